"""Alignment kernels on strings, in numpy, one row of the matrix at a time; no Spark here.

Rows are filled from the one above with vector operations; a gap inside a row is a running minimum, for a gap of
k costs a constant more per base.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BIG = np.int64(1) << 40


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), "<u4")


def levenshtein(a: str, b: str) -> int:
    """Unit-cost edit distance."""
    if not a or not b:
        return len(a) + len(b)
    x, y = _codes(a), _codes(b)
    at = np.arange(len(y) + 1)
    row = at.copy()
    for i, c in enumerate(x, 1):
        new = np.minimum(row + 1, np.concatenate([[i], row[:-1] + (y != c)]))
        row = np.minimum.accumulate(new - at) + at
    return int(row[-1])


def affine_matrices(a: str, b: str, sub: int, open_: int, extend: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least costs (len(a) + 1, len(b) + 1): any end, ending in a gap in b, ending in a gap in a."""
    x, y = _codes(a), _codes(b)
    n, m = len(x), len(y)
    at = np.arange(m + 1, dtype=np.int64)
    best, up, left = (np.full((n + 1, m + 1), BIG, np.int64) for _ in range(3))
    best[0], left[0, 1:] = open_ + extend * at, open_ + extend * at[1:]
    best[0, 0] = 0
    for i in range(1, n + 1):
        up[i] = np.minimum(best[i - 1] + open_ + extend, up[i - 1] + extend)
        here = up[i].copy()
        here[1:] = np.minimum(here[1:], best[i - 1, :-1] + np.where(y == x[i - 1], 0, sub))
        opened = np.minimum.accumulate(here - extend * at) + extend * at + open_
        left[i, 1:] = opened[:-1] + extend
        best[i] = np.minimum(here, left[i])
    return best, up, left


def affine_score(a: str, b: str, sub: int, open_: int, extend: int) -> int:
    return int(affine_matrices(a, b, sub, open_, extend)[0][-1, -1])


def affine_cigar(query: str, ref: str, sub: int, open_: int, extend: int, left_aligned: bool = True) -> list[tuple[str, int]]:
    """Run-length operations (=, X, I, D) of a cheapest global alignment of query to ref.

    Traced from the end, an insertion is preferred to a deletion, to a substitution, to a match, and a gap goes
    on where it can; on reversed strings this puts gaps as far left as they go.
    """
    q, r = (query[::-1], ref[::-1]) if left_aligned else (query, ref)
    best, up, left = affine_matrices(q, r, sub, open_, extend)
    i, j, state, ops = len(q), len(r), "M", []
    while i or j:
        if state == "M":
            if i and best[i, j] == up[i, j]:
                state = "I"
            elif j and best[i, j] == left[i, j]:
                state = "D"
            else:
                ops.append("=" if q[i - 1] == r[j - 1] else "X")
                i, j = i - 1, j - 1
        elif state == "I":
            ops.append("I")
            if not (i > 1 and up[i, j] == up[i - 1, j] + extend):
                state = "M"
            i -= 1
        else:
            ops.append("D")
            if not (j > 1 and left[i, j] == left[i, j - 1] + extend):
                state = "M"
            j -= 1
    if not left_aligned:
        ops.reverse()
    runs: list[tuple[str, int]] = []
    for op in ops:
        runs.append((op, runs.pop()[1] + 1) if runs and runs[-1][0] == op else (op, 1))
    return runs


CELLS = 1 << 20  # of the matrices that are filled together; a longer pair goes alone


def _alike(n: np.ndarray, m: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of lengths in groups of similar ones, of CELLS cells at most when filled up to the longest."""
    order = np.lexsort((m, n // 16))
    rows, at = (n // 16 + 1) * 16, 0
    while at < len(order):
        own = order[at : at + CELLS]
        cells = np.arange(1, len(own) + 1) * rows[own] * (m[own] + 1)  # m ascends among those of equal rows
        fits = (rows[own] == rows[own[0]]) & (m[own] <= 1.5 * m[own[0]] + 16) & (cells <= CELLS)
        size = max(1, int(np.argmin(fits)) if not fits.all() else len(own))
        yield own[:size]
        at += size


def _padded(strings: list[str]) -> np.ndarray:
    """Codes of the strings backwards, a row each, filled up with zeros."""
    sizes = np.array([len(s) for s in strings])
    out = np.zeros((len(strings), sizes.max(initial=0)), "<u4")
    out[np.arange(out.shape[1]) < sizes[:, None]] = _codes("".join(s[::-1] for s in strings))
    return out


def affine_cigars(queries: list[str], refs: list[str], sub: int, open_: int, extend: int) -> list[list[tuple[str, int]]]:
    """affine_cigar of each query and reference, gaps leftmost; pairs of similar lengths are filled and traced together.

    What a pair is filled up with lies beyond its last cell, which no cell of its own looks at.
    """
    out: list[list[tuple[str, int]]] = [[]] * len(queries)
    n_all, m_all = (np.array([len(s) for s in x], np.int64) for x in (queries, refs))
    for own in _alike(n_all, m_all):
        q, r = _padded([queries[k] for k in own]), _padded([refs[k] for k in own])
        size, n, m = len(own), q.shape[1], r.shape[1]
        at = extend * np.arange(m + 1, dtype=np.int32)
        best, up, left = (np.full((n + 1, size, m + 1), 1 << 29, np.int32) for _ in range(3))
        best[0], left[0, :, 1:] = open_ + at, open_ + at[1:]
        best[0, :, 0] = 0
        for i in range(1, n + 1):
            up[i] = np.minimum(best[i - 1] + np.int32(open_ + extend), up[i - 1] + np.int32(extend))
            here = up[i].copy()
            here[:, 1:] = np.minimum(here[:, 1:], best[i - 1, :, :-1] + np.where(r == q[:, i - 1 : i], 0, sub).astype(np.int32))
            left[i, :, 1:] = (np.minimum.accumulate(here - at, axis=1) + at)[:, :-1] + np.int32(open_ + extend)
            best[i] = np.minimum(here, left[i])
        k, i, j, state = np.arange(size), n_all[own], m_all[own], np.zeros(size, np.int8)
        pairs, ops = [], []
        while True:
            on = (i > 0) | (j > 0)
            if not on.all():
                k, i, j, state = k[on], i[on], j[on], state[on]
                if not len(k):
                    break
            b, u, f = best[i, k, j], up[i, k, j], left[i, k, j]
            ins = (state == 1) | ((state == 0) & (i > 0) & (b == u))
            gap = ~ins & ((state == 2) | ((state == 0) & (j > 0) & (b == f)))
            diag = ~(ins | gap)
            same = np.zeros(len(k), bool)
            same[diag] = q[k[diag], i[diag] - 1] == r[k[diag], j[diag] - 1]
            pairs.append(k)
            ops.append(np.where(ins, 0, np.where(gap, 1, np.where(same, 2, 3))).astype(np.int8))
            on_i = ins & (i > 1) & (u == up[i - 1, k, j] + extend)
            on_d = gap & (j > 1) & (f == left[i, k, j - 1] + extend)
            state = np.where(on_i, 1, np.where(on_d, 2, 0)).astype(np.int8)
            i, j = i - ~gap, j - ~ins
        if not ops:
            continue
        pair, op = np.concatenate(pairs), np.concatenate(ops)
        order = np.argsort(pair, kind="stable")
        pair, op = pair[order], op[order]
        edge = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (op[1:] != op[:-1])]))
        runs = list(zip(["ID=X"[x] for x in op[edge].tolist()], np.diff(np.append(edge, len(op))).tolist()))
        first = np.searchsorted(pair[edge], np.arange(size + 1)).tolist()
        for x, a, z in zip(own.tolist(), first, first[1:]):
            out[x] = runs[a:z]
    return out


def cigar_cost(cigar: list[tuple[str, int]], sub: int, open_: int, extend: int) -> int:
    return sum(sub * n if op == "X" else open_ + extend * n if op in "ID" else 0 for op, n in cigar)


def cigar_variants(cigar: list[tuple[str, int]], query: str, ref: str, beg: int) -> list[tuple[int, str, str, str]]:
    """(pos, type, ref, alt): substitutions base by base, insertions and deletions as runs."""
    out, i, j = [], 0, 0
    for op, n in cigar:
        if op == "X":
            out.extend((beg + j + k, "SNP", ref[j + k], query[i + k]) for k in range(n))
        elif op == "I":
            out.append((beg + j, "INS", "", query[i : i + n]))
        elif op == "D":
            out.append((beg + j, "DEL", ref[j : j + n], ""))
        i, j = i + n * (op in "=XI"), j + n * (op in "=XD")
    return out


def apply_variants(ref: str, beg: int, variants: list[tuple[int, int, str]]) -> str:
    """The haplotype: variants (pos, rlen, alt) in order applied to ref, which starts at beg."""
    out, at = [], beg
    for pos, rlen, alt in variants:
        out += [ref[at - beg : pos - beg], alt]
        at = pos + rlen
    return "".join(out) + ref[at - beg :]


def max_reach(query: str, ref: str, last_change: int, budget: int, sub: int, open_: int, extend: int) -> tuple[int, bool]:
    """Greatest reference column that an alignment from the start reaches at a cost within budget, off the trivial path.

    The trivial path runs on the diagonal of the two ends (ref shifted by the change in length) beyond the last
    change; a cell there does not count.  Also whether such an alignment comes to the end of either string, so that
    longer ones might let it go on.
    """
    best, _, _ = affine_matrices(query, ref, sub, open_, extend)
    i, j = np.nonzero(best <= budget)
    shift = len(ref) - len(query)
    off = ~((j - i == shift) & (j >= last_change))
    i, j = i[off], j[off]
    return int(j.max(initial=0)), bool(((i == len(query)) | (j == len(ref))).any())
