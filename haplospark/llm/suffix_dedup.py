"""Suffix-array deduplication: remove every byte covered by a long string that also starts elsewhere.

Prefix doubling, on a sparse set of positions.  A full suffix array would rank every byte in every round; here
only *anchors* are ranked: positions whose string of a quarter of the length has the least hash in some window
of the length.  (Numbers below are for 400 bytes.)  Equal 400-byte strings hold the same anchors at the same
places, so no repeat is lost, and about one byte in 150 is ranked.  An anchor stands for the windows that hold
it, given as offsets o (the window starts o bytes before the anchor, 0 <= o <= 300).

Each round ranks strings around the anchors, deals rank and position by rank, and tells apart:

* strings whose rank is unique: no window of this range repeats, drop the range;
* ranges whose whole union of windows repeats: all its windows repeat, the union is removed;
* the others: cut the range and rank again at a greater length.  The new rank is the pair of the old rank and the
  names of what the string gains before and behind, so no round reads again what an earlier one has ranked.

What all windows of a range share grows 100, 337, 385, 397, 400 bytes: the *rest* to the threshold shrinks to a
quarter each round, where plain doubling would double the length.  Doubling would reach 400 in two rounds, but
could not say which of an anchor's 301 windows repeat without ranking all of them.  The last round ranks single
400-byte windows, so the result is exact (ranks are 64-bit names).  Groups are counted with partial aggregation
and never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haplospark.llm.common import binary_parts, bucketed, keyed_texts, mix64, slices, small_batches, staged, unstage

BLOCK = 1 << 18  # bytes hashed at a time
BASE = 0x9E3779B97F4A7C15 | 1
WIDTHS = (64, 16, 4, 1)  # offsets per range, round by round


class Hasher:
    """Polynomial hashes of substrings modulo 2^64 over random byte values."""

    def __init__(self, room: int):
        rng = np.random.default_rng(20240601)
        self.byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.grow(room)

    def grow(self, room: int) -> None:
        self.room = room
        with np.errstate(over="ignore"):
            self.power = np.ones(room + 1, np.uint64)
            self.power[1:] = np.uint64(BASE)
            self.power = np.multiply.accumulate(self.power)
            self.inverse = np.ones(room + 1, np.uint64)
            self.inverse[1:] = np.uint64(pow(BASE, -1, 1 << 64))
            self.inverse = np.multiply.accumulate(self.inverse)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(data) > self.room:
            self.grow(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.byte[data] * self.power[: len(data)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Names of data[begin:end]."""
        return mix64((prefix[end] - prefix[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64))


def seed_of(length: int) -> int:
    """Bytes ranked at an anchor in the first round."""
    return length // 4


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over values[i:i+width] for each i, in two passes over blocks of that width."""
    n = len(values)
    fill = values[-1:]
    padded = np.concatenate([values, np.repeat(fill, -n % width)]).reshape(-1, width)
    left = best.accumulate(padded, axis=1).ravel()
    right = best.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(right[: n - width + 1], left[width - 1 : n])


def _pieces(offsets: np.ndarray, length: int) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """Groups of (row, slice begin, slice end, own begin, own end) within the text, of about BLOCK bytes.

    A longer text is cut; each piece sees 2 * length more bytes on either side than it owns.
    """
    group, size = [], 0
    for row in range(len(offsets) - 1):
        n = int(offsets[row + 1] - offsets[row])
        if n < length:
            continue
        for begin in range(0, n, BLOCK):
            end = min(n, begin + BLOCK)
            lo, hi = max(0, begin - 2 * length), min(n, end + 2 * length)
            if group and size + hi - lo > 2 * BLOCK:
                yield group
                group, size = [], 0
            group.append((row, lo, hi, begin, end))
            size += hi - lo
    if group:
        yield group


def anchors_of(offsets: np.ndarray, data: memoryview, length: int, hasher: Hasher) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, position, least offset, greatest offset, rank of the core, rank of the union) of each anchor."""
    size = seed_of(length)
    reach = length - size  # greatest offset
    raw = np.frombuffer(data, np.uint8)
    for group in _pieces(offsets, length):
        part = [raw[offsets[r] + lo : offsets[r] + hi] for r, lo, hi, _, _ in group]
        sizes = np.array([len(p) for p in part])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        text = np.concatenate(part)
        prefix = hasher.prefix(text)
        seed = mix64((prefix[size:] - prefix[:-size]) * hasher.inverse[: len(text) - size + 1])
        least = _sliding(seed, reach + 1, np.minimum)  # of each window
        valid = np.zeros(len(least), bool)
        for at, n in zip(starts, sizes):
            valid[at : at + n - length + 1] = True
        least[~valid] = 0
        edge = np.zeros(reach, np.uint64)
        most = _sliding(np.concatenate([edge, least, edge]), reach + 1, np.maximum)  # over the windows that hold a position
        found = np.flatnonzero((most == seed) & (seed != 0))
        piece = np.searchsorted(starts, found, side="right") - 1
        row, lo, _, own, own_end = (np.array(x, np.int64)[piece] for x in zip(*group))
        pos = found - starts[piece] + lo
        n = offsets[row + 1] - offsets[row]
        first, last = np.maximum(0, pos + length - n), np.minimum(reach, pos)
        keep = (pos >= own) & (pos < own_end) & (first <= last)
        found, row, pos, first, last = (x[keep] for x in (found, row, pos, first, last))
        union = _pair(seed[found], hasher.of(prefix, found - last, found), hasher.of(prefix, found + size, found - first + length), first, last)
        yield row, pos, first, last, seed[found], union


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _pair(rank: np.ndarray, before: np.ndarray, behind: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """New rank: the old one paired with the names of what the string gains on either side, and where it lies."""
    gained = mix64(before * np.uint64(5) + mix64(behind + ((first << 32) + last).astype(np.uint64)))
    return mix64(rank * np.uint64(3) ^ gained)


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(2 * BLOCK + 4 * length)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            offsets, data = binary_parts(batch.column(1))
            for row, pos, first, last, seed, union in anchors_of(offsets, data, length, hasher):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row]), _as_long(pos), _as_long(first), _as_long(last), _as_long(seed), _as_long(union)],
                    ["row_id", "pos", "first", "last", "rank", "whole"],
                )

    return run


ANCHOR = "row_id long, pos long, first long, last long, rank long, whole long"


def _context_rows(length: int):
    """Cut the text around each open anchor: from the start of its first window to the end of its last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            offsets, data = binary_parts(batch.column("text"))
            out = {k: [] for k in CONTEXT_COLUMNS}
            for i, (row_id, open_) in enumerate(zip(batch.column("row_id").to_pylist(), batch.column("open").to_pylist())):
                for a in open_:
                    begin = offsets[i] + a["pos"]
                    out["context"].append(bytes(data[begin - a["last"] : begin - a["first"] + length]))
                    out["row_id"].append(row_id)
                    out["at"].append(a["last"])
                    for k in ("pos", "first", "last", "rank"):
                        out[k].append(a[k])
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "context" else pa.int64()) for k, v in out.items()], list(out))

    return run


CONTEXT_COLUMNS = ("row_id", "pos", "first", "last", "rank", "at", "context")
CONTEXT = "row_id long, pos long, first long, last long, rank long, at long, context binary"


def _split_rows(length: int, wider: int, width: int):
    """Cut each open range, a part of a multiple of wider, at multiples of width; rank the parts by what their windows share."""
    reach = length - seed_of(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(BLOCK)
        for batch in slices(batches, 2048):
            offsets, data = binary_parts(batch.column("context"))
            row_id, pos, first, last, rank, at = (batch.column(k).to_numpy(zero_copy_only=False) for k in CONTEXT_COLUMNS[:-1])
            text = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
            prefix, starts = hasher.prefix(text), offsets[:-1] - offsets[0]
            cuts = last // width - first // width + 1
            of = np.repeat(np.arange(len(cuts)), cuts)
            low = (np.arange(len(of)) - np.repeat(np.cumsum(cuts) - cuts, cuts) + (first // width)[of]) * width
            high = np.minimum(low + width - 1, reach)
            old_low = first[of] // wider * wider
            old_high = np.minimum(old_low + wider - 1, reach)
            a, b = np.maximum(first[of], low), np.minimum(last[of], high)
            anchor = starts[of] + at[of]  # where the anchor lies in its context
            # what the windows of the whole part share: also of a part that the end of a text cuts short
            begin, end = anchor - low, anchor - high + length
            new = _pair(rank[of].view(np.uint64), hasher.of(prefix, begin, anchor - old_low), hasher.of(prefix, anchor - old_high + length, end), low, high)
            union = _pair(new, hasher.of(prefix, anchor - b, begin), hasher.of(prefix, end, anchor - a + length), a, b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row_id[of]), pa.array(pos[of]), _as_long(a), _as_long(b), _as_long(new), _as_long(union)],
                ["row_id", "pos", "first", "last", "rank", "whole"],
            )

    return run


def _sorted_out(ranked: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Of ranked ranges: the byte ranges of those that repeat as a whole; and those of which a part may repeat.

    Of equal ranges one goes on where their rank has other ranges too: it stands for them all when those
    look for their partners.  Keys that repeat are written first, so each join has plain shuffles on both
    sides and Spark can split a rank that holds a large share of all rows.
    """

    def more_than_once(rows: DataFrame, key: str) -> DataFrame:
        return staged(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "keys").hint("shuffle_merge")

    alive = staged(ranked.join(more_than_once(ranked, "rank"), "rank"), "alive")
    unstage(ranked)
    groups = staged(
        alive.groupBy("whole").agg(F.first("rank").alias("rank"), F.count(F.lit(1)).alias("n"), F.min(F.struct("row_id", "pos", "first", "last")).alias("one")), "groups"
    )
    twice = groups.where("n > 1").select("whole").hint("shuffle_merge")
    done = staged(alive.join(twice, "whole").select("row_id", (F.col("pos") - F.col("last")).alias("b"), (F.col("pos") - F.col("first") + length).alias("e")), "ranges")
    unstage(alive)
    open_ = staged(groups.join(more_than_once(groups, "rank"), "rank").select("one.*", "rank"), "open")
    unstage(groups)
    return done, open_


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the union of intervals; those that touch are one."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    return begin[new], end[np.concatenate([new[1:], [True]])]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove the union of the intervals of each text."""
    for batch in slices(batches, 256):
        offsets, data = binary_parts(batch.column("text"))
        cuts = batch.column("cuts")
        begin, end = (cuts.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("b", "e"))
        at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(cuts), 0).to_numpy(zero_copy_only=False))])
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for i in range(batch.num_rows):
            text = data[offsets[i] : offsets[i + 1]]
            b, e = merged(begin[at[i] : at[i + 1]], end[at[i] : at[i + 1]])
            left = b"".join(text[x:y] for x, y in zip([0, *e.tolist()], [*b.tolist(), len(text)]))
            out["n_bytes"].append(len(text))
            out["n_removed"].append(len(text) - len(left))
            out["n_spans"].append(len(b))
            out["kept"].append(left)
        carried = [c for c in batch.schema.names if c not in ("text", "cuts")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in carried), *(pa.array(v, pa.binary() if k == "kept" else pa.int64()) for k, v in out.items()), pa.array([hashlib.sha256(x).hexdigest() for x in out["kept"]])],
            [*carried, *out, "kept_sha256"],
        )


def repeated_ranges(texts: DataFrame, length: int = 400) -> DataFrame:
    """(row_id, b, e): byte ranges of (row_id, text) that some repeated string of that many bytes covers."""
    if length < 64:
        raise ValueError("length must be 64 or more")
    anchors = staged(texts.select("row_id", "text").mapInArrow(_anchor_rows(length), ANCHOR), "anchors")
    ranges, open_ = _sorted_out(anchors, length)
    by_text = open_.groupBy("row_id").agg(F.collect_list(F.struct("pos", "first", "last", "rank")).alias("open"))
    context = staged(texts.select("row_id", "text").join(by_text.hint("shuffle_merge"), "row_id").mapInArrow(_context_rows(length), CONTEXT), "context")
    todo, wider = context, length - seed_of(length) + 1
    for width in WIDTHS:
        done, open_ = _sorted_out(staged(todo.mapInArrow(_split_rows(length, wider, width), ANCHOR), "parts"), length)
        wider = width
        ranges = ranges.unionByName(done)
        if width > 1:
            last = todo
            todo = staged(open_.join(context.select("row_id", "pos", "at", "context"), ["row_id", "pos"]).select(*CONTEXT_COLUMNS), "context")
            if last is not context:
                unstage(last)
    unstage(context, todo)
    return ranges


def suffix_array_dedup(docs: DataFrame, length: int = 400, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Remove each byte covered by a string of `length` bytes that starts at two places or more.

    Texts are UTF-8 bytes; matches stay within one text; overlaps count; strings are judged on the input.
    Returns a row per input row: row_id, doc_id, rest (the other columns as one struct, if there are any), n_bytes,
    n_removed, n_spans, kept (binary), kept_sha256.  A null text is empty; empty and short texts lose nothing; null or repeated ids are rows of
    their own, so a repeated row of `length` bytes or more loses all its text; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    texts = bucketed(keyed_texts(docs, text_col, id_col, rest=True), "row_id", "texts")
    ranges = repeated_ranges(texts, length)
    cuts = ranges.groupBy("row_id").agg(F.collect_list(F.struct("b", "e")).alias("cuts")).hint("shuffle_merge")
    schema = T.StructType([f for f in texts.schema if f.name != "text"])
    for name in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(name, "long")
    return texts.join(cuts, "row_id", "left").mapInArrow(_cut, schema.add("kept", "binary").add("kept_sha256", "string"))
