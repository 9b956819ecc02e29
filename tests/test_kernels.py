import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from haplospark.kernels import align as A
from haplospark.kernels import graph as G

dna = st.text(alphabet="ACGT", max_size=14)


def slow_levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def slow_affine(a, b, x, o, e):
    inf = 10**9
    m = [[[inf] * 3 for _ in range(len(b) + 1)] for _ in range(len(a) + 1)]
    m[0][0][0] = 0
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i and j:
                m[i][j][0] = min(m[i - 1][j - 1]) + (0 if a[i - 1] == b[j - 1] else x)
            if i:
                m[i][j][1] = min(min(m[i - 1][j]) + o + e, m[i - 1][j][1] + e)
            if j:
                m[i][j][2] = min(min(m[i][j - 1]) + o + e, m[i][j - 1][2] + e)
    return min(m[-1][-1])


@settings(max_examples=200, deadline=None)
@given(dna, dna)
def test_levenshtein(a, b):
    assert A.levenshtein(a, b) == slow_levenshtein(a, b)


@settings(max_examples=150, deadline=None)
@given(dna, dna)
def test_affine_score_and_cigar(a, b):
    want = slow_affine(a, b, 5, 6, 2)
    assert A.affine_score(a, b, 5, 6, 2) == want
    cigar = A.affine_cigar(a, b, 5, 6, 2)
    assert A.cigar_cost(cigar, 5, 6, 2) == want
    v = A.cigar_variants(cigar, a, b, 100)
    assert A.apply_variants(b, 100, [(p, len(r), alt) for p, _, r, alt in v]) == a


def test_gaps_go_left():
    assert A.affine_cigar("GAAAAT", "GAAAT", 5, 6, 2) == [("=", 1), ("I", 1), ("=", 4)]


def random_variants(rng, n):
    out, at = [], 3
    while at < n - 6:
        kind = rng.choice(["snp", "ins", "del"])
        alt = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 4)))
        out.append({"snp": (at, 1, alt[0], 30.0), "ins": (at, 0, alt, 20.0), "del": (at, rng.randint(1, 3), "", 10.0)}[kind])
        at += rng.randint(5, 12)
    return out


def subsets(xs):
    for mask in range(1 << len(xs)):
        yield [x for i, x in enumerate(xs) if mask >> i & 1]


def test_graph_distance_is_that_of_the_best_subset():
    rng = random.Random(1)
    for _ in range(60):
        ref = "".join(rng.choice("ACGT") for _ in range(30))
        q, t = random_variants(rng, 30), random_variants(rng, 30)
        hap = A.apply_variants(ref, 0, [v[:3] for v in t])
        want = min(A.levenshtein(A.apply_variants(ref, 0, [v[:3] for v in s]), hap) for s in subsets(q))
        assert G.distance(ref, 0, q, t) == want


def test_equal_calls_are_all_right():
    rng = random.Random(2)
    for _ in range(60):
        ref = "".join(rng.choice("ACGT") for _ in range(60))
        t = [v for v in random_variants(rng, 60) if not (v[1] == 1 and ref[v[0]] == v[2])]
        edits, q, r = G.evaluate(ref, 0, t, t, 60)
        assert edits == 0 and all(x.errtype == "TP" and x.credit == 1 for x in q + r)


REF = "ACGTTGCAAGCTTACGGATCCATGCAATTGCCGTAGCTAAGTCCGATTACGGCATTGACCA"


def test_no_query_calls():
    t = [(10, 1, "T" if REF[10] != "T" else "A", 0.0)]
    edits, q, r = G.evaluate(REF, 0, [], t, 60)
    assert (edits, q, r[0].errtype, r[0].callq) == (1, [], "FN", 60)


def test_wrong_call_is_left_out():
    q = [(20, 1, "A" if REF[20] != "A" else "C", 10.0)]
    edits, out, _ = G.evaluate(REF, 0, q, [], 60)
    assert edits == 0 and out[0].errtype == "FP" and out[0].credit == 0 and out[0].callq == 10


@pytest.mark.parametrize("n, errtype", [(9, "TP"), (6, "FP"), (7, "FP")])
def test_partial_credit(n, errtype):
    """Ten bases inserted, of which the query has some; 7/10 is below the threshold in single precision."""
    alt = "GTCAGGACTC"
    edits, q, t = G.evaluate(REF, 0, [(30, 0, alt[:n], 30.0)], [(30, 0, alt, 0.0)], 60)
    assert edits == 10 - n and q[0].errtype == errtype and t[0].errtype == ("TP" if errtype == "TP" else "FN")
    assert abs(q[0].credit - n / 10) < 1e-6
