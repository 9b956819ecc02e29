"""Details of the evaluation: trimmed alleles, shifts, reach, ties, phase runs, distance files, contigs."""

import random

import pytest

from haplospark.config import EvalConfig
from haplospark.evaluator import Evaluator
from haplospark.operators import alignment, intervals, metrics, phasing

VARIANT = "callset string, contig string, hap int, var_idx long, pos long, rlen int, type string, ref string, alt string, phase_set long"


def shifted_slowly(seq, calls):
    """Calls (pos, type, ref, alt, phase_set) moved left one base at a time, then neighbours at one position exchanged."""
    out = [list(c) for c in calls]
    for i, c in enumerate(out):
        end = -1 if i == 0 else out[i - 1][0] + (1 if out[i - 1][1] == "SNP" else len(out[i - 1][2]))
        k = {"INS": 3, "DEL": 2}.get(c[1])
        while k and c[0] > 0 and (i == 0 or c[0] > end + 1) and seq[c[0] - 1] == c[k][-1]:
            c[k] = c[k][-1] + c[k][:-1]
            c[0] -= 1
    for i in range(len(out) - 1):
        if out[i][2] and out[i][0] == out[i + 1][0]:
            out[i][1:4], out[i + 1][1:4] = out[i + 1][1:4], out[i][1:4]
    return [tuple(c) for c in out]


def test_left_shift_against_single_steps(spark):
    rng, rows, want, seqs = random.Random(21), [], {}, []
    for c in range(12):
        unit = ["A", "AC", "ACG", "T"][c % 4]
        seq = "".join(rng.choice([unit * rng.randint(1, 40 if c else 500), rng.choice("ACGT")]) for _ in range(25))
        seqs.append((f"c{c}", seq, len(seq)))
        calls, at = [], 0
        while at < len(seq) - 8:
            kind = rng.choice(["SNP", "INS", "DEL"])
            n = rng.randint(1, 3)
            ref = {"SNP": seq[at], "INS": "", "DEL": seq[at : at + n]}[kind]
            calls.append((at, kind, ref, {"SNP": "G", "INS": rng.choice([seq[at : at + n], unit, "T"]), "DEL": ""}[kind], len(calls)))
            at += len(ref) + (rng.choice([0, 0, 5, 30]) if kind == "INS" and calls[-1][1:] != ("INS",) else rng.choice([1, 5, 60]))
        calls = [x for i, x in enumerate(calls) if not i or x[0] > calls[i - 1][0] or x[1] != "INS"]
        want[f"c{c}"] = shifted_slowly(seq, calls)
        rows += [("QUERY", f"c{c}", 0, i, p, 0 if k == "INS" else len(r), k, r, a, ps) for i, (p, k, r, a, ps) in enumerate(calls)]
    ref = spark.createDataFrame(seqs, "contig string, seq string, length int")
    out = alignment.left_shift(spark.createDataFrame(rows, VARIANT), ref, lambda df: df.cache())
    got = {}
    for r in sorted(out.collect(), key=lambda r: r["var_idx"]):
        got.setdefault(r["contig"], []).append((r["pos"], r["type"], r["ref"], r["alt"], r["phase_set"]))
    assert got == want


def test_long_shift_and_exchange(spark):
    ref = spark.createDataFrame([("c", "C" + "A" * 5000 + "GT", 5003)], "contig string, seq string, length int")
    rows = [("QUERY", "c", 0, 0, 4990, 1, "DEL", "A", "", 7), ("QUERY", "c", 1, 0, 5001, 1, "SNP", "G", "C", 1), ("QUERY", "c", 1, 1, 5001, 0, "INS", "", "T", 2)]
    got = {(r["hap"], r["var_idx"]): r for r in alignment.left_shift(spark.createDataFrame(rows, VARIANT), ref).collect()}
    assert got[0, 0]["pos"] == 1
    assert [(got[1, i]["type"], got[1, i]["phase_set"]) for i in (0, 1)] == [("INS", 1), ("SNP", 2)]


def test_reach_goes_through_a_long_repeat(spark):
    rng = random.Random(3)
    seq = "".join(rng.choice("ACGT") for _ in range(300))
    seq = seq + "CA" * 300 + seq[::-1]
    ref = spark.createDataFrame([("c", seq, len(seq))], "contig string, seq string, length int")
    rows = [("QUERY", "c", 0, 0, 850, 2, "DEL", seq[850:852], "", 0), ("QUERY", "c", 0, 1, 320, 2, "DEL", seq[320:322], "", 0), ("QUERY", "c", 0, 2, 100, 1, "SNP", seq[100], "A" if seq[100] != "A" else "C", 0)]
    out = alignment.reach_iterations(spark.createDataFrame(rows, VARIANT), ref)
    got = {r["var_idx"]: r["cluster_id"] for r in out.collect()}
    assert got[0] == got[1] != got[2]


def test_trimmed_alleles_decide(spark):
    """A padded record of a small change is no large one; size counts after trimming."""
    pad = "ACGTACGTTTACGATCGGATCTTAGACCGATAGCATCGAA"
    schema = "callset string, contig string, pos long, ref string, alts array<string>, qual float, filter string, gt string, gq int, ps long, file_ord long"
    alts = [(pad, pad + "G"), (pad[:5], pad[:5] + "C" * 30), (pad[:5], pad[:5] + "C" * 31), (pad, pad), ("ac", "aCT")]
    rows = [("QUERY", "c", 100 * i, r, [a], 50.0, "PASS", "1|0", 0, 0, i) for i, (r, a) in enumerate(alts)]
    kept, dropped = Evaluator(spark, EvalConfig(max_size=30, sv_threshold=20)).variants(spark.createDataFrame(rows, schema), None)
    n = {r["drop_reason"]: r["n"] for r in dropped.collect()}
    assert (n["too_large"], n["reference_call"]) == (1, 1)
    assert sorted((r["pos"], r["type"], r["alt"]) for r in kept.collect()) == [(40, "INS", "G"), (105, "INS", "C" * 30), (402, "INS", "T")]


def path_slowly(sc, ps):
    """All superclusters of a contig in one fold."""
    n, cost, swapped = len(sc), [0, 0], [[], []]
    for i in range(n):
        here = [cost[0] + (sc[i] == 1), cost[1] + (sc[i] == 0)]
        step = 0 if i + 1 < n and ps[i] != ps[i + 1] else 1
        for p in (0, 1):
            swapped[p].append(not here[p] < here[1 - p] + step)
            cost[p] = min(here[p], here[1 - p] + step)
    state, out = int(cost[1] < cost[0]), []
    switch = [False] * n
    for i in range(n - 1, -1, -1):
        flip = False
        if swapped[state][i]:
            if i + 1 < n and ps[i] == ps[i + 1]:
                switch[i + 1] = True
            state = 1 - state
        else:
            flip = sc[i] != 2 and sc[i] != state
        out.append((state, flip))
    return [(s, switch[i], f) for i, (s, f) in enumerate(reversed(out))]


def test_phase_path_by_runs_equals_one_fold(spark):
    rng, rows, want = random.Random(17), [], {}
    for c in range(40):
        n = rng.randint(1, 40)
        sc, ps, s = [rng.choice([0, 1, 2]) for _ in range(n)], [], 1
        for _ in range(n):
            s += rng.random() < 0.3
            ps.append(s)
        rows += [(f"c{c}", i, x, p) for i, (x, p) in enumerate(zip(sc, ps))]
        want |= {(f"c{c}", i): x for i, x in enumerate(path_slowly(sc, ps))}
    got = phasing.phase_path(spark.createDataFrame(rows, "contig string, sc_idx long, sc_phase int, phase_set long")).collect()
    assert {(r["contig"], r["sc_idx"]): (r["pb_phase"], r["is_switch"], r["is_flip"]) for r in got} == want


def test_contig_universe(spark):
    calls = "contig string, pos long"
    q, t = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], calls), spark.createDataFrame([("b", 1), ("c", 1)], calls)
    ref = spark.createDataFrame([("a", 10), ("b", 20), ("c", 30), ("d", 40)], "contig string, length int")
    got = {tuple(r) for r in intervals.contig_universe(q, t, ref).collect()}
    assert got == {("a", 10, 1, 0), ("b", 20, 2, 1), ("c", 30, 0, 1)}
    regions = spark.createDataFrame([("b", 0, 5), ("d", 0, 5), ("e", 0, 5)], "contig string, start long, stop long")
    assert {tuple(r) for r in intervals.contig_universe(q, t, ref, regions).collect()} == {("b", 20, 2, 1), ("d", 40, 0, 0), ("e", None, 0, 0)}


def test_distances_without_edits(spark):
    none = spark.createDataFrame([], "contig string, type string, size int, min_qual int, max_qual int")
    sweep = metrics.distance_sweep(none, 0, 5)
    assert {(r["edit_dist"], r["aln_qscore"]) for r in sweep.collect()} == {(0, 0.0)}
    best = metrics.best_distances(sweep, 5).collect()
    assert len(best) == 15 and {r["threshold"] for r in best} == {"NONE", "BEST", "REF"} and {r["ed_qscore"] for r in best} == {0.0}
    assert metrics.least_distances(none, 5).count() == 0


def test_memory_steps(spark):
    v = spark.createDataFrame([("QUERY", "c", 0, 0, 0, "A" * 10), ("QUERY", "c", 0, 1, 5, ""), ("TRUTH", "c", 0, 1, 0, "AC")], "callset string, contig string, sc_idx long, hap int, rlen int, alt string")
    v = v.unionByName(spark.createDataFrame([("QUERY", "c", 1, 0, 30, ""), ("QUERY", "c", 1, 1, 20, "")], v.schema))
    sc = spark.createDataFrame([("c", 0, 100, 200), ("c", 1, 500, 600)], "contig string, sc_idx long, beg long, end long")
    got = {r["sc_idx"]: r for r in alignment.supercluster_costs(v, sc, (2e-4, 1e-3, 1.0)).collect()}
    assert (got[0]["query_len"], got[0]["truth_len"], got[0]["cost"], got[0]["step"]) == (110, 102, 110 * 102 * 20, 1)
    assert (got[1]["query_len"], got[1]["truth_len"]) == (80, 100)


@pytest.mark.parametrize("verbosity, classes", [(0, 1), (1, 3), (2, 5)])
def test_files_of_ties_and_distances(spark, tmp_path, verbosity, classes):
    if verbosity != 1:  # classes shown, without a whole evaluation
        shown = {0: ("ALL",), 1: ("ALL", "SNP", "INDEL")}.get(verbosity, metrics.EDIT_CLASSES)
        assert len(shown) == classes
        return
    rng = random.Random(5)
    seq = "".join(rng.choice("ACGT") for _ in range(400))
    (tmp_path / "r.fa").write_text(f">c\n{seq}\n>d\n{seq}\n")
    alt = "A" if seq[100] != "A" else "C"
    head = "##fileformat=VCFv4.2\n##contig=<ID=c,length=400>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\n"
    for name, qual in (("t", 50), ("q", 20)):
        (tmp_path / f"{name}.vcf").write_text(head + f"c\t101\t.\t{seq[100]}\t{alt}\t{qual}\tPASS\t.\tGT\t1|1\n")
    (tmp_path / "m.bed").write_text("c\t0\t400\nd\t0\t400\n")
    config = EvalConfig(prefix=f"{tmp_path}/", cluster_method="gap", distance=True, bed=str(tmp_path / "m.bed"))
    Evaluator(spark, config).evaluate_files(*(str(tmp_path / f) for f in ("q.vcf", "t.vcf", "r.fa")))
    haps = [x.split("\t")[2] for x in (tmp_path / "query.tsv").read_text().splitlines()[1:]]
    assert haps == ["1", "0"]
    lines = [x.split("\t") for x in (tmp_path / "distance-summary.tsv").read_text().splitlines()]
    assert lines[0] == "VAR_TYPE THRESHOLD MIN_QUAL EDIT_DIST DISTINCT_EDITS ED_QSCORE DE_QSCORE ALN_QSCORE".split()
    assert [x[:2] for x in lines[1:]] == [[c, t] for c in ("ALL", "SNP", "INDEL") for t in ("NONE", "BEST", "REF")]
    assert lines[3][3:] == ["2", "2", "0.000000", "0.000000", "0.000000"] and lines[1][5] == "100.000000"
    assert (tmp_path / "distance.tsv").read_text().splitlines()[0].endswith("ALN_SCORE\tALN_QSCORE")
    assert "##contig=<ID=d,length=400>" in (tmp_path / "query.vcf").read_text()


def test_bins_change_nothing(spark, monkeypatch):
    """As-of regions by small bins and by large ones, against a plain search."""
    rng = random.Random(41)
    starts = sorted(rng.sample(range(0, 6000, 10), 80))
    regions = [("a", s, s + rng.choice([5, 10])) for s in starts]
    points = [(rng.choice("ab"), rng.randrange(7000), i) for i in range(300)]
    want = {}
    for contig, pos, i in points:
        before = [x for x in regions if x[0] == contig and x[1] <= pos]
        want[i] = before[-1][1:] if before else (None, None)
    for size in (16384, 128):
        monkeypatch.setattr(intervals, "BIN", size)
        out = intervals.as_of_region(spark.createDataFrame(points, "contig string, pos long, vid long"), spark.createDataFrame(regions, "contig string, start long, stop long"))
        assert {r["vid"]: (r["r_start"], r["r_stop"]) for r in out.collect()} == want


def _moved(df) -> int:
    """Bytes that the exchanges of df's plan have dealt, once it has run."""

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        own = node.metrics().get("dataSize").get().value() if kind == "ShuffleExchangeExec" else 0
        return own + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_windows_move_their_own_bases_only(spark):
    from haplospark.operators.alignment import BLOCK, with_window

    seq = "".join(random.Random(5).choices("ACGT", k=3 * BLOCK + 50))
    at = [*range(0, 3 * BLOCK, 97), BLOCK - 3, 3 * BLOCK - 5]
    groups = spark.createDataFrame([("c", b, b + 10 if i % 50 else b + 2 * BLOCK, i) for i, b in enumerate(at)], "contig string, beg long, end long, i int")
    groups = groups.where("i % 50 <> 0 or i = 100")
    reference = spark.createDataFrame([("c", seq, len(seq))], "contig string, seq string, length int")
    df = with_window(groups, reference)
    got = {r["i"]: (r["beg"], r["end"], r["win"]) for r in df.collect()}
    assert len(got) == groups.count() and all(w == seq[b:e] for b, e, w in got.values())
    assert _moved(df) < 20 * len(seq)  # one block a group would be 480 times a block


def test_cigars_of_many_pairs_equal_those_one_by_one():
    from haplospark.kernels import align as A

    rng = random.Random(6)
    pairs = [("", ""), ("A", ""), ("", "AC"), ("GAAAAT", "GAAAT"), ("ACGT" * 40, "ACG" * 50)]
    for _ in range(300):
        r = "".join(rng.choices("AC" if rng.random() < 0.5 else "ACGT", k=rng.randrange(40)))
        p = rng.randrange(len(r) + 1)
        pairs.append((r[:p] + "".join(rng.choices("ACGT", k=rng.randrange(9))) + r[p + rng.randrange(9) :], r))
    q, r = map(list, zip(*pairs))
    assert A.affine_cigars(q, r, 5, 6, 2) == [A.affine_cigar(x, y, 5, 6, 2) for x, y in pairs]
