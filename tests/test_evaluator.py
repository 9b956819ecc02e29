import random

import pytest

from haplospark.config import EvalConfig, from_args
from haplospark.evaluator import Evaluator
from haplospark.operators import clustering, filters, intervals, metrics, phasing
from haplospark.sources import formats

RNG = random.Random(5)
SEQ = "".join(RNG.choice("ACGT") for _ in range(1000))


def other(base):
    return {"A": "C", "C": "G", "G": "T", "T": "A"}[base]


def snp(pos, gt, qual):
    return f"chrT\t{pos + 1}\t.\t{SEQ[pos]}\t{other(SEQ[pos])}\t{qual}\tPASS\t.\tGT:PS\t{gt}:1"


def vcf(path, lines, sample="S"):
    head = ["##fileformat=VCFv4.2", '##FILTER=<ID=PASS,Description="x">', "##contig=<ID=chrT,length=1000>", f"#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t{sample}"]
    path.write_text("\n".join(head + lines) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("calls")
    (d / "ref.fa").write_text(">chrT some text\n" + "\n".join(SEQ[i : i + 60].lower() for i in range(0, 1000, 60)) + "\n")
    truth = vcf(d / "truth.vcf", [snp(100, "1|0", 50), snp(300, "0|1", 50), snp(700, "1|1", 50)])
    query = vcf(d / "query.vcf", [snp(100, "1|0", 30), snp(500, "1|0", 10), snp(700, "1|1", 40)])
    return d, query, truth, str(d / "ref.fa")


@pytest.mark.parametrize("method", ["gap", "biwfa"])
def test_small_call_set(spark, files, method):
    d, query, truth, ref = files
    config = EvalConfig(prefix=str(d) + f"/{method}-", cluster_method=method, distance=True)
    out = Evaluator(spark, config).evaluate_files(query, truth, ref)
    rows = {(r["callset"], r["pos"], r["hap"]): r for r in out["variants"].collect()}
    assert {k: r["errtype"] for k, r in rows.items()} == {
        ("TRUTH", 100, 0): "TP", ("QUERY", 100, 0): "TP", ("TRUTH", 300, 1): "FN", ("QUERY", 500, 0): "FP",
        ("TRUTH", 700, 0): "TP", ("TRUTH", 700, 1): "TP", ("QUERY", 700, 0): "TP", ("QUERY", 700, 1): "TP",
    }
    sc = [(r["beg"], r["end"], r["orig_ed"], r["swap_ed"], r["sc_phase"]) for r in out["superclusters"].orderBy("beg").collect()]
    assert sc == [(99, 102, 0, 1, 0), (299, 302, 1, 1, 2), (499, 502, 0, 0, 2), (699, 702, 0, 0, 2)]
    pr = {r["min_qual"]: r for r in out["precision_recall"].where("vartype = 'SNP'").collect()}
    for q, want in {0: (3, 1, 3, 1), 10: (3, 1, 3, 1), 11: (3, 0, 3, 1), 31: (2, 0, 2, 2), 41: (0, 0, 0, 4)}.items():
        assert (pr[q]["query_tp"], pr[q]["query_fp"], pr[q]["truth_tp"], pr[q]["truth_fn"]) == want
    assert round(pr[0]["f1_qscore"], 6) == 6.0206 and round(pr[11]["f1_qscore"], 5) == 8.45098 and pr[41]["f1_score"] == 0
    best = out["summary"].where("vartype = 'SNP' and threshold = 'BEST'").first()
    assert best["min_qual"] == 11
    text = (d / f"{method}-precision-recall-summary.tsv").read_text().splitlines()
    assert text[0].startswith("VAR_TYPE\tTHRESHOLD") and len(text) == 9 and text[1].startswith("SNP\tNONE\t0\t3\t3\t1\t1\t0.750000")
    body = [x for x in (d / f"{method}-summary.vcf").read_text().splitlines() if x[0] != "#"]
    assert len(body) == 5 and body[0].split("\t")[1] == "101"
    assert "1|1" in (d / f"{method}-query.vcf").read_text()
    ed = {r["min_qual"]: r["edit_dist"] for r in out["distance"].collect()}
    assert ed[0] == 2 and ed[11] == 1 and ed[61] == 4


def test_representation_only(spark, files, tmp_path):
    d, query, truth, ref = files
    config = EvalConfig(prefix=str(tmp_path) + "/", cluster_method="gap", realign_only=True, realign_query=True, realign_truth=True)
    out = Evaluator(spark, config).evaluate_files(query, truth, ref)
    got = {(r["pos"], r["hap"], r["ref"], r["alt"]) for r in out["query_variants"].collect()}
    assert got == {(p, h, SEQ[p], other(SEQ[p])) for p, h in ((100, 0), (500, 0), (700, 0), (700, 1))}
    assert "variants" not in out and (tmp_path / "truth.vcf").exists()


def test_mask_and_missing_contig(spark, files, tmp_path):
    d, query, truth, ref = files
    (tmp_path / "m.bed").write_text("chrT\t50\t320\n")
    config = EvalConfig(bed=str(tmp_path / "m.bed"), no_output=True, cluster_method="gap")
    out = Evaluator(spark, config).evaluate_files(query, truth, ref)
    assert {r["pos"] for r in out["variants"].collect()} == {100, 300}
    (tmp_path / "bad.bed").write_text("chrT\t50\t320\nchrT\t300\t400\n")
    with pytest.raises(formats.FormatError):
        formats.read_bed(spark, str(tmp_path / "bad.bed"))
    (tmp_path / "u.bed").write_text("chrU\t50\t320\n")
    with pytest.raises(formats.FormatError):
        Evaluator(spark, EvalConfig(bed=str(tmp_path / "u.bed"), no_output=True)).evaluate_files(query, truth, ref)


LOCATIONS = [(9, 1, "SUB", "OUTSIDE"), (10, 1, "SUB", "INSIDE"), (19, 1, "SUB", "INSIDE"), (20, 1, "SUB", "OUTSIDE"), (8, 4, "DEL", "BORDER"), (18, 4, "DEL", "BORDER"), (18, 1, "INS", "INSIDE"), (19, 1, "INS", "BORDER")]


def test_locations(spark):
    v = spark.createDataFrame([(i, "chrT", s, s + n, t) for i, (s, n, t, _) in enumerate(LOCATIONS)] + [(90, "chrU", 1, 2, "SUB")], "vid long, contig string, start long, stop long, type string")
    r = spark.createDataFrame([("chrT", 10, 20)], "contig string, start long, stop long")
    got = {x["vid"]: x["loc"] for x in intervals.located(v, r).collect()}
    assert got == {i: x[3] for i, x in enumerate(LOCATIONS)} | {90: "OFF CTG"}


def test_locations_of_two_regions(spark):
    v = spark.createDataFrame([(0, "c", 22, 25, "SUB"), (1, "c", 18, 32, "DEL")], "vid long, contig string, start long, stop long, type string")
    r = spark.createDataFrame([("c", 10, 20), ("c", 30, 40)], "contig string, start long, stop long")
    assert {x["vid"]: x["loc"] for x in intervals.located(v, r).collect()} == {0: "OUTSIDE", 1: "BORDER"}


CALLS = [(100, 1, 1), (130, 60, 60), (400, 0, 300), (900, 1, 1), (961, 1, 1), (1080, 1, 1)]


@pytest.mark.parametrize("method, want", [("gap", [(50, 240), (350, 450), (850, 1012), (1030, 1131)]), ("size", [(50, 700), (850, 1012), (1030, 1131)])])
def test_clusters(spark, method, want):
    v = spark.createDataFrame([("QUERY", "c", 0, i, p, n, s) for i, (p, n, s) in enumerate(CALLS)], "callset string, contig string, hap int, var_idx long, pos long, rlen long, size long")
    t = clustering.cluster_table(clustering.reach_clusters(clustering.with_reach(v, method, 50)))
    assert [(r["left"], r["right"]) for r in t.orderBy("cluster_id").collect()] == want


PATHS = [
    ("==X==", "11111", "00000", [], [2]),
    ("===XXX", "111111", "000111", [3], []),
    ("=X", "11", "00", [], [1]),
    ("X=", "11", "10", [1], []),
    ("==?XX", "11111", "00011", [3], []),
    ("===X", "1111", "0000", [], [3]),
    ("==XX", "1122", "0011", [], []),
    ("????", "1122", "1100", [], []),
]


@pytest.mark.parametrize("states, sets, block, switches, flips", PATHS)
def test_phase_path(spark, states, sets, block, switches, flips):
    rows = [("c", i, "=X?".index(s), int(p)) for i, (s, p) in enumerate(zip(states, sets))]
    got = phasing.phase_path(spark.createDataFrame(rows, "contig string, sc_idx long, sc_phase int, phase_set long")).orderBy("sc_idx").collect()
    assert "".join(str(r["pb_phase"]) for r in got) == block
    assert [r["sc_idx"] for r in got if r["is_switch"]] == switches
    assert [r["sc_idx"] for r in got if r["is_flip"]] == flips


@pytest.mark.parametrize("sizes, total, want", [([500, 300, 200, 100], 1000, 500), ([300, 200, 100], 1000, 200), ([100, 50], 1000, 0), ([], 10, 0)])
def test_ng50(spark, sizes, total, want):
    got = metrics.ng50(spark.createDataFrame([(s,) for s in sizes], "size long"), total).collect()
    assert (got[0]["ng50"] if got else 0) == want


def test_filters_in_order(spark):
    base = dict(callset="QUERY", contig="c", ref="A", alts=["G"], qual=50.0, filter="PASS", gt="1|0", file_ord=0, ps=0, gq=0)
    make = [dict(base, filter="low"), dict(base, qual=1.0), dict(base, gt=".|1"), dict(base, gt="0|0"), dict(base, gt="0/1"), dict(base, gt="1/1"), dict(base, alts=["*"]), dict(base, alts=["A"]), dict(base, ref="A", alts=["A" + "C" * 40]), dict(base, gt="1|2", alts=["G", "T"])]
    rows = [dict(r, pos=10 * i, file_ord=i) for i, r in enumerate(make)]
    schema = "callset string, contig string, pos long, ref string, alts array<string>, qual float, filter string, gt string, gq int, ps long, file_ord long"
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    e = Evaluator(spark, EvalConfig(filters=("PASS",), min_qual=5, max_size=30, sv_threshold=20))
    kept, dropped = e.variants(df, None)
    n = {r["drop_reason"]: r["n"] for r in dropped.collect()}
    assert n["filter"] == n["low_qual"] == 2 and n["unknown_allele"] == n["spanning_deletion"] == n["reference_call"] == n["too_large"] == 1 and sum(n.values()) == 20
    assert {(r["pos"], r["hap"]) for r in kept.collect()} == {(20, 1), (50, 0), (50, 1), (90, 0), (90, 1)}


def test_overlaps(spark):
    rows = [(0, 0, 10), (1, 5, 10), (2, 12, 3), (3, 20, 0), (4, 20, 0), (5, 20, 4)]
    v = spark.createDataFrame([("QUERY", "c", 0, i, p, n) for i, p, n in rows], "callset string, contig string, hap int, var_idx long, pos long, rlen long")
    assert sorted(r["var_idx"] for r in filters.prune_overlaps(v).collect()) == [0, 2, 3, 5]


def test_complex_change_is_split(spark):
    v = spark.createDataFrame([(10, "CAA", "CGTG", "x"), (10, "ACG", "TCA", "y"), (7, "TA", "TAC", "z")], "pos long, ref string, alt string, k string")
    got = sorted((r["k"], r["pos"], r["type"], r["ref"], r["alt"]) for r in filters.simple_variants(v).collect())
    assert got == [("x", 11, "DEL", "AA", ""), ("x", 11, "INS", "", "GTG"), ("y", 10, "DEL", "ACG", ""), ("y", 10, "INS", "", "TCA"), ("z", 9, "INS", "", "C")]


def test_options():
    c, q, t, r = from_args("q.vcf t.vcf r.fa -c gap 70 -f PASS,x -mx 40".split())
    assert (c.cluster_method, c.cluster_gap, c.filters, c.max_qual, q) == ("gap", 70, ("PASS", "x"), 40, "q.vcf")
    for bad in (dict(sv_threshold=1), dict(min_qual=-1), dict(max_qual=1, min_qual=2), dict(credit_threshold=0), dict(max_supercluster_size=10), dict(cluster_method="x")):
        with pytest.raises(ValueError):
            EvalConfig(**bad)


def test_oversize_superclusters_are_cut(spark):
    from haplospark.operators.alignment import split_oversize

    v = spark.createDataFrame([("QUERY", "c", 0, i, p, 1, 0) for i, p in enumerate([0, 10, 300, 310, 900])], "callset string, contig string, hap int, var_idx long, pos long, rlen long, sc_idx long")
    got = {r["pos"]: r["sc_idx"] for r in split_oversize(v, 100).collect()}
    assert got == {0: 0, 10: 0, 300: 1, 310: 1, 900: 2}


def test_left_shift(spark):
    from haplospark.operators.alignment import left_shift

    ref = spark.createDataFrame([("c", "ACGTTTTTGCA", 11)], "contig string, seq string, length int")
    v = spark.createDataFrame([("QUERY", "c", 0, 0, 7, 1, "DEL", "T", "")], "callset string, contig string, hap int, var_idx long, pos long, rlen int, type string, ref string, alt string")
    r = left_shift(v, ref).first()
    assert (r["pos"], r["ref"]) == (3, "T")


def test_session_stream(spark, tmp_path):
    from haplospark.streaming.sessions import session_stream

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(1).write.parquet(str(tmp_path / "in"))
    out = session_stream(spark, str(tmp_path / "in"), src.schema, "6 hours")
    q = out.writeStream.format("memory").queryName("sess").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("sess").count() > 0
