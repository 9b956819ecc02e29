"""Registered queries of the relational operators, each beside its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haplospark.functions import scalar
from haplospark.operators import clustering, filters, intervals, merges, metrics, phasing
from haplospark.plans import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- scans, filters, projections


@query(
    f"""WITH {V.EV}, g AS (SELECT *, CASE WHEN k % 9 = 0 THEN 'q10;bad' WHEN k % 9 < 4 THEN 'PASS' END AS flt,
      CASE k % 6 WHEN 0 THEN '0|1' WHEN 1 THEN '1|0' WHEN 2 THEN '1|1' WHEN 3 THEN '0/1' WHEN 4 THEN '.|1' ELSE '1/1' END AS gt FROM ev),
    h AS (SELECT *, unnest([0, 1]) AS hp FROM g), a AS (SELECT *, CASE WHEN split_part(replace(gt, '/', '|'), '|', hp + 1) = '.' THEN NULL ELSE CAST(split_part(replace(gt, '/', '|'), '|', hp + 1) AS INT) END AS al FROM h)
    SELECT coalesce(CASE WHEN flt IS NOT NULL AND flt <> 'PASS' THEN 'filter' WHEN qual < 10 THEN 'low_qual' WHEN al IS NULL THEN 'unknown_allele' WHEN al = 0 THEN 'reference_allele'
      WHEN gt = '0/1' THEN 'unphased' WHEN k % 17 = 0 THEN 'spanning_deletion' WHEN size > 90 THEN 'too_large' END, 'kept') AS drop_reason, count(*) AS n FROM a GROUP BY 1"""
)
def scan_filter_reasons(spark, sf):
    """Calls by the first reason for which they are dropped."""
    k = F.col("k")
    gt = F.when(k % 6 == 0, "0|1").when(k % 6 == 1, "1|0").when(k % 6 == 2, "1|1").when(k % 6 == 3, "0/1").when(k % 6 == 4, ".|1").otherwise("1/1")
    g = V.calls(spark, sf).drop("hap").withColumns({"filter": F.when(k % 9 == 0, "q10;bad").when(k % 9 < 4, "PASS"), "gt": gt, "alt": F.when(k % 17 == 0, "*").otherwise("A")})
    tests = filters.record_tests(("PASS",), 10) | filters.allele_tests() | {"too_large": F.col("size") > 90}
    reason = F.coalesce(filters.drop_reason(tests), F.lit("kept"))
    return filters.haplotypes(g).groupBy(reason.alias("drop_reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {V.EV}, g AS (SELECT event_id, pos, k, unnest([0, 1]) AS hap FROM ev), x AS (SELECT * FROM g WHERE CASE k % 3 WHEN 0 THEN hap = 0 WHEN 1 THEN hap = 1 ELSE true END),
    t AS (SELECT event_id, CAST(hap AS INT) AS hap, pos, k, unnest(CASE WHEN k % 5 = 0 THEN ['INS', 'DEL'] ELSE ['SNP'] END) AS type FROM x)
    SELECT event_id, hap, pos + 1 AS pos, type, CAST(CASE type WHEN 'INS' THEN 0 WHEN 'SNP' THEN 1 ELSE 2 END AS INT) AS rlen FROM t WHERE k % 5 = 0
    UNION ALL SELECT event_id, hap, pos, type, 1 FROM t WHERE k % 5 <> 0"""
)
def haplotype_explode(spark, sf):
    """Haplotype rows with complex changes split into an insertion and a deletion."""
    k = F.col("k")
    gt = F.when(k % 3 == 0, "1|0").when(k % 3 == 1, "0|1").otherwise("1|1")
    rec = V.calls(spark, sf).select("event_id", "pos", "k", gt.alias("gt"), F.when(k % 5 == 0, "CAA").otherwise("A").alias("ref"), F.when(k % 5 == 0, "CGTG").otherwise("G").alias("alt"))
    hap = filters.haplotypes(rec).where("allele > 0")
    return filters.simple_variants(hap).select("event_id", "hap", "pos", "type", "rlen")


@query(
    f"""WITH {V.PARTS}, a AS (SELECT *, CAST(len([i for i in range(1, least(length(ref), length(alt)) + 1) if ref[1:i] = alt[1:i]]) AS INT) AS p FROM pp),
    b AS (SELECT *, ref[p + 1:] AS r1, alt[p + 1:] AS a1 FROM a),
    c AS (SELECT *, CAST(len([i for i in range(1, least(length(r1), length(a1)) + 1) if reverse(r1)[1:i] = reverse(a1)[1:i]]) AS INT) AS s FROM b),
    d AS (SELECT *, r1[1:length(r1) - s] AS r2, a1[1:length(a1) - s] AS a2 FROM c)
    SELECT p_partkey, CASE WHEN length(ref) = length(alt) THEN 0 ELSE p END AS skip,
      CASE WHEN length(ref) <> length(alt) THEN CASE WHEN r2 = '' THEN 'INS' WHEN a2 = '' THEN 'DEL' ELSE 'CPX' END WHEN ref = alt THEN 'REF' WHEN ref[2:] = alt[2:] THEN 'SNP' ELSE 'CPX' END AS type,
      CASE WHEN length(ref) <> length(alt) THEN r2 WHEN ref <> alt AND ref[2:] = alt[2:] THEN ref[1:1] ELSE ref END AS ref,
      CASE WHEN length(ref) <> length(alt) THEN a2 WHEN ref <> alt AND ref[2:] = alt[2:] THEN alt[1:1] ELSE alt END AS alt FROM d"""
)
def allele_trim(spark, sf):
    """Names of parts as alleles: shared ends trimmed, the change classified."""
    t = V.numbered_parts(spark, sf).withColumn("t", scalar.trimmed(F.col("ref"), F.col("alt")))
    return t.select("p_partkey", "t.skip", "t.type", "t.ref", "t.alt")


# --- regions


_V = "v AS (SELECT event_id AS vid, contig, pos AS start, pos + greatest(rlen, 1) AS stop, type, hap, k FROM ev)"


def _placed_calls(spark, sf):
    return V.calls(spark, sf).select(F.col("event_id").alias("vid"), "contig", F.col("pos").alias("start"), (F.col("pos") + F.greatest("rlen", F.lit(1))).alias("stop"), "type", "hap", "k")


def _merged(spark, sf):
    return intervals.merge_mask(V.regions(spark, sf))


_MERGED = f"""{V.RG}, ri AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY contig ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS s FROM rg),
  rj AS (SELECT *, sum(s) OVER (PARTITION BY contig ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS i FROM ri), rm AS (SELECT contig, min(start) AS start, max(stop) AS stop FROM rj GROUP BY contig, i)"""
_LOC = f"""WITH {V.EV}, {_V}, {_MERGED}, lo AS (SELECT v.vid, v.contig, v.start, v.stop, v.type, v.hap,
    CASE WHEN v.contig NOT IN (SELECT contig FROM rm) THEN 'OFF CTG'
      WHEN EXISTS (SELECT 1 FROM rm WHERE rm.contig = v.contig AND rm.start <= v.start AND v.stop <= rm.stop AND NOT (v.type = 'INS' AND v.start = rm.stop - 1)) THEN 'INSIDE'
      WHEN EXISTS (SELECT 1 FROM rm WHERE rm.contig = v.contig AND rm.start < v.stop AND v.start < rm.stop) THEN 'BORDER' ELSE 'OUTSIDE' END AS loc FROM v)"""


@query(f"{_LOC} SELECT vid, contig, start, stop FROM lo WHERE loc = 'INSIDE'")
def region_containment(spark, sf):
    """Calls inside a region of the mask."""
    return intervals.located(_placed_calls(spark, sf), _merged(spark, sf)).where("loc = 'INSIDE'").select("vid", "contig", "start", "stop")


@query(f"{_LOC} SELECT contig, type, loc, count(*) AS n FROM lo GROUP BY ALL")
def region_location_class(spark, sf):
    """Calls by contig, type and place in the mask."""
    return intervals.located(_placed_calls(spark, sf), _merged(spark, sf)).groupBy("contig", "type", "loc").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {V.EV}, {_MERGED} SELECT event_id AS vid, ev.contig, ev.pos, rm.start AS r_start, rm.stop AS r_stop FROM ev ASOF LEFT JOIN rm ON ev.contig = rm.contig AND ev.pos >= rm.start")
def region_asof(spark, sf):
    """The last region that starts at or before each call."""
    return intervals.as_of_region(V.calls(spark, sf).select("contig", "pos", F.col("event_id").alias("vid")), _merged(spark, sf))


@query(
    f"""WITH {V.MASK}, l AS (SELECT *, lag(start) OVER w AS ps, lag(stop) OVER w AS pe FROM mask WINDOW w AS (PARTITION BY contig ORDER BY line))
    SELECT contig, start, stop, problem FROM (SELECT *, CASE WHEN stop < start THEN 'negative length' WHEN stop = start THEN 'zero length' WHEN start < ps THEN 'unsorted'
      WHEN start < pe THEN 'overlap' WHEN start = pe THEN 'abutting' END AS problem FROM l) WHERE problem IS NOT NULL"""
)
def mask_validate(spark, sf):
    """Regions that break the rules of a mask."""
    return intervals.mask_problems(V.raw_mask(spark, sf))


def _merge_sql(cte: str, out: str) -> str:
    return f"""{out}i AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY contig ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS s FROM {cte}),
      {out}j AS (SELECT *, sum(s) OVER (PARTITION BY contig ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS i FROM {out}i), {out} AS (SELECT contig, min(start) AS start, max(stop) AS stop FROM {out}j GROUP BY contig, i)"""


@query(f"WITH {V.MASK}, {_merge_sql('mask', 'mm')} SELECT contig, start, stop FROM mm")
def mask_merge(spark, sf):
    """Union of overlapping regions."""
    return intervals.merge_mask(V.raw_mask(spark, sf))


_HALVES = "ma AS (SELECT * FROM mask WHERE line % 2 = 0), mb AS (SELECT * FROM mask WHERE line % 2 = 1 AND contig <> 'c2')"


@query(
    f"""WITH {V.MASK}, {_HALVES}, {_merge_sql('ma', 'am')}, {_merge_sql('mb', 'bm')},
    pt AS (SELECT contig, start AS p FROM am UNION SELECT contig, stop FROM am UNION SELECT contig, start FROM bm UNION SELECT contig, stop FROM bm),
    seg AS (SELECT contig, p AS start, lead(p) OVER (PARTITION BY contig ORDER BY p) AS stop FROM pt),
    keep AS (SELECT * FROM seg s WHERE stop IS NOT NULL AND EXISTS (SELECT 1 FROM am WHERE am.contig = s.contig AND am.start <= s.start AND s.stop <= am.stop)
      AND NOT EXISTS (SELECT 1 FROM bm WHERE bm.contig = s.contig AND bm.start <= s.start AND s.stop <= bm.stop))
    SELECT contig, start, stop FROM keep"""
)
def mask_subtract(spark, sf):
    """One mask less another."""
    m = V.raw_mask(spark, sf)
    a = intervals.merge_mask(m.where("line % 2 = 0"))
    b = intervals.merge_mask(m.where("line % 2 = 1 and contig <> 'c2'"))
    return intervals.subtract_mask(a, b, 1 << 40)


@query(f"WITH {V.EV}, {_V}, {_MERGED}, s AS (SELECT contig, start, stop, 'S' || (start % 3) AS stratum FROM rm) SELECT s.stratum, v.type, count(DISTINCT v.vid) AS n FROM v JOIN s ON s.contig = v.contig AND v.start >= s.start AND v.start < s.stop GROUP BY ALL")
def stratified_counts(spark, sf):
    """Calls by stratum of named regions and type."""
    s = _merged(spark, sf).withColumn("stratum", F.concat(F.lit("S"), F.col("start") % 3))
    return merges.stratify(_placed_calls(spark, sf).withColumn("pos", F.col("start")), s).groupBy("stratum", "type").agg(F.count(F.lit(1)).alias("n"))


# --- clusters


def _clusters(spark, sf, method):
    return clustering.cluster_table(V.clustered(spark, sf, method)).select("callset", "contig", "hap", "cluster_id", F.col("left").alias("l"), F.col("right").alias("r"), "first_pos", "n_vars")


@query(f"WITH {V.clustered_sql('gap')} SELECT callset, contig, hap, cluster_id, l, r, first_pos, n_vars FROM ct")
def gap_clusters(spark, sf):
    """Clusters of a fixed gap."""
    return _clusters(spark, sf, "gap")


@query(f"WITH {V.clustered_sql('size')} SELECT callset, contig, hap, cluster_id, l, r, first_pos, n_vars FROM ct")
def size_clusters(spark, sf):
    """Clusters whose gap grows with the size of variants."""
    return _clusters(spark, sf, "size")


@query(f"WITH {V.SUPER} SELECT contig, sc_idx, beg, fin, n_clusters, n_vars FROM st")
def superclusters(spark, sf):
    """Clusters of all haplotypes merged where they touch."""
    return clustering.supercluster_table(V.super_(spark, sf)).withColumnRenamed("end", "fin")


@query(
    f"""WITH {V.SUPER}, w AS (SELECT *, min(pos) OVER p - 1 AS beg, max(pos + rlen) OVER p + 1 AS fin, lead(pos) OVER o AS nx, row_number() OVER o AS nth FROM pv
      WINDOW p AS (PARTITION BY contig, sc_idx), o AS (PARTITION BY contig, sc_idx ORDER BY pos, callset, hap, var_idx)),
    g AS (SELECT *, greatest(0, nx - pos - rlen) AS gap, pos + rlen + greatest(0, nx - pos - rlen) // 2 AS cut FROM w WHERE nx IS NOT NULL),
    s AS (SELECT *, CASE WHEN gap > 0 THEN -gap * log2(greatest((cut - beg) / (fin - beg), (fin - cut) / (fin - beg))) ELSE 0 END AS score FROM g)
    SELECT contig, sc_idx, cut, gap, nx AS next_pos, round(score, 4) AS score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY contig, sc_idx ORDER BY round(score, 9) DESC, nth) = 1"""
)
def supercluster_best_cut(spark, sf):
    """Where to cut each supercluster."""
    return clustering.best_cut(V.placed(spark, sf)).withColumn("score", F.round("score", 4))


@query(
    f"""WITH {V.SUPER} SELECT contig, sc_idx, count(*) FILTER (callset = 'QUERY' AND hap = 0) AS query1_vars, count(*) FILTER (callset = 'QUERY' AND hap = 1) AS query2_vars,
      count(*) FILTER (callset = 'TRUTH' AND hap = 0) AS truth1_vars, count(*) FILTER (callset = 'TRUTH' AND hap = 1) AS truth2_vars FROM pv GROUP BY ALL"""
)
def supercluster_hap_counts(spark, sf):
    """Variants of each haplotype in superclusters."""
    return clustering.hap_counts(V.placed(spark, sf))


@query(f"WITH {V.SUPER} SELECT contig, count(*) AS n, CAST(max(fin - beg) AS BIGINT) AS largest, round(avg(fin - beg), 4) AS mean_bases, round(avg(n_vars), 4) AS mean_vars FROM st GROUP BY 1")
def supercluster_totals(spark, sf):
    """Number and size of superclusters."""
    s = clustering.supercluster_table(V.super_(spark, sf)).withColumn("size", F.col("end") - F.col("beg"))
    return s.groupBy("contig").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("largest"), F.round(F.avg("size"), 4).alias("mean_bases"), F.round(F.avg("n_vars"), 4).alias("mean_vars"))


@query(
    f"""WITH {V.SUPER}, b AS (SELECT *, CASE WHEN phase_set > coalesce(max(phase_set) OVER (PARTITION BY contig, callset ORDER BY sc_idx, callset, hap, pos, var_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN phase_set END AS bg FROM pv),
    p AS (SELECT contig, sc_idx, last(bg ORDER BY callset, hap, pos, var_idx) FILTER (bg IS NOT NULL) AS lb FROM b GROUP BY ALL),
    f AS (SELECT contig, arg_min(phase_set, pos) FILTER (phase_set > 0) AS f0 FROM pv GROUP BY 1)
    SELECT contig, sc_idx, coalesce(last_value(lb IGNORE NULLS) OVER (PARTITION BY contig ORDER BY sc_idx ROWS UNBOUNDED PRECEDING), f0, 0) AS phase_set FROM p JOIN f USING (contig)"""
)
def phaseset_fill(spark, sf):
    """Phase sets carried over superclusters."""
    return clustering.fill_phase_sets(V.placed(spark, sf))


@query(
    f"""WITH RECURSIVE {V.EV}, w AS (SELECT callset, contig, hap, pos, var_idx, rlen * 60 AS rlen, row_number() OVER (PARTITION BY callset, contig, hap ORDER BY pos, var_idx) AS i FROM ev),
    r AS (SELECT DISTINCT callset, contig, hap, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS fin, CAST(-1 AS BIGINT) AS ins, CAST(-1 AS BIGINT) AS var_idx, false AS keep FROM w
      UNION ALL SELECT w.callset, w.contig, w.hap, w.i, CASE WHEN r.fin <= w.pos AND NOT (w.rlen = 0 AND r.ins = w.pos) THEN w.pos + w.rlen ELSE r.fin END,
        CASE WHEN r.fin <= w.pos AND NOT (w.rlen = 0 AND r.ins = w.pos) THEN CASE WHEN w.rlen = 0 THEN w.pos ELSE -1 END ELSE r.ins END, w.var_idx, r.fin <= w.pos AND NOT (w.rlen = 0 AND r.ins = w.pos)
      FROM r JOIN w ON w.callset = r.callset AND w.contig = r.contig AND w.hap = r.hap AND w.i = r.i + 1)
    SELECT callset, contig, hap, var_idx FROM r WHERE keep"""
)
def overlap_prune(spark, sf):
    """Calls that overlap no kept call before them (reference lengths stretched sixtyfold)."""
    v = V.calls(spark, sf).select("callset", "contig", "hap", "pos", "var_idx", (F.col("rlen") * 60).alias("rlen"))
    return filters.prune_overlaps(v).select("callset", "contig", "hap", "var_idx")


# --- phase


@query(f"WITH {V.PHASE} SELECT contig, pb_idx, min(phase_set) AS phase_set, count(*) AS n_superclusters, min(beg) AS start, max(fin) AS stop FROM db GROUP BY contig, pb_idx")
def phase_blocks(spark, sf):
    """Runs of superclusters of one phase set."""
    return V.decided(spark, sf).groupBy("contig", "pb_idx").agg(F.min("phase_set").alias("phase_set"), F.count(F.lit(1)).alias("n_superclusters"), F.min("beg").alias("start"), F.max("end").alias("stop"))


@query(f"WITH {V.PATH} SELECT contig, sc_idx, sc_phase, CAST(pb_phase AS INT) AS pb_phase, is_switch, is_flip FROM pt")
def phase_viterbi(spark, sf):
    """Cheapest block states, switches and flips."""
    return V.path(spark, sf).select("contig", "sc_idx", "sc_phase", "pb_phase", "is_switch", "is_flip")


@query(
    f"""WITH {V.PATH}, e AS (SELECT *, coalesce(last_value(CASE WHEN sc_phase <> 2 THEN fin END IGNORE NULLS) OVER b, first_value(fin) OVER b) AS l,
        coalesce(first_value(CASE WHEN sc_phase <> 2 THEN beg END IGNORE NULLS) OVER a, last_value(beg) OVER a) AS r FROM pt
      WINDOW b AS (PARTITION BY contig ORDER BY sc_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY contig ORDER BY sc_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
    SELECT contig, l AS start, beg AS stop, 'FLIP_BEG' AS switch_type, sc_idx AS supercluster, pb_idx AS phase_block FROM e WHERE is_flip AND l IS NOT NULL
    UNION ALL SELECT contig, fin, r, 'FLIP_END', sc_idx, pb_idx FROM e WHERE is_flip AND r IS NOT NULL
    UNION ALL SELECT contig, l, CASE WHEN sc_phase <> 2 THEN beg ELSE coalesce(r, beg) END, 'SWITCH_ERR', sc_idx, pb_idx FROM e WHERE is_switch AND l IS NOT NULL"""
)
def phase_error_intervals(spark, sf):
    """Where switches and flips may lie."""
    return phasing.error_intervals(V.path(spark, sf))


@query(f"WITH {V.PHASE}, z AS (SELECT contig, max(fin) - min(beg) AS size FROM db GROUP BY contig, pb_idx), t AS (SELECT contig, sum(size) AS total FROM z GROUP BY 1), r AS (SELECT z.contig, size, total, sum(size) OVER (PARTITION BY z.contig ORDER BY size DESC ROWS UNBOUNDED PRECEDING) AS run FROM z JOIN t USING (contig)) SELECT contig, CAST(coalesce(max(size) FILTER (run >= total // 2), 0) AS BIGINT) AS ng50 FROM r GROUP BY 1")
def ng50(spark, sf):
    """Block size at which half of each contig's blocks is reached."""
    z = V.decided(spark, sf).groupBy("contig", "pb_idx").agg((F.max("end") - F.min("beg")).alias("size"))
    w = Window.partitionBy("contig").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = z.withColumns({"run": F.sum("size").over(w), "total": F.sum("size").over(Window.partitionBy("contig"))})
    return run.groupBy("contig").agg(F.coalesce(F.max(F.when(F.col("run") >= F.floor(F.col("total") / 2), F.col("size"))), F.lit(0)).cast("long").alias("ng50"))


@query(
    f"""WITH {V.PATH}, n AS (SELECT *, CASE WHEN lag(pb_idx) OVER o IS NULL OR lag(pb_idx) OVER o <> pb_idx OR is_switch OR is_flip OR coalesce(lag(is_flip) OVER o, false) THEN 1 ELSE 0 END AS s FROM pt WINDOW o AS (PARTITION BY contig ORDER BY sc_idx)),
    g AS (SELECT *, sum(s) OVER (PARTITION BY contig ORDER BY sc_idx ROWS UNBOUNDED PRECEDING) AS seg FROM n), z AS (SELECT contig, max(fin) - min(beg) AS size FROM g GROUP BY contig, seg),
    r AS (SELECT size, sum(size) OVER (ORDER BY size DESC ROWS UNBOUNDED PRECEDING) AS run FROM z) SELECT CAST(coalesce(max(size) FILTER (run >= 100000 // 2), 0) AS BIGINT) AS ng50 FROM r"""
)
def ngc50_breaks(spark, sf):
    """NG50 of segments between all breaks, over a genome of 100,000 bases."""
    return metrics.ng50(phasing.correct_segments(V.path(spark, sf), True, True), 100_000)


# --- metrics


@query(f"WITH {V.COUNTS} SELECT vartype, min_qual, truth_total, truth_tp, truth_fn, query_total, query_tp, query_fp FROM pq")
def pr_counts_sweep(spark, sf):
    """Counts by class at every quality threshold."""
    return metrics.pr_counts(V.evaluations(spark, sf), 0, 60)


_PR = ("prec", "recall", "f1_score", "f1_qscore")


@query(f"WITH {V.COUNTS} SELECT vartype, min_qual, round(prec, 6) AS prec, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, round(f1_qscore, 4) AS f1_qscore FROM px")
def pr_metrics(spark, sf):
    """Precision, recall and F1 at every threshold."""
    m = metrics.pr_metrics(metrics.pr_counts(V.evaluations(spark, sf), 0, 60))
    return m.select("vartype", "min_qual", *[F.round(c, 4 if c == "f1_qscore" else 6).alias(c) for c in _PR])


@query(f"WITH {V.COUNTS} SELECT vartype, min_qual, truth_tp, query_tp, truth_fn, query_fp, round(f1_score, 6) AS f1_score FROM px QUALIFY row_number() OVER (PARTITION BY vartype ORDER BY f1_score DESC, min_qual) = 1")
def pr_best_threshold(spark, sf):
    """Of each class the threshold of greatest F1."""
    m = metrics.best_threshold(metrics.pr_metrics(metrics.pr_counts(V.evaluations(spark, sf), 0, 60)))
    return m.select("vartype", "min_qual", "truth_tp", "query_tp", "truth_fn", "query_fp", F.round("f1_score", 6).alias("f1_score"))


@query(f"WITH {V.COUNTS} SELECT vartype, min_qual, round(CASE WHEN truth_total = 0 THEN 0.0 ELSE CAST(truth_fn AS DOUBLE) / truth_total END, 6) AS fnr, round(CAST(query_fp AS DOUBLE) / greatest(1, query_tp), 6) AS fpr FROM pq")
def error_rates(spark, sf):
    """False negatives per truth call and false positives per match."""
    m = metrics.strict_rates(metrics.pr_counts(V.evaluations(spark, sf), 0, 60))
    return m.select("vartype", "min_qual", F.round("fnr", 6).alias("fnr"), F.round("fpr", 6).alias("fpr"))


@query(f"WITH {V.PARTS} SELECT p_partkey, CAST(levenshtein(ref, alt) AS INT) AS distance FROM pp")
def edit_distance_pairs(spark, sf):
    """Edit distance of neighbouring part names."""
    return V.numbered_parts(spark, sf).select("p_partkey", F.levenshtein("ref", "alt").alias("distance"))


@query(f"WITH {V.PARTS} SELECT p_partkey, CAST(levenshtein(ref, alt) AS INT) AS distance FROM pp WHERE levenshtein(ref, alt) <= 5")
def edit_distance_bounded(spark, sf):
    """Neighbouring part names at most five edits apart; the kernel gives up beyond."""
    return V.numbered_parts(spark, sf).select("p_partkey", F.levenshtein("ref", "alt", 5).alias("distance")).where("distance >= 0")


@query(f"WITH {V.EDITS} SELECT * REPLACE (round(aln_qscore, 4) AS aln_qscore) FROM (SELECT *, {V.against('aln_score', 'max(aln_score) FILTER (min_qual = 61) OVER ()')} AS aln_qscore FROM ds)")
def distance_sweep(spark, sf):
    """Edit distances at every quality, and the score's Q score against the highest."""
    return metrics.distance_sweep(V.edits(spark, sf), 0, 60).withColumn("aln_qscore", F.round("aln_qscore", 4))


@query(
    f"""WITH {V.EDITS}, c AS (SELECT 'ALL' AS var_type, min_qual, edit_dist, distinct_edits, aln_score FROM ds
      UNION ALL SELECT 'SNP', min_qual, sub_ed, sub_de, NULL FROM ds UNION ALL SELECT 'INS', min_qual, ins_ed, ins_de, NULL FROM ds UNION ALL SELECT 'DEL', min_qual, del_ed, del_de, NULL FROM ds
      UNION ALL SELECT 'INDEL', min_qual, ins_ed + del_ed, ins_de + del_de, NULL FROM ds),
    r AS (SELECT *, row_number() OVER (PARTITION BY var_type ORDER BY edit_dist * distinct_edits, min_qual) AS r, max(edit_dist) FILTER (min_qual = 61) OVER w AS re,
      max(distinct_edits) FILTER (min_qual = 61) OVER w AS rd, max(aln_score) FILTER (min_qual = 61) OVER w AS rs FROM c WINDOW w AS (PARTITION BY var_type)),
    x AS (SELECT *, unnest([x for x in [CASE WHEN min_qual = 0 THEN 'NONE' END, CASE WHEN r = 1 THEN 'BEST' END, CASE WHEN min_qual = 61 THEN 'REF' END] if x IS NOT NULL]) AS threshold FROM r)
    SELECT var_type, threshold, min_qual, edit_dist, distinct_edits, round({V.against('edit_dist', 're')}, 4) AS ed_qscore, round({V.against('distinct_edits', 'rd')}, 4) AS de_qscore,
      CASE WHEN var_type = 'ALL' THEN round({V.against('aln_score', 'rs')}, 4) ELSE 0.0 END AS aln_qscore FROM x"""
)
def distance_best(spark, sf):
    """Distances of each class of edits without a threshold, at the best one, and of the reference."""
    best = metrics.best_distances(metrics.distance_sweep(V.edits(spark, sf), 0, 60), 60)
    return best.withColumns({c: F.round(c, 4) for c in ("ed_qscore", "de_qscore", "aln_qscore")})


@query(
    f"""WITH {V.EV}, ed AS (SELECT contig, size, qual AS lo, CAST(least(61, qual + k % 30) AS INT) AS hi FROM ev), two AS (SELECT contig, size, lo, hi FROM ed WHERE lo < hi UNION ALL SELECT 'ALL', size, lo, hi FROM ed WHERE lo < hi),
    qs AS (SELECT CAST(range AS INT) AS q FROM range(0, 62)), av AS (SELECT c.contig, q, coalesce(sum(size), 0) AS d FROM (SELECT DISTINCT contig FROM two) c CROSS JOIN qs LEFT JOIN two ON two.contig = c.contig AND lo <= q AND q < hi GROUP BY ALL)
    SELECT contig, CAST(min(d) AS BIGINT) AS least_distance FROM av GROUP BY 1"""
)
def least_distances(spark, sf):
    """Least edit distance of each contig over all quality thresholds."""
    return metrics.least_distances(V.edits(spark, sf), 60)


@query(
    f"""WITH {V.EV}, z AS (SELECT type, size, pow(10, floor(log10(size) + 1e-9)) AS p FROM ev)
    SELECT type, CAST(CASE WHEN size >= 5 * p THEN 5 * p WHEN size >= 2 * p THEN 2 * p ELSE p END AS BIGINT) AS bin, count(*) AS n, CAST(sum(size) AS BIGINT) AS sum_size, CAST(sum(size * size) AS BIGINT) AS sum_sq, max(size) AS max_size FROM z GROUP BY 1, 2"""
)
def size_histogram(spark, sf):
    """Sizes of calls in 1-2-5 bins."""
    return metrics.size_histogram(V.calls(spark, sf), ("type",))


@query(
    f"""WITH {V.EV}, m AS (SELECT contig, user_id % 4 AS rep, avg(qual) AS m FROM ev GROUP BY ALL), r AS (SELECT contig, rep, rank() OVER (PARTITION BY rep ORDER BY round(m, 9)) AS rk FROM m)
    SELECT contig, CAST(max(rk) - min(rk) AS INT) AS rank_change FROM r GROUP BY 1"""
)
def rank_change(spark, sf):
    """How far the rank of a submission moves between representations."""
    m = V.calls(spark, sf).groupBy("contig", (F.col("user_id") % 4).alias("rep")).agg(F.round(F.avg("qual"), 9).alias("m"))
    r = m.withColumn("rk", F.rank().over(Window.partitionBy("rep").orderBy("m")))
    return r.groupBy("contig").agg((F.max("rk") - F.min("rk")).alias("rank_change"))


@query(f"WITH {V.EV} SELECT contig, round(regr_r2(qual, size), 8) AS r2, round(regr_slope(qual, size), 8) AS slope FROM ev GROUP BY 1")
def regression_r2(spark, sf):
    """Linear regression of quality on size."""
    return V.calls(spark, sf).groupBy("contig").agg(F.round(F.regr_r2("qual", "size"), 8).alias("r2"), F.round(F.regr_slope("qual", "size"), 8).alias("slope"))


@query(
    f"""WITH {V.EVAL}, g AS (SELECT vartype, count(*) AS n FROM ez WHERE errtype = 'TP' GROUP BY callset, contig, hap, sync_group, vartype),
    p AS (SELECT vartype, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS single, CAST(sum(n) AS BIGINT) AS total FROM g GROUP BY 1)
    SELECT vartype, single, total - single AS multi, round(single / total, 8) AS single_share FROM p"""
)
def multi_match_share(spark, sf):
    """Share of matches made alone and with others."""
    return merges.multi_match(V.evaluations(spark, sf)).withColumn("single_share", F.round("single_share", 8))


@query(
    f"""WITH {V.EV}, o AS (SELECT contig, hap, callset, pos, rlen, max(pos + rlen) OVER (PARTITION BY callset, contig, hap ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM ev)
    SELECT callset, CAST(greatest(0, pos - e) // 100 * 100 AS BIGINT) AS bin, count(*) AS n FROM o WHERE e IS NOT NULL GROUP BY ALL"""
)
def gap_histogram(spark, sf):
    """Gaps between neighbouring calls of a haplotype."""
    w = Window.partitionBy("callset", "contig", "hap").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    g = V.calls(spark, sf).withColumn("e", F.max(F.col("pos") + F.col("rlen")).over(w)).where("e is not null")
    return g.groupBy("callset", (F.floor(F.greatest(F.lit(0), F.col("pos") - F.col("e")) / 100) * 100).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# --- merges and set operations


def _alleles(spark, sf):
    v = V.calls(spark, sf)
    return v.select("callset", "contig", "hap", (F.floor(F.col("pos") / 26) % 400).cast("long").alias("pos"), F.substring("type", 1, 1).alias("ref"), (F.col("k") % 3).cast("string").alias("alt"), "qual", "var_idx", (F.col("contig") == "view").alias("swap"))


_AL = "al AS (SELECT callset, contig, hap, CAST(pos // 26 % 400 AS BIGINT) AS pos, type[1:1] AS ref, CAST(k % 3 AS VARCHAR) AS alt, qual, var_idx, contig = 'view' AS swap FROM ev)"


@query(
    f"""WITH {V.EV}, {_AL}, n AS (SELECT *, row_number() OVER (PARTITION BY contig, pos, ref, alt, hap ORDER BY var_idx) AS nth FROM al WHERE callset = 'QUERY')
    SELECT coalesce(a.contig, b.contig) AS contig, coalesce(a.pos, b.pos) AS pos, coalesce(a.ref, b.ref) AS ref, coalesce(a.alt, b.alt) AS alt,
      CASE WHEN a.qual IS NOT NULL AND b.qual IS NOT NULL THEN '1|1' WHEN a.qual IS NOT NULL THEN '1|0' ELSE '0|1' END AS gt, coalesce(a.qual, b.qual) AS qual
    FROM (SELECT * FROM n WHERE hap = 0) a FULL JOIN (SELECT * FROM n WHERE hap = 1) b USING (contig, pos, ref, alt, nth)"""
)
def hap_merge_outer(spark, sf):
    """Haplotypes of a callset folded into genotypes."""
    return merges.fold_haplotypes(_alleles(spark, sf).where("callset = 'QUERY'"))


@query(
    f"""WITH {V.EV}, {_AL}, o AS (SELECT *, CASE WHEN callset = 'QUERY' AND swap THEN 1 - hap ELSE hap END AS oh FROM al),
    n AS (SELECT *, row_number() OVER (PARTITION BY callset, contig, pos, ref, alt, oh ORDER BY qual) AS nth FROM o)
    SELECT coalesce(t.contig, q.contig) AS contig, coalesce(t.pos, q.pos) AS pos, coalesce(t.ref, q.ref) AS ref, coalesce(t.alt, q.alt) AS alt, CAST(coalesce(t.oh, q.oh) AS INT) AS out_hap, t.qual AS truth_qual, q.qual AS query_qual
    FROM (SELECT * FROM n WHERE callset = 'TRUTH') t FULL JOIN (SELECT * FROM n WHERE callset = 'QUERY') q USING (contig, pos, ref, alt, oh, nth)"""
)
def four_way_merge(spark, sf):
    """Truth and query calls of one allele side by side."""
    return merges.pair_callsets(_alleles(spark, sf))


@query(f"WITH {V.EV}, {V.RG} SELECT DISTINCT contig FROM ev WHERE contig IN (SELECT contig FROM rg)")
def contig_semi(spark, sf):
    """Contigs of calls that the mask knows."""
    return V.calls(spark, sf).select("contig").distinct().join(V.regions(spark, sf).select("contig").distinct(), "contig", "left_semi")


@query(f"WITH {V.EV}, {V.RG} SELECT contig, count(*) AS n FROM ev WHERE contig NOT IN (SELECT contig FROM rg) GROUP BY 1")
def contig_anti(spark, sf):
    """Calls on contigs that the mask lacks."""
    return V.calls(spark, sf).join(V.regions(spark, sf).select("contig").distinct(), "contig", "left_anti").groupBy("contig").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {V.EV}, {V.RG}, u AS (SELECT contig, min(event_id) AS ord FROM ev GROUP BY 1), x AS (SELECT contig FROM ev EXCEPT SELECT contig FROM rg) SELECT contig, ord, contig IN (SELECT contig FROM x) AS only_calls FROM u")
def contig_union_except(spark, sf):
    """All contigs by first sight, and whether only calls have them."""
    calls, mask = V.calls(spark, sf), V.regions(spark, sf).select("contig")
    only = calls.select("contig").subtract(mask)
    u = calls.groupBy("contig").agg(F.min("event_id").alias("ord"))
    return u.join(only.withColumn("only_calls", F.lit(True)), "contig", "left").na.fill(False, ["only_calls"])


@query(
    f"""WITH {V.EVAL}, a AS (SELECT event_id, errtype AS a FROM ez WHERE k % 5 <> 0), b AS (SELECT event_id, CASE WHEN k % 11 = 0 THEN 'FP' ELSE errtype END AS b FROM ez WHERE k % 6 <> 1), c AS (SELECT event_id, vartype AS c FROM ez WHERE k % 2 = 0)
    SELECT coalesce(a, 'MISSING') AS a, coalesce(b, 'MISSING') AS b, coalesce(c, 'MISSING') AS c, count(*) AS n FROM a FULL JOIN b USING (event_id) FULL JOIN c USING (event_id) GROUP BY ALL"""
)
def tool_confusion(spark, sf):
    """What three tools say of each call."""
    e = V.evaluations(spark, sf)
    tools = {
        "a": e.where("k % 5 <> 0").select("event_id", "errtype"),
        "b": e.where("k % 6 <> 1").select("event_id", F.when(F.col("k") % 11 == 0, "FP").otherwise(F.col("errtype")).alias("errtype")),
        "c": e.where("k % 2 = 0").select("event_id", F.col("vartype").alias("errtype")),
    }
    return merges.confusion(tools, ("event_id",))


@query(
    f"""WITH {V.EV}, x AS (SELECT contig, pos AS start, pos + 200 + k AS stop, event_id AS id FROM ev WHERE callset = 'QUERY'), y AS (SELECT contig, pos AS start, pos + 150 AS stop, event_id AS id FROM ev WHERE callset = 'TRUTH'),
    j AS (SELECT x.id AS a_id, x.contig, y.id AS b_id, y.start AS b_start, row_number() OVER (PARTITION BY x.id ORDER BY y.start, y.id) AS r FROM x LEFT JOIN y ON x.contig = y.contig AND x.start < y.stop AND y.start < x.stop)
    SELECT a_id, contig, b_id, b_start FROM j WHERE r = 1"""
)
def error_overlap_first(spark, sf):
    """First overlapping error of another tool."""
    v = V.calls(spark, sf)
    a = v.where("callset = 'QUERY'").select("contig", F.col("pos").alias("start"), (F.col("pos") + 200 + F.col("k")).alias("stop"), F.col("event_id").alias("id"))
    b = v.where("callset = 'TRUTH'").select("contig", F.col("pos").alias("start"), (F.col("pos") + 150).alias("stop"), F.col("event_id").alias("id"))
    return merges.first_overlap(a, b)


@query(
    f"""WITH {V.EV}, d AS (SELECT *, count(*) OVER (PARTITION BY contig, pos // 26 % 400) AS n FROM ev)
    SELECT contig, type, count(*) FILTER (n = 1) AS unique_calls, count(*) FILTER (n > 1) AS repeated FROM d GROUP BY ALL"""
)
def duplicate_positions(spark, sf):
    """Calls alone at their position and not."""
    n = F.count(F.lit(1)).over(Window.partitionBy("contig", F.floor(F.col("pos") / 26) % 400))
    return V.calls(spark, sf).withColumn("n", n).groupBy("contig", "type").agg(F.count_if(F.col("n") == 1).alias("unique_calls"), F.count_if(F.col("n") > 1).alias("repeated"))


@query(
    """WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events),
    g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM o)
    SELECT user_id, min(ts) AS session_start, count(*) AS n FROM g GROUP BY user_id, i"""
)
def session_batch(spark, sf):
    """Extension: sessions of events with a gap of six hours, the batch form of the streaming operator."""
    from haplospark.streaming.sessions import sessions

    return sessions(V.table(spark, sf, "events"), "6 hours")


# --- alignment kernels


def _genome(spark, sf):
    """A genome for the synthetic calls: hashes spelled in bases, long enough for every position; made block by block."""
    from haplospark.operators.alignment import BLOCK, with_blocks

    top = V.calls(spark, sf).groupBy("contig").agg((F.max("pos") + 2000).alias("n")).withColumn("last", F.floor(F.col("n") / 128))
    each = BLOCK // 128
    parts = top.select("contig", "last", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / each).cast("int"))).alias("block")).repartition("contig", "block")
    numbers = F.sequence(F.col("block").cast("long") * each, F.least("last", F.col("block").cast("long") * each + (each - 1)))
    bases = F.transform(numbers, lambda i: F.translate(F.sha2(F.concat_ws(":", "contig", i.cast("string")), 512), "0123456789abcdef", "ACGTACGTACGTACGT"))
    return with_blocks(top.select("contig", ((F.col("last") + 1) * 128).cast("int").alias("length")), parts.select("contig", "block", F.array_join(bases, "").alias("bases")))


def _clustered(spark, sf):
    """Synthetic calls with alleles, the overlapping ones left out, in clusters.

    The calls lie so close (one in 65 bases of a contig) that the configuration's gap of 50 would join whole contigs; so the gap is 10.
    """
    v = V.calls(spark, sf)
    word = F.translate(F.sha2(F.col("event_id").cast("string"), 512), "0123456789abcdef", "ACGTACGTACGTACGT")
    v = v.withColumn("w", word).select(
        "callset", "contig", "hap", "pos", "var_idx", F.when(F.col("type") == "SUB", "SNP").otherwise(F.col("type")).alias("type"), "rlen", "size", F.col("qual").cast("float").alias("qual"), "phase_set", F.when(F.col("type") == "DEL", "").otherwise(F.expr("substring(w, 1, int(size))")).alias("alt")
    )
    return clustering.reach_clusters(clustering.with_reach(filters.prune_overlaps(v), "gap", 10))


def _sequenced(spark, sf):
    """The clustered calls in superclusters: cut at 1,000 bases, as groups of the configuration's 10,000 take minutes each."""
    from haplospark.operators.alignment import split_oversize

    c = _clustered(spark, sf)
    sc = clustering.superclusters(clustering.cluster_table(c)).select("callset", "contig", "hap", "cluster_id", "sc_idx")
    return split_oversize(c.join(sc, ["callset", "contig", "hap", "cluster_id"]), 1000)


# Rows of the cost matrices by one recursion over a's letters, then the trace back by another, one operation a step.
_AFFINE = f"""WITH RECURSIVE {V.PARTS}, st AS (SELECT p_partkey AS p, reverse(ref) AS a, reverse(alt) AS b FROM pp),
    m AS (SELECT p, a, b, 0 AS i, [CASE j WHEN 0 THEN 0 ELSE 6 + 2 * j END for j in range(0, length(b) + 1)] AS best, [1000000 + 0 * j for j in range(0, length(b) + 1)] AS up, [CASE j WHEN 0 THEN 1000000 ELSE 6 + 2 * j END for j in range(0, length(b) + 1)] AS lf FROM st
      UNION ALL SELECT p, a, b, i, [least(here[j], lf[j]) for j in range(1, len(here) + 1)], up, lf FROM (
        SELECT *, [CASE j WHEN 1 THEN 1000000 ELSE list_min([here[k] + 6 + 2 * (j - k) for k in range(1, j)]) END for j in range(1, len(here) + 1)] AS lf FROM (
          SELECT *, [CASE j WHEN 1 THEN up[j] ELSE least(up[j], old[j - 1] + CASE WHEN a[i] = b[j - 1] THEN 0 ELSE 5 END) END for j in range(1, length(b) + 2)] AS here FROM (
            SELECT p, a, b, i + 1 AS i, best AS old, [least(best[j] + 8, up[j] + 2) for j in range(1, length(b) + 2)] AS up FROM m WHERE i < length(a))))),
    c AS MATERIALIZED (SELECT p, a, b, i, unnest(range(0, length(b) + 1)) AS j, unnest(best) AS best, unnest(up) AS up, unnest(lf) AS lf FROM m),
    cell AS MATERIALIZED (SELECT *, CASE WHEN i > 0 THEN a[i] END AS x, CASE WHEN j > 0 THEN b[j] END AS y, coalesce(i > 1 AND up = lag(up) OVER (PARTITION BY p, j ORDER BY i) + 2, false) AS more_i, coalesce(j > 1 AND lf = lag(lf) OVER (PARTITION BY p, i ORDER BY j) + 2, false) AS more_d FROM c),
    tb AS (SELECT p, length(a) AS i, length(b) AS j, 'M' AS s, '' AS ops FROM st
      UNION ALL SELECT p, CASE op WHEN 'D' THEN i ELSE i - 1 END, CASE op WHEN 'I' THEN j ELSE j - 1 END, CASE WHEN op = 'I' AND more_i THEN 'I' WHEN op = 'D' AND more_d THEN 'D' ELSE 'M' END, ops || op FROM (
        SELECT tb.p, tb.i, tb.j, ops, more_i, more_d, CASE WHEN s = 'I' OR s = 'M' AND tb.i > 0 AND best = up THEN 'I' WHEN s = 'D' OR tb.j > 0 AND best = lf THEN 'D' WHEN x = y THEN '=' ELSE 'X' END AS op
        FROM tb JOIN cell ON cell.p = tb.p AND cell.i = tb.i AND cell.j = tb.j WHERE tb.i > 0 OR tb.j > 0))
    SELECT tb.p AS p_partkey, CAST(cell.best AS BIGINT) AS cost, array_to_string(list_transform(regexp_extract_all(ops, 'I+|D+|X+|=+'), lambda r: length(r) || r[1]), '') AS cigar
    FROM tb JOIN st USING (p) JOIN cell ON cell.p = tb.p AND cell.i = length(st.a) AND cell.j = length(st.b) WHERE tb.i = 0 AND tb.j = 0"""


@query(_AFFINE)
def affine_align(spark, sf):
    """Affine alignment cost of neighbouring part names, and its operations."""
    import pandas as pd

    from haplospark.kernels.align import affine_cigar, cigar_cost

    def run(batches):
        for pdf in batches:
            ops = [affine_cigar(a, b, 5, 6, 2) for a, b in zip(pdf["ref"], pdf["alt"])]
            yield pd.DataFrame({"p_partkey": pdf["p_partkey"], "cost": [cigar_cost(o, 5, 6, 2) for o in ops], "cigar": ["".join(f"{n}{op}" for op, n in o) for o in ops]})

    return V.numbered_parts(spark, sf).mapInPandas(run, "p_partkey long, cost long, cigar string")


@query()
def graph_eval(spark, sf):
    """Results of calls in superclusters by the variant graph, for both assignments of haplotypes."""
    from haplospark.operators.alignment import evaluate_superclusters

    v = _sequenced(spark, sf)
    ranges = v.groupBy("contig", "sc_idx").agg((F.min("pos") - 1).alias("beg"), (F.max(F.col("pos") + F.col("rlen")) + 1).alias("end")).withColumn("beg", F.greatest(F.lit(0), "beg"))
    return evaluate_superclusters(v, ranges, _genome(spark, sf)).groupBy("callset", "swap", "errtype").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("credit"), 6).alias("mean_credit"))


@query()
def realign_clusters(spark, sf):
    """Calls of clusters in the representation that the realignment penalties prefer."""
    from haplospark.operators.alignment import realign

    return realign(_clustered(spark, sf).where("pos > 0"), _genome(spark, sf)).groupBy("callset", "type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("ref") + F.length("alt")).alias("bases"))


@query()
def reach_clusters(spark, sf):
    """Clusters by how far realignments may reach, for calls of eight bases at most."""
    from haplospark.operators.alignment import reach_iterations

    # longer calls, one in 65 bases of a contig, would join whole contigs, as each reaches over its neighbours
    v = _sequenced(spark, sf).where("pos > 0").select("callset", "contig", "hap", "pos", "var_idx", F.least("rlen", F.col("rlen") % 8 + 1).cast("long").alias("rlen"), F.expr("left(alt, length(alt) % 8 + 1)").alias("alt"))
    return reach_iterations(v, _genome(spark, sf)).groupBy("callset", "contig", "hap").agg(F.countDistinct("cluster_id").alias("n_clusters"), F.count(F.lit(1)).alias("n_vars"))


# Substitutions at a few places, the new base told by the place: a call is right if the other side has one there.
_SUBS = """sub AS (SELECT DISTINCT event_type AS contig, CASE WHEN event_id % 2 = 0 THEN 'QUERY' ELSE 'TRUTH' END AS callset, CAST(event_id // 2 % 2 AS INT) AS hap, event_id * 13 // 52 % 500 * 20 + 10 AS pos FROM events)"""


def _substitutions(spark, sf):
    e = V.table(spark, sf, "events")
    return e.select(
        F.col("event_type").alias("contig"), F.when(F.col("event_id") % 2 == 0, "QUERY").otherwise("TRUTH").alias("callset"), F.floor(F.col("event_id") / 2 % 2).cast("int").alias("hap"),
        (F.floor(F.col("event_id") * 13 / 52) % 500 * 20 + 10).alias("pos"),
    ).distinct()


@query(
    f"""WITH {_SUBS}, s AS (SELECT *, unnest([false, true]) AS swap FROM sub), r AS (SELECT s.*, EXISTS (SELECT 1 FROM sub o WHERE o.contig = s.contig AND o.pos = s.pos AND o.callset <> s.callset AND o.hap = CASE WHEN s.swap THEN 1 - s.hap ELSE s.hap END) AS ok FROM s)
    SELECT callset, swap, CASE WHEN ok THEN 'TP' WHEN callset = 'QUERY' THEN 'FP' ELSE 'FN' END AS errtype, count(*) AS n, CAST(sum(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS credit FROM r GROUP BY 1, 2, 3"""
)
def graph_eval_substitutions(spark, sf):
    """Results of the variant graph on substitutions, which SQL tells from equal places."""
    from haplospark.operators.alignment import evaluate_superclusters

    v = _substitutions(spark, sf)
    top = v.agg(F.max("pos").alias("n"))
    seq = F.expr(f"concat_ws('', transform(sequence(0, int(n / 128) + 2), i -> translate(sha2(cast(i as string), 512), '0123456789abcdef', 'ACGTACGTACGTACGT')))")
    genome = v.select("contig").distinct().crossJoin(top).select("contig", seq.alias("seq")).withColumn("length", F.length("seq"))  # one row of top
    base = F.expr("translate(substring(seq, int(pos) + 1, 1), 'ACGT', 'CGTA')")
    v = v.join(genome.select("contig", "seq"), "contig").withColumn("alt", base).drop("seq")
    order = Window.partitionBy("callset", "contig", "hap").orderBy("pos")
    v = v.withColumns({"rlen": F.lit(1), "qual": F.lit(30.0).cast("float"), "var_idx": F.row_number().over(order).cast("long"), "sc_idx": F.floor(F.col("pos") / 100)})
    ranges = v.groupBy("contig", "sc_idx").agg((F.min("pos") - 1).alias("beg"), (F.max("pos") + 2).alias("end"))
    return evaluate_superclusters(v, ranges, genome).groupBy("callset", "swap", "errtype").agg(F.count(F.lit(1)).alias("n"), F.sum("credit").alias("credit"))


_RUNS = """rn AS (SELECT event_type AS contig, event_id, event_id * 29 AS pos, CASE WHEN event_id % 3 = 0 THEN 'INS' ELSE 'DEL' END AS type, substr('ACGT', CAST(event_id * 29 // 20 % 4 + 1 AS INT), 1) AS base FROM events WHERE event_id * 29 % 20 + 1 < 20)"""


@query(f"WITH {_RUNS} SELECT event_id, pos - pos % 20 AS pos, type, base FROM rn")
def left_shift_runs(spark, sf):
    """Insertions and deletions of a base in runs of twenty equal bases: each moves to the start of its run."""
    from haplospark.operators.alignment import left_shift

    e = V.table(spark, sf, "events").select(F.col("event_type").alias("contig"), "event_id", (F.col("event_id") * 29).alias("pos")).where("pos % 20 + 1 < 20")
    base = F.expr("substring('ACGT', int(floor(pos / 20) % 4) + 1, 1)")
    kind = F.when(F.col("event_id") % 3 == 0, "INS").otherwise("DEL")
    v = e.withColumns({"callset": F.lit("QUERY"), "hap": F.lit(0), "var_idx": F.col("event_id"), "type": kind, "rlen": F.when(kind == "INS", 0).otherwise(1), "ref": F.when(kind == "DEL", base).otherwise(""), "alt": F.when(kind == "INS", base).otherwise("")})
    top = e.groupBy("contig").agg(F.max("pos").alias("n"))
    seq = F.expr("concat_ws('', transform(sequence(0, int(n / 20) + 1), i -> repeat(substring('ACGT', int(i % 4) + 1, 1), 20)))")
    genome = top.select("contig", seq.alias("seq")).withColumn("length", F.length("seq"))
    return left_shift(v, genome).select("event_id", "pos", "type", F.concat("ref", "alt").alias("base"))


@query(
    f"""WITH {V.SUPER}, h AS (SELECT contig, sc_idx, callset, hap, sum(CASE type WHEN 'INS' THEN size WHEN 'DEL' THEN -size ELSE 0 END) AS g FROM pv GROUP BY ALL),
    n AS (SELECT contig, sc_idx, callset, CASE WHEN count(*) < 2 THEN greatest(0, max(g)) ELSE max(g) END AS g FROM h GROUP BY ALL),
    l AS (SELECT st.contig, st.sc_idx, fin - beg + coalesce(max(g) FILTER (callset = 'QUERY'), 0) AS query_len, fin - beg + coalesce(max(g) FILTER (callset = 'TRUTH'), 0) AS truth_len FROM st LEFT JOIN n USING (contig, sc_idx) GROUP BY st.contig, st.sc_idx, fin, beg)
    SELECT contig, sc_idx, CAST(query_len AS BIGINT) AS query_len, CAST(truth_len AS BIGINT) AS truth_len, CAST(query_len * truth_len * 20 AS BIGINT) AS cost,
      CAST(CASE WHEN query_len * truth_len * 20 < 1e6 THEN 0 WHEN query_len * truth_len * 20 < 1e7 THEN 1 ELSE 2 END AS INT) AS step FROM l"""
)
def supercluster_costs(spark, sf):
    """Memory that each supercluster's evaluation needs, and the step of a ladder it falls in."""
    from haplospark.operators.alignment import supercluster_costs as costs

    p = V.placed(spark, sf)
    alt = F.when(F.col("type") == "INS", F.expr("repeat('A', int(size))")).when(F.col("type") == "SUB", "A").otherwise("")
    return costs(p.withColumn("alt", alt), clustering.supercluster_table(V.super_(spark, sf)).select("contig", "sc_idx", "beg", "end"), steps=(0.001, 0.01, 64.0))
