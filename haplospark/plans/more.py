"""Further registered queries: comparisons of clusterings, phasings and call sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haplospark.operators import clustering, intervals, phasing
from haplospark.plans import views as V
from haplospark.plans.queries import query

GAPS = (10, 50, 200)


def _island_sql(gap: int) -> str:
    return f"""SELECT {gap} AS gap, contig, count(*) AS n, CAST(max(e - b) AS BIGINT) AS largest, round(avg(e - b), 4) AS mean_size, CAST(max(v) AS BIGINT) AS most_vars FROM (
      SELECT contig, i, min(pos) AS b, max(e) AS e, count(*) AS v FROM (SELECT *, sum(s) OVER (PARTITION BY contig ORDER BY pos, e ROWS UNBOUNDED PRECEDING) AS i FROM (
        SELECT *, CASE WHEN pos <= max(e) OVER (PARTITION BY contig ORDER BY pos, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS s FROM (SELECT contig, pos, pos + rlen AS e FROM ev))) GROUP BY contig, i) GROUP BY contig"""


@query(f"WITH {V.EV} " + " UNION ALL ".join(_island_sql(g) for g in GAPS))
def gap_regions(spark, sf):
    """Regions of variants of both callsets, merged over gaps of several sizes."""
    v = V.calls(spark, sf).select("contig", "pos", (F.col("pos") + F.col("rlen")).alias("stop"))

    def at(gap: int) -> DataFrame:
        r = clustering.islands(v, ("contig",), "pos", "stop", gap).groupBy("contig", "island").agg((F.max("stop") - F.min("pos")).alias("size"), F.count(F.lit(1)).alias("v"))
        return r.groupBy("contig").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("largest"), F.round(F.avg("size"), 4).alias("mean_size"), F.max("v").alias("most_vars")).withColumn("gap", F.lit(gap))

    return reduce(DataFrame.unionByName, map(at, GAPS))


def _linked(clustered: DataFrame) -> DataFrame:
    """Pairs of neighbouring variants in one cluster."""
    w = Window.partitionBy("callset", "contig", "hap").orderBy("pos", "var_idx")
    rows = clustered.withColumns({"before": F.lag("var_idx").over(w), "c": F.lag("cluster_id").over(w)})
    return rows.where("c = cluster_id").select("callset", F.col("before").alias("a"), F.col("var_idx").alias("b"))


_PAIRS = "SELECT callset, a, b FROM (SELECT callset, var_idx AS b, cluster_id, lag(var_idx) OVER w AS a, lag(cluster_id) OVER w AS c FROM cl WINDOW w AS (PARTITION BY callset, contig, hap ORDER BY pos, var_idx)) WHERE c = cluster_id"


@query(
    f"""WITH gp AS (WITH {V.clustered_sql('gap')} {_PAIRS}), sz AS (WITH {V.clustered_sql('size')} {_PAIRS})
    SELECT callset, 'added' AS change, count(*) AS n FROM (SELECT * FROM sz EXCEPT SELECT * FROM gp) GROUP BY 1
    UNION ALL SELECT callset, 'broken', count(*) FROM (SELECT * FROM gp EXCEPT SELECT * FROM sz) GROUP BY 1"""
)
def clustering_changes(spark, sf):
    """Dependencies that size-based clusters add to gap-based ones, or break."""
    gap, size = (_linked(V.clustered(spark, sf, m)) for m in ("gap", "size"))
    added, broken = size.subtract(gap).withColumn("change", F.lit("added")), gap.subtract(size).withColumn("change", F.lit("broken"))
    return added.unionByName(broken).groupBy("callset", "change").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {V.PATH} SELECT contig, count(*) AS n, round(100.0 * count(*) FILTER (is_switch) / count(*), 6) AS switch_rate, round(100.0 * count(*) FILTER (is_flip) / count(*), 6) AS flip_rate FROM pt GROUP BY 1")
def phase_error_rates(spark, sf):
    """Switches and flips per hundred superclusters."""
    n = F.count(F.lit(1))
    return V.path(spark, sf).groupBy("contig").agg(n.alias("n"), F.round(100.0 * F.count_if("is_switch") / n, 6).alias("switch_rate"), F.round(100.0 * F.count_if("is_flip") / n, 6).alias("flip_rate"))


@query(f"WITH {V.PATH} SELECT contig, pb_idx, count(*) FILTER (is_switch) AS switch_errors, count(*) FILTER (is_flip) AS flip_errors, count(*) FILTER (sc_phase <> 2 AND sc_phase <> pb_phase) AS flipped, count(*) FILTER (CASE WHEN sc_phase <> 2 THEN sc_phase = 1 ELSE pb_phase = 1 END) AS swapped FROM pt GROUP BY ALL")
def block_errors(spark, sf):
    """Errors, flip flags and exchanged superclusters per phase block."""
    sc, pb = F.col("sc_phase"), F.col("pb_phase")
    return V.path(spark, sf).groupBy("contig", "pb_idx").agg(F.count_if("is_switch").alias("switch_errors"), F.count_if("is_flip").alias("flip_errors"), F.count_if(phasing.flip_flag(sc, pb)).alias("flipped"), F.count_if(phasing.effective_swap(sc, pb)).alias("swapped"))


@query(
    f"""WITH {V.EV}, b AS (SELECT callset, phase_set, min(pos) AS b, max(pos + rlen) AS e FROM ev WHERE phase_set > 0 GROUP BY ALL), r AS (SELECT callset, e - b AS size, sum(e - b) OVER (PARTITION BY callset ORDER BY e - b DESC ROWS UNBOUNDED PRECEDING) AS run, sum(e - b) OVER (PARTITION BY callset) AS total FROM b)
    SELECT callset, CAST(max(size) FILTER (run >= total // 2) AS BIGINT) AS ng50 FROM r GROUP BY 1"""
)
def phase_set_ng50(spark, sf):
    """NG50 of phase-set sizes of each callset."""
    b = V.calls(spark, sf).where("phase_set > 0").groupBy("callset", "phase_set").agg((F.max(F.col("pos") + F.col("rlen")) - F.min("pos")).alias("size"))
    w = Window.partitionBy("callset").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = b.withColumns({"run": F.sum("size").over(w), "total": F.sum("size").over(Window.partitionBy("callset"))})
    return run.groupBy("callset").agg(F.max(F.when(F.col("run") >= F.floor(F.col("total") / 2), F.col("size"))).alias("ng50"))


@query(f"WITH {V.SUPER} SELECT ev.event_id, st.contig, st.sc_idx FROM ev JOIN st ON ev.contig = st.contig AND ev.pos >= st.beg AND ev.pos < st.fin")
def point_in_supercluster(spark, sf):
    """Which superclusters hold the positions of calls: by bins, so the join has an equality."""
    p = V.calls(spark, sf).select("event_id", "contig", "pos", F.floor(F.col("pos") / 1024).alias("bin"))
    s = clustering.supercluster_table(V.super_(spark, sf)).select("contig", "sc_idx", "beg", "end", F.explode(F.sequence(F.floor(F.col("beg") / 1024), F.floor(F.col("end") / 1024))).alias("bin"))
    return p.join(s, ["contig", "bin"]).where("pos >= beg and pos < end").select("event_id", "contig", "sc_idx")


@query(
    f"""WITH {V.EV}, g AS (SELECT callset, contig, CAST(pos // 26 % 2000 AS BIGINT) AS p, CASE k % 3 WHEN 0 THEN '1|1' WHEN 1 THEN '1|0' ELSE '0|1' END AS gt FROM ev), o AS (SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY callset, contig, p) = 1)
    SELECT contig, p AS pos, q.gt AS query_gt, t.gt AS truth_gt FROM (SELECT * FROM o WHERE callset = 'QUERY') q JOIN (SELECT * FROM o WHERE callset = 'TRUTH') t USING (contig, p) WHERE q.gt <> t.gt"""
)
def genotype_mismatch(spark, sf):
    """Genotypes that differ between callsets, at positions each holds once."""
    w = Window.partitionBy("callset", "contig", "pos")
    g = V.calls(spark, sf).select("callset", "contig", (F.floor(F.col("pos") / 26) % 2000).cast("long").alias("pos"), F.when(F.col("k") % 3 == 0, "1|1").when(F.col("k") % 3 == 1, "1|0").otherwise("0|1").alias("gt"))
    one = g.withColumn("n", F.count(F.lit(1)).over(w)).where("n = 1")
    q = one.where("callset = 'QUERY'").select("contig", "pos", F.col("gt").alias("query_gt"))
    t = one.where("callset = 'TRUTH'").select("contig", "pos", F.col("gt").alias("truth_gt"))
    return q.join(t, ["contig", "pos"]).where("query_gt <> truth_gt")


@query(
    f"""WITH {V.EV}, x AS (SELECT contig, pos // 40 * 40 AS start, (pos // 40 + 1 + k % 3) * 40 AS stop, event_id FROM ev), f AS (SELECT *, lag(stop) OVER (PARTITION BY contig ORDER BY start, event_id) AS ps, lag(start) OVER (PARTITION BY contig ORDER BY start, event_id) AS pb FROM x)
    SELECT contig, pb AS start, stop FROM f WHERE ps = start"""
)
def external_flips(spark, sf):
    """Flips in a list of switches: two neighbours that share an end."""
    x = V.calls(spark, sf).select("contig", (F.floor(F.col("pos") / 40) * 40).alias("start"), ((F.floor(F.col("pos") / 40) + 1 + F.col("k") % 3) * 40).alias("stop"), "event_id")
    w = Window.partitionBy("contig").orderBy("start", "event_id")
    f = x.withColumns({"ps": F.lag("stop").over(w), "pb": F.lag("start").over(w)})
    return f.where("ps = start").select("contig", F.col("pb").alias("start"), "stop")


@query(f"WITH {V.EV} SELECT coalesce(callset, 'all') AS callset, coalesce(contig, 'all') AS contig, coalesce(type, 'all') AS type, count(*) AS n FROM ev GROUP BY GROUPING SETS ((callset, type), (callset, contig), (callset), ())")
def call_counters(spark, sf):
    """Numbers of calls by type and by contig, with totals."""
    V.calls(spark, sf).createOrReplaceTempView("haplospark_calls")
    return spark.sql("SELECT coalesce(callset, 'all') AS callset, coalesce(contig, 'all') AS contig, coalesce(type, 'all') AS type, count(*) AS n FROM haplospark_calls GROUP BY GROUPING SETS ((callset, type), (callset, contig), (callset), ())")


@query(f"WITH {V.EV}, s AS (SELECT contig, min(event_id) AS lo, max(event_id) AS hi FROM ev GROUP BY 1) SELECT contig FROM s a WHERE EXISTS (SELECT 1 FROM s b WHERE a.contig <> b.contig AND a.lo < b.hi AND b.lo < a.hi)")
def interleaved_contigs(spark, sf):
    """Contigs that aren't in one stretch of the file."""
    return intervals.interleaved_contigs(V.calls(spark, sf).select("contig", "event_id"), "event_id")


@query(f"WITH {V.SUPER} SELECT q.contig, q.hap AS query_hap, t.hap AS truth_hap, count(*) AS n, CAST(sum(q.n * t.n) AS BIGINT) AS pairs FROM (SELECT contig, sc_idx, hap, count(*) AS n FROM pv WHERE callset = 'QUERY' GROUP BY ALL) q JOIN (SELECT contig, sc_idx, hap, count(*) AS n FROM pv WHERE callset = 'TRUTH' GROUP BY ALL) t USING (contig, sc_idx) GROUP BY ALL")
def haplotype_product(spark, sf):
    """The four pairings of haplotypes inside superclusters."""
    p = V.placed(spark, sf).groupBy("callset", "contig", "sc_idx", "hap").agg(F.count(F.lit(1)).alias("n"))
    q = p.where("callset = 'QUERY'").select("contig", "sc_idx", F.col("hap").alias("query_hap"), F.col("n").alias("a"))
    t = p.where("callset = 'TRUTH'").select("contig", "sc_idx", F.col("hap").alias("truth_hap"), F.col("n").alias("b"))
    return q.join(t, ["contig", "sc_idx"]).groupBy("contig", "query_hap", "truth_hap").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("a") * F.col("b")).alias("pairs"))


@query(
    f"""WITH {V.EVAL}, a AS (SELECT event_id, errtype AS e1 FROM ez WHERE callset = 'QUERY'), b AS (SELECT event_id, CASE WHEN k % 10 = 0 THEN NULL ELSE errtype END AS e2 FROM ez WHERE callset = 'QUERY' AND k % 13 <> 0)
    SELECT event_id, e1, e2 FROM a LEFT JOIN b USING (event_id) WHERE e1 IS DISTINCT FROM e2"""
)
def result_differences(spark, sf):
    """Calls that two evaluations judge differently, nulls told apart from values."""
    e = V.evaluations(spark, sf).where("callset = 'QUERY'")
    b = e.where("k % 13 <> 0").select("event_id", F.when(F.col("k") % 10 != 0, F.col("errtype")).alias("e2"))
    return e.select("event_id", F.col("errtype").alias("e1")).join(b, "event_id", "left").where(~F.col("e1").eqNullSafe(F.col("e2")))


@query(
    f"""WITH {V.PATH}, d AS (SELECT contig, sc_idx, beg, fin, CAST(pb_phase AS INT) AS pb, CAST(sc_idx % 7 AS INT) AS orig_ed, CAST(sc_idx * 3 % 11 AS INT) AS swap_ed, sc_phase <> 2 AND sc_phase <> pb_phase AS own FROM pt),
    c AS (SELECT *, CASE WHEN a = 0 THEN 'none' WHEN b = 0 THEN 'flip' WHEN b >= a THEN 'unknown_none' WHEN 1 - b / a >= 0.7 THEN 'unknown_flip' ELSE 'unknown_none' END AS category FROM (SELECT *, CASE pb WHEN 0 THEN orig_ed ELSE swap_ed END AS a, CASE pb WHEN 0 THEN swap_ed ELSE orig_ed END AS b FROM d)),
    f AS (SELECT contig, pos // 40 * 40 AS start, event_id FROM ev WHERE type = 'SUB'), met AS (SELECT f.event_id, c.* FROM f JOIN c ON c.contig = f.contig AND f.start >= c.beg AND f.start <= c.fin)
    SELECT category, 'flip' AS found, count(*) AS n FROM (SELECT event_id, arg_min(category, sc_idx) AS category FROM met GROUP BY 1) GROUP BY 1
    UNION ALL SELECT category, 'none', count(*) FROM c WHERE own AND NOT EXISTS (SELECT 1 FROM met WHERE met.contig = c.contig AND met.sc_idx = c.sc_idx) GROUP BY 1"""
)
def flip_categories(spark, sf):
    """Flips of a list and our own flips, by what the distances of their superclusters say."""
    flips = V.calls(spark, sf).where("type = 'SUB'").select("contig", (F.floor(F.col("pos") / 40) * 40).alias("start"))
    p = V.path(spark, sf).select("contig", "sc_idx", "beg", "end", "pb_phase", (F.col("sc_idx") % 7).cast("int").alias("orig_ed"), (F.col("sc_idx") * 3 % 11).cast("int").alias("swap_ed"), phasing.flip_flag(F.col("sc_phase"), F.col("pb_phase")).cast("int").alias("flip_error"))
    return phasing.flip_categories(flips, p)


@query(
    f"""WITH {V.EV}, {V.RG}, q AS (SELECT contig, count(*) AS n FROM ev WHERE callset = 'QUERY' AND contig <> 'view' GROUP BY 1), t AS (SELECT contig, count(*) AS n FROM ev WHERE callset = 'TRUTH' AND contig <> 'click' GROUP BY 1),
    l AS (SELECT contig, max(pos) + 100 AS length FROM ev GROUP BY 1)
    SELECT r.contig, l.length, coalesce(q.n, 0) AS n_query, coalesce(t.n, 0) AS n_truth FROM (SELECT DISTINCT contig FROM rg) r LEFT JOIN q USING (contig) LEFT JOIN t USING (contig) LEFT JOIN l USING (contig)"""
)
def contig_universe(spark, sf):
    """Contigs of a mask with the calls of either side, none of which is on some of them."""
    v = V.calls(spark, sf)
    q, t = v.where("callset = 'QUERY' and contig <> 'view'"), v.where("callset = 'TRUTH' and contig <> 'click'")
    return intervals.contig_universe(q, t, v.groupBy("contig").agg((F.max("pos") + 100).alias("length")), V.regions(spark, sf))
