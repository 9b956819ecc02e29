"""Region masks: checks, set operations, and joins of variants with regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haplospark.operators.clustering import islands

BIN = 16_384  # bases; regions and variants meet by contig and bin


def mask_problems(regions: DataFrame) -> DataFrame:
    """(contig, start, stop, problem) of regions that are empty, unsorted or overlapping; abutting ones get a warning.

    regions: contig, start, stop, line (their order).
    """
    w = Window.partitionBy("contig").orderBy("line")
    before = regions.withColumns({"p_start": F.lag("start").over(w), "p_stop": F.lag("stop").over(w)})
    problem = (
        F.when(F.col("stop") < F.col("start"), "negative length")
        .when(F.col("stop") == F.col("start"), "zero length")
        .when(F.col("start") < F.col("p_start"), "unsorted")
        .when(F.col("start") < F.col("p_stop"), "overlap")
        .when(F.col("start") == F.col("p_stop"), "abutting")
    )
    return before.withColumn("problem", problem).where("problem is not null").select("contig", "start", "stop", "problem")


def merge_mask(regions: DataFrame) -> DataFrame:
    """Union of regions: those that touch or overlap become one."""
    return islands(regions, ("contig",), "start", "stop").groupBy("contig", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def complement(merged: DataFrame, low: int, high: int) -> DataFrame:
    """What merged disjoint regions leave of [low, high) on their contigs."""
    w = Window.partitionBy("contig").orderBy("start")
    gaps = merged.select("contig", F.coalesce(F.lag("stop").over(w), F.lit(low)).alias("start"), F.col("start").alias("stop"))
    tail = merged.groupBy("contig").agg(F.max("stop").alias("start")).withColumn("stop", F.lit(high))
    return gaps.unionByName(tail).where("start < stop")


def subtract_mask(a: DataFrame, b: DataFrame, high: int) -> DataFrame:
    """Parts of merged mask a outside merged mask b; high: beyond every stop."""
    free = complement(b, 0, high)
    whole = a.join(b.select("contig").distinct(), "contig", "left_anti")
    hull = a.groupBy("contig").agg(F.min("start").alias("h0"), F.max("stop").alias("h1"))
    near = free.join(hull, "contig").select("contig", F.greatest("start", "h0").alias("y0"), F.least("stop", "h1").alias("y1")).where("y0 < y1")
    meet = binned(a.select("contig", F.col("start").alias("x0"), F.col("stop").alias("x1")), F.col("x0"), F.col("x1")).join(binned(near, F.col("y0"), F.col("y1")), ["contig", "_bin"])
    part = meet.where("x0 < y1 and y0 < x1").select("contig", F.greatest("x0", "y0").alias("start"), F.least("x1", "y1").alias("stop")).distinct()
    return part.unionByName(whole.select("contig", "start", "stop")).where("start < stop")


def binned(df: DataFrame, start: Column, stop: Column) -> DataFrame:
    """A row per bin that [start, stop) touches."""
    return df.withColumn("_bin", F.explode(F.sequence((start / BIN).cast("long"), (F.greatest(start, stop - 1) / BIN).cast("long"))))


def located(variants: DataFrame, regions: DataFrame) -> DataFrame:
    """loc of each variant: INSIDE, OUTSIDE, BORDER or OFF CTG, by one outer join and one aggregation.

    variants: contig, start, stop (half-open; an insertion stops where it starts plus its anchor), type and a key
    `vid`; regions: contig, start, stop, sorted and disjoint.  Regions and variants meet by contig and bin, an
    equality that Spark may hash or sort as sizes ask; a variant lies in as many bins as it touches, so two at most
    unless it is longer than a bin.  A null mask is handled by the caller.
    """
    r = binned(regions.select("contig", F.col("start").alias("r_start"), F.col("stop").alias("r_stop")), F.col("r_start"), F.col("r_stop"))
    row = F.struct(*[F.col(c) for c in variants.columns]).alias("row")
    v = binned(variants.select(row, "vid", "contig", "start", "stop", "type"), F.col("start"), F.col("stop"))
    meets = (F.col("r_start") < F.col("stop")) & (F.col("r_stop") > F.col("start"))
    whole = (F.col("r_start") <= F.col("start")) & (F.col("stop") <= F.col("r_stop")) & ~((F.col("type") == "INS") & (F.col("start") == F.col("r_stop") - 1))
    met = v.join(r, ["contig", "_bin"], "left").groupBy("vid").agg(F.first("row").alias("row"), F.max(F.when(meets, whole)).alias("whole"))
    known = regions.select(F.col("contig").alias("_contig")).distinct()
    loc = F.when(F.col("_contig").isNull(), "OFF CTG").when(F.col("whole"), "INSIDE").when(F.col("whole").isNotNull(), "BORDER").otherwise("OUTSIDE")
    return met.join(known, F.col("row.contig") == F.col("_contig"), "left").select("row.*", loc.alias("loc"))


def as_of_region(points: DataFrame, regions: DataFrame) -> DataFrame:
    """For each point (contig, pos, vid) the last region that starts at or before it: an as-of join by union and windows.

    Rows are ordered within bins of a contig; what earlier bins hold is one region a bin, carried along the bins.
    """
    both = points.select("contig", F.col("pos").alias("at"), F.lit(1).alias("side"), "vid", F.lit(None).cast("struct<start:long,stop:long>").alias("region")).unionByName(
        regions.select("contig", F.col("start").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("vid"), F.struct(F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop")).alias("region"))
    ).withColumn("_bin", F.floor(F.col("at") / BIN))
    w = Window.partitionBy("contig", "_bin").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("last", F.last("region", ignorenulls=True).over(w)).where("side = 1")
    bins = both.groupBy("contig", "_bin").agg(F.max("region").alias("most"))
    earlier = F.last("most", ignorenulls=True).over(Window.partitionBy("contig").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    found = seen.join(bins.withColumn("earlier", earlier), ["contig", "_bin"]).withColumn("last", F.coalesce("last", "earlier"))
    return found.select("vid", "contig", F.col("at").alias("pos"), F.col("last.start").alias("r_start"), F.col("last.stop").alias("r_stop"))


def interleaved_contigs(rows: DataFrame, order: str) -> DataFrame:
    """(contig) of contigs whose stretch of the file overlaps that of another one: the file isn't sorted.

    Each contig's first and last place is enough, so nothing is sorted but one row per contig.
    """
    span = rows.groupBy("contig").agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    w = Window.orderBy("lo")
    before, after = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lead("lo").over(w)
    return span.withColumn("mixed", (F.coalesce(before > F.col("lo"), F.lit(False))) | F.coalesce(after < F.col("hi"), F.lit(False))).where("mixed").select("contig")


def contig_universe(query: DataFrame, truth: DataFrame, reference: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """(contig, length, n_query, n_truth): the contigs to evaluate, also those without calls of either side.

    With regions exactly their contigs, else those of either callset; length is null where the genome lacks one.
    """
    counts = [df.groupBy("contig").agg(F.count(F.lit(1)).alias(n)) for df, n in ((query, "n_query"), (truth, "n_truth"))]
    if regions is not None:
        known = regions.select("contig").distinct()
        both = known.join(counts[0], "contig", "left").join(counts[1], "contig", "left")
    else:
        both = counts[0].join(counts[1], "contig", "full_outer")
    rows = both.join(reference.select("contig", "length"), "contig", "left")
    return rows.select("contig", "length", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n_query", "n_truth")])
