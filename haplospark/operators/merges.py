"""Merges of haplotypes, call sets and tools, as equi-joins; comparisons of interval lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haplospark.operators.intervals import BIN, binned

KEY = ("contig", "pos", "ref", "alt")


def fold_haplotypes(variants: DataFrame) -> DataFrame:
    """One record per allele of one callset: 1|1 where both haplotypes hold it, else 1|0 or 0|1."""
    rank = F.row_number().over(Window.partitionBy(*KEY, "hap").orderBy("var_idx"))
    v = variants.withColumn("nth", rank)
    a = v.where("hap = 0").select(*KEY, "nth", F.col("qual").alias("q0"))
    b = v.where("hap = 1").select(*KEY, "nth", F.col("qual").alias("q1"))
    both = a.join(b, [*KEY, "nth"], "full_outer")
    gt = F.when(F.col("q0").isNotNull() & F.col("q1").isNotNull(), "1|1").when(F.col("q0").isNotNull(), "1|0").otherwise("0|1")
    return both.select(*KEY, gt.alias("gt"), F.coalesce("q0", "q1").alias("qual"))


def pair_callsets(variants: DataFrame) -> DataFrame:
    """Truth and query calls of one allele side by side; query haplotypes exchanged where swap is true.

    variants: callset, contig, pos, ref, alt, hap, qual, swap.
    """
    out_hap = F.when((F.col("callset") == "QUERY") & F.col("swap"), 1 - F.col("hap")).otherwise(F.col("hap"))
    v = variants.withColumn("out_hap", out_hap)
    v = v.withColumn("nth", F.row_number().over(Window.partitionBy("callset", *KEY, "out_hap").orderBy("qual")))
    keys = [*KEY, "out_hap", "nth"]
    t = v.where("callset = 'TRUTH'").select(*keys, F.col("qual").alias("truth_qual"))
    q = v.where("callset = 'QUERY'").select(*keys, F.col("qual").alias("query_qual"))
    return t.join(q, keys, "full_outer").drop("nth")


def confusion(tools: dict[str, DataFrame], keys: tuple[str, ...], label: str = "errtype") -> DataFrame:
    """Number of records by the labels that several tools give them; MISSING where a tool lacks the record."""
    sides = [df.select(*keys, F.col(label).alias(name)) for name, df in tools.items()]
    all_ = reduce(lambda a, b: a.join(b, list(keys), "full_outer"), sides)
    return all_.na.fill("MISSING", list(tools)).groupBy(*tools).agg(F.count(F.lit(1)).alias("n"))


def first_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each interval of a the first overlapping one of b, by start, else nulls.

    a, b: contig, start, stop, id.
    """
    x = a.select("contig", F.col("start").alias("a_start"), F.col("stop").alias("a_stop"), F.col("id").alias("a_id"))
    y = b.select("contig", F.col("start").alias("b_start"), F.col("stop").alias("b_stop"), F.col("id").alias("b_id"))
    size = 4096
    bins = lambda lo, hi: F.explode(F.sequence((F.col(lo) / size).cast("long"), (F.col(hi) / size).cast("long")))
    hit = x.withColumn("bin", bins("a_start", "a_stop")).join(y.withColumn("bin", bins("b_start", "b_stop")), ["contig", "bin"])
    hit = hit.where("a_start < b_stop and b_start < a_stop")
    best = hit.groupBy("a_id").agg(F.min(F.struct("b_start", "b_id")).alias("m"))
    return x.join(best, "a_id", "left").select("a_id", "contig", F.col("m.b_id").alias("b_id"), F.col("m.b_start").alias("b_start"))


def stratify(variants: DataFrame, strata: DataFrame) -> DataFrame:
    """variants once for each stratum of which some region holds their position."""
    s = binned(strata.select("contig", F.col("start").alias("_lo"), F.col("stop").alias("_hi"), "stratum"), F.col("_lo"), F.col("_hi"))
    x = variants.withColumn("_bin", (F.col("pos") / BIN).cast("long"))
    return x.join(s, ["contig", "_bin"]).where("pos >= _lo and pos < _hi").select(*variants.columns, "stratum").distinct()


def multi_match(evaluations: DataFrame) -> DataFrame:
    """Share of matched variants in sync groups of one variant and of more, by type."""
    groups = evaluations.where("errtype = 'TP'").groupBy("callset", "contig", "hap", "sync_group", "vartype").agg(F.count(F.lit(1)).alias("n"))
    per = groups.groupBy("vartype").agg(F.sum(F.when(F.col("n") == 1, F.col("n")).otherwise(0)).alias("single"), F.sum("n").alias("total"))
    return per.select("vartype", "single", (F.col("total") - F.col("single")).alias("multi"), (F.col("single") / F.col("total")).alias("single_share"))
