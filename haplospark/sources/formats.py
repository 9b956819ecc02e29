"""Readers and writers of VCF, FASTA and BED files, as text that Spark splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haplospark.operators.intervals import interleaved_contigs, mask_problems
from haplospark.sources.bcf import bcf_lines


class FormatError(ValueError):
    """A file breaks the rules of its format."""


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(contig, seq, length): a row per sequence, upper case; plain or gzip."""
    rec = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    name = F.regexp_extract("value", r"^(\S+)", 1)
    seq = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s+", ""))
    return rec.select(name.alias("contig"), seq.alias("seq")).withColumn("length", F.length("seq"))


def read_bed(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """(contig, start, stop, line) of the first three columns; raises where regions are empty, unsorted or overlap."""
    raw = spark.read.text(path).where("value <> '' and value not rlike '^(#|track|browser)'").withColumn("line", F.monotonically_increasing_id())
    cols = F.split("value", "\t")
    regions = raw.select(cols[0].alias("contig"), cols[1].cast("long").alias("start"), cols[2].cast("long").alias("stop"), "line")
    if check:
        bad = mask_problems(regions).where("problem <> 'abutting'").limit(1).collect()
        if bad:
            raise FormatError(f"{path}: {bad[0]['problem']} at {bad[0]['contig']}:{bad[0]['start']}-{bad[0]['stop']}")
    return regions


def _vcf_text(spark: SparkSession, path: str) -> DataFrame:
    return bcf_lines(spark, path) if path.endswith(".bcf") else spark.read.text(path)


def vcf_header(spark: SparkSession, path: str) -> dict:
    """FILTER ids, contigs with lengths in file order, and the one sample's name."""
    lines = [r["value"] for r in _vcf_text(spark, path).where("value like '#%'").collect()]  # headers are small
    import re

    out: dict = {"filters": [], "contigs": {}, "sample": None}
    for x in lines:
        if m := re.match(r"##FILTER=<ID=([^,>]+)", x):
            out["filters"].append(m[1])
        elif m := re.match(r"##contig=<ID=([^,>]+)(?:,.*?length=(\d+))?", x):
            if not m[2]:
                raise FormatError(f"{path}: contig {m[1]} has no length")
            out["contigs"][m[1]] = int(m[2])
        elif x.startswith("#CHROM"):
            samples = x.split("\t")[9:]
            if len(samples) != 1:
                raise FormatError(f"{path}: one sample is needed, found {len(samples)}")
            out["sample"] = samples[0]
    if out["sample"] is None:
        raise FormatError(f"{path}: no header line")
    return out


def read_vcf(spark: SparkSession, path: str, callset: str) -> DataFrame:
    """Records of a VCF, or of a BCF if the name ends so: callset, contig, pos (0-based), ref, alts, qual, filter, gt, gq, ps, file_ord.

    A missing GT is the haploid first alternate; missing QUAL, GQ and PS are 0.
    """
    vcf_header(spark, path)
    raw = _vcf_text(spark, path).where("value not like '#%' and value <> ''").withColumn("file_ord", F.monotonically_increasing_id())
    c = F.split("value", "\t")
    keys, vals = F.split(c[8], ":"), F.split(c[9], ":")

    def tag(name: str):
        return F.try_element_at(vals, F.nullif(F.array_position(keys, name), F.lit(0)).cast("int"))

    rec = raw.select(
        F.lit(callset).alias("callset"), c[0].alias("contig"), (c[1].cast("long") - 1).alias("pos"), F.upper(c[3]).alias("ref"), F.split(F.upper(c[4]), ",").alias("alts"),
        F.coalesce(F.expr("try_cast(split(value, '\t')[5] as float)"), F.lit(0.0)).cast("float").alias("qual"), c[6].alias("filter"),
        F.coalesce(tag("GT"), F.lit("1")).alias("gt"), tag("GQ").alias("_gq"), tag("PS").alias("_ps"), "file_ord",
    )
    return rec.select("*", F.coalesce(F.expr("cast(try_cast(_gq as double) as int)"), F.lit(0)).alias("gq"), F.coalesce(F.expr("try_cast(_ps as long)"), F.lit(0)).alias("ps")).drop("_gq", "_ps")


def unsorted_contigs(records: DataFrame) -> list[str]:
    """Contigs that come again after another one, by their stretches of the file."""
    return sorted(r["contig"] for r in interleaved_contigs(records, "file_ord").collect())


def with_anchor(variants: DataFrame, reference: DataFrame) -> DataFrame:
    """out_pos (1-based), out_ref, out_alt: insertions and deletions with the base before them."""
    from haplospark.operators.alignment import BLOCK, reference_blocks

    anchored = F.col("type").isin("INS", "DEL")
    at = F.greatest(F.lit(0), F.col("pos") - 1)
    v = variants.withColumn("block", F.floor(at / BLOCK).cast("int")).join(reference_blocks(reference), ["contig", "block"])
    base = F.when(anchored, F.substring("bases", (at % BLOCK + 1).cast("int"), F.lit(1))).otherwise("")
    return v.select(*variants.columns, (F.col("pos") + F.when(anchored, 0).otherwise(1)).alias("out_pos"), F.concat(base, "ref").alias("out_ref"), F.concat(base, "alt").alias("out_alt"))


def vcf_lines(merged: DataFrame, contigs: dict[str, int], sample: str) -> DataFrame:
    """Lines of a VCF of genotypes, in order; merged: contig, pos, ref, alt, gt, qual (as written)."""
    spark = merged.sparkSession
    head = ["##fileformat=VCFv4.2", '##FILTER=<ID=PASS,Description="All filters passed">', *[f"##contig=<ID={c},length={n}>" for c, n in contigs.items()], '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', f"#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t{sample}"]
    order = F.create_map(*[x for i, c in enumerate(contigs) for x in (F.lit(c), F.lit(i))]) if contigs else F.create_map()
    line = F.concat_ws("\t", "contig", F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.format_string("%.2f", F.col("qual").cast("double")), F.lit("PASS"), F.lit("."), F.lit("GT"), "gt")
    body = merged.select(F.try_element_at(order, F.col("contig")).alias("c"), "pos", "ref", "alt", line.alias("value"))
    top = spark.createDataFrame([(-1, i, "", "", x) for i, x in enumerate(head)], "c int, pos long, ref string, alt string, value string")
    return top.unionByName(body).orderBy("c", "pos", "ref", "alt").select("value")


def summary_lines(variants: DataFrame, superclusters: DataFrame, reference: DataFrame, contigs: dict[str, int], config) -> DataFrame:
    """Lines of the two-sample VCF: truth and query calls of one allele side by side, with what they turned out to be.

    The decision comes from the credit: 1 is a full match, none no match, at least the threshold a partial match that
    counts.  A side without the call has dots but for its supercluster and block.
    """
    head = [
        "##fileformat=VCFv4.2",
        '##FILTER=<ID=PASS,Description="All filters passed">',
        *[f"##contig=<ID={c},length={n}>" for c, n in contigs.items()],
        *[f'##FORMAT=<ID={k},Number=1,Type={t},Description="{d}">' for k, t, d in SUMMARY_TAGS],
        "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tTRUTH\tQUERY",
    ]
    sc = superclusters.select("contig", "sc_idx", "sc_phase", "pb_phase", "pb_idx", F.col("phase_set").alias("sc_set"))
    v = with_anchor(variants, reference).join(sc, ["contig", "sc_idx"])
    full, part = F.col("credit") == 1, F.col("credit").cast("double") >= config.credit_threshold
    wrong = F.when(F.col("callset") == "QUERY", "FP").otherwise("FN")
    decision = F.when(full | part, "TP").otherwise(wrong)
    kind = F.when(full, "gm").when(F.col("credit") > 0, "lm").otherwise(".")
    out_hap = F.when((F.col("callset") == "QUERY") & F.col("swap"), 1 - F.col("hap")).otherwise(F.col("hap"))
    gt = F.when(F.col("hap") == 0, "1|0").otherwise("0|1")
    flip = ((F.col("sc_phase") != 2) & (F.col("sc_phase") != F.col("pb_phase"))).cast("int")
    place = F.concat_ws(":", F.col("sc_idx").cast("string"), F.col("sync_group").cast("string"), F.col("phase_set").cast("string"), F.col("pb_idx").cast("string"), F.col("pb_phase").cast("string"), flip.cast("string"))
    call = F.concat_ws(":", gt, decision, F.format_string("%f", F.col("credit").cast("double")), F.col("ref_ed").cast("string"), F.col("query_ed").cast("string"), kind, F.format_string("%.2f", F.col("qual").cast("double")), place)
    none = F.concat(F.lit(".:.:.:.:.:.:.:"), F.col("sc_idx").cast("string"), F.lit(":.:.:"), F.col("pb_idx").cast("string"), F.lit(":.:."))
    key = ["contig", "out_pos", "out_ref", "out_alt", "out_hap", "nth"]
    rank = F.row_number().over(Window.partitionBy("callset", *key[:-2], "out_hap").orderBy("var_idx"))
    v = v.withColumn("out_hap", out_hap).withColumn("nth", rank).select(*key, "callset", call.alias("call"), none.alias("none"), "qual")
    t = v.where("callset = 'TRUTH'").select(*key, F.col("call").alias("t"), F.col("none").alias("tn"))
    q = v.where("callset = 'QUERY'").select(*key, F.col("call").alias("q"), F.col("none").alias("qn"), "qual")
    both = t.join(q, key, "full_outer")
    line = F.concat_ws(
        "\t", "contig", F.col("out_pos").cast("string"), F.lit("."), "out_ref", "out_alt", F.coalesce(F.format_string("%.2f", F.col("qual").cast("double")), F.lit(".")), F.lit("PASS"), F.lit("."),
        F.lit(":".join(k for k, _, _ in SUMMARY_TAGS)), F.coalesce("t", "qn"), F.coalesce("q", "tn"),
    )
    order = F.create_map(*[x for i, c in enumerate(contigs) for x in (F.lit(c), F.lit(i))])
    body = both.select(F.try_element_at(order, F.col("contig")).alias("c"), F.col("out_pos").alias("p"), F.col("out_hap").cast("long").alias("h"), line.alias("value"))
    top = variants.sparkSession.createDataFrame([(-1, i, 0, x) for i, x in enumerate(head)], "c int, p long, h long, value string")
    return top.unionByName(body).orderBy("c", "p", "h", "value").select("value")


# Tags of the two-sample VCF.
SUMMARY_TAGS = (
    ("GT", "String", "Genotype"),
    ("BD", "String", "Decision: TP, FP or FN"),
    ("BC", "Float", "Credit, 0 to 1"),
    ("RD", "Integer", "Edits between reference and truth in the sync group"),
    ("QD", "Integer", "Edits between query and truth in the sync group"),
    ("BK", "String", "Kind of match: gm full, lm partial, . none"),
    ("QQ", "Float", "Quality"),
    ("SC", "Integer", "Supercluster"),
    ("SG", "Integer", "Sync group"),
    ("PS", "Integer", "Phase set"),
    ("PB", "Integer", "Phase block"),
    ("BS", "Integer", "State of the block: 0 as is, 1 swapped"),
    ("FE", "Integer", "Flip error"),
)
