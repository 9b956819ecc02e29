"""Result files: tab-separated tables and VCF, one file each, by way of the driver's file system or Spark's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Header lines of the output tables.
COLUMNS = {
    "precision-recall": "VAR_TYPE MIN_QUAL PREC RECALL F1_SCORE F1_QSCORE TRUTH_TOTAL TRUTH_TP TRUTH_FN QUERY_TOTAL QUERY_TP QUERY_FP",
    "precision-recall-summary": "VAR_TYPE THRESHOLD MIN_QUAL TRUTH_TP QUERY_TP TRUTH_FN QUERY_FP PREC RECALL F1_SCORE F1_QSCORE",
    "query": "CONTIG POS HAP REF ALT QUAL TYPE ERRTYPE CREDIT CLUSTER SUPERCLUSTER SYNC_GROUP REF_DIST QUERY_DIST LOCATION",
    "truth": "CONTIG POS HAP REF ALT QUAL TYPE ERRTYPE CREDIT CLUSTER SUPERCLUSTER SYNC_GROUP REF_DIST QUERY_DIST LOCATION",
    "superclusters": "CONTIG SUPERCLUSTER START STOP SIZE QUERY1_VARS QUERY2_VARS TRUTH1_VARS TRUTH2_VARS ORIG_ED SWAP_ED SC_PHASE PHASE_STATE PHASE_SET PHASE_BLOCK FLIP_ERROR",
    "phase-blocks": "CONTIG PHASE_BLOCK START STOP SIZE SUPERCLUSTERS FLIP_ERRORS SWITCH_ERRORS",
    "phasing-summary": "PHASE_BLOCKS SWITCH_ERRORS FLIP_ERRORS NG_50 SWITCH_NGC50 SWITCHFLIP_NGC50",
    "switchflips": "CONTIG START STOP SWITCH_TYPE SUPERCLUSTER PHASE_BLOCK",
    "distance": "MIN_QUAL SUB_DE INS_DE DEL_DE SUB_ED INS_ED DEL_ED DISTINCT_EDITS EDIT_DIST ALN_SCORE ALN_QSCORE",
    "distance-summary": "VAR_TYPE THRESHOLD MIN_QUAL EDIT_DIST DISTINCT_EDITS ED_QSCORE DE_QSCORE ALN_QSCORE",
    "edits": "CONTIG START HAP TYPE SIZE SUPERCLUSTER MIN_QUAL MAX_QUAL",
}
FORMATS = {"PREC": "%f", "RECALL": "%f", "F1_SCORE": "%f", "F1_QSCORE": "%f", "CREDIT": "%f", "QUAL": "%.2f", "ED_QSCORE": "%f", "DE_QSCORE": "%f", "ALN_QSCORE": "%f"}


def tsv_lines(table: DataFrame, name: str, order: list[str]) -> DataFrame:
    """(value): the lines of an output table, header first; columns by their names in the file."""
    cols = COLUMNS[name].split()
    cells = [F.format_string(FORMATS[c], F.col(c).cast("double")) if c in FORMATS else F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in cols]
    body = table.select(F.lit(1).alias("_h"), *[F.col(o).alias(f"_{i}") for i, o in enumerate(order)], F.concat_ws("\t", *cells).alias("value"))
    head = table.sparkSession.range(1).select(F.lit(0).alias("_h"), *[F.lit(None).alias(f"_{i}") for i in range(len(order))], F.lit("\t".join(cols)).alias("value"))
    return head.unionByName(body).orderBy("_h", *[F.asc_nulls_first(f"_{i}") for i in range(len(order))]).select("value")


def write_lines(lines: DataFrame, path: str) -> None:
    """One text file of the lines: Spark writes sorted parts, which are then joined by streaming them, in any of Spark's file systems."""
    spark, parts = lines.sparkSession, f"{path}.parts"
    lines.write.mode("overwrite").text(parts)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    folder, conf = fs_path(parts), spark._jsc.hadoopConfiguration()
    fs = folder.getFileSystem(conf)
    fs.delete(fs_path(path), False)
    out = fs.create(fs_path(path))
    try:
        for name in sorted(x.getPath().getName() for x in fs.listStatus(folder)):
            if name.startswith("part-"):
                part = fs.open(fs_path(f"{parts}/{name}"))
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
                part.close()
    finally:
        out.close()
    fs.delete(folder, True)
