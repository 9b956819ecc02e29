"""The corpus pipeline: quality rules, near-dedup, substring dedup, PII removal, packing.

A stage's result is written before the next stage begins; the tables that a stage wrote on its way are removed
when the next one begins, unless its documents are read from them.
Every stage but the last returns the columns of its documents.  A stage treats rows with null or repeated ids
each as a document of its own, a null text as empty, and gives no rows for an empty table.  Of near-duplicates the
least id stays; of equal ids the first row read.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplospark.llm.common import remove_written, staged, unkeyed, written
from haplospark.llm.minhash import minhash_near_dedup
from haplospark.llm.packing import pack_documents
from haplospark.llm.pii import find_personal_data, redacted
from haplospark.llm.quality import quality_rules
from haplospark.llm.suffix_dedup import suffix_array_dedup

ORACLE_SQL = None  # thresholds, sampling and label models have no SQL form; tests compare with brute force


PASSAGE_BYTES = 256  # a repeat of over 50 words has as many bytes where words and their spaces have 5 on average, or more

_LEFT: list[str] = []  # what the last stage wrote on its way


def _stage(f):
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove_written(spark, _LEFT, docs)
        before = set(written())
        out = f(spark, docs, sf_dir)
        _LEFT[:] = [p for p in written() if p not in before]
        return out

    return run_stage


def _with_text(columns: list[str], text, value) -> list:
    """The columns of documents with a new text, and n_chars counted anew where there is such a column."""
    return [text.alias(c) if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else value(c).alias(c) for c in columns]


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where("kept").select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


@_stage
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the least id."""
    classes, keyed = minhash_near_dedup(docs)
    kept = classes.where("kept").select("row_id").hint("shuffle_merge")
    return unkeyed(keyed.join(kept, "row_id"), docs.columns)


@_stage
def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte ranges that repeat; characters that a cut would split go whole.

    All places of a repeat go, the first one too, as in the operator: which one came first is not known.  Ties need
    no rule therefore.  Near-duplicates have gone before, so what repeats is passages, not whole documents.
    """
    cut = suffix_array_dedup(docs, length=PASSAGE_BYTES)
    text = F.call_function("try_validate_utf8", F.col("kept").cast("string"))
    # only texts with a split character need the slower clean-up
    clean = F.coalesce(text, F.regexp_replace(F.call_function("make_valid_utf8", F.col("kept").cast("string")), "�", ""))
    return cut.select(*_with_text(docs.columns, clean, lambda c: F.col("doc_id" if c == "doc_id" else f"rest.`{c}`")))


@_stage
def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    found = find_personal_data(docs)
    text = redacted(F.coalesce(F.col("doc.text"), F.lit("")), F.col("spans"))
    return found.select(F.col("doc").alias("doc"), text.alias("clean")).select(*_with_text(docs.columns, F.col("clean"), lambda c: F.col(f"doc.`{c}`")))


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("quality_rules", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("suffix_array_dedup", substring_dedup_stage),
    ("weak_supervision_pii", pii_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
