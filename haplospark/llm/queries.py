"""The registered queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from haplospark.llm.common import remove_written, staged, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haplospark.llm.sentence_dedup import sentence_span_dedup

    return sentence_span_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_sentences", "n_removed", "kept_sha256")


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haplospark.llm.ann import nearest_rows

    return nearest_rows(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), every=50, k=5)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from haplospark.llm.sentencepieces import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), check=True)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haplospark.llm.suffix_dedup import suffix_array_dedup

    return suffix_array_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op1_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from haplospark.llm.pii import BASE, find_personal_data, span_list

    found = find_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)

    def count(k):
        return F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return found.select("doc.doc_id", *counts, F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from haplospark.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


def op7_gru_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from haplospark.llm.langid import held_out, identify_language, train_language_model

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    model = train_language_model(docs.where("not held_out").select("text", "lang"))
    return identify_language(docs, model, carry=("doc_id", "held_out"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haplospark.llm.minhash import minhash_near_dedup

    return minhash_near_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))[0].select("doc_id", "class_id", "kept")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haplospark.llm.quality import quality_rules

    docs = _table(spark, sf_dir, "documents")
    return quality_rules(docs.select("doc_id", "lang", "text"), _table(spark, sf_dir, "labels"), measures_only=True).select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_weak_supervision_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from haplospark.llm.langid import held_out
    from haplospark.llm.toxicity import score_toxicity, train_toxicity

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id"), 3, 1))
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    # labels grow with the corpus: no broadcast at any size
    model = train_toxicity(docs.where("not held_out").join(labels.hint("shuffle_merge"), "doc_id").select("text", "toxic"))
    return score_toxicity(docs, model, carry=("doc_id", "held_out"))


def _tidy(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """f, with its result written where it wrote tables on its way, so that those can go at once."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        before = set(written())
        out = f(spark, sf_dir)
        left = [p for p in written() if p not in before]
        if left:
            out = staged(out, "result")
            remove_written(spark, left, out)
        return out

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _tidy(f) for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from haplospark.llm.sql import ORACLE

    return dict(ORACLE)
