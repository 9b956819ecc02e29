"""Helpers shared by the training-data operators: shared-folder tables, row keys, Arrow text access."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or (only where unset) a local one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="haplospark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/haplospark/{name}-{uuid.uuid4().hex}"


_WRITTEN: list[str] = []  # tables written in this process, until they are removed
_NAMED: dict[str, str] = {}  # names in the catalog of those that are bucketed, by path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, stage_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(schema).parquet(path)
    out._stage_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    if path in _NAMED:
        spark.sql(f"DROP TABLE IF EXISTS {_NAMED.pop(path)}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def written() -> list[str]:
    """Paths of the tables written so far and not removed."""
    return list(_WRITTEN)


def remove_written(spark: SparkSession, paths: list[str], used_by: DataFrame) -> None:
    """Remove those tables that `used_by` doesn't read."""
    files = used_by.inputFiles() if paths else []
    name = lambda p: p.rsplit("/", 1)[-1]  # noqa: E731  names are unique, schemes and authorities may differ
    for path in paths:
        if path in _WRITTEN and not any(name(path) in f for f in files):
            _remove(spark, path)


def unstage(*frames: DataFrame) -> None:
    """Remove staged tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_stage_path", None)
        if path:
            _remove(df.sparkSession, path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that are no longer held, rather than when memory happens to run low."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Hand Python at most 8 MB or 2,000 rows at a time, whatever the texts; only where no less is set."""
    for key, most in (("maxBytesPerBatch", 8 << 20), ("maxRecordsPerBatch", 2000)):
        key = f"spark.sql.execution.arrow.{key}"
        now = "".join(c for c in spark.conf.get(key) if c.isdigit() or c == "-")
        if not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


#: What operators keep in a worker from task to task: module and cached function.
_KEPT = {"packing": "word_bpe", "minhash": "_worker_hasher"}


def release(keep: str = "") -> None:
    """Drop what other operators than `keep` have kept in this worker, and give freed memory back to the system."""
    for module, name in _KEPT.items():
        loaded = sys.modules.get(f"haplospark.llm.{module}")
        if module != keep and loaded is not None:
            getattr(loaded, name).cache_clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than GNU's
        pass


def released(f, keep: str = ""):
    """f over batches, with release() before the first and after the last: workers live on through other stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(keep)
        yield from f(batches)
        release(keep)

    return run


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Write df once, hashed into buckets by key, so that later joins on key move only their other side."""
    spark, n = df.sparkSession, shuffle_parts(df.sparkSession)
    path, table = stage_path(spark, name), f"haplospark_{name}_{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    _NAMED[path] = table
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).saveAsTable(table, format="parquet")
    out = spark.table(table)
    out._stage_path = path
    return out


def keyed_texts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rest: bool = False) -> DataFrame:
    """(row_id, doc_id, text) with a row key of its own, so null or repeated ids stay separate rows.

    rest adds the other columns as one struct, whatever their names.
    """
    others = [c for c in docs.columns if c not in (text_col, id_col)]
    more = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest")] if rest and others else []
    return docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *more)


def unkeyed(rows: DataFrame, columns: list[str], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Back from keyed_texts(rest=True) to the columns the documents had, in their order."""
    of = {text_col: "text", id_col: "doc_id"}
    return rows.select(*[F.col(of[c] if c in of else f"rest.`{c}`").alias(c) for c in columns])


def binary_parts(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets and bytes of a string or binary Arrow array; a null entry is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return offsets.astype(np.int64), memoryview(data) if data is not None else memoryview(b"")


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most so many rows, to bound what one step holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
