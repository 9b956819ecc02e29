"""Sessions over event time, in batch or streaming (an extension: the coordinate clusters' analogue in time)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str, key: str = "user_id", time: str = "ts") -> DataFrame:
    """(key, session_start, n): events of a key closer than the gap belong together."""
    at = F.col(time) if events.schema[time].dataType.typeName() == "timestamp" else F.col(time).cast("timestamp")  # a cast would lose the watermark
    w = F.session_window(at, gap)
    out = events.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")


def session_stream(spark: SparkSession, path: str, schema, gap: str, late: str = "1 day", key: str = "user_id", time: str = "ts") -> DataFrame:
    """The same over a growing folder of Parquet files; sessions close once the watermark has passed them."""
    read = spark.readStream.schema(schema).parquet(path).withColumn(time, F.col(time).cast("timestamp"))
    return sessions(read.withWatermark(time, late), gap, key, time)
