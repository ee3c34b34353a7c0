"""The incremental models as Structured Streaming jobs that can be run now and again."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan.sources.tables import append_new, upsert_latest


def read_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", per_trigger: int | None = None, **options: str) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema).options(**options)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.load(path)


def append_stream(stream: DataFrame, path: str, keys: Sequence[str], checkpoint: str, compute: Callable[[DataFrame], DataFrame] | None = None):
    """Append new keys of each batch to the table at ``path``. A batch that runs twice adds nothing the second time, so results are exactly once."""
    return stream.writeStream.foreachBatch(lambda df, _: append_new(df, path, keys, compute) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_stream(stream: DataFrame, path: str, keys: Sequence[str], checkpoint: str, latest: str):
    """Keep the latest row of each key in the table at ``path``, in whatever order rows come. Each batch rewrites the table."""
    return stream.writeStream.foreachBatch(lambda df, _: upsert_latest(df, path, keys, latest) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_within(stream: DataFrame, time: str, keys: Sequence[str], delay: str = "1 hour") -> DataFrame:
    """The first row of each key; state is kept as long as the watermark needs."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(stream: DataFrame, time: str, by: Sequence[str], width: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Rows per window and key; a window is final once the watermark has passed its end, and later rows are dropped."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    g = stream.withWatermark(time, delay).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n")
