"""Streams against static structures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_lookup(stream: DataFrame, q: str, table: DataFrame, key: str) -> DataFrame:
    """Each row of a stream with the row of a static table that has its key; nulls for unknown keys."""
    return stream.join(table, stream[q] == table[key], "left").drop(table[key])


def stream_filter(stream: DataFrame, q: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows of a stream whose key is in a static set."""
    return stream.join(keys.select(F.col(key).alias("_k")), F.col(q) == F.col("_k"), "left_semi")


def windowed_counts(stream: DataFrame, ts: str, by: str, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Rows per window and value; rows later than ``late`` behind the watermark are left out."""
    w = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, size), by).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), by, "n")
