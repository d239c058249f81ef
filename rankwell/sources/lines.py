"""Sources and sinks: text lines (plain or compressed by extension), sequences, and saved structures."""

from __future__ import annotations

import json
from dataclasses import fields, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of every line; line ends, also of the two-character kind, are stripped; .gz, .bz2, .zst by extension."""
    return spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"))


def from_items(spark: SparkSession, items: list, schema: str) -> DataFrame:
    """(idx, ...) of items in memory, numbered in their order."""
    rows = [(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(items)]
    return spark.createDataFrame(rows, f"idx long, {schema}")


def synthetic(spark: SparkSession, n: int, kind: str = "uniform", top: int = 1 << 20, p: float = 0.5, seed: int = 0) -> DataFrame:
    """(key, value) for keys 0 to n - 1; values uniform below ``top``, geometric with ``p``, or with Zipf's exponent 1 + ``p``."""
    u = F.rand(seed)
    value = {
        "uniform": F.floor(u * top),
        "geometric": F.floor(F.log(F.lit(1.0) - u) / F.log(F.lit(1 - p))),
        "zipf": F.least(F.lit(float(top)), F.floor(F.pow(F.lit(1.0) - u, F.lit(-1 / p)))) - 1,
    }[kind]
    return spark.range(n).select(F.col("id").alias("key"), value.cast("long").alias("value"))


def save(structure, path: str) -> None:
    """Writes a structure's relations as Parquet, and its numbers as JSON beside them."""
    if not is_dataclass(structure):
        raise TypeError("not a structure")
    told = {"kind": type(structure).__name__}
    spark = None
    for f in fields(structure):
        v = getattr(structure, f.name)
        if isinstance(v, DataFrame):
            v.write.mode("overwrite").parquet(f"{path}/{f.name}")
            spark = v.sparkSession
        else:
            told[f.name] = v
    spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, kind: type, path: str):
    """Reads what :func:`save` wrote."""
    told = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if told.pop("kind") != kind.__name__:
        raise TypeError(f"{path} holds another structure")
    return kind(**{f.name: told[f.name] if f.name in told else spark.read.parquet(f"{path}/{f.name}") for f in fields(kind)})


def reservoir(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """A random sample of ``n`` rows."""
    return df.orderBy(F.rand(seed)).limit(n)
