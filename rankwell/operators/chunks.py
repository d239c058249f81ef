"""Fair chunks: consecutive ranges of about a target weight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .scan import as_of, block_sums


def next_bounds(df: DataFrame, idx: str, weight: str, target: int) -> tuple[DataFrame, int]:
    """(lo, hi) for every index: the least bound whose weight before it reaches that of lo plus ``target``; and n."""
    n = df.count()
    rows = df.select(F.col(idx).cast("long").alias("idx"), F.col(weight).cast("long").alias("w"))
    rows = rows.unionByName(df.sparkSession.createDataFrame([(n, 0)], "idx long, w long"))
    cum = block_sums(rows, "w", "idx", name="cum")
    first = cum.groupBy("cum").agg(F.min("idx").alias("at"))
    found = as_of(cum.select("idx", (F.col("cum") + target).alias("goal")), "goal", first, "cum", forward=True)
    return found.select(F.col("idx").alias("lo"), F.coalesce("found.at", F.lit(n)).alias("hi")), n


def fair_chunks(df: DataFrame, idx: str, weight: str, target: int) -> DataFrame:
    """(chunk, lo, hi): ranges [lo, hi) in order; the last takes the rest; none if the target is 0.

    Each bound depends on the one before, so bounds are followed by pointer
    doubling over the next-bound relation: a logarithmic number of joins.
    """
    spark = df.sparkSession
    schema = "chunk long, lo long, hi long"
    if target <= 0:
        return spark.createDataFrame([], schema)
    bounds, n = next_bounds(df, idx, weight, target)
    if not n:
        return spark.createDataFrame([], schema)
    # every round is written, else the plans would double with the jumps
    step = materialize(bounds.where(F.col("lo") < n), "chunk-jumps")
    reached, jump, size = spark.createDataFrame([(0, 0)], "chunk long, lo long"), step, 1
    while True:
        # chunks 0 .. size - 1 are known; jump leads size chunks on
        more = reached.join(jump, "lo").select((F.col("chunk") + size).alias("chunk"), F.col("hi").alias("lo")).where(F.col("lo") < n)
        more = materialize(more, "chunks")
        if more.isEmpty():
            break
        reached = reached.unionByName(more)
        far = jump.select(F.col("lo").alias("a"), F.col("hi").alias("lo")).join(jump.select("lo", "hi"), "lo").select(F.col("a").alias("lo"), "hi")
        jump, size = materialize(far, "chunk-jumps"), 2 * size
    return reached.join(step, "lo").select("chunk", "lo", "hi")
