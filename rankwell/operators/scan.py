"""Ordered scans without a window over all rows.

Rows are dealt by ranges of the sort keys, every partition is scanned on its own,
and what earlier partitions contribute comes from one row a partition.  The dealt
rows are persisted, so that both passes see the same partitions; lost blocks
are recomputed from the shuffle.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of dense positions.
BLOCK = 1 << 16
_OFFSET = (1 << 33) - 1
UPTO = Window.unboundedPreceding


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranged(df: DataFrame, *keys: str | Column) -> DataFrame:
    """``df`` by ranges of ``keys``, sorted within each, with partition number ``_p`` and place ``_i`` in it."""
    out = df.repartitionByRange(_parts(df), *keys).sortWithinPartitions(*keys)
    return out.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit(_OFFSET))).persist(StorageLevel.MEMORY_AND_DISK)


def dense_index(df: DataFrame, *keys: str | Column, name: str = "idx") -> DataFrame:
    """Adds each row's place in the order of ``keys``, from 0."""
    rows = ranged(df, *keys)
    before = Window.orderBy("_p").rowsBetween(UPTO, -1)  # one row a partition
    base = rows.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_p", "_base")
    return rows.join(F.broadcast(base), "_p").withColumn(name, (F.col("_base") + F.col("_i")).cast("long")).drop("_p", "_i", "_base")


def prefix_sums(df: DataFrame, value: str, *keys: str | Column, name: str = "before") -> DataFrame:
    """Adds the sum of ``value`` over all rows before, in the order of ``keys``."""
    rows = ranged(df, *keys)
    before = Window.orderBy("_p").rowsBetween(UPTO, -1)
    base = rows.groupBy("_p").agg(F.sum(value).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_p", "_base")
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_p").orderBy("_i").rowsBetween(UPTO, -1)), F.lit(0))
    return rows.withColumn("_in", inside).join(F.broadcast(base), "_p").withColumn(name, (F.col("_base") + F.col("_in")).cast("long")).drop("_p", "_i", "_in", "_base")


def block_sums(df: DataFrame, value: str, pos: str, name: str = "before", block: int = BLOCK) -> DataFrame:
    """As :func:`prefix_sums` where ``pos`` numbers the rows densely: blocks of positions need no ranges."""
    rows = df.withColumn("_b", F.expr(f"{pos} div {block}"))
    sums = rows.groupBy("_b").agg(F.sum(value).alias("_n"))  # one row a block
    # blocks of blocks, so that the window without partitions has one row in block * block positions
    sums = sums.withColumn("_g", F.expr(f"_b div {block}"))
    groups = sums.groupBy("_g").agg(F.sum("_n").alias("_m"))
    groups = groups.select("_g", F.coalesce(F.sum("_m").over(Window.orderBy("_g").rowsBetween(UPTO, -1)), F.lit(0)).alias("_far"))
    near = F.coalesce(F.sum("_n").over(Window.partitionBy("_g").orderBy("_b").rowsBetween(UPTO, -1)), F.lit(0))
    base = sums.withColumn("_near", near).join(groups, "_g").select("_b", (F.col("_far") + F.col("_near")).alias("_base"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_b").orderBy(pos).rowsBetween(UPTO, -1)), F.lit(0))
    return rows.withColumn("_in", inside).join(base, "_b").withColumn(name, (F.col("_base") + F.col("_in")).cast("long")).drop("_b", "_in", "_base")


def as_of(probes: DataFrame, probe: str, table: DataFrame, key: str, forward: bool, strict: bool = False) -> DataFrame:
    """Joins every probe with the nearest row of ``table`` at or after it (``forward``), or at or before it.

    ``key`` is unique in ``table``; null probes and probes with no such row get nulls.
    The table's columns come as the struct ``found``.
    """
    struct = F.struct(key, *[c for c in table.columns if c != key])
    kind = dict(table.dtypes)[key]
    sides = table.select(F.col(key).alias("_k"), struct.alias("_row"), F.lit(None).alias("_probe")).unionByName(
        probes.where(F.col(probe).isNotNull()).select(F.col(probe).cast(kind).alias("_k"), F.lit(None).alias("_row"), F.struct(*probes.columns).alias("_probe"))
    )
    # at equal keys the probe stands where the match must be visible to it
    side = F.col("_row").isNotNull().cast("int") if forward != strict else F.col("_probe").isNotNull().cast("int")
    rows = ranged(sides.withColumn("_side", side), "_k", "_side")
    if forward:
        # backwards: a frame that only grows is scanned once
        inside = F.last("_row", True).over(Window.partitionBy("_p").orderBy(F.desc("_i")).rowsBetween(UPTO, 0))
        ends = rows.groupBy("_p").agg(F.min("_row").alias("_e"))
        carried = F.first("_e", True).over(Window.orderBy("_p").rowsBetween(1, Window.unboundedFollowing))
    else:
        inside = F.last("_row", True).over(Window.partitionBy("_p").orderBy("_i").rowsBetween(UPTO, 0))
        ends = rows.groupBy("_p").agg(F.max("_row").alias("_e"))
        carried = F.last("_e", True).over(Window.orderBy("_p").rowsBetween(UPTO, -1))
    ends = ends.withColumn("_c", carried).select("_p", "_c")  # one row a partition
    found = rows.withColumn("_in", inside).where(F.col("_probe").isNotNull()).join(F.broadcast(ends), "_p", "left")
    found = found.select(*(F.col("_probe")[c].alias(c) for c in probes.columns), F.coalesce("_in", "_c").alias("found"))
    none = probes.where(F.col(probe).isNull()).withColumn("found", F.lit(None).cast(struct_type(table, key)))
    return found.unionByName(none)


def struct_type(table: DataFrame, key: str):
    return table.select(F.struct(key, *[c for c in table.columns if c != key]).alias("s")).schema["s"].dataType
