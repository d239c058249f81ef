"""Integer lists with variable widths, prefix sums, and partial arrays."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BuildError, NotMonotone
from ..functions import floor_log2
from .scan import block_sums


@dataclass
class CompactList:
    """Rows (idx, val), val >= low; an element takes floor(log2(val - low + 1)) bits."""

    rows: DataFrame
    low: int
    n: int

    @classmethod
    def build(cls, df: DataFrame, idx: str, val: str, low: int) -> CompactList:
        told = df.agg(F.count("*"), F.min(val), F.max(val)).first()
        if told[0] and (told[1] < low or told[2] - low >= (1 << 63) - 1):
            raise BuildError(f"values must be {low} at least, and the largest 64-bit integer is excluded")
        return cls(df.select(F.col(idx).cast("long").alias("idx"), F.col(val).cast("long").alias("val")), low, told[0])

    def delimiters(self) -> DataFrame:
        """(idx, begin) of every element, and the end at index n."""
        return _with_end(self.rows.withColumn("w", floor_log2(F.col("val") - self.low + 1)), "w", self.n, "begin")

    def get(self, probes: DataFrame, i: str) -> DataFrame:
        r = self.rows.select(F.col("idx").alias("_i"), "val")
        return probes.join(r, F.col(i) == F.col("_i"), "left").drop("_i")


def _with_end(rows: DataFrame, value: str, n: int, name: str) -> DataFrame:
    all_ = rows.select("idx", F.col(value).alias("_v")).unionByName(rows.sparkSession.createDataFrame([(n, 0)], "idx long, _v long"))
    return block_sums(all_, "_v", "idx", name=name).select("idx", name)


@dataclass
class PrefixSumList:
    """Non-negative rows (idx, val) behind their prefix sums (idx, sum), idx 0 to n."""

    sums: DataFrame
    n: int

    @classmethod
    def build(cls, df: DataFrame, idx: str, val: str) -> PrefixSumList:
        told = df.agg(F.count("*"), F.min(val)).first()
        if told[0] and told[1] < 0:
            raise BuildError("values must not be negative")
        return cls(_with_end(df.select(F.col(idx).cast("long").alias("idx"), F.col(val).cast("long").alias("v")), "v", told[0], "sum"), told[0])

    @classmethod
    def from_sums(cls, df: DataFrame, idx: str, sums: str) -> PrefixSumList:
        """Sums that are given; the first must be 0 and none less than the one before."""
        rows = df.select(F.col(idx).cast("long").alias("idx"), F.col(sums).cast("long").alias("sum"))
        n = rows.count()
        if not n or rows.where("idx = 0 and sum = 0").isEmpty():
            raise BuildError("the first prefix sum must be 0")
        after = rows.select((F.col("idx") + 1).alias("idx"), F.col("sum").alias("last"))
        if not rows.join(after, "idx").where("sum < last").isEmpty():
            raise NotMonotone("prefix sums decrease")
        return cls(rows, n - 1)

    def prefix_sum(self, probes: DataFrame, i: str) -> DataFrame:
        r = self.sums.select(F.col("idx").alias("_i"), F.col("sum").alias("prefix_sum"))
        return probes.join(r, F.col(i) == F.col("_i"), "left").drop("_i")

    def get(self, probes: DataFrame, i: str) -> DataFrame:
        """Differences of neighbouring sums."""
        a = self.sums.select(F.col("idx").alias("_i"), F.col("sum").alias("_a"))
        b = self.sums.select((F.col("idx") - 1).alias("_i"), F.col("sum").alias("_b"))
        r = a.join(b, "_i").select("_i", (F.col("_b") - F.col("_a")).alias("val"))
        return probes.join(r, F.col(i) == F.col("_i"), "left").drop("_i")


@dataclass
class PartialArray:
    """Values (pos, v) at some of ``length`` positions."""

    rows: DataFrame
    length: int

    @classmethod
    def build(cls, df: DataFrame, pos: str, v: str, length: int, n: int | None = None) -> PartialArray:
        """``n``: how many values are declared (sparse form)."""
        told = df.agg(F.count("*"), F.countDistinct(pos), F.min(pos), F.max(pos)).first()
        if told[0] and (told[1] != told[0] or told[2] < 0 or told[3] >= length):
            raise BuildError("positions must be distinct and within the array")
        if n is not None and (n > length or n != told[0]):
            raise BuildError(f"{n} values declared, {told[0]} given, length {length}")
        return cls(df.select(F.col(pos).cast("long").alias("pos"), F.col(v).alias("v")), length)

    def get(self, probes: DataFrame, pos: str) -> DataFrame:
        """Adds ``v``, null where there is none; positions outside raise."""
        r = self.rows.withColumnRenamed("pos", "_p")
        out = probes.join(r, F.col(pos) == F.col("_p"), "left").drop("_p")
        ok = (F.col(pos) >= 0) & (F.col(pos) < self.length)
        return out.withColumn("v", F.when(ok, F.col("v")).otherwise(F.raise_error(F.lit("position outside the array")).cast(dict(self.rows.dtypes)["v"])))
