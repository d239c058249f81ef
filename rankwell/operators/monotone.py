"""Monotone sequences: access, reverse lookup, successors, predecessors, ranks and cursors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BuildError, NotMonotone, ValueTooLarge
from ..functions import low_bits, shift_right
from .scan import as_of, prefix_sums


@dataclass
class MonotoneSeq:
    """A non-decreasing sequence as one row per distinct value: (value, first, last) index.

    Of equal values a successor is the first, a predecessor the last.
    """

    runs: DataFrame
    n: int
    upper: int

    @classmethod
    def from_values(cls, df: DataFrame, col: str, upper: int | None = None) -> MonotoneSeq:
        """Values in any order; sorted here.  Null and negative values, and values over ``upper``, are refused."""
        told = df.agg(F.count("*").alias("n"), F.count(col).alias("some"), F.min(col).alias("low"), F.max(col).alias("high")).first()
        if told["n"] != told["some"] or told["n"] and told["low"] < 0:
            raise BuildError("values must be non-negative integers")
        high = told["high"] if told["n"] else 0
        if upper is not None and high > upper:
            raise ValueTooLarge(f"value {high} exceeds the upper bound {upper}")
        counts = df.groupBy(F.col(col).cast("long").alias("value")).agg(F.count("*").alias("n"))
        runs = prefix_sums(counts, "n", "value", name="first")
        return cls(runs.select("value", "first", (F.col("first") + F.col("n") - 1).alias("last")), told["n"], high if upper is None else upper)

    @classmethod
    def from_indexed(cls, df: DataFrame, idx: str, col: str, n: int, upper: int) -> MonotoneSeq:
        """Rows (idx, value) in any order, as a concurrent builder gets them; checked for count, bound and order."""
        runs = df.groupBy(F.col(col).cast("long").alias("value")).agg(F.count("*").alias("n"), F.min(idx).alias("first"), F.max(idx).alias("last"))
        told = df.agg(F.count("*"), F.countDistinct(idx), F.min(idx), F.max(idx), F.max(col), F.min(col)).first()
        if told[0] != n or n and (told[1] != n or told[2] != 0 or told[3] != n - 1):
            raise BuildError(f"{told[0]} values given, {n} expected at indices 0 to {n - 1}")
        if n and told[4] > upper:
            raise ValueTooLarge(f"value {told[4]} exceeds the upper bound {upper}")
        order = prefix_sums(runs, "n", "value", name="due")
        if n and (told[5] < 0 or not order.where("first != due or last != due + n - 1").isEmpty()):
            raise NotMonotone("values are not monotone")
        return cls(runs.select("value", "first", "last"), n, upper)

    def rows(self) -> DataFrame:
        """(idx, value) of every element."""
        return self.runs.select(F.explode(F.sequence("first", "last")).alias("idx"), "value")

    def get(self, probes: DataFrame, i: str) -> DataFrame:
        """Adds ``value`` of index ``i``; null outside the sequence."""
        found = as_of(probes, i, self.runs.select("first", "value", "last"), "first", forward=False)
        return found.select(*probes.columns, F.when((F.col(i) >= 0) & (F.col(i) <= F.col("found.last")), F.col("found.value")).alias("value"))

    def index_of(self, probes: DataFrame, q: str) -> DataFrame:
        """Adds ``idx``, the first index of value ``q``; null if absent."""
        runs = self.runs.select(F.col("value").alias("_v"), F.col("first").alias("idx"))
        return probes.join(runs, F.col(q) == F.col("_v"), "left").drop("_v")

    def contains(self, probes: DataFrame, q: str) -> DataFrame:
        """The probes whose value occurs."""
        return probes.join(self.runs.select(F.col("value").alias("_v")), F.col(q) == F.col("_v"), "left_semi")

    def succ(self, probes: DataFrame, q: str, strict: bool = False) -> DataFrame:
        """Adds (idx, value) of the least element at or after (after) ``q``."""
        found = as_of(probes, q, self.runs, "value", forward=True, strict=strict)
        return found.select(*probes.columns, F.col("found.first").alias("idx"), F.col("found.value").alias("value"))

    def pred(self, probes: DataFrame, q: str, strict: bool = False) -> DataFrame:
        """Adds (idx, value) of the greatest element at or before (before) ``q``."""
        found = as_of(probes, q, self.runs, "value", forward=False, strict=strict)
        return found.select(*probes.columns, F.col("found.last").alias("idx"), F.col("found.value").alias("value"))

    def rank(self, probes: DataFrame, q: str) -> DataFrame:
        """Adds ``rank``: how many elements are less than ``q``."""
        below = self.pred(probes, q, strict=True)
        return below.select(*probes.columns, F.coalesce(F.col("idx") + 1, F.lit(0)).alias("rank"))

    def cursor(self, probes: DataFrame, start: str, k: int, backward: bool = False) -> DataFrame:
        """Up to ``k`` elements a probe, from index ``start`` on, or before and not including it: step, idx, value."""
        s = F.col(start)
        steps = F.sequence(F.lit(0), F.lit(k - 1))
        at = probes.where(s.isNotNull()).withColumn("step", F.explode(steps)).withColumn("step", F.col("step").cast("long"))
        at = at.withColumn("idx", s - 1 - F.col("step") if backward else s + F.col("step")).where((F.col("idx") >= 0) & (F.col("idx") < self.n))
        return self.get(at, "idx")

    def first_last(self) -> DataFrame:
        return self.runs.agg(F.min("value").alias("first_value"), F.max("value").alias("last_value"))

    @property
    def low_width(self) -> int:
        """Low bits of an element's split: floor(log2(upper / n)), 0 if that is negative."""
        return max(0, (self.upper // self.n).bit_length() - 1) if self.n else 0

    def split(self) -> DataFrame:
        """(idx, low, high_pos): low bits, and the place of the bit for the high part."""
        w = self.low_width
        v = F.col("value")
        return self.rows().select("idx", low_bits(v, w).alias("low"), (shift_right(v, F.lit(w)) + F.col("idx")).alias("high_pos"))

    def estimated_bits(self) -> int:
        """2n + n * ceil(log2(upper / n)); 0 if empty."""
        if not self.n:
            return 0
        ratio, w = self.upper / self.n, 0
        while (1 << w) < ratio:
            w += 1
        return self.n * (2 + w)
