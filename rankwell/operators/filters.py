"""Static filters: exact, and with b-bit fingerprints (no false negatives, false positives about 2^-b)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BuildError
from ..functions import fingerprint


def contains(keys: DataFrame, key: str, probes: DataFrame, q: str) -> DataFrame:
    """The probes among the keys."""
    return probes.join(keys.select(F.col(key).alias("_k")), F.col(q) == F.col("_k"), "left_semi")


def absent(keys: DataFrame, key: str, probes: DataFrame, q: str) -> DataFrame:
    """The probes that are none of the keys; null probes are none."""
    return probes.join(keys.select(F.col(key).alias("_k")), F.col(q) == F.col("_k"), "left_anti")


@dataclass
class FingerprintFilter:
    """One b-bit fingerprint for each key, in a slot by another hash; slots hold one key on average."""

    table: DataFrame  # slot, fp
    slots: int
    bits: int
    seed: int = 0

    @classmethod
    def build(cls, df: DataFrame, key: str, bits: int = 8, seed: int = 0) -> FingerprintFilter:
        if not 1 <= bits <= 64:
            raise BuildError("a fingerprint has 1 to 64 bits")
        n = max(1, df.count())
        return cls(df.select(cls._slot(F.col(key), n, seed).alias("slot"), fingerprint(F.col(key), bits, seed).alias("fp")).distinct(), n, bits, seed)

    @staticmethod
    def _slot(key, n: int, seed: int):
        return F.pmod(F.xxhash64(F.lit(seed + 1), key), F.lit(n))

    def contains(self, probes: DataFrame, q: str) -> DataFrame:
        found = self.table.withColumnsRenamed({"slot": "_s", "fp": "_f"})
        return probes.join(found, (self._slot(F.col(q), self.slots, self.seed) == F.col("_s")) & (fingerprint(F.col(q), self.bits, self.seed) == F.col("_f")), "left_semi")
