"""Small helpers that several operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import drop_table, materialize, new_path, release, scratch_dir

__all__ = ["WORD", "bucket_of", "buckets_for", "drop_table", "join_small", "materialize", "n_words", "new_path", "release", "scratch_dir"]

#: A word: a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words of ``text``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def join_small(rows: DataFrame, table: DataFrame, on: Column, spread: Column, small: bool, how: str = "inner", salts: int = 32) -> DataFrame:
    """Joins ``rows`` with a ``table`` of unique keys: broadcast if that is ``small`` (its size checked by the caller);
    else salted, so that a key's rows, dealt by ``spread``, meet in ``salts`` places rather than one."""
    if small:
        return rows.join(F.broadcast(table), on, how)
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    table = table.withColumn("_place", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.join(table, on & (F.col("_salt") == F.col("_place")), how).drop("_salt", "_place")


def buckets_for(rows: int, size: int = 4096) -> int:
    """Number of hash buckets so that one holds about ``size`` rows, a power of two."""
    n = 1
    while n * size < rows:
        n *= 2
    return n


def bucket_of(h: Column, n: int) -> Column:
    """Bucket by the top bits of a 64-bit hash, so bucket order follows hash order."""
    bits = n.bit_length() - 1
    return (F.lit(0) if bits == 0 else F.shiftright(h, 64 - bits) + F.lit(n // 2)).cast("int")
