"""Sorted string lists with rear coding, and lists behind an index map."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BuildError, NotMonotone
from ..functions import byte_lcp, vbyte_len
from .scan import dense_index


def _vbyte(v: int) -> bytes:
    """Bijective base 128: every continuation byte takes one off the rest."""
    out = [v & 127]
    v >>= 7
    while v:
        v -= 1
        out.append(128 | v & 127)
        v >>= 7
    return bytes(reversed(out))


def _read_vbyte(data: bytes, at: int) -> tuple[int, int]:
    b = data[at]
    v, at = b & 127, at + 1
    while b & 128:
        b = data[at]
        v, at = ((v + 1) << 7) | b & 127, at + 1
    return v, at


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def encode_block(strings: list[bytes]) -> bytes:
    """The first string whole; of others the suffix length, the bytes to drop from the one before, the suffix."""
    out, last = [], None
    for s in strings:
        if last is None:
            out.append(_vbyte(len(s)) + s)
        else:
            k = _shared(last, s)
            out.append(_vbyte(len(s) - k) + _vbyte(len(last) - k) + s[k:])
        last = s
    return b"".join(out)


def decode_block(data: bytes, n: int) -> list[bytes]:
    out, at = [], 0
    for i in range(n):
        size, at = _read_vbyte(data, at)
        head = b""
        if i:
            rear, at = _read_vbyte(data, at)
            head = out[-1][: len(out[-1]) - rear]
        out.append(head + data[at : at + size])
        at += size
    return out


@dataclass
class StringList:
    """Rows (idx, s); sorted lists also serve as dictionaries.  ``ratio``: strings a block."""

    rows: DataFrame
    n: int
    ratio: int = 4

    @classmethod
    def sorted(cls, df: DataFrame, col: str, ratio: int = 4) -> StringList:
        """All strings of ``col`` in byte order, repeats kept; nulls are refused."""
        if ratio <= 0:
            raise BuildError("the ratio must be positive")
        told = df.agg(F.count("*"), F.count(col)).first()
        if told[0] != told[1]:
            raise BuildError("strings must not be null")
        return cls(dense_index(df.select(F.col(col).alias("s")), "s").select("idx", "s"), told[0], ratio)

    @classmethod
    def from_indexed(cls, df: DataFrame, idx: str, col: str, ratio: int = 4, check_sorted: bool = True) -> StringList:
        """Rows that have their index, 0 to n - 1; refused if out of order."""
        if ratio <= 0:
            raise BuildError("the ratio must be positive")
        rows = df.select(F.col(idx).cast("long").alias("idx"), F.col(col).alias("s"))
        n = rows.count()
        if check_sorted:
            after = rows.select((F.col("idx") + 1).alias("idx"), F.col("s").alias("last"))
            if not rows.join(after, "idx").where("s < last").isEmpty():
                raise NotMonotone("strings are not sorted")
        return cls(rows, n, ratio)

    def get(self, probes: DataFrame, i: str) -> DataFrame:
        r = self.rows.select(F.col("idx").alias("_i"), "s")
        return probes.join(r, F.col(i) == F.col("_i"), "left").drop("_i")

    def index_of(self, probes: DataFrame, q: str) -> DataFrame:
        """Adds ``idx`` of the first string equal to ``q``; null if absent."""
        first = self.rows.groupBy(F.col("s").alias("_s")).agg(F.min("idx").alias("idx"))
        return probes.join(first, F.col(q) == F.col("_s"), "left").drop("_s")

    def contains(self, probes: DataFrame, q: str) -> DataFrame:
        return probes.join(self.rows.select(F.col("s").alias("_s")), F.col(q) == F.col("_s"), "left_semi")

    def scan(self, start: int = 0) -> DataFrame:
        return self.rows.where(F.col("idx") >= start).orderBy("idx")

    def prefixes(self) -> DataFrame:
        """(idx, s, last, lcp): bytes shared with the string before; 0 for the first."""
        after = self.rows.select((F.col("idx") + 1).alias("idx"), F.col("s").alias("last"))
        out = self.rows.join(after, "idx", "left")
        return out.withColumn("lcp", byte_lcp("last", "s"))

    def stats(self) -> DataFrame:
        """Strings, bytes, longest string, blocks, bytes of the code and the bytes that shared prefixes save."""
        size = F.octet_length("s").cast("long")
        head = F.col("idx") % self.ratio == 0
        last = F.coalesce(F.octet_length("last"), F.lit(0)).cast("long")
        kept = size - F.col("lcp")
        code = F.when(head, vbyte_len(size) + size).otherwise(vbyte_len(kept) + vbyte_len(last - F.col("lcp")) + kept)
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        return self.prefixes().agg(F.count("*").alias("strings"), total(size).alias("bytes"), F.coalesce(F.max(size), F.lit(0)).alias("longest"), total(head.cast("int")).alias("blocks"), total(code).alias("code_bytes"), total(F.when(~head, F.col("lcp")).otherwise(0)).alias("saved"))

    def encode(self) -> DataFrame:
        """(block, n, payload)."""
        ratio = self.ratio

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, []  # the block that a batch may end within

            def coded(done: list[tuple[int, list[bytes]]]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.int64()), pa.array([len(s) for _, s in done], pa.int32()), pa.array([encode_block(s) for _, s in done], pa.binary())], names=["block", "n", "payload"])

            for b in batches:
                done = []
                for block, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if block != at:
                        if held:
                            done.append((at, held))
                        at, held = block, []
                    held.append(s.encode() if isinstance(s, str) else s)
                yield coded(done)
            if held:
                yield coded([(at, held)])

        # ranges of blocks, each in order within its partition: one call a partition, not a block
        rows = self.rows.select(F.expr(f"idx div {ratio}").alias("block"), "s", "idx")
        rows = rows.repartitionByRange(int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block").sortWithinPartitions("idx")
        return rows.select("block", "s").mapInArrow(run, "block long, n int, payload binary")

    @staticmethod
    def decode(blocks: DataFrame, ratio: int, as_bytes: bool = False) -> DataFrame:
        """(idx, s) of encoded blocks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                idx, out = [], []
                for block, n, data in zip(*(c.to_pylist() for c in b.columns)):
                    out += decode_block(data, n)
                    idx += range(block * ratio, block * ratio + n)
                yield pa.RecordBatch.from_arrays([pa.array(idx, pa.int64()), pa.array(out, pa.binary())], names=["idx", "s"])

        out = blocks.select("block", "n", "payload").mapInArrow(run, "idx long, s binary")
        return out if as_bytes else out.withColumn("s", F.decode("s", "UTF-8"))


def mapped_get(strings: StringList, index_map: DataFrame, i: str, j: str) -> DataFrame:
    """A list behind a map i -> j: adds ``s`` of string j to every row of the map."""
    return strings.get(index_map, j)


def inverted(index_map: DataFrame, i: str, j: str) -> DataFrame:
    """The inverse of a permutation; refused if some index occurs twice."""
    if not index_map.groupBy(j).count().where("count > 1").isEmpty():
        raise BuildError("the map is not a permutation")
    return index_map.select(F.col(j).alias(i), F.col(i).alias(j))
