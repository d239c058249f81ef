"""Bit vectors: rows (pos, bit), packed words, edits, and rank and select on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import low_bits, mask, ones_in_word, rank_in_word, select_in_word, shift_left, shift_right
from .scan import as_of, block_sums


@dataclass
class BitVector:
    """Packed words (word_idx, word) of ``length`` bits, the lowest bit first; absent words are zero."""

    words: DataFrame
    length: int

    @classmethod
    def from_bits(cls, df: DataFrame, pos: str, bit: str, length: int | None = None) -> BitVector:
        n = length if length is not None else (df.agg(F.max(pos)).first()[0] if df.head(1) else -1) + 1
        one = F.when(F.col(bit), shift_left(F.lit(1), F.col(pos) % 64)).otherwise(F.lit(0))
        words = df.groupBy(F.expr(f"{pos} div 64").alias("word_idx")).agg(F.bit_or(one).alias("word"))
        return cls(words, n)

    @classmethod
    def filled(cls, spark, length: int, value: bool) -> BitVector:
        left = F.lit(length) - F.col("id") * 64
        word = mask(F.least(F.lit(64), left)) if value else F.lit(0).cast("long")
        return cls(spark.range(-(-length // 64)).select(F.col("id").alias("word_idx"), word.alias("word")), length)

    def bits(self) -> DataFrame:
        """(pos, bit) of every position within stored words."""
        out = self.words.select("word_idx", "word", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
        return out.select((F.col("word_idx") * 64 + F.col("i")).alias("pos"), (F.getbit("word", "i") == 1).alias("bit")).where(F.col("pos") < self.length)

    def _set(self, word) -> DataFrame:
        """(pos) of the set bits of ``word``, an expression over each stored word; other bits make no rows."""
        out = self.words.select("word_idx", F.explode(ones_in_word(word)).alias("i"))
        return out.select((F.col("word_idx") * 64 + F.col("i")).alias("pos")).where(F.col("pos") < self.length)

    def ones(self) -> DataFrame:
        return self._set(F.col("word"))

    def zeros(self) -> DataFrame:
        return self._set(F.bitwise_not("word"))

    def count_zeros(self) -> DataFrame:
        return self.count_ones().select((F.lit(self.length) - F.col("ones")).cast("long").alias("zeros"))

    def trimmed(self, length: int | None = None) -> BitVector:
        """The first ``length`` bits; only the last word changes."""
        n = self.length if length is None else min(length, self.length)
        left = F.lit(n) - F.col("word_idx") * 64
        kept = self.words.where(left > 0)
        return BitVector(kept.select("word_idx", F.when(left < 64, low_bits(F.col("word"), left)).otherwise(F.col("word")).alias("word")), n)

    def count_ones(self) -> DataFrame:
        return self.words.agg(F.coalesce(F.sum(F.bit_count("word")), F.lit(0)).cast("long").alias("ones"))

    def get(self, probes: DataFrame, pos: str) -> DataFrame:
        """Adds ``bit``; null outside the vector."""
        out = probes.join(self.words, F.expr(f"{pos} div 64") == F.col("word_idx"), "left")
        inside = (F.col(pos) >= 0) & (F.col(pos) < self.length)
        return out.select(*probes.columns, F.when(inside, F.getbit(F.coalesce("word", F.lit(0).cast("long")), (F.col(pos) % 64).cast("int")) == 1).alias("bit"))

    def get_bits(self, probes: DataFrame, pos: str, width: str) -> DataFrame:
        """Adds ``value``: ``width`` (0 to 64) bits from ``pos`` on, the first lowest."""
        w0, w1 = (self.words.select(F.col("word_idx").alias(f"_k{i}"), F.col("word").alias(f"_w{i}")) for i in (0, 1))
        at = F.expr(f"{pos} div 64")
        out = probes.join(w0, at == F.col("_k0"), "left").join(w1, at + 1 == F.col("_k1"), "left")
        o = F.col(pos) % 64
        lo, hi = (F.coalesce(c, F.lit(0).cast("long")) for c in ("_w0", "_w1"))
        value = low_bits(shift_right(lo, o).bitwiseOR(shift_left(hi, 64 - o)), F.col(width))
        return out.select(*probes.columns, F.when((F.col(pos) >= 0) & (F.col(pos) + F.col(width) <= self.length), value).alias("value"))

    def flip(self) -> BitVector:
        left = F.lit(self.length) - F.col("word_idx") * 64
        return BitVector(self.full().words.select("word_idx", F.bitwise_not("word").bitwiseAND(mask(F.least(F.lit(64), left))).alias("word")), self.length)

    def full(self) -> BitVector:
        """With a row for every word."""
        all_ = self.words.sparkSession.range(-(-self.length // 64)).select(F.col("id").alias("word_idx"))
        return BitVector(all_.join(self.words, "word_idx", "left").select("word_idx", F.coalesce("word", F.lit(0).cast("long")).alias("word")), self.length)

    def set(self, edits: DataFrame, pos: str, bit: str) -> BitVector:
        """Overwrites positions (one edit each)."""
        one = shift_left(F.lit(1), F.col(pos) % 64)
        masks = edits.groupBy(F.expr(f"{pos} div 64").alias("word_idx")).agg(F.bit_or(one).alias("_m"), F.bit_or(F.when(F.col(bit), one).otherwise(F.lit(0))).alias("_v"))
        out = self.words.join(masks, "word_idx", "full").withColumn("_m", F.coalesce("_m", F.lit(0).cast("long")))
        word = F.coalesce("word", F.lit(0).cast("long")).bitwiseAND(F.bitwise_not("_m")).bitwiseOR(F.coalesce("_v", F.lit(0).cast("long")))
        return BitVector(out.select("word_idx", word.alias("word")), self.length)

    def append(self, other: BitVector) -> BitVector:
        """Whole words move, each into the one or two words that it covers here."""
        words, off = other.trimmed().words, self.length % 64
        at = F.col("word_idx") + self.length // 64
        out = self.trimmed().words.unionByName(words.select(at.alias("word_idx"), shift_left(F.col("word"), F.lit(off)).alias("word")))
        if off:
            out = out.unionByName(words.select((at + 1).alias("word_idx"), shift_right(F.col("word"), F.lit(64 - off)).alias("word")))
        n = self.length + other.length
        return BitVector(out.groupBy("word_idx").agg(F.bit_or("word").alias("word")).where(F.col("word_idx") * 64 < n), n)

    def append_value(self, value: int, width: int) -> BitVector:
        """The lowest ``width`` (up to 64) bits of ``value``."""
        value &= (1 << width) - 1
        word = value - (1 << 64) if value >> 63 else value
        return self.append(BitVector(self.words.sparkSession.createDataFrame([(0, word)], "word_idx long, word long"), width))

    def resize(self, length: int, value: bool = False) -> BitVector:
        if length <= self.length:
            return self.trimmed(length)
        return self.append(BitVector.filled(self.words.sparkSession, length - self.length, value))

    def push(self, bit: bool) -> BitVector:
        return self.resize(self.length + 1, bit)

    def pop(self) -> BitVector:
        return self.resize(max(0, self.length - 1))

    def equals(self, other: BitVector) -> bool:
        """Same length and bits; bits past the length don't count."""
        if self.length != other.length:
            return False
        a, b = (v.trimmed().words.where("word != 0") for v in (self, other))
        both = a.join(b.select(F.col("word_idx").alias("w"), F.col("word").alias("x")), F.col("word_idx") == F.col("w"), "full")
        return both.where("word is distinct from x").isEmpty()

    def chunks(self, bits: int) -> DataFrame:
        """(chunk, pos, bit): disjoint chunks of a multiple of 64 bits."""
        if bits <= 0 or bits % 64:
            raise ValueError("a chunk must be a positive multiple of 64 bits")
        return self.bits().withColumn("chunk", F.expr(f"pos div {bits}"))


@dataclass
class RankSelect:
    """Counts before every word, for ranks and selections in both bit values."""

    words: DataFrame
    length: int
    num_ones: int

    @classmethod
    def build(cls, v: BitVector) -> RankSelect:
        w = v.full().words.withColumn("n", F.bit_count("word").cast("long"))
        counted = block_sums(w, "n", "word_idx", name="ones")
        return cls(counted, v.length, v.count_ones().first()[0])

    def rank(self, probes: DataFrame, pos: str) -> DataFrame:
        """Adds ``rank``: set bits before ``pos``; all from the end on."""
        out = probes.join(self.words, F.expr(f"{pos} div 64") == F.col("word_idx"), "left")
        r = F.col("ones") + rank_in_word(F.col("word"), F.col(pos) % 64)
        return out.select(*probes.columns, F.when(F.col(pos) >= self.length, F.lit(self.num_ones)).otherwise(r).cast("long").alias("rank"))

    def rank_zero(self, probes: DataFrame, pos: str) -> DataFrame:
        """Adds ``rank``: pos - rank(pos), also past the end."""
        return self.rank(probes, pos).withColumn("rank", F.col(pos) - F.col("rank"))

    def _select(self, probes: DataFrame, rank: str, table: DataFrame, n: int) -> DataFrame:
        found = as_of(probes, rank, table, "before", forward=False)
        pos = F.col("found.word_idx") * 64 + select_in_word(F.col("found.word"), F.col(rank) - F.col("found.before"))
        return found.select(*probes.columns, F.when((F.col(rank) >= 0) & (F.col(rank) < n), pos).alias("pos"))

    def select(self, probes: DataFrame, rank: str) -> DataFrame:
        """Adds ``pos`` of the rank-th set bit, from 0; null if there are fewer."""
        return self._select(probes, rank, self.words.where("n > 0").select(F.col("ones").alias("before"), "word_idx", "word"), self.num_ones)

    def select_zero(self, probes: DataFrame, rank: str) -> DataFrame:
        size = F.least(F.lit(64), F.lit(self.length) - F.col("word_idx") * 64)
        z = self.words.select((F.col("word_idx") * 64 - F.col("ones")).alias("before"), "word_idx", F.bitwise_not("word").bitwiseAND(mask(size)).alias("word"))
        return self._select(probes, rank, z.where("word != 0"), self.length - self.num_ones)


@dataclass
class FieldVector:
    """Unsigned integers of ``width`` bits as rows (idx, val)."""

    rows: DataFrame
    width: int
    length: int

    @classmethod
    def from_slice(cls, df: DataFrame, idx: str, val: str) -> FieldVector:
        """Width: bits of the largest value; 1 if all are 0, 0 if there are none."""
        told = df.agg(F.count("*"), F.max(val)).first()
        return cls(df.select(F.col(idx).alias("idx"), F.col(val).cast("long").alias("val")), max(1, int(told[1]).bit_length()) if told[0] else 0, told[0])

    @classmethod
    def zeros(cls, spark, width: int, length: int) -> FieldVector:
        """``length`` elements of ``width`` bits, all 0."""
        return cls(spark.range(length).select(F.col("id").alias("idx"), F.lit(0).cast("long").alias("val")), width, length)

    def slice(self, start: int, end: int) -> FieldVector:
        """Elements start to end - 1, numbered from 0."""
        if not 0 <= start <= end <= self.length:
            raise ValueError("the slice leaves the vector")
        part = self.rows.where((F.col("idx") >= start) & (F.col("idx") < end))
        return FieldVector(part.select((F.col("idx") - start).alias("idx"), "val"), self.width, end - start)

    def chunks(self, size: int) -> DataFrame:
        """(chunk, idx, val): disjoint chunks of ``size`` elements that fill whole words."""
        if size <= 0 or size * self.width % 64:
            raise ValueError("a chunk must fill whole words")
        return self.rows.withColumn("chunk", F.expr(f"idx div {size}"))

    def get(self, probes: DataFrame, i: str) -> DataFrame:
        r = self.rows.withColumnRenamed("idx", "_i")
        return probes.join(r, F.col(i) == F.col("_i"), "left").drop("_i")

    def _fits(self, rows: DataFrame) -> DataFrame:
        bad = F.concat(F.lit("value does not fit in bits: "), F.lit(self.width))
        limit = (1 << self.width) - 1 if self.width < 63 else (1 << 63) - 1
        return rows.withColumn("val", F.when((F.col("val") < 0) | (F.col("val") > limit), F.raise_error(bad).cast("long")).otherwise(F.col("val")))

    def set(self, edits: DataFrame, idx: str, val: str) -> FieldVector:
        e = edits.select(F.col(idx).alias("idx"), F.col(val).cast("long").alias("_new"))
        out = self.rows.join(e, "idx", "left").select("idx", F.coalesce("_new", "val").alias("val"))
        return FieldVector(self._fits(out), self.width, self.length)

    def push(self, value: int) -> FieldVector:
        """One more element; refused if it does not fit the width."""
        if value < 0 or value.bit_length() > self.width:
            raise ValueError(f"{value} does not fit in {self.width} bits")
        new = self.rows.sparkSession.createDataFrame([(self.length, value)], "idx long, val long")
        return FieldVector(self.rows.unionByName(new), self.width, self.length + 1)

    def resize(self, length: int, value: int = 0) -> FieldVector:
        """The first ``length`` elements, filled up with ``value``."""
        kept = self.rows.where(F.col("idx") < length)
        if length > self.length:
            kept = kept.unionByName(self.rows.sparkSession.range(self.length, length).select(F.col("id").alias("idx"), F.lit(value).cast("long").alias("val")))
        return FieldVector(self._fits(kept), self.width, length)

    def pop(self) -> FieldVector:
        return self.resize(max(0, self.length - 1))

    def filled(self, value: int) -> FieldVector:
        """All elements ``value``; 0 resets."""
        return self.apply(lambda _: F.lit(value))

    def equals(self, other: FieldVector) -> bool:
        """Same width, length and elements."""
        if (self.width, self.length) != (other.width, other.length):
            return False
        a, b = self.rows.select("idx", "val"), other.rows.select("idx", "val")
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    def copy(self, start: int, dest: FieldVector, to: int, n: int) -> FieldVector:
        """``dest`` with up to ``n`` of these elements from ``start``, put at ``to``; clipped at both ends."""
        if self.width != dest.width:
            raise ValueError("bit widths differ")
        n = max(0, min(n, self.length - start, dest.length - to))
        part = self.rows.where((F.col("idx") >= start) & (F.col("idx") < start + n)).select((F.col("idx") - start + to).alias("idx"), F.col("val").alias("_new"))
        return FieldVector(dest.rows.join(part, "idx", "left").select("idx", F.coalesce("_new", "val").alias("val")), dest.width, dest.length)

    def apply(self, f) -> FieldVector:
        return FieldVector(self._fits(self.rows.select("idx", f(F.col("val")).cast("long").alias("val"))), self.width, self.length)

    def scan(self, start: int = 0, backward: bool = False) -> DataFrame:
        """Elements from ``start`` up, or below it downwards."""
        return self.rows.where(F.col("idx") < start).orderBy(F.desc("idx")) if backward else self.rows.where(F.col("idx") >= start).orderBy("idx")

    def pack(self) -> BitVector:
        """All elements' bits, one after another."""
        bits = self.rows.select("idx", "val", F.explode(F.sequence(F.lit(0), F.lit(self.width - 1))).alias("i"))
        bits = bits.select((F.col("idx") * self.width + F.col("i")).alias("pos"), (F.getbit("val", "i") == 1).alias("bit"))
        return BitVector.from_bits(bits, "pos", "bit", self.width * self.length)
