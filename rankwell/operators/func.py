"""Static functions: key to value, signed, monotone and compressed ones, and their cost models."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BuildError, DuplicateKey, MismatchedKeysAndValues, NotMonotone, ValueTooLarge
from ..functions import bit_lcp, bit_len
from .scan import dense_index

#: Space of a static function a key, relative to its values.
EXPANSION = 1.11


@dataclass
class KeyedFunction:
    """A function on a set of keys; null off it."""

    table: DataFrame  # key, value

    @classmethod
    def build(cls, df: DataFrame, key: str, value: str, width: int | None = None, expected: int | None = None) -> KeyedFunction:
        told = df.agg(F.count("*"), F.count(value), F.max(value)).first()
        if told[0] != told[1] or expected is not None and told[0] != expected:
            raise MismatchedKeysAndValues(f"{told[0]} keys, {told[1]} values")
        if width is not None and told[0] and int(told[2]).bit_length() > width:
            raise ValueTooLarge(f"value {told[2]} needs more than {width} bits")
        if not duplicate_keys(df, key).isEmpty():
            raise DuplicateKey("a key occurs twice")
        return cls(df.select(F.col(key).alias("key"), F.col(value).alias("value")))

    def get(self, probes: DataFrame, q: str) -> DataFrame:
        return probes.join(self.table, F.col(q) == F.col("key"), "left").drop("key")

    def width(self) -> int:
        """Bits of the largest value."""
        top = self.table.agg(F.max("value")).first()[0]
        return 0 if top is None else max(1, int(top).bit_length())


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def signed_get(function: DataFrame, probes: DataFrame, q: str, hash_width: int = 64, seed: int = 0) -> DataFrame:
    """Adds ``value`` of ``function`` (key, value) through a signed static function: exact on its keys, null off them
    but for a share of 2^-hash_width."""
    from .static import SignedFunction

    return SignedFunction.build(function, "key", "value", hash_width, seed).get(probes, q)


def histogram(df: DataFrame, value: str) -> DataFrame:
    """(value, n, pos): values by falling frequency, ties to the smaller."""
    counts = df.groupBy(F.col(value).cast("long").alias("value")).agg(F.count("*").alias("n"))
    return dense_index(counts, F.desc("n"), F.asc("value"), name="pos")


def split_costs(df: DataFrame, value: str) -> DataFrame:
    """(r, cost): space if the 2^r - 1 most frequent values get r bits and the others an escape and all their bits."""
    h = histogram(df, value)
    told = h.agg(F.sum("n").alias("total"), F.max("value").alias("top")).first()
    if told["total"] is None:
        return df.sparkSession.createDataFrame([], "r long, cost double")
    w = max(1, int(told["top"]).bit_length())
    # pos < 2^r - 1 exactly if pos + 1 has r bits at most: sums by that number of bits, 64 at most, then their prefix sums
    by_bits = {r["bits"]: r["n"] for r in h.groupBy(bit_len(F.col("pos") + 1).alias("bits")).agg(F.sum("n").alias("n")).collect()}
    sizes = [(r, (1 << r) - 1, sum(n for bits, n in by_bits.items() if bits <= r)) for r in range(w + 1)]
    held = df.sparkSession.createDataFrame(sizes, "r long, kept long, held long")
    cost = F.lit(EXPANSION) * told["total"] * F.greatest(F.lit(1), F.col("r")) + F.lit(EXPANSION) * (told["total"] - F.col("held")) * w + F.col("kept") * 64
    return held.select("r", F.round(cost, 3).alias("cost"))


def optimal_split(df: DataFrame, value: str) -> DataFrame:
    """The cheapest r, ties to the smaller."""
    return split_costs(df, value).agg(F.min(F.struct("cost", "r")).alias("b")).select("b.r", "b.cost")


@dataclass
class TwoStepFunction:
    """Frequent values behind short numbers, others behind an escape."""

    first: DataFrame  # key, pos (kept: the escape)
    remap: DataFrame  # pos, value
    second: DataFrame  # key, value

    @classmethod
    def build(cls, df: DataFrame, key: str, value: str) -> TwoStepFunction:
        KeyedFunction.build(df, key, value)
        best = optimal_split(df, value).first()
        kept = (1 << best["r"]) - 1 if best and best["r"] is not None else 0
        h = histogram(df, value).where(F.col("pos") < kept)
        all_ = df.select(F.col(key).alias("key"), F.col(value).cast("long").alias("value"))
        numbered = all_.join(F.broadcast(h.select(F.col("value").alias("_v"), "pos")) if kept < 1 << 16 else h.select(F.col("value").alias("_v"), "pos"), F.col("value") == F.col("_v"), "left")
        return cls(numbered.select("key", F.coalesce("pos", F.lit(kept)).alias("pos")), h.select("pos", "value"), numbered.where("pos is null").select("key", "value"))

    def get(self, probes: DataFrame, q: str) -> DataFrame:
        a = self.first.select(F.col("key").alias("_k1"), F.col("pos").alias("_p"))
        m = self.remap.select(F.col("pos").alias("_q"), F.col("value").alias("_v1"))
        b = self.second.select(F.col("key").alias("_k2"), F.col("value").alias("_v2"))
        out = probes.join(a, F.col(q) == F.col("_k1"), "left").join(m, F.col("_p") == F.col("_q"), "left").join(b, F.col(q) == F.col("_k2"), "left")
        return out.select(*probes.columns, F.coalesce("_v1", "_v2").alias("value"))


def entropy(df: DataFrame, value: str) -> DataFrame:
    """Bits a value of the empirical distribution."""
    n = F.col("n").cast("double")
    h = df.groupBy(value).agg(F.count("*").alias("n")).agg(F.sum(n).alias("t"), F.sum(n * F.log2(n)).alias("s"))
    return h.select(F.round(F.log2("t") - F.col("s") / F.col("t"), 6).alias("entropy"))


@dataclass
class HuffmanCode:
    """A canonical length-limited code of value counts; rare values share an escape."""

    lengths: dict[int, int]
    escape: int | None
    escape_bits: int

    @classmethod
    def from_counts(cls, counts: dict[int, int], max_symbols: int = 1 << 20, share: float = 1.0, others: tuple[int, int] = (0, 0)) -> HuffmanCode:
        """Keeps the most frequent values, up to ``max_symbols`` and until they carry ``share`` of the entropy.

        ``others``: how often values occur that ``counts`` leaves out, and the bits of their widest; they share the escape.
        """
        order = sorted(counts, key=lambda v: (-counts[v], v))
        total = sum(counts.values()) + others[0]
        whole = -sum(c / total * math.log2(c / total) for c in counts.values()) if total else 0
        kept, carried = [], 0.0
        for v in order:
            if len(kept) >= max_symbols or kept and carried >= share * whole and share < 1:
                break
            p = counts[v] / total
            carried -= p * math.log2(p)
            kept.append(v)
        rest = [v for v in order[len(kept) :]]
        weights = [(counts[v], i) for i, v in enumerate(kept)] + ([(sum(counts[v] for v in rest) + others[0], len(kept))] if rest or others[0] else [])
        depth = [0] * len(weights)
        heap = [(w, i, [i]) for w, i in weights]
        heapq.heapify(heap)
        if len(heap) == 1:
            depth[0] = 1
        k = len(weights)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for i in a[2] + b[2]:
                depth[i] += 1
            heapq.heappush(heap, (a[0] + b[0], k, a[2] + b[2]))
            k += 1
        return cls({v: depth[i] for i, v in enumerate(kept)}, depth[len(kept)] if rest or others[0] else None, max([v.bit_length() for v in rest] + [others[1]]))

    @classmethod
    def from_values(cls, df: DataFrame, value: str, max_symbols: int = 1 << 20) -> tuple[HuffmanCode, int]:
        """The code of a column's non-null values, and the bits of all of them: the ``max_symbols`` most frequent have codewords, the others the escape and their bits."""
        h = histogram(df.where(F.col(value).isNotNull()), value)
        counts = {r["value"]: r["n"] for r in h.where(F.col("pos") < max_symbols).collect()}
        told = h.where(F.col("pos") >= max_symbols).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("value"), F.lit(0))).first()
        code = cls.from_counts(counts, max_symbols, others=(told[0], max(1, told[1].bit_length()) if told[0] else 0))
        escaped = told[0] * (code.escape + code.escape_bits) if told[0] else 0
        return code, sum(code.encoded_len(v) * n for v, n in counts.items()) + escaped

    def encoded_len(self, value: int) -> int:
        return self.lengths[value] if value in self.lengths else self.escape + self.escape_bits

    def codewords(self) -> dict[int | None, tuple[int, int]]:
        """Canonical (code, length) by value; the escape under None."""
        code, out, last = 0, {}, 0
        items = sorted([(n, v is None, v or 0, v) for v, n in self.lengths.items()] + ([(self.escape, True, 0, None)] if self.escape else []), key=lambda t: t[:3])
        for n, _, _, v in items:
            code <<= n - last
            out[v], last = (code, n), n
            code += 1
        return out

    def encode(self, values: list[int]) -> str:
        words = self.codewords()
        out = []
        for v in values:
            c, n = words[v] if v in words else words[None]
            out.append(f"{c:0{n}b}" + ("" if v in words else f"{v:0{self.escape_bits}b}"))
        return "".join(out)

    def decode(self, bits: str) -> list[int]:
        by = {f"{c:0{n}b}": v for v, (c, n) in self.codewords().items()}
        out, at, end = [], 0, 1
        while at < len(bits):
            while bits[at:end] not in by:
                end += 1
            v, at = by[bits[at:end]], end
            if v is None:
                v, at = int(bits[at : at + self.escape_bits], 2), at + self.escape_bits
            out.append(v)
            end = at + 1
        return out


@dataclass
class MonotoneRank:
    """Sorted, strictly increasing keys to their ranks."""

    table: DataFrame  # key, rank
    n: int

    @classmethod
    def build(cls, df: DataFrame, key: str, n: int | None = None, idx: str | None = None) -> MonotoneRank:
        """``idx``: the order in which the keys are given, checked to be strictly increasing; without it they are sorted here."""
        count = df.count()
        if n is not None and n != count:
            raise MismatchedKeysAndValues(f"{n} keys expected, {count} given")
        if not duplicate_keys(df, key).isEmpty():
            raise DuplicateKey("a key occurs twice")
        table = dense_index(df.select(F.col(key).alias("key"), *([F.col(idx).alias("_o")] if idx else [])), "key", name="rank")
        if idx and not table.where("_o != rank").isEmpty():
            raise NotMonotone("keys are not sorted")
        return cls(table.select("key", "rank"), count)

    def get(self, probes: DataFrame, q: str) -> DataFrame:
        return probes.join(self.table, F.col(q) == F.col("key"), "left").drop("key")

    def bucket_bits(self) -> int:
        """Binary logarithm of the bucket size that balances the two functions."""
        if self.n < 2:
            return 0
        size = math.ceil(1 + EXPANSION * math.log(2) + math.log(self.n) - math.log(1 + math.log(self.n)))
        return (size - 1).bit_length()

    def bucket_prefixes(self) -> DataFrame:
        """(bucket, lcp): leading bits that all 64-bit integer keys of a bucket share."""
        rows = self.table.withColumn("bucket", F.expr(f"rank div {1 << self.bucket_bits()}"))
        ends = rows.groupBy("bucket").agg(F.min("key").alias("a"), F.max("key").alias("b"))
        return ends.select("bucket", bit_lcp(F.col("a"), F.col("b")).alias("lcp"))


def value_widths(df: DataFrame, value: str) -> DataFrame:
    """How many values need each number of bits."""
    return df.groupBy(bit_len(F.col(value)).alias("bits")).agg(F.count("*").alias("n"))
