"""Static functions and filters as packed cells: the XOR of three cells gives a key's value.

Keys are dealt to shards by their hashes.  A shard's keys are edges of a random
3-uniform hypergraph over its cells; edges with a cell of their own are peeled
off one by one, and cells are filled in reverse.  A shard that does not peel is
tried with another seed.  Off the keys a function gives an arbitrary value; a
filter compares a fingerprint of b bits, so it errs with probability 2^-b.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BuildError, DuplicateKey, MismatchedKeysAndValues, Unsolvable, ValueTooLarge
from ..functions import low_bits, shift_right
from .func import MonotoneRank, duplicate_keys

#: Cells for each key, keys a shard (about), and seeds that a shard tries.
SPACE, SHARD_KEYS, TRIES = 1.23, 1 << 16, 64


def _edges(sigs: np.ndarray, seed: int, third: int) -> np.ndarray:
    """Three cells of each signature, one in each third."""
    x = sigs.view(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 1) % (1 << 64))
    out = []
    for k in range(3):
        x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ x >> np.uint64(29)
        out.append(((x >> np.uint64(32)) * np.uint64(third) >> np.uint64(32)).astype(np.int64) + k * third)
    return np.stack(out, axis=1)


def solve_shard(sigs: np.ndarray, values: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(seed, cells in a third, cells) for distinct signatures."""
    n = len(sigs)
    third = max(1, int(n * SPACE / 3) + 11)
    for seed in range(TRIES):
        edges = _edges(sigs, seed, third)
        degree = np.bincount(edges.ravel(), minlength=3 * third).tolist()
        owner = np.zeros(3 * third, np.int64)
        for k in range(3):
            np.bitwise_xor.at(owner, edges[:, k], np.arange(n))
        owner, rows, order = owner.tolist(), edges.tolist(), []
        free = [c for c, d in enumerate(degree) if d == 1]
        while free:
            c = free.pop()
            if degree[c] != 1:
                continue
            e = owner[c]
            order.append((e, c))
            for o in rows[e]:
                degree[o] -= 1
                owner[o] ^= e
                if degree[o] == 1:
                    free.append(o)
        if len(order) == n:
            cells, told = [0] * (3 * third), values.view(np.uint64).tolist()
            for e, c in reversed(order):
                a, b, d = rows[e]
                cells[c] = told[e] ^ cells[a] ^ cells[b] ^ cells[d]
            return seed, third, np.array(cells, np.uint64)
    raise Unsolvable("a shard has no solution; do two keys share a signature?")


def _dtype(width: int):
    return np.dtype(f"<u{next(b for b in (1, 2, 4, 8) if 8 * b >= width)}")


def read_cells(sigs: np.ndarray, seed: int, third: int, payload: bytes, width: int) -> np.ndarray:
    cells = np.frombuffer(payload, _dtype(width))
    return np.bitwise_xor.reduce(cells[_edges(sigs, seed, third)], axis=1).astype(np.uint64)


@dataclass
class PackedFunction:
    """Rows (shard, seed, third, payload)."""

    blobs: DataFrame
    shards: int
    width: int
    n: int
    seed: int = 0

    @staticmethod
    def signed(df: DataFrame, key: str, shards: int, seed: int) -> DataFrame:
        """``df`` with its keys' signature and shard."""
        sig = F.xxhash64(F.lit(seed), F.col(key))
        return df.withColumn("_sig", sig).withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), sig), F.lit(shards)))

    @classmethod
    def build(cls, df: DataFrame, key: str, value: str, width: int | None = None, seed: int = 0) -> PackedFunction:
        told = df.agg(F.count("*"), F.count(value), F.coalesce(F.max(value), F.lit(0)), F.coalesce(F.min(value), F.lit(0))).first()
        if told[0] != told[1]:
            raise MismatchedKeysAndValues(f"{told[0]} keys, {told[1]} values")
        bits = max(1, int(told[2]).bit_length())
        if told[3] < 0 or width is not None and bits > width:
            raise ValueTooLarge(f"values from {told[3]} to {told[2]} do not fit")
        if not duplicate_keys(df, key).isEmpty():
            raise DuplicateKey("a key occurs twice")
        return cls._solve(df.select(F.col(key).alias("_key"), F.col(value).cast("long").alias("_value")), width or bits, told[0], seed)

    @staticmethod
    def signatures(df: DataFrame, key: str, value: str, seed: int = 0) -> DataFrame:
        """(sig, value): all that a build needs of the keys; stores can be written, read again and put together."""
        return df.select(F.xxhash64(F.lit(seed), F.col(key)).alias("sig"), F.col(value).cast("long").alias("value"))

    @classmethod
    def from_signatures(cls, store: DataFrame, seed: int = 0) -> PackedFunction:
        """A function from stored signatures, without the keys; two of one signature are refused."""
        n, top = store.agg(F.count("*"), F.coalesce(F.max("value"), F.lit(0))).first()
        if not duplicate_keys(store, "sig").isEmpty():
            raise DuplicateKey("two keys share a signature")
        return cls._solve(store.select(F.col("sig").alias("_sig"), F.col("value").alias("_value")), max(1, int(top).bit_length()), n, seed)

    @classmethod
    def _solve(cls, pairs: DataFrame, width: int, n: int, seed: int) -> PackedFunction:
        shards, kind = max(1, -(-n // SHARD_KEYS)), _dtype(width)

        def run(table: pa.Table) -> pa.Table:
            sigs, values = (table.column(c).to_numpy() for c in ("_sig", "_value"))
            s, third, cells = solve_shard(sigs, values)
            return pa.table({"shard": pa.array([table.column("_shard")[0].as_py()], pa.int64()), "seed": pa.array([s], pa.int32()), "third": pa.array([third], pa.int64()), "payload": pa.array([cells.astype(kind).tobytes()], pa.binary())})

        if "_sig" in pairs.columns:
            rows = pairs.withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), "_sig"), F.lit(shards)))
        else:
            rows = cls.signed(pairs, "_key", shards, seed)
        rows = rows.select("_shard", "_sig", "_value").dropDuplicates(["_shard", "_sig", "_value"])
        return cls(rows.groupBy("_shard").applyInArrow(run, "shard long, seed int, third long, payload binary"), shards, width, n, seed)

    def get(self, probes: DataFrame, q: str, name: str = "value") -> DataFrame:
        """Adds the value of every key; arbitrary off the keys, null for null."""
        width, some = self.width, self.signed(probes, q, self.shards, self.seed)
        keys = some.where(F.col(q).isNotNull()).select("_shard", "_sig").distinct()  # a frequent probe is looked up once

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            sigs = left.column("_sig").to_numpy()
            if right.num_rows and len(sigs):
                r = right.to_pylist()[0]
                found = pa.array(read_cells(sigs, r["seed"], r["third"], r["payload"], width).view(np.int64))
            else:
                found = pa.nulls(len(sigs), pa.int64())
            return pa.table({"_s": pa.array(sigs, pa.int64()), "_found": found})

        got = keys.groupBy("_shard").cogroup(self.blobs.groupBy("shard")).applyInArrow(run, "_s long, _found long")
        out = some.join(got, F.col("_sig") == F.col("_s"), "left")
        return out.select(*probes.columns, F.when(F.col(q).isNotNull(), F.col("_found")).alias(name))

    def bits_per_key(self) -> float:
        return self.blobs.agg(F.sum(F.length("payload"))).first()[0] * 8 / max(1, self.n)

    def shard_sizes(self) -> DataFrame:
        return self.blobs.select("shard", F.length("payload").cast("long").alias("bytes"))


@dataclass
class SignedFunction:
    """A packed function with a truncated hash of each key beside its value; off the keys the hashes differ,
    but for a share of 2^-hash_width."""

    values: PackedFunction
    hashes: PackedFunction
    hash_width: int
    seed: int

    @classmethod
    def build(cls, df: DataFrame, key: str, value: str, hash_width: int = 64, seed: int = 0) -> SignedFunction:
        if not 1 <= hash_width <= 64:
            raise BuildError("the hash width must be from 1 to 64")
        values = PackedFunction.build(df, key, value, seed=seed)
        told = df.select(F.col(key).alias("_key"), cls._hash(F.col(key), hash_width, seed).alias("_value"))
        return cls(values, PackedFunction._solve(told, hash_width, values.n, seed), hash_width, seed)

    @staticmethod
    def _hash(key, hash_width: int, seed: int):
        return low_bits(F.xxhash64(F.lit(seed + 3), key), hash_width)

    def get(self, probes: DataFrame, q: str, name: str = "value") -> DataFrame:
        """Adds the value where the stored hash is the probe's; null elsewhere."""
        out = self.hashes.get(self.values.get(probes, q, "_v"), q, "_h")
        ok = F.col("_h") == self._hash(F.col(q), self.hash_width, self.seed)
        return out.select(*probes.columns, F.when(ok, F.col("_v")).alias(name))


@dataclass
class PrefixRank:
    """Ranks of sorted 64-bit integer keys, from the bits that the keys of a bucket share.

    A packed function gives a key's place in its bucket and how many leading bits the bucket
    shares; another one maps these bits to the bucket.  With ``two_step`` the numbers of
    bits, of which few are frequent, are behind a function to their place by frequency, with an
    escape to a second function for the others.  Off the keys ranks are arbitrary.
    """

    offsets: PackedFunction  # key to its place in the bucket, with the shared bits above it unless in two steps
    buckets: PackedFunction  # shared bits to the bucket
    bits: int
    common: list[int] | None = None
    first: PackedFunction | None = None
    second: PackedFunction | None = None

    @staticmethod
    def _prefix(key, shared):
        """The leading ``shared`` bits of a key, with their number, as one key."""
        return F.xxhash64(shared.cast("long"), F.when(shared > 0, shift_right(key, 64 - shared)).otherwise(F.lit(0)).cast("long"))

    @classmethod
    def build(cls, ranks: MonotoneRank, two_step: bool = False) -> PrefixRank:
        bits = ranks.bucket_bits()
        rows = ranks.table.select(F.col("key").cast("long").alias("key"), "rank", F.expr(f"rank div {1 << bits}").alias("bucket"))
        rows = rows.join(ranks.bucket_prefixes(), "bucket").withColumn("place", F.col("rank") % (1 << bits))
        heads = rows.groupBy("bucket", "lcp").agg(F.min("key").alias("key")).select(cls._prefix(F.col("key"), F.col("lcp")).alias("prefix"), "bucket")
        buckets = PackedFunction.build(heads, "prefix", "bucket")
        if not two_step:
            return cls(PackedFunction.build(rows.withColumn("v", F.col("lcp") * (1 << bits) + F.col("place")), "key", "v"), buckets, bits)
        counts = {r["lcp"]: r["n"] for r in rows.groupBy("lcp").agg(F.count("*").alias("n")).collect()}  # 65 numbers of bits at most
        order = sorted(counts, key=lambda v: (-counts[v], v))
        total, width = sum(counts.values()), max(1, max(order, default=0).bit_length())
        cost = lambda r: total * max(1, r) + sum(counts[v] for v in order[(1 << r) - 1 :]) * width
        common = order[: (1 << min(range(width + 1), key=cost)) - 1]
        place = F.coalesce(*(F.when(F.col("lcp") == v, F.lit(i)) for i, v in enumerate(common)), F.lit(len(common))).cast("long")
        rows = rows.withColumn("common", place)
        rare = rows.where(F.col("common") == len(common))
        return cls(PackedFunction.build(rows, "key", "place"), buckets, bits, common, PackedFunction.build(rows, "key", "common"), PackedFunction.build(rare, "key", "lcp"))

    def get(self, probes: DataFrame, q: str, name: str = "rank") -> DataFrame:
        out, size = self.offsets.get(probes, q, "_o"), 1 << self.bits
        if self.common is None:
            out = out.withColumn("_l", F.expr(f"_o div {size}")).withColumn("_o", F.col("_o") % size)
        else:
            out = self.second.get(self.first.get(out, q, "_c"), q, "_r")
            shared = F.coalesce(*(F.when(F.col("_c") == i, F.lit(v)) for i, v in enumerate(self.common)), F.col("_r"))
            out = out.withColumn("_l", shared.cast("long"))
        out = out.withColumn("_l", F.pmod(F.coalesce("_l", F.lit(0)), F.lit(65)))
        out = self.buckets.get(out.withColumn("_p", self._prefix(F.col(q).cast("long"), F.col("_l"))), "_p", "_b")
        return out.select(*probes.columns, F.when(F.col(q).isNotNull(), F.col("_b") * size + F.col("_o")).alias(name))


@dataclass
class PackedFilter:
    """A function from keys to fingerprints; ``contains`` has no false negatives."""

    function: PackedFunction
    bits: int

    @classmethod
    def build(cls, df: DataFrame, key: str, bits: int = 8, seed: int = 0) -> PackedFilter:
        if not 1 <= bits <= 64:
            raise BuildError("a fingerprint has 1 to 64 bits")
        keys = df.select(F.col(key).alias("_key")).where(F.col("_key").isNotNull()).distinct()
        rows = keys.withColumn("_value", cls._print(F.col("_key"), bits, seed))
        return cls(PackedFunction._solve(rows, bits, keys.count(), seed), bits)

    @staticmethod
    def _print(key, bits: int, seed: int):
        return low_bits(F.xxhash64(F.lit(seed + 2), key), bits)

    def contains(self, probes: DataFrame, q: str) -> DataFrame:
        out = self.function.get(probes, q, "_fp")
        return out.where(F.col("_fp") == self._print(F.col(q), self.bits, self.function.seed)).drop("_fp")
