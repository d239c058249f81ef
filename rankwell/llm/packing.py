"""Packing documents into sequences of a fixed number of tokens.

Every document fills whole windows and leaves a remainder.  The remainders'
lengths, a histogram of fewer bins than a window has tokens, are combined on the driver: shallow
combinations that fill a window, repeat counts by non-negative least squares, rounded to
what is there; a greedy fill packs the rest, cutting pieces to end windows exactly.
The plan names ranges of each length's remainders; documents find their places by a
broadcast join with it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, buckets_for, materialize
from .tokens import encoder

WINDOW = 1024
#: Combinations of three lengths that the solver sees, at most; all of two are seen.
TRIPLES = 3000
SWEEPS = 40


def combinations(counts: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Two or three lengths that fill a window exactly, those of frequent lengths first."""
    there = [n for n in range(1, window) if counts[n]]
    pairs = [(a, window - a) for a in there if a <= window - a and counts[window - a]]
    often = sorted(there, key=lambda n: (-counts[n], n))[:128]
    triples = []
    for a in there:
        for b in often:
            c = window - a - b
            if a <= b <= c < window and counts[c]:
                triples.append((-min(counts[a], counts[b], counts[c]), a, b, c))
    return pairs + [t[1:] for t in sorted(triples)[:TRIPLES]]


def repeat_counts(combos: list[tuple[int, ...]], counts: np.ndarray) -> np.ndarray:
    """Minimises |sum of repeats x lengths - counts|^2 over repeats >= 0, by coordinate descent."""
    left, x = counts.astype(np.float64).tolist(), [0.0] * len(combos)
    told = []
    for c in combos:
        mult = {n: c.count(n) for n in c}
        told.append((tuple(mult.items()), sum(m * m for m in mult.values())))
    for _ in range(SWEEPS):
        moved = 0.0
        for i, (mult, norm) in enumerate(told):
            step = max(-x[i], sum(m * left[n] for n, m in mult) / norm)
            if step:
                x[i] += step
                moved = max(moved, abs(step))
                for n, m in mult:
                    left[n] -= m * step
        if moved < 0.25:
            break
    return np.array(x)


class _Stock:
    """Remainders not yet placed, by kind (length class, start, length), as ranges of their class's numbers."""

    def __init__(self, counts: np.ndarray):
        self.ranges = {(n, 0, n): [(0, int(counts[n]))] for n in range(1, len(counts)) if counts[n]}
        self.left = {k: r[0][1] for k, r in self.ranges.items()}

    def take(self, kind, n: int) -> list[tuple[int, int]]:
        out, self.left[kind] = [], self.left[kind] - n
        while n:
            lo, hi = self.ranges[kind].pop()
            k = min(n, hi - lo)
            out.append((hi - k, hi))
            if hi - k > lo:
                self.ranges[kind].append((lo, hi - k))
            n -= k
        if not self.left[kind]:
            del self.left[kind], self.ranges[kind]
        return out

    def put(self, kind, ranges: list[tuple[int, int]]) -> None:
        self.ranges.setdefault(kind, []).extend(ranges)
        self.left[kind] = self.left.get(kind, 0) + sum(hi - lo for lo, hi in ranges)


def plan(counts: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int, int, int, int, int]]:
    """Rows (class, lo, hi, start, length, sequence, mult, offset).

    The class's remainders number lo to hi - 1 each give a piece of ``length``
    from ``start``; number i goes to sequence + (i - lo) // mult, at offset +
    (i - lo) % mult * length.  Sequences count from 0; all are full, but for those
    that end the last window, whose lengths are powers of two.
    """
    stock, rows, sequence = _Stock(counts), [], 0

    def place(kinds: list[tuple], times: int) -> None:
        """``times`` sequences, each of these kinds one after another."""
        nonlocal sequence
        offset, i = 0, 0
        while i < len(kinds):
            kind = kinds[i]
            mult = 1
            while i + mult < len(kinds) and kinds[i + mult] == kind:
                mult += 1
            put(kind, mult, times, offset)
            offset += mult * kind[2]
            i += mult
        sequence += times

    def put(kind, mult: int, times: int, offset: int) -> None:
        done = 0
        for lo, hi in stock.take(kind, mult * times):
            while lo < hi:  # a range may begin or end within a sequence
                within = done % mult
                k = min(hi - lo, mult - within) if within or hi - lo < mult else (hi - lo) // mult * mult
                step = mult if not within and k >= mult else mult - within
                rows.append((kind[0], lo, lo + k, kind[1], kind[2], sequence + done // mult, step, offset + within * kind[2]))
                lo, done = lo + k, done + k

    combos = combinations(counts, window)
    x = repeat_counts(combos, counts)
    for i in np.argsort(-x, kind="stable").tolist():
        kinds = [(n, 0, n) for n in sorted(combos[i], reverse=True)]
        times = min([int(x[i] + 0.5), *(stock.left.get(k, 0) // kinds.count(k) for k in kinds)])
        if times > 0:
            place(kinds, times)

    while stock.left:
        kinds, free, used = [], window, {}
        for kind in sorted(stock.left, key=lambda k: (-k[2], k)):
            n = min(stock.left[kind], free // kind[2])
            if n:
                kinds += [kind] * n
                used[kind] = n
                free -= n * kind[2]
            if not free:
                break
        if free:  # no whole piece fits: the longest one with some left is cut to end the window
            rest = [k for k in stock.left if stock.left[k] > used.get(k, 0)]
            if not rest:
                break
            cut = max(rest, key=lambda k: (k[2], k))
            times = min([stock.left[k] // n for k, n in used.items() if k != cut] + [stock.left[cut] // (used.get(cut, 0) + 1)])
            ranges = stock.take(cut, times)
            head, tail = (cut[0], cut[1], free), (cut[0], cut[1] + free, cut[2] - free)
            place(kinds, times) if kinds else None
            first = sequence - times if kinds else sequence
            sequence = first + times
            done = 0
            for lo, hi in ranges:
                rows.append((head[0], lo, hi, head[1], head[2], first + done, 1, window - free))
                done += hi - lo
            stock.put(tail, ranges)
        else:
            place(kinds, min(stock.left[k] // n for k, n in used.items()))

    # less than a window is left: cut where its length's powers of two end
    total = sum(k[2] * n for k, n in stock.left.items())
    parts = [1 << b for b in range(window.bit_length() - 1, -1, -1) if total >> b & 1]
    offset = 0
    for kind in sorted(stock.left, key=lambda k: (-k[2], k)):
        for lo, hi in stock.ranges[kind]:
            for i in range(lo, hi):
                start, left = kind[1], kind[2]
                while left:
                    n = min(left, parts[0] - offset)
                    rows.append((kind[0], i, i + 1, start, n, sequence, 1, offset))
                    start, left, offset = start + n, left - n, offset + n
                    if offset == parts[0]:
                        parts.pop(0)
                        sequence, offset = sequence + 1, 0
    return rows


def _tokenised(path: str, window: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, last = encoder(path), end.to_bytes(4, "little")
        for b in batches:
            crcs, rem, rem_crc, rem_ids, total = [], [], [], [], []
            for t in b.column(2):
                ids = enc.ids(t.as_py() or "") + last
                n = len(ids) // 4
                full = n // window
                total.append(n)
                crcs.append([zlib.crc32(ids[4 * window * k : 4 * window * (k + 1)]) for k in range(full)])
                rest = ids[4 * window * full :]
                rem.append(n - full * window)
                rem_ids.append(rest)
                rem_crc.append(zlib.crc32(rest))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(total, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rem, pa.int32()), pa.array(rem_crc, pa.int64()), pa.array(rem_ids, pa.binary())],
                names=["doc_id", "h", "doc_tokens", "crcs", "rem", "rem_crc", "rem_ids"],
            )

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """Packs all documents, each with ``end_id`` after its tokens, into sequences of ``window``.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.  A null or empty text is ``end_id`` alone; null ids are
    kept and repeated rows packed as often as they occur; other columns are ignored;
    an empty table gives an empty result.  No sequence needs padding: all are full but
    the last few, whose lengths are powers of two.

    Remainders are numbered within (length, hash bucket) groups of bounded size, so
    a group of copies, which share a length, meets in no single task.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), "text")
    rows = rows.mapInArrow(_tokenised(tokenizer, window, end_id), f"doc_id {kind}, h long, doc_tokens long, crcs array<long>, rem int, rem_crc long, rem_ids binary")
    rows = materialize(rows, "pack-tokens").withColumn("full", F.size("crcs").cast("long"))
    seen = {r["rem"]: r for r in rows.groupBy("rem").agg(F.count("*").alias("n"), F.sum("full").alias("full")).collect()}  # at most ``window`` rows
    if not seen:
        return spark.createDataFrame([], f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    counts = np.array([seen[n]["n"] if n in seen else 0 for n in range(window)], np.int64)
    counts[0] = 0
    base, bases = 0, []
    for n in sorted(seen):
        bases.append((n, base))
        base += seen[n]["full"]
    placed = spark.createDataFrame(plan(counts, window) or [(-1, 0, 0, 0, 0, 0, 1, 0)], "class int, lo long, hi long, part long, length long, sequence long, mult long, at long")

    n = buckets_for(sum(r["n"] for r in seen.values()))
    rows = rows.withColumn("bucket", bucket_of(F.col("h"), n))
    before = Window.partitionBy("rem").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    groups = rows.groupBy("rem", "bucket").agg(F.count("*").alias("rows"), F.sum("full").alias("fulls"))
    groups = groups.select("rem", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row0"), F.coalesce(F.sum("fulls").over(before), F.lit(0)).alias("full0"))
    within = Window.partitionBy("rem", "bucket").orderBy("h", "doc_id")
    rows = rows.withColumn("row", F.row_number().over(within) - 1).withColumn("fulls", F.coalesce(F.sum("full").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(groups, ["rem", "bucket"]).join(F.broadcast(spark.createDataFrame(bases, "rem int, base long")), "rem")
    rows = rows.withColumn("i", F.col("row0") + F.col("row")).withColumn("s0", F.col("base") + F.col("full0") + F.col("fulls"))

    whole = rows.where("full > 0").select("doc_id", "doc_tokens", "s0", F.posexplode("crcs").alias("k", "crc"))
    whole = whole.select("doc_id", (F.col("k") * F.lit(window)).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", (F.col("s0") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    p = F.broadcast(placed)  # its size is bounded by the window, not by the data
    rest = rows.where("rem > 0").join(p, (F.col("rem") == F.col("class")) & (F.col("i") >= F.col("lo")) & (F.col("i") < F.col("hi")))
    cut = F.crc32(F.expr("substring(rem_ids, cast(4 * part + 1 as int), cast(4 * length as int))"))
    q = F.col("i") - F.col("lo")
    rest = rest.select(
        "doc_id", (F.col("doc_tokens") - F.col("rem") + F.col("part")).alias("start"), "length",
        F.when(F.col("length") == F.col("rem"), F.col("rem_crc")).otherwise(cut).alias("ids_crc32"), "doc_tokens",
        (F.lit(base) + F.col("sequence") + F.expr("(i - lo) div mult")).alias("sequence_id"), (F.col("at") + q % F.col("mult") * F.col("length")).alias("offset"),
    )
    return whole.unionByName(rest)
