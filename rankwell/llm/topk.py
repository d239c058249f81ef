"""Exact top-k search by inner product: three phases with a uniform threshold.

A vector's components form ``lists`` groups; a score is the sum of one partial
score from each list.  Phase 1 gathers the best entries of each list over a part of the rows;
the k-th best of their scores is a cutoff that is safe for all rows.  Phase 2 sends it to
all tiles: an entry that reaches the cutoff has a partial score of cutoff / lists in some
list, so of the lists seen only entries at that threshold are collected, and of the last list,
which is not computed, those whose norms could give it.  Phase 3 resolves what is
left: entries whose partial scores and the bound for the last list reach the cutoff get
that list's scores, and the k best stay.

Rows meet queries in tiles of bounded size (blocks of queries by blocks of rows).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Queries and rows of a tile, about.
QUERY_BLOCK, ROW_BLOCK = 2048, 16_384
#: Queries of a tile that are scored at once.
STEP = 128
#: Phase 1 reads one row in so many.
GATHERED = 8
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of every component, whole numbers as doubles; only whole vectors of finite components."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # adding 0 makes a negative zero a zero, also if a product is too large for a double it stays the largest one
    v = F.transform(x, lambda c: F.greatest(F.lit(-1.7e308), F.least(F.lit(1.7e308), F.lit(float(scale)) * c)))
    v = F.transform(v, lambda c: F.when(F.abs(c) < float(1 << 53), F.floor(c).cast("double")).otherwise(c) + 0.0)  # larger doubles are whole
    return df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & whole).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of ``width`` components; shorter vectors are filled up with zeros."""
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    first = np.cumsum(size) - size
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(first, size)] = flat
    return out


def _small(q: np.ndarray, r: np.ndarray) -> bool:
    """Whether double arithmetic gives all inner products, and sums of parts of them, exactly."""
    return float(np.abs(q).max(initial=0)) * float(np.abs(r).max(initial=0)) * max(1, q.shape[1]) < 2.0**53


def _large(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers of any size; beyond the range of long, its nearest value."""
    a, b = ([[int(x) for x in v] for v in m.tolist()] for m in (q, r))
    return np.array([[max(LOW, min(HIGH, sum(x * y for x, y in zip(u, v)))) for v in b] for u in a], np.int64).reshape(len(q), len(r))


def _first_k(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores, ties to smaller id; all if fewer."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= cut)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def _sides(q: pa.Table, r: pa.Table, lists: int):
    width = max(1, *(int(np.diff(c.offsets.to_numpy()).max(initial=0)) for t in (q, r) for c in t.column("v").chunks))
    r = r.sort_by("id")
    cuts = [np.arange(g, width, lists) for g in range(min(lists, width))]
    return _matrix(q.column("v"), width), _matrix(r.column("v"), width), q.column("id").to_numpy(), r.column("id").to_numpy(), cuts


def _table(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    ids = np.concatenate([f[1] for f in found]) if found else np.array([], np.int64)
    scores = np.concatenate([f[2] for f in found]) if found else np.array([], np.int64)
    asked = np.repeat(np.array([f[0] for f in found], np.int64), [len(f[1]) for f in found]) if found else np.array([], np.int64)
    return pa.table({"query_id": pa.array(asked, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.int64())})


def _best(found: list, asked: int, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
    other = ids != asked
    ids, scores = ids[other], scores[other]
    top = _first_k(scores, ids, k)
    found.append((asked, ids[top], scores[top]))


def _gather(k: int, lists: int):
    """Phase 1 on a tile: each list's k best entries of a query, and of these the k best by score."""

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        if not q.num_rows or not r.num_rows:
            return _table([])
        qm, rm, qi, ri, cuts = _sides(q, r, lists)
        found: list = []
        if not _small(qm, rm):
            for asked, scores in zip(qi, _large(qm, rm)):
                _best(found, asked, ri, scores, k)
            return _table(found)
        for s in range(0, len(qi), STEP):
            part = slice(s, s + STEP)
            partial = [qm[part][:, c] @ rm[:, c].T for c in cuts]
            n = min(k + 1, len(ri))  # one more, as the query itself may be among them
            entries = np.concatenate([np.argpartition(p, len(ri) - n, axis=1)[:, len(ri) - n :] for p in partial], axis=1)
            whole = sum(partial)
            for j, e in enumerate(entries):
                e = np.unique(e)
                _best(found, qi[s + j], ri[e], whole[j, e].astype(np.int64), k)
        return _table(found)

    return run


def _collect(k: int, lists: int):
    """Phases 2 and 3 on a tile: entries at the threshold in some list, resolved where they can still reach the cutoff."""

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        if not q.num_rows or not r.num_rows:
            return _table([])
        qm, rm, qi, ri, cuts = _sides(q, r, lists)
        found: list = []
        if not _small(qm, rm):
            for asked, scores in zip(qi, _large(qm, rm)):
                _best(found, asked, ri, scores, k)
            return _table(found)
        cutoff = q.column("cut_score").fill_null(LOW).to_numpy().astype(np.float64)
        seen, last = cuts[:-1], cuts[-1]
        q_norm, r_norm = (np.sqrt((m[:, last] ** 2).sum(axis=1)) for m in (qm, rm))
        for s in range(0, len(qi), STEP):
            part = slice(s, s + STEP)
            low = cutoff[part][:, None]
            share = np.floor(low / len(cuts))  # no more than the threshold
            bound = np.floor(q_norm[part][:, None] * r_norm * (1 + 1e-9)) + 1  # no less than the last list's score
            known, reach = np.zeros(bound.shape), bound >= share
            for c in seen:
                p = qm[part][:, c] @ rm[:, c].T
                reach |= p >= share
                known += p
            reach &= known + bound >= low
            for j in range(len(reach)):
                e = np.flatnonzero(reach[j])
                scores = known[j, e] + rm[np.ix_(e, last)] @ qm[s + j, last]
                ok = scores >= low[j]
                _best(found, qi[s + j], ri[e[ok]], scores[ok].astype(np.int64), k)
        return _table(found)

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64, lists: int = 4, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Each query's k highest scores, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``, candidates all rows
    but the query's own.  Returns query_id, rank (from 1), vec_id and score.  Null
    vectors, vectors with null or non-finite components, and null ids take no part;
    a shorter vector counts as filled up with zeros; rows that share an id count
    once (the smallest vector); other columns are ignored; a table without queries
    or rows gives an empty result.  Scores are exact whatever the components; one beyond the
    range of long is its nearest value and ties with others there.

    Queries are copied once for each block of rows, rows once for each block of
    queries; a tile returns at most k entries a query.
    """
    spark = vectors.sparkSession
    rows = materialize(quantised(vectors, id_col, vec_col, scale).groupBy("id").agg(F.min("v").alias("v")), "topk-rows")
    queries = rows.where(F.col("id") % every == 0)
    n, nq = rows.count(), queries.count()
    if not n or not nq:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    row_blocks, query_blocks = -(-n // ROW_BLOCK), -(-nq // QUERY_BLOCK)
    place = lambda blocks, seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(blocks)).cast("int")
    spread = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    tiles = rows.withColumn("rb", place(row_blocks, 1)).withColumn("qb", spread(query_blocks))
    asked = queries.select(F.col("id").alias("id"), F.col("v").alias("v")).withColumn("qb", place(query_blocks, 2))
    schema = "query_id long, vec_id long, score long"

    def met(q: DataFrame, r: DataFrame, fn) -> DataFrame:
        q = q.withColumn("rb", spread(row_blocks))
        return q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInArrow(fn, schema)

    part = tiles.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(GATHERED)) == 0)
    gathered = _ranked(met(asked, part.withColumn("rb", F.expr(f"rb - rb % {GATHERED}")), _gather(k, lists)), k)
    cutoff = gathered.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("cut_score"))
    with_cutoff = asked.join(cutoff, "id", "left")
    return _ranked(met(with_cutoff, tiles, _collect(k, lists)), k).select("query_id", "rank", "vec_id", "score")
