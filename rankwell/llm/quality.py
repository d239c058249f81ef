"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting cycles through the features; each step fits a shallow tree on one
feature's bins and adds it to that feature's lookup table.  Pairs of features
with the largest remaining gain get tables of their own in the same way.  A score is
the logistic function of a sum of table entries, one addition a table for a
whole batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURES = (
    "log_words", "word_length", "upper", "digits", "exclaim", "bars", "symbols", "stops",
    "distinct_words", "repeats", "repeated_lines", "wide", "line_words", "capital_words", "other_marks", "top_byte",
)
#: At most so many labelled documents train the model: those with the smallest hashes of their ids.
TRAIN_ROWS = 20_000
THRESHOLD = 0.7


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[[ord(c) for c in chars]] = 1
    return out


_UPPER = np.array([1 if 65 <= b <= 90 else 0 for b in range(256)])
_LOWER = np.array([1 if 97 <= b <= 122 else 0 for b in range(256)])
_DIGIT = np.array([1 if 48 <= b <= 57 else 0 for b in range(256)])
_WIDE = np.array([1 if b >= 128 else 0 for b in range(256)])
_SPACE = _class(" \t\n\v\f\r")
_SYMBOLS, _STOPS = _class("%$#&*"), _class(".,")
_MARKS = 1 - np.clip(_UPPER + _LOWER + _DIGIT + _WIDE + _SPACE + _SYMBOLS + _STOPS + _class("!|"), 0, 1)
_COUNTED = np.stack([_UPPER, _LOWER, _DIGIT, _WIDE, _SPACE, _SYMBOLS, _STOPS, _MARKS, _class("!"), _class("|")], axis=1)


def features(text: str | None) -> list[float]:
    """Numbers from the whole text alone; an empty text has zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digit, wide, space, symbols, stops, marks, exclaim, bars = (counts @ _COUNTED).tolist()
    n, letters, dense = len(words), max(1, upper + lower), max(1, len(raw) - space)
    lines = [x for x in raw.split(b"\n") if x]
    return [
        float(np.log1p(n)), dense / n, upper / letters, digit / dense, exclaim / n, bars / n, symbols / n, stops / n,
        len(set(words)) / n, sum(map(bytes.__eq__, words, words[1:])) / n, 1 - len(set(lines)) / len(lines), wide / dense, n / len(lines),
        sum(w[:1].isupper() for w in words) / n, marks / n, int(np.where(_SPACE, 0, counts).max()) / dense,
    ]


@dataclass
class AdditiveModel:
    """Tables over bins.  ``edges``: each feature's bin edges; ``tables``: a table a feature;
    ``pairs``: (feature, feature, table over ``coarse`` bins)."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of features."""
        total = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            total += t[np.searchsorted(e, x[:, j], side="right")]
        for a, b, t in self.pairs:
            total += t[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Edges between distinct values, at equal shares of the rows where these are many."""
    seen = np.unique(x)
    middle = (seen[1:] + seen[:-1]) / 2
    return middle if len(middle) < bins else np.unique(np.quantile(x, np.arange(1, bins) / bins, method="nearest"))


def _leaf(g, h, l2):
    return g / (h + l2)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, l2: float) -> np.ndarray:
    """Leaf values over the bins of one feature: the best cut by gain, then within both parts."""
    out = np.full(len(g), _leaf(g.sum(), h.sum(), l2))
    if depth == 0 or len(g) < 2:
        return out
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + l2) + gr**2 / (hr + l2)
    gain[(hl < 0.5) | (hr < 0.5)] = -1
    k = int(gain.argmax())
    if gain[k] <= g.sum() ** 2 / (h.sum() + l2) + 1e-9:
        return out
    return np.concatenate((_tree(g[: k + 1], h[: k + 1], depth - 1, l2), _tree(g[k + 1 :], h[k + 1 :], depth - 1, l2)))


def _quarters(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[np.ndarray, float]:
    """The best pair of cuts of a two-way table: its four leaves and their gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, c = cg[:-1, :-1], ch[:-1, :-1]
    parts = [(a, c), (cg[:-1, -1:] - a, ch[:-1, -1:] - c), (cg[-1:, :-1] - a, ch[-1:, :-1] - c)]
    parts.append((cg[-1, -1] - sum(p[0] for p in parts), ch[-1, -1] - sum(p[1] for p in parts)))
    out = np.zeros_like(g)
    if not a.size:
        return out, 0.0
    gain = sum(x**2 / (y + l2) for x, y in parts)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    leaves = [_leaf(x[i, j], y[i, j], l2) for x, y in parts]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaves
    return out, float(gain[i, j] - cg[-1, -1] ** 2 / (ch[-1, -1] + l2))


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse: int = 8, cycles: int = 150, pair_cycles: int = 50, n_pairs: int = 6, rate: float = 0.1, depth: int = 2, l2: float = 1.0) -> AdditiveModel:
    """Cyclic boosting of the log-likelihood: first the features' tables, then those of pairs."""
    ones = float(y.sum()) if len(y) else 0.0
    share = (ones + 0.5) / (len(y) + 1)
    model = AdditiveModel(base=float(np.log(share / (1 - share))))
    if not len(y) or ones in (0.0, float(len(y))):
        return model
    model.edges = [_edges(c, bins) for c in x.T]
    model.coarse = [_edges(c, coarse) for c in x.T]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T)]
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(cycles):
        for j, b in enumerate(at):
            g, h = slopes()
            step = rate * _tree(np.bincount(b, g, len(model.tables[j])), np.bincount(b, h, len(model.tables[j])), depth, l2)
            model.tables[j] += step
            total += step[b]
    rough = [np.searchsorted(e, c, side="right") for e, c in zip(model.coarse, x.T)]
    size = [len(e) + 1 for e in model.coarse]

    def crossed(a: int, b: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(rough[a] * size[b] + rough[b], v, size[a] * size[b]).reshape(size[a], size[b])

    g, h = slopes()
    gains = sorted(((_quarters(crossed(a, b, g), crossed(a, b, h), l2)[1], a, b) for a in range(len(size)) for b in range(a + 1, len(size))), reverse=True)
    chosen = [(a, b, np.zeros((size[a], size[b]))) for gain, a, b in gains[:n_pairs] if gain > 0]
    for _ in range(pair_cycles):
        for a, b, t in chosen:
            g, h = slopes()
            step = rate * _quarters(crossed(a, b, g), crossed(a, b, h), l2)[0]
            t += step
            total += step[rough[a], rough[b]]
    model.pairs = chosen
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that never train: crc32 of the id as text leaves 2 modulo 4.  A null id isn't one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Fits on at most ``rows`` labelled documents outside the held-out part, those with the smallest hashes of their ids.

    Null labels and ids are left out; of an id's labels the larger counts, of its rows the one with the least features.
    """
    told = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    told = told.groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumn("h", F.xxhash64("doc_id"))
    told = told.orderBy("h", "doc_id").limit(rows).select(F.col("doc_id").alias("labelled"), "quality")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t.as_py()) for t in b.column(2)], pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    some = docs.select("doc_id", "text").join(F.broadcast(told), F.col("doc_id") == F.col("labelled"))  # ``rows`` at most
    some = some.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), "text")
    found = some.mapInArrow(extract, "doc_id long, quality int, x array<double>").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x"))  # one row an id
    found = found.orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    if not len(found):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(np.array(found["x"].tolist()), found["quality"].to_numpy(np.float64))


def with_score(docs: DataFrame, model: AdditiveModel, text_col: str = "text", name: str = "quality_score") -> DataFrame:
    """``docs`` with the column ``name`` (not one of its own), in one pass without a shuffle."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(place)], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x), pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Scores the whole text of every document.

    Returns one row per row of ``docs``: doc_id, held_out, score (0 to 1) and
    predicted (1 from ``threshold`` on).  Null and empty texts are scored like
    any other (all features 0); null and repeated ids are kept; other columns are
    ignored; without usable labels of both kinds every score is the labels' share.
    """
    model = train(docs, labels)
    slim = docs.select("doc_id", "text")
    scored = with_score(slim, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return with_score(docs, train(docs, labels), name=name).where(F.col(name) >= threshold).drop(name)
