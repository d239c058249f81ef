"""MinHash near-duplicates with sequential Bayesian verification.

Documents of the same words in the same order form a class; class representatives meet in
the buckets of banded signatures.  Candidates compare their signatures batch by batch and
are dropped once the posterior chance that they are similar falls below the
chosen miss probability; survivors are confirmed on their full shingle sets.

No bucket emits all its pairs.  First every member meets its bucket's pivot; what is
confirmed merges.  Then only pairs across the components of a bucket are left; of
these the ones with a member outside the bucket's largest component suffice, and
odd sketches of the sets rule out most of them exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components
from .words import mixed, runs, word_hashes

#: Up to so many ids are sent to the scan of the texts; more meet the texts in a shuffle.
BROADCAST_IDS = 500_000
#: 64-bit words of a set's odd sketch.
ODD_WORDS = 8
_MASKS = np.random.default_rng(8_191).integers(0, 1 << 32, (2, 4096), dtype=np.uint32)


@dataclass(frozen=True)
class NearSpec:
    """Links: ``words``-word shingles with 100 * intersection >= ``percent`` * union.
    ``bands`` of ``rows`` minima make candidates; ``miss``: chance at which a pair of
    sufficient similarity may be dropped by a comparison of signatures, in ``batch`` steps."""

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    batch: int = 16
    miss: float = 1e-7

    @property
    def size(self) -> int:
        return -(-self.bands * self.rows // self.batch) * self.batch


def shingles(raw: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; of a shorter text, of the whole sequence."""
    h, _, _ = word_hashes(raw.lower())
    if not len(h):
        return h
    return np.unique(runs(h, words) if len(h) >= words else runs(h, len(h)))


def shingle_set(text: str | bytes, words: int) -> set:
    """The shingles themselves."""
    w = (text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")).lower().split()
    if len(w) < words:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(words))))


def signature(s: np.ndarray, size: int) -> np.ndarray:
    """``size`` minima of multiplicative hashes of the set."""
    h = (s >> np.uint64(32)).astype(np.uint32)
    a, b = (_MASKS[0, :size] | 1)[:, None], _MASKS[1, :size, None]
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 2048):
        np.minimum(out, (h[None, i : i + 2048] * a + b).min(axis=1), out=out)
    return out


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """Of ODD_WORDS * 64 cells by the elements' low bits, which hold an odd number of them."""
    cells = np.bincount((s & np.uint64(64 * ODD_WORDS - 1)).astype(np.int64), minlength=64 * ODD_WORDS)
    return np.packbits((cells & 1).astype(np.uint8), bitorder="little").view(np.int64)


@lru_cache(maxsize=16)
def least_matches(percent: int, size: int, batch: int, miss: float) -> tuple[int, ...]:
    """After each batch, the least number of equal entries with which a pair stays.

    With a uniform prior and m of n entries equal, the similarity is distributed as
    Beta(m + 1, n - m + 1); it reaches t with the chance that a binomial of n + 1
    trials of chance t gives m or less.
    """
    t, out = percent / 100, []
    for n in range(batch, size + 1, batch):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def _sketch(spec: NearSpec):
    weights = mixed(np.arange(1, spec.bands * spec.rows + 1, dtype=np.uint64)) | np.uint64(1)
    weights = weights.reshape(spec.bands, spec.rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digest, bands, sig, odd = [], [], [], [], []
            for t in b.column(1):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass").lower()
                s = shingles(raw, spec.words)
                n.append(len(shingle_set(raw, spec.words)))  # of the shingles themselves, not their hashes
                if not len(s):
                    digest.append(None), bands.append(None), sig.append(None), odd.append(None)
                    continue
                m = signature(s, spec.size)
                rows = m[: spec.bands * spec.rows].astype(np.uint64).reshape(spec.bands, spec.rows)
                digest.append(hashlib.blake2b(b" ".join(raw.split()), digest_size=16).digest())
                bands.append(mixed((rows * weights).sum(axis=1, dtype=np.uint64) + weights[:, 0]).view(np.int64))
                sig.append((m & 255).astype(np.uint8).tobytes())
                odd.append(odd_sketch(s))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary()), pa.array(odd, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "bands", "sig", "odd"])

    return run


def _bayes(spec: NearSpec):
    least = least_matches(spec.percent, spec.size, spec.batch, spec.miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, spec.size) for c in (b.column(2), b.column(3)))
            alive, equal = np.arange(len(x)), np.zeros(len(x), np.int64)
            for k, m in enumerate(least):
                part = slice(k * spec.batch, (k + 1) * spec.batch)
                equal[alive] += (x[alive, part] == y[alive, part]).sum(axis=1)
                alive = alive[equal[alive] >= m]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(alive)), b.column(1).take(pa.array(alive)), pa.array(equal[alive], pa.int32())], names=["a", "b", "equal"])

    return run


def _confirm(spec: NearSpec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, set] = {}

        def of(text: str) -> set:
            if text not in last:
                if len(last) >= 16:
                    last.pop(next(iter(last)))
                last[text] = shingle_set(text, spec.words)
            return last[text]

        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                s, t = of(x.as_py()), of(y.as_py())
                both = len(s & t)
                ok.append(both > 0 and 100 * both >= spec.percent * (len(s) + len(t) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return run


class _Candidates:
    """Verification of pairs of representatives of ``docs``."""

    def __init__(self, docs: DataFrame, reps: DataFrame, spec: NearSpec):
        self.docs, self.reps, self.spec = docs, reps, spec

    def prune(self, pairs: DataFrame) -> DataFrame:
        """(a, b, equal): pairs that the signatures don't rule out."""
        one = self.reps.select(F.col("rep").alias("a"), F.col("sig").alias("sa"))
        two = self.reps.select(F.col("rep").alias("b"), F.col("sig").alias("sb"))
        met = pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb")
        return met.mapInArrow(_bayes(self.spec), "a long, b long, equal int")

    def texts(self, ids: DataFrame) -> DataFrame:
        """(id, text) of the documents in ``ids``."""
        ids = materialize(ids.distinct(), "near-ids")
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        rows = self.docs.select(F.col("doc_id").cast("long").alias("id"), "text").where(F.col("text").isNotNull())
        return materialize(rows.join(ids, "id", "left_semi"), "near-texts")

    def confirm(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """(a, b): the pairs whose full shingle sets are similar enough."""
        one = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
        two = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
        met = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "ta", "tb")
        return met.mapInArrow(_confirm(self.spec), "a long, b long")


def _labelled(rows: DataFrame, components: DataFrame, node: str, as_: str) -> DataFrame:
    c = components.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    return rows.join(c, F.col(node) == F.col("_n"), "left").withColumn(as_, F.coalesce("_c", node)).drop("_n", "_c")


def _crossing(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """The pairs that lie in two components."""
    out = _labelled(_labelled(pairs, components, "a", "ca"), components, "b", "cb")
    return out.where("ca != cb").drop("ca", "cb")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))


def _open(placed: DataFrame) -> DataFrame:
    """Rows (key, rep, c) of the buckets that hold several components c, with the largest as ``large``."""
    sizes = placed.groupBy("key", "c").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("m", "c"))["c"].alias("large")).where("parts > 1")
    return placed.join(materialize(largest.select("key", "large"), "near-largest"), "key")


def _across(open_: DataFrame, spec: NearSpec) -> DataFrame:
    """Pairs of a bucket that could still link two of its components.

    Bits that differ between two odd sketches are no more than the shingles that
    differ, so pairs with too many of them are left out exactly.  Of the others,
    those with a member outside the largest component suffice.
    """
    bits = [f"o{i}" for i in range(ODD_WORDS)]
    x = open_.where("c != large").select("key", F.col("rep").alias("x"), F.col("c").alias("cx"), F.col("size").alias("sx"), *(F.col(o).alias(f"x{o}") for o in bits))
    y = open_.select(F.col("key").alias("k"), F.col("rep").alias("y"), F.col("c").alias("cy"), "large", F.col("size").alias("sy"), *(F.col(o).alias(f"y{o}") for o in bits))
    differ = sum((F.bit_count(F.col(f"x{o}").bitwiseXOR(F.col(f"y{o}"))) for o in bits), F.lit(0))
    possible = differ * (100 + spec.percent) <= (F.col("sx") + F.col("sy")) * (100 - spec.percent)
    met = (F.col("key") == F.col("k")) & (F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("large")) | (F.col("x") < F.col("y"))) & possible
    return x.join(y, met).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def link_classes(docs: DataFrame, reps: DataFrame, spec: NearSpec, known: DataFrame) -> DataFrame:
    """(node, component) of the representatives (rep, size, bands, sig, odd) that have links; ``known``: links (a, b) told beforehand."""
    check = _Candidates(docs, reps, spec)
    keyed = reps.select("rep", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min_by("rep", F.xxhash64("rep", "key")).alias("pivot")).where("n > 1")
    members = materialize(keyed.join(materialize(buckets, "near-buckets"), "key"), "near-members")

    pairs = members.where("rep != pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    pairs = materialize(pairs, "near-pairs")
    likely = materialize(check.prune(pairs), "near-likely")
    texts = check.texts(_ends(likely))

    # each document's likeliest pair first; of the others, those that still join two components
    ends = likely.select(F.col("a").alias("x"), "*").unionByName(likely.select(F.col("b").alias("x"), "*"))
    best = ends.groupBy("x").agg(F.max(F.struct("equal", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))).alias("p"))
    best = best.select((-F.col("p.a")).alias("a"), (-F.col("p.b")).alias("b")).distinct()
    links = materialize(check.confirm(best, texts).unionByName(known), "near-links")
    components = materialize(connected_components(links), "near-components")
    more = materialize(check.confirm(_crossing(likely, components), texts), "near-links")
    components = materialize(connected_components(links.unionByName(more)), "near-components")

    # buckets of three and more that still hold several components
    placed = _labelled(members.where("n > 2").select("key", "rep"), components, "rep", "c")
    open_ = materialize(_open(placed), "near-open")
    odd = reps.select("rep", "size", *(F.get("odd", F.lit(i)).alias(f"o{i}") for i in range(ODD_WORDS)))
    open_ = open_.join(odd, "rep")
    across = _across(open_, spec).join(pairs, ["a", "b"], "left_anti")  # those were compared above
    likely = materialize(check.prune(across), "near-likely")
    if likely.isEmpty():
        return components
    last = materialize(check.confirm(likely, check.texts(_ends(likely))), "near-links")
    return connected_components(links.unionByName(more).unionByName(last))


def near_duplicates(docs: DataFrame, spec: NearSpec = NearSpec()) -> DataFrame:
    """Components of near-duplicate documents.

    Returns one row per row of ``docs``: doc_id, n_shingles (size of its set),
    component_id (smallest id that it reaches by links, itself included) and kept
    (doc_id = component_id).  Texts are lower-cased in A-Z and cut at ASCII white space;
    null texts and texts without words have empty sets and link with nothing, a text of
    fewer words than a shingle has its whole sequence as one.  Rows with a null id link
    with nothing, have a null component and are kept; rows that share an id are one
    document; other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = rows.mapInArrow(_sketch(spec), "doc_id long, n_shingles long, digest binary, bands array<long>, sig binary, odd array<long>")
    sketched = materialize(sketched, "near-sketches")
    known = sketched.where(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    classes = materialize(known.groupBy("digest").agg(F.min("doc_id").alias("rep")), "near-reps")
    first = known.join(classes.select(F.col("digest").alias("d"), "rep"), (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("rep")))
    reps = materialize(first.select("digest", "rep", F.col("n_shingles").alias("size"), "bands", "sig", "odd").dropDuplicates(["digest"]), "near-classes")
    # rows that share an id but not their words: the id links their classes
    named = known.select("doc_id", "digest").groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high"), F.count("*").alias("n")).where("low != high")
    named = materialize(named.select(F.col("doc_id").alias("shared")), "near-shared")
    of_digest = classes.select(F.col("digest").alias("d"), "rep")
    shared = known.join(named, F.col("doc_id") == F.col("shared"), "left_semi").select("doc_id", "digest").join(of_digest, F.col("digest") == F.col("d"))
    shared = shared.where("doc_id != rep").select(F.greatest("doc_id", "rep").alias("a"), F.least("doc_id", "rep").alias("b")).distinct()
    components = link_classes(rows, reps, spec, shared)
    of = _labelled(reps.select(F.col("digest").alias("d"), "rep"), components, "rep", "component")
    out = sketched.select("doc_id", "n_shingles", "digest").join(of, (F.col("digest") == F.col("d")) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, spec: NearSpec = NearSpec()) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id.

    Of rows that share an id, one stays; rows with a null id all stay.
    """
    found = near_duplicates(docs, spec)
    gone = materialize(found.where(~F.col("kept")).select(F.col("component_id"), F.col("doc_id").alias("gone")), "near-gone").select("gone").distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    kept = docs.join(gone, docs["doc_id"].cast("long") == gone["gone"], "left_anti")
    twice = kept.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("twice"))
    twice = materialize(twice, "near-twice")
    if twice.isEmpty():
        return kept
    once = kept.join(twice, kept["doc_id"] == twice["twice"], "left_anti")
    return once.unionByName(kept.join(twice, kept["doc_id"] == twice["twice"], "left_semi").dropDuplicates(["doc_id"]))
