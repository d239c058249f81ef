"""Substring dedup by a log-structured fingerprint index.

A window is a run of consecutive words.  The least hash of the shorter runs in a
window is its fingerprint; equal windows have equal fingerprints, and
neighbouring windows mostly share one, so a document has few.  Every batch of documents becomes a
sorted immutable run of (fingerprint, count), bucketed by fingerprint; runs are merge-joined
with each new batch and compacted, and no run moves for either.  Windows whose fingerprint
occurs once in the index are unique; all others are verified by the words themselves: by a
128-bit cryptographic digest of each window's words, which is only made for them.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import delete_paths
from .common import materialize, new_path, release
from .words import runs, word_hashes

#: Fingerprints that occur so often have each of their windows dealt by itself.
HOT_PRINT = 2048
#: Fingerprints of a bucket of the index, about.
BUCKET_PRINTS = 1 << 20


@dataclass(frozen=True)
class WindowSpec:
    """``words`` a window; ``inner`` words a fingerprinted run; ``batches`` in which a
    table enters the index; ``fan_in`` runs are compacted into one."""

    words: int = 35
    inner: int = 8
    batches: int = 3
    fan_in: int = 2


def _slide(a: np.ndarray, k: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every k consecutive values."""
    size = 1
    while 2 * size <= k:
        a = pick(a[:-size], a[size:])
        size *= 2
    return a if size == k else pick(a[: len(a) - (k - size)], a[k - size :])


def window_prints(h: np.ndarray, spec: WindowSpec) -> tuple[np.ndarray, np.ndarray]:
    """(inner hashes, fingerprint of each window) of a text's word hashes."""
    g = runs(h, spec.inner)
    if len(h) < spec.words:
        return g, np.zeros(0, np.uint64)
    return g, _slide(g, spec.words - spec.inner + 1, np.minimum)


def fingerprints(h: np.ndarray, spec: WindowSpec) -> np.ndarray:
    """The fingerprint at every place that is least in one of its windows, repeats included."""
    g, w = window_prints(h, spec)
    if not len(w):
        return w
    span = spec.words - spec.inner
    low = np.concatenate((np.zeros(span, np.uint64), w, np.zeros(span, np.uint64)))
    return g[_slide(low, span + 1, np.maximum) == g]


def _raw(text) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


def _keys(docs: DataFrame) -> tuple[Column, Column]:
    """128 bits that tell rows of different id or text apart; rows that share both are copies of each other."""
    return F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2")


def _sketch(spec: WindowSpec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sha, prints = [], [], []
            for t in b.column(3):
                raw = _raw(t)
                h, _, _ = word_hashes(raw)
                n.append(len(h))
                sha.append(hashlib.sha256(b" ".join(raw.split())).hexdigest())
                prints.append(fingerprints(h, spec).view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64()), pa.array(sha), pa.array(prints, pa.list_(pa.int64()))], names=["doc_id", "k1", "k2", "n_words", "sha", "prints"])

    return run


def _candidates(h: np.ndarray, prints: np.ndarray, spec: WindowSpec) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, mask of those in ``prints``) of the windows."""
    _, w = window_prints(h, spec)
    known = np.sort(prints.view(np.uint64))
    at = np.searchsorted(known, w)
    return w, (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == w)


def window_digests(raw: bytes, at: list[int], words: int) -> bytes:
    """16 bytes for each window of ``words`` words that starts at one of ``at``: a digest of its words."""
    own = raw.split()
    text = b" ".join(own)
    start = np.concatenate(([0], np.cumsum([len(w) + 1 for w in own]))).tolist()
    blake = hashlib.blake2b
    return b"".join([blake(text[start[i] : start[i + words] - 1], digest_size=16).digest() for i in at])


def _windows(spec: WindowSpec):
    """Per run of windows with one repeated fingerprint: their digests; equal runs of a batch become one of weight 2.

    Windows of a hot fingerprint are rows of their own, dealt by ``salt``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[tuple[int, int, bytes], list[int]] = {}
            for k1, k2, t, p, hot in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), b.column(4)):
                raw = _raw(t)
                h, _, _ = word_hashes(raw)
                w, mask = _candidates(h, p.values.to_numpy(zero_copy_only=False), spec)
                at = np.flatnonzero(mask)
                if not len(at):
                    continue
                own, place = window_digests(raw, at.tolist(), spec.words), np.cumsum(mask) - 1
                often = set(hot.as_py() or ())
                edge = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1], [True])))
                signed = w.view(np.int64)
                for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    if mask[i]:
                        one, first = int(signed[i]), 16 * int(place[i])
                        alone = one in often
                        step = 1 if alone else j - i
                        for k in range(0, j - i, step):
                            code = own[first + 16 * k : first + 16 * (k + step)]
                            told = found.setdefault((one, code[0] + 1 if alone else 0, code), [0, k1, k2, i + k])
                            told[0] = min(2, told[0] + 1)
            flat = np.frombuffer(b"".join([k[2] for k in found]), "<i8").reshape(-1, 2)
            sizes = np.cumsum([0] + [len(k[2]) // 16 for k in found])
            codes = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["a", "b"]))
            cols = [pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.int32()), *(pa.array([v[i] for v in found.values()], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64())))]
            yield pa.RecordBatch.from_arrays([*cols, codes], names=["print", "salt", "weight", "k1", "k2", "at", "windows"])

    return run


_WINDOWS = "print long, salt int, weight int, k1 long, k2 long, at long, windows array<struct<a: long, b: long>>"


def _cut(spec: WindowSpec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, removed, kept_text, sha = [], [], [], []
            for t, p, u in zip(b.column(2), b.column(3), b.column(4)):
                raw = _raw(t)
                h, _, _ = word_hashes(raw)
                _, mask = _candidates(h, p.values.to_numpy(zero_copy_only=False), spec)
                if u.is_valid:
                    mask[u.values.to_numpy(zero_copy_only=False)] = False
                step = np.zeros(len(h) + 1, np.int64)
                at = np.flatnonzero(mask)
                np.add.at(step, at, 1)
                np.add.at(step, at + spec.words, -1)
                keep = np.cumsum(step)[:-1] == 0
                words = raw.split()
                text = b" ".join([w for w, k in zip(words, keep.tolist()) if k])
                total.append(len(h))
                removed.append(int(len(h) - keep.sum()))
                sha.append(hashlib.sha256(text).hexdigest())
                kept_text.append(text.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_text, pa.string())], names=["k1", "k2", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


class FingerprintIndex:
    """Sorted immutable runs of (print, n), bucketed by print, and the batches of documents behind them.

    With a ``path`` the index outlives the session: a manifest, written anew after every change,
    names its runs and batches, so a lost driver leaves the state of the last whole change.
    Without one it lives in the shared folder and goes with the driver.  Old runs are only ever
    read bucket by bucket: neither the merge join with a new run nor the compaction shuffles them.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fan_in: int = 2, buckets: int | None = None):
        self.spark, self.path, self.fan_in = spark, path or new_path(spark, "print-index"), fan_in
        self.kept = path is not None
        self.buckets, self.runs, self.batches, self.version = buckets, [], [], 0
        if self.kept:
            self._open()

    # ---- state

    def _folder(self) -> tuple:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _open(self) -> None:
        path, fs = self._folder()
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        jvm = self.spark.sparkContext._jvm
        whole = sorted(n for n in names if n.startswith("manifest-") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))
        if whole:
            told = json.loads(self.spark.read.text(f"{self.path}/{whole[-1]}").first()[0])
            self.version, self.buckets, self.runs, self.batches = told["version"], told["buckets"], told["runs"], told["batches"]

    def _save(self) -> None:
        if self.kept:
            self.version += 1
            told = json.dumps({"version": self.version, "buckets": self.buckets, "runs": self.runs, "batches": self.batches})
            self.spark.createDataFrame([(told,)], "value string").coalesce(1).write.text(f"{self.path}/manifest-{self.version:08}")

    # ---- runs

    def read(self, run: str) -> DataFrame:
        """A run as a bucketed table; one written by another session is made known to this one's catalogue."""
        if not self.spark.catalog.tableExists(run):
            self.spark.sql(f"CREATE TABLE {run} (print BIGINT, n BIGINT) USING parquet LOCATION '{self.path}/{run}' CLUSTERED BY (print) SORTED BY (print) INTO {self.buckets} BUCKETS")
        return self.spark.table(run)

    def _write(self, rows: DataFrame) -> str:
        run = f"print_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "print").sortBy("print").option("path", f"{self.path}/{run}").option("compression", "zstd").saveAsTable(run)
        return run

    def _delete(self, runs: list[str]) -> None:
        for r in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {r}")
        delete_paths(self.spark, [f"{self.path}/{r}" for r in runs])

    def again(self, new: DataFrame, run: str) -> DataFrame:
        """Of ``new``'s fingerprints those that ``run`` holds: a merge join in which ``run`` stays where it is."""
        old = self.read(run).select(F.col("print").alias("p"), F.col("n").alias("m"))
        return new.join(old.hint("merge"), F.col("print") == F.col("p")).select("print", (F.col("n") + F.col("m")).alias("n"))

    def add(self, prints: DataFrame) -> DataFrame:
        """Adds a batch of fingerprints (column print, one row each occurrence) as a run.

        Returns (print, n) of those of the batch that occur again, in the batch or in earlier runs:
        the new run is merge-joined with each of these.  Counts are summed before they are dealt to
        buckets, so a frequent fingerprint shrinks first.
        """
        counts = prints.groupBy("print").agg(F.count("*").alias("n"))
        if self.buckets is None:
            counts = materialize(counts, "print-counts")
            self.buckets = max(8, min(65_536, 1 << (counts.count() // BUCKET_PRINTS).bit_length()))
        run = self._write(counts.repartition(self.buckets, "print"))
        new = self.read(run)
        found = new.where("n > 1")
        for old in self.runs:
            found = found.unionByName(self.again(new, old))
        found = materialize(found.groupBy("print").agg(F.max("n").alias("n")), "print-again")  # compaction deletes the runs that it reads
        self.runs.append(run)
        if len(self.runs) > self.fan_in:
            self.compact()
        self._save()
        return found

    def compact(self) -> None:
        """Merges all runs into one, bucket by bucket, and deletes them."""
        if len(self.runs) > 1:
            rows = self.read(self.runs[0])
            for r in self.runs[1:]:
                more = self.read(r).select(F.col("print").alias("p"), F.col("n").alias("m"))
                rows = rows.join(more.hint("merge"), F.col("print") == F.col("p"), "full_outer")
                rows = rows.select(F.coalesce("print", "p").alias("print"), (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
                old, self.runs = self.runs[:2], [self._write(rows), *self.runs[2:]]
                self._save()
                self._delete(old)
                rows = self.read(self.runs[0])

    def drop(self) -> None:
        """Deletes all runs."""
        self._delete(self.runs)
        self.runs = []

    def repeated(self) -> DataFrame:
        """Fingerprints that occur more than once in the whole index."""
        self.compact()
        return self.read(self.runs[0]).where("n > 1").select("print")

    # ---- documents behind the runs, for verification

    def keep(self, sketch: DataFrame, rows: DataFrame) -> None:
        """Stores a batch's fingerprints and texts, against which later batches are verified."""
        batch = f"batch-{uuid.uuid4().hex}"
        sketch.select("k1", "k2", "prints").write.option("compression", "zstd").parquet(f"{self.path}/{batch}/prints")
        rows.select("k1", "k2", "text").write.option("compression", "zstd").parquet(f"{self.path}/{batch}/texts")
        self.batches.append(batch)
        self._save()

    def history(self) -> list[tuple[DataFrame, DataFrame]]:
        """(fingerprints, texts) of each stored batch."""
        read = self.spark.read.parquet
        return [(read(f"{self.path}/{b}/prints"), read(f"{self.path}/{b}/texts")) for b in self.batches]


def _met(sketch: DataFrame, rows: DataFrame, again: DataFrame) -> DataFrame:
    """(k1, k2, text, prints, hot) of the documents with fingerprints that occur again."""
    # a text's repeats of one print (a word over and over) are one row
    posted = sketch.select("k1", "k2", F.explode(F.array_distinct("prints")).alias("print")).join(again, "print")
    hot = F.collect_set(F.when(F.col("n") >= HOT_PRINT, F.col("print")))
    wanted = posted.groupBy("k1", "k2").agg(F.collect_set("print").alias("prints"), hot.alias("hot"))
    wanted = materialize(wanted, "print-wanted")
    release(sketch.sparkSession)
    met = materialize(rows.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "prints", "hot"), "print-texts")
    release(sketch.sparkSession)
    return met


def _judged(docs: DataFrame, spec: WindowSpec, index: FingerprintIndex | None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k1, k2, n_words, sha) of all rows, and (k1, k2, n_removed, kept_sha256, kept_text) of those with candidates."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", *_keys(docs), "text")
    sketch = rows.mapInArrow(_sketch(spec), f"doc_id {kind}, k1 long, k2 long, n_words long, sha string, prints array<long>")
    sketch = materialize(sketch, "print-sketch")

    known, again = index or FingerprintIndex(spark, fan_in=spec.fan_in), None
    past = known.history()
    for i in range(spec.batches):
        part = sketch.where(F.pmod(F.col("k1"), F.lit(spec.batches)) == i)
        found = known.add(part.select(F.explode("prints").alias("print")))
        again = found if again is None else again.unionByName(found)
    again = materialize(again.groupBy("print").agg(F.max("n").alias("n")), "print-again")
    if index is None:
        known.drop()
    else:
        known.keep(sketch, rows)
    release(spark)

    met = _met(sketch, rows, again)
    all_ = met.select("k1", "k2", "text", "prints", "hot")
    for old_sketch, old_rows in past:  # their windows count, but are not judged again
        old = _met(old_sketch, old_rows, again)
        all_ = all_.unionByName(old.withColumn("k1", F.lit(None).cast("long")).withColumn("k2", F.lit(None).cast("long")))
    told = all_.mapInArrow(_windows(spec), _WINDOWS).repartition("print", "salt")
    each = told.select("print", "salt", "weight", "k1", "k2", "at", F.posexplode("windows").alias("i", "w"))
    # the shuffle by print and salt serves this grouping
    once = each.groupBy("print", "salt", F.col("w.a").alias("a"), F.col("w.b").alias("b")).agg(F.sum("weight").alias("n"), F.min("k1").alias("k1"), F.min("k2").alias("k2"), F.min(F.col("at") + F.col("i")).alias("pos"))
    once = materialize(once.where("n = 1 and k1 is not null").groupBy("k1", "k2").agg(F.collect_list("pos").alias("unique")), "print-unique")
    release(spark)
    cut = met.join(once, ["k1", "k2"], "left").select("k1", "k2", "text", "prints", "unique")
    cut = cut.mapInArrow(_cut(spec), "k1 long, k2 long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return sketch.select("doc_id", "k1", "k2", "n_words", "sha"), cut.where("n_removed > 0").dropDuplicates(["k1", "k2"])


def substring_dedup(docs: DataFrame, spec: WindowSpec = WindowSpec(), index: FingerprintIndex | None = None) -> DataFrame:
    """Removes each word that a window covers whose word sequence also starts anywhere else.

    Returns one row per row of ``docs``: doc_id, n_words, n_removed and kept_sha256 (of
    the kept words joined by one blank).  All copies of a repeated window go, and
    windows are judged on the input.  Null texts and texts without words have
    0 words; texts shorter than a window lose nothing; repeated rows are copies of
    each other; null ids are kept; other columns are ignored; an empty table gives an
    empty result.

    With an ``index``, the documents of its earlier batches count as well (what was said of
    those stays), and these documents join it.
    """
    rows, cut = _judged(docs, spec, index)
    cut = cut.select("k1", "k2", "n_removed", "kept_sha256")
    out = rows.join(cut, ["k1", "k2"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def without_repeats(docs: DataFrame, spec: WindowSpec = WindowSpec(), index: FingerprintIndex | None = None) -> DataFrame:
    """``docs`` with the repeated windows' words removed from ``text`` (and n_chars set anew);
    texts that lose nothing stay as they are."""
    _, cut = _judged(docs, spec, index)
    cut = cut.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("kept_text").alias("new"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), *_keys(docs))  # in one column, no name clashes
    out = rows.join(cut, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    old = {c: F.col("row")[c] for c in docs.columns}
    made = old | {"text": F.coalesce("new", old["text"])}
    if "n_chars" in old:
        made["n_chars"] = F.when(F.col("new").isNotNull(), F.length("new").cast("long")).otherwise(old["n_chars"])
    return out.select(*(v.alias(c) for c, v in made.items()))
