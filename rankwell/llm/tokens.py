"""Token counts through a digest cache.

A text is known by the SHA-256 of its normalised content, a tokenizer by the
SHA-256 of its file.  Counts are stored under both digests in a Parquet cache.
Counting joins the documents' digests to the cache, encodes one text for each
missing digest, appends those counts and joins again.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, new_path

#: Entries of a worker's chunk memo; beyond it the memo starts afresh.
MEMO_ENTRIES = 400_000
#: Longer chunks are not remembered.
MEMO_CHARS = 48
#: White space other than blank and newline, and characters on whose class regex engines differ.
_ODD = re.compile("[^\\S \\n]|[\\x1c-\\x1f\\u180e\\u200b\\u2060\\ufeff]")
_CHUNK = re.compile("[ \n]*[^ \n]+|[ \n]+")

#: Chunks for the faster encoder; the library gets all others.
_PLAIN = re.compile("[ -~\n\u00c0-\u017f]+")
#: Whole texts for it: only such characters, single white space, and runs short enough for its merging, whose time grows with their square.
_PLAIN_TEXT = re.compile("[ \n]?(?:[!-~\u00c0-\u017f]{1,255}+(?:[ \n]|\\Z))*+\\Z")
#: How byte-level pre-tokenizers cut a text into pieces; without the look-ahead, which only matters
#: where white space follows white space, a regex engine need not go back.
PLAIN_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
PIECES = PLAIN_PIECES.removesuffix(r"|\s+") + r"|\s+(?!\S)|\s+"

CACHE_SCHEMA = T.StructType(
    [T.StructField("digest", T.BinaryType()), T.StructField("version", T.StringType()), T.StructField("n_tokens", T.LongType())]
)


def _byte_letters() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


def merge_pairs(merges: list) -> list[tuple[str, str]]:
    return [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]


def _ranked(vocab: dict[str, int], merges: list):
    """Faster encoders of the same vocabulary, by PIECES and by PLAIN_PIECES, or None where ids don't follow the order of merges.

    It joins the adjacent pair whose union comes first.  That is what the merge list
    asks for if the list, applied to any token's own bytes, yields that token; a test
    holds this for the vocabulary in use.
    """
    letters = _byte_letters()
    if sorted(vocab[x] for x in letters) != list(range(256)) or any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(merge_pairs(merges))):
        return None
    import tiktoken

    byte = {x: b for b, x in enumerate(letters)}
    ranks = {bytes(byte[x] for x in t): i for t, i in vocab.items() if i < 256 + len(merges)}
    return tuple(tiktoken.Encoding("ranked", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (PIECES, PLAIN_PIECES))


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, as the tokenizer's library gives them.

    Plain whole texts go to a faster encoder of the same vocabulary, texts with special
    strings or unusual white space to the library.  The others are cut into chunks (a run of
    blanks and newlines with what follows it), which a byte-level BPE whose pre-tokenizer
    splits at every white-space run encodes each by itself: a memo of chunks gives the ids,
    and missing chunks go to the faster encoder or the library.
    """

    def __init__(self, path: str):
        self.memo: dict[str, bytes] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._whole = lambda text: model.encode(text)
            self.chunked, self.special = False, ()
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self._whole = lambda text: self.tok.encode(text, add_special_tokens=False).ids
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        pre = told.get("pre_tokenizer") or {}
        self.chunked = told.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and (told.get("model") or {}).get("dropout") is None
        if self.chunked:
            vocab, model = self.tok.get_vocab(with_added_tokens=False), told["model"]
            letters = _byte_letters()
            self.chunked = sys.byteorder == "little" and model.get("type") == "BPE" and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")) and all(x in vocab for x in letters) and max(vocab.values()) < 1 << 20
        if self.chunked:
            self.ranked, self.ranked_plain = _ranked(vocab, model["merges"]) or (None, None)
            self.chunked = self.ranked is not None
        self.special = tuple(t["content"] for t in told.get("added_tokens") or ())

    def whole(self, text: str) -> bytes:
        return np.asarray(self._whole(text), dtype="<u4").tobytes()

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of ``chunks``; short ones are remembered, long ones only returned."""
        missing = {c for c in chunks if c not in self.memo}
        if len(self.memo) + len(missing) > MEMO_ENTRIES:
            self.memo.clear()
            missing = set(chunks)
        out = {}
        for c in missing:
            short = len(c) <= MEMO_CHARS
            plain = short and _PLAIN.fullmatch(c)
            (self.memo if short else out)[c] = array("I", self.ranked.encode_ordinary(c)).tobytes() if plain else self.whole(c)
        return out

    def ids(self, text: str) -> bytes:
        if not self.chunked or any(s in text for s in self.special):
            return self.whole(text)
        if _PLAIN_TEXT.match(text):
            return array("I", self.ranked_plain.encode_ordinary(text)).tobytes()
        if _ODD.search(text):
            return self.whole(text)
        chunks, memo = _CHUNK.findall(text), self.memo
        try:
            return b"".join([memo[c] for c in chunks])
        except KeyError:
            more = self._learn(chunks)
            return b"".join([memo[c] if c in memo else more[c] for c in chunks])

    def count(self, text: str) -> int:
        return len(self.ids(text)) // 4


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder a process and tokenizer file."""
    return Encoder(path)


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file; a changed file never meets old counts."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            h.update(block)
    return h.hexdigest()


class CountCache:
    """Append-only Parquet table ``(digest, version, n_tokens)`` at ``path``.

    Each append adds files and never rewrites any, so a failed or repeated
    append leaves readers with whole counts: equal digests have equal counts.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "token-counts")

    def read(self, version: str) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], CACHE_SCHEMA).select("digest", "n_tokens")
        return self.spark.read.schema(CACHE_SCHEMA).parquet(self.path).where(F.col("version") == version).select("digest", "n_tokens")

    def append(self, counts: DataFrame, version: str) -> None:
        counts.select("digest", F.lit(version).alias("version"), F.col("n_tokens").cast("long")).write.mode("append").parquet(self.path)


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(path), set()
        for b in batches:
            digests, counts = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                if d not in seen:  # rows repeated with their id
                    seen.add(d)
                    digests.append(d)
                    counts.append(enc.count(t.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return count


def token_counts(docs: DataFrame, tokenizer: str, cache: CountCache | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text, without added special tokens.

    Returns one row per row of ``docs``: the id, ``n_bytes`` (UTF-8),
    ``n_tokens`` and ``over_limit`` (more than ``limit``).  A null text counts as
    empty (0 tokens), null ids are kept, repeated rows are returned as often as
    they occur, other columns are ignored, an empty table gives an empty result.

    Shuffles: digests (partially aggregated, so groups of copies shrink before
    they move), the texts once by id (balanced), and digests with counts; that
    last join holds whole groups of copies and is split by adaptive execution.
    """
    spark = docs.sparkSession
    cache = cache or CountCache(spark)
    version = tokenizer_version(tokenizer)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))

    known = cache.read(version)
    one = base.groupBy("digest").agg(F.min("id").alias("rep"))
    misses = one.join(known, "digest", "left_anti").select("rep", F.col("digest").alias("missing"))
    texts = base.join(misses, base["id"].eqNullSafe(misses["rep"]) & (base["digest"] == misses["missing"])).select("digest", "text")
    counted = texts.mapInArrow(_counter(tokenizer), "digest binary, n_tokens long")
    cache.append(counted.dropDuplicates(["digest"]), version)

    # written, so that the join below shuffles plain tables on both sides, which adaptive execution can split
    stored = cache.read(version).join(one.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    stored = materialize(stored, "token-stored")
    rows = base.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return rows.join(stored, "digest").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
