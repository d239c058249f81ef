"""The operators on a small corpus against brute force; nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import os
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from rankwell.llm import html, media, mixing, neardup, packing, quality, queries, substring, tokens, topk, urls
from rankwell.llm.components import connected_components
from rankwell.llm.words import runs, word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("key", "h", "size", "score", "row", "id", "digest", "bucket", "n_words", "quality", "a", "b")
RNG = random.Random(12)
VOCAB = ["".join(RNG.choice("abcdeé") for _ in range(RNG.randint(1, 7))) for _ in range(400)]


def sentence(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def corpus():
    base, shared = sentence(120), sentence(50)
    out = [None, "", "   \n", "one", "two words", "Two  WORDS", base, base, base.upper(), base.replace(" ", "\n", 9)]
    for k in range(1, 6):
        w = base.split()
        for j in range(k):
            w[(37 * j + 11 * k) % len(w)] = f"edit{k}{j}"
        out.append(" ".join(w))
    out += [sentence(40) + " " + shared + " " + sentence(30) for _ in range(3)]
    out += [sentence(RNG.randint(1, 90)) for _ in range(40)]
    out += [" ".join(["again"] * 80), sentence(6000), "x" * 30_000, "a\tb\x0bc\x0cd\re f", "日本 語 <|endoftext|> it's\u2003wide"]
    rows = [(i, t, "en", (None, "s0", "s1", "s0", "s0")[i % 5], len(t or "")) for i, t in enumerate(out)]
    return rows + [rows[12], (None, base, None, None, 3)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


WORDS = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in ROWS]


def test_word_hashes():
    for (_, t, *_), w in zip(ROWS, WORDS):
        raw = (t or "").encode()
        h, start, end = word_hashes(raw)
        assert [raw[a:b].decode() for a, b in zip(start, end)] == w
    h = word_hashes(" ".join(VOCAB).encode())[0]
    assert len(set(h.tolist())) == len(set(VOCAB))
    for k in (1, 2, 3, 5, 8, 35):
        a, b = runs(word_hashes(sentence(60).encode())[0], k), runs(word_hashes(b"q " + sentence(40).encode())[0], k)
        assert len(a) == 61 - k and len(b) == 42 - k
        text = sentence(k)
        assert runs(word_hashes(("x y " + text).encode())[0], k)[2] == runs(word_hashes((text + " z").encode())[0], k)[0]


def test_media(docs, empty):
    got = media.media_features(media.pixel_arrays(media.store(docs))).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    want = []
    for i, t, *_ in ROWS:
        raw = (t or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert collected(got) == sorted(want, key=repr)
    assert media.media_features(media.pixel_arrays(media.store(empty))).isEmpty()
    frames = media.read_media(media.store(docs.where("doc_id = 6"))).first()
    assert frames.width == 576 and len(frames.pixels) == 4 * 576 * frames.height


def test_media_one_form(spark):
    """Texts of every length around a third of a row, one row and more are stored in the same form, the smaller one."""
    texts = [None, ""] + [("word " * 300)[:n] for n in (1, 191, 192, 193, 575, 576, 577, 1400)]
    stored = media.store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = {r.doc_id: r for r in media.pixel_arrays(stored).collect()}
    frames = {r.doc_id: r for r in media.read_media(stored).collect()}
    for i, t in enumerate(texts):
        payload = media.payload_of(t)
        assert (frames[i].width, frames[i].height) == (576, len(payload) // 576)
        assert frames[i].pixels[1::4] == frames[i].pixels[::4] == frames[i].pixels[2::4] == payload == rows[i].pixels
        assert len(rows[i].media) <= len(media.encode_payload(payload))
    assert rows[0].media == rows[1].media


@pytest.fixture(scope="module")
def tokenizer():
    return queries.tokenizer_path()


@pytest.fixture(scope="module")
def library(tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(tokenizer, library):
    enc = tokens.Encoder(tokenizer)
    rng = random.Random(8)
    odd = ["a  b", " \n x", "\t a\n b", "x\x1cy", "!\x1c!", "don't 'LL", "a\u00a0b", "\u200b x", "1 22\n\n333 ", "é" * 60 + " b"]
    odd += ["".join(rng.choice(" \n\tab1!é'日\x1c") for _ in range(30)) for _ in range(300)]
    for t in odd + [t for _, t, *_ in ROWS if t]:
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == library(t)


def test_whole_texts_equal_library(tokenizer, library):
    """Plain texts take the encoder without look-ahead; texts that just fail to be plain don't."""
    enc, rng = tokens.Encoder(tokenizer), random.Random(9)
    texts = ["".join(rng.choice(" \n ab'sll1!\u00e9\u00d7\u017f") for _ in range(rng.randint(1, 40))) for _ in range(5000)]
    texts += ["a" * 255 + " b", "a" * 256 + " b", " a", "\na ", "a  b", "a \nb", "\u00bfa", sentence(3000)]
    path = "/root/testdata/sf0.01/documents.parquet"
    if os.path.exists(path):
        texts += [t for t in pq.read_table(path, columns=["text"]).column(0).to_pylist() if t]
    plain = [bool(tokens._PLAIN_TEXT.match(t)) for t in texts]
    assert 500 < sum(plain) and not any(p and re.search(r"\s\s|\S{256}", t) for p, t in zip(plain, texts))
    for t in texts:
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == library(t)


def test_merges_reproduce_every_token(tokenizer):
    """What the faster encoder rests on: the merge list turns each token's bytes into that token."""
    import json

    with open(tokenizer, encoding="utf-8") as f:
        told = json.load(f)
    rank = {p: i for i, p in enumerate(tokens.merge_pairs(told["model"]["merges"]))}
    special = {t["content"] for t in told["added_tokens"]}
    for t in told["model"]["vocab"]:
        w = list(t)
        while len(w) > 1 and t not in special:
            best = min(zip(w, w[1:]), key=lambda p: rank.get(p, 1 << 60))
            assert best in rank, t
            i = next(i for i, p in enumerate(zip(w, w[1:])) if p == best)
            w[i : i + 2] = ["".join(best)]


def test_token_counts(spark, docs, empty, tokenizer, library, tmp_path):
    cache = tokens.CountCache(spark, str(tmp_path / "cache"))
    want = sorted(((i, len((t or "").encode()), len(library(t)), len(library(t)) > 512) for i, t, *_ in ROWS), key=repr)
    assert collected(tokens.token_counts(docs, tokenizer, cache)) == want
    version = tokens.tokenizer_version(tokenizer)
    n = cache.read(version).count()
    assert n == len({t or "" for _, t, *_ in ROWS})
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(900, "brand new")], "doc_id long, text string"))
    assert tokens.token_counts(more, tokenizer, cache).count() == len(ROWS) + 1
    assert cache.read(version).count() == n + 1  # only the miss was encoded
    assert tokens.token_counts(empty, tokenizer).isEmpty()
    other = tokens.token_counts(docs.where("doc_id < 5"), queries.tokenizer_path("piece_bpe_32k.model"))
    assert other.count() == 5


def test_topk(spark):
    rng = np.random.default_rng(3)
    v = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(150)]
    for i in range(100, 130):
        v[i] = (i, v[40][1])  # ties
    v += [(151, None), (152, [1.0, None]), (153, [float("nan")] * 8), (154, [float("inf")] * 8), (160, [2.0] * 3), (160, [2.0] * 3), (180, []), (None, [1.0] * 8)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("id", F.lit("x"))
    ok = {i: [int(np.floor(64 * float(np.float32(x)))) for x in e] for i, e in v if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    want = []
    for q in ok:
        if q % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(ok[q], ok[r])), r) for r in ok if r != q)[:7]
            want += [(q, k + 1, r, -x) for k, (x, r) in enumerate(s)]
    assert collected(topk.top_k(df, k=7)) == sorted(want, key=repr)
    small = topk.top_k(df.where("vec_id < 3"), k=7)
    assert small.count() == 2
    assert topk.top_k(df.where("vec_id < 0")).isEmpty()


def test_topk_tiles(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    test_topk(spark)


def test_topk_prunes(spark):
    """Of many rows few are resolved, and nothing is lost; components of any size give exact or the nearest scores."""
    rng = np.random.default_rng(5)
    m, ids = np.floor(64 * rng.normal(size=(4000, 32))), np.arange(4000)
    side = lambda k, **more: pa.table({"id": pa.array(ids[k]), "v": pa.array(m[k].tolist(), pa.list_(pa.float64())), **more})
    exact = m[:40] @ m.T
    exact[np.arange(40), np.arange(40)] = -np.inf
    cut = np.sort(exact, axis=1)[:, -20].astype(np.int64)
    got = topk._collect(20, 4)(side(slice(0, 40), cut_score=pa.array(cut)), side(slice(0, 4000))).to_pydict()
    for q in range(40):
        best = sorted(range(4000), key=lambda r: (-exact[q, r], r))[:20]
        assert [v for a, v in zip(got["query_id"], got["vec_id"]) if a == q] == best
    huge = [(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [3e9, 1.0]), (4, [0.0, 2.0]), (20, [1.0, 1.0])]
    df = spark.createDataFrame(huge, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): (r.rank, r.score) for r in topk.top_k(df, k=5).collect()}
    assert got[0, 1] == (1, topk.HIGH) and got[0, 2] == (5, topk.LOW) and got[0, 4][1] == 64 * 128
    assert got[20, 3] == (3, 64 * 64 * 3_000_000_001) and got[20, 4][1] == 64 * 128


def make_labelled(spark):
    rng = random.Random(2)
    good = [sentence(rng.randint(20, 80), rng).capitalize() + "." for _ in range(150)]
    bad = [" ".join(w + rng.choice(["!!", "%%%", "$$$"]) for w in sentence(rng.randint(20, 80), rng).split()) for _ in range(150)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(x for p in zip(good, bad) for x in p)]
    labels = [(i, 1 - i % 2, 0) for i, *_ in rows] + [(5000, 1, 0), (None, 0, 0), (3, None, 0)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark, docs, empty):
    df, labels = make_labelled(spark)
    got = {r.doc_id: r for r in quality.score_documents(df, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert len(held) > 30 and sum(got[i].predicted == 1 - i % 2 for i in held) >= 0.97 * len(held)
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality.score_documents(df, flipped).collect()} == {i: r.score for i, r in got.items()}
    every = quality.score_documents(docs, labels).collect()  # none of these ids means the same texts: only the form counts
    assert len(every) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in every)
    none = quality.score_documents(docs, labels.where("quality = 9")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score_documents(empty, labels).isEmpty()
    assert quality.good_documents(docs, labels).columns == docs.columns


def test_pair_tables():
    rng = np.random.default_rng(1)
    x = np.zeros((4000, len(quality.FEATURES)))
    x[:, :2] = rng.random((4000, 2))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)  # no feature tells alone
    m = quality.fit(x, y)
    assert (0, 1) in [(a, b) for a, b, _ in m.pairs] and ((m.score(x) > 0.5) == y).mean() > 0.95


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    left, out, free = 1.5 * sum(sizes.values()), {}, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    while free:
        share = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
            del free[s]
    return out


@pytest.mark.parametrize("block", [256, 16])
def test_mixing(docs, empty, block):
    spec = mixing.MixSpec(block=block, shard_slots=8)
    got = mixing.mix(docs, spec).collect()
    sizes = Counter()
    for (_, _, _, s, _), w in zip(ROWS, WORDS):
        sizes[s] += len(w)
    targets = brute_targets(dict(sizes))
    assert sorted((r.doc_id is None, r.doc_id, r.size) for r in got) == sorted((i is None, i, len(w)) for (i, *_), w in zip(ROWS, WORDS))
    by = defaultdict(int)
    source = {(i, len(w)): s for (i, _, _, s, _), w in zip(ROWS, WORDS)}
    for r in got:
        s = source[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s]) and 0 <= r.taken <= 2 * r.size
        by[s] += r.taken
    assert {s: int(t) for s, t in targets.items()} == by
    assert collected(mixing.mix(docs.repartition(5), spec)) == collected(mixing.mix(docs, spec))
    assert mixing.mix(empty).isEmpty() and mixing.mixed_documents(empty).isEmpty()
    mixed = mixing.mixed_documents(docs, spec)
    assert mixed.columns == docs.columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r.source] += len(r.text.split())
    spaces = lambda w: sum(len(x.split()) for x in w)  # noqa: E731  (this count splits at other white space too)
    assert abs(sum(words.values()) - sum(by.values())) <= 4 * spaces(["a b"])


def test_permutation(spark):
    for n in (1, 2, 7, 64, 1000):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3), F.lit(1), 5).alias("p"))
        got = [r.p for r in df.collect()]
        assert sorted(got) == list(range(n)) and (n < 64 or got != list(range(n)))


def brute_substring(texts, size=35):
    where = Counter(tuple(w[k : k + size]) for w in texts for k in range(len(w) - size + 1))
    out = []
    for w in texts:
        cover = [False] * len(w)
        for k in range(len(w) - size + 1):
            if where[tuple(w[k : k + size])] > 1:
                cover[k : k + size] = [True] * size
        out.append([x for x, c in zip(w, cover) if not c])
    return out


@pytest.mark.parametrize("batches", [1, 3])
def test_substring(docs, empty, batches):
    kept = brute_substring(WORDS)
    want = [(i, len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for (i, *_), w, k in zip(ROWS, WORDS, kept)]
    assert sum(x[2] for x in want) > 500
    spec = substring.WindowSpec(batches=batches)
    assert collected(substring.substring_dedup(docs, spec)) == sorted(want, key=repr)
    if batches == 1:
        assert substring.substring_dedup(empty).isEmpty()
        out = substring.without_repeats(docs)
        assert out.columns == docs.columns
        texts = Counter((r.doc_id, r.text) for r in out.collect())
        assert texts == Counter((i, t if len(w) == len(k) else " ".join(k)) for (i, t, *_), w, k in zip(ROWS, WORDS, kept))


def test_index_runs(spark, tmp_path):
    index = substring.FingerprintIndex(spark, str(tmp_path / "index"), fan_in=2)
    batch = lambda *p: spark.createDataFrame([(x,) for x in p], "print long")
    again = lambda df: sorted((r.print, r.n) for r in df.collect())
    assert again(index.add(batch(1, 2, 2))) == [(2, 2)]
    assert again(index.add(batch(1, 3))) == [(1, 2)]
    assert again(index.add(batch(3, 4, 5))) == [(3, 2)] and len(index.runs) == 1
    for r in index.runs:  # as another session finds it: files and manifest only
        spark.sql(f"DROP TABLE {r}")
    index = substring.FingerprintIndex(spark, str(tmp_path / "index"))
    assert again(index.add(batch(4))) == [(4, 2)]
    assert sorted(r.print for r in index.repeated().collect()) == [1, 2, 3, 4]
    index.drop()


def test_index_runs_stay_in_place(spark):
    """Neither the merge join with a new run nor the compaction exchanges rows of the runs."""
    index = substring.FingerprintIndex(spark, buckets=8, fan_in=9)
    for k in range(3):
        index.add(spark.range(k * 50, k * 50 + 80).select(F.col("id").alias("print")))
    plan = index.again(index.read(index.runs[2]), index.runs[0])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert sorted(r.print for r in index.repeated().collect()) == [*range(50, 80), *range(100, 130)]
    index.drop()


def test_substring_in_two_calls(spark, tmp_path):
    """Later documents are judged against those of earlier calls, from another session's view of the index."""
    shared, other = sentence(45), sentence(40)
    first = [(1, shared + " " + sentence(20)), (2, sentence(80)), (3, other)]
    later = [(4, sentence(10) + " " + shared), (5, sentence(60)), (6, sentence(5) + " " + other + " " + sentence(3))]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path / "index")
    got = substring.substring_dedup(frame(first), index=substring.FingerprintIndex(spark, path)).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0, 3: 0}
    index = substring.FingerprintIndex(spark, path)
    for r in index.runs:
        spark.sql(f"DROP TABLE {r}")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.substring_dedup(frame(later), index=index).collect()}
    assert got == {4: (55, 45), 5: (60, 0), 6: (48, 40)}


def twins(n):
    """n pairs of words that a polynomial modulo a power of two can't tell apart."""
    odd = [bin(i).count("1") % 2 for i in range(1024)]
    return ["".join("xy"[b ^ k] for b in odd) for k in range(2)] * n


def test_windows_are_verified_on_words(spark, monkeypatch):
    a, b = twins(1)
    tail = sentence(34)
    df = spark.createDataFrame([(1, f"{a} {tail}"), (2, f"{b} {tail}")], "doc_id long, text string")
    assert {r.n_removed for r in substring.substring_dedup(df).collect()} == {0}
    # even where all words hash alike, the words decide
    sub = lambda raw: (np.ones(len(raw.split()), np.uint64), None, None)
    w, mask = substring._candidates(sub(f"{a} {tail}".encode())[0], substring.fingerprints(sub(tail.encode() + b" q")[0], substring.WindowSpec()).view(np.int64), substring.WindowSpec())
    assert mask.all()
    assert substring.window_digests(f"{a} {tail}".encode(), [0], 35) != substring.window_digests(f"{b} {tail}".encode(), [0], 35)
    assert substring.window_digests(f"z {a}\n {tail}".encode(), [1], 35) == substring.window_digests(f"{a} {tail} z".encode(), [0], 35)


def test_periodic_texts(spark):
    """Runs of one window and runs of many share their windows."""
    rows = [(n, " ".join((sentence(n).split() * 9)[:length])) for n, length in ((30, 150), (32, 160), (7, 40), (34, 71), (36, 71), (36, 107))]
    want = {i: len(t.split()) - len(k) for (i, t), k in zip(rows, brute_substring([t.split() for _, t in rows]))}
    got = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == sorted((i, len(t.split()) - len(k)) for (i, t), k in zip(rows, brute_substring([t.split() for _, t in rows]))) and sum(want.values()) > 300


def test_hot_prints(spark, monkeypatch):
    monkeypatch.setattr(substring, "HOT_PRINT", 3)
    shared = sentence(50)
    rows = [(i, f"{sentence(19)} before{i} {shared} after{i} {sentence(19)}") for i in range(12)]  # no two share the words next to the passage
    want = {i: len(t.split()) - len(k) for (i, t), k in zip(rows, brute_substring([t.split() for _, t in rows]))}
    got = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == want and set(want.values()) == {50}


def brute_components(sets, ids, percent):
    best = list(range(len(sets)))

    def root(x):
        while best[x] != x:
            x = best[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if ids[a] == ids[b] or both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                best[max(root(a), root(b))] = min(root(a), root(b))
    low = defaultdict(list)
    for a in range(len(sets)):
        low[root(a)].append(ids[a])
    return [min(low[root(a)]) for a in range(len(sets))]


@pytest.mark.parametrize(("words", "percent", "bands", "rows"), [(3, 85, 25, 5), (5, 80, 32, 4)])
def test_near_duplicates(docs, empty, words, percent, bands, rows):
    spec = neardup.NearSpec(words, percent, bands, rows)
    known = [(i, t) for i, t, *_ in ROWS if i is not None]
    sets = [neardup.shingle_set("".join(c.lower() if c.isascii() else c for c in t or ""), words) for _, t in known]
    low = brute_components(sets, [i for i, _ in known], percent)
    want = [(i, len(s), c, i == c) for (i, _), s, c in zip(known, sets, low)]
    got = neardup.near_duplicates(docs, spec)
    assert collected(got.where("doc_id is not null")) == sorted(want, key=repr)
    assert [tuple(r)[2:] for r in got.where("doc_id is null").collect()] == [(None, True)]
    assert len({c for c in low if low.count(c) > 2}) >= 1
    if words == 5:
        assert neardup.near_duplicates(empty).isEmpty()
        out = neardup.without_near_duplicates(docs, spec)
        assert out.columns == docs.columns
        assert sorted((r.doc_id for r in out.where("doc_id is not null").collect())) == sorted({i for i, _, c, k in want if k})


def test_near_sets_not_hashes(spark):
    """Disjoint sets of words that weak hashes confuse stay apart; equal sets in another order, and rows that share an id, are linked."""
    a, b = twins(1)
    w = sentence(30).split()
    rows = [(1, a), (2, b), (3, " ".join(w)), (5, "\n ".join(x.upper() if x.isascii() else x for x in w)), (5, sentence(40)), (7, "p q r p q r p q r s"), (8, "p q r p q r s")]
    rows += [(4, rows[4][1]), (9, None), (10, a.upper())]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), neardup.NearSpec(3, 85, 25, 5)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2), (3, 3), (4, 3), (5, 3), (5, 3), (7, 7), (8, 7), (9, 9), (10, 1)]
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id in (1, 7, 8, 9)} == {1: 1, 7: 4, 8: 4, 9: 0}


def test_near_recall_against_all_pairs(spark):
    """Every link of a whole table is found: all pairs by an inverted index of shingles, within the contract's similarity."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(path, columns=["doc_id", "text"]).to_pylist()]
    sets = [neardup.shingle_set(t or "", 3) for _, t in rows]
    low = brute_components_by_index(sets, [i for i, _ in rows], 85)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), neardup.NearSpec(3, 85, 25, 5)).collect()
    assert {r.doc_id: r.component_id for r in got} == low and len(set(low.values())) < len(low)


def brute_components_by_index(sets, ids, percent):
    by, root = defaultdict(list), {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, s in enumerate(sets):
        common = Counter(j for g in s for j in by[g])
        for j, both in common.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = find(ids[k]), find(ids[j])
                root[max(a, b)] = min(a, b)
        for g in s:
            by[g].append(k)
    return {i: find(i) for i in ids}


def test_near_group_without_all_pairs(spark):
    """A group whose members are linked only through some of the others, and a bucket full of strays."""
    rng = random.Random(4)
    base = [rng.choice(VOCAB) + str(i) for i in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for j in rng.sample(range(150), rng.choice([0, 1, 2, 3, 6, 9])):
            w[j] = f"n{i}x{j}"
        rows.append((i, " ".join(w)))
    sets = [neardup.shingle_set(t, 3) for _, t in rows]
    low = brute_components(sets, [i for i, _ in rows], 85)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(df, neardup.NearSpec(3, 85, 25, 5)).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(low)) and 1 < len(set(low)) < 120


def test_bayes_bounds():
    least = neardup.least_matches(85, 128, 16, 1e-7)
    assert list(least) == sorted(least) and 0 < least[0] < 14 and 60 < least[-1] < 109
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 1 << 64, 2000, dtype=np.uint64))
    b = np.unique(np.concatenate((a[:1840], rng.integers(0, 1 << 64, 160, dtype=np.uint64))))
    same = (neardup.signature(a, 4096) == neardup.signature(b, 4096)).mean()
    assert abs(same - 1840 / 2160) < 0.03
    diff = np.unpackbits((neardup.odd_sketch(a) ^ neardup.odd_sketch(b)).view(np.uint8)).sum()
    assert diff <= 320


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        if len(seen) > 1:
            assert got[n] == min(seen)


@pytest.mark.parametrize("kind", ["one length", "spread", "none", "ones"])
def test_packing_plan(kind):
    counts = np.zeros(1024, np.int64)
    if kind == "one length":
        counts[700] = 1001
    elif kind == "spread":
        counts[1:] = np.random.default_rng(1).integers(0, 9, 1023)
        counts[333] = 4000
    elif kind == "ones":
        counts[1] = 3000
    cover, seqs = defaultdict(list), defaultdict(list)
    for c, lo, hi, start, length, sequence, mult, at in packing.plan(counts):
        for i in range(lo, hi):
            cover[c, i].append((start, length))
            seqs[sequence + (i - lo) // mult].append((at + (i - lo) % mult * length, length))
    for (c, i), parts in cover.items():
        end = 0
        for s, n in sorted(parts):
            assert s == end
            end += n
        assert end == c and i < counts[c]
    assert len(cover) == counts.sum() and sorted(seqs) == list(range(len(seqs)))
    for parts in seqs.values():
        end = 0
        for s, n in sorted(parts):
            assert s == end
            end += n
        assert end & (end - 1) == 0


def test_repeat_counts():
    counts = np.zeros(1024, np.int64)
    counts[[300, 724, 200, 624]] = (100, 60, 50, 40)
    combos = packing.combinations(counts, 1024)
    x = packing.repeat_counts(combos, counts)
    assert (300, 724) in combos and (200, 200, 624) in combos and (x >= 0).all()
    made = np.zeros(1024)
    for c, n in zip(combos, x):
        for k in c:
            made[k] += n
    assert ((made - counts) ** 2).sum() < (counts**2).sum() / 4


def test_packing(docs, empty, tokenizer, library):
    got = packing.pack(docs, tokenizer).collect()
    ids = defaultdict(list)
    for i, t, *_ in ROWS:
        ids[i].append(np.array([*library(t), 0], "<u4"))
    by, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
        seqs[r.sequence_id].append((r.offset, r.length))
    pieces = Counter()
    for (i, n), parts in by.items():
        (own,) = {len(x): x for x in ids[i]}[n][None]
        times = Counter(s for s, *_ in parts)
        assert len(set(times.values())) == 1 or sum(len(x) == n for x in ids[i]) > 1
        for s, length, crc in parts:
            assert zlib.crc32(own[s : s + length].tobytes()) == crc
            pieces[i] += length
    assert pieces == Counter({i: sum(map(len, x)) for i, x in ids.items()})
    for parts in seqs.values():
        end = 0
        for s, n in sorted(parts):
            assert s == end
            end += n
        assert end <= 1024 and end & (end - 1) == 0
    assert packing.pack(empty, tokenizer).isEmpty()


PAGE = '<!DOCTYPE html><html><head><title>t</title><script>var t="</p>";</script></head><body><nav><ul><li>m<li>n</ul></nav><div class="ad">buy</div>{}<footer>&copy; x</footer></body>'


def test_html(spark):
    pages = [(i, f"http://h.example/{i}", PAGE.format(f"<article><h1>T{i} &amp;\n c</h1><p><b>one<br>two<p>three{i}</p><div class=comments><p>no</p></div></article>")) for i in range(6)]
    pages += [(10 + i, f"http://g.example/{i}", f"<body><div id=x>Site name</div><div><p>own {i}</p></div><div>Terms and more</div></body>") for i in range(8)]
    pages += [(30, None, None), (31, "x", ""), (None, "http://k/", "<p>only</p>"), pages[0]]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("key", F.lit(1))
    got = collected(html.main_text(df))
    want = [(i, f"http://h.example/{i}", f"T{i} & c\none two\nthree{i}") for i in range(6)] + [(10 + i, f"http://g.example/{i}", f"own {i}") for i in range(8)]
    want += [(30, None, ""), (31, "x", ""), (None, "http://k/", "only"), (0, "http://h.example/0", "T0 & c\none two\nthree0")]
    assert got == sorted(((*w, len(w[2])) for w in want), key=repr)
    assert html.main_text(df.where("page_id < 0")).isEmpty()


def test_article_templates(spark):
    """An article's text blocks that recur on most pages of the host go; content that recurs on fewer stays."""
    line = "<p>Site notice</p><ul><li>read more</ul>"
    pages = [(i, f"http://n.example/{i}", PAGE.format(f"<article><h1>T{i}</h1>{line}<p>own {i}</p>{'<p>short</p>' if i < 9 else ''}</article>")) for i in range(20)]
    pages += [(100 + i, f"http://few.example/{i}", PAGE.format(f"<main><p>Site notice</p><p>own {i}</p></main>")) for i in range(9)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"T{i}\nown {i}" + ("\nshort" if i < 9 else "") for i in range(20)} | {100 + i: f"Site notice\nown {i}" for i in range(9)}


def test_page_copies(spark):
    """Copies of a page are no site template: they count as one page, on both sides of the share."""
    copy = "<body><div><h1>Title</h1><p>main text</p></div></body>"
    pages = [(i, f"http://c.example/{i}", copy) for i in range(12)] + [(100 + i, None, copy) for i in range(12)]
    pages += [(200 + i, f"http://c.example/own/{i}", f"<body><p>notice</p><p>own {i}</p></body>") for i in range(5)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: "Title\nmain text" for i in (*range(12), *range(100, 112))} | {200 + i: f"own {i}" for i in range(5)}


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("a < b", "a < b"), ("<p>x", "x"), ("<p>a<!-- unclosed", "a"), ("<style>x", ""), ("<main><p>m</p><form>f</form></main>out", "m"),
        ('<p title="a>b">yes</p>', "yes"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"), ("<p>a<span>b</span>c", "abc"), ("<SCRIPT>if(a<b){}</script >ok", "ok"),
        ("<div hidden>h</div>t<aside>s</aside>", "t"), ("<p>&#233;&lt;b&gt;&nbsp; x</p>", "é<b> x"), ("<article><header><h1>T</h1></header>b</article>", "T\nb"), ("<" * 2000, "<" * 2000),
    ],
)
def test_markup(source, want):
    assert "\n".join(t for t, _ in html.extract(source)[0]) == want


def test_deep_pages_take_linear_time():
    import time

    began = time.process_time()
    blocks, prints, parents = html.extract("<div>" * 100_000 + "deep" + "</div>" * 100_000)
    assert blocks == [("deep", 99_999)] and len(set(prints)) == 100_000
    assert html.without_templates(blocks, prints, parents, {prints[5]}) == "" and html.without_templates(blocks, prints, parents, {1}) == "deep"
    assert len(html.extract("<b>" * 20_000 + "<p>x" * 20_000)[0]) == 20_000
    assert len(html.extract("<ul>" + "<li>x<b>" * 50_000)[0]) == 50_000
    assert time.process_time() - began < 30


def test_templates_against_brute_force(spark):
    """Trees made here, so that their subtrees are known without a parser: counted per host and distinct page, deleted where frequent."""
    rng = random.Random(31)
    pool = [("div", [("p", [sentence(3, rng)]), ("p", [sentence(2, rng)])]) for _ in range(3)] + [("ul", [("li", [sentence(2, rng)]) for _ in range(3)]) for _ in range(3)]

    def source(t):
        return t if isinstance(t, str) else f"<{t[0]}>{''.join(map(source, t[1]))}</{t[0]}>"

    def subtrees(t):
        return {t}.union(*(subtrees(c) for c in t[1] if not isinstance(c, str)))

    def frozen(t):
        return t if isinstance(t, str) else (t[0], tuple(map(frozen, t[1])))

    def texts(t, gone):
        if isinstance(t, str):
            return [t]
        return [] if t in gone else [x for c in t[1] for x in texts(c, gone)]

    rows, trees = [], {}
    for i in range(90):
        own = [("p", [f"own {i}"]), ("div", [("p", [sentence(4, rng)])])]
        trees[i] = [frozen(t) for t in rng.sample([*own, *(t for k, t in enumerate(pool) if rng.random() < (0.1, 0.2, 0.4, 0.6, 0.9, 0.3)[k])], k=2)] + [frozen(own[0])]
        rows.append((i, f"http://h{i % 3}.example/{i}", "<body>" + "".join(map(source, trees[i])) + "</body>"))
    rows += [(100 + i, f"http://h0.example/copy/{i}", rows[0][2]) for i in range(40)]
    trees |= {100 + i: trees[0] for i in range(40)}
    pages = defaultdict(dict)
    for i, u, h in rows:
        pages[u.split("/")[2]][h] = i
    want = {}
    for host, distinct in pages.items():
        n = Counter(t for i in distinct.values() for t in set().union(*map(subtrees, trees[i])))
        gone = {t for t, k in n.items() if k >= 5 and k >= 0.3 * len(distinct)}
        want |= {i: "\n".join(x for t in trees[i] for x in texts(t, gone)) for i, u, _ in rows if host in u}
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want and sum(len(want[i].split("\n")) < sum(len(texts(t, ())) for t in trees[i]) for i in want) > 20


def test_urls(spark):
    rows = [(0, "HTTP://WWW.Example.COM/en/75?x"), (1, "http://a.com/en/1"), (2, "http://com/en/"), (3, "http://b.com/de/1#f"), (4, None), (5, "no scheme/en/"), (6, "x://h.net"), (7, "http://example.net/de/8a"), (8, "http://xcom/en/"), (None, "://É.COM/en/://z"), (9, "http://a.com/en/1")]
    rows += [(100 + i, f"http://shop.org/{'es' if i % 2 else 'buy'}/item-{i}/x") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("n", F.lit(1))
    got = {r.page_id: tuple(r)[1:] for r in urls.judge_urls(df, queries.RULES).collect()}
    assert got[0] == ("www.example.com", "/en/75", "example.com/en/7", "allow")
    assert got[1] == got[9] == ("a.com", "/en/1", "com/en/", "block") and got[2] == ("com", "/en/", "com/en/", "block")
    assert got[3] == ("b.com", "/de/1", None, "allow") and got[4] == got[5] == ("", "", None, "allow")
    assert got[6] == ("h.net", "", None, "allow") and got[7][2:] == ("example.net/de/8", "block") and got[8][2:] == (None, "allow")
    assert got[None] == ("É.com", "/en/://z", "com/en/", "block")
    assert got[101][2:] == ("org/es/", "block") and got[100][2:] == (None, "block")  # all that is known of the host is blocked
    assert urls.judge_urls(df.where("page_id < 0"), queries.RULES).isEmpty()


def test_url_rules_of_contract(spark):
    """Each rule's word, as listed; a net host gets its label from net/de/ and carries it to other paths."""
    told = {("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")}
    assert {(r.text, r.verdict) for r in queries.RULES} == told and len(queries.RULES) == len(told)
    rows = [(0, "http://b.com/en/1"), (1, "http://www.example.com/en/7"), (2, "http://www.example.net/de/7"), (3, "http://www.example.net/de/8"), (4, "http://b.org/es/")]
    rows += [(10 + i, f"http://c.net/{'de' if i % 2 else 'fr'}/{i}") for i in range(20)]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), queries.RULES).collect()}
    assert got[0] == ("com/en/", "block") and got[1] == ("example.com/en/7", "allow") and got[2] == ("net/de/", "allow") and got[3] == ("example.net/de/8", "block") and got[4] == ("org/es/", "block")
    assert all(got[10 + i] == ("net/de/" if i % 2 else None, "allow") for i in range(20))


def brute_urls(rows, rules, spec):
    """Verdicts of (id, url): rules, then the deepest labelled branch, each tree built node by node."""
    parts, told = {}, {}
    for i, u in rows:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        told[i] = max(fits, key=lambda r: (len(r.text), r.text)).verdict if fits else None
        segments = [("*" + (re.search(r"(\.[A-Za-z]+)$", x) or [""])[0]) if re.search("[0-9]", x) else x for x in re.sub("^/", "", path).split("/")]
        parts[i] = host, segments
    chains = {i: [(h, 0, "")] for i, (h, _) in parts.items()}
    for d in range(spec.depth):
        kids = defaultdict(set)
        for i, (_, s) in parts.items():
            if len(s) > d:
                kids[chains[i][-1]].add(s[d])
        for i, (h, s) in parts.items():
            if len(s) > d:
                node = chains[i][-1]
                chains[i].append((h, d + 1, node[2] + "/" + ("*" if len(kids[node]) > spec.children else s[d])))
    for i, (h, s) in parts.items():
        if len(s) > spec.depth:
            chains[i].append((h, spec.depth + 1, chains[i][-1][2] + "/" + "/".join(s[spec.depth :])))
    n, b, children = Counter(), Counter(), defaultdict(set)
    for i, chain in chains.items():
        if told[i]:
            for k, node in enumerate(chain):
                n[node] += 1
                b[node] += told[i] == "block"
                children[chain[k - 1] if k else (node[0], -1)].add(node)
    rejected = {}
    for nodes in children.values():
        pn, pb = sum(n[x] for x in nodes), sum(b[x] for x in nodes)
        alike = {x for x in nodes if (b[x] * pn - n[x] * pb) ** 2 <= spec.z2 * n[x] * pb * (pn - pb)}
        for x in nodes:
            own = alike if x in alike else {x}
            rejected[x] = sum(b[y] for y in own) + spec.smooth >= spec.purity * (sum(n[y] for y in own) + 2 * spec.smooth)
    out = {}
    for i, chain in chains.items():
        nearest = [rejected[x] for x in chain if x in rejected]
        out[i] = told[i] or ("block" if nearest and nearest[-1] else "allow")
    return out


@pytest.mark.parametrize("small", [True, False])
def test_url_tree_against_brute_force(spark, monkeypatch, small):
    """Deep paths, literal wildcards, variable segments, mixed labels; broadcast and salted joins."""
    if not small:
        monkeypatch.setattr(urls, "BROADCAST_ROWS", -1)
    rng = random.Random(17)
    words = ["a", "b", "news", "shop", "*", "", "x1", "y2.html", *(f"v{c}" for c in "abcdefghijklmnopqrstuvwxyz")]
    rows = [(i, f"http://h{rng.randrange(3)}.com/" + "/".join(rng.choice(words[: rng.choice((4, 8, 34))]) for _ in range(rng.randint(0, 8)))) for i in range(900)]
    rows += [(2000 + i, f"http://deep.com/a/b/c/d/{'good' if i % 2 else 'bad'}/{i}") for i in range(60)] + [(3000, None), (3001, None)]
    rules = [urls.Rule("block", "h0.com", "/a/"), urls.Rule("allow", "h0.com", "/b/"), urls.Rule("block", "h1.com", "/news/a"), urls.Rule("allow", "h1.com", "/news/b"), urls.Rule("block", "com", "/v"), urls.Rule("allow", "com", "/va/b")]
    rules += [urls.Rule("block" if k % 4 == 0 else "allow", "deep.com", f"/a/b/c/d/{'bad' if k % 4 == 0 else 'good'}/{k}") for k in range(10, 22) if k % 4 in (0, 1)]
    spec = urls.TreeSpec(children=6)
    want = brute_urls(rows, rules, spec)
    got = {r.page_id: r.verdict for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules, spec).collect()}
    assert got == want
    told = {r.page_id: r.rule for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules, spec).collect()} if small else {}
    free = Counter(want[i] for i in told if told[i] is None)
    assert not small or min(free["block"], free["allow"]) > 20


def test_url_tree(spark):
    """Templates that rules mostly block carry over to urls of the same template that no rule names."""
    rules = [urls.Rule("block", "h.com", f"/x/{k}") for k in range(1, 9)] + [urls.Rule("allow", "h.com", "/y/")]
    rows = [(i, f"http://h.com/x/{i}") for i in range(1, 100)] + [(1000 + i, f"http://h.com/y/{i}") for i in range(40)] + [(2000 + i, f"http://h.com/z/{i}") for i in range(20)]
    rows += [(3000 + i, f"http://deep.com/1/2/3/4/5/{'bad' if i < 20 else 'good'}/{i}") for i in range(40)]
    rules += [urls.Rule("block", "deep.com", "/1/2/3/4/5/bad/1"), urls.Rule("allow", "deep.com", "/1/2/3/4/5/good/2")]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert all(got[i] == (None, "block") for i in (9, *range(90, 100))) and got[15] == ("h.com/x/1", "block")
    assert all(got[1000 + i][1] == "allow" for i in range(40)) and all(got[2000 + i] == (None, "allow") for i in range(20))  # the host's labels are mixed
    assert {got[3000 + i][1] for i in range(20)} == {"block"} and {got[3020 + i][1] for i in range(20)} == {"allow"}  # told apart at the sixth segment
    wide = [(i, f"http://w.com/u{chr(97 + i // 26)}{chr(97 + i % 26)}/page") for i in range(60)]
    got = urls.judge_urls(spark.createDataFrame(wide, "page_id long, url string"), [urls.Rule("block", "w.com", f"/u{c}") for c in "ab"])
    assert {r.verdict for r in got.collect()} == {"block"}  # the first segment is variable, its labelled values are all blocked


def xx(*values):
    """Spark's xxhash64 of literals (ints of four bytes, as a pair) and columns."""
    seed = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
            seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def brute_taken(rows, spec):
    """The mix word by word: (doc_id, size, taken) of every row."""
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    targets, out = brute_targets(dict(sizes)), Counter()
    order = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    told = []
    for sid, s in enumerate(order):
        size, words = sizes[s], int(targets[s])
        epochs, rest = divmod(words, size) if size else (0, 0)
        blocks = -(-size // spec.block)
        told.append((sid, s, blocks, size // spec.block, epochs, rest, epochs * blocks + -(-rest // spec.block)))
    total = sum(t[-1] for t in told)
    shards = max(1, -(-total // spec.shard_slots))
    drawn, ends, acc = Counter(), [], 0
    for t in told:
        acc += t[-1]
        ends.append(acc / total)
    for i in range(total):
        u = (xx((spec.seed,), "draw", i) % (1 << 64) >> 11) / float(1 << 53)
        drawn[next(k for k, e in enumerate(ends) if u < e), i % shards] += 1
    assert sum(drawn.values()) == total
    for sid, s, blocks, even, epochs, rest, slots in told:
        words = []  # of the source's rows end to end, by hash
        own = [(xx(i, of, t), i is not None, i or 0, k) for k, (i, t, _, of, _) in enumerate(rows) if of == s]
        for *_, k in sorted(own):
            words += [k] * len(re.findall(r"[^\x20\x09-\x0D]+", rows[k][1] or ""))
        for j in range(slots):  # draws beyond the slots are lost, missing ones dealt: every number occurs once
            epoch, k = divmod(j, blocks)
            n = spec.block if epoch < epochs else min(spec.block, rest - k * spec.block)
            if k < even:
                for r in range(1, mixing.ROUNDS + 1):
                    y = (xx((spec.seed,), sid, epoch, (r,)) % even - k) % even
                    k = k if xx((spec.seed + 1,), sid, epoch, (r,), max(k, y)) % 2 == 0 else y
            out.update(words[k * spec.block : k * spec.block + n])
    return sorted(((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), out[k]) for k, (i, t, *_) in enumerate(rows)), key=repr)


def test_mixing_word_by_word(spark):
    spec = mixing.MixSpec(block=16, shard_slots=8)
    rows = ROWS[:-2]  # without repeated and null ids
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), spec).select("doc_id", "size", "taken")
    assert collected(got) == brute_taken(rows, spec)


def test_many_sources(spark, monkeypatch):
    """More sources than are broadcast: the salted join gives the same."""
    rows = [(i, "w " * (i % 7), None, f"s{i % 90:02}" if i % 90 else None, 0) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = collected(mixing.mix(df, mixing.MixSpec(block=4)))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    monkeypatch.setattr(mixing, "CELLS", 16)
    got = collected(mixing.mix(df, mixing.MixSpec(block=4)))
    assert [r[:4] for r in got] == [r[:4] for r in want]  # (other cells' bounds don't change draws)
    assert got == want
    targets = brute_targets(dict(Counter({s: sum(len((t or "").split()) for _, t, _, o, _ in rows if o == s) for s in {r[3] for r in rows}})))
    assert {r[0]: r[3] for r in got} == pytest.approx({i: targets[s] for i, _, _, s, _ in rows})
