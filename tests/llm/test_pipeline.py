"""The pipeline's stages, each against brute force on its own input, and the driver's guard."""

import random
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from rankwell.llm import neardup
from rankwell.llm.common import materialize

ROOT = Path(__file__).resolve().parents[2]
RNG = random.Random(21)
VOCAB = ["".join(RNG.choice("abcdefg") for _ in range(RNG.randint(2, 8))) for _ in range(500)]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def sentence(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    shared = sentence(60)
    texts, bad = [], set()
    for i in range(160):
        t = sentence(RNG.randint(60, 120))
        if i % 4 == 3:
            t = " ".join(w + "!!" for w in t.split())
            bad.add(i)
        elif i % 20 == 4:
            t = texts[0] if i == 4 else texts[4]
        elif i % 20 == 8:
            w = texts[5].split()
            w[i % len(w)] = "changed"
            t = " ".join(w)
        elif i % 20 == 13:
            t = t + " " + shared
        texts.append(t)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)] + [(500, None, None, None, None), (501, "", "en", "s0", 0)]
    d = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(d / "documents.parquet"))
    labels = [(i, int(i not in bad), 0) for i in range(160) if i % 5]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    out, df = [spark.read.parquet(str(d / "documents.parquet"))], None
    for name, f in corpus_pipeline.STAGES:
        df = materialize(f(spark, out[-1], str(d)), name)
        out.append(df)
    return out, bad, str(d)


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_columns(stages):
    out, _, _ = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "mixture", "packing"]
    assert all(df.columns == COLUMNS for df in out[:-1])


def test_quality_stage(stages):
    out, bad, _ = stages
    kept = {r.doc_id for r in out[1].collect()}
    assert not kept & bad and kept >= set(range(160)) - bad
    assert set(texts(out[1])) <= set(texts(out[0]))


def test_near_stage(stages):
    out, _, _ = stages
    rows = texts(out[1])
    sets = [neardup.shingle_set(t or "", 5) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
    groups = defaultdict(list)
    for (i, _), v in zip(rows, label):
        groups[v].append(i)
    assert sorted(r.doc_id for r in out[2].collect()) == sorted(min(g) for g in groups.values())
    assert len(groups) < len(rows)


def test_passage_stage(stages):
    out, _, _ = stages
    rows = [(i, t, (t or "").split()) for i, t in texts(out[2])]
    where = Counter(tuple(w[k : k + 35]) for _, _, w in rows for k in range(len(w) - 34))
    want = []
    for i, t, w in rows:
        cover = [False] * len(w)
        for k in range(len(w) - 34):
            if where[tuple(w[k : k + 35])] > 1:
                cover[k : k + 35] = [True] * 35
        want.append((i, " ".join(x for x, c in zip(w, cover) if not c) if any(cover) else t))
    assert texts(out[3]) == sorted(want, key=repr) and texts(out[3]) != texts(out[2])
    assert all(r.n_chars == len(r.text) for r in out[3].collect() if r.text is not None)


def test_mixture_stage(stages):
    out, _, _ = stages
    size, taken, doc, mixed = Counter(), Counter(), {}, Counter()
    for r in out[3].collect():
        size[r.source] += len((r.text or "").split())
        doc[r.doc_id] = Counter((r.text or "").split())
    for r in out[4].collect():
        taken[r.source] += len(r.text.split())
        mixed[r.doc_id] += len(r.text.split())
        assert not Counter(r.text.split()) - doc[r.doc_id] and r.n_chars == len(r.text)
    total, weights = 1.5 * sum(size.values()), {"s0": 3, "s1": 1, "s2": 2}
    free, left, target = dict(weights), total, {}
    while free:
        share = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in free if share[s] > 2 * size[s]]
        target |= {s: 2 * size[s] for s in over} if over else share
        if not over:
            break
        left -= sum(2 * size[s] for s in over)
        free = {s: w for s, w in free.items() if s not in over}
    assert all(abs(taken[s] - target[s]) <= 1 for s in weights)
    assert all(n <= 2 * sum(doc[i].values()) for i, n in mixed.items())


def test_packing_stage(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    out, _, _ = stages
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in out[4].collect())
    rows = out[5].collect()
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in rows) == want
    for parts in seqs.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] & (ends[-1] - 1) == 0 and ends[-1] <= 1024


CLASHES = "score string, gone long, twice long, k1 long, new string, row string, size long, sid int, h long"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null and repeated ids, whole rows repeated, null, empty and long texts, extra columns, an empty table."""
    d = tmp_path_factory.mktemp("odd")
    good, long = [sentence(70) for _ in range(6)], sentence(20_000)
    rows = [(i, t, "en", "s0", len(t)) for i, t in enumerate(good)]
    rows += [rows[0], rows[0], (None, sentence(50), None, None, None), (None, good[1], None, None, 5), (2, sentence(40), "en", "s1", 1)]
    rows += [(20, None, None, None, None), (21, "", "en", "s0", 0), (22, long, "en", None, len(long))]
    extra = tuple(None if c.split()[1] == "string" else 7 for c in CLASHES.split(", "))
    df = spark.createDataFrame([r + extra for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + CLASHES)
    spark.createDataFrame([(i, 1, 0) for i in range(6)] + [(50, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    return materialize(df, "odd"), str(d)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, odd, name):
    """Every stage alone: extra columns are carried, no row is lost but by its rule, an empty table gives an empty result."""
    df, d = odd
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, df, d)
    assert stage(spark, df.limit(0), d).isEmpty()
    rows = out.collect()
    if name == "packing":
        assert sum(r.length for r in rows if r.start == 0) and len({r.doc_id for r in rows}) == len({r.doc_id for r in df.collect()})
        return
    assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString()
    ids = Counter(r.doc_id for r in rows)
    if name == "quality":  # a part of the rows, none twice
        assert not ids - Counter(r.doc_id for r in df.collect())
    elif name == "near_duplicates":  # an id once, null ids always
        assert ids == Counter({None: 2} | dict.fromkeys([0, 1, 2, 3, 4, 5, 20, 21, 22], 1))
    elif name == "repeated_passages":  # every row stays, repeats lose all their words
        assert ids == Counter(r.doc_id for r in df.collect())
        assert [r.text for r in rows if r.doc_id == 0] == ["", "", ""]
    else:
        assert ids.keys() <= {r.doc_id for r in df.collect()} - {20, 21} and rows
    assert all(r.h == 7 and r.size == 7 for r in rows)


def test_run_equals_stages(spark, stages):
    out, _, d = stages
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).collect())) == sorted(map(tuple, out[5].collect()))


def test_entry_without_llm(tmp_path):
    """The rest imports without this subpackage."""
    code = "import __spark_entry__ as e; assert 'ef_succ' in e.queries() and not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']; e.oracle_sql()"
    (tmp_path / "rankwell").mkdir()
    for p in (ROOT / "rankwell").iterdir():
        if p.name != "llm":
            (tmp_path / "rankwell" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    run = subprocess.run([sys.executable, "-c", f"import sys; sys.path[:0] = [{str(tmp_path)!r}]; {code}"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
