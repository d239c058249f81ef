"""Operators against brute force on seeded data, the documented examples, and the errors at build."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from rankwell import functions as fx
from rankwell.errors import BuildError, DuplicateKey, MismatchedKeysAndValues, NotMonotone, Unsolvable, ValueTooLarge
from rankwell.operators import chunks, f2, filters, func, lists, parens, static
from rankwell.operators.bits import BitVector, FieldVector, RankSelect
from rankwell.operators.monotone import MonotoneSeq
from rankwell.operators.scan import dense_index, prefix_sums
from rankwell.operators.strings import StringList, decode_block, encode_block, inverted, mapped_get


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def ints(spark, values, name="v"):
    return spark.createDataFrame([(int(v),) for v in values], f"{name} long")


@pytest.mark.parametrize(("n", "u"), [(10, 1000), (100, 100), (300, 40)])
def test_monotone_against_bisect(spark, n, u):
    rng = random.Random(n)
    v = sorted(rng.randrange(u) for _ in range(n))
    seq = MonotoneSeq.from_values(ints(spark, rng.sample(v, n)), "v")
    q = list(range(-1, u + 3, max(1, u // 40)))
    probes = ints(spark, q, "q")

    def succ(x, strict):
        i = (bisect.bisect_right if strict else bisect.bisect_left)(v, x)
        return (x, i, v[i]) if i < n else (x, None, None)

    def pred(x, strict):
        i = (bisect.bisect_left if strict else bisect.bisect_right)(v, x) - 1
        return (x, i, v[i]) if i >= 0 else (x, None, None)

    for strict in (False, True):
        assert sorted(map(str, rows_any(seq.succ(probes, "q", strict)))) == sorted(map(str, (succ(x, strict) for x in q)))
        assert sorted(map(str, rows_any(seq.pred(probes, "q", strict)))) == sorted(map(str, (pred(x, strict) for x in q)))
    assert rows(seq.rank(probes, "q"), "q", "rank") == sorted((x, bisect.bisect_left(v, x)) for x in q)
    assert rows(seq.rows(), "idx", "value") == list(enumerate(v))
    assert {tuple(r) for r in seq.index_of(probes, "q").collect()} == {(x, v.index(x) if x in v else None) for x in q}
    assert rows(seq.contains(probes, "q"), "q") == sorted((x,) for x in q if x in v)
    got = seq.get(ints(spark, [0, n // 2, n - 1, n, -1], "i"), "i").collect()
    assert {(r.i, r.value) for r in got} == {(0, v[0]), (n // 2, v[n // 2]), (n - 1, v[-1]), (n, None), (-1, None)}


def rows_any(df):
    return [tuple(r) for r in df.collect()]


def test_monotone_example_and_errors(spark):
    seq = MonotoneSeq.from_values(ints(spark, [0, 2, 8, 10]), "v", upper=10)
    assert rows_any(seq.succ(ints(spark, [6], "q"), "q")) == [(6, 2, 8)]
    assert rows_any(seq.succ(ints(spark, [11], "q"), "q")) == [(11, None, None)]
    with pytest.raises(ValueTooLarge):
        MonotoneSeq.from_values(ints(spark, [0, 11]), "v", upper=10)
    with pytest.raises(BuildError):
        MonotoneSeq.from_values(ints(spark, [-1]), "v")
    indexed = spark.createDataFrame([(0, 5), (1, 3)], "i long, v long")
    with pytest.raises(NotMonotone):
        MonotoneSeq.from_indexed(indexed, "i", "v", 2, 10)
    with pytest.raises(BuildError):
        MonotoneSeq.from_indexed(indexed, "i", "v", 3, 10)
    empty = MonotoneSeq.from_values(ints(spark, []), "v")
    assert empty.n == 0 and rows_any(empty.succ(ints(spark, [1], "q"), "q")) == [(1, None, None)]
    assert empty.estimated_bits() == 0


def test_cursors(spark):
    v = [1, 1, 4, 9, 9, 12]
    seq = MonotoneSeq.from_values(ints(spark, v), "v")
    at = spark.createDataFrame([(4,)], "s long")
    assert rows(seq.cursor(at, "s", 3), "step", "idx", "value") == [(0, 4, 9), (1, 5, 12)]
    assert rows(seq.cursor(at, "s", 3, backward=True), "step", "idx", "value") == [(0, 3, 9), (1, 2, 4), (2, 1, 1)]


@pytest.mark.parametrize("density", [0.0, 0.02, 0.5, 1.0])
def test_rank_select(spark, density):
    rng = random.Random(7)
    n = 391
    bits = [rng.random() < density for _ in range(n)]
    v = BitVector.from_bits(spark.createDataFrame(list(enumerate(bits)), "pos long, bit boolean"), "pos", "bit", n)
    rs = RankSelect.build(v)
    q = list(range(0, n + 70, 3))
    assert rows(rs.rank(ints(spark, q, "p"), "p"), "p", "rank") == [(p, sum(bits[:p])) for p in q]
    assert rows(rs.rank_zero(ints(spark, q, "p"), "p"), "p", "rank") == [(p, p - sum(bits[:p])) for p in q]
    for want, method in ((True, rs.select), (False, rs.select_zero)):
        where = [i for i, b in enumerate(bits) if b == want]
        assert {tuple(r) for r in method(ints(spark, range(n + 2), "r"), "r").collect()} == {(r, where[r] if r < len(where) else None) for r in range(n + 2)}
    assert v.flip().count_ones().first()[0] == n - sum(bits)
    assert rows(v.zeros(), "pos") == [(i,) for i, b in enumerate(bits) if not b]


def test_bit_example(spark):
    bits = [1, 0, 1, 1, 0, 1, 0, 1]
    v = BitVector.from_bits(spark.createDataFrame([(i, bool(b)) for i, b in enumerate(bits)], "pos long, bit boolean"), "pos", "bit")
    rs = RankSelect.build(v)
    assert rows(rs.rank(ints(spark, [0, 4, 8], "p"), "p"), "p", "rank") == [(0, 0), (4, 3), (8, 5)]
    got = {tuple(r) for r in rs.select_zero(ints(spark, [0, 1, 2, 3], "r"), "r").collect()}
    assert got == {(0, 1), (1, 4), (2, 6), (3, None)}


def test_bit_edits(spark):
    rng = random.Random(3)
    bits = [rng.random() < 0.5 for _ in range(150)]
    make = lambda b: BitVector.from_bits(spark.createDataFrame(list(enumerate(b)), "pos long, bit boolean"), "pos", "bit", len(b))
    v = make(bits)
    ones = lambda x: [p for (p,) in rows(x.ones(), "pos")]
    edits = spark.createDataFrame([(0, not bits[0]), (64, True), (149, False)], "p long, b boolean")
    want = [not bits[0], *bits[1:64], True, *bits[65:149], False]
    assert ones(v.set(edits, "p", "b")) == [i for i, b in enumerate(want) if b]
    assert ones(v.append(v)) == [i for i, b in enumerate(bits + bits) if b]
    assert ones(v.append_value(5, 3)) == [i for i, b in enumerate(bits + [True, False, True]) if b]
    assert ones(v.resize(160, True)) == [i for i, b in enumerate(bits + [True] * 10) if b]
    assert v.push(True).pop().equals(v) and not v.equals(make(bits[:-1]))
    assert BitVector.filled(spark, 130, True).count_ones().first()[0] == 130
    at = spark.createDataFrame([(0, 64), (60, 10), (1, 63), (149, 1), (145, 10), (5, 0)], "p long, w long")
    for r in v.get_bits(at, "p", "w").collect():
        want = sum(int(b) << i for i, b in enumerate(bits[r.p : r.p + r.w]))
        assert r.value == (None if r.p + r.w > 150 else want - (1 << 64) if want >> 63 else want)
    assert {tuple(r) for r in v.get(ints(spark, [3, 150, -1], "p"), "p").collect()} == {(3, bits[3]), (150, None), (-1, None)}
    with pytest.raises(ValueError):
        v.chunks(100)


def test_fields(spark):
    rng = random.Random(5)
    vals = [rng.randrange(1 << 9) for _ in range(90)]
    v = FieldVector.from_slice(spark.createDataFrame(list(enumerate(vals)), "i long, v long"), "i", "v")
    assert v.width == max(x.bit_length() for x in vals) and v.length == 90
    packed = v.pack()
    at = spark.range(90).select((F.col("id") * v.width).alias("p"), F.lit(v.width).alias("w"))
    assert rows(packed.get_bits(at, "p", "w"), "p", "value") == [(i * v.width, x) for i, x in enumerate(vals)]
    want = list(vals)
    want[70:90] = vals[10:30]
    assert rows(v.copy(10, v, 70, 99).rows, "idx", "val") == list(enumerate(want))
    with pytest.raises(Exception, match="does not fit"):
        v.apply(lambda x: x + 512).rows.collect()
    empty = FieldVector.from_slice(spark.createDataFrame([], "i long, v long"), "i", "v")
    zeros = FieldVector.from_slice(spark.createDataFrame([(0, 0)], "i long, v long"), "i", "v")
    assert (empty.width, zeros.width) == (0, 1)


def test_strings(spark):
    words = ["aa", "aab", "abc", "abdd", "abde\0f", "abdf", "", "é", "z", "aa"]
    v = StringList.sorted(spark.createDataFrame([(w,) for w in words], "s string"), "s", ratio=4)
    order = sorted(words, key=lambda w: w.encode())
    assert rows(v.rows, "idx", "s") == list(enumerate(order))
    q = spark.createDataFrame([("abde\0f",), ("foo",), ("aa",)], "q string")
    assert {tuple(r) for r in v.index_of(q, "q").collect()} == {("abde\0f", order.index("abde\0f")), ("foo", None), ("aa", order.index("aa"))}
    assert rows(v.contains(q, "q"), "q") == [("aa",), ("abde\0f",)]
    assert rows(StringList.decode(v.encode(), 4), "idx", "s") == list(enumerate(order))
    size = v.encode().agg(F.sum(F.length("payload"))).first()[0]
    assert v.stats().first()["code_bytes"] == size
    with pytest.raises(BuildError):
        StringList.sorted(spark.createDataFrame([("a",)], "s string"), "s", ratio=0)
    with pytest.raises(NotMonotone):
        StringList.from_indexed(spark.createDataFrame([(0, "b"), (1, "a")], "i long, s string"), "i", "s")
    m = spark.createDataFrame([(i, j) for i, j in enumerate([5, 4, 2, 0, 1, 3])], "i long, j long")
    assert rows(mapped_get(v, m, "i", "j"), "i", "s") == [(i, order[j]) for i, j in enumerate([5, 4, 2, 0, 1, 3])]
    assert rows(inverted(m, "i", "j"), "i", "j") == sorted((j, i) for i, j in enumerate([5, 4, 2, 0, 1, 3]))


def test_block_codec():
    rng = random.Random(2)
    s = sorted(bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 3, 200, 20_000]))) for _ in range(30))
    assert decode_block(encode_block(s), len(s)) == s


def test_functions(spark):
    keys = spark.createDataFrame([(i, i * 7 % 5) for i in range(100)], "k long, v long")
    f = func.KeyedFunction.build(keys, "k", "v")
    assert {tuple(r) for r in f.get(ints(spark, [3, 100], "q"), "q").collect()} == {(3, 1), (100, None)}
    assert f.width() == 3
    with pytest.raises(DuplicateKey):
        func.KeyedFunction.build(keys.union(keys.limit(1)), "k", "v")
    with pytest.raises(MismatchedKeysAndValues):
        func.KeyedFunction.build(keys, "k", "v", expected=99)
    with pytest.raises(ValueTooLarge):
        func.KeyedFunction.build(keys, "k", "v", width=2)
    two = func.TwoStepFunction.build(keys, "k", "v")
    assert {tuple(r) for r in two.get(ints(spark, range(101), "q"), "q").collect()} == {(i, i * 7 % 5) for i in range(100)} | {(100, None)}
    m = func.MonotoneRank.build(spark.createDataFrame([(x,) for x in (-5, 0, 9, -2)], "k long"), "k")
    assert rows(m.get(ints(spark, [-5, 9], "q"), "q"), "q", "rank") == [(-5, 0), (9, 3)]
    with pytest.raises(MismatchedKeysAndValues):
        func.MonotoneRank.build(keys, "k", n=7)
    with pytest.raises(NotMonotone):
        func.MonotoneRank.build(spark.createDataFrame([(0, 5), (1, 3)], "i long, k long"), "k", idx="i")
    signed = func.signed_get(f.table, ints(spark, [1, 1000], "q"), "q", hash_width=8)
    assert {tuple(r) for r in signed.collect()} == {(1, 2), (1000, None)}
    with pytest.raises(BuildError):
        func.signed_get(f.table, keys, "k", hash_width=0)


def test_huffman():
    rng = random.Random(4)
    values = [min(rng.randrange(1, 40) for _ in range(4)) for _ in range(500)]
    counts = {v: values.count(v) for v in set(values)}
    for code in (func.HuffmanCode.from_counts(counts), func.HuffmanCode.from_counts(counts, max_symbols=5), func.HuffmanCode.from_counts({3: 9})):
        v = values if 3 not in code.lengths or len(code.lengths) > 1 else [3] * 4
        bits = code.encode(v)
        assert code.decode(bits) == v and len(bits) == sum(code.encoded_len(x) for x in v)
        assert sum(2.0**-n for _, n in code.codewords().values()) <= 1


def test_fingerprint_filter(spark):
    f = filters.FingerprintFilter.build(spark.range(2000), "id", 6)
    assert f.contains(spark.range(2000), "id").count() == 2000
    wrong = f.contains(spark.range(2000, 22_000), "id").count() / 20_000
    assert wrong < 2 / 2**6
    with pytest.raises(BuildError):
        filters.FingerprintFilter.build(spark.range(3), "id", 65)


def test_lists(spark):
    vals = [3, 5, 3, 10, 4, 3]
    df = spark.createDataFrame(list(enumerate(vals)), "i long, v long")
    c = lists.CompactList.build(df, "i", "v", 3)
    ends = [0]
    for x in vals:
        ends.append(ends[-1] + (x - 3 + 1).bit_length() - 1)
    assert rows(c.delimiters(), "idx", "begin") == list(enumerate(ends))
    with pytest.raises(BuildError):
        lists.CompactList.build(df, "i", "v", 4)
    p = lists.PrefixSumList.build(df, "i", "v")
    sums = [sum(vals[:i]) for i in range(7)]
    assert rows(p.prefix_sum(spark.range(7), "id"), "id", "prefix_sum") == list(enumerate(sums))
    assert rows(p.get(spark.range(6), "id"), "id", "val") == list(enumerate(vals))
    with pytest.raises(BuildError):
        lists.PrefixSumList.from_sums(spark.createDataFrame([(0, 1)], "i long, s long"), "i", "s")
    with pytest.raises(NotMonotone):
        lists.PrefixSumList.from_sums(spark.createDataFrame([(0, 0), (1, 4), (2, 3)], "i long, s long"), "i", "s")
    a = lists.PartialArray.build(spark.createDataFrame([(1, "x"), (4, "y")], "p long, v string"), "p", "v", 5, 2)
    assert [r.v for r in a.get(spark.range(5), "id").orderBy("id").collect()] == [None, "x", None, None, "y"]
    with pytest.raises(Exception, match="outside"):
        a.get(spark.range(6), "id").collect()
    with pytest.raises(BuildError):
        lists.PartialArray.build(spark.createDataFrame([(1, "x"), (1, "y")], "p long, v string"), "p", "v", 5)


def test_parens(spark):
    rng = random.Random(9)
    s, depth = [], 0
    while len(s) < 400 or depth:
        up = depth == 0 or len(s) < 400 and rng.random() < 0.5
        s.append(up)
        depth += 1 if up else -1
    pairs = parens.matched(spark.createDataFrame(list(enumerate(s)), "pos long, o boolean"), "pos", "o")
    stack, want = [], []
    for i, o in enumerate(s):
        if o:
            stack.append(i)
        else:
            want.append((stack.pop(), i))
    assert rows(pairs, "open_pos", "close_pos") == sorted(want)
    got = {tuple(r) for r in parens.find_close(pairs, ints(spark, range(10), "p"), "p").collect()}
    assert got == {(i, dict(want).get(i)) for i in range(10)}
    for bad in ([True], [False, True], [True, False, False]):
        with pytest.raises(BuildError):
            parens.matched(spark.createDataFrame(list(enumerate(bad)), "pos long, o boolean"), "pos", "o")


def test_parens_over_blocks(spark):
    """Pairs within and across blocks of positions, nested deeper than a block is long, with gaps in the numbering."""
    rng = random.Random(21)
    s = [True] * 70000 + [False] * 100
    while len(s) < 200000:
        s.append(rng.random() < 0.5)
    s += [False] * (2 * sum(s) - len(s))
    assert len(s) > 3 * 65536
    at = [i + i // 1000 for i in range(len(s))]
    stack, want = [], []
    for i, o in zip(at, s):
        if o:
            stack.append(i)
        else:
            want.append((stack.pop(), i, len(stack) + 1))
    got = parens.matched(spark.createDataFrame(list(zip(at, s)), "pos long, o boolean"), "pos", "o")
    assert rows(got, "open_pos", "close_pos", "depth") == sorted(want)
    with pytest.raises(BuildError, match="repeated"):
        parens.matched(spark.createDataFrame([(0, True), (0, True), (1, False), (2, False)], "pos long, o boolean"), "pos", "o")


def test_parens_shuffle_words(spark):
    """No stage reads the positions one by one: what a task sorts or groups is a word of 64 of them, or a block's rest."""
    n = 400000
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    known = {stages().apply(i).stageId() for i in range(stages().size())}
    df = spark.range(n).select("id", ((F.col("id") == 0) | (F.col("id") % 2 == 1) & (F.col("id") < n - 1)).alias("o"))
    assert parens.matched(df, "id", "o").count() == n // 2
    now = stages()
    read = [x.shuffleReadRecords() for x in map(now.apply, range(now.size())) if x.stageId() not in known]
    assert read and 0 < max(read) < n // 16


def test_chunks(spark):
    rng = random.Random(11)
    w = [rng.choice([0, 1, 5, 30, 200]) for _ in range(120)]

    def brute(target):
        cum = [sum(w[:i]) for i in range(len(w) + 1)]
        out, lo = [], 0
        while lo < len(w):
            hi = bisect.bisect_left(cum, cum[lo] + target)
            hi = min(hi, len(w))
            out.append((len(out), lo, hi))
            lo = hi
        return out

    df = spark.createDataFrame(list(enumerate(w)), "i long, w long")
    for target in (1, 300, 10**6):
        assert rows(chunks.fair_chunks(df, "i", "w", target), "chunk", "lo", "hi") == brute(target)
    assert chunks.fair_chunks(df, "i", "w", 0).isEmpty()


def test_f2(spark):
    got = f2.solve([({0, 1}, 5), ({1, 2}, 3), ({2}, 6), ({0, 2}, 6)])
    assert got[0] ^ got[1] == 5 and got[1] ^ got[2] == 3 and got[2] == 6
    with pytest.raises(Unsolvable):
        f2.solve([({0}, 1), ({0}, 0)])


def test_scan(spark):
    rng = random.Random(1)
    data = [(rng.randrange(50), rng.randrange(9)) for _ in range(500)]
    df = spark.createDataFrame(data, "k long, n long")
    got = rows(dense_index(df, "k", "n"), "idx", "k", "n")
    assert got == [(i, *x) for i, x in enumerate(sorted(data))]
    sums = rows(prefix_sums(df.groupBy("k").agg(F.sum("n").alias("n")), "n", "k"), "k", "before")
    assert sums == [(k, sum(n for j, n in data if j < k)) for k in sorted({k for k, _ in data})]


def test_word_functions(spark):
    rng = random.Random(6)
    words = [0, 1, -1, 1 << 62, -(1 << 63), *(rng.getrandbits(63) for _ in range(20))]
    df = ints(spark, words, "w")
    for r in df.select("w", fx.select_in_word(F.col("w"), F.lit(1)).alias("s"), fx.bit_len(F.col("w")).alias("b"), fx.rank_in_word(F.col("w"), F.lit(63)).alias("k")).collect():
        u = r.w % (1 << 64)
        ones = [i for i in range(64) if u >> i & 1]
        assert r.s == (ones[1] if len(ones) > 1 else None)
        assert r.b == max(1, u.bit_length()) and r.k == bin(u & ((1 << 63) - 1)).count("1")
    lcp = spark.createDataFrame([("abc", "abd"), ("", "a"), ("é", "è"), (None, "a")], "a string, b string").select(fx.byte_lcp("a", "b").alias("n"))
    assert [r.n for r in lcp.collect()] == [2, 0, 1, 0]
    v = spark.createDataFrame([(127,), (128,), (16511,), (16512,), (2113663,), (2113664,)], "v long").select(fx.vbyte_len(F.col("v")).alias("n"))
    assert [r.n for r in v.collect()] == [1, 2, 2, 3, 3, 4]


def test_packed_function(spark, monkeypatch):
    monkeypatch.setattr(static, "SHARD_KEYS", 700)
    keys = spark.range(2500).select(F.col("id").alias("k"), (F.col("id") * 7 % 1000).alias("v"))
    f = static.PackedFunction.build(keys, "k", "v")
    assert (f.width, f.n) == (10, 2500) and f.shard_sizes().count() == f.shards == 4
    probes = keys.unionByName(keys.limit(5))
    assert f.get(probes, "k").where("value != v or value is null").isEmpty()
    assert f.bits_per_key() < 16 * 1.3
    with pytest.raises(DuplicateKey):
        static.PackedFunction.build(keys.union(keys.limit(1)), "k", "v")
    with pytest.raises(ValueTooLarge):
        static.PackedFunction.build(keys, "k", "v", width=9)
    g = static.PackedFilter.build(keys, "k", 6)
    assert g.contains(keys, "k").count() == 2500
    assert g.contains(spark.range(2500, 22_500), "id").count() / 20_000 < 2 / 2**6
    empty = static.PackedFunction.build(keys.where("k < 0"), "k", "v")
    assert empty.get(keys.limit(3), "k").select("value").distinct().collect() == [(None,)]


def test_field_edits(spark):
    v = FieldVector.from_slice(spark.createDataFrame([(0, 5), (1, 7)], "i long, v long"), "i", "v")
    assert rows(v.push(3).resize(5, 1).pop().rows, "idx", "val") == [(0, 5), (1, 7), (2, 3), (3, 1)]
    assert rows(v.filled(0).rows, "idx", "val") == [(0, 0), (1, 0)]
    assert v.equals(v.push(1).pop()) and not v.equals(v.filled(2))
    with pytest.raises(ValueError):
        v.push(8)
