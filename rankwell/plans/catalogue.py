"""The operators as queries over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fx
from ..operators import chunks, f2, filters, func, lists, parens, static
from ..operators.bits import BitVector, FieldVector, RankSelect
from ..operators.monotone import MonotoneSeq
from ..operators.scan import dense_index
from ..operators.strings import StringList, mapped_get
from ..scratch import materialize, new_path
from ..sources import lines
from ..streaming import lookups

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name; ``sql``: None where SQL can't express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ------------------------------------------------------------ monotone sequences

_V = "WITH v AS (SELECT l_orderkey AS value, row_number() OVER (ORDER BY l_orderkey) - 1 AS idx FROM lineitem), p AS (SELECT c_custkey * 13 + 3 AS q FROM customer), r AS (SELECT value, min(idx) AS first, max(idx) AS last FROM v GROUP BY value) "


def _seq(spark, d) -> MonotoneSeq:
    return MonotoneSeq.from_values(_t(spark, d, "lineitem"), "l_orderkey")


def _probes(spark, d) -> DataFrame:
    return _t(spark, d, "customer").select((F.col("c_custkey") * 13 + 3).alias("q"))


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_orderkey AS value FROM orders")
def ef_get(spark, d):
    """Every position."""
    seq = MonotoneSeq.from_values(_t(spark, d, "orders"), "o_orderkey")
    return seq.get(spark.range(seq.n).select(F.col("id").alias("i")), "i")


def _nearest(agg: str, at: str, compare: str) -> str:
    return _V + f", m AS (SELECT q, (SELECT {agg}(value) FROM r WHERE value {compare} q) AS value FROM p) SELECT q, r.{at} AS idx, m.value FROM m LEFT JOIN r ON m.value = r.value"


@query(_nearest("min", "first", ">="))
def ef_succ(spark, d):
    return _seq(spark, d).succ(_probes(spark, d), "q")


@query(_nearest("min", "first", ">"))
def ef_succ_strict(spark, d):
    return _seq(spark, d).succ(_probes(spark, d), "q", strict=True)


@query(_nearest("max", "last", "<="))
def ef_pred(spark, d):
    return _seq(spark, d).pred(_probes(spark, d), "q")


@query(_nearest("max", "last", "<"))
def ef_pred_strict(spark, d):
    return _seq(spark, d).pred(_probes(spark, d), "q", strict=True)


@query(_V + "SELECT q, (SELECT count(*) FROM v WHERE value < q) AS rank FROM p")
def ef_value_rank(spark, d):
    return _seq(spark, d).rank(_probes(spark, d), "q")


@query(_V + "SELECT q, first AS idx FROM p LEFT JOIN r ON q = value")
def ef_index_of(spark, d):
    return _seq(spark, d).index_of(_probes(spark, d), "q")


@query(_V + "SELECT q FROM p WHERE EXISTS (SELECT 1 FROM r WHERE value = q)")
def ef_contains(spark, d):
    return _seq(spark, d).contains(_probes(spark, d), "q")


_SUCC = _V + ", m AS (SELECT q, (SELECT min(value) FROM r WHERE value >= q) AS s FROM p), b AS (SELECT q, first AS start FROM m JOIN r ON s = value) "
_PRED = _V + ", m AS (SELECT q, (SELECT max(value) FROM r WHERE value <= q) AS s FROM p), b AS (SELECT q, last AS start FROM m JOIN r ON s = value) "


@query(_SUCC + "SELECT q, idx - start AS step, idx, value FROM b JOIN v ON idx >= start AND idx < start + 5")
def ef_iter_from_succ(spark, d):
    seq = _seq(spark, d)
    at = seq.succ(_probes(spark, d), "q").select("q", F.col("idx").alias("start"))
    return seq.cursor(at, "start", 5).select("q", "step", "idx", "value")


@query(_SUCC + "SELECT q, start - 1 - idx AS step, idx, value FROM b JOIN v ON idx < start AND idx >= start - 5")
def ef_iter_back_from_succ(spark, d):
    seq = _seq(spark, d)
    at = seq.succ(_probes(spark, d), "q").select("q", F.col("idx").alias("start"))
    return seq.cursor(at, "start", 5, backward=True).select("q", "step", "idx", "value")


@query(_PRED + "SELECT q, idx - start AS step, idx, value FROM b JOIN v ON idx >= start AND idx < start + 5")
def ef_iter_from_pred(spark, d):
    seq = _seq(spark, d)
    at = seq.pred(_probes(spark, d), "q").select("q", F.col("idx").alias("start"))
    return seq.cursor(at, "start", 5).select("q", "step", "idx", "value")


@query(_PRED + "SELECT q, start - 1 - idx AS step, idx, value FROM b JOIN v ON idx < start AND idx >= start - 5")
def ef_iter_back_from_pred(spark, d):
    seq = _seq(spark, d)
    at = seq.pred(_probes(spark, d), "q").select("q", F.col("idx").alias("start"))
    return seq.cursor(at, "start", 5, backward=True).select("q", "step", "idx", "value")


_SUCC_STRICT, _PRED_STRICT = _SUCC.replace("value >= q", "value > q"), _PRED.replace("value <= q", "value < q")


@query(_SUCC_STRICT + "SELECT q, idx - start AS step, idx, value FROM b JOIN v ON idx >= start AND idx < start + 5")
def ef_iter_from_succ_strict(spark, d):
    seq = _seq(spark, d)
    at = seq.succ(_probes(spark, d), "q", strict=True).select("q", F.col("idx").alias("start"))
    return seq.cursor(at, "start", 5).select("q", "step", "idx", "value")


@query(_PRED_STRICT + "SELECT q, start - 1 - idx AS step, idx, value FROM b JOIN v ON idx < start AND idx >= start - 5")
def ef_iter_back_from_pred_strict(spark, d):
    seq = _seq(spark, d)
    at = seq.pred(_probes(spark, d), "q", strict=True).select("q", F.col("idx").alias("start"))
    return seq.cursor(at, "start", 5, backward=True).select("q", "step", "idx", "value")


@query("SELECT row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS step, o_orderkey AS value FROM orders")
def ef_iter_back(spark, d):
    seq = MonotoneSeq.from_values(_t(spark, d, "orders"), "o_orderkey")
    return seq.rows().select((F.lit(seq.n - 1) - F.col("idx")).alias("step"), "value")


@query("WITH v AS (SELECT o_orderkey * 5 AS value, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders), l AS (SELECT greatest(0, length(bin(max(value) // count(*))) - 1) AS w FROM v) SELECT idx, value & ((1::BIGINT << w) - 1) AS low, (value >> w) + idx AS high_pos FROM v, l")
def ef_low_high_split(spark, d):
    return MonotoneSeq.from_values(_t(spark, d, "orders").select((F.col("o_orderkey") * 5).alias("v")), "v").split()


@query("WITH l AS (SELECT count(*) AS n, max(o_orderkey * 5) AS u FROM orders) SELECT (n * (2 + ceil(log2(u / n))))::BIGINT AS bits FROM l")
def ef_estimate_size(spark, d):
    seq = MonotoneSeq.from_values(_t(spark, d, "orders").select((F.col("o_orderkey") * 5).alias("v")), "v")
    return spark.createDataFrame([(seq.estimated_bits(),)], "bits long")


@query("SELECT min(l_orderkey) AS first_value, max(l_orderkey) AS last_value FROM lineitem")
def ef_first_last(spark, d):
    return _seq(spark, d).first_last()


@query("WITH v AS (SELECT o_orderkey AS value, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders) SELECT idx, value FROM v")
def ef_concurrent_build(spark, d):
    rows = dense_index(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    n, top = rows.agg(F.count("*"), F.max("o_orderkey")).first()
    return MonotoneSeq.from_indexed(rows, "idx", "o_orderkey", n, top).rows()


# --------------------------------------------------------------------- bit vectors

_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
_B = f"WITH b AS (SELECT row_number() OVER (ORDER BY {', '.join(_ORDER)}) - 1 AS pos, l_returnflag = 'R' AS bit FROM lineitem) "


def _bits(spark, d) -> BitVector:
    rows = dense_index(_t(spark, d, "lineitem").select(*_ORDER), *_ORDER, name="pos")
    return BitVector.from_bits(rows.select("pos", (F.col("l_returnflag") == "R").alias("bit")), "pos", "bit")


@query(_B + "SELECT count(*) FILTER (WHERE bit) AS ones FROM b")
def bv_count_ones(spark, d):
    return _bits(spark, d).count_ones()


@query(_B + "SELECT pos FROM b WHERE bit")
def bv_iter_ones(spark, d):
    return _bits(spark, d).ones()


@query(_B + "SELECT pos FROM b WHERE NOT bit")
def bv_iter_zeros(spark, d):
    return _bits(spark, d).zeros()


@query(_B + "SELECT pos, NOT bit AS bit FROM b")
def bv_flip(spark, d):
    return _bits(spark, d).flip().bits()


@query(_B + "SELECT c_custkey * 3 AS at, coalesce(sum(CASE WHEN bit THEN 1::BIGINT << (pos - c_custkey * 3) ELSE 0 END), 0)::BIGINT AS value FROM customer LEFT JOIN b ON pos >= c_custkey * 3 AND pos < c_custkey * 3 + 20 GROUP BY c_custkey")
def bv_get_bits(spark, d):
    at = _t(spark, d, "customer").select((F.col("c_custkey") * 3).alias("at"), F.lit(20).alias("w"))
    return _bits(spark, d).get_bits(at, "at", "w").drop("w")


@query(_B + "SELECT pos // 64 AS word_idx, sum(CASE WHEN NOT bit THEN 0 WHEN pos % 64 = 63 THEN -9223372036854775808 ELSE 1::BIGINT << (pos % 64)::INT END)::BIGINT AS word FROM b GROUP BY pos // 64")
def bv_pack_words(spark, d):
    return _bits(spark, d).words


@query(_B + "SELECT o_orderkey * 4 AS at, bit FROM orders LEFT JOIN b ON pos = o_orderkey * 4")
def bv_get(spark, d):
    return _bits(spark, d).get(_t(spark, d, "orders").select((F.col("o_orderkey") * 4).alias("at")), "at")


@query(_B + "SELECT pos FROM b WHERE CASE WHEN pos IN (SELECT c_custkey * 3 FROM customer) THEN pos % 2 = 0 ELSE bit END")
def bv_set(spark, d):
    edits = _t(spark, d, "customer").select((F.col("c_custkey") * 3).alias("pos"), (F.col("c_custkey") * 3 % 2 == 0).alias("bit"))
    return _bits(spark, d).set(edits, "pos", "bit").ones()


@query(_B + ", n AS (SELECT count(*) AS n FROM b) SELECT pos FROM b WHERE bit UNION ALL SELECT pos + n FROM b, n WHERE bit")
def bv_append(spark, d):
    v = _bits(spark, d)
    return v.append(v).ones()


@query(_B + ", n AS (SELECT count(*) AS n FROM b) SELECT pos FROM b WHERE bit UNION ALL SELECT n + i FROM n, (VALUES (0), (2), (3)) t(i)")
def bv_append_value(spark, d):
    return _bits(spark, d).append_value(13, 5).ones()


@query(_B + "SELECT pos FROM b WHERE bit AND pos < 1000")
def bv_resize(spark, d):
    return _bits(spark, d).resize(1000).ones()


@query(_B + "SELECT pos // 1024 AS chunk, count(*) FILTER (WHERE bit) AS ones FROM b GROUP BY 1")
def bv_chunks(spark, d):
    return _bits(spark, d).chunks(1024).groupBy("chunk").agg(F.count_if("bit").alias("ones"))


@query(_B + "SELECT pos FROM b WHERE bit UNION ALL SELECT count(*) FROM b")
def bv_push(spark, d):
    return _bits(spark, d).push(True).ones()


@query(_B + "SELECT pos FROM b WHERE bit AND pos < (SELECT count(*) - 1 FROM b)")
def bv_pop(spark, d):
    return _bits(spark, d).pop().ones()


@query(_B + "SELECT pos, bit FROM b")
def bv_iter(spark, d):
    return _bits(spark, d).bits()


@query(_B + "SELECT count(*) FILTER (WHERE NOT bit) AS zeros FROM b")
def bv_count_zeros(spark, d):
    return _bits(spark, d).count_zeros()


@query("SELECT i AS pos FROM range((SELECT count(*) FROM customer)) t(i)")
def bv_filled(spark, d):
    """A new vector of ones."""
    return BitVector.filled(spark, _t(spark, d, "customer").count(), True).ones()


@query("SELECT count(*) AS zeros FROM customer")
def bv_reset(spark, d):
    return BitVector.filled(spark, _t(spark, d, "customer").count(), False).count_zeros()


@query("SELECT true AS same, false AS flipped, false AS longer")
def bv_equals(spark, d):
    v = _bits(spark, d)
    return spark.createDataFrame([(v.equals(v.flip().flip()), v.equals(v.flip()), v.equals(v.push(False)))], "same boolean, flipped boolean, longer boolean")


# --------------------------------------------------------------------- rank and select

_E = "WITH e AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, event_type = 'purchase' AS bit FROM events), t AS (SELECT count(*) AS n, count(*) FILTER (WHERE bit) AS ones FROM e) "


def _ranked(spark, d) -> RankSelect:
    rows = dense_index(_t(spark, d, "events").select("event_id", "event_type"), "event_id", name="pos")
    return RankSelect.build(BitVector.from_bits(rows.select("pos", (F.col("event_type") == "purchase").alias("bit")), "pos", "bit"))


def _positions(spark, d) -> DataFrame:
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("at"))


_RANK = _E + ", c AS (SELECT pos, sum(bit::INT) OVER (ORDER BY pos) - bit::INT AS before FROM e) "


@query(_RANK + "SELECT o_orderkey AS at, coalesce(before, ones)::BIGINT AS rank FROM orders CROSS JOIN t LEFT JOIN c ON pos = o_orderkey")
def rank1(spark, d):
    return _ranked(spark, d).rank(_positions(spark, d), "at")


@query(_RANK + "SELECT o_orderkey AS at, (o_orderkey - coalesce(before, ones))::BIGINT AS rank FROM orders CROSS JOIN t LEFT JOIN c ON pos = o_orderkey")
def rank0(spark, d):
    return _ranked(spark, d).rank_zero(_positions(spark, d), "at")


@query(_E + ", s AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS r FROM e WHERE bit) SELECT c_custkey * 3 AS r, pos FROM customer LEFT JOIN s ON s.r = c_custkey * 3")
def select1(spark, d):
    return _ranked(spark, d).select(_t(spark, d, "customer").select((F.col("c_custkey") * 3).alias("r")), "r")


@query(_E + ", s AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS r FROM e WHERE NOT bit) SELECT c_custkey * 7 AS r, pos FROM customer LEFT JOIN s ON s.r = c_custkey * 7")
def select0(spark, d):
    return _ranked(spark, d).select_zero(_t(spark, d, "customer").select((F.col("c_custkey") * 7).alias("r")), "r")


@query("WITH w AS (SELECT o_orderkey AS k, o_orderkey * 7919 + 13 AS word FROM orders), s AS (SELECT k, word, i, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS r FROM w, range(63) t(i) WHERE (word >> i::INT) & 1 = 1) SELECT k, max(CASE WHEN r = 2 THEN i END) AS pos FROM s GROUP BY k UNION ALL SELECT k, NULL FROM w WHERE word = 0")
def select_in_word(spark, d):
    w = _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") * 7919 + 13).alias("word"))
    return w.select("k", fx.select_in_word(F.col("word"), F.lit(2)).alias("pos"))


@query("WITH w AS (SELECT o_orderkey AS k, o_orderkey * 7919 + 13 AS word FROM orders), s AS (SELECT k, i, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS r FROM w, range(63) t(i) WHERE (word >> i::INT) & 1 = 0) SELECT k, i AS pos FROM s WHERE r = 5")
def select_zero_in_word(spark, d):
    w = _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") * 7919 + 13).alias("word"))
    return w.select("k", fx.select_zero_in_word(F.col("word"), F.lit(5)).alias("pos"))


# ----------------------------------------------------------------------- bit fields


def _sizes(spark, d) -> FieldVector:
    return FieldVector.from_slice(_t(spark, d, "part"), "p_partkey", "p_size")


@query("SELECT length(bin(max(p_size))) AS width, count(*) AS len FROM part")
def bfv_from_slice_width(spark, d):
    v = _sizes(spark, d)
    return spark.createDataFrame([(v.width, v.length)], "width long, len long")


@query("SELECT l_partkey AS i, p_size::BIGINT AS val FROM (SELECT DISTINCT l_partkey FROM lineitem) LEFT JOIN part ON l_partkey = p_partkey")
def bfv_get(spark, d):
    return _sizes(spark, d).get(_t(spark, d, "lineitem").select(F.col("l_partkey").alias("i")).distinct(), "i")


@query("SELECT p_partkey AS idx, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 50 ELSE p_size END::BIGINT AS val FROM part")
def bfv_set(spark, d):
    edits = _t(spark, d, "part").where("p_partkey % 3 = 0").select("p_partkey", (F.col("p_partkey") % 50).alias("v"))
    return _sizes(spark, d).set(edits, "p_partkey", "v").rows


@query("SELECT a.p_partkey AS idx, coalesce(b.p_size, a.p_size)::BIGINT AS val FROM part a LEFT JOIN part b ON a.p_partkey >= 70 AND a.p_partkey < 120 AND b.p_partkey = a.p_partkey - 60")
def bfv_copy(spark, d):
    v = _sizes(spark, d)
    return v.copy(10, v, 70, 50).rows


@query("SELECT p_partkey AS idx, (p_size // 2)::BIGINT AS val FROM part")
def bfv_apply(spark, d):
    return _sizes(spark, d).apply(lambda v: F.expr("val div 2")).rows


@query("SELECT p_partkey AS idx, p_size::BIGINT AS val FROM part WHERE p_partkey >= 100")
def bfv_iter_from(spark, d):
    return _sizes(spark, d).scan(100)


@query("SELECT i AS idx, 0::BIGINT AS val FROM range((SELECT count(*) FROM part)) t(i)")
def bfv_zeros(spark, d):
    return FieldVector.zeros(spark, 6, _t(spark, d, "part").count()).rows


@query("SELECT p_partkey AS idx, p_size::BIGINT AS val FROM part UNION ALL SELECT count(*), 7 FROM part")
def bfv_push(spark, d):
    return _sizes(spark, d).push(7).rows


@query("SELECT p_partkey AS idx, p_size::BIGINT AS val FROM part WHERE p_partkey < (SELECT count(*) - 1 FROM part)")
def bfv_pop(spark, d):
    return _sizes(spark, d).pop().rows


@query("SELECT i AS idx, coalesce(p_size, 3)::BIGINT AS val FROM range((SELECT count(*) + 100 FROM part)) t(i) LEFT JOIN part ON i = p_partkey")
def bfv_resize(spark, d):
    v = _sizes(spark, d)
    return v.resize(v.length + 100, 3).rows


@query("SELECT p_partkey AS idx, 0::BIGINT AS val FROM part")
def bfv_reset(spark, d):
    return _sizes(spark, d).filled(0).rows


@query("SELECT true AS same, false AS reset")
def bfv_equals(spark, d):
    v = _sizes(spark, d)
    return spark.createDataFrame([(v.equals(v.copy(0, v, 0, v.length)), v.equals(v.filled(0)))], "same boolean, reset boolean")


@query("WITH w AS (SELECT length(bin(max(p_size))) AS w FROM part) SELECT p_partkey * w + i AS pos FROM part, w, range(32) t(i) WHERE i < w AND (p_size >> i::INT) & 1 = 1")
def bfv_pack(spark, d):
    """Set bits of all fields, one after another."""
    return _sizes(spark, d).pack().ones()


@query("SELECT p_partkey - 20 AS idx, p_size::BIGINT AS val FROM part WHERE p_partkey >= 20 AND p_partkey < 150")
def bfv_slice(spark, d):
    return _sizes(spark, d).slice(20, 150).rows


@query("SELECT p_partkey // 32 AS chunk, sum(p_size)::BIGINT AS total FROM part GROUP BY 1")
def bfv_chunks(spark, d):
    return _sizes(spark, d).chunks(32).groupBy("chunk").agg(F.sum("val").alias("total"))


# -------------------------------------------------------------------------- strings

_S = "WITH s AS (SELECT p_name AS s, row_number() OVER (ORDER BY p_name) - 1 AS idx FROM part), w AS (SELECT p_name AS q FROM part UNION SELECT r_name FROM region) "


def _names(spark, d) -> StringList:
    return StringList.sorted(_t(spark, d, "part"), "p_name")


def _words(spark, d) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_name").alias("q")).union(_t(spark, d, "region").select("r_name")).distinct()


@query(_S + "SELECT idx AS i, s FROM s")
def rcl_get(spark, d):
    """Every position."""
    v = _names(spark, d)
    return v.get(spark.range(v.n).withColumnRenamed("id", "i"), "i")


@query(_S + "SELECT q, min(idx) AS idx FROM w LEFT JOIN s ON s = q GROUP BY q")
def rcl_index_of(spark, d):
    """Every name, and words that are none."""
    return _names(spark, d).index_of(_words(spark, d), "q")


@query(_S + "SELECT q FROM w WHERE q IN (SELECT s FROM s)")
def rcl_contains(spark, d):
    return _names(spark, d).contains(_words(spark, d), "q")


@query(_S + "SELECT idx, s FROM s WHERE idx >= 150")
def rcl_iter_from(spark, d):
    return _names(spark, d).scan(150)


_LCP = "WITH a AS (SELECT c_name AS s, row_number() OVER (ORDER BY c_name) - 1 AS idx FROM customer), l AS (SELECT idx, s, lag(s) OVER (ORDER BY idx) AS last FROM a), x AS (SELECT idx, s, last, CASE WHEN last IS NULL THEN 0 ELSE len(list_filter(range(1, least(length(s), length(last)) + 1), lambda i: s[:i] = last[:i])) END AS lcp FROM l) "


@query(_LCP + "SELECT idx, lcp::BIGINT AS lcp FROM x")
def rcl_lcp(spark, d):
    return StringList.sorted(_t(spark, d, "customer"), "c_name").prefixes().select("idx", "lcp")


def _vb(v: str) -> str:
    return f"CASE WHEN {v} < 128 THEN 1 WHEN {v} < 16512 THEN 2 WHEN {v} < 2113664 THEN 3 ELSE 4 END"


@query(_LCP + f"SELECT count(*) AS strings, sum(length(s))::BIGINT AS bytes, max(length(s)) AS longest, sum((idx % 4 = 0)::INT)::BIGINT AS blocks, sum(CASE WHEN idx % 4 = 0 THEN {_vb('length(s)')} + length(s) ELSE {_vb('(length(s) - lcp)')} + {_vb('(length(last) - lcp)')} + length(s) - lcp END)::BIGINT AS code_bytes, sum(CASE WHEN idx % 4 = 0 THEN 0 ELSE lcp END)::BIGINT AS saved FROM x")
def rcl_stats(spark, d):
    return StringList.sorted(_t(spark, d, "customer"), "c_name").stats()


@query(f"SELECT o_orderkey AS v, {_vb('o_orderkey * 200')}::BIGINT AS n FROM orders")
def rcl_vbyte_len(spark, d):
    o = _t(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("v"), fx.vbyte_len(F.col("o_orderkey") * 200).alias("n"))


@query("SELECT row_number() OVER (ORDER BY c_name) - 1 AS idx, c_name AS s FROM customer")
def rcl_encode_decode(spark, d):
    v = StringList.sorted(_t(spark, d, "customer"), "c_name", ratio=8)
    return StringList.decode(v.encode(), v.ratio)


@query("SELECT row_number() OVER (ORDER BY c_name) - 1 AS idx, c_name AS s FROM customer")
def rcl_stored_blocks(spark, d):
    """Coded blocks, written and read again."""
    v = StringList.sorted(_t(spark, d, "customer"), "c_name", ratio=8)
    return StringList.decode(materialize(v.encode(), "coded-blocks"), v.ratio)


@query("SELECT row_number() OVER (ORDER BY p_name) - 1 AS idx, p_name AS s FROM part")
def rcl_save_load(spark, d):
    """A list saved and loaded."""
    path = new_path(spark, "saved-list")
    lines.save(_names(spark, d), path)
    return lines.load(spark, StringList, path).rows


@query("SELECT c_name AS value FROM customer")
def read_compressed_lines(spark, d):
    """Lines of a compressed text file."""
    path = new_path(spark, "lines")
    _t(spark, d, "customer").select("c_name").write.option("compression", "gzip").text(path)
    return lines.read_lines(spark, path)


@query("WITH p AS (SELECT DISTINCT o_orderpriority AS s FROM orders), n AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS j FROM p) SELECT o_orderkey AS i, j, s FROM orders JOIN n ON s = o_orderpriority")
def mrcl_get(spark, d):
    o = _t(spark, d, "orders")
    v = StringList.sorted(o.select("o_orderpriority").distinct(), "o_orderpriority")
    index_map = v.index_of(o.select(F.col("o_orderkey").alias("i"), "o_orderpriority"), "o_orderpriority").select("i", F.col("idx").alias("j"))
    return mapped_get(v, index_map, "i", "j")


@query("SELECT c_custkey AS c, n_name AS s FROM customer JOIN nation ON c_nationkey = n_nationkey")
def slice_seq_get(spark, d):
    v = StringList.from_indexed(_t(spark, d, "nation"), "n_nationkey", "n_name", check_sorted=False)
    return v.get(_t(spark, d, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("k")), "k").drop("k")


# ------------------------------------------------------------------------ functions


@query("SELECT o_custkey AS q, c_nationkey AS value FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN customer ON o_custkey = c_custkey")
def vfunc_get(spark, d):
    f = func.KeyedFunction.build(_t(spark, d, "customer"), "c_custkey", "c_nationkey")
    return f.get(_t(spark, d, "orders").select(F.col("o_custkey").alias("q")).distinct(), "q")


@query("SELECT l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def vfunc_dup_keys(spark, d):
    return func.duplicate_keys(_t(spark, d, "lineitem"), "l_orderkey")


#: Values of ``compvfunc_get`` with a codeword of their own.
CODEWORDS = 1 << 16

_H = "WITH h AS (SELECT p_size::BIGINT AS value, count(*) AS n FROM part GROUP BY 1), o AS (SELECT value, n, row_number() OVER (ORDER BY n DESC, value) - 1 AS pos FROM h) "


@query(_H + "SELECT value, n, pos FROM o")
def vfunc2_histogram(spark, d):
    return func.histogram(_t(spark, d, "part"), "p_size")


@query(_H + ", t AS (SELECT sum(n) AS total, length(bin(max(value))) AS w FROM o), r AS (SELECT r, (1::BIGINT << r::INT) - 1 AS kept FROM range(64) x(r), t WHERE r <= w), c AS (SELECT r, round(1.11::DOUBLE * any_value(total) * greatest(1, r) + 1.11::DOUBLE * (any_value(total) - coalesce(sum(n), 0)) * any_value(w) + any_value(kept) * 64, 3) AS cost FROM r CROSS JOIN t LEFT JOIN o ON pos < kept GROUP BY r) SELECT r, cost FROM c ORDER BY cost, r LIMIT 1")
def vfunc2_optimal_r(spark, d):
    return func.optimal_split(_t(spark, d, "part"), "p_size")


@query("SELECT DISTINCT l_partkey AS q, p_size::BIGINT AS value FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def vfunc2_get(spark, d):
    f = func.TwoStepFunction.build(_t(spark, d, "part"), "p_partkey", "p_size")
    return f.get(_t(spark, d, "lineitem").select(F.col("l_partkey").alias("q")).distinct(), "q")


@query("WITH h AS (SELECT count(*) AS n FROM part GROUP BY p_size), t AS (SELECT sum(n)::DOUBLE AS total FROM h) SELECT round(-sum(n / total * log2(n / total)), 6) AS entropy FROM h, t")
def compvfunc_entropy(spark, d):
    return func.entropy(_t(spark, d, "part"), "p_size")


@query("SELECT p_partkey AS q, p_size::BIGINT AS value FROM part")
def compvfunc_get(spark, d):
    """Values through their Huffman code: each key's codeword is decoded again, rare values' from the escape and their bits."""
    part = _t(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("value"))
    book, _ = func.HuffmanCode.from_values(part, "value", CODEWORDS)
    words = {v: f"{c:0{n}b}" for v, (c, n) in book.codewords().items()}
    escape = words.pop(None, None)
    code = spark.createDataFrame(list(words.items()), "v long, w string")
    rare = F.concat(F.lit(escape), F.lpad(F.bin("value"), book.escape_bits, "0"))
    stored = part.join(F.broadcast(code), F.col("value") == F.col("v"), "left").select("p_partkey", F.coalesce("w", rare).alias("word"))
    bits = F.when(F.col("word").startswith(F.lit(escape)), F.conv(F.substring("word", len(escape or "") + 1, book.escape_bits), 2, 10).cast("long"))
    return stored.join(F.broadcast(code), F.col("word") == F.col("w"), "left").select(F.col("p_partkey").alias("q"), F.coalesce("v", bits).alias("value"))


@query("SELECT l_orderkey AS q, rank FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rank FROM orders) ON l_orderkey = o_orderkey")
def mmphf_rank_int(spark, d):
    m = func.MonotoneRank.build(_t(spark, d, "orders"), "o_orderkey")
    return m.get(_t(spark, d, "lineitem").select(F.col("l_orderkey").alias("q")).distinct(), "q")


@query("SELECT c_name AS key, row_number() OVER (ORDER BY c_name) - 1 AS rank FROM customer")
def mmphf_rank_str(spark, d):
    return func.MonotoneRank.build(_t(spark, d, "customer"), "c_name").table


@query("WITH k AS (SELECT o_orderkey AS key, row_number() OVER (ORDER BY o_orderkey) - 1 AS rank FROM orders), s AS (SELECT ceil(1 + 1.11 * ln(2) + ln(count(*)) - ln(1 + ln(count(*))))::BIGINT AS size FROM k), b AS (SELECT rank // (1::BIGINT << length(bin(size - 1))::INT) AS bucket, min(key) AS a, max(key) AS b FROM k, s GROUP BY 1) SELECT bucket, CASE WHEN a = b THEN 64 ELSE 64 - length(bin(xor(a, b))) END AS lcp FROM b")
def mmphf_bucket_lcp(spark, d):
    return func.MonotoneRank.build(_t(spark, d, "orders"), "o_orderkey").bucket_prefixes()


@query("SELECT p_partkey AS q, rank AS value FROM part LEFT JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS rank FROM customer) ON p_partkey = c_custkey")
def signed_get(spark, d):
    m = func.MonotoneRank.build(_t(spark, d, "customer"), "c_custkey")
    return func.signed_get(m.table.withColumnRenamed("rank", "value"), _t(spark, d, "part").select(F.col("p_partkey").alias("q")), "q")


def _prefix_ranks(spark, d, two_step: bool) -> DataFrame:
    o = _t(spark, d, "orders")
    ranks = static.PrefixRank.build(func.MonotoneRank.build(o.select((F.col("o_orderkey") * 1_000_003 % 104_729 * 64 + F.col("o_orderkey")).alias("k")), "k"), two_step)
    return ranks.get(o.select("o_orderkey", (F.col("o_orderkey") * 1_000_003 % 104_729 * 64 + F.col("o_orderkey")).alias("k")), "k").select(F.col("o_orderkey").alias("q"), "rank")


_SCATTERED = "SELECT o_orderkey AS q, row_number() OVER (ORDER BY o_orderkey * 1000003 % 104729 * 64 + o_orderkey) - 1 AS rank FROM orders"


@query(_SCATTERED)
def mmphf_prefix_get(spark, d):
    """Ranks of scattered keys from the bits that a bucket's keys share."""
    return _prefix_ranks(spark, d, False)


@query(_SCATTERED)
def mmphf_prefix2_get(spark, d):
    """The same with the numbers of shared bits behind a two-step function."""
    return _prefix_ranks(spark, d, True)


@query("SELECT c_custkey AS q, c_nationkey::BIGINT AS value FROM customer")
def packed_function_rebuild(spark, d):
    """A function from stored signatures."""
    c = _t(spark, d, "customer")
    store = materialize(static.PackedFunction.signatures(c, "c_custkey", "c_nationkey"), "signatures")
    return static.PackedFunction.from_signatures(store).get(c.select(F.col("c_custkey").alias("q")), "q")


@query("SELECT count(*) AS keys, 8 AS bits FROM customer WHERE c_acctbal < 0")
def filter_metadata(spark, d):
    f = static.PackedFilter.build(_t(spark, d, "customer").where("c_acctbal < 0"), "c_custkey", 8)
    return spark.createDataFrame([(f.function.n, f.bits)], "keys long, bits int")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def filter_absent(spark, d):
    keys = _t(spark, d, "customer").where("c_acctbal < 0")
    return filters.absent(keys, "c_custkey", _t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey")


@query("SELECT event_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def stream_contains(spark, d):
    """A stream of events against a static set of users."""
    events = _t(spark, d, "events").select("event_id", "user_id")
    feed, out, state = (new_path(spark, f"stream-{x}") for x in ("in", "out", "state"))
    events.write.parquet(feed)
    stream = spark.readStream.schema(events.schema).parquet(feed)
    kept = lookups.stream_filter(stream, "user_id", _t(spark, d, "customer").where("c_acctbal < 0"), "c_custkey").select("event_id")
    kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kept.schema).parquet(out)


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def filter_contains(spark, d):
    keys = _t(spark, d, "customer").where("c_acctbal < 0")
    return filters.contains(keys, "c_custkey", _t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey")


@query("SELECT count(*) AS positives FROM customer WHERE c_acctbal < 0")
def filter_no_false_negatives(spark, d):
    """All keys pass a filter of 8-bit fingerprints."""
    keys = _t(spark, d, "customer").where("c_acctbal < 0")
    return filters.FingerprintFilter.build(keys, "c_custkey", 8).contains(keys, "c_custkey").agg(F.count("*").alias("positives"))


@query("SELECT c_custkey AS q, c_nationkey::BIGINT AS value FROM customer")
def packed_function_get(spark, d):
    """Every key's value from the XOR of three cells."""
    c = _t(spark, d, "customer")
    return static.PackedFunction.build(c, "c_custkey", "c_nationkey").get(c.select(F.col("c_custkey").alias("q")), "q")


@query("SELECT c_custkey AS q FROM customer WHERE c_acctbal < 0")
def packed_filter_contains(spark, d):
    """All keys pass a packed filter; with 40 bits, no other customer does."""
    c = _t(spark, d, "customer")
    return static.PackedFilter.build(c.where("c_acctbal < 0"), "c_custkey", 40).contains(c.select(F.col("c_custkey").alias("q")), "q")


# -------------------------------------------------------------------- lists and arrays


@query("SELECT n AS pos, s_name AS v FROM range((SELECT count(*) * 3 FROM supplier)) r(n) LEFT JOIN supplier ON n = s_suppkey * 3")
def partial_array_get(spark, d):
    s = _t(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("pos"), F.col("s_name").alias("v"))
    n = s.count()
    a = lists.PartialArray.build(s, "pos", "v", 3 * n, n)
    return a.get(spark.range(3 * n).withColumnRenamed("id", "pos"), "pos")


@query("SELECT i AS pos, p_name AS v FROM range((SELECT count(*) FROM part)) r(i) LEFT JOIN part ON i = p_partkey")
def partial_array_dense(spark, d):
    """Every position has a value."""
    rows = _t(spark, d, "part")
    n = rows.count()
    return lists.PartialArray.build(rows, "p_partkey", "p_name", n).get(spark.range(n).withColumnRenamed("id", "pos"), "pos")


@query("SELECT p_partkey AS i, p_size::BIGINT AS val FROM part")
def psil_from_sums(spark, d):
    """A list from sums that are given."""
    v = lists.PrefixSumList.build(_t(spark, d, "part"), "p_partkey", "p_size")
    w = lists.PrefixSumList.from_sums(v.sums, "idx", "sum")
    return w.get(spark.range(w.n).withColumnRenamed("id", "i"), "i")


@query("WITH w AS (SELECT p_partkey AS idx, length(bin(p_size - 1 + 1)) - 1 AS w FROM part), n AS (SELECT count(*) AS n FROM part) SELECT idx, coalesce(sum(w) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin FROM (SELECT * FROM w UNION ALL SELECT n, 0 FROM n)")
def cil_delimiters(spark, d):
    return lists.CompactList.build(_t(spark, d, "part"), "p_partkey", "p_size", 1).delimiters()


@query("SELECT DISTINCT l_partkey AS i, p_size::BIGINT AS val FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def cil_get(spark, d):
    v = lists.CompactList.build(_t(spark, d, "part"), "p_partkey", "p_size", 1)
    return v.get(_t(spark, d, "lineitem").select(F.col("l_partkey").alias("i")).distinct(), "i")


@query("WITH n AS (SELECT count(*) AS n FROM part), v AS (SELECT p_partkey AS i, p_size AS v FROM part UNION ALL SELECT n, 0 FROM n) SELECT i, coalesce(sum(v) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prefix_sum FROM v")
def psil_prefix_sum(spark, d):
    v = lists.PrefixSumList.build(_t(spark, d, "part"), "p_partkey", "p_size")
    return v.prefix_sum(spark.range(v.n + 1).withColumnRenamed("id", "i"), "i")


@query("SELECT p_partkey AS i, p_size::BIGINT AS val FROM part")
def psil_get(spark, d):
    v = lists.PrefixSumList.build(_t(spark, d, "part"), "p_partkey", "p_size")
    return v.get(spark.range(v.n).withColumnRenamed("id", "i"), "i")


# ----------------------------------------------------------- parentheses, chunks, systems

_P = "WITH k AS (SELECT o_orderkey AS o, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1), c AS (SELECT o, n, coalesce(sum(2 * n + 2) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM k) "


@query(_P + "SELECT base AS open_pos, base + 2 * n + 1 AS close_pos, 1::BIGINT AS depth FROM c UNION ALL SELECT base + 1 + 2 * i, base + 2 + 2 * i, 2 FROM c, LATERAL (SELECT unnest(range(n)) AS i)")
def bp_find_close(spark, d):
    """Every order opens, has a pair for each of its lines, and closes."""
    o, li = _t(spark, d, "orders").select(F.col("o_orderkey").alias("o")), _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.count("*").alias("n"))
    k = o.join(li, "o", "left").select("o", F.coalesce("n", F.lit(0)).alias("n"))
    k = lists_prefix(k)
    bits = k.select("base", "n", F.explode(F.sequence(F.lit(0), F.col("n") * 2 + 1)).alias("i"))
    is_open = (F.col("i") == 0) | (F.col("i") % 2 == 1) & (F.col("i") <= F.col("n") * 2)
    return parens.matched(bits.select((F.col("base") + F.col("i")).alias("pos"), is_open.alias("open")), "pos", "open")


def lists_prefix(k: DataFrame) -> DataFrame:
    """(base, n): parentheses before each order."""
    from ..operators.scan import prefix_sums

    return prefix_sums(k.withColumn("size", F.col("n") * 2 + 2), "size", "o", name="base").select("base", "n")


@query("WITH RECURSIVE w AS (SELECT c_custkey AS i, count(l_orderkey) AS w FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1), n AS (SELECT count(*) AS n FROM w), x AS (SELECT i, coalesce(sum(w) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c FROM (SELECT * FROM w UNION ALL SELECT n, 0 FROM n)), s AS (SELECT a.i AS lo, coalesce((SELECT min(b.i) FROM x b WHERE b.c >= a.c + 2000), (SELECT n FROM n)) AS hi FROM x a), r AS (SELECT 0::BIGINT AS chunk, lo, hi FROM s WHERE lo = 0 UNION ALL SELECT chunk + 1, s.lo, s.hi FROM r JOIN s ON s.lo = r.hi WHERE r.hi < (SELECT n FROM n)) SELECT chunk, lo, hi FROM r")
def fair_chunks(spark, d):
    li = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.count("*").alias("n"))
    w = _t(spark, d, "customer").join(li, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("w"))
    return chunks.fair_chunks(w, "c_custkey", "w", 2000)


@query("SELECT p_partkey AS system, eq, ((p_size >> eq::INT) & 1)::BIGINT AS c FROM part, range(3) t(eq)")
def f2_solve(spark, d):
    """For every part, three equations whose constants are bits of its size; each equation's sum over the solution is its constant."""
    p = _t(spark, d, "part").select(F.col("p_partkey").cast("long").alias("system"), "p_size")
    terms = p.select("system", F.explode(F.expr("array(named_struct('eq', 0L, 'var', 0L), named_struct('eq', 0L, 'var', 1L), named_struct('eq', 1L, 'var', 1L), named_struct('eq', 1L, 'var', 2L), named_struct('eq', 2L, 'var', 2L))")).alias("t")).select("system", "t.eq", "t.var")
    constants = p.select("system", "p_size", F.explode(F.expr("sequence(0L, 2L)")).alias("eq")).select("system", "eq", F.getbit(F.col("p_size").cast("long"), F.col("eq").cast("int")).cast("long").alias("c"))
    return terms.join(f2.solve_systems(terms, constants), ["system", "var"]).groupBy("system", "eq").agg(F.bit_xor("value").alias("c"))
