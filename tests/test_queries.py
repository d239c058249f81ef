"""Every query with SQL against DuckDB at the smallest scale; sources, streams and the command line."""

import os

import pytest

import __spark_entry__ as entry
from rankwell import cli
from rankwell.operators.func import HuffmanCode, KeyedFunction
from rankwell.plans import catalogue
from rankwell.sources import lines
from rankwell.streaming import lookups

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect()]
    rel = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    want = [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rel.project(", ".join(f'"{c}"' for c in cols)).fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize(("name", "table", "col"), [("ef_get", "orders", "o_orderkey"), ("rcl_get", "part", "p_name"), ("rcl_index_of", "part", "p_name"), ("rcl_contains", "part", "p_name")])
def test_every_position(spark, name, table, col):
    """Nothing of the table is left out of the probes."""
    got = catalogue.QUERIES[name](spark, DATA).drop("i", "idx")
    want = spark.read.parquet(f"{DATA}/{table}.parquet").select(col)
    assert want.exceptAll(got).isEmpty() if name.endswith("get") else want.subtract(got).isEmpty()


def test_rare_values(spark, tmp_path):
    """More values than codewords: every key is decoded."""
    n = (1 << 16) + 1000
    spark.range(n).selectExpr("id AS p_partkey", "CASE WHEN id < 9 THEN 3 ELSE id END AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    got = catalogue.compvfunc_get(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(i, 3 if i < 9 else i) for i in range(n)]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sources(spark, tmp_path):
    import gzip

    (tmp_path / "a.txt").write_bytes(b"x\r\ny\nz")
    with gzip.open(tmp_path / "a.gz", "wb") as f:
        f.write(b"p\nq\n")
    assert [r.value for r in lines.read_lines(spark, str(tmp_path / "a.txt")).collect()] == ["x", "y", "z"]
    assert [r.value for r in lines.read_lines(spark, str(tmp_path / "a.gz")).collect()] == ["p", "q"]
    f = KeyedFunction.build(lines.synthetic(spark, 50, "zipf", 100), "key", "value")
    lines.save(f, str(tmp_path / "f"))
    assert lines.load(spark, KeyedFunction, str(tmp_path / "f")).table.count() == 50
    assert lines.from_items(spark, ["a", "b"], "s string").count() == 2


def test_cli(spark, tmp_path):
    (tmp_path / "w.txt").write_text("b\na\nc\n")
    out = str(tmp_path / "o")
    assert cli.run(spark, ["list", "--file", str(tmp_path / "w.txt"), "--out", out])["n"] == 3
    assert cli.run(spark, ["usage", out])["bytes"] > 0
    assert cli.run(spark, ["function", "--n", "20", "--values", "geometric"])["n"] == 20
    assert cli.run(spark, ["filter", "--n", "20"])["n"] == 20
    assert cli.run(spark, ["huffman", "--n", "50", "--values", "zipf"])["bits"] > 0
    (tmp_path / "p.txt").write_text("2\n0\n1\n")
    assert cli.run(spark, ["map", "--file", str(tmp_path / "p.txt"), "--invert"])["n"] == 3


def test_huffman_escape(spark, tmp_path, monkeypatch):
    """Values beyond the codewords are counted with the escape; no row is left out."""
    (tmp_path / "v.txt").write_text("".join(f"k{i}\n" for i in range(40)))
    monkeypatch.setattr(cli, "MAX_SYMBOLS", 3, raising=False)
    code = HuffmanCode.from_counts({i: 1 for i in range(40)}, 3)
    got = cli.run(spark, ["huffman", "--file", str(tmp_path / "v.txt")])
    assert got == {"symbols": 4, "bits": sum(code.encoded_len(i) for i in range(40))}


def test_streaming(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    users = events.select("user_id").distinct().where("user_id % 2 = 0")
    q = lookups.stream_filter(stream, "user_id", users, "user_id").writeStream.format("memory").queryName("kept").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("kept").count() == events.where("user_id % 2 = 0").count()
    q = lookups.windowed_counts(stream, "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counted").agg({"n": "sum"}).first()[0] == events.count()
