"""``python -m rankwell.cli``: builds structures from line files and saves them."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.bits import FieldVector
from .operators.filters import FingerprintFilter
from .operators.func import HuffmanCode, KeyedFunction, MonotoneRank, TwoStepFunction
from .operators.scan import dense_index
from .operators.strings import StringList, inverted
from .sources.lines import load, read_lines, save, synthetic

#: Values with a codeword of their own; rarer ones share the escape, which counts as a symbol.
MAX_SYMBOLS = 1 << 20


def _keys(spark: SparkSession, args):
    """(key, value): lines in order with their number, or numbers 0 to n - 1 with values of a distribution."""
    if args.file:
        lines = read_lines(spark, args.file).withColumn("_o", F.monotonically_increasing_id())
        return dense_index(lines.withColumnRenamed("value", "key"), "_o", name="value").select("key", "value")
    return synthetic(spark, args.n, args.values)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rankwell", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("list", "function", "two-step", "huffman", "rank", "filter"):
        c = sub.add_parser(name)
        c.add_argument("--file")
        c.add_argument("--n", type=int, default=0)
        c.add_argument("--values", choices=("uniform", "geometric", "zipf"), default="uniform")
        c.add_argument("--out")
        c.add_argument("--seed", type=int, default=0)
        c.add_argument("--ratio", type=int, default=4)
        c.add_argument("--bits", type=int, default=8)
    c = sub.add_parser("map")
    c.add_argument("--file", required=True)
    c.add_argument("--invert", action="store_true")
    c.add_argument("--out")
    c = sub.add_parser("usage")
    c.add_argument("path")
    return p


def run(spark: SparkSession, argv: list[str]) -> dict:
    args = parser().parse_args(argv)
    if args.command == "usage":
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(args.path)
        return {"bytes": path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()}
    if args.command == "map":
        lines = dense_index(read_lines(spark, args.file).withColumn("_o", F.monotonically_increasing_id()), "_o", name="i")
        m = lines.select("i", F.col("value").cast("long").alias("j"))
        v = FieldVector.from_slice(inverted(m, "i", "j") if args.invert else m, "i", "j")
        if args.out:
            save(v, args.out)
        return {"n": v.length, "width": v.width}
    keys = _keys(spark, args)
    if args.command == "list":
        built = StringList.sorted(keys.select(F.col("key").cast("string").alias("key")), "key", args.ratio)
    elif args.command == "function":
        built = KeyedFunction.build(keys, "key", "value")
    elif args.command == "two-step":
        built = TwoStepFunction.build(keys, "key", "value")
    elif args.command == "huffman":
        code, bits = HuffmanCode.from_values(keys, "value", MAX_SYMBOLS)
        return {"symbols": len(code.codewords()), "bits": bits}
    elif args.command == "rank":
        built = MonotoneRank.build(keys, "key")
    else:
        built = FingerprintFilter.build(keys, "key", args.bits, args.seed)
    if args.out:
        save(built, args.out)
        load(spark, type(built), args.out)
    return {"kind": type(built).__name__, "n": keys.count()}


if __name__ == "__main__":
    print(run(SparkSession.builder.getOrCreate(), sys.argv[1:]))
