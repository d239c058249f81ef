"""Balanced parentheses: matching by depth, over words of 64 positions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import BuildError
from ..scratch import materialize
from .scan import block_sums

#: Words of a block, in which pairs are matched at once: 65,536 positions.
BLOCK_WORDS = 1 << 10


def _words(pos: Column, open_: Column) -> tuple[Column, list[Column]]:
    """The word that holds ``pos``, and its aggregates: positions that open, positions in use, and rows."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), pos.bitwiseAND(F.lit(63)).cast("int"))
    ones = F.bit_or(F.when(open_, bit).otherwise(F.lit(0).cast("long")))
    return F.shiftright(pos, 6), [ones.alias("ones"), F.bit_or(bit).alias("used"), F.count("*").alias("n")]


def _bits(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(words.astype("<i8").view(np.uint8), bitorder="little").astype(bool)


def _split(w: np.ndarray, ones: np.ndarray, used: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs of one run of words as (opening, closing, depth), and what is left as (position, opens, depth).

    An opening one and its match are neighbours among the parentheses of their depth.
    """
    held = _bits(used)
    pos, up = ((w << 6)[:, None] + np.arange(64)).reshape(-1)[held], _bits(ones)[held]
    after = before[0] + np.cumsum(np.where(up, 1, -1))
    depth = np.where(up, after, after + 1)
    order = np.argsort((depth - depth.min()).astype(np.uint16), kind="stable")  # depths of a block span less than 2**16
    pos, up, depth = pos[order], up[order], depth[order]
    first = np.flatnonzero(up[:-1] & (depth[1:] == depth[:-1]))
    left = np.ones(len(pos), bool)
    left[first] = left[first + 1] = False
    return pos[first], pos[first + 1], depth[first], pos[left], up[left], depth[left]


def _matcher(left: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["pos", "open", "depth"] if left else ["open_pos", "close_pos", "depth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("w", "ones", "used", "before")]
            # a block that goes on in the next batch is matched in two runs
            cuts = np.flatnonzero(np.diff(cols[0] // BLOCK_WORDS)) + 1
            for part in zip(*(np.split(c, cuts) for c in cols)):
                found = _split(*part)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (found[3:] if left else found[:3])], names)

    return run


def matched(df: DataFrame, pos: str, open_: str, check: bool = True) -> DataFrame:
    """(open_pos, close_pos, depth) of every opening parenthesis of a densely numbered string.

    Rows become words of 64 positions before anything is sorted.  Runs of words within a block are
    matched by themselves; what they leave, at most one closing and one opening parenthesis of each
    depth, is matched by depth.
    """
    w, packed = _words(F.col("pos"), F.col("open"))
    rows = df.select(F.col(pos).cast("long").alias("pos"), F.col(open_).alias("open"))
    words = materialize(rows.groupBy(w.alias("w")).agg(*packed), "parens-words")
    steps = (F.bit_count("ones") * 2 - F.bit_count("used")).cast("long")
    runs = block_sums(words.withColumn("steps", steps), "steps", "w").select("w", "ones", "used", "before")
    runs = runs.repartition(F.expr(f"w div {BLOCK_WORDS}")).sortWithinPartitions("w")
    left = materialize(runs.mapInArrow(_matcher(True), "pos long, open boolean, depth long"), "parens-left")
    if check:
        sums = words.agg(F.sum("n"), F.sum(F.bit_count("used")), F.coalesce(F.sum(steps), F.lit(0))).first()
        if sums[0] != sums[1]:
            raise BuildError("positions are null or repeated")
        if sums[2] != 0 or left.agg(F.coalesce(F.min("depth"), F.lit(1))).first()[0] < 1:
            raise BuildError("the parentheses are not balanced")
    near = runs.mapInArrow(_matcher(False), "open_pos long, close_pos long, depth long")
    close = F.lead("pos").over(Window.partitionBy("depth").orderBy("pos"))
    far = left.withColumn("close_pos", close).where("open").select(F.col("pos").alias("open_pos"), "close_pos", "depth")
    return near.unionByName(far)


def find_close(pairs: DataFrame, probes: DataFrame, pos: str) -> DataFrame:
    """Adds ``close_pos``; null where the probe isn't an opening parenthesis."""
    p = pairs.select(F.col("open_pos").alias("_o"), "close_pos")
    return probes.join(p, F.col(pos) == F.col("_o"), "left").drop("_o")
