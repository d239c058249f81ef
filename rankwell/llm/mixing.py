"""Mixing sources to target weights, with DataFrame functions only.

Each source's documents lie end to end in an order by hash, and this run of words
is cut into blocks of fixed length.  Every output shard draws how many of its
slots each source gets (multinomial, by the targets); a source's draws are
numbered, and each number is mapped through that source's pseudorandom
permutation of its block indices.  Joining on (source, block index) yields what
the mix takes of every document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import dense_index, prefix_sums
from .common import bucket_of, buckets_for, join_small, materialize, n_words

#: Up to so many sources are broadcast; more meet the documents in a salted join.
BROADCAST_SOURCES = 100_000
#: Rounds of the swap-or-not permutation.
ROUNDS = 16
#: Cells of the unit interval by which a draw finds its source, at least.
CELLS = 1024
#: Slots that a task of draws makes, about, and most such tasks.
TASK_SLOTS, TASKS = 1 << 16, 20_000


@dataclass(frozen=True)
class MixSpec:
    """``weights`` repeat over the sources by code point (null last); ``share`` of all
    words is the size of the mix; no target exceeds ``cap`` times its source's size."""

    weights: tuple[float, ...] = (3, 1, 2)
    share: float = 1.5
    cap: float = 2.0
    block: int = 256
    shard_slots: int = 4096
    max_shards: int = 65_536
    seed: int = 17


def with_targets(sizes: DataFrame, spec: MixSpec) -> DataFrame:
    """``sizes`` (source, size) with sid (by code point, null last) and target.

    Shares are by weight; what exceeds a cap goes to the others by weight.  A source is over its
    cap if the level (words left for each weight) is high enough, and the level only rises as
    capped sources leave, so each round is one aggregate over the sources.
    """
    order = dense_index(sizes, F.col("source").isNull(), F.col("source"), name="sid")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in spec.weights)), (F.col("sid") % len(spec.weights) + 1).cast("int"))
    order = materialize(order.withColumn("weight", weight).withColumn("most", F.lit(float(spec.cap)) * F.col("size")), "mix-sources")
    whole, all_ = order.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    words = spec.share * whole
    left, total = words, all_
    while True:
        level = F.lit(left) * F.col("weight") / F.lit(total)
        over = level > F.col("most")
        capped, gone = order.where(over).agg(F.coalesce(F.sum("most"), F.lit(0.0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
        if all_ - gone <= 0 or (words - capped, all_ - gone) == (left, total):
            break
        left, total = words - capped, all_ - gone
    return order.select("sid", "source", "size", F.when(over, F.col("most")).otherwise(level).alias("target"))


def _source_table(sizes: DataFrame, spec: MixSpec) -> tuple[DataFrame, int]:
    """One row per source: blocks, and slots (whole epochs, then a part of one more), numbered from ``first_slot``; and all slots."""
    out = with_targets(sizes, spec).withColumn("words", F.least(F.floor("target"), F.floor(F.lit(float(spec.cap)) * F.col("size"))).cast("long"))
    full = F.col("size") > 0
    out = out.withColumn("epochs", F.when(full, F.expr("words div size")).otherwise(0).cast("long")).withColumn("rest", F.when(full, F.expr("words % size")).otherwise(0).cast("long"))
    out = out.withColumn("blocks", F.expr(f"(size + {spec.block - 1}) div {spec.block}")).withColumn("even", F.expr(f"size div {spec.block}"))
    out = out.withColumn("slots", F.expr(f"epochs * blocks + (rest + {spec.block - 1}) div {spec.block}"))
    out = prefix_sums(out, "slots", "sid", name="first_slot")
    out = materialize(out.select("sid", "source", F.col("size").alias("source_size"), "target", "blocks", "even", "epochs", "rest", "slots", "first_slot"), "mix-source")
    return out, out.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]


def permuted(k: Column, n: Column, sid: Column, epoch: Column, seed: int) -> Column:
    """Swap-or-not: a pseudorandom permutation of 0..n-1, keyed by source, epoch and seed.

    In each round k and (key - k) mod n form a pair, which a keyed bit of the pair swaps or not.
    """

    def step(x: Column, r: Column) -> Column:
        y = F.pmod(F.pmod(F.xxhash64(F.lit(seed), sid, epoch, r), n) - x, n)
        return F.when(F.xxhash64(F.lit(seed + 1), sid, epoch, r, F.greatest(x, y)) % 2 == 0, x).otherwise(y)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), k, step)


_OF_SOURCE = ("slots", "blocks", "even", "epochs", "rest")


def _draws(source: DataFrame, total: int, spec: MixSpec) -> DataFrame:
    """(shard, sid, j) and _OF_SOURCE: each source's numbered draws, as many as it has slots.

    Shards draw independently; a source drawn more often than it has slots loses
    its last draws, and the draws it lacks are dealt to shards by hash.  Counts of draws are few
    rows; they are dealt to tasks by the slots that they make before they become rows each.
    """
    spark = source.sparkSession
    shards = max(1, min(spec.max_shards, -(-total // spec.shard_slots)))
    tasks = max(1, min(TASKS, -(-total // TASK_SLOTS)))
    few = source.count()
    cells = CELLS
    while cells < few:
        cells *= 2
    size = F.lit(float(max(1, total)))
    cell = source.where("slots > 0").select("sid", *_OF_SOURCE, (F.col("first_slot") / size).alias("low"), ((F.col("first_slot") + F.col("slots")) / size).alias("high"))
    cell = cell.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells).cast("int"), F.least(F.lit(cells - 1), F.floor(F.col("high") * cells)).cast("int"))))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(spec.seed), F.lit("draw"), "id"), 11) / F.lit(float(1 << 53))
    at = spark.range(total).select((F.col("id") % shards).alias("shard"), u.alias("u")).withColumn("cell", F.least(F.lit(cells - 1), F.floor(F.col("u") * cells)).cast("int"))
    drawn = at.join(F.broadcast(cell) if few <= BROADCAST_SOURCES else cell, "cell").where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
    drawn = materialize(drawn.groupBy("sid", "shard", *_OF_SOURCE).agg(F.count("*").alias("n")), "mix-draws")  # at most max_shards rows a source
    before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    numbered = drawn.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    kept = numbered.withColumn("end", F.least("slots", F.col("first") + F.col("n"))).where("first < end")
    kept = kept.repartition(tasks, "sid", "shard").select("shard", "sid", *_OF_SOURCE, F.explode(F.expr("sequence(first, end - 1)")).alias("j"))
    had = drawn.groupBy("sid").agg(F.sum("n").alias("had")).withColumnRenamed("sid", "s")
    short = source.where("slots > 0").join(had, F.col("sid") == F.col("s"), "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < slots")
    short = short.select("sid", *_OF_SOURCE, F.explode(F.expr("sequence(had, slots - 1, 4096)")).alias("a")).repartition(tasks, "sid", "a")
    short = short.select("sid", *_OF_SOURCE, F.explode(F.expr("sequence(a, least(slots, a + 4096) - 1)")).alias("j"))
    shard = F.pmod(F.xxhash64(F.lit(spec.seed), "sid", "j"), F.lit(shards)).alias("shard")
    return kept.unionByName(short.select(shard, "sid", *_OF_SOURCE, "j"))


def _taken_blocks(source: DataFrame, total: int, spec: MixSpec) -> DataFrame:
    """(sid, block, epoch, shard, words): a slot takes the first ``words`` words of its block.

    The short block at a source's end keeps its place at the end of each epoch,
    so that an epoch's first k blocks always hold k * block words.
    """
    slots = _draws(source, total, spec)
    slots = slots.withColumn("epoch", F.expr("j div blocks")).withColumn("k", F.expr("j % blocks"))
    mapped = F.when(F.col("k") >= F.col("even"), F.col("k")).otherwise(permuted(F.col("k"), F.col("even"), F.col("sid"), F.col("epoch"), spec.seed))
    words = F.when(F.col("epoch") < F.col("epochs"), F.lit(spec.block)).otherwise(F.least(F.lit(spec.block), F.col("rest") - F.col("k") * spec.block))
    return slots.select("sid", mapped.alias("block"), "epoch", "shard", words.cast("long").alias("words"))


def _placed(docs: DataFrame, spec: MixSpec, keep: tuple[Column, ...] = ()) -> tuple[DataFrame, DataFrame, int]:
    """Documents with size, source and ``start`` (words before it in its source), the sources, and all slots.

    Prefix sums in two levels: over hash buckets of a source, then within a
    bucket, so no task holds a whole source.
    """
    rows = docs.select("doc_id", "source", F.xxhash64("doc_id", "source", "text").alias("h"), n_words(F.col("text")).alias("size"), *keep)
    rows = materialize(rows, "mix-rows")
    sums = materialize(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")), "mix-sizes")
    source, total = _source_table(sums.select("source", "size"), spec)
    few, n = sums.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    n = buckets_for(n)
    sid = source.select("sid", F.col("source").alias("of"), "source_size", "target")
    rows = join_small(rows, sid, F.col("source").eqNullSafe(F.col("of")), F.col("h"), few <= BROADCAST_SOURCES).drop("of", "source").withColumn("bucket", bucket_of(F.col("h"), n))
    upto = Window.unboundedPreceding
    base = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    base = base.select("sid", "bucket", F.coalesce(F.sum("words").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(upto, -1)), F.lit(0)).alias("base"))
    within = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size").rowsBetween(upto, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(base, ["sid", "bucket"])
    return rows.withColumn("start", F.col("base") + F.col("inside")).drop("base", "inside", "bucket", "h"), source, total


def _pieces(rows: DataFrame, spec: MixSpec) -> DataFrame:
    """Each document's part of each block: ``at`` is its place in the block, ``lo`` in the document."""
    b, b0 = F.lit(spec.block), F.expr(f"start div {spec.block}")
    out = rows.where("size > 0").withColumn("block", F.explode(F.sequence(b0, F.expr(f"(start + size - 1) div {spec.block}"))))
    begin = F.greatest("start", F.col("block") * b)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
    return out.withColumn("lo", begin - F.col("start")).withColumn("at", begin - F.col("block") * b).withColumn("n", end - begin)


def mix(docs: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """How many words the mix takes of each document.

    Returns one row per row of ``docs``: doc_id, size, source_size, target (of its
    source) and taken (repeats counted).  A null text has size 0; a null source
    is a source of its own; null and repeated ids are rows like any other; a source
    without words has target 0; an empty table gives an empty result.  Each source
    gives exactly the whole part of its target, each document at most ``cap`` times
    its size, and reruns agree: all draws and permutations are hashes of indices.
    """
    rows, source, total = _placed(docs, spec)
    rows = materialize(rows, "mix-placed")
    slots = _taken_blocks(source, total, spec).select("sid", "block", "words")
    told = ("doc_id", "size", "source_size", "target")
    part = _pieces(rows, spec).join(slots.hint("merge"), ["sid", "block"], "left")  # draws look small to the optimiser until they are rows
    got = F.greatest(F.lit(0), F.least(F.col("n"), F.coalesce("words", F.lit(0)) - F.col("at")))
    taken = part.groupBy("sid", "start", *told).agg(F.sum(got).cast("long").alias("taken"))
    return taken.select(*told, "taken").unionByName(rows.where("size = 0").select(*told, F.lit(0).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """The mix itself, as rows with the columns of ``docs`` (documents): one row for each document
    and epoch that takes of it.

    A document taken whole keeps its text; of one taken in part the row holds
    the taken words, in order, joined by one blank, and n_chars of these.  Rows
    without words are not in the mix.
    """
    columns = docs.columns
    rows, source, total = _placed(docs, spec, (F.struct(*columns).alias("row"),))  # in one column, no name clashes
    rows = materialize(rows, "mix-placed")
    slots = _taken_blocks(source, total, spec)
    part = _pieces(rows.select("sid", "size", "start"), spec).join(slots.hint("merge"), ["sid", "block"])  # as above
    part = part.withColumn("got", F.least(F.col("n"), F.col("words") - F.col("at"))).where("got > 0")
    spans = part.groupBy("sid", "start", "epoch").agg(F.sum("got").alias("got"), F.sort_array(F.collect_list(F.struct("lo", "got"))).alias("spans"))
    text = F.col("row")["text"]
    words = F.split(F.trim(F.regexp_replace(F.translate(text, "\t\n\u000b\f\r", "     "), " {2,}", " ")), " ")
    some = F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(F.col("words"), s["lo"].cast("int") + 1, s["got"].cast("int")))), " ")
    out = rows.where("size > 0").join(spans, ["sid", "start"]).withColumn("words", F.when(F.col("got") < F.col("size"), words))
    out = out.withColumn("new", F.when(F.col("got") < F.col("size"), some).otherwise(text))
    made = {"text": F.col("new"), "n_chars": F.length("new").cast("long")}
    return out.select(*(made[c].alias(c) if c in made else F.col("row")[c].alias(c) for c in columns))
