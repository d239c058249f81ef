"""URL filter: explicit rules, and a path-template tree for the urls that no rule judges.

DataFrame functions only.  Paths become templates per host: segments with digits
and segments with many siblings turn into wildcards.  The urls that rules judge are
the labelled ones.  At every level of the tree, sibling branches whose labelled rates do
not differ significantly are merged, and a branch is rejected if its smoothed share of
blocked labels is high.  A url gets the verdict of the deepest branch on its path that has
labels; the host itself is the outermost branch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_small, materialize

#: Up to so many rows are broadcast to the path shapes or urls; more meet them in a salted join.
BROADCAST_ROWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for urls of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class TreeSpec:
    """``depth``: levels of the tree at which segments with many siblings are generalised; deeper ones keep
    their own branches, one for each rest of a path; ``children``: a node with more distinct ones has them
    generalised; ``z2``: squared z up to which siblings are similar;
    rejected if (blocked + smooth) / (labelled + 2 smooth) >= purity."""

    depth: int = 4
    children: int = 16
    z2: float = 3.84
    smooth: float = 1.0
    purity: float = 0.8


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty where the url is null or has no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def _segments(path: Column) -> Column:
    """The path's segments, those with digits as wildcards."""
    wild = lambda s: F.when(s.rlike("[0-9]"), F.concat(F.lit("*"), F.regexp_extract(s, r"(\.[A-Za-z]+)$", 1))).otherwise(s)
    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), wild)


def _small(table: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """``table`` as written, and whether it may be broadcast."""
    table = materialize(table, name)
    return table, table.count() <= BROADCAST_ROWS


def _branches(leaves: DataFrame, spec: TreeSpec) -> DataFrame:
    """``leaves`` with ``t``: the templates of the branches that hold each, from the host ('') to its own.

    At every node of the first levels, the children become one wildcard if they are many.
    """
    out = leaves.withColumn("template", F.lit("")).withColumn("t", F.array(F.lit("")))
    for d in range(spec.depth):
        kids = out.where(F.size("segments") > d).select("host", "template", F.get("segments", F.lit(d)).alias("child")).distinct()
        many = kids.groupBy(F.col("host").alias("h"), F.col("template").alias("of")).agg(F.count("*").alias("kids")).where(F.col("kids") > spec.children).select("h", "of")
        many, small = _small(many.withColumn("many", F.lit(True)), "url-many")
        out = join_small(out, many, (F.col("host") == F.col("h")) & (F.col("template") == F.col("of")), F.col("key"), small, "left").drop("h", "of")
        child = F.when(F.col("many"), F.lit("*")).otherwise(F.get("segments", F.lit(d)))
        inside = F.size("segments") > d
        out = out.withColumn("template", F.when(inside, F.concat("template", F.lit("/"), child)).otherwise(F.col("template"))).drop("many")
        out = out.withColumn("t", F.when(inside, F.concat("t", F.array("template"))).otherwise(F.col("t")))
    rest = F.concat("template", F.lit("/"), F.array_join(F.slice("segments", spec.depth + 1, F.greatest(F.lit(1), F.size("segments"))), "/"))
    return out.withColumn("t", F.when(F.size("segments") > spec.depth, F.concat("t", F.array(rest))).otherwise(F.col("t"))).drop("template", "segments")


def template_verdicts(judged: DataFrame, spec: TreeSpec) -> DataFrame:
    """(host, key, rejected) for every lexical path shape ``key`` of ``judged`` (host, key, segments, labelled, blocked)
    with a labelled branch on its path."""
    leaves = judged.groupBy("host", "key").agg(F.first("segments").alias("segments"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    leaves = materialize(_branches(materialize(leaves, "url-shapes"), spec), "url-leaves")
    told = leaves.where("labelled > 0").select("host", "labelled", "blocked", F.posexplode("t").alias("level", "template"), "t")
    told = told.withColumn("parent", F.when(F.col("level") > 0, F.get("t", F.col("level") - 1)).otherwise(F.lit("")))
    nodes = told.groupBy("host", "level", "parent", "template").agg(F.sum("labelled").cast("double").alias("n"), F.sum("blocked").cast("double").alias("b"))
    pooled = nodes.groupBy("host", "level", "parent").agg(F.sum("n").alias("pn"), F.sum("b").alias("pb"))
    nodes = nodes.join(pooled, ["host", "level", "parent"])
    gap = F.col("b") * F.col("pn") - F.col("n") * F.col("pb")
    nodes = nodes.withColumn("alike", gap * gap <= F.lit(spec.z2) * F.col("n") * F.col("pb") * (F.col("pn") - F.col("pb")))
    merged = nodes.where("alike").groupBy("host", "level", "parent").agg(F.sum("n").alias("mn"), F.sum("b").alias("mb"))
    nodes = nodes.join(merged, ["host", "level", "parent"], "left")
    n, b = (F.when(F.col("alike"), F.col(x)).otherwise(F.col(y)) for x, y in (("mn", "n"), ("mb", "b")))
    rejected = ((b + spec.smooth) >= F.lit(spec.purity) * (n + 2 * spec.smooth)).alias("rejected")
    nodes, small = _small(nodes.select(F.col("host").alias("h"), F.col("level").alias("l"), F.col("template").alias("of"), rejected), "url-nodes")
    on = leaves.select("host", "key", F.posexplode("t").alias("level", "template"))
    on = join_small(on, nodes, (F.col("host") == F.col("h")) & (F.col("level") == F.col("l")) & (F.col("template") == F.col("of")), F.col("key"), small)
    return on.groupBy("host", "key").agg(F.max_by("rejected", "level").alias("rejected"))


def judge_urls(pages: DataFrame, rules: list[Rule], spec: TreeSpec = TreeSpec(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A verdict for every url: the longest fitting rule's, else the template tree's.

    Returns one row per row of ``pages``: the id, host, path, rule (null if none
    fits) and verdict (allow or block).  A null url, or one without ``://``, has
    empty host and path and is judged like any other; repeated rows and null ids
    are kept, other columns are ignored, an empty table gives an empty result.
    Hosts without labelled urls are allowed.

    Counts are grouped by (host, path shape) before anything is shuffled whole, and what is
    joined back on a host, a template or a shape is broadcast if it is small and salted
    if not, so a large host or a frequent url meets in no single task.
    """
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("id", "host", "path", rule.alias("rule"), verdict.alias("told"), _segments(F.col("path")).alias("segments"))
    rows = rows.withColumn("key", F.array_join("segments", "/"))
    labelled = F.col("told").isNotNull().cast("long")
    judged = rows.select("host", "key", "segments", labelled.alias("labelled"), (F.col("told") == "block").cast("long").alias("blocked"))
    judged = judged.withColumn("blocked", F.coalesce("blocked", F.lit(0)))
    rejected, small = _small(template_verdicts(judged, spec).where("rejected").withColumnsRenamed({"host": "h", "key": "k"}), "url-rejected")
    out = join_small(rows, rejected, (F.col("host") == F.col("h")) & (F.col("key") == F.col("k")), F.col("id"), small, "left")
    method = F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("told", method).alias("verdict"))
