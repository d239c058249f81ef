"""HTML extraction with removal of site templates.

A page's element subtrees are hashed and counted per host; subtrees that recur on
many pages of their host are deleted (paragraphs and other text blocks of an article
only if they recur on most), as are elements whose tag, class, id or role says that
they are not part of the article.  What an article or main element
holds is the text, of pages without one all that is left of the body.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .urls import split_url

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: Text blocks: within an article they are content unless they recur on most pages of the host.
TEXT = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th tr tbody thead tfoot".split())
#: Elements that are never part of the article.
DROPPED = frozenset("aside audio button canvas dialog embed form head iframe menu nav noembed noframes noscript object option script search select style svg template textarea title video".split())
#: Page headers and footers; within an article a header is its own.
EDGES = frozenset(("header", "footer"))
#: Words of a class, id or role that mark what is not part of the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising advertisment sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs "
    "footer cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations comment comments reply replies disqus respond widget toolbar pagination pager skip hidden complementary contentinfo dialog search copyright disclaimer".split()
)
#: Start tags that end an open element of these names.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_NO_P = BLOCKS - frozenset("body caption dd dt head html legend li optgroup option tbody td tfoot th thead title tr".split())
_LISTS = frozenset("ul ol dl table menu select".split())
#: Elements from within which an end tag of a paragraph outside has no effect.
_SCOPES = frozenset("article main section div td th li aside body button".split())


@dataclass(frozen=True)
class TemplateSpec:
    """A subtree is a template if it recurs on ``pages`` pages of its host at least, and on ``share`` of them; copies of a page count once.

    For an article's text blocks the bounds are ``text_pages`` and ``text_share``, so that
    short content which recurs by chance stays.
    """

    pages: int = 5
    share: float = 0.3
    text_pages: int = 10
    text_share: float = 0.5


@lru_cache(maxsize=8192)
def _marked(attributes: str) -> tuple[bool, bool, bool]:
    """(not part of an article, a header, the main element) by class, id, role and visibility."""
    names: set[str] = set()
    hidden = main = False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id", "role"):
            names |= set(re.findall(r"[a-z]+", value))
            main = main or name == "role" and value.strip() == "main"
        hidden = hidden or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "")
    return hidden or bool(names & MARKS), "header" in names, main


class _Page:
    """One pass over a page: its text blocks, each with the innermost subtree that holds it, in time linear in the source.

    A subtree's hash is made of its tags and texts, white space squeezed, and of the hashes of
    the subtrees within it.
    """

    def __init__(self, html: str):
        self.html = html
        self.stack: list[list] = []  # name, dropped, article, subtree number
        self.places: dict[str, list[int]] = {}  # of the open elements of each name
        self.block_places: list[int] = []
        self.scope_places: list[int] = []
        self.inner: list[int] = []  # open subtrees
        self.sources: list[list[str]] = []  # what each subtree's hash is made of
        self.prints: list[int] = []
        self.parents: list[int] = []
        self.kinds: list[int] = []  # 1: a text block of an article
        self.blocks: list[tuple[str, bool, int]] = []
        self.parts: list[str] = []
        self._read()

    def _note(self, source: str) -> None:
        if self.inner:
            source = " ".join(source.split())
            if source:
                self.sources[self.inner[-1]].append(source)

    def _flush(self) -> None:
        if self.parts:
            text = " ".join(unescape("".join(self.parts)).split())
            self.parts = []
            if text:
                self.blocks.append((text, bool(self.stack and self.stack[-1][2]), self.inner[-1] if self.inner else -1))

    def _close(self, depth: int) -> None:
        while len(self.stack) > depth:
            name, _, _, number = self.stack[-1]
            if name in BLOCKS:
                self._flush()
                self.block_places.pop()
            if name in _SCOPES:
                self.scope_places.pop()
            self.places[name].pop()
            self.stack.pop()
            if number >= 0:
                self.inner.pop()
                h = xxhash.xxh64_intdigest("\0".join(self.sources[number])) & ~1 | self.kinds[number]
                self.sources[number] = []
                self.prints[number] = h - (1 << 64) if h >> 63 else h
                self._note(f"{h:x}")

    def _open(self, name: str, attributes: str) -> None:
        _, above, inside, _ = self.stack[-1] if self.stack else (None, False, False, -1)
        marked, header, main = _marked(attributes) if attributes.strip() else (False, False, False)
        article = inside or name in ("article", "main") or main
        edge = name in EDGES and (name == "footer" or not inside) or header and not inside
        dropped = above or name in DROPPED or edge or marked and name not in ("html", "body", "article", "main")
        number = -1
        if name in BLOCKS and name not in ("html", "body", "head", "article", "main") and not main:
            number = len(self.prints)
            self.parents.append(self.inner[-1] if self.inner else -1)
            self.prints.append(0)
            self.sources.append([])
            self.kinds.append(int(article and name in TEXT))
            self.inner.append(number)
        place = len(self.stack)
        self.places.setdefault(name, []).append(place)
        if name in BLOCKS:
            self.block_places.append(place)
        if name in _SCOPES:
            self.scope_places.append(place)
        self.stack.append([name, dropped, article, number])

    def _start(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self._flush()
            if name in _NO_P:
                self._end("p")
            if name in _ENDS:  # items of a list end the one before, up to the innermost list
                top = max((p[-1] for n in _LISTS if (p := self.places.get(n))), default=-1)
                ended = [p[k] for n in _ENDS[name] if (p := self.places.get(n)) and (k := bisect_right(p, top)) < len(p)]
                if ended:
                    self._close(min(ended))
        elif name == "br":
            self.parts.append(" ")
        opens = name not in VOID and not (attributes.endswith("/") and name not in BLOCKS and name not in RAW)
        if opens:
            self._open(name, attributes)
        self._note(f"<{name} {attributes}>")

    def _end(self, name: str) -> None:
        open_ = self.places.get(name)
        if not open_:
            return
        k = open_[-1]
        if name not in BLOCKS and self.block_places and self.block_places[-1] > k or name == "p" and self.scope_places and self.scope_places[-1] > k:
            return
        if name in BLOCKS:
            self._flush()
        self._close(k)

    def _read(self) -> None:
        html, at, token = self.html, 0, _TOKEN
        while True:
            i = html.find("<", at)
            text = html[at : len(html) if i < 0 else i]
            if text:
                self._note(text)
                if not (self.stack and self.stack[-1][1]):
                    self.parts.append(text)
            if i < 0:
                break
            m = token.match(html, i)
            if m is None:  # a plain <
                if not (self.stack and self.stack[-1][1]):
                    self.parts.append("<")
                at = i + 1
                continue
            at = m.end()
            if m[1]:
                name = m[1].lower()
                if name == "p" and not self.places.get("p"):
                    self._flush()
                self._end(name)
            elif m[2]:
                name = m[2].lower()
                self._start(name, m[3])
                if name in RAW and self.stack and self.stack[-1][0] == name:
                    found = re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
                    inside, at = html[at : found.start() if found else len(html)], found.end() if found else len(html)
                    self._note(inside)
                    if not self.stack[-1][1]:
                        self.parts.append(inside)
                    self._close(len(self.stack) - 1)
        self._flush()
        self._close(0)


def extract(html: str | None) -> tuple[list[tuple[str, int]], list[int], list[int]]:
    """(blocks of the main text, each with the number of the innermost subtree that holds it, or -1; the subtrees' hashes; their parents)."""
    page = _Page(html or "")
    main = [b for b in page.blocks if b[1]] or page.blocks
    return [(text, node) for text, _, node in main], page.prints, page.parents


def without_templates(blocks: list[tuple[str, int]], prints: list[int], parents: list[int], gone: set[int]) -> str:
    """The text of the blocks that no subtree of ``gone`` holds."""
    dead: list[bool] = []
    for h, parent in zip(prints, parents):  # a parent has a smaller number
        dead.append(h in gone or parent >= 0 and dead[parent])
    return "\n".join(t for t, node in blocks if node < 0 or not dead[node])


_BLOCK = pa.struct([("text", pa.string()), ("node", pa.int32())])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, len(b), 256):
            part = b.slice(at, 256)
            texts, blocks, prints, parents = [], [], [], []
            for h in part.column(6):
                found, own, above = extract(h.as_py())
                settled = all(node < 0 for _, node in found)
                texts.append("\n".join(t for t, _ in found) if settled else None)
                blocks.append(None if settled else [{"text": t, "node": n} for t, n in found])
                prints.append(own)
                parents.append(None if settled else above)
            arrays = [*part.columns[:6], pa.array(texts, pa.string()), pa.array(blocks, pa.list_(_BLOCK)), pa.array(prints, pa.list_(pa.int64())), pa.array(parents, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "host", "k1", "k2", "content", "text", "blocks", "prints", "parents"])


def _cleared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for blocks, prints, parents, gone in zip(*b.columns[2:]):
            held = [(x["text"], x["node"]) for x in blocks.as_py()]
            texts.append(without_templates(held, prints.as_py(), parents.as_py(), set(gone.as_py() or ())))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def site_templates(parsed: DataFrame, spec: TemplateSpec) -> DataFrame:
    """(host, print) of the subtrees that recur on many pages of their host; pages of the same content count once."""
    distinct = parsed.groupBy("host", "content").agg(F.first("prints").alias("prints")).withColumn("prints", F.array_distinct("prints"))
    seen = distinct.select("host", F.explode("prints").alias("print")).groupBy("host", "print").agg(F.count("*").alias("n"))
    inner = F.col("print").bitwiseAND(F.lit(1)) == 1
    seen = seen.where(F.col("n") >= F.when(inner, spec.text_pages).otherwise(spec.pages))
    pages = distinct.groupBy("host").agg(F.count("*").alias("pages"))
    return seen.join(pages, "host").where(F.col("n") >= F.col("pages") * F.when(inner, spec.text_share).otherwise(spec.share)).select("host", "print")


def main_text(pages: DataFrame, spec: TemplateSpec = TemplateSpec()) -> DataFrame:
    """The main text of every page, from its whole source.

    Returns one row per row of ``pages``: page_id, url, text (blocks in page order
    joined by newlines, white space in a block squeezed, character references decoded;
    empty if none) and n_chars (code points).  Null and empty sources have empty
    texts; pages with a null url share a host without name; null ids and repeated
    rows are kept; broken markup is read leniently; other columns are ignored.

    Sources are parsed where they are read and never move; blocks inside possible
    templates wait for the counts of their host.  Templates and what they delete are
    written first, so that the joins broadcast them where they are few and no text moves.
    """
    id_kind, url_kind = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    keys = F.xxhash64("page_id", "url", "html").alias("k1"), F.xxhash64(F.lit(1), "html", "url", "page_id").alias("k2")
    rows = pages.select("page_id", "url", split_url(F.col("url"))[0].alias("host"), *keys, F.xxhash64("html").alias("content"), "html")
    schema = f"page_id {id_kind}, url {url_kind}, host string, k1 long, k2 long, content long, text string, blocks array<struct<text: string, node: int>>, prints array<long>, parents array<int>"
    parsed = materialize(rows.mapInArrow(_parsed, schema), "page-blocks")
    templates = materialize(site_templates(parsed, spec), "site-templates")

    waiting = parsed.where(F.col("text").isNull())
    held = waiting.select("host", "k1", "k2", F.explode(F.array_distinct("prints")).alias("print"))
    gone = held.join(templates, ["host", "print"]).groupBy("k1", "k2").agg(F.collect_set("print").alias("gone"))
    gone = materialize(gone, "page-templates")
    waiting = waiting.join(gone, ["k1", "k2"], "left").select("page_id", "url", "blocks", "prints", "parents", "gone")
    waiting = waiting.mapInArrow(_cleared, f"page_id {id_kind}, url {url_kind}, text string")
    out = parsed.where(F.col("text").isNotNull()).select("page_id", "url", "text").unionByName(waiting)
    return out.withColumn("n_chars", F.length("text").cast("long"))
