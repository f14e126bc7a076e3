"""Operator 10: main text of web pages by site template removal.

Each page is parsed once into blocks of text. Where a page has an ``article`` or
``main`` element, blocks outside of it are left out, and so are subtrees that name
themselves as something else (by tag, role or class). The element subtrees that remain,
in articles too, are hashed and counted per host in Spark, and template parts deleted:

* by pages: subtrees outside articles, and containers (div, section and the like) in
  them, that are on at least half of a host's pages and on ``min_pages`` of them;
* by contexts: any subtree but a table cell, a term or an article's title (h1) that stands
  in as many contexts; outside articles, and for containers in them, ``most`` contexts
  are enough on a host of more pages. A paragraph, list or table of an article needs the
  half: on fewer pages of a large host it may be the author's own words, as a licence
  line, a refrain or a passage that several articles quote. A context is a min-hash of
  the text around the subtree: exact copies of an article have one, near copies few, so
  a copied article is no template. The best of ``SEEDS`` hashes counts, as other template
  parts can hold the least one; they must number a third of the different texts at least.

A page is never deleted whole.

Defined cases: null or empty html gives empty text; pages without an article or main
element use the whole body; null urls share the empty host; repeated rows and equal
page ids are separate pages; unclosed tags end where HTML lets them end; ``br`` is
white space; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.scratch import Scratch
from quillon.llm.session import bound_batches
from quillon.llm.textkernel import Words, mix, slices
from quillon.llm.urls import host_of

# Element names of HTML, and names that sites give to parts around an article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg math xmp noembed noframes".split())
DROP_TAGS = RAW | set("head nav footer aside form button select menu dialog object audio video canvas datalist".split())
DROP_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
DROP_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "popup modal overlay sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus replies respond "
    "related recommended share sharing social newsletter subscribe subscription signup login search widget pagination pager skip".split()
)
BLOCKS = set(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "html", "body", "legend", "option", "optgroup"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
CELLS = {"td", "th", "dt", "dd"}
CONTAINERS = {"div", "section", "figure", "details", "fieldset", "address", "center", "header", "hgroup"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPLIT = re.compile(r"[\s_\-:]+")
SEEDS = 3
WIDTH = 5


@lru_cache(maxsize=len(RAW))
def _raw_end(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


def _names_other(tag: str, attrs: str, inside: bool) -> bool:
    """Whether an element's tag, role or class says that it is not the article."""
    if tag in DROP_TAGS or (tag == "header" and not inside):
        return True
    if not attrs or tag in ("html", "body", "article", "main") and "=" not in attrs:
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        value, name = (a or b or c).lower(), name.lower()
        if name == "role" and value in DROP_ROLES:
            return True
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name in ("class", "id") and tag not in ("html", "body") and any(w in DROP_NAMES or (w == "header" and not inside) for w in _SPLIT.split(value)):
            return True
    return False


class _Element:
    """An open element: what it is, its first block, and a running hash of its subtree."""

    __slots__ = ("tag", "dropped", "inside", "first", "hash")

    def __init__(self, tag: str, attrs: str, dropped: bool, inside: bool, first: int):
        self.tag, self.dropped, self.inside, self.first = tag, dropped, inside, first
        self.hash = xxhash.xxh64(f"<{tag} {' '.join(attrs.split())}\0".encode("utf-8", "surrogatepass"))


def parse(page: str) -> tuple[list[str], list[tuple[int, int, int, bool, bool]]]:
    """Blocks of the main text, and the deletable subtrees as (hash, first block, past the last, by pages, by contexts).

    A subtree's hash is made of its own tag and texts and its children's hashes, each read
    once, so that deep pages take linear time; comments are left out of it.
    """
    blocks: list[tuple[str, bool]] = []
    subtrees: list[tuple[int, int, int, bool, str]] = []
    stack: list[_Element] = []
    open_tags: dict[str, int] = {}
    buffer: list[str] = []
    at, n = 0, len(page)

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                blocks.append((text, bool(stack) and stack[-1].inside))

    def pop() -> None:
        e = stack[-1]
        if e.tag in BLOCKS:
            flush()
        stack.pop()
        open_tags[e.tag] -= 1
        digest = e.hash.intdigest()
        if stack:
            stack[-1].hash.update(digest.to_bytes(8, "little"))
        if e.tag in BLOCKS and not e.dropped and len(blocks) > e.first and e.tag not in ("article", "main") and not (e.inside and e.tag in CELLS):
            subtrees.append((digest - (1 << 63), e.first, len(blocks), e.inside, e.tag))

    while at < n:
        m = _TOKEN.search(page, at)
        raw = page[at : m.start() if m else n]
        if raw and stack:
            stack[-1].hash.update(" ".join(raw.split()).encode("utf-8", "surrogatepass") + b"\0")
        if not stack or not stack[-1].dropped:
            buffer.append(raw)
        if not m:
            break
        at = m.end()
        slash, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            if open_tags.get(tag):
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            buffer.append(" ")
            if stack:
                stack[-1].hash.update(f"<{tag} {attrs}\0".encode("utf-8", "surrogatepass"))
            continue
        if tag in CLOSES_P and open_tags.get("p"):
            while open_tags["p"]:
                pop()
        if tag in SIBLINGS and any(open_tags.get(t) for t in SIBLINGS[tag]):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in SCOPES.get(tag, ()):
                    break
                if stack[i].tag in SIBLINGS[tag]:
                    while len(stack) > i:
                        pop()
                    break
        if tag in BLOCKS:
            flush()
        inside = bool(stack) and stack[-1].inside
        dropped = (bool(stack) and stack[-1].dropped) or _names_other(tag, attrs, inside)
        if tag in RAW:
            end = _raw_end(tag).search(page, at)
            if stack:
                stack[-1].hash.update(page[at : end.start() if end else n].encode("utf-8", "surrogatepass"))
            at = end.end() if end else n
            continue
        if tag in ("article", "main") and not dropped:
            inside = True
        if not attrs.rstrip().endswith("/") or tag in BLOCKS:
            stack.append(_Element(tag, attrs, dropped, inside, len(blocks)))
            open_tags[tag] = open_tags.get(tag, 0) + 1
    while stack:
        pop()
    flush()
    new = list(range(len(blocks) + 1))
    article = any(inside for _, inside in blocks)
    if article:
        new = [0]
        for _, inside in blocks:
            new.append(new[-1] + inside)
    kept = [t for t, inside in blocks if inside or not article]
    parts = [(h, new[a], new[b], not article or tag in CONTAINERS, tag not in CELLS and not (inside and tag == "h1")) for h, a, b, inside, tag in subtrees if inside or not article]
    return kept, [x for x in parts if x[1] > 0 or x[2] < len(kept)]


def _least(blocks: list[str]) -> np.ndarray:
    """Min-hashes (a row a seed) of each block's word windows; of all its words where it has fewer."""
    words = Words(pa.array(blocks, pa.string()))
    bounds = words.rows
    first = np.arange(len(words.hashes))
    past = np.minimum(first + WIDTH, np.repeat(bounds[1:], words.counts()))
    begin = np.repeat(bounds[:-1], words.counts())
    whole = (past - first == WIDTH) | (first == begin)
    hashes = words.runs().spans(first, past)
    out = np.full((SEEDS, len(blocks)), np.uint64(2**64 - 1))
    some = np.flatnonzero(words.counts())
    for seed in range(SEEDS if len(some) else 0):
        mixed = np.where(whole, mix(hashes ^ np.uint64(seed + 1)), np.uint64(2**64 - 1))
        out[seed, some] = np.minimum.reduceat(mixed, bounds[:-1][some])
    return out


_PART = pa.struct([("hash", pa.int64()), ("first", pa.int32()), ("past", pa.int32()), ("pages", pa.bool_()), ("contexts", pa.bool_()), ("once", pa.bool_()), ("around", pa.list_(pa.int32()))])


def _parts(parts: list[tuple[int, int, int, bool, bool]], least: np.ndarray) -> list[dict]:
    """Subtrees of a page with their contexts; ``once`` is true of the first of equal ones."""
    edge = np.full((SEEDS, 1), np.uint64(2**64 - 1))
    before = np.hstack([edge, np.minimum.accumulate(least, axis=1)])
    after = np.hstack([np.minimum.accumulate(least[:, ::-1], axis=1)[:, ::-1], edge])
    around = np.minimum(before[:, [x[1] for x in parts]], after[:, [x[2] for x in parts]])
    around = mix(around).astype(np.uint32).view(np.int32).T.tolist()
    out, seen = [], set()
    for (h, a, b, pages, contexts), c in zip(parts, around):
        out.append({"hash": h, "first": a, "past": b, "pages": pages, "contexts": contexts, "once": h not in seen, "around": c})
        seen.add(h)
    return out


def _parse_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "html", 4 << 20):
        found = [parse(x) if x else ([], []) for x in part.column("html").to_pylist()]
        least = _least([t for b, _ in found for t in b])
        ends = np.cumsum([len(b) for b, _ in found])
        parts = [_parts(p, least[:, e - len(b) : e]) if p else [] for (b, p), e in zip(found, ends)]
        texts = [xxhash.xxh64_intdigest("\n".join(b)) - (1 << 63) for b, _ in found]
        yield pa.RecordBatch.from_arrays(
            [part.column("page_id"), part.column("url"), part.column("host"), pa.array([b for b, _ in found], pa.list_(pa.string())), pa.array(texts, pa.int64()), pa.array(parts, pa.list_(_PART))],
            ["page_id", "url", "host", "blocks", "whole", "parts"],
        )


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 3, share: float = 0.5, most: int = 20, templates: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``; without ``templates`` no subtree is counted or deleted."""
    bound_batches(pages)
    scratch = Scratch(pages.sparkSession, "htmltext")
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), host_of(pages[url_col]).alias("host"), F.coalesce(pages[html_col], F.lit("")).alias("html"))
    part = "hash:bigint,first:int,past:int,pages:boolean,contexts:boolean,once:boolean,around:array<int>"
    schema = f"page_id long, url string, host string, blocks array<string>, whole long, parts array<struct<{part}>>"
    parsed = scratch.write("parsed", rows.mapInArrow(_parse_batches, schema).withColumn("row", F.monotonically_increasing_id()))
    if not templates:
        return parsed.select("page_id", "url", F.array_join("blocks", "\n").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
    parts = parsed.select("row", "host", "whole", F.explode("parts").alias("p")).select("row", "host", "whole", "p.*")
    hosts = parsed.groupBy("host").agg(F.count("*").alias("n"))
    hosts = hosts.select("host", F.greatest(F.lit(min_pages), F.col("n") * share).alias("half"), F.greatest(F.lit(min_pages), F.least(F.lit(most), F.col("n") * share)).alias("few"))
    seen = parts.where("once").groupBy("host", "hash").agg(F.count_if("pages").alias("n_pages"), F.count("*").alias("n")).where(F.col("n") >= min_pages)
    often = seen.join(hosts, "host").where(F.col("n") >= F.col("few")).select("host", "hash", "few", "half", (F.col("n_pages") >= F.col("half")).alias("common"))
    found = scratch.write("often", parts.join(often.hint("shuffle_hash"), ["host", "hash"]))
    contexts = [F.count_distinct(F.when(F.col("contexts"), F.col("around")[i])) for i in range(SEEDS)]
    counts = found.groupBy("host", "hash", "few", "half").agg(F.greatest(*contexts).alias("n"), F.count_distinct("whole").alias("texts"))
    spread = counts.where((F.col("n") >= F.col("few")) & (F.col("n") * 3 >= F.col("texts"))).select("host", "hash", F.lit(True).alias("spread"), (F.col("n") >= F.col("half")).alias("mostly"))
    chosen = found.join(spread.hint("shuffle_hash"), ["host", "hash"], "left").where((F.col("common") & F.col("pages")) | (F.col("spread") & F.col("contexts") & (F.col("pages") | F.col("mostly"))))
    ranges = scratch.write("ranges", chosen.groupBy("row").agg(F.collect_set(F.struct("first", "past")).alias("ranges")))
    del parts, hosts, seen, often, found, counts, spread, chosen
    scratch.drop("often")
    scratch.free_shuffles()  # before the texts are shuffled
    joined = parsed.select("row", "page_id", "url", "blocks").join(ranges, "row", "left")
    left = F.expr("filter(blocks, (t, i) -> not exists(ranges, r -> i >= r.first and i < r.past))")
    kept = F.when(F.col("ranges").isNull(), F.col("blocks")).otherwise(F.when(F.size(left) > 0, left).otherwise(F.col("blocks")))
    return joined.select("page_id", "url", F.array_join(kept, "\n").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op10_htmltext(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
