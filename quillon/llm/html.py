"""Main-text extraction with removal of site templates.

Pass 1 parses each page, hashes its block element subtrees (tag, class, id, text, and the hashes of
children, so it is linear in the page) and counts, per host, the distinct pages that hold a subtree.
A subtree on MIN_PAGES pages or more of a host is a template of that host. Pass 2 parses again and
deletes templates first, whatever their names. Then goes what counts cannot tell, as it differs from page
to page or its host has few pages, and markup names as no article: menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments. If elements `article` or `main` are
left, only they count.

Copies of a page count once, as a page in full. Text itself is guarded: inside an article, a subtree that
holds running text (paragraphs, headings, lists' items) is never a template, and elsewhere a subtree
with more than TEXT_SHARE of the page's text is not either, so that an article that a site prints on
many pages stays. Both only ever keep text.

Counts are partial sums per task and hash, so a host with a third of all pages is no hot group.
Templates are sent to the executors while their counted number stays under BROADCAST_TEMPLATES;
beyond that they are joined to the pages' own subtrees, page by page.

Defined cases: null, empty or text-free html gives the empty string; a null url (or one without a
host) has no site, so nothing is a template there; unclosed and stray tags are repaired as browsers
do; repeated rows keep one row each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, read_table, small_batches, stored

MIN_PAGES = 5
#: A template is at most this share of its page's text. On sf0.1 templates are 0.1 % to 21 % of it.
TEXT_SHARE = 0.25
#: 8 bytes each.
BROADCAST_TEMPLATES = 500_000

# Names of HTML elements and of customary classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th tr tbody dd dt figcaption".split())
NOT_TEXT = frozenset("nav footer aside form script style noscript template iframe svg math button select option textarea dialog menu canvas object audio video head title map datalist".split())
SITE_HEADER = frozenset("header masthead topbar".split())
NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement adsense adslot advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert "
    "comment comments commentlist disqus respond replies newsletter subscribe subscription signup popup modal overlay sidebar sidenav nav navbar navigation menu submenu "
    "breadcrumb breadcrumbs footer share sharing social related recommended recommendations widget banner toolbar pagination pager skip".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_token = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)", re.DOTALL)
_attribute = re.compile(r"\b(class|id|role|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_name = re.compile(r"[a-z]+|\d+")
_raw_end = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW}


@dataclass(slots=True)
class Element:
    tag: str
    name: str  # tag, class and id, as hashed
    excluded: bool  # by its markup, or inside such an element
    article: int  # 0: outside; 1: inside an article; 2: inside main alone
    parts: list[bytes] = field(default_factory=list)
    first_block: int = 0
    running: bool = False  # is or holds running text of an article


@dataclass(slots=True)
class Subtree:
    digest: int
    first: int  # blocks that it holds
    last: int
    running: bool  # is or holds running text of an article


@dataclass(slots=True)
class Block:
    text: str
    excluded: bool
    article: int


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _attribute.finditer(raw)} if raw else {}


def names_no_article(tag: str, given: dict[str, str], inside: int) -> bool:
    if tag in NOT_TEXT or (tag == "header" and not inside):
        return True
    if not given:
        return False
    if given.get("role") in ROLES or "hidden" in given or "display:none" in given.get("style", "").replace(" ", ""):
        return True
    if tag in ("body", "html", "article", "main") and not (set(_name.findall(given.get("class", ""))) & {"comment", "comments"}):
        return False
    names = {x for part in (given.get("class", ""), given.get("id", "")) for x in _name.findall(part)}
    return bool(names & NOT_ARTICLE) or (not inside and bool(names & SITE_HEADER))


class Page:
    """The blocks of text of a page and its element subtrees."""

    def __init__(self, markup: str, host: str):
        self.blocks: list[Block] = []
        self.subtrees: list[Subtree] = []
        self._host = host
        self._open: list[Element] = [Element("", "", False, 0)]
        self._text: list[str] = []
        self._parse(markup)

    def _parse(self, markup: str) -> None:
        at, end = 0, len(markup)
        while at < end:
            m = _token.search(markup, at)
            if m is None:
                self._characters(markup[at:])
                break
            if m.start() > at:
                self._characters(markup[at : m.start()])
            at = m.end()
            if not (tag := m[2]):
                if m[0].startswith("<![CDATA["):
                    self._characters(m[0][9:-3])
                continue
            tag = tag.lower()
            if m[1]:
                self._close(tag)
                continue
            self._start(tag, m[3])
            if tag in RAW and not m[3].endswith("/"):
                close = _raw_end[tag].search(markup, at)
                at = close.start() if close else end
        self._flush()
        while len(self._open) > 1:
            self._pop()

    def _characters(self, raw: str) -> None:
        self._text.append(entities.unescape(raw) if "&" in raw else raw)

    def _flush(self) -> None:
        """End the block of text that is open."""
        text = " ".join("".join(self._text).split())
        self._text.clear()
        if text:
            top = self._open[-1]
            self.blocks.append(Block(text, top.excluded, top.article))
            top.parts.append(xxhash.xxh64_digest(text.encode("utf-8", "replace")))

    def _start(self, tag: str, raw: str) -> None:
        if tag in INLINE:
            if tag in ("br", "wbr", "img"):
                self._text.append(" " if tag == "br" else "")
            else:
                self._inline(tag, raw)
            return
        self._flush()
        if tag in VOID:
            return
        if tag in CLOSES_P and any(e.tag == "p" for e in self._open[-4:]):
            self._close("p")
        if tag in SIBLINGS:
            same, scope = SIBLINGS[tag]
            for k in range(len(self._open) - 1, 0, -1):
                if self._open[k].tag in scope:
                    break
                if self._open[k].tag in same:
                    while len(self._open) > k:
                        self._pop()
                    break
        above, given = self._open[-1], attributes(raw)
        article = above.article
        if tag == "article":
            article = 1
        elif (tag == "main" or given.get("role") == "main") and not article:
            article = 2
        name = f"{tag}.{given.get('class', '')}#{given.get('id', '')}"
        self._open.append(Element(tag, name, above.excluded or names_no_article(tag, given, above.article), article, first_block=len(self.blocks)))

    def _inline(self, tag: str, raw: str) -> None:
        """An inline element matters only where its markup names it as no article."""
        if raw and names_no_article(tag, given := attributes(raw), self._open[-1].article):
            self._flush()
            above = self._open[-1]
            self._open.append(Element(tag, f"{tag}.{given.get('class', '')}", True, above.article, first_block=len(self.blocks)))

    def _close(self, tag: str) -> None:
        if tag in VOID:
            return
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k].tag == tag:
                self._flush()
                while len(self._open) > k:
                    self._pop()
                return
        if tag not in INLINE:
            self._flush()

    def _pop(self) -> None:
        self._flush()
        e = self._open.pop()
        running = e.running or (bool(e.article) and e.tag in RUNNING)
        self._open[-1].running |= running
        digest = xxhash.xxh64_digest(e.name.encode("utf-8", "replace") + b"\0" + b"".join(e.parts))
        self._open[-1].parts.append(digest)
        if len(self.blocks) > e.first_block and self._host and e.tag not in ("html", "body", "article", "main"):
            key = xxhash.xxh64_intdigest(digest + self._host.encode("utf-8", "replace"))
            self.subtrees.append(Subtree(key - (1 << 64) if key >> 63 else key, e.first_block, len(self.blocks), running))

    def keys(self) -> list[int]:
        """Digests of the subtrees that may be templates, for this host."""
        return list({s.digest for s in self.subtrees if not s.running})

    def main_text(self, is_template, names: bool = True, scope: bool = True) -> tuple[str, int]:
        """The main text, and the characters that the counts of subtrees took away. Without names or scope
        only the counts decide."""
        kept = [True] * len(self.blocks)
        sizes = np.cumsum([0] + [len(b.text) for b in self.blocks])
        for s in self.subtrees:
            if not s.running and sizes[s.last] - sizes[s.first] <= TEXT_SHARE * sizes[-1] and any(kept[s.first : s.last]) and is_template(s.digest):
                kept[s.first : s.last] = [False] * (s.last - s.first)
        gone = sum(len(b.text) for b, k in zip(self.blocks, kept, strict=True) if not k)
        if names:
            kept = [k and not b.excluded for b, k in zip(self.blocks, kept, strict=True)]
        if scope:
            places = {b.article for b in self.blocks if not b.excluded}
            level = 1 if 1 in places else 2 if 2 in places else 0
            kept = [k and (not level or b.article == level) for b, k in zip(self.blocks, kept, strict=True)]
        return "\n".join([b.text for b, k in zip(self.blocks, kept, strict=True) if k]), gone


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _subtree_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(batches, 512):
        keys, pages = [], []
        for url, markup in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if host := host_of(url):
                found = Page(markup or "", host).keys()
                keys += found
                pages += [xxhash.xxh64_intdigest((markup or "").encode("utf-8", "replace")) >> 1] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(pages, pa.int64())], names=["key", "page"])


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """Digests (with their host) of the element subtrees on min_pages distinct pages or more of a host."""
    keys = pages.select("url", "html").mapInArrow(_subtree_keys, "key long, page long")
    per_page = keys.groupBy("key", "page").agg(F.lit(1).alias("one"))
    return per_page.groupBy("key").agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") >= min_pages)


def _extract(templates, flagged: bool, names: bool, scope: bool):
    """templates: a broadcast sorted array of digests; flagged: each row brings its own in `flags`."""

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if flagged else set(templates.value.tolist())
        for batch in batches_of(batches, 512):
            found = []
            flags = batch.column("flags").to_pylist() if flagged else [None] * batch.num_rows
            for url, markup, own in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), flags, strict=True):
                among = set(own or ()) if flagged else known
                found.append(Page(markup or "", host_of(url)).main_text(among.__contains__, names, scope))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_template_chars"],
            )

    return extract


def extract_main_text(pages: DataFrame, min_pages: int = MIN_PAGES, broadcast_templates: int = BROADCAST_TEMPLATES, names: bool = True, scope: bool = True) -> DataFrame:
    """page_id, url, html -> page_id, url, text, n_chars, n_template_chars (what the counts alone took away).

    names and scope switch off what markup's names and the article's element decide after the counts."""
    spark = pages.sparkSession
    small_batches(spark)
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    templates = stored(site_templates(pages, min_pages).select("key"), "templates")
    schema = "page_id long, url string, text string, n_chars long, n_template_chars long"
    if templates.count() <= broadcast_templates:
        digests = np.sort(templates.toPandas()["key"].to_numpy(np.int64))
        return pages.mapInArrow(_extract(spark.sparkContext.broadcast(digests), False, names, scope), schema)

    def own_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 512):
            keys, rows = [], []
            for row, url, markup in zip(batch.column("row").to_pylist(), batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                found = Page(markup or "", host_of(url)).keys()
                keys += found
                rows += [row] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array(keys, pa.int64())], names=["own_row", "key"])

    rows = pages.withColumn("row", F.sha2(F.concat_ws("\n", "url", "html"), 256))
    own = rows.select("row", "url", "html").mapInArrow(own_keys, "own_row string, key long")
    flags = own.join(templates, "key").groupBy("own_row").agg(F.collect_set("key").alias("flags"))
    return rows.join(flags, F.col("row") == F.col("own_row"), "left").select("page_id", "url", "html", "flags").mapInArrow(_extract(None, True, names, scope), schema)


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(read_table(spark, sf_dir, "pages"))
