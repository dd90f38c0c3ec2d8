"""Main text of web pages by template deduction from equivalence classes.

Pages of one host are compared. Tokens are elements (containers, told apart by the path of containers that they
are in; opening and closing are one token) and texts at a path. A token's occurrence vector says how often it is on each
page of the host, and tokens with the same vector form an equivalence class. A class is valid if it is large and frequent
enough, its elements follow the same sibling on every page (ordered), and all of them lie in one place of the
class around them (nested). Valid classes, nested in each other, are the host's template. Texts that are the same on nearly all
pages belong to it; the places between its elements are its slots, each with its mean text over the pages, without links
and without what belongs to the template.

A page is then judged by its host's template: the main text is in the container that holds nearly all text of the slots, found by
walking down from the root. A slot counts with its mean over the host's pages, whatever this page has in it; slots of links and of the
template's own texts count nothing and are left out; places of no valid class, such as those named by a page's number, count with
what they hold. So the same container is taken on all pages of a layout, long or short. Names have a say only inside it,
for things that vary from page to page just as articles do: elements whose tag or name says menu, header, footer, side bar,
notice, advert, form or comment are left out, and where no container holds nearly all text, elements
named as articles are taken.

Vectors are never gathered: each is a sum of hashes of (page, count), summed up before the
shuffle, so a host with a third of all pages is no heavier than others. Paths are 64-bit hashes of their elements.

Defined cases: null or empty html has an empty text; pages without a host are one host (''); pages of hosts
without a valid class (those with one page) are judged alone, each place by what it holds;
names of html, body, article and main elements say nothing; repeated rows are judged each by itself; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorlens.llm.common import saved
from vendorlens.llm.url_filter import host_of

#: A class is valid if it has this many tokens and is on this many pages, or this share of the host's.
LEAST_TOKENS, LEAST_PAGES, LEAST_SHARE = 2, 2, 0.01
#: A text belongs to the template if it is on so many pages and on this share of those that have its path.
FIXED_PAGES, FIXED_SHARE = 4, 0.8
#: What lies outside the main container has less than this share of a page's text.
SLOT_SHARE = 0.2

CONTAINERS = frozenset("html body div main article section nav header footer aside form table ul ol dl figure details dialog template noscript iframe svg select menu fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Containers that can be a page's main one.
WRAPPERS = frozenset(("html", "body", "div", "main", "article"))
#: Their content is never text.
RAW = frozenset(("script", "style", "title", "textarea", "noscript", "iframe", "svg", "template", "select", "object", "canvas"))
_DROPPED_TAGS = frozenset("nav footer aside form menu noscript iframe svg select dialog template fieldset".split())
#: An element with such a word in a class, id or role is no main text.
_DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement banner banners sponsor sponsored promo promotion promotions nav navbar navigation menu menus topbar toolbar "
    "header masthead footer sidebar side aside widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay "
    "comment comments disqus replies respond share sharing social related recommended recommendations newsletter subscribe subscription signup login "
    "search form breadcrumb breadcrumbs pagination pager tags copyright legal".split()
)
_ARTICLE_NAME = re.compile(r"(?:article|post|entry|content|story)(?:[-_]?(?:body|content|text))?")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*|[^<>]*)>|<[!?][^>]*>", re.S)
_NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Place:
    """A path of containers on a page."""

    key: int  # a hash of the path
    parent: int  # place of the path without its last element
    tag: str
    left_out: bool  # an element of the path is named as no main text
    left_out_inside: bool  # one from the article on
    article: bool  # the path is in an element named as an article
    before: int = 0  # the sibling that it first follows on the page
    count: int = 0
    last: int = 0  # the child that was opened last


@dataclass
class Page:
    places: list[Place]
    blocks: list[tuple[int, str, bool]] = field(default_factory=list)  # (place, text, in a link)


@lru_cache(1 << 14)
def named(tag: str, names: str) -> tuple[bool, bool]:
    """(is no main text, is an article) by an element's tag and names."""
    plain = tag in ("html", "body", "article", "main")
    words = re.split(r"[\s._-]+", names)
    article = tag in ("article", "main") or tag == "div" and any(_ARTICLE_NAME.fullmatch(n) for n in names.split())
    return tag in _DROPPED_TAGS or not plain and not _DROPPED_NAMES.isdisjoint(words), article


def parsed(html: str) -> Page:
    """The containers of a page and its texts, in order.

    A text is cut at tags that are not inline; character references are decoded, white space is one blank and none at the ends.
    """
    page = Page([Place(0, -1, "", False, False, False)])
    places, known = page.places, {0: 0}
    stack, open_ = [0], Counter()
    held: list[str] = []
    link = False
    at, end = 0, len(html)

    def flush() -> None:
        if held:
            if text := _SPACE.sub(" ", "".join(held)).strip():
                page.blocks.append((stack[-1], text, link))
            held.clear()

    while at < end:
        m = _TOKEN.search(html, at)
        if m is None:
            held.append(unescape(html[at:]))
            break
        if m.start() > at:
            held.append(unescape(html[at : m.start()]))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing = m[1] == "/"
        if tag in RAW and not closing:
            if not m[3].rstrip().endswith("/"):
                stop = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                # an unclosed script or style takes the rest, as it does in a browser
                at = stop.end() if stop else end if tag in ("script", "style") else at
            flush()
        elif tag in CONTAINERS:
            flush()
            if not closing:
                names = " ".join(x for g in _NAME.findall(m[3]) for x in g if x).lower()
                up = stack[-1]
                above = places[up]
                key = xxhash.xxh64_intdigest(f"{tag} {names}", seed=above.key & 0xFFFFFFFFFFFF) >> 1
                if key not in known:
                    out, article = named(tag, names)
                    out = out or tag == "header" and not above.article
                    inside = article or above.article
                    known[key] = len(places)
                    places.append(Place(key, up, tag, above.left_out or out, inside and (above.left_out_inside or out), inside, above.last if above.last != key else 0))
                above.last = key
                places[known[key]].count += 1
                stack.append(known[key])
                open_[tag] += 1
            elif open_[tag]:
                while True:
                    gone = places[stack.pop()].tag
                    open_[gone] -= 1
                    if gone == tag:
                        break
        elif tag not in INLINE:
            flush()
        elif tag == "a":
            link = not closing
    flush()
    return page


_STATS = pa.schema([("host", pa.string()), *((n, pa.int64()) for n in ("key", "parent", "text", "pages", "vector", "before_lo", "before_hi", "chars", "link_chars"))])


def _page_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a batch by (host, path, text): for elements (text 0) and texts. Rows: id hash, host, html."""
    for batch in batches:
        sums: dict[tuple, list[int]] = {}

        def add(token: tuple, seen: str, before: int, chars: int, links: int) -> None:
            own = sums.setdefault(token, [0, 0, before, before, 0, 0])  # noqa: B023
            own[0] += 1
            own[1] = (own[1] + xxhash.xxh64_intdigest(seen)) & 0x7FFFFFFFFFFF
            own[2], own[3] = min(own[2], before), max(own[3], before)
            own[4] += chars
            own[5] += links

        for page, host, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = parsed(html or "")
            chars, texts = [[0, 0] for _ in own.places], Counter()
            for at, text, link in own.blocks:
                chars[at][0] += len(text)
                chars[at][1] += len(text) if link else 0
                texts[at, xxhash.xxh64_intdigest(text) >> 1 | 1, len(text)] += 1
            for i, x in enumerate(own.places[1:], 1):
                add((host, x.key, own.places[x.parent].key, 0), f"{page}:{x.count}", x.before, *chars[i])
            for (at, text, n), count in texts.items():
                add((host, own.places[at].key, own.places[own.places[at].parent].key, text), f"{page}:{count}", 0, n * count, 0)
        names = list(sums)
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in names], _STATS.field(i).type) for i in range(4)), *(pa.array([v[i] for v in sums.values()], pa.int64()) for i in range(6))], schema=_STATS)


def token_totals(stats: DataFrame) -> DataFrame:
    """The sums of _page_stats over all tasks. Vectors are summed as decimals: as longs, those of a very large host would overflow."""
    vector = F.sum(F.col("vector").cast("decimal(38,0)")) % F.lit(0x7FFFFFFFFFFF)
    return stats.groupBy("host", "key", "parent", "text").agg(
        F.sum("pages").alias("pages"), vector.cast("long").alias("vector"), F.min("before_lo").alias("before_lo"), F.max("before_hi").alias("before_hi"), F.sum("chars").alias("chars"), F.sum("link_chars").alias("link_chars")
    )


def templates(pages: DataFrame) -> DataFrame:
    """(host, slots): the slots of each host's template as a map from a path to its mean text (0 if it holds the
    template's own texts, -1 if it holds links).

    ``pages``: id hash, host, html.
    """
    stats = pages.mapInArrow(_page_stats, "host string, key long, parent long, text long, pages long, vector long, before_lo long, before_hi long, chars long, link_chars long")
    total = token_totals(stats)
    total = saved(total.where("text = 0 or pages > 1"), "html-tokens")
    elements, texts = total.where("text = 0"), total.where("text <> 0")
    size = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    # a token's class is its vector; the element around it is in the same class or tells where the class is nested
    around = elements.select("host", F.col("key").alias("parent"), F.col("vector").alias("outer"), F.col("pages").alias("outer_pages"))
    tokens = total.join(around, ["host", "parent"], "left")
    inner = (F.col("outer") == F.col("vector")) & (F.col("outer_pages") == F.col("pages")) & (F.col("text") == 0)
    place = F.when(F.col("text") != 0, None).when(~F.coalesce(inner, F.lit(False)), F.col("parent"))
    classes = tokens.groupBy("host", "pages", "vector").agg(
        F.count("*").alias("tokens"), F.min(place).alias("place_lo"), F.max(place).alias("place_hi"), F.min(F.col("before_lo") == F.col("before_hi")).alias("ordered")
    ).join(size, "host")
    valid = classes.where((F.col("tokens") >= LEAST_TOKENS) & (F.col("pages") >= LEAST_PAGES) & (F.col("pages") >= F.col("host_pages") * LEAST_SHARE) & F.col("ordered") & (F.col("place_lo") == F.col("place_hi")))
    slots = elements.join(valid.select("host", "pages", "vector"), ["host", "pages", "vector"], "left_semi").where("chars > 0").select("host", "key", "pages", "chars", "link_chars")
    fixed = texts.select("host", "key", F.col("pages").alias("own"), F.col("chars").alias("own_chars")).join(slots.select("host", "key", "pages"), ["host", "key"])
    fixed = fixed.where((F.col("own") >= FIXED_PAGES) & (F.col("own") >= FIXED_SHARE * F.col("pages"))).groupBy("host", "key").agg(F.sum("own_chars").alias("fixed"))
    slots = slots.join(fixed, ["host", "key"], "left").withColumn("free", F.greatest(F.lit(0), F.col("chars") - F.col("link_chars") - F.coalesce("fixed", F.lit(0))) / F.col("pages"))
    slots = slots.withColumn("own_text", F.coalesce("fixed", F.lit(0)) >= 0.9 * F.col("chars"))
    whole = slots.groupBy("host").agg(F.sum("free").alias("host_free"))
    # copies of one article are no template: its own texts are fewer than what varies
    own_text = F.col("own_text") & (F.col("host_free") - F.col("free") >= F.col("chars") / F.col("pages"))
    kept = slots.join(whole, "host").select("host", "key", F.when(own_text, 0.0).when(2 * F.col("link_chars") > F.col("chars"), -1.0).otherwise((F.col("chars") - F.col("link_chars")) / F.col("pages")).alias("mean"))
    return kept.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("key", "mean"))).alias("slots"))


def main_places(page: Page, slots: Mapping[int, float] | None) -> set[int]:
    """The places of a page whose texts are main text, by the template of its host; None: the host has none.

    A template without slots tells nothing: then all that no name leaves out is main text."""
    alone, slots = slots is None, slots or {}
    places = page.places
    chars: dict[int, int] = {}
    for at, text, link in page.blocks:
        chars[at] = chars.get(at, 0) + (0 if link else len(text))
    mean = {p: slots.get(places[p].key) for p in chars}
    good = {p for p in chars if not places[p].left_out and mean[p] != 0}
    if not any(chars[p] for p in good):
        # a wrapper's name is no reason to lose the only article
        if wrapped := {p for p in chars if places[p].article and not places[p].left_out_inside}:
            return wrapped
        good = {p for p in chars if not places[p].left_out}
    held = [0.0] * len(places)
    for p in good:  # what a slot of the template usually holds; another place, what it holds here
        held[p] = chars[p] if mean[p] is None else max(0, mean[p])
    # slots count on pages that leave them empty, too: an element of the template has them or not
    for p, place in enumerate(places):
        if p not in chars and not place.left_out and slots.get(place.key, 0) > 0:
            held[p] = slots[place.key]
    direct = list(held)
    below: dict[int, list[int]] = {}
    for p in range(len(places) - 1, 0, -1):
        held[places[p].parent] += held[p]
        if held[p]:
            below.setdefault(places[p].parent, []).append(p)
    region = 0
    while (alone or slots) and region in below and not (places[region].tag in ("div", "article") and (direct[region] or places[region].tag == "article")):
        best = max(below[region], key=lambda p: (held[p], -p))
        if places[best].tag not in WRAPPERS or held[best] < (1 - SLOT_SHARE) * held[0]:
            break
        region = best
    inside = [False] * len(places)
    for p in range(len(places)):
        inside[p] = p == region or p > 0 and inside[places[p].parent]
    if (alone or slots) and places[region].tag not in ("div", "article", "main"):  # no container holds nearly all: names may tell
        if articles := {p for p in good if places[p].article}:
            return articles
        good = {p for p in good if chars[p] and mean[p] != -1} or good  # menus without a name lie beside the text
    return {p for p in good if inside[p]}


def main_text(html: str | None, slots: Mapping[int, float] | None) -> str:
    """Main texts of a page in page order, given its host's slots (see ``templates``); None: a host without a template."""
    if not html:
        return ""
    page = parsed(html)
    main = main_places(page, slots)
    return " ".join(t for p, t, _ in page.blocks if p in main)


def extracted(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of each page row."""
    kind = pages.schema[id_col].dataType.simpleString()
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    deduced = templates(source.select(F.xxhash64("id", "url").alias("page"), "host", "html"))
    joined = source.join(saved(deduced, "html-templates"), "host", "left").select("id", "url", "html", "slots")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, None if s is None else dict(s)) for h, s in zip(*(batch.column(i).to_pylist() for i in (2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    return joined.mapInArrow(scan, f"id {kind}, url string, text string")
