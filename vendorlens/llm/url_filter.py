"""URL rules with redirect equivalence.

A rule names a host (with all its subdomains) and the start of a path, and allows or blocks; the longest
rule that fits a URL decides. URLs without a rule take the decision of their aliases: redirect and
canonical-link edges join URLs into components (distributed connected components), and a block
on any member goes to the whole component unless a member is explicitly allowed.

Defined cases: null URLs and those without ``://`` have an empty host and path, fit no rule, have no
aliases and are allowed; repeated URLs have one node; null html has no links, nor have comments, scripts, styles and text areas; relative targets
are taken from the page's own URL (a base element is not read), dot segments removed; character references that end in a semicolon
are decoded; targets of other schemes (mailto:) are none; without rules everything is allowed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendorlens.llm.common import saved
from vendorlens.llm.components import connected_components


def lowered(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def node_of(url: Column) -> Column:
    """A URL as a node: host, path and query; scheme and fragment don't tell URLs apart."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.concat(host_of(url), F.when(path_of(url) == "", "/").otherwise(path_of(url)), query))


#: href of <link rel=canonical> (any word of rel) and target of <meta http-equiv=refresh>, whatever the order of attributes.
_LINKS = r"""(?is)<link\b[^>]*>"""
_CANONICAL = r"""(?is)\srel\s*=\s*(?:"(?:[^">]*\s)?canonical(?:\s[^">]*)?"|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?'|canonical(?=[\s/>]))"""
_REFRESH = r"""(?is)<meta\b(?:[^>]*[\s"'/])?http-equiv\s*=\s*["']?refresh\b[^>]*>"""
#: Names of attributes follow a blank, a quote or a slash: data-href is another attribute.
_HREF = r"""(?is)[\s"'/]href\s*=\s*["']?([^"'\s>]+)"""
_TARGET = r"""(?is)[\s"';,]url\s*=\s*["']?((?:[^"'\s>;&]++|&#?\w++;|&)++)"""
#: What looks like a tag in them is none.
_HIDDEN = r"""(?is)<!--.*?(?:-->|\z)|<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)|<textarea\b[^>]*>.*?(?:</textarea\s*>|\z)"""
_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def decoded(links: DataFrame) -> DataFrame:
    """(u, t) with the character references of the targets t decoded, in the few links found."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            targets = [_REFERENCE.sub(lambda m: unescape(m[0]), t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(targets, pa.string())], names=["u", "t"])

    return links.select("u", "t").mapInArrow(decode, "u string, t string")


def without_dots(path: Column) -> Column:
    """A path that starts with / without its . and .. segments."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    shorter = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))
    step = lambda a, x: F.when(x == "..", shorter(a)).when(x == ".", a).otherwise(F.concat(a, F.array(x)))
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit("")), step)
    return F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")


def resolved(url: Column, target: Column) -> Column:
    """The URL that a page's link leads to; null for other schemes and for places in the page itself."""
    base = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    own = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    path = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    rest = F.substring(target, F.length(path) + 1, F.length(target))
    folder = F.regexp_replace(own, r"[^/]*\z", "")
    return (
        F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) == 0, F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target))
        .when(target.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?):", 1), F.lit(":"), target))
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("#") | target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(target.startswith("?"), F.concat(base, own, target))
        .when(target.startswith("/"), F.concat(base, without_dots(path), rest))
        .otherwise(F.concat(base, without_dots(F.concat(folder, path)), rest))
    )


def alias_edges(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): nodes joined by a canonical link or a redirect in a page."""
    tags = lambda pattern: F.regexp_extract_all("_shown", F.lit(pattern), F.lit(0))
    links = F.transform(F.filter(tags(_LINKS), lambda t: t.rlike(_CANONICAL)), lambda t: F.regexp_extract(t, _HREF, 1))
    refreshes = F.transform(tags(_REFRESH), lambda t: F.regexp_extract(t, _TARGET, 1))
    maybe = F.col(html_col).rlike(r"(?i)canonical|http-equiv")
    shown = pages.where(maybe).select(F.col(url_col).alias("u"), F.regexp_replace(html_col, _HIDDEN, " ").alias("_shown"))
    found = shown.select("u", F.explode(F.concat(links, refreshes)).alias("t")).where("t <> ''")
    whole = decoded(found).select("u", resolved(F.col("u"), F.col("t")).alias("t"))
    return whole.select(node_of(F.col("u")).alias("a"), node_of(F.col("t")).alias("b")).where("a is not null and b is not null and a <> b")


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(node, rule, verdict) of the URLs (node, host, path) that a rule fits: the longest one."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = urls.where("host <> ''").select("host").distinct().select("host", F.explode(suffixes).alias("rule_host"))
    near = hosts.join(rules, "rule_host").select("host", "rule_path", "rule", "verdict")
    fits = urls.join(near, "host").where(F.col("path").startswith(F.col("rule_path")))
    return fits.groupBy("node").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.col("rule"))).alias("x")).select("node", "x.rule", "x.verdict")


def rules_table(rules: DataFrame) -> DataFrame:
    """(rule_host, rule_path, rule, verdict) of rules like ``example.com/en/7`` (rule, verdict)."""
    host = lowered(F.regexp_extract("rule", r"^([^/]*)", 1))
    return rules.where("rule is not null").select(host.alias("rule_host"), F.regexp_extract("rule", r"^[^/]*(.*)$", 1).alias("rule_path"), "rule", "verdict").dropDuplicates(["rule"])


def judged(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict) of each page row: the rule's verdict, else that of its aliases, else allow."""
    return _judged(pages, rules, id_col, url_col, html_col).drop("url")


def _judged(pages: DataFrame, rules: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    url = F.col(url_col)
    seen = pages.select(F.col(id_col).alias("id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    edges = saved(alias_edges(pages, url_col=url_col, html_col=html_col), "url-edges")
    components = connected_components(edges, "url")
    table = rules_table(rules)
    node = F.col("node")
    linked = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    aliases = linked.select("node", F.regexp_extract(node, r"(?s)^([^/]*)", 1).alias("host"), F.regexp_extract(node, r"(?s)^[^/]*([^?]*)", 1).alias("path"))
    own = ruled(seen.where("node is not null").select("node", "host", "path").distinct(), table)
    marks = ruled(aliases, table).join(components, "node").groupBy("component").agg(F.max(F.col("verdict") == "allow").alias("allowed"), F.max(F.col("verdict") == "block").alias("blocked"))
    spread = components.join(marks.where("blocked and not allowed"), "component").select("node", F.lit("block").alias("spread"))
    out = seen.join(own, "node", "left").join(spread, "node", "left")
    return out.select("id", "url", "host", "path", "rule", F.coalesce("verdict", "spread", F.lit("allow")).alias("verdict"))


def allowed(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The pages that are not blocked, with all their columns; rows that share an id are judged each by its url."""
    gone = _judged(pages, rules, id_col, url_col, html_col).where("verdict = 'block'").select(F.col("url").alias("_blocked_url")).distinct()
    return pages.join(gone, F.col(url_col) == F.col("_blocked_url"), "left_anti")
