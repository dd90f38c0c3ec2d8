"""Registered queries of signals, scores, evidence and analyst rules, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vendorlens.functions import scalars, tables
from vendorlens.functions.lexicon import lexicon
from vendorlens.operators import analyst, evidence, scoring, signals
from vendorlens.sources import adapters as A

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _signals(spark, sf_dir):
    # the given files are single row groups: deal their rows out to all cores
    return signals.extract_signals(A.evidence_text(spark, sf_dir), ["doc_id", "source"], "text", lexicon(spark), distinct=False, spread=spark.sparkContext.defaultParallelism)


def _vendor_signals(spark, sf_dir):
    return _signals(spark, sf_dir).drop("doc_id").dropDuplicates(["source", "category", "severity", "keyword"])


@query(f"WITH {A.SIGNALS_SQL} SELECT doc_id, category, severity, keyword, weight FROM sig")
def automaton_signals(spark, sf_dir):
    found = signals.extract_signals_automaton(A.evidence_text(spark, sf_dir), ["doc_id", "source"], "text", lexicon(spark), distinct=False, spread=spark.sparkContext.defaultParallelism)
    return found.select("doc_id", "category", "severity", "keyword", "weight")


@query(f"""WITH {A.SIGNALS_SQL} SELECT doc_id, category, sum(weight)::BIGINT AS weight, upper(arg_max(severity, weight * 1000 - ord)) AS severity, string_agg(keyword, '|' ORDER BY ord) AS keywords FROM sig GROUP BY doc_id, category""")
def signals_by_table_function(spark, sf_dir):
    """Groups in SQL alone, from the table function lowered_signals; each text is lowered once."""
    tables.register_tables(spark)
    texts = A.evidence_text(spark, sf_dir)
    return spark.sql(
        """SELECT doc_id, category, sum(weight) AS weight, upper(max_by(severity, struct(weight, -ord))) AS severity, array_join(transform(array_sort(collect_list(struct(ord, keyword))), x -> x.keyword), '|') AS keywords
        FROM (SELECT doc_id, low FROM {texts} LATERAL VIEW explode(array(lower(text))) AS low) d, LATERAL lowered_signals(d.low) s GROUP BY doc_id, category""",
        texts=texts,
    )


@query(f"""WITH {A.TEXT_SQL}, big AS (SELECT DISTINCT lower(substring(text, 11, 9)) AS keyword, lang AS category, length(source) AS weight FROM f1 WHERE length(text) > 19),
    hits AS (SELECT f1.doc_id, big.keyword, big.category, big.weight FROM f1 JOIN big ON contains(lower(f1.text), big.keyword))
    SELECT keyword, category, weight, count(DISTINCT doc_id) AS n_documents, min(doc_id) AS first_document FROM hits GROUP BY keyword, category, weight""")
def large_lexicon(spark, sf_dir):
    """A lexicon that grows with the data: nine letters of each document. In how many documents is each of its entries?"""
    texts = A.evidence_text(spark, sf_dir)
    long = texts.where(F.length("text") > 19)
    big = long.select(F.lower(F.substring("text", 11, 9)).alias("keyword"), F.col("lang").alias("category"), F.length("source").alias("weight")).distinct()
    counts = signals.keyword_counts(texts, "doc_id", "text", big, spread=spark.sparkContext.defaultParallelism)
    return big.join(counts, "keyword").select("keyword", "category", "weight", F.col("n_keys").alias("n_documents"), F.col("first_key").alias("first_document"))


SCORE_SQL = """SELECT {k}, CASE WHEN n IS NULL THEN 5 ELSE s END::INTEGER AS risk_score,
    CASE WHEN n IS NULL THEN 'LOW' WHEN s >= 70 THEN 'CRITICAL' WHEN s >= 50 THEN 'HIGH' WHEN s >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
    CASE WHEN n IS NULL THEN 0.3::DOUBLE ELSE round(0.5::DOUBLE * (c / 5) + 0.5::DOUBLE * least(1.0::DOUBLE, n / 15), 2) END AS confidence_score,
    CASE WHEN n IS NULL THEN 0.05::DOUBLE ELSE round(least(0.99::DOUBLE, s / 100 * (1.0::DOUBLE + CASE WHEN crit THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN joint THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END)) - 1e-9::DOUBLE, 2) END AS disruption_probability,
    coalesce(n, 0)::BIGINT AS n_signals, coalesce(c, 0)::BIGINT AS n_categories
FROM {everyone} LEFT JOIN (
    SELECT {k}, least(100, sum(weight)) AS s, count(*) AS n, count(DISTINCT category) AS c, bool_or(severity = 'critical') AS crit,
           bool_or(category = 'financial') AND bool_or(category = 'operational') AS joint FROM {sig} GROUP BY {k}
) USING ({k})"""

_DOC_SCORES = SCORE_SQL.format(k="doc_id", everyone="f1", sig="sig")
_VENDOR_SCORES = SCORE_SQL.format(k="source", everyone="(SELECT DISTINCT source FROM f1) v", sig="vsig")


@query(f"WITH {A.SIGNALS_SQL} SELECT doc_id, category, severity, keyword, weight FROM sig")
def signals_by_document(spark, sf_dir):
    return _signals(spark, sf_dir).select("doc_id", "category", "severity", "keyword", "weight")


@query(f"WITH {A.SIGNALS_SQL} {_DOC_SCORES}")
def risk_score(spark, sf_dir):
    return scoring.score_signals(_signals(spark, sf_dir), "doc_id", everyone=A.evidence_text(spark, sf_dir))


@query(f"WITH {A.SIGNALS_SQL} {_VENDOR_SCORES}")
def risk_score_by_source(spark, sf_dir):
    return scoring.score_signals(_vendor_signals(spark, sf_dir), "source", everyone=A.evidence_text(spark, sf_dir))


@query(f"WITH {A.SIGNALS_SQL}, x AS ({_DOC_SCORES}) SELECT risk_level, count(*) AS n, round(avg(confidence_score), 6) AS mean_confidence, round(avg(disruption_probability), 6) AS mean_disruption FROM x GROUP BY risk_level")
def risk_level_hist(spark, sf_dir):
    return risk_score(spark, sf_dir).groupBy("risk_level").agg(F.count("*").alias("n"), F.round(F.avg("confidence_score"), 6).alias("mean_confidence"), F.round(F.avg("disruption_probability"), 6).alias("mean_disruption"))


def _groups_sql(k: str, sig: str) -> str:
    return f"""ind AS (
        SELECT {k}, category, indicator, min(ord) AS o, row_number() OVER (PARTITION BY {k}, category ORDER BY min(ord)) AS r FROM {sig} GROUP BY {k}, category, indicator
    ), groups AS (
        SELECT g.{k}, upper(g.category[1]) || g.category[2:] AS category, severity, weight, ord, indicators FROM (
            SELECT {k}, category, upper(arg_max(severity, weight * 1000 - ord)) AS severity, sum(weight)::BIGINT AS weight, min(ord) AS ord FROM {sig} GROUP BY {k}, category
        ) g JOIN (SELECT {k}, category, string_agg(indicator, '|' ORDER BY o) AS indicators FROM ind WHERE r <= 5 GROUP BY {k}, category) i ON i.{k} = g.{k} AND i.category = g.category
    )"""


@query(f"WITH {A.SIGNALS_SQL}, {_groups_sql('doc_id', 'sig')} SELECT doc_id, category, severity, weight, indicators FROM groups")
def signal_groups(spark, sf_dir):
    g = scoring.signal_groups(_signals(spark, sf_dir), "doc_id")
    return g.select("doc_id", "category", "severity", "weight", F.array_join("indicators", "|").alias("indicators"))


@query(f"WITH {A.SIGNALS_SQL}, {_groups_sql('doc_id', 'sig')} SELECT doc_id, string_agg(category || ':' || weight, ',' ORDER BY weight DESC, ord) AS signals FROM groups GROUP BY doc_id")
def grouped_report_signals(spark, sf_dir):
    g = scoring.grouped_arrays(scoring.signal_groups(_signals(spark, sf_dir), "doc_id"), "doc_id")
    return g.select("doc_id", F.array_join(F.transform("signals", lambda s: F.concat(s.category, F.lit(":"), s.weight.cast("string"))), ",").alias("signals"))


@query(f"WITH {A.SIGNALS_SQL} SELECT category, severity, grouping(category, severity)::BIGINT AS grouping, count(DISTINCT source) AS vendors, sum(weight)::BIGINT AS total_weight FROM vsig GROUP BY CUBE (category, severity)")
def category_severity_cube(spark, sf_dir):
    return scoring.rollup_signals(_vendor_signals(spark, sf_dir), "source")


@query(f"""WITH {A.SIGNALS_SQL}, {A.DATED_SQL} SELECT category, severity, grouping(category, severity)::BIGINT AS grouping, count(DISTINCT doc_id) AS vendors, true AS close, sum(weight)::BIGINT AS total_weight
    FROM dsig GROUP BY CUBE (category, severity)""")
def sketch_rollup(spark, sf_dir):
    """Each document as a vendor: estimates from daily sketches beside the exact numbers; ``close``: within 3 %."""
    found = A.dated_signals(spark, sf_dir, _signals(spark, sf_dir))
    exact = scoring.rollup_signals(found, "doc_id").withColumnRenamed("vendors", "n")
    about = scoring.rollup_sketches(scoring.daily_sketches(found, "doc_id")).select(*[F.col(c).alias(f"a_{c}") for c in ("category", "severity", "grouping", "vendors")])
    same = exact["category"].eqNullSafe(F.col("a_category")) & exact["severity"].eqNullSafe(F.col("a_severity")) & (exact["grouping"] == F.col("a_grouping"))
    close = F.abs(F.col("a_vendors") - F.col("n")) <= 0.03 * F.col("n")
    return exact.join(about, same).select("category", "severity", "grouping", F.col("n").alias("vendors"), close.alias("close"), "total_weight")


@query(f"WITH {A.SIGNALS_SQL}, {_groups_sql('source', 'vsig')}, o AS (SELECT source, list(category ORDER BY weight DESC, ord) AS c FROM groups GROUP BY source) SELECT source, c[1] AS primary_category, array_to_string(c[2:], '|') AS secondary FROM o")
def primary_category(spark, sf_dir):
    out = analyst.primary_category(scoring.signal_groups(_vendor_signals(spark, sf_dir), "source"), ["source"])
    return out.withColumn("secondary", F.array_join("secondary", "|"))


# --- evidence


def _payloads(spark, sf_dir):
    e = A.evidence(spark, sf_dir)
    hit = F.to_json(F.struct(F.struct("title", F.when(F.col("doc_id") % 2 == 0, F.col("url")).otherwise("").alias("link"), "url", F.col("snippet")).alias("h")))
    hit = F.regexp_extract(hit, r'(?s)^\{"h":(.*)\}$', 1)
    listed = F.concat(F.lit('{"organic":['), hit, F.lit("]}"))
    escaped = F.replace(F.replace("snippet", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    quoted = F.to_json(F.struct(listed.alias("body")))
    page = F.to_json(F.struct(F.concat(F.lit("<article><h1>Title "), F.col("doc_id").cast("string"), F.lit('</h1><a href="'), "url", F.lit('">x</a><p>Some <b>text</b> '), escaped, F.lit("</p></article>")).alias("body")))
    kind = F.col("doc_id") % 5
    payload = F.when(kind == 0, listed).when(kind == 1, quoted).when(kind == 2, page).when(kind == 3, F.concat(F.lit('{"body":'), listed, F.lit("}"))).otherwise(F.concat(F.lit("{broken "), listed))
    return e.select(F.col("doc_id").alias("response_id"), "vendor_id", "query_id", payload.alias("payload"))


@query(f"""WITH {A.EVIDENCE_SQL}
    SELECT doc_id AS response_id, vendor_id, query_id::INTEGER AS query_id, 0 AS rank, title, url, snippet FROM ev WHERE doc_id % 5 IN (0, 1, 3)
    UNION ALL SELECT doc_id, vendor_id, query_id::INTEGER, 0, 'Title ' || doc_id, url, regexp_replace('Some text ' || replace(replace(snippet, '&', '&amp;'), '<', '&lt;'), '\\s+$', '') FROM ev WHERE doc_id % 5 = 2""")
def serp_normalise(spark, sf_dir):
    return evidence.normalise_serp(_payloads(spark, sf_dir))


@query(r"""WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<article>(.*?)(?:</article>|$)', 1)) AS b, generate_subscripts(regexp_extract_all(html, '(?s)<article>(.*?)(?:</article>|$)', 1), 1) - 1 AS rank FROM pages),
    f AS (SELECT page_id, rank, regexp_replace(regexp_replace(regexp_extract(b, '(?s)<h1>(.*?)</h1>', 1), '(?s)<[^>]*>', '', 'g'), '^\s+|\s+$', '', 'g') AS title,
          regexp_replace(regexp_replace(regexp_extract(b, '(?s)<p>(.*?)(?:</p>|<p>|$)', 1), '(?s)<[^>]*>', '', 'g'), '^\s+|\s+$', '', 'g') AS snippet FROM b WHERE rank < 10)
    SELECT page_id, rank::INTEGER AS rank, title, url, snippet FROM f JOIN pages USING (page_id) WHERE title <> '' AND url <> ''""")
def html_hits(spark, sf_dir):
    pages = A.read(spark, sf_dir, "pages")
    # the pages have no result links: the page's own address stands for them
    linked = pages.select("page_id", F.regexp_replace("html", "<article>", F.concat(F.lit('<article><a href="'), F.regexp_replace("url", r"([\\$])", r"\\$1"), F.lit('"></a>'))).alias("html"))
    return evidence.html_hits(linked, ["page_id"])


@query("""WITH n AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN chr(9) || ' ' || s_name || ' ' WHEN 1 THEN replace(s_name, '#', ' ') ELSE s_name || '.Org' END AS name FROM supplier),
    p AS (SELECT *, replace(regexp_replace(lower(name), '^\\s+|\\s+$', '', 'g'), ' ', '') AS d FROM n) SELECT s_suppkey AS vendor_id, name, CASE WHEN contains(d, '.') THEN d ELSE d || '.com' END AS domain FROM p""")
def vendor_domain(spark, sf_dir):
    k = F.col("s_suppkey") % 3
    name = F.when(k == 0, F.concat(F.lit("\t "), "s_name", F.lit(" "))).when(k == 1, F.replace("s_name", F.lit("#"), F.lit(" "))).otherwise(F.concat("s_name", F.lit(".Org")))
    return A.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("vendor_id"), name.alias("name")).withColumn("domain", scalars.vendor_domain(F.col("name")))


def _query_rows() -> str:
    rows = [*evidence.SWEEP_QUERIES, evidence.SUPPLEMENTARY_QUERY]
    return ", ".join(f"({i}, '{t}')" for i, t in rows)


@query(f"""WITH v AS (SELECT s_suppkey AS vendor_id, s_name AS name, replace(trim(lower(s_name)), ' ', '') AS d FROM supplier), q(query_id, form) AS (VALUES {_query_rows()}),
    x AS (SELECT vendor_id, query_id, replace(replace(form, '{{v}}', name), '{{d}}', CASE WHEN contains(d, '.') THEN d ELSE d || '.com' END) AS query FROM v, q)
    SELECT vendor_id, query_id, query, 'https://www.google.com/search?q=' || replace(url_encode(query), '%20', '+') || '&hl=en' AS search_url FROM x""")
def query_expand(spark, sf_dir):
    v = A.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("vendor_id"), F.col("s_name").alias("name"))
    return evidence.expand_queries(v)


@query(f"WITH {A.EVIDENCE_SQL} SELECT doc_id, vendor_name, url FROM ev WHERE contains(lower(title || ' ' || snippet), lower(trim(vendor_name)))")
def mention_filter(spark, sf_dir):
    return evidence.mention_filter(A.evidence(spark, sf_dir)).select("doc_id", "vendor_name", "url")


_ALL_SQL = f"""{A.EVIDENCE_SQL}, kept AS (SELECT * FROM ev WHERE contains(lower(title || ' ' || snippet), lower(trim(vendor_name)))),
    added AS (SELECT * FROM kept UNION ALL SELECT ev2.* FROM ev2 WHERE NOT EXISTS (SELECT 1 FROM kept WHERE kept.vendor_id = ev2.vendor_id AND kept.url = ev2.url))"""


def _all_evidence(spark, sf_dir):
    return evidence.add_supplementary(evidence.mention_filter(A.evidence(spark, sf_dir)), A.supplementary(spark, sf_dir))


@query(f"WITH {_ALL_SQL} SELECT doc_id, vendor_id, pass, query_id::INTEGER AS query_id, url, CASE pass WHEN 1 THEN 'search' ELSE 'supplementary' END AS source FROM added")
def evidence_antijoin(spark, sf_dir):
    return _all_evidence(spark, sf_dir).select("doc_id", "vendor_id", "pass", "query_id", "url", "source")


_TERMS = [("The", ["lawsuit", "fraud", "scandal"]), ("der", ["shutdown", "delays", "losses"]), ("que", ["breach", "hacked", "leak"])]
_TOPICS_SQL = ", ".join(f"({i}, 0, '{p}', {t!r}, 'src{i}.example.com')" for i, (p, t) in enumerate(_TERMS))


@query(f"""WITH {A.EVIDENCE_SQL}, topics(vendor_id, query_id, phrase, terms, domain) AS (VALUES {_TOPICS_SQL})
    SELECT ev.doc_id, t.vendor_id, t.query_id FROM ev JOIN topics t ON contains(lower(snippet), lower(phrase)) AND len(list_filter(terms, lambda x: contains(lower(snippet), lower(x)))) > 0
    AND NOT (regexp_extract(url, '^[^:]+://([^/?#]+)', 1) = domain OR ends_with(regexp_extract(url, '^[^:]+://([^/?#]+)', 1), '.' || domain))""")
def corpus_retrieval(spark, sf_dir):
    topics = spark.createDataFrame([(i, 0, p, t, f"src{i}.example.com") for i, (p, t) in enumerate(_TERMS)], "vendor_id int, query_id int, phrase string, terms array<string>, domain string")
    return evidence.retrieve(A.evidence(spark, sf_dir), topics, keys=["doc_id"], text_col="snippet")


@query(f"""WITH {A.EVIDENCE_SQL}, t AS (SELECT doc_id AS vendor_id, (doc_id % 3)::INTEGER AS query_id, lower(substring(snippet, (3 * (doc_id % 5))::INTEGER + 1, CASE doc_id % 50 WHEN 7 THEN 1 WHEN 9 THEN 2 WHEN 11 THEN 0 ELSE 12 END)) AS phrase,
        [lower(substring(snippet, 30, 4)), 'lawsuit'] AS terms, 'src' || doc_id % 7 || '.example.com' AS domain FROM ev), d AS (SELECT doc_id, lower(snippet) AS x, regexp_extract(url, '^[^:]+://([^/?#]+)', 1) AS host FROM ev)
    SELECT doc_id, vendor_id, query_id FROM d JOIN t ON contains(x, phrase) AND (contains(x, terms[1]) OR contains(x, terms[2])) AND NOT (host = domain OR ends_with(host, '.' || domain))""")
def indexed_retrieval(spark, sf_dir):
    """A topic for each document, with a phrase and a term of its text."""
    e = A.evidence(spark, sf_dir)
    k = F.col("doc_id") % 50
    length = F.when(k == 7, 1).when(k == 9, 2).when(k == 11, 0).otherwise(12)
    topics = e.select(
        F.col("doc_id").alias("vendor_id"), (F.col("doc_id") % 3).cast("int").alias("query_id"), F.substring("snippet", (3 * (F.col("doc_id") % 5) + 1).cast("int"), length).alias("phrase"),
        F.array(F.substring("snippet", 30, 4), F.lit("lawsuit")).alias("terms"), F.concat(F.lit("src"), (F.col("doc_id") % 7).cast("string"), F.lit(".example.com")).alias("domain"),
    )
    spread = e.repartition(spark.sparkContext.defaultParallelism)  # the given files are single row groups
    return evidence.retrieve_indexed(spread, topics, keys=["doc_id"], text_col="snippet")


_PLACED = "placed AS (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY pass, query_id, rank) AS place FROM added)"


@query(f"""WITH {_ALL_SQL}, {_PLACED}, {A.VENDORS_SQL}, l AS (SELECT vendor_id, string_agg('- [' || title || '](' || url || '): ' || substring(snippet, 1, 200), chr(10) ORDER BY place) AS t FROM placed WHERE place <= 5 AND title <> '' AND url <> '' GROUP BY vendor_id)
    SELECT vendor_id, md5(coalesce(t, 'No live results were retrieved for ' || name || '.')) AS digest FROM vendors LEFT JOIN l USING (vendor_id)""")
def evidence_digest(spark, sf_dir):
    return evidence.digest(_all_evidence(spark, sf_dir), A.vendors(spark, sf_dir)).withColumn("digest", F.md5(F.col("digest").cast("binary")))


@query(f"WITH {_ALL_SQL}, {_PLACED} SELECT vendor_id, string_agg(url, '|' ORDER BY place) AS urls FROM placed WHERE place <= 8 AND title <> '' AND url <> '' GROUP BY vendor_id")
def report_sources(spark, sf_dir):
    return evidence.top_sources(_all_evidence(spark, sf_dir)).select("vendor_id", F.array_join(F.transform("sources", lambda s: s.url), "|").alias("urls"))


def _scraped(spark, sf_dir):
    # each document stands for a vendor: it is its filing and, for even ones, its regional text
    d = A.evidence(spark, sf_dir).select(F.col("doc_id").alias("vendor_id"), F.col("snippet").alias("text"))
    kinds = F.when(F.col("vendor_id") % 2 == 0, F.array(F.lit("filing"), F.lit("regional"))).otherwise(F.array(F.lit("filing")))
    return d.select("vendor_id", F.explode(kinds).alias("kind"), "text")


_SCRAPED_SQL = """scraped AS (SELECT doc_id AS vendor_id, snippet || CASE WHEN doc_id % 2 = 0 AND snippet <> '' THEN chr(10) || chr(10) || '[Regional context]: ' || substring(snippet, 1, 1000) ELSE '' END AS scraped FROM ev)"""


@query(f"WITH {A.EVIDENCE_SQL}, {_SCRAPED_SQL} SELECT vendor_id, length(scraped)::INTEGER AS n_chars, md5(scraped) AS scraped FROM scraped")
def scraped_merge(spark, sf_dir):
    return evidence.merge_scraped(_scraped(spark, sf_dir)).select("vendor_id", F.length("scraped").alias("n_chars"), F.md5(F.col("scraped").cast("binary")).alias("scraped"))


@query(f"""WITH {_ALL_SQL}, {_SCRAPED_SQL}, p AS (SELECT doc_id AS vendor_id, string_agg(snippet || ' ' || title, ' ' ORDER BY pass, query_id, rank) AS t FROM added GROUP BY doc_id)
    SELECT vendor_id, length(coalesce(t, '') || substring(coalesce(scraped, ''), 1, 2000))::INTEGER AS n_chars, md5(coalesce(t, '') || substring(coalesce(scraped, ''), 1, 2000)) AS pooled FROM p FULL JOIN scraped USING (vendor_id)""")
def text_pool(spark, sf_dir):
    """Pooled texts, each document being a vendor with its hits of both passes."""
    found = _all_evidence(spark, sf_dir).withColumn("vendor_id", F.col("doc_id"))
    pooled = evidence.pool_text(found, evidence.merge_scraped(_scraped(spark, sf_dir)))
    return pooled.select("vendor_id", F.length("pooled").alias("n_chars"), F.md5(F.col("pooled").cast("binary")).alias("pooled"))


@query(f"""WITH {A.TEXT_SQL}, w AS (SELECT doc_id, source, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM f1), pooled AS (SELECT source AS vendor_id, string_agg(t, ' ' ORDER BY doc_id) AS t FROM w GROUP BY source)
    SELECT vendor_id, category, severity, keyword, weight FROM pooled JOIN lexicon ON contains(t, lexicon.keyword)""")
def pooled_signals(spark, sf_dir):
    """Signals of each source's pooled text, every two words of its documents being a hit, so that most keywords of several words lie over hits."""
    words = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    texts = A.evidence_text(spark, sf_dir).select("doc_id", F.col("source").alias("vendor_id"), words.alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w"), F.lit(2)), lambda i: F.slice("w", i, F.lit(2)))
    hits = texts.select("vendor_id", F.lit(1).alias("pass"), F.col("doc_id").alias("query_id"), F.posexplode(pairs).alias("rank", "two"))
    # an odd last word has no title; its blank stands for the one before the next hit
    hits = hits.select("vendor_id", "pass", "query_id", "rank", F.col("two")[0].alias("snippet"), F.try_element_at("two", F.lit(2)).alias("title"))
    return evidence.pool_signals(hits, lexicon(spark)).select("vendor_id", "category", "severity", "keyword", "weight")


@query(f"WITH {_ALL_SQL} SELECT vendor_id, count(*) AS n_hits, length(string_agg(snippet || ' ' || title, ' '))::BIGINT AS n_chars FROM added GROUP BY vendor_id")
def text_pool_sizes(spark, sf_dir):
    """Sizes of the pooled text of each source, whose hits no task gathers."""
    return evidence.pool_sizes(evidence.pool_parts(_all_evidence(spark, sf_dir)))


@query(f"WITH {A.TEXT_SQL} SELECT doc_id, md5(CASE WHEN doc_id % 10 = 0 OR text = '' THEN 'No scraped content was found.' ELSE substring(text, 1, 3000) END) AS prompt FROM f1")
def prompt_texts(spark, sf_dir):
    text = F.when(F.col("doc_id") % 10 != 0, F.col("text"))
    return A.evidence_text(spark, sf_dir).select("doc_id", F.md5(evidence.prompt_text(text).cast("binary")).alias("prompt"))


# --- analyst rules

_CLASSES = [("src0.example.com", "Official"), ("src1.example.com", "News"), ("src2.example.com", "News"), ("example.org", "Forum")]
_CLASS_ROWS = ", ".join(f"('{h}', '{c}', {analyst.SOURCE_CLASSES[c]}::DOUBLE)" for h, c in _CLASSES)
_CRED_SQL = f"""classes(host_suffix, class, credibility) AS (VALUES {_CLASS_ROWS}),
    urls AS (SELECT doc_id, pass, lower(regexp_extract(coalesce(url, ''), '^[^:]+://([^/?#]+)', 1)) AS host FROM (SELECT * FROM ev UNION ALL SELECT * FROM ev2)),
    cred AS (SELECT doc_id, pass, host, coalesce(arg_max(class, length(host_suffix)), 'Unknown') AS class, coalesce(arg_max(credibility, length(host_suffix)), 0.3::DOUBLE) AS credibility
             FROM urls LEFT JOIN classes ON host = host_suffix OR ends_with(host, '.' || host_suffix) GROUP BY doc_id, pass, host)"""


def _credible(spark, sf_dir):
    both = A.evidence(spark, sf_dir).unionByName(A.supplementary(spark, sf_dir))
    return analyst.credibility(both, analyst.source_class(spark, _CLASSES))


@query(f"WITH {A.EVIDENCE_SQL}, {_CRED_SQL} SELECT doc_id, pass, host, class, credibility FROM cred")
def credibility(spark, sf_dir):
    return _credible(spark, sf_dir).select("doc_id", "pass", "host", "class", "credibility")


def _supported(spark, sf_dir):
    # documents of four sources tell of one vendor, so that signals have several hosts
    told = F.concat(F.when(F.col("doc_id") % 7 < 3, "Quarterly results: ").otherwise(""), F.coalesce("title", F.lit("")))
    hosts = _credible(spark, sf_dir).where("pass = 1").select("doc_id", "host", "credibility", analyst.routine(told).alias("is_routine"))
    s = _signals(spark, sf_dir).join(hosts, "doc_id").withColumn("vendor_id", F.col("doc_id") % 37)
    return analyst.supported_signals(s, ["vendor_id"])


_SUPPORT_SQL = f"""{A.EVIDENCE_SQL}, {_CRED_SQL}, sig AS (SELECT f1.doc_id, l.* FROM f1 JOIN lexicon l ON contains(lower(f1.text), l.keyword)),
    news AS (SELECT doc_id, regexp_matches(lower(CASE WHEN doc_id % 7 < 3 THEN 'Quarterly results: ' ELSE '' END || coalesce(title, '')), '{analyst.ROUTINE}') AS is_routine FROM ev),
    hosts AS (SELECT doc_id % 37 AS vendor_id, category, severity, keyword, weight, ord, host, max(credibility) AS credibility, bool_and(is_routine) AS is_routine FROM sig JOIN cred USING (doc_id) JOIN news USING (doc_id) WHERE pass = 1 GROUP BY doc_id % 37, category, severity, keyword, weight, ord, host),
    sup AS (SELECT vendor_id, category, severity, keyword, weight, ord, count(*) AS n_hosts, max(credibility) AS best, round(1 - exp(sum(ln(1 - credibility))), 6) AS confidence, count(*) >= 2 AS corroborated, bool_and(is_routine) AS is_routine FROM hosts GROUP BY vendor_id, category, severity, keyword, weight, ord)"""


@query(f"WITH {_SUPPORT_SQL} SELECT vendor_id, category, severity, keyword, n_hosts, confidence, corroborated FROM sup")
def corroboration(spark, sf_dir):
    return _supported(spark, sf_dir).select("vendor_id", "category", "severity", "keyword", "n_hosts", "confidence", "corroborated")


@query(f"WITH {_SUPPORT_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY round(weight * confidence, 6) DESC, ord)::INTEGER AS place FROM sup) SELECT vendor_id, place, category, keyword, round(weight * confidence, 6) AS strength FROM p WHERE place <= 5")
def top_factors(spark, sf_dir):
    return analyst.top_factors(_supported(spark, sf_dir), ["vendor_id"]).select("vendor_id", "place", "category", "keyword", "strength")


_LEVEL = "CASE WHEN {s} >= 70 THEN 'CRITICAL' WHEN {s} >= 50 THEN 'HIGH' WHEN {s} >= 25 THEN 'MEDIUM' ELSE 'LOW' END"


@query(f"""WITH {_SUPPORT_SQL}, o AS (SELECT vendor_id, least(100, coalesce(sum(weight), 5))::INTEGER AS raw_score, least(100, coalesce(sum(weight) FILTER ((corroborated OR best >= 0.8) AND NOT is_routine), 5))::INTEGER AS adjusted_score FROM sup GROUP BY vendor_id)
    SELECT vendor_id, raw_score, adjusted_score, {_LEVEL.format(s='raw_score')} AS raw_level, {_LEVEL.format(s='adjusted_score')} AS adjusted_level FROM o""")
def override_level(spark, sf_dir):
    return analyst.override_level(_supported(spark, sf_dir), ["vendor_id"])


@query(f"""WITH {A.EVIDENCE_SQL}, m AS (SELECT doc_id, lower(trim(vendor_name)) AS v, lower(title || ' ' || substring(snippet, 1, 500)) AS t, contains(lower(title || ' ' || snippet), lower(trim(vendor_name))) AS has FROM ev),
    c AS (SELECT doc_id, CASE WHEN has THEN ((length(t) - length(replace(t, v, ''))) / length(v))::INTEGER ELSE 0 END AS n_mentions FROM m) SELECT doc_id, n_mentions, n_mentions >= 1 AS is_subject FROM c""")
def subject_check(spark, sf_dir):
    return analyst.subject_check(A.evidence(spark, sf_dir)).select("doc_id", "n_mentions", "is_subject")


@query(f"""WITH {A.SIGNALS_SQL}, {A.DATED_SQL}, n AS (SELECT source, max(day) AS newest FROM dsig WHERE severity = 'critical' GROUP BY source), d AS (SELECT source, newest, date_diff('day', newest, DATE '2024-03-31') AS days FROM (SELECT DISTINCT source FROM f1) s LEFT JOIN n USING (source))
    SELECT source, newest::VARCHAR AS newest, CASE WHEN days IS NULL THEN 'Near-term' WHEN days <= 30 THEN 'Immediate' WHEN days <= 90 THEN 'Near-term' WHEN days <= 180 THEN 'Medium-term' ELSE 'Long-term' END AS time_horizon FROM d""")
def horizon(spark, sf_dir):
    dated = A.dated_signals(spark, sf_dir, _signals(spark, sf_dir)).where("severity = 'critical'").groupBy("source").agg(F.max("day").alias("newest"))
    everyone = A.evidence_text(spark, sf_dir).select("source").distinct().join(dated, "source", "left")
    return everyone.select("source", F.col("newest").cast("string").alias("newest"), analyst.horizon(F.col("newest"), F.lit("2024-03-31").cast("date")).alias("time_horizon"))


@query(f"""WITH {A.SIGNALS_SQL}, own AS (SELECT DISTINCT source, category, severity, keyword FROM vsig), known AS (SELECT * FROM own WHERE source IN ('src0', 'src3', 'src7')),
    a AS (SELECT source, count(*) AS a FROM own GROUP BY source), b AS (SELECT source AS case_id, count(*) AS b FROM known GROUP BY source),
    s AS (SELECT own.source, known.source AS case_id, count(*) AS shared FROM own JOIN known USING (category, severity, keyword) WHERE own.source <> known.source GROUP BY own.source, known.source),
    j AS (SELECT source, case_id, shared, round(shared / (a + b - shared), 6) AS jaccard FROM s JOIN a USING (source) JOIN b USING (case_id)),
    p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY jaccard DESC, case_id)::INTEGER AS place FROM j) SELECT * FROM p WHERE place <= 3""")
def analogues(spark, sf_dir):
    s = _vendor_signals(spark, sf_dir)
    return analyst.analogues(s, s.where(F.col("source").isin("src0", "src3", "src7")), "source")


@query(f"""WITH {A.SIGNALS_SQL}, own AS (SELECT DISTINCT doc_id, category, severity, keyword FROM sig), known AS (SELECT * FROM own WHERE doc_id % 4 = 1),
    a AS (SELECT doc_id, count(*) AS a FROM own GROUP BY doc_id), b AS (SELECT doc_id AS case_id, count(*) AS b FROM known GROUP BY doc_id),
    s AS (SELECT own.doc_id, known.doc_id AS case_id, count(*) AS shared FROM own JOIN known USING (category, severity, keyword) WHERE own.doc_id <> known.doc_id GROUP BY own.doc_id, known.doc_id),
    j AS (SELECT doc_id, case_id, shared, round(shared / (a + b - shared), 6) AS jaccard FROM s JOIN a USING (doc_id) JOIN b USING (case_id)),
    p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY jaccard DESC, case_id)::INTEGER AS place FROM j) SELECT * FROM p WHERE place <= 5""")
def document_analogues(spark, sf_dir):
    """Every document against a quarter of all as known cases: many cases with the same signals."""
    s = _signals(spark, sf_dir)
    return analyst.analogues(s, s.where("doc_id % 4 = 1"), "doc_id", 5)


@query(f"""WITH {A.SIGNALS_SQL}, {A.DATED_SQL}, days AS (SELECT DISTINCT source, day FROM dsig)
    SELECT d.source, d.day::VARCHAR AS day, sum(weight) FILTER (s.day > d.day - 90)::BIGINT AS weight_now, coalesce(sum(weight) FILTER (s.day <= d.day - 90), 0)::BIGINT AS weight_before,
           count(DISTINCT category) FILTER (s.day > d.day - 90)::INTEGER AS categories_now, count(DISTINCT category) FILTER (s.day <= d.day - 90)::INTEGER AS categories_before
    FROM days d JOIN dsig s ON s.source = d.source AND s.day <= d.day AND s.day > d.day - 180 GROUP BY d.source, d.day""")
def converging_risk(spark, sf_dir):
    return analyst.converging(A.dated_signals(spark, sf_dir, _signals(spark, sf_dir)), "source").withColumn("day", F.col("day").cast("string"))
