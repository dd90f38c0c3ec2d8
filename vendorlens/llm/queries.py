"""The registered queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendorlens.llm import decontamination, hash_ring, html_text, merkle, near_dedup, packing, periodic_runs, pii, substring_dedup, token_tables, topk, toxicity, url_filter
from vendorlens.llm.common import small_batches, table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.expr("array_sort(array_distinct(filter(transform(items, x -> x.item_id), x -> x is not null)))")
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)
    return found.withColumnRenamed("id", "doc_id")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary, cut = substring_dedup.repeated_passages(table(spark, sf_dir, "documents"), width=50)
    cut = cut.select(F.col("id").alias("cut_id"), F.col("t").alias("cut_t"), "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("cut_sha"))
    copy = F.col("first").isNotNull()
    return summary.join(cut, (F.col("id") == F.col("cut_id")) & (F.col("t") == F.col("cut_t")), "left").select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("cut_sha", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )


def op5_token_sstables(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_tables.write_tables(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_tables.read_tables(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = lambda c: F.crc32(F.col(c).cast("string")) % 4 == 2
    model = toxicity.trained(documents, table(spark, sf_dir, "labels"), usable=~held_out("_id"))
    found = toxicity.scored(documents, model)
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    count = lambda k: F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as long)").alias(f"n_{k}")
    joined = lambda c: F.expr(f"array_join(transform({c}, x -> concat_ws(':', x.kind, x.start, x.stop)), ',')")
    return found.select(F.col("id").alias("doc_id"), *[count(k) for k in pii.KINDS], F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, 10)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The rules of op3: longest wins.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return url_filter.judged(table(spark, sf_dir, "pages"), rules).withColumnRenamed("id", "page_id")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extracted(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """The documents, a tenth of them with a planted run: with h the crc32 of the id and g = h // 10, the words from a = g % n on
    become those from a to a + p - 1 over and over, where p = 1 + (n - a) // (3 + g % 8)."""
    h, g = F.crc32(F.col("doc_id").cast("string")), F.expr("h div 10")
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    staged = documents.select("doc_id", "text", h.alias("h")).select("doc_id", "text", g.alias("g"), words.alias("w"))
    staged = staged.select("*", F.when(F.size("w") > 0, F.expr("g % size(w)")).alias("a"))
    staged = staged.select("*", F.expr("1 + (size(w) - a) div (3 + g % 8)").alias("p"))
    text = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[int(a + (i - a) % p)])), ' ')")
    return staged.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    # a ratio of whole numbers is compared by products
    order = "case when x.length * y.period <> y.length * x.period then if(x.length * y.period > y.length * x.period, -1, 1) when x.start <> y.start then if(x.start < y.start, -1, 1) else cast(sign(x.period - y.period) as int) end"
    best = F.expr(f"aggregate(runs, runs[0], (x, y) -> if({order} <= 0, x, y))")
    lines = F.expr("array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\n')), '')")
    return found.select("id", "kept_text", "runs", F.when(F.size("runs") > 0, best).alias("best")).select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    leaf = lambda n_chars: merkle.row_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    leaves = documents.select("doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"), F.when(tampered, leaf(F.col("n_chars") + 1)).alias("changed"))
    found = merkle.manifest(leaves, id_col="doc_id", group_col="lang", leaf_col="leaf", changed_col="changed")
    return found.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(F.array_join(merkle.siblings(), ""), 256).alias("proof_sha256"),
        F.col("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def op13_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hash_ring.sharded(table(spark, sf_dir, "documents"), 16)
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _limited(query):
    """The query in a session that sends small batches to Python."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    f.__name__: _limited(f)
    for f in (
        op9_html_extraction,
        op2_exact_topk,
        op3_url_filter,
        op8_toxicity,
        op10_pii,
        op5_token_sstables,
        op7_packing,
        op6_substring_dedup,
        op4_minhash_near_dedup,
        op1_benchmark_decontamination,
        op11_periodic_runs,
        op12_merkle_manifest,
        op13_hash_ring,
    )
}

ORACLE_SQL = {
    "op2_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op3_url_filter": r"""
        WITH RECURSIVE rules(rule, verdict) AS (
            VALUES ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'allow'), ('example.net/de/8', 'block'), ('org/es/', 'block')
        ), r AS (SELECT rule, verdict, regexp_extract(rule, '^([^/]*)', 1) AS rule_host, regexp_extract(rule, '^[^/]*(.*)$', 1) AS rule_path FROM rules),
        shown AS (
            SELECT url, regexp_replace(html, '(?is)<!--.*?(?:-->|\z)|<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)|<textarea\b[^>]*>.*?(?:</textarea\s*>|\z)', ' ', 'g') AS html FROM pages
        ), tags AS (
            SELECT url AS u, regexp_extract(t, '(?is)[\s"''/]href\s*=\s*["'']?([^"''\s>]+)', 1) AS t
            FROM (SELECT url, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*>')) AS t FROM shown)
            WHERE regexp_matches(t, '(?is)\srel\s*=\s*(?:"(?:[^">]*\s)?canonical(?:\s[^">]*)?"|''(?:[^''>]*\s)?canonical(?:\s[^''>]*)?''|canonical[\s/>])')
            UNION ALL
            SELECT url, regexp_extract(t, '(?is)[\s"'';,]url\s*=\s*["'']?((?:[^"''\s>;&]|&#?\w+;|&)+)', 1)
            FROM (SELECT url, unnest(regexp_extract_all(html, '(?is)<meta\b(?:[^>]*[\s"''/])?http-equiv\s*=\s*["'']?refresh\b[^>]*>')) AS t FROM shown)
        ), plain AS (
            SELECT u, replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS t FROM tags WHERE t <> ''
        ), based AS (
            SELECT row_number() OVER () AS k, u, t, regexp_extract(u, '(?s)^(.*?://[^/?#]*)', 1) AS base,
                   CASE WHEN regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) END AS own,
                   regexp_extract(t, '(?s)^([^?#]*)', 1) AS path, substring(t, length(regexp_extract(t, '(?s)^([^?#]*)', 1)) + 1) AS rest,
                   CASE WHEN NOT contains(coalesce(u, ''), '://') THEN CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN 'whole' END
                        WHEN t LIKE '//%' THEN 'host' WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN 'whole'
                        WHEN t LIKE '#%' OR regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
                        WHEN t LIKE '?%' THEN 'query' WHEN t LIKE '/%' THEN 'root' ELSE 'folder' END AS kind
            FROM plain
        ), dots AS (
            SELECT k, CASE kind WHEN 'root' THEN path ELSE regexp_replace(own, '[^/]*$', '') || path END AS i, '' AS o FROM based WHERE kind IN ('root', 'folder')
            UNION ALL
            SELECT k, substring(i, length(seg) + 2), CASE seg WHEN '..' THEN regexp_replace(o, '/[^/]*$', '') WHEN '.' THEN o ELSE o || '/' || seg END
                   || CASE WHEN seg IN ('.', '..') AND length(i) = length(seg) + 1 THEN '/' ELSE '' END
            FROM (SELECT k, i, o, regexp_extract(i, '(?s)^/([^/]*)', 1) AS seg FROM dots WHERE i <> '')
        ), whole AS (
            SELECT u, CASE kind WHEN 'host' THEN regexp_extract(u, '(?s)^(.*?):', 1) || ':' || t WHEN 'whole' THEN t WHEN 'query' THEN base || own || t ELSE base || dots.o || rest END AS t
            FROM based LEFT JOIN dots ON dots.k = based.k AND dots.i = '' WHERE kind IS NOT NULL
        ), urls AS (SELECT url FROM pages UNION SELECT t FROM whole),
        parts AS MATERIALIZED (
            SELECT url, CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
                   CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
                   regexp_extract(url, '(?s)^[^?#]*(\?[^#]*)', 1) AS query
            FROM urls WHERE url IS NOT NULL
        ), nodes AS MATERIALIZED (SELECT url, host, path, CASE WHEN contains(url, '://') THEN host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS node FROM parts),
        fits AS MATERIALIZED (
            SELECT node, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
            FROM nodes JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) WHERE node IS NOT NULL GROUP BY node
        ), edges AS MATERIALIZED (
            SELECT a.node AS a, b.node AS b FROM whole JOIN nodes a ON a.url = whole.u JOIN nodes b ON b.url = whole.t WHERE a.node <> b.node
            UNION SELECT b.node, a.node FROM whole JOIN nodes a ON a.url = whole.u JOIN nodes b ON b.url = whole.t WHERE a.node <> b.node
        ), reach AS (
            SELECT a AS node, a AS other FROM edges UNION SELECT reach.node, edges.b FROM reach JOIN edges ON edges.a = reach.other
        ), spread AS (
            SELECT reach.node FROM reach JOIN fits ON fits.node = reach.other GROUP BY reach.node HAVING bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow')
        )
        SELECT p.page_id, coalesce(n.host, '') AS host, coalesce(n.path, '') AS path, f.rule,
               coalesce(f.verdict, CASE WHEN s.node IS NOT NULL THEN 'block' END, 'allow') AS verdict
        FROM pages p LEFT JOIN nodes n ON n.url = p.url LEFT JOIN fits f ON f.node = n.node LEFT JOIN spread s ON s.node = n.node
    """,
    "op6_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), windows AS MATERIALIZED (
            SELECT doc_id, p, md5(array_to_string(w[p : p + 49], ' ')) AS h
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)
        ), firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
        gone AS MATERIALIZED (
            SELECT DISTINCT doc_id, q FROM (
                SELECT doc_id, unnest(range(p, p + 50)) AS q FROM windows JOIN firsts USING (h) WHERE first < doc_id
            )
        ), kept AS (
            SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.q) AS t
            FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d) words
            LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.q = words.q WHERE gone.q IS NULL GROUP BY words.doc_id
        ), lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
        FROM d LEFT JOIN lost ON lost.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
    """,
    "op4_minhash_near_dedup": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS MATERIALIZED (
            SELECT DISTINCT doc_id, array_to_string(w[p : p + least(4, len(w)) - 1], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM d WHERE len(w) > 0)
        ), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        links AS MATERIALIZED (
            SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
            JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
            GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 80 * (nx.n + ny.n - count(*))
        ), reach AS (
            SELECT doc_id, doc_id AS other FROM documents
            UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
        )
        SELECT reach.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(other) AS component_id, reach.doc_id = min(other) AS kept
        FROM reach LEFT JOIN n ON n.doc_id = reach.doc_id GROUP BY reach.doc_id, n.n
    """,
    "op1_benchmark_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), bw AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS window_text
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)
        ), sizes AS (SELECT DISTINCT n FROM bw),
        dw AS (
            SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS window_text
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)
        ), hits AS (
            SELECT doc_id, p, n, item_id FROM dw JOIN bw USING (n, window_text)
        ), covered AS (
            SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hits)) GROUP BY doc_id
        ), listed AS (
            SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
        )
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
    """,
    "op12_merkle_manifest": """
        WITH RECURSIVE d AS (
            SELECT *, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                lambda x, y: list_reduce(list_concat([xor(x, y)], range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))) AS c FROM documents
        ), f AS (SELECT doc_id, lang, n_chars, xor(c, 4294967295) % 7 = 0 AND n_chars IS NOT NULL AS tampered,
                coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                coalesce(strlen(text) || ':' || text, '-') AS tail FROM d
        ), leaves AS MATERIALIZED (
            SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
                   CASE WHEN tampered THEN sha256(head || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || tail) END AS changed FROM f
        ), placed AS MATERIALIZED (
            SELECT *, coalesce('1' || lang, '0') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
        ), trees AS (
            SELECT g, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY g
            UNION ALL
            SELECT g, level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM trees WHERE len(nodes) > 1
        ), subroots AS MATERIALIZED (SELECT g, nodes[1] AS subroot, level AS height, row_number() OVER (ORDER BY g) - 1 AS place FROM trees WHERE len(nodes) = 1),
        top AS (
            SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subroots
            UNION ALL
            SELECT level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM top WHERE len(nodes) > 1
        ), flat AS MATERIALIZED (
            SELECT g, level, unnest(range(0, len(nodes))) AS k, unnest(nodes) AS h FROM trees UNION ALL SELECT 'top', level, unnest(range(0, len(nodes))), unnest(nodes) FROM top
        ), steps AS MATERIALIZED (
            SELECT p.g, p.pos, n.step, CASE WHEN n.step < height THEN p.g ELSE 'top' END AS tree, CASE WHEN n.step < height THEN n.step ELSE n.step - height END AS level,
                   CASE WHEN n.step < height THEN p.pos >> n.step ELSE s.place >> (n.step - height) END AS own
            FROM placed p JOIN subroots s ON s.g = p.g, (SELECT max(level) AS top_height FROM top), LATERAL (SELECT unnest(range(0, s.height + top_height)) AS step) n
        ), beside AS MATERIALIZED (
            SELECT s.g, s.pos, s.step, s.own % 2 AS is_right, f.h FROM steps s LEFT JOIN flat f ON f.g = s.tree AND f.level = s.level AND f.k = xor(s.own, 1)
        ), proofs AS (SELECT g, pos, string_agg(h, '' ORDER BY step) AS proof FROM beside GROUP BY g, pos),
        folds AS (
            SELECT g, pos, 0 AS step, coalesce(changed, leaf) AS h FROM placed
            UNION ALL
            SELECT f.g, f.pos, f.step + 1, sha256(CASE WHEN b.is_right = 1 THEN coalesce(b.h, '') || f.h ELSE f.h || coalesce(b.h, '') END) FROM folds f JOIN beside b ON b.g = f.g AND b.pos = f.pos AND b.step = f.step
        ), folded AS (SELECT g, pos, arg_max(h, step) AS h FROM folds GROUP BY g, pos)
        SELECT p.doc_id, p.leaf, s.subroot, (SELECT h FROM flat WHERE g = 'top' ORDER BY level DESC LIMIT 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256, f.h AS folded_root,
               f.h = (SELECT h FROM flat WHERE g = 'top' ORDER BY level DESC LIMIT 1) AS verified
        FROM placed p JOIN subroots s ON s.g = p.g LEFT JOIN proofs r ON r.g = p.g AND r.pos = p.pos JOIN folded f ON f.g = p.g AND f.pos = p.pos
    """,
}
