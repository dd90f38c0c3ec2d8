"""Registered queries of reports, history, dashboards and jobs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vendorlens.functions import scalars
from vendorlens.operators import analyst, dashboard, evidence, reports, scoring
from vendorlens.plans.risk_queries import _DOC_SCORES, _signals, query
from vendorlens.sources import adapters as A
from vendorlens.streaming import jobs, lifecycle
from vendorlens.streaming import signals as streams


@query(r"""WITH c AS (SELECT conv_id, turn, lower(CASE turn % 3 WHEN 0 THEN 'Please Scan scan ' || text WHEN 1 THEN 'INVESTIGATE recheck ' || text ELSE text END) AS t FROM conversations WHERE text IS NOT NULL)
    SELECT conv_id, turn, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?s)^(.*?)scan ', '\1'), '(?s)^(.*?)investigate ', '\1'), '(?s)^(.*?)check ', '\1'), '^\s+|\s+$', '', 'g')) AS command FROM c""")
def command_normalise(spark, sf_dir):
    k = F.col("turn") % 3
    text = F.when(k == 0, F.concat(F.lit("Please Scan scan "), "text")).when(k == 1, F.concat(F.lit("INVESTIGATE recheck "), "text")).otherwise(F.col("text"))
    return A.read(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.md5(scalars.command_text(text).cast("binary")).alias("command"))


def _requests(spark, sf_dir):
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, F.concat(F.lit("\t "), "c_name", F.lit(" "))).when(k == 1, F.lit(" \t")).when(k == 2, F.col("c_name"))
    return A.read(spark, sf_dir, "customer").select(name.alias("vendor_name"), F.col("c_custkey").cast("string").alias("job_id"), F.when(k == 2, "DE").alias("language"))


@query("""SELECT CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 2 THEN c_name ELSE '' END AS vendor_name, c_custkey::VARCHAR AS job_id, CASE c_custkey % 4 WHEN 2 THEN 'DE' ELSE 'EN' END AS language, c_custkey % 4 IN (0, 2) AS valid FROM customer""")
def clean_requests(spark, sf_dir):
    valid, rejected = reports.clean_requests(_requests(spark, sf_dir))
    return valid.withColumn("valid", F.lit(True)).unionByName(rejected.withColumn("valid", F.lit(False)))


def _outputs(spark, sf_dir):
    d = A.evidence_text(spark, sf_dir)
    fields = F.to_json(F.struct(F.col("text").alias("executive_summary"), F.array("text", F.lit("b")).alias("key_findings"), F.lit("Improving").alias("risk_trajectory")))
    k = F.col("doc_id") % 5
    empty = F.to_json(F.struct(F.lit("").alias("executive_summary"), F.lit("Legal").alias("primary_risk_category")))
    raw = F.when(k == 0, fields).when(k == 1, F.concat(F.lit("```json\n"), fields, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here it is: "), fields, F.lit(" Done."))).when(k == 3, F.lit("no json { here")).otherwise(empty)
    return d.select("doc_id", F.col("source").alias("vendor_name"), "text", raw.alias("raw_output"))


@query(f"""WITH {A.TEXT_SQL} SELECT doc_id, md5(CASE WHEN doc_id % 5 < 3 THEN text WHEN doc_id % 5 = 3 THEN 'missing' ELSE '' END) AS executive_summary,
    CASE WHEN doc_id % 5 < 3 THEN 'Improving' ELSE 'Stable' END AS risk_trajectory, CASE WHEN doc_id % 5 = 4 THEN 'Legal' ELSE 'Operational' END AS primary_risk_category,
    md5(CASE WHEN doc_id % 5 < 3 THEN text || '|b' ELSE '' END) AS key_findings FROM f1""")
def rescue_parse(spark, sf_dir):
    p = reports.parse_reports(_outputs(spark, sf_dir))
    get, digest = reports.field, lambda c: F.md5(c.cast("binary"))
    return p.select(
        "doc_id", digest(get("executive_summary", "string", F.lit("missing"))).alias("executive_summary"), get("risk_trajectory", "string", F.lit("Stable")).alias("risk_trajectory"),
        get("primary_risk_category", "string", F.lit("Operational")).alias("primary_risk_category"), digest(F.array_join(get("key_findings", "array<string>", F.array().cast("array<string>")), "|")).alias("key_findings"),
    )


@query(f"""WITH {A.TEXT_SQL}, p AS (SELECT doc_id, text, CASE WHEN doc_id % 5 < 3 THEN text ELSE '' END AS s, CASE WHEN doc_id % 5 < 3 THEN text || ' b' ELSE '' END AS f FROM f1)
    SELECT doc_id, md5(CASE WHEN regexp_replace(s, '^\\s+|\\s+$', '', 'g') = '' OR length(s || ' ' || f) < 50 THEN text ELSE s || ' ' || f END) AS scored_text FROM p""")
def scoring_text(spark, sf_dir):
    p = reports.parse_reports(_outputs(spark, sf_dir))
    empty = F.array().cast("array<string>")
    chosen = reports.scoring_text(reports.field("executive_summary", "string", F.lit("")), reports.field("key_findings", "array<string>", empty), F.col("text"))
    return p.select("doc_id", F.md5(chosen.cast("binary")).alias("scored_text"))


_COUNTS_SQL = f"x AS ({_DOC_SCORES}), n AS (SELECT x.*, source AS vendor_name, text, doc_id % 9 AS source_count, trunc(disruption_probability * 100)::INTEGER AS pct FROM f1 JOIN x USING (doc_id))"


def _counted(spark, sf_dir):
    found = scoring.scored_groups(_signals(spark, sf_dir), "doc_id")
    rows = _outputs(spark, sf_dir).join(found, "doc_id", "left")
    return scoring.with_no_signals(rows).withColumn("source_count", F.col("doc_id") % 9)


@query(f"""WITH {A.SIGNALS_SQL}, {_COUNTS_SQL} SELECT doc_id, vendor_name || ' was assessed from public evidence. ' || source_count || ' sources were gathered. ' || n_signals || ' risk indicators in ' || n_categories
    || ' categories were detected. The overall risk level is ' || risk_level || ' with a disruption probability of ' || pct || '%.' AS executive_summary, vendor_name || ': ' || risk_level || ' risk from ' || source_count || ' sources.' AS risk_headline, pct AS percent FROM n""")
def default_narrative(spark, sf_dir):
    told = reports.narrative()
    rows = reports.parse_reports(_counted(spark, sf_dir))
    return rows.select("doc_id", told["executive_summary"].alias("executive_summary"), told["risk_headline"].alias("risk_headline"), reports.percent(F.col("disruption_probability")).alias("percent"))


def _assembled(spark, sf_dir):
    rows = reports.parse_reports(_counted(spark, sf_dir)).withColumns({"vendor_id": F.col("doc_id"), "scraped_chars": F.lit(0), "sources": F.lit(None).cast(reports.SOURCES_JSON)})
    return reports.assemble_reports(rows, created_at=F.lit("2024-01-01").cast("timestamp"))


@query(f"""WITH {A.SIGNALS_SQL}, {_COUNTS_SQL}, g AS (SELECT doc_id, count(DISTINCT category) AS c FROM sig GROUP BY doc_id) SELECT doc_id AS vendor_id, vendor_name, risk_score, risk_level, confidence_score, disruption_probability,
    CASE WHEN doc_id % 5 = 4 THEN 'Legal' ELSE 'Operational' END AS primary_risk_category, CASE WHEN doc_id % 5 < 3 THEN 'Improving' ELSE 'Stable' END AS risk_trajectory, 'Near-term' AS time_horizon,
    coalesce(c, 0)::INTEGER AS n_groups, CASE WHEN doc_id % 5 < 3 THEN 2 ELSE 5 END::INTEGER AS n_findings, 3::INTEGER AS n_actions, source_count::VARCHAR AS raw_sources, '0' AS raw_chars, 'completed' AS status FROM n LEFT JOIN g USING (doc_id)""")
def report_assemble(spark, sf_dir):
    keep = ["vendor_id", "vendor_name", "risk_score", "risk_level", "confidence_score", "disruption_probability", "primary_risk_category", "risk_trajectory", "time_horizon", "status"]
    raw = lambda k: F.get_json_object("raw_intelligence", f"$.{k}")
    return _assembled(spark, sf_dir).select(
        *keep, F.size("signals").alias("n_groups"), F.size("key_findings").alias("n_findings"), F.size("recommended_actions").alias("n_actions"),
        raw("search_results_count").alias("raw_sources"), raw("scraped_content_chars").alias("raw_chars"),
    )


@query(f"""WITH {A.SIGNALS_SQL}, {_COUNTS_SQL} SELECT doc_id AS vendor_id, CASE WHEN doc_id % 5 = 4 THEN 'Legal' ELSE 'Operational' END AS primary_risk_category, vendor_name || ': ' || risk_level || ' risk from ' || source_count || ' sources.' AS risk_headline,
    CASE WHEN doc_id % 5 < 3 THEN 'Improving' ELSE 'Stable' END AS risk_trajectory, 'Near-term' AS time_horizon, md5(CASE WHEN doc_id % 5 < 3 THEN text || '|b' ELSE '' END) AS key_findings, 0::INTEGER AS n_actions FROM n""")
def report_round_trip(spark, sf_dir):
    """Reports assembled, and their headline fields rebuilt from the raw part alone."""
    stored = _assembled(spark, sf_dir).select("vendor_id", "vendor_name", "signals", "created_at", F.try_parse_json("raw_intelligence").alias("raw"))
    keep = ["vendor_id", "primary_risk_category", "risk_headline", "risk_trajectory", "time_horizon"]
    return reports.rebuild_history(stored).select(*keep, F.md5(F.array_join("key_findings", "|").cast("binary")).alias("key_findings"), F.size("recommended_actions").alias("n_actions"))


@query("""WITH old AS (SELECT s_suppkey AS vendor_id, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0) SELECT name, vendor_id AS known_id, false AS is_new FROM old UNION ALL SELECT DISTINCT s_name, NULL, true FROM supplier WHERE s_name NOT IN (SELECT name FROM old)""")
def vendor_upsert(spark, sf_dir):
    s = A.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("vendor_id"), F.col("s_name").alias("name"))
    old = s.where("vendor_id % 2 = 0")
    top = old.agg(F.max("vendor_id").alias("top"))
    new = F.col("vendor_id") > F.col("top")
    return reports.upsert_vendors(old, s.select("name")).crossJoin(F.broadcast(top)).select("name", F.when(~new, F.col("vendor_id")).alias("known_id"), new.alias("is_new"))


@query(f"WITH {A.REPORTS_SQL} SELECT reports.report_id, reports.vendor_id, risk_score FROM reports WHERE report_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL AND l_quantity > 45)")
def report_delete(spark, sf_dir):
    ids = A.read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("report_id"))
    return reports.delete_reports(A.reports(spark, sf_dir), ids).select("report_id", "vendor_id", "risk_score")


@query(f"WITH {A.REPORTS_SQL} SELECT report_id, vendor_name, risk_level FROM reports WHERE report_id = 77")
def report_lookup(spark, sf_dir):
    return reports.by_id(A.reports(spark, sf_dir), 77).select("report_id", "vendor_name", "risk_level")


@query(f"WITH {A.REPORTS_SQL} SELECT report_id, CASE WHEN report_id % 3 = 0 THEN 0 ELSE risk_score END::INTEGER AS risk_score, CASE WHEN report_id % 3 = 1 THEN 'LOW' ELSE risk_level END AS risk_level, 0.0::DOUBLE AS confidence_score, '' AS executive_summary, 'completed' AS status FROM reports")
def report_defaults(spark, sf_dir):
    r = A.reports(spark, sf_dir).withColumns({"risk_score": F.when(F.col("report_id") % 3 != 0, F.col("risk_score")), "risk_level": F.when(F.col("report_id") % 3 != 1, F.col("risk_level"))})
    return reports.with_defaults(r).select("report_id", "risk_score", "risk_level", "confidence_score", "executive_summary", "status")


@query(f"WITH {A.REPORTS_SQL} SELECT report_id, vendor_name, risk_score, created_at::VARCHAR AS created_at FROM reports ORDER BY reports.created_at DESC, report_id DESC LIMIT 20")
def recent_reports(spark, sf_dir):
    return reports.recent(A.reports(spark, sf_dir), 20).select("report_id", "vendor_name", "risk_score", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query(f"WITH {A.REPORTS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY created_at DESC, report_id DESC) AS r FROM reports) SELECT vendor_id, report_id, risk_score, risk_level FROM p WHERE r = 1")
def latest_report(spark, sf_dir):
    return reports.latest_per_vendor(A.reports(spark, sf_dir)).select("vendor_id", "report_id", "risk_score", "risk_level")


@query(f"""WITH {A.REPORTS_SQL}, p AS (SELECT *, lag(risk_score) OVER (PARTITION BY vendor_id ORDER BY created_at, report_id) AS previous_score FROM reports)
    SELECT report_id, vendor_id, previous_score, CASE WHEN risk_level = 'CRITICAL' AND risk_score >= previous_score THEN 'Critical' WHEN risk_score - previous_score <= -5 THEN 'Improving' WHEN risk_score - previous_score >= 5 THEN 'Deteriorating' ELSE 'Stable' END AS trajectory FROM p""")
def trajectory(spark, sf_dir):
    return analyst.trajectory(A.reports(spark, sf_dir)).select("report_id", "vendor_id", "previous_score", "trajectory")


@query(f"""WITH {A.REPORTS_SQL}, s AS (SELECT * FROM reports ORDER BY created_at DESC, report_id DESC LIMIT 100), c AS (SELECT report_id FROM s WHERE risk_level = 'CRITICAL' ORDER BY created_at DESC, report_id DESC LIMIT 3)
    SELECT count(*) AS total, count(*) FILTER (risk_level = 'CRITICAL') AS critical, count(*) FILTER (risk_level = 'HIGH') AS high, count(*) FILTER (risk_level = 'MEDIUM') AS medium, count(*) FILTER (risk_level = 'LOW') AS low,
           round(avg(risk_score), 6) AS average, (SELECT string_agg(report_id, ',' ORDER BY r.created_at DESC, report_id DESC) FROM reports r WHERE report_id IN (SELECT report_id FROM c)) AS recent_critical FROM s""")
def dashboard_stats(spark, sf_dir):
    s = dashboard.stats(A.reports(spark, sf_dir))
    level = lambda n: F.col("distribution")[n].alias(n.lower())
    return s.select("total", *[level(n) for n, _ in scalars.LEVELS], F.round("average", 6).alias("average"), F.array_join(F.transform("recent_critical", lambda x: x.report_id.cast("string")), ",").alias("recent_critical"))


@query(f"WITH {A.REPORTS_SQL} SELECT count(*) AS total, count(*) FILTER (risk_level = 'CRITICAL') AS critical, count(*) FILTER (risk_level = 'HIGH') AS high, floor(avg(risk_score) + 0.5)::BIGINT AS average FROM reports")
def headline_tiles(spark, sf_dir):
    return dashboard.tiles(A.reports(spark, sf_dir))


@query(f"WITH {A.REPORTS_SQL} SELECT report_id, vendor_name, risk_score, disruption_probability FROM reports ORDER BY risk_score DESC, disruption_probability DESC, vendor_name, report_id LIMIT 20")
def leaderboard(spark, sf_dir):
    return dashboard.leaderboard(A.reports(spark, sf_dir)).select("report_id", "vendor_name", "risk_score", "disruption_probability")


@query(f"""WITH {A.REPORTS_SQL} SELECT risk_level, vendor_id, CASE risk_level WHEN 'CRITICAL' THEN '#FF2D55' WHEN 'HIGH' THEN '#FF6B00' WHEN 'MEDIUM' THEN '#F5A623' ELSE '#00E87A' END AS colour,
    CASE risk_level WHEN 'CRITICAL' THEN '#FF2D55' WHEN 'HIGH' THEN '#FF9500' WHEN 'MEDIUM' THEN '#FFCC00' ELSE '#34C759' END AS engine_colour, count(*) AS n FROM reports GROUP BY risk_level, vendor_id""")
def level_colour(spark, sf_dir):
    r = A.reports(spark, sf_dir).groupBy("risk_level", "vendor_id").agg(F.count("*").alias("n"))
    return r.withColumns({"colour": scalars.level_colour(F.col("risk_level")), "engine_colour": scalars.level_colour(F.col("risk_level"), "engine")})


@query(f"""WITH {A.REPORTS_SQL} SELECT report_id, CASE WHEN risk_score >= 70 THEN 'CRITICAL' WHEN risk_score >= 50 THEN 'HIGH' WHEN risk_score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS level, floor(disruption_probability * 100 + 0.5)::INTEGER AS percent,
    replace(regexp_replace(lower(vendor_name), '^\\s+|\\s+$', '', 'g'), ' ', '') || '.com' AS domain FROM reports""")
def sql_functions(spark, sf_dir):
    """The functions of the session's SQL."""
    scalars.register(spark)
    return A.reports(spark, sf_dir).selectExpr("report_id", "risk_level(risk_score) AS level", "risk_percent(disruption_probability) AS percent", "vendor_domain(vendor_name) AS domain")


def _sources(n):
    """So many sources; null for none."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.struct(F.concat(F.lit("https://s.example.com/"), i.cast("string")).alias("url"), F.lit("t").alias("title"))))


def _grouped(spark, sf_dir):
    return scoring.grouped_arrays(scoring.signal_groups(_signals(spark, sf_dir), "doc_id"), "doc_id").withColumnRenamed("doc_id", "report_id")


@query(f"""WITH {A.SIGNALS_SQL}, ind AS (SELECT doc_id, category, arg_min(indicator, ord) AS detail, upper(arg_max(severity, weight * 1000 - ord)) AS level, sum(weight) AS w, min(ord) AS o FROM sig GROUP BY doc_id, category),
    own AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, o) - 1 AS position, upper(category[1]) || category[2:] || ' risk detected' AS message, detail, level, level IN ('CRITICAL', 'HIGH') AS fresh FROM ind),
    n AS (SELECT doc_id, count(*) AS n FROM own GROUP BY doc_id)
    SELECT doc_id AS report_id, position::INTEGER AS position, message, detail, level, fresh FROM own
    UNION ALL SELECT doc_id, n::INTEGER, 'Regional news signal', 'Live scan complete', 'MEDIUM', false FROM n WHERE n < 4
    UNION ALL SELECT doc_id, n::INTEGER + 1, 'Operational monitor active', 'Monitor watching', 'LOW', false FROM n WHERE n < 4""")
def alerts(spark, sf_dir):
    return dashboard.alerts(_grouped(spark, sf_dir))


@query(f"WITH {A.SIGNALS_SQL} SELECT doc_id AS report_id, (doc_id % 4)::INTEGER AS n_sources, count(DISTINCT category)::INTEGER AS n_signals FROM sig GROUP BY doc_id")
def report_counters(spark, sf_dir):
    return dashboard.report_counts(_grouped(spark, sf_dir).withColumn("sources", _sources(F.col("report_id") % 4)))


@query(f"""WITH {A.SIGNALS_SQL}, ind AS (SELECT doc_id, category, indicator, min(ord) AS o, row_number() OVER (PARTITION BY doc_id, category ORDER BY min(ord)) AS r FROM sig GROUP BY doc_id, category, indicator),
    c AS (SELECT doc_id, category, string_agg(indicator, '|' ORDER BY o) AS t FROM ind WHERE r <= 3 GROUP BY doc_id, category)
    SELECT doc_id AS report_id, upper(category[1]) || category[2:] AS category, t AS indicators, least(6, doc_id % 9)::INTEGER AS n_sources FROM c""")
def report_cards(spark, sf_dir):
    shown = dashboard.cards(_grouped(spark, sf_dir).withColumn("sources", _sources(F.col("report_id") % 9)))
    return shown.select("report_id", F.explode("signals").alias("s"), F.coalesce(F.size("sources"), F.lit(0)).alias("n_sources")).select("report_id", "s.category", F.array_join("s.indicators", "|").alias("indicators"), "n_sources")


@query("""WITH u AS (SELECT user_id::VARCHAR AS job_id, (count(*) % 12)::INTEGER AS search_calls, round(sum(value) / 100, 4) AS model_cost FROM events GROUP BY user_id)
    SELECT job_id, search_calls, model_cost, least(100.0, search_calls / 10 * 100)::DOUBLE AS query_percent, least(100.0, search_calls / 10 * 100) > 80 AS flagged, CASE WHEN model_cost < 1 THEN 'OPTIMAL' WHEN model_cost < 2.5 THEN 'NORMAL' ELSE 'ELEVATED' END AS cost_class FROM u""")
def governance(spark, sf_dir):
    u = A.read(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("job_id")).agg((F.count("*") % 12).cast("int").alias("search_calls"), F.round(F.sum("value") / 100, 4).alias("model_cost"))
    return dashboard.governance(u)


def _labels_sql() -> str:
    return ", ".join(f"('{lang}', '{k}', '{t}')" for lang, texts in dashboard.LABELS.items() for k, t in zip(dashboard.LABEL_KEYS, texts, strict=True))


_LANGS, _HORIZONS, _TRAJECTORIES = ["EN", "ZH", "AR", "BN", "DE", "JA", "XX"], ["Short-term", "Medium", "mid", "Long haul", "Near-term", ""], ["Improving", "deteriorates", "Stable", "Critical", ""]


@query(f"""WITH l(lang, key, text) AS (VALUES {_labels_sql()}), r AS (SELECT o_orderkey AS report_id, {_LANGS!r}[o_orderkey % 7 + 1] AS language, {_HORIZONS!r}[o_orderkey % 6 + 1] AS h, {_TRAJECTORIES!r}[o_orderkey % 5 + 1] AS t FROM orders),
    k AS (SELECT *, CASE WHEN lower(h) LIKE '%short%' THEN 'shortTerm' WHEN lower(h) LIKE '%mid%' OR lower(h) LIKE '%medium%' THEN 'midTerm' WHEN lower(h) LIKE '%long%' THEN 'longTerm' END AS hk,
          CASE WHEN lower(t) LIKE '%improv%' THEN 'improving' WHEN lower(t) LIKE '%deteriorat%' THEN 'deteriorating' WHEN lower(t) LIKE '%stabl%' THEN 'stable' END AS tk, CASE WHEN language IN ('ZH', 'AR', 'BN', 'DE', 'JA') THEN language END AS lang FROM r)
    SELECT report_id, language, coalesce(a.text, nullif(h, ''), '—') AS time_horizon, coalesce(b.text, nullif(t, ''), '—') AS risk_trajectory FROM k LEFT JOIN l a ON a.lang = k.lang AND a.key = hk LEFT JOIN l b ON b.lang = k.lang AND b.key = tk""")
def localise(spark, sf_dir):
    of = lambda xs: F.array(*[F.lit(x) for x in xs])[(F.col("o_orderkey") % len(xs)).cast("int")]
    r = A.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report_id"), of(_LANGS).alias("language"), of(_HORIZONS).alias("time_horizon"), of(_TRAJECTORIES).alias("risk_trajectory"))
    return dashboard.localise(r, dashboard.label_dict(spark)).select("report_id", "language", "time_horizon", "risk_trajectory")


@query(f"""WITH {A.TEXT_SQL} SELECT doc_id AS report_id, CASE doc_id % 3 WHEN 0 THEN 'Legal' WHEN 1 THEN 'Financial-Risk' ELSE 'Cybersecurity' END AS primary_risk_category, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Near-term' END AS time_horizon,
    md5(CASE WHEN doc_id % 3 = 0 THEN text ELSE source || ' risk profile' END) AS risk_headline, CASE WHEN doc_id % 3 = 0 THEN 'a|b' ELSE '' END AS key_findings FROM f1""")
def history_rebuild(spark, sf_dir):
    d = A.evidence_text(spark, sf_dir)
    k = F.col("doc_id") % 3
    raw = F.when(k == 0, F.to_json(F.struct(F.lit("Legal").alias("primary_risk_category"), F.lit("").alias("time_horizon"), F.col("text").alias("risk_headline"), F.array(F.lit("a"), F.lit("b")).alias("key_findings")))).otherwise("{}")
    sig = F.when(k == 1, '[{"category":"financial-risk","severity":"HIGH","indicators":["x"],"weight":20}]').otherwise("[]")
    legacy = d.select(F.col("doc_id").alias("report_id"), F.col("source").alias("vendor_name"), sig.alias("signals"), F.lit("[]").alias("sources"), raw.alias("raw_intelligence"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    out = reports.rebuild_history(reports.decode_legacy(legacy))
    return out.select("report_id", "primary_risk_category", "time_horizon", F.md5(F.col("risk_headline").cast("binary")).alias("risk_headline"), F.array_join("key_findings", "|").alias("key_findings"))


@query("""SELECT doc_id, coalesce(source, '') AS vendor_name, coalesce(nullif(CASE WHEN doc_id % 4 > 0 THEN lang END, ''), 'en') AS language, 'documents' AS source_type, md5(text) AS content, '2024-01-01' AS fetched FROM documents""")
def evidence_landing(spark, sf_dir):
    """Raw content in the shape of the landing table; the document's number is its url here."""
    d = A.read(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("vendor_name"), F.col("doc_id").cast("string").alias("url"), F.when(F.col("doc_id") % 4 > 0, F.col("lang")).alias("language"), F.col("text").alias("content"))
    rows = evidence.landed(d, source_type="documents", fetched_at=F.lit("2024-01-01").cast("timestamp"))
    return rows.select(F.col("url").cast("long").alias("doc_id"), "vendor_name", "language", "source_type", F.md5(F.col("content").cast("binary")).alias("content"), F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched"))


# --- jobs


@query(f"""WITH {A.JOBS_SQL}, p AS (SELECT job_id, arg_max(row(stage, message, progress), (ts, progress, stage, message)) AS p FROM je WHERE status = 'running' GROUP BY job_id), t AS (SELECT job_id, arg_max(row(stage, message, progress, error), (ts, message)) AS t FROM je WHERE status = 'failed' GROUP BY job_id)
    SELECT job_id, CASE WHEN t IS NULL THEN 'running' ELSE 'failed' END AS status, coalesce(p[1], t[1]) AS stage, coalesce(p[2], t[2]) AS message, coalesce(p[3], 0)::INTEGER AS progress, t[4] AS error FROM p FULL JOIN t USING (job_id)""")
def job_state(spark, sf_dir):
    return jobs.job_state(A.job_events(spark, sf_dir))


@query(f"""WITH {A.JOBS_SQL}, p AS (SELECT job_id, max(ts) AS last, arg_max(row(stage, message, progress), (ts, progress, stage, message)) AS p FROM je WHERE status = 'running' GROUP BY job_id),
    t AS (SELECT job_id, arg_max(row(error, stage, message, progress), (ts, error, progress, stage, message)) AS t FROM je WHERE status = 'failed' GROUP BY job_id),
    j AS (SELECT job_id, t IS NULL AS open, t IS NULL AND (SELECT max(ts) FROM je) - last >= INTERVAL 1 DAY AS silent, coalesce(p[1], t[2]) AS stage, coalesce(p[3], t[4], 0)::INTEGER AS progress, t[1] AS error FROM p FULL JOIN t USING (job_id))
    SELECT job_id, CASE WHEN silent OR NOT open THEN 'failed' ELSE 'running' END AS status, stage, progress, CASE WHEN silent THEN 'no progress before the timeout' ELSE error END AS error FROM j""")
def job_outcome(spark, sf_dir):
    return lifecycle.job_outcome(A.job_events(spark, sf_dir), timeout_seconds=86_400).select("job_id", "status", "stage", "progress", "error")


@query(f"""WITH {A.JOBS_SQL} SELECT job_id, stage, epoch_us(ts) AS ts_us, epoch_us(lead(ts) OVER (PARTITION BY job_id ORDER BY ts, progress NULLS FIRST, stage)) - epoch_us(ts) AS micros FROM je""")
def stage_durations(spark, sf_dir):
    d = jobs.stage_durations(A.job_events(spark, sf_dir))
    return d.select("job_id", "stage", F.unix_micros("ts").alias("ts_us"), "micros")


@query(f"""WITH {A.JOBS_SQL}, d AS (SELECT stage, round(avg(micros) / 1e6, 3) AS mean_seconds FROM (SELECT stage, epoch_us(lead(ts) OVER (PARTITION BY job_id ORDER BY ts, progress NULLS FIRST, stage)) - epoch_us(ts) AS micros FROM je) GROUP BY stage),
    s AS (SELECT job_id, CASE WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'running' END AS status, coalesce(arg_max(stage, (ts, progress, stage, message)) FILTER (status = 'running'), 'failed') AS stage FROM je GROUP BY job_id)
    SELECT stage, status, count(*) AS jobs, any_value(mean_seconds) AS mean_seconds FROM s LEFT JOIN d USING (stage) GROUP BY stage, status""")
def job_funnel(spark, sf_dir):
    e = A.job_events(spark, sf_dir)
    return jobs.job_funnel(jobs.job_state(e), jobs.stage_durations(e))


@query(f"WITH {A.SIGNALS_SQL}, {A.DATED_SQL} SELECT date_trunc('day', ts)::TIMESTAMP::VARCHAR AS window_start, category, count(*) AS n_signals, sum(weight)::BIGINT AS total_weight FROM dsig GROUP BY ALL")
def daily_signal_window(spark, sf_dir):
    w = streams.window_counts(A.dated_signals(spark, sf_dir, _signals(spark, sf_dir)))
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "category", "n_signals", "total_weight")


@query("""WITH e AS (SELECT user_id, ts, ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS end_us, count(*) AS n_events FROM s GROUP BY user_id, k""")
def session_activity(spark, sf_dir):
    s = streams.activity_sessions(A.read(spark, sf_dir, "events"), "user_id")
    return s.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n_events")


@query(f"WITH {A.SIGNALS_SQL}, {A.DATED_SQL} SELECT source, upper(category[1]) || category[2:] || ' risk detected' AS message, upper(severity) AS risk_level, epoch_us(min(ts)) AS ts_us, arg_min(indicator, (ts, ord)) AS indicator FROM dsig GROUP BY source, category, severity")
def alert_once(spark, sf_dir):
    a = streams.alert_stream(A.dated_signals(spark, sf_dir, _signals(spark, sf_dir)), "source")
    return a.select("source", "message", "risk_level", F.unix_micros("ts").alias("ts_us"), F.col("triggered_signals")[0].alias("indicator"))


@query(f"WITH {A.SIGNALS_SQL} SELECT doc_id, risk_score, risk_level, confidence_score, disruption_probability FROM ({_DOC_SCORES}) WHERE n_signals > 0")
def row_level_scores(spark, sf_dir):
    """The streaming form of scoring, over the same rows as a batch."""
    return streams.stream_scores(streams.stream_signals(A.evidence_text(spark, sf_dir), ["doc_id"]), "doc_id")

