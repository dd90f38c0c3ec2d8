"""Rules and edge rows of the vendor-risk operators."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vendorlens.functions import scalars
from vendorlens.functions.lexicon import default_rows, lexicon, title_case
from vendorlens.operators import dashboard, evidence, reports, scoring, signals
from vendorlens.streaming import jobs
from vendorlens.streaming import signals as streams


def found(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    return signals.extract_signals(df, "k", "text", lexicon(spark, fold_keywords=options.pop("fold", False)), **options)


def scores(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    s = scoring.score_signals(found(spark, texts), "k", everyone=df)
    return {r.k: (r.risk_score, r.risk_level, r.confidence_score, r.disruption_probability) for r in s.collect()}


def test_lexicon_counts(spark):
    rows = default_rows()
    assert len(rows) == 102 and len({r[3] for r in rows}) == 101
    assert [r[0] for r in rows] == list(range(102))
    assert lexicon(spark).where("lower(keyword) <> keyword").count() == 4


def test_signals_edge_rows(spark):
    texts = ["", None, "an SEC enforcement case", "restructuring", "bond default", "Refined goods", "DATA BREACH"]
    got = {}
    for r in found(spark, texts).collect():
        got.setdefault(r.k, []).append((r.category, r.keyword))
    assert 0 not in got and 1 not in got and 2 not in got
    assert sorted(got[3]) == [("financial", "restructuring"), ("operational", "restructuring")]
    assert {k for _, k in got[4]} == {"default", "bond default"}
    assert got[5] == [("legal", "fine")] and got[6] == [("cybersecurity", "data breach")]
    assert found(spark, ["Refined goods"], word_boundary=True).count() == 0
    assert found(spark, ["an SEC enforcement case"], fold=True).count() == 1


def test_scores_edge_rows(spark):
    got = scores(spark, ["", "restructuring", "bond default", "fine penalty legal dispute", "bankruptcy shutdown data breach", None])
    assert got[0] == got[5] == (5, "LOW", 0.3, 0.05)
    assert got[1][:2] == (6, "LOW") and got[2][:2] == (55, "HIGH")
    assert got[3][:2] == (30, "MEDIUM")
    assert got[4] == (100, "CRITICAL", 0.4, 0.99)


def test_binary_rounding(spark):
    rows = [(s, c, j) for s in range(3, 101) for c in (False, True) for j in (False, True)]
    df = spark.createDataFrame(rows, "s int, c boolean, j boolean")
    got = df.select("s", "c", "j", scoring.disruption(F.col("s"), F.col("c"), F.col("j")).alias("d")).collect()
    for r in got:
        assert r.d == round(min(0.99, r.s / 100 * (1.0 + (0.2 if r.c else 0) + (0.15 if r.j else 0))), 2)


@pytest.mark.parametrize("score,level", [(24, "LOW"), (25, "MEDIUM"), (49, "MEDIUM"), (50, "HIGH"), (69, "HIGH"), (70, "CRITICAL")])
def test_levels(spark, score, level):
    assert spark.range(1).select(scalars.risk_level(F.lit(score)).alias("x")).first().x == level


def test_scores_do_not_depend_on_order(spark):
    words = [r[3] for r in default_rows()]
    rng = random.Random(5)
    texts = []
    for _ in range(20):
        some = rng.sample(words, 6)
        texts += [" | ".join(some), " | ".join(reversed(some))]
    got = scores(spark, texts)
    assert all(got[i] == got[i + 1] for i in range(0, 40, 2))


def test_strings(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(title_case(F.lit("write-down"))) == "Write-Down"
    assert one(scalars.vendor_domain(F.lit("\t Acme Corp "))) == "acmecorp.com" and one(scalars.vendor_domain(F.lit("A.io"))) == "a.io"
    assert one(scalars.command_text(F.lit("go scan scan x"))) == "go scan x" and one(scalars.command_text(F.lit("recheck x"))) == "rex"
    assert one(scalars.level_colour(F.lit("?"))) == "#00E87A"
    assert one(reports.percent(F.lit(0.29))) == 28
    assert one(scalars.first_filled(F.lit(""), F.lit("u"))) == "u" and one(scalars.first_filled(F.lit(None).cast("string"))) == ""
    scalars.register(spark)
    assert spark.sql("SELECT risk_level(70) AS a, vendor_domain('A B') AS b, risk_percent(0.5D) AS c").first() == ("CRITICAL", "ab.com", 50)


def test_serp_shapes(spark):
    hit = '{"title":"t","link":"","url":"u","description":"d"}'
    raw = [
        (1, f'{{"organic":[{hit}]}}'), (2, '{"organic":[],"body":"{\\"organic\\":[{\\"title\\":\\"b\\",\\"link\\":\\"l\\"}]}"}'), (3, '{"body":"{\\"x\\":1}"}'),
        (4, '{"body":"<article><h1>h</h1><a href=\\"z\\">q</a></article>"}'), (5, f'{{"body":{{"organic":[{hit}]}}}}'), (6, "{broken"), (7, '{"organic":[{"title":"","url":""}]}'), (8, None),
    ]
    df = spark.createDataFrame([(i, 1, 0, p) for i, p in raw], "response_id long, vendor_id long, query_id int, payload string")
    got = {r.response_id: (r.title, r.url, r.snippet) for r in evidence.normalise_serp(df).collect()}
    assert got == {1: ("t", "u", "d"), 2: ("b", "l", ""), 4: ("h", "z", ""), 5: ("t", "u", "d")}


def test_supplementary_urls(spark):
    cols = "vendor_id long, url string, source string"
    first = spark.createDataFrame([(1, "a", "s"), (1, "", "s")], cols)
    more = spark.createDataFrame([(1, "a", "x"), (1, None, "x"), (1, "b", "x"), (1, "b", "x"), (1, "", "x"), (2, "a", "x")], cols)
    got = sorted((r.vendor_id, "-" if r.url is None else r.url, r.source) for r in evidence.add_supplementary(first, more).collect())
    assert got == sorted([(1, "a", "s"), (1, "", "s"), (1, "-", "supplementary"), (1, "b", "supplementary"), (1, "b", "supplementary"), (2, "a", "supplementary")])


def test_parse_shapes(spark):
    raw = ['{"a":"x"}', '```json\n{"a":"x"}\n```', 'so {"a":"x"} it is', "nothing", '{"a":""}', '{"a":null}', None]
    df = reports.parse_reports(spark.createDataFrame(list(enumerate(raw)), "k int, raw_output string"))
    got = [r.a for r in df.select("k", reports.field("a", "string", F.lit("default")).alias("a")).orderBy("k").collect()]
    assert got == ["x", "x", "x", "default", "", None, "default"]


def test_upsert_keeps_rows(spark):
    old = spark.createDataFrame([(3, "a", "it")], "vendor_id long, name string, industry string")
    new = spark.createDataFrame([("a",), ("b",), ("b",), ("A",), (None,)], "name string")
    got = {r.name: (r.vendor_id, r.industry) for r in reports.upsert_vendors(old, new).collect()}
    assert got["a"] == (3, "it") and sorted(got) == ["A", "a", "b"] and sorted(got[n][0] for n in ("A", "b")) == [4, 5]
    empty = spark.createDataFrame([], old.schema)
    assert [r.vendor_id for r in reports.upsert_vendors(empty, new.where("name = 'b'")).collect()] == [1]


def test_append_read_delete(spark, tmp_path):
    path = str(tmp_path / "reports")
    day = lambda d: dt.datetime(2024, 1, d)
    rows = spark.createDataFrame([(1, 1, 10, day(1)), (2, 1, None, day(1)), (3, 2, 30, day(2)), (4, 2, 90, day(3))], "report_id long, vendor_id long, risk_score int, created_at timestamp")
    reports.append_reports(rows, path)
    assert reports.by_id(spark.read.parquet(path), 2).first().risk_score == 0
    ids = spark.createDataFrame([(2,), (3,), (9,)], "report_id long")
    assert reports.delete_stored(spark, path, ids) == 2
    assert sorted(r.report_id for r in spark.read.parquet(path).collect()) == [1, 4]
    assert reports.delete_stored(spark, path, ids) == 0


def test_dashboard_unknown_levels_and_empty(spark):
    cols = "report_id long, vendor_name string, risk_level string, risk_score int, created_at timestamp"
    at = dt.datetime(2024, 1, 1)
    s = dashboard.stats(spark.createDataFrame([(1, "a", "CRITICAL", 80, at), (2, "b", "ODD", 20, at)], cols)).first()
    assert s.total == 2 and s.distribution == {"CRITICAL": 1, "HIGH": 0, "MEDIUM": 0, "LOW": 0, "ODD": 1} and s.average == 50.0
    s = dashboard.stats(spark.createDataFrame([], cols)).first()
    assert (s.total, s.average, s.recent_critical) == (0, 0.0, [])


def test_alerts_filled_and_capped(spark):
    group = "array<struct<category:string,severity:string,indicators:array<string>,weight:bigint>>"
    df = spark.createDataFrame([(1, [("Legal", "high", ["x"], 1)]), (2, [("C", None, [], 1)] * 12), (3, None)], f"report_id long, signals {group}")
    got = {}
    for r in dashboard.alerts(df).orderBy("report_id", "position").collect():
        got.setdefault(r.report_id, []).append((r.detail, r.level, r.fresh))
    assert got[1][0] == ("x", "HIGH", True) and len(got[1]) == 3
    assert len(got[2]) == 10 and got[2][0] == ("C", "LOW", False)
    assert len(got[3]) == 2


def test_localise_falls_back(spark):
    df = spark.createDataFrame([("XX", "Short", "Stable"), ("DE", "Near-term", ""), ("DE", "mid", None)], "language string, time_horizon string, risk_trajectory string")
    got = {(r.language, r.time_horizon, r.risk_trajectory) for r in dashboard.localise(df, dashboard.label_dict(spark)).collect()}
    assert got == {("XX", "Short", "Stable"), ("DE", "Near-term", "—"), ("DE", "Mittelfristig", "—")}


def _events(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [
        ("a", at(1), "recon", "m1", 10, "running", None), ("a", at(3), "failed", "m3", None, "failed", "boom"), ("a", at(5), "agents", "m5", 65, "running", None),
        ("b", at(1), "recon", "m1", 10, "running", None), ("b", at(9), "complete", "m9", 100, "completed", None), ("c", at(2), "scraping", "m2", 35, None, None),
    ]
    return spark.createDataFrame(rows, "job_id string, ts timestamp, stage string, message string, progress int, status string, error string")


def test_job_state_stream_and_batch(spark, tmp_path):
    events = _events(spark)
    batch = sorted(map(tuple, jobs.job_state(events).collect()))
    assert [(r[0], r[1], r[2], r[4], r[5]) for r in batch] == [("a", "failed", "agents", 65, "boom"), ("b", "completed", "complete", 100, None), ("c", "running", "scraping", 35, None)]
    for i, job in enumerate("abc"):
        events.where(F.col("job_id") == job).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out: dict = {}
    q = jobs.job_state(jobs.job_events(spark, str(tmp_path / "in"))).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: out.update({r.job_id: tuple(r) for r in df.collect()})).start()
    q.awaitTermination(120)
    assert sorted(out.values()) == batch


def test_stream_scores_as_batch(spark, tmp_path):
    texts = [(i, f"v{i % 3}", dt.datetime(2024, 1, 1 + i % 5), t) for i, t in enumerate(["bankruptcy", "shutdown | fine", "scandal", "bankruptcy", "data breach", "nothing", "lawsuit"])]
    df = spark.createDataFrame(texts, "doc_id long, vendor string, ts timestamp, text string")
    for k in range(3):
        df.where(F.col("doc_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out: dict = {}

    def run(frame, mode, name, each):
        q = frame.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).foreachBatch(each).start()
        q.awaitTermination(120)

    run(streams.stream_scores(streams.stream_signals(stream, ["vendor"]), "vendor"), "update", "scores", lambda d, _: out.update({r.vendor: tuple(r)[1:] for r in d.collect()}))
    sig = signals.extract_signals(df, "vendor", "text", lexicon(spark))
    want = {r.vendor: (r.risk_score, r.risk_level, r.confidence_score, r.disruption_probability) for r in scoring.score_signals(sig, "vendor").collect()}
    assert out == want
    alerts: list = []
    run(streams.alert_stream(streams.stream_signals(stream, ["vendor", "ts"]), "vendor", late="30 days"), "append", "alerts", lambda d, _: alerts.extend((r.vendor, r.message, r.risk_level) for r in d.collect()))
    assert len(alerts) == len(set(alerts)) == sig.select("vendor", "category", "severity").distinct().count()
    counts: list = []
    run(streams.window_counts(streams.stream_signals(stream, ["ts"])), "append", "windows", lambda d, _: counts.extend(d.collect()))
    assert len({(r.window_start, r.category) for r in counts}) == len(counts)


def test_tables_created_twice(spark):
    from vendorlens.schemas import TABLES, create_tables

    create_tables(spark)
    create_tables(spark)
    assert all(spark.catalog.tableExists(t) for t in TABLES)


def _stream(spark, frame, path, keys):
    """The rows as a stream, a file for each value of keys, in their order."""
    for k in keys:
        frame.where(F.col("file") == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(frame, mode, checkpoint):
    rows: list = []
    q = frame.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(lambda d, _: rows.extend(d.collect())).start()
    q.awaitTermination(120)
    return rows


def test_windows_drop_late_rows(spark, tmp_path):
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    rows = [(0, at(1, 3), "legal", 10), (0, at(1, 5), "legal", 20), (1, at(4, 0), "legal", 3), (2, at(4, 1), "fin", 3), (3, at(1, 9), "legal", 35), (4, at(9, 0), "legal", 1)]
    df = spark.createDataFrame(rows, "file int, ts timestamp, category string, weight int")
    got = _run(streams.window_counts(_stream(spark, df, str(tmp_path / "in"), range(5)), late="1 hour"), "append", str(tmp_path / "cp"))
    # the row of day 1 in the fourth file came after day 4 had been seen (a batch drops by the watermark of the one before)
    assert sorted((r.window_start.day, r.category, r.n_signals, r.total_weight) for r in got) == [(1, "legal", 2, 30), (4, "fin", 1, 3), (4, "legal", 1, 3)]
    assert {(r.window_start.day, r.category): r.n_signals for r in streams.window_counts(df).collect()}[1, "legal"] == 3


def test_sessions_of_a_stream(spark, tmp_path):
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    rows = [(0, "a", at(0, 0)), (0, "b", at(0, 5)), (1, "a", at(0, 20)), (1, "a", at(2, 0)), (2, "b", at(9, 0)), (3, "a", at(20, 0))]
    df = spark.createDataFrame(rows, "file int, job string, ts timestamp")
    stream = _run(streams.activity_sessions(_stream(spark, df, str(tmp_path / "in"), range(4)), "job"), "append", str(tmp_path / "cp"))
    batch = {(r.job, r.session_start, r.session_end, r.n_events) for r in streams.activity_sessions(df, "job").collect()}
    assert {tuple(r) for r in stream} == {r for r in batch if r[2] < at(19, 0)} and len(stream) == 4


def test_alerts_are_stored_once(spark, tmp_path):
    at = lambda d: dt.datetime(2024, 1, d)
    rows = [(0, 7, "v", at(1), "legal", "high", "Lawsuit", 1), (0, 7, "v", at(1), "legal", "high", "Fraud", 2), (1, 7, "v", at(2), "legal", "high", "Lawsuit", 1), (2, 8, "w", at(2), "legal", "high", "Lawsuit", 1)]
    df = spark.createDataFrame(rows, "file int, vendor_id long, vendor string, ts timestamp, category string, severity string, indicator string, ord int")
    stream = streams.alert_stream(_stream(spark, df, str(tmp_path / "in"), range(3)), "vendor", late="10 days")
    for _ in range(2):  # a second run finds nothing new
        streams.store_alerts(stream, str(tmp_path / "alerts"), str(tmp_path / "cp"), key="vendor").awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "alerts"))
    from vendorlens.schemas import ALERTS

    assert got.drop("run", "batch").schema.simpleString() == spark.createDataFrame([], ALERTS).schema.simpleString()
    assert sorted((r.vendor_name, r.message, r.risk_level, r.acknowledged) for r in got.collect()) == [("v", "Legal risk detected", "HIGH", False), ("w", "Legal risk detected", "HIGH", False)]


def test_landing_table(spark, tmp_path):
    raw = spark.createDataFrame([("v", "text", "u", None), ("v", None, None, "de"), (None, "lost", "u", "en")], "vendor_name string, content string, url string, language string")
    for kind in ("search", "filing"):
        evidence.land(raw, str(tmp_path / "landing"), source_type=kind)
    got = spark.read.parquet(str(tmp_path / "landing"))
    assert sorted((r.source_type, r.language, r.content or "-") for r in got.collect()) == [("filing", "de", "-"), ("filing", "en", "text"), ("search", "de", "-"), ("search", "en", "text")]
    assert got.where("fetched_at is null").count() == 0


def test_routine_evidence_comes_down(spark):
    from vendorlens.operators import analyst

    rows = [("a", "bankruptcy", 35, 0, True), ("a", "shutdown", 35, 1, True), ("a", "fine", 10, 2, False), ("b", "bankruptcy", 35, 0, False), ("b", "shutdown", 35, 1, False)]
    df = spark.createDataFrame(rows, "v string, keyword string, weight int, ord int, is_routine boolean").withColumns({"category": F.lit("c"), "severity": F.lit("s"), "host": F.lit("h"), "credibility": F.lit(0.95)})
    got = {r.v: (r.raw_level, r.adjusted_level) for r in analyst.override_level(analyst.supported_signals(df, ["v"]), ["v"]).collect()}
    assert got == {"a": ("CRITICAL", "LOW"), "b": ("CRITICAL", "CRITICAL")}
    assert [r.x for r in spark.createDataFrame([("Form 10-K filed",), ("a historical case",), ("fire",), (None,)], "t string").select(analyst.routine(F.col("t")).alias("x")).collect()] == [True, True, False, False]


def test_cards_and_prompts(spark):
    group = "array<struct<category:string,severity:string,indicators:array<string>,weight:bigint>>"
    rows = [(i, dt.datetime(2024, 1, i), [("Legal", "HIGH", list("abcd"), 1)], [(str(k), "t") for k in range(8)]) for i in range(1, 8)] + [(9, dt.datetime(2023, 1, 1), None, None)]
    df = spark.createDataFrame(rows, f"report_id long, created_at timestamp, signals {group}, sources array<struct<url:string,title:string>>")
    shown = dashboard.front_page(df).collect()
    assert [r.report_id for r in shown] == [7, 6, 5, 4, 3] and shown[0].signals[0].indicators == ["a", "b", "c"] and len(shown[0].sources) == 6
    assert dashboard.cards(df).where("report_id = 9").first().signals is None
    texts = spark.createDataFrame([("x" * 4000,), ("",), (None,)], "t string").select(evidence.prompt_text(F.col("t")).alias("p")).collect()
    assert len(texts[0].p) == 3000 and texts[1].p == texts[2].p == "No scraped content was found."
    assert spark.range(1).select(scalars.level_colour(F.lit("HIGH"), "engine").alias("x")).first().x == "#FF9500"


def test_one_domain_for_sql_and_columns(spark):
    scalars.register(spark)
    names = spark.createDataFrame([("\tAcme\n",), (" A b.Io ",), ("x",)], "n string")
    assert all(r.a == r.b for r in names.select(scalars.vendor_domain(F.col("n")).alias("a"), F.expr("vendor_domain(n)").alias("b")).collect())


def test_pooled_text_in_parts(spark):
    hits = spark.createDataFrame([(1, 1, 0, 2, "t2", "s2"), (1, 1, 0, 1, None, "s1"), (2, 1, 0, 1, "t", "s")], "vendor_id long, pass int, query_id int, rank int, title string, snippet string")
    scraped = spark.createDataFrame([(1, "x" * 3000), (3, "only")], "vendor_id long, scraped string")
    pooled = {r.vendor_id: r.pooled for r in evidence.pool_text(hits, scraped).collect()}
    assert pooled == {1: "s1  s2 t2" + "x" * 2000, 2: "s t", 3: "only"}
    sizes = {r.vendor_id: (r.n_hits, r.n_chars) for r in evidence.pool_sizes(evidence.pool_parts(hits, scraped)).collect()}
    assert sizes == {1: (2, len(pooled[1])), 2: (1, 3), 3: (0, 4)}


def test_more_signals_never_lower_the_score(spark):
    words = [r[3] for r in default_rows()]
    rng = random.Random(7)
    texts = []
    for _ in range(30):
        some = rng.sample(words, rng.randint(1, 8))
        texts += [" | ".join(some), " | ".join(some + rng.sample(words, 3))]
    got = scores(spark, texts)
    for i in range(0, 60, 2):
        assert got[i][0] <= got[i + 1][0] and got[i][2] <= got[i + 1][2] and got[i][3] <= got[i + 1][3]


def test_signals_of_a_vendor_are_those_of_its_documents(spark):
    words = [r[3] for r in default_rows()]
    rng = random.Random(8)
    df = spark.createDataFrame([(i % 4, i, " / ".join(rng.sample(words, 5))) for i in range(24)], "v int, d int, text string")
    own = ["category", "severity", "keyword"]
    by_vendor = {tuple(r) for r in signals.extract_signals(df, "v", "text", lexicon(spark), spread=2).select("v", *own).collect()}
    by_document = signals.extract_signals(df, ["v", "d"], "text", lexicon(spark), distinct=False)
    assert by_vendor == {tuple(r) for r in by_document.select("v", *own).distinct().collect()}
    both = {r.v: r for r in scoring.scored_groups(by_document.dropDuplicates(["v", *own]), "v").collect()}
    for r in scoring.score_signals(by_document.dropDuplicates(["v", *own]), "v").collect():
        assert (r.risk_score, r.risk_level, r.confidence_score, r.disruption_probability, r.n_signals, r.n_categories) == tuple(both[r.v])[1:7] and len(both[r.v].signals) == r.n_categories


def test_large_lexicons_are_matched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(signals, "LEXICON_BLOCK", 20)
    df = spark.createDataFrame([(1, "bankruptcy and a data breach, a lawsuit, delays")], "k long, text string")
    got = sorted(r.keyword for r in signals.extract_signals(df, "k", "text", lexicon(spark)).collect())
    assert got == ["bankruptcy", "data breach", "delays", "lawsuit"]
