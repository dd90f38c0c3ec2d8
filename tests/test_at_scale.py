"""Operators that share a hot key among tasks, large lexicons and topics, and streams with an end."""

from __future__ import annotations

import datetime as dt
import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vendorlens.functions.lexicon import SCHEMA, lexicon
from vendorlens.operators import analyst, evidence, scoring, segments, signals
from vendorlens.streaming import jobs, lifecycle
from vendorlens.streaming import signals as streams

HIT = "vendor_id long, pass int, query_id int, rank int, title string, snippet string"


@pytest.mark.parametrize("seed", range(3))
def test_pooled_signals_are_those_of_the_pooled_text(spark, seed):
    rng = random.Random(seed)
    words = ["chapter", "11", "debt", "crisis", "data", "breach", "", None, "a", "Debt", "cash flow", "problems"]
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice([1, 2]), rng.randrange(3), rng.choice([None, *range(40)]), rng.choice(words), rng.choice(words)) for _ in range(300)]
    hits = spark.createDataFrame(rows, HIT)
    scraped = spark.createDataFrame([(1, " breach of data" + "x" * 3000), (3, "only a lawsuit"), (2, None), (None, "insolvency")], "vendor_id long, scraped string")
    for more in (None, scraped):
        whole = signals.extract_signals(evidence.pool_text(hits, more), "vendor_id", "pooled", lexicon(spark))
        for block in (1, 7, 1000):
            got = evidence.pool_signals(hits, lexicon(spark), more, block=block)
            assert sorted(map(tuple, got.select(*whole.columns).collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)


def test_pooled_signals_hold_one_hit_at_a_time(spark):
    hits = spark.range(20_000).select(F.lit(1).alias("vendor_id"), F.lit(1).alias("pass"), F.lit(0).alias("query_id"), F.col("id").cast("int").alias("rank"), F.lit("cash").alias("title"), F.lit("flow problems").alias("snippet"))
    got = evidence.pool_signals(hits, lexicon(spark))
    assert [r.keyword for r in got.collect()] == ["cash flow problems"]  # only over two hits


@pytest.mark.parametrize("seed", range(2))
def test_pooled_signals_of_long_hits(spark, seed):
    rng = random.Random(seed)
    own = [("c", "low", w) for w in ("ab", "ba ba", "\ue000", "b a b", "aab ", "x" * 30 + " " + "x" * 9)]
    lex = spark.createDataFrame([(i, c, s, w, 3, w) for i, (c, s, w) in enumerate(own)], SCHEMA)
    text = lambda: rng.choice(["", "a", "b", "AB", "x" * 3000, "a" * 1500 + "b", "a" * 1500 + "c", "b" + "c" * 990, "b" + "c" * 3000 + "a", "x" * 20])
    for _ in range(3):
        hits = spark.createDataFrame([(rng.randrange(12), 1, rng.randrange(2), rng.randrange(4), text(), text()) for _ in range(60)], HIT)
        whole = signals.extract_signals(evidence.pool_text(hits), "vendor_id", "pooled", lex)
        got = evidence.pool_signals(hits, lex, block=rng.choice([1, 3, 1000]))
        assert sorted(map(tuple, got.select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))


def test_pooled_signals_match_segments_not_hits(spark):
    hits = spark.range(200_000).select((F.col("id") % 3).alias("vendor_id"), F.lit(1).alias("pass"), F.lit(0).alias("query_id"), F.col("id").cast("int").alias("rank"), F.lit("cash").alias("title"), F.lit("flow problems").alias("snippet"))
    seen = []
    match = evidence.extract_signals
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(evidence, "extract_signals", lambda texts, *rest: seen.append(texts.count()) or match(texts, *rest))
        got = evidence.pool_signals(hits, lexicon(spark))
    assert seen[0] < 2 * 3 * 201 and sorted((r.vendor_id, r.keyword) for r in got.collect()) == [(v, "cash flow problems") for v in range(3)]


@pytest.mark.parametrize("ahead", [False, True])
def test_neighbours_over_segments_are_those_of_a_window(spark, ahead):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, 2]), rng.choice([None, dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(3000))]), i, rng.choice([None, i])) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, ts timestamp, i long, v long")
    w = Window.partitionBy("k").orderBy("ts", "i")
    want = df.withColumn("near", (F.lead if ahead else F.lag)("v").over(w))
    for days in (0.01, 3, 1000):
        got = segments.neighbour(df, ["k"], ["ts", "i"], {"near": "v"}, segments.time_segment(F.col("ts"), days), ahead=ahead)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_a_hot_history_goes_to_many_tasks(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("vendor_id"), F.timestamp_seconds(F.col("id") * 3600).alias("created_at"), F.col("id").alias("report_id"), (F.col("id") % 100).cast("int").alias("risk_score"), F.lit("LOW").alias("risk_level"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        # vendor 7 has a third of all rows
        most = analyst.trajectory(df).where("vendor_id = 7").groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.count("*")).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert most[1] >= int(spark.conf.get("spark.sql.shuffle.partitions")) and most[0] < 0.5 * 20_000


def brute_analogues(sets, cases, k):
    out = []
    for key, own in sets.items():
        near = [(-round(len(own & c) / len(own | c), 6), i, len(own & c)) for i, c in cases.items() if i != key and own & c]
        out += [(key, i, n, -j, place) for place, (j, i, n) in enumerate(sorted(near)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_analogues_are_brute_force(spark, seed):
    rng = random.Random(seed)
    n_signals = [6, 90, 200][seed]
    sets = {i: {int(n_signals * rng.random() ** 3) for _ in range(rng.randint(1, 12))} for i in range(120)}
    sets |= {i: sets[0] for i in range(120, 160)}  # many with the same signals
    cases = {i: s for i, s in sets.items() if i % 3 == 0}
    rows = lambda x: spark.createDataFrame([(i, f"c{s % 5}", "s", f"k{s}") for i, own in x.items() for s in own] * 2, "v long, category string, severity string, keyword string")
    got = analyst.analogues(rows(sets), rows(cases), "v", 4)
    assert got.columns == ["v", "case_id", "shared", "jaccard", "place"]
    assert sorted(map(tuple, got.collect())) == brute_analogues(sets, cases, 4)
    assert analyst.analogues(rows(sets), rows(cases).limit(0), "v", 4).count() == 0


def test_automaton_is_the_theta_join(spark):
    texts = ["", None, "an SEC enforcement case", "bond default and restructuring", "Refined goods", "DATA BREACH", "ab" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    more = [(200 + i, "x", "low", w, 3, w) for i, w in enumerate(["a", "aba", "babab", "bab", ""])]
    lex = lexicon(spark).unionByName(spark.createDataFrame(more, SCHEMA))
    want = sorted(map(tuple, signals.extract_signals(df, "k", "text", lex).collect()))
    for block in (64, 1 << 20):
        assert sorted(map(tuple, signals.extract_signals_automaton(df, "k", "text", lex, block_bytes=block).collect())) == want
    assert signals.extract_signals_automaton(df, "k", "text", lex.limit(0)).count() == 0


def test_automaton_takes_no_longer_for_more_entries(spark):
    df = spark.range(0, 4000, 1, 4).select("id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(200)), lambda i: F.concat(F.lit("w"), ((F.col("id") * 31 + i * 7) % 5000).cast("string"))), " ").alias("text"))
    took = {}
    for n in (100, 100, 100_000):
        lex = spark.range(n).select(F.col("id").cast("int").alias("ord"), F.lit("c").alias("category"), F.lit("low").alias("severity"), F.concat(F.lit(" w"), (F.col("id") + 4900).cast("string"), F.lit(" ")).alias("keyword"), F.lit(3).alias("weight"), F.lit("i").alias("indicator"))
        began = time.time()
        found = signals.extract_signals_automaton(df, "id", "text", lex, distinct=False).count()
        took[n] = time.time() - began
    assert found > 0 and took[100_000] < 10 * took[100] + 5


def test_automaton_does_not_repeat_texts(spark):
    # 2,000 keywords in each of 8 texts of 200 kB: 3 GB if a text went along with each
    import resource

    words = [f"w{i:04d}" for i in range(2000)]
    lex = spark.createDataFrame([(i, "c", "low", w, 3, w) for i, w in enumerate(words)], SCHEMA)
    df = spark.range(0, 8, 1, 1).select("id", F.concat(F.lit(" ".join(words)), F.repeat(F.lit("x "), 95_000)).alias("text"))

    def peak(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "kb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss]})

    found = signals.extract_signals_automaton(df, "id", "text", lex, distinct=False).select("id")
    r = found.mapInArrow(peak, "n long, kb long").agg(F.sum("n").alias("n"), F.max("kb").alias("kb")).first()
    assert r.n == 16_000 and r.kb < 2_000_000


def test_table_function_lowers_a_text_once(spark, sf_dir):
    from vendorlens.plans import registry

    plan = registry.QUERIES["signals_by_table_function"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 1 and "lower(" not in joins[0] and plan.count("lower(") == 1


@pytest.mark.parametrize("seed", range(3))
def test_keyword_counts_are_brute_force(spark, seed):
    rng = random.Random(seed)
    text = lambda lo, hi: "".join(rng.choice("abé \U0001f600") for _ in range(rng.randint(lo, hi)))
    rows = [(rng.choice([None, *range(-9, 30)]), rng.choice([None, text(0, 9), text(50, 300)])) for _ in range(150)]
    words = sorted({text(0, 5) for _ in range(80)} | {t[5:90] for _, t in rows if t})
    texts, lex = spark.createDataFrame(rows, "k long, text string"), spark.createDataFrame([(w,) for w in [*words, *words[:5], None]], "keyword string")
    own = {w: {k for k, t in rows if k is not None and t is not None and w in t} for w in words}
    want = sorted((w, len(k), min(k)) for w, k in own.items() if k)
    for block, chunk in ((6000, 1000), (1 << 20, 3)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(chunk))
        try:
            got = signals.keyword_counts(texts, "k", "text", lex, spread=3, block_bytes=block).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted(map(tuple, got)) == want


def test_indexed_retrieval_is_the_theta_join(spark):
    rng = random.Random(2)
    letters = "abé \U0001f600"
    text = lambda lo, hi: "".join(rng.choice(letters) for _ in range(rng.randint(lo, hi)))
    docs = spark.createDataFrame([(i, rng.choice([None, text(0, 40), text(0, 3)]), rng.choice([None, "https://a.com/x", "https://sub.a.com/", "http://b.org"])) for i in range(120)] * 2, "d long, text string, url string")
    topics = spark.createDataFrame([(i, 0, rng.choice([None, text(0, 5), text(3, 6).upper()]), rng.choice([None, [], [text(1, 2), text(1, 3)], [text(0, 2)]]), rng.choice(["a.com", "b.org"])) for i in range(150)], "vendor_id long, query_id int, phrase string, terms array<string>, domain string")
    want = evidence.retrieve(docs, topics, keys=["d"]).collect()
    got = evidence.retrieve_indexed(docs, topics, keys=["d"]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 100
    blocks = evidence.retrieve_indexed(docs, topics, keys=["d"], block=60).collect()
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, want))


def test_indexed_retrieval_of_phrases_in_every_text(spark):
    # 24 million pairs of a phrase and a text of 40 kB: the texts aren't searched anew for each
    docs = spark.range(0, 4000, 1, 8).select("id", F.repeat(F.concat(F.lit("words of text "), F.col("id").cast("string"), F.lit(" ")), 2000).alias("text"), F.lit("https://x.org/").alias("url"))
    topics = spark.range(6000).select(F.col("id").alias("vendor_id"), F.lit(0).alias("query_id"), F.element_at(F.array(F.lit(""), F.lit("w"), F.lit("OF")), (F.col("id") % 3 + 1).cast("int")).alias("phrase"), F.array(F.lit("absent"), F.concat(F.lit("text "), F.col("id").cast("string"), F.lit(" "))).alias("terms"), F.lit("a.com").alias("domain"))
    found = evidence.retrieve_indexed(docs, topics, keys=["id"])
    assert "Join" not in found._jdf.queryExecution().toString()
    assert found.where("id = vendor_id").count() == found.count() == 4000


def test_indexed_retrieval_of_own_domains_and_null_terms(spark):
    docs = spark.createDataFrame([(i, "a b", u) for i, u in enumerate(["https://a.b.com/x", "https://b.com", "https://xb.com", None, "https://b.com."])], "d long, text string, url string")
    topics = spark.createDataFrame([(i, 0, "A", t, d) for i, (t, d) in enumerate((t, d) for t in ([None, "b"], [None], None, [], ["x", "B"], [""]) for d in ("b.com", "com", "", None))], "vendor_id long, query_id int, phrase string, terms array<string>, domain string")
    want = evidence.retrieve(docs, topics, keys=["d"]).collect()
    assert sorted(map(tuple, evidence.retrieve_indexed(docs, topics, keys=["d"]).collect())) == sorted(map(tuple, want)) and len(want) > 20


def test_indexed_retrieval_gives_a_topic_once_for_64_texts(spark):
    # 1,920,000 rows; Python gives Spark a list of texts for each topic, not each row
    docs = spark.range(0, 6400, 1, 1).select("id", F.concat(F.lit("a lawsuit of "), F.col("id").cast("string")).alias("text"), F.lit("https://x.org/").alias("url"))
    topics = spark.range(300).select(F.col("id").alias("vendor_id"), F.lit(0).alias("query_id"), F.lit("").alias("phrase"), F.array(F.lit("lawsuit")).alias("terms"), F.lit("a.com").alias("domain"))
    found = evidence.retrieve_indexed(docs, topics, keys=["id"])
    assert len(found.toArrow()) == 6400 * 300
    plan, given = found._jdf.queryExecution().executedPlan(), None
    while given is None:
        given = plan.metrics().apply("pythonNumRowsReceived").value() if plan.nodeName() == "MapInArrow" else None
        plan = plan.children().head() if given is None else plan
    assert given == 300 * 100


def test_indexed_retrieval_by_several_keys_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "k", "A b", "https://x.org/"), (None, None, "a", "https://x.org/"), (1, "k", "A b", "https://x.org/"), (2, "", None, None)], "d long, `odd key` string, text string, url string")
    topics = spark.createDataFrame([(i, 0, p, ["a"], "a.com") for i, p in enumerate(["", "b", "a b", "c"])], "vendor_id long, query_id int, phrase string, terms array<string>, domain string")
    for d, t in ((docs, topics), (docs, topics.limit(0)), (docs.limit(0), topics)):
        got, want = (f(d, t, keys=["d", "odd key"]) for f in (evidence.retrieve_indexed, evidence.retrieve))
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("seed", range(4))
def test_substrings_are_brute_force(seed, monkeypatch):
    import pyarrow as pa

    from vendorlens.functions import substrings

    rng = random.Random(seed)
    letters = ["ab", "abcdefghij ", "abé \u20ac\U0001f600", "".join(map(chr, range(32, 127)))][seed]
    text = lambda lo, hi: "".join(rng.choice(letters) for _ in range(rng.randint(lo, hi)))
    texts = [rng.choice([None, "", "", text(0, 9), text(20, 200), text(200, 3000)]) for _ in range(200)]
    inside = [t[i : i + n] for t in texts if t for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 15, 16, 17, 23, 24, 31, 32, 50, 100, 400) for i in rng.sample(range(len(t)), min(2, len(t)))]
    words = list(dict.fromkeys(["", *inside, *(w[:-1] + "a" for w in inside), *(w + "b" for w in inside)]))
    want = {(i, w) for i, t in enumerate(texts) if t is not None for w, word in enumerate(words) if word in t}
    for chunk in (1 << 18, 1000):
        monkeypatch.setattr(substrings, "CHUNK_BYTES", chunk)
        index, found, marked = substrings.Substrings(pa.array(words)), [], set()
        for begin, _, row, word in index.find(pa.array(texts)):
            found += [(begin + i, w) for i, w in zip(row.tolist(), word.tolist(), strict=True)]
        for begin, end, marks in index.marks(pa.array(texts)):
            assert end - begin <= 64 and marks[-1] == 0
            marked |= {(i, w) for w, bits in enumerate(marks.tolist()) if bits for i in range(begin, begin + 64) if bits >> (i - begin) & 1}
        assert found == sorted(want) and marked == want


def test_very_many_topics_without_a_theta_join(spark):
    docs = spark.range(3000).select("id", F.concat(F.lit("about company "), F.col("id").cast("string"), F.lit(" inc and its losses")).alias("text"), F.lit("https://x.org/").alias("url"))
    topics = spark.range(100_000).select(F.col("id").alias("vendor_id"), F.lit(0).alias("query_id"), F.concat(F.lit("Company "), F.col("id").cast("string"), F.lit(" inc")).alias("phrase"), F.array(F.lit("losses")).alias("terms"), F.lit("a.com").alias("domain"))
    found = evidence.retrieve_indexed(docs, topics, keys=["id"])
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    assert found.where("id = vendor_id").count() == found.count() == 3000


def test_converging_at_the_edges_of_windows(spark):
    days = [0, 89, 90, 179, 180, 400, 489, 490, 491]
    df = spark.createDataFrame([("k", dt.date(2024, 1, 1) + dt.timedelta(d), c, 1) for d in days for c in ("a", "b") if c == "a" or d % 2], "k string, day date, category string, weight int")
    got = {r.day: tuple(r)[2:] for r in analyst.converging(df, "k").collect()}
    for day in got:
        near = [(r.category, (day - r.day).days) for r in df.collect()]
        now, before = [c for c, n in near if 0 <= n < 90], [c for c, n in near if 90 <= n < 180]
        assert got[day] == (len(now), len(before), len(set(now)), len(set(before)))
    assert len(got) == len(days)


def test_primary_category_keeps_all_others(spark):
    groups = spark.createDataFrame([("v", f"c{i}", i, i) for i in range(12)], "v string, category string, weight int, ord int")
    r = analyst.primary_category(groups, ["v"]).first()
    assert r.primary_category == "c11" and r.secondary == [f"c{i}" for i in range(10, -1, -1)]


def test_sketches_of_days_are_near_the_exact_rollup(spark):
    df = spark.range(60_000).select((F.col("id") % 7001).alias("v"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 30).cast("int")).alias("day"), (F.col("id") % 5).cast("string").alias("category"), F.lit("high").alias("severity"), F.lit(2).alias("weight"))
    exact = {(r.category, r.severity): (r.vendors, r.total_weight) for r in scoring.rollup_signals(df, "v").collect()}
    for about in (scoring.rollup_sketches(scoring.daily_sketches(df, "v")), scoring.rollup_signals(df, "v", approximate=True)):
        got = {(r.category, r.severity): (r.vendors, r.total_weight) for r in about.collect()}
        assert got.keys() == exact.keys()
        assert all(abs(got[k][0] - n) <= 0.06 * n and got[k][1] == w for k, (n, w) in exact.items())


AT = dt.datetime(2024, 1, 1, 0, 0, 0)
EVENT = "file int, job_id string, ts timestamp, stage string, message string, progress int, status string, error string"


def _files(spark, rows, path):
    df = spark.createDataFrame([(f, j, AT + dt.timedelta(seconds=s), *rest) for f, j, s, *rest in rows], EVENT)
    for k in sorted({r[0] for r in rows}):
        df.where(F.col("file") == k).drop("file").coalesce(1).write.mode("append").parquet(path)
    return df.drop("file")


def test_jobs_leave_the_state(spark, tmp_path):
    rows = [
        (0, "done", 0, "recon", "m", 10, "running", None), (0, "silent", 5, "recon", "m", 10, "running", None), (0, "boom", 5, "agents", "m", 65, None, None),
        (1, "done", 20, "complete", "end", 100, "completed", None), (1, "boom", 30, "failed", "end", None, "failed", "error"), (2, "done", 25, "late", "x", 70, "running", None),
        (3, "alive", 4000, "recon", "m", 10, "running", None), (4, "alive", 4300, "scraping", "m", 35, "running", None),
    ]
    events = _files(spark, rows, str(tmp_path / "in"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out, sizes = {}, []
    try:
        stream = lifecycle.job_lifecycle(jobs.job_events(spark, str(tmp_path / "in")))
        q = stream.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda d, _: out.update({r.job_id: tuple(r)[1:] for r in d.collect()})).start()
        q.awaitTermination(240)
        sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert out["done"] == ("completed", "complete", "end", 100, None)
    assert out["boom"] == ("failed", "agents", "m", 65, "error")
    assert out["silent"] == ("failed", "recon", "m", 10, lifecycle.SILENT)
    assert out["alive"] == ("running", "scraping", "m", 35, None)
    assert max(sizes) > sizes[-1]
    batch = {r.job_id: tuple(r)[1:] for r in lifecycle.job_outcome(events).collect()}
    assert batch == out


def test_replay_loses_and_repeats_nothing(spark, tmp_path):
    from vendorlens.sources.replay import replayed_jobs

    events = spark.range(1000).select(F.col("id").cast("string").alias("job_id"), F.timestamp_seconds("id").alias("ts"), F.lit("recon").alias("stage"), F.lit("m").alias("message"), F.lit(1).alias("progress"), F.lit("running").alias("status"), F.lit(None).cast("string").alias("error"))
    events.repartition(5).write.option("maxRecordsPerFile", 70).parquet(str(tmp_path / "in"))
    seen: list = []
    begin = time.time() - 3

    def run(rate):
        stream = replayed_jobs(spark, str(tmp_path / "in"), rows_per_second=rate, begin=begin)
        q = stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda d, _: seen.extend(r.job_id for r in d.collect())).trigger(availableNow=True).start()
        q.awaitTermination(120)

    run(50)
    first = len(seen)
    assert 0 < first < 1000
    run(50)  # a restart goes on where the checkpoint ends
    assert len(set(seen)) == len(seen) >= first
    run(10_000)
    assert sorted(map(int, seen)) == list(range(1000))


def test_an_added_entry_counts_from_the_next_batch(spark, tmp_path):
    table = str(tmp_path / "lexicon")
    lexicon(spark).where("keyword = 'lawsuit'").write.parquet(table)
    docs = spark.createDataFrame([(0, "a lawsuit and a flood"), (1, "another flood")], "file int, text string")
    for k in (0, 1):
        docs.where(F.col("file") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []

    def write(found, number):
        seen.append((number, sorted(r.keyword for r in found.collect())))
        if number == 0:
            spark.createDataFrame([(500, "operational", "high", "flood", 20, "Flood")], SCHEMA).write.mode("append").parquet(table)

    streams.signals_with_table(stream, ["file"], lambda s: s.read.schema(SCHEMA).parquet(table), write, str(tmp_path / "cp")).awaitTermination(120)
    assert seen == [(0, ["lawsuit"]), (1, ["flood"])]


def test_alerts_of_another_checkpoint_are_kept(spark, tmp_path):
    df = spark.createDataFrame([(0, "v", AT, "legal", "high", "Lawsuit", 1)], "file int, vendor string, ts timestamp, category string, severity string, indicator string, ord int")
    for k, name in enumerate(("v", "w")):
        df.withColumn("vendor", F.lit(name)).write.parquet(str(tmp_path / f"in{k}"))
        stream = streams.alert_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / f"in{k}")), "vendor")
        streams.store_alerts(stream, str(tmp_path / "alerts"), str(tmp_path / f"cp{k}"), key="vendor").awaitTermination(120)
    assert sorted(r.vendor_name for r in spark.read.parquet(str(tmp_path / "alerts")).collect()) == ["v", "w"]
