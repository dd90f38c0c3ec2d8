"""The training-data operators on Spark: SQL, brute force, and rows at the edges."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from compare import differences
from pyspark.sql import functions as F

from vendorlens.llm import decontamination, html_text, near_dedup, packing, pii, substring_dedup, token_tables, topk, toxicity, url_filter
from vendorlens.llm.common import table
from vendorlens.llm.components import connected_components
from vendorlens.llm.queries import ORACLE_SQL, QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
CLASH = "doc_id long, text string, id string, a int, node string, keep int, n long, sig binary, _kept int, label int"


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, name):
    assert differences(spark, QUERIES[name], ORACLE_SQL[name], sf_dir) == ""


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, 3, None, 4, 5) for i, t in rows], CLASH)


LONG = " ".join(f"w{i % 9000}" for i in range(60_000))
EDGE = [(1, None), (2, ""), (3, "one two three four five six seven"), (3, "one two three four five six seven"), (4, LONG), (5, LONG), (None, "one two three four five six seven"), (6, "é"), (7, " \n\t "), (8, "one two three four five six seven")]


def test_edge_rows_and_clashing_columns(spark):
    df = docs(spark, EDGE)
    bench = spark.createDataFrame([(1, "four five six"), (2, None), (3, ""), (None, "é")], "item_id long, text string")
    found = {(r.id, r.n_words): (r.n_hit, sorted(x.item_id or "-" for x in r["items"])) for r in decontamination.matches(df, bench).collect()}
    assert found[(3, 7)] == (3, ["1"]) and found[(6, 1)] == (1, ["-"]) and found[(1, 0)] == (0, []) and found[(4, 60_000)][0] == 0
    clean = decontamination.decontaminated(df, bench)
    assert sorted(str(r.doc_id) for r in clean.collect()) == ["1", "2", "4", "5", "7"] and clean.columns == df.columns

    near = near_dedup.near_duplicates(df, width=4)
    got = sorted((str(r.id), r.n_shingles, r.component_id, r.kept) for r in near.collect())
    assert got == sorted([("1", 0, 1, True), ("2", 0, 2, True), ("3", 4, 3, True), ("3", 4, 3, True), ("4", 9000, 4, True), ("5", 9000, 4, False), ("None", 4, 3, False), ("6", 1, 6, True), ("7", 0, 7, True), ("8", 4, 3, False)])
    kept = near_dedup.deduplicated(df, width=4)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "3", "4", "6", "7", "None"] and kept.columns == df.columns

    cut = substring_dedup.without_repeats(df)
    assert cut.columns == df.columns
    texts = {str(r.doc_id): r.text for r in cut.collect()}
    assert texts["5"] == "" and texts["4"] == LONG and texts["1"] is None

    spans = {str(r.id): r.spans for r in pii.personal_data(df).collect()}
    assert spans["1"] == [] and len(spans) == 9
    assert pii.redacted(df).columns == df.columns and pii.redacted(df).count() == len(EDGE)

    pieces = packing.packed(df, PATH, 1).collect()
    assert len({r.sequence_id for r in pieces}) >= 2 * (LONG.count(" ") // 2048)
    assert {r.length for r in pieces if r.id in (1, 2)} == {1} and all(r.offset + r.length <= 2048 for r in pieces)
    shards = token_tables.write_tables(df, PATH, 2)
    back = token_tables.read_tables(shards).orderBy("start").collect()
    assert [r.doc_id for r in back] == [1, 2, 3, 3, 4, 5, 6, 7, 8] and back[0].n_tokens == 1
    assert [(r.doc_id, r.ids) for r in token_tables.lookup(shards, [1, 99]).collect()] == [(1, [2])]

    labels = spark.createDataFrame([(3, 1, 1), (6, None, 0), (7, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.trained(df, labels)
    assert np.array_equal(model.weights, toxicity.trained(df.repartition(5), labels).weights)
    scores = toxicity.scored(df, model).collect()
    assert len(scores) == len(EDGE) and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.trained(df, labels.where("toxic = 0")) is None


def test_benchmark_in_blocks_as_in_one(spark, monkeypatch):
    word = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    items = [("1", word("a", 15)), ("2", word("b", 4)), (None, word("c", 12)), ("3", f"{word('a', 15)} {word('d', 9)}"), ("4", ""), ("2", word("e", 12))]
    rows = [(1, f"x {word('a', 15)} {word('d', 9)} y {word('b', 4)}"), (1, f"x {word('a', 15)} {word('d', 9)} y {word('b', 4)}"), (1, word("e", 11)), (None, f"{word('c', 12)} {word('b', 4)}"), (None, word("b", 4)), (None, None), (2, "clean")]
    df, bench = docs(spark, rows), spark.createDataFrame(items, "item_id string, text string")
    item = lambda x: (x.item_id or "-", x.longest, x.item_word, x.doc_word)
    found = lambda: sorted((str(r.id), r.n_words, r.n_hit, [tuple(x) for x in r.spans], sorted(map(item, r["items"]))) for r in decontamination.matches(df, bench).collect())
    one = found()
    monkeypatch.setattr(decontamination, "BENCHMARK_BLOCK_BYTES", 30)
    assert len(one) == len(rows) and found() == one
    clean = sorted(str(r.doc_id) for r in decontamination.decontaminated(df, bench).collect())
    assert clean == sorted(r[0] for r in one if not r[2]) and "2" in clean


def test_empty_tables(spark):
    none = docs(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    some = docs(spark, [(1, "a b c")])
    assert decontamination.matches(none, bench).count() == 0 and decontamination.matches(some, bench).first().n_hit == 0
    assert near_dedup.near_duplicates(none).count() == 0 and near_dedup.deduplicated(none).count() == 0
    summary, cut = substring_dedup.repeated_passages(none)
    assert summary.count() == 0 and cut.count() == 0
    assert packing.packed(none, PATH, 1).count() == 0
    assert token_tables.read_tables(token_tables.write_tables(none, PATH, 2)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.trained(none, labels)
    assert model is None and toxicity.scored(none, None).count() == 0 and toxicity.acceptable(some, None).count() == 1
    assert pii.personal_data(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    rules = spark.createDataFrame([], "rule string, verdict string")
    assert html_text.extracted(pages).count() == 0 and url_filter.judged(pages, rules).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.nearest(vectors, F.col("id") % 100 == 0).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(500, 560)] + [(None, 1), (2, 2)]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("small", [False, True])
def test_near_copies_of_one_text(spark, small, monkeypatch):
    """A group whose members differ from each other, single pairs, and texts that are too different; also with nodes
    of many tiles, several blocks of probes, deep branching and salted leaders."""
    if small:
        for name, value in {"LEAF": 4, "TILE": 7, "PROBES": 3, "LAST_DEPTH": 4, "STAR": 16, "CONFIRMED": 2}.items():
            monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(10)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(60):
        own = list(base)
        for k in rng.sample(range(200), rng.randint(0, 9)):
            own[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(f"y{rng.randrange(50)}" for _ in range(30))) for i in range(40)]

    def shingles(t):
        w = t.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    sets = {i: shingles(t) for i, t in rows}
    want = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if i < j and want[i] != want[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    low = min(want[i], want[j])
                    want = {k: low if v in (want[i], want[j]) else v for k, v in want.items()}
                    changed = True
    got = {r.id: r.component_id for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert got == want and len(set(want.values())) < 80


def test_one_row_of_each_class(spark):
    import corpus_pipeline

    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    near = text("a") + " more"
    rows = [(1, text("a")), (1, text("a")), (2, near), (2, text("b")), (None, near), (None, text("c")), (None, text("c") + " more"), (3, ""), (3, ""), (None, None), (4, text("d")), (5, text("d"))]
    df = docs(spark, rows)
    show = lambda out: sorted((str(r.doc_id), (r.text or "-")[:1]) for r in out.collect())
    kept = corpus_pipeline.without_copies(spark, df, "")
    assert kept.columns == df.columns
    assert show(kept) == sorted([("1", "a"), ("2", "b"), ("None", "c"), ("3", "-"), ("3", "-"), ("None", "-"), ("4", "d")])
    assert ("2", "b") in show(near_dedup.deduplicated(df)) and ("2", "a") not in show(near_dedup.deduplicated(df))


def test_repeats_across_documents(spark):
    rng = random.Random(11)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(80)]
    word = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    rows = [(i, " ".join([*word(rng.randint(0, 40)), *passage[rng.randint(0, 20) : rng.randint(50, 80)], *word(20)])) for i in range(25)]
    rows += [(30, " ".join(["same"] * 120)), (31, " ".join(["same"] * 90)), (40, rows[3][1]), (41, " ".join(passage[:49]))]
    first: dict = {}
    for i, t in sorted(rows):
        w = t.split()
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), i)
    want = {}
    for i, t in rows:
        w = t.split()
        gone = {q for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < i for q in range(p, p + 50)}
        want[i] = " ".join(x for q, x in enumerate(w) if q not in gone)
    got = {r.doc_id: " ".join(r.text.split()) for r in substring_dedup.without_repeats(docs(spark, rows)).collect()}
    assert got == want and any(want[i] != t for i, t in rows)


def test_rows_that_share_an_id_are_cut_each_by_itself(spark):
    tail, word = " ".join(f"t{i}" for i in range(60)), lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(1, f"{tail} one"), (2, f"x {tail} {word('x')}"), (2, f"y {word('y')} {tail} z"), (2, f"y {word('y')} {tail} z"), (3, f"{tail} one"), (3, word("q")), (None, tail)]
    got = sorted((str(r.doc_id), r.text) for r in substring_dedup.without_repeats(docs(spark, rows)).collect())
    assert got == sorted([("1", rows[0][1]), ("2", f"x {word('x')}"), ("2", f"y {word('y')} z"), ("2", f"y {word('y')} z"), ("3", ""), ("3", word("q")), ("None", tail)])
    summary, cut = substring_dedup.repeated_passages(docs(spark, rows))
    assert summary.count() == len(rows)
    texts = {1: rows[0][1].split()}
    for r in cut.collect():
        for f in r.factors:
            own = next(t for i, t in rows if i == r.id and len(t.split()) >= f.stop).split() if r.id != 2 else None
            assert f.stop - f.start == 60 and f.reference == 1 and texts[1][f.place : f.place + 60] == tail.split() and own is None


def test_lookup_of_many_documents(spark):
    rows = [(7 * i, f"text number {i}") for i in range(3000)]
    shards = token_tables.write_tables(docs(spark, rows).repartition(3), PATH, 2).cache()
    whole = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_tables.read_tables(shards).collect()}
    asked = list(range(0, 21_000, 5))
    got = {r.doc_id: r.ids for r in token_tables.lookup(shards, asked).collect()}
    assert len(whole) == 3000 and got == {i: whole[i] for i in asked if i in whole}
    assert token_tables.lookup(shards, []).count() == 0


def test_token_query_as_the_library(spark, sf_dir):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(PATH)
    start, want = 0, []
    for r in table(spark, sf_dir, "documents").orderBy("doc_id").collect():
        ids = np.array([*own.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op5_token_sstables"](spark, sf_dir).collect())) == want


def test_packing_query_places_every_token_once(spark, sf_dir):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    full = {r.doc_id: [*own.encode(r.text or "", add_special_tokens=False).ids, 1] for r in table(spark, sf_dir, "documents").collect()}
    by_doc, by_sequence = {}, {}
    for r in QUERIES["op7_packing"](spark, sf_dir).collect():
        assert zlib.crc32(np.array(full[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(full[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in [*by_doc.values(), *by_sequence.values()]:
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:])) and min(parts)[0] == 0
    assert set(by_doc) == set(full)
    assert sum(map(len, full.values())) > 0.97 * 2048 * (len(by_sequence) - 1)


def test_equal_rows_are_spread_over_groups(spark):
    df = docs(spark, [(None, "one and the same text")] * 3000 + [(i, f"text {i}") for i in range(200)])
    pieces = packing.packed(df.repartition(3), PATH, 1, group_documents=400).collect()
    groups = [r.sequence_id // packing.GROUP_SPAN for r in pieces if r.id is None]
    assert len(pieces) == 3200 and len(set(groups)) == 8 and max(map(groups.count, set(groups))) < 600
    assert sum(r.length for r in pieces) > 0.9 * 2048 * (len({r.sequence_id for r in pieces}) - 8)


def test_training_samples_are_bounded_and_stable(spark, monkeypatch):
    for name, value in {"MAX_POSITIVE": 100, "MAX_UNLABELLED": 300, "MAX_SCALE": 100}.items():
        monkeypatch.setattr(toxicity, name, value)
    df = docs(spark, [(i, f"word{i % 7} nasty text {i}" if i % 3 == 0 else f"word{i % 7} other text {i}") for i in range(2000)])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(0, 2000, 2)], "doc_id long, quality int, toxic int")
    known = labels.select(F.col("doc_id").alias("_id"), F.lit(1).alias("_label"))
    some = toxicity._some(known, 60, 1).collect()
    assert len(some) == 60 and some == toxicity._some(known.repartition(7), 60, 1).collect()
    model = toxicity.trained(df, labels)
    scores = {r.id: r.score for r in toxicity.scored(df, model).collect()}
    assert np.mean([scores[i] > 0.5 for i in range(0, 2000, 3)]) > 0.95 > 0.05 > np.mean([scores[i] > 0.5 for i in range(2000) if i % 3])


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    out = QUERIES["op8_toxicity"](spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out and toxic is not null").select("predicted", "toxic").toPandas()
    tp = int(((out.predicted == 1) & (out.toxic == 1)).sum())
    assert tp >= 0.9 * (out.toxic == 1).sum() and tp >= 0.95 * (out.predicted == 1).sum()


def test_pii_query_as_brute_force(spark, sf_dir):
    from test_llm_small import brute_spans

    got = {r.doc_id: r for r in QUERIES["op10_pii"](spark, sf_dir).collect()}
    for r in table(spark, sf_dir, "documents").collect():
        base = brute_spans(r.text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        own = got[r.doc_id]
        assert own.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [own[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert set(joined.split(",")) - {""} <= set(own.spans.split(","))


def test_html_query_keeps_articles(spark, sf_dir):
    import html

    source = {r.page_id: r.html for r in table(spark, sf_dir, "pages").collect()}
    for r in QUERIES["op9_html_extraction"](spark, sf_dir).collect():
        article = re.search(r"(?s)<article>(.*?)</article>", source[r.page_id])[1]
        article = re.sub(r"</?(?:p|br|h1|li|ul|div)[^>]*>", " ", re.sub(r"</?b>", "", article))
        assert r.text == re.sub(r"\s+", " ", html.unescape(article)).strip() and r.n_chars == len(r.text)


def test_template_without_article(spark):
    page = lambda i: (i, f"http://h.org/{i}", f'<body><div id="top">Home News</div><div id="x">{"text %d " % i * 30}</div><div id="y"><a href="/">more</a></div></body>')
    rows = [page(i) for i in range(6)] + [(7, None, None), (8, "no url", "<p>lone &amp; plain</p>")]
    got = {r.id: r.text for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == ("text 3 " * 30).strip() and got[7] == "" and got[8] == "lone & plain"


def test_the_template_alone_tells_the_text(spark):
    """Elements without telling names; only the other pages of the host say which of them is the main one."""
    notice = "We would like you to know that this place uses small files, " * 4
    page = lambda i, n, box="c": (i, f"http://t.org/{i}", f'<body><div class="a"><ul><li><a href="/">Home {i}</a></ul></div><div class="b">{notice}</div><div class="{box}"><p>{f"word{i} " * n}</p></div><div class="d">Page {i} of the other kind</div></body>')
    rows = [page(i, 200 + i) for i in range(12)] + [page(12, 1)]
    many = {r.id: r.text for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert many == {i: (f"word{i} " * (200 + i if i < 12 else 1)).strip() for i in range(13)}
    alone = html_text.extracted(spark.createDataFrame(rows[12:], "page_id long, url string, html string")).first().text
    assert "small files" in alone
    copies = [(i, f"http://c.org/{i}", '<body><div class="c">one and the same text</div><div class="d">p%d</div></body>' % i) for i in range(9)]
    assert {r.text for r in html_text.extracted(spark.createDataFrame(copies, "page_id long, url string, html string")).collect()} == {"one and the same text"}


def test_classes_must_be_ordered_and_nested(spark):
    slots = lambda rows: {r.host: dict(r.slots) for r in html_text.templates(spark.createDataFrame([(i, "h", x) for i, x in enumerate(rows)], "page long, host string, html string")).collect()}
    key = lambda page, tag: [p.key for p in html_text.parsed(page).places if p.tag == tag]
    fine = [f"<body><section>text {i}</section><figure>more {i}</figure></body>" for i in range(4)]
    assert set(slots(fine)["h"]) == {*key(fine[0], "section"), *key(fine[0], "figure")}
    swapped = [*fine[:2], *(f"<body><figure>more {i}</figure><section>text {i}</section></body>" for i in range(2))]
    assert slots(swapped) == {}
    # two elements on the same two pages, in different places of the template: no class of their own
    other = ["<body><main>text <section>s</section></main><aside>x <figure>f</figure></aside></body>"] * 2 + ["<body><main>text</main><aside>x</aside></body>"] * 2
    assert set(slots(other)["h"]) == {*key(other[0], "main"), *key(other[0], "aside")}


def test_layouts_of_one_host_are_judged_apart(spark):
    body = lambda inner: f'<html><body class="has-sidebar search"><div id="top">Home</div>{inner}</body></html>'
    text = lambda i: f"words of page {i} " * 20
    inner = [
        lambda i: f'<article class="post comments-open">{text(i)}</article>',
        lambda i: f'<div id="text">{text(i)}<div class="w-1/2">deep {i}</div></div>',
        lambda i: f'<div id="x"><section>{text(i)}</section><ul><li>point {i}</li></ul><table><tr><td>cell {i}</td></tr></table><div class="share">no</div></div>',
    ]
    rare = (99, "http://m.org/99", body(f'<div id="rare">{text(99)}</div>'))
    rows = [(i, f"http://m.org/{i}", body(inner[i % 3](i))) for i in range(30)] + [rare]
    got = {r.id: r.text for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(30):
        assert got[i] == (text(i) + ["", f"deep {i}", f"point {i} cell {i}"][i % 3]).strip()
    assert got[99] == text(99).strip()


def test_aliases_take_block_decisions(spark):
    link = '<link href="{}" rel="canonical">'.format
    rows = [
        (1, "http://good.org/a", link("http://bad.net/x")), (2, "http://bad.net/x", ""), (3, "http://other.org/b", '<meta http-equiv="refresh" content="0; url=//good.org/a#z">'),
        (4, "http://fine.org/c", link("http://bad.net/y")), (5, "http://bad.net/y", link("http://ok.com/1")), (6, "http://ok.com/1", None), (7, None, None), (8, "x", ""), (9, "HTTP://SUB.Bad.NET?q", ""), (10, "http://rel.org/p/q", link("/r")), (11, "http://rel.org/r", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = spark.createDataFrame([("bad.net/", "block"), ("ok.com/", "allow"), ("rel.org/r", "block"), (None, "block")], "rule string, verdict string")
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages, rules).collect()}
    assert got[1] == ("good.org", "/a", None, "block") and got[2][2:] == ("bad.net/", "block") and got[3][3] == "block"
    assert got[4][3] == "allow" and got[5][3] == "block" and got[6][2:] == ("ok.com/", "allow")
    assert got[7] == got[8] == ("", "", None, "allow") and got[9] == ("sub.bad.net", "", None, "allow")
    assert got[10][3] == "block" and got[11][3] == "block"
    assert sorted(r.page_id for r in url_filter.allowed(pages, rules).collect()) == [4, 6, 7, 8, 9]


def test_targets_are_resolved(spark):
    from urllib.parse import urljoin

    url = "http://h.org/a/b/page.html?x=1"
    targets = ["page2.html", "?id=3", "../x", "../../../y/./z/..", "./", "sub/q?u=http://o.org/", "/r/../s", "//o.org/p", "http://o.org/q"]
    link = '<link rel="{}" href="{}">'.format
    pages = [(i, url, link("alternate canonical", t)) for i, t in enumerate(targets)]
    pages += [(20, url, '<meta http-equiv="refresh" content="0; url=next.html?a=1&amp;b=2">'), (21, "http://h.org", "<link href=z&#46;html rel=canonical>"), (22, url, link("alternate", "no")), (23, url, link("canonical", "mailto:x")), (24, url, link("canonical", "#here"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {(r.a, r.b) for r in url_filter.alias_edges(df).collect()}
    node = lambda u: u.split("://", 1)[1]
    want = {(node(url), node(urljoin(url, t))) for t in targets} | {(node(url), "h.org/a/b/next.html?a=1&b=2"), ("h.org/", "h.org/z.html")}
    assert got == want
    rules = spark.createDataFrame([("h.org/a/x", "block")], "rule string, verdict string")
    assert {r.id: r.verdict for r in url_filter.judged(df, rules).collect()}[2] == "block"


def test_url_query_as_sql_on_linked_pages(spark, tmp_path):
    """The given pages hold no links; these do, so that the SQL says something about aliases."""
    link = '<link rel="{}" href="{}">'.format
    rows = [
        (1, "http://a.example.com/en/x/1.html", ""), (2, "http://z.org/a/b.html", link("alternate canonical", "http://a.example.com/en/x/1.html")), (3, "http://z.org/a/c.html", link("canonical", "b.html")),
        (4, "http://z.org/q", '<meta http-equiv="refresh" content="0; url=../a/./c.html?x=1&amp;y=2">'), (5, "http://z.org/a/c.html?x=1&y=2", "<link href=/a/b.html rel=canonical>"), (6, "http://y.org/a", link("canonical", "//z.org/a/b.html#top")),
        (7, "http://example.com/en/7/z", ""), (8, "http://w.org/en/1", link("canonical", "http://example.com/en/7/z")), (9, "http://com/en/9", link("canonical", "http://w.org/en/1")), (10, "http://v.org", link("canonical", "?page=2")),
        (11, "http://v.org/?page=2", link("canonical", "http://net.org/es/1")), (12, "http://u.org/a/b/", link("canonical", "../../../es/./2/..")), (13, None, None), (14, "nothing", link("canonical", "http://com/en/9")), (15, "http://t.org/", link("canonical", "mailto:x@y.z")),
        (16, "http://s.org/1", link("stylesheet", "http://com/en/9")), (17, "http://org/es/2", ""), (18, "http://u.org/es/", ""), (1, "http://a.example.com/en/x/1.html", ""), (None, "http://com/en/9", None),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    assert differences(spark, QUERIES["op3_url_filter"], ORACLE_SQL["op3_url_filter"], str(tmp_path)) == ""
    got = {r.page_id: r.verdict for r in QUERIES["op3_url_filter"](spark, str(tmp_path)).collect()}
    assert {i for i, v in got.items() if v == "block"} >= {1, 2, 3, 4, 5, 6, 9, 17, 18} and {got[i] for i in (7, 8, 13, 14, 15, 16)} == {"allow"}


def test_topk_edge_vectors(spark):
    rows = [(0, [1.0, 0.5]), (100, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 0.0]), (6, [2.0]), (200, [3.0]), (None, [1.0, 1.0]), (7, []), (8, [-1.0, 0.001])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = {}
    for r in topk.nearest(df, F.col("id") % 100 == 0, 2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    own = 1024 * 1024 + 512 * 512
    assert got == {0: [(1, own), (100, own)], 100: [(0, own), (1, own)], 200: [(6, 3072 * 2048)]}


def test_topk_over_laid_out_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 64)
    monkeypatch.setattr(topk, "LAYOUT_COMPONENTS", 900)
    rng = np.random.default_rng(14)
    centres = rng.normal(size=(9, 6)) * 5
    v = (centres[rng.integers(0, 9, 900)] + rng.normal(size=(900, 6)) * 0.1).astype("float32")
    v[200:500] = v[200]  # a third of all rows
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000 + i, [1.0 * i]) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got: dict = {}
    for r in topk.nearest(df, F.col("id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    n = np.floor(1024 * v.astype(float)).astype(np.int64)
    for q in range(0, 900, 100):
        assert got[q] == sorted(((i, int(n[i] @ n[q])) for i in range(900) if i != q), key=lambda x: (-x[1], x[0]))[:10]
    assert [i for i, _ in got[1000]] == [1001, 1002]


def test_pipeline_stages_keep_their_promises(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    before = table(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "pii", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf).cache()
        assert after.columns == before.columns
        gone = before.join(after.select("doc_id"), "doc_id", "left_anti").count()
        assert gone == before.count() - after.count()
        if name == "near_dedup":
            assert near_dedup.near_duplicates(after).where("not kept").count() == 0
        if name == "decontamination":
            assert decontamination.matches(after, table(spark, sf, "benchmark")).where("n_hit > 0").count() == 0
        if name == "pii":
            assert gone == 0 and pii.personal_data(after).where("size(base) > 0").count() == 0
        before = after


def _classes(texts: list, width: int = 5) -> list:
    """The near-duplicate class of each text with words, None for others."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else None)
    cls = [None if s is None else i for i, s in enumerate(sets)]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and cls[i] != cls[j] and 100 * len(a & b) >= 80 * len(a | b):
                cls = [cls[j] if c == cls[i] else c for c in cls]
    return cls


def test_pipeline_as_brute_force_on_edge_rows(spark, tmp_path):
    import corpus_pipeline
    from collections import Counter

    from test_llm_small import brute_spans
    from tokenizers import Tokenizer

    sf, own = "/root/testdata/sf0.001", str(tmp_path)
    given = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "x", 1) for r in table(spark, sf, "documents").orderBy("doc_id").limit(90).collect()]
    item = table(spark, sf, "benchmark").where("text is not null").first().text
    word = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    texts = [(5000, None), (5001, ""), (5002, " \n "), (5003, word("a", 40)), (5003, word("a", 40)), (5004, word("a", 40) + " end"), (5005, word("b", 40)), (5005, word("c", 40)), (None, word("c", 40)), (None, word("d", 40)), (None, None), (5006, f"x {item} y"), (5007, "one short phrase here"), (5008, word("e", 7000)), (5009, "mail a.b@c.example.org or +1 (202) 555-0143, 10.0.0.7"), (5010, "é")]
    rows = given + [(i, t, None, None, None, "y", None) for i, t in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string, n int").repartition(3).write.parquet(f"{own}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, sf, name).write.parquet(f"{own}/{name}.parquet")
    spark.createDataFrame([(9999, "short phrase")], table(spark, sf, "benchmark").schema).write.mode("append").parquet(f"{own}/benchmark.parquet")

    docs = table(spark, own, "documents")
    key = lambda r: (str(r.doc_id), r.text)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        stage(spark, docs, own).write.parquet(f"{own}/{name}.parquet")
        docs = table(spark, own, name)
        assert docs.columns == table(spark, own, "documents").columns
        kept[name] = (before, docs.collect())
    before, after = kept["toxicity"]
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    assert not Counter(map(key, after)) - Counter(map(key, before)) and all(labels.get(r.doc_id) != 0 for r in before if r not in after)
    before, after = kept["near_dedup"]
    cls = dict(zip(map(key, before), _classes([r.text for r in before]), strict=True))
    assert not Counter(map(key, after)) - Counter(map(key, before))
    assert Counter(cls[key(r)] for r in after) == Counter({c: 1 if c is not None else sum(cls[key(r)] is None for r in before) for c in set(cls.values())})
    before, after = kept["decontamination"]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[k : k + 10]) for r in table(spark, own, "benchmark").collect() for w in [words(r.text)] for k in range(max(1, len(w) - 9)) if w}
    hit = lambda w: any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
    assert Counter(map(key, after)) == Counter(key(r) for r in before if not hit(words(r.text))) and len(after) < len(before)
    before, after = kept["pii"]
    assert len(before) == len(after) and Counter(str(r.doc_id) for r in before) == Counter(str(r.doc_id) for r in after)
    assert not any(brute_spans(r.text or "") for r in after) and Counter(key(r) for r in before if not re.search("[0-9@]", r.text or "")) <= Counter(map(key, after))
    assert all(r.text is None or r.n_chars == len(r.text) for r in after)

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in after:
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[str(r.doc_id), k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    pieces = corpus_pipeline.run(spark, own).collect()
    assert Counter((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces) == want
    by_sequence: dict = {}
    for r in pieces:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in s) <= 2048 and all(a + n == b for (a, n), (b, _) in zip(sorted(s), sorted(s)[1:])) and min(s)[0] == 0 for s in by_sequence.values())


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels", "benchmark"):
        table(spark, "/root/testdata/sf0.001", name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_template_takes_the_boilerplate_out_without_names(spark, sf_dir, monkeypatch):
    from collections import Counter

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html", html_text.host_of(F.col("url")).alias("host"))
    known = {r.host: dict(r.slots) for r in html_text.templates(pages.select(F.xxhash64("page_id", "url").alias("page"), "host", "html")).collect()}
    rows = pages.collect()
    hosts = Counter(r.host for r in rows)
    assert all(h in known for h, n in hosts.items() if n > 1)
    some = [r for r in rows if hosts[r.host] > 1]
    usual = [html_text.main_text(r.html, known[r.host]) for r in some]
    monkeypatch.setattr(html_text, "_DROPPED_TAGS", frozenset())
    monkeypatch.setattr(html_text, "_DROPPED_NAMES", frozenset())
    html_text.named.cache_clear()
    try:
        assert [html_text.main_text(r.html, known[r.host]) for r in some] == usual
        assert all(html_text.main_text(r.html, {}) != t for r, t in zip(some, usual, strict=True))
    finally:
        html_text.named.cache_clear()


def test_vectors_of_a_very_large_host_are_summed(spark):
    stats = spark.range(70_000).select(
        F.lit("h").alias("host"), F.lit(1).cast("long").alias("key"), F.lit(0).cast("long").alias("parent"), F.lit(0).cast("long").alias("text"), F.lit(1).cast("long").alias("pages"),
        F.lit(0x7FFFFFFFFFFE).alias("vector"), F.lit(0).cast("long").alias("before_lo"), F.lit(0).cast("long").alias("before_hi"), F.lit(1).cast("long").alias("chars"), F.lit(0).cast("long").alias("link_chars"),
    )
    r = html_text.token_totals(stats).first()
    assert r.vector == 70_000 * 0x7FFFFFFFFFFE % 0x7FFFFFFFFFFF and r.pages == 70_000
