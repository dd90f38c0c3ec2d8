"""Numpy parts of the training-data operators against brute force."""

from __future__ import annotations

import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from vendorlens.llm import decontamination as dec
from vendorlens.llm import html_text, near_dedup, packing, pii, substring_dedup, token_tables, tokens, topk
from vendorlens.llm.components import stars
from vendorlens.llm.words import blocks, windows

ODD = [None, "", "abc", "  ab c", "É a\nb", "x\ty\x0bz", "<|endoftext|> hi", "12 345,  6%%%\n", "漢字 かな", "\xa0q w", "it's  we'll\n"]


def some_texts(n: int, letters: str = "ab A9é.\t\n", seed: int = 1) -> list:
    rng = random.Random(seed)
    return [*ODD, *("".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n))]


@pytest.mark.parametrize("kind,pattern", [("space", r"[^\x20\x09-\x0D]+"), ("ascii", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words(kind, pattern):
    texts, seen = some_texts(500), {}
    for b in blocks(pa.array(texts), kind, True, 500):
        h = b.hashes()
        for i in range(b.lo, b.hi):
            want = re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), texts[i] or ""))
            span = range(b.first[i - b.lo], b.first[i - b.lo + 1])
            assert [b.word(k).decode() for k in span] == want
            for k, w in zip(span, want, strict=True):
                assert seen.setdefault(w, h[k]) == h[k]
    assert len(set(map(int, seen.values()))) == len(seen)


@pytest.mark.parametrize("width", [3, 20])
def test_windows_stay_in_rows(width):
    for b in blocks(pa.array(["a b c " * 10, "a b", "a b c " * 10]), "space", False):
        start, h = windows(b.hashes(), b.first, width)
        assert len(start) == 2 * (31 - width)
        half = len(h) // 2
        assert (h[:half] == h[half:]).all()


def test_suffix_arrays_find_every_window():
    rng = random.Random(2)
    for _ in range(30):
        width = rng.choice([2, 3, 5, 10])
        docs = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))) for _ in range(20)]
        items = [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 14))) for _ in range(5)]
        s = dec.Suffixes.of([str(i) for i in range(5)], items, width)
        for b in blocks(pa.array(docs), "ascii", True, 200):
            for i, r in enumerate(dec.shard_matches(b, s, width)):
                words = docs[b.lo + i].split()
                hit, found = [0] * len(words), set()
                for k, item in enumerate(items):
                    own = item.split()
                    w = min(width, len(own))
                    for p in range(len(own) - w + 1 if w else 0):
                        for q in range(len(words) - w + 1):
                            if words[q : q + w] == own[p : p + w]:
                                found.add(str(k))
                                hit[q : q + w] = [1] * w
                assert (r["n_words"], r["n_hit"], {x["item_id"] for x in r["items"]}) == (len(words), sum(hit), found)
                assert [k for x in r["spans"] for k in range(x["start"], x["stop"])] == [k for k, x in enumerate(hit) if x]
                for x in r["items"]:
                    own = items[int(x["item_id"])].split()
                    n, p, q = x["longest"], x["item_word"], x["doc_word"]
                    assert own[p : p + n] == words[q : q + n]
                    best = max((k for k in range(1, len(own) + 1) for p in range(len(own) - k + 1) if any(own[p : p + k] == words[q : q + k] for q in range(len(words) - k + 1))), default=0)
                    assert n == best


def test_chosen_path_recall():
    assert near_dedup.missed_per_tree(0.8) == pytest.approx(0.0625, abs=1e-6)
    rng = np.random.default_rng(3)
    met = 0
    for _ in range(300):  # pairs of sets with similarity 0.8
        common, left, right = np.split(rng.integers(0, 1 << 63, 90, dtype=np.uint64), [80, 85])
        rows = pa.array([near_dedup.minwise(np.concatenate([common, x])).tobytes() for x in (left, right)], pa.binary())
        nodes = [out.column(0).to_numpy().reshape(2, -1) for out in near_dedup._roots([pa.RecordBatch.from_arrays([pa.array([0, 1]), rows], names=["id", "sig"])])]
        met += any(set(n[0]) & set(n[1]) for n in nodes)
    assert met == 300


def test_stars():
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(zip(*stars(np.array([e[0] for e in edges]), np.array([e[1] for e in edges])), strict=True))
    assert {int(k): int(v) for k, v in got.items()} == {x: find(x) for x in range(300) if find(x) != x}


@pytest.mark.parametrize("few", [0, 2, 16])
def test_factors_are_the_longest_and_cover_every_repeat(few, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FEW", few)
    rng = random.Random(3)
    for _ in range(100):
        width = rng.choice([3, 5])
        refs = {i: [rng.choice("abcd"[: rng.choice([2, 4])]) for _ in range(rng.randint(0, 40))] for i in range(6)}
        block = substring_dedup.ReferenceBlock(list(refs), [" ".join(x) for x in refs.values()], width)
        doc, me = [*(rng.choice("abc") for _ in range(rng.randint(0, 50))), *refs[0]], rng.randint(0, 7)
        [own] = blocks(pa.array([" ".join(doc)]), "space", False)
        h = own.hashes()
        got = block.parsed(me, h, *windows(h, own.first, width))
        for f in got:
            n, source = f["stop"] - f["start"], refs[f["reference"]]
            assert n >= width and f["reference"] < me and source[f["place"] : f["place"] + n] == doc[f["start"] : f["stop"]]
            longer = doc[f["start"] : f["stop"] + 1]
            assert len(longer) == n or not any(x[q : q + n + 1] == longer for i, x in refs.items() if i < me for q in range(len(x) - n))
        earlier = {tuple(x[q : q + width]) for i, x in refs.items() if i < me for q in range(len(x) - width + 1)}
        want = {q for p in range(len(doc) - width + 1) if tuple(doc[p : p + width]) in earlier for q in range(p, p + width)}
        assert {q for f in got for q in range(f["start"], f["stop"])} == want
        assert set(range(len(doc))) - set(substring_dedup.kept_words(len(doc), got).nonzero()[0].tolist()) == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_as_the_library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path(name))
    special = ["hello <|endoftext|> world", "<|EndOfText|>", "a<|startoftext|>b <|endoftext|>", " <|endoftext|>\n"]
    texts = special + some_texts(300, "ab A9é.'\t\n s", 3) + ["é ́a ΑΣ ΣΑΣ", "—dash “q” z", "ẞ İ ﬁ", "a b", "\x01 x \x01"]
    for lo, hi, ids, offsets in tokens.encoded(pa.array(texts), public_tokenizers.path(name), 7, 2000):
        for i in range(lo, hi):
            assert ids[offsets[i - lo] : offsets[i - lo + 1]].tolist() == [*own.encode(texts[i] or "", add_special_tokens=False).ids, 7]


def test_sorted_string_table_round_trip(monkeypatch):
    monkeypatch.setattr(token_tables, "BLOCK_BYTES", 400)
    rng = np.random.default_rng(4)
    rows = {i: rng.integers(0, 70_000 if i % 5 == 0 else 60_000, rng.integers(0, 60)).astype(np.uint32) for i in sorted({-(1 << 63), -5, 0, 1 << 62, *rng.integers(-1000, 1000, 200).tolist()})}
    writer = token_tables.ShardWriter()
    records = [r for i, ids in rows.items() if (r := writer.add(i, ids))] + [writer.flush()]
    tail = token_tables.Tail(writer.tail()["data"])
    assert len(records) > 5 and [r["block"] for r in records] == list(range(tail.blocks))
    assert [(i, x.tolist()) for r in records for i, x in token_tables.entries(r["data"])] == [(i, x.tolist()) for i, x in rows.items()]
    assert all(dict(token_tables.entries(records[tail.block_of(i)]["data"]))[i].tolist() == x.tolist() for i, x in rows.items())
    assert [r["before"] for r in records] == np.cumsum([0, *(r["n_ids"] for r in records)])[:-1].tolist()
    assert tail.block_of(123456) is None and sum(tail.may_hold(i) for i in range(10_000, 12_000)) < 100
    assert (tail.entries, tail.ids) == (len(rows), sum(map(len, rows.values())))
    assert token_tables.ShardWriter().flush() is None and token_tables.ShardWriter().tail() is None
    with pytest.raises(ValueError):
        token_tables.Tail(b"\0" * 60)


def test_first_fit_decreasing():
    rng = random.Random(5)
    sizes = sorted((rng.randint(1, 100) for _ in range(500)), reverse=True)
    tree, rooms = packing.TournamentTree(100), []
    for n in sizes:
        want = next((k for k, r in enumerate(rooms) if r >= n), None)
        if want is None:
            want = len(rooms)
            rooms.append(100)
        assert tree.place(n) == (want, 100 - rooms[want])
        rooms[want] -= n


def test_tree_search_is_exact():
    rng = np.random.default_rng(7)
    v = rng.integers(-50, 50, (700, 4))
    v[300:400] = v[0]
    tree = topk.build_tree(np.arange(700), v, leaf=16)
    for q in range(0, 700, 50):
        want = sorted(((int(v[i] @ v[q]), -i) for i in range(700) if i != q), reverse=True)[:10]
        got = sorted(((s, -i) for s, i in topk.search(tree, q, v[q], 10, None)), reverse=True)
        assert got == want
        floor = want[4][0]
        assert sorted(((s, -i) for s, i in topk.search(tree, q, v[q], 10, floor)), reverse=True)[:5] == want[:5]
    big = np.array([[1 << 30, -(1 << 30)]])
    assert topk.products(big, big[0]).tolist() == [1 << 61]


def test_near_vectors_share_shards():
    rng = np.random.default_rng(13)
    centres = rng.integers(-5000, 5000, (16, 8))
    v = centres[rng.integers(0, 16, 4000)] + rng.integers(-50, 50, (4000, 8))
    code = topk.Layout(v[::4], 16).codes(v)
    assert code.max() < 32 and np.bincount(code).max() < 1200 and (topk.Layout(v[:3], 16).codes(v) == 0).all()
    queries = v[:200]
    floors = np.sort(queries @ v.T, 1)[:, -11]
    pruned = [len(topk.reaching(v[code == c].min(0), v[code == c].max(0), queries, floors)) for c in np.unique(code)]
    mixed = [len(topk.reaching(v[k::16].min(0), v[k::16].max(0), queries, floors)) for k in range(16)]
    assert np.mean(pruned) < 0.5 * 200 < np.mean(mixed)
    equal = topk.Layout(np.ones((500, 3), np.int64), 8)
    assert equal.leaves == 1 and topk.Layout(np.empty((0, 3), np.int64), 8).leaves == 1


def brute_spans(t: str) -> list:
    out = [("email", *m.span()) for m in pii.EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in pii.IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in pii.CARD.finditer(t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in pii.PHONE.finditer(t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2]))


def test_pattern_spans_as_brute_force():
    rng = random.Random(8)
    known = ["a@b.co ", "4111 1111 1111 1111", "+1 (202) 555-0143", "10.2.3.4", "x@y@z.com", "1.2.3.4444", "é", " ", ".", "-", "+", "(", "@", "7", "55"]
    texts = [None, "", *("".join(rng.choice(known) for _ in range(rng.randint(0, 12))) for _ in range(600))]
    seen = 0
    for lo, hi, rows in pii.spans_of(pa.array(texts), pii.trained_field()):
        for i, (base, all_) in zip(range(lo, hi), rows, strict=True):
            assert base == brute_spans(texts[i] or "")
            assert all(s in all_ for s in base)
            seen += len(base)
    assert seen > 300


def test_odd_numbers_and_long_runs():
    field = pii.trained_field()
    rng = random.Random(12)
    for _ in range(3000):
        t = "".join(rng.choice("aZ0.@-_%+ é²") for _ in range(rng.randint(0, 25)))
        assert sorted(pii.base_spans(t), key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2])) == brute_spans(t)
    table = " ".join(map(str, range(6000)))
    texts = ["1.2.3.²", "٣.٣.٣.٣", "9" * 5000 + ".1.1.1", "000001.2.3.4", "1" * 40_000, "x@" + "a" * 50_000, "@" * 50_000, *["call 5"] * 2047, table]
    began = time.process_time()
    rows = [r for *_, block in pii.spans_of(pa.array(texts), field) for r in block]
    assert time.process_time() - began < 10 and len(rows) == len(texts)
    assert rows[3][0] == [("ip", 0, 12)] and not any(base for i, (base, _) in enumerate(rows) if i != 3)


def test_field_learns_its_table_and_adds_spans():
    field = pii.trained_field()
    chains = pii.labelled_chains()
    wrong = sum(list(y) != list(got) for (_, y), got in zip(chains, field.decode([w for w, _ in chains]), strict=True))
    assert wrong <= 1
    text = "call (202) 555-0175. é jane@x.example.org, version 2.0.1 of 2024"
    [(_, _, [(base, spans)])] = list(pii.spans_of(pa.array([text]), field))
    assert [text[a:b] for _, a, b in spans] == ["(202) 555-0175", "jane@x.example.org"] and len(base) == 1
    assert pii.redact(text, spans) == "call [PHONE]. é [EMAIL], version 2.0.1 of 2024"


#: Rows that the field has not seen, labelled like its table.
HELD_OUT = (
    ("please mail tom.b@shop.example.com before noon", "o o E o o"),
    ("reach us: help_desk@unit7.example.org!", "o o E"),
    ('"anna-k@x1.example.net" wrote', 'E o'),
    ("gateway 172.16.4.200 answered", "o I o"),
    ("blocked 8.8.4.4, 9.9.9.9 today", "o I I o"),
    ("ping 10.255.0.3:443 failed", "o I o"),
    ("visa 4929 1234 5678 9012 is hers", "o C c c c o o"),
    ("paid by 5105105105105100.", "o o C"),
    ("card no. 6011-0009-9013-9424 ok", "o o C o"),
    ("amex 3782 822463 10005 billed", "o C c c o"),
    ("dial +1 (415) 555-0199 at once", "o P p p o o"),
    ("mobile +44 7700 900123", "o P p p"),
    ("fax (312) 555-0101", "o P p"),
    ("ring 646-555-0133 or 646-555-0134", "o P o P"),
    ("+33-1-45-67-89-00 rings", "P o"),
    ("call 415.555.0155 please", "o P o"),
    ("release 3.11.2 on 2023-11-05", "o o o o"),
    ("chapter 12 verse 7", "o o o o"),
    ("the years 1984 1999 2003", "o o o o o"),
    ("budget of 2,450,000.00 euros", "o o o o"),
    ("isbn 978-0-306-40615-7 sold", "o o o"),
    ("mp4 and x86 files", "o o o o"),
    ("order 884512 left at 14:45", "o o o o o"),
    ("hash 9f86d081884c7d65 stored", "o o o"),
    ("@bob liked page 12", "o o o o"),
    ("license 2.0 of 2004", "o o o o"),
    ("id 0042-aa-17 closed", "o o o"),
    ("peers 198.18.0.7, 198.18.0.9: idle", "o I I o"),
    ("4539 1488 0343 6467, thanks", "C c c c o"),
    ("since 1776 1812 1865 or so", "o o o o o o"),
    ("sms +61 2 9374 4000 tonight", "o P p p p o"),
    ("cc: first.last@dept.example.edu; bye", "o E o"),
    ("rows 100 200 300 400 500", "o o o o o o"),
    ("5 apples 6 pears 70 nuts", "o o o o o o"),
)


def test_field_on_rows_it_has_not_seen():
    field, right, found, there = pii.trained_field(), 0, 0, 0
    spans = lambda y: {(y[k], k, next((j for j in range(k + 1, len(y)) if y[j] != y[k].lower()), len(y))) for k in range(len(y)) if y[k] in "EICP"}
    for text, labels in HELD_OUT:
        [block] = blocks(pa.array([text]), "space", False)
        got = ["o"] * len(block.starts)
        chains = [at for _, at in pii.chains_of(block)]
        for at, y in zip(chains, field.decode([[block.word(i).decode() for i in at] for at in chains]), strict=True):
            for i, k in zip(at, y, strict=True):
                got[i] = pii.LABELS[k]
        a, b = spans(got), spans(labels.split())
        right, found, there = right + len(a & b), found + len(a), there + len(b)
    assert there == 23 and right >= 0.9 * found and right >= 0.9 * there


def test_viterbi_is_the_best_path():
    import itertools

    field = pii.trained_field()
    for words in (["4000", "1234", "1234"], ["+1", "(202)", "555-0143"], ["10.0.0.1"], ["7", "a@b.org", "3"]):
        e = np.array([field.emit[f].sum(0) for f in pii.chain_features(words)])
        score = lambda y: pii._START[y[0]] + sum(e[i, k] for i, k in enumerate(y)) + sum(field.move[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        best = max(itertools.product(range(len(pii.LABELS)), repeat=len(words)), key=score)
        assert score(tuple(field.decode([words])[0])) == pytest.approx(score(best))


def test_main_text():
    page = '<html><head><title>t</title></head><body><header>H</header><nav>N</nav><div class="x"><div class="post-body"><p>A &amp; B<b>c</b>d <p>E</div><div class="reader-comments">bad</div><form>f</form></div><footer>F</footer><script>var t="</p>";</script></body></html>'
    assert html_text.main_text(page, None) == "A & Bcd E"
    assert html_text.main_text("<div>hello <span>w</span>orld</div><nav>x</nav>", None) == "hello world"
    assert html_text.main_text("plain &lt; text", None) == "plain < text" and html_text.main_text(None, None) == ""
    assert html_text.main_text("<div>a</div><div>b</div>" * 2000, None).split() == ["a", "b"] * 2000
    assert html_text.main_text("<title>x<body><article>kept", None).endswith("kept")
    assert html_text.named("div", "ad") == (True, False) and html_text.named("div", "adapted") == (False, False)
    assert html_text.main_text("<body><header>h</header><article><header>in</header> text</article>", None) == "in text"
    deep = "<div>" * 30_000 + "deep text" + "</div>" * 30_000 + "</section>" * 30_000
    began = time.process_time()
    assert html_text.main_text(deep, None) == "deep text" and time.process_time() - began < 10


def test_long_chains_decode_as_in_one_go(monkeypatch):
    rng = random.Random(4)
    parts = ["jane@x.org", "+1", "(202)", "555-0143", "4000123412341234", "10.0.31.7", "12", "2024", "4000", "1234", "@", "1e9", "é7", "3.5"]
    chains = [[rng.choice(parts) for _ in range(n)] for n in (1, 7, 8, 9, 16, 40, 41, 300)]
    field = pii.trained_field()
    whole = field.decode(chains)
    monkeypatch.setattr(pii, "STRETCH", 8)
    assert all((a == b).all() for a, b in zip(whole, field.decode(chains), strict=True))
    for words, y in zip(chains[:2], whole, strict=False):
        e = np.array([field.emit[f].sum(0) for f in pii.chain_features(words)])
        best = e[0] + pii._START
        for row in e[1:]:
            best = (best[:, None] + field.move).max(0) + row
        own = pii._START[y[0]] + sum(e[i, k] for i, k in enumerate(y)) + sum(field.move[a, b] for a, b in zip(y, y[1:], strict=False))
        assert own == pytest.approx(best.max())


def test_a_text_of_numbers_takes_bounded_memory_and_time():
    tracemalloc.start()
    text = " ".join(str(i * 7919 % 100003) for i in range(500_000))  # 3 MB, one chain
    began = time.process_time()
    [(_, _, [(base, spans)])] = list(pii.spans_of(pa.array([text]), pii.trained_field()))
    took, peak = time.process_time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert base == [] and len(spans) < 3 and took < 60 and peak < 30 * len(text)


def test_words_are_cut_at_ascii_white_space_only():
    text = "a1\u00a0b  mail\x1cx@y.org\u2003 \t+1\n(202)\x85 555-0143"
    block = next(iter(blocks(pa.array([text]), "space", False)))
    (_, at), *_ = pii.chains_of(block)
    own = pii.Words(block, at)
    assert list(own) == [own[i] for i in range(len(own))] == re.findall(r"[^\x20\x09-\x0D]+", text)


def test_a_large_benchmark_costs_little_where_nothing_matches():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(5000)]
    text = lambda n: " ".join(vocabulary[i] for i in rng.integers(0, 5000, n))
    items = [text(200) for _ in range(4000)] + ["w1 w2 w3"]  # 800,000 suffixes
    shard = [text(1000) for _ in range(150)]
    shard[7] += " " + items[11]
    large, small = dec.Suffixes.of([str(i) for i in range(4001)], items, 10), dec.Suffixes.of(["11"], items[11:12], 10)
    took = {}
    for name, s in (("small", small), ("large", large)):
        [block] = list(blocks(pa.array(shard), "ascii", True))
        took[name] = min(_timed(lambda: list(dec.shard_matches(block, s, 10))) for _ in range(2))  # noqa: B023
        found = [r for r in dec.shard_matches(block, s, 10) if r["n_hit"]]
        assert [x["item_id"] for r in found for x in r["items"] if r["n_hit"] >= 200] == ["11"]
    assert took["large"] < 4 * took["small"] + 0.2


def _timed(f):
    began = time.process_time()
    f()
    return time.process_time() - began
