"""Decontamination, packing, sharding, personal data and pages against plain versions."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import odd
import public_tokenizers
import pytest
from conftest import SF
from tokenizers import Tokenizer

from flightwatch.llm import decontamination, packing, pii, sharding, wrappers
from flightwatch.llm.tables import table

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def plain_contamination(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i:i + 13]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, got = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i:i + n])) in windows:
                    hit |= set(range(i, i + n))
                    got |= windows[g]
        ids = hashlib.sha256(",".join(sorted(got)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(got), ids, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def contaminated(spark, docs, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contamination(docs, benchmark).drop("runs", "items")
    return sorted((tuple(r) for r in found.collect()), key=str)


ITEMS = [(1, odd.PROSE), (2, odd.PROSE), (3, "One TWO"), (4, None), (5, ""), (6, "wort " * 13), (7, "never seen " * 9)]


@pytest.mark.parametrize("block", [1 << 16, 16])
def test_contamination_of_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)  # small blocks take the path of many test sets
    rows = [r for r in odd.ROWS if r[0] != 8] + [(8, "wort " * 400, "de")]
    got = contaminated(spark, odd.documents(spark, rows), ITEMS)
    assert got == plain_contamination([(r[0], r[1]) for r in rows], ITEMS)


def test_contamination_of_a_table(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    got = contaminated(spark, table(spark, SF, "documents"), items)
    assert got == plain_contamination(docs, items) and any(r[5] for r in got)


def test_contamination_of_empty_tables(spark):
    assert contaminated(spark, odd.none(spark), ITEMS) == []
    assert {r[2] for r in contaminated(spark, odd.documents(spark), [])} == {0}


def test_phrases_and_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c a b"), (2, "c x x b x a"), (None, "a b")], "doc_id long, text string")
    index = decontamination.build_index(docs)
    assert sorted(map(str, map(tuple, decontamination.phrase_matches(index, ["A b", "", "c a"]).collect()))) == sorted(
        map(str, [(1, 0, 0), (1, 0, 3), (None, 0, 0), (1, 2, 2)]))
    near = {r[0] for r in decontamination.proximity_matches(index, ["c b"], 3).collect()}
    assert near == {1, 2} and {r[0] for r in decontamination.proximity_matches(index, ["c b"], 2).collect()} == {1}


def plain_ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing_round_trip(spark, capacity):
    docs = odd.documents(spark)
    rows = packing.pack(docs, capacity=capacity).collect()
    want = Counter()
    for r, ids in zip(odd.ROWS, plain_ids([r[1] for r in odd.ROWS]), strict=True):
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.asarray(ids[at:at + capacity], "<u4")
            want[r[0], k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    assert packing.pack(odd.none(spark)).collect() == []


def fewest(sizes, capacity):
    """Fewest bins, by trying everything."""
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] + sizes[i] <= capacity:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        bins.append(sizes[i])
        go(i + 1, bins)
        bins.pop()

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best


def test_reduction_never_costs_a_bin():
    rng = np.random.default_rng(1)
    for _ in range(300):
        capacity = int(rng.integers(8, 40))
        sizes = rng.integers(1, capacity + 1, int(rng.integers(1, 9))).tolist()
        slots = packing.Slots()
        rest = packing.reduce_sizes(Counter(sizes), capacity, slots)
        assert slots.bins + fewest([s for s, n in rest.items() for _ in range(n)], capacity) == fewest(sizes, capacity), (capacity, sizes)
        packed = packing.plan_bins(Counter(sizes), capacity)
        assert packed.used == Counter(sizes)


def test_shards(spark):
    rows = sharding.balanced_shards(odd.documents(spark), shards=4).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd.ROWS)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    for k in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    by_id = sorted((r.doc_id or -1, r.shard) for r in rows)
    assert [s for _, s in by_id] == sorted(s for _, s in by_id)
    assert sharding.balanced_shards(odd.none(spark)).collect() == []
    even = sharding.balanced_shards(table(spark, SF, "documents"), 4).groupBy("shard").sum("size").collect()
    assert max(r[1] for r in even) - min(r[1] for r in even) < 60_000


def plain_spans(text):
    found = []
    for at, (kind, pattern) in enumerate([
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
            if {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in m[0].split(".")),
                    "card": 12 <= len(d) <= 19 and sum(t - 9 * (t > 9) for t in twice) % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]:
                found.append((m.start(), at, m.end(), kind))
    return sorted(found)


PRIVATE = [
    "a@b.co_x@y.org a@b.com-x@y.org ..@-.- @x.y a@b", "1.2.3.4.5.6.7.8 0001.2.3.4 256.1.1.1 1.2.3.255.", "4111 1111 1111 1111-0 4111-1111-1111-1111",
    "+1 (255) 555-8013+49 30 1234567 (x) +1 2", "𝔘é 4111111111111111 é a@b.de", "9" * 5000 + " +" + "1(" * 3000, "a" * 20_000 + "@", "a@b.c " * 1500,
    "1.2.3.4 " * 300, "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", None, "", "IBAN GB82 WEST 1234 5698 7654 32 and DE89370400440532013000, not DE88370400440532013000",
    "SSN 123-45-6789 but 123-45-6789" + " far" * 30 + " 987-65-4321",
]


def test_pii_spans(spark):
    docs = spark.createDataFrame(list(enumerate(PRIVATE)), "doc_id long, text string")
    for r in pii.pii_spans(docs).collect():
        base = [(s.start, s.at, s.end, s.kind) for s in r.pii if s.at < 4]
        assert base == plain_spans(r.text), r.text
        assert all(s.match == r.text[s.start:s.end] for s in r.pii)
        extra = [s.match for s in r.pii if s.at >= 4]
        if r.doc_id == 12:
            assert extra == ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"]
        elif r.doc_id == 13:
            assert extra == ["123-45-6789", "123-45-6789"]


def test_pii_of_odd_rows(spark):
    docs = odd.documents(spark)
    found = pii.pii_spans(docs, keep=["doc_id", "text"]).collect()
    assert len(found) == len(odd.ROWS) and all([(s.start, s.at, s.end, s.kind) for s in r.pii] == plain_spans(r.text) for r in found)
    clean = pii.redact(docs, length_col="n_chars")
    assert clean.columns == docs.columns
    by_id = {r.doc_id: r for r in clean.collect()}
    assert by_id[13].text == "[PHONE] call [EMAIL], 10.0.0.300 [IP]" and by_id[13].n_chars == len(by_id[13].text)
    assert by_id[4].text is None and by_id[1].text == odd.PROSE * 3 and by_id[13].size == "clash"
    assert pii.redact(odd.none(spark)).collect() == []


def test_redaction_of_overlaps(spark):
    docs = spark.createDataFrame([(1, "x +4111111111111111 y 10.0.0.1@a.bc")], "doc_id long, text string")
    assert pii.redact(docs).first().text == "x [CARD] y [EMAIL]" or pii.redact(docs).first().text == "x +[CARD] y [EMAIL]"


PAGE = ("<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t='</p>';</script></head><body>"
        "<nav><ul><li><a href='/a'>Menu %d</a></li></ul></nav><div class='cookie-notice'>We use cookies</div>"
        "<article><h1>Head %d</h1><p>One  &lt;b&gt;\n text<b>bold</b>%d<br>line <p>Second&nbsp;%d</article>"
        "<section id=comments><p>Nice!</p></section><aside>side</aside><footer>foot</footer></body></html>")


def page(k):
    return PAGE % (k, k, k, k)


def test_pages(spark):
    rows = [(k, f"https://h.example.com/{k}", page(k)) for k in range(30)]
    rows += [(100, None, None), (101, "x", ""), (None, "https://h.example.com/9", page(7)), (102, "https://one.example/", "<p>plain <i>te</i>xt"),
             (103, "https://h.example.com/l", "<article>" + "<p>word " * 20_000), (104, "https://b.example/", "<article><p>cut <b>of"),
             (104, "https://b.example/", "<article><p>cut <b>of"), (105, "https://b.example/", "a < b <!-- c --> d <script>no")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS host", "'clash' AS wrapper", "1 AS _nth")
    got = {}
    for r in wrappers.extract(docs).collect():
        got.setdefault(r.page_id, []).append(r)
        assert r.n_chars == len(r.text)
    assert sum(map(len, got.values())) == len(rows)
    assert all(got[k][0].text == f"Head {k} One <b> textbold{k} line Second {k}" for k in range(30))
    assert got[100][0].text == got[101][0].text == "" and got[None][0].text.startswith("Head 7") and got[102][0].text == "plain text"
    assert got[103][0].n_chars == 20_000 * 5 - 1 and [r.text for r in got[104]] == ["cut of"] * 2 and got[105][0].text == "a < b d"
    assert wrappers.extract(docs.limit(0)).collect() == []


def test_wrapper_learns_template_text():
    pages = [f"<body><div class=top>My site</div><article><p>text {k} {'abc' * (9 + k)}</p><p>All rights reserved</p></article></body>" for k in range(8)]
    wrapper = wrappers.induce(pages)
    article = wrappers.step(wrappers.step(0, "body"), "article")
    assert wrapper["root"] == article
    assert [wrappers.step(article, "p"), "All rights reserved"] in wrapper["steady"]
    kept = {"root": wrapper["root"], "steady": {tuple(x) for x in wrapper["steady"]}}
    assert wrappers.main_text(pages[3], kept) == "text 3 " + "abc" * 12
    assert wrappers.induce(pages[:1])["root"] is None and wrappers.induce([pages[0]] * 5)["steady"] == []


def test_tree_matching_is_the_best_one():
    def best(a, b):
        if a.key != b.key:
            return 0
        x, y = a.children, b.children
        return 1 + max((sum(best(x[i], y[j]) for i, j in zip(p, q, strict=True)) for n in range(min(len(x), len(y)) + 1)
                        for p in combinations(range(len(x)), n) for q in combinations(range(len(y)), n)), default=0)

    trees = [wrappers.read_page(h, tree=True)[1] for h in (
        "<div><p>a<ul><li>x<li>y</ul><p>b</div><div><h2>t</h2></div>", "<div><ul><li>x</ul><p>b<p>c</div><h2>z</h2><div><h2>t</h2><p>q</div>",
        "<div><h2>t</h2></div><div><p>a<p>b<ul></ul></div>")]
    for a in trees:
        for b in trees:
            size, pairs = wrappers.match_trees(a, b)
            assert size == best(a, b) == len(pairs)


TEASED = ("<html><body><div class=story><h1>Title %d</h1>%s</div><div class=cards><article><p>Teaser %d</p></article>"
          "<article><p>Other %d</p></article></div></body></html>")


def test_wrapper_decides_over_article_tags(spark):
    """The body text stands in a div, and teaser cards beside it are articles."""
    body = ["".join(f"<p>page {k} says {i} {'xyz' * (k % 5 + 9)}</p>" for i in range(6)) for k in range(12)]
    rows = [(k, f"https://t.example/{k}", TEASED % (k, body[k], k, k)) for k in range(12)]
    rows.append((50, "https://t.example/other", "<html><body><article><p>another layout</p></article></body></html>"))
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(12):
        assert got[k] == f"Title {k} " + " ".join(f"page {k} says {i} {'xyz' * (k % 5 + 9)}" for i in range(6))
    assert got[50] == "another layout"


def test_linked_text_in_the_place_stays(spark):
    body = ["".join(f"<p>page {k} says {i} {'xyz' * (k % 5 + 9)}</p>" for i in range(6)) for k in range(12)]
    rows = [(k, f"https://l.example/{k}", f"<html><body><div class=story><h2><a href=/{k}>Linked head {k}</a></h2>{body[k]}"
             f"<ul><li><a href=/r>Reference {k}</a></ul></div><div class=foot><a href='/x'>Other {k}</a></div></body></html>") for k in range(12)]
    rows.append((60, "https://none.example/", "<html><body><p>plain</p><p><a href='/x'>only a link</a></p></body></html>"))
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(12):
        assert got[k] == f"Linked head {k} " + " ".join(f"page {k} says {i} {'xyz' * (k % 5 + 9)}" for i in range(6)) + f" Reference {k}"
    assert got[60] == "plain"


@pytest.mark.parametrize("around", [
    '<body class="has-sidebar"><article>{}</article></body>', '<body class="sidebar"><div class="widget wide"><article>{}</article></div></body>',
    '<body><article class="post comments-open">{}</article></body>', '<body><div id="share" class="page"><div class="text">{}</div></div></body>'])
def test_names_do_not_empty_an_article(spark, around):
    """Class names of everyday pages around and inside the text; real comments, adverts and menus still go."""
    def body(k):
        return (f'<h1>Title {k}</h1><p class="social">page {k} {"abc " * (k % 4 + 5)}</p><p id="related">more {k * 7}</p>'
                f'<div class="ad">buy {k}</div>')
    rows = [(k, f"https://n.example/{k}", f'<nav>Home {k}</nav>{around.format(body(k))}<div class="comments"><p>first! {k}</p></div>') for k in range(12)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(12):
        assert got[k] == f"Title {k} page {k} {' '.join(['abc'] * (k % 4 + 5))} more {k * 7}"


def test_deep_and_broken_pages(spark):
    """Deep nesting, open inline elements, stray end tags: read to the end, in time, and learned from without recursion."""
    import time
    deep = lambda k, n: "<div>" * n + f"<p>deep text {k} {'xyz' * (k + 9)}</p>" + "</div>" * n
    odd_pages = ["<b>" * 5000 + "start" + "</i></div>" * 20_000 + "<p>end", "<h1>" * 5000 + "start" + "<p>mid</p>" * 3000 + "end",
                 "<div>" * 20_000 + "bottom", "<ul>" + "<li>x" * 5000, "<p><b>" * 3000 + "y"]
    rows = [(k, f"https://deep.example/{k}", deep(k, 1200)) for k in range(3)]
    rows += [(10 + k, f"https://deep2.example/{k}", deep(k, 60)) for k in range(8)]
    rows += [(100 + k, f"https://odd.example/{k}", page) for k, page in enumerate(odd_pages)]
    start = time.time()
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert time.time() - start < 60
    assert all(got[k] == f"deep text {k} {'xyz' * (k + 9)}" for k in range(3)) and all(got[10 + k] == f"deep text {k} {'xyz' * (k + 9)}" for k in range(8))
    assert got[100] == "start end" and got[101].startswith("start mid") and got[101].endswith("mid end") and got[102] == "bottom"
    assert got[103] == " ".join(["x"] * 5000) and got[104] == "y"
