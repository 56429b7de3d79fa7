"""Neighbours, near duplicates, language, toxicity and rollups."""

import itertools
import math
import re

import numpy as np
import odd
import pandas as pd
import pytest
from conftest import SF

import __spark_entry__ as entry
from flightwatch.llm import graph, jaccard, language, neighbours, rollups, toxicity
from flightwatch.llm.tables import table

SMALL = "/root/testdata/sf0.01"


def plain_nearest(rows, queries, k):
    out = []
    for q, v in {q: v for q, v in queries}.items():
        near = sorted((math.sqrt(((np.asarray(v) - np.asarray(w)) ** 2).sum()), i) for i, w in rows if i != q and len(v) == len(w))
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near[:k])]
    return sorted(out)


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.normal(size=6).round(1).tolist()) for i in range(400)]
    good += [(1000 + i, [1.0] * 6) for i in range(150)] + [(7, good[7][1]), (2000, [1.0, 2.0]), (2100, [1.0, 2.5])]
    bad = [(3000, None), (3100, []), (3200, [0.0] * 6), (3300, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (3400, [math.nan] * 6),
           (3500, [math.inf] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").selectExpr("*", "'clash' AS shard", "1 AS dim", "1 AS v")
    vectors = neighbours.usable(df)
    asked = vectors.filter("vec_id % 100 = 0")
    got = sorted(tuple(r) for r in neighbours.nearest(vectors, asked, k=5, shard_rows=150, block_rows=3).collect())
    want = plain_nearest(good, [r for r in good if r[0] % 100 == 0], 5)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-12)
    loose = {tuple(r)[::2][:2] for r in neighbours.nearest(vectors, asked, k=5, relax=1.5, shard_rows=150).collect()}
    assert len(loose & {(r[0], r[2]) for r in want}) >= 0.5 * len(want)
    empty = neighbours.usable(df.limit(0))
    assert neighbours.nearest(empty, empty).collect() == []


def plain_components(rows):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(fold))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    name = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for (i, a), (j, b) in itertools.combinations(list(enumerate(sets)), 2):
            if name[i] is None or name[j] is None or name[i] == name[j] or not a or not b:
                continue
            if 100 * len(a & b) >= 75 * len(a | b):
                name[i] = name[j] = min(name[i], name[j])
                changed = True
    return sorted(((r[0], len(s), n) for r, s, n in zip(rows, sets, name, strict=True)), key=str)


def near(df):
    return sorted((tuple(r) for r in jaccard.near_duplicates(df).collect()), key=str)


def test_near_duplicates_of_odd_rows(spark):
    rows = [r for r in odd.ROWS if r[0] != 8] + [(8, "wort " * 4000, "de")]
    assert near(odd.documents(spark, rows)) == plain_components([r[:2] for r in rows])
    assert near(odd.none(spark)) == []


@pytest.mark.parametrize("tile", [1024, 8])
def test_near_duplicates_in_large_groups(spark, monkeypatch, tile):
    """A chain of copies of copies, a group around one text, and a common passage in unlike texts."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    rng = np.random.default_rng(3)

    def prose(n):
        return [f"w{x}" for x in rng.integers(0, 5000, n)]

    rows, base = [], prose(80)
    for i in range(40):  # every step changes a little: the ends are unlike
        rows.append((i, " ".join(base)))
        base = list(base)
        base[int(rng.integers(80))] = f"new{i}"
    core = prose(60)
    for i in range(100, 140):
        own = list(core)
        for _ in range(int(rng.integers(0, 3))):
            own[int(rng.integers(60))] = f"own{i}"
        rows.append((i, " ".join(own)))
    passage = prose(12)
    rows += [(i, " ".join(prose(int(rng.integers(3, 30))) + passage)) for i in range(200, 260)]
    rows += [(i, " ".join(passage + [f"z{i}"])) for i in range(300, 312)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near(df) == plain_components(rows)


def test_tree_bound_loses_nothing():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(np.concatenate([rng.choice(base, int(rng.integers(250, 400)), replace=False),
                                      rng.integers(0, 1 << 63, int(rng.integers(1, 60)), dtype=np.uint64)])) for _ in range(300)]
    sizes = np.asarray([len(s) for s in sets])
    points = jaccard.points_of([jaccard.counts_of(s) for s in sets])
    tree = jaccard.CountTree(points, sizes)
    kept = 0
    for i in range(0, 300, 7):
        found = set(tree.search(i).tolist())
        kept += len(found)
        for j in range(300):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (sizes[i] + sizes[j] - both):
                assert j in found
    assert kept < 43 * 300 / 2


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, 2000)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    name = {}
    for a, b in edges * 70:
        m = min(name.get(a, a), name.get(b, b))
        name[a] = name[b] = m
    assert got == {k: v for k, v in name.items() if k != 2000}


def test_network_gradients():
    net = language.Network(["a", "b"], cells=3, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(6)
    x, label, real = rng.integers(97, 101, (7, 4)), np.asarray([0, 1, 1, 0]), np.ones((7, 4))
    real[5:, 1] = 0
    _, g = net.gradients(x, label, real)
    for name, at in [("u", (0, 1, 2)), ("u", (1, 0, 7)), ("o", (4, 1)), ("c", (0,)), ("e", (98, 4)), ("e", (97 + 256, 8))]:
        value = net.p[name][at]
        net.p[name][at] = value + 1e-3
        up = net.gradients(x, label, real)[0]
        net.p[name][at] = value - 1e-3
        down = net.gradients(x, label, real)[0]
        net.p[name][at] = value
        assert abs((up - down) / 2e-3 - g[name][at]) < 2e-3, name


def test_language(spark):
    docs = table(spark, SMALL, "documents")
    net = language.train_on(docs)
    found = language.predict(docs, net).join(docs.select("doc_id", "lang"), "doc_id").withColumn("held", language.held_out(4, 2)).toPandas()
    held = found[found.held]
    assert len(held) > 100 and (held.lang_pred == held.lang).mean() > 0.97 and found.score.between(0, 1).all()
    rows = language.predict(odd.documents(spark), net).collect()
    assert len(rows) == len(odd.ROWS)
    for r in rows:
        if r.doc_id in (4, 5, 6, 7):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None:
            assert r.lang_pred in net.languages
    kept = language.recognised(odd.documents(spark), net)
    assert kept.columns == odd.documents(spark).columns and sorted(x or 0 for (x,) in kept.select("doc_id").collect()) == sorted(
        [1, 2, 3, 3, 8, 9, 10, 11, 12, 13, 0])
    assert language.predict(odd.none(spark), net).collect() == [] and not language.train_on(odd.none(spark)).languages
    assert {r.lang_pred for r in language.predict(odd.documents(spark), language.train_on(odd.none(spark))).collect()} == {"und"}


def plain_segments(x):
    """Maximal scoring segments by their definition, from the best one down."""
    def go(b, e):
        best = max(((sum(x[i:j]), -(j - i), -i, i, j) for i in range(b, e) for j in range(i + 1, e + 1)), default=(0,))
        if best[0] <= 1e-12:
            return []
        return go(b, best[3]) + [(best[3], best[4])] + go(best[4], e)
    return go(0, len(x))


def test_segments():
    rng = np.random.default_rng(7)
    for _ in range(300):
        x = [float(s) if s > 0 else -0.37 for s in np.where(rng.random(14) < 0.4, rng.random(14) * 2 + 0.01, 0)]
        got = toxicity.segments([(i, s) for i, s in enumerate(x) if s > 0], -0.37)
        assert [(b, e) for b, e, _ in got] == plain_segments(x)
        assert np.allclose([s for *_, s in got], [sum(x[b:e]) for b, e, _ in got])


def test_toxicity(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.train(docs, labels.filter(~toxicity.held_out()))
    found = toxicity.passages(docs, model).join(labels, "doc_id").filter(toxicity.held_out()).toPandas()
    assert len(found) > 500 and ((found.score >= 0.5) == found.toxic).mean() > 0.96
    rows = toxicity.passages(odd.documents(spark), model).collect()
    assert len(rows) == len(odd.ROWS) and all(0 <= r.score <= 0.5 for r in rows)
    term = max((t for t in model.terms if not t.endswith(b"*")), key=model.terms.get).decode()  # a whole word
    insult = spark.createDataFrame([(1, f"of the and {term} {term} the {term} of")], "doc_id long, text string")
    r = toxicity.passages(insult, model).first()
    assert r.score > 0.5 and (3, 7) in {(p.begin, p.end) for p in r.passages}
    assert toxicity.passages(odd.none(spark), model).collect() == []
    blank = toxicity.train(odd.documents(spark), labels.limit(0))
    assert {r.score < 0.5 for r in toxicity.passages(odd.documents(spark), blank).collect()} == {True}


def totals(store):
    return sorted((tuple(r) for r in store.totals().collect()), key=str)


def test_rollups(spark, tmp_path):
    store = rollups.Rollup(spark, str(tmp_path / "store"))
    rows = "doc_id long, source string, lang string, version string, n_tokens long"
    first = spark.createDataFrame([(1, "a", "en", "v1", 10), (2, "a", None, "v1", 5), (3, None, "de", "v1", None), (4, "b", "en", "v1", 7),
                                   (4, "b", "en", "v1", 7), (None, "b", "en", "v1", 1)], rows)
    assert totals(store) == []
    assert store.commit("one", upserts=first) and not store.commit("one", upserts=first)
    assert totals(store) == sorted([("a", "en", "v1", 1, 10), ("a", None, "v1", 1, 5), (None, "de", "v1", 1, 0), ("b", "en", "v1", 3, 15)], key=str)
    revised = spark.createDataFrame([(1, "a", "en", "v1", 12), (1, "a", "en", "v2", 3), (9, "c", "en", "v1", 4)], rows)
    assert store.commit("two", upserts=revised, deletes=spark.createDataFrame([(4,), (77,)], "doc_id long"))
    assert store.commit("none")
    after = sorted([("a", "en", "v1", 1, 12), ("a", "en", "v2", 1, 3), ("a", None, "v1", 1, 5), (None, "de", "v1", 1, 0), ("b", "en", "v1", 1, 1),
                    ("c", "en", "v1", 1, 4)], key=str)
    assert totals(store) == after
    # An attempt that never became visible, and one that lost the race, change nothing.
    first.selectExpr("source", "lang", "version", "1L AS n_docs", "n_tokens").write.parquet(str(tmp_path / "store/attempt-three-x/totals"))
    assert not store._publish("two", "attempt-three-x")
    assert totals(rollups.Rollup(spark, str(tmp_path / "store"))) == after
    assert store.commit("gone", deletes=spark.createDataFrame([(1, "v1")], "doc_id long, version string"))
    assert ("a", "en", "v2", 1, 3) in totals(store) and not any(r[:3] == ("a", "en", "v1") for r in totals(store))


def test_token_counts_of_odd_rows(spark):
    from test_text_operators import plain_ids
    got = rollups.token_counts(odd.documents(spark)).collect()
    want = [len(x) - 1 for x in plain_ids([r[1] for r in odd.ROWS])]
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == sorted((r[0] or 0, n) for r, n in zip(odd.ROWS, want, strict=True))


def test_rollup_query(spark):
    from test_text_operators import plain_ids
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    docs = docs[~docs.doc_id.isin(labels.doc_id[labels.quality == 0])]
    docs["n_tokens"] = [len(x) - 1 for x in plain_ids(docs.text)]
    want = docs.groupby(["source", "lang"], dropna=False).n_tokens.agg(["size", "sum"]).reset_index()
    got = entry.queries()["op8_token_rollups"](spark, SF).toPandas()
    assert set(got.version) == {"word_bpe_49k"}
    assert sorted(map(tuple, got[["source", "lang", "n_docs", "n_tokens"]].values.tolist())) == sorted(map(tuple, want.values.tolist()))


def pairs_at_the_threshold(n, seed=0):
    """Pairs of random sets of 57 / 76 = 75/100, of 64 and 69 shingles: the second has twice the groups."""
    rng = np.random.default_rng(seed)
    for _ in range(n):
        x = np.unique(rng.integers(0, 1 << 63, 90, dtype=np.uint64) * np.uint64(2))
        rng.shuffle(x)
        yield np.sort(x[:64]), np.sort(np.concatenate([x[:57], x[64:76]]))


def test_bound_keeps_pairs_with_different_numbers_of_groups(spark):
    sets = [s for pair in pairs_at_the_threshold(3000) for s in pair]
    assert {len(jaccard.counts_of(s)) for s in sets} == {32, 64}
    points = spark.createDataFrame([(i, len(s), jaccard.counts_of(s)) for i, s in enumerate(sets)], "sid long, n long, counts binary")
    pairs = spark.range(0, len(sets), 2).selectExpr("id AS u", "id + 1 AS v")
    pairs = pairs.unionByName(pairs.selectExpr("v AS u", "u AS v"))
    assert jaccard._bounded(pairs, points).count() == pairs.count()


def test_near_duplicates_at_the_threshold_across_numbers_of_groups(spark):
    rows = []
    for k in range(3000):
        shared = [f"s{k}x{i}" for i in range(61)]
        rows.append((2 * k, " ".join(shared + [f"a{k}x{i}" for i in range(7)])))
        rows.append((2 * k + 1, " ".join(shared + [f"b{k}x{i}" for i in range(12)])))
    found = near(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(found) == sorted((i, 64 if i % 2 == 0 else 69, i - i % 2) for i, _ in rows)


@pytest.mark.parametrize("column, bits", [("counts_of", 2), ("coarse_of", 4)])
def test_counts_never_promise_less_than_is_shared(column, bits):
    """Sets of unlike sizes, with crowded groups, against their real intersections."""
    rng = np.random.default_rng(6)
    count = getattr(jaccard, column)
    left, right = [], []
    for size in (1, 2, 5, 16, 17, 64, 250, 1000):
        for _ in range(60):
            base = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)
            base[: size // 3] >>= np.uint64(int(rng.integers(0, 40)))
            own = rng.integers(0, 1 << 63, int(rng.integers(1, size + 1)), dtype=np.uint64)
            left.append(np.unique(base))
            right.append(np.unique(np.concatenate([rng.choice(base, int(rng.integers(1, size + 1))), own])))
    sizes = [np.asarray([len(s) for s in side]) for side in (left, right)]
    shared = np.asarray([len(np.intersect1d(a, b)) for a, b in zip(left, right, strict=True)])
    most = jaccard.most_shared([count(s) for s in left], [count(s) for s in right], *sizes, bits)
    assert (most >= shared).all() and (most <= np.minimum(*sizes)).all()
    unlike = jaccard.most_shared([count(s) for s in left[-60:]], [count(s) for s in left[-1:] * 60], sizes[0][-60:], sizes[0][-1:].repeat(60), bits)
    assert (unlike[:-1] < jaccard.needed(1000, 1000)).all()


def test_rows_without_a_partner_go():
    rng = np.random.default_rng(7)
    for _ in range(40):
        block = rng.integers(0, 40, 150).astype(np.uint32)
        size = rng.integers(2000, 2900, 150)
        early, several = rng.random(150) < 0.5, rng.random(150) < 0.03
        kept = jaccard.paired(block, (size << 2 | early << 1 | several).astype(np.uint16))
        want = []
        for i in range(150):
            others = [j for j in range(150) if j != i and block[j] == block[i]]
            pair = [abs(size[i] - size[j]) <= jaccard.SIZE_REACH and (early[i] and size[i] <= size[j] or early[j] and size[j] <= size[i])
                    for j in others]
            if any(pair) or others and (several[i] or any(several[j] for j in others)):
                want.append(i)
        assert kept.tolist() == want


def test_sizes_that_fit_are_within_reach():
    n = np.arange(1, 200_000)
    largest = n * jaccard.DENOMINATOR // jaccard.NUMERATOR
    step = lambda x: (jaccard.SIZE_STEPS * np.log(x)).astype(np.int64)
    assert (step(largest) - step(n)).max() <= jaccard.SIZE_REACH


def test_rows_to_search_grow_in_proportion(spark, monkeypatch):
    """Forty texts just below the threshold that share the same shingles: one block of forty is searched, or a few,
    however long the texts are."""
    seen, search = [], jaccard._search

    def counting(rows, *more):
        seen.append(rows.count())
        return search(rows, *more)

    monkeypatch.setattr(jaccard, "_search", counting)
    for words in (200, 800):
        shared = [f"s{k}" for k in range(words * 84 // 100)]
        rows = [(i, " ".join(shared + [f"o{i}x{k}" for k in range(words - len(shared))])) for i in range(40)]
        assert near(spark.createDataFrame(rows, "doc_id long, text string")) == [(i, words - 4, i) for i in sorted(range(40), key=str)]
    assert 0 < seen[0] and seen[1] <= 4 * seen[0]
