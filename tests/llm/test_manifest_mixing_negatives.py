"""Manifest, mixing and hard negatives against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import odd
import pytest
from pyspark.sql import functions as F

from flightwatch.llm import manifest, mixing, negatives


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(digests):
    """Subroot, and the siblings (before, after) of each leaf on each level."""
    level, owners, ways = list(digests), [[i] for i in range(len(digests))], [[] for _ in digests]
    while len(level) > 1:
        up, mine = [], []
        for at in range(0, len(level), 8):
            run = level[at:at + 8]
            for j, own in enumerate(owners[at:at + 8]):
                for i in own:
                    ways[i].append(("".join(run[:j]), "".join(run[j + 1:])))
            up.append(sha(*run))
            mine.append([i for own in owners[at:at + 8] for i in own])
        level, owners = up, mine
    return level[0], ways


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    langs = defaultdict(list)
    for doc, source, lang, n, text in rows:
        bad = text
        if doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0 and text is not None:
            bad = lower(text)
        langs[lang].append((doc is not None, doc or 0, sha(*map(field, (doc, source, lang, n, text))), doc,
                            sha(*map(field, (doc, source, lang, n, bad)))))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: plain_tree([r[2] for r in sorted(langs[x], key=lambda r: r[:3])]) for x in order}
    root, tops = plain_tree([trees[x][0] for x in order]) if order else (None, [])
    out = []
    for x, top in zip(order, tops, strict=True):
        subroot, ways = trees[x]
        for (_, _, leaf, doc, bad), way in zip(sorted(langs[x], key=lambda r: r[:3]), ways, strict=True):
            node = bad
            for before, after in way + top:
                node = sha(before, node, after)
            out.append((doc, leaf, subroot, root, sha(*[s for side in way + top for s in side]), node, node == root))
    return out


def manifest_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, "de": 9}, {"en": 1, None: 64, "é": 65, "de": 3, "a": 1, "b": 2, "c": 1, "d": 7, "e": 8, "f": 1}])
def test_manifest_shapes(spark, sizes):
    ids = iter(random.Random(5).sample(range(-500, 5000), sum(sizes.values())))
    rows = [(next(ids), "s", lang, k, f"Text {k} É") for lang, n in sizes.items() for k in range(n)]
    got = manifest.verified(manifest_of(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(plain_manifest(rows))


def test_manifest_of_odd_rows(spark):
    docs = odd.documents(spark).select("*").unionByName(odd.documents(spark))
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = manifest.verified(docs).collect()
    assert Counter(map(tuple, got)) == Counter(plain_manifest(rows)) and any(not r["verified"] for r in got)
    assert manifest.verified(odd.none(spark)).count() == 0


def test_manifest_opens_only_what_is_asked(spark):
    rows = [(i, "s", "en" if i % 3 else "de", i, f"t{i}") for i in range(300)]
    made = manifest.build(manifest.document_leaves(manifest_of(spark, rows)).cache())
    asked = made.leaves.filter("doc_id in (0, 77, 299)")
    got = {r["doc_id"]: r for r in manifest.proofs(made, asked).withColumn("back", manifest.folded(F.col("leaf"), F.col("path"))).collect()}
    want = {r[0]: r for r in plain_manifest(rows)}
    assert set(got) == {0, 77, 299} and all(r["back"] == r["root"] == want[i][3] for i, r in got.items())
    assert all(sha(*[s for side in r["path"] for s in (side["before"], side["after"])]) == want[i][4] for i, r in got.items())


def test_manifest_any_other_change_is_seen(spark):
    rows = [(i, "s", "en", 1, "x") for i in range(20)]
    made = manifest.build(manifest.document_leaves(manifest_of(spark, rows)).cache())
    out = manifest.proofs(made).withColumn("back", manifest.folded(F.lit(sha("forged")), F.col("path")))
    assert out.filter("back = root").count() == 0


def plain_seats(votes, seats):
    got = [0] * len(votes)
    for _ in range(seats if any(votes) else 0):
        at = max((i for i, v in enumerate(votes) if v), key=lambda i: (Fraction(votes[i]) / (2 * got[i] + 1), -i))
        got[at] += 1
    return got


@pytest.mark.parametrize("votes, seats", [([5, 5, 5], 1), ([1, 0, 7, 100, 3, 3], 17), ([1000] * 9 + [1], 40), ([2], 5), ([3, 1, 1, 1, 1], 2), ([0, 0], 4)])
def test_seats(spark, votes, seats):
    parties = spark.createDataFrame([(i, float(v)) for i, v in enumerate(votes)], "place long, votes double")
    got = {r["place"]: r["quota"] for r in mixing.apportion(parties, seats, "votes", "place").collect()}
    assert [got[i] for i in range(len(votes))] == plain_seats(votes, seats)


def test_seats_of_shards(spark):
    rng = random.Random(2)
    cases = [(w, rng.randint(0, 3 * w // 4 + 2)) for w in [1, 3, 39, 40, 41, 79, 80, 81, 400, 401, 437, 1999] for _ in range(6)]
    df = (spark.createDataFrame([(i, w, q) for i, (w, q) in enumerate(cases)], "i long, words long, quota long")
          .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / 40)))))
    got = defaultdict(dict)
    for r in df.withColumn("n", mixing.shard_quota(F.col("quota"), F.col("words"), F.col("shard"), 40)).collect():
        got[r["i"]][r["shard"]] = r["n"]
    for i, (w, q) in enumerate(cases):
        parts = [40] * (w // 40) + ([w % 40] if w % 40 else [])
        assert [got[i][k] for k in range(len(parts))] == plain_seats(parts, q), (w, q)


def plain_targets(sizes, weights=(1, 2, 3), repeats=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, out, total = {s: weights[i % len(weights)] for i, s in enumerate(order)}, {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in out]
        left = total - sum(out.values())
        over = [s for s in free if Fraction(weight[s] * left, sum(weight[x] for x in free)) >= repeats * sizes[s]]
        if not over:
            return {**out, **{s: Fraction(weight[s] * left, sum(weight[x] for x in free)) for s in free}}
        out |= {s: repeats * sizes[s] for s in over}


SOURCES = [("a", 900), ("b", 3), ("c", 40), (None, 2), ("é", 700), ("Z", 0), ("d", 5000), ("e", 1)]


def mixing_rows():
    rng, rows, i = random.Random(1), [], 0
    for source, n in SOURCES:
        while n > 0 or (source == "Z" and i % 7):
            size = min(n, rng.choice([0, 1, 5, 30, 400]))
            rows.append((i if i % 11 else None, source, " ".join(["wörd"] * size) if size else rng.choice([None, "", " \n"])))
            n, i = n - size, i + 1
    return rows


def test_mix(spark):
    rows = mixing_rows()
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sizes = {s: sum(len((t or "").split()) for _, x, t in rows if x == s) for s in {r[1] for r in rows}}
    want = plain_targets(sizes)
    got = mixing.mix(docs, block=8, shard_blocks=16).withColumn("taken", mixing.taken(F.col("spans"))).collect()
    assert len(got) == len(rows)
    by = Counter()
    for r in got:
        assert r["target"] == pytest.approx(float(want[r["source"]])) and r["source_size"] == sizes[r["source"]]
        times = np.zeros(r["size"], int)
        for s in r["spans"]:
            assert 0 <= s["from"] < s["to"] <= r["size"]
            times[s["from"]:s["to"]] += s["times"]
        assert times.max(initial=0) <= 3 and r["taken"] == times.sum()
        by[r["source"]] += r["taken"]
    assert all(abs(by[s] - want[s]) <= 8 for s in sizes), [(s, by[s], float(want[s])) for s in sizes]
    again = mixing.mix(docs.repartition(5).withColumn("shard", F.lit("clash")), block=8, shard_blocks=16)
    key = [(str(r["doc_id"]), str(r["source"]), r["size"], str(r["spans"])) for r in got]
    assert sorted(key) == sorted((str(r["doc_id"]), str(r["source"]), r["size"], str(r["spans"])) for r in again.collect())
    other = mixing.mix(docs, block=8, shard_blocks=16, seed="other").withColumn("taken", mixing.taken(F.col("spans"))).collect()
    assert sorted(r["taken"] for r in other) != sorted(r["taken"] for r in got)


def test_mix_of_odd_rows(spark):
    got = mixing.mix(odd.documents(spark)).withColumn("taken", mixing.taken(F.col("spans"))).collect()
    assert len(got) == len(odd.ROWS) and all(r["target"] == r["source_size"] for r in got)
    assert abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 16 and all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix(odd.none(spark)).count() == 0
    wordless = spark.createDataFrame([(1, "a", None), (2, None, " ")], "doc_id long, source string, text string")
    assert [(r["size"], r["target"], r["spans"]) for r in mixing.mix(wordless).collect()] == [(0, 0.0, [])] * 2


def plain_negatives(rows):
    """rows: (id, label, vector), all of them taking part."""
    out = []
    for a, la, va in rows:
        if a % 100:
            continue
        scored = sorted((-int(np.dot(va, v)), i, lab) for i, lab, v in rows if i != a and len(v) == len(va))
        for s, p, _ in [x for x in scored if x[2] == la][:5]:
            window = [x for x in scored if x[2] != la and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(a, p, k, i, -s, -t) for k, (t, i, _) in enumerate(window, 1)]
    return out


def mined(spark, rows, **sizes):
    df = negatives.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, aims string, v string, block string"))
    df = df.cache()
    kept = [(r["vec_id"], r["label"], np.array(r["v"])) for r in df.collect()]
    return kept, negatives.mine(df, df.filter("vec_id % 100 = 0"), **sizes)


@pytest.mark.parametrize("spread", [0.05, 0.6, 5.0])
def test_hard_negatives(spark, spread):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 12))
    rows = []
    for i in range(700):
        v = centres[i % 6] * rng.choice([0.5, 1, 3]) + rng.normal(size=12) * spread
        rows.append((i * 5, [float(x) for x in v], int(rng.integers(3)), "", "", ""))
    rows += [(100_000 + k, rows[0][1], k % 2, "", "", "") for k in range(40)]  # ties
    rows += [(200_000, [0.0] * 12, 1, "", "", ""), (200_100, [0.0] * 12, 0, "", "", ""), (200_200, [1.0, -1.0], 0, "", "", ""),
             (200_201, [1.0, -0.9], 0, "", "", ""), (200_202, [1.0, -0.8], 1, "", "", ""), (200_300, [], 0, "", "", ""), (200_301, [], 0, "", "", ""),
             (200_302, [], 2, "", "", ""), (-100, rows[3][1], 2, "", "", "")]
    kept, df = mined(spark, rows, shard_rows=32, block_rows=4, references=6)
    got = df.collect()
    assert len(kept) == len(rows) and sorted(map(tuple, got)) == sorted(plain_negatives(kept)) and len(got) > 50


def test_hard_negatives_of_odd_rows(spark):
    bad = [(0, None, 1), (1, [1.0, None], 1), (2, [1.0, float("nan")], 1), (3, [1.0, float("inf")], 1), (None, [1.0, 1.0], 1), (100, [1.0, 2.0], None)]
    good = [(200, [1.0, 1.0], 1), (200, [1.0, 1.0], 1), (5, [1.0, 1.0], 1), (5, [1.0, 1.0], 1), (6, [0.9, 0.9], 2), (6, [0.9, 0.9], 2), (300, [-1.0, 0.01], 9)]
    df = mined(spark, [(*r, "", "", "") for r in bad + good])[1]
    # Repeated positives and negatives count as often as they occur; the anchor's own id never does.
    assert sorted(map(tuple, df.collect())) == sorted([(200, 5, k, 6, 131072, 117760) for k in (1, 2)] * 2)
    assert mined(spark, [(*r, "", "", "") for r in bad])[1].count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(8, 32))
    points = np.floor(256 * (centres[rng.integers(8, size=900)] * rng.choice([1e-3, 1, 40], size=(900, 1)) + rng.normal(size=(900, 32)) * 0.1))
    points[:5] = 0
    norms, units = negatives._unit(points)
    turned = negatives._unit(centres)[1]
    angles = np.arccos(np.clip(units @ turned.T, -1, 1))
    low, high = negatives.score_bounds(norms[:60], angles[:60], norms, angles, 32)
    exact = points[:60] @ points.T
    assert (low <= exact).all() and (exact <= high).all()
    big = points[5:60][norms[5:60] > 1000]
    best = np.sort(exact, axis=1)[:, -6]
    assert len(big) and (high < best[:, None]).mean() > 0.5  # most rows need no score


def test_scores_are_whole():
    a = np.array([[2.0 ** 30, 1.0]])
    assert negatives.scores(a, np.array([2.0 ** 30, 1.0])).tolist() == [2 ** 60 + 1]
    with pytest.raises(ValueError, match="64 bits"):
        negatives.scores(np.array([[1e30]]), np.array([1e30]))
