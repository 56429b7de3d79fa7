"""What a task holds or makes grows with its rows, not with their square or with what lies between them."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from flightwatch.llm import decontamination, graph, jaccard, tables


class Handed:
    """Stands for a DataFrame: the function that tasks would run is handed back."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        return run


def test_hits_take_no_memory_for_gaps(spark):
    """Thousands of short texts in one shard: the gaps between them are many times their words."""
    texts = [f"alpha beta gamma number {i}" for i in range(4000)]
    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(4000)), "text": texts})
    asked = {(b"alpha", b"beta", b"gamma"): [7], (b"number", b"5"): [8]}
    index = pa.Table.from_batches(list(decontamination.build_index(Handed(), {t for w in asked for t in w})(iter([rows]))))
    index = index.append_column("shard", pa.array([0], pa.int64())).combine_chunks().to_batches()
    look = decontamination._hits(Handed(), asked, 0)
    tracemalloc.start()
    found = pa.Table.from_batches(list(look(iter(index)))).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(r["doc_id"], r["items"]) for r in found if len(r["items"]) > 1] == [(5, [7, 8])]
    assert found[5]["runs"] == [{"b": 0, "e": 5}] and found[6]["runs"] == [{"b": 0, "e": 3}]
    assert peak < 40 << 20


def test_stretches_that_touch_are_one():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 40):
        begins = rng.integers(0, 60, n)
        ends = begins + rng.integers(1, 6, n)
        hit = np.zeros(70, bool)
        for b, e in zip(begins, ends, strict=True):
            hit[b:e] = True
        change = np.diff(np.concatenate([[0], hit, [0]]))
        b, e = decontamination.runs_of(begins, ends)
        assert b.tolist() == np.flatnonzero(change == 1).tolist() and e.tolist() == np.flatnonzero(change == -1).tolist()


def test_texts_do_not_move_to_meet_the_contaminated(spark, tmp_path):
    item = " ".join(f"word{i}" for i in range(13))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, item), (2, "clean"), (3, None), (None, item + " x")], "doc_id long, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3]


def counted(monkeypatch, name):
    """Rows that ``name`` reads and makes, call by call."""
    calls, run = [], getattr(jaccard, name)

    def counting(rows, *more):
        made = run(rows, *more)
        calls.append((rows.count(), (made[0] if isinstance(made, tuple) else made).count()))
        return made

    monkeypatch.setattr(jaccard, name, counting)
    return calls


@pytest.mark.parametrize("tile, linked", [(1024, False), (16, False), (16, True)])
def test_search_makes_no_more_rows_than_it_reads(spark, monkeypatch, tile, linked):
    """A large group of texts of which no two are quite alike enough; with ``linked`` every third has a partner."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    calls = counted(monkeypatch, "_search"), counted(monkeypatch, "_joined")
    shared = [f"s{k}" for k in range(170)]
    rows = [(i, " ".join(shared + [f"o{i}x{k}" for k in range(30)])) for i in range(90)]
    if linked:
        rows += [(100 + i, " ".join(shared + [f"o{i}x{k}" for k in range(20)] + [f"p{i}x{k}" for k in range(10)])) for i in range(0, 90, 3)]
    found = sorted(tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == [(i, 196, i - 100 if i >= 100 else i) for i, _ in rows]
    assert calls[0] and calls[1] and all(made <= read * (-(-len(rows) // tile)) for call in calls for read, made in call)


def test_a_group_around_a_text_is_joined_without_a_search(spark, monkeypatch):
    """Copies that are like one text, and not like each other."""
    calls = counted(monkeypatch, "_joined")
    core = [f"s{k}" for k in range(160)]
    rows = [(0, " ".join(core))]
    for i in range(1, 70):
        own = list(core)
        for k in (i, i + 30, i + 80):
            own[k] = f"a{i}x{k}"
        rows.append((i, " ".join(own)))
    sets = [jaccard.Hasher().sets([t])[0] for _, t in rows]
    assert jaccard.reaches(sets[0], sets[1:]).all() and jaccard.reaches(sets[1], sets[2:]).mean() < 0.2
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in found} == {0}
    assert all(read == 0 for read, _ in calls)


def test_crowded_blocks_with_mostly_the_same_sets_are_searched_as_one(spark, monkeypatch):
    """A large group of near copies shares many passages, each of them with a few copies left out."""
    calls = counted(monkeypatch, "_joined")
    rng = np.random.default_rng(3)
    core = [f"s{k}" for k in range(160)]
    rows = []
    for i in range(120):
        own = list(core)
        for k in rng.choice(32, 3, replace=False).tolist():
            own[5 * k] = f"a{i}x{k}"
        rows.append((i, " ".join(own)))
    sets = jaccard.Hasher().sets([t for _, t in rows])
    name = list(range(120))
    for i, s in enumerate(sets):
        for j in np.flatnonzero(jaccard.reaches(s, sets)).tolist():
            a, b = sorted((name[i], name[j]))
            name = [a if n == b else n for n in name]
    assert 1 < len(set(name)) < 120
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == dict(enumerate(name))
    assert calls and all(read <= 2 * len(rows) for read, _ in calls)


def test_few_edges_are_not_exchanged(spark, monkeypatch):
    """Paths, a star and a loop, kept in one partition and dealt out."""
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (200, 201)]
    want = {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}
    plans, write = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df))[1])
    table = spark.createDataFrame(edges, "u long, v long")
    assert {r["node"]: r["component"] for r in graph.components(table).collect()} == want
    assert len(plans) > 2 and not any("Exchange hashpartitioning" in p for p in plans[1:])
    monkeypatch.setattr(graph, "FEW_EDGES", -1)
    assert {r["node"]: r["component"] for r in graph.components(table).collect()} == want


def test_rows_are_handed_to_python_in_small_batches(spark, monkeypatch):
    """A batch lies outside the heap on both sides; by default one holds all texts of a task."""
    found, write = [], jaccard.settled
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1024, "spark.sql.execution.arrow.maxBytesPerBatch": 1 << 20}
    before = {k: spark.conf.get(k, None) for k in limits}
    monkeypatch.setattr(jaccard, "settled", lambda df: (found.append({k: spark.conf.get(k, None) for k in limits}), write(df))[1])
    docs = spark.createDataFrame([(i, f"a b c d e f g h i j k l m n o p q r s t {i % 3}") for i in range(6)], "doc_id long, text string")
    assert sorted(r["component_id"] for r in jaccard.near_duplicates(docs).collect()) == [0] * 6
    assert found and all(f[k] and 0 < int(f[k]) <= most for f in found for k, most in limits.items())
    assert {k: spark.conf.get(k, None) for k in limits} == before


def test_batches_are_bounded_by_rows_and_bytes_and_lower_limits_stay(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]}, pa.schema([("n", pa.int64())]))

    def most(width):
        rows = spark.range(0, 5000, 1, 1).selectExpr("id AS doc_id", f"repeat('x', {width}) AS text")
        return max(r["n"] for r in rows.mapInArrow(sizes, "n long").collect())

    with tables.small_batches(spark):
        assert most(1) == 1024 and most(10_000) < 150
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        with tables.small_batches(spark):
            assert most(1) == 100
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "100"
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_run_of_texts_keeps_its_shingles_once(spark, monkeypatch):
    """Shingles of a run are kept in one array, not in an array for each text and then once more."""
    monkeypatch.setattr(jaccard, "FREQUENT_RUN", 1 << 20)
    monkeypatch.setattr(jaccard, "HASHED_BYTES", 1 << 13)
    every = pa.RecordBatch.from_pydict({"doc_id": list(range(18_000)), "text": [" ".join(f"{i}x{k}" for k in range(60)) for i in range(18_000)]})
    tracemalloc.start()
    texts = sum(int(not k) for b in jaccard._described(Handed())(iter([every])) for k in b.column("kind").to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert texts == 18_000 and peak < 15 << 20


def test_runs_of_texts_tell_frequent_shingles_however_they_are_cut(spark, monkeypatch):
    """Runs that hold less than a text, one text, some texts and all."""
    texts = [" ".join(f"w{k}" for k in range(20))] * 2 + [" ".join([f"w{k}" for k in range(20)] + [f"o{i}"]) for i in range(8)] + ["a", "", None]
    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    for run, want in ((10, 0), (17, 0), (60, 48), (10_000, 16)):
        monkeypatch.setattr(jaccard, "FREQUENT_RUN", run)
        made = pa.Table.from_batches(list(jaccard._described(Handed())(iter([rows])))).to_pylist()
        assert [r["doc_id"] for r in made if r["kind"] == 0] == list(range(len(texts)))
        told = [r for r in made if r["kind"] == 1]
        assert len(told) == want and all(3 <= r["n"] <= 9 for r in told), (run, len(told))


def test_prefixes_are_sent_in_parts(spark, monkeypatch):
    """All shingles of the prefixes arrive, a bounded number of bytes at a time."""
    class Packed(Handed):
        def mapInArrow(self, run, _):  # noqa: N802
            self.run = run
            return self

        def withColumn(self, *_):  # noqa: N802
            return self

        groupBy = withColumn

        def applyInPandas(self, *_):  # noqa: N802
            return self.run

    rows = pa.RecordBatch.from_pydict({"text": [" ".join([f"c{k}" for k in range(30)] + [f"{i}x{k}" for k in range(30)]) for i in range(200)]})

    def sent(most):
        monkeypatch.setattr(jaccard, "SENT_BYTES", most)
        batches = list(jaccard._signatures(Packed(), np.zeros(1, np.uint64), 50)(iter([rows])))
        return batches, sorted((r["bucket"], r["straight"], r["shingles"], r["sids"], r["facts"]) for b in batches for r in b.to_pylist())

    (many, a), (few, b) = sent(2000), sent(4 << 20)
    assert a == b and len(many) > len(few) and all(b.num_rows == 1 or sum(len(r["shingles"]) + len(r["sids"]) + len(r["facts"]) for r in b.to_pylist()[:-1]) < 2000 for b in many)
