"""The stages of the pipeline against plain versions, each on its own input."""

import corpus_pipeline
import odd
from conftest import SF
from test_models import plain_components
from test_text_operators import FOLD, plain_contamination, plain_ids, plain_spans  # noqa: F401

from flightwatch.llm.tables import settled, table


def test_stages(spark):
    docs = table(spark, SF, "documents")
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        out = settled(stage(spark, docs, SF))
        after = [r.asDict() for r in out.collect()]
        ids = sorted(r["doc_id"] for r in after)
        if name != "packing":
            assert out.columns == docs.columns
        if name == "language":
            assert ids == sorted(r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or ""))
        elif name == "near_duplicates":
            groups = plain_components([(r["doc_id"], r["text"]) for r in before])
            assert ids == sorted(i for i, _, c in groups if i == c) and len(ids) < len(before)
        elif name == "decontamination":
            dirty = {r[0] for r in plain_contamination([(r["doc_id"], r["text"]) for r in before], items) if r[5]}
            assert dirty and ids == sorted(r["doc_id"] for r in before if r["doc_id"] not in dirty)
        elif name == "pii":
            texts = {r["doc_id"]: r["text"] for r in after}
            for r in before:
                spans = plain_spans(r["text"])
                assert bool(spans) == (texts[r["doc_id"]] != r["text"])
                assert not plain_spans(texts[r["doc_id"]])
            assert all(r["n_chars"] == len(r["text"]) for r in after if "[" in r["text"])
        else:
            total = sum(len(x) for x in plain_ids([r["text"] for r in before]))
            assert sum(r["length"] for r in after) == total
        docs = out


def test_run_of_odd_rows(spark, tmp_path):
    odd.documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "never seen")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(r.doc_id or 0 for r in corpus_pipeline.run(spark, str(tmp_path)).filter("piece = 0").collect())
    assert got == [0, 1, 8, 9, 10, 11, 13]  # 3 is a near duplicate of 1


def test_run_of_empty_tables(spark, tmp_path):
    odd.none(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
