"""The registered queries: their SQL on the same tables, or a plain version, and their columns."""

import duckdb
import pandas as pd
import pytest
from conftest import SF
from test_models import plain_components
from test_oracles import table as canonical
from test_text_operators import plain_ids

import __spark_entry__ as entry

COLUMNS = {
    "op1_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op2_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op3_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op4_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op6_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op7_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op9_ngram_jaccard": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op10_html_text": "page_id bigint, url string, text string, n_chars bigint",
    "op11_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    "op12_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op13_manifest": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
}
ROWS = {"op2_neighbours": 50, "op10_html_text": 50, "op11_hard_negatives": 121}


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    rows = df.collect()
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    if name != "op7_packing":
        assert len(rows) == ROWS.get(name, 200)
    if name in entry.oracle_sql():
        con = duckdb.connect()
        for t in ("documents", "benchmark", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        run = con.execute(entry.oracle_sql()[name])
        assert canonical(df.columns, rows) == canonical([d[0] for d in run.description], run.fetchall())
    elif name == "op9_ngram_jaccard":
        want = plain_components([(int(i), t) for i, t in zip(docs.doc_id, docs.text, strict=True)])
        assert sorted(map(tuple, rows)) == sorted(want)
    elif name == "op7_packing":
        total = sum(len(x) for x in plain_ids(docs.text))
        assert sum(r["length"] for r in rows) == total and len({r["sequence_id"] for r in rows}) <= -(-total // 2048) + 1


def test_pipeline_query_is_registered():
    assert "pipeline" in entry.queries() and {f"op{n}" for n in range(1, 14)} == {
        n.split("_")[0] for n in entry.queries() if n.startswith("op")}
