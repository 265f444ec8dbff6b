"""The registered queries: contract columns, one row per document, and the SQL oracle."""

import duckdb
import pytest

from paygrid.llm.queries import ORACLE, QUERIES
from tests.llm.test_operators import SF

COLUMNS = {
    "op1": "doc_id log_weight key",
    "op2": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op3": "doc_id size source_size target taken",
    "op4": "doc_id fingerprint component_id",
    "op5": "query_id rank vec_id score",
    "op6": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op7": "doc_id held_out lang_pred score",
    "op8": "doc_id n_words n_removed kept_sha256",
    "op9": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op10": "doc_id held_out score predicted",
    "op11": "item_id rank doc_id score",
    "op12": "doc_id n_lines n_dropped kept_sha256",
    "op13": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
}


def test_one_query_per_operator():
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted(COLUMNS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_contract(spark, name):
    out = QUERIES[name](spark, SF)
    op = name.split("_")[0]
    assert out.columns[: len(COLUMNS[op].split())] == COLUMNS[op].split()
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = out.collect()
    if op not in ("op1", "op5", "op11", "op13"):
        assert len(rows) == n == len({r.doc_id for r in rows})


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
