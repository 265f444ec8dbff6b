"""The corpus pipeline stage by stage, over a small corpus and over every awkward case."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from paygrid.llm import langid, mixing, pii
from tests.llm import helpers as h
from tests.llm.test_operators import SF, expected_tokens

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module", params=["small", "awkward"])
def docs(spark, request):
    if request.param == "small":
        return spark.read.parquet(f"{SF}/documents.parquet").cache()
    return h.docs(spark, h.AWKWARD).repartition(3).cache()


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "pii", "mixing", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages(spark, docs):
    """Each stage keeps the columns of documents, and its decisions are those of its operator."""
    at = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        at[name] = now
        now = stage(spark, now, SF)
        if name != "bpe":
            assert now.columns == docs.columns
            now = now.cache()
    kept = Counter(r.doc_id for r in at["simhash_near_dedup"].collect())
    known = langid.identify(docs).where("lang_pred <> 'und' and score >= 0.4")
    assert kept == Counter(r.doc_id for r in known.collect())

    rows = [(r.doc_id, r.text) for r in at["simhash_near_dedup"].collect()]
    names = h.components([h.simhash(t) for _, t in rows], [d for d, _ in rows])
    assert sorted(r.doc_id for r in at["pii"].where("doc_id is not null").collect()) == sorted({n for n in names if n is not None})

    clean = {r.doc_id: r for r in at["mixing"].collect()}
    for r in at["pii"].collect():
        assert clean[r.doc_id].n_chars == len(clean[r.doc_id].text)
        assert pii.detect(clean[r.doc_id].text) == [] and (pii.spans(r.text) or clean[r.doc_id].text == r.text)

    times = {r.doc_id: r.taken // r["size"] for r in mixing.mix(at["mixing"]).collect() if r["size"]}
    assert Counter(r.doc_id for r in at["bpe"].collect()) == Counter({d: n for d, n in times.items() if n})

    want = Counter((r.doc_id, *expected_tokens(r.text)) for r in at["bpe"].collect())
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in now.collect()) == want


def test_empty_table(spark):
    now = h.docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
    assert now.count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    total = out.agg({"n_tokens": "sum"}).first()[0]
    assert 0 < out.count() and np.isfinite(total)
