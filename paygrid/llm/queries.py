"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from paygrid.llm import ann, bpe, dsir, langid, lexical, linededup, minhash, mixing, pii, simhash, substr, toxic, vptree
from paygrid.llm.common import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_importance_resampling(spark, sf_dir):
    """Target: documents labelled as of good quality."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return dsir.resample(table(spark, sf_dir, "documents"), good)


def op2_bpe(spark, sf_dir):
    return bpe.token_digests(table(spark, sf_dir, "documents"), vocabulary())


def op3_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_nearest(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"))


def op6_minhash(spark, sf_dir):
    return minhash.compared(table(spark, sf_dir, "documents"))


def op7_language(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_substring(spark, sf_dir):
    return substr.digests(table(spark, sf_dir, "documents"))


def op9_pii(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    return toxic.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_lexical(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_line_dedup(spark, sf_dir):
    return linededup.digests(table(spark, sf_dir, "documents"))


def op13_clusters(spark, sf_dir):
    return vptree.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_importance_resampling": op1_importance_resampling,
    "op2_bpe": op2_bpe,
    "op3_mixing": op3_mixing,
    "op4_simhash": op4_simhash,
    "op5_nearest": op5_nearest,
    "op6_minhash": op6_minhash,
    "op7_language": op7_language,
    "op8_substring": op8_substring,
    "op9_pii": op9_pii,
    "op10_toxicity": op10_toxicity,
    "op11_lexical": op11_lexical,
    "op12_line_dedup": op12_line_dedup,
    "op13_clusters": op13_clusters,
}

#: DuckDB SQL where SQL can express the operator; tests hold the others against brute force.
ORACLE: dict[str, str] = {
    "op3_mixing": mixing.SQL,
    "op11_lexical": lexical.SQL,
    "op12_line_dedup": linededup.SQL,
    "op13_clusters": vptree.SQL,
}
