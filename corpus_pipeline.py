"""Corpus pipeline: raw documents to token ids, as a chain of (name, function) stages.

Each function takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

import uuid

from paygrid.llm import bpe, langid, mixing, pii, simhash
from paygrid.llm.common import shared_dir, table
from paygrid.llm.queries import vocabulary


def language(spark, docs, sf_dir):
    """Documents without letters, or without a language the model is sure of, go."""
    return langid.with_language(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each near-duplicate group stays: that of the smallest id."""
    return simhash.one_of_each(docs)


def personal_data(spark, docs, sf_dir):
    """Every identifier found, disguised ones included, is replaced by its kind."""
    return pii.without_personal_data(docs)


def mixture(spark, docs, sf_dir):
    """The documents of the mix, each as often as the mix takes it."""
    return mixing.mixed(docs)


def encoding(spark, docs, sf_dir):
    """Token counts and digests of every text's ids and of the text decoded from them."""
    return bpe.token_digests(docs, vocabulary())


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("mixing", mixture),
    ("bpe", encoding),
]

#: Language models and tokenizers are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; what lies between two stages is written to the shared folder and read again."""
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{base}/{k}_{name}")
            docs = spark.read.parquet(f"{base}/{k}_{name}")
    return docs
