"""A corpus report from sketches that merge.

Each batch of chunks leaves one row: exact counts, and HyperLogLog sketches of
its files, chunk texts and words.  The report unites the rows of the batches
that count; no chunk is read again, and a file, text or word that is in several
batches counts once.  A batch that is taken back, or comes again, is a row that
is left out or replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textsearch import terms_of

LG_CELLS = 14                                   # 2 ** 14 cells: at most about 16 kB a sketch
ERROR = 1.04 / (1 << LG_CELLS) ** 0.5           # relative standard error of an estimate, about 0.8 %
SKETCHES = {"files": "n_files", "texts": "n_texts", "words": "n_words"}


def _sketch(c: str, name: str) -> Column:
    """Of hashes: a sketch leaves out the empty string, which is a value here."""
    return F.hll_sketch_agg(F.when(F.col(c).isNotNull(), F.xxhash64(c)), LG_CELLS).alias(name)


def batch_sketches(chunks: DataFrame, batch: Column, file_col: str = "file", text_col: str = "text") -> DataFrame:
    """``batch, n_chunks, n_chars`` and the sketches ``files, texts, words`` of every batch.

    Null files and texts are counted as chunks but are in no sketch.  Sketches
    are built in the map tasks and united in the shuffle, so a batch that holds
    most chunks ships one row a task."""
    x = chunks.select(F.coalesce(batch.cast("string"), F.lit("")).alias("batch"), F.col(file_col).cast("string").alias("f"), F.col(text_col).alias("t"))
    rows = x.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.coalesce(F.sum(F.char_length("t").cast("bigint")), F.lit(0)).alias("n_chars"),
        _sketch("f", "files"),
        _sketch("t", "texts"),
    )
    words = x.select("batch", F.explode_outer(F.array_distinct(terms_of(F.col("t")))).alias("w")) \
        .groupBy("batch").agg(_sketch("w", "words"))
    return rows.join(words, "batch")


def report(sketches: DataFrame) -> DataFrame:
    """One row: exact ``n_chunks`` and ``n_chars``, estimates ``n_files, n_texts, n_words`` (all 0 without batches)."""
    return sketches.agg(
        F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_chunks"),
        F.coalesce(F.sum("n_chars"), F.lit(0)).alias("n_chars"),
        *[F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).alias(out) for c, out in SKETCHES.items()],
    )
