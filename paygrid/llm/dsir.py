"""Importance resampling of raw text towards target text (hashed n-grams, Gumbel top-k).

Words and word pairs of a text are hashed into BUCKETS buckets.  Two generative
models are bucket frequencies: one of all raw documents, one of the target
documents.  A document's log importance weight is the sum over its n-grams of
the log ratio target / raw.  Adding independent Gumbel noise and keeping the k
largest keys draws k documents without replacement in proportion to their
weights.

The raw model counts every document.  The target model is fitted on at most
``target_rows`` target documents, chosen by hash; their ids are broadcast.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paygrid.llm.bpe import slices
from paygrid.llm.common import cut, whole_texts, worker_cache

BUCKETS = 10_000
#: Target documents that the target model is fitted on, at most.
TARGET_ROWS = 20_000
VOCABULARY = 500_000
PAIR = np.uint64(0x9E3779B97F4A7C15)
#: Cells of one narrowing step, and the rows among which the last kept one is found directly.
CELLS, FEW = 4096, 20_000
TOKEN = re.compile(r"\w+|[^\w\s]+")


class Hashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words and word pairs of the texts, and the text each belongs to."""
    cache = worker_cache()
    hashes = cache.get("ngram hashes")
    if hashes is None or len(hashes) > VOCABULARY:
        hashes = cache["ngram hashes"] = Hashes()
    words = [TOKEN.findall(t.lower()) for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    h = np.fromiter((hashes[w] for ws in words for w in ws), np.uint64, int(counts.sum()))
    doc = np.repeat(np.arange(len(words)), counts)
    pair = (h[:-1] * PAIR + h[1:]) * PAIR
    same = doc[:-1] == doc[1:]
    one = (h >> np.uint64(20)) % np.uint64(BUCKETS)
    two = (pair[same] >> np.uint64(20)) % np.uint64(BUCKETS)
    return np.concatenate([one, two]).astype(np.int64), np.concatenate([doc, doc[:-1][same]])


def frequencies(docs: DataFrame, target_ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts over all documents and over the target documents."""
    shipped = docs.sparkSession.sparkContext.broadcast(np.array(sorted(target_ids), np.int64))

    def run(batches):
        chosen = shipped.value
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                bucket, doc = buckets([t or "" for t in part.column("text").to_pylist()])
                ids = np.array([x if x is not None else 0 for x in part.column("doc_id").to_pylist()], np.int64)
                known = np.array(part.column("doc_id").is_valid().to_numpy(zero_copy_only=False), bool) & np.isin(ids, chosen)
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[known[doc]], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "bucket long, raw long, target long")
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for x in rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # BUCKETS rows
        raw[x.bucket], target[x.bucket] = x.raw, x.target
    return raw, target


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket, log of target over raw frequency, each with one added to every count."""
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def log_weight(docs: DataFrame, ratio: np.ndarray, text: Column) -> Column:
    shipped = docs.sparkSession.sparkContext.broadcast(ratio)

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        ratio, out = shipped.value, []
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        for part in slices(batch, "text"):
            bucket, doc = buckets([t or "" for t in part.column("text").to_pylist()])
            out.append(np.bincount(doc, ratio[bucket], minlength=part.num_rows))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return of(text)


def gumbel(seed: int, *columns: Column) -> Column:
    """Standard Gumbel noise that a hash of ``columns`` fixes."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)
    return -F.log(-F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))))


def largest(rows: DataFrame, key: str, tie: str, k: int) -> DataFrame:
    """Exactly the ``k`` rows of largest ``key`` (ties to the smaller ``tie``, null first); all if there are fewer.

    A histogram narrows the place of the k-th key until few rows share its
    cell; only those rows' keys come to the driver.
    """
    n, low, high = rows.agg(F.count("*"), F.min(key), F.max(key)).first()
    if n <= k:
        return rows
    if k <= 0:
        return rows.limit(0)
    above, here = 0, F.lit(True)
    while True:
        width = (high - low) / CELLS
        cell = F.least(F.floor((F.col(key) - F.lit(low)) / F.lit(width)), F.lit(CELLS - 1)) if width > 0 else F.lit(0)
        counts = rows.where(here).groupBy(cell.cast("int").alias("c")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
        for c in sorted(counts.collect(), key=lambda r: -r.c):  # CELLS rows at most
            if above + c.n >= k:
                break
            above += c.n
        here = F.col(key).between(F.lit(c.low), F.lit(c.high))
        if c.n <= FEW or c.low == c.high or (c.low, c.high) == (low, high):
            break
        low, high = c.low, c.high
    # the (k - above)-th of the cell's rows; TakeOrdered keeps that many per task
    inside = rows.where(here).select(key, tie).orderBy(F.desc(key), F.col(tie).asc_nulls_first()).limit(k - above)
    last = inside.orderBy(F.asc(key), F.col(tie).desc_nulls_last()).first()
    upto = F.col(tie).isNull() if last[1] is None else F.col(tie).isNull() | (F.col(tie) <= F.lit(last[1]))
    return rows.where((F.col(key) > F.lit(last[0])) | (F.col(key) == F.lit(last[0])) & upto)


def resample(docs: DataFrame, target: DataFrame, share: float = 0.85, seed: int = 5, target_rows: int = TARGET_ROWS) -> DataFrame:
    """The documents drawn: doc_id, log_weight, key (log_weight plus Gumbel noise).

    ``target`` has the doc_id of target documents; ``share`` of all rows is
    drawn (rounded down).  Null and empty texts have weight 0 (log); repeated
    rows have the same key and stand or fall together only by ties; with no
    target document all log weights come from smoothing alone; an empty table
    gives an empty result.
    """
    docs = whole_texts(docs)
    ids = target.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    ids = [r.doc_id for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows).collect()]
    ratio = log_ratio(*frequencies(docs, ids))
    rows = docs.select("doc_id", "text").withColumn("log_weight", log_weight(docs, ratio, F.col("text")))
    rows = cut(rows.select("doc_id", "log_weight", (F.col("log_weight") + gumbel(seed, F.col("doc_id"))).alias("key")))
    return largest(rows, "key", "doc_id", int(share * rows.count()))
