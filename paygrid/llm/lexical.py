"""Ranked lexical search by accumulator-limited term-at-a-time evaluation.

A first pass counts, batch by batch, the documents that hold each term; the
counts meet the items' terms in a join, which gives every item's term weights.
The search reads the documents where they lie: a task collects POSTINGS
postings of the items' terms, evaluates every item over that block and keeps
the item's best documents so far, so what it holds does not grow with its rows.

Within a block an item's terms are taken rarest first.  A document gets an
accumulator while it could still come among the best: once the bounds of the
terms to come add up to less than the k-th partial score (or the k-th score of
earlier blocks), no accumulator is created any more, and the remaining terms
only update those there are.  All arithmetic is in 64-bit integers, so the
scores are exact.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from paygrid.llm.common import whole_texts

#: ASCII letters and digits, and every byte of a character beyond ASCII.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BEST = 20
#: Postings of a block of documents, and (item, term) rows of a broadcast block of items.
POSTINGS, ITEM_ROWS = 400_000, 200_000


def _texts(batch, name: str) -> list[bytes]:
    """A text column's UTF-8, ASCII capitals made small; null counts as empty."""
    return [(x or b"").lower() for x in batch.column(name).cast(pa.binary()).to_pylist()]


def document_counts(docs: DataFrame) -> DataFrame:
    """(term, df, total): documents that hold each term; the row without a term has the number of documents
    with at least one, and of all their terms with repeats."""

    def count(batches):
        for b in batches:
            df, rows, total = Counter(), 0, 0
            for text in _texts(b, "text"):
                terms = TERM.findall(text)
                rows, total = rows + bool(terms), total + len(terms)
                df.update(set(terms))
            names = pa.array([None, *(t.decode() for t in df)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [names, pa.array([rows, *df.values()], pa.int64()), pa.array([total] + [0] * len(df), pa.int64())], ["term", "df", "total"]
            )

    parts = whole_texts(docs).select("text").mapInArrow(count, "term string, df long, total long")
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times); rows under one id are one item."""

    def split(batches):
        for b in batches:
            found = [Counter(TERM.findall(t)) for t in _texts(b, "text")]
            at = np.repeat(np.arange(len(found)), [len(c) for c in found])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("item_id").take(pa.array(at)),
                    pa.array([t.decode() for c in found for t in c], pa.string()),
                    pa.array([n for c in found for n in c.values()], pa.int64()),
                ],
                ["item_id", "term", "times"],
            )

    kind = items.schema["item_id"].dataType.simpleString()
    parts = whole_texts(items).select("item_id", "text").mapInArrow(split, f"item_id {kind}, term string, times long")
    return parts.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


class Block:
    """Postings of a block of documents, by term number."""

    def __init__(self):
        self.ids, self.lengths, self.docs, self.terms, self.tfs = [], [], [], [], []

    def add(self, doc_id, length: int, found: list[tuple[int, int]]) -> None:
        at = len(self.ids)
        self.ids.append(doc_id)
        self.lengths.append(length)
        for term, tf in found:
            self.docs.append(at)
            self.terms.append(term)
            self.tfs.append(tf)

    def impacts(self, n_docs: int, n_terms: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Term -> (documents, what one occurrence of the term in an item adds for each, apart from the weight)."""
        m = np.array([75 + (25 * n * n_docs) // n_terms for n in self.lengths], np.int64)
        docs, terms, tf = (np.array(x, np.int64) for x in (self.docs, self.terms, self.tfs))
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[docs])
        order = np.argsort(terms, kind="stable")
        starts = np.flatnonzero(np.diff(terms[order], prepend=-1))
        return {int(terms[order[a]]): (docs[part], impact[part]) for a, part in zip(starts, np.split(order, starts[1:]))}


def evaluate(terms, weights, postings, size: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of every accumulator; any document left out scores under ``floor`` or under k that are there.

    ``terms`` stand rarest first; ``floor`` is a score that k documents elsewhere reach.
    """
    here = [(postings[t], w) for t, w in zip(terms, weights) if t in postings]
    bounds = [w * int(p[1].max()) for p, w in here]
    left = sum(bounds)
    acc, open_ = np.zeros(size, np.int64), True
    live = np.zeros(size, bool)
    for ((docs, impact), w), bound in zip(here, bounds):
        if open_ and left < max(floor, _kth(acc[live], k, left)):
            open_ = False
        if open_:
            live[docs] = True
        else:
            there = live[docs]
            docs, impact = docs[there], impact[there]
        acc[docs] += w * impact
        left -= bound
    found = np.flatnonzero(live & (acc > 0))
    return found, acc[found]


def _kth(scores: np.ndarray, k: int, over: int) -> int:
    """The k-th largest; 0 where there are fewer, or where it can't be above ``over``."""
    if len(scores) < k or int(scores.max()) <= over:
        return 0
    return int(np.partition(scores, len(scores) - k)[-k])


def best(ids: list, scores: list[int], k: int) -> list[int]:
    """Places of the k best: by score, then by id (null last)."""
    order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i] is None, ids[i] or 0))
    return order[:k]


def search(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` highest-scoring documents with a score above 0.

    Equal scores stand by ascending doc_id, null last.  Every row of ``docs`` is
    a document, repeated rows too; null and empty texts hold no term and are in
    no result.  Rows of ``items`` that share an id (null is one) are one item
    with the terms of all; an item without a known term has no result.  An empty
    table gives an empty result.  Other columns are not read.

    The items are a stated query set: their term weights are broadcast in
    blocks of about ITEM_ROWS rows, and a larger set is more passes.
    """
    spark = docs.sparkSession
    counts = document_counts(docs)
    counts.cache()
    total = counts.where("term IS NULL").first()
    item_type, doc_type = (t.schema[c].dataType.simpleString() for t, c in ((items, "item_id"), (docs, "doc_id")))
    empty = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {doc_type}, score long")
    if total is None or not total.total:
        counts.unpersist()
        return empty
    n_docs, n_terms = total.df, total.total
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    rows = item_terms(items).join(counts.where("term IS NOT NULL").select("term", "df"), "term").withColumn("w", weight).where("w > 0")
    rows = rows.cache()
    blocks = max(1, -(-2 * rows.count() // ITEM_ROWS))
    counts.unpersist()
    out = None
    for i in range(blocks):
        mine = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i) if blocks > 1 else rows
        found = _search_block(docs, mine.select("item_id", "term", "times", "df", "w").collect(), n_docs, n_terms, k, item_type, doc_type)
        out = found if out is None else out.unionByName(found)
    rows.unpersist()
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_block(docs, rows, n_docs, n_terms, k, item_type, doc_type) -> DataFrame:
    vocabulary, queries = {}, {}
    for r in sorted(rows, key=lambda r: (r.df, r.term)):
        at = vocabulary.setdefault(r.term.encode(), len(vocabulary))
        queries.setdefault(r.item_id, []).append((at, r.w * r.times))
    names = list(queries)
    shipped = docs.sparkSession.sparkContext.broadcast((vocabulary, [([t for t, _ in q], [w for _, w in q]) for q in queries.values()], names))
    def look(batches):
        vocabulary, queries, names = shipped.value
        kept: dict[int, tuple[list, list]] = {}

        def close(block):
            if not block.docs:
                return
            postings = block.impacts(n_docs, n_terms)
            for q, (terms, weights) in enumerate(queries):
                ids, scores = kept.get(q, ([], []))
                docs_at, more = evaluate(terms, weights, postings, len(block.ids), k, scores[k - 1] if len(scores) == k else 0)
                if not len(docs_at):
                    continue
                if len(more) > k:  # all that reach the k-th score, ties too
                    top = more >= np.partition(more, len(more) - k)[-k]
                    docs_at, more = docs_at[top], more[top]
                ids, scores = ids + [block.ids[d] for d in docs_at], scores + more.tolist()
                order = best(ids, scores, k)
                kept[q] = [ids[i] for i in order], [scores[i] for i in order]

        block = Block()
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), _texts(b, "text")):
                terms = TERM.findall(text)
                found = [(vocabulary[t], n) for t, n in Counter(terms).items() if t in vocabulary]
                if found:
                    block.add(doc_id, len(terms), found)
                if len(block.docs) >= POSTINGS:
                    close(block)
                    block = Block()
        close(block)
        for q, (ids, scores) in kept.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[q]] * len(ids), item_arrow), pa.array(ids, doc_arrow), pa.array(scores, pa.int64())], ["item_id", "doc_id", "score"]
            )

    item_arrow, doc_arrow = (to_arrow_schema(StructType.fromDDL(f"x {t}")).field(0).type for t in (item_type, doc_type))
    return whole_texts(docs).select("doc_id", "text").mapInArrow(look, f"item_id {item_type}, doc_id {doc_type}, score long")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
full_docs AS (SELECT * FROM d WHERE len(terms) > 0),
g AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM full_docs),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM full_docs) GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
w AS (SELECT item_id, term, times, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
      FROM q JOIN df USING (term), g),
m AS (SELECT r, doc_id, 75 + (25 * len(terms) * n_docs) // n_terms AS m FROM full_docs, g),
s AS (SELECT w.item_id, m.r, any_value(m.doc_id) AS doc_id,
        CAST(sum(w.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * m.m))) AS BIGINT) AS score
      FROM w JOIN tf USING (term) JOIN m ON m.r = tf.r GROUP BY w.item_id, m.r),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
      FROM s WHERE score > 0)
SELECT * FROM o WHERE rank <= 20"""
