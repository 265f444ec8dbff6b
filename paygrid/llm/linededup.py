"""Line dedup by levelled sorted runs of line hashes, in DataFrame functions only.

The runs are tables bucketed and sorted by the line's 128-bit hash, one bucket
a shuffle partition, with the number of documents that hold the line and the
largest of their ids.  Documents come in batches of descending id.  A batch's
hashes are merge-anti-joined with the runs' settled lines (held by enough
documents already, so the holder is known): what remains is the batch's own run
on level 0.  A level with FAN runs is merged into one run of the next level.

Batches, joins and merges keep one partitioning by hash, so runs are never
shuffled again; a line in a third of all documents is one row a task before the
shuffle, and one row in a run.  Lines to drop reach their text as positions in
it, once per document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paygrid.llm.common import cut, fresh, partitions, shared_dir

MIN_CHARS, MIN_DOCS, BATCHES, FAN = 20, 3, 4, 2
BLANKS = " \t\n\x0b\x0c\r"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["a", "b"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_marks(text: Column) -> tuple[Column, Column]:
    """What tells apart the texts under one id."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text), F.crc32(text.cast("binary"))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, t, u, pos, a, b): every line whose key has at least ``min_chars`` code points, by its hash."""
    t, u = text_marks(F.col("text"))
    # A function of the text in one expression, so that the text is translated once a row.
    keys = F.transform(lines_of(F.translate("text", CAPITALS, SMALL)), lambda x: F.trim(x, F.lit(BLANKS)))
    rows = docs.select("doc_id", t.alias("t"), u.alias("u"), F.posexplode(keys).alias("pos", "key")).where(F.char_length("key") >= min_chars)
    return rows.select("doc_id", "t", "u", "pos", F.xxhash64("key").alias("a"), F.xxhash64("key", "key").alias("b"))


class Runs:
    """Levelled sorted runs: (a, b, n, top) per line, its documents and the largest id."""

    def __init__(self, spark: SparkSession, settled: int = MIN_DOCS, fan: int = FAN):
        self.spark, self.settled, self.fan = spark, settled, fan
        self.buckets, self.name = partitions(spark), f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.written: list[str] = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def fresh(self, lines: DataFrame) -> DataFrame:
        """Rows of ``lines`` whose (a, b) no run has settled."""
        for run in self.runs():
            lines = lines.join(run.where(F.col("n") >= self.settled).select(*KEY), KEY, "left_anti")
        return lines

    def add(self, lines: DataFrame) -> None:
        """Add a batch: ``lines`` (a, b, doc_id), with all ids under every id that is still to come."""
        held = lines.select(*KEY, "doc_id").distinct().groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
        self._put(0, self.fresh(held))

    def _put(self, level: int, run: DataFrame) -> None:
        table = f"{self.name}_{len(self.written)}"
        path = f"{shared_dir(self.spark)}/{table}"
        run.select(*KEY, "n", "top").write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(table, format="parquet")
        self.written.append(table)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)
        if len(self.levels[level]) == self.fan:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._merged([self.spark.table(t) for t in full]))

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """One run of several, each line once in each: a merge join, not a shuffle."""
        out = runs[0]
        for run in runs[1:]:
            run = run.select(*KEY, F.col("n").alias("n2"), F.col("top").alias("top2"))
            n = F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))
            out = out.join(run, KEY, "full").select(*KEY, n.alias("n"), F.greatest("top", "top2").alias("top"))
        return out

    def repeated(self) -> DataFrame | None:
        """(a, b, top) of the lines that enough documents hold; None before the first batch."""
        runs = self.runs()
        return self._merged(runs).where(F.col("n") >= self.settled).select(*KEY, "top") if runs else None

    def forget(self) -> None:
        """Take the runs' names out of the catalog; their files stay in the shared folder."""
        for table in self.written:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """(doc_id, t, u, gone): the positions of the lines that each text loses, for texts that lose any."""
    spark = docs.sparkSession
    bounds = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)]).alias("x")).first()[0] if batches > 1 else None
    bounds = sorted(set(bounds or []))
    batch = F.lit(0)
    for x in bounds:
        batch = batch + F.when(F.col("doc_id") > F.lit(x), 1).otherwise(0)
    path = f"{shared_dir(spark)}/line-hashes-{uuid.uuid4().hex}"
    # Written once, by batch: the batches read their own part only.
    line_hashes(docs, min_chars).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, t long, u long, pos int, a long, b long, batch int"
    lines = spark.read.schema(schema).parquet(path)
    runs = Runs(spark, min_docs, fan)
    for i in reversed(range(len(bounds) + 1)):
        runs.add(lines.where(F.col("batch") == i))
    repeated = cut(runs.repeated())
    runs.forget()
    gone = lines.join(repeated, KEY).where(~F.col("doc_id").eqNullSafe(F.col("top")))
    return gone.groupBy("doc_id", "t", "u").agg(F.collect_set("pos").alias("gone"))


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with the lines dropped from ``text``, and n_lines (before) and n_dropped under names that are free.

    A line's key is the line without blanks at its ends, in small letters (A-Z).
    Keys of at least ``min_chars`` code points that at least ``min_docs``
    documents hold lose their lines, except in the largest doc_id that holds
    them.  Documents are told apart by doc_id; rows that share one are one
    document, and all keep or all lose a line.  Null is an id, smaller than any
    other.  A null text counts as empty: one empty line; other lines, and all
    columns but ``text``, stay as they are.  An empty table stays empty.
    """
    id_, t, u, gone, n_lines, n_dropped, lines = fresh(docs, "id", "t", "u", "gone", "n_lines", "n_dropped", "lines")
    lost = dropped_lines(docs.select("doc_id", "text"), **how).select(
        F.col("doc_id").alias(id_), F.col("t").alias(t), F.col("u").alias(u), F.col("gone").alias(gone))
    marks = text_marks(F.col("text"))
    same = docs["doc_id"].eqNullSafe(lost[id_]) & (marks[0] == lost[t]) & (marks[1] == lost[u])
    rows = docs.join(lost, same, "left").drop(id_, t, u).withColumn(lines, lines_of(F.col("text")))
    # array_except compares by a hash set: linear in the lines, however many go.
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n")
    rows = rows.withColumn(n_lines, F.size(lines).cast("long")).withColumn(n_dropped, F.coalesce(F.size(gone), F.lit(0)).cast("long"))
    return rows.withColumn("text", F.when(F.col(gone).isNull(), F.coalesce("text", F.lit(""))).otherwise(kept)).drop(lines, gone)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 per row of ``docs``."""
    rows = deduplicated(docs.select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = f"""
WITH l AS (SELECT r, doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{CAPITALS}', '{SMALL}') AS key FROM l),
h AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
m AS (SELECT k.*, h.key IS NOT NULL AND k.doc_id IS DISTINCT FROM h.top AS gone FROM k LEFT JOIN h USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r"""
