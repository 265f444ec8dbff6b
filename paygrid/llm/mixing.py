"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Every source is a queue of its documents in a shuffled order that a hash fixes,
repeated ``repeats`` times.  A copy's virtual finish time is the source's words
up to and with it, divided by the source's target.  The mix is the stream of
copies in the order of finish times, cut where the total budget is used up.

No source, however large, meets in one task: words up to a document are the
sum over earlier hash buckets of its source plus those inside its bucket.  The
cut is found by narrowing a histogram of finish times, not by one sorted run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paygrid.llm.common import cut, fresh, partitions, word_count

WEIGHTS = (5, 2, 1)
#: Parts into which the interval that holds the cut is divided, and the copies left when it is read row by row.
CELLS, FEW = 4096, 20_000


def units(docs: DataFrame) -> DataFrame:
    """One row per distinct (source, doc_id, size), with ``n`` its rows: these are queued as one."""
    size = word_count(F.col("text"))
    rows = docs.select(F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("src"), "doc_id", size.alias("size"))
    return rows.groupBy("no_source", "src", "doc_id", "size").agg(F.count("*").alias("n"))


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``rank`` (from 0) in a global order, counted range by range."""
    spark = df.sparkSession
    parts = cut(df.repartitionByRange(partitions(spark), *order).withColumn("pid", F.spark_partition_id()))
    counts = parts.groupBy("pid").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("pid").orderBy(*order))
    # one row per range: as many as shuffle partitions
    return parts.join(counts.select("pid", before.alias("before")), "pid").withColumn("rank", F.col("before") + inside - 1).drop("pid", "before")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """(no_source, src, source_size, target) per source.

    Sources in code-point order, null last, take the weights in turn.  Shares by
    weight stop at ``repeats`` times the source's size; what is over is shared
    again by weight among the others until no target is above.
    """
    sources = sizes.groupBy("no_source", "src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = cut(ranked(sources, "no_source", "src").withColumn("w", weight).withColumn("most", F.col("source_size") * float(repeats)))
    budget = share * float(table.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = F.col("most") <= F.lit(level) * F.col("w")
        row = table.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("w")))).first()
        if not row[1]:
            break
        step = (budget - (row[0] or 0.0)) / row[1]
        if step == level:
            break
        level = step
    target = F.least("most", F.lit(level) * F.col("w"))
    return table.select("no_source", "src", "source_size", target.alias("target")).withColumn("budget", F.lit(budget))


def queued(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """The units with source_size, target, budget, ``h`` (their place in the shuffle) and ``upto``, the words of their source up to and with them."""
    spark = docs.sparkSession
    sizes = cut(units(docs))
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    buckets = 4 * partitions(spark)
    bucket = F.floor(F.conv(F.substring(h, 1, 6), 16, 10).cast("long") * buckets / (1 << 24)).cast("int")
    rows = sizes.withColumns({"h": h, "bucket": bucket})
    key = ["no_source", "src", "bucket"]
    sums = rows.groupBy(*key).agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    earlier = Window.partitionBy("no_source", "src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*key, F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*key).orderBy("h", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(sums, key).withColumn("upto", F.col("before") + F.sum(F.col("size") * F.col("n")).over(inside))
    return rows.drop("bucket", "before").join(targets(sizes, weights, share, repeats), ["no_source", "src"])


def copies(queue: DataFrame, repeats: int) -> DataFrame:
    """One row per unit of size over 0 and copy, with its virtual ``finish`` time."""
    rows = queue.where("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return rows.withColumn("finish", (F.col("upto") + F.col("copy") * F.col("source_size")) / F.col("target"))


#: The total order of copies; finish times first.
ORDER = ("finish", "no_source", "src", "h", "id_key", "size", "copy")


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("id_key", F.struct(F.col("doc_id").isNotNull(), "doc_id"))


def last_taken(stream: DataFrame):
    """The last copy, in ORDER, up to which all words fit into the budget; None if none fits."""
    stream = stream.withColumn("words", F.col("size") * F.col("n"))
    first = stream.agg(F.max("budget"), F.sum("words"), F.min("finish"), F.max("finish")).first()
    if not first[1]:
        return None
    budget, used, low, high = first[0], 0, first[2], first[3]
    here = F.lit(True)
    while True:
        # finish times in [low, high]; cells of equal width, all of them in order
        width = (high - low) / CELLS
        cell = F.least(F.floor((F.col("finish") - F.lit(low)) / F.lit(width)), F.lit(CELLS - 1)) if width > 0 else F.lit(0)
        cells = stream.where(here).groupBy(cell.cast("int").alias("cell")).agg(
            F.sum("words").alias("words"), F.count("*").alias("rows"), F.min("finish").alias("low"), F.max("finish").alias("high")
        )
        for c in sorted(cells.collect(), key=lambda r: r.cell):  # CELLS rows at most
            if used + c.words > budget:
                break
            used += c.words
        else:
            return _last(stream.where(here))
        here = F.col("finish").between(F.lit(c.low), F.lit(c.high))
        if c.rows <= FEW or (c.low, c.high) == (low, high) or c.low == c.high:
            break
        low, high = c.low, c.high
    running = F.sum("words").over(Window.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
    found = _last(_keyed(stream.where(here)).withColumn("total", running).where(F.col("total") + used <= budget), keyed=True)
    return found or _last(stream.where(F.col("finish") < F.lit(c.low)))


def _last(rows: DataFrame, keyed: bool = False):
    rows = rows if keyed else _keyed(rows)
    return rows.agg(F.max(F.struct(*ORDER)).alias("m")).first()["m"]


def _taken(last) -> Column:
    """Whether a copy stands at or before ``last`` in ORDER."""
    if last is None:
        return F.lit(False)
    id_key = F.struct(F.lit(last["id_key"][0]), F.lit(last["id_key"][1]).cast("long"))
    at = F.struct(F.lit(last.finish), F.lit(last.no_source), F.lit(last.src), F.lit(last.h), id_key, F.lit(last.size).cast("long"), F.lit(last["copy"]))
    return F.struct(*ORDER) <= at


def _decided(docs: DataFrame, weights, share, repeats) -> tuple[DataFrame, DataFrame]:
    queue = cut(queued(docs, weights, share, repeats))
    stream = copies(queue, repeats)
    return queue, _keyed(stream).where(_taken(last_taken(stream)))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target (its source's), taken (words taken, repeats counted).

    Null text has size 0 and is never taken; a null source is a source of its
    own, last in order; rows that agree in source, doc_id and size are taken
    alike; an empty table gives an empty result.
    """
    queue, stream = _decided(docs, weights, share, repeats)
    key = ["no_source", "src", "id_key", "size"]
    counted = stream.groupBy(*key).agg(F.count("*").alias("times"))
    rows = _keyed(queue).join(counted, key, "left").withColumn("each", F.explode(F.expr("array_repeat(0, cast(n as int))")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce("times", F.lit(0))).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """The mix itself: ``docs`` with every taken copy as a row, globally sorted by finish time, in range partitions."""
    _, stream = _decided(docs, weights, share, repeats)
    names = dict(zip(("no_source", "src", "doc_id", "size", "finish", "h"), fresh(docs, "q_none", "q_src", "q_id", "q_size", "q_finish", "q_h")))
    picks = stream.select(*[F.col(k).alias(v) for k, v in names.items()])
    q = {k: F.col(v) for k, v in names.items()}
    same = (
        F.col("doc_id").eqNullSafe(q["doc_id"])
        & (F.col("source").isNull() == q["no_source"])
        & (F.coalesce("source", F.lit("")) == q["src"])
        & (word_count(F.col("text")) == q["size"])
    )
    rows = docs.join(picks, same)
    rows = rows.repartitionByRange(partitions(docs.sparkSession), q["finish"], q["h"]).sortWithinPartitions(q["finish"], q["h"])
    return rows.drop(*names.values())


#: DuckDB's form of ``mix`` with its default parameters.
SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
units AS (SELECT doc_id, source, size, count(*) AS n, md5(coalesce(doc_id::VARCHAR, 'null')) AS h FROM rows GROUP BY doc_id, source, size),
sources AS (
  SELECT source, sum(size * n)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM units GROUP BY source),
caps AS (SELECT *, 2.0::DOUBLE * source_size AS most, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM sources),
levels AS (
  SELECT most / w AS r, (budget - coalesce(sum(most) OVER (ORDER BY most / w RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0))
         / sum(w) OVER (ORDER BY most / w RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM caps),
water AS (SELECT max(level) AS level FROM levels WHERE level <= r),
goal AS (SELECT c.source, c.source_size, c.budget, least(c.most, coalesce(l.level, 1e300) * c.w) AS target FROM caps c CROSS JOIN water l),
queue AS (
  SELECT u.*, g.source_size, g.budget, g.target,
         sum(u.size * u.n) OVER (PARTITION BY u.source ORDER BY u.h, u.doc_id NULLS FIRST, u.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM units u JOIN goal g ON u.source IS NOT DISTINCT FROM g.source),
stream AS (
  SELECT q.*, c.copy, (q.upto::BIGINT + c.copy * q.source_size)::DOUBLE / q.target AS finish
  FROM queue q CROSS JOIN (VALUES (0), (1)) c(copy) WHERE q.size > 0),
running AS (
  SELECT *, sum(size * n) OVER (ORDER BY finish, source NULLS LAST, h, doc_id NULLS FIRST, size, copy ROWS UNBOUNDED PRECEDING) AS total FROM stream),
taken AS (SELECT source, doc_id, size, count(*) AS times FROM running WHERE total <= budget GROUP BY source, doc_id, size)
SELECT q.doc_id, q.size::BIGINT AS size, q.source_size, q.target, (q.size * coalesce(t.times, 0))::BIGINT AS taken
FROM rows r JOIN queue q ON r.doc_id IS NOT DISTINCT FROM q.doc_id AND r.source IS NOT DISTINCT FROM q.source AND r.size = q.size
LEFT JOIN taken t ON t.doc_id IS NOT DISTINCT FROM q.doc_id AND t.source IS NOT DISTINCT FROM q.source AND t.size = q.size
"""
