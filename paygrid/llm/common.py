"""Helpers that several operators share."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spark's regular expression of a word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch of whole texts.
TEXT_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def whole_texts(docs: DataFrame) -> DataFrame:
    """``docs``, after the session's Arrow batches are limited to TEXT_ROWS rows.

    A batch of whole texts is held several times over, by the JVM and by its
    Python worker; the default of 10,000 rows is meant for narrow rows.
    """
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(name, "10000"))
    if not 0 < now <= TEXT_ROWS:
        conf.set(name, str(TEXT_ROWS))
    return docs


def held_out(doc_id: Column) -> Column:
    """True for the fold no model learns from: crc32 of the id's decimal text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` with a suffix that no column of ``df`` has (compared without case)."""
    taken = {c.lower() for c in df.columns}
    suffix = ""
    while any((n + suffix).lower() in taken for n in names):
        suffix += "_"
    return [n + suffix for n in names]


def first_of_each(rows: DataFrame, key: str, order: list[str], n: int, rank: str, salts: int = 64) -> DataFrame:
    """The first ``n`` rows of each ``key`` in the order of columns ``order``, numbered by ``rank``.

    They are first sought in ``salts`` parts of a key (each with a partial limit
    before the shuffle), so that a key with a third of all rows is not one
    task's, and then among at most ``salts * n`` rows of a key.
    """
    (part,) = fresh(rows, "first_part")
    within = Window.partitionBy(key, part).orderBy(*order)
    rows = rows.withColumn(part, F.pmod(F.xxhash64(*order), F.lit(salts))).withColumn(rank, F.row_number().over(within)).where(F.col(rank) <= n)
    return rows.drop(part).withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(rank) <= n)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, from ``spark.checkpoint.dir``."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker process and is shared by its tasks."""
    name = "_llm_worker_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    return sys.modules[name].__dict__
