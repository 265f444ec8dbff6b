"""A table of chunks that follows its documents: only what was added or changed is read and cut again.

Two parts are stored.  The manifest is a stored table with a row per document:
its key, its mark (whatever tells that it changed: length and time of a file,
or a digest of a text) and the batch that holds its chunks.  The chunks lie in
Parquet under ``path``, one folder a batch, and are never rewritten in place: a
refresh writes one more batch and then moves the manifest to it in one step.  A
chunk is current if the manifest names its document with its batch, so a
refresh that fails, or is run twice, leaves nothing half done.

Chunks of replaced and deleted documents stay in their batches, unread, until
:func:`compact` gathers the current ones in one batch.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.documents import list_documents
from ..sources.stored import store
from .retrieval import CHUNK_SIZE, chunk_text

BY_NAME = 10_000      # changed files up to which a refresh opens them by name instead of scanning the folder
KEY, MARK, BATCH, WAS = "doc_key", "doc_mark", "batch", "was"


def _marks(listing: DataFrame, key: str) -> DataFrame:
    """One row a key with its mark: number, extremes and a hash sum of what the listing says of it."""
    said = F.to_json(F.struct(*[c for c in listing.columns if c != key]), {"ignoreNullFields": "false"}) \
        if len(listing.columns) > 1 else F.lit("")
    rows = listing.select(F.col(key).alias(KEY), said.alias("said"))
    total = F.sum(F.xxhash64("said").cast("decimal(38,0)"))
    return rows.groupBy(KEY).agg(F.concat_ws("|", F.count(F.lit(1)).cast("string"), total.cast("string"), F.min("said"), F.max("said")).alias(MARK))


def refresh(spark: SparkSession, name: str, path: str, listing: DataFrame, key: str, chunks_of: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
    """Bring the chunks up to date and return how many documents were ``added``, ``changed``, ``deleted`` and ``kept``.

    ``listing`` has the ``key`` of every document there is now and, in its other
    columns, what changes when the document does; rows of one key are one
    document.  ``chunks_of(todo)`` gives the chunks (with the key column) of the
    documents whose keys are in ``todo``, a table with that one column.  A null
    key is a key.  The listing is taken once, before the documents are read: one
    that changes in between is read as it is then and again at the next refresh.
    Nothing is written where nothing changed."""
    taken = scratch_path(spark, "refresh")
    now = _marks(listing, key)
    first = not spark.catalog.tableExists(name)
    if first:
        status = now.select(KEY, MARK, F.lit(None).cast("string").alias(BATCH), F.lit("added").alias(WAS))
    else:
        old = spark.table(name).select(F.col(KEY).alias("k0"), F.col(MARK).alias("m0"), F.col(BATCH).alias("b0"))
        was = F.when(F.col("b0").isNull(), "added").when(F.col(MARK).isNull(), "deleted") \
            .when(F.col(MARK) == F.col("m0"), "kept").otherwise("changed")
        status = now.join(old, F.col(KEY).eqNullSafe(F.col("k0")), "full_outer") \
            .select(F.when(F.col(MARK).isNull(), F.col("k0")).otherwise(F.col(KEY)).alias(KEY), MARK, F.col("b0").alias(BATCH), was.alias(WAS))
    status.write.parquet(taken)
    status = spark.read.parquet(taken)
    found = {"added": 0, "changed": 0, "deleted": 0, "kept": 0, **{r[WAS]: r["count"] for r in status.groupBy(WAS).count().collect()}}
    if not first and not found["added"] + found["changed"] + found["deleted"]:
        return found
    batch, todo = "b" + uuid.uuid4().hex, F.col(WAS).isin("added", "changed")
    if first or found["added"] + found["changed"]:
        chunks_of(status.filter(todo).select(F.col(KEY).alias(key))).write.parquet(f"{path}/{BATCH}={batch}")
    live = status.filter(F.col(WAS) != "deleted")
    store(live.select(KEY, MARK, F.when(todo, F.lit(batch)).otherwise(F.col(BATCH)).alias(BATCH)), name, [KEY])
    return found


def current(spark: SparkSession, name: str, path: str, key: str) -> DataFrame:
    """The current chunks.  Only batches that the manifest names are read (one a refresh since the last :func:`compact`)."""
    of = spark.table(name).select(F.col(KEY).alias("k0"), F.col(BATCH).alias("b0"))
    batches = [r.b0 for r in of.select("b0").distinct().collect()]
    chunks = spark.read.option("basePath", path).parquet(path)
    mine = chunks.filter(F.col(BATCH).isin(*batches) if batches else F.lit(False))
    return mine.join(of, F.col(key).eqNullSafe(F.col("k0")) & (F.col(BATCH) == F.col("b0")), "left_semi").drop(BATCH)


def compact(spark: SparkSession, name: str, path: str, key: str) -> None:
    """Gather the current chunks in one batch.  The folders of the batches that
    the manifest no longer names may be removed once no query reads them."""
    batch = "b" + uuid.uuid4().hex
    current(spark, name, path, key).write.parquet(f"{path}/{BATCH}={batch}")
    store(spark.table(name).withColumn(BATCH, F.lit(batch)), name, [KEY])


def refresh_folder(spark: SparkSession, name: str, path: str, folder: str, suffix: str = ".txt",
                   text: Column | None = None, size: int = CHUNK_SIZE) -> dict[str, int]:
    """:func:`refresh` with the files of a folder; chunks are ``path, file, pos, text``.

    A file is read again when its length or time changed; the contents of the
    others are not opened, as long as at most BY_NAME files changed (beyond that
    the folder is scanned and what did not change left out).  An empty file is
    not listed.  ``text`` makes the text from the column ``content``
    (default: UTF-8).  Raises NoDocuments, and leaves the chunks as they are,
    where the folder is missing or has no such file."""
    content = F.decode(F.col("content"), "UTF-8") if text is None else text

    def chunks_of(todo: DataFrame) -> DataFrame:
        names = [r.path for r in todo.limit(BY_NAME + 1).collect()]
        reader = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}")
        files = reader.load([re.sub(r"([\\*?\[\]{}])", r"\\\1", n) for n in names] if 0 < len(names) <= BY_NAME else folder)
        docs = files.join(todo, "path", "left_semi").select("path", F.element_at(F.split("path", "/"), -1).alias("file"), content.alias("text"))
        return chunk_text(docs, ["path", "file"], "text", size)

    return refresh(spark, name, path, list_documents(spark, folder, suffix), "path", chunks_of)
