"""Chunks that follow their documents, and the corpus report from sketches."""

import os

import pytest
from pyspark.sql import functions as F

from paygrid.operators import chunkstore as cs
from paygrid.operators import corpus as co
from paygrid.operators import retrieval as rt
from paygrid.operators.textsearch import terms_of
from paygrid.sources import stored
from paygrid.sources.documents import NoDocuments, scan_documents


@pytest.fixture
def name(spark):
    yield "cs_chunks"
    stored.forget(spark, "cs_chunks")


def put(folder, name, text, when):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    os.utime(path, (when, when))


def rebuilt(spark, folder, size):
    docs = scan_documents(spark, str(folder), ".txt").withColumn("text", F.decode("content", "UTF-8"))
    return sorted((r.file, r.pos, r.text) for r in rt.chunk_text(docs, ["file"], "text", size).collect())


def test_folder_follows_added_changed_and_deleted_files(spark, tmp_path, name):
    folder, store = tmp_path / "docs", str(tmp_path / "store")
    folder.mkdir()
    now = lambda: sorted((r.file, r.pos, r.text) for r in cs.current(spark, name, store, "path").collect())
    refresh = lambda: cs.refresh_folder(spark, name, store, str(folder), size=4)
    with pytest.raises(NoDocuments):
        refresh()
    put(folder, "a.txt", "primeiro texto", 1000)
    put(folder, "b[1] {x}.txt", "outro ação", 1000)
    put(folder, "skip.md", "not scanned", 1000)
    assert refresh() == {"added": 2, "changed": 0, "deleted": 0, "kept": 0}
    assert now() == rebuilt(spark, folder, 4)
    assert refresh() == {"added": 0, "changed": 0, "deleted": 0, "kept": 2}
    assert len(os.listdir(store)) == 1                       # nothing written
    put(folder, "b[1] {x}.txt", "OUTRO ação", 2000)          # same length, other time
    put(folder, "c.txt", "novo documento", 500)              # older than the last refresh
    put(folder, "empty.txt", "", 500)
    assert refresh() == {"added": 1, "changed": 1, "deleted": 0, "kept": 1}    # an empty file has no chunks and is not listed
    assert now() == rebuilt(spark, folder, 4)
    put(folder, "c.txt", "curto", 500)                       # same time, other length
    (folder / "a.txt").unlink()
    assert refresh() == {"added": 0, "changed": 1, "deleted": 1, "kept": 1}
    assert now() == rebuilt(spark, folder, 4)
    put(folder, "a.txt", "de volta", 1000)
    assert refresh()["added"] == 1 and now() == rebuilt(spark, folder, 4)
    cs.compact(spark, name, store, "path")
    assert now() == rebuilt(spark, folder, 4)
    assert {r.batch for r in spark.table(name).collect()} < {d.split("=")[1] for d in os.listdir(store)}
    put(folder, "d.txt", "depois", 1000)
    assert refresh() == {"added": 1, "changed": 0, "deleted": 0, "kept": 3} and now() == rebuilt(spark, folder, 4)


def test_unchanged_files_are_not_opened(spark, tmp_path, name):
    folder, store = tmp_path / "docs", str(tmp_path / "store")
    folder.mkdir()
    put(folder, "a.txt", "um", 1000)
    cs.refresh_folder(spark, name, store, str(folder))
    put(folder, "b.txt", "dois", 1000)
    boom = F.when(F.col("path").endswith("a.txt"), F.raise_error(F.lit("opened"))).otherwise(F.decode("content", "UTF-8"))
    assert cs.refresh_folder(spark, name, store, str(folder), text=boom)["added"] == 1
    put(folder, "a.txt", "tres", 2000)
    with pytest.raises(Exception, match="opened"):
        cs.refresh_folder(spark, name, store, str(folder), text=boom)
    assert sorted(r.text for r in cs.current(spark, name, store, "path").collect()) == ["dois", "um"]    # failed: as it was
    assert cs.refresh_folder(spark, name, store, str(folder))["changed"] == 1
    assert sorted(r.text for r in cs.current(spark, name, store, "path").collect()) == ["dois", "tres"]


def test_null_and_repeated_keys_and_an_empty_table(spark, tmp_path, name):
    store, schema = str(tmp_path / "store"), "k long, text string"

    def step(rows):
        docs = spark.createDataFrame(rows, schema)
        chunks = lambda todo: rt.chunk_text(docs.join(todo.select(F.col("k").alias("t")), docs["k"].eqNullSafe(F.col("t")), "left_semi"), ["k"], size=3)
        found = cs.refresh(spark, name, store, docs, "k", chunks)
        key = lambda r: (str(r.k), r.pos, r.text)
        got = sorted(map(tuple, sorted(cs.current(spark, name, store, "k").collect(), key=key)), key=str)
        assert got == sorted(map(tuple, rt.chunk_text(docs, ["k"], size=3).collect()), key=str)
        return found

    assert step([])["added"] == 0
    rows = [(None, "nothing"), (1, "one"), (1, "another"), (2, None)]
    assert step(rows)["added"] == 3
    assert step(rows) == {"added": 0, "changed": 0, "deleted": 0, "kept": 3}
    assert step(rows + [(1, "one")]) == {"added": 0, "changed": 1, "deleted": 0, "kept": 2}
    assert step(rows[1:]) == {"added": 0, "changed": 1, "deleted": 1, "kept": 1}
    assert step([])["deleted"] == 2


def test_report_of_batches(spark):
    chunks = spark.range(30000).select((F.col("id") % 7).alias("b"), (F.col("id") % 5000).cast("string").alias("file"),
                                       F.concat(F.lit("Word"), F.col("id") % 9000, F.lit(" common")).alias("text"))
    rows = co.batch_sketches(chunks, F.col("b"))
    whole = co.report(rows).first()
    assert (whole.n_chunks, whole.n_chars) == chunks.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    for got, exact in ((whole.n_files, 5000), (whole.n_texts, 9000), (whole.n_words, 9001)):
        assert abs(got - exact) <= 4 * co.ERROR * exact
    kept = co.report(rows.filter("batch != '3'")).first()      # a batch taken back
    words = chunks.filter("b != 3").select(F.explode(terms_of(F.col("text")))).distinct().count()
    assert kept.n_chunks == chunks.filter("b != 3").count() and abs(kept.n_words - words) <= 4 * co.ERROR * words
    again = co.report(rows.unionByName(rows)).first()          # sketches of the same things united
    assert (again.n_files, again.n_texts, again.n_words) == (whole.n_files, whole.n_texts, whole.n_words)


def test_report_of_nulls_and_of_nothing(spark):
    schema = "b string, file string, text string"
    nothing = spark.createDataFrame([], schema)
    assert co.report(co.batch_sketches(nothing, F.col("b"))).first() == (0, 0, 0, 0, 0)
    rows = spark.createDataFrame([(None, None, None), ("x", "f", ""), ("x", "f", "a A b")], schema)
    assert co.report(co.batch_sketches(rows, F.col("b"))).first() == (3, 5, 1, 2, 2)
