"""Chunking, page assembly, filtered search and text search."""

import math

import pytest
from pyspark.sql import functions as F

from paygrid.operators import retrieval as rt
from paygrid.operators import textsearch as ts
from paygrid.operators import vectorsearch as vs
from paygrid.sources.documents import manifest_key


def test_chunk_edges(spark):
    blank = "\t" * 400 + " " * 600
    docs = spark.createDataFrame([
        (1, ""), (2, "a" * 1000), (3, "b" * 1001), (4, blank + "x"), (5, "é" * 1500), (6, None),
    ], "doc_id long, text string")
    got = {(r.doc_id, r.pos): r.text for r in rt.chunk_text(docs, ["doc_id"]).collect()}
    assert set(got) == {(2, 0), (3, 0), (3, 1), (4, 1), (5, 0), (5, 1)}
    assert got[(3, 1)] == "b" and len(got[(5, 0)]) == 1000 and got[(4, 1)] == "x"


def test_pages_chunk_like_the_assembled_document(spark):
    pages = [(f"f{d}", p, ("page %d of %d " % (p, d)) * (37 * p + d)) for d in range(3) for p in range(1, 6)]
    pdf = spark.createDataFrame(pages, "file string, page_no int, text string")
    got = {(r.file, r.pos): r.text for r in rt.chunk_pages(pdf).collect()}
    for d in range(3):
        doc = "".join(t + "\n" for f, p, t in sorted(pages) if f == f"f{d}")
        want = [doc[i:i + 1000] for i in range(0, len(doc), 1000)]
        assert [got[(f"f{d}", i)] for i in range(len(want))] == want
    # the small page_offsets block still gives the same offsets
    o1 = {(r.file, r.page_no): r.start for r in rt.page_offsets(pdf, block=2).collect()}
    o2 = {(r.file, r.page_no): r.start for r in rt.page_offsets(pdf).collect()}
    assert o1 == o2


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_document_lists_in_pages(spark, size):
    rows = [("P1", f"f{i * 37 % 500:03d}") for i in range(700)] + [("P2", "b"), ("P2", "a"), ("P3", None), (None, "x"), (None, "x")]
    refs = spark.createDataFrame(rows, "plant string, file string")
    want = {}
    for plant in ("P1", "P2", None):
        files = sorted({f for p, f in rows if p == plant and f is not None})
        want |= {(plant, k // size): (len(files[k:k + size]), ", ".join(files[k:k + size])) for k in range(0, len(files), size)}
    found = rt.docs_by_group_paged(refs, size).collect()
    assert {(r.plant, r.page): (r.n_files, r.files) for r in found} == want and len(found) == len(want)
    assert rt.docs_by_group_paged(refs.limit(0), size).count() == 0


def test_post_filter_can_return_fewer_or_none(spark):
    hits = spark.createDataFrame(
        [(1, "P1", r, f"f{r % 2}") for r in range(1, 11)] + [(2, "P2", r, "f0") for r in range(1, 11)],
        "query_id long, plant string, rank int, file string")
    refs = spark.createDataFrame([("P1", "f1"), ("P2", "zz")], "plant string, file string")
    kept = rt.post_filter(hits, refs).collect()
    assert sorted((r.query_id, r.rank) for r in kept) == [(1, 1), (1, 2), (1, 3)]


def brute_tfidf(texts, query):
    """Cosine of tf·ln(N/df) weights, by definition."""
    import math
    import re
    from collections import Counter

    toks = [Counter(re.findall(r"\w+", t.lower())) for t in texts]
    idf = {w: math.log(len(texts) / sum(w in t for t in toks)) for t in toks for w in t}

    def weights(c):
        w = {t: n * idf[t] for t, n in c.items() if idf.get(t, 0) > 0}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()} if norm else {}

    q = weights(Counter(re.findall(r"\w+", query.lower())))
    out = {}
    for i, c in enumerate(toks):
        w = weights(c)
        if set(w) & set(q):
            out[i] = round(sum(x * q.get(t, 0) for t, x in w.items()), 9)
    return out


TEXTS = ["the red fox jumps", "a red red car the", "fox and car the", "nothing shared the", "the the the fox", "", "the"]
ASKED = {10: "red fox", 11: "car", 12: "zzz", 13: "the", 14: "red fox car jumps shared and a nothing", 15: ""}


def found(top):
    out = {}
    for r in top.collect():
        out.setdefault(r.query_id, {})[r.doc_id] = round(r.score, 9)
    return out


@pytest.mark.parametrize("seed,share", [(64, 0.5), (1, 1.0), (1, 0.1)])
def test_text_search_equals_brute_force(spark, monkeypatch, seed, share):
    monkeypatch.setattr(ts, "SEED", seed)
    monkeypatch.setattr(ts, "SHARE", share)
    chunks = spark.createDataFrame([(i, 0, t) for i, t in enumerate(TEXTS)], "doc_id long, pos int, text string")
    qs = spark.createDataFrame(list(ASKED.items()), "query_id long, text string")
    index = ts.build_index(chunks, ["doc_id", "pos"])
    assert found(ts.search(index, qs, 10).top) == {q: b for q, t in ASKED.items() if (b := brute_tfidf(TEXTS, t))}


@pytest.mark.parametrize("k", [1, 3])
def test_text_search_skips_postings_and_loses_no_hit(spark, monkeypatch, k):
    import random

    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.9))}" for _ in range(40_000)]
    texts = [" ".join(rng.choices(words, k=rng.choice([5, 40, 150]))) for _ in range(400)]
    asked = {i: " ".join(texts[i].split()[:12]) for i in range(0, 400, 40)}
    monkeypatch.setattr(ts, "SEGMENT", 50)
    chunks = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, pos int, text string")
    qs = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    index = ts.build_index(chunks, ["doc_id", "pos"])
    search = ts.search(index, qs, k)
    want = {q: dict(sorted(brute_tfidf(texts, t).items(), key=lambda x: (-x[1], x[0]))[:k]) for q, t in asked.items()}
    assert found(search.top) == want
    told = ts.report(index, search).collect()
    assert len(told) == len(asked)
    assert sum(r.opened for r in told) < 0.8 * sum(r.postings for r in told)
    assert sum(r.scored for r in told) < 0.2 * len(texts) * len(asked)


@pytest.mark.parametrize("dense", [0, 40])
def test_text_search_sums_common_words_by_product(spark, monkeypatch, dense):
    """Words that most chunks and queries share are not added posting by posting, and no hit is lost, whichever way a word is summed."""
    import random

    monkeypatch.setattr(ts, "DENSE", dense)
    rng = random.Random(12)
    words = [f"c{i}" for i in range(40)] * 30 + [f"r{i}" for i in range(600)]
    texts = [" ".join(rng.choices(words, k=rng.choice([8, 60, 90]))) for _ in range(120)]
    asked = {i: " ".join(rng.choices(words, k=15)) for i in range(12)}
    chunks = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, pos int, text string")
    qs = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    index = ts.build_index(chunks, ["doc_id", "pos"])
    search = ts.search(index, qs, 5)
    want = {q: dict(sorted(brute_tfidf(texts, t).items(), key=lambda x: (-x[1], x[0]))[:5]) for q, t in asked.items()}
    assert found(search.top) == want
    told = ts.report(index, search).agg(F.sum("postings"), F.sum("opened")).first()
    assert told[1] == told[0] if dense == 0 else told[1] < 0.1 * told[0]


def shuffled(spark):
    """Bytes in the shuffle files that the session holds."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().endswith(".data"))


def test_text_search_shuffles_no_pairs(spark):
    """Every chunk shares words with every query: what is shuffled stays under twice the texts."""
    import random

    rng = random.Random(8)
    words = [f"w{i}" for i in range(150)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(2000)]
    chunks = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, pos int, text string")
    qs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=8))) for i in range(100)], "query_id long, text string")
    before, usual = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")      # as if no table were small
    try:
        assert ts.search(ts.build_index(chunks, ["doc_id", "pos"]), qs, 3).top.count() == 300
        assert shuffled(spark) - before < 2 * sum(map(len, texts))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)


@pytest.mark.parametrize("k", [1, 4])
def test_text_search_in_blocks_loses_no_hit(spark, monkeypatch, k):
    """Many blocks of queries, groups of chunks and slices of pairs; copies tie and go by id; most idfs are not broadcast."""
    import random

    for name, value in {"SEGMENT": 7, "GROUP": 20, "TOGETHER": 3, "PAIRS": 5, "HELD": 10, "QUERY_ROWS": 40, "COMMON": 30, "SEED": 1}.items():
        monkeypatch.setattr(ts, name, value)
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(1.1))}" for _ in range(5000)]
    texts = [" ".join(rng.choices(words, k=rng.choice([3, 12, 30]))) for _ in range(120)]
    texts += [texts[5]] * 9 + ["", "- -"]
    asked = {i: " ".join(texts[i].split()[:9]) for i in range(0, 120, 5)}
    chunks = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, pos int, text string")
    # One query in two rows, a chunk without an id and a query without one
    qs = spark.createDataFrame([(500, "w2 w3"), (500, "w3 w9"), (None, "w2"), *asked.items()], "query_id long, text string")
    search = ts.search(ts.build_index(chunks, ["doc_id", "pos"]), qs, k)
    want = {q: dict(sorted(brute_tfidf(texts, t).items(), key=lambda x: (-x[1], x[0]))[:k]) for q, t in {**asked, 500: "w2 w3 w3 w9"}.items()}
    assert found(search.top) == {q: b for q, b in want.items() if b}
    ranks = sorted((r.query_id, r["rank"], r.doc_id) for r in search.top.collect())
    assert [r[2] for r in ranks if r[0] == 5] == [5, *range(120, 129)][:k]


def test_text_index_counts_repeated_and_null_ids(spark):
    """Rows of one id are one chunk, but each counts as a row; chunks without an id count and are never found."""
    rows = [(1, 0, "fox fox"), (1, 0, "car"), (2, 0, "fox"), (None, 0, "fox car"), (3, 0, "dog"), (4, 0, None)]
    index = ts.build_index(spark.createDataFrame(rows, "doc_id long, pos int, text string"), ["doc_id", "pos"])
    assert {r.term: (r.df, round(r.idf, 9)) for r in index.idf.collect()} == {
        "fox": (3, round(math.log(2), 9)), "car": (2, round(math.log(3), 9)), "dog": (1, round(math.log(6), 9))}
    top = ts.search(index, spark.createDataFrame([(7, "fox")], "query_id long, text string"), 5).top.collect()
    weight = 2 * math.log(2) / math.hypot(2 * math.log(2), math.log(3))
    assert [(r.doc_id, round(r.score, 9)) for r in sorted(top, key=lambda r: r["rank"])] == [(2, 1.0), (1, round(weight, 9))]


def test_text_index_is_built_again_when_a_file_changed(spark, tmp_path):
    path = str(tmp_path / "docs")

    def hits(key):
        table = spark.read.schema("doc_id long, pos int, text string").parquet(path)
        qs = spark.createDataFrame([(1, "fox")], "query_id long, text string")
        return key(table), found(ts.search(ts.build_index(table, ["doc_id", "pos"], key=key(table)), qs, 5).top)

    def write(rows, mode):
        spark.createDataFrame(rows, "doc_id long, pos int, text string").coalesce(1).write.mode(mode).parquet(path)

    write([(1, 0, "a fox"), (2, 0, "a car")], "overwrite")
    first = hits(manifest_key)
    tables = len(spark.catalog.listTables())
    assert hits(manifest_key) == first and len(spark.catalog.listTables()) == tables and set(first[1][1]) == {1}
    write([(3, 0, "fox fox")], "append")
    second = hits(manifest_key)
    assert second[0] != first[0] and set(second[1][1]) == {1, 3}


def test_text_search_of_an_empty_index(spark):
    chunks = spark.createDataFrame([], "doc_id long, pos int, text string")
    qs = spark.createDataFrame([(1, "fox")], "query_id long, text string")
    assert ts.search(ts.build_index(chunks, ["doc_id", "pos"]), qs, 5).top.collect() == []


def cosines(corpus, queries, k):
    """(query_id, rank, vec_id, score) over all pairs."""
    out = []
    for q, v in queries:
        scored = []
        for i, x in corpus:
            n = math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(a * a for a in v)) if x is not None and v is not None and len(x) == len(v) else 0
            scored.append((i, round(sum(a * b for a, b in zip(x, v)) / n, 9) if n else None))
        scored.sort(key=lambda s: (s[1] is None, -(s[1] or 0), s[0]))
        out += [(q, r, i, s) for r, (i, s) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("cell_rows,block,group", [(1000, 4096, 1024), (20, 4096, 1024), (20, 7, 2)])
def test_vector_search_equals_all_pairs(spark, monkeypatch, cell_rows, block, group):
    import random

    rng = random.Random(6)
    monkeypatch.setattr(vs, "BLOCK", block)
    monkeypatch.setattr(vs, "QUERIES", group)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    corpus = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)]) for i in range(300)]
    corpus += [(300 + i, centres[0]) for i in range(60)] + [(400, [0.0] * 6), (401, None), (402, [1.0, 2.0])]    # copies, no direction
    queries = [(i, [c + rng.gauss(0, 0.02) for c in centres[i % 8]]) for i in range(12)] + [(90, [0.0] * 6), (91, None), (92, centres[0])]
    c = spark.createDataFrame([(i, "f", v) for i, v in corpus], "vec_id long, file string, embedding array<double>")
    q = spark.createDataFrame(queries, "query_id long, qvec array<double>")
    index = vs.build_index(c, cell_rows=cell_rows)
    got = sorted((r.query_id, r["rank"], r.vec_id, None if r.score is None else round(r.score, 9)) for r in vs.search(index, q, 7).collect())
    assert got == cosines(corpus, queries, 7)
    every = sorted((r.query_id, r["rank"], r.vec_id) for r in vs.search(index, q, 500).collect())
    assert every == [x[:3] for x in cosines(corpus, queries, 500)]


def test_vector_search_closes_rings(spark):
    """In separated groups a query visits few of the vectors, and no plan pairs all."""
    import random

    rng = random.Random(7)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(20)]
    corpus = [(i, "f", [c + rng.gauss(0, 0.01) for c in centres[i % 20]]) for i in range(1000)]
    index = vs.build_index(spark.createDataFrame(corpus, "vec_id long, file string, embedding array<double>"), cell_rows=10)
    q = spark.createDataFrame([(i, centres[i]) for i in range(5)], "query_id long, qvec array<double>").withColumnRenamed("qvec", "q")
    first = vs._visits(index, q, 10, None)
    kth = spark.createDataFrame([(i, 0.99) for i in range(5)], "query_id long, kth double")
    every = first.unionByName(vs._visits(index, q, 10, kth)).join(index.units, ["cell", "ring"])
    assert every.agg(F.sum("n")).first()[0] < 0.3 * 5 * 1000
    plan = vs.search(index, q.withColumnRenamed("q", "qvec"), 10)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_prefilter_scores_allowed_rows_only(spark):
    corpus = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [1.0, 0.1])], "vec_id long, file string, embedding array<float>")
    q = spark.createDataFrame([(7, "P", [1.0, 0.0])], "query_id long, plant string, qvec array<double>")
    refs = spark.createDataFrame([("P", "b"), ("P", "b"), ("Q", "a")], "plant string, file string")
    assert [(r.query_id, r.vec_id) for r in rt.score_allowed(corpus, q, refs).collect()] == [(7, 2)]


def test_search_status_classes(spark):
    qs = spark.createDataFrame([(i, f"P{i}") for i in range(1, 5)], "query_id long, plant string")
    refs = spark.createDataFrame([(f"P{i}", "f") for i in range(2, 5)], "plant string, file string")
    top = spark.createDataFrame([(3, "P3", "g"), (4, "P4", "f")], "query_id long, plant string, file string")
    kept = top.filter("query_id = 4")
    status = {r.query_id: r.status for r in rt.search_status(qs, refs, top, kept, 1).collect()}
    assert status == {1: "no_allowed_files", 2: "no_hit", 3: "no_allowed_hit", 4: "ok"}
    assert {r.status for r in rt.search_status(qs, refs, top, kept, 0).collect()} == {"no_allowed_files", "empty_index"}


def test_pages_without_number_or_file_stay(spark):
    pages = spark.createDataFrame([(None, 1, "x"), ("d", None, "first"), ("d", 2, "second")], "file string, page_no int, text string")
    assert {r.file: r.text for r in rt.chunk_pages(pages).collect()} == {None: "x\n", "d": "first\nsecond\n"}


def test_vector_search_zero_vector_and_ties(spark):
    corpus = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [1.0, 0.0]), (3, "c", [0.0, 0.0])],
                                   "vec_id long, file string, embedding array<float>")
    q = spark.createDataFrame([(7, [2.0, 0.0])], "query_id long, qvec array<double>")
    top = vs.search(vs.build_index(corpus), q, 10).orderBy("rank").collect()
    assert [(r.vec_id, r.rank) for r in top] == [(1, 1), (2, 2), (3, 3)] and top[2].score is None
    _ = F


def test_allowed_chunks_of_every_plant(spark):
    from paygrid.plans import catalog, testmap

    sf = "/root/testdata/sf0.01"
    chunks = [(r.doc_id, r.pos, r.file) for r in catalog.doc_chunk(spark, sf).collect()]
    refs = [(r.plant, r.file) for r in testmap.doc_refs(spark, sf).collect()]
    want = sorted((plant, *c) for plant, file in refs for c in chunks if c[2] == file)
    got = sorted((r.plant, r.doc_id, r.pos, r.file) for r in catalog.allowed_chunks(spark, sf).collect())
    assert got == want and len({r[0] for r in got}) > testmap.N_SELECTABLE


def test_allowed_chunks_meet_in_bounded_cells(spark, monkeypatch):
    """One file with most of the pairs: repeated chunks and plants count, null files meet nothing, and the pairs are dealt evenly."""
    monkeypatch.setattr(rt, "CELL_CHUNKS", 50)
    monkeypatch.setattr(rt, "CELL_PLANTS", 20)
    chunks = [(i % 700, 0, "hot") for i in range(800)] + [(1, 1, "cold"), (2, 1, None), (3, 1, "none")]
    refs = [(f"P{i}", "hot") for i in range(100)] + [("P7", "hot"), (None, "hot"), (None, "cold"), ("P1", None), ("P2", "else")]
    got = rt.allowed(spark.createDataFrame(chunks, "doc_id long, pos int, file string"), spark.createDataFrame(refs, "plant string, file string"))
    want = [(f, d, p, plant) for d, p, f in chunks for plant, g in refs if f is not None and f == g]
    assert got.columns == ["file", "doc_id", "pos", "plant"]
    assert sorted(map(repr, ((r.file, r.doc_id, r.pos, r.plant) for r in got.collect()))) == sorted(map(repr, want))
    shares = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(shares) < 0.2 * sum(shares)


def test_allowed_chunks_are_stored_small(spark, tmp_path):
    """A row of chunk and plant takes a fraction of a byte in a columnar file: chunks and plants go out in runs."""
    chunks = spark.createDataFrame([(i * 7919, i % 5, "hot") for i in range(500)], "doc_id long, pos int, file string")
    refs = spark.createDataFrame([(f"P{i}", "hot") for i in range(1003)], "plant string, file string")
    rt.allowed(chunks, refs).write.parquet(str(tmp_path / "out"))
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert stored.count() == stored.distinct().count() == 500 * 1003
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.3 * 500 * 1003


@pytest.mark.parametrize("name", ["text_search", "context_block"])
def test_text_queries_shuffle_in_proportion_to_the_texts(spark, tmp_path, name):
    import random

    from paygrid.plans import catalog

    rng = random.Random(11)
    words = [f"w{i}" for i in range(150)]
    docs = [(i, f"src{i % 3}", " ".join(rng.choices(words, k=60))) for i in range(2000)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(i, " ".join(rng.choices(words, k=8))) for i in range(100)]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before, usual = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = catalog.REGISTRY[name](spark, str(tmp_path)).collect()
        assert len(rows) == (300 if name == "text_search" else 100)
        assert shuffled(spark) - before < 4 * sum(len(d[2]) for d in docs)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
