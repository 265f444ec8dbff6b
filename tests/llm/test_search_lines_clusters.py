"""Lexical search, line dedup and centroid clustering against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from paygrid.llm import lexical, linededup, vptree
from tests.llm import helpers as h

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def awkward(spark):
    return h.docs(spark, h.AWKWARD).repartition(3).cache()


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return h.docs(spark, [])


# 11: lexical search ----------------------------------------------------------


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(text or ""))


def ranked(docs, items, k=20):
    """Counter of (item_id, rank, doc_id, score) by the contract's formulas, one pair at a time."""
    texts = [(d, Counter(t)) for d, t in ((d, terms(x)) for d, x in docs) if t]
    n_docs, total = len(texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    asked = {}
    for i, x in items:
        asked.setdefault(i, Counter()).update(terms(x))
    out = Counter()
    for i, q in asked.items():
        scores = []
        for d, c in texts:
            n = sum(c.values())
            m = 100 - 25 + (25 * n * n_docs) // total
            s = 0
            for t, times in q.items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    s += times * w * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        for rank, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1):
            out[i, rank, d, -s] += 1
    return out


ITEMS = [
    (1, "Quick brown FOX fox fox"), (1, "lazy dog"), (2, "é ü 12"), (3, ""), (4, None), (5, "zzz unknown"), (None, "birds long"),
    (6, "long " * 5000), (7, h.LINE), (7, h.LINE), (8, "12 34 ٣"),
]


def items(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "item_id long, text string, score long, doc_id string")


def asked(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize("k", [1, 2, 20])
def test_search_of_awkward_texts(spark, awkward, k):
    got = asked(lexical.search(awkward, items(spark, ITEMS), k))
    assert got == ranked([(d, t) for d, t, *_ in h.AWKWARD], ITEMS, k)


@pytest.mark.parametrize("postings,rows", [(400_000, 200_000), (50, 200_000), (3000, 40)])
def test_search_in_blocks(spark, small, monkeypatch, postings, rows):
    monkeypatch.setattr(lexical, "POSTINGS", postings)
    monkeypatch.setattr(lexical, "ITEM_ROWS", rows)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = asked(lexical.search(small.repartition(3), bench))
    assert got == ranked([(r.doc_id, r.text) for r in small.collect()], [(r.item_id, r.text) for r in bench.collect()])


def test_search_of_copies_and_ties(spark):
    """A third of all rows are one text: ties by id, repeated rows as documents of their own."""
    rows = [(i, "same words here", None, None) for i in range(300)] + [(i, f"word{i} here", None, None) for i in range(600)]
    rows += [(5, "same words here", None, None)] * 3
    asks = [(1, "same here"), (2, "here"), (3, "word7 word8 words")]
    assert asked(lexical.search(h.docs(spark, rows).repartition(4), items(spark, asks))) == ranked([r[:2] for r in rows], asks)


def test_search_of_empty_tables(spark, empty, awkward):
    for docs, asks in ((empty, ITEMS), (awkward, []), (h.docs(spark, [(1, None, None, None), (2, "!!", None, None)]), ITEMS)):
        out = lexical.search(docs, items(spark, asks))
        assert out.collect() == [] and out.columns == ["item_id", "rank", "doc_id", "score"]


def test_accumulators_are_limited():
    """Rare terms settle the best k; the frequent one then updates survivors only, exactly."""
    rng = np.random.default_rng(1)
    postings = {0: (np.arange(10), np.full(10, 80)), 1: (np.arange(1000), rng.integers(1, 5, 1000))}
    docs, scores = lexical.evaluate([0, 1], [1000, 1], postings, 1000, 5, 0)
    assert docs.tolist() == list(range(10))
    assert scores.tolist() == [80000 + int(x) for x in postings[1][1][:10]]
    docs, _ = lexical.evaluate([0, 1], [1, 100], postings, 1000, 5, 0)
    assert len(docs) == 1000
    docs, _ = lexical.evaluate([0, 1], [1, 1], postings, 1000, 5, 10**9)
    assert len(docs) == 0


# 12: line dedup ---------------------------------------------------------------


def lines(rows, min_chars=20, min_docs=3):
    """Counter of (doc_id, n_lines, n_dropped, kept) by the definition."""
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held.setdefault(key(x), set()).add(d)
    top = {k: max(d for d in ids if d is not None) for k, ids in held.items() if len(ids) >= min_docs}
    out = Counter()
    for d, t in rows:
        every = (t or "").split("\n")
        stay = [x for x in every if key(x) not in top or top[key(x)] == d]
        out[d, len(every), len(every) - len(stay), h.sha("\n".join(stay))] += 1
    return out


LONG = "This is a line of TWENTY characters or more"
LINES = [
    (1, f"{LONG}\nown one\n{LONG.lower()}  \n{LONG}"), (2, f"\t{LONG}\r\nx"), (3, LONG), (3, LONG), (3, f"other text\n{LONG}"),
    (None, f"{LONG}\nnull id"), (None, LONG), (4, "short\nshort"), (5, "short"), (6, "short"), (7, ""), (8, None), (9, "\n\n\n"),
    (10, "twenty characters ééé"), (11, "Twenty characters ééé"), (12, "twenty characters ééé \n"), (13, "exactly 19 chars ..."),
    (14, "held by two documents only"), (15, "held by two documents only"), (16, "held by 16 and nulls ......"), (None, "held by 16 and nulls ......"),
    (17, "\n".join(f"line number {i} of a very long text" for i in range(20_000)) + f"\n{LONG}"),
    (18, "\n".join([LONG] * 5000)), (19, "nineteen characters"), (20, "nineteen characters"), (21, "nineteen characters"),
    (22, "all of it goes away here"), (23, "all of it goes away here"), (24, "all of it goes away here"),
]


def digest_rows(df):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("which", ["lines", "awkward", "small", "empty"])
def test_lines(spark, which, request):
    docs = h.docs(spark, [(d, t, None, None) for d, t in LINES]).repartition(3) if which == "lines" else request.getfixturevalue(which)
    assert digest_rows(linededup.digests(docs)) == lines([(r.doc_id, r.text) for r in docs.collect()])


def test_hot_line_and_hot_id(spark):
    """A line in a third of all documents, and a third of all rows without an id."""
    rows = [(i, f"{LONG}\nown line {i} of document {i}", None, None) for i in range(200)]
    rows += [(None, f"another line that is common\n{i}", None, None) for i in range(200)] + [(i, "plain", None, None) for i in range(200, 400)]
    rows += [(i, "another line that is common", None, None) for i in (400, 401)]
    assert digest_rows(linededup.digests(h.docs(spark, rows).repartition(5))) == lines([r[:2] for r in rows])


@pytest.mark.parametrize("batches,fan,least", [(1, 2, 3), (7, 2, 3), (5, 3, 2), (3, 10, 1)])
def test_levels(spark, batches, fan, least):
    rng = random.Random(3)
    pool = [f"a pooled line of text, number {i}" for i in range(30)]
    rows = [(rng.choice([None, *range(60)]), "\n".join(rng.choices(pool, k=rng.randint(0, 4))), None, None) for _ in range(120)]
    if least == 1:
        rows = [r for r in rows if r[0] is not None]
    out = linededup.deduplicated(h.docs(spark, rows), batches=batches, fan=fan, min_docs=least)
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, h.sha(r.text)) for r in out.collect())
    assert got == lines([r[:2] for r in rows], min_docs=least)


def test_runs_are_sorted_merged_and_never_shuffled(spark):
    runs = linededup.Runs(spark, settled=2, fan=2)
    for batch in ([(1, 1, 9), (2, 2, 9)], [(1, 1, 8), (3, 3, 8)], [(1, 1, 7), (2, 2, 6)], [(1, 1, 5)]):
        runs.add(spark.createDataFrame(batch, "a long, b long, doc_id long"))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    got = sorted(tuple(r) for r in runs.runs()[0].select("a", "n", "top").collect())
    assert got == [(1, 2, 9), (2, 2, 9), (3, 1, 8)]  # line 1 was settled after two batches and adds nothing more
    assert sorted(tuple(r) for r in runs.repeated().collect()) == [(1, 1, 9), (2, 2, 9)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        two = runs._merged([runs.runs()[0], spark.table(runs.written[0])])
        plan = two._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    runs.forget()


def test_line_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a\nb", 5, "gone", 2, 3)], "doc_id long, text string, n_lines int, gone string, pos int, t int")
    out = linededup.deduplicated(docs).first().asDict()
    assert out == {"doc_id": 1, "text": "a\nb", "n_lines": 5, "gone": "gone", "pos": 2, "t": 3, "n_lines_": 2, "n_dropped_": 0}


# 13: centroid clustering -------------------------------------------------------


def clustered(rows, k=8, rounds=10, seed=3):
    """Counter of the contract's rows in exact integers, every distance computed."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) * 1024 <= 2**27 for x in v):
            kept.append((i, [math.floor(1024 * x) for x in v]))
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in seeds[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        groups = {}
        for (_, v), (_, c) in zip(kept, assign()):
            groups.setdefault(c, []).append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centroids)]
    found = assign()
    inertia = Counter()
    for far, c in found:
        inertia[c] += far
    digest = [h.sha(",".join(map(str, c))) for c in centroids]
    return Counter((i, c, far, inertia[c], sum(inertia.values()), digest[c]) for (i, _), (far, c) in zip(kept, found))


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 3, 4, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, v int, distance string")


def cluster_rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_clusters_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").repartition(3)
    assert cluster_rows(vptree.cluster(table)) == clustered([(r.vec_id, r.embedding) for r in table.collect()])


def test_clusters_of_awkward_vectors(spark):
    rng = random.Random(2)
    some = [(i, [rng.choice([-0.5, 0.0, 0.25, 1 / 3]) for _ in range(64)]) for i in range(60)]
    rows = some + some[:20] + [(None, some[0][1]), (None, some[1][1]), (100, None), (101, []), (102, [0.0] * 63), (103, [0.0] * 65)]
    rows += [(104, [float("nan")] + [0.0] * 63), (105, [float("inf")] * 64), (106, [None] + [0.0] * 63), (107, [0.0] * 64), (108, [0.0] * 64)]
    rows += [(109, [1e300] * 64), (110, [131072.0] * 64), (111, [-131072.0] * 64), (112, [131073.0] * 64)]
    assert cluster_rows(vptree.cluster(vectors(spark, rows).repartition(4))) == clustered(rows)


def test_clusters_of_equal_vectors(spark):
    """Ties of all centroids go to number 0; empty centroids stay; fewer vectors than centroids."""
    rows = [(i, [0.5] * 64) for i in range(30)]
    assert cluster_rows(vptree.cluster(vectors(spark, rows))) == clustered(rows)
    rows = [(i, [float(i)] * 64) for i in range(3)]
    assert cluster_rows(vptree.cluster(vectors(spark, rows))) == clustered(rows)


def test_clusters_of_nothing(spark):
    for rows in ([], [(1, None)]):
        out = vptree.cluster(vectors(spark, rows))
        assert out.collect() == []
        assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("k", [1, 2, 3, 8, 57, 300])
def test_tree_finds_the_nearest(k):
    rng = np.random.default_rng(k)
    centroids = rng.integers(-6, 6, (k, 4))
    centroids[k // 2 :] = centroids[: k - k // 2]  # equal ones too
    v = rng.integers(-8, 8, (500, 4))
    who, far = vptree.nearest(v, centroids, vptree.build(centroids))
    every = ((v[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (far == every.min(axis=1)).all() and (who == every.argmin(axis=1)).all()


def test_tree_prunes():
    """In separated groups most centroids are never compared."""
    rng = np.random.default_rng(0)
    centroids = np.repeat(rng.integers(-10**6, 10**6, (32, 8)), 8, axis=0) + rng.integers(-50, 50, (256, 8))
    v = centroids[rng.integers(0, 256, 400)] + rng.integers(-5, 5, (400, 8))
    vantage, child, spans, leaves = vptree.build(centroids)
    seen = []

    class Counted(list):
        def __getitem__(self, at):
            seen.append(at)
            return super().__getitem__(at)

    who, _ = vptree.nearest(v, centroids, (vantage, child, spans, Counted(leaves)))
    assert (who == ((v[:, None] - centroids[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    one = []
    for row in v[:50]:
        seen.clear()
        vptree.nearest(row[None], centroids, (vantage, child, spans, Counted(leaves)))
        one.append(len(seen))
    assert np.mean(one) < 0.25 * sum(vantage < 0)
