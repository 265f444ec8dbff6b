"""Centroid clustering with a vantage-point tree over the centroids.

Every round builds the tree over its centroids on the driver and broadcasts it
(k centroids: the size that the caller states).  Each vector searches it best
first: of the nodes it has not seen it takes the one with the least lower bound
and stops when that bound is above its best distance.  A bound equal to it is
still followed, so a tie finds the smaller number.  Bounds come from the
triangle inequality in doubles, lowered by more than their rounding; distances
that decide are exact integers.

A batch of vectors walks the tree in lockstep, each row with its own queue of
bounds.  A task adds up its vectors per centroid, so a round shuffles
k x (components + 1) numbers a task, whatever the vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paygrid.llm.common import cut

COMPONENTS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Centroids of a leaf, and vectors that walk the tree together.
LEAF, TOGETHER = 2, 4096
#: Largest integer component: squared distances of 64 such components fit 64 bits.
LARGEST = 2**27
SLACK = 1e-9


def integer_vectors(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, v): integer vectors of ``components`` components; others, and those beyond LARGEST, take no part."""
    x = F.transform("embedding", lambda e: e.cast("double") * SCALE)
    fine = (F.size("x") == components) & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) <= LARGEST))
    rows = vectors.select(F.col("vec_id").alias("vec_id"), x.alias("x")).where(F.col("x").isNotNull() & fine)
    return rows.select("vec_id", F.transform("x", lambda e: F.floor(e).cast("int")).alias("v"))


def _matrix(batch, components: int) -> np.ndarray:
    column = batch.column("v")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), components)


def build(centroids: np.ndarray) -> tuple:
    """The tree as plain arrays: per node its vantage point (-1: leaf), two children, and the range of their
    members' distances to the vantage point; and every leaf's members."""
    vantage, child, spans, leaves = [], [], [], []

    def grow(ids: np.ndarray) -> int:
        at = len(vantage)
        vantage.append(-1)
        child.append((0, 0))
        spans.append((0.0, 0.0, 0.0, 0.0))
        leaves.append(ids)
        if len(ids) <= LEAF:
            return at
        own, rest = int(ids[0]), ids[1:]
        far = np.sqrt(((centroids[rest] - centroids[own]) ** 2).sum(axis=1).astype(np.float64))
        order = np.argsort(far, kind="stable")
        half = len(order) // 2
        parts = rest[order[:half]], rest[order[half:]]
        near_far = far[order]
        spans[at] = (near_far[0], near_far[half - 1], near_far[half], near_far[-1]) if half else (np.inf, -np.inf, near_far[0], near_far[-1])
        vantage[at], leaves[at] = own, ids[:0]
        child[at] = tuple(grow(p) if len(p) else -1 for p in parts)
        return at

    if len(centroids):
        grow(np.arange(len(centroids)))
    return np.array(vantage), child, spans, leaves


def nearest(v: np.ndarray, centroids: np.ndarray, tree: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid, the smaller number on a tie."""
    vantage, child, spans, leaves = tree
    n = len(v)
    queue = np.full((n, len(vantage)), np.inf)
    queue[:, 0] = 0.0
    best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, len(centroids))
    rows = np.arange(n)

    def compare(r, ids):
        far = ((v[r, None, :] - centroids[ids]) ** 2).sum(axis=2)
        for j, c in enumerate(ids):
            better = (far[:, j] < best[r]) | ((far[:, j] == best[r]) & (c < who[r]))
            best[r[better]], who[r[better]] = far[better, j], c
        return far

    while True:
        pick = queue.argmin(axis=1)
        low = queue[rows, pick]
        going = np.isfinite(low) & (low <= np.sqrt(best.astype(np.float64)))
        if not going.any():
            return who, best
        for node in np.unique(pick[going]):
            r = np.flatnonzero(going & (pick == node))
            queue[r, node] = np.inf
            if vantage[node] < 0:
                compare(r, leaves[node])
                continue
            away = np.sqrt(compare(r, np.array([vantage[node]]))[:, 0].astype(np.float64))
            for side in (0, 1):
                if child[node][side] >= 0:
                    inner, outer = spans[node][2 * side : 2 * side + 2]
                    gap = np.maximum(inner - away, away - outer) - SLACK * (1 + away + outer)
                    queue[r, child[node][side]] = np.maximum(low[r], np.maximum(gap, 0.0))


def _walk(batches, shipped, components: int):
    """(batch, its vectors, their centroids and distances)."""
    centroids, tree = shipped.value
    for b in batches:
        for at in range(0, b.num_rows, TOGETHER):
            part = b.slice(at, TOGETHER)
            v = _matrix(part, components)
            yield (part, v, *nearest(v, centroids, tree))


def _next(rows: DataFrame, centroids: list[list[int]], components: int) -> list[list[int]]:
    """The centroids after one round."""
    array = np.array(centroids, np.int64)
    shipped = rows.sparkSession.sparkContext.broadcast((array, build(array)))
    k = len(centroids)

    def add_up(batches):
        total = np.zeros((k, components + 1), np.int64)
        for _, v, who, _ in _walk(batches, shipped, components):
            for c in np.unique(who):
                mine = who == c
                total[c, 0] += mine.sum()
                total[c, 1:] += v[mine].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(list(total), pa.list_(pa.int64()))], ["cluster", "total"])

    parts = rows.mapInArrow(add_up, "cluster long, total array<long>").select("cluster", F.posexplode("total").alias("at", "x"))
    sums = [[0] * (components + 1) for _ in range(k)]
    for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():  # k x (components + 1)
        sums[r.cluster][r.at] = int(r.x)
    return [[x // s[0] for x in s[1:]] if s[0] else old for s, old in zip(sums, centroids)]


def seed_order(vec_id: Column, seed: int) -> Column:
    return F.asc_nulls_last(F.sha2(F.concat(F.lit(f"{seed}:"), vec_id.cast("string")), 256))


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, components: int = COMPONENTS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector.

    Centroids start as the ``k`` kept vectors with the smallest sha256 of
    ``seed:vec_id`` (repeated ids: the smaller vector; rows without an id last;
    fewer vectors: fewer centroids), and are replaced ``rounds`` times by the
    floor of their vectors' mean; empty ones stay.  Every row is a vector,
    repeated and null ids too.  Vectors that are null, of another number of
    components, or with a component that is null, not finite or beyond
    LARGEST / 1024 in size take no part.  A sum of distances over 64 bits is
    null.  An empty table gives an empty result.  Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = cut(integer_vectors(vectors, components))
    centroids = [list(r.v) for r in rows.orderBy(seed_order(F.col("vec_id"), seed), "v").limit(k).collect()]
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not centroids:
        empty = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], empty)
    for _ in range(rounds):
        centroids = _next(rows, centroids, components)
    array = np.array(centroids, np.int64)
    shipped = spark.sparkContext.broadcast((array, build(array)))

    def assign(batches):
        for part, _, who, far in _walk(batches, shipped, components):
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(who.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    found = cut(rows.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"))
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(wide.alias("s")).collect()}  # k rows at most
    fits = lambda x: x if x < 2**63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    table = [(c, fits(s), fits(sum(sums.values())), digest(centroids[c])) for c, s in sums.items()]
    report = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(report), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    steps = [
        """WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE len(embedding) = 64 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])),
vec AS MATERIALIZED (SELECT r, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM kept),
c0 AS MATERIALIZED (SELECT c, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v FROM kept) WHERE c < 8)"""
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, min(struct_pack(far := far, c := c)) AS best FROM (
  SELECT r, c, CAST(sum((vec.x - c{i}.x) * (vec.x - c{i}.x)) AS BIGINT) AS far FROM vec JOIN c{i} USING (d) GROUP BY r, c) GROUP BY r)""")
        if i < ROUNDS:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c, d, coalesce(m.x, old.x) AS x FROM c{i} AS old LEFT JOIN (
  SELECT best.c AS c, d, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM vec JOIN a{i} USING (r) GROUP BY best.c, d) AS m USING (c, d))""")
    last = f"a{ROUNDS}"
    steps.append(f"h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)")
    return ",\n".join(steps) + f"""
SELECT kept.vec_id, CAST({last}.best.c AS INTEGER) AS cluster, {last}.best.far AS distance,
  CAST(sum({last}.best.far) OVER (PARTITION BY {last}.best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum({last}.best.far) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM kept JOIN {last} USING (r) JOIN h ON h.c = {last}.best.c"""


SQL = _sql()
