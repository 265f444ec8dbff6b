"""Approximate nearest neighbours through low-dimensional stable projections and a kd-tree.

Vectors are scaled to length 1, so the largest cosine is the least distance,
and projected on PROJECTIONS Gaussian directions: the squared projected distance
of two vectors is their squared distance times a chi-square variable.  A
kd-tree over the projections (built from a bounded sample, with at most
MAX_CELLS cells) deals all vectors out; cells that hold more than BLOCK rows
are split by hash into blocks.

A query verifies projected neighbours in the order of their projected distance
and stops once a neighbour at the current k-th distance would, with probability
``sure``, have been projected nearer than all that is left.  It does so in its
home block first; the bound found there selects, by the same test, the other
cells that can still hold neighbours.  Every block returns its k best and a
query's answers are merged by exact cosine.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paygrid.llm.common import cut

PROJECTIONS = 24
#: Rows of the sample that the tree is built from, and the most cells it may have.
SAMPLE, MAX_CELLS = 8192, 1024
#: Rows of a block, and queries that visit a block in one group.
BLOCK, QUERIES = 4096, 1024
SEED = 11
OUT = "query_id long, rank int, vec_id long, score double"
#: Squared distances under this count as equal to 0 in the stopping test (rounding of projections).
TINY = 1e-12


def chi_square_cdf(x: float, df: int) -> float:
    """For an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(df // 2))


def chi_square_quantile(p: float, df: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, df) < p else (low, mid)
    return high


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(dim, PROJECTIONS))


def projected(v: np.ndarray, r: np.ndarray) -> np.ndarray:
    return (v / np.sqrt((v * v).sum(axis=1, keepdims=True))) @ r


class Tree:
    """A kd-tree's cells over a sample: splits at medians of the widest dimension, and each cell's box."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.split: list[tuple[int, float, int, int]] = []  # dimension, value, child at or under it, child above it
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        wide = np.full(PROJECTIONS, np.inf)
        self.root = self._grow(sample, cells, -wide, wide)

    def _grow(self, points: np.ndarray, cells: int, low: np.ndarray, high: np.ndarray) -> int:
        """The number of a split, or -1 minus the number of a cell."""
        spread = np.ptp(points, axis=0) if len(points) else np.zeros(1)
        dim = int(spread.argmax())
        if cells > 1 and spread[dim] > 0:
            value = float(np.median(points[:, dim]))
            if value == points[:, dim].max():  # many ties: keep some above
                value = float(points[points[:, dim] < value, dim].max())
            under = points[:, dim] <= value
            at = len(self.split)
            self.split.append((dim, value, 0, 0))
            left, right = high.copy(), low.copy()
            left[dim] = right[dim] = value
            a = self._grow(points[under], cells // 2, low, left)
            b = self._grow(points[~under], cells - cells // 2, right, high)
            self.split[at] = (dim, value, a, b)
            return at
        self.boxes.append((low, high))
        return -len(self.boxes)

    def plain(self) -> tuple:
        """Root, splits and the boxes' corners, for a broadcast that needs no class of this module."""
        return self.root, self.split, np.array([b[0] for b in self.boxes]), np.array([b[1] for b in self.boxes])


def cell_of(tree: tuple, points: np.ndarray) -> np.ndarray:
    root, split, *_ = tree
    out = np.empty(len(points), np.int32)
    todo = [(root, np.arange(len(points)))]
    while todo:
        node, rows = todo.pop()
        if node < 0:
            out[rows] = -1 - node
            continue
        dim, value, a, b = split[node]
        under = points[rows, dim] <= value
        todo += [(a, rows[under]), (b, rows[~under])]
    return out


def cell_distances(tree: tuple, point: np.ndarray) -> np.ndarray:
    """Squared distance of a point to each cell's box."""
    *_, low, high = tree
    gap = np.maximum(np.maximum(low - point, point - high), 0)
    return (gap * gap).sum(axis=1)


def verified(q, q_proj, own, rows, ids, vecs, norms, proj, k, bound, limit):
    """The k best (score, id) among all rows but ``own``, verified in the order of projected distance up to the stopping test."""
    near = ((proj - q_proj) ** 2).sum(axis=1)
    order = np.argsort(near, kind="stable")
    q_norm = math.sqrt(float((q * q).sum()))
    best_s, best_i = np.zeros(0), np.zeros(0, np.int64)
    at, step = 0, 64
    while at < len(order) and near[order[at]] <= limit * max(bound, TINY):
        pick = order[at : at + step]
        pick = pick[near[pick] <= limit * max(bound, TINY)]
        at, step = at + step, step * 2
        pick = pick[rows[pick] != own]
        scores = (vecs[pick] * q).sum(axis=1) / (norms[pick] * q_norm)
        s, i = np.concatenate([best_s, scores]), np.concatenate([best_i, ids[pick]])
        keep = np.lexsort((i, -s))[:k]
        best_s, best_i = s[keep], i[keep]
        if len(best_s) == k:
            bound = min(bound, max(0.0, 2 - 2 * float(best_s[-1])))
    return best_s, best_i, bound


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(x, np.float64) for x in column])


def scaled(column) -> np.ndarray:
    """The vectors, each divided by a power of two that brings its largest component under 1: cosines stay as they are, and no square overflows."""
    m = _matrix(column)
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])


def usable(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, v): every vector, of doubles, under a number of its own; null, empty, zero and non-finite ones are left out."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return rows.where(fine).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")


def search(vectors: DataFrame, every: int = 50, k: int = 5, sure: float = 0.95) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (ids divisible by ``every``), by cosine.

    A query's own row is no candidate; ties go to the smaller id; with fewer
    candidates than k all are returned.  Each row is a vector of its own: rows
    that repeat an id are candidates of each other, and an id that stands on
    several query rows has k answers for each.  Vectors are compared with those
    of their own dimension, one search for each dimension that has a query.
    Rows without an id take no part; an empty table gives an empty result.
    """
    rows = cut(usable(vectors))
    asked = F.count_if(F.col("vec_id") % every == 0).alias("asked")
    found = None
    for x in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), asked).where("asked > 0 and n > 1").orderBy("d").collect():
        part = _search(rows.where(F.size("v") == x.d), x.d, x.n, every, k, sure)
        found = part if found is None else found.unionAll(part)
    return vectors.sparkSession.createDataFrame([], OUT) if found is None else found


def _search(rows: DataFrame, dim: int, total: int, every: int, k: int, sure: float) -> DataFrame:
    """The answers among ``total`` rows of one dimension."""
    spark = rows.sparkSession
    r, limit = directions(dim), chi_square_quantile(sure, PROJECTIONS)
    sample = rows.orderBy(F.xxhash64("row")).limit(SAMPLE).select("v").collect()
    cells = min(MAX_CELLS, max(1, total // (BLOCK // 2)), max(1, len(sample) // 8))
    tree = Tree(projected(scaled(x.v for x in sample), r), cells)
    shipped = spark.sparkContext.broadcast((r, tree.plain()))

    def place(batches):
        r, tree = shipped.value
        for b in batches:
            v = scaled(b.column("v").to_pylist()) if b.num_rows else np.zeros((0, len(r)))
            p = projected(v, r)
            lists = [pa.array(list(x), pa.list_(pa.float64())) for x in (v, p)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), *lists, pa.array(cell_of(tree, p))], ["row", "vec_id", "v", "p", "cell"])

    placed = rows.mapInArrow(place, "row long, vec_id long, v array<double>, p array<double>, cell int")
    sizes = {x.cell: x["count"] for x in placed.groupBy("cell").count().collect()}  # at most MAX_CELLS rows
    blocks = {c: -(-n // BLOCK) for c, n in sizes.items()}
    n_blocks = F.create_map(*[F.lit(int(x)) for c in sorted(blocks) for x in (c, blocks[c])])
    placed = cut(placed.withColumn("block", F.pmod(F.xxhash64("row"), F.get(F.array(n_blocks), F.lit(0))[F.col("cell")]).cast("int")))

    def home(group: pd.DataFrame) -> pd.DataFrame:
        own, ids, vecs, proj = group["row"].to_numpy(), group["vec_id"].to_numpy(), _matrix(group["v"]), _matrix(group["p"])
        norms, asked = np.sqrt((vecs * vecs).sum(axis=1)), np.flatnonzero(ids % every == 0)
        bounds = [verified(vecs[i], proj[i], own[i], own, ids, vecs, norms, proj, k, 4.0, limit)[2] for i in asked]
        return pd.DataFrame({"asker": own[asked], "query_id": ids[asked], "q": list(vecs[asked]), "qp": list(proj[asked]), "bound": bounds})

    # A block that holds no query is not read into Python.
    with_query = placed.where(F.col("vec_id") % every == 0).select("cell", "block").distinct()
    asked = placed.join(with_query, ["cell", "block"], "left_semi")
    queries = asked.groupBy("cell", "block").applyInPandas(home, "asker long, query_id long, q array<double>, qp array<double>, bound double")

    def visits(batches):
        _, tree = shipped.value
        for b in batches:
            at = [
                np.flatnonzero(cell_distances(tree, np.asarray(p)) <= limit * max(d, TINY)).astype(np.int32)
                for p, d in zip(b.column("qp").to_pylist(), b.column("bound").to_pylist())
            ]
            yield b.append_column("cells", pa.array(at, pa.list_(pa.int32())))

    queries = cut(queries.mapInArrow(visits, "asker long, query_id long, q array<double>, qp array<double>, bound double, cells array<int>"))
    going = queries.withColumn("cell", F.explode("cells")).drop("cells")
    asking = {x.cell: x["count"] for x in going.groupBy("cell").count().collect()}  # at most MAX_CELLS rows
    shares = {c: max(1, -(-asking.get(c, 0) // QUERIES)) for c in blocks}
    n_shares = F.create_map(*[F.lit(int(x)) for c in sorted(shares) for x in (c, shares[c])])
    count = lambda m, c: F.get(F.array(m), F.lit(0))[F.col(c)]
    every_block = F.explode(F.sequence(F.lit(0), count(n_blocks, "cell") - 1))
    every_share = F.explode(F.sequence(F.lit(0), count(n_shares, "cell") - 1))
    going = going.where(F.col("cell").isin(list(blocks))) if len(blocks) < len(tree.boxes) else going
    going = going.withColumn("block", every_block).withColumn("part", F.pmod(F.xxhash64("asker"), count(n_shares, "cell")).cast("int"))
    there = placed.withColumn("part", every_share)

    def answer(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        ids, out = held["vec_id"].to_numpy(), {"asker": [], "query_id": [], "vec_id": [], "score": []}
        if len(ids) and len(asked):
            own, vecs, proj = held["row"].to_numpy(), _matrix(held["v"]), _matrix(held["p"])
            norms = np.sqrt((vecs * vecs).sum(axis=1))
            for asker, query_id, q, qp, bound in zip(asked["asker"], asked["query_id"], _matrix(asked["q"]), _matrix(asked["qp"]), asked["bound"]):
                s, i, _ = verified(q, qp, asker, own, ids, vecs, norms, proj, k, bound, limit)
                out["asker"] += [asker] * len(s)
                out["query_id"] += [query_id] * len(s)
                out["vec_id"] += i.tolist()
                out["score"] += s.tolist()
        return pd.DataFrame(out)

    key = ["cell", "block", "part"]
    found = going.groupBy(*key).cogroup(there.groupBy(*key)).applyInPandas(answer, "asker long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
