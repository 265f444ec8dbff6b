"""Exact vector search that skips what a bound rules out.

Vectors are dealt to cells by their nearest pivot (a bounded, hashed sample of
the vectors) and, within a cell, to rings by their angle to it.  Angles obey the
triangle inequality: no vector of a ring is nearer to a query than the gap
between the query's angle to the pivot and the ring's range of angles.  A query
looks at its nearest rings first, until they hold k vectors; the k-th score
there closes every ring whose bound is below it.  What is left is scored in
full, so the answer is that of comparing all.

Rings of many vectors (copies of one vector, say) are split by hash into blocks
of about BLOCK rows, and queries that visit a block come in groups of QUERIES.
Work meets in an equi-join on the block; nothing is paired that a bound closes.
"""

from __future__ import annotations

import sys
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as vx
from ..session import ensure_checkpoint_dir

# What tasks run is shipped with the task: executors need numpy and pandas, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELL_ROWS, MAX_CELLS = 4096, 512
RING = 0.05            # radians of a ring
BLOCK, QUERIES = 4096, 1024
ROUNDING = 4e-9        # scores are ranked by nine places; also more than what angles lose in doubles
NO_DIRECTION = -1      # the cell of zero and null vectors


class VectorIndex(NamedTuple):
    id_col: str
    rows: DataFrame      # id_col, file, v, cell, ring, block
    units: DataFrame     # cell, ring, low, high, n, blocks
    pivots: np.ndarray   # unit vectors, one per cell


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norms > 0, norms, 1.0)


def _angles(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(m) @ pivots.T, -1.0, 1.0))


def _matrix(column, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column):
        out[i] = v
    return out


def build_index(corpus: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cell_rows: int | None = None) -> VectorIndex:
    """The corpus (``id_col, file, vec_col``) by cell, ring and block, in the shared checkpoint folder.

    Zero, null and other-dimensional vectors have no direction: they stand in a
    cell of their own and score null.  The dimension is the pivots' most frequent."""
    spark = corpus.sparkSession
    ensure_checkpoint_dir(spark)
    rows = corpus.select(id_col, "file", vx.as_double(vec_col).alias("v"))
    useful = rows.filter((vx.norm("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
    n = useful.count()
    cells = min(MAX_CELLS, max(1, n // (cell_rows or CELL_ROWS)))
    sample = [r.v for r in useful.orderBy(F.xxhash64(id_col), id_col).limit(cells).select("v").collect()]
    dims = [len(v) for v in sample]
    dim = max(sorted(set(dims)), key=dims.count) if dims else 0
    pivots = _unit(np.array([v for v in sample if len(v) == dim])) if dims else np.zeros((0, 0))
    shipped = spark.sparkContext.broadcast(pivots)

    def place(v: pd.Series) -> pd.DataFrame:
        pivots = shipped.value
        fine = [x is not None and len(x) == dim and dim > 0 and bool(np.isfinite(np.asarray(x, float)).all()) and np.any(x) for x in v]
        cell, angle = np.full(len(v), NO_DIRECTION, np.int32), np.zeros(len(v))
        at = np.flatnonzero(fine)
        if len(at):
            a = _angles(_matrix(v.iloc[at], dim), pivots)
            cell[at], angle[at] = a.argmin(axis=1), a.min(axis=1)
        return pd.DataFrame({"cell": cell, "angle": angle})

    placed = rows.withColumn("p", F.pandas_udf(place, "cell int, angle double")("v")).select(id_col, "file", "v", "p.*")
    placed = placed.withColumn("ring", F.floor(F.col("angle") / RING).cast("int")).checkpoint()
    units = placed.groupBy("cell", "ring").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("n"))
    units = units.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).checkpoint()
    # One row per cell and ring: at most MAX_CELLS * 63.
    dealt = placed.join(F.broadcast(units.select("cell", "ring", "blocks")), ["cell", "ring"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(id_col), F.col("blocks")).cast("int")).drop("blocks", "angle")
    return VectorIndex(id_col, dealt, units, pivots)


def _visits(index: VectorIndex, queries: DataFrame, k: int, found: DataFrame | None) -> DataFrame:
    """``query_id, q, cell, ring, block``: the first visits of each query, or, given the
    k-th scores ``found`` there, all the others that can matter."""
    units = index.units.orderBy("cell", "ring").collect()
    cell, low, high, n = (np.array([u[c] for u in units]) for c in ("cell", "low", "high", "n"))
    names = [(int(u.cell), int(u.ring), int(u.blocks)) for u in units]
    pivots, dim = index.pivots, index.pivots.shape[1]
    some, first = cell >= 0, found is None

    def plan(q, kth: float | None) -> list[int]:
        v = np.asarray(q, float) if q is not None else np.zeros(0)
        if len(v) != dim or not dim or not np.isfinite(v).all() or not v.any():
            return list(range(len(cell))) if first else []       # every score is null: ids decide
        away = _angles(v[None], pivots)[0]
        gap = np.full(len(cell), np.pi)
        at = away[cell[some]]
        gap[some] = np.maximum(np.maximum(at - high[some], low[some] - at), 0.0)
        order = np.lexsort((np.arange(len(cell)), gap, ~some))
        enough = int(np.searchsorted(np.cumsum(np.where(some, n, 0)[order]), k)) + 1
        if first:
            return order[:enough].tolist()
        best = np.where(some, np.cos(gap), -np.inf)
        return [int(u) for u in order[enough:] if np.isnan(kth) or best[u] >= kth - ROUNDING]

    def visit(batches):
        for b in batches:
            kth = b["kth"] if "kth" in b else [None] * len(b)
            at = [[names[u] for u in plan(q, x)] for q, x in zip(b["q"], kth)]
            yield pd.DataFrame({"query_id": b["query_id"], "q": b["q"],
                                "at": [[{"cell": c, "ring": r, "blocks": s} for c, r, s in a] for a in at]})

    asked = queries if found is None else queries.join(found, "query_id", "left")
    fields = T.StructType([asked.schema["query_id"], T.StructField("q", T.ArrayType(T.DoubleType())),
                           T.StructField("at", T.ArrayType(T.StructType.fromDDL("cell int, ring int, blocks int")))])
    x = asked.mapInPandas(visit, fields).select("query_id", "q", F.explode("at").alias("at"))
    return x.select("query_id", "q", "at.cell", "at.ring", F.explode(F.sequence(F.lit(0), F.col("at.blocks") - 1)).alias("block"))


def _scored(index: VectorIndex, visits: DataFrame, k: int) -> DataFrame:
    """The k best of each visited block: ``query_id, id_col, file, score``."""
    id_col, key = index.id_col, ["cell", "ring", "block", "part"]
    visits = visits.checkpoint()
    asking = visits.groupBy(*key[:3]).agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts"))
    asked = visits.join(asking, key[:3]).select("query_id", "q", *key[:3], F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part"))
    groups = asking.select(*[F.col(c).alias(f"_{c}") for c in (*key[:3], "parts")])
    same = [index.rows[c] == groups[f"_{c}"] for c in key[:3]]
    held = index.rows.join(groups, same).select(id_col, "file", "v", *key[:3], F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"))

    def compare(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values(id_col, kind="stable")
        out = []
        dim = max((len(v) for v in held["v"] if v is not None), default=0)
        usable = np.array([v is not None and len(v) == dim for v in held["v"]], bool)
        m = np.zeros((len(held), dim))
        for i in np.flatnonzero(usable):
            m[i] = held["v"].iloc[i]
        norms = np.sqrt((m * m).sum(axis=1))
        for query, q in zip(asked["query_id"], asked["q"]):
            v = np.asarray(q, float) if q is not None else np.zeros(0)
            size = float(np.sqrt((v * v).sum()))
            score = np.full(len(held), np.nan)
            if size > 0 and len(v) == dim:
                some = norms > 0
                score[some] = (m[some] @ v) / (norms[some] * size)
            order = np.lexsort((np.arange(len(held)), -np.where(np.isnan(score), -np.inf, np.round(score, 9))))[:k]
            out += [(query, held[id_col].iloc[i], held["file"].iloc[i], None if np.isnan(score[i]) else float(score[i])) for i in order]
        return pd.DataFrame(out, columns=["query_id", id_col, "file", "score"])

    fields = T.StructType([visits.schema["query_id"], index.rows.schema[id_col], index.rows.schema["file"], T.StructField("score", T.DoubleType())])
    found = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(compare, fields)
    return found.filter(F.col("query_id").isNotNull())


def _rank(scored: DataFrame, k: int, id_col: str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc_nulls_last(), id_col)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(index: VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, id_col, file, score, rank``: the k largest cosines of each query (``query_id, qvec``).

    Ties (at nine places) go to the smaller id; rows without a direction, and all
    rows for a query without one, score null and rank last by id."""
    asked = queries.select("query_id", vx.as_double("qvec").alias("q"))
    first = _scored(index, _visits(index, asked, k, None), k).checkpoint()
    best = _rank(first, k, index.id_col).groupBy("query_id").agg(F.count("score").alias("n"), F.min("score").alias("least"))
    # Fewer than k scores: the rest of the rows may follow, those without a direction too.
    kth = best.select("query_id", F.when(F.col("n") == k, F.col("least")).otherwise(F.lit(float("nan"))).alias("kth"))
    rest = _scored(index, _visits(index, asked, k, kth), k)
    return _rank(first.unionByName(rest), k, index.id_col)
