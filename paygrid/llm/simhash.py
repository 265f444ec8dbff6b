"""SimHash near-duplicates through the generalised pigeonhole principle.

Fingerprints are 64 bits; two link if they differ in at most ``max_bits``.

1. Bits that go together are grouped into the same partition (greedily, by the
   correlations of all distinct fingerprints).
2. A dynamic programme gives every partition its own threshold ``t`` (-1: the
   partition is not used) so that the sum of ``t + 1`` is ``max_bits + 1``: a
   linked pair then differs in at most ``t`` bits of some partition.  It
   minimises probes plus estimated candidate pairs, over all partition counts.
3. Every fingerprint is indexed under its value in each partition and probes all
   values within that partition's threshold; candidates are verified inside the
   join, so only links leave it.
4. A bucket of more than ``bucket_rows`` distinct fingerprints is not paired at
   all.  Its fingerprints meet at midpoints instead: two words are within
   ``a + b`` bits exactly if some word is within ``a`` of one and ``b`` of the
   other.  A midpoint links all that reach it to one of them, so a group of n
   costs n rows times a constant, never n squared, and no link is lost.
5. Components of the links come from alternating large-star and small-star
   rounds, each cut off through the shared checkpoint folder.

Copies share a fingerprint and are one node throughout.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paygrid.llm.common import cut, fresh, whole_texts

BITS = 64
SEED = 42
#: Cost of one probe row (made, shuffled, sorted) in candidate pairs compared inside the join.
PROBE_COST = 8.0


def fingerprint_of(data: bytes, shingle_words: int) -> int:
    """SimHash of one text in UTF-8: a bit is 1 if set in over half of the shingle hashes (repeats included)."""
    import xxhash

    words = data.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashed, view = xxhash.xxh64_intdigest, memoryview(joined)
    k = min(shingle_words, n)
    bounds = list(zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist()))
    ones, block = np.zeros(BITS, np.int64), 1 << 15
    for at in range(0, len(bounds), block):
        part = np.array([hashed(view[a:b], SEED) for a, b in bounds[at : at + block]], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(bounds), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle_words: int = 4) -> Column:
    """A long column: the fingerprint of each whole text; null text counts as empty (fingerprint 0)."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(t, shingle_words) for t in texts.to_pylist()], pa.int64())

    return of(F.coalesce(text, F.lit("")).cast("binary"))


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def ball(bits: list[int], radius: int) -> list[int]:
    """Masks with at most ``radius`` of ``bits`` set, as signed longs."""
    masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(bits, r)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def longs(values: list[int]) -> Column:
    """A constant array, as one literal that the optimizer folds."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def bit_counts(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often each bit is set and how often each two are set together, over all rows."""

    def run(batches):
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            for at in range(0, len(fps), 1 << 16):
                part = fps[at : at + (1 << 16)]
                bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += np.rint(bits.T @ bits).astype(np.int64)
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "n"])

    both = np.zeros((BITS, BITS))
    # 4096 sums, whatever the input
    for r in nodes.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        both[r.i, r.j] = r.n
    return np.diag(both).copy(), both


def group_bits(share: np.ndarray, both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """``parts`` partitions of nearly equal width; each is grown by the bit most correlated with it."""
    sd = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(share, share)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for p in range(parts):
        width = BITS // parts + (p < BITS % parts)
        group = [max(left, key=lambda b: (round(float(corr[b, left].sum()), 9), -b))]
        left.remove(group[0])
        while len(group) < width:
            best = max(left, key=lambda b: (round(float(corr[b, group].sum()), 9), -b))
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def within(share: np.ndarray, bits: list[int], most: int) -> list[float]:
    """Estimated chance that two fingerprints differ in at most t of ``bits``, for t = 0..most."""
    chance = np.zeros(len(bits) + 1)
    chance[0] = 1.0
    for b in bits:
        p = 2 * share[b] * (1 - share[b])
        chance[1:] = chance[1:] * (1 - p) + chance[:-1] * p
        chance[0] *= 1 - p
    return np.cumsum(chance)[: most + 1].tolist()


def allocate(share: np.ndarray, groups: list[list[int]], n: int, max_bits: int) -> tuple[float, list[int]]:
    """Thresholds of least estimated cost with sum of (t + 1) = max_bits + 1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits in groups:
        near = within(share, bits, min(max_bits, len(bits)))
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for t in range(-1, min(max_bits - used, len(bits)) + 1):
                probes = sum(comb(len(bits), k) for k in range(t + 1))
                if t >= 0 and probes > 100_000:
                    break
                more = cost + (n * probes * PROBE_COST + n * n / 2 * near[t] if t >= 0 else 0.0)
                if (key := used + t + 1) not in step or more < step[key][0]:
                    step[key] = (more, [*ts, t])
        best = step
    return best.get(max_bits + 1, (float("inf"), []))


def plan(ones: np.ndarray, both: np.ndarray, n: int, max_bits: int) -> list[tuple[list[int], int]]:
    """The partitions in use, as (bits, threshold)."""
    share = ones / max(n, 1)
    found = []
    for parts in range(1, max_bits + 2):
        groups = group_bits(share, both, n, parts)
        cost, ts = allocate(share, groups, n, max_bits)
        found.append((cost, parts, [(g, t) for g, t in zip(groups, ts) if t >= 0]))
    return min(found, key=lambda x: x[:2])[2]


def _value(fp: Column, bits: list[int]) -> Column:
    """The bits of one partition, side by side."""
    out = F.lit(0).cast("long")
    for k, b in enumerate(bits):
        one = F.shiftrightunsigned(fp, b).bitwiseAND(F.lit(1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(one, k))
    return out


def links(nodes: DataFrame, max_bits: int = 4, bucket_rows: int = 1024) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within ``max_bits``; ``nodes.fp`` is distinct."""
    n = nodes.count()
    parts = plan(*bit_counts(nodes), n, max_bits)
    fp = F.col("fp")

    def keys(radius: bool) -> DataFrame:
        def of(p: int, bits: list[int], t: int) -> Column:
            masks = longs(ball(range(len(bits)), t if radius else 0))
            return F.transform(masks, lambda m: F.struct(F.lit(p).alias("part"), _value(fp, bits).bitwiseXOR(m).alias("key")))

        return nodes.select("fp", F.inline(F.concat(*[of(p, bits, t) for p, (bits, t) in enumerate(parts)])))

    index, probes = keys(False), keys(True)
    hot = index.groupBy("part", "key").count().where(F.col("count") > bucket_rows).select("part", "key")
    cold = index.join(hot, ["part", "key"], "left_anti").withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    # Sizes are estimated from before the explode, so the joins are told not to broadcast.
    pairs = probes.withColumnRenamed("fp", "a").join(cold.hint("merge"), ["part", "key"]).where((F.col("a") < F.col("b")) & near)
    # A pair in which only one side lies in a hot bucket of this partition meets through the other side's probes,
    # unless those go to hot buckets too; then both are here.
    crowd = probes.join(hot, ["part", "key"], "left_semi").select("fp").union(index.join(hot, ["part", "key"], "left_semi").select("fp")).distinct()
    return pairs.select("a", "b").union(through_midpoints(crowd, max_bits)).distinct()


def through_midpoints(nodes: DataFrame, max_bits: int) -> DataFrame:
    """Edges from each fingerprint to one that shares a midpoint with it; exact, and linear in the rows."""
    far, close = (max_bits + 1) // 2, max_bits // 2
    inner = sum(comb(BITS, k) for k in range(close + 1))
    masks = longs(ball(range(BITS), far))
    reach = nodes.select("fp", F.posexplode(masks).alias("pos", "mask"))
    reach = reach.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("mid"), (F.col("pos") < inner).alias("close"))
    centre = reach.groupBy("mid").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("a"), F.count("*").alias("n"))
    centre = centre.where((F.col("n") > 1) & F.col("a").isNotNull()).select("mid", "a")
    return reach.join(centre.hint("merge"), "mid").where(F.col("fp") != F.col("a")).select("a", F.col("fp").alias("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node reachable."""
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        print_of = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if seen == tuple(print_of):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(print_of)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("w"), "u", "m")
        small = small.select(F.col("w").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").distinct())


def named_groups(prints: DataFrame, max_bits: int, bucket_rows: int) -> DataFrame:
    """(fp, root, component_id) for every distinct fingerprint of ``prints`` (doc_id, fp)."""
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected(links(nodes, max_bits, bucket_rows))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    groups = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return named.join(groups, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, max_bits: int = 4, shingle_words: int = 4, bucket_rows: int = 1024) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (hex), component_id (smallest doc_id reachable, itself included).

    Null and empty texts have fingerprint 0 and link like any other.  Null ids
    never name a component (a component of null ids alone has a null name);
    repeated rows keep their repeats; an empty table gives an empty result.
    """
    prints = cut(whole_texts(docs).select("doc_id", fingerprint(F.col("text"), shingle_words).alias("fp")))
    names = named_groups(prints, max_bits, bucket_rows)
    return prints.join(names, "fp").select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, max_bits: int = 4, shingle_words: int = 4, bucket_rows: int = 1024) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of its smallest doc_id.

    Of several rows of a group with this id the least by text stands for it.  An
    id may head several groups, if it stands on unlike texts: each keeps a row.
    A group without any id keeps one row, again the least by text.
    """
    prints = cut(whole_texts(docs).select("doc_id", fingerprint(F.col("text"), shingle_words).alias("fp")))
    names = cut(named_groups(prints, max_bits, bucket_rows))
    key, fp, pick, root, name = fresh(docs, "group_key", "group_print", "group_pick", "group_root", "group_name")
    whole = F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias(pick)
    heads = names.where("component_id is not null").select(F.col("component_id").alias(key)).distinct()
    unlike = prints.where("doc_id is not null").groupBy(F.col("doc_id").alias(key)).agg((F.min("fp") != F.max("fp")).alias(root)).where(root).select(key)
    # An id that stands on one fingerprint belongs to one group.
    plain = docs.join(heads.join(unlike, key, "left_anti"), F.col("doc_id") == F.col(key), "left_semi")
    kept = plain.groupBy(F.col("doc_id").alias(key)).agg(whole).select(pick)
    # Rows of the other ids, and those without one, are told to their group by their text.
    odd = docs.join(heads.join(unlike, key, "left_semi"), F.col("doc_id") == F.col(key), "left_semi").unionByName(docs.where("doc_id is null"))
    groups = names.select(F.col("fp").alias(fp), F.col("root").alias(root), F.col("component_id").alias(name))
    odd = odd.withColumn(fp, fingerprint(F.col("text"), shingle_words)).join(groups, fp).where(F.col("doc_id").eqNullSafe(F.col(name)))
    return kept.union(odd.groupBy(root).agg(whole).select(pick)).select(f"{pick}.*")
