"""Exact substring dedup of 13-word windows behind a count-min prefilter.

Pass 1 counts, per partition, the *items* of the windows in a count-min sketch
of two rows.  The item of a window is the least hash among the 8-word runs it
holds: equal windows have equal items, so an item's count never falls short of
its windows' counts, and neighbouring windows share one item.  A document
counts an item once.  The partition sketches are merged slot range by slot
range into a bit map a row (slots counted at least twice) and the list of hot
slots.  The bit maps have a fixed size bound (``max_bits``) and are broadcast.

Pass 2 emits only windows whose item both rows call repeated and groups them by
a 96-bit window hash: a window is removed unless its document has the smallest
id that holds it.  Fewer sketch bits let more windows through to the exact
grouping; they never lose one.

A window that very many documents hold would meet in one task.  So windows with
a hot item are counted first, pre-aggregated per task; those that really are
hot are few (at most all windows divided by the hot count, which grows with the
input), their least ids are broadcast, and their rows need no grouping.
"""

from __future__ import annotations

from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paygrid.llm.bpe import slices
from paygrid.llm.common import partitions, whole_texts, worker_cache

WINDOW = 13
RUN = 8
ROWS = 2
#: Slot ranges that are merged separately.
REGION_BITS = 8
#: Documents from which a window counts as hot, at least; and the most hot slots of a sketch row.
HOT, HOT_SLOTS = 1024, 1_000_000
#: Bytes of text that give one item, about.
ITEM_BYTES = 20
#: Items a task holds before it sends off its sketch.
FLUSH = 4_000_000
VOCABULARY = 1_000_000
#: A task's counts in one slot range: gaps between the slots named (2 or, if wide, 4 bytes), then places and counts of those over 1.
PIECE = pa.schema([("row", pa.int32()), ("region", pa.int32()), ("wide", pa.bool_()), ("gaps", pa.binary()), ("many", pa.binary())])
#: Stands for a null id in a minimum.
NO_ID = np.int64((1 << 63) - 1)
MIX = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Word to position in a table of 128-bit word hashes, filled as words come up."""

    def __init__(self):
        self.low, self.high = array("Q"), array("Q")

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_128_intdigest(word)
        self.low.append(h & 0xFFFFFFFFFFFFFFFF)
        self.high.append(h >> 64)
        self[word] = n = len(self.low) - 1
        return n


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def sums(h: np.ndarray, length: int, seed: int) -> np.ndarray:
    """A hash of each run of ``length`` words: the word hashes times odd factors, summed."""
    factors = np.random.default_rng(seed).integers(1, 1 << 63, length, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n = len(h) - length + 1
    out = np.zeros(n, np.uint64)
    for j in range(length):
        out += h[j : j + n] * factors[j]
    return mixed(out)


class Texts:
    """The windows of a run of texts, side by side."""

    def __init__(self, texts: list[bytes]):
        cache = worker_cache()
        words = cache.get("words")
        if words is None or len(words) > VOCABULARY:
            words = cache["words"] = Words()
        split = [t.split() for t in texts]  # of bytes: ASCII white space only
        self.counts = np.fromiter(map(len, split), np.int64, len(split))
        total = int(self.counts.sum())
        ids = np.fromiter(map(words.__getitem__, chain.from_iterable(split)), np.int64, total)
        self.low = np.array(words.low, np.uint64)[ids] if total else np.zeros(0, np.uint64)
        self.high = np.array(words.high, np.uint64)[ids] if total else np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(len(split)), self.counts)
        n = max(0, total - WINDOW + 1)
        self.start = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :]) if n else np.zeros(0, np.int64)
        self.doc = doc[self.start] if n else np.zeros(0, np.int64)
        first = np.cumsum(self.counts) - self.counts
        self.pos = self.start - first[self.doc]

    def items(self) -> np.ndarray:
        """The item of each window."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        runs = sums(self.low, RUN, 1)
        n = len(runs) - (WINDOW - RUN)
        least = runs[:n].copy()
        for j in range(1, WINDOW - RUN + 1):
            np.minimum(least, runs[j : j + n], out=least)
        return least[self.start]

    def distinct_items(self) -> np.ndarray:
        """Every document's items, once each."""
        items, doc = self.items(), self.doc
        if not len(items):
            return items
        new = np.ones(len(items), bool)
        new[1:] = (items[1:] != items[:-1]) | (doc[1:] != doc[:-1])
        items, doc = items[new], doc[new]
        order = np.lexsort((items, doc))
        items, doc = items[order], doc[order]
        new = np.ones(len(items), bool)
        new[1:] = (items[1:] != items[:-1]) | (doc[1:] != doc[:-1])
        return items[new]


def slots(items: np.ndarray, row: int) -> np.ndarray:
    """32-bit slots of a row; a narrower sketch drops low bits."""
    return ((items if row == 0 else mixed(items ^ MIX)) >> np.uint64(32)).astype(np.uint32)


def batched(batch: pa.RecordBatch, column: str, size: int = 4_000_000):
    for part in slices(batch, column, size):
        yield part, Texts([t or b"" for t in part.column(column).to_pylist()])


def sketch(docs: DataFrame, bits: int, hot: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The merged sketch: a bit map [row, slot] of slots counted at least twice, and a row's slots counted at least ``hot`` times."""
    shift = np.uint32(32 - bits)
    width = 1 << (bits - REGION_BITS)

    def count(batches):
        def sent(held):
            items = np.concatenate(held)
            for row in range(ROWS):
                at, n = np.unique(slots(items, row) >> shift, return_counts=True)
                region = at >> np.uint32(bits - REGION_BITS)
                ends = np.searchsorted(region, np.arange((1 << REGION_BITS) + 1))
                inside = (at & np.uint32(width - 1)).astype("<u4")
                n = np.minimum(n, hot).astype("<u4")
                out = []
                for r in range(1 << REGION_BITS):
                    a, b = ends[r], ends[r + 1]
                    if a == b:
                        continue
                    gaps = np.diff(inside[a:b], prepend=np.uint32(0))
                    wide = bool(gaps.max() >> 16)
                    many = np.flatnonzero(n[a:b] > 1).astype("<u4")
                    out.append((row, r, wide, gaps.astype("<u4" if wide else "<u2").tobytes(), many.tobytes() + n[a:b][many].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), PIECE.types)], schema=PIECE)

        held, n = [], 0
        for batch in batches:
            for _, texts in batched(batch, "text"):
                held.append(texts.distinct_items())
                n += len(held[-1])
                if n >= FLUSH:
                    yield from sent(held)
                    held, n = [], 0
        if n:
            yield from sent(held)

    def merge(batches):
        now, counts = None, None

        def closed():
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([np.packbits(counts >= 2).tobytes()]), pa.array([np.flatnonzero(counts >= hot).astype("<u4").tobytes()])],
                ["row", "region", "twice", "hot"],
            )

        for batch in batches:
            for row, region, wide, gaps, many in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (row, region):
                    if now is not None:
                        yield closed()
                    now, counts = (row, region), np.zeros(width, np.int32)
                at = np.cumsum(np.frombuffer(gaps, "<u4" if wide else "<u2"), dtype=np.int64)
                more = np.ones(len(at), np.int32)
                k = len(many) // 8
                more[np.frombuffer(many[: 4 * k], "<u4")] = np.frombuffer(many[4 * k :], "<u4")
                counts[at] = np.minimum(counts[at] + more, hot)  # a piece names a slot once
        if now is not None:
            yield closed()

    pieces = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "row int, region int, wide boolean, gaps binary, many binary")
    parts = pieces.repartition(partitions(docs.sparkSession), "row", "region").sortWithinPartitions("row", "region")
    maps = np.zeros((ROWS, 1 << REGION_BITS, width // 8), np.uint8)
    often: list[list[np.ndarray]] = [[np.zeros(0, np.uint32)] for _ in range(ROWS)]
    # as many rows as slot ranges, together as large as the bit maps
    for r in parts.mapInArrow(merge, "row int, region int, twice binary, hot binary").toLocalIterator():
        maps[r.row, r.region] = np.frombuffer(r.twice, np.uint8)
        often[r.row].append(np.frombuffer(r.hot, "<u4") + np.uint32(r.region * width))
    return maps.reshape(ROWS, -1), [np.sort(np.concatenate(x)).astype(np.uint32) for x in often]


def is_set(maps: np.ndarray, items: np.ndarray, bits: int) -> np.ndarray:
    """Whether every row's bit is set."""
    out = np.ones(len(items), bool)
    for row in range(ROWS):
        at = slots(items, row) >> np.uint32(32 - bits)
        out &= (maps[row][at >> np.uint32(3)] >> (np.uint8(7) - (at & np.uint32(7)).astype(np.uint8))) & np.uint8(1) == 1
    return out


def is_hot(often: list[np.ndarray], items: np.ndarray, bits: int) -> np.ndarray:
    """Whether every row lists the item's slot as hot."""
    out = np.ones(len(items), bool)
    for row in range(ROWS):
        at = slots(items, row) >> np.uint32(32 - bits)
        out &= member(often[row], at)[0]
    return out


def member(values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each x is among sorted ``values``, and where."""
    if not len(values):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(values, x), len(values) - 1)
    return values[at] == x, at


def keys(texts: Texts, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 96-bit hashes of windows, as a long and an int."""
    k1, k2 = sums(texts.low, WINDOW, 2)[texts.start[at]], sums(texts.high, WINDOW, 3)[texts.start[at]]
    return k1.view(np.int64), (k2 >> np.uint64(32)).astype(np.uint32).view(np.int32)


def hot_windows(docs: DataFrame, often: list[np.ndarray], bits: int, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows that at least ``hot`` documents hold, sorted by k1: k1, k2, the least id, and whether there is one."""
    shipped = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches):
        often = shipped.value
        for batch in batches:
            for part, texts in batched(batch, "text"):
                at = np.flatnonzero(is_hot(often, texts.items(), bits))
                if not len(at):
                    continue
                k1, k2 = keys(texts, at)
                doc = texts.doc[at]
                ids = part.column("doc_id")
                known = ids.is_valid().to_numpy(zero_copy_only=False)[doc]
                ids = pc.fill_null(ids, NO_ID).to_numpy()[doc]
                order = np.lexsort((~known, ids, doc, k2, k1))
                k1, k2, doc, ids = k1[order], k2[order], doc[order], ids[order]
                new = changes(k1, k2)
                once = changes(k1, k2, doc)
                head = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[head]), pa.array(k2[head]), pa.array(np.minimum.reduceat(ids, head)), pa.array(np.add.reduceat(once.astype(np.int64), head))],
                    ["k1", "k2", "least", "n"],
                )

    rows = docs.select(F.col("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "k1 long, k2 int, least long, n long")
    found = rows.groupBy("k1", "k2").agg(F.min("least").alias("least"), F.sum("n").alias("n")).where(F.col("n") >= hot)
    found = found.select("k1", "k2", "least").orderBy("k1").collect()  # at most all windows / hot
    k1, k2, least = (np.array([r[i] for r in found], t) for i, t in enumerate((np.int64, np.int32, np.int64)))
    return k1, k2, least, least != NO_ID


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def repeated_windows(docs: DataFrame, twice: np.ndarray, hot: tuple, bits: int) -> DataFrame:
    """(k1, at, salt, doc_id, th, more): each document's windows estimated repeated, once, with their start positions.

    ``at`` is the first position, above the 32 bits of k2: together they are
    shuffled in fewer bytes than apart.

    A hot window's least id is known already: only the rows to be removed are
    sent, spread by a salt that is not 0.  All others have salt 0.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((twice, hot))

    def run(batches):
        twice, (h1, h2, least, has) = shipped.value
        for batch in batches:
            for part, texts in batched(batch, "text"):
                at = np.flatnonzero(is_set(twice, texts.items(), bits))
                if not len(at):
                    continue
                k1, k2 = keys(texts, at)
                doc, pos = texts.doc[at], texts.pos[at]
                order = np.lexsort((pos, k2, k1, doc))
                k1, k2, doc, pos = k1[order], k2[order], doc[order], pos[order]
                head = np.flatnonzero(changes(k1, k2, doc))
                ends = np.append(head[1:], len(k1))
                more = np.full(len(head), None, object)
                for i in np.flatnonzero(ends - head > 1):
                    more[i] = pos[head[i] + 1 : ends[i]].astype("<u4").tobytes()
                # in the order of the text, in which rows compress best
                order = np.lexsort((pos[head], doc[head]))
                head, more = head[order], more[order]
                k1, k2, doc, pos = k1[head], k2[head], doc[head], pos[head]
                salt, send = np.zeros(len(k1), np.int32), np.ones(len(k1), bool)
                if len(h1):
                    known, where = member(h1, k1)
                    known &= h2[where] == k2
                    ids = part.column("doc_id")
                    valid = ids.is_valid().to_numpy(zero_copy_only=False)[doc]
                    ids = pc.fill_null(ids, 0).to_numpy()[doc]
                    send = ~known | (has[where] & (~valid | (least[where] < ids)))
                    spread = mixed(ids.astype(np.int64).view(np.uint64) * MIX + pos.astype(np.uint64))
                    salt[known] = ((spread[known] >> np.uint64(33)) | np.uint64(1)).astype(np.int32)
                take = pa.array(doc[send])
                place = (pos[send].astype(np.int64) << 32) | k2[send].view(np.uint32).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[send]), pa.array(place), pa.array(salt[send]), part.column("doc_id").take(take), part.column("th").take(take), pa.array(more[send], pa.binary())],
                    ["k1", "at", "salt", "doc_id", "th", "more"],
                )

    rows = docs.select("doc_id", F.hash("text").alias("th"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "k1 long, at long, salt int, doc_id long, th int, more binary")


def removals(windows: DataFrame) -> DataFrame:
    """The windows that a document with a smaller id also holds: (doc_id, th, pos, more).  Null ids are larger than any."""
    rows = windows.repartition("k1", "salt")  # which keeps the windows of one (k1, k2, salt) together
    rows = rows.withColumn("k2", F.col("at").bitwiseAND(0xFFFFFFFF)).withColumn("pos", F.shiftrightunsigned("at", 32).cast("int"))
    rows = rows.withColumn("first", F.min("doc_id").over(Window.partitionBy("k1", "k2", "salt")))
    later = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("first") < F.col("doc_id")))
    return rows.where((F.col("salt") != 0) | later).select("doc_id", "th", "pos", "more")


def cut_out(text: Column, at: Column, more: Column) -> Column:
    """struct<n_words, n_removed, kept> of a text and its removed windows' start positions."""

    @F.arrow_udf("struct<n_words: long, n_removed: long, kept: string>")
    def of(texts: pa.Array, at: pa.Array, more: pa.Array) -> pa.Array:
        words, removed, kept = [], [], []
        for t, a, m in zip(texts, at, more):
            w = (t.as_py() or b"").split()
            words.append(len(w))
            start = np.array(a.as_py() or [], np.int64)
            start = np.concatenate([start, *(np.frombuffer(x, "<u4").astype(np.int64) for x in m.as_py() or [])])
            if len(start):
                gone = np.zeros(len(w) + 1, np.int32)
                np.add.at(gone, start, 1)
                np.add.at(gone, start + WINDOW, -1)
                gone = np.cumsum(gone[:-1]) > 0
                removed.append(int(gone.sum()))
                w = [x for x, g in zip(w, gone.tolist()) if not g]
            else:
                removed.append(0)
            kept.append(b" ".join(w).decode())
        return pa.StructArray.from_arrays([pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["n_words", "n_removed", "kept"])

    return of(text.cast("binary"), at, more)


def sketch_size(docs: DataFrame, max_bits: int) -> tuple[int, int]:
    """Bits of a slot number (four slots for each item expected, within 16 and ``max_bits``) and the hot count."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    items = int(size) // ITEM_BYTES
    return min(max_bits, max(16, (4 * items).bit_length())), max(HOT, items // HOT_SLOTS)


def dedup(docs: DataFrame, max_bits: int = 28) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (words joined by one space).

    A word goes if a window of 13 words that covers it also starts in a document
    with a smaller doc_id.  Null text has no words; texts under 13 words stay
    whole; rows that repeat an id do not remove from each other; null ids come
    after all others and not before each other; an empty table stays empty.
    ``max_bits`` bounds the broadcast bit maps to 2 * 2 ** max_bits bits.
    """
    docs = whole_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bits, hot = sketch_size(docs, max_bits)
    twice, often = sketch(docs, bits, hot)
    found = removals(repeated_windows(docs, twice, hot_windows(docs, often, bits, hot), bits))
    per = found.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("at"), F.collect_list("more").alias("more"))
    per = per.select(F.col("doc_id").alias("r_id"), F.col("th").alias("r_th"), "at", "more")
    rows = docs.withColumn("th", F.hash("text"))
    rows = rows.join(per, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("th") == F.col("r_th")), "left")
    return rows.select("doc_id", cut_out(F.col("text"), F.col("at"), F.col("more")).alias("out")).select("doc_id", "out.*")


def digests(docs: DataFrame, max_bits: int = 28) -> DataFrame:
    return dedup(docs, max_bits).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
