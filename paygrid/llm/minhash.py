"""One-permutation MinHash with optimal densification and packed low-order bits, in DataFrame functions only.

Each word shingle is hashed once.  The top bits of the hash choose one of BINS
bins, the rest is its value there; a bin keeps its least value.  An empty bin
``i`` asks the bins in a pseudo-random order of its own (by hash of ``i`` and
the bin) and copies from the first that is occupied, the same for every text.
Of each bin BITS low-order bits are stored, packed into longs.  Two texts'
agreeing bins, corrected for agreement by chance, estimate the Jaccard
similarity of their shingle sets.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paygrid.llm.common import partitions

SHINGLE_WORDS = 5
BINS, BITS = 128, 4
BIN_SHIFT = 64 - 7  # the top 7 bits are the bin
LANES = 64 // BITS
LONGS = BINS // LANES
CHANCE = 1.0 / (1 << BITS)
SPACE = " \t\n\x0b\f\r"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column) -> Column:
    """Hashes of the runs of SHINGLE_WORDS words (fewer words: of the whole sequence; no words: none)."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    words = F.transform(F.split(trimmed, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h)
        runs = F.transform(F.sequence(F.lit(0), n - SHINGLE_WORDS), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE_WORDS)]))
        return F.when(n >= SHINGLE_WORDS, runs).otherwise(F.array(F.xxhash64(h)))

    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(let(words, shingles))


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, BIN_SHIFT).cast("int")


def packed(text: Column) -> Column:
    """The fingerprint as LONGS longs; an empty array for a text without words."""
    low = F.lit((1 << BITS) - 1).cast("long")

    def least(s: Column) -> Column:
        """The least value of each occupied bin, from the sorted hashes."""
        return F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1))))

    def bits(kept: Column) -> Column:
        own = F.map_from_arrays(F.transform(kept, _bin), F.transform(kept, lambda x: x.bitwiseAND(low)))

        def donor(i: Column) -> Column:
            # its stored bits are hashed anew for bin i, so that few values do not repeat the same bits in every bin
            place = lambda x: F.xxhash64(i, _bin(x)).bitwiseAND(F.bitwise_not(low))
            offers = F.transform(kept, lambda x: place(x).bitwiseOR(F.xxhash64(x, i).bitwiseAND(low)))
            return F.array_min(offers).bitwiseAND(low)

        return let(own, lambda m: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.coalesce(F.try_element_at(m, i), donor(i))))

    def pack(v: Column) -> Column:
        words = []
        for k in range(LONGS):
            word = F.get(v, F.lit(k * LANES))
            for j in range(1, LANES):
                word = word.bitwiseOR(F.shiftleft(F.get(v, F.lit(k * LANES + j)), BITS * j))
            words.append(word)
        return F.array(*words)

    def whole(hashes: Column) -> Column:
        kept = let(F.sort_array(hashes), least)
        return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).otherwise(let(let(kept, bits), pack))

    return let(shingle_hashes(text), whole)


def as_hex(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, in 0 to 1.

    Agreement by chance (2 ** -BITS of the bins that differ) is taken out.  Two
    texts without words are alike (1); one without and one with words are not (0).
    """
    one = F.lit(int("1" * LANES, 16) if BITS == 4 else sum(1 << (BITS * j) for j in range(LANES))).cast("long")
    differ = F.lit(0)
    for k in range(LONGS):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        any_bit = x
        for j in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, j))
        differ = differ + F.bit_count(any_bit.bitwiseAND(one))
    same = 1.0 - differ / float(BINS)
    both = F.greatest(F.lit(0.0), (same - CHANCE) / (1.0 - CHANCE))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both)


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``docs`` with the packed fingerprint of each whole text; null text counts as empty."""
    return docs.withColumn(out_col, packed(F.col(text_col)))


def with_next(rows: DataFrame, key: str, then: str, carry: list[str]) -> DataFrame:
    """``rows`` with ``next_<c>`` of the following row in the order of ``key`` (a long, not null), then ``then``; the first follows the last.

    Rows go to ranges of the key (boundaries from its quantiles, as many as
    shuffle partitions times four).  A range's first row is also sent to the
    range before it, where it stands last; so no order is global.
    """
    spark = rows.sparkSession
    count = 4 * partitions(spark)
    cuts = rows.agg(F.percentile_approx(key, [k / count for k in range(1, count)], 100 * count)).first()[0] or []
    cuts = sorted(set(cuts))
    step = max(1, ceil(len(cuts) ** 0.5))
    fine = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]).cast("array<bigint>")
    upto = lambda xs: F.size(F.filter(xs, lambda c: c <= F.col(key)))
    coarse = upto(longs([f[0] for f in fine])) - 1
    inside = upto(F.get(F.array(*[longs(f) for f in fine]), coarse)) if fine else F.lit(0)
    rows = rows.withColumn("_range", F.when(coarse < 0, 0).otherwise(coarse * step + inside) if fine else F.lit(0))
    firsts = {r["_range"]: r["k"] for r in rows.groupBy("_range").agg(F.min(key).alias("k")).collect()}  # a row per range
    order = sorted(firsts)
    before = {r: order[i - 1] for i, r in enumerate(order)}
    top = (order[-1] if order else 0) + 1
    first = F.get(longs([firsts.get(r, 0) for r in range(top)]), F.col("_range"))
    back = F.get(F.array(*[F.lit(before.get(r, 0)) for r in range(top)]), F.col("_range"))
    here = F.struct(F.lit(0).alias("guest"), F.col("_range").alias("at"))
    there = F.struct(F.lit(1).alias("guest"), back.alias("at"))
    rows = rows.withColumn("_to", F.explode(F.when(F.col(key) == first, F.array(here, there)).otherwise(F.array(here))))
    w = Window.partitionBy("_to.at").orderBy("_to.guest", key, then)
    return rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry]).where("_to.guest = 0").drop("_range", "_to")


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and their likenesses.

    The edited text is the text whose last half (rounded down, in code points)
    is replaced by as many of the next document's first code points, or all.
    The next document is the one of the next larger doc_id; null ids stand
    first, repeated ids are ordered by text, and the first follows the last.
    Null text counts as empty; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("k"))
    rows = with_next(fingerprints(rows, out_col="fp"), "k", "text", ["text", "fp"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fp", "next_fp")
    rows = fingerprints(rows, "edited", "edited_fp")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_hex(F.col("fp")).alias("fingerprint"),
        as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
