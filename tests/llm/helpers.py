"""Small tables with every awkward case, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import re
import zlib
from itertools import pairwise

import duckdb

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, taken string, fingerprint string, found string"


def words(text):
    return WORD.findall(text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def docs(spark, rows):
    """A documents table from (doc_id, text, lang, source), with extra columns whose names clash with operators' own."""
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, 7, "t", "f", "x") for r in rows], SCHEMA)


LINE = "the quick brown fox jumps over the lazy dog while seven small birds sing along the river bank"
AWKWARD = [
    (1, LINE, "en", "a"),
    (2, LINE, "en", "a"),
    (3, LINE + " today", "en", None),
    (3, LINE + " today", "en", None),  # a repeated row
    (4, None, None, "b"),
    (5, "", "en", "b"),
    (6, " \t\n ", "fr", "b"),
    (7, "é", "fr", "ü"),
    (None, LINE, "en", "a"),
    (None, "no id here", None, None),
    (8, "12 34 !! %%", "de", "b"),
    (9, ("long " * 30_000) + LINE, "en", "a"),
    (10, "x" * 50_000, None, "b"),
    (11, "<|endoftext|>  tail　\u0085 \U0001f600 ٣", "es", "a"),
    (12, LINE.upper(), "en", "b"),
]


def table(name, sf="0.001"):
    return duckdb.sql(f"SELECT * FROM '/root/testdata/sf{sf}/{name}.parquet'").fetchall()


def documents(sf="0.001"):
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '/root/testdata/sf{sf}/documents.parquet'").fetchall()


def simhash(text):
    import xxhash

    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, ids, bits=4):
    """The smallest id reachable over fingerprints within ``bits``, by trying all pairs."""
    distinct = sorted(set(prints))
    parent = {f: f for f in distinct}

    def root(f):
        while parent[f] != f:
            parent[f] = parent[parent[f]]
            f = parent[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                parent[root(a)] = root(b)
    least = {}
    for f, d in zip(prints, ids):
        r = root(f)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [least.get(root(f)) for f in prints]


def substring(rows, window=13):
    """(doc_id, n_words, n_removed, kept) by the definition."""
    first = {}
    split = [(d, words(t)) for d, t in rows]
    for d, w in split:
        if d is None:
            continue
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            least = first.get(tuple(w[i : i + window]))
            if least is not None and (d is None or least < d):
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def edited(rows):
    """(doc_id, text, edited, next text) in ascending doc_id (null first), then text."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for (d, t), (_, after) in pairwise([*rows, rows[0]] if rows else []):
        half = len(t) // 2
        out.append((d, t, t[: len(t) - half] + after[:half], after))
    return out


def jaccard(a, b, k=5):
    def shingles(t):
        w = words(t)
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())

    x, y = shingles(a), shingles(b)
    return 1.0 if not x and not y else len(x & y) / len(x | y)


def base_spans(text):
    """The four base patterns, by regular expressions."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)
