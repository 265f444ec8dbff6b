"""Byte-level BPE by prefix-sharing trie traversal.

The distinct words (pre-tokens) of a batch form a byte trie.  A depth-first
walk gives every node the *last token* of the encoding of its prefix: the one
vocabulary token ``t`` that ends the prefix and may follow the last token of
what stands before it.  A prefix that many words share is worked out once, and
a word's encoding is read back along its last tokens.

Whether token ``b`` may follow token ``a`` is decided from the merge ranks.
While the bytes of ``a`` and ``b`` are merged, the pieces that touch at the
boundary climb from the last byte of ``a`` and the first byte of ``b`` to the
whole tokens.  The two stay apart exactly if no pair of pieces that touch can
merge before one of them is merged into its own parent.

Texts never leave their partition: no shuffle, and memory is bounded by one
Arrow batch and ``cache_words``.
"""

from __future__ import annotations

import copy
import functools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paygrid.llm.common import whole_texts, worker_cache

#: White space as the pre-tokenizer sees it (Unicode White_Space); fixed values.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Letters and numbers below U+0100; fixed values.
LATIN_LETTERS, LATIN_NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"
#: Contractions that stand alone; fixed values.
CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d"
NEVER = 1 << 30
BYTES = [bytes([b]) for b in range(256)]
#: Characters of a long text that are split into words at a time.
WINDOW_CHARS = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=1)
def newer_characters() -> str:
    """Letters and numbers that the ``regex`` module's Unicode version has and the tokenizers library's has not.

    Only code points that Python's own, older tables do not call letters or
    numbers can differ; for those the library's pre-tokenizer is asked.
    """
    import regex
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    every = "".join(map(chr, [*range(0x100, 0xD800), *range(0xE000, 0x110000)]))
    unsure = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c)[0] not in "LN"]
    return "".join(c for c in unsure if len(split(f"{c}+")) == 1)


class TrieEncoder:
    """Encoder and decoder of one byte-level BPE vocabulary."""

    def __init__(self, spec: str, newer: str = "", cache_words: int = 400_000):
        d = json.loads(spec)
        if d["model"]["type"] != "BPE" or d.get("normalizer") or d["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE file without a normalizer is needed")
        alphabet = byte_alphabet()
        vocab = d["model"]["vocab"]
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.ids = {raw(s): i for s, i in vocab.items()}
        self.added = {a["content"]: a["id"] for a in d.get("added_tokens", [])}
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in d.get("added_tokens", [])):
            raise ValueError("added tokens that strip or need word bounds are not supported")
        self.prefix_space = bool(d["pre_tokenizer"].get("add_prefix_space"))
        self.merge_rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(d["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.merge_rank[left, right] = rank
            parts.setdefault(whole, (left, right, rank))
        self._spines(parts)
        self._drop_unreachable(parts)
        self.longest = max(map(len, self.ids))
        top = max([*vocab.values(), *self.added.values()]) + 1
        self.piece: list[bytes] = [b""] * top
        for s, i in vocab.items():
            self.piece[i] = raw(s)
        for s, i in self.added.items():
            self.piece[i] = s.encode()
        self.pack = [int(i).to_bytes(4, "little") for i in range(top)]
        self.follows: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.cache_words = cache_words
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        import regex

        rest = rf"{CONTRACTIONS}| ?[{{n}}]+| ?[^{SPACE}{{l}}{{n}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
        newer = f"--[{''.join(newer)}]" if newer else ""
        letters, numbers = rf"[\p{{L}}{newer}]", rf"[\p{{N}}{newer}]"
        self.words = regex.compile(
            rf"(?V1) ?{letters}+|{CONTRACTIONS}| ?{numbers}+| ?[^[{SPACE}]{letters}{numbers}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
        ).findall
        self.latin_words = re.compile(f" ?[{LATIN_LETTERS}]+|" + rest.format(l=LATIN_LETTERS, n=LATIN_NUMBERS)).findall
        self.safe_cut = re.compile(rf"(?<=[^{SPACE}]) (?=[^{SPACE}])")

    def _spines(self, parts: dict) -> None:
        """For each token, the pieces at its right and at its left end from byte to whole, each with the rank that ends it."""
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        for token in self.ids.values():
            for side, out in ((1, self.right), (0, self.left)):
                spine, node, ends = [], token, NEVER
                while True:
                    spine.append((node, ends))
                    if node not in parts:
                        break
                    ends = parts[node][2]
                    node = parts[node][side]
                out[token] = spine[::-1]

    def _meeting(self, a: int, b: int) -> tuple[int, int] | None:
        """The first pieces that merge across the boundary of ``a`` and ``b``; None if the two stay apart."""
        ra, lb, rank = self.right[a], self.left[b], self.merge_rank
        i = j = 0
        while True:
            u, u_ends = ra[i]
            v, v_ends = lb[j]
            r = rank.get((u, v), NEVER)
            if r < u_ends and r <= v_ends and r != NEVER:
                return u, v
            if u_ends == NEVER and v_ends == NEVER:
                return None
            if u_ends <= v_ends:
                i += 1
            else:
                j += 1

    def _drop_unreachable(self, parts: dict) -> None:
        """Tokens that merging their own bytes does not give never occur in an encoding."""
        reachable = {t for t in self.ids.values() if t not in parts}
        for token, (left, right, _) in sorted(parts.items(), key=lambda x: x[1][2]):
            if left in reachable and right in reachable and self._meeting(left, right) == (left, right):
                reachable.add(token)
        self.ids = {k: v for k, v in self.ids.items() if v in reachable}

    def _learn(self, words: list[str]) -> None:
        """Encode ``words`` into the cache.

        The trie is held as its words in byte order, each with the length it
        shares with the word before: the nodes of a depth-first walk are then
        the bytes past that length, and the path's states lie on two stacks.
        ``last[d]`` is the last token of the current path's first ``d`` bytes
        and ``begin[d]`` the place where that token starts.
        """
        ids, follows, longest, pack, cache = self.ids.get, self.follows, self.longest, self.pack, self.cache
        last, begin, before = [-1], [0], b""
        for path, word in sorted([(w.encode(), w) for w in words]):
            shared, most = 0, min(len(path), len(before))
            while shared < most and path[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], begin[shared + 1 :]
            before = path
            for depth in range(shared + 1, len(path) + 1):
                # Only one token can end the path here, so the likeliest is tried first: the parent's, one byte longer.
                start = begin[-1]
                token = ids(path[start:depth])
                if token is None or start and not self._may_follow(follows, last[start], token):
                    for start in range(depth - longest if depth > longest else 0, depth):
                        token = ids(path[start:depth])
                        if token is not None and (not start or self._may_follow(follows, last[start], token)):
                            break
                last.append(token)
                begin.append(start)
            out, depth = [], len(path)
            while depth:
                out.append(pack[last[depth]])
                depth = begin[depth]
            out.reverse()
            cache[word] = b"".join(out)

    def _may_follow(self, follows: dict, a: int, b: int) -> bool:
        pair = a << 20 | b
        ok = follows.get(pair)
        if ok is None:
            if len(follows) >= 400_000:
                follows.clear()
            ok = follows[pair] = self._meeting(a, b) is None
        return ok

    def _windows(self, text: str):
        """Parts of at most about WINDOW_CHARS that end where no word can span the cut."""
        at = 0
        while len(text) - at > WINDOW_CHARS:
            m = self.safe_cut.search(text, at + WINDOW_CHARS)
            if m is None:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def _split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
            return self.latin_words(text)
        except UnicodeEncodeError:
            return self.words(text)

    def _pieces(self, text: str):
        """The runs of words and the added tokens of a text, in order."""
        for k, part in enumerate(self.split_added.split(text) if self.added else [text]):
            if k % 2:
                yield self.added[part]
            else:
                if self.prefix_space and part and not part[0].isspace():
                    part = " " + part
                for window in self._windows(part):
                    yield self._split(window)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as little-endian unsigned 32-bit integers."""
        split = [list(self._pieces(t)) for t in texts]
        words = {w for pieces in split for p in pieces if not isinstance(p, int) for w in p}
        if len(self.cache) > self.cache_words:
            self.cache.clear()
        self._learn([w for w in words if w not in self.cache])
        get = self.cache.__getitem__
        return [b"".join([self.pack[p] if isinstance(p, int) else b"".join(map(get, p)) for p in pieces]) for pieces in split]

    def decode(self, packed: bytes) -> str:
        piece = self.piece
        return b"".join([piece[i] for i in np.frombuffer(packed, "<u4").tolist()]).decode("utf-8", "replace")


def _shipped(df: DataFrame, vocab_path: str):
    """The vocabulary file, read by the driver and broadcast (a few MB), so that executors need not see the path."""
    with open(vocab_path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast((f.read(), newer_characters()))


def _encoder(shipped) -> TrieEncoder:
    cache, spec = worker_cache(), shipped.value
    key = ("bpe", hash(spec))
    if key not in cache:
        cache[key] = TrieEncoder(*spec)
    return cache[key]


def slices(batch: pa.RecordBatch, column: str, chars: int = 1_000_000):
    """Runs of rows whose texts have about ``chars`` bytes together, and at least one row each."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > chars:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def encode_documents(docs: DataFrame, vocab_path: str, text_col: str = "text", out_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with ``out_col``: the ids of each whole text, packed as little-endian unsigned 32-bit integers.

    ``decoded_col`` names a column for the text decoded from those ids again.
    Null text counts as empty and gives no ids; rows, ties and repeats stay as
    they are; an empty table stays empty.  Columns of ``docs`` that have the
    new names are replaced.
    """
    spec = _shipped(docs, vocab_path)
    docs = whole_texts(docs).drop(out_col, decoded_col or out_col)

    def run(batches):
        enc = _encoder(spec)
        for batch in batches:
            for part in slices(batch, text_col):
                ids = enc.encode([t or "" for t in part.column(text_col).to_pylist()])
                part = part.append_column(out_col, pa.array(ids, pa.binary()))
                yield part.append_column(decoded_col, pa.array(map(enc.decode, ids), pa.string())) if decoded_col else part

    schema = copy.deepcopy(docs.schema).add(out_col, "binary")
    return docs.mapInArrow(run, schema.add(decoded_col, "string") if decoded_col else schema)


def decode_ids(docs: DataFrame, vocab_path: str, ids_col: str = "ids") -> Column:
    """A column: the text of packed ids, special tokens kept; null ids give null."""
    spec = _shipped(docs, vocab_path)

    @F.arrow_udf("string")
    def decoded(ids: pa.Array) -> pa.Array:
        enc = _encoder(spec)
        return pa.array([None if x is None else enc.decode(x) for x in ids.to_pylist()], pa.string())

    return decoded(F.col(ids_col))


def unpack_ids(packed: Column) -> Column:
    """Packed ids as ``array<int>`` (for readers that want one element per token)."""

    @F.arrow_udf("array<int>")
    def unpacked(ids: pa.Array) -> pa.Array:
        return pa.array([None if x is None else np.frombuffer(x, "<i4") for x in ids.to_pylist()], pa.list_(pa.int32()))

    return unpacked(packed)


def token_digests(docs: DataFrame, vocab_path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 and decoded_sha256 (of the text decoded from the ids)."""
    coded = encode_documents(docs.select("doc_id", "text"), vocab_path, decoded_col="decoded")
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
