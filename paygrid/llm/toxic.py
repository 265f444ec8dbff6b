"""Toxic spans and document scores by a linear-chain conditional random field.

Documents carry labels, tokens do not.  Tokens are labelled from a sample of
labelled documents: a word counts as toxic where it stands in toxic documents
if it is found in them far more often than in the others (by a likelihood ratio)
and in many different contexts; copies and near copies count as one document, so
that they prove nothing and hide nothing.  A
two-label chain (features: the word, its first and its last three letters) is
then trained on these tokens by forward-backward, in numpy on the driver.

Scoring runs the chain over every token of every text, in runs of RUN tokens.
Marginals give the offending spans, and a logistic model of their aggregates
(trained on the same labelled documents) gives the document's score.

The training sample is bounded: SAMPLE documents a label, chosen by hash, of at
most SAMPLE_CHARS characters each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paygrid.llm.common import first_of_each, held_out, whole_texts

TOKEN = re.compile(r"[^\W_]+")
RUN = 32
#: The training sample: documents a label, and characters a document may have to be in it.
SAMPLE, SAMPLE_CHARS = 2500, 20_000
#: A word is a seed from this likelihood ratio on and with so many different neighbourhoods.
LEAST_RATIO, LEAST_CONTEXTS = 15.0, 4
#: Texts of a label are copies if they share half of so many of their neighbourhoods, those of least hash.
SKETCH = 32
HASHED = 1 << 16
CACHE = 300_000
LIMIT = 18.0


def lowered(text: str) -> str:
    """Lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def features(word: str) -> tuple[int, int, int]:
    import xxhash

    return tuple(xxhash.xxh3_64_intdigest(x) % HASHED for x in (word, f"^{word[:3]}", f"{word[-3:]}$"))


def runs_of(values: np.ndarray, fill: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Values as rows of RUN, and which cells hold one."""
    n = max(1, -(-len(values) // RUN))
    out = np.full(n * RUN, fill)
    out[: len(values)] = values
    return out.reshape(n, RUN), (np.arange(n * RUN) < len(values)).reshape(n, RUN)


def marginals(scores: np.ndarray, held: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Forward-backward over rows of token scores (label 1 against 0).

    Returns each token's probability of label 1, expected transitions (summed,
    2 x 2) and starts.  Cells not held come last in a row and add nothing.
    """
    n, length = scores.shape
    weight = np.exp(np.clip(scores, -LIMIT, LIMIT))
    t, s = np.exp(trans), np.exp(start)
    ahead = np.empty((length, 2, n))
    ahead[0, 0], ahead[0, 1] = s[0], s[1] * weight[:, 0]
    ahead[0] /= ahead[0].sum(axis=0)
    for k in range(1, length):
        a0, a1 = ahead[k - 1]
        ahead[k, 0] = a0 * t[0, 0] + a1 * t[1, 0]
        ahead[k, 1] = (a0 * t[0, 1] + a1 * t[1, 1]) * weight[:, k]
        ahead[k] /= ahead[k].sum(axis=0)
    back = np.ones((2, n))
    prob = np.empty((n, length))
    pairs = np.zeros((2, 2))
    for k in range(length - 1, -1, -1):
        both = ahead[k] * back
        prob[:, k] = both[1] / both.sum(axis=0)
        if k == 0:
            break
        after = np.stack([back[0], back[1] * weight[:, k]])
        use = held[:, k]
        each = ahead[k - 1][:, None, :] * t[:, :, None] * after[None]
        total = each.sum(axis=(0, 1))
        pairs += (each / total)[:, :, use].sum(axis=2)
        step = np.stack([t[0, 0] * after[0] + t[0, 1] * after[1], t[1, 0] * after[0] + t[1, 1] * after[1]])
        step /= step.sum(axis=0)
        back = np.where(use, step, 1.0)
    first = held[:, 0]
    return np.where(held, prob, 0.0), pairs, np.array([(1 - prob[first, 0]).sum(), prob[first, 0].sum()])


def neighbourhoods(words: list[str]):
    return zip(["", *words], words, [*words[1:], ""])


def without_copies(docs: list[tuple[int, list[str]]]) -> list[tuple[int, set[str]]]:
    """(label, words) of each group of copies and near copies: a group has every word of its texts."""
    import xxhash

    out, firsts = [], []
    equal: dict[tuple, int] = {}
    holders: dict[tuple, list[int]] = {}
    for label, words in docs:
        text = (label, xxhash.xxh3_128_intdigest(" ".join(words)))
        group = equal.get(text)
        if group is None:
            sketch = nsmallest(SKETCH, {xxhash.xxh3_64_intdigest(" ".join(x)) for x in neighbourhoods(words)})
            shared = Counter(g for x in sketch for g in holders.get((label, x), ()))
            group, n = max(shared.items(), key=lambda x: (x[1], -x[0]), default=(0, 0))
            if n == 0 or 2 * n < max(len(sketch), firsts[group]):
                group = len(out)
                out.append((label, set()))
                firsts.append(len(sketch))
                for x in sketch:
                    holders.setdefault((label, x), []).append(group)
            equal[text] = group
        out[group][1].update(words)
    return out


def seeds(docs: list[tuple[int, list[str]]]) -> set[str]:
    """Words that mark toxic documents."""
    count = [{}, {}]
    contexts: dict[str, set] = {}
    total = [0, 0]
    for label, words in without_copies(docs):
        total[label] += 1
        for w in words:
            count[label][w] = count[label].get(w, 0) + 1
    for label, words in docs:
        if label:
            for before, w, after in neighbourhoods(words):
                contexts.setdefault(w, set()).add((before, after))
    found = set()
    for w, a in count[1].items():
        b = count[0].get(w, 0)
        p, q = a / total[1], b / max(1, total[0])
        if p <= 4 * q or len(contexts[w]) < LEAST_CONTEXTS:
            continue
        both = (a + b) / sum(total)
        ratio = 2 * (_log(a, p) + _log(b, q) - _log(a + b, both) + _log(total[1] - a, 1 - p) + _log(total[0] - b, 1 - q) - _log(sum(total) - a - b, 1 - both))
        if ratio >= LEAST_RATIO:
            found.add(w)
    return found


def _log(n: float, p: float) -> float:
    return n * math.log(p) if n > 0 and p > 0 else 0.0


def train(rows: list[tuple[int, str]], epochs: int = 12, seed: int = 3) -> dict:
    """Fit the chain and the document model; with one label only, a constant score."""
    labels = [label for label, _ in rows]
    if len(set(labels)) < 2:
        return {"constant": float(labels[0]) if labels else 0.0}
    docs = [(label, TOKEN.findall(lowered(text))) for label, text in rows]
    marked = seeds(docs)
    x, y, held = [], [], []
    rng = np.random.default_rng(seed)
    for label, words in docs:
        if not words:
            continue
        f = np.array([features(w) for w in words])
        gold = np.array([float(bool(label) and w in marked) for w in words])
        g, h = runs_of(gold)
        keep = (g.sum(axis=1) > 0) | (rng.random(len(g)) < 0.35)
        cells = np.zeros((len(g) * RUN, 3), np.int64)
        cells[: len(f)] = f
        x.append(cells.reshape(len(g), RUN, 3)[keep])
        y.append(g[keep])
        held.append(h[keep])
    x, y, held = np.concatenate(x), np.concatenate(y), np.concatenate(held)
    w, trans, start = np.zeros(HASHED), np.zeros((2, 2)), np.zeros(2)
    sums = [np.full(HASHED, 1e-8), np.full((2, 2), 1e-8), np.full(2, 1e-8)]
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 512):
            pick = order[at : at + 512]
            xs, ys, hs = x[pick], y[pick], held[pick]
            p, pairs, first = marginals(w[xs].sum(axis=2), hs, trans, start)
            diff = np.where(hs, ys - p, 0.0)
            gw = np.bincount(xs.ravel(), np.repeat(diff.ravel(), 3), HASHED)
            labels_now = ys.astype(int)
            seen = np.zeros((2, 2))
            np.add.at(seen, (labels_now[:, :-1][hs[:, 1:]], labels_now[:, 1:][hs[:, 1:]]), 1)
            begun = np.array([(1 - ys[hs[:, 0], 0]).sum(), ys[hs[:, 0], 0].sum()])
            for value, grad, total in ((w, gw - 1e-3 * w, sums[0]), (trans, seen - pairs - 1e-3 * trans, sums[1]), (start, begun - first - 1e-3 * start, sums[2])):
                total += grad * grad  # Adagrad: a weight's step shrinks as its gradients add up
                value += 0.3 * grad / np.sqrt(total)
    model = {"w": w, "trans": trans, "start": start}
    table = np.array([aggregates(model, words)[0] for _, words in docs])
    model["doc"] = logistic(table, np.array(labels, float))
    return model


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton steps with a little ridge; labels weigh alike only through the sample."""
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / sd]
    b = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -LIMIT, LIMIT)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.eye(len(b))
        b += np.linalg.solve(h, z.T @ (y - p) - b)
    return b, mean, sd


def aggregates(model: dict, words: list[str], cache: dict | None = None) -> tuple[list[float], np.ndarray]:
    """What the document model sees (log-odds that any token is toxic, expected toxic tokens) and the tokens' marginals."""
    e = np.array([_score(model, w, cache) for w in words])
    grid, held = runs_of(e)
    p = marginals(grid, held, model["trans"], model["start"])[0].ravel()[: len(words)]
    return summary(p), p


def summary(p: np.ndarray) -> list[float]:
    none = float(np.log1p(-np.minimum(p, 1 - 1e-9)).sum())  # log chance that no token is toxic
    some = math.log(max(1e-9, -math.expm1(none)))
    return [some - max(none, -LIMIT), min(float(p.sum()), 50.0)]


def _score(model: dict, word: str, cache: dict | None) -> float:
    s = cache.get(word) if cache is not None else None
    if s is None:
        s = float(model["w"][list(features(word))].sum())
        if cache is not None:
            if len(cache) > CACHE:
                cache.clear()
            cache[word] = s
    return s


def document_score(model: dict, found: list[float]) -> float:
    b, mean, sd = model["doc"]
    z = b[0] + float(((np.array(found) - mean) / sd) @ b[1:])
    return 1 / (1 + math.exp(-max(-LIMIT, min(LIMIT, z))))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, text): at most SAMPLE documents a label from outside the held-out fold."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # twice the sample by ids alone, so that few texts meet the join; some are too long or missing
    ids = first_of_each(known.withColumn("o", F.xxhash64(F.col("doc_id"), F.lit(1))), "toxic", ["o", "doc_id"], 2 * SAMPLE, "k")
    rows = docs.where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).select("doc_id", "text")
    rows = rows.join(F.broadcast(ids.select("doc_id", "toxic", "k")), "doc_id")  # 4 * SAMPLE ids at most
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy("k", "text"))
    return rows.withColumn("r", rank).where(F.col("r") <= SAMPLE).orderBy("toxic", "r").select("toxic", "text")


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    return train([(int(r.toxic), r.text) for r in labelled_sample(docs, labels).collect()])


TAGGED = "struct<score: double, spans: array<struct<start: int, end: int, p: double>>>"


def tag(docs: DataFrame, model: dict, text: Column) -> Column:
    """struct<score, spans> of each whole text; spans are runs of tokens whose marginal is 0.5 or more, in code points."""
    shipped = whole_texts(docs).sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(TAGGED)
    def of(texts: pa.Array) -> pa.Array:
        model, cache = shipped.value, {}
        kind = pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))])
        out, waiting, size = [], [], 0

        def flush():
            grids = [runs_of(e) for _, e in waiting]
            all_p = marginals(np.concatenate([g for g, _ in grids]), np.concatenate([h for _, h in grids]), model["trans"], model["start"])[0]
            at = 0
            for (t, e), (g, _) in zip(waiting, grids):
                p = all_p[at : at + len(g)].ravel()[: len(e)]
                at += len(g)
                out.append({"score": document_score(model, summary(p)), "spans": spans(t, p)})
            waiting.clear()

        for t in texts:
            t = t.as_py() or ""
            if "constant" in model:
                out.append({"score": model["constant"], "spans": []})
                continue
            words = TOKEN.findall(lowered(t))
            get = cache.get
            e = [get(w) for w in words]
            if None in e:
                e = [x if x is not None else _score(model, w, cache) for x, w in zip(e, words)]
            waiting.append((t, np.array(e, np.float64)))
            size += len(words)
            if size >= 100_000:
                flush()
                size = 0
        if waiting:
            flush()
        return pa.array(out, kind)

    return of(text)


def spans(text: str, p: np.ndarray) -> list[dict]:
    hot = p >= 0.5
    if not hot.any():
        return []
    out, before = [], -2
    for k, m in enumerate(TOKEN.finditer(lowered(text))):
        if hot[k]:
            if k == before + 1:
                out[-1]["end"], out[-1]["p"] = m.end(), max(out[-1]["p"], float(p[k]))
            else:
                out.append({"start": m.start(), "end": m.end(), "p": float(p[k])})
            before = k
    return out


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans per row of ``docs``.

    Learns from labels outside the held-out fold only (an id labelled more than
    once counts as toxic if any label says so).  Null and empty texts get the
    score of a text without evidence; with labels of one kind, or none, every
    score is that label (0 for none); null ids are not held out and repeats keep
    their rows; an empty table gives an empty result.
    """
    tagged = tag(docs, fit(docs, labels), F.col("text"))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), tagged.alias("t"))
    found = F.col("t.score")
    return out.select("doc_id", "held_out", found.alias("score"), (found >= 0.5).cast("int").alias("predicted"), F.col("t.spans").alias("spans"))
