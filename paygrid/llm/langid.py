"""Language identification by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into windows of fixed length that cover all of it
(the last one padded with zero bytes).  Per window: byte embeddings, filters of
several widths, max pooling over positions, softmax.  A document's distribution
is the mean over its windows.

Training runs on the driver over a sample bounded by ``SAMPLE_PER_LANG`` rows a
language and one window of ``WINDOW`` characters a row.  For prediction the
embedding is folded into the filters: a filter of width w is then w small table
look-ups a byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paygrid.llm.common import first_of_each, fresh, held_out, whole_texts

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDING = 8
#: The training sample: rows a language, chosen by hash.
SAMPLE_PER_LANG = 1500
EPOCHS = 8
UNKNOWN = "und"


def windows(data: bytes) -> np.ndarray:
    """All of ``data`` as rows of WINDOW bytes, zero-padded at the end."""
    n = -(-len(data) // WINDOW)
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(samples: list[tuple[str, bytes]], seed: int = 7) -> dict | None:
    """Fit the network by Adam; None if there is nothing to learn from."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for lang, _ in samples})
    rows = [(langs.index(lang), w) for lang, data in samples for w in windows(data)[:1]]
    if not rows:
        return None
    y = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows])
    short = rng.random(len(x)) < 0.3  # some windows are cut short, as the ends of texts are
    for i in np.flatnonzero(short):
        x[i, rng.integers(4, WINDOW) :] = 0
    weight = (len(y) / (len(langs) * np.bincount(y, minlength=len(langs))))[y]
    p = {"E": rng.normal(0, 0.3, (256, EMBEDDING))}
    for w in WIDTHS:
        p[f"W{w}"] = rng.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w * EMBEDDING, FILTERS))
        p[f"b{w}"] = np.zeros(FILTERS)
    p["O"] = rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(langs)))
    p["c"] = np.zeros(len(langs))
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 32):
            pick = order[at : at + 32]
            step += 1
            for k, g in gradients(p, x[pick], y[pick], weight[pick]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                p[k] = (p[k] - 0.004 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return {"langs": langs, "p": p, "tables": fold(p)}


def gradients(p: dict, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    emb = p["E"][x]
    n = len(x)
    pooled, kept = [], []
    for w in WIDTHS:
        span = np.concatenate([emb[:, k : WINDOW - w + 1 + k] for k in range(w)], axis=2)
        z = span @ p[f"W{w}"]
        at = z.argmax(axis=1)
        top = np.take_along_axis(z, at[:, None, :], 1)[:, 0] + p[f"b{w}"]
        pooled.append(np.maximum(top, 0))
        kept.append((at, top > 0, span))
    hidden = np.concatenate(pooled, axis=1)
    d = softmax(hidden @ p["O"] + p["c"])
    d[np.arange(n), y] -= 1
    d *= (weight / n)[:, None]
    g = {"O": hidden.T @ d, "c": d.sum(0), "E": np.zeros_like(p["E"])}
    back = d @ p["O"].T
    rows = np.arange(n)[:, None]
    for i, w in enumerate(WIDTHS):
        at, on, span = kept[i]
        dz = back[:, i * FILTERS : (i + 1) * FILTERS] * on
        chosen = span[rows, at]  # n x filters x (w * embedding)
        g[f"W{w}"] = np.einsum("nfe,nf->ef", chosen, dz)
        g[f"b{w}"] = dz.sum(0)
        de = dz[:, :, None] * p[f"W{w}"].T[None]
        for k in range(w):
            np.add.at(g["E"], x[rows, at + k], de[:, :, k * EMBEDDING : (k + 1) * EMBEDDING])
    return g


def fold(p: dict) -> dict:
    """Per width and offset, the filters' answer to each byte value."""
    return {w: [np.ascontiguousarray(p["E"] @ p[f"W{w}"][k * EMBEDDING : (k + 1) * EMBEDDING]) for k in range(w)] for w in WIDTHS}


def probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    """Softmax of each window (rows of bytes)."""
    p, out = model["p"], []
    for at in range(0, len(x), 256):
        part, pooled = x[at : at + 256], []
        for w in WIDTHS:
            size, tables = WINDOW - w + 1, model["tables"][w]
            z = tables[0].take(part[:, :size], axis=0)
            for k in range(1, w):
                z += tables[k].take(part[:, k : k + size], axis=0)
            pooled.append(np.maximum(z.max(axis=1) + p[f"b{w}"], 0))
        out.append(softmax(np.concatenate(pooled, axis=1) @ p["O"] + p["c"]))
    return np.concatenate(out)


def training_sample(docs: DataFrame) -> DataFrame:
    """(lang, part): at most SAMPLE_PER_LANG rows a language from outside the held-out fold, one window of text each."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    order = F.xxhash64(F.col("doc_id").cast("string"), F.col("text"))
    start = F.pmod(order, F.greatest(F.length("text") - WINDOW, F.lit(1))).cast("int") + 1
    rows = known.select("lang", F.substring(F.col("text"), start, F.lit(WINDOW)).alias("part"), order.alias("o"))
    return first_of_each(rows, "lang", ["o", "part"], SAMPLE_PER_LANG, "k").orderBy("lang", "k").select("lang", "part")


def fit(docs: DataFrame) -> dict | None:
    return train([(r.lang, r.part.encode()) for r in training_sample(docs).collect()])


def predict(docs: DataFrame, model: dict | None, text: Column) -> Column:
    """struct<lang string, score double> of each whole text; UNKNOWN with score 0 for null, letterless or unlearnt."""
    shipped = whole_texts(docs).sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double>")
    def of(texts: pa.Array) -> pa.Array:
        model = shipped.value
        langs, scores, waiting, rows = [], [], [], 0

        def flush():
            x = np.concatenate([w for w in waiting if w is not None] or [np.zeros((0, WINDOW), np.uint8)])
            each = probabilities(model, x) if len(x) else None
            at = 0
            for w in waiting:
                if w is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    mean = each[at : at + len(w)].mean(axis=0, dtype=np.float64)
                    at += len(w)
                    langs.append(model["langs"][int(mean.argmax())])
                    scores.append(min(1.0, float(mean.max())))
            waiting.clear()

        for t in texts:
            data = t.as_py()
            waiting.append(windows(data) if model and data else None)
            rows += 0 if waiting[-1] is None else len(waiting[-1])
            if rows >= 8192:
                flush()
                rows = 0
        flush()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    has_letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return of(F.when(has_letter, text).cast("binary"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row of ``docs``.

    Learns from rows outside the held-out fold that have a language.  With no
    such row every document is UNKNOWN with score 0.  A null id is not held
    out; repeats keep their rows; an empty table gives an empty result.
    """
    found = predict(docs, fit(docs), F.col("text"))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), found.alias("found"))
    return out.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def with_language(docs: DataFrame, least_score: float = 0.4) -> DataFrame:
    """``docs`` without the rows rejected: no letters, or no language that reaches ``least_score``."""
    found = predict(docs, fit(docs), F.col("text"))
    (name,) = fresh(docs, "language_found")
    kept = docs.withColumn(name, found)
    return kept.where((F.col(f"{name}.lang") != UNKNOWN) & (F.col(f"{name}.score") >= least_score)).drop(name)
