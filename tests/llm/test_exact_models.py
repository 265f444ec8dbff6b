"""MinHash fingerprints and the language network against direct versions that share no code with them."""

from __future__ import annotations

import struct
from collections import Counter

import numpy as np
import pytest
import xxhash

from paygrid.llm import langid, minhash
from tests.llm import helpers as h


@pytest.fixture(scope="module")
def awkward(spark):
    return h.docs(spark, h.AWKWARD)


# MinHash: bins, densification, packing, chance correction ---------------------


def hashed(*values, seed=42):
    """Of strings, ("i", int) and ("l", long) in turn, each seeded by the one before; signed."""
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<" + ("i" if v[0] == "i" else "q"), v[1])
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def direct_bins(text):
    """The stored bits of each of the 128 bins; None for a text without words."""
    words = [("l", hashed(w)) for w in h.words(text)]
    if not words:
        return None
    values = {hashed(*words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    least = {}
    for x in values:
        at = (x & (1 << 64) - 1) >> 57
        least[at] = min(x, least.get(at, x))
    out = []
    for i in range(128):
        if i in least:
            out.append(least[i] & 15)
            continue
        asked = min((hashed(("i", i), ("i", b)) >> 4, hashed(("l", x), ("i", i)) & 15) for b, x in least.items())
        out.append(asked[1])
    return out


def direct_hex(bins):
    return "" if bins is None else "".join(f"{sum(v << 4 * j for j, v in enumerate(bins[k : k + 16])):016x}" for k in range(0, 128, 16))


def direct_likeness(a, b):
    if a is None or b is None:
        return float(a is b)
    same = sum(x == y for x, y in zip(a, b)) / 128
    return round(max(0.0, (same - 1 / 16) / (15 / 16)), 9)


def test_minhash_equals_direct_bins(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    want = Counter()
    for doc_id, text, edited, after in h.edited(rows):
        own, other, following = direct_bins(text), direct_bins(edited), direct_bins(after)
        want[doc_id, h.sha(edited), direct_hex(own), direct_hex(other), direct_likeness(own, other), direct_likeness(own, following)] += 1
    got = minhash.compared(awkward).collect()
    found = Counter((r.doc_id, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got)
    assert found == want


@pytest.mark.parametrize("n", [1, 4, 5, 6, 40, 2000])
def test_minhash_of_few_and_many_shingles(spark, n):
    text = " ".join(f"w{i * i % 977}" for i in range(n))
    assert minhash.fingerprints(spark.createDataFrame([(text,)], "text string")).select(minhash.as_hex(minhash.F.col("fingerprint"))).first()[0] == direct_hex(direct_bins(text))


# Language network: forward pass and gradients ----------------------------------


def direct_probabilities(p, window):
    """One window's distribution: every filter moved over the bytes, one position at a time, in doubles."""
    p = {k: v.astype(np.float64) for k, v in p.items()}
    hidden = []
    for w in (2, 3, 4):
        for f in range(p[f"b{w}"].size):
            answers = []
            for at in range(len(window) - w + 1):
                span = np.concatenate([p["E"][b] for b in window[at : at + w]])
                answers.append(float(span @ p[f"W{w}"][:, f]) + p[f"b{w}"][f])
            hidden.append(max(0.0, max(answers)))
    z = np.array(hidden) @ p["O"] + p["c"]
    e = np.exp(z - z.max())
    return e / e.sum()


@pytest.fixture(scope="module")
def network():
    texts = {"de": "der Hund und die Katze schlafen nicht im Haus ", "en": "the dog and the cat do not sleep in the house ", "fr": "le chien et le chat ne dorment pas à la maison "}
    return langid.train([(lang, (t * 3)[k : k + 120].encode()) for lang, t in texts.items() for k in range(0, 40, 4)])


def test_language_scores_equal_direct_forward_pass(spark, network):
    texts = ["the house", "é", "chien " * 60, "x" * 256, "Katze" * 52, "a\0b", "  \n z"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", None, "12 !"])], "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r.out for r in docs.select("doc_id", langid.predict(docs, network, docs.text).alias("out")).collect()}
    for i, t in enumerate(texts):
        data = t.encode() + bytes(-len(t.encode()) % 256)
        mean = np.mean([direct_probabilities(network["p"], data[k : k + 256]) for k in range(0, len(data), 256)], axis=0)
        assert found[i].lang == network["langs"][int(mean.argmax())]
        assert found[i].score == pytest.approx(mean.max(), abs=1e-4)
    assert [tuple(found[i]) for i in range(len(texts), len(texts) + 3)] == [("und", 0.0)] * 3


def test_language_gradients_equal_difference_quotients():
    rng = np.random.default_rng(5)
    p = {"E": rng.normal(0, 0.5, (256, langid.EMBEDDING)), "O": rng.normal(0, 0.5, (3 * langid.FILTERS, 4)), "c": rng.normal(0, 0.1, 4)}
    for w in langid.WIDTHS:
        p[f"W{w}"] = rng.normal(0, 0.4, (w * langid.EMBEDDING, langid.FILTERS))
        p[f"b{w}"] = rng.normal(0, 0.1, langid.FILTERS)
    x = rng.integers(97, 110, (3, 256)).astype(np.uint8)
    y, weight = np.array([0, 3, 1]), np.array([1.0, 0.5, 2.0])

    def loss():
        return sum(-w * np.log(direct_probabilities(p, row)[k]) for row, k, w in zip(x, y, weight)) / 3

    g = langid.gradients(p, x, y, weight)
    assert g.keys() == p.keys()
    for name, value in p.items():
        places = np.flatnonzero(np.abs(g[name]).ravel() > 1e-3)  # most bytes and windows' places have none
        for at in rng.choice(places, min(2, len(places)), replace=False):
            flat, was = value.reshape(-1), value.reshape(-1)[at]
            flat[at] = was + 1e-5
            above = loss()
            flat[at] = was - 1e-5
            below = loss()
            flat[at] = was
            assert g[name].reshape(-1)[at] == pytest.approx((above - below) / 2e-5, rel=1e-3, abs=1e-6)
    assert not g["E"][:97].any() and not g["E"][110:].any()
