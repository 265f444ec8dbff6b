"""Long texts in the personal-data detector; one document of each group where ids repeat."""

import random
import re
import time

import pytest

from paygrid.llm import pii, simhash
from tests.llm import helpers as h

LONG = 300_000
ADVERSE = [
    "a dot ", "a at ", "one two ", " ", "( ", "a @ ", "1 dot ", "a.b.", "+1 ", "@", "a dot b at c dot ", "[at] ", "(at)          ", "a\tdot\t",
    "a at b.", "at ", "dot ", "1.2.3.", "1 2 ", "a@b.", "plus one ", "x1 at a.", "a @ b . ", "a%+-", "\n", "jane at example dot com ", "(", "＠ａ",
]


@pytest.mark.parametrize("piece", ADVERSE)
def test_detector_is_linear(piece):
    text = piece * (LONG // len(piece))
    for t in ("x (at) y " + text, text + " dot jane at example dot com"):
        at = time.perf_counter()
        pii.spans(t)
        assert time.perf_counter() - at < 10, piece


@pytest.mark.parametrize("text,found", [
    ("write to jane dot doe at example dot com now", "jane dot doe at example dot com"), ("jane at example\tdot\tcom", "jane at example\tdot\tcom"),
    ("192\tdot\t168\tdot\t0\tdot\t1", "192\tdot\t168\tdot\t0\tdot\t1"), ("a dot b dot c", None), (".a dot b at c dot d", "b at c dot d"),
    ("jane\nat\nexample\ndot\norg", "jane\nat\nexample\ndot\norg"), ("a at b dot c at d dot e", "a at b dot c"), ("jane at example.org", None),
])
def test_spelled_signs(text, found):
    got = [text[s:e] for s, _, e, base in pii.spans(text) if not base]
    assert got[:1] == ([found] if found else [])


def test_words_as_one_expression_finds_them():
    """The one-pass reader against the whole pattern as one regular expression, on short random texts."""
    name, label = r"[A-Za-z0-9_%+-]+", r"[A-Za-z0-9-]+"
    dot = rf"(?:\s+(?:{pii.DOT})\s+|\.)"
    whole = re.compile(rf"(?<![A-Za-z0-9._%+-]){name}(?:{dot}{name})*(?:\s+(?:{pii.AT})\s+|\s*@\s*){label}(?:{dot}{label})*\s+(?:{pii.DOT})\s+{label}", re.I)
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(x for _ in range(rng.randint(2, 8)) for x in (rng.choice(["a", "b1", "x-y"]), rng.choice([" ", " at ", " dot ", "  Dot\n", ".", "@", " @ ", ", ", "; "])))
        assert list(pii.in_words(text)) == [m.span() for m in whole.finditer(text)], text


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def one_of_each(rows):
    """The kept (doc_id, text) by brute force over fingerprints."""
    prints = [simhash_of(t) for _, t in rows]
    roots = {}
    distinct = sorted(set(prints))
    group = {f: f for f in distinct}
    changed = True
    while changed:
        changed = False
        for a in distinct:
            for b in distinct:
                if (a ^ b).bit_count() <= 4 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    for (d, t), f in zip(rows, prints):
        best = roots.get(group[f])
        order = (d is None, d or 0, (t or "").encode())
        if best is None or order < best[0]:
            roots[group[f]] = (order, (d, t))
    return sorted((x for _, x in roots.values()), key=str)


def simhash_of(text):
    return h.simhash(text)


def test_an_id_on_two_groups_keeps_both(spark):
    rng = random.Random(2)
    a, b, c = (" ".join(rng.choices(WORDS, k=60)) for _ in range(3))
    rows = [(1, a), (1, b), (2, b), (3, a), (None, c), (None, a), (4, c), (None, None), (None, "only here and without an id at all")]
    got = sorted(((r.doc_id, r.text) for r in simhash.one_of_each(h.docs(spark, [(d, t, "en", "s") for d, t in rows])).collect()), key=str)
    assert got == one_of_each(rows) and {(1, a), (1, b)} <= set(got)


def test_one_of_each_of_random_ids(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choices(WORDS, k=50)) for _ in range(12)]
    rows = [(rng.choice([None, *range(15)]), rng.choice(pool)) for _ in range(80)]
    got = sorted(((r.doc_id, r.text) for r in simhash.one_of_each(h.docs(spark, [(d, t, "en", "s") for d, t in rows])).collect()), key=str)
    assert got == one_of_each(rows)
