"""Personal data in disguised text, reported in source offsets.

Plain identifiers (e-mail, IP, card, phone) are found in the text as it stands;
these *base* spans always stay.  Then transducers rewrite disguises: look-alike
characters to ASCII, invisible characters to nothing, runs of spelled digits to
digits, and "at" / "dot" written out or bracketed to ``@`` and ``.``.  Each
rewritten character keeps the source span it stands for, so what the same
detectors find in the rewritten text is mapped back to the source.  A found
span that base spans of its kind already cover is not added.

Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paygrid.llm.common import fresh, whole_texts

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match never starts inside a run of digits: from there it would have failed or succeeded at the run's start already.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Look-alikes of ASCII letters that compatibility normalisation does not fold; fixed values.
CYRILLIC = dict(zip("аеорсухіѕјԁһӏкмтвнАВЕКМНОРСТУХІЅЈԌԜѡԛ", "aeopcyxisjdhlkmtbhABEKMHOPCTYXISJGWwq"))
GREEK = dict(zip("οανιρτκυχεηωΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oaviptkuxenwABEZHIKMNOPTYX"))
OTHER = {"ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l", "ꓲ": "l", "օ": "o", "ո": "n", "ս": "u", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "｡": "."}
INVISIBLE = "­​‌‍‎‏⁠﻿"
#: Spelled digits in the four languages; fixed values.
DIGITS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9", "un": "1",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
AT, DOT = "at|arroba|chez", "dot|punkt|punto|point"


def look_alikes() -> dict[int, str]:
    """Each character that stands for one ASCII character, by compatibility folding, decimal value or the tables above."""
    out = {}
    for c in map(chr, [*range(0xA0, 0xD800), *range(0xF900, 0x20000)]):
        folded = unicodedata.normalize("NFKC", c)
        if len(folded) == 1 and folded.isascii() and folded.isprintable():
            out[ord(c)] = folded
        elif unicodedata.category(c) == "Nd":
            out[ord(c)] = str(unicodedata.digit(c))
    return out | {ord(k): v for table in (CYRILLIC, GREEK, OTHER) for k, v in table.items()}


FOLD = look_alikes()
DISGUISES = frozenset([*map(chr, FOLD), *INVISIBLE])
LATIN_DISGUISE = re.compile("[" + "".join(sorted(c for c in DISGUISES if c < "\u0100")) + "]")
_D = "|".join(sorted(DIGITS, key=len, reverse=True))
SPELLED = re.compile(rf"(?:\bplus[\s-]+)?\b(?:{_D})(?:[\s,-]+(?:{_D}))*\b", re.I)
LETTERS = re.compile(r"[^\W\d_]+")
DIGIT_WORD = re.compile(rf"\b(?:plus|{_D})\b", re.I)
OPEN, CLOSE = r"[\[({<]", r"[\])}>]"
#: The blanks before a bracket are taken from their first on, so that a long run of blanks is tried once.
BRACKETS = re.compile(rf"(?:(?<!\s)\s+)?{OPEN}\s*(?:(?P<at>{AT}|@)|(?P<dot>{DOT}|\.))\s*{CLOSE}\s*", re.I)
_NAME, _LABEL = r"[A-Za-z0-9_%+-]+", r"[A-Za-z0-9-]+"
_ATS = rf"(?:\s+(?:{AT})\s+|\s*@\s*)"
#: An address in words: a name, "at", labels with at least one "dot" in words.
NAMES = re.compile(rf"{_NAME}(?:(?:\s+(?:{DOT})\s+|\.){_NAME})*", re.I)
AT_SIGN = re.compile(_ATS, re.I)
LABELS = re.compile(rf"{_LABEL}(?:(?:\s+(?:{DOT})\s+|\.){_LABEL})*\s+(?:{DOT})\s+{_LABEL}", re.I)
DOT_WORD = re.compile(rf"\s(?:{DOT})\s")
SPACED_DOT = re.compile(rf"\s+(?:{DOT})\s+", re.I)
#: "at" in words before a plain domain, where the name cannot be an ordinary word.
BEFORE_DOMAIN = re.compile(rf"(?<![A-Za-z0-9._%+-])(?=[A-Za-z]*[0-9._%+]){_NAME}(?:\.{_NAME})*\s+(?:{AT})\s+{_LABEL}(?:\.{_LABEL})*\.[A-Za-z]{{2,}}(?![A-Za-z0-9-])", re.I)
#: What BEFORE_DOMAIN ends with, in lower case; cheap to look for.
AT_DOMAIN = re.compile(rf"\s(?:{AT})\s+[a-z0-9-]+\.")
#: An address with blanks around its signs.
BLANKS = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?:\s+@\s*|\s*@\s+){_LABEL}(?:\s?\.\s?{_LABEL})*\s?\.\s?[A-Za-z]{{2,}}(?![A-Za-z0-9-])")
NUMBERS = re.compile(rf"(?<![A-Za-z0-9])[0-9]{{1,3}}(?:(?:\s+(?:{DOT})\s+|\.)[0-9]{{1,3}}){{3}}(?![A-Za-z0-9])", re.I)
SIGN = re.compile(rf"(?P<at>\s+(?:{AT})\s+|\s*@\s*)|(?P<dot>\s+(?:{DOT})\s+|\s*\.\s*)", re.I)
HINT = re.compile(rf"{OPEN}\s*(?:{AT}|@|{DOT}|\.)\s*{CLOSE}", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches, one candidate per ``@``: the longest run before it that is still free, and a domain after it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            free = m.end()
            yield start, free
        at = text.find("@", max(free, at + 1))


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of plain identifiers, in order."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    found.sort()
    return found


def rewrite(text: str, edits: list[tuple[int, int, str]], places: list | None) -> tuple[str, list]:
    """Apply edits (start, end, replacement of at most one character); places[i] is the source span of character i."""
    if places is None:
        places = [(i, i + 1) for i in range(len(text))]
    out, where, at = [], [], 0
    for start, end, new in sorted(edits):
        if start < at:
            continue  # a longer edit already covers it
        out.append(text[at:start])
        where += places[at:start]
        if new:
            out.append(new)
            where.append((places[start][0], places[end - 1][1]))
        at = end
    out.append(text[at:])
    where += places[at:]
    return "".join(out), where


def spelled(text: str) -> list[tuple[int, int, str]]:
    """Edits for runs of three or more spelled digits: each word becomes its digit, what separates them goes."""
    edits = []
    for run in SPELLED.finditer(text):
        words = list(DIGIT_WORD.finditer(text, run.start(), run.end()))
        dotted = re.compile(rf"\s+(?:{DOT})\s+", re.I).match(text, run.end()) or re.search(rf"\s(?:{DOT})\s+\Z", text[max(0, run.start() - 10) : run.start()], re.I)
        if sum(w[0].lower() != "plus" for w in words) < (1 if dotted else 3):
            continue
        for k, w in enumerate(words):
            edits.append((w.start(), w.end(), DIGITS.get(w[0].lower(), "+")))
            if k + 1 < len(words):
                edits.append((w.end(), words[k + 1].start(), ""))
    return edits


def in_words(text: str):
    """(start, end) of addresses in words.

    Names joined by dots are read once from left to right; only a whole run of
    them with an "at" behind it is looked at further, so the work is linear."""
    done = 0
    for names in NAMES.finditer(text):
        start = names.start()
        if start < done:
            continue
        if start and text[start - 1] == ".":  # its first name is not whole
            part = SPACED_DOT.search(text, start, names.end())
            if not part:
                continue
            start = part.end()
        sign = AT_SIGN.match(text, names.end())
        labels = LABELS.match(text, sign.end()) if sign else None
        if labels:
            done = labels.end()
            yield start, done


def signs(text: str) -> list[tuple[int, int, str]]:
    """Edits for written-out "at" and "dot" inside addresses and numbers."""
    edits = []
    places = [*in_words(text), *(m.span() for whole in (BEFORE_DOMAIN, BLANKS, NUMBERS) for m in whole.finditer(text))]
    for start, end in places:
        for s in SIGN.finditer(text, start, end):
            if s[0] not in ("@", "."):
                edits.append((s.start(), s.end(), "@" if s["at"] else "."))
    return edits


def disguised(text: str) -> bool:
    """Whether the text has a look-alike or an invisible character."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not DISGUISES.isdisjoint(text)
    return LATIN_DISGUISE.search(text) is not None


def counts_up(low: str) -> bool:
    """Whether three digit words follow each other among the text's words, whatever stands between them."""
    return b"\1\1\1" in bytes(map(DIGITS.__contains__, LETTERS.findall(low)))


def normalised(text: str) -> tuple[str, list] | None:
    """The rewritten text with the source span of each character; None if nothing is disguised."""
    places, plain = None, text
    if disguised(text):
        plain = text.translate(FOLD)
        gone = [(m.start(), m.end(), "") for m in re.finditer(f"[{INVISIBLE}]", plain)]
        if gone:
            plain, places = rewrite(plain, gone, places)
    low = plain.lower()
    if HINT.search(plain):
        edits = [(m.start(), m.end(), "@" if m["at"] else ".") for m in BRACKETS.finditer(plain)]
        plain, places = rewrite(plain, edits, places)
        low = plain.lower()
    dots = DOT_WORD.search(low) is not None
    if counts_up(low) or dots and SPELLED.search(plain):
        plain, places = rewrite(plain, spelled(plain), places)
    if dots or "@" in plain or AT_DOMAIN.search(low):
        edits = signs(plain)
        if edits:
            plain, places = rewrite(plain, edits, places)
    if plain is text:
        return None
    return plain, places if places is not None else [(i, i + 1) for i in range(len(plain))]


def spans(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base) of all identifiers, base spans and added ones, in order."""
    base = detect(text)
    out = [(*s, True) for s in base]
    new = normalised(text)
    if new:
        plain, places = new
        own = [[(a, b) for a, k, b in base if k == kind] for kind in range(len(KINDS))]  # in order, apart from each other
        for start, kind, end in detect(plain):
            s, e = places[start][0], places[end - 1][1]
            at = bisect_right(own[kind], s, key=lambda x: x[0]) - 1
            if at < 0 or e > own[kind][at][1]:
                out.append((s, kind, e, False))
        out.sort()
    return out


SPAN = "array<struct<kind: string, start: int, end: int, base: boolean>>"


def find(text: Column) -> Column:
    """An array column of spans (kind, start, end, base) of each whole text; null text counts as empty."""

    @F.arrow_udf(SPAN)
    def of(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        rows = []
        for t in texts:
            t = t.as_py()
            rows.append([{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in spans(t)] if t else [])
        return pa.array(rows, kind)

    return of(text)


def redact(text: Column, found: Column) -> Column:
    """The text with each run of overlapping spans replaced by ``<KIND>`` of its first; null stays null."""

    @F.arrow_udf("string")
    def of(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, spans in zip(texts, found):
            t, spans = t.as_py(), spans.as_py()
            if t is None or not spans:
                out.append(t)
                continue
            parts, at, until = [], 0, -1
            for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= until:
                    parts += [t[at : s["start"]], f"<{s['kind'].upper()}>"]
                until = max(until, s["end"])
                at = until
            out.append("".join(parts) + t[at:])
        return pa.array(out, pa.string())

    return of(text, found)


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, base spans per kind, base_sha256, spans (base and added) per row of ``docs``.

    Null and empty texts have no spans; repeats and null ids keep their rows;
    an empty table gives an empty result.  ``n_added`` counts the added spans.
    """
    rows = whole_texts(docs).select("doc_id", find(F.col("text")).alias("found"))
    base = F.filter("found", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        (F.size("found") - F.size(base)).cast("long").alias("n_added"),
    )


def without_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind, and ``n_chars``, where there is one, counted anew."""
    (name,) = fresh(docs, "pii_found")
    rows = whole_texts(docs).withColumn(name, find(F.col("text")))
    rows = rows.withColumn("text", F.when(F.size(name) > 0, redact(F.col("text"), F.col(name))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size(name) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.drop(name)
