"""Text predicates and normalisers shared by tagging, routing and chunking."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's behaviour) -------------------
# Characters Python's str.isspace() accepts; a chunk made only of these is blank.
PY_WHITESPACE_CLASS = (
    "\\t\\n\\x{0B}\\f\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
)
# Python's \w in a str pattern: Unicode letters, digits and underscore.
WORD_CLASS = "\\p{L}\\p{N}_"
# Risk rule: the substrings "6%" .. "100%" anywhere in the text.
RISK_PERCENT_PATTERN = "([6-9]|[1-9][0-9]|100)%"
# Words that alone make an answer high risk.
RISK_WORDS = ("greve", "paralisação")
# Intent labels accepted from the classifier.
INTENT_LABELS = ("CÁLCULO", "POLÍTICA", "CÁLCULO_FINANCEIRO", "BENCHMARK", "CONSULTA_ESTRATEGICA")
INTENT_STRATEGIC = "CONSULTA_ESTRATEGICA"
INTENT_POLICY = "POLÍTICA"
INTENT_ERROR = "ERRO"
# Keywords that mark a strategic question when no label is supplied.
STRATEGIC_KEYWORDS = (
    "reajuste", "como está", "como esta", "mercado", "benchmark", "praticado",
    "acordo coletivo", "act", "cct",
)
# ---------------------------------------------------------------------------

NON_BLANK_PATTERN = f"[^{PY_WHITESPACE_CLASS}]"


def py_strip(col: Column | str) -> Column:
    """Python's ``str.strip()``: drop leading and trailing Unicode whitespace
    (Spark's ``trim`` removes only blanks)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, f"^[{PY_WHITESPACE_CLASS}]+|[{PY_WHITESPACE_CLASS}]+$", "")


def has_content(col: Column | str) -> Column:
    """True when the text has a character that Python's ``strip`` would keep."""
    c = F.col(col) if isinstance(col, str) else col
    return c.rlike(NON_BLANK_PATTERN)


def contains_any(col: Column | str, words: Iterable[str]) -> Column:
    """Substring test of any word in the lower-cased text (not a word test)."""
    c = F.lower(F.col(col) if isinstance(col, str) else col)
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w.lower())
    return F.coalesce(out, F.lit(False))


def normalise_label(col: Column | str, allowed: Sequence[str] = INTENT_LABELS) -> Column:
    """``upper(trim(x))`` if it is one of ``allowed``, else null."""
    c = F.upper(py_strip(col))
    return F.when(c.isin(*allowed), c)


def risk_level(text: Column | str, kind: Column | str, words: Sequence[str] = RISK_WORDS) -> Column:
    """``high`` for a risk word or a 6–100 % substring, ``attention`` when the
    answer type contains ``erro``, else ``low``."""
    t = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    k = F.lower(F.coalesce(F.col(kind) if isinstance(kind, str) else kind, F.lit("")))
    high = t.rlike(RISK_PERCENT_PATTERN)
    for w in words:
        high = high | t.contains(w)
    return F.when(high, "high").when(k.contains("erro"), "attention").otherwise("low")


def preview(col: Column | str, n: int = 300) -> Column:
    """First ``n`` characters with newlines turned into spaces."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.substring(c, 1, n), "\n", " ")


def render_rows(cols: list[str], sep: str = " | ") -> Column:
    """One text line per row (the text-table form handed to a prompt);
    nulls render as empty strings."""
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])


def render_table(df, cols: list[str], order_col: str, group_cols: list[str] | None = None, sep: str = " | "):
    """Rows rendered as lines under a header line, in ``order_col`` order, one
    text per group (a bounded group: a plant's market rows, a query's hits)."""
    groups = list(group_cols or [])
    line = render_rows(cols, sep)
    g = df.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), line.alias("l")))).alias("ls"))
    header = sep.join(cols)
    return g.select(*groups, F.concat_ws("\n", F.lit(header), F.array_join(F.transform("ls", lambda x: x["l"]), "\n")).alias("table"))
