"""The payroll / market / retrieval model derived from the driver's tables.

The driver supplies a TPC-H-like star schema and text tables.  Each input of
the reference's model is a projection of one of them:

* employees  <- ``lineitem`` (one row per line item; plant = supplier key)
* rates      <- ``supplier`` (one rate row per plant)
* market     <- ``supplier`` + ``nation`` rendered as the market file's text
* synonyms   <- ``supplier`` + ``nation`` rendered as the synonym file's text
* doc_refs   <- ``supplier`` (which sources each plant may read)
* chunks     <- ``documents`` (file = ``source``)
* vectors    <- ``embeddings`` (file = ``'src' || label``)
* messages   <- ``conversations``

The projections are SQL expressions so that the same input is available to an
independent SQL engine; everything computed *from* these inputs is written
with the operators of this package.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import format_brl

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Column projections (SQL expressions valid in Spark SQL and DuckDB).
RATES_EXPR = [
    "s_suppkey AS planta",
    "CAST(300 + 50 * (s_suppkey % 7) AS DOUBLE) AS ajuda_combustivel_planta",
    "CAST(300 + 100 * (s_suppkey % 11) AS DOUBLE) AS plr_alvo_planta",
    "CAST(0.01 * (1 + s_suppkey % 5) AS DOUBLE) AS rat_fap",
    "CAST(0.08 + 0.02 * (s_suppkey % 8) AS DOUBLE) AS perc_he_medio",
    "CAST(0.08 AS DOUBLE) AS fgts",
    "CAST(0.1111 AS DOUBLE) AS provisao_ferias",
    "CAST(0.0833 AS DOUBLE) AS provisao_13",
    "CAST(0.2 AS DOUBLE) AS inss_patronal",
    "CAST(0.06 AS DOUBLE) AS terceiros",
]
# Same, with a null rate for the suppliers of nation 0 (null counts as 0).
RATES_NULL_EXPR = [e if not e.endswith(" AS rat_fap") else
                   "CASE WHEN s_nationkey = 0 THEN NULL ELSE CAST(0.01 * (1 + s_suppkey % 5) AS DOUBLE) END AS rat_fap"
                   for e in RATES_EXPR]
EMPLOYEES_EXPR = [
    "l_suppkey AS planta",
    "l_extendedprice AS salario_atual",
    "l_quantity AS valor_va_atual",
    "CASE WHEN l_returnflag = 'R' THEN CAST(0 AS DOUBLE) ELSE l_quantity * 10 END AS plr_alvo_atual",
]
# Same, with null salaries (no discount) and null VA (no tax).
EMPLOYEES_NULL_EXPR = [
    "l_suppkey AS planta",
    "CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice END AS salario_atual",
    "CASE WHEN l_tax = 0 THEN NULL ELSE l_quantity END AS valor_va_atual",
    "CASE WHEN l_returnflag = 'R' THEN CAST(0 AS DOUBLE) ELSE l_quantity * 10 END AS plr_alvo_atual",
]
# Staff with job titles (string plant codes) for the generator's pay rules.
STAFF_EXPR = [
    "l_orderkey AS id_funcionario",
    "'G' || CAST(l_suppkey AS VARCHAR(20)) AS planta",
    "CASE l_returnflag WHEN 'A' THEN 'Analista' WHEN 'R' THEN 'Especialista' "
    "ELSE CASE l_linestatus WHEN 'O' THEN 'Operação' ELSE 'Supervisor' END END AS subgrupo_cargos",
]
# Plant dimension with string codes and a line number (file order).
PLANT_DIM_EXPR = [
    "'G' || CAST(s_suppkey AS VARCHAR(20)) AS planta",
    "s_suppkey AS line",
    "CAST(300 + 50 * (s_suppkey % 7) AS DOUBLE) AS ajuda_combustivel_planta",
    "CAST(300 + 100 * (s_suppkey % 11) AS DOUBLE) AS plr_alvo_planta",
]
# Plant -> allowed document sources: the supplier's own source and its nation's.
DOC_REFS_SQL_PARTS = [
    "SELECT 'G' || CAST(s_suppkey AS VARCHAR(20)) AS plant, 'src' || CAST(s_suppkey % 20 AS VARCHAR(20)) AS file FROM supplier WHERE s_acctbal >= 0",
    "SELECT 'G' || CAST(s_suppkey AS VARCHAR(20)) AS plant, 'src' || CAST(s_nationkey % 20 AS VARCHAR(20)) AS file FROM supplier WHERE s_acctbal >= 0",
]
# Frequent words of the four languages; the synonym file lists one next to the
# supplier's nation so that messages can be tagged.
FREQUENT_WORDS = ("the", "and", "que", "der", "die", "for", "les")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def employees(spark: SparkSession, sf_dir: str, with_nulls: bool = False) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(*(EMPLOYEES_NULL_EXPR if with_nulls else EMPLOYEES_EXPR))


def rates(spark: SparkSession, sf_dir: str, with_nulls: bool = False) -> DataFrame:
    return read(spark, sf_dir, "supplier").selectExpr(*(RATES_NULL_EXPR if with_nulls else RATES_EXPR))


def staff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(*STAFF_EXPR)


def plant_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plant attributes with each plant listed twice (a stale copy further down
    the file): the lookup must take the first line."""
    s = read(spark, sf_dir, "supplier")
    first = s.selectExpr(*PLANT_DIM_EXPR)
    stale = first.select("planta", (F.col("line") + F.lit(1_000_000_000_000)).alias("line"),
                         (F.col("ajuda_combustivel_planta") + 1).alias("ajuda_combustivel_planta"),
                         (F.col("plr_alvo_planta") + 1).alias("plr_alvo_planta"))
    return first.unionByName(stale)


def doc_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").filter(F.col("s_acctbal") >= 0)
    plant = F.concat(F.lit("G"), F.col("s_suppkey").cast("string"))
    a = s.select(plant.alias("plant"), F.concat(F.lit("src"), (F.col("s_suppkey") % 20).cast("string")).alias("file"))
    b = s.select(plant.alias("plant"), F.concat(F.lit("src"), (F.col("s_nationkey") % 20).cast("string")).alias("file"))
    return a.unionByName(b).distinct()


def market_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market file's records as text, one per supplier with a positive
    balance, each whole record wrapped in quotes and ``;`` inside.  Every third
    key carries a trailing blank."""
    s = read(spark, sf_dir, "supplier").filter(F.col("s_acctbal") > 0)
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = s.join(n, s.s_nationkey == n.n_nationkey, "left")
    key = F.concat(F.lit("G"), F.col("s_suppkey").cast("string"),
                   F.when(F.col("s_suppkey") % 3 == 0, F.lit(" ")).otherwise(F.lit("")))
    pct = F.format_string("%.1f%%", (F.lit(50) + F.col("s_nationkey") % 10) / F.lit(10.0))
    ym = F.format_string("%04d-%02d", (F.lit(2024) + F.col("s_suppkey") % 2).cast("int"),
                         (F.lit(1) + F.col("s_suppkey") % 12).cast("int"))
    rec = F.concat_ws(";", key, F.col("s_name"), F.col("n_name"), pct,
                      format_brl(F.col("s_acctbal")), format_brl(F.col("s_acctbal") * 10), ym,
                      F.concat(F.lit("clause "), F.col("n_name")))
    return j.select(F.col("s_suppkey").alias("line"), F.concat(F.lit('"'), rec, F.lit('"')).alias("value"))


def synonym_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synonym file's rows: plant code and a comma-separated cell holding
    the supplier name, its nation (shared by many plants) and a frequent word;
    suppliers with a negative balance have an empty cell (null)."""
    s = read(spark, sf_dir, "supplier")
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = s.join(n, s.s_nationkey == n.n_nationkey, "left")
    words = F.array(*[F.lit(w) for w in FREQUENT_WORDS])
    word = F.element_at(words, (F.col("s_suppkey") % len(FREQUENT_WORDS) + 1).cast("int"))
    cell = F.concat_ws(", ", F.col("s_name"), F.col("n_name"), F.lit(""), word)
    return j.select(
        F.col("s_suppkey").alias("line"),
        F.concat(F.lit("G"), F.col("s_suppkey").cast("string")).alias("Planta"),
        F.when(F.col("s_acctbal") >= 0, cell).alias("Sinonimos"),
    )


# Labels a classifier might return (valid, padded, lower-case, unknown, none).
LABEL_CHOICES = ("  cálculo ", "POLÍTICA", "benchmark\n", "Consulta_Estrategica", "unknown", "CÁLCULO_FINANCEIRO ", None)
N_SELECTABLE = 10      # plants G0..G9 can be selected in the interface


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as questions: selected plant from the conversation, and the
    label a classifier returned for it."""
    c = read(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return c.select(
        "conv_id", "turn", "text",
        F.concat(F.lit("G"), (F.col("conv_id") % N_SELECTABLE).cast("string")).alias("selected_plant"),
        message_label().alias("label"),
    )


def message_label() -> Column:
    """The label a classifier returned for a message."""
    labels = F.array(*[F.lit(x).cast("string") for x in LABEL_CHOICES])
    return F.element_at(labels, ((F.col("conv_id") + F.col("turn")) % len(LABEL_CHOICES) + 1).cast("int"))


# Scenario parameters a model might extract from a message, by (conv_id + turn) % 5.
MESSAGE_PARAMS = (
    '{"reajuste_salarial": 5, "reajuste_va": "10", "reajuste_plr": 15}',
    '{"reajuste_plr": 15.5, "aumento_he": 10}',
    "not json",
    '{"reajuste_salarial": "5d", "reajuste_va": 3}',
    "{}",
)
# Delimited records with quoted fields, separators and doubled quotes inside them, short and long lines.
RECORD_EXPR = (
    "CAST(s_suppkey AS VARCHAR(20)) || ';\"' || s_name || '; \"\"' || CAST(s_nationkey AS VARCHAR(20)) || '\"\"\"' || "
    "CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN ';' WHEN 2 THEN ';note' ELSE ';note;too many' END AS value"
)
PARAMS_TEXT_EXPR = (
    "CASE event_type "
    "WHEN 'purchase' THEN replace(props, '\"k\"', '\"reajuste_salarial\"') "
    "WHEN 'signup' THEN '{\"reajuste_va\": \"' || replace(replace(props, '{\"k\": ', ''), '}', '') || '\", \"reajuste_plr\": 2}' "
    "WHEN 'view' THEN '[' || props || ']' "
    "WHEN 'error' THEN 'not json' "
    "ELSE '{\"aumento_he\": null, \"reajuste_va\": 3}' END AS params_text"
)


def message_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the parameter text extracted from them: ``conv_id, turn, params_text``."""
    texts = F.array(*[F.lit(x) for x in MESSAGE_PARAMS])
    at = ((F.col("conv_id") + F.col("turn")) % len(MESSAGE_PARAMS) + 1).cast("int")
    c = read(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return c.select("conv_id", "turn", F.element_at(texts, at).alias("params_text"))


def delimited_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delimited text record per supplier."""
    return read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS line", RECORD_EXPR)


def params_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON texts a model might return: valid, numbers as strings, arrays, not
    JSON, null values."""
    return read(spark, sf_dir, "events").selectExpr("event_id", PARAMS_TEXT_EXPR)


def doc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their file name (the ``source`` column)."""
    return read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file"), "text")


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as paged documents: file = conversation, page = turn."""
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("file"), F.col("turn").alias("page_no"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk vectors with the file each came from (``'src' || label``)."""
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.concat(F.lit("src"), F.col("label").cast("string")).alias("file"), "embedding", "label")
