"""Text rules on the fixture edge cases."""

import pytest
from pyspark.sql import functions as F

from paygrid.functions import numbers as nu
from paygrid.functions import text as tx
from paygrid.operators import tagging as tg


@pytest.fixture(scope="module")
def smap(spark):
    rows = [(1, "G1", "Curitiba, São José dos Pinhais, SJP"), (2, "G2", "Gravataí, GM, General Motors"),
            (3, "G5", "ABC Paulista, Toyota, , gr"), (4, "G6", "Sorocaba, Toyota"), (5, "G7", None)]
    lines = spark.createDataFrame(rows, "line long, Planta string, Sinonimos string")
    return tg.synonym_map(tg.explode_synonyms(lines))


def test_synonym_map_first_position_last_value(smap):
    m = {r.synonym: r for r in smap.collect()}
    assert m["toyota"].plant == "G6" and (m["toyota"].pos_line, m["toyota"].pos_idx) == (3, 1)
    assert "" not in m and "nan" not in m and len(m) == 10


def test_tagging_whole_word_first_entry(spark, smap):
    msgs = spark.createDataFrame([
        (1, "Como está a planta de São José dos Pinhais?"),
        (2, "Os gráficos da GM"),                 # 'gr' must not match inside 'gráficos'
        (3, "toyota e General Motors"),           # first dictionary entry wins: gm (line 2) < toyota (line 3)
        (4, "general  motors"),                   # two blanks: no match
        (5, "nothing here"),
    ], "id long, text string")
    got = {r.id: r.tagged_plant for r in tg.tag_messages(msgs, smap, ["id"]).collect()}
    assert got == {1: "G1", 2: "G2", 3: "G2", 4: None, 5: None}


@pytest.mark.parametrize("text,level", [
    ("5%", "low"), ("6%", "high"), ("5.7%", "high"), ("0.6%", "high"), ("105%", "low"),
    ("100%", "high"), ("200%", "low"), ("GREVE", "high"), ("paralisação", "high"), ("ok", "low")])
def test_risk_levels(spark, text, level):
    df = spark.createDataFrame([(text, "POLÍTICA")], "t string, k string")
    assert df.select(tx.risk_level("t", "k")).first()[0] == level


def test_risk_attention_on_error_type(spark):
    df = spark.createDataFrame([("fine", "ERRO")], "t string, k string")
    assert df.select(tx.risk_level("t", "k")).first()[0] == "attention"


@pytest.mark.parametrize("text,want", [
    ('{"reajuste_salarial": 5, "reajuste_va": 10, "reajuste_plr": 15, "aumento_he": 0}', (5.0, 10.0, 15.0, 0.0)),
    ('{"reajuste_salarial": 5}', (5.0, 0.0, 0.0, 0.0)),
    ('{"reajuste_va": "5"}', (0.0, 5.0, 0.0, 0.0)),
    ('{"reajuste_va": null, "reajuste_salarial": 3}', (0.0, 0.0, 0.0, 0.0)),
    ('{"reajuste_va": "abc", "reajuste_salarial": 3}', (0.0, 0.0, 0.0, 0.0)),
    ("not json", (0.0, 0.0, 0.0, 0.0)),
    ('[{"reajuste_va": 3}]', (0.0, 0.0, 0.0, 0.0)),
    (None, (0.0, 0.0, 0.0, 0.0)),
])
def test_json_params_all_or_nothing(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert tuple(df.select(nu.json_params("t").alias("v")).select("v.*").first()) == want


def test_label_normalisation(spark):
    df = spark.createDataFrame([("  cálculo ",), ("benchmark\n",), ("x",), (None,)], "l string")
    assert [r[0] for r in df.select(tx.normalise_label("l")).collect()] == ["CÁLCULO", "BENCHMARK", None, None]


def test_keywords_are_substrings(spark):
    df = spark.createDataFrame([("Qual o impacto?",), ("nada",)], "t string")
    assert [r[0] for r in df.select(tg.keyword_flag(F.col("t"))).collect()] == [True, False]


def test_money_and_percent_formats(spark):
    df = spark.createDataFrame([(1234.5, 6.2645, "R$ 1.200,00", "5.5%", "2025-01", "R$ x")],
                               "m double, p double, b string, pc string, ym string, bad string")
    r = df.select(nu.format_money("m"), nu.format_pct("p"), nu.parse_brl("b"), nu.parse_percent("pc"),
                  nu.parse_year_month("ym").cast("string"), nu.parse_brl("bad")).first()
    assert tuple(r) == ("R$ 1,234.50", "6.26%", 1200.0, 5.5, "2025-01-01", None)


def test_tagging_irregular_synonym_fallback(spark):
    """A synonym that starts and ends with punctuation cannot be an n-gram;
    Python's ``\\b`` then needs a word character *outside* the brackets."""
    import re
    lines = spark.createDataFrame([(1, "G3", "(gm)"), (2, "G4", "fiat")], "line long, Planta string, Sinonimos string")
    smap = tg.synonym_map(tg.explode_synonyms(lines))
    texts = ["carro(gm)novo", "o (gm) novo", "fiat (gm)", "nada"]
    msgs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.tagged_plant for r in tg.tag_messages(msgs, smap, ["id"]).collect()}
    want = {}
    for i, t in enumerate(texts):
        hit = None
        for syn, plant in (("(gm)", "G3"), ("fiat", "G4")):
            if re.search(rf"\b{re.escape(syn)}\b", t.lower()):
                hit = plant
                break
        want[i] = hit
    assert got == want
