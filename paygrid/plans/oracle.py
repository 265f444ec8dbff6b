"""Independent SQL for every registered query, runnable by DuckDB on the
driver's parquet views (same column names as the Spark results).

Payroll: the cascade is applied to every employee row and summed, in exact
decimals, and rounded once; the Spark side aggregates first, so the two share
no algebra."""

from __future__ import annotations

from ..functions.text import STRATEGIC_KEYWORDS
from . import testmap as tm

ORACLE: dict[str, str] = {}


def _ctes() -> str:
    return (
        f"h AS (SELECT {', '.join(tm.EMPLOYEES_EXPR)} FROM lineitem),\n"
        f"hn AS (SELECT {', '.join(tm.EMPLOYEES_NULL_EXPR)} FROM lineitem),\n"
        f"p AS (SELECT {', '.join(tm.RATES_EXPR)} FROM supplier),\n"
        f"pn AS (SELECT {', '.join(tm.RATES_NULL_EXPR)} FROM supplier)"
    )


SCEN_TEST = "SELECT 'test' AS scenario_id, CAST(5 AS DOUBLE) AS pct_salary, CAST(10 AS DOUBLE) AS pct_va, CAST(15 AS DOUBLE) AS pct_plr, CAST(0 AS DOUBLE) AS pct_overtime"
SCEN_FIXTURE = " UNION ALL ".join([
    "SELECT 'base' AS scenario_id, CAST(0 AS DOUBLE) AS pct_salary, CAST(0 AS DOUBLE) AS pct_va, CAST(0 AS DOUBLE) AS pct_plr, CAST(0 AS DOUBLE) AS pct_overtime",
    SCEN_TEST,
    "SELECT 'he', CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(10 AS DOUBLE)",
    "SELECT 'all', CAST(5 AS DOUBLE), CAST(5 AS DOUBLE), CAST(5 AS DOUBLE), CAST(5 AS DOUBLE)",
])
SCEN_GRID = (
    "SELECT 's' || lpad(CAST(i AS VARCHAR), 4, '0') AS scenario_id, (i % 20) * 0.5 AS pct_salary, "
    "CAST((i // 20) % 10 AS DOUBLE) * 2.0 AS pct_va, CAST(i // 200 AS DOUBLE) * 1.5 AS pct_plr, "
    "CASE WHEN i % 2 = 1 THEN 10.0 ELSE 0.0 END AS pct_overtime FROM range(1000) t(i)"
)


def _num(x: str, kind: str) -> str:
    return f"CAST(coalesce(CASE WHEN isnan({x}) THEN 0 ELSE {x} END, 0) AS {kind})"


def _cascade(emp: str, rates: str, scen: str, where: str = "") -> str:
    """One row per employee, rate row and scenario: the cost cascade as it is
    applied to a single employee, in exact decimals and unrounded."""
    r = {c: _num("r." + c, "DECIMAL(8,6)") for c in ("perc_he_medio", "provisao_ferias", "provisao_13", "rat_fap", "fgts",
                                                   "inss_patronal", "terceiros")}
    return f"""
{_ctes()},
sc AS ({scen}),
person AS (
  SELECT h.planta, {_num('h.salario_atual', 'DECIMAL(20,6)')} AS s, {_num('h.valor_va_atual', 'DECIMAL(20,6)')} AS va,
    {_num('h.plr_alvo_atual', 'DECIMAL(20,6)')} AS plr, {r['perc_he_medio']} AS he,
    CAST(1 + {r['provisao_ferias']} + {r['provisao_13']} AS DECIMAL(9,6)) AS prov,
    CAST(1 + {r['rat_fap']} + {r['fgts']} + {r['inss_patronal']} + {r['terceiros']} AS DECIMAL(9,6)) AS chg
  FROM {emp} h JOIN {rates} r ON h.planta = r.planta {where}),
cas AS (
  SELECT planta, scenario_id, s, va, plr, he, prov, chg,
    CAST(s * ks AS DECIMAL(22,10)) AS s2, CAST(he * khe AS DECIMAL(14,10)) AS he2,
    CAST(va * kva AS DECIMAL(22,10)) AS va2, CAST(plr * kplr AS DECIMAL(22,10)) AS plr2
  FROM person, (SELECT scenario_id, CAST(1 + pct_salary / 100 AS DECIMAL(12,8)) AS ks, CAST(1 + pct_va / 100 AS DECIMAL(12,8)) AS kva,
    CAST(1 + pct_plr / 100 AS DECIMAL(12,8)) AS kplr, CAST(1 + pct_overtime / 100 AS DECIMAL(12,8)) AS khe FROM sc)),
ot AS (
  SELECT *, CAST(he * s * CAST(1.2 AS DECIMAL(2,1)) AS DECIMAL(24,10)) AS o1,
    CAST(CAST(he2 * s2 AS DECIMAL(26,12)) * CAST(1.2 AS DECIMAL(2,1)) AS DECIMAL(24,10)) AS o2 FROM cas),
paid AS (
  SELECT *, CAST(CAST((s + o1) * prov AS DECIMAL(24,10)) * chg AS DECIMAL(24,10)) AS c1,
    CAST(CAST((s2 + o2) * prov AS DECIMAL(24,10)) * chg AS DECIMAL(24,10)) AS c2 FROM ot)"""


def _cents(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(28,6)), 2) AS DOUBLE)"


def _details(emp: str, rates: str, scen: str, where: str = "") -> str:
    """All 20 result columns: the employees' cascades summed per plant and
    scenario, rounded once at the end."""
    return f"""
WITH {_cascade(emp, rates, scen, where)},
t AS (
  SELECT planta, scenario_id, count(*) AS n_employees, sum(c1) * 12 AS sc1, sum(c2) * 12 AS sc2, sum(va) * 12 AS v1, sum(va2) * 12 AS v2,
    sum(plr) AS p1, sum(plr2) AS p2, sum(s) AS s1, sum(s2) AS s2, sum(o1) AS o1, sum(o2) AS o2, sum(va) AS va1, sum(va2) AS va2
  FROM paid GROUP BY planta, scenario_id)
SELECT planta, scenario_id, n_employees,
  {_cents('sc1 + v1 + p1')} AS current_cost, {_cents('sc2 + v2 + p2')} AS projected_cost,
  {_cents('(sc2 + v2 + p2) - (sc1 + v1 + p1)')} AS impact,
  {_cents('sc1')} AS salary_charged_current_annual, {_cents('sc2')} AS salary_charged_projected_annual,
  {_cents('v1')} AS va_current_annual, {_cents('v2')} AS va_projected_annual,
  {_cents('p1')} AS plr_current_annual, {_cents('p2')} AS plr_projected_annual,
  {_cents('s1')} AS base_salary_current, {_cents('o1')} AS overtime_current, CAST(0 AS DOUBLE) AS dsr_current,
  {_cents('va1')} AS va_current, {_cents('p1')} AS plr_current, {_cents('s2')} AS base_salary_new,
  {_cents('o2')} AS overtime_new, CAST(0 AS DOUBLE) AS dsr_projected, {_cents('va2')} AS va_new, {_cents('p2')} AS plr_new
FROM t"""


def _grid() -> str:
    """A thousand scenarios a plant: the employees' cascades without and with a
    unit of overtime, summed per plant, then scaled by each scenario."""
    one = "SELECT 'x' AS scenario_id, CAST(0 AS DOUBLE) AS pct_salary, CAST(0 AS DOUBLE) AS pct_va, CAST(0 AS DOUBLE) AS pct_plr, CAST(0 AS DOUBLE) AS pct_overtime"
    return f"""
WITH {_cascade("h", "p", one)},
t AS (SELECT planta, sum(CAST(CAST(s * prov AS DECIMAL(24,10)) * chg AS DECIMAL(24,10))) AS a,
        sum(c1) - sum(CAST(CAST(s * prov AS DECIMAL(24,10)) * chg AS DECIMAL(24,10))) AS b, sum(va) AS v, sum(plr) AS p FROM paid GROUP BY planta),
g AS ({SCEN_GRID}),
k AS (SELECT scenario_id, CAST(1 + pct_salary / 100 AS DECIMAL(12,8)) AS ks, CAST(1 + pct_va / 100 AS DECIMAL(12,8)) AS kva,
    CAST(1 + pct_plr / 100 AS DECIMAL(12,8)) AS kplr, CAST(1 + pct_overtime / 100 AS DECIMAL(12,8)) AS khe FROM g),
x AS (SELECT planta, scenario_id, (a + b) * 12 + v * 12 + p AS cur,
    CAST((CAST(a AS DECIMAL(24,10)) + CAST(CAST(b AS DECIMAL(22,10)) * khe AS DECIMAL(24,10))) AS DECIMAL(24,10)) AS sal, ks,
    CAST(CAST(v AS DECIMAL(22,8)) * kva AS DECIMAL(24,10)) * 12 + CAST(CAST(p AS DECIMAL(22,8)) * kplr AS DECIMAL(24,10)) AS other FROM t, k),
y AS (SELECT planta, scenario_id, cur, CAST(CAST(sal AS DECIMAL(22,10)) * ks AS DECIMAL(24,10)) * 12 + other AS new FROM x)
SELECT planta, scenario_id, {_cents('cur')} AS current_cost, {_cents('new')} AS projected_cost, {_cents('new - cur')} AS impact FROM y"""


def _wrap(inner: str, select: str) -> str:
    return f"SELECT {select} FROM ({inner}) q"


ORACLE["cost_details"] = _details("h", "p", SCEN_FIXTURE)
ORACLE["cost_scenario"] = _wrap(_details("h", "p", SCEN_TEST),
                                "planta, scenario_id, current_cost, projected_cost, impact")
ORACLE["cost_null_safe"] = _details("hn", "pn", SCEN_TEST)
ORACLE["scenario_grid"] = _grid()
ORACLE["filter_group"] = _details("h", "p", SCEN_TEST, "WHERE h.planta = 7")
ORACLE["cost_current"] = _wrap(
    _details("h", "p", SCEN_TEST),
    "planta, n_employees, salary_charged_current_annual, va_current_annual, plr_current_annual, current_cost")
ORACLE["budget_alert"] = _wrap(
    _details("h", "p", SCEN_FIXTURE),
    "planta, scenario_id, current_cost, impact, "
    "round(CASE WHEN current_cost > 0 THEN impact / current_cost * 100 ELSE 0 END, 4) AS budget_increase_pct, "
    "(CASE WHEN current_cost > 0 THEN impact / current_cost * 100 ELSE 0 END) > 5 AS alert")
ORACLE["cost_composition"] = f"""
WITH d AS ({_details("h", "p", SCEN_TEST)})
SELECT planta, scenario_id, 0 AS item_order, 'Salary' AS item, round(CAST(base_salary_current * 12 AS DECIMAL(28,6)), 2)::DOUBLE AS current,
       round(CAST(base_salary_new * 12 AS DECIMAL(28,6)), 2)::DOUBLE AS projected, round(CAST(base_salary_new * 12 AS DECIMAL(28,6)) - CAST(base_salary_current * 12 AS DECIMAL(28,6)), 2)::DOUBLE AS incremental FROM d
UNION ALL SELECT planta, scenario_id, 1, 'Salary with charges', salary_charged_current_annual, salary_charged_projected_annual,
       round(CAST(salary_charged_projected_annual AS DECIMAL(28,6)) - CAST(salary_charged_current_annual AS DECIMAL(28,6)), 2)::DOUBLE FROM d
UNION ALL SELECT planta, scenario_id, 2, 'PLR', plr_current_annual, plr_projected_annual,
       round(CAST(plr_projected_annual AS DECIMAL(28,6)) - CAST(plr_current_annual AS DECIMAL(28,6)), 2)::DOUBLE FROM d
UNION ALL SELECT planta, scenario_id, 3, 'VA', va_current_annual, va_projected_annual,
       round(CAST(va_projected_annual AS DECIMAL(28,6)) - CAST(va_current_annual AS DECIMAL(28,6)), 2)::DOUBLE FROM d"""
ORACLE["cost_composition_monthly"] = f"""
WITH d AS ({_details("h", "p", SCEN_TEST)})
SELECT planta, scenario_id, 0 AS item_order, 'Salary' AS item, base_salary_current AS current, base_salary_new AS projected,
       round(CAST(base_salary_new AS DECIMAL(28,6)) - CAST(base_salary_current AS DECIMAL(28,6)), 2)::DOUBLE AS incremental FROM d
UNION ALL SELECT planta, scenario_id, 1, 'PLR', plr_current, plr_new, round(CAST(plr_new AS DECIMAL(28,6)) - CAST(plr_current AS DECIMAL(28,6)), 2)::DOUBLE FROM d
UNION ALL SELECT planta, scenario_id, 2, 'VA', va_current, va_new, round(CAST(va_new AS DECIMAL(28,6)) - CAST(va_current AS DECIMAL(28,6)), 2)::DOUBLE FROM d"""
ORACLE["group_practice"] = f"""
WITH {_ctes()}
SELECT planta, round(avg(salario_atual), 4) AS avg_salary, round(avg(valor_va_atual), 4) AS avg_va,
       round(avg(plr_alvo_atual), 4) AS avg_plr, count(*) AS n_employees
FROM hn GROUP BY planta"""
ORACLE["maintained_costs"] = ORACLE["cost_null_safe"]
ORACLE["maintained_practice"] = ORACLE["group_practice"]
ORACLE["group_practice_empty"] = f"""
WITH {_ctes()}
SELECT avg(salario_atual) AS avg_salary, avg(valor_va_atual) AS avg_va, avg(plr_alvo_atual) AS avg_plr,
       count(*) AS n_employees
FROM h WHERE planta = -1"""
ORACLE["group_headcount"] = f"""
WITH {_ctes()}
SELECT h.planta, count(*) AS total_employees, round(avg(h.salario_atual), 4) AS avg_salary
FROM h JOIN p ON h.planta = p.planta GROUP BY h.planta"""
ORACLE["distinct_groups"] = f"WITH {_ctes()} SELECT DISTINCT planta FROM h"
_DIM = f"""dim AS (
  SELECT {', '.join(tm.PLANT_DIM_EXPR)} FROM supplier
  UNION ALL
  SELECT 'G' || CAST(s_suppkey AS VARCHAR(20)), s_suppkey + 1000000000000,
         CAST(300 + 50 * (s_suppkey % 7) AS DOUBLE) + 1, CAST(300 + 100 * (s_suppkey % 11) AS DOUBLE) + 1 FROM supplier),
d1 AS (SELECT planta, arg_min(ajuda_combustivel_planta, line) AS ajuda_combustivel_planta,
              arg_min(plr_alvo_planta, line) AS plr_alvo_planta FROM dim GROUP BY planta),
st AS (SELECT {', '.join(tm.STAFF_EXPR)} FROM lineitem)"""
ORACLE["dim_lookup"] = f"""
WITH {_DIM}
SELECT st.planta, count(*) AS n_staff, any_value(d1.ajuda_combustivel_planta) AS ajuda_combustivel_planta,
       any_value(d1.plr_alvo_planta) AS plr_alvo_planta
FROM st LEFT JOIN d1 ON st.planta = d1.planta GROUP BY st.planta"""
ORACLE["derive_pay"] = f"""
WITH {_DIM}
SELECT st.id_funcionario, st.planta, st.subgrupo_cargos,
  round(CASE st.subgrupo_cargos WHEN 'Operação' THEN 2500.0 WHEN 'Analista' THEN 5500.0 WHEN 'Especialista' THEN 11000.0
        WHEN 'Supervisor' THEN 9000.0 END * CASE WHEN st.planta = 'G1' THEN 1.2 ELSE 1.0 END, 2)::DOUBLE AS base_salary_ref,
  CASE WHEN st.planta = 'G1' THEN 1050.0 ELSE 700.0 END::DOUBLE AS va,
  d1.ajuda_combustivel_planta AS fuel_aid,
  st.subgrupo_cargos IN ('Operação', 'Analista') AS plr_eligible,
  CASE WHEN st.subgrupo_cargos IN ('Operação', 'Analista') THEN d1.plr_alvo_planta ELSE 0.0 END::DOUBLE AS plr_target
FROM st LEFT JOIN d1 ON st.planta = d1.planta"""

# ----------------------------------------------------------------- market and sources
_MARKET = """market AS (
  SELECT 'G' || CAST(s_suppkey AS VARCHAR) AS Filial, s_name AS Empresa_Referencia, n_name AS Regiao,
    CAST(50 + s_nationkey % 10 AS DOUBLE) / 10 AS Reajuste_Praticado,
    round(s_acctbal, 2) AS VA_Valor, round(s_acctbal * 10, 2) AS PLR_Referencia,
    make_date(CAST(2024 + s_suppkey % 2 AS INTEGER), CAST(1 + s_suppkey % 12 AS INTEGER), 1) AS Data_Acordo,
    'clause ' || n_name AS Principais_Clausulas
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0)"""
ORACLE["market_parse"] = f"WITH {_MARKET} SELECT * FROM market"
ORACLE["filter_ci"] = f"WITH {_MARKET} SELECT * FROM market WHERE upper(Filial) = upper('g7')"
ORACLE["benchmark_status"] = f"""
WITH {_MARKET}
SELECT 'G' || CAST(s_suppkey AS VARCHAR) AS plant,
       CASE WHEN m.Filial IS NULL THEN 'no_data' ELSE 'ok' END AS status, m.* EXCLUDE (Filial)
FROM supplier s LEFT JOIN market m ON upper('G' || CAST(s.s_suppkey AS VARCHAR)) = upper(m.Filial)"""
ORACLE["benchmark_gap"] = f"""
WITH {_ctes()}, {_MARKET},
pr AS (SELECT 'G' || CAST(planta AS VARCHAR) AS plant, avg(valor_va_atual) AS avg_va, avg(plr_alvo_atual) AS avg_plr,
              count(*) AS n_employees FROM h GROUP BY planta),
j AS (SELECT pr.*, m.VA_Valor AS market_va, m.PLR_Referencia AS market_plr
      FROM pr LEFT JOIN market m ON upper(pr.plant) = upper(m.Filial))
SELECT plant, n_employees,
  round(avg_va, 4) AS own_va, market_va, round(avg_va - market_va, 4) AS gap_va,
  CASE WHEN market_va IS NULL OR avg_va IS NULL THEN 'no_data'
       WHEN abs(avg_va - market_va) <= abs(market_va) * 0.01 THEN 'at'
       WHEN avg_va - market_va > 0 THEN 'above' ELSE 'below' END AS verdict_va,
  round(avg_plr, 4) AS own_plr, market_plr, round(avg_plr - market_plr, 4) AS gap_plr,
  CASE WHEN market_plr IS NULL OR avg_plr IS NULL THEN 'no_data'
       WHEN abs(avg_plr - market_plr) <= abs(market_plr) * 0.01 THEN 'at'
       WHEN avg_plr - market_plr > 0 THEN 'above' ELSE 'below' END AS verdict_plr
FROM j"""
ORACLE["csv_bad_lines"] = """
SELECT s_suppkey AS line, CAST(s_suppkey AS VARCHAR) AS id, s_name || '; "' || s_nationkey || '"' AS title,
  CASE WHEN s_suppkey % 4 = 2 THEN 'note' END AS note
FROM supplier WHERE s_suppkey % 4 <> 3"""

# ----------------------------------------------------------------- text rules
WS = "\\t\\n\\x{0B}\\f\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


_SYN = f"""syn_rows AS (
  SELECT s_suppkey AS line, 'G' || CAST(s_suppkey AS VARCHAR) AS Planta,
    CASE WHEN s_acctbal >= 0 THEN concat_ws(', ', s_name, n_name, '',
      ['the', 'and', 'que', 'der', 'die', 'for', 'les'][s_suppkey % 7 + 1]) END AS Sinonimos
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
syn_items AS (
  SELECT line, Planta, unnest(string_split(coalesce(Sinonimos, ''), ',')) AS raw,
         unnest(range(len(string_split(coalesce(Sinonimos, ''), ',')))) AS idx FROM syn_rows),
syn_ex AS (
  SELECT line, CAST(idx AS INTEGER) AS idx, {_strip('Planta')} AS plant, lower({_strip('raw')}) AS synonym
  FROM syn_items WHERE lower({_strip('raw')}) <> ''),
smap AS (
  SELECT synonym, min(line * 1000000 + idx) AS p, arg_max(plant, line * 1000000 + idx) AS plant
  FROM syn_ex GROUP BY synonym),
msgs AS (
  SELECT conv_id, turn, text, 'G' || CAST(conv_id % 10 AS VARCHAR) AS selected_plant,
    (['  cálculo ', 'POLÍTICA', 'benchmark' || chr(10), 'Consulta_Estrategica', 'unknown', 'CÁLCULO_FINANCEIRO ', NULL])
      [(conv_id + turn) % 7 + 1] AS label
  FROM conversations WHERE role = 'user'),
msg_words AS (
  SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM msgs),
hits AS (
  SELECT m.conv_id, m.turn, s.plant, s.p
  FROM (SELECT *, regexp_extract(synonym, '[\\p{{L}}\\p{{N}}_]+') AS word FROM smap) s JOIN msg_words USING (word)
  JOIN msgs m ON m.conv_id = msg_words.conv_id AND m.turn = msg_words.turn
  WHERE regexp_matches(lower(m.text),
         '(^|[^\\p{{L}}\\p{{N}}_])' || regexp_replace(s.synonym, '([^\\p{{L}}\\p{{N}}_ ])', '\\\\\\1', 'g') || '([^\\p{{L}}\\p{{N}}_]|$)')),
tags AS (
  SELECT m.conv_id, m.turn, h.tagged_plant
  FROM msgs m LEFT JOIN (SELECT conv_id, turn, arg_min(plant, p) AS tagged_plant FROM hits GROUP BY conv_id, turn) h
    ON m.conv_id = h.conv_id AND m.turn = h.turn),
ctx AS (
  SELECT m.*, t.tagged_plant, coalesce(t.tagged_plant, m.selected_plant) AS plant
  FROM msgs m JOIN tags t ON m.conv_id = t.conv_id AND m.turn = t.turn),
refs AS (
  SELECT DISTINCT plant FROM (
    SELECT 'G' || CAST(s_suppkey AS VARCHAR) AS plant FROM supplier WHERE s_acctbal >= 0)),
routed AS (
  SELECT ctx.*,
    CASE WHEN r.plant IS NULL THEN 'ERRO'
         WHEN upper({_strip('label')}) IN ('CÁLCULO', 'POLÍTICA', 'CÁLCULO_FINANCEIRO', 'BENCHMARK', 'CONSULTA_ESTRATEGICA')
           THEN upper({_strip('label')})
         WHEN contains(lower(text), 'the') OR contains(lower(text), 'und') OR contains(lower(text), 'que')
           OR contains(lower(text), 'les') THEN 'CONSULTA_ESTRATEGICA'
         ELSE 'POLÍTICA' END AS intent
  FROM ctx LEFT JOIN refs r ON ctx.plant = r.plant)"""

ORACLE["synonym_explode"] = f"WITH {_SYN} SELECT line, idx, plant, synonym FROM syn_ex"
ORACLE["synonym_map"] = f"""WITH {_SYN}
SELECT synonym, p // 1000000 AS pos_line, CAST(p % 1000000 AS INTEGER) AS pos_idx, plant FROM smap"""
ORACLE["tag_group"] = f"WITH {_SYN} SELECT conv_id, turn, tagged_plant FROM tags"
ORACLE["message_context"] = f"WITH {_SYN} SELECT conv_id, turn, selected_plant, tagged_plant, plant FROM ctx"
ORACLE["keyword_flag"] = """
SELECT conv_id, turn, coalesce(contains(lower(text), 'the') OR contains(lower(text), 'und')
  OR contains(lower(text), 'que') OR contains(lower(text), 'les'), false) AS has_keyword FROM conversations"""
ORACLE["intent_normalise"] = f"""WITH {_SYN}
SELECT conv_id, turn, label, CASE WHEN upper({_strip('label')}) IN
  ('CÁLCULO', 'POLÍTICA', 'CÁLCULO_FINANCEIRO', 'BENCHMARK', 'CONSULTA_ESTRATEGICA') THEN upper({_strip('label')}) END AS intent_label
FROM msgs"""
ORACLE["intent_route"] = f"WITH {_SYN} SELECT conv_id, turn, plant, intent FROM routed"
ORACLE["risk_flag"] = f"""WITH {_SYN},
rep AS (SELECT conv_id, turn - 1 AS q_turn, text AS answer FROM conversations WHERE role = 'assistant')
SELECT r.conv_id, r.turn, r.intent,
  CASE WHEN regexp_matches(lower(coalesce(answer, '')), '([6-9]|[1-9][0-9]|100)%')
         OR contains(lower(coalesce(answer, '')), 'greve') OR contains(lower(coalesce(answer, '')), 'paralisação')
         OR contains(lower(coalesce(answer, '')), 'nicht') THEN 'high'
       WHEN contains(lower(coalesce(r.intent, '')), 'erro') THEN 'attention' ELSE 'low' END AS risk
FROM routed r LEFT JOIN rep ON r.conv_id = rep.conv_id AND r.turn = rep.q_turn"""
ORACLE["history_view"] = f"""WITH {_SYN}
SELECT c.conv_id, c.turn, c.role, c.text,
  CASE WHEN c.role = 'assistant' THEN r.intent END AS reply_type,
  CASE WHEN c.role = 'assistant' THEN r.plant END AS reply_context
FROM conversations c LEFT JOIN routed r ON c.conv_id = r.conv_id AND c.turn = r.turn + 1"""

_JSON_KEYS = [("reajuste_salarial", "pct_salary"), ("reajuste_va", "pct_va"), ("reajuste_plr", "pct_plr"),
              ("aumento_he", "pct_overtime")]


def _json_oracle() -> str:
    from .testmap import PARAMS_TEXT_EXPR
    vals = ",\n    ".join(
        f"json_extract(CASE WHEN obj THEN params_text END, '$.\"{k}\"') AS v_{n}" for k, n in _JSON_KEYS)
    nums = ",\n    ".join(
        f"CASE WHEN v_{n} IS NULL THEN NULL "
        f"WHEN json_type(v_{n}) IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(json_extract_string(v_{n}, '$') AS DOUBLE) "
        f"WHEN json_type(v_{n}) = 'VARCHAR' THEN TRY_CAST(trim(json_extract_string(v_{n}, '$')) AS DOUBLE) "
        f"WHEN json_type(v_{n}) = 'BOOLEAN' THEN CASE WHEN json_extract_string(v_{n}, '$') = 'true' THEN 1.0 ELSE 0.0 END "
        f"END AS x_{n}" for _, n in _JSON_KEYS)
    ok = " AND ".join(f"(v_{n} IS NULL OR x_{n} IS NOT NULL)" for _, n in _JSON_KEYS)
    outs = ", ".join(f"CASE WHEN ok AND v_{n} IS NOT NULL THEN x_{n} ELSE 0.0 END AS {n}" for _, n in _JSON_KEYS)
    return f"""
WITH t AS (SELECT event_id, {PARAMS_TEXT_EXPR} FROM events),
o AS (SELECT *, CASE WHEN coalesce(json_valid(params_text), false) THEN json_type(params_text) = 'OBJECT' ELSE false END AS obj FROM t),
v AS (SELECT event_id, obj, {vals} FROM o),
x AS (SELECT *, {nums} FROM v),
y AS (SELECT *, obj AND {ok} AS ok FROM x)
SELECT event_id, {outs} FROM y"""


ORACLE["json_params"] = _json_oracle()
ORACLE["scenario_inputs"] = """
SELECT s_suppkey AS planta, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE round(s_acctbal / 1000, 1) END AS typed,
  CAST(s_nationkey % 41 AS DOUBLE) * 0.5 AS slider,
  coalesce(nullif(CASE WHEN s_acctbal < 0 THEN 0.0 ELSE round(s_acctbal / 1000, 1) END, 0.0),
           CAST(s_nationkey % 41 AS DOUBLE) * 0.5) AS pct_salary
FROM supplier"""
ORACLE["format_money"] = f"""
WITH d AS ({_details("h", "p", SCEN_TEST)})
SELECT planta, 'R$ ' || format('{{:,.2f}}', current_cost) AS current_fmt,
  'R$ ' || format('{{:,.2f}}', projected_cost) AS projected_fmt, 'R$ ' || format('{{:,.2f}}', impact) AS impact_fmt,
  format('{{:.2f}}', CASE WHEN current_cost > 0 THEN impact / current_cost * 100 ELSE 0 END) || '%' AS increase_fmt
FROM d"""

# ----------------------------------------------------------------- retrieval


def _chunk_sql(src: str, key: str) -> str:
    """Fixed 1000-character chunks of ``src`` (columns: key, file, text)."""
    return f"""(
  SELECT {key}, file, pos, text FROM (
    SELECT {key}, file, CAST(p AS INTEGER) AS pos, substring(text, CAST(p * 1000 + 1 AS BIGINT), 1000) AS text FROM (
      SELECT {key}, file, text, unnest(range(CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS p
      FROM {src} WHERE length(text) > 0))
  WHERE regexp_matches(text, '[^{WS}]'))"""


_REFS = f"refs AS (SELECT DISTINCT plant, file FROM ({' UNION ALL '.join(tm.DOC_REFS_SQL_PARTS)}))"
_CHUNKS = f"chunks AS {_chunk_sql('(SELECT doc_id, source AS file, text FROM documents)', 'doc_id')}"
ORACLE["doc_chunk"] = f"WITH {_CHUNKS} SELECT * FROM chunks"
ORACLE["chunk_preview"] = f"WITH {_CHUNKS} SELECT doc_id, pos, replace(substring(text, 1, 300), chr(10), ' ') AS preview FROM chunks"
ORACLE["corpus_stats"] = f"WITH {_CHUNKS} SELECT count(*) AS n_chunks, count(DISTINCT file) AS n_files FROM chunks"
ORACLE["chunks_refreshed"] = ORACLE["doc_chunk"]
ORACLE["corpus_report"] = f"""WITH {_CHUNKS}
SELECT count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars, true AS files_near, true AS texts_near, true AS words_near FROM chunks"""
ORACLE["doc_assemble"] = f"""
WITH docs AS (SELECT conv_id AS file, string_agg(coalesce(text, '') || chr(10), '' ORDER BY turn) AS text
              FROM conversations GROUP BY conv_id)
SELECT file, pos, text FROM {_chunk_sql('(SELECT file AS k, file, text FROM docs)', 'k')}"""
ORACLE["docs_by_group"] = f"""WITH {_REFS}
SELECT plant, count(*) AS n_files, string_agg(file, ', ' ORDER BY file) AS files FROM refs GROUP BY plant"""
ORACLE["docs_by_group_paged"] = f"""WITH {_REFS},
numbered AS (SELECT plant, file, (row_number() OVER (PARTITION BY plant ORDER BY file) - 1) // 1 AS page FROM refs)
SELECT plant, page, count(*) AS n_files, string_agg(file, ', ' ORDER BY file) AS files FROM numbered GROUP BY plant, page"""
ORACLE["allowed_chunks"] = f"""WITH {_CHUNKS}, {_REFS}
SELECT r.plant, c.doc_id, c.pos, c.file FROM chunks c JOIN refs r ON c.file = r.file"""

_VEC = f"""{_REFS},
vecs AS (SELECT vec_id, 'src' || CAST(label AS VARCHAR) AS file, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
dims AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS d FROM vecs),
cen AS (SELECT label, list(x ORDER BY d) AS q FROM (SELECT label, d, avg(x) AS x FROM dims GROUP BY label, d) GROUP BY label),
qs AS (SELECT CAST(label AS BIGINT) AS query_id, 'G' || CAST(label AS VARCHAR) AS plant, q FROM cen),
sc AS (
  SELECT qs.query_id, qs.plant, vecs.vec_id, vecs.file,
    CASE WHEN list_dot_product(v, v) > 0 AND list_dot_product(q, q) > 0
         THEN list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) END AS score
  FROM vecs CROSS JOIN qs),
top10 AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC NULLS LAST, vec_id) AS rank
                 FROM sc) WHERE rank <= 10),
post AS (
  SELECT * FROM (
    SELECT t.query_id, t.vec_id, t.file, t.score, row_number() OVER (PARTITION BY t.query_id ORDER BY t.rank) AS rank
    FROM top10 t WHERE EXISTS (SELECT 1 FROM refs r WHERE r.plant = t.plant AND r.file = t.file)) WHERE rank <= 3)"""
ORACLE["search_top10"] = f"WITH {_VEC} SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, file, round(score, 6) AS score FROM top10"
ORACLE["search_postfilter"] = f"WITH {_VEC} SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, file, round(score, 6) AS score FROM post"
ORACLE["search_prefilter"] = f"""WITH {_VEC},
pre AS (
  SELECT * FROM (
    SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC NULLS LAST, vec_id) AS rank
    FROM sc s WHERE EXISTS (SELECT 1 FROM refs r WHERE r.plant = s.plant AND r.file = s.file)) WHERE rank <= 3)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, file, round(score, 6) AS score FROM pre"""
ORACLE["search_status"] = f"""WITH {_VEC},
na AS (SELECT plant, count(*) AS n FROM refs GROUP BY plant),
nt AS (SELECT query_id, count(*) AS n FROM top10 GROUP BY query_id),
nk AS (SELECT query_id, count(*) AS n FROM post GROUP BY query_id)
SELECT qs.query_id, qs.plant,
  CASE WHEN coalesce(na.n, 0) = 0 THEN 'no_allowed_files' WHEN (SELECT count(*) FROM vecs) = 0 THEN 'empty_index'
       WHEN coalesce(nt.n, 0) = 0 THEN 'no_hit' WHEN coalesce(nk.n, 0) = 0 THEN 'no_allowed_hit' ELSE 'ok' END AS status,
  coalesce(nk.n, 0) AS n_returned
FROM qs LEFT JOIN na ON qs.plant = na.plant LEFT JOIN nt ON qs.query_id = nt.query_id LEFT JOIN nk ON qs.query_id = nk.query_id"""

_TOK = "'[\\p{L}\\p{N}]+'"


def _tfidf(queries: str) -> str:
    """TF-IDF cosine of ``queries(query_id, text)`` against the document
    chunks; top 3 per query."""
    return f"""{_CHUNKS},
qsrc AS ({queries}),
ct AS (SELECT doc_id, pos, unnest(regexp_extract_all(lower(text), {_TOK})) AS term FROM chunks),
tf AS (SELECT doc_id, pos, term, count(*) AS tf FROM ct GROUP BY doc_id, pos, term),
idf AS (SELECT term, ln(CAST((SELECT count(*) FROM chunks) AS DOUBLE) / count(*)) AS idf FROM tf GROUP BY term),
w AS (SELECT tf.doc_id, tf.pos, tf.term, tf.tf * idf.idf AS w FROM tf JOIN idf ON tf.term = idf.term WHERE idf.idf > 0),
nd AS (SELECT doc_id, pos, sqrt(sum(w * w)) AS nd FROM w GROUP BY doc_id, pos),
qt AS (SELECT query_id, unnest(regexp_extract_all(lower(text), {_TOK})) AS term FROM qsrc),
qtf AS (SELECT query_id, term, count(*) AS tf FROM qt GROUP BY query_id, term),
qw AS (SELECT qtf.query_id, qtf.term, qtf.tf * idf.idf AS wq FROM qtf JOIN idf ON qtf.term = idf.term WHERE idf.idf > 0),
qn AS (SELECT query_id, sqrt(sum(wq * wq)) AS nq FROM qw GROUP BY query_id),
dots AS (SELECT qw.query_id, w.doc_id, w.pos, sum(w.w * qw.wq) AS dot FROM w JOIN qw ON w.term = qw.term
         GROUP BY qw.query_id, w.doc_id, w.pos),
tsc AS (SELECT d.query_id, d.doc_id, d.pos, d.dot / (nd.nd * qn.nq) AS score FROM dots d
        JOIN nd ON d.doc_id = nd.doc_id AND d.pos = nd.pos JOIN qn ON d.query_id = qn.query_id),
trk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC NULLS LAST, doc_id, pos)
        AS rank FROM tsc) WHERE rank <= 3),
thits AS (SELECT trk.*, c.file, c.text FROM trk JOIN chunks c ON trk.doc_id = c.doc_id AND trk.pos = c.pos)"""


_BENCH_Q = "SELECT item_id AS query_id, text FROM benchmark"
ORACLE["text_search"] = f"WITH {_tfidf(_BENCH_Q)} SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, pos, file, round(score, 6) AS score FROM thits"
ORACLE["context_block"] = f"""WITH {_tfidf(_BENCH_Q)}
SELECT query_id, string_agg(text, chr(10) || '---' || chr(10) ORDER BY rank) AS context,
  string_agg(file, ', ' ORDER BY rank) AS files, count(*) AS n_hits FROM thits GROUP BY query_id"""

# ----------------------------------------------------------------- SQL, records, streaming, answers
ORACLE["sql_passthrough"] = f"""WITH {_ctes()}, headcount AS (SELECT * FROM h), premissas AS (SELECT * FROM p)
SELECT rate.planta AS plant, max(rate.perc_he_medio) AS overtime_share, max(pay.salario_atual) AS top_salary,
  CAST(sum(CASE WHEN pay.plr_alvo_atual > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_with_plr
FROM premissas AS rate LEFT JOIN headcount AS pay USING (planta)
GROUP BY rate.planta HAVING count(*) >= 1"""
ORACLE["to_records"] = f"""WITH {_MARKET}
SELECT Filial, CAST(to_json(market) AS VARCHAR) AS record FROM market"""
ORACLE["stream_tag"] = ORACLE["tag_group"]
_STRATEGIC = " OR ".join(f"contains(lower(text), '{w}')" for w in STRATEGIC_KEYWORDS)
ORACLE["stream_history"] = f"""WITH {_SYN},
told AS (SELECT ctx.conv_id, ctx.turn, ctx.plant,
    CASE WHEN r.plant IS NULL THEN 'ERRO'
         WHEN upper({_strip('label')}) IN ('CÁLCULO', 'POLÍTICA', 'CÁLCULO_FINANCEIRO', 'BENCHMARK', 'CONSULTA_ESTRATEGICA') THEN upper({_strip('label')})
         WHEN {_STRATEGIC} THEN 'CONSULTA_ESTRATEGICA' ELSE 'POLÍTICA' END AS intent
  FROM ctx LEFT JOIN refs r ON ctx.plant = r.plant)
SELECT c.conv_id, c.turn, c.role, c.text, CASE WHEN c.role = 'assistant' THEN u.intent END AS reply_type,
  CASE WHEN c.role = 'assistant' THEN u.plant END AS reply_context,
  CASE WHEN c.role = 'assistant' THEN
    CASE WHEN regexp_matches(lower(coalesce(c.text, '')), '([6-9]|[1-9][0-9]|100)%') OR contains(lower(coalesce(c.text, '')), 'greve')
           OR contains(lower(coalesce(c.text, '')), 'paralisação') THEN 'high'
         WHEN contains(lower(coalesce(u.intent, '')), 'erro') THEN 'attention' ELSE 'low' END END AS risk
FROM conversations c LEFT JOIN told u ON c.conv_id = u.conv_id AND c.turn = u.turn + 1"""
_MSGQ = "SELECT {'c': conv_id, 't': turn} AS query_id, text FROM routed"


def _scenario_sql() -> str:
    """The message's percentages by parameter text, and every plant's costs under each."""
    pct = ((5, 10, 15, 0), (0, 0, 15.5, 10), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0))
    return " UNION ALL ".join(
        f"SELECT '{i}' AS scenario_id, CAST({a} AS DOUBLE) AS pct_salary, CAST({b} AS DOUBLE) AS pct_va, "
        f"CAST({c} AS DOUBLE) AS pct_plr, CAST({d} AS DOUBLE) AS pct_overtime" for i, (a, b, c, d) in enumerate(pct))


def _message_costs(source: str, where: str = "TRUE") -> str:
    return f"""SELECT x.conv_id, x.turn, x.planta, pct_salary, pct_va, pct_plr, pct_overtime, d.* EXCLUDE (planta, scenario_id)
FROM (SELECT conv_id, turn, CAST(substring(plant, 2) AS BIGINT) AS planta, CAST((conv_id + turn) % 5 AS VARCHAR) AS k FROM {source} WHERE {where}) x
JOIN ({_scenario_sql()}) sc ON sc.scenario_id = x.k
LEFT JOIN ({_details("h", "p", _scenario_sql())}) d ON d.planta = x.planta AND d.scenario_id = x.k"""


ORACLE["message_scenario"] = f"WITH {_SYN} {_message_costs('ctx')}"
ORACLE["text_search_status"] = f"""WITH {_REFS}, {_tfidf(_BENCH_Q).replace("WHERE rank <= 3)", "WHERE rank <= 10)")},
qs AS (SELECT item_id AS query_id, 'G' || CAST(item_id % 10 AS VARCHAR) AS plant FROM benchmark),
kept AS (SELECT t.query_id, least(count(*), 3) AS n FROM thits t JOIN qs ON t.query_id = qs.query_id
         JOIN refs r ON r.plant = qs.plant AND r.file = t.file GROUP BY t.query_id)
SELECT qs.query_id, qs.plant,
  CASE WHEN qs.plant NOT IN (SELECT plant FROM refs) THEN 'no_allowed_files'
       WHEN qs.query_id NOT IN (SELECT query_id FROM thits) THEN 'no_hit'
       WHEN coalesce(kept.n, 0) = 0 THEN 'no_allowed_hit' ELSE 'ok' END AS status, coalesce(kept.n, 0) AS n_returned
FROM qs LEFT JOIN kept ON qs.query_id = kept.query_id"""


def _answer() -> str:
    t = _tfidf(_MSGQ.replace("routed", "readers")).replace("WHERE rank <= 3)", "WHERE rank <= 10)")
    return f"""WITH {_SYN}, {_REFS.replace('refs AS', 'drefs AS')}, {_MARKET},
recs AS (SELECT upper(Filial) AS k, CAST(to_json(list(market ORDER BY Filial)) AS VARCHAR) AS market_records FROM market GROUP BY upper(Filial)),
known AS (SELECT r.*, recs.market_records AS all_records FROM routed r LEFT JOIN recs ON upper(r.plant) = recs.k),
readers AS (SELECT * FROM known WHERE intent = 'POLÍTICA' OR (intent = 'CONSULTA_ESTRATEGICA' AND all_records IS NOT NULL)), {t},
hp AS (SELECT thits.*, r.plant FROM thits JOIN readers r ON thits.query_id.c = r.conv_id AND thits.query_id.t = r.turn),
post AS (SELECT * FROM (SELECT hp.*, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r2 FROM hp
         WHERE EXISTS (SELECT 1 FROM drefs d WHERE d.plant = hp.plant AND d.file = hp.file)) WHERE r2 <= 3),
actx AS (SELECT query_id.c AS conv_id, query_id.t AS turn, string_agg(text, chr(10) || '---' || chr(10) ORDER BY r2) AS context,
         string_agg(file, ', ' ORDER BY r2) AS files, count(*) AS n_hits FROM post GROUP BY query_id),
own AS ({ORACLE["group_practice"].replace("FROM hn", "FROM h")}),
cost AS ({_message_costs("routed", "intent = 'CÁLCULO_FINANCEIRO'")})
SELECT k.conv_id, k.turn, k.plant, k.intent,
  CASE WHEN k.intent IN ('BENCHMARK', 'CONSULTA_ESTRATEGICA') THEN k.all_records END AS market_records,
  CASE WHEN k.intent IN ('BENCHMARK', 'CONSULTA_ESTRATEGICA') THEN CASE WHEN k.all_records IS NULL THEN 'no_data' ELSE 'ok' END END AS market_status,
  own.avg_salary AS own_avg_salary, own.avg_va AS own_avg_va, own.avg_plr AS own_avg_plr, own.n_employees AS own_employees,
  a.context, a.files, coalesce(a.n_hits, 0) AS n_context, c.* EXCLUDE (conv_id, turn, planta)
FROM known k LEFT JOIN actx a ON k.conv_id = a.conv_id AND k.turn = a.turn
LEFT JOIN own ON k.intent = 'BENCHMARK' AND k.all_records IS NOT NULL AND k.plant = 'G' || CAST(own.planta AS VARCHAR)
LEFT JOIN cost c ON k.conv_id = c.conv_id AND k.turn = c.turn"""


ORACLE["answer_context"] = _answer()
