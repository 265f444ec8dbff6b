"""Payroll costing: employees joined to per-plant charge rates, current and
projected annual cost per plant, for any number of raise scenarios.

Plan shape (all plants, all scenarios in one job)::

    employees --partial agg by plant--> shuffle(plant) --final agg--+
                                                                    +-- join(plant) -- agg -- explode(scenarios)
    rates -----------------------------------------------------------+

Cost is linear in the employee values once the plant's rates are fixed, so the
employee side is reduced to a handful of sums per plant *before* the rate join:
the join and everything after it meet plants, never employees.  Duplicate rate
rows for a plant multiply the plant's employees exactly as a row-wise join
would, because the post-join sums run over the joined rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------
OVERTIME_LOAD = 1.2          # overtime hours are paid at +20 %
MONTHS = 12                  # salary and VA are monthly; PLR is already annual
RATE_COLUMNS = (
    "rat_fap", "perc_he_medio", "fgts", "provisao_ferias", "provisao_13",
    "inss_patronal", "terceiros",
)
# ---------------------------------------------------------------------------------

PLANT = "planta"


@dataclass(frozen=True)
class Scenario:
    """Percentages as in the user interface: 5.0 means +5 %."""

    scenario_id: str
    pct_salary: float = 0.0
    pct_va: float = 0.0
    pct_plr: float = 0.0
    pct_overtime: float = 0.0


SCENARIO_TYPE = ("array<struct<scenario_id:string,pct_salary:double,pct_va:double,"
                 "pct_plr:double,pct_overtime:double>>")


def scenarios_column(scenarios: Sequence[Scenario]) -> Column:
    """The scenario list as one array column: a single JSON string literal
    parsed by ``from_json``, which the optimizer folds into a constant once
    (thousands of scenarios cost one literal, not thousands of expressions)."""
    payload = json.dumps([
        {"scenario_id": s.scenario_id, "pct_salary": float(s.pct_salary), "pct_va": float(s.pct_va),
         "pct_plr": float(s.pct_plr), "pct_overtime": float(s.pct_overtime)}
        for s in scenarios
    ])
    return F.from_json(F.lit(payload), SCENARIO_TYPE)


def rule_scenarios(n: int) -> list[Scenario]:
    """``n`` scenarios on a regular grid (salary 0–9.5 %, VA 0–18 %, PLR in
    1.5 % steps, overtime 0 or 10 %) — a parameter sweep for planning."""
    out = []
    for i in range(n):
        out.append(Scenario(
            scenario_id=f"s{i:04d}",
            pct_salary=(i % 20) * 0.5,
            pct_va=float((i // 20) % 10) * 2.0,
            pct_plr=float(i // 200) * 1.5,
            pct_overtime=10.0 if i % 2 else 0.0,
        ))
    return out


# Money is exact decimal from the first sum to the last rounding: six places for
# an employee's amounts, twelve for a rate, ten for what is computed from them.
# Only results are rounded, once, to cents.
AMOUNT, RATE, TOTAL = "decimal(22,6)", "decimal(18,12)", "decimal(24,10)"


def _exact(col: str, kind: str) -> Column:
    """A number as exact decimal; null and NaN count as 0, an infinite one is an error."""
    c = F.col(col).cast("double")
    finite = F.when(F.abs(c) == float("inf"), F.raise_error(F.lit(f"{col} is infinite")).cast("double")).otherwise(c)
    return F.coalesce(F.when(~F.isnan(c), finite), F.lit(0.0)).cast(kind)


def amount_sums() -> list[Column]:
    """Aggregates of the employee columns: rows, and the exact sums of salary, VA and PLR."""
    return [
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(_exact("salario_atual", AMOUNT)).cast(AMOUNT).alias("s_sum"),
        F.sum(_exact("valor_va_atual", AMOUNT)).cast(AMOUNT).alias("va_sum"),
        F.sum(_exact("plr_alvo_atual", AMOUNT)).cast(AMOUNT).alias("plr_sum"),
    ]


def employee_sums(employees: DataFrame) -> DataFrame:
    """Per-plant sums of the employee columns (null and NaN count as 0, rows as 1).

    Sums are unrounded and exact, so they do not depend on the order in which
    rows reach the aggregate.  Spark runs this as a partial aggregate in every
    map task: a plant that holds a third of all employees still ships one row
    per task to the shuffle.
    """
    return employees.groupBy(PLANT).agg(*amount_sums())


def rate_factors(rates: DataFrame) -> DataFrame:
    """Per rate row: charged-salary factor ``fe`` (provisions times charges) and
    loaded overtime share ``ot``; a null or NaN rate counts as 0."""
    r = {c: _exact(c, RATE) for c in RATE_COLUMNS}
    one = F.lit(1).cast(RATE)
    f = (one + r["provisao_ferias"] + r["provisao_13"]).cast(RATE)
    e = (one + r["rat_fap"] + r["fgts"] + r["inss_patronal"] + r["terceiros"]).cast(RATE)
    load = F.lit(str(OVERTIME_LOAD)).cast("decimal(2,1)")
    return rates.select(F.col(PLANT), (f * e).cast("decimal(22,16)").alias("fe"),
                        (r["perc_he_medio"] * load).cast("decimal(20,13)").alias("ot"))


def cost_basis(employees: DataFrame, rates: DataFrame) -> DataFrame:
    """Per plant, the sums every scenario needs.

    ``S = Σs``, ``HE = Σ 1.2·s·he``, ``A = Σ s·f·e``, ``B = Σ 1.2·s·he·f·e``,
    ``V = Σva``, ``P = Σplr``, ``n`` joined rows.  Plants without a rate row
    drop out (inner join).
    """
    return basis_of_sums(employee_sums(employees), rates)


def basis_of_sums(sums: DataFrame, rates: DataFrame) -> DataFrame:
    """:func:`cost_basis` from per-plant sums that are there already."""
    j = sums.join(rate_factors(rates), PLANT, "inner")
    j = j.withColumn("a", (F.col("s_sum") * F.col("fe")).cast(TOTAL))

    def total(c: Column, name: str) -> Column:
        return F.sum(c.cast(TOTAL)).cast(TOTAL).alias(name)

    return j.groupBy(PLANT).agg(
        F.sum("n_rows").alias("n_employees"),
        total(F.col("s_sum"), "S"),
        total(F.col("s_sum") * F.col("ot"), "HE"),
        total(F.col("a"), "A"),
        total(F.col("a") * F.col("ot"), "B"),
        total(F.col("va_sum"), "V"),
        total(F.col("plr_sum"), "P"),
    )


def _r2(c: Column) -> Column:
    """Cents, as double; what exact arithmetic leaves beyond six places is not a tie."""
    return F.round(c.cast("decimal(28,6)"), 2).cast("double")


def _times(a: Column, b: Column) -> Column:
    return (a.cast(TOTAL) * b).cast(TOTAL)


def detail_columns() -> list[Column]:
    """The 4 totals and 16 details of a scenario, from the basis sums and the
    scenario factors ``k_s, k_va, k_plr, k_he`` (columns in scope)."""
    A, B, S, HE, V, P = (F.col(c) for c in ("A", "B", "S", "HE", "V", "P"))
    ks, kva, kplr, khe = (F.col(c) for c in ("k_s", "k_va", "k_plr", "k_he"))
    sal_cur = (A + B) * MONTHS
    sal_new = _times(A + _times(B, khe), ks) * MONTHS
    va_cur, va_new = V * MONTHS, _times(V, kva) * MONTHS
    plr_cur, plr_new = P, _times(P, kplr)
    cur = sal_cur + va_cur + plr_cur
    new = sal_new + va_new + plr_new
    return [
        _r2(cur).alias("current_cost"),
        _r2(new).alias("projected_cost"),
        _r2(new - cur).alias("impact"),
        _r2(sal_cur).alias("salary_charged_current_annual"),
        _r2(sal_new).alias("salary_charged_projected_annual"),
        _r2(va_cur).alias("va_current_annual"),
        _r2(va_new).alias("va_projected_annual"),
        _r2(plr_cur).alias("plr_current_annual"),
        _r2(plr_new).alias("plr_projected_annual"),
        _r2(S).alias("base_salary_current"),
        _r2(HE).alias("overtime_current"),
        F.lit(0.0).alias("dsr_current"),
        _r2(V).alias("va_current"),
        _r2(P).alias("plr_current"),
        _r2(_times(S, ks)).alias("base_salary_new"),
        _r2(_times(_times(HE, ks), khe)).alias("overtime_new"),
        F.lit(0.0).alias("dsr_projected"),
        _r2(_times(V, kva)).alias("va_new"),
        _r2(_times(P, kplr)).alias("plr_new"),
    ]


FACTORS = {"pct_salary": "k_s", "pct_va": "k_va", "pct_plr": "k_plr", "pct_overtime": "k_he"}


def _factors(prefix: str = "") -> list[Column]:
    return [(1 + F.col(prefix + c) / 100).cast("decimal(12,8)").alias(k) for c, k in FACTORS.items()]


def apply_scenarios(basis: DataFrame, scenarios: Sequence[Scenario] | Column) -> DataFrame:
    """Every plant × every scenario, from the per-plant basis.

    The scenarios are a parameter list exploded next to each plant row (a
    generator, no join); the rows produced are exactly the requested grid.  The
    plants are dealt out by key before the explode, to as many tasks as shuffle
    partitions: the few basis rows alone would be coalesced into one task.
    """
    arr = scenarios if isinstance(scenarios, Column) else scenarios_column(scenarios)
    n = int(basis.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = basis.repartition(n, PLANT).select("*", F.explode(arr).alias("sc"))
    x = x.select("*", *_factors("sc."))
    return x.select(F.col(PLANT), F.col("sc.scenario_id").alias("scenario_id"),
                    F.col("n_employees"), *detail_columns())


def scenario_costs(employees: DataFrame, rates: DataFrame, scenarios: Sequence[Scenario]) -> DataFrame:
    """Full result rows (4 totals + 16 details) for all plants and scenarios."""
    return apply_scenarios(cost_basis(employees, rates), scenarios)


def scenario_table_costs(employees: DataFrame, rates: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Scenarios as a table: each row names its plant (column ``planta``) and four
    percentages, and comes back with all its columns and the cost of its plant
    under them; a row whose plant has no employee with rates keeps null costs."""
    keep = scenarios.columns
    x = scenarios.select("*", *_factors()).join(cost_basis(employees, rates), PLANT, "left")
    return x.select(*keep, "n_employees", *detail_columns())


def current_costs(employees: DataFrame, rates: DataFrame) -> DataFrame:
    """Annual current cost per plant, split into charged salary, VA and PLR."""
    b = cost_basis(employees, rates)
    sal = (F.col("A") + F.col("B")) * MONTHS
    va = F.col("V") * MONTHS
    return b.select(
        PLANT, "n_employees",
        _r2(sal).alias("salary_charged_current_annual"),
        _r2(va).alias("va_current_annual"),
        _r2(F.col("P")).alias("plr_current_annual"),
        _r2(sal + va + F.col("P")).alias("current_cost"),
    )


class PlantNotFound(Exception):
    """The single-plant call found no employee with rates for the plant."""


def simulate_plant(employees: DataFrame, rates: DataFrame, plant, scenario: Scenario) -> DataFrame:
    """The one-plant, one-scenario call.  The plant filter is a plain equality
    on both inputs, so it reaches both parquet scans; raises
    :class:`PlantNotFound` when nothing matches (one row of each input is
    looked for, not the aggregate)."""
    e = employees.filter(F.col(PLANT) == F.lit(plant))
    r = rates.filter(F.col(PLANT) == F.lit(plant))
    out = scenario_costs(e, r, [scenario])
    if e.isEmpty() or r.isEmpty():
        raise PlantNotFound(f"plant {plant!r} not found or without data for simulation")
    return out


def budget_alert(costs: DataFrame, threshold_pct: float = 5.0) -> DataFrame:
    """Budget increase in % of current cost (0 when current ≤ 0) from the
    rounded totals, and the alert flag when it exceeds ``threshold_pct``."""
    cur, imp = F.col("current_cost"), F.col("impact")
    pct = F.when(cur > 0, imp / cur * 100).otherwise(F.lit(0.0))
    return costs.select(
        PLANT, "scenario_id", "current_cost", "impact",
        F.round(pct, 4).alias("budget_increase_pct"),
        (pct > threshold_pct).alias("alert"),
    )


def _figure(costs: DataFrame, name: str) -> Column:
    """A detail of a result row; 0 where it is null or the rows have no such column."""
    return F.coalesce(F.col(name), F.lit(0.0)) if name in costs.columns else F.lit(0.0)


def composition_annual(costs: DataFrame) -> DataFrame:
    """Annual composition rows Salary, Salary with charges, PLR, VA (rows are
    not additive: salary appears twice) with the incremental column; a figure
    that is missing counts as 0."""
    x = lambda name: _figure(costs, name)
    items = [
        ("Salary", x("base_salary_current") * MONTHS, x("base_salary_new") * MONTHS),
        ("Salary with charges", x("salary_charged_current_annual"), x("salary_charged_projected_annual")),
        ("PLR", x("plr_current_annual"), x("plr_projected_annual")),
        ("VA", x("va_current_annual"), x("va_projected_annual")),
    ]
    return _unpivot(costs, items)


def composition_monthly(costs: DataFrame) -> DataFrame:
    """Monthly-base composition rows Salary, PLR, VA; a figure that is missing counts as 0."""
    x = lambda name: _figure(costs, name)
    items = [
        ("Salary", x("base_salary_current"), x("base_salary_new")),
        ("PLR", x("plr_current"), x("plr_new")),
        ("VA", x("va_current"), x("va_new")),
    ]
    return _unpivot(costs, items)


def _unpivot(costs: DataFrame, items: Iterable[tuple[str, Column, Column]]) -> DataFrame:
    arr = F.array(*[
        F.struct(F.lit(i).alias("item_order"), F.lit(name).alias("item"),
                 cur.cast("double").alias("cur"), new.cast("double").alias("new"))
        for i, (name, cur, new) in enumerate(items)
    ])
    x = costs.select(PLANT, "scenario_id", F.explode(arr).alias("r"))
    return x.select(
        PLANT, "scenario_id", F.col("r.item_order").alias("item_order"), F.col("r.item").alias("item"),
        _r2(F.col("r.cur")).alias("current"),
        _r2(F.col("r.new")).alias("projected"),
        _r2(F.col("r.new").cast("decimal(28,6)") - F.col("r.cur").cast("decimal(28,6)")).alias("incremental"),
    )


def practice(employees: DataFrame) -> DataFrame:
    """Per-plant averages of salary, VA and PLR (nulls skipped) and head count."""
    return employees.groupBy(PLANT).agg(
        F.avg("salario_atual").alias("avg_salary"),
        F.avg("valor_va_atual").alias("avg_va"),
        F.avg("plr_alvo_atual").alias("avg_plr"),
        F.count(F.lit(1)).alias("n_employees"),
    )


def practice_of(employees: DataFrame, plant) -> DataFrame:
    """The one-plant form: a global aggregate, so a plant with no employee
    gives one row of null averages and count 0."""
    e = employees.filter(F.col(PLANT) == F.lit(plant))
    return e.agg(
        F.avg("salario_atual").alias("avg_salary"),
        F.avg("valor_va_atual").alias("avg_va"),
        F.avg("plr_alvo_atual").alias("avg_plr"),
        F.count(F.lit(1)).alias("n_employees"),
    )


def headcount_with_rates(employees: DataFrame, rates: DataFrame) -> DataFrame:
    """Head count and average salary over the employee × rate join, per plant."""
    emp = employees.groupBy(PLANT).agg(
        F.count(F.lit(1)).alias("n"), F.sum("salario_atual").alias("s"),
        F.count("salario_atual").alias("n_s"))
    rcount = rates.groupBy(PLANT).agg(F.count(F.lit(1)).alias("m"))
    j = emp.join(rcount, PLANT, "inner")
    return j.select(
        PLANT,
        (F.col("n") * F.col("m")).alias("total_employees"),
        (F.col("s") / F.col("n_s")).alias("avg_salary"),
    )


# --- deterministic pay rules of the data generator --------------------------------
# fixed values: base salary by job title, multiplier for plant G1, VA by plant,
# PLR-eligible titles.
BASE_SALARY = {"Operação": 2500.0, "Analista": 5500.0, "Especialista": 11000.0, "Supervisor": 9000.0}
MULTIPLIER_PLANT, PLANT_MULTIPLIER = "G1", 1.2
VA_PLANT, VA_SPECIAL, VA_DEFAULT = "G1", 1050.0, 700.0
PLR_ELIGIBLE = ("Operação", "Analista")


def derive_pay(staff: DataFrame, plant_dim: DataFrame) -> DataFrame:
    """Reference pay per employee from title and plant: base × plant
    multiplier, VA, fuel aid and PLR target from the plant row (0 when the
    title is not eligible).  Expressions only; the plant lookup is a join."""
    title = F.col("subgrupo_cargos")
    base = F.element_at(F.create_map(*[x for k, v in BASE_SALARY.items() for x in (F.lit(k), F.lit(v))]), title)
    mult = F.when(F.col(PLANT) == MULTIPLIER_PLANT, PLANT_MULTIPLIER).otherwise(1.0)
    eligible = title.isin(*PLR_ELIGIBLE)
    j = staff.join(first_per_key(plant_dim, PLANT, "line"), PLANT, "left")
    return j.select(
        "id_funcionario", PLANT, "subgrupo_cargos",
        F.round(base * mult, 2).alias("base_salary_ref"),
        F.when(F.col(PLANT) == VA_PLANT, VA_SPECIAL).otherwise(VA_DEFAULT).alias("va"),
        F.col("ajuda_combustivel_planta").alias("fuel_aid"),
        eligible.alias("plr_eligible"),
        F.when(eligible, F.col("plr_alvo_planta")).otherwise(F.lit(0.0)).alias("plr_target"),
    )


def first_per_key(dim: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the row with the smallest ``order`` value (the first
    line of the file), as ``min_by`` over a struct of the other columns."""
    others = [c for c in dim.columns if c not in (key, order)]
    agg = dim.groupBy(key).agg(F.min_by(F.struct(*others), F.col(order)).alias("r"))
    return agg.select(key, *[F.col(f"r.{c}").alias(c) for c in others])
