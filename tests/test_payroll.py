"""Payroll: the per-plant linear plan against the reference's per-employee
cascade, null and join semantics, scenarios, alerts and composition rows."""

import pytest
from pyspark.sql import functions as F

from paygrid.operators import payroll as pay

EMP = "planta string, salario_atual double, valor_va_atual double, plr_alvo_atual double"
RATES = ("planta string, rat_fap double, perc_he_medio double, fgts double, provisao_ferias double, "
         "provisao_13 double, inss_patronal double, terceiros double")
R1 = (0.02, 0.15, 0.08, 0.1111, 0.0833, 0.2, 0.06)
R2 = (0.03, 0.10, 0.08, 0.1111, 0.0833, 0.2, 0.06)


def cascade(rows, rates, pct):
    """The reference's loop, per employee × rate row (nulls as 0)."""
    ps, pva, pplr, phe = pct
    tot = dict(cur=0.0, new=0.0, n=0)
    for plant, s, va, plr in rows:
        for r in [r for r in rates if r[0] == plant]:
            rat, he, fgts, pf, p13, inss, ter = [x or 0.0 for x in r[1:]]
            s, va, plr = s or 0.0, va or 0.0, plr or 0.0
            f, e = 1 + pf + p13, 1 + rat + fgts + inss + ter
            cur = (s + he * s * 1.2) * f * e
            sn, hen = s * (1 + ps / 100), he * (1 + phe / 100)
            new = (sn + hen * sn * 1.2) * f * e
            tot["cur"] += cur * 12 + va * 12 + plr
            tot["new"] += new * 12 + va * (1 + pva / 100) * 12 + plr * (1 + pplr / 100)
            tot["n"] += 1
    return tot


@pytest.fixture(scope="module")
def data(spark):
    rows = [("G1", 2500.10, 700.0, 1233.0), ("G1", 5500.55, 700.0, 0.0), ("G1", None, None, 100.0),
            ("G2", 3000.0, 700.0, 1100.0), ("G9", 9999.0, 1.0, 1.0), ("g1", 1000.0, 1.0, 1.0)]
    rates = [("G1",) + R1, ("G2",) + R2, ("G2",) + R2]          # duplicate rate row for G2
    return rows, rates, spark.createDataFrame(rows, EMP), spark.createDataFrame(rates, RATES)


@pytest.mark.parametrize("pct", [(5.0, 10.0, 15.0, 0.0), (0.0, 0.0, 0.0, 10.0), (5.0, 5.0, 5.0, 5.0)])
def test_linear_plan_equals_cascade(data, pct):
    rows, rates, e, r = data
    out = {x.planta: x for x in pay.scenario_costs(e, r, [pay.Scenario("s", *pct)]).collect()}
    assert set(out) == {"G1", "G2"}                       # G9 and lower-case g1 have no rates
    for plant in ("G1", "G2"):
        want = cascade([x for x in rows if x[0] == plant], rates, pct)
        assert out[plant].n_employees == want["n"]
        assert out[plant].current_cost == pytest.approx(want["cur"], abs=0.011)
        assert out[plant].projected_cost == pytest.approx(want["new"], abs=0.011)


def test_zero_scenario_has_zero_impact(data):
    _, _, e, r = data
    for x in pay.scenario_costs(e, r, [pay.Scenario("base")]).collect():
        assert x.impact == 0.0 and x.current_cost == x.projected_cost


def test_duplicate_rate_rows_multiply(data):
    _, _, e, r = data
    g2 = [x for x in pay.scenario_costs(e, r, [pay.Scenario("base")]).collect() if x.planta == "G2"][0]
    assert g2.n_employees == 2 and g2.base_salary_current == 6000.0


def test_null_rate_counts_as_zero(spark):
    e = spark.createDataFrame([("G1", 1000.0, 0.0, 0.0)], EMP)
    r = spark.createDataFrame([("G1", None, None, None, None, None, None, None)], RATES)
    x = pay.scenario_costs(e, r, [pay.Scenario("base")]).first()
    assert x.current_cost == 12000.0 and x.dsr_current == 0.0


def test_va_plr_linear_and_uncharged(spark):
    e = spark.createDataFrame([("G1", 0.0, 100.0, 1000.0)], EMP)
    r = spark.createDataFrame([("G1",) + R1], RATES)
    x = pay.scenario_costs(e, r, [pay.Scenario("s", 0, 10, 20, 0)]).first()
    assert x.va_projected_annual == pytest.approx(1320.0) and x.plr_projected_annual == pytest.approx(1200.0)
    assert x.impact == pytest.approx(120.0 + 200.0)


def test_grid_equals_single_scenarios(data):
    _, _, e, r = data
    sc = pay.rule_scenarios(25)
    grid = {(x.planta, x.scenario_id): x.projected_cost for x in pay.scenario_costs(e, r, sc).collect()}
    for s in sc[::6]:
        one = {x.planta: x.projected_cost for x in pay.scenario_costs(e, r, [s]).collect()}
        for p, v in one.items():
            assert grid[(p, s.scenario_id)] == v


def test_single_plant_call_and_missing_plant(data):
    _, _, e, r = data
    assert pay.simulate_plant(e, r, "G1", pay.Scenario("s", 5)).count() == 1
    with pytest.raises(pay.PlantNotFound):
        pay.simulate_plant(e, r, "G7", pay.Scenario("s", 5))


def test_budget_alert_and_composition(data):
    _, _, e, r = data
    costs = pay.scenario_costs(e, r, [pay.Scenario("s", 10.0)])
    alerts = {x.planta: x for x in pay.budget_alert(costs).collect()}
    assert all(a.alert for a in alerts.values())
    comp = pay.composition_annual(costs).filter(F.col("planta") == "G1").orderBy("item_order").collect()
    assert [c.item for c in comp] == ["Salary", "Salary with charges", "PLR", "VA"]
    monthly = pay.composition_monthly(costs).filter(F.col("planta") == "G1").collect()
    assert len(monthly) == 3


def test_practice_empty_plant_gives_null_row(data):
    _, _, e, _ = data
    x = pay.practice_of(e, "nope").collect()
    assert len(x) == 1 and x[0].n_employees == 0 and x[0].avg_salary is None


def test_amounts_are_not_rounded_before_the_sum(spark):
    rows = [("G1", 1000.004, 0.004, 0.0)] * 1000 + [("G1", float("nan"), float("nan"), None)]
    out = pay.scenario_costs(spark.createDataFrame(rows, EMP), spark.createDataFrame([("G1",) + R1], RATES), [pay.Scenario("s")]).first()
    want = cascade([r for r in rows if r[1] == r[1]], [("G1",) + R1], (0, 0, 0, 0))
    assert out.base_salary_current == 1000004.0 and out.va_current == 4.0 and out.n_employees == 1001
    assert out.current_cost == pytest.approx(want["cur"], abs=0.006)


def test_nan_rates_count_as_zero(spark):
    rates = spark.createDataFrame([("G1", float("nan")) + R1[1:]], RATES)
    zero = spark.createDataFrame([("G1", 0.0) + R1[1:]], RATES)
    e = spark.createDataFrame([("G1", 1000.0, 1.0, 1.0)], EMP)
    assert pay.current_costs(e, rates).collect() == pay.current_costs(e, zero).collect()


def test_scenario_table(data):
    _, _, e, r = data
    spark = e.sparkSession
    asked = spark.createDataFrame([(1, "G1", 5.0, 10.0, 15.0, 0.0), (2, "G2", 0.0, 0.0, 0.0, 0.0), (3, "zz", 1.0, 1.0, 1.0, 1.0)],
                                  "msg int, planta string, pct_salary double, pct_va double, pct_plr double, pct_overtime double")
    got = {x.msg: x for x in pay.scenario_table_costs(e, r, asked).collect()}
    want = {x.planta: x for x in pay.scenario_costs(e, r, [pay.Scenario("s", 5.0, 10.0, 15.0, 0.0)]).collect()}
    assert got[1].projected_cost == want["G1"].projected_cost and got[2].impact == 0.0 and got[3].projected_cost is None


def test_rates_keep_twelve_places(spark):
    """Provisions of 1/12 and 0.1111111111, against exact fractions."""
    from fractions import Fraction

    rates = [("G1", 0.02, 0.15, 0.08, 0.1111111111, 1 / 12, 0.2, 0.06), ("G2", 0.0, 0.0, 0.0, 1000.0, 0.0, 0.0, 0.0)]
    emp = [("G1", 10_000_000.0 + i, 0.0, 0.0) for i in range(10)] + [("G2", 1.0, 0.0, 0.0)]
    got = {r.planta: r.current_cost for r in pay.current_costs(spark.createDataFrame(emp, EMP), spark.createDataFrame(rates, RATES)).collect()}
    rat, he, fgts, pf, p13, inss, ter = (Fraction(str(x)) if x != 1 / 12 else Fraction(1, 12) for x in rates[0][1:])
    f, e = 1 + pf + p13, 1 + rat + fgts + inss + ter
    want = sum(Fraction(int(s)) * (1 + he * Fraction("1.2")) * f * e * 12 for p, s, _, _ in emp if p == "G1")
    assert abs(got["G1"] - float(want)) < 0.011 and got["G2"] == 1001 * 12


def test_an_infinite_amount_is_an_error(spark):
    emp = spark.createDataFrame([("G1", float("inf"), 0.0, 0.0)], EMP)
    with pytest.raises(Exception, match="salario_atual is infinite"):
        pay.current_costs(emp, spark.createDataFrame([("G1",) + R1], RATES)).collect()


def test_missing_figures_count_as_zero(data):
    _, _, e, r = data
    costs = pay.scenario_costs(e, r, [pay.Scenario("s", 5.0, 0.0, 0.0, 0.0)])
    full = {(x.planta, x.item): x for x in pay.composition_annual(costs).collect()}
    short = {(x.planta, x.item): x for x in pay.composition_annual(costs.drop("plr_new", "plr_projected_annual", "plr_current_annual")).collect()}
    assert all((x.current, x.projected, x.incremental) == (0.0, 0.0, 0.0) for k, x in short.items() if k[1] == "PLR")
    assert {k: x for k, x in short.items() if k[1] != "PLR"} == {k: x for k, x in full.items() if k[1] != "PLR"}
    empty = costs.withColumn("va_new", F.lit(None).cast("double")).withColumn("va_current", F.lit(None).cast("double"))
    assert all(x.current == x.projected == 0.0 for x in pay.composition_monthly(empty).collect() if x.item == "VA")
