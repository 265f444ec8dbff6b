"""Sums kept per load: equal to a full pass after additions, repeats and removals."""

import random

import pytest
from pyspark.sql import functions as F

from paygrid.operators import maintained as mt
from paygrid.operators import payroll as pay
from paygrid.sources import stored

SCHEMA = "planta string, salario_atual double, valor_va_atual double, plr_alvo_atual double, load string, planta2 string"
SCENARIOS = pay.rule_scenarios(5)


def rows_of(load, n, seed):
    r = random.Random(seed)
    some = lambda top: None if r.random() < 0.2 else round(r.uniform(0, top), 2)
    # Half of all rows are one plant's.
    return [("G1" if r.random() < 0.5 else r.choice(["G2", "G3", None]), some(9000), some(800), some(3000), load, "x") for _ in range(n)]


@pytest.fixture
def rates(spark):
    cols = ", ".join(f"{c} double" for c in pay.RATE_COLUMNS)
    return spark.createDataFrame([("G1", *[0.1] * 7), ("G2", *[0.2] * 7), ("G2", None, *[0.05] * 6)], f"planta string, {cols}")


@pytest.fixture
def name(spark):
    yield "mt_sums"
    stored.forget(spark, "mt_sums")


def same(spark, name, rows, rates):
    emp = spark.createDataFrame(rows, SCHEMA)
    assert sorted(mt.scenario_costs(spark, name, rates, SCENARIOS).collect()) == sorted(pay.scenario_costs(emp, rates, SCENARIOS).collect())
    key = lambda r: str(r.planta)
    got, want = sorted(mt.practice(spark, name).collect(), key=key), sorted(pay.practice(emp).collect(), key=key)
    assert [(r.planta, r.n_employees) for r in got] == [(r.planta, r.n_employees) for r in want]
    for g, w in zip(got, want):
        assert list(g)[1:4] == pytest.approx(list(w)[1:4], nan_ok=True)


def test_equal_to_a_full_pass(spark, name, rates):
    a, b, c = rows_of("a", 60, 1), rows_of("b", 40, 2), rows_of(None, 30, 3)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    mt.add(spark, name, frame(a + c), F.col("load"), 4)
    mt.add(spark, name, frame(b), "b", 4)
    same(spark, name, a + b + c, rates)
    mt.add(spark, name, frame(b), "b", 4)                    # replayed
    mt.add(spark, name, frame(c), F.col("load"), 4)          # a null load is replaced by itself
    same(spark, name, a + b + c, rates)
    a2 = rows_of("a", 10, 4)                                 # a corrected load, with other plants
    mt.add(spark, name, frame(a2), F.col("load"), 4)
    same(spark, name, a2 + b + c, rates)
    mt.retract(spark, name, ["b", "never"], 4)
    same(spark, name, a2 + c, rates)
    mt.settle(spark, name, ["a"], 4)
    mt.retract(spark, name, ["a"], 4)                        # settled: stays
    same(spark, name, a2 + c, rates)
    assert spark.table(name).filter("load_id IS NULL").count() == len({r[0] for r in a2})
    mt.add(spark, name, frame(a), "a", 4)                    # a new load beside the settled one
    same(spark, name, a + a2 + c, rates)
    mt.add(spark, name, frame([]), "a", 4)                   # empty now
    same(spark, name, a2 + c, rates)


def test_nan_counts_as_in_a_full_pass_and_infinity_changes_nothing(spark, name, rates):
    rows = [("G1", float("nan"), 1.0, None, "a", "x"), ("G1", 5.0, 2.0, None, "a", "x"), ("G2", None, None, None, "a", "x")]
    mt.add(spark, name, spark.createDataFrame(rows, SCHEMA), "a", 4)
    same(spark, name, rows, rates)
    with pytest.raises(Exception, match="salario_atual is infinite"):
        mt.add(spark, name, spark.createDataFrame([("G1", float("inf"), 1.0, 1.0, "b", "x")], SCHEMA), "b", 4)
    same(spark, name, rows, rates)


def test_no_shuffle_from_sums_to_costs(spark, name, rates):
    mt.add(spark, name, spark.createDataFrame(rows_of("a", 20, 1), SCHEMA), "a", 4)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        stored_rates = stored.store(rates, "mt_rates", ["planta"], 4)
        plan = mt.cost_basis(spark, name, stored_rates)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        stored.forget(spark, "mt_rates")
