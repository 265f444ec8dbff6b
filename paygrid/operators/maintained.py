"""Per-plant sums kept up to date load by load.

The stored table has a row per load and plant: counts and exact sums of the
employee columns.  A load that arrives again replaces its own rows, a load that
is taken back leaves without a trace, and no other load's employees are read
again.  Costs and averages need only the sums over the loads, which equal those
of one pass over all employees because decimals add up exactly.

The table is stored bucketed by plant, so the sum over loads, and its join with
rates stored the same way, run without a shuffle.  It is written anew with each
change: plants times loads rows, whatever the number of employees.
:func:`settle` folds loads that will not change any more into one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.stored import store
from . import payroll as pay

LOAD = "load_id"      # null: loads that were settled
AMOUNTS = {"salario_atual": ("s", "avg_salary"), "valor_va_atual": ("va", "avg_va"), "plr_alvo_atual": ("plr", "avg_plr")}
SUMS = ["n_rows", *[f"{short}_{part}" for short, _ in AMOUNTS.values() for part in ("sum", "n", "nan")]]


def load_sums(employees: DataFrame, load: Column) -> DataFrame:
    """``load_id, planta`` and the SUMS of each; a null load is the load ``""``."""
    x = employees.select(F.coalesce(load.cast("string"), F.lit("")).alias(LOAD), pay.PLANT, *AMOUNTS)
    kinds = []
    for col, (short, _) in AMOUNTS.items():
        c = F.col(col).cast("double")
        kinds += [F.count(c).alias(f"{short}_n"), F.count(F.when(F.isnan(c), 1)).alias(f"{short}_nan")]
    return x.groupBy(LOAD, pay.PLANT).agg(*pay.amount_sums(), *kinds).select(LOAD, pay.PLANT, *SUMS)


def _total(rows: DataFrame, *by: str) -> DataFrame:
    """SUMS of ``rows`` by ``by``."""
    sums = [F.sum(c).cast(pay.AMOUNT if c.endswith("_sum") else "bigint").alias(c) for c in SUMS]
    return rows.groupBy(*by).agg(*sums)


def add(spark: SparkSession, name: str, employees: DataFrame, load: str | Column, buckets: int | None = None) -> DataFrame:
    """Put loads into the stored table ``name``, each in place of an earlier load of its id.

    ``load`` is the id of the one load that ``employees`` is (without rows: the
    load becomes empty), or the column that tells each row's load.  An infinite
    amount is an error and leaves the table as it was."""
    path = scratch_path(spark, "load-sums")
    load_sums(employees, F.lit(load) if isinstance(load, str) else load).write.parquet(path)
    new = rows = spark.read.parquet(path)
    if spark.catalog.tableExists(name):
        old = spark.table(name)
        if isinstance(load, str):
            kept = old.filter(~F.col(LOAD).eqNullSafe(F.lit(load)))
        else:
            kept = old.join(new.select(LOAD).distinct(), LOAD, "left_anti").select(*old.columns)
        rows = kept.unionByName(new)
    return store(rows, name, [pay.PLANT], buckets)


def retract(spark: SparkSession, name: str, loads: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Take loads back; one that is not there, or is settled, changes nothing."""
    gone = F.coalesce(F.col(LOAD).isin(*loads), F.lit(False))
    return store(spark.table(name).filter(~gone), name, [pay.PLANT], buckets)


def settle(spark: SparkSession, name: str, loads: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Fold loads into the settled one: they count for good, and take one row a plant together."""
    x = spark.table(name).withColumn(LOAD, F.when(~F.coalesce(F.col(LOAD).isin(*loads), F.lit(False)), F.col(LOAD)))
    return store(_total(x, LOAD, pay.PLANT), name, [pay.PLANT], buckets)


def sums(spark: SparkSession, name: str) -> DataFrame:
    """Per plant, the sums over all loads."""
    return _total(spark.table(name), pay.PLANT)


def cost_basis(spark: SparkSession, name: str, rates: DataFrame) -> DataFrame:
    """:func:`payroll.cost_basis` of all loads' employees."""
    return pay.basis_of_sums(sums(spark, name).select(pay.PLANT, "n_rows", "s_sum", "va_sum", "plr_sum"), rates)


def scenario_costs(spark: SparkSession, name: str, rates: DataFrame, scenarios: Sequence[pay.Scenario]) -> DataFrame:
    """:func:`payroll.scenario_costs` of all loads' employees."""
    return pay.apply_scenarios(cost_basis(spark, name, rates), scenarios)


def practice(spark: SparkSession, name: str) -> DataFrame:
    """:func:`payroll.practice` of all loads' employees: averages skip nulls, a NaN
    makes its average NaN, and amounts count with six places."""
    x = sums(spark, name)
    mean = lambda s: F.when(F.col(f"{s}_nan") > 0, F.lit(float("nan"))) \
        .when(F.col(f"{s}_n") > 0, F.col(f"{s}_sum").cast("double") / F.col(f"{s}_n"))
    return x.select(pay.PLANT, *[mean(short).alias(out) for short, out in AMOUNTS.values()], F.col("n_rows").alias("n_employees"))
