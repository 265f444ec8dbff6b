"""Delimited sources, market parsing, load reports and the SQL surface."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from paygrid.operators import market as mk
from paygrid.functions import numbers as nu
from paygrid.operators.sql import MISSING_TABLE, OTHER, SYNTAX, QueryError, query_rows, run_sql
from paygrid.sources import delimited as dl


def test_split_fields_pandas_skip_rule(spark):
    lines = spark.createDataFrame([(1, "a;b;c"), (2, "a;b"), (3, "a;b;c;d"), (4, "a;;c")], "id int, value string")
    got = {r.id: tuple(r)[1:] for r in dl.split_fields(lines, ";", ["x", "y", "z"]).collect()}
    assert got == {1: ("a", "b", "c"), 2: ("a", "b", None), 4: ("a", None, "c")}


def test_market_records_quoted_whole(spark):
    rows = ['"G1 ;Acme;North;5.5%;R$ 1.200,00;R$ 28.000,00;2025-01;Foco"',
            '"G2;Umbra;South;x%;R$ abc;R$ 22.000,00;2025-13;""Clausula"" a"']
    m = mk.parse_market(spark.createDataFrame([(r,) for r in rows], "value string")).collect()
    g1 = [r for r in m if r.Filial == "G1"][0]
    assert (g1.Reajuste_Praticado, g1.VA_Valor, g1.PLR_Referencia, str(g1.Data_Acordo)) == (5.5, 1200.0, 28000.0, "2025-01-01")
    g2 = [r for r in m if r.Filial == "G2"][0]
    assert g2.Principais_Clausulas == '"Clausula" a'
    assert g2.Reajuste_Praticado is None and g2.VA_Valor is None and g2.Data_Acordo is None


def test_benchmark_status_no_data(spark):
    market = mk.parse_market(spark.createDataFrame([('"G1;A;R;5%;R$ 1,00;R$ 2,00;2025-01;c"',)], "value string"))
    plants = spark.createDataFrame([("g1",), ("G6",)], "plant string")
    got = {r.plant: r.status for r in mk.benchmark_status(plants, market).collect()}
    assert got == {"g1": "ok", "G6": "no_data"}


def test_files_load_report_and_separator(spark):
    d = tempfile.mkdtemp(prefix="paygrid-test-")
    semi = os.path.join(d, "semi.csv")
    with open(semi, "w", encoding="utf-8-sig") as f:
        f.write('Planta;Sinonimos\nG1;"a, b"\n')
    assert dl.detect_separator(spark, semi) == ";"
    tables, report = dl.load_set(spark, {semi: "sinonimos", os.path.join(d, "missing.csv"): "x"})
    status = {r.table: r.status for r in report.collect()}
    assert status == {"sinonimos": "loaded", "x": "missing"}
    assert tables["sinonimos"].columns == ["Planta", "Sinonimos"]
    with pytest.raises(FileNotFoundError):
        dl.load_strict(spark, os.path.join(d, "missing.csv"))
    out = os.path.join(d, "out")
    dl.write_csv(tables["sinonimos"], out)
    assert spark.read.option("header", True).csv(out).count() == 1


def test_sql_parameters_and_error_classes(spark):
    t = spark.createDataFrame([("G1", 10.0), ("G2", 20.0)], "planta string, s double")
    r = run_sql(spark, "SELECT planta FROM hc WHERE s > :m", {"hc": t}, {"m": 15.0}).collect()
    assert [x.planta for x in r] == ["G2"]
    with pytest.raises(QueryError) as e:
        run_sql(spark, "SELECT * FROM no_such_table_xyz")
    assert e.value.kind == MISSING_TABLE
    with pytest.raises(QueryError) as e:
        run_sql(spark, "SELECT * FROM (")
    assert e.value.kind == SYNTAX
    with pytest.raises(QueryError):
        run_sql(spark, "DROP TABLE hc")
    _ = F


def test_split_fields_with_quoted_separator(spark):
    lines = spark.createDataFrame([(1, 'G1;"a;b";c'), (2, '"x ""y""";;""')], "id int, value string")
    got = {r.id: tuple(r)[1:] for r in dl.split_fields(lines, ";", ["x", "y", "z"]).collect()}
    assert got == {1: ("G1", "a;b", "c"), 2: ('x "y"', None, None)}


def test_strict_numbers(spark):
    texts = ["R$ 1.200,00", "R$ 1200.50", "1200,5", "R$ 12.00,0", "5d", "-3,25"]
    got = [r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select(nu.parse_brl("t").alias("v")).collect()]
    assert got == [1200.0, None, 1200.5, None, None, -3.25]
    pct = [r.v for r in spark.createDataFrame([("5.5%",), ("5d",), ("7 %",), ("x",)], "t string").select(nu.parse_percent("t").alias("v")).collect()]
    assert pct == [5.5, None, 7.0, None]
    js = spark.createDataFrame([('{"reajuste_va": "5d", "reajuste_plr": 2}',)], "t string").select(nu.json_params("t").alias("v")).first().v
    assert tuple(js) == (0.0, 0.0, 0.0, 0.0)


def test_market_row_without_leading_fields_is_data(spark):
    market = mk.parse_market(spark.createDataFrame([('"G1;;;5.5%;a combinar;R$ 1,00;2025-01;c"',)], "value string"))
    row = mk.benchmark_status(spark.createDataFrame([("G1",)], "plant string"), market).first()
    assert row.status == "ok" and row.Reajuste_Praticado == 5.5


def test_gap_verdict_edges(spark):
    market = spark.createDataFrame([("G1", 100.0, None)], "Filial string, VA_Valor double, PLR_Referencia double")
    own = spark.createDataFrame([("g1", v, 1.0, 1) for v in (101.0, 101.01, 98.99, None)], "plant string, avg_va double, avg_plr double, n_employees int")
    assert [r.verdict_va for r in mk.benchmark_gap(own, market).collect()] == ["at", "above", "below", "no_data"]


def test_record_file_keeps_lines_equal_to_the_header(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="paygrid-test-"), "rec.csv")
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write('"a;b"\n"1;2"\n"a;b"\n')
    assert [tuple(r) for r in dl.read_record_quoted(spark, path).collect()] == [("1", "2"), ("a", "b")]


def test_rename_first_and_publish(spark):
    df = dl.rename_first(spark.createDataFrame([(1, 2)], "x int, y int"), "Filial")
    dl.publish(df, "published_t")
    dl.publish(df.union(df), "published_t")
    assert df.columns == ["Filial", "y"] and spark.table("published_t").count() == 2


WRITES = ["WITH a AS (SELECT 1 AS x) INSERT INTO dst SELECT x FROM a", "FROM hc INSERT INTO dst SELECT s", "CREATE TABLE dst AS SELECT 1",
          "DROP TABLE hc", "TRUNCATE TABLE hc", "SET x=1"]


@pytest.mark.parametrize("text", WRITES)
def test_sql_refuses_writes(spark, text):
    with pytest.raises(QueryError) as e:
        run_sql(spark, text, {"hc": spark.range(1).withColumnRenamed("id", "s")})
    assert e.value.kind == SYNTAX


def test_sql_comments_run_time_errors_and_views(spark):
    spark.range(7).createOrReplaceTempView("mine")
    assert query_rows(spark, "-- note\nSELECT count(*) AS n FROM mine", {"mine": spark.range(3)})[0].n == 3
    assert spark.table("mine").count() == 7
    with pytest.raises(QueryError) as e:
        query_rows(spark, "SELECT 1 / CAST(id AS INT) FROM range(1)")
    assert e.value.kind == OTHER


@pytest.mark.parametrize("line,want", [
    ('a;b "x;c', ("a", 'b "x', "c")), ('"ab"c;d', ("abc", "d", None)), ('"a;b', ("a;b", None, None)), ("", (None, None, None)),
    (";;", (None, None, None)), ('"";"""";x', (None, '"', "x")), ('a"b";"c;""d"""', ('a"b"', 'c;"d"', None)), ('"x";y;"z"', ("x", "y", "z")),
    ("a;b;c;", None), ('"a;b";c;d;e', None), ("é;日本;\t", ("é", "日本", "\t")),
])
def test_field_states(spark, line, want):
    got = [tuple(r) for r in dl.split_fields(spark.createDataFrame([(line,)], "value string"), ";", ["x", "y", "z"]).collect()]
    assert got == ([want] if want is not None else [])


def test_fields_like_the_csv_module(spark):
    """Random records, quoted where they need it: the fields that were written come back."""
    import csv
    import io
    import random

    rng = random.Random(5)
    rows = [["".join(rng.choices('ab ;",é', k=rng.randint(0, 6))) for _ in range(rng.randint(1, 5))] for _ in range(300)]
    lines = []
    for r in rows:
        f = io.StringIO()
        csv.writer(f, delimiter=";", lineterminator="").writerow(r)
        lines.append(f.getvalue())
    df = spark.createDataFrame(list(enumerate(lines)), "id int, value string")
    got = {r.id: list(r)[1:] for r in dl.split_fields(df, ";", [f"c{i}" for i in range(5)]).collect()}
    assert got == {i: [x or None for x in r] + [None] * (5 - len(r)) for i, r in enumerate(rows)}


def test_records_of_many_and_long_quoted_fields(spark):
    many = ";".join(['"a;""b"""'] * 100_000)
    long = '"' + 'x""' * 500_000 + '";end'
    df = spark.createDataFrame([(1, many), (2, long), (3, '"' * 99_999), (4, "a;b")], "id int, value string")
    assert dl.parse_fields(df, ";", ["x"]).filter("id = 1").first()["_n"] == 100_000
    got = {r.id: r for r in dl.split_fields(df, ";", ["x", "y"]).collect()}
    assert set(got) == {2, 3, 4} and got[2].x == 'x"' * 500_000 and got[2].y == "end" and got[3].x == '"' * 49_999


def test_load_report_of_a_full_pass(spark, tmp_path):
    import gzip

    good, typed, cut = tmp_path / "good.csv", tmp_path / "typed.csv", tmp_path / "cut.csv.gz"
    good.write_text("a,b\n" + "1,2\n" * 1000)
    typed.write_text("a;b\n" + "1;x\n" * 5000 + "late;y\n2;z;more\n3\n")
    cut.write_bytes(gzip.compress(("a,b\n" + "".join(f"{i},{i * 7919 % 10007}\n" for i in range(200_000))).encode())[:-2000])
    loaders = {str(typed): lambda s, p: dl.load_checked(s, p, "a int, b string"),
               str(cut): lambda s, p: dl.load_delimited(s, p, schema="a int, b int", sep=",")}
    found = dl.load_set(spark, {str(good): "good", str(typed): "typed", str(cut): "cut"}, lambda s, p: loaders.get(p, dl.load_delimited)(s, p))
    tables, report = found
    rows = {r.table: r for r in report.collect()}
    assert (rows["good"].status, rows["good"].n_rows, rows["good"].n_rejected) == ("loaded", 1000, 0)
    assert (rows["typed"].status, rows["typed"].n_rows, rows["typed"].n_rejected) == ("loaded", 5001, 2)
    assert tables["typed"].columns == ["a", "b"] and tables["typed"].filter("a = 3 AND b IS NULL").count() == 1
    assert {(r["_line"], r["_reason"]) for r in found.rejects["typed"].collect()} == {("late;y", "a is not int"), ("2;z;more", "too many fields")}
    assert rows["cut"].status == "failed" and rows["cut"].error and "cut" not in tables       # the failure is beyond the first rows


REACHES = [
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT java_method('java.lang.System', 'nanoTime') FROM hc",
    "SELECT * FROM hc WHERE s IN (SELECT length(reflect('java.lang.System', 'getProperty', 'user.home')))",
    "WITH a AS (SELECT reflect('java.util.UUID', 'randomUUID') AS x) SELECT * FROM a", "SELECT system.builtin.reflect('java.util.UUID', 'randomUUID')",
    "SELECT count(*) FROM hc GROUP BY s HAVING max(try_reflect('java.util.UUID', 'randomUUID')) > ''", "SELECT input_file_name() FROM hc",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`", "SELECT * FROM text.`/etc/hostname`",
    "SELECT (SELECT count(*) FROM text.`/etc/hostname`) FROM hc", "SELECT * FROM hc WHERE EXISTS (SELECT 1 FROM csv.`/etc/hostname`)",
    "SELECT * FROM not_given", "SELECT TRANSFORM (s) USING 'cat' AS (x) FROM hc",
]


@pytest.mark.parametrize("text", REACHES)
def test_sql_reaches_only_its_tables(spark, text):
    spark.read.parquet("/root/testdata/sf0.001/nation.parquet").createOrReplaceTempView("not_given")
    with pytest.raises(QueryError) as e:
        run_sql(spark, text, {"hc": spark.range(1).withColumnRenamed("id", "s")})
    assert e.value.kind in (SYNTAX, MISSING_TABLE)


READS = [
    ("SELECT max(s) AS x FROM hc", 4), ("WITH a AS (SELECT s FROM hc) SELECT sum(a.s + b.s) AS x FROM a JOIN a AS b USING (s)", 20),
    ("SELECT (SELECT count(*) FROM hc) AS x FROM range(1)", 5), ("SELECT count(*) AS x FROM hc AS a, hc AS b WHERE a.s < b.s", 10),
    ("SELECT sum(e) AS x FROM (SELECT explode(array(s, s)) AS e FROM hc)", 20), ("SELECT count(*) AS x FROM hc LATERAL VIEW explode(array(1, 2)) t AS y", 10),
    ("SELECT sum(r) AS x FROM (SELECT row_number() OVER (ORDER BY s DESC) AS r FROM hc)", 15), ("SELECT x FROM VALUES (7) AS t(x)", 7),
    ("SELECT size(filter(collect_list(s), v -> v > 1)) AS x FROM hc WHERE s IN (SELECT s FROM hc WHERE s < 4)", 2),
]


@pytest.mark.parametrize("text,want", READS)
def test_sql_reads(spark, text, want):
    assert run_sql(spark, text, {"hc": spark.range(5).withColumnRenamed("id", "s")}).first().x == want


def test_sql_over_the_session_tables(spark):
    spark.range(6).createOrReplaceTempView("of_session")
    assert run_sql(spark, "SELECT count(*) AS n FROM of_session").first().n == 6
    with pytest.raises(QueryError):
        run_sql(spark, "SELECT * FROM text.`/etc/hostname`")
