"""Work by package stays where the rows lie, and gives what it did."""

import datetime as dt

from pyspark.sql import functions as F

from dossier.functions import text as fn
from dossier.operators import compare, merge
from dossier.plans import compare_checks, match_checks, registry

SF = "/root/testdata/sf0.001"


def shuffles(df, name):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return [line for line in plan.splitlines() if "Exchange hashpartitioning(" + name in line and "REPARTITION_BY_NUM" not in line]


def test_dates_are_read_without_a_reader_that_fails(spark):
    t = "29.02.2023 29.02.2024 2024-13-01 2024-04-31 1 мая 2024 31 июня 2024 30.06.0000 00.01.2024 31.12.9999"
    got = spark.createDataFrame([(t,), ("",), (None,)], "t string").select(fn.extract_dates(F.col("t")).cast("array<string>").alias("d"))
    assert [r.d for r in got.collect()] == [["2024-02-29", "2024-05-01", "0000-06-30", "9999-12-31"], [], None]
    assert "gettimestamp" not in got._jdf.queryExecution().optimizedPlan().toString()
    one = spark.createDataFrame([("05.06.2024",)], "t string").select(fn.extract_dates(F.col("t")).alias("d")).first()
    assert one.d == [dt.date(2024, 6, 5)]


def test_tables_of_several_slices_are_dealt_whatever_the_session_has(spark, monkeypatch):
    monkeypatch.setattr(registry, "SLICE_ROWS", 3000)
    assert registry.sliced(spark, 3000) is None and registry.sliced(spark, 3001) == spark.sparkContext.defaultParallelism
    assert registry.sliced(spark, 3000 * 50) == 50


def test_unexpected_codes_of_dealt_rows(spark):
    codes = spark.createDataFrame([(1, "01.02.03"), (1, "01.02.03"), (1, "01.20"), (1, None), (2, "01.02"), (None, "01"), (3, "5."), (3, ".5"), (4, "7..8")], "pk int, code string").repartition(7, "pk")
    explained = spark.createDataFrame([(1, "01.02"), (1, None), (2, "01.0"), (None, "01"), (3, ""), (4, "7.")], "pk int, code string").repartition(7, "pk")
    got = compare.unexpected_codes(codes, explained)
    assert {(r.pk, r.code) for r in got.collect()} == {(1, "01.20"), (1, None), (2, "01.02"), (None, "01"), (3, "5.")}
    assert not shuffles(got, "pk")


def test_amounts_of_dealt_lines_are_grouped_in_slices(spark, monkeypatch):
    monkeypatch.setattr(registry, "SLICE_ROWS", 500)
    got = compare_checks.amount_equality(spark, SF)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert got.count() == 1500 and plan.count("RepartitionByExpression") == 0
    assert got.rdd.getNumPartitions() >= 12


def test_gaps_are_filled_in_windows_of_one_table(spark):
    cols = "pk int, seq int, no int, name string, qty int, total long"
    a = spark.createDataFrame([(1, 1, 1, "", 1, None), (1, 2, 2, "x", 1, 5), (1, 3, 2, "y", 2, None), (1, 4, None, " ", 1, None), (2, 1, 1, "q", 1, None), (None, 1, 1, "n", 1, None)], cols).repartition(7, "pk")
    b = spark.createDataFrame([(1, 1, 1, "one", 1, 10), (1, 2, None, "y", 2, 20), (1, 3, 9, "z", 1, 30), (1, 4, 8, "w", 1, 40), (1, 5, 7, "v", 1, 50), (None, 1, 1, "n", 1, 60)], cols).repartition(7, "pk")
    got = merge.fill_gaps_cascade(a, b, [["no"], ["name", "qty"]], "pk", "seq", ["name", "total"])
    assert {tuple(r) for r in got.collect()} == {
        (1, "primary", 1, "one", 10, 1), (1, "primary", 2, "x", 5, 0), (1, "primary", 3, "y", 20, 2), (1, "primary", 4, "w", 40, 0), (2, "primary", 1, "q", None, None), (None, "primary", 1, "n", None, None),
        (1, "secondary", 5, "v", 50, None), (None, "secondary", 1, "n", 60, None),
    }
    assert not shuffles(got, "pk")


def test_sides_of_sliced_lines_are_numbered_once(spark, monkeypatch):
    whole = match_checks._sides(spark, SF)
    monkeypatch.setattr(registry, "SLICE_ROWS", 500)
    for want, got in zip(whole, match_checks._sides(spark, SF), strict=True):
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "row_number" not in plan and "Join" not in plan
        assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()
