"""Files, reference lists, JSON and streams on temporary folders."""

from pyspark.sql import functions as F

from dossier.operators import prices
from dossier.sources import packages as src
from dossier.streaming import jobs


def test_discovery_by_name(spark, tmp_path):
    for p, n in (("p1", "Контракт.docx"), ("p1", "Обоснование НМЦК.xlsx"), ("p1", "report.docx"), ("p2", "КП 1.pdf"), ("p2", "что-то.txt")):
        (tmp_path / p).mkdir(exist_ok=True)
        (tmp_path / p / n).write_text("x")
    got = sorted((r.pk, r.role, r.extension) for r in src.discover_files(spark, str(tmp_path)).collect())
    assert got == [("p1", "contract", "docx"), ("p1", "nmck", "xlsx"), ("p2", "offer", "pdf"), ("p2", "unknown", "txt")]


def test_reference_codes_are_pruned_by_folder(spark, tmp_path):
    codes = spark.createDataFrame([("t", 1, 1, "a", "31.01"), ("t", 2, 2, "b", "13.20")], "table_id string, row_index int, position int, name string, code string")
    src.write_ref_codes(codes, str(tmp_path / "ref"))
    back = spark.read.parquet(str(tmp_path / "ref")).where("code2 = 31")
    assert [r.code for r in back.collect()] == ["31.01"]
    assert "PartitionFilters: [isnotnull(code2" in back._jdf.queryExecution().executedPlan().toString()


def test_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "я"), (2, None)], "a int, b string")
    src.write_findings(df, str(tmp_path / "out"))
    assert sorted((r.a, r.b) for r in src.read_json_index(spark, str(tmp_path / "out"), "a int, b string").collect()) == [(1, "я"), (2, None)]


def test_package_identity_ignores_order(spark):
    a = spark.createDataFrame([("p", "x"), ("p", "y"), ("q", "y"), ("q", "x"), ("r", None)], "pk string, text string")
    got = {r.pk: r.package_id for r in src.package_ids(a).collect()}
    assert got["p"] == got["q"] != got["r"]


def test_stream_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, 5), (1, 7), (2, 3)], "pk int, price long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = jobs.read_packages(spark, str(tmp_path / "in"), "pk int, price long")
        jobs.incremental_audit(stream, prices.price_variation, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_metrics_count_errors(spark):
    df = spark.createDataFrame([("2024-01-01 00:01:00", "error", 1.0), ("2024-01-01 00:09:59", "view", 2.5), ("2024-01-01 00:10:00", "view", 1.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r.n_calls, r.n_errors, r.value) for r in jobs.metrics(df).collect()) == [(1, 0, 100), (2, 1, 350)]
