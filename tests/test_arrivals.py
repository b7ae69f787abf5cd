"""Packages that arrive in parts, over restarts and timers, and the shared folder without its setting."""

import datetime as dt
import statistics
from types import SimpleNamespace

import pytest

from dossier.sources import shared
from dossier.streaming import jobs, packages

SCHEMA = "pk string, at timestamp, price long"
T = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def feed(spark, tmp_path, rows):
    """One more batch of files, read by a query that starts from the checkpoint and stops."""
    spark.createDataFrame([(pk, T + dt.timedelta(hours=h), price) for pk, h, price in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read_packages(spark, str(tmp_path / "in"), SCHEMA)
    jobs.to_table(packages.audit_arrivals(stream, "7 days", "1 day"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    return {r.pk: r for r in packages.current(found).collect()}, found


def cv(*prices):
    return round(statistics.stdev(prices) / statistics.mean(prices) * 100, 4)


def test_three_arrivals_give_one_current_finding(spark, tmp_path):
    got, _ = feed(spark, tmp_path, [("a", 0, 100), ("b", 0, 5), ("b", 1, None), (None, 0, 1), ("c", 0, 10**15), ("c", 0, 10**15 + 3)])
    assert (got["a"].n_prices, got["a"].cv, got["a"].status) == (1, None, "manual_review")
    got, _ = feed(spark, tmp_path, [("a", 5, 120), ("a", 6, 120)])
    assert got["a"].cv == cv(100, 120, 120) and got["a"].status == "passed"
    got, found = feed(spark, tmp_path, [("a", 9, 900)])
    assert got["a"].cv == cv(100, 120, 120, 900) and got["a"].status == "failed"
    assert (got["b"].n_prices, got["b"].cv, got["b"].status) == (1, None, "manual_review")
    assert got["c"].cv == 0.0 and set(got) == {"a", "b", "c"} and not any(r.closed for r in got.values())
    assert sorted(r.arrival for r in found.where("pk = 'a'").collect()) == [1, 2, 3]


def test_a_quiet_package_is_closed_and_begins_anew(spark, tmp_path):
    feed(spark, tmp_path, [("a", 0, 100), ("a", 0, 140), ("b", 0, 7)])
    # twenty days later the watermark has passed the week of a and b
    got, _ = feed(spark, tmp_path, [("x", 24 * 20, 1)])
    got, _ = feed(spark, tmp_path, [("x", 24 * 20, 1)])
    assert got["a"].closed and got["a"].cv == cv(100, 140) and got["b"].closed and not got["x"].closed
    # what comes later than the watermark is dropped, what comes after it is a new package
    got, _ = feed(spark, tmp_path, [("b", 0, 1_000), ("a", 24 * 21, 10), ("a", 24 * 21, 10)])
    assert (got["a"].n_prices, got["a"].cv, got["a"].closed) == (2, 0.0, False)
    assert got["b"].n_prices == 1 and got["b"].closed


def test_shared_folder_without_its_setting(spark):
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: default), sparkContext=spark.sparkContext)
    first = shared.shared_dir(unset)
    assert first and shared.shared_dir(unset) == first == spark.sparkContext.getCheckpointDir()
    cluster = SimpleNamespace(conf=unset.conf, sparkContext=SimpleNamespace(master="spark://x", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(cluster)
