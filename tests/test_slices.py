"""Tables of more rows than a slice, packages of more pairs than meet as they are, and states that packages share."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dossier.operators import catalogue, match, rule_tables
from dossier.plans import registry
from dossier.streaming import packages

SF = "/root/testdata/sf0.001"


def test_lines_with_parts_are_shuffled_by_package_once_and_equal_the_join(spark, tmp_path, monkeypatch):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    part = spark.read.parquet(f"{SF}/part.parquet")
    lines.unionByName(lines.limit(50)).write.parquet(str(tmp_path / "lineitem.parquet"))
    # some parts are there twice, others not at all
    part.where("p_partkey % 5 != 0").unionByName(part.where("p_partkey % 7 = 1")).write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(registry, "SLICE_ROWS", 500)
    sf = str(tmp_path)
    got = registry.item_parts(spark, sf)
    want = registry.items(spark, sf).join(registry.parts(spark, sf), "item").select(got.columns)
    assert got.count() > 0 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    slices = -(-lines.count() // 500)
    counted = got.groupBy("pk").agg(F.count("*").alias("n"))
    counted.collect()
    assert counted.rdd.getNumPartitions() >= slices > 4
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(pk" not in plan.split("Initial Plan")[0]


@pytest.mark.parametrize("most", [0, 3, 10**6])
def test_packages_meet_alike_below_and_above_the_limit(spark, monkeypatch, most):
    monkeypatch.setattr(match.large_groups, "__defaults__", (("pk",), most))
    rows = [(1, 1, 1, "ring", "a", "x"), (1, 2, 2, "old ring", "b", "y"), (1, 3, 3, "", "c", "z"), (2, 1, 1, "bolt", "a", "x"), (4, 5, 9, "hot plate", "q", "x"), (4, 6, 9, "hot", None, "w")]
    just = [(1, 1, 2, "none", None, ["x"]), (1, 2, None, "an old ring", "a", []), (1, 3, None, "", "c", ["x"]), (1, 4, None, None, None, ["z", None]), (1, 5, 77, "nothing", "zz", None), (2, 1, None, "other", None, []), (3, 1, 1, "ring", "a", ["x"]), (4, 1, None, "so hot plate", None, ["w"])]
    got = catalogue.link_justifications(spark.createDataFrame(just, "pk int, j int, row_no int, name_norm string, code string, chars array<string>"), spark.createDataFrame(rows, "pk int, seq int, row_no int, name_norm string, code string, char string"))
    assert {(r.pk, r.j): (r.seq, r.way) for r in got.collect()} == {(1, 1): (2, 1), (1, 2): (1, 2), (1, 3): (3, 3), (1, 4): (3, 4), (1, 5): (None, None), (2, 1): (1, 5), (3, 1): (None, None), (4, 1): (5, 2)}
    assert "explode" not in got._jdf.queryExecution().optimizedPlan().toString() or most < 10**6
    a = spark.createDataFrame([(1, "01.02.03.1", ["ring", ""]), (1, "09.02", ["x"]), (2, "01.02.03.1", ["bolt"]), (3, "5", ["nut"])], "pk int, code string, names array<string>")
    b = spark.createDataFrame([(1, "01.02.03.1", ["big"]), (1, "01.02.03.2", [""]), (1, "07.07", ["small ring"]), (1, "09.02", ["y"]), (2, "08.08", ["bo", "olt"]), (3, "6", [None])], "pk int, code string, names array<string>")
    assert {(r.pk, r.code): r.similar for r in rule_tables.similar_by_name(a, b).collect()} == {(1, "01.02.03.1"): "01.02.03.2,07.07", (2, "01.02.03.1"): "08.08"}


class Store:
    """Stands for the state of one key; counts what is asked of it."""

    def __init__(self):
        self.row, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        self.calls += 1
        return self.row is not None

    def get(self):
        self.calls += 1
        return self.row

    def update(self, row):
        self.calls += 1
        self.row = row

    def clear(self):
        self.row = None

    def listTimers(self):
        self.calls += 1
        return iter(self.timers)

    def deleteTimer(self, t):
        self.calls += 1
        self.timers.remove(t)

    def registerTimer(self, t):
        self.calls += 1
        self.timers.append(t)


def test_packages_of_a_bucket_share_one_read_and_one_write_of_state():
    store, sums = Store(), packages.PriceSums(10)
    sums.init(store)
    batch = pd.DataFrame({"bucket": 0, "pk": [f"p{i % 100}" for i in range(300)], "at_ms": range(300), "price": [10**15] * 200 + [None] * 100})
    found = pd.concat(sums.handleInputRows((0,), iter([batch]), None))
    assert len(found) == 100 and set(found["n_prices"]) == {2} and set(found["cv"]) == {0.0} and store.calls < 10
    again = pd.concat(sums.handleInputRows((0,), iter([batch[:1]]), None))
    assert again[["pk", "arrival", "n_prices"]].values.tolist() == [["p0", 2, 3]]
    clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self: 260, "getExpiryTimeInMs": lambda self: 210})()
    closed = pd.concat(sums.handleExpiredTimer((0,), clock, clock))
    # the last rows came at 200 to 299, and ten later their time is up
    assert len(closed) == 50 and closed["closed"].all() and store.timers == [260] and len(store.row[0]) == 50
