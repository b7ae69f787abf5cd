"""Codes that stand in a package under several names, and look-ups by keys that many rows share."""

from dossier.operators import catalogue, match


def test_a_code_of_two_names_is_met_by_each_and_counts_once(spark):
    items = spark.createDataFrame([(1, 1, ["red", "blue", "ring"]), (2, 1, ["red", "ring"]), (3, 1, ["red", "ring", "bolt", "hot"])], "pk int, seq int, tokens array<string>")
    # of package 1 each name shares one token of two with the item, which is too few; package 2 has one code under two fitting names
    codes = [(1, "c", ["red", "bolt"]), (1, "c", ["blue", "plate"]), (2, "c", ["red"]), (2, "c", ["ring", "red", "old"]), (3, "c", ["red", "ring", "bolt"]), (3, "d", ["hot"])]
    got = {r.pk: (r.code, r.n_codes, r.status) for r in match.link_codes(items, spark.createDataFrame(codes, "pk int, code string, tokens array<string>")).collect()}
    assert got == {1: (None, 0, "warning"), 2: ("c", 1, "passed"), 3: (None, 2, "warning")}


def test_plan_code_by_the_stems_of_one_name(spark):
    items = [(1, 1, None, ["red", "ring"]), (2, 1, None, ["red", "ring"]), (3, 1, "k", ["red"]), (4, 1, None, ["hot"])]
    # the stems of two names of one code together are as many as one name has, but the item has all of neither
    codes = [(1, "c", "x", ["red", "bolt"]), (1, "c", "y", ["ring", "plate"]), (2, "c", "x", ["red"]), (2, "c", "y", ["ring"]), (3, "c", "k", ["old"]), (4, "c", "x", [])]
    x = spark.createDataFrame(items, "pk int, seq int, ktru string, tokens array<string>")
    got = catalogue.plan_code_for_item(x, spark.createDataFrame(codes, "pk int, code string, ktru string, tokens array<string>")).collect()
    assert {r.pk: (r.code, r.how) for r in got} == {1: (None, None), 2: ("c", "name"), 3: ("c", "ktru"), 4: ("c", "name")}


def test_lookup_meets_no_reference_key_of_many_rows(spark):
    ref = [(i, f"k{i}", "10", "ring") for i in range(50)] + [(50, "k50", "11", "ring"), (51, None, "12", "bolt"), (52, "k0", None, None)]
    items = [(1, 1, "k1", "10", "ring"), (1, 2, None, "11", "ring"), (1, 3, None, None, "bolt"), (1, 4, "k0", "10", "ring"), (1, 5, None, None, None)]
    x, r = spark.createDataFrame(items, "pk int, seq int, ktru string, code string, name string"), spark.createDataFrame(ref, "ref_id int, ktru string, code string, name string")
    found = match.lookup_item(x, r)
    assert {s.seq: (s.ref_id, s.how) for s in found.collect()} == {1: (1, "ktru"), 2: (50, "code+name"), 3: (51, "name"), 4: (None, None), 5: (None, None)}
    # 200 items of a name that 51 reference rows have: no join gives out more rows than there are items
    many = spark.range(200).selectExpr("id AS pk", "1 AS seq", "string(null) AS ktru", "string(null) AS code", "'ring' AS name")
    assert most_rows(match.lookup_item(many, r)) <= 200


def most_rows(df):
    """Most rows that a join of the plan has given out."""
    df.collect()
    plan, most = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            plan.append(node.executedPlan())
            continue
        if "Join" in node.nodeName():
            most = max(most, node.metrics().apply("numOutputRows").value())
        if node.nodeName().endswith("QueryStage"):
            plan.append(node.plan())
        plan += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_best_name_of_a_block_compares_each_name_once(spark):
    ref = spark.range(300).selectExpr("id AS ref_id", "CASE id % 3 WHEN 0 THEN 'red ring' WHEN 1 THEN 'blue ring' END AS ref_name", "id % 2 AS size")
    items = spark.range(300).selectExpr("id AS pk", "1 AS seq", "CASE id % 3 WHEN 0 THEN 'red ring big' WHEN 1 THEN 'blue ring' END AS name", "id % 2 AS size")
    pairs = items.join(ref, "size")
    want = {r.pk: (r.ref_id, r.score) for r in match.best_by_name(pairs).collect()}
    found = match.best_in_blocks(items, ref, ["size"])
    assert {r.pk: (r.ref_id, r.score) for r in found.collect()} == want and len(want) == 300
    assert most_rows(match.best_in_blocks(items, ref, ["size"])) <= 300 < pairs.count()
