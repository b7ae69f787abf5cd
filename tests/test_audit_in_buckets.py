"""The audit over lines that are dealt by package once, and grouping sets by hand."""

from dossier.operators import audit as op
from dossier.plans import audit_checks, registry

from .test_queries import SF, plain


def rows_of(df):
    return sorted(str(tuple(plain(r[c]) for c in sorted(df.columns))) for r in df.collect())


def test_full_audit_shuffles_no_fact_table_but_the_union_with_orders(spark, monkeypatch):
    want = rows_of(audit_checks.full_audit(spark, SF))
    monkeypatch.setattr(registry, "SLICE_ROWS", 1000)
    monkeypatch.setattr(audit_checks, "BUCKET_ROWS", 500)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = audit_checks.full_audit(spark, SF)
        got = rows_of(df)
        plan = audit_checks.full_audit(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want and len(want) > 10_000
    assert plan.count("SortMergeJoin") == 14 and plan.count("Exchange ") == 1 and "to_json" not in plan
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("audit")]


def test_findings_have_the_named_columns_and_the_same_values(spark):
    packages = spark.createDataFrame([(1, 100, None, True), (2, None, None, None)], "pk int, amount long, end_date date, extra_present boolean")
    prices = spark.createDataFrame([(1, 0, 0, 2, 5, 10, 10, 5), (1, 0, None, 2, 6, 12, 12, 5), (1, None, 1, 1, None, 7, 7, None), (None, 1, 1, 1, 1, 1, 1, 1)], "pk int, seq int, source int, qty long, price long, total long, declared long, declared_min long")
    full = op.audit(packages, {"prices": prices}, op.standard_checks())
    few = op.audit(packages, {"prices": prices}, op.standard_checks(), columns=["check_id", "pk", "status"], apart=True)
    assert few.columns == ["check_id", "pk", "status"] and rows_of(few) == rows_of(full.select("check_id", "pk", "status"))
    found = {(r.check_id, r.pk): (r.status, r.details) for r in full.collect()}
    assert found["prices.minimum", "1"] == ("manual_review", '{"n":2,"n_unknown":1,"n_wrong":0}')
    assert found["prices.source_totals", "1"] == ("passed", '{"n":3,"n_unknown":0,"n_wrong":0}')
