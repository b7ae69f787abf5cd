"""The findings table: one row for each check of a package, and what is derived from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import small

# Statuses from best to worst, and the severity of each.
STATUSES = ["not_applicable", "skipped", "passed", "warning", "manual_review", "failed"]
SEVERITY = {"failed": "high", "manual_review": "medium", "warning": "medium", "passed": "info", "not_applicable": "info", "skipped": "info"}
#: Sources from the strongest.
AUTHORITY = ["external", "deterministic", "llm"]
FIELDS = ["pk", "check_id", "status", "severity", "expected", "actual", "details"]


def rank(values: list[str], c: Column) -> Column:
    """Place of a value in an ordered list; null for others."""
    return reduce(lambda acc, x: acc.when(c == x[1], F.lit(x[0])), list(enumerate(values))[1:], F.when(c == values[0], F.lit(0)))


def verdict(known: Column, good: Column) -> Column:
    """passed or failed; manual_review where an operand is missing."""
    return F.when(~F.coalesce(known, F.lit(False)), F.lit("manual_review")).when(F.coalesce(good, F.lit(False)), F.lit("passed")).otherwise(F.lit("failed"))


def severity(status: Column) -> Column:
    return reduce(lambda acc, x: acc.when(status == x[0], F.lit(x[1])), list(SEVERITY.items())[1:], F.when(status == "failed", F.lit("high")))


def findings(df: DataFrame, check_id: str, status: str = "status", expected: Column | None = None, actual: Column | None = None, details: list[str] = ()) -> DataFrame:
    """Rows of a check in the shape of the findings table; details as JSON of the named columns."""
    none = F.lit(None).cast("string")
    more = F.to_json(F.struct(*details)) if details else none
    return df.select(
        F.col("pk").cast("string").alias("pk"), F.lit(check_id).alias("check_id"), F.col(status).alias("status"), severity(F.col(status)).alias("severity"),
        (none if expected is None else expected.cast("string")).alias("expected"), (none if actual is None else actual.cast("string")).alias("actual"), more.alias("details"),
    )


def run_all(*checks: DataFrame) -> DataFrame:
    """One findings table of lazily built checks."""
    return reduce(lambda a, b: a.unionByName(b), checks)


def status_counts(df: DataFrame, key: str = "pk") -> DataFrame:
    """Number of findings of each status by package."""
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    return df.groupBy(key).agg(*[n(s) for s in STATUSES], F.count("*").alias("n_total"))


def worst_status(df: DataFrame, *keys: str) -> DataFrame:
    """The worst status of each group."""
    return df.groupBy(*keys).agg(F.max_by("status", rank(STATUSES, F.col("status"))).alias("worst"))


def merge_findings(*parts: DataFrame, key: list[str] = ("pk", "rule", "documents"), order: str = "seq") -> DataFrame:
    """Union without repeats of (key, actual); of one key without actual only the strongest source stays."""
    every = run_all(*parts).withColumn("_r", F.coalesce(rank(AUTHORITY, F.col("source")), F.lit(len(AUTHORITY))))
    best = F.min("_r").over(W.partitionBy(*key))
    every = every.withColumn("_b", best).where(F.col("actual").isNotNull() | (F.col("_r") == F.col("_b")))
    first = F.row_number().over(W.partitionBy(*key, "actual").orderBy("_r", order))
    return every.withColumn("_n", first).where("_n = 1").drop("_n", "_b", "_r")


def filter_findings(df: DataFrame, technical: list[str], unsettled: list[str], text: str = "text") -> DataFrame:
    """Findings about layout alone go; those that say they are unsettled become manual_review."""
    has = lambda words: reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(w)) for w in words])
    kept = df.where(~F.coalesce(has(technical), F.lit(False)))
    return kept.withColumn("status", F.when(has(unsettled), F.lit("manual_review")).otherwise(F.col("status")))


def top_warnings(df: DataFrame, n: int, key: list[str], priority: Column, text: str = "text", order: str = "seq") -> DataFrame:
    """At most n different warnings of each group in the order of priority."""
    once = df.withColumn("_p", priority).withColumn("_n", F.row_number().over(W.partitionBy(*key, text).orderBy("_p", order))).where("_n = 1")
    place = F.row_number().over(W.partitionBy(*key).orderBy("_p", order))
    return once.withColumn("place", place).where(F.col("place") <= n).drop("_n", "_p")


def report_rows(df: DataFrame, sections: DataFrame, replaced: DataFrame) -> DataFrame:
    """Visible findings in the order of sections. ``sections``: check_id, section, ord; ``replaced``: strict_id, semantic_id,
    where a strict finding that needs review gives way to a settled semantic one of the same package."""
    settled = df.where("status in ('passed', 'failed', 'warning')").select("pk", F.col("check_id").alias("semantic_id"))
    hidden = settled.join(small(replaced), "semantic_id").select("pk", F.col("strict_id").alias("check_id"), F.lit("manual_review").alias("status")).distinct()
    seen = df.where("status not in ('skipped', 'not_applicable')").join(hidden, ["pk", "check_id", "status"], "left_anti")
    return seen.join(small(sections), "check_id").withColumn("place", F.row_number().over(W.partitionBy("pk").orderBy("ord", "check_id", "status", "actual")))


def override_results(base: DataFrame, better: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rows of ``base``, with the fields of the row of ``better`` that has the same keys where there is one."""
    other = better.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_has"))
    joined = base.join(other, keys, "left")
    return joined.select(*[F.when(F.col("_has"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns])
