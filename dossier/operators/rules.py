"""Rule tables over facts: bands by amount, shares, clauses, terms and the guards of semantic decisions."""

from __future__ import annotations

from decimal import Decimal as D

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import norm_text, text_close
from ..sources.shared import small
from .findings import verdict

# Fixed values, amounts in roubles and percents: kind, amount above which and up to which the band holds, least, most.
SECURITY_BANDS = [
    ("bid", None, 20_000_000, D("0.5"), D("1")),
    ("bid", 20_000_000, None, D("0.5"), D("5")),
    ("performance", None, 50_000_000, D("0.5"), D("30")),
    ("performance", 50_000_000, None, D("10"), D("30")),
    ("warranty", None, None, D("0"), D("10")),
]
# Percent of the contract price for a supplier's breach of a valued obligation.
PENALTY_PERCENTS = [
    (None, 3_000_000, D("10")), (3_000_000, 50_000_000, D("5")), (50_000_000, 100_000_000, D("1")), (100_000_000, 500_000_000, D("0.5")),
    (500_000_000, 1_000_000_000, D("0.4")), (1_000_000_000, 2_000_000_000, D("0.3")), (2_000_000_000, 5_000_000_000, D("0.25")),
    (5_000_000_000, 10_000_000_000, D("0.2")), (10_000_000_000, None, D("0.1")),
]
# Roubles for a breach without a value, and for the customer's.
PENALTY_AMOUNTS = [(None, 3_000_000, 1_000), (3_000_000, 50_000_000, 5_000), (50_000_000, 100_000_000, 10_000), (100_000_000, None, 100_000)]
EXTRA_REQUIREMENTS_FROM = 20_000_000


def within(amount: Column) -> Column:
    """Whether a band (above, upto) holds for the amount."""
    return (F.col("above").isNull() | (amount > F.col("above"))) & (F.col("upto").isNull() | (amount <= F.col("upto")))


def security_band_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SECURITY_BANDS, "kind string, above bigint, upto bigint, least decimal(9,4), most decimal(9,4)")


def penalty_table(spark: SparkSession) -> DataFrame:
    """kind, above, upto, percent, fixed."""
    rows = [("value", a, b, p, None) for a, b, p in PENALTY_PERCENTS] + [("non_value", a, b, None, x) for a, b, x in PENALTY_AMOUNTS]
    return spark.createDataFrame(rows, "kind string, above bigint, upto bigint, percent decimal(9,4), fixed bigint")


def security_bands(facts: DataFrame, bands: DataFrame) -> DataFrame:
    """Percent of a security against the band of its kind and amount. ``facts``: pk, kind, amount, percent, exempt.

    Each fact gets its row; without an amount it has no band and is for manual review.
    """
    own = bands.withColumnRenamed("kind", "_kind")
    both = facts.join(small(own), (F.col("kind") == F.col("_kind")) & F.col("amount").isNotNull() & within(F.col("amount")), "left").drop("_kind")
    known = F.col("amount").isNotNull() & F.col("percent").isNotNull() & F.col("least").isNotNull()
    status = F.when(F.coalesce("exempt", F.lit(False)), "not_applicable").otherwise(verdict(known, F.col("percent").between(F.col("least"), F.col("most"))))
    return both.select("pk", "kind", "amount", "percent", "least", "most", status.alias("status"))


def security_check(facts: DataFrame, bands: DataFrame) -> DataFrame:
    """pk, kind, status of securities with all that decides before the band. ``facts``: pk, kind, amount, percent, method,
    note (an exception that the plan speaks of), required.

    A single supplier has neither bid nor performance security; an exception is for manual review; what isn't required
    passes; without an amount, a percent, or the method beside 0 %, it is for manual review. A warranty security has its
    upper bound only, whatever the method and the amount.
    """
    own = bands.withColumnRenamed("kind", "_kind")
    warranty = F.col("kind") == "warranty"
    band = (F.col("kind") == F.col("_kind")) & F.when(warranty, F.lit(True)).otherwise(F.col("amount").isNotNull() & within(F.col("amount")))
    both = facts.join(small(own), band, "left")
    unclear = F.col("percent").isNull() | (~warranty & (F.col("amount").isNull() | ((F.col("percent") == 0) & F.col("method").isNull())))
    good = F.when(warranty, F.col("percent") <= F.col("most")).otherwise(F.col("percent").between(F.col("least"), F.col("most")))
    status = (
        F.when(~warranty & F.coalesce(F.col("method") == "single_supplier", F.lit(False)), "not_applicable").when(~warranty & F.col("note").isNotNull(), "manual_review")
        .when(~F.coalesce("required", F.lit(True)), "passed").when(unclear, "manual_review").when(good, "passed").otherwise("failed")
    )
    return both.select("pk", "kind", status.alias("status"))


def penalty_check(clauses: DataFrame, facts: DataFrame, table: DataFrame) -> DataFrame:
    """Penalties of clauses (pk, party, kind, percent, fixed) against the band of the amount (``facts``: pk, amount).

    A clause of the other kind is looked at only if there is none of the kind itself.
    """
    need = facts.join(small(table), within(F.col("amount"))).select("pk", "amount", "kind", F.col("percent").alias("due_percent"), F.col("fixed").alias("due_fixed"))
    best = F.row_number().over(W.partitionBy("pk", "need").orderBy((F.col("kind") != F.col("need")).cast("int"), "seq"))
    own = clauses.select("pk", "seq", F.col("kind").alias("c_kind"), F.col("percent").alias("c_percent"), F.col("fixed").alias("c_fixed"))
    both = need.withColumnRenamed("kind", "need").join(own, "pk", "left").withColumn("kind", F.coalesce("c_kind", "need"))
    both = both.withColumn("_n", best).where("_n = 1")
    has = F.when(F.col("need") == "value", F.col("c_percent").isNotNull()).otherwise(F.col("c_fixed").isNotNull())
    right = F.when(F.col("need") == "value", F.col("c_percent") == F.col("due_percent")).otherwise(F.col("c_fixed") == F.col("due_fixed"))
    return both.select("pk", "amount", "need", "due_percent", "due_fixed", "c_percent", "c_fixed", verdict(has, right).alias("status"))


def threshold_required(facts: DataFrame, limit: int = EXTRA_REQUIREMENTS_FROM) -> DataFrame:
    """Above the limit extra requirements must be there; below it they may not be. ``facts``: pk, amount, present."""
    above = F.col("amount") > limit
    return facts.withColumn("required", above).withColumn("status", verdict(F.col("amount").isNotNull() & F.col("present").isNotNull(), F.col("present") == above))


def share_agreement(plan: DataFrame, contract: DataFrame) -> DataFrame:
    """Whether both documents demand subcontractors, and the same share. Both: pk, required, percent."""
    other = contract.select("pk", F.col("required").alias("c_required"), F.col("percent").alias("c_percent"))
    both = plan.join(other, "pk", "left")
    status = (
        F.when(F.col("required").isNull() | F.col("c_required").isNull(), "manual_review").when(F.col("required") != F.col("c_required"), "failed")
        .when(~F.col("required"), "passed").otherwise(verdict(F.col("percent").isNotNull() & F.col("c_percent").isNotNull(), F.col("percent") == F.col("c_percent")))
    )
    return both.withColumn("status", status)


def clause_checklist(sections: DataFrame, checklist: DataFrame) -> DataFrame:
    """Mandatory clauses and whether a text of the package has all markers of one. ``checklist``: clause, markers (array)."""
    text = sections.groupBy("pk").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("_t"))
    has = F.forall("markers", lambda m: F.contains(F.lower("_t"), m))
    return text.crossJoin(small(checklist)).select("pk", "clause", has.alias("present"), verdict(F.col("_t").isNotNull(), has).alias("status"))


def text_vs_baseline(facts: DataFrame, field: str, base: str) -> DataFrame:
    """A text field of each document against that of the base document: equal in normal form, or one within the other."""
    own = facts.where(F.col("field") == field)
    first = own.where(F.col("doc_role") == base).groupBy("pk").agg(F.min("raw").alias("base_text"))
    both = own.where(F.col("doc_role") != base).join(first, "pk", "left")
    same = text_close(norm_text(F.col("raw")), norm_text(F.col("base_text")))
    known = (norm_text(F.col("raw")) != "") & (norm_text(F.col("base_text")) != "")
    return both.select("pk", "doc_role", "raw", "base_text", verdict(known, same).alias("status"))


def term_issues(stages: DataFrame, overall: DataFrame) -> DataFrame:
    """Stages without an end and stages that end after the whole. ``stages``: pk, stage_no, end_date; ``overall``: pk, end_date."""
    last = overall.select("pk", F.col("end_date").alias("overall_end"))
    both = stages.join(last, "pk", "left")
    issue = F.when(F.col("end_date").isNull(), "end_missing").when(F.col("end_date") > F.col("overall_end"), "after_overall_end")
    sums = both.withColumn("issue", issue).groupBy("pk").agg(
        F.count("*").alias("n_stages"), F.count_if(F.col("issue") == "end_missing").alias("n_missing"), F.count_if(F.col("issue") == "after_overall_end").alias("n_late"),
        F.max("end_date").alias("last_end"), F.first("overall_end", True).alias("overall_end"),
    )
    return sums.withColumn("status", F.when((F.col("n_missing") > 0) | F.col("overall_end").isNull(), "manual_review").when(F.col("n_late") > 0, "failed").otherwise("passed"))


def apply_guards(decisions: DataFrame, facts: DataFrame) -> DataFrame:
    """Overrides semantic decisions that facts contradict. ``decisions``: pk, check_id, status; ``facts``: pk, equal_text,
    houses_differ, by_reference. Equal texts pass; different house numbers fail; a bare reference can't be passed."""
    both = decisions.join(facts, "pk", "left")
    new = (
        F.when(F.coalesce("houses_differ", F.lit(False)), "failed").when(F.coalesce("equal_text", F.lit(False)), "passed")
        .when(F.coalesce("by_reference", F.lit(False)) & (F.col("status") == "passed"), "manual_review").otherwise(F.col("status"))
    )
    return both.select("pk", "check_id", F.col("status").alias("given"), new.alias("status"), (new != F.col("status")).alias("overridden"))


def warranty_check(facts: DataFrame) -> DataFrame:
    """Warranty of the contract (that of its annex if it has one) against the description. ``facts``: pk, plan, body, annex."""
    own = F.coalesce(F.when(F.trim("annex") != "", F.col("annex")), F.col("body"))
    known = (norm_text(F.col("plan")) != "") & (norm_text(own) != "")
    return facts.select("pk", own.alias("contract_text"), verdict(known, text_close(norm_text(F.col("plan")), norm_text(own))).alias("status"))


def funding_check(facts: DataFrame, placeholders: list[str]) -> DataFrame:
    """Funding source of plan and contract: missing, a placeholder, equal or different. ``facts``: pk, plan, contract."""
    p, c = norm_text(F.col("plan")), norm_text(F.col("contract"))
    empty = lambda x: x.isNull() | (x == "")
    kind = F.when(empty(p) | empty(c), "missing").when(p.isin(placeholders) | c.isin(placeholders), "placeholder").when(p == c, "equal").otherwise("different")
    out = facts.select("pk", kind.alias("kind"))
    return out.withColumn("status", F.when(F.col("kind") == "equal", "passed").when(F.col("kind") == "different", "failed").otherwise("manual_review"))


def method_kind(facts: DataFrame, fields: list[str], rules: list[tuple[str, str]]) -> DataFrame:
    """Kind of procurement from several text fields: the first rule (marker, kind) whose marker is in one of them."""
    text = F.lower(F.concat_ws(" ", *fields))
    kind = F.coalesce(*[F.when(F.contains(text, F.lit(m)), F.lit(k)) for m, k in rules], F.lit("unknown"))
    return facts.select("pk", kind.alias("method"))


def offer_row_check(pairs: DataFrame, tolerance: int = 0) -> DataFrame:
    """Matched rows: quantity and unit against both references, row total; one status for each and the worst. ``pairs``:
    pk, seq, qty, unit, price, total, ref_qty, ref_unit, plan_qty."""
    qty = verdict(F.col("qty").isNotNull() & F.col("ref_qty").isNotNull(), F.col("qty") == F.col("ref_qty"))
    plan = F.when(F.col("plan_qty").isNull(), "skipped").otherwise(verdict(F.col("qty").isNotNull(), F.col("qty") == F.col("plan_qty")))
    unit = verdict(F.col("unit").isNotNull() & F.col("ref_unit").isNotNull(), F.col("unit") == F.col("ref_unit"))
    total = verdict(F.col("total").isNotNull() & F.col("price").isNotNull(), F.abs(F.col("qty") * F.col("price") - F.col("total")) <= tolerance)
    out = pairs.select("pk", "seq", qty.alias("qty_status"), plan.alias("plan_status"), unit.alias("unit_status"), total.alias("total_status"))
    each = [F.col(c) for c in out.columns[2:]]
    any_of = lambda s: F.array_contains(F.array(*each), s)
    return out.withColumn("status", F.when(any_of("failed"), "failed").when(any_of("manual_review"), "manual_review").otherwise("passed"))
