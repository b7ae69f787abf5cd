"""Comparison of documents inside a package: presence, codes, amounts, items, stages, attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import text_close
from ..sources.shared import small
from .findings import verdict


def first_per_role(files: DataFrame, order: list, many: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(chosen, ignored): one file for each role of a package, all of the roles in ``many``."""
    place = F.row_number().over(W.partitionBy("pk", "role").orderBy(*order))
    seen = files.withColumn("place", place)
    chosen = (F.col("place") == 1) | F.col("role").isin(list(many))
    reason = F.concat(F.lit("duplicate of role "), F.col("role"))
    return seen.where(chosen).drop("place"), seen.where(~chosen).withColumn("reason", reason).drop("place")


def completeness(files: DataFrame, packages: DataFrame, required: DataFrame, offer_role: str, min_offers: int = 3) -> DataFrame:
    """Required roles that a package lacks, and whether it has enough offers. ``required``: role (a small list)."""
    need = packages.select("pk").crossJoin(small(required.select("role")))
    missing = need.join(files.select("pk", "role").distinct(), ["pk", "role"], "left_anti").groupBy("pk").agg(F.array_sort(F.collect_set("role")).alias("missing"))
    offers = files.where(F.col("role") == offer_role).groupBy("pk").agg(F.count("*").alias("n_offers"))
    out = packages.select("pk").join(missing, "pk", "left").join(offers, "pk", "left")
    out = out.select("pk", F.array_join(F.coalesce("missing", F.array().cast("array<string>")), ",").alias("missing"), F.coalesce("n_offers", F.lit(0)).alias("n_offers"))
    return out.withColumn("status", F.when(F.col("missing") != "", "failed").when(F.col("n_offers") < min_offers, "manual_review").otherwise("passed"))


def compare_codes(codes: DataFrame, base: str) -> DataFrame:
    """Code sets of each document against the required set of the base document, per package and role.

    A missing code whose parent (its text before the dash) is there counts as derived only: a warning, not a match.
    """
    sets = codes.groupBy("pk", "role").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    need = sets.where(F.col("role") == base).select("pk", F.col("codes").alias("required"))
    both = sets.where(F.col("role") != base).join(need, "pk")
    missing = F.array_except("required", "codes")
    parents = F.transform("codes", lambda c: F.split_part(c, F.lit("-"), F.lit(1)))
    derived = F.filter(missing, lambda c: F.array_contains(parents, F.split_part(c, F.lit("-"), F.lit(1))))
    joined = lambda a: F.array_join(a, ",")
    out = both.select("pk", "role", F.size(F.array_intersect("required", "codes")).alias("n_common"), joined(F.array_except(missing, derived)).alias("missing"), joined(derived).alias("derived_only"), joined(F.array_except("codes", "required")).alias("additional"))
    return out.withColumn("status", F.when(F.col("missing") != "", "failed").when((F.col("derived_only") != "") | (F.col("additional") != ""), "warning").otherwise("passed"))


def code_sets(codes: DataFrame) -> DataFrame:
    """Union of explicit and derived codes of a package, and expected codes that are only derived. ``codes``: pk, code, kind."""
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("code"))))
    sets = codes.groupBy("pk").agg(of("explicit").alias("explicit"), of("derived").alias("derived"), of("expected").alias("expected"))
    all_codes = F.array_union("explicit", "derived")
    only = F.array_except(F.array_intersect("expected", all_codes), "explicit")
    return sets.select("pk", F.size(all_codes).alias("n_all"), F.array_join(F.array_sort(only), ",").alias("derived_only"))


def unexpected_codes(codes: DataFrame, explained: DataFrame) -> DataFrame:
    """Codes of a field that no explained code equals or is a parent of. Both: pk, code.

    A code is looked for among the explained ones with each of its parents (its text before a point), so the codes of a
    package don't meet one another.
    """
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("code", r"\."))), lambda n: F.call_function("substring_index", F.col("code"), F.lit("."), n))
    asked = codes.select("pk", "code").distinct().select("pk", "code", F.explode_outer(above).alias("_e"), F.lit(False).alias("_known"))
    known = explained.where("pk is not null and code is not null").select("pk", F.lit(None).cast("string").alias("code"), F.col("code").alias("_e"), F.lit(True).alias("_known"))
    # one window in place of a join by package and code: rows that lie by package stay where they are
    met = asked.unionByName(known).withColumn("_met", F.bool_or("_known").over(W.partitionBy("pk", "_e"))).where("not _known")
    return met.groupBy("pk", "code").agg(F.bool_or("_met").alias("_met")).where("not _met").drop("_met")


def similar_codes(codes: DataFrame, others: DataFrame) -> DataFrame:
    """For each code other codes of the package with the same first three segments. Both: pk, code."""
    head = F.substring_index("code", ".", 3)
    left, right = codes.select("pk", "code", head.alias("h")), others.select("pk", F.col("code").alias("similar"), head.alias("h"))
    near = left.join(right, ["pk", "h"]).where("code != similar").groupBy("pk", "code").agg(F.array_sort(F.collect_set("similar")).alias("s"))
    return near.select("pk", "code", F.array_join("s", ",").alias("similar"))


def compare_amounts(facts: DataFrame) -> DataFrame:
    """Whether all known amounts of a package are equal; two at least are needed. ``facts``: pk, role, amount."""
    sums = facts.where("amount is not null").groupBy("pk").agg(F.countDistinct("role").alias("n_known"), F.min("amount").alias("low"), F.max("amount").alias("high"))
    return sums.withColumn("status", verdict(F.col("n_known") >= 2, F.col("low") == F.col("high")))


def compare_item_values(items: DataFrame, value: str) -> DataFrame:
    """Equality of a value of the items of one key across documents; keys repeated inside one document are left out."""
    seen = items.where("key is not null").withColumn("_n", F.count("*").over(W.partitionBy("pk", "key", "role")))
    sums = seen.where("_n = 1").groupBy("pk", "key").agg(F.count("*").alias("n_docs"), F.count(value).alias("n_known"), F.min(value).alias("low"), F.max(value).alias("high"))
    return sums.where("n_docs > 1").withColumn("status", verdict(F.col("n_known") == F.col("n_docs"), F.col("low") == F.col("high")))


def names_by_code(items: DataFrame) -> DataFrame:
    """Names and quantity by code of a package."""
    sums = items.groupBy("pk", "code").agg(F.array_sort(F.collect_set("name")).alias("n"), F.sum("qty").alias("qty"))
    return sums.select("pk", "code", F.array_join("n", "; ").alias("names"), "qty")


def compare_stages(plan: DataFrame, other: DataFrame) -> DataFrame:
    """Stages of the plan against those of another document, both: pk, stage_no, start_date, end_date, term_text.

    Dates decide; without dates the texts; without either it is for a person. Order is checked by ``stage_order``.
    """
    o = other.select("pk", "stage_no", *[F.col(c).alias(f"o_{c}") for c in ("start_date", "end_date", "term_text")], F.lit(True).alias("_o"))
    both = plan.withColumn("_p", F.lit(True)).join(o, ["pk", "stage_no"], "full")
    dated = F.col("end_date").isNotNull() & F.col("o_end_date").isNotNull()
    texts = F.coalesce((F.col("term_text") != "") & (F.col("o_term_text") != ""), F.lit(False))
    kind = (
        F.when(F.col("_o").isNull(), "missing").when(F.col("_p").isNull(), "extra").when(dated, F.when((F.col("end_date") == F.col("o_end_date")) & F.coalesce(F.col("start_date") == F.col("o_start_date"), F.lit(True)), "equal").otherwise("different"))
        .when(texts, F.when(text_close(F.col("term_text"), F.col("o_term_text")), "equal").otherwise("different")).otherwise("unknown")
    )
    out = both.select("pk", "stage_no", "end_date", "o_end_date", kind.alias("kind"))
    return out.withColumn("status", F.when(F.col("kind") == "equal", "passed").when(F.col("kind") == "unknown", "manual_review").when(F.col("kind") == "extra", "warning").otherwise("failed"))


def stage_order(plan: DataFrame, other: DataFrame) -> DataFrame:
    """Whether both documents name their stages in the same order. Both: pk, seq, stage_no."""
    listed = lambda df: df.groupBy("pk").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "stage_no"))), lambda s: s["stage_no"]).alias("l"))
    both = listed(plan).join(listed(other).withColumnRenamed("l", "m"), "pk")
    return both.select("pk", F.size("l").alias("n_plan"), F.size("m").alias("n_other"), verdict(F.lit(True), F.col("l") == F.col("m")).alias("status"))


def stage_contradictions(inline: DataFrame, tabled: DataFrame) -> DataFrame:
    """Stages that a text and a table of one document give different ends, or that only one has. Both: pk, stage_no, end_date."""
    o = tabled.select("pk", "stage_no", F.col("end_date").alias("table_end"), F.lit(True).alias("_t"))
    both = inline.select("pk", "stage_no", F.col("end_date").alias("text_end"), F.lit(True).alias("_i")).join(o, ["pk", "stage_no"], "full")
    kind = F.when(F.col("_t").isNull(), "text_only").when(F.col("_i").isNull(), "table_only").when(F.col("text_end") != F.col("table_end"), "different_end")
    return both.select("pk", "stage_no", "text_end", "table_end", kind.alias("kind")).where("kind is not null")


def merge_stages(tabled: DataFrame, texts: DataFrame, fields: list[str]) -> DataFrame:
    """Table stages with blanks filled from text stages; text stages are added only where the table has none at all."""
    o = texts.select("pk", "stage_no", *[F.col(f).alias(f"_{f}") for f in fields])
    filled = tabled.join(o, ["pk", "stage_no"], "left").select("pk", "stage_no", *[F.coalesce(f, f"_{f}").alias(f) for f in fields], F.lit("table").alias("origin"))
    rest = texts.join(tabled.select("pk").distinct(), "pk", "left_anti").select("pk", "stage_no", *fields, F.lit("text").alias("origin"))
    return filled.unionByName(rest)


def dedupe_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def longer_list(first: DataFrame, second: DataFrame, key: str = "pk") -> DataFrame:
    """All rows of the longer of two lists of each key, of equal ones the first. Both have the same columns."""
    n = lambda df, c: df.groupBy(key).agg(F.count("*").alias(c))
    sizes = n(first, "n1").join(n(second, "n2"), key, "full").select(key, (F.coalesce("n1", F.lit(0)) >= F.coalesce("n2", F.lit(0))).alias("_first"))
    pick = lambda df, which: df.join(sizes.where(F.col("_first") == which), key, "left_semi")
    return pick(first, True).unionByName(pick(second, False))


def reconcile_attachments(listed: DataFrame, files: DataFrame, shared_tokens: int = 2) -> DataFrame:
    """Listed attachments against files, one to one: first by type in order, then by shared title tokens.

    Both: pk, seq, kind, tokens (array). All typed matches are made before any by title. Result: pk, side, seq, kind,
    how ('type', 'title', 'missing' or 'extra').
    """
    numbered = lambda df: df.withColumn("_n", F.row_number().over(W.partitionBy("pk", "kind").orderBy("seq")))
    a, b = numbered(listed), numbered(files)
    typed = a.where("kind is not null").alias("a").join(b.alias("b"), ["pk", "kind", "_n"]).select("pk", F.col("a.seq").alias("seq"), F.col("b.seq").alias("file_seq"))
    left = a.join(typed.select("pk", "seq"), ["pk", "seq"], "left_anti")
    right = b.join(typed.select("pk", F.col("file_seq").alias("seq")), ["pk", "seq"], "left_anti")
    common = F.size(F.array_intersect("a.tokens", "b.tokens"))
    met = left.alias("a").join(right.alias("b"), "pk").where(common >= shared_tokens).select("pk", F.col("a.seq").alias("seq"), F.col("b.seq").alias("file_seq"), common.alias("n"))
    best = met.withColumn("_a", F.row_number().over(W.partitionBy("pk", "seq").orderBy(F.desc("n"), "file_seq"))).withColumn("_b", F.row_number().over(W.partitionBy("pk", "file_seq").orderBy(F.desc("n"), "seq")))
    titled = best.where("_a = 1 and _b = 1").select("pk", "seq", "file_seq")
    mark = lambda df, how: df.select("pk", F.lit("listed").alias("side"), "seq", F.lit(how).alias("how"))
    missing = left.join(titled.select("pk", "seq"), ["pk", "seq"], "left_anti")
    extra = right.join(titled.select("pk", F.col("file_seq").alias("seq")), ["pk", "seq"], "left_anti")
    return mark(typed, "type").unionByName(mark(titled, "title")).unionByName(mark(missing, "missing")).unionByName(extra.select("pk", F.lit("file").alias("side"), "seq", F.lit("extra").alias("how")))


def contract_attachments(referenced: DataFrame, present: DataFrame) -> DataFrame:
    """Kinds of attachments that a contract refers to and whether the package has data of that kind. Both: pk, kind."""
    has = present.select("pk", "kind", F.lit(True).alias("_has")).distinct()
    both = referenced.select("pk", "kind").distinct().join(has, ["pk", "kind"], "left")
    return both.select("pk", "kind", F.when(F.col("_has"), "passed").otherwise("failed").alias("status"))


def occurrences(facts: DataFrame, roles: list[str]) -> DataFrame:
    """Fields by documents: how many different values of a field each role has."""
    once = facts.dropDuplicates(["pk", "field", "role", "norm"])
    return once.groupBy("pk", "field").pivot("role", roles).agg(F.count(F.lit(1))).na.fill(0)


def offer_summary(offers: DataFrame, items: DataFrame, requisites: list[str]) -> DataFrame:
    """Missing requisites, number of items, and warnings of each offer (pk, offer)."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    missing = F.array_compact(F.array(*[F.when(blank(c), F.lit(c)) for c in requisites]))
    n = items.groupBy("pk", "offer").agg(F.count("*").alias("n_items"))
    both = offers.join(n, ["pk", "offer"], "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))
    warn = F.array_compact(F.array(F.when(F.size(missing) > 0, F.lit("requisites")), F.when(F.col("n_items") == 0, F.lit("no items"))))
    return both.select("pk", "offer", F.array_join(missing, ",").alias("missing"), "n_items", F.array_join(warn, ",").alias("warnings"))


def registry_rollup(codes: DataFrame, matches: DataFrame) -> DataFrame:
    """Codes of each document by what the registry said: matched, not matched, error. ``matches``: code, found."""
    both = codes.select("pk", "role", "code").distinct().join(matches.select("code", "found"), "code", "left")
    of = lambda cond, name: F.count_if(cond).alias(name)
    return both.groupBy("pk", "role").agg(of(F.col("found"), "n_matched"), of(~F.col("found"), "n_unmatched"), of(F.col("found").isNull(), "n_error"))


def classify_fields(raw: DataFrame, negatives: list[str]) -> DataFrame:
    """Each raw field: empty, negative (an explicit no) or filled."""
    value = F.lower(F.trim(F.col("value")))
    kind = F.when(value.isNull() | (value == ""), "empty").when(value.isin(negatives), "negative").otherwise("filled")
    return raw.withColumn("kind", kind)


def field_completeness(raw: DataFrame, negatives: list[str]) -> DataFrame:
    """Counts of the kinds by package; an empty field fails the check."""
    n = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    out = classify_fields(raw, negatives).groupBy("pk").agg(n("empty"), n("negative"), n("filled"))
    return out.withColumn("status", F.when(F.col("n_empty") > 0, "failed").otherwise("passed"))


def field_value(raw: DataFrame, markers: list[str]) -> DataFrame:
    """The first filled value whose key has one of the markers, by package."""
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.contains(F.lower("key"), F.lit(m))
    return raw.where(hit & (F.trim("value") != "")).groupBy("pk").agg(F.min_by("value", "seq").alias("value"))


def route_points(points: DataFrame, keywords: list[str], text: Column) -> DataFrame:
    """Points with a keyword go to the exact branch, the others to retrieval."""
    low, hit = F.lower(text), F.lit(False)
    for k in keywords:
        hit = hit | F.contains(low, F.lit(k))
    return points.withColumn("route", F.when(hit, "exact").otherwise("retrieval"))
