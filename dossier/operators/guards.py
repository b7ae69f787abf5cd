"""Guards of semantic decisions that find out themselves what contradicts a decision, from the fields of the documents.

``fields``: pk, role, field, value (the first filled value of a role and field counts). Each guard looks at the decisions
of its own check only; a null or empty value is no value, and decisions of other checks stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import to_bool

# Documents in the order in which their values are compared, and how their texts are read.
PLACE_ROLES, METHOD_ROLES = ["plan", "ooz", "contract"], ["plan", "request", "explanatory_note"]
HOUSE = r"(?iu)(?<![а-яa-z])(?:д(?:ом)?\.?)\s*(\d+[а-яa-z]?)"
STREET = r"(?iu)(?:ул[.]?|улица)\s*([^,;.]+)"
CITY = r"(?iu)(?:город|г[.]?)\s+([а-яёa-z-]+)"
METHODS = [
    (["электрон", "магазин"], "single_supplier"), (["аукцион"], "auction"), (["auction"], "auction"), (["конкурс"], "tender"), (["tender"], "tender"),
    (["котиров"], "request_for_quotations"), (["quotation"], "request_for_quotations"), (["единственн"], "single_supplier"), (["single_supplier"], "single_supplier"),
]
EXPLICIT_TERM = r"(?<![\p{L}\p{N}_])\d+\s*(?:\([^)]*\)\s*)?(?:месяц|год|лет)|(?<![\p{L}\p{N}_])до\s+\d{1,2}[./]\d{1,2}[./]\d{2,4}"


def house_numbers(c: Column) -> Column:
    """The house numbers of an address, without leading zeros, in order; an empty array where it has none."""
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(HOUSE), F.lit(1)), lambda x: F.regexp_replace(F.lower(x), r"^0+(?=\d)", ""))
    return F.array_sort(F.array_distinct(found))


def street_and_city(c: Column) -> Column:
    """struct(street, city) of an address, each null if it isn't named; the last city counts."""
    none = lambda x: F.nullif(x, F.lit(""))
    street = F.regexp_extract(F.coalesce(c, F.lit("")), STREET, 1)
    street = F.lower(F.regexp_replace(F.regexp_replace(street, r"\s+", " "), r"^[ .]+|[ .]+$", ""))
    cities = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(CITY), F.lit(1))
    return F.struct(none(street).alias("street"), none(F.lower(F.get(cities, F.size(cities) - 1))).alias("city"))


def method_kind(c: Column) -> Column:
    low = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ё"), F.lit("е"))
    return F.coalesce(*[F.when(reduce(lambda a, b: a & b, [F.contains(low, F.lit(m)) for m in ms]), F.lit(kind)) for ms, kind in METHODS])


def plain(c: Column) -> Column:
    """Lower case with single blanks; null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(F.translate(c, " ", " ")), r"\s+", " ")), F.lit(""))


def reference_only(c: Column) -> Column:
    """Whether a text points at a description or annex and names no term of its own."""
    t = F.coalesce(plain(c), F.lit(""))
    return F.contains(t, F.lit("указан")) & (F.contains(t, F.lit("описани")) | F.contains(t, F.lit("приложени"))) & ~t.rlike(EXPLICIT_TERM)


def _place(given: Column, values: list[Column]) -> Column:
    each = [F.struct(house_numbers(v).alias("houses"), street_and_city(v).alias("core"), v.alias("value")) for v in values]
    filled = F.filter(F.array(*each), lambda x: x["value"].isNotNull())
    housed = F.filter(filled, lambda x: F.size(x["houses"]) > 0)
    base = F.get(housed, F.lit(0))["houses"]
    conflict = F.exists(housed, lambda x: ~F.arrays_overlap(x["houses"], base))
    one = lambda part: (F.size(F.array_distinct(F.transform(filled, lambda x: x["core"][part]))) == 1) & F.forall(filled, lambda x: x["core"][part].isNotNull())
    return F.when(F.size(housed) < 2, given).when(conflict, "failed").when(one("street") & one("city"), "passed").otherwise(given)


def _method(given: Column, values: list[Column]) -> Column:
    kinds = F.array_distinct(F.array_compact(F.array(*[method_kind(v) for v in values])))
    return F.when(F.size(kinds) > 1, "failed").when((F.size(kinds) == 1) & F.get(kinds, F.lit(0)).isin("auction", "single_supplier"), "passed").otherwise(given)


def guard_decisions(decisions: DataFrame, fields: DataFrame) -> DataFrame:
    """pk, check_id, given, status, overridden of each decision (pk, check_id, status).

    ``delivery_place``: house numbers that have nothing in common with the first document's fail; where they agree,
    one street and one city pass. ``warranty``: a pass is for manual review if the contract names no term but a reference.
    ``procurement_method``: different kinds fail, auctions and single suppliers pass. ``smp_preferences``: decided by
    the plan alone. ``delivery_term``: equal terms of description and contract pass.
    """
    wanted = [(r, "delivery_place") for r in PLACE_ROLES] + [(r, "procurement_method") for r in METHOD_ROLES] + [("contract", "warranty"), ("annex", "warranty"), ("plan", "smp_preference"), ("plan", "subcontract_required"), ("ooz", "delivery_term"), ("contract", "delivery_term")]
    name = lambda r, f: f"{r}.{f}"
    value = lambda r, f: F.col(f"`{name(r, f)}`")
    filled = fields.where(F.trim("value") != "")
    facts = filled.groupBy("pk").agg(*[F.min(F.when((F.col("role") == r) & (F.col("field") == f), F.col("value"))).alias(name(r, f)) for r, f in wanted])
    given, check = F.col("given"), F.col("check_id")
    prefers, required = to_bool(value("plan", "smp_preference")), F.coalesce(to_bool(value("plan", "subcontract_required")), F.lit(False))
    bare = value("annex", "warranty").isNull() & (value("contract", "warranty").isNull() | reference_only(value("contract", "warranty")))
    same_term = F.coalesce(plain(value("ooz", "delivery_term")) == plain(value("contract", "delivery_term")), F.lit(False))
    status = (
        F.when(check == "delivery_place", _place(given, [value(r, "delivery_place") for r in PLACE_ROLES])).when(check == "procurement_method", _method(given, [value(r, "procurement_method") for r in METHOD_ROLES]))
        .when(check == "warranty", F.when((given == "passed") & bare, "manual_review").otherwise(given)).when(check == "delivery_term", F.when(same_term, "passed").otherwise(given))
        .when(check == "smp_preferences", F.when(prefers.isNull() | (~prefers & required), "warning").otherwise("passed")).otherwise(given)
    )
    both = decisions.select("pk", "check_id", F.col("status").alias("given")).join(facts, "pk", "left")
    return both.select("pk", "check_id", "given", status.alias("status"), (~status.eqNullSafe(given)).alias("overridden"))
