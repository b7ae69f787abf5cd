"""All checks of a package in one findings table: a declarative registry, fused into one scan of each fact table.

A check names its fact table, the aggregates that it needs of it, and what has to hold of them. All checks of one table
share a single aggregation: those of plain rows are columns of it, those of groups inside a package (items, sources,
stages, codes) are further grouping sets of the same scan, folded to the package in a second step. The tables are then
joined by package, and every check becomes one finding of each package. Nothing is collected but sums, so a package
may have any number of rows.

Fact tables (columns that the standard checks use; a table that isn't given leaves its checks out):

* ``files``: pk, role
* ``fields``: pk, role, field, value
* ``amounts``: pk, role, amount
* ``rows`` (price justification): pk, seq, qty, price, total, declared (least price as declared)
* ``prices``: pk, seq, source, qty, price, total, declared (total as declared for the source)
* ``offers``: pk, offer, number, date, supplier, total
* ``offer_rows``: pk, offer, qty, price, total, declared (total as declared for the offer)
* ``items``: pk, role, key, qty, unit
* ``codes``: pk, kind, role, code
* ``stages``: pk, role, stage_no, end_date, price
* ``attachments``: pk, side (``listed`` or ``file``), kind
* ``securities``: pk, kind, amount, percent, exempt
* ``clauses``: pk, party, kind, stated
* ``sections``: pk, text

and packages: pk, amount, end_date, extra_present. Nulls: a check whose operands are missing is manual_review, never
failed; a null key (seq, source and so on) is a group of its own. A package without rows in a table has its findings too.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rules
from .findings import FIELDS, severity
from .prices import VARIATION_LIMIT


@dataclass(frozen=True)
class Check:
    """One finding for each package. Texts are SQL; ``{x}`` stands for the measure x, other names are columns of packages.

    ``measures`` are single aggregate calls over the rows of ``table`` (those where ``where`` holds), or, if ``by`` is
    given, over its groups, of which ``parts`` are the aggregates. The status is not_applicable unless ``applies``,
    manual_review unless ``known``, passed if ``good``, warning if ``doubt``, and else failed.
    """

    id: str
    section: str
    known: str
    good: str
    table: str | None = None
    measures: dict[str, str] = field(default_factory=dict)
    where: str | None = None
    by: tuple[str, ...] = ()
    parts: dict[str, str] = field(default_factory=dict)
    applies: str | None = None
    doubt: str | None = None
    expected: str | None = None
    actual: str | None = None


def _named(sql: str, prefix: str) -> str:
    return re.sub(r"\{(\w+)\}", rf"`{prefix}\1`", sql)


def _filtered(sql: str, *conditions: str | None) -> str:
    given = [f"({c})" for c in conditions if c]
    return f"{sql} FILTER (WHERE {' AND '.join(given)})" if given else sql


def _aggregated(df: DataFrame, checks: dict[int, Check]) -> DataFrame:
    """One row for each package with the measures of all checks of one fact table, ``c<number>_<measure>`` each."""
    plain = {k: c for k, c in checks.items() if not c.by}
    grouped = {k: c for k, c in checks.items() if c.by}
    own = [F.expr(_filtered(sql, c.where)).alias(f"c{k}_{name}") for k, c in plain.items() for name, sql in c.measures.items()]
    if not grouped:
        return df.groupBy("pk").agg(*own)
    columns = sorted({x for c in grouped.values() for x in c.by})
    sets = sorted({c.by for c in grouped.values()})
    number = {by: n for n, by in enumerate([*sets, ()] if plain else sets)}
    own = [F.expr(_filtered(sql, c.where, f"_set = {number[()]}")).alias(f"c{k}_{name}") for k, c in plain.items() for name, sql in c.measures.items()]
    parts = [F.expr(_filtered(sql, c.where, f"_set = {number[c.by]}")).alias(f"p{k}_{name}") for k, c in grouped.items() for name, sql in c.parts.items()]
    # grouping sets by hand: the rows stay where their package is, so a table that is dealt by package isn't shuffled
    keys = [F.when(F.col("_set").isin([n for by, n in number.items() if x in by]), F.col(f"`{x}`")).alias(f"_by_{x}") for x in columns]
    every = df.select("*", F.explode(F.array(*map(F.lit, number.values()))).alias("_set"))
    each = every.groupBy("pk", "_set", *keys).agg(*parts, *own)
    folded = [F.expr(_filtered(_named(sql, f"p{k}_"), f"_set = {number[c.by]}")).alias(f"c{k}_{name}") for k, c in grouped.items() for name, sql in c.measures.items()]
    kept = [F.expr(_filtered(f"max(`c{k}_{name}`)", f"_set = {number[()]}")).alias(f"c{k}_{name}") for k, c in plain.items() for name in c.measures]
    return each.groupBy("pk").agg(*folded, *kept)


def _finding(k: int, c: Check, wanted: list[str]) -> str:
    sql = lambda x: _named(x, f"c{k}_")
    cases = [f"WHEN NOT coalesce({sql(c.applies)}, false) THEN 'not_applicable'"] if c.applies else []
    cases += [f"WHEN NOT coalesce({sql(c.known)}, false) THEN 'manual_review'", f"WHEN coalesce({sql(c.good)}, false) THEN 'passed'"]
    cases += [f"WHEN coalesce({sql(c.doubt)}, false) THEN 'warning'"] if c.doubt else []
    text = lambda x: f"CAST({sql(x)} AS STRING)" if x else "CAST(NULL AS STRING)"
    details = f"to_json(named_struct({', '.join(f"'{m}', `c{k}_{m}`" for m in c.measures)}))" if c.measures else "CAST(NULL AS STRING)"
    fields = {"check_id": f"'{c.id}'", "section": f"'{c.section}'", "status": f"CASE {' '.join(cases)} ELSE 'failed' END", "expected": text(c.expected), "actual": text(c.actual), "details": details}
    return f"named_struct({', '.join(f"'{n}', {x}" for n, x in fields.items() if n in wanted)})"


def audit(packages: DataFrame, tables: dict[str, DataFrame], checks: list[Check], others: list[DataFrame] = (), columns: list[str] = (*FIELDS, "section"), apart: bool = False) -> DataFrame:
    """The findings of all checks whose fact table is given, and those of ``others`` (tables of findings from elsewhere).

    Only the named columns are worked out: Spark doesn't leave out unused fields of rows that it unfolds. Packages and
    tables that are dealt by pk into the same number of parts are grouped and joined without a shuffle; if each table then
    meets the packages ``apart``, these are read as often, but a task holds the sorts of one table only.
    """
    used = {k: c for k, c in enumerate(checks) if c.table is None or c.table in tables}
    unfolded = lambda wide, own: wide.select(F.col("pk").cast("string").alias("pk"), F.expr(f"inline(array({', '.join(_finding(k, c, [*columns, 'status']) for k, c in own.items())}))"))
    wide, each = packages, [unfolded(packages, own)] if apart and (own := {k: c for k, c in used.items() if c.table is None}) else []
    for name in tables:
        if own := {k: c for k, c in used.items() if c.table == name}:
            met = (packages if apart else wide).join(_aggregated(tables[name], own), "pk", "left")
            if apart:
                each.append(unfolded(met, own))
            wide = met
    out = reduce(DataFrame.unionByName, each or [unfolded(wide, used)]).withColumn("severity", severity(F.col("status"))).select(*columns)
    for more in others:
        out = out.unionByName(more.select(*FIELDS, F.lit("external").alias("section")).select(*columns))
    return out


def _bands(bands: list[tuple], amount: str, value: int) -> str:
    """The value of the band (above, upto, ...) of an amount, as SQL."""
    cases = []
    for band in bands:
        above, upto = band[0], band[1]
        holds = " AND ".join([f"{amount} > {above}"] * (above is not None) + [f"{amount} <= {upto}"] * (upto is not None)) or "true"
        cases.append(f"WHEN {amount} IS NOT NULL AND {holds} THEN {band[value]}")
    return f"CASE {' '.join(cases)} END"


def completeness(required: list[str], offer_role: str = "commercial_offer", min_offers: int = 3) -> list[Check]:
    out = [Check(f"completeness.{role}", "documents", "true", "coalesce({n}, 0) > 0", "files", {"n": "count(*)"}, f"role = '{role}'", actual="coalesce({n}, 0)") for role in required]
    few = Check("completeness.offers", "documents", f"coalesce({{n}}, 0) >= {min_offers}", "true", "files", {"n": "count(*)"}, f"role = '{offer_role}'", expected=str(min_offers), actual="coalesce({n}, 0)")
    return [*out, few, Check("schedule.fields", "documents", "{n} > 0", "{n_blank} = 0", "fields", {"n": "count(*)", "n_blank": "count_if(coalesce(trim(value), '') = '')"}, "role = 'plan'", actual="{n_blank}")]


def agreement(name: str, section: str = "texts", base: str = "plan", other: str = "contract", text: bool = True) -> Check:
    """A field of two documents: equal, or (a text) one inside the other; letters' case and runs of spaces don't count."""
    of = lambda role: f"min(CASE WHEN role = '{role}' THEN nullif(trim(regexp_replace(lower(value), '\\\\s+', ' ')), '') END)"
    good = "contains({a}, {b}) OR contains({b}, {a})" if text else "{a} = {b}"
    return Check(f"{section}.{name}", section, "{a} IS NOT NULL AND {b} IS NOT NULL", good, "fields", {"a": of(base), "b": of(other)}, f"field = '{name}'", expected="{a}", actual="{b}")


def amounts() -> list[Check]:
    return [
        Check("amounts.equal", "amounts", "{n} >= 2", "{low} = {high}", "amounts", {"n": "count({least})", "low": "min({least})", "high": "max({most})"}, by=("role",), parts={"least": "min(amount)", "most": "max(amount)"}, expected="{low}", actual="{high}"),
        Check("amounts.plan", "amounts", "{a} IS NOT NULL AND amount IS NOT NULL", "{a} = amount", "amounts", {"a": "max(amount)"}, "role = 'plan'", expected="amount", actual="{a}"),
    ]


def price_rows() -> list[Check]:
    return [
        Check("rows.arithmetic", "prices", "{n} > 0 AND {n_unknown} = 0", "{n_wrong} = 0", "rows", {"n": "count(*)", "n_unknown": "count_if(qty IS NULL OR price IS NULL OR total IS NULL)", "n_wrong": "count_if(qty * price <> total)"}, actual="{n_wrong}"),
        Check("rows.sum", "prices", "{n} > 0 AND {n_unknown} = 0 AND amount IS NOT NULL", "{s} = amount", "rows", {"n": "count(*)", "n_unknown": "count_if(total IS NULL)", "s": "sum(total)"}, expected="amount", actual="{s}"),
    ]


def supplier_prices(limit: float = VARIATION_LIMIT, least_offers: int = 3) -> list[Check]:
    spread = lambda dev, mean, n: f"{n} >= 2 AND {mean} <> 0"
    return [
        Check("prices.offers", "prices", f"{{least}} >= {least_offers}", "true", "prices", {"least": "min({n})"}, by=("seq",), parts={"n": "count(price)"}, expected=str(least_offers), actual="{least}"),
        Check("prices.minimum", "prices", "{n} > 0 AND {n_unknown} = 0", "{n_wrong} = 0", "prices", {"n": "count(*)", "n_unknown": "count_if({least} IS NULL OR {said} IS NULL)", "n_wrong": "count_if({least} <> {said})"}, by=("seq",), parts={"least": "min(price)", "said": "max(declared_min)"}, actual="{n_wrong}"),
        Check("prices.variation", "prices", "{n} > 0 AND {n_unknown} = 0", "{n_high} = 0", "prices", {"n": "count(*)", "n_unknown": f"count_if(NOT ({spread('{dev}', '{mean}', '{n}')}))", "n_high": f"count_if({spread('{dev}', '{mean}', '{n}')} AND {{dev}} / {{mean}} * 100 >= {limit})"}, by=("seq",), parts={"n": "count(price)", "mean": "avg(price)", "dev": "stddev_samp(price)"}, actual="{n_high}"),
        Check("prices.rows", "prices", "{n_unknown} = 0", "{n_wrong} = 0", "prices", {"n_unknown": "count_if(qty IS NULL OR price IS NULL OR total IS NULL)", "n_wrong": "count_if(qty * price <> total)"}, actual="{n_wrong}"),
        Check("prices.source_totals", "prices", "{n} > 0 AND {n_unknown} = 0", "{n_wrong} = 0", "prices", {"n": "count(*)", "n_unknown": "count_if({gaps} > 0 OR {said} IS NULL)", "n_wrong": "count_if({own} <> {said})"}, by=("source",), parts={"gaps": "count_if(coalesce(total, qty * price) IS NULL)", "own": "sum(coalesce(total, qty * price))", "said": "max(declared)"}, actual="{n_wrong}"),
        Check("prices.totals_variation", "prices", "{n} >= 2 AND {gaps} = 0 AND {mean} <> 0", f"{{dev}} / {{mean}} * 100 < {limit}", "prices", {"n": "count({own})", "gaps": "sum({gaps})", "mean": "avg({own})", "dev": "stddev_samp({own})"}, by=("source",), parts={"gaps": "count_if(coalesce(total, qty * price) IS NULL)", "own": "sum(coalesce(total, qty * price))"}, expected=str(limit)),
    ]


def offers(requisites: tuple[str, ...] = ("number", "date", "supplier", "total")) -> list[Check]:
    blank = " OR ".join(f"coalesce(trim(CAST({c} AS STRING)), '') = ''" for c in requisites)
    return [
        Check("offers.requisites", "offers", "{n} > 0", "{n_blank} = 0", "offers", {"n": "count(*)", "n_blank": f"count_if({blank})"}, actual="{n_blank}"),
        Check("offers.rows", "offers", "{n} > 0 AND {n_unknown} = 0", "{n_wrong} = 0", "offer_rows", {"n": "count(*)", "n_unknown": "count_if(qty IS NULL OR price IS NULL OR total IS NULL)", "n_wrong": "count_if(qty * price <> total)"}, actual="{n_wrong}"),
        Check("offers.totals", "offers", "{n} > 0 AND {n_unknown} = 0", "{n_wrong} = 0", "offer_rows", {"n": "count(*)", "n_unknown": "count_if({gaps} > 0 OR {said} IS NULL)", "n_wrong": "count_if({own} <> {said})"}, by=("offer",), parts={"gaps": "count_if(coalesce(total, qty * price) IS NULL)", "own": "sum(coalesce(total, qty * price))", "said": "max(declared)"}, actual="{n_wrong}"),
    ]


def codes(kind: str, base: str = "plan") -> Check:
    """The codes of all other documents against those of the base: a missing one fails, one more is a warning."""
    measures = {"n": "count_if({own} > 0)", "n_missing": "count_if({own} > 0 AND {rest} = 0)", "n_extra": "count_if({own} = 0 AND {rest} > 0)"}
    parts = {"own": f"count_if(role = '{base}')", "rest": f"count_if(role <> '{base}')"}
    return Check(f"codes.{kind}", "codes", "{n} > 0", "{n_missing} = 0 AND {n_extra} = 0", "codes", measures, f"kind = '{kind}'", ("code",), parts, doubt="{n_missing} = 0", expected="{n}", actual="{n_missing}")


def item_values() -> list[Check]:
    """Quantity and unit of the items that more than one document has, by key."""
    out = []
    for value in ("qty", "unit"):
        parts = {"n": "count(*)", "known": f"count({value})", "low": f"min({value})", "high": f"max({value})"}
        measures = {"n": "count_if({n} > 1)", "n_unknown": "count_if({n} > 1 AND {known} < {n})", "n_wrong": "count_if({n} > 1 AND {low} <> {high})"}
        out.append(Check(f"items.{value}", "items", "{n} > 0 AND {n_unknown} = 0", "{n_wrong} = 0", "items", measures, "key IS NOT NULL", ("key",), parts, actual="{n_wrong}"))
    return out


def stages(base: str = "plan", other: str = "contract") -> list[Check]:
    end = lambda role: f"max(CASE WHEN role = '{role}' THEN end_date END)"
    parts = {"own": f"count_if(role = '{base}')", "rest": f"count_if(role = '{other}')", "a": end(base), "b": end(other)}
    both = "{own} > 0 AND {rest} > 0"
    return [
        Check("stages.present", "stages", "true", "{n_missing} = 0 AND {n_extra} = 0", "stages", {"n": "count_if({own} > 0)", "n_missing": "count_if({own} > 0 AND {rest} = 0)", "n_extra": "count_if({own} = 0 AND {rest} > 0)"}, by=("stage_no",), parts=parts, applies="{n} > 0", doubt="{n_missing} = 0", expected="{n}", actual="{n_missing}"),
        Check("stages.ends", "stages", "{n_unknown} = 0", "{n_wrong} = 0", "stages", {"n": f"count_if({both})", "n_unknown": f"count_if({both} AND ({{a}} IS NULL OR {{b}} IS NULL))", "n_wrong": f"count_if({both} AND {{a}} <> {{b}})"}, by=("stage_no",), parts=parts, applies="{n} > 0", actual="{n_wrong}"),
        Check("stages.term", "stages", "end_date IS NOT NULL AND {n_open} = 0", "{last} <= end_date", "stages", {"n": "count(*)", "n_open": "count_if(end_date IS NULL)", "last": "max(end_date)"}, f"role = '{base}'", applies="{n} > 0", expected="end_date", actual="{last}"),
        Check("stages.prices", "stages", "amount IS NOT NULL AND {n_open} = 0", "{s} = amount", "stages", {"n": "count(*)", "n_open": "count_if(price IS NULL)", "s": "sum(price)"}, f"role = '{base}'", applies="{n} > 0", expected="amount", actual="{s}"),
    ]


def attachments() -> Check:
    measures = {"n": "count_if({listed} > 0)", "n_missing": "count_if({listed} > {filed})", "n_extra": "count_if({listed} < {filed})"}
    return Check("attachments.files", "documents", "{n} > 0", "{n_missing} = 0 AND {n_extra} = 0", "attachments", measures, by=("kind",), parts={"listed": "count_if(side = 'listed')", "filed": "count_if(side = 'file')"}, doubt="{n_missing} = 0", expected="{n}", actual="{n_missing}")


def securities(unit: int = 100) -> list[Check]:
    """Percents of each kind within the band of their amount; ``unit``: minor units of money in a rouble."""
    out = []
    for kind in dict.fromkeys(k for k, *_ in rules.SECURITY_BANDS):
        bands = [(a and a * unit, b and b * unit, lo, hi) for k, a, b, lo, hi in rules.SECURITY_BANDS if k == kind]
        wrong = f"percent < {_bands(bands, 'amount', 2)} OR percent > {_bands(bands, 'amount', 3)}"
        measures = {"n": "count(*)", "n_exempt": "count_if(exempt)", "n_unknown": "count_if(amount IS NULL OR percent IS NULL)", "n_wrong": f"count_if({wrong})", "least": "min(percent)"}
        out.append(Check(f"security.{kind}", "rules", "{n_exempt} = 0 AND {n_unknown} = 0", "{n_wrong} = 0", "securities", measures, f"kind = '{kind}'", applies="{n} > 0", actual="{least}"))
    return out


def penalties(unit: int = 100) -> list[Check]:
    """What a clause of the party and kind states against the band of the amount."""
    out = []
    scaled = lambda table: [(a and a * unit, b and b * unit, x) for a, b, x in table]
    for party, kind, table in (("supplier", "value", rules.PENALTY_PERCENTS), ("supplier", "non_value", rules.PENALTY_AMOUNTS), ("customer", "non_value", rules.PENALTY_AMOUNTS)):
        due = _bands(scaled(table), "amount", 2)
        measures = {"low": "min(stated)", "high": "max(stated)"}
        out.append(Check(f"penalty.{party}.{kind}", "rules", "amount IS NOT NULL AND {low} IS NOT NULL", f"{{low}} = {due} AND {{high}} = {due}", "clauses", measures, f"party = '{party}' AND kind = '{kind}'", expected=due, actual="{low}"))
    return out


def mandatory_clauses() -> list[Check]:
    """Clauses of mandatory subcontracting that some section of the contract has."""
    from .rule_tables import MANDATORY_CLAUSES, clause_sql

    return [Check(f"clause.{name}", "rules", "{n} > 0", "{has}", "sections", {"n": "count(text)", "has": f"bool_or({clause_sql('text', groups)})"}) for name, groups in MANDATORY_CLAUSES]


def extra_requirements(limit: int = rules.EXTRA_REQUIREMENTS_FROM, unit: int = 100) -> Check:
    return Check("requirements.extra", "rules", "amount IS NOT NULL AND extra_present IS NOT NULL", f"extra_present = (amount > {limit * unit})", actual="extra_present")


def funding(placeholders: tuple[str, ...] = ("-", "нет", "не указано", "unknown")) -> Check:
    c = agreement("funding", text=False)
    unclear = ", ".join(f"'{p}'" for p in placeholders)
    return Check(c.id, c.section, f"{c.known} AND {{a}} NOT IN ({unclear}) AND {{b}} NOT IN ({unclear})", c.good, c.table, c.measures, c.where, expected=c.expected, actual=c.actual)


#: Documents that a package has to have.
REQUIRED = ["plan", "request", "onmck", "ooz", "contract", "explanatory_note"]


def standard_checks(unit: int = 100) -> list[Check]:
    """All built checks; ``unit``: minor units of money in a rouble."""
    texts = [agreement(x) for x in ("subject", "delivery_place", "delivery_term", "payment", "acceptance", "warranty")]
    shares = [agreement(x, "subcontract", text=False) for x in ("required", "percent")]
    regime = [agreement(x, "regime", text=False) for x in ("ban", "restriction", "advantage")]
    return [
        *completeness(REQUIRED), attachments(), *amounts(), *price_rows(), *supplier_prices(), *offers(), codes("okpd2"), codes("ktru"), *item_values(),
        *stages(), funding(), *texts, *shares, *regime, *securities(unit), extra_requirements(unit=unit), *penalties(unit), *mandatory_clauses(),
    ]
