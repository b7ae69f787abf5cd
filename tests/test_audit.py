"""The fused audit: a package that passes every check, one change each, and one scan of each fact table."""

import datetime as dt
import re

import pytest

from dossier.operators import audit as op

D = dt.date
SCHEMAS = {
    "packages": "pk string, amount long, end_date date, extra_present boolean",
    "files": "pk string, role string",
    "fields": "pk string, role string, field string, value string",
    "amounts": "pk string, role string, amount long",
    "rows": "pk string, seq int, qty long, price long, total long",
    "prices": "pk string, seq int, source string, qty long, price long, total long, declared long, declared_min long",
    "offers": "pk string, offer int, number string, date date, supplier string, total long",
    "offer_rows": "pk string, offer int, qty long, price long, total long, declared long",
    "items": "pk string, role string, key string, qty long, unit string",
    "codes": "pk string, kind string, role string, code string",
    "stages": "pk string, role string, stage_no string, end_date date, price long",
    "attachments": "pk string, side string, kind string",
    "securities": "pk string, kind string, amount long, percent decimal(9,4), exempt boolean",
    "clauses": "pk string, party string, kind string, stated decimal(18,4)",
    "sections": "pk string, text string",
}
TERMS = """Обязан привлечь СМП и СОНКО в объеме 25 (двадцать пять) процентов. Декларацию и копии договоров в течение 5 рабочих дней.
При замене документы в течение 5 дней. В течение 10 рабочих дней со дня оплаты платежные документы и документы о приемке.
Оплачивает в течение 7 рабочих дней после приемки. Гражданско-правовая ответственность за непривлечение. Вправе осуществлять замену соисполнителя."""


def base():
    """200 roubles for two cartridges at 100, three suppliers; one stage."""
    from decimal import Decimal as N

    roles = ["plan", "request", "onmck", "ooz", "contract", "explanatory_note"]
    texts = ["subject", "delivery_place", "delivery_term", "payment", "acceptance", "warranty", "funding", "required", "percent", "ban", "restriction", "advantage"]
    suppliers = (("s1", 10_000), ("s2", 12_000), ("s3", 11_000))
    return {
        "packages": [(20_000, D(2024, 12, 31), False)],
        "files": [(r,) for r in roles] + [("commercial_offer",)] * 3,
        "fields": [(r, f, "Картридж " + f) for r in ("plan", "contract") for f in texts],
        "amounts": [(r, 20_000) for r in roles[:5]],
        "rows": [(1, 2, 10_000, 20_000)],
        "prices": [(1, s, 2, p, 2 * p, 2 * p, 10_000) for s, p in suppliers],
        "offers": [(i, f"12-{i}", D(2024, 5, i), s, 2 * p) for i, (s, p) in enumerate(suppliers, 1)],
        "offer_rows": [(i, 2, p, 2 * p, 2 * p) for i, (_, p) in enumerate(suppliers, 1)],
        "items": [(r, "картридж", 2, "шт") for r in ("plan", "onmck", "ooz")],
        "codes": [(k, r, c) for k, c in (("okpd2", "20.59.12.120"), ("ktru", "20.59.12.120-00000002")) for r in ("plan", "onmck", "ooz")],
        "stages": [(r, "1", D(2024, 12, 1), 20_000) for r in ("plan", "contract")],
        "attachments": [(side, k) for side in ("listed", "file") for k in ("onmck", "ooz")],
        "securities": [("bid", 20_000, N(1), False), ("performance", 20_000, N(10), False), ("warranty", 20_000, N(5), False)],
        "clauses": [("supplier", "value", N(10)), ("supplier", "non_value", N(1000)), ("customer", "non_value", N(1000))],
        "sections": [(TERMS,), (None,)],
    }


def run(spark, packages, checks=None):
    """{pk: {check: status}} of whole packages in the form of ``base``."""
    made = {name: spark.createDataFrame([(pk, *row) for pk, p in packages.items() for row in p[name]], schema) for name, schema in SCHEMAS.items()}
    out = {pk: {} for pk in packages}
    for r in op.audit(made.pop("packages"), made, checks or op.standard_checks()).collect():
        assert r.check_id not in out[r.pk]
        out[r.pk][r.check_id] = r.status
    return out


def swap(table, i, **new):
    def change(p):
        names = [c.split()[0] for c in SCHEMAS[table].split(", ")][1:]
        row = dict(zip(names, p[table][i])) | new
        p[table][i] = tuple(row[n] for n in names)

    return change


def drop(table, i):
    return lambda p: p[table].pop(i)


def add(table, *row):
    return lambda p: p[table].append(row)


# a change and the checks that it turns; all others stay as they are
CHANGES = [
    (drop("files", 0), {"completeness.plan": "failed"}),
    (drop("files", 8), {"completeness.offers": "manual_review"}),
    (swap("amounts", 1, amount=20_001), {"amounts.equal": "failed"}),
    (swap("amounts", 0, amount=None), {"amounts.plan": "manual_review"}),
    (swap("rows", 0, total=19_999), {"rows.arithmetic": "failed", "rows.sum": "failed"}),
    (swap("rows", 0, total=None), {"rows.arithmetic": "manual_review", "rows.sum": "manual_review"}),
    (swap("prices", 0, price=9_999), {"prices.minimum": "failed", "prices.rows": "failed"}),
    (swap("prices", 1, price=30_000, total=60_000, declared=60_000), {"prices.variation": "failed", "prices.totals_variation": "failed"}),
    (swap("prices", 2, price=None), {"prices.offers": "manual_review", "prices.rows": "manual_review"}),
    (swap("prices", 0, declared=1), {"prices.source_totals": "failed"}),
    (swap("offers", 0, number=" "), {"offers.requisites": "failed"}),
    (swap("offer_rows", 0, total=1), {"offers.rows": "failed", "offers.totals": "failed"}),
    (drop("codes", 2), {}),
    (add("codes", "okpd2", "plan", "31.01.12"), {"codes.okpd2": "failed"}),
    (add("codes", "ktru", "ooz", "31.01.12-1"), {"codes.ktru": "warning"}),
    (swap("items", 1, qty=3), {"items.qty": "failed"}),
    (swap("items", 1, unit=None), {"items.unit": "manual_review"}),
    (swap("stages", 1, end_date=D(2024, 12, 2)), {"stages.ends": "failed"}),
    (swap("stages", 1, end_date=None), {"stages.ends": "manual_review"}),
    (drop("stages", 1), {"stages.present": "failed", "stages.ends": "not_applicable"}),
    (add("stages", "contract", "2", D(2024, 12, 1), 1), {"stages.present": "warning"}),
    (swap("packages", 0, end_date=D(2024, 11, 30)), {"stages.term": "failed"}),
    (add("stages", "plan", "1", D(2024, 12, 1), 1), {"stages.prices": "failed"}),
    (drop("attachments", 3), {"attachments.files": "failed"}),
    (add("attachments", "file", "other"), {"attachments.files": "warning"}),
    (swap("fields", 0, value="иное"), {"texts.subject": "failed"}),
    (swap("fields", 0, value="  КАРТРИДЖ   Subject и бумага"), {}),
    (swap("fields", 6, value="-"), {"texts.funding": "manual_review"}),
    (swap("fields", 8, value="30"), {"subcontract.percent": "failed"}),
    (swap("fields", 9, value=None), {"regime.ban": "manual_review", "schedule.fields": "failed"}),
    (swap("securities", 0, percent=2), {"security.bid": "failed"}),
    (swap("securities", 0, percent=2, amount=2_000_000_001), {}),
    (swap("securities", 1, exempt=True), {"security.performance": "manual_review"}),
    (drop("securities", 2), {"security.warranty": "not_applicable"}),
    (swap("packages", 0, extra_present=True), {"requirements.extra": "failed"}),
    (swap("packages", 0, extra_present=None), {"requirements.extra": "manual_review"}),
    (swap("clauses", 0, stated=5), {"penalty.supplier.value": "failed"}),
    (drop("clauses", 2), {"penalty.customer.non_value": "manual_review"}),
    (swap("sections", 0, text=TERMS.replace("процентов", "долей")), {"clause.duty_with_share": "failed"}),
    (swap("sections", 0, text=TERMS.replace("непривлечение", "просрочку")), {"clause.liability": "failed"}),
]


def test_a_sound_package_and_one_change_each(spark):
    from decimal import Decimal

    packages = {"sound": base()}
    for k, (change, _) in enumerate(CHANGES):
        packages[f"change {k}"] = base()
        change(packages[f"change {k}"])
        for table in ("securities", "clauses"):
            packages[f"change {k}"][table] = [tuple(Decimal(x) if n in ("percent", "stated") and x is not None else x for n, x in zip([c.split()[0] for c in SCHEMAS[table].split(", ")][1:], row)) for row in packages[f"change {k}"][table]]
    got = run(spark, packages)
    sound = got.pop("sound")
    assert len(sound) == len(op.standard_checks()) and set(sound.values()) == {"passed"}, {c: s for c, s in sound.items() if s != "passed"}
    for k, (_, want) in enumerate(CHANGES):
        assert {c: s for c, s in got[f"change {k}"].items() if s != "passed"} == want, (k, want)


def test_a_package_without_facts_and_no_packages(spark):
    empty = {name: [] for name in SCHEMAS} | {"packages": [(None, None, None)]}
    got = run(spark, {"bare": empty})["bare"]
    assert {c for c, s in got.items() if s == "failed"} == {f"completeness.{r}" for r in op.REQUIRED}
    assert {c for c, s in got.items() if s == "not_applicable"} == {"stages.present", "stages.ends", "stages.term", "stages.prices", "security.bid", "security.performance", "security.warranty"}
    assert set(got.values()) == {"failed", "not_applicable", "manual_review"}
    assert run(spark, {}) == {}


@pytest.mark.parametrize("given", [["prices", "files"], list(SCHEMAS)[1:]])
def test_each_fact_table_is_scanned_once(spark, tmp_path, given):
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
    read = {name: spark.read.parquet(str(tmp_path / name)) for name in SCHEMAS}
    found = op.audit(read["packages"], {n: read[n] for n in given}, op.standard_checks())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[", plan)) == len(given) + 1
    assert "Window" not in plan and "collect" not in plan


def test_findings_from_elsewhere_are_added(spark):
    packages = spark.createDataFrame([("a", 1, None, None)], SCHEMAS["packages"])
    one = spark.createDataFrame([("a", "external.status", "passed", "info", None, None, None)], "pk string, check_id string, status string, severity string, expected string, actual string, details string")
    rows = op.audit(packages, {}, op.standard_checks(), [one]).collect()
    assert {(r.check_id, r.section) for r in rows} == {("requirements.extra", "rules"), ("external.status", "external")}
