"""Guards of decisions: what overrides them is read from texts; expected values typed by hand."""

import pytest
from pyspark.sql import functions as F

from dossier.operators import guards as op

M, D, CITY = "г. Москва, ул. Мира", "passed", "Москва, ул. Мира"
CASES = [
    ("delivery_place", "passed", {"plan.delivery_place": f"{M}, д. 5", "contract.delivery_place": f"{M}, дом 6"}, "failed"),
    ("delivery_place", "failed", {"plan.delivery_place": f"{M}, д. 05А", "contract.delivery_place": "Город  МОСКВА; УЛ. мира , Дом 5а"}, "passed"),
    ("delivery_place", "manual_review", {"plan.delivery_place": f"{CITY}, д. 5", "contract.delivery_place": f"{M}, д.5"}, "manual_review"),
    ("delivery_place", "warning", {"plan.delivery_place": f"{M}, д. 5", "contract.delivery_place": f"{M}"}, "warning"),
    # the first document that has a house number is the base
    ("delivery_place", "passed", {"plan.delivery_place": M, "ooz.delivery_place": f"{M}, д. 1 и д. 2", "contract.delivery_place": f"{M}, д. 2"}, "passed"),
    ("delivery_place", "passed", {"plan.delivery_place": f"{M}, д. 1", "ooz.delivery_place": f"{M}, д. 1", "contract.delivery_place": f"{M}, д. 3"}, "failed"),
    # letters before the mark of a house are another word
    ("delivery_place", "passed", {"plan.delivery_place": "склад 5", "contract.delivery_place": "склад 6"}, "passed"),
    ("delivery_place", "failed", {}, "failed"),
    ("warranty", "passed", {"contract.warranty": "Срок указан в описании объекта закупки"}, "manual_review"),
    ("warranty", "passed", {"contract.warranty": "указан в приложении: 12 (двенадцать) месяцев"}, "passed"),
    ("warranty", "passed", {"contract.warranty": "указан в приложении, до 01.02.2025"}, "passed"),
    ("warranty", "passed", {"contract.warranty": " "}, "manual_review"),
    ("warranty", "passed", {"contract.warranty": "указан в описании", "annex.warranty": "год"}, "passed"),
    ("warranty", "failed", {}, "failed"),
    ("procurement_method", "passed", {"plan.procurement_method": "Электронный аукцион", "request.procurement_method": "Открытый конкурс"}, "failed"),
    ("procurement_method", "failed", {"plan.procurement_method": "Электронный аукцион", "request.procurement_method": "auction"}, "passed"),
    ("procurement_method", "failed", {"plan.procurement_method": "Электронный магазин", "explanatory_note.procurement_method": "у единственного поставщика"}, "passed"),
    ("procurement_method", "warning", {"plan.procurement_method": "запрос котировок"}, "warning"),
    ("procurement_method", "warning", {"plan.procurement_method": "иное"}, "warning"),
    ("smp_preferences", "failed", {"plan.smp_preference": "Не установлены", "plan.subcontract_required": "Да"}, "warning"),
    ("smp_preferences", "failed", {"plan.smp_preference": "Не установлены", "plan.subcontract_required": "нет"}, "passed"),
    ("smp_preferences", "failed", {"plan.smp_preference": "Установлены"}, "passed"),
    ("smp_preferences", "passed", {"plan.smp_preference": "?"}, "warning"),
    ("delivery_term", "failed", {"ooz.delivery_term": "10 дней", "contract.delivery_term": " 10   ДНЕЙ"}, "passed"),
    ("delivery_term", "failed", {"ooz.delivery_term": "10 дней", "contract.delivery_term": "11 дней"}, "failed"),
    ("delivery_term", "failed", {"ooz.delivery_term": "10 дней"}, "failed"),
    ("other", "failed", {"plan.delivery_place": f"{M}, д. 5"}, "failed"),
    ("warranty", None, {}, None),
]


@pytest.fixture(scope="module")
def got(spark):
    decisions = spark.createDataFrame([(k, c, s) for k, (c, s, _, _) in enumerate(CASES)], "pk int, check_id string, status string")
    fields = spark.createDataFrame([(k, *name.split("."), v) for k, (_, _, f, _) in enumerate(CASES) for name, v in f.items()] + [(0, None, None, None)], "pk int, role string, field string, value string")
    return {r.pk: r for r in op.guard_decisions(decisions, fields).collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_case(got, k):
    _, given, _, want = CASES[k]
    assert (got[k].given, got[k].status, got[k].overridden) == (given, want, given != want)


def test_house_numbers(spark):
    df = spark.createDataFrame([("д.5, дом 07б; Д 12 стр. 3, сад 9",), (None,)], "t string")
    assert [r[0] for r in df.select(op.house_numbers(F.col("t"))).collect()] == [["12", "5", "7б"], []]
