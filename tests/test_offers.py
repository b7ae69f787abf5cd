"""Offers in a text layer: expected rows typed by hand."""

import datetime as dt
from decimal import Decimal as D

from dossier.operators import extraction as op

TEXT = """  05.06.2024 № 12-3/КП \r
ооо  «Ромашка и Ко» Предлагает товары
1.1
Картридж
 лазерный, № реестровой записи 1234 ,
товарный  знак HP 85A
Шт.
2
1 200,50
20
2 401,00
Раздел два

1.2
Бумага
усл. ед
10
5
без НДС
50
2.10
Без единицы
3
4
5
6
2.11
комплект
1
нет
20
5
3.1
Стол
компл
1
7
0
7,00
Сумма коммерческого  предложения составляет: 2 458,00 руб.
шт
1
1
1
1
Срок поставки товара: 10 дней
"""
DOC = "doc_id long, text string, name string"


def test_rows(spark):
    docs = spark.createDataFrame([(1, TEXT, "x"), (2, None, "x"), (3, "", "x"), (4, "1.1", "x"), (5, "шт\n1\n2\n3\n4", "x"), (6, "1.1\nшт\n1\n2\n3\n4", "x")], DOC)
    got = {(r.doc_id, r.row_number): r for r in op.offer_text_rows(docs).collect()}
    assert set(got) == {(1, "1.1"), (1, "1.2"), (1, "3.1"), (6, "1.1")}
    a, b, c = got[1, "1.1"], got[1, "1.2"], got[1, "3.1"]
    assert (a.name, a.trademark, a.unit, a.notes) == ("Картридж лазерный,  , товарный знак HP 85A", "HP 85A", "Шт.", ["№ реестровой записи 1234"])
    assert (a.qty, a.price, a.vat_text, a.vat_rate, a.total) == (D(2), D("1200.50"), "20", D(20), D("2401.00"))
    assert (b.name, b.trademark, b.unit, b.qty, b.vat_text, b.vat_rate, b.total) == ("Бумага", None, "усл. ед", D(10), "без НДС", None, D(50))
    assert (c.name, c.vat_rate, c.total, c.ord) == ("Стол", D(0), D(7), 4)
    assert got[6, "1.1"].name == ""


def test_odd_lines(spark):
    """Blanks and line ends of every kind, units among other signs, sums before the last item, numbers before a unit."""
    body = "\n1\n2\n20\n4"
    texts = [
        "\u00a01.1\u00a0\r\n\t x\x0b\x0c \r \t a \t b\rШ-Т ." + body, "1.1\n(усл.) Ёд:" + body, "1.1\nКшт" + body, "1.1\nкомплекты" + body, "1.1\nшт\nшт" + body,
        "1.1\nСумма коммерческого предложения\nшт" + body + "\n1.2\nсумма  коммерческого\u00a0предложения:\nшт" + body, "1.1\n😀 № реестровой записи 1\nшт" + body, "1.1\nшт\n1\n2\n20",
        "1.1\n1.2\nшт" + body, "1.1.1\nшт" + body, "1.1\n" + "a\n" * 50000 + "шт" + body, " " * 100000 + "1.1\nшт" + body,
    ]
    got = {(r.doc_id, r.ord): r for r in op.offer_text_rows(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert sorted(got) == [(0, 0), (1, 0), (5, 0), (6, 0), (8, 1), (10, 0), (11, 0)]
    assert [(got[k, 0].name, got[k, 0].unit) for k in (0, 1, 6)] == [("x a b", "Ш-Т ."), ("", "(усл.) Ёд:"), ("😀", "шт")]
    assert got[5, 0].name == "Сумма коммерческого предложения" and got[6, 0].notes == ["№ реестровой записи 1"] and len(got[10, 0]["name"]) == 99999


def test_items_are_cut_once(spark):
    """The pattern of a unit stands once in the plan: a filter on the rows had it (and the lines) worked out for each use."""
    rows = op.offer_text_rows(spark.createDataFrame([(1, TEXT, "x")], DOC))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^а-яa-z]") + plan.count(op._UNIT[-20:]) == 1


def test_requisites(spark):
    docs = spark.createDataFrame([(1, TEXT, "x"), (2, None, "x"), (3, "32.13.2024 № 5\nбез НДС", "x")], DOC)
    got = {r.doc_id: r for r in op.offer_requisites(docs).collect()}
    a = got[1]
    assert (a.number, a.date, a.supplier, a.total, a.term, a.vat_text) == ("12-3/КП", dt.date(2024, 6, 5), "ооо «Ромашка и Ко»", D("2458.00"), "10 дней", "mixed")
    assert set(got[2].asDict().values()) == {2, None}
    assert (got[3].number, got[3].date, got[3].vat_text) == ("5", None, "exempt")
