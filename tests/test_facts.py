"""Facts of documents by anchors: expected values typed by hand, brute force over random rules, and time against their number."""

import datetime as dt
import random
import time
from decimal import Decimal

from dossier.operators import facts as op

DOCS, PAIRS = "doc_id long, doc_type string, text string, raw string", "doc_id long, doc_type string, seq int, name string, value string"
CONTRACT = "КОНТРАКТ № 17-А\n\n1. Предмет контракта\nПоставка  картриджей\nСрок исполнения контракта\nСрок исполнения контракта :\t до 31.12.2024\nМесто поставки: г. Москва: ул. Мира, 5\nСрок поставки: \nв течение 10 дней"


def run(spark, docs, pairs=()):
    rows = op.document_facts(spark.createDataFrame([(*d, "x") for d in docs], DOCS), spark.createDataFrame(list(pairs), PAIRS)).collect()
    return {(r.doc_id, r.field): r for r in rows}, rows


def test_lines(spark):
    got, rows = run(spark, [(1, "contract", CONTRACT), (2, "commercial_offer", "ООО Ромашка\nИсх. № 5 от 01.02.2024\nНДС: 20 %\nАванс: нет"), (3, None, CONTRACT), (4, "contract", None), (5, "contract", "\n \n"), (6, "other", CONTRACT), (7, "onmck", "метод")])
    assert {r.doc_id for r in rows} == {1, 2, 7}
    value = lambda d, f: (got[d, f].way, got[d, f].ord, got[d, f].raw)
    # without a colon the next line; a last line stands for itself; what follows the first colon counts, with later ones
    assert value(1, "number") == ("after", 0, "1. Предмет контракта")
    assert value(1, "subject") == ("after", 1, "Поставка картриджей")
    assert value(1, "contract_term") == ("value", 4, "до 31.12.2024") and got[1, "contract_term"].date == dt.date(2024, 12, 31)
    assert value(1, "delivery_place") == ("after", 5, "г. Москва: ул. Мира, 5")
    assert value(1, "delivery_term") == ("after", 6, "в течение 10 дней") and got[1, "delivery_term"].date is None
    assert value(2, "outgoing_number")[2] == value(2, "outgoing_date")[2] == "НДС: 20 %"
    assert got[2, "vat"].percent == Decimal("20.00") and got[2, "vat"].amount is None and value(2, "advance")[2] == "нет"
    assert value(7, "method") == ("after", 0, "метод")


def test_keys_and_their_priority(spark):
    pairs = [(1, "plan", 3, "СОНКО, субподряд", "да, 15 %"), (1, "plan", 5, "Процент привлечения", "не менее 25,5 %"), (1, "plan", 1, "НМЦК", "1 200,50 руб."), (1, "plan", 2, "Начальная цена", "7 руб."), (1, "plan", 4, None, "x"), (1, "plan", 6, "Национальный режим", None)]
    pairs += [(2, "plan", 3, "субподряд СОНКО", "нет, 15 %"), (3, "contract", 1, "НМЦК", "1 руб.")]
    got, rows = run(spark, [], pairs)
    assert got[1, "nmck"].raw == "1 200,50 руб." and got[1, "nmck"].amount == Decimal("1200.50")
    assert got[1, "subcontract"].flag is True and got[2, "subcontract"].flag is False
    # the way of the percent comes before that of the clause, wherever it stands
    assert got[1, "subcontract_percent"].percent == Decimal("25.50") and got[2, "subcontract_percent"].percent == Decimal("15.00")
    assert got[1, "national_regime"].raw is None and got[1, "national_regime"].norm == ""
    assert not [r for r in rows if r.doc_id == 3]


def naive(text, doc_type, rules):
    lines = [" ".join(x.split()) for x in text.split("\n") if x.split()]
    out = set()
    for r, rule in enumerate(rules):
        for w, (way, anchors) in enumerate(rule.ways):
            for k, line in enumerate(lines):
                tail = line.split(":", 1)[1].strip() if ":" in line else ""
                if rule.doc_type == doc_type and any(a in line.lower() for a in anchors) and (tail or way == "after"):
                    out.add((r, w, k, tail or (lines[k + 1] if k + 1 < len(lines) else line)))
                    break
    return out


def test_against_brute_force():
    random.seed(4)
    word = lambda: "".join(random.choice("abA ") for _ in range(random.randint(1, 3))).strip() or "a"
    for _ in range(400):
        rules = [op.Rule("t", str(i), tuple((random.choice(["after", "value"]), tuple(word().lower() for _ in range(random.randint(1, 3)))) for _ in range(random.randint(1, 2)))) for i in range(6)]
        text = "".join(random.choice("abAB :\n\t") for _ in range(random.randint(0, 60)))
        assert set(op.read_text(text, "t", op.Anchors(rules, ("after", "value")), rules)) == naive(text, "t", rules)


def test_time_does_not_follow_the_number_of_rules():
    random.seed(5)
    text = "\n".join(" ".join("".join(random.choice("абвгд") for _ in range(6)) for _ in range(12)) for _ in range(20_000))
    spent = {}
    for n in (10, 3000):
        rules = [op.Rule("t", str(i), (("after", (f"якорь {i} ю",)),)) for i in range(n)]
        anchors = op.Anchors(rules, ("after",))
        start = time.perf_counter()
        op.read_text(text, "t", anchors, rules)
        spent[n] = time.perf_counter() - start
    assert spent[3000] < 3 * spent[10] + 0.2
