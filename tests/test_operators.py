"""Operators on small frames: the statuses that one changed field leads to, and nulls that are never a failure."""

from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from dossier.functions import text as fn
from dossier.operators import catalogue, compare, findings, match, merge, prices, retrieval, rule_tables, rules, sections, tables
from dossier.operators.retrieval import bm25_topk


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture
def three_prices(spark):
    return spark.createDataFrame([(1, 1, "a", 100, 200), (1, 2, "b", 120, 240), (1, 3, "c", 110, 220)], "pk int, seq int, source string, price long, total long").withColumn("qty", F.lit(2))


def test_min_price_and_variation(spark, three_prices):
    assert rows(prices.min_price(three_prices), "min_price", "min_source") == [(100, "a")]
    assert rows(prices.price_variation(three_prices), "cv", "status") == [(9.0909, "passed")]


def test_variation_needs_two_prices_and_a_mean(spark):
    one = spark.createDataFrame([(1, 5), (2, 0), (2, 0), (3, None)], "pk int, price long")
    assert rows(prices.price_variation(one), "pk", "cv", "status") == [(1, None, "manual_review"), (2, None, "manual_review")]


def test_wrong_minimum_fails_and_missing_is_for_review(spark, three_prices):
    said = spark.createDataFrame([(1, 110), (2, 5)], "pk int, declared long")
    assert rows(prices.min_price(three_prices, said), "pk", "status") == [(1, "failed"), (2, "manual_review")]


def test_row_sum_counts_only_when_all_rows_are_known(spark):
    items = spark.createDataFrame([(1, 2, 100, 200), (1, 1, 50, None), (2, 2, 100, 200), (3, 2, 100, 201)], "pk int, qty long, price long, total long")
    declared = spark.createDataFrame([(1, 250), (2, 200), (3, 201), (4, 1)], "pk int, amount long")
    got = rows(prices.reconcile_rows(items, declared), "pk", "row_sum", "row_status", "sum_status")
    assert got == [(1, None, "manual_review", "manual_review"), (2, 200, "passed", "passed"), (3, 201, "failed", "passed"), (4, None, "manual_review", "manual_review")]


def test_proven_aggregate_goes_once(spark):
    items = spark.createDataFrame([(1, 0, 1, 10), (1, 0, 2, 20), (1, 0, 3, 30), (2, 0, 1, 10), (2, 0, 2, 20), (2, 0, 3, 31)], "pk int, offer int, seq int, total long")
    offers = spark.createDataFrame([(1, 0, 30), (2, 0, 31)], "pk int, offer int, offer_total long")
    assert rows(prices.drop_proven_aggregate(items, offers), "pk", "seq") == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)]


def test_unpriced_rows_stay_where_fewer_than_two_are_priced(spark):
    items = spark.createDataFrame([(1, 0, 1, 5), (1, 0, 2, 6), (1, 0, 3, None), (2, 0, 1, 5), (2, 0, 2, None)], "pk int, offer int, seq int, total long").withColumn("price", F.lit(None).cast("long"))
    assert rows(prices.drop_unpriced_rows(items), "pk", "seq") == [(1, 1), (1, 2), (2, 1), (2, 2)]


@pytest.mark.parametrize("included, vat, status", [(True, 2000, "passed"), (False, 2400, "passed"), (True, 2400, "failed"), (None, 2000, "manual_review")])
def test_vat(spark, included, vat, status):
    offer = spark.createDataFrame([(12000, 20, vat, included)], "total long, rate long, vat long, included boolean")
    assert rows(prices.vat_check(offer, F.lit(False)), "status") == [(status,)]
    assert rows(prices.vat_check(offer, F.lit(True)), "status") == [("passed",)]


@pytest.mark.parametrize("kind, amount, percent, status", [("bid", 20_000_000, "1", "passed"), ("bid", 20_000_000, "2", "failed"), ("bid", 20_000_001, "5", "passed"), ("performance", 50_000_000, "0.5", "passed"), ("performance", 50_000_001, "5", "failed"), ("warranty", 1, "10", "passed"), ("warranty", 1, "10.5", "failed"), ("bid", None, "1", "manual_review")])
def test_security_bands(spark, kind, amount, percent, status):
    fact = spark.createDataFrame([(1, kind, amount, D(percent), False)], "pk int, kind string, amount long, percent decimal(9,4), exempt boolean")
    assert rows(rules.security_bands(fact, rules.security_band_table(spark)), "status") == [(status,)]


@pytest.mark.parametrize("amount, percent, fixed", [(3_000_000, "10", 1000), (3_000_001, "5", 5000), (100_000_000, "1", 10000), (600_000_000, "0.4", 100000), (20_000_000_000, "0.1", 100000)])
def test_penalty_bands(spark, amount, percent, fixed):
    facts = spark.createDataFrame([(1, amount)], "pk int, amount long")
    clauses = spark.createDataFrame([(1, 1, "value", D(percent), None), (1, 2, "non_value", None, fixed)], "pk int, seq int, kind string, percent decimal(9,4), fixed long")
    assert rows(rules.penalty_check(clauses, facts, rules.penalty_table(spark)), "status") == [("passed",), ("passed",)]


def test_stages(spark):
    schema = "pk int, stage_no int, start_date date, end_date date, term_text string"
    day = date(2024, 5, 1)
    plan = spark.createDataFrame([(1, 1, None, day, None), (1, 2, None, None, "10 days"), (1, 3, None, None, None), (1, 4, None, day, None)], schema)
    other = spark.createDataFrame([(1, 1, None, date(2024, 5, 2), None), (1, 2, None, None, "within 10 days"), (1, 3, None, day, None)], schema)
    assert rows(compare.compare_stages(plan, other), "stage_no", "kind", "status") == [(1, "different", "failed"), (2, "equal", "passed"), (3, "unknown", "manual_review"), (4, "missing", "failed")]


def test_cascade_never_guesses_between_equal_names(spark):
    def side(data):
        return spark.createDataFrame(data, "pk int, seq int, ktru string, okpd2 string, name_norm string, qty int, price int, unit string").withColumn("tokens", fn.name_tokens(F.col("name_norm"))).withColumn("marks", F.array(F.lit("zzz")))

    left = side([(1, 1, "k1", None, "red round ring", 1, 5, "u"), (1, 2, None, "c", "blue long bolt", 2, 6, "u"), (1, 3, None, None, "type alpha", 9, 7, "u"), (1, 4, None, None, "type beta", 8, 7, "u")])
    right = side([(1, 1, None, "c", "blue long bolt extra", 3, 6, "u"), (1, 2, "k1", None, "else", 4, 5, "u"), (1, 3, None, None, "first thing", 5, 7, "u"), (1, 4, None, None, "other thing", 6, 7, "u")])
    assert rows(match.match_items(left, right), "l", "r", "how") == [(1, 2, "ktru"), (2, 1, "okpd2")]


def test_ordered_rest_matches_only_if_all_rows_agree(spark):
    def side(names):
        return spark.createDataFrame([(1, i, None, None, n, q, p, "u") for i, (n, q, p) in enumerate(names)], "pk int, seq int, ktru string, okpd2 string, name_norm string, qty int, price int, unit string").withColumn("tokens", fn.name_tokens(F.col("name_norm"))).withColumn("marks", F.array().cast("array<string>"))

    a = side([("aaa", 1, 10), ("bbb", 1, 11)])
    assert rows(match.match_items(a, side([("ccc", 1, 10), ("ddd", 1, 11)])), "l", "r") == [(0, 0), (1, 1)]
    assert rows(match.match_items(a, side([("ccc", 1, 10), ("ddd", 1, 12)])), "l", "r") == []


def test_prefix_lookup_order(spark):
    got = spark.range(1).select(match.prefix_candidates(F.lit("31.01.12.190")).alias("c")).first().c
    assert got == ["31.01.12.190", "31.01.12.1", "31.01.12.19", "31.01.12", "31.01.1", "31.01", "31.0"]
    ref = spark.createDataFrame([("31.01",), ("13.20.11",)], "code string")
    codes = spark.createDataFrame([("31.01.12",), ("13.20",), ("99.99",), ("x",)], "code string")
    assert rows(match.prefix_lookup(codes, ref), "code", "candidate", "ref_code", "exact") == [("13.20", "13.20", "13.20.11", False), ("31.01.12", "31.01", "31.01", True), ("99.99", None, None, None), ("x", None, None, None)]


def test_characteristics(spark):
    known = spark.createDataFrame([("k", "Цвет", ["Черный"], True, None), ("k", "Ресурс", ["<= 70"], True, None)], "code string, name string, allowed array<string>, required boolean, unit string")
    chars = spark.createDataFrame([(1, 1, "k", "Цвет", "Белый", None), (1, 2, "k", "Pecypc", "65", None), (1, 3, "k", "Вес", "1", None)], "pk int, seq int, code string, name string, value string, unit string")
    assert rows(catalogue.validate_chars(chars, known), "seq", "status") == [(1, "failed"), (2, "passed"), (3, "extra")]
    items = spark.createDataFrame([(1, 1, "k")], "pk int, seq int, code string")
    assert rows(catalogue.missing_required(chars, items, known), "name") == [("Ресурс",)]


def test_text_functions(spark):
    row = spark.range(1).select(
        fn.norm_text(F.lit("«Ёлка»  И Ко.")).alias("norm"), fn.extract_money(F.lit("цена 1 234 руб. 5 коп. и 99")).alias("money"), F.array_join(fn.extract_dates(F.lit("от 05.06.2024, 31.02.2024 и 7 мая 2023")).cast("array<string>"), ",").alias("dates"),
        fn.to_decimal(F.lit("1 234,50 р")).alias("d"), fn.to_money(F.lit(D("2.345"))).alias("m"), fn.in_range(F.lit(D(65)), F.lit("<= 70")).alias("r"), fn.fold_homoglyphs(F.lit("Pecypc")).alias("f"), F.array_join(fn.short_codes(F.lit("20.59.12.120-00000002 и 13.20")), ",").alias("s"),
    ).first()
    assert (row.norm, row.money, row.dates, row.d, row.m, row.r, row.f, row.s) == ("елка и ко", D("1234.05"), "2024-06-05,2023-05-07", D("1234.500000"), D("2.34"), True, "Ресурс", "13.20")


def test_findings_keep_the_strongest_source_without_an_actual_value(spark):
    df = spark.createDataFrame([(1, 1, "r", "d", "llm", None), (1, 2, "r", "d", "external", None), (1, 3, "r", "d", "llm", "x"), (1, 4, "r", "d", "llm", "x")], "pk int, seq int, rule string, documents string, source string, actual string")
    assert rows(findings.merge_findings(df), "seq") == [(2,), (3,)]


def test_recovery(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (2, '{"a": "no", "b": "x"}'), (3, '{"a": 1}'), (4, "nonsense"), (5, None)], "pk int, j string")
    got = rows(merge.recover_json(df, "j", {"a": "int", "b": "string"}), "pk", "recovery", "issues")
    assert got == [(1, "validated", ""), (2, "recovered", "a"), (3, "partial", ""), (4, "failed", ""), (5, "failed", "")]


def test_chunks_pack_greedily(spark):
    blocks = spark.createDataFrame([(1, 0, "a" * 6), (1, 1, "a" * 5), (1, 2, "a" * 5), (1, 3, "a" * 30)], "doc_id long, ord int, text string")
    assert rows(sections.pack_chunks(blocks, 10), "ord", "chunk") == [(0, 0), (1, 1), (2, 1), (3, 2)]


def test_spans_round_trip(spark):
    cells = spark.createDataFrame([(1, "t", 0, 0, 2, 1, "x"), (1, "t", 0, 1, 1, 2, "y"), (1, "t", 1, 1, 1, 1, "z")], "doc_id int, table_id string, r int, c int, row_span int, col_span int, text string")
    cols = ("r", "c", "row_span", "col_span", "text")
    assert rows(tables.origin_cells(tables.dense_cells(cells)), *cols) == rows(cells, *cols)


def test_empty_tables_give_empty_results(spark, three_prices):
    none = three_prices.limit(0)
    assert prices.price_variation(none).count() == prices.supplier_totals(none).count() == prices.stage_rollup(none.withColumn("stage", F.lit(1))).where("level = 0").count() == 0
    queries = spark.createDataFrame([], "query_id long, text string")
    assert bm25_topk(spark.createDataFrame([(1, 0, "a")], "doc_id long, chunk int, text string"), queries, 3, ["doc_id", "chunk"]).count() == 0


def test_best_by_name_against_brute_force(spark):
    from difflib import SequenceMatcher

    names, refs = ["Red Bolt 5", "steel ring", "blue «pipe»", "x"], [(1, "red bolt 5"), (2, "Red Bolt 6"), (3, "ring of steel"), (4, "blue pipe"), (5, "pipe blue"), (6, "blue pipe")]
    pairs = spark.createDataFrame([(k, 1, i, a, b) for k, a in enumerate(names) for i, b in refs], "pk int, seq int, ref_id int, name string, ref_name string")
    norm = {t: spark.range(1).select(fn.norm_text(F.lit(t))).first()[0] for t in {*names, *(b for _, b in refs)}}

    def score(a, b):
        return round(100 * SequenceMatcher(None, norm[a], norm[b], autojunk=False).ratio(), 4) + 10 * (norm[a] == norm[b]) + 20 * (a == b)

    want = {k: min((-score(a, b), i) for i, b in refs) for k, a in enumerate(names)}
    assert {r.pk: (-r.score, r.ref_id) for r in match.best_by_name(pairs).collect()} == want


def test_vectors_in_blocks_are_those_of_one(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id int, embedding array<double>")
    queries = vectors.where("vec_id % 4 = 0")
    whole = sorted(map(tuple, retrieval.vector_topk(vectors, queries, 3).collect()))
    monkeypatch.setattr(retrieval, "QUERY_ROWS", 4)
    assert sorted(map(tuple, retrieval.vector_topk(vectors, queries, 3).collect())) == whole and len(whole) == 45


def test_packing_is_greedy(spark):
    import random

    random.seed(1)
    sizes = {k: [random.choice([0, 1, 3, 5, 12]) for _ in range(random.randint(1, 12))] for k in range(60)}
    want = []
    for k, ns in sizes.items():
        chunk = used = 0
        for o, n in enumerate(ns):
            if used and used + n > 10:
                chunk, used = chunk + 1, 0
            used += n
            want.append((k, o, chunk))
    blocks = spark.createDataFrame([(k, o, "x" * n) for k, ns in sizes.items() for o, n in enumerate(ns)], "doc_id long, ord int, text string")
    assert rows(sections.pack_chunks(blocks, 10), "doc_id", "ord", "chunk") == sorted(want)


def test_security_check_decides_before_the_band(spark):
    case = lambda pk, kind, amount, percent, method=None, note=None, required=True: (pk, kind, amount, percent, method, note, required)
    facts = [
        case(1, "bid", 100, "0.4", "auction"), case(2, "bid", 100, "1", "auction"), case(3, "bid", 100, "2", "auction"), case(4, "bid", 20_000_001, "2", "auction"), case(5, "bid", 100, "9", "single_supplier"),
        case(6, "bid", 100, "9", "auction", "penal_system"), case(7, "bid", 100, "9", None, None, False), case(8, "bid", None, "1"), case(9, "bid", 100, None), case(10, "bid", 100, "0"), case(11, "bid", 100, "0", "auction"),
        case(12, "performance", 50_000_000, "0.5"), case(13, "performance", 50_000_001, "5"), case(14, "warranty", None, "10", "single_supplier", "advance"), case(15, "warranty", None, "10.5"), case(16, "warranty", 1, None), case(17, "warranty", 1, "0"),
    ]
    df = spark.createDataFrame([(*f[:3], None if f[3] is None else D(f[3]), *f[4:]) for f in facts], "pk int, kind string, amount bigint, percent decimal(9,4), method string, note string, required boolean")
    got = {r.pk: r.status for r in rules.security_check(df, rules.security_band_table(spark)).collect()}
    want = "failed passed failed passed not_applicable manual_review passed manual_review manual_review manual_review failed passed failed passed failed manual_review passed"
    assert [got[k] for k in range(1, 18)] == want.split()


def test_penalties_decide_in_order(spark):
    """2,000,000 roubles: 10 % of the supplier, 1,000 roubles of the supplier without value and of the customer."""
    dues = [("supplier", "value", D(10)), ("supplier", "non_value", D(1000)), ("customer", "non_value", D(1000))]
    table = spark.createDataFrame([(p, k, None, 3_000_000, d) for p, k, d in dues], "party string, kind string, above bigint, upto bigint, due decimal(18,4)")
    clauses = {
        1: [("supplier", "value", 10), ("supplier", "non_value", 1000), ("customer", "other", 1000)],
        2: [("supplier", "value", 5), ("supplier", "non_value", 5000), ("customer", "non_value", 5000)],
        3: [], 4: [], 5: [("supplier", "value", 5), ("supplier", "non_value", 5000), ("customer", "non_value", 5000)], 6: [("supplier", "value", 5), ("supplier", "value", 10)],
    }
    texts = {4: "Штраф 10 процентов, штраф 1000 рублей", 5: "Штраф 10 процентов, штраф 1000 рублей"}
    facts = spark.createDataFrame([(k, 2_000_000) for k in clauses], "pk int, amount bigint")
    c = spark.createDataFrame([(k, p, kind, D(x)) for k, each in clauses.items() for p, kind, x in each], "pk int, party string, kind string, stated decimal(18,4)")
    s = spark.createDataFrame(list(texts.items()), "pk int, text string")
    got = {(r.pk, r.party, r.kind): r.status for r in rule_tables.penalties_by_party(facts, c, table, s).collect()}
    of = lambda k: [got[k, p, kind] for p, kind, _ in dues]
    assert of(1) == ["passed"] * 3
    assert of(2) == ["failed", "manual_review", "manual_review"]
    assert of(3) == ["failed", "manual_review", "failed"]
    assert of(4) == ["passed"] * 3
    # another percent fails whatever the text says, other fines give way to it
    assert of(5) == ["failed", "passed", "passed"]
    assert of(6) == ["passed", "manual_review", "failed"]


def test_other_penalties(spark):
    facts = spark.createDataFrame([(1, True), (2, True), (3, True), (4, True), (5, False), (6, None)], "pk int, required boolean")
    clauses = spark.createDataFrame([(1, "delay", None), (1, "subcontract", D(5)), (2, "subcontract", D(7))], "pk int, kind string, stated decimal(18,4)")
    texts = spark.createDataFrame([(3, "за непривлечение СМП штраф 5 (пять) процентов"), (4, "СМП, штраф 15 процентов")], "pk int, text string")
    got = {(r.pk, r.kind): r.status for r in rule_tables.other_penalties(facts, clauses, texts).collect()}
    assert [got[k, "subcontract"] for k in range(1, 7)] == ["passed", "manual_review", "passed", "failed", "not_applicable", "not_applicable"]
    assert [got[k, "delay"] for k in range(1, 4)] == ["passed", "manual_review", "manual_review"]


def test_price_columns_end_before_the_minimum(spark):
    """Headers of two suppliers without names, then the least price and the sum: no third supplier."""
    head = ["Наименование", "Количество", "Цена за ед.", "Стоимость", "Цена за ед.", "Стоимость", "Минимальная цена за единицу", "Сумма, руб."]
    for cut, end in ((8, 6), (6, None)):
        paths = spark.createDataFrame([(1, "t", c, h) for c, h in enumerate(["№ п/п", "Ед. изм.", *head[: cut]])], "doc_id int, table_id string, c int, path string")
        got = sorted((r.c, r.source, r.measure) for r in rule_tables.supplier_columns(paths).collect())
        assert got == ([(4, 1, "price"), (5, 1, "total"), (6, 2, "price"), (7, 2, "total")] if end else [])


def test_unknown_hint_and_share_in_words(spark):
    docs = spark.createDataFrame([("коммерческое предложение", "unknown"), ("коммерческое предложение", "plan"), ("коммерческое предложение", None)], "text string, hint string")
    assert [r.hint_conflict for r in rule_tables.document_types(docs, "text", hint="hint").collect()] == [False, True, False]
    texts = ["привлечь СМП, 25 процентов", "привлечь СМП, 25 (двадцать пять) %", "привлечь СМП, доля в %", "привлечь СМП, 12,5%"]
    clauses = spark.createDataFrame([(k, True, t) for k, t in enumerate(texts)], "pk int, required boolean, text string")
    got = {r.pk: r.status for r in rule_tables.mandatory_clauses(clauses).where("clause = 'duty_with_share'").collect()}
    assert [got[k] for k in range(4)] == ["passed", "passed", "failed", "passed"]


def test_a_million_blocks_are_packed(spark):
    """One document of many blocks, with a budget that each thousand meets exactly, and blocks larger than the budget."""
    blocks = spark.range(1_000_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("ord"), F.lit("x" * 10).alias("text"))
    got = sections.pack_chunks(blocks, 10_000).groupBy("chunk").agg(F.count("*").alias("n"), F.min("ord").alias("first"), F.max("ord").alias("last")).orderBy("chunk").collect()
    assert [(r.n, r.first, r.last) for r in got] == [(1000, 1000 * k, 1000 * k + 999) for k in range(1000)]
    some = spark.createDataFrame([(2, i, "x" * n if n is not None else None) for i, n in enumerate([0, 0, 50, 3, 7, None, 11, 10])], "doc_id long, ord int, text string")
    assert [r.chunk for r in sections.pack_chunks(some, 10).orderBy("ord").collect()] == [0, 0, 0, 1, 1, 1, 2, 3]
    assert "Pandas" not in sections.pack_chunks(some, 10)._jdf.queryExecution().executedPlan().toString()
