"""Fixed rule tables: document types, header names, table types, mandatory clauses and exceptions, and how they are applied.

Every rule is an expression of columns, so a table of documents, headers or grids is classified in one pass without a join.
Nulls count as empty texts; where no rule holds, the result says so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import small
from .match import large_groups, within

# Markers in the text (two points each), and in the file name (one point for a type, whichever it has).
DOCUMENT_MARKERS = [
    ("plan", ["заявка на внесение в план-график", "код позиции ктру"]),
    ("request", ["обращение о проведении закупки", "приложение:"]),
    ("commercial_offer", ["коммерческое предложение", "ценовое предложение"]),
    ("onmck", ["обоснование начальной", "определение цены контракта", "метод сопоставимых рыночных цен"]),
    ("ooz", ["описание объекта закупки", "функциональные, технические"]),
    ("contract", ["проект контракта", "предмет контракта", "контракт №"]),
    ("explanatory_note", ["пояснительная записка"]),
]
FILE_MARKERS = [
    ("plan", ["план", "заявка"]), ("request", ["обращение"]), ("commercial_offer", ["кп", "коммерч"]), ("onmck", ["онмцк", "оцк", "обоснован"]),
    ("ooz", ["ооз", "описание"]), ("contract", ["контракт"]), ("explanatory_note", ["поясн"]),
]
TEXT_POINTS, FILE_POINTS, HINT_POINTS = 2.0, 1.0, 1.25
# Header names and the markers that a header path must all have, in the order of the rules.
HEADERS = [
    ("stage_number", ["№", "этап"]), ("stage_number", ["номер", "этап"]), ("stage_result", ["результат", "этап"]),
    ("stage_start", ["дата начала", "этап"]), ("stage_start", ["начало", "этап"]),
    ("stage_service_term", ["срок оказания", "этап"]), ("stage_service_term", ["срок выполнения", "этап"]), ("stage_service_term", ["срок поставки", "этап"]),
    ("stage_service_term", ["период оказания", "этап"]), ("stage_service_term", ["период выполнения", "этап"]), ("stage_service_term", ["период поставки", "этап"]),
    ("stage_service_term", ["период исполнения", "этап"]), ("stage_service_term", ["срок предоставления", "этап"]),
    ("stage_end", ["дата окончания", "этап"]), ("stage_end", ["окончание", "этап"]),
    ("stage_price", ["цена этапа"]), ("stage_price", ["стоимость этапа"]), ("stage_price", ["сумма этапа"]),
    ("row_number", ["№", "номер", "п/п"]),
    ("characteristic_unit", ["единица измерения характерист"]), ("characteristic_value", ["значение"]), ("characteristic_name", ["характеристик"]),
    ("selected_min_unit_price", ["минимальная цена"]), ("okpd2_ktru", ["окпд", "ктру"]), ("okpd2_code", ["окпд"]), ("ktru_code", ["ктру"]),
    ("trademark_justification", ["обоснование", "товарн", "знак"]), ("trademark", ["товарн", "знак"]),
    ("quantity", ["количество"]), ("quantity", ["кол-во"]), ("quantity", ["кол-в"]), ("quantity", ["кол во"]),
    ("unit", ["единица измерения товара"]), ("unit", ["единица измерения"]), ("unit", ["ед. изм"]), ("unit", ["ед изм"]),
    ("unit_price", ["цена за ед"]), ("unit_price", ["цена за единицу"]),
    ("row_total", ["стоимость товаров"]), ("row_total", ["стоимость в руб"]), ("row_total", ["сумма"]), ("row_total", ["цена контракта"]), ("row_total", ["всего"]),
    ("vat_rate", ["ставка ндс"]), ("vat_amount", ["сумма ндс"]), ("name", ["наименование"]),
]
# Groups of which a stage table has two in its header, besides a stage number.
STAGE_DETAILS = [
    ["дата начала", "начало исполнения", "начало этапа"], ["срок оказания", "срок выполнения", "срок поставки", "период исполнения"],
    ["дата окончания", "окончание исполнения", "окончание этапа"], ["цена этапа", "стоимость этапа", "сумма этапа"],
    ["наименование этапа", "результат выполнения", "результат этапа"],
]
# What signatures have, and what a table of goods has that a table of signatures never does.
SIGNATURES = ["подпись", "расшифровка", "м.п.", "мп", "должность", "заказчик", "поставщик", "сдал", "принял"]
GOODS = ["окпд", "ктру", "количество", "кол-во", "кол-в", "цена товара", "цена за ед", "характеристик"]
GOODS_BESIDE_INITIALS = ["окпд", "ктру", "количество", "кол-во", "кол-в", "цена", "характеристик"]
SCHEDULE = ["наименование объекта закупки", "код позиции ктру", "начальная", "план-график"]
SPECIFICATION = [["спецификация", "цена за единицу", "сумма без ндс", "ставка ндс", "всего"], ["цена", "сумма", "ндс", "всего"]]
EMBEDDED_ITEMS = [["ктру", "окпд"], ["характеристик", "наименование товара", "наименование позиции", "требования"]]
EMBEDDED_ITEMS_NOT = ["цена за единицу", "сумма без ндс", "стоимость товаров"]
ATTACHED = ["заявка", "определение цены", "обоснование", "проект контракта", "описание объекта", "пояснительная", "коммерчес"]
# Fixed value: a share, as a number with a percent sign or word.
SHARE = r"\d+(?:[,.]\d+)?\s*(?:\([^)]*\)\s*)?(?:%|процент)"
# Clauses that a contract with mandatory subcontracting has, each as groups of which it has a marker of every one;
# a group that is a text is a pattern.
MANDATORY_CLAUSES = [
    ("duty_with_share", [["смп", "сонко", "субъектов малого предпринимательства", "социально ориентирован"], ["привлеч"], SHARE]),
    ("declaration_in_5_days", [["декларац"], ["копи"], ["договор"], ["5"], ["рабоч"]]),
    ("replacement_in_5_days", [["замен"], ["документ"], ["5"], ["дн"]]),
    ("acceptance_in_10_days", [["10"], ["рабоч"], ["оплат"], ["приемк"], ["платеж"]]),
    ("payment_in_7_days", [["оплач"], ["7"], ["рабоч"], ["приемк"]]),
    ("liability", [["ответственност", "гражданско-правов"], ["непривлеч", "непредставлен"]]),
    ("right_to_replace", [["осуществлять замену"], ["соисполн", "субподряд"]]),
]
# Marks in the fields of a plan beside which the bands of a security have exceptions.
SECURITY_EXCEPTIONS = [
    ("performance", r"аванс", "advance"), ("performance", r"казначейск", "treasury"),
    ("bid", r"уголовно-исполнитель", "penal_system"), ("bid", r"уис", "penal_system"), ("bid", r"организац.*инвалид", "disabled_persons"),
]


def low(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def any_of(c: Column, markers: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(m)) for m in markers])


def all_of(c: Column, markers: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.contains(c, F.lit(m)) for m in markers])


def first_rule(rules: list[tuple[Column, str]], default: Column | None = None) -> Column:
    """Label of the first rule (condition, label) that holds."""
    return F.coalesce(*[F.when(holds, F.lit(label)) for holds, label in rules], *([] if default is None else [default]))


def document_types(docs: DataFrame, text: str = "text", file_name: str | None = None, hint: str | None = None) -> DataFrame:
    """``docs`` with doc_type, confidence and hint_conflict: text markers, file markers and a hint (a type) score.

    confidence = min(0.99, 0.55 + 0.1 best + 0.05 (best - second)); a document without points is unknown. Of equal
    scores the type that comes first in the table counts. The hint ``unknown`` is none.
    """
    body, files = low(F.col(text)), dict(FILE_MARKERS)
    given = F.nullif(F.col(hint), F.lit("unknown")) if hint is not None else None
    stem = F.regexp_replace(low(F.element_at(F.split(F.col(file_name), r"[/\\]"), -1)), r"\.[^.]*$", "") if file_name else None
    points = []
    for k, (kind, markers) in enumerate(DOCUMENT_MARKERS):
        score = reduce(lambda a, b: a + b, [F.contains(body, F.lit(m)).cast("int") for m in markers]) * F.lit(TEXT_POINTS)
        if stem is not None:
            score = score + any_of(stem, files[kind]).cast("int") * F.lit(FILE_POINTS)
        if hint is not None:
            score = score + F.coalesce((given == kind).cast("int"), F.lit(0)) * F.lit(HINT_POINTS)
        points.append(F.struct(score.alias("score"), F.lit(-k).alias("place"), F.lit(kind).alias("kind")))
    ranked = F.sort_array(F.array(*points), False)
    best, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    known = best["score"] > 0
    confidence = F.round(F.least(F.lit(0.99), 0.55 + 0.1 * best["score"] + 0.05 * (best["score"] - second["score"])), 4)
    conflict = known & F.coalesce(given != best["kind"], F.lit(False)) if hint is not None else F.lit(False)
    return docs.select("*", F.when(known, best["kind"]).otherwise("unknown").alias("doc_type"), F.when(known, confidence).otherwise(0.0).alias("confidence"), conflict.alias("hint_conflict"))


def header_name(path: Column) -> Column:
    """Name of the first header rule that holds, else the path itself as a key (lower case, other signs as one underscore)."""
    c = low(path)
    key = F.nullif(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", ""), F.lit(""))
    return first_rule([(all_of(c, markers), name) for name, markers in HEADERS], key)


def table_business_type(doc_type: Column, kind: Column, text: Column, header: Column) -> Column:
    """Business type of a table from its document's type, its kind, its whole text and its header (first rows).

    A stage header goes before signatures, as stage results name customers too.
    """
    t, h, d = low(text), low(header), F.coalesce(doc_type, F.lit(""))
    details = reduce(lambda a, b: a + b, [any_of(h, ms).cast("int") for ms in STAGE_DETAILS])
    stages = (h.rlike(r"(?:№|номер)\s*этап") | h.rlike(r"(?:^|\s)этап(?:\s|$)")) & (details >= 2)
    initials = F.regexp_count(t, F.lit(r"(?u)\b[а-яё]+(?:\s+[а-яё]\.){1,2}")) >= 3
    signed = (initials & ~any_of(t, GOODS_BESIDE_INITIALS)) | (any_of(t, SIGNATURES) & ~any_of(t, GOODS))
    direct, parent, child = F.regexp_count(t, F.lit(r"(?u)\(\s*\d+\s*этап\b")) >= 2, t.rlike(r"(?:^|\s)\d+\.\s+[^|.]{0,160}этап"), t.rlike(r"(?:^|\s)\d+\.\d+\s+")
    staged = any_of(t, ["минимальная цена", "начальная", "цена контракта"]) & (direct | (parent & child))
    pair = any_of(h, ["цена за ед"]) & any_of(h, ["стоимость", "сумма"])
    matrix = h.rlike(r"(?:поставщик|исполнитель)\s*\d+") & (pair | any_of(h, ["цена услуги"])) & any_of(h, ["минимальная цена", "цена контракта"]) & any_of(h, ["количество", "кол-во", "кол-в"])
    attached = d.isin("request", "explanatory_note", "contract") & any_of(t, ["приложение"]) & any_of(t, ATTACHED)
    embedded = reduce(lambda a, b: a & b, [any_of(t, ms) for ms in EMBEDDED_ITEMS]) & ~any_of(t, EMBEDDED_ITEMS_NOT)
    rules = [
        (d.isin("plan", "ooz", "contract") & stages, "contract_stages_table"),
        (signed, "signature_table"),
        ((d == "plan") & (any_of(t, SCHEDULE) | (kind == "key_value")), "schedule_application_table"),
        ((d == "onmck") & staged, "nmck_staged_calculation_table"),
        ((d == "onmck") & matrix, "nmck_calculation_table"),
        ((d == "ooz") & kind.isin("characteristics", "item_list"), "ooz_items_table"),
        ((d == "contract") & embedded, "ooz_items_table"),
        ((d == "contract") & reduce(lambda a, b: a & b, [any_of(t, ms) for ms in SPECIFICATION]), "contract_specification_table"),
        (attached & (d == "contract"), "contract_attachments_table"),
        (attached, "request_attachments_table"),
    ]
    return first_rule(rules, F.lit("generic_table"))


def has_clause(c: Column, groups: list[list[str] | str]) -> Column:
    """Whether a lower-cased text has a marker of every group."""
    return reduce(lambda a, b: a & b, [F.regexp_like(c, F.lit(g)) if isinstance(g, str) else any_of(c, g) for g in groups])


def clause_sql(column: str, groups: list[list[str] | str]) -> str:
    """The same as SQL over a text column."""
    text = f"lower(coalesce({column}, ''))"
    one = lambda g: f"regexp_like({text}, r'{g}')" if isinstance(g, str) else " OR ".join(f"contains({text}, '{m}')" for m in g)
    return " AND ".join(f"({one(g)})" for g in groups)


def mandatory_clauses(contracts: DataFrame) -> DataFrame:
    """pk, clause, present, status for each of the mandatory clauses. ``contracts``: pk, required, text (one row each).

    Not required: not_applicable; required without a contract (no row text): manual_review; an empty text fails.
    """
    body = F.col("_low")
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("clause"), has_clause(body, groups).alias("present")) for name, groups in MANDATORY_CLAUSES])).alias("x")
    rows = contracts.select("pk", "required", F.col("text").isNull().alias("_none"), low(F.col("text")).alias("_low")).select("pk", "required", "_none", each)
    status = F.when(~F.coalesce("required", F.lit(False)), "not_applicable").when(F.col("_none"), "manual_review").when(F.col("x.present"), "passed").otherwise("failed")
    return rows.select("pk", "x.clause", "x.present", status.alias("status"))


def security_exception(kind: Column, fields: Column) -> Column:
    """The note of the first exception whose mark the fields of the plan have, by kind of security; else null."""
    t = low(fields)
    return first_rule([((kind == k) & t.rlike(p), note) for k, p, note in SECURITY_EXCEPTIONS])


# Points of a table's complexity: a column, the least value, points.
COMPLEXITY = [("n_rows", 40, 20), ("n_rows", 80, 20), ("n_cols", 8, 10), ("n_header_rows", 2, 15), ("n_warnings", 1, 20), ("n_suspicious", 1, 30), ("n_chars", 15_001, 15), ("n_chars", 30_001, 15)]
FALLBACK_POINTS, FALLBACK_MOST = 3, 30


def complexity(tables: DataFrame, gate: int) -> DataFrame:
    """``tables`` with points (size, width, headers, warnings, rows that no rule read, length) and repair (points at the gate)."""
    points = reduce(lambda a, b: a + b, [F.when(F.col(c) >= least, p).otherwise(0) for c, least, p in COMPLEXITY])
    points = points + F.least(F.lit(FALLBACK_MOST), F.coalesce("n_fallback", F.lit(0)) * FALLBACK_POINTS)
    return tables.withColumn("points", points.cast("int")).withColumn("repair", F.col("points") >= gate)


def start_event(c: Column) -> Column:
    """From when a term runs: the day after the contract is signed, the day of it, or null for anything else."""
    t = low(c)
    return F.when(all_of(t, ["со дня, следующего", "заключ"]), "next_day_after_contract_signing").when(any_of(t, ["с даты заключ", "со дня заключ"]), "contract_signing")


def codes_with_names(docs: DataFrame, key: str, text: str, code: str) -> DataFrame:
    """key, seq, code, name: each code (a pattern without groups) of a text with what stands between it and the next code,
    semicolon or line end; the first place of a code counts, an empty name is null."""
    pattern = rf"(?:{code})\s*[–—-]?\s*[^;\n]*?(?=(?:{code})|[;\n]|$)"
    found = docs.select(key, F.posexplode(F.regexp_extract_all(F.replace(text, F.lit("\r"), F.lit("\n")), F.lit(pattern), F.lit(0))).alias("seq", "raw"))
    own = F.regexp_extract("raw", f"^(?:{code})", 0)
    name = F.regexp_replace(F.regexp_replace(F.substr("raw", F.length(own) + 1), r"^\s*[–—-]?\s*", ""), r"[\s.;]+$", "")
    rows = found.select(key, own.alias("code"), F.struct("seq", F.nullif(name, F.lit("")).alias("name")).alias("b"))
    return rows.groupBy(key, "code").agg(F.min("b").alias("b")).select(key, "b.seq", "code", "b.name")


def similar_by_name(missing: DataFrame, present: DataFrame) -> DataFrame:
    """pk, code, similar: for each missing code the present ones with the same first three segments, or one of whose names
    is within one of its names or the other way round. Both: pk, code, names (array). Codes of a package of up to PAIRS
    pairs meet as they are, in larger ones names meet under rare parts."""
    head = F.substring_index("code", ".", 3)
    a = missing.select("pk", "code", head.alias("h"), "names")
    b = present.select("pk", F.col("code").alias("similar"), head.alias("h"), F.col("names").alias("others"))
    long = lambda c: F.size(F.split(c, r"\.")) >= 3
    large = large_groups(a, b)
    either = lambda x, y: (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))
    alike = F.exists("names", lambda x: F.exists("others", lambda y: either(x, y)))
    same = long("code") & long("similar") & (F.col("code") != F.col("similar")) & (F.col("a.h") == F.col("b.h"))
    few = a if large is None else a.join(large, "pk", "left_anti")
    every = few.alias("a").join(b.alias("b"), "pk").where(F.coalesce(same, F.lit(False)) | alike).select("pk", "code", "similar")
    if large is not None:
        every = every.unionByName(_similar_many(a.join(large, "pk", "left_semi"), b.join(large, "pk", "left_semi")))
    return every.groupBy("pk", "code").agg(F.array_join(F.array_sort(F.collect_set("similar")), ",").alias("similar"))


def _similar_many(a: DataFrame, b: DataFrame) -> DataFrame:
    """pk, code, similar of packages with many pairs: by a join on the segments, and by names under their rare parts."""
    long = lambda c: F.size(F.split(c, r"\.")) >= 3
    by_code = a.where(long("code")).join(b.where(long("similar")), ["pk", "h"]).where("code != similar").select("pk", "code", "similar")
    x = a.select("pk", "code", F.explode("names").alias("x")).where("x != ''")
    y = b.select("pk", "similar", F.explode("others").alias("y")).where("y != ''")
    inside = within(x.select("pk", F.col("x").alias("inner")), y.select("pk", F.col("y").alias("outer")), ["pk"]).select("pk", F.col("inner").alias("x"), F.col("outer").alias("y"))
    around = within(y.select("pk", F.col("y").alias("inner")), x.select("pk", F.col("x").alias("outer")), ["pk"]).select("pk", F.col("outer").alias("x"), F.col("inner").alias("y"))
    by_name = inside.union(around).distinct().join(x.distinct(), ["pk", "x"]).join(y.distinct(), ["pk", "y"]).select("pk", "code", "similar")
    return by_code.union(by_name).distinct()


def validate_cells(found: DataFrame, blocks: DataFrame, tables: DataFrame, cells: DataFrame, most_chars: int = 500) -> DataFrame:
    """``found`` (doc_id, ord, table_id, r, c; the last three may be null) with valid and quote.

    The cited block must be there; a cited table must be there, and the row and column inside it. The quote is that of the
    cell if row and column are cited, else of the block. ``tables``: doc_id, table_id, n_rows, n_cols.
    """
    own = ["doc_id", "ord", "table_id", "r", "c"]
    both = found.select(*own).join(blocks.select("doc_id", "ord", F.col("text").alias("_block")), ["doc_id", "ord"], "left").join(tables.select("doc_id", "table_id", "n_rows", "n_cols"), ["doc_id", "table_id"], "left")
    both = both.join(cells.select("doc_id", "table_id", "r", "c", F.col("text").alias("_cell")), ["doc_id", "table_id", "r", "c"], "left")
    inside = lambda at, n: F.col(at).isNull() | F.col(at).between(0, F.col(n) - 1)
    ok = F.col("_block").isNotNull() & (F.col("table_id").isNull() | (F.col("n_rows").isNotNull() & inside("r", "n_rows") & inside("c", "n_cols")))
    cited = F.col("table_id").isNotNull() & F.col("r").isNotNull() & F.col("c").isNotNull()
    quote = F.when(ok, F.substring(F.when(cited, F.coalesce("_cell", F.lit(""))).otherwise(F.col("_block")), 1, most_chars))
    return both.select(*own, F.coalesce(ok, F.lit(False)).alias("valid"), quote.alias("quote"))


# Who offers in a header path, and what marks a unit price and a total.
OFFERER = r"(?:поставщик|исполнитель)\s*(?:№\s*)?(\d+)"
UNIT_PRICE, ROW_TOTAL = ["цена за ед", "цена услуги"], ["стоимость", "сумма"]


def supplier_columns(headers: DataFrame) -> DataFrame:
    """doc_id, table_id, c, source, measure (price or total, a single price is both) of a price matrix from its header
    paths (doc_id, table_id, c, path).

    Three forms: columns that name a supplier, with a price and a total each; one price for each named supplier; and,
    where no supplier with a price or total is named, pairs by place: they begin after the columns of name, quantity and
    unit, and end before the least price, or else before the total of the contract or of the row. Of columns with one
    name the first counts. Without either end there are no pairs; columns without a price or total are left out.
    """
    t = low(F.col("path"))
    source = F.regexp_extract(t, OFFERER, 1).try_cast("int")
    measure = F.when(any_of(t, ROW_TOTAL), "total").when(any_of(t, UNIT_PRICE), "price")
    key = ["doc_id", "table_id"]
    whole = W.partitionBy(*key)
    seen = headers.select(*key, "c", source.alias("source"), measure.alias("measure"), header_name(F.col("path")).alias("_name"), F.contains(t, F.lit("цена контракта")).alias("_contract"))
    first = lambda cond: F.min(F.when(cond, F.col("c"))).over(whole)
    begin = F.greatest(*[first(F.col("_name") == n) for n in ("name", "quantity", "unit")]) + 1
    end = F.coalesce(first(F.col("_name") == "selected_min_unit_price"), first(F.col("_contract")), first(F.col("_name") == "row_total"))
    seen = seen.withColumn("_begin", begin).withColumn("_end", end).withColumn("_named", F.max(F.col("source").isNotNull() & F.col("measure").isNotNull()).over(whole))
    named = seen.where("_named and source > 0 and measure is not null").select(*key, "c", "source", "measure")
    place = F.col("c") - F.col("_begin")
    pairs = seen.where("not _named and c >= _begin and c < _end").select(*key, "c", (F.floor(place / 2) + 1).cast("int").alias("source"), F.when(place % 2 == 0, "price").otherwise("total").alias("measure"))
    alone = F.count("*").over(W.partitionBy(*key, "source")) == 1
    each = named.withColumn("measures", F.when(alone & (F.col("measure") == "price"), F.array(F.lit("price"), F.lit("total"))).otherwise(F.array("measure")))
    return each.select(*key, "c", "source", F.explode("measures").alias("measure")).unionByName(pairs)


def penalties_by_party(facts: DataFrame, clauses: DataFrame, table: DataFrame, sections: DataFrame) -> DataFrame:
    """Penalties that a contract owes by its amount, for each party and kind: pk, party, kind, due, stated, origin, status.

    ``facts``: pk, amount; ``table``: party, kind, above, upto, due (percent or roubles); ``clauses``: pk, party, kind,
    stated; ``sections``: pk, text. A clause of the party and kind that states what is due passes (of the customer any
    kind counts). Another percent of the supplier fails. Else the section text that has the number as a word passes.
    Without it a missing percent of the supplier or fine of the customer fails, and other amounts, or a missing fine
    without value, are for manual review.
    """
    band = (F.col("above").isNull() | (F.col("amount") > F.col("above"))) & (F.col("upto").isNull() | (F.col("amount") <= F.col("upto")))
    need = facts.join(small(table), band).select("pk", "party", "kind", "due")
    counted = F.when(F.col("party") == "customer", "non_value").otherwise(F.col("kind"))
    own = need.join(clauses.select("pk", "party", counted.alias("kind"), "stated"), ["pk", "party", "kind"], "left")
    best = own.groupBy("pk", "party", "kind", "due").agg(F.max(F.col("stated") == F.col("due")).alias("right"), F.min("stated").alias("least"))
    number = F.regexp_replace(F.regexp_replace(F.col("due").cast("string"), r"\.?0+$", ""), r"\.", "[.,]")
    number = F.when(F.col("due") == F.floor("due"), F.col("due").cast("bigint").cast("string")).otherwise(number)
    said = F.regexp_like(F.coalesce("_text", F.lit("")), F.concat(F.lit(r"(?:^|[^0-9.,])"), number, F.lit(r"(?:[^0-9.,]|[.,](?:[^0-9]|$)|$)")))
    both = best.join(_section_texts(sections), "pk", "left")
    stated, percent = F.col("least").isNotNull(), F.col("kind") == "value"
    origin = F.when(F.col("right") | (stated & percent), "clause").when(said, "text").when(stated, "clause").otherwise("none")
    status = (
        F.when(F.col("right"), "passed").when(percent & stated, "failed").when(said, "passed")
        .when(percent | ((F.col("party") == "customer") & ~stated), "failed").otherwise("manual_review")
    )
    return both.select("pk", "party", "kind", "due", F.when(F.col("right"), F.col("due")).otherwise(F.col("least")).alias("stated"), origin.alias("origin"), status.alias("status"))


def _section_texts(sections: DataFrame) -> DataFrame:
    return sections.groupBy("pk").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("_text"))


# Percent for a breach of the duty to subcontract, what marks its text, and how it is written there.
SUBCONTRACT_PERCENT, SUBCONTRACT_MARKERS = 5, ["смп", "сонко", "соисполн", "субподряд"]
SUBCONTRACT_TEXT = r"(?<![0-9.,])5(?:[.,]0+)?\s*(?:\([^)]*\)\s*)?(?:%|процент)"


def other_penalties(facts: DataFrame, clauses: DataFrame, sections: DataFrame) -> DataFrame:
    """pk, kind, stated, status of the two penalties that no amount decides. ``facts``: pk, required (subcontracting).

    ``delay``: a clause with the formula passes, without one it is for manual review. ``subcontract``, where it is required:
    five percent in a clause or in the section text about subcontractors passes, no clause fails, another is for review.
    """
    sums = clauses.groupBy("pk").agg(F.count_if(F.col("kind") == "delay").alias("_delay"), F.count_if(F.col("kind") == "subcontract").alias("_sub"), F.max(F.when(F.col("kind") == "subcontract", F.col("stated") == SUBCONTRACT_PERCENT)).alias("_right"), F.min(F.when(F.col("kind") == "subcontract", F.col("stated"))).alias("stated"))
    both = facts.select("pk", "required").join(sums, "pk", "left").join(_section_texts(sections), "pk", "left")
    text = low(F.col("_text"))
    said = any_of(text, SUBCONTRACT_MARKERS) & text.rlike(SUBCONTRACT_TEXT)
    delay = F.when(F.col("_delay") > 0, "passed").otherwise("manual_review")
    sub = F.when(~F.coalesce("required", F.lit(False)), "not_applicable").when(F.col("_right") | said, "passed").when(F.coalesce("_sub", F.lit(0)) == 0, "failed").otherwise("manual_review")
    none = F.lit(None).cast("decimal(18,4)")
    each = F.explode(F.array(F.struct(F.lit("delay").alias("kind"), none.alias("stated"), delay.alias("status")), F.struct(F.lit("subcontract").alias("kind"), F.col("stated").cast("decimal(18,4)").alias("stated"), sub.alias("status")))).alias("x")
    return both.select("pk", each).select("pk", "x.*")
