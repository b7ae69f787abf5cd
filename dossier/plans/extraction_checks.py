"""Typed rows from cell grids and from texts rendered out of lineitem and part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extraction as op
from ..operators import facts
from .registry import ITEMS, PARTS, item_parts, items, parts, query, table
from .rule_checks import _NORM
from .table_checks import _BLOCKS, _GRID, _blocks, _cells, _columns, _lines


@query(f"""WITH {_GRID}, t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'plan' ELSE 'contract' END AS doc_type, lower(string_agg(text, ' ')) AS text FROM cells GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_type = 'plan' AND contains(text, 'promo') THEN 'plan_items' WHEN contains(text, 'ring') AND contains(text, 'small') THEN 'rings' WHEN doc_type = 'contract' THEN 'specification' ELSE 'other' END AS table_type FROM t""")
def table_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _cells(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "c", "text"))), lambda x: x["text"]), " ").alias("text"))
    rules = [("plan", ["promo"], "plan_items"), (None, ["ring", "small"], "rings"), ("contract", [], "specification")]
    return op.table_type(texts.withColumn("doc_type", F.when(F.col("doc_id") % 2 == 0, "plan").otherwise("contract")), rules).select("doc_id", "table_type")


@query(f"""WITH {_GRID} SELECT doc_id, 't' AS table_id, r, name AS what, qty::DECIMAL(24,6) AS number, total::DECIMAL(24,6) AS total FROM l UNION ALL SELECT doc_id, 't', 1, 'name', NULL, NULL FROM (SELECT DISTINCT doc_id FROM l) UNION ALL SELECT doc_id, 't', 0, 'item', NULL, NULL FROM (SELECT DISTINCT doc_id FROM l)""")
def spec_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    keywords = {"what": "item / name", "number": "number", "total": "total"}
    return op.typed_rows(_columns(spark, sf_dir, keywords), list(keywords), ["number", "total"])


@query(f"""WITH {ITEMS} SELECT pk, seq, seq || '.' || (item % 9) AS number, CASE WHEN seq % 4 <> 0 THEN day END AS start_date, CASE WHEN seq % 4 <> 0 THEN day + 30 END AS end_date, (total / 100)::DECIMAL(24,2) AS price FROM items WHERE seq % 3 <> 0""")
def stage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each third row has no stage number, each fourth no dates."""
    d = lambda c: F.date_format(c, "dd.MM.yyyy")  # noqa: E731
    rows = items(spark, sf_dir).select(
        "pk", "seq", F.when(F.col("seq") % 3 == 0, "итого").otherwise(F.concat("seq", F.lit("."), F.col("item") % 9, F.lit("."))).alias("number"),
        F.when(F.col("seq") % 4 != 0, F.concat(F.lit("с "), d("day"), F.lit(" по "), d(F.date_add("day", 30)))).otherwise("по заявке").alias("term"), F.concat((F.col("total") / 100).cast("decimal(18,2)"), F.lit(" р")).alias("price"),
    )  # fmt: skip
    return op.stage_rows(rows).select("pk", "seq", "number", "start_date", "end_date", "price")


@query(f"""WITH {ITEMS}, {PARTS}, w AS (SELECT pk, seq, name FROM items JOIN parts USING (item)), n AS (SELECT pk, row_number() OVER (PARTITION BY pk ORDER BY seq)::INTEGER - 1 AS seq, seq::VARCHAR AS number, name AS title FROM w)
SELECT * FROM n WHERE NOT contains(title, 'green') QUALIFY row_number() OVER (PARTITION BY pk, title ORDER BY seq) = 1""")
def attachment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of the parts of a package are the titles of its attachments."""
    line = F.concat(F.lit("Приложение № "), F.col("seq"), F.lit(" – "), F.col("name"))
    texts = item_parts(spark, sf_dir).groupBy("pk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("t")))), lambda x: x["t"]), "; ").alias("text"))
    return op.attachment_rows(texts, ["green"], "pk")


@query(f"""WITH {_GRID}, s AS (SELECT *, CASE WHEN role = 'O' THEN kind END AS k FROM l), f AS (SELECT *, CASE WHEN k IS NOT NULL THEN min(r) OVER (PARTITION BY doc_id, k) END AS first FROM s),
p AS (SELECT *, last_value(first IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS parent_r FROM f) SELECT doc_id, parent_r AS r, count(*) AS n_rows, min_by(kind, r) AS item_key FROM p WHERE parent_r IS NOT NULL GROUP BY doc_id, parent_r""")
def items_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.items_from_tables(_lines(spark, sf_dir), F.col("role") == "O", F.col("kind")).select("doc_id", "r", "n_rows", "item_key")


_RULES = [("licence", r"under the ([A-Z]\w+)"), ("mail", r"(\w+)@"), ("first", r"^(\w+)")]
_RULE_SQL = ", ".join(f"('{f}', '{p}')" for f, p in _RULES)


@query(f"""WITH {_BLOCKS}, m AS (SELECT * FROM blocks, (VALUES {", ".join(f"('{f}')" for f, _ in _RULES)}) r(field) WHERE CASE field {" ".join(f"WHEN '{f}' THEN regexp_matches(text, '{p}')" for f, p in _RULES)} END),
f AS (SELECT *, CASE field {" ".join(f"WHEN '{f}' THEN trim(regexp_extract(text, '{p}', 1))" for f, p in _RULES)} END AS raw FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY ord) = 1)
SELECT doc_id, field, ord, raw, {_NORM("raw")} AS norm FROM f""")
def document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.build_facts(_blocks(spark, sf_dir), spark.createDataFrame(_RULES, "field string, pattern string"))


@query(f"""WITH {ITEMS}, {PARTS}, e AS (SELECT pk, kind AS item, seq, name AS text, 'table' AS origin FROM items JOIN parts USING (item) WHERE flag = 'A' UNION ALL SELECT pk, kind, seq, CASE WHEN seq % 4 = 0 THEN ' ' ELSE upper(name) || '.' END, 'text' FROM items JOIN parts USING (item) WHERE flag <> 'A')
SELECT * FROM e WHERE {_NORM("text")} <> '' QUALIFY row_number() OVER (PARTITION BY pk, item, {_NORM("text")} ORDER BY origin, seq) = 1""")
def justification_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = item_parts(spark, sf_dir).withColumnRenamed("kind", "k")
    tabled = w.where("flag = 'A'").select("pk", F.col("k").alias("item"), "seq", F.col("name").alias("text"))
    texts = w.where("flag != 'A'").select("pk", F.col("k").alias("item"), "seq", F.when(F.col("seq") % 4 == 0, " ").otherwise(F.concat(F.upper("name"), F.lit("."))).alias("text"))
    return op.justifications(tabled, texts)


@query(f"""WITH {ITEMS}, {PARTS} SELECT pk AS doc_id, seq AS ord, seq AS number, name, 'шт' AS unit, qty::DECIMAL(24,3) AS qty, (total / 100)::DECIMAL(24,2) AS price, (total * 2 / 100)::DECIMAL(24,2) AS total FROM items JOIN parts USING (item) WHERE seq % 5 <> 0""")
def offers_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fifth line is prose."""
    money = lambda c: F.replace((c / 100).cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))  # noqa: E731
    line = F.concat_ws(" ", F.concat("seq", F.lit(".")), "name", F.lit("шт."), "qty", money(F.col("total")), money(F.col("total") * 2))
    blocks = item_parts(spark, sf_dir).select(F.col("pk").alias("doc_id"), F.col("seq").alias("ord"), F.when(F.col("seq") % 5 != 0, line).otherwise(F.concat(F.lit("итого "), F.col("name"))).alias("text"))
    return op.offers_from_text(blocks)


@query("""SELECT event_id, event_type, CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS place FROM events""")
def order_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.order_by_role(table(spark, sf_dir, "events").select("event_id", "event_type"), ["error", "purchase"], "event_type")


_TYPE = "CASE doc_id % 7 WHEN 0 THEN 'plan' WHEN 1 THEN 'request' WHEN 2 THEN 'onmck' WHEN 3 THEN 'ooz' WHEN 4 THEN 'contract' WHEN 5 THEN 'explanatory_note' ELSE 'commercial_offer' END"
# lines around the text of a document, in SQL that Spark and DuckDB read alike
_LINES = [
    "CASE WHEN n_chars % 3 = 0 THEN concat('Предмет закупки: картридж ', source) END", "CASE WHEN n_chars % 4 = 0 THEN 'ОБЪЕКТ  ЗАКУПКИ' END",
    "CASE WHEN n_chars % 5 = 1 THEN concat('Срок поставки:  ', CASE WHEN n_chars % 2 = 0 THEN 'до 05.06.2024' ELSE '' END) END", "CASE WHEN n_chars % 7 < 3 THEN 'Место поставки, адрес поставки: г. Москва: склад' END",
    "CASE WHEN n_chars % 6 = 2 THEN 'Способ закупки : аукцион' END", "CASE WHEN n_chars % 11 < 5 THEN concat('Коэффициент вариации: ', CAST(n_chars % 40 AS VARCHAR(9)), ',5 %') END",
    "CASE WHEN n_chars % 8 < 3 THEN 'Поставщик: ООО Ромашка, исх. № 12 от 01.02.2024' END", "CASE WHEN n_chars % 9 < 4 THEN 'НДС 20 %' END", "CASE WHEN n_chars % 10 < 4 THEN 'Контракт № 5' END",
    "CASE WHEN n_chars % 13 < 6 THEN 'Срок исполнения контракта' END", "text", "CASE WHEN n_chars % 13 < 3 THEN 'Срок исполнения контракта: 31.12.2024 включительно' END",
    "CASE WHEN n_chars % 5 = 0 THEN 'Обоснование закупки и метод:' END", "CASE WHEN n_chars % 3 = 1 THEN 'Гарантия: 12 месяцев; основание - п. 4' END",
    "CASE WHEN n_chars % 4 = 1 THEN 'Этапы исполнения: не предусмотрены' END", "CASE WHEN n_chars % 4 = 2 THEN 'Аванс не предусмотрен' END", "CASE WHEN n_chars % 2 = 0 THEN 'Предмет контракта: бумага' END",
]  # fmt: skip
_DOCS = f"SELECT doc_id, {_TYPE} AS doc_type, n_chars, concat_ws(chr(10), {', '.join(_LINES)}) AS text FROM documents"
_NAMES = ["1. Наименование объекта закупки", "Начальная (максимальная) цена, НМЦК", "Способ определения", "Единственный поставщик", "Источник финансирования", "Место оказания услуг", "Сроки поставки товара", "Срок исполнения контракта", "Этапы исполнения", "Преимущества СМП", "СОНКО: субподряд", "Процент, объем привлечения", "Размер обеспечения заявки", "Обеспечение исполнения контракта", "Обеспечение гарантийных обязательств", "Дополнительные требования", "Национальный режим", "Прочее", "Предмет закупки"]
_WORTH = ["1 200,50 руб.", "5 %", "да", "не требуется", "до 05.06.2024", " ", "12,25% от цены", "25.02.2024 и 01.03.2024"]
_PAIR_ROWS = "SELECT doc_id, doc_type, seq, {names}[(seq * 7 + n_chars) % {n}{one}] AS name, CASE WHEN (n_chars + seq) % 9 <> 0 THEN {worth}[(doc_id + seq) % {m}{one}] END AS value"
_FIELDS = """('plan', 'subject', 'text', 0, 'key', ['наименование объекта закупки', 'предмет закупки']), ('plan', 'nmck', 'amount', 0, 'key', ['начальная', 'нмцк', 'цена контракта']), ('plan', 'method', 'text', 0, 'key', ['способ закупки', 'способ определения', 'способ выбора']),
('plan', 'basis', 'text', 0, 'key', ['основание', 'единственный поставщик']), ('plan', 'funding', 'text', 0, 'key', ['источник финансирования']), ('plan', 'delivery_place', 'text', 0, 'key', ['место поставки', 'адрес поставки', 'место оказания']),
('plan', 'delivery_term', 'date', 0, 'key', ['сроки поставки товара', 'срок поставки', 'срок оказания', 'срок выполнения']), ('plan', 'contract_term', 'date', 0, 'key', ['срок исполнения контракта']), ('plan', 'has_stages', 'flag', 0, 'key', ['этапы исполнения']),
('plan', 'smp_preference', 'flag', 0, 'key', ['преимуществ', 'смп']), ('plan', 'subcontract', 'flag', 0, 'key', ['субподряд', 'сонко']), ('plan', 'subcontract_percent', 'percent', 0, 'key', ['процент', 'объем привлечения']), ('plan', 'subcontract_percent', 'percent', 1, 'key', ['субподряд', 'сонко']),
('plan', 'bid_security', 'percent', 0, 'key', ['обеспечения заявки', 'обеспечение заявки']), ('plan', 'contract_security', 'percent', 0, 'key', ['обеспечения исполнения контракта', 'обеспечение исполнения контракта']), ('plan', 'warranty_security', 'percent', 0, 'key', ['обеспечения гарантийных обязательств', 'обеспечение гарантийных обязательств']),
('plan', 'extra_requirements', 'text', 0, 'key', ['дополнительные требования']), ('plan', 'national_regime', 'text', 0, 'key', ['национальный режим']),
('request', 'subject', 'text', 0, 'after', ['предмет закупки', 'объект закупки']), ('request', 'method', 'text', 0, 'after', ['способ закупки']), ('request', 'basis', 'text', 0, 'after', ['основание']), ('request', 'delivery_term', 'date', 0, 'after', ['срок поставки', 'срок выполнения']), ('request', 'stages', 'flag', 0, 'after', ['этапы исполнения', 'этапность']),
('onmck', 'method', 'text', 0, 'after', ['метод']), ('onmck', 'subject', 'text', 0, 'after', ['предмет закупки', 'объект закупки']), ('onmck', 'variation', 'percent', 0, 'after', ['коэффициент вариации']),
('ooz', 'subject', 'text', 0, 'after', ['предмет закупки', 'объект закупки']), ('ooz', 'delivery_place', 'text', 0, 'after', ['место поставки', 'адрес поставки']), ('ooz', 'delivery_term', 'date', 0, 'after', ['срок оказания', 'срок поставки', 'срок выполнения']), ('ooz', 'warranty', 'text', 0, 'after', ['гаранти']),
('contract', 'number', 'text', 0, 'after', ['контракт №', 'контракт n']), ('contract', 'subject', 'text', 0, 'after', ['предмет контракта', 'предмет закупки']), ('contract', 'delivery_place', 'text', 0, 'after', ['место поставки', 'адрес поставки']), ('contract', 'delivery_term', 'date', 0, 'after', ['срок оказания', 'срок поставки', 'срок выполнения']),
('contract', 'contract_term', 'date', 0, 'value', ['срок исполнения контракта']), ('contract', 'contract_term', 'date', 1, 'after', ['срок исполнения контракта']),
('explanatory_note', 'subject', 'text', 0, 'after', ['предмет закупки', 'объект закупки']), ('explanatory_note', 'method', 'text', 0, 'after', ['способ закупки']), ('explanatory_note', 'justification', 'text', 0, 'after', ['обоснование']),
('commercial_offer', 'supplier', 'text', 0, 'after', ['поставщик', 'организация']), ('commercial_offer', 'outgoing_number', 'text', 0, 'after', ['исх']), ('commercial_offer', 'outgoing_date', 'date', 0, 'after', ['исх']), ('commercial_offer', 'offer_date', 'date', 0, 'after', ['дата', 'от']),
('commercial_offer', 'subject', 'text', 0, 'after', ['предмет', 'объект закупки']), ('commercial_offer', 'delivery_term', 'date', 0, 'after', ['срок поставки', 'срок оказания', 'срок выполнения']), ('commercial_offer', 'delivery_place', 'text', 0, 'after', ['место поставки', 'место оказания', 'адрес поставки']),
('commercial_offer', 'advance', 'text', 0, 'after', ['аванс']), ('commercial_offer', 'vat', 'percent', 0, 'after', ['ндс'])"""


def _listed(values: list[str], left: str, right: str) -> str:
    return left + ", ".join(f"'{v}'" for v in values) + right


@query(rf"""WITH d AS ({_DOCS}), rule(doc_type, field, kind, w, way, anchors) AS (VALUES {_FIELDS}),
line AS (SELECT doc_id, doc_type, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord, x, lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS next, trim(CASE WHEN contains(x, ':') THEN x[strpos(x, ':') + 1:] ELSE '' END, ' ') AS tail
  FROM (SELECT doc_id, doc_type, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i, trim(regexp_replace(unnest(string_split(text, chr(10))), '[ 	
]+', ' ', 'g'), ' ') AS x FROM d) WHERE x <> ''),
pair AS ({_PAIR_ROWS.format(names=_listed(_NAMES, '[', ']'), worth=_listed(_WORTH, '[', ']'), n=len(_NAMES), m=len(_WORTH), one=' + 1')} FROM d, range(12) t(seq)),
hit AS (SELECT doc_id, line.doc_type, field, kind, w, way, ord, CASE WHEN tail <> '' THEN tail ELSE coalesce(next, x) END AS raw FROM line JOIN rule ON rule.doc_type = line.doc_type AND way <> 'key' WHERE len(list_filter(anchors, lambda a: contains(lower(x), a))) > 0 AND (way = 'after' OR tail <> '')
  UNION ALL SELECT doc_id, pair.doc_type, field, kind, w, way, seq, value FROM pair JOIN rule ON rule.doc_type = pair.doc_type AND way = 'key' WHERE len(list_filter(anchors, lambda a: contains(lower(name), a))) > 0),
f AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY w, ord) = 1), n AS (SELECT *, {_NORM("raw")} AS norm FROM f)
SELECT doc_id, doc_type, field, way, ord, raw, norm, CASE WHEN kind = 'amount' THEN TRY_CAST(replace(replace(regexp_extract(raw, '([0-9]{{1,3}}(?: [0-9]{{3}})+(?:[.,][0-9]{{1,2}})?|[0-9]+(?:[.,][0-9]{{1,2}})?) ?руб', 1), ' ', ''), ',', '.') AS DECIMAL(18,2)) END AS amount,
  CASE WHEN kind = 'percent' THEN TRY_CAST(replace(regexp_extract(raw, '([0-9]+(?:[.,][0-9]+)?) ?%', 1), ',', '.') AS DECIMAL(9,2)) END AS percent, CASE WHEN kind = 'date' THEN try_strptime(regexp_extract(raw, '[0-9]{{2}}\.[0-9]{{2}}\.[0-9]{{4}}'), '%d.%m.%Y')::DATE END AS date,
  CASE WHEN kind = 'flag' THEN CASE WHEN regexp_matches(norm, '^(не |нет|отсутств|no|false)') THEN false WHEN regexp_matches(norm, '^(да|установлен|требует|предусмотрен|yes|true)') THEN true END END AS flag FROM n""")
def facts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of seven types of documents, from lines around their texts and from key-value rows."""
    docs = spark.sql(_DOCS.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))
    pairs = spark.sql(_PAIR_ROWS.format(names=_listed(_NAMES, "array(", ")"), worth=_listed(_WORTH, "array(", ")"), n=len(_NAMES), m=len(_WORTH), one="") + " FROM {d} LATERAL VIEW explode(sequence(0, 11)) AS seq", d=docs)
    return facts.document_facts(docs, pairs)


def _offer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An offer for each package: a header, items over five to eight lines, prose between, the sum and a term."""
    w = item_parts(spark, sf_dir, "name", "brand")
    money = lambda c: F.replace((c / 100).cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))  # noqa: E731
    name = F.concat_ws("\n", F.substring_index("name", " ", 2), F.regexp_extract("name", r"^\S+ \S+ ?(.*)$", 1))
    note = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("№ реестровой  записи "), F.col("item"))).when(F.col("seq") % 3 == 1, F.concat(F.lit("Товарный знак "), F.col("brand")))
    unit = F.when(F.col("seq") % 5 == 4, "без единицы").when(F.col("seq") % 2 == 0, "шт.").otherwise("Компл")
    vat = F.when(F.col("flag") == "A", "без НДС").otherwise("20")
    item = F.concat_ws("\n", F.concat(F.lit("1."), F.col("seq")), name, note, unit, F.col("qty").cast("string"), money(F.col("total")), vat, money(F.col("total") * F.col("qty")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", item.alias("t")))), lambda x: x["t"]), "\n \n")
    each = w.groupBy("pk").agg(body.alias("body"), F.min("day").alias("day"), F.sum("total").alias("sum"))
    head = F.when(F.col("pk") % 4 != 0, F.concat(F.lit("  "), F.date_format("day", "dd.MM.yyyy"), F.lit(" № КП-"), F.col("pk")))
    who = F.when(F.col("pk") % 3 != 0, F.concat(F.lit("ООО «Ромашка "), F.col("pk"), F.lit("» предлагает поставить:"))).otherwise("Предлагаем поставить:")
    tail = F.concat(F.lit("Сумма коммерческого предложения составляет: "), F.regexp_replace(money(F.col("sum")), r"(?<=\d)(?=(?:\d{3})+,)", " "), F.lit(" рублей\nшт\n1\n2\n3\n4"))
    term = F.when(F.col("pk") % 5 != 0, F.concat(F.lit("Срок поставки товара: "), F.col("pk") % 30 + 1, F.lit(" дней")))
    return each.select(F.col("pk").alias("doc_id"), F.concat_ws("\n", head, who, "body", tail, term).alias("text"))


@query(f"""WITH {ITEMS}, {PARTS} SELECT pk AS doc_id, '1.' || seq AS row_number, trim(CASE WHEN seq % 3 = 1 THEN name || ' Товарный знак ' || brand ELSE name END) AS name, CASE WHEN seq % 3 = 1 THEN brand END AS trademark, CASE WHEN seq % 2 = 0 THEN 'шт.' ELSE 'Компл' END AS unit, qty::DECIMAL(24,6) AS qty, (total / 100)::DECIMAL(24,2) AS price,
CASE WHEN flag = 'A' THEN 'без НДС' ELSE '20' END AS vat_text, CASE WHEN flag <> 'A' THEN 20::DECIMAL(24,2) END AS vat_rate, (total * qty / 100)::DECIMAL(24,2) AS total, CASE WHEN seq % 3 = 0 THEN '№ реестровой записи ' || item ELSE '' END AS notes FROM items JOIN parts USING (item) WHERE seq % 5 <> 4""")
def offer_text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the text layers of offers; each fifth has no unit line."""
    rows = op.offer_text_rows(_offer_texts(spark, sf_dir))
    return rows.select("doc_id", "row_number", "name", "trademark", "unit", "qty", "price", "vat_text", "vat_rate", "total", F.array_join("notes", ";").alias("notes"))


@query(f"""WITH {ITEMS} SELECT pk AS doc_id, CASE WHEN pk % 4 <> 0 THEN 'КП-' || pk END AS number, CASE WHEN pk % 4 <> 0 THEN min(day) END AS date, CASE WHEN pk % 3 <> 0 THEN 'ООО «Ромашка ' || pk || '»' END AS supplier, (sum(total) / 100)::DECIMAL(24,2) AS total,
CASE WHEN pk % 5 <> 0 THEN (pk % 30 + 1) || ' дней' END AS term, CASE WHEN bool_or(flag = 'A') AND bool_or(flag <> 'A' OR qty IN (20, 22)) THEN 'mixed' WHEN bool_or(flag = 'A') THEN 'exempt' END AS vat_text FROM items GROUP BY pk""")
def offer_requisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quantity of 20 or 22 on a line of its own reads like a rate, as the rule says."""
    return op.offer_requisites(_offer_texts(spark, sf_dir))
