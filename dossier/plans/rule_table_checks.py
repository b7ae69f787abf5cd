"""The fixed rule tables over texts that are put together from the given tables: many different inputs, and SQL made of the same tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import merge
from ..operators import rule_tables as op
from ..operators import rules
from .registry import ITEMS, PARTS, dealt, item_parts, items, parts, query, table


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _pick(parts: list[str], n: Column) -> Column:
    """The part with the number n modulo their count."""
    return F.element_at(F.array(*map(F.lit, parts)), (F.pmod(n, F.lit(len(parts))) + 1).cast("int"))


def _pick_sql(parts: list[str], n: str) -> str:
    return f"[{', '.join(map(_q, parts))}][(({n}) % {len(parts)} + 1)::INTEGER]"


def _any(c: str, markers: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {_q(m)})" for m in markers) + ")"


def _all(c: str, markers: list[str]) -> str:
    return "(" + " AND ".join(f"contains({c}, {_q(m)})" for m in markers) + ")"


_TYPES = [k for k, _ in op.DOCUMENT_MARKERS]
_PHRASES = [m.capitalize() for _, ms in op.DOCUMENT_MARKERS for m in ms] + ["", "прочее"]
_FILES = [m.upper() for _, ms in op.FILE_MARKERS for m in ms] + ["letter"]
_HINTS = [*_TYPES, "unknown"]
_SCORES = ", ".join(
    f"""{{'score': 2.0::DOUBLE * ({" + ".join(f"contains(t, {_q(m)})::INTEGER" for m in ms)}) + {_any("f", dict(op.FILE_MARKERS)[k])}::INTEGER + 1.25::DOUBLE * (hint = {_q(k)})::INTEGER, 'place': {-i}, 'kind': {_q(k)}}}"""
    for i, (k, ms) in enumerate(op.DOCUMENT_MARKERS)
)


@query(f"""WITH d AS (SELECT doc_id, lower({_pick_sql(_PHRASES, "doc_id")} || ' ' || coalesce(text, '') || ' ' || {_pick_sql(_PHRASES, "n_chars")}) AS t, lower({_pick_sql(_FILES, "n_chars // 7")} || '_' || doc_id) AS f, {_pick_sql(_HINTS, "n_chars // 3")} AS hint FROM documents),
s AS (SELECT doc_id, hint, list_sort([{_SCORES}], 'DESC') AS r FROM d)
SELECT doc_id, CASE WHEN r[1].score > 0 THEN r[1].kind ELSE 'unknown' END AS doc_type, CASE WHEN r[1].score > 0 THEN round(least(0.99, 0.55 + 0.1 * r[1].score + 0.05 * (r[1].score - r[2].score)), 4) ELSE 0 END AS confidence, r[1].score > 0 AND coalesce(nullif(hint, 'unknown') <> r[1].kind, false) AS hint_conflict FROM s""")
def document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.concat_ws(" ", _pick(_PHRASES, F.col("doc_id")), F.coalesce("text", F.lit("")), _pick(_PHRASES, F.col("n_chars")))
    name = F.concat(F.lit("in/"), _pick(_FILES, F.expr("n_chars div 7")), F.lit("_"), F.col("doc_id"), F.lit(".docx"))
    rows = docs.select("doc_id", text.alias("text"), name.alias("file"), _pick(_HINTS, F.expr("n_chars div 3")).alias("hint"))
    return op.document_types(rows, "text", "file", "hint").select("doc_id", "doc_type", "confidence", "hint_conflict")


_PATHS = sorted({" / ".join(ms) for _, ms in op.HEADERS})
_HEADER_SQL = " ".join(f"WHEN {_all('h', ms)} THEN {_q(name)}" for name, ms in op.HEADERS)
_KEY_SQL = r"nullif(regexp_replace(regexp_replace(h, '[^\p{L}\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g'), '')"


@query(f"""SELECT p_partkey, CASE {_HEADER_SQL} ELSE {_KEY_SQL} END AS header FROM (SELECT p_partkey, lower(p_name || ' ' || CASE WHEN p_size % 5 = 0 THEN '' ELSE {_pick_sql(_PATHS, "p_partkey")} END || ' / ' || CASE WHEN p_size % 3 = 0 THEN {_pick_sql(_PATHS, "p_partkey // 7")} ELSE '' END) AS h FROM part)""")
def header_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    first = F.when(F.col("p_size") % 5 == 0, "").otherwise(_pick(_PATHS, F.col("p_partkey")))
    second = F.when(F.col("p_size") % 3 == 0, _pick(_PATHS, F.expr("p_partkey div 7"))).otherwise("")
    return part.select("p_partkey", op.header_name(F.concat(F.col("p_name"), F.lit(" "), first, F.lit(" / "), second)).alias("header"))


_TEXTS = [
    "№ этапа | Дата начала | Цена этапа", "Должность: Петров П. С.", "иванов и. о. петров п. п. сидоров с. с.", "Начальная цена; 1. Первый этап; 1.1 работы", "(1 этап) (2 этап) минимальная цена",
    "Код ОКПД; характеристики; требования", "Спецификация: ставка НДС, всего", "Приложение 1: проект контракта", "Приложение 2: описание объекта закупки", "Цена за единицу по ОКПД, наименование товара", "прочее",
]
_HEADS = ["Номер этапа Срок поставки Результат этапа", "Поставщик 1 Цена за ед. Стоимость Количество Минимальная цена", "Исполнитель 2 цена услуги кол-во цена контракта", "этап", "Наименование", ""]
_TABLE_KINDS = ["key_value", "characteristics", "item_list", "supplier_matrix"]
_GOODS_SQL = f"(len(regexp_extract_all(t, '(?:^|[^\\p{{L}}\\p{{N}}_])[а-яё]+(?:\\s+[а-яё]\\.){{1,2}}')) >= 3 AND NOT {_any('t', op.GOODS_BESIDE_INITIALS)}) OR ({_any('t', op.SIGNATURES)} AND NOT {_any('t', op.GOODS)})"
_DETAIL_SQL = " + ".join(f"{_any('h', ms)}::INTEGER" for ms in op.STAGE_DETAILS)


@query(f"""WITH x AS (SELECT o_orderkey AS pk, {_pick_sql(_TYPES, "o_orderkey")} AS d, {_pick_sql(_TABLE_KINDS, "o_custkey")} AS kind, lower({_pick_sql(_HEADS, "o_orderkey // 5")}) AS h, lower({_pick_sql(_TEXTS, "o_orderkey // 3")} || ' ' || {_pick_sql(_HEADS, "o_orderkey // 5")} || ' ' || {_pick_sql(_TEXTS, "o_custkey")}) AS t FROM orders)
SELECT pk, CASE WHEN d IN ('plan', 'ooz', 'contract') AND (regexp_matches(h, '(?:№|номер)\\s*этап') OR regexp_matches(h, '(?:^|\\s)этап(?:\\s|$)')) AND {_DETAIL_SQL} >= 2 THEN 'contract_stages_table'
 WHEN {_GOODS_SQL} THEN 'signature_table' WHEN d = 'plan' AND ({_any("t", op.SCHEDULE)} OR kind = 'key_value') THEN 'schedule_application_table'
 WHEN d = 'onmck' AND {_any("t", ["минимальная цена", "начальная", "цена контракта"])} AND (len(regexp_extract_all(t, '\\(\\s*[0-9]+\\s*этап(?:[^\\p{{L}}\\p{{N}}_]|$)')) >= 2 OR (regexp_matches(t, '(?:^|\\s)[0-9]+\\.\\s+[^|.]{{0,160}}этап') AND regexp_matches(t, '(?:^|\\s)[0-9]+\\.[0-9]+\\s+'))) THEN 'nmck_staged_calculation_table'
 WHEN d = 'onmck' AND regexp_matches(h, '(?:поставщик|исполнитель)\\s*[0-9]+') AND ((contains(h, 'цена за ед') AND {_any("h", ["стоимость", "сумма"])}) OR contains(h, 'цена услуги')) AND {_any("h", ["минимальная цена", "цена контракта"])} AND {_any("h", ["количество", "кол-во", "кол-в"])} THEN 'nmck_calculation_table'
 WHEN d = 'ooz' AND kind IN ('characteristics', 'item_list') THEN 'ooz_items_table' WHEN d = 'contract' AND {" AND ".join(_any("t", ms) for ms in op.EMBEDDED_ITEMS)} AND NOT {_any("t", op.EMBEDDED_ITEMS_NOT)} THEN 'ooz_items_table'
 WHEN d = 'contract' AND {" AND ".join(_any("t", ms) for ms in op.SPECIFICATION)} THEN 'contract_specification_table'
 WHEN d IN ('request', 'explanatory_note', 'contract') AND contains(t, 'приложение') AND {_any("t", op.ATTACHED)} THEN CASE WHEN d = 'contract' THEN 'contract_attachments_table' ELSE 'request_attachments_table' END ELSE 'generic_table' END AS table_type FROM x""")
def table_business_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    header = _pick(_HEADS, F.expr("o_orderkey div 5"))
    text = F.concat_ws(" ", _pick(_TEXTS, F.expr("o_orderkey div 3")), header, _pick(_TEXTS, cust))
    return orders.select(key.alias("pk"), op.table_business_type(_pick(_TYPES, key), _pick(_TABLE_KINDS, cust), text, header).alias("table_type"))


_SENTENCES = [
    "Исполнитель обязан привлечь СМП и СОНКО", "в объеме 25 (двадцати пяти) процентов", "в доле, %", "не менее 12,5 %", "декларация и копия договора в течение 5 рабочих дней", "при замене соисполнителя документы в течение 5 дней", "документы о приемке и платежные за 10 рабочих дней после оплаты",
    "услуги оплачиваются за 7 рабочих дней после приемки", "гражданско-правовая ответственность за непривлечение", "вправе осуществлять замену субподрядчика", "иные условия",
]
_TEXT_SQL = "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE " + " || ' ' || ".join(f"CASE WHEN (o_orderkey // {2**i} + o_custkey) % 3 <> 0 THEN {_q(s.capitalize())} ELSE '' END" for i, s in enumerate(_SENTENCES)) + " END"
# typed by hand, not made of the operator's table
_CLAUSE_SQL = ", ".join(
    f"{{'clause': '{name}', 'present': {holds}}}"
    for name, holds in {
        "duty_with_share": r"(contains(t, 'смп') OR contains(t, 'сонко')) AND contains(t, 'привлеч') AND regexp_matches(t, '[0-9]\s*(\([^)]*\)\s*)?(%|процент)')",
        "declaration_in_5_days": "contains(t, 'декларац') AND contains(t, 'копи') AND contains(t, 'договор') AND contains(t, '5') AND contains(t, 'рабоч')",
        "replacement_in_5_days": "contains(t, 'замен') AND contains(t, 'документ') AND contains(t, '5') AND contains(t, 'дн')",
        "acceptance_in_10_days": "contains(t, '10') AND contains(t, 'рабоч') AND contains(t, 'оплат') AND contains(t, 'приемк') AND contains(t, 'платеж')",
        "payment_in_7_days": "contains(t, 'оплач') AND contains(t, '7') AND contains(t, 'рабоч') AND contains(t, 'приемк')",
        "liability": "contains(t, 'гражданско-правовая ответственность за непривлечение')",
        "right_to_replace": "contains(t, 'вправе осуществлять замену субподрядчика')",
    }.items()
)


@query(f"""WITH c AS (SELECT o_orderkey AS pk, CASE WHEN o_custkey % 5 <> 0 THEN o_orderstatus <> 'P' END AS required, {_TEXT_SQL} AS text FROM orders),
x AS (SELECT pk, required, text, unnest([{_CLAUSE_SQL}]) AS x FROM (SELECT *, lower(coalesce(text, '')) AS t FROM c))
SELECT pk, x.clause AS clause, x.present AS present, CASE WHEN NOT coalesce(required, false) THEN 'not_applicable' WHEN text IS NULL THEN 'manual_review' WHEN x.present THEN 'passed' ELSE 'failed' END AS status FROM x""")
def mandatory_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    body = F.concat_ws(" ", *[F.when((F.expr(f"o_orderkey div {2**i}") + cust) % 3 != 0, s.capitalize()).otherwise("") for i, s in enumerate(_SENTENCES)])
    rows = table(spark, sf_dir, "orders").select(key.alias("pk"), F.when(cust % 5 != 0, F.col("o_orderstatus") != "P").alias("required"), F.when(key % 13 != 0, body).alias("text"))
    return op.mandatory_clauses(rows)


_FIELDS = ["Выплата аванса 30 %", "Казначейское сопровождение", "Учреждение УИС", "организация для инвалидов", "уголовно-исполнительная система", "нет"]


@query(f"""WITH f AS (SELECT o_orderkey AS pk, ['bid', 'performance', 'warranty'][(o_orderkey % 3 + 1)::INTEGER] AS kind, lower({_pick_sql(_FIELDS, "o_custkey")} || '; ' || {_pick_sql(_FIELDS, "o_orderkey // 4")}) AS t FROM orders)
SELECT pk, kind, CASE {" ".join(f"WHEN kind = '{k}' AND regexp_matches(t, {_q(p)}) THEN '{note}'" for k, p, note in op.SECURITY_EXCEPTIONS)} END AS exception FROM f""")
def security_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    fields = F.concat_ws("; ", _pick(_FIELDS, F.col("o_custkey")), _pick(_FIELDS, F.expr("o_orderkey div 4")))
    rows = table(spark, sf_dir, "orders").select(key.alias("pk"), _pick(["bid", "performance", "warranty"], key).alias("kind"), fields.alias("fields"))
    return rows.select("pk", "kind", op.security_exception(F.col("kind"), F.col("fields")).alias("exception"))


_STARTS = ["Срок 10 рабочих дней со дня, следующего за днем заключения контракта", "Со дня, следующего за приемкой", "с даты заключения контракта", "СО ДНЯ ЗАКЛЮЧЕНИЯ договора", "с момента заявки", ""]


@query(f"""WITH t AS (SELECT o_orderkey AS pk, lower({_pick_sql(_STARTS, "o_orderkey")} || '; ' || {_pick_sql(_STARTS, "o_custkey")}) AS t FROM orders)
SELECT pk, CASE WHEN contains(t, 'со дня, следующего') AND contains(t, 'заключ') THEN 'next_day_after_contract_signing' WHEN contains(t, 'с даты заключ') OR contains(t, 'со дня заключ') THEN 'contract_signing' END AS start_event FROM t""")
def start_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws("; ", _pick(_STARTS, F.col("o_orderkey")), _pick(_STARTS, F.col("o_custkey")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pk"), op.start_event(text).alias("start_event"))


_POINTS = " + ".join(f"(CASE WHEN {c} >= {least} THEN {p} ELSE 0 END)" for c, least, p in op.COMPLEXITY)


@query(f"""WITH {ITEMS}, {PARTS}, t AS (SELECT item AS pk, count(*) AS n_rows, count(DISTINCT source) AS n_cols, count(DISTINCT flag) AS n_header_rows, count(*) FILTER (discount > 8) AS n_warnings, count(*) FILTER (tax = 0 AND qty < 5) AS n_suspicious, sum(total) // 10000 AS n_chars, CASE WHEN item % 4 <> 0 THEN count(*) FILTER (role = 'O') END AS n_fallback FROM items GROUP BY item)
SELECT pk, points, points >= 60 AS repair FROM (SELECT pk, ({_POINTS} + least(30, coalesce(n_fallback, 0) * 3))::INTEGER AS points FROM t)""")
def table_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: F.count_if(c)
    tables = items(spark, sf_dir).groupBy(F.col("item").alias("pk")).agg(
        F.count("*").alias("n_rows"), F.countDistinct("source").alias("n_cols"), F.countDistinct("flag").alias("n_header_rows"), n(F.col("discount") > 8).alias("n_warnings"),
        n((F.col("tax") == 0) & (F.col("qty") < 5)).alias("n_suspicious"), F.expr("sum(total) div 10000").alias("n_chars"), F.when(F.col("item") % 4 != 0, n(F.col("role") == "O")).alias("n_fallback"),
    )
    return op.complexity(tables, 60).select("pk", "points", "repair")


@query(f"""WITH {PARTS}, f AS (SELECT size AS pk, code, arg_min(name, item) AS name, min(item) AS i FROM parts GROUP BY size, code) SELECT pk, (row_number() OVER (PARTITION BY pk ORDER BY i) - 1)::INTEGER AS place, code, nullif(CASE WHEN i % 5 = 0 THEN '' ELSE name END, '') AS name FROM f""")
def named_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text for each size, with the codes of its parts and their names, in three styles of writing; places are those of first codes."""
    p = parts(spark, sf_dir)
    name = F.when(F.col("item") % 5 == 0, "").otherwise(F.col("name"))
    raw = F.concat("code", F.when(F.col("item") % 3 == 0, " – ").otherwise(" "), name, F.when(F.col("item") % 2 == 0, ".;").otherwise("\n"))
    texts = p.groupBy(F.col("size").alias("pk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", raw.alias("raw")))), lambda x: x["raw"]), " ").alias("text"))
    found = op.codes_with_names(texts, "pk", "text", r"\d{2}\.\d{2}\.\d{2}\.\d{3}")
    return found.select("pk", (F.row_number().over(W.partitionBy("pk").orderBy("seq")) - 1).alias("place"), "code", "name")


@query(f"""WITH {ITEMS}, {PARTS}, w AS (SELECT pk, role, code, split_part(name, ' ', 1) AS short, name FROM items JOIN parts USING (item)), a AS (SELECT DISTINCT pk, code, short AS n FROM w WHERE role = 'O'), b AS (SELECT DISTINCT pk, code, name AS n FROM w WHERE role = 'F'),
m AS (SELECT DISTINCT a.pk, a.code, b.code AS s FROM a JOIN b ON a.pk = b.pk WHERE (array_to_string(string_split(a.code, '.')[1:3], '.') = array_to_string(string_split(b.code, '.')[1:3], '.') AND a.code <> b.code) OR (a.n <> '' AND b.n <> '' AND (contains(a.n, b.n) OR contains(b.n, a.n))))
SELECT pk, code, string_agg(s, ',' ORDER BY s) AS similar FROM m GROUP BY ALL""")
def similar_named_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = item_parts(spark, sf_dir, "code", "name")
    side = lambda role, name: w.where(F.col("role") == role).groupBy("pk", "code").agg(F.collect_set(name).alias("names"))
    return op.similar_by_name(side("O", F.split_part("name", F.lit(" "), F.lit(1))), side("F", F.col("name")))


@query(f"""WITH {ITEMS}, {PARTS}, l AS (SELECT pk, seq, name, qty, total, tax FROM items JOIN parts USING (item)), size AS (SELECT pk, max(seq) AS n FROM l GROUP BY pk),
f AS (SELECT pk AS doc_id, seq AS ord, CASE WHEN tax % 3 <> 0 THEN CASE WHEN tax = 1 THEN 'x' ELSE 't' END END AS table_id, CASE WHEN tax % 2 = 0 THEN (qty % 8)::INTEGER END AS r, (total % 4)::INTEGER AS c FROM l),
v AS (SELECT f.*, b.name AS block, n, x.name AS cname, x.qty AS cqty, x.total AS ctotal, x.pk IS NOT NULL AS there FROM f LEFT JOIN l b ON b.pk = doc_id AND b.seq = ord AND ord % 6 <> 0 LEFT JOIN size ON size.pk = doc_id AND table_id = 't' LEFT JOIN l x ON x.pk = doc_id AND x.seq = r + 1 AND table_id = 't'),
o AS (SELECT *, coalesce(block IS NOT NULL AND (table_id IS NULL OR (n IS NOT NULL AND (r IS NULL OR r < n) AND c < 3)), false) AS ok FROM v)
SELECT doc_id, ord, table_id, r, c, ok AS valid, CASE WHEN ok THEN CASE WHEN table_id IS NOT NULL AND r IS NOT NULL THEN coalesce([cname, cqty::VARCHAR, ctotal::VARCHAR][c + 1], '') ELSE block END END AS quote FROM o""")
def cited_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of a package's lines: blocks that may be missing, tables that may be others, rows and columns beyond the end."""
    l = item_parts(spark, sf_dir, "name").select("pk", "seq", "name", "qty", "total", "tax")  # noqa: E741
    tax = F.col("tax")
    found = l.select(F.col("pk").alias("doc_id"), F.col("seq").alias("ord"), F.when(tax % 3 != 0, F.when(tax == 1, "x").otherwise("t")).alias("table_id"), F.when(tax % 2 == 0, (F.col("qty") % 8).cast("int")).alias("r"), (F.col("total") % 4).cast("int").alias("c"))
    blocks = l.where("seq % 6 != 0").select(F.col("pk").alias("doc_id"), F.col("seq").alias("ord"), F.col("name").alias("text"))
    tables = l.groupBy(F.col("pk").alias("doc_id")).agg(F.max("seq").alias("n_rows")).select("doc_id", F.lit("t").alias("table_id"), "n_rows", F.lit(3).alias("n_cols"))
    texts = F.posexplode(F.array("name", F.col("qty").cast("string"), F.col("total").cast("string"))).alias("c", "text")
    cells = l.select(F.col("pk").alias("doc_id"), F.lit("t").alias("table_id"), (F.col("seq") - 1).alias("r"), texts)
    return op.validate_cells(found, blocks, tables, cells)


_SIDES = f"""{ITEMS}, {PARTS}, l AS (SELECT pk, seq, source, name, qty, brand AS unit, total FROM items JOIN parts USING (item)),
a AS (SELECT pk, seq, CASE WHEN seq % 3 <> 0 THEN seq END AS no, CASE WHEN seq % 4 <> 1 THEN name END AS name, qty, unit, CASE WHEN seq % 2 = 0 THEN total END AS total FROM l WHERE seq < 6),
b AS (SELECT pk, seq, CASE WHEN seq % 5 <> 0 THEN seq END AS no, name, qty, unit, total FROM l WHERE seq > 1)"""


@query(f"""WITH {_SIDES}, p1 AS (SELECT pk, x.s AS a, y.s AS b, 1 AS how FROM (SELECT pk, no, min(seq) AS s FROM a WHERE no IS NOT NULL GROUP BY ALL HAVING count(*) = 1) x JOIN (SELECT pk, no, min(seq) AS s FROM b WHERE no IS NOT NULL GROUP BY ALL HAVING count(*) = 1) y USING (pk, no)),
a2 AS (SELECT * FROM a WHERE (pk, seq) NOT IN (SELECT (pk, a) FROM p1)), b2 AS (SELECT * FROM b WHERE (pk, seq) NOT IN (SELECT (pk, b) FROM p1)),
p2 AS (SELECT pk, x.s AS a, y.s AS b, 2 AS how FROM (SELECT pk, name, qty, unit, min(seq) AS s FROM a2 WHERE trim(name) <> '' GROUP BY ALL HAVING count(*) = 1) x JOIN (SELECT pk, name, qty, unit, min(seq) AS s FROM b2 WHERE trim(name) <> '' GROUP BY ALL HAVING count(*) = 1) y USING (pk, name, qty, unit)),
a3 AS (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY seq) AS n FROM a2 WHERE (pk, seq) NOT IN (SELECT (pk, a) FROM p2)), b3 AS (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY seq) AS n FROM b2 WHERE (pk, seq) NOT IN (SELECT (pk, b) FROM p2)),
p AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT a3.pk, a3.seq, b3.seq, 0 FROM a3 JOIN b3 USING (pk, n))
SELECT a.pk, 'primary' AS origin, a.seq, coalesce(a.name, b.name) AS name, coalesce(a.total, b.total) AS total, how FROM a LEFT JOIN p ON p.pk = a.pk AND p.a = a.seq LEFT JOIN b ON b.pk = p.pk AND b.seq = p.b
UNION ALL SELECT pk, 'secondary', seq, name, total, NULL FROM b WHERE (pk, seq) NOT IN (SELECT (pk, b) FROM p)""")
def fill_gaps_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two extractions of the lines of a package: by row number, then by name, quantity and unit, then by place."""
    l = item_parts(spark, sf_dir, "name", "brand").select("pk", "seq", "name", "qty", F.col("brand").alias("unit"), "total")  # noqa: E741
    seq = F.col("seq")
    a = l.where("seq < 6").select("pk", "seq", F.when(seq % 3 != 0, seq).alias("no"), F.when(seq % 4 != 1, F.col("name")).alias("name"), "qty", "unit", F.when(seq % 2 == 0, F.col("total")).alias("total"))
    b = l.where("seq > 1").select("pk", "seq", F.when(seq % 5 != 0, seq).alias("no"), "name", "qty", "unit", "total")
    return merge.fill_gaps_cascade(a, b, [["no"], ["name", "qty", "unit"]], "pk", "seq", ["name", "total"])


_HEADERS = [
    ["Наименование", "Поставщик №1 / Цена за ед.", "Поставщик №1 / Стоимость", "Исполнитель 2 / Цена за ед.", "Исполнитель 2 / Сумма", "Минимальная цена"],
    ["Наименование", "Поставщик 3 / цена услуги", "Поставщик 4 / цена услуги", "Всего"],
    ["№ п/п", "Наименование", "Количество", "Цена за ед.", "Стоимость", "Цена за ед.", "Стоимость", "Минимальная цена за единицу", "Сумма, руб."],
    ["Наименование", "Ед. изм.", "Кол-во", "Цена", "Стоимость", "Цена", "Стоимость", "Цена", "Стоимость", "Цена контракта, руб."],
    ["Количество", "Наименование", "Цена за ед.", "Стоимость", "Сумма"],
    ["Наименование", "Цена за ед.", "Цена контракта", "Количество"],
    ["Наименование", "Количество", "Цена за ед.", "Стоимость"],
    ["Поставщик 7", "Наименование", "Цена за ед.", "Стоимость", "Минимальная цена"],
    ["Цена за ед.", "Стоимость", "Минимальная цена"],
]
_HEADERS_SQL = "[" + ", ".join("[" + ", ".join(map(_q, h)) + "]" for h in _HEADERS) + "]"


@query(f"""WITH h AS (SELECT doc_id, 't' AS table_id, i - 1 AS c, lower(p[i]) AS t FROM (SELECT doc_id, p, unnest(generate_series(1, len(p))) AS i FROM (SELECT o_orderkey AS doc_id, {_HEADERS_SQL}[(o_custkey + o_orderkey) % {len(_HEADERS)} + 1] AS p FROM orders))),
s AS (SELECT doc_id, table_id, c, t, TRY_CAST(regexp_extract(t, '(?:поставщик|исполнитель)\\s*(?:№\\s*)?([0-9]+)', 1) AS INTEGER) AS source, CASE WHEN contains(t, 'стоимость') OR contains(t, 'сумма') THEN 'total' WHEN contains(t, 'цена за ед') OR contains(t, 'цена услуги') THEN 'price' END AS measure FROM h),
e AS (SELECT doc_id, count(*) FILTER (source IS NOT NULL AND measure IS NOT NULL) AS n_named,
  greatest(min(c) FILTER (contains(t, 'наименование')), min(c) FILTER (contains(t, 'количество') OR contains(t, 'кол-во')), min(c) FILTER (contains(t, 'ед. изм'))) + 1 AS first,
  coalesce(min(c) FILTER (contains(t, 'минимальная цена')), min(c) FILTER (contains(t, 'цена контракта')), min(c) FILTER (contains(t, 'сумма') OR contains(t, 'всего'))) AS last FROM s GROUP BY doc_id),
k AS (SELECT s.*, count(*) OVER (PARTITION BY doc_id, source) AS n FROM s JOIN e USING (doc_id) WHERE n_named > 0 AND source > 0 AND measure IS NOT NULL)
SELECT doc_id, table_id, c::INTEGER AS c, source, unnest(CASE WHEN n = 1 AND measure = 'price' THEN ['price', 'total'] ELSE [measure] END) AS measure FROM k
UNION ALL SELECT doc_id, table_id, c::INTEGER, ((c - first) // 2 + 1)::INTEGER, CASE WHEN (c - first) % 2 = 0 THEN 'price' ELSE 'total' END FROM s JOIN e USING (doc_id) WHERE n_named = 0 AND c >= first AND c < last""")
def supplier_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price matrices of nine forms."""
    forms = F.array(*[F.array(*map(F.lit, h)) for h in _HEADERS])
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("t").alias("table_id"), F.posexplode(F.get(forms, (F.col("o_custkey") + F.col("o_orderkey")) % len(_HEADERS))).alias("c", "path"))
    return op.supplier_columns(rows)


_DUES = [("supplier", "value", a, b, p) for a, b, p in rules.PENALTY_PERCENTS] + [(who, "non_value", a, b, x) for who in ("supplier", "customer") for a, b, x in rules.PENALTY_AMOUNTS]
_DUE_SQL = ", ".join(f"('{w}', '{k}', {'NULL' if a is None else a}::BIGINT, {'NULL' if b is None else b}::BIGINT, {x}::DECIMAL(18,4))" for w, k, a, b, x in _DUES)


@query(f"""WITH b(party, kind, above, upto, due) AS (VALUES {_DUE_SQL}), f AS (SELECT o_orderkey AS pk, o_custkey AS k, round(o_totalprice * 100)::BIGINT * 40 AS amount FROM orders),
need AS (SELECT pk, k, party, kind, due FROM f JOIN b ON (above IS NULL OR amount > above) AND (upto IS NULL OR amount <= upto)),
c AS (SELECT pk, party, CASE WHEN party = 'customer' AND pk % 2 = 0 THEN 'value' ELSE kind END AS kind, CASE WHEN pk % 5 < 2 THEN due + 1 ELSE due END AS stated FROM need WHERE (pk + length(kind) + length(party)) % 3 <> 0),
t AS (SELECT pk, CASE WHEN k % 4 = 0 THEN 'Штраф 5000 рублей, пени 0,4 %' WHEN k % 4 = 1 THEN 'Штраф 100000 рублей. 10 процентов.' WHEN k % 4 = 2 THEN 'штраф 150001; 0.45' END AS t FROM f),
m AS (SELECT need.pk, need.party, need.kind, need.due, stated, CASE WHEN due = floor(due) THEN due::BIGINT::VARCHAR ELSE replace(rtrim(due::VARCHAR, '0'), '.', '[.,]') END AS num FROM need LEFT JOIN c ON c.pk = need.pk AND c.party = need.party AND (c.party = 'customer' OR c.kind = need.kind)),
s AS (SELECT m.*, regexp_matches(coalesce(t, ''), '(?:^|[^0-9.,])' || num || '(?:[^0-9.,]|[.,](?:[^0-9]|$)|$)') AS said FROM m JOIN t ON t.pk = m.pk)
SELECT pk, party, kind, due, stated, CASE WHEN stated = due OR (stated IS NOT NULL AND kind = 'value') THEN 'clause' WHEN said THEN 'text' WHEN stated IS NOT NULL THEN 'clause' ELSE 'none' END AS origin,
CASE WHEN stated = due THEN 'passed' WHEN stated IS NOT NULL AND kind = 'value' THEN 'failed' WHEN said THEN 'passed' WHEN kind = 'value' THEN 'failed' WHEN party = 'customer' AND stated IS NULL THEN 'failed' ELSE 'manual_review' END AS status FROM s""")
def penalties_by_party(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts whose clauses state what is due, one more, or nothing, with a text that may say it."""
    dues = spark.createDataFrame([(*row[:4], Decimal(row[4])) for row in _DUES], "party string, kind string, above bigint, upto bigint, due decimal(18,4)")
    orders = table(spark, sf_dir, "orders")
    f = dealt(orders, "o_orderkey", orders.count()).select(F.col("o_orderkey").alias("pk"), F.col("o_custkey").alias("k"), (F.round(F.col("o_totalprice") * 100).cast("bigint") * 40).alias("amount"))
    none = spark.createDataFrame([], "pk bigint, party string, kind string, stated decimal(18,4)")
    need = op.penalties_by_party(f, none, dues, f.select("pk", F.lit("").alias("text"))).where((F.col("pk") + F.length("kind") + F.length("party")) % 3 != 0)
    kind = F.when((F.col("party") == "customer") & (F.col("pk") % 2 == 0), "value").otherwise(F.col("kind"))
    clauses = need.select("pk", "party", kind.alias("kind"), F.when(F.col("pk") % 5 < 2, F.col("due") + 1).otherwise(F.col("due")).cast("decimal(18,4)").alias("stated"))
    n = F.col("k") % 4
    text = F.when(n == 0, "Штраф 5000 рублей, пени 0,4 %").when(n == 1, "Штраф 100000 рублей. 10 процентов.").when(n == 2, "штраф 150001; 0.45")
    return op.penalties_by_party(f, clauses, dues, f.select("pk", text.alias("text")))


@query("""WITH f AS (SELECT o_orderkey AS pk, o_custkey AS k, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus <> 'P' END AS required FROM orders),
c AS (SELECT l_orderkey AS pk, CASE l_suppkey % 4 WHEN 0 THEN 'delay' WHEN 1 THEN 'subcontract' ELSE 'value' END AS kind, CASE WHEN l_linenumber % 2 = 0 THEN 5 ELSE 7 END::DECIMAL(18,4) AS stated FROM lineitem),
s AS (SELECT pk, count(*) FILTER (kind = 'delay') AS d, count(*) FILTER (kind = 'subcontract') AS n, count(*) FILTER (kind = 'subcontract' AND stated = 5) AS good, min(stated) FILTER (kind = 'subcontract') AS stated FROM c GROUP BY pk)
SELECT pk, 'delay' AS kind, NULL::DECIMAL(18,4) AS stated, CASE WHEN d > 0 THEN 'passed' ELSE 'manual_review' END AS status FROM f LEFT JOIN s USING (pk)
UNION ALL SELECT pk, 'subcontract', stated, CASE WHEN NOT coalesce(required, false) THEN 'not_applicable' WHEN good > 0 OR k % 4 = 1 THEN 'passed' WHEN coalesce(n, 0) = 0 THEN 'failed' ELSE 'manual_review' END FROM f LEFT JOIN s USING (pk)""")
def other_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delay formulas and the percent for missing subcontractors, in clauses or in the text of every fourth customer."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pk"), F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus") != "P").alias("required"))
    n = F.col("l_suppkey") % 4
    clauses = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pk"), F.when(n == 0, "delay").when(n == 1, "subcontract").otherwise("value").alias("kind"), F.when(F.col("l_linenumber") % 2 == 0, 5).otherwise(7).cast("decimal(18,4)").alias("stated"))
    k = F.col("k") % 4
    text = F.when(k == 0, "За непривлечение СМП штраф 15 процентов").when(k == 1, "За непривлечение СОНКО штраф 5 (пять) процентов").when(k == 2, "штраф 5 %")
    return op.other_penalties(orders, clauses, orders.select("pk", text.alias("text")))
