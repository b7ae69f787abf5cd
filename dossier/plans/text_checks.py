"""Column functions over documents, part, lineitem, supplier and customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from .registry import ITEMS, PARTS, items, parts, query, table
from .rule_checks import _NORM


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"SELECT doc_id, sha256({_NORM('text')}) AS norm, length({_NORM('text')}) AS n FROM documents")
def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2(fn.norm_text(F.col("text")), 256).alias("norm"), F.length(fn.norm_text(F.col("text"))).alias("n"))


_TYPO = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(text, '«»“”„–—', '"""  '"""""--' + r"""'), '[\r\n]+', '; ', 'g'), '[ \t]+', ' ', 'g'), ' ?,( ?,)+', ',', 'g'), ' ?;( ?;)+', ';', 'g'), ' ([,;])', '\1', 'g'))"""


@query(f"SELECT doc_id, sha256({_TYPO}) AS clean FROM documents".replace("'\"\"\"\"\"--'", "'\"\"\"\"\"--'"))
def typography(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2(fn.clean_typography(F.col("text")), 256).alias("clean"))


@query(f"SELECT p_partkey, replace({_NORM('p_name || $$ «X»$$ || p_type')}, ' ', '_') AS key, array_to_string(list_filter(string_split({_NORM('p_name')}, ' '), lambda w: w NOT IN ('red', 'small')), ' ') AS name FROM part".replace("$$", "'"))
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", fn.norm_key(F.concat("p_name", F.lit(" «X»"), "p_type")).alias("key"), fn.name_key(F.col("p_name"), ["red", "small"]).alias("name"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'шт' WHEN 1 THEN 'компл' WHEN 2 THEN lower(p_type) ELSE 'шт' END AS unit FROM part")
def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size") % 4
    raw = F.when(n == 0, "Штука").when(n == 1, " комплект.").when(n == 2, F.col("p_type")).otherwise("шт.")
    return table(spark, sf_dir, "part").select("p_partkey", fn.norm_unit(raw).alias("unit"))


@query(f"""WITH {PARTS} SELECT item, code, ktru, left(ktru, 12) AS parent, true AS good, false AS bad FROM parts""")
def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blanks inside a code go; its parent is its first twelve characters."""
    spaced = F.concat(F.substring("ktru", 1, 5), F.lit(" \t"), F.substring("ktru", 6, 99))
    clean = fn.norm_code(spaced)
    return parts(spark, sf_dir).select("item", "code", clean.alias("ktru"), fn.derive_parent(clean).alias("parent"), fn.valid_code(clean).alias("good"), fn.valid_code(F.concat("code", F.lit("x"))).alias("bad"))


@query("SELECT p_partkey, replace(replace(replace(p_name, 'e', 'е'), 'o', 'о'), 'a', 'а') AS folded FROM (SELECT p_partkey, replace(replace(replace(replace(p_name, 'c', 'с'), 'p', 'р'), 'x', 'х'), 'y', 'у') AS p_name FROM part) t".replace("SELECT p_partkey, replace(replace(replace(p_name", "SELECT p_partkey, replace(replace(replace(replace(p_name, 'k', 'к')"))
def homoglyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", fn.fold_homoglyphs(F.col("p_name")).alias("folded"))


#: Prose about a line: a price with words, percents, dates and a term.
_PROSE = f"""{ITEMS}, prose AS (SELECT pk, seq, qty, total, tax, discount, day, 'Цена ' || (total // 100) || ' руб. ' || lpad((total % 100)::VARCHAR, 2, '0') || ' коп., аванс ' || qty || ' руб., налог ' || tax || '%, скидка ' || discount || ',5 %, от ' || strftime(day, '%d.%m.%Y') || ' до 31.02.2024, срок ' || qty || ' рабочих дней с даты подписания. Конец' AS t FROM items)"""


def _prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda x: F.col(x).cast("string")
    t = F.concat(F.lit("Цена "), F.expr("total div 100").cast("string"), F.lit(" руб. "), F.lpad((F.col("total") % 100).cast("string"), 2, "0"), F.lit(" коп., аванс "), s("qty"), F.lit(" руб., налог "), s("tax"), F.lit("%, скидка "), s("discount"), F.lit(",5 %, от "), F.date_format("day", "dd.MM.yyyy"), F.lit(" до 31.02.2024, срок "), s("qty"), F.lit(" рабочих дней с даты подписания. Конец"))
    return items(spark, sf_dir).withColumn("t", t)


@query(f"WITH {_PROSE} SELECT pk, seq, (total / 100)::DECIMAL(18,2) AS money, list_distinct([(total // 100)::DECIMAL(18,2), qty::DECIMAL(18,2)])[1] IS NOT NULL AS amounts FROM prose".replace("list_distinct([(total // 100)::DECIMAL(18,2), qty::DECIMAL(18,2)])[1] IS NOT NULL AS amounts", "CASE WHEN total // 100 = qty THEN qty::VARCHAR || '.00' ELSE (total // 100) || '.00,' || qty || '.00' END AS amounts"))
def money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roubles and kopeks in words, and all amounts before a currency word."""
    return _prose(spark, sf_dir).select("pk", "seq", fn.extract_money(F.col("t")).alias("money"), F.array_join(fn.extract_amounts(F.col("t")).cast("array<string>"), ",").alias("amounts"))


@query(f"WITH {_PROSE} SELECT pk, seq, tax || '.00,' || discount || '.50' AS percents FROM prose")
def percents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prose(spark, sf_dir).select("pk", "seq", F.array_join(fn.extract_percents(F.col("t")).cast("array<string>"), ",").alias("percents"))


@query(f"WITH {_PROSE} SELECT pk, seq, day::VARCHAR AS dates FROM prose")
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date that doesn't exist is left out."""
    return _prose(spark, sf_dir).select("pk", "seq", F.array_join(fn.extract_dates(F.col("t")).cast("array<string>"), ",").alias("dates"))


@query(f"WITH {_PROSE} SELECT pk, seq, qty::INTEGER AS days, 'working' AS day_type, 'подписания' AS start_event FROM prose")
def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    term = F.regexp_extract("t", "срок (.*)$", 0)
    return _prose(spark, sf_dir).select("pk", "seq", fn.parse_term(term).alias("x")).select("pk", "seq", "x.*")


@query("SELECT p_partkey, p_size <= 20 AS up_to, p_size > 5 AND p_size < 30 AS between_, NULL::BOOLEAN AS none FROM part")
def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size").cast("decimal(24,6)")
    return table(spark, sf_dir, "part").select("p_partkey", fn.in_range(n, F.lit("<= 20")).alias("up_to"), fn.in_range(n, F.lit("> 5 и <30,0")).alias("between_"), fn.in_range(n, F.lit("any")).alias("none"))


@query(f"WITH {PARTS} SELECT item, ktru AS long_codes, code AS short_codes FROM parts")
def extract_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The short code inside a long one isn't found on its own."""
    t = F.concat(F.lit("Код "), F.col("ktru"), F.lit(" и "), F.col("code"), F.lit("; 12345.67"))
    return parts(spark, sf_dir).select("item", F.array_join(fn.long_codes(t), ",").alias("long_codes"), F.array_join(fn.short_codes(t), ",").alias("short_codes"))


@query("""SELECT p_partkey, concat_ws('|', p_name, p_type, p_brand) AS by_line, CASE WHEN p_name <> p_type THEN concat_ws('|', p_name, p_type) END AS by_comma FROM part""")
def split_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat("p_name", F.lit("; "), "p_type", F.lit(" ;\n"), "p_brand", F.lit(";"), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(fn.split_values(line), "|").alias("by_line"), F.array_join(fn.split_values(F.concat_ws(", ", "p_name", "p_type")), "|").alias("by_comma"))


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?is)license.{0,20}'))), '|') AS found FROM documents""")
def keyword_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(fn.keyword_windows(F.col("text"), "license", 20)), "|").alias("found"))


@query(f"""WITH {ITEMS} SELECT pk, seq, '1 этап – поставка ' || qty || '. |2 этап – монтаж ' || tax AS parts FROM items""")
def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("Сроки: 1 этап – поставка "), F.col("qty"), F.lit(". 2 этап – монтаж "), F.col("tax"))
    return items(spark, sf_dir).select("pk", "seq", F.array_join(fn.fragments(t, r"\d+ этап"), "|").alias("parts"))


@query("""WITH t AS (SELECT p_partkey, list_distinct(list_filter(string_split(p_name, ' '), lambda w: length(w) >= 3)) AS a, list_distinct(list_filter(string_split(lower(p_name || ' ' || p_type), ' '), lambda w: length(w) >= 3)) AS b FROM part)
SELECT p_partkey, len(b)::INTEGER AS n, round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 6) AS jaccard, true AS supported FROM t""")
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = fn.name_tokens(F.col("p_name")), fn.name_tokens(F.concat_ws(" ", "p_name", "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(b).alias("n"), F.round(fn.jaccard(a, b), 6).alias("jaccard"), fn.name_support(a, b).alias("supported"))


@query("""SELECT c_custkey, c_nationkey::VARCHAR AS houses, 'ленина' AS street, 'москва' AS city FROM customer""")
def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.concat(F.lit("г. Москва, ул. Ленина, д. "), F.col("c_nationkey"))
    x = fn.address_core(a)
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(x["houses"], ",").alias("houses"), x["street"].alias("street"), x["city"].alias("city"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS answer FROM customer")
def to_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey") % 4
    raw = F.when(n == 0, "Да").when(n == 1, "Не требуется").when(n == 2, "НЕТ.").otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", fn.to_bool(raw).alias("answer"))


@query(f"""WITH {ITEMS} SELECT pk, seq, seq % 3 <> 0 AS required, CASE WHEN seq % 3 <> 0 THEN (tax + 0.5)::DECIMAL(9,4) END AS percent, CASE WHEN seq % 3 <> 0 THEN qty::DECIMAL(18,2) END AS amount, seq % 3 = 1 AS by_reference FROM items""")
def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.col("tax"), F.lit(",5 % или "), F.col("qty"), F.lit(" руб."))
    raw = F.when(F.col("seq") % 3 == 0, "Не требуется").when(F.col("seq") % 3 == 1, F.concat(body, F.lit(" согласно пункт 4"))).otherwise(body)
    x = fn.parse_security(raw)
    return items(spark, sf_dir).select("pk", "seq", x.alias("x")).select("pk", "seq", "x.*")


_KINDS = [("license", "licence"), ("@", "contact"), ("!!", "shout"), (" | ", "table")]


@query("SELECT doc_id, CASE " + " ".join(f"WHEN contains(lower(text), '{m}') THEN '{k}'" for m, k in _KINDS) + " ELSE 'unknown' END AS kind FROM documents")
def classify_by_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", fn.classify_by_markers(F.col("text"), _KINDS).alias("kind"))


@query("SELECT p_partkey, CASE WHEN contains(n, 'red') AND contains(n, 'promo') THEN 'both' WHEN contains(n, 'red') THEN 'red' WHEN contains(n, 'promo') THEN 'promo' END AS header FROM (SELECT p_partkey, lower(p_name || ' ' || p_type) AS n FROM part)")
def header_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("both", ["red", "promo"]), ("red", ["red"]), ("promo", ["promo"])]
    return table(spark, sf_dir, "part").select("p_partkey", fn.norm_header(F.concat_ws(" / ", "p_name", "p_type"), rules).alias("header"))


@query(f"WITH {ITEMS} SELECT pk, seq, item || '-' || seq || '/К' AS number, day AS date FROM items")
def requisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("Письмо № "), F.col("item"), F.lit("-"), F.col("seq"), F.lit("/К от "), F.date_format("day", "dd.MM.yyyy"))
    x = fn.parse_requisites(raw)
    return items(spark, sf_dir).select("pk", "seq", x["number"].alias("number"), x["date"].alias("date"))


@query(f"WITH {ITEMS} SELECT pk, seq, (qty + 0.5)::DECIMAL(24,6) AS parsed, NULL::DECIMAL(24,6) AS bad, (total / 100)::DECIMAL(18,2) AS money, true AS same FROM items")
def decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("~ "), F.col("qty"), F.lit(",5 шт"))
    cents = (F.col("total") / 100).cast("decimal(24,6)")
    return items(spark, sf_dir).select("pk", "seq", fn.to_decimal(raw).alias("parsed"), fn.to_decimal(F.lit("нет-")).alias("bad"), fn.to_money(cents).alias("money"), fn.money_equal(cents, cents).alias("same"))
