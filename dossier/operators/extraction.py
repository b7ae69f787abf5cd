"""From blocks and cells to typed rows: table types, specifications, stages, attachments, facts, justifications and offers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import extract_dates, norm_text, norm_unit, to_decimal
from ..sources.shared import small
from .tables import TABLE, attach_children, classify_rows, select_columns

OFFER_LINE = r"^(\d{1,3})[.)]? +(.+?) +(шт|ед|компл|кг|м|усл)\.? +(\d+(?:,\d+)?) +(\d[\d ]*,\d{2}) +(\d[\d ]*,\d{2})$"


def table_type(tables: DataFrame, rules: list[tuple[str | None, list[str], str]]) -> DataFrame:
    """Business type of a table (doc_type, text): the first rule (doc_type or None for any, markers, type) that holds."""
    low = F.lower("text")

    def holds(doc_type: str | None, markers: list[str]) -> Column:
        every = reduce(lambda a, b: a & b, [F.contains(low, F.lit(m)) for m in markers], F.lit(True))
        return every if doc_type is None else every & (F.col("doc_type") == doc_type)

    kind = F.coalesce(*[F.when(holds(d, ms), F.lit(k)) for d, ms, k in rules], F.lit("other"))
    return tables.withColumn("table_type", kind)


def spec_rows(cells: DataFrame, paths: DataFrame, keywords: dict[str, str], numbers: list[str]) -> DataFrame:
    """Rows of a specification: columns by header keyword, the named ones as numbers; total, numbering and empty rows go."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("c", "text"))), lambda x: x["text"])
    good = classify_rows(cells.groupBy(*TABLE, "r").agg(texts.alias("texts"))).where("row_type = 'item'").select(*TABLE, "r")
    wide = select_columns(cells.join(good, [*TABLE, "r"], "left_semi"), paths, keywords)
    return wide.select(*TABLE, "r", *[to_decimal(F.col(k)).alias(k) if k in numbers else F.col(k) for k in keywords])


def typed_rows(rows: DataFrame, columns: list[str], numbers: list[str]) -> DataFrame:
    """``spec_rows`` for the rows of ``column_rows``: nothing is joined or grouped."""
    found = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])
    good = classify_rows(rows.where(found).withColumn("texts", F.transform("cells", lambda x: x["text"]))).where("row_type = 'item'")
    text = lambda c: F.col(c)["text"]
    return good.select(*TABLE, "r", *[(to_decimal(text(c)) if c in numbers else text(c)).alias(c) for c in columns])


def stage_rows(rows: DataFrame) -> DataFrame:
    """Rows with a stage number: number, name, first and last date of the term, price. Input: key columns, number, name, term, price."""
    dates = extract_dates(F.col("term"))
    good = rows.where(F.trim("number").rlike(r"^\d+(?:\.\d+)*\.?$"))
    return good.withColumn("start_date", F.array_min(dates)).withColumn("end_date", F.array_max(dates)).withColumn("price", to_decimal(F.col("price"), 2)).withColumn("number", F.regexp_replace(F.trim("number"), r"\.$", ""))


def attachment_rows(docs: DataFrame, stop: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Attachments 'Приложение № 2 – title' of a text: key, seq, number, title; titles with a stop word go, repeats too."""
    mark = r"(?iu)приложение ?№ ?(\d+)[ –-]+([^;\n]+)"
    found = docs.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(mark), F.lit(0))).alias("seq", "raw"))
    rows = found.select(key, "seq", F.regexp_extract("raw", mark, 1).alias("number"), F.trim(F.regexp_extract("raw", mark, 2)).alias("title"))
    bad = reduce(lambda a, b: a | b, [F.contains(F.lower("title"), F.lit(s)) for s in stop], F.lit(False))
    first = F.row_number().over(W.partitionBy(key, norm_text(F.col("title"))).orderBy("seq"))
    return rows.where(~bad).withColumn("_n", first).where("_n = 1").drop("_n")


def items_from_tables(rows: DataFrame, is_item: Column, key: Column) -> DataFrame:
    """Items of all kinds of tables: rows keyed by code or name with the number of rows that belong to each."""
    seen = attach_children(rows, is_item, key)
    own = seen.where("parent_r is not null").groupBy(*TABLE, "parent_r").agg(F.count("*").alias("n_rows"), F.min_by(key, "r").alias("item_key"))
    return own.withColumnRenamed("parent_r", "r")


def build_facts(blocks: DataFrame, rules: DataFrame, key: str = "doc_id") -> DataFrame:
    """Facts of documents: for each rule (field, pattern with one group; a small table) its first match in order."""
    met = blocks.join(small(rules), F.regexp_like("text", "pattern"))
    first = met.groupBy(key, "field").agg(F.min_by(F.struct("ord", "text", "pattern"), "ord").alias("b"))
    raw = F.trim(F.call_function("regexp_extract", F.col("b.text"), F.col("b.pattern"), F.lit(1)))
    return first.select(key, "field", F.col("b.ord").alias("ord"), raw.alias("raw"), norm_text(raw).alias("norm"))


def justifications(tabled: DataFrame, texts: DataFrame) -> DataFrame:
    """Justifications of tables and of plain text, once for each (item, text); that of a table stands. Both: pk, item, seq, text."""
    every = tabled.withColumn("origin", F.lit("table")).unionByName(texts.withColumn("origin", F.lit("text"))).where(norm_text(F.col("text")) != "")
    first = F.row_number().over(W.partitionBy("pk", "item", norm_text(F.col("text"))).orderBy("origin", "seq"))
    return every.withColumn("_n", first).where("_n = 1").drop("_n")


def offers_from_text(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines of an offer in a text layer: number, name, unit, quantity, price, total."""
    part = lambda n: F.regexp_extract("text", OFFER_LINE, n)
    lines = blocks.where(F.col("text").rlike(OFFER_LINE))
    return lines.select(key, "ord", part(1).cast("int").alias("number"), part(2).alias("name"), norm_unit(part(3)).alias("unit"), to_decimal(part(4), 3).alias("qty"), to_decimal(part(5), 2).alias("price"), to_decimal(part(6), 2).alias("total"))


def order_by_role(rows: DataFrame, roles: list[str], role: str = "role") -> DataFrame:
    """Place of each row in the order of roles; other roles come last."""
    place = F.array_position(F.array(*[F.lit(r) for r in roles]), F.col(role)).cast("int")
    return rows.withColumn("place", F.when(place > 0, place).otherwise(F.lit(len(roles) + 1)))


# Lines that are a unit (letters only), and the words of an offer's requisites.
UNIT_LINES = ["шт", "штука", "штук", "услед", "услуга", "компл", "комплект"]
OFFER_SUM = r"(?iu)Сумма\s+коммерческого\s+предложения"
OFFER_TOTAL = OFFER_SUM + r"\s+составляет\s*:\s*(\d[\d\s\u00a0]*(?:[,.]\d{2})?)"
OFFER_HEADER = r"(?m)^[ \t\u00a0]*(\d{2}\.\d{2}\.\d{4})[ \t\u00a0]*№[ \t\u00a0]*([^\r\n]+?)[ \t\u00a0\r]*$"
OFFER_SUPPLIER = r"""(?iu)(?<![\p{L}\p{N}_])(ООО[\s\u00a0]+(?:«[^»]+»|"[^"]+"|[А-ЯЁA-Z][^,\n]{1,60}?))[\s\u00a0]+предлагает(?![\p{L}\p{N}_])"""
OFFER_TERM = r"(?imu)^\s*Срок\s+(?:поставки|оказания|выполнения)[^:\r\n]*:\s*([^\r\n]+)"
REGISTRY_NOTE = r"(?iu)№\s*реестровой\s+записи\s+\d+"
TRADEMARK = r"(?iu)товарный\s+знак\s+(.+)$"
# Where the text of an offer is cut: before the number of an item, before its unit if four lines follow, at the sum. What
# isn't a letter in lower case doesn't count in a unit; the last two have a lower case among a-z.
_REST = r"[^a-zA-Zа-яА-ЯёЁ\u212a\u0130\n]*+"
_ITEM = r"\n(?=\d++\.\d++[\u0085\u2028\u2029]?(?:\n|\z))"
_UNIT = r"(\n" + _REST + "(?:" + "|".join("".join(("[еЕёЁ]" if c == "е" else f"[{c}{c.upper()}]") + _REST for c in w) + r"(?=\n)" for w in UNIT_LINES) + r")(?:\n[^\n]++){4})"
_SUM = r"\n" + OFFER_SUM.replace(r"\s+", " ") + "(?s:.*)"


def offer_requisites(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, number, date, supplier, total, term, vat_text of the text layer of an offer; what isn't there is null."""
    part = lambda pattern, n: F.nullif(F.trim(F.regexp_extract("text", pattern, n)), F.lit(""))
    free, rate = F.col("text").rlike(r"(?iu)без\s+НДС(?![\p{L}])"), F.col("text").rlike(r"(?m)^\s*(?:20|22)\s*$")
    vat = F.when(free & rate, "mixed").when(free, "exempt")
    squeezed = lambda c: F.regexp_replace(c, r"[\s\u00a0]+", " ")
    return docs.select(
        key, part(OFFER_HEADER, 2).alias("number"), F.try_to_date(part(OFFER_HEADER, 1), "dd.MM.yyyy").alias("date"), squeezed(part(OFFER_SUPPLIER, 1)).alias("supplier"),
        to_decimal(part(OFFER_TOTAL, 1), 2).alias("total"), part(OFFER_TERM, 1).alias("term"), vat.alias("vat_text"),
    )


def offer_text_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ord, row_number, name, trademark, unit, qty, price, vat_text, vat_rate, total, notes: items that run over lines.

    A line of two numbers with a point begins an item, which goes on to the next such line, the last one to the sum of the
    offer. Lines up to the unit are the name; the four after it are quantity, price, VAT and total. An item without a
    unit, with fewer lines after it or with one that is no number is left out. Texts are cut where they lie: only the
    items of a document become rows. A null text has none.
    """
    put = lambda c, *pairs: reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)
    plain = put(F.col("text"), ("\u00a0", " "), ("\t", " "), ("\r", "\n"), ("\x0b", "\n"), ("\x0c", "\n"))
    lines = F.btrim(F.regexp_replace(put(F.regexp_replace(plain, " {2,}", " "), (" \n", "\n"), ("\n ", "\n")), "\n{2,}", "\n"), F.lit(" \n"))
    marked = docs.select(key, F.split(F.concat(F.lit("\n"), lines), _ITEM).alias("parts"))
    value = lambda s, k: F.get(s["values"], k)
    number = lambda x, scale: F.when(x.rlike(r"\d"), to_decimal(x, scale))
    # what a note leaves at the ends of the name goes with it
    name = lambda raw: F.regexp_replace(F.regexp_replace(raw, REGISTRY_NOTE, ""), r"^[ ,]+|[ ,]+$", "")
    # a filter on rows would be pushed below what it asks for, which would then be worked out again for each use
    # split with a pattern compiles it for each text, the others once
    cut = F.transform(F.slice("parts", 2, F.size("parts")), lambda x, j: F.struct(j.alias("ord"), F.when(j == F.size("parts") - 2, F.regexp_replace(x, _SUM, "")).otherwise(x).alias("item")))
    cut = F.transform(cut, lambda s: F.struct(s["ord"].alias("ord"), s["item"].alias("item"), F.regexp_extract(s["item"], _UNIT, 1).alias("tail")))
    cut = F.filter(cut, lambda s: s["tail"] != "")
    cut = F.transform(cut, lambda s: F.struct(s["ord"].alias("ord"), F.split(F.call_function("substring_index", s["item"], s["tail"], F.lit(1)), "\n", 2).alias("head"), F.split(s["tail"], "\n").alias("values")))
    cut = F.transform(cut, lambda s: F.struct(
        s["ord"].alias("ord"), s["head"][0].alias("row_number"), F.replace(F.coalesce(F.get(s["head"], F.lit(1)), F.lit("")), F.lit("\n"), F.lit(" ")).alias("raw"), value(s, 1).alias("unit"),
        number(value(s, 2), 6).alias("qty"), number(value(s, 3), 2).alias("price"), value(s, 4).alias("vat_text"), number(value(s, 5), 2).alias("total"),
    ))
    cut = F.filter(cut, lambda s: s["qty"].isNotNull() & s["price"].isNotNull() & s["total"].isNotNull())
    cut = F.transform(cut, lambda s: F.struct(*[s[n].alias(n) for n in ("ord", "row_number", "raw", "unit", "qty", "price", "vat_text", "total")], name(s["raw"]).alias("name")))
    return marked.select(key, F.inline(cut)).select(
        key, "ord", "row_number", "name", F.nullif(F.regexp_extract("name", TRADEMARK, 1), F.lit("")).alias("trademark"), "unit", "qty", "price", "vat_text",
        F.when(F.col("vat_text").rlike(r"^\d+(?:[,.]\d+)?$"), to_decimal(F.col("vat_text"), 2)).alias("vat_rate"), "total", F.regexp_extract_all("raw", F.lit(REGISTRY_NOTE), F.lit(0)).alias("notes"),
    )
