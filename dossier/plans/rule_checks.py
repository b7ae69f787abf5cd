"""Bands, thresholds, clauses and terms over orders, lineitem, documents and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import guards
from ..operators import rules as op
from .price_checks import _status
from .registry import ITEMS, PACKAGES, items, packages, query, table

_SECURITY = ", ".join(f"('{k}', {a if a is not None else 'NULL::BIGINT'}, {b if b is not None else 'NULL::BIGINT'}, {p}::DECIMAL(9,4), {q}::DECIMAL(9,4))" for k, a, b, p, q in op.SECURITY_BANDS)
_null = lambda x: "NULL::BIGINT" if x is None else str(x)
_PERCENTS = ", ".join(f"({_null(a)}, {_null(b)}, {p}::DECIMAL(9,4))" for a, b, p in op.PENALTY_PERCENTS)
_AMOUNTS = ", ".join(f"({_null(a)}, {_null(b)}, {x}::BIGINT)" for a, b, x in op.PENALTY_AMOUNTS)


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in roubles up to a few hundred million: order totals by two hundred."""
    return packages(spark, sf_dir).withColumn("amount", F.col("amount") * 2)


@query(f"""WITH {PACKAGES}, bands(kind, above, upto, least, most) AS (VALUES {_SECURITY}),
f AS (SELECT pk, k.kind, amount * 2 AS amount, CASE WHEN pk % 11 <> 0 THEN ((pk % 70) / 2.0)::DECIMAL(9,4) END AS percent, status = 'P' AS exempt FROM packages, (VALUES ('bid'), ('performance'), ('warranty')) k(kind))
SELECT pk, f.kind, amount, percent, least, most, CASE WHEN exempt THEN 'not_applicable' ELSE {_status("percent IS NOT NULL", "percent BETWEEN least AND most")} END AS status
FROM f JOIN bands ON f.kind = bands.kind AND (above IS NULL OR amount > above) AND (upto IS NULL OR amount <= upto)""")
def security_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.explode(F.array(F.lit("bid"), F.lit("performance"), F.lit("warranty"))).alias("kind")
    percent = F.when(F.col("pk") % 11 != 0, ((F.col("pk") % 70) / 2).cast("decimal(9,4)"))
    facts = _facts(spark, sf_dir).select("pk", kind, "amount", percent.alias("percent"), (F.col("status") == "P").alias("exempt"))
    return op.security_bands(facts, op.security_band_table(spark))


@query(f"""WITH {PACKAGES}, f AS (SELECT pk, k.kind, CASE WHEN pk % 17 <> 0 THEN amount * 2 END AS amount, CASE WHEN pk % 11 <> 0 THEN (pk % 23) / 2.0 END AS percent, CASE pk % 5 WHEN 0 THEN 'single_supplier' WHEN 1 THEN 'auction' END AS method, pk % 7 = 0 AS noted, CASE WHEN pk % 13 <> 0 THEN pk % 9 <> 0 END AS required FROM packages, (VALUES ('bid'), ('performance'), ('warranty')) k(kind))
SELECT pk, kind, CASE WHEN kind <> 'warranty' AND coalesce(method = 'single_supplier', false) THEN 'not_applicable' WHEN kind <> 'warranty' AND noted THEN 'manual_review' WHEN required = false THEN 'passed' WHEN percent IS NULL THEN 'manual_review'
  WHEN kind = 'warranty' THEN CASE WHEN percent <= 10 THEN 'passed' ELSE 'failed' END WHEN amount IS NULL OR (percent = 0 AND method IS NULL) THEN 'manual_review'
  WHEN kind = 'bid' THEN CASE WHEN percent >= 0.5 AND percent <= CASE WHEN amount <= 20000000 THEN 1 ELSE 5 END THEN 'passed' ELSE 'failed' END
  ELSE CASE WHEN percent >= CASE WHEN amount <= 50000000 THEN 0.5 ELSE 10 END AND percent <= 30 THEN 'passed' ELSE 'failed' END END AS status FROM f""")
def security_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Securities with methods, exceptions of the plan, and those that aren't required."""
    pk = F.col("pk")
    facts = _facts(spark, sf_dir).select(
        "pk", F.explode(F.array(F.lit("bid"), F.lit("performance"), F.lit("warranty"))).alias("kind"), F.when(pk % 17 != 0, F.col("amount")).alias("amount"), F.when(pk % 11 != 0, ((pk % 23) / 2).cast("decimal(9,4)")).alias("percent"),
        F.when(pk % 5 == 0, "single_supplier").when(pk % 5 == 1, "auction").alias("method"), F.when(pk % 7 == 0, "advance").alias("note"), F.when(pk % 13 != 0, pk % 9 != 0).alias("required"),
    )
    return op.security_check(facts, op.security_band_table(spark))


@query(f"""WITH {PACKAGES}, {ITEMS}, p(above, upto, percent) AS (VALUES {_PERCENTS}), a(above, upto, fixed) AS (VALUES {_AMOUNTS}),
f AS (SELECT pk, amount * 2 AS amount FROM packages),
need AS (SELECT pk, amount, 'value' AS need, percent AS due_percent, NULL::BIGINT AS due_fixed FROM f JOIN p ON (above IS NULL OR amount > above) AND (upto IS NULL OR amount <= upto)
  UNION ALL SELECT pk, amount, 'non_value', NULL, fixed FROM f JOIN a ON (above IS NULL OR amount > above) AND (upto IS NULL OR amount <= upto)),
c AS (SELECT pk, seq, CASE WHEN seq % 2 = 0 THEN 'value' ELSE 'non_value' END AS kind, CASE WHEN seq % 2 = 0 THEN discount::DECIMAL(9,4) END AS c_percent, CASE WHEN seq % 2 = 1 THEN qty * 1000 END AS c_fixed FROM items),
b AS (SELECT need.*, c_percent, c_fixed, row_number() OVER (PARTITION BY need.pk, need ORDER BY (coalesce(kind, need) <> need)::INTEGER, seq) AS n FROM need LEFT JOIN c ON c.pk = need.pk)
SELECT pk, amount, need, due_percent, due_fixed, c_percent, c_fixed, {_status("CASE WHEN need = 'value' THEN c_percent IS NOT NULL ELSE c_fixed IS NOT NULL END", "CASE WHEN need = 'value' THEN c_percent = due_percent ELSE c_fixed = due_fixed END")} AS status FROM b WHERE n = 1""")
def penalty_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("seq") % 2 == 0
    clauses = items(spark, sf_dir).select("pk", "seq", F.when(value, "value").otherwise("non_value").alias("kind"), F.when(value, F.col("discount").cast("decimal(9,4)")).alias("percent"), F.when(~value, F.col("qty") * 1000).alias("fixed"))
    return op.penalty_check(clauses, _facts(spark, sf_dir).select("pk", "amount"), op.penalty_table(spark))


@query(f"""WITH {PACKAGES} SELECT pk, amount, present, amount > 20000000 AS required, {_status("present IS NOT NULL", "present = (amount > 20000000)")} AS status
FROM (SELECT pk, amount, CASE WHEN status <> 'P' THEN status = 'F' END AS present FROM packages)""")
def threshold_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.threshold_required(packages(spark, sf_dir).select("pk", "amount", F.when(F.col("status") != "P", F.col("status") == "F").alias("present")))


@query(f"""WITH {ITEMS}, a AS (SELECT pk, bool_or(discount >= 5) AS required, max(discount) AS percent FROM items WHERE role = 'O' GROUP BY pk), b AS (SELECT pk, bool_or(tax >= 5) AS c_required, max(tax) AS c_percent FROM items WHERE role = 'F' GROUP BY pk)
SELECT pk, required, percent, c_required, c_percent, CASE WHEN required IS NULL OR c_required IS NULL THEN 'manual_review' WHEN required <> c_required THEN 'failed' WHEN NOT required THEN 'passed' ELSE {_status("percent IS NOT NULL AND c_percent IS NOT NULL", "percent = c_percent")} END AS status FROM a LEFT JOIN b USING (pk)""")
def share_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    side = lambda role, c: rows.where(F.col("role") == role).groupBy("pk").agg(F.bool_or(F.col(c) >= 5).alias("required"), F.max(c).alias("percent"))
    return op.share_agreement(side("O", "discount"), side("F", "tax"))


_CLAUSES = [("right of return", ["the", "of"]), ("license", ["license"]), ("contact", ["@"]), ("liability", ["and", "with", "from"])]


@query(f"""WITH c(clause, markers) AS (VALUES {", ".join(f"('{k}', {m})" for k, m in _CLAUSES)}), t AS (SELECT doc_id AS pk, lower(text) AS t FROM documents)
SELECT pk, clause, len(list_filter(markers, lambda m: NOT contains(t, m))) = 0 AS present, CASE WHEN len(list_filter(markers, lambda m: NOT contains(t, m))) = 0 THEN 'passed' ELSE 'failed' END AS status FROM t, c""")
def clause_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    checklist = spark.createDataFrame(_CLAUSES, "clause string, markers array<string>")
    return op.clause_checklist(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pk"), "text"), checklist)


_NORM = lambda c: rf"trim(regexp_replace(regexp_replace(replace(replace(lower(coalesce({c}, '')), 'ё', 'е'), 'ß', 'ss'), '[«»\"''`]', '', 'g'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"
_CLOSE = lambda a, b: f"coalesce({a} <> '' AND {b} <> '' AND (contains({a}, {b}) OR contains({b}, {a})), false)"


@query(f"""WITH t AS (SELECT conv_id AS pk, turn, role AS doc_role, split_part(text, '.', 1) AS raw FROM conversations), b AS (SELECT pk, min(raw) AS base_text FROM t WHERE doc_role = 'user' GROUP BY pk)
SELECT t.pk, doc_role, raw, base_text, {_status(f"{_NORM('raw')} <> '' AND {_NORM('base_text')} <> ''", _CLOSE(_NORM("raw"), _NORM("base_text")))} AS status FROM t LEFT JOIN b ON t.pk = b.pk WHERE doc_role <> 'user'""")
def text_vs_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sentences of a conversation's answers against the first of its questions in order."""
    facts = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pk"), F.col("role").alias("doc_role"), F.lit("subject").alias("field"), F.substring_index("text", ".", 1).alias("raw"))
    return op.text_vs_baseline(facts, "subject", "user")


@query(f"""WITH {ITEMS}, {PACKAGES}, s AS (SELECT items.pk, CASE WHEN flag <> 'A' OR qty > 10 THEN items.day END AS end_date, packages.day + 1800 AS overall_end FROM items LEFT JOIN packages ON packages.pk = items.pk)
SELECT *, CASE WHEN n_missing > 0 OR overall_end IS NULL THEN 'manual_review' WHEN n_late > 0 THEN 'failed' ELSE 'passed' END AS status
FROM (SELECT pk, count(*) AS n_stages, count(*) FILTER (end_date IS NULL) AS n_missing, count(*) FILTER (end_date > overall_end) AS n_late, max(end_date) AS last_end, max(overall_end) AS overall_end FROM s GROUP BY pk)""")
def term_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = items(spark, sf_dir).select("pk", F.when((F.col("flag") != "A") | (F.col("qty") > 10), F.col("day")).alias("end_date"))
    return op.term_issues(stages, packages(spark, sf_dir).select("pk", F.date_add("day", 1800).alias("end_date")))


@query("""WITH d AS (SELECT doc_id AS pk, 'quality' AS check_id, CASE quality WHEN 1 THEN 'passed' ELSE 'failed' END AS given FROM labels),
f AS (SELECT doc_id AS pk, n_chars < 300 AS equal_text, contains(text, '!!') AS houses_differ, contains(lower(text), 'license') AS by_reference FROM documents)
SELECT *, status <> given AS overridden FROM (SELECT pk, check_id, given, CASE WHEN coalesce(houses_differ, false) THEN 'failed' WHEN coalesce(equal_text, false) THEN 'passed' WHEN coalesce(by_reference, false) AND given = 'passed' THEN 'manual_review' ELSE given END AS status FROM d LEFT JOIN f USING (pk))""")
def decision_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are the decisions, the documents the facts that override them."""
    decisions = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pk"), F.lit("quality").alias("check_id"), F.when(F.col("quality") == 1, "passed").otherwise("failed").alias("status"))
    facts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pk"), (F.col("n_chars") < 300).alias("equal_text"), F.contains("text", F.lit("!!")).alias("houses_differ"), F.contains(F.lower("text"), F.lit("license")).alias("by_reference"))
    return op.apply_guards(decisions, facts)


@query(f"""WITH f AS (SELECT p_partkey AS pk, p_name AS plan, split_part(p_name, ' ', 2) AS body, CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS annex FROM part), o AS (SELECT pk, plan, CASE WHEN trim(annex) <> '' THEN annex ELSE body END AS contract_text FROM f)
SELECT pk, contract_text, {_status(f"{_NORM('plan')} <> '' AND {_NORM('contract_text')} <> ''", _CLOSE(_NORM("plan"), _NORM("contract_text")))} AS status FROM o""")
def warranty_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return op.warranty_check(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), name.alias("plan"), F.split_part(name, F.lit(" "), F.lit(2)).alias("body"), F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("").alias("annex")))


@query(f"""WITH f AS (SELECT c_custkey AS pk, {_NORM("CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END")} AS p, {_NORM("CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment ELSE 'Furniture' END")} AS c FROM customer),
k AS (SELECT pk, CASE WHEN p = '' OR c = '' THEN 'missing' WHEN p = 'building' OR c = 'building' THEN 'placeholder' WHEN p = c THEN 'equal' ELSE 'different' END AS kind FROM f)
SELECT pk, kind, CASE kind WHEN 'equal' THEN 'passed' WHEN 'different' THEN 'failed' ELSE 'manual_review' END AS status FROM k""")
def funding_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pk"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")).alias("plan"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")).otherwise("Furniture").alias("contract"))
    return op.funding_check(facts, ["building"])


@query("""SELECT o_orderkey AS pk, CASE WHEN contains(t, 'urgent') THEN 'quote' WHEN contains(t, 'high') THEN 'auction' WHEN contains(t, 'low f') THEN 'single' ELSE 'unknown' END AS method FROM (SELECT o_orderkey, lower(o_orderpriority || ' ' || o_orderstatus) AS t FROM orders)""")
def method_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "pk")
    return op.method_kind(facts, ["o_orderpriority", "o_orderstatus"], [("urgent", "quote"), ("high", "auction"), ("low f", "single")])


_ADDRESS = "CASE {0} % 6 WHEN 0 THEN 'г. Москва, ул. Мира, д. 05' WHEN 1 THEN 'город  Москва; улица Мира, дом 5' WHEN 2 THEN 'г. Москва, ул. Мира, д. 6а' WHEN 3 THEN 'Москва, ул. Мира' WHEN 4 THEN 'г. Омск, ул. Мира, д. 5 и д. 6А' END"
_HOUSES = "CASE {0} % 6 WHEN 0 THEN ['5'] WHEN 1 THEN ['5'] WHEN 2 THEN ['6а'] WHEN 4 THEN ['5', '6а'] END"
_WAY = "CASE {0} % 5 WHEN 0 THEN 'Электронный аукцион' WHEN 1 THEN 'auction' WHEN 2 THEN 'Электронный магазин' WHEN 3 THEN 'запрос котировок' END"
_WAY_KIND = "CASE {0} % 5 WHEN 0 THEN 'auction' WHEN 1 THEN 'auction' WHEN 2 THEN 'single_supplier' WHEN 3 THEN 'request_for_quotations' END"
_GIVEN = ["passed", "failed", "manual_review", "warning"]
_CHECKS = ["delivery_place", "procurement_method", "warranty", "smp_preferences", "delivery_term", "other"]
_GUARDED = "SELECT doc_id AS pk, n_chars AS n, doc_id + n_chars // 7 AS m, doc_id * 3 + n_chars // 5 AS k FROM documents"


@query(f"""WITH d AS ({_GUARDED}), c AS (SELECT d.*, check_id, [{", ".join(f"'{g}'" for g in _GIVEN)}][((pk + length(check_id)) % 4 + 1)::INTEGER] AS given FROM d, (SELECT unnest([{", ".join(f"'{x}'" for x in _CHECKS)}]) AS check_id)),
p AS (SELECT *, list_filter([{_HOUSES.format("n")}, {_HOUSES.format("m")}, {_HOUSES.format("k")}], lambda x: x IS NOT NULL) AS h, list_distinct(list_transform(list_filter([n % 6, m % 6, k % 6], lambda x: x <> 5), lambda x: CASE x WHEN 1 THEN 'spelled out' WHEN 3 THEN 'none' WHEN 4 THEN 'omsk' ELSE 'moscow' END)) AS a, list_distinct(list_filter([{_WAY_KIND.format("n")}, {_WAY_KIND.format("m")}, {_WAY_KIND.format("k")}], lambda x: x IS NOT NULL)) AS w FROM c),
s AS (SELECT pk, check_id, given, CASE check_id
  WHEN 'delivery_place' THEN CASE WHEN len(h) < 2 THEN given WHEN len(list_filter(h, lambda x: len(list_intersect(x, h[1])) = 0)) > 0 THEN 'failed' WHEN len(a) = 1 AND a[1] <> 'none' THEN 'passed' ELSE given END
  WHEN 'procurement_method' THEN CASE WHEN len(w) > 1 THEN 'failed' WHEN w[1] IN ('auction', 'single_supplier') THEN 'passed' ELSE given END
  WHEN 'warranty' THEN CASE WHEN given = 'passed' AND m % 3 <> 0 AND n % 4 <> 1 AND n % 4 <> 3 THEN 'manual_review' ELSE given END
  WHEN 'smp_preferences' THEN CASE WHEN n % 3 = 2 OR (n % 3 = 0 AND m % 2 = 0) THEN 'warning' ELSE 'passed' END
  WHEN 'delivery_term' THEN CASE WHEN n % 3 = m % 3 THEN 'passed' ELSE given END ELSE given END AS status FROM p)
SELECT *, status <> given AS overridden FROM s""")
def guarded_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of six checks about addresses, methods, warranties, preferences and terms that documents spell differently."""
    d = spark.sql(_GUARDED.replace(" // ", " div ").replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))
    check = F.explode(F.array(*map(F.lit, _CHECKS))).alias("check_id")
    given = F.get(F.array(*map(F.lit, _GIVEN)), ((F.col("pk") + F.length("check_id")) % 4).cast("int"))
    decisions = d.select("pk", check).withColumn("status", given)
    field = lambda role, name, sql: d.select("pk", F.lit(role).alias("role"), F.lit(name).alias("field"), F.expr(sql).alias("value"))
    rows = [field(r, "delivery_place", _ADDRESS.format(x)) for r, x in zip(("plan", "ooz", "contract"), "nmk", strict=True)] + [field(r, "procurement_method", _WAY.format(x)) for r, x in zip(("plan", "request", "explanatory_note"), "nmk", strict=True)]
    rows += [
        field("contract", "warranty", "CASE n % 4 WHEN 0 THEN 'Указан в описании' WHEN 1 THEN 'указан в приложении, 12 месяцев' WHEN 3 THEN 'год' END"), field("annex", "warranty", "CASE WHEN m % 3 = 0 THEN 'два года' END"),
        field("plan", "smp_preference", "CASE n % 3 WHEN 0 THEN 'нет' WHEN 1 THEN 'Установлены' END"), field("plan", "subcontract_required", "CASE WHEN m % 2 = 0 THEN 'да' ELSE 'не требуется' END"),
        field("ooz", "delivery_term", "concat(n % 3, ' Дней')"), field("contract", "delivery_term", "concat(' ', m % 3, '  дней')"),
    ]
    return guards.guard_decisions(decisions, reduce(DataFrame.unionByName, rows))
