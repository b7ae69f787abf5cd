"""Comparison between documents of a package: codes, amounts, items, stages, attachments, requisites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare as op
from .price_checks import _status
from .registry import ITEMS, PACKAGES, PARTS, dealt, item_parts, items, packages, parts, query, table


@query(f"""WITH {ITEMS} SELECT pk, role, seq, item FROM items QUALIFY row_number() OVER (PARTITION BY pk, role ORDER BY qty DESC, seq) = 1""")
def first_per_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of the largest quantity stands for a role of the package."""
    return op.first_per_role(items(spark, sf_dir), [F.desc("qty"), "seq"])[0].select("pk", "role", "seq", "item")


@query(f"""WITH {ITEMS} SELECT pk, seq, 'duplicate of role ' || role AS reason FROM items QUALIFY row_number() OVER (PARTITION BY pk, role ORDER BY qty DESC, seq) > 1 AND role <> 'O'""")
def ignored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.first_per_role(items(spark, sf_dir), [F.desc("qty"), "seq"], ["O"])[1].select("pk", "seq", "reason")


@query(f"""WITH {ITEMS}, {PACKAGES}, need AS (SELECT pk, role FROM packages, (VALUES ('N'), ('A'), ('R')) r(role)),
m AS (SELECT pk, string_agg(role, ',' ORDER BY role) AS missing FROM need WHERE NOT EXISTS (SELECT 1 FROM items WHERE items.pk = need.pk AND items.flag = need.role) GROUP BY pk),
o AS (SELECT pk, count(*) AS n_offers FROM items WHERE flag = 'N' GROUP BY pk)
SELECT pk, coalesce(missing, '') AS missing, coalesce(n_offers, 0) AS n_offers, CASE WHEN missing IS NOT NULL THEN 'failed' WHEN coalesce(n_offers, 0) < 3 THEN 'manual_review' ELSE 'passed' END AS status
FROM packages LEFT JOIN m USING (pk) LEFT JOIN o USING (pk)""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = items(spark, sf_dir).select("pk", F.col("flag").alias("role"))
    required = spark.createDataFrame([("N",), ("A",), ("R",)], "role string")
    return op.completeness(files, packages(spark, sf_dir), required, "N")


_CODES = f"""{ITEMS}, {PARTS}, codes AS (SELECT pk, role, CASE WHEN seq % 3 = 0 THEN ktru ELSE code END AS code FROM items JOIN parts USING (item))"""


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_parts(spark, sf_dir).select("pk", "role", F.when(F.col("seq") % 3 == 0, F.col("ktru")).otherwise(F.col("code")).alias("code"))


@query(f"""WITH {_CODES}, w AS (SELECT pk, item, ktru, code, seq FROM items JOIN parts USING (item)),
a AS (SELECT pk, list_sort(list(DISTINCT ktru)) AS required FROM w WHERE seq <= 3 GROUP BY pk),
b AS (SELECT pk, list_sort(list(DISTINCT CASE WHEN seq % 2 = 0 THEN code ELSE ktru END)) AS codes FROM w WHERE seq >= 2 GROUP BY pk),
j AS (SELECT pk, required, codes, list_filter(required, lambda c: NOT list_contains(codes, c)) AS gone, list_transform(codes, lambda c: split_part(c, '-', 1)) AS parents FROM a JOIN b USING (pk))
SELECT *, CASE WHEN missing <> '' THEN 'failed' WHEN derived_only <> '' OR additional <> '' THEN 'warning' ELSE 'passed' END AS status FROM (
SELECT pk, 'contract' AS role, len(list_filter(required, lambda c: list_contains(codes, c)))::INTEGER AS n_common,
  array_to_string(list_filter(gone, lambda c: NOT list_contains(parents, split_part(c, '-', 1))), ',') AS missing, array_to_string(list_filter(gone, lambda c: list_contains(parents, split_part(c, '-', 1))), ',') AS derived_only,
  array_to_string(list_filter(codes, lambda c: NOT list_contains(required, c)), ',') AS additional FROM j)""")
def code_set_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan has the first three lines, the contract those from the second on, half of them by their short code."""
    w = item_parts(spark, sf_dir)
    plan = w.where("seq <= 3").select("pk", F.lit("plan").alias("role"), F.col("ktru").alias("code"))
    contract = w.where("seq >= 2").select("pk", F.lit("contract").alias("role"), F.when(F.col("seq") % 2 == 0, F.col("code")).otherwise(F.col("ktru")).alias("code"))
    return op.compare_codes(plan.unionByName(contract), "plan")


@query(f"""WITH {_CODES}, k AS (SELECT pk, code, CASE flag WHEN 'A' THEN 'explicit' WHEN 'R' THEN 'derived' ELSE 'expected' END AS kind FROM items JOIN parts USING (item)),
s AS (SELECT pk, coalesce(list(DISTINCT code) FILTER (kind = 'explicit'), []) AS e, coalesce(list(DISTINCT code) FILTER (kind = 'derived'), []) AS d, coalesce(list(DISTINCT code) FILTER (kind = 'expected'), []) AS x FROM k GROUP BY pk)
SELECT pk, len(list_distinct(e || d))::INTEGER AS n_all, array_to_string(list_sort(list_filter(x, lambda c: list_contains(d, c) AND NOT list_contains(e, c))), ',') AS derived_only FROM s""")
def code_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("flag") == "A", "explicit").when(F.col("flag") == "R", "derived").otherwise("expected")
    return op.code_sets(item_parts(spark, sf_dir).select("pk", "code", kind.alias("kind")))


@query(f"""WITH {_CODES}, c AS (SELECT DISTINCT pk, code FROM items JOIN parts USING (item)), e AS (SELECT DISTINCT pk, CASE WHEN seq % 2 = 0 THEN code ELSE split_part(code, '.', 1) END AS e FROM items JOIN parts USING (item) WHERE flag = 'N')
SELECT pk, code FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.pk = c.pk AND (e.e = c.code OR starts_with(c.code, e.e || '.')))""")
def unexpected_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of open lines explain themselves and, by their first segment, their children."""
    w = item_parts(spark, sf_dir, "code")
    explained = w.where("flag = 'N'").select("pk", F.when(F.col("seq") % 2 == 0, F.col("code")).otherwise(F.split_part("code", F.lit("."), F.lit(1))).alias("code")).distinct()
    return op.unexpected_codes(w.select("pk", "code"), explained)


@query(f"""WITH {PARTS}, c AS (SELECT size AS pk, ktru AS code, split_part(ktru, '.', 1) || '.' || split_part(ktru, '.', 2) || '.' || split_part(ktru, '.', 3) AS h FROM parts)
SELECT pk, code, string_agg(s, ',' ORDER BY s) AS "similar" FROM (SELECT DISTINCT a.pk, a.code, b.code AS s FROM c a JOIN c b ON a.pk = b.pk AND a.h = b.h AND a.code <> b.code) GROUP BY ALL""")
def similar_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = parts(spark, sf_dir).select(F.col("size").alias("pk"), F.col("ktru").alias("code"))
    return op.similar_codes(codes, codes)


@query(f"""WITH {ITEMS}, {PACKAGES}, f AS (SELECT pk, 'plan' AS role, amount FROM packages UNION ALL SELECT pk, role, CASE WHEN pk % 4 = 0 THEN max(p.amount) ELSE sum(total)::BIGINT END FROM items JOIN packages p USING (pk) GROUP BY pk, role)
SELECT pk, count(DISTINCT role) AS n_known, min(amount) AS low, max(amount) AS high, CASE WHEN count(DISTINCT role) < 2 THEN 'manual_review' WHEN min(amount) = max(amount) THEN 'passed' ELSE 'failed' END AS status FROM f GROUP BY pk""")
def amount_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fourth package has the same amount in all its documents."""
    orders = packages(spark, sf_dir).select("pk", "amount")
    sums = items(spark, sf_dir).join(orders, "pk").groupBy("pk", "role").agg(F.when(F.col("pk") % 4 == 0, F.max("amount")).otherwise(F.sum("total")).alias("amount"))
    facts = orders.select("pk", F.lit("plan").alias("role"), "amount").unionByName(sums)
    return op.compare_amounts(dealt(facts, "pk", table(spark, sf_dir, "lineitem").count()))


@query(f"""WITH {ITEMS}, {PARTS}, k AS (SELECT pk, flag AS role, CASE WHEN size % 5 = 0 THEN NULL ELSE kind END AS key, CASE WHEN qty > 3 THEN qty END AS v FROM items JOIN parts USING (item)),
o AS (SELECT * FROM k WHERE key IS NOT NULL QUALIFY count(*) OVER (PARTITION BY pk, key, role) = 1)
SELECT pk, key, n_docs, n_known, low, high, {_status("n_known = n_docs", "low = high")} AS status FROM (SELECT pk, key, count(*) AS n_docs, count(v) AS n_known, min(v) AS low, max(v) AS high FROM o GROUP BY ALL) WHERE n_docs > 1""")
def item_value_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of one kind of item across the documents of a package."""
    key = F.when(F.col("size") % 5 != 0, F.col("kind"))
    rows = item_parts(spark, sf_dir).select("pk", F.col("flag").alias("role"), key.alias("key"), F.when(F.col("qty") > 3, F.col("qty")).alias("v"))
    return op.compare_item_values(rows, "v")


@query(f"""WITH {ITEMS}, {PARTS} SELECT pk, code, string_agg(DISTINCT name, '; ' ORDER BY name) AS names, sum(qty)::BIGINT AS qty FROM (SELECT pk, split_part(code, '.', 1) AS code, name, qty FROM items JOIN parts USING (item)) GROUP BY ALL""")
def names_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = item_parts(spark, sf_dir).select("pk", F.split_part("code", F.lit("."), F.lit(1)).alias("code"), "name", "qty")
    return op.names_by_code(rows)


_STAGES = f"""{ITEMS}, st AS (SELECT pk, role, year(day)::INTEGER AS stage_no, min(day) AS start_date, max(day) AS end_date, min(seq)::INTEGER AS seq FROM items GROUP BY ALL)"""


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).groupBy("pk", "role", F.year("day").alias("stage_no")).agg(F.min("day").alias("start_date"), F.max("day").alias("end_date"), F.min("seq").alias("seq"))


@query(f"""WITH {_STAGES}, p AS (SELECT pk, stage_no, start_date, CASE WHEN seq <> 2 THEN end_date END AS end_date, 'within ' || month(end_date) AS term FROM st WHERE role = 'O'), o AS (SELECT pk, stage_no, start_date, end_date, CASE WHEN seq <> 3 THEN 'within ' || month(end_date) END AS term FROM st WHERE role = 'F'),
j AS (SELECT coalesce(p.pk, o.pk) AS pk, coalesce(p.stage_no, o.stage_no) AS stage_no, p.end_date, o.end_date AS o_end_date, p.start_date AS s, o.start_date AS os, p.term AS t, o.term AS ot, p.pk IS NOT NULL AS hp, o.pk IS NOT NULL AS ho FROM p FULL JOIN o ON p.pk = o.pk AND p.stage_no = o.stage_no)
SELECT pk, stage_no, end_date, o_end_date, kind, CASE kind WHEN 'equal' THEN 'passed' WHEN 'unknown' THEN 'manual_review' WHEN 'extra' THEN 'warning' ELSE 'failed' END AS status FROM (
SELECT *, CASE WHEN NOT ho THEN 'missing' WHEN NOT hp THEN 'extra' WHEN end_date IS NOT NULL AND o_end_date IS NOT NULL THEN CASE WHEN end_date = o_end_date AND s = os THEN 'equal' ELSE 'different' END
  WHEN t <> '' AND ot <> '' THEN CASE WHEN contains(t, ot) OR contains(ot, t) THEN 'equal' ELSE 'different' END ELSE 'unknown' END AS kind FROM j)""")
def stage_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of open and of shipped lines are the stages of two documents; some lack a date or a text."""
    st = _stages(spark, sf_dir).withColumn("term_text", F.concat(F.lit("within "), F.month("end_date")))
    plan = st.where("role = 'O'").withColumn("end_date", F.when(F.col("seq") != 2, F.col("end_date")))
    other = st.where("role = 'F'").withColumn("term_text", F.when(F.col("seq") != 3, F.col("term_text")))
    return op.compare_stages(plan.select("pk", "stage_no", "start_date", "end_date", "term_text"), other)


@query(f"""WITH {_STAGES}, a AS (SELECT pk, list(stage_no ORDER BY seq, stage_no) AS l FROM st WHERE role = 'O' GROUP BY pk), b AS (SELECT pk, list(stage_no ORDER BY seq, stage_no) AS m FROM st WHERE role = 'F' GROUP BY pk)
SELECT pk, len(l)::INTEGER AS n_plan, len(m)::INTEGER AS n_other, CASE WHEN l = m THEN 'passed' ELSE 'failed' END AS status FROM a JOIN b USING (pk)""")
def stage_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = _stages(spark, sf_dir)
    return op.stage_order(st.where("role = 'O'"), st.where("role = 'F'"))


@query(f"""WITH {_STAGES}, a AS (SELECT * FROM st WHERE role = 'O'), b AS (SELECT * FROM st WHERE role = 'F')
SELECT * FROM (SELECT coalesce(a.pk, b.pk) AS pk, coalesce(a.stage_no, b.stage_no) AS stage_no, a.end_date AS text_end, b.end_date AS table_end,
  CASE WHEN b.pk IS NULL THEN 'text_only' WHEN a.pk IS NULL THEN 'table_only' WHEN a.end_date <> b.end_date THEN 'different_end' END AS kind FROM a FULL JOIN b ON a.pk = b.pk AND a.stage_no = b.stage_no) WHERE kind IS NOT NULL""")
def stage_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = _stages(spark, sf_dir)
    return op.stage_contradictions(st.where("role = 'O'"), st.where("role = 'F'"))


@query(f"""WITH {_STAGES}, t AS (SELECT pk, stage_no, start_date, CASE WHEN seq % 2 = 0 THEN end_date END AS end_date FROM st WHERE role = 'O'), x AS (SELECT pk, stage_no, start_date, end_date FROM st WHERE role = 'F')
SELECT t.pk, t.stage_no, coalesce(t.start_date, x.start_date) AS start_date, coalesce(t.end_date, x.end_date) AS end_date, 'table' AS origin FROM t LEFT JOIN x ON t.pk = x.pk AND t.stage_no = x.stage_no
UNION ALL SELECT pk, stage_no, start_date, end_date, 'text' FROM x WHERE pk NOT IN (SELECT pk FROM t)""")
def merge_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = _stages(spark, sf_dir)
    tabled = st.where("role = 'O'").withColumn("end_date", F.when(F.col("seq") % 2 == 0, F.col("end_date")))
    return op.merge_stages(tabled.select("pk", "stage_no", "start_date", "end_date"), st.where("role = 'F'"), ["start_date", "end_date"])


@query(f"""WITH {ITEMS} SELECT pk, stage_no, qty, total, seq FROM (SELECT pk, year(day)::INTEGER AS stage_no, qty, total, seq FROM items) QUALIFY row_number() OVER (PARTITION BY pk, stage_no, qty ORDER BY total, seq) = 1""")
def dedupe_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).select("pk", F.year("day").alias("stage_no"), "qty", "total", "seq")
    return op.dedupe_rows(rows, ["pk", "stage_no", "qty"], ["total", "seq"])


@query(f"""WITH {ITEMS}, {PARTS} SELECT pk, kind, code, flag, seq FROM (SELECT pk, kind, code, flag, seq FROM items JOIN parts USING (item)) QUALIFY row_number() OVER (PARTITION BY pk, kind, flag ORDER BY seq) = 1""")
def dedupe_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = item_parts(spark, sf_dir).select("pk", "kind", "code", "flag", "seq")
    return op.dedupe_rows(rows, ["pk", "kind", "flag"], ["seq"])


@query(f"""WITH {ITEMS}, a AS (SELECT pk, seq, item FROM items WHERE role = 'O'), b AS (SELECT pk, seq, item FROM items WHERE role = 'F'),
n AS (SELECT pk, coalesce(x, 0) >= coalesce(y, 0) AS f FROM (SELECT pk, count(*) AS x FROM a GROUP BY pk) FULL JOIN (SELECT pk, count(*) AS y FROM b GROUP BY pk) USING (pk))
SELECT a.* FROM a JOIN n ON a.pk = n.pk AND f UNION ALL SELECT b.* FROM b JOIN n ON b.pk = n.pk AND NOT f""")
def longer_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    side = lambda role: rows.where(F.col("role") == role).select("pk", "seq", "item")
    return op.longer_list(side("O"), side("F"))


_ATTACH = f"""{ITEMS}, {PARTS}, att AS (SELECT pk, seq, role, CASE WHEN size % 4 <> 0 THEN kind END AS kind, string_split(name, ' ') AS tokens FROM items JOIN parts USING (item)),
a AS (SELECT *, row_number() OVER (PARTITION BY pk, kind ORDER BY seq) AS n FROM att WHERE role = 'O'), b AS (SELECT *, row_number() OVER (PARTITION BY pk, kind ORDER BY seq) AS n FROM att WHERE role = 'F'),
typed AS (SELECT a.pk, a.seq, b.seq AS f FROM a JOIN b ON a.pk = b.pk AND a.kind = b.kind AND a.n = b.n),
la AS (SELECT * FROM a WHERE (pk, seq) NOT IN (SELECT (pk, seq) FROM typed)), lb AS (SELECT * FROM b WHERE (pk, seq) NOT IN (SELECT (pk, f) FROM typed)),
met AS (SELECT la.pk, la.seq, lb.seq AS f, len(list_intersect(la.tokens, lb.tokens)) AS n FROM la JOIN lb ON la.pk = lb.pk WHERE len(list_intersect(la.tokens, lb.tokens)) >= 1),
titled AS (SELECT pk, seq, f FROM (SELECT *, row_number() OVER (PARTITION BY pk, seq ORDER BY n DESC, f) AS x, row_number() OVER (PARTITION BY pk, f ORDER BY n DESC, seq) AS y FROM met) WHERE x = 1 AND y = 1)"""


@query(f"""WITH {_ATTACH} SELECT pk, 'listed' AS side, seq, 'type' AS how FROM typed UNION ALL SELECT pk, 'listed', seq, 'title' FROM titled
UNION ALL SELECT pk, 'listed', seq, 'missing' FROM la WHERE (pk, seq) NOT IN (SELECT (pk, seq) FROM titled) UNION ALL SELECT pk, 'file', seq, 'extra' FROM lb WHERE (pk, seq) NOT IN (SELECT (pk, f) FROM titled)""")
def attachment_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open lines are listed attachments, shipped ones files; a quarter has no type. One shared token is enough here."""
    rows = item_parts(spark, sf_dir).select("pk", "seq", "role", F.when(F.col("size") % 4 != 0, F.col("kind")).alias("kind"), F.split("name", " ").alias("tokens"))
    return op.reconcile_attachments(rows.where("role = 'O'"), rows.where("role = 'F'"), 1)


@query(f"""WITH {ITEMS}, {PARTS}, k AS (SELECT pk, role, kind FROM items JOIN parts USING (item)) SELECT r.pk, r.kind, CASE WHEN p.pk IS NULL THEN 'failed' ELSE 'passed' END AS status
FROM (SELECT DISTINCT pk, kind FROM k WHERE role = 'O') r LEFT JOIN (SELECT DISTINCT pk, kind FROM k WHERE role = 'F') p ON r.pk = p.pk AND r.kind = p.kind""")
def contract_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = item_parts(spark, sf_dir)
    return op.contract_attachments(rows.where("role = 'O'"), rows.where("role = 'F'"))


@query(f"""WITH {ITEMS}, f AS (SELECT DISTINCT pk, flag, role, k AS field, CASE k WHEN 'tax' THEN tax ELSE discount END AS norm FROM items, (VALUES ('tax'), ('discount')) v(k))
SELECT pk, field, count(*) FILTER (flag = 'A') AS "A", count(*) FILTER (flag = 'N') AS "N", count(*) FILTER (flag = 'R') AS "R" FROM (SELECT DISTINCT pk, field, flag, norm FROM f) GROUP BY ALL""")
def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    facts = rows.unpivot(["pk", "flag"], ["tax", "discount"], "field", "norm").withColumnRenamed("flag", "role")
    return op.occurrences(facts, ["A", "N", "R"])


@query("""WITH o AS (SELECT s_suppkey AS pk, 0 AS offer, s_name AS supplier, CASE WHEN s_acctbal > 0 THEN s_acctbal::VARCHAR END AS bank, CASE WHEN s_nationkey <> 3 THEN 'N' ELSE ' ' END AS country FROM supplier),
n AS (SELECT CASE WHEN l_suppkey % 7 <> 0 THEN l_suppkey END AS pk, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
m AS (SELECT pk, offer, concat_ws(',', CASE WHEN bank IS NULL THEN 'bank' END, CASE WHEN trim(country) = '' THEN 'country' END) AS missing, coalesce(n, 0) AS n_items FROM o LEFT JOIN n USING (pk))
SELECT *, concat_ws(',', CASE WHEN missing <> '' THEN 'requisites' END, CASE WHEN n_items = 0 THEN 'no items' END) AS warnings FROM m""")
def offer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pk"), F.lit(0).alias("offer"), F.col("s_name").alias("supplier"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("bank"), F.when(F.col("s_nationkey") != 3, "N").otherwise(" ").alias("country"))
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey")).alias("pk"), F.lit(0).alias("offer"))
    return op.offer_summary(offers, rows, ["supplier", "bank", "country"])


@query(f"""WITH {_CODES}, m AS (SELECT DISTINCT code, size > 20 AS found FROM parts WHERE size <> 7)
SELECT pk, role, count(*) FILTER (found) AS n_matched, count(*) FILTER (NOT found) AS n_unmatched, count(*) FILTER (found IS NULL) AS n_error FROM (SELECT DISTINCT pk, role, code FROM codes) LEFT JOIN m USING (code) GROUP BY ALL""")
def registry_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry has the short codes of all sizes but one; those of large sizes are found."""
    matches = parts(spark, sf_dir).where("size != 7").select("code", (F.col("size") > 20).alias("found")).distinct()
    return op.registry_rollup(_codes(spark, sf_dir), matches)


_RAW = """raw AS (SELECT c_custkey AS pk, 1 AS seq, 'name' AS key, c_name AS value FROM customer UNION ALL SELECT c_custkey, 2, 'segment', CASE WHEN c_custkey % 6 = 0 THEN ' ' WHEN c_custkey % 6 = 1 THEN 'None' ELSE c_mktsegment END FROM customer
  UNION ALL SELECT c_custkey, 3, 'balance', CASE WHEN c_acctbal > 0 THEN c_nationkey::VARCHAR END FROM customer)"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    segment = F.when(F.col("c_custkey") % 6 == 0, " ").when(F.col("c_custkey") % 6 == 1, "None").otherwise(F.col("c_mktsegment"))
    pairs = [("name", F.col("c_name")), ("segment", segment), ("balance", F.when(F.col("c_acctbal") > 0, F.col("c_nationkey").cast("string")))]
    rows = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(k).alias("key"), v.alias("value")) for i, (k, v) in enumerate(pairs, 1)])
    return c.select(F.col("c_custkey").alias("pk"), F.explode(rows).alias("r")).select("pk", "r.*")


@query(f"""WITH {_RAW}, k AS (SELECT pk, CASE WHEN value IS NULL OR trim(value) = '' THEN 'empty' WHEN lower(trim(value)) IN ('none', 'no', '-') THEN 'negative' ELSE 'filled' END AS kind FROM raw)
SELECT pk, count(*) FILTER (kind = 'empty') AS n_empty, count(*) FILTER (kind = 'negative') AS n_negative, count(*) FILTER (kind = 'filled') AS n_filled, CASE WHEN count(*) FILTER (kind = 'empty') > 0 THEN 'failed' ELSE 'passed' END AS status FROM k GROUP BY pk""")
def field_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.field_completeness(_raw(spark, sf_dir), ["none", "no", "-"])


@query(f"""WITH {_RAW} SELECT pk, min_by(value, seq) AS value FROM raw WHERE (contains(lower(key), 'segm') OR contains(lower(key), 'bal')) AND trim(value) <> '' GROUP BY pk""")
def field_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.field_value(_raw(spark, sf_dir), ["segm", "bal"])


@query("""SELECT conv_id, turn, CASE WHEN contains(lower(text), 'the') OR contains(lower(text), 'une') THEN 'exact' ELSE 'retrieval' END AS route FROM conversations""")
def route_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.route_points(table(spark, sf_dir, "conversations"), ["the", "une"], F.col("text")).select("conv_id", "turn", "route")
