"""Matching, reference lists and catalogue over lineitem, part and supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import catalogue as cat
from ..operators import match as op
from ..sources.shared import written
from .price_checks import _status
from .registry import ITEMS, PARTS, dealt, item_parts, items, parts, query, sliced, table

_TOK = "list_distinct(list_filter(string_split(name, ' '), lambda w: length(w) >= 3))"
#: Two documents of a package for the cascade: open and shipped lines; the second has a longer name.
_SIDES = f"""{ITEMS}, {PARTS}, w AS (SELECT pk, seq, role, ktru, code AS okpd2, name, qty, total, kind AS unit, brand FROM items JOIN parts USING (item)),
a AS (SELECT pk, seq, CASE WHEN seq % 3 = 0 THEN ktru END AS ktru, okpd2, {_TOK} AS tokens, name AS name_norm, qty, total AS price, unit, CASE WHEN seq % 2 = 0 THEN [lower(brand)] ELSE []::VARCHAR[] END AS marks FROM w WHERE role = 'O'),
b AS (SELECT pk, seq, CASE WHEN seq % 3 <> 1 THEN ktru END AS ktru, okpd2, {_TOK} AS tokens, name AS name_norm, qty, total AS price, unit, [split_part(name, ' ', 2)] AS marks FROM w WHERE role = 'F')"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    w, n = item_parts(spark, sf_dir, "name", "brand", "kind", "code", "ktru"), table(spark, sf_dir, "lineitem").count()
    if sliced(spark, n):
        # each pass reads the lines again: they are numbered and met with their parts once, and a pass deals what it needs
        w = dealt(written(w.select("pk", "seq", "role", "qty", "total", "name", "brand", "kind", "code", "ktru"), "lines"), "pk", n)

    def side(role: str, ktru, marks) -> DataFrame:
        return w.where(F.col("role") == role).select(
            "pk", "seq", F.when(ktru, F.col("ktru")).alias("ktru"), F.col("code").alias("okpd2"), fn.name_tokens(F.col("name")).alias("tokens"),
            F.col("name").alias("name_norm"), "qty", F.col("total").alias("price"), F.col("kind").alias("unit"), marks.alias("marks"),
        )

    none = F.array().cast("array<string>")
    return side("O", F.col("seq") % 3 == 0, F.when(F.col("seq") % 2 == 0, F.array(F.lower("brand"))).otherwise(none)), side("F", F.col("seq") % 3 != 1, F.array(F.split_part("name", F.lit(" "), F.lit(2))))


_SUPPORT = """CASE WHEN least(len(x.tokens), len(y.tokens)) = 0 THEN false WHEN least(len(x.tokens), len(y.tokens)) <= 3 THEN len(list_intersect(x.tokens, y.tokens)) = least(len(x.tokens), len(y.tokens))
  ELSE len(list_intersect(x.tokens, y.tokens)) / least(len(x.tokens), len(y.tokens)) >= 0.75 END"""


def _pass(n: int, on: str, extra: str = "") -> str:
    left = lambda t, c: f"SELECT * FROM {t} WHERE (pk, seq) NOT IN (SELECT (pk, {c}) FROM m{n - 1})" if n > 1 else f"SELECT * FROM {t}"
    how = ["", "ktru", "okpd2", "jaccard", "name", "mark", "qty"][n]
    cols = "x.pk, x.seq AS l, y.seq AS r, len(list_intersect(x.tokens, y.tokens)) / nullif(len(list_distinct(x.tokens || y.tokens)), 0) AS s"
    pick = "SELECT * FROM c{n}" if n != 3 else "SELECT * FROM c{n} QUALIFY rank() OVER (PARTITION BY pk, l ORDER BY s DESC) = 1 AND rank() OVER (PARTITION BY pk, r ORDER BY s DESC) = 1"
    before = f"SELECT * FROM m{n - 1} UNION ALL " if n > 1 else ""
    return f"""c{n} AS (SELECT {cols} FROM ({left('a', 'l')}) x JOIN ({left('b', 'r')}) y ON x.pk = y.pk AND {on} {extra}),
d{n} AS ({pick.format(n=n)}), m{n} AS ({before}SELECT pk, l, r, '{how}' AS how FROM d{n} QUALIFY count(*) OVER (PARTITION BY pk, l) = 1 AND count(*) OVER (PARTITION BY pk, r) = 1)"""


@query(f"""WITH {_SIDES}, {_pass(1, "x.ktru = y.ktru")}, {_pass(2, f"x.okpd2 = y.okpd2 AND {_SUPPORT}")},
{_pass(3, "len(list_intersect(x.tokens, y.tokens)) / nullif(len(list_distinct(x.tokens || y.tokens)), 0) >= 0.55")}, {_pass(4, _SUPPORT)},
{_pass(5, "len(list_filter(y.marks, lambda m: length(m) >= 3 AND contains(x.name_norm, m))) > 0")}, {_pass(6, "x.qty = y.qty", "WHERE x.pk IN (SELECT pk FROM m5)")},
ra AS (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY seq) AS n, count(*) OVER (PARTITION BY pk) AS size FROM a WHERE (pk, seq) NOT IN (SELECT (pk, l) FROM m6)), rb AS (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY seq) AS n, count(*) OVER (PARTITION BY pk) AS size FROM b WHERE (pk, seq) NOT IN (SELECT (pk, r) FROM m6)),
o AS (SELECT ra.pk, ra.seq AS l, rb.seq AS r, min((ra.price = rb.price AND ra.qty = rb.qty AND ra.unit = rb.unit)::INTEGER) OVER (PARTITION BY ra.pk) AS ok FROM ra JOIN rb ON ra.pk = rb.pk AND ra.n = rb.n AND ra.size = rb.size WHERE ra.size >= 2)
SELECT * FROM m6 UNION ALL SELECT pk, l, r, 'order' FROM o WHERE ok = 1""")
def item_cascade_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.match_items(*_sides(spark, sf_dir))


_LETTERS = f"""{ITEMS}, s AS (SELECT pk, seq, CASE WHEN seq % 4 <> 0 THEN 'L' || (item % 50) END AS number, CASE WHEN seq % 3 <> 0 THEN day END AS date, total FROM items WHERE role = 'O'),
o AS (SELECT pk, seq, CASE WHEN (item + seq) % 5 <> 0 THEN 'L' || (item % 50) END AS number, CASE WHEN seq % 2 = 0 THEN day END AS date, total FROM items)"""


def _letters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = items(spark, sf_dir)
    number = F.concat(F.lit("L"), F.col("item") % 50)
    s = rows.where("role = 'O'").select("pk", "seq", F.when(F.col("seq") % 4 != 0, number).alias("number"), F.when(F.col("seq") % 3 != 0, F.col("day")).alias("date"), "total")
    o = rows.select("pk", "seq", F.when((F.col("item") + F.col("seq")) % 5 != 0, number).alias("number"), F.when(F.col("seq") % 2 == 0, F.col("day")).alias("date"), "total")
    return o, s


_MATCHED = f"""{_LETTERS}, fit AS (SELECT s.pk, s.seq AS source, o.seq AS offer FROM s JOIN o ON s.pk = o.pk WHERE (s.number IS NOT NULL OR s.date IS NOT NULL) AND (s.number IS NULL OR s.number = o.number) AND (s.date IS NULL OR coalesce(s.date = o.date, false))),
exact AS (SELECT * FROM fit QUALIFY count(*) OVER (PARTITION BY pk, source) = 1 AND count(*) OVER (PARTITION BY pk, offer) = 1),
ls AS (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY seq) AS n FROM s WHERE (pk, seq) NOT IN (SELECT (pk, source) FROM exact)), lo AS (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY seq) AS n FROM o WHERE (pk, seq) NOT IN (SELECT (pk, offer) FROM exact)),
placed AS (SELECT ls.pk, ls.seq AS source, lo.seq AS offer FROM ls JOIN lo ON ls.pk = lo.pk AND ls.n = lo.n WHERE coalesce(starts_with(lo.number, ls.number) OR starts_with(ls.number, lo.number), true) AND coalesce(ls.date = lo.date, true)),
matched AS (SELECT s.pk, s.seq AS source, coalesce(e.offer, p.offer) AS offer, CASE WHEN e.pk IS NOT NULL THEN 'exact' WHEN p.pk IS NOT NULL THEN 'position' ELSE 'none' END AS how FROM s LEFT JOIN exact e ON e.pk = s.pk AND e.source = s.seq LEFT JOIN placed p ON p.pk = s.pk AND p.source = s.seq)"""


@query(f"WITH {_MATCHED} SELECT * FROM matched")
def source_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.match_sources(*_letters(spark, sf_dir))


_same = lambda c: f"CASE WHEN s.{c} IS NULL OR o.{c} IS NULL THEN 'manual_review' WHEN s.{c} = o.{c} THEN 'passed' ELSE 'failed' END AS {c}_status"


@query(f"WITH {_MATCHED} SELECT m.pk, m.source, m.offer, {_same('number')}, {_same('date')}, {_same('total')} FROM matched m JOIN s ON s.pk = m.pk AND s.seq = m.source LEFT JOIN o ON o.pk = m.pk AND o.seq = m.offer")
def source_requisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers, sources = _letters(spark, sf_dir)
    return op.compare_source_requisites(op.match_sources(offers, sources), offers, sources)


_LOOK = f"""{ITEMS}, {PARTS}, i AS (SELECT pk, seq, CASE WHEN seq % 2 = 0 THEN ktru END AS ktru, code, name FROM items JOIN parts USING (item)), r AS (SELECT item AS ref_id, CASE WHEN item % 3 <> 0 THEN ktru END AS ktru, CASE WHEN item % 3 <> 0 THEN code END AS code, CASE WHEN item % 3 <> 0 THEN name END AS name FROM parts)"""


@query(f"""WITH {_LOOK}, e AS (SELECT pk, seq, min(ref_id) AS ref_id, 0 AS p, 'ktru' AS how FROM i JOIN r ON i.ktru = r.ktru GROUP BY pk, seq HAVING count(*) = 1
UNION ALL SELECT pk, seq, min(ref_id), 1, 'code+name' FROM i JOIN r ON i.code = r.code AND i.name = r.name GROUP BY pk, seq HAVING count(*) = 1 UNION ALL SELECT pk, seq, min(ref_id), 2, 'name' FROM i JOIN r ON i.name = r.name GROUP BY pk, seq HAVING count(*) = 1),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY pk, seq ORDER BY p) = 1) SELECT i.pk, i.seq, ref_id, how FROM i LEFT JOIN b ON b.pk = i.pk AND b.seq = i.seq""")
def item_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = item_parts(spark, sf_dir, "name", "code", "ktru").select("pk", "seq", F.when(F.col("seq") % 2 == 0, F.col("ktru")).alias("ktru"), "code", "name")
    return op.lookup_item(rows, parts(spark, sf_dir).select(F.col("item").alias("ref_id"), *[F.when(F.col("item") % 3 != 0, F.col(c)).alias(c) for c in ("ktru", "code", "name")]))


_ENTRIES = [(1, "red widget", "10.1"), (2, "blue", "20.2"), (3, "bolt", "30.3"), (4, "small ring of steel", "40.4"), (5, "green", "50.5")]
_ENTRY_SQL = ", ".join(f"({o}, '{n}', '{c}')" for o, n, c in _ENTRIES)


@query(f"""WITH {PARTS}, e(ord, e_name, code2) AS (VALUES {_ENTRY_SQL}), f AS (SELECT item AS pk, min_by(code2, ord) AS code FROM parts JOIN e ON name <> '' AND (contains(name, e_name) OR contains(e_name, name)) GROUP BY item)
SELECT item AS pk, 1 AS seq, name, f.code FROM parts LEFT JOIN f ON f.pk = item""")
def code_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.createDataFrame(_ENTRIES, "ord int, name string, code string")
    return op.code_by_name(parts(spark, sf_dir).select(F.col("item").alias("pk"), F.lit(1).alias("seq"), "name"), entries)


@query(f"""WITH {ITEMS}, {PARTS}, w AS (SELECT pk, seq, role, code, {_TOK} AS tokens FROM items JOIN parts USING (item)), i AS (SELECT * FROM w WHERE role = 'O'), c AS (SELECT DISTINCT pk, code, tokens FROM w WHERE role = 'F'),
m AS (SELECT i.pk, i.seq, c.code FROM i JOIN c ON i.pk = c.pk AND len(list_intersect(i.tokens, c.tokens)) >= greatest(1, least(3, len(i.tokens), len(c.tokens)))), s AS (SELECT pk, seq, count(*) AS n, min(code) AS code FROM (SELECT DISTINCT * FROM m) GROUP BY ALL)
SELECT i.pk, i.seq, CASE WHEN n = 1 THEN s.code END AS code, coalesce(n, 0) AS n_codes, CASE WHEN n = 1 THEN 'passed' ELSE 'warning' END AS status FROM i LEFT JOIN s ON s.pk = i.pk AND s.seq = i.seq""")
def link_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = item_parts(spark, sf_dir, "name", "code").select("pk", "seq", "role", "code", fn.name_tokens(F.col("name")).alias("tokens"))
    return op.link_codes(w.where("role = 'O'"), w.where("role = 'F'").select("pk", "code", "tokens").distinct())


_PREFIX = f"""{PARTS}, c AS (SELECT DISTINCT code FROM parts), r AS (SELECT DISTINCT CASE WHEN size % 4 <> 1 THEN NULL WHEN item % 3 = 0 THEN code WHEN item % 3 = 1 THEN split_part(code, '.', 1) || '.' || split_part(code, '.', 2) ELSE split_part(code, '.', 1) || '.' || left(split_part(code, '.', 2), 1) END AS code FROM parts),
d AS (SELECT code, string_split(code, '.') AS p, unnest(generate_series(2, 4)) AS d FROM c), t AS (SELECT code, d, array_to_string(p[1:d - 1], '.') || '.' AS head, p[d] AS last FROM d),
cand AS (SELECT code, d, 0 AS k, head || last AS candidate FROM t UNION ALL SELECT code, d, k, head || left(last, k) FROM (SELECT *, unnest(generate_series(1, length(last) - 1)) AS k FROM t)),
known AS (SELECT candidate, min(code) FILTER (code = candidate) AS same, min(code) AS code FROM (SELECT code, array_to_string(string_split(code, '.')[1:n], '.') AS candidate FROM (SELECT code, unnest(generate_series(1, len(string_split(code, '.')))) AS n FROM r)) GROUP BY candidate),
hit AS (SELECT cand.code, cand.candidate, coalesce(same, known.code) AS ref_code, same IS NOT NULL AS exact FROM cand JOIN known ON cand.candidate = known.candidate QUALIFY row_number() OVER (PARTITION BY cand.code ORDER BY d DESC, k) = 1)"""


def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = lambda n: F.split_part("code", F.lit("."), F.lit(n))
    code = F.when(F.col("item") % 3 == 0, F.col("code")).when(F.col("item") % 3 == 1, F.concat_ws(".", seg(1), seg(2))).otherwise(F.concat_ws(".", seg(1), F.substring(seg(2), 1, 1)))
    return parts(spark, sf_dir).select(F.when(F.col("size") % 4 == 1, code).alias("code")).distinct()


@query(f"WITH {_PREFIX} SELECT c.code, candidate, ref_code, exact FROM c LEFT JOIN hit ON hit.code = c.code")
def prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the sizes a quarter has reference codes, of several depths."""
    return op.prefix_lookup(parts(spark, sf_dir).select("code"), _reference(spark, sf_dir))


@query(f"""WITH {_PREFIX}, need AS (SELECT DISTINCT size AS pk, parts.code, hit.code IS NOT NULL AS due FROM parts LEFT JOIN hit ON hit.code = parts.code), f AS (SELECT size AS pk, CASE WHEN item % 5 <> 0 THEN code ELSE '00.00' END AS code, name AS label, CASE WHEN item % 4 <> 0 THEN brand ELSE ' ' END AS value FROM parts),
k AS (SELECT coalesce(need.pk, f.pk) AS pk, coalesce(need.code, f.code) AS code, CASE WHEN due IS NULL THEN 'unscoped' WHEN due AND f.pk IS NULL THEN 'missing' WHEN due AND coalesce(trim(value), '') = '' THEN 'label_only' WHEN due THEN 'present' WHEN f.pk IS NOT NULL AND coalesce(trim(value), '') <> '' THEN 'unexpected' ELSE 'not_due' END AS kind FROM need FULL JOIN f ON need.pk = f.pk AND need.code = f.code)
SELECT *, CASE WHEN kind IN ('missing', 'label_only', 'unexpected') THEN 'failed' WHEN kind = 'unscoped' THEN 'warning' WHEN kind = 'present' THEN 'passed' ELSE 'not_applicable' END AS status FROM k""")
def regime_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir).withColumn("pk", F.col("size"))
    fields = p.select("pk", F.when(F.col("item") % 5 != 0, F.col("code")).otherwise("00.00").alias("code"), F.col("name").alias("label"), F.when(F.col("item") % 4 != 0, F.col("brand")).otherwise(" ").alias("value"))
    return cat.regime_check(p.select("pk", "code"), fields, _reference(spark, sf_dir))


@query()
def best_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of lines against those of the parts of the same size and brand."""
    p = parts(spark, sf_dir)
    ref = p.select(F.col("item").alias("ref_id"), F.col("name").alias("ref_name"), "size", "brand")
    return op.best_in_blocks(p.select(F.col("item").alias("pk"), F.lit(1).alias("seq"), F.concat_ws(" ", "name", "kind").alias("name"), "size", "brand"), ref, ["size", "brand"])


_DECIDE = """d AS (SELECT doc_id AS pk, 'q' AS key, doc_id % 3 AS candidate_id FROM labels UNION ALL SELECT doc_id, 'q', 7 FROM labels WHERE toxic = 1), r AS (SELECT doc_id AS pk, 'q' AS key, source FROM documents WHERE n_chars > 500),
c AS (SELECT doc_id AS pk, source, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 3 END AS candidate_id, lang = 'en' AS supported FROM documents)"""


@query(f"""WITH {_DECIDE}, j AS (SELECT d.pk, d.key, d.candidate_id, r.source, count(*) OVER (PARTITION BY d.pk, d.key) AS n FROM (SELECT DISTINCT * FROM d) d LEFT JOIN r ON d.pk = r.pk AND d.key = r.key)
SELECT j.pk, key, j.candidate_id, CASE WHEN j.source IS NULL THEN 'not_requested' WHEN n <> 1 THEN 'ambiguous' WHEN supported IS NULL THEN 'unknown_candidate' WHEN NOT supported THEN 'ambiguous' ELSE 'accepted' END AS status
FROM j LEFT JOIN c ON c.pk = j.pk AND c.source = j.source AND c.candidate_id = j.candidate_id""")
def decision_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are decisions about documents; toxic ones have a second answer."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    d = labels.select(F.col("doc_id").alias("pk"), F.lit("q").alias("key"), (F.col("doc_id") % 3).alias("candidate_id"))
    d = d.unionByName(labels.where("toxic = 1").select(F.col("doc_id").alias("pk"), F.lit("q").alias("key"), F.lit(7).cast("bigint").alias("candidate_id")))
    r = docs.where("n_chars > 500").select(F.col("doc_id").alias("pk"), F.lit("q").alias("key"), "source")
    c = docs.select(F.col("doc_id").alias("pk"), "source", F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 3).alias("candidate_id"), (F.col("lang") == "en").alias("supported"))
    return op.validate_decisions(d, r, c)


@query(f"""WITH {_SIDES}, p AS (SELECT a.pk, a.seq AS l, b.seq AS r FROM a JOIN b ON a.pk = b.pk AND a.okpd2 = b.okpd2),
c AS (SELECT a.pk, a.seq, b.qty, b.unit, b.price, b.price * b.qty AS total, a.qty AS ref_qty, a.unit AS ref_unit, CASE WHEN a.seq % 2 = 0 THEN a.qty END AS plan_qty FROM p JOIN a ON a.pk = p.pk AND a.seq = p.l JOIN b ON b.pk = p.pk AND b.seq = p.r),
s AS (SELECT pk, seq, CASE WHEN qty = ref_qty THEN 'passed' ELSE 'failed' END AS qty_status, CASE WHEN plan_qty IS NULL THEN 'skipped' WHEN qty = plan_qty THEN 'passed' ELSE 'failed' END AS plan_status, CASE WHEN unit = ref_unit THEN 'passed' ELSE 'failed' END AS unit_status, 'passed' AS total_status FROM c)
SELECT *, CASE WHEN 'failed' IN (qty_status, plan_status, unit_status, total_status) THEN 'failed' ELSE 'passed' END AS status FROM s""")
def offer_row_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of both documents with the same short code."""
    from ..operators.rules import offer_row_check as check

    a, b = _sides(spark, sf_dir)
    ref = a.select("pk", "seq", "okpd2", F.col("qty").alias("ref_qty"), F.col("unit").alias("ref_unit"), F.when(F.col("seq") % 2 == 0, F.col("qty")).alias("plan_qty"))
    return check(ref.join(b.select("pk", "okpd2", "qty", "unit", "price", (F.col("price") * F.col("qty")).alias("total")), ["pk", "okpd2"]))


@query(f"""WITH {ITEMS}, {PARTS}, c AS (SELECT pk, seq, ktru AS code, CASE WHEN seq % 5 = 0 THEN ' ' WHEN seq % 3 = 0 THEN upper(name) ELSE name || CASE WHEN seq % 7 = 0 THEN ' x' ELSE '' END END AS name FROM items JOIN parts USING (item)), k AS (SELECT CASE WHEN size % 6 <> 0 THEN ktru END AS code, name AS c_name, DATE '1995-01-01' + (item % 3000)::INTEGER AS end_date FROM parts)
SELECT pk, seq, c.code, CASE WHEN k.code IS NULL THEN 'not_found' WHEN end_date <= DATE '1998-06-01' THEN 'excluded' WHEN trim(name) = '' THEN 'unnamed' WHEN lower(trim(name)) = c_name THEN 'name_equal' ELSE 'name_differs' END AS kind FROM c LEFT JOIN k USING (code)""")
def catalogue_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("seq") % 5 == 0, " ").when(F.col("seq") % 3 == 0, F.upper("name")).otherwise(F.concat("name", F.when(F.col("seq") % 7 == 0, " x").otherwise("")))
    codes = item_parts(spark, sf_dir).select("pk", "seq", F.col("ktru").alias("code"), name.alias("name"))
    known = parts(spark, sf_dir).select(F.when(F.col("size") % 6 != 0, F.col("ktru")).alias("code"), "name", F.date_add(F.lit("1995-01-01").cast("date"), (F.col("item") % 3000).cast("int")).alias("end_date"))
    return cat.catalogue_status(codes, known, F.lit("1998-06-01").cast("date"))


#: Catalogue: each part has a size range, a brand that must be there, and (large ones) a type.
_CHARS = f"""{ITEMS}, {PARTS}, k AS (SELECT ktru AS code, 'Размер' AS name, ['<= ' || (size + 5)] AS allowed, true AS required, 'шт' AS unit FROM parts UNION ALL SELECT ktru, 'Brand', [brand, 'any'], true, NULL FROM parts UNION ALL SELECT ktru, 'Kind', [lower(kind)], false, NULL FROM parts WHERE size > 25),
w AS (SELECT pk, seq, ktru AS code, size, brand, kind, qty FROM items JOIN parts USING (item)),
v AS (SELECT pk, seq, code, 'Рaзмер' AS name, qty::VARCHAR AS value, CASE WHEN qty % 4 = 0 THEN 'кг' ELSE 'штука' END AS unit, 'размер' AS k FROM w UNION ALL SELECT pk, seq, code, 'brand', CASE WHEN qty % 3 = 0 THEN 'other' ELSE upper(brand) END, NULL, 'brand' FROM w WHERE qty % 2 = 0 UNION ALL SELECT pk, seq, code, 'kind', kind, NULL, 'kind' FROM w)"""


def _chars(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = parts(spark, sf_dir)
    none = F.lit(None).cast("string")
    known = p.select(F.col("ktru").alias("code"), F.lit("Размер").alias("name"), F.array(F.concat(F.lit("<= "), F.col("size") + 5)).alias("allowed"), F.lit(True).alias("required"), F.lit("шт").alias("unit"))
    known = known.unionByName(p.select(F.col("ktru").alias("code"), F.lit("Brand").alias("name"), F.array("brand", F.lit("any")).alias("allowed"), F.lit(True).alias("required"), none.alias("unit")))
    known = known.unionByName(p.where("size > 25").select(F.col("ktru").alias("code"), F.lit("Kind").alias("name"), F.array(F.lower("kind")).alias("allowed"), F.lit(False).alias("required"), none.alias("unit")))
    w = item_parts(spark, sf_dir).withColumnRenamed("code", "short").withColumnRenamed("ktru", "code")
    row = lambda df, name, value, unit: df.select("pk", "seq", "code", F.lit(name).alias("name"), value.alias("value"), unit.alias("unit"))
    chars = row(w, "Рaзмер", F.col("qty").cast("string"), F.when(F.col("qty") % 4 == 0, "кг").otherwise("штука"))
    chars = chars.unionByName(row(w.where("qty % 2 = 0"), "brand", F.when(F.col("qty") % 3 == 0, "other").otherwise(F.upper("brand")), none)).unionByName(row(w, "kind", F.col("kind"), none))
    return chars, w.select("pk", "seq", "code"), known


@query(f"""WITH {_CHARS}, s AS (SELECT ktru, size, brand FROM parts)
SELECT pk, seq, v.code, v.name, v.value, CASE v.k WHEN 'kind' THEN CASE WHEN s.size > 25 THEN 'passed' ELSE 'extra' END
 WHEN 'brand' THEN CASE WHEN value = 'other' THEN 'failed' ELSE 'passed' END ELSE CASE WHEN value::INTEGER <= s.size + 5 AND unit = 'штука' THEN 'passed' ELSE 'failed' END END AS status FROM v JOIN s ON s.ktru = v.code""")
def char_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes are ranges with a unit, brands lists of values; the name of one has a look-alike letter."""
    chars, _, known = _chars(spark, sf_dir)
    return cat.validate_chars(chars, known)


@query(f"""WITH {_CHARS} SELECT pk, seq, code, 'Brand' AS name FROM w WHERE qty % 2 <> 0""")
def missing_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.missing_required(*_chars(spark, sf_dir))


@query(f"""WITH {_CHARS} SELECT v.pk, v.seq, v.code, v.name, v.value, v.unit FROM v JOIN parts ON ktru = v.code WHERE v.k = 'kind' AND size <= 25""")
def extra_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars, _, known = _chars(spark, sf_dir)
    return cat.extra_chars(chars, known)


_STEMS = "list_distinct(list_transform(list_distinct(list_filter(string_split(name, ' '), lambda w: length(w) >= 3)), lambda t: left(t, 5)))"


@query(f"""WITH {ITEMS}, {PARTS}, w AS (SELECT pk, seq, role, ktru, code, {_STEMS} AS st FROM items JOIN parts USING (item)), i AS (SELECT pk, seq, CASE WHEN seq % 2 = 0 THEN ktru END AS ktru, st FROM w WHERE role = 'O'), c AS (SELECT DISTINCT pk, code, ktru, st FROM w WHERE role = 'F'),
k AS (SELECT i.pk, i.seq, min(c.code) AS code FROM i JOIN c ON i.pk = c.pk AND i.ktru = c.ktru GROUP BY ALL HAVING count(*) = 1), n AS (SELECT i.pk, i.seq, c.code FROM i JOIN c ON i.pk = c.pk AND len(list_intersect(i.st, c.st)) = len(c.st) WHERE (i.pk, i.seq) NOT IN (SELECT (pk, seq) FROM k)),
u AS (SELECT pk, seq, min(code) AS code FROM (SELECT DISTINCT * FROM n) GROUP BY ALL HAVING count(*) = 1)
SELECT i.pk, i.seq, coalesce(k.code, u.code) AS code, CASE WHEN k.pk IS NOT NULL THEN 'ktru' WHEN u.pk IS NOT NULL THEN 'name' END AS how FROM i LEFT JOIN k ON k.pk = i.pk AND k.seq = i.seq LEFT JOIN u ON u.pk = i.pk AND u.seq = i.seq""")
def plan_code_for_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = item_parts(spark, sf_dir, "name", "code", "ktru").select("pk", "seq", "role", "ktru", "code", fn.name_tokens(F.col("name")).alias("tokens"))
    left = w.where("role = 'O'").drop("code").withColumn("ktru", F.when(F.col("seq") % 2 == 0, F.col("ktru")))
    return cat.plan_code_for_item(left, w.where("role = 'F'").select("pk", "code", "ktru", "tokens").distinct())


@query(f"""WITH {ITEMS}, {PARTS}, r AS (SELECT pk, seq, seq AS row_no, name AS name_norm, code, kind AS char, count(*) OVER (PARTITION BY pk) AS n FROM items JOIN parts USING (item)),
j AS (SELECT pk, seq AS j, CASE WHEN seq % 4 = 1 THEN seq + 1 END AS row_no, 'about ' || name AS name_norm, CASE WHEN seq % 3 = 0 THEN code END AS code, [lower(kind)] AS chars FROM items JOIN parts USING (item) WHERE role = 'F'
 UNION ALL SELECT pk, 100, NULL, 'nothing', NULL, ['PROMO'] FROM items WHERE seq = 1),
m AS (SELECT j.pk, j.j, r.seq, CASE WHEN j.row_no = r.row_no THEN 1 WHEN r.name_norm <> '' AND contains(j.name_norm, r.name_norm) THEN 2 WHEN j.code = r.code THEN 3 WHEN list_contains(chars, r.char) THEN 4 WHEN n = 1 THEN 5 END AS way FROM j JOIN r ON j.pk = r.pk),
b AS (SELECT * FROM m WHERE way IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pk, j ORDER BY way, seq) = 1)
SELECT j.pk, j.j, b.seq, b.way, CASE WHEN b.seq IS NULL THEN 'partial' ELSE 'passed' END AS status FROM j LEFT JOIN b ON b.pk = j.pk AND b.j = j.j""")
def link_justifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = item_parts(spark, sf_dir, "name", "code", "kind")
    rows = w.select("pk", "seq", F.col("seq").alias("row_no"), F.col("name").alias("name_norm"), "code", F.col("kind").alias("char"))
    just = w.where("role = 'F'").select("pk", F.col("seq").alias("j"), F.when(F.col("seq") % 4 == 1, F.col("seq") + 1).alias("row_no"), F.concat(F.lit("about "), F.col("name")).alias("name_norm"), F.when(F.col("seq") % 3 == 0, F.col("code")).alias("code"), F.array(F.lower("kind")).alias("chars"))
    more = w.where("seq = 1").select("pk", F.lit(100).alias("j"), F.lit(None).cast("int").alias("row_no"), F.lit("nothing").alias("name_norm"), F.lit(None).cast("string").alias("code"), F.array(F.lit("PROMO")).alias("chars"))
    return cat.link_justifications(just.unionByName(more), rows)


@query(f"""WITH {PARTS} SELECT item, list_no, position, coalesce((list_no = 1 AND (position BETWEEN 25 AND 26 OR position BETWEEN 32 AND 32)) OR (list_no = 2 AND position BETWEEN 191 AND 361), false) AS special FROM (SELECT item, (item % 3)::INTEGER AS list_no, CASE WHEN item % 3 = 1 THEN size ELSE (item % 400)::INTEGER END AS position FROM parts)""")
def special_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir).select("item", (F.col("item") % 3).cast("int").alias("list_no"), F.when(F.col("item") % 3 == 1, F.col("size")).otherwise((F.col("item") % 400).cast("int")).alias("position"))
    return cat.is_special(p)


@query(f"""WITH {ITEMS}, r AS (SELECT pk, CASE WHEN qty % 9 <> 0 THEN tax > 2 END AS ic, item % 5 = 0 AS sp, CASE WHEN qty % 4 <> 0 THEN discount > 3 END AS ju FROM items),
s AS (SELECT pk, CASE WHEN ic IS NULL OR sp IS NULL THEN 'manual_review' WHEN NOT ic THEN 'not_applicable' WHEN sp THEN 'failed' WHEN ju IS NULL THEN 'manual_review' WHEN ju THEN 'passed' ELSE 'failed' END AS status FROM r)
SELECT pk, count(*) AS n_chars, max_by(status, CASE status WHEN 'not_applicable' THEN 0 WHEN 'passed' THEN 2 WHEN 'manual_review' THEN 4 ELSE 5 END) AS status FROM s GROUP BY pk""")
def extra_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).select("pk", "seq", F.when(F.col("qty") % 9 != 0, F.col("tax") > 2).alias("in_catalogue"), (F.col("item") % 5 == 0).alias("special"), F.when(F.col("qty") % 4 != 0, F.col("discount") > 3).alias("justified"))
    return cat.extra_decision(rows)


@query("""SELECT p_partkey AS pk, name, trademark, coalesce(nullif(trim(trademark), ''), nullif(trim(regexp_extract(name, 'brand ([a-z]+)', 1)), '')) AS mark FROM (SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN ' brand ' || lower(p_type) ELSE '' END AS name, CASE WHEN p_size % 3 = 0 THEN p_brand END AS trademark FROM part) t WHERE coalesce(nullif(trim(trademark), ''), nullif(trim(regexp_extract(name, 'brand ([a-z]+)', 1)), '')) IS NOT NULL""")
def trademark_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    name = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" brand "), F.lower("p_type"))).otherwise(""))
    return cat.trademark_rows(p.select(F.col("p_partkey").alias("pk"), name.alias("name"), F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).alias("trademark")), r"brand ([a-z]+)")
