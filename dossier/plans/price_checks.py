"""Prices, arithmetic and bands over lineitem and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prices as op
from .registry import ITEMS, PACKAGES, PRICES, items, packages, prices, query


def _status(known: str, good: str) -> str:
    return f"CASE WHEN NOT coalesce({known}, false) THEN 'manual_review' WHEN coalesce({good}, false) THEN 'passed' ELSE 'failed' END"


@query(f"""WITH {PRICES}, v AS (SELECT pk, count(*) AS n_prices, avg(price) AS mean, stddev_samp(price) AS dev FROM prices GROUP BY pk),
m AS (SELECT pk, price AS min_price, source AS min_source FROM prices QUALIFY row_number() OVER (PARTITION BY pk ORDER BY price, seq) = 1)
SELECT pk, n_prices, min_price, min_source, cv, {_status("cv IS NOT NULL", "cv < 33")} AS status
FROM (SELECT pk, n_prices, round(CASE WHEN n_prices >= 2 AND mean <> 0 THEN dev / mean * 100 END, 4) AS cv FROM v) JOIN m USING (pk)""")
def price_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least price with its first source, and the variation of the prices, of each item."""
    got = prices(spark, sf_dir)
    return op.price_variation(got).join(op.min_price(got).drop("n_prices"), "pk")


@query(f"""WITH {PRICES} SELECT pk, source, count(*) AS n_rows, sum(CASE WHEN seq % 3 = 0 THEN qty * price ELSE total END)::BIGINT AS source_total FROM prices GROUP BY ALL""")
def supplier_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each third row total is missing and taken from quantity by price."""
    return op.supplier_totals(prices(spark, sf_dir).withColumn("total", F.when(F.col("seq") % 3 != 0, F.col("total"))))


@query(f"""WITH {PRICES}, t AS (SELECT pk, source, sum(total) AS t FROM prices GROUP BY ALL), v AS (SELECT pk, count(*) AS n_prices, round(CASE WHEN count(*) >= 2 THEN stddev_samp(t) / avg(t) * 100 END, 4) AS cv FROM t GROUP BY pk)
SELECT *, {_status("cv IS NOT NULL", "cv < 33")} AS status FROM v""")
def totals_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.totals_variation(prices(spark, sf_dir))


@query(f"""WITH {ITEMS}, {PACKAGES}, r AS (SELECT *, (2 * total + qty) // (2 * qty) AS price FROM items),
s AS (SELECT pk, count(*) AS n_rows, count(*) FILTER (qty * price <> total) AS n_wrong, sum(total)::BIGINT AS row_sum FROM r GROUP BY pk)
SELECT pk, amount, coalesce(n_rows, 0) AS n_rows, coalesce(n_wrong, 0) AS n_wrong, row_sum, {_status("n_rows > 0", "n_wrong = 0")} AS row_status, {_status("row_sum IS NOT NULL", "row_sum = amount")} AS sum_status
FROM packages LEFT JOIN s USING (pk)""")
def row_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).withColumn("price", F.expr("(2 * total + qty) div (2 * qty)"))
    return op.reconcile_rows(rows, packages(spark, sf_dir).select("pk", "amount"))


@query(f"""WITH {ITEMS}, t AS (SELECT pk, source, count(*) AS n_rows, sum(total)::BIGINT AS source_total FROM items GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY source)::INTEGER AS place FROM t),
d AS (SELECT pk, row_number() OVER (PARTITION BY pk ORDER BY seq)::INTEGER AS place, total AS declared FROM items WHERE flag <> 'N')
SELECT pk, place, source, n_rows, source_total, declared, {_status("source_total IS NOT NULL AND declared IS NOT NULL", "source_total = declared")} AS status FROM p FULL JOIN d USING (pk, place)""")
def source_totals_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source totals of a package in their order against the totals of its returned lines."""
    from pyspark.sql import Window as W

    rows = items(spark, sf_dir).withColumn("price", F.lit(None).cast("bigint"))
    declared = rows.where("flag != 'N'").select("pk", F.row_number().over(W.partitionBy("pk").orderBy("seq")).alias("place"), F.col("total").alias("declared"))
    return op.reconcile_totals(rows, declared)


@query(f"""WITH {ITEMS}, r AS (SELECT pk, source AS offer, qty, CASE WHEN seq % 4 <> 0 THEN total END AS total, (2 * total + qty) // (2 * qty) AS price FROM items),
o AS (SELECT pk, source AS offer, sum(total)::BIGINT AS offer_total FROM items GROUP BY ALL),
s AS (SELECT pk, offer, count(*) AS n_rows, count(*) FILTER (total IS NULL) AS n_derived, count(*) FILTER (coalesce(total, qty * price) IS NULL) AS n_unknown, count(*) FILTER (qty * price <> total) AS n_wrong, sum(coalesce(total, qty * price))::BIGINT AS sum FROM r GROUP BY ALL)
SELECT *, {_status("n_unknown = 0", "n_wrong = 0 AND sum = offer_total")} AS status FROM o JOIN s USING (pk, offer)""")
def offer_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An offer is what one source has in a package; each fourth row has no total."""
    rows = items(spark, sf_dir).withColumnRenamed("source", "offer")
    offers = rows.groupBy("pk", "offer").agg(F.sum("total").alias("offer_total"))
    return op.offer_arithmetic(rows.withColumn("price", F.expr("(2 * total + qty) div (2 * qty)")).withColumn("total", F.when(F.col("seq") % 4 != 0, F.col("total"))), offers)


@query(f"""WITH {ITEMS}, k AS (SELECT pk, seq, total, tax AS rate, total * tax // 100 AS vat, CASE WHEN tax = 0 THEN 'exempt' WHEN flag = 'N' THEN 'undetermined' WHEN role = 'O' THEN 'included' ELSE 'on_top' END AS vat_kind FROM items),
d AS (SELECT *, CASE vat_kind WHEN 'exempt' THEN 0 WHEN 'included' THEN (2 * total * rate + 100 + rate) // (2 * (100 + rate)) WHEN 'on_top' THEN (2 * total * rate + 100) // 200 END AS vat_due FROM k)
SELECT *, CASE WHEN vat_kind = 'exempt' THEN 'passed' WHEN vat_due IS NULL THEN 'manual_review' WHEN abs(vat_due - vat) <= 1 THEN 'passed' ELSE 'failed' END AS status FROM d""")
def vat_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate is l_tax; open lines include it, returned lines don't say."""
    rows = items(spark, sf_dir).select("pk", "seq", "total", F.col("tax").alias("rate"), F.expr("total * tax div 100").alias("vat"), F.when(F.col("flag") != "N", F.col("role") == "O").alias("included"))
    return op.vat_check(rows, F.col("rate") == 0).drop("included")


@query(f"""WITH {ITEMS} SELECT pk, year(day)::INTEGER AS stage, 0 AS level, count(*) AS n_rows, sum(total)::BIGINT AS price FROM items GROUP BY ALL
UNION ALL SELECT pk, NULL, 1, count(*), sum(total)::BIGINT FROM items GROUP BY pk""")
def stage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.stage_rollup(items(spark, sf_dir).withColumn("stage", F.year("day")))


@query(f"""WITH {PRICES}, e AS (SELECT pk, count(DISTINCT source) AS n_expected, min(price) AS declared FROM prices GROUP BY pk),
l AS (SELECT pk, min(price) AS least, count(DISTINCT source) AS n_matched FROM (SELECT pk, source, CASE WHEN source % 5 <> 0 THEN price END AS price FROM prices) WHERE price IS NOT NULL GROUP BY pk)
SELECT pk, n_expected, declared, least, coalesce(n_matched, 0) AS n_matched, {_status("coalesce(n_matched, 0) >= n_expected", "least = declared")} AS status FROM e LEFT JOIN l USING (pk)""")
def min_over_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fifth source has no matched offer."""
    got = prices(spark, sf_dir)
    expected = got.groupBy("pk").agg(F.countDistinct("source").alias("n_expected"), F.min("price").alias("declared"))
    return op.min_over_offers(got.withColumn("price", F.when(F.col("source") % 5 != 0, F.col("price"))), expected)


@query(f"""WITH {PRICES}, f AS (SELECT pk, source % 4 AS source, min_by(price, seq) AS price FROM (SELECT pk, source, seq, price FROM prices) GROUP BY ALL)
SELECT pk, max(price) FILTER (source = 0) AS s0, max(price) FILTER (source = 1) AS s1, max(price) FILTER (source = 2) AS s2, max(price) FILTER (source = 3) AS s3 FROM f GROUP BY pk""")
def price_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by four groups of sources."""
    return op.price_matrix(prices(spark, sf_dir).withColumn("source", F.concat(F.lit("s"), F.col("source") % 4)), ["s0", "s1", "s2", "s3"])


@query(f"""WITH {ITEMS}, o AS (SELECT pk, sum(total)::BIGINT AS offer_total FROM items GROUP BY pk),
r AS (SELECT pk, seq, total FROM items UNION ALL SELECT pk, 1000, offer_total FROM o WHERE pk % 3 <> 0),
w AS (SELECT *, count(total) OVER p AS n, sum(total) OVER p - total AS rest FROM r JOIN o USING (pk) WINDOW p AS (PARTITION BY pk)),
h AS (SELECT *, n >= 3 AND total = offer_total AND total = rest AS hit FROM w)
SELECT pk, seq::INTEGER AS seq, total FROM (SELECT *, min(seq) FILTER (hit) OVER (PARTITION BY pk) AS first FROM h) WHERE NOT (hit AND seq = first)""")
def proven_aggregate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three packages get a row with their total at the end."""
    rows = items(spark, sf_dir).select("pk", F.lit(0).alias("offer"), "seq", "total")
    offers = rows.groupBy("pk", "offer").agg(F.sum("total").alias("offer_total"))
    more = offers.where("pk % 3 != 0").select("pk", "offer", F.lit(1000).alias("seq"), F.col("offer_total").alias("total"))
    return op.drop_proven_aggregate(rows.unionByName(more), offers).drop("offer")


@query(f"""WITH {ITEMS}, r AS (SELECT pk, seq, CASE WHEN flag <> 'A' THEN total END AS total FROM items), w AS (SELECT *, count(total) OVER (PARTITION BY pk) AS n FROM r)
SELECT pk, seq, total FROM w WHERE total IS NOT NULL OR n < 2""")
def unpriced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).select("pk", F.lit(0).alias("offer"), "seq", F.when(F.col("flag") != "A", F.col("total")).alias("total"))
    return op.drop_unpriced_rows(rows.withColumn("price", F.lit(None).cast("bigint"))).select("pk", "seq", "total")
