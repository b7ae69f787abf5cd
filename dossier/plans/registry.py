"""Collects queries with their SQL, and the views of the given tables that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A task that sorts or groups the rows of a table has about so many of them.
SLICE_ROWS = 500_000


def sliced(spark: SparkSession, n_rows: int) -> int | None:
    """Slices of SLICE_ROWS rows at most, or None if one is enough. The session's shuffle partitions are not asked, as
    adaptive execution joins them by their packed bytes, into tasks of several millions of rows."""
    slices = -(-n_rows // SLICE_ROWS)
    return max(slices, spark.sparkContext.defaultParallelism) if slices > 1 else None


def dealt(df: DataFrame, key: str, n_rows: int) -> DataFrame:
    """``df`` dealt by a key into slices if it needs any, so that a task's memory doesn't grow with the table. Windows,
    groups and joins by the key (and more) then work where the rows lie."""
    slices = sliced(df.sparkSession, n_rows)
    return df.repartition(slices, key) if slices else df


def _numbered(lines: DataFrame, *more: str) -> DataFrame:
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_tax", "l_discount", "l_returnflag", "l_linestatus")
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    return lines.select(
        F.col("l_orderkey").alias("pk"), F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)).alias("seq"),
        F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("source"), F.round("l_quantity").cast("bigint").alias("qty"),
        cents("l_extendedprice").alias("total"), cents("l_tax").alias("tax"), cents("l_discount").alias("discount"),
        F.col("l_linestatus").alias("role"), F.col("l_returnflag").alias("flag"), F.col("l_shipdate").cast("date").alias("day"), *more,
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a package: pk, seq, item, source, qty, total (in kopeks), tax and discount in percent, role, flag, day."""
    lines = table(spark, sf_dir, "lineitem")
    return _numbered(dealt(lines, "l_orderkey", lines.count()))


ITEMS = """items AS (SELECT l_orderkey AS pk, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_tax, l_discount, l_returnflag, l_linestatus)::INTEGER AS seq,
  l_partkey AS item, l_suppkey AS source, round(l_quantity)::BIGINT AS qty, round(l_extendedprice * 100)::BIGINT AS total, round(l_tax * 100)::BIGINT AS tax, round(l_discount * 100)::BIGINT AS discount,
  l_linestatus AS role, l_returnflag AS flag, l_shipdate::DATE AS day FROM lineitem)"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier prices of an item: pk (the item), source, seq, unit price and row total in kopeks, qty.

    The order of the prices of an item is that of (order, line).
    """
    every = table(spark, sf_dir, "lineitem")
    lines = dealt(every, "l_partkey", every.count()).select(
        F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("source"), F.round("l_quantity").cast("bigint").alias("qty"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("total"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"),
    )
    seq = F.row_number().over(W.partitionBy("pk").orderBy("o", "n", "source", "total", "qty")).alias("seq")
    return lines.select("pk", seq, "source", "qty", "total", F.expr("(2 * total + qty) div (2 * qty)").alias("price"))


PRICES = """prices AS (SELECT pk, row_number() OVER (PARTITION BY pk ORDER BY o, n, source, total, qty)::INTEGER AS seq, source, qty, total, (2 * total + qty) // (2 * qty) AS price
  FROM (SELECT l_partkey AS pk, l_suppkey AS source, round(l_quantity)::BIGINT AS qty, round(l_extendedprice * 100)::BIGINT AS total, l_orderkey AS o, l_linenumber AS n FROM lineitem))"""


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages: pk, customer, status, amount in kopeks, day, priority."""
    orders = table(spark, sf_dir, "orders")
    return dealt(orders, "o_orderkey", orders.count()).select(
        F.col("o_orderkey").alias("pk"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("amount"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").alias("priority"),
    )


PACKAGES = """packages AS (SELECT o_orderkey AS pk, o_custkey AS customer, o_orderstatus AS status, round(o_totalprice * 100)::BIGINT AS amount, o_orderdate::DATE AS day, o_orderpriority AS priority FROM orders)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue of items: item, name, brand, kind, size, code (segments 'ss.pp.tt'), long code."""
    code = F.concat_ws(".", F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), F.lpad((F.col("p_partkey") % 7).cast("string"), 2, "0"), F.lit("000"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"),
        code.alias("code"), F.concat_ws("-", code, F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("ktru"),
    )


def item_parts(spark: SparkSession, sf_dir: str, *columns: str, slices: int | None = None) -> DataFrame:
    """Lines with columns of their part (all, if none are named), dealt by package into ``slices`` if that is given.

    Where the lines need slices the parts are met before the lines are dealt by package and numbered: after that all work
    by package needs no further shuffle. A line whose part isn't there has its number all the same and goes afterwards,
    and of a part that is there twice both rows are met, as by a join of ``items`` and ``parts``.
    """
    p, lines = parts(spark, sf_dir), table(spark, sf_dir, "lineitem")
    p = p.select("item", *(columns or [c for c in p.columns if c != "item"]))
    n = lines.count()
    if sliced(spark, n) is None:
        return _numbered(lines).join(p, "item")
    listed = p.groupBy(F.col("item").alias("l_partkey")).agg(F.collect_list(F.struct(*p.columns[1:])).alias("_parts"))
    met = dealt(lines, "l_partkey", n).join(listed, "l_partkey", "left")
    met = met.repartition(slices, "l_orderkey") if slices else dealt(met, "l_orderkey", n)
    return _numbered(met, "_parts").select("*", F.inline("_parts")).drop("_parts")


PARTS = """parts AS (SELECT *, code || '-' || lpad(item::VARCHAR, 8, '0') AS ktru FROM (SELECT p_partkey AS item, p_name AS name, p_brand AS brand, p_type AS kind, p_size AS size,
  lpad(p_size::VARCHAR, 2, '0') || '.' || lpad((p_partkey % 100)::VARCHAR, 2, '0') || '.' || lpad((p_partkey % 7)::VARCHAR, 2, '0') || '.000' AS code FROM part))"""
