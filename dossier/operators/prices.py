"""Price and arithmetic checks. Money is in minor units (long) or decimal; nothing is decided on a null operand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .findings import verdict

#: Coefficient of variation, in percent, from which prices are too unlike.
VARIATION_LIMIT = 33


def min_price(prices: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Least price of each item with its first source, against the declared minimum where one is given."""
    first = F.min(F.struct("price", "seq", "source"))
    out = prices.where("price is not null").groupBy("pk").agg(first.alias("m"), F.count("*").alias("n_prices")).select("pk", F.col("m.price").alias("min_price"), F.col("m.source").alias("min_source"), "n_prices")
    if declared is None:
        return out
    both = declared.join(out, "pk", "left")
    known = F.col("declared").isNotNull() & F.col("min_price").isNotNull()
    return both.withColumn("status", verdict(known, F.col("declared") == F.col("min_price")))


def price_variation(prices: DataFrame, limit: float = VARIATION_LIMIT) -> DataFrame:
    """Coefficient of variation by item (sample deviation in percent of the mean); none for one price or mean 0."""
    sums = prices.where("price is not null").groupBy("pk").agg(F.count("*").alias("n_prices"), F.avg("price").alias("mean"), F.stddev_samp("price").alias("dev"))
    cv = F.when((F.col("n_prices") >= 2) & (F.col("mean") != 0), F.col("dev") / F.col("mean") * 100)
    out = sums.select("pk", "n_prices", F.round(cv, 4).alias("cv"))
    return out.withColumn("status", verdict(F.col("cv").isNotNull(), F.col("cv") < limit))


def supplier_totals(prices: DataFrame) -> DataFrame:
    """Total of each source of a package; a missing row total is quantity by price, a row with neither makes it null."""
    row = F.coalesce("total", F.col("qty") * F.col("price"))
    sums = prices.groupBy("pk", "source").agg(F.count("*").alias("n_rows"), F.count_if(row.isNull()).alias("n_unknown"), F.sum(row).alias("sum"))
    return sums.select("pk", "source", "n_rows", F.when(F.col("n_unknown") == 0, F.col("sum")).alias("source_total"))


def totals_variation(prices: DataFrame) -> DataFrame:
    """Variation of the source totals of each package."""
    return price_variation(supplier_totals(prices).select("pk", F.col("source_total").alias("price")))


def reconcile_rows(items: DataFrame, declared: DataFrame) -> DataFrame:
    """Rows whose quantity by price isn't their total, and the sum of the rows against the declared amount.

    ``items``: pk, qty, price, total; ``declared``: pk, amount. The sum counts only if all rows are known.
    """
    product = F.col("qty") * F.col("price")
    rows = items.groupBy("pk").agg(
        F.count("*").alias("n_rows"), F.count_if(product.isNull() | F.col("total").isNull()).alias("n_unknown"),
        F.count_if(product != F.col("total")).alias("n_wrong"), F.when(F.bool_and(F.col("total").isNotNull()), F.sum("total")).alias("row_sum"),
    )
    both = declared.join(rows, "pk", "left")
    known = F.col("row_sum").isNotNull() & F.col("amount").isNotNull()
    return both.select(
        "pk", "amount", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_wrong", F.lit(0)).alias("n_wrong"), "row_sum",
        verdict(F.col("n_unknown") == 0, F.col("n_wrong") == 0).alias("row_status"), verdict(known, F.col("row_sum") == F.col("amount")).alias("sum_status"),
    )


def reconcile_totals(prices: DataFrame, declared: DataFrame) -> DataFrame:
    """Source totals in their order against the declared totals of the same place. ``declared``: pk, place, declared."""
    place = F.row_number().over(W.partitionBy("pk").orderBy("source"))
    own = supplier_totals(prices).withColumn("place", place)
    both = own.join(declared, ["pk", "place"], "full")
    return both.withColumn("status", verdict(F.col("source_total").isNotNull() & F.col("declared").isNotNull(), F.col("source_total") == F.col("declared")))


def offer_arithmetic(items: DataFrame, offers: DataFrame) -> DataFrame:
    """Offers (pk, offer, total): rows with wrong products, rows whose total had to be derived, and the sum."""
    row = F.coalesce("total", F.col("qty") * F.col("price"))
    sums = items.groupBy("pk", "offer").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("total").isNull() & row.isNotNull()).alias("n_derived"), F.count_if(row.isNull()).alias("n_unknown"),
        F.count_if(F.col("qty") * F.col("price") != F.col("total")).alias("n_wrong"), F.sum(row).alias("sum"),
    )
    both = offers.join(sums, ["pk", "offer"], "left")
    known = (F.col("n_unknown") == 0) & F.col("offer_total").isNotNull()
    return both.withColumn("status", verdict(known, (F.col("n_wrong") == 0) & (F.col("sum") == F.col("offer_total"))))


def vat_check(offers: DataFrame, exempt: Column) -> DataFrame:
    """VAT by kind: exempt, included in the total, on top of it, or undetermined; half up to the minor unit.

    ``offers``: total, rate (percent), vat, included (null if not said).
    """
    inside = F.round(F.col("total").cast("decimal(24,6)") * F.col("rate") / (100 + F.col("rate")), 0).cast("bigint")
    on_top = F.round(F.col("total").cast("decimal(24,6)") * F.col("rate") / 100, 0).cast("bigint")
    kind = F.when(exempt, "exempt").when(F.col("rate").isNull() | F.col("included").isNull(), "undetermined").when(F.col("included"), "included").otherwise("on_top")
    out = offers.withColumn("vat_kind", kind)
    due = F.when(F.col("vat_kind") == "exempt", F.lit(0).cast("bigint")).when(F.col("vat_kind") == "included", inside).when(F.col("vat_kind") == "on_top", on_top)
    out = out.withColumn("vat_due", due)
    return out.withColumn("status", F.when(F.col("vat_kind") == "exempt", "passed").otherwise(verdict(F.col("vat_due").isNotNull() & F.col("vat").isNotNull(), F.abs(F.col("vat_due") - F.col("vat")) <= 1)))


def stage_rollup(items: DataFrame) -> DataFrame:
    """Price of each stage and of the package as a rollup; level 0 is a stage, 1 the package."""
    sums = items.rollup("pk", "stage").agg(F.grouping_id().alias("g"), F.count("*").alias("n_rows"), F.sum("total").alias("price"))
    return sums.where("g in (0, 1)").select("pk", "stage", F.col("g").cast("int").alias("level"), "n_rows", "price")


def min_over_offers(matched: DataFrame, expected: DataFrame) -> DataFrame:
    """Least price over matched offers; with fewer than expected it is never called wrong. ``expected``: pk, n_expected, declared."""
    least = matched.where("price is not null").groupBy("pk").agg(F.min("price").alias("least"), F.countDistinct("source").alias("n_matched"))
    both = expected.join(least, "pk", "left").withColumn("n_matched", F.coalesce("n_matched", F.lit(0)))
    complete = F.col("n_matched") >= F.col("n_expected")
    return both.withColumn("status", verdict(complete & F.col("declared").isNotNull(), F.col("least") == F.col("declared")))


def price_matrix(prices: DataFrame, sources: list, value: str = "price") -> DataFrame:
    """Items by sources: the first price of each source, for a stated list of sources."""
    first = prices.groupBy("pk", "source").agg(F.min_by(value, "seq").alias(value))
    return first.groupBy("pk").pivot("source", sources).agg(F.first(value))


def drop_proven_aggregate(items: DataFrame, offers: DataFrame) -> DataFrame:
    """Takes away the first row whose total is the declared total and the sum of the two or more other priced rows."""
    offer = W.partitionBy("pk", "offer")
    seen = items.join(offers.select("pk", "offer", "offer_total"), ["pk", "offer"], "left")
    seen = seen.withColumn("_n", F.count("total").over(offer)).withColumn("_rest", F.sum("total").over(offer) - F.col("total"))
    proven = F.coalesce((F.col("_n") >= 3) & (F.col("total") == F.col("offer_total")) & (F.col("total") == F.col("_rest")), F.lit(False))
    seen = seen.withColumn("_hit", proven).withColumn("_first", F.min(F.when(F.col("_hit"), F.col("seq"))).over(offer))
    return seen.where(~(F.col("_hit") & (F.col("seq") == F.col("_first")))).select(*items.columns)


def drop_unpriced_rows(items: DataFrame) -> DataFrame:
    """Takes away rows without a price and a total where an offer has two or more that have one."""
    priced = F.col("price").isNotNull() | F.col("total").isNotNull()
    seen = items.withColumn("_n", F.count_if(priced).over(W.partitionBy("pk", "offer")))
    return seen.where(priced | (F.col("_n") < 2)).drop("_n")
