"""Merging of extractions: filling gaps, chunks, evidence, and recovery of malformed rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def fill_gaps(primary: DataFrame, secondary: DataFrame, keys: list[str], fields: list[str], append: bool = True) -> DataFrame:
    """Rows of the first extraction, blanks filled from the row of equal keys of the second; others may be appended."""
    other = secondary.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    filled = primary.join(other, keys, "left").select(*keys, *[F.when(~blank(F.col(f)), F.col(f)).otherwise(F.col(f"_{f}")).alias(f) for f in fields], F.lit("primary").alias("origin"))
    if not append:
        return filled
    rest = secondary.join(primary.select(*keys), keys, "left_anti").select(*keys, *fields, F.lit("secondary").alias("origin"))
    return filled.unionByName(rest)


def fill_gaps_cascade(primary: DataFrame, secondary: DataFrame, ways: list[list[str]], key: str, order: str, fields: list[str]) -> DataFrame:
    """Rows of the first extraction (key, order, fields), blanks filled from the row of the second that stands for the same.

    ``ways`` are lists of columns, tried in turn (row number, then name with quantity and unit): a pair counts if all are
    filled and equal and no other row of either side has them. What is left then is paired by its place. Rows that no way
    pairs are appended. how: number of the way, 0 for the place, null without a partner. key and order name one row of a side.
    """
    columns = list(dict.fromkeys([*fields, *(c for way in ways for c in way)]))
    side = lambda df, first: df.select(key, F.lit(first).alias("_first"), F.col(order).alias("_at"), *columns)
    rows = side(primary, True).unionByName(side(secondary, False))
    own = F.struct("_at", *fields)
    rows = rows.select("*", F.lit(None).cast(rows.select(own.alias("o")).schema["o"].dataType).alias("_with"), F.lit(None).cast("int").alias("how"))
    # both sides lie in one table, and the rows of a key that may stand for each other in one window: no pass is joined back
    for number, way in enumerate(ways, 1):
        asks = reduce(lambda x, y: x & y, [F.col("how").isNull(), F.col(key).isNotNull(), *[~blank(F.col(c)) for c in way]])
        rows = _paired(rows.withColumn("_asks", asks), [key, *way], own, number)
    place = F.row_number().over(W.partitionBy(key, "_first", F.col("how").isNull()).orderBy("_at"))
    rows = rows.withColumn("_place", place).withColumn("_asks", F.col("how").isNull() & F.col(key).isNotNull())
    rows = _paired(rows, [key, "_place"], own, 0).where("_first or how is null")
    filled = [F.when(~blank(F.col(f)) | ~F.col("_first"), F.col(f)).otherwise(F.col(f"_with.{f}")).alias(f) for f in fields]
    return rows.select(key, F.when(F.col("_first"), "primary").otherwise("secondary").alias("origin"), F.col("_at").alias(order), *filled, "how")


def _paired(rows: DataFrame, group: list[str], own: Column, number: int) -> DataFrame:
    """``rows`` with _with (the fields of the partner) and how (the number) where one row of each side asks in a group."""
    w, asks, first = W.partitionBy(*group), F.col("_asks"), F.col("_first")
    n = lambda c: F.count_if(asks & c).over(w)
    seen = rows.select("*", n(first).alias("_l"), n(~first).alias("_r"), *[F.max(F.when(asks & c, own)).over(w).alias(a) for a, c in (("_a", first), ("_b", ~first))])
    hit = asks & (F.col("_l") == 1) & (F.col("_r") == 1)
    partner = F.when(first, F.col("_b")).otherwise(F.col("_a"))
    return seen.withColumn("_with", F.when(hit, partner).otherwise(F.col("_with"))).withColumn("how", F.when(hit, F.lit(number)).otherwise(F.col("how"))).select(rows.columns)


def merge_chunks(parts: DataFrame, key: str, order: str, scalars: list[str], lists: list[str]) -> DataFrame:
    """Partial results of one document: the first scalar that isn't null, and distinct values of the lists, sorted."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in scalars]
    every = [F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), ",").alias(c) for c in lists]
    return parts.groupBy(key).agg(*first, *every)


def validate_evidence(findings: DataFrame, blocks: DataFrame, most_chars: int = 500) -> DataFrame:
    """Findings whose cited block exists and has the quote's place: pk, finding, doc_id, ord, start, n. The quote is restored."""
    both = findings.join(blocks.select("doc_id", "ord", "text"), ["doc_id", "ord"], "left")
    ok = F.col("text").isNotNull() & (F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.length("text"))
    quote = F.when(ok, F.substring(F.col("text"), F.col("start") + 1, F.least(F.col("n"), F.lit(most_chars))))
    return both.select("doc_id", "ord", "start", "n", F.coalesce(ok, F.lit(False)).alias("valid"), quote.alias("quote"))


def recover_json(rows: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """Typed columns of a JSON object; a leaf that doesn't fit its type is dropped and named in issues.

    Status: validated, recovered (some leaves dropped), partial (fields missing), failed (no JSON object).
    """
    raw = F.from_json(column, ", ".join(f"`{f}` string" for f in fields), {"mode": "PERMISSIVE"})
    seen = rows.withColumn("_j", raw).withColumn("_ok", F.coalesce(F.startswith(F.trim(column), F.lit("{")) & F.endswith(F.trim(column), F.lit("}")), F.lit(False)))
    typed = {f: F.col(f"_j.{f}").try_cast(t) for f, t in fields.items()}
    bad = F.array_compact(F.array(*[F.when(F.col(f"_j.{f}").isNotNull() & c.isNull(), F.lit(f)) for f, c in typed.items()]))
    lacking = F.array_compact(F.array(*[F.when(F.col("_ok") & F.col(f"_j.{f}").isNull(), F.lit(f)) for f in fields]))
    status = F.when(~F.col("_ok"), "failed").when(F.size(bad) > 0, "recovered").when(F.size(lacking) > 0, "partial").otherwise("validated")
    return seen.select(*rows.columns, *[F.when(F.col("_ok"), c).alias(f) for f, c in typed.items()], F.array_join(bad, ",").alias("issues"), status.alias("recovery"))


