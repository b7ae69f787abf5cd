"""Cell grids to logical rows. A cell: doc_id, table_id, r, c, row_span, col_span, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import norm_text

TABLE = ("doc_id", "table_id")
# Labels of total rows.
TOTALS = ["итого", "всего", "total", "sum"]


def dense_cells(cells: DataFrame) -> DataFrame:
    """Each covered place of the grid with the text of its cell."""
    rows = F.explode(F.sequence(F.col("r"), F.col("r") + F.col("row_span") - 1)).alias("r2")
    cols = F.explode(F.sequence(F.col("c"), F.col("c") + F.col("col_span") - 1)).alias("c2")
    wide = cells.select(*TABLE, "r", "c", "col_span", "text", rows).select(*TABLE, F.col("r").alias("origin_r"), F.col("c").alias("origin_c"), "text", "r2", cols)
    return wide.select(*TABLE, F.col("r2").alias("r"), F.col("c2").alias("c"), "origin_r", "origin_c", "text")


def origin_cells(dense: DataFrame) -> DataFrame:
    """Back to cells with spans."""
    box = dense.groupBy(*TABLE, "origin_r", "origin_c").agg(F.min("r").alias("r"), F.min("c").alias("c"), F.max("r").alias("r9"), F.max("c").alias("c9"), F.first("text").alias("text"))
    return box.select(*TABLE, "r", "c", (F.col("r9") - F.col("r") + 1).alias("row_span"), (F.col("c9") - F.col("c") + 1).alias("col_span"), "text")


def table_kind(cells: DataFrame, suppliers: str = "постав", chars: str = "характ") -> DataFrame:
    """key_value (two columns), supplier_matrix, characteristics or item_list, by shape and header markers."""
    low = F.lower("text")
    sums = cells.groupBy(*TABLE).agg((F.max("c") + 1).alias("n_cols"), (F.max("r") + 1).alias("n_rows"), F.count_if((F.col("r") < 3) & F.contains(low, F.lit(suppliers))).alias("n_s"), F.count_if((F.col("r") < 3) & F.contains(low, F.lit(chars))).alias("n_c"))
    kind = F.when(F.col("n_cols") <= 2, "key_value").when(F.col("n_s") >= 2, "supplier_matrix").when(F.col("n_c") >= 1, "characteristics").otherwise("item_list")
    return sums.select(*TABLE, "n_rows", "n_cols", kind.alias("kind"))


def infer_headers(rows: DataFrame, is_data: Column, continues: Column, most: int = 8) -> DataFrame:
    """Leading rows before the first data-like row that doesn't continue a header; at most ``most``. Rows: table, r."""
    stop = F.min(F.when(is_data & ~continues, F.col("r"))).over(W.partitionBy(*TABLE))
    return rows.withColumn("_stop", stop).withColumn("is_header", (F.col("r") < F.coalesce("_stop", F.lit(0))) & (F.col("r") < most)).drop("_stop")


def header_paths(dense: DataFrame, header_rows: DataFrame) -> DataFrame:
    """Header texts of each column from top to bottom without repeats of the one above: table, c, path."""
    head = dense.join(header_rows.where("is_header").select(*TABLE, "r"), [*TABLE, "r"])
    above = F.lag("text").over(W.partitionBy(*TABLE, "c").orderBy("r"))
    kept = head.withColumn("_a", above).where("_a is null or _a != text")
    path = F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"])
    return kept.groupBy(*TABLE, "c").agg(F.array_join(path, " / ").alias("path"))


def dedupe_adjacent(cells: DataFrame) -> DataFrame:
    """Without cells that repeat the text of the one to their left (merged cells)."""
    left = F.lag("text").over(W.partitionBy(*TABLE, "r").orderBy("c"))
    return cells.withColumn("_l", left).where("_l is null or _l != text").drop("_l")


def attach_children(rows: DataFrame, is_item: Column, key: Column) -> DataFrame:
    """Rows below an item belong to it; an item whose key was there before belongs to the first row of that key."""
    order = W.partitionBy(*TABLE).orderBy("r")
    seen = rows.withColumn("_k", F.when(is_item, key))
    seen = seen.withColumn("_first", F.when(F.col("_k").isNotNull(), F.min("r").over(W.partitionBy(*TABLE, "_k"))))
    return seen.withColumn("parent_r", F.last("_first", True).over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_k", "_first")


def infer_numbers(rows: DataFrame) -> DataFrame:
    """Rows without a number get the place they have among such rows."""
    order = W.partitionBy(*TABLE).orderBy("r").rowsBetween(W.unboundedPreceding, 0)
    n = F.sum(F.col("number").isNull().cast("int")).over(order)
    return rows.withColumn("number", F.coalesce("number", F.concat(F.lit("#"), n.cast("string"))))


def classify_rows(rows: DataFrame) -> DataFrame:
    """total, numbering (1, 2, 3 …), empty or item, for rows with an array ``texts`` in column order."""
    first = norm_text(F.get("texts", F.lit(0)))
    total = first.rlike(f"^(?:{'|'.join(TOTALS)})")
    one = F.coalesce(F.trim(F.get("texts", F.lit(0))) == "1", F.lit(False))
    numbering = (F.size("texts") >= 2) & one & F.forall(F.transform("texts", lambda x, i: F.coalesce(F.trim(x) == (i + 1).cast("string"), F.lit(False))), lambda ok: ok)
    filled = F.exists("texts", lambda x: F.trim(x) != "")
    return rows.withColumn("row_type", F.when(~F.coalesce(filled, F.lit(False)), "empty").when(total, "total").when(numbering, "numbering").otherwise("item"))


def key_values(cells: DataFrame) -> DataFrame:
    """First cell of a row as key, the others joined as value."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("c", "text"))), lambda x: x["text"])
    rows = cells.groupBy(*TABLE, "r").agg(texts.alias("t"))
    return rows.where(F.size("t") >= 2).select(*TABLE, "r", F.get("t", F.lit(0)).alias("key"), F.array_join(F.slice("t", F.lit(2), F.size("t")), " ").alias("value"))


def column_rows(rows: DataFrame, is_data: Column, continues: Column, keywords: dict[str, str], most: int = 8) -> DataFrame:
    """Rows (table, r, an array ``cells`` of c, row_span, col_span, text; each place once) with a column for each keyword: their cell,
    if any, in the first column whose header path has it.

    This is ``infer_headers``, ``header_paths`` and ``select_columns`` in windows by table over one pass of the rows, without
    a join: only the header, of ``most`` rows at most, is held together.
    """
    w = W.partitionBy(*TABLE)
    # the only window with an order comes first, so that its sort serves the others too
    seen = rows.withColumn("_n", F.row_number().over(w.orderBy("r")))
    seen = seen.withColumn("_stop", F.min(F.when(is_data & ~continues, F.col("r"))).over(w))
    is_header = (F.col("r") < F.coalesce("_stop", F.lit(0))) & (F.col("r") < most)
    seen = seen.withColumn("_heads", F.collect_list(F.when(is_header, F.struct("r", "cells"))).over(w))
    span = lambda start, n: F.sequence(start, start + n - 1)
    places = lambda h, x: F.flatten(F.transform(span(h["r"], x["row_span"]), lambda r: F.transform(span(x["c"], x["col_span"]), lambda c: F.struct(c.alias("c"), r.alias("r"), x["text"].alias("text")))))
    dense = F.flatten(F.flatten(F.transform("_heads", lambda h: F.transform(h["cells"], lambda x: places(h, x)))))
    # worked out in the first row of a table only; each step is used twice by the next one, so it is a column of its own
    seen = seen.withColumn("_dense", F.when(F.col("_n") == 1, F.sort_array(F.filter(dense, lambda x: F.exists("_heads", lambda h: h["r"] == x["r"])))))
    above = lambda i: F.get("_dense", i - 1)
    kept = F.filter("_dense", lambda x, i: (i == 0) | (above(i)["c"] != x["c"]) | above(i)["text"].isNull() | (above(i)["text"] != x["text"]))
    seen = seen.withColumn("_kept", kept)
    path = lambda c: F.lower(F.array_join(F.transform(F.filter("_kept", lambda y: y["c"] == c), lambda y: y["text"]), " / "))
    paths = F.transform(F.array_distinct(F.transform("_kept", lambda x: x["c"])), lambda c: F.struct(c.alias("c"), path(c).alias("path")))
    seen = seen.withColumn("_paths", paths)
    first = lambda k: F.get(F.filter("_paths", lambda p: F.contains(p["path"], F.lit(k))), F.lit(0))["c"]
    firsts = F.when(F.col("_n") == 1, F.struct(*[first(k).alias(name) for name, k in keywords.items()]))
    seen = seen.withColumn("_firsts", F.first(firsts, True).over(w))
    cell = lambda name: F.get(F.filter("cells", lambda x: x["c"] == F.col("_firsts")[name]), F.lit(0))
    return seen.select(*rows.columns, *[cell(name).alias(name) for name in keywords])


def select_columns(cells: DataFrame, paths: DataFrame, keywords: dict[str, str]) -> DataFrame:
    """Rows with one column for each keyword: the cell of the first column whose header path has it."""
    low = F.lower("path")
    wanted = paths.select(*TABLE, "c", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.contains(low, F.lit(k)).alias("hit")) for n, k in keywords.items()])).alias("w")).where("w.hit")
    first = wanted.groupBy(*TABLE, F.col("w.name").alias("name")).agg(F.min("c").alias("c"))
    return cells.join(first, [*TABLE, "c"]).groupBy(*TABLE, "r").pivot("name", list(keywords)).agg(F.first("text"))


def unpivot_suppliers(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """Supplier columns to rows: table, r, source, price, from columns with a known source. ``sources``: table, c, source, measure."""
    met = cells.join(sources, [*TABLE, "c"])
    return met.groupBy(*TABLE, "r", "source").pivot("measure", ["unit_price", "row_total"]).agg(F.first("text"))


def unpivot_rows(rows: DataFrame) -> DataFrame:
    """``unpivot_suppliers`` for rows (table, r, an array ``cells`` of c and text, each place once) that bring their table's
    ``sources`` (c, source, measure) as an array: nothing is joined or grouped."""
    known = F.filter("cells", lambda x: F.exists("sources", lambda y: y["c"] == x["c"]))
    met = rows.select(*TABLE, "r", known.alias("cells"), "sources")
    own = F.array_distinct(F.transform(F.filter("sources", lambda y: F.exists("cells", lambda x: x["c"] == y["c"])), lambda y: y["source"]))
    met = met.select(*TABLE, "r", "cells", "sources", F.explode(own).alias("source"))
    at = lambda m: F.get(F.filter("cells", lambda x: F.exists("sources", lambda y: (y["source"] == F.col("source")) & (y["measure"] == m) & (y["c"] == x["c"]))), F.lit(0))["text"]
    return met.select(*TABLE, "r", "source", at("unit_price").alias("unit_price"), at("row_total").alias("row_total"))


def nest_items(items: DataFrame, chars: DataFrame) -> DataFrame:
    """Items with their characteristics as one text; characteristics without an item are kept with a warning. Both: pk, seq."""
    line = F.concat_ws("=", "name", "value")
    own = chars.groupBy("pk", "seq").agg(F.array_join(F.array_sort(F.collect_list(line)), "; ").alias("chars"), F.count("*").alias("n_chars"))
    both = items.withColumn("_i", F.lit(True)).join(own, ["pk", "seq"], "full")
    return both.withColumn("warning", F.when(F.col("_i").isNull(), "no item")).withColumn("n_chars", F.coalesce("n_chars", F.lit(0))).drop("_i")


def apply_scopes(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """Texts of cells that span several rows, for every row that they cover (interval join by table)."""
    scopes = cells.where("row_span > 1").select(*TABLE, F.col("c").alias("scope_c"), F.col("text").alias("scope"), F.col("r").alias("_a"), (F.col("r") + F.col("row_span") - 1).alias("_b"))
    return rows.join(scopes, list(TABLE)).where(F.col("r").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def cells_around(cells: DataFrame, keyword: str, left: int, right: int) -> DataFrame:
    """Cells at most so far left or right of a cell with the keyword in the same row, each once."""
    hits = cells.where(F.contains(F.lower("text"), F.lit(keyword))).select(*TABLE, "r", F.col("c").alias("_h"))
    near = cells.join(hits, [*TABLE, "r"]).where(F.col("c").between(F.col("_h") - left, F.col("_h") + right))
    return near.drop("_h").dropDuplicates([*TABLE, "r", "c"])


def stage_children(rows: DataFrame) -> DataFrame:
    """Rows of a staged table (pk, number '2.1'): parent by the part before the first dot; leaves have no children."""
    parent = F.when(F.contains("number", F.lit(".")), F.split_part("number", F.lit("."), F.lit(1)))
    seen = rows.withColumn("parent", parent)
    n = seen.where("parent is not null").groupBy("pk", F.col("parent").alias("number")).agg(F.count("*").alias("n_children"))
    out = seen.join(n, ["pk", "number"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return out.withColumn("is_leaf", F.col("n_children") == 0)


def score_tables(cells: DataFrame, gate: float) -> DataFrame:
    """Complexity by size, width, empty cells and spans, at most 1; tables at the gate or above are sent to repair."""
    sums = cells.groupBy(*TABLE).agg(F.count("*").alias("n_cells"), (F.max("c") + 1).alias("n_cols"), F.count_if(F.trim("text") == "").alias("n_empty"), F.count_if((F.col("row_span") > 1) | (F.col("col_span") > 1)).alias("n_spans"))
    score = F.least(F.lit(1.0), F.when(F.col("n_cells") > 20, 0.25).otherwise(0.0) + F.when(F.col("n_cols") > 6, 0.25).otherwise(0.0) + F.when(F.col("n_empty") > 0, 0.25).otherwise(0.0) + F.when(F.col("n_spans") > 0, 0.25).otherwise(0.0))
    return sums.withColumn("score", score).withColumn("repair", F.col("score") >= gate)


def drop_noise_tables(tables: DataFrame, markers: list[str], least: int = 3) -> DataFrame:
    """Without tables (key, text) that have ``least`` signature markers or more."""
    low = F.lower("text")
    n = sum((F.contains(low, F.lit(m)).cast("int") for m in markers), F.lit(0))
    return tables.where(n < least)


def select_uncovered(tables: DataFrame, facts: DataFrame) -> DataFrame:
    """Tables (doc_id, table_id, n_warnings) that no extracted fact (doc_id, table_id) covers, or that carry warnings."""
    return tables.join(facts.select("doc_id", "table_id").distinct().withColumn("_f", F.lit(True)), ["doc_id", "table_id"], "left").where("_f is null or n_warnings > 0").drop("_f")


def rank_tables(tables: DataFrame, k: int, role: str, query: list[str]) -> DataFrame:
    """At most k tables of each document by score: role +100, shared query tokens up to 30, confidence and complexity."""
    shared = F.size(F.array_intersect("tokens", F.array(*[F.lit(q) for q in query])))
    score = F.when(F.col("role") == role, 100).otherwise(0) + F.least(shared * 10, F.lit(30))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), F.desc("complexity"), "table_id"))
    return tables.withColumn("score", score).withColumn("place", place).where(F.col("place") <= k)


def render_tables(rows: DataFrame, names: list[str]) -> DataFrame:
    """Each table as text: a line for each row of 'name: value' parts, blank values left out."""
    line = F.concat_ws("; ", *[F.when(F.trim(F.col(n).cast("string")) != "", F.concat_ws(": ", F.lit(n), F.col(n))) for n in names])
    lines = F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("l")))), lambda x: x["l"])
    return rows.groupBy(*TABLE).agg(F.array_join(lines, "\n").alias("text"))
