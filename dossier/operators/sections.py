"""Blocks of a document in order: clauses, sections, first matches and chunks. All windows are by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def split_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines of a text that aren't blank, with white space cleaned: key, ord, text."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("ord", "text"))
    clean = F.trim(F.regexp_replace("text", r"[ \t\r\f\x0B]+", " "))
    return lines.select(key, "ord", clean.alias("text")).where("text != ''")


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """List items, paragraphs and headings of HTML in order: key, ord, kind, text."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<(?:li|p|h[1-6])>.*?</(?:li|p|h[1-6])>"), F.lit(0))
    blocks = pages.select(key, F.posexplode(found).alias("ord", "raw"))
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", r"<[^>]*>", " "), r"\s+", " "))
    return blocks.select(key, "ord", F.lower(F.regexp_extract("raw", r"^<(\w+)", 1)).alias("kind"), text.alias("text")).where("text != ''")


def segment_clauses(blocks: DataFrame, starts: Column, key: str = "doc_id") -> DataFrame:
    """Clauses: a block that starts one and all that follow up to the next start. Blocks before the first start are clause 0."""
    number = F.sum(starts.cast("int")).over(W.partitionBy(key).orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    seen = blocks.withColumn("clause", number)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda b: b["text"])
    return seen.groupBy(key, "clause").agg(F.count("*").alias("n_blocks"), F.array_join(texts, " ").alias("text"))


def sections(blocks: DataFrame, heading: Column, most_chars: int, key: str = "doc_id") -> DataFrame:
    """Blocks under each heading up to the next, cut at ``most_chars``: key, heading, n_blocks, text."""
    order = W.partitionBy(key).orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    seen = blocks.withColumn("_h", heading).withColumn("_at", F.max(F.when(F.col("_h"), F.col("ord"))).over(order)).withColumn("heading", F.last(F.when(F.col("_h"), F.col("text")), True).over(order))
    body = seen.where("_at is not null and not _h")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda b: b["text"])
    out = body.groupBy(key, "_at", "heading").agg(F.count("*").alias("n_blocks"), F.substring(F.array_join(texts, "\n"), 1, most_chars).alias("text"))
    return out.withColumnRenamed("_at", "ord")


def table_context(blocks: DataFrame, is_table: Column, n: int = 2, key: str = "doc_id") -> DataFrame:
    """For each table block the n blocks before and after it."""
    order = W.partitionBy(key).orderBy("ord")
    seen = blocks.withColumn("before", F.collect_list("text").over(order.rowsBetween(-n, -1))).withColumn("after", F.collect_list("text").over(order.rowsBetween(1, n)))
    return seen.where(is_table).select(key, "ord", F.array_join("before", "\n").alias("before"), F.array_join("after", "\n").alias("after"))


def first_match(blocks: DataFrame, marker: str, key: str = "doc_id") -> DataFrame:
    """The first block with a marker, and its value: after the colon, or the next block where it ends with one."""
    seen = blocks.withColumn("_next", F.lead("text").over(W.partitionBy(key).orderBy("ord"))).where(F.contains(F.lower("text"), F.lit(marker)))
    first = seen.groupBy(key).agg(F.min_by(F.struct("ord", "text", "_next"), "ord").alias("b")).select(key, "b.*")
    after = F.trim(F.regexp_extract("text", r"(?s)^[^:]*:(.*)$", 1))
    value = F.when(F.endswith("text", F.lit(":")), F.col("_next")).when(after != "", after).otherwise(F.col("text"))
    return first.select(key, "ord", "text", value.alias("value"))


def code_blocks(blocks: DataFrame, marker: Column, is_code: Column, reach: int = 11, key: str = "doc_id") -> DataFrame:
    """Lines with a code at most ``reach`` blocks after the last marker: key, marker_ord, n_codes, last_code_ord."""
    order = W.partitionBy(key).orderBy("ord")
    seen = blocks.withColumn("_n", F.row_number().over(order)).withColumn("_m", F.last(F.when(marker, F.col("_n")), True).over(order.rowsBetween(W.unboundedPreceding, -1)))
    near = seen.where(is_code & (F.col("_n") - F.col("_m") <= reach))
    return near.groupBy(key, F.col("_m").alias("marker_place")).agg(F.count("*").alias("n_codes"), F.max("ord").alias("last_ord"))


def best_window(blocks: DataFrame, weights: list[tuple[str, float]], size: int = 4, most_chars: int = 1200, key: str = "doc_id") -> DataFrame:
    """Of all windows of ``size`` blocks the one with the highest sum of marker weights, the first of equal ones."""
    own = W.partitionBy(key).orderBy("ord").rowsBetween(0, size - 1)
    text = F.array_join(F.collect_list("text").over(own), "\n")
    seen = blocks.withColumn("_w", text)
    score = sum((F.when(F.contains(F.lower("_w"), F.lit(m)), F.lit(float(x))).otherwise(F.lit(0.0)) for m, x in weights), F.lit(0.0))
    best = F.max(F.struct(F.col("score"), F.negative("ord").alias("o"), F.col("_w")))
    top = seen.withColumn("score", score).where("score > 0").groupBy(key).agg(best.alias("b"))
    return top.select(key, F.negative("b.o").alias("ord"), F.col("b.score").alias("score"), F.substring("b._w", 1, most_chars).alias("text"))


def capped(blocks: DataFrame, budget: int, key: str = "doc_id") -> DataFrame:
    """The blocks of a document that fit into a budget of characters, in order."""
    run = F.sum(F.length("text")).over(W.partitionBy(key).orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    return blocks.withColumn("_c", run).where(F.col("_c") <= budget).drop("_c")


def pack_chunks(blocks: DataFrame, budget: int = 30_000, key: str = "doc_id") -> DataFrame:
    """Blocks put into chunks one after the other, a new chunk where the budget would be passed: key, ord, chunk.

    A block that is larger than the budget has a chunk of its own, with empty ones before it. Greedy packing is sequential
    in a document, so a fold goes over the lengths of its blocks and keeps where chunks begin; texts never meet, and the
    places are cut at those beginnings.
    """
    lengths = F.array_sort(F.collect_list(F.struct("ord", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))))
    docs = blocks.select(key, "ord", "text").groupBy(key).agg(lengths.alias("blocks"))

    def step(state: Column, block: Column) -> Column:
        passed = (state["used"] > 0) & (state["used"] + block["n"] > budget)
        return F.struct(
            F.when(passed, block["n"]).otherwise(state["used"] + block["n"]).alias("used"), (state["at"] + 1).alias("at"),
            F.when(passed, F.concat(state["begins"], F.array(state["at"]))).otherwise(state["begins"]).alias("begins"),
        )

    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("at"), F.array(F.lit(0)).alias("begins"))
    begun = docs.select(key, F.transform("blocks", lambda x: x["ord"]).alias("ords"), F.aggregate("blocks", start, step, lambda s: s["begins"]).alias("begins"))
    ends = F.transform("begins", lambda x, i: F.coalesce(F.get("begins", i + 1), F.size("ords")))
    cut = F.zip_with("begins", ends, lambda x, end: F.slice("ords", x + 1, end - x))
    return begun.select(key, F.posexplode(cut).alias("chunk", "_ords")).select(key, F.explode("_ords").alias("ord"), "chunk")


def chunk_text(docs: DataFrame, size: int = 300, overlap: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of ``size`` characters that overlap: key, chunk, text. An empty text has none."""
    # one pass over the text: a piece is looked at ahead, then its step is passed; after the first, more than the overlap has to be left
    piece = rf"(?s)(?:\A|(?=.{{{overlap + 1}}}))(?=(.{{1,{size}}})).{{1,{size - overlap}}}"
    return docs.where(F.length(text) > 0).select(key, F.posexplode(F.regexp_extract_all(text, F.lit(piece), F.lit(1))).alias("chunk", "text"))


