"""Operator 2: token counts, kept up to date by signed changes.

A rollup is a folder of batches. Committing batch k sums its signed changes by source, language and tokenizer version
and writes the sums to ``batch=k``, replacing whatever an earlier attempt left there: a batch that is sent twice, or
again after a crash, counts once. The totals are the sum over all batches, so nothing old is read to commit. Compacting
sums the batches up to an id into one, which marks itself: a batch of that id or a lower one is in it already, and
counts no second time when it is sent again.

Change rows: op ("insert", "delete" or "revise"), source, lang, tokenizer_version, n_tokens and, for "revise",
old_n_tokens. An insert adds a document and its tokens, a delete takes both away, a revision adds the difference.

Nulls: a null source, language or version is a key of its own; a null count is 0; a row with a null or unknown op
changes nothing. Repeated rows are separate changes. An empty batch commits no sums. Sums don't depend on an order, so
there are no ties. Tokens are counted over whole texts, however long. Further columns are not looked at.
A hot source costs no more than any other, as sums are formed before the shuffle.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer_version")
#: Tokenizer versions by the pattern of their tokens: words, then words split from signs.
PATTERNS = {"words-1": r"[^\x20\x09-\x0D]+", "words-2": r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[!-/:-@\[-`{-~]"}
SUMS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, compacted boolean"


def n_tokens(text: Column, version: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(PATTERNS[version])), F.lit(0)).cast("long")


class TokenRollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._floor = spark, path, None

    def commit(self, batch: int, changes: DataFrame) -> None:
        if batch <= self._compacted():
            return
        new, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_n_tokens", F.lit(0))
        docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
        tokens = F.when(F.col("op") == "insert", new).when(F.col("op") == "delete", -new).when(F.col("op") == "revise", new - old).otherwise(0)
        sums = changes.groupBy(*KEYS).agg(F.sum(docs).alias("n_docs"), F.sum(tokens).alias("n_tokens"))
        self._write(batch, sums.where("n_docs != 0 or n_tokens != 0").withColumn("compacted", F.lit(False)))

    def _write(self, batch: int, sums: DataFrame) -> None:
        sums.write.mode("overwrite").parquet(f"{self.path}/batch={int(batch)}")

    def _rows(self) -> DataFrame:
        """The sums of all batches; none before the first commit."""
        try:
            return self.spark.read.schema(SUMS + ", batch int").option("basePath", self.path).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SUMS + ", batch int")

    def _compacted(self) -> int | float:
        """The id up to which batches are summed into one, below all ids if none are."""
        if self._floor is None:
            found = self._rows().where("compacted").agg(F.max("batch")).first()[0]
            self._floor = float("-inf") if found is None else found
        return self._floor

    def totals(self) -> DataFrame:
        """Current sums by key; keys whose documents are all gone are left out."""
        sums = self._rows().groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs != 0 or n_tokens != 0")

    def compact(self, batch: int) -> TokenRollup:
        """A new rollup beside this one whose first batch holds the sums of all up to ``batch``, followed by the later ones."""
        out = TokenRollup(self.spark, f"{self.path}-upto-{int(batch)}")
        rows = self._rows()
        sums = rows.where(F.col("batch") <= batch).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        mark = self.spark.range(1).select(*(F.lit(None).cast("string").alias(k) for k in KEYS), F.lit(0).cast("long").alias("n_docs"), F.lit(0).cast("long").alias("n_tokens"))
        out._write(batch, sums.union(mark).withColumn("compacted", F.lit(True)))
        for later in [r.batch for r in rows.where(F.col("batch") > batch).select("batch").distinct().collect()]:
            out._write(later, rows.where(F.col("batch") == later).drop("batch"))
        return out


def inserts(docs: DataFrame, version: str) -> DataFrame:
    return docs.select(F.lit("insert").alias("op"), "source", "lang", F.lit(version).alias("tokenizer_version"), n_tokens(F.col("text"), version).alias("n_tokens"), F.lit(None).cast("long").alias("old_n_tokens"))


def deletes(docs: DataFrame, version: str) -> DataFrame:
    return inserts(docs, version).withColumn("op", F.lit("delete"))


def revisions(docs: DataFrame, new_text: Column, version: str) -> DataFrame:
    """Changes for documents whose text becomes ``new_text``."""
    own = inserts(docs, version).columns
    old = n_tokens(F.col("text"), version)
    return docs.select("source", "lang", F.lit("revise").alias("op"), F.lit(version).alias("tokenizer_version"), n_tokens(new_text, version).alias("n_tokens"), old.alias("old_n_tokens")).select(*own)
