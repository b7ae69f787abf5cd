"""Finding the files of packages, their identity, reference lists, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SHORT_CODE

# Role of a file by a pattern over its lower-cased name, first match wins; and names of own reports.
ROLE_RULES = [
    ("nmck", "нмцк|обоснован|nmck"), ("contract", "контракт|договор|contract"), ("plan", "план|plan"), ("description", "описание|техническ|description"),
    ("offer", "предложение|кп|offer"), ("note", "записк|note"), ("request", "заявк|request"),
]
IGNORED = "report|отчет|findings"


def role_of(name: Column) -> Column:
    low = F.lower(name)
    return F.coalesce(*[F.when(low.rlike(p), F.lit(r)) for r, p in ROLE_RULES], F.lit("unknown"))


def discover_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path`` (a folder for each package): pk, file_name, role, extension, size; own reports are left out.

    Only names and sizes are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    out = files.select(F.element_at(parts, -2).alias("pk"), name.alias("file_name"), role_of(name).alias("role"), F.lower(F.element_at(F.split(name, r"\."), -1)).alias("extension"), F.col("length").alias("size"))
    return out.where(~F.lower("file_name").rlike(IGNORED))


def text_hash(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def package_ids(files: DataFrame, key: str = "pk", text: str = "text") -> DataFrame:
    """Identity of a package from the hashes of its files, whatever their order: key, package_id, n_files."""
    hashes = F.array_sort(F.collect_list("h"))
    return files.select(key, text_hash(F.col(text)).alias("h")).groupBy(key).agg(F.sha2(F.concat_ws("|", hashes), 256).alias("package_id"), F.count("*").alias("n_files"))


def snapshot_meta(pages: DataFrame, key: str, content: str, markers: list[str]) -> DataFrame:
    """Digest, size and whether all markers are there, for each page."""
    ok = F.lit(True)
    for m in markers:
        ok = ok & F.contains(content, F.lit(m))
    return pages.select(key, F.sha2(content, 256).alias("sha256"), F.octet_length(content).alias("size"), ok.alias("complete"))


def changed(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Keys of the new snapshot that the old one lacks or has with another digest."""
    return new.join(old.select(key, "sha256"), [key, "sha256"], "left_anti")


def load_reference_list(rows: DataFrame) -> DataFrame:
    """Rows (table_id, row_index, position, name, codes) to one row for each code; header and service rows are rejected."""
    good = rows.where(F.col("position").rlike(r"^\s*\d+\s*\.?\s*$") & (F.trim("name") != ""))
    code = F.explode(F.regexp_extract_all("codes", F.lit(rf"{SHORT_CODE}|\d{{2}}\.\d"), F.lit(0)))
    return good.select("table_id", "row_index", F.regexp_extract("position", r"(\d+)", 1).cast("int").alias("position"), F.trim("name").alias("name"), code.alias("code"))


def ref_profile(codes: DataFrame) -> DataFrame:
    """Rows, codes and codes for each row, by list."""
    rows = codes.groupBy("table_id", "row_index").agg(F.count("*").alias("n"))
    return rows.groupBy("table_id").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_codes"), F.max("n").alias("most"))


def write_ref_codes(codes: DataFrame, path: str) -> None:
    """Partitioned by the first segment, so that a look-up reads one folder."""
    out = codes.withColumn("code2", F.substring("code", 1, 2))
    out.repartition("code2").sortWithinPartitions("code").write.mode("overwrite").partitionBy("code2").parquet(path)


def read_json_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)


def write_findings(df: DataFrame, path: str, kind: str = "json") -> None:
    df.write.mode("overwrite").format(kind).save(path)
