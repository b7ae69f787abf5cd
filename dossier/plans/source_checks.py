"""Sources, findings, streaming and run metrics over pages, documents, part, events, orders and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import findings as fd
from ..operators import prices as price_op
from ..operators import rules
from ..sources import packages as src
from ..sources.shared import shared_path, written
from ..streaming import jobs
from ..streaming import packages as arrivals
from .price_checks import _status
from .registry import ITEMS, PACKAGES, PRICES, items, packages, prices, query, table


@query("""SELECT conv_id, sha256(array_to_string(list_sort(list(sha256(coalesce(text, '')))), '|')) AS package_id, count(*) AS n_files FROM conversations GROUP BY conv_id""")
def package_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.package_ids(table(spark, sf_dir, "conversations"), "conv_id")


@query("""SELECT page_id, sha256(html) AS sha256, strlen(html)::INTEGER AS size, contains(html, '<article>') AND contains(html, '</nav>') AS complete FROM pages""")
def snapshot_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.snapshot_meta(table(spark, sf_dir, "pages"), "page_id", "html", ["<article>", "</nav>"])


@query("""SELECT page_id, sha256(html) AS sha256, strlen(html)::INTEGER AS size, contains(html, '<article>') AS complete FROM pages WHERE page_id % 3 = 0 OR (page_id % 7 = 0 AND contains(html, 'ad 7'))""")
def changed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old snapshot lacks each third page and has other text for some."""
    pages = table(spark, sf_dir, "pages")
    old = pages.where("page_id % 3 != 0").withColumn("html", F.when(F.col("page_id") % 7 == 0, F.replace("html", F.lit("ad 7"), F.lit("ad"))).otherwise(F.col("html")))
    meta = lambda df: src.snapshot_meta(df, "page_id", "html", ["<article>"])
    return src.changed(meta(pages), meta(old), "page_id")


_REF = """rows AS (SELECT p_type AS table_id, p_partkey AS row_index, CASE p_size % 5 WHEN 0 THEN 'No' ELSE ' ' || p_partkey || '. ' END AS position, CASE p_size % 7 WHEN 0 THEN ' ' ELSE p_name END AS name, 'see ' || lpad(p_size::VARCHAR, 2, '0') || '.' || lpad((p_partkey % 100)::VARCHAR, 2, '0') || ', ' || lpad(p_size::VARCHAR, 2, '0') || '.1; ' || CASE WHEN p_size > 30 THEN '31.01.12.190' ELSE '' END AS codes FROM part),
good AS (SELECT * FROM rows WHERE regexp_matches(position, '^\\s*\\d+\\s*\\.?\\s*$') AND trim(name) <> ''),
codes AS (SELECT table_id, row_index, regexp_extract(position, '(\\d+)', 1)::INTEGER AS position, trim(name) AS name, unnest(regexp_extract_all(codes, '\\d{2}\\.\\d{2}(?:\\.\\d{2}(?:\\.\\d{3})?)?|\\d{2}\\.\\d')) AS code FROM good)"""


def _ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    size, key = F.col("p_size"), F.col("p_partkey")
    codes = F.concat(F.lit("see "), two(size), F.lit("."), two(key % 100), F.lit(", "), two(size), F.lit(".1; "), F.when(size > 30, "31.01.12.190").otherwise(""))
    position = F.when(size % 5 == 0, "No").otherwise(F.concat(F.lit(" "), key.cast("string"), F.lit(". ")))
    rows = p.select(F.col("p_type").alias("table_id"), key.alias("row_index"), position.alias("position"), F.when(size % 7 == 0, " ").otherwise(F.col("p_name")).alias("name"), codes.alias("codes"))
    return src.load_reference_list(rows)


@query(f"WITH {_REF} SELECT * FROM codes")
def reference_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ref(spark, sf_dir)


@query(f"WITH {_REF} SELECT table_id, count(*) AS n_rows, sum(n)::BIGINT AS n_codes, max(n) AS most FROM (SELECT table_id, row_index, count(*) AS n FROM codes GROUP BY ALL) GROUP BY table_id")
def ref_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.ref_profile(_ref(spark, sf_dir))


@query(f"WITH {_REF} SELECT code, count(*) AS n FROM codes WHERE code LIKE '31%' GROUP BY code")
def reference_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by first segment and read back with a filter that one folder answers."""
    path = shared_path(spark, "ref-codes")
    src.write_ref_codes(_ref(spark, sf_dir), path)
    return spark.read.parquet(path).where("code2 = 31").groupBy("code").agg(F.count("*").alias("n"))


_EVENTS = """e AS (SELECT user_id AS pk, event_id AS seq, event_type AS rule, (event_id % 3)::VARCHAR AS documents, CASE event_id % 4 WHEN 0 THEN 'external' WHEN 1 THEN 'deterministic' ELSE 'llm' END AS source, CASE WHEN event_id % 5 < 2 THEN round(value)::BIGINT END AS actual, CASE event_id % 6 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' WHEN 2 THEN 'warning' WHEN 3 THEN 'manual_review' WHEN 4 THEN 'skipped' ELSE 'not_applicable' END AS status FROM events)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    names = F.array(*[F.lit(s) for s in ("passed", "failed", "warning", "manual_review", "skipped", "not_applicable")])
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("pk"), i.alias("seq"), F.col("event_type").alias("rule"), (i % 3).cast("string").alias("documents"), F.when(i % 4 == 0, "external").when(i % 4 == 1, "deterministic").otherwise("llm").alias("source"),
        F.when(i % 5 < 2, F.round("value").cast("bigint")).alias("actual"), F.get(names, (i % 6).cast("int")).alias("status"),
    )


@query(f"""WITH {_EVENTS}, r AS (SELECT *, CASE source WHEN 'external' THEN 0 WHEN 'deterministic' THEN 1 ELSE 2 END AS r FROM e), b AS (SELECT *, min(r) OVER (PARTITION BY pk, rule, documents) AS b FROM r)
SELECT pk, seq, rule, documents, source, actual, status FROM b WHERE actual IS NOT NULL OR r = b QUALIFY row_number() OVER (PARTITION BY pk, rule, documents, actual ORDER BY r, seq) = 1""")
def merge_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _events(spark, sf_dir)
    return fd.merge_findings(*[every.where(F.col("source") == s) for s in fd.AUTHORITY])


@query(f"""WITH {_EVENTS} SELECT pk, {", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in fd.STATUSES)}, count(*) AS n_total FROM e GROUP BY pk""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.status_counts(_events(spark, sf_dir))


_RANK = "CASE status " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(fd.STATUSES)) + " END"


@query(f"WITH {_EVENTS} SELECT pk, rule, max_by(status, {_RANK}) AS worst FROM e GROUP BY ALL")
def worst_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.worst_status(_events(spark, sf_dir), "pk", "rule")


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'license') OR contains(lower(text), '@') THEN 'manual_review' ELSE 'failed' END AS status FROM documents WHERE NOT (contains(lower(text), '!!') OR contains(lower(text), ' | '))""")
def filter_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("failed").alias("status"))
    return fd.filter_findings(rows, ["!!", " | "], ["license", "@"]).select("doc_id", "status")


@query(f"""WITH {_EVENTS}, o AS (SELECT *, {_RANK} * -1 AS p FROM e), u AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY pk, rule ORDER BY p, seq) = 1)
SELECT pk, rule, status, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY p, seq) AS place FROM u) WHERE place <= 3""")
def top_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    return fd.top_warnings(rows, 3, ["pk"], F.negative(fd.rank(fd.STATUSES, F.col("status"))), "rule").select("pk", "rule", "status", "place")


@query(f"""WITH {_EVENTS}, b AS (SELECT pk, seq, status FROM e), r AS (SELECT pk, seq, 'passed' AS status FROM e WHERE seq % 10 = 3) SELECT b.pk, b.seq, coalesce(r.status, b.status) AS status FROM b LEFT JOIN r ON r.pk = b.pk AND r.seq = b.seq""")
def override_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _events(spark, sf_dir).select("pk", "seq", "status")
    return fd.override_results(base, base.where("seq % 10 = 3").withColumn("status", F.lit("passed")), ["pk", "seq"], ["status"])


_ALL = f"""{ITEMS}, {PACKAGES}, {PRICES},
v AS (SELECT pk::VARCHAR AS pk, 'price.variation' AS check_id, {_status("cv IS NOT NULL", "cv < 33")} AS status, NULL AS expected, cv::VARCHAR AS actual FROM (SELECT pk, round(CASE WHEN count(*) >= 2 AND avg(price) <> 0 THEN stddev_samp(price) / avg(price) * 100 END, 4) AS cv FROM prices GROUP BY pk)),
a AS (SELECT pk::VARCHAR, 'amount.sum', {_status("s IS NOT NULL", "s = amount")}, amount::VARCHAR, s::VARCHAR FROM packages LEFT JOIN (SELECT pk, sum(total)::BIGINT AS s FROM items GROUP BY pk) USING (pk)),
t AS (SELECT pk::VARCHAR, 'extra.requirements', CASE WHEN status = 'P' THEN 'manual_review' WHEN (status = 'F') = (amount > 20000000) THEN 'passed' ELSE 'failed' END, NULL, amount::VARCHAR FROM packages),
found AS (SELECT pk, check_id, status, expected FROM v UNION ALL SELECT pk, 'amount.sum', column2, column3 FROM (SELECT * FROM a) a2(pk, c1, column2, column3, column4) UNION ALL SELECT pk, 'extra.requirements', column2, column3 FROM (SELECT * FROM t) t2(pk, c1, column2, column3, column4))"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = packages(spark, sf_dir), items(spark, sf_dir)
    variation = price_op.price_variation(prices(spark, sf_dir))
    rows = price_op.reconcile_rows(lines.withColumn("price", F.lit(None).cast("bigint")), orders.select("pk", "amount"))
    extra = rules.threshold_required(orders.select("pk", "amount", F.when(F.col("status") != "P", F.col("status") == "F").alias("present")))
    return fd.run_all(
        fd.findings(variation, "price.variation", actual=F.col("cv"), details=["n_prices"]), fd.findings(rows, "amount.sum", "sum_status", F.col("amount"), F.col("row_sum")),
        fd.findings(extra, "extra.requirements", actual=F.col("amount")),
    )


@query(f"WITH {_ALL} SELECT pk, check_id, status, CASE status WHEN 'failed' THEN 'high' WHEN 'manual_review' THEN 'medium' WHEN 'warning' THEN 'medium' ELSE 'info' END AS severity, expected FROM found")
def run_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several checks in one findings table."""
    return _found(spark, sf_dir).select("pk", "check_id", "status", "severity", "expected")


@query(f"""WITH {_ALL}, s AS (SELECT pk FROM found WHERE check_id = 'amount.sum' AND status IN ('passed', 'failed', 'warning')), k AS (SELECT * FROM found WHERE NOT (check_id = 'extra.requirements' AND status = 'manual_review' AND pk IN (SELECT pk FROM s)))
SELECT section, pk, check_id, status FROM k JOIN (VALUES ('amount.sum', 'amounts', 1), ('price.variation', 'prices', 2), ('extra.requirements', 'rules', 3)) o(check_id, section, ord) USING (check_id)""")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = spark.createDataFrame([("amount.sum", "amounts", 1), ("price.variation", "prices", 2), ("extra.requirements", "rules", 3)], "check_id string, section string, ord int")
    replaced = spark.createDataFrame([("extra.requirements", "amount.sum")], "strict_id string, semantic_id string")
    return fd.report_rows(_found(spark, sf_dir), sections, replaced).select("section", "pk", "check_id", "status")


@query("""SELECT event_type, hour, grouping(event_type, hour)::INTEGER AS level, count(*) AS n_calls, count(*) FILTER (event_type = 'error') AS n_errors, sum(v)::BIGINT AS value FROM (SELECT event_type, hour(ts)::INTEGER AS hour, round(value * 100)::BIGINT AS v FROM events) GROUP BY CUBE (event_type, hour)""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, errors and values by type and hour with all totals."""
    rows = table(spark, sf_dir, "events").select("event_type", F.hour("ts").alias("hour"), F.round(F.col("value") * 100).cast("bigint").alias("v"))
    return rows.cube("event_type", "hour").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n_calls"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.sum("v").alias("value"))


@query("""SELECT time_bucket(INTERVAL '10 minutes', ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n_calls, count(*) FILTER (event_type = 'error') AS n_errors, sum(round(value * 100)::BIGINT)::BIGINT AS value FROM events GROUP BY ALL""")
def metrics_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.metrics(table(spark, sf_dir, "events"))


@query(f"""WITH {PRICES} SELECT pk, n_prices, cv, {_status("cv IS NOT NULL", "cv < 33")} AS status FROM (SELECT pk, count(*) AS n_prices, round(CASE WHEN count(*) >= 2 AND avg(price) <> 0 THEN stddev_samp(price) / avg(price) * 100 END, 4) AS cv FROM prices GROUP BY pk)""")
def incremental_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices arrive as a stream of files, whole packages in each, and are checked batch by batch. A task writes the packages dealt to it."""
    box = shared_path(spark, "incremental")
    got = prices(spark, sf_dir)
    got.withColumn("part", F.col("pk") % 3).write.partitionBy("part").parquet(f"{box}/in")
    stream = jobs.read_packages(spark, f"{box}/in", got.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    jobs.incremental_audit(stream, price_op.price_variation, f"{box}/out", f"{box}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{box}/out").select("pk", "n_prices", "cv", "status")


@query("""SELECT DISTINCT sha256(text) AS digest FROM documents""")
def duplicate_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads of a stream whose text was there before are dropped."""
    box = shared_path(spark, "uploads")
    # uploads come over some hours, less than the day in which repeats are looked for
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") % 36_000)
    table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"), at.alias("at")).write.parquet(f"{box}/in")
    stream = jobs.read_packages(spark, f"{box}/in", "digest string, at timestamp")
    jobs.to_table(jobs.first_uploads(stream, "digest", "at"), f"{box}/out", f"{box}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{box}/out").select("digest")


@query("""WITH e AS (SELECT * FROM events WHERE event_id % 10 <> 0), w AS (SELECT max(ts) - INTERVAL '1 hour' AS mark FROM e)
SELECT time_bucket(INTERVAL '10 minutes', ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n_calls, count(*) FILTER (event_type = 'error') AS n_errors, sum(round(value * 100)::BIGINT)::BIGINT AS value FROM e, w GROUP BY 1, mark HAVING start + INTERVAL '10 minutes' <= mark""")
def metrics_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive as a stream; a tenth of them comes after the watermark has closed the windows, and is dropped."""
    box = shared_path(spark, "metrics")
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields)
    last = events.where("event_id % 10 != 0").agg(F.max("ts")).first()[0]
    late = events.where("event_id % 10 = 0").where(F.col("ts") < F.lit(last) - F.expr("INTERVAL 70 MINUTES"))
    for part in (events.where("event_id % 10 != 0"), late):
        part.write.mode("append").parquet(f"{box}/in")
        jobs.to_table(jobs.metrics(jobs.read_packages(spark, f"{box}/in", schema)), f"{box}/out", f"{box}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{box}/out").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT 'pk=' || s_nationkey AS pk, 'unknown' AS role, 'txt' AS extension, sum(strlen(s_name) + 1)::BIGINT AS size FROM supplier GROUP BY s_nationkey""")
def discovered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each nation with one file that lists its suppliers."""
    box = shared_path(spark, "packages")
    names = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("pk"), "s_name")
    names.repartition("pk").sortWithinPartitions("pk").write.partitionBy("pk").text(box)
    return src.discover_files(spark, box).select("pk", "role", "extension", "size")


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name, n_regionkey AS parent FROM nation UNION ALL SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def json_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index files, an array of records for each key, written as JSON and read back with their types."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("parent"))
    read = []
    for rows in (nation, supplier):
        box = shared_path(spark, "index")
        rows.groupBy(F.col("parent").alias("key")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("text")).repartition("key").write.partitionBy("key").text(box)
        read.append(src.read_json_index(spark, box, "id bigint, name string, parent int").select("id", "name", "parent"))
    return read[0].unionByName(read[1])


@query(f"""WITH {PRICES} SELECT pk::VARCHAR AS pk, n_prices, cv, {_status("cv IS NOT NULL", "cv < 33")} AS status FROM (SELECT pk, count(*) AS n_prices, round(CASE WHEN count(*) >= 2 AND avg(price) <> 0 THEN stddev_samp(price) / avg(price) * 100 END, 4) AS cv FROM prices GROUP BY pk)""")
def arriving_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of each package arrive in three parts, the stream starting anew for each; the current findings are those of all."""
    box = shared_path(spark, "arrivals")
    got = written(prices(spark, sf_dir).select(F.col("pk").cast("string").alias("pk"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("seq") * 3600).alias("at"), "price", (F.col("seq") % 3).alias("part")), "arrivals")
    for part in range(3):
        got.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{box}/in")
        stream = jobs.read_packages(spark, f"{box}/in", "pk string, at timestamp, price long")
        jobs.to_table(arrivals.audit_arrivals(stream, "90 days", "60 days"), f"{box}/out", f"{box}/checkpoint").awaitTermination()
    return arrivals.current(spark.read.parquet(f"{box}/out")).select("pk", "n_prices", "cv", "status")
