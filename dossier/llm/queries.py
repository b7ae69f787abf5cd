"""The queries of the numbered operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontam, licenses, lines, lm, minhash, negatives, passages, pii, quality, secrets, token_counts
from .shared import shared_dir, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in under two tokenizer versions, shouted ones are revised, copies are deleted, and one batch is sent twice."""
    docs = table(spark, sf_dir, "documents")
    rollup = token_counts.TokenRollup(spark, f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}")
    rollup.commit(1, token_counts.inserts(docs, "words-1"))
    rollup.commit(2, token_counts.inserts(docs, "words-2"))
    first = docs.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"))
    again = docs.join(first, "doc_id", "left_anti")
    calmed = F.replace("text", F.lit("!!"), F.lit(""))
    changes = token_counts.deletes(again, "words-1").unionByName(token_counts.deletes(again, "words-2"))
    rollup.commit(3, changes)
    shouted = docs.join(first, "doc_id", "left_semi").where(F.contains("text", F.lit("!!")))
    rollup.commit(4, token_counts.revisions(shouted, calmed, "words-2"))
    rollup.commit(3, changes)
    return rollup.totals()


def op3_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(table(spark, sf_dir, "documents"), vocabulary())


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh label is off by one; the anchors are the stated query set, every hundredth id."""
    label = F.when(F.expr("vec_id % 7 = 0"), F.expr("(label + 1) % 10")).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.expr("vec_id % 100 = 0"))


def vocabulary() -> str:
    """The vocabulary file of the query; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_token_counts, op3_minhash_near_duplicates, op4_personal_data, op5_decontamination, op6_license_scan, op7_byte_bpe, op8_language_model, op9_line_dedup, op10_repeated_passages, op11_secret_scan, op12_collocations, op13_hard_negatives)}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_sql() -> str:
    def lines(c: str) -> str:
        plain = f"array_to_string(list_transform(string_split(lower({c}), chr(10)), lambda x: CASE WHEN regexp_matches(x, {_quoted(licenses.COPYRIGHT)}) THEN '' ELSE x END), chr(10))"
        for old, new in licenses.SPELLINGS:
            plain = f"replace({plain}, {_quoted(old)}, {_quoted(new)})"
        return f"regexp_replace({plain}, {_quoted(licenses.PUNCTUATION)}, ' ', 'g')"

    known = ", ".join("(" + ", ".join(map(_quoted, row)) + ")" for row in licenses.KNOWN)
    return f"""
WITH known AS (SELECT license_id, kind, sha256(trim(regexp_replace({lines("text")}, '[ \\n]+', ' ', 'g'))) AS digest FROM (VALUES {known}) t(license_id, kind, text)),
plain AS (SELECT doc_id, string_split({lines("text")}, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, 0 AS line_no, trim(regexp_replace(array_to_string(parts, ' '), ' +', ' ', 'g')) AS unit FROM plain
  UNION ALL SELECT doc_id, unnest(generate_series(1, len(parts))) AS line_no, trim(unnest(parts)) AS unit FROM plain)
SELECT doc_id, line_no::INTEGER AS line_no, license_id, kind, digest FROM units JOIN known ON digest = sha256(unit) WHERE unit <> ''"""


def _tokens_sql(column: str, version: str) -> str:
    return f"coalesce(len(regexp_extract_all({column}, {_quoted(token_counts.PATTERNS[version])})), 0)"


SQL = {
    "op2_token_counts": f"""
WITH first AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text),
kept AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM first)),
n AS (SELECT source, lang, 'words-1' AS tokenizer_version, {_tokens_sql("text", "words-1")} AS n FROM kept
  UNION ALL SELECT source, lang, 'words-2', {_tokens_sql("replace(text, '!!', '')", "words-2")} FROM kept)
SELECT source, lang, tokenizer_version, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens FROM n GROUP BY ALL""",
    "op5_decontamination": """
WITH item AS (SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT item_id, len(part) AS width, md5(array_to_string(part, ' ')) AS part
  FROM (SELECT item_id, list_slice(w, i, i + least(len(w), 10) - 1) AS part FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM item WHERE len(w) > 0))),
doc AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
seen AS (SELECT doc_id, i, width, md5(array_to_string(list_slice(w, i, i + width - 1), ' ')) AS part
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - width + 1)) AS i, width FROM doc, (SELECT DISTINCT width FROM windows) WHERE len(w) >= width)),
hits AS (SELECT doc_id, i, seen.width, item_id FROM seen JOIN windows ON seen.part = windows.part AND seen.width = windows.width),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + width - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op3_minhash_near_duplicates": """
WITH RECURSIVE doc AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 2), ' ')) AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(v, u) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.v, edge.b FROM reach JOIN edge ON edge.a = reach.u)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(u) AS component_id, doc_id = min(u) AS kept FROM documents LEFT JOIN size USING (doc_id) JOIN reach ON v = doc_id GROUP BY doc_id""",
    "op6_license_scan": _license_sql(),
    "op12_collocations": """
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w
  FROM (SELECT lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents WHERE text IS NOT NULL)),
f AS (SELECT lang, len(g) AS m, array_to_string(g, ' ') AS phrase, g, count(*) AS c
  FROM (SELECT lang, list_slice(w, i, i + m - 1) AS g FROM (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM piece), (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= len(w)) GROUP BY lang, g HAVING count(*) >= 30),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM piece GROUP BY lang),
cut AS (SELECT lang, phrase, c AS a, k, array_to_string(list_slice(g, 1, k), ' ') AS head, array_to_string(list_slice(g, k + 1, m), ' ') AS tail FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM f WHERE m > 1)),
scored AS (SELECT cut.lang, cut.phrase, a, k, h.c AS l, t.c AS r, (2000000::HUGEINT * a // (h.c + t.c))::BIGINT AS score FROM cut JOIN f h ON h.lang = cut.lang AND h.phrase = head JOIN f t ON t.lang = cut.lang AND t.phrase = tail),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS p FROM scored) WHERE p = 1),
inner_part AS (SELECT lang, array_to_string(list_slice(g, i, i + s - 1), ' ') AS phrase, max(c) AS c FROM (SELECT lang, g, c, m, s, unnest(generate_series(1, m - s + 1)) AS i FROM (SELECT *, unnest(generate_series(2, m - 1)) AS s FROM f WHERE m > 2)) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inner_part USING (lang, phrase) WHERE inner_part.c IS NULL OR 100::HUGEINT * inner_part.c < 80::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN total USING (lang) WHERE rank <= 2000""",
    "op13_hard_negatives": """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
anchor AS (SELECT * FROM v WHERE vec_id % 100 = 0),
score AS (SELECT a.row AS anchor, a.vec_id AS anchor_id, a.label AS anchor_label, v.row, v.vec_id, v.label, list_sum(list_transform(generate_series(1, least(len(a.q), len(v.q))), lambda i: a.q[i] * v.q[i]))::BIGINT AS s FROM anchor a, v WHERE a.row <> v.row),
positive AS (SELECT anchor, anchor_id, vec_id AS positive_id, s AS positive_score, row_number() OVER (PARTITION BY anchor ORDER BY s DESC, vec_id) AS p FROM score WHERE label = anchor_label QUALIFY p <= 5),
negative AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor, p ORDER BY s DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, s AS negative_score
  FROM positive p JOIN score n ON n.anchor = p.anchor AND n.label <> n.anchor_label AND 30 * positive_score <= 100 * s AND 100 * s <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 10""",
    "op9_line_dedup": """
WITH line AS (SELECT doc_id, i, x, trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)),
run AS (SELECT doc_id, i, row_number() OVER d AS p, k, lead(k) OVER d AS k2 FROM line WHERE k <> '' WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k, k2 ORDER BY doc_id, p) AS n FROM run WHERE k2 IS NOT NULL) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i FROM run JOIN (SELECT doc_id, p FROM later UNION SELECT doc_id, p + 1 FROM later) USING (doc_id, p)),
left_over AS (SELECT doc_id, count(*) FILTER (k <> '') AS n_lines, count(gone.i) AS n_dropped, string_agg(x, chr(10) ORDER BY line.i) FILTER (gone.i IS NULL) AS text FROM line LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(left_over.text, '')) AS text_sha256 FROM documents LEFT JOIN left_over USING (doc_id)""",
}
