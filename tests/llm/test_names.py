"""Callers' columns with dots and backticks, and a rollup to which nothing has been committed."""

import pytest

from dossier.llm import bpe, decontam, lines, minhash, pii, quality, secrets, token_counts

COLUMNS = "doc_id long, text string, `e.f` string, `a``b` int, odd0 string, n_chars long"
ROWS = [(1, "one two three four five\nsix seven eight", "x", 1, "o", 9), (2, "one two three four five\nsix seven eight", "y", 2, "p", 9), (3, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


def test_columns_keep_their_names(spark, docs):
    import public_tokenizers

    bench = spark.createDataFrame([("b", "two three four")], "item_id string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    made = [
        lines.drop_repeated_lines(docs), minhash.drop_near_duplicates(docs), decontam.decontaminate(docs, bench), pii.redact(docs), secrets.redact(docs),
        quality.drop_rejected(docs, labels), bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), 0).drop("ids"),
    ]
    for out in made:
        assert out.columns == docs.columns
        for r in out.collect():
            assert tuple(r)[2:5] == ROWS[r.doc_id - 1][2:5]


def test_a_rollup_without_commits(spark, tmp_path):
    empty = token_counts.TokenRollup(spark, str(tmp_path / "none"))
    assert empty.totals().collect() == []
    compacted = empty.compact(3)
    assert compacted.totals().collect() == []
    compacted.commit(3, token_counts.inserts(spark.createDataFrame([("s", "en", "a b")], "source string, lang string, text string"), "words-1"))
    assert compacted.totals().collect() == []
