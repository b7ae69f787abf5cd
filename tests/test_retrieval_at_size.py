"""Searches at more pairs than a task holds, and vectors that no matrix can hold."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from dossier.operators import retrieval, sections

from .test_code_names import most_rows


def test_bm25_has_as_many_tasks_as_its_pairs_need(spark, monkeypatch):
    random.seed(2)
    text = lambda: " ".join(random.choice("red blue ring bolt old hot plate".split()) for _ in range(8))
    chunks = spark.createDataFrame([(i, text()) for i in range(120)], "doc_id int, text string")
    queries = spark.createDataFrame([(i, text()) for i in range(10)], "query_id int, text string")
    few = retrieval.bm25_topk(chunks, queries, 3, ["doc_id"])
    want = sorted(map(tuple, few.collect()))
    monkeypatch.setattr(retrieval, "PAIR_ROWS", 50)
    many = retrieval.bm25_topk(chunks, queries, 3, ["doc_id"])
    assert sorted(map(tuple, many.collect())) == want and len(want) == 30
    assert "REPARTITION_BY_NUM" in many._jdf.queryExecution().executedPlan().toString() and "doc_id#" in many._jdf.queryExecution().executedPlan().toString()
    assert ", 24), REPARTITION_BY_NUM" in many._jdf.queryExecution().executedPlan().toString()


def test_vectors_meet_as_matrices_and_odd_ones_by_columns(spark):
    random.seed(3)
    rows = [(i, [random.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(3)] + [1.0]) for i in range(300)]
    rows += [(300, None), (301, [1.0, 2.0]), (302, [1.0, None, 1.0, 1.0]), (303, [float("nan"), 1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id int, embedding array<double>").repartition(3)
    queries = vectors.where("vec_id % 20 = 0 or vec_id > 299")
    found = retrieval.vector_topk(vectors, queries, 7)
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_q"))
    met = vectors.join(F.broadcast(asked), F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", F.round(retrieval.cosine(F.col("embedding"), F.col("_q")), 6).alias("score"))
    met.createOrReplaceTempView("met")
    want = spark.sql("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM met) WHERE place <= 7")
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    assert most_rows(retrieval.vector_topk(vectors, queries, 7)) < met.count() / 2


@pytest.mark.parametrize("limits", [{}, {"TERM_ROWS": 7, "PAIRS": 20, "SLICE_ROWS": 3, "PAIR_ROWS": 100}])
def test_bm25_scores_odd_chunks_in_slices_without_rows_of_pairs(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(retrieval, name, value)
    random.seed(5)
    text = lambda: " ".join(random.choice("Red blue ring bolt old hot plate the of".split()) for _ in range(random.randint(1, 9)))
    rows = [(f"d{i // 3}", i % 3, text()) for i in range(90)]
    # copies of a row, other texts under a known key, nulls, blanks, and one text many times
    rows += rows[:9] + [("d0", 0, "ring"), ("d0", 1, text()), (None, 0, "bolt the"), ("e", None, "old"), ("f", 0, None), ("g", 0, " \t\n"), ("h", 0, "unknown")] + [(f"t{i}", 0, "hot plate") for i in range(9)]
    asked = [(i, text()) for i in range(12)] + [(3, "ring ring"), (None, "blue"), (50, ""), (51, None), (52, "absent")]
    found = retrieval.bm25_topk(spark.createDataFrame(rows, "doc string, part int, text string").repartition(3), spark.createDataFrame(asked, "query_id int, text string"), 4, ["doc", "part"])
    words = lambda x: [w for w in re.split(r"\s+", x.lower()) if w]
    sizes = [len(words(x)) for _, _, x in rows if x is not None]
    times, qf, df, score = Counter(), Counter(), Counter(), defaultdict(float)
    for d, p, x in rows:
        times.update((d, p, len(words(x)), w) for w in words(x or "") if x is not None)
    for q, x in asked:
        qf.update((q, w) for w in words(x or ""))
    df.update(w for _, _, _, w in times)
    for (d, p, n, w), tf in times.items():
        for (q, v), f in qf.items():
            if v == w:
                idf = math.log((len(rows) - df[w] + 0.5) / (df[w] + 0.5) + 1)
                score[q, d, p] += f * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n * len(sizes) / sum(sizes)))
    want = []
    for q in {q for q, _, _ in score}:
        ranked = sorted((-round(s, 6), d or "", -1 if p is None else p) for (r, d, p), s in score.items() if r == q)
        want += [(q, d or None, None if p < 0 else p, -s) for s, d, p in ranked[:4]]
    got = [(r.query_id, r.doc, r.part, r.score) for r in found.collect()]
    order = lambda rows: sorted((str(a), str(b), str(c), round(x, 6)) for a, b, c, x in rows)
    assert order(got) == order(want) and {r.place for r in found.collect()} == {1, 2, 3, 4}
    if not limits:
        assert most_rows(found) <= len(rows) < len(score)


def test_pieces_of_a_long_text_are_cut_in_one_pass(spark):
    texts = ["", None, "a", "é" * 7, "x\ny" * 50, "😀я" * 200, *["0123456789" * 99 + "z" * n for n in range(12)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for size, overlap in ((300, 100), (10, 3), (5, 0), (9, 7)):
        want = [(i, j, t[at : at + size]) for i, t in enumerate(texts) if t for j, at in enumerate(range(0, max(len(t) - overlap - 1, 0) + 1, size - overlap))]
        assert sorted(map(tuple, sections.chunk_text(docs, size, overlap).collect())) == want
    # a substring from a place far on reads the text from its start
    assert "substring(" not in sections.chunk_text(docs)._jdf.queryExecution().optimizedPlan().toString()
