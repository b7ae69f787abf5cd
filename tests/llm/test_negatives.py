"""Hard negatives and their exact scores against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import negatives as neg

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, `e.f` int"


def brute(rows, every=100, positives=5, negatives=10):
    good = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    clip = lambda s: max(min(s, 2**63 - 1), 1 - 2**63)
    out = []
    for n, (i, v, y) in enumerate(good):
        if i is None or i % every:
            continue
        scored = [(-clip(sum(p * q for p, q in zip(v, w))), math.inf if j is None else j, z) for m, (j, w, z) in enumerate(good) if m != n]
        scored.sort()
        named = lambda j: None if j == math.inf else j
        for s, j, _ in [x for x in scored if x[2] == y][:positives]:
            fit = [x for x in scored if x[2] != y and -30 * s <= -100 * x[0] <= -90 * s][:negatives]
            out += [(i, named(j), r, named(k), -s, -t) for r, (t, k, _) in enumerate(fit, 1)]
    return Counter(out)


def mined(spark, rows, every=100, parts=3, **named):
    df = spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in rows], SCHEMA).repartition(parts)
    return Counter(map(tuple, neg.hard_negatives(df, F.col("vec_id") % every == 0, **named).collect()))


def vectors(seed, n, labels=3, d=8, size=1.0):
    rng = np.random.default_rng(seed)
    return [(i, (rng.normal(0.3, size, d)).tolist(), int(rng.integers(labels))) for i in range(n)]


def test_against_brute_force(spark, monkeypatch):
    rows = vectors(1, 700)
    assert mined(spark, rows, 50) == brute(rows, 50) and brute(rows, 50)
    # small tiles and blocks, many ties and equal vectors
    monkeypatch.setattr(neg, "ROWS", 16)
    monkeypatch.setattr(neg, "ANCHORS", 3)
    monkeypatch.setattr(neg, "ANCHOR_BYTES", 700)
    random.seed(2)
    tied = [(i, [random.choice([0.0, 0.5, 1.0]) for _ in range(3)], random.randrange(2)) for i in range(300)] + [(1000 + i, [1.0, 1.0, 0.5], i % 2) for i in range(200)]
    random.shuffle(tied)
    assert mined(spark, tied, 20) == brute(tied, 20)


def test_odd_rows(spark):
    rows = vectors(3, 60, 2, 4)
    rows += [(100, None, 1), (101, [1.0, None, 2.0, 1.0], 1), (102, [1.0, math.nan, 2.0, 1.0], 0), (103, [math.inf, 0.0, 0.0, 1.0], 0), (104, [1.0] * 4, None), (105, [], 1), (200, [1.0], 0), (106, [1.0] * 9, 1)]
    rows += [rows[0], rows[0], (0, [0.25] * 4, 1), (None, [1.0] * 4, 0), (None, [1.0] * 4, 1), (-20, [1.0, -2.0, 0.5, 0.1], 1)]
    assert mined(spark, rows, 20) == brute(rows, 20)
    assert mined(spark, []) == Counter()
    assert mined(spark, [(7, [1.0], 1)]) == Counter()
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 2)]) == Counter()
    floats = spark.createDataFrame([(i, v, y) for i, v, y in vectors(5, 200)], "vec_id long, embedding array<float>, label long")
    want = [(r.vec_id, list(r.embedding), r.label) for r in floats.collect()]
    assert Counter(map(tuple, neg.hard_negatives(floats, F.col("vec_id") % 40 == 0).collect())) == brute(want, 40)


@pytest.mark.parametrize("size", [1e3, 1e6, 3e7, 1e12])
def test_large_components(spark, size):
    rows = vectors(4, 120, 2, 5, size)
    assert mined(spark, rows, 30) == brute(rows, 30)


def test_residue_products_are_exact():
    rng = np.random.default_rng(9)
    for d, top in ((1, 3), (64, 150), (700, 40_000), (3000, 2**20), (0, 1), (5, 2**31)):
        a, b = (np.floor(rng.uniform(-top, top, (n, d))) for n in (17, 11))
        if d:
            a[0], b[0], a[1] = -top, -top, top - 1
        want = [[max(min(sum(int(x) * int(y) for x, y in zip(p, q)), 2**63 - 1), 1 - 2**63) for q in b] for p in a]
        assert neg.scores(neg.Matrix(a), neg.Matrix(b)).tolist() == want
    assert len(neg.primes_for(64 * 150 * 150)) == 3
