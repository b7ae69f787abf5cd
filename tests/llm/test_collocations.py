"""Collocations against brute force, and the summaries of the first pass."""

import random
import re
from collections import Counter
from itertools import islice

import numpy as np

from dossier.llm import collocations as co

EMPTY = "doc_id long, text string, lang string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute(rows, threshold, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und" if lang is None else lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f["und" if lang is None else lang, tuple(w[i : i + m])] += 1
    out = []
    for lang in n:
        scored = []
        mine = {p: c for (x, p), c in f.items() if x == lang and c >= threshold}
        for p, a in mine.items():
            if len(p) < 2:
                continue
            if any(len(q) > len(p) and 100 * c >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, c in mine.items()):
                continue
            score, k = min((2_000_000 * a // (mine[p[:k]] + mine[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), mine[p[:k]], mine[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(islice(sorted(scored), top), 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return Counter(out)


def made(seed, n):
    random.seed(seed)
    words = ["the", "The", "new", "york", "city", "of", "é", "日本", "a\x00b", "x" * 300, "und"]
    join = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?", "\x0b"]
    return [("".join(random.choice(words[: random.choice((3, 6, 11))]) + random.choice(join) for _ in range(random.randint(0, 60))), random.choice(["en", "fr", None, "und", ""])) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1) for i, (t, lang) in enumerate(rows)], EMPTY + ", phrase string, n long").repartition(5)


def test_against_brute_force(spark, monkeypatch):
    rows = [*made(1, 400), (None, "en"), ("", "fr"), ("one two three four five " * 3000, "de"), *[("one two three", "de")] * 50]
    for threshold, top in ((30, 2000), (5, 7)):
        got = co.collocations(frame(spark, rows), threshold, top)
        assert Counter(map(tuple, got.collect())) == brute(rows, threshold, top)
    # many hash partitions, small summaries, and bits that nearly all are set
    monkeypatch.setattr(co, "BITS", 64)
    monkeypatch.setattr(co, "GATHER", 500)
    counted = lambda capacity: Counter(map(tuple, co.counts(frame(spark, rows), 30, capacity).collect()))
    assert counted(40) == counted(1 << 19)


def test_empty(spark):
    assert co.collocations(spark.createDataFrame([], EMPTY)).collect() == []
    assert co.collocations(spark.createDataFrame([(1, None, None), (2, " . ", "en")], EMPTY)).collect() == []


def test_no_frequent_fingerprint_is_lost():
    rng = np.random.default_rng(7)
    for capacity, threshold, mass in ((50, 30, 1400), (200, 30, 5900), (10, 30, 280)):
        stream = np.concatenate((rng.integers(0, 1 << 20, mass - 60), np.repeat(rng.integers(0, 1 << 20, 2), 30))).astype(np.uint32)
        rng.shuffle(stream)
        summary = co.Summary(capacity, threshold)
        for part in np.array_split(stream, 13):
            summary.add(*np.unique(part, return_counts=True))
        kept = set(summary.frequent().tolist())
        keys, n = np.unique(stream, return_counts=True)
        assert set(keys[n >= threshold].tolist()) <= kept
        assert summary.cut < threshold and len(kept) <= capacity
    # more frequent fingerprints than counters: the table grows, nothing is lost
    summary = co.Summary(10, 30)
    for part in np.array_split(np.tile(np.arange(500, dtype=np.uint32), 40), 7):
        summary.add(*np.unique(part, return_counts=True))
    assert len(summary.frequent()) == 500


def test_scores_beyond_64_bits(spark, monkeypatch):
    big = 1 << 60
    table = [("en", 0, "", 4 * big), ("en", 1, "a", big), ("en", 1, "b", big), ("en", 1, "c", big + 5), ("en", 2, "a b", big - 7), ("en", 2, "b c", big // 2), ("en", 3, "a b c", (big - 7) * 4 // 5)]
    monkeypatch.setattr(co, "counts", lambda docs, threshold: spark.createDataFrame(table, "lang string, n_words int, phrase string, f long"))
    got = {r.phrase: r for r in co.collocations(spark.createDataFrame([], EMPTY)).collect()}
    score = lambda a, left, right: 2_000_000 * a // (left + right)
    a = (big - 7) * 4 // 5
    assert got["a b c"].score == min(score(a, big, big // 2), score(a, big - 7, big + 5))
    # 100 * f(longer) falls short of 80 * a by rounding down
    assert ("a b" in got) == (100 * a < 80 * (big - 7)) and "b c" not in got
