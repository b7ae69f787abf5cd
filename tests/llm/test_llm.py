"""The ten operators against brute force on small tables, and their edge cases."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from dossier.llm import bpe, decontam, kernels, licenses, lines, lm, minhash, passages, pii, quality, token_counts
from dossier.llm.shared import shared_dir

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, copies, repeated rows and clashing extra columns."""
    long = " ".join(f"w{i % 700}x{i // 700}" for i in range(30_000))
    same = "one two three four five six seven\neight nine ten eleven twelve\nagain and again"
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, same), (6, same), (6, same), (None, same), (7, "word"), (8, "naïve Ünïcode 日本 text"), (9, long + " tail")]
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, kept string, n_words int, ids string")


#: A sequence and its complement that meet under any polynomial modulo a power of two.
THUE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
UHT = THUE.translate(str.maketrans("ab", "ba"))
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def test_spans_and_lines_match_python():
    random.seed(3)
    data = ["".join(random.choice(" \n\tab\x0bé") for _ in range(random.randint(0, 30))) for _ in range(500)] + [None, ""]
    for piece in kernels.slices(pa.array(data), 200):
        for spans, split in ((piece.runs(kernels.SPACE), lambda t: re.findall(WORD, t)), (piece.lines(), lambda t: t.split("\n"))):
            for k in range(len(piece)):
                got = [piece.data[a:b].tobytes().decode() for a, b in zip(spans.start[spans.first[k] : spans.first[k + 1]], spans.end[spans.first[k] : spans.first[k + 1]])]
                assert got == split(data[piece.lo + k] or "")


# 1


def test_quality_counts_and_accuracy(spark, docs, texts):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in quality.quality_rules(docs, labels).collect()}
    for i, t in texts.items():
        w = re.findall(WORD, t)
        runs = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = {j for k in range(len(w) - 7) if runs[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        filled = [x for x in t.split("\n") if re.search(WORD, x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(filled) - len(set(filled)), len(again), len(w) < 20 or 100 * len(again) > 30 * len(w))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.base_failed and r.kept)
    right = [got[r.doc_id].kept == (r.quality == 1) for r in labels.collect() if not got[r.doc_id].base_failed]
    assert np.mean(right) > 0.95


def test_quality_edges(spark, odd):
    none = spark.createDataFrame([(5, None, 0), (None, 1, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_rules(odd, none).collect()
    assert len(got) == 11 and not any(r.kept for r in got if r.n_words < 20)
    assert quality.score(odd, None).select("doc_id", "ids").count() == 11
    assert quality.drop_rejected(spark.createDataFrame([], EMPTY), none).count() == 0


# 2


def test_rollup_is_idempotent(spark, odd):
    rollup = token_counts.TokenRollup(spark, f"{shared_dir(spark)}/t-{random.random()}")
    rows = spark.createDataFrame([("a", "en", "t"), ("a", "en", None), (None, "en", "x y")], "source string, lang string, text string")
    rollup.commit(1, token_counts.inserts(rows, "words-1"))
    gone = token_counts.deletes(rows.where("text = 't'"), "words-1")
    for _ in range(3):
        rollup.commit(2, gone)
    rollup.commit(3, spark.createDataFrame([("revise", None, "en", "words-1", 5, 2), (None, None, "en", "words-1", 9, 9)], "op string, source string, lang string, tokenizer_version string, n_tokens long, old_n_tokens long"))
    rollup.commit(4, gone.limit(0))
    assert sorted((r.source or "", r.n_docs, r.n_tokens) for r in rollup.totals().collect()) == [("", 1, 5), ("a", 1, 0)]
    assert rollup.compact(4).totals().count() == 2


# 3


def brute_components(sets, percent):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def shingle_set(t, n):
    w = re.findall(WORD, lower(t or ""))
    n = min(n, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, texts, width, percent):
    want = brute_components({i: shingle_set(t, width) for i, t in texts.items()}, percent)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, width, percent).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_chains_and_dense_groups_lose_no_link(spark):
    random.seed(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):  # copies with a few changes each, many of them near the threshold
        w = list(base)
        for _ in range(random.randint(0, 7)):
            w[random.randrange(120)] = f"z{random.randrange(40)}"
        rows.append((i, " ".join(w)))
    for i in range(12):  # a chain, each link close, the ends far apart
        rows.append((100 + i, " ".join(f"c{j}" for j in range(i * 5, i * 5 + 120))))
    want = brute_components({i: shingle_set(t, 3) for i, t in rows}, 85)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == want and len({got[100 + i] for i in range(12)}) == 1


def test_near_duplicate_edges(spark, odd):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(odd, 3, 85).collect()]
    assert sorted(x for x in got if x[0] in (1, 2, 3)) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
    assert {x[2:] for x in got if x[0] == 6} == {(5, False)} and {x[2:] for x in got if x[0] == 9} == {(4, False)}
    assert [x[2:] for x in got if x[0] is None] == [(None, True)]
    assert minhash.near_duplicates(spark.createDataFrame([], EMPTY)).count() == 0
    assert minhash.drop_near_duplicates(odd, 3, 85).count() == 8


def test_threshold_is_rarely_missed():
    t = minhash.threshold(85)
    assert sum(math.comb(64, k) * 0.85**k * 0.15 ** (64 - k) for k in range(t)) <= 1e-9


# 4


def test_base_spans_match_the_patterns(texts):
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def good(kind, v):
        d = re.sub("[^0-9]", "", v)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in v.split(".")), "card": 13 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    random.seed(9)
    noise = ["".join(random.choice("a.@1 23-+()4@.b") for _ in range(60)) for _ in range(3000)]
    for t in [*texts.values(), *noise, "1.1.1.1.1.1.1.1", "a@b@c.d", "0001.0000000.2.3"]:
        assert pii.base_spans(t) == [(k, m.start(), m.end()) for k, p in kinds for m in re.finditer(p, t) if good(k, m[0])]


def test_pii_adds_spans_and_leaves_prose(spark, docs, texts, odd):
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    for i, t in texts.items():
        if not re.search(r"[0-9@=]", t):
            assert got[i].spans == ""
    clean = pii.redact(docs).select("doc_id", "text").collect()
    assert not any(re.search(r"@mail\d", r.text) for r in clean)
    assert pii.report(odd).count() == 11 and pii.report(spark.createDataFrame([], EMPTY)).count() == 0


def test_reliabilities_follow_the_better_labelers():
    got = pii.reliabilities([("card", "+++0+0", 100), ("card", "0-0000", 100), ("card", "0--0-0", 50)])
    assert got["card", "+++0+0"] > 0.9 > 0.1 > got["card", "0--0-0"]


# 5


def brute_hits(t, items, width):
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x or ""))
    w, hit, who = words(t), set(), set()
    for i, x in items:
        x = words(x)
        n = min(width, len(x))
        wins = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in wins:
                hit |= set(range(k, k + n))
                who.add(str(i))
    return sorted(hit), sorted(who)


def test_decontamination(spark, docs, texts, odd):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][:12] + [(99, "Of THE"), (98, None), (97, "?!"), (None, "the")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    some = docs.limit(60)
    known = [x for x in items if x[0] is not None]
    for block in (1 << 20, 300):
        for r in decontam.scan(some.select("doc_id", "text"), bench, block_bytes=block).collect():
            assert (list(r.hits), list(r.items)) == brute_hits(texts[r.doc_id], known, 10)
    left = decontam.decontaminate(some, bench)
    assert left.columns == docs.columns and decontam.scan(left, bench).where("size(hits) > 0 and not array_contains(items, '99')").count() == 0
    assert decontam.report(odd, bench).count() == 11 and decontam.report(odd, bench.limit(0)).where("contaminated").count() == 0
    assert hashlib.sha256(b"").hexdigest() == decontam.report(odd, bench.limit(0)).first().items_sha256


# 6


def test_licences(spark, odd):
    mit = next(t for i, k, t in licenses.KNOWN if i == "MIT" and k == "text")
    rows = [(1, "Copyright (c) 2020 A. Nother\n" + mit.upper().replace("SUBLICENSE", "sub-licence")), (2, mit + " and more"), (3, "x\n  RELEASED under the MIT Licence\ny"), (4, "copyright is a right"), (5, None), (6, "")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.line_no, r.license_id) for r in got) == [(1, 0, "MIT"), (3, 2, "MIT")]
    assert licenses.scan(odd).count() == 0


# 7


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_multi_50k.tiktoken")


def test_words_and_folds_match_the_library(vocabulary):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(2)
    parts = ["'", "s", "re", "ll", " ", "  ", "\n", "a", "É", "1", "²", "!", "日", "\U0001f600", "ve", "m", "\x1c", "\x85"]
    data = ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(5000)] + ["a" * 700, " " * 300, "éèàù" * 90]
    merges = bpe.Merges(ranks)
    for piece in kernels.slices(pa.array(data)):
        start, end = bpe.words(piece)
        ids, count = merges.fold(piece, start, end)
        cut = np.concatenate(([0], np.cumsum(count)))[np.searchsorted(start, piece.offs)]
        for k in range(len(piece)):
            assert ids[cut[k] : cut[k + 1]].tolist() == library.encode_ordinary(data[piece.lo + k])


def test_documents_are_encoded_as_by_the_library(spark, docs, texts, vocabulary):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    more = {10**6: THUE, 10**6 + 1: UHT, 10**6 + 2: THUE, 10**6 + 3: "x" * 5000 + " " + "ab" * 3000}
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(more.items()), "doc_id long, text string"))
    for most in (0, 2000):
        for r in bpe.report(both, vocabulary, most).collect():
            ids = library.encode_ordinary((texts | more)[r.doc_id])
            assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256((texts | more)[r.doc_id].encode()).hexdigest()


def test_higher_order_fold_equals_the_helper(spark, docs, vocabulary):
    ranks = bpe.read_ranks(spark, vocabulary)
    got, merges = bpe.encoded_words(bpe.word_counts(docs), ranks, 3000).collect(), bpe.Merges(ranks)
    assert len(got) > 1000
    for r in got:
        piece = kernels.Slice(0, 1, np.frombuffer(bytes(r.word), np.uint8), np.array([0, len(r.word)]))
        assert r.ids == merges.fold(piece, piece.offs[:1], piece.offs[1:])[0].tolist()


def test_round_trip(spark, odd, vocabulary):
    both = bpe.decode(bpe.encode(odd, vocabulary, most=50), vocabulary).collect()
    assert len(both) == 11 and all(bytes(r.decoded).decode() == (r.text or "") for r in both)
    assert bpe.report(spark.createDataFrame([], EMPTY), vocabulary).count() == 0


# 8


def test_language_model(spark, docs, texts):
    got = {r.doc_id: r for r in lm.score(docs, known_words=500).collect()}
    tokens = {i: [*re.findall(WORD, lower(t)), ""] for i, t in texts.items()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    c = Counter(w for i, ws in tokens.items() if i not in held for w in ws)
    total, distinct = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, len(ws), sum(c[w] > 0 for w in ws), total)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in ws), rel=1e-9)
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)


def test_language_model_is_a_distribution():
    known = lm.Vocabulary(np.array([1 << 60, 3 << 60], np.uint64), np.array([5, 2]), np.array([64, 65]), np.array([1.0, 1.0]), 10, 4, 3, 2)
    assert known.find(np.array([3 << 60, 7, 1 << 60], np.uint64)).tolist() == [1, -1, 0]
    w = lm.Weights(np.random.default_rng(1).normal(size=lm.Weights().flat.shape).astype(np.float32))
    features = np.tile(lm.context(np.array([5, 6, 7], np.uint64), np.array([0, 3]))[2], (256, 1))
    assert (10 ** w.log10(features, np.arange(256))).sum() == pytest.approx(1, abs=1e-4)


def test_language_model_edges(spark, odd):
    assert lm.score(odd, known_words=100).where("isnan(score) or score is null").count() == 0
    held = [i for i in range(100) if lm.is_held_out(i)][:3]
    none = lm.score(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert all(r.train_tokens == 0 and r.score == r.base_score == 0 for r in none)


# 9


def brute_lines(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        parts = texts[i].split("\n")
        filled = [k for k, x in enumerate(parts) if x.strip(" \t\n\r\x0b\x0c")]
        key = [parts[k].strip(" \t\n\r\x0b\x0c") for k in filled]
        gone = set()
        for p in range(len(key) - 1):
            if (key[p], key[p + 1]) in seen:
                gone |= {filled[p], filled[p + 1]}
            seen.add((key[p], key[p + 1]))
        out[i] = "\n".join(x for k, x in enumerate(parts) if k not in gone)
    return out


def test_line_dedup(spark, docs, texts, odd):
    random.seed(4)
    small = {i: "\n".join(random.choice(["a", "b", " a ", "c", "", "d e"]) for _ in range(random.randint(0, 9))) for i in range(300)}
    for frame, source in ((docs, texts), (spark.createDataFrame(list(small.items()), "doc_id long, text string"), small)):
        assert {r.doc_id: r.text for r in lines.line_dedup(frame).collect()} == brute_lines(source)
    got = lines.line_dedup(odd)
    assert got.count() == 11 and {r.text for r in got.where("doc_id = 6").collect()} == {""} and got.where("doc_id = 1").first().text is None
    assert lines.report(spark.createDataFrame([], EMPTY)).count() == 0


# 10


def test_compact_windows_cover_each_subsequence_once():
    random.seed(6)
    for _ in range(50):
        parts = [[random.randrange(1, 30) for _ in range(random.randint(0, 60))] for _ in range(3)]
        h, first = np.array(sum(parts, []), np.uint64), np.cumsum([0, *map(len, parts)])
        got = list(zip(*passages.compact_windows(h, first, 5)))
        for lo, hi in zip(first[:-1], first[1:]):
            for i in range(lo, hi):
                for j in range(i + 4, hi):
                    inside = [c for a, c, b in got if a <= i <= c <= j <= b]
                    assert len(inside) == 1 and h[inside[0]] == h[i : j + 1].min()


def test_planted_passages(spark, odd):
    random.seed(8)
    word = lambda: f"{random.choice('abcdefg')}{random.randrange(4000)}"
    shared = [word() for _ in range(60)]
    near = list(shared)
    near[30] = "changed"
    prose = lambda n: [word() for _ in range(n)]
    rows = [(1, prose(90) + shared + prose(20)), (2, prose(10) + shared + prose(80)), (3, prose(40) + near + prose(40)), (4, prose(200)), (5, prose(20) + shared[:30] + prose(40)), (6, shared + prose(30) + shared)]
    got = passages.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    found = {(r.doc_id, r.first_id) for r in got}
    assert found == {(2, 1), (3, 1), (6, 1)}
    two = next(r for r in got if r.doc_id == 2)
    assert (two.start, two.end, two.first_start, two.first_end) == (10, 70, 90, 150)
    assert {(r.start, r.end) for r in got if r.doc_id == 6} == {(0, 60), (90, 150)}
    again = passages.repeated_passages(odd)
    assert {(r.doc_id, r.first_id) for r in again.collect()} == {(9, 4)}
    assert passages.drop_passages(odd).count() == 11
    assert passages.repeated_passages(spark.createDataFrame([], EMPTY)).count() == 0


def passage_found(later, first):
    """Passages of one text in another, in words."""
    (x,), (y,) = (passages.sequences(pa.array([" ".join(w)])) for w in (later, first))
    return [(a, b + 4, c, d + 4) for a, b, c, d in passages.verified(x, y, False, 46, 80)]


def test_passage_is_found_behind_many_earlier_places():
    number = iter(range(10_000))
    fresh = lambda n: [f"n{next(number)}" for _ in range(n)]
    passage = fresh(50)
    first = [w for _ in range(20) for w in passage[:24] + fresh(9)] + passage
    assert passage_found(fresh(30) + passage + fresh(30), first) == [(30, 80, 660, 710)]


def test_passage_with_a_long_insertion_is_one():
    passage = [f"p{i}" for i in range(90)]
    longer = passage[:45] + [f"new{i}" for i in range(12)] + passage[45:]
    around = lambda w, name: [f"{name}{i}" for i in range(20)] + w + [f"{name}-{i}" for i in range(20)]
    assert passage_found(around(longer, "a"), around(passage, "b")) == [(20, 122, 20, 110)]
    assert passage_found(around(passage, "b"), around(longer, "a")) == [(20, 110, 20, 122)]
    assert passage_found(passage[:45] + [f"far{i}" for i in range(60)] + passage[45:], passage) == []


def test_passage_may_be_shorter_in_the_first_text():
    passage = [f"p{i}" for i in range(49)]
    longer = passage[:39] + ["new"] + passage[39:]
    assert passage_found(longer + [f"a{i}" for i in range(30)], passage + [f"b{i}" for i in range(30)]) == [(0, 50, 0, 49)]


def test_fragments_in_first_documents_hide_no_passage(spark):
    rows, pairs = [], set()
    for g in range(20):
        passage, base = [f"g{g}p{i}" for i in range(60)], 10 * g
        parts = [passage[:40], passage[20:], passage, passage]
        rows += [(base + k, " ".join([f"d{base + k}a{i}" for i in range(30)] + w + [f"d{base + k}b{i}" for i in range(30)])) for k, w in enumerate(parts)]
        pairs.add((base + 3, base + 2))
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r.doc_id, r.first_id) for r in got}
    assert found <= pairs and len(found) >= 19
    assert all((r.start, r.end, r.first_start, r.first_end) == (30, 90, 30, 90) for r in got)


def test_slices_in_earlier_documents_hide_no_passage(spark):
    number = iter(range(10**6))
    fresh = lambda n: [f"n{next(number)}" for _ in range(n)]
    rows, want = [], set()
    for g in range(10):
        passage, base = fresh(60), 100 * g
        for k in range(7):
            rows.append((base + k, fresh(40) + passage[8 * k : 8 * k + 12] + fresh(40)))
        rows += [(base + 50, fresh(30) + passage + fresh(20)), (base + 51, fresh(10) + passage + fresh(50))]
        want.add((base + 51, base + 50))
    got = passages.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.first_id) for r in got} == want


def test_near_passages_behind_slices_are_found(spark):
    """Earlier documents hold 12-word slices of a passage that two later ones have with one word changed."""
    number = iter(range(10**6))
    fresh = lambda n: [f"n{next(number)}" for _ in range(n)]
    rows, want = [], set()
    for g in range(40):
        passage, base = fresh(60), 100 * g
        rows += [(base + k, fresh(40) + passage[12 * k : 12 * k + 12] + fresh(40)) for k in range(5)]
        near = passage[:24] + ["changed"] + passage[25:]
        rows += [(base + 50, fresh(30) + passage + fresh(20)), (base + 51, fresh(10) + near + fresh(50))]
        want.add((base + 51, base + 50))
    got = passages.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.first_id) for r in got} == want


def test_near_passages_behind_a_common_fragment_are_found(spark):
    """A fragment of 40 words that many texts share is no passage, and hides none around it, nor are its texts compared."""
    number = iter(range(10**6))
    fresh = lambda n: [f"n{next(number)}" for _ in range(n)]
    line = fresh(40)
    rows = [(i, fresh(30) + line + fresh(30)) for i in range(80)]
    passage = fresh(10) + line + fresh(20)
    near = passage[:60] + ["changed"] + passage[61:]
    rows += [(100, fresh(20) + passage + fresh(20)), (200, fresh(30) + near + fresh(20))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    for few in (2, 32):
        assert {(r.doc_id, r.first_id) for r in passages.repeated_passages(docs, few=few).collect()} == {(200, 100)}
    lists = spark.createDataFrame([(i, [(1, 30)]) for i, _ in rows], "doc_id long, posts array<struct<key: long, at: int>>").selectExpr("doc_id", "inline(posts)")
    left = lists.where("doc_id > 0").selectExpr("key as t", "doc_id", "key", "at", "at as begin", "82L as n")
    met = lists.selectExpr("key as t", "doc_id", "key", "at", "82L as n")
    pairs = passages.meetings(left, met, lists.selectExpr("*", "82L as n"), docs, 12, 46, 80, 32)
    assert {(r.doc_id, r.first_id) for r in pairs.collect()} == {(200, 100)}


def test_passages_against_brute_force(spark):
    """Every word of an exact repeat of 50 words of an earlier document lies in a reported passage, and nothing else does."""
    random.seed(12)
    number = iter(range(10**6))
    fresh = lambda n: [f"n{next(number)}" for _ in range(n)]
    pool = [fresh(random.randint(20, 90)) for _ in range(12)]
    docs = {}
    for i in range(120):
        words = []
        for _ in range(random.randint(1, 5)):
            part = random.choice(pool)
            a = random.randrange(len(part) - 10)
            words += fresh(random.randint(5, 40)) + part[a : a + random.randint(10, 90)]
        docs[i] = words + fresh(12)
    want, seen = {}, {}
    for i, w in docs.items():
        runs = {tuple(w[k : k + 50]): k for k in reversed(range(len(w) - 49))}
        want[i] = {j for run, k in runs.items() if run in seen for j in range(k, k + 50)}
        for run in runs:
            seen.setdefault(run, i)
    got = {i: set() for i in docs}
    for r in passages.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")).collect():
        got[r.doc_id] |= set(range(r.start, r.end))
        x, y = docs[r.doc_id][r.start : r.end], docs[r.first_id][r.first_start : r.first_end]
        a, b = ({tuple(z[k : k + 5]) for k in range(len(z) - 4)} for z in (x, y))
        assert r.first_id <= r.doc_id and len(x) >= 50 and 100 * len(a & b) >= 80 * len(a | b)
    total = sum(map(len, want.values()))
    assert total > 2000 and sum(len(want[i] & got[i]) for i in docs) >= 0.99 * total


# all


def test_pipeline_runs(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF).collect()
    assert got and all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    assert len({r.doc_id for r in got}) == len(got)


def test_structured_texts_do_not_meet(spark):
    """Two unlike lines that a linear hash takes for one."""
    rows = [(1, f"first line\n{THUE}\nlast line"), (2, f"first line\n{UHT}\nlast line"), (3, f"{THUE}\n{UHT}\n{THUE}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in lines.line_dedup(docs).collect()} == dict(rows)
    assert [r.n_dup_lines for r in sorted(quality.score(docs, None).collect())] == [0, 0, 1]
    got = minhash.near_duplicates(docs.where("doc_id < 3"), 1, 100).collect()
    assert all(r.kept for r in got)
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame([(1, THUE), (3, UHT)], "doc_id long, text string")).collect()}
    assert [got[i].n_known for i in (1, 3)] == [2 - lm.is_held_out(1), 2 - lm.is_held_out(3)]


def test_long_digits_and_many_proposals(spark):
    digits = "0" * 5000
    text = f"{digits}.1.1.1 and {'9' * 6000}.1.1.1 " + "call 555-123-4567 now " * 3000
    row = pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_ip == 1 and row.n_card == 0


def test_resent_batches_count_once_after_compaction(spark):
    rollup = token_counts.TokenRollup(spark, f"{shared_dir(spark)}/t-{random.random()}")
    rows = [spark.createDataFrame([("a", "en", "x y z"[: 2 * k + 1])], "source string, lang string, text string") for k in range(3)]
    for k, docs in enumerate(rows):
        rollup.commit(k, token_counts.inserts(docs, "words-1"))
    short = rollup.compact(1)
    for again in (short, token_counts.TokenRollup(spark, short.path)):
        for k in (0, 1, 2):
            again.commit(k, token_counts.inserts(rows[k], "words-1"))
        assert [(r.n_docs, r.n_tokens) for r in again.totals().collect()] == [(3, 6)]
    empty = token_counts.TokenRollup(spark, f"{shared_dir(spark)}/t-{random.random()}")
    empty.commit(1, token_counts.inserts(rows[0].limit(0), "words-1"))
    late = empty.compact(1)
    late.commit(1, token_counts.inserts(rows[0], "words-1"))
    assert late.totals().count() == 0


def test_callers_columns_stay(spark):
    names = ["n_words", "hits", "items", "kept", "p_quality", "n_lines", "n_dropped", "sign", "drop", "of_doc", "_sign", "spans", "first"]
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty one\nand more words"
    docs = spark.createDataFrame([(i, text, *[f"own {n}" for n in names]) for i in (1, 2)], ", ".join(["doc_id long", "text string", *(f"`{n}` string" for n in names)]))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "two three four")], "item_id long, text string")
    for out in (quality.drop_rejected(docs, labels), decontam.decontaminate(docs, bench), decontam.decontaminate(docs, bench, block_bytes=5), lines.drop_repeated_lines(docs), passages.drop_passages(docs), minhash.drop_near_duplicates(docs), pii.redact(docs)):
        assert out.schema == docs.schema
        got = out.orderBy("doc_id").collect()
        assert got and all(r[n] == f"own {n}" for r in got for n in names)
    assert decontam.decontaminate(docs, bench).first().text == text.replace("two three four", "")
    assert decontam.decontaminate(docs, bench, remove="documents").count() == 0
    assert [r.text for r in lines.drop_repeated_lines(docs).orderBy("doc_id").collect()] == [text, ""]


def test_pipeline_against_brute_force(spark, docs, texts, vocabulary):
    """What the classifier keeps is taken as it is; every later stage is done again by hand."""
    import corpus_pipeline
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {r.doc_id for r in quality.quality_rules(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.kept}
    left = brute_lines({i: t for i, t in texts.items() if i in kept})
    group = brute_components({i: shingle_set(t, 5) for i, t in left.items()}, 80)
    want = {}
    for i, t in left.items():
        if group[i] != i:
            continue
        words = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))]
        hits, _ = brute_hits(t, items, 10)
        if hits and len(hits) == len(words):
            continue
        for k in reversed(hits):
            t = t[: words[k][0]] + t[words[k + 1][0] if k + 1 in hits else words[k][1] :]
        want[i] = library.encode_ordinary(t)
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < len(kept) < len(texts)


def test_pipeline_stages_take_odd_tables(spark):
    import corpus_pipeline

    prose = " ".join(f"word{i} of the {i % 7} day" for i in range(40))
    rows = [(1, None), (2, ""), (3, " \n "), (4, prose + "\n" + prose[::-1]), (4, prose + "\n" + prose[::-1]), (None, prose), (5, prose + "\nmore"), (6, "naïve 日本 " * 30)]
    kind = EMPTY + ", n_words string, hits string, drop string, kept string, cls string, sign string"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *"abcdef") for i, t in rows], kind)
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, SF), stage(spark, docs.limit(0), SF)
        assert none.count() == 0
        got = out.collect()
        if name != "encode":
            assert out.columns == docs.columns and all((r.n_words, r.hits, r.drop, r.kept, r.cls, r.sign) == tuple("abcdef") for r in got)
            assert all(r.n_chars == len(r.text) for r in got if r.text is not None)
        assert len(got) <= len(rows)
        if name in ("line_dedup", "encode"):
            assert len(got) == len(rows)
