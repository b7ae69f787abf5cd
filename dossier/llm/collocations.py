"""Operator 12: collocations by Misra-Gries summaries of hash partitions and an exact second pass.

First pass: every phrase of up to LONGEST words (of one language, inside one piece) is a fingerprint in one of many hash
partitions. Tasks hand on summaries, fingerprints with counts; where a partition meets, its summaries are merged, and when
there are more than CAPACITY counters the one after the CAPACITY-th largest is taken off all. The number of partitions
follows the input, so CAPACITY exceeds the mass of a partition divided by the threshold, and what was taken off stays
below the threshold: every frequent phrase survives. (Where a partition is heavier than that, its table grows instead.)
The survivors are marked in a bit table of fixed size that is broadcast.
Second pass: phrases whose bits are set are counted by their words, so neither fingerprints nor bits decide a result.

Pieces are split at ``.,;:!?`` and U+000A to U+000D, words at spaces and tabs, after lower-casing A-Z. Nulls: a null text
is empty, a null language is ``und``. Repeated rows and rows of equal id all count. Ties go by the phrase in the order of
its bytes. Very long texts and words are counted whole. Without words there are no rows. Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kernels import ODD, Slice, Spans, U, byte_table, mix, slices, spread
from .shared import BATCH_BYTES, removed, small_batches, written

LONGEST, THRESHOLD, TOP = 4, 30, 2000
#: A candidate goes where a longer phrase that holds it has so many hundredths of its occurrences.
COVERED = 80
SCALE = 2_000_000
#: Counters of the summary of one hash partition.
CAPACITY = 1 << 19
#: Bits of the broadcast table of survivors.
BITS = 1 << 27
#: Fingerprints that a task gathers before it hands a summary on.
GATHER = 1 << 22
UNKNOWN = "und"
_BREAKS = b".,;:!?\n\x0b\x0c\r"
BREAK, GAP = byte_table(_BREAKS), byte_table(_BREAKS + b" \t")
LOW = U(0xFFFFFFFF)


class Phrases:
    """The words of a slice of texts and all phrases in them."""

    def __init__(self, piece: Slice, codes: np.ndarray, seeds: np.ndarray):
        piece = piece.lowered()
        self.words: Spans = piece.runs(GAP)
        self.home = self.words.home()
        self.code = codes[self.home]
        # equal for words of one piece of one text, rising elsewhere
        self.part = np.cumsum(BREAK[piece.data])[self.words.start] + self.home
        self.hash = self.words.hashes()
        self._seeds = seeds

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each phrase of n words."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.part[n - 1 :] == self.part[:m])
        total = self._seeds[self.code[at]] + ODD[4060 + n]
        for j in range(n):
            total += self.hash[at + j] * ODD[j]
        return at, mix(total)

    def ids(self) -> np.ndarray:
        """A number for each word; equal numbers only for equal words."""
        _, first, place = np.unique(self.hash, return_index=True, return_inverse=True)
        w = self.words
        same = w.piece.same_bytes(w.start, w.end, w.start[first][place], w.end[first][place])
        return np.where(same, place, len(first) + np.arange(len(place)))

    def texts(self, at: np.ndarray, n: int) -> pa.Array:
        """The phrases of n words that begin at the words ``at``, joined by spaces."""
        data = self.words.piece.data
        begin = np.full((len(at), 2 * n - 1), len(data))
        size = np.ones((len(at), 2 * n - 1), np.int64)
        word = at[:, None] + np.arange(n)
        begin[:, ::2], size[:, ::2] = self.words.start[word], (self.words.end - self.words.start)[word]
        flat, first = spread(np.append(data, np.uint8(0x20)), begin.ravel(), size.ravel())
        first = first[:: 2 * n - 1] if len(at) else np.zeros(1, np.int64)
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.ascontiguousarray(first, np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.string())


def _phrases(batch: pa.RecordBatch) -> Iterator[tuple[Phrases, list[str]]]:
    lang = batch["lang"].cast(pa.string()).fill_null(UNKNOWN).dictionary_encode()
    names = lang.dictionary.to_pylist()
    seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], np.uint64)
    codes = lang.indices.to_numpy()
    for piece in slices(batch["text"], BATCH_BYTES):
        if len(piece.data):
            yield Phrases(piece, codes[piece.lo : piece.hi], seeds), names


def place(h: np.ndarray, buckets: int) -> np.ndarray:
    """Hash partition (upper half) and fingerprint in it (lower half) of each hash."""
    return (((h >> U(32)) * U(buckets)) >> U(32) << U(32)) | (h & LOW)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, counts, len(keys)).astype(np.int64)


class Summary:
    """Misra-Gries counters of one hash partition; summaries merge by adding them up and cutting what is too much."""

    def __init__(self, capacity: int, threshold: int):
        self.capacity, self.threshold, self.cut = capacity, threshold, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self._new: list[tuple[np.ndarray, np.ndarray]] = []
        self._waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._new.append((keys, counts))
        self._waiting += len(keys)
        if self._waiting > self.capacity // 2:
            self.merge()

    def merge(self) -> None:
        parts = [(self.keys, self.counts), *self._new]
        self.keys, self.counts = summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        self._new, self._waiting = [], 0
        over = len(self.keys) - self.capacity
        if over > 0:
            # the largest count that doesn't fit in; no cut may reach the threshold, the table grows instead
            off = int(np.partition(self.counts, over - 1)[over - 1])
            if self.cut + off < self.threshold:
                self.cut += off
                self.counts -= off
                stay = self.counts > 0
                self.keys, self.counts = self.keys[stay], self.counts[stay]

    def frequent(self) -> np.ndarray:
        """All fingerprints that may have occurred as often as the threshold says."""
        self.merge()
        return self.keys[self.counts + self.cut >= self.threshold]


def summaries(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, keys, counts: the phrases of a part of the texts, as fingerprints by hash partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            keys, counts = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            bucket = (keys >> U(32)).astype(np.int64)
            first = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1))
            edge = pa.py_buffer((np.append(first, len(keys)) * 4).astype(np.int32))
            blob = lambda x: pa.Array.from_buffers(pa.binary(), len(first), [None, edge, pa.py_buffer(x)])
            return pa.record_batch({"bucket": pa.array(bucket[first]), "keys": blob((keys & LOW).astype("<u4")), "counts": blob(counts.astype("<i4"))})

        for batch in batches:
            for phrases, _ in _phrases(batch):
                for n in range(1, LONGEST + 1):
                    keys, counts = np.unique(place(phrases.of(n)[1], buckets), return_counts=True)
                    held.append((keys, counts))
                if sum(len(k) for k, _ in held) > GATHER:
                    yield out()
        if any(len(k) for k, _ in held):
            yield out()

    return docs.select("text", "lang").mapInArrow(run, "bucket long, keys binary, counts binary")


def _bits(fingerprint: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places among ``size`` bits."""
    h = mix(fingerprint.astype(np.uint64) + ODD[4091])
    return ((h & LOW) * U(size) >> U(32)).astype(np.int64), ((h >> U(32)) * U(size) >> U(32)).astype(np.int64)


class Survivors:
    """The bit table: one segment for each hash partition."""

    def __init__(self, buckets: int, segments: dict[int, bytes]):
        self.buckets, self.bytes = buckets, segment_bytes(buckets)
        self.table = np.zeros(buckets * self.bytes, np.uint8)
        for b, bits in segments.items():
            self.table[b * self.bytes : (b + 1) * self.bytes] = np.frombuffer(bits, np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        key = place(h, self.buckets)
        base = (key >> U(32)).astype(np.int64) * (8 * self.bytes)
        hit = np.ones(len(h), bool)
        for at in _bits(key & LOW, 8 * self.bytes):
            at = at + base
            hit &= (self.table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return hit


def segment_bytes(buckets: int) -> int:
    return max(BITS // 8 // buckets, 8)


def survivors(docs: DataFrame, threshold: int, buckets: int, capacity: int = CAPACITY) -> Survivors:
    size = 8 * segment_bytes(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, Summary] = {}
        for batch in batches:
            for b, keys, counts in zip(batch["bucket"].to_pylist(), batch["keys"], batch["counts"], strict=True):
                part = parts.setdefault(b, Summary(capacity, threshold))
                part.add(np.frombuffer(keys.as_buffer(), "<u4").copy(), np.frombuffer(counts.as_buffer(), "<i4").astype(np.int64))
        for b, part in parts.items():
            bits = np.zeros(size, bool)
            for at in _bits(part.frequent(), size):
                bits[at] = True
            yield pa.record_batch({"bucket": pa.array([b]), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    merged = summaries(docs, buckets).repartition(buckets, "bucket").mapInArrow(run, "bucket long, bits binary")
    return Survivors(buckets, {r.bucket: bytes(r.bits) for r in merged.toLocalIterator()})


def counts(docs: DataFrame, threshold: int = THRESHOLD, capacity: int = CAPACITY) -> DataFrame:
    """lang, n_words, phrase, f: every phrase of 1 to LONGEST words that occurs as often as the threshold; n_words 0 is the number of all words."""
    small_batches(docs.sparkSession)
    docs = docs.select("text", "lang")
    # a text of b bytes has b/2 words at most and LONGEST phrases begin at each
    mass = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * LONGEST // 2
    known = docs.sparkSession.sparkContext.broadcast(survivors(docs, threshold, mass // threshold // capacity + 1, capacity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for phrases, names in _phrases(batch):
                if not len(phrases.hash):
                    continue
                ids = phrases.ids()
                for n in range(1, LONGEST + 1):
                    at, h = phrases.of(n)
                    hit = known.value.has(h)
                    at, h = at[hit], h[hit]
                    _, first, group = np.unique(h, return_index=True, return_inverse=True)
                    lead = at[first][group]
                    same = phrases.code[at] == phrases.code[lead]
                    for j in range(n):
                        same &= ids[at + j] == ids[lead + j]
                    # phrases of one hash that differ in a word are handed on one by one
                    reps = np.concatenate((at[first], at[~same]))
                    c = np.concatenate((np.bincount(group[same], minlength=len(first)), np.ones(np.count_nonzero(~same), np.int64)))
                    yield _rows(names, phrases.code[reps], n, phrases.texts(reps, n), c)
                total = np.bincount(phrases.code, minlength=len(names))
                yield _rows(names, np.arange(len(names)), 0, pa.array([""] * len(names)), total)

    each = docs.mapInArrow(run, "lang string, n_words int, phrase string, c long")
    return each.groupBy("lang", "n_words", "phrase").agg(F.sum("c").alias("f")).where((F.col("f") >= threshold) | (F.col("n_words") == 0))


def _rows(names: list[str], code: np.ndarray, n: int, phrase: pa.Array, c: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"lang": pa.array(names, pa.string()).take(pa.array(code)), "n_words": pa.array(np.full(len(code), n, np.int32)), "phrase": phrase, "c": pa.array(c.astype(np.int64))})


def wide(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def collocations(docs: DataFrame, threshold: int = THRESHOLD, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of 2 to LONGEST words of each language.

    score is the least floor(SCALE a / (l + r)) over the cuts of the phrase into two; of equal cuts the first counts.
    """
    found = written(counts(docs, threshold), "phrases")
    words = F.split("phrase", " ")
    part = lambda begin, size: F.array_join(F.slice("w", begin, size), " ")
    phrases = found.where("n_words > 1").select("lang", "phrase", "n_words", F.col("f").alias("a"), words.alias("w"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("tail"))
    f = found.where(f"n_words BETWEEN 1 AND {LONGEST - 1}")
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(f.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cuts = cuts.withColumn("score", F.expr(f"(CAST(a AS DECIMAL(20,0)) * {SCALE}) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    inner = F.expr("flatten(transform(sequence(2, n_words - 1), s -> transform(sequence(1, n_words - s + 1), i -> array_join(slice(w, i, s), ' '))))")
    longer = phrases.where("n_words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("c")).groupBy("lang", "phrase").agg(F.max("c").alias("c"))
    scored = scored.join(longer, ["lang", "phrase"], "left").where(F.col("c").isNull() | (wide("c") * 100 < wide("a") * COVERED))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    total = found.where("n_words = 0").select("lang", F.col("f").alias("n"))
    best = scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).join(total, "lang")
    out = written(best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    removed(found)
    return out
