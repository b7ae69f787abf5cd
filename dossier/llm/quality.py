"""Operator 1: quality rules.

Counting rules first, then a logistic regression on hashed word and character n-grams. It is fitted on a bounded
sample of labelled rows, its scores are calibrated to probabilities on rows kept out of the fit, and every whole text
is scored in Arrow batches against a fixed threshold.

Nulls: a null text has no words and fails the counting rules; a null label or a label without a document is not used;
a null doc_id is carried through. Repeated rows each get their row; of several labels of one id the lowest counts, of
several texts the least. Without labelled rows of both kinds (or without documents) there is no model, and the counting
rules decide alone. Very long texts are counted and scored whole. Columns beyond doc_id and text are not looked at:
``score`` replaces those named like its results, ``drop_rejected`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import ODD, SPACE, Slice, U, byte_table, mix, slices
from .shared import ddl, free_names, plain_names, small_batches

#: At most so many labelled documents are fitted and calibrated on (those with the smallest hash of their id).
SAMPLE_ROWS = 2000
#: Hash buckets of word n-grams, and again of character n-grams.
BUCKETS = 1 << 14
#: Probability of good quality from which a document stays.
KEEP_FROM = 0.5
MIN_WORDS, MAX_REPEATED, REPEAT_WINDOW = 20, 30, 8
SYMBOLS = byte_table(b"#*$%&|<>")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
RESULTS = (*COUNTS, "p_quality", "kept")
KINDS = ("long",) * 5 + ("boolean", "double", "boolean")
_SHIFT = U(64 - 14)


@dataclass
class Model:
    """One weight for each bucket, an offset, and the line that turns the sum into a log odds."""

    weights: np.ndarray
    offset: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (z + self.offset) + self.shift, -40, 40)))


def counted(piece: Slice) -> tuple[dict[str, np.ndarray], object, np.ndarray]:
    """The counts of the rules for each text, with its words and their hashes."""
    data, words = piece.data, piece.runs(SPACE)
    h = words.hashes()
    out = {"n_words": words.count, "word_chars": piece.per_text(((data & 0xC0) != 0x80) & ~SPACE[data]), "n_symbols": piece.per_text(SYMBOLS[data])}
    lines = piece.lines()
    filled = np.concatenate(([0], np.cumsum(~SPACE[data])))
    home, key = lines.home(), lines.hashes()
    some = filled[lines.end] > filled[lines.start]
    home, key = home[some], key[some]
    order = np.lexsort((key, home))
    again = np.zeros(len(order), bool)
    again[1:] = (home[order][1:] == home[order][:-1]) & (key[order][1:] == key[order][:-1])
    out["n_dup_lines"] = np.bincount(home[order][again], minlength=len(piece))
    seen, at = words.windows(h, REPEAT_WINDOW)
    seen = mix(seen + words.home()[at].astype(np.uint64) * ODD[4093])
    order = np.argsort(seen, kind="stable")
    same = seen[order][1:] == seen[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(h) + 1, np.int64)
    first = at[order[twice]]
    np.add.at(cover, first, 1)
    np.add.at(cover, first + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = words.total((np.cumsum(cover)[:-1] > 0).astype(np.int64))
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEATED * out["n_words"])
    return out, words, h


def _grams(piece: Slice, words, h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets of the features, and where those of each text begin and end: single words, pairs, runs of 3 and 4 bytes."""
    out = [((h >> _SHIFT).astype(np.int64), words.first[:-1], words.first[1:])]
    if len(h) > 1:
        pair = mix(h[:-1] * ODD[0] + h[1:] * ODD[1])
        begin = np.minimum(words.first[:-1], len(pair))
        out.append(((pair >> _SHIFT).astype(np.int64), begin, np.maximum(np.minimum(words.first[1:] - 1, len(pair)), begin)))
    data = piece.data.astype(np.uint64)
    for n in (3, 4):
        if len(data) >= n:
            gram = sum(data[j : len(data) - n + 1 + j] << U(8 * j) for j in range(n)) + U(n << 40)
            begin = np.minimum(piece.offs[:-1], len(gram))
            out.append((BUCKETS + (gram * ODD[2] >> _SHIFT).astype(np.int64), begin, np.maximum(np.minimum(piece.offs[1:] - n + 1, len(gram)), begin)))
    return out


def scores(model: Model, piece: Slice, words, h: np.ndarray) -> np.ndarray:
    """The weight of a text: of each feature kind the mean."""
    z = np.zeros(len(piece))
    for bucket, begin, end in _grams(piece, words, h):
        run = np.concatenate(([0.0], np.cumsum(model.weights[bucket])))
        z += (run[end] - run[begin]) / np.maximum(end - begin, 1)
    return z


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch["text"]):
            words = piece.runs(SPACE)
            grams = _grams(piece, words, words.hashes())
            rows = []
            for k in range(len(piece)):
                x = np.zeros(2 * BUCKETS, np.float32)
                for bucket, begin, end in grams:
                    if end[k] > begin[k]:
                        x += np.bincount(bucket[begin[k] : end[k]], minlength=2 * BUCKETS).astype(np.float32) / (end[k] - begin[k])
                at = np.flatnonzero(x)
                rows.append((at.astype(np.uint16).tobytes(), x[at].tobytes()))
            kept = batch.slice(piece.lo, len(piece))
            yield pa.record_batch({"doc_id": kept["doc_id"], "quality": kept["quality"], "at": pa.array([r[0] for r in rows], pa.binary()), "x": pa.array([r[1] for r in rows], pa.binary())})


class Rows:
    """Sparse rows (binary columns of buckets and of values) where Arrow has put them, in blocks of which a step needs one."""

    def __init__(self, at: pa.ChunkedArray, x: pa.ChunkedArray, block: int = 100):
        self.n, self.blocks = 0, []
        for a, v in zip(at.chunks, x.chunks, strict=True):
            for lo in range(0, len(a), block):
                ends, places = self._flat(a.slice(lo, block), np.uint16)
                _, values = self._flat(v.slice(lo, block), np.float32)
                self.blocks.append((self.n, np.diff(ends), places, values))
                self.n += len(ends) - 1

    @staticmethod
    def _flat(part: pa.BinaryArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
        _, offs, data = part.buffers()
        offs = np.frombuffer(offs, np.int32)[part.offset : part.offset + len(part) + 1] // np.dtype(kind).itemsize
        flat = np.frombuffer(data, kind, offs[-1]) if data is not None else np.zeros(0, kind)
        return offs, flat[offs[0] :]

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for lo, size, at, x in self.blocks:
            out[lo : lo + len(size)] = np.bincount(np.repeat(np.arange(len(size)), size), w[at] * x, len(size))
        return out

    def back(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros(2 * BUCKETS)
        for lo, size, at, x in self.blocks:
            out += np.bincount(at, x * np.repeat(r[lo : lo + len(size)], size), 2 * BUCKETS)
        return out


def _descent(rows: Rows, y: np.ndarray, use: np.ndarray, steps: int = 200, rate: float = 20.0, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression by adaptive full gradients over the rows in use."""
    w, b, seen, seen_b = np.zeros(2 * BUCKETS), 0.0, np.full(2 * BUCKETS, 1e-8), 1e-8
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows.dot(w) + b, -40, 40)))
        off = np.where(use, p - y, 0) / use.sum()
        g = rows.back(off) + ridge * w
        gb = float(off.sum())
        seen += g * g
        seen_b += gb * gb
        w -= rate * g / np.sqrt(seen) * 0.05
        b -= 0.1 * gb / seen_b**0.5
    return w, b


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fits on at most ``sample_rows`` labelled documents; each fifth is kept for the calibration."""
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    got = texts.mapInArrow(_sparse, "doc_id long, quality int, at binary, x binary").toArrow()
    y = got["quality"].to_numpy().astype(float)
    if len(np.unique(y)) < 2:
        return None
    order = np.random.Generator(np.random.PCG64(7)).permutation(len(y))
    held = np.zeros(len(y), bool)
    held[np.argsort(got["doc_id"].to_numpy(), kind="stable")[order[::5]]] = True
    rows = Rows(got["at"], got["x"])
    w, b = _descent(rows, y, ~held)
    model = Model(w, b)
    z, target = (rows.dot(w) + b)[held], y[held]
    # smoothed targets keep the slope finite where the two kinds are apart
    good, bad = (target == 1).sum(), (target == 0).sum()
    target = np.where(target == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    if good and bad:
        s, t = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(s * z + t, -40, 40)))
            r = np.maximum(p * (1 - p), 1e-9)
            hess = np.array([[np.sum(r * z * z) + 1e-6, np.sum(r * z)], [np.sum(r * z), np.sum(r) + 1e-6]])
            move = np.linalg.solve(hess, [np.sum((p - target) * z), np.sum(p - target)])
            s, t = s - np.clip(move[0], -2, 2), t - np.clip(move[1], -2, 2)
        model.slope, model.shift = float(max(s, 1e-3)), float(t)
    del got, rows
    pa.default_memory_pool().release_unused()
    return model


def score(docs: DataFrame, model: Model | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """All columns of ``docs`` (those with the names of results are replaced) with the counts, p_quality and kept."""
    return _scored(docs.drop(*RESULTS), model, keep_from, list(RESULTS))


def _scored(docs: DataFrame, model: Model | None, keep_from: float, names: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for piece in slices(batch["text"]):
                got, words, h = counted(piece)
                p = np.ones(len(piece)) if known is None else known.probability(scores(known, piece, words, h))
                rows = batch.slice(piece.lo, len(piece))
                own = [*(pa.array(got[k]) for k in COUNTS), pa.array(np.round(p, 6)), pa.array(~got["base_failed"] & (p >= keep_from))]
                yield pa.record_batch({n: rows[n] for n in fields} | dict(zip(names, own, strict=True)))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, ", ".join([ddl(docs), *(f"`{n}` {k}" for n, k in zip(names, KINDS, strict=True))]))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, p_quality and kept for each row of ``docs``."""
    return score(docs.select("doc_id", "text"), fit(docs, labels)).drop("text")


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    plain = plain_names(docs)
    names = free_names(plain, *RESULTS)
    return _scored(plain, fit(plain, labels), KEEP_FROM, names).where(F.col(names[-1])).select(*plain.columns).toDF(*docs.columns)
