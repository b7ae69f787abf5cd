"""Operator 13: hard negatives from exact integer scores in a residue number system.

Components are whole steps (floor of ``scale`` times the component). Blocks of rows meet blocks of anchors in matrix
products modulo several primes below 256, in float32, whose sums stay whole; as many primes are taken as the largest
component in a block of rows and anchors needs, and the Chinese remainder theorem (mixed radix digits around zero) gives
back each signed score. Each task keeps the best rows for each anchor, windows choose among the tasks.

Anchors are a stated set: they go out in blocks of ANCHOR_BYTES, and each block scans all rows twice, once for the
positives of its anchors and once for the negatives in the range of each positive. ``vectors`` is read for each block, so
what is costly to derive should be a written table.

A row with a null label, a null vector or a null or non-finite component takes no part; neither does one with a component
beyond 2**LARGEST steps. Vectors of unequal length: missing components are zero. A null id is never an anchor and comes
last among ties. Rows of one id are rows of their own: an anchor leaves out only itself. Scores beyond 64 bits count as
the largest that fits. Repeated anchors give repeated rows. Without anchors there are no rows. Further columns are not
looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import shared_dir, small_batches

#: Bytes of the anchors (eight for each component) in one block.
ANCHOR_BYTES = 8 << 20
#: Rows and anchors of one product.
ROWS, ANCHORS = 2048, 512
PRIMES = [p for p in range(255, 2, -1) if all(p % d for d in range(2, int(p**0.5) + 1))]
#: Components of one product: sums of so many balanced residues stay below 2**23, so float32 holds them whole.
DEPTH = (1 << 23) // (PRIMES[0] // 2) ** 2
LARGEST = 150
#: No score, and the id after all others.
NONE, NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def primes_for(bound: int) -> list[int]:
    """So many primes that their product tells all whole numbers from -bound to bound apart."""
    product, out = 1, []
    for p in PRIMES:
        if product > 2 * bound:
            break
        product *= p
        out.append(p)
    return out


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """Residues of whole float32 numbers below 2**23, from -(p-1)/2 to (p-1)/2."""
    p = np.float32(p)
    x = x - p * np.rint(x / p)
    half = (p - 1) / 2
    x -= p * (x > half)
    x += p * (x < -half)
    return x


def residues(q: np.ndarray, p: int) -> np.ndarray:
    """The same for whole float64 numbers of any size, as float32."""
    r = np.fmod(q, p).astype(np.float32)
    return balanced(r, p)


def product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a times b transposed, modulo p."""
    total = None
    for k in range(0, max(a.shape[1], 1), DEPTH):
        part = balanced(a[:, k : k + DEPTH] @ b[:, k : k + DEPTH].T, p)
        total = part if total is None else balanced(total + part, p)
    return total


def reconstruct(parts: list[np.ndarray], primes: list[int], bound: int) -> np.ndarray:
    """The signed numbers that have these residues, by mixed radix digits; beyond 64 bits the largest that fits."""
    digits: list[np.ndarray] = []
    for i, p in enumerate(primes):
        d = parts[i]
        for j, q in enumerate(primes[:i]):
            d = balanced(balanced(d - digits[j], p) * np.float32(pow(q, -1, p)), p)
        digits.append(d)
    value, weight = np.zeros(parts[0].shape, np.int64), 1
    for d, p in zip(digits, primes, strict=True):
        # arithmetic modulo 2**64 is right for every value that fits
        signed = (weight + (1 << 63)) % (1 << 64) - (1 << 63)
        value += d.astype(np.int64) * np.int64(signed)
        weight *= p
    if bound >= 1 << 62:
        about, weight = np.zeros(value.shape), 1
        for d, p in zip(digits, primes, strict=True):
            about += d.astype(np.float64) * float(weight)
            weight *= p
        value = np.where(about >= 2.0**63, NO_ID, np.where(about <= -(2.0**63), -NO_ID, value))
    return value


class Matrix:
    """Whole components of a block of rows, with their residues by prime."""

    def __init__(self, q: np.ndarray):
        self.q = q
        self.largest = int(np.abs(q).max()) if q.size else 0
        self._by: dict[int, np.ndarray] = {}

    def modulo(self, p: int) -> np.ndarray:
        if p not in self._by:
            self._by[p] = residues(self.q, p)
        return self._by[p]


def scores(rows: Matrix, anchors: Matrix) -> np.ndarray:
    """Exact inner products, rows by anchors."""
    depth = min(rows.q.shape[1], anchors.q.shape[1])
    bound = depth * rows.largest * anchors.largest
    if not bound:
        return np.zeros((len(rows.q), len(anchors.q)), np.int64)
    primes = primes_for(bound)
    return reconstruct([product(rows.modulo(p)[:, :depth], anchors.modulo(p)[:, :depth], p) for p in primes], primes, bound)


class Best:
    """The k best (score, then least id) of each of a number of windows, over all that was offered."""

    def __init__(self, windows: int, k: int):
        self.k = k
        self.score, self.id = np.full((windows, k), NONE), np.full((windows, k), NO_ID)

    def offer(self, window: np.ndarray, score: np.ndarray, ids: np.ndarray, valid: np.ndarray) -> None:
        """``score`` and ``valid`` are rows by windows, rows in the order of their ids; ``window`` numbers the columns."""
        k = self.k
        last, last_id = self.score[window, -1], self.id[window, -1]
        valid &= score >= last
        valid &= (score > last) | (ids[:, None] < last_id)
        if len(ids) > k and np.count_nonzero(valid) > 4 * k * len(window):
            # of each column only its k best, of ties the first k, so that equal vectors don't swell what is sorted
            masked = np.where(valid, score, NONE)
            limit = np.partition(masked, len(ids) - k, axis=0)[len(ids) - k]
            tie = valid & (score == limit)
            tie &= np.cumsum(tie, axis=0, dtype=np.int32) <= k
            valid &= score > limit
            valid |= tie
        row, column = np.nonzero(valid)
        if not len(row):
            return
        touched = np.unique(column)
        w = np.concatenate((column, np.repeat(touched, k)))
        s = np.concatenate((score[row, column], self.score[window[touched]].ravel()))
        i = np.concatenate((ids[row], self.id[window[touched]].ravel()))
        order = np.lexsort((i, -s, w))
        order = order[s[order] != NONE]
        w, s, i = w[order], s[order], i[order]
        place = np.arange(len(w)) - np.searchsorted(w, w)
        keep = place < k
        w, s, i, place = window[w[keep]], s[keep], i[keep], place[keep]
        self.score[w, place], self.id[w, place] = s, i

    def rows(self) -> pa.RecordBatch:
        window, place = np.nonzero(self.score != NONE)
        return pa.record_batch({"w": pa.array(window), "score": pa.array(self.score[window, place]), "id": pa.array(self.id[window, place])})


BEST_DDL = "w long, score long, id long"


def steps(column: pa.Array, scale: int) -> np.ndarray:
    """The components of a list column in whole steps, as float64; missing ones are zero."""
    values = np.asarray(column.flatten(), np.float64)
    n = column.value_lengths().to_numpy().astype(np.int64)
    out = np.zeros((len(n), int(n.max()) if len(n) else 0))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)] = np.floor(scale * values)
    return out


def taking_part(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, embedding of the rows that can be scored."""
    good = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) <= 2.0**LARGEST / scale), F.lit(False))
    return vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall(F.col("embedding").cast("array<double>"), good)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")


class Block:
    """Anchors with their labels in rising order, and the ranges of the scores that are looked for."""

    def __init__(self, anchors: list[tuple[int, int, np.ndarray]]):
        anchors = sorted(anchors, key=lambda x: x[1])
        self.id, self.label = np.array([x[0] for x in anchors], np.int64), np.array([x[1] for x in anchors], np.int64)
        self.q = np.zeros((len(anchors), max(len(x[2]) for x in anchors)))
        for k, (_, _, q) in enumerate(anchors):
            self.q[k, : len(q)] = q
        own = [min(sum(int(x) ** 2 for x in q), int(NO_ID)) for _, _, q in anchors]
        self.own = np.array(own, np.int64)

    def __len__(self) -> int:
        return len(self.id)


def _blocks(rows: DataFrame, is_anchor: Column, scale: int) -> Iterator[Block]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, n = steps(batch["embedding"], scale), batch["embedding"].value_lengths().to_pylist()
            yield pa.record_batch({"id": batch["vec_id"], "label": batch["label"], "q": pa.array([row[:m].tobytes() for row, m in zip(q, n, strict=True)], pa.binary())})

    held, size = [], 0
    for r in rows.where(is_anchor).mapInArrow(pack, "id long, label long, q binary").toLocalIterator():
        held.append((r.id, r.label, np.frombuffer(r.q)))
        size += len(r.q) + 64
        if size >= ANCHOR_BYTES:
            yield Block(held)
            held, size = [], 0
    if held:
        yield Block(held)


def _batches(batches: Iterator[pa.RecordBatch], scale: int, by_label: bool) -> Iterator[tuple[np.ndarray, np.ndarray, Matrix]]:
    """ids, labels and components of at most ROWS rows in the order of their ids, of one label each if asked."""
    for batch in batches:
        ids = batch["vec_id"].fill_null(NO_ID).to_numpy()
        labels = batch["label"].to_numpy()
        q = steps(batch["embedding"], scale)
        order = np.lexsort((ids, labels)) if by_label else np.argsort(ids, kind="stable")
        edges = np.flatnonzero(np.diff(labels[order], prepend=labels[order[:1]])) if by_label and len(order) else np.zeros(0, np.int64)
        for part in np.split(order, edges):
            # an empty batch has one empty part and yields nothing
            for k in range(0, len(part), ROWS):
                at = part[k : k + ROWS]
                yield ids[at], labels[at], Matrix(q[at])


def _positives(rows: DataFrame, block: Block, k: int, scale: int) -> list[list[tuple[int, int]]]:
    """For each anchor of the block its best other rows of its label, as (score, id)."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        best = Best(len(own), k + 1)
        for ids, labels, m in _batches(batches, scale, by_label=True):
            lo, hi = np.searchsorted(own.label, labels[0]), np.searchsorted(own.label, labels[0], side="right")
            for a in range(lo, hi, ANCHORS):
                b = min(a + ANCHORS, hi)
                s = scores(m, Matrix(own.q[a:b]))
                best.offer(np.arange(a, b), s, ids, np.ones(s.shape, bool))
        yield best.rows()

    place = F.row_number().over(W.partitionBy("w").orderBy(F.desc("score"), "id"))
    found = rows.mapInArrow(run, BEST_DDL).withColumn("place", place).where(F.col("place") <= k + 1).collect()
    shared.unpersist()
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(block))]
    for r in sorted(found, key=lambda r: (r.w, r.place)):
        out[r.w].append((r.score, r.id))
    for each, own_id, own_score in zip(out, block.id.tolist(), block.own.tolist(), strict=True):
        # rows that equal the anchor in id and score can't be told from it, and one of them is the anchor
        if (own_score, own_id) in each:
            each.remove((own_score, own_id))
        del each[k:]
    return out


def _negatives(rows: DataFrame, block: Block, positives: list[list[tuple[int, int]]], k: int, low: int, high: int, scale: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the block."""
    window = [(a, s, i) for a, each in enumerate(positives) for s, i in each]
    anchor = np.array([a for a, _, _ in window], np.int64)
    # low * s <= 100 * x <= high * s
    least = np.array([-((-low * s) // 100) for _, s, _ in window], np.int64)
    most = np.array([high * s // 100 for _, s, _ in window], np.int64)
    score, positive = (np.array([x[j] for x in window], np.int64) for j in (1, 2))
    shared = rows.sparkSession.sparkContext.broadcast((block, anchor, least, most, score, positive))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, anchor, least, most, _, _ = shared.value
        best = Best(len(anchor), k)
        tiles = [(a, min(a + ANCHORS, len(own))) for a in range(0, len(own), ANCHORS)]
        anchors = [Matrix(own.q[a:b]) for a, b in tiles]
        # the windows of a tile by their number among those of the anchor: each set meets a score column once
        nth = np.arange(len(anchor)) - np.searchsorted(anchor, anchor)
        sets = [[np.flatnonzero((anchor >= a) & (anchor < b) & (nth == j)) for j in range(nth.max(initial=-1) + 1)] for a, b in tiles]
        for ids, labels, m in _batches(batches, scale, by_label=False):
            for (a, b), other, windows in zip(tiles, anchors, sets, strict=True):
                s = scores(m, other)
                differs = labels[:, None] != own.label[a:b]
                for w in windows:
                    if len(w):
                        column = anchor[w] - a
                        x = s[:, column]
                        best.offer(w, x, ids, differs[:, column] & (x >= least[w]) & (x <= most[w]))
        yield best.rows()

    place = F.row_number().over(W.partitionBy("w").orderBy(F.desc("score"), "id"))
    ranked = rows.mapInArrow(run, BEST_DDL).withColumn("rank", place).where(F.col("rank") <= k)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, anchor, _, _, score, positive = shared.value
        for batch in batches:
            w = batch["w"].to_numpy()
            known = lambda x: pa.array(x, mask=x == NO_ID)
            yield pa.record_batch({"anchor_id": pa.array(own.id[anchor[w]]), "positive_id": known(positive[w]), "rank": batch["rank"], "negative_id": known(batch["id"].to_numpy()), "positive_score": pa.array(score[w]), "negative_score": batch["score"]})

    return ranked.mapInArrow(named, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """For each anchor and each of its best rows of the same label, the best rows of other labels in a range of scores.

    ``vectors``: vec_id, embedding, label. The range is low to high hundredths of the positive's score.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = taking_part(vectors, scale)
    path = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for block in _blocks(rows, F.coalesce(is_anchor, F.lit(False)), scale):
        _negatives(rows, block, _positives(rows, block, positives, scale), negatives, low, high, scale).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
