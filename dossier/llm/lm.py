"""Operator 8: language-model scores from a hashed maximum-entropy model.

The next word is predicted in three factors: its group, its class within the group, and the word within the class.
Groups and classes are softmaxes over hashed features of the context (the word before, the two words before, the word
before that one, and a constant); the word within its class has its smoothed share. The weights come from
gradient steps over all training documents: in each round every task (a part of the input of Spark's usual size) starts
from the same weights and walks over its documents in small batches; the tasks' weights are cut into pieces, and each
piece is averaged where the shuffle puts it. Texts are scored in numpy batches in which only the rows of the features
that occur are read.

Counts cover every training token. The most frequent TOP words have a class each, the other KNOWN ones share a class
by their ending, and all rarer words share the class of rare words, where an unseen word has the share of one more
count. The KNOWN words and the weights are bounded and broadcast; counts of rarer words are looked up by a join.

Words are split at ASCII white space after lower-casing A-Z, and each text ends with one end token. Nulls: a null text
has the end token only; a null id is not held out. Repeated rows count as often as they occur. With no training
document the counts are zero, the score is the base score. Of words of equal count those of the lower hash come first.
Very long texts are walked in parts and scored whole. Further columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import ODD, SPACE, Slice, Spans, U, lists, mix, slices
from .shared import removed, small_batches, written

#: Words whose counts are broadcast.
KNOWN = 1 << 18
GROUPS = CLASSES = 16
#: Slots (group, class): 0 for rare words, then endings, then single words.
ENDINGS = 63
TOP = GROUPS * CLASSES - ENDINGS - 1
#: Hash buckets of the features, feature kinds, rounds, step size, and bytes of text in one step.
BUCKETS, KINDS, ROUNDS, RATE, STEP_BYTES = 1 << 12, 4, 2, 0.3, 1 << 15
HELD_OUT_OF, HELD_OUT = 7, 2
#: The training tokens a task gathers before it hands its counts on.
GATHER = 1 << 20
#: Pieces in which the weights of the tasks are averaged, and the bound of a sum of weights.
PIECES, LIMIT = 64, 30.0
END = U(0xE0D)


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % HELD_OUT_OF == HELD_OUT


def tokens(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token with the end tokens in their places, and where each text's begin."""
    h, first, _ = _tokens(piece)
    return h, first


def tokens_and_endings(piece: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens with the class of the ending of each."""
    h, first, (words, place) = _tokens(piece)
    ending = np.zeros(len(h), np.int64)
    ending[place] = 1 + (words.piece.span_hash(np.maximum(words.end - 3, words.start), words.end) % U(ENDINGS)).astype(np.int64)
    return h, first, ending


def _tokens(piece: Slice) -> tuple[np.ndarray, np.ndarray, tuple[Spans, np.ndarray]]:
    piece = piece.lowered()
    words = piece.runs(SPACE)
    n = len(words.start)
    place = np.arange(n) + words.home()
    h = np.full(n + len(piece), END)
    h[place] = words.hashes()
    return h, words.first + np.arange(len(piece) + 1), (words, place)


def counts(docs: DataFrame) -> DataFrame:
    """h, c, ending: how often each token occurs in the training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []

        def merged() -> tuple[np.ndarray, ...]:
            h, c, e = (np.concatenate(x) for x in zip(*parts, strict=True))
            h, first, place = np.unique(h, return_index=True, return_inverse=True)
            return h, np.bincount(place, c).astype(np.int64), e[first]

        def out(h, c, e):
            return pa.record_batch({"h": pa.array(h.view(np.int64)), "c": pa.array(c), "ending": pa.array(e.astype(np.int32))})

        for batch in batches:
            held = np.array([is_held_out(i) for i in batch["doc_id"].to_pylist()], bool)
            for piece in slices(batch["text"]):
                h, first, ending = tokens_and_endings(piece)
                keep = np.repeat(~held[piece.lo : piece.hi], np.diff(first))
                h, at, n = np.unique(h[keep], return_index=True, return_counts=True)
                parts.append((h, n, ending[keep][at]))
                if sum(len(p[0]) for p in parts) > GATHER:
                    parts[:] = [merged()]
                    if len(parts[0][0]) > GATHER // 2:
                        yield out(*parts.pop())
        if parts:
            yield out(*merged())

    each = docs.select("doc_id", "text").mapInArrow(run, "h long, c long, ending int")
    return each.groupBy("h").agg(F.sum("c").alias("c"), F.max("ending").alias("ending"))


@dataclass
class Vocabulary:
    """The KNOWN words by hash: count, slot, and share of their class; the last is for rare words."""

    hashes: np.ndarray
    count: np.ndarray
    slot: np.ndarray
    share: np.ndarray
    total: int
    distinct: int
    rare_total: int
    rare_distinct: int

    def __post_init__(self):
        """A table of places by the first bits of the hash; what finds its slot taken goes to the next."""
        self.bits = max(4, int(4 * len(self.hashes)).bit_length())
        self.table = np.full((1 << self.bits) + len(self.hashes), -1, np.int32)
        todo = np.arange(len(self.hashes))
        slot = (self.hashes >> U(64 - self.bits)).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self.table[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            took = free[one]
            self.table[slot[took]] = todo[took]
            left = np.ones(len(todo), bool)
            left[took] = False
            todo, slot = todo[left], slot[left] + 1

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        out = np.full(len(h), -1)
        if not len(self.hashes):
            return out
        at, slot = np.arange(len(h)), (h >> U(64 - self.bits)).astype(np.int64)
        while len(at):
            place = self.table[slot]
            hit = (self.hashes[place] == h[at]) & (place >= 0)
            out[at[hit]] = place[hit]
            more = (place >= 0) & ~hit
            at, slot = at[more], slot[more] + 1
        return out


def vocabulary(table: DataFrame, known: int = KNOWN) -> Vocabulary:
    total, distinct = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    left, least = known, None
    for c, n in table.groupBy("c").count().orderBy(F.desc("c")).limit(known).collect():
        if n > left:
            break
        left, least = left - n, c
    rows = table.where(F.col("c") >= least if least is not None else F.lit(False)).toPandas()
    rows = rows.sort_values(["c", "h"], ascending=[False, True])
    count = rows["c"].to_numpy(np.int64)
    slot = rows["ending"].to_numpy(np.int64).copy()
    slot[:TOP] = ENDINGS + 1 + np.arange(min(TOP, len(slot)))
    # the end token has no ending of its own; where it isn't among the top words it shares the first
    slot[slot == 0] = 1
    share = count / np.bincount(slot, count, GROUPS * CLASSES)[slot]
    h = rows["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return Vocabulary(h[order], count[order], slot[order], share[order], int(total), int(distinct), int(total - count.sum()), int(distinct - len(count)))


def context(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Feature buckets of each token: constant, previous, previous two, the one before the previous."""
    begin = np.zeros(len(h), bool)
    begin[first[:-1]] = True
    one = np.concatenate(([U(1)], h[:-1]))
    one[begin] = 1
    two = np.concatenate(([U(1)], one[:-1]))
    two[begin] = 2
    out = np.empty((len(h), KINDS), np.int64, order="F")
    out[:, 0] = 0
    for k, x in enumerate((one * ODD[20], mix(one * ODD[21] + two * ODD[22]), two * ODD[23]), 1):
        out[:, k] = 1 + (mix(x) % U(BUCKETS - 1)).astype(np.int64)
    return out


def _softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = np.take(weights, rows[:, 0], axis=0)
    for k in range(1, rows.shape[1]):
        z += np.take(weights, rows[:, k], axis=0)
    np.clip(z, -LIMIT, LIMIT, out=z)
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], z.dtype))[:, None]
    return z


def _rows(features: np.ndarray, group: np.ndarray) -> np.ndarray:
    return features * GROUPS + group[:, None]


class Weights:
    """Weights of the groups (a row for each bucket) and of the classes (for each bucket and group)."""

    def __init__(self, flat: np.ndarray | None = None):
        n = BUCKETS * (GROUPS + GROUPS * CLASSES)
        self.flat = np.zeros(n, np.float32) if flat is None else flat
        self.group = self.flat[: BUCKETS * GROUPS].reshape(BUCKETS, GROUPS)
        self.cls = self.flat[BUCKETS * GROUPS :].reshape(BUCKETS * GROUPS, CLASSES)

    def log10(self, features: np.ndarray, slot: np.ndarray) -> np.ndarray:
        at = np.arange(len(slot))
        group, cls = slot // CLASSES, slot % CLASSES
        p = _softmax(self.group, features)[at, group] * _softmax(self.cls, _rows(features, group))[at, cls]
        return np.log10(np.maximum(p, 1e-30))


def _step(table: np.ndarray, seen: np.ndarray, rows: np.ndarray, target: np.ndarray) -> None:
    """One gradient step over a batch, with a step size for each row from its past gradients."""
    grad = _softmax(table, rows)
    grad[np.arange(len(target)), target] -= 1
    # the rows that occur, numbered; the gradients are summed by row and column
    mark = np.zeros(len(table), bool)
    mark[rows.ravel(order="K")] = True
    at, number = np.flatnonzero(mark), np.cumsum(mark) - 1
    width = table.shape[1]
    weight, column = grad.ravel().astype(np.float64), np.arange(width)
    place = np.concatenate([((number[rows[:, k]] * width)[:, None] + column).ravel() for k in range(1, rows.shape[1])])
    total = np.bincount(place, np.tile(weight, rows.shape[1] - 1), len(at) * width).reshape(-1, width).astype(np.float32)
    # the constant has one row, or one for each group
    first = np.zeros((GROUPS, len(grad)), np.float32)
    first[rows[:, 0], np.arange(len(grad))] = 1
    own = at[at < GROUPS]
    total[: len(own)] += (first @ grad)[own]
    past = seen[at] + (total * total) @ np.ones(width, np.float32)
    seen[at] = past
    total *= (RATE / np.sqrt(past + 1e-6))[:, None]
    table[at] -= total


def train(docs: DataFrame, known: Vocabulary, rounds: int = ROUNDS) -> Weights:
    if not known.total:
        return Weights()
    spark = docs.sparkSession
    words = spark.sparkContext.broadcast(known)
    flat = Weights().flat
    bounds = np.linspace(0, len(flat), PIECES + 1).astype(int)
    schema = "piece int, n long, w binary"

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        n: dict[int, int] = {}
        for batch in batches:
            for k, m, w in zip(batch["piece"].to_pylist(), batch["n"].to_pylist(), batch["w"], strict=True):
                part = np.frombuffer(w.as_buffer(), np.float32) * np.float64(m)
                total[k] = total[k] + part if k in total else part
                n[k] = n.get(k, 0) + m
        for k, x in total.items():
            yield pa.record_batch({"piece": pa.array([k], pa.int32()), "n": pa.array([n[k]]), "w": pa.array([(x / n[k]).astype(np.float32).tobytes()], pa.binary())})

    for _ in range(rounds):
        start = spark.sparkContext.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, known, n = Weights(start.value.copy()), words.value, 0  # noqa: B023
            seen = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS * GROUPS, np.float32)
            for batch in batches:
                held = np.array([is_held_out(i) for i in batch["doc_id"].to_pylist()], bool)
                for piece in slices(batch["text"], STEP_BYTES):
                    h, first = tokens(piece)
                    keep = np.flatnonzero(np.repeat(~held[piece.lo : piece.hi], np.diff(first)))
                    place = known.find(h)
                    slot = np.where(place < 0, 0, known.slot[place] if len(known.slot) else 0)[keep]
                    features = context(h, first)
                    # a very long text is walked in parts
                    for a in range(0, len(keep), 1 << 14):
                        f, s = np.asfortranarray(features[keep[a : a + (1 << 14)]]), slot[a : a + (1 << 14)]
                        _step(w.group, seen[0], f, s // CLASSES)
                        _step(w.cls, seen[1], _rows(f, s // CLASSES), s % CLASSES)
                    n += len(keep)
            for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True) if n else ()):
                yield pa.record_batch({"piece": pa.array([k], pa.int32()), "n": pa.array([n]), "w": pa.array([w.flat[a:b].tobytes()], pa.binary())})

        small_batches(spark)
        pieces = docs.select("doc_id", "text").mapInArrow(run, schema).repartition("piece").mapInArrow(average, schema).collect()
        flat = np.concatenate([np.frombuffer(r.w, np.float32) for r in sorted(pieces)])
    return Weights(flat)


def score(docs: DataFrame, known_words: int = KNOWN, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of ``docs``."""
    spark = docs.sparkSession
    table = written(counts(docs), "token-counts")
    known = vocabulary(table, known_words)
    shared = spark.sparkContext.broadcast((known, train(docs, known, rounds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights = shared.value
        count = np.append(np.log10(known.count + 1.0), 0.0)
        share = np.append(np.log10(known.share), 0.0)
        slots = np.append(known.slot, 0)
        for batch in batches:
            for piece in slices(batch["text"]):
                h, first = tokens(piece)
                place = known.find(h)
                rare = place < 0
                features, slot = context(h, first), slots[place]
                by_class = np.concatenate([weights.log10(features[a : a + 8192], slot[a : a + 8192]) for a in range(0, len(h), 8192)])
                total = lambda x: np.add.reduceat(x, first[:-1])  # noqa: B023, E731  each text has its end token
                ids = batch.slice(piece.lo, len(piece))["doc_id"]
                at = np.concatenate(([0], np.cumsum(rare)))[first]
                yield pa.record_batch({
                    "doc_id": ids, "held_out": pa.array([is_held_out(i) for i in ids.to_pylist()], pa.bool_()), "n_tokens": pa.array(np.diff(first)),
                    "n_frequent": pa.array(total((~rare).astype(np.int64))), "base": pa.array(total(count[place])), "model": pa.array(total(by_class + share[place])),
                    "rare": lists(h[rare].view(np.int64), at, pa.int64()),
                })

    schema = "doc_id long, held_out boolean, n_tokens long, n_frequent long, base double, model double, rare array<long>"
    rows = written(docs.select("doc_id", "text").mapInArrow(run, schema).select(F.monotonically_increasing_id().alias("row"), "*"), "scores")
    each = rows.select("row", F.explode("rare").alias("h")).join(table.select("h", "c"), "h")
    rest = each.groupBy("row").agg(F.count("*").alias("seen"), F.sum(F.log10(F.col("c") + F.lit(1.0))).alias("sum"))
    seen, more = F.coalesce("seen", F.lit(0)), F.coalesce("sum", F.lit(0.0))
    all_log = float(np.log10(known.total + known.distinct + 1))
    rare_log = float(np.log10(known.rare_total + known.rare_distinct + 1))
    base = F.col("base") + more - F.col("n_tokens") * F.lit(all_log)
    model = F.col("model") + more - (F.col("n_tokens") - F.col("n_frequent")) * F.lit(rare_log)
    return rows.drop("rare").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_frequent") + seen).alias("n_known"), F.lit(known.total).cast("long").alias("train_tokens"),
        base.alias("base_score"), (model if known.total else base).alias("score"),
    )
