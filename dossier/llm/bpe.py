"""Operator 7: byte-level BPE encoding and decoding with given ranks.

Three steps. Every whole text is cut into words by the pattern of the tokenizer, and the words are counted over all
documents. The frequent distinct words are encoded in Spark higher-order functions: an ``aggregate`` folds ranked
merges over the bytes of a word, looking ranks up in a literal map. Then the texts are encoded in Arrow batches from
the broadcast result; the words of a batch outside it are folded there by the same rule, all at once in numpy. Decoding
concatenates the pieces of the ids in higher-order functions.

The broadcast table is bounded by WORDS whatever the input; it decides where a word is folded, not how. Words meet by
hash and are then compared byte by byte. A very long text is a batch of its own; a word of any length is folded whole.
Nulls: a null text is empty and has no ids; a null list of ids decodes to no bytes, an id out of range is an error.
Repeated rows and null ids are carried through. Ties between merges go to the leftmost, as ranks are unique. Columns
named like a result are replaced.
"""

from __future__ import annotations

import base64
import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import Slice, binaries, lists, slices, spread
from .shared import plain_names, removed, small_batches, written

#: Distinct words (the most frequent) that are folded once and broadcast.
WORDS = 1 << 17
#: Distinct words that a task gathers before it hands their counts on, and the longest word of the table.
GATHER, LONGEST = 200_000, 128
#: A rank that no merge has.
NONE = 2**31 - 1
_SLOTS = 1 << 17
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Lines of base64 bytes and a rank; ``path`` is read on the driver, as vocabulary files are small and fixed."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.cache
def _kinds() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        group = unicodedata.category(chr(c))[0]
        if group == "L":
            out[c] = _LETTER
        elif group == "N":
            out[c] = _NUMBER
    # White_Space of Unicode
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    return out


def words(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the matches of the pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``, which cover the texts."""
    points = np.frombuffer(piece.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero((piece.data & 0xC0) != 0x80)
    kind = _kinds()[points]
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(at, piece.offs)] = True
    begin = edge[:-1].copy()
    begin[0] = True
    begin[1:] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(begin)
    end = np.append(start[1:], n)
    token = begin
    # the last of several blanks before something else goes with it if it is a space, and stands alone if not
    blank = (kind[start] == _SPACE) & ~edge[end]
    last = end[blank] - 1
    token[last] = True
    joined = last[points[last] == 0x20]
    token[joined + 1] = False
    # contractions
    quote = np.flatnonzero((points == 0x27) & token)
    quote = quote[(quote + 1 < n)]
    quote = quote[(kind[quote + 1] == _LETTER) & ~edge[quote + 1]]
    if len(quote):
        one = np.isin(points[quote + 1], [ord(c) for c in "stmd"])
        two = np.zeros(len(quote), bool)
        room = (quote + 2 < n) & ~edge[np.minimum(quote + 2, n)]
        a, b = points[quote + 1], points[np.minimum(quote + 2, n - 1)]
        for x, y in ("re", "ve", "ll"):
            two |= room & (a == ord(x)) & (b == ord(y))
        size = np.where(one, 1, np.where(two, 2, 0))
        hit = quote[size > 0]
        after = hit + 1 + size[size > 0]
        token[hit + 1] = False
        token[after[after < n]] = True
    start = at[np.flatnonzero(token)]
    return start, np.append(start[1:], len(piece.data))


class Merges:
    """The ranks as arrays: the token of each byte, and for each pair of tokens that make one the rank of that token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.n = max(ranks.values(), default=0) + 1
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {ranks[a] * self.n + ranks[b]: r for raw, r in ranks.items() for i in range(1, len(raw)) if (a := raw[:i]) in ranks and (b := raw[i:]) in ranks}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.pairs.tolist()], np.int64)
        words = sorted(ranks)
        self.whole = Table(np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)]), np.array([ranks[w] for w in words], np.int32), np.arange(len(words) + 1))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NONE) if len(self.pairs) else np.full(len(key), NONE)

    def fold(self, piece: Slice, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the spans one after the other, and how many each has.

        In each step every span merges its pair of the lowest rank, the leftmost of equal ones, until no pair has a rank;
        a span that is a token as a whole is that token.
        """
        size, none = end - start, np.zeros(0, np.int64)
        known = self.whole.find(piece, start, end)
        todo = np.flatnonzero(known < 0)
        at, first = spread(np.arange(len(piece.data)), start[todo], size[todo])
        token, home = self.bytes[piece.data[at]], np.repeat(np.arange(len(todo)), size[todo])
        rank = np.full(len(token), NONE)
        if len(token) > 1:
            inside = np.flatnonzero(home[1:] == home[:-1])
            rank[inside] = self.rank(token[inside], token[inside + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(token):
            begin = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1])))
            low = np.minimum.reduceat(rank, begin)
            some = low < NONE
            count = np.diff(np.append(begin, len(home)))
            if not some.all():
                over = np.repeat(~some, count)
                done.append((home[over], token[over]))
                home, token, rank = home[~over], token[~over], rank[~over]
                low, count = low[some], count[some]
                if not len(token):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, count))
            hit = hit[np.concatenate(([True], home[hit][1:] != home[hit][:-1]))]
            token[hit] = rank[hit]
            keep = np.ones(len(token), bool)
            keep[hit + 1] = False
            hit = hit - np.arange(len(hit))
            home, token, rank = home[keep], token[keep], rank[keep]
            # only the pairs on either side of a merged token have new ranks
            for near in (hit, hit[hit > 0] - 1):
                rank[near] = NONE
                near = near[near + 1 < len(home)]
                near = near[home[near] == home[near + 1]]
                rank[near] = self.rank(token[near], token[near + 1])
        count = np.ones(len(start), np.int64)
        homes, tokens = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (none, none)
        order = np.argsort(homes, kind="stable")
        count[todo] = np.bincount(homes, minlength=len(todo))
        ids = np.empty(count.sum(), np.int32)
        where = np.repeat(known < 0, count)
        ids[where] = tokens[order]
        ids[~where] = self.whole.ids[self.whole.begin[known[known >= 0]]]
        return ids, count


class Table:
    """Words with their ids, found by hash and compared byte by byte."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, ids: np.ndarray, first: np.ndarray):
        piece = Slice(0, len(offs) - 1, data, offs)
        h = piece.span_hash(offs[:-1], offs[1:])
        order = np.argsort(h, kind="stable")
        self.hashes, self.data, self.start, self.end = h[order], data, offs[:-1][order], offs[1:][order]
        self.ids, self.begin, self.size = ids, first[:-1][order], np.diff(first)[order]

    def find(self, piece: Slice, start: np.ndarray, end: np.ndarray, h: np.ndarray | None = None) -> np.ndarray:
        """Place of each span, or -1."""
        if not len(self.hashes) or not len(start):
            return np.full(len(start), -1)
        h = piece.span_hash(start, end) if h is None else h
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == h)
        own = Slice(0, 1, self.data, np.array([0, len(self.data)]))
        out = np.full(len(start), -1)
        good = hit[piece.same_bytes(start[hit], end[hit], self.start[at[hit]], self.end[at[hit]], own)]
        out[good] = at[good]
        return out


def distinct(piece: Slice, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and numbers of the distinct spans, and which of them each span is."""
    h = piece.span_hash(start, end)
    known, at, place = np.unique(h, return_index=True, return_inverse=True)
    other = np.flatnonzero(~piece.same_bytes(start, end, start[at[place]], end[at[place]]))
    place[other] = len(known) + np.arange(len(other))
    return np.concatenate((known, h[other])), np.concatenate((at, other)), place


def word_counts(docs: DataFrame) -> DataFrame:
    """Distinct words of all texts and how often each occurs: word (binary), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []

        def merged() -> tuple[np.ndarray, ...]:
            h, n, size, data = (np.concatenate(x) for x in zip(*parts, strict=True))
            known, at, place = np.unique(h, return_index=True, return_inverse=True)
            return known, np.bincount(place, n).astype(np.int64), size[at], spread(data, (np.cumsum(size) - size)[at], size[at])[0]

        def out(h, n, size, data) -> pa.RecordBatch:
            return pa.record_batch({"word": binaries(data, np.concatenate(([0], np.cumsum(size)))), "n": pa.array(n)})

        for batch in batches:
            for piece in slices(batch["text"]):
                start, end = words(piece)
                h, at, n = np.unique(piece.span_hash(start, end), return_index=True, return_counts=True)
                parts.append((h, n, (end - start)[at], spread(piece.data, start[at], (end - start)[at])[0]))
                if sum(len(p[0]) for p in parts) > GATHER:
                    parts[:] = [merged()]
                    if len(parts[0][0]) > GATHER // 2:
                        yield out(*parts.pop())
        if parts:
            yield out(*merged())

    small_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int = WORDS) -> DataFrame:
    """The words of the highest counts, as many whole counts as fit in ``most``."""
    by_count = counts.where(F.length("word") <= LONGEST).groupBy("n").agg(F.count("*").alias("words"))
    # the number of different counts is small beside the number of words; those of one word each are at most ``most``
    total, least = 0, None
    for n, k in by_count.orderBy(F.desc("n")).limit(most).collect():
        total += k
        if total > most:
            break
        least = n
    return counts.where(F.length("word") <= LONGEST).where(F.col("n") >= least if least is not None else F.lit(False))


class RankMap:
    """A literal map from a byte string to its rank: two literal arrays, in which a key has one of two places.

    Bytes are written as the characters from U+0100, so a key is an ordinary string without blanks.
    """

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int]):
        rows = spark.createDataFrame([(self.spelled(k), r) for k, r in ranks.items()], "k string, r int")
        homes = {k: (r, *at) for k, r, *at in rows.select("k", "r", *self._homes(F.col("k"))).collect()}
        keys = [""] * _SLOTS
        for k in homes:
            slot = homes[k][1]
            for _ in range(500):
                keys[slot], k = k, keys[slot]
                if not k:
                    break
                _, a, b = homes[k]
                slot = b if slot == a else a
            else:
                raise ValueError("too many ranks for the map")
        self._keys = " ".join(keys)
        self._ranks = " ".join(str(homes[k][0]) if k else "0" for k in keys)

    @staticmethod
    def spelled(raw: bytes) -> str:
        return "".join(chr(0x100 + b) for b in raw)

    @staticmethod
    def _homes(key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key), F.lit(_SLOTS)).cast("int"), F.pmod(F.hash(key), F.lit(_SLOTS)).cast("int")]

    def within(self, body) -> Column:
        """``body`` of this map; the two literals stand once in the plan, however often the body looks a key up."""

        def bound(keys: Column) -> Column:
            self.keys = keys
            return _let(F.split(F.lit(self._ranks), " ").cast("array<int>"), with_ranks)

        def with_ranks(ranks: Column) -> Column:
            self.ranks = ranks
            return body(self)

        return _let(F.split(F.lit(self._keys), " "), bound)

    def __getitem__(self, key: Column) -> Column:
        def look(k: Column) -> Column:
            a, b = self._homes(k)
            return F.when(F.get(self.keys, a) == k, F.get(self.ranks, a)).when(F.get(self.keys, b) == k, F.get(self.ranks, b)).otherwise(F.lit(NONE))

        return _let(key, look)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(word: Column, ranks: RankMap) -> Column:
    """Ids of a binary word: ranked merges folded over its bytes."""
    state = "struct<p:array<string>,r:array<int>>"
    spelled = F.lit(RankMap.spelled(bytes(range(256))))
    hexed = F.hex(word)
    size = F.length(word)
    byte = lambda i: F.conv(F.substring(hexed, 2 * i - 1, F.lit(2)), 16, 10).cast("int")
    pieces = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(spelled, byte(i) + 1, F.lit(1)))

    def begin(p: Column) -> Column:
        pairs = F.transform(F.slice(p, 1, F.size(p) - 1), lambda x, i: ranks[F.concat(x, F.get(p, i + 1))])
        return F.struct(p.alias("p"), pairs.alias("r")).cast(state)

    def merge(s: Column, i: Column) -> Column:
        p, r = s["p"], s["r"]
        none = F.slice(r, 1, 0)

        def put(new: Column) -> Column:
            before = F.when(i > 1, F.array(ranks[F.concat(F.get(p, i - 2), new)])).otherwise(none)
            after = F.when(i + 1 < F.size(p), F.array(ranks[F.concat(new, F.get(p, i + 1))])).otherwise(none)
            q = F.concat(F.slice(p, F.lit(1), i - 1), F.array(new), F.slice(p, i + 2, F.size(p)))
            t = F.concat(F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))), before, after, F.slice(r, i + 2, F.size(p)))
            return F.struct(q.alias("p"), t.alias("r")).cast(state)

        return _let(F.concat(F.get(p, i - 1), F.get(p, i)), put)

    def step(s: Column, _: Column) -> Column:
        low = F.array_min(s["r"])
        return F.when(low < NONE, _let(F.array_position(s["r"], low).cast("int"), lambda i: merge(s, i))).otherwise(s)

    def ids(p: Column) -> Column:
        merged = F.aggregate(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), begin(p), step)["p"]
        whole = ranks[F.array_join(p, "")]
        return F.when(whole < NONE, F.array(whole)).otherwise(F.transform(merged, lambda x: ranks[x]))

    return _let(pieces, ids)


def encoded_words(counts: DataFrame, ranks: dict[bytes, int], most: int = WORDS) -> DataFrame:
    """word, ids for the frequent ones of counted distinct words."""
    return frequent(counts, most).select("word", RankMap(counts.sparkSession, ranks).within(lambda m: folded(F.col("word"), m)).alias("ids"))


def encode(docs: DataFrame, path: str, most: int = WORDS, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with ids, a list of token ids for each text."""
    spark = docs.sparkSession
    ranks = read_ranks(spark, path)
    known = pa.table({"word": pa.array([], pa.binary()), "ids": pa.array([], pa.list_(pa.int32()))})
    if most:
        counts = written(word_counts(docs), "words")
        known = encoded_words(counts, ranks, most).toArrow().combine_chunks()
        removed(counts)
    word, ids = (c.chunk(0) if c.num_chunks else c.combine_chunks() for c in (known["word"].cast(pa.large_binary()), known["ids"]))
    offs = np.concatenate(([0], np.cumsum(pa.compute.binary_length(word).to_numpy(zero_copy_only=False)))).astype(np.int64)
    sizes = pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False)
    table = Table(np.frombuffer(b"".join(word.to_pylist()), np.uint8), offs, ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64))
    shared = spark.sparkContext.broadcast((table, Merges(ranks)))
    del known, word, ids, table
    pa.default_memory_pool().release_unused()
    names, plain = [c for c in (docs.columns if carry is None else carry) if c != "ids"], plain_names(docs)
    fields = [dict(zip(docs.columns, plain.columns, strict=True))[c] for c in names]
    kept = plain.select(*dict.fromkeys([*fields, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, merges = shared.value
        for batch in batches:
            for piece in slices(batch["text"]):
                start, end = words(piece)
                h, at, place = distinct(piece, start, end)
                found = table.find(piece, start[at], end[at], h)
                rest, some = np.flatnonzero(found < 0), np.flatnonzero(found >= 0)
                own, count = merges.fold(piece, start[at[rest]], end[at[rest]])
                begin, size = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
                begin[some], size[some] = table.begin[found[some]], table.size[found[some]]
                begin[rest], size[rest] = len(table.ids) + np.cumsum(count) - count, count
                ids, run_of = spread(np.concatenate((table.ids, own)), begin[place], size[place])
                first = run_of[np.searchsorted(start, piece.offs)]
                rows = batch.slice(piece.lo, len(piece))
                yield pa.record_batch({n: rows[n] for n in fields} | {"ids": lists(ids, first, pa.int32())})

    schema = ", ".join(f"`{n}` {plain.schema[n].dataType.simpleString()}" for n in fields)
    return kept.mapInArrow(run, f"{schema}, ids array<int>").toDF(*names, "ids")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with decoded, the bytes of the pieces of ids in their order.

    The pieces stand in the plan once, as a literal array of hexadecimal strings that is addressed by id.
    """
    ranks = read_ranks(encoded.sparkSession, path)
    pieces = ["!"] * (max(ranks.values()) + 1)
    for raw, r in ranks.items():
        pieces[r] = raw.hex()
    ids = F.coalesce("ids", F.array().cast("array<int>"))
    joined = _let(F.split(F.lit(" ".join(pieces)), " "), lambda p: F.array_join(F.transform(ids, lambda i: F.element_at(p, i + 1)), ""))
    return encoded.withColumn("decoded", F.unhex(joined))


def report(docs: DataFrame, path: str, most: int = WORDS) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded bytes."""
    both = decode(encode(docs, path, most, ["doc_id"]), path)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
