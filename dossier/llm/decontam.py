"""Operator 5: benchmark decontamination.

A broadcast hash set of the normalised word windows of the benchmark; every training text is scanned with windows of
the same widths, each hit is verified byte by byte, and the hit words (or the documents) are removed. The set is
broadcast only up to BLOCK_BYTES of benchmark text (it takes some eight times as much); a larger benchmark is cut into
blocks by item, each scanned in a pass of its own over the result of the one before, so no part of it is left out.

Words are runs of ASCII letters (lower-cased), ASCII digits and all non-ASCII characters. A window is ``width``
consecutive words of an item; an item of fewer words is one window. Nulls: a null text or an item without id or words
has no window. Repeated items count once; items of one id and several texts are one item. Each row of the documents
gets its row, whatever its id. A very long text is scanned whole, as a batch of its own. Columns of ``docs`` named like
a result are replaced by ``scan`` and kept by ``decontaminate``. There are no ties: every window that hits counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import NOT_ALNUM, Slice, Spans, lists, slices, texts
from .shared import ddl, free_names, plain_names, small_batches, written

WIDTH = 10
#: Benchmark text that is turned into one broadcast set.
BLOCK_BYTES = 8 << 20
_BITS = 20


class Windows:
    """The different windows of one width, by hash: where each stands in the benchmark, and the items that have it."""

    def __init__(self, width: int, text: Slice, words: Spans, h: np.ndarray, first: np.ndarray, item: np.ndarray):
        self.width, self.text, self.start, self.end = width, text, words.start, words.end
        order = np.lexsort((item, h))
        h, first, item = h[order], first[order], item[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | ~self.same(text, words.start, words.end, first[1:], first[:-1])
        self.hashes, self.first = h[new], first[new]
        self.begin, self.item = np.append(np.flatnonzero(new), len(h)), item
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[self.hashes >> np.uint64(64 - _BITS)] = True

    def same(self, piece: Slice, start: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words from a on in a text are those from b on in the benchmark."""
        out = np.ones(len(a), bool)
        for j in range(self.width):
            out &= piece.same_bytes(start[a + j], end[a + j], self.start[b + j], self.end[b + j], self.text)
        return out

    def find(self, piece: Slice, words: Spans, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows (hashes h, first words at) that are known, and which they are."""
        some = np.flatnonzero(self.maybe[h >> np.uint64(64 - _BITS)])
        lo = np.searchsorted(self.hashes, h[some], "left")
        n = np.searchsorted(self.hashes, h[some], "right") - lo
        at, place = np.repeat(at[some], n), np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        good = self.same(piece, words.start, words.end, at, self.first[place])
        return at[good], place[good]


def windows_of(items: list[tuple[object, str]], width: int) -> tuple[list[str], list[Windows]]:
    """Item ids as sorted strings, and the windows of each width with items as places in that list."""
    names = sorted({str(i) for i, _ in items})
    place = {name: k for k, name in enumerate(names)}
    texts = pa.array([text for _, text in items], pa.large_string())
    out = []
    for piece in slices(texts, 1 << 62):
        piece = piece.lowered()
        words = piece.runs(NOT_ALNUM)
        item, h, home = np.array([place[str(i)] for i, _ in items]), words.hashes(), words.home()
        for n in np.unique(np.minimum(words.count, width)).tolist():
            if n:
                seen, first = words.windows(h, n)
                own = np.minimum(words.count, width)[home[first]] == n
                if own.any():
                    out.append(Windows(n, piece, words, seen[own], first[own], item[home[first[own]]]))
    return names, out


def _hits(piece: Slice, words: Spans, known: list[Windows]) -> tuple[np.ndarray, np.ndarray]:
    """Which words of a slice are hit, and the (text, item) pairs of the windows, sorted."""
    h, home = words.hashes(), words.home()
    cover = np.zeros(len(h) + 1, np.int64)
    pairs = [np.zeros((0, 2), np.int64)]
    for windows in known:
        at, place = windows.find(piece, words, *words.windows(h, windows.width))
        np.add.at(cover, at, 1)
        np.add.at(cover, at + windows.width, -1)
        met = np.unique(np.stack((home[at], place), 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        n = windows.begin[met[:, 1] + 1] - windows.begin[met[:, 1]]
        item = windows.item[np.repeat(windows.begin[met[:, 1]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        pairs.append(np.stack((np.repeat(met[:, 0], n), item), 1))
    return np.cumsum(cover)[:-1] > 0, np.unique(np.concatenate(pairs), axis=0)


def _cut(piece: Slice, words: Spans, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of the texts of a slice without the hit words and what stands between two of them."""
    edge = np.zeros(len(piece.data) + 1, np.int64)
    home = words.home()
    joined = hit[1:] & hit[:-1] & (home[1:] == home[:-1])
    begin = hit & ~np.concatenate(([False], joined)) if len(hit) else hit
    close = hit & ~np.concatenate((joined, [False])) if len(hit) else hit
    np.add.at(edge, words.start[begin], 1)
    np.add.at(edge, words.end[close], -1)
    keep = np.cumsum(edge)[:-1] == 0
    return piece.data[keep], np.concatenate(([0], np.cumsum(keep)))[piece.offs]


def _pass(docs: DataFrame, items: list[tuple[object, str]], width: int, names: list[str], earlier: bool, remove: str | None) -> DataFrame:
    """``docs`` with the columns ``names`` (n_words, hits, items), or its own columns without what is hit."""
    shared = docs.sparkSession.sparkContext.broadcast(windows_of(items, width))
    fields = [n for n in docs.columns if n not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known = shared.value
        ids = pa.array(ids, pa.string())
        for batch in batches:
            for piece in slices(batch["text"]):
                words = piece.lowered().runs(NOT_ALNUM)
                hit, pairs = _hits(words.piece, words, known)
                rows = batch.slice(piece.lo, len(piece))
                if earlier:  # blocks
                    hit[_flat(words, rows[names[1]])] = True
                out = {n: rows[n] for n in fields}
                if remove is None:
                    at = np.flatnonzero(hit)
                    of, item = pairs.T
                    who = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(piece) + 1)), pa.int32()), ids.take(pa.array(item)))
                    if earlier:
                        who = pa.array([sorted({*a, *b}) for a, b in zip(who.to_pylist(), rows[names[2]].to_pylist(), strict=True)], pa.list_(pa.string()))
                    where = lists(at - words.first[words.home()[at]], np.searchsorted(at, words.first), pa.int32())
                    yield pa.record_batch(out | {names[0]: pa.array(words.count), names[1]: where, names[2]: who})
                    continue
                n = words.total(hit.astype(np.int64))
                out["text"] = texts(*_cut(piece, words, hit), rows["text"])
                yield pa.record_batch(out).filter(pa.array((n == 0) | ((n < words.count) & (remove == "spans"))))

    small_batches(docs.sparkSession)
    own = "" if remove else f", `{names[0]}` long, `{names[1]}` array<int>, `{names[2]}` array<string>"
    return docs.mapInArrow(run, ddl(docs.select(*fields)) + own)


def _flat(words: Spans, hits: pa.Array) -> np.ndarray:
    """Numbers of the hit words in the slice, from lists of their numbers in the texts."""
    size = np.array([len(x or ()) for x in hits.to_pylist()], np.int64)
    return np.repeat(words.first[:-1], size) + hits.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _passes(docs: DataFrame, benchmark: DataFrame, width: int, block_bytes: int, names: list[str], remove: str | None) -> DataFrame:
    items = benchmark.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    out = docs
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        last = k == blocks - 1
        out = _pass(out, [tuple(r) for r in part.collect()], width, names, k > 0, remove if last else None)
        if not last:
            out = written(out, "decontam")
    return out


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` with n_words, hits (numbers of the hit words) and items (ids as sorted strings)."""
    names = ["n_words", "hits", "items"]
    return _passes(docs.drop(*names), benchmark, width, block_bytes, names, None)


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row for each document: how many words are hit, by how many items, and the digest of their ids."""
    found = scan(docs.select("doc_id", "text"), benchmark, width)
    return found.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, remove: str = "spans", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the hit words ("spans") or without the documents that have any ("documents").

    A text that consists of hit words alone goes in either case; n_chars follows the text where there is such a column.
    """
    plain = plain_names(docs)
    out = _passes(plain, benchmark, width, block_bytes, free_names(plain, "n_words", "hits", "items"), remove).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
