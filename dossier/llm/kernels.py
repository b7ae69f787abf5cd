"""Numpy over the bytes of an Arrow string column: words, lines, and 64-bit hashes of any span.

A column is worked on in slices of whole texts of about a quarter of a megabyte, so memory follows the slice or the longest
text and not the batch. A span is hashed in blocks of eight bytes: each block is mixed with a key of its place, and the
sum is mixed with the length. No step is linear, so texts of regular structure don't meet; ``seed`` gives a second,
independent hash where 64 bits are too few, and ``same_bytes`` compares the bytes themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

U = np.uint64
SLICE_BYTES = 1 << 18
_rng = np.random.Generator(np.random.PCG64(20240229))
#: Odd factors for the places of a window and for the coordinates of a signature.
ODD = _rng.integers(1, 1 << 63, 4096, dtype=np.uint64) * U(2) + U(1)
#: The bytes of a block that belong to a span of so many bytes.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def byte_table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: Space and U+0009 to U+000D.
SPACE = byte_table(bytes([0x20, *range(0x09, 0x0E)]))
#: Neither ASCII letters (lower case), digits nor bytes of other characters.
NOT_ALNUM = byte_table(bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122)))
NEWLINE = byte_table(b"\n")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Slice:
    """Whole texts lo..hi of a column: their bytes, and where each begins and ends."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offs: np.ndarray):
        self.lo, self.hi, self.data, self.offs = lo, hi, data, offs
        self._eight = None

    def __len__(self) -> int:
        return self.hi - self.lo

    def lowered(self) -> Slice:
        return Slice(self.lo, self.hi, LOWER[self.data], self.offs)

    def blocks(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The eight bytes from each place, as one number; of them only as many as are left."""
        if self._eight is None:
            padded = np.concatenate((self.data, np.zeros(8, np.uint8)))
            self._eight = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
        return self._eight[at] & _MASK[np.minimum(left, 8)]

    def span_hash(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        size = end - start
        first, rest, last = ODD[4080 + 4 * seed : 4083 + 4 * seed]
        total = mix(self.blocks(start, size) + first)
        long = np.flatnonzero(size > 8)
        if len(long):
            n = (size[long] - 1) >> 3
            begin = np.cumsum(n) - n
            place = 1 + np.arange(begin[-1] + n[-1]) - np.repeat(begin, n)
            more = self.blocks(np.repeat(start[long], n) + 8 * place, np.repeat(size[long], n) - 8 * place)
            total[long] += np.add.reduceat(mix(more + mix(place.astype(np.uint64) * rest)), begin)
        return mix(total + size.astype(np.uint64) * last)

    def same_bytes(self, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, other: Slice | None = None) -> np.ndarray:
        """Whether the spans a and b (of this slice or the other) of each pair are equal."""
        other = other or self
        size = a_end - a
        same = (size == b_end - b) & (self.blocks(a, size) == other.blocks(b, size))
        long = np.flatnonzero(same & (size > 8))
        if len(long):
            n = (size[long] - 1) >> 3
            begin = np.cumsum(n) - n
            at, left = 8 * (1 + np.arange(begin[-1] + n[-1]) - np.repeat(begin, n)), np.repeat(size[long], n)
            equal = self.blocks(np.repeat(a[long], n) + at, left - at) == other.blocks(np.repeat(b[long], n) + at, left - at)
            same[long] = np.logical_and.reduceat(equal, begin)
        return same

    def runs(self, gap: np.ndarray) -> Spans:
        """Maximal runs of bytes outside ``gap``, never across texts."""
        at = gap[self.data]
        edge = np.zeros(len(at) + 1, bool)
        edge[self.offs] = True
        begin, close = ~at, ~at
        begin[1:] &= at[:-1] | edge[1:-1]
        close[:-1] &= at[1:] | edge[1:-1]
        return Spans(self, np.flatnonzero(begin), np.flatnonzero(close) + 1)

    def lines(self) -> Spans:
        """The parts between newlines; an empty text has one empty line."""
        cut = np.flatnonzero(self.data == 10)
        start = np.sort(np.concatenate((self.offs[:-1], cut + 1)), kind="stable")
        # a newline that ends a text gives it a last empty line, whose start equals the next text's
        home = np.searchsorted(self.offs, cut, side="right") - 1
        count = np.bincount(home, minlength=len(self))[: len(self)] + 1
        first = np.concatenate(([0], np.cumsum(count)))
        end = np.empty(len(start), np.int64)
        end[:-1] = start[1:] - 1
        last = first[1:] - 1
        end[last] = self.offs[1:]
        return Spans(self, start, end, first)

    def per_text(self, hit: np.ndarray) -> np.ndarray:
        """How many marked bytes each text has."""
        total = np.concatenate(([0], np.cumsum(hit, dtype=np.int64)))
        return total[self.offs[1:]] - total[self.offs[:-1]]

    def text(self, k: int) -> bytes:
        return self.data[self.offs[k] : self.offs[k + 1]].tobytes()


class Spans:
    """Spans in reading order; those of text k of the slice are first[k]..first[k+1]."""

    def __init__(self, piece: Slice, start: np.ndarray, end: np.ndarray, first: np.ndarray | None = None):
        self.piece, self.start, self.end = piece, start, end
        self.first = np.searchsorted(start, piece.offs) if first is None else first
        self.count = np.diff(self.first)

    def home(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.piece)), self.count)

    def hashes(self) -> np.ndarray:
        return self.piece.span_hash(self.start, self.end)

    def windows(self, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``width`` spans inside one text, and the number of its first span."""
        n = len(h) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        left = np.repeat(self.first[1:], self.count) - np.arange(len(h))
        total = h[:n] * ODD[0]
        for j in range(1, width):
            total += h[j : n + j] * ODD[j]
        at = np.flatnonzero(left[:n] >= width)
        return mix(total[at] + U(width * int(ODD[4094]) % (1 << 64))), at

    def total(self, values: np.ndarray) -> np.ndarray:
        """Sum of values (one for each span) by text."""
        run = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
        return run[self.first[1:]] - run[self.first[:-1]]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Nulls count as empty texts."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(max(int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1, lo + 1), n)
        yield Slice(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def lists(flat: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat, kind))


def spread(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts flat[begin:begin+size] one after the other, and where each begins in the result."""
    first = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
    return flat[np.repeat(begin - first[:-1], size) + np.arange(first[-1])], first


def binaries(data: np.ndarray, first: np.ndarray) -> pa.Array:
    """The parts data[first[k]:first[k+1]] as a binary column."""
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(first.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def texts(data: np.ndarray, first: np.ndarray, like: pa.Array) -> pa.Array:
    """The parts data[first[k]:first[k+1]] as a string column, with the nulls of another."""
    out = pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer(first.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return pa.compute.if_else(like.is_valid(), out, None).cast(pa.string())
