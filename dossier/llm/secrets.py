"""Operator 11: secrets by assignment-aware lexing.

Strict patterns find the base spans of each kind, which always stand. Beside them the lines that assign something are
split into tokens, and read as pairs of a name and an expression: assignments and declarations of source code, keyed
arguments, entries of JSON, YAML and configuration files, subscripts, defines, options of command lines, elements and
key/value attributes of markup, and the parts of connection strings inside a literal. Literals are joined over ``+``, and
names that stand for a literal hand it on, in any order and over several steps inside one text. A literal takes the
highest score of the names that it reaches; one that scores ADD_FROM and that no base span overlaps is added.

Spans count code points, end exclusive; a base span is the whole match. Nulls: a null text is empty; null ids and
repeated rows are carried through, row by row. Ties: of added spans that overlap the one that begins first stands, of
equal ones the longest. Very long texts and lines are read whole, a literal may not cross a line. Where a name has several
literals the last one before it is meant, or else the first after it. Names that lead to each other in a circle end there.
Further columns are not looked at; ``redact`` keeps them.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Slice, byte_table, slices
from .shared import plain_names, small_batches

#: Kinds in the order of the results; the last has the added spans.
KINDS = ("assign", "access", "hex", "literal")
#: Least lengths: group 2 of assign, access, hex, and an added literal.
LEAST = {"assign": 6, "access": 20, "hex": 24, "literal": 6}
#: Score from which a literal is added.
ADD_FROM = 4.0

_ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_NOT_HEX = ~byte_table(b"0123456789abcdef")

# Words of names.
_STRONG = frozenset("password passwd passwort passphrase pwd secret token apikey credential credentials motdepasse contrasena jwt".split())
_PAIRS = frozenset("api key|access key|private key|secret key|signing key|encryption key|account key|shared key|storage key|auth key|client secret|master key|service key|license key|pass word|pass phrase|bearer auth".split("|"))
_WEAK = frozenset("key auth pass pin bearer cred creds salt authorization signature dsn".split())
_BENIGN = frozenset(
    "count length len size max min limit type name id ids url uri path file dir field hint label policy expiry expires ttl timeout regex pattern format prefix suffix index header placeholder prompt title message error enabled required valid class method endpoint algorithm version".split()
)
_EMPTY = frozenset("none null nil true false undefined changeme change_me password passwd secret token default example test dummy todo redacted hidden unknown string yourpassword your_password".split())

_STRINGS = {q: rb"(?:[^%b\\]|\\.)*+%b" % (q, q) for q in (b'"', b"'", b"`")}


@functools.cache
def _token(open_quotes: frozenset[bytes]) -> re.Pattern:
    """A token of a line in which only the given quotes begin a literal."""
    strings = b"|".join(q + _STRINGS[q] for q in sorted(open_quotes)) or rb"(?!)"
    return re.compile(
        rb"""(?P<space>[\x20\t\r]+)
        |(?P<string>[rRbBuUfF]{0,2}(?:%b))
        |(?P<close></[A-Za-z_][\w.:-]*+>)
        |(?P<option>(?<![\w-])--[A-Za-z][\w-]*+)
        |(?P<name>[A-Za-z_$@][\w$]*+(?:(?:->|::|[.-])[A-Za-z_$][\w$]*+)*+)
        |(?P<comment>(?<![^\s;])(?:\#(?!define\b)|//).*+)
        |(?P<op>:=|=>|==|!=|<=|>=|=~|\+=|::|\#define|[=:+,;()\[\]{}<>&|?])
        |(?P<quote>["'`])
        |(?P<bare>[^\s"'`=:+,;()\[\]{}<>&|?]++|.)"""
        % strings,
        re.X | re.S,
    )


_ASSIGNS = frozenset((b"=", b":", b":=", b"=>", b"+="))
#: What ends an expression.
_ENDS = frozenset((b",", b";", b")", b"}", b"]", b"<", b">", b"&", b"|", b"?"))
_REFERENCE = re.compile(rb"\$\{\s*([A-Za-z_][\w.]*)\s*\}|\$([A-Za-z_]\w*)|%\(([A-Za-z_]\w*)\)s|\{\{?\s*([A-Za-z_][\w.]*)\s*\}?\}|%([A-Za-z_]\w*)%")
_INNER = re.compile(rb"(?:^|[;&?,\s])([A-Za-z_][\w\x20-]{0,40}?)\x20*=\x20*([^;&,\s\"']+)")
_URL_LOGIN = re.compile(rb"[a-z][a-z0-9+.-]*://[^\s:/@]*:([^\s:/@]+)@")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


@dataclass
class Token:
    kind: str
    text: bytes
    start: int
    end: int


@dataclass
class Source:
    """The pairs of one text: literals (name, start, end, statement) and references (name, other name, statement)."""

    literals: list[tuple[str, int, int, int]] = field(default_factory=list)
    references: list[tuple[str, str, int]] = field(default_factory=list)


def tokens(line: bytes, base: int) -> list[Token]:
    out, at, quotes = [], 0, frozenset(_STRINGS)
    while at < len(line):
        m = _token(quotes).match(line, at)
        if m.lastgroup == "quote":
            # what isn't closed from here on isn't closed from any later one either
            quotes -= {m[0]}
        elif m.lastgroup not in ("space", "comment"):
            out.append(Token(m.lastgroup, m[0], base + at, base + m.end()))
        at = m.end()
    return out


def _inside(t: Token) -> tuple[bytes, int]:
    """What a string token holds, and where it begins."""
    quote = min(t.text.find(q) for q in (b'"', b"'", b"`") if q in t.text)
    return t.text[quote + 1 : -1], t.start + quote + 1


def _name(text: bytes) -> str:
    return text.decode("utf-8", "replace")


def _target(ts: list[Token], i: int) -> str | None:
    """The name that the operator at ts[i] gives a value."""
    j = i - 1
    if j >= 0 and ts[j].text == b"]":
        # config["name"], name[16], or name[]
        k = next((k for k in (j - 1, j - 2) if k >= 0 and ts[k].text == b"["), -1)
        if k == j - 2 and ts[j - 1].kind == "string":
            return _name(_inside(ts[j - 1])[0])
        j = k - 1
    elif j >= 1 and ts[j].kind == "name" and ts[j - 1].text == b":" and j >= 2 and ts[j - 2].kind == "name":
        # name: type = value
        j -= 2
    if j < 0:
        return None
    if ts[j].kind == "string":
        return _name(_inside(ts[j])[0])
    if ts[j].kind in ("name", "bare"):
        return _name(ts[j].text)
    return _name(ts[j].text[2:]) if ts[j].kind == "option" else None


def _value(ts: list[Token], i: int, name: str, out: Source, most: int | None = None) -> int:
    """Reads the expression from ts[i] on: literals and names joined over ``+`` or standing side by side. Returns what follows it."""
    if i >= len(ts):
        return i
    first, place, end = i, ts[i].start, len(ts) if most is None else min(i + most, len(ts))
    while i < end and ts[i].text not in _ENDS and ts[i].text not in _ASSIGNS:
        t, after = ts[i], ts[i + 1].text if i + 1 < len(ts) else b""
        if t.kind == "string":
            _literal(*_inside(t), name, place, out)
        elif t.kind in ("name", "bare"):
            if after == b"(":
                # a call is no literal; what it is given by key is read as pairs of their own
                return i
            if t.kind == "name" and after in _ASSIGNS and i > first:
                return i
            # parts of an unquoted value that touch, as in abc+def=
            j = i
            while j + 1 < len(ts) and ts[j + 1].start == ts[j].end and ts[j + 1].kind in ("name", "bare", "op") and ts[j + 1].text not in _ENDS:
                j += 1
            if t.kind == "name" and j == i:
                out.references.append((name, _name(t.text), place))
            if t.kind == "bare" or j > i or _looks_random(t.text):
                out.literals.append((name, t.start, ts[j].end, place))
            i = j
        i += 1
    return i


def _looks_random(text: bytes) -> bool:
    """Whether an unquoted word is rather a value than the name of a variable."""
    digits = sum(48 <= c <= 57 for c in text)
    return b"." not in text and b"->" not in text and b"::" not in text and digits >= 2


def _literal(value: bytes, at: int, name: str, place: int, out: Source) -> None:
    if m := _REFERENCE.fullmatch(value.strip()):
        out.references.append((name, _name(next(g for g in m.groups() if g)), place))
        return
    # of a connection string or address only the part that a sensitive name, or the place of a password, points at
    inner = [(_name(m[1]), at + m.start(2), at + m.end(2), place) for m in _INNER.finditer(value)]
    inner = [x for x in inner if name_score(x[0]) > 0] + [("password", at + m.start(1), at + m.end(1), place) for m in _URL_LOGIN.finditer(value)]
    out.literals += inner or [(name, at, at + len(value), place)]


def read_line(line: bytes, base: int, out: Source) -> None:
    """The pairs of one line, its first byte being number ``base`` of the text."""
    ts = tokens(line, base)
    closes = [i for i, t in enumerate(ts) if t.kind == "close"]
    key: bytes | None = None
    done = 0
    for i, t in enumerate(ts[:-1]):
        after = ts[i + 1]
        if i < done:
            # inside an unquoted value
            continue
        if t.text in _ASSIGNS:
            if t.text == b":" and i + 2 < len(ts) and ts[i + 2].text == b"=":
                continue
            if (name := _target(ts, i)) is None:
                continue
            # key="..." value="..." of markup
            if name.lower() in ("key", "name", "id") and after.kind == "string":
                key = _inside(after)[0]
            elif name.lower() in ("value", "content") and key is not None:
                name, key = _name(key), None
            done = _value(ts, i + 1, name, out)
        elif t.text == b"#define" and after.kind == "name":
            done = _value(ts, i + 2, _name(after.text), out)
        elif t.kind == "option" and after.kind in ("string", "bare", "name"):
            done = _value(ts, i + 1, _name(t.text[2:]), out, most=1)
        elif t.text == b">" and i >= 2 and ts[i - 1].kind == "name" and ts[i - 2].text == b"<":
            # <name>value</name>
            k = bisect.bisect_right(closes, i)
            if k < len(closes) and closes[k] > i + 1 and ts[closes[k]].text[2:-1] == ts[i - 1].text:
                _literal(line[t.end - base : ts[closes[k]].start - base], t.end, _name(ts[i - 1].text), t.end, out)


def words(name: str) -> list[str]:
    """The parts of a name in lower case: camel case, underscores, hyphens and dots part them."""
    return [w.lower() for w in _PARTS.findall(name)]


@functools.lru_cache(1 << 16)
def name_score(name: str) -> float:
    parts = words(name)
    if not parts:
        return 0.0
    pairs = {f"{a} {b}" for a, b in zip(parts, parts[1:], strict=False)}
    strong = bool(_STRONG.intersection(w.rstrip("0123456789") for w in parts)) or bool(_PAIRS & pairs)
    singular = any(w.endswith("s") and w[:-1] in _STRONG for w in parts)
    score = 3.0 if strong or singular else 1.5 if _WEAK.intersection(parts) else 0.0
    return score - 3.0 if parts[-1] in _BENIGN else score


def literal_score(value: str) -> float:
    """What the literal itself says: length and spread of characters for it, place-holders and prose against it."""
    plain = value.strip()
    if len(plain) < LEAST["literal"] or plain.lower().strip("<>[]{}$*_-. ") in _EMPTY or len(set(plain)) <= 2:
        return -9.0
    lower = plain.lower()
    if lower[:1] in "<{$%" or any(x in lower for x in ("example", "your", "xxxx", "****", "placeholder", "changeme", "...")):
        return -9.0
    bits = sum(-c / len(plain) * math.log2(c / len(plain)) for c in Counter(plain).values())
    kinds = sum((any(c.islower() for c in plain), any(c.isupper() for c in plain), any(c.isdigit() for c in plain), any(not c.isalnum() for c in plain)))
    score = min(2.0, bits * len(plain) / 40) + 0.5 * (kinds - 1)
    if any(c.isspace() for c in plain):
        score -= 2.0
    if "://" in plain or plain.startswith(("/", "./", "../")):
        score -= 2.0
    return score


def resolved(source: Source) -> dict[tuple[int, int], float]:
    """The highest score of the names that each literal reaches, itself and over other names."""
    best: dict[tuple[int, int], float] = {}
    # by name and statement: spans of literals, and other names
    stated: dict[str, dict[int, list[tuple[int, int] | str]]] = {}
    for name, a, b, place in source.literals:
        best[a, b] = max(name_score(name), best.get((a, b), -math.inf))
        stated.setdefault(name, {}).setdefault(place, []).append((a, b))
    for name, other, place in source.references:
        stated.setdefault(name, {}).setdefault(place, []).append(other)
    places = {name: sorted(x) for name, x in stated.items()}
    # from the best names on, so that what one has reached is never walked again
    met: set[tuple[str, int]] = set()
    for name, other, place in sorted(source.references, key=lambda r: -name_score(r[0])):
        if (score := name_score(name)) <= 0:
            break
        todo = [(other, place)]
        while todo:
            other, place = todo.pop()
            if other not in places:
                continue
            near = places[other][max(bisect.bisect_left(places[other], place) - 1, 0)]
            if (other, near) in met:
                continue
            met.add((other, near))
            for x in stated[other][near]:
                if isinstance(x, tuple):
                    best[x] = max(best[x], score)
                else:
                    todo.append((x, near))
    return best


def base_spans(text: bytes, assigned: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """assign and access of one text, in bytes; ``assigned`` are its lines with a colon or an equals sign."""
    out = [("assign", a + m.start(), a + m.end()) for a, b in assigned for m in _ASSIGN.finditer(text[a:b]) if len(m[1]) >= LEAST["assign"]]
    if b"AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    return out


def added_spans(text: bytes, lines: list[tuple[int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    source = Source()
    for a, b in lines:
        read_line(text[a:b], a, source)
    good = []
    for (a, b), score in resolved(source).items():
        if score > 0 and score + literal_score(text[a:b].decode("utf-8", "replace")) >= ADD_FROM:
            good.append((a, b))
    out, taken = [], sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    ends = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
    last = 0
    for a, b in sorted(good, key=lambda s: (s[0], -s[1])):
        i = bisect.bisect_left(starts, b)
        if a >= last and (i == 0 or ends[i - 1] <= a):
            out.append(("literal", a, b))
            last = b
    return out


def _lines(text: bytes, marks: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each line that has a mark."""
    out, last = [], -1
    for at in marks.tolist():
        if at >= last:
            a = text.rfind(b"\n", 0, at) + 1
            last = text.find(b"\n", at)
            last = len(text) if last < 0 else last
            out.append((a, last))
    return out


_PAIRING = byte_table(b":=")
_OTHER = byte_table(b"<#")


def _marks(piece: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that may assign something: colon and equals sign, and the beginnings of markup, defines and options."""
    strict = _PAIRING[piece.data]
    lexed = strict | _OTHER[piece.data]
    dash = piece.data == 0x2D
    lexed[:-1] |= dash[:-1] & dash[1:]
    return strict, lexed


def find_in(piece: Slice) -> dict[int, tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """For each text of a slice that has any: its base spans, and all spans with the added ones, in code points and in order."""
    strict, lexed = _marks(piece)
    runs = piece.runs(_NOT_HEX)
    long = np.flatnonzero(runs.end - runs.start >= LEAST["hex"])
    hexes: dict[int, list[tuple[str, int, int]]] = {}
    for k, a, b in zip(runs.home()[long].tolist() if len(long) else [], runs.start[long].tolist(), runs.end[long].tolist(), strict=True):
        hexes.setdefault(k, []).append(("hex", a - int(piece.offs[k]), b - int(piece.offs[k])))
    asked = piece.per_text(lexed) > 0
    asked[list(hexes)] = True
    raw, at = piece.data.tobytes(), -1
    while (at := raw.find(b"AKIA", at + 1)) >= 0:
        asked[np.searchsorted(piece.offs, at, side="right") - 1] = True
    rank = {k: i for i, k in enumerate(KINDS)}
    out = {}
    for k in np.flatnonzero(asked).tolist():
        lo, hi = int(piece.offs[k]), int(piece.offs[k + 1])
        text = raw[lo:hi]
        base = base_spans(text, _lines(text, np.flatnonzero(strict[lo:hi]))) + hexes.get(k, [])
        added = added_spans(text, _lines(text, np.flatnonzero(lexed[lo:hi])), base)
        if base or added:
            points = np.concatenate(([0], np.cumsum((piece.data[lo:hi] & 0xC0) != 0x80)))
            ordered = lambda spans: sorted(((kind, int(points[a]), int(points[b])) for kind, a, b in spans), key=lambda s: (s[1], rank[s[0]]))  # noqa: B023, E731
            out[k] = ordered(base), ordered(base + added)
    return out


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
SPANS_DDL = "array<struct<kind:string,start:int,end:int>>"


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (base and added) for each row of ``docs``, in the order of start and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch["text"]):
                found = find_in(piece)
                column = lambda j: pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in found[k][j]] if k in found else [] for k in range(len(piece))], SPANS)  # noqa: B023, E731
                yield pa.record_batch({"doc_id": batch.slice(piece.lo, len(piece))["doc_id"], "base": column(0), "spans": column(1)})

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, base {SPANS_DDL}, spans {SPANS_DDL}")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in angle brackets; n_chars follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.names.index("text")
            for piece in slices(batch["text"]):
                part = batch.slice(piece.lo, len(piece))
                texts = part["text"].to_pylist()
                for k, (_, spans) in find_in(piece).items():
                    parts, last = [], 0
                    for kind, a, b in spans:
                        if a >= last:
                            parts += [texts[k][last:a], f"<{kind}>"]
                        last = max(last, b)
                    texts[k] = "".join(parts) + texts[k][last:]
                yield part.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    small_batches(docs.sparkSession)
    plain = plain_names(docs)
    out = plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the numbers of base spans of each strict kind, the digest of the base spans, and all spans as text."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = [F.size(F.filter(F.col("base.kind"), lambda x: x == F.lit(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]]  # noqa: B023
    return find(docs).select("doc_id", *n, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
