"""Operator 4: personal data by weak supervision.

Strict patterns find the base spans of each kind, which always stand. Wider patterns propose further spans; labelers
(patterns, gazetteers, context) vote for, against or not at all on every proposal. Expectation-maximisation over the
counts of vote patterns estimates how reliable each labeler is, and its posteriors train a span classifier on a
bounded sample of proposals; a proposal that it accepts and that no base span overlaps is added.

Spans count code points, end exclusive. Nulls: a null text is empty; null ids and repeated rows are carried through,
row by row. Without proposals nothing is trained and nothing added. Overlapping proposals: the one that begins first
stands, of equal ones the longest. Very long texts and runs of digits are read whole. Further columns are not looked at;
``redact`` keeps them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import byte_table, slices
from .shared import plain_names, removed, small_batches, written

#: Kinds in the order of the results.
KINDS = ("email", "ip", "card", "phone", "secret")
#: At most so many proposals (those of the least hash) train the classifier.
SAMPLE_SPANS = 20_000
#: Probability from which a proposal is added.
ADD_FROM = 0.9
BUCKETS = 1 << 10
CONTEXT = 30

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Wider patterns: kind and proposal.
_WIDER = [
    ("email", re.compile(r"(?<![\w.])[a-z0-9][a-z0-9._-]{1,40}\s?[\[(]at[\])]\s?[a-z0-9-]{1,40}\s?[\[(]dot[\])]\s?[a-z]{2,10}\b", re.I)),
    ("phone", re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+.])00[1-9][0-9][0-9\x20-]{7,14}[0-9](?!\w)")),
    ("card", re.compile(r"(?<![\w.])[0-9]{4}(?:[.\x20/-][0-9]{4}){3}(?!\w)")),
    ("ip", re.compile(r"(?<![\w:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![\w:])")),
    ("secret", re.compile(r"(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{12,20}(?!\w)")),
    ("secret", re.compile(r"(?<!\w)(?:password|passwd|pwd|secret|token|api_?key)\s?[=:]\s?[^\s,;]{6,64}", re.I)),
    ("secret", re.compile(r"(?<!\w)(?=[A-Za-z]*[0-9])[A-Za-z0-9_-]{24,64}(?!\w)")),
]
# Gazetteers.
_ENDINGS = frozenset("com org net edu gov info io de fr es uk eu us co ru it nl ch at".split())
_NEAR = {
    "email": frozenset("mail email e-mail contact write schreiben correo courriel".split()),
    "phone": frozenset("phone tel call mobile cell fax telefon telefono téléphone appel".split()),
    "card": frozenset("card visa credit karte carte tarjeta mastercard payment".split()),
    "ip": frozenset("ip host address server login from addr".split()),
    "secret": frozenset("password key secret token login aws access credentials".split()),
}
_AGAINST = frozenset("version isbn issn article section figure page order invoice total price sum paragraph".split())
_TRIGGER = byte_table(b"0123456789@=:[(")
LABELERS = ("strict", "check", "gazetteer", "context", "shape", "against")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The strict spans, by kind and start: leftmost and without overlap within a kind; a match that fails its check goes."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _HOST.match(text, at + 1)):
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def _votes(kind: str, value: str, before: list[str], strict: bool) -> str:
    """One sign for each labeler: for, against, or 0."""
    digits = "".join(c for c in value if "0" <= c <= "9")
    share = len(digits) / len(value)
    check, listed, shape = "0", "0", "0"
    if kind == "card":
        check = "+" if luhn(digits) else "-"
        listed = "+" if digits[:1] in "3456" else "-"
        shape = "+" if len(digits) in (15, 16) else "-"
    elif kind == "ip":
        check = "+" if ":" in value or all(len(p) <= 3 and int(p) <= 255 for p in value.split(".")) else "-"
        shape = "+" if len(value) >= 7 else "-"
    elif kind == "phone":
        check = "+" if 9 <= len(digits) <= 15 else "-"
        listed = "+" if value[0] in "+(" or value.startswith("00") else "0"
        shape = "+" if any(c in value for c in "()-+") else "-"
    elif kind == "email":
        listed = "+" if re.split(r"[.\])\s]+", value.lower())[-1] in _ENDINGS else "-"
        shape = "+" if len(value) <= 60 else "-"
    else:
        listed = "+" if re.match(r"AKIA|ASIA|passw|pwd|secret|token|api", value, re.I) else "0"
        check = "+" if 0.15 <= share <= 0.8 else "-"
        shape = "+" if any(c.isupper() for c in value) or "=" in value else "-"
    context = "+" if _NEAR[kind].intersection(before) else "0"
    against = "-" if _AGAINST.intersection(before) else "0"
    return ("+" if strict else "0") + check + listed + context + shape + against


def _shape(value: str) -> str:
    return re.sub(r"(.)\1+", r"\1", "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in value))


def _features(kind: str, value: str, votes: str, before: list[str]) -> list[int]:
    """Hashed features: the votes, the shape of the value, its length and the words before it."""
    import zlib

    names = [f"{kind}|v{i}{v}" for i, v in enumerate(votes)] + [f"{kind}|s{_shape(value)[:24]}", f"{kind}|n{min(len(value) // 4, 12)}", *(f"w{w}" for w in before[-2:])]
    return [zlib.crc32(n.encode()) % BUCKETS for n in names]


def proposals(text: str, base: list[tuple[str, int, int]]) -> list[dict]:
    """All spans to be voted on: the base spans and those of the wider patterns."""
    found = [(kind, a, b, True) for kind, a, b in base]
    wider = sorted((m.start(), -m.end(), kind) for kind, p in _WIDER for m in p.finditer(text))
    taken = bytearray(len(text) if wider else 0)
    for _, a, b in base if wider else []:
        taken[a:b] = b"\1" * (b - a)
    for a, b, kind in wider:
        if taken.find(1, a, -b) < 0:
            found.append((kind, a, -b, False))
            taken[a:-b] = b"\1" * (-b - a)
    out = []
    for kind, a, b, strict in found:
        before = re.findall(r"[\w-]+", text[max(0, a - CONTEXT) : a].lower())
        value = text[a:b]
        votes = _votes(kind, value, before, strict)
        out.append({"kind": kind, "start": a, "end": b, "strict": strict, "votes": votes, "features": _features(kind, value, votes, before)})
    return out


PROPOSAL = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("strict", pa.bool_()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))]))
PROPOSAL_DDL = "array<struct<kind:string,start:int,end:int,strict:boolean,votes:string,features:array<int>>>"


def propose(docs: DataFrame) -> DataFrame:
    """doc_id and proposals for each row. Texts without a digit or one of a few signs are passed over unread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch["text"]):
                spans = [[] for _ in range(len(piece))]
                for k in np.flatnonzero(piece.per_text(_TRIGGER[piece.data])):
                    text = piece.text(k).decode()
                    spans[k] = proposals(text, base_spans(text))
                yield pa.record_batch({"doc_id": batch.slice(piece.lo, len(piece))["doc_id"], "proposals": pa.array(spans, PROPOSAL)})

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, proposals {PROPOSAL_DDL}")


def reliabilities(counts: list[tuple[str, str, int]], rounds: int = 50) -> dict[tuple[str, str], float]:
    """Posterior of each (kind, votes) from the counts of vote patterns, at most 3**6 for each of the kinds.

    Labelers vote independently given the truth; each has a rate of its signs among true and among false spans,
    begun as better than chance and smoothed.
    """
    out = {}
    for kind in KINDS:
        rows = [(v, n) for k, v, n in counts if k == kind]
        if not rows:
            continue
        signs = np.array([["-0+".index(c) for c in v] for v, _ in rows])
        n = np.array([x for _, x in rows], float)
        rate = np.empty((2, len(LABELERS), 3))
        rate[1], rate[0] = [0.15, 0.35, 0.5], [0.5, 0.35, 0.15]
        prior = 0.5
        for _ in range(rounds):
            by = np.stack([np.log(rate[t][np.arange(len(LABELERS)), signs]).sum(1) for t in (0, 1)], 1) + np.log([1 - prior, prior])
            post = 1 / (1 + np.exp(np.clip(by[:, 0] - by[:, 1], -50, 50)))
            prior = float(np.clip((post @ n + 1) / (n.sum() + 2), 0.01, 0.99))
            for t, w in ((1, post * n), (0, (1 - post) * n)):
                start = np.array([0.15, 0.35, 0.5] if t else [0.5, 0.35, 0.15]) * 4
                for j in range(len(LABELERS)):
                    got = np.bincount(signs[:, j], w, 3) + start
                    rate[t, j] = got / got.sum()
        out |= {(kind, v): float(p) for (v, _), p in zip(rows, post, strict=True)}
    return out


@dataclass
class SpanModel:
    weights: np.ndarray
    offset: float

    def probability(self, features: list[int]) -> float:
        return 1 / (1 + np.exp(-np.clip(self.weights[features].sum() + self.offset, -40, 40)))


def fit(found: DataFrame, sample_spans: int = SAMPLE_SPANS) -> SpanModel | None:
    """The span classifier, from the table of proposals."""
    each = found.select("doc_id", F.explode("proposals").alias("p")).select("doc_id", "p.*")
    counts = [tuple(r) for r in each.groupBy("kind", "votes").count().collect()]
    posterior = reliabilities(counts)
    if not posterior:
        return None
    # twice the share that is wanted by hash, so that tasks don't each send a whole sample; then exactly the least hashes
    steps = 1 << 30
    share = min(steps, 2 * steps * sample_spans // sum(n for _, _, n in counts) + 1)
    hashed = F.xxhash64("doc_id", "kind", "start")
    order = (F.pmod(hashed, F.lit(steps)), hashed, "doc_id", "start", "kind")
    sample = each.where(F.pmod(hashed, F.lit(steps)) < share).orderBy(*order).limit(sample_spans).select("kind", "votes", "features").collect()
    rows = np.repeat(np.arange(len(sample)), [len(r.features) for r in sample])
    at = np.concatenate([r.features for r in sample])
    y = np.array([posterior[r.kind, r.votes] for r in sample])
    w, b, seen = np.zeros(BUCKETS), 0.0, np.full(BUCKETS + 1, 1e-6)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[at], len(y)) + b, -40, 40)))
        g = np.append(np.bincount(at, (p - y)[rows], BUCKETS) / len(y) + 1e-5 * w, np.mean(p - y))
        seen += g * g
        move = 0.3 * g / np.sqrt(seen)
        w, b = w - move[:-1], b - move[-1]
    return SpanModel(w, float(b))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
SPANS_DDL = "array<struct<kind:string,start:int,end:int>>"


def decide(found: DataFrame, model: SpanModel | None, add_from: float = ADD_FROM) -> DataFrame:
    """doc_id, base and spans (base and added) as lists in the order of kind and start."""
    shared = found.sparkSession.sparkContext.broadcast(model)
    rank = {k: i for i, k in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, spans = [], []
            for each in batch["proposals"].to_pylist():
                each = sorted(each, key=lambda p: (rank[p["kind"]], p["start"]))
                cut = [{k: p[k] for k in ("kind", "start", "end")} for p in each]
                base.append([c for c, p in zip(cut, each, strict=True) if p["strict"]])
                spans.append([c for c, p in zip(cut, each, strict=True) if p["strict"] or shared.value.probability(p["features"]) >= add_from])
            yield pa.record_batch({"doc_id": batch["doc_id"], "base": pa.array(base, SPANS), "spans": pa.array(spans, SPANS)})

    return found.mapInArrow(run, f"doc_id long, base {SPANS_DDL}, spans {SPANS_DDL}")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans for each row of ``docs``."""
    found = written(propose(docs), "proposals")
    return decide(found, fit(found))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in angle brackets; n_chars follows."""
    found = written(propose(docs), "proposals")
    model = fit(found)
    removed(found)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch["text"].to_pylist():
                each = proposals(text, base_spans(text)) if text else []
                each = [p for p in each if p["strict"] or shared.value.probability(p["features"]) >= ADD_FROM]
                parts, last = [], 0
                for p in sorted(each, key=lambda p: (p["start"], -p["end"])):
                    if p["start"] >= last:
                        parts += [text[last : p["start"]], f"<{p['kind']}>"]
                    last = max(last, p["end"])
                texts.append("".join(parts) + text[last:] if each else text)
            yield pa.record_batch({n: pa.array(texts, pa.string()) if n == "text" else batch[n] for n in batch.schema.names})

    plain = plain_names(docs)
    out = plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the numbers of base spans of the four strict kinds, the digest of the base spans, and all spans as text."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = [F.size(F.filter(F.col("base.kind"), lambda x: x == F.lit(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS[:4]]  # noqa: B023
    return find(docs).select("doc_id", *n, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
