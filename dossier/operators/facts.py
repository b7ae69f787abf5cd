"""Facts of documents by type: fields that anchors in the text, or in the keys of key-value tables, point at.

All anchors of a document type are one multi-pattern automaton, which reads a text once however many rules there are.
Texts are read where they lie, in Arrow batches: nothing is shuffled but what was found. A field may be found in several
ways; the first way that found anything counts, and within a way the first place.

Lines are parted by newlines, cleaned of runs of white space, and left out if empty. Case doesn't count. Nulls: a null
text has no lines, a null key or type meets no rule; a null or empty value is a fact without text. Repeated documents
of one id are read as one. Very long texts and lines are read whole.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extract_amounts, extract_dates, extract_percents, norm_text, to_bool


@dataclass(frozen=True)
class Rule:
    """A field of a document type. Ways: ``after`` (what follows the colon of the first line with an anchor, or else the
    next line, or else the line), ``value`` (the first line with an anchor that has something after its colon), ``key``
    (the value of the first key with an anchor). ``kind`` says how it is read: text, amount, date, percent or flag."""

    doc_type: str
    field: str
    ways: tuple[tuple[str, tuple[str, ...]], ...]
    kind: str = "text"


def _after(*anchors: str):
    return (("after", anchors),)


def _key(*anchors: str):
    return (("key", anchors),)


_SUBJECT = ("предмет закупки", "объект закупки")
_TERM = ("срок оказания услуг", "срок оказания", "срок поставки", "срок выполнения")
_SUBCONTRACT = (("key", ("субподряд", "сонко")),)
# The fields of each document type, their anchors, and how they are read.
RULES = [
    Rule("plan", "subject", _key("наименование объекта закупки", "предмет закупки")),
    Rule("plan", "nmck", _key("начальная", "нмцк", "цена контракта"), "amount"),
    Rule("plan", "method", _key("способ закупки", "способ определения", "способ выбора")),
    Rule("plan", "basis", _key("основание", "единственный поставщик")),
    Rule("plan", "funding", _key("источник финансирования")),
    Rule("plan", "delivery_place", _key("место поставки", "адрес поставки", "место оказания")),
    Rule("plan", "delivery_term", _key("сроки поставки товара", "срок поставки", "срок оказания", "срок выполнения"), "date"),
    Rule("plan", "contract_term", _key("срок исполнения контракта"), "date"),
    Rule("plan", "has_stages", _key("этапы исполнения"), "flag"),
    Rule("plan", "smp_preference", _key("преимуществ", "смп"), "flag"),
    Rule("plan", "subcontract", _SUBCONTRACT, "flag"),
    Rule("plan", "subcontract_percent", (("key", ("процент", "объем привлечения")), *_SUBCONTRACT), "percent"),
    Rule("plan", "bid_security", _key("размер обеспечения заявки", "обеспечение заявки"), "percent"),
    Rule("plan", "contract_security", _key("размер обеспечения исполнения контракта", "обеспечение исполнения контракта"), "percent"),
    Rule("plan", "warranty_security", _key("размер обеспечения гарантийных обязательств", "обеспечение гарантийных обязательств"), "percent"),
    Rule("plan", "extra_requirements", _key("дополнительные требования")),
    Rule("plan", "national_regime", _key("национальный режим")),
    Rule("request", "subject", _after(*_SUBJECT)),
    Rule("request", "method", _after("способ закупки")),
    Rule("request", "basis", _after("основание")),
    Rule("request", "delivery_term", _after("срок поставки", "срок выполнения"), "date"),
    Rule("request", "stages", _after("этапы исполнения", "этапность"), "flag"),
    Rule("onmck", "method", _after("метод")),
    Rule("onmck", "subject", _after(*_SUBJECT)),
    Rule("onmck", "variation", _after("коэффициент вариации"), "percent"),
    Rule("ooz", "subject", _after(*_SUBJECT)),
    Rule("ooz", "delivery_place", _after("место поставки", "адрес поставки")),
    Rule("ooz", "delivery_term", _after(*_TERM), "date"),
    Rule("ooz", "warranty", _after("гаранти")),
    Rule("contract", "number", _after("контракт №", "контракт n")),
    Rule("contract", "subject", _after("предмет контракта", "предмет закупки")),
    Rule("contract", "delivery_place", _after("место поставки", "адрес поставки")),
    Rule("contract", "delivery_term", _after(*_TERM), "date"),
    Rule("contract", "contract_term", (("value", ("срок исполнения контракта",)), ("after", ("срок исполнения контракта",))), "date"),
    Rule("explanatory_note", "subject", _after(*_SUBJECT)),
    Rule("explanatory_note", "method", _after("способ закупки")),
    Rule("explanatory_note", "justification", _after("обоснование")),
    Rule("commercial_offer", "supplier", _after("поставщик", "организация")),
    Rule("commercial_offer", "outgoing_number", _after("исх", "исходящий")),
    Rule("commercial_offer", "outgoing_date", _after("исх", "исходящий"), "date"),
    Rule("commercial_offer", "offer_date", _after("дата", "от"), "date"),
    Rule("commercial_offer", "subject", _after("предмет", "объект закупки")),
    Rule("commercial_offer", "delivery_term", _after("срок поставки", "срок оказания", "срок выполнения"), "date"),
    Rule("commercial_offer", "delivery_place", _after("место поставки", "место оказания", "адрес поставки")),
    Rule("commercial_offer", "advance", _after("аванс", "авансовый")),
    Rule("commercial_offer", "vat", _after("ндс"), "percent"),
]
_SPACE = re.compile(r"[ \t\r\f\x0b]+")


class Anchors:
    """The automatons of the rules by document type, for the ways that read lines or those that read keys."""

    def __init__(self, rules: list[Rule], ways: tuple[str, ...]):
        by_type: dict[str, dict[str, list[tuple[int, int]]]] = {}
        for r, rule in enumerate(rules):
            for w, (way, anchors) in enumerate(rule.ways):
                for a in anchors if way in ways else ():
                    by_type.setdefault(rule.doc_type, {}).setdefault(a.casefold(), []).append((r, w))
        self._by_type = {}
        for doc_type, anchors in by_type.items():
            machine = ahocorasick.Automaton()
            for a, targets in anchors.items():
                machine.add_word(a, targets)
            machine.make_automaton()
            self._by_type[doc_type] = machine, len({t for targets in anchors.values() for t in targets})

    def knows(self, doc_type: str | None) -> bool:
        return doc_type in self._by_type

    def hits(self, doc_type: str | None, text: str) -> Iterator[tuple[int, int, int]]:
        """(end of the anchor, rule, way) of all anchors in a text in lower case, in the order of their ends."""
        for end, targets in self._by_type[doc_type][0].iter(text):
            for r, w in targets:
                yield end, r, w

    def n_targets(self, doc_type: str) -> int:
        return self._by_type[doc_type][1]


def lines_of(text: str) -> list[str]:
    return [x for x in (_SPACE.sub(" ", line).strip(" ") for line in text.split("\n")) if x]


def read_text(text: str, doc_type: str, anchors: Anchors, rules: list[Rule]) -> list[tuple[int, int, int, str]]:
    """(rule, way, line, value) of each rule and way at its first place."""
    lines = lines_of(text)
    folded = [x.casefold() for x in lines]
    ends, at = [], 0
    for x in folded:
        at += len(x)
        ends.append(at)
        at += 1
    found: dict[tuple[int, int], tuple[int, str]] = {}
    for end, r, w in anchors.hits(doc_type, "\n".join(folded)):
        if (r, w) in found:
            continue
        k = bisect.bisect_right(ends, end)
        tail = lines[k].partition(":")[2].strip(" ")
        if tail:
            found[r, w] = k, tail
        elif rules[r].ways[w][0] == "after":
            found[r, w] = k, lines[k + 1] if k + 1 < len(lines) else lines[k]
        if len(found) == anchors.n_targets(doc_type):
            break
    return [(r, w, k, value) for (r, w), (k, value) in found.items()]


_HITS = "r int, w int, ord long, raw string"


def _found(df: DataFrame, key: str, rules: list[Rule], ways: tuple[str, ...], each) -> DataFrame:
    """key, r, w, ord, raw: what ``each`` (of a batch and the anchors: row, rule, way, place, value) finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(rules, ways)
        for batch in batches:
            hits = list(each(batch, anchors))
            row, r, w, at, raw = zip(*hits, strict=True) if hits else ((),) * 5
            yield pa.record_batch({"key": batch["key"].take(pa.array(row, pa.int64())), "r": pa.array(r, pa.int32()), "w": pa.array(w, pa.int32()), "ord": pa.array(at, pa.int64()), "raw": pa.array(raw, pa.string())})

    return df.mapInArrow(run, f"key {df.schema['key'].dataType.simpleString()}, {_HITS}")


def document_facts(docs: DataFrame, pairs: DataFrame | None = None, rules: list[Rule] = RULES, key: str = "doc_id") -> DataFrame:
    """key, doc_type, field, way, ord, raw, norm, amount, percent, date, flag: the facts of each document by the rules of its type.

    ``docs``: key, doc_type, text; ``pairs`` (of key-value tables): key, doc_type, seq, name, value.
    """

    def texts(batch: pa.RecordBatch, anchors: Anchors):
        for row, (doc_type, text) in enumerate(zip(batch["doc_type"].to_pylist(), batch["text"].to_pylist(), strict=True)):
            if text and anchors.knows(doc_type):
                for r, w, k, value in read_text(text, doc_type, anchors, rules):
                    yield row, r, w, k, value

    def keys(batch: pa.RecordBatch, anchors: Anchors):
        for row, (doc_type, seq, name, value) in enumerate(zip(*(batch[c].to_pylist() for c in ("doc_type", "seq", "name", "value")), strict=True)):
            if name and anchors.knows(doc_type):
                for r, w in {(r, w) for _, r, w in anchors.hits(doc_type, name.casefold())}:
                    yield row, r, w, seq, value

    named = lambda df, *more: df.select(F.col(key).alias("key"), "doc_type", *more)
    hits = _found(named(docs, "text"), key, rules, ("after", "value"), texts)
    if pairs is not None:
        hits = hits.unionByName(_found(named(pairs, F.col("seq").cast("long").alias("seq"), "name", "value"), key, rules, ("key",), keys))
    first = hits.groupBy("key", "r").agg(F.min(F.struct("w", "ord", "raw")).alias("b"))
    names = F.lit([f"{r.doc_type}\t{r.field}\t{r.kind}" for r in rules])
    rule = F.split(F.get(names, F.col("r")), "\t")
    way = F.get(F.split(F.get(F.lit([",".join(w for w, _ in r.ways) for r in rules]), F.col("r")), ","), F.col("b.w"))
    out = first.select(F.col("key").alias(key), rule[0].alias("doc_type"), rule[1].alias("field"), rule[2].alias("_kind"), way.alias("way"), F.col("b.ord").alias("ord"), F.col("b.raw").alias("raw"))
    return out.select(
        key, "doc_type", "field", "way", "ord", "raw", norm_text(F.col("raw")).alias("norm"), _read("amount", F.get(extract_amounts(F.col("raw")), F.lit(0))),
        _read("percent", F.get(extract_percents(F.col("raw")), F.lit(0))), _read("date", F.get(extract_dates(F.col("raw")), F.lit(0))), _read("flag", to_bool(F.col("raw"))),
    )


def _read(kind: str, value: Column) -> Column:
    return F.when(F.col("_kind") == kind, value).alias(kind)
