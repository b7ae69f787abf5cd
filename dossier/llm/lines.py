"""Operator 9: line dedup by winnowing.

Lines are hashed; of every WINDOW consecutive lines the one with the least hash is a fingerprint (the last of equal
ones), so any run of WINDOW lines that two places share has a fingerprint that both select. Fingerprints that occur
once are done. Around the others the places are joined and the match is extended both ways: every run of WINDOW lines
that holds the fingerprint is compared over all places that have it, and joined runs make up the full match. The
first place in (doc_id, position) keeps its lines; at later places the lines of the run are deleted.

So the result is: a line goes if it lies in a run of WINDOW lines that also stands at an earlier place, of the same
or another document. Lines compare without ASCII white space at their ends; blank lines are passed over and stay.

Lines are compared by 64-bit hashes, runs by two independent ones of all their lines. Hot lines and runs are counted
before the shuffle, joined with one first place for each run (never with each other), and split by Spark where the join
is skewed. Nulls: a null text has no lines and stays null; documents without id come last in the order. Rows with equal
id and equal lines are one document and treated alike; of equal ids with other lines the order is that of a hash. Very
long texts are cut into lines whole. Further columns are kept; ``line_dedup`` replaces those named n_lines and n_dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import ODD, SPACE, Slice, binaries, lists, mix, slices, texts
from .shared import ddl, free_names, plain_names, removed, small_batches, written

WINDOW = 2


def filled_lines(piece: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each line that isn't blank (without white space at its ends), its text, and its number there."""
    lines = piece.lines()
    solid = np.flatnonzero(~SPACE[piece.data])
    a, b = np.searchsorted(solid, lines.start), np.searchsorted(solid, lines.end)
    some = b > a
    home = lines.home()
    return solid[a[some]], solid[b[some] - 1] + 1, home[some], (np.arange(len(home)) - lines.first[home])[some]


def _signs(h: np.ndarray, home: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One number for the lines of each text in their order."""
    sign = np.zeros(len(first) - 1, np.uint64)
    np.add.at(sign, home, mix(h + (np.arange(len(h)) - first[home]).astype(np.uint64) * ODD[7]))
    return sign.view(np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch["text"]):
            start, end, home, _ = filled_lines(piece)
            h, again = piece.span_hash(start, end), piece.span_hash(start, end, 1)
            first = np.searchsorted(home, np.arange(len(piece) + 1))
            # a run starts at each line that has WINDOW - 1 more after it in its text; there is no run in a shorter text
            n = np.diff(first)
            left = np.repeat(first[1:], n) - np.arange(len(h))
            begin = np.flatnonzero(left >= WINDOW)
            chosen = begin.copy()
            for j in range(1, WINDOW):
                chosen = np.where(h[begin + j] <= h[chosen], begin + j, chosen)
            chosen = np.unique(chosen)
            run = np.zeros((len(begin), 2), np.uint64)
            for j in range(WINDOW):
                for k, x in enumerate((h, again)):
                    run[:, k] += mix(x[begin + j] + ODD[4060 + j]) * ODD[4070 + j]
            of = home[begin]
            runs = binaries(mix(run).view(np.uint8).ravel(), 16 * np.arange(len(begin) + 1))
            rows = batch.slice(piece.lo, len(piece))
            yield pa.record_batch({
                "doc_id": rows["doc_id"], "sign": pa.array(_signs(h, home, first)), "lines": lists(h.view(np.int64), first, pa.int64()),
                "runs": pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(piece) + 1)), pa.int32()), runs),
                "marks": lists(chosen - first[home[chosen]] if len(chosen) else chosen, np.searchsorted(chosen, first), pa.int32()),
            })


def _without(batches: Iterator[pa.RecordBatch], fields: list[str], names: list[str], drop: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch["text"]):
            lines = piece.lines()
            _, _, home, number = filled_lines(piece)
            filled = np.searchsorted(home, np.arange(len(piece) + 1))
            rows = batch.slice(piece.lo, len(piece))
            wanted = rows[drop]
            size = np.diff(wanted.offsets.to_numpy()) * wanted.is_valid().to_numpy(zero_copy_only=False)
            at = np.repeat(filled[:-1], size) + wanted.flatten().to_numpy(zero_copy_only=False)
            gone = np.zeros(len(lines.start), bool)
            gone[lines.first[home[at]] + number[at]] = True
            # a line goes with the newline after it; where the last line goes, with the one before it
            edge = np.zeros(len(piece.data) + 2, np.int64)
            last = np.zeros(len(gone), bool)
            last[lines.first[1:] - 1] = True
            kept = np.concatenate(([0], np.cumsum(~gone)))
            before = kept[lines.first[1:]] > kept[lines.first[:-1]]
            np.add.at(edge, lines.start[gone], 1)
            np.add.at(edge, (lines.end + ~last)[gone], -1)
            keep = np.cumsum(edge)[: len(piece.data)] == 0
            # the newline before a run of lines that goes up to the end of its text
            tail = np.flatnonzero(gone[lines.first[1:] - 1] & before)
            final = np.searchsorted(np.flatnonzero(~gone), lines.first[1:][tail]) - 1
            keep[lines.end[np.flatnonzero(~gone)[final]]] = False
            own = {"text": texts(piece.data[keep], np.concatenate(([0], np.cumsum(keep)))[piece.offs], rows["text"])}
            own |= dict(zip(names, (pa.array(np.diff(filled)), pa.array(size, pa.int64())), strict=True))
            yield pa.record_batch({n: own[n] if n in own else rows[n] for n in [*fields, *names]})


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, sign and drop: the numbers of the lines to delete (among lines that aren't blank), for documents that have any."""
    small_batches(docs.sparkSession)
    hashed = written(docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, sign long, lines array<long>, runs array<binary>, marks array<int>"), "lines")
    each = hashed.dropDuplicates(["doc_id", "sign"]) if hashed.groupBy("doc_id", "sign").count().where("count > 1").limit(1).count() else hashed
    order = F.coalesce("doc_id", F.lit(2**63 - 1))
    marks = each.where(F.size("marks") > 0).select(order.alias("at"), "doc_id", "sign", "lines", "runs", F.explode("marks").alias("mark"))
    marks = marks.withColumn("print", F.get("lines", F.col("mark")))
    seen = marks.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print")
    starts = F.sequence(F.greatest(F.col("mark") - (WINDOW - 1), F.lit(0)), F.least(F.col("mark"), F.size("runs") - 1))
    near = marks.select("at", "doc_id", "sign", "print", F.transform(starts, lambda i: F.struct(i.alias("pos"), F.get("runs", i).alias("run"))).alias("runs"))
    runs = near.join(seen, "print").select("at", "doc_id", "sign", F.explode("runs").alias("r")).select("at", "doc_id", "sign", "r.pos", "r.run").distinct()
    runs = written(runs, "line-runs")
    removed(hashed)
    first = runs.groupBy("run").agg(F.min(F.struct("at", "sign", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = runs.join(first, "run").where(F.struct("at", "sign", "pos") > F.col("first"))
    lines = F.explode(F.sequence(F.col("pos"), F.col("pos") + (WINDOW - 1)))
    return later.select("doc_id", "sign", lines.alias("line")).groupBy("doc_id", "sign").agg(F.sort_array(F.collect_set("line")).alias("drop"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` without the repeated lines in text, with n_lines (not blank) and n_dropped."""
    return _deduped(docs.drop("n_lines", "n_dropped"), ["n_lines", "n_dropped"])


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with its own columns only, without the repeated lines in text."""
    plain = plain_names(docs)
    return _deduped(plain, free_names(plain, "n_lines", "n_dropped")).select(*plain.columns).toDF(*docs.columns)


def _deduped(docs: DataFrame, names: list[str]) -> DataFrame:
    fields = docs.columns
    own, mine, theirs, drop = free_names(docs, "sign", "of_doc", "of_sign", "drop")
    found = repeated_lines(docs).select(F.col("doc_id").alias(mine), F.col("sign").alias(theirs), F.col("drop").alias(drop))
    signs = docs.mapInArrow(lambda batches: _signed(batches, fields, own), f"{ddl(docs)}, `{own}` long")
    joined = signs.join(found, F.col("doc_id").eqNullSafe(F.col(mine)) & (F.col(own) == F.col(theirs)), "left").drop(mine, theirs, own)
    out = joined.mapInArrow(lambda batches: _without(batches, fields, names, drop), ddl(docs) + "".join(f", `{n}` long" for n in names))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in fields else out


def _signed(batches: Iterator[pa.RecordBatch], fields: list[str], own: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch["text"]):
            start, end, home, _ = filled_lines(piece)
            rows = batch.slice(piece.lo, len(piece))
            sign = _signs(piece.span_hash(start, end), home, np.searchsorted(home, np.arange(len(piece) + 1)))
            yield pa.record_batch({n: rows[n] for n in fields} | {own: pa.array(sign)})


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of the text that is left (a null text counts as empty)."""
    return line_dedup(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
