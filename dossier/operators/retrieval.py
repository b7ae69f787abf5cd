"""Retrieval for review: chunks by BM25, vectors by cosine, contexts, and document types by markers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.shared import small

K1, B = 1.5, 0.75
#: Query vectors are broadcast so many at a time, and terms of queries.
QUERY_ROWS, TERM_ROWS = 10_000, 200_000
#: A task sums the scores of about so many pairs of a chunk and a query, in up to so many tasks.
PAIR_ROWS, TASKS = 2_000_000, 20_000
#: It holds about so many of them at a time; terms are counted in slices of so many chunks.
PAIRS, SLICE_ROWS = 1_000_000, 10_000


def bm25_topk(chunks: DataFrame, queries: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """The k best chunks of each query (query_id, text). Tokens are lower-cased parts between white space.

    k1 = 1.5, b = 0.75, idf = ln((N - df + 0.5) / (df + 0.5) + 1). Only chunks that share a token are met. The chunks are
    dealt by their keys, rows of equal keys and length being one chunk, and read twice: for the counts of terms, and for
    the scores, which a task sums as matrices of some chunks by queries, so that neither terms nor pairs of chunks and
    queries become rows. Each task keeps its own best. The terms of the queries go to the tasks in blocks of some
    TERM_ROWS, each of which reads the chunks again. Equal scores go by the keys.
    """
    session = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(TASKS, -(-chunks.count() * queries.count() // PAIR_ROWS))
    tokens = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    docs = chunks.select(*keys, "text").repartition(*([tasks] if tasks > session else []), *keys).select(*keys, tokens("text").alias("t")).withColumn("n", F.size("t"))
    # sorted by the keys, which settle equal scores; the first row of each key is marked
    docs = docs.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy("n")))
    asked = queries.select("query_id", F.explode(tokens("text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    blocks = max(1, -(-asked.count() // TERM_ROWS))
    out = StructType([queries.schema["query_id"], *[chunks.schema[c] for c in keys], StructField("score", DoubleType())])
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), *keys))

    def best(block: int) -> DataFrame:
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        t = own.toArrow().combine_chunks()
        ids, terms = (t[c].combine_chunks().dictionary_encode(null_encoding="encode") if t.num_rows else None for c in ("query_id", "term"))
        if ids is None:
            return chunks.sparkSession.createDataFrame([], out)
        counted = docs.select("n", "rn", "t").mapInArrow(_terms_in_task(terms.dictionary), "kind string, at int, n long").groupBy("kind", "at").agg(F.sum("n").alias("n")).toArrow()
        counts = {kind: counted.filter(pc.equal(counted["kind"], kind)) for kind in ("rows", "known", "words", "df")}
        n_all, known, words = (sum(counts[c]["n"].to_pylist()) for c in ("rows", "known", "words"))
        df = np.zeros(len(terms.dictionary))
        df[counts["df"]["at"].to_numpy()] = counts["df"]["n"].to_numpy()
        term, query = terms.indices.to_numpy(), ids.indices.to_numpy()
        order = np.argsort(term, kind="stable")
        weight = (t["qf"].to_numpy() * np.log((n_all - df + 0.5) / (df + 0.5) + 1)[term])[order]
        first = np.searchsorted(term[order], np.arange(len(df) + 1))
        return docs.mapInArrow(_chunks_in_task(terms.dictionary, ids.dictionary, first, query[order], weight, words / max(known, 1), k, keys), out)

    scores = reduce(DataFrame.unionByName, map(best, range(blocks))).withColumn("score", F.round("score", 6))
    return scores.withColumn("place", place).where(F.col("place") <= k)


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows in slices of about so many, none of which parts the rows of a key."""
    left = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if left is None else pa.concat_tables([left, t])
        starts, at = np.flatnonzero(t["rn"].to_numpy() == 1), 0
        while (i := np.searchsorted(starts, at + rows)) < len(starts):
            yield t.slice(at, starts[i] - at)
            at = starts[i]
        left = t.slice(at)
    if left is not None and left.num_rows:
        yield left


def _terms(t: pa.Table, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of equal keys and length are one chunk: the first row of each, and for its terms chunk, term and times."""
    n, rn = t["n"].fill_null(-1).to_numpy(), t["rn"].to_numpy()
    head = rn == 1
    head[1:] |= n[1:] != n[:-1]
    words = t["t"].combine_chunks()
    at = pc.fill_null(pc.index_in(words.flatten(), value_set=terms), -1).to_numpy()
    chunk = np.repeat(np.cumsum(head) - 1, pc.fill_null(pc.list_value_length(words), 0).to_numpy())
    code, times = np.unique((chunk * len(terms) + at)[at >= 0], return_counts=True)
    return np.flatnonzero(head), code // len(terms), code % len(terms), times


def _terms_in_task(terms: pa.Array) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a task: rows, rows with words and their words, and chunks by term."""
    size = SLICE_ROWS

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows, known, words = np.zeros(len(terms), np.int64), 0, 0, 0
        for t in _slices(batches, size):
            df += np.bincount(_terms(t, terms)[2], minlength=len(terms))
            rows, known, words = rows + t.num_rows, known + t.num_rows - t["n"].null_count, words + (pc.sum(t["n"]).as_py() or 0)
        at = np.flatnonzero(df)
        kind = ["rows", "known", "words"] + ["df"] * len(at)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate(([0, 0, 0], at)).astype(np.int32)), pa.array(np.concatenate(([rows, known, words], df[at])).astype(np.int64))], ["kind", "at", "n"])

    return task


def _chunks_in_task(terms: pa.Array, ids: pa.Array, first: np.ndarray, query: np.ndarray, weight: np.ndarray, mean: float, k: int, keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best chunks of a task for each query, of equal scores the earlier ones. The queries of a term are those of
    ``query`` from first[term] on, with their weights."""
    size = max(1, PAIRS // len(ids))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, asked, score = None, np.zeros(0, np.int64), np.zeros(0)
        least = np.zeros(len(ids))
        for t in _slices(batches, size):
            head, chunk, term, times = _terms(t, terms)
            key = (np.cumsum(t["rn"].to_numpy() == 1) - 1)[head]
            n = t["n"].fill_null(0).to_numpy()[head][chunk]
            part = times * (K1 + 1) / (times + K1 * (1 - B + B * n / mean)) if len(n) else np.zeros(0)
            many = first[term + 1] - first[term]
            pair = np.repeat(first[term] - np.cumsum(many) + many, many) + np.arange(many.sum())
            shape = (key[-1] + 1, len(ids))
            s = np.bincount(np.repeat(key[chunk], many) * len(ids) + query[pair], np.repeat(part, many) * weight[pair], shape[0] * shape[1]).reshape(shape)
            good = s > least
            if shape[0] > k and np.count_nonzero(good) > 20 * k * len(ids):
                good &= s >= np.partition(s, -k, axis=0)[-k] - 1e-6
            row, col = np.nonzero(good)
            heads = t.select(keys).take(np.flatnonzero(t["rn"].to_numpy() == 1)[row])
            found = heads if found is None else pa.concat_tables([found, heads])
            asked, score = np.concatenate((asked, col)), np.concatenate((score, s[row, col]))
            rounded = np.round(score, 6)
            order = np.lexsort((-rounded, asked))
            place = np.arange(len(order)) - np.searchsorted(asked[order], asked[order])
            kept = np.sort(order[place < k])
            found, asked, score, rounded = found.take(kept), asked[kept], score[kept], rounded[kept]
            full = np.bincount(asked, minlength=len(ids)) >= k
            lowest = np.full(len(ids), np.inf)
            np.minimum.at(lowest, asked, rounded)
            least = np.where(full, lowest, 0.0)
        if found is not None and len(asked):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(asked)), *[found[c].combine_chunks() for c in keys], pa.array(score)], ["query_id", *keys, "score"])

    return task


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, decimals: int = 6) -> DataFrame:
    """The k nearest vectors (vec_id, embedding) of each query by cosine, without itself; ties by id.

    The queries are a stated set, taken in blocks of some QUERY_ROWS; every vector is compared with each of them, as a
    product of matrices in batches of rows, and each task keeps its own best before the shuffle. Vectors that are null, of
    another length than most queries of the block, with null or non-finite components or without a direction are compared
    by columns.
    """
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_q"))
    blocks = max(1, -(-q.count() // QUERY_ROWS))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ids = vectors.schema["vec_id"].dataType.simpleString()

    def plain(c: str, size: int) -> Column:
        finite = F.forall(c, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < 1e100), F.lit(False)))
        return F.coalesce((F.size(c) == size) & finite & F.exists(c, lambda x: F.abs(x) > 1e-100), F.lit(False))

    def compared(left: DataFrame, right: DataFrame) -> DataFrame:
        met = left.join(F.broadcast(right), F.col("vec_id") != F.col("query_id"))
        return met.select("query_id", "vec_id", F.round(cosine(F.col("embedding"), F.col("_q")), decimals).alias("score"))

    def nearest(block: int) -> DataFrame:
        own = q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        size = own.groupBy(F.size("_q").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
        size = size[0]["n"] if size else 0
        rows = own.where(plain("_q", size)).where("query_id is not null").collect()
        fit = plain("embedding", size)
        met = compared(vectors, own.where(~plain("_q", size))).unionByName(compared(vectors.where(~fit), own.where(plain("_q", size))))
        if rows:
            task = _nearest_in_task(np.array([r["query_id"] for r in rows]), np.array([r["_q"] for r in rows], np.float64), k, decimals)
            met = met.unionByName(vectors.where(fit).where("vec_id is not null").select("vec_id", "embedding").mapInPandas(task, f"query_id {ids}, vec_id {ids}, score double"))
        return met.withColumn("place", place).where(F.col("place") <= k)

    return reduce(DataFrame.unionByName, map(nearest, range(blocks)))


def _nearest_in_task(ids: np.ndarray, asked: np.ndarray, k: int, decimals: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The k best rows of a task for each query, of equal scores those of the least ids."""
    asked = asked / np.sqrt((asked * asked).sum(1))[:, None]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score, found = np.full((len(ids), 0), 0.0), np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            x = np.array(batch["embedding"].tolist(), np.float64).reshape(-1, asked.shape[1])
            own = batch["vec_id"].to_numpy()
            x /= np.sqrt((x * x).sum(1))[:, None]
            for at in range(0, len(x), 2048):
                s = np.round(asked @ x[at : at + 2048].T, decimals) + 0.0
                part = own[at : at + 2048]
                s[ids[:, None] == part[None, :]] = -np.inf
                score = np.concatenate((score, s), 1)
                found = np.concatenate((found, np.broadcast_to(part, s.shape)), 1)
                best = np.lexsort((found, -score))[:, :k] if score.shape[1] <= 64 else _best(score, found, k)
                score, found = np.take_along_axis(score, best, 1), np.take_along_axis(found, best, 1)
        row, col = np.nonzero(score > -np.inf)
        yield pd.DataFrame({"query_id": ids[row], "vec_id": found[row, col], "score": score[row, col]})

    return task


def _best(score: np.ndarray, found: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row: those above the k-th score, and of the ones equal to it the least ids."""
    edge = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
    out = np.empty((len(score), k), np.int64)
    for i, (s, e) in enumerate(zip(score, edge, strict=True)):
        at = np.flatnonzero(s >= e)
        out[i] = at[np.lexsort((found[i, at], -s[at]))[:k]]
    return out


def assemble_context(hits: DataFrame, source: str, text: str = "text") -> DataFrame:
    """One text for each query: its hits in order, each under its source."""
    part = F.concat(F.lit("[source="), F.col(source).cast("string"), F.lit("]\n"), F.col(text))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", part.alias("p")))), lambda x: x["p"])
    return hits.groupBy("query_id").agg(F.count("*").alias("n_hits"), F.array_join(parts, "\n\n").alias("context"))


def classify_documents(docs: DataFrame, markers: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Type with the highest sum of marker weights. ``markers`` (a small table): doc_type, marker, weight.

    confidence = min(0.99, 0.55 + 0.1 best + 0.05 (best - second)); a tie is a conflict. Documents without a marker are unknown.
    """
    met = docs.select(key, F.lower(text).alias("_t")).join(small(markers), F.contains("_t", "marker"))
    sums = met.groupBy(key, "doc_type").agg(F.sum("weight").alias("s"))
    top = F.slice(F.sort_array(F.collect_list(F.struct("s", "doc_type")), False), 1, 2)
    best = sums.groupBy(key).agg(top.alias("top"))
    second = F.coalesce(F.get(F.col("top.s"), F.lit(1)), F.lit(0.0))
    first = F.get(F.col("top.s"), F.lit(0))
    conf = F.round(F.least(F.lit(0.99), 0.55 + 0.1 * first + 0.05 * (first - second)), 4)
    out = docs.select(key).join(best.select(key, F.get(F.col("top.doc_type"), F.lit(0)).alias("doc_type"), conf.alias("confidence"), (first == second).alias("conflict")), key, "left")
    return out.select(key, F.coalesce("doc_type", F.lit("unknown")).alias("doc_type"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("conflict", F.lit(False)).alias("conflict"))


def top_evidence(df: DataFrame, key: str, score: str, text: str, n: int = 3) -> DataFrame:
    """The n strongest pieces of evidence of each key, joined."""
    best = F.slice(F.sort_array(F.collect_set(F.struct(F.col(score), F.col(text))), False), 1, n)
    return df.groupBy(key).agg(F.array_join(F.transform(best, lambda x: x[text].cast("string")), ",").alias("evidence"))
