"""Operator 3: near-duplicates by an inverted join over the coordinates of MinHash signatures.

Documents with the same shingle set form a class, and one document of it stands for all. Each class is posted under
every pair (coordinate, value) of its signature. Pairs of one posting are counted and skipped. Of a class with m
shared postings only the m - T + 1 rarest are its prefix, where T is the number of coordinates that two signatures
must share: two classes that share T meet in both prefixes, and classes with fewer than T shared postings meet none.

Classes with more shingles that no other candidate has than the similarity allows are done. Inside a posting no pairs
are listed. Round one joins each class with the hub of its posting, the class whose postings are the most common; a
pair with at least T equal coordinates is confirmed on the full sets. Round two skips classes that a confirmed hub
already links. The classes of a hub that it leaves open are kept as what each lacks and has beside the hub, short
lists from which the overlap of two classes follows; the join on the hub compares them in its condition, gives out
links alone, and is split by Spark where a hub has many classes. So each pair above the threshold is confirmed, or
linked through its hub, or cannot be a link; T leaves a pair at the threshold out with a chance of at most MISS.
Components are found by least labels and pointer jumps over tables in the shared folder.

Words are split at ASCII white space after lower-casing A-Z. Nulls: a document with no words or a null text links with
nothing and stands for itself; a row without id also links with nothing, has no component and is kept. Repeated rows
are copies of each other; rows of equal id are all kept. Very long texts are hashed whole. Of a class or component the
least id stands for all; equal postings are ordered by their numbers and hubs by their ids, so ties don't depend on the
order of rows. Further columns are not looked at; ``drop_near_duplicates`` keeps them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .kernels import ODD, SPACE, Slice, lists, mix, slices
from .shared import plain_names, removed, small_batches, written

COORDINATES = 64
#: Chance that a pair exactly at the similarity shares fewer coordinates than the threshold.
MISS = 1e-9


def threshold(percent: int, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """Most equal coordinates that a pair of this similarity has with a chance of at least 1 - miss."""
    p, below = percent / 100, 0.0
    for t in range(coordinates + 1):
        below += math.comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if below > miss:
            return max(t, 1)
    return coordinates


def shingle_sets(piece: Slice, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, and where those of each text begin."""
    piece = piece.lowered()
    words = piece.runs(SPACE)
    h, homes = words.hashes(), words.home()
    found, at = words.windows(h, width)
    parts, home = [found], [homes[at]]
    for n in range(1, width):
        if (words.count == n).any():
            found, at = words.windows(h, n)
            short = words.count[homes[at]] == n
            parts.append(found[short])
            home.append(homes[at][short])
    found, home = np.concatenate(parts), np.concatenate(home)
    order = np.lexsort((found, home))
    found, home = found[order], home[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (home[1:] != home[:-1])
    found, home = found[new], home[new]
    return found, np.searchsorted(home, np.arange(len(piece) + 1))


def signatures(docs: DataFrame, width: int, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, n_shingles, cls (digest of the set, null for an empty one) and signature for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch["text"]):
                sets, first = shingle_sets(piece, width)
                some = np.flatnonzero(np.diff(first))
                begin = first[:-1][some]
                sign = np.zeros((len(some), coordinates), np.uint64)
                cls = np.zeros((len(some), 2), np.uint64)
                if len(some):
                    for j in range(coordinates):
                        sign[:, j] = np.minimum.reduceat(sets * ODD[2 * j] + ODD[2 * j + 1], begin)
                    for j in range(2):
                        cls[:, j] = np.add.reduceat(mix(sets + ODD[500 + j]), begin)
                has = np.zeros(len(piece), np.int64)
                has[some] = 1
                raw = cls.tobytes()
                ids = iter(range(len(some)))
                names = [raw[16 * k : 16 * k + 16] if n and (k := next(ids)) is not None else None for n in has]
                rows = batch.slice(piece.lo, len(piece))
                yield pa.record_batch({
                    "doc_id": rows["doc_id"], "n_shingles": pa.array(np.diff(first), pa.int64()), "cls": pa.array(names, pa.binary()),
                    "signature": lists(sign.view(np.int64).ravel(), np.concatenate(([0], np.cumsum(has * coordinates))), pa.int64()),
                })

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, cls binary, signature array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch["text"]):
                sets, first = shingle_sets(piece, width)
                yield pa.record_batch({"rep": batch.slice(piece.lo, len(piece))["doc_id"], "shingles": lists(sets.view(np.int64), first, pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(run, "rep long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, signs: DataFrame, percent: int, least: int) -> DataFrame:
    """Those of the pairs (a, b) with enough equal coordinates whose full sets are similar enough."""

    def beside(df: DataFrame, side: str) -> DataFrame:
        return df.join(sets.join(signs, "rep").select(F.col("rep").alias(side), F.col("shingles").alias(f"set_{side}"), F.col("signature").alias(f"sign_{side}")), side)

    both = beside(beside(pairs, "a"), "b")
    collisions = F.size(F.filter(F.zip_with("sign_a", "sign_b", lambda x, y: x == y), lambda same: same))
    inter = F.size(F.array_intersect("set_a", "set_b"))
    both = both.where(collisions >= least).select("a", "b", inter.alias("i"), (F.size("set_a") + F.size("set_b")).alias("n"))
    return both.where(F.lit(100) * F.col("i") >= F.lit(percent) * (F.col("n") - F.col("i"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """v, component: the least vertex that each vertex of the edges (a, b) reaches."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "component"), "b").groupBy(F.col("a").alias("v")).agg(F.min("component").alias("near"))
        hooked = labels.drop("was").join(near, "v").select("v", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        up = labels.select(F.col("v").alias("component"), F.col("component").alias("up"))
        moved = Observation()
        new = hooked.join(up, "component").select("v", F.least("component", "up").alias("component"), "was")
        new = written(new.observe(moved, F.count_if(F.col("component") != F.col("was")).alias("n")), "labels")
        removed(labels)
        if not moved.get.get("n"):
            removed(both)
            return new
        labels = new


def links(docs: DataFrame, signs: DataFrame, width: int, percent: int, coordinates: int = COORDINATES) -> DataFrame:
    """Confirmed pairs (a, b) of class representatives whose components are those of all links."""
    least = threshold(percent, coordinates)
    reps = signs.where("cls is not null and doc_id is not null")
    first = reps.groupBy("cls").agg(F.min("doc_id").alias("rep"))
    reps = reps.join(first, (reps["cls"] == first["cls"]) & (reps["doc_id"] == first["rep"])).select("rep", "n_shingles", "signature")
    posts = reps.select("rep", F.posexplode("signature").alias("coordinate", "value"))
    shared = posts.groupBy("coordinate", "value").agg(F.count("*").alias("n")).where("n > 1")
    own = posts.join(shared, ["coordinate", "value"]).groupBy("rep").agg(F.collect_set(F.struct("n", "coordinate", "value")).alias("own")).where(F.size("own") >= least)
    weight = F.aggregate("own", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    heads = own.select("rep", weight.alias("weight"), F.slice(F.array_sort("own"), F.lit(1), F.size("own") - least + 1).alias("prefix"))
    heads = written(heads, "prefixes")
    signs = written(reps.join(heads.select("rep"), "rep").dropDuplicates(["rep"]).select("rep", "n_shingles", "signature"), "candidates")
    sets = written(_sets(docs.join(signs.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]), width), "sets")

    # a partner holds at most the shingles that some other candidate has, and the similarity of a part to the whole is its share
    alone = sets.select("rep", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.min("rep").alias("rep")).where("n = 1").groupBy("rep").agg(F.count("*").alias("alone"))
    known = signs.select("rep", F.col("n_shingles").alias("size")).join(alone, "rep", "left").select("rep", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("common"))
    known = known.where(F.lit(100) * F.col("common") >= F.lit(percent) * F.col("size"))

    places = heads.join(known, "rep").select("rep", "weight", "size", "common", F.explode("prefix").alias("p")).select("rep", "weight", "size", "common", "p.coordinate", "p.value")
    hubs = places.groupBy("coordinate", "value").agg(F.max(F.struct("weight", "rep")).alias("hub"), F.count("*").alias("n")).where("n > 1").select("coordinate", "value", F.col("hub.rep").alias("hub"))
    places = written(places.join(hubs, ["coordinate", "value"]), "places")
    met = places.where("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    near = written(_confirmed(met, sets, signs, percent, least), "links")

    # what the hubs leave open: postings whose members aren't all linked to one hub
    weights = places.select(F.col("rep").alias("a"), "weight").distinct()
    label = near.join(weights, "a").groupBy(F.col("b").alias("rep")).agg(F.max(F.struct("weight", "a"))["a"].alias("label"))
    labelled = places.join(label, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    mixed = labelled.groupBy("coordinate", "value").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l != m").select("coordinate", "value")
    family = labelled.join(mixed, ["coordinate", "value"]).where("rep != hub").select("hub", "rep", "label", "size", "common").distinct()
    # each member by what it lacks and what it has beside its hub, from which the overlap of two members follows
    hub_sets = sets.select(F.col("rep").alias("hub"), F.col("shingles").alias("of_hub"))
    family = family.join(hub_sets, "hub").join(sets, "rep")
    family = written(family.select("hub", "rep", "label", "size", "common", F.size("of_hub").alias("n_hub"), F.array_except("of_hub", "shingles").alias("lacks"), F.array_except("shingles", "of_hub").alias("extra")), "families")

    def side(name: str) -> DataFrame:
        return family.select("hub", *[F.col(c).alias(f"{c}_{name}") for c in ("rep", "label", "size", "common", "n_hub", "lacks", "extra")])

    inter = F.col("n_hub_a") - F.size(F.array_union("lacks_a", "lacks_b")) + F.size(F.array_intersect("extra_a", "extra_b"))
    fits = (F.col("rep_a") < F.col("rep_b")) & (F.col("label_a") != F.col("label_b")) & _possible(percent)
    similar = F.lit(100 + percent) * inter >= F.lit(percent) * (F.col("size_a") + F.col("size_b"))
    joined = side("a").join(side("b").withColumnRenamed("hub", "hub_b"), (F.col("hub") == F.col("hub_b")) & fits & similar)
    rest = joined.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()
    found = written(near.unionByName(_confirmed(rest, sets, signs, percent, least)), "links")
    removed(heads, signs, sets, places, near, family)
    return found


def _possible(percent: int) -> Column:
    """Whether the sizes and the common parts of two sets allow the similarity."""
    inter = F.least("common_a", "common_b")
    return F.lit(100 + percent) * inter >= F.lit(percent) * (F.col("size_a") + F.col("size_b"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, n_shingles, component_id (least id that links reach) and kept (is that document) for each row."""
    signs = written(signatures(docs, width, coordinates), "signatures")
    edges = links(docs, signs, width, percent, coordinates)
    found = components(edges)
    first = signs.where("cls is not null and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"))
    # a table, so that the join below deals both sides itself and Spark can split a class that has many documents
    named = written(first.join(found, first["rep"] == found["v"], "left").select("cls", F.coalesce("component", "rep").alias("component_id")), "classes")
    removed(edges, found)
    # empty texts have no class; a key of its own for each keeps them apart
    spare = F.coalesce("cls", F.sha1(F.concat_ws("-", "doc_id", F.rand(7)).cast("binary")).cast("binary"))
    out = signs.select("doc_id", "n_shingles", spare.alias("cls")).join(named, "cls", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that have a near-duplicate of lower id in their component."""
    plain = plain_names(docs)
    gone = near_duplicates(plain, width, percent).where("not kept").select("doc_id").distinct()
    return plain.join(gone, "doc_id", "left_anti").select(*plain.columns).toDF(*docs.columns)
