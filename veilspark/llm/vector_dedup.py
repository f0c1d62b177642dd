"""Near-duplicate vectors through a pivot-permutation index.

Vectors are compared within a label by cosine in double precision.

Method: ``pivots`` vectors, taken from a bounded sample (eight times as many,
chosen by a hash of the id) so that no two are close, serve as reference points. A vector is described by its nearest pivots in order, of which
the first ``nearest`` are indexed. Two vectors are candidates if they share at
least ``shared`` of them: the inverted lists are kept for every set of
``shared`` pivots, so that a list holds just the vectors that share those.
Candidates are verified, which gives the connected groups; within a group every
pair is verified once more to count its links, so a pair that the index missed
is counted too if its ends are connected otherwise.

Long lists and groups are cut into blocks, and each pair of blocks is one unit
of work, so a group of any size spreads over many tasks; a unit returns a
spanning forest of its links, or how many each vector has, never the pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.components import components
from veilspark.session import store

COSINE = 0.98
PIVOTS, NEAREST, SHARED = 192, 7, 4
SAMPLED, CLOSE_PIVOTS = 8, 0.8      # pivots are taken from so many times their number of vectors; none closer than this cosine
BLOCK = 512


def _describe(pivots: np.ndarray, nearest: int, shared: int):
    """For each vector the lists it stands in: numbers made of ``shared`` of its nearest pivots."""
    picks = np.array(list(combinations(range(min(nearest, len(pivots))), shared)), dtype=np.int64)

    def run(vectors: pd.Series) -> pd.Series:
        x = _unit_length(vectors)
        close = np.sort(np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :nearest], axis=1)
        keys = np.zeros((len(x), len(picks)), dtype=np.int64)
        for column in range(shared):
            keys = keys * 256 + close[:, picks[:, column]] + 1
        return pd.Series(list(keys))

    run.__annotations__ = {"vectors": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<bigint>")


def _apart(sample: np.ndarray, most: int) -> np.ndarray:
    """Pivots that are not close to each other: a group of near copies, however large, has one, or its vectors would
    be told apart by noise alone."""
    chosen = sample[:0]
    for x in sample:
        if len(chosen) == most:
            break
        if not len(chosen) or (chosen @ x).max() < CLOSE_PIVOTS:
            chosen = np.concatenate([chosen, x[None]])
    return chosen


def _unit_length(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) that connect the same ids as all links of a block pair."""
    rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    if not len(rows):
        return left[:0], left[:0]
    part = linked[np.ix_(rows, cols)]
    a, b = left[rows].copy(), right[cols].copy()
    top = np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(a, np.where(part, b[None, :], top).min(1))
        new_b = np.minimum(b, np.where(part, new_a[:, None], top).min(0))
        if (new_a == a).all() and (new_b == b).all():
            return np.concatenate([left[rows], right[cols]]), np.concatenate([a, b])
        a, b = new_a, new_b


def _unit(threshold: float, count: bool):
    """Links between two blocks: how many each vector has (u = v), or a spanning forest."""
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        first, second = key[-2:]
        own = frame[frame["block"] == first]
        other = own if first == second else frame[frame["block"] == second]
        linked = _unit_length(own["vector"]) @ _unit_length(other["vector"]).T >= threshold
        if first == second:
            np.fill_diagonal(linked, False)
        ids, ids2 = own["id"].to_numpy(), other["id"].to_numpy()
        if not count:
            u, v = _forest(linked, ids, ids2)
            return pd.DataFrame({"u": u, "v": v, "links": 0})[u != v]
        parts = [(ids, linked @ other["copies"].to_numpy())]
        if first != second:
            parts.append((ids2, linked.T @ own["copies"].to_numpy()))
        found = pd.concat([pd.DataFrame({"u": i, "v": i, "links": n}) for i, n in parts])
        return found[found["links"] > 0].astype("int64")
    return run


def _by_block(entries: DataFrame, key: list[str], vectors: DataFrame, threshold: float, count: bool) -> DataFrame:
    """Every pair of entries (key…, id) of one key, as units of two blocks; keys of one entry are left out."""
    sizes = entries.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    sizes = store(sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"), "sizes")
    placed = entries.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    units = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select(*key, "id", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    return (units.join(vectors.select("id", "copies", "vector"), "id")
            .groupBy(*key, "first", "second").applyInPandas(_unit(threshold, count), "u long, v long, links long"))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 threshold: float = COSINE, pivots: int = PIVOTS, nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    n_links counts the other vectors of the label that it is linked with
    directly; component_id is the smallest id reachable. Vectors that are null, empty, zero
    or hold a null or a number that is not finite, and vectors without a label or an
    id, have no links. Vectors of different lengths are never linked. Equal vectors are linked with each other; rows that
    repeat an id with an equal vector count as one vector. Other columns are not looked at. Among equally near
    pivots the first counts. An empty table gives an empty result.
    """
    if not 0 < shared <= nearest <= pivots <= 255:
        raise ValueError("0 < shared <= nearest <= pivots <= 255 is needed")
    numbers = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), numbers.alias("vector"))
    size = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = store(rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
                 .where((size > 0) & (size < float("inf"))).distinct()
                 .withColumn("label", F.concat_ws("/", "label", F.size("vector"))), "vectors")
    # Equal vectors are one entry with their number.
    classes = store(good.groupBy("label", "vector").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "vector-classes")
    forest = _forests(classes, threshold, pivots, nearest, shared)
    joined = components(forest).withColumnRenamed("component", "label")
    degree = _by_block(joined, ["label"], classes, threshold, True).groupBy("u").agg(F.sum("links").alias("n"))
    members = good.join(classes.select("label", "vector", F.col("id").alias("first"), "copies"), ["label", "vector"]).select("id", "first", "copies")
    members = store(members.join(degree, F.col("first") == F.col("u"), "left")
                    .groupBy("id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.min("first").alias("first")), "members")
    links = forest.union(members.where("id != first").select(F.col("id").alias("u"), F.col("first").alias("v")))
    groups = components(links).select(F.col("id").alias("member"), "component")
    component = F.coalesce("component", F.col("row_id"))
    return (rows.select(F.col("id").alias("row_id")).join(members.select("id", "n"), F.col("row_id") == F.col("id"), "left")
            .join(groups, F.col("row_id") == F.col("member"), "left")
            .select(F.col("row_id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                    F.coalesce(component == F.col("row_id"), F.lit(True)).alias("kept")))


def _forests(classes: DataFrame, threshold: float, pivots: int, nearest: int, shared: int) -> DataFrame:
    """Links (u, v) that connect the vectors whose cosine reaches the threshold, as far as the index finds them."""
    sizes = [r["n"] for r in classes.select(F.size("vector").alias("n")).distinct().collect()]     # dimensions in use, one as a rule
    found = None
    for n in sizes:
        some = classes.where(F.size("vector") == n)
        sample = some.orderBy(F.xxhash64("id"), "id").limit(SAMPLED * pivots).select("vector").collect()
        points = _apart(_unit_length(pd.Series([r["vector"] for r in sample])), pivots)
        lists = F.explode(_describe(points, nearest, min(shared, len(points)))(F.col("vector"))).alias("list")
        entries = store(some.select("label", "id", lists), "pivot-lists")
        links = _by_block(entries, ["label", "list"], some, threshold, False).select("u", "v")
        found = links if found is None else found.union(links)
    return store(found.distinct() if found is not None else classes.select(F.col("id").alias("u"), F.col("id").alias("v")).limit(0), "forest")
