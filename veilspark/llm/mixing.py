"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources share ``share`` times all sizes in proportion to their weights; a target stops at ``cap`` times its source's
size, and what is left over goes to the other sources by weight until none is above.

Method: a document gets the exponential key ``-ln(u) / weight``, where ``u`` comes from a hash of its id and the weight is
its quality. A source gives ``floor(target / size)`` complete epochs, in which every document is taken once; the rest of
the target is filled with its documents by ascending key, whole documents, of which the last is taken if that brings the
source nearer to its target. So a source misses its target by half of one document at most.

No source is sorted whole. Keys are spread over 2 ** 12 ranges, sizes are summed by source and range, and the prefix sums
of those show in which range a source's budget ends; that range is split once more the same way. Only the documents of
the last range, about one in 2 ** 24, are sorted and summed one by one. Rows come together at no other point: they are
compared with their source's edge where they lie, so a source may hold any part of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspark.session import store

RATIOS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
QUALITY_WEIGHTS = {1: 2.0, 0: 0.5}      # of documents labelled good and bad; others weigh 1
BITS = 12                               # of the range numbers of one round
_SPACE = " \t\n\x0b\x0c\r"


def word_count(text: str) -> Column:
    """How many runs of characters other than white space; null has none."""
    marked = F.regexp_replace(F.col(text).cast("string"), r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(marked, _SPACE, "")), F.lit(0)).cast("long")


def quality_weights(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """(id, weight), one row per id; the best label counts if there are several."""
    known = F.create_map(*[F.lit(x) for pair in QUALITY_WEIGHTS.items() for x in pair])
    return (labels.where(F.col(id_col).isNotNull())
            .groupBy(F.col(id_col)).agg(F.max(F.try_element_at(known, F.col(quality_col).cast("int"))).alias("weight")))


def targets(sizes: DataFrame, ratios: tuple[float, ...] = RATIOS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds ``target`` to (source, source_size), one row per source.

    Ratios repeat over the sources in code-point order, null last. A source is full if its equal part of what the fuller
    ones leave exceeds its cap; sources fill up in the order of size by weight, so prefix sums in that order give the
    level at which the rest stand. The table has a row per source and is small, which is why one task may order it.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(r)) for r in ratios]), F.col("place") % len(ratios) + 1)
    ranked = sizes.withColumn("place", F.row_number().over(by_name) - 1).withColumn("ratio", weight.cast("double"))
    fill = W.orderBy(F.col("source_size") / F.col("ratio"), "place")
    everything = W.partitionBy()
    level = (ranked
             .withColumn("filled", F.coalesce(F.sum("source_size").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
             .withColumn("weights", F.sum("ratio").over(fill.rowsBetween(0, W.unboundedFollowing)))
             .withColumn("left", F.lit(share) * F.sum("source_size").over(everything) - F.lit(cap) * F.col("filled"))
             .withColumn("at", F.row_number().over(fill))
             .withColumn("open", F.col("ratio") * F.col("left") < F.lit(cap) * F.col("source_size") * F.col("weights")))
    first = F.min(F.when(F.col("open"), F.struct("at", "left", "weights"))).over(everything)
    poured = F.col("ratio") * F.col("first.left") / F.col("first.weights")
    capped = F.lit(cap) * F.col("source_size")
    return level.withColumn("first", first).select(
        "source", "source_size", F.when(F.col("at") < F.coalesce("first.at", F.lit(2**31 - 1)), capped).otherwise(poured).alias("target"))


def _edge(rows: DataFrame, part: str) -> DataFrame:
    """Of each source the first range whose documents exceed what is left, and the sizes before it."""
    sums = rows.groupBy("place", "rest", part).agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(W.partitionBy("place").orderBy(part))
    over = sums.withColumn("upto", upto).where(F.col("upto") > F.col("rest"))
    least = over.groupBy("place").agg(F.min(F.struct(part, (F.col("upto") - F.col("size")).alias("before"))).alias("edge"))
    return least.select("place", f"edge.{part}", "edge.before")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", weight_col: str | None = None,
        ratios: tuple[float, ...] = RATIOS, share: float = SHARE, cap: float = CAP, seed: str = "") -> DataFrame:
    """All columns of docs with source_size, target, repeats (how often the mix takes the row) and taken (repeats * size).

    Columns of docs with the four new names are replaced. A null or negative size counts as 0; a null or NaN weight is 1,
    and rows of weight 0 or less come last in their source. Null sources form a source of their own. Rows that share an id
    share a key and follow each other by size; of rows equal in these, any are taken, so the result is the same
    rows whatever the partitioning. Sizes may be of any magnitude; texts are not read. An empty table gives an empty result.
    """
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    number = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("id"))), 1, 13), 16, 10).cast("double")     # 52 bits
    weight = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    weight = F.when(weight.isNull() | F.isnan(weight), 1.0).otherwise(F.least(F.greatest(weight, F.lit(0.0)), F.lit(1e12)))
    key = F.when(F.col("weight") > 0, -F.log((number + 0.5) / F.lit(2.0**52)) / F.col("weight")).otherwise(F.lit(float("inf")))
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("source_size", "target", "repeats", "taken")]
    rows = (docs.select(F.struct(*keep).alias("doc"), name.alias("id"), F.col(source_col).cast("string").alias("source"),
                        F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0)).alias("size"), weight.alias("weight"))
            .select("doc", "id", "source", "size", "weight", key.alias("key"), F.monotonically_increasing_id().alias("row")))
    rows = store(rows, "mix-rows")

    found = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg("weight").alias("mean"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    found = store(found, "mix-sizes")
    goals = targets(found.drop("mean"), ratios, share, cap)
    goals = goals.join(found.select(F.col("source").alias("name"), "mean"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    goals = store(goals.withColumn("epochs", epochs)
                  .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
                  .withColumn("place", F.monotonically_increasing_id()), "mix-targets")

    spread = F.lit(1.0) - F.exp(-F.col("key") * F.greatest("mean", F.lit(1e-300)))      # ascends with the key, from 0 to 1
    fine = F.least(F.floor(spread * 2**(2 * BITS)), F.lit(2**(2 * BITS) - 1)).cast("int")
    named = goals.select(F.col("source").alias("name"), "source_size", "target", "mean", "epochs", "rest", "place")
    placed = (rows.join(named, F.col("source").eqNullSafe(F.col("name")))
              .withColumn("fine", fine).withColumn("coarse", F.shiftright("fine", BITS)))
    narrow = placed.where("size > 0 AND rest > 0").select("place", "rest", "coarse", "fine", "key", "id", "size", "row")

    coarse = store(_edge(narrow, "coarse"), "mix-coarse")
    inside = narrow.join(coarse, ["place", "coarse"]).withColumn("rest", F.col("rest") - F.col("before")).drop("before")
    inside = store(inside.drop("coarse"), "mix-inside")
    fine = store(_edge(inside, "fine"), "mix-fine")
    last = inside.join(fine, ["place", "fine"]).withColumn("rest", F.col("rest") - F.col("before")).drop("before")

    # Equal rows are one group; of the group in which the budget ends, ``copies`` rows are taken.
    groups = last.groupBy("place", "fine", "rest", "key", "id", "size").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum(F.col("n") * F.col("size")).over(W.partitionBy("place").orderBy("key", "id", "size"))
    nearest = F.ceil((F.col("rest") - (F.col("upto") - F.col("n") * F.col("size"))) / F.col("size") - F.lit(0.5))
    ends = (groups.withColumn("upto", upto).where(F.col("upto") > F.col("rest"))
            .withColumn("copies", F.least(F.greatest(nearest, F.lit(0)), F.col("n")))
            .groupBy("place").agg(F.min(F.struct("key", "id", "size", "copies", "n", "fine")).alias("end")))
    ends = store(ends.select("place", "end.*"), "mix-ends")
    cuts = store(_cut(inside, ends), "mix-cuts")
    edges = ends.join(cuts, "place", "left").select(
        F.col("place").alias("at"), F.struct("fine", "key", "id", "size").alias("end"),
        F.when(F.col("copies") == 0, -1).when(F.col("copies") == F.col("n"), 2**63 - 1).otherwise(F.col("cut")).alias("cut"))

    here = F.struct("fine", "key", "id", "size")
    more = (F.col("rest") > 0) & F.coalesce((here < F.col("end")) | ((here == F.col("end")) & (F.col("row") <= F.col("cut"))), F.lit(False))
    repeats = F.col("epochs") + more.cast("long")
    final = placed.join(store(edges, "mix-edges"), F.col("place") == F.col("at"), "left")
    return final.select("doc.*", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"))


def _cut(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """(place, cut): the row number of the last copy taken of a repeated row; counted in the blocks that wrote the rows, so
    any number of copies spreads over tasks."""
    some = ends.where("copies > 0 AND copies < n").withColumnRenamed("n", "all")
    same = (rows.join(some, ["place", "fine", "key", "id", "size"])
            .select("place", "copies", "row", F.shiftright("row", 33).alias("block")))
    counts = same.groupBy("place", "copies", "block").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy("place").orderBy("block"))
    block = (counts.withColumn("upto", upto).where(F.col("upto") >= F.col("copies"))
             .groupBy("place").agg(F.min(F.struct("block", (F.col("copies") - F.col("upto") + F.col("n")).alias("nth"))).alias("in"))
             .select("place", "in.*"))
    ranked = same.join(block, ["place", "block"]).withColumn("number", F.row_number().over(W.partitionBy("place").orderBy("row")))
    return ranked.where(F.col("number") == F.col("nth")).select("place", F.col("row").alias("cut"))
