"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import WORD, cut, uniform


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """Target of each source by water filling.

    sizes has source and source_size, one row a source, so the window without a key orders
    sources, never documents. Weights repeat in code point order of the source, null last. With
    sources in order of cap / weight, all before some source stop at their cap and the rest share
    what is left by weight. The level at which the rest share grows while sources are capped and
    falls from the first that isn't, so it is the greatest of all.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rest = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    s = s.withColumn("level", F.max("level").over(everything))
    return s.select("source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("w")).alias("target"))


def pareto_mix(docs: DataFrame, size: Column | None = None, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, seed: int = 7, bins: int = 4096) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words) for each document.

    Each document of a source with ratio r = target / source_size gets floor(r) certain copies. One
    more goes to a Pareto sample of a fixed size in words: a document's odds of inclusion are those
    of the fraction of r times its size over the source's mean size, and those with the least rank,
    odds of a uniform number that follows from id and text over the odds of inclusion, are taken
    until their words come nearest the target. Documents larger than all that is left to take rank
    after all others. The cut is found in bins of the rank, in bins of one such bin, and among the
    rows of one of those, so no source is ever sorted as a whole.

    Null or wordless texts have size 0 and take 0; a null source is a source; repeated rows count
    each; an empty table gives an empty result; other columns don't matter. No document exceeds
    `most` copies, as no target exceeds `most` times its source. Sizes are counted once and kept
    in the checkpoint folder, as narrow rows.
    """
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long") if size is None else size
    d = cut(docs.select("doc_id", "source", size.alias("size"), uniform(F.col("doc_id"), F.xxhash64("text"), seed=seed).alias("u")))
    per = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg("size").alias("mean"))
    t = targets(per, weights, most).join(per.select(F.col("source").alias("src"), "mean"), F.col("source").eqNullSafe(F.col("src"))).drop("src")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    t = t.withColumn("whole", F.floor(ratio + 1e-12)).withColumn("part", F.greatest(F.lit(0.0), ratio - F.col("whole")))
    t = t.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # one row a source: far under any broadcast bound, and Spark falls back to a shuffle beyond its own
    d = _with_source(d, t)
    part = F.greatest(F.col("part"), F.lit(1e-12))
    odds = part / (1 - F.least(part, F.lit(1 - 1e-12))) * F.greatest(F.col("size"), F.lit(1)) / F.greatest(F.col("mean"), F.lit(1.0))
    rank = F.col("u") / (1 - F.col("u")) / odds
    # a place in (0, 1) that grows with the rank, in the upper half for what can't fit
    d = d.withColumn("place", (rank / (1 + rank) + F.when(F.col("size") > F.col("rest"), 1.0).otherwise(0.0)) / 2)
    d = d.withColumn("bin", F.floor(F.col("place") * bins)).withColumn("sub", F.floor((F.col("place") * bins - F.col("bin")) * bins))
    d = _with_source(d, _edge(d.select("source", "bin", "size", "rest", F.lit(0).alias("start")), "bin"))
    on_edge = F.col("bin").eqNullSafe(F.col("bin_edge"))
    d = _with_source(d, _edge(d.where(on_edge).select("source", "sub", "size", "rest", F.col("bin_start").alias("start")), "sub"))
    inside = on_edge & F.col("sub").eqNullSafe(F.col("sub_edge"))
    run = Window.partitionBy("source").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    near = d.where(inside).withColumn("upto", F.col("sub_start") + F.sum("size").over(run))
    near = near.withColumn("extra", (F.col("upto") - F.col("size") / 2 <= F.col("rest")).cast("long")).drop("upto")
    first = F.col("bin_edge").isNull() | (F.col("bin") < F.col("bin_edge")) | on_edge & (F.col("sub") < F.col("sub_edge"))
    far = d.where(~inside).withColumn("extra", (F.coalesce(first, F.lit(False)) & (F.col("rest") > 0)).cast("long"))
    out = near.unionByName(far)
    taken = (F.least(F.col("whole") + F.col("extra"), F.lit(int(most))) * F.col("size")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def _with_source(d: DataFrame, per: DataFrame) -> DataFrame:
    """d with the columns of its source in per, which has one row a source."""
    return d.join(per.withColumnRenamed("source", "src"), F.col("source").eqNullSafe(F.col("src")), "left").drop("src")


def _edge(rows: DataFrame, key: str) -> DataFrame:
    """The bin of each source in which the words, counted from start, pass rest, and the words before it."""
    b = rows.groupBy("source", key).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("start").alias("start"))
    upto = Window.partitionBy("source").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("before", F.col("start") + F.coalesce(F.sum("words").over(upto), F.lit(0)))
    b = b.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    return b.select("source", F.col(key).alias(f"{key}_edge"), F.col("before").alias(f"{key}_start"))
