"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import cut, fresh, sweep

#: Words of a shingle, blocks of a fingerprint, and the bits that may differ in one block.
SHINGLE, BLOCKS, FLIPS = 5, 4, 4
#: Fingerprints at most this far apart agree in some block up to FLIPS bits.
RADIUS = BLOCKS * (FLIPS + 1) - 1

_EDGE = r"^[\\p{P}\\p{S}]++|(?<![\\p{P}\\p{S}])[\\p{P}\\p{S}]++$"
#: Words in lower case without punctuation at their edges; a word of punctuation only stays as it is.
_WORDS = rf"transform(filter(split(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), w -> w <> ''), w -> coalesce(nullif(regexp_replace(w, '{_EDGE}', ''), ''), w))"
_ARGS = ", ".join(f"ws[i + {j}]" for j in range(SHINGLE))
_WEIGHT = " + ".join(f"char_length(ws[i + {j}])" for j in range(SHINGLE))


def _split(df: DataFrame) -> DataFrame:
    """Adds ws, the words of text."""
    # a generator of one row keeps the optimizer from splitting the text anew for each shingle
    return df.select("*", F.explode(F.array(F.expr(_WORDS))).alias("ws"))


def _shingles(df: DataFrame) -> DataFrame:
    """Adds sh, the hash of each run of SHINGLE words, and wt, the characters of each."""
    df = _split(df).where(F.size("ws") >= SHINGLE)
    at = f"sequence(0, size(ws) - {SHINGLE})"
    return df.withColumn("sh", F.expr(f"transform({at}, i -> xxhash64({_ARGS}))")).withColumn("wt", F.expr(f"transform({at}, i -> {_WEIGHT})"))


def _fingerprint(zipped: str) -> str:
    """The 64-bit SimHash of an array of structs (sh, wt), made within its row: the sign of the weighted bits."""
    # sixty-four sums of an aggregation would be so many columns of every plan and code that the driver makes
    signed = f"aggregate({zipped}, 0L, (s, z) -> s + z.wt * (2 * (shiftright(z.sh, b) & 1) - 1))"
    return f"aggregate(transform(sequence(0, 63), b -> if({signed} > 0, shiftleft(1L, b), 0L)), 0L, (m, x) -> m | x)"


def _short_matches(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int) -> DataFrame | None:
    """The rows of matches() for items under SHINGLE words, found whole and in order; None without any."""
    items = _split(benchmark.select("item_id", "text")).where(F.size("ws").between(1, SHINGLE - 1)).select("item_id", F.size("ws").alias("len"), F.expr("xxhash64(ws)").alias("h")).distinct()
    sizes = {r["len"]: r["count"] for r in items.groupBy("len").count().collect()}
    if not sizes:
        return None
    # a word run of each length that an item has
    runs = [f"transform(sequence(1, size(ws) - {n - 1}), i -> struct({n} as len, i - 1 as pos, xxhash64(slice(ws, i, {n})) as h))" for n in sorted(sizes)]
    runs = [f"if(size(ws) >= {n}, {x}, cast(array() as array<struct<len:int,pos:int,h:bigint>>))" for n, x in zip(sorted(sizes), runs)]
    seen = _split(docs.select("doc_id", F.xxhash64("text").alias("k"), "text")).select("doc_id", "k", F.explode(F.expr(f"concat({', '.join(runs)})")).alias("r")).select("doc_id", "k", F.col("r.len").alias("len"), F.col("r.pos").alias("pos"), F.col("r.h").alias("h"))
    near = F.broadcast(items) if sum(sizes.values()) <= broadcast_rows else items
    found = seen.join(near, ["len", "h"]).groupBy("doc_id", "k", "item_id").agg(F.min("pos").alias("start_word"))
    return found.withColumn("similarity", F.lit(1.0))


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, broadcast_rows: int = 500_000) -> DataFrame:
    """doc_id, k (hash of the text), item_id, start_word and similarity of each contaminated pair.

    Windows have an item's number of words and start where a shingle of five words that both hold
    puts them, as any window that can pass shares one. Window and item fingerprints must agree in
    some block up to FLIPS bits, which all pairs within RADIUS do, and lie within it; then the
    exact similarity decides: the weight of the common shingles over that of all, a shingle weighing
    its characters, each as often as it occurs.

    Items under five words must stand in the text whole and in order, with similarity 1. Null and
    empty texts are left out; case and punctuation at the edges of words do not count. Each row of docs is looked at by itself, and the best window of a pair is returned.
    The item table is broadcast only if its counted rows are within broadcast_rows.
    """
    # items and windows are cut: each is used several times, and plans that repeat what they come from fill the driver's memory
    items = _shingles(benchmark.select("item_id", "text")).select("item_id", F.size("ws").alias("len"), F.arrays_zip("sh", "wt").alias("win"))
    items = cut(items.withColumn("fp", F.expr(_fingerprint("win"))))
    parts = items.select("item_id", "len", F.posexplode("win").alias("ipos", "z")).select("item_id", "len", "ipos", F.col("z.sh").alias("h"), F.col("z.wt").alias("w"))
    small = parts.count() <= broadcast_rows
    fit = F.broadcast if small else (lambda x: x)

    d = docs.select("doc_id", F.xxhash64("text").alias("k"), "text")
    seen = _shingles(d).select("doc_id", "k", F.posexplode("sh").alias("pos", "h"))
    near = parts.groupBy("h").agg(F.collect_list(F.struct("item_id", "len", "ipos")).alias("at"))
    hits = seen.join(fit(near), "h").select("doc_id", "k", "pos", F.explode("at").alias("a"))
    start = F.greatest(F.col("pos") - F.col("a.ipos"), F.lit(0))
    hits = hits.groupBy("doc_id", "k").agg(F.collect_set(F.struct(F.col("a.item_id").alias("item_id"), F.col("a.len").alias("len"), start.alias("start"))).alias("wins"))
    texts = d.join(hits.withColumnRenamed("doc_id", "hit_id").withColumnRenamed("k", "hit_k"), F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("k") == F.col("hit_k"))).drop("hit_id", "hit_k").dropDuplicates(["doc_id", "k"])
    key = ["doc_id", "k", "item_id", "start"]
    wins = _shingles(texts).select("doc_id", "k", "sh", "wt", F.explode("wins").alias("x")).select("doc_id", "k", F.col("x.item_id").alias("item_id"), F.col("x.start").alias("start"), F.expr(f"slice(arrays_zip(sh, wt), x.start + 1, x.len - {SHINGLE - 1})").alias("win"))
    wins = cut(wins.withColumn("fp", F.expr(_fingerprint("win"))))
    sweep(wins)

    block = F.posexplode(F.expr(f"transform(sequence(0, {BLOCKS - 1}), i -> cast(shiftrightunsigned(fp, i * 16) & 65535 as int))")).alias("blk", "val")
    flips = F.explode(F.expr(f"filter(sequence(0, 65535), x -> bit_count(x) <= {FLIPS})"))
    index = items.select("item_id", "fp", block).select("item_id", F.col("fp").alias("ifp"), "blk", "val", flips.alias("flip")).select("item_id", "ifp", "blk", F.expr("val ^ flip").alias("val"))
    # the planner can't see that the flips make 2517 rows of each block, so it must not broadcast them
    cand = wins.select(*key, "fp", block).join(index.hint("merge"), ["item_id", "blk", "val"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS).select(*key).distinct()

    rows = wins.select(*key, F.explode("win").alias("z")).select(*key, F.col("z.sh").alias("h"), F.col("z.wt").alias("w"))
    have = rows.groupBy(*key, "h").agg(F.count("*").alias("c"), F.first("w").alias("w"))
    want = parts.groupBy("item_id", "h").agg(F.count("*").alias("ic"))
    whole = parts.groupBy("item_id").agg(F.sum("w").alias("iw"))
    both = have.join(fit(want), ["item_id", "h"], "left").groupBy(*key).agg(F.sum(F.col("c") * F.col("w")).alias("ww"), F.sum(F.least("c", F.coalesce("ic", F.lit(0))) * F.col("w")).alias("common"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    both = both.join(cand.toDF(*[f"_{c}" for c in key]), same[0] & same[1] & same[2] & same[3], "left_semi")
    scored = both.join(fit(whole), "item_id").withColumn("similarity", F.col("common") / (F.col("ww") + F.col("iw") - F.col("common"))).where(F.col("similarity") >= similarity)
    best = scored.groupBy("doc_id", "k", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("m"))
    best = best.select("doc_id", "k", "item_id", (-F.col("m.s")).alias("start_word"), F.col("m.similarity").alias("similarity"))
    short = _short_matches(docs, benchmark, broadcast_rows)
    return best if short is None else best.unionByName(short)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, columns as they were, whose text holds no benchmark item."""
    one, two = fresh(docs, "bad_id"), fresh(docs, "bad_text")
    bad = matches(docs, benchmark, similarity).select(F.col("doc_id").alias(one), F.col("k").alias(two)).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col(one)) & (F.xxhash64(docs["text"]) == F.col(two)), "left_anti")
