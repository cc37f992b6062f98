"""The trie of conversation prefixes: locally combined node tables, merged by key, rolled up from the leaves."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import batch, cut
from pageloom.operators.cursor import ordinals

#: Turns of a conversation that one task sums up at a time; a longer one is split.
SEGMENT = 1024
#: Bits of a conversation's id that a partial table's slice spans: a slice holds at most so many ends.
SLICE_BITS = 12
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, place (global, from 0, by conversation and turn), t1, t2 (hashes of a turn) and bytes; no texts."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"),
        F.xxhash64(role, text).alias("t1"), F.xxhash64(text, F.lit(1), role).alias("t2"), F.octet_length(text).cast("bigint").alias("bytes"),
    )
    return ordinals(rows, F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("t1"), F.col("t2"), name="place").drop("turn", "role")


def rebuilt(conversations: DataFrame, siblings: int = 5, lengths: int = 9) -> tuple[DataFrame, DataFrame]:
    """The turns of rebuilt conversations (conv_id, length, depth, t1, t2, bytes), and all of those (conv_id, length).

    Conversation c starts with the first h turns of c - c % siblings, then has its own after its
    first h, where h is crc32 of its id's digits modulo `lengths`.
    """
    turns = turns_of(conversations)
    sizes = turns.groupBy("conv_id").agg(F.min("place").alias("start"), F.count("*").alias("own"))
    base = F.col("conv_id") - F.col("conv_id") % siblings
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % lengths
    convs = sizes.select("conv_id", "start", "own", base.alias("base"), h.alias("h"))
    of = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = convs.join(of, "base", "left").withColumn("lead", F.least("h", F.coalesce("base_own", F.lit(0))))
    convs = cut(convs.withColumn("length", F.col("lead") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).drop("base_own", "own"))
    placed = turns.join(convs, "conv_id").withColumn("i", F.col("place") - F.col("start"))
    columns = ["conv_id", "length", "depth", "t1", "t2", "bytes"]
    own = placed.where("i >= h").withColumn("depth", F.col("lead") + F.col("i") - F.col("h") + 1).select(columns)
    heads = placed.where((F.col("i") < lengths - 1) & (F.col("conv_id") % siblings == 0)).select(F.col("conv_id").alias("base"), "i", "t1", "t2", "bytes")
    lead = convs.select("conv_id", "base", "h", "length").join(heads, "base").where("i < h").withColumn("depth", F.col("i") + 1).select(columns)
    return own.unionByName(lead), convs.select("conv_id", "length")


def _node(depth: Column, a: Column, b: Column) -> Column:
    """A node's key: the hash of its depth and the sums of its turns' hashes, each made with its place."""
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), a.cast("string"), b.cast("string"))))


def members(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each conversation and each node that it is a member of, the root included.

    A prefix is known by two sums over its turns of hashes that hold the turn's place. Sums are
    over SEGMENT turns, then over segments, so a conversation of any length takes many tasks.
    """
    d = turns.withColumn("segment", F.floor((F.col("depth") - 1) / SEGMENT))
    d = d.withColumns({"a": F.xxhash64("depth", "t1", "t2").cast("decimal(20,0)"), "b": F.xxhash64("t2", "depth", F.lit(1), "t1").cast("decimal(20,0)")})
    sums = d.where(F.col("length") > SEGMENT).groupBy("conv_id", "segment").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "segment", F.sum("sa").over(before).alias("sa"), F.sum("sb").over(before).alias("sb"))
    inside = Window.partitionBy("conv_id", "segment").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"ia": F.sum("a").over(inside), "ib": F.sum("b").over(inside)}).join(sums, ["conv_id", "segment"], "left")
    wide = "decimal(38,0)"
    a, b = (F.col(i).cast(wide) + F.coalesce(F.col(s).cast(wide), F.lit(0).cast(wide)) for i, s in (("ia", "sa"), ("ib", "sb")))
    d = d.withColumns({"pa": a.cast(wide), "pb": b.cast(wide)})
    node, parent = _node(F.col("depth"), F.col("pa"), F.col("pb")), _node(F.col("depth") - 1, (F.col("pa") - F.col("a")).cast(wide), (F.col("pb") - F.col("b")).cast(wide))
    rows = d.select(node.alias("node"), parent.alias("parent"), "depth", "conv_id", "bytes", (F.col("depth") == F.col("length")).alias("ends"))
    zero = F.lit(0).cast(wide)
    root = convs.select(_node(F.lit(0), zero, zero).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("bigint").alias("depth"), "conv_id", F.lit(0).cast("bigint").alias("bytes"), (F.col("length") == 0).alias("ends"))
    return rows.unionByName(root)


def merged(tables: DataFrame, *key: str) -> DataFrame:
    """Partial node tables of one key into one table: members are summed, the smallest one is kept.

    Tasks combine rows of a key before they are dealt out, so a node that all conversations share
    costs a row for each task and key.
    """
    same = [F.first(c).alias(c) for c in ("parent", "depth", "bytes")]
    return tables.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), *same)


def rollup(nodes: DataFrame) -> DataFrame:
    """node, n_leaves and saved_tokens over the subtree of each node that several conversations share.

    A node of one conversation has one leaf below and saves nothing, so only shared nodes take part.
    In round k a node has the sums of its descendants less than 2**k levels below and its ancestor
    2**k levels above, and adds its sums to that one's: as many rounds as the shared depth has bits.
    """
    s = cut(nodes.where("n_convs > 1").select("node", F.col("parent").alias("up"), "leaves", "saved"))
    while s.where("up is not null").limit(1).count():
        more = s.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        above = s.select(F.col("node").alias("up"), F.col("up").alias("next"))
        s = s.join(more, "node", "left").join(above, "up", "left")
        s = cut(s.select("node", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")))
    return s.select("node", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def digests(ends: DataFrame) -> DataFrame:
    """node and the SHA-256 of its ends' ids, comma-joined, from slices of sorted ids that are read in order."""

    def run(batches):
        node, state, names = None, None, {"node": pa.binary(), "ends_sha256": pa.string()}
        for b in batches:
            out = []
            for key, ids in zip(b.column(0).to_pylist(), b.column(1)):
                if key != node:
                    if state is not None:
                        out.append((node, state.hexdigest()))
                    node, state, sep = key, hashlib.sha256(), ""
                state.update((sep + ",".join(map(str, ids.as_py()))).encode())
                sep = ","
            yield batch({n: (list(c), t) for (n, t), c in zip(names.items(), zip(*out) if out else [()] * 2)})
        if state is not None:
            yield batch({n: ([v], t) for (n, t), v in zip(names.items(), (node, state.hexdigest()))})

    return ends.repartition("node").sortWithinPartitions("node", "slice").select("node", "ids").mapInArrow(run, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, siblings: int = 5, lengths: int = 9) -> DataFrame:
    """The nodes of the trie of rebuilt conversations, one row each.

    conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256; texts are hashed once and don't move.

    Turns are in order of turn, null first, then of role and text hash where turns repeat. A null role
    or text is empty. A row without conv_id belongs to no conversation and takes no part; a
    conversation that has no turn left is a member of the root alone. A negative id counts down to
    its base, as remainders take its sign. An empty table has no node, not even a root. Columns
    with other names don't matter.
    """
    turns, convs = rebuilt(conversations, siblings, lengths)
    m = members(turns, convs).withColumn("slice", F.shiftright("conv_id", SLICE_BITS))
    same = [F.first(c).alias(c) for c in ("parent", "depth", "bytes")]
    partial = m.groupBy("node", "slice").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *same, F.sort_array(F.collect_list(F.when(F.col("ends"), F.col("conv_id")))).alias("ids"))
    partial = cut(partial)
    ends = digests(partial.where(F.size("ids") > 0))
    widest = partial.agg(F.max("slice"), F.min("slice")).first()
    nodes, (top, low) = partial.drop("ids"), (widest if widest[0] is not None else (0, 0))
    while top - low > 1:  # a slice of the next round spans 2**SLICE_BITS as many ids
        nodes, top, low = merged(nodes.withColumn("slice", F.shiftright("slice", SLICE_BITS)), "node", "slice"), top >> SLICE_BITS, low >> SLICE_BITS
    nodes = cut(merged(nodes, "node"))
    below = nodes.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("single"))
    nodes = cut(nodes.join(below, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    leaves = F.coalesce("single", F.lit(0)) + (F.col("n_children") == 0).cast("bigint")
    sums = rollup(nodes.withColumns({"leaves": leaves, "saved": (F.col("n_convs") - 1) * F.col("bytes")}))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    d = nodes.join(sums, "node", "left").join(ends, "node", "left").join(above, "parent", "left")
    return d.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
