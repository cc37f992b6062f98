"""Substring dedup of word windows by difference-cover anchors."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import NO_ID, batch, cut, mix, range_hashes, words_of

#: Every difference modulo PERIOD is one of two members of COVER.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Anchors that a sample shows to be common, at most.
COMMON = 20_000


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in [s, s + width) of some start s."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step[:n]) > 0


def anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Cover positions and a hash of 48 bits of the window - PERIOD + 1 words from there on."""
    size = window - PERIOD + 1
    at = np.arange(max(0, len(words) - size + 1)) if len(words) >= window else np.zeros(0, int)
    at = at[np.isin(at % PERIOD, COVER)]
    return at, range_hashes(words, at, at + size) >> np.uint64(16)


def keyed(docs: DataFrame) -> DataFrame:
    """id, k and text of each row of docs: null ids are NO_ID, null texts empty.

    Rows with the same id and k say the same: k is a hash of the text where an id is repeated, else 0,
    so it takes no room in the rows that carry it.
    """
    d = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    repeated = cut(d.groupBy("id").count().where("count > 1").select("id"))
    if repeated.isEmpty():
        # 0, but not as a literal, which the optimizer would take out of the keys of joins and aggregations
        return d.select("id", F.coalesce(F.pmod("id", F.lit(1)), F.lit(0)).alias("k"), "text")
    d = d.join(repeated.withColumn("again", F.lit(True)), "id", "left")
    return d.select("id", F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0)).cast("bigint").alias("k"), "text")


def sampled(d: DataFrame, one_in: int = 64) -> DataFrame:
    """text of one in `one_in` rows of d (id, k, text), by a hash of the row's key."""
    return d.where(F.pmod(F.xxhash64("id", "k"), F.lit(one_in)) == 0).select("text")


def squeezed(d: DataFrame) -> DataFrame:
    """id, k, z (the text's bytes, compressed, as they move) and copy (whether a row of smaller id has
    the same whole text) of each row of d (id, k, text)."""

    def squeeze(batches):
        for b in batches:
            z = [zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("k"), pa.array(z, pa.binary())], ["id", "k", "z"])

    whole = d.select("id", "k", F.md5("text").alias("m"))
    least = whole.groupBy("m").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("m", "lo")
    copies = cut(whole.join(least, "m").where("id > lo").select("id", "k", F.lit(True).alias("copy")).distinct())
    z = d.mapInArrow(squeeze, "id bigint, k bigint, z binary")
    # said to be never null, the same exchange of the texts serves inner and outer joins
    z = z.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), F.coalesce("k", F.lit(0)).alias("k"), "z")
    return z.join(copies, ["id", "k"], "left").withColumn("copy", F.coalesce("copy", F.lit(False)))


def sample_counts(rows: DataFrame, anchors_of, most: int) -> list[tuple[int, int]]:
    """The `most` commonest anchor hashes that several of rows (text) have, with how many have them."""

    def hashes(batches):
        for b in batches:
            for at in range(0, b.num_rows, 200):
                texts = [t.encode("utf-8", "surrogatepass") for t in b.column("text").slice(at, 200).to_pylist()]
                yield batch({"h": (anchors_of(texts)[1], pa.int64())})

    counts = rows.mapInArrow(hashes, "h bigint").groupBy("h").count().where("count > 1")
    return [(r["h"], r["count"]) for r in counts.orderBy(F.desc("count"), "h").limit(most).collect()]


def shared_anchors(d: DataFrame, common: list[int], anchors_of) -> DataFrame:
    """id, k and hashes: the anchor hashes of each row of d (id, k, z, copy) that other rows have too.

    anchors_of gives the distinct pairs of a text's number and a hash of some texts' bytes. Those of `common`, a bounded list, are known to be
    shared: they are marked where they are found and dealt out by id, so that only hashes that are
    none of the commonest meet by hash. Copies of a whole text have none.
    """
    common = d.sparkSession.sparkContext.broadcast(np.sort(np.array(common, np.int64)))

    def emit(batches):
        hot = common.value
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                text, h = anchors_of([zlib.decompress(z) for z in part.column("z").to_pylist()])
                sure = np.isin(h, hot)
                ids, ks = (part.column(c).to_numpy()[text] for c in ("id", "k"))
                at_ = np.where(sure, mix((ids ^ ks).view(np.uint64)).view(np.int64), h)
                yield batch({"at": (at_, pa.int64()), "id": (ids, pa.int64()), "k": (ks, pa.int64()), "h": (pa.array(h, mask=~sure), pa.int64())})

    a = d.where(~F.col("copy")).select("id", "k", "z").mapInArrow(emit, "at bigint, id bigint, k bigint, h bigint")
    a = a.withColumn("c", F.count("*").over(Window.partitionBy("at"))).where("h is not null or c > 1")
    return a.groupBy("id", "k").agg(F.collect_list(F.coalesce("h", "at")).alias("hashes"))


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words that stay) of each row of docs.

    A word goes if a window of `window` words over it also starts in a document with a smaller id.
    Two equal windows at i and j have a d below PERIOD with (i + d) and (j + d) both in the cover
    modulo PERIOD, so they share the anchor there: only hashes at cover positions are compared
    across the corpus. Each window over a shared anchor is then extended to its full width, and
    its least id is found by an aggregation with map-side combine, so no group is collected.

    A row whose whole text has a copy of smaller id loses all its words if it has a window, and its
    own windows are not looked at, as the copy has the same. Null and empty texts have no words; a
    null id is the largest; rows that repeat an id are judged one by one, never against each other;
    an empty table gives no rows; other columns of docs do not matter.
    """
    rows = keyed(docs)
    d = squeezed(rows)

    def own_anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [np.unique(anchors(words_of(t)[3], window)[1]).view(np.int64) for t in texts]
        return np.repeat(np.arange(len(got)), [len(g) for g in got]), np.concatenate([np.zeros(0, np.int64), *got])

    common = [h for h, _ in sample_counts(sampled(rows), own_anchors, COMMON)]
    both = d.select("id", "k", "z").join(shared_anchors(d, common, own_anchors), ["id", "k"])

    def emit_windows(batches):
        size = window - PERIOD + 1
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 5]
                for i, k, z, known in zip(*(part.column(c).to_pylist() for c in ("id", "k", "z", "hashes"))):
                    words = words_of(zlib.decompress(z))[3]
                    n = len(words) - window + 1
                    if n <= 0:
                        continue
                    pos, h = anchors(words, window)
                    pos = pos[np.isin(h.view(np.int64), np.array(known, np.int64))]
                    near = np.maximum(pos - (window - size), 0)
                    s = np.flatnonzero(covered(near[near < n], window - size + 1, n))
                    ends = s + window
                    w1 = range_hashes(words, s, ends).view(np.int64)
                    w2 = (range_hashes(words, s, ends, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    out.append([np.full(len(s), i), np.full(len(s), k), s, w1, w2])
                c = [np.concatenate(x) for x in zip(*out)]
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
                yield batch(dict(zip(("id", "k", "s", "w1", "w2"), zip(c, types))))

    w = both.mapInArrow(emit_windows, "id bigint, k bigint, s int, w1 bigint, w2 int")
    first = w.groupBy("w1", "w2").agg(F.min("id").alias("lo"))
    dup = w.join(first, ["w1", "w2"]).where("id > lo").groupBy("id", "k").agg(F.collect_list("s").alias("dup"))
    done = d.join(dup, ["id", "k"], "left")
    names = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"

    def finish(batches):
        for b in batches:
            rows = []
            for i, z, starts, copy in zip(*(b.column(c).to_pylist() for c in ("id", "z", "dup", "copy"))):
                data, first, last, words = words_of(zlib.decompress(z))
                n = len(words)
                out = np.full(n, n >= window) if copy else covered(np.array(starts or (), np.int64), window, n)
                raw = data.tobytes()
                kept = b" ".join([raw[s:e] for s, e in zip(first[~out].tolist(), last[~out].tolist())])
                rows.append((None if i == NO_ID else i, n, int(out.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
            columns = zip(*rows) if rows else [()] * 5
            yield batch({c.split()[0]: (list(v), t) for c, v, t in zip(names.split(", "), columns, [*[pa.int64()] * 3, pa.string(), pa.string()])})

    return done.select("id", "z", "dup", "copy").mapInArrow(finish, names)
