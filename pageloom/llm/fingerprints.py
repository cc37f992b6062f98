"""Order MinHash fingerprints: minimal occurrence-numbered k-mers in text order, hashed as tuples."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import SEED, mix, range_hashes
from pageloom.operators.cursor import ordinals

SKETCHES, TAKE, K = 64, 2, 9


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def labelled(kmers: np.ndarray) -> np.ndarray:
    """Hash of each k-mer with the number of its earlier occurrences."""
    order = np.argsort(kmers, kind="stable")
    run = kmers[order]
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    nth = np.arange(len(run)) - np.repeat(first, np.diff(np.append(first, len(run))))
    out = np.empty_like(kmers)
    out[order] = mix(run + nth.astype(np.uint64) * np.uint64(SEED))
    return out


def signature(points: np.ndarray) -> np.ndarray:
    """SKETCHES hashes of 32 bits, 0 for a sketch without k-mers.

    Each labelled k-mer falls into one sketch by its hash; a sketch takes its TAKE least ones, puts
    them in text order and hashes the tuple. A text shorter than K is a single k-mer.
    """
    n = len(points)
    out = np.zeros(SKETCHES, np.uint32)
    if not n:
        return out
    starts = np.arange(max(1, n - K + 1))
    kmers = range_hashes(points, starts, np.minimum(starts + K, n))
    rank = labelled(kmers)
    bits = np.uint64(64 - SKETCHES.bit_length() + 1)
    low = rank & np.uint64((1 << int(bits)) - 1)
    for limit in (24 * SKETCHES * TAKE / len(rank), 1.0):  # a text-length bound first; all k-mers if any sketch is short
        at = np.flatnonzero(low < np.uint64(min(limit, 1.0) * ((1 << int(bits)) - 1))) if limit < 1 else np.arange(len(rank))
        at = at[np.argsort(rank[at], kind="stable")]
        first = np.searchsorted(rank[at] >> bits, np.arange(SKETCHES + 1, dtype=np.uint64))
        size = np.diff(first)
        if limit >= 1 or size.min() >= TAKE:
            break
    a = at[np.minimum(first[:-1], len(at) - 1)]
    b = at[np.minimum(first[:-1] + 1, len(at) - 1)]
    two = size >= 2
    lo, hi = np.where(two, np.minimum(a, b), a), np.where(two, np.maximum(a, b), a)
    h = mix(kmers[lo] * np.uint64(3) + kmers[hi] * np.uint64(5) + np.arange(SKETCHES, dtype=np.uint64))
    out[size > 0] = np.maximum(h >> np.uint64(32), np.uint64(1)).astype(np.uint32)[size > 0]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of sketches that agree, to the power 1 / TAKE; two empty texts are alike."""
    used = (a > 0) | (b > 0)
    return float(((a == b) & used).sum() / used.sum()) ** (1 / TAKE) if used.any() else 1.0


def edited(text: str, other: str) -> str:
    """The last third of text, by code points, replaced by the start of the other one."""
    n = len(text) // 3
    return text[: len(text) - n] + other[:n]


def with_next(docs: DataFrame, width: int = 256, broadcast_rows: int = 2_000_000) -> DataFrame:
    """Rows (block, halo, doc_id, text), each block with the row that follows it in descending doc_id.

    A block is a range of `width` ids; rows that repeat an id, and those without one, share a block. The
    block that follows is that of the next place in the order of blocks, which is found without
    sorting them in one task, and no text moves for that. A null id counts as the least.
    """
    least = -(1 << 62)
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    d = d.withColumn("key", F.coalesce(F.col("doc_id"), F.lit(least))).withColumn("block", F.floor(F.col("key") / width).cast("bigint"))
    blocks = ordinals(d.groupBy("block").agg(F.max("key").alias("head")), F.desc("block"), name="place")
    before = blocks.select((F.col("place") + 1).alias("place"), F.col("block").alias("to"))
    last = blocks.agg(F.min("block")).first()[0]
    heads = blocks.join(before, "place", "left").select(F.col("head").alias("key"), F.coalesce("to", F.lit(last)).alias("to"))
    if heads.count() <= broadcast_rows:
        heads = F.broadcast(heads)
    halo = d.join(heads, "key").select(F.col("to").alias("block"), F.lit(1).alias("halo"), "doc_id", "text")
    return d.select("block", F.lit(0).alias("halo"), "doc_id", "text").unionByName(halo)


def fingerprints(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null text counts as empty. Rows that repeat an id follow one another by text. A table of one row
    is its own next document; an empty one gives no row. Texts move once, by block of ids; columns
    other than doc_id and text don't matter. The sketches share one pool of k-mers, each of which falls
    into one sketch by its hash, so a text is hashed once.
    """
    n = partitions or max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = with_next(docs).repartition(n, "block").sortWithinPartitions("block", "halo", F.col("doc_id").desc_nulls_last(), "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        last = None
        for b in batches:
            out: list[tuple] = []
            for block, halo, doc, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                sig = signature(code_points(text))
                if last is not None and last[0] == block:
                    _, ldoc, ltext, lsig = last
                    new = edited(ltext, text)
                    esig = signature(code_points(new))
                    out.append((ldoc, len(ltext), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), lsig.tobytes().hex(), esig.tobytes().hex(), likeness(lsig, esig), likeness(lsig, sig)))
                last = None if halo else (block, doc, text, sig)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 7, types)], names)

    return rows.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
