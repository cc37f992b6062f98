"""Exact top-k by inner product: MaxScore over shards of posting lists, merged by query."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import batch, cut

#: Queries that one group holds, about; vectors of a shard, at most about and at least.
BLOCK, WIDEST, NARROWEST = 4096, 1 << 20, 1 << 12
#: Vectors that are scored in full before bounds are known; each later chunk is twice as long.
SEED = 1024
#: Terms that are probed before the floor is looked at again.
PROBES = 8
LONG = (1 << 63) - 1


def quantised(vectors: list, scale: float) -> np.ndarray:
    """floor(scale * x) of each component; a short vector is filled up with zeros. Exact in float64, or Python integers."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    with np.errstate(over="ignore"):
        whole = np.floor(scale * out)
    if np.isfinite(whole).all():
        return whole
    return np.array([[math.floor(Fraction(x) * Fraction(scale)) for x in v] for v in out], object).reshape(out.shape)


class Postings:
    """The lists of a chunk of vectors, a row for each dimension, with the least and greatest value of each."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        self.lists, self.ids, self.rows = np.ascontiguousarray(vectors.T), ids, rows
        self.least, self.most = vectors.min(axis=0), vectors.max(axis=0)


class Best:
    """The k best (score, id) of each query so far, best first; of equal scores the smaller id is better."""

    def __init__(self, queries: int, k: int):
        self.k, self.scores, self.ids = k, [np.zeros(0)] * queries, [np.zeros(0, np.int64)] * queries

    def floor(self, q: int) -> float:
        """The score that a vector must reach to take part."""
        return self.scores[q][-1] if len(self.scores[q]) == self.k else -np.inf

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.append(self.scores[q], scores), np.append(self.ids[q], ids)
        if s.dtype == object:
            order = sorted(range(len(s)), key=lambda j: (-s[j], i[j]))[: self.k]
        else:
            if len(s) > 4 * self.k:  # ties at the edge stay for the exact order
                keep = s >= np.partition(s, len(s) - self.k)[len(s) - self.k]
                s, i = s[keep], i[keep]
            order = np.lexsort((i, -s))[: self.k]
        self.scores[q], self.ids[q] = s[order], i[order]


def search(query: np.ndarray, own: int, p: Postings, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores and places of the chunk's vectors that may reach `floor`, by MaxScore.

    A term is a dimension. Its score is counted from the least that it can give in this chunk, so all
    scores are at least 0 and each has a bound. Terms in order of their bounds: the longest run of
    the smallest ones whose bounds don't reach what is asked for is non-essential. The lists of the
    others are traversed, each adding to its vectors; then the non-essential terms are probed, the
    largest bound first, for vectors that can still reach the floor.
    """
    low, high = query * p.least, query * p.most
    base, bound = np.minimum(low, high), np.abs(high - low)
    order = np.argsort(bound, kind="stable")
    upto = np.cumsum(bound[order])
    asked = floor - base.sum()
    split = int(np.searchsorted(upto, asked, side="left")) if len(order) else 0
    essential, rest = order[split:], order[:split][::-1]
    # the others' least scores stand in until they are probed
    score = query[essential] @ p.lists[essential] + base[rest].sum()
    left = upto[split - 1] if split else 0
    live = np.flatnonzero((score + left >= floor) & (p.rows != own))
    score = score[live]
    for i in range(0, split, PROBES):
        d = rest[i : i + PROBES]
        some = p.lists[d] if 2 * len(live) > len(p.ids) else p.lists[np.ix_(d, live)]
        more = query[d] @ some
        score = score + ((more[live] if len(more) > len(live) else more) - base[d].sum())
        left = upto[split - 1 - i - len(d)] if i + len(d) < split else 0
        stay = score + left >= floor
        live, score = live[stay], score[stay]
    return score, live


def exact(queries: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in one width and in the narrowest type in which every sum of products is exact."""
    width = max(queries.shape[1], vectors.shape[1])
    q, v = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (queries, vectors))
    most = int(np.abs(q).max(initial=0)) * int(np.abs(v).max(initial=0)) * 4 * max(1, width)
    if most < 1 << 24:
        return q.astype(np.float32), v.astype(np.float32)
    return (q, v) if most < 1 << 53 else tuple(np.array([[int(x) for x in r] for r in m], object).reshape(m.shape) for m in (q, v))


def group_search(queries: np.ndarray, own: np.ndarray, best: Best, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    """Adds the vectors, in chunks that grow, to the best of every query of a block."""
    q, v = exact(queries, vectors)
    if v.dtype == object:  # numbers beyond 53 bits: no bounds, all scores
        for k in range(len(q)):
            others = np.flatnonzero(rows != own[k])
            best.add(k, np.array([max(-LONG, min(LONG, int(v[i] @ q[k]))) for i in others], object), ids[others])
        return
    start, size = 0, SEED
    while start < len(v):
        end = min(len(v), start + size)
        p = Postings(v[start:end], ids[start:end], rows[start:end])
        for k in range(len(q)):
            score, at = search(q[k], own[k], p, best.floor(k))
            if len(at):
                best.add(k, score, p.ids[at])
        start, size = end, size * 2


def top_k(vectors: DataFrame, k: int = 20, one_in: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k rows with the highest inner products for each query.

    Components become floor(scale * x); queries are the rows whose vec_id is divisible by one_in,
    candidates all rows but the query's own; equal scores are in order of vec_id, a null one last.

    Queries are dealt out in blocks of about BLOCK, vectors in shards of up to about WIDEST, by row and
    not by id, and each block meets each shard in one group, where vectors stream past the block;
    k rows of each query leave a group, and a window takes the best k of all shards. Memory holds one
    block and one Arrow batch of vectors.

    A vector that is null or holds a null or non-finite component takes no part. Rows that repeat an
    id are rows of their own: each is a candidate of the other, and a query for each of them. Vectors of
    different lengths are filled up with zeros; an empty one scores 0. Scores beyond a 64-bit integer
    are cut to its range, and tie there. A table without queries gives no row.
    """
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    d = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    d = d.where(F.col("v").isNotNull() & sound).select("vec_id", F.col("v").cast(vectors.schema["embedding"].dataType).alias("v"), F.monotonically_increasing_id().alias("row"))
    d = cut(d)
    is_query = F.coalesce(F.col("vec_id") % one_in == 0, F.lit(False))
    n, n_queries = d.agg(F.count("*"), F.count_if(is_query)).first()
    blocks = max(1, -(-n_queries // BLOCK))
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-n // WIDEST), min(-(-n // NARROWEST), -(-parts // blocks)))
    mixed = F.xxhash64("row")
    queries = d.where(is_query).withColumns({"kind": F.lit(0), "each": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))}).withColumn("cell", F.pmod(mixed, F.lit(blocks)) * shards + F.col("each"))
    against = d.withColumns({"kind": F.lit(1), "each": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))}).withColumn("cell", F.col("each") * shards + F.pmod(mixed, F.lit(shards)))
    rows = queries.unionByName(against).repartition(blocks * shards, "cell").sortWithinPartitions("cell", "kind", "row").select("cell", "kind", "row", "vec_id", "v")
    names = {"query_row": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}

    def results(block) -> pa.RecordBatch:
        out = []
        for row, doc, s, i in zip(block["rows"], block["ids"], block["best"].scores, block["best"].ids):
            out += [(row, doc, None if y == LONG else int(y), int(x)) for x, y in zip(s, i)]
        return batch({c: (list(x), t) for (c, t), x in zip(names.items(), zip(*out) if out else [()] * 4)})

    def run(batches):
        cell, block = None, None
        for b in batches:
            at = b.column(0).to_numpy()
            for start, end in zip(edges := np.append(0, np.flatnonzero(np.diff(at)) + 1), np.append(edges[1:], len(at))):
                if at[start] != cell:
                    if block and block["best"]:
                        yield results(block)
                    cell, block = at[start], {"rows": [], "ids": [], "vectors": [], "best": None}
                part = b.slice(start, end - start)
                kinds, row = part.column(1).to_numpy(), part.column(2).to_numpy()
                ids, vs = part.column(3).to_pylist(), part.column(4)
                nq = int(np.searchsorted(kinds, 1))
                block["rows"] += row[:nq].tolist()
                block["ids"] += ids[:nq]
                block["vectors"] += vs[:nq].to_pylist()
                if nq == len(ids) or not block["ids"]:
                    continue
                if block["best"] is None:
                    block |= {"best": Best(len(block["ids"]), k), "q": quantised(block["vectors"], scale), "own": np.array(block["rows"]), "vectors": []}
                group_search(block["q"], block["own"], block["best"], quantised(vs[nq:].to_pylist(), scale), np.array([LONG if i is None else i for i in ids[nq:]]), row[nq:])
        if block and block["best"]:
            yield results(block)

    found = rows.mapInArrow(run, "query_row bigint, query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
