"""Quality classifier: similarity-weighted votes of the nearest labelled latent-semantic vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import held_out, uniform, words_of

TRIGRAMS = 4096
#: Terms that a text has if at least this share of its words repeats the word before.
REPEATS = np.linspace(0.03, 0.93, 31)
BINS = TRIGRAMS + len(REPEATS)
#: Rows that are weighted together in training.
BLOCK = 512


def histogram(text: str | None) -> np.ndarray:
    """Counts of hashed byte trigrams of the whole text, and repetition terms; shorter texts have none."""
    data, _, _, words = words_of(text)
    out = np.zeros(BINS, np.int64)
    if len(data) < 3:
        return out
    b = data.astype(np.uint32)
    h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)
    out[:TRIGRAMS] = np.bincount(h >> np.uint32(20), minlength=TRIGRAMS)
    if len(words) > 1:
        out[TRIGRAMS:] = 7 * ((words[1:] == words[:-1]).mean() >= REPEATS)
    return out


class Model:
    """TF-IDF, a truncated SVD of the labelled rows, and their unit vectors with labels."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, rank: int = 64, neighbours: int = 15, power: float = 8.0):
        self.neighbours, self.power, self.labels = neighbours, power, labels.astype(np.float32)
        counts = counts.reshape(-1, BINS)
        self.idf = (np.log((1 + len(counts)) / (1 + np.count_nonzero(counts, axis=0))) + 0.3).astype(np.float32)
        # the counts are the only whole copy: weighted rows are made in blocks, again for each pass
        parts = [slice(at, at + BLOCK) for at in range(0, len(counts), BLOCK)]
        self.basis = np.zeros((BINS, rank), np.float32)
        if parts:
            rng = np.random.default_rng(0)
            q = rng.standard_normal((BINS, rank + 16)).astype(np.float32)
            for _ in range(6):  # subspace iteration for the leading right singular vectors
                q, _r = np.linalg.qr(sum(x.T @ (x @ q) for x in (self.weighted(counts[p]) for p in parts)))
            _, _, vt = np.linalg.svd(np.concatenate([self.weighted(counts[p]) @ q for p in parts]), full_matrices=False)
            self.basis = (q @ vt.T)[:, :rank].astype(np.float32)
        self.vectors = np.concatenate([np.zeros((0, rank), np.float32), *(self.project(self.weighted(counts[p])) for p in parts)])

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        x = counts.astype(np.float32)  # the only copy; all that follows is in place
        np.log1p(x, out=x)
        x *= self.idf
        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
        return x

    def project(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Exact cosines against every labelled vector, then the nearest ones vote."""
        if not len(self.labels):
            return np.zeros(len(counts))
        cosine = self.project(self.weighted(counts)) @ self.vectors.T
        k = min(self.neighbours, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        votes = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** self.power
        total = votes.sum(1)
        return np.where(total > 0, (votes * self.labels[near]).sum(1) / np.maximum(total, 1e-300), 0.0)


def _ordered(got: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Counts and labels of rows (doc_id, q, c) by id."""
    counts = np.empty((got.num_rows, BINS), np.uint16)
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at = 0
    for chunk in got.column("c").cast(pa.binary()).chunks:  # copied straight from the buffers, without an object a row
        first = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        counts[place[at : at + len(chunk)]] = np.frombuffer(chunk.buffers()[2], np.uint8)[first[0] : first[-1]].view(np.uint16).reshape(-1, BINS)
        at += len(chunk)
    return counts, got.column("q").to_numpy()[order]


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 4000, **how) -> Model:
    """Fits on about max_labelled labelled rows that are not held out, drawn evenly by a hash of the id.

    Rows without a label are left out; several labels of one document are averaged and rounded up.
    """
    lab = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    lab = lab.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("q"))
    n = lab.count()
    if n > max_labelled:
        lab = lab.where(uniform(F.col("doc_id"), seed=9) < max_labelled / n)

    def count(batches):
        for b in batches:
            got = [np.minimum(histogram(t), 65535).astype(np.uint16).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("q"), pa.array(got, pa.binary())], ["doc_id", "q", "c"])

    # about max_labelled rows of 16 bytes, so the size of this broadcast is bounded
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(lab.select(F.col("doc_id").cast("bigint").alias("doc_id"), "q")), "doc_id")
    got = rows.select("doc_id", "q", "text").mapInArrow(count, "doc_id bigint, q int, c binary").toArrow()
    counts, q = _ordered(got)
    del got
    pa.default_memory_pool().release_unused()  # else the driver keeps what the rows took for the rest of its life
    return Model(counts, q, **how)


def score(docs: DataFrame, model: Model, block: int = 256) -> DataFrame:
    """doc_id and score of every whole text, in blocks of rows against all labelled vectors.

    The model has a bounded number of vectors, so its broadcast is bounded. Null, empty or very
    short texts without a trigram score 0. Equal texts score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            for at in range(0, b.num_rows, block):
                part = b.slice(at, block)
                s = m.score(np.stack([histogram(t) for t in part.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.clip(s, 0, 1), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_labelled: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from the threshold on)."""
    s = score(docs, train(docs, labels, max_labelled))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_labelled: int = 4000) -> DataFrame:
    """The rows of docs, all columns as they were, whose text scores at least the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_labelled))
    names = docs.columns

    def run(batches):
        m = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                s = m.score(np.stack([histogram(t) for t in part.column(names.index("text")).to_pylist()]))
                yield part.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
