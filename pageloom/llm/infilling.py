"""Fill-in-the-middle: one boundary index for each distinct text, one seeded cut for each document."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import batch

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A text is hot if more than this many rows, and more than one row in SHARE, have it.
ROWS, SHARE = 64, 10_000
#: Characters of output in one Arrow batch, but for a single longer text.
FLUSH = 4_000_000


class EliasFano:
    """A growing list of integers: low bits packed, high bits in unary, select by a directory of ones."""

    BLOCK = 64  # bytes of the unary part for each directory entry

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.width = max(0, (int(values[-1]) // n).bit_length() - 1)
        self.low = np.packbits((values[:, None] >> np.arange(self.width) & 1).astype(np.uint8).ravel(), bitorder="little")
        ones = np.zeros((int(values[-1]) >> self.width) + n, np.uint8)
        ones[(values >> self.width) + np.arange(n)] = 1
        self.high = np.packbits(ones, bitorder="little")
        self.before = np.append(0, np.cumsum(np.add.reduceat(np.bitwise_count(self.high).astype(np.int64), np.arange(0, len(self.high), self.BLOCK))))

    def __getitem__(self, i: int) -> int:
        block = int(np.searchsorted(self.before, i, side="right")) - 1
        bits = np.unpackbits(self.high[block * self.BLOCK : (block + 1) * self.BLOCK], bitorder="little")
        at = block * self.BLOCK * 8 + int(np.flatnonzero(bits)[i - self.before[block]])
        value = 0
        for j in range(self.width):
            k = i * self.width + j
            value |= (int(self.low[k >> 3]) >> (k & 7) & 1) << j
        return (at - i) << self.width | value


class Entry:
    """The index entry of one text: its units' ends as an Elias-Fano list, and whether it can be cut."""

    def __init__(self, text: str):
        self.text = text
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = ((points >= 65) & (points <= 90)) | ((points >= 97) & (points <= 122))
        starts = np.flatnonzero(~letter | ~np.append(False, letter[:-1])) if len(points) else np.zeros(0, np.int64)
        self.n = len(starts)
        self.ends = EliasFano(np.append(starts, len(points))) if self.n else None
        self.whole = not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE))


def seeds(doc_id: int | None) -> list[int]:
    """Four unsigned 32-bit numbers of a document's id."""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def transformed(entry: Entry, doc_id: int | None, cut_share: int, spm_share: int) -> tuple[str, int | None, int | None, str]:
    """Form, characters of prefix and middle (None if plain) and output of one document."""
    h1, h2, h3, h4 = seeds(doc_id)
    if entry.whole or h3 % 100 >= cut_share:
        return "plain", None, None, entry.text
    a, b = sorted((entry.ends[h1 % (entry.n + 1)], entry.ends[h2 % (entry.n + 1)]))
    before, middle, after = entry.text[:a], entry.text[a:b], entry.text[b:]
    if h4 % 100 < spm_share:
        return "spm", a, b - a, f"{SUFFIX}{after}{PREFIX}{before}{MIDDLE}{middle}"
    return "psm", a, b - a, f"{PREFIX}{before}{SUFFIX}{after}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, cut_share: int = 90, spm_share: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every document's whole text.

    Rows meet by a hash of their text, so texts move once. Rows of one hash are compared by content;
    the list of a text's unit ends is made once and each document selects its two cuts from it.
    A text that more than ROWS rows and more than one row in SHARE have is dealt over several groups,
    each with its own copy of the list; fewer than SHARE texts can be so common, which bounds what
    is broadcast.

    A null text is empty and plain. A null id has seeds of its own, those of an empty id. Repeated rows
    each get a row, equal for equal ids and texts. An empty table gives no row. Columns other
    than doc_id and text, whatever their names, don't matter.
    """
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keyed = d.select(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "doc_id", "text")
    limit = max(ROWS, docs.count() // SHARE)
    hot = keyed.groupBy("k1", "k2").agg(F.count("*").alias("rows")).where(F.col("rows") > limit)
    hot = hot.select("k1", "k2", F.ceil(F.col("rows") / limit).alias("groups"))
    keyed = keyed.join(F.broadcast(hot), ["k1", "k2"], "left")
    keyed = keyed.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.coalesce("groups", F.lit(1)))).drop("groups")
    rows = keyed.repartition("k1", "k2", "part").sortWithinPartitions("k1", "k2", "part").select("k1", "k2", "doc_id", "text")

    def run(batches):
        key, held, out, size = None, [], [], 0
        for b in batches:
            for k1, k2, doc, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                if (k1, k2) != key:
                    key, held = (k1, k2), []
                entry = next((e for e in held if e.text == text), None)
                if entry is None:
                    held.append(entry := Entry(text))
                out.append((doc, entry.n, *transformed(entry, doc, cut_share, spm_share)))
                size += len(out[-1][-1])
                if size >= FLUSH:
                    yield as_batch(out)
                    out, size = [], 0
        yield as_batch(out)

    return rows.mapInArrow(run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}
    return batch({name: (list(c), t) for (name, t), c in zip(names.items(), zip(*rows) if rows else [()] * len(names))})


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from: a cut text holds no marker, so the first of each is the right one."""
    a = F.when(form == "psm", F.locate(SUFFIX, output, 2)).otherwise(F.locate(PREFIX, output, 2))
    b = F.locate(MIDDLE, output, 2)
    head, tail, middle = F.substring(output, F.lit(4), a - 4), F.substring(output, a + 3, b - a - 3), F.substring(output, b + 3, F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(head, middle, tail)).otherwise(F.concat(tail, middle, head))
