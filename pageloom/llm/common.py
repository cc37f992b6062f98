"""Helpers that the corpus operators share."""

from __future__ import annotations

import gc
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.operators.store import cut

#: A word is a run of bytes that are none of space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
SEED = 0x9E3779B97F4A7C15
#: Stands for a null id: it is the largest.
NO_ID = (1 << 63) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def uniform(*cols: Column, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the columns' text and the seed only."""
    text = F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols], F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def sweep(df: DataFrame) -> None:
    """Lets Spark delete shuffle files of plans that are done: it does so when the driver collects garbage.

    Called after a cut, whose rows no longer need the shuffles before it. Files in use stay.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def packed(df: DataFrame, rows: int = 100_000) -> tuple[DataFrame, int]:
    """cut(df), read back by as many tasks as its rows need, and the number of its rows."""
    out = cut(df)
    n = out.count()
    return out.coalesce(max(1, -(-n // rows))), n


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (wrapping arithmetic)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _powers[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of values[s:e] for each pair, in linear time by prefix sums of a polynomial."""
    up, down = powers(_BASES[which], len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(SEED))


def sliding_hashes(values: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """range_hashes() of each run of `size` values."""
    up, down = powers(_BASES[which], len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
    n = max(0, len(values) - size + 1)
    return mix((total[size : size + n] - total[:n]) * down[:n] + np.uint64(size * SEED & (1 << 64) - 1))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word of UTF-8 bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def words_of(text: str | bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, word starts, word ends and a 64-bit hash of each word of a text or its UTF-8 bytes."""
    data = np.frombuffer(text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends = word_spans(data)
    return data, starts, ends, range_hashes(data, starts, ends)


def shingle_hashes(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hash of each run of `size` words; a shorter text that has words is one shingle."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    starts = np.arange(max(1, n - size + 1))
    return range_hashes(words, starts, np.minimum(starts + size, n), which)
