"""Exact removal of repeated byte strings by suffix arrays of shards."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import NO_ID, SEED, batch, range_hashes, sliding_hashes
from pageloom.llm.substrings import COMMON, covered, keyed, sampled, shared_anchors, squeezed

SEPARATOR = 0xFF  # never a byte of UTF-8
#: Alphabets up to this size are induced a bucket at a time, by array operations; larger ones, the names
#: of deeper levels, whose buckets hold few suffixes, a suffix at a time.
WIDEST = 2048
#: Bytes of a window that segments need not share to be sorted together.
STRIDE = 5
#: Texts whose windows are found together.
TEXTS = 100


def induced_singly(t: np.ndarray, small: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Suffix order of t, given its leftmost-smaller suffixes in order, by two scans of all suffixes."""
    n = len(t)
    ends = np.cumsum(np.bincount(t))
    tail, head = ends.tolist(), [0, *ends[:-1].tolist()]
    # the symbol before each suffix if a scan has to place it, else -1; n stands for an empty place
    before, type_before = np.append(t[:-1], -1), np.append(small[:-1], False)
    larger = [-1, *np.where(type_before, -1, before)[:-1].tolist(), -1]
    smaller = [-1, *np.where(type_before, before, -1)[:-1].tolist(), -1]
    sa = [n] * n
    for i, c in zip(order[::-1].tolist(), t[order[::-1]].tolist()):
        tail[c] -= 1
        sa[tail[c]] = i
    for i in sa:  # places ahead are filled on the way
        c = larger[i]
        if c >= 0:
            sa[head[c]] = i - 1
            head[c] += 1
    tail = ends.tolist()
    for i in reversed(sa):
        c = smaller[i]
        if c >= 0:
            tail[c] -= 1
            sa[tail[c]] = i - 1
    return np.array(sa, np.int64)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix order of t by induced sorting; the last symbol is 0 and occurs once.

    Suffixes are classified as smaller or larger than the next one; leftmost-smaller substrings are
    sorted by one induction and named; if names repeat, the string of names is sorted recursively;
    a last induction places all suffixes. Over bytes a bucket is induced in rounds of array operations:
    a round's own symbol goes to the next round, all others to the end of their buckets.
    """
    n, top = len(t), int(t.max()) + 1
    if n == 1:
        return np.zeros(1, np.int64)
    t = t.astype(np.int16 if top <= WIDEST else np.int64)
    step = np.sign(t[1:].astype(np.int32) - t[:-1])
    differs = np.where(step != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(differs[::-1])[::-1]
    small = np.ones(n, bool)
    small[:-1] = step[np.minimum(following, n - 2)] > 0
    small[n - 2] = False  # the last symbol is the least
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    size = np.bincount(t, minlength=top)
    head = np.cumsum(size) - size
    tail = head + size

    def spread(sa: np.ndarray, ptr: np.ndarray, at: np.ndarray, back: bool) -> None:
        symbol = t[at]
        order = np.argsort(symbol, kind="stable")
        s = symbol[order]
        count = np.bincount(s, minlength=top)
        nth = np.arange(len(s)) - (np.cumsum(count) - count)[s]
        if back:
            sa[ptr[s] - 1 - nth] = at[order]
            ptr -= count
        else:
            sa[ptr[s] + nth] = at[order]
            ptr += count

    def induce(order: np.ndarray) -> np.ndarray:
        if top > WIDEST:
            return induced_singly(t, small, order)
        sa = np.full(n, -1, np.int64)
        own = np.argsort(t[order], kind="stable")
        first = np.searchsorted(t[order][own], np.arange(top + 1))
        seeds = order[own]
        front = head.copy()
        for c in range(top):
            done = head[c]
            while done < front[c]:
                at = sa[done : front[c]] - 1
                done = front[c]
                at = at[at >= 0]
                at = at[~small[at]]
                if len(at):
                    spread(sa, front, at, False)
            at = seeds[first[c] : first[c + 1]] - 1
            if len(at):
                spread(sa, front, at[at >= 0], False)
        rear = tail.copy()
        for c in range(top - 1, -1, -1):
            done = tail[c]
            while done > rear[c]:
                at = sa[rear[c] : done][::-1] - 1
                done = rear[c]
                at = at[at >= 0]
                at = at[small[at]]
                if len(at):
                    spread(sa, rear, at, True)
            at = sa[head[c] : front[c]][::-1] - 1
            at = at[at >= 0]
            at = at[small[at]]
            if len(at):
                spread(sa, rear, at, True)
        sa[0] = n - 1
        return sa

    sa = induce(lms)
    starts = np.zeros(n, bool)
    starts[lms] = True
    ordered = sa[starts[sa]]
    index = np.zeros(n, np.int64)
    index[lms] = np.arange(len(lms))
    ends = np.append(lms[1:] + 1, n)
    digest = range_hashes(t, lms, ends)
    digest[-1] = 0
    same = digest[index[ordered]]
    names = np.concatenate([[0], np.cumsum(same[1:] != same[:-1])])
    if names[-1] + 1 < len(lms):
        reduced = np.empty(len(lms), np.int64)
        reduced[index[ordered]] = names
        ordered = lms[suffix_array(reduced)]
    return induce(ordered)


def common_prefixes(t: np.ndarray, sa: np.ndarray, stop: int) -> np.ndarray:
    """For each place, the common prefix with the suffix before it in order, up to a symbol `stop`.

    Permuted, so in text order: where the symbols before both suffixes are equal the value is that
    of the place before, less one; only the other places are compared symbol by symbol.
    """
    n = len(t)
    before = np.full(n, n - 1)
    before[sa[1:]] = sa[:-1]
    left = np.empty(n, t.dtype)
    left[0], left[1:] = stop, t[:-1]
    at = np.flatnonzero((left == stop) | (left != left[before]) | (before == 0))
    live, size = at, np.zeros(n, np.int64)
    k = 0
    while len(live):
        a, b = live + k, before[live] + k
        ok = (b < n) & (a < n)
        live = live[ok]
        a, b = a[ok], b[ok]
        live = live[(t[a] == t[b]) & (t[a] != stop)]
        size[live] += 1
        k += 1
    last = np.zeros(n, np.int64)
    last[at] = at
    last = np.maximum.accumulate(last)
    return np.maximum(size[last] - (np.arange(n) - last), 0)


def earlier_windows(segments: list[bytes], ids: np.ndarray, width: int) -> list[int]:
    """For each segment, bits of the window starts whose bytes also occur in a segment of smaller id."""
    sizes = np.array([len(s) for s in segments])
    joined = np.frombuffer(bytes([SEPARATOR]).join(segments) + bytes([SEPARATOR]), np.uint8)
    t = np.append(joined.astype(np.int64) + 1, 0)
    sa = suffix_array(t)
    lcp = common_prefixes(t, sa, SEPARATOR + 1)
    owner = np.repeat(np.arange(len(segments)), sizes + 1)
    first = np.cumsum(sizes + 1) - sizes - 1
    least = np.append(ids[owner], NO_ID)[sa]
    group = np.flatnonzero(np.concatenate([[True], lcp[sa[1:]] < width]))
    best = np.empty(len(t), np.int64)
    best[sa] = np.repeat(np.minimum.reduceat(least, group), np.diff(np.append(group, len(sa))))
    place = np.arange(len(owner)) - first[owner]
    hit = np.flatnonzero((place <= sizes[owner] - width) & (best[:-1] < ids[owner]))
    return np.bincount(owner[hit], weights=2.0 ** place[hit], minlength=len(segments)).astype(np.int64).tolist()


def meeting(segments: list[bytes], anchors: np.ndarray, width: int, k: int) -> np.ndarray:
    """Whether a segment may share a window with another segment of its anchor.

    A window has its anchor and width - k bytes around it, some number on the left. With that number
    rounded down to a multiple of STRIDE, all but STRIDE of those bytes are in one of few places
    around the anchor: two segments that share a window have equal bytes in one of them. The anchor
    is the first least k-gram of a segment's first window.
    """
    sizes = np.array([len(s) for s in segments])
    data = np.frombuffer(b"".join(segments), np.uint8)
    first = np.cumsum(sizes) - sizes
    h = sliding_hashes(data, k) & np.uint64((1 << 48) - 1)
    at = first + h[first[:, None] + np.arange(width - k + 1)].argmin(1)
    around = max(0, width - k - STRIDE)
    out = np.zeros(len(segments), bool)
    for left in range(0, width - k + 1, STRIDE):
        start, end = at - min(left, around), at + k + around - min(left, around)
        there = np.flatnonzero((start >= first) & (end <= first + sizes))
        key = range_hashes(data, start[there], end[there], 1) ^ (anchors[there].view(np.uint64) * np.uint64(SEED))
        _, index, count = np.unique(key, return_inverse=True, return_counts=True)
        out[there] |= count[index] > 1
    return out


def short_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of 48 bits of data[s:e]; keys of a segment have two, its anchor's and its own."""
    return (range_hashes(data, starts, ends) & np.uint64((1 << 48) - 1)).view(np.int64)


def first_least(values: np.ndarray, run: int) -> np.ndarray:
    """The place of the least, and of equal ones the first, of each `run` values in a row."""
    least, size = np.arange(len(values), dtype=np.int32), 1
    while size < run:
        step = min(size, run - size)
        left = values[:-step] <= values[step:]
        least = np.where(left, least[:-step], least[step:])
        values = np.where(left, values[:-step], values[step:])
        size += step
    return least


def segments(texts: list[bytes], width: int, k: int) -> tuple[np.ndarray, ...]:
    """The joined bytes, and text, anchor hash, start in the joined bytes and number of windows of each segment.

    The anchor of a window of `width` bytes is its k-gram whose hash is least, the first of equal
    ones, so equal windows have equal anchors at equal places, and those places never fall along a
    text. A segment is the windows in a row that have one anchor; none crosses texts.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    windows = np.maximum(size - width + 1, 0)
    text = np.repeat(np.arange(len(texts)), windows)
    if not len(text):
        return data, text, text, text, text
    at = np.arange(len(text)) + np.repeat(np.cumsum(size) - size - (np.cumsum(windows) - windows), windows)
    h = (sliding_hashes(data, k) & np.uint64((1 << 48) - 1)).view(np.int64)
    anchor = first_least(h, width - k + 1)[at]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    return data, text[first], h[anchor[first]], at[first], np.diff(np.append(first, len(text)))


def apart(data: np.ndarray, text: np.ndarray, key: np.ndarray, start: np.ndarray, count: np.ndarray, split: np.ndarray, width: int):
    """text, key, start and count after each window of the anchors in `split` is a segment, keyed by its own hash."""
    hit = np.isin(key, split)
    if not hit.any():
        return text, key, start, count
    total = count[hit]
    s = np.repeat(start[hit] - np.cumsum(total) + total, total) + np.arange(total.sum())
    columns = (np.repeat(text[hit], total), range_hashes(data, s, s + width, 1).view(np.int64), s, np.ones(len(s), np.int64))
    return tuple(np.concatenate([old[~hit], new]) for old, new in zip((text, key, start, count), columns))


def distinct(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of text (under 2**15) and key (48 bits), each once."""
    pairs = np.unique((text << 48) | key)
    return pairs >> 48, pairs & ((1 << 48) - 1)


def remove_repeats(docs: DataFrame, width: int = 50, k: int = 20, shard_bytes: int = 1 << 20, hot: float = 0.01, one_in: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes that stay) of each row of docs.

    A byte goes if a string of `width` bytes over it also starts in a document with a smaller id.
    Every such string, a window, has an anchor, the same in each of its copies. The windows of an
    anchor that several documents have are a segment of the text; equal ones are merged, with their
    least id, before they move. Segments of an anchor meet in a shard, those that have nearly all of
    a window in common with another one; its suffix array, by induced sorting, and its permuted common prefixes put equal windows side by side, and each run of those
    gives the least id. Shards are cut at `shard_bytes` between anchors. Anchors with many different
    segments in a sample, one in `one_in` rows, at least `hot` of its rows, have their windows dealt
    out one by one; a shard's memory is bounded by that and the contexts of one other anchor.

    A row whose whole text has a copy of smaller id loses everything if it has a window, and its own
    windows are not looked at, as the copy has the same. Null texts count as empty; a null id is the
    largest; rows that repeat an id are never held against each other; strings never cross rows; an
    empty table gives no rows; other columns of docs do not matter.
    """
    rows = keyed(docs)
    d = squeezed(rows)

    def own_anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        _, text, key, _, _ = segments(texts, width, k)
        return distinct(text, key)

    few = sampled(rows, one_in)

    def contexts(batches):
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                data, _, key, start, count = segments([t.encode("utf-8", "surrogatepass") for t in b.column("text").slice(at, TEXTS).to_pylist()], width, k)
                yield batch({"h": (key, pa.int64()), "g": (short_hashes(data, start, start + count + width - 1), pa.int64())})

    kinds = few.mapInArrow(contexts, "h bigint, g bigint").groupBy("h", "g").count().groupBy("h").agg(F.sum("count").alias("c"), F.count("*").alias("kinds"))
    kinds = kinds.where("c > 1").orderBy(F.desc("c"), "h").limit(COMMON).collect()
    limit = max(8.0, hot * few.count())
    common, split = [r["h"] for r in kinds], np.array([r["h"] for r in kinds if r["kinds"] >= limit], np.int64)
    both = d.select("id", "k", "z").join(shared_anchors(d, common, own_anchors), ["id", "k"])

    def shared(part: pa.RecordBatch):
        """Ids, ks and the segments of known anchors of the rows of part."""
        raws = [zlib.decompress(z) for z in part.column("z").to_pylist()]
        known = [np.array(x, np.int64) for x in part.column("hashes").to_pylist()]
        codes = np.concatenate([x | (i << 48) for i, x in enumerate(known)]) if known else np.zeros(0, np.int64)
        data, text, key, start, count = segments(raws, width, k)
        mine = np.isin(key | (text << 48), codes)
        text, key, start, count = apart(data, text[mine], key[mine], start[mine], count[mine], split, width)
        first = np.cumsum([0, *map(len, raws)])[text]
        return data, part.column("id").to_numpy()[text], part.column("k").to_numpy()[text], key, start, count, start - first

    def texts(batches):
        least: dict[tuple[int, bytes], list[int]] = {}

        def rows():
            keys, ids = list(least), list(least.values())
            least.clear()
            columns = [[x[0] for x in keys], [x[1] for x in keys], [x[0] for x in ids], [x[0] < x[1] for x in ids]]
            return batch(dict(zip(("key", "seg", "lo", "more"), zip(columns, [pa.int64(), pa.binary(), pa.int64(), pa.bool_()]))))

        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                data, ids, _, key, start, count, _ = shared(b.slice(at, TEXTS))
                raw = data.tobytes()
                for h, i, s, e in zip(key.tolist(), ids.tolist(), start.tolist(), (start + count + width - 1).tolist()):
                    have = least.setdefault((h, raw[s:e]), [i, i])
                    have[0], have[1] = min(have[0], i), max(have[1], i)
                if len(least) > 400_000:
                    yield rows()
        yield rows()

    def places(batches):
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                data, ids, ks, key, start, count, place = shared(b.slice(at, TEXTS))
                g = short_hashes(data, start, start + count + width - 1)
                columns = [key, g, ids, ks, (place << 6) | count]
                yield batch(dict(zip(("key", "g", "id", "k", "sc"), zip(columns, [pa.int64()] * 5))))

    def sort_shards(batches):
        have: list[tuple[int, bytes, int, bool]] = []  # segments of anchors in several contexts
        ready: list[tuple[int, bytes, int, bool]] = []  # those of them that may share a window with another
        alone: list[tuple[int, bytes, int, bool]] = []  # the others, and those of anchors in one context, whose windows have its least id
        own: dict[bytes, list] = {}
        size, last = 0, None

        def close():
            rows = [(last, seg, lo, more) for seg, (lo, more) in own.items()]
            (have if len(rows) > 1 else alone).extend(rows)
            own.clear()
            return sum(len(x[1]) + 1 for x in rows) if len(rows) > 1 else 0

        def sifted() -> int:
            """Deals `have` out to `ready` and `alone`; the bytes of what is ready."""
            if have:
                for row, meets in zip(have, meeting([r[1] for r in have], np.array([r[0] for r in have], np.int64), width, k).tolist()):
                    (ready if meets else alone).append(row)
                have.clear()
            return sum(len(r[1]) + 1 for r in ready)

        def done():
            h, segs, lo, more = (list(c) for c in zip(*ready, *alone)) if ready or alone else ([], [], [], [])
            lo, more = np.array(lo, np.int64), np.array(more, bool)
            bits = np.zeros(len(h), np.int64)
            if ready:
                bits[: len(ready)] = earlier_windows(segs[: len(ready)], lo[: len(ready)], width)
            some = np.flatnonzero((bits != 0) | more)
            length = np.array([len(segs[x]) for x in some], np.int64)
            joined, ends = np.frombuffer(b"".join(segs[x] for x in some), np.uint8), np.cumsum(length)
            g = short_hashes(joined, ends - length, ends)
            ready.clear(), alone.clear()
            columns = (np.array(h, np.int64)[some], g, lo[some], bits[some])
            return batch(dict(zip(("key", "g", "lo", "bits"), zip(columns, [pa.int64()] * 4))))

        for b in batches:
            for h, seg, lo, more in zip(*(b.column(c).to_pylist() for c in ("key", "seg", "lo", "more"))):
                if h != last:
                    size += close()
                    if size >= shard_bytes or len(alone) > 50_000:
                        size = 0
                        if sifted() >= shard_bytes or len(alone) > 50_000:
                            yield done()
                    last = h
                known = own.setdefault(seg, [lo, more])
                known[0], known[1] = min(known[0], lo), known[1] or more or known[0] != lo
        close()
        sifted()
        yield done()

    seg = both.mapInArrow(texts, "key bigint, seg binary, lo bigint, more boolean")
    found = seg.repartition("key").sortWithinPartitions("key").mapInArrow(sort_shards, "key bigint, g bigint, lo bigint, bits bigint")
    dup = both.mapInArrow(places, "key bigint, g bigint, id bigint, k bigint, sc bigint").join(found, ["key", "g"])
    # a segment's windows, up to width - k + 1 of them, are bits of a long below its start
    every = F.expr("shiftleft(1L, cast(sc & 63 as int)) - 1")
    reach = width - k + 1
    dup = dup.withColumn("bits", F.when(F.col("id") > F.col("lo"), every).otherwise(F.col("bits"))).where("bits <> 0")
    dup = dup.groupBy("id", "k").agg(F.collect_list(F.shiftleft(F.shiftright("sc", 6), reach).bitwiseOR(F.col("bits"))).alias("dup"))
    names = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"

    def finish(batches):
        for b in batches:
            rows = []
            for i, z, got, copy in zip(*(b.column(c).to_pylist() for c in ("id", "z", "dup", "copy"))):
                data = np.frombuffer(zlib.decompress(z), np.uint8)
                size = len(data)
                if copy:
                    out = np.full(size, size >= width)
                else:
                    mine = np.array(got or (), np.int64)
                    on = (mine[:, None] >> np.arange(reach)) & 1 > 0
                    out = covered(((mine >> reach)[:, None] + np.arange(reach))[on], width, size)
                edge = np.diff(np.concatenate([[False], out, [False]]).astype(np.int8))
                kept = data[~out].tobytes()
                rows.append((None if i == NO_ID else i, size, int(out.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
            columns = zip(*rows) if rows else [()] * 6
            yield batch({c.split()[0]: (list(v), t) for c, v, t in zip(names.split(", "), columns, [*[pa.int64()] * 4, pa.string(), pa.binary()])})

    return d.join(dup, ["id", "k"], "left").select("id", "z", "dup", "copy").mapInArrow(finish, names)
