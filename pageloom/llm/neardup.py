"""Near-duplicate documents: Order MinHash candidates, verified by banded alignment."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import NO_ID, WORD, batch, cut, fresh, mix, packed, shingle_hashes, sweep, words_of
from pageloom.llm.fingerprints import labelled

#: Bands of one sketch over shingles of SHINGLE words; texts of up to SHORT words have SHORT_BANDS more
#: over pairs of words, as one edit can leave them without a common shingle of five.
SHINGLE, BANDS = 5, 96
SHORT, SHORT_BANDS = 40, 48
#: Bins of the word counts that bound an alignment from above.
BINS = 128
#: Rows of a head's buckets that one group has, about, and how many of the rows it gave it remembers.
GROUP, SEEN = 16_384, 200_000
_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64)) | np.uint64(1)


def _sketches(s: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """A sketch for each seed: the two least labelled shingles in text order."""
    rank = labelled(s)
    out = np.empty(len(seeds), np.uint64)
    step = max(1, 400_000 // len(s))
    for at in range(0, len(seeds), step):
        v = rank[None, :] * seeds[at : at + step, None]
        line = np.arange(len(v))
        a = v.argmin(1)
        v[line, a] = np.uint64((1 << 64) - 1)
        b = v.argmin(1) if len(s) > 1 else a
        out[at : at + step] = mix(s[np.minimum(a, b)] * np.uint64(3) + s[np.maximum(a, b)] * np.uint64(5))
    return out


def band_keys(words: np.ndarray) -> np.ndarray:
    """A key for each band of the text, chosen for alignment 0.8 at scattered edits."""
    keys = [_sketches(shingle_hashes(words, SHINGLE), _SEEDS)]
    if len(words) <= SHORT:
        keys.append(_sketches(shingle_hashes(words, 2), _SEEDS[:SHORT_BANDS]))
    keys = np.concatenate(keys)
    return mix(keys) + np.arange(len(keys), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def word_counts(words: np.ndarray) -> np.ndarray:
    """How many words fall into each of BINS bins, up to 255."""
    return np.minimum(np.bincount((words >> np.uint64(57)).astype(np.int64), minlength=BINS), 255).astype(np.uint8)


def most_edits(n, m, farthest: float):
    """Words left unaligned in both sequences together, at most, within a distance of `farthest`."""
    return (n + m) * (farthest / (2 - farthest)) + 1e-9


def distance(a: np.ndarray, b: np.ndarray, farthest: float = 0.2) -> float:
    """1 - matches / (len(a) + len(b) - matches) of the best alignment of two sequences.

    Exact up to `farthest`, else some value above it. Equal ends are cut off; then only the band of
    places that an alignment within `farthest` can pair is kept, as the bits of one integer that
    moves along the second sequence: bits that leave it are counted, so a step costs the band's
    width however long the texts are. Two empty sequences are far apart.
    """
    n, m = len(a), len(b)
    edits = int(most_edits(n, m, farthest))
    if not n or not m or abs(n - m) > edits:
        return 1.0
    shorter = min(n, m)
    unlike = np.flatnonzero(a[:shorter] != b[:shorter])
    head = int(unlike[0]) if len(unlike) else shorter
    rest = shorter - head
    unlike = np.flatnonzero(a[n - rest :][::-1] != b[m - rest :][::-1]) if rest else np.zeros(0, int)
    tail = int(unlike[0]) if len(unlike) else rest
    x, y = a[head : n - tail].tolist(), b[head : m - tail].tolist()
    matches = head + tail
    if x and y:
        reach = (edits + abs(n - m)) // 2 + 1  # an alignment this near strays no further from the diagonal
        places: dict[int, list[int]] = {}
        for i, v in enumerate(x):
            places.setdefault(v, []).append(i)
        full = (1 << (2 * reach + 1)) - 1
        low, free = -reach, full  # bit k of free is place low + k: not yet aligned
        for v in y:
            at = places.get(v)
            if at is not None:
                hit = 0
                for p in at[bisect_left(at, low) :] if len(at) > 8 else at:
                    if low <= p <= low + 2 * reach:
                        hit |= 1 << (p - low)
                    elif p > low:
                        break
                used = free & hit
                free = ((free + used) | (free - used)) & full
            matches += low >= 0 and not free & 1
            low += 1
            free = (free >> 1) | (1 << (2 * reach))
        left = free if low >= 0 else free >> -low
        inside = len(x) - max(low, 0)
        if inside > 0:
            kept = min(inside, 2 * reach + 1 - max(-low, 0))
            matches += kept - (left & ((1 << kept) - 1)).bit_count()
    return 1 - matches / (n + m - matches)


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) of edges (a, b), by label propagation.

    Each round takes the least label of the neighbours and then the label of that label.
    """
    both, _ = packed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"))
    labels, _ = packed(least.select(F.col("a").alias("node"), "label"))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("other"))
        new = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "other").alias("label"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("jump"))
        new = new.join(up, new.label == up.up, "left").select("node", "old", F.least("label", F.coalesce("jump", "label")).alias("label"))
        new, _ = packed(new)
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels


def _merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels after the labels that edges (a, b) connect are one."""
    edges, n = packed(edges.where("a <> b").distinct())
    if not n:
        return labels
    # a member of several heads' buckets ties all of them to the least: most of those edges are the same
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    tied = edges.join(least, "b")
    edges = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(tied.where("a <> m").select("a", F.col("m").alias("b"))).distinct()
    new = components(edges).toDF("old", "new")
    merged, _ = packed(labels.join(new, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label")))
    return merged


def _sign(batches):
    """id, node, n, counts and keys of each row; of the rows of a partition with one text only the first has keys."""
    names = ["id", "node", "n", "counts", "keys"]
    types = [pa.int64(), pa.binary(), pa.list_(pa.int64())]
    seen: set[int] = set()
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            n, counts, keys = [], [], []
            for node, text in zip(part.column("node").to_pylist(), part.column("text").to_pylist()):
                words = words_of(text)[3]
                n.append(len(words))
                counts.append(word_counts(words).tobytes())
                keys.append(band_keys(words).view(np.int64) if len(words) and node not in seen else [])
                seen.add(node)
            columns = [part.column("id"), part.column("node"), *(pa.array(v, t) for v, t in zip((n, counts, keys), types))]
            yield pa.RecordBatch.from_arrays(columns, names)


def _first_texts(batches):
    """The first row of each node in a partition."""
    seen: set[int] = set()
    for b in batches:
        at = [i for i, node in enumerate(b.column("node").to_pylist()) if node not in seen and not seen.add(node)]
        yield b.take(pa.array(at, pa.int64()))


def _sequences(batches):
    for b in batches:
        got = [(words_of(t)[3] >> np.uint64(32)).astype(np.uint32).tobytes() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(got, pa.binary())], ["node", "seq"])


def _table(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16)


def _plausible(farthest: float):
    """Pairs (x, y) whose word counts allow an alignment within `farthest`."""

    def run(batches):
        for b in batches:
            apart = np.abs(_table(b.column("cx")) - _table(b.column("cy"))).sum(1)
            ok = apart <= most_edits(b.column("nx").to_numpy(), b.column("ny").to_numpy(), farthest)
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y")], ["x", "y"]).filter(pa.array(ok))

    return run


def _untried(farthest: float, largest: bool):
    """(node, other): a node and the label of another class in its bucket that holds a plausible partner.

    Rows of a bucket come one after another. Its members are held in memory, a few dozen bytes each
    and no more than a leaf has; pairs are looked at as array operations in blocks and never leave
    the task, only the classes that a node must be held against do, the node being that of the
    smaller class. The head has been held against all members already. With `largest` only the bucket's
    largest class is held against others, so a member gives at most one row.

    Near copies share most of their buckets, and these a head: buckets of the same group g follow one
    another, and what one of them gave is not given again. Up to SEEN rows are remembered; more are
    only repeated, and the caller makes them distinct.
    """

    def one(rows: list[tuple]) -> set[tuple[int, int]]:
        if len({r[2] for r in rows}) < 2:
            return set()
        rows.sort(key=lambda r: r[1])
        node, n, label, size = (np.array(c, np.int64) for c in list(zip(*rows))[:4])
        counts = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(-1, BINS).astype(np.int16)
        rough = counts.reshape(len(rows), 16, -1).sum(2)
        chief = label[np.lexsort((label, size))[-1]]
        out = set()
        ratio = 1 / (1 - farthest) + 1e-9
        upto = np.searchsorted(n, n * ratio, "right")
        for at in range(0, len(rows), 32):
            end = min(at + 32, len(rows))
            top = int(upto[end - 1])
            most = most_edits(n[at:end, None], n[None, at:top], farthest)
            ok = (label[at:end, None] != label[None, at:top]) & (np.abs(n[at:end, None] - n[None, at:top]) <= most)
            ok &= np.arange(at, top)[None, :] > np.arange(at, end)[:, None]
            if largest:
                ok &= (label[at:end, None] == chief) | (label[None, at:top] == chief)
            i, j = np.nonzero(ok)
            i, j = i + at, j + at
            for table in (rough, counts):
                near = np.abs(table[i] - table[j]).sum(1) <= most_edits(n[i], n[j], farthest)
                i, j = i[near], j[near]
            swap = (size[i] > size[j]) | ((size[i] == size[j]) & (label[i] > label[j]))
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            out.update(zip(node[i].tolist(), label[j].tolist()))
        return out

    def run(batches):
        key, rows = (None, None), []
        seen: set[tuple[int, int]] = set()

        def new() -> set[tuple[int, int]]:
            got = one(rows) - seen if len(rows) > 1 else set()
            if len(seen) + len(got) > SEEN:
                seen.clear()
            if len(got) <= SEEN:
                seen.update(got)
            return got

        for b in batches:
            found: set[tuple[int, int]] = set()
            for g, k, *row in zip(*(b.column(c).to_pylist() for c in ("g", "key", "node", "n", "label", "of", "counts"))):
                if (g, k) != key:
                    found |= new()
                    if g != key[0]:
                        seen.clear()
                    key, rows = (g, k), []
                rows.append(tuple(row))
            yield batch({"node": ([f[0] for f in found], pa.int64()), "other": ([f[1] for f in found], pa.int64())})
        found = new()
        yield batch({"node": ([f[0] for f in found], pa.int64()), "other": ([f[1] for f in found], pa.int64())})

    return run


def _aligned(farthest: float, once: bool):
    """(g, x): asked nodes x of group g that align with a member of the group.

    Of each group the asked rows (side 0) come first and are held; members stream past them. With
    `once` a node that has a partner is not held against further members; otherwise (g, member) comes.
    """

    def run(batches):
        group, asked = None, []
        for b in batches:
            links = []
            for g, blk, salt, side, node, raw in zip(*(b.column(c).to_pylist() for c in ("g", "blk", "salt", "side", "node", "seq"))):
                seq = np.frombuffer(raw, np.uint32)
                counts = np.bincount(seq & np.uint32(255), minlength=256)
                if group != (g, blk, salt):
                    group, asked = (g, blk, salt), []
                if side == 0:
                    asked.append((node, seq, counts))
                    continue
                left = []
                for own in asked:
                    other, theirs, bins = own
                    near = np.abs(counts - bins).sum() <= most_edits(len(seq), len(theirs), farthest)
                    near = near and distance(theirs, seq, farthest) <= farthest + 1e-12
                    if near:
                        links.append((g, other if once else node))
                    if not (near and once):
                        left.append(own)
                asked = left
            yield batch({"g": ([x[0] for x in links], pa.int64()), "x": ([x[1] for x in links], pa.int64())})

    return run


def _meet(asked: DataFrame, members: DataFrame, seqs: DataFrame, farthest: float, once: bool, block: int = 64, share: int = 512) -> DataFrame:
    """_aligned() over asked (g, node) and members (g, node) of each group g.

    Groups are cut into blocks of asked nodes and shares of members, so a task's piece has about
    `block` of the one and `share` of the other however large a class is.
    """
    cuts = asked.groupBy("g").agg(F.count("*").alias("na")).join(members.groupBy("g").agg(F.count("*").alias("nm")), "g")
    cuts = cuts.select("g", F.ceil(F.col("na") / block).cast("int").alias("blocks"), F.ceil(F.col("nm") / share).cast("int").alias("salts"))
    own = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    a = asked.join(cuts, "g").select("g", own("blocks").alias("blk"), every("salts").alias("salt"), F.lit(0).alias("side"), "node")
    m = members.join(cuts, "g").select("g", every("blocks").alias("blk"), own("salts").alias("salt"), F.lit(1).alias("side"), "node")
    rows = a.union(m).join(seqs, "node").select("g", "blk", "salt", "side", "node", "seq")
    rows = rows.repartition("g", "blk", "salt").sortWithinPartitions("g", "blk", "salt", "side")
    return rows.mapInArrow(_aligned(farthest, once), "g bigint, x bigint")


def _buckets(rows: DataFrame, leaf: int) -> DataFrame:
    """key, node, groups and head of each key that several of rows (key, node) have.

    The head is the member whose buckets are largest together: the centre of a group of copies is in
    all of its buckets, so most of the group is linked to it at once, and to the same one in each.
    groups is the number of groups that the head's buckets are dealt to, so that one has about GROUP
    rows; 0 if the key has one node besides the head at most, null if it may have more than `leaf`.
    A text counts once for each partition that has it.
    """
    size = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    own = rows.join(size, "key").distinct()
    own = own.withColumn("score", F.sum("size").over(Window.partitionBy("node")))  # a node has no more rows than bands
    head = own.groupBy("key").agg(F.max(F.struct("score", "node")).alias("m"))
    groups = F.when(F.col("size") <= 2, 0).when(F.col("size") <= leaf, F.ceil(F.col("m.score") / GROUP)).cast("int")
    return cut(own.join(head, "key").select("key", "node", groups.alias("groups"), F.col("m.node").alias("head")))


def _star(cand: DataFrame, labels: DataFrame, known: DataFrame, seqs: DataFrame, far: float) -> DataFrame:
    """Links (a, b) of members to the heads of their buckets, if those are of another class."""
    pairs = cand.where("node <> head").select(F.col("node").alias("x"), F.col("head").alias("y")).distinct()
    pairs = pairs.join(known.toDF("x", "nx", "cx"), "x").join(known.toDF("y", "ny", "cy"), "y")
    pairs = pairs.join(labels.toDF("x", "lx"), "x").join(labels.toDF("y", "ly"), "y").where("lx <> ly") if labels is not None else pairs
    pairs, _ = packed(pairs.select("x", "y", "nx", "ny", "cx", "cy").mapInArrow(_plausible(far), "x bigint, y bigint"))
    heads = pairs.select(F.col("y").alias("g"), F.col("y").alias("node")).distinct()
    return _meet(heads, pairs.select(F.col("y").alias("g"), F.col("x").alias("node")), seqs, far, False).toDF("a", "b")


def _large(cand: DataFrame, labels: DataFrame, known: DataFrame, seqs: DataFrame, far: float, leaf: int) -> DataFrame:
    """Links (a, b) of labels by members of the buckets that are too large for _across().

    The members of a bucket's most common class are of one class already. Each of the others is held against
    that class. Among the others, blocks of about leaf / 2 meet two by two, in a group each, so every
    pair of them is looked at in some group of about `leaf` members and none is left out.
    """
    size = labels.groupBy("label").agg(F.count("*").alias("of"))
    rows = cand.where(F.col("groups").isNull()).select("key", "node").join(labels, "node")
    per = rows.groupBy("key", "label").agg(F.count("*").alias("n"))
    chief = per.groupBy("key").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("all"))
    chief = chief.where("m.n < all").select("key", F.col("m.label").alias("chief"), F.ceil((F.col("all") - F.col("m.n")) * 2 / leaf).cast("int").alias("blocks"))
    rest, n = packed(rows.join(chief, "key").where("label <> chief"))
    if not n:
        return labels.select(F.col("label").alias("a"), F.col("label").alias("b")).limit(0)
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = rest.withColumn("own", block).select("key", "node", "own", "blocks", other.alias("with"))
    key = F.xxhash64("key", F.least("own", "with"), F.greatest("own", "with"))
    about = known.join(labels.join(size, "label"), "node")
    pairs = pairs.select(key.alias("key"), "node").join(about, "node").withColumn("g", F.col("key"))
    pairs = pairs.select("g", "key", "node", "n", "label", "of", "counts").repartition("g").sortWithinPartitions("g", "key")
    tests = pairs.mapInArrow(_untried(far, False), "node bigint, other bigint")
    return _held(tests.union(rest.select("node", F.col("chief").alias("other"))), labels, seqs, far)


def _held(tests: DataFrame, labels: DataFrame, seqs: DataFrame, far: float) -> DataFrame:
    """Links (a, b) of labels: tests are (node, other), a node to be held against the class with the label other."""
    tests, _ = packed(tests.distinct())
    members = labels.join(tests.select(F.col("other").alias("label")).distinct(), "label").select(F.col("label").alias("g"), "node")
    found = _meet(tests.select(F.col("other").alias("g"), "node"), members, seqs, far, True).distinct()
    return found.join(labels.toDF("x", "lx"), "x").select(F.col("g").alias("a"), F.col("lx").alias("b"))


def _across(cand: DataFrame, labels: DataFrame, known: DataFrame, seqs: DataFrame, far: float, largest: bool) -> DataFrame:
    """Links (a, b) of labels by members of a bucket, its head apart, that are of different classes.

    With `largest` one of the two classes is the bucket's largest.
    """
    size = labels.groupBy("label").agg(F.count("*").alias("of"))
    about = known.join(labels.join(size, "label"), "node")
    group = F.xxhash64("head", F.pmod(F.xxhash64("key"), F.col("groups"))).alias("g")
    rows = cand.where((F.col("groups") > 0) & (F.col("node") != F.col("head"))).select(group, "key", "node").join(about, "node")
    rows = rows.select("g", "key", "node", "n", "label", "of", "counts").repartition("g").sortWithinPartitions("g", "key")
    return _held(rows.mapInArrow(_untried(far, largest), "node bigint, other bigint"), labels, seqs, far)


def classes(docs: DataFrame, similarity: float = 0.8, leaf: int = 4096) -> DataFrame:
    """id, node (hash of the text), n (words) and label of each row of docs; see near_duplicates()."""
    far = 1 - similarity
    d = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    d = d.select("id", F.xxhash64("text").alias("node"), "text")
    sig = cut(d.mapInArrow(_sign, "id bigint, node bigint, n bigint, counts binary, keys array<bigint>"))
    cand = _buckets(sig.select(F.explode("keys").alias("key"), "node"), leaf)
    sweep(cand)
    need = cand.select("node").distinct()
    known = sig.where(F.size("keys") > 0).select("node", "n", "counts").join(need, "node").groupBy("node")
    known, _ = packed(known.agg(F.first("n").alias("n"), F.first("counts").alias("counts")))
    texts = d.select("node", "text").mapInArrow(_first_texts, "node bigint, text string")
    texts = texts.join(known.select("node"), "node").groupBy("node").agg(F.first("text").alias("text"))
    seqs = cut(texts.mapInArrow(_sequences, "node bigint, seq binary"))
    del texts
    sweep(seqs)
    labels = _merged(known.select("node", F.col("node").alias("label")), _star(cand, None, known, seqs, far))
    # what joins the largest class of its bucket is not held against all other classes one by one
    for largest in (True, False):
        sweep(labels)
        labels = _merged(labels, _across(cand, labels, known, seqs, far, largest))
    labels = _merged(labels, _large(cand, labels, known, seqs, far, leaf))
    return sig.select("id", "node", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def near_duplicates(docs: DataFrame, similarity: float = 0.8, leaf: int = 4096) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and class_size (its rows) of each row of docs.

    A node is a text, by 64 bits of hash, so copies and rows that repeat an id are told apart by what
    they say: at 10^9 different texts the chance that any two are taken for one is 3 %. Nodes that
    share an Order MinHash sketch over shingles of five words, in short texts also of two, are
    candidates; a link needs an alignment of the two word sequences (32 bits of hash a word) with
    matches / (all - matches) of at least `similarity`, and classes are what links connect. Near
    copies with their parts in another order, or with lines that repeat a different number of times,
    share most shingles but are not linked, as the alignment counts them as edits.

    First each member of a bucket is aligned with its head. Then only members of different classes
    matter. Within buckets of up to `leaf` nodes all pairs are held against a bound on their word
    counts, in place and without a row for any pair; a node that may have a partner in another class
    is aligned with that class, first if it is the bucket's largest, then with those left. In larger
    buckets the members that are not of the largest class are held against that class, and against one
    another by blocks that meet two by two, so a bucket's size decides how pairs are found and never
    whether. Copies of a text count once for each partition of docs.

    Texts without words are each a class of their own. A null id sorts last: a class without any
    other has a null class_id. An empty table gives no rows. Other columns of docs do not matter.
    """
    rows = classes(docs, similarity, leaf)
    least = rows.where("n > 0").groupBy("label").agg(F.min("id").alias("least"), F.count("*").alias("rows"))
    out = rows.join(least, "label", "left")
    own = F.col("n") == 0
    class_id = F.when(own, F.col("id")).otherwise(F.col("least"))
    return out.select(F.col("id").alias("doc_id"), class_id.alias("class_id"), F.when(own, F.lit(1)).otherwise(F.col("rows")).cast("bigint").alias("class_size"))


def keep_one(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One row of docs for each class, columns as they were: that of the least doc_id, null ids last.

    Rows that repeat an id stay if their texts are in different classes; of rows with the same id
    and text one stays. Rows without words are classes of their own and all stay.
    """
    first = F.min(F.struct(F.coalesce("id", F.lit(NO_ID)).alias("i"), F.col("node").alias("t"))).alias("m")
    kept = classes(docs, similarity).where("n > 0").groupBy("label").agg(first)
    i, t = fresh(docs, "i"), fresh(docs, "t")
    marked = docs.withColumn(i, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))).withColumn(t, F.xxhash64(F.coalesce("text", F.lit(""))))
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    one = marked.where(worded).join(kept.select(F.col("m.i").alias(i), F.col("m.t").alias(t)), [i, t], "left_semi").dropDuplicates([i, t])
    return one.select(*docs.columns).unionByName(docs.where(~worded))
