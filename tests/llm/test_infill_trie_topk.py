"""Fill-in-the-middle, the prefix trie and exact top-k against plain versions, on awkward small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.llm import infilling, prefixtrie, topk

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def infilled(doc_id, text):
    units = UNIT.findall(text or "")
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text or ""
    if h4 % 100 < 20:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def awkward_texts():
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abZé 7.<>\n\U0001f600") for _ in range(rng.randint(0, 60)))) for i in range(120)]
    rows += [(200 + i, "one text that many rows share, again and again") for i in range(300)]
    rows += [(i, t) for i, t in enumerate([None, "", "<P>", "x<", "a<S", "S>b", "<P", "M>", "aaaa", "    ", "x" * 300_000, "ab " * 200_000], 600)]
    return rows + [(None, "no id"), (None, None), (7, rows[7][1]), (7, rows[7][1]), (7, "another text")]


def test_fill_in_middle(spark):
    rows = awkward_texts()
    d = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, k1 string, n int")
    out = infilling.fill_in_middle(d)
    got = out.withColumn("back", infilling.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(repr, (tuple(r)[:6] for r in got))) == sorted(repr(infilled(*r)) for r in rows)
    assert sorted(r.back for r in got) == sorted(t or "" for _, t in rows)
    assert infilling.fill_in_middle(d.limit(0)).count() == 0


def test_texts_with_one_hash_are_told_apart_by_content(spark, monkeypatch):
    monkeypatch.setattr(infilling.F, "xxhash64", lambda *c: F.lit(0).cast("bigint"))
    rows = [(i, t) for i, t in enumerate(["ab c", "d", "ab c", "", "ef, g"] * 3)]
    got = infilling.fill_in_middle(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(infilled(*r)) for r in rows)


@pytest.mark.parametrize("step", [1, 2, 3, 50, 5000])
def test_elias_fano_selects_every_value(step):
    rng = np.random.default_rng(step)
    for n in (1, 2, 9, 700, 5000):
        values = np.cumsum(rng.integers(1, step + 1, n)) - 1
        held = infilling.EliasFano(values)
        assert [held[i] for i in range(n)] == values.tolist()


def trie(rows, siblings=5, lengths=9):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(list)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % lengths
        path = tuple(own.get(c - int(math.fmod(c, siblings)), [])[:h] + v[h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    sha = {k: hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest() for k in members}
    return [(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], sha[k]) for k, m in members.items()]


def dialogues():
    rng = random.Random(9)
    rows = []
    for c in [*range(-12, 60), 5000, 9999, 1 << 40, -(1 << 40)]:
        for t in range(rng.randint(1, 12)):
            rows.append((c, t if rng.random() > 0.05 else None, rng.choice(["user", "é", None, ""]), rng.choice(["a", "b", "", None])))
    rows += [(c, t, "user", f"same {t}") for c in range(300, 420) for t in range(40)]
    rows += [(777, t, "user", "long") for t in range(2500)] + [(782, t, "user", "long") for t in range(2300)]
    rows += [(3, 1, "user", "twice")] * 3 + [(None, 0, "user", "no conversation")]
    return rows


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_prefix_trie(spark):
    rows = dialogues()
    rng = random.Random(1)
    repeated = [r for r in rows if r[1] is not None]  # rows whose turn repeats with other texts have an order of their own
    seen = {}
    rows = [r for r in repeated if seen.setdefault(r[:2], r[2:]) == r[2:]] + [r for r in rows if r[1] is None and seen.setdefault(r[:2], r[2:]) == r[2:]]
    rng.shuffle(rows)
    d = spark.createDataFrame([(*r, "clash", 0) for r in rows], f"{SCHEMA}, node string, depth int")
    got = [tuple(r) for r in prefixtrie.prefix_trie(d).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, trie(rows)))


def test_small_tries(spark):
    assert prefixtrie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefixtrie.prefix_trie(spark.createDataFrame([(None, 0, "a", "b")], SCHEMA)).count() == 0
    rows = [(c, 0, "u", "x") for c in (1, 2, 3, 4, 6)]  # without a base, most have no turn left
    got = [tuple(r) for r in prefixtrie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, trie(rows)))


LONG = (1 << 63) - 1


def best(rows, k=20, one_in=20):
    sound = [(i, v, n) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(64 * x) for x in v], n) for i, v, n in sound]
    out = []
    for i, v, n in whole:
        if i is not None and i % one_in == 0:
            scores = sorted((-max(-LONG, min(LONG, sum(a * b for a, b in zip(v, w)))), j is None, j or 0) for j, w, m in whole if m != n)[:k]
            out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(scores, 1)]
    return out


def vectors(n, width, seed, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(width)]) for i in range(n)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_top_k(spark, kind, monkeypatch):
    monkeypatch.setattr(topk, "SEED", 40)
    monkeypatch.setattr(topk, "NARROWEST", 100)
    monkeypatch.setattr(topk, "BLOCK", 7)
    rows = vectors(700, 12, 4) + [(i, [0.5] * 12) for i in range(1000, 1100)]
    rows += [(2000, None), (2020, [None] + [0.1] * 11), (2040, [float("nan")] * 12), (2060, [float("inf")] * 12), (2080, []), (2100, [1.0] * 3), (None, [2.0] * 12), (40, [1.0] * 12), (40, [1.0] * 12)]
    if kind == "float":
        rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    d = spark.createDataFrame([(*r, 1) for r in rows], f"vec_id bigint, embedding array<{kind}>, score int")
    got = [tuple(r) for r in topk.top_k(d).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, best(rows)))
    assert topk.top_k(d.limit(0)).count() == 0
    assert topk.top_k(d.where("vec_id = 3")).count() == 0


@pytest.mark.parametrize("size", [1e7, 1e9, 1e300])
def test_top_k_of_large_numbers_is_exact(spark, size):
    rows = [(i, [x * size for x in v]) for i, v in vectors(60, 4, 8)]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 5).collect()]
    assert sorted(got) == sorted(best(rows, 5))


def test_top_k_leaves_most_lists_untouched():
    rng = np.random.default_rng(2)
    v = np.floor(rng.normal(0, 1, (3000, 64)) * np.geomspace(60, 1, 64))
    best_of, rows = topk.Best(1, 5), np.arange(3000)
    topk.group_search(v[:1], rows[:1], best_of, v, rows, rows)
    p = topk.Postings(v, rows, rows)
    low, high = v[0] * p.least, v[0] * p.most
    bounds = np.sort(np.abs(high - low))
    assert (np.cumsum(bounds) < best_of.floor(0) - np.minimum(low, high).sum()).sum() > 32
    assert best_of.ids[0].tolist() == sorted(range(1, 3000), key=lambda i: (-(v[i] @ v[0]), i))[:5]
