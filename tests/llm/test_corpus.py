"""The corpus operators against plain versions, on small tables with nulls, ties and repeats."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.llm import decontaminate, fingerprints, langid, mixing, neardup, pages, quality, secrets, substrings, suffixes
from pageloom.llm.common import uniform

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, schema="doc_id bigint, text string, lang string, source string, n_chars bigint, k string"):
    return spark.createDataFrame(rows, schema)


def texts(n=30, seed=3):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    shared = " ".join(rng.choice(vocab) for _ in range(90))
    out = []
    for i in range(n):
        t = " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 260)))
        if i % 3 == 0:
            t = f"{t[:200]} {shared[i * 3:]} {t[:100]}"
        out.append((i, t))
    out += [(100, None), (101, ""), (102, "  \n"), (103, out[0][1]), (104, out[0][1]), (None, out[0][1]), (105, "x" * 400), (106, "x" * 300)]
    return [(i, t, None, None, None, "clash") for i, t in out]


def covered(n, starts, w):
    m = [False] * n
    for s in starts:
        m[s : s + w] = [True] * w
    return m


def plain(rows, split, w=50):
    seen, out = {}, {}
    for i, t in sorted((1 << 62 if r[0] is None else r[0], r[1]) for r in rows):
        parts = split(t)
        keys = [tuple(parts[j : j + w]) for j in range(len(parts) - w + 1)]
        out[i] = (parts, covered(len(parts), [j for j, k in enumerate(keys) if seen.get(k, i) < i], w))
        for k in keys:
            seen.setdefault(k, i)
    return out


def test_substring_dedup(spark):
    rows = texts()
    want = plain(rows, lambda t: WORD.findall(t or ""))
    assert substrings.remove_repeats(frame(spark, [])).count() == 0
    got = substrings.remove_repeats(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        parts, gone = want[1 << 62 if r.doc_id is None else r.doc_id]
        kept = " ".join(p for p, g in zip(parts, gone) if not g)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(parts), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("hot", [0.0, 1.0])
def test_suffix_dedup(spark, hot):
    rows = texts()
    want = plain(rows, lambda t: list((t or "").encode()))
    assert suffixes.remove_repeats(frame(spark, [])).count() == 0
    for r in suffixes.remove_repeats(frame(spark, rows), shard_bytes=2000, hot=hot, one_in=1).collect():
        parts, gone = want[1 << 62 if r.doc_id is None else r.doc_id]
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        kept = bytes(p for p, g in zip(parts, gone) if not g)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(parts), sum(gone), spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("alphabet", [1, 2, 4, 30])
def test_suffix_array(alphabet):
    rng = random.Random(alphabet)
    for _ in range(60):
        t = np.array([rng.randint(1, alphabet) for _ in range(rng.randint(1, 50))] + [0])
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert suffixes.suffix_array(t).tolist() == want


def test_suffix_array_of_many_names():
    rng = np.random.default_rng(5)
    t = np.append(rng.integers(1, 5000, 9000), 0)
    t[3000:6000] = t[:3000]
    assert len(np.unique(t)) > suffixes.WIDEST
    assert suffixes.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    deep = np.frombuffer(" ".join(str(x) for x in rng.integers(0, 100000, 6000)).encode(), np.uint8).astype(np.int64)
    t = np.append(deep, 0)
    assert suffixes.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i : i + 40].tolist())


def test_difference_cover():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


def test_distance_is_that_of_the_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randint(1, 5) for _ in range(rng.randint(1, 40))]
        b = [x for x in a if rng.random() > 0.15] or [1]
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        want = 1 - row[-1] / (len(a) + len(b) - row[-1])
        for farthest in (0.2, 0.4):
            got = neardup.distance(np.array(a, np.uint64), np.array(b, np.uint64), farthest)
            assert got == pytest.approx(want) if want <= farthest else got > farthest


def test_near_duplicates(spark):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(200)]
    near = list(base)
    near[50] = near[120] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, " ".join(base[::-1])), (5, None), (6, ""), (7, "a b")]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(frame(spark, [(*r, None, None, None, "c") for r in rows])).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}
    assert neardup.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("leaf", [4096, 3])
def test_near_duplicate_classes_against_all_pairs(spark, leaf):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows: list = []
    for base in range(4):
        words = [rng.choice(vocab) for _ in range(90)]
        for _ in range(9):
            edited = [w if rng.random() > 0.07 else rng.choice(vocab) for w in words]
            rows.append((len(rows), " ".join(edited)))
    rows += [(100 + i, " ".join([*passage, *(rng.choice(vocab) for _ in range(60))])) for i in range(12)]
    rows += [(5, rows[20][1]), (None, rows[3][1]), (None, rows[30][1]), (None, "words of its own"), (7, rows[0][1]), (7, rows[0][1]), (200, None), (201, "")]
    seqs = [np.array([hash(w) & 0xFFFFFFFF for w in (t or "").split()], np.uint64) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and len(seqs[i]) and neardup.distance(seqs[i], seqs[j]) <= 0.2 + 1e-12:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    want = []
    for (i, _), x in zip(rows, label):
        ids = [k for (k, _), y in zip(rows, label) if y == x and k is not None]
        want.append((i, min(ids) if ids else None, label.count(x)))
    order = lambda r: tuple(-1 if x is None else x for x in r)
    df = frame(spark, [(*r, None, None, None, "c") for r in rows])
    assert sorted(map(tuple, neardup.near_duplicates(df, leaf=leaf).collect()), key=order) == sorted(want, key=order)
    kept = neardup.keep_one(df).collect()
    assert len(kept) == len(set(label)) and kept[0].k == "c"


def test_bands_meet_at_the_link_rule():
    rng = np.random.default_rng(3)
    for length, edits in [(9, 1), (20, 2), (60, 6), (200, 22)]:
        met = 0
        for _ in range(60):
            a = rng.integers(1, 1 << 60, length).astype(np.uint64)
            b = a.copy()
            b[rng.choice(length, edits, replace=False)] = rng.integers(1, 1 << 60, edits).astype(np.uint64)
            assert neardup.distance(a, b) <= 0.2 + 1e-12
            met += bool((neardup.band_keys(a) == neardup.band_keys(b)).any())
        assert met >= 59


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(1, 60), None, rng.choice(["a", "b", "c", None]), None, "c") for i in range(2000)] + [(5000, None, None, "a", None, "c")]
    got = mixing.pareto_mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    total = sum(r["size"] for r in got)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(total)
    for s in ("a", "b", "c", None):
        mine = [r for r in got if r.source == s]
        assert sum(r.taken for r in mine) == pytest.approx(mine[0].target, rel=0.02)
        assert all(r.taken <= 3 * r["size"] for r in mine)


def plain_pareto(rows, targets, seed):
    """Words taken of each row (doc_id, source, size, u) by sorting all of a source by Pareto rank."""
    out = {}
    for s, target in targets.items():
        mine = [r for r in rows if r[1] == s]
        total = sum(r[2] for r in mine)
        whole = int(target / total + 1e-12)
        part, rest, mean = max(target / total - whole, 1e-12), target - whole * total, total / len(mine)
        rank = lambda r: r[3] / (1 - r[3]) / (part / (1 - part) * max(r[2], 1) / mean)
        at = 0
        for r in sorted(mine, key=lambda r: (r[2] > rest, rank(r))):
            out[r[0]] = (whole + (rest > 0 and at + r[2] / 2 <= rest)) * r[2]
            at += r[2]
    return out


@pytest.mark.parametrize("bins", [4096, 3])
def test_mixing_against_a_plain_pareto_sampler(spark, bins):
    rng = random.Random(4)
    rows = [(i, "w " * int(rng.paretovariate(1.1) * 3), None, rng.choice(["a", "a", "a", "b", "c", None]), None, "c") for i in range(900)]
    rows += [(5000, "w " * 9000, None, "a", None, "c"), (5001, None, None, "b", None, "c")]
    df = frame(spark, rows)
    us = {r.doc_id: r.u for r in df.select("doc_id", uniform(F.col("doc_id"), F.xxhash64("text"), seed=7).alias("u")).collect()}
    got = mixing.pareto_mix(df, bins=bins).collect()
    want = plain_pareto([(r.doc_id, r.source, r["size"], us[r.doc_id]) for r in got], {r.source: r.target for r in got}, 7)
    assert {r.doc_id: r.taken for r in got} == want
    assert mixing.pareto_mix(frame(spark, [])).count() == 0


def test_mixing_includes_by_size(spark):
    rows = [(i, "w " * (10 if i % 2 else 30), None, s, None, "c") for s in ("a", "b", "c") for i in range(800)]
    taken = {10: 0, 30: 0}
    for r in mixing.pareto_mix(frame(spark, rows)).where("source = 'a'").collect():
        taken[r["size"]] += r.taken > 0
    odds = lambda n: taken[n] / (400 - taken[n])
    assert odds(30) / odds(10) == pytest.approx(3, rel=0.35)


def test_targets_stop_at_three_times_the_source(spark):
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame([("a", 1000), ("b", 10), ("c", 400)], "source string, source_size bigint")).collect()}
    assert got["b"] == 30 and got["a"] == pytest.approx(1380 / 4) and got["c"] == pytest.approx(1380 * 3 / 4)


def test_secrets(spark):
    good, sha = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "2c26b46b68ffc68ff99b453c1d30413413422d70"
    rows = [(1, f'the token = "{good}" here'), (2, f"at commit {sha} we"), (3, None), (4, ""), (5, "plain words only")]
    df = frame(spark, [(*r, None, None, None, "c") for r in rows])
    got = {(r.doc_id, r.secret): r.is_secret for r in secrets.findings(df).collect()}
    assert got == {(1, good): True, (2, sha): False}
    text = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert text == {1: f'the token = "{secrets.MARK}" here', 2: rows[1][1], 3: None, 4: "", 5: "plain words only"}


def test_secrets_of_all_lengths_alphabets_and_places(spark):
    rng = random.Random(6)
    text = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    aws, hexa = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    jwt = f"eyJ{text(alnum, 33)}.eyJ{text(alnum, 800)}.{text(alnum + '_-', 86)}"
    letters = "qWzRtYpLkJhGfDsAxCvBnMqE"
    rows = [(1, f"secret = {aws}"), (2, f"Authorization: Bearer {jwt}"), (3, 'password: "tR7!kq9Zx2" set'), (4, f'api_key="{letters}"')]
    rows += [(5, f'at commit {hexa} we set {"much of the text " * 3} token = "{hexa}"'), (6, "the password policy of /usr/local/lib/python/site/index or the key findings, see either/or/neither/nor/both")]
    rows += [(7, f"{aws} and then {aws}")]
    df = frame(spark, [(*r, None, None, None, "c") for r in rows])
    got = {(r.doc_id, r.secret) for r in secrets.findings(df).where("is_secret").collect()}
    assert got == {(1, aws), (2, jwt), (3, "tR7!kq9Zx2"), (4, letters), (5, hexa), (7, aws)}
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert clean[1] == f"secret = {secrets.MARK}" and clean[3] == f'password: "{secrets.MARK}" set' and hexa not in clean[5] and clean[6] == rows[5][1]


def test_decontamination(spark):
    rng = random.Random(8)
    item = " ".join(f"q{rng.randint(0, 900)}" for _ in range(30))
    other = " ".join(f"z{rng.randint(0, 900)}" for _ in range(200))
    bench = spark.createDataFrame([(7, item), (8, None), (9, "too short")], "item_id bigint, text string")
    df = frame(spark, [(i, t, None, None, None, "c") for i, t in [(1, f"{other} {item} {other}"), (2, other), (3, None), (4, " ".join(item.split()[:14]))]])
    assert [(r.doc_id, r.item_id, r.start_word, r.similarity) for r in decontaminate.matches(df, bench).collect()] == [(1, 7, 200, 1.0)]
    assert {r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()} == {2, 3, 4}


def test_decontamination_of_quoted_and_short_items(spark):
    rng = random.Random(9)
    item = " ".join(f"q{rng.randint(0, 900)}" for _ in range(15))
    bench = spark.createDataFrame([(1, item), (2, "Blue, green whale"), (3, "zebra"), (4, "¿?")], "item_id bigint, text string")
    rows = [(1, f'He said "{item}" and left'), (2, f"see {item}###"), (3, 'so "blue green whale!" it was'), (4, "(Zebra)"), (5, "blue whale green zebras"), (6, "a ¿? b"), (7, None), (8, "")]
    df = frame(spark, [(*r, None, None, None, "c") for r in rows])
    got = {(r.doc_id, r.item_id, r.start_word, r.similarity) for r in decontaminate.matches(df, bench).collect()}
    assert got == {(1, 1, 2, 1.0), (2, 1, 1, 1.0), (3, 2, 1, 1.0), (4, 3, 0, 1.0), (6, 4, 1, 1.0)}
    assert {r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()} == {5, 7, 8}


def test_decontamination_keeps_its_plan_small(spark):
    """Fingerprints are made within rows, and what items and windows come from is in no plan that is left: the driver holds plans."""
    rng = random.Random(10)
    item = " ".join(f"q{rng.randint(0, 900)}" for _ in range(30))
    df = frame(spark, [(1, item, None, None, None, "c")])
    plan = decontaminate.matches(df, spark.createDataFrame([(1, item)], "item_id bigint, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 12_000 and plan.count("Generate") <= 8 and "xxhash64" not in plan

    pairs = [[(rng.getrandbits(64) - (1 << 63), rng.randint(1, 60)) for _ in range(n)] for n in (0, 1, 7, 40)]
    got = spark.createDataFrame([(n, p) for n, p in enumerate(pairs)], "n int, win array<struct<sh: bigint, wt: int>>").selectExpr("n", f"{decontaminate._fingerprint('win')} as fp").collect()
    for r in got:
        bits = [sum(w if h >> b & 1 else -w for h, w in pairs[r.n]) > 0 for b in range(64)]
        assert r.fp & (1 << 64) - 1 == sum(1 << b for b in range(64) if bits[b])


def test_fingerprints(spark):
    rows = [(i, t) for i, t, *_ in texts() if i is not None]
    got = {r.doc_id: r for r in fingerprints.fingerprints(frame(spark, texts()[:-3] + texts()[-2:])).collect()}
    order = sorted(rows, reverse=True)
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        want = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        assert got[i].edited_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[i].n_chars == len(t)
    assert got[103].fingerprint == got[104].fingerprint == got[0].fingerprint


def test_language_and_quality(spark):
    rng = random.Random(4)
    words = {"en": ["the", "house", "with", "water"], "de": ["das", "haus", "mit", "wasser"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang, None, None, "c") for i in range(80) for lang in [["en", "de"][i % 2]]]
    rows += [(900, None, "en", None, None, "c"), (901, "123 456", None, None, None, "c"), (902, "das wasserhaus", None, None, None, "c")]
    got = {r.doc_id: r for r in langid.language_id(frame(spark, rows)).collect()}
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "de"
    assert all(got[i].lang_pred == lang for i, _, lang, *_ in rows[:80])
    docs = [(i, " ".join(rng.choice(words["en"]) + ("###" if i % 4 == 0 else "") for _ in range(40)), None, None, None, "c") for i in range(200)] + [(999, None, None, None, None, "c")]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(200)], "doc_id bigint, quality int, toxic int")
    out = {r.doc_id: r for r in quality.classify(frame(spark, docs), labels).collect()}
    assert all(out[i].predicted == int(i % 4 > 0) for i in range(200)) and out[999].predicted == 0


def test_main_text(spark):
    body = lambda i: f"<html><body><nav><a>Menu</a></nav><div class='cookie'>We use cookies</div><article><h1>T{i}</h1><p>Body &amp; more  {i}<p>Shared note</article><div class='comments'><p>nice</div><footer>F</footer>"
    df = spark.createDataFrame([(i, "http://h.org/a", body(i)) for i in range(6)] + [(9, None, None)], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in pages.main_text(df).collect()}
    assert got[1].startswith("T1\n\nBody & more 1") and "cookies" not in got[1] and "nice" not in got[1] and got[9] == ""


@pytest.mark.parametrize("raw", ["<svg width='1'/>", "<math/>", "<object data='x' />", "<script src='x' />", "<svg width='1'>", "<iframe src='x'>"])
def test_elements_without_an_end_are_empty(raw):
    assert [x[1] for x in pages.blocks(f"<article><p>before</p>{raw}<p>after</p></article>")] == ["before", "after"]


def test_article_text_stays():
    page = "<article id='side-effects'><h2 id='related-work'>Related</h2><section id='search-methods'><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>TeX</annotation></math> be</p></section>"
    page += "<object data='v'>Fallback</object><p class='side-effects'>Effects</p><div class='ad'>Buy</div><div class='big social-share buttons'>Share</div><div class='related-posts'>More</div><script>var x;</script></article>"
    assert [x[1] for x in pages.blocks(page) if not x[2]] == ["Related", "Let x=1 be", "Fallback", "Effects"]


def test_template_of_repeated_and_mirrored_pages(spark):
    page = lambda note, ad: f"<div class='top'>Site</div><p>{ad}</p><article><h1>Title {note}</h1><p>Only {note}</p></article><div>Imprint</div>"
    rows = [(1, "http://one.org/a", page("a", "x"))] * 3 + [(i, f"http://mirror.org/{i}", page("b", f"ad {i}")) for i in range(2, 6)]
    rows += [(10 + i, "http://many.org", "<div>Site</div>" + "".join(f"<div>own {i} {j}</div>" for j in range(i)) + f"<h1>T{i}</h1><div>{'Quoted' if i < 5 else 'Other'}</div><div>Imprint</div>") for i in range(1, 8)]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1] == "Title a\n\nOnly a" and all(got[i] == "Title b\n\nOnly b" for i in range(2, 6))
    assert got[12] == "own 2 0\n\nown 2 1\n\nT2\n\nQuoted" and got[16] == "\n\n".join([f"own 6 {j}" for j in range(6)] + ["T6", "Other"])


def test_rare_languages_and_cut_terms_are_learned(spark):
    rows = [(i, "the house", "en", None, None, "c") for i in range(600)] + [(1000 + i, "xylo qix", "xx", None, None, "c") for i in range(3)]
    assert langid.train(frame(spark, rows), max_docs=20).langs == ["en", "xx"]
    rows = [(i, text, lang, None, None, "c") for i in range(40) for lang, text in [("de", "bbb " * 10 + "aaa " * 9), ("en", "aaa " * 10 + "bbb " * 9)]]
    model = langid.train(frame(spark, rows), max_terms=1)
    assert np.ptp(model.matrix[[model.tables[0]["aaa"], model.tables[0]["bbb"]]], axis=1).max() < 0.5
