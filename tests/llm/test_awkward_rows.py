"""Clashing names, repeated and null ids, odd letters, cards beside the body, groups larger than a leaf, empty tables."""

from __future__ import annotations

import random

import numpy as np
import pytest

from pageloom.llm import decontaminate, langid, neardup, pages, quality, secrets

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
KEY = "ghp_a8Fk2Lq9Zx7Vb4Nm1Tc6Yw3Rd5Hs0Jp2UeKq"


def docs(spark, rows, more=""):
    return spark.createDataFrame([(i, t, None, None, len(t or ""), *([1] * more.count(","))) for i, t in rows], DOCS + more)


def test_numbers_are_no_letters_and_marks_stay_in_words(spark):
    assert langid.LETTERS.findall("x² ½ ① Ⅳ a_b हिन्दी é́x") == ["x", "a", "b", "हिन्दी", "é́x"]
    rows = [(i, "der die und das", "de", None, 1) for i in range(40)] + [(100, "² ½ ① 12", None, None, 1), (101, None, None, None, 1), (102, "", None, None, 1), (103, "und " * 60_000, None, None, 1)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.language_id(spark.createDataFrame(rows, DOCS)).collect()}
    assert [got[i] for i in (100, 101, 102)] == [("und", 0.0)] * 3 and got[103][0] == "de"
    assert langid.language_id(docs(spark, [])).count() == 0


def test_a_card_does_not_push_out_the_body(spark):
    html = "<html><body><div><p>The long body of the page is here, and it goes on for some time.</p><p>It ends here.</p></div><article><p>Teaser</p></article></body></html>"
    whole = "<html><body><p>Before.</p><article><p>The article is the longer part of this page by far, with two</p><p>blocks of text.</p></article></body></html>"
    p = spark.createDataFrame([(1, "http://a/1", html), (2, None, whole), (3, "odd", None), (4, "http://a/1", "")], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in pages.main_text(p).collect()}
    assert got[1].startswith("The long body") and "It ends here." in got[1]
    assert got[2] == "The article is the longer part of this page by far, with two\n\nblocks of text."
    assert got[3] == got[4] == ""
    assert pages.main_text(p.limit(0)).count() == 0


def test_secrets_of_rows_that_share_an_id_stay_apart(spark):
    other = KEY[::-1].replace("_phg", "xphg")
    rows = [(None, f"token = {KEY}"), (None, f"see {KEY[:12]} and token = {other}"), (4, None), (5, ""), (6, "a b " * 50_000 + f"token = {KEY}")]
    d = docs(spark, rows, ", _id int, _bad int, secrets int, secret_id int")
    got = secrets.redact(d)
    assert got.columns == d.columns and got.count() == len(rows)
    texts = [r.text for r in got.collect()]
    assert not any(t and (KEY in t or other in t) for t in texts) and None in texts and "" in texts
    assert secrets.redact(d.limit(0)).count() == secrets.findings(d.limit(0)).count() == 0


def test_decontamination_keeps_columns_whatever_their_names(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    d = docs(spark, [(1, f"before {item} after"), (2, "clean text of its own, nothing else"), (None, item), (None, None), (3, "")], ", _id int, _k int, bad_id int")
    b = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id bigint, text string")
    got = decontaminate.drop_contaminated(d, b)
    assert got.columns == d.columns and sorted((r.doc_id or -1, r.text or "") for r in got.collect()) == [(-1, ""), (2, "clean text of its own, nothing else"), (3, "")]
    assert decontaminate.drop_contaminated(d, b.limit(0)).count() == 5 and decontaminate.matches(d.limit(0), b).count() == 0


def test_quality_of_an_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.classify(docs(spark, []), labels).count() == 0


@pytest.mark.parametrize("leaf", [4096, 64])
def test_classes_of_groups_larger_than_a_leaf(spark, leaf):
    """Three groups of edited copies share a passage, one text has thousands of copies: labels are those of all pairs."""
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocab) for _ in range(40)]
    texts = []
    for n in (300, 150, 60):
        own = [rng.choice(vocab) for _ in range(80)]
        texts += [" ".join([*passage, *(w if rng.random() > 0.04 else rng.choice(vocab) for w in own)]) for _ in range(n)]
    rows = [*enumerate(texts), *((10_000 + i, texts[0]) for i in range(5000))]
    seqs = [np.array([hash(w) & 0xFFFFFFFF for w in t.split()], np.uint64) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and neardup.distance(seqs[i], seqs[j]) <= 0.2 + 1e-12:
                old, new = sorted((label[i], label[j]), reverse=True)
                label = [new if x == old else x for x in label]
    got = {r.doc_id: (r.class_id, r.class_size) for r in neardup.near_duplicates(docs(spark, rows).repartition(6), leaf=leaf).collect()}
    assert {i: got[i][0] for i in range(len(texts))} == dict(enumerate(label))
    assert all(got[10_000 + i] == got[0] for i in range(5000)) and got[0][1] == label.count(0) + 5000


HOST = "http://shop.org"


def main(spark, htmls, hosts=None):
    rows = [(i, (hosts or [HOST] * len(htmls))[i], h) for i, h in enumerate(htmls)]
    return [r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).orderBy("page_id").collect()]


def words(rng, n):
    return " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))


def test_the_tree_tells_elements_of_one_path_apart(spark):
    """Between two headings the paragraph of each page is another, and so are their numbers before and after: only the gap says which."""
    rng = random.Random(3)
    own = [[words(rng, 9) for _ in range(2 + i % 4)] for i in range(9)]
    end = [[words(rng, 7) for _ in range(1 + (i * 5) % 3)] for i in range(9)]
    htmls = ["".join(f"<p>{x}</p>" for x in a) + "<h2>About the shop</h2><p>We deliver on Mondays</p><h3>More</h3>" + "".join(f"<p>{x}</p>" for x in b) for a, b in zip(own, end)]
    assert main(spark, htmls) == ["\n\n".join(a + b) for a, b in zip(own, end)]


def test_optional_parts_nest_and_crossed_ones_stay(spark):
    rng = random.Random(4)
    body = [words(rng, 12) for _ in range(12)]
    top, end = "<h4>Shop</h4>", "<h5>Imprint</h5>"
    promo = lambda i: "<div class='x'>Sale</div>" if i % 2 else ""
    assert main(spark, [f"{top}{promo(i)}<p>{b}</p>{end}" for i, b in enumerate(body)]) == body
    # a part that is now before the text's end mark and now after it has no place in the template
    loose = lambda i, at: "<div class='x'>Sale</div>" if i % 2 and (i % 4 == 1) == at else ""
    got = main(spark, [f"{top}{loose(i, True)}<p>{b}</p>{end}{loose(i, False)}" for i, b in enumerate(body)])
    assert got == [b if i % 2 == 0 else f"Sale\n\n{b}" if i % 4 == 1 else f"{b}\n\nSale" for i, b in enumerate(body)]


def test_a_moving_text_leaves_the_root_whole(spark):
    """It is no token of the class of all pages; by the gaps of that class it is two optional parts."""
    rng = random.Random(5)
    body = [words(rng, 12) for _ in range(8)]
    moved = "<h6>Quote of the day</h6>"
    got = main(spark, [f"{moved * (i % 2)}<h4>Shop</h4><p>{b}</p><h5>Imprint</h5>{moved * (1 - i % 2)}" for i, b in enumerate(body)])
    assert got == body


def test_trees_are_the_same_broadcast_or_joined(spark):
    rng = random.Random(6)
    htmls = [f"<h4>Shop {i % 3}</h4><p>{words(rng, 9)}</p><h5>Imprint</h5>" for i in range(30)]
    p = spark.createDataFrame([(i, f"http://h{i % 3}.org", h) for i, h in enumerate(htmls)], "page_id bigint, url string, html string")
    got, joined = (sorted(map(tuple, pages.main_text(p, n).collect())) for n in (1_000_000, 0))
    assert got == joined and all("Shop" not in r[2] and "Imprint" not in r[2] for r in got)


@pytest.mark.parametrize("blocks", [[], [1], [3, 1, 2], [1, 1, 2], [5, 4, 3, 2, 1], [0, 8, 4, 12, 2, 10, 6, 14]])
def test_the_longest_ordered_part(blocks):
    at = pages.in_order(list(enumerate(blocks)))
    every = [[i for i in range(len(blocks)) if m >> i & 1] for m in range(1 << len(blocks))]
    best = max(len(x) for x in every if all(blocks[a] <= blocks[b] for a, b in zip(x, x[1:])))
    assert len(at) == best and all(a < b and blocks[a] <= blocks[b] for a, b in zip(at, at[1:]))
