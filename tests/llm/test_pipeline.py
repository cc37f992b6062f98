"""Every stage of the pipeline on a small corpus, held against plain versions on that stage's own input."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline as C
from pageloom.llm import mixing, neardup, quality
from pageloom.llm.common import cut

KEY = "ghp_a8Fk2Lq9Zx7Vb4Nm1Tc6Yw3Rd5Hs0Jp2UeKq"
ITEM = "which of the following rivers flows through the old town before it meets the sea near the northern harbour"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Good prose and junk with labels, edited copies, a benchmark item in a text, a secret; nulls, empties, repeats."""
    rng = random.Random(8)
    vocab = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n)).capitalize() + "."
    junk = lambda n: " ".join("".join(rng.choice("#$%&*!0123456789") for _ in range(5)) for _ in range(n))
    rows = [(i, prose(rng.randint(60, 120)) if i % 3 else junk(40)) for i in range(240)]
    base = prose(120).split()
    for i in range(300, 312):
        rows.append((i, " ".join(w if rng.random() > 0.02 else "edited" for w in base)))
    rows += [(400, f"{prose(40)} {ITEM} {prose(40)}"), (401, f"{prose(60)} token = {KEY} {prose(30)}"), (402, f"{prose(50)} {rows[1][1]}")]
    rows += [(500 + i, rows[1][1]) for i in range(5)] + [(600, None), (601, ""), (None, prose(80)), (1, rows[1][1])]
    folder = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(i, t, "en", f"s{n % 4}" if n % 9 else None, len(t or "")) for n, (i, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(240)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, "another question that no document of this corpus has in it at all")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages_against_plain_versions(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    got = {}
    for name, stage in C.STAGES:
        new = cut(stage(spark, docs, corpus))
        got[name] = (docs, new)
        docs = new
    # quality: the rows that the classifier accepts, as they were
    before, after = got["quality"]
    scores = {r.doc_id: r.predicted for r in quality.classify(before, spark.read.parquet(f"{corpus}/labels.parquet")).collect()}
    assert rows_of(after) == rows_of(before.where(before.doc_id.isin([i for i, p in scores.items() if p == 1 and i is not None]) | before.doc_id.isNull() if scores.get(None) == 1 else before.doc_id.isin([i for i, p in scores.items() if p == 1])))
    kept = {r.doc_id for r in after.collect()}
    assert not any(i in kept for i in range(0, 240, 3)) and sum(i in kept for i in range(240) if i % 3) > 150
    # near duplicates: the least id of each class of aligned texts
    before, after = got["near_duplicates"]
    rows = [r for r in before.collect() if (r.text or "").split()]
    seqs = [np.array([hash(w) & 0xFFFFFFFF for w in r.text.split()], np.uint64) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and neardup.distance(seqs[i], seqs[j]) <= 0.2 + 1e-12:
                label = [label[j] if x == label[i] else x for x in label]
    last = 1 << 62
    least = {x: min((last if r.doc_id is None else r.doc_id) for r, y in zip(rows, label) if y == x) for x in set(label)}
    assert sorted((last if r.doc_id is None else r.doc_id) for r in after.collect() if (r.text or "").split()) == sorted(least.values())
    assert len([r for r in after.collect() if r.doc_id is not None and 300 <= r.doc_id < 312]) == 1
    # decontamination: what holds an item goes, all else stays
    before, after = got["decontamination"]
    assert rows_of(after) == rows_of(before.where("text is null or not contains(text, 'flows through the old town')"))
    # secrets: all rows stay, the token goes
    before, after = got["secrets"]
    assert sorted(map(repr, (r.doc_id for r in before.collect()))) == sorted(map(repr, (r.doc_id for r in after.collect())))
    texts = {r.doc_id: r.text for r in after.collect()}
    assert all(KEY not in (t or "") for t in texts.values())
    changed = [r.doc_id for r in before.collect() if texts[r.doc_id] != r.text]
    assert changed == ([401] if 401 in texts else [])
    assert all(s.columns == columns for s in (got[n][1] for n, _ in C.STAGES[:-1]))
    # mixing: whole copies within reach of each source's target
    before, after = got["mixing"]
    plain = {}
    for r in before.collect():
        plain[r.source] = plain.get(r.source, 0) + len((r.text or "").split())
    taken = {}
    for r in after.collect():
        assert r.taken == r.copies * r.size and r.copies <= 3 and r.source_size == plain[r.source]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    targets = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(plain.items()), "source string, source_size bigint")).collect()}
    assert sum(targets.values()) == pytest.approx(sum(plain.values()))
    assert all(abs(taken.get(s, 0) - t) < 130 for s, t in targets.items())


def test_run_applies_every_stage_and_agrees_with_itself(spark, corpus):
    once = rows_of(C.run(spark, corpus))
    assert once and once == rows_of(C.run(spark, corpus))
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "mixing"]
