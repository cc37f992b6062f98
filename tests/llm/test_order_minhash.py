"""Order MinHash fingerprints against the definition, k-mer by k-mer, and the order of documents."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from pageloom.llm import fingerprints as P
from pageloom.llm.common import SEED, mix, range_hashes

ALL = (1 << 64) - 1


def mixed(x: int) -> int:
    return int(mix(np.array([x & ALL], np.uint64))[0])


def plain(text: str) -> list[int]:
    """Every k-mer with its occurrence number, the two of least rank in each sketch in text order, hashed as a pair."""
    points = P.code_points(text)
    pieces = [points[i : i + P.K] for i in range(max(1, len(points) - P.K + 1))] if len(points) else []
    seen: Counter = Counter()
    sketches: dict[int, list[tuple[int, int, int]]] = {}
    for i, piece in enumerate(pieces):
        h = int(range_hashes(piece, np.array([0]), np.array([len(piece)]))[0])
        rank = mixed(h + seen[h] * SEED)
        seen[h] += 1
        sketches.setdefault(rank >> (64 - P.SKETCHES.bit_length() + 1), []).append((rank, i, h))
    out = []
    for s in range(P.SKETCHES):
        least = sorted(sorted(sketches.get(s, []))[: P.TAKE], key=lambda x: x[1])
        out.append(max(mixed(least[0][2] * 3 + least[-1][2] * 5 + s) >> 32, 1) if least else 0)
    return out


@pytest.mark.parametrize("length", [0, 1, 8, 9, 10, 60, 700, 9000])
def test_signatures_follow_the_definition(length):
    rng = random.Random(length)
    for alphabet in ("a", "ab", "abcdefg é\U0001f600"):
        text = "".join(rng.choice(alphabet) for _ in range(length))
        assert P.signature(P.code_points(text)).tolist() == plain(text)


def test_near_texts_are_alike_and_others_are_not():
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefghij ") for _ in range(4000))
    a = P.signature(P.code_points(base))
    few = P.signature(P.code_points(base[:1000] + "changed" + base[1010:]))
    swapped = P.signature(P.code_points(base[2000:] + base[:2000]))
    other = P.signature(P.code_points("".join(rng.choice("abcdefghij ") for _ in range(4000))))
    assert P.likeness(a, a) == 1.0 and P.likeness(a, few) > 0.9 > 0.8 > P.likeness(a, swapped) and P.likeness(a, other) < 0.2


@pytest.mark.parametrize("spread", [1, 1 << 40])
def test_each_document_meets_the_next_one(spark, spread):
    rng = random.Random(spread)
    ids = rng.sample(range(-500, 500), 300)
    rows = [(i * spread, f"text of {i} " * rng.randint(1, 9)) for i in ids] + [(None, "without an id")]
    got = {r.doc_id: r for r in P.fingerprints(spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, block int")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    for (i, text), (_, other) in zip(order, [*order[1:], order[0]]):
        assert got[i].near_next == P.likeness(P.signature(P.code_points(text)), P.signature(P.code_points(other)))
        assert got[i].near_edited == P.likeness(P.signature(P.code_points(text)), P.signature(P.code_points(P.edited(text, other))))
    assert P.fingerprints(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
