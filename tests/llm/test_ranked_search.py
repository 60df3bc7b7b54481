"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyloom.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, top=R.TOP):
    bags = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    out = []
    for name, text in items:
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(w in b for _, b in bags) + 1))) for w in asked}
        scored = []
        for (d, b), size in zip(bags, sizes, strict=True):
            m = 75 + (25 * size * n) // total if total else 0
            score = sum(c * weight[w] * ((1_000_000_000 * b[w]) // (1000 * b[w] + 12 * m)) for w, c in asked.items() if b[w])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(name, k + 1, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def got(spark, docs, items, **more):
    left = spark.createDataFrame([(d, t, 0, "x") for d, t in docs], "doc_id long, text string, m int, score string").repartition(3)
    right = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in R.search(left, right, **more).select("item_id", "rank", "doc_id", "score").collect()), key=str)


ITEMS = [(1, "The quick brown FOX the fox"), (2, None), (3, "... !!"), (4, "hello world 2024"), (None, "word1 tail"), (4, "naïve café 東京都"), (5, "unheard of"), (6, "a b c d e a")]


@pytest.fixture(scope="module")
def docs(edge_texts):
    draw = random.Random(5)
    some = [(k, " ".join(draw.choices("a b c d e the fox quick, Brown hello-world 2024! other".split(), k=draw.randint(1, 12)))) for k in range(20, 160)]
    return [*edge_texts, *some, *[(d, "the fox; the fox a") for d in range(300, 360)], (310, "the fox; the fox a"), (None, "The fox the fox A")]


@pytest.mark.parametrize("block_terms", [R.BLOCK_TERMS, 40])
def test_search_against_brute_force(spark, docs, block_terms):
    assert got(spark, docs, ITEMS, block_terms=block_terms) == brute(docs, ITEMS)


def test_classes_larger_than_top_and_slices(spark, docs, monkeypatch):
    assert got(spark, docs, ITEMS, top=3) == brute(docs, ITEMS, 3)
    monkeypatch.setattr(R, "SLICE", 10)
    assert got(spark, docs, ITEMS[:1]) == brute(docs, ITEMS[:1])


def test_empty_tables(spark, docs):
    assert got(spark, [], ITEMS) == [] == got(spark, docs, []) == got(spark, [(1, None), (2, "")], ITEMS) == got(spark, docs, [(1, None)])


def test_best_keeps_ties_by_least_document():
    draw, best, every = np.random.default_rng(3), R.Best(4, 5), []
    for k in range(30):
        rows = np.stack([draw.integers(0, 4, 50), draw.integers(0, 9, 50), draw.integers(0, 40, 50), k * 50 + np.arange(50)])
        best.add(*rows)
        every += rows.T.tolist()
    want = [r for i in range(4) for r in sorted((r for r in every if r[0] == i and r[1] > 0), key=lambda r: (-r[1], r[2], r[3]))[:5]]
    assert best.held.tolist() == want
