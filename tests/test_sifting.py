"""Sifting of queries before the name search: nothing that scores well is lost, and little else is ranked."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from tallyloom.operators import names as N
from tallyloom.operators import serving as V
from tests.test_names import score

PRODUCT = "product_key string, normalized_product_name string, product_id_norm string, search_aliases_norm array<string>"


def words(draw, letters, longest):
    return " ".join("".join(draw.choice(letters) for _ in range(draw.randint(1, longest))) for _ in range(draw.randint(1, 2)))


def test_letters_and_subsequences_of_many_texts():
    draw = random.Random(3)
    one, two = ([words(draw, "AB12Ä", 9) for _ in range(300)] for _ in range(2))
    assert (N.letters_each(one) == np.array([N.letters(t) for t in one])).all() and N.letters_each([]).shape == (0, 38)

    def longest(a, b):
        best = [0] * (len(b) + 1)
        for x in a:
            before, best = best, [0]
            for j, y in enumerate(b):
                best.append(before[j] + 1 if x == y else max(before[j + 1], best[j]))
        return best[-1]

    got = N.common_subsequence(one, two).tolist()
    assert got == [longest(a, b) for a, b in zip(one, two, strict=True)]
    assert all(2 * n / (len(a) + len(b)) >= SequenceMatcher(None, a, b).ratio() - 1e-12 for n, a, b in zip(got, one, two, strict=True))


@pytest.mark.parametrize("cells", [N.CELLS, 50])
@pytest.mark.parametrize("letters", ["0123456789", "ABC1 ", "AB" * 3 + "Ä"])
def test_queries_that_reach_a_score(monkeypatch, cells, letters):
    monkeypatch.setattr(N, "CELLS", cells)
    draw = random.Random(len(letters))
    make = lambda n: list(filter(None, (" ".join(words(draw, letters, 6).split()) for _ in range(n))))
    texts, queries = [*make(70), "A" * 300], [*make(200), "A" * 299 + "B"]
    block = N.Block(texts)
    for least in (0.2, 0.3, 0.45, V.MATCH, 0.65, 0.74, 0.85, 0.88, 0.9, 1.0):
        want = [k for k, q in enumerate(queries) if score(q, texts) >= least]
        assert N.reaching_of(queries, block, least) == want, least
    assert N.reaching_of([], block, 0.5) == [] == N.reaching_of(queries, N.Block([]), 0.5)


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame([("p1", "RED LAMP", "4711021", ["RED LAMP", "4711021", "8100345"]), ("p2", "BLUE CHAIR 7", "9000017", ["9000017"])], PRODUCT)


@pytest.mark.parametrize("block", [N.BLOCK, 1])
def test_queries_in_blocks(spark, known, block):
    asked = V.asked_names(spark.createDataFrame([(q,) for q in ("red lampe", "4711022", "1234567", "9000017 9", "qq", "", "blue chair")], "query string"))
    assert {r["query"] for r in N.reaching(asked, known, V.MATCH, block=block).collect()} == {"red lampe", "4711022", "9000017 9", "blue chair"}


def test_only_queries_that_match_are_ranked(spark, known, monkeypatch):
    codes = [str(1_000_000 + 37 * k) for k in range(400)]
    given, real = [], N.ranked
    monkeypatch.setattr(N, "ranked", lambda queries, *a, **b: given.append(queries.count()) or real(queries, *a, **b))
    got = {r["query"]: r for r in V.resolve(spark.createDataFrame([(q,) for q in [*codes, "red lampe"]], "query string"), known).collect()}
    names = [[n, i, *a] for _, n, i, a in known.collect()]
    want = {c for c in codes if max(score(c, own) for own in names) >= V.MATCH}
    assert given == [len(want) + 1] and len(got) == 401
    assert {c for c in codes if got[c].status != "not_found"} == want and got["red lampe"]["keys"] == ["p1"]


def test_answers_rank_what_no_other_step_takes(spark, known, monkeypatch):
    listed = spark.createDataFrame([("OLD CLOCK", "OLD CLOCK", "", [], "dropped")], "product_family_name string, normalized_product_name string, product_id_norm string, search_aliases_norm array<string>, reason_type string")
    asked = [*(str(k) for k in range(7_000_000, 7_000_300)), "4711021", "the old clock", "red lampe", "blue chairs"]
    given, real = [], N.ranked
    monkeypatch.setattr(N, "ranked", lambda queries, *a, **b: given.extend(r["query"] for r in queries.collect()) or real(queries, *a, **b))
    got = {r["query"]: (r.status, r["keys"], r.nearest) for r in V.answer(spark.createDataFrame([(q,) for q in asked], "query string"), known, listed).collect()}
    names = [[n, i, *a] for _, n, i, a in known.collect()]
    codes = {c for c in asked[:300] if max(score(c, own) for own in names) >= V.MATCH}
    assert set(given) == {"blue chairs", "red lampe"} | codes and len(codes) == 1 and len(got) == len(asked)
    assert got["4711021"] == ("resolved", ["p1"], []) and got["the old clock"] == ("unavailable", ["OLD CLOCK"], []) and got["blue chairs"][1] == ["p2"]
    assert got["7000000"] == ("not_found", [], [])


def test_each_pair_of_block_and_part_is_a_task(spark):
    many = spark.createDataFrame([(f"k{k}", f"NAME {k}", str(k), []) for k in range(40)], PRODUCT)
    asked = V.asked_names(spark.createDataFrame([(f"name {k}x",) for k in range(40)], "query string"))
    seen, real = [], N._met
    try:
        N._met = lambda *a: seen.append(real(*a)) or seen[-1]
        N.ranked(asked, many, block=20, part=10)
    finally:
        N._met = real
    assert seen[0].rdd.getNumPartitions() == 8
