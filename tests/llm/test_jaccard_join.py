"""The Jaccard join against all pairs; its steps against their definitions."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import jaccard_join as J

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, k=3):
    w = WORD.findall((text or "").encode().lower())
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs, percent=90):
    sets = [shingles(t) for _, t in docs]
    to = list(range(len(docs)))

    def root(k):
        while to[k] != k:
            k = to[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                to[root(a)] = root(b)
    least = {}
    for k, (d, _) in enumerate(docs):
        r = root(k)
        least[r] = d if least.get(r) is None else min(least[r], d) if d is not None else least[r]
    return sorted(((d, len(s), least[root(k)]) for k, ((d, _), s) in enumerate(zip(docs, sets, strict=True))), key=str)


def got(spark, docs, **more):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n int, component_id string").repartition(3)
    return sorted((tuple(r) for r in J.similar(df, counters=1 << 16, **more).select("doc_id", "n_shingles", "component_id").collect()), key=str)


@pytest.fixture(scope="module")
def docs(edge_texts):
    """Stars (copies near their base only), chains, pairs about the threshold, common passages, few-word texts, equal texts."""
    draw = random.Random(13)
    words = lambda n: [draw.choice("abcdefgh") + draw.choice("abcdefgh") + draw.choice(["", "é", "x"]) for _ in range(n)]
    out, d = list(edge_texts), 100
    license_ = words(40)
    for k in range(6):
        base = words(draw.randint(60, 90)) + (license_ if k % 2 else [])
        out.append((d + 50, " ".join(base)))
        for _ in range(12):
            own = list(base)
            for _ in range(draw.choice([1, 1, 1, 2, 3])):
                own[draw.randrange(len(own))] = "zz" + str(draw.random())
            out.append((d, " ".join(own)))
            d += 1
        for _ in range(6):  # a chain: each one near the last
            base = [*base[:-1], "q" + str(draw.random())] if draw.random() < 0.5 else [*base, "r" + str(draw.random())]
            out.append((d, "\t".join(base).upper()))
            d += 1
        d += 100
    out += [(2000 + k, " ".join(license_ + words(2))) for k in range(30)]
    out += [(3000 + k, t) for k, t in enumerate(["one", "ONE", "one two", "one two three", "one two three ", "", None, "two one"])]
    return out


@pytest.mark.parametrize("more", [{}, {"meeting": 2, "block_shingles": 300}, {"meeting": 1, "block_shingles": 1500}])
def test_join_against_all_pairs(spark, docs, more):
    assert got(spark, docs, **more) == brute(docs)


def test_other_thresholds(spark, docs):
    assert got(spark, docs, percent=60, block_shingles=2000) == brute(docs, 60)
    assert got(spark, docs[:60], percent=100) == brute(docs[:60], 100)


def test_empty_table(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None), (2, ""), (None, " \n")]) == [(1, 0, 1), (2, 0, 2), (None, 0, None)]


def test_a_third_of_all_rows_are_copies(spark):
    docs = [(k, " ".join(f"w{k % 7}{j}" for j in range(30))) for k in range(40)] + [(500 + k, "the same text as all others of this group") for k in range(60)] + [(500, "the same text as all others of this group")] * 5
    assert got(spark, docs, meeting=4) == brute(docs)


def test_sets_are_those_of_whole_words():
    texts = ["à  la\x1ccarte\x0bnoël", None, "", "A b\nC d", " x ", "x", "東京 à\x85b c", "a b c a b c a b c"]
    sets = J.shingle_sets(pa.array(texts))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert len({tuple(s) for s in sets}) == len({frozenset(shingles(t)) for t in texts})
    assert all((np.diff(s.astype(object)) > 0).all() for s in sets)
    assert [s.tolist() for s in J.shingle_sets(pa.array(texts).slice(3, 2))] == [s.tolist() for s in sets[3:5]]


def test_prefixes_share_as_many_tokens_as_asked():
    """Whatever l two sets have: similar ones share the smaller number among their prefixes."""
    draw = np.random.default_rng(2)
    for _ in range(400):
        n = int(draw.integers(1, 60))
        a = draw.choice(1000, n, replace=False)
        b = np.unique(np.concatenate([draw.permutation(a)[: int(draw.integers(0, n + 1))], draw.choice(1000, int(draw.integers(1, 4)))]))
        a, b = np.sort(a), np.sort(b)
        both = len(np.intersect1d(a, b))
        if 100 * both < 90 * (len(a) + len(b) - both):
            continue
        for la in range(1, J.overlap(len(a), 90) + 1):
            for lb in range(1, J.overlap(len(b), 90) + 1):
                pa_, pb = a[: len(a) - J.overlap(len(a), 90) + la], b[: len(b) - J.overlap(len(b), 90) + lb]
                assert len(np.intersect1d(pa_, pb)) >= min(la, lb)


def test_matches_grow_with_the_estimated_cost():
    rare, common = np.zeros(500), np.full(500, 400.0)
    assert J.matches(rare, 500, 90) == 1 < J.matches(common, 500, 90) <= J.MOST
    assert J.matches(np.zeros(1), 1, 90) == 1


def test_counts_are_never_less_than_the_truth(spark):
    texts = [f"a b c d{k % 3}" for k in range(50)] + [None, ""]
    counts = J.frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4), counters=1 << 16)
    shift = np.uint64(48)
    for own, times in ((J.shingle_sets(pa.array(["a b c"]))[0], 50), (J.shingle_sets(pa.array(["b c d1"]))[0], 17)):
        assert J._COUNT[counts[(own >> shift).astype(int)]][0] == times
    codes = J.coded(np.array([0, 1, 127, 128, 1000, 10**6, 10**12]))
    assert codes.tolist()[:4] == [0, 1, 127, 128] and (np.diff(codes.astype(int)) > 0).all()
    assert np.allclose(J._COUNT[codes[4:6]], [1000, 10**6], rtol=0.1)
