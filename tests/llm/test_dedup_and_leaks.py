"""Decontamination and SimHash near-dedup against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tallyloom.llm import decontaminate as D
from tallyloom.llm import shingles as N
from tallyloom.llm import simhash as S

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute_leaks(text, items, width=10):
    found, hit, own = set(), set(), words(text)
    for key, item in items:
        w = words(item)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            for j in range(len(own) - n + 1):
                if own[j : j + n] == w[k : k + n]:
                    found.add("null" if key is None else str(key))
                    hit.update(range(j, j + n))
    return len(own), len(hit), sorted(found)


ITEMS = [(1, "the quick brown fox jumps over the lazy dog and then it sleeps a while"), (2, "hello world"), (3, None), (4, "... !!"), (None, "one two three"), (11, "Übergrößenträger naïve café"), (2, "no id here"), (12, "b b b b b b b b b b b")]


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


TEXTS = [
    (1, "So THE quick, brown fox: jumps over the lazy dog and then it sleeps a while. Hello   World hello world"),
    (2, None), (3, ""), (4, "b " * 300), (5, "the quick brown fox jumps over the lazy cat and then it sleeps a while"), (None, "No id here? One-two three!"), (6, "ÜBERGRÖßENTRÄGER übergrößenträger naïve café"),
    (7, "the quick brown fox jumps over the lazy dog and the quick brown fox jumps over the lazy dog and then"), (7, "hello"), (7, "hello world"),
]


@pytest.mark.parametrize("block_windows", [D.BLOCK_WINDOWS, 4])
def test_leaks_against_brute_force(spark, benchmark, block_windows, monkeypatch):
    monkeypatch.setattr(D, "SLICE", min(D.SLICE, block_windows))
    docs = spark.createDataFrame([(k, d, t, "x") for k, (d, t) in enumerate(TEXTS)], "row long, doc_id long, text string, items string")
    out = D.decontaminate(docs, benchmark, block_windows=block_windows).withColumns({"hit": D.n_hit(), "clean": D.without_spans()}).collect()
    for r in out:
        n, hit, names = brute_leaks(r.text, ITEMS)
        assert (r.n_words, r.hit, sorted(r["items"])) == (n, hit, names)
        if r.text is not None:
            # spans are places in code points
            assert sum(len(words(r.text[s.start : s.end])) for s in r.spans) == hit
            assert len(words(r.clean)) <= n - hit + len(r.spans)


def test_leaks_of_edge_cases(edge_docs, no_docs, benchmark, spark):
    out = D.decontaminate(edge_docs, benchmark)
    assert out.count() == edge_docs.count() and out.columns.count("spans") == 1
    assert D.decontaminate(no_docs, benchmark).count() == 0
    none = D.decontaminate(edge_docs, spark.createDataFrame([], benchmark.schema))
    assert {len(r.spans) for r in none.collect()} == {0}


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=30), min_size=1, max_size=5), st.lists(st.lists(st.integers(1, 5), min_size=1, max_size=5), min_size=1, max_size=6))
def test_fm_index_finds_every_occurrence(runs, patterns):
    text = np.array([s for run in runs for s in [*run, 0]], np.int64)
    index = D.FmIndex(text, 6)
    for pattern in patterns:
        low, high = index.search(np.array([pattern]))
        got = sorted(index.locate(np.arange(low[0], high[0])).tolist())
        assert got == [k for k in range(len(text)) if text[k : k + len(pattern)].tolist() == pattern]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=200), st.integers(0, 12))
def test_wavelet_ranks(symbols, symbol):
    text = np.array(symbols)
    wavelet = D.Wavelet(text, 13)
    at = np.arange(len(text) + 1)
    assert wavelet.rank(np.full(len(at), symbol), at).tolist() == np.concatenate([[0], np.cumsum(text == symbol)]).tolist()
    assert wavelet.access(at[:-1])[0].tolist() == symbols


def brute_print(text):
    own = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    hashes = [xxhash.xxh64_intdigest(b" ".join(own[k : k + 3]), 42) for k in range(max(1, len(own) - 2))] if own else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, docs, radius=2):
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for k, d in enumerate(docs):
        if d is not None:
            least[find(k)].append(d)
    return [min(least[find(k)], default=None) for k in range(len(prints))]


def test_fingerprints(edge_texts):
    for _, text in edge_texts:
        assert S.fingerprint(text) == brute_print(text)


@pytest.fixture(scope="module")
def near(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{rng.integers(400)}" for _ in range(300)) for _ in range(6)]
    texts = [(k, t) for k, t in enumerate(base)]
    for k in range(60):
        own = base[k % 3].split()
        for _ in range(k % 4):
            own[int(rng.integers(300))] = f"new{k}"
        texts.append((100 + k, " ".join(own)))
    texts += [(None, base[5]), (500, None), (501, ""), (502, " \n"), (3, base[3]), (3, base[4])]
    return texts


def test_components_against_brute_force(spark, near):
    got = Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in S.near_duplicates(spark.createDataFrame(near, "doc_id long, text string")).collect())
    prints = [brute_print(t) for _, t in near]
    assert got == Counter(zip([d for d, _ in near], prints, brute_components(prints, [d for d, _ in near]), strict=True))


def test_keep_one(spark, near):
    docs = spark.createDataFrame([(d, t, "x") for d, t in near], "doc_id long, text string, fp string")
    kept = S.keep_one(docs)
    prints = [brute_print(t) for _, t in near]
    classes = brute_components(prints, [d for d, _ in near])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes)) and kept.columns == docs.columns


def test_many_trees_in_a_shard(spark):
    rng = np.random.default_rng(5)
    centers = rng.integers(0, 2**62, 4)
    prints = {int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in centers for a in range(0, 60, 3) for b in range(1, 60, 7)}
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    for nodes in (1 << 15, 7):
        moved = {r.fp: r.root for r in S.components(S.links(df, tree_nodes=nodes)).collect()}
        got = defaultdict(set)
        for p in prints:
            got[moved.get(p, p)].add(p)
        order = sorted(prints)
        want = defaultdict(set)
        for p, c in zip(order, brute_components(order, order), strict=True):
            want[c].add(p)
        assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in want.values()}


def test_empty_table(no_docs):
    assert S.near_duplicates(no_docs).count() == 0 and S.keep_one(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=1, max_size=40), st.lists(st.integers(0, 255), min_size=1, max_size=10))
def test_bk_tree_search(nodes, queries):
    fps, asks = np.array(nodes, np.uint64), np.array(queries, np.uint64)
    tree = np.zeros(len(fps), int)
    found = {(int(asks[q]), int(fps[n])) for a, b in S.search(fps, tree, asks, np.zeros(len(asks), int)) for q, n in zip(a, b, strict=True)}
    assert found == {(q, n) for q in queries for n in nodes if bin(q ^ n).count("1") <= 2}


def brute_sets(texts, shingle=5):
    found = [(t or "").lower().split() for t in texts]
    return [{" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set() for w in found]


def brute_near(texts, docs, least=0.8):
    """The documents that stay: of each component over pairs of similar sets, the smallest."""
    sets = brute_sets(texts)
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) > 0:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return sorted(min(d for d, r in zip(docs, root, strict=True) if r == c) for c in set(root))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), max_size=12), min_size=1, max_size=14))
def test_prefix_filter_links_all_similar_sets(given_sets):
    sets = [np.array(sorted(s), np.uint64) for s in given_sets]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if len(given_sets[i] & given_sets[j]) >= 0.6 * len(given_sets[i] | given_sets[j]) > 0:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert N.linked(sets, 0.6).tolist() == root


@pytest.mark.parametrize("block", [N.BLOCK_SHINGLES, 3000])
def test_planted_near_copies_are_dropped(spark, monkeypatch, block):
    """Copies with one, two or four of 200 words changed (0.95 to 0.82), and some below the threshold that stay."""
    monkeypatch.setattr(N.similar, "__defaults__", (*N.similar.__defaults__[:-1], block))
    rng = np.random.default_rng(9)
    texts = []
    family = [f"f{k}" for k in range(200)]  # a chain of near copies, all in one candidate component of several blocks
    for k in range(150):
        family[int(rng.integers(200))] = f"g{k}"
        texts.append((20_000 + k, " ".join(family)))
    for k in range(120):
        own = [f"w{rng.integers(5000)}" for _ in range(200)]
        texts.append((k, " ".join(own)))
        for n, changed in enumerate((1, 2, 4, 12)):
            copy = list(own)
            for at in rng.choice(200, changed, replace=False):
                copy[int(at)] = f"new{rng.integers(10**9)}"
            texts.append((1000 * (n + 1) + k, " ".join(copy)))
    texts += [(9000, None), (9001, ""), (9002, " \n"), (9003, "one two"), (9004, "One  two"), (9005, "one"), (9005, "one"), (9006, "x y z " * 900)]
    kept = N.keep_one(spark.createDataFrame([(d, t, "x") for d, t in texts], "doc_id long, text string, fp string"))
    got = sorted(r.doc_id for r in kept.collect())
    assert kept.columns == ["doc_id", "text", "fp"] and got == brute_near([t for _, t in texts], [d for d, _ in texts])
    assert not any(1000 <= d < 3000 for d in got) and sum(d // 1000 == 4 for d in got) == 120


def grouped(pairs):
    root = {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in pairs:
        root[find(a)] = find(b)
    groups = defaultdict(set)
    for k in list(root):
        groups[find(k)].add(k)
    return {frozenset(g) for g in groups.values()}


@pytest.fixture
def many_tasks(spark):
    """Sixteen tasks after each shuffle, of batches of 50 rows."""
    held = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "50"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("members", [400, 800])
def test_star_steps_get_about_a_link_for_each_member_of_a_group(spark, many_tasks, monkeypatch, members):
    """Of a group whose members have 30 links each, as large groups of near copies have by their draws."""
    rows, own = [], S.materialize

    def counted(df, name):
        out = own(df, name)
        rows.append((name, out.count()))
        return out

    monkeypatch.setattr(S, "materialize", counted)
    rng = np.random.default_rng(13)
    links = [(1000 + k, int(h)) for k in range(members) for h in rng.choice(40, 30, replace=False)]
    got = S.components(spark.createDataFrame(links, "fp long, to long")).collect()
    assert sorted((r.fp, r.root) for r in got) == [(k, 0) for k in [*range(1, 40), *range(1000, 1000 + members)]]
    assert rows and all(name == "links" and n <= 1.2 * (members + 40) for name, n in rows), rows


@pytest.mark.parametrize("frontier", [1 << 20, 20])
def test_components_of_random_links(spark, many_tasks, monkeypatch, frontier):
    """Chains, stars with the greatest name in the middle, thickets, loops and repeated links, also where a task's links don't fit its frontier."""
    monkeypatch.setattr(S, "FRONTIER", frontier)
    rng = np.random.default_rng(17)
    names = [int(n) for n in rng.integers(-(2**63), 2**63 - 1, 700)]
    hub = max(names[:200])
    pairs = list(zip(names[200:300], names[201:301], strict=True)) + [(hub, n) for n in names[:200] if n != hub]
    pairs += [(names[a], names[b]) for a, b in rng.integers(310, 400, (1500, 2))] + [(names[a], names[b]) for a, b in rng.integers(400, 700, (160, 2))] + [(names[k], names[k]) for k in (305, 405)]
    pairs += pairs[::3]
    got = S.components(spark.createDataFrame(pairs, "fp long, to long").repartition(5)).collect()
    want = {n: min(group) for group in grouped(p for p in pairs if p[0] != p[1]) for n in group}
    assert sorted((r.fp, r.root) for r in got) == sorted((n, root) for n, root in want.items() if n != root)
    assert S.components(spark.createDataFrame([], "fp long, to long")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(1, 4), st.sampled_from([5, 20, 74]))
def test_tree_links_of_wide_fingerprints(seed, n, shards, within):
    """Links over BK-trees of 256-bit fingerprints span what all pairs within a shard link."""
    rng = np.random.default_rng(seed)
    centers = rng.integers(0, 1 << 64, (3, 4), np.uint64)
    noise = np.packbits(rng.random((n, 256)) < rng.choice([0.01, 0.1, 0.2], (n, 1)), axis=1).view("<u8")
    fps, shard, names = centers[rng.integers(3, size=n)] ^ noise, np.sort(rng.integers(shards, size=n)), rng.permutation(n)
    got = N.near_links(shard, names, fps, within)
    near = [(int(names[i]), int(names[j])) for i in range(n) for j in range(i) if shard[i] == shard[j] and int(np.bitwise_count(fps[i] ^ fps[j]).sum()) <= within]
    assert grouped(zip(*map(np.ndarray.tolist, got), strict=True)) == grouped(near)


@pytest.mark.parametrize("tree_nodes", [N.TREE_NODES, 3])
def test_near_dedup_of_the_pipeline_is_by_simhash_trees(spark, monkeypatch, tree_nodes):
    """Candidates are what SimHash shards and their trees propose; all of 600 pairs of similarity 0.8 to 0.83, of short texts also, are among them."""
    rng = np.random.default_rng(11)
    asked, own = [], N.candidates
    monkeypatch.setattr(N, "candidates", lambda prints, least=N.LEAST: asked.append(own(prints, least, tree_nodes)) or asked[-1])
    texts = []
    for k in range(600):
        n = (8, 9, 12, 40, 200)[k % 5]
        own_words = [f"w{rng.integers(10**6)}" for _ in range(n)]
        copy = own_words[:-1] if n < 10 else own_words[: -max(1, (n - 4) // 6)]
        sets = brute_sets([" ".join(own_words), " ".join(copy)])
        texts += [(2 * k, " ".join(own_words)), (2 * k + 1, " ".join(copy))]
        assert len(sets[1]) >= 0.8 * len(sets[0]) or n == 8
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == brute_near([t for _, t in texts], [d for d, _ in texts]) and len(got) == 720
    assert len(asked) == 1 and asked[0].columns == ["fp", "to"] and asked[0].count() >= 480


def test_near_copies_of_edge_cases(edge_docs, no_docs):
    assert N.keep_one(no_docs).count() == 0 and N.keep_one(edge_docs).columns == edge_docs.columns
