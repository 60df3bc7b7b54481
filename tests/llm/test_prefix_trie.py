"""The prefix trie against enumeration of every prefix, in blocks of all sizes."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tallyloom.llm import prefix_trie as P


def brute(rows):
    """rows: (conv_id, turn, role, text), no ties of turns in a conversation but equal rows."""
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if c is not None else 0
        seqs[c] = own.get(c - int(math.fmod(c, 100)) if c is not None else c, [])[:h] + turns[h:] if h else turns
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    order = lambda cs: sorted(cs, key=lambda c: (c is None, c or 0))
    least = {k: order(v)[0] for k, v in members.items()}
    kids = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for k in members:
        kids[k[:-1]] += len(k) > 0
    for k, v in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(v) - 1) * len(k[-1][1]) if k else 0
    out = []
    for k, v in members.items():
        ends = ",".join("null" if c is None else str(c) for c in order(c for c in v if len(seqs[c]) == len(k)))
        out.append((least[k], len(k), least[k[:-1]] if k else None, len(v), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, pos string, n_convs string"


def got(spark, rows, block_turns):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in P.trie(P.rebuilt(P.numbered(df)), block_turns).select(*COLUMNS).collect()), key=str)


@pytest.fixture(scope="module")
def talks():
    """Shared beginnings, copies, prefixes of others, null and empty values, one hot conversation of many turns, one without a beginning to share."""
    draw = random.Random(11)
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(205, 215), -3, None]:
        for t in range(draw.choice([1, 2, 3, 3, 8])):
            rows.append((c, t if t else draw.choice([0, None]), draw.choice(["user", None]), draw.choice(["", "hi", "hello there 🙂", None])))
    rows += [(500, t, "user", "same" if t < 90 else str(t)) for t in range(150)] + [(507, t, "user", "same") for t in range(150)]
    rows += [(600, 5, "user", "twice"), (600, 5, "user", "twice")]
    return rows


@pytest.mark.parametrize("block_turns", [40, P.BLOCK_TURNS])
def test_trie_against_enumeration(spark, talks, block_turns):
    assert got(spark, talks, block_turns) == brute(talks)


def test_copies_cross_blocks(spark):
    """A group of equal conversations, larger than a block: its node and its ends are made of parts."""
    rows = [(1000 + k * 100, t, "user", f"t{t}") for k in range(60) for t in range(3)] + [(1000 + k * 100, 3, "user", f"own{k}") for k in range(0, 60, 7)]
    assert got(spark, rows, 24) == brute(rows)


def test_empty_table_and_turnless(spark):
    assert got(spark, [], 10) == []
    # conversation 7 has one turn, takes more than that from a beginning that isn't there: no turns are left
    c = next(k for k in range(1, 100) if zlib.crc32(str(k).encode()) % 6 >= 1)
    assert got(spark, [(c, 0, "user", "gone")], 10) == brute([(c, 0, "user", "gone")]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_positions_do_not_depend_on_buckets(spark):
    rows = [(1, t, "u", str(t)) for t in (-5000, -1, 0, 3, 1023, 1024, 99_999, 1 << 40)] + [(1, None, "u", "first")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    assert [r.chars for r in P.numbered(df).orderBy("pos").collect()] == [5, 5, 2, 1, 1, 4, 4, 5, 13]


def test_minima():
    draw = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 100):
        values = draw.integers(0, 5, n)
        own = P.Minima(values)
        for low in range(n):
            for high in range(low, n):
                assert own.between(np.array([low]), np.array([high]))[0] == values[low : high + 1].min()
            for least in range(6):
                right = next((k for k in range(n - low) if values[low + k] < least), n - low)
                left = next((k for k in range(low) if values[low - 1 - k] < least), low)
                assert own.reach(np.array([low]), np.array([least]), True)[0] == right
                assert own.reach(np.array([low]), np.array([least]), False)[0] == left
