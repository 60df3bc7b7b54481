"""Near copies by the Jaccard similarity of their word shingles: SimHash fingerprints in BK-trees find candidates, an exact test decides.

A text is the set of XXH64 hashes of its runs of SHINGLE words. Sets of a similarity of at least LEAST are linked; components over all
links are near copies of each other. Equal sets are first reduced to one; sets so small that one more shingle is too much (below 4) are similar to
no other. A set's fingerprint is the majority of its hashes, bit by bit, over WORDS words of 64 bits: at a similarity of 0.8 a bit differs
with probability 0.152, between unlike sets with 0.5. That is too many for bands that leave no pair out, so shards are drawn: the values
of some bits (SHARD_BITS; one more for four times the sets, so that neither the shards of a set nor its pairs in them become many), for so many choices of bits that a pair at LEAST meets in none of them
with probability LOST (0.00007); sets of at most SMALL shingles, whose bits differ more often, are in more of them. Each shard gets a BK-tree
over the first TREE_WORDS words; its radius is the distance expected at LEAST and six deviations (59 of 192 bits). Trees reach their shard's
queries by a shuffle, as in simhash.py, whose trees these are. What lies within the radius of a tree's first member is linked to that and
needs no search for its like; it asks a tree of the others. At this radius a tree leaves out other groups of near copies but few single nodes,
so small shards, not trees, keep the number of compared pairs low. A shard of more than TREE_NODES sets, which only texts alike are, isn't
searched: all of it is one candidate component.

Candidate components hold whatever the trees found and more. Their sets are compared exactly, in tasks of at most about BLOCK_SHINGLES
hashes: within a task a prefix filter finds partners (sets of that similarity share one of their rarest shingles), breadth first from the
least set on, and what is reached drops out, so near copies cost about one pass over them. A larger component is dealt to blocks, each
with the component's least set. What is then connected to that set needs no more comparison with its like; the rest of the component goes,
in blocks again, to all blocks. So every pair is compared, or connected already, and no task holds a whole component.

Defined results: a null text, like one without words, is the empty set, equal to itself and similar to nothing else; a text of fewer
than SHINGLE words is one shingle. Null, repeated and tied doc_ids are rows like any other."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.arrowtext import map_texts, release
from tallyloom.llm.decontaminate import ragged
from tallyloom.llm.simhash import FOREST, FRONTIER, SEED, _roots, apart, components, search
from tallyloom.session import materialize, ship

SHINGLE = 5
LEAST = 0.8
#: 64-bit words of a fingerprint, and those of them that trees measure.
WORDS = 16
TREE_WORDS = 3
#: Bits of a shard in a table of 2^18 sets (128 sets a shard, about); one more for four times as many. And most nodes of a tree.
SHARD_BITS = 11
TREE_NODES = 1 << 13
#: Probability that a pair at the least similarity meets in no shard.
LOST = 7e-5
#: Sets of few shingles, whose bits differ more often (four shingles of five: 0.1875), are in more shards.
SMALL = 7
SMALL_DIFFERS = 0.1875
#: Hashes of the sets that a task compares with each other, about.
BLOCK_SHINGLES = 2_000_000
#: Names of rows that are sent to all tasks, to find or leave out their texts (some 60 MB); more are joined by a shuffle of the texts.
SENT = 500_000
#: Hashes whose bits are counted at once, in bytes.
BLOCK = 255

_ADD = np.random.default_rng(SEED).integers(0, 1 << 64, WORDS, np.uint64)


def shingle_set(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    found = (text or "").encode().lower().split()  # bytes: of ASCII letters and white space only
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    n = max(1, len(found) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1])
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hashed(line[a:b], seed) for a, b in zip(starts.tolist(), ends[-n:].tolist(), strict=True)), np.uint64, n))


def fingerprint(own: np.ndarray) -> np.ndarray:
    """The SimHash of a set, WORDS words: each hash is mixed anew for each word."""
    counts = np.zeros(64 * WORDS, np.int64)
    for k in range(0, len(own), BLOCK):
        mixed = own[k : k + BLOCK, None] + _ADD
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((mixed ^ (mixed >> np.uint64(31))).view(np.uint8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.uint8)
    return np.packbits(2 * counts > len(own), bitorder="little").view("<u8")


def differing(least: float = LEAST) -> float:
    """The probability that a bit differs between sets of one size and this similarity (the angle between their sums)."""
    return math.acos(2 * least / (1 + least)) / math.pi


def radius(least: float = LEAST) -> int:
    """Of a tree: the distance expected at this similarity and six deviations."""
    bits, p = 64 * TREE_WORDS, differing(least)
    return math.ceil(bits * p + 6 * math.sqrt(bits * p * (1 - p)))


def drawn(sets: int, differ: float) -> list[list[int]]:
    """Masks of all words (signed longs) for each choice of bits: bits for so many sets, choices until a pair whose bits
    differ with this probability meets in one of them, but for LOST. All bits are used up before one is drawn again."""
    whole, bits = 64 * WORDS, max(4, round(SHARD_BITS + (math.log2(max(sets, 1)) - 18) / 2))
    d = np.arange(whole + 1)
    log = np.concatenate([[0], np.cumsum(np.log(np.arange(1, whole + 1)))])
    chance = np.exp(log[whole] - log[d] - log[whole - d] + d * math.log(differ) + (whole - d) * math.log1p(-differ))
    equal = np.prod([np.maximum(whole - d - k, 0) / (whole - k) for k in range(bits)], axis=0)
    n = 1
    while chance @ (1 - equal) ** n > LOST:
        n += 1
    draw, waiting, out = np.random.default_rng(SEED), np.zeros(0, np.int64), []
    for _ in range(n):
        if len(waiting) < bits:
            waiting = draw.permutation(whole)
        mask = np.zeros(whole, np.uint8)
        mask[waiting[:bits]] = 1
        waiting = waiting[bits:]
        out.append(np.packbits(mask, bitorder="little").view("<i8").tolist())
    return out


def _name(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED)


def near_links(shard: np.ndarray, names: np.ndarray, fps: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of a batch of whole shards (sorted by shard): each set and the least one that it reaches by fingerprints."""
    distinct, number = np.unique(names, return_inverse=True)
    left, right, held = [], [], 0

    def link(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal left, right, held
        a, b = number[a], number[b]
        left.append(a[a != b]), right.append(b[a != b])
        held += len(left[-1])
        if held > FRONTIER:  # reduce to a spanning set
            root = _roots(len(distinct), np.concatenate(left), np.concatenate(right))
            moved = np.flatnonzero(root != np.arange(len(root)))
            left, right, held = [moved], [root[moved]], len(moved)

    def ask(asks: np.ndarray, tree: np.ndarray) -> None:
        asks = asks[np.isin(shard[asks], shard[tree])]
        if len(asks):
            for query, node in search(fps[tree], shard[tree], fps[asks], shard[asks], within):
                link(asks[query], tree[node])

    at = np.arange(len(shard))
    while len(at):
        _, first, of = np.unique(shard[at], return_index=True, return_inverse=True)
        leader = at[first][of]
        near = apart(fps[at], fps[leader]) <= within
        link(at[near], leader[near])
        # where the first member has few near it, taking them out first saves nothing
        many = (8 * np.bincount(of[near]) >= np.bincount(of))[of]
        ask(at[~many], at[~many])
        ask(at[many & near], at[many & ~near])
        at = at[many & ~near]
    root = _roots(len(distinct), np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right]))
    moved = np.flatnonzero(root != np.arange(len(root)))
    return distinct[moved], distinct[root[moved]]


def candidates(prints: DataFrame, least: float = LEAST, tree_nodes: int = TREE_NODES) -> DataFrame:
    """(fp, to): links of sets that may be similar. prints, a written table, has set, n and words, a row for each set."""
    ship(prints.sparkSession)
    within, fields = radius(least), [f"w{k}" for k in range(TREE_WORDS)]
    prints = prints.where(F.col("n") * (1 - least) >= least - 1e-9)  # one shingle more or less is too much for smaller ones
    sets = prints.count()
    common, every = len(drawn(sets, differing(least))), drawn(sets, max(SMALL_DIFFERS, differing(least)))
    masks = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*map(F.lit, map(np.int64, mask))).alias("mask")) for k, mask in enumerate(every)])
    placed = prints.select("set", "n", "words", F.explode(masks).alias("c")).where((F.col("c.k") < common) | (F.col("n") <= SMALL))
    shard = F.xxhash64("c.k", *[F.col("words")[k].bitwiseAND(F.col("c.mask")[k]) for k in range(WORDS)])
    placed = placed.select(shard.alias("shard"), "set", *[F.col("words")[k].alias(f) for k, f in enumerate(fields)])
    crowded = materialize(placed.groupBy("shard").agg(F.count("*").alias("n"), F.min("set").alias("to")).where(F.col("n") > tree_nodes).select("shard", "to"), "crowded")
    some = not crowded.isEmpty()
    dealt = placed.join(_few(crowded.select("shard")), "shard", "left_anti") if some else placed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(rows: list[np.ndarray]) -> pa.RecordBatch:
            a, b = near_links(rows[0], rows[1], np.stack(rows[2:], 1).view(np.uint64), within)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["fp", "to"])

        held: list[list[np.ndarray]] = []
        count = 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False).copy() for c in batch.columns])
            count += batch.num_rows
            if count >= FOREST:  # all but the last shard are whole
                rows = [np.concatenate(c) for c in zip(*held, strict=True)]
                cut = int(np.searchsorted(rows[0], rows[0][-1]))
                if cut:
                    yield whole([c[:cut] for c in rows])
                held, count = [[c[cut:].copy() for c in rows]], count - cut
        if count:
            yield whole([np.concatenate(c) for c in zip(*held, strict=True)])
        release()

    found = dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "fp long, to long")
    return found.unionByName(placed.join(_few(crowded), "shard").select(F.col("set").alias("fp"), "to")) if some else found


def linked(sets: list[np.ndarray], least: float = LEAST) -> np.ndarray:
    """For each set the number of the first one of its component."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    out, free = np.arange(len(sets)), np.ones(len(sets), bool)
    _, element, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rarity = np.empty(len(counts), np.int64)
    rarity[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    owner = np.repeat(np.arange(len(sets)), sizes)
    element = rarity[element]
    element = element[np.lexsort((element, owner))]  # each set's rarest first
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sets) else sizes
    prefix = np.where(sizes > 0, sizes - np.ceil(least * sizes - 1e-9).astype(np.int64) + 1, 0)
    mark = np.zeros(len(counts), bool)

    def postings() -> tuple[np.ndarray, np.ndarray]:
        """Prefix elements of the free sets in order, and whose they are."""
        live = np.flatnonzero(free)
        of, at = np.repeat(live, prefix[live]), element[ragged(begins[live], prefix[live])]
        order = np.argsort(at, kind="stable")
        return at[order], of[order]

    keys, holders = postings()
    held = int(free.sum())
    for first in range(len(sets)):
        if not free[first]:
            continue
        free[first], stack = False, [first]
        while stack:
            k = stack.pop()
            if held > 64 and free.sum() < held / 2:
                keys, holders = postings()
                held = int(free.sum())
            own = element[begins[k] : begins[k] + sizes[k]]
            low, high = np.searchsorted(keys, own[: prefix[k]]), np.searchsorted(keys, own[: prefix[k]], "right")
            near = np.unique(holders[ragged(low, high - low)])
            near = near[free[near]]
            if not len(near):
                continue
            mark[own] = True
            hits = np.concatenate([[0], np.cumsum(mark[element[ragged(begins[near], sizes[near])]])])
            mark[own] = False
            ends = np.cumsum(sizes[near])
            common = hits[ends] - hits[ends - sizes[near]]
            near = near[common >= least * (sizes[near] + sizes[k] - common) - 1e-9]
            out[near], free[near] = first, False
            stack += near.tolist()
    return out


def compared(dealt: DataFrame, least: float, shingle: int) -> DataFrame:
    """(set, root) of sets that aren't their component's least, within each task's key: dealt has key, set and text."""
    ship(dealt.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole() -> pa.RecordBatch:
            root = linked(sets, least)
            moved = np.flatnonzero(root != np.arange(len(root)))
            name = np.array(names, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(name[moved]), pa.array(name[root[moved]])], ["set", "root"])

        key, names, sets = None, [], []
        for batch in batches:
            for g, s, t in zip(*(c for c in (batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))), strict=True):
                if g != key:
                    if len(sets) > 1:
                        yield whole()
                    key, names, sets = g, [], []
                if not names or names[-1] != s:  # rows of equal sets lie together
                    names.append(s), sets.append(shingle_set(t.as_py(), shingle))
        if len(sets) > 1:
            yield whole()
        release()

    return dealt.repartition("key").sortWithinPartitions("key", "set").select("key", "set", "text").mapInArrow(run, "set long, root long")


def similar(texts: DataFrame, members: DataFrame, least: float = LEAST, shingle: int = SHINGLE, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(set, root) of all sets that aren't their component's least: texts has set and text, members each set's candidate group and
    number n of shingles."""
    sizes = members.groupBy("group").agg(F.sum("n").alias("n"), F.min("set").alias("least")).withColumn("blocks", F.ceil(F.col("n") / block_shingles).cast("int"))
    placed = members.select("set", "group", "n").join(sizes.select("group", "blocks", "least"), "group").withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    everywhere = F.when(F.col("set") == F.col("least"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    placed = materialize(placed.withColumn("block", F.explode(everywhere)), "blocks")
    first = materialize(compared(placed.join(texts, "set").withColumn("key", F.xxhash64("group", "block")), least, shingle), "near")
    crowded = placed.where("blocks > 1").groupBy("set", "group", "blocks", "least").agg(F.min("block").alias("block"), F.min("n").alias("n"))
    if crowded.isEmpty():
        return first
    found = components(first.select(F.col("set").alias("fp"), F.col("root").alias("to"))).select(F.col("fp").alias("set"), "root")
    apart = crowded.join(found, "set", "left").where(F.coalesce("root", "set") != F.col("least")).select("set", "group", "blocks", "n")
    sizes = apart.groupBy("group").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("parts"))
    own = apart.join(sizes, "group").withColumn("part", F.pmod(F.xxhash64("set", F.lit(1)), F.col("parts")).cast("int"))
    rest = own.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("set", "group", "block", "part")
    all_ = crowded.join(sizes, "group").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("set", "group", "block", "part")
    again = compared(rest.union(all_).distinct().join(texts, "set").withColumn("key", F.xxhash64("group", "block", "part")), least, shingle)
    links = first.union(again).select(F.col("set").alias("fp"), F.col("root").alias("to"))
    return components(links).select(F.col("fp").alias("set"), "root")


def _few(rows: DataFrame) -> DataFrame:
    """Rows of a written table, to be sent to all tasks if they are few."""
    return F.broadcast(rows) if rows.count() <= SENT else rows


def keep_one(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """One document of each component: that of the smallest doc, of rows of equal doc that of the smallest hash of its text."""
    marks = [F.xxhash64(text).alias("__mark"), F.xxhash64(F.col(doc).isNull(), doc, text).alias("__row")]

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column("__text")]
            words = np.concatenate([np.zeros(0, np.uint64), *map(fingerprint, sets)]).view(np.int64)
            return [pa.array(np.array([_name(s) for s in sets], np.uint64).view(np.int64)), pa.array(np.fromiter(map(len, sets), np.int64, len(sets))), pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * WORDS, words)]

        return work

    fields = [T.StructField("set", T.LongType()), T.StructField("n", T.LongType()), T.StructField("words", T.ArrayType(T.LongType()))]
    found = materialize(map_texts(docs.select(doc, text, *marks), text, make, fields, keep=[doc, "__mark", "__row"]), "sets")
    prints = materialize(found.groupBy("set").agg(F.first("n").alias("n"), F.first("words").alias("words")), "prints")
    linked_ = components(candidates(prints, least))
    groups = linked_.select(F.col("fp").alias("set"), F.col("root").alias("group"))
    members = groups.unionByName(groups.select(F.col("group").alias("set"), "group").distinct())
    # a text for each set in a group; rows of one set hold the same shingles
    row = ["__mark", "__row"]
    asked = materialize(found.join(members, "set").groupBy("set", "group").agg(F.min(F.struct(*row)).alias("r"), F.min("n").alias("n")).select("set", "group", "n", "r.*"), "asked")
    texts = docs.select(F.col(text).alias("text"), *marks).join(_few(asked.select("set", *row)), row).select("set", "text")
    moved = materialize(similar(texts, asked.select("set", "group", "n"), least, shingle), "near")
    known = found.join(moved, "set", "left").withColumn("root", F.coalesce("root", "set"))
    best = known.groupBy("root").agg(F.min(F.struct(F.col(doc).isNull(), F.col(doc).alias("d"), F.col("__mark"), F.col("__row"))).alias("best")).select("best.__mark", "best.__row")
    # rows that go, and rows that are there several times: few beside those that stay
    rows = found.groupBy(*row).agg(F.count("*").alias("times")).join(best.distinct().withColumn("best", F.lit(True)), row, "left")
    marked = materialize(rows.where("best IS NULL OR times > 1").select(*row, F.coalesce("best", F.lit(False)).alias("best")), "marked")
    every = docs.withColumns({"__mark": marks[0], "__row": marks[1]})
    again = F.row_number().over(Window.partitionBy(*row).orderBy(F.lit(0)))
    marked = _few(marked)
    once = every.join(marked.where("best").select(*row), row, "left_semi").withColumn("__again", again).where("__again = 1").drop("__again")
    return every.join(marked.select(*row), row, "left_anti").unionByName(once).drop(*row)
