"""Similarity join of texts by the Jaccard similarity of their word shingles: adaptive multi-match prefixes.

A text is the set of the hashes of its runs of SHINGLE words. Sets are in one order of tokens, the rarest first. Two sets that are similar enough
share l tokens among the first n - o + l of either, o being the least overlap that a set of n allows, for any l. Each set chooses its own l: a longer
prefix costs more rows, but asks for more shared tokens before a pair is looked at. The choice is the least of an estimate: rows sent, partners
met in them, and the partners that can have l matches (at most all those met, divided by l) times the cost of a test. A pair must then
share as many prefix tokens as the smaller of both l.

How often tokens occur is counted over all texts, by a hash into COUNTERS counters that each task sums and sends compressed; what tasks get is a byte
a counter, whatever the corpus. A counter is never less than the truth, so the order prefers tokens that are surely rare, and a poor estimate
costs time, not links. For a corpus of over some 10^11 words take more counters.

Equal sets are one. Tokens of up to MEETING sets make pairs (a join on the token, counted by pair); a token of more joins its sets to the least of them, as a
pair for each two would be the square of a group. Both give candidate groups, whose sets are then compared exactly, by the same multi-match
prefixes with exact counts, in tasks of about BLOCK_SHINGLES hashes: breadth first, so what is reached drops out, and a group of copies costs
a few passes over it. A larger group is divided by size (sets of unlike size can't be similar; each goes to its own cell and the next), a
larger cell is dealt to blocks that each hold the cell's least set, and only sets that aren't connected to that one meet all other blocks.
So every pair that could be linked is compared or already connected.

Shingles are told apart by 64 bits, sets by 128. A text that is fetched for a set is held against the set's name.

Defined results: null, like a text without words, is the empty set, which is linked with nothing, its like included. A text of fewer words
than SHINGLE is one shingle. Rows of equal doc are rows of their own; component_id is the least doc that is linked, null only where no linked row
has one. An empty table gives an empty result. Extra columns are not used."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.arrowtext import flat, map_texts
from tallyloom.llm.decontaminate import ragged
from tallyloom.llm.simhash import components
from tallyloom.llm.tables import table
from tallyloom.session import materialize, ship

SHINGLE = 3
#: Least similarity in hundredths.
PERCENT = 90
#: Counters of token frequencies, and of one message.
COUNTERS, PIECE = 1 << 24, 1 << 16
#: Longest l, and the cost of sending a token and of testing a pair, in partners met.
MOST, SEND, TEST = 8, 2.0, 16.0
#: Sets of a token that meet as pairs.
MEETING = 16
#: Hashes of the sets that a task compares with each other, about.
BLOCK_SHINGLES = 2_000_000
#: Sets whose names are sent to all tasks to find their texts (some 60 MB); more are joined by a shuffle of the texts.
SENT = 500_000

_SPACE = np.isin(np.arange(256), [*b" \t\n\v\f\r"])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_SEEDS = [np.uint64(x) for x in np.random.default_rng(13).integers(0, 1 << 64, 5, np.uint64)]
_TIMES = [s | np.uint64(1) for s in _SEEDS]


def _mixed(parts: list[np.ndarray]) -> np.ndarray:
    """A hash of rows of words' hashes; the number of words counts."""
    out = np.full(len(parts[0]), _SEEDS[0] + np.uint64(len(parts)), np.uint64)
    for part in parts:
        out = (out ^ part) * _TIMES[1]
        out ^= out >> np.uint64(29)
        out = out * _TIMES[2]
        out ^= out >> np.uint64(32)
    return out


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The distinct hashes of each text's shingles, sorted."""
    data, offsets = flat(texts)
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins[first] = solid[first]
    at = np.flatnonzero(begins)
    # without white space the words lie back to back
    edges = np.append((np.cumsum(solid) - 1)[at], solid.sum()).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(edges), pa.py_buffer(_LOWER[data[solid]])]).dictionary_encode()
    known = np.fromiter((xxhash.xxh64_intdigest(w.as_buffer()) for w in words.dictionary), np.uint64, len(words.dictionary))
    own = known[words.indices.to_numpy()] if len(known) else known
    ends = np.searchsorted(at, offsets)
    starts, sizes = ends[:-1], np.diff(ends)
    full = _mixed([own[k : len(own) - shingle + 1 + k] for k in range(shingle)]) if len(own) >= shingle else own[:0]
    out = []
    for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        out.append(np.unique(full[a : a + n - shingle + 1]) if n >= shingle else _mixed([own[a + k : a + k + 1] for k in range(n)]) if n else full[:0])
    return out


def name(own: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64).tolist())


def overlap(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least number of elements that a set of n shares with a similar one."""
    return (n * percent + 99) // 100


def matches(others: np.ndarray, n: int, percent: int) -> int:
    """A set's l, by the estimated number of other sets of each of its tokens in order."""
    least = overlap(n, percent)
    most = min(MOST, least)
    total = np.cumsum(others[: n - least + most])[n - least :]
    step = np.arange(1, most + 1)
    return int(np.argmin(SEND * (n - least + step) + total * (1 + TEST / step))) + 1


# --- frequencies -----------------------------------------------------------------------------------------------------------------

_EXACT = 128


def coded(counts: np.ndarray) -> np.ndarray:
    """A byte for each count: exact below _EXACT, four steps an octave above."""
    high = _EXACT + np.minimum(np.round(4 * np.log2(np.maximum(counts, _EXACT) / _EXACT)), 255 - _EXACT)
    return np.where(counts < _EXACT, counts, high).astype(np.uint8)


_CODE = np.arange(256)
_COUNT = np.where(_CODE < _EXACT, _CODE, _EXACT * 2.0 ** ((_CODE - _EXACT) / 4))


def frequencies(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, counters: int = COUNTERS) -> np.ndarray:
    """coded() counts of all texts' tokens, by their highest bits."""
    ship(docs.sparkSession)
    piece = min(PIECE, counters)
    shift = np.uint64(64 - int(math.log2(counters)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(counters, np.uint32)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                sets = shingle_sets(batch.column(0).slice(k, 256), shingle)
                np.add.at(held, (np.concatenate(sets) >> shift).astype(np.int64), np.uint32(1))
        for k, part in enumerate(held.reshape(-1, piece)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)])], ["piece", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, np.zeros(piece, np.int64)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(coded(held).tobytes(), 1)])], ["piece", "counts"])

        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k != at:
                    if at is not None:
                        yield row()
                    at, held = k, np.zeros(piece, np.int64)
                held += np.frombuffer(zlib.decompress(counts.as_py()), np.uint32)
        if at is not None:
            yield row()

    kind = "piece int, counts binary"
    parts = docs.select(text).mapInArrow(count, kind).repartition("piece").sortWithinPartitions("piece").mapInArrow(merge, kind)
    out = np.zeros((counters // piece, piece), np.uint8)
    for r in parts.collect():  # a byte a counter
        out[r.piece] = np.frombuffer(zlib.decompress(r.counts), np.uint8)
    return out.ravel()


# --- prefixes and candidates -----------------------------------------------------------------------------------------------------


def prefixed(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, counters: int = COUNTERS) -> DataFrame:
    """doc, row (a hash of doc and text), s1 and s2 (the set's name), n, need (its l) and prefix."""
    sent = docs.sparkSession.sparkContext.broadcast(frequencies(docs, text, shingle, counters))
    shift = np.uint64(64 - int(math.log2(counters)))

    def make():
        codes = sent.value

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            first, second, sizes, needs, prefix = [], [], [], [], []
            for k in range(0, batch.num_rows, 256):
                for own in shingle_sets(batch.column("__text").slice(k, 256), shingle):
                    n = len(own)
                    code = codes[(own >> shift).astype(np.int64)]
                    order = np.argsort(code, kind="stable")  # then by hash
                    need = matches(_COUNT[code[order]] - 1, n, percent) if n else 0
                    kept = order[: n - overlap(n, percent) + need] if n else order
                    a, b = name(own)
                    first.append(a), second.append(b), sizes.append(n), needs.append(need), prefix.append(own[kept])
            ends = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *prefix]).view(np.int64)
            return [pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(sizes, pa.int32()), pa.array(needs, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]

        return work

    fields = [T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("need", T.IntegerType()), T.StructField("prefix", T.ArrayType(T.LongType()))]
    return map_texts(docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"), F.xxhash64(doc, text).alias("row")), "text", make, fields, keep=["doc", "row"])


def candidates(distinct: DataFrame, percent: int = PERCENT, meeting: int = MEETING) -> DataFrame:
    """Links (fp, to) that connect all sets that can be similar: distinct has set, n, need and prefix."""
    tokens = distinct.select("set", "n", "need", F.explode("prefix").alias("token"))
    shared = materialize(tokens.groupBy("token").agg(F.count("*").alias("times"), F.min("set").alias("least")).where("times > 1"), "shared")
    met = materialize(tokens.join(shared, "token"), "met")
    crowd = met.where((F.col("times") > meeting) & (F.col("set") != F.col("least"))).select(F.col("set").alias("fp"), F.col("least").alias("to")).distinct()
    few = met.where(F.col("times") <= meeting).select("token", "set", "n", "need")
    pairs = few.alias("a").join(few.alias("b"), "token").where(f"a.set < b.set AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)")
    pairs = pairs.groupBy(F.col("b.set").alias("fp"), F.col("a.set").alias("to")).agg(F.count("*").alias("hits"), F.min(F.least("a.need", "b.need")).alias("need"))
    return crowd.unionByName(pairs.where("hits >= need").select("fp", "to"))


# --- exact comparison ------------------------------------------------------------------------------------------------------------


def linked(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """For each set the number of the first one of its component, by multi-match prefixes with exact frequencies."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    _, token, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    begins = np.cumsum(sizes) - sizes
    token = rank[token]
    token = token[np.lexsort((token, np.repeat(np.arange(len(sets)), sizes)))]  # each set's rarest first
    others = np.sort(counts) - 1
    need = np.fromiter((matches(others[token[a : a + n]], n, percent) if n else 1 for a, n in zip(begins.tolist(), sizes.tolist(), strict=True)), np.int64, len(sets))
    prefix = np.where(sizes > 0, sizes - overlap(sizes, percent) + need, 0)
    out, free, mark = np.arange(len(sets)), np.ones(len(sets), bool), np.zeros(len(counts), bool)

    def postings() -> tuple[np.ndarray, np.ndarray]:
        """Prefix tokens of the free sets in order, and whose they are."""
        live = np.flatnonzero(free)
        of, at = np.repeat(live, prefix[live]), token[ragged(begins[live], prefix[live])]
        order = np.argsort(at, kind="stable")
        return at[order], of[order]

    keys, holders = postings()
    left = held = len(sets)
    for first in range(len(sets)):
        if not free[first]:
            continue
        free[first], left, stack = False, left - 1, [first]
        while stack and left:
            k = stack.pop()
            if held > 64 and left < held / 2:
                keys, holders = postings()
                held = left
            own = token[begins[k] : begins[k] + sizes[k]]
            low, high = np.searchsorted(keys, own[: prefix[k]]), np.searchsorted(keys, own[: prefix[k]], "right")
            near, hits = np.unique(holders[ragged(low, high - low)], return_counts=True)
            near = near[free[near] & (hits >= np.minimum(need[k], need[near])) & (100 * np.minimum(sizes[near], sizes[k]) >= percent * np.maximum(sizes[near], sizes[k]))]
            if not len(near):
                continue
            mark[own] = True
            total = np.concatenate([[0], np.cumsum(mark[token[ragged(begins[near], sizes[near])]])])
            mark[own] = False
            ends = np.cumsum(sizes[near])
            common = total[ends] - total[ends - sizes[near]]
            near = near[100 * common >= percent * (sizes[near] + sizes[k] - common)]
            out[near], free[near], left = first, False, left - len(near)
            stack += near.tolist()
    return out


def compared(dealt: DataFrame, percent: int, shingle: int) -> DataFrame:
    """(fp, to) of sets and their component's first within each task's key: dealt has key, set, s1, s2 and text."""
    ship(dealt.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole() -> pa.RecordBatch:
            root, of = linked(sets, percent), np.array(names, np.int64)
            moved = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(of[moved]), pa.array(of[root[moved]])], ["fp", "to"])

        key, names, sets = None, [], []
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                for g, s, a, b, own in zip(*(part.column(c).to_pylist() for c in range(4)), shingle_sets(part.column(4), shingle), strict=True):
                    if g != key:
                        if len(sets) > 1:
                            yield whole()
                        key, names, sets = g, [], []
                    if (not names or names[-1] != s) and name(own) == (a, b):  # rows that a set was fetched from lie together
                        names.append(s), sets.append(own)
        if len(sets) > 1:
            yield whole()

    return dealt.repartition("key").sortWithinPartitions("key", "set").select("key", "set", "s1", "s2", "text").mapInArrow(run, "fp long, to long")


def celled(members: DataFrame, percent: int, block_shingles: int) -> DataFrame:
    """set, n and group of sets (set, n, group): a group too large for a task becomes cells of like sizes, each set in two of them."""
    sizes = members.groupBy("group").agg((F.sum("n") > block_shingles).alias("large"))
    cell = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int")
    both = F.when(F.col("large"), F.array(cell, cell + 1)).otherwise(F.array(F.lit(-1)))
    return members.join(sizes, "group").select("set", "n", "group", F.explode(both).alias("cell")).select("set", "n", F.xxhash64("group", "cell").alias("group"))


def verified(texts: DataFrame, members: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(fp, root) of all sets that aren't their component's least: texts has set, s1, s2 and text, members each set's n and group."""
    cells = materialize(celled(members, percent, block_shingles), "cells")
    sizes = cells.groupBy("group").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("blocks"), F.min("set").alias("least"))
    placed = cells.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    everywhere = F.when(F.col("set") == F.col("least"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    placed = materialize(placed.withColumn("block", F.explode(everywhere)), "blocks")
    first = materialize(compared(placed.join(texts, "set").withColumn("key", F.xxhash64("group", "block")), percent, shingle), "compared")
    found = components(first)
    crowded = placed.where("blocks > 1").groupBy("set", "group", "blocks", "least").agg(F.min("block").alias("block"), F.min("n").alias("n"))
    if crowded.isEmpty():
        return found
    # a set that isn't connected to its cell's least one meets the other blocks
    own = found.select(F.col("fp").alias("set"), "root")
    roots = crowded.select("least").distinct().join(found.select(F.col("fp").alias("least"), F.col("root").alias("top")), "least", "left")
    apart = crowded.join(own, "set", "left").join(roots, "least", "left").where(F.coalesce("root", "set") != F.coalesce("top", "least")).select("set", "group", "blocks", "n")
    parts = materialize(apart.groupBy("group").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("parts")), "parts")
    mine = apart.join(parts, "group").withColumn("part", F.pmod(F.xxhash64("set", F.lit(1)), F.col("parts")).cast("int"))
    rest = mine.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("set", "group", "block", "part")
    all_ = crowded.join(parts, "group").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("set", "group", "block", "part")
    again = compared(rest.union(all_).distinct().join(texts, "set").withColumn("key", F.xxhash64("group", "block", "part")), percent, shingle)
    return components(first.union(again))


def similar(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, counters: int = COUNTERS, meeting: int = MEETING, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc, n_shingles and component_id, a row for each of docs."""
    found = materialize(prefixed(docs, doc, text, shingle, percent, counters), "sets")
    kinds = found.where("n > 0").groupBy("s1", "s2", "n", "need", "prefix").agg(F.min("doc").alias("least_doc"), F.min("row").alias("row"))
    distinct = materialize(kinds.withColumn("set", F.monotonically_increasing_id()), "distinct")
    near = components(candidates(distinct, percent, meeting)).select(F.col("fp").alias("set"), F.col("root").alias("group"))
    near = near.unionByName(near.select(F.col("group").alias("set"), "group").distinct())
    asked = materialize(distinct.select("set", "s1", "s2", "n", "row").join(near, "set"), "asked")
    wanted = asked.select("set", "s1", "s2", "row")
    wanted = F.broadcast(wanted) if asked.count() <= SENT else wanted
    texts = materialize(docs.select(F.col(text).alias("text"), F.xxhash64(doc, text).alias("row")).join(wanted, "row").drop("row"), "texts")
    moved = verified(texts, asked.select("set", "n", "group"), percent, shingle, block_shingles).select(F.col("fp").alias("set"), "root")
    rooted = distinct.select("set", "s1", "s2", "least_doc").join(moved, "set", "left").withColumn("root", F.coalesce("root", "set"))
    least = rooted.groupBy("root").agg(F.min("least_doc").alias("component_id"))
    known = rooted.join(least, "root").select("s1", "s2", "component_id")
    some = found.where("n > 0").join(known, ["s1", "s2"]).select("doc", "n", "component_id")
    every = some.unionByName(found.where("n = 0").select("doc", "n", F.col("doc").alias("component_id")))
    return every.select(F.col("doc").alias(doc), F.col("n").cast("long").alias("n_shingles"), "component_id")


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))


#: SQL for op13's rows: all pairs that share a shingle, and what they reach.
ORACLE = r"""
WITH w AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT r, sh FROM (
    SELECT r, unnest(CASE WHEN len(words) < 3 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 1), lambda k: words[k] || ' ' || words[k + 1] || ' ' || words[k + 2]) END) AS sh
    FROM w WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
pairs AS (SELECT a.r, b.r AS q, count(*) AS hits FROM s a JOIN s b ON a.sh = b.sh AND a.r < b.r GROUP BY ALL),
links AS MATERIALIZED (SELECT r, q FROM pairs JOIN n x USING (r) JOIN n y ON y.r = q WHERE 100 * hits >= 90 * (x.n + y.n - hits)),
edges AS MATERIALIZED (SELECT r, q FROM links UNION ALL SELECT q, r FROM links),
reach AS (WITH RECURSIVE go AS (SELECT r, r AS q FROM w UNION SELECT go.r, edges.q FROM go JOIN edges ON edges.r = go.q) SELECT * FROM go)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM w JOIN reach USING (r) JOIN w o ON o.r = reach.q LEFT JOIN n ON n.r = w.r GROUP BY w.r, w.doc_id
"""
