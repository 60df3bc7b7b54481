"""Near-duplicates by SimHash fingerprints and BK-trees.

A fingerprint is the majority of the XXH64 hashes of a text's word shingles, bit by bit. Fingerprints of at most RADIUS differing bits
link. Copies are first reduced to distinct fingerprints. As RADIUS changed bits leave one of RADIUS + 1 bands of bits untouched, every
band's value names a shard, and linked fingerprints meet in at least one shard; values with a single fingerprint drop out. A shard of more
than TREE_NODES fingerprints is divided by bands of its other bits in the same way, until none is larger. Each shard gets a BK-tree:
children hang from their parent by their integer Hamming distance to it. Trees aren't broadcast from the driver, which trees of all
documents would not fit: a tree meets the queries of its shard by Spark's shuffle. A search follows only edges within RADIUS of the
query's distance to the node. A batch of shards forms one forest, built and searched level by level in numpy. Only spanning links leave a shard: each
fingerprint to the least one that it reaches there. Links of all shards are reduced to spanning ones again, by name; components over these come
from alternating large-star and small-star steps over tables in the shared folder. Documents, links and fingerprints never go to the driver.

Defined results: a null text, like one without words, has fingerprint zero and links like any other. A null doc_id is never a
component's smallest; a component without any other has component_id null. Rows of equal doc_id are rows of their own that share
a component if their fingerprints do. An empty table gives an empty result. Extra columns stay out of the search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.arrowtext import map_texts
from tallyloom.llm.decontaminate import ragged
from tallyloom.llm.tables import table
from tallyloom.session import materialize, ship

SEED = 42
SHINGLE = 3
RADIUS = 2
#: Most nodes of a tree.
TREE_NODES = 1 << 15
#: Fingerprints in a forest, and pairs of query and node that a search looks at together.
FOREST = 1 << 17
FRONTIER = 1 << 20
#: Hashes whose bits are counted at once.
BLOCK = 1 << 14


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text, unsigned."""
    found = (text or "").encode().lower().split()  # bytes: of ASCII letters and white space only
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    n = max(1, len(found) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1])
    stops = ends[-n:]
    counts = np.zeros(64, np.int64)
    hashed = xxhash.xxh64_intdigest
    for k in range(0, n, BLOCK):
        some = [hashed(line[a:b], seed) for a, b in zip(starts[k : k + BLOCK].tolist(), stops[k : k + BLOCK].tolist(), strict=True)]
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """docs with fp: the fingerprint's 64 bits as a signed long."""

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column("__text")]
            return [pa.array(np.array(fps, np.uint64).view(np.int64))]

        return work

    return map_texts(docs, text, make, [T.StructField("fp", T.LongType())], keep)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, pair by pair: of one word each, or of a row of words."""
    counts = np.bitwise_count(a ^ b)
    return counts.astype(np.int64) if counts.ndim == 1 else sum(counts[:, k].astype(np.int64) for k in range(counts.shape[1]))


def grow(fps: np.ndarray, tree: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of all fingerprints (words, or rows of words) with the same tree number: parent and edge of each node (-1 for roots), and the
    roots. A level at a time: of the fingerprints that wait at a node with the same distance, the first becomes its child, the others go on to it."""
    stride = 1 + 64 * (fps.size // max(len(fps), 1))
    parent, edge = np.full(len(fps), -1), np.full(len(fps), -1)
    _, roots = np.unique(tree, return_index=True)
    wait = np.ones(len(fps), bool)
    wait[roots] = False
    waiting = np.flatnonzero(wait)
    at = roots[np.searchsorted(tree[roots], tree[waiting])]
    while len(waiting):
        distance = apart(fps[waiting], fps[at])
        _, first, group = np.unique(at * stride + distance, return_index=True, return_inverse=True)
        parent[waiting[first]], edge[waiting[first]] = at[first], distance[first]
        at = waiting[first][group]
        stay = np.ones(len(waiting), bool)
        stay[first] = False
        waiting, at = waiting[stay], at[stay]
    return parent, edge, roots


def search(fps: np.ndarray, tree: np.ndarray, queries: np.ndarray, of: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) of all pairs within radius; tree must be sorted, of holds each query's tree."""
    parent, edge, roots = grow(fps, tree)
    words = fps.size // max(len(fps), 1)
    stride, most = 1 + 64 * words, FRONTIER // max(words, 1)
    order = np.argsort(parent * stride + edge, kind="stable")
    keys = (parent * stride + edge)[order]
    inner = np.zeros(len(fps), bool)
    inner[parent[parent >= 0]] = True
    for k in range(0, len(queries), most // 16):
        query = np.arange(k, min(len(queries), k + most // 16))
        stack = [(query, roots[np.searchsorted(tree[roots], of[query])])]
        while stack:
            query, node = stack.pop()
            if len(query) > most:
                stack += [(query[i : i + most], node[i : i + most]) for i in range(0, len(query), most)]
                continue
            distance = apart(queries[query], fps[node])
            hit = distance <= radius
            yield query[hit], node[hit]
            on = inner[node]
            query, node, distance = query[on], node[on], distance[on]
            low = np.searchsorted(keys, node * stride + np.maximum(distance - radius, 0))
            counts = np.searchsorted(keys, node * stride + np.minimum(distance + radius, stride - 1), "right") - low
            if counts.any():
                stack.append((np.repeat(query, counts), order[ragged(low, counts)]))


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least number that each of n reaches over links."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
        more = root[left] != root[right]
        left, right = left[more], right[more]
    return root


def forest_links(shard: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of a batch of whole shards (sorted by shard): each fingerprint and the least one that it reaches in its shard."""
    distinct, number = np.unique(fps.view(np.int64), return_inverse=True)
    left, right, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for query, node in search(fps, shard, fps, shard, radius):
        a, b = number[query], number[node]
        left.append(a[a != b]), right.append(b[a != b])
        held += len(left[-1])
        if held > FRONTIER:  # reduce to a spanning set
            root = _roots(len(distinct), np.concatenate(left), np.concatenate(right))
            moved = np.flatnonzero(root != np.arange(len(root)))
            left, right, held = [moved], [root[moved]], len(moved)
    root = _roots(len(distinct), np.concatenate(left), np.concatenate(right))
    moved = np.flatnonzero(root != np.arange(len(root)))
    return distinct[moved], distinct[root[moved]]


def bands(bits: tuple[int, ...], radius: int) -> list[tuple[int, ...]]:
    """radius + 1 bands of the given bit numbers: radius changed bits leave one of them untouched."""
    return [tuple(int(b) for b in band) for band in np.array_split(np.array(bits), radius + 1)]


def _mask(bits: tuple[int, ...]) -> int:
    """As a signed long."""
    whole = sum(1 << b for b in bits)
    return whole - (1 << 64) if whole >> 63 else whole


def sharded(fps: DataFrame, radius: int = RADIUS, most: int = TREE_NODES) -> DataFrame:
    """(mask, value, fp): shards of two to most distinct fingerprints, so that all within radius of each other meet in one of them.

    A shard holds the fingerprints that are equal under a mask of bits. One of more than most of them is divided by the bands of the bits
    that are left, of which radius changed ones again leave one untouched: each member goes to radius + 1 narrower shards. When no more
    than log2(most) bits are left, a shard can't hold more, so this ends after a few rounds (four, for two bits)."""
    every, most = tuple(range(64)), max(most, 1 << radius)
    open_ = {_mask(band): tuple(b for b in every if b not in band) for band in bands(every, radius)}  # mask: bits that are left
    now = fps.select("fp", F.explode(F.array(*map(F.lit, open_))).alias("mask"))
    out = []
    while open_:
        keyed = now.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = materialize(keyed.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1"), "shards")
        out.append(keyed.join(sizes.where(F.col("n") <= most), ["mask", "value"]).select("mask", "value", "fp"))
        crowded = {r.mask for r in sizes.where(F.col("n") > most).select("mask").distinct().collect()}
        if not crowded:
            break
        # the number of masks grows by radius + 1 a round; they depend on the radius alone
        split = {m: [(_mask(tuple(b for b in every if b not in left) + band), tuple(b for b in left if b not in band)) for band in bands(left, radius)] for m, left in open_.items() if m in crowded}
        narrower = F.create_map(*[x for m, parts in split.items() for x in (F.lit(m), F.array(*[F.lit(p) for p, _ in parts]))])
        hot = keyed.join(sizes.where(F.col("n") > most).select("mask", "value"), ["mask", "value"])
        now = hot.select("fp", F.explode(narrower[F.col("mask")]).alias("mask")).distinct()
        open_ = {p: left for parts in split.values() for p, left in parts}
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def links(fps: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """Spanning links (fp, to) of distinct fingerprints in column fp: whatever is within radius is connected by them."""
    ship(fps.sparkSession)
    dealt = sharded(fps, radius, tree_nodes).repartition("mask", "value").sortWithinPartitions("mask", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(rows: list[np.ndarray]) -> pa.RecordBatch:
            edge = np.ones(len(rows[0]), bool)
            edge[1:] = np.any([c[1:] != c[:-1] for c in rows[:2]], axis=0)
            a, b = forest_links(np.cumsum(edge) - 1, rows[2].view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["fp", "to"])

        held: list[np.ndarray] = []
        for batch in batches:
            new = [np.array(c.to_numpy(zero_copy_only=False)) for c in batch.columns]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            if len(held[0]) >= FOREST:  # all but the last shard are whole
                last = np.any([c != c[-1] for c in held[:2]], axis=0)
                cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
                if cut:
                    yield whole([c[:cut] for c in held])
                    held = [c[cut:] for c in held]
        if held and len(held[0]):
            yield whole(held)

    return dealt.mapInArrow(run, "fp long, to long")


def spanning(edges: DataFrame) -> DataFrame:
    """Links (fp, to), the greater name first, that connect what edges do: edges meet by their greater name, and a task keeps spanning ones, to
    the least name that it reaches. Where a group's members have many links each, nearly every task reaches the same least one, so few more
    than one for each member are left."""
    ship(edges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def reduced() -> list[np.ndarray]:
            left, right = (np.concatenate(c) for c in zip(*held, strict=True))
            distinct, number = np.unique(np.concatenate([left, right]), return_inverse=True)
            root = _roots(len(distinct), number[: len(left)], number[len(left) :])
            moved = np.flatnonzero(root != np.arange(len(root)))
            return [distinct[moved], distinct[root[moved]]]

        held: list[list[np.ndarray]] = []
        count = 0
        for batch in batches:
            held.append([np.array(c.to_numpy(zero_copy_only=False)) for c in batch.columns])
            count += batch.num_rows
            if count > FRONTIER:
                held = [reduced()]
                count = len(held[0][0])
                if count > FRONTIER // 2:  # links of as many names: they go out, and those that follow are reduced anew
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], ["fp", "to"])
                    held, count = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in reduced()], ["fp", "to"])

    down = edges.where("fp <> to").select(F.greatest("fp", "to").alias("fp"), F.least("fp", "to").alias("to"))
    return down.repartition("fp").mapInArrow(run, "fp long, to long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) of all fingerprints that aren't their component's least, from links (fp, to): large-star and small-star steps over spanning
    links until nothing changes. A step joins each link to at most one minimum, so it makes as many rows as there are links, or twice as many."""
    seen = lambda links: tuple(links.agg(F.count("*"), F.sum(F.xxhash64("fp", "to").cast("decimal(38,0)"))).first())
    now = materialize(spanning(edges), "links")
    state = seen(now)
    while True:
        # large star: a node's greater neighbours go to the least of its others, or stay with it where it has none
        least = now.groupBy(F.col("fp").alias("to")).agg(F.min("to").alias("low"))
        large = now.join(least, "to", "left").select("fp", F.coalesce("low", "to").alias("to")).distinct()
        # small star: a node and its lesser neighbours go to the least of these
        found = large.withColumn("low", F.min("to").over(Window.partitionBy("fp")))
        ends = F.when(F.col("to") == F.col("low"), F.array("fp")).otherwise(F.array("fp", "to"))
        small = found.select(F.explode(ends).alias("fp"), F.col("low").alias("to")).distinct()
        now = materialize(small, "links")
        last, state = state, seen(now)
        if state == last:
            return now.select("fp", F.col("to").alias("root"))


def classes(fingerprints: DataFrame, doc: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """fp and component_id of all distinct fingerprints of a table (doc, fp)."""
    distinct = materialize(fingerprints.groupBy("fp").agg(F.min(doc).alias("least_doc")), "fingerprints")
    moved = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(moved, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.where("root <> fp").unionByName(distinct.join(moved.select(F.col("root").alias("fp")).distinct(), "fp", "left_semi").withColumn("root", F.col("fp"))).groupBy("root").agg(F.min("least_doc").alias("component_id"))
    return rooted.join(ids, "root", "left").select("fp", F.when(F.col("component_id").isNull() & (F.col("root") == F.col("fp")), F.col("least_doc")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc, fp and component_id, a row for each of docs."""
    found = materialize(with_fingerprints(docs.select(doc, text), text, shingle, keep=[doc]), "simhash")
    return found.join(classes(found, doc, radius), "fp").select(doc, "fp", "component_id")


def keep_one(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each component: that of the smallest doc, of rows of equal doc that of the smallest hash of its text."""
    mark = F.xxhash64(text)
    found = materialize(with_fingerprints(docs.select(doc, text).withColumn("__mark", mark), text, shingle, keep=[doc, "__mark"]), "simhash")
    known = found.join(classes(found, doc, radius), "fp")
    best = known.groupBy(F.coalesce("component_id", "fp").alias("c"), F.col("component_id").isNull().alias("n")).agg(F.min(F.struct(F.col(doc).isNull(), F.col(doc).alias("d"), F.col("__mark").alias("m"))).alias("best")).select("best.d", "best.m").distinct()
    left = docs.withColumn("__mark", mark)
    kept = left.join(best, left[doc].eqNullSafe(best["d"]) & (left["__mark"] == best["m"]), "left_semi")
    again = F.row_number().over(Window.partitionBy(doc, "__mark").orderBy(F.lit(0)))
    return kept.withColumn("__again", again).where("__again = 1").drop("__again", "__mark")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
