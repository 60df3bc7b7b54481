"""Ranked lexical search of a query set over all documents, with bag deduplication.

A document counts by its bag alone: the numbers and frequencies of the terms that some item has, and m, its length beside the mean. One pass
over the texts makes the bags. Equal bags (grouped by a hash and by all their values, so a group is verified by comparing them) are a
class, which is scored once, for all items; only the classes that an item ranks among its first TOP are expanded to their members,
by ascending doc_id. TOP classes in the order of score and least doc_id hold an item's first TOP documents: a class beyond them has that
many documents before its first. A class may hold any share of the rows: grouping is combined on the map side, members are ranked with the
partial limit that Spark pushes below the shuffle.

Items are a query set, in blocks of about BLOCK_TERMS terms (some 6 MB of text): one block's vocabulary, frequencies and item lists go to the
tasks, so what is sent has that bound; each block more is a pass more over the texts. Within a task scores are sums of 64-bit integers
over the item lists of a class's terms, a slice of classes at a time, and each item keeps its best TOP.

Defined results: null has no terms, in documents and in items; a document without terms doesn't count in N. An item without terms, or
whose terms no document has, has no rows. Rows of equal item_id are items of their own, ranked each for itself and told apart by nothing.
Repeated rows are documents of their own, ranks are unique all the same. Null doc_ids stand after others of equal score. An empty table of
either kind gives an empty result. Extra columns are not used."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.arrowtext import map_texts
from tallyloom.llm.decontaminate import ragged
from tallyloom.llm.tables import table
from tallyloom.session import materialize, ship

TOP = 20
#: Terms of all items of a block, with repeats, about.
BLOCK_TERMS = 1_000_000
#: Classes times items that are scored at once, and list entries.
SLICE = 1 << 18
K1, B = 12, 25

_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """A text's terms, A-Z lower-cased."""
    return (text or "").encode().translate(_TERMS).split()


@dataclass
class Items:
    """A block of items: the vocabulary, and for each of its terms the items that hold it and how often."""

    numbers: dict[bytes, int]
    starts: np.ndarray
    sizes: np.ndarray
    owners: np.ndarray
    times: np.ndarray
    n: int

    @classmethod
    def build(cls, texts: list[str | None]) -> Items:
        found = [Counter(terms(t)) for t in texts]
        numbers = {w: k for k, w in enumerate(sorted(set().union(*found)))}
        entries = np.array(sorted((numbers[w], k, c) for k, own in enumerate(found) for w, c in own.items()), np.int64).reshape(-1, 3)
        sizes = np.bincount(entries[:, 0], minlength=len(numbers))
        return cls(numbers, np.cumsum(sizes) - sizes, sizes, entries[:, 1], entries[:, 2], len(texts))


def bags(docs: DataFrame, items: Items, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, n (all terms of a text), terms (ascending numbers of those of the items) and tfs."""
    sent = docs.sparkSession.sparkContext.broadcast(items.numbers)

    def make():
        numbers = sent.value

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            n, sizes, own, tfs = [], [], [], []
            for t in batch.column("__text"):
                every = terms(t.as_py())
                held = sorted((numbers[w], c) for w, c in Counter(filter(numbers.__contains__, every)).items())
                n.append(len(every)), sizes.append(len(held))
                own += [k for k, _ in held]
                tfs += [c for _, c in held]
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            return [pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(own, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))]

        return work

    fields = [T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.LongType()))]
    named = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    return map_texts(named, "text", make, fields, keep=["doc"])


class Best:
    """Each item's best classes so far: by score, then least doc (null last), then class."""

    def __init__(self, n: int, top: int):
        self.top, self.held = top, np.zeros((0, 4), np.int64)  # item, score, least, class
        self.floor = np.zeros(n, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, least: np.ndarray, name: np.ndarray) -> None:
        some = score >= np.maximum(self.floor[item], 1)
        new = np.stack([c[some] for c in (item, score, least, name)], 1)
        every = np.concatenate([self.held, new])
        every = every[np.lexsort((every[:, 3], every[:, 2], -every[:, 1], every[:, 0]))]
        _, first, count = np.unique(every[:, 0], return_index=True, return_counts=True)
        place = np.arange(len(every)) - np.repeat(first, count)
        self.held = every[place < self.top]
        full = np.flatnonzero(place == self.top - 1)
        self.floor[every[full, 0]] = every[full, 1]


def scores(classes: DataFrame, items: Items, weights: np.ndarray, top: int = TOP) -> DataFrame:
    """(item, score, least, class): each task's best classes for each item. classes has class, least, m, terms and tfs."""
    spark = classes.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((items.starts, items.sizes, items.owners, items.times, weights, items.n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, sizes, owners, times, weight, n_items = sent.value
        best = Best(n_items, top)
        for batch in batches:
            name, m = batch.column("class").to_numpy(), batch.column("m").to_numpy()
            least = pc.fill_null(batch.column("least"), _LAST).to_numpy()
            held, tfs = batch.column("terms"), pc.list_flatten(batch.column("tfs")).to_numpy()
            own, per = pc.list_flatten(held).to_numpy(), pc.list_value_length(held).to_numpy()
            row = np.repeat(np.arange(len(per)), per)
            value = weight[own] * ((1_000_000_000 * tfs) // (1000 * tfs + K1 * m[row]))
            # slices of whole classes, bounded by what they spread to
            spread = np.cumsum(np.bincount(row, sizes[own], len(per)).astype(np.int64))
            a = 0
            while a < len(per):
                b = max(a + 1, min(a + max(1, SLICE // n_items), int(np.searchsorted(spread, (spread[a - 1] if a else 0) + SLICE, "right"))))
                lo, hi = np.searchsorted(row, [a, b])
                size = sizes[own[lo:hi]]
                at = ragged(starts[own[lo:hi]], size)
                total = np.zeros((b - a) * n_items, np.int64)
                np.add.at(total, np.repeat(row[lo:hi] - a, size) * n_items + owners[at], np.repeat(value[lo:hi], size) * times[at])
                some = np.flatnonzero(total)
                best.add(some % n_items, total[some], least[a + some // n_items], name[a + some // n_items])
                a = b
        item, score, least, name = best.held.T
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(score), pa.array(least, mask=least == _LAST), pa.array(name)], ["item", "score", "least", "class"])

    return classes.select("class", F.col("least").cast("long").alias("least"), "m", "terms", "tfs").mapInArrow(run, "item long, score long, least long, class long")


_LAST = (1 << 63) - 1


def ranked(docs: DataFrame, texts: list[str | None], top: int = TOP, doc: str = "doc_id", text: str = "text") -> DataFrame | None:
    """(item: number in texts, rank, doc, score) of one block of items; None if there is nothing to rank."""
    items = Items.build(texts)
    if not items.numbers:
        return None
    found = materialize(bags(docs, items, doc, text), "bags")
    n_docs, n_terms = found.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    m = F.expr(f"{100 - B} + (({B} * n * {n_docs}L) div {n_terms}L)")
    key = ["hash", "m", "terms", "tfs"]
    named = found.where(F.size("terms") > 0).withColumn("m", m).withColumn("hash", F.xxhash64("m", "terms", "tfs"))
    classes = materialize(named.groupBy(*key).agg(F.min("doc").alias("least"), F.count("*").alias("members")).withColumn("class", F.monotonically_increasing_id()), "classes")
    held = classes.select(F.explode("terms").alias("term"), "members").groupBy("term").agg(F.sum("members").alias("df")).collect()  # a row per term of the block
    weights = np.zeros(len(items.numbers), np.int64)
    for r in held:
        weights[r.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1)))
    order = [F.desc("score"), F.col("least").asc_nulls_last(), "class"]
    best = scores(classes, items, weights, top).withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("place") <= top)
    best = materialize(best.select("item", "score", "class"), "best")
    ahead = materialize(classes.join(best.select("class").distinct(), "class", "left_semi").select("class", *key), "ahead")
    hashes = materialize(ahead.select("hash").distinct(), "hashes")  # at most top for each item: of known size
    place = F.row_number().over(Window.partitionBy("class").orderBy(F.col("doc").asc_nulls_last()))
    members = named.join(hashes, "hash", "left_semi").join(ahead, key).select("class", "doc").withColumn("place", place).where(F.col("place") <= top)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last()))
    return best.join(members, "class").withColumn("rank", rank).where(F.col("rank") <= top).select("item", "rank", "doc", "score")


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item, rank, doc and score of each item's top documents with a score above 0."""
    spark = docs.sparkSession
    queries = materialize(benchmark.select(F.col(item).alias("name"), F.col(item_text).alias("text"), F.xxhash64(item, item_text, F.monotonically_increasing_id()).alias("mark")), "items")
    # at most half of a text's bytes are terms
    total = queries.agg(F.sum(F.ceil(F.octet_length("text") / 2))).first()[0] or 0
    blocks = max(1, -(-total // block_terms))
    kind = T.StructType([T.StructField(item, benchmark.schema[item].dataType), T.StructField("item", T.LongType())])
    out = spark.createDataFrame([], T.StructType([kind[item], T.StructField("rank", T.IntegerType()), T.StructField(doc, docs.schema[doc].dataType), T.StructField("score", T.LongType())]))
    for k in range(blocks):
        rows = queries.where(F.pmod("mark", F.lit(blocks)) == k).select("name", "text").collect()  # one block: bounded
        found = ranked(docs, [r.text for r in rows], top, doc, text) if rows else None
        if found is not None:
            names = spark.createDataFrame([(r.name, n) for n, r in enumerate(rows)], kind)
            out = out.unionByName(found.join(names, "item").select(item, "rank", F.col("doc").alias(doc), "score"))
    return out


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: SQL for op12's rows.
ORACLE = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
b AS MATERIALIZED (
  SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
t AS (SELECT count(*) AS n, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0),
asked AS (SELECT i, item_id, term, count(*) AS times FROM b GROUP BY ALL),
f AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * t.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f CROSS JOIN t GROUP BY term, t.n),
m AS (SELECT r, doc_id, 75 + ((25 * len(terms) * t.n) // t.l) AS m FROM d CROSS JOIN t),
s AS (SELECT i, item_id, doc_id, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN f USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""
