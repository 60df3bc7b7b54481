"""Benchmark decontamination by an FM-index per training shard.

Words are runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after lower-casing A-Z. A benchmark item's windows are its runs of `width` consecutive
words; an item of fewer words, but not none, is one window. A shard (a bounded slice of a partition) is turned into a sequence of word
numbers. A word that no item has, or that stands in a run of item words shorter than the shortest window, can't be part of an
occurrence; such words become terminators, each its own symbol, so no match crosses them. Over that sequence stands an FM-index: a
suffix array by prefix doubling, the Burrows-Wheeler transform in a wavelet matrix of packed rank bit vectors, and every eighth suffix
position. All windows are searched backwards at once; occurrences are located by stepping to the next sampled position; the words that
they cover merge into removal spans.

The items are the query set. Their distinct rows are cut into words by Spark and counted: blocks have about BLOCK_WINDOWS windows each, and
an item of more than SLICE of them is divided. What is built from a block is an array of 4 bytes a word of a window (8 MB a block) beside
vocabulary and owners; blocks are files that Spark hands to the executors, and a worker holds one at a time. Documents are read in one
pass: a shard is searched for each block in turn, and its hit words are marked in one array. No document is shuffled.

Defined results: null has no words, in documents and in items; an item without words has no window. An item whose item_id is null
counts under the name "null". Rows of equal item_id are one item with all their windows. Repeated documents are rows like any other. An
empty benchmark hits nothing. Extra columns stay; a column that has the name of an output is replaced."""

from __future__ import annotations

import pickle
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm import files
from tallyloom.llm.arrowtext import flat, map_texts
from tallyloom.llm.tables import table
from tallyloom.session import fresh_path, materialize

WIDTH = 10
#: Windows of a block, about, and most windows of an item that stay together.
BLOCK_WINDOWS = 200_000
SLICE = 50_000
#: Bytes of text in a shard.
SHARD_BYTES = 6_000_000
#: A suffix position is kept of every so many.
SAMPLE = 8
_WORD = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)

SPAN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("word", "word_end", "start", "end")])
_ARROW_SPAN = pa.struct([(n, pa.int32()) for n in ("word", "word_end", "start", "end")])
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType()))]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.BinaryArray]:
    """Starts and ends of all words, in bytes of data, and the words; none crosses a document's end."""
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts).astype(np.int32), np.flatnonzero(ends).astype(np.int32) + 1
    stops = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    return starts, ends, pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(stops), pa.py_buffer(_LOWER[data[inside]])])


class Bits:
    """A bit vector with rank in constant time: packed words and the count before each."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & low)


class Wavelet:
    """A wavelet matrix: a Bits per bit of the symbols, highest first, with zeros before ones in the next level's order."""

    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        self.shifts = range(max(1, (n_symbols - 1).bit_length()) - 1, -1, -1)
        self.levels, self.zeros = [], []
        for shift in self.shifts:
            bit = symbols >> shift & 1 == 1
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        every = np.arange(n_symbols)
        self.first = self._down(every, np.zeros(n_symbols, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, level, zeros in zip(self.shifts, self.levels, self.zeros, strict=True):
            ones = level.rank(at)
            at = np.where(symbols >> shift & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self._down(symbols, at) - self.first[symbols]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its rank there."""
        symbols = np.zeros(len(at), np.int64)
        for shift, level, zeros in zip(self.shifts, self.levels, self.zeros, strict=True):
            bit, ones = level.get(at), level.rank(at)
            symbols |= bit.astype(np.int64) << shift
            at = np.where(bit, zeros + ones, at - ones)
        return symbols, at - self.first[symbols]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling. 0 is a terminator; terminators differ, in the order of their places."""
    stop = text == 0
    rank = np.where(stop, np.cumsum(stop) - 1, int(stop.sum()) + text.astype(np.int64))
    step = 1
    while True:
        ahead = np.zeros(len(rank), np.int64)
        ahead[:-step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + np.where(stop, 0, ahead)
        order = np.argsort(key, kind="stable")
        fresh = np.ones(len(order), np.int64)
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        rank[order] = np.cumsum(fresh) - 1
        if rank[order[-1]] == len(order) - 1:
            return order
        step *= 2


class FmIndex:
    """Backward search and location over a text of symbols 1 and up, with 0 as terminator at its end at least."""

    def __init__(self, text: np.ndarray, n_symbols: int) -> None:
        order = suffix_array(text)
        before = text[order - 1]  # of the first suffix, the last symbol: a terminator
        self.bwt = Wavelet(before.astype(np.int64), n_symbols)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        kept = (order % SAMPLE == 0) | (before == 0)  # a step back never crosses a terminator
        self.marks, self.samples = Bits(kept), order[kept]
        self.size = len(text)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's interval of suffixes that begin with it."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        live = np.arange(len(patterns))
        for column in patterns.T[::-1]:
            symbols = column[live].astype(np.int64)
            low[live] = self.smaller[symbols] + self.bwt.rank(symbols, low[live])
            high[live] = self.smaller[symbols] + self.bwt.rank(symbols, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffixes, by steps back to a sampled one."""
        out, live, rows, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(live):
            found = self.marks.get(rows)
            out[live[found]] = self.samples[self.marks.rank(rows[found])] + steps
            live, rows = live[~found], rows[~found]
            symbols, ranks = self.bwt.access(rows)
            rows = self.smaller[symbols] + ranks
            steps += 1
        return out


@dataclass
class Windows:
    """A block of benchmark items: the vocabulary, windows by length as rows of word numbers (from 1 on), and the items of each."""

    vocabulary: pa.BinaryArray
    names: list[str]
    patterns: dict[int, np.ndarray]
    owners: dict[int, tuple[np.ndarray, np.ndarray]]

    @property
    def shortest(self) -> int:
        return min(self.patterns, default=0)


def windows(items: list[tuple[str, str]], width: int = WIDTH) -> Windows:
    """The distinct windows of items (name, text)."""
    texts = pa.array([t for _, t in items], pa.string())
    starts, _, found = words(*flat(texts))
    coded = found.dictionary_encode()
    numbers = coded.indices.to_numpy().astype(np.int32) + 1
    ends = np.searchsorted(starts, flat(texts)[1])
    names, of_item = np.unique(np.array([n for n, _ in items], object), return_inverse=True) if items else ([], np.zeros(0, np.int64))
    sizes, patterns, owners = np.diff(ends), {}, {}
    for size in range(1, width + 1):
        own = np.flatnonzero(sizes == size if size < width else sizes >= width)
        if not len(own):
            continue
        counts = sizes[own] - size + 1
        rows = numbers[ragged(ends[own], counts)[:, None] + np.arange(size)]
        _, first, window = np.unique(rows.view(np.dtype((np.void, rows.itemsize * size)))[:, 0], return_index=True, return_inverse=True)
        pairs = np.unique(window * len(names) + np.repeat(of_item[own], counts))
        patterns[size] = rows[first]
        owners[size] = np.searchsorted(pairs, np.arange(len(first) + 1) * len(names)), (pairs % len(names)).astype(np.int32)
    return Windows(coded.dictionary, [*names], patterns, owners)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for sizes[i] places, back to back."""
    stops = np.cumsum(sizes)
    return np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(starts - (stops - sizes), sizes)


def occurrences(numbers: np.ndarray, run_edge: np.ndarray, sought: Windows) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, window, first word) of all occurrences in a shard. numbers: of its words, 0 for words of no item; run_edge: where a
    document begins."""
    inside = numbers > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1] | run_edge[1:]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | run_edge[1:]
    sizes = np.flatnonzero(last) + 1 - starts
    long = sizes >= sought.shortest
    starts, sizes = starts[long], sizes[long]
    if not len(starts):
        return []
    stops = np.cumsum(sizes + 1)
    text, place = np.zeros(int(stops[-1]), np.int64), np.full(int(stops[-1]), -1, np.int64)
    filled = np.ones(len(text), bool)
    filled[stops - 1] = False
    place[filled] = ragged(starts, sizes)
    text[filled] = numbers[place[filled]]
    index = FmIndex(text, len(sought.vocabulary) + 1)
    out = []
    for size, patterns in sought.patterns.items():
        low, high = index.search(patterns)
        hit = np.flatnonzero(high > low)
        counts = high[hit] - low[hit]
        out.append((size, np.repeat(hit, counts), place[index.locate(ragged(low[hit], counts))]))
    return out


def code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points before each byte place of a document."""
    return np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])[at]


def find(batch: pa.RecordBatch, blocks: Iterable[Windows]) -> tuple[np.ndarray, list[list[dict]], list[list[str]]]:
    """Of each document of a shard: number of words, spans of hit words, names of items."""
    data, offsets = flat(batch.column("__text"))
    n = len(offsets) - 1
    spans: list[list[dict]] = [[] for _ in range(n)]
    names: list[list[str]] = [[] for _ in range(n)]
    starts, ends, found = words(data, offsets)
    edges = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.diff(edges), spans, names
    begins = np.zeros(len(starts) + 1, bool)
    begins[edges] = True
    steps = np.zeros(len(starts) + 1, np.int64)
    for sought in blocks:
        numbers = pc.fill_null(pc.index_in(found, value_set=sought.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        pairs = []
        for size, window, at in occurrences(numbers, begins[:-1], sought):
            np.add.at(steps, at, 1)
            np.add.at(steps, at + size, -1)
            doc = np.searchsorted(edges, at, "right") - 1
            key = np.unique(doc * len(sought.patterns[size]) + window)
            ends_of, of = sought.owners[size]
            doc, window = np.divmod(key, len(sought.patterns[size]))
            counts = ends_of[window + 1] - ends_of[window]
            pairs.append(np.unique(np.repeat(doc, counts) * len(sought.names) + of[ragged(ends_of[window], counts)]))
        for key in np.unique(np.concatenate(pairs)) if pairs else []:
            names[key // len(sought.names)].append(sought.names[key % len(sought.names)])
    names = [sorted({*own}) for own in names]
    hit = np.cumsum(steps[:-1]) > 0
    first, last = hit.copy(), hit.copy()
    first[1:] &= ~hit[:-1] | begins[1:-1]
    last[:-1] &= ~hit[1:] | begins[1:-1]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    of = np.searchsorted(edges, first, "right") - 1
    for doc in np.unique(of):
        own = of == doc
        a, b, base = first[own], last[own], offsets[doc]
        points = code_points(data[base : offsets[doc + 1]], np.stack([starts[a] - base, ends[b] - base]))
        spans[doc] = [dict(zip(("word", "word_end", "start", "end"), map(int, x), strict=True)) for x in zip(a - edges[doc], b + 1 - edges[doc], *points, strict=True)]
    return np.diff(edges), spans, names


#: Fixed value: what a word is, for Java's regular expressions.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def sliced(benchmark: DataFrame, item: str, text: str, width: int) -> DataFrame:
    """(name, text, n) of the distinct items: words joined by spaces, divided into slices of at most SLICE windows, which they number."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("name"), F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct()
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = rows.select("name", F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)).alias("w")).where(F.size("w") > 0)
    count: Column = F.greatest(F.size("w") - (width - 1), F.lit(1))
    parts = found.select("name", "w", count.alias("of"), F.explode(F.sequence(F.lit(0), F.floor((count - 1) / SLICE).cast("int"))).alias("k"))
    n = F.least(F.col("of") - F.col("k") * SLICE, F.lit(SLICE))
    return parts.select("name", F.array_join(F.slice("w", F.col("k") * SLICE + 1, n + (width - 1)), " ").alias("text"), n.alias("n"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = WIDTH, item: str = "item_id", item_text: str = "text", block_windows: int = BLOCK_WINDOWS, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with n_words, spans (hit words: numbers of the first and after the last, and code points) and items (names, as sorted
    strings)."""
    spark = docs.sparkSession
    slices = materialize(sliced(benchmark, item, item_text, width), "benchmark-slices")
    count = -(-(slices.agg(F.sum("n")).first()[0] or 0) // block_windows)
    names = []
    for k in range(count):
        own = slices.where(F.pmod(F.xxhash64("name", "text"), F.lit(count)) == k).select("name", "text")
        block = fresh_path(spark, "benchmark-block")
        system, path = files.place(block)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        with system.open_output_stream(path) as out:
            out.write(pickle.dumps(windows([tuple(r) for r in own.collect()], width), 5))
        spark.sparkContext.addFile(block)
        names.append(block.rpartition("/")[2])

    def load(name: str) -> Windows:
        with open(SparkFiles.get(name), "rb") as block:
            return pickle.load(block)

    def make():
        held = [load(names[0])] if len(names) == 1 else None

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            n_words, spans, items = find(batch, held or map(load, names))
            return [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(_ARROW_SPAN)), pa.array(items, pa.list_(pa.string()))]

        return work

    return map_texts(docs, text, make, FIELDS, keep, limit=SHARD_BYTES)


def n_hit(spans: str = "spans") -> F.Column:
    """Hit words of a document."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["word_end"] - s["word"])


def without_spans(text: str = "text", spans: str = "spans") -> F.Column:
    """The text without its removal spans."""
    return F.expr(
        f"""CASE WHEN size(`{spans}`) = 0 THEN `{text}` ELSE array_join(transform(sequence(0, size(`{spans}`)), i ->
        substring(`{text}`, CASE WHEN i = 0 THEN 1 ELSE `{spans}`[greatest(i, 1) - 1].end + 1 END,
        CASE WHEN i = size(`{spans}`) THEN length(`{text}`) ELSE `{spans}`[least(i, size(`{spans}`) - 1)].start - CASE WHEN i = 0 THEN 0 ELSE `{spans}`[greatest(i, 1) - 1].end END END)), '') END"""
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
#: SQL for op1's rows, by joining all windows of both tables as text.
ORACLE = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents), items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, n, array_to_string(w[k : k + n - 1], ' ') AS gram FROM (
  SELECT item, w, least(len(w), {WIDTH}) AS n, unnest(range(1, CAST(len(w) - least(len(w), {WIDTH}) + 2 AS BIGINT))) AS k FROM items WHERE len(w) > 0)),
grams AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS gram FROM (
  SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS k FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item, n, k FROM grams JOIN windows USING (n, gram)),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
