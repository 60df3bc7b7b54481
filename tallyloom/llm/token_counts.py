"""Token counts by rank-synchronous array merging.

The distinct pre-tokens of a batch lie in one ragged numpy array of symbols. In every round each sequence looks up the rank of all its
adjacent pairs, finds the lowest, and merges all places of that pair at once; sequences without a ranked pair leave. What is counted
is the symbols that survive. That equals merging one pair at a time, as a pair that holds a merged symbol never ranks before the merge
that made the symbol.

Rounds over whole arrays would make a long unbroken sequence quadratic. Sequences of more than LONG symbols therefore lie in arrays with
neighbour links: places wait by the rank of their pair, the lowest rank is merged at all its places at once, and only the pairs beside a
merge get a new rank. So a symbol is looked at once for each merge beside it, however long its sequence is.

Defined results: a null or empty text has 0 tokens and bytes. A special string inside a text is one token, as by the library's
default. Extra columns stay; a column that has the name of an output is replaced. Rows are independent, so ties and repeated rows need
no rule."""

from __future__ import annotations

import functools
import heapq
import json
from dataclasses import dataclass
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.arrowtext import chunk_starts, flat, map_texts, row_sums, unique_chunks
from tallyloom.llm.tables import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
_NONE = np.iinfo(np.int32).max
#: Symbols of a sequence above which only the pairs beside a merge are looked up again.
LONG = 512


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else the next from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


@dataclass
class Merges:
    """A tokenizer file's merges: sorted keys of pairs of ids, with rank and result; the ids of bytes; the special strings."""

    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    of_byte: np.ndarray
    special: regex.Pattern | None
    words: regex.Pattern

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or _NONE) and result of each pair."""
        want = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], _NONE), self.made[at]

    def count(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Symbols that survive in each of the ragged sequences."""
        out = sizes.astype(np.int64)
        long, short = sizes > LONG, (sizes > 1) & (sizes <= LONG)
        if long.any():
            out[long] = self.count_long(symbols[np.repeat(long, sizes)], sizes[long])
        live = np.flatnonzero(short)
        symbols = symbols[np.repeat(short, sizes)]
        sizes = sizes[live]
        while len(live):
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            ranks, made = self.lookup(symbols[:-1], symbols[1:])
            ranks, made = np.append(ranks, _NONE), np.append(made, 0)
            ranks[starts[1:] - 1] = _NONE  # a sequence's last symbol has no partner
            chosen = ranks == np.repeat(np.minimum.reduceat(ranks, starts), sizes)
            chosen &= ranks != _NONE
            # x x x: of overlapping places of one pair, every second one from the left
            places = np.flatnonzero(chosen)
            first = np.ones(len(places), bool)
            first[1:] = np.diff(places) > 1
            run = np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - run) % 2 == 0]
            symbols[places] = made[places]
            gone = np.zeros(len(symbols), bool)
            gone[places + 1] = True
            left = sizes - np.add.reduceat(gone, starts, dtype=np.int64)
            stay = (left < sizes) & (left > 1)
            out[live] = left
            symbols = symbols[~gone & np.repeat(stay, sizes)]
            live, sizes = live[stay], left[stay]
        return out


    def count_long(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """As count(), for long sequences: the places of a rank, in all sequences, merge together, lowest rank first."""
        n, ends = len(symbols), np.cumsum(sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[ends[:-1]], alive = n, -1, np.ones(n, bool)
        before[0] = -1
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def wait(at: np.ndarray) -> None:
            at = at[after[at] < n]
            found = self.lookup(symbols[at], symbols[after[at]])[0]
            at, found = at[found != _NONE], found[found != _NONE]
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            starts = np.flatnonzero(np.diff(found, prepend=-1))
            for rank, own in zip(found[starts].tolist(), np.split(at, starts[1:]) if len(at) else (), strict=True):
                if rank not in waiting:
                    waiting[rank] = []
                    heapq.heappush(ranks, rank)
                waiting[rank].append(own)

        wait(np.arange(n))
        while ranks:
            rank = heapq.heappop(ranks)
            places = np.unique(np.concatenate(waiting.pop(rank)))
            places = places[alive[places] & (after[places] < n)]
            found, made = self.lookup(symbols[places], symbols[after[places]])
            places, made = places[found == rank], made[found == rank]
            if not len(places):
                continue
            # x x x: of overlapping places, every second one from the left
            first = np.ones(len(places), bool)
            first[1:] = after[places[:-1]] != places[1:]
            run = np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))
            taken = (np.arange(len(places)) - run) % 2 == 0
            places = places[taken]
            gone = after[places]
            symbols[places], alive[gone] = made[taken], False
            after[places] = after[gone]
            linked = after[places] < n
            before[after[places[linked]]] = places[linked]
            left = before[places]
            wait(np.unique(np.concatenate([places, left[left >= 0]])))
        return np.add.reduceat(alive, ends - sizes, dtype=np.int64)


@functools.cache
def merges(path: str) -> Merges:
    """The merges of a byte-level BPE tokenizer file, once per Python worker."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocab, rules = spec["model"]["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
    keys = np.array([vocab[a] << 20 | vocab[b] for a, b in rules], np.int64)
    order = np.argsort(keys)
    made = np.array([vocab[a + b] for a, b in rules], np.int32)
    special = [regex.escape(t["content"]) for t in spec.get("added_tokens", [])]
    space = r"\p{White_Space}"
    words = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{space}\p{{L}}\p{{N}}]+|{space}+(?![^{space}])|{space}+"
    return Merges(keys[order], order.astype(np.int32), made[order], np.array([vocab[c] for c in byte_symbols()], np.int32), regex.compile("|".join(special)) if special else None, regex.compile(words))


def chunk_counts(chunks: list[bytes], rules: Merges) -> np.ndarray:
    """Tokens of each chunk."""
    extra = np.zeros(len(chunks), np.int64)
    parts: list[list[bytes]] = []
    for k, chunk in enumerate(chunks):
        if chunk.isalpha() or chunk[:1] == b" " and chunk[1:].isalpha():  # of ASCII letters: one pre-token
            parts.append([chunk])
            continue
        text = chunk.decode()
        pieces = [text]
        if rules.special and "<" in text:
            pieces = rules.special.split(text)
            extra[k] = len(pieces) - 1
        parts.append([w.encode() for p in pieces for w in rules.words.findall(p)])
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    every = pa.array(chain.from_iterable(parts), pa.binary(), size=int(sizes.sum())).dictionary_encode()
    data, ends = flat(every.dictionary)
    counts = rules.count(rules.of_byte[data], np.diff(ends))[every.indices.to_numpy()] if len(data) else np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(counts)])
    stops = np.cumsum(sizes)
    return total[stops] - total[stops - sizes] + extra


def count_tokens(df: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, keep: list[str] | None = None) -> DataFrame:
    """df with n_bytes (of UTF-8) and n_tokens."""

    def make():
        rules = merges(tokenizer)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            data, offsets = flat(batch.column("__text"))
            starts = chunk_starts(data, offsets)
            at, chunks = unique_chunks(data, starts)
            counts = chunk_counts(chunks.to_pylist(), rules)
            return [pa.array(np.diff(offsets)), pa.array(row_sums(counts[at], starts, offsets))]

        return work

    return map_texts(df, text, make, [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())], keep)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
