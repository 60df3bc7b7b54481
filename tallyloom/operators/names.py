"""Names that are like a written one: all names of a registry against a set of queries, in blocks, by an upper bound before the exact score.

A name's score is the largest of: 1 for equality, a fixed score for containment, token Jaccard, and the weighted ratio of matching blocks. That
ratio has no expression in Catalyst and costs the product of both lengths. It is at most twice the letters that both have (with repeats) over both
lengths, which is a vector operation over a block's letter counts. Candidates are taken by falling bound, and the search ends where the bound falls
below what the query's list already holds, or below the cutoff; so few pairs are scored. (Longer grams can't bound it: blocks may be single
letters. Prefixes of the letters, at a cutoff of 0.45, hold 71 % of them, which nearly all names share.)

Queries are dealt to parts and names to blocks, each pair of these is a task; lists of blocks are merged by a ranked window. Most queries of a large
set are like no name at all. These are sifted out before in runs of many queries: by the same bound, then by the longest common subsequence, which
holds all matching blocks, of those pairs that the bound lets pass."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import materialize, ship

#: Fixed values of the score.
HELD, HELD_SHORT, SHORT, SHARED, JACCARD, RATIO = 0.88, 0.74, 4, 0.40, 0.45, 0.65
#: Least ratio of a close name; names less alike that share no token are no candidates.
CLOSE = 0.45
#: Names and queries of a task, about; queries of a task that sifts.
BLOCK, PART, MANY = 20_000, 2_000, 50_000
#: Cells of a table of queries by texts that are held at once, about.
CELLS = 1_000_000

_LETTERS = np.full(128, 37)
_LETTERS[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = np.arange(36)
_LETTERS[ord(" ")] = 36


def letters(text: str) -> np.ndarray:
    """How often a normalised text has each letter; all others count as one kind, so sums only grow."""
    return np.bincount(_LETTERS[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 127)], minlength=38)


def letters_each(texts: list[str]) -> np.ndarray:
    """The same for many texts, a row for each."""
    own = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    kinds = _LETTERS[np.minimum(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), 127)]
    return np.bincount(own * 38 + kinds, minlength=38 * len(texts)).reshape(-1, 38)


def common_subsequence(one: list[str], two: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair of texts, for all pairs in step."""
    a, b = (np.array(x, "U").view(np.uint32).reshape(len(x), -1).T for x in (one, two))
    b = np.where(b == 0, 1, b)  # what fills up a shorter text is unlike in both
    best = np.zeros((len(b) + 1, len(one)), np.int32)
    for letter in a:
        np.maximum.accumulate(np.maximum(best[1:], best[:-1] + (b == letter)), axis=0, out=best[1:])
    return best[-1]


class Block:
    """Texts, with letter counts and tokens."""

    def __init__(self, texts: list[str]):
        self.texts, self.sizes = texts, np.fromiter(map(len, texts), np.int64, len(texts))
        self.counts = letters_each(texts).astype(np.int32)
        self.tokens = [frozenset(t.split()) for t in texts]
        self.holding = defaultdict(list)
        for k, own in enumerate(self.tokens):
            for t in own:
                self.holding[t].append(k)

    def common(self, text: str) -> np.ndarray:
        """Letters that each text has in common with this one."""
        return np.minimum(self.counts, letters(text)).sum(1)

    def runs(self, queries: list[str], least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Runs of queries: the number of the first, the letters that each query has in common with each text, and whether these allow a ratio of least."""
        sizes, counts = np.fromiter(map(len, queries), np.int64, len(queries)), letters_each(queries)
        longest = max(sizes.max(initial=0), self.sizes.max(initial=0))
        kind, most = (np.uint8, 255) if longest < 255 else (np.int32, 2**31 - 1)
        counts, texts = counts.astype(kind), np.ascontiguousarray(self.counts.T.astype(kind))
        held, rows = texts.any(1), max(1, CELLS // max(1, len(self.texts)))
        for at in range(0, len(queries), rows):
            own = counts[at : at + rows]
            both = np.zeros((len(own), len(self.texts)), kind)
            for k in np.flatnonzero(own.any(0) & held):
                both += np.minimum(own[:, k, None], texts[k])
            each, which = np.unique(sizes[at : at + rows], return_inverse=True)
            need = np.minimum(np.ceil((each[:, None] + self.sizes) * (least / 2) - 1e-9), most).astype(kind)
            yield at, both, both >= need[which]


def ranked_of(query: str, block: Block, owners: np.ndarray, names: list[str], limit: int) -> tuple[list[tuple[float, int]], int]:
    """(score, owner) of the query's best owners of candidates, and how many pairs took the ratio."""
    both = block.common(query)
    best: dict[int, float] = {}

    def hold(k: int, score: float) -> None:
        best[owners[k]] = max(best.get(owners[k], 0.0), round(score, 6))

    tokens = frozenset(query.split())
    for k in {k for t in tokens for k in block.holding.get(t, ())}:
        own = block.tokens[k]
        hold(k, SHARED + JACCARD * len(own & tokens) / len(own | tokens))
    for k in np.flatnonzero((both == block.sizes) | (both == len(query))).tolist():
        text = block.texts[k]
        if text == query:
            hold(k, 1.0)
        elif text in query or query in text:
            hold(k, HELD if len(text) >= SHORT else HELD_SHORT)
    bound = 2 * both / (block.sizes + len(query))
    scored = 0
    top = heapq.nlargest(limit, best.values())
    for k in np.argsort(-bound, kind="stable").tolist():
        least = max(top[-1] - 1e-6 if len(top) == limit else 0.0, CLOSE * RATIO - 1e-9)
        if bound[k] * RATIO < least:
            break
        if bound[k] * RATIO <= best.get(owners[k], 0.0):
            continue
        scored += 1
        ratio = SequenceMatcher(None, query, block.texts[k]).ratio()
        if ratio >= CLOSE and ratio * RATIO > best.get(owners[k], 0.0):
            hold(k, ratio * RATIO)
            top = heapq.nlargest(limit, best.values())
    order = sorted(best.items(), key=lambda x: (-x[1], names[x[0]], x[0]))
    return [(s, o) for o, s in order[:limit]], scored


def reaching_of(queries: list[str], block: Block, least: float) -> list[int]:
    """Numbers of the queries that any text of the block scores with at least `least`."""
    good = np.zeros(len(queries), bool)
    for q, query in enumerate(queries):
        tokens = frozenset(query.split())
        good[q] = any(round(SHARED + JACCARD * len(own & tokens) / len(own | tokens), 6) >= least for own in map(block.tokens.__getitem__, {k for t in tokens for k in block.holding.get(t, ())}))
    left = np.flatnonzero(~good)
    asked = [queries[q] for q in left]
    for at, both, close in block.runs(asked, max(CLOSE, (least - 1e-6) / RATIO)):
        sizes = np.fromiter(map(len, asked[at : at + len(both)]), np.int64, len(both))
        for i, k in np.argwhere((both == block.sizes) | (both == sizes[:, None])).tolist():
            query, text = asked[at + i], block.texts[k]
            if text in query or query in text:
                good[left[at + i]] |= (1.0 if text == query else HELD if len(text) >= SHORT else HELD_SHORT) >= least
        pairs = np.argwhere(close & ~good[left[at : at + len(both)], None]).tolist()
        step = max(1, CELLS // max(1, sizes.max(initial=1), block.sizes.max(initial=1)))
        for some in (pairs[j : j + step] for j in range(0, len(pairs), step)):
            one, two = [asked[at + i] for i, _ in some], [block.texts[k] for _, k in some]
            for (i, _), a, b, n in zip(some, one, two, common_subsequence(one, two).tolist(), strict=True):
                if not good[left[at + i]] and 2 * n / (len(a) + len(b)) * RATIO >= least - 1e-6:
                    ratio = SequenceMatcher(None, a, b).ratio()
                    good[left[at + i]] = ratio >= CLOSE and round(ratio * RATIO, 6) >= least
    return np.flatnonzero(good).tolist()


def nearest_of(query: str, block: Block, limit: int) -> tuple[list[tuple[float, int]], int]:
    """(ratio, number) of the closest texts of a ratio of CLOSE at least, equal ones by falling name."""
    bound = 2 * block.common(query) / (block.sizes + len(query))
    top: list[tuple[float, str, int]] = []
    scored = 0
    for k in np.argsort(-bound, kind="stable").tolist():
        if bound[k] < max(CLOSE, top[0][0] if len(top) == limit else 0.0) - 1e-12:
            break
        scored += 1
        ratio = SequenceMatcher(None, block.texts[k], query).ratio()
        if ratio >= CLOSE:
            (heapq.heappushpop if len(top) == limit else heapq.heappush)(top, (ratio, block.texts[k], k))
    return [(r, k) for r, _, k in sorted(top, reverse=True)], scored


def _met(queries: DataFrame, names: DataFrame, key: str, work, schema: str, block: int, part: int) -> DataFrame:
    """The rows of work(a block's names)(a part's queries) for all blocks and parts. Both are written tables, as two counts size the grid; each pair is a partition of
    its own, as its work has little to do with its bytes."""
    ship(queries.sparkSession)
    blocks, parts = max(1, -(-names.count() // block)), max(1, -(-queries.count() // part))
    left = queries.withColumn("part", F.pmod(F.xxhash64("norm"), F.lit(parts))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = names.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def each(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(known):
            out = work(known.sort_values([key]).reset_index(drop=True))(asked)
        return pd.DataFrame(out, columns=columns)

    columns = [c.split()[0].strip("`") for c in schema.split(", ")]
    left, right = (side.repartition(blocks * parts, "block", "part").groupBy("block", "part") for side in (left, right))
    return left.cogroup(right).applyInPandas(each, schema)


def _listed(queries: DataFrame, names: DataFrame, key: str, work, block: int, part: int) -> DataFrame:
    """query, key, name, score and scored of each block's list for each query: work(block's rows) gives, for a query, (score, row) and a count."""

    def lists(known: pd.DataFrame):
        find = work(known)

        def rows(asked: pd.DataFrame) -> list[tuple]:
            out = []
            for query, norm in zip(asked["query"], asked["norm"], strict=True):
                found, scored = find(norm)
                out += [(query, known[key][k], known["name"][k], s, 0) for s, k in found]
                out.append((query, None, None, None, scored))
            return out

        return rows

    return _met(queries, names, key, lists, f"query string, `{key}` string, name string, score double, scored long", block, part)


def _sifted(queries: DataFrame, names: DataFrame, key: str, work, block: int) -> DataFrame:
    """The queries whose numbers work(block's rows) gives for a list of them, with any block."""

    def some(known: pd.DataFrame):
        find = work(known)
        return lambda asked: [(asked["query"].iloc[k],) for k in find(asked["norm"].tolist())]

    found = materialize(_met(queries, names, key, some, "query string", block, MANY), "sifted")
    return queries.join(found.distinct(), "query", "left_semi")


def _texts(products: DataFrame, key: str) -> DataFrame:
    """key, name, and texts: all that a product is called."""
    texts = F.array_distinct(F.filter(F.concat(F.array("normalized_product_name", "product_id_norm"), "search_aliases_norm"), lambda t: t != ""))
    return products.select(key, F.coalesce("normalized_product_name", F.lit("")).alias("name"), texts.alias("texts"))


def reaching(queries: DataFrame, products: DataFrame, least: float, key: str = "product_key", block: int = BLOCK) -> DataFrame:
    """The queries (query, norm) that any product scores with at least `least`."""
    queries, names = materialize(queries, "queries"), materialize(_texts(products, key), "names")

    def work(known: pd.DataFrame):
        held = Block([t for own in known["texts"] for t in own])
        return lambda norms: reaching_of(norms, held, least)

    return _sifted(queries, names, key, work, block)


def ranked(queries: DataFrame, products: DataFrame, limit: int = 5, key: str = "product_key", block: int = BLOCK, part: int = PART) -> DataFrame:
    """query, key, score and rank of the best products of queries (query, norm), and scored: the pairs that took the ratio, in the row of rank 1."""
    queries, names = materialize(queries, "queries"), materialize(_texts(products, key), "names")

    def work(known: pd.DataFrame):
        flat = [(k, t) for k, own in enumerate(known["texts"]) for t in own]
        held, owners, titles = Block([t for _, t in flat]), np.array([k for k, _ in flat], int), known["name"].tolist()
        return lambda norm: ranked_of(norm, held, owners, titles, limit)

    found = materialize(_listed(queries, names, key, work, block, part), "ranked")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "name", key)
    scored = found.groupBy("query").agg(F.sum("scored").alias("scored"))
    best = found.where(F.col(key).isNotNull()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return best.drop("scored").join(scored, "query").select("query", key, "score", "rank", F.when(F.col("rank") == 1, F.col("scored")).otherwise(0).alias("scored"))


def nearest(queries: DataFrame, products: DataFrame, limit: int = 5, key: str = "product_key", block: int = BLOCK, part: int = PART) -> DataFrame:
    """query and nearest: the closest names of queries (query, norm), a row for each query that has any."""
    queries, names = materialize(queries, "queries"), materialize(products.where("normalized_product_name <> ''").select(key, F.col("normalized_product_name").alias("name")), "names")

    def any_near(known: pd.DataFrame):
        held = Block(known["name"].tolist())
        return lambda norms: [at + k for at, _, close in held.runs(norms, CLOSE) for k in np.flatnonzero(close.any(1)).tolist()]

    def work(known: pd.DataFrame):
        held = Block(known["name"].tolist())
        return lambda norm: nearest_of(norm, held, limit)

    near = materialize(_sifted(queries, names, key, any_near, block), "near")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("name"), key)
    best = _listed(near, names, key, work, block, part).where(F.col(key).isNotNull()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return best.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda r: r["name"]).alias("nearest"))
