"""The trie of conversation prefixes: member intervals by range minima over sorted common prefixes.

A conversation is the sequence of its turns, each a digest of 16 bytes of role and text. Sequences are sorted over the whole table and dealt to
blocks of about BLOCK_TURNS turns, each a range of that order. Within a block the turns that neighbours have in common (LCPs) go into a
sparse table of range minima. Every prefix that begins at a row is a candidate; its left and right extent are binary searches in that
table, each by itself, all candidates at once. A node's interval gives all the rest as sums over places: members; children, where the common
prefix is exactly the node; leaves, at the last row of each; and saved characters, as sum over (l, r] of the common prefix's characters less
those above the node.

A block knows the last sequence before it and the first after it. Nodes that cross such an edge are prefixes of the block's first or last
sequence; their parts are sums, so a grouped sum by key (a chained 128-bit hash of the prefix) makes them whole. So no node, however many
members it has, needs its rows in one task. The digest of a node's ends is one value over all their ids: within a block at once, for
crossing nodes by a sorted stream that holds one row.

A conversation's sequence of digests is one value (16 bytes a turn, 8 for its characters): a conversation meets in one row in that form,
its texts never do. Positions in it are counted in buckets of TURN_BUCKET turn numbers, so its rows are numbered by many tasks.

Defined results: the beginning that a conversation c shares is that of c - c % SHARE, % with the sign of c. Null role or text is empty. Turns go by turn, null first, rows of an equal turn by role, then by the digest of role and
text; repeated rows are turns like any other. Rows of null conv_id are one conversation; it has no beginning to share (h is 0), is
listed as "null" after all others in ends, and a node's conv_id is null only if it has no other member (2^63-1 stands for it inside).
A conversation that is rebuilt without turns is a member, and an end, of the root alone. An empty table has no nodes. Extra columns are
not used."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.decontaminate import ragged
from tallyloom.llm.tables import table
from tallyloom.session import materialize, ship

#: Turns of a block, about.
BLOCK_TURNS = 100_000
#: Turn numbers whose rows are put in order together.
TURN_BUCKET = 1024
#: Conversations share the beginning of that whose id is the next lower multiple of SHARE; fewer than HEADS turns of it.
SHARE, HEADS = 100, 6
BYTES = 16
NONE = (1 << 63) - 1
NO_ENDS = hashlib.sha256(b"").hexdigest()
ROOT = b"\0" * BYTES
FIELDS = "open boolean, end boolean, key binary, parent_key binary, conv long, depth long, parent_conv long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def numbered(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, pos (from 1), digest and chars of all turns."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_), 256)), 1, BYTES)
    bucket = F.coalesce(F.expr(f"`{turn}` div {TURN_BUCKET}"), F.lit(-(1 << 62)))
    rows = df.select(F.coalesce(F.col(conv).cast("long"), F.lit(NONE)).alias("conv"), bucket.alias("bucket"), F.col(turn).alias("turn"), role_.alias("role"), digest.alias("digest"), F.length(text_).cast("long").alias("chars"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy("conv", "bucket").agg(F.count("*").alias("n")).select("conv", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("conv", "bucket").orderBy(F.col("turn").asc_nulls_first(), "role", "digest"))
    return rows.withColumn("place", place).join(offsets, ["conv", "bucket"]).select("conv", (F.col("place") + F.col("before")).alias("pos"), "digest", "chars")


def shared_heads(conv: Column) -> Column:
    """How many turns a conversation takes from another one's beginning."""
    return F.when(conv == NONE, 0).otherwise(F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("int")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv, seq (its turns' digests, joined) and chars (array) of numbered turns, after each has taken its shared beginning."""
    heads = turns.where((F.col("conv") % SHARE == 0) & (F.col("pos") < HEADS)).groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("head"))
    base = F.when(F.col("conv") != NONE, F.col("conv") - F.col("conv") % SHARE)
    convs = turns.select("conv").distinct().withColumns({"base": base, "h": shared_heads(F.col("conv"))}).join(heads, "base", "left")
    taken = F.coalesce(F.slice("head", 1, F.col("h")), F.array().cast(heads.schema["head"].dataType))
    convs = convs.select("conv", "h", taken.alias("head"))
    own = turns.join(convs.select("conv", "h", (F.size("head") - F.col("h")).alias("shift")), "conv").where("pos > h").select("conv", (F.col("pos") + F.col("shift")).alias("pos"), "digest", "chars")
    rows = own.unionByName(convs.select("conv", F.inline("head")).withColumn("pos", F.col("pos").cast("long")))
    whole = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("rows"))
    whole = whole.select("conv", F.unhex(F.array_join(F.transform("rows", lambda r: F.hex(r["digest"])), "")).alias("seq"), F.transform("rows", lambda r: r["chars"]).alias("chars"))
    return convs.select("conv").join(whole, "conv", "left").select("conv", F.coalesce("seq", F.lit(b"")).alias("seq"), F.coalesce("chars", F.array().cast("array<bigint>")).alias("chars"))


class Minima:
    """A sparse table: minima over values[k : k + 2**j]."""

    def __init__(self, values: np.ndarray):
        self.rows, self.n = [values], len(values)
        while 2 << (len(self.rows) - 1) <= self.n:
            last, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima over values[low : high + 1]."""
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), self.rows[0].dtype)
        for j in np.unique(level):
            at = level == j
            out[at] = np.minimum(self.rows[j][low[at]], self.rows[j][high[at] + 1 - (1 << j)])
        return out

    def reach(self, start: np.ndarray, least: np.ndarray, right: bool) -> np.ndarray:
        """How many values from start on (before it, if not right) are all at least least: binary search by halving steps."""
        done = np.zeros(len(start), np.int64)
        for j in range(len(self.rows) - 1, -1, -1):
            row, step = self.rows[j], 1 << j
            low = start + done if right else start - done - step
            fits = (low >= 0) & (low + step <= self.n)
            fits[fits] = row[low[fits]] >= least[fits]
            done[fits] += step
        return done


def common(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Turns that each sequence has in common with the one before it: words has a digest's two halves."""
    least = np.minimum(sizes[:-1], sizes[1:])
    a, b = ragged(starts[:-1], least), ragged(starts[1:], least)
    begins = np.cumsum(least) - least
    unlike = np.where((words[a] == words[b]).all(1), np.repeat(least, least), np.arange(len(a)) - np.repeat(begins, least))
    out = np.zeros(len(least), np.int64)
    some = least > 0
    if some.any():
        out[some] = np.minimum.reduceat(unlike, begins[some])
    return out


def chain(seq: bytes, depth: int) -> list[bytes]:
    """Keys of a sequence's prefixes of 0 to depth turns."""
    keys = [ROOT]
    for d in range(depth):
        keys.append(xxhash.xxh3_128_digest(keys[-1] + seq[d * BYTES : (d + 1) * BYTES]))
    return keys


def block_nodes(convs: np.ndarray, seqs: list[bytes], chars: list[np.ndarray], before: bytes | None, after: bytes | None) -> dict[str, np.ndarray | list]:
    """Nodes and parts of nodes of a block of sorted sequences, and the ends of those that are parts (FIELDS without a type)."""
    m = len(seqs)
    every = [before or b"", *seqs, after or b""]
    sizes = np.fromiter(map(len, every), np.int64, m + 2) // BYTES
    words = np.frombuffer(b"".join(every), np.uint64).reshape(-1, 2)
    lcp = common(words, np.cumsum(sizes) - sizes, sizes)  # lcp[i]: of row i with the one before; lcp[m]: of the next block's first
    sizes = sizes[1:-1]
    edge = [-1 if before is None else lcp[0], -1 if after is None else lcp[m]]
    starts = np.cumsum(sizes) - sizes
    told = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *chars]))])

    inner = lcp[1:m]
    table_, least_conv = Minima(inner), Minima(convs)
    first = np.concatenate([[0], inner]) if m else inner  # shallowest depth that row 0 or a later row has alone, less one
    i = np.concatenate([[0], np.repeat(np.arange(m), sizes - first)])
    d = np.concatenate([[0], ragged(first + 1, sizes - first)])

    def extent(i: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return i - table_.reach(i, d, False), i + table_.reach(i, d, True)

    low, high = extent(i, d)
    above = np.where(d > 0, told[starts[i] + np.maximum(d - 1, 0)] - told[starts[i]], 0)
    kept = np.cumsum(np.concatenate([[0], told[starts[1:] + inner] - told[starts[1:]]]))
    n = high - low + 1
    saved = kept[high] - kept[low] - (n - 1) * above
    inherited = (low == 0) & (d <= edge[0])
    crossing = inherited | (high == m - 1) & (d <= edge[1]) | (d == 0)
    if edge[0] >= 0:
        saved[inherited] += told[starts[0] + edge[0]] - told[starts[0]] - above[inherited]
    next_lcp = np.concatenate([inner, [edge[1]]])
    leaf = np.concatenate([[0], np.cumsum(next_lcp < sizes)])
    # a row begins a child of the node at the depth that it has in common with the row before
    begins = np.flatnonzero(sizes[1:] > inner) + 1
    marks = np.sort(inner[begins - 1] * (m + 1) + begins)
    children = np.searchsorted(marks, d * (m + 1) + high, "right") - np.searchsorted(marks, d * (m + 1) + low, "right")
    children += np.where(inherited, (d == edge[0]) & (sizes[0] > d), sizes[low] > d)

    pd = np.maximum(d - 1, 0)
    plow, phigh = extent(i, pd)
    p_inherited = (plow == 0) & (pd <= edge[0])
    p_crossing = p_inherited | (phigh == m - 1) & (pd <= edge[1]) | (pd == 0)
    head_keys, tail_keys = chain(seqs[0], max(edge[0], 0)), chain(seqs[-1], max(edge[1], 0))
    key = [None if not c else head_keys[k] if h else tail_keys[k] for c, h, k in zip(crossing, inherited, d, strict=True)]
    parent_key = [None if k == 0 or not c else head_keys[pk] if h else tail_keys[pk] for c, h, pk, k in zip(p_crossing, p_inherited, pd, d, strict=True)]
    parent_conv = np.where(p_crossing, 0, least_conv.between(plow, phigh))

    same = np.concatenate([(inner == sizes[1:]) & (sizes[1:] == sizes[:-1]), [False]])
    stop = np.flatnonzero(~same)
    last = stop[np.searchsorted(stop, low)]  # of the rows that equal the interval's first
    ends, e_key, e_conv = [], [], []
    for a, b, k, at in zip(low.tolist(), last.tolist(), key, (sizes[low] == d).tolist(), strict=True):
        own = convs[a : b + 1] if at else convs[:0]
        if k is None:
            ends.append(hashlib.sha256(told_ids(own)).hexdigest() if at else NO_ENDS)
        else:
            ends.append(None)
            e_key += [k] * len(own)
            e_conv.append(own)
    e_conv = np.concatenate([convs[:0], *e_conv])
    more, zeros = len(e_conv), np.zeros(len(e_conv), np.int64)
    plus = lambda x, y=zeros: np.concatenate([x, y])
    return {
        "open": plus(crossing, zeros == 0), "end": plus(np.zeros(len(d), bool), zeros == 0), "key": key + e_key, "parent_key": parent_key + [None] * more,
        "conv": plus(least_conv.between(low, high), e_conv), "depth": plus(d), "parent_conv": pa.array(plus(parent_conv), mask=plus(p_crossing, zeros == 0)),
        "n_convs": plus(n), "n_children": plus(children), "n_leaves": plus(leaf[high + 1] - leaf[low]), "saved_tokens": plus(saved), "ends_sha256": ends + [None] * more,
    }


def told_ids(convs: np.ndarray) -> bytes:
    return ",".join("null" if c == NONE else str(c) for c in convs.tolist()).encode()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of the first column, which is sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            if held and held[0].column(0)[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _groups(batches):
        kind, seq = rows.column("kind").to_numpy(), rows.column("seq").to_pylist()
        own = np.flatnonzero(kind == 1)
        if not len(own):
            continue
        chars = [np.array(c.as_py(), np.int64) for c in rows.column("chars").take(pa.array(own))]
        found = block_nodes(rows.column("conv").to_numpy()[own], [seq[k] for k in own], chars, seq[0] if kind[0] == 0 else None, seq[-1] if kind[-1] == 2 else None)
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) if isinstance(c, np.ndarray) else pa.array(c, pa.string() if k == "ends_sha256" else pa.binary()) for k, c in found.items()], list(found))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each key's ids, which come in order."""
    row = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])
    key = state = None
    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy(), strict=True):
            if k != key:
                if key is not None:
                    yield row()
                key, state = k, hashlib.sha256(told_ids(np.array([c])))
            else:
                state.update(b"," + told_ids(np.array([c])))
    if key is not None:
        yield row()


def trie(sequences: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """A row for each distinct prefix of sequences (conv, seq, chars): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    spark = sequences.sparkSession
    ship(spark)
    sequences = materialize(sequences, "sequences")
    turns = sequences.agg(F.sum(F.size("chars") + 1)).first()[0] or 0
    blocks = max(1, -(-turns // block_turns))
    placed = materialize(sequences.repartitionByRange(blocks, "seq", "conv").withColumn("block", F.spark_partition_id()), "sorted")
    order = Window.orderBy("block")  # a row for each block
    edges = placed.groupBy("block").agg(F.min("seq").alias("head"), F.max("seq").alias("tail")).select("block", F.lag("tail").over(order).alias("before"), F.lead("head").over(order).alias("after"))
    edges = edges.select("block", F.inline(F.array(F.struct(F.lit(0).alias("kind"), F.col("before").alias("seq")), F.struct(F.lit(2).alias("kind"), F.col("after").alias("seq"))))).where("seq IS NOT NULL")
    rows = placed.select("block", F.lit(1).alias("kind"), "seq", "conv", "chars").unionByName(edges.select("block", "kind", "seq", F.lit(0).cast("long").alias("conv"), F.array().cast("array<bigint>").alias("chars")))
    nodes = materialize(rows.repartition(blocks, "block").sortWithinPartitions("block", "kind", "seq", "conv").mapInArrow(_find, FIELDS), "nodes")

    sums = {c: F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")}
    parts = nodes.where("open AND NOT end").groupBy("key", "depth").agg(F.min("conv").alias("conv"), F.max("parent_key").alias("parent_key"), *sums.values())
    ends = nodes.where("end").select("key", "conv").repartition("key").sortWithinPartitions("key", "conv").mapInArrow(_ends, "key binary, ends_sha256 string")
    crossing = materialize(parts.join(ends, "key", "left").fillna(NO_ENDS, "ends_sha256"), "crossing")
    above = crossing.select(F.col("key").alias("parent_key"), F.col("conv").alias("above"))
    columns = [_known("conv").alias("conv_id"), "depth", _known("parent_conv").alias("parent_conv_id"), *sums, "ends_sha256"]
    inside = nodes.where("NOT open AND parent_key IS NULL")
    below = nodes.where("NOT open AND parent_key IS NOT NULL").join(above, "parent_key").withColumn("parent_conv", F.col("above"))
    crossing = crossing.join(above, "parent_key", "left").withColumn("parent_conv", F.col("above"))
    return inside.select(*columns).unionByName(below.select(*columns)).unionByName(crossing.select(*columns))


def _known(conv: str) -> Column:
    return F.nullif(F.col(conv), F.lit(NONE))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return trie(rebuilt(materialize(numbered(given), "turns")))


#: SQL for op11's rows: every conversation's prefixes, named by the digest of their turns; what lies below a node hangs on it by the members.
ORACLE = """
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
bits AS (SELECT x, list_reduce(list_prepend(x, range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END) AS v FROM (SELECT unnest(range(256)) AS x)),
lookup AS (SELECT list(v ORDER BY x) AS v FROM bits),
convs AS (
  SELECT c, c - c % 100 AS base,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
      lambda v, x: xor(v // 256, lookup.v[CAST(xor(v % 256, x) AS BIGINT) + 1]))) % 6 AS h
  FROM (SELECT DISTINCT c FROM turns) CROSS JOIN lookup),
taken AS (SELECT convs.c, pos, role, text FROM convs JOIN turns ON turns.c = base AND pos <= h),
own AS (SELECT convs.c, pos - h + (SELECT count(*) FROM taken WHERE taken.c = convs.c) AS pos, role, text FROM convs JOIN turns ON turns.c = convs.c AND pos > h),
whole AS (SELECT c, pos AS d, role, text FROM taken UNION ALL SELECT c, pos, role, text FROM own),
named AS (
  SELECT c, d, length(text) AS chars, sha256(string_agg(length(role) || ':' || role || sha256(text), '') OVER (PARTITION BY c ORDER BY d)) AS k FROM whole
  UNION ALL SELECT c, 0, 0, '' FROM convs),
depths AS (SELECT c, max(d) AS n FROM named GROUP BY c),
nodes AS (SELECT d, k, min(c) AS c, count(*) AS n_convs, any_value(chars) AS chars, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = n), '') AS ends FROM named JOIN depths USING (c) GROUP BY d, k),
up AS (SELECT nodes.d, nodes.k, p.k AS parent FROM nodes JOIN named p ON p.c = nodes.c AND p.d = nodes.d - 1),
kids AS (SELECT d - 1 AS d, parent AS k, count(*) AS n FROM up GROUP BY 1, 2),
below AS (SELECT a.d, a.k, count(*) FILTER (WHERE kids.n IS NULL) AS n_leaves, sum((u.n_convs - 1) * u.chars) AS saved
  FROM nodes u JOIN named a ON a.c = u.c AND a.d <= u.d LEFT JOIN kids ON kids.d = u.d AND kids.k = u.k GROUP BY a.d, a.k)
SELECT nodes.c AS conv_id, nodes.d AS depth, p.c AS parent_conv_id, nodes.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(nodes.ends) AS ends_sha256
FROM nodes JOIN below USING (d, k) LEFT JOIN kids USING (d, k) LEFT JOIN up USING (d, k) LEFT JOIN nodes p ON p.d = nodes.d - 1 AND p.k = up.parent
"""
