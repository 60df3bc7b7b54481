"""Byte-level BPE encoding and decoding by the tiktoken library and a local rank file.

Texts are split at safe boundaries (arrowtext.chunk_starts); each distinct chunk of a batch is encoded once. A chunk of more than LONG
bytes, such as a run of white space, has no safe boundary: its pre-tokens are found by a regular expression without look-behind or nested
repeats, in time linear in its length, and each goes to the library's encoder of single pieces, as the library's own splitter overflows
its stack on long runs. Decoding looks raw bytes up by id, without going through text, so any list of ids can be decoded, also one that
ends inside a character.

Defined results: a null or empty text has no ids and decodes to no bytes. Ids outside the vocabulary raise. Extra columns stay; a
column that has the name of an output is replaced. Rows are independent, so ties and repeated rows need no rule."""

from __future__ import annotations

import base64
import functools
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.arrowtext import chunk_starts, flat, map_texts, row_sums, unique_chunks
from tallyloom.llm.tables import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Bytes of text or ids in a batch.
BATCH = 4_000_000
#: Bytes of a chunk above which its pre-tokens are found outside the library.
LONG = 20_000


@functools.cache
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The library's encoder, once per Python worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def splitter(pattern: str) -> regex.Pattern:
    """The pattern for the regex module, whose own white space holds four control characters more than Unicode's."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


@functools.cache
def token_bytes(path: str, pattern: str) -> pa.BinaryArray:
    """The bytes of each id; null for ids that the file leaves out."""
    own = encoding(path, pattern)
    known = dict.fromkeys(range(own.max_token_value + 1))
    known.update({rank: token for token, rank in own._mergeable_ranks.items()})
    return pa.array(list(known.values()), pa.binary())


class Codec:
    """Encodes and decodes batches as flat arrays."""

    def __init__(self, ranks: str, pattern: str) -> None:
        self.library, self.table, self.pieces = encoding(ranks, pattern), token_bytes(ranks, pattern), splitter(pattern)

    def chunk(self, data: bytes) -> list[int]:
        """The ids of one chunk."""
        if len(data) <= LONG:
            return self.library.encode_ordinary(data.decode())
        out: list[int] = []
        for piece in self.pieces.finditer(data.decode()):
            out += self.library._encode_single_piece(piece.group().encode())
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids by text, and all ids."""
        data, offsets = flat(texts)
        starts = chunk_starts(data, offsets)
        at, chunks = unique_chunks(data, starts)
        lists = [*map(self.chunk, chunks.to_pylist())]
        sizes = np.fromiter(map(len, lists), np.int32, len(lists))
        ids = np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum()))
        ragged = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(ids))
        return row_sums(sizes[at], starts, offsets), ragged.take(pa.array(at)).flatten().to_numpy() if len(at) else ids

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
        """The bytes of each row; ends: of the rows in ids, from 0 on."""
        taken = self.table.take(pa.array(ids.astype(np.int32, copy=False)))
        if taken.null_count:
            raise ValueError("an id is not in the rank file")
        out, places = flat(taken)
        at = places[ends].astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(out)])


def _binary(ids: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4", copy=False))])


IDS, N_TOKENS, DECODED = T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.BinaryType())


def encode(df: DataFrame, text: str = "text", ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """df with ids (binary, little-endian unsigned 32-bit) and n_tokens."""

    def make():
        codec = Codec(ranks, pattern)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            n, ids = codec.encode(batch.column("__text"))
            return [_binary(ids, np.concatenate([[0], np.cumsum(n)])), pa.array(n, pa.int64())]

        return work

    return map_texts(df, text, make, [IDS, N_TOKENS], limit=BATCH)


def decode(df: DataFrame, ids: str = "ids", ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """df with decoded (binary): the bytes of the tokens back to back."""

    def make():
        codec = Codec(ranks, pattern)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            data, offsets = flat(batch.column("__text"))
            return [codec.decode(data.view("<u4"), offsets // 4)]

        return work

    return map_texts(df, ids, make, [DECODED], limit=BATCH)


def round_trip(df: DataFrame, text: str = "text", ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN, keep: list[str] | None = None) -> DataFrame:
    """df with ids, n_tokens and decoded, which is made of the packed ids: one pass, so one Python worker per task."""

    def make():
        codec = Codec(ranks, pattern)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            n, ids = codec.encode(batch.column("__text"))
            ends = np.concatenate([[0], np.cumsum(n)])
            packed = _binary(ids, ends)
            return [packed, pa.array(n, pa.int64()), codec.decode(flat(packed)[0].view("<u4"), ends)]

        return work

    return map_texts(df, text, make, [IDS, N_TOKENS, DECODED], keep, limit=BATCH)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes that they decode to."""
    coded = round_trip(docs.select("doc_id", "text"), keep=["doc_id"])
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
