"""Token ids in files of fixed-width packed bits.

Every id takes the bits that the vocabulary needs. A file holds blocks of BLOCK_IDS ids, each from a byte boundary on, then the
offsets of the blocks, the documents' ids and starts, and a trailer that says where these are. numpy packs and unpacks whole blocks, and
any range of ids can be read by reading its blocks alone.

write() sorts documents by range over the cluster, so no task holds more than a partition; each task streams its partition into one
file under a temporary name and renames it when complete. The manifest is a table with a row per file; read() sums its counts for the
global starts and reads the files in parallel.

Defined results: a null or empty text has the end id alone. Documents stand in ascending order of doc_id, null first; rows of equal
doc_id by their text's hash and length, so that a hot doc_id splits over tasks; repeated rows are all written. An empty table has no
files. Other columns are not written. An id that the width cannot hold raises."""

from __future__ import annotations

import functools
import io
import os
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm import files
from tallyloom.llm.arrowtext import by_bytes, chunk_starts, flat, row_sums, unique_chunks
from tallyloom.llm.tables import table
from tallyloom.session import fresh_path, materialize, ship

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
MAGIC = b"TLPACK01"
BLOCK_IDS = 1 << 16
#: Ids that a reader puts into one batch.
READ_IDS = 1 << 21


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in bits each, lowest bit first, up to a whole byte."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits((ids[:, None] >> np.arange(bits, dtype=np.uint32) & 1).astype(np.uint8), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids of packed data."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    wide = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (wide.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


class PackedWriter:
    """Writes documents' ids to an open binary file; holds less than a block of them."""

    def __init__(self, out: io.RawIOBase, bits: int, block_ids: int = BLOCK_IDS) -> None:
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.rest, self.blocks, self.at, self.n_ids = np.zeros(0, np.uint32), [], 0, 0
        self.docs: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def _block(self, ids: np.ndarray) -> None:
        self.blocks.append(self.at)
        data = pack(ids, self.bits)
        self.out.write(data)
        self.at += len(data)

    def add(self, docs: np.ndarray, nulls: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(docs), self.nulls.append(nulls), self.sizes.append(sizes)
        self.n_ids += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // self.block_ids * self.block_ids
        for k in range(0, whole, self.block_ids):
            self._block(ids[k : k + self.block_ids])
        self.rest = ids[whole:]

    def close(self) -> tuple[int, int]:
        """Number of documents and of ids."""
        if len(self.rest):
            self._block(self.rest)
        docs, nulls, sizes = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((self.docs, np.int64), (self.nulls, bool), (self.sizes, np.int64)))
        for part in (np.array([*self.blocks, self.at], "<u8"), docs.astype("<i8"), nulls.astype("u1"), np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")):
            self.out.write(part.tobytes())
        self.out.write(struct.pack("<IIQQQ", self.bits, self.block_ids, self.n_ids, len(docs), self.at) + MAGIC)
        return len(docs), self.n_ids


class PackedReader:
    """Random access to a packed file."""

    def __init__(self, source: pa.NativeFile) -> None:
        self.source, end = source, source.size()
        source.seek(end - 40)
        tail = source.read(40)
        if tail[-8:] != MAGIC:
            raise ValueError("not a packed token file, or not a whole one")
        self.bits, self.block_ids, self.n_ids, self.n_docs, body = struct.unpack("<IIQQQ", tail[:32])
        source.seek(body)
        n_blocks = -(-self.n_ids // self.block_ids)
        self.blocks = np.frombuffer(source.read(8 * (n_blocks + 1)), "<u8").astype(np.int64)
        self.docs = np.frombuffer(source.read(8 * self.n_docs), "<i8")
        self.nulls = np.frombuffer(source.read(self.n_docs), "u1").astype(bool)
        self.starts = np.frombuffer(source.read(8 * (self.n_docs + 1)), "<u8").astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, by the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        self.source.seek(int(self.blocks[first]))
        data = self.source.read(int(self.blocks[last + 1] - self.blocks[first]))
        out = [unpack(data[self.blocks[k] - self.blocks[first] : self.blocks[k + 1] - self.blocks[first]], min(self.block_ids, self.n_ids - k * self.block_ids), self.bits) for k in range(first, last + 1)]
        return np.concatenate(out)[start - first * self.block_ids : stop - first * self.block_ids]


#: A chunk that is one run of letters: one pre-token, whose last symbol alone ends a word.
_ONE_WORD = "^ ?[a-z\u00df-\u00f6\u00f8-\u00ff]+$"
#: A-Z in lower case, and the white space of ASCII as blanks, as the tokenizer reads them.
_PLAIN = bytes(32 if c in b"\t\n\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words in a call.
_CALL = 1024


class WordEncoder:
    """Ids of texts by a tokenizers file that drops white space and lower-cases: of each distinct chunk once, many words a call."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.size = self.own.get_vocab_size()
        self.ends = np.zeros(self.size, bool)
        for token, k in self.own.get_vocab().items():
            self.ends[k] = token.endswith("</w>")

    def _encode(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct chunks, in an order of their own: each one's place in it, the sizes of their ids, and these back to back."""
        single = pc.match_substring_regex(chunks, _ONE_WORD).to_numpy(zero_copy_only=False)
        plain, other = np.flatnonzero(single), [np.flatnonzero(~single)]
        order, sizes, ids = [], [], []
        words = chunks.take(pa.array(plain))
        lines = pc.binary_join(pa.ListArray.from_arrays(np.append(np.arange(0, len(plain), _CALL), len(plain)).astype(np.int32), words), " ").to_pylist()
        for k in range(0, len(lines), 8):
            for j, coded in enumerate(self.own.encode_batch_fast(lines[k : k + 8], add_special_tokens=False), k):
                group, found = plain[j * _CALL : (j + 1) * _CALL], np.array(coded.ids, np.uint32)
                stops = np.flatnonzero(self.ends[found]) + 1
                if len(stops) != len(group):  # not one end a word: each alone
                    other.append(group)
                    continue
                order.append(group), ids.append(found), sizes.append(np.diff(stops, prepend=0))
        rest = np.concatenate(other)
        for k in range(0, len(rest), 4 * _CALL):
            some = rest[k : k + 4 * _CALL]
            lists = [coded.ids for coded in self.own.encode_batch_fast(chunks.take(pa.array(some)).to_pylist(), add_special_tokens=False)]
            own = np.fromiter(map(len, lists), np.int64, len(lists))
            order.append(some), sizes.append(own), ids.append(np.fromiter(chain.from_iterable(lists), np.uint32, int(own.sum())))
        place = np.zeros(len(chunks), np.int64)
        if order:
            place[np.concatenate(order)] = np.arange(len(chunks))
        return place, np.concatenate([np.zeros(0, np.int64), *sizes]), np.concatenate([np.zeros(0, np.uint32), *ids])

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids by document, and all ids."""
        raw = data.tobytes()
        low = np.frombuffer(raw.translate(_PLAIN), np.uint8)
        # every blank is dropped in the end, so a line's end is a boundary like a space
        starts = chunk_starts(low, offsets)
        if b"<|" in raw:  # special strings keep their case
            low = low.copy()
            ends = np.append(starts, len(data))
            for m in re.finditer(rb"<\|", raw):
                k = int(np.searchsorted(starts, m.start(), "right")) - 1
                low[ends[k] : ends[k + 1]] = data[ends[k] : ends[k + 1]]
        at, chunks = unique_chunks(low, starts)
        place, sizes, ids = self._encode(chunks.cast(pa.string()))
        at = place[at]
        ragged = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(ids))
        out = ragged.take(pa.array(at)).flatten().to_numpy() if len(at) else ids
        return row_sums(sizes[at], starts, offsets), out


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    """The encoder, once per Python worker."""
    return WordEncoder(path)


def with_end(sizes: np.ndarray, ids: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each document."""
    stops = np.cumsum(sizes + 1)
    out = np.zeros(int(stops[-1]) if len(stops) else 0, np.uint32)
    ends = np.zeros(len(out), bool)
    ends[stops - 1] = True
    out[~ends], out[ends] = ids, end_id
    return sizes + 1, out


def write(df: DataFrame, path: str, doc: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end_id: int = 1, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode and write all documents to files in path; the manifest: file, part, n_docs, n_ids."""
    spark = df.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer)
        writer = None
        for batch in by_bytes(batches, "text"):
            if writer is None:
                system, base = files.place(path)
                part = TaskContext.get().partitionId()
                name = f"part-{part:06d}.tlp"
                temp = files.temporary(name)
                system.create_dir(f"{base}/_tmp", recursive=True)
                out = system.open_output_stream(f"{base}/{temp}")
                writer = PackedWriter(out, (encode.size - 1).bit_length(), block_ids)
            sizes, ids = with_end(*encode(*flat(batch.column("text"))), end_id)
            docs = batch.column("doc")
            writer.add(pc.fill_null(docs, 0).to_numpy(zero_copy_only=False), pc.is_null(docs).to_numpy(zero_copy_only=False), sizes, ids)
        if writer is not None:
            n_docs, n_ids = writer.close()
            out.close()
            files.commit(system, base, temp, name)
            yield pa.RecordBatch.from_pydict({"file": [name], "part": pa.array([part], pa.int32()), "n_docs": [n_docs], "n_ids": [n_ids]})

    rows = df.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))
    tie = [F.xxhash64("text"), F.length("text")]
    placed = rows.repartitionByRange("doc", *tie).sortWithinPartitions("doc", *tie)
    return materialize(placed.mapInArrow(run, "file string, part int, n_docs long, n_ids long"), "packed-manifest")


def read(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (binary, little-endian unsigned 32-bit) from the files."""
    ship(spark)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    based = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = files.place(path)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{root}/{row['file']}") as source:
                    packed = PackedReader(source)
                    at = 0
                    while at < packed.n_docs:
                        stop = max(at + 1, int(np.searchsorted(packed.starts, packed.starts[at] + READ_IDS, "right")) - 1)
                        ids = packed.ids(int(packed.starts[at]), int(packed.starts[stop]))
                        ends = ((packed.starts[at : stop + 1] - packed.starts[at]) * 4).astype(np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(packed.docs[at:stop], pa.int64(), mask=packed.nulls[at:stop]),
                                pa.array(packed.starts[at:stop] + row["base"], pa.int64()),
                                pa.array(np.diff(packed.starts[at : stop + 1])),
                                pa.BinaryArray.from_buffers(pa.binary(), stop - at, [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4", copy=False))]),
                            ],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )
                        at = stop

    spread = based.repartition(max(1, manifest.count()))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op3_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "packed")
    manifest = write(table(spark, sf_dir, "documents"), path)
    return read(spark, path, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
