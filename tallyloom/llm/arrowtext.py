"""Text columns as flat byte buffers: bounded batches, safe splitting into chunks, ragged gathers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyloom.session import ship

#: Bytes of text that a Python worker holds at a time (one longer text is a batch of its own).
BATCH_BYTES = 12_000_000


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts back to back, and the offset of each (n + 1 of them). Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1] or b"\0" * 8, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most limit bytes of text, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def release() -> None:
    """An idle worker should not hold what its last task used: give unused memory back, of Arrow's pool and, where the C library can, of the heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_texts(df: DataFrame, column: str, make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], fields: list[T.StructField], keep: list[str] | None = None, limit: int = BATCH_BYTES) -> DataFrame:
    """df's columns (or keep of them) and new ones. make() runs once a task; what it returns gets bounded batches and gives the new
    columns. Columns of df that have the name of a new one are replaced; the text column itself is given to the function either way."""
    ship(df.sparkSession)
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new and (keep is None or f.name in keep)]
    schema = T.StructType([*kept, *fields])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        if once:
            batches = (b.append_column("__text", b.column(column)) for b in batches)
        for batch in by_bytes(batches, "__text", limit):
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *work(batch)], [*names, *(f.name for f in fields)])
        release()

    once = column in names  # the text travels once: under its working name if it isn't kept
    sent = df.select(*[df[n] for n in names], *([] if once else [df[column].alias("__text")]))
    return sent.mapInArrow(run, schema)


#: The second and third last bytes that some character of white space outside ASCII has.
_WIDE_SPACE = np.isin(np.arange(256), [0x85, 0xA0, 0x9F, 0xA8, 0xA9, 0xAF, *range(0x80, 0x8B)])
_WIDE_LEAD = np.isin(np.arange(256), [0xC2, 0x9A, 0x80, 0x81])
_ALNUM = np.isin(np.arange(256), [*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"])
_STOP = np.isin(np.arange(256), [*b",.;:!?"])
_SPACE = np.isin(np.arange(256), [*b" \t\n\v\f\r\x1c\x1d\x1e\x1f"])


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of chunks that BPE tokenizers treat alone: a chunk begins at a space after a character that is no white space, and at
    one of , . ; : ! ? after an ASCII letter or digit or a letter of U+00C0 to U+00FF. Splitting patterns of the GPT-2 family
    have a boundary there, whatever follows: no alternative goes on from a non-space to a space, or from a letter or digit to such
    a mark, and none looks back. Every document begins a chunk."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    cut = np.zeros(n, bool)
    if n > 1:
        before, here = data[:-1], data[1:]
        lead = np.concatenate([[np.uint8(0)], data[:-2]])
        latin = (lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
        wide = _WIDE_SPACE[before] & _WIDE_LEAD[lead] & ~latin
        cut[1:] = (here == 0x20) & ~_SPACE[before] & ~wide
        cut[1:] |= _STOP[here] & (_ALNUM[before] | latin)
    starts = offsets[:-1]
    cut[starts[starts < n]] = True
    return np.flatnonzero(cut)


def unique_chunks(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.BinaryArray]:
    """For each chunk its number among the distinct ones, and those."""
    ends = np.append(starts, len(data)).astype(np.int32)
    chunks = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    coded = chunks.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def row_sums(values: np.ndarray, starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the chunks' values by document."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    at = np.searchsorted(starts, offsets)
    return total[at[1:]] - total[at[:-1]]
