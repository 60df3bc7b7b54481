"""Byte-level BPE, packed token files and token counts against the libraries themselves."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyloom.llm import arrowtext, byte_bpe, packed_tokens, token_counts
from tallyloom.session import fresh_path


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.encoding(byte_bpe.RANKS, public_tokenizers.PATTERN)


def test_encode_and_decode_edge_cases(edge_docs, edge_texts, encoder):
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids)) for r in byte_bpe.encode(edge_docs).collect())
    want = Counter((d, len(i := encoder.encode_ordinary(t or "")), np.array(i, "<u4").tobytes()) for d, t in edge_texts)
    assert got == want
    back = Counter((r.doc_id, bytes(r.decoded)) for r in byte_bpe.decode(byte_bpe.encode(edge_docs)).collect())
    assert back == Counter((d, (t or "").encode()) for d, t in edge_texts)


def test_extra_columns_stay_and_clashing_ones_are_replaced(edge_docs):
    out = byte_bpe.encode(edge_docs)
    assert out.columns.count("ids") == 1 and "source" in out.columns and out.schema["n_tokens"].dataType.typeName() == "long"


def test_empty_tables(no_docs, spark):
    assert byte_bpe.digests(no_docs).count() == 0
    assert token_counts.count_tokens(no_docs).count() == 0
    path = fresh_path(spark, "packed")
    assert packed_tokens.read(spark, path, packed_tokens.write(no_docs, path)).count() == 0


def test_ids_that_end_inside_a_character(spark):
    own = byte_bpe.encoding(byte_bpe.RANKS, public_tokenizers.PATTERN).encode_ordinary("🙂")
    part = np.array(own[:1], "<u4").tobytes()
    got = byte_bpe.decode(spark.createDataFrame([(1, part)], "doc_id long, ids binary")).first().decoded
    assert bytes(got) == "🙂".encode()[: len(got)] and got


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n'.,;:!?asdlévÀ×÷ß  　\x1c0123🙂<|>"), st.characters(codec="utf-8")), max_size=60))
def test_chunks_are_safe_boundaries(text):
    encoder = byte_bpe.encoding(byte_bpe.RANKS, public_tokenizers.PATTERN)
    data, offsets = arrowtext.flat(pa.array([text, text]))
    ends = np.append(arrowtext.chunk_starts(data, offsets), len(data))
    pieces = [data[a:b].tobytes().decode() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    assert [i for p in pieces for i in encoder.encode_ordinary(p)] == encoder.encode_ordinary(text) * 2


def test_counts_match_the_library(edge_docs, edge_texts):
    library = Tokenizer.from_file(token_counts.TOKENIZER)
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(edge_docs).collect())
    assert got == Counter((d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in edge_texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abAB eiou.,'\n🙂é", min_size=1, max_size=30), min_size=1, max_size=8))
def test_rank_synchronous_merging(texts):
    library = Tokenizer.from_file(token_counts.TOKENIZER)
    counts = token_counts.chunk_counts([t.encode() for t in texts], token_counts.merges(token_counts.TOKENIZER))
    assert counts.tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("bits", [1, 7, 8, 15, 16, 17, 32])
def test_pack_and_unpack(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001, dtype=np.uint64).astype(np.uint32)
    assert (packed_tokens.unpack(packed_tokens.pack(ids, bits), len(ids), bits) == ids).all()
    assert len(packed_tokens.pack(ids, bits)) == -(-len(ids) * bits // 8)


def test_ids_that_do_not_fit_raise():
    with pytest.raises(ValueError):
        packed_tokens.pack(np.array([300], np.uint32), 8)


def test_packed_files(edge_docs, edge_texts, spark):
    library = Tokenizer.from_file(packed_tokens.TOKENIZER)
    path = fresh_path(spark, "packed")
    manifest = packed_tokens.write(edge_docs, path, block_ids=1000)
    rows = sorted(packed_tokens.read(spark, path, manifest).collect(), key=lambda r: r.start)
    want = Counter((d, len(i := [*library.encode(t or "", add_special_tokens=False).ids, 1]), zlib.crc32(np.array(i, "<u4").tobytes())) for d, t in edge_texts)
    assert Counter((r.doc_id, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in rows) == want
    keys = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert keys == sorted(keys)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens


def test_random_access(tmp_path):
    ids = np.arange(10_000, dtype=np.uint32) % 5000
    with open(tmp_path / "f", "wb") as out:
        writer = packed_tokens.PackedWriter(out, 13, 256)
        for k in range(0, 10_000, 1234):
            part = ids[k : k + 1234]
            writer.add(np.array([k]), np.array([False]), np.array([len(part)]), part)
        assert writer.close() == (9, 10_000)
    reader = packed_tokens.PackedReader(pa.OSFile(str(tmp_path / "f")))
    for a, b in ((0, 0), (0, 1), (255, 257), (4000, 9999), (9999, 10_000)):
        assert (reader.ids(a, b) == ids[a:b]).all()
    (tmp_path / "g").write_bytes((tmp_path / "f").read_bytes()[:-5])
    with pytest.raises(ValueError):
        packed_tokens.PackedReader(pa.OSFile(str(tmp_path / "g")))


def test_queries_over_the_smallest_tables(spark, small, encoder):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in byte_bpe.op2_byte_bpe(spark, small).collect()}
    for d in docs:
        ids = np.array(encoder.encode_ordinary(d.text or ""), "<u4")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())


RUNS = {"spaces": " " * 1_000_000, "lines": "a" + "\n" * 1_000_000, "tabs": "\t" * 1_000_000 + " x", "letters": "".join(np.random.default_rng(1).choice(list("etaoinshrdlu"), 1_000_000)), "digits": "".join(np.random.default_rng(2).choice(list("0123456789"), 1_000_000)), "marks": "!" * 1_000_000}


@pytest.mark.parametrize("name", RUNS)
def test_runs_of_a_million_characters(name, encoder):
    """They neither overflow a stack nor take quadratic time; shorter runs equal the libraries."""
    codec, rules, library = byte_bpe.Codec(byte_bpe.RANKS, public_tokenizers.PATTERN), token_counts.merges(token_counts.TOKENIZER), Tokenizer.from_file(token_counts.TOKENIZER)
    n, ids = codec.encode(pa.array([RUNS[name]]))
    assert bytes(codec.decode(ids, np.array([0, len(ids)]))[0].as_py()) == RUNS[name].encode()
    assert token_counts.chunk_counts([RUNS[name].encode()], rules).tolist() == n.tolist()
    part = RUNS[name][:30_000] + RUNS[name][-30_000:]
    assert codec.encode(pa.array([part]))[1].tolist() == encoder.encode_ordinary(part)
    assert token_counts.chunk_counts([part.encode()], rules).tolist() == [len(library.encode(part, add_special_tokens=False).ids)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abAB eiou.,'\n🙂é", min_size=1, max_size=200))
def test_linked_merging_equals_rounds(text):
    rules = token_counts.merges(token_counts.TOKENIZER)
    data = rules.of_byte[np.frombuffer(text.encode() * 2, np.uint8)]
    sizes = np.array([len(text.encode())] * 2)
    assert rules.count_long(data.copy(), sizes).tolist() == rules.count(data, sizes).tolist()
