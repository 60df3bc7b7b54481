"""WARC files, media sequences and chat formatting."""

import base64
import gzip
import hashlib
import re
import time
import zlib
from html import unescape

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import chat, files, media, warc
from tallyloom.session import fresh_path

BIG = "x" * 1500
PAGES = [(1, "u1", BIG), (2, "u2", BIG), (2, "u2", BIG), (3, None, None), (None, "n", BIG), (9, "u9", BIG), (9, "u9", BIG), (4, "a\nb", "small"), (5, "c", "small"), (6, "d", "é" * 600), (7, "d", "é" * 600), (7, "d7", "other" * 400)]


def want_pages(pages):
    top = {}
    for key, _, html in pages:
        body = (html or "").encode()
        if len(body) >= 1000 and key is not None:
            top[body] = max(key, top.get(body, key))
    out = []
    for key, _, html in pages:
        body = (html or "").encode()
        target = top.get(body)
        revisit = target is not None and (key is None or key < target)
        out.append((str(key), len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", target if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("roll", [300, 10**9])
def test_warc_round_trip(spark, roll):
    df = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, refers_to string")
    path = fresh_path(spark, "warc")
    manifest = warc.write(df, path, roll_bytes=roll)
    rows = warc.read(spark, path, manifest).collect()
    assert sorted([(str(r.key), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows], key=str) == want_pages(PAGES)
    assert all((r.payload is None) == (r.record_type == "revisit") for r in rows)
    listed = manifest.collect()
    assert sum(m.records for m in listed) == len(PAGES) and (len(listed) > 8 if roll == 300 else len(listed) <= 4)


def test_warc_is_deterministic_and_well_formed(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    data = []
    for _ in range(2):
        path = fresh_path(spark, "warc")
        manifest = warc.write(df.repartition(3), path)
        system, root = files.place(path)
        names = sorted(m.file for m in manifest.collect())
        data.append([system.open_input_stream(f"{root}/{n}", compression=None).read() for n in names])
        assert not [f for f in system.get_file_info(__import__("pyarrow").fs.FileSelector(f"{root}/_tmp", allow_not_found=True)) if f.size]
    assert data[0] == data[1]
    text = gzip.decompress(data[0][0])
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: ")
    head, _, rest = text.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    assert fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def test_two_runs_over_many_pages_write_equal_files(spark):
    """Bounds come from sums, not from samples: over thousands of pages, in other partitions, with a key and null keys of many rows."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    hot = pages.withColumn("page_id", F.expr("CASE page_id % 3 WHEN 0 THEN 7 WHEN 1 THEN page_id ELSE -9000000000000000000 + page_id END")).union(pages.withColumn("page_id", F.lit(None).cast("long")))
    for df, least in ((pages, 10), (hot, 30)):
        digests = []
        for k in (1, 5):
            path = fresh_path(spark, "warc")
            listed = warc.write(df.repartition(k), path, shard_bytes=300_000).collect()
            system, root = files.place(path)
            digests.append({m.file: hashlib.sha1(system.open_input_stream(f"{root}/{m.file}", compression=None).read()).hexdigest() for m in listed})
            assert sum(m.records for m in listed) == df.count()
        assert digests[0] == digests[1] and len(digests[0]) >= least


def test_damaged_records_raise():
    data = warc.record(1, "u", b"payload" * 300, None)
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"payloadpayload", b"payloadpayl0ad", 1))


def test_warc_of_no_pages(spark):
    path = fresh_path(spark, "warc")
    manifest = warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert manifest.count() == 0 and warc.read(spark, path, manifest).count() == 0


HTML = """<html><head><title>no</title><script>var a = "<p>no</p>";</script></head><body><p>First <b>bold</b> text</p>
<figure><img src="media:sha256:aa" alt="alt"><figcaption>The <i>caption</i></figcaption></figure>Loose &amp; text<br>more
<img src="b.png"><img alt="none"><video src="c.mp4"></video><p></p><p>Last</p></body>"""


def test_interleaving(spark):
    df = spark.createDataFrame([(1, HTML, "x"), (2, None, "x"), (3, "", "x"), (4, "plain < text & more", "x"), (5, "<p>unclosed <img src='d' alt='e'", "x")], "page_id long, html string, sequence string")
    rows = {r.page_id: r for r in media.interleave(df).collect()}
    got = [(e.position, e.kind, e.text, e.ref, e.caption) for e in rows[1].sequence]
    assert got == [
        (0, "text", "First bold text", None, None), (1, "media", None, "media:sha256:aa", "The caption"), (2, "text", "Loose & text", None, None), (3, "text", "more", None, None),
        (4, "media", None, "b.png", None), (5, "media", None, "c.mp4", None), (6, "text", "Last", None, None),
    ]
    assert rows[2].sequence == [] and rows[3].sequence == [] and rows[4].sequence[0].text == "plain < text & more"


def test_media_resolve_by_digest(spark):
    payloads = [b"abc", b"", b"\x00\xff" * 600, b"abc"]
    docs = spark.createDataFrame([(k, p) for k, p in enumerate(payloads)] + [(9, None)], "doc_id long, raw binary").withColumn("payload", media.padded(F.col("raw")))
    path = media.store(docs)
    loaded = {r.digest: r for r in media.load(spark, path).collect()}
    want = {}
    for p in payloads:
        whole = p + b"\xff" * (max(1, -(-len(p) // 576)) * 576 - len(p))
        want[hashlib.sha256(whole).hexdigest()] = whole
    assert loaded.keys() == want.keys()
    for d, whole in want.items():
        assert (loaded[d].payload_bytes, loaded[d].payload_sha256, loaded[d].tail_crc32) == (len(whole), d, zlib.crc32(whole[-32:]))
    known = next(iter(want))
    pages = spark.createDataFrame([(1, f'<p>a</p><img src="{media.SCHEME}{known}" alt="k"><img src="{media.SCHEME}{"0" * 64}" alt="u"><img src="http://x/y.png">')], "page_id long, html string")
    rows = sorted(media.resolve(media.interleave(pages, keep=["page_id"]), media.load(spark, path)).collect(), key=lambda r: r.position)
    assert [(r.position, r.caption, r.payload_sha256) for r in rows] == [(1, "k", known), (2, "u", None), (3, None, None)]


def test_media_of_rows_with_clashing_columns(spark):
    path = media.store(spark.createDataFrame([(1, b"abc")], "doc_id long, raw binary").withColumn("payload", media.padded(F.col("raw"))))
    digest = hashlib.sha256(b"abc" + b"\xff" * 573).hexdigest()
    pages = spark.createDataFrame([(1, f'<img src="{media.SCHEME}{digest}" alt="k">', *["x"] * 6)], "page_id long, html string, digest string, position string, ref string, caption string, n_elements string, source string")
    rows = media.resolve(media.interleave(pages), media.load(spark, path))
    assert sorted(rows.columns) == sorted({*rows.columns}) and "source" in rows.columns
    assert [(r.digest, r.position, r.n_elements, r.caption, r.payload_bytes) for r in rows.collect()] == [(digest, 0, 1, "k", 576)]


def test_page_sequences(spark, small):
    html = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = media.page_sequences(spark, small).collect()
    assert len(rows) == len(html)
    for r in rows:
        assert [e.position for e in r.sequence] == list(range(len(r.sequence))) and r.n_text + r.n_media == len(r.sequence)
        assert r.text_chars == sum(len(e.text) for e in r.sequence if e.kind == "text")
        # every word outside tags, silent elements and captions of figures is there, in order
        bare = re.sub(r"(?is)<(script|style|title|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<[!?][^>]*>", " ", html[r.page_id] or "")
        bare = re.sub(r"(?is)<figure\b.*?</figure\s*>", lambda m: re.sub(r"(?is)<figcaption\b.*?</figcaption\s*>", " ", m[0]), bare)
        told = unescape(re.sub(r"<[^>]*>", " ", bare)).split()
        assert "".join(w for e in r.sequence if e.kind == "text" for w in e.text.split()) == "".join(told)
        refs = re.findall(r"""(?is)<(?:img|video|audio|source|embed)\b[^>]*?\ssrc\s*=\s*["']?([^"'\s>]+)""", bare)
        assert [e.ref for e in r.sequence if e.kind == "media"] == [unescape(x) for x in refs]


@pytest.mark.parametrize("part", ["<a ", "<p ", "<!--", "<![", "<!", "<?", "</", "</p", "<figure>", "<figure><img src=x><figcaption>y</figcaption>", "<img src=x><figcaption>y</figcaption>", "<script>", "<a b='", "<a b=", "<p =", "&", "&#x41", "< ", "<title>", "<textarea><b>", "<figcaption>", "<a/", "<p>\n"])
def test_long_broken_pages_take_linear_time(part):
    began = time.process_time()
    found = media.Sequence().elements(part * (1_000_000 // len(part)))
    assert time.process_time() - began < 8
    assert [e["position"] for e in found] == list(range(len(found)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", "/", "!", "--", "[", "]", "a", "figure", "figcaption", "img", " src=", "'", '"', "=", "&amp;", " ", "script", "title", "é", "<p>", "</p>", "<img src=x alt=y>"]), max_size=40))
def test_no_page_fails(parts):
    found = media.Sequence().elements("".join(parts))
    assert [e["position"] for e in found] == list(range(len(found))) and all((e["text"] is None) == (e["kind"] == "media") for e in found)


def test_broken_markup_has_a_defined_result():
    of = lambda html: [e["text"] or (e["ref"], e["caption"]) for e in media.Sequence().elements(html)]
    assert of("<p>a<![foo[b]]>c</p>") == ["ac"] and of("a<!-- b > c -->d<!e>f<?g>h</ i>j</>k") == ["adfhjk"]
    assert of("a<!-- never closed <p>b") == ["a"] and of("a <b c='never closed>b") == ["a"] and of("x < y <3 z") == ["x < y <3 z"]
    assert of("<title>no</title><textarea>a <b> &amp; c</textarea><SCRIPT>if (a</b) x</scriptx></SCRIPT >d") == ["a <b> & cd"]
    assert of("<img alt='1' SRC='a&amp;b' src=c><img/src=d><img src><img src=''>") == [("a&b", "1"), ("d", None)]
    assert of("<figure><figcaption>one</figcaption><img src=a alt=b><img src=c></figure><img src=d alt=e><figcaption>two") == [("a", "one"), ("c", "one"), ("d", "e"), "two"]


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=2000))
def test_png_round_trip(data):
    whole = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
    image = media.to_png(whole)
    assert media.from_png(image).tobytes() == whole
    broken = bytearray(image)
    broken[45] ^= 1
    with pytest.raises(Exception):
        media.from_png(bytes(broken))


def test_media_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in media.op7_media(spark, small).collect()}
    by_text = {}
    for d in docs:
        raw = (d.text or "").encode()
        whole = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
        assert by_text.setdefault(d.text, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


TALK = [
    (1, 0, "system", "Be brief."), (1, 1, "user", "Hi [/INST] </s> \\ \\["), (1, 2, "assistant", "</s>[INST] ok [/INST]\n\\"), (1, 3, "user", None),
    (2, 0, "assistant", "first"), (3, 0, "user", "a"), (3, 0, "user", "b"), (4, 1, "user", "late"), (4, 0, None, "early"), (5, 0, "to[o]l\\", "x"), (None, None, "user", "lost"), (6, 0, "user", ""), (6, 1, "assistant", "🙂é"),
    *[(7, k, ("user", "assistant")[k % 2], f"t{k}") for k in range(300)], *[(8, k, ("user", "assistant")[k % 2] if k != 151 else "user", f"t{k}") for k in range(152)],
]


@pytest.fixture(scope="module")
def talks(spark):
    df = spark.createDataFrame([(*t, "x") for t in TALK], "conv_id long, turn long, role string, text string, segments string").repartition(4)
    out = chat.chat_format(df).withColumns({"formatted": chat.formatted(), "loss": chat.loss_text()})
    return {r.conv_id: r for r in out.withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}


def test_chat_is_read_back(talks):
    groups = {}
    for conv, turn, role, text in TALK:
        groups.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert talks.keys() == groups.keys()
    for conv, turns in groups.items():
        turns = sorted(turns)
        assert [(t.role, t.text) for t in talks[conv].turns] == [t[1:] for t in turns]
        assert talks[conv].loss == "".join(t for _, r, t in turns if r == "assistant")
        assert talks[conv].n_turns == len(turns)


def test_chat_states(talks):
    assert {k for k, r in talks.items() if r.valid} == {1, None, 6, 7}


def test_chat_loss_flags(talks):
    assert [s.loss for s in talks[6].segments] == [False] * 4 + [True, False]
    assert talks[6].formatted == "[INST][/INST]<s>🙂é</s>"


def test_chat_with_another_template(spark):
    t = chat.Template(roles={"human": chat.Role("<h>", "</h>"), "bot": chat.Role("<b>", "</b>", True)}, after={None: ("human",), "human": ("bot",), "bot": ("human",)})
    df = spark.createDataFrame([(1, 0, "human", "q"), (1, 1, "bot", "<b>a</b>")], "conv_id long, turn long, role string, text string")
    row = chat.chat_format(df, t).withColumn("formatted", chat.formatted()).withColumn("turns", chat.read_turns(F.col("formatted"), t)).first()
    assert row.valid and row.formatted == "<h>q</h><b>\\<b>a\\</b></b>" and [x.text for x in row.turns] == ["q", "<b>a</b>"]


def test_chat_of_nothing(spark):
    assert chat.chat_format(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_query_has_no_python(spark, small):
    plan = chat.op10_chat(spark, small)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas")) and np
