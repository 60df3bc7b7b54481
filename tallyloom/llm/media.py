"""Interleaved document sequences: ordered text and media references, payloads resolved by digest.

interleave() parses HTML, whatever it is like, in time in proportion to its length, into a sequence of structs: a position, a kind (text or media), text,
the reference and its caption (a figure's figcaption, else the alt text). store() writes payloads as 8-bit greyscale PNG images of ROW samples a row, into a table keyed
by the payload's SHA-256; load() reads the images back, decodes them and checks the digest. resolve() joins media elements to what was
stored by digest; only digests, places and properties travel, images stay where they were written, and an element keeps its position and
caption whether or not its digest is known.

Defined results: null HTML is empty and gives an empty sequence. An element without a known payload resolves to nulls. Equal payloads
are one entry of what load() gives; store() writes one once for each batch that has it. A payload is padded by bytes 255 to a positive multiple of ROW; a
null one counts as empty. Repeated rows are rows like any other, empty tables give empty results, other columns stay."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.arrowtext import by_bytes, flat, map_texts
from tallyloom.llm.tables import table
from tallyloom.session import fresh_path, materialize, ship

ROW = 576
SCHEME = "media:sha256:"
ELEMENT = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("caption", T.StringType())])
_ARROW = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
#: Elements that end a run of text, those whose content is no text, and those that refer to media.
BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
SILENT = frozenset("script style template noscript title".split())
MEDIA = frozenset("img video audio source embed".split())


#: Elements whose content has no tags.
RAW = frozenset("script style title textarea".split())
_NAME = re.compile(r"[^\s/>]+")
_GAP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


def start_tag(html: str, at: int) -> tuple[str, dict[str, str | None], int]:
    """Name and attributes (the first of a name counts) of the tag that opens at at, and where it ends: -1 if the page ends before it."""
    end = _NAME.match(html, at + 1).end()
    name, found = html[at + 1 : end].lower(), {}
    while True:
        at = _GAP.match(html, end).end()
        if at >= len(html):
            return name, found, -1
        if html[at] == ">":
            return name, found, at + 1
        end = _ATTRIBUTE.match(html, at).end()
        key, value = html[at:end].lower(), None
        if equals := _EQUALS.match(html, end):
            at = equals.end()
            if html[at : at + 1] in ('"', "'"):
                end = html.find(html[at], at + 1)
                if end < 0:
                    return name, found, -1
                value, end = html[at + 1 : end], end + 1
            else:
                end = _BARE.match(html, at).end()
                value = html[at:end]
        found.setdefault(key, None if value is None else unescape(value))


class Sequence:
    """Collects a page's elements in document order, in one pass that never goes back: whatever isn't closed reaches to the end of the page.

    A comment, a declaration or any other <! <? </ that begins no end tag ends at its own close and is no text; a < before anything but a letter is
    text. Script, style, title and textarea hold no tags."""

    def __init__(self) -> None:
        self.out: list[dict] = []
        self.parts: list[str] = []
        self.silent = 0
        self.figure: list[int] | None = None
        self.title = ""
        self.caption: list[str] | None = None

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.out.append({"position": len(self.out), "kind": "text", "text": text, "ref": None, "caption": None})

    def _leave(self) -> None:
        """The end of a figure: its media get its caption."""
        for k in self.figure or []:
            self.out[k]["caption"] = self.title or self.out[k]["caption"]
        self.figure, self.title = None, ""

    def opened(self, tag: str, attrs: dict[str, str | None]) -> None:
        if tag in SILENT:
            self.silent += 1
        elif tag in BLOCKS:
            self._flush()
            if tag == "figure":
                self._leave()
                self.figure = []
            elif tag == "figcaption":
                self.caption = []
        elif tag in MEDIA and attrs.get("src"):
            self._flush()
            if self.figure is not None:
                self.figure.append(len(self.out))
            self.out.append({"position": len(self.out), "kind": "media", "text": None, "ref": attrs["src"], "caption": attrs.get("alt")})

    def closed(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            if self.figure is None:  # outside a figure a caption is text
                self.parts.append(text)
            else:
                self.title = text or self.title
            self.caption = None
        elif tag in BLOCKS:
            self._flush()
            if tag == "figure":
                self._leave()

    def said(self, data: str) -> None:
        if data and not self.silent:
            (self.parts if self.caption is None else self.caption).append(unescape(data))

    def elements(self, html: str) -> list[dict]:
        at = 0
        while 0 <= at < len(html):
            tag = html.find("<", at)
            if tag < 0:
                tag = len(html)
            self.said(html[at:tag])
            mark, after = html[tag + 1 : tag + 2], html[tag + 2 : tag + 3]
            if not mark or not (mark.isascii() and mark.isalpha() or mark in "!?/"):
                self.said(html[tag : tag + 1])
                at = tag + 1
            elif mark.isalpha():
                name, attrs, at = start_tag(html, tag)
                if at < 0:
                    break
                self.opened(name, attrs)
                if name in RAW:
                    end = _RAW_END[name].search(html, at)
                    self.said(html[at : end.start() if end else len(html)])
                    at = end.start() if end else -1
            elif mark == "/" and after.isascii() and after.isalpha():
                close = html.find(">", tag)
                if close >= 0:
                    self.closed(_NAME.match(html, tag + 2).group().lower())
                at = close + 1 or -1
            else:
                comment = html.startswith("<!--", tag)
                close = html.find("-->" if comment else ">", tag + 4 if comment else tag)
                at = close + (3 if comment else 1) if close >= 0 else -1
        if self.caption is not None:
            self.closed("figcaption")
        self._leave()
        self._flush()
        return self.out


def interleave(df: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """df with sequence: the page's elements in order."""

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([Sequence().elements(t.as_py() or "") for t in batch.column("__text")], _ARROW)]

        return work

    return map_texts(df, html, make, [T.StructField("sequence", T.ArrayType(ELEMENT))], keep)


def padded(payload: Column, row: int = ROW) -> Column:
    """A binary column with bytes 255 up to a positive multiple of row; null counts as empty."""
    whole = F.coalesce(payload, F.lit(b""))
    n = F.octet_length(whole)
    return F.concat(whole, F.unhex(F.repeat(F.lit("FF"), F.greatest(F.ceil(n / row), F.lit(1)).cast("int") * row - n)))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


SIGNATURE = b"\x89PNG\r\n\x1a\n"


def to_png(payload: bytes, width: int = ROW) -> bytes:
    """A payload of a multiple of width bytes as an 8-bit greyscale image."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)  # filter 0 before each row
    lines[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> np.ndarray:
    """The samples of an image that to_png wrote, as rows; checks every chunk's sum."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, data, width, height = 8, [], 0, 0
    while at < len(image):
        (size,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", image, at + 8 + size)[0]:
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit greyscale")
        elif kind == b"IDAT":
            data.append(body)
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a filter that isn't used here")
    return lines[:, 1:]


def store(df: DataFrame, payload: str = "payload", path: str | None = None) -> str:
    """Write the payloads of df (padded) as images; the path of the table (digest, image). Copies within a batch are written once."""
    spark = df.sparkSession
    ship(spark)
    path = path or fresh_path(spark, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "payload"):
            data, offsets = flat(batch.column("payload"))
            images: dict[str, bytes] = {}
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                own = data[a:b].tobytes()
                digest = hashlib.sha256(own).hexdigest()
                if digest not in images:
                    images[digest] = to_png(own)
            yield pa.RecordBatch.from_pydict({"digest": pa.array(list(images), pa.string()), "image": pa.array(list(images.values()), pa.binary())})

    df.select(F.col(payload).alias("payload")).mapInArrow(run, "digest string, image binary").write.option("compression", "none").parquet(path)
    return path


LOADED = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("look", T.StringType())]


def describe(rows: np.ndarray) -> str:
    """Size, mean, deviation and the shares of eight brightness ranges."""
    counts = np.bincount((rows >> 5).ravel(), minlength=8)
    return f"{rows.shape[1]}x{rows.shape[0]} mean={rows.mean():.3f} std={rows.std():.3f} hist={'/'.join(f'{c / rows.size:.3f}' for c in counts)}"


def load(spark: SparkSession, path: str) -> DataFrame:
    """digest and properties of each stored payload, from its decoded image."""

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            out = []
            for digest, image in zip(batch.column("digest").to_pylist(), batch.column("__text"), strict=True):
                stored = image.as_py()
                rows = from_png(stored)
                payload = rows.tobytes()
                own = hashlib.sha256(payload).hexdigest()
                if own != digest:
                    raise ValueError(f"the payload of {digest} has digest {own}")
                out.append((len(payload), own, zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), describe(rows)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]

        return work

    stored = spark.read.schema("digest string, image binary").parquet(path)
    return map_texts(stored, "image", make, [T.StructField(*f) for f in LOADED], keep=["digest"]).dropDuplicates(["digest"])


def resolve(sequences: DataFrame, loaded: DataFrame, sequence: str = "sequence") -> DataFrame:
    """A row for each media element of sequences' rows: their other columns (but those named as an output), position, ref, caption, n_elements, digest and what is
    stored under it (nulls if nothing is)."""
    made = {"n_elements", "position", "ref", "caption", *(c.lower() for c in loaded.columns)}
    others = [c for c in sequences.columns if c != sequence and c.lower() not in made]
    media = sequences.select(*others, F.size(sequence).alias("n_elements"), F.explode(F.filter(sequence, lambda e: e["kind"] == "media")).alias("e"))
    told = media.select(*others, "n_elements", "e.position", "e.ref", "e.caption", F.when(F.col("e.ref").startswith(SCHEME), F.substring("e.ref", len(SCHEME) + 1, 64)).alias("digest"))
    return told.join(loaded, "digest", "left")


def page(text: Column, digest: Column) -> Column:
    """A text as HTML: a paragraph per line, and its payload's figure after the first, captioned with the digest's first digits."""
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    lines = F.split(safe, "\n", 2)
    figure = F.concat(F.lit(f'<figure><img src="{SCHEME}'), digest, F.lit('" alt="payload"><figcaption>payload '), F.left(digest, F.lit(12)), F.lit("</figcaption></figure>"))
    rest = F.regexp_replace(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), "\n", "</p><p>")
    return F.concat(F.lit("<article><p>"), F.get(lines, F.lit(0)), F.lit("</p>"), figure, F.lit("<p>"), rest, F.lit("</p></article>"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    payload = padded(F.col("text").cast("binary"))
    path = store(docs.select(payload.alias("payload")))
    pages = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), page(F.col("text"), F.sha2(payload, 256)).alias("html"))
    # as a table, so that the join deals both sides itself and can split a digest that very many documents share
    loaded = materialize(load(spark, path), "media-loaded")
    found = resolve(interleave(pages, keep=["doc_id", "n_bytes"]), loaded)
    feature = F.concat_ws(" ", "look", F.concat(F.lit("at="), "position", F.lit("/"), "n_elements"), F.concat(F.lit("caption="), "caption"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def page_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of pages as its ordered elements, with their numbers by kind and the characters of text."""
    found = interleave(table(spark, sf_dir, "pages").select("page_id", "html"), keep=["page_id"])
    of = lambda kind: F.filter("sequence", lambda e: e["kind"] == kind)
    chars = F.aggregate(of("text"), F.lit(0).cast("long"), lambda n, e: n + F.length(e["text"]))
    return found.select("page_id", "sequence", F.size(of("text")).cast("long").alias("n_text"), F.size(of("media")).cast("long").alias("n_media"), chars.alias("text_chars"))
