"""WARC archives: a deterministic sharded writer and a reader.

Records are sorted by range over the cluster. Ranges (shards) come from exact sums of bytes by fixed buckets of keys, finer where a bucket
holds more than a shard, and not from a sample: equal tables have equal shards, whatever their partitions. Rows of one key that exceed a
shard are split by their digests. A shard is written into gzip members, one per record, and rolls to the next file once a file has
ROLL_BYTES compressed bytes. All headers are made anew from the row: record ids from key and digest, lengths, payload and
block digests. A file is written under a temporary name and renamed when complete; a row per file goes to the manifest, which Spark
commits after all tasks, and readers open only files that the manifest lists. A task or a whole run that is done again writes the same bytes under
the same names.

Of rows with equal payloads of at least MIN_REVISIT bytes, that with the largest key is a response record, the others are revisit
records of it, without the payload. The groups are found by an aggregation of digests; keys and digests alone are joined to them.

Defined results: a null payload is written as an empty one. Rows with a null key sort first, are responses unless a row with a key has
their payload, and are never revisited. Repeated rows of the largest key are all responses. A null url is written as an empty one; line
breaks in urls become spaces. An empty table has an empty manifest. Other columns are not written. Rows that are equal in key and digest
lie in one shard, as nothing tells them apart."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import files
from tallyloom.llm.tables import table
from tallyloom.session import fresh_path, materialize, ship

MIN_REVISIT = 1000
ROLL_BYTES = 64_000_000
#: Payload bytes of a shard, or more where that would make over MOST_SHARDS.
SHARD_BYTES = 24_000_000
MOST_SHARDS = 20_000
#: Bits of keys that are told apart at first, and in each further step inside buckets that exceed a shard.
FIRST_BITS, MORE_BITS = 16, 8
#: Capture time that regenerated headers state.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The header lines of the format that are used here, in the order in which they are written.
CONTENT = "application/http;msgtype=response"
LEVEL = 6
#: Payload bytes that a reader puts into one batch.
READ_BYTES = 8_000_000


def _urn(key: int | None, digest: bytes) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(b'%s %s' % (str(key).encode(), digest)).digest()[:16])}>"


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """A response record, or a revisit record where refers_to is given."""
    digest = hashlib.sha1(payload).digest()
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    uri = " ".join((url or "").split())
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(key, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to, digest)}", f"X-Refers-To-Key: {refers_to}"]
    lines += [] if key is None else [f"X-Key: {key}"]
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}", f"Content-Type: {CONTENT}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time stamp."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(source: pa.NativeFile, size: int = 1 << 20) -> Iterator[bytes]:
    """The contents of a file's gzip members, one at a time."""
    rest = b""
    while True:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            data = rest or source.read(size)
            if not data:
                if parts:
                    raise ValueError("a record is cut off")
                return
            parts.append(unpack.decompress(data))
            rest = unpack.unused_data
        yield b"".join(parts)


def parse(data: bytes) -> dict:
    """A record's fields, its digests checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    revisit = fields["WARC-Type"] == "revisit"
    if base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} is wrong")
    if not revisit and (len(payload) != length or hashlib.sha1(payload).digest() != digest):
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']} is wrong")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"key": number("X-Key"), "url": fields["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest.hex(), "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Key"), "payload": None if revisit else payload}


def shards(index: DataFrame, shard_bytes: int) -> tuple[list[DataFrame], list[str], int]:
    """How to deal rows by key: tables (id, shard, parts), one per bucket width, the expression of each one's id, and the number of
    shards. A row's shard is that of the last table that has its id, plus its digest's share of parts; ids of null keys are null.

    The driver gets sums of buckets: 2 ** FIRST_BITS, and 2 ** MORE_BITS for each of the at most MOST_SHARDS that exceed a shard."""
    spark = index.sparkSession
    low, high, total = index.agg(F.min("key"), F.max("key"), F.sum("n")).first()
    target = max(shard_bytes, -(-(total or 0) // MOST_SHARDS))
    span = (high or 0) - (low or 0)
    base = 0 if span >> 63 else low or 0  # a difference of longs may not be a long
    width = max(0, span.bit_length() - FIRST_BITS)
    widths, leaves, heavy = [], [], None
    while True:
        own = f"shiftright(key - {base}L, {width})"
        rows = index if heavy is None else index.join(F.broadcast(heavy), F.expr(widths[-1]) == F.col("__heavy"), "left_semi")
        sums = [(r.id, r.n) for r in rows.groupBy(F.expr(own).alias("id")).agg(F.sum("n").alias("n")).collect()]
        last = width == 0
        over = [] if last else [i for i, n in sums if i is not None and n > target]
        leaves += [(i is not None, (i or 0) << width, len(widths), i, n) for i, n in sums if last or i is None or n <= target]
        widths.append(own)
        if not over:
            break
        heavy, width = spark.createDataFrame([(i,) for i in over], "__heavy long"), max(0, width - MORE_BITS)
    tables: list[list[tuple[int | None, int, int]]] = [[] for _ in widths]
    shard, held = 0, 0
    for _, _, level, i, n in sorted(leaves, key=lambda leaf: leaf[:2]):
        parts = -(-n // target) if i is None or level == len(widths) - 1 else 1
        if held and (held + n > target or parts > 1):
            shard, held = shard + 1, 0
        tables[level].append((i, shard, parts))
        shard, held = shard + parts - 1, n if parts > 1 else held + n
    return [spark.createDataFrame(t, "id long, shard long, parts long") for t in tables], widths, shard + 1


def dealt(rows: DataFrame, tables: list[DataFrame], ids: list[str]) -> DataFrame:
    """rows (with key and digest) with their shard."""
    shard, parts = F.lit(None).cast("long"), F.lit(None).cast("long")
    for k, (own, id_) in enumerate(zip(tables, ids, strict=True)):
        named = own.select(F.col("id").alias(f"__id{k}"), F.col("shard").alias(f"__shard{k}"), F.col("parts").alias(f"__parts{k}"))
        rows = rows.join(F.broadcast(named), F.expr(id_).eqNullSafe(F.col(f"__id{k}")), "left")
        shard, parts = F.coalesce(f"__shard{k}", shard), F.coalesce(f"__parts{k}", parts)
    share = F.conv(F.left("digest", F.lit(8)), 16, 10).cast("long")
    added = [c for k in range(len(tables)) for c in (f"__id{k}", f"__shard{k}", f"__parts{k}")]
    return rows.withColumn("shard", shard + F.shiftright(share * parts, 32)).drop(*added)


def write(df: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_revisit: int = MIN_REVISIT, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write all rows to WARC files in path; the manifest: file, records, bytes, first_key, last_key."""
    spark = df.sparkSession
    ship(spark)
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    index = materialize(df.select(F.col(key).cast("long").alias("key"), F.sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("n")), "warc-index")
    about_ = index.where(F.col("n") >= min_revisit).drop("n")
    groups = about_.groupBy("digest").agg(F.max("key").alias("target"), F.count("*").alias("n")).where("n > 1 AND target IS NOT NULL").select("digest", "target")
    revisits = about_.join(groups, "digest").where("key IS NULL OR key < target").select("key", "digest", "target").distinct()
    # a revisit's target travels as a row of its own, sorted right before the pages of its key and digest: payloads are shuffled once
    pages = df.select(F.col(key).cast("long").alias("key"), F.sha1(body).alias("digest"), F.lit(None).cast("long").alias("target"), F.col(url).alias("url"), body.alias("payload"))
    tables, ids, count = shards(index.withColumn("n", F.col("n") + 200), shard_bytes)
    rows = dealt(pages.unionByName(revisits, allowMissingColumns=True), tables, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, out = None, 0, None
        system, base = files.place(path)

        def close() -> pa.RecordBatch:
            out.close()
            files.commit(system, base, temp, name)
            return pa.RecordBatch.from_pylist([{"file": name, **about}], out_schema)

        told: tuple = ()
        for batch in batches:
            for own_key, digest, target, own_url, data, shard in zip(*(c.to_pylist() if n != "payload" else c for n, c in zip(batch.schema.names, batch.columns, strict=True)), strict=True):
                if shard != part:
                    if out is not None:
                        yield close()
                    part, k, out = shard, 0, None
                if target is not None:
                    told = own_key, digest, target
                    continue
                target = told[2] if told[:2] == (own_key, digest) else None
                if out is None:
                    name = f"pages-{part:06d}-{k:05d}.warc.gz"
                    temp = files.temporary(name)
                    system.create_dir(f"{base}/_tmp", recursive=True)
                    out, about = system.open_output_stream(f"{base}/{temp}", compression=None), {"records": 0, "bytes": 0, "first_key": own_key, "last_key": own_key}
                packed = member(record(own_key, own_url, data.as_py(), target))
                out.write(packed)
                about = about | {"records": about["records"] + 1, "bytes": about["bytes"] + len(packed), "last_key": own_key}
                if about["bytes"] >= roll_bytes:
                    yield close()
                    out, k = None, k + 1
        if out is not None:
            yield close()

    out_schema = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64())])
    placed = rows.repartitionById(count, F.col("shard").cast("int")).sortWithinPartitions("shard", "key", "digest", F.desc_nulls_last("target"), "url")
    return materialize(placed.mapInArrow(run, "file string, records long, bytes long, first_key long, last_key long"), "warc-manifest")


def read(spark: SparkSession, path: str, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record of the listed files: key, url, payload_bytes, payload_digest, record_type, refers_to and, if asked for,
    payload (null for revisits)."""
    ship(spark)
    types = {"key": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if payloads else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = files.place(path)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                held, size = [], 0
                with system.open_input_stream(f"{base}/{name}", compression=None) as source:
                    for data in members(source):
                        found = parse(data)
                        held.append(found if payloads else {k: v for k, v in found.items() if k != "payload"})
                        size += 200 + len(found["payload"] or b"") * payloads
                        if size > READ_BYTES:
                            yield pa.RecordBatch.from_pylist(held, pa.schema(list(types.items())))
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, pa.schema(list(types.items())))

    spread = manifest.select("file").repartition(max(1, manifest.count()))
    return spread.mapInArrow(run, "key long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    manifest = write(table(spark, sf_dir, "pages"), path)
    return read(spark, path, manifest, payloads=False).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: SQL for op4's rows.
ORACLE = f"""
WITH given AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
told AS (SELECT page_id, strlen(body) AS n, sha1(body) AS digest, max(page_id) OVER (PARTITION BY body) AS target FROM given)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN n >= {MIN_REVISIT} AND page_id < target THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {MIN_REVISIT} AND page_id < target THEN target END AS refers_to FROM told
"""
