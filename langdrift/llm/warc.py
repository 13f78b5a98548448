"""WARC archives with revisit records for payloads that were seen before."""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, join_small_values, new_path, open_fs, partitions, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEW_LINE = b"\r\n"


def record_id(page_id: int | None, fallback: str, digest: str = "") -> str:
    """A record's urn: holds the page's id and the begin of the payload's digest (hexadecimal), by which others refer to it; made of ``fallback`` where there is no id."""
    if page_id is None:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, fallback)}>"
    h, d = f"{page_id & 0xFFFFFFFFFFFFFFFF:016x}", digest[:14].ljust(14, "0")
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-8{h[12:15]}-8{d[:3]}-{d[3:]}{h[15]}>"


def page_of_record_id(urn: str) -> int:
    """The page's id in a ``record_id`` that was made of one."""
    d = urn.removeprefix("<urn:uuid:").removesuffix(">").replace("-", "")
    n = int(d[:12] + d[13:16] + d[31], 16)
    return n - (1 << 64) if n >> 63 else n


def resolve_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """The record headers of ``pages``: page_id, digest, payload_bytes, record_type, refers_to, refers_url.

    Headers alone (no payloads) are shuffled by payload digest. Of the records with
    equal payloads of at least ``min_bytes`` bytes the one with the smallest id is
    the response and the others refer to it; smaller payloads are all responses. One
    header for each distinct (page_id, digest), with the number of its ``rows``, so repeats
    of a page's id with the same payload share a header: repeats of the smallest id are
    all responses.
    Null payloads are empty; a null id is after all others, and never referred to
    (where all ids of a payload are null, all are responses).
    """
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    headers = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).cast("long").alias("payload_bytes"))
    headers = written(headers, "warc-headers")
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    repeated = headers.filter(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), first.alias("first")).filter("copies > 1")
    total = headers.count()
    one = headers.groupBy("page_id", "digest").agg(F.first("payload_bytes").alias("payload_bytes"), F.count(F.lit(1)).alias("rows"))
    joined = join_small_values(one, repeated, "digest", "copies", total)
    is_revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return joined.select(
        "page_id", "digest", "rows", "payload_bytes", F.when(is_revisit, "revisit").otherwise("response").alias("record_type"), F.when(is_revisit, F.col("first.page_id")).alias("refers_to"), F.when(is_revisit, F.col("first.url")).alias("refers_url")
    )


def warc_record(kind: str, urn: str, date: str, digest: str, fields: list[tuple[str, str]], block: bytes, block_type: str) -> bytes:
    """One WARC/1.1 record, compressed as a gzip member of its own."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", urn), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}"), *fields, ("Content-Type", block_type), ("Content-Length", str(len(block)))]
    text = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    return gzip.compress(text + NEW_LINE + block + NEW_LINE + NEW_LINE, compresslevel=4, mtime=0)


def clean_header(value: str | None) -> str:
    """A header's value without line ends."""
    return " ".join((value or "").split())


def write_archives(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0, date: str | None = None, bytes_a_file: int = 32_000_000) -> DataFrame:
    """Writes ``pages`` as ``.warc.gz`` archives with fresh headers; returns the files.

    A response record has the whole payload below an HTTP header; a revisit record
    only headers that name the response. Records are dated ``date``, or when the job
    begins. A response's id is made of page and payload, a revisit's is its own. The
    payloads are shuffled once, to meet their header by (page_id, digest); headers of many
    rows (one id or null id with one payload) are dealt out to several tasks. Tasks roll
    files at about ``bytes_a_file``.
    Files get their name when whole, and only those of tasks that succeeded are
    returned. Result: file, n_records, n_bytes.
    """
    spark = pages.sparkSession
    folder = path or new_path(spark, "warc")
    headers = resolve_revisits(pages, id_col, url_col, body_col, min_bytes)
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    bodies = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("body")).withColumn("digest", F.sha1(F.col("body").cast("binary")))
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    n = partitions(spark)
    headers = written(headers.withColumn("key", F.xxhash64("page_id", "digest")), "warc-resolved")
    limit = max(1.0, (headers.agg(F.sum("rows")).first()[0] or 0) * HOT_SHARE)
    shares = F.ceil(F.col("rows") / limit).cast("long")
    hot = F.broadcast(headers.filter(F.col("rows") > limit).groupBy("key").agg(F.max(shares).alias("shares")))  # fewer than 1 / HOT_SHARE
    bodies = bodies.withColumn("place", F.monotonically_increasing_id()).withColumn("key", F.xxhash64("page_id", "digest")).join(hot, "key", "left")
    b = bodies.withColumn("share", F.pmod("place", F.coalesce("shares", F.lit(1)))).repartition(n, "key", "share").alias("b")
    h = headers.join(hot, "key", "left").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("shares", F.lit(1)) - 1)))
    h = h.repartition(n, "key", "share").hint("shuffle_hash").alias("h")
    same = (F.col("b.key") == F.col("h.key")) & (F.col("b.share") == F.col("h.share")) & F.col("b.page_id").eqNullSafe(F.col("h.page_id")) & (F.col("b.digest") == F.col("h.digest"))
    rows = b.join(h, same).select("b.page_id", "b.url", F.when(F.col("record_type") == "response", F.col("b.body")).alias("body"), "b.digest", "payload_bytes", "record_type", "refers_to", "refers_url")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, out, made = TaskContext.get(), None, []
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        stem = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"

        def ended():
            out.close()
            fs.move(f"{root}/{name}.part", f"{root}/{name}")
            made.append({"file": f"{folder}/{name}", "n_records": records, "n_bytes": size})

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    name, records, size = f"{stem}-{len(made):04d}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}.part", compression=None)
                    info = f"software: langdrift\r\nformat: WARC File Format 1.1\r\nfile: {name}\r\n".encode()
                    out.write(gzip.compress(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: %s\r\nWARC-Date: %s\r\nWARC-Filename: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (record_id(None, f"{folder}/{name}").encode(), date.encode(), name.encode(), len(info), info), mtime=0))
                revisit = r["record_type"] == "revisit"
                urn = record_id(None if revisit else r["page_id"], f"{folder}/{name}#{records}", r["digest"])
                url = clean_header(r["url"])
                fields = [("WARC-Target-URI", url)] if url else []
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % r["payload_bytes"]
                if revisit:
                    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(r["refers_to"], "", r["digest"])), ("WARC-Refers-To-Date", date)]
                    if r["refers_url"]:
                        fields.append(("WARC-Refers-To-Target-URI", clean_header(r["refers_url"])))
                else:
                    http += r["body"].encode()
                if r["page_id"] is not None:
                    fields.append(("X-Page-ID", str(r["page_id"])))
                fields.append(("X-Payload-Length", str(r["payload_bytes"])))
                digest = base64.b32encode(bytes.fromhex(r["digest"])).decode()
                data = warc_record(r["record_type"], urn, date, digest, fields, http, "application/http; msgtype=response")
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= bytes_a_file:
                    ended()
                    out = None
        if out is not None:
            ended()
        if made:
            yield pa.RecordBatch.from_pylist(made)

    return written(rows.mapInArrow(write, "file string, n_records long, n_bytes long"), "warc-files")


def records_of(stream, chunk: int = 1 << 15) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a ``.warc.gz`` stream, a gzip member at a time.

    What follows a member in its chunk is copied for the next one, so chunks are small.
    """
    z, raw, got = zlib.decompressobj(31), b"", []
    while True:
        if not raw and not (raw := stream.read(chunk)):
            break
        got.append(z.decompress(raw))
        raw = z.unused_data if z.eof else b""
        if z.eof:
            head, _, rest = b"".join(got).partition(NEW_LINE * 2)
            lines = head.decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"no WARC/1.1 record: {lines[0][:40]}")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            yield fields, rest[: int(fields["Content-Length"])]
            z, got = zlib.decompressobj(31), []
    if got:
        raise ValueError("the archive is cut short")


def read_archives(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of archives: page_id, payload_bytes, payload_digest, record_type, refers_to[, payload].

    A response's digest and length are those of the payload read; they must equal its headers.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    dealt = files.select("file").repartition(max(1, min(files.count(), 16 * files.sparkSession.sparkContext.defaultParallelism)))

    def read(batches):
        import pyarrow as pa

        types = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload)
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = open_fs(uri)
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for head, block in records_of(stream):
                        kind = head["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        payload = block.partition(NEW_LINE * 2)[2]
                        digest, n = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                        if kind == "response":
                            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                            if (found, len(payload)) != (digest, n):
                                raise ValueError(f"{uri}: a payload of {head['WARC-Record-ID']} doesn't have its digest")
                        page, to = head.get("X-Page-ID"), head.get("WARC-Refers-To")
                        row = {"page_id": int(page) if page else None, "payload_bytes": n, "payload_digest": digest, "record_type": kind, "refers_to": page_of_record_id(to) if to else None}
                        if with_payload:
                            row["payload"] = payload if kind == "response" else None
                            size += len(payload)
                        rows.append(row)
                        if len(rows) >= 10_000 or size > 8_000_000:
                            yield pa.RecordBatch.from_pylist(rows, types)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, types)

    return dealt.mapInArrow(read, schema)


def warc_round_trip(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Writes ``pages`` as archives and reads every record back."""
    return read_archives(write_archives(pages, **options))
