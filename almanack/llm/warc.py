"""WARC archives: a deduplicating writer and a splittable reader.

Every record is a gzip member of its own. Of records with equal payloads of at least
``min_revisit`` bytes, the one with the largest ``page_id`` is a response and the others are
revisits that name it. The reader cuts files into byte ranges; a task looks for the gzip magic in
its range, accepts a candidate only if it inflates to a whole member that begins with a WARC
header, and owns the records that start inside its range, wherever they end.

A NULL payload is an empty one. A NULL ``page_id`` is written as such and is always a response;
repeated rows of the largest id are responses too. A NULL url leaves the header out, and control
characters in it are percent-encoded. An empty table gives no records. Other columns are ignored.
Bytes that belong to no whole record (a torn end, for instance) are skipped. Records of other
writers are read too; what they lack is NULL. A record of any length is held whole by one task, and no more than a few
megabytes of other records with it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanack.llm.common import SLICE_BYTES, shared_folder, staged

MAGIC = b"\x1f\x8b\x08"
RECORD_URN = "urn:almanack:page:"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FETCHED = "2024-01-01T00:00:00Z"
CHUNK = 1 << 20
RECORD_SCHEMA = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
    "refers_to long, payload binary, file string, start long"
)


def open_store(uri: str):
    """The file system of a URI or absolute path, and the path in it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


# ---------------------------------------------------------------- writing


def marked_revisits(pages: DataFrame, min_revisit: int) -> DataFrame:
    """page_id, url, html, digest (hex) and refers_to; counts of equal payloads combine map-side."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    pages = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"))
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    groups = (
        pages.where(size >= min_revisit)
        .groupBy("digest")
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    older = F.col("page_id") < F.col("keeper")
    return pages.join(groups, "digest", "left").withColumn("refers_to", F.when(older, F.col("keeper"))).drop("keeper")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    name = "null" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{RECORD_URN}{name}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Date: {FETCHED}")
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        head += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: <{RECORD_URN}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(
    pages: DataFrame, folder: str, *, min_revisit: int = 1000, max_file_bytes: int = 1 << 30, level: int = 6
) -> DataFrame:
    """Write archives into ``folder``; returns the manifest: file, bytes, records.

    A file's name is new in each attempt of a task, and only files in the manifest count, so a
    repeated task leaves no half or double file behind.
    """

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        part, out, done = TaskContext.get().partitionId(), None, []
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                page_id, url, html, digest, refers_to = (x.as_py() for x in row)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                body = record(page_id, url, (html or "").encode(), digest, refers_to)
                if out is None:
                    name = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz"
                    out, records = store.open_output_stream(f"{base}/{name}", compression=None), 0
                out.write(packer.compress(body) + packer.flush())
                records += 1
                if out.tell() >= max_file_bytes:
                    done.append((name, out.tell(), records))
                    out = out.close()
        if out is not None:
            done.append((name, out.tell(), records))
            out.close()
        yield pa.RecordBatch.from_pylist(
            [{"file": f"{folder}/{n}", "bytes": size, "records": k} for n, size, k in done],
            pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]),
        )

    written = marked_revisits(pages, min_revisit).mapInArrow(write, "file string, bytes long, records long")
    return staged(written, "warc-manifest")


# ---------------------------------------------------------------- reading


def read_archives(
    spark: SparkSession, files: DataFrame, *, split_bytes: int = 4 << 20, with_payload: bool = True
) -> DataFrame:
    """The records of archives; ``files`` holds ``file`` and ``bytes``. One task row per byte range."""
    ranges = files.where("bytes > 0").select(
        "file", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split_bytes))).alias("start")
    )
    # Range rows are tiny, so their number of tasks is set here and not by their size.
    tasks = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    most = 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges.repartition(min(int(tasks), most), "file", "start")
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]

    def read(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                store, path = open_store(row.file)
                with store.open_input_file(path) as source:
                    rows, held = [], 0
                    for start, member in members(source, row.start, min(row.start + split_bytes, row.bytes), row.bytes):
                        rows.append((*parsed(member, with_payload), row.file, start))
                        held += len(member) if with_payload else 0
                        if held > SLICE_BYTES or len(rows) >= 10_000:
                            yield pd.DataFrame(rows, columns=names, dtype=object)
                            rows, held = [], 0
                    yield pd.DataFrame(rows, columns=names, dtype=object)

    return ranges.mapInPandas(read, RECORD_SCHEMA)


def members(source, start: int, stop: int, size: int) -> Iterator[tuple[int, bytes]]:
    """The WARC members that begin in [start, stop), each with its place."""
    data = source.read_at(min(size, stop + len(MAGIC) - 1) - start, start)
    at = 0
    while (at := data.find(MAGIC, at)) >= 0 and start + at < stop:
        member, used = inflated(source, data, at, start, size)
        if member is None:
            at += 1
        else:
            yield start + at, member
            at += used


def inflated(source, data: bytes, at: int, start: int, size: int) -> tuple[bytes | None, int]:
    """The member at ``data[at]`` and its compressed length, or None if it isn't a whole WARC member.

    What lies beyond the range's own bytes is read on, piece by piece, until the member ends.
    """
    unpacker, pieces, place, checked = zlib.decompressobj(31), [], start + at, b""
    chunk = data[at : at + CHUNK]
    try:
        while chunk:
            piece = unpacker.decompress(chunk)
            place += len(chunk)
            pieces.append(piece)
            if len(checked) < 7:
                checked += piece[:7]
                if len(checked) >= 7 and not checked.startswith(b"WARC/1."):
                    return None, 0
            if unpacker.eof:
                whole = b"".join(pieces)
                return (whole if whole.startswith(b"WARC/1.") else None), place - len(unpacker.unused_data) - start - at
            inside = place - start
            chunk = data[inside : inside + CHUNK] or source.read_at(min(CHUNK, size - place), place)
    except zlib.error:
        pass
    return None, 0


def parsed(member: bytes, with_payload: bool) -> tuple:
    """The fields of a record, in the order of the schema up to ``payload``.

    A response's size and digest are those of the payload that is there, whatever its header says. A revisit has none,
    so they come from its headers. Other records, and fields that a record lacks or that can't be read, are NULL.
    """
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    fields = {name.strip().lower(): value.strip() for name, _, value in lines}
    length = fields.get("content-length", "")
    block = rest[: int(length)] if re.fullmatch("[0-9]{1,18}", length) else rest.removesuffix(b"\r\n\r\n")
    kind = fields.get("warc-type")
    size = digest = payload = None
    if kind == "response":
        http, gap, body = block.partition(b"\r\n\r\n")
        payload = body if gap and http.startswith(b"HTTP/") else block
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    elif kind == "revisit":
        stated = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", block.partition(b"\r\n\r\n")[0])
        size, digest = int(stated[1]) if stated else None, digest_of(fields.get("warc-payload-digest", ""))
    url = fields.get("warc-target-uri")
    url = None if url is None else re.sub(r"%(0[0-9A-F]|1[0-9A-F]|20|7F|25)", lambda m: chr(int(m[1], 16)), url)
    refers_to = page_of(fields.get("warc-refers-to", ""))
    return page_of(fields.get("warc-record-id", "")), url, kind, size, digest, refers_to, payload if with_payload else None


def digest_of(stated: str) -> str | None:
    """The SHA-1 of a digest header, written in base 32 or in hexadecimal, as hexadecimal."""
    name, _, value = stated.partition(":")
    if name.lower() != "sha1":
        return None
    if re.fullmatch("[0-9a-fA-F]{40}", value):
        return value.lower()
    return base64.b32decode(value.upper()).hex() if re.fullmatch("[A-Za-z2-7]{32}", value) else None


def page_of(urn: str) -> int | None:
    """The page of a record id that ``record`` made."""
    found = re.fullmatch(rf"<{RECORD_URN}(-?[0-9]{{1,19}})>", urn)
    return int(found[1]) if found else None


def archived(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read the records back."""
    spark = pages.sparkSession
    manifest = write_archives(pages, shared_folder(spark, "warc"), **options)
    return read_archives(spark, manifest)
