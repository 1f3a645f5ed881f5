"""WARC archives of Zstandard frames.

An archive starts with a skippable frame that holds the dictionary (itself
compressed), then has one frame per record.  The writer deals pages into
archives of bounded size; the reader loads the dictionary from the leading
frame, decodes one record at a time and checks headers, lengths and digests.

Archives are files in a folder that all executors see; pyarrow's file
systems open it, so the folder can be local, HDFS or an object store.  Names
are unique per attempt and only the finished attempts' names are in the
manifest, so that lost executors and repeated tasks leave no half archives
in a result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import qualified, shared_dir, table, tune, written

#: Fixed value: magic number of the skippable frame that carries a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
MIN_REVISIT = 1000
ARCHIVE_BYTES = 64 << 20
#: Pages that train the dictionary, and the bytes of each that it sees. The records themselves are whole.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 8192, 64 << 10
MAX_RECORD = 1 << 31


class WarcError(ValueError):
    """An archive that breaks the format; the message says where."""


def train_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or no bytes when there is too little to learn from."""
    samples = [s for s in samples if len(s) >= 64]
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 10 + 256), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _leading_frame(dictionary: bytes) -> bytes:
    body = zstandard.ZstdCompressor(level=3).compress(dictionary) if dictionary else b""
    return struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body


def record(page_id, url, payload: bytes, digest: bytes, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head and leaves the payload out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}"] if url else []),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes, where: str = "record") -> dict:
    """Check one decoded record and take it apart."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError(f"{where}: no WARC head")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        key, colon, value = line.decode().partition(":")
        if not colon or not key or key.lower() in fields:
            raise WarcError(f"{where}: bad header line {line!r}")
        fields[key.lower()] = value.strip()
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if need not in fields:
            raise WarcError(f"{where}: {need} is missing")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise WarcError(f"{where}: Content-Length doesn't match the block")
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    found = re.search(rb"\r\nContent-Length: (\d+)", http)
    if not gap or not http.startswith(b"HTTP/1.") or not found:
        raise WarcError(f"{where}: no HTTP head")
    size, kind = int(found[1]), fields["warc-type"]
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
    if kind == "response":
        if len(payload) != size or hashlib.sha1(payload).digest() != digest:
            raise WarcError(f"{where}: the payload doesn't match its length or digest")
    elif kind != "revisit" or payload or "warc-refers-to" not in fields:
        raise WarcError(f"{where}: unknown or broken record type {kind}")
    number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x)) else None
    return {
        "page_id": number(fields["warc-record-id"]),
        "url": unquote(fields["warc-target-uri"]) if "warc-target-uri" in fields else None,
        "payload": payload if kind == "response" else None,
        "payload_bytes": size,
        "payload_digest": digest.hex(),
        "record_type": kind,
        "refers_to": number(fields["warc-refers-to"]) if kind == "revisit" else None,
    }


class ArchiveWriter:
    def __init__(self, out, dictionary: bytes):
        self.out = out
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=data, write_content_size=True)
        self.size = self.out.write(_leading_frame(dictionary))
        self.records = 0

    def add(self, raw: bytes) -> None:
        frame = self.compressor.compress(raw)
        self.out.write(frame)
        self.size += len(frame)
        self.records += 1


def read_archive(source, where: str = "archive") -> Iterator[dict]:
    """Records of one archive in order; ``source`` is a binary file. Holds one record and one read block at a time."""
    start = source.read(8)
    if len(start) < 8 or struct.unpack("<II", start)[0] != DICTIONARY_MAGIC:
        raise WarcError(f"{where}: no leading dictionary frame")
    body = source.read(struct.unpack("<II", start)[1])
    if len(body) < struct.unpack("<II", start)[1]:
        raise WarcError(f"{where}: the dictionary frame is cut off")
    if body[:4] == b"\x28\xb5\x2f\xfd":
        body = zstandard.ZstdDecompressor().decompress(body, max_output_size=64 << 20)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body) if body else None)
    pending, number = b"", 0
    while True:
        if not pending and not (pending := source.read(1 << 16)):
            return
        frame, parts = decoder.decompressobj(), []
        while not frame.eof:
            if not pending and not (pending := source.read(1 << 16)):
                raise WarcError(f"{where}: record {number} is cut off")
            try:
                parts.append(frame.decompress(pending))
            except zstandard.ZstdError as e:
                raise WarcError(f"{where}: record {number}: {e}") from e
            pending = frame.unused_data if frame.eof else b""
        yield parse(b"".join(parts), f"{where}: record {number}")
        number += 1


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


MANIFEST = "path string, records long, bytes long"


def write_archives(pages: DataFrame, folder: str | None = None, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html); returns the manifest of the archives.

    Of the rows with equal payloads of at least ``min_revisit`` bytes, those
    with the largest page_id are responses (a repeated row repeats it) and
    the others revisit it; a null page_id is smaller than any.  A null html
    is an empty payload.  Other columns are not archived.
    """
    spark = pages.sparkSession
    tune(spark)
    folder = qualified(spark, folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    sample = rows.select("page_id", F.substring("html", 1, SAMPLE_BYTES).alias("h")).orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_PAGES)
    dictionary = train_dictionary([r["h"].encode() for r in sample.toLocalIterator()])
    marked = rows.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary")))).withColumn("big", F.octet_length("html") >= min_revisit)
    # Only digests and ids meet here; the html is joined to the digests that more than one row has.
    first = marked.where("big").groupBy("sha").agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "newest", F.lit(True).alias("big"))
    joined = marked.join(first, ["sha", "big"], "left").select("page_id", "url", "html", "sha", F.when(F.col("page_id") < F.col("newest"), F.col("newest")).when(F.col("page_id").isNull(), F.col("newest")).alias("refers"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _file_system(folder)
        system.create_dir(path, recursive=True)
        done, writer, out, name = [], None, None, ""

        def close() -> None:
            out.close()
            done.append((name, writer.records, writer.size))

        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "html", "sha", "refers")]
            cols[2] = cols[2].cast(pa.large_binary() if pa.types.is_large_string(cols[2].type) else pa.binary())
            for i in range(batch.num_rows):
                if writer is None:
                    name = f"{path}/{uuid.uuid4().hex}.warc.zst"
                    out = system.open_output_stream(name, compression=None)
                    writer = ArchiveWriter(out, dictionary)
                page_id, url, html, sha, refers = (c[i].as_py() for c in cols)
                writer.add(record(page_id, url, html, sha, refers))
                if writer.size >= ARCHIVE_BYTES:
                    close()
                    writer = None
        if writer is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "records", "bytes"])

    return written(joined.mapInArrow(write, MANIFEST), "warc-manifest")


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Rows of every record of the archives in ``manifest``; with ``payloads`` also url and html (null for revisits)."""
    names = [c.split()[0] for c in RECORDS.split(", ")] + (["url", "payload"] if payloads else [])
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(folder)
        for batch in batches:
            for name, expected in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows, seen, held = [], 0, 0

                def flush(rows):
                    cols = zip(*rows, strict=True)
                    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=False)], names=names)

                with system.open_input_stream(name, compression=None) as source:
                    for r in read_archive(source, name):
                        rows.append([r[n] for n in names])
                        seen += 1
                        held += r["payload_bytes"] if payloads else 100
                        if len(rows) >= 1000 or held > 16 << 20:
                            yield flush(rows)
                            rows, held = [], 0
                if rows:
                    yield flush(rows)
                if seen != expected:
                    raise WarcError(f"{name}: {seen} records, the manifest has {expected}")

    spread = manifest.repartition(max(1, min(10_000, manifest.count())), "path")
    return spread.mapInArrow(read, RECORDS + (", url string, payload binary" if payloads else ""))


def op4_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` into archives in the shared folder, and back."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(table(spark, sf_dir, "pages"), folder), folder)


QUERIES = {"op4_warc_zstd": op4_warc_zstd}
ORACLES = {
    "op4_warc_zstd": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
f AS (SELECT h, max(page_id) AS newest FROM p WHERE n >= 1000 GROUP BY h)
SELECT p.page_id, p.n AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN p.page_id < f.newest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id < f.newest THEN f.newest END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h AND p.n >= 1000
"""
}
