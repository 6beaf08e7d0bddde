"""Deterministic sharded WARC writer and reader for the pages of sources."""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..session import ship_package
from .records import border_key, borders_in, by_pieces, pieces, sampled_borders, staged

# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
RECORD_SPACE = uuid.UUID("8c4b6a0e-6d0a-5c8e-9a55-0f6a3a1f2b11")

SHARD_RECORDS = 2048         # records of one shard, about
TASK_BYTES = 128 << 20       # payload that a writing or reading task takes, about
FILE_BYTES = 16 << 20        # a file is closed when its compressed size reaches this
MANIFEST = "shard string, file string, records long, bytes long, sha256 string"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, h: int, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(RECORD_SPACE, f'{page_id}/{h}/{copy}')}>"


def record(page_id: int | None, h: int, copy: int, url: str | None, html: str | None, refers_to: tuple[int, int] | None, date: str) -> bytes:
    """One WARC record; every header and digest is made from the row (``h``: hash of url and payload; ``copy`` counts rows equal in all), so equal rows give equal bytes.

    ``refers_to`` (page id and hash of the response) makes it a revisit.

    A revisit keeps the payload's digest and length in its headers and has an empty block.
    """
    payload, revisit = (html or "").encode(), refers_to is not None
    block = b"" if revisit else HTTP_HEAD % len(payload) + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id, h, copy)), ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")),
        ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)), ("WARC-Block-Digest", "sha1:" + sha1_base32(block)),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None), ("WARC-Refers-To", _record_id(*refers_to, 0) if revisit else None),
        ("Content-Type", "application/http; msgtype=response"), ("X-Page-Id", None if page_id is None else str(page_id)),
        ("X-Payload-Bytes", str(len(payload))), ("X-Refers-To-Page", str(refers_to[0]) if revisit else None),
        ("Content-Length", str(len(block)))]
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in head if v is not None), b"", block, b"", b""])


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] != VERSION:
        raise ValueError("not a WARC record")
    headers = dict(x.decode().split(": ", 1) for x in lines[1:])
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record length differs from its header")
    return headers, rest[:size]


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


class _Shard:
    """Files of one shard under temporary names; a finished file is renamed, a repeated task writes the same bytes again."""

    def __init__(self, folder: str, shard: str, file_bytes: int):
        self.fs, self.root = _filesystem(folder)
        self.shard, self.file_bytes, self.no, self.out, self.done = shard, file_bytes, 0, None, []

    def write(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"{self.shard}-{self.no:04d}.warc.gz"
            self.temp = f"{self.root}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha256()
        member = gzip.compress(data, 6, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.size, self.records = self.size + len(member), self.records + 1
        if self.size >= self.file_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temp, f"{self.root}/{self.name}")
            self.done.append((self.shard, self.name, self.records, self.size, self.sha.hexdigest()))
            self.out, self.no = None, self.no + 1


def revisits(digests: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, h, refers_to, refers_h`` of the rows that repeat a payload: all but those with the largest page id of each digest.

    ``digests(page_id, h, digest, size)`` is narrow; the largest id per digest (of rows with that id, the
    largest hash) is aggregated before it is joined back, so a payload that a third of all pages share is one aggregated row.
    """
    top = digests.filter(F.col("size") >= least_bytes).groupBy("digest").agg(F.max(F.struct("page_id", "h")).alias("_top"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    top = top.select("digest", F.col("_top.page_id").alias("refers_to"), F.col("_top.h").alias("refers_h"))
    older = F.coalesce(F.col("page_id") < F.col("refers_to"), F.col("page_id").isNull() & F.col("refers_to").isNotNull())
    return digests.join(top, "digest").filter(older).select("page_id", "h", "refers_to", "refers_h")


def _tasks(spark: SparkSession, most: int, size: int) -> int:
    """Tasks for ``size`` bytes in ``most`` units that cannot be split."""
    return max(1, min(most, max(4 * spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))))


def write_archives(pages: DataFrame, folder: str, *, least_bytes: int = 0, date: str = "2025-01-01T00:00:00Z", shard_records: int = SHARD_RECORDS,
                   file_bytes: int = FILE_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one WARC record per page into ``folder`` and return the manifest of its files.

    The workbench keeps sources (``sources.url``) but no copies of their pages, so the operator is
    general: ``pages(page_id, url, html)``.  Of equal payloads of at least ``least_bytes`` the one
    with the largest page id is the response, the others revisit it.  Records are in order of
    page id (nulls first) and a hash of url and payload; ranges of about ``shard_records`` records between
    sampled borders of that order make a shard, however ids are spread or repeated, and a shard's files are closed at ``file_bytes`` compressed; each record is a
    gzip member of its own.  The bytes depend on the rows alone.  Payloads are shuffled once:
    digests decide the record types beforehand, and the few marks of repeated payloads meet
    their pages in the writer.

    Tasks write below ``_temporary`` and rename whole files; the manifest (``shard, file, records,
    bytes, sha256``) is written last under a temporary name and renamed, and a reader takes only
    files that it lists, so leftovers of lost tasks are never read.

    Null html is an empty payload; a null url has no target header; rows with one page id are
    written one by one (all responses if that id is the largest of its payload; a null id is
    smaller than any); an empty table gives an empty manifest; other columns are not read.
    """
    spark = pages.sparkSession
    ship_package(spark)
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))
    digest = F.sha2("html", 256)
    rows = rows.withColumn("h", F.xxhash64("url", digest))
    digests = staged(rows.select("page_id", "h", digest.alias("digest"), F.octet_length("html").alias("size")), "page-digests")
    borders, shards = sampled_borders(digests, shard_records, id_col="page_id")
    none = F.lit(None).cast("string")
    both = rows.select("page_id", "h", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("long").alias("refers_h")).unionByName(
        revisits(digests, least_bytes).select("page_id", "h", F.lit(0).alias("kind"), none.alias("url"), none.alias("html"), "refers_to", "refers_h"))

    def deal(part: pa.RecordBatch) -> pa.RecordBatch:
        edges = borders_in(borders.value)
        shard = [bisect.bisect_right(edges, border_key(i, h)) - 1 for i, h in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(shard, pa.int64())], [*part.schema.names, "shard"])

    placed = by_pieces(both, deal, StructType([*both.schema]).add("shard", LongType()), text="html")
    tasks = _tasks(spark, shards, digests.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    sorted_rows = placed.repartition(tasks, "shard").sortWithinPartitions(F.asc("shard"), F.asc_nulls_first("page_id"), F.asc("h"), F.asc("kind"), F.asc("url"), F.asc("html"))
    filesystem, root = _filesystem(folder)
    filesystem.create_dir(f"{root}/_temporary", recursive=True)

    def run(batches):
        at, writer, last, copy, mark = None, None, None, 0, None
        for batch in batches:
            for part in pieces(batch, "html"):
                for row in part.to_pylist():
                    if row["shard"] != at:
                        if writer is not None:
                            writer.close()
                            yield _manifest(writer.done)
                        at, writer, last = row["shard"], _Shard(folder, f"shard-{row['shard']:08d}", file_bytes), None
                    if (row["page_id"], row["h"]) != last:
                        last, copy, mark = (row["page_id"], row["h"]), 0, None
                    if row["kind"] == 0:
                        mark = (row["refers_to"], row["refers_h"])
                        continue
                    writer.write(record(*last, copy, row["url"], row["html"], mark, date))
                    copy += 1
        if writer is not None:
            writer.close()
            yield _manifest(writer.done)

    temp = f"{folder}/_temporary/manifest-{uuid.uuid4().hex}"
    sorted_rows.mapInArrow(run, MANIFEST).write.parquet(temp)
    filesystem.move(_filesystem(temp)[1], f"{root}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def _manifest(done) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))], ["shard", "file", "records", "bytes", "sha256"])


READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the archives that the manifest of ``folder`` lists, digests verified.

    ``payload`` is null for revisits.  Files are read record by record; a file whose digest or
    count differs from the manifest raises an error.
    """
    ship_package(spark)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                filesystem, root = _filesystem(folder)
                rows, size, n, sha = [], 0, 0, hashlib.sha256()
                with filesystem.open_input_stream(f"{root}/{row['file']}", compression=None) as stream:
                    for data in _members(stream, sha):
                        rows.append(_read(data))
                        size, n = size + len(data), n + 1
                        if size >= 4 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                if n != row["records"] or sha.hexdigest() != row["sha256"]:
                    raise ValueError(f"{row['file']} differs from its manifest")
                if rows:
                    yield _batch(rows)

    files = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    held = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    return files.repartitionByRange(_tasks(spark, *held), "file").mapInArrow(run, READ)


def _members(stream, sha, step: int = 1 << 20):
    """Uncompressed gzip members of a stream, one at a time."""
    unzip, out = zlib.decompressobj(31), io.BytesIO()
    while chunk := stream.read(step):
        sha.update(chunk)
        while chunk:
            out.write(unzip.decompress(chunk))
            chunk = unzip.unused_data
            if unzip.eof:
                yield out.getvalue()
                unzip, out = zlib.decompressobj(31), io.BytesIO()
    if out.tell():
        raise ValueError("archive ends inside a record")


def _read(data: bytes):
    h, block = parse(data)
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    if "sha1:" + sha1_base32(block) != h["WARC-Block-Digest"]:
        raise ValueError("block digest differs")
    payload = None
    if h["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if sha1_base32(payload) != digest:
            raise ValueError("payload digest differs")
    number = lambda k: int(h[k]) if k in h else None
    return number("X-Page-Id"), h.get("WARC-Target-URI"), payload, number("X-Payload-Bytes") if payload is None else len(payload), digest, h["WARC-Type"], number("X-Refers-To-Page")


def _batch(rows) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])
