"""Stamped event documents as a Spark source and sink (S3).

A document is a JSON list of rows, each with its time, its type and its stamp.  Rows are
range-placed by (document, order), so a long document is written by many tasks, each its own
numbered list; a list is written row by row and never held.  A task writes into a folder of
its own and the commit publishes the folders by one manifest, put in place by a rename: a
failed or repeated task, or a failed job, leaves nothing that a reader sees.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..session import ship_package
from .documents import STAMP_VERSION

FORMAT = "stamped_documents"
#: the key of the stamp in a written row
STAMP_KEY = "document"
MANIFEST = "_manifest.json"
SCHEMA = "doc string, part long, row_no long, t double, type string, stamp struct<version:long,producer:string>, body string, refusal string"


def file_system(path: str):
    """(file system, path inside it) of a local path or of any URI that Arrow can open."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def committed(path: str) -> list[str]:
    """Folders that a finished job has published, relative to the path; none where nothing was written."""
    files, root = file_system(path)
    from pyarrow import fs

    if files.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.NotFound:
        return []
    with files.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())["folders"]


@dataclass
class Folder(WriterCommitMessage):
    """Folder of one task; the files in it stay out of the message, so the driver holds one name per task."""

    name: str
    rows: int


class StampedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, producer: str, overwrite: bool):
        self.path, self.producer, self.overwrite, self.job = path, producer, overwrite, uuid.uuid4().hex

    def name(self, row: dict) -> str:
        """The row as it is written; a row that cannot be named ends the write."""
        old = row.pop("stamp", None)
        if row.get("t") is None or row.get("type") is None:
            raise ValueError(f"a row is named by its time and its type: {row}")
        if old is not None and old["producer"] != self.producer:
            raise ValueError(f"stamped by {old['producer']!r}, not by {self.producer!r}: {row}")
        if old is not None and (old["version"] or 0) > STAMP_VERSION:
            raise ValueError(f"stamped version {old['version']}, newer than {STAMP_VERSION}: {row}")
        row[STAMP_KEY] = {"version": STAMP_VERSION, "producer": self.producer}
        return json.dumps(row, ensure_ascii=False, default=str)

    def write(self, iterator: Iterator) -> Folder:
        files, root = file_system(self.path)
        part, at = TaskContext.get().partitionId(), uuid.uuid4().hex
        folder, rows, doc, out = f"{self.job}/{part:06d}-{at}", 0, None, None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or row["doc"] != doc:
                        if out is not None:
                            out.write(b"]\n")
                            out.close()
                        doc = row["doc"]
                        files.create_dir(f"{root}/{folder}", recursive=True)
                        # documents come in order, so their number in the task names the list
                        out = files.open_output_stream(f"{root}/{folder}/{rows:012d}.json")
                        out.write(b"[")
                        lead = ""
                    out.write((lead + "\n " + self.name(row)).encode())
                    lead, rows = ",", rows + 1
            if out is not None:
                out.write(b"]\n")
        finally:
            if out is not None and not out.closed:
                out.close()
        return Folder(folder, rows)

    def commit(self, messages: list) -> None:
        files, root = file_system(self.path)
        mine = sorted(m.name for m in messages if m is not None and m.rows)
        before = [] if self.overwrite else committed(self.path)
        files.create_dir(root, recursive=True)
        temporary = f"{root}/{MANIFEST}.{self.job}"
        with files.open_output_stream(temporary) as f:
            f.write(json.dumps({"version": STAMP_VERSION, "folders": before + mine}).encode())
        files.move(temporary, f"{root}/{MANIFEST}")

    def abort(self, messages: list) -> None:
        """Nothing is published; folders of the job stay unnamed and can be swept at any time."""


@dataclass
class Part(InputPartition):
    folder: str
    number: int


class StampedReader(DataSourceReader):
    def __init__(self, path: str, producers: Sequence[str]):
        self.path, self.producers = path, list(producers)

    def partitions(self) -> list[Part]:
        return [Part(f, i) for i, f in enumerate(committed(self.path))]

    def refusal(self, row: dict, stamp) -> str | None:
        if row.get("t") is None or row.get("type") is None:
            return "missing time or type"
        if stamp is None:
            return None
        if (stamp.get("version") or 0) > STAMP_VERSION:
            return "newer version"
        if self.producers and stamp.get("producer") not in self.producers:
            return "stamped by another producer"
        return None

    def read(self, partition: Part | None) -> Iterator[tuple]:
        from pyarrow import fs

        if partition is None:  # Spark asks for one empty part where nothing is published
            return
        files, root = file_system(self.path)
        for info in sorted(files.get_file_info(fs.FileSelector(f"{root}/{partition.folder}")), key=lambda i: i.path):
            with files.open_input_stream(info.path) as raw:
                for no, row in enumerate(listed(raw)):
                    stamp = row.get(STAMP_KEY)
                    stamp = stamp if isinstance(stamp, dict) else None
                    t = row.get("t")
                    yield (None if row.get("doc") is None else str(row["doc"]), partition.number, no, None if t is None else float(t), row.get("type"),
                           stamp and (stamp.get("version"), stamp.get("producer")), json.dumps(row, ensure_ascii=False), self.refusal(row, stamp))


def listed(raw, size: int = 1 << 20) -> Iterator[dict]:
    """Rows of a list as the writer lays it out, one a line, read block by block."""
    rest = b""
    while block := raw.read(size):
        *lines, rest = (rest + block).split(b"\n")
        yield from (json.loads(k.strip().removesuffix(b",").removesuffix(b"]")) for k in lines if k.strip() not in (b"[", b"]", b""))
    if rest.strip() not in (b"[", b"]", b""):
        raise ValueError("a list that does not end with its closing bracket")


class StampedDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StampedReader:
        return StampedReader(self.options["path"], [p for p in self.options.get("producers", "").split(",") if p])

    def writer(self, schema, overwrite: bool) -> StampedWriter:
        return StampedWriter(self.options["path"], self.options["producer"], overwrite)


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(StampedDocuments)


def write_documents(rows: DataFrame, path: str, producer: str, order: Sequence[str], overwrite: bool = True, tasks: int | None = None) -> None:
    """Write rows (doc, t, type, stamp and any others) as stamped documents in ``order``.

    One row without a time or type, named by another producer or by a newer version ends the
    whole write and leaves what was published before; ``documents.stamp`` tells such rows apart.
    One writer at a time to a path.  ``tasks`` fixes how many ranges are written; Spark chooses by size if not given.
    """
    register(rows.sparkSession)
    placed = rows.repartitionByRange(*([tasks] if tasks else []), "doc", *order).sortWithinPartitions("doc", *order)
    placed.write.format(FORMAT).option("producer", producer).mode("overwrite" if overwrite else "append").save(path)


def read_documents(spark: SparkSession, path: str, producers: Sequence[str] = ()) -> DataFrame:
    """Rows of the published documents with ``refusal``: why a row cannot be read as named (null: it can).

    Rows of a document are in order of (part, row_no).  ``producers``: the ones the reader knows; all if empty.
    """
    register(spark)
    return spark.read.format(FORMAT).option("producers", ",".join(producers)).load(path)


def numbered(rows: DataFrame) -> DataFrame:
    """Place of each row in its document, from counts per written part."""
    from ..operators.kernels import ordered_index

    return ordered_index(rows, ["doc"], ["row_no"], "part", 1, "position")
