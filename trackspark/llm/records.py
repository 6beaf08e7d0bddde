"""Shared steps: Arrow batches in bounded pieces, and shared folders for files that must outlive an executor."""

from __future__ import annotations

import ctypes
import functools
import gc
import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ship_package

PIECE_BYTES = 1 << 19  # text handled at once inside a task; a longer text is a piece of its own


def id_and_text(notes: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Exactly the two columns an operator reads, so that extra columns never clash."""
    return notes.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold at most ``limit`` bytes (one row at least)."""
    col = batch.column(batch.schema.get_field_index(text))
    if not len(col):
        return
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    ends = np.frombuffer(col.buffers()[1], kind)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def by_pieces(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text") -> DataFrame:
    """``work`` on bounded slices of the Arrow batches of ``df``; a task never holds more than one batch."""
    ship_package(df.sparkSession)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, text):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(tidy(run), schema)


def give_back() -> None:
    """Return freed memory to the system: an idle worker shares its executor with the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def tidy(run):
    """``run`` over the batches of a task, then ``give_back``."""
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return whole


def bytes_and_offsets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and its row ends (nulls are empty), without making Python strings."""
    wide = pa.types.is_large_string(col.type)
    ends = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[ends[0]: ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write once as Parquet in the shared folder and read back: cuts lineage, keeps column pruning."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def border_key(row_id, h) -> tuple:
    """Order of (id, hash) keys as Spark has it: null ids first."""
    return (row_id is not None, 0 if row_id is None else row_id, h)


def sampled_borders(keyed: DataFrame, every: int, most: int = 1 << 18, id_col: str = "id"):
    """Broadcast of sorted keys of ``keyed(id, h)``, the smallest and about one in ``every`` (fewer where they would exceed ``most``); and their number.

    Keys are chosen by hash, so the borders depend on the rows alone, and ranges between them hold
    about as many distinct keys each however ids are spread or repeated.
    """
    every = max(every, -(-keyed.count() * 2 // most))
    keys = keyed.select(F.col(id_col).alias("id"), "h")
    chosen = keys.filter(F.pmod(F.xxhash64("id", "h"), F.lit(every)) == 0).union(keys.orderBy(F.asc_nulls_first("id"), "h").limit(1)).distinct()
    borders = sorted(border_key(r.id, r.h) for r in chosen.collect())
    return checked_broadcast(keyed.sparkSession, pickle.dumps(borders), 64 << 20, "the borders"), len(borders)


@functools.lru_cache(maxsize=2)
def borders_in(raw: bytes) -> list[tuple]:
    return pickle.loads(raw)


def join_counted(rows: DataFrame, known: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``known``, one row per ``key`` with the number of ``rows`` that have it in ``count``.

    Fewer than a thousand keys can hold more than a thousandth of ``total`` rows each; those keys are
    sent to all tasks, so their rows stay where they are and no task gathers a hot key.
    """
    large = F.col(count) * 1000 > total
    hot = F.broadcast(known.filter(large).drop(count))
    rest = rows.join(hot.select(key), key, "left_anti").join(known.filter(~large).drop(count), key, how)
    return rows.join(hot, key).unionByName(rest)


def checked_broadcast(spark: SparkSession, value: bytes, limit: int, what: str):
    """Broadcast a parameter (a vocabulary, an automaton's source) whose size is checked first."""
    if len(value) > limit:
        raise ValueError(f"{what} holds {len(value)} bytes; at most {limit} may be broadcast")
    return spark.sparkContext.broadcast(value)


_resident: dict = {}


def resident(what: str, raw: bytes, make):
    """The one large object a Python worker keeps: built from ``raw``, dropped when another is asked for.

    Workers outlive a stage, so without this the automata and caches of every operator that ever
    ran on an executor would add up.
    """
    if _resident.get("key") != (what, raw):
        _resident.clear()
        gc.collect()
        _resident.update(key=(what, raw), value=make(raw))
    return _resident["value"]
