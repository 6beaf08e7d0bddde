"""Document fingerprints: SimHash of weighted terms, and all fingerprints within a Hamming radius by block tables."""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship_package
from . import shingles
from .records import border_key, borders_in, by_pieces, bytes_and_offsets, join_counted, pieces, sampled_borders, staged, tidy

BITS = 256              # of a fingerprint
RADIUS = 11             # bits in which two fingerprints may differ
LONG_WORD, WINDOW = 32, 12  # bytes: a longer word also counts as its windows of so many bytes
WEIGHT = 16             # steps of a term's weight, which is 1 + ln(occurrences)
BUCKET_ROWS = 2048      # rows between two borders of the ordered notes, about
CELL_ROWS = 1024        # fingerprints of a cell side
_WORDS = BITS // 64


def _terms(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every term: words, pairs of neighbours, and byte windows of words too long to be words."""
    h, row = shingles.words(data, ends)
    same = row[:-1] == row[1:]
    pair = shingles.mix(h[:-1] * shingles.PLACE[0] + h[1:] * shingles.PLACE[1])[same]
    hashes, rows = [h, pair], [row, row[:-1][same]]
    start, end = _long_words(data, ends)
    for a, b in zip(start.tolist(), end.tolist()):
        for at in range(a, b - WINDOW + 1, 1 << 20):
            size = min(1 << 20, b - WINDOW + 1 - at)
            window = np.lib.stride_tricks.sliding_window_view(data[at: at + size + WINDOW - 1], WINDOW)
            value = np.zeros(size, np.uint64)
            for j in range(WINDOW):
                value = value * np.uint64(shingles.STEP) + shingles.BYTE[window[:, j]]
            hashes.append(shingles.mix(value))
            rows.append(np.full(size, np.searchsorted(ends, at, "right") - 1))
    return np.concatenate(hashes), np.concatenate(rows)


def _long_words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the words of more than ``LONG_WORD`` bytes; words end with their row."""
    edge = np.union1d(np.flatnonzero(np.diff(np.concatenate(([True], shingles.SPACE[data], [True])))), ends)
    start, end = edge[:-1], edge[1:]
    keep = (end - start > LONG_WORD) & ~shingles.SPACE[data[start]] if len(start) else np.zeros(0, bool)
    return start[keep], end[keep]


@functools.cache
def _table() -> np.ndarray:
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)


def fingerprints(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of ``BITS // 8`` bytes per text: bit b is set if the terms whose hash sets b outweigh the others.

    Votes are whole numbers, so equal texts have equal fingerprints wherever they stand.  They
    are summed per hash byte and turned into bits by a table.  A text without terms has no bit set.
    """
    value, row = _terms(data, ends)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])))[: len(value)])
    times = np.diff(np.append(new, len(value)))
    value, row = value[new], row[new]
    weight = np.rint(WEIGHT * (1 + np.log(times)))
    rows = len(ends) - 1
    border = np.searchsorted(row, np.arange(rows + 1))
    out = np.zeros((rows, BITS // 8), np.uint8)
    place = np.arange(BITS // 8) * 256
    for r in range(rows):
        votes, total = np.zeros(BITS), 0.0
        for at in range(int(border[r]), int(border[r + 1]), 1 << 14):
            to = min(at + (1 << 14), int(border[r + 1]))
            wide = np.stack([shingles.mix(value[at:to] + np.uint64(j + 1)) for j in range(_WORDS)], axis=1).view(np.uint8)
            hist = np.bincount((wide + place).ravel(), np.repeat(weight[at:to], BITS // 8), BITS // 8 * 256)
            votes += (hist.reshape(BITS // 8, 256) @ _table()).ravel()
            total += weight[at:to].sum()
        out[r] = np.packbits(2 * votes > total)
    return out


def of_texts(texts: list[str | None]) -> np.ndarray:
    return fingerprints(*bytes_and_offsets(pa.array(texts, pa.large_string())))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated cosine of the weighted terms of two texts, 0 to 1, from the share of bits in which their fingerprints differ."""
    away = np.unpackbits(a ^ b, axis=-1).sum(-1) / BITS
    return np.clip(np.cos(np.pi * away), 0.0, 1.0)


# -- texts against the notes that follow them --------------------------------------------------------


def half_replaced(text: str, following: str) -> str:
    """The last half of a text (rounded down) replaced by the first code points of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _dealt(keyed: DataFrame, borders) -> DataFrame:
    """Notes with the bucket between borders that holds them; the first note of a bucket also ends the bucket before (``guest``).

    Equal rows that meet in a batch are one row with a count.
    """
    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        edges = borders_in(borders.value)
        times: dict[tuple, list[int]] = {}
        for i, key in enumerate(map(border_key, part.column(0).to_pylist(), part.column(2).to_pylist())):
            times.setdefault(key, [i, 0])[1] += 1
        rows = []
        for key, (i, n) in times.items():
            bucket = bisect.bisect_right(edges, key) - 1
            rows.append((i, n, bucket, 0))
            if edges[bucket] == key:
                rows.append((i, 0, (bucket - 1) % len(edges), 1))
        at, n, bucket, guest = zip(*rows)
        at = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([*(c.take(at) for c in part.columns), pa.array(n, pa.int64()), pa.array(bucket, pa.int32()), pa.array(guest, pa.int32())],
                                          ["id", "text", "h", "times", "bucket", "guest"])

    schema = StructType([*keyed.schema, *StructType.fromDDL("times long, bucket int, guest int")])
    return by_pieces(keyed, work, schema)


MADE = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, times long"


def compare_with_next(notes: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every whole note.

    ``notes(id, text)`` are the workbench's notes.  A note is compared with an edited copy of itself (its
    last half replaced by the beginning of the note that follows) and with that note.  Notes follow each
    other by id, null ids first; rows of one id by a hash of their texts, and equal rows count as
    one in that order, so they get equal answers.  After the last comes the first, and a lone
    note follows itself.  Null texts are empty; fingerprints of texts without words have no bit set;
    an empty table gives no rows; repeated rows are answered one by one; other columns are not read.

    Every text is shuffled once, to the bucket between two borders (sampled keys, so a bucket
    begins at a border and ends with a copy of the next one's first note), and streamed in order.
    """
    spark = notes.sparkSession
    ship_package(spark)
    keyed = notes.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    schema = StructType([keyed.schema["id"], *StructType.fromDDL(MADE)])
    borders, n = sampled_borders(keyed, BUCKET_ROWS)
    if not n:
        return spark.createDataFrame([], schema).drop("times")
    placed = _dealt(keyed, borders).repartition("bucket").sortWithinPartitions("bucket", "guest", F.asc_nulls_first("id"), "h")

    def answer(rows: list[dict], following: dict, kind: pa.DataType) -> pa.RecordBatch:
        texts = [r["text"] for r in rows]
        nexts = [*texts[1:], following["text"]]
        edited = [half_replaced(a, b) for a, b in zip(texts, nexts)]
        own = of_texts([*texts, following["text"]])
        other = of_texts(edited)
        return pa.RecordBatch.from_arrays(
            [pa.array([r["id"] for r in rows], kind), pa.array(list(map(len, texts)), pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
             pa.array([x.tobytes() for x in own[:-1]], pa.binary()), pa.array([x.tobytes() for x in other], pa.binary()),
             pa.array(likeness(own[:-1], other)), pa.array(likeness(own[:-1], own[1:])), pa.array([r["times"] for r in rows], pa.int64())], schema.names)

    def run(batches):
        held: list[dict] = []  # rows of one bucket whose follower is not known yet is the last of these
        for batch in batches:
            kind = batch.schema.field("id").type
            for part in pieces(batch):
                for row in part.to_pylist():
                    if not held:
                        held.append(row)
                        continue
                    last = held[-1]
                    if not row["guest"] and not last["guest"] and (row["id"], row["h"]) == (last["id"], last["h"]):
                        last["times"] += row["times"]
                        continue
                    if row["guest"]:
                        if not last["guest"]:
                            yield answer(held, row, kind)
                        held = [row]
                    elif last["guest"]:
                        held = [row]
                    else:
                        held.append(row)
                if len(held) > 1:
                    yield answer(held[:-1], held[-1], kind)
                    held = held[-1:]

    made = placed.mapInArrow(tidy(run), schema)
    return made.withColumn("_t", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("times", "_t")


# -- fingerprints within a radius -------------------------------------------------------------------


def block_tables(n: int, bits: int = BITS, radius: int = RADIUS) -> list[tuple[np.ndarray, ...]]:
    """Bit positions of each table's key.

    ``bits`` in radius + c blocks: two fingerprints within the radius agree on c blocks at least, so
    one table per choice of c blocks finds them all.  c is the least that leaves a handful of
    fingerprints per key among ``n``: at radius 11, 12 tables up to 16 million, 78 beyond.
    """
    c = 1
    while c * bits // (radius + c) < min(48, n.bit_length() - 3):
        c += 1
    blocks = np.array_split(np.arange(bits), radius + c)
    return [tuple(blocks[i] for i in chosen) for chosen in itertools.combinations(range(radius + c), c)]


def _bit_keys(bits: np.ndarray, tables) -> np.ndarray:
    """One 64-bit key per fingerprint and table."""
    out = np.zeros((len(bits), len(tables)), np.uint64)
    for t, blocks in enumerate(tables):
        packed = np.packbits(bits[:, np.concatenate(blocks)], axis=1)
        key = np.full(len(bits), t + 1, np.uint64)
        for j in range(packed.shape[1]):
            key = key * np.uint64(shingles.STEP) + packed[:, j].astype(np.uint64) + np.uint64(1)
        out[:, t] = shingles.mix(key)
    return out


def linked_classes(prints: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """``fingerprint, class_id, members, n_links`` of every distinct fingerprint of ``prints(id, fingerprint)``.

    Equal fingerprints are one class, named by its smallest id; ``n_links`` is the number of
    other classes within ``radius`` bits.  Classes meet in the permuted block tables; a bucket is
    dealt into blocks of bounded size and every two blocks meet in a cell of their own, where
    distances are counted.  A pair is counted in the first table it shares, and a cell hands on
    one count per class, never its pairs.
    """
    ship_package(prints.sparkSession)
    rows = prints.filter("fingerprint IS NOT NULL")
    classes = staged(rows.groupBy("fingerprint").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("members")), "fingerprint-classes")
    tables = block_tables(classes.count(), radius=radius)

    def keys(batches):
        for batch in batches:
            if batch.num_rows:
                bits = np.unpackbits(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1), axis=1)
                made = _bit_keys(bits, tables).view(np.int64)
                offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(tables))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(made.ravel()))], ["fingerprint", "keys"])

    met = classes.select("fingerprint").mapInArrow(keys, "fingerprint binary, keys array<bigint>").select("fingerprint", F.posexplode("keys").alias("no", "key"))
    groups = met.groupBy("no", "key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("no", "key", F.ceil(F.col("_n") / CELL_ROWS).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
    dealt = met.join(groups, ["no", "key"]).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.groupBy("no", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(
        F.collect_list(F.when(F.col("block") <= F.col("other"), F.col("fingerprint"))).alias("x"), F.collect_list(F.when(F.col("block") > F.col("other"), F.col("fingerprint"))).alias("y"))

    def counts(batches):
        for batch in batches:
            for no, x, y in zip(*(batch.column(c).to_pylist() for c in range(3))):
                got = _cell_links(x, y, no, tables, radius)
                if got is not None:
                    yield got

    links = cells.select("no", "x", "y").mapInArrow(tidy(counts), "fingerprint binary, n long").groupBy("fingerprint").agg(F.sum("n").alias("n_links"))
    return classes.join(links, "fingerprint", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))


def count_links(prints: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """Every row of ``prints(id, fingerprint, ...)`` with its ``class_id`` and ``n_links`` (see ``linked_classes``).

    A class with a third of all rows is never gathered (``join_counted``).  Null fingerprints have neither class nor links; null ids name a class only if it has no other; an empty table
    gives no rows.
    """
    known = staged(linked_classes(prints, radius=radius), "fingerprint-links")
    n = known.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    return join_counted(prints, known, "fingerprint", "members", n, "left")


def _cell_links(x: list[bytes], y: list[bytes], no: int, tables, radius: int) -> pa.RecordBatch | None:
    """Links of each fingerprint of a cell that meet in table ``no`` first; ``y`` is empty where a block meets itself."""
    raw = [*x, *y]
    wide = np.frombuffer(b"".join(raw), np.uint64).reshape(len(raw), -1)
    keys = _bit_keys(np.unpackbits(wide.view(np.uint8), axis=1), tables[:no])
    n = np.zeros(len(raw), np.int64)
    others = slice(len(x), None) if y else slice(0, len(x))
    for a in range(len(x)):
        away = np.bitwise_count(wide[others] ^ wide[a]).sum(1)
        near = np.flatnonzero((away <= radius) & (away > 0)) + (len(x) if y else 0)
        if len(near):
            near = near[~(keys[near] == keys[a]).any(1)]
            n[a] += len(near)
            if y:
                n[near] += 1
    some = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([pa.array([raw[i] for i in some], pa.binary()), pa.array(n[some])], ["fingerprint", "n"]) if len(some) else None


def fingerprint_notes(notes: DataFrame, *, radius: int = RADIUS, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``compare_with_next`` of every note, with its ``class_id`` and ``n_links`` among all fingerprints (``count_links``)."""
    return count_links(staged(compare_with_next(notes, id_col=id_col, text_col=text_col), "fingerprints"), radius=radius)
