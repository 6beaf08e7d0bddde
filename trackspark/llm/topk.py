"""Exact top-k search over enrolled embeddings by block-at-a-time pruning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .records import staged

BLOCK = 128      # vectors of a document-range block
SHARD = 4096     # vectors of a shard, the unit that travels
PROBES = 2048    # queries of a group
SLOTS = 1024     # most slots that shards are dealt into

PACKED = "name string, ids binary, width int, bits int, vectors binary"


def quantised(embedding, steps: int = 64):
    """floor(steps * x) of every component as a double; null if the vector or a component is null or not finite."""
    good = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(good, F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(float(steps))).cast("long")))


def _pack(name: str, ids: list[int], vectors: list[list[int]]):
    width = max(map(len, vectors), default=0)
    m = np.zeros((len(ids), width), np.int64)
    for i, v in enumerate(vectors):
        m[i, : len(v)] = v
    ends = int(m.min(initial=0)), int(m.max(initial=0))
    bits = next(b for b in (16, 32, 64) if -(1 << b - 1) <= ends[0] and ends[1] < 1 << b - 1)
    return name, np.array(ids, np.int64).tobytes(), width, bits, m.astype(f"int{bits}").tobytes()


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, vector), in the order they come, as packed shards of ``size``; equal neighbours count once."""
    def run(batches):
        part, no = TaskContext.get().partitionId(), 0
        ids, vectors = [], []
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and ids[-1] == i and vectors[-1] == v:
                    continue
                if len(ids) == size:
                    yield _shard(f"{part}-{no}", ids, vectors)
                    ids, vectors, no = [], [], no + 1
                ids.append(i)
                vectors.append(v)
        if ids:
            yield _shard(f"{part}-{no}", ids, vectors)

    return rows.mapInArrow(run, PACKED)


def _shard(name, ids, vectors) -> pa.RecordBatch:
    kinds = (pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(_pack(name, ids, vectors), kinds)], ["name", "ids", "width", "bits", "vectors"])


def _unpack(ids: bytes, width: int, bits: int, vectors: bytes, to: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    m = np.zeros((len(i), to), np.int64)
    m[:, :width] = np.frombuffer(vectors, f"int{bits}").reshape(len(i), width)
    return i, m


def _product(q: np.ndarray, x: np.ndarray, largest: int) -> np.ndarray:
    """Exact integer products q @ x.T: doubles while every sum is below 2**53, else wider integers held to 64 bits."""
    if largest < 1 << 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if largest < 1 << 63:
        return q @ x.T
    exact = q.astype(object) @ x.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Best:
    """The k best (score, id) of each query so far, by score, then smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), np.iinfo(np.int64).min)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)
        self.held = np.zeros((queries, k), bool)

    def kth(self) -> tuple[np.ndarray, np.ndarray]:
        """(score of the k-th, whether there is one)."""
        return self.score[:, -1], self.held[:, -1]

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, valid: np.ndarray) -> None:
        s = np.concatenate((self.score[rows], scores), 1)
        i = np.concatenate((self.id[rows], np.broadcast_to(ids, scores.shape)), 1)
        h = np.concatenate((self.held[rows], valid), 1)
        order = np.lexsort((i, -1 - s, ~h))[:, : self.k]  # -1 - s cannot overflow
        for own, new in ((self.score, s), (self.id, i), (self.held, h)):
            own[rows] = np.take_along_axis(new, order, 1)


def score_shard(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, best: Best) -> int:
    """Add a shard's best to ``best``; returns how many (query, block) pairs were scored.

    A block's bound for a query is the sum over terms (components) of the largest contribution
    any of its vectors can make, from the block's term maxima and minima.  Each query takes its
    blocks by falling bound and stops when the next bound is below its k-th score; in each
    round the queries that chose one block are scored through its forward index together.
    """
    blocks = -(-len(ids) // BLOCK)
    parts = [slice(b * BLOCK, (b + 1) * BLOCK) for b in range(blocks)]
    hi = np.array([x[p].max(0) for p in parts])
    lo = np.array([x[p].min(0) for p in parts])
    largest = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(1, x.shape[1])
    if min(q.min(initial=0), x.min(initial=0)) == np.iinfo(np.int64).min:
        largest = 1 << 63  # the absolute value of the smallest integer is not one
    cut = largest < 1 << 62
    bound = _product(np.maximum(q, 0), hi, largest) + _product(np.minimum(q, 0), lo, largest) if cut else np.full((len(q), blocks), np.iinfo(np.int64).max)
    order = np.argsort(-bound, 1, kind="stable")
    going, scored = np.arange(len(q)), 0
    for turn in range(blocks):
        chosen = order[going, turn]
        kth, full = best.kth()
        on = ~full[going] | (bound[going, chosen] >= kth[going])
        going, chosen = going[on], chosen[on]
        if not len(going):
            break
        scored += len(going)
        for b in np.unique(chosen):
            rows = going[chosen == b]
            scores = _product(q[rows], x[parts[b]], largest)
            valid = query_ids[rows][:, None] != ids[parts[b]][None, :]
            kth, full = best.kth()
            new = (valid & (~full[rows][:, None] | (scores >= kth[rows][:, None]))).any(1)
            if new.any():
                best.add(rows[new], scores[new], ids[parts[b]], valid[new])
    return scored


def search(gallery: DataFrame, probes: DataFrame, k: int = 20, *, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` largest inner products of each probe with all other enrolled embeddings.

    ``gallery(id, embedding)`` and ``probes(id, embedding)`` are enrolled embeddings as integer
    arrays (``quantised``).  Exact: ranks from 1, ties to the smaller id, fewer rows where the
    gallery is smaller.  A probe is not compared with rows of its own id.  Null vectors take no
    part; vectors of different lengths meet in the components both have; an equal row repeated
    counts once; a probe id with several vectors is searched by the smallest of them.  Scores
    beyond 64 bits are held to the largest integer.  An empty side gives no rows.

    Vectors are sorted so that a range of them has its largest and smallest component in the same
    places, which keeps term maxima tight, and packed into shards; probes are packed into groups.
    Each pair of shard and group meets in one cell of a grid, so the work spreads over shards times
    groups and a shard travels once per group; a task keeps the k best of the group it works on,
    so later shards are pruned by earlier ones.  Probe groups against all shards is the stated
    query set, not a join of all rows.
    """
    spark = gallery.sparkSession
    ship_package(spark)
    own = gallery.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("vector")).filter("id IS NOT NULL AND vector IS NOT NULL")
    asked = probes.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("vector")).filter("id IS NOT NULL AND vector IS NOT NULL")
    asked = asked.groupBy("id").agg(F.min("vector").alias("vector"))
    v = F.col("vector")
    lead = [F.array_position(v, F.array_max(v)), F.array_position(v, F.array_min(v)), F.col("id"), v]
    n_shards = max(1, -(-own.count() // SHARD))
    shards = staged(_packed(own.repartitionByRange(n_shards, *lead[:3]).sortWithinPartitions(*lead), SHARD), "gallery-shards")
    n_groups = max(1, -(-asked.count() // PROBES))
    groups = staged(_packed(asked.repartition(n_groups, "id").sortWithinPartitions("id"), PROBES), "probe-groups")
    slots = min(SLOTS, n_shards)
    slot, group = F.pmod(F.xxhash64("name"), F.lit(slots)), F.pmod(F.xxhash64("name"), F.lit(n_groups))
    left = groups.select(group.alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("s"), *[F.col(c).alias(f"q_{c}") for c in groups.columns])
    right = shards.select(slot.alias("s"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long"))).alias("g"), "ids", "width", "bits", "vectors")
    # Spark knows the size of the files, not that every row is repeated for each cell: it would broadcast a side that is many times as large
    cells = left.join(right.hint("merge"), ["g", "s"]).select("q_name", "q_ids", "q_width", "q_bits", "q_vectors", "ids", "width", "bits", "vectors").sortWithinPartitions("q_name")

    def run(batches):
        name = query_ids = best = None
        for batch in batches:
            for r in range(batch.num_rows):
                c = [batch.column(i)[r] for i in range(9)]
                if c[0].as_py() != name:
                    if best is not None:
                        yield _rows(query_ids, best)
                    name, best = c[0].as_py(), None
                to = max(c[2].as_py(), c[6].as_py())
                query_ids, q = _unpack(c[1].as_buffer(), c[2].as_py(), c[3].as_py(), c[4].as_buffer(), to)
                best = best or Best(len(query_ids), k)
                score_shard(query_ids, q, *_unpack(c[5].as_buffer(), c[6].as_py(), c[7].as_py(), c[8].as_buffer(), to), best)
        if best is not None:
            yield _rows(query_ids, best)

    found = cells.mapInArrow(run, "query_id long, id long, score long")
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _rows(query_ids: np.ndarray, best: Best) -> pa.RecordBatch:
    at = best.held
    return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(query_ids[:, None], at.shape)[at]), pa.array(best.id[at]), pa.array(best.score[at])], ["query_id", "id", "score"])
