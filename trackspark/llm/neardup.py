"""Near-duplicate notes: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import shingles
from .records import by_pieces, bytes_and_offsets, id_and_text, join_counted, staged, tidy

ROWS, BANDS = 6, 64      # at similarity 0.75 a pair meets in 11 of 64 buckets on average, in none with probability 4e-6
SLOTS = ROWS * BANDS
CENTRES = 4              # bands share so many choices of a bucket's centre
CELL_ROWS = 256          # members of an open bucket that a task compares at once with as many others ...
CELL_BYTES = 1 << 20     # ... and about so many bytes of their sets
SMALL = 1 << 20          # note ids (8 MB) that may be sent to all tasks; beyond it they are joined
EMPTY = np.iinfo(np.uint64).max


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One-permutation signature of each row with a set, ``SLOTS`` values.

    One hash value places a shingle in a slot and ranks it there; an empty slot takes the value
    of a slot that a hash sequence of its own names, trying on until that one is filled (optimal
    densification: which slot lends depends on nothing but the empty slot and the attempt).
    """
    rows = len(offsets) - 1
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    ranked = shingles.mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    cell = owner * SLOTS + (ranked % np.uint64(SLOTS)).astype(np.int64)
    sig = np.full(rows * SLOTS, EMPTY, np.uint64)
    order = np.argsort(cell, kind="stable")
    cell, value = cell[order], ranked[order] // np.uint64(SLOTS)
    if len(cell):
        begin = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        sig[cell[begin]] = np.minimum.reduceat(value, begin)
    sig = sig.reshape(rows, SLOTS)
    filled = sig != EMPTY
    out = sig.copy()
    r, s = np.nonzero(~filled & filled.any(1)[:, None])
    attempt = np.uint64(0)
    while len(r):
        attempt += np.uint64(1)
        lender = (shingles.mix(s.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + attempt) % np.uint64(SLOTS)).astype(np.int64)
        ok = filled[r, lender]
        out[r[ok], s[ok]] = sig[r[ok], lender[ok]]
        r, s = r[~ok], s[~ok]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band; the band's number is part of it."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    key = np.zeros(parts.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = shingles.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key


def _sketch(part: pa.RecordBatch) -> pa.RecordBatch:
    value, offsets = shingles.sets(*bytes_and_offsets(part.column(1)))
    n = np.diff(offsets)
    mixed = shingles.mix(value)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed)))
    k1 = total[offsets[1:]] - total[offsets[:-1]]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(shingles.mix(mixed + np.uint64(1)))))
    k2 = total[offsets[1:]] - total[offsets[:-1]]
    keys = band_keys(signatures(value, offsets)).view(np.int64)
    some = n > 0
    bands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(some * BANDS))), pa.int32()), pa.array(keys[some].ravel()))
    return pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), bands], ["id", "n", "k1", "k2", "bands"])


def _full_sets(notes: DataFrame, ids: DataFrame, kind: str, bits: int = 64) -> DataFrame:
    """``id, hashes`` (whole sets, ``bits`` of each hash) of the named notes."""
    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        value, offsets = shingles.sets(*bytes_and_offsets(part.column(1)))
        raw, step = value.astype(f"uint{bits}").tobytes(), bits // 8
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([raw[step * a: step * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())], ["id", "hashes"])

    named = F.broadcast(ids) if ids.count() <= SMALL else ids
    return by_pieces(notes.join(named, "id", "left_semi"), work, f"id {kind}, hashes binary")


def _confirmed(notes: DataFrame, pairs: DataFrame, share: tuple[int, int], kind: str) -> DataFrame:
    """Those of ``pairs(a, b)`` whose full sets reach the similarity."""
    pairs = staged(pairs, "near-pairs")
    ids = staged(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near-ids")
    sets = staged(_full_sets(notes, ids, kind), "near-sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b")

    def work(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(share[1] * common >= share[0] * (len(p) + len(q) - common))
            out = batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            if out.num_rows:
                yield out

    return staged(both.select("a", "b", "x", "y").mapInArrow(tidy(work), f"a {kind}, b {kind}"), "near-links")


def components(links: DataFrame) -> DataFrame:
    """``id, component``: every linked id but the smallest with the smallest id it can reach.

    Alternates two steps until all that is left are stars round their smallest node: every node hands its
    larger neighbours to its smallest neighbour, then its smaller ones; chains halve each time.
    Every step aggregates per node before it joins and a hub's edges stay where they are (``join_counted``).
    Aggregates and steps are each written once to the shared folder: their parts are read several times by
    the next join, and as one nested plan they would be planned, sent and run anew for each reading.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "near-edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")), "near-least")
        chained, n = least.agg(F.coalesce(F.max((F.col("m") < F.col("u")) & (F.col("_n") > 1)), F.lit(False)), F.coalesce(F.sum("_n"), F.lit(0))).first()
        if not chained:  # a node with a smaller neighbour has no other
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        larger = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = join_counted(larger, least.withColumn("m", F.least("m", "u")), "u", "_n", n)
        large = staged(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "near-edges")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")), "near-least")
        small = join_counted(large, least, "u", "_n", n // 2).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = staged(small.select("e.u", "e.v").filter("u <> v").distinct(), "near-edges")


def _labelled(members: DataFrame, parts: DataFrame) -> DataFrame:
    return members.join(parts.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _open(members: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component, with the bucket's number of blocks; ``astray``: outside its commonest component."""
    kinds = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("_m"), F.sum("n").alias("_s"))
    blocks = F.ceil(F.greatest(F.sum("_m") / CELL_ROWS, F.sum("_s") * 4 / CELL_BYTES)).cast("int")
    keys = kinds.groupBy("key").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("_kinds"), F.max(F.struct("_m", "component")).alias("_c"))
    keys = keys.filter("_kinds > 1").select("key", "blocks", F.col("_c.component").alias("_common"))
    return members.join(keys, "key").withColumn("astray", F.col("component") != F.col("_common")).drop("_common")


def _star(members: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Distinct pairs (a, b), a < b, of each bucket's centre with its members."""
    turn = F.pmod(F.col("key"), F.lit(CENTRES))
    centre = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep", turn).alias("h"), "rep", "n")).alias("c")).select("key", F.col("c.rep").alias("c"), F.col("c.n").alias("m"))
    fits = F.least("n", "m") * share[1] >= F.greatest("n", "m") * share[0]  # set sizes alone rule other pairs out
    met = members.join(centre, "key").filter((F.col("rep") != F.col("c")) & fits)
    return met.select(F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b")).distinct()


def _rest(notes: DataFrame, left: DataFrame, share: tuple[int, int], kind: str) -> DataFrame:
    """Pairs of open buckets that the stars left apart and that reach the similarity.

    A bucket is dealt into blocks of bounded size.  Members of its commonest component stay in their block, the
    others are copied to every block and compared there with all that are at home in it, so copies
    follow the stragglers.  Whole sets (32 bits of each hash, which can only add to a count) are compared
    through inverted lists.  Pairs are made and judged inside the task; only those that pass
    leave it, and they are confirmed on the full hashes like all others.
    """
    ids = staged(left.select(F.col("rep").alias("id")).distinct(), "near-ids")
    sets = _full_sets(notes, ids, kind, 32).withColumnRenamed("id", "rep")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    visits = F.when(F.col("astray"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    dealt = left.join(sets, "rep").withColumn("block", block).withColumn("cell", F.explode(visits))
    row = F.struct("rep", "component", "n", "astray", (F.col("block") == F.col("cell")).alias("home"), "hashes")
    cells = dealt.groupBy("key", "cell").agg(F.collect_list(row).alias("m"))

    def work(batches):
        for batch in batches:
            for m in batch.column(0):
                pairs = _compare(m.values, share)
                if pairs.num_rows:
                    yield pairs

    return cells.select("m").mapInArrow(tidy(work), f"a {kind}, b {kind}").distinct()


def _compare(m: pa.StructArray, share: tuple[int, int]) -> pa.RecordBatch:
    """Pairs of a cell in different components, a straggler and a member at home, whose counts reach the similarity."""
    rep, component, n, astray, home = (m.field(c) for c in range(5))
    _, component = np.unique(np.array(component.to_pylist(), object).astype(str), return_inverse=True)
    n, astray, home = (x.to_numpy(zero_copy_only=False) for x in (n, astray, home))
    sets = [np.frombuffer(x.as_buffer(), np.uint32) for x in m.field(5)]
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    found = []
    for x in np.flatnonzero(astray):
        a, b = np.searchsorted(flat, sets[x], "left"), np.searchsorted(flat, sets[x], "right")
        size = b - a
        at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
        shared = np.bincount(owner[at], minlength=len(sets))
        good = (share[1] * shared >= share[0] * (n + n[x] - shared)) & (component != component[x]) & home
        found += [(min(p, q), max(p, q)) for p, q in ((rep[int(x)].as_py(), rep[int(y)].as_py()) for y in np.flatnonzero(good))]
    found = sorted(set(found))
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], rep.type), pa.array([q for _, q in found], rep.type)], ["a", "b"])


def near_duplicates(notes: DataFrame, *, share: tuple[int, int] = (75, 100), id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id, kept``: one note of each group of near copies stays.

    ``notes(id, text)`` are the workbench's notes.  A note's set holds its distinct shingles of
    five words (lower-cased A-Z, split at ASCII white space); fewer words make one shingle.  Notes
    are linked when their sets' intersection reaches ``share`` of their union; a component is named
    by its smallest id, which is the note that stays.

    Equal sets are one class before anything is compared.  Classes meet in buckets of equal
    bands; a bucket compares its members with a centre (one of four choices, so that groups are
    tied together by several stars), and links are confirmed on full sets.  Buckets that still hold
    several components are finished exactly, block by block inside tasks.  So candidate pairs
    follow the number of members, and a link between unlike texts is lost only if no band shows it.

    Null, empty or wordless texts have an empty set and are linked with nothing; rows with a null
    id are answered with a null component and stay; repeated rows are answered one by one; an
    empty table gives no rows; other columns are not read.
    """
    return _judged(notes, share, id_col, text_col).select("id", F.col("n").alias("n_shingles"), "component_id", "kept")


def _judged(notes: DataFrame, share: tuple[int, int], id_col: str, text_col: str) -> DataFrame:
    """``near_duplicates`` with the two checksums of each row's set."""
    texts = id_and_text(notes, id_col, text_col)
    kind = texts.schema["id"].dataType.simpleString()
    sketch = staged(by_pieces(texts, _sketch, f"id {kind}, n long, k1 long, k2 long, bands array<bigint>"), "near-sketch")
    known = sketch.filter("id IS NOT NULL AND n > 0")
    classes = staged(known.groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands")), "near-classes")
    banded = classes.select("rep", "n", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("key")
    members = staged(banded.join(shared, "key").withColumn("component", F.col("rep")), "near-members")
    wanted = texts.filter("id IS NOT NULL AND text IS NOT NULL")
    links = _confirmed(wanted, _star(members, share), share, kind)
    top = components(links)
    left = staged(_open(_labelled(members.drop("component"), top)), "near-open")
    if not left.isEmpty():
        more = _confirmed(wanted, _rest(wanted, left, share, kind), share, kind)
        top = components(more.union(top.select(F.col("id").alias("a"), F.col("component").alias("b"))))  # what is tied stays tied
    own = classes.select("k1", "k2", F.col("n"), F.col("rep"))
    grouped = own.join(top.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", "n", F.coalesce("component", "rep").alias("component"))
    out = sketch.drop("bands").join(grouped, ["k1", "k2", "n"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component"))).otherwise(F.col("id"))
    return out.select("id", "n", "k1", "k2", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one(notes: DataFrame, *, share: tuple[int, int] = (75, 100), id_col: str = "id", text_col: str = "text") -> DataFrame:
    """The rows of ``notes``, all columns, without the near copies: one note of each component stays.

    Notes without words stay, as do rows with a null id.  Rows that share an id are judged each by its own
    set: unlike texts of one id stay or go on their own, and of equal sets under one id the row with the smallest text stays.
    """
    judged = staged(_judged(notes, share, id_col, text_col), "near-judged")
    gone = judged.filter("NOT kept").select(F.col("id").alias(id_col)).distinct()
    repeated = staged(judged.filter("id IS NOT NULL").groupBy("id").count().filter("count > 1").select(F.col("id").alias(id_col)), "near-repeated")
    if repeated.isEmpty():
        return notes.join(F.broadcast(gone) if gone.count() <= SMALL else gone, id_col, "left_anti")
    once = notes.join(repeated, id_col, "left_anti").join(gone, id_col, "left_anti")
    again = notes.join(repeated, id_col, "left_semi").select(F.col(f"`{text_col}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in notes.columns]).alias("row"))

    def keyed(part: pa.RecordBatch) -> pa.RecordBatch:
        got = _sketch(pa.RecordBatch.from_arrays([part.column(0), part.column(0)], ["id", "text"]))
        return pa.RecordBatch.from_arrays([*part.columns, *(got.column(c) for c in (1, 2, 3))], ["text", "row", "n", "k1", "k2"])

    sets = by_pieces(again, keyed, StructType([*again.schema, *StructType.fromDDL("n long, k1 long, k2 long")])).withColumn("id", F.col(f"row.`{id_col}`"))
    stays = judged.filter("kept").select("id", "n", "k1", "k2").distinct()
    one = sets.filter("n > 0").groupBy("id", "n", "k1", "k2").agg(F.min_by("row", "text").alias("row")).join(stays, ["id", "n", "k1", "k2"], "left_semi")
    return once.unionByName(sets.filter("n = 0").select("row").unionByName(one.select("row")).select("row.*"))
