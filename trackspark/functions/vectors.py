"""Embedding arithmetic: exact block-wise cosine joins and element-wise means.

Vectors travel packed in blocks of a bounded size, so the shuffle carries each vector once
per block pair instead of once per pair, and no block grows with its group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package

BLOCK = 512


def pack(df: DataFrame, keys: Sequence[str], cols: Sequence[str], block: str, prefix: str) -> DataFrame:
    item = F.struct(*cols, "vec")
    got = df.groupBy(*keys, block).agg(F.collect_list(item).alias("_s"))
    def field(name):
        return F.transform("_s", lambda e: e[name])
    return got.select(*keys, block, *[field(c).alias(prefix + c) for c in cols], F.flatten(field("vec")).alias(prefix + "vec"))


def _unit(flat, n: int) -> np.ndarray:
    m = np.asarray(flat, dtype=np.float64).reshape(n, -1)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.where(np.isnan(norm), np.nan, np.zeros_like(m)), where=norm > 0)


def cosine_blocks(left: DataFrame, right: DataFrame, keys: Sequence[str], lcols: Sequence[str], rcols: Sequence[str],
                  reduce: Callable, schema: str, size: int = BLOCK) -> DataFrame:
    """Exact all-against-all cosines inside each key, reduced block by block.

    ``reduce(sims, left, right) -> dict of columns`` gets the similarity matrix of one
    block pair and the id columns of both sides; whatever it returns is all that leaves
    the task.  Zero vectors give 0.0, NaN stays NaN.
    """
    ship_package(left.sparkSession)
    ks = list(keys) or ["_k"]
    if not keys:
        left, right = left.withColumn("_k", F.lit(0)), right.withColumn("_k", F.lit(0))
    def blocks(df, name):
        return df.groupBy(*ks).agg(F.ceil(F.count(F.lit(1)) / size).alias(name))
    nl, nr = blocks(left, "_nl"), blocks(right, "_nr")
    l = left.join(nl, ks).withColumn("_lb", F.pmod(F.xxhash64(*lcols), F.col("_nl")))
    r = right.join(nr, ks).withColumn("_rb", F.pmod(F.xxhash64(*rcols), F.col("_nr")))
    lp = pack(l, ks, lcols, "_lb", "l_").join(nr, ks).withColumn("_rb", F.explode(F.sequence(F.lit(0), F.col("_nr") - 1)))
    rp = pack(r, ks, rcols, "_rb", "r_")
    pairs = lp.join(rp, [*ks, "_rb"]).drop("_nr")

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                a = {c: np.asarray(row["l_" + c]) for c in lcols}
                b = {c: np.asarray(row["r_" + c]) for c in rcols}
                na, nb = len(a[lcols[0]]), len(b[rcols[0]])
                out = pd.DataFrame(reduce(_unit(row["l_vec"], na) @ _unit(row["r_vec"], nb).T, a, b))
                for k in keys:
                    out[k] = row[k]
                if len(out):
                    yield out

    return pairs.mapInPandas(run, schema)


#: pivots that place vectors into blocks, chosen from four times as many: they decide only how tight blocks are
PIVOTS = 1024
_SLACK = 1e-9


def spread_out(m: np.ndarray, k: int) -> np.ndarray:
    """At most ``k`` of the rows, each the one farthest from those before it."""
    own = (m * m).sum(axis=1)
    picked, away = [0], own + own[0] - 2 * (m @ m[0])
    while len(picked) < k:
        at = int(np.argmax(away))
        if away[at] <= _SLACK:
            break
        picked.append(at)
        away = np.minimum(away, own + own[at] - 2 * (m @ m[at]))
    return m[picked]


def metric_blocks(df: DataFrame, cols: Sequence[str], prefix: str, size: int = BLOCK) -> DataFrame:
    """Unit vectors packed in blocks of near ones: (block, count, id arrays, vec, centre, radius).

    Every vector goes to its nearest pivot; a pivot with more than ``size`` vectors is split by hash.  At most
    ``PIVOTS`` vectors, spread out among the first by hash, are pivots.  Vectors that hold NaN have a cell of their own
    with an infinite radius; rows without a vector take no part.  The table is written once: the index is
    read by every step of a search.
    """
    ship_package(df.sparkSession)
    df = df.select(*cols, "vec").filter(F.col("vec").isNotNull())
    n = df.count()
    order = F.xxhash64(*cols)
    wanted = int(min(PIVOTS, -(-n // size)))
    first = df.filter(~F.exists("vec", F.isnan)).orderBy(order, *cols).limit(4 * wanted).select("vec").collect()
    pivots = spread_out(_unit([r["vec"] for r in first], len(first)), wanted) if first else np.zeros((0, 0))
    half = (pivots * pivots).sum(axis=1) / 2

    def place(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            m = _unit(np.stack(pdf["vec"].to_numpy()), len(pdf))
            bad = np.isnan(m).any(axis=1)
            cell = np.argmax(np.nan_to_num(m) @ pivots.T - half, axis=1) if len(pivots) else np.zeros(len(m), dtype=np.int64)
            yield pdf.assign(_c=np.where(bad, -1, cell))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    # cells are counted and packed from one written placing
    placed = cut_lineage(df.mapInPandas(place, fields + ", _c long"))
    counts = placed.groupBy("_c").agg(F.ceil(F.count(F.lit(1)) / size).alias("_n"))
    blocks = placed.join(counts, "_c").withColumn("_b", F.struct("_c", F.pmod(F.xxhash64(*cols), F.col("_n")).alias("_p")))
    packed = pack(blocks, [], cols, "_b", prefix)

    def summarise(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            got = []
            for cell, flat, n in zip(pdf["_cell"], pdf[prefix + "vec"], pdf[prefix + "n"]):
                m = _unit(flat, n)
                centre = np.nan_to_num(m).mean(axis=0)
                got.append((centre, np.inf if cell < 0 else float(np.sqrt(((m - centre) ** 2).sum(axis=1).max()))))
            yield pdf.assign(**{prefix + "centre": [c for c, _ in got], prefix + "radius": [r for _, r in got]}).drop(columns="_cell")

    shaped = packed.select((F.shiftleft(F.col("_b._c") + 1, 32) + F.col("_b._p")).alias(prefix + "block"), F.col("_b._c").alias("_cell"), F.size(prefix + cols[0]).alias(prefix + "n"),
                           *[prefix + c for c in cols], prefix + "vec")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shaped.drop("_cell").schema) + f", {prefix}centre array<double>, {prefix}radius double"
    return cut_lineage(shaped.mapInPandas(summarise, schema))


def _pair_bounds(c: np.ndarray, cr: np.ndarray, d: np.ndarray, dr: np.ndarray) -> np.ndarray:
    """No cosine of blocks with centres c and radii cr (rows) and blocks with d and dr (columns) is above these.

    Centres c, d and radii r, s: a . b <= c . d + |c| s + |d| r + r s, and for vectors no longer than one
    a . b <= 1 - max(0, |c - d| - r - s)^2 / 2; the smaller one counts.
    """
    cr, dr = cr[:, None], dr[None, :]
    dot, cn, dn = c @ d.T, np.linalg.norm(c, axis=1)[:, None], np.linalg.norm(d, axis=1)[None, :]
    away = np.sqrt(np.maximum(cn * cn + dn * dn - 2 * dot, 0.0))
    whole = np.isfinite(cr) & np.isfinite(dr)
    cr, dr = np.where(whole, cr, 0.0), np.where(whole, dr, 0.0)
    bound = np.minimum(dot + cn * dr + dn * cr + cr * dr, 1 - np.maximum(away - cr - dr, 0.0) ** 2 / 2) + _SLACK
    return np.where(whole, bound, np.inf)


def block_bounds(left: DataFrame, right: DataFrame, group: int = BLOCK) -> DataFrame:
    """(l_block, r_block, bound): no cosine of the block pair is above ``bound``.  Centres meet group against group."""
    def grouped(df, p, name):
        n = max(1, -(-df.count() // group))
        head = df.withColumn(name, F.pmod(F.xxhash64(p + "block"), F.lit(n)))
        return n, head.groupBy(name).agg(F.collect_list(F.struct(p + "block", p + "centre", p + "radius")).alias(p + "s"))
    _, l = grouped(left, "l_", "_lg")
    nr, r = grouped(right, "r_", "_rg")
    pairs = l.withColumn("_rg", F.explode(F.sequence(F.lit(0), F.lit(nr - 1)))).join(r.withColumn("_rg", F.col("_rg").cast("int")), "_rg").select("l_s", "r_s")

    def run(batches):
        for pdf in batches:
            for ls, rs in zip(pdf["l_s"], pdf["r_s"]):
                bound = _pair_bounds(*(np.array([k[p + x] for k in ks]) for p, ks in (("l_", ls), ("r_", rs)) for x in ("centre", "radius")))
                i, j = np.indices(bound.shape).reshape(2, -1)
                yield pd.DataFrame({"l_block": np.array([k["l_block"] for k in ls])[i], "r_block": np.array([k["r_block"] for k in rs])[j], "bound": bound.ravel()})

    return pairs.mapInPandas(run, "l_block long, r_block long, bound double")


def score_blocks(left: DataFrame, right: DataFrame, pairs: DataFrame, lcols: Sequence[str], rcols: Sequence[str], reduce: Callable, schema: str) -> DataFrame:
    """``reduce(sims, left, right)`` of the given block pairs only; blocks meet by their own ids.

    A result column ``l_block`` in the schema is filled in.
    """
    named = "l_block" in [k.split()[0] for k in schema.split(", ")]
    met = pairs.select("l_block", "r_block").join(left.drop("l_centre", "l_radius", "l_n"), "l_block").join(right.drop("r_centre", "r_radius", "r_n"), "r_block")

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                a = {c: np.asarray(row["l_" + c]) for c in lcols}
                b = {c: np.asarray(row["r_" + c]) for c in rcols}
                out = pd.DataFrame(reduce(_unit(row["l_vec"], len(a[lcols[0]])) @ _unit(row["r_vec"], len(b[rcols[0]])).T, a, b))
                if len(out):
                    yield out.assign(l_block=row["l_block"]) if named else out

    return met.mapInPandas(run, schema)


#: bytes of vectors of one side of a cell, rows of results held before they leave a task, cells for each core
CELL_BYTES, HELD, PER_CORE = 1 << 25, 1 << 18, 3


def score_cells(left: DataFrame, right: DataFrame, bar: float, lcols: Sequence[str], rcols: Sequence[str], reduce: Callable, schema: str) -> DataFrame:
    """The distinct rows of ``reduce(sims, left, right)`` over the block pairs whose bound reaches ``bar``.

    Blocks are dealt into groups of about ``CELL_BYTES`` and each pair of groups meets in one cell, a partition of its own: a
    block is shuffled once per group of the other side, not once per pair.  A cell holds its right group; left blocks
    stream past it, and bounds are taken there.
    """
    spark = left.sparkSession
    ship_package(spark)

    def dealt(df, p, least):
        n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col(p + "n") * F.size(p + "centre")), F.lit(0)) * 8).first()
        groups = max(1, min(n, max(-(-size // CELL_BYTES), least)))
        return groups, df.drop(p + "n").withColumn(p + "group", F.pmod(F.xxhash64(p + "block"), F.lit(groups)))
    nr, r = dealt(right, "r_", 1)
    nl, l = dealt(left, "l_", -(-PER_CORE * spark.sparkContext.defaultParallelism // nr))
    l = l.withColumn("r_group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nr - 1).cast("long"))))
    r = r.withColumn("l_group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nl - 1).cast("long"))))
    cell = (F.col("l_group") * nr + F.col("r_group")).cast("int").alias("_cell")
    lkept, rkept = [c for c in left.columns if c != "l_n"], [c for c in right.columns if c != "r_n"]
    both = r.select(cell, F.lit(0).alias("_side"), *rkept).unionByName(l.select(cell, F.lit(1).alias("_side"), *lkept), allowMissingColumns=True)

    def run(batches):
        at, held, centres, radii, out, size = None, [], None, None, [], 0
        for pdf in batches:
            for row in pdf.to_dict("records"):
                if row["_cell"] != at:
                    at, held, centres = row["_cell"], [], None
                if row["_side"] == 0:
                    ids = {c: np.asarray(row["r_" + c]) for c in rcols}
                    held.append((row["r_centre"], row["r_radius"], _unit(row["r_vec"], len(ids[rcols[0]])), ids))
                    continue
                if not held:
                    continue
                if centres is None:
                    centres, radii = np.array([h[0] for h in held]), np.array([h[1] for h in held])
                ids = {c: np.asarray(row["l_" + c]) for c in lcols}
                m = _unit(row["l_vec"], len(ids[lcols[0]]))
                bound = _pair_bounds(np.asarray(row["l_centre"])[None, :], np.array([row["l_radius"]]), centres, radii)[0]
                for k in np.flatnonzero(bound >= bar):
                    got = pd.DataFrame(reduce(m @ held[k][2].T, ids, held[k][3]))
                    if len(got):
                        out.append(got)
                        size += len(got)
                    if size >= HELD:
                        yield pd.concat(out, ignore_index=True).drop_duplicates()
                        out, size = [], 0
                if out:
                    yield pd.concat(out, ignore_index=True).drop_duplicates()
                    out, size = [], 0

    return both.repartitionById(nl * nr, "_cell").sortWithinPartitions("_cell", "_side").mapInPandas(run, schema).distinct()


def mean_vector(df: DataFrame, keys: Sequence[str], unit: bool = False) -> DataFrame:
    """Element-wise mean per key (optionally of unit vectors), partially aggregated per position."""
    vec = F.col("vec")
    if unit:
        norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))
        df = df.withColumn("_n", norm)
        vec = F.transform(vec, lambda x: x / F.col("_n"))
    cells = df.select(*keys, F.posexplode(vec).alias("_p", "_x")).groupBy(*keys, "_p").agg(F.avg("_x").alias("_m"))
    got = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_p", "_m"))).alias("_a"))
    return got.select(*keys, F.transform("_a", lambda e: e["_m"]).alias("vec"))
