"""Skew-safe building blocks the other operators compose.

A recording may hold a third of all rows, so no kernel here orders a whole recording
inside one task.  Each works on (keys, bucket) cells where a bucket is a bounded span of
the ordering column, and carries a one-row-per-bucket summary across bucket borders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def shuffled(df: DataFrame) -> DataFrame:
    """One side of a join whose both sides grow with the tables: met by shuffle and sort, never broadcast.

    Spark guesses a side's size from its compressed files, before rows are exploded, so that a side of
    millions of rows may be taken for a small one and pass whole through the driver.
    """
    return df.hint("merge")


def bucket_of(pos: Column, width: int) -> Column:
    """Floor bucket of an integer position (exact for negatives)."""
    return ((pos - F.pmod(pos, F.lit(width))) / F.lit(width)).cast("long")


def with_halo(df: DataFrame, pos: str, width: int, before: int, after: int) -> DataFrame:
    """Copy each row into every bucket that can see it.

    A home row at p looks at positions [p-before, p+after].  Adds ``bucket`` and
    ``is_home``; a row has exactly one home copy, and guest copies only when it lies
    within reach of a border, so the growth is (before+after)/width.
    """
    p = F.col(pos)
    lo, hi = bucket_of(p - F.lit(after), width), bucket_of(p + F.lit(before), width)
    return df.withColumn("bucket", F.explode(F.sequence(lo, hi))).withColumn(
        "is_home", F.col("bucket") == bucket_of(p, width)
    )


def halo_window(df: DataFrame, keys: Sequence[str], pos: str, width: int, before: int, after: int,
                columns: dict[str, Column] | None = None, *, frame: str = "range",
                order: Sequence[str] = (), build=None) -> DataFrame:
    """Evaluate window columns whose frame reaches at most before/after positions.

    ``build(window)`` returns {name: Column} for a window already partitioned by
    (keys, bucket) and ordered by the position (then ``order``).
    """
    wide = with_halo(df, pos, width, before, after)
    w = W.partitionBy(*keys, "bucket").orderBy(pos, *order)
    cols = build(w)
    return wide.select("*", *[c.alias(n) for n, c in cols.items()]).filter("is_home").drop("bucket", "is_home")


def ordered_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], pos: str, width: int,
                  name: str = "idx") -> DataFrame:
    """Dense 0-based index in (pos, order) per key: local rank plus a per-bucket offset."""
    b = df.withColumn("_b", bucket_of(F.col(pos), width))
    sizes = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = W.partitionBy(*keys, "_b").orderBy(pos, *order)
    return (
        b.join(offsets, [*keys, "_b"])
        .withColumn(name, F.row_number().over(local).cast("long") - 1 + F.col("_off"))
        .drop("_b", "_off")
    )


def gap_islands(df: DataFrame, keys: Sequence[str], pos: str, gap: int, width: int,
                order: Sequence[str] = (), name: str = "island") -> DataFrame:
    """Island id = position of the row that opened the island (a step > ``gap``).

    Two passes: the last position of the previous non-empty bucket decides the first row
    of a bucket; the last opener of earlier buckets is the carry for rows before the
    first opener of theirs.  Adds ``name`` and boolean ``opens``.
    """
    b = df.withColumn("_b", bucket_of(F.col(pos), width))
    over_buckets = W.partitionBy(*keys).orderBy("_b")
    edges = b.groupBy(*keys, "_b").agg(F.max(pos).alias("_last"))
    edges = edges.select(*keys, "_b", F.lag("_last").over(over_buckets).alias("_prev_last"))
    local = W.partitionBy(*keys, "_b").orderBy(pos, *order)
    prev = F.coalesce(F.lag(pos).over(local), F.col("_prev_last"))
    flagged = b.join(edges, [*keys, "_b"]).withColumn("_prev", prev).withColumn(
        "opens", F.col("_prev").isNull() | (F.col(pos) - F.col("_prev") > gap)
    )
    openers = flagged.groupBy(*keys, "_b").agg(F.max(F.when(F.col("opens"), F.col(pos))).alias("_open"))
    carry = openers.select(
        *keys, "_b",
        F.last("_open", ignorenulls=True).over(over_buckets.rowsBetween(W.unboundedPreceding, -1)).alias("_carry"),
    )
    running = F.last(F.when(F.col("opens"), F.col(pos)), ignorenulls=True).over(
        local.rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        flagged.join(carry, [*keys, "_b"])
        .withColumn(name, F.coalesce(running, F.col("_carry")))
        .drop("_b", "_prev_last", "_prev", "_carry")
    )


def bounded_lag(df: DataFrame, keys: Sequence[str], idx: str, cols: Sequence[str], steps: int = 1,
                width: int = 4096, prefix: str = "prev_") -> DataFrame:
    """lag() over a dense index without ordering a whole key in one task."""
    def build(w):
        return {f"{prefix}{c}": F.lag(c, steps).over(w) for c in cols}
    return halo_window(df, keys, idx, width, max(steps, 0), max(-steps, 0), build=build)


def value_cell(v: Column, per_octave: int = 128) -> Column:
    """Monotone, data-independent cell of a double: a signed fraction of an octave."""
    size = F.floor(F.log2(F.abs(F.nullif(v, F.lit(0.0)))) * per_octave) + 200_000
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v).cast("long") * size)


def exact_ranks(df: DataFrame, keys: Sequence[str], col: str, ranks: dict) -> DataFrame:
    """Order statistics for groups of any size: {name: rank(n) -> 0-based Column}.

    Nulls count nothing (no filter is placed on the value: a pushed-down predicate would
    inline a computed column many times over).  Values are folded to (value, count) before
    any shuffle of raw rows; running counts over the few cells of a key locate the cells
    that hold the wanted ranks, and only those cells are ordered inside.
    Returns keys, n, min, max and one column per rank.
    """
    counted = (
        df.select(*keys, F.col(col).cast("double").alias("_v"))
        .groupBy(*keys, "_v").agg(F.count("_v").alias("_c"))
        .withColumn("_cell", F.coalesce(value_cell(F.col("_v")), F.lit(-9_000_000_000)))
    )
    part = W.partitionBy(*keys)
    cells = counted.groupBy(*keys, "_cell").agg(F.sum("_c").alias("_cn"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))
    upto = part.orderBy("_cell").rowsBetween(W.unboundedPreceding, W.currentRow)
    cells = cells.select(
        *keys, "_cell", F.sum("_cn").over(upto).alias("_end"), (F.sum("_cn").over(upto) - F.col("_cn")).alias("_off"),
        F.sum("_cn").over(part).alias("n"), F.min("_mn").over(part).alias("min"), F.max("_mx").over(part).alias("max"))
    wanted = {n: r(F.col("n")) for n, r in ranks.items()}
    hit = F.lit(False)
    for r in wanted.values():
        hit = hit | ((r < F.col("_end")) & (r >= F.col("_off")))
    inside = W.partitionBy(*keys, "_cell").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = counted.join(shuffled(cells.filter(hit)), [*keys, "_cell"]).withColumn(
        "_hi", F.col("_off") + F.sum("_c").over(inside)).withColumn("_lo", F.col("_hi") - F.col("_c"))
    return ranked.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("min").alias("min"), F.max("max").alias("max"),
        *[F.max(F.when((r >= F.col("_lo")) & (r < F.col("_hi")), F.col("_v"))).alias(n) for n, r in wanted.items()])


def exact_quantiles(df: DataFrame, keys: Sequence[str], col: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles (position q*(n-1)) for groups of any size."""
    ranks = {}
    for name, q in probs.items():
        ranks[f"_{name}_a"] = lambda n, q=q: F.floor(F.lit(q) * (n - 1))
        ranks[f"_{name}_b"] = lambda n, q=q: F.ceil(F.lit(q) * (n - 1))
    out = exact_ranks(df, keys, col, ranks)
    frac = {n: F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1)) for n, q in probs.items()}
    return out.select(*keys, "n", "min", "max", *[
        (F.col(f"_{n}_a") + (F.col(f"_{n}_b") - F.col(f"_{n}_a")) * frac[n]).alias(n) for n in probs])


def in_intervals(df: DataFrame, intervals: DataFrame, keys: Sequence[str], pos: str, start: str, end: str,
                 width: int) -> DataFrame:
    """Rows inside one of the disjoint intervals of their key (inclusive), with the interval."""
    iv = intervals.withColumn("_b", F.explode(F.sequence(bucket_of(F.col(start), width), bucket_of(F.col(end), width))))
    rows = df.withColumn("_b", bucket_of(F.col(pos), width))
    return rows.join(iv, [*keys, "_b"]).filter((F.col(pos) >= F.col(start)) & (F.col(pos) <= F.col(end))).drop("_b")


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, width: int) -> DataFrame:
    """Disjoint union of intervals per key; touching intervals merge.

    Local pass per bucket of the start first, then one pass over the survivors, which
    are at most one interval per disjoint stretch per bucket.
    """
    def sweep(d: DataFrame, part: list[str]) -> DataFrame:
        w = W.partitionBy(*part).orderBy(start, end)
        reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
        opened = d.withColumn("_new", (reach.isNull() | (F.col(start) > reach)).cast("int"))
        marked = opened.withColumn("_run", F.sum("_new").over(w))
        return marked.groupBy(*part, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")
    local = sweep(df.select(*keys, start, end).withColumn("_b", F.floor(F.col(start) / width)), [*keys, "_b"])
    return sweep(local.drop("_b"), list(keys))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, salt: Column, salts: int = 32, name: str = "rank") -> DataFrame:
    """First k rows per key; a salted local cut first, so a hot key never sorts in one task."""
    s = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
    first = W.partitionBy(*keys, "_salt").orderBy(*order)
    cut = s.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k).drop("_salt", "_r")
    return cut.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)


def strongest_first(pairs: DataFrame, group: Sequence[str], rounds: int = 3) -> DataFrame:
    """``weak``: the rows that go when rows are taken strongest first and a row goes if a stronger one that stays excludes it.

    pairs: ``group`` columns, ``weak``, ``strong`` (ids of two rows that exclude each other) and ``order``, the
    weak row's place among its group, stronger first.  In a round every row without a live stronger
    neighbour stays and its neighbours go, by joins alone; a few rounds settle all but chains of steadily
    falling strength.  What is left of those is walked once in order, with the ids that went as state.
    """
    import pandas as pd

    from ..session import cut_lineage

    live, gone = cut_lineage(pairs.select(*group, "weak", "strong", "order")), pairs.select("weak").limit(0)
    for _ in range(rounds):
        stays = live.select("strong").distinct().join(live.select(F.col("weak").alias("strong")).distinct(), "strong", "left_anti")
        out = cut_lineage(live.join(stays, "strong").select("weak").distinct())
        gone = gone.unionByName(out)
        live = cut_lineage(live.join(out, "weak", "left_anti").join(out.select(F.col("weak").alias("strong")), "strong", "left_anti"))
        if live.isEmpty():
            return gone

    def step(state, pdf):
        out, went = [], state["gone"]
        for weak, strong in zip(pdf["weak"], pdf["strong"]):
            if weak not in went and strong not in went:
                went.add(weak)
                out.append(weak)
        return pd.DataFrame({"weak": out})

    kind = live.schema["weak"].dataType.simpleString()
    fields = [f"order.{f.name}" for f in live.schema["order"].dataType]
    walked = live.select(*group, "weak", "strong", *[F.col(f).alias(f"_o{i}") for i, f in enumerate(fields)])
    return gone.unionByName(stream_fold(walked, group, [*(f"_o{i}" for i in range(len(fields))), "weak"], lambda: {"gone": set()}, step, f"weak {kind}"))


def dominant_pairs(pairs: DataFrame, group: Sequence[str], left: str, right: str, order: Sequence, rounds: int = 2, passes: int = 2) -> DataFrame:
    """One-to-one pairs: all pairs of a group walked by (``order``, left, right), a pair with a used end skipped.

    A pair that comes first at both of its ends is won whatever the rest of the group holds, and every other pair
    at these ends is lost.  A round wins and drops such pairs by windows over one end, so no group is gathered
    and rows are dealt by end, not by group.  A pass is ``rounds`` rounds in one plan over the pairs the last pass left
    open; only chains of steadily later pairs outlast the passes, and what is left of those is walked once in order,
    with the used ends as state.  Equal pairs count once; all columns of ``pairs`` are kept.  Ends that are null are
    ends like any other.
    """
    from ..session import cut_lineage

    at_left, at_right = W.partitionBy(*group, left), W.partitionBy(*group, right)
    steps = [c.alias(f"_o{i}") for i, c in enumerate([*order, F.col(left), F.col(right)])]
    once = F.row_number().over(at_left.orderBy("_k"))
    won, rest = None, pairs.withColumn("_k", F.struct(*steps))
    for _ in range(passes):
        for _ in range(rounds):
            rest = rest.withColumn("_l", F.min("_k").over(at_left)).withColumn("_r", F.min("_k").over(at_right))
            rest = rest.withColumn("_won", (F.col("_k") == F.col("_l")) & (F.col("_k") == F.col("_r")))
            for end in (at_right, at_left):
                rest = rest.withColumn("_taken", F.max("_won").over(end)).filter("_won or not _taken")
        settled = cut_lineage(rest.withColumn("_n", once).filter("not _won or _n = 1").drop("_l", "_r", "_taken", "_n"))
        new, rest = settled.filter("_won").drop("_won", "_k"), settled.filter("not _won").drop("_won")
        won = new if won is None else won.unionByName(new)
        if rest.isEmpty():
            return won
    columns = won.columns

    def step(state, pdf):
        free = []
        for a, b in zip(pdf[left], pdf[right]):
            free.append(a not in state["left"] and b not in state["right"])
            if free[-1]:
                state["left"].add(a)
                state["right"].add(b)
        return pdf.loc[free, columns]

    names = [f"_o{i}" for i in range(len(steps))]
    walked = rest.select(*won.columns, *[F.col(f"_k.{n}").alias(n) for n in names])
    return won.unionByName(stream_fold(walked, group, names, lambda: {"left": set(), "right": set()}, step, won.schema))


def stream_fold(df: DataFrame, keys: Sequence[str], order: Sequence, make_state, step, schema, finish=None) -> DataFrame:
    """Sequential rule over sorted rows of each key with bounded state.

    Rows are hash-placed by key and sorted inside the partition (the sort spills), then
    flow through ``mapInPandas`` batch by batch: a key is never collected, only ``state``
    lives in memory.  ``step(state, pdf) -> pdf`` sees rows of one key, in order;
    ``finish(state) -> pdf`` gives what is still held when a key ends.
    """
    import pandas as pd

    from ..session import ship_package

    ship_package(df.sparkSession)
    names = list(keys)

    def run(batches):
        current, state = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            changed = (pdf[names] != pdf[names].shift()).any(axis=1).to_numpy()
            changed[0] = True
            starts = [i for i, c in enumerate(changed) if c] + [len(pdf)]
            parts = []
            for a, b in zip(starts, starts[1:]):
                chunk = pdf.iloc[a:b]
                key = tuple(chunk.iloc[0][names])
                if key != current:
                    if finish and state is not None:
                        parts.append(finish(state))
                    current, state = key, make_state()
                parts.append(step(state, chunk))
            parts = [p for p in parts if len(p)]
            if parts:
                yield parts[0] if len(parts) == 1 else pd.concat([p.astype(object) for p in parts], ignore_index=True)
        if finish and state is not None:
            rest = finish(state)
            if len(rest):
                yield rest

    return df.repartition(*names).sortWithinPartitions(*names, *order).mapInPandas(run, schema)
