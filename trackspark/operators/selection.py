"""Selection: unions by precedence, budgets, work lists, stable ids, plans and backlogs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage


def union_sets(sets: Sequence[tuple[str, DataFrame]], keys: Sequence[str]) -> DataFrame:
    """Distinct keys over all sets; ``source`` names the first set that holds the key."""
    parts = [d.select(*keys).withColumn("_p", F.struct(F.lit(i).alias("i"), F.lit(n).alias("n"))) for i, (n, d) in enumerate(sets)]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.min("_p").alias("_p")).select(*keys, F.col("_p.n").alias("source"))


def timeline(nights: DataFrame, recordings: DataFrame) -> DataFrame:
    """Events and recordings, newest first, undated last, id as the tie-break; hidden events left out."""
    both = nights.filter("not hidden").select("night", F.lit("night").alias("kind"), "at_us").unionByName(recordings.select("night", F.lit("recording").alias("kind"), "at_us"))
    return both.orderBy(F.desc_nulls_last("at_us"), F.desc("night"))


def play_queue(matches: DataFrame, order: Sequence[str]) -> DataFrame:
    """Scheduled before delayed, then by round."""
    w = W.partitionBy("night").orderBy(F.col("status") == "delayed", "round", *order)
    return matches.filter("status in ('scheduled', 'delayed')").withColumn("place", F.row_number().over(w).cast("long"))


def plan_frames(cands: DataFrame, cached: DataFrame, offsets: dict[str, Sequence[float]], top: dict[str, int], key: str = "dataset") -> DataFrame:
    """Bracketing frames of the strongest candidates, one per 0.1 s, flagged when already bought.

    The strongest plan entry that asks for a frame owns it.
    """
    from .kernels import top_k
    best = None
    for kind, n in top.items():
        k = top_k(cands.filter(F.col("kind") == kind), [key], [F.desc("strength"), "t", "event_id"], n, F.col("event_id"))
        k = k.withColumn("_o", F.explode(F.array(*[F.lit(float(o)) for o in offsets[kind]])))
        best = k if best is None else best.unionByName(k)
    f = best.withColumn("at", F.col("t") + F.col("_o")).filter("at >= 0").withColumn("tick", F.rint(F.col("at") * 10).cast("long"))
    owner = f.groupBy(key, "tick").agg(F.min(F.struct((-F.col("strength")).alias("k"), "t", "event_id", "_o")).alias("b"))
    have = cached.select(key, "tick").distinct().withColumn("_c", F.lit(True))
    return owner.join(have, [key, "tick"], "left").select(key, "tick", F.col("b.event_id").alias("event_id"), F.coalesce("_c", F.lit(False)).alias("cached"))


def select_for_gating(kept: DataFrame, planned: DataFrame, served: DataFrame, controls: int = 20, first_id: int = 1001) -> DataFrame:
    """Planned candidates, the next strongest controls, then served events not already in; new ids from ``first_id``."""
    p = planned.select("event_id").distinct()
    sel = kept.join(p, "event_id", "left_semi").withColumn("measured", F.lit("planned"))
    spare = kept.join(p, "event_id", "left_anti").orderBy(F.desc("strength"), "t", "event_id").limit(controls).withColumn("measured", F.lit("control"))
    both = sel.unionByName(spare)
    extra = served.join(both.select("event_id"), "event_id", "left_anti").withColumn("measured", F.lit("served"))
    out = both.unionByName(extra, allowMissingColumns=True).withColumn("_g", F.when(F.col("measured") == "planned", 0).when(F.col("measured") == "control", 1).otherwise(2))
    return assign_order(out, "_g", "strength", ["t", "event_id"], first_id).drop("_g")


def assign_order(df: DataFrame, group: str, strength: str, ties: Sequence[str], first_id: int) -> DataFrame:
    """Ids by position (group, strongest first without strength last, ties) for the rows without one.

    A row's position is its rank inside a cell of like strength, plus the rows of stronger cells of its group,
    plus the rows of earlier groups; only counts per cell are ordered together, never the rows.
    """
    from .kernels import value_cell

    cell = F.coalesce(value_cell(-F.col(strength)), F.lit(9_000_000_000))
    rows = df.withColumn("_cell", cell)
    counts = rows.groupBy(group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    earlier = counts.groupBy(group).agg(F.sum("_n").alias("_n")).agg(F.map_from_entries(F.collect_list(F.struct(group, "_n"))).alias("_all"))  # one entry a group
    upto = W.partitionBy(group).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    before = F.aggregate(F.map_entries(F.map_filter("_all", lambda g, _: g < F.col(group))), F.lit(0).cast("long"), lambda total, e: total + e["value"])
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(upto), F.lit(0))).crossJoin(earlier).select(group, "_cell", (F.col("_off") + before).alias("_off"))
    local = W.partitionBy(group, "_cell").orderBy(F.desc(strength), *ties)
    return rows.join(offsets, [group, "_cell"]).withColumn("id", F.coalesce(F.col("id"), F.col("_off") + F.row_number().over(local) - 1 + first_id).cast("long")).drop("_cell", "_off")



def pending(requested: DataFrame, cached: DataFrame, refetch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requested minus cached, plus what is asked for again."""
    new = requested.select(*keys).distinct().join(cached.select(*keys), list(keys), "left_anti")
    again = requested.select(*keys).distinct().join(refetch.select(*keys), list(keys), "left_semi")
    return new.unionByName(again).distinct()


def persistent_tracks(obs: DataFrame, n: int, keys: Sequence[str] = ("dataset", "track_id")) -> DataFrame:
    """Tracks by the number of frames they appear in, earlier first on a tie."""
    f = obs.select(*keys, "frame_no").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"), F.min("frame_no").alias("first_frame"), F.max("frame_no").alias("last_frame"))
    return f.orderBy(F.desc("frames"), "first_frame", *keys).limit(n)


def burst_plan(spans: DataFrame, anchors: int, burst: int, spacing: int, key: str = "dataset") -> DataFrame:
    """Frame indices of n evenly spread anchors, each a burst of spaced frames, inside the recording."""
    a = spans.withColumn("anchor", F.explode(F.sequence(F.lit(0), F.lit(anchors - 1)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(burst - 1))))
    at = F.expr(f"(n_frames * anchor) div {anchors} + k * {spacing}")
    return a.withColumn("frame", at).filter("frame < n_frames").select(key, "frame").distinct()


def backlog(recent: DataFrame, index: DataFrame, queue: DataFrame, key: str, order: Sequence) -> DataFrame:
    """Recent broadcasts neither indexed nor queued, in arrival order."""
    return recent.join(index.select(key), key, "left_anti").join(queue.select(key), key, "left_anti").orderBy(*order)


def assign_ids(entries: DataFrame, previous: DataFrame, reserved: DataFrame, keys: Sequence[str], order: Sequence[str], span: int) -> tuple[DataFrame, DataFrame]:
    """Known keys keep their id, new keys continue after every id ever issued; departed rows listed."""
    from .kernels import ordered_index
    known = entries.join(previous.select(*keys, "id"), list(keys), "left")
    top = previous.select("id").unionByName(reserved.select("id")).agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    fresh = known.filter("id is null").withColumn("_all", F.lit(0))
    new = ordered_index(fresh, ["_all"], list(order[1:]), order[0], span, "_i").crossJoin(top).withColumn("id", F.col("_top") + 1 + F.col("_i")).drop("_i", "_top", "_all")
    gone = previous.join(entries.select(*keys), list(keys), "left_anti")
    return known.filter("id is not null").unionByName(new), gone


def split_blocks(times: DataFrame, second: int, key: str = "dataset", block_s: float = 30.0, every: int = 4, gap_s: float = 5.0, hole_s: float = 3.0) -> DataFrame:
    """Train / held / dropped by contiguous time blocks with a real gap between the sides.

    Block borders depend on where the block started, so they are streamed with a two-number
    state; everything after that is native on blocks.
    """
    import pandas as pd
    from .joins import range_pairs
    from .kernels import stream_fold
    hole, length, gap = int(hole_s * second), int(block_s * second), int(gap_s * second)

    def make():
        return {"first": None, "last": None, "no": -1}

    def step(state, pdf):
        out = []
        for t in pdf["us"]:
            t = int(t)
            if state["first"] is None or t - state["last"] > hole or t - state["first"] >= length:
                state["first"], state["no"] = t, state["no"] + 1
            state["last"] = t
            out.append(state["no"])
        return pd.DataFrame({key: pdf[key].to_numpy(), "event_id": pdf["event_id"].to_numpy(), "us": pdf["us"].to_numpy(), "block": out})
    rows = stream_fold(times.select(key, "event_id", "us"), [key], ["us", "event_id"], make, step, f"{key} long, event_id long, us long, block long")
    rows = cut_lineage(rows)  # the sequential pass runs once
    b = rows.groupBy(key, "block").agg(F.min("us").alias("b0"), F.max("us").alias("b1"))
    w = W.partitionBy(key).orderBy("block")
    edge = F.lag("b1").over(w).isNull() | F.lead("b0").over(w).isNull() | (F.col("b0") - F.lag("b1").over(w) < gap) | (F.lead("b0").over(w) - F.col("b1") < gap)
    b = b.withColumn("boundary", edge).withColumn("held", F.col("block") % every == every - 1)
    j = rows.join(b, [key, "block"])
    near = (F.col("us") - F.col("b0") < gap) | (F.col("b1") - F.col("us") < gap)
    j = j.withColumn("side", F.when(F.col("boundary") & near, "dropped").when(F.col("held"), "held").otherwise("train"))
    close = range_pairs(j.filter("side = 'train'").select(key, "event_id", "us"), j.filter("side = 'held'").select(key, F.col("us").alias("h_us")), [key], "us", "h_us", -gap + 1, gap - 1, 8 * length)
    bad = close.select("event_id").distinct().withColumn("_bad", F.lit(True))
    return j.join(bad, "event_id", "left").select(key, "event_id", "block", F.when(F.col("_bad"), "dropped").otherwise(F.col("side")).alias("side"))
