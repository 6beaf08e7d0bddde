"""Temporal and spatial joins: as-of, range, nearest, radius and one-to-one matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kernels import HOUR_US, bucket_of, dominant_pairs, halo_window, shuffled


def asof_first(left: DataFrame, right: DataFrame, keys: Sequence[str], pos: str, tol: int, order: str,
               payload: Sequence[str], width: int = 24 * HOUR_US) -> DataFrame:
    """Each left row with the first right row (in ``order``) whose position is within tol.

    One range window over the union of both sides: no candidate pair is ever emitted, and
    the window lives in (keys, time bucket) cells.  Left rows without a match are absent.
    """
    fields = F.struct(F.col(order).alias("_ord"), *[F.col(c).alias(c) for c in payload if c != order], F.col(order).alias(order))
    kind = fields_type(right.select(fields.alias("s")))
    l = left.withColumn("_left", F.lit(True)).withColumn("_r", F.lit(None).cast(kind))
    r = right.select(*keys, pos, fields.alias("_r")).withColumn("_left", F.lit(False))
    both = l.unionByName(r, allowMissingColumns=True)
    hits = halo_window(both, keys, pos, width, tol, tol,
                       build=lambda w: {"match": F.min("_r").over(w.rangeBetween(-tol, tol))})
    return hits.filter("_left and match is not null").drop("_left", "_r")


def fields_type(df: DataFrame) -> str:
    return df.schema[0].dataType.simpleString()


def nearest_time(left: DataFrame, right: DataFrame, keys: Sequence[str], pos: str, payload: Sequence[str],
                 width: int = 24 * HOUR_US) -> DataFrame:
    """Nearest right row in time at any distance; the earlier one on a tie.

    The last key before and the first key after come from ordered cells; a one-row-per-cell
    summary carries both across empty or distant cells.
    """
    item = F.struct(F.col(pos).alias("at"), *payload)
    kind = fields_type(right.select(item.alias("s")))
    l = left.withColumn("_left", F.lit(True)).withColumn("_r", F.lit(None).cast(kind))
    r = right.select(*keys, pos, item.alias("_r")).withColumn("_left", F.lit(False))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_b", bucket_of(F.col(pos), width))
    cells = both.groupBy(*keys, "_b").agg(F.min("_r").alias("_lo"), F.max("_r").alias("_hi"))
    w = W.partitionBy(*keys).orderBy("_b")
    carry = cells.select(
        *keys, "_b", F.last("_hi", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("_cp"),
        F.first("_lo", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing)).alias("_cn"))
    local = W.partitionBy(*keys, "_b").orderBy(pos)
    seen = both.join(shuffled(carry), [*keys, "_b"]).withColumn(
        "_p", F.coalesce(F.max("_r").over(local.rangeBetween(W.unboundedPreceding, 0)), F.col("_cp"))).withColumn(
        "_n", F.coalesce(F.min("_r").over(local.rangeBetween(0, W.unboundedFollowing)), F.col("_cn")))
    back, ahead = F.col(pos) - F.col("_p.at"), F.col("_n.at") - F.col(pos)
    pick = F.when(F.col("_n").isNull() | (back <= ahead), F.col("_p")).otherwise(F.col("_n"))
    return seen.filter("_left").withColumn("nearest", pick).drop("_left", "_r", "_b", "_cp", "_cn", "_p", "_n")


def range_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], lpos: str, rpos: str,
                lo: int, hi: int, width: int) -> DataFrame:
    """All pairs with lo <= left - right <= hi, as an equi-join on (keys, bucket)."""
    l = left.withColumn("_b", bucket_of(F.col(lpos), width))
    first, last = bucket_of(F.col(rpos) + lo, width), bucket_of(F.col(rpos) + hi, width)
    r = right.withColumn("_b", F.explode(F.sequence(first, last)))
    gap = F.col(lpos) - F.col(rpos)
    # dealt into a stated number of parts: sized by the sides alone, the parts would be merged and hold all pairs in a few tasks
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    l, r = (side.repartition(n, *keys, "_b") for side in (l, r))
    return l.join(shuffled(r), [*keys, "_b"]).filter((gap >= lo) & (gap <= hi)).drop("_b")


def near_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], radius: int,
               lxy: tuple[str, str], rxy: tuple[str, str]) -> DataFrame:
    """Pairs within ``radius`` by grid cell; adds ``d2``, the squared distance."""
    def cell(c):
        return F.floor(F.col(c) / radius)
    l = left.withColumn("_cx", cell(lxy[0])).withColumn("_cy", cell(lxy[1]))
    ring = F.array(*[F.lit(v) for v in (-1, 0, 1)])
    r = right.withColumn("_ox", F.explode(ring)).withColumn("_oy", F.explode(ring)).withColumn(
        "_cx", cell(rxy[0]) + F.col("_ox")).withColumn("_cy", cell(rxy[1]) + F.col("_oy")).drop("_ox", "_oy")
    dx, dy = F.col(lxy[0]) - F.col(rxy[0]), F.col(lxy[1]) - F.col(rxy[1])
    return (l.join(shuffled(r), [*keys, "_cx", "_cy"]).withColumn("d2", dx * dx + dy * dy)
            .filter(F.col("d2") <= radius * radius).drop("_cx", "_cy"))


def greedy_nearest(pairs: DataFrame, group: Sequence[str], order: Column, left: str, right: str,
                   cost: str) -> DataFrame:
    """Greedy one-to-one: all pairs of a group by (cost, left, right), those with a used end skipped."""
    return dominant_pairs(pairs.select(*group, left, right, cost), group, left, right, [F.col(cost)])


def match_frames(prev: DataFrame, cur: DataFrame, radius: int, keys: Sequence[str] = ("dataset", "frame_no", "color")) -> DataFrame:
    """Two-stage matching of one frame against the previous one.

    Stage 1: greedy nearest of the same colour within the radius.  Stage 2: a leftover of a
    colour that occurs exactly once on both sides matches at any distance.
    Inputs: keys, id, x, y; ``prev`` already carries the frame number of ``cur``.
    Output: keys, prev_id, cur_id, d2, stage (unmatched rows have the other id null).
    """
    p = prev.select(*keys, F.col("id").alias("prev_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    c = cur.select(*keys, F.col("id").alias("cur_id"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    near = near_pairs(c, p, keys, radius, ("cx", "cy"), ("px", "py"))
    first = greedy_nearest(near, keys, None, "prev_id", "cur_id", "d2").withColumn("stage", F.lit(1))
    one_p = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("np"), F.min("prev_id").alias("prev_id"), F.min("px").alias("px"), F.min("py").alias("py")).filter("np = 1")
    one_c = c.groupBy(*keys).agg(F.count(F.lit(1)).alias("nc"), F.min("cur_id").alias("cur_id"), F.min("cx").alias("cx"), F.min("cy").alias("cy")).filter("nc = 1")
    dx, dy = F.col("cx") - F.col("px"), F.col("cy") - F.col("py")
    second = one_p.join(shuffled(one_c), list(keys)).withColumn("d2", dx * dx + dy * dy).filter(F.col("d2") > radius * radius).select(
        *keys, "prev_id", "cur_id", "d2").withColumn("stage", F.lit(2))
    matched = first.unionByName(second)
    before = p.select(*keys, "prev_id").join(shuffled(matched.drop(*keys)), "prev_id", "left")
    fresh = c.join(shuffled(matched.select("cur_id")), "cur_id", "left_anti").select(*keys, "cur_id")
    return before.unionByName(fresh, allowMissingColumns=True)


def match_truth(pred: DataFrame, truth: DataFrame, tol: int, keys: Sequence[str] = ("dataset", "frame_no")) -> DataFrame:
    """Predictions in (score desc, id) order each take the nearest unused truth within tol.

    Output: keys, pred_id, truth_id, d2.  A nearest unused truth beyond the tolerance is
    never consumed, so truths beyond it cannot influence the walk and need no pairing.
    """
    p = pred.select(*keys, F.col("id").alias("pred_id"), "score", F.col("x").alias("px"), F.col("y").alias("py"))
    t = truth.select(*keys, F.col("id").alias("truth_id"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    near = near_pairs(p, t, keys, tol, ("px", "py"), ("tx", "ty"))
    best = dominant_pairs(near, keys, "pred_id", "truth_id", [-F.col("score"), F.col("pred_id"), F.col("d2")])
    return best.select(*keys, "pred_id", "truth_id", "d2")


def mutual_nearest(prev: DataFrame, cur: DataFrame, keys: Sequence[str], max_px: int, min_px: int) -> DataFrame:
    """Pairs where each side is the other's nearest of the same colour, min..max px apart."""
    p = prev.select(*keys, F.col("id").alias("prev_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    c = cur.select(*keys, F.col("id").alias("cur_id"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    near = near_pairs(c, p, keys, max_px, ("cx", "cy"), ("px", "py"))
    best_p = near.groupBy(*keys, "prev_id").agg(F.min(F.struct("d2", "cur_id")).alias("b")).select(
        *keys, "prev_id", F.col("b.cur_id").alias("cur_id"), F.col("b.d2").alias("d2"))
    best_c = near.groupBy(*keys, "cur_id").agg(F.min(F.struct("d2", "prev_id")).alias("b")).select(
        *keys, "cur_id", F.col("b.prev_id").alias("prev_id"))
    return best_p.join(shuffled(best_c), [*keys, "prev_id", "cur_id"]).filter(F.col("d2") >= min_px * min_px)


def previous_links(df: DataFrame, radius: int = 60, keys: Sequence[str] = ("dataset", "color")) -> DataFrame:
    """Nearest same-colour ball of the previous frame within the radius: (id, prev_id)."""
    cur = df.select(*keys, "frame_no", F.col("id").alias("cur_id"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    prev = df.select(*keys, (F.col("frame_no") + 1).alias("frame_no"), F.col("id").alias("prev_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    near = near_pairs(cur, prev, [*keys, "frame_no"], radius, ("cx", "cy"), ("px", "py"))
    return near.groupBy("cur_id").agg(F.min(F.struct("d2", "prev_id")).alias("b")).select(
        F.col("cur_id").alias("id"), F.col("b.prev_id").alias("prev_id"))


def streak_at_least(df: DataFrame, links: DataFrame, depth: int, name: str = "streak") -> DataFrame:
    """Streak length capped at ``depth`` (the rules test only >= 2 and >= 3): depth-1 lookups."""
    hop = links
    out = df.join(shuffled(links), "id", "left").withColumn(name, F.when(F.col("prev_id").isNull(), 1).otherwise(2)).drop("prev_id")
    for k in range(3, depth + 1):
        nxt = links.select(F.col("id").alias("prev_id"), F.col("prev_id").alias("_pp"))
        hop = hop.join(shuffled(nxt), "prev_id").select("id", F.col("_pp").alias("prev_id"))
        mark = hop.select("id").withColumn("_k", F.lit(k))
        out = out.join(shuffled(mark), "id", "left").withColumn(name, F.greatest(name, F.coalesce("_k", F.lit(1)))).drop("_k")
    return out


def streak_length(df: DataFrame, links: DataFrame, name: str = "streak", rounds: int = 62) -> DataFrame:
    """Exact streak length by pointer doubling: ceil(log2(longest)) rounds, lineage cut per round."""
    from ..session import cut_lineage
    cur = df.select("id").join(shuffled(links), "id", "left").select(
        "id", F.col("prev_id").alias("up"), F.when(F.col("prev_id").isNull(), 1).otherwise(2).alias("len"))
    cur = cut_lineage(cur)
    for _ in range(rounds):
        if cur.filter("up is not null").isEmpty():
            break
        far = cur.select(F.col("id").alias("up"), F.col("up").alias("_u"), F.col("len").alias("_l"))
        cur = cut_lineage(cur.join(shuffled(far), "up", "left").select(
            "id", F.col("_u").alias("up"), (F.col("len") + F.coalesce(F.col("_l"), F.lit(1)) - 1).alias("len")))
    else:
        raise ValueError("the links do not end: a row cannot follow itself")
    return df.join(shuffled(cur.select("id", F.col("len").alias(name))), "id")


def vanished(prev: DataFrame, cur: DataFrame, radius: int, keys: Sequence[str]) -> DataFrame:
    """Balls of the previous frame with no same-colour ball within the radius now."""
    p = prev.select(*keys, "id", F.col("x").alias("px"), F.col("y").alias("py"))
    c = cur.select(*keys, F.col("x").alias("cx"), F.col("y").alias("cy"))
    seen = near_pairs(c, p, keys, radius, ("cx", "cy"), ("px", "py")).select("id").distinct()
    return p.join(shuffled(seen), "id", "left_anti")


def persistence_filter(peaks: DataFrame, frames: DataFrame, radius: int, neighbours: int = 2,
                       min_support: float = 0.6, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Support = share of the existing frames within +-neighbours that hold a peak nearby."""
    steps = F.array(*[F.lit(s) for s in range(-neighbours, neighbours + 1) if s])
    asks = peaks.select(*keys, "frame_no", "id", "x", "y").withColumn("_s", F.explode(steps)).withColumn(
        "other", F.col("frame_no") + F.col("_s"))
    known = frames.select(*keys, F.col("frame_no").alias("other")).distinct()
    asks = asks.join(shuffled(known), [*keys, "other"])
    others = peaks.select(*keys, F.col("frame_no").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    hits = near_pairs(asks, others, [*keys, "other"], radius, ("x", "y"), ("ox", "oy")).select("id", "other").distinct()
    counted = asks.groupBy("id").agg(F.count(F.lit(1)).alias("checks")).join(
        shuffled(hits.groupBy("id").agg(F.count(F.lit(1)).alias("hits"))), "id", "left")
    out = peaks.join(shuffled(counted), "id", "left")
    support = F.when(F.col("checks") > 0, F.coalesce("hits", F.lit(0)) / F.col("checks")).otherwise(0.0)
    return out.withColumn("support", support).withColumn("kept", F.col("support") >= min_support).drop("checks", "hits")


def double_claims(obs: DataFrame, radius: int = 12, keys: Sequence[str] = ("dataset", "frame_no")) -> DataFrame:
    """Two identities within the radius in one frame."""
    a = obs.select(*keys, F.col("track_id").alias("tid_a"), F.col("id").alias("id_a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = obs.select(*keys, F.col("track_id").alias("tid_b"), F.col("id").alias("id_b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return near_pairs(a, b, keys, radius, ("ax", "ay"), ("bx", "by")).filter("tid_a <> tid_b and id_a < id_b")
