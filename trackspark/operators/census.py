"""Census of identities per frame, windows around claims, and census-drop candidates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalars as P
from .joins import near_pairs, range_pairs, vanished
from ..session import cut_lineage
from .kernels import bounded_lag, bucket_of, gap_islands, halo_window, ordered_index, shuffled, with_halo
from .stats import array_median, running_median

KEYS = ("dataset", "frame_no")
TRACK = ("dataset", "track_id")


def frame_spine(obs: DataFrame) -> DataFrame:
    """Every frame between the first and last of a recording, so empty frames are kept."""
    edge = obs.groupBy("dataset").agg(F.min("frame_no").alias("a"), F.max("frame_no").alias("b"))
    return edge.select("dataset", F.explode(F.sequence("a", "b")).alias("frame_no"))


def build_census(obs: DataFrame, spine: DataFrame) -> DataFrame:
    """Distinct identities per frame and source; a scored frame counts scored sightings only."""
    hits = obs.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("hits"))
    seen = obs.select(*TRACK, "frame_no", "source").distinct().join(hits, list(TRACK))
    scored = F.col("source") == "scored"
    per = seen.groupBy(*KEYS).agg(
        F.count_if(~scored).alias("plain_count"), F.count_if(scored).alias("scored_count"),
        F.count_if(scored & (F.col("hits") >= 2)).alias("_ss"), F.count_if(~scored & (F.col("hits") >= 2)).alias("_ps"),
        F.count_if(scored & (F.col("hits") == 1)).alias("_sf"), F.count_if(~scored & (F.col("hits") == 1)).alias("_pf"))
    full = spine.join(per, list(KEYS), "left").fillna(0)
    is_scored = F.col("scored_count") > 0
    return full.select(
        *KEYS, F.when(is_scored, F.col("scored_count")).otherwise(F.col("plain_count")).alias("count"), "plain_count", "scored_count",
        F.when(is_scored, F.col("_ss")).otherwise(F.col("_ps")).alias("stable_count"),
        F.when(is_scored, F.col("_sf")).otherwise(F.col("_pf")).alias("fresh_count"), is_scored.alias("scored_frame"))


def evidence_window(claims: DataFrame, frames: DataFrame, before: int, after: int, width: int, lpos: str = "frame_us", also: Sequence[str] = ()) -> DataFrame:
    """Frames in [claim-before, claim+after] with the side they bracket the claim on; ``also``: further columns of the claims."""
    c = claims.select("dataset", F.col("event_id").alias("claim_id"), F.col("us").alias("claim_us"), F.col("color").alias("claim_color"), "kind", *also)
    pairs = range_pairs(frames, c, ["dataset"], lpos, "claim_us", -before, after, width)
    return pairs.withColumn("side", F.when(F.col(lpos) <= F.col("claim_us"), "pre").otherwise("post"))


def window_summary(census_window: DataFrame, min_balls: int = 2, max_spread: int = 4) -> DataFrame:
    """Like-for-like census before and after each claim.

    Both sides scored -> scored frames, with frames under the floor dropped unless the
    whole side is low; otherwise the plain frames of either side.
    """
    entry = F.struct("frame_us", "count", "plain_count", "stable_count", "scored_frame")
    def side(name):
        return F.array_sort(F.collect_list(F.when(F.col("side") == name, entry)))
    got = census_window.groupBy("claim_id").agg(side("pre").alias("pre"), side("post").alias("post"))
    for s in ("pre", "post"):
        got = got.withColumn(f"sc_{s}", F.filter(s, lambda e: e["scored_frame"])).withColumn(f"pl_{s}", F.filter(s, lambda e: ~e["scored_frame"]))
    got = got.withColumn("scored", (F.size("sc_pre") > 0) & (F.size("sc_post") > 0)).withColumn(
        "comparable", (F.size("sc_pre") > 0) == (F.size("sc_post") > 0))
    for s in ("pre", "post"):
        low = F.array_max(F.transform(f"sc_{s}", lambda e: e["count"])) < min_balls
        got = got.withColumn(f"low_{s}", F.col("scored") & low).withColumn(
            f"use_{s}", F.when(F.col("scored"), F.filter(f"sc_{s}", lambda e: F.col(f"low_{s}") | (e["count"] >= min_balls))).otherwise(F.col(f"pl_{s}")))
        got = got.withColumn(f"dropped_{s}", F.when(F.col("scored"), F.size(f"sc_{s}") - F.size(f"use_{s}")).otherwise(0)).withColumn(
            f"n_{s}", F.array_sort(F.transform(f"use_{s}", lambda e: F.when(F.col("scored"), e["count"]).otherwise(e["plain_count"]))))
    def med(c):
        return F.when(F.size(c) > 0, array_median(F.col(c)))
    def spread(c):
        return F.array_max(c) - F.array_min(c)
    stable = ~F.col("scored") | F.coalesce(
        (F.col("dropped_pre") == 0) & (F.col("dropped_post") == 0) & (spread("n_pre") <= max_spread) & (spread("n_post") <= max_spread), F.lit(False))
    return got.select(
        "claim_id", F.when(F.col("scored"), "scored").otherwise("plain").alias("source"), "comparable",
        F.size("n_pre").alias("frames_pre"), F.size("n_post").alias("frames_post"), med("n_pre").alias("census_pre"), med("n_post").alias("census_post"),
        F.array_max("n_post").alias("census_post_max"), spread("n_pre").alias("spread_pre"), spread("n_post").alias("spread_post"),
        F.coalesce("low_pre", F.lit(False)).alias("low_pre"), F.coalesce("low_post", F.lit(False)).alias("low_post"),
        "dropped_pre", "dropped_post", stable.alias("census_stable"), (med("n_pre") - med("n_post")).alias("census_drop"))


def vanished_identities(claims: DataFrame, obs: DataFrame, reach: int, width: int, span: int) -> DataFrame:
    """Identities with >= 2 sightings in the ``reach`` before a claim and none in the ``reach`` after it.

    A claim's pair with an identity is found at one sighting only, the earliest in the claim's window, from what
    is known of that identity's sightings around it (``last_chances``).  So pairs are the answers, and neither
    pairs nor windows are shuffled.  A claim id that stands at several places pools their windows, and those
    claims alone are grouped by their sightings.
    """
    claims = claims.filter("dataset IS NOT NULL AND us IS NOT NULL")
    ids = claims.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("times"), F.min("dataset").alias("dataset"), F.min("us").alias("us"),
        ((F.min("dataset") == F.max("dataset")) & (F.min("us") == F.max("us"))).alias("lone"))
    ids = cut_lineage(ids)
    lone = ids.filter("lone").withColumn("color", F.lit(None).cast("string")).withColumn("kind", F.lit(None).cast("string"))
    pairs = evidence_window(lone, last_chances(obs, reach, span), reach, reach, width, "us", ["times"])
    first = (F.col("side") == "pre") & (F.col("prev_us").isNull() | (F.col("prev_us") < F.col("claim_us") - reach))
    gone = (F.col("claim_us") >= F.col("last.us")) & (F.col("next_us").isNull() | (F.col("next_us") > F.col("claim_us") + reach))
    hits = F.col("hits") * F.col("times")
    found = pairs.filter(first & gone & (hits >= 2)).select("claim_id", "track_id", hits.alias("hits_pre"), F.lit(0).cast("long").alias("hits_post"), "last")
    pooled = ids.filter("NOT lone").select(F.col("event_id").alias("_id"))
    if pooled.isEmpty():
        return found
    rest = evidence_window(claims.join(pooled, F.col("event_id").eqNullSafe(F.col("_id")), "left_semi"), obs, reach, reach, width, "us")
    return found.union(rest.groupBy("claim_id", "track_id").agg(
        F.count_if(F.col("side") == "pre").alias("hits_pre"), F.count_if(F.col("side") == "post").alias("hits_post"),
        F.max(F.when(F.col("side") == "pre", F.struct("us", "event_id", "x", "y"))).alias("last")).filter("hits_pre >= 2 and hits_post = 0"))


def last_chances(obs: DataFrame, reach: int, span: int) -> DataFrame:
    """Times at which an identity is seen and, within ``reach`` from there, for the last time before a gap of more than ``reach``.

    One row per identity and such time: ``hits`` sightings from it to the last one (``last``), the times before it
    (``prev_us``, if within ``reach``) and after the last one (``next_us``, if near enough to matter).
    """
    rows = obs.filter("dataset IS NOT NULL").select(*TRACK, "us", "event_id", "x", "y")
    w = W.partitionBy(*TRACK, "bucket").orderBy("us")
    near = with_halo(rows, "us", span, reach, 3 * reach).withColumn("_next", F.min("us").over(w.rangeBetween(1, 2 * reach))).select(
        *TRACK, "us", "is_home", F.count(F.lit(1)).over(w.rangeBetween(0, reach)).alias("hits"), F.lag("us").over(w).alias("_twin"),
        F.max("us").over(w.rangeBetween(-reach, -1)).alias("prev_us"), F.max(F.struct("us", "event_id", "x", "y", "_next")).over(w.rangeBetween(0, reach)).alias("_last"))
    ends = F.col("_last._next").isNull() | (F.col("_last._next") > F.col("_last.us") + reach)
    return near.filter(F.col("is_home") & ~F.col("_twin").eqNullSafe(F.col("us")) & ends).select(
        *TRACK, "us", "hits", "prev_us", F.struct("_last.us", "_last.event_id", "_last.x", "_last.y").alias("last"), F.col("_last._next").alias("next_us"))


def color_presence(obs_window: DataFrame) -> DataFrame:
    """Was the claimed colour measured after the claim: one scored sighting or two frames."""
    hit = (F.col("side") == "post") & (P.normalize_color(F.col("color")) == P.normalize_color(F.col("claim_color")))
    got = obs_window.filter(hit).groupBy("claim_id", "frame_no").agg(
        F.count(F.lit(1)).alias("d"), F.count_if(F.col("source") == "scored").alias("s")).groupBy("claim_id").agg(
        F.sum("d").alias("detections"), F.sum("s").alias("scored"), F.count(F.lit(1)).alias("hits"))
    return got.withColumn("measured", (F.col("scored") >= 1) | (F.col("hits") >= 2))


def track_summary(obs: DataFrame) -> DataFrame:
    """Majority colour (ties: the colour whose last sighting is earliest), conflicts, confidence."""
    conf = P.obs_confidence(F.col("source"), F.col("score"))
    votes = obs.groupBy(*TRACK, "color").agg(
        F.count(F.lit(1)).alias("votes"), F.max(F.struct("us", "event_id")).alias("last"), F.sum(conf).alias("conf"),
        F.count_if(F.col("source") == "scored").alias("scored"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    known = F.col("color") != P.UNKNOWN
    rank = F.struct(F.col("votes").alias("v"), (-F.col("last.us")).alias("u"), (-F.col("last.event_id")).alias("e"))
    out = votes.groupBy(*TRACK).agg(
        F.max_by(F.when(known, F.col("color")), F.when(known, rank)).alias("color"), F.sum("votes").alias("hits"),
        F.sum(F.when(known, F.col("votes"))).alias("_known"), F.max(F.when(known, F.col("votes"))).alias("_top"),
        F.sum("conf").alias("_conf"), F.sum("scored").alias("scored"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    out = out.withColumn("color", F.coalesce("color", F.lit(P.UNKNOWN))).withColumn("conflicts", F.coalesce(F.col("_known") - F.col("_top"), F.lit(0)))
    return out.withColumn("confidence", P.track_confidence(F.col("_conf") / F.col("hits"), F.col("hits"), F.col("conflicts"))).drop("_known", "_top", "_conf")


def dedupe_samples(obs: DataFrame, conf: str = "score", floor: float = 0.0) -> DataFrame:
    """One sample per (identity, frame): highest confidence, earlier on a tie."""
    w = W.partitionBy(*TRACK, "frame_no").orderBy(F.desc(conf), "us", "event_id")
    best = obs.withColumn("_rn", F.row_number().over(w)).withColumn("_dups", F.count(F.lit(1)).over(W.partitionBy(*TRACK, "frame_no")) - 1)
    return best.filter("_rn = 1").withColumn("duplicates", F.col("_dups")).drop("_rn", "_dups").withColumn("kept", F.col(conf) >= floor)


def sample_status(samples: DataFrame, minimum: int = 3) -> DataFrame:
    s = samples.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("samples"), F.count_if("kept").alias("kept"), F.sum("duplicates").alias("duplicates"))
    return s.withColumn("status", F.when(F.col("samples") < minimum, "track_too_short").when(F.col("kept") < minimum, "below_confidence_floor").otherwise("ok"))


def kinematics(obs: DataFrame, second: int, span: int, kink_speed: float = 200.0, bridge_s: float = 0.15) -> DataFrame:
    """Speed, kinks and bridges per identity from one position per frame (the latest sighting)."""
    frame = obs.groupBy(*TRACK, "frame_no").agg(F.max(F.struct("us", "event_id", "x", "y")).alias("p")).select(*TRACK, "frame_no", "p.us", "p.x", "p.y")
    i = ordered_index(frame, TRACK, [], "us", span)
    i = bounded_lag(i, TRACK, "idx", ["us", "x", "y"])
    dt = (F.col("us") - F.col("prev_us")) / float(second)
    i = i.withColumn("dt", dt).withColumn("vx", F.when(F.col("dt") > 1e-6, (F.col("x") - F.col("prev_x")) / F.col("dt"))).withColumn(
        "vy", F.when(F.col("dt") > 1e-6, (F.col("y") - F.col("prev_y")) / F.col("dt")))
    i = bounded_lag(i.drop("prev_us", "prev_x", "prev_y"), TRACK, "idx", ["vx", "vy"])
    change = F.hypot(F.col("vx") - F.col("prev_vx"), F.col("vy") - F.col("prev_vy"))
    return i.withColumn("speed", F.hypot("vx", "vy")).withColumn("kink", F.coalesce(change > kink_speed, F.lit(False))).withColumn(
        "bridged", F.coalesce(F.col("dt") > bridge_s, F.lit(False))).drop("prev_vx", "prev_vy")


def census_drops(frames: DataFrame, balls: DataFrame, radius: int, hold: int = 8, drop: int = 1, window: int = 40, span: int = 4096) -> DataFrame:
    """Episodes where the count falls below the running median and stays down.

    ``frames``: dataset, frame_no, n.  ``balls``: dataset, frame_no, color, id, x, y, mm (STRUCT)
    and optionally ``streak``.  The candidate names the missing ball nearest a pocket.
    """
    def look_back(w):
        return {"median": F.percentile("n", 0.5).over(w.rowsBetween(-window, -1)), "prev_frame_no": F.lag("frame_no").over(w)}
    i = ordered_index(frames, ["dataset"], [], "frame_no", span)
    # one row per frame, read by the island passes and by both sides of the ball lookup
    f = cut_lineage(halo_window(i, ["dataset"], "idx", 4096, window, 0, build=look_back))
    low = f.filter(F.col("n") <= F.col("median") - drop)
    runs = gap_islands(low, ["dataset"], "idx", 1, 4096, name="start_idx").groupBy("dataset", "start_idx").agg(
        F.count(F.lit(1)).alias("held"), F.min("n").alias("floor"), F.min(F.struct("idx", "frame_no", "prev_frame_no", "median")).alias("s")).filter(
        F.col("held") >= hold).select("dataset", "held", "floor", "s.frame_no", "s.prev_frame_no", "s.median")
    runs = cut_lineage(runs)
    now = runs.select("dataset", "frame_no")
    cur = balls.join(now, ["dataset", "frame_no"], "left_semi").select("dataset", "frame_no", "color", "id", "x", "y")
    before = balls.join(runs.select("dataset", F.col("prev_frame_no").alias("frame_no"), F.col("frame_no").alias("start")), ["dataset", "frame_no"])
    prev = before.drop("frame_no").withColumnRenamed("start", "frame_no")
    gone = vanished(prev.select("dataset", "frame_no", "color", "id", "x", "y"), cur, radius, ["dataset", "frame_no", "color"]).select("id")
    streak = F.col("streak") if "streak" in balls.columns else F.lit(1)
    lost = prev.join(gone, "id").withColumn("_st", streak).withColumn("near", G.nearest_pocket(F.col("mm.x"), F.col("mm.y")))
    ok = F.col("mm").isNotNull() & G.on_table(F.col("mm.x"), F.col("mm.y"), 30.0)
    best = lost.groupBy("dataset", "frame_no").agg(F.count(F.lit(1)).alias("missing"), F.min(F.when(ok, F.struct(
        F.col("near.dist").alias("dist"), (-F.col("_st")).alias("k"), "id", "color", F.col("near.pocket").alias("pocket")))).alias("b"))
    return runs.join(best, ["dataset", "frame_no"], "left").select(
        "dataset", "frame_no", "held", "floor", "median", (F.col("median") - F.col("floor")).alias("census_drop"),
        F.coalesce("missing", F.lit(0)).alias("missing"), F.col("b.id").alias("ball_id"), F.col("b.color").alias("color"),
        F.col("b.pocket").alias("pocket"), F.col("b.dist").alias("pocket_mm"))


def shot_candidates(matched: DataFrame, balls: DataFrame, persists: DataFrame, gap_s: float, min_mm: float = 300.0,
                    lo: float = 500.0, hi: float = 11000.0) -> DataFrame:
    """Matched pairs that moved far and fast enough, start established, arrival persists.

    ``matched``: prev_id, cur_id.  ``balls``: id, color, frame_no, streak, mm.
    """
    a = balls.filter("streak >= 2").select(F.col("id").alias("prev_id"), "dataset", "color", F.col("mm").alias("from_mm"))
    b = balls.select(F.col("id").alias("cur_id"), "frame_no", F.col("mm").alias("to_mm"))
    m = matched.select("prev_id", "cur_id").join(shuffled(a), "prev_id").join(shuffled(b), "cur_id").join(
        shuffled(persists.select(F.col("id").alias("cur_id"))), "cur_id", "left_semi")
    m = m.withColumn("disp_mm", G.distance(F.col("from_mm.x"), F.col("from_mm.y"), F.col("to_mm.x"), F.col("to_mm.y"))).withColumn(
        "speed_mm_s", F.col("disp_mm") / gap_s)
    on = G.on_table(F.col("from_mm.x"), F.col("from_mm.y"), 30.0) & G.on_table(F.col("to_mm.x"), F.col("to_mm.y"), 30.0)
    return m.filter(on & (F.col("disp_mm") >= min_mm) & (F.col("speed_mm_s") >= lo) & (F.col("speed_mm_s") <= hi))


def motion_candidates(frames: DataFrame, floor: float = 18.0) -> DataFrame:
    """Energy spikes while the census stays within one of its running median."""
    return frames.filter((F.col("motion") >= floor) & F.col("median").isNotNull() & (F.abs(F.col("n") - F.col("median")) <= 1))


SIDE = ("claim_id", "post", "known", "track_id", "claim_color", "mx", "my", "color", "hits")


def dominant_spots(ax, ay, bx, by):
    """Index pairs that a walk over all pairs by (distance, left, right) takes, a used end skipped; by rounds of pairs first at both ends."""
    left, right, won = np.arange(len(ax)), np.arange(len(bx)), []
    while len(left) and len(right):
        to, back, least = np.empty(len(left), int), np.zeros(len(right), int), np.full(len(right), np.inf)
        step = max(1, 2**20 // len(right))
        for s in range(0, len(left), step):
            at = left[s:s + step, None]
            d = np.hypot(ax[at] - bx[right], ay[at] - by[right])
            d[np.isnan(d)] = -1.0  # an unknown place comes first, as null does
            to[s:s + step] = d.argmin(axis=1)
            first = d.argmin(axis=0)
            got = d[first, np.arange(len(right))]
            closer = got < least
            back[closer], least[closer] = first[closer] + s, got[closer]
        both = back[to] == np.arange(len(left))
        won.append(np.stack([left[both], right[to[both]]]))
        left, right = left[~both], np.delete(right, to[both])
    return np.concatenate(won, axis=1) if won else np.empty((2, 0), int)


def nearest_sides(sides: DataFrame) -> DataFrame:
    """The greedy nearest pairs of mean places before and after each claim; rows as in ``SIDE``, one per track and side.

    Only sides are shuffled and sorted, by claim; pairs live one claim (one event window) at a time, in blocks,
    so neither a shuffle nor a task's memory holds the pairs of its claims.
    """
    from ..session import ship_package

    ship_package(sides.sparkSession)

    def pairs(pdf):
        key, post = pdf["claim_id"].to_numpy(), pdf["post"].to_numpy(bool)
        x, y, ids = pdf["mx"].to_numpy(float), pdf["my"].to_numpy(float), list(zip(pdf["known"], pdf["track_id"]))
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends, found = np.r_[starts[1:], len(key)], []
        for s, e in zip(starts, ends):
            m = s + int(np.count_nonzero(~post[s:e]))
            if s == m or m == e:
                continue
            if len(set(ids[s:m])) == m - s and len(set(ids[m:e])) == e - m:
                found.append(dominant_spots(x[s:m], y[s:m], x[m:e], y[m:e]) + [[s], [m]])
                continue
            used = set()  # a repeated claim may hold a track more than once: an end is the track, not the row
            d = np.nan_to_num(np.hypot(x[s:m, None] - x[m:e], y[s:m, None] - y[m:e]), nan=-1.0)
            for k in np.argsort(d, axis=None, kind="stable"):
                i, j = s + k // (e - m), m + k % (e - m)
                if (0, ids[i]) not in used and (1, ids[j]) not in used:
                    used |= {(0, ids[i]), (1, ids[j])}
                    found.append(np.array([[i], [j]]))
        at = np.concatenate(found, axis=1) if found else np.empty((2, 0), int)
        a, b = pdf.iloc[at[0]], pdf.iloc[at[1]]
        named = {"claim_id": a["claim_id"], "claim_color": a["claim_color"], "a_known": a["known"], "a_id": a["track_id"]}
        for side, rows in (("a", a), ("b", b)):
            named |= {f"{side}x": rows["mx"], f"{side}y": rows["my"], f"{side}c": rows["color"], f"{side}h": rows["hits"]}
        return pd.DataFrame({n: v.to_numpy() for n, v in named.items()})

    def run(batches):
        held = []
        for pdf in batches:
            if pdf.empty:
                continue
            key = pdf["claim_id"].to_numpy()
            if held and key[0] == key[-1] == held[-1]["claim_id"].iloc[-1]:
                held.append(pdf)
                continue
            rows = pd.concat([*held, pdf], ignore_index=True) if held else pdf
            cut = int(np.argmax(rows["claim_id"].to_numpy() == key[-1]))
            held = [rows.iloc[cut:]]
            if cut:
                yield pairs(rows.iloc[:cut])
        if held:
            yield pairs(pd.concat(held, ignore_index=True))

    kind = dict(sides.dtypes)
    schema = f"claim_id {kind['claim_id']}, claim_color {kind['claim_color']}, a_known boolean, a_id {kind['track_id']}, " + ", ".join(
        f"{s}x double, {s}y double, {s}c {kind['color']}, {s}h long" for s in "ab")
    got = sides.repartition("claim_id").sortWithinPartitions(*SIDE[:4]).mapInPandas(run, schema)
    return got.withColumn("a_id", F.when(F.col("a_known"), F.col("a_id"))).drop("a_known")


def displacement(sides: DataFrame, min_mm: float = 300.0, still_mm: float = 60.0) -> DataFrame:
    """Greedy pairing of mean positions before and after an anchor; the best mover, claim colour first.

    ``sides``: claim_id, claim_color, side, track_id, color, mx, my (one row per sighting).
    """
    per = sides.groupBy("claim_id", "claim_color", "side", "track_id").agg(
        F.avg("mx").alias("mx"), F.avg("my").alias("my"), F.count(F.lit(1)).alias("hits"), F.min(F.struct("us", "event_id", "color")).alias("c"))
    per = per.withColumn("color", F.col("c.color")).drop("c")
    per = per.withColumn("known", F.col("track_id").isNotNull()).withColumn("track_id", F.coalesce("track_id", F.lit(0)))
    near = nearest_sides(per.withColumn("post", F.col("side") == "post").select(*SIDE).filter("claim_id is not null"))
    full = near.withColumn("dist", F.rint(F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))))
    want = (F.col("claim_color") == F.col("ac")) | (F.col("claim_color") == F.col("bc"))
    moved = F.col("dist") >= min_mm
    item = F.struct(F.when(want, 1).otherwise(0).alias("w"), F.col("dist").alias("dist"), (-F.col("a_id")).alias("k"), F.col("ac").alias("color"), F.col("ah").alias("ah"), F.col("bh").alias("bh"))
    return full.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("measured"), F.count_if(moved).alias("moved"), F.count_if(F.col("dist") <= still_mm).alias("still"),
        F.max(F.when(moved, item)).alias("b")).select(
        "claim_id", "measured", "moved", "still", (F.col("b.w") == 1).alias("claim_color_measured"), F.col("b.dist").alias("disp_mm"),
        F.col("b.color").alias("color"), F.col("b.ah").alias("start_hits"), F.col("b.bh").alias("end_hits"))
