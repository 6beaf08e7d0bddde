"""Linking detections into identities, and the order-dependent rules around it.

Every sequential rule here has a reach in time.  Rows are first cut into islands no link
can cross (``gap_islands``), then streamed island by island with a small state, so one
long recording spreads over many tasks and no island is collected.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalars as P
from ..session import cut_lineage
from .joins import near_pairs, range_pairs
from .kernels import bounded_lag, exact_quantiles, gap_islands, ordered_index, stream_fold, strongest_first

TRACK = ("dataset", "track_id")


@dataclass(frozen=True)
class LinkConfig:
    """Fixed values of the association gate, in pixels and seconds."""

    match_px: float = 30.0
    gap_s: float = 2.0
    bootstrap_px: float = 60.0
    bootstrap_dt_s: float = 0.1
    slack: float = 0.25
    bridge_s: float = 0.15
    flicker_px: float = 14.0
    stitch_gap_s: float = 1.0
    stitch_px: float = 45.0
    bucket_s: float = 0.02
    kink_px_s: float = 200.0
    double_px: int = 12


class Identity:
    """Summary of one identity: enough to predict, gate and vote, not its sightings."""

    __slots__ = ("tid", "hits", "first", "last", "prev", "votes", "source", "bucket", "seen", "root")

    def __init__(self, tid):
        self.tid, self.hits, self.first, self.last, self.prev = tid, 0, None, None, None
        self.votes, self.source, self.bucket, self.seen = {}, None, None, set()

    def add(self, t, x, y, color, source, bucket):
        self.prev, self.last = self.last, (t, x, y)
        self.first = self.first or self.last
        if bucket != self.bucket:
            self.bucket, self.seen = bucket, set()
        self.seen.add(source)
        self.source = source
        if color != P.UNKNOWN:
            self.votes[color] = (self.votes.get(color, (0, 0))[0] + 1, self.hits)
        self.hits += 1

    @property
    def color(self):
        return max(self.votes, key=lambda c: (self.votes[c][0], -self.votes[c][1])) if self.votes else P.UNKNOWN

    def velocity(self):
        if self.prev is None or self.last[0] - self.prev[0] <= 1e-6:
            return 0.0, 0.0
        dt = self.last[0] - self.prev[0]
        return (self.last[1] - self.prev[1]) / dt, (self.last[2] - self.prev[2]) / dt


class OpenPool:
    """Open identities with their predictor state in arrays, so one sighting is gated in one pass."""

    FIELDS = ("t", "x", "y", "vx", "vy", "hits")

    def __init__(self, cfg: LinkConfig):
        self.cfg, self.ids, self.count = cfg, [], 0
        self.a = {f: np.zeros(64) for f in self.FIELDS}

    def put(self, i: int, k: Identity) -> None:
        vx, vy = k.velocity()
        for f, v in zip(self.FIELDS, (*k.last, vx, vy, k.hits)):
            self.a[f][i] = v

    def open(self) -> Identity:
        self.count += 1
        k = Identity(self.count)
        if len(self.ids) == len(self.a["t"]):
            self.a = {f: np.concatenate([v, np.zeros_like(v)]) for f, v in self.a.items()}
        self.ids.append(k)
        return k

    def candidates(self, t: float, x: float, y: float):
        """(index, residual, dt) of the identities whose gate admits the sighting, nearest first."""
        n, c = len(self.ids), self.cfg
        if not n:
            return ()
        dt = t - self.a["t"][:n]
        fresh = dt <= c.gap_s
        if n > 64 and fresh.sum() * 2 < n:
            keep = np.flatnonzero(fresh)
            self.ids = [self.ids[i] for i in keep]
            for f in self.FIELDS:
                self.a[f][: len(keep)] = self.a[f][keep]
            n, dt, fresh = len(keep), dt[keep], fresh[keep]
        vx, vy, lead = self.a["vx"][:n], self.a["vy"][:n], np.maximum(dt, 0.0)
        away = np.hypot(self.a["x"][:n] + vx * lead - x, self.a["y"][:n] + vy * lead - y)
        wide = np.where(dt <= c.bootstrap_dt_s, c.bootstrap_px, c.match_px)
        bar = np.where(self.a["hits"][:n] < 2, wide, c.match_px + c.slack * np.hypot(vx, vy) * lead)
        hit = np.flatnonzero(fresh & (away <= bar))
        return [(int(i), float(away[i]), float(dt[i])) for i in hit[np.argsort(away[hit], kind="stable")]]


def _link(pool: OpenPool, bucket, t, x, y, color, source, cfg):
    """(identity, residual, bridged) of one sighting against the open identities; ``bucket`` is its frame, the same wherever an island starts."""
    for i, away, dt in pool.candidates(t, x, y):
        k = pool.ids[i]
        if k.bucket == bucket and source in k.seen:
            continue
        mine = k.color
        flicker = k.hits < 2 and k.source == source and away <= cfg.flicker_px
        if mine == color or P.UNKNOWN in (mine, color) or flicker:
            k.add(t, x, y, color, source, bucket)
            pool.put(i, k)
            return k, away, dt > cfg.bridge_s
    k = pool.open()
    k.add(t, x, y, color, source, bucket)
    pool.put(len(pool.ids) - 1, k)
    return k, None, False


def associate(obs: DataFrame, second: int, width: int, cfg: LinkConfig = LinkConfig()) -> DataFrame:
    """obs + (tid, residual_px, bridged, stitched, bucket, seq): constant-velocity association, then stitching.

    obs: dataset, us, event_id, color, source, x, y.  ``tid`` is unique per dataset: the
    local number inside an island plus the identities opened in earlier islands.  ``seq`` is
    the place of a sighting in the walk over its island; ``association_stats`` counts the links.
    """
    import pandas as pd

    isl = gap_islands(obs, ["dataset"], "us", int(cfg.gap_s * second), width, ["event_id"], "island").drop("opens")
    isl = isl.withColumn("bucket", F.rint(F.col("us") / (cfg.bucket_s * second)).cast("long"))

    def step(state, pdf):
        rows = []
        t0 = state.setdefault("t0", int(pdf["us"].iloc[0]))
        for bucket, us, x, y, c, s in zip(pdf["bucket"], pdf["us"], pdf["x"], pdf["y"], pdf["color"], pdf["source"]):
            k, away, bridged = _link(state["pool"], int(bucket), (int(us) - t0) / second, float(x), float(y), c, s, cfg)
            rows.append((state["seq"], k.tid, away, bridged))
            state["seq"] += 1
        got = pd.DataFrame(rows, columns=["seq", "local", "residual_px", "bridged"])
        return pd.concat([pdf[["dataset", "island", "event_id", "us", "bucket", "source", "x", "y", "color"]].reset_index(drop=True), got], axis=1)
    cols = ["dataset", "island", "bucket", "source", "color", "x", "y", "us", "event_id"]
    linked = stream_fold(isl.select(*cols), ["dataset", "island"], ["bucket", "source", "color", "x", "event_id"], lambda: {"pool": OpenPool(cfg), "seq": 0}, step,
                         "dataset long, island long, event_id long, us long, bucket long, source string, x double, y double, color string, seq long, local long, residual_px double, bridged boolean")
    # five branches of the stitch read the links: written once, so the fold runs once
    return stitch(cut_lineage(linked), second, cfg)


class Piece:
    """One identity as the stitch sees it: its ends, the sighting before its last, colour votes and the pieces it took in."""

    __slots__ = ("local", "hits", "first", "last", "prev", "votes", "parts", "gone")

    def __init__(self, row):
        self.local, self.hits, self.gone = int(row["local"]), int(row["hits"]), False
        self.first = (int(row["a_us"]), row["ax"], row["ay"], int(row["head"]))
        self.last = (int(row["z_us"]), row["zx"], row["zy"])
        self.prev = None if row["w_us"] is None or row["w_us"] != row["w_us"] else (int(row["w_us"]), row["wx"], row["wy"])
        self.votes = {} if row["vote_color"] is None else {c: (int(n), int(at)) for c, n, at in zip(row["vote_color"], row["vote_n"], row["vote_at"])}
        self.parts = [(self.local, None, None, None)]

    @property
    def color(self):
        return max(self.votes, key=lambda c: (self.votes[c][0], -self.votes[c][1])) if self.votes else P.UNKNOWN

    def fits(self, other: Piece, second: int, cfg: LinkConfig):
        """Distance of the other's first sighting from where this piece points, if the gate admits it."""
        gap = (other.first[0] - self.last[0]) / second
        if not cfg.bucket_s <= gap <= cfg.stitch_gap_s or (P.UNKNOWN not in (self.color, other.color) and self.color != other.color):
            return None
        dt = (self.last[0] - self.prev[0]) / second if self.prev else 0.0
        vx, vy = ((self.last[1] - self.prev[1]) / dt, (self.last[2] - self.prev[2]) / dt) if dt > 1e-6 else (0.0, 0.0)
        away = math.hypot(self.last[1] + vx * gap - other.first[1], self.last[2] + vy * gap - other.first[2])
        bar = cfg.stitch_px + cfg.slack * math.hypot(vx, vy) * gap if self.hits > 1 else cfg.bootstrap_px if gap <= cfg.bootstrap_dt_s else cfg.stitch_px
        return away if away <= bar else None

    def take(self, other: Piece, away: float, bridged: bool) -> bool:
        """Continue with the other piece; true if the colour of the whole is another one now."""
        before = self.color
        self.prev, self.last, self.hits = other.prev or self.last, other.last, self.hits + other.hits
        for c, (n, at) in other.votes.items():
            self.votes[c] = (self.votes.get(c, (0, 0))[0] + n, at)
        local, *_ = other.parts[0]
        self.parts += [(local, other.first[3], away, bridged), *other.parts[1:]]
        other.gone = True
        return self.color != before


class Stitcher:
    """Pieces arrive by start and are settled by end: each takes the earliest later piece that fits, then looks again.

    A piece is settled once every piece that may start in its reach has arrived.  A settled piece stays at
    hand while an unsettled one starts in its reach, because that one may still change its colour and fit.
    """

    def __init__(self, second: int, cfg: LinkConfig):
        self.second, self.cfg, self.reach = second, cfg, cfg.stitch_gap_s * second
        self.waiting, self.settled, self.born = [], [], []

    def arrive(self, piece: Piece) -> list[Piece]:
        done = self.settle(piece.first[0])
        heapq.heappush(self.waiting, (piece.last[0], piece.local, piece))
        self.born.append(piece)
        return done

    def settle(self, until: float) -> list[Piece]:
        moved = False
        while self.waiting and self.waiting[0][0] + self.reach < until:
            moved = True
            _, _, older = heapq.heappop(self.waiting)
            if older.gone:
                continue
            # born is in order of start
            lo = bisect.bisect_left(self.born, older.last[0], key=lambda k: k.first[0])
            for newer in itertools.islice(self.born, lo, None):
                if newer.first[0] > older.last[0] + self.reach:
                    self.settled.append(older)
                    break
                away = None if newer.gone or newer is older else older.fits(newer, self.second, self.cfg)
                if away is not None:
                    gap = (newer.first[0] - older.last[0]) / self.second
                    if older.take(newer, away, gap > self.cfg.bridge_s):
                        again = [k for k in self.settled if 0 < older.first[0] - k.last[0] <= self.reach]
                        self.settled = [k for k in self.settled if k not in again]
                        for k in again:
                            heapq.heappush(self.waiting, (k.last[0], k.local, k))
                    heapq.heappush(self.waiting, (older.last[0], older.local, older))
                    break
            else:
                self.settled.append(older)
        # letting go costs a look at all that is at hand, so a few are kept longer
        return self.release(until) if moved and (len(self.settled) > 64 or until == math.inf) else []

    def release(self, until: float) -> list[Piece]:
        """Settled pieces that nothing can change any more; they leave the state."""
        live = [k for _, _, k in self.waiting if not k.gone]
        starts, keep, done = sorted(k.first[0] for k in live), [], []
        # from the latest end back: a piece that stays at hand holds the ones before it in turn
        for k in sorted((k for k in self.settled if not k.gone), key=lambda k: -k.last[0]):
            i = bisect.bisect_right(starts, k.last[0])
            if i < len(starts) and starts[i] <= k.last[0] + self.reach:
                keep.append(k)
                bisect.insort(starts, k.first[0])
            else:
                done.append(k)
        self.settled = keep
        # a piece can still be taken while a piece that waits or is at hand ends less than the reach before it starts
        low = min([k.last[0] for k in (*live, *self.settled)], default=until)
        self.born = [k for k in self.born if not k.gone and k.first[0] >= low]
        return done


def stitch(linked: DataFrame, second: int, cfg: LinkConfig) -> DataFrame:
    """Re-join identities split by a short occlusion; works on one summary row per identity.

    The pair with the earliest end, then the earliest start, is joined first, until no pair fits.  The first
    sighting of a re-joined piece is ``stitched``: it carries its distance from where the earlier piece
    pointed, and is bridged if the hole is longer than ``bridge_s``.
    """
    import pandas as pd

    keys = ["dataset", "island", "local"]
    p = F.struct("seq", "us", "event_id", "x", "y")
    votes = linked.filter(F.col("color") != P.UNKNOWN).groupBy(*keys, "color").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("at"))
    votes = votes.groupBy(*keys).agg(F.collect_list(F.struct("color", "n", "at")).alias("v")).select(*keys, *[F.col(f"v.{c}").alias(f"vote_{c}") for c in ("color", "n", "at")])
    ends = linked.groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"), F.min(p).alias("a"), F.max(p).alias("z"))
    prev = linked.join(ends.select(*keys, F.col("z.seq").alias("_z")), keys).filter("seq <> _z").groupBy(*keys).agg(F.max(p).alias("w"))
    tails = ends.join(prev, keys, "left").join(votes, keys, "left").select(
        *keys, "hits", "vote_color", "vote_n", "vote_at", F.col("a.event_id").alias("head"), *[F.col(f"{s}.{c}").alias(f"{s}_us" if c == "us" else s + c) for s in "azw" for c in ("us", "x", "y")])

    def rows(key, done):
        out = [(*key, local, k.local, head, away, bridged) for k in done for local, head, away, bridged in k.parts]
        return pd.DataFrame(out, columns=["dataset", "island", "local", "root", "head", "away", "joined_bridged"], dtype=object)

    def step(state, pdf):
        state["key"] = (pdf["dataset"].iloc[0], pdf["island"].iloc[0])
        return rows(state["key"], [k for r in pdf.to_dict("records") for k in state["stitcher"].arrive(Piece(r))])

    roots = stream_fold(tails, ["dataset", "island"], ["a_us", "local"], lambda: {"stitcher": Stitcher(second, cfg)}, step,
                        "dataset long, island long, local long, root long, head long, away double, joined_bridged boolean",
                        finish=lambda state: rows(state["key"], state["stitcher"].settle(math.inf)))
    counts = linked.groupBy("dataset", "island").agg(F.max("local").alias("n"))
    w = W.partitionBy("dataset").orderBy("island").rowsBetween(W.unboundedPreceding, -1)
    offs = counts.select("dataset", "island", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("off"))
    joined = F.coalesce(F.col("event_id") == F.col("head"), F.lit(False))
    return linked.join(roots, keys).join(offs, ["dataset", "island"]).withColumn("tid", F.col("off") + F.col("root")).withColumn("stitched", joined).withColumn(
        "bridged", F.when(F.col("stitched"), F.col("joined_bridged")).otherwise(F.col("bridged"))).withColumn(
        "residual_px", F.when(F.col("stitched"), F.col("away")).otherwise(F.col("residual_px"))).drop("local", "root", "off", "head", "away", "joined_bridged")


def association_stats(linked: DataFrame, second: int, cfg: LinkConfig = LinkConfig()) -> DataFrame:
    """Purity counters of ``associate`` per dataset.

    assignments, tracks, bridged_links and wide_links (links the fixed gate would refuse) of the walk,
    stitched_links, frame_source_skips (identities passed over because the frame and source had them already),
    kinks (speed changes beyond ``kink_px_s`` between the frames of an identity), kinked_tracks, double_claims
    (two identities within ``double_px`` in one frame) and frames_with_double_claims.
    """
    links = linked.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("assignments"), F.count_if(F.col("bridged") & ~F.col("stitched")).alias("bridged_links"),
        F.count_if(~F.col("stitched") & (F.col("residual_px") > cfg.match_px)).alias("wide_links"), F.count_if("stitched").alias("stitched_links"))
    seen = linked.groupBy("dataset", "bucket", "source").agg(F.count(F.lit(1)).alias("n"))
    skips = seen.groupBy("dataset").agg(F.sum(F.expr("n * (n - 1) div 2")).alias("frame_source_skips"))
    spots = linked.groupBy("dataset", "tid", "bucket").agg(F.max(F.struct("island", "seq", "us", "x", "y")).alias("p")).select("dataset", "tid", "bucket", "p.us", "p.x", "p.y")
    w = W.partitionBy("dataset", "tid").orderBy("bucket")
    dt = (F.col("us") - F.lag("us").over(w)) / F.lit(float(second))
    moved = F.when(dt > 1e-6, F.struct(((F.col("x") - F.lag("x").over(w)) / dt).alias("x"), ((F.col("y") - F.lag("y").over(w)) / dt).alias("y")))
    v = spots.withColumn("v", moved)
    turn = v.withColumn("u", F.lag("v").over(w)).withColumn("kink", F.coalesce(F.hypot(F.col("v.x") - F.col("u.x"), F.col("v.y") - F.col("u.y")) > cfg.kink_px_s, F.lit(False)))
    kinks = turn.groupBy("dataset", "tid").agg(F.count_if("kink").alias("k")).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("tracks"), F.count_if(F.col("k") > 0).alias("kinked_tracks"), F.sum("k").alias("kinks"))
    one = linked.select("dataset", "bucket", "x", "y", F.col("event_id").alias("a"), F.col("tid").alias("ta"))
    two = linked.select("dataset", "bucket", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("event_id").alias("b"), F.col("tid").alias("tb"))
    near = near_pairs(one, two, ["dataset", "bucket"], cfg.double_px, ("x", "y"), ("x2", "y2")).filter("a < b and ta <> tb")
    double = near.groupBy("dataset", "bucket").agg(F.count(F.lit(1)).alias("n")).groupBy("dataset").agg(
        F.sum("n").alias("double_claims"), F.count(F.lit(1)).alias("frames_with_double_claims"))
    out = links.join(skips, "dataset").join(kinks, "dataset").join(double, "dataset", "left")
    return out.fillna(0, ["double_claims", "frames_with_double_claims"])


def iou_tracklets(boxes: DataFrame, keys: Sequence[str], order: Sequence[str], mode: str = "burst", bar: float | None = None, grace: int = 3) -> DataFrame:
    """IoU linking.  ``burst``: one box at a time against the open boxes of the burst (>= .5).
    ``grace``: a track stays open for ``grace`` frames and takes one box per frame (>= .3)."""
    import pandas as pd

    floor = bar if bar is not None else (0.5 if mode == "burst" else 0.3)

    def overlap(a, b):
        inter = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
        union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
        return inter / union if union > 0 else 0.0

    def step(state, pdf):
        out = []
        for f, *box in zip(pdf["frame_no"], pdf["x"], pdf["y"], pdf["x2"], pdf["y2"]):
            if mode == "grace":
                state["pool"] = [t for t in state["pool"] if f - t["frame"] <= grace]
            fit = [(overlap(t["box"], box), i) for i, t in enumerate(state["pool"]) if mode == "burst" or t["frame"] != f]
            fit = [s for s in fit if s[0] >= floor]
            if fit:
                t = state["pool"].pop(max(fit)[1])
            else:
                state["n"] += 1
                t = {"id": state["n"]}
            t.update(box=box, frame=f)
            state["pool"].append(t)
            out.append(t["id"])
        return pd.DataFrame({**{k: pdf[k].to_numpy() for k in keys}, "event_id": pdf["event_id"].to_numpy(), "tracklet": out})
    cols = list(dict.fromkeys([*keys, *order, "frame_no", "event_id", "x", "y", "x2", "y2"]))
    return stream_fold(boxes.select(*cols), list(keys), list(order), lambda: {"pool": [], "n": 0}, step, ", ".join(f"{k} long" for k in keys) + ", event_id long, tracklet long")


def dedupe_claims(claims: DataFrame, second: int, width: int, window_s: float = 2.0, strict_s: float = 0.5, near_mm: float = 200.0) -> DataFrame:
    """First-fit groups of claims that describe one act; the earliest is kept.

    claims: dataset, kind, us, event_id, color, pocket, mx, my.  Two claims of one kind within the
    window describe one act when two of colour, place and instant agree.  A claim joins the first
    group with *any* matching member, so groups are not connected components.
    """
    import pandas as pd

    reach, strict = int(window_s * second), int(strict_s * second)
    isl = gap_islands(claims, ["dataset", "kind"], "us", reach, width, ["event_id"], "island").drop("opens")

    def text(v):
        return v if isinstance(v, str) and v else None

    def step(state, pdf):
        out = []
        for us, eid, color, pocket, mx, my in zip(pdf["us"], pdf["event_id"], pdf["color"], pdf["pocket"], pdf["mx"], pdf["my"]):
            color, pocket, at = text(color), text(pocket), None if mx != mx or my != my else (mx, my)
            leader = None
            keep = []
            for g in state["groups"]:
                g["members"] = [m for m in g["members"] if us - m[0] <= reach]
                if g["members"]:
                    keep.append(g)
                if leader is None and any(_agreements(us - m[0], color, pocket, at, m, strict, near_mm) >= 2 for m in g["members"]):
                    leader = g
            state["groups"] = keep
            if leader is None:
                leader = {"id": eid, "members": []}
                state["groups"].append(leader)
            leader["members"].append((us, color, pocket, at))
            out.append(leader["id"])
        return pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "leader": out, "color": pdf["color"].to_numpy(), "kind": pdf["kind"].to_numpy()})
    cols = ["dataset", "kind", "island", "us", "event_id", "color", "pocket", "mx", "my"]
    rows = stream_fold(isl.select(*cols), ["dataset", "kind", "island"], ["us", "event_id"], lambda: {"groups": []}, step, "event_id long, leader long, color string, kind string")
    return rows.groupBy("leader", "kind").agg(F.count(F.lit(1)).alias("count"), F.array_join(F.array_sort(F.collect_set("color")), "+").alias("colors")).withColumnRenamed("leader", "event_id")


def _agreements(dt, color, pocket, at, member, strict, near_mm) -> int:
    """In how many of three ways two claims agree: colour, place (pocket or spot), instant."""
    _, other_color, other_pocket, other_at = member
    spot = None not in (at, other_at) and math.dist(at, other_at) <= near_mm
    return sum((bool(color) and color == other_color, spot or (bool(pocket) and pocket == other_pocket), dt <= strict))


def occlusion_reasons(cands: DataFrame, person: Column, cloth: Column, median: Column, share: float = 0.02, band=(0.55, 1.60)) -> DataFrame:
    reasons = F.array_compact(F.array(F.when(median.isNotNull() & (median != 0) & ~cloth.between(band[0] * median, band[1] * median), "cloth_area_out_of_band"),
                                      F.when(person > share, "person_on_cloth")))
    return cands.withColumn("drop_reasons", reasons)


def prune_candidates(cands: DataFrame, second: int, width: int, window_s: float = 4.0, near_mm: float = 250.0) -> DataFrame:
    """Strongest candidate per act; weaker ones within the window and distance are counted.

    Candidates that exclude each other are paired once, by time bucket; ``strongest_first`` settles the pairs, and a candidate
    that goes counts for the strongest of its neighbours that stay.
    """
    keys, reach = ["dataset", "kind"], int(window_s * second)
    item = F.struct((-F.col("strength")).alias("k"), "us", "event_id")
    rows = cut_lineage(cands.select(*keys, "us", "event_id", "mx", "my", item.alias("order")))
    other = rows.select(*keys, *[F.col(c).alias(f"s_{c}") for c in ("us", "event_id", "mx", "my", "order")])
    apart = F.hypot(F.col("mx") - F.col("s_mx"), F.col("my") - F.col("s_my")) > near_mm
    pairs = range_pairs(rows, other, keys, "us", "s_us", -reach, reach, max(width, reach)).filter((F.col("s_order") < F.col("order")) & ~F.coalesce(apart, F.lit(False)))
    pairs = cut_lineage(pairs.select(*keys, F.col("event_id").alias("weak"), F.col("s_event_id").alias("strong"), "order", "s_order"))
    gone = cut_lineage(strongest_first(pairs, keys))
    leaders = pairs.join(gone.select(F.col("weak").alias("strong")), "strong", "left_anti").join(gone, "weak").groupBy(*keys, "weak").agg(F.min("s_order").alias("_s"))
    led = leaders.groupBy(*keys, F.col("_s.event_id").alias("event_id")).agg(F.count(F.lit(1)).alias("_n"))
    stays = rows.select(*keys, "event_id").join(gone.select(F.col("weak").alias("event_id")), "event_id", "left_anti")
    return stays.join(led, [*keys, "event_id"], "left").select(*keys, "event_id", (F.coalesce("_n", F.lit(0)) + 1).alias("duplicates"))


def debounce(rows: DataFrame, second: int, window_s: float = 4.0) -> DataFrame:
    """Drop a row closer than the window to the last *kept* row of any type when the types agree."""
    import pandas as pd
    reach = int(window_s * second)

    def step(state, pdf):
        keep = []
        for us, kind in zip(pdf["us"], pdf["kind"]):
            last = state.get("last")
            ok = last is None or us - last[0] >= reach or last[1] != kind
            if ok:
                state["last"] = (us, kind)
            keep.append(ok)
        return pd.DataFrame({"dataset": pdf["dataset"].to_numpy(), "event_id": pdf["event_id"].to_numpy(), "kept": keep})
    return stream_fold(rows.select("dataset", "us", "event_id", "kind"), ["dataset"], ["us", "event_id"], dict, step, "dataset long, event_id long, kept boolean")


def frame_gate(frames: DataFrame, band=(0.85, 1.15), brightness_step: float = 6.0, ball_band: int = 2, window: int = 30) -> DataFrame:
    """Admissibility of each frame; the cloth reference and census follow *accepted* frames only.

    frames: dataset, frame_no, n, cloth, brightness, person.  First blocking reason wins.
    """
    import pandas as pd
    from statistics import median

    def make():
        return {"ref": None, "light": None, "census": []}

    def step(s, pdf):
        out = []
        for n, cloth, light, person in zip(pdf["n"], pdf["cloth"], pdf["brightness"], pdf["person"]):
            if person:
                why = "person_on_table"
            elif s["ref"] is None:
                why = "warming_up"
            elif not band[0] * s["ref"] <= cloth <= band[1] * s["ref"]:
                why = "cloth_area_out_of_band"
            elif s["light"] is not None and abs(light - s["light"]) > brightness_step:
                why = "exposure_shift"
            elif s["census"] and n < median(s["census"]) - ball_band:
                why = "ball_census_off"
            else:
                why = None
            if s["ref"] is None and not person:
                s["ref"] = float(cloth)
            if why is None:
                s["ref"] = 0.95 * s["ref"] + 0.05 * float(cloth)
                s["census"] = (s["census"] + [int(n)])[-window:]
            s["light"] = light
            out.append(why)
        return pd.DataFrame({"dataset": pdf["dataset"].to_numpy(), "frame_no": pdf["frame_no"].to_numpy(), "reason": out})
    return stream_fold(frames, ["dataset"], ["frame_no"], make, step, "dataset long, frame_no long, reason string")


@dataclass(frozen=True)
class DenseConfig:
    """Fixed values of the dense rules, in pixels and seconds."""

    rest_speed: float = 6.0
    rest_window_s: float = 0.5
    rest_min: int = 2
    motion_speed: float = 40.0
    onset_intervals: int = 3
    max_gap_s: float = 0.25
    min_net_px: float = 37.8
    net_error_px: float = 3.62 * math.sqrt(2.0)
    loc_error_px: float = 3.62
    vanish_min_s: float = 0.4
    vanish_cadence: float = 4.0
    persistence_s: float = 1.0


def intervals(samples: DataFrame, second: int, width: int) -> DataFrame:
    """Consecutive sample pairs per identity: idx is the later sample."""
    i = bounded_lag(ordered_index(samples, TRACK, ["event_id"], "us", width), TRACK, "idx", ["us", "x", "y", "event_id"])
    dt = (F.col("us") - F.col("prev_us")) / float(second)
    i = i.withColumn("dt", dt).withColumn("dist", F.hypot(F.col("x") - F.col("prev_x"), F.col("y") - F.col("prev_y")))
    return i.withColumn("speed", F.when(F.col("dt") > 0, F.col("dist") / F.col("dt")))


def dense_shots(samples: DataFrame, second: int, width: int, cfg: DenseConfig = DenseConfig()) -> DataFrame:
    """Motion runs of each identity with their outcome: shot, typed rejection or unresolved."""
    i = cut_lineage(intervals(samples, second, width))  # read by the motion and the rest islands
    near = F.col("dt") <= cfg.max_gap_s
    hot = gap_islands(i.filter(near & (F.col("speed") > cfg.motion_speed)), TRACK, "idx", 1, 4096, name="run")
    runs = hot.groupBy(*TRACK, "run").agg(
        F.count(F.lit(1)).alias("intervals"), F.max("speed").alias("peak_speed"), F.sum("dist").alias("path"),
        F.min(F.struct("idx", "prev_event_id", "prev_us", "prev_x", "prev_y")).alias("a"), F.max(F.struct("idx", "us", "x", "y")).alias("b"))
    still = gap_islands(i.filter(near & (F.col("speed") <= cfg.rest_speed)), TRACK, "idx", 1, 4096, name="rest")
    rests = still.groupBy(*TRACK, "rest").agg(F.count(F.lit(1)).alias("n_rest"), F.max("idx").alias("_end"), F.min("prev_us").alias("_r0"), F.max("us").alias("_r1"))
    r = runs.withColumn("_end", F.col("run") - 1).join(rests.drop("rest"), [*TRACK, "_end"], "left")
    net = F.hypot(F.col("b.x") - F.col("a.prev_x"), F.col("b.y") - F.col("a.prev_y"))
    r = r.withColumn("net", net).withColumn("n_rest", F.coalesce("n_rest", F.lit(0))).withColumn("rest_s", F.coalesce((F.col("_r1") - F.col("_r0")) / float(second), F.lit(0.0)))
    outcome = (F.when(F.col("intervals") < cfg.onset_intervals, "motion_too_short").when(F.col("net") <= cfg.min_net_px - cfg.net_error_px, "oscillation_no_net_travel")
               .when(F.col("net") <= cfg.min_net_px + cfg.net_error_px, "oscillation_unresolved")
               .when((F.col("rest_s") + 1e-12 < cfg.rest_window_s) | (F.col("n_rest") < cfg.rest_min), "no_still_stretch").otherwise("shot"))
    return r.select(*TRACK, F.col("a.prev_event_id").alias("onset_id"), F.col("a.prev_us").alias("onset_us"), "intervals", "peak_speed", "path", "net", "n_rest", "rest_s", outcome.alias("outcome"))


def dense_pots(samples: DataFrame, membership: Column, until: DataFrame, occlusion: Column, second: int, width: int, in_frame: Column, in_cloth: Column,
               cfg: DenseConfig = DenseConfig()) -> DataFrame:
    """Every disappearance of an identity, internal or trailing, judged in order.

    ``until``: dataset, until_us (last time watched).  ``membership`` is the pocket STRUCT of a
    sample, ``occlusion`` its clear/occluded/silent status.
    """
    i = cut_lineage(intervals(samples, second, width))  # read by the cadence, the next sample and the verdict
    cadence = exact_quantiles(i, TRACK, "dt", {"cadence": 0.5}).select(*TRACK, "cadence")
    nxt = i.select(*TRACK, (F.col("idx") - 1).alias("idx"), F.col("us").alias("next_us"))
    s = i.join(nxt, [*TRACK, "idx"], "left").join(cadence, list(TRACK), "left").join(until, "dataset")
    internal = F.col("next_us").isNotNull()
    gap = F.when(internal, F.col("next_us") - F.col("us")).otherwise(F.col("until_us") - F.col("us")) / float(second)
    bar = F.greatest(F.lit(cfg.vanish_min_s), F.lit(cfg.vanish_cadence) * F.coalesce("cadence", F.lit(0.0)))
    s = s.withColumn("internal", internal).withColumn("gap_s", gap).filter(F.col("gap_s") >= bar).withColumn("m", membership).withColumn("occ", occlusion)
    inside, vague = F.col("m.verdict") == "inside", F.col("m.verdict") == "ambiguous"
    s = s.withColumn("swap", F.col("internal") & inside & (F.col("gap_s") >= cfg.persistence_s))
    swaps = s.filter("swap").groupBy(*TRACK).agg(F.lit(True).alias("swapped"))
    s = s.join(swaps, list(TRACK), "left").withColumn("swapped", F.coalesce("swapped", F.lit(False)))
    parked = F.coalesce("speed", F.lit(0.0)) <= cfg.rest_speed
    def out(status, reason):
        return F.struct(F.lit(status).alias("status"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    blocked = F.when(F.col("occ") == "occluded", "cloth_occluded_at_disappearance").when(F.col("occ") == "silent", "occlusion_channel_silent")
    verdict = (F.when(F.col("swap"), out("unknown", "reappeared_after_gap_inside_pocket")).when(F.col("internal"), out("rejected", "reappeared_after_gap"))
               .when(vague, out("unknown", F.coalesce(blocked, F.lit("pocket_distance_within_uncertainty"))))
               .when(~inside & ~in_frame, out("rejected", "left_frame_edge")).when(~inside & ~in_cloth, out("rejected", "left_cloth")).when(~inside, out("rejected", "disappeared_outside_pocket"))
               .when(F.col("gap_s") < cfg.persistence_s, out("unknown", "no_persistence_window")).when(blocked.isNotNull(), out("unknown", blocked))
               .when(parked, out("unknown", "at_rest_inside_pocket_radius")).when(F.col("swapped"), out("unknown", "prior_identity_swap_inside_pocket"))
               .otherwise(out("pot", "inside_pocket_persistence_clear")))
    return s.withColumn("v", verdict).select(*TRACK, "event_id", "us", "gap_s", "internal", F.col("m.pocket").alias("pocket"), "v.status", "v.reason")


def dense_queue(shots: DataFrame, pots: DataFrame) -> DataFrame:
    """Served rows with their channel; only clear outcomes are served."""
    a = shots.filter("outcome = 'shot'").select("dataset", "track_id", F.col("onset_id").alias("event_id"), F.col("onset_us").alias("us"), F.lit("shot").alias("kind"), F.lit("dense_motion").alias("origin"))
    b = pots.filter("status = 'pot'").select("dataset", "track_id", "event_id", "us", F.lit("pot").alias("kind"), F.lit("dense_vanish").alias("origin"))
    return a.unionByName(b)


def gate_ledger(shots: DataFrame, pots: DataFrame) -> DataFrame:
    """What is not served and why; rejected, unresolved and unknown stay apart."""
    state = F.when(F.col("outcome") == "oscillation_unresolved", "unresolved").otherwise("rejected")
    a = shots.filter("outcome <> 'shot'").select(F.lit("shot").alias("kind"), state.alias("status"), F.col("outcome").alias("reason"))
    b = pots.filter("status <> 'pot'").select(F.lit("pot").alias("kind"), "status", "reason")
    return a.unionByName(b).groupBy("kind", "status", "reason").agg(F.count(F.lit(1)).alias("n"))
