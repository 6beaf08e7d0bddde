"""Calibration: segment lookup, fallback chain, re-projection and map comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

# Five-by-five grid and the three bands of the table's length.
GRID = 5
REGION_BANDS = (("head", 0.0, 400.0), ("middle", 400.0, 2140.0), ("foot", 2140.0, 2541.0))


def resolve_segment(df: DataFrame, segments: DataFrame, keys: Sequence[str] = ("dataset",), t: str = "t") -> DataFrame:
    """First segment that holds t; else the nearest edge, flagged; no time -> the first segment.

    Segments of one recording are packed into one small array and joined by recording, so
    no event is ever shuffled by id and no (event, segment) pair is emitted.
    """
    cols = [c for c in segments.columns if c not in keys]
    fields = F.struct("t_start", "t_end", *[c for c in cols if c not in ("t_start", "t_end")])
    packed = segments.groupBy(*keys).agg(F.array_sort(F.collect_list(fields)).alias("_segs"))
    at = F.col(t)
    inside = F.filter("_segs", lambda s: (s["t_start"] <= at) & (at <= s["t_end"]))
    ranked = F.array_min(F.transform("_segs", lambda s, i: F.struct(
        F.least(F.abs(at - s["t_start"]), F.abs(at - s["t_end"])).alias("d"), i.alias("i"))))
    pick = (F.when(at.isNull(), F.col("_segs")[0]).when(F.size(inside) > 0, F.get(inside, F.lit(0)))
            .otherwise(F.col("_segs")[ranked["i"]]))
    return (
        df.join(packed, list(keys), "left")
        .withColumn("segment", pick)
        .withColumn("clamped", F.col("segment").isNotNull() & (at.isNull() | (F.size(inside) == 0)))
        .withColumn("clamp_reason", F.when(F.col("segment").isNull(), None).when(at.isNull(), "no_time")
                    .when(F.size(inside) == 0, "outside_all_segments"))
        .drop("_segs")
    )


def project_detections(df: DataFrame, segments: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Pixels to millimetres through the map of the segment that owns the time."""
    return resolve_segment(df, segments.withColumn("h", G.homography(F.col("quad")))).withColumn("mm", G.project(F.col("segment.h"), F.col(x), F.col(y)))


def event_geometry(events: DataFrame, segments: DataFrame, mm_cols: Sequence[str]) -> DataFrame:
    """Additive ``<name>_px`` for each millimetre point that really projects."""
    out = resolve_segment(events, segments.withColumn("ih", G.inverse_homography(F.col("quad"))))
    for c in mm_cols:
        px = G.project(F.col("segment.ih"), F.col(f"{c}.x"), F.col(f"{c}.y"), G.PIXEL_HORIZON)
        far = F.greatest(F.abs(px["x"]), F.abs(px["y"])) > 1e6
        out = out.withColumn(c.replace("_mm", "") + "_px", F.when(~far, px))
    return out


def resolve_reference(df: DataFrame, kinds: Sequence[tuple[str, Column]], width: float, height: float) -> DataFrame:
    """Fallback chain over candidate quads; the first that fits the frame wins.

    Candidates before the winner that do not fit are listed in ``rejected`` in order.
    """
    def fits(q):
        pts = G.corners(q)
        ok = F.lit(True)
        for px, py in pts:
            ok = ok & (px >= 0) & (px <= width) & (py >= 0) & (py <= height)
        return ok
    entries = F.array(*[
        F.struct(F.lit(k).alias("kind"), q.alias("quad"), F.when(q.isNotNull(), fits(q)).alias("fit")) for k, q in kinds
    ])
    pos = F.array_position(F.transform(entries, lambda e: F.coalesce(e["fit"], F.lit(False))), True)
    before = F.when(pos > 0, F.slice(entries, F.lit(1), (pos - 1).cast("int"))).otherwise(entries)
    return (
        df.withColumn("reference_kind", F.when(pos > 0, entries[(pos - 1).cast("int")]["kind"]).otherwise("none"))
        .withColumn("reference_quad", F.when(pos > 0, entries[(pos - 1).cast("int")]["quad"]))
        .withColumn("rejected", F.transform(F.filter(before, lambda e: e["fit"] == F.lit(False)), lambda e: e["kind"]))
    )


def reproject(events: DataFrame, old_h: Column, new_h: Column, x: Column, y: Column) -> DataFrame:
    """Same pixels through a corrected map: keep ids, report both positions and the shift."""
    both = events.withColumn("old_mm", G.project(old_h, x, y)).withColumn("new_mm", G.project(new_h, x, y))
    return both.withColumn("shift_mm", G.distance(F.col("old_mm.x"), F.col("old_mm.y"), F.col("new_mm.x"), F.col("new_mm.y")))


def grid_points() -> Column:
    """ARRAY of the grid plus the pockets that are not grid corners."""
    pts, seen = [], set()
    for i in range(GRID):
        for j in range(GRID):
            p = (G.TABLE_W * i / (GRID - 1), G.TABLE_H * j / (GRID - 1))
            seen.add(p)
            pts.append(p)
    pts += [(px, py) for _, px, py in G.POCKETS if (px, py) not in seen]
    return F.array(*[G.point(px, py) for px, py in pts])


def region_of(y: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, lo, hi in reversed(REGION_BANDS):
        out = F.when((y >= lo) & (y < hi), name).otherwise(out)
    return F.coalesce(out, F.lit("outside"))


def map_disagreement(maps: DataFrame, by: Sequence[str], quad_a: str = "quad_a", quad_b: str = "quad_b") -> DataFrame:
    """Where two maps of one recording put the same table points, by region."""
    maps = maps.withColumns({"_ia": G.inverse_homography(F.col(quad_a)), "_ib": G.inverse_homography(F.col(quad_b)),
                             "_ha": G.homography(F.col(quad_a))})
    pts = maps.withColumn("p", F.explode(grid_points()))
    rows = pts.withColumn("pa", G.project(F.col("_ia"), F.col("p.x"), F.col("p.y"))).withColumn(
        "pb", G.project(F.col("_ib"), F.col("p.x"), F.col("p.y"))).filter("pa is not null and pb is not null")
    back = G.project(F.col("_ha"), F.col("pb.x"), F.col("pb.y"))
    rows = rows.withColumn("region", region_of(F.col("p.y"))).withColumn("back", back).select(
        *by, "region", G.distance(F.col("pa.x"), F.col("pa.y"), F.col("pb.x"), F.col("pb.y")).alias("d_px"),
        G.distance(F.col("back.x"), F.col("back.y"), F.col("p.x"), F.col("p.y")).alias("off_mm"))
    # at most 27 grid points per (map pair, region): the exact built-in percentile is bounded
    return rows.groupBy(*by, "region").agg(
        F.count(F.lit(1)).alias("n"), F.percentile("d_px", 0.5).alias("d_px_median"), F.max("d_px").alias("d_px_max"),
        F.percentile("off_mm", 0.5).alias("off_mm_median"), F.percentile("off_mm", 0.95).alias("off_mm_p95"),
        F.max("off_mm").alias("off_mm_max"))


def cause_of(coverage: Column, desaturated: Column, v: Column, gate: float = 0.80) -> Column:
    """Why the coverage proxy dropped; a missing reading never fires its rule."""
    return (F.when(F.coalesce(coverage, F.lit(1.0)) >= gate, "coverage_above_gate")
            .when(desaturated >= 0.05, "occlusion_and_shading").when(v < 150, "shading_not_framing")
            .otherwise("mask_instability_not_framing"))


def framing_test(offsets: Column, shift: Column, move_px: float = 2.0, noise_px: float = 8.0) -> Column:
    """STRUCT<moved,reasons>: whole-frame shift, or four verified sides moved together."""
    s = F.array_sort(offsets)
    med = (s[1] + s[2]) / 2.0
    together = (F.size(offsets) == 4) & (F.abs(med) > noise_px) & F.forall(offsets, lambda v: F.abs(v - med) <= noise_px)
    reasons = F.array_compact(F.array(F.when(shift > move_px, "whole_frame_shift"),
                                      F.when(together, "rail_boundary_moved")))
    return F.struct((F.size(reasons) > 0).alias("moved"), reasons.alias("reasons"))
