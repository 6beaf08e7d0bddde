"""Dense signals: floors, baselines, onsets and windows around events.

Times are integer microseconds; a second of signal time is ``SECOND`` of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import fields_type, range_pairs
from .kernels import (bounded_lag, bucket_of, exact_quantiles, exact_ranks, gap_islands, in_intervals, merge_intervals, strongest_first,
                      ordered_index)
from ..session import cut_lineage
from .stats import FLOOR_MARGIN, array_median

OCC_DENSE_MIN, OCC_SHARE_MIN, FLOOR_QUANTILE = 0.30, 0.02, 0.999
DAY = 86_400_000_000


def limits(stats: DataFrame, floor: Column, contrast: float, ball_area: float, window_px: int) -> DataFrame:
    """Ceiling one ball can reach in the footprint window against the measured bar."""
    ceiling = F.lit(contrast * min(1.0, ball_area / float(window_px * window_px)))
    bar = floor * FLOOR_MARGIN
    return (stats.withColumn("floor", floor).withColumn("threshold", bar).withColumn("ceiling", ceiling)
            .withColumn("head_room", ceiling / F.nullif(bar, F.lit(0.0))).withColumn("saturated", bar >= ceiling))


def noise_floor(signal: DataFrame, controls: DataFrame, keys: Sequence[str], half: int, eligible: Column,
                width: int = DAY) -> DataFrame:
    """p99.9 of the eligible samples inside the merged control windows, and the bar over it."""
    windows = merge_intervals(controls.select(*keys, (F.col("at") - half).alias("w0"), (F.col("at") + half).alias("w1")),
                              keys, "w0", "w1", width)
    held = in_intervals(signal, windows, keys, "us", "w0", "w1", width).withColumn("_ok", eligible)
    sample = held.withColumn("_s", F.when(F.col("_ok"), F.col("signal")))
    q = exact_quantiles(sample, keys, "_s", {"median": 0.5, "p99": 0.99, "floor": FLOOR_QUANTILE})
    counts = held.groupBy(*keys).agg(F.count_if(~F.col("_ok")).alias("excluded"))
    spans = windows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_windows"))
    out = spans.join(counts, list(keys), "left").join(q, list(keys), "left").fillna(0, ["n", "excluded"])
    return out.withColumn("threshold", F.col("floor") * FLOOR_MARGIN)


def calibrate(signal: DataFrame, controls: DataFrame, keys: Sequence[str], half: int, eligible: Column,
              width: int = DAY) -> DataFrame:
    """Combined-control floor against the whole-scan floor; the stricter one sets the bar.

    Output per key: floors, threshold, control coverage and the rate of eligible control
    samples that still clear the bar.
    """
    windows = merge_intervals(controls.select(*keys, (F.col("at") - half).alias("w0"), (F.col("at") + half).alias("w1")),
                              keys, "w0", "w1", width)
    flagged = signal.withColumn("_ok", eligible)
    held = in_intervals(flagged, windows, keys, "us", "w0", "w1", width)
    clean = exact_quantiles(held.withColumn("_s", F.when(F.col("_ok"), F.col("signal"))), keys, "_s", {"q": FLOOR_QUANTILE}).select(*keys, F.col("q").alias("floor_controls"))
    whole = exact_quantiles(flagged.withColumn("_s", F.when(F.col("_ok"), F.col("signal"))), keys, "_s",
                            {"q": FLOOR_QUANTILE}).select(*keys, F.col("q").alias("floor_whole"))
    bars = signal.select(*keys).distinct().join(clean, list(keys), "left").join(whole, list(keys), "left").withColumn(
        "threshold", F.greatest(F.coalesce("floor_controls", F.lit(0.0)), F.coalesce("floor_whole", F.lit(0.0))) * FLOOR_MARGIN)
    total = signal.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"))
    inside = held.join(bars.select(*keys, "threshold"), list(keys)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("control_samples"), F.count_if("_ok").alias("control_eligible"),
        F.count_if(F.col("_ok") & (F.col("signal") >= F.col("threshold"))).alias("above"))
    out = bars.join(total, list(keys)).join(inside, list(keys), "left").fillna(0, ["control_samples", "control_eligible", "above"])
    return out.withColumn("share", F.col("control_samples") / F.col("samples")).withColumn(
        "false_rate", F.col("above") / F.greatest(F.lit(1), F.col("control_eligible")))


def quiet_windows(df: DataFrame, keys: Sequence[str], col: str, count: int = 20, quantile: float = 0.01, width: int = DAY) -> DataFrame:
    """Rows at or below the low quantile of an independent signal, strided to ``count``."""
    cut = exact_quantiles(df, keys, col, {"cut": quantile}).select(*keys, "cut")
    quiet = df.join(cut, list(keys)).filter(F.col(col) <= F.col("cut"))
    total = quiet.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / count))
    return ordered_index(quiet, keys, ["event_id"], "us", width, "_i").join(total, list(keys)).filter(
        (F.col("_i") % step == 0) & (F.col("_i") / step < count)).drop("_i", "_n", "cut")


def quiet_blocks(df: DataFrame, keys: Sequence[str], col: str, block: int, keep: int = 14) -> DataFrame:
    """Blocks from the first sample on, ranked by the p90 of an occlusion column; the quietest ``keep``."""
    edge = df.groupBy(*keys).agg(F.min("us").alias("t0"), F.max("us").alias("t1"))
    rows = df.join(edge, list(keys)).withColumn("block", F.floor((F.col("us") - F.col("t0")) / block)).filter(
        F.col("t0") + (F.col("block") + 1) * block <= F.col("t1"))
    p90 = rows.groupBy(*keys, "block").agg(F.percentile(col, 0.9).alias("p90"))
    w = W.partitionBy(*keys).orderBy("p90", "block")
    return p90.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def spread_controls(events: DataFrame, keys: Sequence[str], duration: int, count: int, margin: int, before: int, after: int,
                    width: int = DAY) -> DataFrame:
    """Evenly spread times clear of every event by more than ``margin``."""
    grid = events.select(*keys).distinct().withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(count)))).withColumn(
        "at", F.floor(F.lit(duration) * F.col("step") / (count + 1)).cast("long")).filter(
        (F.col("at") - before >= 0) & (F.col("at") + after <= duration))
    near = range_pairs(grid, events.select(*keys, F.col("us").alias("_e")), keys, "at", "_e", -margin, margin, width)
    return grid.join(near.select(*keys, "step").distinct(), [*keys, "step"], "left_anti")


def sample_step(indexed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median sampling interval per key, exact."""
    lagged = bounded_lag(indexed.select(*keys, "idx", "us"), keys, "idx", ["us"])
    gaps = lagged.withColumn("_d", F.col("us") - F.col("prev_us"))
    return exact_quantiles(gaps, keys, "_d", {"dt": 0.5}).select(*keys, "dt")


def rolling_baseline(indexed: DataFrame, keys: Sequence[str], window_s: int, block_s: int) -> DataFrame:
    """Block medians -> median of neighbouring blocks -> linear interpolation back to samples.

    ``indexed`` carries a dense ``idx``.  The last block is padded with the series median,
    edge blocks repeat the first and last full window, as in the block rule.
    """
    step = sample_step(indexed, keys)
    whole = exact_quantiles(indexed, keys, "signal", {"med": 0.5}).select(*keys, "med", F.col("n").alias("total"))
    shape = step.join(whole, list(keys)).withColumn(
        "block", F.greatest(F.lit(1), F.rint(F.lit(float(block_s)) / F.greatest(F.col("dt"), F.lit(1.0))).cast("long"))).withColumn(
        "nb", F.ceil(F.col("total") / F.col("block"))).withColumn(
        "half", F.rint(F.lit(float(window_s)) / F.greatest(F.lit(float(block_s)), F.col("dt"))).cast("long"))
    shape = cut_lineage(shape)  # one row per recording, read by five branches
    rows = indexed.join(shape, list(keys))
    values = rows.select(*keys, F.expr("idx div block").alias("blk"), "signal")
    pad = shape.filter("nb * block > total").withColumn("_p", F.explode(F.expr("sequence(total, nb * block - 1)"))).select(
        *keys, F.expr("_p div block").alias("blk"), F.col("med").alias("signal"))
    meds = values.unionByName(pad).groupBy(*keys, "blk").agg(F.percentile("signal", 0.5).alias("m")).join(
        shape.select(*keys, "nb", "half", "block"), list(keys))
    meds = cut_lineage(meds)  # one row per block
    reach = max(1, round(window_s / block_s))
    w = W.partitionBy(*keys).orderBy("blk").rowsBetween(-reach, reach)
    near = F.collect_list(F.struct("blk", "m")).over(w)
    full = meds.withColumn("_near", near).withColumn("_own", F.array_sort(F.transform(
        F.filter("_near", lambda e: F.abs(e["blk"] - F.col("blk")) <= F.col("half")), lambda e: e["m"])))
    flat = exact_quantiles(meds, keys, "m", {"all_m": 0.5}).select(*keys, "all_m")
    narrow = (F.col("half") == 0) | (F.col("nb") <= 2 * F.col("half"))
    inner = full.filter("blk >= half and blk < nb - half").select(*keys, F.col("blk").alias("src"), array_median(F.col("_own")).alias("s"))
    clamp = F.greatest(F.col("half"), F.least(F.col("blk"), F.col("nb") - 1 - F.col("half")))
    smooth = meds.join(flat, list(keys)).withColumn("src", clamp).join(inner, [*keys, "src"], "left").withColumn(
        "smooth", F.when(narrow, F.col("all_m")).otherwise(F.col("s"))).select(*keys, "blk", "smooth")
    nxt = smooth.select(*keys, (F.col("blk") - 1).alias("blk"), F.col("smooth").alias("ahead"))
    table = smooth.join(nxt, [*keys, "blk"], "left")
    pos = (F.col("idx") - (F.col("block") - 1) / 2.0) / F.col("block")
    at = rows.withColumn("_pos", F.greatest(F.lit(0.0), F.least(pos, F.col("nb") - 1.0))).withColumn("blk", F.floor("_pos"))
    out = at.join(table, [*keys, "blk"]).withColumn(
        "baseline", F.col("smooth") + F.coalesce((F.col("ahead") - F.col("smooth")) * (F.col("_pos") - F.col("blk")), F.lit(0.0)))
    return out.drop("blk", "_pos", "smooth", "ahead", "block", "nb", "half", "med", "total")


def detect_onsets(indexed: DataFrame, keys: Sequence[str], threshold: float, merge: int) -> DataFrame:
    """Runs at or above the bar; runs whose index gap is within the merge gap are one onset.

    ``indexed`` carries ``idx``, ``us``, ``signal`` and the sampling step ``dt``.
    """
    gap = F.greatest(F.lit(1), F.rint(F.lit(float(merge)) / F.greatest(F.col("dt"), F.lit(1.0))).cast("long"))
    hot = indexed.filter(F.col("signal") >= threshold).withColumn("_gap", gap)
    runs = gap_islands(hot, keys, "idx", F.col("_gap"), 4096, name="first_idx")
    out = runs.groupBy(*keys, "first_idx").agg(
        F.min("us").alias("onset_us"), F.max("us").alias("last_us"), F.max("idx").alias("last_idx"),
        F.max(F.struct("signal", (-F.col("idx")).alias("k"), "us")).alias("pk"),
        F.min(F.struct("idx", "baseline") if "baseline" in indexed.columns else F.struct("idx")).alias("_first"))
    out = out.withColumn("peak", F.col("pk.signal")).withColumn("peak_us", F.col("pk.us")).withColumn(
        "n_frames", F.col("last_idx") - F.col("first_idx") + 1).withColumn("active_us", F.col("last_us") - F.col("onset_us")).withColumn(
        "excess", F.col("peak") / F.lit(threshold))
    if "baseline" in indexed.columns:
        out = out.withColumn("baseline", F.col("_first.baseline"))
    return out.drop("pk", "_first", "last_us")


def enforce_gap(onsets: DataFrame, keys: Sequence[str], min_gap: int, width: int = DAY) -> DataFrame:
    """Strongest peak per neighbourhood: peaks closer than ``min_gap`` exclude each other, ties go to the earlier onset."""
    order = F.struct((-F.col("peak")).alias("k"), "onset_us", "peak_us")
    rows = cut_lineage(onsets.select(*keys, "onset_us", "peak_us", "peak", "n_frames", order.alias("order"), F.to_json(F.struct(*keys, "onset_us", "peak_us")).alias("weak")))
    other = rows.select(*keys, F.col("peak_us").alias("s_us"), F.col("weak").alias("strong"), F.col("order").alias("s_order"))
    pairs = range_pairs(rows, other, keys, "peak_us", "s_us", 1 - min_gap, min_gap - 1, max(width, min_gap)).filter(F.col("s_order") < F.col("order"))
    return rows.join(strongest_first(pairs, keys), "weak", "left_anti").select(*keys, "onset_us", "peak_us", "peak", "n_frames")


def decay_shape(onsets: DataFrame, signal: DataFrame, keys: Sequence[str], window: int, second: int, width: int = DAY,
                floor_frac: float = 0.25) -> DataFrame:
    """How the motion after an onset ends: half time, active time, share of falling steps."""
    s = signal.select(*keys, F.col("us").alias("s_us"), F.col("signal").alias("s_v"))
    pairs = range_pairs(s, onsets, keys, "s_us", "onset_us", 0, window, width)
    seg = pairs.groupBy(*keys, "onset_us").agg(F.array_sort(F.collect_list(F.struct("s_us", "s_v"))).alias("_s"))
    seg = seg.withColumn("n", F.size("_s")).withColumn("_v", F.transform("_s", lambda e: e["s_v"])).withColumn("peak", F.array_max("_v"))
    seg = seg.withColumn("_tail", F.expr("slice(_s, cast(array_position(_v, peak) as int), size(_s))"))
    half = F.get(F.filter("_tail", lambda e: e["s_v"] <= F.col("peak") / 2.0), F.lit(0))["s_us"]
    end = F.get(F.filter("_tail", lambda e: e["s_v"] <= F.lit(floor_frac) * F.col("peak")), F.lit(0))["s_us"]
    seg = seg.withColumn("half_s", (half - F.col("onset_us")) / float(second)).withColumn("_end", end).withColumn(
        "active_s", (F.col("_end") - F.col("onset_us")) / float(second))
    upto = F.when(F.col("_end").isNull(), F.size("_tail")).otherwise(F.size(F.filter("_tail", lambda e: e["s_us"] <= F.col("_end"))))
    seg = seg.withColumn("_cut", F.slice("_tail", F.lit(1), upto))
    falls = F.expr("size(filter(transform(_cut, (e, i) -> i > 0 and e.s_v < _cut[i-1].s_v), b -> b))")
    seg = seg.withColumn("monotone", falls / F.greatest(F.lit(1), F.size("_cut") - 1))
    def level(offset):
        ask = F.col("onset_us") + int(offset * second)
        return F.array_min(F.transform("_s", lambda e: F.struct(F.abs(e["s_us"] - ask).alias("d"), e["s_us"].alias("u"), e["s_v"].alias("v"))))["v"]
    verdict = (F.when(F.col("n") < 3, "no data").when(F.col("active_s").isNull(), "persists").when(F.col("active_s") <= 0.25, "spike")
               .when(F.col("monotone") >= 0.6, "decays").otherwise("ends unevenly"))
    return seg.select(*keys, "onset_us", "n", "peak", "half_s", "active_s", "monotone", level(0.5).alias("level_05"),
                      level(1.0).alias("level_10"), verdict.alias("verdict"))


def bracket(left: DataFrame, right: DataFrame, keys: Sequence[str], pos: str, payload: Sequence[str], width: int = DAY) -> DataFrame:
    """Left rows with ``prev`` (last right row strictly before) and ``next`` (first at or after)."""
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
    return both.join(carry, [*keys, "_b"]).withColumn(
        "prev", F.coalesce(F.max("_r").over(local.rangeBetween(W.unboundedPreceding, -1)), F.col("_cp"))).withColumn(
        "next", F.coalesce(F.min("_r").over(local.rangeBetween(0, W.unboundedFollowing)), F.col("_cn"))).filter(
        "_left").drop("_left", "_r", "_b", "_cp", "_cn")


def window_profile(events: DataFrame, signal: DataFrame, keys: Sequence[str], event_id: str, floor: Column, second: int,
                   before: float = 1.5, after: float = 2.5, hz: int = 10, at_tol: float = 0.5) -> DataFrame:
    """Grid around an event sampled by the *next* sample (the last one past the end)."""
    steps = F.array(*[F.lit(int(round((k / hz - before) * second))) for k in range(int(round((before + after) * hz)) + 1)])
    grid = events.select(*keys, event_id, F.col("us").alias("_t0"), F.posexplode(steps).alias("_k", "_off")).withColumn(
        "us", F.col("_t0") + F.col("_off"))
    seen = bracket(grid, signal.select(*keys, "us", "signal"), keys, "us", ["signal"])
    v = F.coalesce("next.signal", "prev.signal")
    prof = seen.withColumn("_v", v).groupBy(*keys, event_id).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("_v", (-F.col("_k")).alias("k"), "_off")).alias("_pk"),
        F.percentile("_v", 0.5).alias("median"))
    off = F.col("_pk._off") / float(second)
    verdict = F.when(F.col("_pk._v") < floor, "none").when(F.abs(off) <= at_tol, "at").otherwise("elsewhere")
    return prof.select(*keys, event_id, "n", F.col("_pk._v").alias("peak"), "median", off.alias("peak_offset_s"), verdict.alias("verdict"))


def peak_in_window(events: DataFrame, signal: DataFrame, keys: Sequence[str], event_id: str, cols: Sequence[str], second: int,
                   before: float, after: float, width: int = DAY) -> DataFrame:
    """Raw peak, median and offset of each column inside [t-before, t+after]."""
    s = signal.select(*keys, F.col("us").alias("_s"), *cols)
    e = events.select(*keys, event_id, "us")
    pairs = range_pairs(s, e, keys, "_s", "us", -int(before * second), int(after * second), width)
    aggs = [F.count(F.lit(1)).alias("n"), F.first("us").alias("us")]
    for c in cols:
        aggs += [F.max(F.struct(F.col(c).alias("v"), (-F.col("_s")).alias("k"))).alias(f"_{c}"), F.percentile(c, 0.5).alias(f"{c}_median")]
    got = pairs.groupBy(*keys, event_id).agg(*aggs)
    full = e.select(*keys, event_id).join(got, [*keys, event_id], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.select(*keys, event_id, "n", *[x for c in cols for x in (
        F.col(f"_{c}.v").alias(f"{c}_peak"), F.col(f"{c}_median"), ((-F.col(f"_{c}.k") - F.col("us")) / float(second)).alias(f"{c}_offset_s"))])


def classify_timing(peak: Column, offset: Column, floor: Column, ratio: float = 3.0, absolute: float = 3.0, at: float = 0.5) -> Column:
    """Three-way verdict of a motion peak; a missing peak is ``no frames``."""
    bar = F.greatest(F.coalesce(floor, F.lit(0.0)) * ratio, F.lit(absolute))
    return (F.when(peak.isNull(), "no frames decoded").when(peak < bar, "no motion anywhere in window")
            .when(F.abs(offset) <= at, "motion at the served time").otherwise("motion elsewhere in window"))


def ball_scale_verdict(peak: Column, offset: Column, floor: Column, ratio: float = 1.5, absolute: float = 60.0, at: float = 0.5) -> Column:
    """The ball-scale twin: not separable when the floor itself reaches the absolute bar."""
    bar = F.greatest(F.coalesce(floor, F.lit(0.0)) * ratio, F.lit(absolute))
    return (F.when(floor >= absolute, "not separable from controls").when(peak.isNull() | (peak < bar), "no ball-scale motion")
            .when(F.abs(offset) <= at, "at the served time").otherwise("elsewhere in window"))


def combined_verdict(ball: Column, occluded: Column, offset: Column, at: float = 0.5) -> Column:
    far = offset.isNotNull() & (F.abs(offset) > at)
    return (F.when(occluded & far, "occlusion-explained elsewhere").when(occluded, "occlusion-explained at t")
            .when(ball == "at", "ball-scale motion at t").when(ball == "elsewhere", "ball-scale motion elsewhere")
            .otherwise("no motion separable"))


def group_onsets(shots: DataFrame, keys: Sequence[str], window: int, width: int = DAY, break_min: int = 3) -> DataFrame:
    """Chain onsets within the window; a group of three or more is a break."""
    g = gap_islands(shots, keys, "us", window, width, ["event_id"], "group_us")
    size = g.groupBy(*keys, "group_us").agg(F.count(F.lit(1)).alias("members"))
    return g.join(size, [*keys, "group_us"]).withColumn("is_break", F.col("members") >= break_min).drop("opens")


def footprint_split(pairs: DataFrame, by: Sequence[str], peak: Column, change: Column, at: Column, limit: float = 0.02) -> DataFrame:
    """Strongest reading among the pairs whose changed share stays under the cap."""
    ok = (change <= limit) & peak.isNotNull()
    best = F.max(F.when(ok, F.struct(peak.alias("peak"), (-at).alias("k"), change.alias("change")))).alias("b")
    return pairs.groupBy(*by).agg(best, F.count_if(ok).alias("pairs"), F.avg(F.when(ok, peak)).alias("mean")).select(
        *by, "pairs", F.col("b.peak").alias("peak"), F.col("b.change").alias("change"), (-F.col("b.k")).alias("at"), "mean")


def drift(indexed: DataFrame, keys: Sequence[str], fps: float, step: int, second: int) -> DataFrame:
    """Real time minus index/fps on every step-th frame: largest magnitude and the last one."""
    edge = indexed.groupBy(*keys).agg(F.max("idx").alias("_last"), F.min("us").alias("_t0"))
    rows = indexed.join(edge, list(keys)).filter((F.col("idx") % step == 0) | (F.col("idx") == F.col("_last"))).withColumn(
        "drift", (F.col("us") - F.col("_t0")) / float(second) - F.col("idx") / float(fps))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.max(F.abs("drift")).alias("max_abs_drift_s"),
                                   F.max_by("drift", "idx").alias("last_drift_s"))
