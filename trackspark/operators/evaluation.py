"""Scoring predictions, detectors and association against human labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as P
from .joins import near_pairs, range_pairs
from .kernels import bounded_lag, exact_quantiles, exact_ranks, gap_islands, ordered_index

THRESHOLDS = [round(0.05 + 0.025 * i, 3) for i in range(38)]


def thresholds_col(values: Sequence[float] = THRESHOLDS) -> Column:
    return F.array(*[F.lit(v) for v in values])


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Long confusion counts with the share and rank of each prediction inside its class."""
    c = df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("truth")
    return c.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "pred")).cast("long"))


def accuracy(conf: DataFrame) -> DataFrame:
    return conf.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n"))), F.lit(0)).alias("correct"))


def pr_sweep(pred: DataFrame, matched: DataFrame, truth_count: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Precision / recall / F1 and localisation error at every threshold.

    Predictions are matched in score order, so the matching at a threshold is the prefix of
    one full matching: the data is matched once and never multiplied by the thresholds.
    """
    ts = thresholds_col(thresholds)
    def levels(df):
        return df.withColumn("threshold", F.explode(F.filter(ts, lambda t: F.col("score") >= t)))
    # integer histogram of scores first: the fan-out runs over distinct scores, not rows
    n_pred = levels(pred.groupBy("score").agg(F.count(F.lit(1)).alias("c"))).groupBy("threshold").agg(F.sum("c").alias("n_pred"))
    hit = levels(matched.select("score", F.sqrt(F.col("d2").cast("double")).alias("err")))
    q = exact_quantiles(hit, ["threshold"], "err", {"err_p50": 0.5, "err_p90": 0.9}).select("threshold", F.col("n").alias("tp"), "err_p50", "err_p90")
    out = n_pred.join(q, "threshold", "left").withColumn("tp", F.coalesce("tp", F.lit(0))).crossJoin(truth_count)
    out = out.withColumn("fp", F.col("n_pred") - F.col("tp")).withColumn("fn", F.col("n_truth") - F.col("tp"))
    p, r = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp")), F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn"))
    out = out.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)))
    return out.withColumn("f1", f1).select("threshold", "tp", "fp", "fn", "precision", "recall", "f1", "err_p50", "err_p90")


def operating_point(sweep: DataFrame, bar: float = 4.0) -> DataFrame:
    """Best F1 whose p90 error clears the bar, and best F1 overall; the lower threshold on a tie."""
    key = F.struct(F.round("f1", 3).alias("f"), (-F.col("threshold")).alias("t"))
    return sweep.agg(F.max_by("threshold", F.when(F.col("err_p90") <= bar, key)).alias("operating"), F.max_by("threshold", key).alias("best_f1"),
                     F.max(F.when(F.col("err_p90") <= bar, F.round("f1", 3))).alias("operating_f1"))


def leftovers(side: DataFrame, matched: DataFrame, col: str) -> DataFrame:
    return side.join(matched.select(F.col(col).alias("id")), "id", "left_anti")


def disagreement(misses: DataFrame, extras: DataFrame, edge: Column, edge_px: float = 25.0) -> DataFrame:
    """What the missed labels and the extra detections look like."""
    m = misses.withColumn("side", F.lit("fn")).unionByName(extras.withColumn("side", F.lit("fp"))).withColumn("edge", edge)
    med = exact_quantiles(m, ["side"], "score", {"score_median": 0.5}).select("side", "score_median", F.col("min").alias("score_min"))
    ed = exact_quantiles(m.withColumn("_e", F.abs("edge")), ["side"], "_e", {"edge_median": 0.5}).select("side", "edge_median")
    c = m.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("edge") > 0).alias("inside"), F.count_if(F.abs("edge") <= edge_px).alias("near_edge"))
    return c.join(med, "side").join(ed, "side")


def mode_agreement(a: DataFrame, b: DataFrame, matched: DataFrame, keys: Sequence[str] = ("dataset", "frame_no")) -> DataFrame:
    """Per frame: equal counts, and every instance matched."""
    ca, cb = (d.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for d, n in ((a, "count_a"), (b, "count_b")))
    m = matched.groupBy(*keys).agg(F.count(F.lit(1)).alias("matched"), F.max("d2").alias("max_d2"))
    out = ca.join(cb, list(keys), "full").join(m, list(keys), "left").fillna(0, ["count_a", "count_b", "matched"])
    return out.withColumn("counts_agree", F.col("count_a") == F.col("count_b")).withColumn("full", (F.col("count_a") == F.col("count_b")) & (F.col("matched") == F.col("count_a")))


def recovery(misses: DataFrame, peaks: DataFrame, tol: int, thresholds: Sequence[float], keys: Sequence[str] = ("dataset", "frame_no")) -> DataFrame:
    """(missed label, threshold, squared distance) for every threshold whose peaks bring the label back."""
    m = misses.select(*keys, F.col("id").alias("fn_id"), F.col("x").alias("mx"), F.col("y").alias("my"))
    p = peaks.select(*keys, "score", F.col("x").alias("px"), F.col("y").alias("py"))
    near = near_pairs(m, p, keys, tol, ("mx", "my"), ("px", "py")).groupBy("fn_id", "score").agg(F.min("d2").alias("d2"))
    lv = near.withColumn("threshold", F.explode(F.filter(thresholds_col(thresholds), lambda t: F.col("score") >= t)))
    return lv.groupBy("fn_id", "threshold").agg(F.min("d2").alias("d2"))


def recovery_by_threshold(rec: DataFrame) -> DataFrame:
    """Recovered labels per threshold with nearest-rank localisation errors."""
    def rank(q):
        return lambda n: F.greatest(F.lit(0), F.least(n - 1, F.ceil(F.lit(q) * n) - 1))
    r = exact_ranks(rec.withColumn("err", F.sqrt(F.col("d2").cast("double"))), ["threshold"], "err", {"err_p50": rank(0.5), "err_p90": rank(0.9)})
    return r.select("threshold", F.col("n").alias("recovered"), "err_p50", "err_p90")


def adjudicate(cases: DataFrame, instances: DataFrame, measured: DataFrame, radius: int = 10, keys: Sequence[str] = ("dataset", "frame_no")) -> DataFrame:
    """recall / hallucination / unresolved; silence is never read as a hallucination."""
    c = cases.select(*keys, F.col("id").alias("case_id"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    i = instances.select(*keys, F.col("id").alias("inst_id"), "score", "gate", F.col("x").alias("ix"), F.col("y").alias("iy"))
    near = near_pairs(c, i, keys, radius, ("cx", "cy"), ("ix", "iy"))
    above = F.col("score") >= P.SWEEP[0]
    got = near.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("near"), F.count_if(above).alias("above"),
        F.min(F.when(above & (F.col("gate") == "admitted"), F.struct("d2", "inst_id", "score"))).alias("best"))
    seen = measured.select(*keys).distinct().withColumn("_m", F.lit(True))
    out = c.join(got, "case_id", "left").join(seen, list(keys), "left").withColumn("measured", F.coalesce("_m", F.lit(False))).withColumn("near", F.coalesce("near", F.lit(0)))
    found = F.col("best").isNotNull()
    verdict = (F.when(~F.col("measured"), "unresolved").when(found, "teacher_recall").when(F.col("near") > 0, "unresolved").otherwise("student_hallucination"))
    reason = (F.when(~F.col("measured"), "frame_not_measured").when(found & (F.col("best.score") >= P.SCORE_CUT), "instance_at_or_above_production_cut").when(found, "instance_below_production_cut")
              .when(F.col("near") == 0, "no_instance_within_radius_at_any_threshold").when(F.col("above") > 0, "instance_present_but_failed_gate").otherwise("only_instances_below_the_lowest_sweep_threshold"))
    return out.select("case_id", "near", verdict.alias("verdict"), reason.alias("reason"), F.col("best.inst_id").alias("inst_id"),
                      F.size(F.filter(F.array(*[F.lit(v) for v in P.SWEEP]), lambda t: F.col("best.score") >= t)).alias("_levels")).withColumn(
        "levels", F.when(F.col("inst_id").isNotNull(), F.col("_levels").cast("long"))).drop("_levels")


def headline(adjudicated: DataFrame, missed: DataFrame, rec: DataFrame, cut: float = 0.425) -> DataFrame:
    """The counts a reader acts on."""
    v = adjudicated.agg(F.count(F.lit(1)).alias("fp_total"), F.count_if(F.col("verdict") == "teacher_recall").alias("recall"), F.count_if(F.col("reason") == "instance_below_production_cut").alias("recall_below_cut"),
                        F.count_if(F.col("verdict") == "student_hallucination").alias("hallucination"), F.count_if(F.col("verdict") == "unresolved").alias("unresolved"))
    f = missed.agg(F.count(F.lit(1)).alias("fn_total"))
    r = rec.agg(F.countDistinct("fn_id").alias("fn_recovered_best"), F.countDistinct(F.when(F.col("threshold") == cut, F.col("fn_id"))).alias("fn_recovered_at_cut"))
    return v.crossJoin(f).crossJoin(r)


def fragments(obs: DataFrame, gap: int, width: int, keys: Sequence[str] = ("dataset", "track_id")) -> DataFrame:
    """Stretches of an identity without a hole longer than ``gap``, with head, tail and tail velocity."""
    i = gap_islands(obs.select(*keys, "us", "event_id", "color", "x", "y"), keys, "us", gap, width, ["event_id"], "start_us").drop("opens")
    p = F.struct("us", "event_id", "color", "x", "y")
    tails = i.groupBy(*keys, "start_us").agg(F.count(F.lit(1)).alias("hits"), F.min(p).alias("head"), F.max(p).alias("tail"))
    before = i.join(tails.select(*keys, "start_us", F.col("tail.event_id").alias("_last")), [*keys, "start_us"]).filter("event_id <> _last").groupBy(*keys, "start_us").agg(F.max(F.struct("us", "event_id", "x", "y")).alias("prev"))
    return tails.join(before, [*keys, "start_us"], "left")


def fragment_pairs(frags: DataFrame, bound: int, width: int, second: int, max_px: float = 600.0) -> DataFrame:
    """End of one identity -> start of another, 0 < gap <= bound, with the constant-velocity residual."""
    dt = (F.col("tail.us") - F.col("prev.us")) / float(second)
    vx, vy = F.coalesce((F.col("tail.x") - F.col("prev.x")) / dt, F.lit(0.0)), F.coalesce((F.col("tail.y") - F.col("prev.y")) / dt, F.lit(0.0))
    e = frags.select("dataset", F.col("tail.event_id").alias("end_id"), F.col("track_id").alias("end_track"), F.col("tail.us").alias("end_us"), F.col("tail.color").alias("end_color"),
                     F.col("tail.x").alias("ex"), F.col("tail.y").alias("ey"), vx.alias("vx"), vy.alias("vy"))
    s = frags.select("dataset", F.col("head.event_id").alias("start_id"), F.col("track_id").alias("start_track"), F.col("head.us").alias("s_us"), F.col("head.color").alias("start_color"), F.col("head.x").alias("sx"), F.col("head.y").alias("sy"))
    j = range_pairs(s, e, ["dataset"], "s_us", "end_us", 1, bound, width).filter("start_track <> end_track")
    gap = (F.col("s_us") - F.col("end_us")) / float(second)
    j = j.withColumn("gap_s", gap).withColumn("d", F.hypot(F.col("sx") - F.col("ex"), F.col("sy") - F.col("ey"))).filter(F.col("d") <= max_px)
    return j.withColumn("residual", F.hypot(F.col("ex") + F.col("vx") * F.col("gap_s") - F.col("sx"), F.col("ey") + F.col("vy") * F.col("gap_s") - F.col("sy"))).withColumn("same_color", F.col("end_color") == F.col("start_color"))


def residual_summary(pairs: DataFrame) -> DataFrame:
    def rank(q):
        return lambda n: F.least(n - 1, F.rint(F.lit(q) * (n - 1)).cast("long"))
    return exact_ranks(pairs, ["same_color"], "residual", {"p50": rank(0.5), "p90": rank(0.9), "p99": rank(0.99)}).select("same_color", "n", "p50", "p90", "p99")


def fragment_links(pairs: DataFrame, radii: Sequence[int] = (20, 60, 150, 300)) -> DataFrame:
    """Ended identities with a same-colour start inside each radius; stationary and moving links."""
    nearest = pairs.filter("same_color").groupBy("dataset", "end_id").agg(F.min(F.struct("d", "start_id", "gap_s", "vx", "vy")).alias("b"))
    moving = F.hypot("b.vx", "b.vy") > 6.0
    speed = F.col("b.d") / F.col("b.gap_s")
    aggs = [F.count_if(F.col("b.d") <= r).alias(f"within_{r}") for r in radii]
    return nearest.groupBy("dataset").agg(F.count(F.lit(1)).alias("links"), *aggs, F.count_if(moving).alias("moving"), F.count_if(~moving).alias("stationary"), F.max(speed).alias("max_speed"))


def compare_variants(variants: dict[str, DataFrame]) -> DataFrame:
    """Shape of association variants side by side."""
    out = None
    for name, f in variants.items():
        one = f.groupBy("dataset").agg(F.count(F.lit(1)).alias("tracks"), F.sum("hits").alias("hits"), F.count_if(F.col("hits") == 1).alias("singletons"), F.max("hits").alias("longest"))
        one = one.select("dataset", *[F.col(c).alias(f"{c}_{name}") for c in ("tracks", "hits", "singletons", "longest")])
        out = one if out is None else out.join(one, "dataset", "full")
    return out


def quad_eval(rows: DataFrame, by: Sequence[str], tolerance: float) -> DataFrame:
    """Detector against reference: rejections, mean and p90 corner distance, share within tolerance."""
    ok = F.col("reason").isNull()
    q = exact_quantiles(rows.withColumn("_d", F.when(ok, F.col("distance"))), by, "_d", {"p90": 0.9}).select(*by, "p90")
    c = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(~ok).alias("rejected"), F.count_if(F.col("reason") == "degenerate corner").alias("degenerate"),
                              F.avg(F.when(ok, F.col("distance"))).alias("mean"), F.count_if(ok & (F.col("distance") <= tolerance)).alias("within"))
    return c.join(q, list(by), "left")


def passes_everywhere(picks: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Recordings where every sampled pick passes, against the recorded expectation."""
    got = picks.groupBy(key).agg(F.bool_and("ok").alias("passes"), F.count(F.lit(1)).alias("picks"))
    j = got.join(expected, key, "full")
    return j.withColumn("outcome", F.when(F.col("passes").isNull(), "not sampled").when(F.col("expected").isNull(), "unexpected").when(F.col("passes") == F.col("expected"), "as expected").otherwise("gate failure"))
