"""Evidence gates: ordered rules over nullable evidence; null means *not measured*.

Evidence columns keep their nulls; no rule replaces a missing number by zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as P
from ..session import cut_lineage
from .joins import near_pairs
from .kernels import strongest_first

# Side reasons that contradict the reference, and the reason of a blind side.
REFUTE = ("boundary_outside_band", "prior_disagreement")
BLIND = "no_boundary_evidence"
CONTRADICTED = "calibration_reference_contradicted_at_time"
UNVERIFIED = "calibration_rail_unverified_at_time"


def calibration_warning(verified: Column, supported: Column, unverified: Column) -> Column:
    """``unverified``: MAP<side, reason>.  Nothing measurable warns about nothing."""
    reasons = F.map_values(unverified)
    empty = unverified.isNull() | (F.size(unverified) == 0)
    return (F.when(empty & verified.isNull(), None).when(empty & (supported < 4), UNVERIFIED).when(empty, None)
            .when(F.exists(reasons, lambda r: r.isin(*REFUTE)), CONTRADICTED)
            .when(F.size(F.filter(reasons, lambda r: r == BLIND)) >= 2, UNVERIFIED))


def verdict(status: str, gate: str, *reasons, tier: str | None = None, warn: Column | None = None) -> Column:
    items = [r if isinstance(r, Column) else F.lit(r) for r in reasons]
    arr = F.array(*items) if warn is None else F.array_compact(F.array(*items, warn))
    return F.struct(F.lit(status).alias("status"), F.lit(gate).alias("gate"), arr.alias("reasons"),
                    F.lit(tier).cast("string").alias("tier"))


def eligible_vanish(vanish: Column, color: Column) -> Column:
    """Vanished balls whose colour does not contradict the claim's."""
    blank = color.isNull() | (color == "")
    key = P.color_key(color)
    return F.filter(vanish, lambda v: blank | v["color"].isNull() | (v["color"] == "") | (P.color_key(v["color"]) == key))


def with_pot_gate(df: DataFrame, e: str = "pot", color: str = "color", warn: Column | None = None, out: str = "verdict") -> DataFrame:
    """A pot needs a census drop that stays down and the vanished ball at a pocket.

    ``e`` is a struct: available, note, color_unique, color_measured, color_present,
    census_pre, census_post, census_post_max, comparable, vanish ARRAY<STRUCT<color,dist_mm,pre_hits,approach_mm>>.
    """
    ev = F.col(e)
    far = F.lit(float("inf"))
    df = df.withColumn("_ok", eligible_vanish(ev["vanish"], F.col(color))).withColumn("_best", F.array_min(F.transform(
        "_ok", lambda v, i: F.struct(F.coalesce(v["dist_mm"], far).alias("d"), i.alias("i"), v["dist_mm"].alias("dist_mm"),
                                     v["pre_hits"].alias("pre_hits"), v["approach_mm"].alias("approach_mm")))))
    best, drop = F.col("_best"), ev["census_pre"] - ev["census_post"]
    chain = (
        F.when(~F.coalesce(ev["available"], F.lit(False)), verdict("unconfirmed", "probe", F.coalesce(F.nullif(ev["note"], F.lit("")), F.lit("no probe evidence"))))
        .when(ev["color_unique"] & ev["color_measured"] & ev["color_present"], verdict("rejected", "vanish", "vanished_ball_still_on_cloth"))
        .when(ev["census_pre"].isNull() | ev["census_post"].isNull(), verdict("unconfirmed", "census", "no cloth census measured"))
        .when(ev["comparable"] == F.lit(False), verdict("unconfirmed", "census", "census_source_mismatch"))
        .when(ev["census_pre"] < 2.0, verdict("unconfirmed", "census", "census_too_sparse"))
        .when(drop < 1, verdict("rejected", "census", "census_did_not_drop"))
        .when(ev["census_post_max"] > ev["census_pre"] - 1, verdict("rejected", "census", "census_recovered"))
        .when(F.size("_ok") == 0, verdict("unconfirmed", "vanish", "no_vanished_ball_measured"))
        .when(best["dist_mm"].isNull() | (best["dist_mm"] > 100.0), verdict("rejected", "pocket", "vanished_ball_not_at_pocket"))
        .when(F.coalesce(best["pre_hits"], F.lit(0)) < 1, verdict("unconfirmed", "vanish", "vanished_ball_not_established"))
        .when(best["approach_mm"] <= 0, verdict("rejected", "approach", "no_approach_to_pocket"))
        .otherwise(verdict("confirmed", "pot", "census_drop", "vanished_ball_at_pocket", tier="geometry", warn=warn)))
    return df.withColumn(out, chain).drop("_ok", "_best")


def census_corroborated(e: Column, needed: int = 2, min_mm: float = 300.0, tol_px: float = 60.0) -> Column:
    """A fused identity seen on both ends moved far enough from where the claim starts."""
    zero = F.lit(0)
    return (F.coalesce(e["census_disp_mm"] >= min_mm, F.lit(False)) & (F.coalesce(e["census_start_hits"], zero) >= needed)
            & (F.coalesce(e["census_end_hits"], zero) >= needed) & (F.coalesce(e["census_moved"], zero) >= 1)
            & F.coalesce(e["census_gap_px"] <= tol_px, F.lit(True)))


def shot_gate(e: Column, warn: Column | None = None, needed: int = 2) -> Column:
    """A shot needs on-cloth geometry and a re-measured displacement of the ball."""
    inside = F.least(e["from_px"], e["to_px"])
    return (
        F.when(~F.coalesce(e["available"], F.lit(False)), verdict("unconfirmed", "probe", F.coalesce(F.nullif(e["note"], F.lit("")), F.lit("no probe evidence"))))
        .when(e["from_px"].isNull() | e["to_px"].isNull(), verdict("unconfirmed", "geometry", "claim_not_projectable"))
        .when(inside < -2.0, verdict("rejected", "geometry", "off_cloth"))
        .when(census_corroborated(e), verdict("confirmed", "displacement", "census_displacement_corroborated", tier="census", warn=warn))
        .when(e["disp_mm"].isNull(), verdict("unconfirmed", "displacement", "no_matched_ball_measured"))
        .when(e["disp_mm"] < 300.0, verdict("rejected", "displacement", "displacement_not_corroborated"))
        .when((e["start_hits"] < needed) | (e["end_hits"] < needed), verdict("rejected", "observation", "displacement_unobserved_elsewhere"))
        .when((e["anchor_tries"] > 0) & (e["stable_hits"] < 2), verdict("unconfirmed", "stability", "displacement_not_stable"))
        .when(e["gap_px"] > 60.0, verdict("confirmed", "displacement", "displacement_corroborated", "geometry_mismatch", tier="window", warn=warn))
        .otherwise(verdict("confirmed", "displacement", "displacement_corroborated", tier="geometry", warn=warn)))


def judge(df: DataFrame, pot: str, shot: str, warn: Column, color: str = "color", kind: str = "kind") -> DataFrame:
    """Dispatch on the claim's kind; unknown kinds stay unconfirmed."""
    d = with_pot_gate(df, pot, color, warn, "_pot")
    unknown = verdict("unconfirmed", "kind", F.concat(F.lit("unknown kind "), F.coalesce(F.col(kind), F.lit(""))))
    return d.withColumn("verdict", F.when(F.col(kind) == "pot", F.col("_pot")).when(F.col(kind) == "shot", shot_gate(F.col(shot), warn)).otherwise(unknown)).drop("_pot")


def occlusion_status(claims: DataFrame, readings: DataFrame, keys: Sequence[str], start: str, end: str, width: int) -> DataFrame:
    """clear / occluded / silent over [start, end]; no reading is silence, not clarity."""
    from .kernels import bucket_of
    iv = claims.withColumn("_b", F.explode(F.sequence(bucket_of(F.col(start), width), bucket_of(F.col(end), width))))
    r = readings.select(*keys, F.col("us").alias("_r"), "covered").withColumn("_b", bucket_of(F.col("_r"), width))
    got = iv.join(r, [*keys, "_b"]).filter((F.col("_r") >= F.col(start)) & (F.col("_r") <= F.col(end))).groupBy("event_id").agg(F.max("covered").alias("_any"))
    return claims.join(got, "event_id", "left").withColumn("occlusion", F.when(F.col("_any").isNull(), "silent").when(F.col("_any"), "occluded").otherwise("clear")).drop("_any")


def summarize_verdicts(rows: DataFrame) -> DataFrame:
    """Status x kind with totals, plus the geometry-tier share of confirmed rows."""
    c = rows.cube("kind", F.col("verdict.status").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("verdict.status") == "confirmed") & F.coalesce(F.col("verdict.tier") == "geometry", F.lit(False))).alias("geometry"),
        F.count_if(F.col("verdict.status") == "confirmed").alias("confirmed"), F.grouping_id().cast("long").alias("level"))
    return c.withColumn("precision_proxy", F.when(F.col("confirmed") > 0, F.col("geometry") / F.nullif(F.col("confirmed"), F.lit(0))))


def reason_histogram(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("verdict.reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def near_misses(rows: DataFrame, k: int = 5, order: str = "event_id") -> DataFrame:
    """Strongest evidence among the rows that were not confirmed; top k overall."""
    pot, shot = F.col("pot"), F.col("shot")
    near = F.size(F.filter(pot["vanish"], lambda v: F.coalesce((v["dist_mm"] <= 150) & (F.coalesce(v["pre_hits"], F.lit(0)) >= 2), F.lit(False))))
    parts = [2.0 * near, F.when(pot["census_pre"] - pot["census_post"] >= 1, 1.0), F.when(shot["disp_mm"] >= 150, 1.0), F.when(shot["census_disp_mm"] >= 150, 1.0)]
    score = parts[0]
    for p in parts[1:]:
        score = score + F.coalesce(p, F.lit(0.0))
    scored = rows.filter("verdict.status <> 'confirmed'").withColumn("score", score).filter("score > 0")
    return scored.orderBy(F.desc("score"), order).limit(k)


def compare_references(judged: DataFrame, key: str = "event_id") -> DataFrame:
    """One column per reference with the status, and whether the verdict flips."""
    refs = judged.groupBy(key).agg(F.max(F.when(F.col("reference") == "own", F.col("verdict.status"))).alias("own"),
                                   F.max(F.when(F.col("reference") == "next", F.col("verdict.status"))).alias("next"))
    return refs.withColumn("flips", F.col("own") != F.col("next"))


def agreement(queue: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Recorded verdict against the gate status; the first file wins per id, unsure is not comparable."""
    first = verdicts.groupBy("id").agg(F.min(F.struct("file_no", "verdict")).alias("v")).select("id", F.col("v.verdict").alias("owner_verdict"))
    out = first.join(queue.select("id", "status"), "id", "left").withColumn("gate_status", F.coalesce("status", F.lit("not-in-queue"))).drop("status")
    agrees = F.when(F.col("owner_verdict") == "wrong", F.col("gate_status") == "rejected").when(F.col("owner_verdict") == "correct", F.col("gate_status") == "confirmed")
    return out.withColumn("agrees", agrees)


def consolidate(vanish: DataFrame, group: Sequence[str], radius_mm: float = 200.0) -> DataFrame:
    """One row per vanished ball: by pocket distance, each joins the first kept row of its colour within the
    radius or is kept itself; the kept row takes the largest hit count.

    Rows that exclude each other are paired once on a grid of the radius and settled by ``strongest_first``, so
    no group is gathered.  A ball without a pocket distance comes last, ties go by id; ids are unique in a
    group, and a ball without colour or position is kept.
    """
    row = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in (*group, "id")])
    place = F.struct(F.col("dist").isNull().alias("n"), F.coalesce("dist", F.lit(0.0)).alias("d"), F.col("id").alias("i"))
    balls = cut_lineage(vanish.select(*group, "id", "color", "mx", "my", "hits", row.alias("weak"), place.alias("order")))
    early = balls.select(*group, "color", F.col("mx").alias("sx"), F.col("my").alias("sy"), F.col("weak").alias("strong"), F.col("order").alias("first"))
    pairs = near_pairs(balls, early, [*group, "color"], radius_mm * (1 + 1e-9), ("mx", "my"), ("sx", "sy")).filter(
        (F.col("first") < F.col("order")) & (F.hypot(F.col("mx") - F.col("sx"), F.col("my") - F.col("sy")) <= radius_mm))
    pairs = cut_lineage(pairs.select(*group, "weak", "strong", "order", "first"))
    gone = cut_lineage(strongest_first(pairs, group))
    leaders = pairs.join(gone, "weak").join(gone.withColumnRenamed("weak", "strong"), "strong", "left_anti").groupBy("weak").agg(
        F.min("first").alias("first"))
    return balls.join(leaders, "weak", "left").groupBy(*group, F.coalesce("first.i", "id").alias("id")).agg(
        F.max("hits").alias("hits"), F.count(F.lit(1)).alias("merged"))
