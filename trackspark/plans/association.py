"""Association and order-dependent operators bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..functions import geometry as G
from ..operators import association as A
from ..operators import calibration as C
from ..operators import census as N
from .geometry import boxes
from .signals import rounded

QUERIES, ORACLE = {}, {}
SEC = B.HOUR_US
WIDTH = 48 * SEC
#: the driver identities are sighted hours (scaled seconds) apart, so the dense bars are widened
DENSE = A.DenseConfig(rest_speed=4.0, rest_window_s=1.0, rest_min=1, motion_speed=8.0, onset_intervals=2, max_gap_s=12.0, vanish_min_s=4.0)


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def obs(spark, sf):
    return B.detections(spark, sf).select("dataset", "us", "event_id", "color", "source", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


@query("w15_associate")
def w15(spark, sf):
    return A.associate(obs(spark, sf), SEC, WIDTH).select("dataset", "event_id", "tid", F.round("residual_px", 6).alias("residual_px"), "bridged")


@query("w15_association_stats")
def w15s(spark, sf):
    return A.association_stats(A.associate(obs(spark, sf), SEC, WIDTH), SEC)


@query("w16_iou_tracklets")
def w16(spark, sf):
    b = boxes(B.detections(spark, sf)).withColumn("burst", F.expr("frame_no div 6"))
    a = A.iou_tracklets(b, ["dataset", "burst"], ["frame_no", "event_id"])
    g = A.iou_tracklets(b, ["dataset", "burst"], ["frame_no", "event_id"], mode="grace").withColumnRenamed("tracklet", "grace_tracklet")
    return a.join(g, ["dataset", "burst", "event_id"])


@query("w17_dedupe_claims", B.sql("""
, c AS (SELECT dataset, kind, us, event_id, color, CASE WHEN x%3=0 THEN 'head-left' END AS pocket, x*10.0::DOUBLE AS mx, y*10.0::DOUBLE AS my, lag(us) OVER (PARTITION BY dataset, kind ORDER BY us, event_id) AS pu FROM claims),
i AS (SELECT *, sum(CASE WHEN us-pu<=7200000000 THEN 0 ELSE 1 END) OVER (PARTITION BY dataset, kind ORDER BY us, event_id) AS isl FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY dataset, kind, isl ORDER BY us, event_id) AS rn FROM i),
fold AS (SELECT DISTINCT dataset, kind, isl, 0::BIGINT AS rn, []::STRUCT(g BIGINT, us BIGINT, color VARCHAR, pocket VARCHAR, mx DOUBLE, my DOUBLE)[] AS m, NULL::BIGINT AS id, NULL::BIGINT AS leader FROM o UNION ALL
 SELECT dataset, kind, isl, rn, list_append(m, {'g':coalesce(g,rn),'us':us,'color':color,'pocket':pocket,'mx':mx,'my':my}), event_id, coalesce(g,rn) FROM (
  SELECT f.dataset, f.kind, f.isl, o.rn, f.m, o.event_id, o.us, o.color, o.pocket, o.mx, o.my, list_min(list_transform(list_filter(f.m, lambda k: o.us-k.us<=7200000000 AND
   (k.color=o.color)::INT + coalesce(k.pocket=o.pocket OR sqrt((k.mx-o.mx)*(k.mx-o.mx)+(k.my-o.my)*(k.my-o.my))<=200, sqrt((k.mx-o.mx)*(k.mx-o.mx)+(k.my-o.my)*(k.my-o.my))<=200)::INT + (o.us-k.us<=1800000000)::INT >= 2), lambda k: k.g)) AS g
  FROM fold f JOIN o ON o.dataset=f.dataset AND o.kind=f.kind AND o.isl=f.isl AND o.rn=f.rn+1)),
l AS (SELECT f.*, o.event_id AS leader_id, c.color FROM fold f JOIN o ON o.dataset=f.dataset AND o.kind=f.kind AND o.isl=f.isl AND o.rn=f.leader JOIN c ON c.event_id=f.id)
SELECT leader_id AS event_id, kind, count(*) AS count, array_to_string(list_sort(list_distinct(list(color))), '+') AS colors FROM l GROUP BY leader_id, kind""".lstrip()[1:], "claims", recursive=True))
def w17(spark, sf):
    c = B.claims(spark, sf).withColumn("pocket", F.when(F.col("x") % 3 == 0, "head-left")).withColumn("mx", F.col("x") * 10.0).withColumn("my", F.col("y") * 10.0)
    return A.dedupe_claims(c, SEC, WIDTH)


@query("w18_prune_candidates", B.sql("""
, l AS (SELECT *, value AS strength, CASE WHEN event_id%4>0 THEN x*10.0::DOUBLE END AS mx, CASE WHEN event_id%4>0 THEN y*10.0::DOUBLE END AS my, lag(us) OVER (PARTITION BY dataset, kind ORDER BY us, event_id) AS pu FROM claims),
i AS (SELECT *, sum(CASE WHEN us-pu<=14400000000 THEN 0 ELSE 1 END) OVER (PARTITION BY dataset, kind ORDER BY us, event_id) AS isl FROM l),
o AS (SELECT *, row_number() OVER (PARTITION BY dataset, kind, isl ORDER BY strength DESC, us, event_id) AS rn FROM i),
fold AS (SELECT DISTINCT dataset, kind, isl, 0::BIGINT AS rn, []::STRUCT(id BIGINT, us BIGINT, mx DOUBLE, my DOUBLE)[] AS kept, NULL::BIGINT AS id, NULL::BIGINT AS leader FROM o UNION ALL
 SELECT dataset, kind, isl, rn, CASE WHEN same IS NULL THEN list_append(kept, {'id':event_id,'us':us,'mx':mx,'my':my}) ELSE kept END, event_id, coalesce(same.id, event_id) FROM (
  SELECT f.dataset, f.kind, f.isl, o.rn, f.kept, o.event_id, o.us, o.mx, o.my, list_filter(f.kept, lambda k: abs(k.us-o.us)<=14400000000 AND (k.mx IS NULL OR o.mx IS NULL OR sqrt((k.mx-o.mx)*(k.mx-o.mx)+(k.my-o.my)*(k.my-o.my))<=250))[1] AS same
  FROM fold f JOIN o ON o.dataset=f.dataset AND o.kind=f.kind AND o.isl=f.isl AND o.rn=f.rn+1))
SELECT dataset, kind, leader AS event_id, count(*) AS duplicates FROM fold WHERE id IS NOT NULL GROUP BY ALL""".lstrip()[1:], "claims", recursive=True))
def w18(spark, sf):
    c = B.claims(spark, sf).withColumn("strength", F.col("value"))
    for k, v in (("mx", "x"), ("my", "y")):
        c = c.withColumn(k, F.when(F.col("event_id") % 4 > 0, F.col(v) * 10.0))
    return A.prune_candidates(c, SEC, WIDTH)


@query("w18_debounce", B.sql("""
, o AS (SELECT dataset, us, event_id, kind, row_number() OVER (PARTITION BY dataset ORDER BY us, event_id) AS rn FROM claims),
f AS (SELECT dataset, rn, event_id, us AS last_us, kind AS last_kind, true AS kept FROM o WHERE rn=1 UNION ALL
 SELECT dataset, rn, event_id, CASE WHEN ok THEN us ELSE last_us END, CASE WHEN ok THEN kind ELSE last_kind END, ok FROM (
  SELECT o.dataset, o.rn, o.event_id, o.us, o.kind, f.last_us, f.last_kind, o.us-f.last_us>=14400000000 OR o.kind<>f.last_kind AS ok FROM f JOIN o ON o.dataset=f.dataset AND o.rn=f.rn+1))
SELECT dataset, event_id, kept FROM f""".lstrip()[1:], "claims", recursive=True))
def w18d(spark, sf):
    return A.debounce(B.claims(spark, sf), SEC)


@query("w18_occlusion_reasons", B.sql("""
SELECT event_id, concat_ws('+', CASE WHEN med<>0 AND NOT cl BETWEEN 0.55*med AND 1.6*med THEN 'cloth_area_out_of_band' END, CASE WHEN p>0.02 THEN 'person_on_cloth' END) AS reasons FROM (
 SELECT event_id, x%50+30.0 AS cl, CASE WHEN event_id%9>0 THEN (y%60+20)::DOUBLE END AS med, (event_id%5)/100.0 AS p FROM claims)""", "claims"))
def w18o(spark, sf):
    out = A.occlusion_reasons(B.claims(spark, sf), (F.col("event_id") % 5) / 100.0, F.col("x") % 50 + 30.0, F.when(F.col("event_id") % 9 > 0, (F.col("y") % 60 + 20).cast("double")))
    return out.select("event_id", F.array_join("drop_reasons", "+").alias("reasons"))


@query("w23_frame_gate", B.sql("""
, g AS (SELECT dataset, frame_no, count(*) AS n, (sum(event_id)%300+1000)::DOUBLE AS cloth, (sum(x)%9+100)::DOUBLE AS bright, max(score)>=0.99 AS person FROM detections GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY frame_no) AS rn FROM g),
f AS (SELECT DISTINCT dataset, 0::BIGINT AS rn, NULL::BIGINT AS frame_no, NULL::DOUBLE AS ref, NULL::DOUBLE AS light, []::BIGINT[] AS census, NULL::VARCHAR AS reason FROM o UNION ALL
 SELECT dataset, rn, frame_no, CASE WHEN why IS NULL THEN 0.95::DOUBLE*base+0.05::DOUBLE*cloth ELSE base END, bright, CASE WHEN why IS NULL THEN list_append(census, n)[-30:] ELSE census END, why FROM (
  SELECT o.dataset, o.rn, o.frame_no, o.n, o.cloth, o.bright, f.census, CASE WHEN f.ref IS NULL AND NOT o.person THEN o.cloth ELSE f.ref END AS base,
   CASE WHEN o.person THEN 'person_on_table' WHEN f.ref IS NULL THEN 'warming_up' WHEN NOT o.cloth BETWEEN 0.85::DOUBLE*f.ref AND 1.15::DOUBLE*f.ref THEN 'cloth_area_out_of_band' WHEN abs(o.bright-f.light)>6 THEN 'exposure_shift'
    WHEN len(f.census)>0 AND o.n<list_aggregate(f.census,'median')-2 THEN 'ball_census_off' END AS why
  FROM f JOIN o ON o.dataset=f.dataset AND o.rn=f.rn+1))
SELECT dataset, frame_no, reason FROM f WHERE rn>0""".lstrip()[1:], "detections", recursive=True))
def w23(spark, sf):
    f = B.detections(spark, sf).groupBy("dataset", "frame_no").agg(
        F.count(F.lit(1)).alias("n"), (F.sum("event_id") % 300 + 1000).cast("double").alias("cloth"), (F.sum("x") % 9 + 100).cast("double").alias("brightness"), (F.max("score") >= 0.99).alias("person"))
    return A.frame_gate(f)


def samples(spark, sf):
    return N.dedupe_samples(B.tracks(spark, sf), "score")


@query("w11_dense_shots", B.sql("""
, dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, track_id, frame_no ORDER BY score DESC, us, event_id) AS k FROM tracks) WHERE k=1),
iv AS (SELECT *, row_number() OVER w AS idx, (us-lag(us) OVER w)/3.6e9 AS dt, sqrt(power(x-lag(x) OVER w,2)+power(y-lag(y) OVER w,2)) AS dist, lag(us) OVER w AS pu, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(event_id) OVER w AS pe FROM dd WINDOW w AS (PARTITION BY dataset, track_id ORDER BY us, event_id)),
sp AS (SELECT *, CASE WHEN dt>0 THEN dist/dt END AS speed FROM iv),
ht AS (SELECT *, idx-row_number() OVER (PARTITION BY dataset, track_id ORDER BY idx) AS g FROM sp WHERE dt<=12 AND speed>8), st AS (SELECT *, idx-row_number() OVER (PARTITION BY dataset, track_id ORDER BY idx) AS g FROM sp WHERE dt<=12 AND speed<=4),
rn AS (SELECT dataset, track_id, g, count(*) AS intervals, max(speed) AS peak_speed, min(idx) AS i0, arg_min(pe,idx) AS onset_id, min(pu) AS onset_us, arg_min(px,idx) AS ax, arg_min(py,idx) AS ay, arg_max(x,idx) AS bx, arg_max(y,idx) AS b_y FROM ht GROUP BY ALL),
rs AS (SELECT dataset, track_id, g, count(*) AS n_rest, max(idx) AS i1, (max(us)-min(pu))/3.6e9 AS rest_s FROM st GROUP BY ALL),
fn AS (SELECT rn.*, coalesce(n_rest,0) AS n_rest, coalesce(rest_s,0) AS rest_s, sqrt(power(bx-ax,2)+power(b_y-ay,2)) AS net FROM rn LEFT JOIN rs ON rs.dataset=rn.dataset AND rs.track_id=rn.track_id AND rs.i1=rn.i0-1)
SELECT dataset, track_id, onset_id, onset_us, intervals, round(peak_speed,6) AS peak_speed, round(net,6) AS net, n_rest, round(rest_s,6) AS rest_s, CASE WHEN intervals<2 THEN 'motion_too_short' WHEN net<=37.8-3.62*sqrt(2) THEN 'oscillation_no_net_travel' WHEN net<=37.8+3.62*sqrt(2) THEN 'oscillation_unresolved'
 WHEN rest_s<1.0 OR n_rest<1 THEN 'no_still_stretch' ELSE 'shot' END AS outcome FROM fn""".lstrip()[1:], "tracks"))
def w11(spark, sf):
    return rounded(A.dense_shots(samples(spark, sf), SEC, WIDTH, DENSE).drop("path"))


def pots(spark, sf):
    located = C.resolve_segment(samples(spark, sf), B.segments(spark, sf).withColumn("h", G.homography(F.col("quad"))))
    full = G.with_pocket_membership(located, F.col("segment.h"), F.col("x"), F.col("y"), DENSE.loc_error_px, "membership")
    full = full.withColumn("cloth", G.in_quad(F.col("x"), F.col("y"), F.col("segment.quad"))).drop("segment", "clamped", "clamp_reason")
    until = full.groupBy("dataset").agg((F.max("us") + 6 * SEC).alias("until_us"))
    occ = F.when(F.col("event_id") % 11 == 0, "silent").when(F.col("value") >= 100, "occluded").otherwise("clear")
    return A.dense_pots(full, F.col("membership"), until, occ, SEC, WIDTH, G.in_frame(F.col("x"), F.col("y"), 127, 254, 3.0), F.col("cloth"), DENSE)


@query("w12_dense_pots")
def w12(spark, sf):
    return rounded(pots(spark, sf))


@query("w27_dense_queue")
def w27(spark, sf):
    return A.dense_queue(A.dense_shots(samples(spark, sf), SEC, WIDTH, DENSE), pots(spark, sf))


@query("w27_gate_ledger")
def w27g(spark, sf):
    return A.gate_ledger(A.dense_shots(samples(spark, sf), SEC, WIDTH, DENSE), pots(spark, sf))
