"""Evaluation and selection operators bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..functions import geometry as G
from ..functions import scalars as P
from ..operators import evaluation as E
from ..operators import gates as T
from ..operators import joins as J
from ..operators import selection as S
from ..operators import trajectory as TR
from ..session import cut_lineage
from .signals import rounded

QUERIES, ORACLE = {}, {}
SEC = B.HOUR_US


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


@query("a20_confusion", """
WITH p AS (SELECT event_type AS truth, CASE WHEN event_id%3>0 THEN event_type WHEN event_id%2=0 THEN 'view' ELSE 'click' END AS pred FROM events), c AS (SELECT truth, pred, count(*) AS n FROM p GROUP BY ALL)
SELECT truth, pred, n, round(n/sum(n) OVER (PARTITION BY truth),9) AS share, rank FROM (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY n DESC, pred) AS rank FROM c)""")
def a20(spark, sf):
    p = F.expr("case when event_id % 3 > 0 then event_type when event_id % 2 = 0 then 'view' else 'click' end")
    return rounded(E.confusion(B.table(spark, sf, "events").withColumn("pred_type", p), "event_type", "pred_type"), 9)


def sides(spark, sf):
    b = B.detections(spark, sf).withColumnRenamed("event_id", "id").select("dataset", "frame_no", "id", "x", "y", "score", "color")
    pred, truth = b.filter("id % 2 = 1"), b.filter("id % 2 = 0")
    return pred, truth, cut_lineage(J.match_truth(pred, truth, 6))  # matched once, read several times


MT = """near AS (SELECT p.dataset, p.frame_no, p.event_id AS pid, p.score, list({'d2':(p.x-t.x)*(p.x-t.x)+(p.y-t.y)*(p.y-t.y), 'tid':t.event_id} ORDER BY (p.x-t.x)*(p.x-t.x)+(p.y-t.y)*(p.y-t.y), t.event_id) AS offers
 FROM detections p JOIN detections t ON p.dataset=t.dataset AND p.frame_no=t.frame_no AND (p.x-t.x)*(p.x-t.x)+(p.y-t.y)*(p.y-t.y)<=36 WHERE p.event_id%2=1 AND t.event_id%2=0 GROUP BY ALL),
walk AS (SELECT *, row_number() OVER (PARTITION BY dataset, frame_no ORDER BY score DESC, pid) AS rn FROM near),
fold AS (SELECT DISTINCT dataset, frame_no, 0::BIGINT AS rn, []::BIGINT[] AS used, NULL::BIGINT AS pid, NULL::DOUBLE AS score, NULL::STRUCT(d2 BIGINT, tid BIGINT) AS pick FROM walk
 UNION ALL SELECT dataset, frame_no, rn, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick.tid) END, pid, score, pick FROM (
  SELECT f.dataset, f.frame_no, w.rn, f.used, w.pid, w.score, list_filter(w.offers, lambda o: NOT list_contains(f.used, o.tid))[1] AS pick FROM fold f JOIN walk w ON w.dataset=f.dataset AND w.frame_no=f.frame_no AND w.rn=f.rn+1)),
mp AS (SELECT dataset, frame_no, pid, score, pick.tid AS tid, pick.d2 AS d2 FROM fold WHERE pick IS NOT NULL)"""
SWEEP = MT + """,
th AS (SELECT round(0.05+0.025*i,3)::DOUBLE AS threshold FROM (SELECT unnest(range(38)) AS i)),
pc AS (SELECT threshold, count(*) AS n_pred FROM th JOIN detections d ON d.event_id%2=1 AND d.score>=threshold GROUP BY threshold),
tc AS (SELECT threshold, count(*) AS tp, median(sqrt(d2)) AS p50, quantile_cont(sqrt(d2),0.9) AS p90 FROM th JOIN mp ON score>=threshold GROUP BY threshold),
sw AS (SELECT threshold, coalesce(tp,0) AS tp, n_pred-coalesce(tp,0) AS fp, (SELECT count(*) FROM detections WHERE event_id%2=0)-coalesce(tp,0) AS fn, p50, p90 FROM pc LEFT JOIN tc USING (threshold)),
sf AS (SELECT *, tp/greatest(1,tp+fp) AS precision, tp/greatest(1,tp+fn) AS recall FROM sw),
sx AS (SELECT *, CASE WHEN precision+recall=0 THEN 0 ELSE 2*precision*recall/(precision+recall) END AS f1 FROM sf)"""


def sweep(spark, sf):
    pred, truth, m = sides(spark, sf)
    scored = m.join(pred.select(F.col("id").alias("pred_id"), "score"), "pred_id")
    return E.pr_sweep(pred, scored, truth.agg(F.count(F.lit(1)).alias("n_truth")))


@query("a21_pr_sweep", B.sql(SWEEP + "\nSELECT threshold, tp, fp, fn, round(precision,9) AS precision, round(recall,9) AS recall, round(f1,9) AS f1, round(p50,6) AS err_p50, round(p90,6) AS err_p90 FROM sx", "detections", recursive=True))
def a21(spark, sf):
    s = sweep(spark, sf)
    return s.select("threshold", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], *[F.round(c, 6).alias(c) for c in ("err_p50", "err_p90")])


@query("a21_operating_point", B.sql(SWEEP + """
SELECT arg_max(threshold,(round(f1,3),-threshold)) FILTER (WHERE p90<=5) AS operating, arg_max(threshold,(round(f1,3),-threshold)) AS best_f1, max(round(f1,3)) FILTER (WHERE p90<=5) AS operating_f1 FROM sx""", "detections", recursive=True))
def a21o(spark, sf):
    return E.operating_point(sweep(spark, sf), 5.0)


@query("a22_disagreement", B.sql(MT + """,
l AS (SELECT 'fn' AS side, score, x, y FROM detections WHERE event_id%2=0 AND event_id NOT IN (SELECT tid FROM mp) UNION ALL SELECT 'fp', score, x, y FROM detections WHERE event_id%2=1 AND event_id NOT IN (SELECT pid FROM mp)),
e AS (SELECT *, least(x,126-x,y,253-y)::DOUBLE AS edge FROM l)
SELECT side, count(*) AS n, count(*) FILTER (WHERE edge>0) AS inside, count(*) FILTER (WHERE abs(edge)<=25) AS near_edge, round(median(score),6) AS score_median, min(score) AS score_min, round(median(abs(edge)),6) AS edge_median FROM e GROUP BY side""", "detections", recursive=True))
def a22(spark, sf):
    pred, truth, m = sides(spark, sf)
    q = F.array(G.point(0, 0), G.point(126, 0), G.point(126, 253), G.point(0, 253))
    return rounded(E.disagreement(E.leftovers(truth, m, "truth_id"), E.leftovers(pred, m, "pred_id"), G.edge_distance(q, F.col("x"), F.col("y"))))


@query("a23_mode_agreement", B.sql(MT + """,
c AS (SELECT dataset, frame_no, count(*) FILTER (WHERE event_id%2=0) AS count_a, count(*) FILTER (WHERE event_id%2=1) AS count_b FROM detections GROUP BY ALL), m AS (SELECT dataset, frame_no, count(*) AS matched, max(d2) AS max_d2 FROM mp GROUP BY ALL)
SELECT dataset, frame_no, count_a, count_b, coalesce(matched,0) AS matched, max_d2, count_a=count_b AS counts_agree, count_a=count_b AND coalesce(matched,0)=count_a AS "full" FROM c LEFT JOIN m USING (dataset, frame_no)""", "detections", recursive=True))
def a23(spark, sf):
    pred, truth, m = sides(spark, sf)
    return E.mode_agreement(truth, pred, m)


LV = [0.2, 0.35, 0.425, 0.5, 0.62]
REC = MT + """,
fn AS (SELECT * FROM detections WHERE event_id%2=0 AND event_id NOT IN (SELECT tid FROM mp WHERE score>=0.425)),
lv AS (SELECT unnest([0.2,0.35,0.425,0.5,0.62])::DOUBLE AS threshold),
rc AS (SELECT f.event_id AS fn_id, threshold, min((f.x-p.x)*(f.x-p.x)+(f.y-p.y)*(f.y-p.y)) AS d2 FROM fn f JOIN detections p ON p.dataset=f.dataset AND p.frame_no=f.frame_no AND p.event_id%2=1 AND (f.x-p.x)*(f.x-p.x)+(f.y-p.y)*(f.y-p.y)<=100 JOIN lv ON p.score>=threshold GROUP BY ALL)"""


def missed(spark, sf):
    pred, truth, m = sides(spark, sf)
    kept = m.join(pred.filter("score >= 0.425").select(F.col("id").alias("pred_id")), "pred_id", "left_semi")
    return pred, truth, E.leftovers(truth, kept, "truth_id"), E.leftovers(pred, m, "pred_id")


@query("j17_recovery", B.sql(REC + "\nSELECT fn_id, max(threshold) AS entry, arg_max(d2, threshold) AS d2 FROM rc GROUP BY fn_id", "detections", recursive=True))
def j17(spark, sf):
    pred, _, fn, _ = missed(spark, sf)
    r = E.recovery(fn, pred, 10, LV)
    return r.groupBy("fn_id").agg(F.max("threshold").alias("entry"), F.max_by("d2", "threshold").alias("d2"))


@query("j17_recovery_by_threshold", B.sql(REC + """,
o AS (SELECT threshold, list(sqrt(d2) ORDER BY d2) AS v, count(*) AS n FROM rc GROUP BY threshold)
SELECT threshold, n AS recovered, round(v[greatest(0,least(n-1,ceil(0.5*n)::BIGINT-1))+1],6) AS err_p50, round(v[greatest(0,least(n-1,ceil(0.9::DOUBLE*n)::BIGINT-1))+1],6) AS err_p90 FROM o""", "detections", recursive=True))
def j17t(spark, sf):
    pred, _, fn, _ = missed(spark, sf)
    return rounded(E.recovery_by_threshold(E.recovery(fn, pred, 10, LV)))


ADJ = REC + """,
fp AS (SELECT * FROM detections WHERE event_id%2=1 AND event_id NOT IN (SELECT pid FROM mp)),
it AS (SELECT *, CASE WHEN x*y<60 THEN 'area_too_small' WHEN x*y>9000 THEN 'area_too_large' WHEN y/3.0<4 THEN 'radius_too_small' WHEN y/3.0>60 THEN 'radius_too_large' WHEN x%5=0 THEN 'off_cloth' ELSE 'admitted' END AS gate FROM detections WHERE source='scored'),
ms AS (SELECT DISTINCT dataset, frame_no FROM it WHERE score>=0.9),
nr AS (SELECT c.event_id AS case_id, i.event_id AS inst_id, i.score, i.gate, (c.x-i.x)*(c.x-i.x)+(c.y-i.y)*(c.y-i.y) AS d2 FROM fp c JOIN it i ON i.dataset=c.dataset AND i.frame_no=c.frame_no AND (c.x-i.x)*(c.x-i.x)+(c.y-i.y)*(c.y-i.y)<=100),
ag AS (SELECT case_id, count(*) AS near, count(*) FILTER (WHERE score>=0.2) AS above, arg_min(inst_id,(d2,inst_id)) FILTER (WHERE score>=0.2 AND gate='admitted') AS inst_id, arg_min(score,(d2,inst_id)) FILTER (WHERE score>=0.2 AND gate='admitted') AS best FROM nr GROUP BY case_id),
ad AS (SELECT c.event_id AS case_id, coalesce(near,0) AS near, inst_id, CASE WHEN m.dataset IS NULL THEN 'unresolved' WHEN inst_id IS NOT NULL THEN 'teacher_recall' WHEN near>0 THEN 'unresolved' ELSE 'student_hallucination' END AS verdict,
 CASE WHEN m.dataset IS NULL THEN 'frame_not_measured' WHEN best>=0.62 THEN 'instance_at_or_above_production_cut' WHEN inst_id IS NOT NULL THEN 'instance_below_production_cut' WHEN near IS NULL THEN 'no_instance_within_radius_at_any_threshold' WHEN above>0 THEN 'instance_present_but_failed_gate'
  ELSE 'only_instances_below_the_lowest_sweep_threshold' END AS reason, CASE WHEN inst_id IS NOT NULL THEN (best>=0.2)::BIGINT+(best>=0.35)::BIGINT+(best>=0.5)::BIGINT+(best>=0.62)::BIGINT END AS levels
 FROM fp c LEFT JOIN ag ON ag.case_id=c.event_id LEFT JOIN ms m ON m.dataset=c.dataset AND m.frame_no=c.frame_no)"""


def adjudicated(spark, sf):
    pred, truth, fn, fp = missed(spark, sf)
    x, y = F.col("x"), F.col("y")
    inst = B.detections(spark, sf).filter("source = 'scored'").withColumn("gate", P.admit(x * y * 1.0, y / 3.0, x % 5 != 0)).withColumnRenamed("event_id", "id")
    return E.adjudicate(fp, inst, inst.filter("score >= 0.9")), pred, fn


@query("j18_adjudicate", B.sql(ADJ + "\nSELECT case_id, near, inst_id, verdict, reason, levels FROM ad", "detections", recursive=True))
def j18(spark, sf):
    return adjudicated(spark, sf)[0]


@query("a24_headline", B.sql(ADJ + """
SELECT (SELECT count(*) FROM ad) AS fp_total, (SELECT count(*) FROM ad WHERE verdict='teacher_recall') AS recall, (SELECT count(*) FROM ad WHERE reason='instance_below_production_cut') AS recall_below_cut, (SELECT count(*) FROM ad WHERE verdict='student_hallucination') AS hallucination,
 (SELECT count(*) FROM ad WHERE verdict='unresolved') AS unresolved, (SELECT count(*) FROM fn) AS fn_total, (SELECT count(DISTINCT fn_id) FROM rc) AS fn_recovered_best, (SELECT count(DISTINCT fn_id) FROM rc WHERE threshold=0.425) AS fn_recovered_at_cut""", "detections", recursive=True))
def a24(spark, sf):
    ad, pred, fn = adjudicated(spark, sf)
    return E.headline(ad, fn, E.recovery(fn, pred, 10, LV))


FRAG = """pv AS (SELECT *, lag(us) OVER (PARTITION BY dataset, track_id ORDER BY us, event_id) AS pu FROM tracks),
isl AS (SELECT *, sum(CASE WHEN us-pu<=43200000000 THEN 0 ELSE 1 END) OVER (PARTITION BY dataset, track_id ORDER BY us, event_id) AS run FROM pv),
fg AS (SELECT dataset, track_id, run, count(*) AS hits, min(us) AS h_us, arg_min(event_id,(us,event_id)) AS h_id, arg_min(color,(us,event_id)) AS h_color, arg_min(x,(us,event_id)) AS hx, arg_min(y,(us,event_id)) AS hy,
 max(us) AS t_us, arg_max(event_id,(us,event_id)) AS t_id, arg_max(color,(us,event_id)) AS t_color, arg_max(x,(us,event_id)) AS tx, arg_max(y,(us,event_id)) AS ty FROM isl GROUP BY ALL),
pp AS (SELECT i.dataset, i.track_id, i.run, max(i.us) AS p_us, arg_max(i.x,(i.us,i.event_id)) AS px, arg_max(i.y,(i.us,i.event_id)) AS py FROM isl i JOIN fg f ON f.dataset=i.dataset AND f.track_id=i.track_id AND f.run=i.run WHERE i.event_id<>f.t_id GROUP BY ALL),
en AS (SELECT f.*, coalesce((tx-px)/((t_us-p_us)/3.6e9),0) AS vx, coalesce((ty-py)/((t_us-p_us)/3.6e9),0) AS vy FROM fg f LEFT JOIN pp USING (dataset, track_id, run)),
fpair AS (SELECT e.dataset, e.t_id AS end_id, s.h_id AS start_id, (s.h_us-e.t_us)/3.6e9 AS gap_s, sqrt(power(s.hx-e.tx,2)+power(s.hy-e.ty,2)) AS d, vx, vy, sqrt(power(e.tx+vx*((s.h_us-e.t_us)/3.6e9)-s.hx,2)+power(e.ty+vy*((s.h_us-e.t_us)/3.6e9)-s.hy,2)) AS residual, e.t_color=s.h_color AS same_color
 FROM en e JOIN fg s ON s.dataset=e.dataset AND s.track_id<>e.track_id AND s.h_us-e.t_us BETWEEN 1 AND 9000000000)"""


def frags(spark, sf, hours=12):
    return E.fragments(B.tracks(spark, sf), hours * SEC, 96 * SEC)


def frag_pairs(spark, sf):
    return E.fragment_pairs(frags(spark, sf), int(2.5 * SEC), 12 * SEC, SEC)


@query("j20_prediction_residuals", B.sql(FRAG + "\nSELECT end_id, start_id, same_color, round(gap_s,6) AS gap_s, round(d,6) AS d, round(residual,6) AS residual FROM fpair WHERE d<=600", "tracks"))
def j20(spark, sf):
    return rounded(frag_pairs(spark, sf).select("end_id", "start_id", "same_color", "gap_s", "d", "residual"))


@query("j20_residual_summary", B.sql(FRAG + """,
o AS (SELECT same_color, list(residual ORDER BY residual) AS v, count(*) AS n FROM fpair WHERE d<=600 GROUP BY same_color)
SELECT same_color, n, round(v[least(n-1,round_even(0.5*(n-1),0)::BIGINT)+1],6) AS p50, round(v[least(n-1,round_even(0.9::DOUBLE*(n-1),0)::BIGINT)+1],6) AS p90, round(v[least(n-1,round_even(0.99::DOUBLE*(n-1),0)::BIGINT)+1],6) AS p99 FROM o""", "tracks"))
def j20s(spark, sf):
    return rounded(E.residual_summary(frag_pairs(spark, sf)))


@query("w29_fragment_links", B.sql(FRAG + """,
b AS (SELECT dataset, end_id, min(d) AS d, arg_min(gap_s,(d,start_id)) AS gap_s, arg_min(vx,(d,start_id)) AS vx, arg_min(vy,(d,start_id)) AS vy FROM fpair WHERE same_color AND d<=600 GROUP BY ALL)
SELECT dataset, count(*) AS links, count(*) FILTER (WHERE d<=20) AS within_20, count(*) FILTER (WHERE d<=60) AS within_60, count(*) FILTER (WHERE d<=150) AS within_150, count(*) FILTER (WHERE d<=300) AS within_300,
 count(*) FILTER (WHERE sqrt(vx*vx+vy*vy)>6) AS moving, count(*) FILTER (WHERE sqrt(vx*vx+vy*vy)<=6) AS stationary, round(max(d/gap_s),6) AS max_speed FROM b GROUP BY dataset""", "tracks"))
def w29(spark, sf):
    return rounded(E.fragment_links(frag_pairs(spark, sf)))


@query("a29_diagnose", B.sql(FRAG + """,
q AS (SELECT f.dataset, f.t_id, CASE WHEN f.t_us>=(SELECT max(us) FROM tracks z WHERE z.dataset=f.dataset)-3600000000 THEN 'end_of_data' WHEN max(d.event_id) IS NULL THEN 'undecidable' WHEN bool_or(d.score>=0.7) THEN 'occluded' ELSE 'lost_on_open_cloth' END AS cause
 FROM fg f LEFT JOIN tracks d ON d.dataset=f.dataset AND d.source='scored' AND d.us BETWEEN f.t_us+1 AND f.t_us+3600000000 GROUP BY f.dataset, f.t_id, f.t_us)
SELECT dataset, cause, count(*) AS n FROM q GROUP BY ALL""", "tracks"))
def a29(spark, sf):
    t = B.tracks(spark, sf)
    f = frags(spark, sf).select("dataset", F.col("tail.event_id").alias("event_id"), (F.col("tail.us") + 1).alias("u0"), (F.col("tail.us") + SEC).alias("u1"))
    r = t.filter("source = 'scored'").withColumn("covered", F.col("score") >= 0.7)
    s = T.occlusion_status(f, r, ["dataset"], "u0", "u1", 12 * SEC).join(t.groupBy("dataset").agg(F.max("us").alias("last")), "dataset")
    cause = F.when(F.col("u1") >= F.col("last"), "end_of_data").when(F.col("occlusion") == "silent", "undecidable").when(F.col("occlusion") == "occluded", "occluded").otherwise("lost_on_open_cloth")
    return s.groupBy("dataset", cause.alias("cause")).agg(F.count(F.lit(1)).alias("n"))


@query("a32_compare_variants", B.sql(FRAG + """,
is2 AS (SELECT *, sum(CASE WHEN us-pu<=86400000000 THEN 0 ELSE 1 END) OVER (PARTITION BY dataset, track_id ORDER BY us, event_id) AS run FROM pv), g2 AS (SELECT dataset, track_id, run, count(*) AS hits FROM is2 GROUP BY ALL),
a AS (SELECT dataset, count(*) AS tracks_short, sum(hits)::BIGINT AS hits_short, count(*) FILTER (WHERE hits=1) AS singletons_short, max(hits) AS longest_short FROM fg GROUP BY dataset),
b AS (SELECT dataset, count(*) AS tracks_long, sum(hits)::BIGINT AS hits_long, count(*) FILTER (WHERE hits=1) AS singletons_long, max(hits) AS longest_long FROM g2 GROUP BY dataset) SELECT * FROM a JOIN b USING (dataset)""", "tracks"))
def a32(spark, sf):
    return E.compare_variants({"short": frags(spark, sf, 12), "long": frags(spark, sf, 24)})


@query("a26_quad_eval", B.sql("""
, q AS (SELECT dataset, source, (253.0::DOUBLE*x)/2 AS a, least(sqrt((x-126)*(x-126)+y*y*1.0), sqrt(x*x+(y-253)*(y-253)*1.0)) AS side, sqrt((x-126)*(x-126)+(y-253)*(y-253)*1.0)/4 AS distance, (abs(126*253.0)+abs(0*y-253.0*x))/2.0/(127*254) AS share FROM detections),
r AS (SELECT *, CASE WHEN side<8 THEN 'degenerate corner' WHEN NOT share BETWEEN 0.02 AND 0.9 THEN 'implausible' END AS reason FROM q)
SELECT dataset, source, count(*) AS n, count(*) FILTER (WHERE reason IS NOT NULL) AS rejected, count(*) FILTER (WHERE reason='degenerate corner') AS degenerate, round(avg(distance) FILTER (WHERE reason IS NULL),6) AS mean, count(*) FILTER (WHERE reason IS NULL AND distance<=20) AS within,
 round(quantile_cont(distance,0.9) FILTER (WHERE reason IS NULL),6) AS p90 FROM r GROUP BY ALL""".lstrip()[1:], "detections"))
def a26(spark, sf):
    q = F.array(G.point(0, 0), G.point(126, 0), G.point(F.col("x"), F.col("y")), G.point(0, 253))
    ref = F.array(G.point(0, 0), G.point(126, 0), G.point(126, 253), G.point(0, 253))
    d = B.detections(spark, sf).withColumn("reason", G.quad_sanity(q, 127.0, 254.0)).withColumn("distance", G.quad_distance(q, ref)["mean"])
    return rounded(E.quad_eval(d.select("dataset", "source", "reason", "distance"), ["dataset", "source"], 20.0))


@query("a33_passes_everywhere", """
WITH p AS (SELECT user_id AS rec, bool_and(value<150) AS passes, count(*) AS picks FROM events GROUP BY user_id), e AS (SELECT c_custkey AS rec, c_acctbal>5000 AS expected FROM customer)
SELECT coalesce(p.rec,e.rec) AS rec, passes, picks, expected, CASE WHEN passes IS NULL THEN 'not sampled' WHEN expected IS NULL THEN 'unexpected' WHEN passes=expected THEN 'as expected' ELSE 'gate failure' END AS outcome FROM p FULL JOIN e ON p.rec=e.rec""")
def a33(spark, sf):
    e = B.table(spark, sf, "events").select(F.col("user_id").alias("rec"), (F.col("value") < 150).alias("ok"))
    x = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("rec"), (F.col("c_acctbal") > 5000).alias("expected"))
    return E.passes_everywhere(e, x, "rec")


CELLS = """cl AS (SELECT dataset, frame_no, x//16 AS gx, y//16 AS gy, sum(event_id%97)::DOUBLE AS r0 FROM detections GROUP BY ALL), cm AS (SELECT dataset, frame_no, median(r0) AS m FROM cl GROUP BY ALL), cf AS (SELECT dataset, frame_no, gx, gy, greatest(0.0::DOUBLE, r0-m) AS response FROM cl JOIN cm USING (dataset, frame_no)),
sd AS (SELECT ((dataset*1000000+frame_no)*16+gx)*32+gy AS seed_id, dataset, frame_no, gx, gy, response FROM cf WHERE response>=60),
dr AS (SELECT * FROM (VALUES (0,2,0),(1,2,1),(2,1,2),(3,0,2),(4,-1,2),(5,-2,1),(6,-2,0),(7,-2,-1),(8,-1,-2),(9,0,-2),(10,1,-2),(11,2,-1)) d(dir,dx,dy)), hy AS (SELECT s.s AS speed, dir, (s.s-1)*12+dir AS v, s.s*dx AS vx, s.s*dy AS vy FROM dr, (VALUES (1),(2)) s(s)),
st AS (SELECT seed_id, dataset, frame_no+i AS f, v, speed, dir, gx+floor(vx*i/2.0)::BIGINT AS qx, gy+floor(vy*i/2.0)::BIGINT AS qy FROM sd, hy, (SELECT unnest(range(3)) AS i)),
sc AS (SELECT seed_id, v, speed, dir, CASE WHEN bool_and(qx>=0 AND qy>=0 AND qx<8 AND qy<16) THEN sum(coalesce(response,0))/3.0 ELSE -1 END AS score, count(*) FILTER (WHERE response>0)/3.0 AS cs FROM st LEFT JOIN cf ON cf.dataset=st.dataset AND cf.frame_no=f AND cf.gx=qx AND cf.gy=qy GROUP BY ALL),
be AS (SELECT seed_id, arg_min(v,(-score,v)) AS v, max(score) AS score, arg_min(speed,(-score,v)) AS speed, arg_min(dir,(-score,v)) AS dir, arg_min(cs,(-score,v)) AS cs FROM sc GROUP BY seed_id),
rv AS (SELECT b.seed_id, max(s.score) AS rival FROM be b JOIN sc s USING (seed_id) WHERE (s.dir=b.dir AND s.speed<>b.speed) OR (s.speed=b.speed AND (s.dir-b.dir+12)%12 IN (1,11)) GROUP BY b.seed_id),
bs AS (SELECT b.*, score>rival AS local_max FROM be b JOIN rv USING (seed_id) WHERE score>=0)"""


def cells(spark, sf):
    c = B.detections(spark, sf).groupBy("dataset", "frame_no", F.expr("x div 16").alias("gx"), F.expr("y div 16").alias("gy")).agg(F.sum(F.col("event_id") % 97).cast("double").alias("response"))
    return cut_lineage(TR.frame_floor(c))  # seeds and lookups read the same grid


def searched(spark, sf, low=60.0, high=1e9):
    c = cells(spark, sf)
    sid = ((F.col("dataset") * 1000000 + F.col("frame_no")) * 16 + F.col("gx")) * 32 + F.col("gy")
    seeds = c.filter((F.col("response") >= low) & (F.col("response") < high)).select(sid.alias("seed_id"), "dataset", "frame_no", "gx", "gy")
    return TR.best_hypothesis(TR.score_hypotheses(c, seeds, 3, 8, 16))


@query("j26_trajectory_search", B.sql(CELLS + "\nSELECT seed_id, v::INTEGER AS v, round(score,6) AS score, round(cs,6) AS coherent_share, local_max FROM bs", "detections"))
def j26(spark, sf):
    return rounded(searched(spark, sf).select("seed_id", "v", "score", "coherent_share", "local_max"))


@query("a34_null_bar", B.sql(CELLS.replace("WHERE response>=60", "WHERE response<20") + "\nSELECT seed_id//512//1000000 AS dataset, count(*) AS n, round(median(score),6) AS median, round(quantile_cont(score,0.95),6) AS bar FROM bs GROUP BY ALL", "detections"))
def a34(spark, sf):
    best = searched(spark, sf, 0.0, 20.0).withColumn("dataset", F.expr("(seed_id div 512) div 1000000"))
    return rounded(TR.null_bar(best, "dataset"))
