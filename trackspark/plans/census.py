"""Census, window and candidate operators bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..operators import calibration as C
from ..operators import census as N
from ..operators import joins as J
from ..operators import kernels as K
from ..operators import stats as T
from .geometry import r6
from .matching import GREEDY
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


def obs(spark, sf):
    return B.tracks(spark, sf)


CENSUS = """hits AS (SELECT dataset, track_id, count(*) AS hits FROM tracks GROUP BY ALL),
sn AS (SELECT DISTINCT t.dataset, t.track_id, frame_no, source, hits FROM tracks t JOIN hits h ON h.dataset=t.dataset AND h.track_id=t.track_id),
sp AS (SELECT dataset, unnest(range(a, b+1)) AS frame_no FROM (SELECT dataset, min(frame_no) AS a, max(frame_no) AS b FROM tracks GROUP BY dataset)),
cs AS (SELECT sp.dataset, sp.frame_no, count(*) FILTER (WHERE source='plain') AS plain_count, count(*) FILTER (WHERE source='scored') AS scored_count,
 count(*) FILTER (WHERE source='scored')>0 AS scored_frame, count(*) FILTER (WHERE source='scored' AND hits>=2) AS ss, count(*) FILTER (WHERE source='plain' AND hits>=2) AS ps,
 count(*) FILTER (WHERE source='scored' AND hits=1) AS s1, count(*) FILTER (WHERE source='plain' AND hits=1) AS p1 FROM sp LEFT JOIN sn ON sn.dataset=sp.dataset AND sn.frame_no=sp.frame_no GROUP BY ALL),
census AS (SELECT dataset, frame_no, CASE WHEN scored_frame THEN scored_count ELSE plain_count END AS count, plain_count, scored_count, CASE WHEN scored_frame THEN ss ELSE ps END AS stable_count,
 CASE WHEN scored_frame THEN s1 ELSE p1 END AS fresh_count, scored_frame FROM cs)"""


def census(spark, sf):
    o = obs(spark, sf)
    return N.build_census(o, N.frame_spine(o))


@query("a7_build_census", B.sql(CENSUS + "\nSELECT * FROM census", "tracks"))
def a7(spark, sf):
    return census(spark, sf)


WIN = CENSUS + """,
ew AS (SELECT c.event_id AS claim_id, c.color AS claim_color, c.kind, f.*, f.frame_no*14400000000 AS frame_us, CASE WHEN f.frame_no*14400000000<=c.us THEN 'pre' ELSE 'post' END AS side
 FROM claims c JOIN census f ON f.dataset=c.dataset AND f.frame_no*14400000000 BETWEEN c.us-28800000000 AND c.us+28800000000)"""


def frame_window(spark, sf):
    f = census(spark, sf).withColumn("frame_us", F.col("frame_no") * B.FRAME_US)
    return N.evidence_window(B.claims(spark, sf), f, 8 * SEC, 8 * SEC, 24 * SEC)


def obs_window(spark, sf, before=8, after=8):
    o = obs(spark, sf).select("dataset", "us", "frame_no", "track_id", "event_id", "color", "source", "x", "y", "score")
    return N.evidence_window(B.claims(spark, sf), o, before * SEC, after * SEC, 24 * SEC, "us")


@query("j24_evidence_window", B.sql(WIN + "\nSELECT claim_id, frame_no, side, count, scored_frame FROM ew", "tracks", "claims"))
def j24(spark, sf):
    return frame_window(spark, sf).select("claim_id", "frame_no", "side", "count", "scored_frame")


SUMMARY = WIN + """,
s0 AS (SELECT claim_id, count(*) FILTER (WHERE scored_frame AND side='pre')>0 AS sa, count(*) FILTER (WHERE scored_frame AND side='post')>0 AS sb,
 max(count) FILTER (WHERE scored_frame AND side='pre') AS ma, max(count) FILTER (WHERE scored_frame AND side='post') AS mb FROM ew GROUP BY claim_id),
s1 AS (SELECT claim_id, sa AND sb AS scored, sa=sb AS comparable, sa AND sb AND ma<2 AS low_pre, sa AND sb AND mb<2 AS low_post FROM s0),
s2 AS (SELECT ew.*, scored, comparable, low_pre, low_post, CASE WHEN scored THEN count ELSE plain_count END AS v,
 CASE WHEN scored THEN scored_frame AND (count>=2 OR CASE WHEN side='pre' THEN low_pre ELSE low_post END) ELSE NOT scored_frame END AS use FROM ew JOIN s1 USING (claim_id)),
s3 AS (SELECT claim_id, any_value(scored) AS scored, any_value(comparable) AS comparable, any_value(low_pre) AS low_pre, any_value(low_post) AS low_post,
 count(*) FILTER (WHERE use AND side='pre')::INTEGER AS frames_pre, count(*) FILTER (WHERE use AND side='post')::INTEGER AS frames_post, median(v) FILTER (WHERE use AND side='pre') AS census_pre,
 median(v) FILTER (WHERE use AND side='post') AS census_post, max(v) FILTER (WHERE use AND side='post') AS census_post_max,
 max(v) FILTER (WHERE use AND side='pre')-min(v) FILTER (WHERE use AND side='pre') AS spread_pre, max(v) FILTER (WHERE use AND side='post')-min(v) FILTER (WHERE use AND side='post') AS spread_post,
 count(*) FILTER (WHERE scored AND scored_frame AND NOT use AND side='pre')::INTEGER AS dropped_pre, count(*) FILTER (WHERE scored AND scored_frame AND NOT use AND side='post')::INTEGER AS dropped_post FROM s2 GROUP BY claim_id)"""


@query("a8_window_summary", B.sql(SUMMARY + """
SELECT claim_id, CASE WHEN scored THEN 'scored' ELSE 'plain' END AS source, comparable, frames_pre, frames_post, census_pre, census_post, census_post_max, spread_pre, spread_post, low_pre, low_post,
 dropped_pre, dropped_post, NOT scored OR coalesce(dropped_pre=0 AND dropped_post=0 AND spread_pre<=4 AND spread_post<=4, false) AS census_stable, census_pre-census_post AS census_drop FROM s3""", "tracks", "claims"))
def a8(spark, sf):
    return N.window_summary(frame_window(spark, sf))


OBSW = """ow AS (SELECT c.event_id AS claim_id, c.color AS claim_color, o.*, CASE WHEN o.us<=c.us THEN 'pre' ELSE 'post' END AS side
 FROM claims c JOIN tracks o ON o.dataset=c.dataset AND o.us BETWEEN c.us-28800000000 AND c.us+28800000000)"""


@query("a8_vanished_identities", B.sql(OBSW + """
SELECT claim_id, track_id, count(*) FILTER (WHERE side='pre') AS hits_pre, arg_max(event_id, (us,event_id)) FILTER (WHERE side='pre') AS last_id FROM ow GROUP BY ALL
HAVING count(*) FILTER (WHERE side='pre')>=2 AND count(*) FILTER (WHERE side='post')=0""", "tracks", "claims"))
def a8v(spark, sf):
    return N.vanished_identities(B.claims(spark, sf), obs(spark, sf), 8 * SEC, 24 * SEC, 32 * 24 * SEC).select("claim_id", "track_id", "hits_pre", F.col("last.event_id").alias("last_id"))


@query("a9_color_presence", B.sql(OBSW + """
SELECT claim_id, count(*) AS detections, count(*) FILTER (WHERE source='scored') AS scored, count(DISTINCT frame_no) AS hits,
 count(*) FILTER (WHERE source='scored')>=1 OR count(DISTINCT frame_no)>=2 AS measured FROM ow WHERE side='post' AND color=claim_color GROUP BY claim_id""", "tracks", "claims"))
def a9(spark, sf):
    return N.color_presence(obs_window(spark, sf))


@query("a10_track_summary", B.sql("""
, v AS (SELECT dataset, track_id, color, count(*) AS votes, max(us) AS lu, arg_max(event_id, us) AS le, sum(CASE WHEN source='scored' THEN least(1.0::DOUBLE,greatest(0.0::DOUBLE,(score-0.5)/0.5)) ELSE 0.5::DOUBLE END) AS conf,
 count(*) FILTER (WHERE source='scored') AS scored, min(us) AS fu FROM tracks GROUP BY ALL),
a AS (SELECT dataset, track_id, arg_min(color, (-votes, lu, le)) AS color, sum(votes)::BIGINT AS hits, (sum(votes)-max(votes))::BIGINT AS conflicts, sum(conf) AS conf, sum(scored)::BIGINT AS scored, min(fu) AS first_us, max(lu) AS last_us FROM v GROUP BY ALL)
SELECT dataset, track_id, color, hits, conflicts, scored, first_us, last_us, round(least(1.0,greatest(0.0, conf/hits + least(0.25, 0.1*(hits-1)) - CASE WHEN conflicts>0 THEN 0.15 ELSE 0 END)),9) AS confidence FROM a""".lstrip()[1:], "tracks"))
def a10(spark, sf):
    return rounded(N.track_summary(obs(spark, sf)), 9)


@query("p27_dedupe_samples", B.sql("""
, r AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY dataset, track_id, frame_no)-1 AS d FROM tracks WINDOW w AS (PARTITION BY dataset, track_id, frame_no ORDER BY score DESC, us, event_id))
SELECT dataset, track_id, count(*) AS samples, count(*) FILTER (WHERE score>=0.3) AS kept, sum(d)::BIGINT AS duplicates, sum(event_id)::BIGINT AS kept_ids,
 CASE WHEN count(*)<3 THEN 'track_too_short' WHEN count(*) FILTER (WHERE score>=0.3)<3 THEN 'below_confidence_floor' ELSE 'ok' END AS status FROM r WHERE rn=1 GROUP BY ALL""".lstrip()[1:], "tracks"))
def p27(spark, sf):
    d = N.dedupe_samples(obs(spark, sf), "score", 0.3)
    ids = d.groupBy(*N.TRACK).agg(F.sum("event_id").alias("kept_ids"))
    return N.sample_status(d).join(ids, list(N.TRACK))


@query("w14_kinematics", B.sql("""
, p AS (SELECT dataset, track_id, frame_no, max(us) AS us, arg_max(x,us) AS x, arg_max(y,us) AS y FROM tracks GROUP BY ALL),
v AS (SELECT *, (us-lag(us) OVER w)/3.6e9 AS dt, x-lag(x) OVER w AS dx, y-lag(y) OVER w AS dy FROM p WINDOW w AS (PARTITION BY dataset, track_id ORDER BY us)),
k AS (SELECT *, dx/dt AS vx, dy/dt AS vy FROM v), z AS (SELECT *, lag(vx) OVER w AS pvx, lag(vy) OVER w AS pvy FROM k WINDOW w AS (PARTITION BY dataset, track_id ORDER BY us))
SELECT dataset, track_id, frame_no, round(sqrt(vx*vx+vy*vy),6) AS speed, coalesce(sqrt(power(vx-pvx,2)+power(vy-pvy,2))>20,false) AS kink, coalesce(dt>0.15,false) AS bridged FROM z""".lstrip()[1:], "tracks"))
def w14(spark, sf):
    k = N.kinematics(obs(spark, sf), SEC, 240 * SEC, kink_speed=20.0)
    return k.select("dataset", "track_id", "frame_no", r6("speed").alias("speed"), "kink", "bridged")


def located(spark, sf):
    d = C.project_detections(B.detections(spark, sf), B.segments(spark, sf))
    return d.select("dataset", "frame_no", "us", "color", F.col("event_id").alias("id"), "x", "y", "mm")


FRAMES = """fr AS (SELECT dataset, frame_no, count(*) AS n, sum(event_id)%40 AS motion FROM detections GROUP BY ALL),
fm AS (SELECT *, quantile_cont(n,0.5) OVER (PARTITION BY dataset ORDER BY frame_no ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)::DOUBLE AS median, row_number() OVER (PARTITION BY dataset ORDER BY frame_no) AS i,
 lag(frame_no) OVER (PARTITION BY dataset ORDER BY frame_no) AS pf FROM fr)"""

DROPS = FRAMES + """,
lw AS (SELECT *, i-row_number() OVER (PARTITION BY dataset ORDER BY frame_no) AS run FROM fm WHERE n<=median-1),
ep AS (SELECT dataset, count(*) AS held, min(n) AS floor, min(frame_no) AS frame_no, arg_min(pf,frame_no) AS pf, arg_min(median,frame_no) AS median FROM lw GROUP BY dataset, run HAVING count(*)>=2),
gn AS (SELECT e.dataset, e.frame_no, r.event_id, r.color, r.mx, r.my FROM ep e JOIN resolved r ON r.dataset=e.dataset AND r.frame_no=e.pf WHERE NOT EXISTS (
 SELECT 1 FROM detections c WHERE c.dataset=e.dataset AND c.frame_no=e.frame_no AND c.color=r.color AND (c.x-r.x)*(c.x-r.x)+(c.y-r.y)*(c.y-r.y)<=900)),
gp AS (SELECT g.*, pocket, sqrt((mx-qx)*(mx-qx)+(my-qy)*(my-qy)) AS d, ord FROM gn g, pockets),
gb AS (SELECT dataset, frame_no, event_id, any_value(color) AS color, arg_min(pocket,(d,ord)) AS pocket, min(d) AS d, bool_and(mx BETWEEN -30 AND 1300 AND my BETWEEN -30 AND 2570) AS ok FROM gp GROUP BY ALL),
bs AS (SELECT dataset, frame_no, count(*) AS missing, arg_min(event_id,(d,event_id)) FILTER (WHERE ok) AS ball_id, arg_min(color,(d,event_id)) FILTER (WHERE ok) AS color, arg_min(pocket,(d,event_id)) FILTER (WHERE ok) AS pocket, min(d) FILTER (WHERE ok) AS pocket_mm FROM gb GROUP BY ALL)"""


def frames(spark, sf):
    return B.detections(spark, sf).groupBy("dataset", "frame_no").agg(F.count(F.lit(1)).alias("n"), (F.sum("event_id") % 40).alias("motion"))


def drops(spark, sf):
    return N.census_drops(frames(spark, sf).select("dataset", "frame_no", "n"), located(spark, sf), 30, hold=2)


@query("w9_census_drops", B.sql(DROPS + """
SELECT e.dataset, e.frame_no, held, floor, median, median-floor AS census_drop, coalesce(missing,0) AS missing, ball_id, color, pocket, round(pocket_mm,6) AS pocket_mm FROM ep e LEFT JOIN bs USING (dataset, frame_no)""",
 "detections", "resolved", "pockets"))
def w9(spark, sf):
    return rounded(drops(spark, sf))


SHOTS = GREEDY + ",\n" + FRAMES + """,
sh AS (SELECT c.dataset, c.frame_no, c.color, pid AS prev_id, cid AS cur_id, sqrt(power(p.mx-c.mx,2)+power(p.my-c.my,2)) AS disp FROM mt JOIN resolved p ON p.event_id=pid JOIN resolved c ON c.event_id=cid
 WHERE p.mx BETWEEN -30 AND 1300 AND p.my BETWEEN -30 AND 2570 AND c.mx BETWEEN -30 AND 1300 AND c.my BETWEEN -30 AND 2570
 AND EXISTS (SELECT 1 FROM detections q WHERE q.dataset=p.dataset AND q.color=p.color AND q.frame_no=p.frame_no-1 AND (q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y)<=3600)
 AND (c.frame_no=(SELECT max(frame_no) FROM detections z WHERE z.dataset=c.dataset) OR EXISTS (SELECT 1 FROM detections q WHERE q.dataset=c.dataset AND q.color=c.color AND q.frame_no=c.frame_no+1 AND (q.x-c.x)*(q.x-c.x)+(q.y-c.y)*(q.y-c.y)<=6400))),
so AS (SELECT dataset, frame_no, 'pair' AS source, color, prev_id, cur_id, disp AS disp_mm, disp/4.0 AS speed_mm_s FROM sh WHERE disp>=300 AND disp/4.0 BETWEEN 100 AND 11000
 UNION ALL SELECT dataset, frame_no, 'motion', NULL, NULL, NULL, NULL, NULL FROM fm WHERE motion>=18 AND median IS NOT NULL AND abs(n-median)<=1)"""


def shots(spark, sf):
    b = located(spark, sf)
    slim = b.select("dataset", "frame_no", "color", "id", "x", "y")
    matched = J.match_frames(slim.withColumn("frame_no", F.col("frame_no") + 1), slim, 60).filter("prev_id is not null and cur_id is not null")
    held = J.streak_at_least(b, J.previous_links(slim), 2)
    nxt = slim.select("dataset", "color", (F.col("frame_no") - 1).alias("frame_no"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    stays = J.near_pairs(slim, nxt, ["dataset", "color", "frame_no"], 80, ("x", "y"), ("nx", "ny")).select("id")
    last = slim.join(slim.groupBy("dataset").agg(F.max("frame_no").alias("frame_no")), ["dataset", "frame_no"]).select("id")
    pairs = N.shot_candidates(matched, held, stays.unionByName(last), gap_s=4.0, lo=100.0)
    f = T.running_median(frames(spark, sf), ["dataset"], "frame_no", "n", 40, 4096)
    motion = N.motion_candidates(f).select("dataset", "frame_no", F.lit("motion").alias("source"))
    return pairs.select("dataset", "frame_no", F.lit("pair").alias("source"), "color", "prev_id", "cur_id", "disp_mm", "speed_mm_s").unionByName(motion, allowMissingColumns=True)


@query("w10_shot_candidates", B.sql(SHOTS + "\nSELECT dataset, frame_no, source, color, prev_id, cur_id, round(disp_mm,6) AS disp_mm, round(speed_mm_s,6) AS speed_mm_s FROM so", "detections", "resolved", recursive=True))
def w10(spark, sf):
    return rounded(shots(spark, sf))


@query("j12_displacement", B.sql(OBSW + """,
sd AS (SELECT claim_id, claim_color, side, track_id, avg(x*10.0::DOUBLE) AS mx, avg(y*10.0::DOUBLE) AS my, count(*) AS hits, arg_min(color,(us,event_id)) AS color FROM ow
 WHERE source='scored' AND abs(us-(SELECT us FROM detections d WHERE d.event_id=claim_id))>=1080000000 AND (claim_id % 2 = 1) GROUP BY ALL),
pr AS (SELECT a.claim_id, a.claim_color, a.track_id AS aid, b.track_id AS bid, sqrt(power(a.mx-b.mx,2)+power(a.my-b.my,2)) AS d, a.color AS ac, b.color AS bc, a.hits AS ah, b.hits AS bh FROM sd a JOIN sd b ON a.claim_id=b.claim_id WHERE a.side='pre' AND b.side='post'),
od AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY d, aid, bid) AS rn FROM pr),
fold AS (SELECT DISTINCT claim_id, 0::BIGINT AS rn, []::BIGINT[] AS ua, []::BIGINT[] AS ub, false AS ok FROM od UNION ALL
 SELECT f.claim_id, o.rn, CASE WHEN list_contains(ua,aid) OR list_contains(ub,bid) THEN ua ELSE list_append(ua,aid) END, CASE WHEN list_contains(ua,aid) OR list_contains(ub,bid) THEN ub ELSE list_append(ub,bid) END,
 NOT (list_contains(ua,aid) OR list_contains(ub,bid)) FROM fold f JOIN od o ON o.claim_id=f.claim_id AND o.rn=f.rn+1),
mv AS (SELECT o.*, round_even(d,0) AS dist, claim_color=ac OR claim_color=bc AS w FROM od o JOIN fold f USING (claim_id, rn) WHERE ok)
SELECT claim_id, count(*) AS measured, count(*) FILTER (WHERE dist>=300) AS moved, count(*) FILTER (WHERE dist<=60) AS still, arg_min(w,(NOT w,-dist,aid)) FILTER (WHERE dist>=300) AS claim_color_measured,
 arg_min(dist,(NOT w,-dist,aid)) FILTER (WHERE dist>=300) AS disp_mm, arg_min(ac,(NOT w,-dist,aid)) FILTER (WHERE dist>=300) AS color, arg_min(ah,(NOT w,-dist,aid)) FILTER (WHERE dist>=300) AS start_hits,
 arg_min(bh,(NOT w,-dist,aid)) FILTER (WHERE dist>=300) AS end_hits FROM mv GROUP BY claim_id""", "tracks", "claims", recursive=True))
def j12(spark, sf):
    margin = int(0.3 * SEC)
    w = obs_window(spark, sf).filter((F.col("kind") == "shot") & (F.col("source") == "scored") & (F.abs(F.col("us") - F.col("claim_us")) >= margin))
    return N.displacement(w.withColumn("mx", F.col("x") * 10.0).withColumn("my", F.col("y") * 10.0))
