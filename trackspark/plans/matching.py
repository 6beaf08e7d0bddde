"""Join operators bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..operators import joins as J
from ..operators.kernels import shuffled
from .geometry import query as _q, r6

QUERIES, ORACLE = {}, {}
H = B.HOUR_US


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def halves(spark, sf):
    s = B.series(spark, sf).select("event_id", "dataset", "us", "signal")
    return s.filter("event_id % 2 = 0"), s.filter("event_id % 2 = 1").select("dataset", "us", F.col("event_id").alias("rid"), F.col("signal").alias("rsignal"))


def balls(spark, sf):
    return B.detections(spark, sf).withColumnRenamed("event_id", "id")


@query("j1_asof_first", B.sql("""
SELECT l.event_id, arg_min(r.event_id, r.event_id) AS rid, arg_min(r.signal, r.event_id) AS rsignal FROM series l JOIN series r
 ON l.dataset=r.dataset AND abs(l.us-r.us)<=360000000 WHERE l.event_id%2=0 AND r.event_id%2=1 GROUP BY l.event_id""", "series"))
def j1(spark, sf):
    l, r = halves(spark, sf)
    return J.asof_first(l, r, ["dataset"], "us", H // 10, "rid", ["rid", "rsignal"]).select("event_id", "match.rid", "match.rsignal")


@query("j4_window_lookup", B.sql("""
SELECT l.event_id, r.event_id AS rid FROM series l JOIN series r ON l.dataset=r.dataset AND abs(l.us-r.us)<=3*3600000000
WHERE l.event_id%2=0 AND r.event_id%2=1""", "series"))
def j4(spark, sf):
    l, r = halves(spark, sf)
    r = r.select("dataset", "rid", F.col("us").alias("rus"))
    return J.range_pairs(l, r, ["dataset"], "us", "rus", -3 * H, 3 * H, 12 * H).select("event_id", "rid")


@query("j5_nearest_time", B.sql("""
SELECT l.event_id, arg_min(r.event_id, (abs(l.us-r.us), r.us, r.event_id)) AS rid FROM series l JOIN series r ON l.dataset=r.dataset
WHERE l.event_id%2=0 AND r.event_id%2=1 GROUP BY l.event_id""", "series"))
def j5(spark, sf):
    l, r = halves(spark, sf)
    return J.nearest_time(l, r, ["dataset"], "us", ["rid"]).select("event_id", F.col("nearest.rid").alias("rid"))


GREEDY = """
, pairs AS (SELECT *, row_number() OVER (PARTITION BY dataset, frame_no, color ORDER BY d2, pid, cid) AS rn FROM (
 SELECT c.dataset, c.frame_no, c.color, (c.x-p.x)*(c.x-p.x)+(c.y-p.y)*(c.y-p.y) AS d2, p.event_id AS pid, c.event_id AS cid
 FROM detections c JOIN detections p ON c.dataset=p.dataset AND c.color=p.color AND p.frame_no=c.frame_no-1) WHERE d2<=3600),
fold AS (SELECT DISTINCT dataset, frame_no, color, 0::BIGINT AS rn, []::BIGINT[] AS up, []::BIGINT[] AS uc, NULL::BIGINT AS pid, NULL::BIGINT AS cid, NULL::BIGINT AS d2 FROM pairs
 UNION ALL SELECT f.dataset, f.frame_no, f.color, p.rn, CASE WHEN free THEN list_append(up,p.pid) ELSE up END, CASE WHEN free THEN list_append(uc,p.cid) ELSE uc END,
  CASE WHEN free THEN p.pid END, CASE WHEN free THEN p.cid END, CASE WHEN free THEN p.d2 END
 FROM (SELECT f.*, NOT list_contains(f.up,p.pid) AND NOT list_contains(f.uc,p.cid) AS free, p.pid AS ppid FROM fold f JOIN pairs p
  ON p.dataset=f.dataset AND p.frame_no=f.frame_no AND p.color=f.color AND p.rn=f.rn+1) f JOIN pairs p
  ON p.dataset=f.dataset AND p.frame_no=f.frame_no AND p.color=f.color AND p.rn=f.rn+1),
st1 AS (SELECT dataset, frame_no, color, pid, cid, d2 FROM fold WHERE pid IS NOT NULL),
cnt AS (SELECT dataset, frame_no, color, count(*) AS n, min(event_id) AS id, min(x) AS x, min(y) AS y FROM detections GROUP BY ALL),
st2 AS (SELECT c.dataset, c.frame_no, c.color, p.id AS pid, c.id AS cid, (c.x-p.x)*(c.x-p.x)+(c.y-p.y)*(c.y-p.y) AS d2 FROM cnt c JOIN cnt p
 ON c.dataset=p.dataset AND c.color=p.color AND p.frame_no=c.frame_no-1 WHERE c.n=1 AND p.n=1 AND (c.x-p.x)*(c.x-p.x)+(c.y-p.y)*(c.y-p.y)>3600),
mt AS (SELECT *, 1 AS stage FROM st1 UNION ALL SELECT *, 2 FROM st2)"""[2:]


@query("j6_match_frames", B.sql(GREEDY + """
SELECT dataset, frame_no, color, pid AS prev_id, cid AS cur_id, d2, stage FROM mt
UNION ALL SELECT dataset, frame_no+1, color, event_id, NULL, NULL, NULL FROM detections WHERE event_id NOT IN (SELECT pid FROM mt)
UNION ALL SELECT dataset, frame_no, color, NULL, event_id, NULL, NULL FROM detections WHERE event_id NOT IN (SELECT cid FROM mt)""", "detections", recursive=True))
def j6(spark, sf):
    b = balls(spark, sf).select("dataset", "frame_no", "color", "id", "x", "y")
    return J.match_frames(b.withColumn("frame_no", F.col("frame_no") + 1), b, 60)


@query("j7_lookback", B.sql("""
, s AS (SELECT d.*, EXISTS (SELECT 1 FROM detections p WHERE p.dataset=d.dataset AND p.color=d.color AND p.frame_no=d.frame_no-1
  AND (p.x-d.x)*(p.x-d.x)+(p.y-d.y)*(p.y-d.y)<=3600) AS held FROM detections d)
SELECT c.event_id, max((c.x-p.x)*(c.x-p.x)+(c.y-p.y)*(c.y-p.y))::BIGINT AS d2, arg_max(p.event_id, ((c.x-p.x)*(c.x-p.x)+(c.y-p.y)*(c.y-p.y), p.event_id)) AS from_id
FROM s c JOIN s p ON c.dataset=p.dataset AND c.color=p.color AND c.us-p.us BETWEEN 1800000000 AND 7200000000
WHERE p.held AND (c.x-p.x)*(c.x-p.x)+(c.y-p.y)*(c.y-p.y)<=176400 GROUP BY c.event_id""".lstrip()[1:], "detections"))
def j7(spark, sf):
    b = balls(spark, sf).select("dataset", "color", "frame_no", "us", "id", "x", "y")
    held = J.streak_at_least(b, J.previous_links(b), 2).filter("streak >= 2")
    p = held.select("dataset", "color", F.col("us").alias("pus"), F.col("id").alias("pid"), F.col("x").alias("px"), F.col("y").alias("py"))
    pairs = J.range_pairs(b, p, ["dataset", "color"], "us", "pus", H // 2, 2 * H, 6 * H)
    d2 = (F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py"))
    best = pairs.withColumn("d2", d2).filter("d2 <= 420 * 420").groupBy("id").agg(F.max(F.struct("d2", "pid")).alias("b"))
    return best.select(F.col("id").alias("event_id"), F.col("b.d2").alias("d2"), F.col("b.pid").alias("from_id"))


@query("j8_persistence", B.sql("""
, fr AS (SELECT DISTINCT dataset, frame_no FROM detections),
a AS (SELECT d.event_id, d.dataset, d.x, d.y, d.frame_no+s.s AS other FROM detections d, (VALUES (-2),(-1),(1),(2)) s(s)),
k AS (SELECT a.event_id, count(*) AS checks, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM detections o WHERE o.dataset=a.dataset AND o.frame_no=a.other
  AND (o.x-a.x)*(o.x-a.x)+(o.y-a.y)*(o.y-a.y)<=144)) AS hits FROM a JOIN fr ON fr.dataset=a.dataset AND fr.frame_no=a.other GROUP BY ALL),
lst AS (SELECT dataset, max(frame_no) AS last_no FROM detections GROUP BY dataset)
SELECT d.event_id, coalesce(hits*1.0::DOUBLE/checks,0) AS support, coalesce(hits*1.0/checks,0)>=0.6 AS kept,
 d.frame_no=last_no OR EXISTS (SELECT 1 FROM detections o WHERE o.dataset=d.dataset AND o.color=d.color AND o.frame_no=d.frame_no+1
  AND (o.x-d.x)*(o.x-d.x)+(o.y-d.y)*(o.y-d.y)<=6400) AS persists
FROM detections d LEFT JOIN k USING (event_id) JOIN lst USING (dataset)""".lstrip()[1:], "detections"))
def j8(spark, sf):
    b = balls(spark, sf).select("dataset", "color", "frame_no", "id", "x", "y")
    soft = J.persistence_filter(b, b, 12)
    nxt = b.select("dataset", "color", (F.col("frame_no") - 1).alias("frame_no"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    kept = J.near_pairs(b, nxt, ["dataset", "color", "frame_no"], 80, ("x", "y"), ("nx", "ny")).select("id").distinct().withColumn("stays", F.lit(True))
    last = b.groupBy("dataset").agg(F.max("frame_no").alias("last_no"))
    return soft.join(shuffled(kept), "id", "left").join(last, "dataset").select(
        F.col("id").alias("event_id"), "support", "kept", (F.coalesce("stays", F.lit(False)) | (F.col("frame_no") == F.col("last_no"))).alias("persists"))


@query("j9_vanished", B.sql("""
SELECT p.event_id, p.dataset, p.frame_no+1 AS frame_no FROM detections p WHERE NOT EXISTS (SELECT 1 FROM detections c WHERE c.dataset=p.dataset
 AND c.color=p.color AND c.frame_no=p.frame_no+1 AND (c.x-p.x)*(c.x-p.x)+(c.y-p.y)*(c.y-p.y)<=900)""", "detections"))
def j9(spark, sf):
    b = balls(spark, sf).select("dataset", "frame_no", "color", "id", "x", "y")
    return J.vanished(b.withColumn("frame_no", F.col("frame_no") + 1), b, 30, ["dataset", "frame_no", "color"]).select(
        F.col("id").alias("event_id"), "dataset", "frame_no")


@query("j10_match_truth", B.sql("""
, near AS (SELECT p.dataset, p.frame_no, p.event_id AS pid, p.score, list({'d2':(p.x-t.x)*(p.x-t.x)+(p.y-t.y)*(p.y-t.y), 'tid':t.event_id}
   ORDER BY (p.x-t.x)*(p.x-t.x)+(p.y-t.y)*(p.y-t.y), t.event_id) AS offers FROM detections p JOIN detections t ON p.dataset=t.dataset AND p.frame_no=t.frame_no
  AND (p.x-t.x)*(p.x-t.x)+(p.y-t.y)*(p.y-t.y)<=36 WHERE p.event_id%2=1 AND t.event_id%2=0 GROUP BY ALL),
walk AS (SELECT *, row_number() OVER (PARTITION BY dataset, frame_no ORDER BY score DESC, pid) AS rn FROM near),
fold AS (SELECT DISTINCT dataset, frame_no, 0::BIGINT AS rn, []::BIGINT[] AS used, NULL::BIGINT AS pid, NULL::STRUCT(d2 BIGINT, tid BIGINT) AS pick FROM walk
 UNION ALL SELECT dataset, frame_no, rn, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick.tid) END, pid, pick FROM (
  SELECT f.dataset, f.frame_no, w.rn, f.used, w.pid, list_filter(w.offers, lambda o: NOT list_contains(f.used, o.tid))[1] AS pick
  FROM fold f JOIN walk w ON w.dataset=f.dataset AND w.frame_no=f.frame_no AND w.rn=f.rn+1))
SELECT dataset, frame_no, pid AS pred_id, pick.tid AS truth_id, pick.d2 AS d2 FROM fold WHERE pick IS NOT NULL""".lstrip()[1:], "detections", recursive=True))
def j10(spark, sf):
    b = balls(spark, sf).select("dataset", "frame_no", "id", "x", "y", "score")
    return J.match_truth(b.filter("id % 2 = 1"), b.filter("id % 2 = 0"), 6)


@query("j11_moving_pairs", B.sql("""
, n AS (SELECT c.dataset, c.color, c.frame_no, p.event_id AS pid, c.event_id AS cid, (c.x-p.x)*(c.x-p.x)+(c.y-p.y)*(c.y-p.y) AS d2 FROM detections c
 JOIN detections p ON c.dataset=p.dataset AND c.color=p.color AND p.frame_no=c.frame_no-1 WHERE (c.x-p.x)*(c.x-p.x)+(c.y-p.y)*(c.y-p.y)<=250000),
r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d2, cid) AS rp, row_number() OVER (PARTITION BY cid ORDER BY d2, pid) AS rc FROM n),
k AS (SELECT dataset, color, frame_no, count(*) AS n FROM detections GROUP BY ALL)
SELECT r.pid AS prev_id, r.cid AS cur_id, r.d2, a.n>1 OR b.n>1 AS ambiguous FROM r JOIN k a ON a.dataset=r.dataset AND a.color=r.color AND a.frame_no=r.frame_no-1
 JOIN k b ON b.dataset=r.dataset AND b.color=r.color AND b.frame_no=r.frame_no WHERE rp=1 AND rc=1 AND d2>=25""".lstrip()[1:], "detections"))
def j11(spark, sf):
    keys = ["dataset", "color", "frame_no"]
    b = balls(spark, sf).select(*keys, "id", "x", "y")
    prev = b.withColumn("frame_no", F.col("frame_no") + 1)
    n = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("nc"))
    before = n.select("dataset", "color", (F.col("frame_no") + 1).alias("frame_no"), F.col("nc").alias("np"))
    return J.mutual_nearest(prev, b, keys, 500, 5).join(n, keys).join(before, keys).select(
        "prev_id", "cur_id", "d2", ((F.col("nc") > 1) | (F.col("np") > 1)).alias("ambiguous"))


@query("j19_double_claims", B.sql("""
SELECT a.dataset, a.frame_no, a.event_id AS id_a, b.event_id AS id_b, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS d2 FROM detections a JOIN detections b
 ON a.dataset=b.dataset AND a.frame_no=b.frame_no AND a.user_id<>b.user_id AND a.event_id<b.event_id WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<=144""", "detections"))
def j19(spark, sf):
    o = B.tracks(spark, sf).withColumnRenamed("event_id", "id")
    return J.double_claims(o).select("dataset", "frame_no", "id_a", "id_b", "d2")


@query("w1_streaks", B.sql("""
, l AS (SELECT c.event_id AS id, arg_min(p.event_id, ((c.x-p.x)*(c.x-p.x)+(c.y-p.y)*(c.y-p.y), p.event_id)) AS prev_id FROM detections c JOIN detections p
 ON c.dataset=p.dataset AND c.color=p.color AND p.frame_no=c.frame_no-1 WHERE (c.x-p.x)*(c.x-p.x)+(c.y-p.y)*(c.y-p.y)<=3600 GROUP BY c.event_id),
k AS (SELECT event_id AS id, 1::BIGINT AS streak FROM detections WHERE event_id NOT IN (SELECT id FROM l)
 UNION ALL SELECT l.id, k.streak+1 FROM k JOIN l ON l.prev_id=k.id)
SELECT id AS event_id, streak, least(streak,3)::BIGINT AS capped FROM k""".lstrip()[1:], "detections", recursive=True))
def w1(spark, sf):
    b = balls(spark, sf).select("dataset", "color", "frame_no", "id", "x", "y")
    links = J.previous_links(b)
    exact = J.streak_length(b, links)
    capped = J.streak_at_least(b, links, 3, "capped").select("id", "capped")
    return exact.join(shuffled(capped), "id").select(F.col("id").alias("event_id"), F.col("streak").cast("long").alias("streak"), F.col("capped").cast("long").alias("capped"))
