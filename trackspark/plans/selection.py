"""Selection, plan and id operators bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..operators import selection as S
from .judging import SEC
from .signals import rounded

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


CAND = """cd AS (SELECT dataset, event_id, kind, t, value+event_id%7/10.0::DOUBLE AS strength FROM claims),
tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, kind ORDER BY strength DESC, t, event_id) AS rn FROM cd) WHERE rn<=CASE kind WHEN 'pot' THEN 12 ELSE 8 END),
fr AS (SELECT dataset, event_id, strength, t, o, t+o AS at0 FROM tk, (VALUES ('pot',-1.25),('pot',-0.5),('pot',0.8),('pot',1.6),('shot',-1.0),('shot',-0.5),('shot',0.6),('shot',1.6)) v(k,o) WHERE k=kind AND t+o::DOUBLE>=0),
pf AS (SELECT dataset, round_even((t+o::DOUBLE)*10,0)::BIGINT AS tick, arg_min(event_id,(-strength,t,event_id,o)) AS event_id FROM fr GROUP BY ALL),
ch AS (SELECT DISTINCT dataset, round_even(t*10,0)::BIGINT AS tick FROM detections WHERE source='scored')"""


def cands(spark, sf):
    return B.claims(spark, sf).withColumn("strength", F.col("value") + F.col("event_id") % 7 / 10.0).select("dataset", "event_id", "kind", "t", "strength")


def cached(spark, sf):
    return B.detections(spark, sf).filter("source = 'scored'").select("dataset", F.rint(F.col("t") * 10).cast("long").alias("tick"))


def plan(spark, sf):
    return S.plan_frames(cands(spark, sf), cached(spark, sf), {"pot": (-1.25, -0.5, 0.8, 1.6), "shot": (-1.0, -0.5, 0.6, 1.6)}, {"pot": 12, "shot": 8})


@query("t1_plan_frames", B.sql(CAND + "\nSELECT p.dataset, p.tick, p.event_id, c.tick IS NOT NULL AS cached FROM pf p LEFT JOIN ch c USING (dataset, tick)", "claims"))
def t1(spark, sf):
    return plan(spark, sf)


@query("t2_select_for_gating", B.sql(CAND + """,
pl AS (SELECT DISTINCT event_id FROM pf), sp AS (SELECT * FROM cd WHERE event_id NOT IN (SELECT event_id FROM pl) ORDER BY strength DESC, t, event_id LIMIT 20),
sv AS (SELECT event_id, t, NULL::DOUBLE AS strength, event_id%100 AS id FROM detections WHERE value>=300),
al AS (SELECT event_id, strength, t, NULL::BIGINT AS id, 0 AS g, 'planned' AS measured FROM cd WHERE event_id IN (SELECT event_id FROM pl) UNION ALL SELECT event_id, strength, t, NULL, 1, 'control' FROM sp),
an AS (SELECT * FROM al UNION ALL SELECT event_id, strength, t, id, 2, 'served' FROM sv WHERE event_id NOT IN (SELECT event_id FROM al))
SELECT event_id, measured, coalesce(id, row_number() OVER (ORDER BY g, strength DESC NULLS LAST, t, event_id)-1+1001) AS id FROM an""", "claims"))
def t2(spark, sf):
    c = cands(spark, sf).withColumn("id", F.lit(None).cast("long"))
    served = B.detections(spark, sf).filter("value >= 300").select("event_id", "t", (F.col("event_id") % 100).alias("id"))
    return S.select_for_gating(c, plan(spark, sf), served).select("event_id", "measured", "id")


@query("t3_pending", B.sql("""
, rq AS (SELECT DISTINCT dataset, round_even(t*10,0)::BIGINT AS tick FROM detections), ca AS (SELECT DISTINCT dataset, round_even(t*10,0)::BIGINT AS tick FROM detections WHERE source='scored'), rf AS (SELECT DISTINCT dataset, round_even(t*10,0)::BIGINT AS tick FROM detections WHERE score>=0.9)
SELECT * FROM rq WHERE NOT EXISTS (SELECT 1 FROM ca WHERE ca.dataset=rq.dataset AND ca.tick=rq.tick) OR EXISTS (SELECT 1 FROM rf WHERE rf.dataset=rq.dataset AND rf.tick=rq.tick)""".lstrip()[1:], "detections"))
def t3(spark, sf):
    d = B.detections(spark, sf).withColumn("tick", F.rint(F.col("t") * 10).cast("long"))
    return S.pending(d, d.filter("source = 'scored'"), d.filter("score >= 0.9"), ["dataset", "tick"])


@query("t6_persistent_tracks", B.sql("""
SELECT dataset, track_id, count(DISTINCT frame_no) AS frames, min(frame_no) AS first_frame, max(frame_no) AS last_frame FROM tracks GROUP BY ALL ORDER BY frames DESC, first_frame, dataset, track_id LIMIT 10""", "tracks"))
def t6(spark, sf):
    return S.persistent_tracks(B.tracks(spark, sf), 10)


@query("t7_burst_plan", B.sql("""
, n AS (SELECT dataset, count(*) AS n_frames FROM detections GROUP BY dataset)
SELECT DISTINCT dataset, (n_frames*a)//16+k*15 AS frame FROM n, (SELECT unnest(range(16)) AS a), (SELECT unnest(range(10)) AS k) WHERE (n_frames*a)//16+k*15<n_frames""".lstrip()[1:], "detections"))
def t7(spark, sf):
    return S.burst_plan(B.detections(spark, sf).groupBy("dataset").agg(F.count(F.lit(1)).alias("n_frames")), 16, 10, 15)


@query("t8_backlog", "SELECT page_id, url FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels WHERE toxic=1) AND page_id NOT IN (SELECT conv_id FROM conversations WHERE turn>=4)")
def t8(spark, sf):
    p = B.table(spark, sf, "pages").select("page_id", "url")
    i = B.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("page_id"))
    q = B.table(spark, sf, "conversations").filter("turn >= 4").select(F.col("conv_id").alias("page_id"))
    return S.backlog(p, i, q, "page_id", ["page_id"])


IDS = """en AS (SELECT kind, event_id AS key, us FROM claims WHERE score>=0.3), pv AS (SELECT kind, event_id AS key, event_id*2 AS id FROM claims WHERE score<0.6)"""


def ids(spark, sf):
    c = B.claims(spark, sf)
    entries = c.filter("score >= 0.3").select("kind", F.col("event_id").alias("key"), "us")
    prev = c.filter("score < 0.6").select("kind", F.col("event_id").alias("key"), (F.col("event_id") * 2).alias("id"))
    reserved = c.agg((F.max("event_id") * 3).alias("id"))
    return S.assign_ids(entries, prev, reserved, ["kind", "key"], ["us", "key"], 24 * SEC)


@query("w19_assign_ids", B.sql(IDS + """,
nw AS (SELECT e.kind, e.key, row_number() OVER (ORDER BY us, e.key) AS rn FROM en e LEFT JOIN pv p ON p.kind=e.kind AND p.key=e.key WHERE p.key IS NULL)
SELECT e.kind, e.key, p.id FROM en e JOIN pv p ON p.kind=e.kind AND p.key=e.key UNION ALL SELECT kind, key, greatest((SELECT max(id) FROM pv),(SELECT max(event_id)*3 FROM claims))+rn FROM nw""", "claims"))
def w19(spark, sf):
    return ids(spark, sf)[0].select("kind", "key", "id")


@query("w19_departed_ids", B.sql(IDS + "\nSELECT kind, key, id FROM pv WHERE NOT EXISTS (SELECT 1 FROM en WHERE en.kind=pv.kind AND en.key=pv.key)", "claims"))
def w19d(spark, sf):
    return ids(spark, sf)[1].select("kind", "key", "id")


@query("w20_split_blocks", B.sql("""
, o AS (SELECT dataset, event_id, us, row_number() OVER (PARTITION BY dataset ORDER BY us, event_id) AS rn FROM series),
f AS (SELECT dataset, rn, event_id, us, us AS first, 0::BIGINT AS block FROM o WHERE rn=1 UNION ALL
 SELECT o.dataset, o.rn, o.event_id, o.us, CASE WHEN o.us-f.us>10800000000 OR o.us-f.first>=108000000000 THEN o.us ELSE f.first END, f.block + CASE WHEN o.us-f.us>10800000000 OR o.us-f.first>=108000000000 THEN 1 ELSE 0 END
 FROM f JOIN o ON o.dataset=f.dataset AND o.rn=f.rn+1),
b AS (SELECT dataset, block, min(us) AS b0, max(us) AS b1 FROM f GROUP BY ALL), n AS (SELECT *, lag(b1) OVER w AS pb, lead(b0) OVER w AS nb FROM b WINDOW w AS (PARTITION BY dataset ORDER BY block)),
j AS (SELECT f.dataset, event_id, us, block, CASE WHEN (pb IS NULL OR nb IS NULL OR b0-pb<18000000000 OR nb-b1<18000000000) AND (us-b0<18000000000 OR b1-us<18000000000) THEN 'dropped' WHEN block%4=3 THEN 'held' ELSE 'train' END AS side FROM f JOIN n USING (dataset, block))
SELECT dataset, event_id, block, CASE WHEN side='train' AND EXISTS (SELECT 1 FROM j h WHERE h.dataset=j.dataset AND h.side='held' AND abs(h.us-j.us)<18000000000) THEN 'dropped' ELSE side END AS side FROM j""".lstrip()[1:], "series", recursive=True))
def w20(spark, sf):
    return S.split_blocks(B.series(spark, sf), SEC)
