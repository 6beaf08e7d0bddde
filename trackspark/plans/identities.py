"""Face, embedding and identity operators bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..functions import scalars as P
from ..operators import identity as I
from ..operators import kernels as K
from .signals import rounded

QUERIES, ORACLE = {}, {}
BAR = 0.40


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


@query("p22_face_quality", B.sql("""
SELECT vec_id, eye_px>=8 AND det_score>=0.4 AS quality, round(det_score*eye_px,6) AS rank_value, CASE WHEN vec_id*7%300<90 THEN 'far' WHEN vec_id*7%300<180 THEN 'mid' ELSE 'near' END AS bucket,
 CASE WHEN power(vec_id*13%127-0,2)+power(vec_id*31%254-120,2) <= power(vec_id*13%127-127,2)+power(vec_id*31%254-120,2) THEN 'left' ELSE 'right' END AS side FROM faces""", "faces"))
def p22(spark, sf):
    f = B.faces(spark, sf)
    i = F.col("vec_id")
    return f.select("vec_id", P.face_quality(F.col("eye_px"), F.col("det_score")).alias("quality"), F.round(P.rank_score(F.col("det_score"), F.col("eye_px")), 6).alias("rank_value"),
                    P.height_bucket(i * 7 % 300).alias("bucket"), P.table_role(i * 13 % 127, i * 31 % 254, (0, 120), (127, 120)).alias("side"))


@query("p23_cosine", B.sql("""
, z AS (SELECT vec_id, CASE WHEN vec_id%50=0 THEN list_transform(vec, lambda x: 0.0::DOUBLE) ELSE vec END AS vec FROM faces)
SELECT a.vec_id, CASE WHEN list_dot_product(a.vec,a.vec)<=0 OR list_dot_product(b.vec,b.vec)<=0 THEN 0 ELSE round(list_dot_product(a.vec,b.vec)/(sqrt(list_dot_product(a.vec,a.vec))*sqrt(list_dot_product(b.vec,b.vec))),6) END::DOUBLE AS cosine
FROM z a JOIN z b ON b.vec_id=a.vec_id+1""".lstrip()[1:], "faces"))
def p23(spark, sf):
    f = B.faces(spark, sf).select("vec_id", F.when(F.col("vec_id") % 50 == 0, F.transform("vec", lambda x: F.lit(0.0))).otherwise(F.col("vec")).alias("vec"))
    nxt = f.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("v2"))
    return f.join(nxt, "vec_id").select("vec_id", F.round(P.cosine(F.col("vec"), F.col("v2")), 6).alias("cosine"))


@query("j13_associate_faces", B.sql("""
, p AS (SELECT dataset, frame_no, event_id AS pid, x AS x0, y AS y0, x+20+event_id%40 AS x1, y+20+user_id%40 AS y1 FROM detections WHERE source='plain'),
f AS (SELECT dataset, frame_no, event_id AS fid, x+4.0 AS cx, y+4.0 AS cy, event_id%20 AS eye, score FROM detections WHERE source='scored'),
c AS (SELECT f.dataset, f.frame_no, fid, count(*) AS claims, any_value(pid) AS pid, any_value(eye) AS eye, any_value(score) AS score FROM f JOIN p ON p.dataset=f.dataset AND p.frame_no=f.frame_no AND cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1 GROUP BY ALL)
SELECT dataset, frame_no, pid AS person_id, min(fid) AS face_id, count(*) AS usable FROM (SELECT dataset, frame_no, fid, sum(claims) AS n, any_value(pid) AS pid, any_value(eye) AS eye, any_value(score) AS score FROM c GROUP BY ALL) WHERE n=1 AND eye>=8 AND score>=0.4 GROUP BY ALL""".lstrip()[1:], "detections"))
def j13(spark, sf):
    d = B.detections(spark, sf)
    p = d.filter("source = 'plain'").select("dataset", "frame_no", F.col("event_id").alias("person_id"), F.col("x").alias("px0"), F.col("y").alias("py0"),
                                            (F.col("x") + 20 + F.col("event_id") % 40).alias("px1"), (F.col("y") + 20 + F.col("user_id") % 40).alias("py1"))
    f = d.filter("source = 'scored'").select("dataset", "frame_no", F.col("event_id").alias("face_id"), F.col("x").alias("fx0"), F.col("y").alias("fy0"),
                                             (F.col("x") + 8).alias("fx1"), (F.col("y") + 8).alias("fy1"), (F.col("event_id") % 20).alias("eye_px"), F.col("score").alias("det_score"))
    return I.associate_faces(p, f)


MATCH = """sm AS (SELECT p.vec_id, p.expected, p.role, g.player, max(list_dot_product(p.vec,g.vec)/(sqrt(list_dot_product(p.vec,p.vec))*sqrt(list_dot_product(g.vec,g.vec)))) AS sim FROM probes p, gallery g GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, player) AS rn FROM sm),
mg AS (SELECT a.vec_id, a.expected, a.role, a.player, a.sim AS similarity, b.sim AS runner_up, a.sim>=0.35 AND coalesce(a.sim-b.sim>=0.12,true) AS accepted, a.sim>=0.40 AND coalesce(a.sim-b.sim>=0.12,true) AS bound
 FROM rk a LEFT JOIN rk b ON b.vec_id=a.vec_id AND b.rn=2 WHERE a.rn=1)"""


def matched(spark, sf):
    return I.match_gallery(B.probes(spark, sf), B.gallery(spark, sf), bind_bar=BAR, keep=["expected", "role"])


@query("j14_match_gallery", B.sql(MATCH + "\nSELECT vec_id, expected, role, player, round(similarity,6) AS similarity, round(runner_up,6) AS runner_up, accepted, bound FROM mg", "gallery", "probes"))
def j14(spark, sf):
    return rounded(matched(spark, sf))


@query("a14_evaluate_binding", B.sql(MATCH + """
SELECT role, count(*) AS n, count(*) FILTER (WHERE accepted AND player=expected) AS correct, count(*) FILTER (WHERE accepted AND player<>expected) AS wrong, count(*) FILTER (WHERE bound) AS bound,
 count(*) FILTER (WHERE similarity<0.35) AS below_threshold, count(*) FILTER (WHERE similarity<0.40) AS below_bind_bar, count(*) FILTER (WHERE similarity>=0.35 AND similarity-runner_up<0.12) AS ambiguous, grouping(role)::BIGINT AS level,
 count(*)-count(*) FILTER (WHERE accepted) AS unmatched, round(count(*) FILTER (WHERE accepted AND player=expected)/count(*),6) AS accuracy FROM mg GROUP BY ROLLUP (role)""", "gallery", "probes"))
def a14(spark, sf):
    return rounded(I.evaluate_binding(matched(spark, sf), bar=BAR))


@query("a15_bind_counts", B.sql(MATCH + """
SELECT g.player, count(*) FILTER (WHERE s.expected=g.player) AS own_n, count(*) FILTER (WHERE s.expected=g.player AND sim>=0.3) AS own_bound, count(*) FILTER (WHERE s.expected<>g.player) AS other_n,
 count(*) FILTER (WHERE s.expected<>g.player AND sim>=0.3) AS other_clearing FROM (SELECT DISTINCT player FROM gallery) g JOIN sm s ON s.player=g.player GROUP BY g.player""", "gallery", "probes"))
def a15(spark, sf):
    return I.bind_counts(B.probes(spark, sf), B.gallery(spark, sf), 0.3)


def instances(spark, sf):
    return B.faces(spark, sf).withColumn("inside", F.col("vec_id") % 3 != 0).withColumn("bucket", P.height_bucket(F.col("vec_id") * 7 % 300))


@query("a11_detectability", B.sql("""
, i AS (SELECT *, vec_id%3<>0 AS inside, CASE WHEN vec_id*7%300<90 THEN 'far' WHEN vec_id*7%300<180 THEN 'mid' ELSE 'near' END AS bucket, eye_px>=8 AND det_score>=0.4 AS q FROM faces)
SELECT CASE WHEN grouping(bucket)=0 THEN 'bucket' WHEN grouping(role)=0 THEN 'role' WHEN grouping(burst)=0 THEN 'burst' ELSE 'all' END AS grouping, coalesce(bucket, role::VARCHAR, burst::VARCHAR, 'all') AS value, count(*) AS instances, count(*) FILTER (WHERE inside) AS inside_box,
 count(*) FILTER (WHERE eye_px>=8) AS eye_pass, count(*) FILTER (WHERE det_score>=0.4) AS det_pass, count(*) FILTER (WHERE q) AS quality_pass, count(*) FILTER (WHERE q AND inside) AS selected, round(count(*) FILTER (WHERE q AND inside)/count(*),6) AS yield_rate
FROM i GROUP BY GROUPING SETS ((bucket),(role),(burst),())""".lstrip()[1:], "faces"))
def a11(spark, sf):
    return rounded(I.detectability(instances(spark, sf), ["bucket", "role", "burst"]))


def usable(spark, sf):
    f = B.faces(spark, sf)
    return f.filter(P.face_quality(F.col("eye_px"), F.col("det_score")))


COS = "list_dot_product(a.vec,b.vec)/(sqrt(list_dot_product(a.vec,a.vec))*sqrt(list_dot_product(b.vec,b.vec)))"


@query("a12_separation", B.sql(f"""
u AS (SELECT * FROM faces WHERE eye_px>=8 AND det_score>=0.4),
c AS (SELECT 'within' AS kind, {COS} AS c FROM u a JOIN u b ON a.tracklet=b.tracklet AND a.vec_id<b.vec_id AND a.frame<>b.frame UNION ALL SELECT 'cross', {COS} FROM u a JOIN u b ON a.frame=b.frame AND a.vec_id<b.vec_id AND a.tracklet<>b.tracklet)
SELECT kind, count(*) AS n, round(min(c),6) AS min, round(max(c),6) AS max, round(quantile_cont(c,0.05),6) AS p05, round(median(c),6) AS median, round(quantile_cont(c,0.95),6) AS p95, round(avg((c>=0.35)::INT),6) AS ge_threshold, round(avg((c>=0.47)::INT),6) AS ge_bind_bar FROM c GROUP BY kind""", "faces"))
def a12(spark, sf):
    return rounded(I.separation(usable(spark, sf)))


MED = f"""u AS (SELECT * FROM faces WHERE eye_px>=8 AND det_score>=0.4),
ms AS (SELECT a.burst, a.role, a.vec_id, any_value(a.vec) AS vec, coalesce(sum(CASE WHEN a.vec_id<>b.vec_id THEN {COS} END),0) AS score, count(*) AS faces FROM u a JOIN u b ON a.burst=b.burst AND a.role=b.role GROUP BY a.burst, a.role, a.vec_id),
md AS (SELECT burst, role, arg_min(vec_id,(-round(score,9),vec_id)) AS vec_id, arg_min(vec,(-round(score,9),vec_id)) AS vec, any_value(faces) AS faces FROM ms GROUP BY burst, role),
ct AS (SELECT a.role, a.burst, a.vec_id, b.vec_id AS next_id, {COS} AS cosine, {COS}>=0.05 AS same_person FROM md a JOIN md b ON a.role=b.role AND b.burst=a.burst+1)"""


@query("a13_medoids", B.sql(MED + "\nSELECT burst, role, vec_id, faces FROM md", "faces"))
def a13(spark, sf):
    return I.medoids(usable(spark, sf)).select("burst", "role", "vec_id", "faces")


@query("a13_role_continuity", B.sql(MED + "\nSELECT role, burst, vec_id, next_id, round(cosine,6) AS cosine, same_person FROM ct", "faces"))
def a13c(spark, sf):
    return rounded(I.continuity(I.medoids(usable(spark, sf)), 0.05))


@query("a13_cross_role", B.sql(f"""
u AS (SELECT burst, frame, role, arg_max(vec, vec_id) AS vec FROM faces WHERE eye_px>=8 AND det_score>=0.4 GROUP BY ALL),
c AS (SELECT {COS} AS c FROM u a JOIN u b ON a.burst=b.burst AND a.frame=b.frame WHERE a.role=0 AND b.role=1)
SELECT count(*) AS n, round(min(c),6) AS min, round(max(c),6) AS max, round(quantile_cont(c,0.05),6) AS p05, round(median(c),6) AS median, round(quantile_cont(c,0.95),6) AS p95 FROM c""", "faces"))
def a13x(spark, sf):
    u = usable(spark, sf).groupBy("burst", "frame", "role").agg(F.max_by("vec", "vec_id").alias("vec"))
    b = u.filter("role = 1").select("burst", "frame", F.col("vec").alias("v2"))
    c = u.filter("role = 0").join(b, ["burst", "frame"]).select(P.cosine(F.col("vec"), F.col("v2")).alias("cos"), F.lit(0).alias("k"))
    return rounded(K.exact_quantiles(c, ["k"], "cos", I.PAIR).drop("k"))


@query("w26_longest_run", B.sql(MED + """,
g AS (SELECT role, burst, burst-row_number() OVER (PARTITION BY role ORDER BY burst) AS run FROM ct WHERE same_person), r AS (SELECT role, min(burst) AS start, count(*) AS links FROM g GROUP BY role, run)
SELECT role, start AS enroll_burst, links+1 AS bursts FROM r ORDER BY links DESC, role, start LIMIT 1""", "faces"))
def w26(spark, sf):
    return I.longest_run(I.continuity(I.medoids(usable(spark, sf)), 0.05))


@query("w26_label_probes", B.sql(MED + f"""
SELECT a.vec_id, round({COS},6) AS medoid_cosine, CASE WHEN {COS}>=0.1 THEN 'same' ELSE 'impostor_same_end' END AS grp FROM u a JOIN md b ON a.burst=b.burst AND a.role=b.role""", "faces"))
def w26p(spark, sf):
    u = usable(spark, sf)
    return rounded(I.label_probes(u, I.medoids(u), 0.1).select("vec_id", "medoid_cosine", "grp"))


@query("w21_leader_cluster")
def w21(spark, sf):
    f = usable(spark, sf).withColumn("rank", -P.rank_score(F.col("det_score"), F.col("eye_px")))
    return I.track_groups(I.leader_cluster(f, ["burst"], ["rank", "vec_id"], 0.15), ["burst"])


@query("w22_plan_enrollment")
def w22(spark, sf):
    return rounded(I.plan_enrollment(B.faces(spark, sf), bar=0.1))


@query("w25_cluster_banks", B.sql("""
, b AS (SELECT tracklet, vec_id, round(det_score*eye_px,6) AS rank_value, row_number() OVER (PARTITION BY tracklet ORDER BY det_score*eye_px DESC, vec_id)::INTEGER AS rank FROM faces),
l AS (SELECT *, row_number() OVER (PARTITION BY tracklet ORDER BY frame DESC, vec_id DESC) AS rn FROM faces),
a AS (SELECT tracklet, i, avg(vec[i]) AS mean FROM (SELECT tracklet, vec, unnest(range(1,65)) AS i FROM l WHERE rn<=32) GROUP BY tracklet, i),
m AS (SELECT tracklet, round(max(mean) FILTER (WHERE i=1),6) AS m0, round(max(mean) FILTER (WHERE i=64),6) AS m63, round(sum(i*mean),6) AS weighted_sum FROM a GROUP BY tracklet)
SELECT tracklet, rank, vec_id, rank_value, m0, m63, weighted_sum FROM b JOIN m USING (tracklet) WHERE rank<=3""".lstrip()[1:], "faces"))
def w25(spark, sf):
    best, mean = I.cluster_banks(B.faces(spark, sf))
    every = F.aggregate(F.transform("vec", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    m = mean.select("tracklet", F.col("vec")[0].alias("m0"), F.col("vec")[63].alias("m63"), every.alias("weighted_sum"))
    return rounded(best.join(m, "tracklet"))


@query("j25_label_tracks", B.sql("""
, s AS (SELECT DISTINCT tracklet, CASE tracklet%5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'implicit' END AS seed FROM faces),
e AS (SELECT s.seed, generate_subscripts(vec,1) AS p, unnest(list_transform(vec, lambda x: x/sqrt(list_dot_product(vec,vec)))) AS x FROM faces f JOIN s USING (tracklet) WHERE s.seed IN ('A','B')),
pr AS (SELECT seed, list(m ORDER BY p) AS vec FROM (SELECT seed, p, avg(x) AS m FROM e GROUP BY ALL) GROUP BY seed),
c AS (SELECT a.vec_id, b.seed, list_dot_product(a.vec,b.vec)/(sqrt(list_dot_product(a.vec,a.vec))*sqrt(list_dot_product(b.vec,b.vec))) AS c FROM faces a, pr b)
SELECT vec_id, arg_max(seed,c) AS label, round(max(c),6) AS similarity, round(max(c)-min(c),6) AS gap, CASE WHEN max(c)-min(c)>=0.05 THEN 'embedding' ELSE 'ambiguous' END AS method FROM c GROUP BY vec_id""".lstrip()[1:], "faces"))
def j25(spark, sf):
    f = B.faces(spark, sf)
    seeds = f.select("tracklet").distinct().withColumn("seed", F.expr("case tracklet % 5 when 0 then 'A' when 1 then 'B' when 2 then 'implicit' end"))
    return rounded(I.label_tracks(f.select("vec_id", "vec"), I.prototypes(f, seeds)))


ACTOR = """ac AS (SELECT c.dataset, c.frame_no, c.event_id AS shot_id, any_value(c.us) AS us, arg_min(p.event_id, ((c.x-p.x-10)*(c.x-p.x-10)+(c.y-p.y-20)*(c.y-p.y-20), p.event_id)) AS person_id, min((c.x-p.x-10)*(c.x-p.x-10)+(c.y-p.y-20)*(c.y-p.y-20)) AS d2
 FROM detections c JOIN detections p ON p.dataset=c.dataset AND p.frame_no=c.frame_no AND p.source='plain' WHERE c.source='scored' GROUP BY ALL)"""


def actors(spark, sf):
    d = B.detections(spark, sf)
    s = d.filter("source = 'scored'").select("dataset", "frame_no", F.col("event_id").alias("shot_id"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    p = d.filter("source = 'plain'").select("dataset", "frame_no", F.col("event_id").alias("person_id"), (F.col("x") + 10).alias("fx"), (F.col("y") + 20).alias("fy"))
    return I.attribute_actor(s, p)


@query("j23_attribute_actor", B.sql(ACTOR + "\nSELECT dataset, frame_no, shot_id, person_id, d2 FROM ac", "detections"))
def j23(spark, sf):
    return actors(spark, sf)


@query("a28_actor_stats", B.sql(ACTOR + """,
s AS (SELECT dataset, us, shot_id, CASE WHEN person_id%2=0 THEN 'A' ELSE 'B' END AS actor, (d2%100)/100.0 AS gap FROM ac), l AS (SELECT *, lag(actor) OVER (PARTITION BY dataset ORDER BY us, shot_id) AS pa FROM s)
SELECT dataset, count(*) FILTER (WHERE actor='A') AS a, count(*) FILTER (WHERE actor='B') AS b, count(*) FILTER (WHERE pa<>actor) AS switches, count(*) FILTER (WHERE gap<0.05) AS close_calls FROM l GROUP BY dataset""", "detections"))
def a28(spark, sf):
    a = actors(spark, sf)
    us = B.detections(spark, sf).select(F.col("event_id").alias("shot_id"), "us")
    s = a.join(us, "shot_id").select("dataset", "us", "shot_id", F.when(F.col("person_id") % 2 == 0, "A").otherwise("B").alias("actor"), ((F.col("d2") % 100) / 100.0).alias("gap"))
    return I.actor_stats(s)


@query("s13_forget", B.sql("""
, c AS (SELECT tracklet, mode(label) AS x, min(label) AS player FROM faces GROUP BY tracklet), fg AS (SELECT DISTINCT label AS player FROM faces WHERE label%3=1)
SELECT fg.player, (SELECT count(*) FROM gallery g WHERE g.player=fg.player) AS faces, (SELECT count(*) FROM c WHERE c.player=fg.player) AS clusters,
 (SELECT count(*) FROM gallery g WHERE g.player NOT IN (SELECT player FROM fg)) AS left_faces, (SELECT count(*) FROM c WHERE player NOT IN (SELECT player FROM fg)) AS bound_clusters FROM fg""".lstrip()[1:], "gallery"))
def s13(spark, sf):
    f = B.faces(spark, sf)
    clusters = f.groupBy("tracklet").agg(F.min("label").alias("player"))
    gone = f.filter("label % 3 = 1").select(F.col("label").alias("player")).distinct()
    kept, free, counts = I.forget(B.gallery(spark, sf), clusters, gone)
    totals = kept.agg(F.count(F.lit(1)).alias("left_faces")).crossJoin(free.agg(F.count("player").alias("bound_clusters")))
    return counts.crossJoin(totals)


@query("s14_add_faces", B.sql("""
, g AS (SELECT player, vec_id, row_number() OVER (PARTITION BY player ORDER BY vec_id)-1 AS position FROM gallery), p AS (SELECT expected AS player, vec_id FROM probes),
n AS (SELECT p.player, p.vec_id, row_number() OVER (PARTITION BY p.player ORDER BY p.vec_id)-1+coalesce((SELECT max(position)+1 FROM g WHERE g.player=p.player),0) AS position FROM p)
SELECT player, vec_id, position FROM g UNION ALL SELECT * FROM n""".lstrip()[1:], "gallery", "probes"))
def s14(spark, sf):
    g = K.ordered_index(B.gallery(spark, sf).select("player", "vec_id"), ["player"], [], "vec_id", 4096, "position")
    return I.add_faces(g, B.probes(spark, sf).select(F.col("expected").alias("player"), "vec_id"))
