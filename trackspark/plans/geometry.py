"""Geometry and calibration operators bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import bindings as B
from ..functions import geometry as G
from ..operators import calibration as C

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def r6(c):
    return F.round(c, 6)


def located(spark, sf):
    return C.project_detections(B.detections(spark, sf), B.segments(spark, sf))


def event_quad():
    """A quad per detection: three fixed corners and the detection as the fourth."""
    return F.array(G.point(0, 0), G.point(126, 0), G.point(F.col("x"), F.col("y")), G.point(0, 253))


@query("p1_homography", B.sql("""
SELECT dataset, seg, count(*) AS n, round(any_value(h0),6) AS h0, round(any_value(h1),6) AS h1, round(any_value(h2),6) AS h2,
  round(any_value(h3),6) AS h3, round(any_value(h4),6) AS h4, round(any_value(h5),6) AS h5,
  round(any_value(h6),6) AS h6, round(any_value(h7),6) AS h7
FROM resolved JOIN maps USING (dataset, seg) GROUP BY ALL""", "resolved"))
def p1(spark, sf):
    rows = located(spark, sf).groupBy("dataset", F.col("segment.seg").alias("seg")).agg(
        F.count(F.lit(1)).alias("n"), F.first("segment.quad").alias("quad"))
    return rows.withColumn("h", G.homography(F.col("quad"))).select("dataset", "seg", "n", *[r6(F.col("h")[i]).alias(f"h{i}") for i in range(8)])


@query("p2_project", B.sql("SELECT event_id, seg, clamped, round(mx,6) AS mx, round(my,6) AS my FROM resolved", "resolved"))
def p2(spark, sf):
    return located(spark, sf).select("event_id", F.col("segment.seg").alias("seg"), "clamped",
                                     r6("mm.x").alias("mx"), r6("mm.y").alias("my"))


@query("p3_event_geometry", B.sql("""
SELECT event_id, seg, round((a*u+b*v+c)/(g*u+h*v+1),6) AS px, round((d*u+e*v+f)/(g*u+h*v+1),6) AS py FROM (
 SELECT c.event_id, r.seg, ((c.event_id*13)%1270)/1269.0 AS u, ((c.event_id*29)%2540)/2539.0 AS v, m.a, m.b, m.c, m.d, m.e, m.f, m.g, m.h
 FROM claims c JOIN resolved r USING (event_id) JOIN maps m ON m.dataset=r.dataset AND m.seg=r.seg)""", "claims", "resolved"))
def p3(spark, sf):
    c = B.claims(spark, sf).withColumn("last_mm", G.point((F.col("event_id") * 13) % 1270, (F.col("event_id") * 29) % 2540))
    return C.event_geometry(c, B.segments(spark, sf), ["last_mm"]).select(
        "event_id", F.col("segment.seg").alias("seg"), r6("last_px.x").alias("px"), r6("last_px.y").alias("py"))


@query("p4_nearest_pocket", B.sql("""
SELECT event_id, arg_min(pocket, (d, ord)) AS pocket, round(min(d),6) AS dist FROM (
 SELECT event_id, pocket, ord, sqrt((mx-qx)*(mx-qx)+(my-qy)*(my-qy)) AS d FROM resolved, pockets) GROUP BY event_id""",
 "resolved", "pockets"))
def p4(spark, sf):
    return located(spark, sf).withColumn("p", G.nearest_pocket(F.col("mm.x"), F.col("mm.y"))).select(
        "event_id", F.col("p.pocket").alias("pocket"), r6("p.dist").alias("dist"))


@query("p5_inside_tests", B.sql("""
SELECT r.event_id, (s0>=0 AND s1>=0 AND s2>=0 AND s3>=0) OR (s0<=0 AND s1<=0 AND s2<=0 AND s3<=0) AS in_quad,
 mx BETWEEN -30 AND 1300 AND my BETWEEN -30 AND 2570 AS on_table, x BETWEEN 20 AND 107 AND y BETWEEN 20 AND 234 AS in_frame
FROM (SELECT r.event_id, r.mx, r.my, r.x, r.y, (x1-x0)*(r.y-y0)-(y1-y0)*(r.x-x0) AS s0, (x2-x1)*(r.y-y1)-(y2-y1)*(r.x-x1) AS s1,
 (x3-x2)*(r.y-y2)-(y3-y2)*(r.x-x2) AS s2, (x0-x3)*(r.y-y3)-(y0-y3)*(r.x-x3) AS s3
 FROM resolved r JOIN segments g ON g.dataset=r.dataset AND g.seg=r.seg) r""", "resolved"))
def p5(spark, sf):
    return located(spark, sf).select(
        "event_id", G.in_quad(F.col("x"), F.col("y"), F.col("segment.quad")).alias("in_quad"),
        G.on_table(F.col("mm.x"), F.col("mm.y"), 30.0).alias("on_table"),
        G.in_frame(F.col("x"), F.col("y"), 127, 254, 20.0).alias("in_frame"))


@query("p6_pocket_membership", B.sql("""
, n AS (SELECT event_id, arg_min(pocket,(d,ord)) AS pocket, min(d) AS d, arg_min(qx,(d,ord)) AS qx, arg_min(qy,(d,ord)) AS qy FROM (
 SELECT *, sqrt((mx-qx)*(mx-qx)+(my-qy)*(my-qy)) AS d FROM resolved, pockets) GROUP BY event_id),
j AS (SELECT r.event_id, n.pocket, n.d, n.qx, n.qy, r.mx, r.my,
 (h0*(x+1)+h1*y+h2)/(h6*(x+1)+h7*y+h8)-mx AS jxx, (h3*(x+1)+h4*y+h5)/(h6*(x+1)+h7*y+h8)-my AS jxy,
 (h0*x+h1*(y+1)+h2)/(h6*x+h7*(y+1)+h8)-mx AS jyx, (h3*x+h4*(y+1)+h5)/(h6*x+h7*(y+1)+h8)-my AS jyy
 FROM resolved r JOIN maps m ON m.dataset=r.dataset AND m.seg=r.seg JOIN n ON n.event_id=r.event_id),
b AS (SELECT *, 1.5*CASE WHEN d<=1e-9 THEN greatest(sqrt(jxx*jxx+jxy*jxy), sqrt(jyx*jyx+jyy*jyy))
 ELSE sqrt(power((jxx*(mx-qx)+jyx*(my-qy))/d,2)+power((jxy*(mx-qx)+jyy*(my-qy))/d,2)) END AS bar FROM j)
SELECT event_id, pocket, round(d,6) AS distance_mm, round(bar,6) AS uncertainty_mm,
 CASE WHEN d+bar<=100 THEN 'inside' WHEN d-bar>100 THEN 'outside' ELSE 'ambiguous' END AS verdict FROM b""".lstrip()[1:],
 "resolved", "pockets"))
def p6(spark, sf):
    d = located(spark, sf)
    return G.with_pocket_membership(d, F.col("segment.h"), F.col("x"), F.col("y"), 1.5, "m").select(
        "event_id", "m.pocket", r6("m.distance_mm").alias("distance_mm"),
        r6("m.uncertainty_mm").alias("uncertainty_mm"), "m.verdict")


def boxes(df):
    return df.withColumn("x2", F.col("x") + 20 + F.col("event_id") % 40).withColumn("y2", F.col("y") + 20 + F.col("user_id") % 40)


@query("p7_iou", B.sql("""
, b AS (SELECT event_id, dataset, frame_no, x, y, x+20+event_id%40 AS x2, y+20+user_id%40 AS y2 FROM detections),
l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(x2) OVER w AS px2, lag(y2) OVER w AS py2 FROM b
 WINDOW w AS (PARTITION BY dataset, frame_no ORDER BY event_id)),
o AS (SELECT *, greatest(0, least(x2,px2)-greatest(x,px))*greatest(0, least(y2,py2)-greatest(y,py)) AS inter FROM l WHERE px IS NOT NULL)
SELECT event_id, round(inter/((x2-x)*(y2-y)+(px2-px)*(py2-py)-inter),6) AS iou, round(inter/((x2-x)*(y2-y)),6) AS face_share,
 (x+x2)/2.0 BETWEEN px AND px2 AND (y+y2)/2.0 BETWEEN py AND py2 AS center_inside FROM o""".lstrip()[1:], "detections"))
def p7(spark, sf):
    w = W.partitionBy("dataset", "frame_no").orderBy("event_id")
    names = ("x", "y", "x2", "y2")
    d = boxes(B.detections(spark, sf)).select("event_id", *names, *[F.lag(n).over(w).alias("p" + n) for n in names])
    a, p = [F.col(n).cast("double") for n in names], [F.col("p" + n).cast("double") for n in names]
    return d.filter("px is not null").select("event_id", r6(G.iou(p, a)).alias("iou"), r6(G.face_area_iou(a, p)).alias("face_share"),
                                             G.center_inside(a, p).alias("center_inside"))


@query("p8_quad_sanity", B.sql("""
, q AS (SELECT event_id, x, y, (abs(126*253.0)+abs(0*y-253.0*x))/2.0/(127*254) AS share,
 least(sqrt(126*126.0), sqrt((x-126)*(x-126)+y*y*1.0), sqrt(x*x+(y-253)*(y-253)*1.0), 253.0) AS side FROM detections)
SELECT event_id, CASE WHEN side<8 THEN 'degenerate corner' WHEN share BETWEEN 0.02 AND 0.9 THEN 'sane'
 ELSE 'implausible area '||printf('%.1f', share*100)||'%' END AS reason FROM q""".lstrip()[1:], "detections"))
def p8(spark, sf):
    return B.detections(spark, sf).select(
        "event_id", F.coalesce(G.quad_sanity(event_quad(), 127.0, 254.0), F.lit("sane")).alias("reason"))


@query("p9_playfield_check", B.sql("""
, q AS (SELECT event_id, x::DOUBLE AS x, y::DOUBLE AS y FROM detections),
a AS (SELECT *, sqrt(126*126.0) AS top, sqrt((x-126)*(x-126)+y*y) AS rgt, sqrt(x*x+(y-253)*(y-253)) AS bot, 253.0::DOUBLE AS lft FROM q),
m AS (SELECT *, degrees(acos(greatest(-1,least(1,(126*x)/(126*CASE WHEN bot=0 THEN 1e-9 ELSE bot END))))) AS long_deg,
 degrees(acos(greatest(-1,least(1,(253*y)/(253*CASE WHEN rgt=0 THEN 1e-9 ELSE rgt END))))) AS short_deg,
 [sign(126*y), sign((x-126)*(253-y)+y*x), sign(-x*(-253)), sign(253*126)] AS s FROM a)
SELECT event_id, round(long_deg,6) AS long_deg, round(short_deg,6) AS short_deg,
 concat_ws('+', CASE WHEN NOT (list_min(s)>0 OR list_max(s)<0) THEN 'not-convex' END,
  CASE WHEN least(long_deg,short_deg)>3 THEN 'no-parallel-pair' END,
  CASE WHEN (top+bot)/2/((lft+rgt)/2)<1.1 THEN 'aspect-too-square' END) AS reasons,
 round(CASE WHEN least(top,rgt,bot,lft)<=1e-6 THEN 1 ELSE greatest(abs(top-bot)/greatest(top,bot), abs(lft-rgt)/greatest(lft,rgt)) END,6) AS perspective,
 round((SELECT min(v) FROM (VALUES ((0+0+0+sqrt((x-126)*(x-126)+(y-253)*(y-253)))/4)) t(v)),6) AS unshifted_mean FROM m""".lstrip()[1:], "detections"))
def p9(spark, sf):
    q = event_quad()
    ref = F.array(G.point(0, 0), G.point(126, 0), G.point(126, 253), G.point(0, 253))
    c = G.with_quad_check(B.detections(spark, sf).withColumn("q", q), "q", "c").withColumn("d", G.quad_distance(F.col("q"), ref))
    # three corners coincide, so alignment 0 is the best one and its mean is a quarter of one gap
    return c.select("event_id", r6("c.long_deg").alias("long_deg"), r6("c.short_deg").alias("short_deg"),
                    F.array_join("c.reasons", "+").alias("reasons"), r6("c.perspective").alias("perspective"),
                    r6("d.mean").alias("unshifted_mean"))


@query("p15_ball_scale", B.sql("""
SELECT event_id, (x+640)/1280.0::DOUBLE AS scale, 18.9::DOUBLE*((x+640)/1280.0::DOUBLE) AS diameter_px,
 round(pi()*power(18.9::DOUBLE*((x+640)/1280.0::DOUBLE)/2,2),6) AS area_px2, 57.15::DOUBLE/(18.9::DOUBLE*((x+640)/1280.0::DOUBLE)) AS mm_per_px FROM detections""", "detections"))
def p15(spark, sf):
    frame = ((F.col("x") + 640).cast("double"), None)
    return B.detections(spark, sf).select(
        "event_id", G.scale_between((1280.0, 0), frame).alias("scale"), G.ball_diameter_px(frame).alias("diameter_px"),
        r6(G.ball_area_px2(frame)).alias("area_px2"), G.ball_mm_per_px(frame).alias("mm_per_px"))


@query("p17_calibration_cause", B.sql("""
SELECT event_id, CASE WHEN coalesce(cov,1.0)>=0.8 THEN 'coverage_above_gate' WHEN desat>=0.05 THEN 'occlusion_and_shading'
 WHEN v<150 THEN 'shading_not_framing' ELSE 'mask_instability_not_framing' END AS cause,
 concat_ws('+', CASE WHEN shift>2 THEN 'whole_frame_shift' END,
  CASE WHEN abs(med)>8 AND greatest(abs(o0-med),abs(o1-med),abs(o2-med),abs(o3-med))<=8 THEN 'rail_boundary_moved' END) AS moved FROM (
 SELECT *, (o0+o1+o2+o3-greatest(o0,o1,o2,o3)-least(o0,o1,o2,o3))/2.0 AS med FROM (
 SELECT event_id, CASE WHEN event_id%11>0 THEN score END AS cov, CASE WHEN event_id%5>0 THEN (x%20)/100.0 END AS desat,
  (y+20) AS v, (x%30)/10.0 AS shift, (x%12)+5.0 AS o0, (y%12)+5.0 AS o1, ((x+y)%12)+5.0 AS o2, ((x*y)%12)+5.0 AS o3 FROM detections))""", "detections"))
def p17(spark, sf):
    x, y = F.col("x"), F.col("y")
    offs = F.array(x % 12 + 5.0, y % 12 + 5.0, (x + y) % 12 + 5.0, (x * y) % 12 + 5.0)
    test = C.framing_test(offs, (x % 30) / 10.0)
    return B.detections(spark, sf).select(
        "event_id", C.cause_of(F.when(F.col("event_id") % 11 > 0, F.col("score")),
                               F.when(F.col("event_id") % 5 > 0, (x % 20) / 100.0), y + 20).alias("cause"),
        F.array_join(test["reasons"], "+").alias("moved"))


@query("p25_reproject", B.sql("""
, r AS (SELECT r.event_id, r.mx, r.my, (n.h0*x+n.h1*y+n.h2)/(n.h6*x+n.h7*y+n.h8) AS nx, (n.h3*x+n.h4*y+n.h5)/(n.h6*x+n.h7*y+n.h8) AS ny
 FROM resolved r JOIN maps n ON n.dataset=r.dataset AND n.seg=(r.seg+1)%6)
SELECT event_id, round(nx,6) AS new_x, round(ny,6) AS new_y, round(sqrt((mx-nx)*(mx-nx)+(my-ny)*(my-ny)),6) AS shift_mm FROM r""".lstrip()[1:], "resolved"))
def p25(spark, sf):
    seg = B.segments(spark, sf)
    h = seg.withColumn("new_h", G.homography(F.col("quad"))).select("dataset", ((F.col("seg") + 5) % 6).alias("seg"), "new_h")
    pairs = seg.withColumn("h", G.homography(F.col("quad"))).join(h, ["dataset", "seg"])
    d = C.resolve_segment(B.detections(spark, sf), pairs)
    return C.reproject(d, F.col("segment.h"), F.col("segment.new_h"), F.col("x"), F.col("y")).select(
        "event_id", r6("new_mm.x").alias("new_x"), r6("new_mm.y").alias("new_y"), r6("shift_mm").alias("shift_mm"))


@query("p26_box_cover")
def p26(spark, sf):
    d = boxes(C.resolve_segment(B.detections(spark, sf), B.segments(spark, sf)))
    cover = box_cover(d, F.col("segment.quad"), [F.col(c).cast("double") for c in ("x", "y", "x2", "y2")])
    return cover.groupBy("dataset", "frame_no").agg(r6(F.max("cover")).alias("cover")).withColumn(
        "person_on_table", F.col("cover") > 0.02)


def box_cover(df, quad, box):
    """Share of the quad inside the box; each cut is materialised as a column to keep the plan flat."""
    out = df.withColumn("_poly", quad)
    for axis, bound, sign in G.clip_to_box(quad, box):
        out = out.withColumn("_poly", F.when(F.size("_poly") > 0, G._clip(F.col("_poly"), axis, bound, sign)).otherwise(F.col("_poly")))
    return out.withColumn("cover", G.polygon_area(F.col("_poly")) / F.nullif(G.polygon_area(quad), F.lit(0.0))).drop("_poly")


@query("a25_map_disagreement", B.sql("""
, g AS (SELECT DISTINCT gx, gy FROM (SELECT i*317.5::DOUBLE AS gx, j*635.0::DOUBLE AS gy FROM (SELECT unnest(range(5)) AS i), (SELECT unnest(range(5)) AS j)
  UNION ALL SELECT qx, qy FROM pockets)),
u AS (SELECT seg_pairs.*, gx, gy, gx/1269 AS u, gy/2539 AS v FROM (
  SELECT p.dataset, p.seg, p.n, a.a a1,a.b b1,a.c c1,a.d d1,a.e e1,a.f f1,a.g g1,a.h hh1, b.a a2,b.b b2,b.c c2,b.d d2,b.e e2,b.f f2,b.g g2,b.h hh2, a.h0,a.h1,a.h2,a.h3,a.h4,a.h5,a.h6,a.h7,a.h8
  FROM (SELECT dataset, seg, count(*) AS n FROM resolved GROUP BY ALL) p JOIN maps a USING (dataset, seg) JOIN maps b ON b.dataset=p.dataset AND b.seg=(p.seg+1)%6) seg_pairs, g),
p AS (SELECT *, (a1*u+b1*v+c1)/(g1*u+hh1*v+1) AS pax, (d1*u+e1*v+f1)/(g1*u+hh1*v+1) AS pay,
  (a2*u+b2*v+c2)/(g2*u+hh2*v+1) AS pbx, (d2*u+e2*v+f2)/(g2*u+hh2*v+1) AS pby FROM u),
o AS (SELECT dataset, seg, n, CASE WHEN gy<400 THEN 'head' WHEN gy<2140 THEN 'middle' ELSE 'foot' END AS region,
  sqrt(power(pax-pbx,2)+power(pay-pby,2)) AS d_px, sqrt(power((h0*pbx+h1*pby+h2)/(h6*pbx+h7*pby+h8)-gx,2)+power((h3*pbx+h4*pby+h5)/(h6*pbx+h7*pby+h8)-gy,2)) AS off FROM p)
SELECT dataset, seg, n AS events, region, count(*) AS n, round(median(d_px),6) AS d_px_median, round(max(d_px),6) AS d_px_max,
 round(median(off),6) AS off_mm_median, round(quantile_cont(off,0.95),6) AS off_mm_p95, round(max(off),6) AS off_mm_max FROM o GROUP BY ALL""".lstrip()[1:],
 "resolved", "pockets"))
def a25(spark, sf):
    seg = B.segments(spark, sf).select("dataset", "seg", "quad")
    used = located(spark, sf).groupBy("dataset", F.col("segment.seg").alias("seg")).agg(F.count(F.lit(1)).alias("events"))
    nxt = seg.select("dataset", ((F.col("seg") + 5) % 6).alias("seg"), F.col("quad").alias("quad_b"))
    maps = used.join(seg.withColumnRenamed("quad", "quad_a"), ["dataset", "seg"]).join(nxt, ["dataset", "seg"])
    out = C.map_disagreement(maps, ["dataset", "seg", "events"])
    return out.select(*[r6(c).alias(c) if t == "double" else c for c, t in out.dtypes])


@query("a27_qa", B.sql("""
SELECT dataset, frame_no, count(*) AS balls, count(*) FILTER (WHERE NOT (mx BETWEEN 0 AND 1270 AND my BETWEEN 0 AND 2540)) AS out_of_bounds,
 count(DISTINCT color||' '||source) AS kinds, round(stddev_pop(x),6) AS x_std, round(stddev_pop(y),6) AS y_std FROM resolved GROUP BY ALL""", "resolved"))
def a27(spark, sf):
    d = located(spark, sf)
    return d.groupBy("dataset", "frame_no").agg(
        F.count(F.lit(1)).alias("balls"), F.count_if(~G.on_table(F.col("mm.x"), F.col("mm.y"))).alias("out_of_bounds"),
        F.countDistinct(F.concat_ws(" ", "color", "source")).alias("kinds"),
        r6(F.stddev_pop("x")).alias("x_std"), r6(F.stddev_pop("y")).alias("y_std"))


@query("a35_fit_segments", B.sql("""
, s AS (SELECT dataset, frame_no, x, y, event_id, score FROM detections),
f AS (SELECT dataset, frame_no, count(*) FILTER (WHERE score>=0.25) AS verified, min(score) AS low, max(x)-min(x) AS spread,
  avg(x) AS cx, avg(y) AS cy FROM s GROUP BY ALL),
p AS (SELECT dataset, min(frame_no) FILTER (WHERE low<0.02) AS t_split FROM f GROUP BY dataset)
SELECT f.dataset, count(*) AS samples, count(*) FILTER (WHERE verified>=4) AS fully_verified, any_value(t_split) AS t_split,
 count(*) FILTER (WHERE frame_no>=t_split AND verified>=4) AS n_fit,
 round(median(cx) FILTER (WHERE frame_no>=t_split AND verified>=4),6) AS quad_x, round(median(cy) FILTER (WHERE frame_no>=t_split AND verified>=4),6) AS quad_y,
 count(*) FILTER (WHERE frame_no>=t_split AND verified<4) AS held_out, count(*) FILTER (WHERE spread>120) AS moved
FROM f JOIN p USING (dataset) GROUP BY f.dataset""".lstrip()[1:], "detections"))
def a35(spark, sf):
    frames = B.detections(spark, sf).groupBy("dataset", "frame_no").agg(
        F.count_if(F.col("score") >= 0.25).alias("verified"), F.min("score").alias("low"),
        (F.max("x") - F.min("x")).alias("spread"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    split = frames.groupBy("dataset").agg(F.min(F.when(F.col("low") < 0.02, F.col("frame_no"))).alias("t_split"))
    f = frames.join(split, "dataset")
    late, full = F.col("frame_no") >= F.col("t_split"), F.col("verified") >= 4
    from ..operators.kernels import exact_quantiles
    med = None
    for c in ("cx", "cy"):
        q = exact_quantiles(f.filter(late & full), ["dataset"], c, {"m": 0.5}).select("dataset", F.col("m").alias(c))
        med = q if med is None else med.join(q, "dataset", "full")
    agg = f.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(full).alias("fully_verified"), F.first("t_split").alias("t_split"),
        F.count_if(late & full).alias("n_fit"), F.count_if(late & ~full).alias("held_out"), F.count_if(F.col("spread") > 120).alias("moved"))
    return agg.join(med, "dataset", "left").select(
        "dataset", "samples", "fully_verified", "t_split", "n_fit", r6("cx").alias("quad_x"), r6("cy").alias("quad_y"), "held_out", "moved")


@query("a36_map_provenance", B.sql("""
, c AS (SELECT r.event_id, r.dataset, r.seg, r.x, r.y, r.mx, r.my FROM claims k JOIN resolved r USING (event_id)),
z AS (SELECT c.dataset, k.which, sqrt(power((m.a*u+m.b*v+m.c)/(m.g*u+m.h*v+1)-c.x,2)+power((m.d*u+m.e*v+m.f)/(m.g*u+m.h*v+1)-c.y,2)) AS res
 FROM (SELECT *, mx/1269 AS u, my/2539 AS v FROM c) c, (VALUES ('own',0),('next',1)) k(which, off), maps m WHERE m.dataset=c.dataset AND m.seg=(c.seg+k.off)%6),
s AS (SELECT dataset, which, count(*) AS n, median(res) AS med, quantile_cont(res,0.9) AS p90, max(res) AS mx FROM z GROUP BY ALL)
SELECT o.dataset, o.n, round(o.med,6) AS own_median, round(o.p90,6) AS own_p90, round(o.mx,6) AS own_max, round(b.med,6) AS next_median,
 round(b.p90,6) AS next_p90, round(b.mx,6) AS next_max, CASE WHEN o.med<b.med/2 THEN 'own' WHEN b.med<o.med/2 THEN 'next' ELSE 'inconclusive' END AS verdict
FROM s o JOIN s b USING (dataset) WHERE o.which='own' AND b.which='next'""".lstrip()[1:], "claims", "resolved"))
def a36(spark, sf):
    from ..operators.kernels import exact_quantiles
    seg = B.segments(spark, sf)
    nxt = seg.select("dataset", ((F.col("seg") + 5) % 6).alias("seg"), F.col("quad").alias("next_quad"))
    both = seg.join(nxt, ["dataset", "seg"]).withColumns({
        "h": G.homography(F.col("quad")), "own_ih": G.inverse_homography(F.col("quad")), "next_ih": G.inverse_homography(F.col("next_quad"))})
    c = C.resolve_segment(B.claims(spark, sf), both).withColumn("mm", G.project(F.col("segment.h"), F.col("x"), F.col("y")))
    def residual(name):
        px = G.project(F.col(f"segment.{name}_ih"), F.col("mm.x"), F.col("mm.y"))
        return c.withColumn("px", px).select("dataset", F.lit(name).alias("map"), G.distance(F.col("px.x"), F.col("px.y"), F.col("x"), F.col("y")).alias("res"))
    q = exact_quantiles(residual("own").unionByName(residual("next")), ["dataset", "map"], "res", {"median": 0.5, "p90": 0.9})
    out = q.groupBy("dataset").agg(F.max(F.when(F.col("map") == "own", F.col("n"))).alias("own_n"), *[
        F.max(F.when(F.col("map") == m, F.col(s))).alias(f"{m}_{s}") for m in ("own", "next") for s in ("median", "p90", "max")])
    a, b = F.col("own_median"), F.col("next_median")
    return out.select("dataset", F.col("own_n").alias("n"), *[r6(f"{k}_{s}").alias(f"{k}_{s}") for k in ("own", "next") for s in ("median", "p90", "max")],
                      F.when(a < b / 2, "own").when(b < a / 2, "next").otherwise("inconclusive").alias("verdict"))


@query("a37_limits", B.sql("""
, s AS (SELECT dataset, color, count(*) AS n, quantile_cont(signal,0.999) AS p999, max(signal) AS mx FROM series GROUP BY ALL)
SELECT dataset, color, n, round(p999,9) AS floor, round(p999*1.25,9) AS threshold, round(135.0*least(1, 280.5523/361.0),6) AS ceiling,
 round(135.0*least(1,280.5523/361.0)/(p999*1.25),6) AS head_room, p999*1.25>=135.0*least(1,280.5523/361.0) AS saturated FROM s""".lstrip()[1:], "series"))
def a37(spark, sf):
    from ..operators.signals import limits
    from ..operators.kernels import exact_quantiles
    s = exact_quantiles(B.series(spark, sf), ["dataset", "color"], "signal", {"p999": 0.999})
    out = limits(s, F.col("p999"), contrast=135.0, ball_area=280.5523, window_px=19)
    return out.select("dataset", "color", "n", F.round("floor", 9).alias("floor"), F.round("threshold", 9).alias("threshold"),
                      r6("ceiling").alias("ceiling"), r6("head_room").alias("head_room"), "saturated")


@query("j2_resolve_segment", B.sql("""
, e AS (SELECT event_id, dataset // 5 AS dataset, CASE WHEN event_id%97=0 THEN NULL ELSE t END AS t FROM series),
k AS (SELECT e.*, g.seg, coalesce(t BETWEEN t_start AND t_end, false) AS inside, row_number() OVER (PARTITION BY event_id ORDER BY
  coalesce(t BETWEEN t_start AND t_end, false) DESC, CASE WHEN t IS NULL OR t BETWEEN t_start AND t_end THEN 0 ELSE least(abs(t-t_start),abs(t-t_end)) END, t_start) AS rn
 FROM e JOIN segments g USING (dataset))
SELECT event_id, seg, NOT inside AS clamped, CASE WHEN t IS NULL THEN 'no_time' WHEN NOT inside THEN 'outside_all_segments' END AS clamp_reason FROM k WHERE rn=1""".lstrip()[1:],
 "series", "segments"))
def j2(spark, sf):
    e = B.series(spark, sf).select("event_id", F.expr("dataset div 5L").alias("dataset"), F.when(F.col("event_id") % 97 != 0, F.col("t")).alias("t"))
    return C.resolve_segment(e, B.segments(spark, sf)).select("event_id", F.col("segment.seg").alias("seg"), "clamped", "clamp_reason")


@query("j3_reference_chain", B.sql("""
SELECT event_id, CASE WHEN sup AND x<=120 AND y<=240 THEN 'supplied' WHEN NOT clamped AND 126+seg*3<=135 AND 253+seg*4<=266 THEN 'segment'
  WHEN event_id%2=0 THEN 'static' ELSE 'none' END AS kind,
 concat_ws('+', CASE WHEN sup AND NOT (x<=120 AND y<=240) THEN 'supplied' END,
  CASE WHEN NOT (sup AND x<=120 AND y<=240) AND NOT clamped AND NOT (126+seg*3<=135 AND 253+seg*4<=266) THEN 'segment' END) AS rejected
FROM (SELECT *, event_id%3=0 AS sup FROM resolved)""", "resolved"))
def j3(spark, sf):
    d = C.resolve_segment(B.detections(spark, sf), B.segments(spark, sf))
    one = F.array(G.point(0, 0), G.point(126, 0), G.point(126, 253), G.point(0, 253))
    # a supplied quad stretched by the detection: fits 135x266 only when x<=120 and y<=240
    grow = F.array(G.point(0, 0), G.point(F.col("x") + 15, 0), G.point(F.col("x") + 15, F.col("y") + 26), G.point(0, F.col("y") + 26))
    out = C.resolve_reference(d, [
        ("supplied", F.when(F.col("event_id") % 3 == 0, grow)), ("segment", F.when(~F.col("clamped"), F.col("segment.quad"))),
        ("static", F.when(F.col("event_id") % 2 == 0, one)), ("prior", F.lit(None).cast("array<struct<x:double,y:double>>"))], 135.0, 266.0)
    return out.select("event_id", F.col("reference_kind").alias("kind"), F.array_join("rejected", "+").alias("rejected"))
