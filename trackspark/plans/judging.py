"""Claim normalisation, scalar rules and evidence gates bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..functions import geometry as G
from ..functions import scalars as P
from ..operators import calibration as C
from ..operators import gates as T
from ..operators import joins as J
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


@query("p10_color_key", """
SELECT event_id, CASE WHEN k IN ('red1','red2') THEN 'red' ELSE k END AS key, CASE WHEN k='' THEN 'unknown' WHEN k IN ('red1','red2') THEN 'red' ELSE k END AS name,
 CASE WHEN k='' OR event_type='view' THEN true ELSE (CASE WHEN k IN ('red1','red2') THEN 'red' ELSE k END)='click' END AS fits FROM (
 SELECT *, lower(trim(coalesce(CASE event_type WHEN 'error' THEN ' Red'||(event_id%3)||' ' WHEN 'signup' THEN '  ' WHEN 'purchase' THEN NULL ELSE upper(event_type) END,''))) AS k FROM events)""")
def p10(spark, sf):
    e = B.table(spark, sf, "events")
    raw = F.expr("case event_type when 'error' then concat(' Red', event_id % 3, ' ') when 'signup' then '  ' when 'purchase' then null else upper(event_type) end")
    other = F.when(F.col("event_type") == "view", P.UNKNOWN).otherwise("click")
    return e.select("event_id", P.color_key(raw).alias("key"), P.normalize_color(raw).alias("name"), P.colors_compatible(P.normalize_color(raw), other).alias("fits"))


@query("p11_pocket_from_text", """
, t AS (SELECT p_partkey, p_name, CASE p_partkey%6 WHEN 0 THEN 'head-left' WHEN 1 THEN 'head-right (12 mm)' WHEN 2 THEN p_name||' from left-side' WHEN 3 THEN p_name||' from nowhere' WHEN 4 THEN ' right-side ' ELSE p_name END AS s FROM part),
h AS (SELECT *, trim(split_part(trim(s),'(',1)) AS head, CASE WHEN instr(trim(s),' from ')>0 THEN trim(list_last(string_split(trim(s),' from '))) END AS tail FROM t)
SELECT p_partkey, CASE WHEN head IN ('head-left','head-right','foot-right','foot-left','left-side','right-side') THEN head WHEN tail IN ('head-left','head-right','foot-right','foot-left','left-side','right-side') THEN tail END AS pocket FROM h""".replace("\n, t AS", "WITH t AS", 1))
def p11(spark, sf):
    text = F.expr("case p_partkey % 6 when 0 then 'head-left' when 1 then 'head-right (12 mm)' when 2 then concat(p_name, ' from left-side') "
                  "when 3 then concat(p_name, ' from nowhere') when 4 then ' right-side ' else p_name end")
    return B.table(spark, sf, "part").select("p_partkey", P.pocket_from_text(text).alias("pocket"))


@query("p12_search_fold", """
WITH n AS (SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT -1-p_partkey, p_name FROM part),
f AS (SELECT id, name, trim(regexp_replace(lower(name),'[^a-z0-9]+',' ','g')) AS folded FROM n)
SELECT id, folded, lower(trim(name)) AS name_key, (contains(folded,'customer') OR contains(replace(folded,' ',''),'customer')) AND (contains(folded,'12') OR contains(replace(folded,' ',''),'12')) AS hit_customer,
 contains(folded,'redwid') OR contains(replace(folded,' ',''),'redwid') AS hit_part FROM f""")
def p12(spark, sf):
    n = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).unionByName(
        B.table(spark, sf, "part").select((-1 - F.col("p_partkey")).alias("id"), F.col("p_name").alias("name")))
    f = n.withColumn("folded", P.search_fold(F.col("name")))
    return f.select("id", "folded", P.name_key(F.col("name")).alias("name_key"), P.name_matches(F.col("folded"), F.lit("customer 12")).alias("hit_customer"),
                    P.name_matches(F.col("folded"), F.lit("redwid")).alias("hit_part"))


@query("p13_normalize_claims", B.sql("""
SELECT event_id, kind, CASE WHEN event_id%4<>3 THEN x::DOUBLE END AS from_mm, CASE event_id%3 WHEN 0 THEN y::DOUBLE WHEN 1 THEN score END AS last_mm, CASE event_id%5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE (x+y)/4.0::DOUBLE END AS gap_s FROM claims""", "claims"))
def p13(spark, sf):
    c = B.claims(spark, sf)
    x = F.col("x").cast("double")
    raw = c.select("event_id", "kind", "score", "x", "y", F.when(F.col("event_id") % 4 == 0, x).alias("from_mm"), F.when((F.col("event_id") % 4).isin(1, 2), x).alias("ball_from"),
                   F.when(F.col("event_id") % 3 == 0, F.col("y").cast("double")).alias("last_mm"), F.when(F.col("event_id") % 3 == 1, F.col("score")).alias("ball_table_mm"),
                   F.when(F.col("event_id") % 5 == 0, "true").when(F.col("event_id") % 5 == 1, "n/a").otherwise(((F.col("x") + F.col("y")) / 4.0).cast("string")).alias("gap_s"))
    return normalize_claims(raw).select("event_id", "kind", "from_mm", "last_mm", "gap_s")


def normalize_claims(df):
    """Read view over both claim schemas: scan names first, queue names second."""
    return (df.withColumn("from_mm", F.coalesce("from_mm", "ball_from")).withColumn("last_mm", F.coalesce("last_mm", "ball_table_mm"))
            .withColumn("gap_s", P.number_or_null(F.col("gap_s"))))


@query("p14_confidence", B.sql("SELECT event_id, CASE WHEN source='scored' THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, (score-0.5)/0.5)) ELSE 0.5::DOUBLE END AS confidence FROM detections", "detections"))
def p14(spark, sf):
    return B.detections(spark, sf).select("event_id", P.obs_confidence(F.col("source"), F.col("score")).alias("confidence"))


@query("p16_admit", B.sql("""
SELECT event_id, CASE WHEN coalesce(area,0)<60 THEN 'area_too_small' WHEN area>9000 THEN 'area_too_large' WHEN coalesce(r,0)<4 THEN 'radius_too_small' WHEN r>60 THEN 'radius_too_large' WHEN NOT coalesce(cloth,true) THEN 'off_cloth' ELSE 'admitted' END AS reason
FROM (SELECT event_id, x*y*1.0 AS area, CASE WHEN event_id%9>0 THEN y/3.0 END AS r, CASE WHEN event_id%7>0 THEN x%5>0 END AS cloth FROM detections)""", "detections"))
def p16(spark, sf):
    x, y, i = F.col("x"), F.col("y"), F.col("event_id")
    return B.detections(spark, sf).select("event_id", P.admit(x * y * 1.0, F.when(i % 9 > 0, y / 3.0), F.when(i % 7 > 0, x % 5 > 0)).alias("reason"))


RAIL = """CASE WHEN nu=0 THEN CASE WHEN vs IS NULL THEN NULL WHEN ss<4 THEN 'calibration_rail_unverified_at_time' END
 WHEN ra IN ('boundary_outside_band','prior_disagreement') OR (nu=2 AND rb IN ('boundary_outside_band','prior_disagreement')) THEN 'calibration_reference_contradicted_at_time'
 WHEN nu=2 AND ra='no_boundary_evidence' AND rb='no_boundary_evidence' THEN 'calibration_rail_unverified_at_time' END"""
EVIDENCE = """ev AS (SELECT c.event_id, c.kind, c.color, event_id%11<>0 AS av, CASE WHEN event_id%22=0 THEN 'no frames' END AS note, color='click' AS cu, event_id%3=0 AS cm, event_id%5=0 AS cp,
 CASE WHEN event_id%13>0 THEN (x%6)::DOUBLE END AS c0, CASE WHEN event_id%17>0 THEN (y%4)::DOUBLE END AS c1, CASE WHEN event_id%9>0 THEN (y%4+event_id%8//7)::DOUBLE END AS cx,
 CASE event_id%19 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS comp,
 CASE WHEN event_id%7=0 THEN 'other' ELSE color END AS va, CASE WHEN event_id%6>0 THEN (x*2)::DOUBLE END AS vd, event_id%3 AS vh, CASE WHEN event_id%4>0 THEN (y%50-10)::DOUBLE END AS vp, event_id%10<8 AS v1, (y*2)::DOUBLE AS wd, event_id%4 AS wh, event_id%15=2 AS v2,
 CASE WHEN event_id%12>0 THEN (x-3)::DOUBLE END AS fp, CASE WHEN event_id%14>0 THEN (y-4)::DOUBLE END AS tp, CASE WHEN event_id%8=1 THEN (x*5)::DOUBLE END AS cd, event_id%5 AS ch, event_id%4 AS ce, event_id%3 AS ct, CASE WHEN event_id%2=1 THEN (y%90)::DOUBLE END AS cg,
 CASE WHEN event_id%10>0 THEN (y*4)::DOUBLE END AS dm, CASE WHEN event_id%7>2 THEN event_id%7-2 END AS sh, CASE WHEN event_id%9>3 THEN event_id%9-2 END AS eh, event_id%4 AS st, CASE WHEN event_id%5>1 THEN 3 END AS atr, CASE WHEN event_id%6>1 THEN x::DOUBLE END AS gp,
 event_id%4 AS nv, CASE event_id%4 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS nu, CASE WHEN event_id%8>0 THEN x%5 END AS vs, x%5 AS ss,
 CASE x%4 WHEN 0 THEN 'boundary_outside_band' WHEN 1 THEN 'no_boundary_evidence' WHEN 2 THEN 'prior_disagreement' ELSE 'weak' END AS ra, CASE y%3 WHEN 0 THEN 'no_boundary_evidence' WHEN 1 THEN 'weak' ELSE 'boundary_outside_band' END AS rb FROM claims c),
wr AS (SELECT *, """ + RAIL + """ AS warn, CASE WHEN v1 AND va=color THEN 1 ELSE 0 END AS e1, CASE WHEN v2 THEN 1 ELSE 0 END AS e2 FROM ev),
bt AS (SELECT *, CASE WHEN e1=1 AND (e2=0 OR coalesce(vd,1e300)<=wd) THEN 1 WHEN e2=1 THEN 2 ELSE 0 END AS pick FROM wr),
bb AS (SELECT *, CASE pick WHEN 1 THEN vd WHEN 2 THEN wd END AS bd, CASE pick WHEN 1 THEN vh WHEN 2 THEN wh END AS bh, CASE pick WHEN 1 THEN vp END AS ba FROM bt),
jd AS (SELECT *, CASE WHEN kind='pot' THEN CASE WHEN NOT av THEN 'unconfirmed|probe|'||coalesce(note,'no probe evidence')||'|' WHEN cu AND cm AND cp THEN 'rejected|vanish|vanished_ball_still_on_cloth|' WHEN c0 IS NULL OR c1 IS NULL THEN 'unconfirmed|census|no cloth census measured|'
  WHEN comp=false THEN 'unconfirmed|census|census_source_mismatch|' WHEN c0<2 THEN 'unconfirmed|census|census_too_sparse|' WHEN c0-c1<1 THEN 'rejected|census|census_did_not_drop|' WHEN cx>c0-1 THEN 'rejected|census|census_recovered|' WHEN pick=0 THEN 'unconfirmed|vanish|no_vanished_ball_measured|'
  WHEN bd IS NULL OR bd>100 THEN 'rejected|pocket|vanished_ball_not_at_pocket|' WHEN bh<1 THEN 'unconfirmed|vanish|vanished_ball_not_established|' WHEN ba<=0 THEN 'rejected|approach|no_approach_to_pocket|'
  ELSE 'confirmed|pot|census_drop+vanished_ball_at_pocket'||coalesce('+'||warn,'')||'|geometry' END
 ELSE CASE WHEN NOT av THEN 'unconfirmed|probe|'||coalesce(note,'no probe evidence')||'|' WHEN fp IS NULL OR tp IS NULL THEN 'unconfirmed|geometry|claim_not_projectable|' WHEN least(fp,tp)<-2 THEN 'rejected|geometry|off_cloth|'
  WHEN coalesce(cd>=300,false) AND ch>=2 AND ce>=2 AND ct>=1 AND coalesce(cg<=60,true) THEN 'confirmed|displacement|census_displacement_corroborated'||coalesce('+'||warn,'')||'|census' WHEN dm IS NULL THEN 'unconfirmed|displacement|no_matched_ball_measured|'
  WHEN dm<300 THEN 'rejected|displacement|displacement_not_corroborated|' WHEN coalesce(sh<2,false) OR coalesce(eh<2,false) THEN 'rejected|observation|displacement_unobserved_elsewhere|' WHEN coalesce(atr>0,false) AND st<2 THEN 'unconfirmed|stability|displacement_not_stable|'
  WHEN gp>60 THEN 'confirmed|displacement|displacement_corroborated+geometry_mismatch'||coalesce('+'||warn,'')||'|window' ELSE 'confirmed|displacement|displacement_corroborated'||coalesce('+'||warn,'')||'|geometry' END END AS v FROM bb),
jj AS (SELECT *, split_part(v,'|',1) AS status, split_part(v,'|',2) AS gate, split_part(v,'|',3) AS reasons, nullif(split_part(v,'|',4),'') AS tier FROM jd)"""


def evidence(spark, sf):
    """Nullable evidence per claim, by integer arithmetic, so every gate branch is reached."""
    e = F.expr
    c = B.claims(spark, sf)
    pot = F.struct(
        e("event_id % 11 <> 0").alias("available"), e("case when event_id % 22 = 0 then 'no frames' end").alias("note"), e("color = 'click'").alias("color_unique"),
        e("event_id % 3 = 0").alias("color_measured"), e("event_id % 5 = 0").alias("color_present"), e("case when event_id % 13 > 0 then double(x % 6) end").alias("census_pre"),
        e("case when event_id % 17 > 0 then double(y % 4) end").alias("census_post"), e("case when event_id % 9 > 0 then double(y % 4 + (event_id % 8) div 7) end").alias("census_post_max"),
        e("case event_id % 19 when 0 then false when 1 then null else true end").alias("comparable"),
        e("""filter(array(if(event_id % 10 < 8, named_struct('color', if(event_id % 7 = 0, 'other', color), 'dist_mm', if(event_id % 6 > 0, double(x * 2), null), 'pre_hits', event_id % 3,
             'approach_mm', if(event_id % 4 > 0, double(y % 50 - 10), null)), null), if(event_id % 15 = 2, named_struct('color', string(null), 'dist_mm', double(y * 2), 'pre_hits', event_id % 4, 'approach_mm', double(null)), null)), v -> v is not null)""").alias("vanish"))
    shot = F.struct(
        e("event_id % 11 <> 0").alias("available"), e("case when event_id % 22 = 0 then 'no frames' end").alias("note"), e("case when event_id % 12 > 0 then double(x - 3) end").alias("from_px"),
        e("case when event_id % 14 > 0 then double(y - 4) end").alias("to_px"), e("case when event_id % 8 = 1 then double(x * 5) end").alias("census_disp_mm"), e("event_id % 5").alias("census_start_hits"),
        e("event_id % 4").alias("census_end_hits"), e("event_id % 3").alias("census_moved"), e("case when event_id % 2 = 1 then double(y % 90) end").alias("census_gap_px"),
        e("case when event_id % 10 > 0 then double(y * 4) end").alias("disp_mm"), e("case when event_id % 7 > 2 then event_id % 7 - 2 end").alias("start_hits"),
        e("case when event_id % 9 > 3 then event_id % 9 - 2 end").alias("end_hits"), e("event_id % 4").alias("stable_hits"), e("case when event_id % 5 > 1 then 3 end").alias("anchor_tries"), e("case when event_id % 6 > 1 then double(x) end").alias("gap_px"))
    rail = e("""case event_id % 4 when 2 then map('left', case x % 4 when 0 then 'boundary_outside_band' when 1 then 'no_boundary_evidence' when 2 then 'prior_disagreement' else 'weak' end)
        when 3 then map('left', case x % 4 when 0 then 'boundary_outside_band' when 1 then 'no_boundary_evidence' when 2 then 'prior_disagreement' else 'weak' end,
                        'top', case y % 3 when 0 then 'no_boundary_evidence' when 1 then 'weak' else 'boundary_outside_band' end) else map() end""")
    return c.withColumn("pot", pot).withColumn("shot", shot).withColumn("warn", T.calibration_warning(e("case when event_id % 8 > 0 then x % 5 end"), e("x % 5"), rail))


def judged(spark, sf):
    return T.judge(evidence(spark, sf), "pot", "shot", F.col("warn"))


@query("p18_calibration_warning", B.sql(EVIDENCE + "\nSELECT event_id, warn FROM wr", "claims"))
def p18(spark, sf):
    return evidence(spark, sf).select("event_id", "warn")


def flat(df):
    return df.select("event_id", "verdict.status", "verdict.gate", F.array_join("verdict.reasons", "+").alias("reasons"), "verdict.tier")


@query("g1_pot_gate", B.sql(EVIDENCE + "\nSELECT event_id, status, gate, reasons, tier FROM jj WHERE kind='pot'", "claims"))
def g1(spark, sf):
    return flat(T.with_pot_gate(evidence(spark, sf).filter("kind = 'pot'"), "pot", "color", F.col("warn")))


@query("g2_shot_gate", B.sql(EVIDENCE + "\nSELECT event_id, status, gate, reasons, tier FROM jj WHERE kind='shot'", "claims"))
def g2(spark, sf):
    return flat(evidence(spark, sf).filter("kind = 'shot'").withColumn("verdict", T.shot_gate(F.col("shot"), F.col("warn"))))


@query("g2_judge", B.sql(EVIDENCE + "\nSELECT event_id, status, gate, reasons, tier FROM jj", "claims"))
def judge_all(spark, sf):
    return flat(judged(spark, sf))


@query("g3_compare_references", B.sql(EVIDENCE + """,
rd AS (SELECT r.event_id, w.ref, min(sqrt(power(CASE WHEN w.ref='own' THEN r.mx ELSE (n.h0*r.x+n.h1*r.y+n.h2)/(n.h6*r.x+n.h7*r.y+n.h8) END-qx,2)+power(CASE WHEN w.ref='own' THEN r.my ELSE (n.h3*r.x+n.h4*r.y+n.h5)/(n.h6*r.x+n.h7*r.y+n.h8) END-qy,2))) AS dist
 FROM resolved r JOIN maps n ON n.dataset=r.dataset AND n.seg=(r.seg+1)%6, (VALUES ('own'),('next')) w(ref), pockets GROUP BY ALL),
rv AS (SELECT b.event_id, d.ref, CASE WHEN NOT av THEN 'unconfirmed' WHEN cu AND cm AND cp THEN 'rejected' WHEN c0 IS NULL OR c1 IS NULL OR comp=false OR c0<2 THEN 'unconfirmed' WHEN c0-c1<1 OR cx>c0-1 THEN 'rejected' WHEN dist>100 THEN 'rejected' ELSE 'confirmed' END AS st FROM bb b JOIN rd d USING (event_id))
SELECT event_id, max(st) FILTER (WHERE ref='own') AS own, max(st) FILTER (WHERE ref='next') AS next, max(st) FILTER (WHERE ref='own')<>max(st) FILTER (WHERE ref='next') AS flips FROM rv GROUP BY event_id""", "claims", "resolved", "pockets"))
def g3(spark, sf):
    seg = B.segments(spark, sf).withColumn("h", G.homography(F.col("quad")))
    nxt = seg.select("dataset", ((F.col("seg") + 5) % 6).alias("seg"), F.col("h").alias("next_h"))
    base = C.resolve_segment(evidence(spark, sf), seg.join(nxt, ["dataset", "seg"]))
    both = base.withColumn("ref", F.explode(F.array(F.struct(F.lit("own").alias("reference"), F.col("segment.h").alias("h")), F.struct(F.lit("next").alias("reference"), F.col("segment.next_h").alias("h")))))
    near = both.withColumn("reference", F.col("ref.reference")).withColumn("mm", G.project(F.col("ref.h"), F.col("x"), F.col("y"))).withColumn("near", G.nearest_pocket(F.col("mm.x"), F.col("mm.y")))
    v = F.array(F.struct(F.col("color").alias("color"), F.col("near.dist").alias("dist_mm"), F.lit(2).cast("long").alias("pre_hits"), F.lit(None).cast("double").alias("approach_mm")))
    return T.compare_references(T.with_pot_gate(near.withColumn("pot", F.col("pot").withField("vanish", v)), "pot", "color"))


@query("a16_summarize_verdicts", B.sql(EVIDENCE + """
SELECT kind, status, count(*) AS n, count(*) FILTER (WHERE status='confirmed' AND tier='geometry') AS geometry, count(*) FILTER (WHERE status='confirmed') AS confirmed, (2*grouping(kind)+grouping(status))::BIGINT AS level,
 round(count(*) FILTER (WHERE status='confirmed' AND tier='geometry')/nullif(count(*) FILTER (WHERE status='confirmed'),0),6) AS precision_proxy FROM jj GROUP BY CUBE (kind, status)""", "claims"))
def a16(spark, sf):
    return rounded(T.summarize_verdicts(judged(spark, sf)))


@query("a16_reason_histogram", B.sql(EVIDENCE + "\nSELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons,'+')) AS reason FROM jj) GROUP BY reason", "claims"))
def a16r(spark, sf):
    return T.reason_histogram(judged(spark, sf))


@query("a17_near_misses", B.sql(EVIDENCE + """,
sc AS (SELECT event_id, 2.0*(CASE WHEN v1 AND coalesce(vd<=150,false) AND vh>=2 THEN 1 ELSE 0 END + CASE WHEN v2 AND wd<=150 AND wh>=2 THEN 1 ELSE 0 END) + CASE WHEN c0-c1>=1 THEN 1 ELSE 0 END + CASE WHEN dm>=150 THEN 1 ELSE 0 END + CASE WHEN cd>=150 THEN 1 ELSE 0 END AS score, reasons FROM jj WHERE status<>'confirmed')
SELECT event_id, score::DOUBLE AS score, reasons FROM sc WHERE score>0 ORDER BY score DESC, event_id LIMIT 5""", "claims"))
def a17(spark, sf):
    return T.near_misses(judged(spark, sf)).select("event_id", "score", F.array_join("verdict.reasons", "+").alias("reasons"))


@query("p19_strengths", B.sql("""
SELECT event_id, CASE WHEN coalesce(dr,0)<1 THEN 0 ELSE CASE WHEN dr<=2 THEN 1.4 WHEN dr<=4 THEN 0.6 ELSE -1.0 END + CASE WHEN pm IS NOT NULL THEN greatest(0.0, 1.6*(1.0-pm/300.0)) ELSE -0.5 END + CASE WHEN ms>3 THEN -0.5*(ms-3) ELSE 0 END END::DOUBLE AS pot,
 round((coalesce(least(3.0, dp/500.0),0) + CASE WHEN event_id%3>0 THEN 0.5 ELSE 0 END + least(1.5, coalesce(mo,0)/30.0) - CASE WHEN src='pair' AND coalesce(mo,0)<8 THEN 2.5 ELSE 0 END - CASE WHEN src='motion' THEN 0.25 ELSE 0 END)::DOUBLE,6) AS shot
FROM (SELECT event_id, CASE WHEN event_id%7>0 THEN x%7 END AS dr, CASE WHEN event_id%5>0 THEN (y*2)::DOUBLE END AS pm, y%8 AS ms, CASE WHEN event_id%4>0 THEN (x*10)::DOUBLE END AS dp, CASE WHEN event_id%6>0 THEN (y%60)::DOUBLE END AS mo, CASE WHEN event_id%2=0 THEN 'pair' ELSE 'motion' END AS src FROM claims)""", "claims"))
def p19(spark, sf):
    e = F.expr
    c = B.claims(spark, sf)
    pot = P.pot_strength(e("case when event_id % 7 > 0 then x % 7 end"), e("case when event_id % 5 > 0 then double(y * 2) end"), e("y % 8"))
    shot = P.shot_strength(e("case when event_id % 4 > 0 then double(x * 10) end"), e("event_id % 3 > 0"), e("case when event_id % 6 > 0 then double(y % 60) end"), e("if(event_id % 2 = 0, 'pair', 'motion')"))
    return c.select("event_id", pot.alias("pot"), F.round(shot, 6).alias("shot"))


@query("p20_occlusion_status", B.sql("""
SELECT c.event_id, CASE WHEN max(d.event_id) IS NULL THEN 'silent' WHEN bool_or(d.score>=0.7) THEN 'occluded' ELSE 'clear' END AS occlusion FROM claims c LEFT JOIN detections d ON d.dataset=c.dataset AND d.source='scored'
 AND d.us BETWEEN c.us AND c.us+1800000000 GROUP BY c.event_id""", "claims"))
def p20(spark, sf):
    d = B.detections(spark, sf).filter("source = 'scored'").withColumn("covered", F.col("score") >= 0.7)
    c = B.claims(spark, sf).select("event_id", "dataset", F.col("us").alias("u0"), (F.col("us") + SEC // 2).alias("u1"))
    return T.occlusion_status(c, d, ["dataset"], "u0", "u1", 12 * SEC).select("event_id", "occlusion")


@query("j15_agreement", B.sql("""
, f AS (SELECT doc_id AS id, 0 AS file_no, verdict FROM verdicts WHERE gate<>'unconfirmed' UNION ALL SELECT doc_id, 1, CASE verdict WHEN 'correct' THEN 'wrong' ELSE verdict END FROM verdicts),
o AS (SELECT id, arg_min(verdict, file_no) AS owner_verdict FROM f GROUP BY id), q AS (SELECT v.doc_id AS id, v.gate AS status FROM verdicts v JOIN documents d USING (doc_id) WHERE d.lang<>'fr')
SELECT id, owner_verdict, coalesce(status,'not-in-queue') AS gate_status, CASE owner_verdict WHEN 'wrong' THEN coalesce(status,'not-in-queue')='rejected' WHEN 'correct' THEN coalesce(status,'not-in-queue')='confirmed' END AS agrees FROM o LEFT JOIN q USING (id)""".lstrip()[1:], "verdicts"))
def j15(spark, sf):
    v = B.verdicts(spark, sf).withColumnRenamed("doc_id", "id")
    f = v.filter("gate <> 'unconfirmed'").select("id", F.lit(0).alias("file_no"), "verdict").unionByName(
        v.select("id", F.lit(1).alias("file_no"), F.when(F.col("verdict") == "correct", "wrong").otherwise(F.col("verdict")).alias("verdict")))
    docs = B.table(spark, sf, "documents").filter("lang <> 'fr'").select(F.col("doc_id").alias("id"))
    return T.agreement(v.join(docs, "id").select("id", F.col("gate").alias("status")), f)


@query("a31_consolidate", B.sql("""
, v AS (SELECT p.event_id AS id, p.dataset, p.frame_no+1 AS frame_no, p.color, p.x*10.0::DOUBLE AS mx, p.y*10.0::DOUBLE AS my, CASE WHEN p.event_id%6>0 THEN (p.x+p.y)*1.0::DOUBLE END AS dist, p.event_id%5 AS hits FROM detections p WHERE NOT EXISTS (
 SELECT 1 FROM detections c WHERE c.dataset=p.dataset AND c.color=p.color AND c.frame_no=p.frame_no+1 AND (c.x-p.x)*(c.x-p.x)+(c.y-p.y)*(c.y-p.y)<=900)),
o AS (SELECT *, row_number() OVER (PARTITION BY dataset, frame_no ORDER BY dist IS NULL, coalesce(dist,0), id) AS rn FROM v),
fold AS (SELECT DISTINCT dataset, frame_no, 0::BIGINT AS rn, []::STRUCT(id BIGINT, color VARCHAR, mx DOUBLE, my DOUBLE)[] AS kept, NULL::BIGINT AS id, NULL::BIGINT AS leader, NULL::BIGINT AS hits FROM o UNION ALL
 SELECT dataset, frame_no, rn, CASE WHEN same IS NULL THEN list_append(kept, {'id':id,'color':color,'mx':mx,'my':my}) ELSE kept END, id, coalesce(same.id, id), hits FROM (
  SELECT f.dataset, f.frame_no, o.rn, f.kept, o.id, o.color, o.mx, o.my, o.hits, list_filter(f.kept, lambda k: k.color=o.color AND sqrt((k.mx-o.mx)*(k.mx-o.mx)+(k.my-o.my)*(k.my-o.my))<=200)[1] AS same FROM fold f JOIN o ON o.dataset=f.dataset AND o.frame_no=f.frame_no AND o.rn=f.rn+1))
SELECT dataset, frame_no, leader AS id, max(hits) AS hits, count(*) AS merged FROM fold WHERE id IS NOT NULL GROUP BY ALL""".lstrip()[1:], "detections", recursive=True))
def a31(spark, sf):
    d = B.detections(spark, sf).withColumnRenamed("event_id", "id")
    b = d.select("dataset", "frame_no", "color", "id", "x", "y")
    gone = J.vanished(b.withColumn("frame_no", F.col("frame_no") + 1), b, 30, ["dataset", "frame_no", "color"])
    v = gone.select("dataset", "frame_no", "color", "id", (F.col("px") * 10.0).alias("mx"), (F.col("py") * 10.0).alias("my"),
                    F.when(F.col("id") % 6 > 0, (F.col("px") + F.col("py")) * 1.0).alias("dist"), (F.col("id") % 5).alias("hits"))
    return T.consolidate(v, ["dataset", "frame_no"])
