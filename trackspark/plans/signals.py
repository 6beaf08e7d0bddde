"""Signal, summary and interval operators bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..operators import kernels as K
from ..operators import signals as S
from ..operators import stats as T
from ..session import cut_lineage

QUERIES, ORACLE = {}, {}
SEC = B.HOUR_US
DS = ["dataset"]


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes])


def series(spark, sf):
    return B.series(spark, sf)


def indexed(spark, sf):
    # consumed by several branches below, so the ordered series is written once
    return cut_lineage(K.ordered_index(series(spark, sf), DS, ["event_id"], "us", S.DAY))


IDX = "idx AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY us, event_id)-1 AS idx FROM series)"
DT = """dts AS (SELECT dataset, quantile_cont(d,0.5) AS dt FROM (SELECT dataset, us-lag(us) OVER (PARTITION BY dataset ORDER BY idx) AS d FROM idx) GROUP BY dataset)"""


@query("a1_summary", B.sql("""
SELECT dataset, color, count(signal) AS n, min(signal) AS min, max(signal) AS max, round(quantile_cont(signal,0.05),6) AS p05, round(quantile_cont(signal,0.1),6) AS p10,
 round(median(signal),6) AS median, round(quantile_cont(signal,0.9),6) AS p90, round(quantile_cont(signal,0.95),6) AS p95 FROM series GROUP BY ALL""", "series"))
def a1(spark, sf):
    s = series(spark, sf)
    return rounded(T.summary(s, "signal", ["dataset", "color"], s))


@query("a2_percentile_ranks", B.sql("""
, o AS (SELECT dataset, list(signal ORDER BY signal) AS v, count(*) AS n FROM series GROUP BY dataset)
SELECT dataset, n, v[greatest(0, least(n-1, ceil(0.9::DOUBLE*n)::BIGINT-1))+1] AS ceil_p90, v[least(n-1, round_even(0.9::DOUBLE*(n-1),0)::BIGINT)+1] AS round_p90 FROM o""".lstrip()[1:], "series"))
def a2(spark, sf):
    s = series(spark, sf)
    a = T.percentile_rank(s, "signal", DS, 0.9, "ceil").withColumnRenamed("value", "ceil_p90")
    b = T.percentile_rank(s, "signal", DS, 0.9, "round").select("dataset", F.col("value").alias("round_p90"))
    return a.join(b, "dataset").select("dataset", "n", "ceil_p90", "round_p90")


@query("a2_rolling_last_120", B.sql(IDX + """,
w AS (SELECT event_id, list_sort(list(signal) OVER (PARTITION BY dataset ORDER BY idx ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)) AS v FROM idx)
SELECT event_id, v[round_even(0.5*(len(v)-1),0)::BIGINT+1] AS p50, v[round_even(0.95*(len(v)-1),0)::BIGINT+1] AS p95, v[len(v)] AS max FROM w""", "series"))
def a2r(spark, sf):
    return T.rolling_rank(indexed(spark, sf), DS, "idx", "signal", {"p50": 0.5, "p95": 0.95, "max": 1.0}).select("event_id", "p50", "p95", "max")


@query("a3_series_stats", B.sql("""
, c AS (SELECT dataset, 'signal' AS channel, signal AS v FROM series UNION ALL SELECT dataset, 'occ', (event_id%100)/100.0::DOUBLE FROM series)
SELECT dataset, channel, count(*) AS n, min(v) AS min, max(v) AS max, round(median(v),9) AS median, round(quantile_cont(v,0.9),9) AS p90, round(quantile_cont(v,0.99),9) AS p99,
 round(quantile_cont(v,0.999),9) AS p999, round(quantile_cont(v,0.999)*1.25,9) AS threshold FROM c GROUP BY ALL""".lstrip()[1:], "series"))
def a3(spark, sf):
    s = series(spark, sf).withColumn("occ", (F.col("event_id") % 100) / 100.0)
    return rounded(T.channel_floors(T.series_stats(s, DS, ["signal", "occ"])), 9)


CTRL = """ctl AS (SELECT dataset, us AS c0 FROM series WHERE signal<=2.5),
wn AS (SELECT dataset, min(w0) AS w0, max(w1) AS w1 FROM (SELECT *, sum(o) OVER (PARTITION BY dataset ORDER BY w0) AS run FROM (
 SELECT *, CASE WHEN w0 <= max(w1) OVER (PARTITION BY dataset ORDER BY w0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o
 FROM (SELECT dataset, c0-9000000000 AS w0, c0+9000000000 AS w1 FROM ctl))) GROUP BY dataset, run),
fl AS (SELECT *, (event_id*7%100)/100.0 < 0.3 AS ok FROM series),
hd AS (SELECT f.* FROM fl f JOIN wn w ON w.dataset=f.dataset AND f.us BETWEEN w.w0 AND w.w1)"""
def ok():
    return (F.col("event_id") * 7 % 100) / 100.0 < 0.3


def controls(spark, sf):
    return series(spark, sf).filter("signal <= 2.5").select("dataset", F.col("us").alias("at"))


@query("a4_noise_floor", B.sql(CTRL + """
SELECT w.dataset, n_windows, excluded, n, min, max, median, p99, floor, threshold FROM (SELECT dataset, count(*) AS n_windows FROM wn GROUP BY dataset) w LEFT JOIN (
 SELECT dataset, count(*) FILTER (WHERE NOT ok) AS excluded, count(*) FILTER (WHERE ok) AS n, min(signal) FILTER (WHERE ok) AS min, max(signal) FILTER (WHERE ok) AS max,
 round(median(signal) FILTER (WHERE ok),9) AS median, round(quantile_cont(signal,0.99) FILTER (WHERE ok),9) AS p99, round(quantile_cont(signal,0.999) FILTER (WHERE ok),9) AS floor,
 round(quantile_cont(signal,0.999) FILTER (WHERE ok)*1.25,9) AS threshold FROM hd GROUP BY dataset) USING (dataset)""", "series"))
def a4(spark, sf):
    return rounded(S.noise_floor(series(spark, sf), controls(spark, sf), DS, int(2.5 * SEC), ok()), 9)


@query("a5_calibrate", B.sql(CTRL + """,
a AS (SELECT dataset, quantile_cont(signal,0.999) FILTER (WHERE ok) AS fc FROM hd GROUP BY dataset),
b AS (SELECT dataset, quantile_cont(signal,0.999) FILTER (WHERE ok) AS fw, count(*) AS samples FROM fl GROUP BY dataset),
th AS (SELECT dataset, fc, fw, samples, greatest(coalesce(fc,0),coalesce(fw,0))*1.25 AS bar FROM b LEFT JOIN a USING (dataset)),
c AS (SELECT h.dataset, count(*) AS cs, count(*) FILTER (WHERE ok) AS ce, count(*) FILTER (WHERE ok AND signal>=bar) AS ab FROM hd h JOIN th USING (dataset) GROUP BY h.dataset)
SELECT dataset, round(fc,9) AS floor_controls, round(fw,9) AS floor_whole, round(bar,9) AS threshold, samples, coalesce(cs,0) AS control_samples, coalesce(ce,0) AS control_eligible,
 coalesce(ab,0) AS above, round(coalesce(cs,0)/samples,9) AS share, round(coalesce(ab,0)/greatest(1,coalesce(ce,0)),9) AS false_rate FROM th LEFT JOIN c USING (dataset)""", "series"))
def a5(spark, sf):
    return rounded(S.calibrate(series(spark, sf), controls(spark, sf), DS, int(2.5 * SEC), ok()), 9)


@query("a6_quiet_windows", B.sql("""
, q AS (SELECT dataset, quantile_cont(signal,0.1) AS cut FROM series GROUP BY dataset),
r AS (SELECT s.dataset, s.event_id, row_number() OVER (PARTITION BY s.dataset ORDER BY us, event_id)-1 AS i, count(*) OVER (PARTITION BY s.dataset) AS n FROM series s JOIN q USING (dataset) WHERE signal<=cut)
SELECT dataset, event_id FROM r WHERE i % greatest(1, n//20) = 0 AND i / greatest(1, n//20) < 20""".lstrip()[1:], "series"))
def a6(spark, sf):
    return S.quiet_windows(series(spark, sf), DS, "signal", 20, 0.1).select("dataset", "event_id")


@query("a6_quiet_blocks", B.sql("""
, e AS (SELECT dataset, min(us) AS t0, max(us) AS t1 FROM series GROUP BY dataset),
k AS (SELECT s.dataset, (us-t0)//36000000000 AS block, quantile_cont(signal,0.9) AS p90 FROM series s JOIN e USING (dataset) WHERE t0+((us-t0)//36000000000+1)*36000000000<=t1 GROUP BY ALL)
SELECT dataset, block, round(p90,6) AS p90, rank FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY p90, block)::INTEGER AS rank FROM k) WHERE rank<=14""".lstrip()[1:], "series"))
def a6b(spark, sf):
    return rounded(S.quiet_blocks(series(spark, sf), DS, "signal", 10 * SEC))


@query("a6_spread_controls", B.sql("""
, b AS (SELECT dataset, us-1704067200000000 AS us FROM series WHERE signal>=150), g AS (SELECT dataset, s.step, floor(2592000000000*step/41)::BIGINT AS g0 FROM (SELECT DISTINCT dataset FROM b), (SELECT unnest(range(1,41))::INTEGER AS step) s)
SELECT dataset, step, g0 AS "at" FROM g WHERE g0>=5400000000 AND g0+9000000000<=2592000000000 AND NOT EXISTS (SELECT 1 FROM b WHERE b.dataset=g.dataset AND abs(b.us-g.g0)<=36000000000)""".lstrip()[1:], "series"))
def a6c(spark, sf):
    ev = series(spark, sf).filter("signal >= 150").select("dataset", (F.col("us") - B.EPOCH_2024_US).alias("us"))
    return S.spread_controls(ev, DS, 720 * SEC, 40, 10 * SEC, int(1.5 * SEC), int(2.5 * SEC)).select("dataset", "step", "at")


@query("w2_running_median", B.sql("""
, f AS (SELECT dataset, frame_no, count(*) AS n FROM detections GROUP BY ALL)
SELECT dataset, frame_no, n, quantile_cont(n,0.5) OVER (PARTITION BY dataset ORDER BY frame_no ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)::DOUBLE AS median FROM f""".lstrip()[1:], "detections"))
def w2(spark, sf):
    f = B.detections(spark, sf).groupBy("dataset", "frame_no").agg(F.count(F.lit(1)).alias("n"))
    return T.running_median(f, DS, "frame_no", "n", 40, 4096)


BASE = ", " + IDX + ",\n" + DT + """,
wh AS (SELECT dataset, median(signal) AS med, count(*) AS total FROM series GROUP BY dataset),
sh AS (SELECT *, ceil(total/block)::BIGINT AS nb, round_even(72000000000.0::DOUBLE/greatest(18000000000.0::DOUBLE,dt),0)::BIGINT AS half FROM (
 SELECT dataset, dt, med, total, greatest(1, round_even(18000000000.0::DOUBLE/greatest(dt,1),0)::BIGINT) AS block FROM dts JOIN wh USING (dataset))),
vl AS (SELECT i.dataset, i.idx//block AS blk, signal FROM idx i JOIN sh USING (dataset) UNION ALL SELECT dataset, blk, med FROM (SELECT dataset, med, unnest(range(total, nb*block))//block AS blk FROM sh)),
md AS (SELECT dataset, blk, median(signal) AS m FROM vl GROUP BY ALL),
sm AS (SELECT m.dataset, m.blk, CASE WHEN half=0 OR nb<=2*half THEN (SELECT median(z.m) FROM md z WHERE z.dataset=m.dataset)
  ELSE (SELECT median(z.m) FROM md z WHERE z.dataset=m.dataset AND abs(z.blk-greatest(half,least(m.blk,nb-1-half)))<=half) END AS s FROM md m JOIN sh USING (dataset)),
ps AS (SELECT i.*, dt, greatest(0.0, least((idx-(block-1)/2.0)/block, nb-1.0))::DOUBLE AS p FROM idx i JOIN sh USING (dataset)),
bl AS (SELECT ps.*, a.s + coalesce((b.s-a.s)*(p-floor(p)),0) AS baseline FROM ps JOIN sm a ON a.dataset=ps.dataset AND a.blk=floor(p) LEFT JOIN sm b ON b.dataset=ps.dataset AND b.blk=floor(p)+1)"""
BASE = BASE[2:]


@query("w3_rolling_baseline", B.sql(BASE + "\nSELECT event_id, round(baseline,9) AS baseline FROM bl", "series"))
def w3(spark, sf):
    return S.rolling_baseline(indexed(spark, sf), DS, 20 * SEC, 5 * SEC).select("event_id", F.round("baseline", 9).alias("baseline"))


ONSETS = BASE + """,
ac AS (SELECT *, greatest(1, round_even(900000000.0::DOUBLE/greatest(dt,1),0)::BIGINT) AS gp FROM bl WHERE signal>=120),
rn AS (SELECT *, sum(CASE WHEN idx-pi<=gp THEN 0 ELSE 1 END) OVER (PARTITION BY dataset ORDER BY idx) AS run FROM (SELECT *, lag(idx) OVER (PARTITION BY dataset ORDER BY idx) AS pi FROM ac)),
ons AS (SELECT dataset, min(us) AS onset_us, arg_max(us,(signal,-idx)) AS peak_us, max(signal) AS peak, max(idx)-min(idx)+1 AS n_frames, max(us)-min(us) AS active_us,
 arg_min(baseline, idx) AS baseline, max(signal)/120 AS excess FROM rn GROUP BY dataset, run)"""


def onsets(spark, sf):
    base = S.rolling_baseline(indexed(spark, sf), DS, 20 * SEC, 5 * SEC)
    return S.detect_onsets(base, DS, 120.0, SEC // 4)


@query("w4_detect_onsets", B.sql(ONSETS + "\nSELECT dataset, onset_us, peak_us, peak, n_frames, active_us, round(baseline,9) AS baseline, round(excess,9) AS excess FROM ons", "series"))
def w4(spark, sf):
    return rounded(onsets(spark, sf).select("dataset", "onset_us", "peak_us", "peak", "n_frames", "active_us", "baseline", "excess"), 9)


def quick_onsets(spark, sf):
    i = indexed(spark, sf)
    return S.detect_onsets(i.join(S.sample_step(i, DS), "dataset"), DS, 120.0, SEC // 4)


@query("w5_enforce_gap", B.sql(ONSETS + """,
cl AS (SELECT *, sum(CASE WHEN peak_us-pp<3600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY dataset ORDER BY peak_us) AS c FROM (SELECT *, lag(peak_us) OVER (PARTITION BY dataset ORDER BY peak_us) AS pp FROM ons)),
od AS (SELECT *, row_number() OVER (PARTITION BY dataset, c ORDER BY peak DESC, onset_us) AS rn FROM cl),
fold AS (SELECT DISTINCT dataset, c, 0::BIGINT AS rn, []::BIGINT[] AS kept, NULL::BIGINT AS onset_us, NULL::BIGINT AS peak_us FROM od UNION ALL
 SELECT f.dataset, f.c, o.rn, CASE WHEN len(list_filter(f.kept, lambda k: abs(k-o.peak_us)<3600000000))=0 THEN list_append(f.kept,o.peak_us) ELSE f.kept END,
  CASE WHEN len(list_filter(f.kept, lambda k: abs(k-o.peak_us)<3600000000))=0 THEN o.onset_us END, o.peak_us FROM fold f JOIN od o ON o.dataset=f.dataset AND o.c=f.c AND o.rn=f.rn+1)
SELECT dataset, onset_us, peak_us FROM fold WHERE onset_us IS NOT NULL""", "series", recursive=True))
def w5(spark, sf):
    return S.enforce_gap(quick_onsets(spark, sf), DS, SEC).select("dataset", "onset_us", "peak_us")


@query("w6_decay_shape", B.sql(ONSETS + """,
sg AS (SELECT o.dataset, o.onset_us, s.us, s.signal AS v FROM ons o JOIN series s ON s.dataset=o.dataset AND s.us BETWEEN o.onset_us AND o.onset_us+21600000000),
pk AS (SELECT dataset, onset_us, count(*) AS n, max(v) AS peak, arg_min(us,(-v,us)) AS pus, arg_min(v, (abs(us-onset_us-1800000000),us)) AS level_05, arg_min(v, (abs(us-onset_us-3600000000),us)) AS level_10 FROM sg GROUP BY ALL),
tl AS (SELECT pk.*, min(us) FILTER (WHERE v<=peak/2) AS hu, min(us) FILTER (WHERE v<=peak*0.25) AS eu FROM pk JOIN sg USING (dataset, onset_us) WHERE us>=pus GROUP BY ALL),
st AS (SELECT tl.dataset, tl.onset_us, count(*) AS c, count(*) FILTER (WHERE v<pv) AS falls FROM (SELECT tl.dataset, tl.onset_us, us, v, lag(v) OVER (PARTITION BY tl.dataset, tl.onset_us ORDER BY us) AS pv
  FROM tl JOIN sg USING (dataset, onset_us) WHERE us>=pus AND (eu IS NULL OR us<=eu)) tl GROUP BY ALL)
SELECT dataset, onset_us, n::INTEGER AS n, peak, round((hu-onset_us)/3.6e9,6) AS half_s, round((eu-onset_us)/3.6e9,6) AS active_s, round(falls/greatest(1,c-1),6) AS monotone, level_05, level_10,
 CASE WHEN n<3 THEN 'no data' WHEN eu IS NULL THEN 'persists' WHEN (eu-onset_us)/3.6e9<=0.25 THEN 'spike' WHEN falls/greatest(1,c-1)>=0.6 THEN 'decays' ELSE 'ends unevenly' END AS verdict
FROM tl JOIN st USING (dataset, onset_us)""", "series"))
def w6(spark, sf):
    return rounded(S.decay_shape(quick_onsets(spark, sf), series(spark, sf), DS, 6 * SEC, SEC))


PROFILE = """ev AS (SELECT event_id, dataset, us FROM series WHERE signal>=120),
gd AS (SELECT ev.*, k.k, us + (k.k*360000000 - 5400000000) AS g FROM ev, (SELECT unnest(range(41)) AS k) k),
nx AS (SELECT dataset, us, min(signal) AS v FROM series GROUP BY ALL), la AS (SELECT dataset, arg_max(v, us) AS lastv FROM (SELECT dataset, us, max(signal) AS v FROM series GROUP BY ALL) GROUP BY dataset),
sm AS (SELECT g.event_id, g.dataset, g.k, coalesce(n.v, lastv) AS v FROM gd g ASOF LEFT JOIN nx n ON n.dataset=g.dataset AND g.g<=n.us JOIN la ON la.dataset=g.dataset)"""


@query("w7_window_profile", B.sql(PROFILE + """
SELECT dataset, event_id, count(*) AS n, max(v) AS peak, median(v) AS median, round((arg_min(k,(-v,k))*360000000-5400000000)/3.6e9,6) AS peak_offset_s,
 CASE WHEN max(v)<60 THEN 'none' WHEN abs((arg_min(k,(-v,k))*360000000-5400000000)/3.6e9)<=0.5 THEN 'at' ELSE 'elsewhere' END AS verdict FROM sm GROUP BY ALL""", "series"))
def w7(spark, sf):
    s = series(spark, sf)
    out = S.window_profile(s.filter("signal >= 120"), s, DS, "event_id", F.lit(60.0), SEC)
    return out.withColumn("peak_offset_s", F.round("peak_offset_s", 6))


@query("w8_occlusion_reading", B.sql("""
, s AS (SELECT dataset, event_id, us, (event_id*7%100)/100.0::DOUBLE AS dense, (event_id*3%50)/1000.0::DOUBLE AS share FROM series),
e AS (SELECT event_id, dataset, us FROM series WHERE signal>=120),
j AS (SELECT e.event_id, e.dataset, e.us, s.us AS su, dense, share FROM e LEFT JOIN s ON s.dataset=e.dataset AND s.us BETWEEN e.us-5400000000 AND e.us+9000000000)
SELECT dataset, event_id, count(su) AS n, max(dense) AS dense_peak, round(median(dense),6) AS dense_median, round((arg_min(su,(-dense,su))-any_value(us))/3.6e9,6) AS dense_offset_s, max(share) AS share_peak,
 round(median(share),6) AS share_median, round((arg_min(su,(-share,su))-any_value(us))/3.6e9,6) AS share_offset_s, max(dense)>=0.3 OR max(share)>=0.02 AS explained FROM j GROUP BY ALL""".lstrip()[1:], "series"))
def w8(spark, sf):
    s = series(spark, sf).withColumn("dense", (F.col("event_id") * 7 % 100) / 100.0).withColumn("share", (F.col("event_id") * 3 % 50) / 1000.0)
    out = S.peak_in_window(s.filter("signal >= 120"), s, DS, "event_id", ["dense", "share"], SEC, 1.5, 2.5)
    bars = (F.col("dense_peak") >= S.OCC_DENSE_MIN) | (F.col("share_peak") >= S.OCC_SHARE_MIN)
    return rounded(out.withColumn("explained", bars))


@query("p21_classify_timing", B.sql(PROFILE + """,
p AS (SELECT event_id, max(v) AS peak, (arg_min(k,(-v,k))*360000000-5400000000)/3.6e9 AS off FROM sm GROUP BY ALL),
f AS (SELECT *, (event_id%50)::DOUBLE AS fl, event_id%3=0 AS occ FROM p)
SELECT event_id, CASE WHEN peak<greatest(fl*3,3) THEN 'no motion anywhere in window' WHEN abs(off)<=0.5 THEN 'motion at the served time' ELSE 'motion elsewhere in window' END AS timing,
 CASE WHEN fl>=60 THEN 'not separable from controls' WHEN peak<greatest(fl*1.5,60) THEN 'no ball-scale motion' WHEN abs(off)<=0.5 THEN 'at the served time' ELSE 'elsewhere in window' END AS ball_scale,
 CASE WHEN occ AND abs(off)>0.5 THEN 'occlusion-explained elsewhere' WHEN occ THEN 'occlusion-explained at t' WHEN peak<60 THEN 'no motion separable' WHEN abs(off)<=0.5 THEN 'ball-scale motion at t' ELSE 'ball-scale motion elsewhere' END AS combined FROM f""", "series"))
def p21(spark, sf):
    s = series(spark, sf)
    p = S.window_profile(s.filter("signal >= 120"), s, DS, "event_id", F.lit(60.0), SEC)
    fl, off = (F.col("event_id") % 50).cast("double"), F.col("peak_offset_s")
    return p.select("event_id", S.classify_timing(F.col("peak"), off, fl).alias("timing"), S.ball_scale_verdict(F.col("peak"), off, fl).alias("ball_scale"),
                    S.combined_verdict(F.col("verdict"), F.col("event_id") % 3 == 0, off).alias("combined"))


@query("w13_group_onsets", B.sql("""
, r AS (SELECT *, sum(CASE WHEN us-pu<=540000000 THEN 0 ELSE 1 END) OVER (PARTITION BY dataset ORDER BY us, event_id) AS run FROM (SELECT *, lag(us) OVER (PARTITION BY dataset ORDER BY us, event_id) AS pu FROM series))
SELECT event_id, min(us) OVER (PARTITION BY dataset, run) AS group_us, count(*) OVER (PARTITION BY dataset, run) AS members, count(*) OVER (PARTITION BY dataset, run)>=3 AS is_break FROM r""".lstrip()[1:], "series"))
def w13(spark, sf):
    return S.group_onsets(series(spark, sf), DS, int(0.15 * SEC)).select("event_id", "group_us", "members", "is_break")


@query("w24_clock_drift", B.sql(IDX + """,
r AS (SELECT *, (us-min(us) OVER (PARTITION BY dataset))/3.6e9 - idx/0.87 AS drift FROM idx)
SELECT dataset, count(*) AS samples, round(max(abs(drift)),6) AS max_abs_drift_s, round(arg_max(drift, idx),6) AS last_drift_s FROM (SELECT *, max(idx) OVER (PARTITION BY dataset) AS mi FROM r) WHERE idx%30=0 OR idx=mi GROUP BY dataset""", "series"))
def w24(spark, sf):
    return rounded(S.drift(indexed(spark, sf), DS, 0.87, 30, SEC))


@query("w28_footprint_split", B.sql("""
, p AS (SELECT dataset, color, event_id, signal, (event_id*3%100)/1000.0::DOUBLE AS change, us FROM series)
SELECT dataset, color, count(*) FILTER (WHERE change<=0.02) AS pairs, max(signal) FILTER (WHERE change<=0.02) AS peak, arg_min(change,(-signal,us)) FILTER (WHERE change<=0.02) AS change,
 arg_min(us,(-signal,us)) FILTER (WHERE change<=0.02) AS "at", round(avg(signal) FILTER (WHERE change<=0.02),6) AS mean FROM p GROUP BY ALL""".lstrip()[1:], "series"))
def w28(spark, sf):
    s = series(spark, sf).withColumn("change", (F.col("event_id") * 3 % 100) / 1000.0)
    return S.footprint_split(s, ["dataset", "color"], F.col("signal"), F.col("change"), F.col("us")).withColumn("mean", F.round("mean", 6))


@query("i1_merge_intervals", B.sql(CTRL + "\nSELECT dataset, w0, w1 FROM wn", "series"))
def i1(spark, sf):
    half = int(2.5 * SEC)
    return K.merge_intervals(controls(spark, sf).select("dataset", (F.col("at") - half).alias("w0"), (F.col("at") + half).alias("w1")), DS, "w0", "w1", S.DAY)


@query("i2_interval_gaps", B.sql("""
, iv AS (SELECT dataset, event_id, us AS s, us + (event_id%5)*1800000000 AS e FROM series),
p AS (SELECT *, lag(e) OVER (PARTITION BY dataset ORDER BY s, e, event_id) AS pe FROM iv)
SELECT event_id, CASE WHEN s>pe THEN s-pe END AS gap_us, s<pe AS overlaps FROM p WHERE pe IS NOT NULL AND s<>pe""".lstrip()[1:], "series"))
def i2(spark, sf):
    iv = series(spark, sf).select("dataset", "event_id", F.col("us").alias("s"), (F.col("us") + (F.col("event_id") % 5) * (SEC // 2)).alias("e"))
    i = K.ordered_index(iv, DS, ["e", "event_id"], "s", S.DAY)
    p = K.bounded_lag(i, DS, "idx", ["e"])
    return p.filter("prev_e is not null and s <> prev_e").select(
        "event_id", F.when(F.col("s") > F.col("prev_e"), F.col("s") - F.col("prev_e")).alias("gap_us"), (F.col("s") < F.col("prev_e")).alias("overlaps"))


@query("i5_union_sets", B.sql("""
, u AS (SELECT 'a' AS s, 0 AS p, dataset, us//3600000000 AS h FROM series WHERE color='view' UNION ALL SELECT 'b', 1, dataset, us//3600000000 FROM series WHERE color IN ('view','click'))
SELECT dataset, h, arg_min(s,p) AS source FROM u GROUP BY dataset, h""".lstrip()[1:], "series"))
def i5(spark, sf):
    from ..operators.selection import union_sets
    s = series(spark, sf).withColumn("h", F.expr(f"us div {SEC}"))
    return union_sets([("a", s.filter("color = 'view'")), ("b", s.filter("color in ('view', 'click')"))], ["dataset", "h"])
