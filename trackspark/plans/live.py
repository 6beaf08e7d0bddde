"""Live operators replayed from the driver tables as streams of files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from .. import bindings as B
from ..streaming import live as R
from ..streaming import stages as U
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


def events(spark, sf, ending=None):
    """The events table as a stream, with the integer time beside the timestamp."""
    e = R.replay_table(spark, sf, "events", ending)
    return e.withColumn("us", B.micros(e, "ts")).withColumn("ts", F.timestamp_micros("us"))


def end_of_events(spark, sf):
    return R.Ending(spark, R.table_schema(spark, sf, "events"), ts=datetime(2200, 1, 1))


@query("r1_frame_outcomes", """
WITH f AS (SELECT epoch_us(ts)//86400000000 AS day, CASE WHEN event_id%5=0 THEN 'no_frame_ready' WHEN event_id%37*1000>33000 THEN 'stale' WHEN value*300>33000 THEN 'stage_overrun' ELSE 'processed' END AS outcome FROM events)
SELECT day, outcome, count(*) AS n FROM f GROUP BY ALL""")
def r1(spark, sf):
    e = events(spark, sf).withColumn("received_us", F.col("us")).withColumn("pickup_us", F.when(F.col("event_id") % 5 > 0, F.col("us") + F.col("event_id") % 37 * 1000)).withColumn(
        "finish_us", F.col("pickup_us") + (F.col("value") * 300).cast("long"))
    counts = R.drain(R.outcome_counts(R.frame_outcomes(e, 33000)), "complete")
    return counts.select(F.expr("unix_micros(window_start) div 86400000000").alias("day"), "outcome", "n")


@query("r2_latency_summary", """
WITH w AS (SELECT event_id, event_type AS color, value, list_sort(list(value) OVER (PARTITION BY event_type ORDER BY epoch_us(ts), event_id ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)) AS v FROM events)
SELECT color, event_id, len(v) AS count, v[round_even(0.5*(len(v)-1),0)::BIGINT+1] AS p50, v[round_even(0.95::DOUBLE*(len(v)-1),0)::BIGINT+1] AS p95, v[len(v)] AS max, value AS last FROM w""")
def r2(spark, sf):
    end = end_of_events(spark, sf)
    e = events(spark, sf, end).withColumnRenamed("event_type", "color")
    return R.drain(R.latency_summary(e, "color", "value", ["us", "event_id"]), ending=end)


STAGES = """SELECT event_id, user_id//9 AS source, CASE WHEN event_id%2=0 THEN value END AS table_value, CASE WHEN event_id%5=0 THEN event_type END AS person, concat_ws('+', CASE WHEN event_id%2=0 THEN 'table_value' END, CASE WHEN event_id%5=0 THEN 'person' END) AS ran,
 CASE WHEN event_id%2=0 AND value>60 THEN 'table_value' WHEN event_id%5=0 AND (event_id%40>33 OR CASE WHEN event_id%2=0 THEN value ELSE 0 END + event_id%40>70) THEN 'person' END AS overrun FROM events"""


@query("r3_run_stages", STAGES)
def r3(spark, sf):
    stages = [U.Stage("table_value", lambda d: F.col("value"), lambda d: F.col("value"), every=2, budget_ms=60.0),
              U.Stage("person", lambda d: F.col("event_type"), lambda d: F.col("event_id") % 40, every=5, budget_ms=33.0)]
    out = U.run_stages(events(spark, sf), stages, "event_id", 70.0)
    # a total above the frame budget on the first stage is already its own overrun (60 < 70)
    return R.drain(out.select("event_id", F.expr("user_id div 9L").alias("source"), "table_value", "person", F.array_join("ran", "+").alias("ran"), "overrun"))


@query("r4_stream_pots", B.sql("""
, p AS (SELECT *, lag(us) OVER (PARTITION BY dataset, color ORDER BY us, event_id) AS pu FROM detections), r AS (SELECT *, sum(CASE WHEN us-pu<1800000000 THEN 0 ELSE 1 END) OVER (PARTITION BY dataset, color ORDER BY us, event_id) AS run FROM p),
s AS (SELECT dataset, color, min(us) AS start_us, max(us)+1800000000 AS end_us, count(*) AS n, max(score) AS peak FROM r GROUP BY dataset, color, run), m AS (SELECT max(us) AS mx FROM detections)
SELECT dataset, color, start_us, n, peak, CASE WHEN end_us+3600000000<=mx THEN 'pot' ELSE 'unknown' END AS status, CASE WHEN end_us+3600000000<=mx THEN 'persistence_clear' ELSE 'no_persistence_window' END AS reason FROM s, m""".lstrip()[1:], "detections"))
def r4(spark, sf):
    end = end_of_events(spark, sf)
    e = events(spark, sf, end).select(F.expr("user_id div 38L").alias("dataset"), F.col("event_type").alias("color"), "ts", (F.col("event_id") * 17 % 101 / 100.0).alias("score"))
    s = R.drain(R.activity_sessions(e, ["dataset", "color"], "30 minutes", delay="1 hour"), ending=end)
    d = B.detections(spark, sf).agg(F.timestamp_micros(F.max("us")).alias("mx"))
    out = R.stream_pots(s.crossJoin(d), "mx", 3600.0)
    return out.select("dataset", "color", F.unix_micros("start_ts").alias("start_us"), "n", "peak", "status", "reason")


def tracker_input(df):
    return df.select(F.expr("user_id div 38L").alias("dataset"), ((F.col("us") - F.col("us") % B.FRAME_US) / B.FRAME_US).cast("long").alias("frame_no"), "us", "event_id",
                     (((F.col("event_id") * 37 + F.col("user_id") * 11) % 127) * 10.0).alias("x"), (((F.col("event_id") * 91 + F.col("user_id") * 53) % 254) * 10.0).alias("y"),
                     F.col("event_type").alias("color"), ((F.col("event_id") * 17) % 101 / 100.0).alias("conf"), (F.col("event_id") % 41 == 0).alias("hidden"))


@query("r5_slot_tracker")
def r5(spark, sf):
    end = end_of_events(spark, sf)
    return rounded(R.drain(R.slot_tracker(tracker_input(events(spark, sf, end)), SEC, frame_us=B.FRAME_US, gate=300.0, bootstrap=300.0, patience=9.0), ending=end))


@query("r6_register_identities", """
WITH f AS (SELECT vec_id, vec_id//100 AS camera, vec_id%10 AS track, label::BIGINT AS label, (vec_id%10)/10.0::DOUBLE>=0.47 AND (vec_id%10)/10.0::DOUBLE-(vec_id%7)/10.0::DOUBLE>=0.12 AS sure FROM embeddings),
m AS (SELECT camera, track, min(vec_id) AS first FROM f GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY first) AS cluster FROM m),
b AS (SELECT camera, track, min(vec_id) AS bid FROM f WHERE sure GROUP BY ALL), p AS (SELECT b.*, label AS player FROM b JOIN f ON vec_id=bid)
SELECT f.camera, f.vec_id AS event_id, k.cluster, CASE WHEN f.vec_id>=bid THEN p.player END AS player, coalesce(f.vec_id=bid, false) AS bound_now FROM f JOIN k USING (camera, track) LEFT JOIN p USING (camera, track)""")
def r6(spark, sf):
    end = R.Ending(spark, R.table_schema(spark, sf, "embeddings"), vec_id=1 << 40)
    e = R.replay_table(spark, sf, "embeddings", end)
    o = e.select(F.expr("vec_id div 100L").alias("camera"), (F.col("vec_id") % 10).alias("track"), F.col("embedding").cast("array<double>").alias("vec"), F.col("vec_id").alias("event_id"), F.col("label").cast("long").alias("player"),
                 ((F.col("vec_id") % 10) / 10.0).alias("sim"), ((F.col("vec_id") % 7) / 10.0).alias("runner_up"))
    return R.drain(R.register_identities(o, "camera"), ending=end)


@query("r7_board_changes", """
WITH b AS (SELECT user_id//9 AS night, event_id, epoch_us(ts) AS us, md5(floor(value/50)::BIGINT::VARCHAR) AS digest FROM events), l AS (SELECT *, lag(digest) OVER (PARTITION BY night ORDER BY us, event_id) AS pd FROM b)
SELECT night, event_id, digest FROM l WHERE pd IS NULL OR pd<>digest""")
def r7(spark, sf):
    end = end_of_events(spark, sf)
    b = events(spark, sf, end).select(F.expr("user_id div 9L").alias("night"), "us", "event_id", F.md5(F.floor(F.col("value") / 50).cast("string")).alias("digest"))
    return R.drain(R.board_changes(b, "night", ["us", "event_id"]), ending=end)


@query("r8_append_audit", """
SELECT user_id AS doc, event_id, CASE WHEN event_id%4>0 THEN count(*) FILTER (WHERE event_id%4>0) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) END AS revision, CASE WHEN event_id%4=0 THEN 'stale revision' END AS refusal FROM events""")
def r8(spark, sf):
    end = end_of_events(spark, sf)
    p = events(spark, sf, end).select(F.col("user_id").alias("doc"), "us", "event_id", F.when(F.col("event_id") % 4 == 0, 1).otherwise(0).alias("behind"))
    return R.drain(R.append_audit(p, "doc", ["us", "event_id"]), ending=end)


@query("r9_source_delay", """
SELECT user_id//9 AS source, round((1706745600000000-max(epoch_us(ts)+event_id%7*1000000))/1e6,6) AS delay_s FROM events GROUP BY ALL""")
def r9(spark, sf):
    s = events(spark, sf).select(F.expr("user_id div 9L").alias("source"), F.col("us").alias("program_us"), (F.col("event_id") % 7 * 1000000).alias("duration_us"))
    return rounded(R.drain(R.source_delay(s, "source", F.lit(1706745600000000)), "complete"))
