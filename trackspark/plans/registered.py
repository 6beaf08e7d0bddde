"""Registered functions called from SQL on the driver tables."""

from __future__ import annotations

from ..functions.registered import register

QUERIES, ORACLE = {}, {}


def query(name, sql):
    def add(fn):
        QUERIES[name] = fn
        ORACLE[name] = sql
        return fn
    return add


def tables(spark, sf, *names):
    register(spark)
    for n in names:
        spark.read.parquet(f"{sf}/{n}.parquet").createOrReplaceTempView(f"registered_{n}")


@query("u4_nearest_rank", """
WITH g AS (SELECT user_id, date_trunc('day', ts) AS day, list_sort(list(value)) AS v FROM events GROUP BY ALL)
SELECT user_id, epoch_us(day)//86400000000 AS day, v[round_even(0.5*(len(v)-1),0)::BIGINT+1] AS p50, v[round_even(0.9::DOUBLE*(len(v)-1),0)::BIGINT+1] AS p90 FROM g""")
def u4_rank(spark, sf):
    tables(spark, sf, "events")
    return spark.sql("SELECT user_id, unix_micros(cast(date_trunc('day', ts) as timestamp)) div 86400000000 AS day, nearest_rank(value, 0.5D) AS p50, nearest_rank(value, 0.9D) AS p90 "
                     "FROM (SELECT user_id, value, cast(ts as timestamp) AS ts FROM registered_events) GROUP BY user_id, date_trunc('day', ts)")


@query("u4_medoid", """
WITH f AS (SELECT vec_id, vec_id//50 AS burst, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.burst, a.label, a.vec_id, coalesce(sum(CASE WHEN a.vec_id<>b.vec_id THEN list_dot_product(a.v,b.v)/sqrt(list_dot_product(a.v,a.v)*list_dot_product(b.v,b.v)) END),0) AS score FROM f a JOIN f b USING (burst, label) GROUP BY ALL)
SELECT burst, label, arg_min(vec_id, (-round(score,9), vec_id)) AS medoid, count(*) AS faces FROM s GROUP BY ALL""")
def u4_medoid(spark, sf):
    tables(spark, sf, "embeddings")
    return spark.sql("SELECT vec_id div 50 AS burst, label, medoid(vec_id, cast(embedding as array<double>)) AS medoid, "
                     "leader_count(vec_id, cast(embedding as array<double>), 2.0D) AS faces FROM registered_embeddings GROUP BY vec_id div 50, label")  # beyond a bar of 1 every face leads


@query("u4_leader_count", """
WITH RECURSIVE f AS (SELECT vec_id//50 AS burst, label, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY vec_id//50, label ORDER BY vec_id) AS rn FROM embeddings),
w AS (SELECT burst, label, rn, [v] AS leaders FROM f WHERE rn=1 UNION ALL
 SELECT f.burst, f.label, f.rn, CASE WHEN len(list_filter(w.leaders, lambda x: list_dot_product(x,f.v)/sqrt(list_dot_product(x,x)*list_dot_product(f.v,f.v))>=0.1))=0 THEN list_append(w.leaders,f.v) ELSE w.leaders END
 FROM w JOIN f ON f.burst=w.burst AND f.label=w.label AND f.rn=w.rn+1)
SELECT burst, label, CAST(max(len(leaders)) AS BIGINT) AS leaders FROM w GROUP BY ALL""")
def u4_leaders(spark, sf):
    tables(spark, sf, "embeddings")
    return spark.sql("SELECT vec_id div 50 AS burst, label, leader_count(vec_id, cast(embedding as array<double>), 0.1D) AS leaders FROM registered_embeddings GROUP BY vec_id div 50, label")


@query("u5_bracket_times", """
SELECT event_id, epoch_us(ts)+k*500000 AS at_us, CAST(k AS INTEGER) AS step FROM events, unnest(range(-3, 5)) t(k)""")
def u5_times(spark, sf):
    tables(spark, sf, "events")
    return spark.sql("SELECT e.event_id, b.at_us, b.step FROM (SELECT event_id, unix_micros(cast(ts as timestamp)) AS us FROM registered_events) e, LATERAL bracket_times(e.us, 1500000L, 2000000L, 500000L) b")


@query("u5_grid_points", """
SELECT s_suppkey AS id, CAST(c AS INTEGER) AS col, CAST(r AS INTEGER) AS row, s_nationkey+(s_suppkey%7+1)*c/4.0::DOUBLE AS x, (s_suppkey%5+1)*r/2.0::DOUBLE AS y FROM supplier, unnest(range(0,5)) a(c), unnest(range(0,3)) b(r)""")
def u5_grid(spark, sf):
    tables(spark, sf, "supplier")
    return spark.sql("SELECT s.s_suppkey AS id, g.col, g.row, g.x, g.y FROM registered_supplier s, "
                     "LATERAL grid_points(cast(s.s_nationkey as double), 0.0D, cast(s.s_nationkey + s.s_suppkey % 7 + 1 as double), cast(s.s_suppkey % 5 + 1 as double), 5, 3) g")


@query("u5_sweep", """
WITH b AS (SELECT k AS step, 0.1::DOUBLE+0.8::DOUBLE*k/8 AS bar FROM unnest(range(0,9)) t(k))
SELECT user_id, CAST(step AS INTEGER) AS step, round(bar,6) AS bar, count(*) FILTER (WHERE value/500>=bar) AS hits FROM events, b GROUP BY ALL""")
def u5_sweep(spark, sf):
    tables(spark, sf, "events")
    return spark.sql("SELECT e.user_id, s.step, round(s.bar, 6) AS bar, count_if(e.value / 500 >= s.bar) AS hits FROM registered_events e, LATERAL sweep(0.1D, 0.9D, 9) s GROUP BY e.user_id, s.step, s.bar")


@query("u5_bracket_slots", """
WITH t AS (SELECT o_custkey AS tournament, count(*) AS n FROM orders GROUP BY o_custkey), s AS (SELECT tournament, n, CAST(ceil(log2(n)) AS BIGINT) AS rounds FROM t),
r AS (SELECT tournament, rounds, unnest(range(1, rounds+1)) AS round FROM s)
SELECT tournament, CAST(round AS INTEGER) AS round, CAST(unnest(range(0, CAST(pow(2, rounds-round) AS BIGINT))) AS INTEGER) AS slot FROM r""")
def u5_slots(spark, sf):
    tables(spark, sf, "orders")
    return spark.sql("SELECT t.tournament, s.round, s.slot FROM (SELECT o_custkey AS tournament, cast(count(*) as int) AS n FROM registered_orders GROUP BY o_custkey) t, LATERAL bracket_slots(t.n) s")
