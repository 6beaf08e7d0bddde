"""Views over the driver tables: the same integer arithmetic in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_2024_US = 1_704_067_200_000_000
FRAME_US = 14_400_000_000
HOUR_US = 3_600_000_000
# Units keep their size as the tables grow: more recordings, nights and tracklets, not longer ones.
USERS_PER_RECORDING, USERS_PER_SERIES, ORDERS_PER_NIGHT, FACES_PER_TRACKLET = 38, 9, 75, 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(df: DataFrame, col: str):
    """Epoch microseconds of a timestamp column, whatever the session time zone."""
    if df.schema[col].dataType.typeName() == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {col})")
    return F.unix_micros(col)


def _whole(col: str, size: int):
    return F.expr(f"{col} div {size}L")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "user_id", _whole("user_id", USERS_PER_RECORDING).alias("dataset"), micros(e, "ts").alias("us"),
        F.col("event_type").alias("color"), "value",
        ((F.col("event_id") * 37 + F.col("user_id") * 11) % 127).alias("x"),
        ((F.col("event_id") * 91 + F.col("user_id") * 53) % 254).alias("y"),
        F.when(F.col("event_id") % 3 == 0, "scored").otherwise("plain").alias("source"),
        (((F.col("event_id") * 17) % 101) / 100.0).alias("score"),
    ).withColumn("frame_no", ((F.col("us") - F.col("us") % FRAME_US) / FRAME_US).cast("long")).withColumn(
        "t", (F.col("us") - EPOCH_2024_US) / 3.6e9
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", _whole("user_id", USERS_PER_SERIES).alias("dataset"), micros(e, "ts").alias("us"),
        F.col("event_type").alias("color"), F.col("value").alias("signal"), "user_id",
    ).withColumn("t", (F.col("us") - EPOCH_2024_US) / 3.6e9)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).withColumn("track_id", F.col("user_id"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six calibration ranges per recording seen in the data; corner k moves by seg*(k+1) px."""
    keys = table(spark, sf_dir, "events").select(_whole("user_id", USERS_PER_RECORDING).alias("dataset")).distinct()
    corners = ((0, 0), (126, 0), (126, 253), (0, 253))
    quad = F.array(*[
        F.struct((F.lit(x) + F.col("seg") * (k + 1)).cast("double").alias("x"),
                 (F.lit(y) + F.col("seg") * (k + 1)).cast("double").alias("y"))
        for k, (x, y) in enumerate(corners)
    ])
    return keys.withColumn("seg", F.explode(F.sequence(F.lit(0), F.lit(5)))).select(
        "dataset", F.col("seg").cast("long").alias("seg"),
        (F.col("seg") * 120.0).alias("t_start"), ((F.col("seg") + 1) * 120.0 - 1.0).alias("t_end"),
        quad.alias("quad"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every detection is one claim; its kind alternates."""
    return detections(spark, sf_dir).withColumn("kind", F.when(F.col("event_id") % 2 == 0, "pot").otherwise("shot"))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    n = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"))
    return l.crossJoin(n).select(
        _whole("l_orderkey", ORDERS_PER_NIGHT).alias("night"), "l_orderkey", "l_linenumber",
        F.col("l_linenumber").cast("long").alias("round"),
        F.col("l_suppkey").alias("side_a"),
        ((F.col("l_suppkey") + 1 + F.col("l_partkey") % (F.col("n") - 1)) % F.col("n")).alias("side_b"),
        "l_partkey", F.col("l_quantity").cast("long").alias("qty"),
        F.expr("case l_returnflag when 'A' then 'played' when 'R' then 'forfeit' else 'bye' end").alias("result"),
        micros(l, "l_shipdate").alias("completed_us"), "l_linestatus",
    ).withColumn("winner", F.when(F.col("qty") >= 25, F.col("side_a")).otherwise(F.col("side_b")))


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return v.select(
        "vec_id", F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("vec"),
        F.expr("vec_id div 50").alias("burst"), F.expr("vec_id div 5").alias("frame"),
        _whole("vec_id", FACES_PER_TRACKLET).alias("tracklet"), (F.col("vec_id") % 2).alias("role"),
        (F.col("vec_id") % 20).alias("eye_px"), ((F.col("vec_id") % 10) / 10.0).alias("det_score"),
    )


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faces(spark, sf_dir).filter("vec_id % 5 = 0").select("vec_id", F.col("label").alias("player"), "vec")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faces(spark, sf_dir).filter("vec_id % 5 <> 0").select(
        "vec_id", F.col("label").alias("expected"), "role", "burst", "vec")


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        "doc_id",
        F.expr("case when toxic = 1 then 'wrong' when quality = 1 then 'correct' else 'unsure' end").alias("verdict"),
        F.expr("case doc_id % 3 when 0 then 'confirmed' when 1 then 'rejected' else 'unconfirmed' end").alias("gate"),
    )


SQL_VIEWS = {
    "detections": """
SELECT event_id, user_id, user_id // 38 AS dataset, epoch_us(ts) AS us, event_type AS color, value,
       (event_id*37 + user_id*11) % 127 AS x, (event_id*91 + user_id*53) % 254 AS y,
       CASE WHEN event_id % 3 = 0 THEN 'scored' ELSE 'plain' END AS source,
       ((event_id*17) % 101) / 100.0 AS score, epoch_us(ts) // 14400000000 AS frame_no,
       (epoch_us(ts) - 1704067200000000) / 3.6e9 AS t FROM events""",
    "series": """
SELECT event_id, user_id // 9 AS dataset, epoch_us(ts) AS us, event_type AS color, value AS signal, user_id,
       (epoch_us(ts) - 1704067200000000) / 3.6e9 AS t FROM events""",
    "tracks": "SELECT *, user_id AS track_id FROM detections",
    "segments": """
SELECT d.dataset, s.seg, s.seg*120.0::DOUBLE AS t_start, (s.seg+1)*120.0::DOUBLE - 1.0 AS t_end,
       (0+seg*1)::DOUBLE AS x0, (0+seg*1)::DOUBLE AS y0, (126+seg*2)::DOUBLE AS x1, (0+seg*2)::DOUBLE AS y1,
       (126+seg*3)::DOUBLE AS x2, (253+seg*3)::DOUBLE AS y2, (0+seg*4)::DOUBLE AS x3, (253+seg*4)::DOUBLE AS y3
FROM (SELECT DISTINCT user_id // 38 AS dataset FROM events) d, (SELECT unnest(range(6)) AS seg) s""",
    # the projective map is derived here by eliminating the 8 unknowns of the unit-square map
    "maps": """
SELECT *, (1269.0*AA)/II AS h0, (1269.0*BB)/II AS h1, (1269.0*CC)/II AS h2, (2539.0*DD)/II AS h3,
       (2539.0*EE)/II AS h4, (2539.0*FF)/II AS h5, GG/II AS h6, HH/II AS h7, 1.0::DOUBLE AS h8
FROM (SELECT *, e*1-f*h AS AA, c*h-b*1 AS BB, b*f-c*e AS CC, f*g-d*1 AS DD, a*1-c*g AS EE, c*d-a*f AS FF,
             d*h-e*g AS GG, b*g-a*h AS HH, a*e-b*d AS II
      FROM (SELECT *, x1-x0+g*x1 AS a, x3-x0+h*x3 AS b, x0 AS c, y1-y0+g*y1 AS d, y3-y0+h*y3 AS e, y0 AS f
            FROM (SELECT *, (sx*dy2-dx2*sy)/den AS g, (dx1*sy-sx*dy1)/den AS h
                  FROM (SELECT *, dx1*dy2-dx2*dy1 AS den
                        FROM (SELECT *, x1-x2 AS dx1, x3-x2 AS dx2, x0-x1+x2-x3 AS sx,
                                     y1-y2 AS dy1, y3-y2 AS dy2, y0-y1+y2-y3 AS sy FROM segments)))))""",
    "resolved": """
SELECT d.*, m.seg, m.clamped,
       CASE WHEN abs(wz) < 1e-12 THEN NULL ELSE px/wz END AS mx, CASE WHEN abs(wz) < 1e-12 THEN NULL ELSE py/wz END AS my
FROM detections d JOIN (
  SELECT event_id, seg, NOT inside AS clamped, h0*x+h1*y+h2 AS px, h3*x+h4*y+h5 AS py, h6*x+h7*y+h8 AS wz FROM (
    SELECT d.event_id, d.x, d.y, g.*, (d.t BETWEEN g.t_start AND g.t_end) AS inside,
           row_number() OVER (PARTITION BY d.event_id ORDER BY (d.t BETWEEN g.t_start AND g.t_end) DESC,
             CASE WHEN d.t BETWEEN g.t_start AND g.t_end THEN 0 ELSE least(abs(d.t-g.t_start), abs(d.t-g.t_end)) END,
             g.t_start, g.t_end) AS rn
    FROM detections d JOIN maps g USING (dataset)) WHERE rn = 1) m USING (event_id)""",
    "pockets": """
SELECT * FROM (VALUES (0,'head-left',0.0::DOUBLE,0.0::DOUBLE),(1,'head-right',1270.0,0.0),(2,'foot-right',1270.0,2540.0),
 (3,'foot-left',0.0,2540.0),(4,'left-side',0.0,1270.0),(5,'right-side',1270.0,1270.0)) p(ord, pocket, qx, qy)""",
    "claims": """
SELECT *, CASE WHEN event_id % 2 = 0 THEN 'pot' ELSE 'shot' END AS kind FROM detections""",
    "matches": """
SELECT l_orderkey // 75 AS night, l_orderkey, l_linenumber, l_linenumber::BIGINT AS round, l_suppkey AS side_a,
       (l_suppkey + 1 + l_partkey % ((SELECT count(*) FROM supplier) - 1)) % (SELECT count(*) FROM supplier) AS side_b,
       l_partkey, l_quantity::BIGINT AS qty,
       CASE l_returnflag WHEN 'A' THEN 'played' WHEN 'R' THEN 'forfeit' ELSE 'bye' END AS result,
       epoch_us(l_shipdate) AS completed_us, l_linestatus,
       CASE WHEN l_quantity >= 25 THEN l_suppkey
            ELSE (l_suppkey + 1 + l_partkey % ((SELECT count(*) FROM supplier) - 1)) % (SELECT count(*) FROM supplier) END AS winner
FROM lineitem""",
    "faces": """
SELECT vec_id, label::BIGINT AS label, embedding::DOUBLE[] AS vec, vec_id // 50 AS burst, vec_id // 5 AS frame,
       vec_id // 20 AS tracklet, vec_id % 2 AS role, vec_id % 20 AS eye_px, (vec_id % 10) / 10.0 AS det_score FROM embeddings""",
    "gallery": "SELECT vec_id, label AS player, vec FROM faces WHERE vec_id % 5 = 0",
    "probes": "SELECT vec_id, label AS expected, role, burst, vec FROM faces WHERE vec_id % 5 <> 0",
    "verdicts": """
SELECT doc_id, CASE WHEN toxic = 1 THEN 'wrong' WHEN quality = 1 THEN 'correct' ELSE 'unsure' END AS verdict,
       CASE doc_id % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' ELSE 'unconfirmed' END AS gate FROM labels""",
}
_NEEDS = {
    "tracks": ["detections"], "maps": ["segments"], "resolved": ["detections", "segments", "maps"],
    "claims": ["detections"], "gallery": ["faces"], "probes": ["faces"],
}


def sql(body: str, *views: str, recursive: bool = False) -> str:
    """Prefix ``body`` (optionally with its own CTEs after ``,``) with the named views."""
    names: list[str] = []
    for v in views:
        for n in [*_NEEDS.get(v, []), v]:
            if n not in names:
                names.append(n)
    head = ",\n".join(f"{n} AS ({SQL_VIEWS[n].strip()})" for n in names)
    body = body.strip()
    if not body.upper().startswith("SELECT"):
        head, body = f"{head},\n{body}", ""
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}\n{body}"
