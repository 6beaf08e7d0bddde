"""Scans of nested JSON documents and the stamps on their rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME = "t double, frame long, n long, cloth_area long, brightness double, motion double, person_share double, cands array<struct<color:string,cx:double,cy:double,r:double>>"
STAMP_VERSION = 1


def parse_frames(df: DataFrame, doc: str, keep: Sequence[str] = ()) -> DataFrame:
    """Frame records of a list document or of ``{records: [...]}``, one row per record."""
    rows = F.coalesce(F.from_json(F.when(F.ltrim(doc).startswith("["), F.col(doc)), f"array<struct<{_struct(FRAME)}>>"),
                      F.from_json(doc, f"records array<struct<{_struct(FRAME)}>>")["records"])
    return df.withColumn("_r", F.explode(rows)).select(*keep, "_r.*")


def _struct(ddl: str) -> str:
    out, depth, parts = "", 0, []
    for ch in ddl + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = out.strip().split(" ", 1)
            parts.append(f"{name}:{kind}")
            out = ""
        else:
            out += ch
    return ",".join(parts)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frame records of every JSON document under a path (one document per file)."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("doc"))
    return parse_frames(docs, "doc", ["file"])


def detections_of(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    return frames.select(*keys, "t", F.posexplode("cands").alias("position", "_c")).select(*keys, "t", "position", "_c.*")


def read_time_map(docs: DataFrame, doc: str, keys: Sequence[str], precedence: str) -> DataFrame:
    """``{time: [balls]}`` caches merged by the time rounded to 0.1 s; the lowest precedence wins a time."""
    m = docs.withColumn("_m", F.from_json(doc, "map<string,array<struct<color:string,x:double,y:double,score:double>>>"))
    e = m.select(*keys, precedence, F.explode("_m").alias("_t", "_balls")).withColumn("tick", F.rint(F.col("_t").cast("double") * 10).cast("long"))
    best = e.groupBy(*keys, "tick").agg(F.min(F.struct(precedence, "_t", "_balls")).alias("b"))
    return best.select(*keys, "tick", F.col(f"b.{precedence}").alias(precedence), F.posexplode("b._balls").alias("position", "ball")).select(*keys, "tick", precedence, "position", "ball.*")


def stamp(df: DataFrame, producer: str) -> DataFrame:
    """Name every row; rows that cannot be named go to ``refusal`` instead of being written."""
    old = F.col("stamp")
    why = (F.when(F.col("t").isNull() | F.col("type").isNull(), "missing time or type").when(old["producer"] != producer, "stamped by another producer")
           .when(old["version"] > STAMP_VERSION, "newer version"))
    named = F.struct(F.lit(STAMP_VERSION).cast("long").alias("version"), F.lit(producer).alias("producer"))
    return df.withColumn("refusal", why).withColumn("stamp", F.when(F.col("refusal").isNull(), named).otherwise(old))


def classify_stamp(s: Column, producers: Sequence[str]) -> Column:
    ok = (s["version"] == STAMP_VERSION) & s["producer"].isin(*producers)
    return F.when(s.isNull(), "UNSTAMPED").when(ok, "NAMED").otherwise("FOREIGN")


def document_status(df: DataFrame, doc: str, producers: Sequence[str]) -> DataFrame:
    """STAMPED (one producer on every row), UNSTAMPED, or MIXED, from pre-aggregated row classes."""
    k = df.withColumn("_k", classify_stamp(F.col("stamp"), producers))
    g = k.groupBy(doc).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_k") == "UNSTAMPED").alias("unstamped"), F.count_if(F.col("_k") == "FOREIGN").alias("foreign"),
                           F.min(F.when(F.col("_k") == "NAMED", F.col("stamp.producer"))).alias("_lo"), F.max(F.when(F.col("_k") == "NAMED", F.col("stamp.producer"))).alias("_hi"))
    one = F.col("_lo").isNotNull() & (F.col("_lo") == F.col("_hi")) & (F.col("unstamped") == 0) & (F.col("foreign") == 0)
    status = F.when(one, "STAMPED").when(F.col("_lo").isNull() & (F.col("foreign") == 0), "UNSTAMPED").otherwise("MIXED")
    return g.select(doc, "rows", "unstamped", "foreign", status.alias("status"), F.when(one, F.col("_lo")).alias("producer"))


def parse_dataset_id(c: Column) -> Column:
    """STRUCT<vod,start_s,end_s> of a canonical imported id, else null: no leading zeros, end after start."""
    pat = r"^tw-([1-9][0-9]{0,11})(?:-(0|[1-9][0-9]*)-(0|[1-9][0-9]*))?$"
    part = lambda i: F.nullif(F.regexp_extract(c, pat, i), F.lit(""))
    start, end = part(2).try_cast("long"), part(3).try_cast("long")
    ok = c.rlike(pat) & (part(2).isNull() | (end > start))
    return F.when(ok, F.struct(part(1).alias("vod"), start.alias("start_s"), end.alias("end_s")))


def clock(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%d:%02d:%02d", F.expr("0") + F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def dataset_dim(df: DataFrame, known: DataFrame, col: str = "dataset_id") -> DataFrame:
    """Lookup of each id in the registry; unknown or malformed ids answer null."""
    p = df.withColumn("_p", parse_dataset_id(F.col(col)))
    out = p.join(known.select(F.col("vod").alias("_vod"), F.col("title")), F.col("_p.vod") == F.col("_vod"), "left")
    label = F.when(F.col("_p.start_s").isNotNull(), F.concat(clock(F.col("_p.start_s")), F.lit("-"), clock(F.col("_p.end_s"))))
    return out.select(*df.columns, F.col("_p.vod").alias("vod"), F.col("_p.start_s").alias("start_s"), F.col("_p.end_s").alias("end_s"), label.alias("label"), "title")


# Hosts of a broadcast source and paths that are no channel.
SOURCE_HOSTS = ("twitch.tv", "www.twitch.tv")
RESERVED_CHANNELS = ("videos", "directory", "downloads", "settings", "search", "login", "signup", "subscriptions", "inventory", "wallet", "jobs", "turbo")


def canonical_source(url: Column) -> Column:
    """STRUCT<url,kind,subject> of a channel or videos/<digits> URL, else null (host and scheme exactly as typed)."""
    text = F.trim(url)
    pat = r"^https://([^/?#]*)(/[^?#]*)?$"
    host = F.regexp_extract(text, pat, 1)
    path = F.regexp_replace(F.regexp_extract(text, pat, 2), "/+$", "")
    video = F.regexp_extract(path, r"^/videos/([0-9]+)$", 1)
    channel = F.lower(F.regexp_extract(path, r"^/([A-Za-z0-9_]{1,25})$", 1))
    good = text.rlike(pat) & host.isin(*SOURCE_HOSTS)
    canon = F.concat(F.lit("https://www.twitch.tv"), F.lower(path))
    return (F.when(good & (video != ""), F.struct(canon.alias("url"), F.lit("video").alias("kind"), video.alias("subject")))
            .when(good & (channel != "") & ~channel.isin(*RESERVED_CHANNELS), F.struct(canon.alias("url"), F.lit("channel").alias("kind"), channel.alias("subject"))))
