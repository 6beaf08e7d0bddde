"""Whitelisted public board: one nested JSON per event and a digest of its stable content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def board(matches: DataFrame, standings: DataFrame) -> DataFrame:
    """Bracket rounds, play queue and standings of each event as one struct (an event is a bounded document)."""
    m = matches.groupBy("night").agg(F.array_sort(F.collect_list(F.struct("round", "slot", "status", "side_a", "side_b", "winner"))).alias("matches"))
    s = standings.groupBy("night").agg(F.array_sort(F.collect_list(F.struct("place", "name", "won", "lost", "played"))).alias("standings"))
    b = m.join(s, "night", "left")
    rounds = F.array_sort(F.array_distinct(F.transform("matches", lambda x: x["round"])))
    bracket = F.transform(rounds, lambda r: F.struct(r.alias("round"), F.filter("matches", lambda x: x["round"] == r).alias("matches")))
    queue = F.array_sort(F.transform(F.filter("matches", lambda x: x["status"].isin("scheduled", "delayed")), lambda x: F.struct(
        (x["status"] == "delayed").alias("held"), x["round"].alias("round"), x["slot"].alias("slot"))))
    body = F.struct(F.lit("on").alias("board"), F.col("night").alias("event"), bracket.alias("bracket"), queue.alias("next"), F.col("standings").alias("standings"))
    return b.select("night", body.alias("board"))


def encode(df: DataFrame, served_at: Column) -> DataFrame:
    """Digest over the stable content only; ``served_at`` joins the body after it."""
    stable = F.to_json("board")
    return df.withColumn("digest", F.substring(F.sha2(stable, 256), 1, 16)).withColumn("body", F.to_json(F.col("board").withField("served_at", served_at)))
