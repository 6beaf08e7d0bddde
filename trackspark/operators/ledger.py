"""Ledger analytics: standings, records, brackets, draws, replays and backfills."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .kernels import ordered_index, stream_fold


def sides(matches: DataFrame) -> DataFrame:
    """One row per (match, side) of the signed results; byes are not results."""
    pair = F.array(F.struct(F.col("side_a").alias("me"), F.col("side_b").alias("opp")), F.struct(F.col("side_b").alias("me"), F.col("side_a").alias("opp")))
    s = matches.filter("result <> 'bye' and side_a is not null and side_b is not null").withColumn("_s", F.explode(pair))
    return s.select("*", F.col("_s.me").alias("me"), F.col("_s.opp").alias("opp")).drop("_s").withColumn("win", (F.col("winner") == F.col("me")).cast("int"))


def standings(matches: DataFrame, names: DataFrame) -> DataFrame:
    """Won/lost/played per event; wins down, rate down (unplayed last), name up."""
    t = sides(matches).groupBy("night", "me").agg(F.sum("win").alias("won"), F.count(F.lit(1)).alias("played"))
    t = t.join(names.select(F.col("id").alias("me"), "name"), "me").withColumn("lost", F.col("played") - F.col("won"))
    w = W.partitionBy("night").orderBy(F.desc("won"), F.desc(F.col("won") / F.col("played")), F.lower("name"))
    return t.select("night", F.col("me").alias("player"), "name", "won", "lost", "played", F.row_number().over(w).cast("long").alias("place"))


def player_record(matches: DataFrame) -> DataFrame:
    """Overall record (forfeits count) with the number of events played."""
    return sides(matches).groupBy(F.col("me").alias("player")).agg(
        F.sum("win").alias("wins"), (F.count(F.lit(1)) - F.sum("win")).alias("losses"), F.count(F.lit(1)).alias("played"), F.countDistinct("night").alias("nights"))


def head_to_head(matches: DataFrame) -> DataFrame:
    """Per opponent; forfeits are kept apart from the played results."""
    played = F.col("result") == "played"
    return sides(matches).groupBy(F.col("me").alias("player"), F.col("opp").alias("opponent")).agg(
        F.coalesce(F.sum(F.when(played, F.col("win"))), F.lit(0)).alias("wins"), F.count_if(played & (F.col("win") == 0)).alias("losses"), F.count_if(played).alias("played"),
        F.count_if(F.col("result") == "forfeit").alias("forfeits"), F.max("completed_us").alias("last_us"))


def champions(matches: DataFrame, order: Sequence[str]) -> DataFrame:
    """Winner of the last match of each event, with its tallies."""
    return matches.groupBy("night").agg(
        F.max_by("winner", F.struct("round", *order)).alias("champion"), F.count_if(F.col("result") == "played").alias("played"),
        F.count_if(F.col("result") == "forfeit").alias("forfeits"), F.count_if(F.col("result") == "bye").alias("byes"), F.max("round").alias("rounds"))


def results_sheet(matches: DataFrame, names: DataFrame, order: Sequence[str]) -> DataFrame:
    """One printed line per match with its place inside the round."""
    def named(col, out):
        return names.select(F.col("id").alias(col), F.col("name").alias(out))
    m = matches.join(named("side_a", "name_a"), "side_a", "left").join(named("side_b", "name_b"), "side_b", "left")
    a_won = F.col("winner") == F.col("side_a")
    win, lose = F.when(a_won, F.col("name_a")).otherwise(F.col("name_b")), F.when(a_won, F.col("name_b")).otherwise(F.col("name_a"))
    line = (F.when(F.col("result") == "bye", F.format_string("%s: bye", win)).when(F.col("result") == "forfeit", F.format_string("%s by forfeit over %s", win, lose))
            .otherwise(F.format_string("%s %d-%d %s", win, F.greatest("qty", F.lit(50) - F.col("qty")), F.least("qty", F.lit(50) - F.col("qty")), lose)))
    placed = ordered_index(m.select("night", "round", *order, line.alias("line")), ["night", "round"], list(order[1:]), order[0], 1 << 16, "pos")
    return placed.withColumn("pos", F.col("pos") + 1)


def win_percent(wins: Column, played: Column) -> Column:
    """Rounded percentage; a dash when nothing was played."""
    return F.when(played > 0, F.concat(F.floor(wins / played * 100 + 0.5).cast("string"), F.lit("%"))).otherwise("—")


def audit_of(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Audit rows whose context id belongs to the event set, and the remainder, flagged."""
    known = ids.select("id").distinct().withColumn("_in", F.lit(True))
    return events.join(known, "id", "left").withColumn("belongs", F.col("_in").isNotNull()).drop("_in")


def link_sources(links: DataFrame, sources: DataFrame) -> DataFrame:
    """Many-to-many event <-> broadcast links: one row per pair, known ranges kept, missing pairs adopted."""
    have = links.groupBy("night", "vod").agg(F.min("start_s").alias("start_s"), F.min("end_s").alias("end_s")).withColumn("origin", F.lit("link"))
    src = sources.groupBy("night", "vod").agg(F.min("start_s").alias("_s"), F.max("end_s").alias("_e"))
    out = have.join(src, ["night", "vod"], "full")
    return out.select("night", "vod", F.coalesce("start_s", "_s").alias("start_s"), F.coalesce("end_s", "_e").alias("end_s"), F.coalesce("origin", F.lit("adopted")).alias("origin"))


def build_brackets(entrants: DataFrame) -> DataFrame:
    """Single elimination for every tournament: next power of two, the first seeds get byes."""
    n = entrants.groupBy("tournament").agg(F.count(F.lit(1)).alias("n"))
    n = n.filter("n >= 2").withColumn("rounds", F.ceil(F.log2(F.col("n").cast("double"))).cast("int")).withColumn("size", F.expr("shiftleft(1L, rounds)"))
    m = n.withColumn("round", F.explode(F.sequence(F.lit(1), F.col("rounds")))).withColumn("slot", F.explode(F.expr("sequence(0L, shiftright(size, round) - 1)")))
    byes = F.col("size") - F.col("n")
    first = F.col("round") == 1
    m = m.withColumn("_a", F.when(first, F.when(F.col("slot") < byes, F.col("slot")).otherwise(byes + 2 * (F.col("slot") - byes)))).withColumn(
        "_b", F.when(first & (F.col("slot") >= byes), byes + 2 * (F.col("slot") - byes) + 1))
    def seat(pos, out):
        return entrants.select("tournament", F.col("position").alias(pos), F.col("entrant").alias(out))
    m = m.join(seat("_a", "side_a"), ["tournament", "_a"], "left").join(seat("_b", "side_b"), ["tournament", "_b"], "left")
    return m.select("tournament", F.col("round").cast("long").alias("round"), "slot", "side_a", "side_b",
                    F.when(~first, 2 * F.col("slot")).alias("parent_a"), F.when(~first, 2 * F.col("slot") + 1).alias("parent_b"))


def propagate(bracket: DataFrame, results: DataFrame, absent: DataFrame) -> DataFrame:
    """Winners climb from their parents round by round, as many rounds as the deepest bracket has.

    results: tournament, round, slot, winner_side (0/1), result.  A side alone completes as a
    bye; a full match without a result is scheduled, or delayed when an entrant is absent.
    """
    gone = absent.select("entrant").distinct()
    res = results.select("tournament", "round", "slot", "winner_side", F.col("result").alias("_res"))
    def settle(df):
        df = df.join(res, ["tournament", "round", "slot"], "left")
        for s in ("a", "b"):
            df = df.join(gone.select(F.col("entrant").alias(f"side_{s}"), F.lit(True).alias(f"_x{s}")), f"side_{s}", "left")
        both, none = F.col("side_a").isNotNull() & F.col("side_b").isNotNull(), F.lit(None)
        ready, held = F.col("ready"), F.coalesce("_xa", F.lit(False)) | F.coalesce("_xb", F.lit(False))
        status = (F.when(~ready, "pending").when(~both, "complete").when(F.col("_res").isNotNull(), "complete").when(held, "delayed").otherwise("scheduled"))
        winner = (F.when(~ready, none).when(~both, F.coalesce("side_a", "side_b")).when(F.col("_res").isNotNull(), F.when(F.col("winner_side") == 0, F.col("side_a")).otherwise(F.col("side_b"))))
        result = F.when(ready & ~both, "bye").when(ready, F.col("_res"))
        return df.select("tournament", "round", "slot", "side_a", "side_b", status.alias("status"), winner.alias("winner"), result.alias("result"))
    # each round feeds the next and the result: written once, so no round is computed twice
    cur = cut_lineage(settle(bracket.filter("round = 1").select("tournament", "round", "slot", "side_a", "side_b", F.lit(True).alias("ready"))))
    out = cur
    rounds = bracket.agg(F.max("round")).first()[0] or 0
    for _ in range(2, rounds + 1):
        fed = cur.groupBy("tournament", (F.col("round") + 1).alias("round"), F.expr("slot div 2").alias("slot")).agg(
            F.max(F.when(F.col("slot") % 2 == 0, F.col("winner"))).alias("side_a"), F.max(F.when(F.col("slot") % 2 == 1, F.col("winner"))).alias("side_b"),
            F.bool_and(F.col("status") == "complete").alias("ready"), F.count(F.lit(1)).alias("_n")).filter("_n = 2")
        cur = cut_lineage(settle(fed.select("tournament", "round", "slot", "side_a", "side_b", "ready")))
        out = out.unionByName(cur)
    return out


def tournament_status(settled: DataFrame) -> DataFrame:
    """Complete when every match of the last round is complete."""
    last = settled.groupBy("tournament").agg(F.max("round").alias("round"))
    return settled.join(last, ["tournament", "round"]).groupBy("tournament").agg(F.bool_and(F.col("status") == "complete").alias("complete"), F.max_by("winner", "slot").alias("champion"))


def revival_pool(matches: DataFrame) -> DataFrame:
    """Round-1 losers of played results; a forfeit loser did not play."""
    lost = F.when(F.col("winner") == F.col("side_a"), F.col("side_b")).otherwise(F.col("side_a"))
    return matches.filter("round = 1 and result = 'played'").select("night", lost.alias("entrant")).distinct()


def bye_slots(settled: DataFrame) -> DataFrame:
    """Round-1 byes whose next match has not been played."""
    nxt = settled.filter("round = 2 and status in ('pending', 'scheduled', 'delayed')").select("tournament", F.col("slot").alias("next_slot"))
    return settled.filter("round = 1 and result = 'bye'").withColumn("next_slot", F.expr("slot div 2")).join(nxt, ["tournament", "next_slot"], "left_semi").select(
        "tournament", "slot", "next_slot", F.col("winner").alias("holder"))


def pairings(pool: DataFrame, seed: int, key: str = "night") -> DataFrame:
    """Random teams of two in a reproducible hash order; odd pools are refused."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("entrant").cast("string")))
    size = pool.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2 and n % 2 = 0").select(key)
    w = W.partitionBy(key).orderBy("_h", "entrant")
    p = pool.join(size, key, "left_semi").withColumn("_h", order).withColumn("_i", F.row_number().over(w) - 1)
    return p.groupBy(key, F.expr("_i div 2").cast("long").alias("team")).agg(
        F.max(F.when(F.col("_i") % 2 == 0, F.col("entrant"))).alias("first"), F.max(F.when(F.col("_i") % 2 == 1, F.col("entrant"))).alias("second"))


def audit_draws(events: DataFrame) -> DataFrame:
    """Was the recorded pick in the recorded pool; how many results were signed since the draw."""
    d = events.withColumn("d", F.from_json("draw", "pool array<bigint>, entrant bigint, signed bigint, attempt bigint"))
    return d.select("event_id", F.size("d.pool").alias("pool_size"), F.array_contains("d.pool", F.col("d.entrant")).alias("in_pool"), F.col("d.attempt").alias("attempt"),
                    (F.col("signed_now") - F.col("d.signed")).alias("signed_since"), (F.col("signed_now") != F.col("d.signed")).alias("undo_closed"))


def backfill(rows: DataFrame) -> DataFrame:
    """Validate typed results; the first broken rule names the refusal, null means accepted."""
    ok_score = (F.col("score_a").between(0, 99)) & (F.col("score_b").between(0, 99))
    refusal = (F.when(F.col("side_a").isNull() | F.col("side_b").isNull(), "two sides required").when(F.col("side_a") == F.col("side_b"), "two different entrants")
               .when(~ok_score | F.col("score_a").isNull() | F.col("score_b").isNull(), "two scores required")
               .when((F.col("winner") != F.col("side_a")) & (F.col("winner") != F.col("side_b")), "winner must be one of the two sides")
               .when(~F.col("result").isin("played", "forfeit"), "result must be played or forfeit").when(F.col("clip_end") <= F.col("clip_start"), "clip end must be after clip start")
               .when(~F.col("round").between(1, 99), "round out of range"))
    return rows.withColumn("refusal", refusal).withColumn("status", F.when(F.col("refusal").isNull(), "complete"))


class Match(NamedTuple):
    """One match of a night: its place in the evening, never changed in place."""

    status: str = "scheduled"
    score: tuple[int, int] = (0, 0)
    absent: frozenset = frozenset()
    table: int | None = None
    winner: int | None = None


class House(NamedTuple):
    """What the rules of a night depend on beside the match itself."""

    race_to: int
    tables: int
    busy: frozenset

    def table_for(self, asked: int | None) -> int | None:
        return asked or min(set(range(1, self.tables + 1)) - self.busy, default=None)

    def won(self, m: Match) -> bool:
        return m.status == "live" and sorted(m.score)[1] == self.race_to > sorted(m.score)[0]


# Per action: the demands in the order they are answered, and what the match becomes when all hold.
# The refusals are outputs.
DEMANDS: dict[str, list[tuple[Callable, str]]] = {
    "schedule": [(lambda m, e, h: not m.absent, "absent player"), (lambda m, e, h: h.table_for(e["table"]) is not None, "all tables in use"),
                 (lambda m, e, h: h.table_for(e["table"]) not in h.busy, "table occupied")],
    "unschedule": [(lambda m, e, h: m.status == "live", "not on a table")],
    "score": [(lambda m, e, h: m.status == "live", "schedule before scoring"), (lambda m, e, h: 0 <= min(e["a"], e["b"]) and max(e["a"], e["b"]) <= h.race_to, "score out of range"),
              (lambda m, e, h: min(e["a"], e["b"]) < h.race_to, "both cannot win")],
    "absence": [],
    "complete": [(lambda m, e, h: h.won(m), "race-winning score required")],
    "forfeit": [],
}
BECOMES: dict[str, Callable] = {
    "schedule": lambda m, e, h: m._replace(status="live", table=h.table_for(e["table"])),
    "unschedule": lambda m, e, h: m._replace(status="scheduled", table=None),
    "score": lambda m, e, h: m._replace(score=(e["a"], e["b"])),
    "absence": lambda m, e, h: _with_absence(m, m.absent | {e["side"]} if e["flag"] else m.absent - {e["side"]}),
    "complete": lambda m, e, h: m._replace(status="complete", winner=int(m.score[1] > m.score[0]), table=None),
    "forfeit": lambda m, e, h: m._replace(status="complete", winner=1 - e["side"], table=None),
}


def _with_absence(m: Match, absent: frozenset) -> Match:
    return m._replace(absent=absent, status="delayed" if absent else "scheduled", table=None)


def next_match(m: Match, e: dict, house: House) -> tuple[Match, str]:
    """The match after one event, and '' or the first demand that was not met (the match then stays)."""
    if m.status == "complete":
        return m, "not editable"
    if e["action"] not in DEMANDS:
        return m, "unknown action"
    refusal = next((why for holds, why in DEMANDS[e["action"]] if not holds(m, e, house)), "")
    return (m, refusal) if refusal else (BECOMES[e["action"]](m, e, house), "")


REPLAY_FIELDS = ("match", "action", "table", "a", "b", "side", "flag")


def replay(events: DataFrame, key: str = "night", order: Sequence[str] = ("us", "event_id"), race_to: int = 5, tables: int = 4) -> DataFrame:
    """Fold the match events of each tournament in order; refused events keep their reason.

    The state is the matches of one tournament (at most 127), events stream past it.
    """
    import pandas as pd

    def step(state, pdf):
        out = []
        for e in pdf[list(REPLAY_FIELDS)].to_dict("records"):
            busy = frozenset(m.table for k, m in state.items() if k != e["match"] and m.status == "live")
            m, why = next_match(state.get(e["match"], Match()), e, House(race_to, tables, busy))
            state[e["match"]] = m
            out.append((why, m.status, *m.score, m.winner))
        got = pd.DataFrame(out, columns=["refusal", "status", "score_a", "score_b", "winner"]).astype({"winner": "Int64"})
        return pd.concat([pdf[[key, "event_id", "match"]].reset_index(drop=True), got], axis=1)
    cols = list(dict.fromkeys([key, "event_id", *order, *REPLAY_FIELDS]))
    schema = f"{key} long, event_id long, match long, refusal string, status string, score_a long, score_b long, winner long"
    return stream_fold(events.select(*cols), [key], list(order), dict, step, schema)
