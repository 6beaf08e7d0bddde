"""Ledger, bracket and audit operators bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..operators import audit as V
from ..operators import kernels as K
from ..operators import ledger as L
from ..sources import board as BD
from .signals import rounded

QUERIES, ORACLE = {}, {}
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "qty", "completed_us"]


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def players(spark, sf):
    return B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))


SIDES = "sd AS (SELECT *, side_a AS me, side_b AS opp, (winner=side_a)::BIGINT AS win FROM matches WHERE result<>'bye' UNION ALL SELECT *, side_b, side_a, (winner=side_b)::BIGINT FROM matches WHERE result<>'bye')"
STAND = SIDES + """,
st AS (SELECT night, me, any_value(s_name) AS name, sum(win)::BIGINT AS won, count(*) AS played, count(*)-sum(win)::BIGINT AS lost FROM sd JOIN supplier ON s_suppkey=me GROUP BY night, me)"""


@query("a18_standings", B.sql(STAND + "\nSELECT night, me AS player, name, won, lost, played, row_number() OVER (PARTITION BY night ORDER BY won DESC, won/played DESC, lower(name)) AS place FROM st", "matches"))
def a18(spark, sf):
    return L.standings(B.matches(spark, sf), players(spark, sf))


@query("a19_player_record", B.sql(SIDES + "\nSELECT me AS player, sum(win)::BIGINT AS wins, count(*)-sum(win)::BIGINT AS losses, count(*) AS played, count(DISTINCT night) AS nights, CASE WHEN count(*)>0 THEN floor(sum(win)/count(*)*100+0.5)::BIGINT::VARCHAR||'%' ELSE '—' END AS pct FROM sd GROUP BY me", "matches"))
def a19(spark, sf):
    r = L.player_record(B.matches(spark, sf))
    return r.withColumn("pct", L.win_percent(F.col("wins"), F.col("played")))


@query("a19_head_to_head", B.sql(SIDES + """
SELECT me AS player, opp AS opponent, coalesce(sum(win) FILTER (WHERE result='played'),0)::BIGINT AS wins, count(*) FILTER (WHERE result='played' AND win=0) AS losses, count(*) FILTER (WHERE result='played') AS played,
 count(*) FILTER (WHERE result='forfeit') AS forfeits, max(completed_us) AS last_us FROM sd GROUP BY me, opp""", "matches"))
def a19h(spark, sf):
    return L.head_to_head(B.matches(spark, sf))


@query("a19_champions", B.sql("""
SELECT night, arg_max(winner,(round,l_orderkey,l_linenumber,l_partkey,qty,completed_us)) AS champion, count(*) FILTER (WHERE result='played') AS played, count(*) FILTER (WHERE result='forfeit') AS forfeits,
 count(*) FILTER (WHERE result='bye') AS byes, max(round) AS rounds FROM matches GROUP BY night""", "matches"))
def a19c(spark, sf):
    return L.champions(B.matches(spark, sf), ORDER)


@query("p24_results_sheet", B.sql("""
, n AS (SELECT m.*, a.s_name AS na, b.s_name AS nb, winner=side_a AS aw FROM matches m JOIN supplier a ON a.s_suppkey=side_a JOIN supplier b ON b.s_suppkey=side_b),
w AS (SELECT *, CASE WHEN aw THEN na ELSE nb END AS wn, CASE WHEN aw THEN nb ELSE na END AS ln FROM n)
SELECT night, round, l_orderkey, l_linenumber, l_partkey, qty, completed_us, row_number() OVER (PARTITION BY night, round ORDER BY l_orderkey, l_linenumber, l_partkey, qty, completed_us) AS pos,
 CASE result WHEN 'bye' THEN wn||': bye' WHEN 'forfeit' THEN wn||' by forfeit over '||ln ELSE wn||' '||greatest(qty,50-qty)||'-'||least(qty,50-qty)||' '||ln END AS line FROM w""".lstrip()[1:], "matches"))
def p24(spark, sf):
    return L.results_sheet(B.matches(spark, sf), players(spark, sf), ORDER)


@query("j21_audit_of", """
WITH ids AS (SELECT 'n'||(l_orderkey//75) AS id FROM lineitem UNION SELECT 'm'||l_orderkey FROM lineitem UNION SELECT 'e'||c_custkey FROM customer),
e AS (SELECT o_orderkey, CASE o_orderkey%4 WHEN 0 THEN 'n'||(o_orderkey%300) WHEN 1 THEN 'm'||(o_orderkey*2) WHEN 2 THEN 'e'||o_custkey ELSE 'x'||o_orderkey END AS id FROM orders)
SELECT o_orderkey, e.id, e.id IN (SELECT id FROM ids) AS belongs FROM e""")
def j21(spark, sf):
    l, c = B.table(spark, sf, "lineitem"), B.table(spark, sf, "customer")
    ids = l.select(F.expr("concat('n', l_orderkey div 75)").alias("id")).unionByName(l.select(F.expr("concat('m', l_orderkey)").alias("id"))).unionByName(c.select(F.expr("concat('e', c_custkey)").alias("id")))
    e = B.table(spark, sf, "orders").select("o_orderkey", F.expr("case o_orderkey % 4 when 0 then concat('n', o_orderkey % 300) when 1 then concat('m', o_orderkey * 2) when 2 then concat('e', o_custkey) else concat('x', o_orderkey) end").alias("id"))
    return L.audit_of(e, ids)


@query("j22_link_sources", """
WITH s AS (SELECT l_orderkey//75 AS night, l_partkey%50 AS vod, min(l_partkey) AS s0, max(l_partkey+l_suppkey) AS e0 FROM lineitem GROUP BY ALL),
k AS (SELECT o_orderkey//75 AS night, o_custkey%50 AS vod, min(CASE WHEN o_orderkey%3>0 THEN o_custkey END) AS s1, min(CASE WHEN o_orderkey%3>0 THEN o_custkey+100 END) AS e1 FROM orders GROUP BY ALL)
SELECT coalesce(s.night,k.night) AS night, coalesce(s.vod,k.vod) AS vod, coalesce(s1,s0) AS start_s, coalesce(e1,e0) AS end_s, CASE WHEN k.night IS NULL THEN 'adopted' ELSE 'link' END AS origin FROM s FULL JOIN k ON s.night=k.night AND s.vod=k.vod""")
def j22(spark, sf):
    s = B.table(spark, sf, "lineitem").select(F.expr("l_orderkey div 75L").alias("night"), (F.col("l_partkey") % 50).alias("vod"), F.col("l_partkey").alias("start_s"), (F.col("l_partkey") + F.col("l_suppkey")).alias("end_s"))
    known = F.col("o_orderkey") % 3 > 0
    k = B.table(spark, sf, "orders").select(F.expr("o_orderkey div 75L").alias("night"), (F.col("o_custkey") % 50).alias("vod"), F.when(known, F.col("o_custkey")).alias("start_s"), F.when(known, F.col("o_custkey") + 100).alias("end_s"))
    return L.link_sources(k, s)


ENT = "en AS (SELECT c_nationkey::BIGINT AS tournament, c_custkey AS entrant, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)-1 AS position FROM customer)"
BR = ENT + """,
nn AS (SELECT tournament, count(*) AS n, ceil(log2(count(*)))::BIGINT AS rounds, (1::BIGINT << ceil(log2(count(*)))::BIGINT) AS size FROM en GROUP BY tournament HAVING count(*)>=2),
bm AS (SELECT tournament, n, size, round, unnest(range(size >> round)) AS slot FROM (SELECT *, unnest(range(1, rounds+1)) AS round FROM nn)),
bk AS (SELECT b.tournament, round, slot, a.entrant AS side_a, c.entrant AS side_b, CASE WHEN round>1 THEN 2*slot END AS parent_a, CASE WHEN round>1 THEN 2*slot+1 END AS parent_b FROM bm b
 LEFT JOIN en a ON a.tournament=b.tournament AND round=1 AND a.position=CASE WHEN slot<size-n THEN slot ELSE size-n+2*(slot-(size-n)) END
 LEFT JOIN en c ON c.tournament=b.tournament AND round=1 AND slot>=size-n AND c.position=size-n+2*(slot-(size-n))+1)"""


def entrants(spark, sf):
    c = B.table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("tournament"), F.col("c_custkey").alias("entrant"))
    return K.ordered_index(c, ["tournament"], [], "entrant", 65536, "position")


@query("b1_build_brackets", "WITH " + BR + "\nSELECT tournament, round, slot, side_a, side_b, parent_a, parent_b FROM bk")
def b1(spark, sf):
    return L.build_brackets(entrants(spark, sf))


PROP = BR + """,
pr AS (SELECT tournament, 1::BIGINT AS round, slot, side_a, side_b, CASE WHEN side_b IS NULL THEN 'complete' WHEN (tournament*31+7+slot)%5<>0 THEN 'complete' WHEN side_a%9=0 OR side_b%9=0 THEN 'delayed' ELSE 'scheduled' END AS status,
  CASE WHEN side_b IS NULL THEN side_a WHEN (tournament*31+7+slot)%5<>0 THEN CASE WHEN (tournament+slot)%2=0 THEN side_a ELSE side_b END END AS winner, CASE WHEN side_b IS NULL THEN 'bye' WHEN (tournament*31+7+slot)%5<>0 THEN 'played' END AS result FROM bk WHERE round=1
 UNION ALL SELECT tournament, round, slot, side_a, side_b, CASE WHEN NOT ready THEN 'pending' WHEN side_a IS NULL OR side_b IS NULL THEN 'complete' WHEN (tournament*31+round*7+slot)%5<>0 THEN 'complete' WHEN side_a%9=0 OR side_b%9=0 THEN 'delayed' ELSE 'scheduled' END,
  CASE WHEN NOT ready THEN NULL WHEN side_a IS NULL OR side_b IS NULL THEN coalesce(side_a,side_b) WHEN (tournament*31+round*7+slot)%5<>0 THEN CASE WHEN (tournament+slot)%2=0 THEN side_a ELSE side_b END END,
  CASE WHEN ready AND (side_a IS NULL OR side_b IS NULL) THEN 'bye' WHEN ready AND (tournament*31+round*7+slot)%5<>0 THEN 'played' END
 FROM (SELECT tournament, max(round)+1 AS round, slot//2 AS slot, max(CASE WHEN slot%2=0 THEN winner END) AS side_a, max(CASE WHEN slot%2=1 THEN winner END) AS side_b, bool_and(status='complete') AS ready FROM pr GROUP BY tournament, slot//2 HAVING count(*)=2))"""


def settled(spark, sf):
    b = L.build_brackets(entrants(spark, sf))
    k = F.col("tournament") * 31 + F.col("round") * 7 + F.col("slot")
    res = b.filter(k % 5 != 0).select("tournament", "round", "slot", ((F.col("tournament") + F.col("slot")) % 2).alias("winner_side"), F.lit("played").alias("result"))
    gone = B.table(spark, sf, "customer").filter("c_custkey % 9 = 0").select(F.col("c_custkey").alias("entrant"))
    return L.propagate(b, res, gone)


@query("b2_propagate", "WITH RECURSIVE " + PROP + "\nSELECT * FROM pr")
def b2(spark, sf):
    return settled(spark, sf)


@query("b2_tournament_status", "WITH RECURSIVE " + PROP + """
SELECT tournament, bool_and(status='complete') AS complete, arg_max(winner, slot) AS champion FROM pr JOIN (SELECT tournament, max(round) AS round FROM pr GROUP BY tournament) USING (tournament, round) GROUP BY tournament""")
def b2s(spark, sf):
    return L.tournament_status(settled(spark, sf))


@query("b3_bye_slots", "WITH RECURSIVE " + PROP + "\nSELECT a.tournament, a.slot, a.slot//2 AS next_slot, a.winner AS holder FROM pr a JOIN pr b ON b.tournament=a.tournament AND b.round=2 AND b.slot=a.slot//2 WHERE a.round=1 AND a.result='bye' AND b.status<>'complete'")
def b3s(spark, sf):
    return L.bye_slots(settled(spark, sf))


POOL = "pl AS (SELECT DISTINCT night, CASE WHEN winner=side_a THEN side_b ELSE side_a END AS entrant FROM matches WHERE round=1 AND result='played')"


@query("b3_revival_pool", B.sql(POOL + "\nSELECT * FROM pl", "matches"))
def b3(spark, sf):
    return L.revival_pool(B.matches(spark, sf))


@query("b3_pairings", B.sql(POOL + """,
o AS (SELECT *, row_number() OVER (PARTITION BY night ORDER BY md5('77:'||entrant), entrant)-1 AS i, count(*) OVER (PARTITION BY night) AS n FROM pl)
SELECT night, i//2 AS team, max(entrant) FILTER (WHERE i%2=0) AS first, max(entrant) FILTER (WHERE i%2=1) AS second FROM o WHERE n>=2 AND n%2=0 GROUP BY ALL""", "matches"))
def b3p(spark, sf):
    return L.pairings(L.revival_pool(B.matches(spark, sf)), 77)


@query("b4_audit_draws", """
SELECT o_orderkey AS event_id, 4::INTEGER AS pool_size, o_orderkey%5<4 AS in_pool, o_orderkey%3+1 AS attempt, (o_custkey%7+o_orderkey%2)-o_custkey%7 AS signed_since, o_orderkey%2<>0 AS undo_closed FROM orders""")
def b4(spark, sf):
    e = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"), F.expr("o_custkey % 7 + o_orderkey % 2").alias("signed_now"), F.expr(
        "concat('{\"pool\":[', o_custkey, ',', o_custkey + 1, ',', o_custkey + 2, ',', o_custkey + 3, '],\"entrant\":', o_custkey + o_orderkey % 5, ',\"signed\":', o_custkey % 7, ',\"attempt\":', o_orderkey % 3 + 1, '}')").alias("draw"))
    return L.audit_draws(e)


@query("b5_replay")
def b5(spark, sf):
    m = B.matches(spark, sf)
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    e = m.select("night", (k * 2500 + F.col("l_partkey")).alias("event_id"), F.col("completed_us").alias("us"), (F.col("l_partkey") % 32).alias("match"),
                 F.element_at(F.array(*[F.lit(v) for v in ("schedule", "score", "score", "complete", "absence", "unschedule", "forfeit")]), (F.col("qty") % 7 + 1).cast("int")).alias("action"),
                 F.lit(0).cast("long").alias("table"), (F.col("side_a") % 6).alias("a"), (F.col("side_b") % 6).alias("b"), (F.col("l_partkey") % 2).alias("side"), (F.col("side_a") % 3 == 0).alias("flag"))
    return L.replay(e)


@query("b6_backfill", B.sql("""
SELECT l_orderkey, l_linenumber, l_partkey, qty, completed_us, CASE WHEN side_a=side_b THEN 'two different entrants' WHEN qty NOT BETWEEN 0 AND 99 OR 50-qty*2 NOT BETWEEN 0 AND 99 THEN 'two scores required'
 WHEN l_partkey%13=0 THEN 'winner must be one of the two sides' WHEN result NOT IN ('played','forfeit') THEN 'result must be played or forfeit' WHEN l_partkey%17<=l_orderkey%5 THEN 'clip end must be after clip start' END AS refusal FROM matches""", "matches"))
def b6(spark, sf):
    m = B.matches(spark, sf)
    rows = m.withColumn("score_a", F.col("qty")).withColumn("score_b", F.lit(50) - F.col("qty") * 2).withColumn("winner", F.when(F.col("l_partkey") % 13 == 0, -1).otherwise(F.col("winner"))).withColumn(
        "clip_start", F.col("l_orderkey") % 5).withColumn("clip_end", F.col("l_partkey") % 17)
    return L.backfill(rows).select(*ORDER, "refusal")


@query("v1_check_domains", """
SELECT o_orderkey AS key, rule FROM (SELECT o_orderkey, unnest([CASE WHEN NOT o_orderstatus IN ('O','F') THEN 'status_domain' END, CASE WHEN NOT o_totalprice BETWEEN 1000 AND 450000 THEN 'price_range' END, CASE WHEN NOT length(o_orderpriority)<=8 THEN 'priority_length' END,
 CASE WHEN NOT regexp_full_match(o_orderpriority,'[0-9]-[A-Z]+') THEN 'priority_format' END]) AS rule FROM orders) WHERE rule IS NOT NULL""")
def v1(spark, sf):
    return V.check_domains(B.table(spark, sf, "orders"), "o_orderkey", {
        "status_domain": F.col("o_orderstatus").isin("O", "F"), "price_range": F.col("o_totalprice").between(1000, 450000),
        "priority_length": F.length("o_orderpriority") <= 8, "priority_format": F.col("o_orderpriority").rlike("^[0-9]-[A-Z]+$")})


@query("v2_check_unique", """
SELECT 'one_live_match_per_table' AS rule, (l_orderkey//75)||'|'||(l_partkey%40) AS key, count(*) AS n FROM lineitem WHERE l_linestatus='O' GROUP BY l_orderkey//75, l_partkey%40 HAVING count(*)>1
UNION ALL SELECT 'name_key', lower(trim(p_name)), count(*) FROM part GROUP BY lower(trim(p_name)) HAVING count(*)>1""")
def v2(spark, sf):
    l = B.table(spark, sf, "lineitem").select(F.expr("l_orderkey div 75L").alias("night"), (F.col("l_partkey") % 40).alias("table"), "l_linestatus")
    p = B.table(spark, sf, "part").select(F.lower(F.trim("p_name")).alias("k"))
    return V.check_unique(l, "one_live_match_per_table", ["night", "table"], F.col("l_linestatus") == "O").unionByName(V.check_unique(p, "name_key", ["k"]))


@query("v3_check_references", B.sql("""
SELECT 'line_order' AS rule, l_orderkey AS key FROM lineitem WHERE l_orderkey+1 NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'order_customer', o_orderkey FROM orders WHERE o_custkey*2 NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'both_sides', l_orderkey FROM matches WHERE side_a=side_b""", "matches"))
def v3(spark, sf):
    o, l, c = (B.table(spark, sf, t) for t in ("orders", "lineitem", "customer"))
    a = V.check_references(l.withColumn("ref", F.col("l_orderkey") + 1), o, "ref", "o_orderkey", "line_order", "l_orderkey")
    b = V.check_references(o.withColumn("ref", F.col("o_custkey") * 2), c, "ref", "c_custkey", "order_customer", "o_orderkey")
    same = B.matches(spark, sf).filter("side_a = side_b").select(F.lit("both_sides").alias("rule"), F.col("l_orderkey").alias("key"))
    return a.unionByName(b).unionByName(same)


@query("a30_fingerprint", " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", count(*) AS rows, sum(('0x'||substr(md5(concat_ws('|',{','.join(f"coalesce({c}::VARCHAR,'~')" for c in cols)})),1,8))::BIGINT)::BIGINT AS digest FROM {t}"""
    for t, cols in {"nation": ["n_nationkey", "n_name", "n_regionkey"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
                    "conversations": ["conv_id", "turn", "role", "text"]}.items()))
def a30(spark, sf):
    return V.fingerprint({t: B.table(spark, sf, t) for t in ("nation", "orders", "customer", "conversations")})


@query("i3_table_diff", """
WITH a AS (SELECT o_custkey, o_orderstatus FROM orders), b AS (SELECT CASE WHEN o_orderkey%50=0 THEN o_custkey+1 ELSE o_custkey END AS o_custkey, o_orderstatus FROM orders),
u AS (SELECT *, 1 AS x, 0 AS y FROM a UNION ALL SELECT *, 0, 1 FROM b)
SELECT o_custkey, o_orderstatus, sum(x)::BIGINT AS in_a, sum(y)::BIGINT AS in_b, CASE WHEN sum(x)>sum(y) THEN 'a' ELSE 'b' END AS only_in FROM u GROUP BY ALL HAVING sum(x)<>sum(y)""")
def i3(spark, sf):
    o = B.table(spark, sf, "orders")
    b = o.select(F.when(F.col("o_orderkey") % 50 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("o_custkey"), "o_orderstatus")
    return V.table_diff(o.select("o_custkey", "o_orderstatus"), b)


@query("i4_first_difference", """
SELECT o_orderkey AS id, CASE o_orderkey%6 WHEN 1 THEN '$.a.flag' WHEN 2 THEN '$.list' WHEN 3 THEN '$.list[000001]' WHEN 4 THEN '$.extra' WHEN 5 THEN '$.a.key' END AS path,
 CASE o_orderkey%6 WHEN 1 THEN 'type' WHEN 2 THEN 'length' WHEN 3 THEN 'value' WHEN 4 THEN 'missing in a' WHEN 5 THEN 'missing in b' END AS why, CASE o_orderkey%6 WHEN 2 THEN 2 ELSE 1 END::BIGINT AS differences FROM orders WHERE o_orderkey%6>0""")
def i4(spark, sf):
    o = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    a = o.select("id", F.expr("concat('{\"a\":{\"flag\":true,\"key\":', id, '},\"list\":[1,', o_custkey, ']}')").alias("doc"))
    b = o.select("id", F.expr("""concat('{"a":{"flag":', if(id % 6 = 1, '1', 'true'), if(id % 6 = 5, '', concat(',"key":', id, '.0')), '},"list":[1,', o_custkey + if(id % 6 = 3, 1, 0), if(id % 6 = 2, ',3', ''), ']', if(id % 6 = 4, ',"extra":null', ''), '}')""").alias("doc"))
    return V.first_difference(a, b)


@query("t4_timeline", B.sql("""
, n AS (SELECT night, CASE WHEN night%10>0 THEN max(completed_us) END AS at_us FROM matches GROUP BY night)
SELECT night, 'night' AS kind, at_us FROM n WHERE night%7<>3 UNION ALL SELECT conv_id, 'recording', CASE WHEN conv_id%4>0 THEN 1000000*max(turn) END FROM conversations GROUP BY conv_id""".lstrip()[1:], "matches"))
def t4(spark, sf):
    from ..operators.selection import timeline
    n = B.matches(spark, sf).groupBy("night").agg(F.max("completed_us").alias("at_us")).withColumn("at_us", F.when(F.col("night") % 10 > 0, F.col("at_us"))).withColumn("hidden", F.col("night") % 7 == 3)
    v = B.table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("night")).agg((F.max("turn") * 1000000).alias("at_us")).withColumn("at_us", F.when(F.col("night") % 4 > 0, F.col("at_us")))
    return timeline(n, v)


@query("t5_play_queue", B.sql("""
, s AS (SELECT *, CASE qty%5 WHEN 0 THEN 'live' WHEN 1 THEN 'scheduled' WHEN 2 THEN 'delayed' ELSE 'complete' END AS status FROM matches)
SELECT night, l_orderkey, l_linenumber, l_partkey, qty, completed_us, row_number() OVER (PARTITION BY night ORDER BY status='delayed', round, l_orderkey, l_linenumber, l_partkey, qty, completed_us) AS place FROM s WHERE status IN ('scheduled','delayed')""".lstrip()[1:], "matches"))
def t5(spark, sf):
    from ..operators.selection import play_queue
    s = F.expr("case qty % 5 when 0 then 'live' when 1 then 'scheduled' when 2 then 'delayed' else 'complete' end")
    return play_queue(B.matches(spark, sf).withColumn("status", s), ORDER).select("night", *ORDER, "place")


@query("s12_board", B.sql(STAND + """,
pl AS (SELECT *, row_number() OVER (PARTITION BY night ORDER BY won DESC, won/played DESC, lower(name)) AS place FROM st)
SELECT m.night, count(*) FILTER (WHERE qty%5 IN (1,2)) AS queued, count(DISTINCT round) AS rounds, (SELECT name FROM pl WHERE pl.night=m.night AND place=1) AS leader, (SELECT won FROM pl WHERE pl.night=m.night AND place=1) AS leader_won, true AS stable FROM matches m GROUP BY m.night""", "matches"))
def s12(spark, sf):
    m = B.matches(spark, sf)
    s = F.expr("case qty % 5 when 0 then 'live' when 1 then 'scheduled' when 2 then 'delayed' else 'complete' end")
    b = BD.board(m.withColumn("status", s).withColumn("slot", F.col("l_orderkey") * 8 + F.col("l_linenumber")), L.standings(m, players(spark, sf)))
    one, two = BD.encode(b, F.lit("2026-01-01T00:00:00Z")), BD.encode(b, F.lit("2026-01-01T00:00:09Z")).select("night", F.col("digest").alias("d2"), F.col("body").alias("b2"))
    j = one.join(two, "night")
    return j.select("night", F.size("board.next").cast("long").alias("queued"), F.size("board.bracket").cast("long").alias("rounds"), F.col("board.standings")[0]["name"].alias("leader"),
                    F.col("board.standings")[0]["won"].alias("leader_won"), ((F.col("digest") == F.col("d2")) & (F.col("body") != F.col("b2"))).alias("stable"))
