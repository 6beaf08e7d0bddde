"""Document, store and source operators bound to the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import bindings as B
from ..sources import documents as D
from ..sources import operations_store as O
from ..session import checkpoint_dir, cut_lineage
from ..sources import sets as S
from ..sources import stamped as T

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


@query("s1_read_frames", B.sql("""
SELECT event_id AS frame, t, color, x::DOUBLE AS cx, y::DOUBLE AS cy FROM detections""", "detections"))
def s1(spark, sf):
    d = B.detections(spark, sf).select("event_id", F.struct(
        "t", F.col("event_id").alias("frame"), F.lit(1).alias("n"), F.array(F.struct("color", F.col("x").alias("cx"), F.col("y").alias("cy"), F.lit(8.0).alias("r"))).alias("cands")).alias("rec"))
    docs = d.select(F.when(F.col("event_id") % 2 == 0, F.to_json(F.array("rec"))).otherwise(F.to_json(F.struct(F.array("rec").alias("records")))).alias("doc"))
    f = D.parse_frames(docs, "doc")
    return D.detections_of(f, ["frame"]).select("frame", "t", "color", "cx", "cy")


@query("s2_read_time_map", B.sql("""
, e AS (SELECT dataset, frame_no, event_id, color, score, x::DOUBLE AS x, CASE WHEN event_id%3=0 THEN 0 ELSE 1 END AS file_no, round_even(t*10,0)::BIGINT AS tick, t FROM detections),
k AS (SELECT dataset, frame_no, tick, arg_min(event_id,(file_no,t::VARCHAR)) AS event_id FROM e GROUP BY ALL)
SELECT k.dataset, k.frame_no, k.tick, e.file_no, e.color, e.x, e.score FROM k JOIN e USING (event_id)""".lstrip()[1:], "detections"))
def s2(spark, sf):
    d = B.detections(spark, sf).withColumn("file_no", F.when(F.col("event_id") % 3 == 0, 0).otherwise(1))
    ball = F.array(F.struct("color", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "score"))
    docs = d.select("dataset", "frame_no", "file_no", F.to_json(F.map_from_arrays(F.array(F.col("t").cast("string")), F.array(ball))).alias("doc"))
    return D.read_time_map(docs, "doc", ["dataset", "frame_no"], "file_no").select("dataset", "frame_no", "tick", "file_no", "color", "x", "score")


def stamped(spark, sf):
    e = F.expr
    return B.table(spark, sf, "events").select(
        (F.col("user_id") * 7 + F.col("event_id") % 29).alias("doc"), "event_id", e("if(event_id % 41 > 0, value, null)").alias("t"), F.col("event_type").alias("type"),
        e("case when user_id % 5 = 0 then null when event_id % 97 = 0 then named_struct('version', 9L, 'producer', 'scan') when user_id % 5 = 1 and event_id % 29 = 3 then named_struct('version', 1L, 'producer', 'probe') "
          "else named_struct('version', 1L, 'producer', if(user_id % 2 = 0, 'scan', 'probe')) end").alias("stamp"))


STAMPS = """st AS (SELECT user_id*7+event_id%29 AS doc, event_id, CASE WHEN event_id%41>0 THEN value END AS t, CASE WHEN user_id%5=0 THEN NULL WHEN event_id%97=0 THEN 9 ELSE 1 END AS ver,
 CASE WHEN user_id%5=0 THEN NULL WHEN event_id%97=0 THEN 'scan' WHEN user_id%5=1 AND event_id%29=3 THEN 'probe' WHEN user_id%2=0 THEN 'scan' ELSE 'probe' END AS prod FROM events)"""


@query("s3_stamp_rows", "WITH " + STAMPS + """
SELECT event_id, CASE WHEN t IS NULL THEN 'missing time or type' WHEN prod<>'scan' THEN 'stamped by another producer' WHEN ver>1 THEN 'newer version' END AS refusal,
 CASE WHEN t IS NULL OR coalesce(prod<>'scan',false) OR coalesce(ver>1,false) THEN prod ELSE 'scan' END AS producer FROM st""")
def s3(spark, sf):
    return D.stamp(stamped(spark, sf), "scan").select("event_id", "refusal", F.col("stamp.producer").alias("producer"))


@query("s3_document_status", "WITH " + STAMPS + """,
k AS (SELECT *, CASE WHEN prod IS NULL THEN 'U' WHEN ver=1 THEN 'N' ELSE 'F' END AS k FROM st)
SELECT doc, count(*) AS rows, count(*) FILTER (WHERE k='U') AS unstamped, count(*) FILTER (WHERE k='F') AS "foreign", CASE WHEN count(DISTINCT prod) FILTER (WHERE k='N')=1 AND count(*) FILTER (WHERE k<>'N')=0 THEN 'STAMPED'
 WHEN count(*) FILTER (WHERE k<>'U')=0 THEN 'UNSTAMPED' ELSE 'MIXED' END AS status, CASE WHEN count(DISTINCT prod) FILTER (WHERE k='N')=1 AND count(*) FILTER (WHERE k<>'N')=0 THEN min(prod) END AS producer FROM k GROUP BY doc""")
def s3d(spark, sf):
    return D.document_status(stamped(spark, sf), "doc", ["scan", "probe"])


@query("s3_write_read", "WITH " + STAMPS + """
SELECT doc::VARCHAR AS doc, row_number() OVER (PARTITION BY doc ORDER BY event_id)-1 AS "position", event_id, t, 1::BIGINT AS version, 'scan' AS producer FROM st WHERE t IS NOT NULL AND coalesce(prod='scan',true) AND coalesce(ver<=1,true)""")
def s3w(spark, sf):
    path = f"{checkpoint_dir(spark).rstrip('/')}/stamped-{uuid.uuid4().hex}"
    T.write_documents(D.stamp(stamped(spark, sf), "scan").filter("refusal is null").drop("refusal"), path, "scan", ["event_id"])
    back = T.numbered(T.read_documents(spark, path, ["scan", "probe"]).filter("refusal is null"))
    return back.select("doc", "position", F.get_json_object("body", "$.event_id").cast("long").alias("event_id"), "t", F.col("stamp.version").alias("version"), F.col("stamp.producer").alias("producer"))


def operations_docs(spark, sf):
    """One operations document per order, its lines as matches."""
    o, l = B.table(spark, sf, "orders"), B.table(spark, sf, "lineitem")
    s = lambda c: F.col(c).cast("string")
    m = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(
        F.concat(s("l_linenumber"), F.lit("-"), s("l_partkey"), F.lit("-"), s("l_extendedprice")).alias("id"), F.col("l_linenumber").cast("long").alias("round"), F.array(s("l_partkey"), s("l_suppkey")).alias("sides"),
        F.array(F.col("l_quantity").cast("long"), F.lit(3).cast("long")).alias("score"), s("l_suppkey").alias("winnerId"), F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("flag")))).alias("matches"))
    d = o.join(m, o.o_orderkey == m.l_orderkey, "left")
    players = F.array(F.struct(s("o_custkey").alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("status"), F.lit("left").alias("hand")))
    entrants = F.array(F.struct(F.concat(F.lit("e"), s("o_custkey")).alias("id"), (F.col("o_orderkey") % 3 == 0).alias("absent"), F.array(F.struct(s("o_custkey").alias("pid"), F.lit("x").alias("name"))).alias("members")))
    body = F.struct(F.col("o_orderkey").alias("revision"), players.alias("players"), F.struct(
        F.concat(F.lit("t"), s("o_orderkey")).alias("id"), F.lit("night").alias("name"), F.lit("singles").alias("format"), F.lit("active").alias("status"), entrants.alias("entrants"), F.col("matches")).alias("tournament"),
        F.array(F.struct(F.concat(F.lit("v"), s("o_orderkey")).alias("id"), F.lit("https://x").alias("url"))).alias("sources"),
        F.array(F.struct(F.concat(F.lit("a"), s("o_orderkey")).alias("id"), F.lit("start").alias("action"), F.col("o_orderkey").alias("revision"))).alias("events"))
    return d.select(F.col("o_orderkey").alias("doc_id"), F.to_json(body).alias("doc"))


@query("s4_shred_operations", """
WITH m AS (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber||'-'||l_partkey||'-'||l_extendedprice) - 1 AS p FROM lineitem l JOIN orders ON o_orderkey=l_orderkey)
SELECT 'matches' AS "table", l_orderkey AS doc_id, p::INTEGER AS position, l_linenumber||'-'||l_partkey||'-'||l_extendedprice AS id, l_suppkey::VARCHAR AS value, l_returnflag AS extra FROM m
UNION ALL SELECT 'players', o_orderkey, 0, o_custkey::VARCHAR, o_orderstatus, 'left' FROM orders UNION ALL SELECT 'entrants', o_orderkey, 0, 'e'||o_custkey, CASE WHEN o_orderkey%3=0 THEN 'true' ELSE 'false' END, NULL FROM orders
UNION ALL SELECT 'members', o_orderkey, 0, o_custkey::VARCHAR, 'x', NULL FROM orders UNION ALL SELECT 'tournaments', o_orderkey, 0, 't'||o_orderkey, 'active', NULL FROM orders UNION ALL SELECT 'sources', o_orderkey, 0, 'v'||o_orderkey, 'https://x', NULL FROM orders
UNION ALL SELECT 'events', o_orderkey, 0, 'a'||o_orderkey, o_orderkey::VARCHAR, NULL FROM orders""")
def s4(spark, sf):
    t = O.shred_operations(cut_lineage(operations_docs(spark, sf)))
    def view(name, ident, value, extra=None, pos="position"):
        x = F.col("extra")[extra] if extra else F.lit(None).cast("string")
        return t[name].select(F.lit(name).alias("table"), "doc_id", F.col(pos).cast("int").alias("position"), F.col(ident).alias("id"), F.col(value).cast("string").alias("value"), x.alias("extra"))
    out = view("matches", "id", "winnerId", "flag")
    for v in (view("players", "id", "status", "hand"), view("entrants", "id", "absent"), view("members", "pid", "name"), view("tournaments", "id", "status", pos="slot"), view("sources", "id", "url"), view("events", "id", "revision")):
        out = out.unionByName(v)
    return out


@query("s5_render_operations", """
WITH m AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL)
SELECT o_orderkey AS doc_id, 1::INTEGER AS players, coalesce(n,0)::INTEGER AS matches, q AS score_sum, o_custkey::VARCHAR AS member, true AS ordered FROM orders LEFT JOIN m ON l_orderkey=o_orderkey""")
def s5(spark, sf):
    # kept by document: no table shredded from a document moves again to be packed and joined
    r = O.render_operations(O.shred_operations(cut_lineage(operations_docs(spark, sf), "doc_id")))
    t = F.col("tournaments")[0]
    m = F.coalesce(t["matches"], F.expr("array()"))
    ids = F.transform(t["matches"], lambda x: x["id"])
    return r.select("doc_id", F.size("players").alias("players"), F.when(t["matches"].isNull(), 0).otherwise(F.size(t["matches"])).alias("matches"),
                    F.aggregate(t["matches"], F.lit(0).cast("long"), lambda s, x: s + x["score"][0]).alias("score_sum"), t["entrants"][0]["members"][0]["pid"].alias("member"),
                    F.coalesce(ids == F.array_sort(ids), F.lit(True)).alias("ordered"))


@query("s6_shred_label_set", """
SELECT source AS doc, 'crops/'||doc_id AS name, CASE WHEN doc_id%7=0 THEN 'u' ELSE (doc_id%16)::VARCHAR END AS label, CASE WHEN doc_id%7>0 THEN (doc_id%16)::INTEGER END AS value FROM documents""")
def s6(spark, sf):
    d = B.table(spark, sf, "documents")
    rows = d.select(F.col("source").alias("doc"), "doc_id", F.concat(F.lit("crops/"), F.col("doc_id")).alias("name"), F.when(F.col("doc_id") % 7 == 0, "u").otherwise((F.col("doc_id") % 16).cast("string")).alias("value"))
    keyed = rows.withColumn("key", F.concat_ws("#", "doc", F.expr("string(doc_id div 64)")))
    back = S.shred_map(S.render_map(keyed, "key"), "key", "doc", "string")
    text, number = S.label_pair(F.col("value"))
    return back.select(F.substring_index("key", "#", 1).alias("doc"), "name", text.alias("label"), number.alias("value"))


@query("s6_shred_bank", B.sql("SELECT vec_id//8 AS cluster, (vec_id%8)::INTEGER AS position, round(vec[1],6) AS first, round(vec[64],6) AS last, round(list_dot_product(vec, list_transform(range(1,65), lambda i: i::DOUBLE)),6) AS weighted_sum FROM faces", "faces"))
def s6b(spark, sf):
    f = B.faces(spark, sf).select(F.expr("vec_id div 8").alias("cluster"), (F.col("vec_id") % 8).cast("int").alias("position"), "vec")
    r = S.shred_bank(S.render_bank(f, "cluster"), "cluster", "flat", 64)
    return r.select("cluster", "position", F.round(F.col("vec")[0], 6).alias("first"), F.round(F.col("vec")[63], 6).alias("last"),
                    F.round(F.aggregate(F.transform("vec", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 6).alias("weighted_sum"))


@query("s7_load_set", """
SELECT 'same' AS "set", count(*) AS new_rows, count(*) AS stored_rows, 'unchanged' AS status, count(*) AS kept FROM orders UNION ALL SELECT 'fresh', count(*), 0, 'imported', count(*) FROM orders
UNION ALL SELECT 'other', count(*), count(*), 'refused', count(*) FROM orders UNION ALL SELECT 'forced', count(*), count(*), 'imported', count(*) FROM orders UNION ALL SELECT 'gone', 0, count(*), 'absent', count(*) FROM orders""")
def s7(spark, sf):
    o = B.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    moved, none = o.withColumn("o_custkey", F.col("o_custkey") + (F.col("o_orderkey") % 50 == 0).cast("int")), o.filter("o_orderkey < 0")
    out = None
    for name, new, stored, rep in (("same", o, o, False), ("fresh", o, none, False), ("other", moved, o, False), ("forced", moved, o, True), ("gone", none, o, False)):
        report, keep = S.load_set(new, stored, rep, name)
        row = report.crossJoin(keep.agg(F.count(F.lit(1)).alias("kept")))
        out = row if out is None else out.unionByName(row)
    return out


@query("s8_merge_label_sets", """
SELECT 'v1_'||doc_id||'.png' AS file, n_chars AS t, CASE WHEN quality=1 THEN quality+doc_id%3 END::INTEGER AS label, CASE WHEN doc_id%4=0 THEN 'v1_c'||doc_id||'.png' END AS ctx FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT 'v2_'||page_id||'.png', length(url), (page_id%5)::INTEGER, NULL FROM pages""")
def s8(spark, sf):
    d, l, p = (B.table(spark, sf, t) for t in ("documents", "labels", "pages"))
    name = F.concat(F.lit("a/b/"), F.col("doc_id"), F.lit(".png"))
    one = ("v1", d.select(name.alias("file"), F.col("n_chars").alias("t"), F.lit(0.5).alias("score")), l.select(name.alias("file"), F.when(F.col("quality") == 1, (F.col("quality") + F.col("doc_id") % 3).cast("string")).otherwise("u").alias("label")),
           d.filter("doc_id % 4 = 0").select(name.alias("file"), F.concat(F.lit("ctx/c"), F.col("doc_id"), F.lit(".png")).alias("ctx")))
    pn = F.concat(F.lit("z/"), F.col("page_id"), F.lit(".png"))
    two = ("v2", p.select(pn.alias("file"), F.length("url").cast("long").alias("t"), F.lit(0.5).alias("score")), p.select(pn.alias("file"), (F.col("page_id") % 5).cast("string").alias("label")), p.filter("page_id < 0").select(pn.alias("file"), F.lit("").alias("ctx")))
    return S.merge_label_sets([one, two]).drop("score")


@query("j16_upsert_by_basename", """
WITH s AS (SELECT doc_id, source||'/'||(doc_id%300)||'.jpg' AS key, (doc_id%300)||'.jpg' AS file, lang AS label FROM documents), f AS (SELECT file, arg_min(key, doc_id) AS first FROM s GROUP BY file),
i AS (SELECT DISTINCT (item_id*11)||'.jpg' AS file, 'new'||item_id AS nl FROM benchmark)
SELECT coalesce(key, i.file) AS key, coalesce(nl, label) AS label FROM (SELECT s.*, f.first FROM s JOIN f USING (file)) s FULL JOIN i ON i.file=s.file WHERE nl IS NULL OR key IS NULL OR key=first""")
def j16(spark, sf):
    d = B.table(spark, sf, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id") % 300, F.lit(".jpg")).alias("key"), F.col("lang").alias("label"), F.col("doc_id").alias("position"))
    i = B.table(spark, sf, "benchmark").select(F.concat(F.col("item_id") * 11, F.lit(".jpg")).alias("file"), F.concat(F.lit("new"), F.col("item_id")).alias("new_label"))
    return S.upsert_by_basename(d, i)


@query("j16_merge_records", """
SELECT coalesce(d.doc_id, p.page_id) AS id, coalesce(CASE WHEN p.page_id%2=0 THEN p.url END, d.lang) AS a, coalesce(CASE WHEN p.page_id%3=0 THEN 'b'||p.page_id END, d.source) AS b FROM documents d FULL JOIN pages p ON p.page_id=d.doc_id""")
def j16m(spark, sf):
    d = B.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("a"), F.col("source").alias("b"))
    p = B.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 2 == 0, F.col("url")).alias("a"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("b"), "page_id")).alias("b"))
    return S.merge_records(d, p, "id", ["a", "b"])


@query("s9_trim_log", """
SELECT o_custkey%5 AS log, o_orderkey, age FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey%5 ORDER BY o_orderdate DESC, o_orderkey DESC)::INTEGER AS age FROM orders) WHERE age<=500""")
def s9(spark, sf):
    o = B.table(spark, sf, "orders").select((F.col("o_custkey") % 5).alias("log"), "o_orderkey", "o_orderdate")
    return S.trim_log(o, ["log"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("log", "o_orderkey", "age")


@query("s10_dataset_dim", """
WITH i AS (SELECT o_orderkey, CASE o_orderkey%5 WHEN 0 THEN 'tw-'||o_custkey WHEN 1 THEN 'tw-0'||o_custkey WHEN 2 THEN 'tw-'||o_custkey||'-'||(o_orderkey%9000)||'-'||(o_orderkey%9000+o_orderkey%7*100) WHEN 3 THEN 'vod'||o_custkey ELSE 'tw-'||o_custkey||'-5' END AS dataset_id, o_custkey, o_orderkey%9000 AS s, o_orderkey%9000+o_orderkey%7*100 AS e FROM orders),
p AS (SELECT *, o_custkey>0 AND (o_orderkey%5=0 OR (o_orderkey%5=2 AND e>s)) AS ok FROM i)
SELECT o_orderkey, dataset_id, CASE WHEN ok THEN o_custkey::VARCHAR END AS vod, CASE WHEN ok AND o_orderkey%5=2 THEN s END AS start_s, CASE WHEN ok AND o_orderkey%5=2 THEN e END AS end_s,
 CASE WHEN ok AND o_orderkey%5=2 THEN printf('%d:%02d:%02d',s//3600,s%3600//60,s%60)||'-'||printf('%d:%02d:%02d',e//3600,e%3600//60,e%60) END AS label, c_name AS title FROM p LEFT JOIN customer ON ok AND c_custkey=o_custkey""")
def s10(spark, sf):
    i = B.table(spark, sf, "orders").select("o_orderkey", F.expr("""case o_orderkey % 5 when 0 then concat('tw-', o_custkey) when 1 then concat('tw-0', o_custkey)
        when 2 then concat('tw-', o_custkey, '-', o_orderkey % 9000, '-', o_orderkey % 9000 + o_orderkey % 7 * 100) when 3 then concat('vod', o_custkey) else concat('tw-', o_custkey, '-5') end""").alias("dataset_id"))
    k = B.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("vod"), F.col("c_name").alias("title"))
    return D.dataset_dim(i, k)


@query("s11_canonical_source", """
WITH u AS (SELECT page_id, CASE page_id%6 WHEN 0 THEN url WHEN 1 THEN 'https://www.twitch.tv/Chan_'||page_id||'//' WHEN 2 THEN 'https://twitch.tv/videos/'||page_id WHEN 3 THEN ' https://twitch.tv/Settings ' WHEN 4 THEN 'https://WWW.twitch.tv/c'||page_id ELSE 'https://twitch.tv/c'||page_id||'?t=1' END AS url FROM pages)
SELECT page_id, CASE page_id%6 WHEN 1 THEN 'https://www.twitch.tv/chan_'||page_id WHEN 2 THEN 'https://www.twitch.tv/videos/'||page_id END AS canonical, CASE page_id%6 WHEN 1 THEN 'channel' WHEN 2 THEN 'video' END AS kind,
 CASE page_id%6 WHEN 1 THEN 'chan_'||page_id WHEN 2 THEN page_id::VARCHAR END AS subject FROM u""")
def s11(spark, sf):
    u = B.table(spark, sf, "pages").withColumn("u", F.expr("""case page_id % 6 when 0 then url when 1 then concat('https://www.twitch.tv/Chan_', page_id, '//') when 2 then concat('https://twitch.tv/videos/', page_id)
        when 3 then ' https://twitch.tv/Settings ' when 4 then concat('https://WWW.twitch.tv/c', page_id) else concat('https://twitch.tv/c', page_id, '?t=1') end""")).withColumn("s", D.canonical_source(F.col("u")))
    return u.select("page_id", F.col("s.url").alias("canonical"), "s.kind", "s.subject")
