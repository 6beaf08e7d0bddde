"""The registered queries: the given tables mapped to the operators' records and results back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, infill, langid, neardup, secrets, simhash, spelling, topk, toxicity, urltree, warc, wordpiece
from .records import shared_folder

# The stated url rules (verdict, host/path).
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
VOCABULARY_FILE = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "text")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    gallery = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.quantised(F.col("embedding")).alias("embedding"))
    found = topk.search(gallery, gallery.filter("id % 20 = 0"), 20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "benchmark").selectExpr("item_id AS id", "text")
    found = decontaminate.find_contamination(_notes(spark, sf_dir), items)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_notes(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_notes(_notes(spark, sf_dir), public_tokenizers.path(VOCABULARY_FILE))
    return encoded.select(
        F.col("id").alias("doc_id"), F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "archives")
    warc.write_archives(_table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def fold(parts: int, chosen: int):
    """True where the checksum of the id as text leaves ``chosen`` modulo ``parts``."""
    return F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) % parts == chosen


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = _notes(spark, sf_dir)
    labels = _table(spark, sf_dir, "labels").selectExpr("doc_id AS id", "toxic")
    model = toxicity.learn(notes, labels.filter(~fold(3, 1)))
    return toxicity.score(notes, model).select(F.col("id").alias("doc_id"), fold(3, 1).alias("held_out"), "score", F.col("toxic").alias("predicted"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = _table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "text", "lang")
    profiles = langid.learn_profiles(notes.filter(~fold(4, 2)))
    return langid.identify(notes, profiles).select(F.col("id").alias("doc_id"), fold(4, 2).alias("held_out"), F.col("lang").alias("lang_pred"), "score")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_tokens(_notes(spark, sf_dir), public_tokenizers.path(VOCABULARY_FILE)).withColumnRenamed("id", "doc_id")


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_notes(spark, sf_dir), keep_text=False)
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in secrets.BASE_KINDS]

    def shown(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def op10_url_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = _table(spark, sf_dir, "pages").selectExpr("page_id AS id", "url")
    return urltree.judge_sources(sources, URL_RULES).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.fingerprint_notes(_notes(spark, sf_dir))
    shown = [F.lower(F.hex(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    return found.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", *shown, "near_edited", "near_next", "class_id", "n_links")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.rearrange_notes(_notes(spark, sf_dir))
    return made.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_notes(spark, sf_dir)).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    "op1_top_k": op1_top_k,
    "op2_decontaminate": op2_decontaminate,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_bpe": op4_bpe,
    "op5_warc": op5_warc,
    "op6_toxicity": op6_toxicity,
    "op7_langid": op7_langid,
    "op8_token_counts": op8_token_counts,
    "op9_secrets": op9_secrets,
    "op10_url_tree": op10_url_tree,
    "op11_simhash": op11_simhash,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_spelling_variants": op13_spelling_variants,
}
LOWER = f"translate(text, '{urltree.UPPER}', '{urltree.LOWER}')"

OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

OP2_SQL = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), []) AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item, coalesce(regexp_extract_all({LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), []) AS w FROM benchmark),
win AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS k
        FROM (SELECT item, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
spot AS (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, (SELECT DISTINCT size FROM win) WHERE len(w) >= size),
hit AS (SELECT r, i, a.size, item FROM (SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS k FROM spot) a JOIN win ON a.size = win.size AND a.k = win.k),
words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words ON doc.r = words.r LEFT JOIN items ON doc.r = items.r"""

OP3_SQL = f"""
WITH RECURSIVE doc AS (SELECT doc_id, list_filter(string_split_regex({LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS id, doc_id AS r FROM doc UNION SELECT link.b, reach.r FROM reach JOIN link ON reach.id = link.a WHERE reach.r < link.b),
least AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN size USING (doc_id) JOIN least ON least.id = doc_id"""

BASE32_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# A SHA-1 is 160 bits, eight groups of 20 bits that are four base-32 letters each.
BASE32 = "||".join(
    f"substr('{BASE32_LETTERS}', CAST(((CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT) >> {s}) & 31) + 1 AS BIGINT), 1)" for g in range(8) for s in (15, 10, 5, 0))

OP5_SQL = f"""
WITH page AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
top AS (SELECT h, max(page_id) AS refers_to FROM page GROUP BY h)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, {BASE32} AS payload_digest,
       CASE WHEN page_id < refers_to THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < refers_to THEN refers_to END AS refers_to
FROM page JOIN top USING (h)"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS p, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS q,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 100 THEN 'plain'
           WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, array_to_string(u[1:least(p, q)], '') AS prefix, array_to_string(u[least(p, q) + 1:greatest(p, q)], '') AS middle, array_to_string(u[greatest(p, q) + 1:n], '') AS suffix FROM e)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c"""


def _url_sql() -> str:
    """The url tree with its default parameters: templates from the host down, then judgements from the host down."""
    tree = urltree.Tree()
    rule = verdict = "NULL"
    for kind, text in sorted(URL_RULES, key=lambda r: (len(r[1]), r[1])):
        at = text.index("/")
        fits = f"(host = '{text[:at]}' OR ends_with(host, '.{text[:at]}')) AND starts_with(path, '{text[at:]}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{kind}' ELSE {verdict} END"
    return f"""
WITH RECURSIVE u AS (SELECT page_id, coalesce(url, '') AS url, position('://' IN coalesce(url, '')) AS sep FROM pages),
p AS (SELECT page_id, CASE WHEN sep > 0 THEN translate(regexp_extract(substr(url, sep + 3), '^([^/?#]*)', 1), '{urltree.UPPER}', '{urltree.LOWER}') ELSE '' END AS host,
      CASE WHEN sep > 0 THEN regexp_extract(substr(url, sep + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
q AS (SELECT *, {rule} AS rule, {verdict} AS rv,
      list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '*' ELSE x END) AS parts FROM p),
g AS (SELECT host, parts, count(*) AS n, count(rv) AS l, count(*) FILTER (WHERE rv = 'block') AS b FROM q GROUP BY ALL),
lev AS (SELECT *, 0 AS d, CAST([] AS VARCHAR[]) AS t FROM g
        UNION ALL
        SELECT host, parts, n, l, b, d + 1, list_append(t, CASE WHEN kinds > {tree.wide} AND links < {tree.thin} * kinds THEN '*' ELSE parts[d + 1] END)
        FROM (SELECT *, count(DISTINCT parts[d + 1]) OVER w AS kinds, sum(n) OVER w AS links FROM lev WHERE len(parts) > d WINDOW w AS (PARTITION BY host, t))),
leaf AS (SELECT * FROM lev WHERE d = len(parts)),
node AS (SELECT host, k, t[1:k] AS t, sum(l) AS l, sum(b) AS b FROM (SELECT host, t, l, b, unnest(range(0, len(t) + 1)) AS k FROM leaf) GROUP BY ALL),
judge AS (SELECT *, l AS jl, b AS jb FROM node WHERE k = 0
          UNION ALL
          SELECT host, k, t, l, b, CASE WHEN differs THEN l ELSE jl END, CASE WHEN differs THEN b ELSE jb END
          FROM (SELECT c.*, a.jl, a.jb, c.l > 0 AND abs(c.b / c.l - a.b / a.l) > {tree.z} * sqrt(a.b / a.l * (1 - a.b / a.l) / c.l) AS differs
                FROM judge a JOIN node c ON c.host = a.host AND c.k = a.k + 1 AND c.t[1:a.k] = a.t))
SELECT page_id, q.host, path, rule, coalesce(rv, CASE WHEN (jb + {tree.weight * tree.prior}) / (jl + {tree.weight}) >= {tree.reject} THEN 'block' ELSE 'allow' END) AS verdict
FROM q JOIN leaf ON leaf.host = q.host AND leaf.parts = q.parts JOIN judge ON judge.host = q.host AND judge.t = leaf.t"""


ORACLE: dict[str, str] = {
    "op1_top_k": OP1_SQL,
    "op2_decontaminate": OP2_SQL,
    "op3_near_duplicates": OP3_SQL,
    "op5_warc": OP5_SQL,
    "op10_url_tree": _url_sql(),
    "op12_fill_in_middle": OP12_SQL,
}
