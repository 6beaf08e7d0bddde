"""The operations document as normalised tables, and back.

Known keys become columns, list order becomes ``position``, everything else stays in
``extra`` as JSON, so rendering restores the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.kernels import shuffled

ITEM = "map<string,string>"
DOC = f"revision long, players array<{ITEM}>, tournament {ITEM}, history array<{ITEM}>, notes array<{ITEM}>, sources array<{ITEM}>, links array<{ITEM}>, events array<{ITEM}>"
# The columns of each table, with their JSON type; the rest of an item is extra.
TABLES = {
    "players": {"id": "string", "name": "string", "status": "string"},
    "tournaments": {"id": "string", "name": "string", "format": "string", "status": "string"},
    "entrants": {"id": "string", "absent": "boolean"},
    "members": {"pid": "string", "name": "string"},
    "matches": {"id": "string", "round": "long", "sides": "array<string>", "score": "array<long>", "winnerId": "string", "status": "string"},
    "notes": {"id": "string", "text": "string"},
    "sources": {"id": "string", "url": "string"},
    "links": {"night": "string", "vod": "string"},
    "events": {"id": "string", "action": "string", "revision": "long"},
}
SHORT = ("players", "notes", "sources", "links", "events")
NESTED = {"tournaments": ("entrants", "matches"), "entrants": ("members",)}


def _typed(m: Column, name: str, kind: str) -> Column:
    raw = m[name]
    if kind == "string":
        return raw.alias(name)
    if kind.startswith("array"):
        return F.from_json(raw, kind).alias(name)
    return raw.try_cast(kind).alias(name)


def _columns(table: str, m: Column) -> list[Column]:
    known = [*TABLES[table], *NESTED.get(table, ())]
    left = F.map_filter(m, lambda k, v: ~k.isin(*known))
    return [_typed(m, n, k) for n, k in TABLES[table].items()] + [F.when(F.size(left) > 0, left).alias("extra")]


def _list(df: DataFrame, keys: list[str], items: Column) -> DataFrame:
    return df.select(*keys, F.posexplode_outer(items).alias("position", "_i")).filter("_i is not null")


def shred_operations(docs: DataFrame, key: str = "doc_id", doc: str = "doc") -> dict[str, DataFrame]:
    """The nine tables of every document, keyed by document."""
    d = docs.select(key, F.from_json(doc, DOC).alias("d"))
    out: dict[str, DataFrame] = {}
    for t in SHORT:
        rows = _list(d, [key], F.col(f"d.{t}"))
        out[t] = rows.select(key, "position", *_columns(t, F.col("_i")))
    # the current night has slot 0, past ones follow; one list, so that rows stay where their document is
    nights = F.concat(F.array("d.tournament"), F.coalesce("d.history", F.array().cast(f"array<{ITEM}>")))
    night = _list(d, [key], nights).withColumn("slot", F.col("position"))
    out["tournaments"] = night.select(key, "slot", *_columns("tournaments", F.col("_i")))
    ent = _list(night.drop("position"), [key, "slot"], F.from_json(F.col("_i")["entrants"], f"array<{ITEM}>"))
    out["entrants"] = ent.select(key, "slot", "position", *_columns("entrants", F.col("_i")))
    seat = ent.withColumn("seat", F.col("position")).drop("position")
    mem = _list(seat, [key, "slot", "seat"], F.from_json(F.col("_i")["members"], f"array<{ITEM}>"))
    out["members"] = mem.select(key, "slot", "seat", "position", *_columns("members", F.col("_i")))
    mat = _list(night.drop("position"), [key, "slot"], F.from_json(F.col("_i")["matches"], f"array<{ITEM}>"))
    out["matches"] = mat.select(key, "slot", "position", *_columns("matches", F.col("_i")))
    return out


def _packed(df: DataFrame, keys: list[str], fields: list[str], name: str) -> DataFrame:
    """Rows back to a list in position order; a document is a bounded unit."""
    g = df.groupBy(*keys).agg(F.array_sort(
        F.collect_list(F.struct("position", F.struct(*fields).alias("v"))), lambda a, b: a["position"] - b["position"]).alias("_a"))
    return g.select(*keys, F.transform("_a", lambda e: e["v"]).alias(name))


def render_operations(t: dict[str, DataFrame], key: str = "doc_id") -> DataFrame:
    """One STRUCT document per key, the inverse of :func:`shred_operations`."""
    def fields(name, *more):
        return [*TABLES[name], *more, "extra"]
    mem = _packed(t["members"], [key, "slot", "seat"], fields("members"), "members").withColumnRenamed("seat", "position")
    ent = _packed(t["entrants"].join(shuffled(mem), [key, "slot", "position"], "left"), [key, "slot"], fields("entrants", "members"), "entrants")
    mat = _packed(t["matches"], [key, "slot"], fields("matches"), "matches")
    night = t["tournaments"].join(shuffled(ent), [key, "slot"], "left").join(shuffled(mat), [key, "slot"], "left")
    nights = _packed(night.withColumnRenamed("slot", "position"), [key], fields("tournaments", "entrants", "matches"), "tournaments")
    # a full join deals its rows anew, so the short lists meet first and the nights, which hold nearly all, come last
    out = None
    for name in SHORT:
        items = _packed(t[name], [key], fields(name), name)
        out = items if out is None else out.join(shuffled(items), key, "full")
    return nights.join(shuffled(out), key, "full").select(key, "tournaments", *SHORT)
