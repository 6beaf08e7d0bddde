"""Identity, label and annotation sets: shredding, merging, idempotent loads and retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.kernels import top_k


def shred_map(docs: DataFrame, key: str, doc: str, value: str) -> DataFrame:
    """``{name: value}`` documents (labels, verdicts, seeds, corrections, anchors) to rows."""
    return docs.select(key, F.explode(F.from_json(doc, f"map<string,{value}>")).alias("name", "value"))


def render_map(rows: DataFrame, key: str) -> DataFrame:
    """Rows back to a document; a set document is a bounded unit."""
    pairs = F.array_sort(F.collect_list(F.struct("name", "value")))
    return rows.groupBy(key).agg(F.to_json(F.map_from_entries(pairs)).alias("doc"))


def shred_bank(df: DataFrame, key: str, flat: str, dim: int) -> DataFrame:
    """A flat n x dim bank to one row per vector."""
    n = F.expr(f"size({flat}) div {dim}")
    rows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(F.col(flat), i * dim + 1, F.lit(dim)))
    return df.select(key, F.posexplode(rows).alias("position", "vec"))


def render_bank(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "vec"))).alias("_a")).select(
        key, F.flatten(F.transform("_a", lambda e: e["vec"])).alias("flat"))


def label_pair(raw: Column) -> tuple[Column, Column]:
    """(label text, integer label): ``u`` and other text keep a null integer."""
    return raw, raw.try_cast("int")


def merge_label_sets(sets: Sequence[tuple[str, DataFrame, DataFrame, DataFrame]]) -> DataFrame:
    """Prefix names per set, keep integer labels only, carry the context file.

    Each set is (prefix, meta(file,t,score), labels(file,label text), context(file,ctx)).
    """
    out = None
    for prefix, meta, labels, ctx in sets:
        m = meta.join(labels.select("file", F.col("label").try_cast("int").alias("label")), "file", "left").join(ctx.select("file", "ctx"), "file", "left")
        def named(c):
            return F.concat(F.lit(f"{prefix}_"), F.regexp_extract(c, "[^/]+$", 0))
        m = m.select(named("file").alias("file"), "t", "score", "label", F.when(F.col("ctx").isNotNull(), named("ctx")).alias("ctx"))
        out = m if out is None else out.unionByName(m)
    return out


def upsert_by_basename(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """A label goes to the first stored key of its file name, other keys of that name are cleared.

    stored: key, label, position.  incoming: file, new_label.
    """
    base = F.regexp_extract("key", "[^/]+$", 0)
    s = stored.withColumn("file", base)
    first = s.groupBy("file").agg(F.min(F.struct("position", "key")).alias("f")).select("file", F.col("f.key").alias("_first"))
    j = s.join(first, "file").join(incoming.select("file", "new_label"), "file", "full")
    hit = F.col("new_label").isNotNull()
    keep = ~hit | F.col("key").isNull() | (F.col("key") == F.col("_first"))
    return j.filter(keep).select(F.coalesce("key", "file").alias("key"), F.coalesce("new_label", "label").alias("label"))


def merge_records(stored: DataFrame, incoming: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Field-wise merge; an incoming value wins, absent fields keep the stored one."""
    i = incoming.select(key, *[F.col(c).alias(f"_{c}") for c in cols])
    return stored.join(i, key, "full").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in cols])


def load_set(new: DataFrame, stored: DataFrame, replace: bool, name: str) -> tuple[DataFrame, DataFrame]:
    """(report row, table to keep): unchanged / imported / refused / absent.

    Both sides are digested in one pass each; the stored side stays unless the load is due.
    """
    cols = new.columns
    def digest(df):
        row = F.xxhash64(*[F.col(c) for c in cols])
        return df.select(row.alias("_h")).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col("_h").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("digest"))
    a, b = digest(new), digest(stored)
    j = a.select(F.col("rows").alias("new_rows"), F.col("digest").alias("_a")).crossJoin(b.select(F.col("rows").alias("stored_rows"), F.col("digest").alias("_b")))
    same = (F.col("new_rows") == F.col("stored_rows")) & (F.col("_a") == F.col("_b"))
    status = (F.when(F.col("new_rows") == 0, "absent").when(same, "unchanged").when((F.col("stored_rows") == 0) | F.lit(replace), "imported").otherwise("refused"))
    report = j.select(F.lit(name).alias("set"), "new_rows", "stored_rows", status.alias("status"))
    take = report.select((F.col("status") == "imported").alias("_take"))
    keep = new.crossJoin(take).filter("_take").drop("_take").unionByName(stored.crossJoin(take).filter("not _take").drop("_take"))
    return report, keep


def trim_log(df: DataFrame, keys: Sequence[str], order: Sequence, n: int = 500, salt: str = "o_orderkey") -> DataFrame:
    """Newest ``n`` entries per log, numbered oldest first; the log table itself stays unbounded."""
    cut = top_k(df, keys, order, n, F.col(salt), name="age")
    return cut
