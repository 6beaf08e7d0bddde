"""Store verification: domains, uniqueness, references, fingerprints and differences."""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAT_ROWS = 20_000  # rows of a flattened document that are handed on at once


def check_domains(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row per (rule, key) violated, all rules of a table in one scan; null fails no CHECK."""
    broken = F.array_compact(F.array(*[F.when(~rule, name) for name, rule in rules.items()]))
    return df.select(F.col(key).alias("key"), F.explode(broken).alias("rule"))


def check_unique(df: DataFrame, rule: str, cols: Sequence[str], where: Column | None = None) -> DataFrame:
    """Key values held by more than one row, optionally only among the rows of a condition."""
    d = df if where is None else df.filter(where)
    return d.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.lit(rule).alias("rule"), F.concat_ws("|", *cols).alias("key"), "n")


def check_references(child: DataFrame, parent: DataFrame, child_col: str, parent_col: str, rule: str, key: str) -> DataFrame:
    """Child rows whose parent is missing; a null reference is not a broken one."""
    orphans = child.filter(F.col(child_col).isNotNull()).join(parent.select(F.col(parent_col).alias(child_col)), child_col, "left_anti")
    return orphans.select(F.lit(rule).alias("rule"), F.col(key).alias("key"))


def fingerprint(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count and an order-insensitive content digest per table (the sum of row digests)."""
    out = None
    for name, df in tables.items():
        row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in df.columns])
        one = df.select(F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("long").alias("_d")).agg(
            F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("_d"), F.lit(0)).alias("digest")).select(F.lit(name).alias("table"), "rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def table_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset difference both ways in one aggregation: rows with unequal counts."""
    cols = a.columns
    both = a.withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0)).unionByName(b.select(*cols).withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1)))
    g = both.groupBy(*cols).agg(F.sum("_a").alias("in_a"), F.sum("_b").alias("in_b")).filter("in_a <> in_b")
    return g.withColumn("only_in", F.when(F.col("in_a") > F.col("in_b"), "a").otherwise("b"))


def flatten_json(df: DataFrame, key: str, doc: str) -> DataFrame:
    """(key, path, kind, value) per leaf and container; a path is an array of typed steps, so that it sorts at any length.

    A step is a name (``index`` -1) or a place in a list (``name`` empty); ``path_text`` shows a path.
    """
    import pyarrow as pa

    from ..session import ship_package

    ship_package(df.sparkSession)

    def walk(path, v):
        if isinstance(v, dict):
            yield path, "object", ""
            for k in v:
                yield from walk((*path, (-1, k)), v[k])
        elif isinstance(v, list):
            yield path, "array", str(len(v))
            for i, x in enumerate(v):
                yield from walk((*path, (i, "")), x)
        else:
            kind = "bool" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "null" if v is None else "string"
            yield path, kind, json.dumps(float(v) if kind == "number" else v)

    def packed(keys, rows, key_type):
        steps = [s for path, _, _ in rows for s in path]
        flat = pa.StructArray.from_arrays([pa.array([i for i, _ in steps], pa.int64()), pa.array([n for _, n in steps], pa.string())], ["index", "name"])
        ends = pa.array(list(accumulate((len(path) for path, _, _ in rows), initial=0)), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.ListArray.from_arrays(ends, flat), pa.array([k for _, k, _ in rows], pa.string()), pa.array([v for _, _, v in rows], pa.string())],
                                          [key, "path", "kind", "value"])

    def run(batches):
        for batch in batches:
            keys, rows = [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in walk((), json.loads(text)):
                    keys.append(k)
                    rows.append(row)
                    if len(rows) == FLAT_ROWS:
                        yield packed(keys, rows, batch.column(0).type)
                        keys, rows = [], []
            if rows:
                yield packed(keys, rows, batch.column(0).type)
    kind = dict(df.dtypes)[key]
    return df.select(key, doc).mapInArrow(run, f"{key} {kind}, path array<struct<index: bigint, name: string>>, kind string, value string")


def path_text(path: Column) -> Column:
    """``$.name[000001]``: places in lists have six digits at least."""
    shown = F.transform(path, lambda s: F.when(s["index"] < 0, F.concat(F.lit("."), s["name"])).otherwise(F.format_string("[%06d]", s["index"])))
    return F.concat(F.lit("$"), F.array_join(shown, ""))


def first_difference(a: DataFrame, b: DataFrame, key: str = "id", doc: str = "doc") -> DataFrame:
    """First differing path per document: a bool is no number, a missing key and a length differ."""
    l = flatten_json(a, key, doc).select(key, "path", F.struct("kind", "value").alias("l"))
    r = flatten_json(b, key, doc).select(key, "path", F.struct("kind", "value").alias("r"))
    d = l.join(r, [key, "path"], "full").filter(F.col("l").isNull() | F.col("r").isNull() | (F.col("l") != F.col("r")))
    why = (F.when(F.col("r").isNull(), "missing in b").when(F.col("l").isNull(), "missing in a").when(F.col("l.kind") != F.col("r.kind"), "type")
           .when(F.col("l.kind") == "array", "length").otherwise("value"))
    return d.groupBy(key).agg(F.min(F.struct("path", why.alias("why"))).alias("f"), F.count(F.lit(1)).alias("differences")).select(
        key, path_text(F.col("f.path")).alias("path"), "f.why", "differences")
