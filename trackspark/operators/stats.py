"""Summaries and rank percentiles with their distinct definitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kernels import exact_quantiles, exact_ranks, halo_window, ordered_index

SUMMARY = {"p05": 0.05, "p10": 0.10, "median": 0.5, "p90": 0.9, "p95": 0.95}
SERIES = {"median": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}
FLOOR_MARGIN = 1.25


def summary(df: DataFrame, col: str, by: Sequence[str], groups: DataFrame | None = None) -> DataFrame:
    """n/min/p05/p10/median/p90/p95/max; groups without a value answer n = 0 and nulls."""
    out = exact_quantiles(df, by, col, SUMMARY)
    if groups is not None:
        out = groups.select(*by).distinct().join(out, list(by), "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0)))


def percentile_rank(df: DataFrame, col: str, by: Sequence[str], q: float, rule: str) -> DataFrame:
    """``ceil``: ceil(q*n)-1; ``round``: half-even round of q*(n-1)."""
    if rule == "ceil":
        rank = lambda n: F.greatest(F.lit(0), F.least(n - 1, F.ceil(F.lit(q) * n) - 1))
    elif rule == "round":
        rank = lambda n: F.least(n - 1, F.rint(F.lit(q) * (n - 1)).cast("long"))
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return exact_ranks(df, by, col, {"value": rank}).select(*by, "n", "value")


def rolling_rank(df: DataFrame, keys: Sequence[str], idx: str, col: str, probs: dict[str, float], last: int = 120) -> DataFrame:
    """Ordered nearest-rank percentiles over the last ``last`` samples, per sample."""
    def build(w):
        held = F.array_sort(F.collect_list(col).over(w.rowsBetween(-(last - 1), 0)))
        return {"_held": held}
    out = halo_window(df, keys, idx, 4096, last - 1, 0, build=build)
    def pick(q):
        n = F.size("_held")
        return F.col("_held")[F.least(n - 1, F.rint(F.lit(q) * (n - 1)).cast("int"))]
    return out.select("*", *[pick(q).alias(n) for n, q in probs.items()]).drop("_held")


def unpivot(df: DataFrame, ids: Sequence[str], channels: Sequence[str]) -> DataFrame:
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in channels]).unpivot(list(ids), list(channels), "channel", "value")


def series_stats(df: DataFrame, by: Sequence[str], channels: Sequence[str]) -> DataFrame:
    return exact_quantiles(unpivot(df, by, channels), [*by, "channel"], "value", SERIES)


def channel_floors(stats: DataFrame) -> DataFrame:
    return stats.withColumn("threshold", F.col("p999") * FLOOR_MARGIN)


def array_median(a: Column) -> Column:
    """Median of an already sorted, non-empty array."""
    n = F.size(a)
    return (a[F.floor((n - 1) / 2).cast("int")] + a[F.floor(n / 2).cast("int")]) / 2.0


def running_median(df: DataFrame, keys: Sequence[str], order: str, col: str, n: int, span: int, name: str = "median") -> DataFrame:
    """Median of the previous n values, the current row excluded; null on the first row."""
    indexed = ordered_index(df, keys, [], order, span, "_i")
    def build(w):
        return {name: F.percentile(col, 0.5).over(w.rowsBetween(-n, -1))}
    return halo_window(indexed, keys, "_i", 4096, n, 0, build=build).drop("_i")
