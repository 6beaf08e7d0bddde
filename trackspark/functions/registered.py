"""Functions a user calls by name from SQL: grouped functions over bounded groups, and generators for lateral joins.

``register(spark)`` makes them known to a session.  A grouped function sees one group at a time
(the samples of a burst, the faces of a tracklet), so its group must be bounded; for groups of any size
use ``operators.stats`` and ``operators.identity``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..session import ship_package


def nearest_rank(values: pd.Series, share: pd.Series) -> float:
    """The value at position round(share * (n - 1)) of the sorted values; nulls count nothing."""
    v = np.sort(values.dropna().to_numpy(float))
    return None if not len(v) else float(v[min(len(v) - 1, round(float(share.iloc[0]) * (len(v) - 1)))])


def _unit(vecs: pd.Series) -> np.ndarray:
    m = np.array(vecs.tolist(), float)
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def medoid(ids: pd.Series, vecs: pd.Series) -> int:
    """The id whose vector is most similar to the others of its group (first id on a tie)."""
    m = _unit(vecs)
    score = np.round(m @ m.sum(axis=0) - (m * m).sum(axis=1), 9)
    return int(min(zip(-score, ids))[1])


def leader_count(ranks: pd.Series, vecs: pd.Series, bar: pd.Series) -> int:
    """Leaders of a group: in order of rank, a vector that no earlier leader is similar to (cosine below the bar) leads."""
    m = _unit(vecs)[np.argsort(ranks.to_numpy(), kind="stable")]
    leaders: list[np.ndarray] = []
    for v in m:
        if not leaders or max(float(v @ x) for x in leaders) < float(bar.iloc[0]):
            leaders.append(v)
    return len(leaders)


class BracketTimes:
    """``at_us, step``: the times around an event, every ``every_us`` from ``before_us`` before it to ``after_us`` after it."""

    def eval(self, us: int, before_us: int, after_us: int, every_us: int) -> Iterator[tuple[int, int]]:
        if us is not None:
            for step in range(-(before_us // every_us), after_us // every_us + 1):
                yield us + step * every_us, step


class GridPoints:
    """``col, row, x, y``: points of a grid of ``cols`` by ``rows`` over a box, corners included."""

    def eval(self, x0: float, y0: float, x1: float, y1: float, cols: int, rows: int) -> Iterator[tuple[int, int, float, float]]:
        for r in range(rows):
            for c in range(cols):
                yield c, r, x0 + (x1 - x0) * c / max(1, cols - 1), y0 + (y1 - y0) * r / max(1, rows - 1)


class Sweep:
    """``step, bar``: thresholds from ``first`` to ``last``."""

    def eval(self, first: float, last: float, steps: int) -> Iterator[tuple[int, float]]:
        for k in range(steps):
            yield k, first + (last - first) * k / max(1, steps - 1)


class BracketSlots:
    """``round, slot``: the matches of a single-elimination bracket for ``entrants``, first round first."""

    def eval(self, entrants: int) -> Iterator[tuple[int, int]]:
        rounds = max(0, math.ceil(math.log2(entrants))) if entrants and entrants > 0 else 0
        for r in range(1, rounds + 1):
            for slot in range(1 << (rounds - r)):
                yield r, slot


GROUPED = {"nearest_rank": (nearest_rank, "double"), "medoid": (medoid, "long"), "leader_count": (leader_count, "long")}
GENERATORS = {"bracket_times": (BracketTimes, "at_us long, step int"), "grid_points": (GridPoints, "col int, row int, x double, y double"),
              "sweep": (Sweep, "step int, bar double"), "bracket_slots": (BracketSlots, "round int, slot int")}


def register(spark: SparkSession) -> None:
    """Register all of them under their names (once per session; again is harmless)."""
    ship_package(spark)
    for name, (fn, kind) in GROUPED.items():
        spark.udf.register(name, F.pandas_udf(fn, kind))
    for name, (cls, kind) in GENERATORS.items():
        spark.udtf.register(name, F.udtf(cls, returnType=kind))
