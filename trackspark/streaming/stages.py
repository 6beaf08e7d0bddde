"""Staged enrichment: registered column stages with cadence, evidence and budget."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stage:
    """``process(df) -> Column`` for the result, ``cost`` its measured milliseconds."""

    name: str
    process: Callable[[DataFrame], Column]
    cost: Callable[[DataFrame], Column] = lambda df: F.lit(0.0)
    every: int = 1
    budget_ms: float | None = None


@dataclass
class StageRegistry:
    """Fixed order, one stage per name."""

    stages: list[Stage] = field(default_factory=list)

    def add(self, stage: Stage) -> "StageRegistry":
        if any(s.name == stage.name for s in self.stages):
            raise ValueError(f"stage {stage.name!r} is already registered")
        if stage.every < 1:
            raise ValueError("a cadence is at least one frame")
        self.stages.append(stage)
        return self

    def run(self, df: DataFrame, seq: str = "seq", frame_budget_ms: float | None = None) -> DataFrame:
        """One result column per stage (absent on skipped frames, never stale), and the first overrun.

        Works the same on a batch or a streaming DataFrame: every rule is a column.
        """
        total = F.lit(0.0)
        over, ran = None, []
        for s in self.stages:
            on = F.pmod(F.col(seq), F.lit(s.every)) == 0
            cost = F.when(on, s.cost(df)).otherwise(0.0)
            df = df.withColumn(s.name, F.when(on, s.process(df))).withColumn(f"_cost_{s.name}", cost)
            total = total + F.col(f"_cost_{s.name}")
            ran.append(F.when(on, s.name))
            ceiling = s.budget_ms if s.budget_ms is not None else frame_budget_ms
            rule = F.lit(False)
            if ceiling is not None:
                rule = rule | (F.col(f"_cost_{s.name}") > ceiling)
            if frame_budget_ms is not None:
                rule = rule | (total > frame_budget_ms)
            hit = on & rule
            over = F.when(hit, s.name) if over is None else over.when(hit, s.name)
        df = df.withColumn("total_ms", total).withColumn("ran", F.array_compact(F.array(*ran))).withColumn("overrun", over)
        return df.drop(*[f"_cost_{s.name}" for s in self.stages])


def run_stages(df: DataFrame, stages: list[Stage], seq: str = "seq", frame_budget_ms: float | None = None) -> DataFrame:
    registry = StageRegistry()
    for s in stages:
        registry.add(s)
    return registry.run(df, seq, frame_budget_ms)
