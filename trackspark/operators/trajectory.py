"""Trajectory hypothesis search over gridded responses, and its null distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import exact_quantiles, shuffled

# Twelve unit directions on the cell grid, 30 degrees apart (rounded).
DIRECTIONS = ((2, 0), (2, 1), (1, 2), (0, 2), (-1, 2), (-2, 1), (-2, 0), (-2, -1), (-1, -2), (0, -2), (1, -2), (2, -1))


def hypotheses(n: int, width: int, height: int, speeds: Sequence[int] = (1, 2)) -> Column:
    """Velocity grid: half cells per frame as offsets ``o<i>`` of each step in a grid laid out column by column, and the start cells that stay on it."""
    out = []
    for i, s in enumerate(speeds):
        for d, (dx, dy) in enumerate(DIRECTIONS):
            steps = [(s * dx * k // 2, s * dy * k // 2) for k in range(n)]
            xs, ys = zip(*steps)
            bounds = {"left": -min(xs), "right": width - max(xs), "top": -min(ys), "bottom": height - max(ys)}
            fields = {"v": i * 12 + d, "speed": s, "dir": d} | bounds | {f"o{k}": x * height + y for k, (x, y) in enumerate(steps)}
            out.append(F.struct(*[F.lit(v).alias(name) for name, v in fields.items()]))
    return F.array(*out)


def score_hypotheses(cells: DataFrame, seeds: DataFrame, n: int, width: int, height: int, key: str = "dataset") -> DataFrame:
    """Mean response along each hypothesis of each seed; out of bounds scores -1.

    A frame has a fixed cell grid, so it is packed into one row; a seed meets its own frame and the n - 1 after
    it by equality and looks the cells of its steps up there.  No seed meets another seed, and no step of a
    hypothesis is a row.  Output: seed_id, hypotheses (ARRAY<STRUCT<v,speed,dir,score,coherent_share>>; a path off the grid has no share).
    """
    at = (F.col("gx") * height + F.col("gy")).cast("int")
    on_grid = (F.col("gx") >= 0) & (F.col("gy") >= 0) & (F.col("gx") < width) & (F.col("gy") < height)
    packed = cells.filter(on_grid & F.col(key).isNotNull()).groupBy(key, "frame_no").agg(
        F.collect_list(F.struct(at.alias("at"), F.coalesce(F.col("response").cast("double"), F.lit(0.0)).alias("r"))).alias("_cells"))
    spots = F.sequence(F.lit(0), F.lit(width * height - 1))
    held = lambda k: F.aggregate(F.filter("_cells", lambda c: c["at"] == k), F.lit(0.0), lambda a, c: a + c["r"])
    frames = packed.select(key, "frame_no", F.transform(spots, held).alias("_grid"))
    path = seeds.filter("seed_id is not null").select("seed_id", key, "frame_no", "gx", "gy")
    for i in range(n):
        step = frames.select(key, (F.col("frame_no") - i).alias("frame_no"), F.col("_grid").alias(f"_f{i}"))
        path = path.join(shuffled(step), [key, "frame_no"], "left")
    def scored(h):
        # steps of one direction never turn, so the ends decide whether a path stays on the grid
        alive = (F.col("gx") >= h["left"]) & (F.col("gx") < h["right"]) & (F.col("gy") >= h["top"]) & (F.col("gy") < h["bottom"])
        r = [F.coalesce(F.get(F.col(f"_f{i}"), F.col("_at") + h[f"o{i}"]), F.lit(0.0)) for i in range(n)]
        lit = [F.when(x > 0, 1).otherwise(0) for x in r]
        return F.struct(h["v"].alias("v"), h["speed"].alias("speed"), h["dir"].alias("dir"),
                        F.when(alive, sum(r[1:], r[0]) / float(n)).otherwise(-1.0).alias("score"),
                        F.when(alive, sum(lit[1:], lit[0]) / float(n)).otherwise(0.0).alias("coherent_share"))
    return path.withColumn("_at", at).select("seed_id", F.transform(hypotheses(n, width, height), scored).alias("hypotheses"))


def best_hypothesis(scores: DataFrame) -> DataFrame:
    """Best hypothesis per seed; a local maximum beats its other speed and both 30-degree neighbours."""
    order = lambda h: F.struct((-h["score"]).alias("k"), h["v"].alias("v"), h["score"].alias("score"), h["speed"].alias("speed"),
                               h["dir"].alias("dir"), h["coherent_share"].alias("coherent_share"))
    best = scores.withColumn("b", F.array_min(F.transform("hypotheses", order))).filter("b.score >= 0")
    def rival(h):
        turn = F.pmod(h["dir"] - F.col("b.dir"), F.lit(12))
        return ((h["dir"] == F.col("b.dir")) & (h["speed"] != F.col("b.speed"))) | ((h["speed"] == F.col("b.speed")) & turn.isin(1, 11))
    top = F.array_max(F.transform(F.filter("hypotheses", rival), lambda h: h["score"]))
    out = best.select("seed_id", "b.v", "b.score", "b.speed", "b.dir", "b.coherent_share", top.alias("rival"))
    return out.withColumn("local_max", F.col("score") > F.col("rival"))


def frame_floor(cells: DataFrame, key: str = "dataset") -> DataFrame:
    """Response above the frame's own median, floored at zero (a frame has a fixed cell grid)."""
    med = cells.groupBy(key, "frame_no").agg(F.percentile("response", 0.5).alias("_m"))
    return cells.join(shuffled(med), [key, "frame_no"]).withColumn("response", F.greatest(F.lit(0.0), F.col("response") - F.col("_m"))).drop("_m")


def null_bar(best: DataFrame, by: str, q: float = 0.95) -> DataFrame:
    return exact_quantiles(best, [by], "score", {"bar": q, "median": 0.5}).select(by, "n", "median", "bar")
