"""Kernels against brute force, and their independence from bucket width and partitioning."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.functions.vectors import cosine_blocks
from trackspark.operators import joins as J
from trackspark.operators import kernels as K


def skewed(spark, n=600, seed=5):
    """One key holds most rows, with ties, zeros and negatives."""
    r = random.Random(seed)
    rows = [(0 if i % 4 else r.randrange(1, 5), r.randrange(0, 4000), i, r.choice([0.0, -1.5, 7.0, r.uniform(-50, 50)])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k long, pos long, id long, v double")


def by_key(rows):
    out = {}
    for row in rows:
        out.setdefault(row[0], []).append(row)
    return out


def test_exact_quantiles_match_numpy(spark):
    rows, df = skewed(spark)
    probs = {"a": 0.05, "b": 0.5, "c": 0.999}
    for got in K.exact_quantiles(df, ["k"], "v", probs).collect():
        want = np.percentile([x[3] for x in by_key(rows)[got.k]], [100 * p for p in probs.values()])
        assert np.allclose([got.a, got.b, got.c], want)
        assert got.n == len(by_key(rows)[got.k])


@pytest.mark.parametrize("width", [7, 100, 100000])
def test_islands_do_not_depend_on_the_bucket_width(spark, width):
    rows, df = skewed(spark)
    got = {r.id: r.island for r in K.gap_islands(df.repartition(5), ["k"], "pos", 12, width, ["id"]).collect()}
    for group in by_key(rows).values():
        start = last = None
        for _, pos, ident, _ in sorted(group, key=lambda x: (x[1], x[2])):
            if last is None or pos - last > 12:
                start = pos
            last = pos
            assert got[ident] == start


@pytest.mark.parametrize("width", [50, 5000])
def test_ordered_index_and_lag(spark, width):
    rows, df = skewed(spark)
    i = K.bounded_lag(K.ordered_index(df, ["k"], ["id"], "pos", width), ["k"], "idx", ["id"], width=16)
    got = {r.id: (r.idx, r.prev_id) for r in i.collect()}
    for group in by_key(rows).values():
        prev = None
        for n, row in enumerate(sorted(group, key=lambda x: (x[1], x[2]))):
            assert got[row[2]] == (n, prev)
            prev = row[2]


@pytest.mark.parametrize("width", [20, 900])
def test_asof_first_takes_the_first_row_in_order(spark, width):
    rows, df = skewed(spark)
    left = df.filter("id % 2 = 0").select("k", "pos", "id")
    right = df.filter("id % 2 = 1").select("k", "pos", F.col("id").alias("rid"))
    got = {r.id: r.match.rid for r in J.asof_first(left, right, ["k"], "pos", 5, "rid", ["rid"], width=width).collect()}
    for k, pos, ident, _ in rows:
        if ident % 2 == 0:
            hits = [r[2] for r in rows if r[2] % 2 and r[0] == k and abs(r[1] - pos) <= 5]
            assert got.get(ident) == (min(hits) if hits else None)


def test_merge_intervals(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 10, 12), (1, 30, 40), (1, 5, 33), (2, 1, 2)], "k long, a long, b long")
    for width in (4, 1000):
        assert sorted(tuple(r) for r in K.merge_intervals(df, ["k"], "a", "b", width).collect()) == [(1, 0, 40), (2, 1, 2)]


def test_top_k_is_exact_under_salting(spark):
    _, df = skewed(spark)
    got = sorted((r.k, r["rank"], r.id) for r in K.top_k(df, ["k"], [F.desc("v"), "id"], 3, F.col("id"), salts=8).collect())
    rows = by_key([tuple(r) for r in df.collect()])
    want = sorted((k, n + 1, x[2]) for k, g in rows.items() for n, x in enumerate(sorted(g, key=lambda x: (-x[3], x[2]))[:3]))
    assert got == want


def test_cosine_blocks_see_every_pair_once(spark):
    rng = np.random.default_rng(3)
    vecs = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(40)] + [(40, [0.0] * 6)]
    df = spark.createDataFrame(vecs, "id long, vec array<double>")

    def emit(sims, a, b):
        i, j = np.nonzero(np.ones_like(sims))
        return {"a": a["id"][i], "b": b["id"][j], "c": sims[i, j]}
    got = {(r.a, r.b): r.c for r in cosine_blocks(df, df, [], ["id"], ["id"], emit, "a long, b long, c double", size=7).collect()}
    assert len(got) == 41 * 41 and got[(40, 3)] == 0.0
    u, v = np.array(vecs[2][1]), np.array(vecs[9][1])
    assert abs(got[(2, 9)] - u @ v / np.linalg.norm(u) / np.linalg.norm(v)) < 1e-12


def test_greedy_is_global_not_mutual(spark):
    """Nearest overall first: b takes 1 although a is also nearest to 1."""
    df = spark.createDataFrame([(0, 10, 1, 4), (0, 20, 1, 3), (0, 10, 2, 9), (0, 20, 2, 100)], "g long, l long, r long, c long")
    got = sorted((r.l, r.r) for r in J.greedy_nearest(df, ["g"], None, "l", "r", "c").collect())
    assert got == [(10, 2), (20, 1)]
