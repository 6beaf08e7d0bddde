"""Steps whose memory, shuffle or driver share must not outgrow the tables."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from trackspark.operators import census as N
from trackspark.operators import joins as J
from trackspark.operators import trajectory as TR
from trackspark.session import cut_lineage
from trackspark.sources import operations_store as O
from trackspark.streaming import live as R


def written(spark, tmp_path, name, rows, schema):
    """Rows read from a small file, which Spark would take for small enough to broadcast."""
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
    return spark.read.parquet(f"{tmp_path}/{name}")


def sent(df) -> int:
    """Broadcasts in the plan, before anything has run."""
    return df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")


def some_balls(spark, tmp_path):
    rnd = random.Random(4)
    rows = [("d", "red", i // 10, i, rnd.randrange(127), rnd.randrange(254), (0.0, 0.0)) for i in range(200)]
    return written(spark, tmp_path, "balls", rows, "dataset string, color string, frame_no long, id long, x long, y long, mm struct<x:double,y:double>")


def test_radius_joins_send_no_table_through_the_driver(spark, tmp_path):
    b = some_balls(spark, tmp_path).drop("mm")
    c = b.select("dataset", "color", (F.col("frame_no") - 1).alias("frame_no"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    near = J.near_pairs(b, c, ["dataset", "color", "frame_no"], 80, ("x", "y"), ("nx", "ny"))
    rows = {tuple(r) for r in b.collect()}
    want = {(p[3], (p[4] - q[4]) ** 2 + (p[5] - q[5]) ** 2) for p in rows for q in rows if q[2] == p[2] + 1 and (p[4] - q[4]) ** 2 + (p[5] - q[5]) ** 2 <= 6400}
    assert sent(near) == 0 and {(r.id, r.d2) for r in near.collect()} == want
    assert sent(J.persistence_filter(b, b, 12)) == 0


def test_shot_candidates_send_no_table_through_the_driver(spark, tmp_path):
    b = some_balls(spark, tmp_path)
    links = b.select("id", (F.col("id") - 10).alias("prev_id")).filter("prev_id >= 0")
    matched = links.withColumnRenamed("id", "cur_id")
    assert sent(N.shot_candidates(matched, b.withColumn("streak", F.lit(2)), b.select("id"), 4.0)) == 0


def test_streaks_send_no_table_through_the_driver(spark, tmp_path):
    b = some_balls(spark, tmp_path).select("id")
    links = b.select("id", (F.col("id") - 10).alias("prev_id")).filter("prev_id >= 0")
    exact, capped = J.streak_length(b, links), J.streak_at_least(b, links, 3)
    assert sent(exact) == 0 and sent(capped) == 0
    assert {(r.id, r.streak) for r in exact.collect()} == {(i, i // 10 + 1) for i in range(200)}
    assert {(r.id, r.streak) for r in capped.collect()} == {(i, min(i // 10 + 1, 3)) for i in range(200)}


def test_hypotheses_are_scored_on_frames_not_on_rows_of_steps(spark):
    """No step of a hypothesis becomes a row (72 a seed before), and the scores are those of a plain walk."""
    rnd = random.Random(6)
    cells = {(f, rnd.randrange(8), rnd.randrange(16)): float(rnd.randrange(9)) for f in range(6) for _ in range(40)}
    c = spark.createDataFrame([("d", f, x, y, r) for (f, x, y), r in cells.items()], "dataset string, frame_no long, gx long, gy long, response double")
    seeds = c.select(((F.col("frame_no") * 16 + F.col("gx")) * 32 + F.col("gy")).alias("seed_id"), "dataset", "frame_no", "gx", "gy")
    scores = TR.score_hypotheses(c, seeds, 3, 8, 16)
    assert "Generate" not in scores._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for f, x, y in cells:
        for i, s in enumerate((1, 2)):
            for d, (dx, dy) in enumerate(TR.DIRECTIONS):
                path = [(f + k, x + s * dx * k // 2, y + s * dy * k // 2) for k in range(3)]
                on = all(0 <= u < 8 and 0 <= v < 16 for _, u, v in path)
                want[(f * 16 + x) * 32 + y, i * 12 + d] = sum(cells.get(p, 0.0) for p in path) / 3.0 if on else -1.0
    rows = scores.collect()
    assert {(r.seed_id, h.v): h.score for r in rows for h in r.hypotheses} == want
    best = {r.seed_id: r for r in TR.best_hypothesis(scores).collect()}
    for seed in {s for s, _ in want}:
        v = min(range(24), key=lambda k: (-want[seed, k], k))
        rivals = [want[seed, (v + 12) % 24], want[seed, v // 12 * 12 + (v + 1) % 12], want[seed, v // 12 * 12 + (v - 1) % 12]]
        assert (best[seed].v, best[seed].score, best[seed].rival) == (v, want[seed, v], max(rivals))


def test_sides_of_a_claim_are_paired_as_a_walk_over_all_pairs_would(spark):
    """Ties, unknown places and several claims; no pair is a row of the plan."""
    rnd = random.Random(9)
    rows = [(c, "red", side, t, float(rnd.randrange(6)) if rnd.random() < 0.9 else None, 0.0, 1, c * 100 + t, "red")
            for c in range(30) for side in ("pre", "post") for t in rnd.sample(range(20), 12)]
    df = spark.createDataFrame(rows, "claim_id long, claim_color string, side string, track_id long, mx double, my double, us long, event_id long, color string")
    out = N.displacement(df, 3.0, 1.0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "Join" not in plan and "cut-" not in out._jdf.queryExecution().executedPlan().toString()
    want = {}
    for c in range(30):
        a, b = ([(r[3], r[4]) for r in rows if r[0] == c and r[2] == side] for side in ("pre", "post"))
        used, got = set(), []
        for d, i, j in sorted((-1.0 if x is None or y is None else abs(x - y), i, j) for i, x in a for j, y in b):
            if ("a", i) not in used and ("b", j) not in used:
                used |= {("a", i), ("b", j)}
                got.append(d)
        want[c] = (len(got), sum(d >= 3 for d in got), sum(0 <= d <= 1 for d in got))
    assert {r.claim_id: (r.measured, r.moved, r.still) for r in out.collect()} == want


def sightings(spark, rnd, rows):
    """Sightings of a few identities in two recordings: ties, repeated rows, null keys, gaps of every kind."""
    made = [(rnd.choice("ab"), rnd.randrange(5), rnd.randrange(-120, 120), i, i % 7, i % 5) for i in range(rows)]
    made += made[:9] + [("a", None, t, 900 + t, 1, 1) for t in (3, 4, 40)] + [(None, 1, 5, 950, 1, 1), ("a", 1, None, 951, 1, 1), ("b", 2, 60, None, 1, 1)]
    return made, spark.createDataFrame(made, "dataset string, track_id long, us long, event_id long, x long, y long").repartition(3)


def test_vanished_identities_equal_a_walk_over_all_windows(spark):
    rnd, reach = random.Random(8), 8
    obs, frame = sightings(spark, rnd, 90)
    claims = [(*o[:1], o[2], o[3], "red", "pot") for o in obs] + [("b", 30, 5, "red", "pot"), ("a", -10, None, "red", "pot"), ("b", 70, 7, "red", "pot"), ("b", 70, 7, "red", "pot")]
    got = N.vanished_identities(spark.createDataFrame(claims, "dataset string, us long, event_id long, color string, kind string"), frame, reach, 24, 40)
    pre, post = {}, set()
    for d, at, claim, *_ in claims:
        for q, track, us, event, x, y in obs:
            if None not in (d, at, us) and d == q and abs(us - at) <= reach:
                post.add((claim, track)) if us > at else pre.setdefault((claim, track), []).append((us, event is not None, event, x, y))
    want = {(*k, len(v), 0, (max(v)[0], *max(v)[2:])) for k, v in pre.items() if len(v) >= 2 and k not in post}
    assert len(want) > 30 and {(r.claim_id, r.track_id, r.hits_pre, r.hits_post, tuple(r.last)) for r in got.collect()} == want and got.count() == len(want)


def test_vanished_identities_shuffle_no_row_per_claim_and_sighting(spark):
    obs = spark.range(60).selectExpr("'d' AS dataset", "id % 3 AS track_id", "id AS us", "id AS event_id", "id AS x", "id AS y")
    got = N.vanished_identities(obs.selectExpr("dataset", "us", "event_id", "'red' AS color", "'pot' AS kind"), obs, 8, 24, 40)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    above = plan[:plan.index("SortMergeJoin")]
    assert "Aggregate" not in above and "Exchange" not in above


def test_range_pairs_are_dealt_into_the_stated_parts(spark):
    l = spark.range(400).select((F.col("id") % 2).alias("k"), (F.col("id") * 10).alias("a"))
    got = J.range_pairs(l, l.select("k", F.col("a").alias("b")), ["k"], "a", "b", -50, 50, 100)
    assert got.count() == 400 * 5 - 12
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_rendering_packs_lists_where_they_lie(spark, tmp_path):
    """Documents kept by id: lists are packed where they lie and dealt anew by the joins only."""
    doc = ('{"players":[{"id":"p","name":"n","status":"s"}],"tournament":{"id":"t","matches":[{"id":"m"}],"entrants":[{"id":"e","members":[{"pid":"q"}]}]},'
           '"history":[{"id":"old"},null,{"id":"older"}],"events":[{"id":"v","action":"a","revision":3}]}')
    kept = cut_lineage(spark.createDataFrame([(i, doc) for i in range(50)] + [(50, '{"players":[{"id":"x"}]}')], "doc_id long, doc string"), "doc_id")
    out = O.render_operations(O.shred_operations(kept))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 10
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == 51 and rows[50].tournaments is None and rows[50].players[0].id == "x"
    assert [t.id for t in rows[7].tournaments] == ["t", "old", "older"] and rows[7].tournaments[0].entrants[0].members[0].pid == "q"
    assert rows[7].events[0].revision == 3 and rows[7].notes is None


def test_a_key_is_never_one_frame():
    """200,000 rows of one key over 100 hours, out of order: put away in chunks, handed to the rule an hour at a time."""
    class Store(dict):
        getValue, removeKey = dict.__getitem__, dict.__delitem__

        def updateValue(self, k, v):
            self[k] = v

    class Value:
        now = None
        exists, get = lambda self: self.now is not None, lambda self: self.now

        def update(self, v):
            self.now = v

        def clear(self):
            self.now = None

    class Handle:
        getMapState, getValueState, registerTimer = lambda self, *a: Store(), lambda self, *a: Value(), lambda self, at: None

    class Clock:
        getCurrentWatermarkInMs = lambda self: at // 1000

    seen, at = [], 10**18
    rule = R.OrderedRule(["us"], dict, lambda state, rows: seen.append(rows) or rows, "event_id", None)
    rule.init(Handle())
    us = np.random.default_rng(3).permutation(200_000) * 1_800_000
    parts = (pd.DataFrame({"us": p, "event_id": p, "at_us": p, "at_time": p}) for p in np.split(us, 20))
    out = pd.concat(rule.handleInputRows(("k",), parts, Clock()), ignore_index=True)
    assert out["us"].tolist() == sorted(us.tolist())
    assert max(len(x) for x in seen) <= 2000 and not rule.waiting
