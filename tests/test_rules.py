"""Literal scenarios for the order-dependent, geometric and live rules."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.functions import geometry as G
from trackspark.functions import scalars as P
from trackspark.operators import association as A
from trackspark.operators import audit as V
from trackspark.operators import evaluation as E
from trackspark.operators import identity as I
from trackspark.operators import ledger as L
from trackspark.operators import selection as S
from trackspark.operators import signals as SG
from trackspark.plans.geometry import box_cover
from trackspark.streaming import live as R
from trackspark.streaming import stages as U

SEC = 1_000_000


def sightings(spark, rows):
    full = [(0, int(t * SEC), i, c, s, float(x), float(y)) for i, (t, c, s, x, y) in enumerate(rows)]
    return spark.createDataFrame(full, "dataset long, us long, event_id long, color string, source string, x double, y double")


def tids(df):
    return [r.tid for r in df.orderBy("event_id").collect()]


def test_homography_solves_the_four_corners(spark):
    quad = [(532.0, 323.0), (800.2, 324.0), (997.7, 569.2), (383.9, 563.2)]
    q = F.array(*[G.point(x, y) for x, y in quad])
    m = np.array(spark.range(1).select(G.homography(q).alias("h")).first().h).reshape(3, 3)
    for (x, y), (u, v) in zip(quad, [(0, 0), (1269, 0), (1269, 2539), (0, 2539)]):
        a, b, w = m @ np.array([x, y, 1.0])
        assert abs(a / w - u) < 1e-6 and abs(b / w - v) < 1e-6
    inv = np.array(spark.range(1).select(G.inverse_homography(q).alias("h")).first().h).reshape(3, 3)
    p = m @ inv
    assert np.allclose(p / p[2, 2], np.eye(3), atol=1e-8)


def test_projection_has_no_answer_at_the_horizon(spark):
    h = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0, 1, 0, -5)])
    got = spark.createDataFrame([(5.0, 1.0), (6.0, 1.0), (float("nan"), 1.0), (float("inf"), 1.0)], "x double, y double").select(G.project(h, F.col("x"), F.col("y")).alias("p")).collect()
    assert [r.p is None for r in got] == [True, False, True, True]


def clip_area(poly, box):
    x0, y0, x1, y1 = box
    for axis, bound, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = []
        for k in range(len(poly)):
            p, q = poly[k - 1], poly[k]
            pin, qin = sign * (p[axis] - bound) >= 0, sign * (q[axis] - bound) >= 0
            if pin != qin:
                t = (bound - p[axis]) / (q[axis] - p[axis])
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
            if qin:
                out.append(q)
        poly = out
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(poly, poly[1:] + poly[:1]))) / 2 if poly else 0.0


def test_box_cover_matches_a_polygon_clip(spark):
    quad = [(0.0, 0.0), (100.0, 10.0), (120.0, 90.0), (-10.0, 80.0)]
    boxes = [(10, 10, 40, 50), (-50, -50, 300, 300), (90, 40, 200, 60), (300, 300, 310, 310), (-20, 70, 20, 100)]
    df = spark.createDataFrame([tuple(map(float, b)) for b in boxes], "a double, b double, c double, d double").withColumn("q", F.array(*[G.point(x, y) for x, y in quad]))
    got = [r.cover for r in box_cover(df, F.col("q"), [F.col(c) for c in "abcd"]).collect()]
    whole = clip_area(quad, (-1e6, -1e6, 1e6, 1e6))
    assert np.allclose(got, [clip_area(quad, b) / whole for b in boxes])


def test_association_keeps_two_balls_apart_and_follows_a_roll(spark):
    rows = [(0.0, "red", "scored", 10, 10), (0.0, "blue", "scored", 200, 10)]
    for k in range(1, 6):
        rows += [(k / 10, "red", "scored", 10 + 20 * k, 10), (k / 10, "blue", "scored", 200, 10)]
    got = tids(A.associate(sightings(spark, rows), SEC, 10 * SEC))
    assert len({got[i] for i in range(0, 12, 2)}) == 1 and len({got[i] for i in range(1, 12, 2)}) == 1 and got[0] != got[1]


def test_association_gap_flicker_and_bridge(spark):
    near = A.associate(sightings(spark, [(0, "red", "plain", 5, 5), (0.5, "red", "plain", 8, 5), (0.6, "red", "plain", 8, 5)]), SEC, SEC).orderBy("event_id").collect()
    assert len({r.tid for r in near}) == 1 and [r.bridged for r in near] == [False, True, False]
    assert len(set(tids(A.associate(sightings(spark, [(0, "red", "plain", 5, 5), (2.5, "red", "plain", 5, 5)]), SEC, SEC)))) == 2
    assert len(set(tids(A.associate(sightings(spark, [(0, "red", "plain", 5, 5), (0.1, "pink", "plain", 9, 5)]), SEC, SEC)))) == 1
    assert len(set(tids(A.associate(sightings(spark, [(0, "red", "plain", 5, 5), (0.1, "pink", "scored", 9, 5)]), SEC, SEC)))) == 2


def test_association_does_not_depend_on_partitioning(spark):
    rng = np.random.default_rng(1)
    rows = [(float(t) / 15, "red" if k % 2 else "blue", "scored", 40 * k + rng.normal(), 50 + rng.normal()) for t in range(60) if t not in range(20, 60, 13) for k in range(4)]
    df = sightings(spark, rows)
    assert tids(A.associate(df, SEC, 10 * SEC)) == tids(A.associate(df.repartition(7), SEC, SEC // 2))


def naive_association(rows, cfg=A.LinkConfig()):
    """The stated rule over whole lists: (sightings in order, identities as lists of places, marks per sighting, skips)."""
    frame = lambda t: round(t / cfg.bucket_s)
    order = sorted(range(len(rows)), key=lambda i: (frame(rows[i][0]), rows[i][2], rows[i][1], rows[i][3], i))
    ids, marks, skips = [], {}, 0

    def color(k):
        seen = [rows[i][1] for i in k]
        named = {c: (seen.count(c), -max(j for j, d in enumerate(seen) if d == c)) for c in seen if c != "unknown"}
        return max(named, key=named.get) if named else "unknown"

    def ahead(k, t):
        last, v = rows[k[-1]], (0.0, 0.0)
        if len(k) > 1 and last[0] - rows[k[-2]][0] > 1e-6:
            dt = last[0] - rows[k[-2]][0]
            v = ((last[3] - rows[k[-2]][3]) / dt, (last[4] - rows[k[-2]][4]) / dt)
        lead = max(0.0, t - last[0])
        return last[3] + v[0] * lead, last[4] + v[1] * lead, float(np.hypot(*v))

    def gate(k, t, base):
        gap, (px, py, speed) = t - rows[k[-1]][0], ahead(k, t)
        if len(k) < 2:
            return px, py, cfg.bootstrap_px if gap <= cfg.bootstrap_dt_s else base
        return px, py, base + cfg.slack * speed * max(0.0, gap)
    for i in order:
        t, c, source, x, y = rows[i]
        fits = []
        for n, k in enumerate(ids):
            if any(frame(rows[j][0]) == frame(t) and rows[j][2] == source for j in k):
                skips += 1
                continue
            px, py, bar = gate(k, t, cfg.match_px)
            away, same = float(np.hypot(px - x, py - y)), color(k)
            flicker = len(k) < 2 and rows[k[-1]][2] == source and away <= cfg.flicker_px
            if t - rows[k[-1]][0] <= cfg.gap_s and away <= bar and ("unknown" in (same, c) or same == c or flicker):
                fits.append((away, n))
        if fits:
            away, n = min(fits)
            marks[i] = (away, t - rows[ids[n][-1]][0] > cfg.bridge_s, False)
            ids[n].append(i)
        else:
            marks[i] = (None, False, False)
            ids.append([i])

    def joinable():
        for a in sorted(ids, key=lambda k: rows[k[-1]][0]):
            for b in sorted(ids, key=lambda k: rows[k[0]][0]):
                gap = rows[b[0]][0] - rows[a[-1]][0]
                if a is b or not cfg.bucket_s <= gap <= cfg.stitch_gap_s or len({color(a), color(b)} - {"unknown"}) > 1:
                    continue
                px, py, bar = gate(a, rows[b[0]][0], cfg.stitch_px)
                away = float(np.hypot(px - rows[b[0]][3], py - rows[b[0]][4]))
                if away <= bar:
                    return a, b, away, gap > cfg.bridge_s
        return None
    while (pair := joinable()) is not None:
        a, b, away, bridged = pair
        marks[b[0]] = (away, bridged, True)
        a.extend(b)
        ids = [k for k in ids if k is not b]
    return ids, marks, skips


def crowd(seed, frames=70):
    """Balls that roll, stop, hide and flicker, read by two detectors."""
    rng = np.random.default_rng(seed)
    at, v, rows = rng.uniform(0, 260, (7, 2)), rng.normal(0, 60, (7, 2)), []
    hidden = np.zeros(7)
    for f in range(frames):
        at, v = at + v / 15, np.where(rng.random((7, 1)) < 0.05, rng.normal(0, 150, (7, 2)), v * 0.97)
        hidden = np.where(rng.random(7) < 0.06, rng.integers(1, 14, 7), hidden - 1)
        for k in np.flatnonzero(hidden <= 0):
            for source in ("plain", "scored")[: 1 + (rng.random() < 0.4)]:
                c = ("red", "blue", "red", "pink", "blue", "red", "pink")[k]
                c = "unknown" if rng.random() < 0.15 else "pink" if rng.random() < 0.06 else c
                x, y = at[k] + rng.normal(0, 4, 2)
                rows.append((round(f / 16, 6), c, source, float(x), float(y)))
    return rows


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_association_and_its_counters_equal_the_rule_over_lists(spark, seed):
    rows = crowd(seed)
    ids, marks, skips = naive_association(rows)
    linked = A.associate(sightings(spark, rows), SEC, 10 * SEC).cache()
    got = {r.event_id: r for r in linked.collect()}
    groups = {}
    for i, r in got.items():
        groups.setdefault(r.tid, set()).add(i)
    assert {frozenset(k) for k in ids} == {frozenset(g) for g in groups.values()}
    assert {i: (r.bridged, r.stitched) for i, r in got.items()} == {i: m[1:] for i, m in marks.items()}
    for i, (away, _, _) in marks.items():
        assert (away is None) == (got[i].residual_px is None) and (away is None or abs(away - got[i].residual_px) < 1e-6)
    frame, of = lambda i: round(rows[i][0] / 0.02), {i: n for n, k in enumerate(ids) for i in k}
    double = [frame(a) for a in range(len(rows)) for b in range(a + 1, len(rows))
              if frame(a) == frame(b) and of[a] != of[b] and np.hypot(rows[a][3] - rows[b][3], rows[a][4] - rows[b][4]) <= 12]
    kinks = []
    for k in ids:
        spots = [rows[i] for i in {frame(i): i for i in k}.values()]
        v = [((b[3] - a[3]) / (b[0] - a[0]), (b[4] - a[4]) / (b[0] - a[0])) for a, b in zip(spots, spots[1:])]
        kinks.append(sum(np.hypot(q[0] - p[0], q[1] - p[1]) > 200 for p, q in zip(v, v[1:])))
    plain = [m for m in marks.values() if not m[2]]
    want = {"dataset": 0, "assignments": len(rows), "bridged_links": sum(m[1] for m in plain), "wide_links": sum(m[0] is not None and m[0] > 30 for m in plain),
            "stitched_links": sum(m[2] for m in marks.values()), "frame_source_skips": skips, "tracks": len(ids), "kinked_tracks": sum(n > 0 for n in kinks), "kinks": sum(kinks),
            "double_claims": len(double), "frames_with_double_claims": len(set(double))}
    assert A.association_stats(linked, SEC).collect()[0].asDict() == want
    assert min(want["stitched_links"], want["bridged_links"], want["kinks"]) > 0
    linked.unpersist()


def claims(spark, rows):
    return spark.createDataFrame([(0, k, int(t * SEC), i, c, p, None if xy is None else float(xy[0]), None if xy is None else float(xy[1])) for i, (k, t, c, p, xy) in enumerate(rows)],
                                 "dataset long, kind string, us long, event_id long, color string, pocket string, mx double, my double")


def test_dedupe_is_first_fit(spark):
    got = {r.event_id: r["count"] for r in A.dedupe_claims(claims(spark, [
        ("pot", 0.0, "red", "head-left", None), ("pot", 1.5, "red", "head-left", None), ("pot", 3.0, "red", "head-left", None), ("pot", 3.1, "blue", "head-left", None), ("shot", 3.1, "blue", None, None), ("pot", 9.0, "red", "head-left", None)]), SEC, 4 * SEC).collect()}
    assert got == {0: 4, 4: 1, 5: 1}


def test_debounce_looks_at_the_last_kept_row_of_any_type(spark):
    rows = spark.createDataFrame([(0, t * SEC, i, k) for i, (t, k) in enumerate([(0, "a"), (3, "a"), (5, "a"), (6, "b"), (7, "a")])], "dataset long, us long, event_id long, kind string")
    assert [r.kept for r in A.debounce(rows, SEC).orderBy("event_id").collect()] == [True, False, True, True, True]


def test_frame_gate_follows_accepted_frames_only(spark):
    rows = [(0, 0, 10, 1000.0, 100.0, False), (0, 1, 10, 1000.0, 100.0, False), (0, 2, 10, 2000.0, 100.0, False), (0, 3, 10, 1010.0, 110.0, False), (0, 4, 5, 1000.0, 110.0, False), (0, 5, 10, 1000.0, 110.0, True)]
    df = spark.createDataFrame(rows, "dataset long, frame_no long, n long, cloth double, brightness double, person boolean")
    assert [r.reason for r in A.frame_gate(df).orderBy("frame_no").collect()] == ["warming_up", None, "cloth_area_out_of_band", "exposure_shift", "ball_census_off", "person_on_table"]


def test_leader_cluster_and_votes(spark):
    rows = [(0, 1, 7, [1.0, 0.0], -9.0), (0, 2, 7, [0.9, 0.1], -8.0), (0, 3, 8, [0.0, 1.0], -7.0), (0, 4, 8, [0.1, 1.0], -6.0), (0, 5, 7, [0.0, 1.0], -5.0)]
    df = spark.createDataFrame(rows, "burst long, vec_id long, tracklet long, vec array<double>, rank double")
    c = I.leader_cluster(df, ["burst"], ["rank", "vec_id"], 0.5)
    assert {r.vec_id: r.grp for r in c.collect()} == {1: 0, 2: 0, 3: 1, 4: 1, 5: 1}
    assert {r.tracklet: r.grp for r in I.track_groups(c, ["burst"]).collect()} == {7: 0, 8: 1}


def test_enrolment_outcomes(spark):
    def face(t, i, v, det=0.9):
        return (t, i, [float(x) for x in v], 20, det)
    rows = [face(1, 1, (1, 0)), face(2, 2, (1, 0)), face(2, 3, (0, 1)), face(3, 4, (1, 0)), face(3, 5, (1, 0.1)), face(3, 6, (1, 0.05)), face(4, 7, (1, 0), 0.1)]
    df = spark.createDataFrame(rows, "tracklet long, vec_id long, vec array<double>, eye_px long, det_score double")
    assert {r.tracklet: r.outcome for r in I.plan_enrollment(df).collect()} == {1: "single_face_only", 2: "inconsistent_faces", 3: "enrolled"}


def test_a_nan_similarity_never_matches(spark):
    nan = float("nan")
    g = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, [nan, 0.0])], "vec_id long, player long, vec array<double>")
    p = spark.createDataFrame([(9, [1.0, 0.0]), (8, [nan, 1.0])], "vec_id long, vec array<double>")
    got = {r.vec_id: (r.player, r.accepted) for r in I.match_gallery(p, g).collect()}
    assert got[9] == (1, True) and got[8][1] is False
    assert math.isnan(spark.range(1).select(P.cosine(F.array(F.lit(nan), F.lit(1.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("c")).first().c)


def test_replay_refuses_by_the_guards(spark):
    acts = [("complete", 0, 0), ("schedule", 0, 0), ("score", 5, 5), ("score", 5, 2), ("complete", 0, 0), ("schedule", 0, 0)]
    rows = [(1, i, i, 3, a, 0, x, y, 0, False) for i, (a, x, y) in enumerate(acts)]
    df = spark.createDataFrame(rows, "night long, event_id long, us long, match long, action string, table long, a long, b long, side long, flag boolean")
    got = L.replay(df).orderBy("event_id").collect()
    assert [r.refusal for r in got] == ["race-winning score required", "", "both cannot win", "", "", "not editable"]
    assert got[-1].status == "complete" and got[-1].winner == 0


def test_split_blocks_keeps_held_frames_away_from_training(spark):
    times = [i for i in range(0, 300)]
    df = spark.createDataFrame([(0, i, t * SEC) for i, t in enumerate(times)], "dataset long, event_id long, us long")
    got = {r.event_id: r.side for r in S.split_blocks(df, SEC).collect()}
    held = [t for t in times if got[t] == "held"]
    train = [t for t in times if got[t] == "train"]
    assert held and train and min(abs(a - b) for a in held for b in train) >= 5


def test_assignment_is_optimal_not_greedy():
    assert R.assign_min_cost([[1.0, 2.0], [2.0, 100.0]]) == {0: 1, 1: 0}
    rng = np.random.default_rng(0)
    from itertools import permutations
    for rows, cols in ((3, 5), (5, 3), (4, 4)):
        c = rng.random((rows, cols)).tolist()
        got = R.assign_min_cost(c)
        small, big = min(rows, cols), max(rows, cols)
        best = min(sum(c[i][j] if rows <= cols else c[j][i] for i, j in enumerate(p)) for p in permutations(range(big), small))
        assert len(got) == small and abs(sum(c[i][j] for i, j in got.items()) - best) < 1e-9


def tracker_rows():
    rows = []
    for f in range(8):
        rows.append((0, f, f * SEC, 2 * f, 300.0 + 20 * f, 600.0, "red", 1.0, False))
        if f not in (3, 4, 5, 6):
            rows.append((0, f, f * SEC, 2 * f + 1, 900.0, 1500.0, "blue", 1.0, False))
    return rows


TRACKER = "dataset long, frame_no long, us long, event_id long, x double, y double, color string, conf double, hidden boolean"


def test_slot_tracker_events(spark):
    df = spark.createDataFrame(tracker_rows(), TRACKER)
    got = [(r.frame_no, r.slot, r.kind) for r in R.slot_tracker(df, SEC).orderBy("frame_no", "slot").collect()]
    assert got == [(0, 1, "seeded"), (0, 2, "seeded"), (4, 2, "lost"), (7, 2, "reacquired")]


def shuffled_files(df, folder, parts=6):
    """One row order, many files, none of them in order of time."""
    df.repartition(parts).write.parquet(str(folder))


def live_of(spark, df, folder, **last):
    ending = R.Ending(spark, df.schema, **last)
    return ending.after(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))), ending


def test_slot_tracker_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(tracker_rows(), TRACKER)
    shuffled_files(df, tmp_path / "in")
    stream, ending = live_of(spark, df, tmp_path / "in", dataset=0, frame_no=10**9, us=10**9 * SEC)
    live = R.drain(R.slot_tracker(stream, SEC), ending=ending)
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, R.slot_tracker(df, SEC).collect()))


@pytest.mark.parametrize("rule", ["latency", "audit", "board", "identities"])
def test_keyed_rules_stream_equals_batch(spark, tmp_path, rule):
    rows = [(i % 3, i, i * SEC, float(i * 7 % 11), int(i % 4 == 0), str(i // 5 % 2), i % 7, [float(i % 5), 1.0], i % 4, 0.1 * (i % 9), 0.05 * (i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "key long, event_id long, us long, value double, behind long, digest string, track long, vec array<double>, player long, sim double, runner_up double")
    shuffled_files(df, tmp_path / "in")
    def apply(d):
        if rule == "latency":
            return R.latency_summary(d, "key", "value", ["us", "event_id"], 7)
        if rule == "audit":
            return R.append_audit(d, "key", ["us", "event_id"])
        if rule == "identities":
            return R.register_identities(d, "key", bar=0.97, margin=0.0)
        return R.board_changes(d, "key", ["us", "event_id"], 2 * SEC)
    stream, ending = live_of(spark, df, tmp_path / "in", key=0, us=10**9 * SEC, **({"event_id": 10**9} if rule == "identities" else {}))
    live = R.drain(apply(stream), ending=ending)
    assert sorted(map(str, live.collect())) == sorted(map(str, apply(df).collect()))


def test_keys_that_ended_are_forgotten(spark, tmp_path):
    rows = [(0, i, i * SEC, 1.0) for i in range(20)] + [(1, 100 + i, (100_000 + i) * SEC, 2.0) for i in range(20)]
    df = spark.createDataFrame(rows, "key long, event_id long, us long, value double")
    for part in (df.filter("key = 0"), df.filter("key = 1")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream, ending = live_of(spark, df, tmp_path / "in", key=1, us=10**9 * SEC)
    totals = []
    out = R.drain(R.latency_summary(stream, "key", "value", ["us", "event_id"], 7, delay="10 seconds", idle_us=3600 * SEC), ending=ending, progress=totals)
    assert out.count() == 40
    assert max(totals) > 0 and totals[-1] == 0


def test_a_repeated_post_counts_once_within_its_time(spark):
    rows = [(0, 5, 0, 0), (0, 6, SEC, 0), (0, 5, 2 * SEC, 0), (0, 5, 100 * SEC, 0), (0, 7, 101 * SEC, 1)]
    df = spark.createDataFrame(rows, "key long, event_id long, us long, behind long")
    got = [(r.event_id, r.revision, r.refusal) for r in R.append_audit(df, "key", ["us", "event_id"], repeat_us=50 * SEC).collect()]
    assert got == [(5, 1, None), (6, 2, None), (5, 3, None), (7, None, "stale revision")]


def test_identities_merge_at_a_finite_bar(spark):
    rows = [(1, 0, [1.0, 0.0], 0, None, None, None), (1, 1, [0.0, 1.0], 1, None, None, None), (1, 2, [0.99, 0.05], 2, 7, 0.6, 0.1), (1, 3, [0.7, 0.7], 3, 8, 0.9, 0.1), (1, 0, [1.0, 0.1], 4, 9, 0.9, 0.1)]
    df = spark.createDataFrame(rows, "key long, track long, vec array<double>, event_id long, player long, sim double, runner_up double")
    got = [(r.event_id, r.cluster, r.player, r.bound_now) for r in R.register_identities(df, "key", bar=0.9, margin=0.05).orderBy("event_id").collect()]
    assert got == [(0, 1, None, False), (1, 2, None, False), (2, 1, 7, True), (3, 3, 8, True), (4, 1, 7, False)]


def test_sessions_close_with_the_source(spark, tmp_path):
    rows = [("a", t, 0.5) for t in (0, 600, 10_000)] + [("b", 9_900, 0.1)]
    df = spark.createDataFrame(rows, "color string, s long, score double").select("color", F.timestamp_seconds(F.col("s") + 86_400).alias("ts"), "score")
    shuffled_files(df, tmp_path / "in", 4)
    from datetime import datetime
    stream, ending = live_of(spark, df, tmp_path / "in", ts=datetime(2200, 1, 1))
    live = R.drain(R.activity_sessions(stream, ["color"], "30 minutes", delay="5 hours"), ending=ending)
    assert sorted((r.color, r.n) for r in live.collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_stages_are_absent_not_stale(spark):
    df = spark.range(4).withColumnRenamed("id", "seq")
    out = U.run_stages(df, [U.Stage("a", lambda d: F.col("seq") * 10), U.Stage("b", lambda d: F.col("seq"), lambda d: F.lit(9.0), every=2, budget_ms=5.0)]).orderBy("seq").collect()
    assert [r.b for r in out] == [0, None, 2, None] and [r.overrun for r in out] == ["b", None, "b", None] and out[1].ran == ["a"]
    with pytest.raises(ValueError):
        U.StageRegistry().add(U.Stage("a", lambda d: F.lit(1))).add(U.Stage("a", lambda d: F.lit(1)))


def test_search_fold_handles_unicode(spark):
    df = spark.createDataFrame([("  José  O’Neil-№5 ",), ("ＡＢＣ  x_y",), (None,)], "n string")
    assert [r.f for r in df.select(P.search_fold(F.col("n")).alias("f")).collect()] == ["jose o neil no5", "abc x y", None]


def test_dense_shot_needs_rest_then_travel(spark):
    pts = [(k * 0.1, 100.0) for k in range(8)] + [(0.8 + k * 0.1, 100.0 + 30 * k) for k in range(1, 6)]
    df = spark.createDataFrame([(0, 1, int(t * SEC), i, x, 50.0) for i, (t, x) in enumerate(pts)], "dataset long, track_id long, us long, event_id long, x double, y double")
    got = A.dense_shots(df, SEC, 10 * SEC).collect()
    assert [(r.outcome, r.intervals) for r in got] == [("shot", 5)]


def test_fragments_split_at_holes(spark):
    df = spark.createDataFrame([(0, 1, t * SEC, i, "red", 1.0 * t, 0.0) for i, t in enumerate([0, 1, 2, 9, 10])], "dataset long, track_id long, us long, event_id long, color string, x double, y double")
    assert sorted(r.hits for r in E.fragments(df, 3 * SEC, 4 * SEC).collect()) == [2, 3]


def test_iou_tracklets_burst_and_grace(spark):
    rows = [(0, 1, 0, 1, 0.0, 0.0, 10.0, 10.0), (0, 1, 1, 2, 1.0, 0.0, 11.0, 10.0), (0, 1, 1, 3, 50.0, 50.0, 60.0, 60.0), (0, 1, 9, 4, 1.0, 0.0, 11.0, 10.0)]
    df = spark.createDataFrame(rows, "dataset long, burst long, frame_no long, event_id long, x double, y double, x2 double, y2 double")
    def got(mode):
        return [r.tracklet for r in A.iou_tracklets(df, ["dataset", "burst"], ["frame_no", "event_id"], mode=mode).orderBy("event_id").collect()]
    assert got("burst") == [1, 1, 2, 1] and got("grace") == [1, 1, 2, 3]


def test_dense_pots_in_order(spark):
    rows = []
    for track, status in ((1, "inside"), (2, "outside"), (3, "ambiguous"), (4, "inside"), (5, "inside")):
        for k in range(5):
            t = k * 0.1 + (3.0 if track == 4 and k == 4 else 0.0)
            rows.append((0, track, int(t * SEC), 10 * track + k, 100.0 + (2.0 * k if track != 5 else 0.0), 50.0, status))
    df = spark.createDataFrame(rows, "dataset long, track_id long, us long, event_id long, x double, y double, v string")
    until = spark.createDataFrame([(0, 20 * SEC)], "dataset long, until_us long")
    m = F.struct(F.lit("head-left").alias("pocket"), F.col("v").alias("verdict"))
    out = A.dense_pots(df, m, until, F.lit("clear"), SEC, 10 * SEC, F.lit(True), F.lit(True)).orderBy("track_id", "us").collect()
    assert [(r.track_id, r.status, r.reason) for r in out] == [
        (1, "pot", "inside_pocket_persistence_clear"), (2, "rejected", "disappeared_outside_pocket"), (3, "unknown", "pocket_distance_within_uncertainty"),
        (4, "unknown", "reappeared_after_gap_inside_pocket"), (4, "unknown", "at_rest_inside_pocket_radius"), (5, "unknown", "at_rest_inside_pocket_radius")]


def test_deep_brackets_climb_to_a_single_champion(spark):
    entrants = spark.range(600).select(F.lit(1).cast("long").alias("tournament"), F.col("id").alias("entrant"), F.col("id").alias("position"))
    bracket = L.build_brackets(entrants)
    results = bracket.select("tournament", "round", "slot", F.lit(0).alias("winner_side"), F.lit("played").alias("result"))
    done = L.propagate(bracket, results, entrants.limit(0))
    assert done.count() == bracket.count() == 1023 and done.agg(F.max("round")).first()[0] == 10
    assert L.tournament_status(done).first().complete


def test_open_sessions_survive_files_out_of_order(spark, tmp_path):
    rows = [("a", t, 0.5) for t in (0, 600, 10_000)] + [("b", 9_900, 0.1)]
    df = spark.createDataFrame(rows, "color string, s long, score double").select("color", F.timestamp_seconds("s").alias("ts"), "score")
    for part in (df.filter("color = 'b' or score > 0.4 and unix_seconds(ts) > 5000"), df.filter("color = 'a' and unix_seconds(ts) < 5000")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live = R.drain(R.activity_sessions(stream, ["color"], "30 minutes"), "complete")
    assert sorted((r.color, r.n) for r in live.collect()) == sorted((r.color, r.n) for r in R.activity_sessions(df, ["color"], "30 minutes").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_tracker_knows_unknown_colours_and_local_occluders():
    t = R.SlotTracker(shade=50.0)
    t.observe(0.0, [(300.0, 600.0, "red", 1.0), (900.0, 1500.0, "blue", 1.0)], [])
    assert t.observe(1.0, [(305.0, 600.0, "unknown", 1.0), (905.0, 1500.0, "blue", 1.0)], []) == [] and t.color == ["red", "blue"]
    said = t.observe(4.0, [(305.0 + 15, 600.0, "red", 1.0), (40.0, 2000.0, "pink", 1.0)], [(920.0, 1500.0)])
    assert [(s, k) for s, k, _, _ in said] == [(2, "occluded"), (0, "unmatched")]


def test_an_id_posted_again_is_ignored_however_late(spark):
    df = spark.createDataFrame([(1, e, i, 0) for i, e in enumerate((5, 6, 5, 7, 6))], "key long, event_id long, us long, behind long")
    assert sorted((r.event_id, r.revision) for r in R.append_audit(df, "key", ["us", "event_id"]).collect()) == [(5, 1), (6, 2), (7, 3)]


def test_a_held_board_change_is_not_lost(spark):
    df = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 5, "b"), (1, 2, 20, "b"), (1, 3, 60, "b")], "key long, event_id long, us long, digest string")
    assert [(r.event_id, r.digest) for r in R.board_changes(df, "key", ["us", "event_id"], 10).orderBy("event_id").collect()] == [(0, "a"), (1, "b")]


def test_first_difference_past_a_million_items_and_dotted_names(spark):
    same = "[" + "0," * 999_999
    rows = [(1, same + "1,1]", same + "2,2]"), (2, '{"a":{"b":1},"a.b":1}', '{"a":{"b":2},"a.b":1}'), (3, '{"a":[1]}', '{"a":[1]}')]
    a, b = (spark.createDataFrame([(r[0], r[k]) for r in rows], "id long, doc string") for k in (1, 2))
    got = {r.id: (r.path, r.why, r.differences) for r in V.first_difference(a, b).collect()}
    assert got == {1: ("$[999999]", "value", 2), 2: ("$.a.b", "value", 1)}


@pytest.mark.parametrize("shape", ["random", "falling", "ties"])
def test_long_chains_of_peaks_equal_the_walk(spark, shape):
    rng = random.Random(5)
    n, gap = 30_000, 10
    peaks = [(0, i * 6, i * 6, {"random": rng.random(), "falling": -float(i), "ties": 1.0}[shape], 1) for i in range(n)]
    df = spark.createDataFrame(peaks, "dataset long, onset_us long, peak_us long, peak double, n_frames long")
    got = sorted(r.peak_us for r in SG.enforce_gap(df, ["dataset"], gap, 5000).collect())
    kept = set()
    for _, onset, at, _, _ in sorted(peaks, key=lambda p: (-p[3], p[1])):
        if not any(at + 6 * k in kept for k in (-1, 1)):
            kept.add(at)
    assert got == sorted(kept)


def test_weaker_candidates_go_to_the_strongest_that_stays(spark):
    rng = random.Random(6)
    rows = [(i % 2, "shot", rng.randrange(4000) * SEC // 10, i, rng.choice([None, rng.random() * 900]), rng.random() * 900, float(rng.randrange(40))) for i in range(1500)]
    df = spark.createDataFrame(rows, "dataset long, kind string, us long, event_id long, mx double, my double, strength double")
    got = {r.event_id: r.duplicates for r in A.prune_candidates(df, SEC, 60 * SEC).collect()}
    kept, want = [], {}
    for d, _, us, i, mx, my, s in sorted(rows, key=lambda r: (-r[6], r[2], r[3])):
        same = next((k for k in kept if k[0] == d and abs(k[1] - us) <= 4 * SEC and (k[3] is None or mx is None or ((k[3] - mx) ** 2 + (k[4] - my) ** 2) ** 0.5 <= 250)), None)
        if same is None:
            kept.append((d, us, i, mx, my))
        want[(same or kept[-1])[2]] = want.get((same or kept[-1])[2], 0) + 1
    assert got == want


def faces_around(rng, n, people, spread, dim=16):
    base = rng.normal(0, 1, (people, dim))
    who = rng.integers(0, people, n)
    return who, base[who] + rng.normal(0, spread, (n, dim))


@pytest.mark.parametrize("spread", [0.02, 1.5])
def test_gallery_match_skips_block_pairs_and_stays_exact(spark, monkeypatch, spread):
    from trackspark.functions import vectors as V
    from trackspark.operators import identity as I

    monkeypatch.setattr(V.metric_blocks, "__defaults__", (4,))
    monkeypatch.setattr(V.block_bounds, "__defaults__", (5,))
    rng = np.random.default_rng(8)
    gw, gv = faces_around(rng, 400, 24, spread)
    pw, pv = gw[:120], gv[:120] + rng.normal(0, spread, (120, 16))
    pv[3], pv[5, 2], gv[7], gv[9, 1] = 0.0, np.nan, 0.0, np.nan
    gallery = spark.createDataFrame([(i, int(w), [float(x) for x in v]) for i, (w, v) in enumerate(zip(gw, gv))] + [(900, 5, None)], "vec_id long, player long, vec array<double>")
    probes = spark.createDataFrame([(1000 + i, int(w), [float(x) for x in v]) for i, (w, v) in enumerate(zip(pw, pv))] + [(2000, 1, None)], "vec_id long, expected long, vec array<double>")

    def unit(m):
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return m / np.where(norm == 0, 1, norm)
    sims = unit(pv) @ unit(gv).T
    best = np.array([[np.where(np.isnan(s[gw == k]), -np.inf, s[gw == k]).max() for k in range(24)] for s in sims])
    got = {r.vec_id: r for r in I.match_gallery(probes, gallery, keep=["expected"]).collect()}
    assert len(got) == 121 and got[2000].player is None
    for i, row in enumerate(best):
        order = np.argsort(-row, kind="stable")
        r = got[1000 + i]
        assert np.isclose(r.similarity, row[order[0]]) and np.isclose(r.runner_up, row[order[1]])
        assert r.player == order[0] or np.isclose(row[r.player], row[order[0]])
    counts = {r.player: r for r in I.bind_counts(probes.filter("vec is not null"), gallery, 0.9).collect()}
    for k, r in counts.items():
        assert r.own_bound == int((best[pw == k, k] >= 0.9).sum()) and r.other_clearing == int((best[pw != k, k] >= 0.9).sum())
    left, right = V.metric_blocks(probes, ["vec_id"], "l_"), V.metric_blocks(gallery, ["vec_id", "player"], "r_")
    bounds = V.block_bounds(left, right)
    assert bounds.count() == left.count() * right.count() and left.agg(F.max("l_n")).first()[0] <= 120
    of_l = {i: r.l_block for r in left.collect() for i in r.l_vec_id}
    of_r = {i: r.r_block for r in right.collect() for i in r.r_vec_id}
    assert len(of_l) == 120 and len(of_r) == 400
    bound = {(r.l_block, r.r_block): r.bound for r in bounds.collect()}
    assert all(np.isnan(sims[i, j]) or sims[i, j] <= bound[of_l[1000 + i], of_r[j]] for i in range(120) for j in range(400))
    clear = sum(b < 0.9 for b in bound.values()) / len(bound)
    assert clear > 0.5 or spread > 1

    def top(sims, a, b):
        return {"vec_id": np.repeat(a["vec_id"], sims.shape[1]), "player": np.tile(b["player"], len(sims)), "sim": sims.ravel()}
    seeds, rest, _ = I.gallery_pairs(left.filter(F.col("l_radius") < 9), right.filter(F.col("r_radius") < 9), top)
    best_two = seeds.count() + rest.count()
    assert best_two < len(bound) * 0.5 or spread > 1


def test_gallery_match_of_nothing(spark):
    from trackspark.operators import identity as I

    gallery = spark.createDataFrame([(1, 2, [1.0, 0.0])], "vec_id long, player long, vec array<double>")
    probes = spark.createDataFrame([(5, 2, [1.0, 0.0])], "vec_id long, expected long, vec array<double>")
    assert I.match_gallery(probes.limit(0), gallery).count() == 0
    alone = I.match_gallery(probes, gallery.limit(0)).collect()
    assert len(alone) == 1 and alone[0].player is None
    one = I.match_gallery(probes, gallery).collect()[0]
    assert (one.player, one.similarity, one.runner_up, one.accepted) == (2, 1.0, None, True)
