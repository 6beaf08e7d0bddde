"""Fourth review: state by pieces of rows (F2, F3), cells of blocks (F4), probe groups without a broadcast (F1)."""

import numpy as np
import pandas as pd
import pytest

from trackspark.functions import vectors as V
from trackspark.llm import topk
from trackspark.operators import identity as I
from trackspark.streaming import live as R

HOUR = R.HOUR_US


class Store(dict):
    writes = 0
    getValue, removeKey = dict.__getitem__, dict.__delitem__

    def updateValue(self, k, v):
        self[k], self.writes = v, self.writes + 1


class Value:
    now = None
    exists, get = lambda self: self.now is not None, lambda self: self.now

    def update(self, v):
        self.now = v

    def clear(self):
        self.now = None


class Handle:
    def __init__(self):
        self.timers = []
        self.registerTimer = self.timers.append

    getMapState, getValueState = lambda self, *a: Store(), lambda self, *a: Value()


class Clock:
    def __init__(self, us):
        self.getCurrentWatermarkInMs = lambda: us // 1000


def rule_of(order, step=None, make=dict):
    rule = R.OrderedRule(order, make, step or (lambda state, rows: rows.copy()), "event_id", None)
    rule.init(Handle())
    return rule


def rows_at(us, ids):
    return pd.DataFrame({"us": us, "event_id": ids, "at_us": us, "at_time": us})


def test_a_key_of_few_rows_is_one_piece_however_many_hours_it_spans():
    """60 rows in 60 hours were 60 pieces of state."""
    rule, us = rule_of(["us", "event_id"]), np.arange(60, 0, -1) * HOUR
    assert not list(rule.handleInputRows(("k",), iter([rows_at(us, np.arange(60))]), Clock(0)))
    assert rule.waiting.writes == 1 and rule.handle.timers == [HOUR // 1000 + 1]
    out = pd.concat(rule.handleExpiredTimer(("k",), Clock(40 * HOUR), None))
    assert out["us"].tolist() == [i * HOUR for i in range(1, 41)]
    assert rule.waiting.writes == 2 and min(first for first, _ in rule.waiting) == 41 * HOUR
    out = pd.concat(rule.handleExpiredTimer(("k",), Clock(100 * HOUR), None))
    assert out["us"].tolist() == [i * HOUR for i in range(41, 61)] and not rule.waiting


def test_rows_leave_in_order_and_equal_ones_as_they_came_however_they_are_cut(monkeypatch):
    """batches out of order, ties, rows without a time and closing rows against one stable sort."""
    monkeypatch.setattr(R.OrderedRule, "CHUNK", 40)
    monkeypatch.setattr(R.OrderedRule, "PIECE", 7)
    monkeypatch.setattr(R.OrderedRule, "STEP", 5)
    rng = np.random.default_rng(5)
    for _ in range(20):
        rule, out, came, n, now = rule_of(["us"]), [], [], 0, 0
        for _ in range(8):
            us = now + rng.integers(0, 12, 30) * (HOUR // 3)
            part = rows_at(us.astype(object if rng.random() < 0.2 else "int64"), np.arange(n, n + 30))
            odd = pd.DataFrame({"us": [None, 5.0], "event_id": [-1, None], "at_us": [None, 5.0], "at_time": [None, 5.0]})
            n += 30
            came.append(part)
            out += rule.handleInputRows(("k",), iter([part.iloc[:11], odd, part.iloc[11:]]), Clock(now))
            now += int(rng.integers(0, 3)) * HOUR
            out += rule.handleExpiredTimer(("k",), Clock(now), None)
        out += rule.handleExpiredTimer(("k",), Clock(10**15), None)
        got, all_rows = pd.concat(out), pd.concat(came)
        late = all_rows.sort_values("us", kind="stable")
        assert sorted(got["event_id"]) == list(range(n)) and not rule.waiting
        # a row older than what has left cannot be put before it: order holds for the rows a watermark lets through
        seen = [x["us"].astype("int64").is_monotonic_increasing for x in out]
        assert all(seen)
        if got["us"].astype("int64").is_monotonic_increasing:
            assert got["event_id"].tolist() == late["event_id"].tolist()


def test_rows_of_one_time_reach_the_rule_together(monkeypatch):
    """a frame's rows are one step, also where they are more than a step holds."""
    monkeypatch.setattr(R.OrderedRule, "STEP", 4)
    seen = []
    rule = rule_of(["us", "event_id"], lambda state, rows: seen.append(rows["us"].tolist()) or rows)
    us = np.repeat([3, 1, 2], [3, 9, 3]) * HOUR
    list(rule.handleInputRows(("k",), iter([rows_at(us, np.arange(15))]), Clock(10**15)))
    assert seen == [[HOUR] * 9, [2 * HOUR] * 3, [3 * HOUR] * 3]


def test_board_changes_of_a_night_take_a_few_pieces_of_state(monkeypatch):
    """F2: 600 rows of a night over a month, in three micro-batches, were some 600 pieces; changes equal one fold over all rows."""
    taken = {}
    monkeypatch.setattr(R, "keyed", lambda df, key, order, make, step, schema, **more: taken.update(order=order, make=make, step=step))

    class Boards:
        def select(self, *names):
            return self

    R.board_changes(Boards(), "night", ["us", "event_id"], 3 * HOUR)
    rng = np.random.default_rng(11)
    us = rng.permutation(720)[:600] * HOUR
    rows = rows_at(us, np.arange(600)).assign(night=4, digest=rng.choice(["a", "b", "c"], 600))
    rule, out = rule_of(taken["order"], taken["step"], taken["make"]), []
    for k in range(3):
        out += rule.handleInputRows((4,), iter([rows.iloc[k::3]]), Clock(-1))
    assert not out and rule.waiting.writes == 3
    out += rule.handleExpiredTimer((4,), Clock(700 * HOUR), None)
    out += rule.handleExpiredTimer((4,), Clock(10**15), None)
    whole = taken["step"](taken["make"](), rows.sort_values(["us", "event_id"]))
    assert pd.concat(out)[["event_id", "digest"]].values.tolist() == whole[["event_id", "digest"]].values.tolist() and len(whole) > 50
    assert rule.waiting.writes == 4 and not rule.waiting


def test_probe_groups_meet_shards_by_shuffle(spark, monkeypatch):
    """small files whose rows are repeated for every cell were broadcast, whole through the driver."""
    monkeypatch.setattr(topk, "SHARD", 8)
    monkeypatch.setattr(topk, "PROBES", 4)
    x = np.random.default_rng(2).integers(-9, 9, (60, 5))
    gallery = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, embedding array<long>")
    found = topk.search(gallery, gallery.filter("id % 5 = 0"), 3)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().sparkPlan().toString()
    want = {(q, r + 1, i) for q in range(0, 60, 5) for r, i in enumerate(sorted((i for i in range(60) if i != q), key=lambda i: (-int(x[q] @ x[i]), i))[:3])}
    assert {(r.query_id, r["rank"], r.id) for r in found.collect()} == want


def test_pooled_keys_are_handed_over_by_the_hour():
    """where Spark pools keys (a batch with a null key), steps are hours, as they were."""
    seen = []
    rule = R.OrderedRule(["us", "event_id"], dict, lambda state, rows: seen.append(rows["event_id"].tolist()) or rows, "event_id", None, "doc")
    rule.init(Handle())
    rows = rows_at(np.array([0, 5, HOUR, HOUR + 1, 3 * HOUR]), np.arange(5)).assign(doc=[1.0, np.nan, 2.0, 2.0, 1.0])
    list(rule.handleInputRows(("k",), iter([rows]), Clock(10**15)))
    assert seen == [[0, 1], [2, 3], [4]]


@pytest.mark.parametrize("cell, held", [(600, 1), (1 << 25, 1 << 18)])
def test_bind_counts_join_no_block_pairs(spark, monkeypatch, cell, held):
    """a pair of blocks was a shuffled row with both; counts equal brute force however blocks are dealt."""
    monkeypatch.setattr(V.metric_blocks, "__defaults__", (6,))
    monkeypatch.setattr(V, "CELL_BYTES", cell, raising=False)
    monkeypatch.setattr(V, "HELD", held, raising=False)
    rng = np.random.default_rng(4)
    gw, pw = rng.integers(0, 7, 60), rng.integers(0, 9, 90)
    gv, pv = rng.normal(0, 1, (60, 4)) + gw[:, None] % 3, rng.normal(0, 1, (90, 4)) + pw[:, None] % 3
    pv[3], pv[5, 2], gv[7], gv[9, 1] = 0.0, np.nan, 0.0, np.nan
    player, expected = [None if i % 10 == 2 else int(w) for i, w in enumerate(gw)], [None if i % 10 == 4 else int(w) for i, w in enumerate(pw)]
    gallery = spark.createDataFrame([(i, w, v) for i, (w, v) in enumerate(zip(player, gv.tolist()))] + [(900, 5, None)], "vec_id long, player long, vec array<double>")
    asked = [(100 + i, w, v) for i, (w, v) in enumerate(zip(expected, pv.tolist()))]
    probes = spark.createDataFrame(asked + asked[:8] + [(2000, 1, None)], "vec_id long, expected long, vec array<double>")

    def unit(m):
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return m / np.where(norm == 0, 1, norm)
    near = unit(pv) @ unit(gv).T >= 0.8
    of = lambda p: [i for i, w in enumerate(player) if w == p and p is not None]
    all_n, want = len(asked) + 9, {}
    for p in {*player, 5}:
        clears = [i for i in range(90) if near[i, of(p)].any()]
        own_n = sum(expected[i] == p for i in [*range(90), *range(8)]) + (p == 1) if p is not None else 0
        want[p] = (own_n, sum(expected[i] == p for i in clears), all_n - own_n, sum(expected[i] not in (p, None) for i in clears))
    found = I.bind_counts(probes, gallery, 0.8)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "_block" in line]
    assert {r.player: tuple(r)[1:] for r in found.collect()} == want
    assert I.bind_counts(probes.limit(0), gallery, 0.8).count() == 7 + 1
    assert I.bind_counts(probes, gallery.limit(0), 0.8).count() == 0
