"""Live operators: each is one definition for batch and stream, plus keyed state where a rule needs it.

Stateful rules run through ``keyed``: the same ``step(state, rows)`` is a sorted fold in
batch and, in a stream, runs over rows that a stateful processor holds back until the watermark
has passed them; so it sees them in order however files and micro-batches are cut.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions.scalars import UNKNOWN
from ..operators.kernels import stream_fold
from ..session import checkpoint_dir, ship_package

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedRule(StatefulProcessor):
    """A sequential rule over rows in order of event time, whatever micro-batch brought them.

    ``waiting`` holds rows in pieces of whole hours of event time, as many as give ``PIECE`` rows or one, so a key of few
    rows is one piece.  A piece is named by its first time and its last arrival, so names alone tell what is due; a timer at
    the first waiting row wakes the key once the watermark has passed it.  Pieces are then taken in order of their
    first times, and rows before the next piece's first hour go through ``step`` sorted, ``STEP`` rows at a time: a key of any
    size takes the memory of ``CHUNK`` rows, or of one piece of each chunk that came.  ``held`` is the
    rule's own small state.  A key whose last row lies ``idle_us`` behind the watermark is forgotten.
    """

    CHUNK, PIECE, STEP = 50_000, 1_000, 2_000

    def __init__(self, order: list[str], make, step, real: str, idle_us: int | None, key: str | None = None):
        self.order, self.make, self.step, self.real, self.idle_us, self.key = order, make, step, real, idle_us, key

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "first long, number long", "rows binary")
        self.held = handle.getValueState("held", "state binary, last long")

    def handleInputRows(self, key, rows, timerValues):
        some, size, names = [], 0, None
        for part in rows:
            part = part[part[self.real].notna() & part["at_us"].notna()]  # a closing row only moves the watermark
            if len(part):
                names = self._names() if names is None else names
                some.append(part.drop(columns="at_time"))
                size += len(part)
            if size >= self.CHUNK:
                self._take(some, names)
                some, size = [], 0
        if some:
            self._take(some, names)
        if names is not None:
            yield from self._release(timerValues, names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._release(timerValues, self._names())

    def close(self) -> None:
        pass

    def _names(self) -> list[tuple[int, int]]:
        return [(int(first), int(number)) for first, number in self.waiting.keys()]

    def _take(self, some, names):
        """Put new rows away, numbered as they came."""
        rows = some[0] if len(some) == 1 else pd.concat(some, ignore_index=True)
        begin = 1 + max((number for _, number in names), default=-1)
        self._wait(rows.assign(_no=np.arange(begin, begin + len(rows))), names)

    def _wait(self, rows, names):
        """Put numbered rows away in pieces; ``names`` gets theirs."""
        rows = rows.take(np.argsort(rows["at_us"].to_numpy(), kind="stable"))
        at, cuts = rows["at_us"].to_numpy(), [0]
        if len(rows) > self.PIECE:
            hours = at // HOUR_US
            for begin, end in zip(starts := [0, *(np.flatnonzero(hours[1:] != hours[:-1]) + 1).tolist()], [*starts[1:], len(rows)]):
                if begin > cuts[-1] and end - cuts[-1] > self.PIECE:
                    cuts.append(begin)
        for begin, end in zip(cuts, [*cuts[1:], len(rows)]):
            piece = rows.iloc[begin:end]
            names.append((int(at[begin]), int(piece["_no"].max())))
            self.waiting.updateValue(names[-1], (pickle.dumps(piece),))

    def _ordered(self, rows):
        """Rows sorted, equal ones as they came."""
        by = [*self.order, "_no"]
        if any(rows[c].dtype == object for c in by):
            return rows.sort_values(by)
        return rows.take(np.lexsort([rows[c].to_numpy() for c in reversed(by)]))

    def _steps(self, rows):
        """Sorted rows, ``STEP`` at a time; rows of one time stay together.

        Spark pools the keys of an Arrow batch that holds a null key; such rows are handed over hour by hour.
        """
        at, begin = rows["at_us"].to_numpy(), 0
        if self.key is not None and len(at) and (rows[self.key].to_numpy() != rows[self.key].iloc[0]).any():
            for _, part in rows.groupby(at // HOUR_US, sort=True):
                yield part
            return
        while begin < len(at):
            end = min(begin + self.STEP, len(at))
            if end < len(at):
                end = int(np.searchsorted(at, at[end], "left"))
                end = end if end > begin else int(np.searchsorted(at, at[begin], "right"))
            yield rows.iloc[begin:end]
            begin = end

    def _release(self, timers, names):
        passed = timers.getCurrentWatermarkInMs() * 1000
        due, after = sorted(n for n in names if n[0] <= passed), [n for n in names if n[0] > passed]
        some, size, full, state, last = [], 0, self.STEP, None, None
        for name, then in zip(due, [*(first - first % HOUR_US for first, _ in due[1:]), None]):
            some.append(pickle.loads(bytes(self.waiting.getValue(name)[0])))
            self.waiting.removeKey(name)
            size += len(some[-1])
            if size < full and then is not None:
                continue
            rows = some[0] if len(some) == 1 else pd.concat(some, ignore_index=True)
            ready = (rows["at_us"] < then if then is not None else rows["at_us"] <= passed).to_numpy()
            some, size = [rows[~ready]], int((~ready).sum())
            full = max(self.STEP, 2 * size)
            for part in self._steps(self._ordered(rows[ready])):
                if state is None:
                    held = self.held.get()
                    state = pickle.loads(bytes(held[0])) if held else self.make()
                out, last = self.step(state, part.drop(columns=["at_us", "_no"])), int(part["at_us"].max())
                if len(out):
                    yield out
        if size:
            self._wait(some[0], after)
        if last is not None:
            self.held.update((pickle.dumps(state), last))
        if after:
            self.handle.registerTimer(min(after)[0] // 1000 + 1)
        elif self.idle_us is not None and self.held.exists():
            forget = self.held.get()[1] + self.idle_us
            if forget <= passed:
                self.held.clear()
            else:
                self.handle.registerTimer(forget // 1000 + 1)


def keyed(df: DataFrame, key: str, order: Sequence[str], make, step, schema: str, *, at: Column | None = None, delay: str = "1 hour", idle_us: int | None = None, real: str = "event_id") -> DataFrame:
    """Run a sequential rule per key, in batch or in a stream.

    ``order`` sorts the rows of a key and must agree with ``at``, their event time in microseconds (by
    default the first order column).  A stream waits ``delay`` for rows out of order; rows later still are dropped.
    Rows without ``real`` are closing rows (``Ending``).
    """
    if not df.isStreaming:
        return stream_fold(df, [key], list(order), make, step, schema)

    ship_package(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = df.withColumn("at_us", (at if at is not None else F.col(order[0])) + DAY_US)  # a watermark starts at 0 and takes what is not above it for late
    timed = timed.withColumn("at_time", F.timestamp_micros("at_us")).withWatermark("at_time", delay)
    return timed.groupBy(key).transformWithStateInPandas(OrderedRule(list(order), make, step, real, idle_us, key), schema, "Append", "EventTime")


class Ending:
    """The end of a bounded source, said inside the stream: one closing row far in the future moves the watermark past all rows.

    The closing row comes from a folder of its own, which is empty until ``say``; ``last`` names the columns it fills.
    """

    def __init__(self, spark: SparkSession, schema, **last):
        self.spark, self.schema, self.last = spark, schema, last
        self.folder = f"{checkpoint_dir(spark)}/streams/end-{uuid.uuid4().hex}"
        spark.createDataFrame([], schema).write.parquet(self.folder)

    def after(self, stream: DataFrame) -> DataFrame:
        return stream.unionByName(self.spark.readStream.schema(self.schema).parquet(self.folder))

    def say(self) -> None:
        row = tuple(self.last.get(f.name) for f in self.schema)
        self.spark.createDataFrame([row], self.schema).write.mode("append").parquet(self.folder)


def drain(df: DataFrame, mode: str = "append", ending: Ending | None = None, progress: list[int] | None = None) -> DataFrame:
    """Run a stream over the data available now and return what it wrote.

    With ``ending`` the stream is then told that its source is over and run on from its
    checkpoint, so rows held back and open sessions come out.  The sink and its checkpoint live in the shared folder, so a lost
    executor or a restart resumes from the committed offsets; rewriting a batch replaces its own folder only.
    ``progress`` takes the number of state rows after each micro-batch.
    """
    spark = df.sparkSession
    root = f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"

    def sink(batch: DataFrame, batch_id: int) -> None:
        part = "all" if mode == "complete" else f"batch={batch_id}"
        batch.write.mode("overwrite").parquet(f"{root}/out/{part}")

    def run() -> None:
        q = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        if progress is not None:
            progress.extend([sum(o.numRowsTotal for o in p.stateOperators) for p in q.recentProgress])

    run()
    if ending is not None:
        ending.say()
        run()
    got = spark.read.schema(df.schema).parquet(f"{root}/out/all" if mode == "complete" else f"{root}/out")
    return got.select(*df.columns)


def replay_table(spark: SparkSession, sf_dir: str, name: str, ending: Ending | None = None) -> DataFrame:
    """A table of the folder as a stream of files, with its ``ending`` if one is given."""
    schema = table_schema(spark, sf_dir, name)
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}*.parquet")
    return ending.after(stream) if ending is not None else stream


def table_schema(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").schema


def frame_outcomes(frames: DataFrame, budget_us: int) -> DataFrame:
    """Each received frame ends in exactly one outcome.

    frames: received_us, pickup_us (null when never picked up), finish_us.  The one-slot
    overwrite itself is a scheduler and stays out; its result is ``pickup_us`` being null.
    """
    late, slow = F.col("pickup_us") - F.col("received_us") > budget_us, F.col("finish_us") - F.col("pickup_us") > budget_us
    return frames.withColumn("outcome", F.when(F.col("pickup_us").isNull(), "no_frame_ready").when(late, "stale").when(slow, "stage_overrun").otherwise("processed"))


def outcome_counts(outcomes: DataFrame, ts: str = "ts", window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    w = outcomes.withWatermark(ts, delay) if outcomes.isStreaming else outcomes
    return w.groupBy(F.window(ts, window).alias("w"), "outcome").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "outcome", "n")


def latency_summary(samples: DataFrame, key: str, value: str, order: Sequence[str], size: int = 120, *, delay: str = "1 hour", idle_us: int | None = None) -> DataFrame:
    """Nearest-rank p50/p95, max and last over the newest ``size`` samples of each step."""
    def step(state, pdf):
        out = []
        for v in pdf[value]:
            state["held"] = (state["held"] + [max(0.0, float(v))])[-size:]
            s = sorted(state["held"])
            rank = lambda q: s[min(len(s) - 1, round(q * (len(s) - 1)))]
            out.append((len(s), rank(0.5), rank(0.95), s[-1], state["held"][-1]))
        got = pd.DataFrame(out, columns=["count", "p50", "p95", "max", "last"])
        return pd.concat([pdf[[key, "event_id"]].reset_index(drop=True), got], axis=1)
    kind = dict(samples.dtypes)[key]
    return keyed(samples.select(key, "event_id", value, *[o for o in order if o != "event_id"]), key, order, lambda: {"held": []}, step,
                 f"{key} {kind}, event_id long, count long, p50 double, p95 double, max double, last double", delay=delay, idle_us=idle_us)


def activity_sessions(events: DataFrame, keys: Sequence[str], gap: str, ts: str = "ts", delay: str | None = None) -> DataFrame:
    """Sessions of activity, open ones included.

    With ``delay`` a stream emits a session once the watermark closes it, gives its state back and drops rows that
    come later still; the source's ``Ending`` closes what is open.  Without, all sessions are kept up to date (complete output).
    """
    e = events.withWatermark(ts, delay) if events.isStreaming and delay else events
    return e.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("peak")).select(
        *keys, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n", "peak")


def stream_pots(sessions: DataFrame, watched_until, persistence_s: float) -> DataFrame:
    """A disappearance needs the persistence window; one cut by the end of data stays unknown."""
    left = F.unix_micros("end_ts") + int(persistence_s * 1_000_000) <= F.unix_micros(watched_until)
    return sessions.withColumn("status", F.when(left, "pot").otherwise("unknown")).withColumn("reason", F.when(left, "persistence_clear").otherwise("no_persistence_window"))


ACTIVE, COAST, OCCLUDED, LOST, POTTED = "active", "coast", "occluded", "lost", "potted"
POCKETS = ((0.0, 0.0), (1270.0, 0.0), (1270.0, 2540.0), (0.0, 2540.0), (0.0, 1270.0), (1270.0, 1270.0))


def assign_min_cost(cost: list[list[float]]) -> dict[int, int]:
    """Exact minimum-cost matching of a small matrix (rows <= ~32) by augmenting paths over potentials."""
    rows, cols = len(cost), len(cost[0]) if cost else 0
    flip = rows > cols
    if flip:
        cost = [list(r) for r in zip(*cost)]
        rows, cols = cols, rows
    u, v, owner = [0.0] * (rows + 1), [0.0] * (cols + 1), [0] * (cols + 1)
    for r in range(1, rows + 1):
        owner[0], j, best, came, seen = r, 0, [math.inf] * (cols + 1), [0] * (cols + 1), [False] * (cols + 1)
        while owner[j]:
            seen[j] = True
            i, step, nxt = owner[j], math.inf, 0
            for c in range(1, cols + 1):
                if seen[c]:
                    continue
                slack = cost[i - 1][c - 1] - u[i] - v[c]
                if slack < best[c]:
                    best[c], came[c] = slack, j
                if best[c] < step:
                    step, nxt = best[c], c
            for c in range(cols + 1):
                if seen[c]:
                    u[owner[c]] += step
                    v[c] -= step
                else:
                    best[c] -= step
            j = nxt
        while j:
            owner[j], j = owner[came[j]], came[j]
    pairs = {owner[c] - 1: c - 1 for c in range(1, cols + 1) if owner[c]}
    return {c: r for r, c in pairs.items()} if flip else pairs


SEEN, IN_POCKET, HIDDEN, HIDDEN_TOO_LONG, OPEN, OVERDUE = "seen", "in_pocket", "hidden", "hidden_too_long", "open", "overdue"
# What a slot becomes and says, by its status and what the frame shows of it.
TURNS = {
    ACTIVE: {SEEN: (ACTIVE, None), IN_POCKET: (POTTED, "potted"), HIDDEN: (OCCLUDED, "occluded"), OPEN: (COAST, None), OVERDUE: (LOST, "lost")},
    COAST: {SEEN: (ACTIVE, "reacquired"), IN_POCKET: (POTTED, "potted"), HIDDEN: (OCCLUDED, "occluded"), OPEN: (COAST, None), OVERDUE: (LOST, "lost")},
    OCCLUDED: {SEEN: (ACTIVE, "reacquired"), IN_POCKET: (POTTED, "potted"), HIDDEN: (OCCLUDED, None), HIDDEN_TOO_LONG: (LOST, "occlusion_expired"), OPEN: (COAST, None), OVERDUE: (LOST, "lost")},
    LOST: {SEEN: (ACTIVE, "reacquired"), IN_POCKET: (POTTED, "potted"), HIDDEN: (LOST, None), OPEN: (COAST, None), OVERDUE: (LOST, None)},
}


class SlotTracker:
    """Fixed slots seeded by the first frame; gated exact assignment to constant-velocity predictions.

    Slots are rows of arrays.  Rolling friction and cushions are not modelled.  An unknown colour
    fits any slot and never overwrites a known one; ``alike`` names colour pairs that may be
    read for each other.  A position is hidden when a frame's occluder lies within ``shade`` of it
    (by default one occluder hides the whole frame).
    """

    BIG = 1e6

    def __init__(self, gate=55.0, slack=0.35, bootstrap=90.0, patience=1.5, hidden_patience=60.0, color_cost=40.0, pocket=62.0, shade=math.inf, alike=()):
        self.gate, self.slack, self.bootstrap, self.patience = gate, slack, bootstrap, patience
        self.hidden_patience, self.color_cost, self.pocket, self.shade = hidden_patience, color_cost, pocket, shade
        self.alike = {frozenset(p) for p in alike}
        self.status: list[str] = []

    def _seed(self, t, xy, colors):
        n = len(xy)
        self.xy, self.v, self.color = xy.copy(), np.zeros((n, 2)), list(colors)
        self.seen_t, self.at_t, self.hits, self.since = np.full(n, t), np.full(n, t), np.ones(n, int), np.full(n, math.nan)
        self.status = [ACTIVE] * n
        return [(i + 1, "seeded", *map(float, xy[i])) for i in range(n)]

    def _differs(self, a, b) -> bool:
        return a != b and UNKNOWN not in (a, b)

    def observe(self, t: float, seen: list[tuple], occluders: list[tuple]) -> list[tuple]:
        """seen: (x, y, color, conf); occluders: (x, y).  Returns events (slot, kind, x, y); slot 0 is a sighting no slot took."""
        xy = np.array([o[:2] for o in seen], float).reshape(-1, 2)
        if not self.status:
            return self._seed(t, xy, [o[2] for o in seen])
        ahead = self.xy + self.v * (t - self.at_t)[:, None]
        taken = self._assigned(t, ahead, xy, seen)
        readings = self._readings(t, ahead, taken, occluders)
        events = []
        for i, reading in enumerate(readings):
            if self.status[i] == POTTED:
                continue
            before = self.status[i]
            self.status[i], said = TURNS[before][reading]
            if reading is SEEN:
                events += self._move(i, t, xy[taken[i]], seen[taken[i]][2], before is ACTIVE, said)
                continue
            self.xy[i], self.at_t[i] = ahead[i], t
            self.since[i] = t if said == "occluded" else self.since[i]
            if said:
                events.append((i + 1, said, *map(float, ahead[i])))
        free = sorted(set(range(len(seen))) - set(taken.values()))
        return events + [(0, "unmatched", *map(float, xy[c])) for c in free]

    def _assigned(self, t, ahead, xy, seen) -> dict[int, int]:
        """Slot -> sighting of least total cost among the pairs inside the gates."""
        if not len(xy):
            return {}
        away = np.hypot(*(xy[None, :, :] - ahead[:, None, :]).transpose(2, 0, 1))
        reach = self.gate + self.slack * np.hypot(*self.v.T) * np.maximum(0.0, t - self.seen_t)
        reach = np.where(self.hits < 2, np.maximum(reach, self.bootstrap), reach)
        other = np.array([[self._differs(c, o[2]) for o in seen] for c in self.color])
        strange = np.array([[d and frozenset((c, o[2])) not in self.alike for d, o in zip(row, seen)] for row, c in zip(other, self.color)])
        barred = (away > reach[:, None]) | (strange & (self.hits >= 2)[:, None]) | np.array([s == POTTED for s in self.status])[:, None]
        cost = np.where(barred, self.BIG, away + self.color_cost * other + 10.0 * (1.0 - np.array([o[3] for o in seen]))[None, :])
        return {r: c for r, c in assign_min_cost(cost.tolist()).items() if not barred[r, c]}

    def _readings(self, t, ahead, taken, occluders) -> list[str]:
        pocketed = (np.hypot(*(ahead[:, None, :] - np.array(POCKETS)[None, :, :]).transpose(2, 0, 1)) <= self.pocket).any(1)
        dark = np.array([any(math.dist(p, o) <= self.shade for o in occluders) for p in ahead.tolist()], bool)
        out = []
        for i in range(len(ahead)):
            held = self.status[i] == OCCLUDED and t - self.since[i] > self.hidden_patience
            out.append(SEEN if i in taken else IN_POCKET if pocketed[i] else (HIDDEN_TOO_LONG if held else HIDDEN) if dark[i] else OPEN if t - self.seen_t[i] <= self.patience else OVERDUE)
        return out

    def _move(self, i, t, xy, color, steady, said) -> list[tuple]:
        """Take a sighting: speed is blended after a steady step and unknown after a gap."""
        events = [(i + 1, said, *map(float, xy))] if said else []
        dt = t - self.seen_t[i]
        if not steady:
            self.v[i] = 0.0
        elif dt > 1e-6:
            new = (xy - self.xy[i]) / dt
            self.v[i] = new if self.hits[i] < 2 else (new + self.v[i]) / 2
        if self._differs(self.color[i], color) and frozenset((self.color[i], color)) not in self.alike:
            events.append((i + 1, "color_mismatch", *map(float, xy)))
        self.color[i] = self.color[i] if color == UNKNOWN else color
        self.xy[i], self.seen_t[i], self.at_t[i], self.since[i] = xy, t, t, math.nan
        self.hits[i] += 1
        return events


def slot_tracker(obs: DataFrame, second: int, *, frame_us: int = 1000, delay: str = "1 hour", **config) -> DataFrame:
    """Identity slots per recording; one event row per status change, and one per sighting that no slot took (slot 0).

    obs: dataset, us, frame_no, event_id, x, y, color, conf, hidden (the sighting is also an
    occluder).  The rows of a frame share its time (``frame_us`` a frame), so they are seen together in a stream as well.
    """
    def step(state, pdf):
        tracker, out = state.setdefault("tracker", SlotTracker(**config)), []
        for frame, rows in pdf.groupby("frame_no", sort=True):
            t = float(rows["us"].iloc[0]) / second
            seen = list(zip(rows["x"].astype(float), rows["y"].astype(float), rows["color"], rows["conf"].astype(float)))
            dark = rows[rows["hidden"].astype(bool)]
            for slot, kind, x, y in tracker.observe(t, seen, list(zip(dark["x"].astype(float), dark["y"].astype(float)))):
                out.append((int(rows["dataset"].iloc[0]), int(frame), slot, kind, x, y))
        return pd.DataFrame(out, columns=["dataset", "frame_no", "slot", "kind", "x", "y"])
    cols = ["dataset", "frame_no", "us", "event_id", "x", "y", "color", "conf", "hidden"]
    schema = "dataset long, frame_no long, slot long, kind string, x double, y double"
    src = obs.select(*cols)
    if src.isStreaming:
        return keyed(src, "dataset", ["frame_no", "us", "event_id"], dict, step, schema, at=F.col("frame_no") * frame_us, delay=delay)
    return stream_fold(close_keys(src.filter("event_id IS NOT NULL")), ["dataset"], ["frame_no", "us", "event_id"], dict, _whole_frames(step), schema)


def _whole_frames(step: Callable) -> Callable:
    """A batch boundary may cut a frame: hold its rows until the next frame, or the closing row of the key, begins."""
    def run(state, pdf):
        held = state.get("tail")
        rows = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        last = rows["frame_no"].max()
        done = rows[(rows["frame_no"] < last) & rows["event_id"].notna()]
        state["tail"] = rows[rows["frame_no"] == last]
        return step(state, done) if len(done) else pd.DataFrame(columns=["dataset", "frame_no", "slot", "kind", "x", "y"])
    return run


def close_keys(obs: DataFrame) -> DataFrame:
    """One closing row per recording, after its last frame."""
    end = obs.groupBy("dataset").agg((F.max("frame_no") + 1).alias("frame_no"), F.max("us").alias("us"))
    return obs.unionByName(end, allowMissingColumns=True)


def register_identities(obs: DataFrame, key: str, bar: float = math.inf, margin: float = 0.05, bank: int = 32, *, delay: str = "1 hour") -> DataFrame:
    """Track -> cluster, online.  A known track is idempotent; by default nothing ever merges.

    obs: key, track, vec, event_id, player, sim, runner_up.  The first confident face binds a
    cluster for good (bind rule: .47 and a .12 lead).
    """
    import numpy as np

    def step(state, pdf):
        out = []
        for track, vec, eid, player, sim, second in zip(pdf["track"], pdf["vec"], pdf["event_id"], pdf["player"], pdf["sim"], pdf["runner_up"]):
            v = np.asarray(vec, dtype=np.float64)
            cid = state["tracks"].get(track)
            if cid is None:
                cid = _join_or_open(state, v, bar, margin)
                state["tracks"][track] = cid
            c = state["clusters"][cid]
            c["bank"] = (c["bank"] + [v])[-bank:]
            sure = sim == sim and sim >= 0.47 and (second != second or sim - second >= 0.12)
            bound = c["player"] is None and sure
            if bound:
                c["player"] = int(player)
            out.append((eid, cid, c["player"], bound))
        got = pd.DataFrame(out, columns=["event_id", "cluster", "player", "bound_now"]).astype({"player": "Int64"})
        got.insert(0, key, pdf[key].to_numpy())
        return got
    return keyed(obs.select(key, "track", "vec", "event_id", "player", "sim", "runner_up"), key, ["event_id"], lambda: {"tracks": {}, "clusters": {}}, step,
                 f"{key} long, event_id long, cluster long, player long, bound_now boolean", at=F.col("event_id") * 1000, delay=delay, real="vec")


def _join_or_open(state, v, bar, margin):
    import numpy as np
    if bar != math.inf and state["clusters"]:
        def cos(a):
            n = np.linalg.norm(a) * np.linalg.norm(v)
            return float(a @ v / n) if n > 0 else 0.0
        ranked = sorted(((cos(np.mean(c["bank"], axis=0)), -i) for i, c in state["clusters"].items()), reverse=True)
        second = ranked[1][0] if len(ranked) > 1 else -1.0
        if ranked[0][0] >= bar and ranked[0][0] - second >= margin:
            return -ranked[0][1]
    cid = len(state["clusters"]) + 1
    state["clusters"][cid] = {"bank": [], "player": None}
    return cid


def board_changes(boards: DataFrame, key: str, order: Sequence[str], min_interval_us: int = 0, *, delay: str = "1 hour", idle_us: int | None = None) -> DataFrame:
    """Emit a board only when the digest of its stable content changes, at a bounded rate.

    A change inside the interval is held and goes out, with its own id, once the interval is
    over and the board still differs from the one shown; it is seen then at the next row.
    """
    def step(state, pdf):
        out = []
        for us, eid, digest in zip(pdf["us"], pdf["event_id"], pdf["digest"]):
            due = "us" not in state or us - state["us"] >= min_interval_us
            held = state.get("held")
            if held is not None and due:
                out.append(held)
                state.update(digest=held[1], us=state["us"] + min_interval_us, held=None)
                due = us - state["us"] >= min_interval_us
            if digest == state.get("digest"):
                state["held"] = None
            elif due:
                out.append((eid, digest))
                state.update(digest=digest, us=int(us), held=None)
            else:
                state["held"] = (eid, digest)
        got = pd.DataFrame(out, columns=["event_id", "digest"])
        got.insert(0, key, pdf[key].iloc[0])
        return got
    return keyed(boards.select(key, "us", "event_id", "digest"), key, order, dict, step, f"{key} long, event_id long, digest string", delay=delay, idle_us=idle_us)


def append_audit(posts: DataFrame, key: str, order: Sequence[str], *, repeat_us: int = 7 * DAY_US, delay: str = "1 hour") -> DataFrame:
    """One audit row per accepted revision; a post based on an older revision is refused, a repeated id ignored.

    posts: key, event_id, us, behind (how many revisions the writer's base is behind).  An id
    counts once, at its first post, however many others came between; ids are remembered for
    ``repeat_us`` after their last post, so a document's state follows its recent posts.
    """
    def step(state, pdf):
        out, known = [], state["known"]
        for us, eid, behind in zip(pdf["us"], pdf["event_id"], pdf["behind"]):
            again = known.pop(eid, None)
            known[eid] = int(us)  # in order of the last post
            while known and next(iter(known.values())) < us - repeat_us:
                del known[next(iter(known))]
            if again is not None and again >= us - repeat_us:
                continue
            accepted = int(behind) == 0
            state["revision"] += accepted
            out.append((eid, state["revision"] if accepted else None, None if accepted else "stale revision"))
        got = pd.DataFrame(out, columns=["event_id", "revision", "refusal"]).astype({"revision": "Int64"})
        got.insert(0, key, pdf[key].iloc[0])
        return got
    return keyed(posts.select(key, "us", "event_id", "behind"), key, order, lambda: {"revision": 0, "known": {}}, step, f"{key} long, event_id long, revision long, refusal string", delay=delay)


def source_delay(segments: DataFrame, key: str, now_us) -> DataFrame:
    """now - (program time + duration) of the newest segment per source."""
    return segments.groupBy(key).agg(F.max(F.col("program_us") + F.col("duration_us")).alias("_e")).select(key, ((now_us - F.col("_e")) / 1e6).alias("delay_s"))
