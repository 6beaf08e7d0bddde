"""Toxicity: a learned lexicon whose misspellings an automaton finds, weighed by how the words around read."""

from __future__ import annotations

import heapq
import math
import pickle
import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship_package
from .records import by_pieces, checked_broadcast, resident, staged, tidy
from .vocabulary import WordCache

WORD = re.compile(r"[^\W_]+")
LONGEST = 24            # letters of a stem
SHORTEST_STEM = 3       # two where letters are ideographs or kana
FUZZY_FROM = 5          # a stem of so many letters may hold one edit
SAMPLE = 40_000         # labelled notes to learn from, about
LEAST = 4               # toxic notes that hold a stem, and occurrences it must newly explain, whatever the size of the sample
SURE = 3.0              # nats by which a stem's share of toxic notes must stand out beyond the number of stems looked at
CLEAN_COST = 0.5        # occurrences that a stem must newly explain per occurrence in clean notes
ENOUGH = 6              # occurrences of lexicon stems that explain a toxic note
PURER = 6               # a stem is so many times more frequent in toxic notes
REJECT = 0.7
WINDOW = 4              # words to either side that say how a hit reads
OPENING, CLOSING = "\"'“«„‘‹", "\"'”»“’›"
REPORTING = re.compile(r"\b(said|says|called|calls|quote|quoted|word|wrote|sagte|nannte|dit|appelé|dijo|llamó)\b")  # fixed cues of reported speech


class Automaton:
    """Levenshtein automaton of stems, intersected with their trie and determinised as words ask for it.

    A state is a set of (trie node, edits so far); reading a letter matches it, replaces it or
    takes it as added, and a missing letter is a step without reading.  ``anywhere`` keeps the
    start in every state, so one pass over a word finds the stems that end at each letter.
    """

    def __init__(self, stems: list[str], anywhere: bool):
        self.anywhere = anywhere
        self.go: list[dict[str, int]] = [{}]
        self.stem: list[int | None] = [None]
        self.room = [0]
        for i, stem in enumerate(stems):
            node, edits = 0, int(len(stem) >= FUZZY_FROM)
            for c in stem:
                if c not in self.go[node]:
                    self.go[node][c] = len(self.go)
                    self.go.append({})
                    self.stem.append(None)
                    self.room.append(0)
                node = self.go[node][c]
                self.room[node] = max(self.room[node], edits)
            self.stem[node] = i
            self.room[0] = max(self.room[0], edits)
        self._reset()

    def _reset(self):
        self.sets: dict[bytes, int] = {}
        self.members: list[bytes] = []  # of each state, the packed numbers 2 * node + edits
        self.found: list[tuple[tuple[int, int], ...]] = []
        self.step: list[dict[str, int]] = []
        self.steps = 0
        self.start = self._state({(0, 0)})

    def _state(self, pairs) -> int:
        least: dict[int, int] = {}
        todo = sorted(pairs, key=lambda p: -p[1])
        while todo:  # missing letters; the fewest edits come last, so they are taken first
            node, e = todo.pop()
            if least.get(node, 9) <= e:
                continue
            least[node] = e
            if e < self.room[node]:
                todo[:0] = [(child, e + 1) for child in self.go[node].values() if e < self.room[child]]
        key = array("i", sorted(2 * node + e for node, e in least.items())).tobytes()
        at = self.sets.get(key)
        if at is None:
            at = self.sets[key] = len(self.members)
            self.members.append(key)
            self.step.append({})
            self.found.append(tuple(sorted((e, self.stem[node]) for node, e in least.items() if self.stem[node] is not None and e <= self.room[node])))
        return at

    def follow(self, state: int, c: str) -> int:
        """The state after a letter that was not asked for in this state before; -1 where nothing goes on."""
        to = {(0, 0)} if self.anywhere else set()
        go, room = self.go, self.room
        for code in array("i", self.members[state]):
            node, e = code >> 1, code & 1
            if e >= room[node]:  # no edit left below: only the letter itself leads on
                child = go[node].get(c)
                if child is not None and e <= room[child]:
                    to.add((child, e))
                continue
            to.add((node, e + 1))
            for letter, child in go[node].items():
                cost = e + (letter != c)
                if cost <= room[child]:
                    to.add((child, cost))
        out = self.step[state][c] = self._state(to) if to else -1
        self.steps += 1
        return out

    def room_made(self) -> None:
        if self.steps > 500_000 or len(self.members) > 50_000:
            self._reset()


class Lexicon:
    """Stems a word begins with, and stems (those marked in ``inside``) it holds after its first letter.

    A code is 2 * (stem + 1) + (1 if an edit was needed).  The head of a word is the stem with the fewest edits
    that some prefix of the word fits; inside, exact stems go before edited ones and no letter counts twice.
    ``codes[word]`` is None where there is nothing, which most words are.
    """

    def __init__(self, stems: list[str], inside: list[bool] = ()):
        self.stems = stems
        self.places = [i for i, ok in enumerate(inside) if ok]
        self.at_head = Automaton(stems, False)
        self.anywhere = Automaton([stems[i] for i in self.places], True) if self.places else None
        self.codes = WordCache(self._codes, limit=150_000)

    def _codes(self, word: str) -> tuple[int, ...] | None:
        """(head code or 0, codes inside ...)"""
        head = self.head(word)
        inner = self._inner(word, len(self.stems[(head >> 1) - 1]) + (head & 1) if head else 1) if self.anywhere is not None and len(word) > 2 else ()
        return (head, *inner) if head or inner else None

    def head(self, word: str) -> int:
        auto = self.at_head
        auto.room_made()
        state, best, step, found = auto.start, None, auto.step, auto.found
        for c in word:
            nxt = step[state].get(c)
            state = auto.follow(state, c) if nxt is None else nxt
            if state < 0:
                break
            if found[state] and (best is None or found[state][0] < best):
                best = found[state][0]
        return 0 if best is None else 2 * (best[1] + 1) + (best[0] > 0)

    def _inner(self, word: str, at: int) -> tuple[int, ...]:
        auto = self.anywhere
        auto.room_made()
        state, step, found, ends = auto.start, auto.step, auto.found, []
        for k, c in enumerate(word, 1):
            nxt = step[state].get(c)
            state = auto.follow(state, c) if nxt is None else nxt
            if found[state]:
                ends += [(e, begin, k, stem) for e, stem in found[state] if (begin := k - len(self.stems[self.places[stem]])) >= at]
        if not ends:
            return ()
        taken, out = bytearray(len(word) + 1), []
        for e, begin, end, stem in sorted(ends):
            if 1 not in taken[begin:end]:
                taken[begin:end] = b"\1" * (end - begin)
                out.append(2 * (self.places[stem] + 1) + (e > 0))
        return tuple(out)


def features(lexicon: Lexicon, weights: list[float], text: str | None) -> list[float]:
    """Plain hits, misspelled hits, quoted hits, the strongest plain hit, their share of the words, length, misspelled hits inside words; logarithms of counts."""
    low = (text or "").lower()
    words = WORD.findall(low)
    codes = list(map(lexicon.codes.__getitem__, words))
    plain = fuzzy = quoted = strongest = blurred = 0.0
    if any(codes):
        places = [m.span() for m in WORD.finditer(low)]
        for i, held in enumerate(codes):
            if not held:
                continue
            head = held[0]
            held = held if head else held[1:]
            said = _reads_quoted(low, places, i)
            for k, code in enumerate(held):
                if code & 1 and (k or not head):
                    blurred += 1
                elif said:
                    quoted += 1
                elif code & 1:
                    fuzzy += 1
                else:
                    plain += weights[(code >> 1) - 1]
                    strongest = max(strongest, weights[(code >> 1) - 1])
    n = len(words)
    return [math.log1p(plain), math.log1p(fuzzy), math.log1p(quoted), strongest, 20 * plain / (n + 20), math.log1p(n) / 10, math.log1p(blurred)]


def _reads_quoted(low: str, places, i: int) -> bool:
    """A hit inside quotation marks within its window, or right after a verb of speech."""
    a, b = places[i]
    left = low[places[max(0, i - WINDOW)][0]: a]
    right = low[b: places[min(len(places) - 1, i + WINDOW)][1]]
    opened = max((left.rfind(c) for c in OPENING), default=-1)
    inside = opened >= 0 and any(c in right for c in CLOSING) and not any(c in left[opened + 1:] for c in CLOSING)
    return inside or bool(REPORTING.search(left[-24:]))


def _shortest(part: str) -> int:
    return SHORTEST_STEM - ("\u2e80" <= part[0] <= "\u9fff")


def labelled_sample(notes: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """About ``sample`` labelled notes at most, ``text, toxic``; equal texts are one, with their larger label.

    The ids are chosen by hash before texts are touched; that list is small enough by
    construction to be sent to all tasks, so the notes' texts are never shuffled.
    """
    marks = labels.select("id", "toxic").filter("id IS NOT NULL AND toxic IS NOT NULL").groupBy("id").agg(F.max("toxic").alias("toxic"))
    n = marks.count()
    keep = min(1.0, sample / max(1, n))
    marks = marks.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(keep * (1 << 20)) + 1)
    rows = notes.select("id", "text").filter("text IS NOT NULL").join(F.broadcast(marks), "id").select("text", "toxic")
    return staged(rows.groupBy("text").agg(F.max("toxic").alias("toxic")), "toxic-sample")


def sample_words(sample: DataFrame) -> DataFrame:
    """``word, t, c, d, dc``: occurrences in toxic and clean notes (``ENOUGH`` a note at most), and toxic and clean notes that hold the word."""
    def words(part: pa.RecordBatch) -> pa.RecordBatch:
        held = [Counter(WORD.findall((t or "").lower())) for t in part.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array([list(h) for h in held], pa.list_(pa.string())), pa.array([[min(ENOUGH, k) for k in h.values()] for h in held], pa.list_(pa.int32())), part.column(1)], ["words", "times", "toxic"])

    held = by_pieces(sample.select("text", F.col("toxic").cast("int").alias("toxic")), words, "words array<string>, times array<int>, toxic int")
    return held.select(F.explode(F.arrays_zip("words", "times")).alias("w"), "toxic").groupBy(F.col("w.words").alias("word")).agg(
        F.sum(F.col("toxic") * F.col("w.times")).alias("t"), F.sum((1 - F.col("toxic")) * F.col("w.times")).alias("c"), F.sum("toxic").alias("d"), F.sum(1 - F.col("toxic")).alias("dc"))


def _part_counts(words: DataFrame, counts: list[str], known=None, held_most: int = 1 << 16) -> DataFrame:
    """``part`` with the sums of ``counts`` over the words that hold it, and over those that begin with it (``h_...``).

    Every letter of a word may start a part.  ``known`` (a broadcast list) names the parts wanted; where
    a part is not, none that continues it is.  Sums are made inside the task and handed on whenever
    ``held_most`` parts are held, so even a text without breaks takes bounded memory.
    """
    names = [*counts, *(f"h_{c}" for c in counts)]
    width = len(counts)

    def flush(held):
        columns = np.array(list(held.values()), np.int64).reshape(len(held), 2 * width)
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *(pa.array(columns[:, i]) for i in range(2 * width))], ["part", *names])

    def run(batches):
        wanted = resident("known parts", known.value, lambda raw: set(pickle.loads(raw))) if known is not None else None
        held: dict[str, list[int]] = {}
        for batch in batches:
            for word, *values in zip(*(c.to_pylist() for c in batch.columns)):
                for i in range(len(word)):
                    for k in range(i + _shortest(word[i]), min(i + LONGEST, len(word)) + 1):
                        part = word[i:k]
                        if wanted is not None and part not in wanted:
                            break
                        row = held.get(part)
                        if row is None:
                            row = held[part] = [0] * (2 * width)
                        for j, v in enumerate(values):
                            row[j] += v
                            if not i:
                                row[width + j] += v
                    if len(held) >= held_most:
                        yield flush(held)
                        held = {}
        if held:
            yield flush(held)

    ship_package(words.sparkSession)
    made = words.select("word", *counts).mapInArrow(tidy(run), "part string, " + ", ".join(f"{n} long" for n in names))
    return made.groupBy("part").agg(*[F.sum(n).alias(n) for n in names])


def _stands_out(t: str, c: str, d: str, dc: str, n: int, toxic: int, looked_at: int):
    """Purer than ``PURER`` and beyond chance: the toxic share among the notes that hold a part, by its likelihood ratio against the number of parts."""
    pure = F.col(t) * (n - toxic) >= PURER * F.col(c) * toxic
    all_, share = F.col(d) + F.col(dc), toxic / n
    q = F.col(d) / all_
    nats = F.col(d) * F.log(q / share) + F.when(F.col(dc) > 0, F.col(dc) * F.log((1 - q) / (1 - share))).otherwise(0.0)
    return (F.col(d) >= LEAST) & pure & (nats >= math.log(max(1, looked_at)) + SURE)


def _cover(held: list[tuple[np.ndarray, np.ndarray]], left: np.ndarray, clean: np.ndarray, stems: list[str], apart: bool) -> list[int]:
    """Greedy cover: the stem that newly explains most, less its cost in clean notes, until none explains ``LEAST``.

    ``held[stem]`` are the rows that hold it and how often; ``left`` is what each row still lacks.
    ``apart``: parts and extensions of a chosen stem are the same occurrences and are left out.
    Gains only fall, so a stem is looked at again only when it comes first.
    """
    def gain(i):
        rows, times = held[i]
        return float(np.minimum(times, left[rows]).sum() - CLEAN_COST * clean[i])

    heap = [(-gain(i), -len(stems[i]), stems[i], i) for i in range(len(stems))]
    heapq.heapify(heap)
    chosen, whole, begun = [], set(), set()
    while heap:
        before, size, stem, i = heapq.heappop(heap)
        if -before < LEAST:
            break
        if apart and (stem in begun or any(stem[:k] in whole for k in range(1, len(stem)))):
            continue
        now = -gain(i)
        if now > before:
            heapq.heappush(heap, (now, size, stem, i))
            continue
        chosen.append(i)
        whole.add(stem)
        begun.update(stem[:k] for k in range(1, len(stem) + 1))
        rows, times = held[i]
        left[rows] = np.maximum(0, left[rows] - times)
    return chosen


def _by_stem(rows, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and times of each stem from the stems and times of each row."""
    at = np.concatenate([np.zeros(0, np.int64), *(np.array(r.at, np.int64) for r in rows)])
    times = np.concatenate([np.zeros(0, np.int64), *(np.array(r.times, np.int64) for r in rows)])
    row = np.repeat(np.arange(len(rows)), [len(r.at) for r in rows])
    order = np.argsort(at, kind="stable")
    border = np.searchsorted(at[order], np.arange(n + 1))
    return [(row[order[a:b]], times[order[a:b]]) for a, b in zip(border[:-1], border[1:])]


def learn_lexicon(sample: DataFrame) -> tuple[list[str], list[float], list[bool]]:
    """Stems that mark toxic notes, their weights, and which of them are looked for inside words too.

    All is counted over the sample's distinct words.  Parts that ``LEAST`` toxic notes hold are counted in all
    words; those that stand out beyond chance are candidates.  A greedy cover of the toxic notes
    by candidates that begin words comes first (a note is explained by ``ENOUGH`` occurrences, so that
    stems which a clean note may hold once by chance still serve); a cover of the toxic words
    without such a stem, by candidates anywhere in them, follows.  Neither cover has a size limit; what comes
    to the driver are candidates and, for each toxic sample note or word, which of them it holds, so the
    sample bounds both.
    """
    total = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("toxic").cast("int")), F.lit(0)).alias("t")).first()
    if not total.t or total.t == total.n:
        return [], [], []
    n, toxic, spark = total.n, total.t, sample.sparkSession
    table = staged(sample_words(sample), "toxic-words")
    often = [r.part for r in _part_counts(table.filter("d > 0"), ["d"]).filter(F.col("d") >= LEAST).select("part").collect()]
    known = checked_broadcast(spark, pickle.dumps(often), 256 << 20, "the parts of toxic words")
    counts = _part_counts(table, ["t", "c", "d", "dc"], known).withColumn("ti", F.col("t") - F.col("h_t")).withColumn("ci", F.col("c") - F.col("h_c"))
    tests = (n, toxic, 2 * len(often))
    begins, holds = _stands_out("h_t", "h_c", "h_d", "h_dc", *tests), _stands_out("t", "c", "d", "dc", *tests) & (F.col("ti") > 0)
    found = sorted(counts.withColumn("begins", begins).withColumn("holds", holds).filter("begins OR holds").collect(), key=lambda r: r.part)

    rows = [r for r in found if r.begins]
    stems = [r.part for r in rows]
    packed = checked_broadcast(spark, pickle.dumps({s: i for i, s in enumerate(stems)}), 64 << 20, "the candidate stems")

    def begun(part: pa.RecordBatch) -> pa.RecordBatch:
        place = resident("candidate stems", packed.value, pickle.loads)
        out = []
        for text in part.column(0).to_pylist():
            held: dict[int, int] = {}
            for word, times in Counter(WORD.findall((text or "").lower())).items():
                for k in range(_shortest(word), min(LONGEST, len(word)) + 1):
                    i = place.get(word[:k])
                    if i is not None:
                        held[i] = min(ENOUGH, held.get(i, 0) + times)
            out.append(held)
        return pa.RecordBatch.from_arrays([pa.array([list(h) for h in out], pa.list_(pa.int32())), pa.array([list(h.values()) for h in out], pa.list_(pa.int32()))], ["at", "times"])

    notes = by_pieces(sample.filter("toxic = 1").select("text"), begun, "at array<int>, times array<int>").filter("size(at) > 0").collect() if stems else []
    chosen = _cover(_by_stem(notes, len(stems)), np.full(len(notes), ENOUGH), np.array([r.h_c for r in rows]), stems, True)
    heads = [stems[i] for i in chosen]
    weights = [_weight(rows[i].h_t, rows[i].h_c, n, toxic) for i in chosen]
    inside = [rows[i].ti * (n - toxic) >= PURER * rows[i].ci * toxic for i in chosen]

    rows = [r for r in found if r.holds and r.part not in set(heads)]
    stems = [r.part for r in rows]
    known = checked_broadcast(spark, pickle.dumps((heads, {s: i for i, s in enumerate(stems)})), 64 << 20, "the candidate parts")

    def held_in(part: pa.RecordBatch) -> pa.RecordBatch:
        lexicon, place = resident("candidate parts", known.value, lambda raw: (lambda x: (Lexicon(x[0]), x[1]))(pickle.loads(raw)))
        longest = max(map(len, place), default=0)
        out = []
        for word in part.column(0).to_pylist():
            held = set()
            if lexicon.codes[word] is None:
                for i in range(len(word)):
                    held.update(at for k in range(i + 2, min(i + longest, len(word)) + 1) if (at := place.get(word[i:k])) is not None)
            out.append(sorted(held))
        return pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32())), part.column(1)], ["at", "t"])

    words = by_pieces(table.filter("t > 0").select("word", "t"), held_in, "at array<int>, t bigint", text="word").filter("size(at) > 0").select(
        "at", F.expr("array_repeat(t, size(at))").alias("times"), "t").collect() if stems else []
    chosen = _cover(_by_stem(words, len(stems)), np.array([r.t for r in words], np.int64), np.array([r.c for r in rows]), stems, False)
    return ([*heads, *(stems[i] for i in chosen)], [*weights, *(_weight(rows[i].t, rows[i].c, n, toxic) for i in chosen)], [*inside, *[True] * len(chosen)])


def _weight(t: int, c: int, n: int, toxic: int) -> float:
    return min(1.0, math.log((t + 0.5) / toxic / ((c + 0.5) / (n - toxic))) / math.log(100))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)) * len(y) ** 0.5, x.T @ (y - p) - ridge * len(y) ** 0.5 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(notes: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> dict:
    """Stems, their weights and the coefficients of the score, from labelled notes alone.

    ``notes(id, text)`` and ``labels(id, toxic)`` (0 or 1); rows without either are no examples,
    a note labelled twice counts with its larger label.  Without both classes the model is
    constant.  Learns from about ``sample`` labelled notes at most.
    """
    rows = labelled_sample(notes, labels, sample=sample)
    stems, weights, inside = learn_lexicon(rows)
    model = dict(stems=stems, weights=weights, inside=inside, coef=None)
    got = _featured(rows.select("text", F.col("toxic").cast("double").alias("toxic")), model, "f array<double>").select("f", "toxic").collect()  # at most the sample, a few numbers each
    y = np.array([r.toxic for r in got])
    x = np.array([[1.0, *r.f] for r in got])
    constant = [math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -2.0, *[0.0] * 7]
    model["coef"] = _logistic(x, y).tolist() if stems and 0 < y.sum() < len(y) else constant
    return model


def _featured(rows: DataFrame, model: dict, made: str, keep_text: bool = False) -> DataFrame:
    packed = checked_broadcast(rows.sparkSession, pickle.dumps(model), 16 << 20, "the toxicity model")
    schema = StructType([f for f in rows.schema if keep_text or f.name != "text"] + list(StructType.fromDDL(made)))

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        lexicon, weights, coef = _loaded(packed.value)
        f = [features(lexicon, weights, t) for t in part.column(part.schema.get_field_index("text")).to_pylist()]
        if coef is None:
            new = pa.array(f, pa.list_(pa.float64()))
        else:
            z = np.array([[1.0, *x] for x in f]) @ np.array(coef)
            new = pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        kept = [part.column(i) for i, n in enumerate(part.schema.names) if keep_text or n != "text"]
        return pa.RecordBatch.from_arrays([*kept, new], schema.names)

    return by_pieces(rows, work, schema)


def _loaded(raw: bytes):
    def make(r):
        model = pickle.loads(r)
        return Lexicon(model["stems"], model["inside"]), model["weights"], model["coef"]
    return resident("toxicity", raw, make)


def score(notes: DataFrame, model: dict, *, keep_text: bool = False, id_col: str = "id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``id, score, toxic``: score 0..1 of every whole note; toxic from 0.7 on; ``text`` if asked for and a struct ``carry`` of named columns.

    ``notes(id, text)`` are the workbench's notes.  Null and empty texts get the score of a text
    without words; an empty table gives no rows; repeated rows are answered one by one; other
    columns are not read.
    """
    more = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carry")] if carry else []
    base = notes.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *more)
    return _featured(base, model, "score double", keep_text).withColumn("toxic", (F.col("score") >= REJECT).cast("int"))
