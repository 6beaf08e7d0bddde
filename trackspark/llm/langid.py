"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

import functools
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .records import by_pieces, checked_broadcast, pieces, resident

DIM = 1024            # components of a vector
SEED = 20_11
UNKNOWN = "und"
CACHE = 1 << 15       # n-gram vectors kept by a worker (32 MB)
UNIT = 1 << 20        # a note's unit vector is bundled in steps of 1 / UNIT, so sums are exact
PROFILES = 4096       # most languages there may be
SPACE = 32


@functools.cache
def _letters() -> np.ndarray:
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), np.bool_)


@functools.lru_cache(maxsize=4096)
def letter_vector(point: int) -> np.ndarray:
    return (np.random.default_rng([SEED, point]).integers(0, 2, DIM, np.int8) * 2 - 1).astype(np.int8)


def ngram_vector(a: int, b: int, c: int) -> np.ndarray:
    """Three letters bound: each rotated by its place, multiplied component by component."""
    return np.roll(letter_vector(a), 2) * np.roll(letter_vector(b), 1) * letter_vector(c)


class Vectors:
    """Vectors of the n-grams met so far; emptied when full, so memory is bounded."""

    def __init__(self):
        self.row: dict[int, int] = {}
        self.table = np.zeros((CACHE, DIM), np.int8)

    def rows(self, codes: np.ndarray) -> np.ndarray:
        row = self.row
        if len(row) + len(codes) > CACHE:
            row.clear()
        out = np.empty(len(codes), np.int64)
        for i, code in enumerate(codes.tolist()):
            at = row.get(code)
            if at is None:
                at = row[code] = len(row)
                self.table[at] = ngram_vector(code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF)
            out[i] = at
        return out

    def bundle(self, text: str | None) -> np.ndarray | None:
        """Sum of the vectors of all letter trigrams (words framed by one space), or None without letters."""
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        alike = np.where(_letters()[points], points, SPACE)
        if not (alike != SPACE).any():
            return None
        alike = np.concatenate(([SPACE], alike, [SPACE]))
        alike = alike[np.concatenate(([True], (alike[1:] != SPACE) | (alike[:-1] != SPACE)))]
        codes, counts = np.unique(alike[:-2] << 42 | alike[1:-1] << 21 | alike[2:], return_counts=True)
        total = np.zeros(DIM, np.float32 if counts.sum() < 1 << 23 else np.float64)
        for at in range(0, len(codes), 4096):
            rows = self.rows(codes[at: at + 4096])
            total += counts[at: at + 4096].astype(total.dtype) @ self.table[rows].astype(total.dtype)
        return total.astype(np.float64)


def _vectors() -> Vectors:
    return resident("n-gram vectors", b"", lambda _: Vectors())


def learn_profiles(notes: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototype vector per language: the bundle of the unit vectors of all its notes.

    Every row with a language and a letter counts, repeated rows as often as they occur.  Tasks
    add up their own notes; those sums are added in Spark as integers, so the result does not
    depend on the order.  At most ``PROFILES`` languages of ``DIM`` numbers reach the driver.
    """
    ship_package(notes.sparkSession)
    schema = "lang string, profile array<bigint>"

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in pieces(batch):
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    v = _vectors().bundle(text)
                    if v is not None and (size := np.sqrt(v @ v)) > 0:
                        sums[lang] = sums.get(lang, 0) + np.rint(v / size * UNIT).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums), pa.array(list(sums.values()), pa.list_(pa.int64()))], ["lang", "profile"])

    rows = notes.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    parts = rows.mapInArrow(run, schema).select("lang", F.posexplode("profile").alias("at", "v")).groupBy("lang", "at").agg(F.sum("v").alias("v"))
    profiles = parts.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("profile")).limit(PROFILES + 1).collect()
    if len(profiles) > PROFILES:
        raise ValueError(f"more than {PROFILES} languages")
    return {r.lang: np.array(r.profile, float) for r in sorted(profiles)}


def identify(notes: DataFrame, profiles: dict[str, np.ndarray], *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id, lang, score``: the language whose prototype has the largest cosine with each whole note.

    ``notes(id, text)`` are the workbench's notes.  Score is that cosine, not below 0.  Null texts and
    texts without a letter are ``und`` with score 0, as is everything without profiles; ties go
    to the smaller name; an empty table gives no rows; repeated rows are answered one by one;
    other columns are not read.
    """
    names = sorted(profiles)
    matrix = np.array([profiles[n] / max(1e-12, float(np.linalg.norm(profiles[n]))) for n in names])
    packed = checked_broadcast(notes.sparkSession, pickle.dumps((names, matrix)), 64 << 20, "the profiles")
    kind = notes.schema[id_col].dataType.simpleString()

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        known, unit = _profiles(packed.value)
        langs, scores = [], []
        for text in part.column(1).to_pylist():
            v = _vectors().bundle(text) if known else None
            size = 0.0 if v is None else float(np.sqrt(v @ v))
            if not size:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            cosine = unit @ v / size
            best = int(cosine.argmax())
            langs.append(known[best])
            scores.append(min(1.0, max(0.0, float(cosine[best]))))
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang", "score"])

    base = notes.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return by_pieces(base, work, f"id {kind}, lang string, score double")


@functools.lru_cache(maxsize=2)
def _profiles(raw: bytes):
    return pickle.loads(raw)
