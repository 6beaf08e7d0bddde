"""Secret scan: stated patterns plus a battery of randomness tests under length-aware false-discovery control."""

from __future__ import annotations

import math
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .records import by_pieces, staged

# The stated patterns, their shortest length and their order in equal starts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # whole runs only: a run is matched from its first character
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
SHORTEST = {"assign": 12, "access": 18}
BASE_KINDS = ("assign", "access", "hex")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
VALUE = re.compile(r"[A-Za-z0-9+/_-]+(?:=+(?![A-Za-z0-9+/_=-]))?")  # between the '=' of a run, with its padding
SEGMENT = re.compile(r"[^/]+")
# Alphabets in the order they are tried: a run belongs to the first that holds all its characters.
ENCODINGS = {
    "hexupper": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
KINDS = (*BASE_KINDS, *ENCODINGS)
LENGTH_CLASSES = (20, 28, 40, 64, 128)  # class = the largest of these a run reaches
BINS = 40                               # quarter decades of the combined p-value
PLAUSIBLE = 7                           # a run below p = 0.01 is not random, whatever the decoys say
DECOY_BLOCK = 4096                      # characters of text per set of decoys
CELLS = 8                               # equal cells of an alphabet in the uniformity test


def chi2_tail(x: float, dof: int) -> float:
    """P(chi-squared >= x), closed form."""
    h = x / 2
    if dof % 2 == 0:
        term = total = math.exp(-h)
        for k in range(1, dof // 2):
            term *= h / k
            total += term
        return min(1.0, total)
    total = math.erfc(math.sqrt(h))
    term = math.exp(-h) * math.sqrt(h) * 2 / math.sqrt(math.pi)
    for k in range(1, dof // 2 + 1):
        total += term
        term *= h / (k + 0.5)
    return min(1.0, total)


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def encoding_of(run: str) -> str | None:
    body = run.rstrip("=")
    if not (any(c.isdigit() for c in body) and any(c.isalpha() for c in body)):
        return None
    letters = set(body)
    return next((name for name, alphabet in ENCODINGS.items() if letters <= _SETS[name]), None)


_SETS = {name: set(a) for name, a in ENCODINGS.items()}
_PLACE = {name: {c: i for i, c in enumerate(a)} for name, a in ENCODINGS.items()}


def randomness(body: str, encoding: str) -> float:
    """Combined p-value of three tests that ``body`` is uniform and independent over its alphabet.

    Chi-squared over equal cells of the alphabet, runs above and below its middle, and lag-one
    serial correlation; the smallest counts three times (they share one text, so their order
    statistic is bounded instead of multiplied).
    """
    place = _PLACE[encoding]
    x = np.array([place[c] for c in body], float)
    n, size = len(x), len(place)
    cells = np.bincount((x * CELLS / size).astype(int), minlength=CELLS)
    uniform = chi2_tail(float(((cells - n / CELLS) ** 2).sum() / (n / CELLS)), CELLS - 1)
    up = x >= size / 2
    a = int(up.sum())
    b = n - a
    if a == 0 or b == 0:
        return 0.0
    turns = 1 + int((up[1:] != up[:-1]).sum())
    mean = 1 + 2 * a * b / n
    spread = math.sqrt((mean - 1) * (mean - 2) / (n - 1)) or 1.0
    runs = _normal_tail((turns - mean) / spread)
    d = x - x.mean()
    serial = _normal_tail(float((d[1:] * d[:-1]).sum() / (d * d).sum()) * math.sqrt(n))
    return min(1.0, 3 * min(uniform, runs, serial))


def p_bin(p: float) -> int:
    return BINS if p <= 0 else min(BINS, int(-4 * math.log10(p)))


def length_class(n: int) -> int:
    return sum(n >= c for c in LENGTH_CLASSES) - 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= SHORTEST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= SHORTEST["access"]]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], BASE_KINDS.index(s[2])))


def _outside(a: int, b: int, taken: list[tuple[int, int]], starts: list[int]) -> list[tuple[int, int]]:
    """Parts of [a, b) that no span of ``taken`` (apart and in order) covers."""
    out = []
    for x, y in taken[max(0, bisect_right(starts, a) - 1):]:
        if x >= b:
            break
        if y > a:
            if x > a:
                out.append((a, x))
            a = y
    return [*out, (a, b)] if a < b else out


def _segments(text: str, a: int, b: int) -> list[tuple[int, int]]:
    return [m.span() for m in SEGMENT.finditer(text, a, b)]


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str, int, list[int]]]:
    """Runs of encoded-looking characters that base spans do not cover, with p-value bin and the codes of the runs around them.

    A run is cut at ``=`` unless that is its padding.  What is left is tested as a whole, by its
    segments between slashes, by its parts outside the base spans and by the segments of those
    parts; a code is class * 64 + bin.
    """
    apart: list[tuple[int, int]] = []
    for x, y, _ in taken:
        if apart and x <= apart[-1][1]:
            apart[-1] = (apart[-1][0], max(y, apart[-1][1]))
        else:
            apart.append((x, y))
    starts = [x for x, _ in apart]
    out = []
    for m in RUN.finditer(text):
        for v in VALUE.finditer(text, *m.span()):
            a, b = v.span()
            left = _outside(a, b, apart, starts)
            if b - a < LENGTH_CLASSES[0] or not left:
                continue
            parts = [(a, b)]
            if "/" in v.group():
                parts += _segments(text, a, b)
            if left != [(a, b)]:
                parts += left + [s for x, y in left for s in _segments(text, x, y)]
            tested: list[tuple[int, int, int]] = []
            for x, y in sorted({p for p in parts if p[1] - p[0] >= LENGTH_CLASSES[0]}, key=lambda p: (p[0] - p[1], p[0])):  # longest first
                kind = encoding_of(text[x:y]) if _outside(x, y, apart, starts) else None
                if kind:
                    p = p_bin(randomness(text[x:y].rstrip("="), kind))
                    out.append((x, y, kind, p, [c for i, j, c in tested if i <= x and y <= j]))
                    tested.append((x, y, length_class(y - x) * 64 + p))
    return out


def decoys(text: str) -> list[int]:
    """Known non-secrets: for each block of the text, its ordinary words run together, as codes class * 64 + bin.

    The lengths take turns over the blocks; a block with too few words serves a shorter class.
    """
    out = []
    for block in range(0, len(text), DECOY_BLOCK):
        joined = "".join([w for w in text[block: block + DECOY_BLOCK].split() if len(w) < 16 and w.isascii() and w.isalnum()])
        k = min((block // DECOY_BLOCK + len(text)) % len(LENGTH_CLASSES), length_class(len(joined)))
        if k >= 0:
            out.append(k * 64 + p_bin(randomness(joined[: LENGTH_CLASSES[k]], "base62")))
    return out


def find_secrets(notes: DataFrame, *, rate: float = 0.01, keep_text: bool = True, id_col: str = "id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``id, text, spans array<struct<start,end,kind>>, carry``: secrets in every whole note, in order of start.

    ``notes(id, text)`` are the workbench's notes (``text`` is returned if ``keep_text``).  Spans are code points, end exclusive.  The
    stated patterns (``assign``, ``access``, ``hex``) always stay.  Other long runs that mix
    letters and digits, the values of ``name=value`` and segments of paths among them, get the p-value of the randomness battery for the alphabet they fit; a run
    is a secret when its p-value is at least 0.01 and above the limit of its length class; a part
    of such a run is not named again.  The limit is the
    lowest at which the expected share of ordinary text among the accepted runs is at most
    ``rate``: decoys of the same lengths, cut from the notes themselves, say how often ordinary
    text gets that far.  Counts of runs and decoys come from all notes and are a table of
    length classes by p-value bins, so their size is fixed.

    Null and empty texts have no spans; an empty table gives no rows; repeated rows are answered
    one by one; a class without decoys or runs accepts nothing beyond the stated patterns.
    """
    base = notes.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in carry], F.lit(True).alias("_")).alias("carry"))
    made = StructType.fromDDL("base array<struct<start:int,end:int,kind:string>>, runs array<struct<start:int,end:int,kind:string,bin:int,outer:array<int>>>, decoys array<int>")
    schema = StructType([*base.schema, *made])
    span = [("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        found, runs, controls = [], [], []
        for text in part.column(1).to_pylist():
            own = base_spans(text or "")
            found.append([dict(start=a, end=b, kind=k) for a, b, k in own])
            runs.append([dict(start=a, end=b, kind=k, bin=p, outer=o) for a, b, k, p, o in candidates(text or "", own)])
            controls.append(decoys(text or ""))
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.struct(span))), pa.array(runs, pa.list_(pa.struct([*span, ("bin", pa.int32()), ("outer", pa.list_(pa.int32()))]))),
                                           pa.array(controls, pa.list_(pa.int32()))], schema.names)

    scanned = by_pieces(base, work, schema)
    scanned = staged(scanned if keep_text else scanned.drop("text"), "secrets")  # scanned once: the limits come before the answer
    limits = _limits(scanned, rate)
    most = F.array(*map(F.lit, limits))
    good = F.filter("runs", lambda r: (r["bin"] <= _limit_of(r["end"] - r["start"], limits)) & ~F.exists(r["outer"], lambda c: c % 64 <= F.get(most, F.floor(c / 64).cast("int"))))
    spans = F.array_sort(
        F.concat("base", F.transform(good, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["kind"].alias("kind")))),
        lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(_order(a["kind"]) - _order(b["kind"]))).cast("int"))
    return scanned.select("id", *["text"] * keep_text, spans.alias("spans"), "carry")


def _order(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def _limit_of(length: Column, limits: list[int]) -> Column:
    out = F.lit(-1)
    for k, c in enumerate(LENGTH_CLASSES):
        out = F.when(length >= c, F.lit(limits[k])).otherwise(out)
    return out


def _limits(scanned: DataFrame, rate: float) -> list[int]:
    """Largest accepted p-value bin per length class (-1: none), from two histograms of fixed size."""
    klass = F.lit(-1)
    for k, c in enumerate(LENGTH_CLASSES):
        klass = F.when(F.col("r.end") - F.col("r.start") >= c, F.lit(k)).otherwise(klass)
    runs = scanned.select(F.explode("runs").alias("r")).select((klass * 64 + F.col("r.bin")).alias("code"), F.lit(1).alias("run"), F.lit(0).alias("decoy"))
    controls = scanned.select(F.explode("decoys").alias("code"), F.lit(0).alias("run"), F.lit(1).alias("decoy"))
    counts = {r.code: (r.runs, r.decoys) for r in runs.unionAll(controls).groupBy("code").agg(F.sum("run").alias("runs"), F.sum("decoy").alias("decoys")).collect()}
    limits = []
    for k in range(len(LENGTH_CLASSES)):
        row = [counts.get(k * 64 + b, (0, 0)) for b in range(BINS + 1)]
        n_runs, n_decoys = sum(r for r, _ in row), sum(d for _, d in row)
        best, seen, wrong = -1, 0, 0
        for b, (r, d) in enumerate(row[: PLAUSIBLE + 1]):
            seen, wrong = seen + r, wrong + d
            if seen and n_decoys and (wrong + 1) / n_decoys * n_runs <= rate * seen:
                best = b
        limits.append(best)
    return limits


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by ``mark``; overlapping spans are replaced once."""
    state = F.aggregate(
        spans, F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda s, x: F.when(x["end"] <= s["at"], s).otherwise(F.struct(
            F.concat(s["done"], F.when(x["start"] >= s["at"], F.concat(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))).otherwise(F.lit(""))).alias("done"),
            x["end"].alias("at"))))
    return F.when(F.size(spans) > 0, F.concat(state["done"], F.substring(text, state["at"] + 1, F.length(text)))).otherwise(text)
