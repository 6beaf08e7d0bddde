"""Scalar rules as native columns: names, confidences, strengths, admission, folding."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .geometry import POCKETS

UNKNOWN = "unknown"
# Detector spellings that name one colour; colours a rack holds once.
COLOR_ALIASES = {"red1": "red", "red2": "red"}
UNIQUE_COLORS = ("black",)
# Admission window of a ball instance and the score cuts.
BALL_AREA = (60.0, 9000.0)
BALL_RADIUS = (4.0, 60.0)
SCORE_CUT = 0.62
SWEEP = (0.20, 0.35, 0.50, 0.62)


def color_key(c: Column) -> Column:
    """Comparable colour name; blank stays blank."""
    text = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    for alias, name in COLOR_ALIASES.items():
        text = F.when(text == alias, name).otherwise(text)
    return text


def normalize_color(c: Column) -> Column:
    key = color_key(c)
    return F.when(key == "", UNKNOWN).otherwise(key)


def colors_compatible(a: Column, b: Column) -> Column:
    return (a == UNKNOWN) | (b == UNKNOWN) | (a == b)


def pocket_from_text(c: Column) -> Column:
    """A bare pocket name, a name before a parenthesis, or a name after the last `` from ``."""
    names = [n for n, _, _ in POCKETS]
    text = F.trim(c)
    head = F.trim(F.substring_index(text, "(", 1))
    tail = F.when(F.instr(text, " from ") > 0, F.trim(F.substring_index(text, " from ", -1)))
    return F.when(head.isin(names), head).when(tail.isin(names), tail)


def _fold_text(text: str) -> str:
    flat = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text))
    flat = re.sub("[̀-ͯ]", "", flat).lower()
    return re.sub(r"[\W_]+", " ", flat, flags=re.UNICODE).strip()


@F.pandas_udf(StringType())
def _fold_unicode(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else _fold_text(v))


def search_fold(c: Column, ascii_only: bool = False) -> Column:
    """Fold for searching.  Stays in the JVM; non-ASCII text needs ``ascii_only=False``."""
    plain = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    if ascii_only:
        return plain
    ascii_ = c.rlike("^\\p{ASCII}*$")
    return F.when(ascii_, plain).otherwise(_fold_unicode(F.when(~ascii_, c)))


def name_matches(folded: Column, query: Column) -> Column:
    """Every word of the folded query is inside the folded or the space-less name."""
    tight = F.replace(folded, F.lit(" "), F.lit(""))
    words = F.filter(F.split(query, " "), lambda w: w != "")
    return F.forall(words, lambda w: F.contains(folded, w) | F.contains(tight, w))


def name_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def number_or_null(v: Column) -> Column:
    """A JSON scalar as a number; booleans and text are not numbers."""
    return F.when(v.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), v.try_cast("double"))


def obs_confidence(source: Column, score: Column, scored: str = "scored") -> Column:
    return F.when((source == scored) & score.isNotNull(),
                  F.least(F.lit(1.0), F.greatest(F.lit(0.0), (score - 0.5) / 0.5))).otherwise(0.5)


def track_confidence(mean: Column, hits: Column, conflicts: Column) -> Column:
    bonus = F.least(F.lit(0.25), F.lit(0.1) * (hits - 1))
    raw = mean + bonus - F.when(conflicts > 0, 0.15).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))


def admit(area: Column, radius: Column, in_cloth: Column) -> Column:
    """Reason a ball instance passes or fails; the first failing rule names it."""
    return (F.when(F.coalesce(area, F.lit(0.0)) < BALL_AREA[0], "area_too_small").when(area > BALL_AREA[1], "area_too_large")
            .when(F.coalesce(radius, F.lit(0.0)) < BALL_RADIUS[0], "radius_too_small").when(radius > BALL_RADIUS[1], "radius_too_large")
            .when(~F.coalesce(in_cloth, F.lit(True)), "off_cloth").otherwise("admitted"))


def pot_strength(drop: Column, pocket_mm: Column, missing: Column) -> Column:
    """How much a census drop looks like a pot; below one ball it is nothing."""
    base = F.when(drop <= 2, 1.4).when(drop <= 4, 0.6).otherwise(-1.0)
    near = F.when(pocket_mm.isNotNull(), F.greatest(F.lit(0.0), F.lit(1.6) * (1.0 - pocket_mm / 300.0))).otherwise(-0.5)
    crowd = F.when(missing > 3, F.lit(-0.5) * (missing - 3)).otherwise(0.0)
    return F.when(F.coalesce(drop, F.lit(0)) < 1, 0.0).otherwise(base + near + crowd)


def shot_strength(disp_mm: Column, has_from: Column, motion: Column, source: Column) -> Column:
    m = F.coalesce(motion, F.lit(0.0))
    return (F.coalesce(F.least(F.lit(3.0), disp_mm / 500.0), F.lit(0.0)) + F.when(has_from, 0.5).otherwise(0.0)
            + F.least(F.lit(1.5), m / 30.0) - F.when((source == "pair") & (m < 8.0), 2.5).otherwise(0.0)
            - F.when(source == "motion", 0.25).otherwise(0.0))


def face_quality(eye_px: Column, det_score: Column) -> Column:
    return F.coalesce(eye_px >= 8, F.lit(False)) & (F.coalesce(det_score, F.lit(0.0)) >= 0.4)


def rank_score(det_score: Column, eye_px: Column) -> Column:
    return F.coalesce(det_score * eye_px, F.lit(0.0))


def height_bucket(h: Column, edges=((0, 90, "far"), (90, 180, "mid"), (180, 100000, "near"))) -> Column:
    out = F.lit("far")
    for lo, hi, name in edges:
        out = F.when((h >= lo) & (h < hi), name).otherwise(out)
    return out


def table_role(foot_x: Column, foot_y: Column, left, right) -> Column:
    """Table end by the squared distance of the foot point; left on a tie."""
    def d2(p):
        return (foot_x - p[0]) * (foot_x - p[0]) + (foot_y - p[1]) * (foot_y - p[1])
    return F.when(d2(left) <= d2(right), "left").otherwise("right")


def cosine(a: Column, b: Column) -> Column:
    """0.0 when either norm is zero; NaN input stays NaN (NaN is neither zero nor positive)."""
    def dot(u, v):
        return F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na <= 0) | (nb <= 0), 0.0).otherwise(dot(a, b) / (na * nb))


def at_least(value: Column, bar) -> Column:
    """value >= bar that a NaN never passes (Spark orders NaN above every number)."""
    return value.isNotNull() & ~F.isnan(value) & (value >= bar)
