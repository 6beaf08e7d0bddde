"""Planar geometry as native columns: maps, projection, pockets, quads and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The canonical table in millimetres and its six pockets (order breaks ties).
TABLE_W, TABLE_H = 1270.0, 2540.0
POCKETS = (
    ("head-left", 0.0, 0.0),
    ("head-right", 1270.0, 0.0),
    ("foot-right", 1270.0, 2540.0),
    ("foot-left", 0.0, 2540.0),
    ("left-side", 0.0, 1270.0),
    ("right-side", 1270.0, 1270.0),
)
POCKET_RADIUS_MM = 100.0
HORIZON = 1e-12
PIXEL_HORIZON = 1e-9
# Measured ball size.
BALL_WIDTH_MM = 57.15
NATIVE_FRAME = (1280, 720)
WORKING_FRAME = (960, 540)
BALL_DIAMETER_NATIVE_PX = 18.9


def lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def point(x, y) -> Column:
    return F.struct(lit(x).cast("double").alias("x"), lit(y).cast("double").alias("y"))


def corners(quad: Column) -> list[tuple[Column, Column]]:
    return [(quad[i]["x"], quad[i]["y"]) for i in range(4)]


def stage(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns in one projection; staging keeps shared terms from being inlined many times."""
    return df.withColumns(cols)


def let(value: Column, body) -> Column:
    """Bind a shared term once inside an expression: body(value) without inlining it.

    A higher-order function keeps one copy of the term, where plain nesting (or staged
    columns under a join) would multiply it in the optimizer.  Meant for per-segment work.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _unit_map(quad: Column, body) -> Column:
    """body(coefficients a..h of unit square -> quad), closed form."""
    def deltas(q):
        (x0, y0), (x1, y1), (x2, y2), (x3, y3) = corners(q)
        return F.struct(*[v.alias(n) for n, v in dict(
            dx1=x1 - x2, dx2=x3 - x2, sx=x0 - x1 + x2 - x3, dy1=y1 - y2, dy2=y3 - y2, sy=y0 - y1 + y2 - y3).items()])

    def bends(v):
        den = F.nullif(v["dx1"] * v["dy2"] - v["dx2"] * v["dy1"], F.lit(0.0))
        return F.struct(((v["sx"] * v["dy2"] - v["dx2"] * v["sy"]) / den).alias("g"),
                        ((v["dx1"] * v["sy"] - v["sx"] * v["dy1"]) / den).alias("h"))

    def coefficients(q, b):
        (x0, y0), (x1, y1), (x2, y2), (x3, y3) = corners(q)
        g, h = b["g"], b["h"]
        return F.struct((x1 - x0 + g * x1).alias("a"), (x3 - x0 + h * x3).alias("b"), x0.alias("c"),
                        (y1 - y0 + g * y1).alias("d"), (y3 - y0 + h * y3).alias("e"), y0.alias("f"), g.alias("g"), h.alias("h"))

    return let(quad, lambda q: let(deltas(q), lambda v: let(bends(v), lambda b: let(
        coefficients(q, b), lambda m: F.when(m["g"].isNotNull(), body(m))))))


def target_extent(landscape: bool = False, inset: bool = True) -> tuple[float, float]:
    """Target rectangle; the inset ring is one millimetre short on both axes."""
    w, h = (TABLE_H, TABLE_W) if landscape else (TABLE_W, TABLE_H)
    return (w - 1, h - 1) if inset else (w, h)


def homography(quad: Column, landscape: bool = False, inset: bool = True) -> Column:
    """Row-major 3x3 map of quad [TL,TR,BR,BL] to the canonical rectangle, last entry 1.

    The target is a rectangle, so the map is the scaled adjugate of the unit-square map
    and no linear solver is needed; null when the quad is degenerate.
    """
    w, h_ = target_extent(landscape, inset)

    def adjugate(m):
        a, b, c, d, e, f, g, h = [m[n] for n in "abcdefgh"]
        rows = [(e - f * h, c * h - b, b * f - c * e), (f * g - d, a - c * g, c * d - a * f),
                (d * h - e * g, b * g - a * h, a * e - b * d)]
        scaled = F.array(*[F.lit(s) * v for r, s in zip(rows, (w, h_, 1.0)) for v in r])
        return let(scaled, lambda v: F.when(v[8] != 0, F.transform(v, lambda e: e / v[8])))

    return _unit_map(quad, adjugate)


def inverse_homography(quad: Column, landscape: bool = False, inset: bool = True) -> Column:
    """Canonical millimetres -> pixels: the unit-square map with its columns rescaled."""
    w, h_ = target_extent(landscape, inset)
    return _unit_map(quad, lambda m: F.array(
        m["a"] / w, m["b"] / h_, m["c"], m["d"] / w, m["e"] / h_, m["f"], m["g"] / w, m["h"] / h_, F.lit(1.0)))


def invert_h(m: Column) -> Column:
    """Adjugate inverse of any row-major 3x3 map."""
    a, b, c, d, e, f, g, h, i = [m[k] for k in range(9)]
    adj = [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f,
           d * h - e * g, b * g - a * h, a * e - b * d]
    det = F.nullif(a * adj[0] + b * adj[3] + c * adj[6], F.lit(0.0))
    return F.when(det.isNotNull(), F.array(*[v / det for v in adj]))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def project(m: Column, x, y, tol: float = HORIZON) -> Column:
    """STRUCT<x,y>, or null at the horizon (|w| < tol) and for non-finite input."""
    x, y = lit(x), lit(y)
    u = m[0] * x + m[1] * y + m[2]
    v = m[3] * x + m[4] * y + m[5]
    w = m[6] * x + m[7] * y + m[8]
    size = F.abs(w)  # NaN sorts above every number, so the upper bound rejects it too
    safe = F.when((size >= tol) & (size <= 1.7976931348623157e308), w)
    px, py = u / safe, v / safe
    return F.when(finite(px) & finite(py), point(px, py))


def distance(ax, ay, bx, by) -> Column:
    return F.hypot(lit(ax) - lit(bx), lit(ay) - lit(by))


def nearest_pocket(x, y, pockets=POCKETS) -> Column:
    """STRUCT<dist,ord,pocket>; equal distances go to the earlier pocket."""
    return F.array_min(F.array(*[
        F.struct(distance(x, y, px, py).alias("dist"), F.lit(i).alias("ord"), F.lit(n).alias("pocket"))
        for i, (n, px, py) in enumerate(pockets)
    ]))


def in_quad(x, y, quad: Column) -> Column:
    """Inside or on a convex quad: the four cross products share a sign; null without a quad."""
    p = corners(quad)
    s = [(bx - ax) * (lit(y) - ay) - (by - ay) * (lit(x) - ax) for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1])]
    pos, neg = s[0] >= 0, s[0] <= 0
    for v in s[1:]:
        pos, neg = pos & (v >= 0), neg & (v <= 0)
    return F.when(quad.isNotNull(), pos | neg)


def on_table(x, y, margin: float = 0.0) -> Column:
    return (x >= -margin) & (x <= TABLE_W + margin) & (y >= -margin) & (y <= TABLE_H + margin)


def in_frame(x, y, width: float, height: float, margin: float = 20.0) -> Column:
    return (lit(x) >= margin) & (lit(x) <= width - margin) & (lit(y) >= margin) & (lit(y) <= height - margin)


def with_pocket_membership(df: DataFrame, m: Column, x, y, err_px: float, out: str = "membership",
                           radius_mm: float = POCKET_RADIUS_MM) -> DataFrame:
    """STRUCT<pocket,distance_mm,uncertainty_mm,verdict> with first-order error propagation.

    The uncertainty is err * |J^T u| along the pocket->ball direction; at zero distance it
    is the larger Jacobian column.  A gate met only inside the error bar is ``ambiguous``.
    """
    df = stage(df, _here=project(m, x, y), _right=project(m, lit(x) + 1.0, y), _down=project(m, x, lit(y) + 1.0))
    here, right, down = F.col("_here"), F.col("_right"), F.col("_down")
    df = stage(df, _near=nearest_pocket(here["x"], here["y"]))
    centre = F.array(*[point(px, py) for _, px, py in POCKETS])[F.col("_near.ord")]
    safe = F.nullif(F.col("_near.dist"), F.lit(0.0))
    df = stage(df, _ux=(here["x"] - centre["x"]) / safe, _uy=(here["y"] - centre["y"]) / safe,
               _jxx=right["x"] - here["x"], _jxy=right["y"] - here["y"], _jyx=down["x"] - here["x"], _jyy=down["y"] - here["y"])
    ux, uy, jxx, jxy, jyx, jyy = [F.col(c) for c in ("_ux", "_uy", "_jxx", "_jxy", "_jyx", "_jyy")]
    worst = F.greatest(F.hypot(jxx, jxy), F.hypot(jyx, jyy))
    along = F.hypot(jxx * ux + jyx * uy, jxy * ux + jyy * uy)
    df = stage(df, _bar=F.lit(err_px) * F.when(F.col("_near.dist") <= 1e-9, worst).otherwise(along))
    d, bar = F.col("_near.dist"), F.col("_bar")
    verdict = F.when(d + bar <= radius_mm, "inside").when(d - bar > radius_mm, "outside").otherwise("ambiguous")
    return df.withColumn(out, F.when(here.isNotNull(), F.struct(
        F.col("_near.pocket").alias("pocket"), d.alias("distance_mm"), bar.alias("uncertainty_mm"), verdict.alias("verdict")))
    ).drop("_here", "_right", "_down", "_near", "_ux", "_uy", "_jxx", "_jxy", "_jyx", "_jyy", "_bar")


def singular_axes(jx: tuple, jy: tuple) -> Column:
    """Semi-axes of the image of the unit disc under the 2x2 Jacobian [jx jy]."""
    (a, b), (c, d) = jx, jy
    mean = (a * a + b * b + c * c + d * d) / 2.0
    off = F.sqrt(F.pow((a * a + b * b - c * c - d * d) / 2.0, F.lit(2.0)) + F.pow(a * c + b * d, F.lit(2.0)))
    return F.struct(F.sqrt(F.greatest(F.lit(0.0), mean + off)).alias("big"),
                    F.sqrt(F.greatest(F.lit(0.0), mean - off)).alias("small"))


def local_mm_per_px(m: Column, x, y, step: float = 6.0) -> Column:
    """Mean stretch over the four axis steps that project."""
    here = project(m, x, y)
    steps = F.array(*[
        distance(p["x"], p["y"], here["x"], here["y"]) / step
        for p in (project(m, lit(x) + dx, lit(y) + dy) for dx, dy in ((step, 0.0), (-step, 0.0), (0.0, step), (0.0, -step)))
    ])
    seen = F.filter(steps, lambda v: v.isNotNull())
    return F.when(F.size(seen) > 0, F.aggregate(seen, F.lit(0.0), lambda s, v: s + v) / F.size(seen))


def _overlap(a: list[Column], b: list[Column]) -> Column:
    ix = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    iy = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return ix * iy


def iou(a: list[Column], b: list[Column]) -> Column:
    inter = _overlap(a, b)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.when(union > 0, inter / F.nullif(union, F.lit(0.0))).otherwise(0.0)


def face_area_iou(face: list[Column], person: list[Column]) -> Column:
    area = (face[2] - face[0]) * (face[3] - face[1])
    return F.when(area > 0, _overlap(face, person) / F.nullif(area, F.lit(0.0))).otherwise(0.0)


def center_inside(box: list[Column], person: list[Column]) -> Column:
    cx, cy = (box[0] + box[2]) / 2.0, (box[1] + box[3]) / 2.0
    return (person[0] <= cx) & (cx <= person[2]) & (person[1] <= cy) & (cy <= person[3])


def quad_area_px(quad: Column) -> Column:
    """Two triangles sharing corner 0: (p0,p1,p3) and (p0,p3,p2)."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = corners(quad)
    t1 = F.abs((x1 - x0) * (y3 - y0) - (y1 - y0) * (x3 - x0))
    t2 = F.abs((x3 - x0) * (y2 - y0) - (y3 - y0) * (x2 - x0))
    return (t1 + t2) / 2.0


def quad_sanity(quad: Column, width, height, edge: float = 2.0, corner: float = 8.0,
                lo: float = 0.02, hi: float = 0.9) -> Column:
    """First failing reason, null when sane."""
    p = corners(quad)
    bad = F.size(quad) != 4
    outside = F.lit(False)
    for x, y in p:
        bad = bad | ~finite(x) | ~finite(y)
        outside = outside | (x < -edge) | (y < -edge) | (x > lit(width) + edge) | (y > lit(height) + edge)
    tight = F.lit(False)
    for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1]):
        tight = tight | (distance(ax, ay, bx, by) < corner)
    share = quad_area_px(quad) / (lit(width) * lit(height))
    return (F.when(quad.isNull() | bad, "malformed").when(outside, "outside frame").when(tight, "degenerate corner")
            .when(~((share >= lo) & (share <= hi)), F.format_string("implausible area %.1f%%", share * 100)))


def _angle(ax, ay, bx, by) -> Column:
    def length(u, v):
        return F.coalesce(F.nullif(F.hypot(u, v), F.lit(0.0)), F.lit(1e-9))
    c = (ax * bx + ay * by) / (length(ax, ay) * length(bx, by))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def parallelism(quad: Column) -> tuple[Column, Column]:
    """Angles (long, short) between opposite edges walked the same way, degrees."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = corners(quad)
    return _angle(x1 - x0, y1 - y0, x2 - x3, y2 - y3), _angle(x3 - x0, y3 - y0, x2 - x1, y2 - y1)


def turn_signs(quad: Column) -> list[Column]:
    p = corners(quad)
    out = []
    for i in range(4):
        (ax, ay), (bx, by), (cx, cy) = p[i], p[(i + 1) % 4], p[(i + 2) % 4]
        out.append(F.signum((bx - ax) * (cy - by) - (by - ay) * (cx - bx)).cast("int"))
    return out


def with_quad_check(df: DataFrame, quad: str, out: str = "check", parallel_tol: float = 3.0, aspect: float = 2.0) -> DataFrame:
    """STRUCT<ok,reasons,long_deg,short_deg,perspective,aspect> of a playfield quad."""
    p = corners(F.col(quad))
    long_deg, short_deg = parallelism(F.col(quad))
    top, rgt, bot, lft = [distance(*p[i], *p[(i + 1) % 4]) for i in range(4)]
    df = stage(df, _long=long_deg, _short=short_deg, _top=top, _rgt=rgt, _bot=bot, _lft=lft,
               _signs=F.array(*turn_signs(F.col(quad))))
    xs, ys = [x for x, _ in p], [y for _, y in p]
    flat = (F.greatest(*xs) - F.least(*xs) < 8) | (F.greatest(*ys) - F.least(*ys) < 8)
    top, rgt, bot, lft = [F.col(c) for c in ("_top", "_rgt", "_bot", "_lft")]
    convex = (F.array_min("_signs") > 0) | (F.array_max("_signs") < 0)

    def gap(a, b):
        return F.abs(a - b) / F.nullif(F.greatest(a, b), F.lit(0.0))
    persp = F.when(F.least(top, rgt, bot, lft) <= 1e-6, 1.0).otherwise(F.greatest(gap(top, bot), gap(lft, rgt)))
    df = stage(df, _persp=persp, _aspect=(top + bot) / F.nullif(lft + rgt, F.lit(0.0)))
    reasons = F.when(flat, F.array(F.lit("degenerate"))).otherwise(F.array_compact(F.array(
        F.when(~convex, "not-convex"), F.when(F.least("_long", "_short") > parallel_tol, "no-parallel-pair"),
        F.when(F.col("_aspect") < aspect * 0.55, "aspect-too-square"))))
    df = stage(df, _reasons=reasons)
    return df.withColumn(out, F.struct(
        (F.size("_reasons") == 0).alias("ok"), F.col("_reasons").alias("reasons"), F.col("_long").alias("long_deg"),
        F.col("_short").alias("short_deg"), F.col("_persp").alias("perspective"), F.col("_aspect").alias("aspect"))
    ).drop("_long", "_short", "_top", "_rgt", "_bot", "_lft", "_signs", "_persp", "_aspect", "_reasons")


def quad_distance(quad: Column, ref: Column) -> Column:
    """Best of the four cyclic alignments: STRUCT<mean,shift,max> over the four corners."""
    q, r = corners(quad), corners(ref)
    options = []
    for s in range(4):
        d = [distance(*r[i], *q[(i + s) % 4]) for i in range(4)]
        options.append(F.struct(((d[0] + d[1] + d[2] + d[3]) / 4.0).alias("mean"), F.lit(s).alias("shift"),
                                F.greatest(*d).alias("max")))
    return F.array_min(F.array(*options))


def scale_between(from_frame, to_frame) -> Column:
    """Linear scale between two frame sizes, by width."""
    return lit(to_frame[0]) / lit(from_frame[0])


def ball_diameter_px(frame) -> Column:
    return F.lit(BALL_DIAMETER_NATIVE_PX) * scale_between((float(NATIVE_FRAME[0]), 0), frame)


def ball_area_px2(frame) -> Column:
    return F.pi() * F.pow(ball_diameter_px(frame) / 2.0, F.lit(2.0))


def ball_mm_per_px(frame) -> Column:
    return F.lit(BALL_WIDTH_MM) / ball_diameter_px(frame)


def _clip(poly: Column, axis: str, bound: Column, sign: float) -> Column:
    """One half-plane cut of a convex polygon: keep sign*(axis - bound) >= 0."""
    other = "y" if axis == "x" else "x"
    n = F.size(poly)

    def step(p, i):
        q = poly[F.pmod(i + n - 1, n)]
        pin, qin = sign * (p[axis] - bound) >= 0, sign * (q[axis] - bound) >= 0
        k = (bound - q[axis]) / F.nullif(p[axis] - q[axis], F.lit(0.0))
        cross = q[other] + k * (p[other] - q[other])
        cut = point(bound, cross) if axis == "x" else point(cross, bound)
        none = F.expr("cast(array() as array<struct<x:double,y:double>>)")
        return F.concat(F.when(pin != qin, F.array(cut)).otherwise(none), F.when(pin, F.array(p)).otherwise(none))

    return F.flatten(F.transform(poly, step))


def polygon_area(poly: Column) -> Column:
    n = F.size(poly)
    terms = F.transform(poly, lambda p, i: p["x"] * poly[F.pmod(i + 1, n)]["y"] - poly[F.pmod(i + 1, n)]["x"] * p["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)) / 2.0


def clip_to_box(quad: Column, box: list[Column]) -> list[tuple[str, Column, float]]:
    return [("x", box[0], 1.0), ("x", box[2], -1.0), ("y", box[1], 1.0), ("y", box[3], -1.0)]


def edge_distance(quad: Column, x: Column, y: Column) -> Column:
    """Distance to the quad's boundary, negative outside."""
    p = corners(quad)
    best = []
    for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1]):
        ex, ey = bx - ax, by - ay
        along = (x - ax) * ex + (y - ay) * ey
        size = ex * ex + ey * ey
        side = F.abs(ex * (y - ay) - ey * (x - ax)) / F.sqrt(F.nullif(size, F.lit(0.0)))
        best.append(F.when(along <= 0, F.hypot(x - ax, y - ay)).when(along >= size, F.hypot(x - bx, y - by)).otherwise(side))
    return F.when(in_quad(x, y, quad), F.least(*best)).otherwise(-F.least(*best))
