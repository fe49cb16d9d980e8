"""Boxes and quadrilaterals as column expressions.

A quadrilateral is eight columns x1, y1 .. x4, y4 in the order top-left, top-right, bottom-right, bottom-left.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once however often body names it; inside a lambda a name is no such guarantee."""
    return F.get(F.transform(F.array(value), body), 0)


def apart(value: Column) -> Column:
    """value itself, which should be a plain column. The lambda keeps a projection out of whole-stage code, where hundreds of
    terms make one method that is too large for the JVM to compile; outside it they become small methods, and equal terms
    are computed once. What a lambda is given is interpreted, so large terms belong beside it and not in it."""
    return let(value, lambda v: v)


def corners(prefix: str = "") -> list[Point]:
    return [(F.col(f"{prefix}x{i}"), F.col(f"{prefix}y{i}")) for i in range(1, 5)]


# -- boxes ------------------------------------------------------------------------------------------------------------


def bbox_properties(x1: Column, y1: Column, x2: Column, y2: Column) -> dict[str, Column]:
    """width, height, area (signed), aspect (0 without height) and centre."""
    w, h = x2 - x1, y2 - y1
    return {"width": w, "height": h, "area": w * h, "aspect": F.when(h == 0, 0.0).otherwise(w / h), "center_x": (x1 + x2) / 2, "center_y": (y1 + y2) / 2}


def bbox_valid(x1: Column, y1: Column, x2: Column, y2: Column, max_x: Column, max_y: Column) -> Column:
    return (x1 < x2) & (y1 < y2) & (x1 >= 0) & (y1 >= 0) & (x2 <= max_x) & (y2 <= max_y)


def bbox_to_list(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.array(x1, y1, x2, y2)


def bbox_from_list(a: Column) -> Column:
    return F.struct(*[F.get(a, i).cast("int").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


def scale_bbox(box: list[Column], sx: Column, sy: Column) -> list[Column]:
    """Coordinates scaled and cut to whole numbers toward zero."""
    return [(c * (sx if i % 2 == 0 else sy)).cast("long") for i, c in enumerate(box)]


def detection_scale(w: Column, h: Column, target: int) -> dict[str, Column]:
    """Scale and size of an image fitted to a largest side; small images stay."""
    most = F.greatest(w, h)
    scale = F.when(most <= target, 1.0).otherwise(F.lit(float(target)) / most)
    return {"scale": scale, "scaled_w": (w * scale).cast("long"), "scaled_h": (h * scale).cast("long")}


# -- quadrilaterals ---------------------------------------------------------------------------------------------------


def distance(a: Point, b: Point) -> Column:
    return F.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]))


def is_convex(q: list[Point]) -> Column:
    """All turns the same way; a straight one counts as neither."""
    turns = []
    for i in range(4):
        a, b, c = q[i], q[(i + 1) % 4], q[(i + 2) % 4]
        turns.append((b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0]))
    every = lambda xs: reduce(lambda x, y: x & y, xs)
    return every([t > 0 for t in turns]) | every([t < 0 for t in turns])


def area(q: list[Point]) -> Column:
    """Shoelace."""
    total = reduce(lambda x, y: x + y, [q[i][0] * q[(i + 1) % 4][1] - q[(i + 1) % 4][0] * q[i][1] for i in range(4)])
    return F.abs(total) / 2.0


def bounds(q: list[Point]) -> dict[str, Column]:
    """Smallest box around a quadrilateral in whole pixels."""
    xs, ys = [p[0] for p in q], [p[1] for p in q]
    return {"bx1": F.floor(F.least(*xs)), "by1": F.floor(F.least(*ys)), "bx2": F.ceil(F.greatest(*xs)), "by2": F.ceil(F.greatest(*ys))}


def rectangularity(q: list[Point]) -> Column:
    xs, ys = [p[0] for p in q], [p[1] for p in q]
    box = (F.greatest(*xs) - F.least(*xs)) * (F.greatest(*ys) - F.least(*ys))
    return F.when(box > 0, area(q) / box).otherwise(0.0)


def convexity(contour_area: Column, hull_area: Column) -> Column:
    return F.when(hull_area > 0, contour_area / hull_area).otherwise(0.0)


def polygon_area(points: Column) -> Column:
    """Area of a polygon given as an array of points (x, y) in order."""

    def total(ps: Column) -> Column:
        after = lambda i: F.get(ps, (i + 1) % F.size(ps))
        turns = F.transform(ps, lambda p, i: p["x"] * after(i)["y"] - after(i)["x"] * p["y"])
        return F.abs(F.aggregate(turns, F.lit(0.0), lambda a, x: a + x)) / 2.0

    return let(points, total)


def hull(points: Column) -> Column:
    """Corners of the convex hull of an array of points (x, y): from the leftmost along the lower chain, then the upper.

    A chain is a fold over the sorted points with a stack: each point drops the corners that no longer turn left. Those are
    the last ones, so the corners kept are counted instead of popped one by one."""
    cross = lambda a, b, c: (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])
    ordered = F.array_sort(F.array_distinct(F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))))

    def push(stack: Column, p: Column) -> Column:
        left = F.filter(stack, lambda b, i: (i > 0) & (cross(F.get(stack, F.greatest(i - 1, F.lit(0))), b, p) > 0))
        keep = F.when(F.size(stack) < 2, F.size(stack)).otherwise(1 + F.size(left))
        return F.concat(F.slice(stack, F.lit(1), keep), F.array(p))

    chain = lambda ps: F.aggregate(ps, F.slice(ps, F.lit(1), F.lit(0)), push)
    most = lambda c: F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0)))
    return let(ordered, lambda ps: F.when(F.size(ps) < 2, ps).otherwise(F.concat(most(chain(ps)), most(chain(F.reverse(ps))))))


def polygon_convexity(points: Column) -> Column:
    """Area of a polygon over that of its hull; 0 where the hull has none."""
    return convexity(polygon_area(points), polygon_area(hull(points)))


def aspect_ratio(q: list[Point]) -> Column:
    """Mean of top and bottom over mean of left and right side."""
    w = (distance(q[0], q[1]) + distance(q[3], q[2])) / 2.0
    h = (distance(q[0], q[3]) + distance(q[1], q[2])) / 2.0
    return F.when(h > 0, w / h).otherwise(0.0)


def angles(q: list[Point]) -> list[Column]:
    """Inner angle at each corner in degrees; 0 beside a side without length."""
    out = []
    for i in range(4):
        p, a, b = q[i], q[(i - 1) % 4], q[(i + 1) % 4]
        ux, uy, vx, vy = a[0] - p[0], a[1] - p[1], b[0] - p[0], b[1] - p[1]
        n = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)
        out.append(F.when(n > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / n))))).otherwise(0.0))
    return out


def ordered(points: list[Point]) -> list[Column]:
    """Four points in any order as x1, y1 .. x4, y4: the two upper ones from left to right, the two lower ones from right
    to left. Ties keep the order of input."""
    made = F.array(*[F.struct(y.cast("double").alias("y"), F.lit(i).alias("i"), x.cast("double").alias("x")) for i, (x, y) in enumerate(points)])
    byy = F.array_sort(made)
    pair = lambda a, b: F.array_sort(F.transform(F.slice(byy, a, b), lambda p: F.struct(p["x"].alias("x"), p["i"].alias("i"), p["y"].alias("y"))))
    top, low = pair(1, 2), pair(3, 2)
    seq = [F.get(top, 0), F.get(top, 1), F.get(low, 1), F.get(low, 0)]
    return [p[c] for p in seq for c in ("x", "y")]


def flaws(q: list[Point], w: Column, h: Column, closest: float = 50.0, most_deviation: float = 45.0) -> list[tuple[Column, Column]]:
    """What can be wrong with a quadrilateral in an image, in a fixed order: whether it is (null: no), and the text that says so."""
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    out = [(~is_convex(q), F.lit("Corners do not form a convex quadrilateral")), (~is_convex(q), F.lit("Corner edges self-intersect"))]
    for i, (x, y) in enumerate(q):
        out.append(((x < 0) | (x > w), text(f"Corner {i} x-coordinate (", x, ") outside image bounds [0, ", w, "]")))
        out.append(((y < 0) | (y > h), text(f"Corner {i} y-coordinate (", y, ") outside image bounds [0, ", h, "]")))
    for i in range(4):
        for j in range(i + 1, 4):
            d = distance(q[i], q[j])
            out.append((d < closest, text(f"Corners {i} and {j} are too close (", F.format_string("%.1f", d), f"px < {closest:.0f}px)")))
    for i, a in enumerate(angles(q)):
        out.append((F.abs(a - 90.0) > most_deviation, text(f"Corner {i} angle (", F.format_string("%.1f", a), "°) deviates too much from 90°")))
    return out


def texts(found: list[tuple[Column, Column]]) -> Column:
    """The texts of those flaws that are there."""
    return F.concat(*[F.when(bad, F.array(text)).otherwise(F.array().cast("array<string>")) for bad, text in found])


def number(found: list[tuple[Column, Column]]) -> Column:
    """How many of these flaws are there; no text is made."""
    return reduce(lambda a, b: a + b, [F.when(bad, 1).otherwise(0) for bad, _ in found])


def issues(q: list[Point], w: Column, h: Column, closest: float = 50.0, most_deviation: float = 45.0) -> Column:
    """What is wrong with a quadrilateral in an image, in a fixed order."""
    return texts(flaws(q, w, h, closest, most_deviation))


# -- perspective ------------------------------------------------------------------------------------------------------


def projection(q: list[Point], width: int = 1000, height: int = 630) -> list[Column]:
    """Row-major 3 x 3 matrix, up to a factor, that takes the corners (as single-precision numbers) to those of a width x
    height canvas; null where three corners are in line.

    Each side opposite a corner of the first three is a line's equation, scaled to 1 at the fourth corner; the rows are
    sums of these. The order of operations decides the last bits, which show where an element is rounded at a tie."""
    e, f, g, t = [(x.cast("float").cast("double"), y.cast("float").cast("double")) for x, y in q]
    det = lambda a, b, c: a[0] * (b[1] - c[1]) - a[1] * (b[0] - c[0]) + (b[0] * c[1] - c[0] * b[1])
    line = lambda a, b, by: [F.try_divide(v, by) for v in (a[1] - b[1], b[0] - a[0], a[0] * b[1] - a[1] * b[0])]
    p, s, r = line(f, g, det(t, f, g)), line(g, e, det(e, t, g)), line(e, f, det(e, f, t))
    return [(width - 1.0) * (r[i] - s[i]) for i in range(3)] + [(height - 1.0) * r[i] for i in range(3)] + [p[i] - s[i] + r[i] for i in range(3)]


def homography(q: list[Point], width: int = 1000, height: int = 630) -> Column:
    """projection() with its last element 1. Null where three corners are in line or no such matrix exists."""
    turn = lambda a, b, c: (q[b][0] - q[a][0]) * (q[c][1] - q[a][1]) - (q[b][1] - q[a][1]) * (q[c][0] - q[a][0])
    bent = reduce(lambda a, b: a & b, [turn(i, (i + 1) % 4, (i + 2) % 4) != 0 for i in range(4)])
    rows = projection(q, width, height)
    return F.when(bent & (rows[8] != 0), F.array(*[F.try_divide(x, rows[8]) for x in rows]))


def transform_point(m: list[Column], x: Column, y: Column) -> Point:
    w = m[6] * x + m[7] * y + m[8]
    return (m[0] * x + m[1] * y + m[2]) / w, (m[3] * x + m[4] * y + m[5]) / w


def adjugate(m: list[Column]) -> list[Column]:
    """Adjugate of a 3 x 3 matrix: its inverse but for a factor, which transform_point() divides out."""
    a, b, c, d, e, f, g, h, i = m
    return [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]


def inverse(m: list[Column]) -> list[Column]:
    """Inverse of a 3 x 3 matrix by its adjugate."""
    a, b, c, d, e, f, g, h, i = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    return [x / det for x in adjugate(m)]


def map_bbox(m: list[Column], box: list[Column], width: Column, height: Column) -> list[Column]:
    """A box moved by a matrix: the smallest whole-pixel box around its corners, inside the canvas."""
    x1, y1, x2, y2 = box
    pts = [transform_point(m, x, y) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))]
    inside = lambda v, most: F.greatest(F.lit(0).cast("long"), F.least(most.cast("long"), v))
    xs, ys = [p[0] for p in pts], [p[1] for p in pts]
    return [inside(F.floor(F.least(*xs)), width), inside(F.floor(F.least(*ys)), height), inside(F.ceil(F.greatest(*xs)), width), inside(F.ceil(F.greatest(*ys)), height)]

