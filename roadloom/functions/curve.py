"""Polyline algebra as Column expressions. A curve is ARRAY<STRUCT<y: DOUBLE, x: DOUBLE>>."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(y: Column, x: Column) -> Column:
    return F.struct(y.cast("double").alias("y"), x.cast("double").alias("x"))


def distance(a: Column, b: Column) -> Column:
    dy, dx = a["y"] - b["y"], a["x"] - b["x"]
    return F.sqrt(dy * dy + dx * dx)


def segments(curve: Column) -> Column:
    """Consecutive point pairs as structs (a, b)."""
    n = F.size(curve)
    return F.when(n > 1, F.zip_with(F.slice(curve, 1, n - 1), F.slice(curve, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def segment_lengths(curve: Column) -> Column:
    return F.transform(segments(curve), lambda s: distance(s["a"], s["b"]))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def length(curve: Column) -> Column:
    """Sum of segment lengths; 0 for a single point."""
    return F.coalesce(total(segment_lengths(curve)), F.lit(0.0))


def cumulative(lengths: Column) -> Column:
    """Running sums, from 0 on: one more element than ``lengths``."""
    return F.aggregate(lengths, F.array(F.lit(0.0)), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))


def bounding_box(curve: Column, padding: float = 0.0) -> Column:
    ys, xs = F.transform(curve, lambda p: p["y"]), F.transform(curve, lambda p: p["x"])
    return F.struct((F.array_min(ys) - padding).alias("miny"), (F.array_min(xs) - padding).alias("minx"), (F.array_max(ys) + padding).alias("maxy"), (F.array_max(xs) + padding).alias("maxx"))


def pad_bounding_box(box: Column, padding: float) -> Column:
    return F.struct((box["miny"] - padding).alias("miny"), (box["minx"] - padding).alias("minx"), (box["maxy"] + padding).alias("maxy"), (box["maxx"] + padding).alias("maxx"))


def boxes_overlap(a: Column, b: Column) -> Column:
    """Closed intersection."""
    return (a["miny"] <= b["maxy"]) & (b["miny"] <= a["maxy"]) & (a["minx"] <= b["maxx"]) & (b["minx"] <= a["maxx"])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _upto(curve: Column) -> Column:
    return cumulative(F.coalesce(segment_lengths(curve), F.array().cast("array<double>")))


def _at(curve: Column, upto: Column, goal: Column) -> Column:
    """The point after a length: on the first segment whose end lies beyond it, or the last point."""

    def on(i: Column) -> Column:
        a, b = F.element_at(curve, i), F.element_at(curve, i + 1)
        t = F.try_divide(goal - F.element_at(upto, i), F.element_at(upto, i + 1) - F.element_at(upto, i))
        return F.when(i >= F.size(upto), F.element_at(curve, -1)).otherwise(let(t, lambda t: point(a["y"] + t * (b["y"] - a["y"]), a["x"] + t * (b["x"] - a["x"]))))

    return let(F.size(F.filter(upto, lambda u: u <= goal)), lambda n: on(F.greatest(n, F.lit(1))))


def position_at(curve: Column, fraction: Column) -> Column:
    """The point at a fraction of arc length; the last point from 1 on."""
    return let(_upto(curve), lambda u: F.when(fraction >= 1, F.element_at(curve, -1)).otherwise(let(fraction * F.element_at(u, -1), lambda g: _at(curve, u, g))))


def _part(curve: Column, upto: Column, low: Column, high: Column) -> Column:
    """The part between two lengths, vertices strictly between them kept."""
    between = F.filter(F.sequence(F.lit(1), F.size(curve)), lambda i: (F.element_at(upto, i) > low + 1e-9) & (F.element_at(upto, i) < high - 1e-9))
    return F.concat(F.array(_at(curve, upto, low)), F.transform(between, lambda i: F.element_at(curve, i)), F.array(_at(curve, upto, high)))


def cut(curve: Column, low: Column, high: Column) -> Column:
    """The part of a curve between two fractions of its length."""
    return let(_upto(curve), lambda u: _part(curve, u, low * F.element_at(u, -1), high * F.element_at(u, -1)))


def cut_intervals(curve: Column, fractions: Column) -> Column:
    """Pieces between consecutive fractions (those in (0, 1), sorted), the ends included."""
    inner = F.filter(F.array_sort(F.array_distinct(fractions)), lambda f: (f > 1e-5) & (f < 1 - 1e-5))
    every = F.concat(F.array(F.lit(0.0)), inner, F.array(F.lit(1.0)))
    ends = lambda f, w: F.slice(f, w, F.size(f) - 1)
    return let(_upto(curve), lambda u: let(every, lambda f: F.zip_with(ends(f, 1), ends(f, 2), lambda a, b: _part(curve, u, a * F.element_at(u, -1), b * F.element_at(u, -1)))))


def cut_pieces(curve: Column, pieces: Column | int) -> Column:
    """Equal pieces."""
    n = F.lit(pieces) if isinstance(pieces, int) else pieces
    step = lambda u: F.element_at(u, -1) / n
    return let(_upto(curve), lambda u: F.transform(F.sequence(F.lit(0), n - 1), lambda i: _part(curve, u, i * step(u), (i + 1) * step(u))))


def cut_max_distance(curve: Column, most: float = 10.0) -> Column:
    """The curve itself if it is no longer than ``most``, else ceil(length / most) equal pieces."""
    own = length(curve)
    return F.when(own <= most, F.array(curve)).otherwise(cut_pieces(curve, F.ceil(own / most).cast("int")))


def nearest_on_segment(a: Column, b: Column, p: Column) -> Column:
    """(distance, y, x, t): clamped projection; t is 0 on a degenerate segment."""
    dy, dx = b["y"] - a["y"], b["x"] - a["x"]
    flat = (F.abs(dy) < 1e-4) & (F.abs(dx) < 1e-4)
    t = F.when(flat, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((p["y"] - a["y"]) * dy + (p["x"] - a["x"]) * dx, dy * dy + dx * dx))))
    spot = lambda t: F.struct((a["y"] + t * dy).alias("y"), (a["x"] + t * dx).alias("x"), t.alias("t"))
    return let(let(t, spot), lambda q: F.struct(distance(q, p).alias("distance"), q["y"].alias("y"), q["x"].alias("x"), q["t"].alias("t")))


def distance_to_segment(ay: Column, ax: Column, by: Column, bx: Column, y: Column, x: Column) -> Column:
    """The distance of ``nearest_on_segment`` without functions of arrays, which Spark does not compile."""
    dy, dx = by - ay, bx - ax
    flat = (F.abs(dy) < 1e-4) & (F.abs(dx) < 1e-4)
    t = F.when(flat, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((y - ay) * dy + (x - ax) * dx, dy * dy + dx * dx))))
    fy, fx = ay + t * dy - y, ax + t * dx - x
    return F.sqrt(fy * fy + fx * fx)


def nearest_on_curve(curve: Column, p: Column) -> Column:
    """(distance, index, y, x, fraction) of the curve's nearest point to ``p``; the first of equal segments wins."""

    def of(upto: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            def found(near: Column) -> Column:
                along = F.element_at(upto, i + 1) + near["t"] * (F.element_at(upto, i + 2) - F.element_at(upto, i + 1))
                return F.struct(near["distance"].alias("distance"), i.alias("index"), near["y"].alias("y"), near["x"].alias("x"), F.coalesce(F.try_divide(along, F.element_at(upto, -1)), F.lit(0.0)).alias("fraction"))

            return let(nearest_on_segment(s["a"], s["b"], p), found)

        return F.array_min(F.transform(segments(curve), one))

    return let(_upto(curve), of)


def rotate(p: Column, angle: Column) -> Column:
    """``p`` turned by ``angle`` about the origin, in (x, y) sense."""
    return point(p["x"] * F.sin(angle) + p["y"] * F.cos(angle), p["x"] * F.cos(angle) - p["y"] * F.sin(angle))


def to_linestring(curve: Column) -> Column:
    """Well-known text in (x, y) order."""
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(curve, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))


def from_linestring(text: Column) -> Column:
    body = F.regexp_extract(text, r"\((.*)\)", 1)
    return F.transform(F.split(body, r",\s*"), lambda s: point(F.split(s, " ")[1], F.split(s, " ")[0]))


def path_curve(curves: Column) -> Column:
    """Curves laid end to end, each first point that repeats the last one left out."""
    return F.aggregate(curves, F.slice(curves[0], 1, 0), lambda acc, c: F.when(F.size(acc) == 0, c).otherwise(F.concat(acc, F.slice(c, 2, F.size(c)))))


def ccw(a: Column, b: Column, c: Column) -> Column:
    return (c["y"] - a["y"]) * (b["x"] - a["x"]) > (b["y"] - a["y"]) * (c["x"] - a["x"])


def crosses(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Strict crossing of segments ab and cd."""
    return (ccw(a, c, d) != ccw(b, c, d)) & (ccw(a, b, c) != ccw(a, b, d))


def cosine(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Cosine of the angle between the directions ab and cd; null if one has no length."""
    dot = (b["y"] - a["y"]) * (d["y"] - c["y"]) + (b["x"] - a["x"]) * (d["x"] - c["x"])
    return F.try_divide(dot, distance(a, b) * distance(c, d))


def random_curve(points: Column | int, low: Column, high: Column, seed: Column) -> Column:
    """``points`` places, uniform in the box from ``low`` to ``high``; the same for the same ``seed``, in whatever task it is made."""
    unit = lambda i, axis: F.pmod(F.xxhash64(seed, i, F.lit(axis)), F.lit(1 << 52)) / float(1 << 52)
    along = lambda i, axis: low[axis] + unit(i, axis) * (high[axis] - low[axis])
    last = F.lit(points) if isinstance(points, int) else points
    every = F.filter(F.sequence(F.lit(0), last), lambda i: i < last)
    return F.transform(every, lambda i: point(along(i, "y"), along(i, "x")))


def cut_line(curve: Column, at: Column) -> Column:
    """The two parts before and after a distance along a curve; the curve alone if that is not strictly between its ends."""
    return let(length(curve), lambda own: F.when((at <= 0) | (at >= own) | own.isNull(), F.array(curve)).otherwise(F.array(cut(curve, F.lit(0.0), at / own), cut(curve, at / own, F.lit(1.0)))))


def unzip(pairs: Column, first: str, second: str) -> Column:
    """An array of two-field structs as a struct of two arrays."""
    return F.struct(F.transform(pairs, lambda p: p[first]).alias(first), F.transform(pairs, lambda p: p[second]).alias(second))


def closest_between(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Of the places a unit apart on a-b, from ``a``, the one with the least sum of distances to c and d (the first of equals)."""

    def place(i: Column) -> Column:
        return let(i / distance(a, b), lambda t: point(a["y"] * (1 - t) + b["y"] * t, a["x"] * (1 - t) + b["x"] * t))

    steps = F.filter(F.sequence(F.lit(0), F.floor(distance(a, b)).cast("int")), lambda i: i < F.floor(distance(a, b)))
    scored = F.transform(steps, lambda i: let(place(i), lambda p: F.struct((distance(p, c) + distance(p, d)).alias("sum"), i.alias("i"), p.alias("p"))))
    return F.coalesce(F.array_min(scored)["p"], a)
