"""Plane geometry as column expressions, inside whole-stage code generation.

A segment is given by the columns of its ends, a box by x0, y0, x1, y1, a polyline by an array of (x, y) structs.
Angles of segments are undirected. All functions give null for null coordinates.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F



@dataclass(frozen=True)
class Segment:
    """The ends of a segment, as columns."""

    ax: Column
    ay: Column
    bx: Column
    by: Column

    @classmethod
    def of(cls, prefix: str = "") -> Segment:
        return cls(*(F.col(f"{prefix}{c}") for c in ("ax", "ay", "bx", "by")))

    @property
    def dx(self) -> Column:
        return self.bx - self.ax

    @property
    def dy(self) -> Column:
        return self.by - self.ay

    @property
    def length(self) -> Column:
        return F.hypot(self.dx, self.dy)

    def box(self) -> Box:
        return Box(F.least(self.ax, self.bx), F.least(self.ay, self.by), F.greatest(self.ax, self.bx), F.greatest(self.ay, self.by))


@dataclass(frozen=True)
class Box:
    """The sides of a box, as columns; its intervals are closed."""

    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")))

    @classmethod
    def around(cls, points: Column) -> Box:
        side = lambda f, axis: f(F.transform(points, lambda p: p[axis]))
        return cls(side(F.array_min, "x"), side(F.array_min, "y"), side(F.array_max, "x"), side(F.array_max, "y"))

    def expanded(self, m: float | Column) -> Box:
        return Box(self.x0 - m, self.y0 - m, self.x1 + m, self.y1 + m)

    def intersects(self, o: Box) -> Column:
        return (self.x0 <= o.x1) & (o.x0 <= self.x1) & (self.y0 <= o.y1) & (o.y0 <= self.y1)

    def contains(self, o: Box) -> Column:
        return (self.x0 <= o.x0) & (o.x1 <= self.x1) & (self.y0 <= o.y0) & (o.y1 <= self.y1)

    def has(self, x: Column, y: Column) -> Column:
        return x.between(self.x0, self.x1) & y.between(self.y0, self.y1)

    def to_point(self, x: Column, y: Column) -> Column:
        """Distance to a point; 0 inside."""
        return F.hypot(F.greatest(self.x0 - x, F.lit(0), x - self.x1), F.greatest(self.y0 - y, F.lit(0), y - self.y1))

    def gap(self, o: Box) -> Column:
        """Distance between boxes; 0 when they touch."""
        return F.hypot(F.greatest(o.x0 - self.x1, F.lit(0), self.x0 - o.x1), F.greatest(o.y0 - self.y1, F.lit(0), self.y0 - o.y1))

    @property
    def area(self) -> Column:
        return (self.x1 - self.x0) * (self.y1 - self.y0)

    def common(self, o: Box) -> Column:
        """Area of the intersection."""
        wide = F.greatest(F.lit(0), F.least(self.x1, o.x1) - F.greatest(self.x0, o.x0))
        return wide * F.greatest(F.lit(0), F.least(self.y1, o.y1) - F.greatest(self.y0, o.y0))

    def iou(self, o: Box) -> Column:
        return F.try_divide(self.common(o), self.area + o.area - self.common(o))

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.alias(f"{prefix}{n}") for c, n in zip((self.x0, self.y0, self.x1, self.y1), ("x0", "y0", "x1", "y1"), strict=True)]


def angle(s: Segment) -> Column:
    """Undirected, in [0, pi)."""
    turned = F.pmod(F.atan2(s.dy.cast("double"), s.dx.cast("double")), F.lit(pi))
    return F.when(F.abs(turned - pi) < 1e-12, 0.0).otherwise(turned)


def degrees(s: Segment) -> Column:
    return F.degrees(angle(s))


def angle_between(a: Column, b: Column, half: float = pi) -> Column:
    """The smallest difference of undirected angles; half is pi or 180."""
    d = F.abs(a - b) % half
    return F.least(d, half - d)


def along(s: Segment, x: Column, y: Column) -> Column:
    """The place of a point's foot on a segment's line: 0 at a, 1 at b; null for a segment without length."""
    return F.try_divide((x - s.ax) * s.dx + (y - s.ay) * s.dy, s.dx * s.dx + s.dy * s.dy)


def foot(s: Segment, x: Column, y: Column) -> Column:
    """The nearest point of a segment, as (x, y)."""
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along(s, x, y))), F.lit(0.0))
    return F.struct((s.ax + t * s.dx).alias("x"), (s.ay + t * s.dy).alias("y"))


def point_distance(s: Segment, x: Column, y: Column) -> Column:
    f = foot(s, x, y)
    return F.hypot(x - f.x, y - f.y)


def line_offset(s: Segment, x: Column, y: Column) -> Column:
    """Signed distance of a point from a segment's line, positive at its left."""
    return F.try_divide(s.dx * (y - s.ay) - s.dy * (x - s.ax), s.length)


def line_distance(s: Segment, x: Column, y: Column) -> Column:
    return F.abs(line_offset(s, x, y))


def crossing(s: Segment, t: Segment, eps: float = 1e-9) -> Column:
    """The point where two segments cross (ends count), as (x, y); null for none and for parallel ones."""
    d = s.dx * t.dy - s.dy * t.dx
    u = F.try_divide((t.ax - s.ax) * t.dy - (t.ay - s.ay) * t.dx, d)
    v = F.try_divide((t.ax - s.ax) * s.dy - (t.ay - s.ay) * s.dx, d)
    inside = (F.abs(d) > eps) & u.between(-eps, 1 + eps) & v.between(-eps, 1 + eps)
    return F.when(inside, F.struct((s.ax + u * s.dx).alias("x"), (s.ay + u * s.dy).alias("y")))


def segment_distance(s: Segment, t: Segment) -> Column:
    ends = F.least(point_distance(s, t.ax, t.ay), point_distance(s, t.bx, t.by), point_distance(t, s.ax, s.ay), point_distance(t, s.bx, s.by))
    return F.when(crossing(s, t).isNotNull(), 0.0).otherwise(ends)


def overlap(s: Segment, t: Segment) -> Column:
    """Length of t's shadow on s."""
    a, b = along(s, t.ax, t.ay), along(s, t.bx, t.by)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest(a, b)) - F.greatest(F.lit(0.0), F.least(a, b))) * s.length


def overlap_fraction(s: Segment, t: Segment) -> Column:
    return F.try_divide(overlap(s, t), s.length)


def overlap_of_shorter(s: Segment, t: Segment) -> Column:
    return F.try_divide(overlap(s, t), F.least(s.length, t.length))


def extended(s: Segment, amount: float | Column) -> Segment:
    """s made longer past b."""
    return Segment(s.ax, s.ay, s.bx + F.try_divide(s.dx, s.length) * amount, s.by + F.try_divide(s.dy, s.length) * amount)


def midline(s: Segment, t: Segment) -> Segment:
    """The line half way between two walls, over the extent that they share along s."""
    a, b = along(s, t.ax, t.ay), along(s, t.bx, t.by)
    low, high = F.greatest(F.lit(0.0), F.least(a, b)), F.least(F.lit(1.0), F.greatest(a, b))
    half = (line_offset(s, t.ax, t.ay) + line_offset(s, t.bx, t.by)) / 4
    nx, ny = F.try_divide(-s.dy, s.length) * half, F.try_divide(s.dx, s.length) * half
    return Segment(s.ax + low * s.dx + nx, s.ay + low * s.dy + ny, s.ax + high * s.dx + nx, s.ay + high * s.dy + ny)


def meeting_point(s: Segment, t: Segment, near: float) -> Column:
    """Where two axes meet if that is within near of both, else the middle of their nearest ends' midpoints."""
    d = s.dx * t.dy - s.dy * t.dx
    u = F.try_divide((t.ax - s.ax) * t.dy - (t.ay - s.ay) * t.dx, d)
    x, y = s.ax + u * s.dx, s.ay + u * s.dy
    close = (F.abs(d) > 1e-9) & (point_distance(s, x, y) <= near) & (point_distance(t, x, y) <= near)
    return F.when(close, F.struct(x.alias("x"), y.alias("y"))).otherwise(F.struct(((s.bx + t.ax) / 2).alias("x"), ((s.by + t.ay) / 2).alias("y")))


def rotated(x: Column, y: Column, turn: Column, ox: Column, oy: Column) -> Column:
    """A point turned about (ox, oy)."""
    c, s = F.cos(turn), F.sin(turn)
    return F.struct((ox + (x - ox) * c - (y - oy) * s).alias("x"), (oy + (x - ox) * s + (y - oy) * c).alias("y"))


def projected(x: Column, y: Column, ux: Column, uy: Column) -> Column:
    return x * ux + y * uy


def edges(points: Column, closed: Column | bool = False) -> Column:
    """The segments of a polyline as (ax, ay, bx, by), without those of no length; closed adds the one back to the start."""
    closed = closed if isinstance(closed, Column) else F.lit(closed)
    ring = F.when(closed, F.concat(points, F.slice(points, 1, 1))).otherwise(points)
    pairs = F.transform(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), lambda q, i: F.struct(F.get(ring, i).x.alias("ax"), F.get(ring, i).y.alias("ay"), q.x.alias("bx"), q.y.alias("by")))
    return F.filter(pairs, lambda e: (e.ax != e.bx) | (e.ay != e.by))


def polyline_length(points: Column, closed: Column | bool = False) -> Column:
    return F.aggregate(edges(points, closed), F.lit(0.0), lambda total, e: total + F.hypot(e.bx - e.ax, e.by - e.ay))


def direction(points: Column, tolerance: float = 8.0) -> Column:
    """horizontal, vertical_on_sheet or diagonal when all edges agree within tolerance degrees, else mixed."""

    def of(e: Column) -> Column:
        a = degrees(Segment(e.ax, e.ay, e.bx, e.by))
        return F.when(angle_between(a, F.lit(0.0), 180) <= tolerance, "horizontal").when(angle_between(a, F.lit(90.0), 180) <= tolerance, "vertical_on_sheet").otherwise("diagonal")

    kinds = F.array_distinct(F.transform(edges(points), of))
    return F.when(F.size(kinds) == 1, F.get(kinds, F.lit(0))).otherwise("mixed")


def straightness(points: Column) -> Column:
    """The largest distance of a point from the line through both ends, as a share of their distance."""
    first, last = F.get(points, F.lit(0)), F.get(points, F.size(points) - 1)
    chord = Segment(first.x, first.y, last.x, last.y)
    return F.try_divide(F.array_max(F.transform(points, lambda p: line_distance(chord, p.x, p.y))), chord.length)


def cut(points: Column, cuts: Column) -> Column:
    """The pieces of a polyline cut at sorted (at, x, y): at counts edges from the start, with the place on the edge as fraction."""
    n = F.size(points)
    ends = F.concat(F.array(F.struct(F.lit(0.0).alias("at"), F.get(points, F.lit(0)).x.alias("x"), F.get(points, F.lit(0)).y.alias("y"))), cuts, F.array(F.struct((n - 1).cast("double").alias("at"), F.get(points, n - 1).x.alias("x"), F.get(points, n - 1).y.alias("y"))))

    def piece(end: Column, i: Column) -> Column:
        start = F.get(ends, i)
        inner = F.filter(F.transform(points, lambda p, k: F.struct(k.cast("double").alias("at"), p.x.alias("x"), p.y.alias("y"))), lambda p: (p.at > start.at) & (p.at < end.at))
        return F.transform(F.concat(F.array(start), inner, F.array(end)), lambda p: F.struct(p.x.alias("x"), p.y.alias("y")))

    return F.transform(F.slice(ends, 2, F.size(ends) - 1), piece)


def principal_angle(x: Column, y: Column) -> Column:
    """Aggregate: the axis of largest variance, in [0, pi)."""
    return F.pmod(0.5 * F.atan2(2 * F.covar_pop(x, y), F.var_pop(x) - F.var_pop(y)), F.lit(pi))


def box_union() -> list[Column]:
    """Aggregates: the box around the boxes of a group."""
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
