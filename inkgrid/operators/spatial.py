"""Spatial joins: boxes meet in the cells of a grid, so every join is an equi-join that can be dealt out and split.

A box is replicated to the cells it covers; a pair is emitted only in the lowest cell that both cover, so it appears
once without a distinct. Work grows with the boxes and the pairs that share a cell, not with pairs on a page.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import radians, sin

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.functions import geo
from inkgrid.functions.geo import Box, Segment
from inkgrid.session import materialise

CELL = 60.0


def with_box(df: DataFrame, s: Segment | None = None) -> DataFrame:
    """df with the box of its segment as x0, y0, x1, y1."""
    box = (s or Segment.of()).box()
    return df.withColumns(dict(zip(("x0", "y0", "x1", "y1"), (box.x0, box.y0, box.x1, box.y1), strict=True)))


def _celled(df: DataFrame, cell: float, pad: float) -> DataFrame:
    low = lambda c: F.floor((F.col(c) - pad) / cell)
    high = lambda c: F.floor((F.col(c) + pad) / cell)
    df = df.withColumns({"_cx0": low("x0"), "_cy0": low("y0")})
    return df.withColumn("_cx", F.explode(F.sequence("_cx0", high("x1")))).withColumn("_cy", F.explode(F.sequence("_cy0", high("y1"))))


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))


def grid_join(left: DataFrame, right: DataFrame, keys: list[str], pad: float = 0.0, cell: float = CELL, on: Callable[[], Column] | Column | None = None) -> DataFrame:
    """Pairs of rows with equal keys whose boxes (x0, y0, x1, y1) come within pad of each other along both axes.

    Columns come prefixed with l_ and r_; on is a further condition on those.
    """
    a, b = prefixed(_celled(left, cell, pad), "l_"), prefixed(_celled(right, cell, 0.0), "r_")
    match = [F.col(f"l_{k}") == F.col(f"r_{k}") for k in [*keys, "_cx", "_cy"]]
    home = (F.col("l__cx") == F.greatest("l__cx0", "r__cx0")) & (F.col("l__cy") == F.greatest("l__cy0", "r__cy0"))
    near = Box.of("l_").expanded(pad).intersects(Box.of("r_"))
    both = a.join(b, match).where(home & near)
    if on is not None:
        both = both.where(on() if callable(on) else on)
    return both.drop(*(f"{p}{c}" for p in ("l_", "r_") for c in ("_cx", "_cy", "_cx0", "_cy0")))


def within(left: DataFrame, right: DataFrame, keys: list[str], distance: float, cell: float = CELL) -> DataFrame:
    """Pairs whose boxes are at most distance apart, with their gap."""
    gap = Box.of("l_").gap(Box.of("r_"))
    return grid_join(left, right, keys, distance, cell).withColumn("gap", gap).where(F.col("gap") <= distance + 1e-9)


def pairs_within(df: DataFrame, keys: list[str], distance: float, id_: str = "id", cell: float = CELL) -> DataFrame:
    return within(df, df, keys, distance, cell).where(F.col(f"l_{id_}") < F.col(f"r_{id_}"))


def touching(df: DataFrame, keys: list[str], tolerance: float, id_: str = "id") -> DataFrame:
    """Pairs of segments with two ends at most tolerance apart."""
    ends = [(F.col(f"l_{p}x"), F.col(f"l_{p}y"), F.col(f"r_{q}x"), F.col(f"r_{q}y")) for p in "ab" for q in "ab"]
    near = F.least(*(F.hypot(c - a, d - b) for a, b, c, d in ends)) <= tolerance
    return grid_join(df, df, keys, tolerance, on=(F.col(f"l_{id_}") < F.col(f"r_{id_}")) & near)


def parallel(df: DataFrame, keys: list[str], most: float, turn: float = 2.0, overlap: float = 0.25, id_: str = "id", least: float = 0.0) -> DataFrame:
    """Pairs of segments within turn degrees, whose lines are least to most apart, that overlap on both by a share of overlap."""
    # lengths and directions are worked out once a segment, which keeps the join's condition small enough to compile well
    seg = Segment.of()
    units = df.withColumn("_len", seg.length).withColumns({"_ux": F.try_divide(seg.dx, F.col("_len")), "_uy": F.try_divide(seg.dy, F.col("_len"))})

    def side(u: str, v: str) -> tuple[Column, Column]:
        """Mean distance of v's ends from u's line, and the share of u in v's shadow."""
        c = F.col
        step = lambda e: (c(f"{v}{e}x") - c(f"{u}ax"), c(f"{v}{e}y") - c(f"{u}ay"))
        (x1, y1), (x2, y2) = step("a"), step("b")
        away = (F.abs(c(f"{u}_ux") * y1 - c(f"{u}_uy") * x1) + F.abs(c(f"{u}_ux") * y2 - c(f"{u}_uy") * x2)) / 2
        p, q = c(f"{u}_ux") * x1 + c(f"{u}_uy") * y1, c(f"{u}_ux") * x2 + c(f"{u}_uy") * y2
        shared = F.greatest(F.lit(0.0), F.least(c(f"{u}_len"), F.greatest(p, q)) - F.greatest(F.lit(0.0), F.least(p, q)))
        return away, F.try_divide(shared, c(f"{u}_len"))

    (apart, one), (_, other) = side("l_", "r_"), side("r_", "l_")
    straight = F.abs(F.col("l__ux") * F.col("r__uy") - F.col("l__uy") * F.col("r__ux")) <= sin(radians(turn)) + 1e-12
    both = grid_join(units, units, keys, most, on=(F.col(f"l_{id_}") < F.col(f"r_{id_}")) & straight)
    both = both.withColumn("apart", apart).where(F.col("apart").between(least, most) & (one >= overlap) & (other >= overlap))
    bent = geo.angle_between(geo.degrees(Segment.of("l_")), geo.degrees(Segment.of("r_")), 180)
    return both.withColumns({"turn": bent, "share": F.least(one, other)}).drop(*(f"{p}_{c}" for p in ("l_", "r_") for c in ("len", "ux", "uy")))


def collinear(df: DataFrame, keys: list[str], turn: float = 2.0, offset: float = 0.6, gap: float = 24.0, id_: str = "id") -> DataFrame:
    """Pairs of segments on one line: within turn degrees and offset, boxes at most gap apart."""
    s, t = Segment.of("l_"), Segment.of("r_")
    bent = geo.angle_between(geo.degrees(s), geo.degrees(t), 180) <= turn
    off = F.greatest(geo.line_distance(s, t.ax, t.ay), geo.line_distance(s, t.bx, t.by)) <= offset
    return grid_join(df, df, keys, gap, on=(F.col(f"l_{id_}") < F.col(f"r_{id_}")) & bent & off)


def continuing(ends: DataFrame, segments: DataFrame, keys: list[str], turn: float = 12.0, reach: float = 40.0) -> DataFrame:
    """For ends (id, x, y, heading in degrees): segments with an end ahead within reach, whose direction is within turn of the heading."""
    probes = ends.withColumns({"x0": F.col("x"), "y0": F.col("y"), "x1": F.col("x"), "y1": F.col("y")})
    s = Segment.of("r_")
    x, y, heading = F.col("l_x"), F.col("l_y"), F.radians("l_heading")

    def ahead(px: Column, py: Column) -> Column:
        step = (px - x) * F.cos(heading) + (py - y) * F.sin(heading)
        return (step > 0) & (F.hypot(px - x, py - y) <= reach)

    bent = geo.angle_between(geo.degrees(s), F.pmod(F.col("l_heading"), F.lit(180.0)), 180) <= turn
    return grid_join(probes, segments, keys, reach, on=(ahead(s.ax, s.ay) | ahead(s.bx, s.by)) & bent)


def crossings(df: DataFrame, keys: list[str], id_: str = "id") -> DataFrame:
    """Pairs of segments that cross or touch, with the point."""
    both = grid_join(df, df, keys, 0.0, on=F.col(f"l_{id_}") < F.col(f"r_{id_}"))
    return both.withColumn("at", geo.crossing(Segment.of("l_"), Segment.of("r_"))).where("at is not null")


def in_region(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows whose box meets a box: four comparisons that reach the scan."""
    return df.where(Box.of().intersects(Box(*map(F.lit, box))))


def near_point(df: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    """Segments at most radius from a point, with their distance."""
    box = in_region(df, (x - radius, y - radius, x + radius, y + radius))
    return box.withColumn("distance", geo.point_distance(Segment.of(), F.lit(x), F.lit(y))).where(F.col("distance") <= radius)


def nearest(probes: DataFrame, df: DataFrame, keys: list[str], k: int, radius: float, probe: str = "id", id_: str = "id") -> DataFrame:
    """The k boxes nearest to each probe's box within radius, by distance, ties by id."""
    both = within(probes, df, keys, radius)
    order = Window.partitionBy(f"l_{probe}").orderBy("gap", f"r_{id_}")
    return both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def k_nearest(probes: DataFrame, df: DataFrame, keys: list[str], k: int, radius: float = CELL, probe: str = "id", id_: str = "id", others: bool = False) -> DataFrame:
    """The k boxes nearest to each probe's box however far off (all, where a key has fewer), by distance, ties by id; others leaves out a probe's own id.

    Probes that found fewer than k look again in twice the radius, until it spans the sheet; each round is written before the next.
    """
    extent = probes.select("x0", "y0", "x1", "y1").unionByName(df.select("x0", "y0", "x1", "y1")).agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).first()
    span = ((extent[2] - extent[0]) ** 2 + (extent[3] - extent[1]) ** 2) ** 0.5 if extent[0] is not None else 0.0
    left, found = probes, []
    while True:
        both = within(left, df, keys, radius, max(CELL, radius))
        if others:
            both = both.where(F.col(f"l_{probe}") != F.col(f"r_{id_}"))
        order = Window.partitionBy(f"l_{probe}").orderBy("gap", f"r_{id_}")
        best = materialise(both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k), "nearest")
        if radius >= span:
            found.append(best)
            break
        full = materialise(best.where(F.col("place") == k).select(F.col(f"l_{probe}").alias(probe)), "nearest")
        found.append(best.join(full.withColumnRenamed(probe, f"l_{probe}"), f"l_{probe}", "left_semi"))
        left = materialise(left.join(full, probe, "left_anti"), "nearest")
        if left.isEmpty():
            break
        radius *= 2
    return reduce(DataFrame.unionByName, found)


def containment(outer: DataFrame, inner: DataFrame, keys: list[str], cell: float = CELL) -> DataFrame:
    """Pairs where the left box contains the right one."""
    return grid_join(outer, inner, keys, 0.0, cell, on=Box.of("l_").contains(Box.of("r_")))


def innermost(df: DataFrame, keys: list[str], id_: str = "id", cell: float = CELL) -> DataFrame:
    """Boxes that contain no smaller box of df."""
    smaller = containment(df, df, keys, cell).where((F.col(f"l_{id_}") != F.col(f"r_{id_}")) & (Box.of("r_").area < Box.of("l_").area))
    return df.join(smaller.select(F.col(f"l_{id_}").alias(id_)).distinct(), id_, "left_anti")


def cell_size(df: DataFrame, keys: list[str], times: float = 4.0) -> DataFrame:
    """Per key, a cell size from the upper median of box extents."""
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return df.groupBy(*keys).agg((F.expr("percentile_approx(greatest(x1 - x0, y1 - y0), 0.5, 10000)") * times).alias("cell"), F.max(extent).alias("most"))


def density(df: DataFrame, keys: list[str], cell: float = 24.0) -> DataFrame:
    """Boxes per cell, by the middle of each box."""
    cx, cy = F.floor((F.col("x0") + F.col("x1")) / (2 * cell)), F.floor((F.col("y0") + F.col("y1")) / (2 * cell))
    return df.groupBy(*keys, cx.alias("cx"), cy.alias("cy")).agg(F.count(F.lit(1)).alias("n"))
