"""What stands where on a sheet: frames, panels, label blocks, stacked labels, leaders, hatches, symbols and risers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.functions import geo, tokens
from inkgrid.functions.geo import Box, Segment
from inkgrid.operators import decisions, graph, spatial


def rectangle(points: Column, tolerance: float = 0.75) -> Column:
    """Four distinct points, each within tolerance of the corners' sides."""
    box = Box.around(points)
    on = lambda v, a, b: F.least(F.abs(v - a), F.abs(v - b)) <= tolerance
    return (F.size(F.array_distinct(points)) == 4) & F.forall(points, lambda p: on(p.x, box.x0, box.x1) & on(p.y, box.y0, box.y1))


def frames(objects: DataFrame, page_area: Column, share: float = 0.40) -> DataFrame:
    """Closed contours as large as a good part of the page."""
    return objects.where(F.col("closed") & (Box.of().area >= share * page_area))


def on_frame(segments: DataFrame, frames_: DataFrame, keys: list[str], tolerance: float = 3.0) -> DataFrame:
    """Segments whose ends and middle lie on one side of a frame."""
    both = spatial.grid_join(segments, frames_, keys, tolerance)
    s, b = Segment.of("l_"), Box.of("r_")
    near = lambda side, *v: F.greatest(*(F.abs(x - side) for x in v)) <= tolerance
    xs, ys = (s.ax, s.bx, (s.ax + s.bx) / 2), (s.ay, s.by, (s.ay + s.by) / 2)
    return both.where(near(b.x0, *xs) | near(b.x1, *xs) | near(b.y0, *ys) | near(b.y1, *ys)).select(F.col("l_id").alias("id")).distinct()


def panels(rectangles: DataFrame, texts: DataFrame, keys: list[str], page_area: float, least: int = 2, shares: tuple[float, float] = (0.004, 0.40)) -> DataFrame:
    """Rectangles of a middling size that hold texts and no smaller such panel, with the texts they hold and their kind."""
    sized = rectangles.where(Box.of().area.between(shares[0] * page_area, shares[1] * page_area))
    held = spatial.containment(sized, texts, keys, cell=120.0)
    counts = held.groupBy(F.col("l_id").alias("id")).agg(F.count(F.lit(1)).alias("n_texts"), F.array_sort(F.collect_list("r_id")).alias("texts"), F.bool_or(tokens.ratio(F.col("r_text")).isNotNull()).alias("title"))
    full = sized.join(counts.where(F.col("n_texts") >= least), "id")
    return spatial.innermost(full, keys, cell=120.0).withColumn("panel_kind", F.when(F.col("title"), "title_block").otherwise("legend"))


def label_blocks(texts: DataFrame, keys: list[str], cap: float) -> DataFrame:
    """Lines of text above each other (gap 0.8 caps, overlap 35 %, like heights) as blocks with their box."""
    a, b = Box.of("l_"), Box.of("r_")
    overlap = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    gap = F.greatest(b.y0 - a.y1, a.y0 - b.y1)
    tall = lambda p: F.col(f"{p}_y1") - F.col(f"{p}_y0")
    like = F.greatest(tall("l"), tall("r")) <= 1.8 * F.least(tall("l"), tall("r"))
    stacked = spatial.grid_join(texts, texts, keys, 0.8 * cap, on=(F.col("l_id") < F.col("r_id")) & (gap <= 0.8 * cap) & (overlap >= 0.35 * F.least(a.x1 - a.x0, b.x1 - b.x0)) & like)
    named = graph.labelled(texts, stacked.select(F.col("l_id").alias("u"), F.col("r_id").alias("v")))
    lines = F.array_sort(F.collect_list(F.struct("y0", "x0", "text")))
    return named.groupBy(*keys, F.col("root").alias("block")).agg(*geo.box_union(), F.transform(lines, lambda t: t.text).alias("lines"), F.array_sort(F.collect_list("id")).alias("ids"))


def stacked_labels(texts: DataFrame, keys: list[str], cap: float) -> DataFrame:
    """Codes with the nearest line below that is a size or an elevation, one to one in reading order."""
    a, b = Box.of("l_"), Box.of("r_")
    gap, overlap = b.y0 - a.y1, F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    part = tokens.size(F.col("r_text")).isNotNull() | tokens.dimension(F.col("r_text")).isNotNull() | tokens.elevation(F.col("r_text")).isNotNull()
    on = tokens.code_like(F.col("l_text")) & part & gap.between(-0.3 * cap, 1.6 * cap) & (overlap >= 0.3 * F.least(a.x1 - a.x0, b.x1 - b.x0))
    pairs = spatial.grid_join(texts, texts, keys, 1.6 * cap, on=on).select(F.concat(F.lit("u"), F.col("l_id")).alias("u"), F.concat(F.lit("v"), F.col("r_id")).alias("v"), F.col("l_id").alias("upper"), F.col("r_id").alias("lower"), F.col("l_text").alias("code"), F.col("r_text").alias("part"), gap.alias("gap"))
    return graph.matching(pairs, [F.col("gap"), F.col("upper"), F.col("lower")]).drop("u", "v")


def leaders(texts: DataFrame, strokes: DataFrame, keys: list[str], cap: float, join: float = 1.2, hops: int = 14) -> DataFrame:
    """Leaders from texts: the strokes that touch a text's box, followed end to end while there is one way on.

    texts: id and boxes. strokes: id and ends. Gives text, path (strokes in order), root and tip as (x, y) and why it stopped.
    """
    starts = spatial.within(texts, spatial.with_box(strokes), keys, 0.5 * cap)
    a, b = Box.of("l_").to_point(F.col("r_ax"), F.col("r_ay")), Box.of("l_").to_point(F.col("r_bx"), F.col("r_by"))
    starts = starts.where(F.least(a, b) <= 0.5 * cap).select(F.col("l_id").alias("text"), F.col("r_id").alias("node"), (a <= b).alias("from_a"))
    links = spatial.touching(spatial.with_box(strokes), keys, join)
    both = links.select(F.col("l_id").alias("u"), F.col("r_id").alias("v")).unionByName(links.select(F.col("r_id").alias("u"), F.col("l_id").alias("v")))
    keyed = starts.withColumn("start", F.struct("text", "node", "from_a"))
    walked = graph.walk(keyed.select("start", "node"), both, hops)
    last, one = F.element_at("path", -1), F.size("path") == 1
    ends = strokes.select(F.col("id").alias("last"), *(F.col(c) for c in ("ax", "ay", "bx", "by")))
    first = strokes.select(F.col("id").alias("first_id"), *(F.col(c).alias(f"f{c}") for c in ("ax", "ay", "bx", "by")))
    out = walked.withColumns({"last": last, "first_id": F.get("path", F.lit(0))}).join(ends, "last").join(first, "first_id")
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    root = F.when(F.col("start.from_a"), at("fax", "fay")).otherwise(at("fbx", "fby"))
    far = F.when(F.col("start.from_a"), at("bx", "by")).otherwise(at("ax", "ay"))
    away = lambda p: F.hypot(p.x - root.x, p.y - root.y)
    tip = F.when(one, far).when(away(at("ax", "ay")) >= away(at("bx", "by")), at("ax", "ay")).otherwise(at("bx", "by"))
    return out.select(F.col("start.text").alias("text"), "path", root.alias("root"), tip.alias("tip"), "stop")


def attach(leaders_: DataFrame, runs: DataFrame, keys: list[str], reach: float, eps: float = 0.75) -> DataFrame:
    """leaders_: leader, text, tip and keys. runs: run, segment ends and keys. The nearest run at each tip, or why none."""
    probes = leaders_.select("leader", *keys, F.col("tip.x").alias("x0"), F.col("tip.y").alias("y0"), F.col("tip.x").alias("x1"), F.col("tip.y").alias("y1"))
    near = spatial.grid_join(probes, spatial.with_box(runs), keys, reach)
    d = near.withColumn("d", geo.point_distance(Segment.of("r_"), F.col("l_x0"), F.col("l_y0")))
    distances = d.groupBy(F.col("l_leader").alias("leader"), F.col("r_run").alias("run")).agg(F.min("d").alias("distance"))
    return decisions.associate(leaders_.select("leader", "text"), distances, reach, eps)


def hatches(strokes: DataFrame, keys: list[str], bucket: float = 4.0, least: int = 12, variation: float = 0.25) -> DataFrame:
    """Families of short strokes of one direction whose distances across it are regular."""
    from inkgrid.operators.islands import regular

    s = Segment.of()
    turned = F.floor(geo.degrees(s) / bucket)
    across = F.round((s.ax + s.bx) / 2 * -F.sin(F.radians((turned + 0.5) * bucket)) + (s.ay + s.by) / 2 * F.cos(F.radians((turned + 0.5) * bucket)), 2)
    return regular(strokes.withColumns({"direction": turned, "across": across}), [*keys, "direction"], "across", least, variation)


def grid_lines(strokes: DataFrame, keys: list[str], span: float, share: float = 0.55, least: int = 3) -> DataFrame:
    """Strokes along the axes over a good part of the sheet, in families of least or more."""
    s = Segment.of()
    axis = F.when(geo.angle_between(geo.degrees(s), F.lit(0.0), 180) <= 1, "x").when(geo.angle_between(geo.degrees(s), F.lit(90.0), 180) <= 1, "y")
    long_ = strokes.withColumn("axis", axis).where(F.col("axis").isNotNull() & (s.length >= share * span))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys, "axis"))
    return long_.withColumn("family", n).where(F.col("family") >= least)


def risers(symbols: DataFrame, elevations: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """Symbols with the height between the elevations noted near them; null with fewer than two different ones."""
    near = spatial.within(symbols, elevations, keys, reach)
    return near.groupBy(F.col("l_id").alias("id")).agg(decisions.riser_height(F.col("r_elevation")).alias("height_m"), F.count(F.lit(1)).alias("notes"))


def scale_bars(cells: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Rows of boxes of one size that touch: bars of least or more cells, with their length."""
    a, b = Box.of("l_"), Box.of("r_")
    same = (F.abs((a.x1 - a.x0) - (b.x1 - b.x0)) <= 0.1) & (F.abs(a.y0 - b.y0) <= 0.1) & (F.abs(a.y1 - b.y1) <= 0.1) & (F.abs(a.x1 - b.x0) <= 0.1)
    next_ = spatial.grid_join(cells, cells, keys, 0.2, on=same & (F.col("l_id") != F.col("r_id")))
    named = graph.labelled(cells, next_.select(F.least("l_id", "r_id").alias("u"), F.greatest("l_id", "r_id").alias("v")))
    return named.groupBy(*keys, F.col("root").alias("bar")).agg(*geo.box_union(), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).withColumn("length", F.col("x1") - F.col("x0"))


def ticked(lines: DataFrame, strokes: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """Lines with a short stroke that isn't parallel at both ends: dimension lines."""
    found = None
    for end in "ab":
        probes = lines.withColumns({"x0": F.col(f"{end}x"), "y0": F.col(f"{end}y"), "x1": F.col(f"{end}x"), "y1": F.col(f"{end}y")})
        near = spatial.grid_join(probes, spatial.with_box(strokes), keys, reach, on=F.col("l_id") != F.col("r_id"))
        s, t = Segment.of("l_"), Segment.of("r_")
        tick = (t.length <= 2 * reach) & (geo.angle_between(geo.degrees(s), geo.degrees(t), 180) > 20) & (geo.point_distance(t, F.col("l_x0"), F.col("l_y0")) <= reach)
        ids = near.where(tick).select(F.col("l_id").alias("id")).distinct()
        found = ids if found is None else found.join(ids, "id", "left_semi")
    return lines.join(found, "id", "left_semi")


def dimension_lines(lines: DataFrame, numbers: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """lines (ticked) with exactly one number near their middle: metres per point of each."""
    mid = lines.withColumns({"x0": (F.col("ax") + F.col("bx")) / 2, "y0": (F.col("ay") + F.col("by")) / 2})
    near = spatial.within(mid.withColumns({"x1": F.col("x0"), "y1": F.col("y0")}), numbers, keys, reach)
    one = near.groupBy(F.col("l_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("r_value").alias("value")).where("n = 1")
    return lines.join(one, "id").withColumn("metres_per_point", F.col("value") / Segment.of().length)


def glyph_lines(chars: DataFrame, keys: list[str]) -> DataFrame:
    """Characters joined to lines of text: their band overlaps and the gap is at most 1.1 of the lower height."""
    a, b = Box.of("l_"), Box.of("r_")
    tall = F.least(a.y1 - a.y0, b.y1 - b.y0)
    gap = F.greatest(b.x0 - a.x1, a.x0 - b.x1)
    band = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    near = spatial.grid_join(chars, chars, keys, 40.0, on=(F.col("l_id") < F.col("r_id")) & (gap <= 1.1 * tall) & (band >= 0.5 * tall))
    return graph.labelled(chars, near.select(F.col("l_id").alias("u"), F.col("r_id").alias("v"))).withColumnRenamed("root", "line")
