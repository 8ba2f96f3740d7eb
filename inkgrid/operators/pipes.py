"""From strokes to pipes: wall pairs, centrelines, duplicates, nodes, runs and physical pipes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.functions import canon, geo, states
from inkgrid.functions.geo import Segment
from inkgrid.operators import graph, spatial

#: Weights of a wall pair's score, and the tolerances of runs.
OVERLAP, PARALLEL, SLENDER = 0.45, 0.30, 0.25
TURN, SECOND, WIDTH = 35.0, 3.0, 0.12


def pair_score(share: Column, turn: Column, length: Column, width: Column) -> Column:
    return OVERLAP * share + PARALLEL * (1 - turn / 2.0) + SLENDER * F.least(F.lit(1.0), F.try_divide(length, width) / 6)


def wall_pairs(segments: DataFrame, keys: list[str], least: float = 0.8, most: float = 90.0, turn: float = 2.0, share: float = 0.55) -> DataFrame:
    """segments: id, object_id, ends and keys (document, page, pen, layer, ...). Scored candidates u, v with their centreline.

    Walls belong to different objects, lie on one side of each other and keep their distance to 6 % and 0.05.
    """
    found = spatial.parallel(segments, keys, most, turn, share, least=least)
    s, t = Segment.of("l_"), Segment.of("r_")
    a, b = geo.line_offset(s, t.ax, t.ay), geo.line_offset(s, t.bx, t.by)
    even = (a * b > 0) & (F.abs(F.abs(a) - F.abs(b)) <= 0.06 * F.col("apart") + 0.05)
    mid = geo.midline(s, t)
    width = (F.abs(a) + F.abs(b)) / 2
    score = canon.quantise(pair_score(F.col("share"), F.col("turn"), mid.length, width), 6)
    out = found.where(even & (F.col("l_object_id") != F.col("r_object_id")))
    out = out.withColumns({"score": score, "width": canon.quantise(width), "cax": canon.quantise(mid.ax), "cay": canon.quantise(mid.ay), "cbx": canon.quantise(mid.bx), "cby": canon.quantise(mid.by)})
    return out.select(F.col("l_id").alias("u"), F.col("r_id").alias("v"), *(F.col(f"l_{k}").alias(k) for k in keys), "score", "width", *(F.col(f"c{c}").alias(c) for c in ("ax", "ay", "bx", "by")))


def centrelines(segments: DataFrame, keys: list[str], **limits: float) -> DataFrame:
    """Wall pairs that a greedy pass in the order of scores keeps, each wall once, as candidates with an id."""
    order = [(-F.col("score")).alias("s"), "ax", "ay", "bx", "by", "u", "v"]
    chosen = graph.matching(wall_pairs(segments, keys, **limits), [F.col(o) if isinstance(o, str) else o for o in order])
    key = canon.segment_key(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return chosen.withColumns({"candidate_id": canon.content_id("cand", F.lit("double_line"), F.col("width"), key), "style": F.lit("double_line"), "confidence": F.least(F.lit(0.99), 0.55 + 0.45 * F.col("score"))})


def mutual_walls(segments: DataFrame, keys: list[str], most: float, least: float = 0.4, turn: float = 1.5, share: float = 0.55, eps: float = 0.05) -> DataFrame:
    """The other rule: walls that are each other's nearest parallel; a tie within eps refuses, so do pairs wider than long."""
    found = spatial.parallel(segments, keys, most, turn, share, least=least)
    s = Segment.of("l_")
    found = found.where((F.col("l_object_id") != F.col("r_object_id")) & (geo.overlap(s, Segment.of("r_")) >= F.col("apart")))
    return graph.mutual_best(found.select(F.col("l_id").alias("u"), F.col("r_id").alias("v"), F.col("apart")), "apart", eps)


def single_lines(segments: DataFrame, explained: DataFrame, least: float) -> DataFrame:
    """Long strokes that nothing explains, as weak candidates."""
    seg = Segment.of()
    left = segments.join(explained.select("id").distinct(), "id", "left_anti").where(seg.length >= least)
    return left.withColumns({"style": F.lit("single_line"), "confidence": F.lit(0.45), "reasons": F.array(F.lit("INSUFFICIENT_GEOMETRY"))})


def collapse_exact(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """One candidate for equal lines, styles and widths: the least by content, with the sources of all and their number."""
    line = canon.segment_key(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    rows = candidates.withColumns({"line": line, "_row": F.struct(*sorted(candidates.columns))})
    merged = rows.groupBy(*keys, "line", "style", "width").agg(F.min("_row").alias("kept"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("all_sources"), F.count(F.lit(1)).alias("instances"))
    return merged.select("kept.*", "all_sources", "instances")


def collapse_concentric(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """One candidate for equal lines of different widths: double lines first, then the narrowest; all widths stay as evidence."""
    order = F.struct(F.array_position(F.array(*map(F.lit, ("double_line", "dashed_line", "single_line"))), F.col("style")).alias("s"), F.coalesce("width", F.lit(float("inf"))).alias("w"), F.col("candidate_id").alias("c"))
    line = canon.segment_key(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    rows = candidates.withColumns({"line": line, "_row": F.struct(*candidates.columns), "_order": order})
    merged = rows.groupBy(*keys, "line").agg(F.min_by("_row", "_order").alias("kept"), F.min("width").alias("least_width"), F.max("width").alias("most_width"), F.count(F.lit(1)).alias("instances"))
    return merged.select("kept.*", "least_width", "most_width", "instances")


def tee_cuts(lines: DataFrame, keys: list[str], tolerance: float = 2.5) -> DataFrame:
    """lines: id and ends. The places, as fractions, where ends of other lines meet a line's inside."""
    probes = lines.select("id", *keys, F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("p"))
    probes = probes.select("id", *keys, F.col("p.x").alias("x0"), F.col("p.y").alias("y0"), F.col("p.x").alias("x1"), F.col("p.y").alias("y1"))
    near = spatial.grid_join(probes, spatial.with_box(lines), keys, tolerance, on=F.col("l_id") != F.col("r_id"))
    s, x, y = Segment.of("r_"), F.col("l_x0"), F.col("l_y0")
    at = geo.along(s, x, y)
    inside = (at * s.length > tolerance) & ((1 - at) * s.length > tolerance) & (geo.point_distance(s, x, y) <= tolerance)
    return near.where(inside).groupBy(F.col("r_id").alias("id")).agg(F.array_sort(F.collect_set(canon.quantise(at, 6))).alias("cuts"))


def split_tees(lines: DataFrame, keys: list[str], tolerance: float = 2.5) -> DataFrame:
    """lines cut where others meet them; part numbers the pieces from a on, and lengths add up to the whole."""
    both = lines.join(tee_cuts(lines, keys, tolerance), "id", "left")
    ends = F.concat(F.array(F.lit(0.0)), F.coalesce("cuts", F.expr("cast(array() as array<double>)")), F.array(F.lit(1.0)))
    parts = both.withColumn("ends", ends).select("*", F.posexplode(F.slice("ends", 2, F.size("ends") - 1)).alias("part", "_to")).withColumn("_from", F.get("ends", F.col("part")))
    at = lambda c, d, t: F.col(c) + F.col(t) * (F.col(d) - F.col(c))
    moved = {"_ax": at("ax", "bx", "_from"), "_ay": at("ay", "by", "_from"), "_bx": at("ax", "bx", "_to"), "_by": at("ay", "by", "_to")}
    cut = parts.withColumns(moved).drop("ax", "ay", "bx", "by", "ends", "cuts", "_from", "_to")
    return cut.withColumnsRenamed({f"_{c}": c for c in ("ax", "ay", "bx", "by")})


def nodes(lines: DataFrame, keys: list[str], tolerance: float = 2.5) -> tuple[DataFrame, DataFrame]:
    """lines: edge and ends. Nodes (node, x, y, degree, kind), and each edge's end with its node.

    Ends at most tolerance apart are one node at their mean, chains of them too.
    """
    e = F.col("edge")
    ends = lines.select("edge", *keys, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.lit(1).alias("side"), F.col("bx").alias("x"), F.col("by").alias("y")))).alias("p"))
    ends = ends.select((e * 2 + F.col("p.side")).alias("id"), "edge", *keys, "p.side", F.col("p.x").alias("x0"), F.col("p.y").alias("y0"), F.col("p.x").alias("x1"), F.col("p.y").alias("y1"))
    near = spatial.pairs_within(ends, keys, tolerance).select(F.col("l_id").alias("u"), F.col("r_id").alias("v"))
    placed = graph.labelled(ends, near).withColumnRenamed("root", "node")
    kind = F.when(F.col("degree") == 1, "end").when(F.col("degree") == 2, "joint").when(F.col("degree") == 3, "tee").otherwise("cross")
    found = placed.groupBy("node", *keys).agg(canon.quantise(F.avg("x0")).alias("x"), canon.quantise(F.avg("y0")).alias("y"), F.count(F.lit(1)).alias("degree"))
    return found.withColumn("kind", kind), placed.select("edge", "side", "node")


def continuations(lines: DataFrame, ends: DataFrame) -> DataFrame:
    """Pairs of edges that go on through a node: each other's straightest partner of a like width, turning TURN at most, no second within SECOND degrees."""
    s = Segment.of()
    heading = F.degrees(F.atan2(s.dy.cast("double"), s.dx.cast("double")))
    out = ends.join(lines, "edge").select("node", "edge", "width", "style", F.pmod(F.when(F.col("side") == 0, heading).otherwise(heading + 180), F.lit(360.0)).alias("away"))
    a, b = spatial.prefixed(out, "l_"), spatial.prefixed(out, "r_")
    bent = F.abs(180 - F.abs(F.col("l_away") - F.col("r_away")))
    like = (F.col("l_style") == F.col("r_style")) & (F.col("l_width").eqNullSafe(F.col("r_width")) | (F.abs(F.col("l_width") - F.col("r_width")) <= WIDTH * F.greatest("l_width", "r_width")))
    pairs = a.join(b, (F.col("l_node") == F.col("r_node")) & (F.col("l_edge") < F.col("r_edge"))).where(like).withColumn("bent", bent).where(F.col("bent") <= TURN)
    key = lambda side: F.struct(F.col(f"{side}_node").alias("n"), F.col(f"{side}_edge").alias("e"))
    best = graph.mutual_best(pairs.select(key("l").alias("u"), key("r").alias("v"), "bent"), "bent", SECOND)
    return best.select(F.col("u.e").alias("u"), F.col("v.e").alias("v"), F.col("u.n").alias("node"))


def runs(lines: DataFrame, ends: DataFrame) -> DataFrame:
    """Edges joined into runs: run (its least edge), number of edges, length and mean width."""
    joined = graph.labelled(lines.withColumn("id", F.col("edge")), continuations(lines, ends))
    length = F.sum(Segment.of().length)
    return joined.groupBy(F.col("root").alias("run")).agg(F.array_sort(F.collect_list("edge")).alias("edges"), canon.quantise(length).alias("length"), canon.quantise(F.avg("width")).alias("width"), F.min("style").alias("style"))


def pipes(runs_: DataFrame, touches: DataFrame, metres_per_point: Column) -> DataFrame:
    """runs_: run, designation, diameter, length, vertical (null if unknown), state, reasons, confidence. touches: u, v, runs that meet.

    Runs of one designation and diameter that meet are one pipe: horizontal, vertical and total metres, the worst
    state, all reasons and the least confidence. A missing scale makes lengths null and the state INSUFFICIENT.
    """
    a = runs_.select(F.col("run").alias("u"), F.col("designation").alias("du"), F.col("diameter").alias("mu"))
    b = runs_.select(F.col("run").alias("v"), F.col("designation").alias("dv"), F.col("diameter").alias("mv"))
    same = touches.join(a, "u").join(b, "v").where(F.col("du").eqNullSafe(F.col("dv")) & F.col("mu").eqNullSafe(F.col("mv")))
    named = graph.labelled(runs_.withColumn("id", F.col("run")), same)
    out = named.groupBy(F.col("root").alias("pipe")).agg(
        F.min("designation").alias("designation"), F.min("diameter").alias("diameter"), F.array_sort(F.collect_list("run")).alias("runs"), canon.quantise(F.sum("length")).alias("length_pt"),
        states.strict_sum(F.col("vertical")).alias("vertical_m"), states.worst(F.col("state")).alias("state"), states.reasons(F.col("reasons")).alias("reasons"), F.min("confidence").alias("confidence"),
    )
    horizontal = canon.quantise(F.col("length_pt") * metres_per_point)
    state = F.when(metres_per_point.isNull(), states.worst_of(F.col("state"), F.lit("INSUFFICIENT"))).when(F.col("vertical_m").isNull(), states.worst_of(F.col("state"), F.lit("AMBIGUOUS"))).otherwise(states.worst_of(F.col("state"), F.lit("HIGH_CONFIDENCE")))
    return out.withColumns({"horizontal_m": horizontal, "total_m": horizontal + F.col("vertical_m"), "state": state})


def occurrences(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with how many equal rows come before."""
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
