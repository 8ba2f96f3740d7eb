"""Queries on column functions: boxes, segments, polylines, keys and tokens, each over all strokes or parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrid.functions import canon, geo, tokens
from inkgrid.functions.geo import Box, Segment
from inkgrid.plans.catalogue import query
from inkgrid.plans.lattice import STROKES, strokes, table
from inkgrid.plans.text import NOTES, notes

#: Two slanted segments (a to b, c to d) and a point for each order.
SLANTS = """slants AS (SELECT o_orderkey AS id, o_orderkey // 200 AS page, CAST((o_orderkey * 37) % 300 AS DOUBLE) AS ax, CAST((o_orderkey * 53) % 240 AS DOUBLE) AS ay,
  (o_orderkey * 17) % 300 + 0.5::DOUBLE AS bx, (o_orderkey * 29) % 240 + 0.25::DOUBLE AS by_, CAST((o_orderkey * 41) % 300 AS DOUBLE) AS cx, CAST((o_orderkey * 59) % 240 AS DOUBLE) AS cy,
  (o_orderkey * 61) % 300 + 0.5::DOUBLE AS dx, (o_orderkey * 67) % 240 + 0.25::DOUBLE AS dy, CAST((o_orderkey * 13) % 300 AS DOUBLE) AS px, CAST((o_orderkey * 71) % 240 AS DOUBLE) AS py FROM orders)"""
S, T = ("ax", "ay", "bx", "by_"), ("cx", "cy", "dx", "dy")


def slants(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    at = lambda m, n, more=0.0: ((k * m) % n + F.lit(more)).cast("double")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), F.expr("o_orderkey div 200").alias("page"), at(37, 300).alias("ax"), at(53, 240).alias("ay"), at(17, 300, 0.5).alias("bx"), at(29, 240, 0.25).alias("by"),
        at(41, 300).alias("cx"), at(59, 240).alias("cy"), at(61, 300, 0.5).alias("dx"), at(67, 240, 0.25).alias("dy"), at(13, 300).alias("px"), at(71, 240).alias("py"),
    )


def _pair() -> tuple[Segment, Segment]:
    return Segment.of(), Segment(*(F.col(c) for c in ("cx", "cy", "dx", "dy")))


def r6(c: Column) -> Column:
    return F.round(c, 6)


def _along(s: tuple[str, ...], x: str, y: str) -> str:
    a, b, c, d = s
    return f"((({x}) - {a}) * ({c} - {a}) + (({y}) - {b}) * ({d} - {b})) / (({c} - {a}) * ({c} - {a}) + ({d} - {b}) * ({d} - {b}))"


def _length(s: tuple[str, ...]) -> str:
    return f"sqrt(pow({s[2]} - {s[0]}, 2) + pow({s[3]} - {s[1]}, 2))"


def _far(s: tuple[str, ...], x: str, y: str) -> str:
    t = f"greatest(0, least(1, {_along(s, x, y)}))"
    return f"sqrt(pow(({x}) - ({s[0]} + {t} * ({s[2]} - {s[0]})), 2) + pow(({y}) - ({s[1]} + {t} * ({s[3]} - {s[1]})), 2))"


def _offset(s: tuple[str, ...], x: str, y: str) -> str:
    return f"((({s[2]} - {s[0]}) * (({y}) - {s[1]}) - ({s[3]} - {s[1]}) * (({x}) - {s[0]})) / {_length(s)})"


def _degrees(s: tuple[str, ...]) -> str:
    a = f"atan2({s[3]} - {s[1]}, {s[2]} - {s[0]})"
    return f"degrees(CASE WHEN {a} < 0 THEN {a} + pi() ELSE {a} END)"


SHARED = f"(least(1, greatest({_along(S, 'cx', 'cy')}, {_along(S, 'dx', 'dy')})) - greatest(0, least({_along(S, 'cx', 'cy')}, {_along(S, 'dx', 'dy')})))"
CROSS = "((bx - ax) * (dy - cy) - (by_ - ay) * (dx - cx))"
U, V = f"((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / {CROSS}", f"((cx - ax) * (by_ - ay) - (cy - ay) * (bx - ax)) / {CROSS}"
MEETS = f"(({U}) BETWEEN -1e-9 AND 1 + 1e-9 AND ({V}) BETWEEN -1e-9 AND 1 + 1e-9)"
ENDS = f"least({_far(S, 'cx', 'cy')}, {_far(S, 'dx', 'dy')}, {_far(T, 'ax', 'ay')}, {_far(T, 'bx', 'by_')})"


@query(f"""WITH {SLANTS} SELECT id, round(abs(90 - abs(90 - abs({_degrees(S)} - {_degrees(T)}))), 6) AS turn, round({_far(S, 'px', 'py')}, 6) AS to_point, round({_offset(S, 'px', 'py')}, 6) AS aside, round({_along(S, 'px', 'py')}, 6) AS along,
  round(ax + greatest(0, least(1, {_along(S, 'px', 'py')})) * (bx - ax), 6) AS foot_x, round(greatest(0, {SHARED}) * {_length(S)}, 6) AS shared, round(greatest(0, {SHARED}), 6) AS share, round(greatest(0, {SHARED}) * {_length(S)} / least({_length(S)}, {_length(T)}), 6) AS of_shorter,
  round(CASE WHEN {MEETS} THEN 0 ELSE {ENDS} END, 6) AS apart, round(CASE WHEN {MEETS} THEN ax + ({U}) * (bx - ax) END, 6) AS cross_x FROM slants""")
def segment_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles, distances, feet, shadows and crossings of two segments and a point."""
    s, t = _pair()
    p = F.col("px"), F.col("py")
    return slants(spark, sf_dir).select(
        "id", r6(geo.angle_between(geo.degrees(s), geo.degrees(t), 180)).alias("turn"), r6(geo.point_distance(s, *p)).alias("to_point"), r6(geo.line_offset(s, *p)).alias("aside"), r6(geo.along(s, *p)).alias("along"),
        r6(geo.foot(s, *p).x).alias("foot_x"), r6(geo.overlap(s, t)).alias("shared"), r6(geo.overlap_fraction(s, t)).alias("share"), r6(geo.overlap_of_shorter(s, t)).alias("of_shorter"),
        r6(geo.segment_distance(s, t)).alias("apart"), r6(geo.crossing(s, t).x).alias("cross_x"),
    )


LOW, HIGH = (f"{f}({z}, {g}({_along(S, 'cx', 'cy')}, {_along(S, 'dx', 'dy')}))" for f, z, g in (("greatest", 0, "least"), ("least", 1, "greatest")))
HALF = f"(({_offset(S, 'cx', 'cy')} + {_offset(S, 'dx', 'dy')}) / 4)"
CLOSE = f"(abs({CROSS}) > 1e-9 AND {_far(S, f'ax + ({U}) * (bx - ax)', f'ay + ({U}) * (by_ - ay)')} <= 30 AND {_far(T, f'ax + ({U}) * (bx - ax)', f'ay + ({U}) * (by_ - ay)')} <= 30)"


@query(f"""WITH {SLANTS} SELECT id, round(bx + (bx - ax) / {_length(S)} * 10, 6) AS longer_x, round(by_ + (by_ - ay) / {_length(S)} * 10, 6) AS longer_y, round(ax + {LOW} * (bx - ax) - (by_ - ay) / {_length(S)} * {HALF}, 6) AS middle_ax, round(ay + {HIGH} * (by_ - ay) + (bx - ax) / {_length(S)} * {HALF}, 6) AS middle_by,
  round(CASE WHEN {CLOSE} THEN ax + ({U}) * (bx - ax) ELSE (bx + cx) / 2 END, 6) AS meet_x, round(CASE WHEN {CLOSE} THEN ay + ({U}) * (by_ - ay) ELSE (by_ + cy) / 2 END, 6) AS meet_y,
  round(ax + (px - ax) * cos(id % 7) - (py - ay) * sin(id % 7), 6) AS turned_x, round(px * 0.6::DOUBLE + py * 0.8::DOUBLE, 6) AS on_axis FROM slants""")
def segment_constructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longer segments, midlines, meeting points, turned and projected points."""
    s, t = _pair()
    m, meet = geo.midline(s, t), geo.meeting_point(s, t, 30.0)
    turned = geo.rotated(F.col("px"), F.col("py"), F.col("id") % 7, s.ax, s.ay)
    return slants(spark, sf_dir).select(
        "id", r6(geo.extended(s, 10.0).bx).alias("longer_x"), r6(geo.extended(s, 10.0).by).alias("longer_y"), r6(m.ax).alias("middle_ax"), r6(m.by).alias("middle_by"),
        r6(meet.x).alias("meet_x"), r6(meet.y).alias("meet_y"), r6(turned.x).alias("turned_x"), r6(geo.projected(F.col("px"), F.col("py"), F.lit(0.6), F.lit(0.8))).alias("on_axis"),
    )


CHORD = ("ax", "ay", "px", "py")


@query(f"""WITH {SLANTS} SELECT id, round(greatest(abs({_offset(CHORD, 'bx', 'by_')}), abs({_offset(CHORD, 'cx', 'cy')})) / {_length(CHORD)}, 6) AS bend,
  round({_length(S)} + {_length(('bx', 'by_', 'cx', 'cy'))} + {_length(('cx', 'cy', 'px', 'py'))}, 6) AS open_length, round({_length(S)} + {_length(('bx', 'by_', 'cx', 'cy'))} + {_length(('cx', 'cy', 'px', 'py'))} + {_length(CHORD)}, 6) AS closed_length,
  3 AS pieces, round({_length(S)} / 2 + {_length(('bx', 'by_', 'cx', 'cy'))} / 4, 6) AS middle_length FROM slants WHERE (ax, ay) <> (px, py) AND (bx, by_) <> (cx, cy) AND (cx, cy) <> (px, py)""")
def polyline_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straightness and lengths of four-point lines, and their pieces when cut half way along the first and a quarter along the second edge."""
    at = lambda p: F.struct(F.col(f"{p}x").alias("x"), F.col(f"{p}y").alias("y"))
    rows = slants(spark, sf_dir).where("(ax <> px or ay <> py) and (bx <> cx or by <> cy) and (cx <> px or cy <> py)")
    points = F.array(*(at(p) for p in "abcp"))
    cuts = F.array(
        F.struct(F.lit(0.5).alias("at"), ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y")),
        F.struct(F.lit(1.25).alias("at"), (F.col("bx") + (F.col("cx") - F.col("bx")) / 4).alias("x"), (F.col("by") + (F.col("cy") - F.col("by")) / 4).alias("y")),
    )
    out = rows.select("id", points.alias("points"), geo.cut(points, cuts).alias("parts"))
    return out.select("id", r6(geo.straightness(F.col("points"))).alias("bend"), r6(geo.polyline_length(F.col("points"))).alias("open_length"), r6(geo.polyline_length(F.col("points"), True)).alias("closed_length"), F.size("parts").alias("pieces"), r6(geo.polyline_length(F.get("parts", F.lit(1)))).alias("middle_length"))


@query(f"""WITH {SLANTS}, a AS (SELECT page, count(*) AS n, 0.5 * atan2(2 * covar_pop(bx, by_), var_pop(bx) - var_pop(by_)) AS a FROM slants GROUP BY page) SELECT page, n, round(CASE WHEN a < 0 THEN a + pi() ELSE a END, 6) AS axis FROM a""")
def principal_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The axis of largest variance of each page's points."""
    return slants(spark, sf_dir).groupBy("page").agg(F.count(F.lit(1)).alias("n"), r6(geo.principal_angle(F.col("bx"), F.col("by"))).alias("axis"))


COMMON = "greatest(0, least(x1 + 3, 220) - greatest(x0 - 3, 100)) * greatest(0, least(y1 + 3, 200) - greatest(y0 - 3, 80))"


@query(f"""WITH b AS (SELECT o_orderkey AS id, (o_orderkey * 37) % 300 AS x0, (o_orderkey * 53) % 240 AS y0, (o_orderkey * 37) % 300 + 10 + o_orderkey % 90 AS x1, (o_orderkey * 53) % 240 + 10 + o_orderkey % 70 AS y1 FROM orders)
  SELECT id, x0 - 3 <= 220 AND x1 + 3 >= 100 AND y0 - 3 <= 200 AND y1 + 3 >= 80 AS meets, x0 - 3 >= 100 AND x1 + 3 <= 220 AND y0 - 3 >= 80 AND y1 + 3 <= 200 AS inside, 150 BETWEEN x0 - 3 AND x1 + 3 AND 120 BETWEEN y0 - 3 AND y1 + 3 AS has_point,
  round(sqrt(pow(greatest(x0 - 3 - 150, 0, 150 - x1 - 3), 2) + pow(greatest(y0 - 3 - 120, 0, 120 - y1 - 3), 2)), 6) AS to_point, round(sqrt(pow(greatest(100 - x1 - 3, 0, x0 - 3 - 220), 2) + pow(greatest(80 - y1 - 3, 0, y0 - 3 - 200), 2)), 6) AS gap,
  {COMMON} AS common, (x1 - x0 + 6) * (y1 - y0 + 6) AS area, round({COMMON} / ((x1 - x0 + 6) * (y1 - y0 + 6) + 14400 - {COMMON}), 6) AS iou FROM b""")
def box_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes made larger, against a fixed box and a point."""
    from inkgrid.plans.geometry import boxes

    b, fixed, x, y = Box.of().expanded(3), Box(*map(F.lit, (100, 80, 220, 200))), F.lit(150), F.lit(120)
    return boxes(spark, sf_dir).select("id", b.intersects(fixed).alias("meets"), fixed.contains(b).alias("inside"), b.has(x, y).alias("has_point"), r6(b.to_point(x, y)).alias("to_point"), r6(b.gap(fixed)).alias("gap"), b.common(fixed).alias("common"), b.area.alias("area"), r6(b.iou(fixed)).alias("iou"))


LINE = "least({0}, {1}) || '/' || greatest({0}, {1})"


@query(f"""WITH {SLANTS}, v AS (SELECT *, bx / 7 AS x, by_ * 13 AS deg FROM slants), q AS (SELECT *, sign(x) * floor(abs(x) * 10000 + 0.5) / 10000 AS q FROM v)
  SELECT id, q AS half_up, round_even(x * 1000, 0) / 1000 AS half_even, round_even(x * 1e9, 0) / 1e9 AS scalar, (round_even(deg * 10, 0) / 10) % 360 AS tenth, CASE WHEN (ax, ay) <= (bx, by_) THEN 1 ELSE 2 END AS first_end, CASE WHEN (ax, ay) <= (px, py) THEN ax ELSE px END AS first_x,
  'pen_' || substr(sha256('{{"k0":"' || id % 5 || '","k1":' || id % 11 || '}}'), 1, 12) AS pen FROM q""")
def keys_and_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values on grids, keys that don't depend on direction, and content ids."""
    rows = slants(spark, sf_dir).withColumns({"x": F.col("bx") / 7, "deg": F.col("by") * 13})
    ends = canon.segment_key(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    line = canon.undirected(F.array(*(F.struct(F.col(f"{p}x").alias("x"), F.col(f"{p}y").alias("y")) for p in "abp")))
    first = F.when((ends[0].x == F.col("ax")) & (ends[0].y == F.col("ay")), 1).otherwise(2)
    return rows.select(
        "id", canon.quantise(F.col("x")).alias("half_up"), canon.quantise_even(F.col("x")).alias("half_even"), canon.quantise_scalar(F.col("x")).alias("scalar"), canon.quantise_degrees(F.col("deg")).alias("tenth"),
        first.alias("first_end"), line[0].x.alias("first_x"), canon.content_id("pen", (F.col("id") % 5).cast("string"), F.col("id") % 11).alias("pen"),
    )


@query(f"""WITH {STROKES} SELECT layer, pen, len AS width, count(*) AS n FROM strokes GROUP BY layer, pen, len""")
def pens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strokes by the key of their pen."""
    return strokes(spark, sf_dir).groupBy(canon.pen_key("layer", "pen", "len").alias("key")).agg(F.count(F.lit(1)).alias("n")).select("key.layer", "key.pen", F.col("key.len").alias("width"), "n")


@query(f"""WITH {NOTES}, w AS (SELECT p_partkey, label, note, string_split(note, ' ') AS words FROM notes)
  SELECT p_partkey, CASE WHEN regexp_matches(words[-1], '^[0-9]+$') AND CAST(words[-1] AS DOUBLE) BETWEEN 10 AND 3000 THEN CAST(words[-1] AS DOUBLE) END AS size, try_cast(nullif(regexp_extract(label, '[-/]([0-9]{{2,4}})$', 1), '') AS DOUBLE) AS digits,
  CASE WHEN note LIKE 'DN %' THEN 'dn' END AS rule, CASE WHEN note LIKE 'DN %' THEN CAST(words[2] AS DOUBLE) END AS mm, note LIKE '2024-%' AS is_date, contains(label, '-') AND regexp_matches(label, '[0-9]') AS is_code,
  label AS fuller, label IS NULL AS none, try_cast(replace(words[-1], '+', '') AS DOUBLE) AS number, regexp_replace(lower(note), '[^a-z0-9]+', '-', 'g') AS slug FROM w""")
def token_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What notes and labels state: sizes, digits, dimensions, dates, codes, numbers and slugs."""
    note, label = F.col("note"), F.col("label")
    last = F.element_at(F.split("note", " "), -1)
    head = F.regexp_extract("label", "^(.*)-[0-9]+$", 1)
    return notes(spark, sf_dir).select(
        "p_partkey", tokens.size(last).alias("size"), tokens.trailing_digits(label).alias("digits"), tokens.dimension(note).rule.alias("rule"), tokens.dimension(note).mm.alias("mm"), tokens.date_like(note).alias("is_date"), tokens.code_like(label).alias("is_code"),
        tokens.fuller(head, label).alias("fuller"), tokens.fuller(label, F.lit("x")).isNotNull().alias("none"), tokens.number(F.replace(last, F.lit("+"), F.lit(""))).alias("number"), tokens.slug(note).alias("slug"),
    )
