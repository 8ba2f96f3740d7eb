"""Links between stages: sources of runs, symbols at points, gates of layers and pens, readings, profiles and failures."""

from __future__ import annotations

from functools import reduce
from math import e

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.functions import geo, tokens
from inkgrid.functions.geo import Box, Segment
from inkgrid.operators import graph, spatial
from inkgrid.operators.search import is_dashed

#: Roles that are no pipes, and the least confidence of a verdict that comes from a layer.
NON_PIPE = ("WALL", "GRID", "HATCH", "REFERENCE_LINE", "TITLE_BLOCK", "LEGEND")
LAYER_CONFIDENCE = 0.75


def exclude_markup(objects: DataFrame, annotations: DataFrame, keys: list[str], tolerance: float = 0.05) -> DataFrame:
    """objects without those that copy an annotation: as many points, each with a counterpart within tolerance."""
    marks = annotations.where(F.size("pts") > 0)
    near = lambda p, q: (F.abs(p.x - q.x) <= tolerance) & (F.abs(p.y - q.y) <= tolerance)
    all_in = lambda a, b: F.forall(a, lambda p: F.exists(b, lambda q: near(p, q)))
    same = (F.size(F.array_distinct("l_pts")) == F.size(F.array_distinct("r_pts"))) & all_in(F.col("l_pts"), F.col("r_pts"))
    copies = spatial.grid_join(objects, marks, keys, tolerance, cell=240.0, on=same).select(F.col("l_object_id").alias("object_id")).distinct()
    return objects.join(copies, "object_id", "left_anti")


def source_objects(runs: DataFrame, edges: DataFrame) -> DataFrame:
    """runs: run, edges (array). edges: edge, sources (array). The objects that each run is made of."""
    member = runs.select("run", F.explode("edges").alias("edge")).join(edges.select("edge", "sources"), "edge")
    return member.select("run", F.explode("sources").alias("source")).distinct().groupBy("run").agg(F.array_sort(F.collect_list("source")).alias("sources"))


def nearest_source(tips: DataFrame, segments: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """tips: id, x, y. The object whose stroke is nearest to each tip, of equal ones the first by id."""
    probes = tips.withColumns({"x0": F.col("x"), "y0": F.col("y"), "x1": F.col("x"), "y1": F.col("y")})
    near = spatial.grid_join(probes, segments, keys, reach).withColumn("d", geo.point_distance(Segment.of("r_"), F.col("l_x"), F.col("l_y")))
    return near.where(F.col("d") <= reach).groupBy(F.col("l_id").alias("id")).agg(F.min(F.struct("d", F.col("r_object_id").alias("object_id"))).alias("best")).select("id", "best.object_id", F.col("best.d").alias("distance"))


def symbol_at(points: DataFrame, symbols: DataFrame, keys: list[str]) -> DataFrame:
    """The symbol that holds each point, if it is the only one."""
    probes = points.withColumns({"x0": F.col("x"), "y0": F.col("y"), "x1": F.col("x"), "y1": F.col("y")})
    inside = spatial.grid_join(probes, symbols, keys).groupBy(F.col("l_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("r_id").alias("symbol"))
    return inside.where("n = 1").select("id", "symbol")


def leaders_by_text(leaders: DataFrame, texts: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """leaders: leader and root (x, y). The nearest text to each leader's start; of leaders at one text the first."""
    probes = leaders.select("leader", *keys, F.col("root.x").alias("x0"), F.col("root.y").alias("y0"), F.col("root.x").alias("x1"), F.col("root.y").alias("y1"))
    near = spatial.within(probes, texts, keys, reach)
    nearest = graph.best_by(near, ["l_leader"], [F.col("gap"), F.col("r_id")]).select(F.col("l_leader").alias("leader"), F.col("r_id").alias("text"), "gap")
    return graph.best_by(nearest, ["text"], [F.col("leader")])


def layer_gate(layers: Column, attested: Column | None) -> Column:
    """Whether any of a run's layers is attested; without attested layers everything passes."""
    return F.lit(True) if attested is None else F.coalesce(F.arrays_overlap(layers, attested), F.lit(False))


def pen_gate(width: Column, attested: list[float] | None, tolerance: float = 0.15) -> Column:
    """Whether a pen is within tolerance of an attested one; null fails, and without attested pens everything passes."""
    if attested is None:
        return F.lit(True)
    return F.coalesce(reduce(lambda a, b: a | b, (F.abs(width - w) <= tolerance * w for w in attested), F.lit(False)), F.lit(False))


def non_pipe(roles: DataFrame) -> DataFrame:
    """Objects whose role rules out a pipe; verdicts that come from a layer count only when they are sure."""
    return roles.where(F.col("role").isin(*NON_PIPE) & ((F.col("source") != "layer") | (F.col("confidence") >= LAYER_CONFIDENCE))).select("object_id").distinct()


def attested_share(pieces: DataFrame, least: float = 0.5) -> DataFrame:
    """pieces: pipe, length, layer_ok, pen_ok. Pipes with the share of their length on attested layers and pens, and whether they count."""
    share = F.try_divide(F.sum(F.when(F.col("layer_ok") & F.col("pen_ok"), F.col("length")).otherwise(0.0)), F.sum("length"))
    return pieces.groupBy("pipe").agg(share.alias("share")).withColumn("counts", F.col("share") >= least)


def adjacent_lines(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of texts that overlap in x and follow each other within 1.5 heights in y, in reading order."""
    a, b = Box.of("l_"), Box.of("r_")
    gap = F.greatest(b.y0 - a.y1, a.y0 - b.y1)
    on = (F.col("l_id") != F.col("r_id")) & (gap <= 1.5 * (a.y1 - a.y0)) & (F.least(a.x1, b.x1) > F.greatest(a.x0, b.x0))
    near = spatial.grid_join(texts, texts, keys, 60.0, on=on)
    order = Window.partitionBy("l_id").orderBy("r_y0", "r_x0", "r_id")
    return near.select(F.col("l_id").alias("id"), F.col("r_id").alias("other"), F.row_number().over(order).alias("place"))


def both_ways(forward: DataFrame, labels: DataFrame, pipes: DataFrame, keys: list[str], reach: float, eps: float = 0.05) -> DataFrame:
    """forward: pipe, text, distance (from leaders' ends). The other rule of association: a pipe with one label text is CONFIRMED, with
    several or a tie AMBIGUOUS; a label within reach of the pipe itself corroborates, or is a hint where no leader came."""
    w = Window.partitionBy("text").orderBy("distance", "pipe")
    ranked = forward.withColumns({"place": F.row_number().over(w), "next": F.lead("distance").over(w)}).where("place = 1")
    tie = F.coalesce(F.col("next") - F.col("distance") < eps, F.lit(False))
    claims = ranked.withColumn("tie", tie).groupBy("pipe").agg(F.array_sort(F.collect_set("text")).alias("texts"), F.bool_or("tie").alias("tie"))
    back = spatial.within(labels, pipes, keys, reach).groupBy(F.col("r_pipe").alias("pipe")).agg(F.array_sort(F.collect_set("l_text")).alias("near"))
    both = claims.join(back, "pipe", "full")
    one = (F.size("texts") == 1) & ~F.col("tie")
    seen = F.coalesce(F.array_contains("near", F.get("texts", F.lit(0))), F.lit(False))
    state = F.when(F.col("texts").isNull(), "HINT").when(one, "CONFIRMED").otherwise("AMBIGUOUS")
    score = F.when(F.col("texts").isNull(), 0.0).when(one, 0.70 + 0.20 * seen.cast("int")).otherwise(0.4)
    return both.select("pipe", F.when(one, F.get("texts", F.lit(0))).alias("text"), state.alias("state"), score.alias("score"), seen.alias("corroborated"))


def alternative_readings(glyphs: DataFrame, keys: list[str], most: int = 8, least: float = 0.45) -> DataFrame:
    """glyphs: place, character and alternatives (character, score) of a text. The text, and the `most` best texts with one or two
    characters read otherwise, by the product of their scores. A text is one row of its characters.
    """
    order = F.array_sort(F.collect_list(F.struct("place", "character", "alternatives")))
    text = glyphs.groupBy(*keys).agg(order.alias("g")).withColumn("characters", F.transform("g", lambda g: g.character))
    other = F.flatten(F.transform("g", lambda g, i: F.transform(F.filter(g.alternatives, lambda a: (a.score >= least) & (a.character != g.character)), lambda a: F.struct(i.alias("i"), a.character.alias("c"), a.score.alias("score")))))
    none = F.expr("cast(null as struct<i: int, c: string, score: double>)")
    one = text.select(*keys, "characters", other.alias("other")).select(*keys, "characters", "other", F.explode("other").alias("a"))
    # with itself alone, or with a second one at a later place
    both = one.select(*keys, "characters", "a", F.explode(F.concat(F.array(none), F.filter("other", lambda x: x.i > F.col("a.i")))).alias("b"))
    changed = F.array_join(F.transform("characters", lambda c, i: F.when(i == F.col("a.i"), F.col("a.c")).when(i == F.col("b.i"), F.col("b.c")).otherwise(c)), "")
    rows = both.select(*keys, changed.alias("text"), (F.col("a.score") * F.coalesce(F.col("b.score"), F.lit(1.0))).alias("score"))
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), "text")
    own = text.select(*keys, F.array_join("characters", "").alias("text"), F.lit(1.0).alias("score"), F.lit(0).alias("rank"))
    return own.unionByName(rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most))


def ratio_hypotheses(readings: DataFrame, keys: list[str]) -> DataFrame:
    """readings: text, cost (0 for the text itself). Scales that texts state, with weights that fall with the cost of a reading."""
    found = readings.withColumn("value", tokens.ratio(F.col("text"))).where("value is not null")
    weight = F.when(F.col("cost") <= 0, 0.9).otherwise(F.greatest(F.lit(0.05), 0.55 * F.pow(F.lit(e), -2 * F.col("cost"))))
    return found.select(*keys, "value", weight.alias("weight"), F.when(F.col("cost") <= 0, "ratio").otherwise("ratio_alternative").alias("source"))


def profile(objects: DataFrame, keys: list[str]) -> DataFrame:
    """One row a page: counts of objects by what they are."""
    n = F.count_if
    return objects.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("objects"), n(F.col("stroke").isNotNull()).alias("stroked"), n(F.col("fill").isNotNull()).alias("filled"), n(F.col("closed")).alias("closed"),
        n(is_dashed(F.col("dashes"))).alias("dashed"), n(F.col("kind") == "image").alias("images"), F.count_distinct("layer").alias("layers"), F.count_distinct("stroke_width").alias("pens"), F.count_distinct("stroke").alias("colours"),
    )


def metrics(pipes: DataFrame) -> DataFrame:
    """Counts by what is known, and the mean of confidences that are present."""
    known = lambda c: F.count(c)  # noqa: E731  null-ignoring
    return pipes.agg(F.count(F.lit(1)).alias("pipes"), known("designation").alias("named"), known("diameter").alias("sized"), known("horizontal_m").alias("measured"), F.avg("confidence").alias("mean_confidence"), F.count_if(F.col("state") == "AMBIGUOUS").alias("ambiguous"))


def crop_requests(failures: DataFrame, texts: DataFrame, sized: DataFrame, pad: float = 12.0) -> DataFrame:
    """Regions worth looking at: failed leaders (their text's box and the tip) and designations without a size."""
    box = Box.of()
    with_tip = failures.join(texts.select(F.col("id").alias("text"), "page", "x0", "y0", "x1", "y1"), "text")
    around = lambda side, pick, at: pick(F.col(side), F.col(at))
    failed = with_tip.select("page", F.col("text").alias("id"), F.col("reason"), (around("x0", F.least, "tip.x") - pad).alias("x0"), (around("y0", F.least, "tip.y") - pad).alias("y0"), (around("x1", F.greatest, "tip.x") + pad).alias("x1"), (around("y1", F.greatest, "tip.y") + pad).alias("y1"))
    bare = texts.join(sized.select("id").distinct(), "id", "left_anti").select("page", "id", F.lit("NO_DIMENSION_EVIDENCE").alias("reason"), *box.expanded(pad).columns())
    return failed.unionByName(bare)
