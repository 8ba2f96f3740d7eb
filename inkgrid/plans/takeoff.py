"""From a drawing's objects and texts to quantities: the stages in order, each a table.

Walls are paired to centrelines, cut at tees and joined to runs; labels reach runs only through leaders that end on
them; names spread along touching runs of a like width; lengths become metres where the sheet's scale is known.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.functions import canon, geo, tokens
from inkgrid.functions.geo import Segment
from inkgrid.operators import aggregates, decisions, evidence, graph, layout, pipes, spatial
from inkgrid.operators.islands import lowest_mode
from inkgrid.session import materialise

SHEET = ["doc_id", "page"]
PEN = ["stroke", "stroke_width", "dashes", "layer"]
LEAST_EDGE, WIDTH, TOUCH = 0.05, 0.12, 1.5


def texts(spans: DataFrame) -> DataFrame:
    return spans.select(F.concat_ws("/", "doc_id", "span_id").alias("id"), *SHEET, F.trim("text").alias("text"), "size", "x0", "y0", "x1", "y1")


def scales(items: DataFrame) -> DataFrame:
    """Metres per point of each sheet, from its ratio notes; null where they contradict each other."""
    notes = items.select(*SHEET, tokens.ratio(F.col("text")).alias("value"), F.lit(0.9).alias("weight"), F.lit("ratio").alias("source")).where("value is not null")
    out = decisions.scale(notes, SHEET)
    return out.select(*SHEET, F.col("state").alias("scale_state"), decisions.metres_per_point(F.col("value")).alias("per_point"))


def segments(objects: DataFrame) -> DataFrame:
    """The edges of stroked paths, with an id below 2**61."""
    paths = objects.where("kind = 'path' and stroke is not null")
    out = paths.select("object_id", *SHEET, *PEN, F.posexplode(geo.edges(F.col("pts"), F.col("closed"))).alias("place", "e")).select("object_id", *SHEET, *PEN, "place", "e.*")
    id_ = F.pmod(F.xxhash64("doc_id", "page", "object_id", "place"), F.lit(2**61))
    return spatial.with_box(out.where(Segment.of().length >= LEAST_EDGE).withColumn("id", id_))


def analyse(objects: DataFrame, spans: DataFrame, pages: DataFrame) -> dict[str, DataFrame]:
    """All stages of the documents in these tables, by name; quantities last."""
    items = materialise(texts(spans), "texts")
    cap = items.agg(lowest_mode("size")).first()[0] or 10.0
    edges = materialise(segments(objects), "segments")

    # sheet frames are no linework
    areas = pages.select(*SHEET, (F.col("width") * F.col("height")).alias("page_area"))
    framed = layout.frames(objects.join(areas, SHEET).withColumnRenamed("object_id", "id"), F.col("page_area")).select("id", *SHEET, "x0", "y0", "x1", "y1")
    lines = edges.join(layout.on_frame(edges, framed, SHEET), "id", "left_anti")

    # leaders first: what they consume is no wall
    labels = items.where(tokens.code_like(F.col("text")) & ~tokens.date_like(F.col("text")))
    traced = layout.leaders(labels, lines.select("id", *SHEET, "ax", "ay", "bx", "by"), SHEET, cap)
    leaders = materialise(traced.withColumn("leader", F.sha1(F.to_json(F.struct("text", "path")))), "leaders")
    consumed = leaders.select(F.explode("path").alias("id")).distinct()
    walls = materialise(lines.join(consumed, "id", "left_anti"), "walls")

    # centrelines, once each, cut where others meet them
    found = pipes.centrelines(walls, [*SHEET, *PEN]).withColumn("sources", F.array(F.col("u"), F.col("v")))
    flat = found.select("candidate_id", *SHEET, "layer", "ax", "ay", "bx", "by", "style", "width", "sources", "confidence")
    candidates = materialise(pipes.collapse_concentric(pipes.collapse_exact(flat, SHEET).drop("all_sources", "instances"), SHEET), "candidates")
    whole = candidates.withColumn("id", F.pmod(F.xxhash64("doc_id", "page", "candidate_id"), F.lit(2**61)))
    cut = pipes.split_tees(whole.drop("least_width", "most_width", "instances"), SHEET).withColumn("edge", F.pmod(F.xxhash64("id", "part"), F.lit(2**61)))
    cut = materialise(cut, "edges")
    nodes, ends = pipes.nodes(cut, SHEET)
    ends = materialise(ends, "ends")
    runs = materialise(pipes.runs(cut, ends), "runs")
    member = runs.select("run", F.explode("edges").alias("edge"))
    placed = materialise(cut.join(member, "edge"), "placed")

    # names: leaders that end on one run, then neighbours of a like width
    tips = leaders.join(items.select(F.col("id").alias("text"), F.col("text").alias("label"), *SHEET), "text")
    attached = layout.attach(tips.select("leader", F.col("label").alias("text"), *SHEET, "tip"), placed.select("run", *SHEET, "ax", "ay", "bx", "by"), SHEET, max(4.0, 1.2 * cap))
    attached = materialise(attached, "attachments")
    named = decisions.label_conflicts(attached.where("run is not null"))
    touching = ends.join(member, "edge").join(runs.select("run", "width"), "run")
    a, b = spatial.prefixed(touching, "l_"), spatial.prefixed(touching, "r_")
    like = F.abs(F.col("l_width") - F.col("r_width")) <= WIDTH * F.greatest("l_width", "r_width")
    meets = a.join(b, (F.col("l_node") == F.col("r_node")) & (F.col("l_run") < F.col("r_run"))).where(like).select(F.col("l_run").alias("u"), F.col("r_run").alias("v")).distinct()
    meets = materialise(meets, "meets")
    seeds = named.where("designation is not null").select(F.col("run").alias("node"), F.col("designation").alias("label"))
    spread = graph.propagate(seeds, meets).select(F.col("node").alias("run"), F.when(F.size("labels") == 1, F.get("labels", F.lit(0))).alias("designation"), F.size("labels").alias("n_labels"), "depth")

    # measures and states of runs, then pipes and quantities
    scale = scales(items)
    sheets = placed.groupBy("run").agg(*(F.min(c).alias(c) for c in SHEET))
    measured = runs.join(sheets, "run").join(scale, SHEET, "left").join(spread, "run", "left")
    label_mm = tokens.trailing_size(F.col("designation"))
    d = decisions.diameter(label_mm, decisions.measured_mm(F.col("width"), F.col("per_point")))
    state = F.when(F.col("designation").isNull(), F.when(F.col("n_labels") > 1, "AMBIGUOUS").otherwise("UNRESOLVED")).otherwise("HIGH_CONFIDENCE")
    reasons = F.array_compact(F.array(F.when(F.col("designation").isNull(), F.when(F.col("n_labels") > 1, F.lit("AMBIGUOUS_ASSOCIATION")).otherwise(F.lit("NO_ASSOCIATION_EVIDENCE"))), F.when(F.col("per_point").isNull(), F.lit("NO_SCALE")), d.reason))
    confidence = F.least(d.confidence, decisions.hop_confidence(F.coalesce("depth", F.lit(9))))
    ready = measured.withColumns({"diameter": d.mm, "nominal": label_mm, "state": state, "reasons": reasons, "confidence": confidence, "vertical": F.lit(0.0), "length_pt": F.col("length"), "length": canon.quantise(F.col("length") * F.col("per_point"))})
    ready = materialise(ready, "measured")
    physical = pipes.pipes(ready, meets, F.lit(1.0)).withColumnRenamed("length_pt", "length_m")
    nominal = ready.select(F.col("run").alias("pipe"), "nominal", *SHEET)
    physical = materialise(physical.join(nominal, "pipe"), "pipes")
    quantities = aggregates.quantities(physical.where("designation is not null"))
    return {"texts": items, "leaders": leaders, "candidates": candidates, "edges": cut, "nodes": nodes, "runs": runs, "attachments": attached, "pipes": physical, "quantities": quantities}


def census(stages: dict[str, DataFrame]) -> DataFrame:
    """How many rows each stage has."""
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n") for name, df in stages.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def shapes(stages: dict[str, DataFrame]) -> DataFrame:
    """Centrelines as shapes for an SVG of each page."""
    c = stages["candidates"]
    pts = F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))
    w = Window.partitionBy(*SHEET).orderBy("candidate_id")
    return c.select(*SHEET, F.coalesce("layer", F.lit("-")).alias("layer"), F.lit("HIGH_CONFIDENCE").alias("state"), pts.alias("pts"), F.concat(F.lit("line "), F.row_number().over(w)).alias("label"))


def why(stages: dict[str, DataFrame], id_: str, depth: int = 6) -> DataFrame:
    """Every step back from a pipe, run or leader to the runs, candidates, strokes, leaders and texts that it was made of."""
    c = lambda df, child, parent, relation: evidence.link(df.where(F.col(parent).isNotNull()), child, parent, relation)
    runs = stages["runs"].select("run", F.explode("edges").alias("edge"))
    attached = stages["attachments"].where("run is not null").select("run", "leader", "text")
    edges = [
        c(stages["pipes"].select("pipe", F.explode("runs").alias("run")), "pipe", "run", "made_of_run"), c(runs, "run", "edge", "made_of_edge"), c(attached, "run", "leader", "named_by_leader"), c(attached, "leader", "text", "begins_at_text"),
        c(stages["edges"].select("edge", F.explode("sources").alias("source")), "edge", "source", "drawn_by_stroke"),
    ]
    every = materialise(reduce(DataFrame.unionByName, edges), "evidence")
    kinds = every.select(F.col("child").alias("id"), F.regexp_extract("relation", "^([a-z]+)_", 1).alias("kind"), F.lit("").alias("label")).limit(0)
    nothing = kinds.select("id", F.col("label").alias("reason"))
    start = every.select(F.lit(id_).alias("id")).limit(1)
    return evidence.why(kinds, every, nothing, start, depth).select("start", "id", "parent", "relation", "depth")
