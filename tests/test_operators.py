import itertools
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import drawings

from inkgrid.functions import canon, geo, raster, states, tokens
from inkgrid.functions.geo import Segment
from inkgrid.operators import aggregates, decisions, evaluate, evidence, graph, layout, pipes, search, spatial
from inkgrid.sources import pdfvector, sinks
from inkgrid.streaming import jobs


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def seg(*v):
    return Segment(*(F.lit(float(x)) for x in v))


def test_geometry(spark):
    s, t = seg(0, 0, 10, 0), seg(2, 3, 8, 3)
    line = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (10, 0), (10, 5))))
    cuts = F.array(F.struct(F.lit(0.5).alias("at"), F.lit(5.0).alias("x"), F.lit(0.0).alias("y")))
    r = one(
        spark, geo.degrees(seg(0, 0, -1, 1)), geo.angle_between(F.lit(179.0), F.lit(2.0), 180), geo.point_distance(s, F.lit(13.0), F.lit(4.0)), geo.segment_distance(s, t), geo.crossing(s, seg(5, -1, 5, 1)),
        geo.crossing(s, t), geo.overlap_fraction(s, t), geo.overlap_of_shorter(s, t), F.struct(*(getattr(geo.midline(s, t), c).alias(c) for c in ("ax", "ay", "bx", "by"))), geo.polyline_length(line), geo.polyline_length(line, True), geo.direction(line),
        geo.straightness(line), geo.cut(line, cuts), s.box().gap(t.box()), s.box().iou(s.box()), geo.line_offset(s, F.lit(1.0), F.lit(2.0)),
    )
    assert r[0] == pytest.approx(135) and r[1] == 3 and r[2] == 5 and r[3] == 3 and tuple(r[4]) == (5, 0) and r[5] is None and r[6] == pytest.approx(0.6) and r[7] == pytest.approx(1)
    assert tuple(r[8]) == (2, 1.5, 8, 1.5) and r[9] == 15 and r[10] == pytest.approx(15 + 125**0.5) and r[11] == "mixed" and r[12] == pytest.approx(10 * 5 / 125**0.5 / 125**0.5)
    assert [[tuple(p) for p in piece] for piece in r[13]] == [[(0, 0), (5, 0)], [(5, 0), (10, 0), (10, 5)]] and r[14] == 3 and r[15] is None and r[16] == 2


def test_canonical_values(spark):
    values = [0.00005, -0.00005, 1.00015, -0.0, 2.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(canon.quantise(F.col("v"))).collect()]
    assert got == [0.0001, -0.0001, 1.0002, 0.0, 2.5] and str(got[3]) == "0.0"
    assert [r[0] for r in df.select(canon.quantise_even(F.col("v"), 1.0)).collect()] == [0, 0, 1, 0, 2]
    nan = spark.createDataFrame([(float("nan"),), (None,)], "v double")
    assert [tuple(r) for r in nan.select(canon.quantise(F.col("v")), canon.quantise_even(F.col("v"))).collect()] == [(None, 0.0), (None, None)]
    p = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(0.0).alias("y")) for x in (3.0, 1.0, 2.0)))
    a, b = one(spark, canon.undirected(p), canon.undirected(F.reverse(p)))
    assert a == b and canon_id(spark, "x") != canon_id(spark, "y")


def canon_id(spark, v):
    return one(spark, canon.content_id("run", F.lit(v), F.lit(1)))[0]


def test_tokens(spark):
    texts = {"S1-P2-110": ("L1D1S1L1D1S1D3", True, 110.0), "2024-04-19": ("D4S1D2S1D2", True, 19.0), "ROOM 12": ("L4S1D2", False, None), "é5": ("L1D1", False, None), "": ("", False, None)}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", tokens.pattern(F.col("t")), tokens.code_like(F.col("t")), tokens.trailing_size(F.col("t"))).collect():
        assert tuple(r)[1:] == texts[r.t], r.t
    r = one(spark, tokens.ratio(F.lit("SKALA 1:50 (A1)")), tokens.ratio(F.lit("11:50")), tokens.elevation(F.lit("VG -0,150")), tokens.elevation(F.lit("2.8")), tokens.dimension(F.lit("DN110")), tokens.dimension(F.lit("200x300")), tokens.fuller(F.lit("A-1"), F.lit("A-1-110")), tokens.number(F.lit(" 1,5")), tokens.date_like(F.lit("2024-04-19")))
    assert r[0] == 50 and r[1] is None and r[2] == -0.15 and r[3] is None and tuple(r[4]) == ("dn", 110) and tuple(r[5]) == ("box", 200) and r[6] == "A-1-110" and r[7] == 1.5 and r[8]


def test_states(spark):
    df = spark.createDataFrame([("a", "CONFIRMED", 1.0, ["x"]), ("a", "AMBIGUOUS", None, ["y", "x"]), ("b", "HIGH_CONFIDENCE", 2.0, [])], "k string, s string, v double, r array<string>")
    out = {r.k: r for r in df.groupBy("k").agg(states.worst(F.col("s")).alias("s"), states.strict_sum(F.col("v")).alias("v"), states.reasons(F.col("r")).alias("r")).collect()}
    assert (out["a"].s, out["a"].v, out["a"].r, out["b"].v) == ("AMBIGUOUS", None, ["x", "y"], 2.0)


def random_segments(spark, n=150, seed=0):
    rng = np.random.default_rng(seed)
    a, d = rng.uniform(0, 300, (n, 2)), rng.uniform(-80, 80, (n, 2))
    rows = [(i, 0, float(p[0]), float(p[1]), float(p[0] + q[0]), float(p[1] + q[1])) for i, (p, q) in enumerate(zip(a, d, strict=True))]
    return spatial.with_box(spark.createDataFrame(rows, "id long, page int, ax double, ay double, bx double, by double")), rows


def test_grid_join_equals_nested_loops(spark):
    df, rows = random_segments(spark)
    for pad, cell in ((0.0, 60.0), (15.0, 20.0), (40.0, 500.0)):
        got = [(r.l_id, r.r_id) for r in spatial.grid_join(df, df, ["page"], pad, cell).select("l_id", "r_id").collect()]
        box = lambda r: (min(r[2], r[4]), min(r[3], r[5]), max(r[2], r[4]), max(r[3], r[5]))
        want = {(a[0], b[0]) for a, b in itertools.product(rows, rows) if (p := box(a)) and (q := box(b)) and p[0] - pad <= q[2] and q[0] <= p[2] + pad and p[1] - pad <= q[3] and q[1] <= p[3] + pad}
        assert len(got) == len(set(got)) and set(got) == want


def test_matching_components_and_walks(spark):
    rng = np.random.default_rng(5)
    rows = sorted({(int(u), int(v)) for u, v in rng.integers(0, 60, (150, 2)) if u < v})
    df = spark.createDataFrame([(u, v, float((u * 7 + v * 3) % 11)) for u, v in rows], "u long, v long, s double")
    used, want = set(), set()
    for u, v, s in sorted(((u, v, float((u * 7 + v * 3) % 11)) for u, v in rows), key=lambda r: (r[2], r[0], r[1])):
        if not {u, v} & used:
            used |= {u, v}
            want.add((u, v))
    assert {(r.u, r.v) for r in graph.matching(df, [F.col("s"), F.col("u"), F.col("v")]).collect()} == want
    root = {i: i for i in range(60)}
    for _ in range(60):
        for u, v in rows:
            root[u] = root[v] = min(root[u], root[v])
    assert all(root[r.node] == r.root for r in graph.components(df).collect())
    path = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 2), (3, 4), (3, 5)], "u long, v long")
    walked = graph.walk(spark.createDataFrame([(9, 1), (8, 4)], "start long, node long"), path).collect()
    assert {(r.start, tuple(r.path), r.stop) for r in walked} == {(9, (1, 2, 3), "fork"), (8, (4,), "end")}
    seeds = spark.createDataFrame([(1, "a"), (5, "b")], "node long, label string")
    spread = {r.node: (r.depth, r.labels) for r in graph.propagate(seeds, path).collect()}
    assert spread == {1: (0, ["a"]), 5: (0, ["b"]), 2: (1, ["a"]), 3: (1, ["b"]), 4: (2, ["b"])}


def test_empty_graphs(spark):
    none = spark.createDataFrame([], "u long, v long, s double")
    assert graph.components(none).count() == 0 and graph.matching(none, [F.col("s")]).count() == 0 and graph.mutual_best(none, "s").count() == 0


def test_nodes_runs_and_pipes(spark):
    """A tee: a long pipe that another one meets in its middle, and a straight continuation."""
    lines = spark.createDataFrame([(1, 0, 0.0, 0.0, 100.0, 0.0, 8.0, "d"), (2, 0, 50.0, 1.0, 50.0, 60.0, 8.0, "d"), (3, 0, 100.5, 0.0, 160.0, 0.0, 8.2, "d")], "id long, page int, ax double, ay double, bx double, by double, width double, style string")
    cut = pipes.split_tees(lines, ["page"]).withColumn("edge", F.col("id") * 10 + F.col("part"))
    assert sorted((r.edge, r.ax, r.bx) for r in cut.collect()) == [(10, 0, 50), (11, 50, 100), (20, 50, 50), (30, 100.5, 160)]
    found, ends = pipes.nodes(cut, ["page"])
    assert sorted(r.degree for r in found.collect()) == [1, 1, 1, 2, 3]
    out = {tuple(r.edges): r for r in pipes.runs(cut, ends).collect()}
    assert set(out) == {(10, 11, 30), (20,)} and out[10, 11, 30].length == pytest.approx(159.5)
    rows = spark.createDataFrame([(1, "A", 110.0, 100.0, 2.0, "CONFIRMED", [], 0.9), (2, "A", 110.0, 50.0, None, "CONFIRMED", ["x"], 0.5), (3, "B", 110.0, 10.0, 0.0, "CONFIRMED", [], 0.9)], "run long, designation string, diameter double, length double, vertical double, state string, reasons array<string>, confidence double")
    touches = spark.createDataFrame([(1, 2), (2, 3)], "u long, v long")
    got = {r.pipe: r for r in pipes.pipes(rows, touches, F.lit(0.01)).collect()}
    assert got[1].runs == [1, 2] and got[1].horizontal_m == 1.5 and got[1].total_m is None and got[1].state == "AMBIGUOUS" and got[3].state == "HIGH_CONFIDENCE"


def test_duplicates(spark):
    rows = [("c1", 0, 0.0, 0.0, 9.0, 0.0, "double_line", 8.0, ["a"]), ("c2", 0, 9.0, 0.0, 0.0, 0.0, "double_line", 8.0, ["b"]), ("c3", 0, 0.0, 0.0, 9.0, 0.0, "single_line", None, ["c"])]
    df = spark.createDataFrame(rows, "candidate_id string, page int, ax double, ay double, bx double, by double, style string, width double, sources array<string>")
    exact = pipes.collapse_exact(df, ["page"]).collect()
    assert sorted(r.instances for r in exact) == [1, 2] and [r.all_sources for r in exact if r.instances == 2] == [["a", "b"]]
    both = pipes.collapse_concentric(df, ["page"]).collect()
    assert len(both) == 1 and both[0].candidate_id == "c1" and both[0].instances == 3


def test_decisions(spark):
    rows = [("s", 50.0, 0.9, "ratio"), ("s", 51.0, 0.5, "bar"), ("t", 50.0, 0.9, "ratio"), ("t", 100.0, 0.6, "bar"), ("u", 20.0, 0.3, "bar")]
    out = {r.sheet: r for r in decisions.scale(spark.createDataFrame(rows, "sheet string, value double, weight double, source string"), ["sheet"]).collect()}
    assert [(out[k].state, out[k].value is None) for k in "stu"] == [("SCALE_CONFIRMED", False), ("SCALE_CONFLICT", True), ("RESOLVED", False)]
    assert one(spark, decisions.paper(F.lit(841.9), F.lit(1190.6)))[0] == "A3" and one(spark, decisions.paper(F.lit(500.0), F.lit(500.0)))[0] is None
    d = [tuple(one(spark, decisions.diameter(F.lit(a).cast("double"), F.lit(b).cast("double")))[0]) for a, b in ((110, 112), (110, 75), (None, 75), (110, None), (None, None))]
    assert d == [(110.0, 0.97, None), (75.0, 0.6, "DIMENSION_CONFLICT"), (75.0, 0.8, None), (110.0, 0.7, "NO_DRAWN_WIDTH"), (None, 0.0, "NO_DIMENSION_EVIDENCE")]
    c = decisions.label_conflicts(spark.createDataFrame([(1, "A-1"), (1, "A-1-110"), (2, "A"), (2, "B"), (3, "C"), (3, "C")], "run int, text string"))
    assert {r.run: r.designation for r in c.collect()} == {1: "A-1-110", 2: None, 3: "C"}
    near = spark.createDataFrame([("l1", "r1", 1.0), ("l1", "r2", 1.5), ("l2", "r1", 1.0), ("l2", "r2", 3.0)], "leader string, run string, distance double")
    a = decisions.associate(spark.createDataFrame([("l1", "x"), ("l2", "y"), ("l3", "z")], "leader string, text string"), near, 5.0)
    assert {r.leader: (r.run, r.reason) for r in a.collect()} == {"l1": (None, "COMPETING_PIPES"), "l2": ("r1", None), "l3": (None, "LEADER_ENDS_NOWHERE")}


def test_quantities_and_evaluation(spark):
    schema = "designation string, nominal double, diameter double, horizontal_m double, vertical_m double, total_m double, state string, reasons array<string>, confidence double"
    rows = [("A", 110.0, 110.0, 1.0, None, None, "CONFIRMED", [], 0.9), ("A", 110.0, 75.0, 2.0, 3.0, 5.0, "AMBIGUOUS", ["x"], 0.5), ("B", 50.0, None, 2.0, None, 2.0, "CONFIRMED", [], 1.0)]
    out = {r.designation: r for r in aggregates.quantities(spark.createDataFrame(rows, schema)).collect()}
    assert (out["A"].horizontal_m, out["A"].vertical_m, out["A"].total_m, out["A"].diameter, out["A"].reasons) == (3, 3, None, 110, ["DIMENSION_CONFLICT", "x"]) and out["B"].vertical_m is None
    got = spark.createDataFrame([("A", 110.4, 1.0, None, 1.0), ("C", 50.0, 1.0, None, 1.0)], "designation string, diameter double, horizontal_m double, vertical_m double, total_m double")
    want = spark.createDataFrame([("A", 110.0, 1.04, None, 9.0), ("D", None, 1.0, None, 1.0)], got.schema)
    s = evaluate.summary(evaluate.compare(got, want)).first()
    assert (s.tp, s.fp, s.fn, s.precision, s.horizontal_m_accuracy, s.total_m_accuracy) == (1, 1, 1, 0.5, 1.0, 0.0)


def test_layer_roles(spark):
    schema = "layer string, n long, median_extent double, closed double, filled double, long double, text double, dashed double, span double, dominant_dash string, chain double"
    rows = [("pipes", 10, 60.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.9, "[3]", 1.0), ("letters", 10, 3.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.1, None, 0.0), ("most", 90, 60.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.9, "[3]", 1.0)]
    out = {r.layer: r.role for r in aggregates.layer_roles(spark.createDataFrame(rows, schema), 5.0, []).collect()}
    assert out == {"pipes": "PIPE", "letters": "TEXT", "most": "UNKNOWN"}


def test_search_and_layout(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(drawings.pdf([drawings.sheet()]))
    objects = pdfvector.read(spark, str(tmp_path)).cache()
    spans = pdfvector.read(spark, str(tmp_path), "spans").withColumn("text_id", F.col("span_id")).withColumn("id", F.col("span_id"))
    sheet = search.Sheet.of_objects(objects, spans)
    assert sheet.search_text("s1-p2").count() == 3 and sheet.search_text("S1-P2", case_sensitive=True).count() == 3 and sheet.search_text("^S1.P2.75$", regex=True).count() == 1
    assert sheet.search_vertical().count() > 0 and sheet.search_geometry(min_length=580, angle=0).count() >= 2
    assert sheet.search_paths(line_width=0.35).count() == 6 and sheet.search_paths(closed=True).count() == 1
    wall = sheet.segments.where("stroke_width = 0.35").first().id
    assert sheet.search_parallel(wall).count() >= 1 and sheet.search_near_text("110", 60.0).count() > 0
    assert search.union(sheet.search_text("75"), sheet.search_text("75"), sheet.search_vertical(), limit=2).count() == 2
    assert {(r.all_pages, r.all_kinds) for r in sheet.inventory().collect()} == {(0, 0), (1, 0), (1, 1)}
    strokes = sheet.segments.where("stroke_width = 0.2")
    traced = layout.leaders(spans, strokes, ["page"], 10.0).collect()
    assert len(traced) == 3 and {round(r.tip.y) for r in traced} == {620, 400, 330} and all(len(r.path) == 1 for r in traced)
    runs = sheet.segments.where("layer = 'pipes'").withColumn("run", F.col("id"))
    tips = spark.createDataFrame([Row(leader=r.text, text=r.text, page=0, tip=Row(x=r.tip.x, y=r.tip.y)) for r in traced])
    assert all(r.reason in (None, "COMPETING_PIPES") for r in layout.attach(tips, runs, ["page"], 8.0).collect())


def test_panels_blocks_and_bars(spark):
    texts = spark.createDataFrame([("t1", 0, "S1-P2", 10.0, 10.0, 50.0, 18.0), ("t2", 0, "110", 12.0, 20.0, 40.0, 28.0), ("t3", 0, "1:50", 300.0, 300.0, 330.0, 308.0), ("t4", 0, "x", 300.0, 320.0, 330.0, 328.0)], "id string, page int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [(r.lines, r.x1) for r in layout.label_blocks(texts, ["page"], 8.0).collect() if len(r.lines) > 1] == [(["S1-P2", "110"], 50.0)]
    assert [(r.code, r.part) for r in layout.stacked_labels(texts, ["page"], 8.0).collect()] == [("S1-P2", "110")]
    boxes = spark.createDataFrame([("p", 0, 290.0, 290.0, 340.0, 340.0), ("q", 0, 280.0, 280.0, 400.0, 400.0)], "id string, page int, x0 double, y0 double, x1 double, y1 double")
    assert [(r.id, r.n_texts, r.panel_kind) for r in layout.panels(boxes, texts, ["page"], 100_000.0).collect()] == [("p", 2, "title_block")]
    cells = spark.createDataFrame([(i, 0, 10.0 * i, 0.0, 10.0 * i + 10, 4.0) for i in range(5)], "id long, page int, x0 double, y0 double, x1 double, y1 double")
    assert [(r.n, r.length) for r in layout.scale_bars(cells, ["page"]).collect()] == [(5, 50.0)]
    shade = spark.createDataFrame([(i, 0, 0.0, 3.0 * i, 20.0, 3.0 * i) for i in range(15)], "id long, page int, ax double, ay double, bx double, by double")
    assert layout.hatches(shade, ["page"]).first().n == 15
    notes = spark.createDataFrame([("e1", 0, 2.8, 0.0, 0.0, 5.0, 5.0), ("e2", 0, 0.15, 0.0, 8.0, 5.0, 12.0)], "id string, page int, elevation double, x0 double, y0 double, x1 double, y1 double")
    assert layout.risers(boxes.limit(1).withColumns({c: F.lit(6.0) for c in ("x0", "y0", "x1", "y1")}), notes, ["page"], 20.0).first().height_m == pytest.approx(2.65)


def test_raster_kernels(spark):
    square, bar = [[(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]], [[(0, 0), (0, 10)]]
    tee = [[(0, 0), (10, 0)], [(5, 0), (5, 10)]]
    f = raster.features(square)
    assert f["holes"] == 1 and raster.features(bar)["holes"] == 0 and raster.features(tee)["ends"] == 3 and raster.features(tee)["junctions"] == 1
    a, b = (raster.thin(raster.rasterise(x)) for x in (square, bar))
    assert raster.chamfer(a, a) == 0 and raster.chamfer(a, b) > 3 and raster.jaccard(a, a) == 0 < raster.jaccard(a, b)
    rng = np.random.default_rng(1)
    for _ in range(20):
        costs = rng.uniform(0, 3, (4, 4))
        best = min(sum(costs[i, p[i]] for i in range(4)) for p in itertools.permutations(range(4)))
        got = raster.assign(costs, duplicate=10.0, reject=50.0)
        assert sum(costs[i, j] for i, j in enumerate(got)) == pytest.approx(best)
    assert raster.assign(np.array([[9.0]])) == [-1] and raster.assign(np.zeros((0, 3))) == []
    shapes = {"O": square, "I": bar, "T": tee}
    df = spark.createDataFrame([(k, [[Row(x=float(x), y=float(y)) for x, y in line] for line in v]) for k, v in shapes.items()], "truth string, polylines array<array<struct<x: double, y: double>>>")
    bank = [{"character": k, **raster.features(v)} for k, v in shapes.items()]
    out = raster.classify(raster.with_features(df), bank).collect()
    assert all(r.alternatives[0].character == r.truth and r.alternatives[0].distance == 0 for r in out)


def test_evidence(spark):
    edges = evidence.link(spark.createDataFrame([("p", "r"), ("r", "o1"), ("r", "o2")], "c string, p string"), "c", "p", "made_of")
    entities = evidence.declare(spark.createDataFrame([("p", "pipe"), ("r", "run")], "id string, name string"), "thing", "id", "name")
    refused = evidence.reject(spark.createDataFrame([("o1", "OTHER")], "id string, why string"), "id", "why")
    ids = spark.createDataFrame([("p",)], "id string")
    steps = evidence.why(entities, edges, refused, ids).collect()
    assert {(r.id, r.parent, r.depth) for r in steps} == {("p", "r", 1), ("r", "o1", 2), ("r", "o2", 2)} and [r.refused for r in steps if r.parent == "o1"] == [["OTHER"]]
    assert {r.ancestor for r in evidence.chain(edges, ids).collect()} == {"r", "o1", "o2"}


def test_sinks_and_truth(spark, tmp_path):
    schema = "designation string, diameter double, horizontal_m double, vertical_m double, total_m double, n_pipes long, state string, reasons array<string>, confidence double"
    rows = spark.createDataFrame([("A", 110.0, 1.5, None, None, 1, "CONFIRMED", ["x", "y"], 0.5)], schema)
    sinks.quantities_csv(rows, f"{tmp_path}/q")
    text = "".join(p.read_text() for p in tmp_path.glob("q/*.csv"))
    assert "x;y" in text and "designation,diameter" in text
    (tmp_path / "t.csv").write_text('Beteckning,DN,Langd,Summa\nA,110,"1,5",2\n')
    assert tuple(sinks.read_truth(spark, f"{tmp_path}/t.csv").first()) == ("A", 110.0, 1.5, None, 2.0)
    (tmp_path / "t.json").write_text('{"quantities": [{"designation": "A", "diameterMm": 110, "horizontalM": 1.5, "totalM": 2}]}')
    assert tuple(sinks.read_truth(spark, f"{tmp_path}/t.json").first()) == ("A", 110.0, 1.5, None, 2.0)
    shapes = spark.createDataFrame([("d", 0, "pipes", "CONFIRMED", [Row(x=0.0, y=0.0), Row(x=5.0, y=5.0)], "A<1"), ("d", 1, "pipes", "AMBIGUOUS", [Row(x=0.0, y=0.0)], None)], "doc_id string, page int, layer string, state string, pts array<struct<x: double, y: double>>, label string")
    assert sinks.svg(shapes, f"{tmp_path}/svg", 100, 100) == 2 and "A&lt;1" in (tmp_path / "svg/d-0.svg").read_text()
    assert sinks.canonical_json({"b": 1.0, "a": [0.1 + 0.2, -0.0]}) == '{"a":[0.3,0.0],"b":1.0}'
    with pytest.raises(ValueError):
        sinks.canonical_json(float("nan"))
    sinks.freeze(rows, f"{tmp_path}/frozen")
    assert sinks.changes(rows, f"{tmp_path}/frozen").count() == 0 and sinks.changes(rows.limit(0), f"{tmp_path}/frozen").first().change == "gone"
    sinks.write_report({"rows": rows}, f"{tmp_path}/report", "inkgrid/analysis/1")
    assert '"schema":"inkgrid/analysis/1"' in (tmp_path / "report/index.json").read_text()


def test_results_do_not_depend_on_order(spark):
    df, _ = random_segments(spark, 80, 3)
    assert sinks.same_whatever_the_order(df, lambda d: spatial.touching(d, ["page"], 10.0).select("l_id", "r_id"))
    assert not sinks.same_whatever_the_order(df, lambda d: d.limit(5).select("id"))


def test_jobs(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet")
    want = {tuple(r) for r in jobs.states_of(events).collect()}
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    q = jobs.stream(spark, f"{tmp_path}/in", events.schema, "job_states", f"{tmp_path}/checkpoint")
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("job_states").collect()} == want
    known = spark.createDataFrame([("a", "succeeded", 1), ("b", "running", 1), ("c", "queued", 2)], "job string, state string, attempts int")
    assert {r.job: (r.state, r.attempts) for r in jobs.recovered(known).collect()} == {"a": ("succeeded", 1), "b": ("queued", 2), "c": ("failed", 3)}
    sent = spark.createDataFrame([("a", "x"), ("d", "y"), ("d", "y")], "job string, content string")
    assert [r.job for r in jobs.new_jobs(sent, known).collect()] == ["d"]


def test_evaluation_is_out_of_reach_of_detection():
    """No operator, function, source or query but evaluation itself and its queries imports evaluate."""
    root = Path(__file__).resolve().parents[1] / "inkgrid"
    users = {p.relative_to(root).as_posix() for p in root.rglob("*.py") if "evaluate" in p.read_text() and "import" in p.read_text() and p.name != "evaluate.py" and "operators.evaluate" in p.read_text()}
    assert users <= {"plans/relational.py"}
    assert not any("inkgrid.llm" in p.read_text() for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts)


def test_components_of_few_edges(spark, monkeypatch):
    """In one task and two writes, not in rounds; with the results of rounds, whatever the order, ids and repeats."""
    rng = np.random.default_rng(4)
    chain = [(i + 1, i) for i in range(300)]
    star = [(10**6, 10**5 + i) for i in range(50)]
    loose = [(int(a), int(b)) for a, b in rng.integers(-(2**62), 2**62, 40)[:, None] ^ rng.integers(0, 60, (40, 2))]
    some = [(int(a) + 5000, int(b) + 5000) for a, b in rng.integers(0, 200, (120, 2))]
    rows = [*chain, *star, *loose, *some, *some[:20], (7, 7), (None, 3)]
    rng.shuffle(rows)
    df = spark.createDataFrame([tuple(None if x is None else int(x) for x in r) for r in rows], "u long, v long").repartition(5)
    writes = []
    inner = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda frame, name: writes.append(name) or inner(frame, name))
    found = sorted(map(tuple, graph.components(df, len(rows)).collect()))
    assert len(writes) == 2
    assert found == sorted(map(tuple, graph.components(df).collect())) == sorted(map(tuple, graph.components(df, 10).collect()))
    assert {r for n, r in found if 0 <= n <= 300} == {0} and len(writes) > 8
    assert graph.components(df.limit(0), 10).count() == 0
