import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from inkgrid.operators import links as L
from inkgrid.operators.spatial import with_box

BOXED = "id string, page int, x0 double, y0 double, x1 double, y1 double"


def P(x, y):
    return Row(x=float(x), y=float(y))


def test_markup_and_sources(spark):
    schema = "object_id string, page int, pts array<struct<x: double, y: double>>, x0 double, y0 double, x1 double, y1 double"
    objects = spark.createDataFrame([("o1", 0, [P(0, 0), P(5, 5)], 0.0, 0.0, 5.0, 5.0), ("o2", 0, [P(0, 0), P(5, 9)], 0.0, 0.0, 5.0, 9.0)], schema)
    marks = spark.createDataFrame([(0, [P(5.01, 5), P(0, 0)], 0.0, 0.0, 5.01, 5.0)], "page int, pts array<struct<x: double, y: double>>, x0 double, y0 double, x1 double, y1 double")
    assert [r.object_id for r in L.exclude_markup(objects, marks, ["page"]).collect()] == ["o2"]
    runs = spark.createDataFrame([(1, [10, 11])], "run long, edges array<long>")
    edges = spark.createDataFrame([(10, ["b"]), (11, ["a", "b"])], "edge long, sources array<string>")
    assert L.source_objects(runs, edges).first().sources == ["a", "b"]
    segs = with_box(spark.createDataFrame([("x", 0, 0.0, 0.0, 10.0, 0.0), ("w", 0, 0.0, 4.0, 10.0, 4.0)], "object_id string, page int, ax double, ay double, bx double, by double"))
    tips = spark.createDataFrame([("t", 0, 5.0, 2.0), ("far", 0, 500.0, 2.0)], "id string, page int, x double, y double")
    assert [(r.id, r.object_id, r.distance) for r in L.nearest_source(tips, segs, ["page"], 10.0).collect()] == [("t", "w", 2.0)]
    symbols = spark.createDataFrame([("s1", 0, 0.0, 0.0, 6.0, 6.0), ("s2", 0, 490.0, 0.0, 510.0, 9.0), ("s3", 0, 499.0, 0.0, 501.0, 9.0)], BOXED)
    assert [(r.id, r.symbol) for r in L.symbol_at(tips, symbols, ["page"]).collect()] == [("t", "s1")]


def test_gates(spark):
    row = spark.range(1).select(L.layer_gate(F.array(F.lit("a")), F.array(F.lit("b"))), L.layer_gate(F.array(F.lit("a")), None), L.pen_gate(F.lit(0.35), [0.33]), L.pen_gate(F.lit(None).cast("double"), [0.33]), L.pen_gate(F.lit(9.0), None)).first()
    assert tuple(row) == (False, True, True, False, True)
    roles = spark.createDataFrame([("a", "WALL", "object", 0.1), ("b", "WALL", "layer", 0.5), ("c", "PIPE", "layer", 0.9), ("d", "HATCH", "layer", 0.8)], "object_id string, role string, source string, confidence double")
    assert sorted(r.object_id for r in L.non_pipe(roles).collect()) == ["a", "d"]
    pieces = spark.createDataFrame([(1, 6.0, True, True), (1, 4.0, True, False), (2, 1.0, False, True)], "pipe int, length double, layer_ok boolean, pen_ok boolean")
    assert {r.pipe: (r.share, r.counts) for r in L.attested_share(pieces).collect()} == {1: (0.6, True), 2: (0.0, False)}


def test_texts_and_associations(spark):
    texts = spark.createDataFrame([("t1", 0, 0.0, 0.0, 10.0, 8.0), ("t2", 0, 2.0, 10.0, 9.0, 18.0), ("t3", 0, 200.0, 0.0, 210.0, 8.0)], BOXED)
    assert {(r.id, r.other) for r in L.adjacent_lines(texts, ["page"]).collect()} == {("t1", "t2"), ("t2", "t1")}
    leaders = spark.createDataFrame([Row(leader="l1", page=0, root=P(11, 4)), Row(leader="l2", page=0, root=P(12, 4)), Row(leader="l3", page=0, root=P(900, 4))])
    assert [(r.leader, r.text) for r in L.leaders_by_text(leaders, texts, ["page"], 5.0).collect()] == [("l1", "t1")]
    forward = spark.createDataFrame([(1, "A", 1.0), (2, "A", 9.0), (3, "B", 1.0), (4, "B", 1.01), (1, "C", 2.0)], "pipe long, text string, distance double")
    labels = spark.createDataFrame([("A", 0, 0.0, 0.0, 1.0, 1.0)], "text string, page int, x0 double, y0 double, x1 double, y1 double")
    pipes = spark.createDataFrame([(9, 0, 2.0, 0.0, 3.0, 1.0)], "pipe long, page int, x0 double, y0 double, x1 double, y1 double")
    out = {r.pipe: (r.text, r.state) for r in L.both_ways(forward, labels, pipes, ["page"], 4.0).collect()}
    assert out == {1: (None, "AMBIGUOUS"), 3: (None, "AMBIGUOUS"), 9: (None, "HINT")}


def test_readings(spark):
    schema = "text_id string, place int, character string, alternatives array<struct<character: string, score: double>>"
    g = spark.createDataFrame([("t", 0, "1", [("I", 0.9), ("1", 1.0)]), ("t", 1, ";", [(":", 0.8)]), ("t", 2, "5", []), ("t", 3, "0", [("O", 0.2)])], schema)
    out = L.alternative_readings(g, ["text_id"]).orderBy("rank").collect()
    assert [r.text for r in out] == ["1;50", "I;50", "1:50", "I:50"]  # one character read otherwise, or two
    r = L.ratio_hypotheses(spark.createDataFrame([("s", "1:50", 0.0), ("s", "1:100", 0.5), ("s", "x", 0.0)], "sheet string, text string, cost double"), ["sheet"]).collect()
    assert {x.value: round(x.weight, 4) for x in r} == {50.0: 0.9, 100.0: round(0.55 * 2.718281828459045**-1, 4)}


def test_profiles(spark):
    rows = [(0, "path", True, [0.0], None, "[3 2] 0", "a", 0.35), (0, "path", False, None, [1.0], "[] 0", None, None), (0, "image", True, None, None, "", "a", 0.0)]
    p = L.profile(spark.createDataFrame(rows, "page int, kind string, closed boolean, stroke array<double>, fill array<double>, dashes string, layer string, stroke_width double"), ["page"]).first()
    assert (p.objects, p.stroked, p.filled, p.closed, p.dashed, p.images, p.layers) == (3, 1, 1, 2, 1, 1, 1)
    m = L.metrics(spark.createDataFrame([("A", 110.0, None, 0.5, "AMBIGUOUS"), (None, None, None, None, "CONFIRMED")], "designation string, diameter double, horizontal_m double, confidence double, state string")).first()
    assert (m.pipes, m.named, m.measured, m.mean_confidence, m.ambiguous) == (2, 1, 0, pytest.approx(0.5), 1)
    texts = spark.createDataFrame([("t1", 0, 0.0, 0.0, 10.0, 8.0), ("t2", 0, 2.0, 10.0, 9.0, 18.0)], BOXED)
    failures = spark.createDataFrame([Row(text="t1", tip=P(50, -5), reason="LEADER_ENDS_NOWHERE")])
    out = {(r.id, r.reason): (r.x0, r.y0, r.x1) for r in L.crop_requests(failures, texts, texts.where("id = 't1'")).collect()}
    assert out == {("t1", "LEADER_ENDS_NOWHERE"): (-12.0, -17.0, 62.0), ("t2", "NO_DIMENSION_EVIDENCE"): (-10.0, -2.0, 21.0)}
