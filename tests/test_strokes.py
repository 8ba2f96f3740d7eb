import pytest
from pyspark.sql import Row

from inkgrid.operators import strokes as S
from inkgrid.operators.spatial import with_box


def segments(spark, rows):
    return with_box(spark.createDataFrame([(i, 0, "pen", "L", *map(float, r)) for i, r in enumerate(rows)], "id long, page int, pen string, layer string, ax double, ay double, bx double, by double"))


def test_dash_chains(spark):
    dashes = [(10 * i, 5, 10 * i + 6, 5) for i in range(20)] + [(0, 50, 6, 50), (10, 50, 16, 50), (3, 90, 3, 120)]
    out = S.dash_chains(segments(spark, dashes), ["page", "pen"]).collect()
    assert [(r.chain, r.members, r.ink, r.span) for r in out] == [(0, 20, 120.0, 196.0)]


def test_corners(spark):
    out = {r.id: r for r in S.heal_corners(segments(spark, [(0, 0, 98, 0), (100, 2, 100, 50), (300, 0, 350, 0)]), ["page"]).collect()}
    assert (out[0].bx, out[0].by, out[1].ax, out[1].ay) == (100.0, 0.0, 100.0, 0.0) and (out[2].ax, out[2].bx) == (300.0, 350.0) and out[1].by == 50.0


def test_characters(spark):
    parts = with_box(spark.createDataFrame([(1, 0, 0.0, 0.0, 4.0, 0.0), (2, 0, 2.0, 0.5, 2.0, 8.0), (3, 0, 10.0, 2.0, 10.0, 2.4), (4, 0, 10.0, 5.0, 10.0, 5.4), (5, 0, 40.0, 0.0, 90.0, 0.0)], "id long, page int, ax double, ay double, bx double, by double"))
    chars = S.characters(parts, ["page"], 8.0)
    assert sorted(r.ids for r in chars.collect()) == [[1, 2], [3], [4]]
    assert sorted(r.ids for r in S.stacked_parts(chars, ["page"], 8.0).collect()) == [[1, 2], [3, 4]]


def test_readings(spark):
    schema = "id string, page int, text string, x0 double, y0 double, x1 double, y1 double"
    spans = spark.createDataFrame([("s1", 0, "A-1", 0.0, 0.0, 10.0, 5.0), ("s2", 0, "B", 50.0, 0.0, 60.0, 5.0)], schema)
    read = spark.createDataFrame([("g1", 0, "A-l", 0.0, 0.0, 9.0, 5.0), ("g2", 0, "C", 90.0, 0.0, 99.0, 5.0)], schema)
    assert {(r.id, r.origin, r.reading, r.agree) for r in S.merge_readings(spans, read, ["page"]).collect()} == {("s1", "span+glyph", "g1", False), ("s2", "span", None, None), ("g2", "glyph", None, None)}


def test_shares_and_regions(spark):
    lines = segments(spark, [(0, 0, 10, 0), (10.5, 0, 20, 0), (200, 200, 220, 200)])
    assert S.chained_share(lines, ["page"], 2.0).first().chain == pytest.approx(2 / 3)
    ink = segments(spark, [(x / 10, y / 10, x / 10 + 1, y / 10) for x in range(100, 120) for y in range(100, 120)] + [(30 * i, 300, 30 * i + 5, 300) for i in range(20)])
    out = S.artwork_regions(ink, ["page"], 1e6).collect()
    assert len(out) == 1 and len(out[0].ids) == 400
    same = spark.createDataFrame([Row(id=1, page=0, node_a=1, node_b=2, pts=[Row(x=0.0, y=0.0), Row(x=1.0, y=1.0)]), Row(id=2, page=0, node_a=2, node_b=1, pts=[Row(x=1.0, y=1.0), Row(x=0.0, y=0.0)])])
    assert [r.ids for r in S.coincident(same, ["page"]).collect()] == [[1, 2]]
    assert {r.repeats for r in S.occurrences_on_sheet(spark.createDataFrame([(0, "a"), (0, "a")], "page int, text string"), ["page"]).collect()} == {2}
