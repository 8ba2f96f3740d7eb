import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import drawings

from inkgrid.functions import canon, geo
from inkgrid.functions.geo import Segment
from inkgrid.operators import decisions, pipes
from inkgrid.sources import pdf, pdfvector


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("pdf")
    (path / "a.pdf").write_bytes(drawings.pdf([drawings.sheet()]))
    (path / "a_marked.pdf").write_bytes(drawings.pdf([drawings.sheet()]))
    (path / "b.pdf").write_bytes(drawings.pdf([["0 0 m 10 0 l 10 10 l h S"], ["q 2 0 0 2 0 0 cm 1 w 1 0 0 RG [3 2] 0 d 1 1 m 5 1 l S Q"]], compress=False))
    (path / "notes.csv").write_text("x")
    return str(path)


def test_tables(spark, folder):
    pages = {(r.file[-5:], r.page): r for r in pdfvector.read(spark, folder, "pages").collect()}
    assert set(pages) == {("a.pdf", 0), ("b.pdf", 0), ("b.pdf", 1)} and pages["a.pdf", 0].n_annotations == 1
    b = {r.page: r for r in pdfvector.read(spark, f"{folder}/b.pdf").collect()}
    assert b[0].closed and len(b[0].pts) == 3 and b[1].stroke == [1.0, 0.0, 0.0] and b[1].dashes == "[3 2] 0" and b[1].stroke_width == 2.0
    assert (b[1].x0, b[1].y0, b[1].x1) == (2.0, 2.0, 10.0)
    spans = {r.text for r in pdfvector.read(spark, folder, "spans").collect()}
    assert spans == {"S1-P2-160", "S1-P2-75", "S1-P2-110"}
    assert pdfvector.read(spark, folder, "annotations").first().subtype == "Square"
    with pytest.raises(Exception, match="answer"):
        pdfvector.read(spark, f"{folder}/a_marked.pdf").count()
    with pytest.raises(ValueError):
        pdf.Document(b"no pdf")


def test_lengths_of_drawn_pipes(spark, folder):
    """From the file to metres: walls are paired, and the centrelines have the lengths that were drawn."""
    objects = pdfvector.read(spark, f"{folder}/a.pdf").where("layer = 'pipes'")
    segments = objects.select("object_id", "page", "layer", "stroke_width", F.posexplode(geo.edges(F.col("pts"), F.col("closed")))).select("object_id", "page", "layer", "stroke_width", "col.*")
    segments = segments.withColumn("id", F.xxhash64("object_id", "ax", "ay"))
    from inkgrid.operators.spatial import with_box

    lines = pipes.centrelines(with_box(segments), ["page", "layer", "stroke_width"])
    per_point = decisions.metres_per_point(F.lit(50))
    out = lines.select(F.round(canon.quantise(Segment.of().length * per_point), 3).alias("m"), F.round(decisions.measured_mm(F.col("width"), per_point)).alias("mm")).collect()
    assert sorted((r.m, r.mm) for r in out) == [(2.293, 75.0), (4.057, 110.0), (10.407, 160.0)]


def test_curve_chords_stay_near():
    points = [(0.0, 0.0), *pdf.chords((0, 0), (0, 55), (45, 100), (100, 100))]
    assert len(points) > 8 and all(abs(((x - 100) ** 2 + y**2) ** 0.5 - 100) < 1.0 for x, y in points)
