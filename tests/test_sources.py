import datetime
import io
import sys
import zipfile
from functools import reduce
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import drawings

from inkgrid.functions import raster
from inkgrid.operators import decisions, spatial
from inkgrid.operators import strokes as S
from inkgrid.sources import pdf, pdfvector, sinks, xlsx
from inkgrid.streaming import jobs


def workbook(rows, shared=True):
    """A spreadsheet of one sheet."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    texts, cells = [], []
    for y, row in enumerate(rows, 1):
        cells.append(f'<row r="{y}">')
        for x, v in enumerate(row):
            name = f"{chr(65 + x)}{y}"
            if isinstance(v, str) and shared:
                texts.append(v)
                cells.append(f'<c r="{name}" t="s"><v>{len(texts) - 1}</v></c>')
            elif isinstance(v, str):
                cells.append(f'<c r="{name}" t="inlineStr"><is><t>{v}</t></is></c>')
            elif v is not None:
                cells.append(f'<c r="{name}"><v>{v}</v></c>')
        cells.append("</row>")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="a" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(cells)}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si><t>{t}</t></si>' for t in texts)}</sst>")
    return out.getvalue()


def test_spreadsheet_truth(spark, tmp_path):
    plain = [["Beteckning", "Dimension", "Horisontell", "Vertikal", "Totalt"], ["S1-P1-75", 75, "1,5", 2, 3.5], [None, 1, 2, 3, 4], ["S2", None, None, None, None]]
    markup = [["Subject", "Längd", "Antal", "Höjd"], ["S1-P1-75", 2.5, None, None], ["S1-P1-75", 1.25, None, None], ["S1-P1-75 vertikal", None, 2, 3], ["Highlight", None, None, None], ["S9 Riser", None, 1, 2.5]]
    for shared in (True, False):
        (tmp_path / "a.xlsx").write_bytes(workbook(plain, shared))
        got = {r.designation: tuple(r)[1:] for r in sinks.read_truth(spark, f"{tmp_path}/a.xlsx").collect()}
        assert got == {"S1-P1-75": (75.0, 1.5, 2.0, 3.5), "S2": (None, None, None, None)}
        (tmp_path / "b.xlsx").write_bytes(workbook(markup, shared))
        got = {r.designation: tuple(r)[1:] for r in sinks.read_truth(spark, f"{tmp_path}/b.xlsx").collect()}
        assert got == {"S1-P1-75": (75.0, 3.75, 6.0, 9.75), "S9": (None, 0.0, 2.5, 2.5)}
    (tmp_path / "c.xlsx").write_bytes(workbook([]))
    assert xlsx.read(spark, f"{tmp_path}/c.xlsx").count() == 0 and xlsx.column("AB12") == 27
    with pytest.raises(ValueError):
        sinks.read_truth(spark, "x.ods")


def with_font(lines):
    data = drawings.pdf([lines], compress=False)
    font = b"/Font << /F1 << /Type /Font /Subtype /TrueType /BaseFont /ABCDEF+Lucida /FirstChar 65 /Widths [250 1000] /FontDescriptor << /MissingWidth 400 /FontFile2 50 0 R >> >> >> "
    program = b"50 0 obj\n<< /Length 4 >>\nstream\nFONT\nendstream\nendobj\n"
    return data.replace(b"/Resources << ", b"/Resources << " + font).replace(b"trailer", program + b"trailer")


def test_fonts_widths_and_characters(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(with_font(["BT", "/F1 10 Tf", "1 0 0 -1 100 50 Tm", "[(AB) -100 (C)] TJ", "(A) Tj", "ET"]))
    (fonts,) = pdfvector.read(spark, str(tmp_path), "fonts").collect()
    assert (fonts.name, fonts.base_font, fonts.embedded, fonts.program, bytes(fonts.data)) == ("F1", "ABCDEF+Lucida", True, "FontFile2", b"FONT")
    assert [(r.font, r.pages) for r in pdfvector.font_programs(pdfvector.read(spark, str(tmp_path), "fonts")).collect()] == [("Lucida", 1)]
    glyphs = [(r.character, round(r.x0, 3), round(r.x1, 3), r.confidence) for r in pdfvector.read(spark, str(tmp_path), "glyphs").orderBy("glyph_id").collect()]
    assert glyphs == [("A", 100.0, 102.5, 1.0), ("B", 102.5, 112.5, 1.0), ("C", 113.5, 117.5, 1.0), ("A", 117.5, 120.0, 1.0)]
    spans = [(r.text, round(r.x1, 3)) for r in pdfvector.read(spark, str(tmp_path), "spans").orderBy("span_id").collect()]
    assert spans == [("ABC", 117.5), ("A", 120.0)]
    page = pdfvector.read(spark, str(tmp_path), "pages").first()
    assert len(page.sha1) == 40 and page.crop_x1 == 1190.55


def test_two_ways_to_flatten(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(drawings.pdf([["0 0 m 0 20 20 20 20 0 c S", "0 0 m 0 400 400 400 400 0 c S"]]))
    steps = sorted(len(r.pts) for r in pdfvector.read(spark, str(tmp_path), flatten="steps").collect())
    assert steps == [25, 25] or steps[0] < steps[1] == 25
    assert sorted(len(r.pts) for r in pdfvector.read(spark, str(tmp_path)).collect()) != steps
    points = pdf.stepped((0, 0), (0, 1), (1, 1), (1, 0))
    assert len(points) == 4 and points[1] == (0.5, 0.75) and points[-1] == (1, 0)


@pytest.mark.parametrize(("name", "clean"), [("plan.pdf", True), ("plan_take_off.pdf", False), ("Markerad.pdf", False), ("mangder.pdf", True), ("mangd.pdf", False), ("quantities-1.pdf", False), ("plan.xlsx", False)])
def test_blind_names(name, clean):
    assert pdfvector.blind(f"/x/{name}") == (clean and "mangd" not in name)


def test_masks():
    ink = np.zeros((200, 100), bool)
    ink[50:150, 40:60] = True
    mask, aspect = raster.rasterise_mask(ink)
    ys, xs = np.nonzero(mask)
    assert aspect == 0.2 and (np.ptp(ys) + 1, np.ptp(xs) + 1) == (40, 8) and mask.sum() == 320
    small, _ = raster.rasterise_mask(np.eye(3, dtype=bool))
    assert small.shape == (raster.SIDE, raster.SIDE) and small.any() and not raster.rasterise_mask(np.zeros((4, 4), bool))[0].any()
    line = raster.rasterise_in([[(0, 0), (10, 10)], [(5, 5), (5, 5)]], (0, 0, 10, 10))
    assert line.shape == (32, 32) and line.sum() == 29 and (np.nonzero(line)[0] == np.nonzero(line)[1]).all()


def test_scales_join_the_mean_of_a_cluster(spark):
    """A chain of values each near the next is not one cluster."""
    values = [100.0, 104.0, 108.0, 112.0]
    clusters = []
    for v in values:
        for c in clusters:
            if abs(v - sum(c) / len(c)) <= 0.05 * sum(c) / len(c):
                c.append(v)
                break
        else:
            clusters.append([v])
    assert clusters == [[100.0, 104.0], [108.0, 112.0]]
    df = spark.createDataFrame([("a", v, 0.9, "ratio") for v in values] + [("b", 50.0, 0.9, "ratio"), ("b", 51.0, 0.5, "bar"), ("b", 200.0, 0.5, "bar"), ("c", 100.0, 0.9, "ratio"), ("c", 104.0, 0.9, "ratio"), ("c", 108.0, 0.3, "ratio")], "sheet string, value double, weight double, source string")
    got = {r.sheet: (r.state, r.value and round(r.value, 4), r.sources) for r in decisions.scale(df, ["sheet"]).collect()}
    assert got == {"a": ("SCALE_CONFLICT", None, 1), "b": ("SCALE_CONFIRMED", round((50 * 0.9 + 51 * 0.5) / 1.4, 4), 2), "c": ("RESOLVED", 102.0, 1)}


def test_k_nearest_goes_as_far_as_it_must(spark):
    rows = [(i, 0, float(x), 0.0) for i, x in enumerate([0, 1, 3, 1000, 5000])] + [(9, 1, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, page int, x0 double, y0 double").withColumns({"x1": F.col("x0"), "y1": F.col("y0")})
    got = {}
    for r in spatial.k_nearest(df, df, ["page"], 2, 2.0, others=True).collect():
        got.setdefault(r.l_id, []).append((r.place, r.r_id))
    assert {k: [b for _, b in sorted(v)] for k, v in got.items()} == {0: [1, 2], 1: [0, 2], 2: [1, 0], 3: [2, 1], 4: [3, 2]}


def test_signatures_meet_in_parts_and_clusters_need_no_pairs(spark, monkeypatch):
    """Parts of few rows, copies, repeated ids, nulls, NaN and other widths against all pairs; clusters against a walk over them."""
    monkeypatch.setattr(S, "BLOCK", 7)
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(2)), rng.normal(0, 2, 3).tolist()) for i in range(120)] + [(200 + i, 1, [50.0, 1.0, 2.0]) for i in range(30)] + [(200, 1, [50.5, 1.0, 2.0])]
    rows += [(300, 0, [0.0, 0.0]), (301, 0, [0.0, 1.0]), (302, 0, None), (303, 0, [None, 1.0, 1.0]), (304, 0, [float("nan"), 1.0, 1.0]), (305, 0, [float("inf"), 1.0, 1.0]), (306, 0, []), (307, 0, []), (308, 0, [1e300, 0.0, 0.0]), (309, 0, [1e300, 1.0, 0.0])]
    good = [r for r in rows if r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])]
    apart = lambda x, y: reduce(float.__add__, (abs(i - j) for i, j in zip(x, y, strict=True)), 0.0)  # noqa: E731  sum() would round otherwise
    want = sorted((a[0], b[0], apart(a[2], b[2])) for a in good for b in good if a[0] < b[0] and a[1] == b[1] and len(a[2]) == len(b[2]) and apart(a[2], b[2]) <= 1.5)
    df = spark.createDataFrame(rows, "id int, block int, signature array<double>")
    assert sorted((r.u, r.v, r.distance) for r in S.like_signatures(df, ["block"], 1.5).collect()) == want
    root = {r[0]: r[0] for r in rows}
    for _ in rows:
        for u, v, _ in want:
            root[u] = root[v] = min(root[u], root[v])
    assert {(r.id, r.cluster) for r in S.shape_clusters(df, ["block"], 1.5).collect()} == set(root.items())
    met = S._meetings(df, ["block"], 1.5, "signature", "id").groupBy("block", "w", "r", "p", "o", "q").count()
    assert met.agg({"count": "max"}).first()[0] < 80


def test_like_signatures_equal_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(3)), rng.normal(0, 3, 4).tolist()) for i in range(150)]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and np.abs(np.array(a[2]) - b[2]).sum() <= 4.0}
    df = spark.createDataFrame(rows, "id int, block int, signature array<double>")
    assert {(r.u, r.v) for r in S.like_signatures(df, ["block"], 4.0).collect()} == want and want


def test_worker_runs_each_job_once_and_outlives_failures(spark, tmp_path):
    schema = "job string, content string"
    seen = []

    def job(batch):
        rows = batch.collect()
        seen.extend(r.job for r in rows)
        if any(r.content == "bad" for r in rows):
            raise RuntimeError("cannot run")
        return batch.select("job", F.lit("succeeded").alias("state"))

    submit = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: jobs.work(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, f"{tmp_path}/log", f"{tmp_path}/check", job).awaitTermination()
    submit([("a", "x"), ("a", "x")])
    run()
    submit([("b", "bad")])
    run()
    submit([("a", "x"), ("c", "y")])
    run()
    got = {r.job: (r.state, r.error) for r in jobs.status(spark, f"{tmp_path}/log").collect()}
    assert got == {"a": ("succeeded", None), "b": ("failed", "cannot run"), "c": ("succeeded", None)} and seen == ["a", "b", "c"]
    assert jobs.status(spark, f"{tmp_path}/none") is None


def test_heartbeats(spark):
    at = datetime.datetime(2024, 1, 1, 12, 0)
    rows = [("a", at), ("a", at - datetime.timedelta(minutes=5)), ("b", at - datetime.timedelta(minutes=3))]
    out = jobs.heartbeats(spark.createDataFrame(rows, "job string, ts timestamp"), "2024-01-01 12:00:30").collect()
    assert {r.job: r.late for r in out} == {"a": False, "b": True}


def test_crops_move_shapes_to_their_box(spark):
    at = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    shapes = spark.createDataFrame([("d", 0, "a", at((10, 10), (20, 10))), ("d", 0, "b", at((500, 500), (510, 500))), ("d", 1, "c", at((10, 10), (20, 10)))], "doc_id string, page int, label string, pts array<struct<x: double, y: double>>")
    wanted = spark.createDataFrame([(7, "d", 0, 5.0, 5.0, 30.0, 30.0), (8, "d", 0, 0.0, 0.0, 600.0, 600.0)], "id int, doc_id string, page int, x0 double, y0 double, x1 double, y1 double")
    got = {(r.page, r.label): [(p.x, p.y) for p in r.pts] for r in sinks.crops(shapes, wanted).collect()}
    assert got == {(7, "a"): [(5.0, 5.0), (15.0, 5.0)], (8, "a"): [(10.0, 10.0), (20.0, 10.0)], (8, "b"): [(500.0, 500.0), (510.0, 500.0)]}


def test_search_leaders(spark):
    from inkgrid.operators.search import Sheet

    point = "struct<x: double, y: double>"
    leaders = spark.createDataFrame([("l1", "t1", 0, (1.0, 9.0), (4.0, 2.0))], f"leader string, text string, page int, root {point}, tip {point}")
    segments = spark.createDataFrame([], "id string, page int, ax double, ay double, bx double, by double")
    (hit,) = Sheet(segments, segments, segments).search_leaders(leaders).collect()
    assert tuple(hit) == (0, "leader", "l1", 1.0, 2.0, 4.0, 9.0, "t1")


def test_worker_analyses_drawings(spark, tmp_path):
    from inkgrid.__main__ import drawn

    (tmp_path / "plan.pdf").write_bytes(drawings.pdf([drawings.sheet()]))
    batch = spark.createDataFrame([("good", f"{tmp_path}/plan.pdf"), ("bad", f"{tmp_path}/none.pdf")], "job string, content string")
    assert {r.job: r.state for r in drawn(batch, f"{tmp_path}/out").collect()} == {"good": "succeeded", "bad": "failed"}
    assert spark.read.parquet(f"{tmp_path}/out/good").count() == 3
