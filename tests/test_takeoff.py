import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import drawings

from inkgrid.__main__ import main
from inkgrid.plans import takeoff
from inkgrid.sources import pdfvector


def note(text, x, y):
    return ["BT", "/F1 10 Tf", f"1 0 0 -1 {x} {y} Tm", f"({text}) Tj", "ET"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("takeoff")
    branch = drawings.pipe((400, 618), (400, 500), 160)  # meets the first pipe's middle and takes its name
    traps = [*note("2024-04-19", 900, 700), *note("ROOM 12", 900, 720), *drawings.pipe((900, 100), (900, 160), 50)]
    (path / "sheet.pdf").write_bytes(drawings.pdf([[*drawings.sheet(), *branch, *traps, *note("SKALA 1:50", 900, 800)]]))
    (path / "unscaled.pdf").write_bytes(drawings.pdf([drawings.sheet()]))
    return path


def tables(spark, path):
    return (pdfvector.read(spark, path, t) for t in ("objects", "spans", "pages"))


def test_quantities_of_a_sheet(spark, folder):
    stages = takeoff.analyse(*tables(spark, f"{folder}/sheet.pdf"))
    rows = {r.designation: r for r in stages["quantities"].collect()}
    assert set(rows) == {"S1-P2-160", "S1-P2-110", "S1-P2-75"}
    assert rows["S1-P2-110"].horizontal_m == pytest.approx(4.0569, abs=0.002) and rows["S1-P2-75"].horizontal_m == pytest.approx(2.2931, abs=0.002)
    assert rows["S1-P2-160"].horizontal_m == pytest.approx(10.4069 + 118 * 0.0176389, abs=0.05) and rows["S1-P2-160"].diameter == 160
    assert {r.state for r in rows.values()} == {"HIGH_CONFIDENCE"}
    unnamed = [r for r in stages["pipes"].collect() if r.designation is None]
    assert len(unnamed) == 1 and unnamed[0].state == "UNRESOLVED" and unnamed[0].reasons == ["NO_ASSOCIATION_EVIDENCE"]
    assert {r.stage: r.n for r in takeoff.census(stages).collect()}["leaders"] == 3


def test_no_scale_means_no_length(spark, folder):
    stages = takeoff.analyse(*tables(spark, f"{folder}/unscaled.pdf"))
    rows = stages["quantities"].collect()
    assert len(rows) == 3 and all(r.horizontal_m is None and "NO_SCALE" in r.reasons for r in rows)


def test_commands(spark, folder, tmp_path, capsys):
    assert main(["analyse", f"{folder}/sheet.pdf", str(tmp_path)]) == 0
    assert "S1-P2-160" in "".join(p.read_text() for p in tmp_path.glob("quantities/*.csv")) and len(list(tmp_path.glob("svg/*.svg"))) == 1
    assert main(["search", f"{folder}/sheet.pdf", "--text", "S1-P2", "--limit", "5"]) == 0 and "S1-P2-75" in capsys.readouterr().out
    assert main(["inspect", str(folder)]) == 0


def test_empty_tables(spark, folder):
    objects, spans, pages = tables(spark, f"{folder}/sheet.pdf")
    assert takeoff.analyse(objects.limit(0), spans.limit(0), pages)["quantities"].count() == 0
