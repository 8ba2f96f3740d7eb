"""spark.read.format("pdfvector"): vector PDFs as tables of pages, objects, spans and annotations, a file to a partition."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from inkgrid.session import ship
from inkgrid.sources.pdf import Document

#: Suffixes and words in file names that a blind input must not have.
ANSWERS = (".xlsx", ".xls", ".xlsm", ".csv", ".ods", ".json")
MARKERS = ("facit", "answer", "truth", "ground_truth", "groundtruth", "marked", "markerad", "takeoff", "take_off", "take-off", "with_takeoff", "mangd", "quantities")

POINTS = "array<struct<x: double, y: double>>"
BOX = "x0 double, y0 double, x1 double, y1 double"
SCHEMAS = {
    "pages": "doc_id string, file string, page int, width double, height double, rotation int, crop_x0 double, crop_y0 double, crop_x1 double, crop_y1 double, sha1 string, n_paths int, n_spans int, n_annotations int",
    "objects": f"object_id string, doc_id string, page int, kind string, pts {POINTS}, closed boolean, stroke array<double>, fill array<double>, stroke_width double, dashes string, layer string, {BOX}",
    "spans": f"span_id string, doc_id string, page int, text string, font string, size double, rotation double, {BOX}",
    "glyphs": f"glyph_id string, span_id string, doc_id string, page int, character string, confidence double, font string, size double, {BOX}",
    "fonts": "doc_id string, page int, name string, base_font string, subtype string, encoding string, embedded boolean, program string, data binary",
    "annotations": f"doc_id string, page int, subtype string, pts {POINTS}, {BOX}",
}


def blind(path: str) -> bool:
    """Whether a file may be read without knowing the answer: a PDF whose name carries no answer marker."""
    name = path.rsplit("/", 1)[-1]
    stem = name.rsplit(".", 1)[0].lower()
    return name.lower().endswith(".pdf") and not any(m in stem for m in MARKERS)


def _grid(x: float) -> float:
    """Half away from zero to four places, without negative zero."""
    q = int(abs(x) * 1e4 + 0.5) / 1e4
    return (-q if x < 0 else q) + 0.0


class File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class PdfSource(DataSource):
    """Options: path (a file or folder), table (pages, objects, spans, glyphs, annotations, fonts), flatten (adaptive or steps), answers (true reads files that are not blind)."""

    @classmethod
    def name(cls) -> str:
        return "pdfvector"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "objects")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return PdfReader(self.options)


class PdfReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.table = options["path"], options.get("table", "objects")
        self.flatten = options.get("flatten", "adaptive")
        self.answers = str(options.get("answers", "false")).lower() == "true"

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def partitions(self) -> list[File]:
        system, root = self._system()
        info = system.get_file_info(root)
        files = [root] if info.is_file else sorted(f.path for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file)
        if info.is_file and not self.answers and not blind(root):
            raise ValueError(f"{root} may hold the answer; answers=true reads it")
        return [File(f) for f in files if self.answers and f.lower().endswith(".pdf") or blind(f)]

    def read(self, partition: File) -> Iterator[tuple]:
        system, _ = self._system()
        with system.open_input_stream(partition.path) as f:
            data = f.read()
        doc = hashlib.sha256(data).hexdigest()
        self.sha1 = hashlib.sha1(data).hexdigest()
        for page in Document(data, self.flatten).pages():
            yield from getattr(self, f"_{self.table}")(doc, partition.path, page)

    def _pages(self, doc: str, path: str, page) -> Iterator[tuple]:
        yield doc, path, page.number, page.width, page.height, page.rotation, *page.box, self.sha1, len(page.paths), len(page.spans), len(page.annotations)

    def _objects(self, doc: str, path: str, page) -> Iterator[tuple]:
        seen: dict[str, int] = {}
        for p in page.paths:
            points = [(_grid(x), _grid(y)) for x, y in p.points]
            key = hashlib.sha256(repr((page.number, min(points, points[::-1]), p.closed, p.stroke, p.fill, p.width, p.dashes, p.layer)).encode()).hexdigest()[:12]
            seen[key] = seen.get(key, 0) + 1
            name = f"obj_{key}" + (f"#{seen[key]}" if seen[key] > 1 else "")
            xs, ys = [q[0] for q in points], [q[1] for q in points]
            yield name, doc, page.number, p.kind, points, p.closed, list(p.stroke) if p.stroke else None, list(p.fill) if p.fill else None, _grid(p.width), p.dashes, p.layer, min(xs), min(ys), max(xs), max(ys)

    def _spans(self, doc: str, path: str, page) -> Iterator[tuple]:
        for i, s in enumerate(page.spans):
            yield f"span_{page.number}_{i}", doc, page.number, s.text, s.font, s.size, s.rotation, _grid(s.x), _grid(s.y - s.size), _grid(s.x + s.advance), _grid(s.y)

    def _glyphs(self, doc: str, path: str, page) -> Iterator[tuple]:
        """Characters of the text layer: what they are is certain."""
        for i, s in enumerate(page.spans):
            for place, (char, x, y, wide) in enumerate(s.chars):
                if char.strip():
                    yield f"glyph_{page.number}_{i}_{place}", f"span_{page.number}_{i}", doc, page.number, char, 1.0, s.font, s.size, _grid(x), _grid(y - s.size), _grid(x + wide), _grid(y)

    def _fonts(self, doc: str, path: str, page) -> Iterator[tuple]:
        for f in page.fonts:
            yield doc, page.number, f["name"], f["base"], f["subtype"], f["encoding"], f["program"] is not None, f["program"], f["data"]

    def _annotations(self, doc: str, path: str, page) -> Iterator[tuple]:
        for a in page.annotations:
            box = a["rect"] or [None] * 4
            yield doc, page.number, a["subtype"], a["points"], *box


def read(spark: SparkSession, path: str, table: str = "objects", **options: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(PdfSource)
    return spark.read.format("pdfvector").options(table=table, **options).load(path)


def font_programs(fonts: DataFrame) -> DataFrame:
    """Each embedded font program once, by name without its subset prefix and digest, with how many pages use it."""
    named = fonts.where("data is not null").withColumns({"font": F.regexp_replace("base_font", "^[A-Z]{6}[+]", ""), "digest": F.sha2("data", 256)})
    return named.groupBy("font", "program", "digest").agg(F.first("data").alias("data"), F.count_distinct("doc_id", "page").alias("pages"))
