"""The first sheet of a spreadsheet as rows of texts, from its zipped XML: no reader library is needed."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: The namespaces of sheets and of relations.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Bytes of the largest part that is unpacked.
MOST = 256 << 20


def column(reference: str) -> int:
    """The number of a cell's column, from 0: A is 0, AA is 26."""
    number = 0
    for c in re.match("[A-Z]+", reference)[0]:
        number = number * 26 + ord(c) - 64
    return number - 1


def rows(data: bytes) -> list[list[str | None]]:
    """The rows of the first sheet, as wide as its widest; dates and numbers come as they are stored."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:

        def part(name: str) -> ElementTree.Element:
            if z.getinfo(name).file_size > MOST:
                raise ValueError(f"{name} is too large")
            return ElementTree.fromstring(z.read(name))

        text = lambda e: "".join(t.text or "" for t in e.iter(f"{MAIN}t"))
        shared = [text(s) for s in part("xl/sharedStrings.xml").findall(f"{MAIN}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        first = part("xl/workbook.xml").find(f"{MAIN}sheets/{MAIN}sheet").get(RELATION)
        target = next(r.get("Target") for r in part("xl/_rels/workbook.xml.rels") if r.get("Id") == first)
        out = []
        for row in part(target.lstrip("/") if target.startswith("/") else f"xl/{target}").iter(f"{MAIN}row"):
            cells: dict[int, str | None] = {}
            for c in row.findall(f"{MAIN}c"):
                value = c.find(f"{MAIN}v")
                kind = c.get("t")
                found = text(c) if kind == "inlineStr" else None if value is None else shared[int(value.text)] if kind == "s" else value.text
                cells[column(c.get("r"))] = found
            out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    width = max(map(len, out), default=0)
    return [r + [None] * (width - len(r)) for r in out]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet with its first row as header; a spreadsheet is a small file that the driver reads. Repeated or empty names get their number."""
    system, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    with system.open_input_stream(name) as f:
        table = rows(f.read())
    header, seen = [], set()
    for i, h in enumerate(table[0] if table else []):
        h = (h or "").strip()
        header.append(h if h and h not in seen else f"{h or 'column'}_{i}")
        seen.add(header[-1])
    schema = ", ".join("`{}` string".format(h.replace("`", "``")) for h in header) or "empty string"
    return spark.createDataFrame([tuple(r) for r in table[1:]], schema)
