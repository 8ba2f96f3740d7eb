"""Sinks: quantity tables as CSV, reports as canonical JSON, drawings as SVG, one table a stage, and frozen runs."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrid.operators.spatial import grid_join
from inkgrid.session import map_arrow, materialise

QUANTITY = ("designation", "diameter", "horizontal_m", "vertical_m", "total_m", "n_pipes", "state", "reasons", "confidence")
COLOURS = {"CONFIRMED": "#1a7f37", "HIGH_CONFIDENCE": "#0969da", "AMBIGUOUS": "#bf8700", "INSUFFICIENT": "#8250df", "UNRESOLVED": "#6e7781"}


def quantities_csv(rows: DataFrame, path: str) -> None:
    """Quantity rows as CSV with header: nulls empty, reasons joined by semicolons."""
    out = rows.withColumn("reasons", F.array_join("reasons", ";")).select(*QUANTITY)
    out.orderBy("designation", "diameter").write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def _canonical(value):
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("a report holds finite numbers only")
        return round(value, 9) + 0.0
    if isinstance(value, dict):
        return {k: _canonical(v) for k, v in value.items()}
    return [_canonical(v) for v in value] if isinstance(value, (list, tuple)) else value


def canonical_json(value) -> str:
    """JSON with sorted keys, floats to nine places, and no NaN."""
    return json.dumps(_canonical(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def write_report(tables: dict[str, DataFrame], path: str, schema: str) -> None:
    """A report's tables as folders of JSON lines below path, each ordered by all its columns, and a small index."""
    for name, df in tables.items():
        df.orderBy(*df.columns).write.mode("overwrite").json(f"{path}/{name}")
    system, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    with system.open_output_stream(f"{root}/index.json") as out:
        out.write(canonical_json({"schema": schema, "tables": {n: df.columns for n, df in tables.items()}}).encode())


def dump(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet table for each stage."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def svg(shapes: DataFrame, path: str, width: float, height: float) -> int:
    """shapes: doc_id, page, layer, state, pts (array of (x, y)), label. One SVG for each page, layers as groups; gives their number.

    A page's shapes are sorted into one stream, so a page is written without being held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        system.create_dir(root, recursive=True)
        at, layer, out, names = None, None, None, []

        def end() -> None:
            if out is not None:
                out.write(b"</g></svg>")
                out.close()

        for batch in batches:
            for r in batch.to_pylist():
                if (r["doc_id"], r["page"]) != at:
                    end()
                    at, layer = (r["doc_id"], r["page"]), None
                    names.append(f"{r['doc_id']}-{r['page']}.svg")
                    out = system.open_output_stream(f"{root}/{names[-1]}")
                    out.write(f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width:g} {height:g}">'.encode())
                if r["layer"] != layer:
                    out.write((("</g>" if layer is not None else "") + f'<g id="{_escaped(r["layer"])}">').encode())
                    layer = r["layer"]
                points = " ".join(f"{p['x']:g},{p['y']:g}" for p in r["pts"])
                out.write(f'<polyline fill="none" stroke="{COLOURS.get(r["state"], "#999")}" points="{points}"><title>{_escaped(r["label"])}</title></polyline>'.encode())
        end()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["file"])

    dealt = shapes.select("doc_id", "page", "layer", "state", "pts", "label").na.fill("-", ["layer", "label", "state"])
    return map_arrow(dealt.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "layer", "label"), run, "file string").count()


def _escaped(text: str) -> str:
    return str(text).replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")


def crops(shapes: DataFrame, requests: DataFrame) -> DataFrame:
    """shapes: doc_id, page, pts and more. requests: id, doc_id, page and a box. The shapes that reach into each box, moved to its corner, with
    the request's id as page, so that svg() writes a picture of each."""
    boxed = shapes.withColumns({"x0": F.array_min(F.transform("pts", lambda p: p.x)), "y0": F.array_min(F.transform("pts", lambda p: p.y)), "x1": F.array_max(F.transform("pts", lambda p: p.x)), "y1": F.array_max(F.transform("pts", lambda p: p.y))})
    both = grid_join(requests.select("id", "doc_id", "page", "x0", "y0", "x1", "y1"), boxed, ["doc_id", "page"], cell=240.0)
    moved = F.transform("r_pts", lambda p: F.struct((p.x - F.col("l_x0")).alias("x"), (p.y - F.col("l_y0")).alias("y")))
    kept = [c for c in shapes.columns if c not in ("page", "pts")]
    return both.select(F.col("l_id").alias("page"), *(F.col(f"r_{c}").alias(c) for c in kept), moved.alias("pts"))


def freeze(rows: DataFrame, path: str) -> None:
    """Keeps a run's rows, to hold later runs against."""
    rows.write.mode("overwrite").parquet(path)


def changes(rows: DataFrame, path: str) -> DataFrame:
    """Rows that a frozen run has and this one doesn't, and the other way round."""
    old = rows.sparkSession.read.parquet(path)
    gone, new = old.exceptAll(rows.select(*old.columns)), rows.select(*old.columns).exceptAll(old)
    return gone.withColumn("change", F.lit("gone")).unionByName(new.withColumn("change", F.lit("new")))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth: a JSON object with quantities or a list of them, or CSV or a spreadsheet with a header; comma decimals are read.

    Columns are matched by words in their names, as reviewers name them. With columns for a count and a height it is a markup
    export, a row for each annotation: lengths are added up by designation, and rows whose designation ends in a word for
    vertical give count times height to the designation without it; rows with neither length nor count are no quantities.
    """
    from inkgrid.functions.tokens import number, trailing_digits
    from inkgrid.sources import xlsx

    #: Words that name a column, those of markup exports, and the endings that mark a vertical part.
    hints = {
        "designation": ("designation", "beteckning", "subject", "kod", "code", "benamning"), "diameter": ("diameter", "dimension", "dn", "dim"),
        "horizontal_m": ("horizontal", "horisontell", "liggande", "langd", "längd"), "vertical_m": ("vertical", "vertikal", "stam", "stigare"), "total_m": ("total", "summa", "totalt", "sum"),
    }
    counts, heights = ("antal",), ("hojd", "höjd", "height")
    vertical = r"(?i)\s*(vertikal|vertical|stam|riser)\s*$"
    if path.endswith(".json"):
        raw = spark.read.option("multiLine", True).json(path)
        rows = raw.select(F.explode("quantities").alias("q")).select("q.*") if "quantities" in raw.columns else raw
    elif path.endswith(".csv"):
        rows = spark.read.option("header", True).csv(path)
    elif path.endswith((".xlsx", ".xlsm")):
        rows = xlsx.read(spark, path)
    else:
        raise ValueError("truth is read from .json, .csv, .xlsx and .xlsm")
    of = lambda words, used=(): next((c for c in rows.columns if c not in used and any(w in c.strip().lower() for w in words)), None)
    named, used = {}, set()
    for target, words in hints.items():
        if (column := of(words, used)) is not None:
            named[target] = F.col(f"`{column}`")
            used.add(column)
    text = F.trim(named.get("designation", F.lit(None)).cast("string"))
    value = lambda c: number(c.cast("string"))
    count, height = of(counts), of(heights)
    if count is None or height is None:
        out = rows.select(text.alias("designation"), *(value(named[t]).alias(t) if t in named else F.lit(None).cast("double").alias(t) for t in list(hints)[1:]))
        return out.where("designation <> ''")
    length = value(named["horizontal_m"]) if "horizontal_m" in named else F.lit(None).cast("double")
    marks = rows.select(text.alias("subject"), length.alias("length"), value(F.col(f"`{count}`")).alias("count"), value(F.col(f"`{height}`")).alias("height"))
    marks = marks.where("subject <> '' and (length is not null or count <> 0)").withColumn("upright", F.col("subject").rlike(vertical))
    flat, up = F.when(~F.col("upright"), F.col("length")), F.when(F.col("upright"), F.coalesce("count", F.lit(0.0)) * F.coalesce("height", F.lit(0.0)))
    summed = marks.groupBy(F.trim(F.regexp_replace("subject", vertical, "")).alias("designation")).agg(F.round(F.coalesce(F.sum(flat), F.lit(0.0)), 4).alias("horizontal_m"), F.round(F.coalesce(F.sum(up), F.lit(0.0)), 4).alias("vertical_m"))
    return summed.select("designation", trailing_digits(F.col("designation")).alias("diameter"), "horizontal_m", "vertical_m", F.round(F.col("horizontal_m") + F.col("vertical_m"), 4).alias("total_m"))


def same_whatever_the_order(df: DataFrame, query, seeds: tuple[int, ...] = (1, 2)) -> bool:
    """Whether a query's result stays the same when its input comes in other orders and partitions."""
    digests = set()
    for order in (df, df.orderBy(*(F.desc(c) for c in df.columns)), *(df.repartition(3 + s).orderBy(F.rand(s)) for s in seeds)):
        out = query(materialise(order, "order"))
        digests.add(tuple(out.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*sorted(out.columns)))).first()))
    return len(digests) == 1
