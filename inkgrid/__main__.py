"""python -m inkgrid analyse PATH OUT [--order normal|reversed|shuffled] [--why ID], or search PATH [--text T] [--near PAGE,X,Y,R] [--geometry LENGTH,ANGLE] [--limit N],
or inspect PATH [--region PAGE,X0,Y0,X1,Y1]. analyse ends with 2 where nothing could be measured.
work INBOX LOG runs the jobs submitted to a folder (Parquet files of job and content, the path of a drawing), one file at a time, and keeps their states.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from inkgrid.operators import search
from inkgrid.plans import takeoff
from inkgrid.session import local_session
from inkgrid.sources import pdfvector, sinks
from inkgrid.streaming import jobs


def drawn(batch: DataFrame, out: str) -> DataFrame:
    """Analyses the drawing of each job of a file of jobs, which is a short list, and writes its quantities; a drawing that can't be read fails its own job."""
    spark, states = batch.sparkSession, []
    for row in batch.orderBy("job").collect():
        try:
            tables = [pdfvector.read(spark, row.content, t) for t in ("objects", "spans", "pages")]
            takeoff.analyse(*tables)["quantities"].write.mode("overwrite").parquet(f"{out}/{row.job}")
            states.append((row.job, "succeeded"))
        except Exception as e:  # noqa: BLE001  the next job must run
            print(f"{row.job}: {e}")
            states.append((row.job, "failed"))
    return spark.createDataFrame(states, "job string, state string")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="inkgrid", description=__doc__)
    parser.add_argument("command", choices=("analyse", "search", "inspect", "work"))
    parser.add_argument("path")
    parser.add_argument("out", nargs="?")
    parser.add_argument("--text")
    parser.add_argument("--near", help="page,x,y,radius")
    parser.add_argument("--geometry", help="least length,angle")
    parser.add_argument("--region", help="page,x0,y0,x1,y1")
    parser.add_argument("--order", choices=("normal", "reversed", "shuffled"), default="normal", help="the order in which objects are read; results don't depend on it")
    parser.add_argument("--why", help="an id whose evidence is shown")
    parser.add_argument("--limit", type=int, default=40)
    args = parser.parse_args(argv)
    spark = local_session(app="inkgrid-cli")
    if args.command == "work":
        if args.out is None:
            parser.error("work needs a folder for its log")
        schema = StructType([StructField("job", StringType()), StructField("content", StringType())])
        jobs.work(spark, args.path, schema, f"{args.out}/log", f"{args.out}/checkpoint", lambda batch: drawn(batch, f"{args.out}/results")).awaitTermination()
        states = jobs.status(spark, f"{args.out}/log")
        if states is not None:
            states.show(200, truncate=False)
        return 0
    tables = {t: pdfvector.read(spark, args.path, t) for t in ("objects", "spans", "pages")}
    if args.command == "analyse":
        if args.out is None:
            parser.error("analyse needs a folder to write to")
        sort = {"normal": [], "reversed": [F.desc("object_id")], "shuffled": [F.xxhash64("object_id", F.lit(7))]}[args.order]
        stages = takeoff.analyse(tables["objects"].orderBy(*sort) if sort else tables["objects"], tables["spans"], tables["pages"])
        sinks.quantities_csv(stages["quantities"], f"{args.out}/quantities")
        sinks.dump(stages, f"{args.out}/stages")
        size = tables["pages"].first()
        sinks.svg(takeoff.shapes(stages), f"{args.out}/svg", size.width, size.height)
        takeoff.census(stages).show(truncate=False)
        if args.why:
            takeoff.why(stages, args.why).show(200, truncate=False)
        return 0 if stages["quantities"].where("horizontal_m is not null").limit(1).count() else 2
    items = takeoff.texts(tables["spans"]).withColumnRenamed("id", "text_id")
    sheet = search.Sheet.of_objects(tables["objects"], items)
    if args.command == "inspect":
        if args.region:
            page, *box = map(float, args.region.split(","))
            sheet.search_region(int(page), tuple(box)).show(args.limit, truncate=False)
        else:
            sheet.inventory().show(200, truncate=False)
        return 0
    found = []
    if args.text:
        found.append(sheet.search_text(args.text))
    if args.near:
        page, x, y, radius = map(float, args.near.split(","))
        found.append(sheet.search_near_point(int(page), x, y, radius))
    if args.geometry:
        length, angle = map(float, args.geometry.split(","))
        found.append(sheet.search_geometry(min_length=length, angle=angle))
    search.union(*(found or [sheet.search_objects()]), limit=args.limit).show(args.limit, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
