"""Strokes that belong together: dashes of one line, corners that should meet, characters and lines of lettering, double readings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from inkgrid.functions import canon, geo
from inkgrid.functions.geo import Box, Segment
from inkgrid.operators import aggregates, graph, spatial
from inkgrid.session import materialise, ship

#: Signatures of one side of a meeting, about.
BLOCK = 2048


def _ends(df: DataFrame, keys: list[str], id_: str = "id") -> DataFrame:
    """Both ends of every stroke with the heading away from it, as points with boxes."""
    s = Segment.of()
    heading = F.degrees(F.atan2(s.dy.cast("double"), s.dx.cast("double")))
    sides = F.array(F.struct(F.lit(0).alias("side"), s.ax.alias("x"), s.ay.alias("y"), F.pmod(heading + 180, F.lit(360.0)).alias("away")), F.struct(F.lit(1).alias("side"), s.bx.alias("x"), s.by.alias("y"), F.pmod(heading, F.lit(360.0)).alias("away")))
    out = df.select(F.col(id_).alias("stroke"), *keys, F.explode(sides).alias("e")).select("stroke", *keys, "e.*")
    return out.withColumns({"id": F.col("stroke") * 2 + F.col("side"), "x0": F.col("x"), "y0": F.col("y"), "x1": F.col("x"), "y1": F.col("y")})


def aligned_gaps(strokes: DataFrame, keys: list[str], reach: float = 40.0, turn: float = 6.0, offset: float = 0.6) -> DataFrame:
    """Pairs of ends of different strokes that look at each other along one line, with their gap. keys hold the pen."""
    ends = _ends(strokes, keys)
    gap = F.hypot(F.col("r_x") - F.col("l_x"), F.col("r_y") - F.col("l_y"))
    facing = F.abs(180 - F.abs(F.col("l_away") - F.col("r_away"))) <= turn
    a = F.radians("l_away")
    ahead = (F.col("r_x") - F.col("l_x")) * F.cos(a) + (F.col("r_y") - F.col("l_y")) * F.sin(a)
    aside = F.abs((F.col("r_y") - F.col("l_y")) * F.cos(a) - (F.col("r_x") - F.col("l_x")) * F.sin(a))
    on = (F.col("l_stroke") < F.col("r_stroke")) & facing & (ahead > 0) & (aside <= offset) & (gap <= reach)
    return spatial.grid_join(ends, ends, keys, reach, on=on).withColumn("gap", gap)


def dash_chains(strokes: DataFrame, keys: list[str], least: int = 5, eps: float = 1e-6, straight: float = 0.5) -> DataFrame:
    """Chains of dashes drawn with one pen: each end's only nearest partner within the pen's usual gap, mutual, least strokes or more.

    Gives chain (its least stroke), members, ink (drawn length), the chain's box and span, and how far the strokes' ends
    lie from the line through its far ends (chains further than `straight` of it are dropped).
    """
    gaps = aligned_gaps(strokes, keys)
    usual = aggregates.dash_gap(gaps.select(*(F.col(f"l_{k}").alias(k) for k in keys), "gap"), keys)
    near = gaps.join(usual.select(*(F.col(k).alias(f"l_{k}") for k in keys), "reach"), [f"l_{k}" for k in keys]).where(F.col("gap") <= F.col("reach"))
    best = graph.mutual_best(near.select(F.col("l_id").alias("u"), F.col("r_id").alias("v"), "gap"), "gap", eps)
    pairs = best.select(F.floor(F.col("u") / 2).cast("long").alias("u"), F.floor(F.col("v") / 2).cast("long").alias("v"))
    named = graph.labelled(strokes, pairs)
    ends = F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))
    chains = named.groupBy(*keys, F.col("root").alias("chain")).agg(F.count(F.lit(1)).alias("members"), canon.quantise(F.sum(Segment.of().length)).alias("ink"), *geo.box_union(), F.array_sort(F.flatten(F.collect_list(ends))).alias("points"))
    chains = chains.where(F.col("members") >= least).withColumn("span", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    chains = chains.withColumn("deviation", geo.straightness(F.col("points")) * F.col("span"))
    return chains.where(F.col("deviation") <= straight)


def heal_corners(lines: DataFrame, keys: list[str], tolerance: float = 2.5) -> DataFrame:
    """lines with ends moved to where their axes meet: ends of two lines within twice the tolerance, 15 to 90 degrees apart, nearest first."""
    ends = _ends(lines, keys)
    gap = F.hypot(F.col("r_x") - F.col("l_x"), F.col("r_y") - F.col("l_y"))
    bent = geo.angle_between(F.col("l_away"), F.col("r_away"), 180)
    pairs = spatial.grid_join(ends, ends, keys, 2 * tolerance, on=(F.col("l_stroke") < F.col("r_stroke")) & (gap <= 2 * tolerance) & bent.between(15, 90))
    chosen = graph.matching(pairs.select(F.col("l_id").alias("u"), F.col("r_id").alias("v"), gap.alias("gap"), F.col("l_x").alias("x"), F.col("l_y").alias("y"), F.col("l_away").alias("a"), F.col("r_x").alias("p"), F.col("r_y").alias("q"), F.col("r_away").alias("b")), [F.col("gap"), F.col("u"), F.col("v")])
    a, b = F.radians("a"), F.radians("b")
    step = F.try_divide((F.col("p") - F.col("x")) * F.sin(b) - (F.col("q") - F.col("y")) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b))
    at = F.struct(canon.quantise(F.col("x") + step * F.cos(a)).alias("x"), canon.quantise(F.col("y") + step * F.sin(a)).alias("y"))
    moved = chosen.where(step.isNotNull()).select("u", "v", at.alias("at")).select(F.explode(F.array("u", "v")).alias("end"), "at")
    moved = moved.select(F.floor(F.col("end") / 2).cast("long").alias("id"), (F.col("end") % 2).alias("side"), "at")
    by_line = moved.groupBy("id").agg(F.max(F.when(F.col("side") == 0, F.col("at"))).alias("_a"), F.max(F.when(F.col("side") == 1, F.col("at"))).alias("_b"))
    out = lines.join(by_line, "id", "left")
    new = {f"{e}{c}": F.coalesce(F.col(f"_{e}.{c}"), F.col(f"{e}{c}").cast("double")) for e in "ab" for c in "xy"}
    return out.withColumns(new).drop("_a", "_b")


def fragments(objects: DataFrame, diagonal: float, share: float = 0.02, least: float = 0.05) -> DataFrame:
    """Stroked objects small enough to be parts of letters."""
    extent = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return objects.where(F.col("stroke").isNotNull() & extent.between(least, share * diagonal))


def characters(parts: DataFrame, keys: list[str], cap: float, join: float = 0.10) -> DataFrame:
    """Parts within join of a cap height of each other as characters, with their box and number; furniture over 2.6 caps is dropped."""
    near = spatial.pairs_within(parts, keys, join * cap, cell=8 * cap).select(F.col("l_id").alias("u"), F.col("r_id").alias("v"))
    out = graph.labelled(parts, near).groupBy(*keys, F.col("root").alias("id")).agg(*geo.box_union(), F.count(F.lit(1)).alias("parts"), F.array_sort(F.collect_list("id")).alias("ids"))
    return out.where(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) <= 2.6 * cap)


def stacked_parts(chars: DataFrame, keys: list[str], cap: float) -> DataFrame:
    """Marks above each other (gap 0.55 caps, overlap 45 % of the narrower, 1.25 caps in all) as one character."""
    a, b = Box.of("l_"), Box.of("r_")
    gap = F.greatest(b.y0 - a.y1, a.y0 - b.y1)
    overlap = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    narrow = F.least(a.x1 - a.x0, b.x1 - b.x0)
    centred = F.abs((a.x0 + a.x1) - (b.x0 + b.x1)) / 2 <= 0.15 * cap
    tall = F.greatest(a.y1, b.y1) - F.least(a.y0, b.y0)
    on = (F.col("l_id") < F.col("r_id")) & gap.between(0, 0.55 * cap) & ((narrow > 0) & (overlap >= 0.45 * narrow) | (narrow <= 0.05 * cap) & centred) & (tall <= 1.25 * cap)
    near = spatial.grid_join(chars, chars, keys, 0.55 * cap, cell=8 * cap, on=on).select(F.col("l_id").alias("u"), F.col("r_id").alias("v"))
    out = graph.labelled(chars, near).groupBy(*keys, F.col("root").alias("id"))
    return out.agg(*geo.box_union(), F.sum("parts").alias("parts"), F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"))


def merge_readings(spans: DataFrame, read: DataFrame, keys: list[str], least: float = 0.35) -> DataFrame:
    """Texts of the file and texts read from strokes: a span takes the place of a reading that covers it (IoU of least or more).

    Gives id, text, origin (span, glyph or span+glyph), the reading replaced, and whether both agree.
    """
    both = spatial.grid_join(spans, read, keys).withColumn("iou", Box.of("l_").iou(Box.of("r_"))).where(F.col("iou") >= least)
    first = graph.best_by(both, ["l_id"], [F.desc("iou"), F.col("r_id")]).select(F.col("l_id").alias("id"), F.col("r_id").alias("reading"), (F.col("l_text") == F.col("r_text")).alias("agree"))
    kept = spans.select("id", *keys, "text").join(first, "id", "left").withColumn("origin", F.when(F.col("reading").isNull(), "span").otherwise("span+glyph"))
    covered = both.select(F.col("r_id").alias("id")).distinct()
    rest = read.select("id", *keys, "text").join(covered, "id", "left_anti").withColumns({"reading": F.lit(None).cast(dict(read.dtypes)["id"]), "agree": F.lit(None).cast("boolean"), "origin": F.lit("glyph")})
    return kept.unionByName(rest)


def chained_share(strokes: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """Per layer, the share of strokes with another one of the layer within reach."""
    near = spatial.pairs_within(strokes, [*keys, "layer"], reach)
    linked = near.select(F.explode(F.array("l_id", "r_id")).alias("id")).distinct().withColumn("linked", F.lit(1))
    return strokes.join(linked, "id", "left").groupBy(*keys, "layer").agg(F.avg(F.coalesce("linked", F.lit(0))).alias("chain"))


def artwork_regions(objects: DataFrame, keys: list[str], page_area: float, cell: float = 24.0) -> DataFrame:
    """Dense cells that touch as regions (of 6 % of the page at most), with the objects inside."""
    hot = aggregates.artwork(spatial.density(objects, keys, cell), keys)
    cells = hot.withColumns({"id": F.xxhash64(*keys, "cx", "cy"), "x0": F.col("cx") * cell, "y0": F.col("cy") * cell, "x1": (F.col("cx") + 1) * cell, "y1": (F.col("cy") + 1) * cell})
    near = spatial.grid_join(cells, cells, keys, on=F.col("l_id") < F.col("r_id")).select(F.col("l_id").alias("u"), F.col("r_id").alias("v"))
    regions = graph.labelled(cells, near).groupBy(*keys, F.col("root").alias("id")).agg(*geo.box_union(), F.sum("n").alias("n")).where(Box.of().area <= 0.06 * page_area)
    inside = spatial.containment(regions, objects, keys, cell=120.0)
    return inside.groupBy(F.col("l_id").alias("region"), *(F.col(f"l_{k}").alias(k) for k in keys)).agg(F.array_sort(F.collect_list("r_id")).alias("ids"))


def occurrences_on_sheet(texts: DataFrame, keys: list[str]) -> DataFrame:
    """texts with how often each one stands on its sheet: counted, then joined, so that a text that is everywhere needs no window."""
    counts = texts.groupBy(*(F.col(k).alias(f"_{k}") for k in [*keys, "text"])).agg(F.count(F.lit(1)).alias("repeats"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, "text"]]
    return texts.join(counts, same).drop(*(f"_{k}" for k in [*keys, "text"]))


def _meetings(glyphs: DataFrame, keys: list[str], most: float, signature: str, id_: str) -> DataFrame:
    """keys, id, s, side, own and the meeting (w, r, p, o, q) of every row: part p of range r of sums with part q of range r + o.

    Signatures of one width that are at most `most` apart have sums at most as far apart, so rows meet only in neighbouring
    ranges of sums. A range has parts of about BLOCK rows, each of which meets every other once.
    """
    values = F.transform(signature, lambda x: x.cast("double"))
    rows = glyphs.select(*keys, F.col(id_).alias("id"), values.alias("s")).withColumns({"w": F.size("s"), "sum": F.aggregate("s", F.lit(0.0), lambda t, x: t + x)}).where(F.abs("sum") < float("inf"))
    rows = rows.withColumn("r", F.floor(F.greatest(F.lit(-(2.0**62)), F.least(F.lit(2.0**62), F.col("sum") / most)))).drop("sum")
    rows = rows.where(reduce(Column.__and__, (F.col(k).isNotNull() for k in [*keys, "id"])))
    parts = materialise(rows.groupBy(*keys, "w", "r").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")), "signature-parts")
    there = lambda o: parts.select(*keys, "w", (F.col("r") - o).alias("r"), F.col("parts").alias(f"parts{o}".replace("-", "_")))
    rows = rows.join(there(0), [*keys, "w", "r"]).join(there(1), [*keys, "w", "r"], "left").join(there(-1), [*keys, "w", "r"], "left")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), "parts0"))
    meeting = lambda r, p, o, q, side: F.struct(r.alias("r"), p.cast("long").alias("p"), F.lit(o).alias("o"), q.cast("long").alias("q"), F.lit(side).alias("side"))
    r, own = F.col("r"), F.col("own")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    inside = F.concat(
        F.transform(upto(own), lambda q: meeting(r, q, 0, own, 1)),
        F.transform(F.sequence(own, F.col("parts0") - 1), lambda q: meeting(r, own, 0, q, 0)),
    )
    above = F.transform(upto(F.coalesce("parts1", F.lit(0).cast("long"))), lambda q: meeting(r, own, 1, q, 0))
    below = F.transform(upto(F.coalesce("parts_1", F.lit(0).cast("long"))), lambda q: meeting(r - 1, q, 1, own, 1))
    return rows.select(*keys, "w", "id", "s", F.explode(F.concat(inside, above, below)).alias("m")).select(*keys, "w", "id", "s", "m.*")


def _near(most: float, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions of the pairs of rows of a and b that are at most `most` apart in L1, and their distances, a few rows of a at a time.

    Single precision first, with room for its errors; what that leaves is added up in double precision from the first value on.
    """
    width = a.shape[1]
    largest = max((float(np.abs(x).max(initial=0)) for x in (a, b)))
    single = largest < 1e30
    limit = most + (width + 2) * 2.0**-21 * (largest + most)
    low_a, low_b = (np.ascontiguousarray(x.T.astype(np.float32)) if single else x.T for x in (a, b))
    step = max(1, (1 << 17) // max(1, len(b)))
    for at in range(0, len(a), step):
        n = min(step, len(a) - at)
        if single:
            total, gap = np.zeros((n, len(b)), np.float32), np.empty((n, len(b)), np.float32)
            for k in range(width):
                np.subtract(low_a[k, at : at + n, None], low_b[k][None], out=gap)
                np.abs(gap, out=gap)
                total += gap
            i, j = np.nonzero(total <= limit)
        else:
            i, j = (x.ravel() for x in np.indices((n, len(b))))
        i += at
        for cut in range(0, len(i), 1 << 16):
            x, y = i[cut : cut + (1 << 16)], j[cut : cut + (1 << 16)]
            distance = np.zeros(len(x))
            with np.errstate(invalid="ignore", over="ignore"):
                for k in range(width):
                    distance += np.abs(a[x, k] - b[y, k])
            right = distance <= most
            yield x[right], y[right], distance[right]


def _sides(table: pa.Table, width: int) -> list[tuple[pa.Array, np.ndarray]]:
    """Ids and signatures of a meeting's two sides; both are one where a part meets itself."""
    out = []
    for side in (0, 1):
        some = table.filter(pc.equal(table["side"], side)).combine_chunks()
        values = pc.list_flatten(some["s"]).to_numpy().reshape(some.num_rows, width)
        out.append((some["id"].to_numpy(), values))
    return out


def _pairs(keys: list[str], most: float, forest: bool):
    """For each meeting: its pairs with their distances, or (forest) edges between u and v whose components are those of its pairs."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *names, width, r, p, o, q = key
        table = pa.Table.from_batches(list(batches))
        (ids, a), (others, b) = _sides(table, width.as_py())
        same = o.as_py() == 0 and p.as_py() == q.as_py()
        if same:
            others, b = ids, a
        kind = table.schema.field("id").type
        if not forest:
            for i, j, distance in _near(most, a, b):
                u, v = np.minimum(ids[i], others[j]), np.maximum(ids[i], others[j])
                kept = (ids[i] < others[j]) if same else (u != v)
                m = int(kept.sum())
                if m:
                    columns = [*(pa.array([k.as_py()] * m, k.type) for k in names), pa.array(u[kept], kind), pa.array(v[kept], kind), pa.array(distance[kept])]
                    yield pa.RecordBatch.from_arrays(columns, [*keys, "u", "v", "distance"])
            return
        every = ids if same else np.concatenate((ids, others))
        shift, root = 0 if same else len(ids), np.arange(len(every))
        for i, j, _ in _near(most, a, b):
            j = j + shift
            while True:
                x, y = root[i], root[j]
                apart = x != y
                if not apart.any():
                    break
                i, j, x, y = i[apart], j[apart], x[apart], y[apart]
                np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
                while (root != root[root]).any():
                    root = root[root]
        u, v = every[root], every
        moved = u != v
        if moved.any():
            yield pa.RecordBatch.from_arrays([pa.array(u[moved], kind), pa.array(v[moved], kind)], ["u", "v"])

    return run


def like_signatures(glyphs: DataFrame, keys: list[str], most: float, signature: str = "signature", id_: str = "id") -> DataFrame:
    """Pairs u < v of equal keys whose signatures (of numbers; equally many) are at most `most` apart in L1, with the distance."""
    met = _meetings(glyphs, keys, most, signature, id_)
    ship(glyphs.sparkSession)
    types = {f.name: f.dataType for f in met.schema}
    schema = StructType([StructField(k, types[k]) for k in keys] + [StructField("u", types["id"]), StructField("v", types["id"]), StructField("distance", DoubleType())])
    return met.groupBy(*keys, "w", "r", "p", "o", "q").applyInArrow(_pairs(keys, most, False), schema)


def shape_clusters(glyphs: DataFrame, keys: list[str], most: float, same: Column | None = None) -> DataFrame:
    """glyphs with cluster: the least id that like signatures connect it with; same is a further test on the pairs' u, v and distance."""
    if same is not None:
        links = like_signatures(glyphs, keys, most).where(same)
    else:
        met = _meetings(glyphs, keys, most, "signature", "id")
        ship(glyphs.sparkSession)
        kind = dict(met.dtypes)["id"]
        links = met.groupBy(*keys, "w", "r", "p", "o", "q").applyInArrow(_pairs(keys, most, True), f"u {kind}, v {kind}")
    return graph.labelled(glyphs, links).withColumnRenamed("root", "cluster")


def coincident(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Edges between the same nodes along the same line as one, with the ids of all. lines: id, node_a, node_b, pts."""
    key = canon.undirected(F.col("pts"))
    return lines.groupBy(*keys, F.least("node_a", "node_b").alias("u"), F.greatest("node_a", "node_b").alias("v"), key.alias("line")).agg(F.min("id").alias("id"), F.array_sort(F.collect_list("id")).alias("ids"))


def share_along(leader: Segment, run: Segment, tolerance: float, turn: float = 6.0) -> Column:
    """The share of a leader that stays near a run and within turn degrees of it."""
    near = (geo.point_distance(run, leader.ax, leader.ay) <= tolerance) & (geo.point_distance(run, leader.bx, leader.by) <= tolerance)
    return F.when(near & (geo.angle_between(geo.degrees(leader), geo.degrees(run), 180) <= turn), geo.overlap_fraction(leader, run)).otherwise(0.0)
