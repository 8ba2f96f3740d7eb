"""The search surface: questions about a drawing whose answers share one schema and can be united."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.functions import geo, tokens
from inkgrid.functions.geo import Box, Segment
from inkgrid.operators import spatial

HIT = ("page", "type", "id", "x0", "y0", "x1", "y1", "detail")


def hits(df: DataFrame, kind: str, id_: str, detail: Column | None = None) -> DataFrame:
    """Rows as hits."""
    box = Box.of()
    return df.select(F.col("page").cast("int").alias("page"), F.lit(kind).alias("type"), F.col(id_).cast("string").alias("id"), *(c.cast("double").alias(n) for c, n in zip((box.x0, box.y0, box.x1, box.y1), HIT[3:7], strict=True)), (detail if detail is not None else F.lit("")).cast("string").alias("detail"))


def union(*found: DataFrame, limit: int | None = None) -> DataFrame:
    """All hits once, ordered by page, box, type and id; limit is for reports."""
    every = reduce(DataFrame.unionByName, found).distinct().orderBy("page", "x0", "y0", "x1", "y1", "type", "id")
    return every.limit(limit) if limit is not None else every


class Sheet:
    """A drawing's tables: objects, segments (id, page, ends, stroke_width, dashes) and text_items, each with boxes."""

    def __init__(self, objects: DataFrame, segments: DataFrame, text_items: DataFrame, glyphs: DataFrame | None = None) -> None:
        self.objects, self.texts, self.glyphs = objects, text_items, glyphs
        self.segments = spatial.with_box(segments)

    @classmethod
    def of_objects(cls, objects: DataFrame, text_items: DataFrame) -> Sheet:
        exploded = objects.where("kind = 'path'").select("object_id", "page", "stroke_width", "dashes", "layer", F.posexplode(geo.edges(F.col("pts"), F.col("closed"))).alias("place", "e"))
        segments = exploded.where(F.hypot(F.col("e.bx") - F.col("e.ax"), F.col("e.by") - F.col("e.ay")) >= 0.05)
        return cls(objects, segments.select(F.concat_ws("/", "object_id", "place").alias("id"), "object_id", "page", "stroke_width", "dashes", "layer", "e.*"), text_items)

    def search_objects(self, kind: str | None = None, predicate: Column | None = None) -> DataFrame:
        found = self.objects
        if kind is not None:
            found = found.where(F.col("kind") == kind)
        return hits(found.where(predicate) if predicate is not None else found, "object", "object_id", F.col("kind"))

    def search_paths(self, line_width: float | None = None, colour: list[float] | None = None, dashed: bool | None = None, closed: bool | None = None, filled: bool | None = None) -> DataFrame:
        found = self.objects.where("kind = 'path'")
        if line_width is not None:
            found = found.where(F.abs(F.col("stroke_width") - line_width) <= 1e-3)
        if colour is not None:
            found = found.where(F.col("stroke") == F.array(*map(F.lit, colour)))
        for wanted, column in ((dashed, is_dashed(F.col("dashes"))), (closed, F.col("closed")), (filled, F.col("fill").isNotNull())):
            if wanted is not None:
                found = found.where(column == wanted)
        return hits(found, "path", "object_id", F.col("layer"))

    def search_text(self, pattern: str, regex: bool = False, case_sensitive: bool = False) -> DataFrame:
        """Texts, or their alternative readings where there are any, that contain a pattern."""
        import re

        p = ("" if case_sensitive else "(?i)") + (pattern if regex else re.escape(pattern))
        match = F.col("text").rlike(p)
        if "alternatives" in self.texts.columns:
            match = match | F.coalesce(F.exists("alternatives", lambda a: a.rlike(p)), F.lit(False))
        return hits(self.texts.where(match), "text", "text_id", F.col("text"))

    def search_glyphs(self, character: str | None = None, unresolved: bool | None = None) -> DataFrame:
        found = self.glyphs
        if character is not None:
            found = found.where(F.col("character") == character)
        if unresolved is not None:
            found = found.where((F.col("character").isNull() | (F.col("confidence") < 0.25)) == unresolved)
        return hits(found, "glyph", "glyph_id", F.col("character"))

    def search_region(self, page: int, box: tuple[float, float, float, float]) -> DataFrame:
        at = lambda df: spatial.in_region(df.where(F.col("page") == page), box)
        return union(hits(at(self.objects), "object", "object_id"), hits(at(self.segments), "segment", "id"), hits(at(self.texts), "text", "text_id", F.col("text")))

    def search_near_point(self, page: int, x: float, y: float, radius: float) -> DataFrame:
        return self.search_region(page, (x - radius, y - radius, x + radius, y + radius)).where(Box.of().to_point(F.lit(x), F.lit(y)) <= radius)

    def search_near_text(self, pattern: str, radius: float) -> DataFrame:
        """Objects within radius of any text that matches."""
        near = spatial.within(self.search_text(pattern), self.objects, ["page"], radius)
        back = near.select(*(F.col(f"r_{c}").alias(c) for c in self.objects.columns)).dropDuplicates(["page", "object_id"])
        return hits(back, "object", "object_id")

    def search_geometry(self, page: int | None = None, min_length: float | None = None, angle: float | None = None, tolerance: float = 2.0, line_width: float | None = None) -> DataFrame:
        found, seg = self.segments, Segment.of()
        if page is not None:
            found = found.where(F.col("page") == page)
        if min_length is not None:
            found = found.where(seg.length >= min_length)
        if angle is not None:
            found = found.where(geo.angle_between(geo.degrees(seg), F.lit(float(angle)), 180) <= tolerance)
        if line_width is not None:
            found = found.where(F.abs(F.col("stroke_width") - line_width) <= 1e-3)
        return hits(found, "segment", "id", F.round(seg.length, 4))

    def search_vertical(self, page: int | None = None, tolerance: float = 2.0) -> DataFrame:
        return self.search_geometry(page, angle=90.0, tolerance=tolerance)

    def search_horizontal(self, page: int | None = None, tolerance: float = 2.0) -> DataFrame:
        return self.search_geometry(page, angle=0.0, tolerance=tolerance)

    def _partners(self, pairs: DataFrame, segment_id: str) -> DataFrame:
        """The other segments of pairs with one segment."""
        sides = [pairs.where(F.col(f"{a}_id") == segment_id).select(*(F.col(f"{b}_{c}").alias(c) for c in self.segments.columns)) for a, b in (("l", "r"), ("r", "l"))]
        return hits(sides[0].unionByName(sides[1]), "segment", "id")

    def _around(self, segment_id: str) -> DataFrame:
        return self.segments.join(self.segments.where(F.col("id") == segment_id).select("page").distinct(), "page", "left_semi")

    def search_parallel(self, segment_id: str, max_distance: float = 40.0) -> DataFrame:
        return self._partners(spatial.parallel(self._around(segment_id), ["page"], max_distance), segment_id)

    def search_collinear(self, segment_id: str) -> DataFrame:
        return self._partners(spatial.collinear(self._around(segment_id), ["page"]), segment_id)

    def search_connected(self, segment_id: str, tolerance: float = 0.6) -> DataFrame:
        return self._partners(spatial.touching(self._around(segment_id), ["page"], tolerance), segment_id)

    def search_leaders(self, leaders: DataFrame) -> DataFrame:
        """All traced leaders: leader, text, page, root and tip, with the box around both ends."""
        side = lambda f, axis: f(F.col(f"root.{axis}"), F.col(f"tip.{axis}"))
        boxed = leaders.withColumns({"x0": side(F.least, "x"), "y0": side(F.least, "y"), "x1": side(F.greatest, "x"), "y1": side(F.greatest, "y")})
        return hits(boxed, "leader", "leader", F.col("text"))

    def search_dimensions(self) -> DataFrame:
        words = self.texts.withColumn("word", F.explode(F.split("text", r"\s+"))).withColumn("d", tokens.dimension(F.col("word"))).where("d is not null")
        return hits(words, "dimension", "text_id", F.concat_ws(" ", "d.rule", F.col("d.mm").cast("string")))

    def inventory(self) -> DataFrame:
        """Objects by kind, by page and kind, and in all."""
        return self.objects.groupingSets([[F.col("kind")], [F.col("page"), F.col("kind")], []], F.col("page"), F.col("kind")).agg(F.count(F.lit(1)).alias("n"), F.grouping("page").alias("all_pages"), F.grouping("kind").alias("all_kinds"))

    def neighbourhood(self, page: int, x: float, y: float, radius: float | None = None) -> DataFrame:
        """Everything near a point, by type."""
        return self.search_near_point(page, x, y, radius if radius is not None else 12.0)


def is_dashed(declaration: Column) -> Column:
    """Whether a dash declaration such as [3 2] 0 has a positive length."""
    inside = F.regexp_extract(declaration, r"\[([^\]]*)\]", 1)
    return F.coalesce(F.exists(F.regexp_extract_all(inside, F.lit(r"([0-9]*\.?[0-9]+)"), F.lit(1)), lambda x: x.cast("double") > 0), F.lit(False))


def transformed(objects: DataFrame) -> DataFrame:
    """Objects with a rotation, or with a matrix (a, b, c, d) other than the page's."""
    identity = F.array(*map(F.lit, (1.0, 0.0, 0.0, 1.0)))
    return objects.where((F.coalesce("rotation", F.lit(0.0)) != 0) | (F.coalesce("matrix", identity) != identity))
