"""Quantising, keys and content ids: what makes results independent of order and direction."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def quantise(x: Column, places: int = 4) -> Column:
    """Half away from zero on the grid of 10**-places, without negative zero. NaN and infinities give null."""
    grid = 10.0**places
    finite = ~F.isnan(x.cast("double")) & (F.abs(x) != float("inf"))
    return F.when(finite, F.signum(x.cast("double")) * F.floor(F.abs(x) * grid + 0.5) / grid + 0.0)


def quantise_even(x: Column, step: float = 1000.0) -> Column:
    """Half to even on the grid of 1 / step; NaN and infinities give 0."""
    finite = ~F.isnan(x.cast("double")) & (F.abs(x) != float("inf"))
    return F.when(x.isNull(), None).when(finite, F.rint(x * step) / step + 0.0).otherwise(0.0)


def quantise_scalar(x: Column) -> Column:
    return quantise_even(x, 1e9)


def quantise_degrees(a: Column) -> Column:
    """A tenth of a degree, in [0, 360)."""
    return F.pmod(F.rint(a * 10) / 10, F.lit(360.0)) + 0.0


def undirected(points: Column, places: int = 4) -> Column:
    """A polyline's key: the lesser of its quantised points and their reverse."""
    grid = F.transform(points, lambda p: F.struct(quantise(p.x, places).alias("x"), quantise(p.y, places).alias("y")))
    return F.transform(F.array(grid), lambda g: F.least(g, F.reverse(g)))[0]


def segment_key(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.array_sort(F.array(F.struct(ax.alias("x"), ay.alias("y")), F.struct(bx.alias("x"), by.alias("y"))))


def content_id(prefix: str, *key: Column) -> Column:
    """prefix, and 12 hexadecimal digits of the SHA-256 of the key's JSON."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.to_json(F.struct(*(k.alias(f"k{i}") for i, k in enumerate(key))), {"ignoreNullFields": "false"}), 256), 1, 12))


def occurrence_id(prefix: str, text: Column, occurrence: Column) -> Column:
    """prefix, 12 digits of the SHA-1 of a key's text, and how many equal ones came before."""
    return F.concat_ws(":", F.lit(prefix), F.substring(F.sha1(text.cast("binary")), 1, 12), occurrence.cast("string"))


def occurrence(*key: str, order: list[str]) -> Column:
    """How many rows of the same key come before, in a total order."""
    return F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1


def digest(*columns: str) -> Column:
    """Aggregate: a digest of a bounded group's rows that doesn't depend on their order."""
    return F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(*columns)))), 256)


def set_digest(*columns: str) -> Column:
    """Aggregate for groups of any size: count and exclusive-or of row hashes."""
    return F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*columns)).alias("hash"))


def pen_key(*columns: str) -> Column:
    return F.struct(*columns)


def text_key(*columns: str) -> Column:
    """The JSON text of a key, for the order in which 10 comes before 9."""
    return F.to_json(F.array(*columns))
