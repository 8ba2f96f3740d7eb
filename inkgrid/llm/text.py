"""Column expressions on texts that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The separators between words, as a Java and RE2 character class.
SPACE = "[\\x20\\x09-\\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The maximal runs of characters outside SPACE; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def fold(column: Column, buckets: int) -> Column:
    """crc32 of a value's decimal text modulo buckets; a null value counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % buckets


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128 bits that tell rows apart by id and text, as a struct of two longs."""
    return F.struct(F.xxhash64(F.col(doc_id), F.col(text)).alias("a"), F.xxhash64(F.lit(1), F.col(doc_id), F.col(text)).alias("b"))
