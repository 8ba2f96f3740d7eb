"""A fixed-size bitmap of hashes as one array value, to thin rows before an exact join.

Its size depends only on the number of bits, so it may go to every task; false positives are for the join to drop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 23


def bitmap(hashes: DataFrame, column: str, bits: int = BITS) -> Column:
    """A scalar subquery: an array of 2**(bits - 6) longs with a bit set for every hash in column."""
    slot = F.shiftrightunsigned(F.col(column), 6).bitwiseAND(F.lit(2 ** (bits - 6) - 1)).cast("long")
    one = F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))")
    filled = hashes.groupBy(slot.alias("slot")).agg(F.bit_or(one).alias("word"))
    slots = hashes.sparkSession.range(0, 2 ** (bits - 6), 1, 1).withColumnRenamed("id", "slot")
    dense = slots.join(filled, "slot", "left").select("slot", F.coalesce("word", F.lit(0).cast("long")).alias("word"))
    rows = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "word"))), lambda x: x.word).alias("bits"))
    return rows.scalar()


def hit(words: Column, value: Column, bits: int = BITS) -> Column:
    """Whether the bitmap has value's bit."""
    slot = F.shiftrightunsigned(value, 6).bitwiseAND(F.lit(2 ** (bits - 6) - 1)).cast("int")
    place = value.bitwiseAND(F.lit(63).cast("long")).cast("int")
    return F.call_function("shiftrightunsigned", F.get(words, slot), place).bitwiseAND(F.lit(1).cast("long")) == 1
