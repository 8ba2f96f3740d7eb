"""Comparison of finished quantities with ground truth. No other operator imports this module."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def size_key(diameter: Column) -> Column:
    """Whole millimetres, half to even; -1 for null."""
    return F.coalesce(F.rint(diameter), F.lit(-1.0))


def within(got: Column, want: Column) -> Column:
    """Whether a length is right to 5 cm or 1 %; null when either is missing."""
    return F.abs(got - want) <= F.greatest(F.lit(0.05), 0.01 * F.abs(want))


def compare(got: DataFrame, want: DataFrame) -> DataFrame:
    """Full outer comparison by designation and size: outcome TP, FP or FN, and per length the difference and whether it is right."""
    lengths = ("horizontal_m", "vertical_m", "total_m")
    side = lambda df, p: df.select("designation", size_key(F.col("diameter")).alias("size"), F.lit(True).alias(f"{p}_there"), *(F.col(c).alias(f"{p}_{c}") for c in lengths))
    both = side(got, "got").join(side(want, "want"), ["designation", "size"], "full")
    outcome = F.when(F.col("got_there") & F.col("want_there"), "TP").when(F.col("got_there"), "FP").otherwise("FN")
    out = both.withColumn("outcome", outcome)
    for c in lengths:
        out = out.withColumns({f"{c}_difference": F.col(f"got_{c}") - F.col(f"want_{c}"), f"{c}_right": within(F.col(f"got_{c}"), F.col(f"want_{c}"))})
    return out.drop("got_there", "want_there")


def summary(compared: DataFrame) -> DataFrame:
    """Precision, recall, F1 and the share of right lengths among those present."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    out = compared.agg(n("TP").alias("tp"), n("FP").alias("fp"), n("FN").alias("fn"), *(F.avg(F.col(f"{c}_right").cast("int")).alias(f"{c}_accuracy") for c in ("horizontal_m", "vertical_m", "total_m")))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return out.withColumns({"precision": p, "recall": r, "f1": F.try_divide(2 * p * r, p + r)})
