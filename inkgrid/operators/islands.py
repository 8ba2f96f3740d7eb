"""Gaps and islands along a line: words, characters, hatches and scale-bar cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upper_median(column: str) -> Column:
    """Aggregate: the value at place n div 2 of the sorted values, counted from 0, as a double; counts by value are merged, so groups may be large."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}` DESC)")


def lowest_mode(column: str) -> Column:
    """Aggregate: the most frequent value, of equally frequent ones the least."""
    return F.expr(f"mode(`{column}`, true)")


def islands(df: DataFrame, keys: list[str], start: str, end: str, gap: Column, order: list[str] | None = None) -> DataFrame:
    """df with island: numbers of groups whose intervals follow each other by at most gap."""
    w = Window.partitionBy(*keys).orderBy(*(order or [start, end]))
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_new", F.coalesce((F.col(start) - reach > gap).cast("int"), F.lit(0))).withColumn("island", F.sum("_new").over(w)).drop("_new")


def words(chars: DataFrame, keys: list[str], height: str, factor: float = 2.2, share: float = 0.45, spacing: str | None = None) -> DataFrame:
    """chars: start, end, char. Lines with spaces where a gap exceeds both factor times the line's usual gap and a share of its height.

    The usual gap is that of the characters' font (column spacing) where it is known, else the upper median of the line's gaps, which
    can't tell spaces where half of the gaps or more are spaces ("A | B"). A line is one row of its characters in order.
    """
    known = F.max(spacing) if spacing else F.lit(None)
    c = F.array_sort(F.collect_list(F.struct("start", "end", F.coalesce("char", F.lit("\ufffd")).alias("char"))))
    return words_of(chars.groupBy(*keys).agg(c.alias("c"), F.max(height).alias("tall"), known.cast("double").alias("known")), keys, factor, share)


def words_of(lines: DataFrame, keys: list[str], factor: float = 2.2, share: float = 0.45) -> DataFrame:
    """What words gives, of lines that have all their characters in order already: c (start, end and char of each), tall and known (the usual gap, or null)."""
    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  value is computed once a line
    gaps = F.zip_with(F.slice("c", 2, F.size("c") - 1), F.slice("c", 1, F.size("c") - 1), lambda x, y: (x.start - y.end).cast("double"))

    def joined(line: Column) -> Column:
        usual = F.get(F.array_sort(line.gaps), F.floor(F.size(line.gaps) / 2).cast("int"))
        limit = F.greatest(factor * F.coalesce(line.known, usual, F.lit(0.0)), share * line.tall)
        before = F.concat(F.array(F.lit(None).cast("double")), line.gaps)
        return once(F.struct(line.c.alias("c"), before.alias("before"), limit.alias("limit")), lambda z: F.array_join(F.zip_with(z.c, z.before, lambda x, g: F.concat(F.when(g > z.limit, " ").otherwise(""), x.char)), ""))

    return lines.select(*keys, once(F.struct("c", "tall", "known", gaps.alias("gaps")), joined).alias("text"))


def regular(df: DataFrame, keys: list[str], at: str, least: int = 12, variation: float = 0.25) -> DataFrame:
    """Groups of least or more distinct places whose spacing varies by at most variation of its mean."""
    w = Window.partitionBy(*keys).orderBy(at)
    gaps = df.select(*keys, at).distinct().withColumn("gap", F.col(at) - F.lag(at).over(w))
    found = gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean_gap"), F.try_divide(F.stddev_pop("gap"), F.avg("gap")).alias("variation"))
    return found.where((F.col("n") >= least) & (F.col("variation") <= variation))


def cells(df: DataFrame, keys: list[str], at: str, tolerance: float = 0.15) -> DataFrame:
    """Per key, how many gaps between distinct places are within tolerance of the upper median gap."""
    w = Window.partitionBy(*keys).orderBy(at)
    gaps = df.select(*keys, at).distinct().withColumn("gap", F.col(at) - F.lag(at).over(w)).where("gap is not null")
    usual = gaps.groupBy(*keys).agg(upper_median("gap").alias("usual"))
    return gaps.join(usual, keys).groupBy(*keys).agg(F.count_if(F.abs(F.col("gap") - F.col("usual")) <= tolerance * F.col("usual")).alias("cells"), F.max("usual").alias("usual"))
