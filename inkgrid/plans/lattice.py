"""Strokes on integer lattices made of orders: 200 to a page, exact in every engine. Labels made of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrid.functions.geo import Segment
from inkgrid.operators.spatial import with_box

STROKES = """strokes AS (
  SELECT id, page, ax, ay, CASE WHEN id % 3 < 2 THEN ax + len ELSE ax END AS bx, CASE WHEN id % 3 < 2 THEN ay ELSE ay + len END AS by_,
         len, layer, pen, custkey
  FROM (SELECT o_orderkey AS id, o_orderkey // 200 AS page, (o_orderkey * 37) % 300 AS ax, (o_orderkey * 53) % 240 AS ay,
               30 + (o_orderkey % 11) * 6 AS len, o_orderstatus AS layer, o_orderpriority AS pen, o_custkey AS custkey FROM orders))"""

LABELS = """labelled AS (
  SELECT p_partkey, p_size, 'S' || (p_size % 7 + 1) || '-P' || (p_partkey % 5 + 1) || '-' || (50 + p_size) AS label FROM part)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, page, the ends and length of each stroke, its layer, pen and box."""
    k = F.col("o_orderkey")
    flat = k % 3 < 2
    base = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.expr("o_orderkey div 200").alias("page"), (k * 37 % 300).alias("ax"), (k * 53 % 240).alias("ay"), (30 + k % 11 * 6).alias("len"),
        F.col("o_orderstatus").alias("layer"), F.col("o_orderpriority").alias("pen"), F.col("o_custkey").alias("custkey"), flat.alias("flat"),
    )
    ends = base.withColumns({"bx": F.when(F.col("flat"), F.col("ax") + F.col("len")).otherwise(F.col("ax")), "by": F.when(F.col("flat"), F.col("ay")).otherwise(F.col("ay") + F.col("len"))})
    return with_box(ends.drop("flat"), Segment.of())


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, p_size and the label of each part."""
    size, key = F.col("p_size"), F.col("p_partkey")
    label = F.concat(F.lit("S"), size % 7 + 1, F.lit("-P"), key % 5 + 1, F.lit("-"), size + 50)
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", label.alias("label"))
