"""The evidence graph as three tables: entities, edges and rejections; and questions about it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.functions import canon
from inkgrid.operators import graph


def declare(df: DataFrame, kind: str, id_: str, label: str) -> DataFrame:
    return df.select(F.col(id_).cast("string").alias("id"), F.lit(kind).alias("kind"), F.col(label).cast("string").alias("label")).distinct()


def link(df: DataFrame, child: str, parent: str, relation: str) -> DataFrame:
    """Edges with an id made of their content."""
    out = df.select(F.col(child).cast("string").alias("child"), F.col(parent).cast("string").alias("parent"), F.lit(relation).alias("relation")).distinct()
    return out.withColumn("edge", canon.content_id("ev", F.col("child"), F.col("parent"), F.col("relation")))


def reject(df: DataFrame, id_: str, reason: str) -> DataFrame:
    return df.select(F.col(id_).cast("string").alias("id"), F.col(reason).alias("reason")).distinct()


def why(entities: DataFrame, edges: DataFrame, rejections: DataFrame, ids: DataFrame, depth: int = 6) -> DataFrame:
    """Every step back from ids, with kinds and labels of both ends and the reasons for which an end was refused elsewhere."""
    steps = graph.ancestors(ids, edges, depth)
    name = lambda side: entities.select(F.col("id").alias(side), F.col("kind").alias(f"{side}_kind"), F.col("label").alias(f"{side}_label"))
    refused = rejections.groupBy(F.col("id").alias("parent")).agg(F.array_sort(F.collect_set("reason")).alias("refused"))
    return steps.join(name("id"), "id", "left").join(name("parent"), "parent", "left").join(refused, "parent", "left")


def chain(edges: DataFrame, ids: DataFrame, depth: int = 50) -> DataFrame:
    """All ancestors of ids."""
    return graph.ancestors(ids, edges, depth).select("start", F.col("parent").alias("ancestor")).distinct()
