"""Graph operators as joins: components, propagation, matching and lineage. No edge list reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.session import map_arrow, materialise


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large(edges: DataFrame) -> DataFrame:
    both = _both(edges)
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of components, from all edges at once: roots of linked nodes are hooked onto the lesser one until none are apart."""
    read = [np.stack([b.column(c).to_numpy() for c in ("u", "v")]) for b in batches if b.num_rows]
    if not read:
        return
    nodes, ends = np.unique(np.concatenate(read, axis=1), return_inverse=True)
    u, v = ends.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            break
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]
    for at in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + (1 << 16)]), pa.array(nodes[root[at : at + (1 << 16)]])], ["node", "root"])


def components(edges: DataFrame, few: int = 0) -> DataFrame:
    """edges: u, v. Gives node and root (the least node it is connected with) for nodes with an edge.

    Alternating large and small stars; a round's edges are written to the shared folder, and the rounds end when the
    edges are stars around the roots. Their number grows with the logarithm of the nodes. Up to `few` edges (between longs)
    go through one task instead, since rounds of nine stages over next to nothing load the driver more than the executors.
    """
    seen = None
    edges = edges.where("u <> v").select("u", "v")
    if few:
        edges = materialise(edges, "components")
        if edges.count() <= few:
            return materialise(map_arrow(edges.coalesce(1), _roots, "node long, root long"), "components-roots")
    edges = materialise(edges.distinct(), "components")
    while True:
        state = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen or state[0] == 0:
            break
        seen, edges = state, materialise(_small(_large(edges)), "components")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def labelled(nodes: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """nodes with root; a node without an edge is its own root."""
    roots = components(edges).withColumnRenamed("node", node)
    return nodes.join(roots, node, "left").withColumn("root", F.coalesce("root", F.col(node)))


def matching(pairs: DataFrame, order: list[Column]) -> DataFrame:
    """pairs: u, v. The pairs that a greedy pass in this order takes when each node may be taken once.

    A pair that comes first at both its nodes is in the greedy result; those are taken and their nodes' other pairs
    dropped, round by round. order must be total. A round that takes nothing ends it.
    """
    taken, left = [], materialise(pairs, "matching")
    while True:
        ends = left.select("u", "v", F.struct(*order).alias("o"))
        best = _ends(ends).groupBy("n").agg(F.min("o").alias("first"))
        a, b = best.select(F.col("n").alias("u"), F.col("first").alias("fu")), best.select(F.col("n").alias("v"), F.col("first").alias("fv"))
        new = left.withColumn("_o", F.struct(*order)).join(a, "u").join(b, "v").where("_o = fu and _o = fv").select(*left.columns)
        new = materialise(new, "matching")
        if new.isEmpty():
            break
        taken.append(new)
        used = materialise(new.select(F.col("u").alias("n")).unionByName(new.select(F.col("v").alias("n"))).distinct(), "matching")
        left = left.join(used.withColumnRenamed("n", "u"), "u", "left_anti").join(used.withColumnRenamed("n", "v"), "v", "left_anti").select(*left.columns)
        left = materialise(left, "matching")
    return reduce(DataFrame.unionByName, taken) if taken else left.limit(0)


def _ends(ends: DataFrame) -> DataFrame:
    return ends.select(F.col("u").alias("n"), "o").unionByName(ends.select(F.col("v").alias("n"), "o"))


def propagate(seeds: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """seeds: node, label. edges: u, v, used both ways. Each reached node with depth and the sorted set of labels that
    reach it first; more than one label means that the nearest is not unique. Steps go on until none is reached, or `most`.
    """
    both = materialise(_both(edges).distinct(), "propagate")
    front = materialise(seeds.groupBy("node").agg(F.array_sort(F.collect_set("label")).alias("labels")).withColumn("depth", F.lit(0)), "propagate")
    done, step = front, 0
    while most is None or step < most:
        step += 1
        new = front.join(both, front.node == both.u).select(F.col("v").alias("node"), "labels").join(done.select("node"), "node", "left_anti")
        new = new.groupBy("node").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))).alias("labels")).withColumn("depth", F.lit(step))
        front = materialise(new, "propagate")
        if front.isEmpty():
            break
        done = done.unionByName(front)
    return done


def ancestors(starts: DataFrame, edges: DataFrame, depth: int = 6) -> DataFrame:
    """starts: id. edges: child, parent, relation. start, id, parent, relation and depth of every step back, to a depth; a node expands once a start."""
    front = materialise(starts.select(F.col("id").alias("start"), "id"), "ancestors")
    seen, steps = front, []
    for d in range(1, depth + 1):
        step = materialise(front.join(edges, front.id == edges.child).select("start", "id", "parent", "relation", F.lit(d).alias("depth")), "ancestors")
        if step.isEmpty():
            break
        steps.append(step)
        new = step.select("start", F.col("parent").alias("id")).distinct().join(seen, ["start", "id"], "left_anti")
        front = materialise(new, "ancestors")
        seen = materialise(seen.unionByName(front), "ancestors")
    none = edges.select(F.col("child").alias("start"), F.col("child").alias("id"), "parent", "relation", F.lit(0).alias("depth")).limit(0)
    return reduce(DataFrame.unionByName, steps) if steps else none


def walk(starts: DataFrame, links: DataFrame, hops: int = 14) -> DataFrame:
    """starts: start, node. links: u, v, both ways. Follows the only link onward from each node; at a fork, a dead end or a node seen
    before the walk stops. start, path (nodes in order) and stop."""
    front = materialise(starts.select("start", "node", F.array("node").alias("path")), "walk")
    ended = []
    for _ in range(hops):
        on = front.join(links, front.node == links.u, "left").where(F.col("v").isNull() | ~F.array_contains("path", F.col("v")))
        chosen = on.groupBy("start", "node", "path").agg(F.array_sort(F.collect_set("v")).alias("next"))
        step = materialise(front.join(chosen.select("start", "next"), "start", "left"), "walk")
        n = F.coalesce(F.size("next"), F.lit(0))
        ended.append(step.where(n != 1).select("start", "path", F.when(n > 1, "fork").otherwise("end").alias("stop")))
        front = step.where(n == 1).select("start", F.get("next", F.lit(0)).alias("node"), F.concat("path", F.slice("next", 1, 1)).alias("path"))
        front = materialise(front, "walk")
        if front.isEmpty():
            break
    return reduce(DataFrame.unionByName, [*ended, front.select("start", "path", F.lit("limit").alias("stop"))])


def best_by(df: DataFrame, keys: list[str], order: list[Column], score: str | None = None, eps: float = 1e-9) -> DataFrame:
    """The first row of each key; with score, none where the second's score is within eps of the first's."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_place", F.row_number().over(w))
    if score is not None:
        ranked = ranked.withColumn("_tie", F.coalesce(F.abs(F.lead(score).over(w) - F.col(score)) < eps, F.lit(False))).where("not _tie").drop("_tie")
    return ranked.where("_place = 1").drop("_place")


def mutual_best(pairs: DataFrame, score: str, eps: float = 0.0) -> DataFrame:
    """pairs: u, v and a score, less being better. Pairs that are each other's best; a tie within eps at either end refuses."""
    pairs = materialise(pairs, "mutual")
    ends = pairs.select("u", "v", score).unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), score))
    w = Window.partitionBy("u").orderBy(score, "v")
    first = ends.withColumns({"place": F.row_number().over(w), "next": F.lead(score).over(w)})
    first = first.where((F.col("place") == 1) & (F.col("next").isNull() | (F.col("next") - F.col(score) > eps))).select("u", "v")
    back = first.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return pairs.join(first.join(back, ["u", "v"]).where("u < v"), ["u", "v"])
