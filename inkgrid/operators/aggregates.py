"""Aggregations of quantities and evidence, with their null, state and tie rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.functions import states
from inkgrid.operators.islands import lowest_mode, upper_median

#: Weights of the layer roles' scores, the least score and margin of a verdict.
LEAST_SCORE, LEAST_MARGIN, MOST_SHARE = 0.45, 0.10, 0.60


def quantities(pipes: DataFrame) -> DataFrame:
    """One row for a designation and nominal size: a length is null if any member's is, vertical only if all are; the worst
    state, all reasons, the least confidence. Several resolved diameters leave the nominal one, with a conflict."""
    sizes = F.array_distinct(F.array_compact(F.collect_set("diameter")))
    out = pipes.groupBy("designation", "nominal").agg(
        states.strict_sum(F.col("horizontal_m")).alias("horizontal_m"), F.sum("vertical_m").alias("vertical_m"), states.strict_sum(F.col("total_m")).alias("total_m"),
        F.count(F.lit(1)).alias("n_pipes"), states.worst(F.col("state")).alias("state"), states.reasons(F.col("reasons")).alias("reasons"), F.min("confidence").alias("confidence"), sizes.alias("sizes"),
    )
    clash = F.size("sizes") > 1
    reasons = F.when(clash, F.array_sort(F.array_union("reasons", F.array(F.lit("DIMENSION_CONFLICT"))))).otherwise(F.col("reasons"))
    return out.withColumns({"diameter": F.when(F.size("sizes") == 1, F.get("sizes", F.lit(0))).otherwise(F.col("nominal")), "reasons": reasons}).drop("sizes")


def measured_quantities(pipes: DataFrame) -> DataFrame:
    """The other rule: nulls are counted as not measurable and not added."""
    null = F.coalesce(F.sum("horizontal_m"), F.lit(0.0))
    return pipes.groupBy("designation", "diameter").agg(null.alias("horizontal_m"), F.coalesce(F.sum("vertical_m"), F.lit(0.0)).alias("vertical_m"), F.count(F.lit(1)).alias("n_pipes"), F.count_if(F.col("horizontal_m").isNull()).alias("not_measurable"))


def totals(rows: DataFrame, designation: str = "designation", total: str = "total_m") -> DataFrame:
    """Totals by designation; null lengths count 0 and a null designation as (unresolved)."""
    return rows.groupBy(F.coalesce(F.col(designation), F.lit("(unresolved)")).alias("designation")).agg(F.sum(F.coalesce(F.col(total), F.lit(0.0))).alias("total"), F.count(F.lit(1)).alias("n"))


def layer_signatures(objects: DataFrame, cap: Column | float, span: Column | float, keys: list[str]) -> DataFrame:
    """objects: layer, extent, closed, filled, text, dashed, dash. Per layer: number, upper median extent and shares."""
    share = lambda c: F.avg(c.cast("double"))
    base = objects.groupBy(*keys, "layer").agg(
        F.count(F.lit(1)).alias("n"), upper_median("extent").alias("median_extent"), share(F.col("closed")).alias("closed"), share(F.col("filled")).alias("filled"),
        share(F.col("extent") >= 8 * cap).alias("long"), share(F.col("text")).alias("text"), share(F.col("dashed")).alias("dashed"), F.try_divide(F.max("extent"), span if isinstance(span, Column) else F.lit(span)).alias("span"),
    )
    dashes = objects.where("dash is not null").groupBy(*keys, "layer", "dash").agg(F.count(F.lit(1)).alias("m"))
    top = dashes.groupBy(*keys, "layer").agg(F.max(F.struct("m", "dash")).alias("top"), F.sum("m").alias("all"))
    named = top.select(*keys, "layer", F.when(F.col("top.m") >= 0.7 * F.col("all"), F.col("top.dash")).alias("dominant_dash"))
    return base.join(named, [*keys, "layer"], "left")


def layer_roles(signatures: DataFrame, cap: float, keys: list[str]) -> DataFrame:
    """Roles of layers by six linear scores; the best must reach LEAST_SCORE and lead by LEAST_MARGIN, and a layer of
    over MOST_SHARE of the sheet stays UNKNOWN. signatures also need chain (the share of strokes with a neighbour)."""
    c = F.col
    small = lambda caps: (c("median_extent") <= caps * cap).cast("double")
    spans = F.least(F.lit(1.0), c("span"))
    scores = {
        "TEXT": 0.6 * c("text") + 0.2 * small(1.6) + 0.2 * (1 - c("long")),
        "PIPE": 0.35 * c("chain") + 0.25 * c("long") + 0.2 * spans + 0.2 * c("dominant_dash").isNotNull().cast("double") - 0.4 * c("closed") - 0.4 * c("text"),
        "WALL": 0.4 * c("closed") + 0.25 * c("long") + 0.2 * c("span") - 0.35 * c("chain") - 0.4 * c("text"),
        "SYMBOL": 0.45 * c("closed") + 0.3 * small(6) + 0.25 * (1 - c("span")) - 0.4 * c("long") - 0.3 * c("text"),
        "HATCH": 0.7 * c("filled") + 0.3 * (1 - c("long")),
        "REFERENCE_LINE": 0.4 * c("dashed") + 0.3 * c("long") + 0.3 * (1 - c("chain")) - 0.4 * c("closed") - 0.3 * c("text"),
    }
    ranked = F.reverse(F.array_sort(F.array(*(F.struct(s.alias("score"), F.lit(role).alias("role")) for role, s in scores.items()))))
    share = c("n") / (F.sum("n").over(Window.partitionBy(*keys)) if keys else signatures.agg(F.sum("n")).scalar())
    best, second = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    firm = (best.score >= LEAST_SCORE) & (best.score - second.score >= LEAST_MARGIN) & (c("share") <= MOST_SHARE)
    out = signatures.withColumns({"ranked": ranked, "share": share})
    return out.withColumns({"role": F.when(firm, best.role).otherwise("UNKNOWN"), "confidence": F.when(firm, F.least(F.lit(0.95), best.score)).otherwise(0.0)}).drop("ranked")


def object_role(text: Column, grid: Column, hatch: Column, title: Column, symbol: Column, layer_role: Column) -> Column:
    """The role of an object: what it is itself goes before what its layer is."""
    return F.when(text, "TEXT").when(grid, "GRID").when(hatch, "HATCH").when(title, "TITLE_BLOCK").when(symbol, "SYMBOL").otherwise(F.coalesce(layer_role, F.lit("UNKNOWN")))


def attested(attachments: DataFrame, key: str, hits: int = 3, share: float = 0.05) -> DataFrame:
    """Values of key (layers or pens) with at least `hits` attachments and that share of all."""
    counts = attachments.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("hits"))
    return counts.withColumn("share", F.col("hits") / counts.agg(F.sum("hits")).scalar()).where((F.col("hits") >= hits) & (F.col("share") >= share))


def cap_height(fragments: DataFrame, keys: list[str], height: str = "height", least: float = 1.2, step: float = 0.25) -> DataFrame:
    """Per key, the most frequent height in steps of step, the lower of two as frequent."""
    bins = fragments.where(F.col(height) >= least).withColumn("bin", F.floor(F.col(height) / step + 0.5) * step)
    return bins.groupBy(*keys).agg(lowest_mode("bin").alias("cap_height"))


def dash_gap(gaps: DataFrame, keys: list[str], gap: str = "gap", least: int = 12) -> DataFrame:
    """Per pen, a reach from the most frequent gap of aligned ends: 2.2 times, within 2 and 24."""
    bins = gaps.where(F.col(gap) <= 40).withColumn("bin", F.floor(F.col(gap) / 0.5 + 0.5) * 0.5)
    out = bins.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), lowest_mode("bin").alias("mode"))
    return out.where(F.col("samples") >= least).withColumn("reach", F.greatest(F.lit(2.0), F.least(F.lit(24.0), 2.2 * F.col("mode"))))


def histogram(df: DataFrame, column: str, limit: int = 40) -> DataFrame:
    """The most frequent values: a report of at most limit rows."""
    return df.groupBy(F.col(column).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(limit)


def angle_histogram(df: DataFrame, degrees: Column, bucket: float = 5.0) -> DataFrame:
    return df.groupBy((F.floor(degrees / bucket) * bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def artwork(cells: DataFrame, keys: list[str], least: int = 40, times: float = 25.0) -> DataFrame:
    """Cells so dense that they hold artwork: at least `least` strokes and `times` the upper median of filled cells."""
    usual = cells.groupBy(*keys).agg(F.expr("percentile_approx(n, 0.5, 10000)").alias("usual"))
    return cells.join(usual, keys).where(F.col("n") >= F.greatest(F.lit(least), times * F.col("usual")))


def status(reconciled: Column, scaled: Column, measured: Column) -> Column:
    return F.when(~reconciled, "INVALID").when(~scaled | ~measured, "INCOMPLETE").otherwise("VALID")


def gates(checks: dict[str, DataFrame]) -> DataFrame:
    """checks: name -> offenders. One row per check with their number and whether it passed."""
    rows = None
    for name, offenders in checks.items():
        row = offenders.agg(F.count(F.lit(1)).alias("offenders")).select(F.lit(name).alias("check"), "offenders", (F.col("offenders") == 0).alias("passed"))
        rows = row if rows is None else rows.unionByName(row)
    return rows


def reconcile(candidates: DataFrame, runs: DataFrame, pipes: DataFrame) -> DataFrame:
    """candidates: candidate_id, line. runs: run, edges (array), length. pipes: pipe, runs (array), length_pt. Broken invariants, by gate."""
    lines = candidates.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = pipes.select("pipe", F.explode("runs").alias("run"))
    twice = members.groupBy("run").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bare = runs.join(members, "run", "left_anti")
    edges = runs.select(F.explode("edges").alias("edge")).groupBy("edge").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    a, b = runs.agg(F.coalesce(F.sum("length"), F.lit(0.0)).alias("a")), pipes.agg(F.coalesce(F.sum("length_pt"), F.lit(0.0)).alias("b"))
    sums = a.unionByName(b.select((-F.col("b")).alias("a"))).agg(F.sum("a").alias("d")).where(F.abs("d") > 0.01)
    return gates({"duplicate_centrelines": lines, "run_in_two_pipes": twice, "uncovered_runs": bare, "edge_in_two_runs": edges, "length_difference": sums})
