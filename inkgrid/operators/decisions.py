"""Decisions from evidence: roles of texts, scales, diameters, promotion, associations and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.functions import states, tokens


def _clamp(x: Column, most: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(most), x))


def text_roles(items: DataFrame, text: str, size: bool = True) -> DataFrame:
    """items: text, leader, nearby, repeated, in_panel, title. The ranked roles of each text, and the best one's state.

    A ratio note, an elevation and a size are told by their form, codes by form and evidence; words are room labels.
    """
    t = F.col(text)
    yes = lambda c: F.col(c).cast("double")
    code = tokens.code_like(t) & ~tokens.date_like(t)
    designation = _clamp(0.45 + 0.22 * yes("leader") + 0.12 * yes("nearby") + 0.08 * yes("repeated") - 0.30 * yes("in_panel"), 0.99)
    legend = _clamp(0.30 + 0.45 * (F.col("in_panel") & ~F.col("title")).cast("double") + 0.10 * yes("repeated") - 0.25 * yes("leader"))
    is_size = tokens.dimension(t).isNotNull() if size else F.lit(False)
    bare = tokens.size(t).isNotNull()
    plain = t.rlike(r"^\p{L}")
    scores = {
        "SCALE_NOTE": F.when(tokens.ratio(t).isNotNull(), 0.97), "ELEVATION": F.when(tokens.elevation(t).isNotNull(), 0.95),
        "DIMENSION": F.when(is_size, 0.80).when(bare, 0.45), "PIPE_DESIGNATION": F.when(code, designation), "LEGEND_ENTRY": F.when(code, legend),
        "ROOM_LABEL": F.when(plain & ~code, F.when(F.col("in_panel"), 0.2).otherwise(0.55)), "TITLE_BLOCK": F.when(plain & ~code & F.col("title"), 0.6),
        "IRRELEVANT": F.lit(0.12),
    }
    ranked = F.array_sort(F.filter(F.array(*(F.struct((-s).alias("order"), F.lit(r).alias("role")) for r, s in scores.items())), lambda x: x.order.isNotNull()))
    best = F.get("ranked", F.lit(0))
    out = items.withColumn("ranked", ranked)
    state = F.when(-best.order >= 0.5, "HIGH_CONFIDENCE").when(-best.order > 0, "AMBIGUOUS").otherwise("UNRESOLVED")
    return out.withColumns({"role": best.role, "score": -best.order, "state": state}).drop("ranked")


def structure_score(signals: dict[str, Column]) -> Column:
    """The other rule for designations: nine weighted signals less four penalties, within 0 and 1."""
    weights = {"compound": 0.30, "mixed": 0.22, "leading_alpha": 0.12, "compact": 0.12, "upper": 0.10, "consistent": 0.08, "repetition": 0.10, "legend": 0.10, "leader": 0.08, "date": -0.45, "prose": -0.30, "digits": -0.20, "doubt": -0.25}
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + weight * signals.get(name, F.lit(0.0)).cast("double")
    return _clamp(total)


def scale(hypotheses: DataFrame, keys: list[str], agreement: float = 0.05, rival: float = 0.5) -> DataFrame:
    """hypotheses: value, weight, source. One value for each key, the weighted mean of the heaviest cluster; a rival of half its weight
    is a conflict, two kinds of source confirm.

    By source and value, each hypothesis joins the first cluster whose weighted mean it agrees with, or begins one. Equal
    hypotheses count together, so a key's row holds its distinct ones only.
    """
    once = hypotheses.groupBy(*keys, "source", "value").agg(F.sum("weight").alias("weight"))
    rows = once.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("source", F.col("value").cast("double").alias("value"), F.col("weight").cast("double").alias("weight")))).alias("h"))

    def grown(clusters: Column, h: Column) -> Column:
        mean = lambda c: c.sum / c.weight
        at = F.array_position(F.transform(clusters, lambda c: F.abs(h.value - mean(c)) <= agreement * mean(c)), F.lit(True))
        new = F.struct((h.value * h.weight).alias("sum"), h.weight.alias("weight"), h.value.alias("first"), F.array(h.source).alias("sources"))
        more = lambda c: F.struct((c.sum + h.value * h.weight).alias("sum"), (c.weight + h.weight).alias("weight"), c.first.alias("first"), F.array_union(c.sources, F.array(h.source)).alias("sources"))
        return F.when(at == 0, F.concat(clusters, F.array(new))).otherwise(F.transform(clusters, lambda c, i: F.when(i + 1 == at, more(c)).otherwise(c)))

    none = F.expr("cast(array() as array<struct<sum: double, weight: double, first: double, sources: array<string>>>)")
    clusters = F.aggregate("h", none, grown)
    ordered = F.array_sort(F.transform(clusters, lambda c: F.struct((-F.round(c.weight, 9)).alias("order"), c.first.alias("first"), c.alias("c"))))
    best, second = F.get("ordered", F.lit(0)).c, F.get("ordered", F.lit(1)).c
    out = rows.withColumn("ordered", ordered).withColumns({"best": best, "next": second.weight})
    clash = F.coalesce(F.round("next", 9) >= rival * F.round("best.weight", 9), F.lit(False))
    state = F.when(clash, "SCALE_CONFLICT").when(F.size("best.sources") >= 2, "SCALE_CONFIRMED").otherwise("RESOLVED")
    value = F.round(F.col("best.sum") / F.col("best.weight"), 9)
    return out.select(*keys, state.alias("state"), F.when(~clash, value).alias("value"), F.round("best.weight", 9).alias("weight"), F.size("best.sources").cast("long").alias("sources"))


def metres_per_point(ratio: Column) -> Column:
    return 25.4 / 72 * ratio / 1000


def paper(width: Column, height: Column) -> Column:
    """The ISO A size (A0 to A7) of a sheet in points, to 2 %."""
    short, long_ = F.least(width, height), F.greatest(width, height)
    out = F.lit(None).cast("string")
    for n in range(7, -1, -1):
        a = 1000 * 2 ** (0.25 - n / 2) / 25.4 * 72
        out = F.when((F.abs(long_ - a) <= 0.02 * a) & (F.abs(short - a / 2**0.5) <= 0.02 * a / 2**0.5), f"A{n}").otherwise(out)
    return out


def diameter(label_mm: Column, measured_mm: Column, agreement: float = 0.15) -> Column:
    """mm, confidence and reason from a label's size and the drawn width."""
    none = F.lit(None).cast("string")
    as_ = lambda mm, c, reason: F.struct(mm.cast("double").alias("mm"), F.lit(c).alias("confidence"), (F.lit(reason) if reason else none).alias("reason"))
    agree = F.abs(measured_mm - label_mm) <= agreement * label_mm
    missing = F.lit(None).cast("double")
    return (
        F.when(label_mm.isNull() & measured_mm.isNull(), as_(missing, 0.0, "NO_DIMENSION_EVIDENCE"))
        .when(label_mm.isNull(), as_(measured_mm, 0.8, None))
        .when(measured_mm.isNull(), as_(label_mm, 0.7, "NO_DRAWN_WIDTH"))
        .when(agree, as_(label_mm, 0.97, None))
        .otherwise(as_(measured_mm, 0.6, "DIMENSION_CONFLICT"))
    )


def measured_mm(width_pt: Column, per_point: Column) -> Column:
    return width_pt * per_point * 1000


def tier(reached: Column, leader: Column, length: Column, least: float = 1.0) -> Column:
    """How far a text got: confirmed only with pipes reached, a leader and some length."""
    return F.when(reached & leader & (length >= least), "CONFIRMED_DESIGNATION").when(reached | leader, "DESIGNATION_CANDIDATE").otherwise("TEXT_ONLY")


def associate(leaders: DataFrame, distances: DataFrame, reach: float, eps: float = 0.75) -> DataFrame:
    """leaders: leader, text. distances: leader, run, distance. The nearest run of each leader within reach; a second within eps refuses."""
    w = Window.partitionBy("leader").orderBy("distance", "run")
    ranked = distances.where(F.col("distance") <= reach).withColumns({"place": F.row_number().over(w), "next": F.lead("distance").over(w)}).where("place = 1")
    tie = F.coalesce(F.col("next") - F.col("distance") < eps, F.lit(False))
    joined = leaders.join(ranked, "leader", "left")
    reason = F.when(F.col("run").isNull(), "LEADER_ENDS_NOWHERE").when(tie, "COMPETING_PIPES")
    return joined.select("leader", "text", F.when(reason.isNull(), F.col("run")).alias("run"), "distance", reason.alias("reason"))


def label_conflicts(assignments: DataFrame) -> DataFrame:
    """assignments: run, text. One text for each run: equal ones count once, of two the fuller; otherwise AMBIGUOUS without a name."""
    texts = assignments.groupBy("run").agg(F.array_sort(F.collect_set("text")).alias("texts"))
    two = tokens.fuller(F.get("texts", F.lit(0)), F.get("texts", F.lit(1)))
    name = F.when(F.size("texts") == 1, F.get("texts", F.lit(0))).when(F.size("texts") == 2, two)
    return texts.withColumns({"designation": name, "state": F.when(name.isNull(), "AMBIGUOUS").otherwise("CONFIRMED")})


def hop_confidence(hops: Column) -> Column:
    return F.greatest(F.lit(0.35), 0.85 - 0.15 * hops)


def verified(state: Column, designation: Column, total: Column, reasons: Column) -> Column:
    return state.isin(*states.STATES[:2]) & designation.isNotNull() & total.isNotNull() & (F.size(reasons) == 0)


def measurable(scale_states: Column) -> Column:
    """Aggregate: whether every page has a scale that may be measured with."""
    return F.coalesce(F.bool_and(scale_states.isin("RESOLVED", "SCALE_CONFIRMED")), F.lit(False))


def riser_height(elevations: Column) -> Column:
    """Aggregate: the height between the highest and lowest of two distinct elevations or more; null with fewer."""
    return F.when(F.count_distinct(elevations) >= 2, F.max(elevations) - F.min(elevations))
