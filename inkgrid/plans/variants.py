"""Queries on the second engine's rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrid.functions import canon
from inkgrid.operators import variants
from inkgrid.operators.search import transformed
from inkgrid.plans.catalogue import query
from inkgrid.plans.geometry import BOXES, boxes
from inkgrid.plans.lattice import LABELS, STROKES, labelled, strokes, table
from inkgrid.plans.relational import PIPES, pipes
from inkgrid.plans.sheet import FAR


@query(f"""WITH {STROKES}, {BOXES}, p AS (SELECT DISTINCT s.id FROM strokes s JOIN boxes b ON b.page = s.page AND (b.x1 - b.x0) * (b.y1 - b.y0) >= 4000 AND s.ax >= b.x0 - 0.5 AND s.bx <= b.x1 + 0.5 AND s.ay >= b.y0 - 0.5 AND s.by_ <= b.y1 + 0.5),
  t AS (SELECT DISTINCT s.id FROM strokes s JOIN boxes b ON b.page = s.page AND (b.x1 - b.x0) * (b.y1 - b.y0) BETWEEN 1500 AND 3999 AND s.ax >= b.x0 - 1.1 AND s.bx <= b.x1 + 1.1 AND s.ay >= b.y0 - 1.1 AND s.by_ <= b.y1 + 1.1),
  r AS (SELECT s.id, CASE WHEN pen = '1-URGENT' THEN 1 WHEN layer = 'P' THEN 2 WHEN p.id IS NOT NULL THEN 3 WHEN t.id IS NOT NULL THEN 4 ELSE 5 END AS r FROM strokes s LEFT JOIN p ON p.id = s.id LEFT JOIN t ON t.id = s.id)
  SELECT id, ['LETTERING', 'SHEET_FRAME', 'PANEL', 'LETTERING', 'LINEWORK'][r] AS role, ['PATH_PRODUCED_A_GLYPH', 'PATH_SPANS_THE_SHEET', 'INSIDE_A_TEXT_PANEL', 'INSIDE_A_TEXT_ITEM', 'DEFAULT'][r] AS reason FROM r""")
def segment_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each stroke is: lettering, frame, inside a panel or a text, or linework."""
    s, b = strokes(spark, sf_dir).withColumn("path_id", F.col("id")), boxes(spark, sf_dir)
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return variants.segment_roles(s, s.where("pen = '1-URGENT'"), s.where("layer = 'P'"), b.where(area >= 4000), b.where(area.between(1500, 3999)), ["page"]).select("id", "role", "reason")


@query(f"""WITH {STROKES}, d AS (SELECT r.id, l.id AS leader, {FAR.format(s='r', x='l.bx', y='l.by_')} AS distance FROM strokes l JOIN strokes r ON r.page = l.page AND l.len <= 36 AND r.len >= 60 AND r.layer <> 'F') SELECT id, round(min(distance), 6) AS distance, count(DISTINCT leader) AS leaders FROM d WHERE distance <= 2.9 GROUP BY id""")
def leader_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long strokes that short ones end on and that nothing explains."""
    s = strokes(spark, sf_dir)
    ends = s.where("len <= 36").select(F.col("id").alias("leader"), "page", F.col("bx").alias("x"), F.col("by").alias("y"))
    out = variants.leader_support(ends, s.where("len >= 60").select("id", "page", "ax", "ay", "bx", "by"), s.where("layer = 'F'"), ["page"], 2.9)
    return out.withColumn("distance", F.round("distance", 6))


@query("""WITH p AS (SELECT unnest(CASE WHEN l_returnflag = l_linestatus THEN [l_returnflag] ELSE [l_returnflag, l_linestatus] END) AS layer, l_quantity / CASE WHEN l_returnflag = l_linestatus THEN 1 ELSE 2 END AS part FROM lineitem WHERE l_linenumber < 6)
  SELECT layer, round(sum(part) / (SELECT sum(l_quantity) FROM lineitem), 6) AS share FROM p GROUP BY layer HAVING sum(part) / (SELECT sum(l_quantity) FROM lineitem) >= 0.02""")
def pipe_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flags and statuses as layers, by their share of all quantity; some lines have no layer."""
    named = F.when(F.col("l_linenumber") < 6, F.array("l_returnflag", "l_linestatus", F.lit("")))
    out = variants.pipe_layers(table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("length"), named.alias("layers")))
    return out.select("layer", F.round("share", 6).alias("share"))


UNITS = """parts AS (SELECT o_orderkey AS id, o_orderkey // 200 AS page, o_orderkey // 200 * 1000 + o_custkey % 40 AS unit, (o_orderkey * 37) % 300 AS s, (o_orderkey * 37) % 300 + 3 + o_orderkey % 9 AS e FROM orders)"""


@query(f"""WITH {UNITS}, w AS (SELECT page, unit, max(e) - min(s) AS width, count(*) AS n FROM parts GROUP BY ALL), u AS (SELECT page, median(width) AS usual, count(*) AS units FROM w GROUP BY page), wide AS (SELECT w.unit FROM w JOIN u USING (page) WHERE units >= 3 AND n >= 2 AND width > 1.7 * usual),
  p AS (SELECT *, row_number() OVER o AS place, s - max(e) OVER (PARTITION BY unit ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM parts SEMI JOIN wide USING (unit) WINDOW o AS (PARTITION BY unit ORDER BY s, e, id)),
  c AS (SELECT unit, arg_max(place, gap * 100000 - place) AS cut FROM p WHERE gap > 5 GROUP BY unit) SELECT parts.id, CAST(coalesce(p.place >= c.cut, false) AS INTEGER) AS piece FROM parts LEFT JOIN p ON p.id = parts.id LEFT JOIN c ON c.unit = parts.unit""")
def resplit_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of ink much wider than usual on their page, cut at their widest gap."""
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr("o_orderkey div 200").alias("page"), (F.expr("o_orderkey div 200") * 1000 + F.col("o_custkey") % 40).alias("unit"), (F.col("o_orderkey") * 37 % 300).alias("start"))
    return variants.resplit(s.withColumn("end", F.col("start") + 3 + F.col("id") % 9), ["page"], 5.0).select("id", "piece")


@query(f"""WITH {BOXES}, m AS (SELECT page, median(y1 - y0) AS usual FROM boxes GROUP BY page) SELECT id FROM boxes JOIN m USING (page) WHERE NOT (y1 - y0 > 1.3 * usual OR x1 - x0 > 2 * usual OR (id % 2 = 0 AND id % 90 > 1.5 * usual))""")
def without_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes without those too tall, too wide or too straight for their page."""
    ink = boxes(spark, sf_dir).select("id", "page", (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"), (F.col("id") % 2 == 0).alias("straight"), (F.col("id") % 90).alias("longest"))
    return variants.without_outliers(ink, ["page"], 1.3, 2.0, 1.5).select("id")


@query(f"""WITH RECURSIVE {STROKES}, t AS (SELECT id, page, ax, ay, bx, by_, least(greatest(1.6, 0.9 * (len // 12)), 0.45 * len) AS t FROM strokes), ends AS (SELECT id * 2 AS e, id AS edge, page, ax AS x, ay AS y, t FROM t UNION ALL SELECT id * 2 + 1, id, page, bx, by_, t FROM t),
  near AS (SELECT a.e AS u, b.e AS v FROM ends a JOIN ends b ON a.page = b.page AND a.e < b.e AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= least(a.t, b.t) AND (abs(a.t - b.t) <= 1 OR sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 1.6)),
  both_ways AS (SELECT u, v FROM near UNION ALL SELECT v, u FROM near), reach(n, m) AS (SELECT e, e FROM ends UNION SELECT r.n, b.v FROM reach r JOIN both_ways b ON r.m = b.u), c AS (SELECT n AS e, min(m) AS node FROM reach GROUP BY n)
  SELECT a.edge, ca.node AS a_node, cb.node AS b_node FROM ends a JOIN c ca ON ca.e = a.e JOIN c cb ON cb.e = a.e + 1 WHERE a.e % 2 = 0 AND ca.node <> cb.node""")
def scaled_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with the nodes at their ends, which ends of wider pipes reach further for."""
    lines = strokes(spark, sf_dir).select(F.col("id").alias("edge"), "page", "ax", "ay", "bx", "by", F.expr("len div 12").cast("double").alias("width"))
    return variants.scaled_nodes(lines, ["page"])[1]


@query("""SELECT 'customer' AS kind, CAST(c_custkey AS VARCHAR) AS id, c_name AS label FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), n_name FROM nation WHERE n_nationkey = 7""")
def entity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities that an id names."""
    t = lambda n, i, l: table(spark, sf_dir, n).select(F.col(i).alias("id"), F.col(l).alias("label"))  # noqa: E731, E741
    return variants.find({"customer": t("customer", "c_custkey", "c_name"), "nation": t("nation", "n_nationkey", "n_name"), "region": t("region", "r_regionkey", "r_name")}, "7")


@query(f"""WITH {STROKES} SELECT CASE layer WHEN 'F' THEN 'walls' WHEN 'O' THEN 'dashes' ELSE 'support' END AS kind, id, CAST(len AS DOUBLE) AS width, CASE layer WHEN 'F' THEN 0.9 WHEN 'O' THEN 0.7 ELSE 0.4 END::DOUBLE AS confidence FROM strokes""")
def fragment_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of three origins as fragments."""
    s = strokes(spark, sf_dir).withColumn("width", F.col("len"))
    return variants.fragments(s.where("layer = 'F'"), s.where("layer = 'O'"), s.where("layer = 'P'")).select("kind", "id", "width", "confidence")


@query(f"""WITH {LABELS}, h AS (SELECT p_partkey % 40 AS sheet, CASE WHEN p_partkey % 3 = 0 THEN 'scale_bar' ELSE 'ratio_note' END AS source, 50 * (1 + p_partkey % 80 // 40) + CASE WHEN p_partkey % 3 = 0 THEN 0.5 ELSE 0 END AS value FROM labelled),
  c AS (SELECT sheet, value >= 75 AS high, count(DISTINCT source) AS kinds, count(*) AS n, avg(CASE WHEN source = 'ratio_note' THEN value END) AS stated, avg(value) AS mean FROM h GROUP BY ALL),
  r AS (SELECT *, row_number() OVER w AS place, lead(kinds) OVER w AS next_kinds, lead(n) OVER w AS next_n FROM c WINDOW w AS (PARTITION BY sheet ORDER BY kinds DESC, n DESC, high))
  SELECT sheet, CASE WHEN next_kinds >= kinds AND next_n >= n THEN 'AMBIGUOUS' WHEN kinds >= 2 THEN 'CONFIRMED' ELSE 'AMBIGUOUS' END AS state, CASE WHEN NOT coalesce(next_kinds >= kinds AND next_n >= n, false) THEN round(coalesce(stated, mean), 9) END::DOUBLE AS value,
  CASE WHEN next_kinds >= kinds AND next_n >= n THEN 'SCALE_CONFLICT' WHEN kinds >= 2 THEN 'AGREEING_INDEPENDENT_SOURCES' ELSE 'SINGLE_SOURCE' END AS reason FROM r WHERE place = 1""")
def sheet_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scale for each sheet, stated ratios before measured bars."""
    k = F.col("p_partkey")
    bar = k % 3 == 0
    rows = labelled(spark, sf_dir).select((k % 40).alias("sheet"), F.when(bar, "scale_bar").otherwise("ratio_note").alias("source"), (50 * (1 + F.floor(k % 80 / 40)) + F.when(bar, 0.5).otherwise(0.0)).alias("value"))
    return variants.sheet_scale(rows, ["sheet"])


@query(f"""WITH {PIPES}, c AS (SELECT designation, coalesce(nullif(nominal / 100.0, 0.6), 0.5) AS geometry, coalesce(vertical / 7.0, 0) AS text, horizontal / 50.0 AS association, CASE WHEN state = 'CONFIRMED' THEN 1 WHEN nominal % 2 = 0 THEN 0.5 ELSE 0 END AS dimension, CASE WHEN vertical IS NOT NULL THEN 1 ELSE 0 END AS measurement FROM pipes)
  SELECT designation, round(sum(least(geometry, text, association, dimension, measurement))::DOUBLE, 6) AS overall, CAST(sum(measurement) AS BIGINT) AS measured FROM c GROUP BY designation""")
def pipe_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of pipes by aspect, summed by designation."""
    p = pipes(spark, sf_dir)
    c = variants.confidence(F.nullif(F.col("nominal") / 100, F.lit(0.6)), F.col("vertical") / 7, F.col("horizontal") / 50, F.col("state"), F.when(F.col("nominal") % 2 == 0, F.col("nominal")), F.col("vertical"))
    return p.select("designation", c.alias("c")).groupBy("designation").agg(F.round(F.sum("c.overall"), 6).alias("overall"), F.sum("c.measurement").cast("long").alias("measured"))


@query(f"""WITH {STROKES}, d AS (SELECT p.id AS pipe, l.id AS label, pow(greatest(l.ax - p.bx, 0, p.ax - l.bx), 2) + pow(greatest(l.ay - p.by_, 0, p.ay - l.by_), 2) AS d2 FROM strokes p JOIN strokes l ON l.page = p.page AND l.layer = 'P' AND p.len >= 60 AND p.layer = 'O')
  SELECT pipe, label, round(sqrt(d2), 6) AS distance FROM d WHERE d2 <= 900 QUALIFY row_number() OVER (PARTITION BY pipe ORDER BY d2, label) = 1""")
def second_look(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest label of long strokes that have no name yet."""
    s = strokes(spark, sf_dir)
    long_ = s.where("len >= 60").withColumn("pipe", F.col("id"))
    return variants.second_look(long_, long_.where("layer <> 'O'"), s.where("layer = 'P'"), ["page"], 30.0).select("pipe", "label", F.round("distance", 6).alias("distance"))


@query(f"""WITH {STROKES} SELECT id FROM strokes WHERE len % 60 <> 0 AND ax = bx OR layer = 'P'""")
def transformed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that are turned, or placed otherwise than their page."""
    turned = F.when(F.col("ax") == F.col("bx"), F.col("len") % 60).otherwise(0).cast("double")
    matrix = F.when(F.col("layer") == "P", F.array(*map(F.lit, (2.0, 0.0, 0.0, 2.0)))).otherwise(F.array(*map(F.lit, (1.0, 0.0, 0.0, 1.0))))
    return transformed(strokes(spark, sf_dir).withColumns({"rotation": turned, "matrix": matrix})).select("id")


@query("""SELECT p_brand AS brand, min('[' || p_size || ']') AS first_text, min(p_size) AS first_number FROM part GROUP BY p_brand""")
def text_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first size by its JSON text, and by its value."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.min(canon.text_key("p_size")).alias("first_text"), F.min("p_size").alias("first_number"))


@query("""WITH c AS (SELECT o_orderkey // 200 AS page, (o_orderkey // 25) % 8 AS row, o_orderkey % 25 AS col, o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P'), n AS (SELECT page, row, min(col) AS a, max(col) AS b, count(DISTINCT col) AS n, list_sort(list(DISTINCT col)) AS x FROM c GROUP BY page, row),
  g AS (SELECT *, list_transform(range(1, len(x)), lambda i: x[i + 1] - x[i]) AS gaps FROM n WHERE n >= 4), u AS (SELECT *, list_sort(gaps)[len(gaps) // 2 + 1] AS usual FROM g)
  SELECT CAST(page * 8 + row AS BIGINT) AS bar, round(5.0::DOUBLE / (10 * (b - a)), 9) AS value, CAST(len(list_filter(gaps, lambda q: q = usual)) AS INTEGER) AS cells FROM u WHERE b - a >= 2 AND len(list_filter(gaps, lambda q: q = usual)) >= 3""")
def bar_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scales of rows of upright strokes with a number at each end."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.expr("o_orderkey div 200").alias("page"), (F.expr("o_orderkey div 25") % 8).alias("row"), (k % 25).alias("col"))
    x, y = F.col("col") * 10.0, F.col("row") * 100.0
    bars = o.select("page", x.alias("ax"), y.alias("ay"), x.alias("bx"), (y + 5).alias("by"))
    ends = o.groupBy("page", "row").agg(F.min("col").alias("a"), F.max("col").alias("b")).select("page", "row", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("at")), F.struct(F.lit(1).alias("side"), F.col("b").alias("at")))).alias("e"))
    numbers = ends.select(((F.col("page") * 8 + F.col("row")) * 2 + F.col("e.side")).alias("id"), "page", (F.col("e.side") * 5.0).alias("value"), F.lit(4.0).alias("cap"), (F.col("e.at") * 10.0).alias("x0"), (F.col("row") * 100.0 - 6).alias("y0"), (F.col("e.at") * 10.0).alias("x1"), (F.col("row") * 100.0 - 2).alias("y1"))
    return variants.bar_hypotheses(numbers, bars, ["page"]).select(F.expr("from div 2").alias("bar"), "value", "cells")
