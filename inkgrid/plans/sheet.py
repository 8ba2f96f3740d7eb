"""Queries on the operators that read a sheet: frames, grids, dimensions, leaders, symbols, lettering, roles and the search surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrid.functions import states, tokens
from inkgrid.functions.geo import Segment
from inkgrid.operators import aggregates, decisions, layout, links, spatial
from inkgrid.operators import strokes as strokes_of
from inkgrid.operators.search import Sheet
from inkgrid.plans.catalogue import query
from inkgrid.plans.geometry import BOXES, boxes
from inkgrid.plans.lattice import LABELS, STROKES, labelled, strokes, table
from inkgrid.plans.measures import SHARED, SLANTS, S, T, _degrees, _far, slants
from inkgrid.plans.relational import PIPES, pipes

#: Distance of a point to an upright or flat stroke s.
FAR = "sqrt(pow(greatest({s}.ax - {x}, 0, {x} - {s}.bx), 2) + pow(greatest({s}.ay - {y}, 0, {y} - {s}.by_), 2))"


@query(f"""WITH {STROKES}, {BOXES}, f AS (SELECT * FROM boxes WHERE (x1 - x0) * (y1 - y0) >= 4000) SELECT DISTINCT s.id FROM strokes s JOIN f ON f.page = s.page AND s.ax <= f.x1 + 3 AND s.bx >= f.x0 - 3 AND s.ay <= f.y1 + 3 AND s.by_ >= f.y0 - 3
  AND (greatest(abs(ax - x0), abs(bx - x0)) <= 3 OR greatest(abs(ax - x1), abs(bx - x1)) <= 3 OR greatest(abs(ay - y0), abs(by_ - y0)) <= 3 OR greatest(abs(ay - y1), abs(by_ - y1)) <= 3)""")
def on_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strokes that lie on a side of a large closed box."""
    frames = layout.frames(boxes(spark, sf_dir).withColumn("closed", F.lit(True)), F.lit(20000.0), 0.2)
    return layout.on_frame(strokes(spark, sf_dir), frames, ["page"], 3.0)


@query(f"""WITH {BOXES} SELECT id, id % 3 = 0 AS is_rectangle FROM boxes""")
def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four corners, of which one is moved by one or two units or not."""
    c = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    moved = F.struct((F.col("x0") + F.col("id") % 3).cast("double").alias("x"), F.col("y1").cast("double").alias("y"))
    return boxes(spark, sf_dir).select("id", layout.rectangle(F.array(c("x0", "y0"), c("x1", "y0"), c("x1", "y1"), moved)).alias("is_rectangle"))


@query(f"""WITH {STROKES}, l AS (SELECT id, page, CASE WHEN ay = by_ THEN 'x' ELSE 'y' END AS axis FROM strokes WHERE len >= 82.5) SELECT * FROM (SELECT id, axis, count(*) OVER (PARTITION BY page, axis) AS family FROM l) WHERE family >= 3""")
def grid_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long strokes along an axis in families of three or more."""
    return layout.grid_lines(strokes(spark, sf_dir), ["page"], 150.0).select("id", "axis", "family")


TICKS = f"""ticks AS (SELECT * FROM strokes l WHERE len >= 78 AND {" AND ".join(f"EXISTS (SELECT 1 FROM strokes t WHERE t.page = l.page AND t.id <> l.id AND (t.ay = t.by_) <> (l.ay = l.by_) AND t.len <= 60 AND {FAR.format(s='t', x=x, y=y)} <= 30)" for x, y in (('l.ax', 'l.ay'), ('l.bx', 'l.by_')))})"""


@query(f"""WITH {STROKES}, {TICKS}, near AS (SELECT l.id, l.len, n.len AS value FROM ticks l JOIN strokes n ON n.page = l.page AND n.layer = 'P' AND pow(greatest(n.ax - (l.ax + l.bx) / 2, 0, (l.ax + l.bx) / 2 - n.bx), 2) + pow(greatest(n.ay - (l.ay + l.by_) / 2, 0, (l.ay + l.by_) / 2 - n.by_), 2) <= 1600)
  SELECT id, any_value(value) AS value, round(any_value(value) / any_value(len), 6) AS metres_per_point FROM near GROUP BY id HAVING count(*) = 1""")
def dimension_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long strokes with a short one across both ends, and the only number near their middle."""
    s = strokes(spark, sf_dir)
    ticked = layout.ticked(s.where("len >= 78"), s, ["page"], 30.0)
    out = layout.dimension_lines(ticked, s.where("layer = 'P'").withColumn("value", F.col("len")), ["page"], 40.0)
    return out.select("id", "value", F.round("metres_per_point", 6).alias("metres_per_point"))


ATTACH = f"""d AS (SELECT l.id AS leader, r.id AS run, {FAR.format(s='r', x='l.bx', y='l.by_')} AS distance FROM strokes l JOIN strokes r ON r.page = l.page AND l.len <= 36 AND r.len >= 84),
  ranked AS (SELECT *, row_number() OVER w AS place, lead(distance) OVER w AS next FROM d WHERE distance <= 11.9 WINDOW w AS (PARTITION BY leader ORDER BY round(distance, 9), run))"""


@query(f"""WITH {STROKES}, {ATTACH}, a AS (SELECT l.id AS leader, r.run, r.distance, CASE WHEN r.run IS NULL THEN 'LEADER_ENDS_NOWHERE' WHEN next - distance < 0.75 THEN 'COMPETING_PIPES' END AS reason FROM strokes l LEFT JOIN ranked r ON r.leader = l.id AND place = 1 WHERE l.len <= 36)
  SELECT leader, CASE WHEN reason IS NULL THEN run END AS run, round(distance, 6) AS distance, reason FROM a""")
def leader_attachment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest long stroke at the far end of each short one, or why there is none."""
    s = strokes(spark, sf_dir)
    tips = s.where("len <= 36").select(F.col("id").alias("leader"), "page", F.col("pen").alias("text"), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")).alias("tip"))
    runs = s.where("len >= 84").select(F.col("id").alias("run"), "page", "ax", "ay", "bx", "by")
    return layout.attach(tips, runs, ["page"], 11.9).select("leader", "run", F.round("distance", 6).alias("distance"), "reason")


@query(f"""WITH {STROKES}, {ATTACH} SELECT leader AS id, round(min(distance), 6) AS distance FROM d WHERE distance <= 11.9 GROUP BY leader""")
def nearest_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the nearest long stroke is from each tip."""
    s = strokes(spark, sf_dir)
    tips = s.where("len <= 36").select("id", "page", F.col("bx").alias("x"), F.col("by").alias("y"))
    return links.nearest_source(tips, s.where("len >= 84").withColumn("object_id", F.col("id")), ["page"], 11.9).select("id", F.round("distance", 6).alias("distance"))


@query(f"""WITH {STROKES}, {BOXES} SELECT s.id, any_value(b.id) AS symbol FROM strokes s JOIN boxes b ON b.page = s.page AND (b.x1 - b.x0) * (b.y1 - b.y0) <= 600 AND s.ax BETWEEN b.x0 AND b.x1 AND s.ay BETWEEN b.y0 AND b.y1 GROUP BY s.id HAVING count(*) = 1""")
def symbol_at_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The only small box that holds the start of each stroke."""
    points = strokes(spark, sf_dir).select("id", "page", F.col("ax").alias("x"), F.col("ay").alias("y"))
    return links.symbol_at(points, boxes(spark, sf_dir).where("(x1 - x0) * (y1 - y0) <= 600"), ["page"])


@query(f"""WITH {STROKES}, {BOXES}, d AS (SELECT l.id AS leader, b.id AS text, pow(greatest(b.x0 - l.ax, 0, l.ax - b.x1), 2) + pow(greatest(b.y0 - l.ay, 0, l.ay - b.y1), 2) AS d2 FROM strokes l JOIN boxes b ON b.page = l.page AND l.len <= 36 AND (b.x1 - b.x0) * (b.y1 - b.y0) <= 600),
  n AS (SELECT leader, text, d2 FROM d WHERE d2 <= 400 QUALIFY row_number() OVER (PARTITION BY leader ORDER BY d2, text) = 1) SELECT text, min(leader) AS leader FROM n GROUP BY text""")
def leaders_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first leader of those that begin nearest to each small box."""
    leaders = strokes(spark, sf_dir).where("len <= 36").select(F.col("id").alias("leader"), "page", F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")).alias("root"))
    return links.leaders_by_text(leaders, boxes(spark, sf_dir).where("(x1 - x0) * (y1 - y0) <= 600"), ["page"], 20.0).select("text", "leader")


@query(f"""WITH {STROKES}, f AS (SELECT custkey AS pipe, page * 10 + id % 10 AS text, len AS distance FROM strokes WHERE len <= 60), r AS (SELECT *, row_number() OVER w AS place, lead(distance) OVER w AS next FROM f WINDOW w AS (PARTITION BY text ORDER BY distance, pipe)),
  c AS (SELECT pipe, list_sort(list_distinct(list(text))) AS texts, bool_or(coalesce(next - distance < 0.05, false)) AS tie FROM r WHERE place = 1 GROUP BY pipe),
  b AS (SELECT p.custkey AS pipe, list(DISTINCT l.page * 10 + l.id % 10) AS near FROM strokes l JOIN strokes p ON p.page = l.page AND l.len <= 36 AND p.len >= 84 AND pow(greatest(p.ax - l.bx, 0, l.ax - p.bx), 2) + pow(greatest(p.ay - l.by_, 0, l.ay - p.by_), 2) <= 25 GROUP BY p.custkey),
  j AS (SELECT pipe, texts, len(texts) = 1 AND NOT tie AS one, coalesce(list_contains(near, texts[1]), false) AS corroborated FROM c FULL JOIN b USING (pipe))
  SELECT pipe, CASE WHEN one THEN texts[1] END AS text, CASE WHEN texts IS NULL THEN 'HINT' WHEN one THEN 'CONFIRMED' ELSE 'AMBIGUOUS' END AS state, round(CASE WHEN texts IS NULL THEN 0 WHEN one THEN 0.7 + 0.2 * CAST(corroborated AS INTEGER) ELSE 0.4 END::DOUBLE, 6) AS score, corroborated FROM j""")
def both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts claimed by pipes through leaders, against labels near the pipes."""
    s = strokes(spark, sf_dir).withColumn("text", F.col("page") * 10 + F.col("id") % 10)
    forward = s.where("len <= 60").select(F.col("custkey").alias("pipe"), "text", F.col("len").alias("distance"))
    out = links.both_ways(forward, s.where("len <= 36"), s.where("len >= 84").withColumn("pipe", F.col("custkey")), ["page"], 5.0)
    return out.withColumn("score", F.round(F.col("score").cast("double"), 6))


@query(f"""WITH {BOXES}, t AS (SELECT * FROM boxes WHERE y1 - y0 <= 14), p AS (SELECT a.id, b.id AS other, b.y0, b.x0, greatest(b.y0 - a.y1, a.y0 - b.y1) AS gap FROM t a JOIN t b ON a.page = b.page AND a.id <> b.id AND a.x0 < b.x1 AND b.x0 < a.x1 WHERE greatest(b.y0 - a.y1, a.y0 - b.y1) <= 1.5 * (a.y1 - a.y0))
  SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY y0, x0, other) AS place FROM p""")
def adjacent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low boxes that follow each other."""
    return links.adjacent_lines(boxes(spark, sf_dir).where("y1 - y0 <= 14"), ["page"])


@query("""WITH e AS (SELECT l_orderkey AS run, unnest([l_partkey, l_suppkey + 1000000]) AS source FROM lineitem) SELECT run, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM e GROUP BY run""")
def sources_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers of each order's lines."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("edge"), F.array(F.col("l_partkey"), F.col("l_suppkey") + 1000000).alias("sources"))
    runs = li.groupBy("run").agg(F.collect_set("edge").alias("edges"))
    return links.source_objects(runs, li.dropDuplicates(["edge"])).select("run", F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"))


@query("""SELECT l_suppkey AS pipe, round(sum(CASE WHEN l_returnflag IN ('A', 'R') AND (l_linenumber IN (1, 2) OR abs(l_linenumber - 4.4) <= 0.66) THEN CAST(l_quantity AS DOUBLE) ELSE 0 END) / sum(CAST(l_quantity AS DOUBLE)), 6) AS share,
  sum(CASE WHEN l_returnflag IN ('A', 'R') AND (l_linenumber IN (1, 2) OR abs(l_linenumber - 4.4) <= 0.66) THEN CAST(l_quantity AS DOUBLE) ELSE 0 END) / sum(CAST(l_quantity AS DOUBLE)) >= 0.25 AS counts FROM lineitem GROUP BY l_suppkey""")
def attested_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each supplier's quantity on attested layers (return flags) and pens (line numbers)."""
    layer = links.layer_gate(F.array("l_returnflag"), F.array(F.lit("A"), F.lit("R")))
    pen = links.pen_gate(F.col("l_linenumber").cast("double"), [1.0, 2.0, 4.4])
    pieces = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("pipe"), F.col("l_quantity").cast("double").alias("length"), layer.alias("layer_ok"), pen.alias("pen_ok"))
    return links.attested_share(pieces, 0.25).withColumn("share", F.round("share", 6))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS object_id FROM orders WHERE o_orderstatus = 'F' AND (o_orderpriority <> '5-LOW' OR o_orderkey % 100 >= 75) OR o_orderstatus = 'P' AND (o_orderpriority <> '5-LOW' OR o_orderkey % 100 >= 75)""")
def ruled_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects whose role rules out a pipe."""
    role = F.when(F.col("layer") == "F", "WALL").when(F.col("layer") == "P", "LEGEND").otherwise("PIPE")
    rows = strokes(spark, sf_dir).select(F.col("id").cast("string").alias("object_id"), role.alias("role"), F.when(F.col("pen") == "5-LOW", "layer").otherwise("object").alias("source"), ((F.col("id") % 100) / 100).alias("confidence"))
    return links.non_pipe(rows)


@query(f"""WITH {PIPES} SELECT count(*) AS pipes, count(designation) AS named, count(CASE WHEN nominal % 3 = 0 THEN nominal END) AS sized, count(vertical) AS measured, round(avg(CASE WHEN vertical IS NOT NULL THEN horizontal / 50.0 END), 6) AS mean_confidence, count(*) FILTER (state = 'AMBIGUOUS') AS ambiguous FROM pipes""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by what is known about pipes."""
    p = pipes(spark, sf_dir).select("designation", F.when(F.col("nominal") % 3 == 0, F.col("nominal")).alias("diameter"), F.col("vertical").alias("horizontal_m"), F.when(F.col("vertical").isNotNull(), F.col("horizontal") / 50).alias("confidence"), "state")
    return links.metrics(p).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query(f"""WITH {PIPES}, c AS (SELECT designation, nominal, horizontal, vertical, state, CASE WHEN nominal % 4 = 0 THEN 'HIGH_CONFIDENCE' ELSE 'CONFIRMED' END AS other FROM pipes),
  v AS (SELECT *, state IN ('CONFIRMED', 'HIGH_CONFIDENCE') AND vertical IS NOT NULL AND nominal % 5 > 0 AS verified, least(horizontal / 50::DOUBLE, vertical / 7::DOUBLE) AS low FROM c)
  SELECT designation, nominal, count(*) FILTER (verified) AS verified, round(sum(coalesce(low, 0)), 6) AS confidence, count(*) FILTER (state = 'AMBIGUOUS') AS worst_ambiguous, count(*) FILTER (state <> 'AMBIGUOUS' AND (state = 'HIGH_CONFIDENCE' OR other = 'HIGH_CONFIDENCE')) AS worst_high,
  bool_and(nominal % 7 <> 0) AS measurable FROM v GROUP BY ALL""")
def row_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows are verified, their least confidence and worst state, and whether all may be measured."""
    p = pipes(spark, sf_dir)
    reasons = F.when(F.col("nominal") % 5 == 0, F.array(F.lit("X"))).otherwise(F.expr("cast(array() as array<string>)"))
    worst = states.worst_of(F.col("state"), F.when(F.col("nominal") % 4 == 0, "HIGH_CONFIDENCE").otherwise("CONFIRMED"))
    low = states.overall(F.col("horizontal") / 50, F.col("vertical") / 7)
    rows = p.select("designation", "nominal", decisions.verified(F.col("state"), F.col("designation"), F.col("vertical"), reasons).alias("ok"), low.alias("low"), worst.alias("worst"), F.when(F.col("nominal") % 7 == 0, "SCALE_CONFLICT").otherwise("RESOLVED").alias("scale"))
    return rows.groupBy("designation", "nominal").agg(F.count_if("ok").alias("verified"), F.round(F.sum("low"), 6).alias("confidence"), F.count_if(F.col("worst") == "AMBIGUOUS").alias("worst_ambiguous"), F.count_if(F.col("worst") == "HIGH_CONFIDENCE").alias("worst_high"), decisions.measurable(F.col("scale")).alias("measurable"))


@query(f"""WITH {LABELS}, a AS (SELECT l_orderkey AS run, CASE WHEN l_linenumber % 2 = 0 THEN label ELSE regexp_extract(label, '^(.*)-[0-9]+$', 1) END AS text FROM lineitem JOIN labelled ON p_partkey = l_partkey),
  t AS (SELECT run, list_sort(list_distinct(list(text))) AS t FROM a GROUP BY run), n AS (SELECT run, CASE WHEN len(t) = 1 THEN t[1] WHEN len(t) = 2 AND starts_with(t[2], t[1]) AND regexp_matches(substr(t[2], length(t[1]) + 1), '^[-/][0-9]+$') THEN t[2] END AS designation FROM t)
  SELECT run, designation, CASE WHEN designation IS NULL THEN 'AMBIGUOUS' ELSE 'CONFIRMED' END AS state FROM n""")
def label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text for each run, of two the fuller."""
    li = table(spark, sf_dir, "lineitem").join(labelled(spark, sf_dir), F.col("p_partkey") == F.col("l_partkey"))
    text = F.when(F.col("l_linenumber") % 2 == 0, F.col("label")).otherwise(F.regexp_extract("label", "^(.*)-[0-9]+$", 1))
    return decisions.label_conflicts(li.select(F.col("l_orderkey").alias("run"), text.alias("text"))).select("run", "designation", "state")


@query(f"""WITH {LABELS} SELECT p_partkey, round(greatest(0, least(1, 0.30::DOUBLE + 0.12 * CAST(p_size % 2 = 0 AS INTEGER) + 0.22 * CAST(p_size % 3 = 0 AS INTEGER) + 0.10 * CAST(p_size % 5 = 0 AS INTEGER) - 0.45 * CAST(p_partkey % 4 = 0 AS INTEGER) - 0.30 * CAST(p_partkey % 7 = 0 AS INTEGER))), 6) AS score,
  CASE p_size % 4 WHEN 0 THEN 'A4' WHEN 1 THEN 'A3' WHEN 2 THEN 'A1' END AS paper, round(p_size * 0.35::DOUBLE * 1000, 6) AS width_mm, round(greatest(0.35, 0.85::DOUBLE - 0.15 * (p_size % 6)), 6) AS hop, round(25.4::DOUBLE / 72 * p_size / 1000, 9) AS per_point FROM labelled""")
def form_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by structure, sheet sizes, drawn widths and confidence by hops."""
    n, k = F.col("p_size"), F.col("p_partkey")
    signals = {"compound": F.col("label").contains("-"), "leading_alpha": n % 2 == 0, "mixed": n % 3 == 0, "upper": n % 5 == 0, "date": k % 4 == 0, "prose": k % 7 == 0}
    sheet = lambda a, b, c, d: F.when(n % 4 == 0, F.lit(a)).when(n % 4 == 1, F.lit(b)).when(n % 4 == 2, F.lit(c)).otherwise(F.lit(d))
    return labelled(spark, sf_dir).select(
        "p_partkey", F.round(decisions.structure_score(signals), 6).alias("score"), decisions.paper(sheet(595.3, 1190.6, 1683.8, 500.0), sheet(841.9, 841.9, 2383.9, 500.0)).alias("paper"),
        F.round(decisions.measured_mm(n, F.lit(0.35)), 6).alias("width_mm"), F.round(decisions.hop_confidence(n % 6), 6).alias("hop"), F.round(decisions.metres_per_point(n), 9).alias("per_point"),
    )


MARKS = "marks AS (SELECT o_orderkey AS id, o_orderkey // 200 AS page, (o_orderkey * 37) % 300 AS x0, (o_orderkey * 53) % 240 AS y0, (o_orderkey * 37) % 300 + 3 + o_orderkey % 5 AS x1, (o_orderkey * 53) % 240 + 4 + o_orderkey % 7 AS y1 FROM orders)"
JOINED = """, both_ways AS (SELECT u, v FROM near UNION ALL SELECT v, u FROM near), reach(n, m) AS (SELECT id, id FROM marks UNION SELECT r.n, b.v FROM reach r JOIN both_ways b ON r.m = b.u), comp AS (SELECT n AS id, min(m) AS root FROM reach GROUP BY n)"""


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small boxes, 200 to a page."""
    return boxes(spark, sf_dir).withColumns({"x1": F.col("x0") + 3 + F.col("id") % 5, "y1": F.col("y0") + 4 + F.col("id") % 7})


@query(f"""WITH RECURSIVE {MARKS}, near AS (SELECT a.id AS u, b.id AS v FROM marks a JOIN marks b ON a.page = b.page AND a.id < b.id AND pow(greatest(b.x0 - a.x1, 0, a.x0 - b.x1), 2) + pow(greatest(b.y0 - a.y1, 0, a.y0 - b.y1), 2) <= 4){JOINED},
  c AS (SELECT root AS id, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, count(*) AS parts FROM comp JOIN marks USING (id) GROUP BY root) SELECT * FROM c WHERE greatest(x1 - x0, y1 - y0) <= 52""")
def characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks at most 2 apart as characters of at most 52."""
    return strokes_of.characters(marks(spark, sf_dir), ["page"], 20.0).select("id", "x0", "x1", "y0", "y1", "parts")


@query(f"""WITH RECURSIVE {MARKS}, near AS (SELECT a.id AS u, b.id AS v FROM marks a JOIN marks b ON a.page = b.page AND a.id < b.id AND greatest(b.x0 - a.x1, a.x0 - b.x1) <= 1.1 * least(a.y1 - a.y0, b.y1 - b.y0) AND least(a.y1, b.y1) - greatest(a.y0, b.y0) >= 0.5 * least(a.y1 - a.y0, b.y1 - b.y0)){JOINED}
  SELECT id, root AS line FROM comp""")
def glyph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks whose bands overlap and whose gaps are small, as lines."""
    return layout.glyph_lines(marks(spark, sf_dir), ["page"]).select("id", "line")


@query(f"""WITH RECURSIVE {MARKS}, near AS (SELECT a.id AS u, b.id AS v FROM marks a JOIN marks b ON a.page = b.page AND a.id < b.id AND greatest(b.y0 - a.y1, a.y0 - b.y1) BETWEEN 0 AND 11 AND least(a.x1, b.x1) - greatest(a.x0, b.x0) >= 0.45 * least(a.x1 - a.x0, b.x1 - b.x0) AND greatest(a.y1, b.y1) - least(a.y0, b.y0) <= 25){JOINED}
  SELECT root AS id, min(x0) AS x0, max(y1) AS y1, count(*) AS parts FROM comp JOIN marks USING (id) GROUP BY root""")
def stacked_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks above each other as one character."""
    chars = marks(spark, sf_dir).withColumns({"parts": F.lit(1), "ids": F.array("id")})
    return strokes_of.stacked_parts(chars, ["page"], 20.0).select("id", "x0", "y1", "parts")


@query("""WITH c AS (SELECT DISTINCT o_orderkey // 200 AS page, (o_orderkey // 25) % 8 AS row, o_orderkey % 25 AS col, o_orderkey AS id FROM orders WHERE o_orderstatus <> 'O'),
  g AS (SELECT *, col - row_number() OVER (PARTITION BY page, row ORDER BY col) AS island FROM c) SELECT page, min(id) AS bar, count(*) AS n, CAST(10 * count(*) AS DOUBLE) AS length FROM g GROUP BY page, row, island HAVING count(*) >= 3""")
def scale_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of one size in rows, those that touch as bars of three or more."""
    k = F.col("o_orderkey")
    cells = table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").select(k.alias("id"), F.expr("o_orderkey div 200").alias("page"), (k % 25 * 10.0).alias("x0"), (F.expr("o_orderkey div 25") % 8 * 20.0).alias("y0"))
    cells = cells.withColumns({"x1": F.col("x0") + 10, "y1": F.col("y0") + 4})
    return layout.scale_bars(cells, ["page"]).select("page", "bar", "n", "length")


@query(f"""WITH {STROKES} SELECT CAST(id AS VARCHAR) AS object_id FROM strokes WHERE len <> 30""")
def without_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strokes without those that annotations copy, the other way round and a little off."""
    at = lambda a, b, off: F.struct((F.col(a) + off).cast("double").alias("x"), (F.col(b) + off).cast("double").alias("y"))
    s = strokes(spark, sf_dir).withColumn("object_id", F.col("id").cast("string"))
    marked = s.where("len = 30").withColumn("pts", F.array(at("bx", "by", 0.03), at("ax", "ay", 0.03)))
    return links.exclude_markup(s.withColumn("pts", F.array(at("ax", "ay", 0.0), at("bx", "by", 0.0))), marked, ["page"]).select("object_id")


ROLES = """s AS (SELECT pen AS layer, count(*) AS n, list_sort(list(len))[count(*) // 2 + 1] AS median_extent, avg(CAST(layer = 'P' AS INTEGER)) AS text, avg(CAST(ax = bx AS INTEGER)) AS closed, avg(CAST(len >= 60 AS INTEGER)) AS long, avg(CAST(layer = 'F' AND len < 40 AS INTEGER)) AS filled, avg(CAST(len < 40 AS INTEGER)) AS dashed, avg(CAST(len >= 42 AS INTEGER)) AS chain, max(len) / 300.0 AS span FROM strokes GROUP BY pen),
  r AS (SELECT layer, n, unnest([{'role': 'TEXT', 'score': 0.6 * text + 0.2 * CAST(median_extent <= 1.6 * 40 AS INTEGER) + 0.2 * (1 - long)}, {'role': 'PIPE', 'score': 0.35 * chain + 0.25 * long + 0.2 * least(1, span) - 0.4 * closed - 0.4 * text}, {'role': 'WALL', 'score': 0.4 * closed + 0.25 * long + 0.2 * span - 0.35 * chain - 0.4 * text},
    {'role': 'SYMBOL', 'score': 0.45 * closed + 0.3 * CAST(median_extent <= 6 * 40 AS INTEGER) + 0.25 * (1 - span) - 0.4 * long - 0.3 * text}, {'role': 'HATCH', 'score': 0.7 * filled + 0.3 * (1 - long)}, {'role': 'REFERENCE_LINE', 'score': 0.4 * dashed + 0.3 * long + 0.3 * (1 - chain) - 0.4 * closed - 0.3 * text}]) AS x FROM s),
  o AS (SELECT layer, n, x.role AS role, x.score AS score, row_number() OVER w AS place, lead(x.score) OVER w AS next FROM r WINDOW w AS (PARTITION BY layer ORDER BY x.score DESC, x.role DESC))"""


@query(f"""WITH {STROKES}, {ROLES} SELECT layer, CASE WHEN score >= 0.45 AND score - next >= 0.10 AND n / sum(n) OVER () <= 0.6 THEN role ELSE 'UNKNOWN' END AS role, round(CASE WHEN score >= 0.45 AND score - next >= 0.10 AND n / sum(n) OVER () <= 0.6 THEN least(0.95, score) ELSE 0 END, 6) AS confidence FROM o WHERE place = 1""")
def layer_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of pens by six scores of their strokes."""
    share = lambda c: F.avg(F.expr(c).cast("int"))
    from inkgrid.operators.islands import upper_median

    signs = strokes(spark, sf_dir).groupBy(F.col("pen")).agg(
        F.count(F.lit(1)).alias("n"), upper_median("len").alias("median_extent"), share("layer = 'P'").alias("text"), share("ax = bx").alias("closed"), share("len >= 60").alias("long"), share("layer = 'F' and len < 40").alias("filled"),
        share("len < 40").alias("dashed"), share("len >= 42").alias("chain"), (F.max("len") / 300).alias("span"), F.lit(None).cast("string").alias("dominant_dash"),
    )
    return aggregates.layer_roles(signs.withColumnRenamed("pen", "layer"), 40.0, []).select("layer", "role", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {STROKES} SELECT id, CASE WHEN layer = 'P' THEN 'TEXT' WHEN len >= 84 THEN 'GRID' WHEN len = 30 THEN 'HATCH' WHEN ax < 20 THEN 'TITLE_BLOCK' WHEN ax = bx THEN 'SYMBOL' WHEN pen = '5-LOW' THEN 'UNKNOWN' ELSE 'PIPE' END AS role FROM strokes""")
def object_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What objects are, before what their layers are."""
    is_ = F.expr
    role = aggregates.object_role(is_("layer = 'P'"), is_("len >= 84"), is_("len = 30"), is_("ax < 20"), is_("ax = bx"), F.when(F.col("pen") != "5-LOW", "PIPE"))
    return strokes(spark, sf_dir).select("id", role.alias("role"))


@query("""WITH b AS (SELECT l_suppkey, floor(l_quantity / 0.5 + 0.5) * 0.5 AS bin FROM lineitem WHERE l_quantity <= 40), g AS (SELECT l_suppkey, bin, count(*) AS n FROM b GROUP BY l_suppkey, bin), c AS (SELECT *, sum(n) OVER (PARTITION BY l_suppkey) AS samples FROM g)
  SELECT l_suppkey, CAST(samples AS BIGINT) AS samples, CAST(bin AS DOUBLE) AS mode, round(greatest(2, least(24, 2.2 * bin))::DOUBLE, 6) AS reach FROM c WHERE samples >= 12 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, bin) = 1""")
def dash_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reach for each supplier from its most frequent quantity, as for the gaps of a pen."""
    gaps = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").cast("double").alias("gap"))
    return aggregates.dash_gap(gaps, ["l_suppkey"]).select("l_suppkey", "samples", "mode", F.round("reach", 6).alias("reach"))


IOU = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"


@query(f"""WITH {BOXES}, r AS (SELECT id + 10000000 AS id, page, x0 + 2 AS x0, y0 + 1 AS y0, x1 + 2 AS x1, y1 + 1 AS y1, CASE WHEN id % 3 = 0 THEN 'x' ELSE 't' || id % 7 END AS text FROM boxes WHERE x1 - x0 <= 40), sp AS (SELECT *, 't' || id % 7 AS text FROM boxes WHERE y1 - y0 <= 50),
  p AS (SELECT a.id, b.id AS reading, a.text = b.text AS agree, {IOU} / CAST((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {IOU} AS DOUBLE) AS iou FROM sp a JOIN r b ON a.page = b.page AND {IOU} > 0),
  f AS (SELECT * FROM p WHERE iou >= 0.35 QUALIFY row_number() OVER (PARTITION BY id ORDER BY iou DESC, reading) = 1)
  SELECT sp.id, sp.text, CASE WHEN f.reading IS NULL THEN 'span' ELSE 'span+glyph' END AS origin, f.reading, f.agree FROM sp LEFT JOIN f USING (id) UNION ALL SELECT r.id, r.text, 'glyph', NULL, NULL FROM r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.reading = r.id AND p.iou >= 0.35)""")
def merged_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the file and readings of strokes that cover each other."""
    b = boxes(spark, sf_dir)
    name = F.concat(F.lit("t"), F.col("id") % 7)
    moved = {"x0": F.col("x0") + 2, "y0": F.col("y0") + 1, "x1": F.col("x1") + 2, "y1": F.col("y1") + 1}
    read = b.where("x1 - x0 <= 40").withColumn("text", F.when(F.col("id") % 3 == 0, "x").otherwise(name)).withColumns(moved).withColumn("id", F.col("id") + 10000000)
    out = strokes_of.merge_readings(b.where("y1 - y0 <= 50").withColumn("text", name), read, ["page"])
    return out.select("id", "text", "origin", "reading", "agree")


@query(f"""WITH {SLANTS} SELECT id, round(CASE WHEN {_far(T, 'ax', 'ay')} <= 80 AND {_far(T, 'bx', 'by_')} <= 80 AND abs(90 - abs(90 - abs({_degrees(S)} - {_degrees(T)}))) <= 60 THEN greatest(0, {SHARED}) ELSE 0 END, 6) AS share FROM slants""")
def share_along(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of one segment that stays near another."""
    run = Segment(*(F.col(c) for c in ("cx", "cy", "dx", "dy")))
    return slants(spark, sf_dir).select("id", F.round(strokes_of.share_along(Segment.of(), run, 80.0, 60.0), 6).alias("share"))


@query(f"""WITH {STROKES}, e AS (SELECT id, least(id % 7, id % 5 + 7) AS u, greatest(id % 7, id % 5 + 7) AS v, layer, CASE WHEN len < 60 THEN 1 ELSE 2 END AS line FROM strokes) SELECT layer, u, v, min(id) AS id, count(*) AS n FROM e GROUP BY layer, u, v, line""")
def coincident_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between the same nodes along the same line as one, drawn one way or the other."""
    ends = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((0.0, 0.0), (9.0, 1.0))]
    line = F.when(F.col("len") < 60, F.when(F.col("id") % 2 == 0, F.array(*ends)).otherwise(F.array(*ends[::-1]))).otherwise(F.array(ends[0], F.struct(F.lit(3.0).alias("x"), F.lit(5.0).alias("y")), ends[1]))
    rows = strokes(spark, sf_dir).select("id", "layer", (F.col("id") % 5 + 7).alias("node_a"), (F.col("id") % 7).alias("node_b"), line.alias("pts"))
    return strokes_of.coincident(rows, ["layer"]).select("layer", "u", "v", "id", F.size("ids").cast("long").alias("n"))


def sheet(spark: SparkSession, sf_dir: str) -> Sheet:
    """Strokes as objects, segments, glyphs and texts of a drawing."""
    s = strokes(spark, sf_dir)
    number = F.array(F.lit(1.0))
    objects = s.select(
        F.col("id").alias("object_id"), "page", F.when(F.col("layer") == "O", "path").when(F.col("layer") == "F", "text").otherwise("image").alias("kind"), (F.col("len") / 60).alias("stroke_width"), number.alias("stroke"),
        F.when(F.col("pen") == "1-URGENT", "[3 2] 0").otherwise("[] 0").alias("dashes"), (F.col("ax") == F.col("bx")).alias("closed"), F.when(F.col("pen") == "5-LOW", number).alias("fill"), "layer", "x0", "y0", "x1", "y1",
    )
    segments = s.select(F.col("id").cast("string").alias("id"), "page", "ax", "ay", "bx", "by", (F.col("len") / 60).alias("stroke_width"))
    text = F.when(F.col("len") == 48, F.concat(F.lit("DN "), F.col("id") % 90 + 10)).when(F.col("len") == 54, "Ø 50 12x8").otherwise(F.concat(F.lit("T"), F.col("id")))
    texts = s.where("layer = 'P'").select(F.col("id").alias("text_id"), "page", text.alias("text"), "x0", "y0", "x1", "y1")
    glyphs = s.select(F.col("id").alias("glyph_id"), "page", F.when(F.col("len") > 36, F.substring("pen", 3, 1)).alias("character"), (F.col("len") / 200).alias("confidence"), "x0", "y0", "x1", "y1")
    return Sheet(objects, segments, texts, glyphs)


def _hit(kind: str, detail: str, source: str = "strokes s", search: str = "") -> str:
    return f"SELECT '{search}' AS search, CAST(s.page AS INTEGER) AS page, '{kind}' AS type, CAST(s.id AS VARCHAR) AS id, {detail} AS detail FROM {source}"


KIND = "CASE s.layer WHEN 'O' THEN 'path' WHEN 'F' THEN 'text' ELSE 'image' END"
TEXT = "CASE WHEN s.len = 48 THEN 'DN ' || (s.id % 90 + 10) WHEN s.len = 54 THEN 'Ø 50 12x8' ELSE 'T' || s.id END"
CHARACTER = "CASE WHEN s.len > 36 THEN substr(s.pen, 3, 1) END"
LONG = "CAST(CAST(s.len AS DOUBLE) AS VARCHAR)"


@query(f"""WITH {STROKES} {" UNION ALL ".join([
    _hit("object", KIND, f"strokes s WHERE {KIND} = 'image'", "images"), _hit("path", "s.layer", f"strokes s WHERE {KIND} = 'path' AND s.pen = '1-URGENT' AND s.ax <> s.bx", "dashed"),
    _hit("path", "s.layer", f"strokes s WHERE {KIND} = 'path' AND s.pen = '5-LOW' AND s.len = 60", "filled"), _hit("glyph", CHARACTER, "strokes s WHERE s.len < 50", "unresolved"),
    _hit("glyph", CHARACTER, f"strokes s WHERE {CHARACTER} = 'H'", "character"), _hit("text", TEXT, f"strokes s WHERE s.layer = 'P' AND {TEXT} LIKE 'DN %'", "text"),
    _hit("segment", LONG, "strokes s WHERE s.ax = s.bx AND s.page = 1", "vertical"), _hit("segment", LONG, "strokes s WHERE s.ay = s.by_ AND s.len >= 84", "horizontal"),
])}""")
def search_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches for objects, paths, glyphs, texts and segments, side by side."""
    d = sheet(spark, sf_dir)
    found = {
        "images": d.search_objects("image"), "dashed": d.search_paths(dashed=True, closed=False), "filled": d.search_paths(filled=True, line_width=1.0), "unresolved": d.search_glyphs(unresolved=True),
        "character": d.search_glyphs("H"), "text": d.search_text("dn "), "vertical": d.search_vertical(1), "horizontal": d.search_geometry(min_length=84, angle=0.0),
    }
    out = None
    for name, hits in found.items():
        one = hits.select(F.lit(name).alias("search"), "page", "type", "id", "detail")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {STROKES}, d AS (SELECT page, id, regexp_extract({TEXT.replace('s.', '')}, '^DN ([0-9]+)$', 1) AS dn, len FROM strokes WHERE layer = 'P') SELECT CAST(page AS INTEGER) AS page, CAST(id AS VARCHAR) AS id, 'box 12.0' AS detail FROM d WHERE len = 54""")
def dimension_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes that the words of texts state."""
    return sheet(spark, sf_dir).search_dimensions().select("page", "id", "detail")


GAP = "pow(greatest(b.ax - a.bx, 0, a.ax - b.bx), 2) + pow(greatest(b.ay - a.by_, 0, a.ay - b.by_), 2)"


@query(f"""WITH {STROKES}, p AS (SELECT * FROM strokes WHERE page = (SELECT page FROM strokes WHERE id = 7) AND id <> 7), a AS (SELECT * FROM strokes WHERE id = 7)
  SELECT 'text' AS search, CAST(b.page AS INTEGER) AS page, CAST(b.id AS VARCHAR) AS id FROM strokes b WHERE EXISTS (SELECT 1 FROM strokes a WHERE a.layer = 'P' AND a.len = 48 AND a.page = b.page AND {GAP} <= 100)
  UNION ALL SELECT 'parallel', CAST(b.page AS INTEGER), CAST(b.id AS VARCHAR) FROM p b, a WHERE (a.ay = a.by_) = (b.ay = b.by_) AND (CASE WHEN a.ay = a.by_ THEN abs(a.ay - b.ay) ELSE abs(a.ax - b.ax) END) <= 40
    AND (CASE WHEN a.ay = a.by_ THEN least(a.bx, b.bx) - greatest(a.ax, b.ax) ELSE least(a.by_, b.by_) - greatest(a.ay, b.ay) END) >= 0.25 * greatest(a.len, b.len)
  UNION ALL SELECT 'collinear', CAST(b.page AS INTEGER), CAST(b.id AS VARCHAR) FROM p b, a WHERE (a.ay = a.by_) = (b.ay = b.by_) AND (CASE WHEN a.ay = a.by_ THEN a.ay = b.ay AND greatest(a.ax, b.ax) - least(a.bx, b.bx) <= 24 ELSE a.ax = b.ax AND greatest(a.ay, b.ay) - least(a.by_, b.by_) <= 24 END)
  UNION ALL SELECT 'connected', CAST(b.page AS INTEGER), CAST(b.id AS VARCHAR) FROM p b, a WHERE least((a.ax-b.ax)**2 + (a.ay-b.ay)**2, (a.ax-b.bx)**2 + (a.ay-b.by_)**2, (a.bx-b.ax)**2 + (a.by_-b.ay)**2, (a.bx-b.bx)**2 + (a.by_-b.by_)**2) <= 400
  UNION ALL SELECT 'point', CAST(b.page AS INTEGER), CAST(b.id AS VARCHAR) FROM strokes b, (SELECT 150 AS ax, 150 AS bx, 120 AS ay, 120 AS by_) a WHERE b.page = 1 AND {GAP} <= 625""")
def search_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies near texts, beside and along one segment, and around a point."""
    d = sheet(spark, sf_dir)
    found = {"text": d.search_near_text("dn ", 10.0), "parallel": d.search_parallel("7"), "collinear": d.search_collinear("7"), "connected": d.search_connected("7", 20.0), "point": d.search_near_point(1, 150.0, 120.0, 25.0).where("type = 'object'")}
    out = None
    for name, hits in found.items():
        one = hits.select(F.lit(name).alias("search"), "page", "id")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {STROKES} SELECT page, id, reason, x0, y0, x1, y1 FROM (
  SELECT page, id, 'COMPETING_PIPES' AS reason, least(ax, 150) - 12 AS x0, least(ay, 120) - 12 AS y0, greatest(bx, 150) + 12 AS x1, greatest(by_, 120) + 12 AS y1 FROM strokes WHERE layer = 'P' AND len <= 60
  UNION ALL SELECT page, id, 'NO_DIMENSION_EVIDENCE', ax - 12, ay - 12, bx + 12, by_ + 12 FROM strokes WHERE layer = 'P' AND len > 48)""")
def crop_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions around failed leaders and around texts without a size."""
    s = strokes(spark, sf_dir).where("layer = 'P'")
    failures = s.where("len <= 60").select(F.col("id").alias("text"), F.lit("COMPETING_PIPES").alias("reason"), F.struct(F.lit(150).alias("x"), F.lit(120).alias("y")).alias("tip"))
    return links.crop_requests(failures, s, s.where("len <= 48").select("id"), 12)


@query(f"""WITH {LABELS}, c AS (SELECT p_partkey, label, i - 1 AS place, substr(label, CAST(i AS INTEGER), 1) AS c FROM labelled, unnest(range(1, length(label) + 1)) u(i)),
  a AS (SELECT p_partkey, label, place, CASE c WHEN '5' THEN 'S' WHEN '1' THEN 'I' WHEN '0' THEN 'O' END AS other, CASE c WHEN '5' THEN 0.5::DOUBLE WHEN '1' THEN 0.7::DOUBLE WHEN '0' THEN 0.9::DOUBLE END AS score FROM c WHERE c IN ('5', '1', '0')),
  one AS (SELECT p_partkey, substr(label, 1, CAST(place AS INTEGER)) || other || substr(label, CAST(place AS INTEGER) + 2) AS text, score, place FROM a),
  two AS (SELECT o.p_partkey, substr(o.text, 1, CAST(a.place AS INTEGER)) || a.other || substr(o.text, CAST(a.place AS INTEGER) + 2) AS text, o.score * a.score AS score FROM one o JOIN a ON a.p_partkey = o.p_partkey AND a.place > o.place),
  every AS (SELECT p_partkey, text, score FROM one UNION ALL SELECT p_partkey, text, score FROM two), ranked AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY round(score, 9) DESC, text) AS rank FROM every)
  SELECT p_partkey, text, round(score, 6) AS score, rank FROM ranked WHERE rank <= 8 UNION ALL SELECT p_partkey, label, 1.0, 0 FROM labelled""")
def alternative_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with one or two characters read otherwise."""
    c = labelled(spark, sf_dir).select("p_partkey", F.posexplode(F.split("label", "")).alias("place", "character")).where("character <> ''")
    pair = lambda a, x, s: F.when(F.col("character") == a, F.array(F.struct(F.lit(a).alias("character"), F.lit(0.95).alias("score")), F.struct(F.lit(x).alias("character"), F.lit(s).alias("score")), F.struct(F.lit("?").alias("character"), F.lit(0.1).alias("score"))))
    none = F.expr("cast(array() as array<struct<character: string, score: double>>)")
    glyphs = c.withColumn("alternatives", F.coalesce(pair("5", "S", 0.5), pair("1", "I", 0.7), pair("0", "O", 0.9), none))
    return links.alternative_readings(glyphs, ["p_partkey"]).select("p_partkey", "text", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {LABELS}, n AS (SELECT p_partkey, p_size % 4 AS cost, 50 * (1 + p_size % 5) AS value FROM labelled) SELECT p_partkey, CAST(value AS DOUBLE) AS value, round(CASE WHEN cost = 0 THEN 0.9 ELSE greatest(0.05, 0.55 * exp(-2.0 * cost)) END, 6) AS weight, CASE WHEN cost = 0 THEN 'ratio' ELSE 'ratio_alternative' END AS source FROM n""")
def ratio_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scales that notes state, with weights by how far the reading is from the text."""
    n = F.col("p_size")
    readings = labelled(spark, sf_dir).select("p_partkey", F.concat(F.lit("SCALE 1:"), 50 * (1 + n % 5)).alias("text"), (n % 4).alias("cost"))
    return links.ratio_hypotheses(readings, ["p_partkey"]).withColumn("weight", F.round("weight", 6))


@query(f"""WITH {STROKES} SELECT id, len AS length FROM strokes WHERE len >= 72 AND layer <> 'F'""")
def single_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long strokes that nothing explains."""
    from inkgrid.operators import pipes as pipes_of

    s = strokes(spark, sf_dir)
    return pipes_of.single_lines(s, s.where("layer = 'F'").select("id"), 72.0).select("id", F.col("len").alias("length"))


@query(f"""WITH {STROKES} SELECT id FROM strokes WHERE layer <> 'F' AND len BETWEEN 30 AND 48""")
def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stroked objects small enough to be parts of letters."""
    s = strokes(spark, sf_dir).withColumn("stroke", F.when(F.col("layer") != "F", F.array(F.lit(0.0))))
    return strokes_of.fragments(s, 2400.0).select("id")


@query("""SELECT 'c' || c_custkey AS start, 'c' || c_custkey AS id, 'n' || c_nationkey AS parent, 'in_nation' AS relation, 1 AS depth, 'customer' AS id_kind, 'nation' AS parent_kind, CASE WHEN c_nationkey % 5 = 0 THEN 'FAR' END AS refused FROM customer
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'r' || n_regionkey, 'in_region', 2, 'nation', 'region', NULL FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def evidence_why(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a customer is where it is: every step back with kinds and refusals, from declared entities and links."""
    from inkgrid.operators import evidence

    t = lambda n: table(spark, sf_dir, n)
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    c = t("customer").select(name("c", "c_custkey").alias("id"), name("n", "c_nationkey").alias("parent"))
    n = t("nation").select(name("n", "n_nationkey").alias("id"), name("r", "n_regionkey").alias("parent"), "n_nationkey")
    r = t("region").select(name("r", "r_regionkey").alias("id"))
    entities = evidence.declare(c, "customer", "id", "id").unionByName(evidence.declare(n, "nation", "id", "id")).unionByName(evidence.declare(r, "region", "id", "id"))
    edges = evidence.link(c, "id", "parent", "in_nation").unionByName(evidence.link(n, "id", "parent", "in_region"))
    refused = evidence.reject(n.where("n_nationkey % 5 = 0").withColumn("reason", F.lit("FAR")), "id", "reason")
    out = evidence.why(entities, edges, refused, c.select("id"))
    return out.select("start", "id", "parent", "relation", "depth", "id_kind", "parent_kind", F.get("refused", F.lit(0)).alias("refused"))
