"""Queries on the stroke lattice: projections, spatial joins, matching, components and the pipe take-off."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkgrid.functions import canon, geo
from inkgrid.functions.geo import Segment
from inkgrid.operators import graph, islands, pipes, spatial
from inkgrid.plans.catalogue import query
from inkgrid.plans.lattice import STROKES, strokes
from inkgrid.session import materialise

S = STROKES
#: Wall pairs: same page and layer, both flat or both upright, 1 to 12 apart, overlap of 55 % of both or more.
PAIRS = S + """, pairs AS (
  SELECT a.id AS u, b.id AS v, a.page, a.layer, a.len AS len_u, b.len AS len_v,
         CASE WHEN a.ay = a.by_ THEN abs(a.ay - b.ay) ELSE abs(a.ax - b.ax) END AS apart,
         CASE WHEN a.ay = a.by_ THEN least(a.bx, b.bx) - greatest(a.ax, b.ax) ELSE least(a.by_, b.by_) - greatest(a.ay, b.ay) END AS shared
  FROM strokes a JOIN strokes b ON a.page = b.page AND a.layer = b.layer AND a.id < b.id AND (a.ay = a.by_) = (b.ay = b.by_)
  WHERE (CASE WHEN a.ay = a.by_ THEN abs(a.ay - b.ay) ELSE abs(a.ax - b.ax) END) BETWEEN 1 AND 12
    AND (CASE WHEN a.ay = a.by_ THEN least(a.bx, b.bx) - greatest(a.ax, b.ax) ELSE least(a.by_, b.by_) - greatest(a.ay, b.ay) END)
        >= 0.55 * greatest(a.len, b.len))"""
TOUCH = S + """, touch AS (
  SELECT a.id AS u, b.id AS v, a.page FROM strokes a JOIN strokes b ON a.page = b.page AND a.id < b.id
  WHERE least((a.ax-b.ax)**2 + (a.ay-b.ay)**2, (a.ax-b.bx)**2 + (a.ay-b.by_)**2, (a.bx-b.ax)**2 + (a.by_-b.ay)**2, (a.bx-b.bx)**2 + (a.by_-b.by_)**2) <= 9)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v, page, layer, apart and shared of every wall pair."""
    found = spatial.parallel(strokes(spark, sf_dir), ["page", "layer"], 12.0, 2.0, 0.55 - 1e-9, least=1.0)
    shared = F.round(geo.overlap(Segment.of("l_"), Segment.of("r_"))).cast("long")
    return found.select(F.col("l_id").alias("u"), F.col("r_id").alias("v"), F.col("l_page").alias("page"), F.col("l_layer").alias("layer"), F.round("apart").cast("long").alias("apart"), shared.alias("shared"))


def touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.touching(strokes(spark, sf_dir), ["page"], 3.0).select(F.col("l_id").alias("u"), F.col("r_id").alias("v"), F.col("l_page").alias("page"))


@query(f"WITH {S} SELECT id, page, ax, ay, bx, by_ AS \"by\", len AS length, CASE WHEN ay = by_ THEN 0 ELSE 90 END AS angle FROM strokes")
def segment_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strokes as two-point polylines, exploded into segments with length and angle."""
    s = strokes(spark, sf_dir)
    points = F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))
    out = s.select("id", "page", F.inline(geo.edges(points)))
    seg = Segment.of()
    return out.select("id", "page", "ax", "ay", "bx", "by", F.round(seg.length).cast("long").alias("length"), F.round(geo.degrees(seg)).cast("int").alias("angle"))


@query(f"WITH {S} SELECT page, layer, min(ax) AS x0, min(ay) AS y0, max(bx) AS x1, max(by_) AS y1, count(*) AS n FROM strokes GROUP BY page, layer")
def bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around each layer of a page."""
    return strokes(spark, sf_dir).groupBy("page", "layer").agg(*geo.box_union(), F.count(F.lit(1)).alias("n"))


@query(f"WITH {S} SELECT custkey, count(*) AS n, CAST(sum(len) AS BIGINT) AS ink FROM strokes GROUP BY custkey")
def polyline_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink per customer, from the lengths of polylines."""
    points = F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))
    lengths = strokes(spark, sf_dir).select("custkey", F.round(geo.polyline_length(points)).cast("long").alias("ink"))
    return lengths.groupBy("custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("ink").alias("ink"))


@query(f"WITH {S} SELECT page, CASE WHEN ay = by_ THEN 'horizontal' ELSE 'vertical_on_sheet' END AS direction, count(*) AS n FROM strokes GROUP BY 1, 2")
def direction_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))
    return strokes(spark, sf_dir).groupBy("page", geo.direction(points).alias("direction")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS id, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS cents, 'o_' || substr(sha256(o_orderstatus || '|' || o_orderpriority), 1, 12) AS pen_id FROM orders")
def quantise_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantised amounts and content ids."""
    from inkgrid.plans.lattice import table

    key = F.concat_ws("|", "o_orderstatus", "o_orderpriority")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.round(canon.quantise(F.col("o_totalprice"), 2) * 100).cast("long").alias("cents"), F.concat(F.lit("o_"), F.substring(F.sha2(key, 256), 1, 12)).alias("pen_id"))


@query(f"""WITH {S} SELECT page, count(*) AS n, sha256('[' || string_agg('{{"id":' || id || ',"ax":' || ax || ',"ay":' || ay || '}}', ',' ORDER BY id) || ']') AS digest FROM strokes GROUP BY page""")
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each page that doesn't depend on the order of rows."""
    return strokes(spark, sf_dir).groupBy("page").agg(F.count(F.lit(1)).alias("n"), canon.digest("id", "ax", "ay").alias("digest"))


@query(f"WITH {S} SELECT id, page FROM strokes WHERE ax <= 160 AND bx >= 100 AND ay <= 140 AND by_ >= 80")
def region_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.in_region(strokes(spark, sf_dir), (100, 80, 160, 140)).select("id", "page")


@query(f"""WITH {S} SELECT id, page, round(sqrt(d2), 4) AS distance FROM (SELECT id, page,
  (greatest(ax - 150, 0, 150 - bx))**2 + (greatest(ay - 120, 0, 120 - by_))**2 AS d2 FROM strokes) WHERE d2 <= 900""")
def near_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.near_point(strokes(spark, sf_dir), 150.0, 120.0, 30.0).select("id", "page", F.round("distance", 4).alias("distance"))


@query(f"""WITH {S}, gaps AS (SELECT a.id AS probe, b.id, (greatest(b.ax - a.bx, 0, a.ax - b.bx))**2 + (greatest(b.ay - a.by_, 0, a.ay - b.by_))**2 AS d2
  FROM strokes a JOIN strokes b ON a.page = b.page AND a.id <> b.id WHERE a.id % 20 = 0)
  SELECT probe, id, place FROM (SELECT probe, id, d2, row_number() OVER (PARTITION BY probe ORDER BY d2, id) AS place FROM gaps) WHERE place <= 3""")
def k_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three strokes nearest to every twentieth one (a stated set of probes), however far off."""
    s = strokes(spark, sf_dir)
    near = spatial.k_nearest(s.where("id % 20 = 0"), s, ["page"], 3, 8.0, others=True)
    return near.select(F.col("l_id").alias("probe"), F.col("r_id").alias("id"), "place")


@query(f"WITH {S} SELECT id, page, len AS length FROM strokes WHERE len >= 60 AND ax = bx AND pen = '1-URGENT'")
def geometry_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upright strokes of 60 or more drawn with one pen."""
    seg = Segment.of()
    upright = geo.angle_between(geo.degrees(seg), F.lit(90.0), 180) <= 2
    return strokes(spark, sf_dir).where((seg.length >= 60) & upright & (F.col("pen") == "1-URGENT")).select("id", "page", F.round(seg.length).cast("long").alias("length"))


@query(f"WITH {S} SELECT a.id AS u, b.id AS v FROM strokes a JOIN strokes b ON a.page = b.page AND a.id < b.id AND a.ax <= b.bx AND b.ax <= a.bx AND a.ay <= b.by_ AND b.ay <= a.by_")
def bbox_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = strokes(spark, sf_dir)
    return spatial.grid_join(s, s, ["page"], on=F.col("l_id") < F.col("r_id")).select(F.col("l_id").alias("u"), F.col("r_id").alias("v"))


@query(f"""WITH {S} SELECT a.id AS u, b.id AS v FROM strokes a JOIN strokes b ON a.page = b.page AND a.id < b.id
  AND (greatest(b.ax - a.bx, 0, a.ax - b.bx))**2 + (greatest(b.ay - a.by_, 0, a.ay - b.by_))**2 <= 25""")
def distance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.pairs_within(strokes(spark, sf_dir), ["page"], 5.0).select(F.col("l_id").alias("u"), F.col("r_id").alias("v"))


@query(f"WITH {PAIRS} SELECT u, v, page, layer, apart, shared FROM pairs")
def parallel_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir)


@query(f"""WITH {S} SELECT a.id AS u, b.id AS v FROM strokes a JOIN strokes b ON a.page = b.page AND a.id < b.id
  WHERE (a.ay = a.by_ AND b.ay = b.by_ AND abs(a.ay - b.ay) <= 4 AND greatest(a.ax, b.ax) - least(a.bx, b.bx) <= 24)
     OR (a.ax = a.bx AND b.ax = b.bx AND abs(a.ax - b.ax) <= 4 AND greatest(a.ay, b.ay) - least(a.by_, b.by_) <= 24)""")
def collinear_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.collinear(strokes(spark, sf_dir), ["page"], offset=4.0).select(F.col("l_id").alias("u"), F.col("r_id").alias("v"))


@query(f"WITH {TOUCH} SELECT u, v, page FROM touch")
def connected_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return touch(spark, sf_dir)


@query(f"""WITH {S} SELECT h.id AS flat, v.id AS upright, v.ax AS x, h.ay AS y FROM strokes h JOIN strokes v ON h.page = v.page
  WHERE h.ay = h.by_ AND v.ax = v.bx AND v.ax BETWEEN h.ax AND h.bx AND h.ay BETWEEN v.ay AND v.by_""")
def crossing_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spatial.crossings(strokes(spark, sf_dir), ["page"])
    flat = F.col("l_ay") == F.col("l_by")
    return found.select(F.when(flat, F.col("l_id")).otherwise(F.col("r_id")).alias("flat"), F.when(flat, F.col("r_id")).otherwise(F.col("l_id")).alias("upright"), F.round("at.x").cast("long").alias("x"), F.round("at.y").cast("long").alias("y"))


@query(f"""WITH {TOUCH}, ends AS (SELECT s.id, s.page, s.bx AS x, s.by_ AS y, s.ay = s.by_ AS flat FROM strokes s)
  SELECT e.id AS "from", s.id AS "to" FROM ends e JOIN strokes s ON e.page = s.page AND e.flat = (s.ay = s.by_)
  WHERE (e.flat AND ((s.ax > e.x AND (s.ax-e.x)**2 + (s.ay-e.y)**2 <= 1600) OR (s.bx > e.x AND (s.bx-e.x)**2 + (s.by_-e.y)**2 <= 1600)))
     OR (NOT e.flat AND ((s.ay > e.y AND (s.ax-e.x)**2 + (s.ay-e.y)**2 <= 1600) OR (s.by_ > e.y AND (s.bx-e.x)**2 + (s.by_-e.y)**2 <= 1600)))""")
def continuation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strokes that go on from the far end of each stroke."""
    s = strokes(spark, sf_dir)
    ends = s.select("id", "page", F.col("bx").alias("x"), F.col("by").alias("y"), F.when(F.col("ay") == F.col("by"), 0.0).otherwise(90.0).alias("heading"))
    found = spatial.continuing(ends, s, ["page"])
    step = lambda p: F.when(F.col("l_heading") == 0, F.col(f"r_{p}x") - F.col("l_x")).otherwise(F.col(f"r_{p}y") - F.col("l_y"))
    near = lambda p: (F.col(f"r_{p}x") - F.col("l_x")) ** 2 + (F.col(f"r_{p}y") - F.col("l_y")) ** 2 <= 1600
    exact = ((step("a") > 0) & near("a")) | ((step("b") > 0) & near("b"))  # integers decide where the heading's cosine is not quite 0
    return found.where(exact).select(F.col("l_id").alias("from"), F.col("r_id").alias("to"))


BEST = PAIRS + """, ends AS (SELECT u AS n, v AS m, apart FROM pairs UNION ALL SELECT v, u, apart FROM pairs),
  ranked AS (SELECT n, m, apart, row_number() OVER w AS place, lead(apart) OVER w AS next FROM ends WINDOW w AS (PARTITION BY n ORDER BY apart, m))"""


@query(f"WITH {BEST}, best AS (SELECT n, m FROM ranked WHERE place = 1 AND (next IS NULL OR next > apart)) SELECT p.u, p.v, p.apart FROM pairs p JOIN best a ON a.n = p.u AND a.m = p.v JOIN best b ON b.n = p.v AND b.m = p.u")
def mutual_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of walls that are each other's only nearest."""
    return graph.mutual_best(pairs(spark, sf_dir), "apart").select("u", "v", "apart")


@query(f"WITH {BEST} SELECT n AS id, apart, next = apart AS tied FROM ranked WHERE place = 1 AND next IS NOT NULL")
def tie_refusal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For walls with two partners or more: whether the nearest is refused for a tie."""
    p = materialise(pairs(spark, sf_dir), "pairs")
    ends = p.select(F.col("u").alias("n"), F.col("v").alias("m"), "apart").unionByName(p.select(F.col("v").alias("n"), F.col("u").alias("m"), "apart"))
    w = Window.partitionBy("n").orderBy("apart", "m")
    ranked = ends.withColumns({"place": F.row_number().over(w), "next": F.lead("apart").over(w)})
    return ranked.where("place = 1 and next is not null").select(F.col("n").alias("id"), "apart", (F.col("next") == F.col("apart")).alias("tied"))


@query()
def greedy_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wall pairs in the order of a greedy pass: most shared, then nearest, then ids."""
    order = [(-F.col("shared")).alias("a"), F.col("apart").alias("b"), F.col("u").alias("c"), F.col("v").alias("d")]
    return graph.matching(pairs(spark, sf_dir), order).select("u", "v", "shared", "apart")


BOXES = "boxes AS (SELECT o_orderkey AS id, o_orderkey // 200 AS page, (o_orderkey * 37) % 300 AS x0, (o_orderkey * 53) % 240 AS y0, (o_orderkey * 37) % 300 + 10 + o_orderkey % 90 AS x1, (o_orderkey * 53) % 240 + 10 + o_orderkey % 70 AS y1 FROM orders)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    s = strokes(spark, sf_dir).select("id", "page", F.col("ax").alias("x0"), F.col("ay").alias("y0"))
    return s.withColumns({"x1": F.col("x0") + 10 + k % 90, "y1": F.col("y0") + 10 + k % 70})


@query(f"WITH {S}, {BOXES} SELECT b.id AS panel, count(*) AS n FROM boxes b JOIN strokes s ON b.page = s.page AND b.x0 <= s.ax AND s.bx <= b.x1 AND b.y0 <= s.ay AND s.by_ <= b.y1 GROUP BY b.id HAVING count(*) >= 2")
def containment_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that hold two strokes or more."""
    held = spatial.containment(boxes(spark, sf_dir), strokes(spark, sf_dir), ["page"])
    return held.groupBy(F.col("l_id").alias("panel")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query(f"WITH {BOXES} SELECT id, page FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM boxes c WHERE c.page = b.page AND c.id <> b.id AND (c.x1-c.x0)*(c.y1-c.y0) < (b.x1-b.x0)*(b.y1-b.y0) AND b.x0 <= c.x0 AND c.x1 <= b.x1 AND b.y0 <= c.y0 AND c.y1 <= b.y1)")
def nested_panel_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes without a smaller box inside."""
    return spatial.innermost(boxes(spark, sf_dir), ["page"]).select("id", "page")


COMPONENTS = """, both_ways AS (SELECT u, v FROM {edges} UNION ALL SELECT v, u FROM {edges}),
  reach(n, m) AS (SELECT id, id FROM {nodes} UNION SELECT r.n, b.v FROM reach r JOIN both_ways b ON r.m = b.u),
  comp AS (SELECT n AS id, min(m) AS root FROM reach GROUP BY n)"""


@query(f"WITH RECURSIVE {PAIRS}{COMPONENTS.format(edges='pairs', nodes='strokes')} SELECT id, root FROM comp")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of walls by pairing."""
    return graph.labelled(strokes(spark, sf_dir).select("id"), pairs(spark, sf_dir)).select("id", "root")


STACKED = S + """, stacked AS (SELECT a.id AS u, b.id AS v FROM strokes a JOIN strokes b ON a.page = b.page AND a.layer = b.layer AND a.id < b.id
  AND a.ay = a.by_ AND b.ay = b.by_ AND abs(a.ay - b.ay) BETWEEN 1 AND 6 AND least(a.bx, b.bx) - greatest(a.ax, b.ax) >= 0.35 * least(a.len, b.len))"""


@query(f"WITH RECURSIVE {STACKED}{COMPONENTS.format(edges='stacked', nodes='strokes')} SELECT root AS block, count(*) AS n, min(s.ax) AS x0, min(s.ay) AS y0, max(s.bx) AS x1, max(s.by_) AS y1 FROM comp JOIN strokes s USING (id) GROUP BY root HAVING count(*) > 1")
def label_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacked flat strokes as blocks, with their boxes."""
    s = strokes(spark, sf_dir)
    flat = s.where("ay = by")
    share = F.least("l_bx", "r_bx") - F.greatest("l_ax", "r_ax") >= 0.35 * F.least("l_len", "r_len")
    rows = spatial.grid_join(flat, flat, ["page", "layer"], 6.0, on=(F.col("l_id") < F.col("r_id")) & F.abs(F.col("l_ay") - F.col("r_ay")).between(1, 6) & share)
    named = graph.labelled(s, rows.select(F.col("l_id").alias("u"), F.col("r_id").alias("v")))
    return named.groupBy(F.col("root").alias("block")).agg(F.count(F.lit(1)).alias("n"), *geo.box_union()).where("n > 1")


@query(f"""WITH RECURSIVE {PAIRS}, runs AS (SELECT u AS id, page, layer, apart AS width, shared AS length FROM {{mutual}}),
  meets AS (SELECT a.id AS u, b.id AS v FROM runs a JOIN runs b ON a.page = b.page AND a.layer = b.layer AND a.width = b.width AND a.id < b.id
    JOIN strokes s ON s.id = a.id JOIN strokes t ON t.id = b.id
    WHERE least((s.ax-t.ax)**2 + (s.ay-t.ay)**2, (s.ax-t.bx)**2 + (s.ay-t.by_)**2, (s.bx-t.ax)**2 + (s.by_-t.ay)**2, (s.bx-t.bx)**2 + (s.by_-t.by_)**2) <= 400){COMPONENTS.format(edges='meets', nodes='runs')}
  SELECT root AS pipe, min(page) AS page, min(layer) AS layer, min(width) AS width, count(*) AS n_runs, CAST(sum(length) AS BIGINT) AS length
  FROM comp JOIN runs USING (id) GROUP BY root""".replace("{mutual}", """(SELECT p.* FROM pairs p
    JOIN (SELECT n, m FROM (SELECT n, m, apart, row_number() OVER w AS place, lead(apart) OVER w AS next FROM (SELECT u AS n, v AS m, apart FROM pairs UNION ALL SELECT v, u, apart FROM pairs) WINDOW w AS (PARTITION BY n ORDER BY apart, m)) WHERE place = 1 AND (next IS NULL OR next > apart)) a ON a.n = p.u AND a.m = p.v
    JOIN (SELECT n, m FROM (SELECT n, m, apart, row_number() OVER w AS place, lead(apart) OVER w AS next FROM (SELECT u AS n, v AS m, apart FROM pairs UNION ALL SELECT v, u, apart FROM pairs) WINDOW w AS (PARTITION BY n ORDER BY apart, m)) WHERE place = 1 AND (next IS NULL OR next > apart)) b ON b.n = p.v AND b.m = p.u)"""))
def physical_pipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strokes, their mutual wall pairs as runs, and runs of one width that meet as pipes with their lengths."""
    runs = materialise(graph.mutual_best(pairs(spark, sf_dir), "apart"), "runs").select(F.col("u").alias("id"), "page", "layer", F.col("apart").alias("width"), F.col("shared").alias("length"))
    placed = runs.join(strokes(spark, sf_dir).drop("page", "layer"), "id")
    meets = spatial.touching(placed, ["page", "layer", "width"], 20.0)
    named = graph.labelled(runs, meets.select(F.col("l_id").alias("u"), F.col("r_id").alias("v")))
    return named.groupBy(F.col("root").alias("pipe")).agg(F.min("page").alias("page"), F.min("layer").alias("layer"), F.min("width").alias("width"), F.count(F.lit(1)).alias("n_runs"), F.sum("length").alias("length"))


@query(f"""WITH {PAIRS} SELECT u, v, round(0.45 * shared / greatest(len_u, len_v) + 0.3 + 0.25 * least(1, (shared / apart) / 6), 6) AS score FROM pairs""")
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of wall pairs by overlap, parallelism and slenderness."""
    found = spatial.parallel(strokes(spark, sf_dir), ["page", "layer"], 12.0, 2.0, 0.55 - 1e-9, least=1.0)
    return found.select(F.col("l_id").alias("u"), F.col("r_id").alias("v"), F.round(pipes.pair_score(F.col("share"), F.col("turn"), geo.overlap(Segment.of("l_"), Segment.of("r_")), F.col("apart")), 6).alias("score"))


@query(f"WITH {S} SELECT page, (ax + bx) // 48 AS cx, (ay + by_) // 48 AS cy, count(*) AS n FROM strokes GROUP BY 1, 2, 3")
def artwork_density_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strokes per cell of 24."""
    return spatial.density(strokes(spark, sf_dir), ["page"])


@query(f"""WITH {S}, d AS (SELECT DISTINCT layer, pen, ay FROM strokes WHERE ay = by_ AND len <= 60), g AS (SELECT layer, pen, ay - lag(ay) OVER (PARTITION BY layer, pen ORDER BY ay) AS gap FROM d)
  SELECT layer, pen, count(*) AS n, round(avg(gap), 4) AS mean_gap, round(stddev_pop(gap) / avg(gap), 4) AS variation FROM g GROUP BY layer, pen HAVING count(*) >= 12 AND stddev_pop(gap) / avg(gap) <= 2.5""")
def hatch_regularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of short flat strokes by how regular their spacing is."""
    flat = strokes(spark, sf_dir).where("ay = by and len <= 60")
    out = islands.regular(flat, ["layer", "pen"], "ay", 12, 2.5)
    return out.select("layer", "pen", "n", F.round("mean_gap", 4).alias("mean_gap"), F.round("variation", 4).alias("variation"))


@query(f"""WITH {S}, a AS (SELECT page, ay, ax, bx, id, max(bx) OVER (PARTITION BY page, ay ORDER BY ax, bx, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM strokes WHERE ay = by_),
  b AS (SELECT *, sum(CASE WHEN ax - reach > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY page, ay ORDER BY ax, bx, id) AS island FROM a)
  SELECT page, ay, CAST(island AS BIGINT) AS island, min(ax) AS x0, max(bx) AS x1, count(*) AS n FROM b GROUP BY page, ay, island""")
def gap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat strokes of a row joined where gaps are 10 or less."""
    flat = strokes(spark, sf_dir).where("ay = by")
    out = islands.islands(flat, ["page", "ay"], "ax", "bx", F.lit(10), ["ax", "bx", "id"])
    return out.groupBy("page", "ay", "island").agg(F.min("ax").alias("x0"), F.max("bx").alias("x1"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {S} SELECT kind, id, page FROM (
  SELECT 'region' AS kind, id, page FROM strokes WHERE ax <= 160 AND bx >= 100 AND ay <= 140 AND by_ >= 80
  UNION SELECT 'long' AS kind, id, page FROM strokes WHERE len >= 84) ORDER BY kind, page, id LIMIT 40""")
def hit_union_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of two searches, deduplicated, ordered and limited to 40 as a report."""
    s = strokes(spark, sf_dir)
    region = spatial.in_region(s, (100, 80, 160, 140)).select(F.lit("region").alias("kind"), "id", "page")
    long_ = s.where("len >= 84").select(F.lit("long").alias("kind"), "id", "page")
    return region.unionByName(long_).distinct().orderBy("kind", "page", "id").limit(40)


@query(f"""WITH {S} SELECT layer, page, count(*) AS n, GROUPING(layer) AS g_layer, GROUPING(page) AS g_page FROM strokes GROUP BY GROUPING SETS ((layer), (page, layer), ())""")
def inventory_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects by layer, by page and layer, and in all."""
    s = strokes(spark, sf_dir)
    out = s.groupingSets([[F.col("layer")], [F.col("page"), F.col("layer")], []], F.col("layer"), F.col("page"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.grouping("layer").cast("long").alias("g_layer"), F.grouping("page").cast("long").alias("g_page"))


@query(f"""WITH {PAIRS}, direct AS (SELECT page, count(*) AS n FROM strokes GROUP BY page), split AS (SELECT page, count(*) AS n FROM (SELECT id, page FROM strokes WHERE ay = by_ UNION ALL SELECT id, page FROM strokes WHERE ax = bx) GROUP BY page)
  SELECT coalesce(d.page, s.page) AS page, d.n AS reported, s.n AS modelled, d.n - s.n AS delta FROM direct d FULL JOIN split s ON d.page = s.page""")
def conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported and modelled objects of each page; their difference must be 0."""
    s = strokes(spark, sf_dir)
    direct = s.groupBy("page").agg(F.count(F.lit(1)).alias("reported"))
    split = s.where("ay = by").unionByName(s.where("ax = bx")).groupBy("page").agg(F.count(F.lit(1)).alias("modelled"))
    return direct.join(split, "page", "full").withColumn("delta", F.col("reported") - F.col("modelled"))
