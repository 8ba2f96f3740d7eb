"""Reports: histograms, coverage, tiers, attestation, status, nodes and tees of the lattice, and small parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrid.functions import geo, tokens
from inkgrid.functions.geo import Segment
from inkgrid.operators import aggregates, decisions, graph, pipes, spatial, strokes as stroke_ops
from inkgrid.plans.catalogue import query
from inkgrid.plans.lattice import LABELS, STROKES, labelled, strokes, table
from inkgrid.plans.relational import PIPES
from inkgrid.plans.relational import pipes as pipe_rows

S = STROKES


@query("SELECT key, n FROM (SELECT p_type AS key, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, key LIMIT 40)")
def histogram_top40(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 most frequent part types: the limit is the report."""
    return aggregates.histogram(table(spark, sf_dir, "part"), "p_type")


@query(f"WITH {S} SELECT page, CASE WHEN ay = by_ THEN 0.0::DOUBLE ELSE 90.0::DOUBLE END AS bucket, count(*) AS n FROM strokes GROUP BY 1, 2")
def angle_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = strokes(spark, sf_dir).withColumn("bucket", F.floor(geo.degrees(Segment.of()) / 5) * 5.0)
    return s.groupBy("page", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {S} SELECT pen, len AS stroke_width, count(*) AS n FROM strokes GROUP BY pen, len")
def stroke_width_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strokes(spark, sf_dir).groupBy("pen", F.col("len").alias("stroke_width")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PIPES} SELECT nominal, count(*) AS pipes, count(*) FILTER (state = 'CONFIRMED') AS confirmed, count(*) FILTER (state = 'AMBIGUOUS') AS ambiguous,
  count(DISTINCT designation) AS designations, count(*) FILTER (vertical IS NULL) AS unmeasured, round(avg(vertical), 6) AS mean_vertical FROM pipes GROUP BY nominal""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by state, distinct designations and the mean of what is present."""
    return pipe_rows(spark, sf_dir).groupBy("nominal").agg(
        F.count(F.lit(1)).alias("pipes"), F.count_if(F.col("state") == "CONFIRMED").alias("confirmed"), F.count_if(F.col("state") == "AMBIGUOUS").alias("ambiguous"),
        F.count_distinct("designation").alias("designations"), F.count_if(F.col("vertical").isNull()).alias("unmeasured"), F.round(F.avg("vertical"), 6).alias("mean_vertical"),
    )


@query("SELECT tier, count(l_orderkey) AS n FROM (VALUES ('A'), ('N'), ('R'), ('X')) t(tier) LEFT JOIN lineitem ON l_returnflag = tier GROUP BY tier")
def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by tier, those without rows too."""
    tiers = spark.createDataFrame([(t,) for t in "ANRX"], "tier string")
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("tier")).agg(F.count("l_orderkey").alias("n"))
    return tiers.join(counts, "tier", "left").na.fill(0, ["n"])


@query(f"""WITH {PIPES} SELECT designation, nominal AS diameter, CAST(coalesce(sum(horizontal), 0) AS BIGINT) AS horizontal_m, CAST(coalesce(sum(vertical), 0) AS BIGINT) AS vertical_m, count(*) AS n_pipes FROM pipes GROUP BY designation, nominal""")
def measured_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule that skips nulls."""
    rows = pipe_rows(spark, sf_dir).select("designation", F.col("nominal").alias("diameter"), F.col("horizontal").alias("horizontal_m"), F.col("vertical").alias("vertical_m"))
    out = aggregates.measured_quantities(rows)
    return out.select("designation", "diameter", F.col("horizontal_m").cast("long").alias("horizontal_m"), F.col("vertical_m").cast("long").alias("vertical_m"), "n_pipes")


@query(f"WITH {PIPES} SELECT state, count(*) AS n, CAST(min(horizontal) AS BIGINT) AS least, CAST(max(horizontal) AS BIGINT) AS most FROM pipes GROUP BY state")
def pipes_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipe_rows(spark, sf_dir).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.min("horizontal").alias("least"), F.max("horizontal").alias("most"))


@query(f"""WITH {S}, c AS (SELECT pen, count(*) AS hits FROM strokes WHERE layer = 'F' GROUP BY pen) SELECT pen, hits, round(hits / (SELECT sum(hits) FROM c), 6) AS share FROM c WHERE hits / (SELECT sum(hits) FROM c) >= 0.10""")
def attested_pens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.attested(strokes(spark, sf_dir).where("layer = 'F'"), "pen", 1, 0.10).select("pen", "hits", F.round("share", 6).alias("share"))


@query("""SELECT o_orderpriority AS sheet, CASE WHEN bool_or(o_totalprice < 0) THEN 'INVALID' WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'INCOMPLETE' ELSE 'VALID' END AS status FROM orders GROUP BY 1""")
def analysis_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("sheet"))
    checks = o.agg(F.bool_and(F.col("o_totalprice") >= 0).alias("reconciled"), F.bool_and(F.col("o_orderstatus") != "P").alias("measured"))
    return checks.select("sheet", aggregates.status(F.col("reconciled"), F.lit(True), F.col("measured")).alias("status"))


@query(f"""WITH {S}, e AS (SELECT page, ax AS x, ay AS y FROM strokes UNION ALL SELECT page, bx, by_ FROM strokes)
  SELECT page, x, y, count(*) AS degree, CASE count(*) WHEN 1 THEN 'end' WHEN 2 THEN 'joint' WHEN 3 THEN 'tee' ELSE 'cross' END AS kind FROM e GROUP BY page, x, y""")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the stroke graph with their degree."""
    s = strokes(spark, sf_dir).withColumn("edge", F.col("id"))
    found, _ = pipes.nodes(s.select("edge", "page", "ax", "ay", "bx", "by"), ["page"], 0.4)
    return found.select("page", F.round("x").cast("long").alias("x"), F.round("y").cast("long").alias("y"), "degree", "kind")


@query(f"""WITH {S}, e AS (SELECT id, page, ax AS x, ay AS y FROM strokes UNION ALL SELECT id, page, bx, by_ FROM strokes),
  hit AS (SELECT DISTINCT s.id, CASE WHEN s.ay = s.by_ THEN e.x ELSE e.y END AS place FROM strokes s JOIN e ON e.page = s.page AND e.id <> s.id
    WHERE (s.ay = s.by_ AND abs(e.y - s.ay) <= 4 AND e.x > s.ax + 4 AND e.x < s.bx - 4) OR (s.ax = s.bx AND abs(e.x - s.ax) <= 4 AND e.y > s.ay + 4 AND e.y < s.by_ - 4))
  SELECT id, count(*) AS cuts FROM hit GROUP BY id""")
def tee_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often other strokes' ends cut each stroke."""
    cuts = pipes.tee_cuts(strokes(spark, sf_dir).select("id", "page", "ax", "ay", "bx", "by"), ["page"], 4.0)
    return cuts.select("id", F.size("cuts").cast("long").alias("cuts"))


@query(f"""WITH {S}, near AS (SELECT a.id AS u, b.id AS v FROM strokes a JOIN strokes b ON a.page = b.page AND a.layer = b.layer AND a.id < b.id
    WHERE (greatest(b.ax - a.bx, 0, a.ax - b.bx))**2 + (greatest(b.ay - a.by_, 0, a.ay - b.by_))**2 <= 9),
  linked AS (SELECT u AS id FROM near UNION SELECT v FROM near)
  SELECT layer, round(avg(CASE WHEN l.id IS NULL THEN 0 ELSE 1 END), 6) AS chain FROM strokes s LEFT JOIN linked l ON l.id = s.id GROUP BY layer""")
def chain_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each layer's strokes with another one within 3."""
    s = strokes(spark, sf_dir)
    near = spatial.pairs_within(s, ["page", "layer"], 3.0)
    linked = near.select(F.explode(F.array("l_id", "r_id")).alias("id")).distinct().withColumn("linked", F.lit(1))
    return s.join(linked, "id", "left").groupBy("layer").agg(F.round(F.avg(F.coalesce("linked", F.lit(0))), 6).alias("chain"))


@query(f"""WITH {S}, g AS (SELECT a.id AS u, b.id AS v, CASE WHEN a.ay = a.by_ THEN greatest(b.ax - a.bx, a.ax - b.bx) ELSE greatest(b.ay - a.by_, a.ay - b.by_) END AS ahead, CASE WHEN a.ay = a.by_ THEN abs(a.ay - b.ay) ELSE abs(a.ax - b.ax) END AS aside
    FROM strokes a JOIN strokes b ON a.page = b.page AND a.id < b.id AND (a.ay = a.by_) = (b.ay = b.by_))
  SELECT u, v, CAST(round(sqrt(ahead * ahead + aside * aside)) AS BIGINT) AS gap FROM g WHERE ahead >= 1 AND aside <= 4 AND ahead * ahead + aside * aside <= 1600""")
def aligned_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of strokes that face each other along one line, with their gap."""
    out = stroke_ops.aligned_gaps(strokes(spark, sf_dir), ["page"], 40.0, offset=4.0 + 1e-6)
    return out.select(F.col("l_stroke").alias("u"), F.col("r_stroke").alias("v"), F.round("gap").cast("long").alias("gap"))


@query(f"WITH {LABELS} SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'dn' WHEN 1 THEN 'box' WHEN 2 THEN 'pair' ELSE NULL END AS rule, CASE WHEN p_partkey % 4 < 3 THEN CAST(p_size * 10 AS DOUBLE) END AS mm FROM labelled")
def dimension_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes stated in words of several forms."""
    size = (F.col("p_size") * 10).cast("string")
    k = F.col("p_partkey") % 4
    word = F.when(k == 0, F.concat(F.lit("DN"), size)).when(k == 1, F.concat(size, F.lit("x20"))).when(k == 2, F.concat(F.lit("DN"), size, F.lit("/5"))).otherwise(F.col("label"))
    out = labelled(spark, sf_dir).select("p_partkey", tokens.dimension(word).alias("d"))
    return out.select("p_partkey", "d.rule", "d.mm")


@query("SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS whole, lower(regexp_replace(c_name, '[^A-Za-z0-9]+', '-', 'g')) || '-' || substr(sha256(c_name), 1, 16) AS job FROM customer")
def job_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with decimal commas read back, and ids made of names."""
    c = table(spark, sf_dir, "customer")
    comma = F.replace(c.c_acctbal.cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(","))
    return c.select("c_custkey", F.floor(tokens.number(comma)).alias("whole"), F.concat_ws("-", tokens.slug(F.col("c_name")), F.substring(F.sha2("c_name", 256), 1, 16)).alias("job"))


@query("""WITH a AS (SELECT o_custkey AS leader, o_orderkey AS run, CAST(floor(o_totalprice / 1000) AS BIGINT) AS d FROM orders), r AS (SELECT *, row_number() OVER w AS place, lead(d) OVER w AS next FROM a WHERE d <= 300 WINDOW w AS (PARTITION BY leader ORDER BY d, run))
  SELECT c_custkey AS leader, CASE WHEN r.run IS NULL THEN 'LEADER_ENDS_NOWHERE' WHEN next - d < 0.75 THEN 'COMPETING_PIPES' END AS reason, CASE WHEN next IS NULL OR next - d >= 0.75 THEN r.run END AS run FROM customer LEFT JOIN (SELECT * FROM r WHERE place = 1) r ON leader = c_custkey""")
def association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of several targets within reach, refused for a tie."""
    distances = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("leader"), F.col("o_orderkey").alias("run"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("distance"))
    leaders = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("leader"), F.col("c_name").alias("text"))
    return decisions.associate(leaders, distances, 300.0).select("leader", "reason", "run")


@query("""WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS u, 'r' || n_regionkey AS v FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer), w(start, node, hops) AS (SELECT 'c' || c_custkey, 'c' || c_custkey, 0 FROM customer UNION ALL SELECT w.start, e.v, hops + 1 FROM w JOIN e ON e.u = w.node)
  SELECT start, arg_max(node, hops) AS "last", max(hops) AS hops FROM w GROUP BY start""")
def trace_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks along the only link onward, from customers to regions."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n = table(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("u"), name("r", "n_regionkey").alias("v"))
    c = table(spark, sf_dir, "customer").select(name("c", "c_custkey").alias("u"), name("n", "c_nationkey").alias("v"))
    out = graph.walk(c.select(F.col("u").alias("start"), F.col("u").alias("node")), n.unionByName(c))
    return out.select("start", F.element_at("path", -1).alias("last"), (F.size("path") - 1).alias("hops"))
