"""Queries on the star tables: aggregation rules, ranking, dedupe, lineage, evaluation and the job log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrid.functions import canon, states
from inkgrid.operators import aggregates, graph, islands
from inkgrid.operators import strokes as strokes_of
from inkgrid.operators.pipes import collapse_concentric, collapse_exact
from inkgrid.operators.strokes import like_signatures
from inkgrid.plans.catalogue import query
from inkgrid.plans.lattice import LABELS, STROKES, labelled, strokes, table

PIPES = LABELS + """, pipes AS (SELECT l.label AS designation, p_size AS nominal, CAST(l_quantity AS BIGINT) AS horizontal, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_linenumber END AS vertical,
  CASE WHEN l_returnflag = 'A' THEN 'AMBIGUOUS' WHEN l_returnflag = 'R' THEN 'CONFIRMED' ELSE 'HIGH_CONFIDENCE' END AS state FROM lineitem JOIN labelled l ON p_partkey = l_partkey)"""


def pipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as pipes: designation and nominal size of the part, whole lengths, some without vertical."""
    items = table(spark, sf_dir, "lineitem").join(labelled(spark, sf_dir), F.col("p_partkey") == F.col("l_partkey"))
    state = F.when(F.col("l_returnflag") == "A", "AMBIGUOUS").when(F.col("l_returnflag") == "R", "CONFIRMED").otherwise("HIGH_CONFIDENCE")
    vertical = F.when(F.col("l_linenumber") % 4 != 0, F.col("l_linenumber").cast("long"))
    return items.select(F.col("label").alias("designation"), F.col("p_size").alias("nominal"), F.col("l_quantity").cast("long").alias("horizontal"), vertical.alias("vertical"), state.alias("state"))


@query(f"""WITH {PIPES} SELECT designation, nominal, CAST(sum(horizontal) AS BIGINT) AS horizontal_m, CAST(sum(vertical) AS BIGINT) AS vertical_m,
  CASE WHEN count(vertical) = count(*) THEN CAST(sum(horizontal + vertical) AS BIGINT) END AS total_m, count(*) AS n_pipes,
  CASE max(CASE state WHEN 'CONFIRMED' THEN 1 WHEN 'HIGH_CONFIDENCE' THEN 2 ELSE 3 END) WHEN 1 THEN 'CONFIRMED' WHEN 2 THEN 'HIGH_CONFIDENCE' ELSE 'AMBIGUOUS' END AS state
  FROM pipes GROUP BY designation, nominal""")
def quantity_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pipes(spark, sf_dir).select(
        "designation", "nominal", F.col("nominal").alias("diameter"), F.col("horizontal").alias("horizontal_m"), F.col("vertical").alias("vertical_m"), (F.col("horizontal") + F.col("vertical")).alias("total_m"),
        "state", F.expr("cast(array() as array<string>)").alias("reasons"), F.lit(1.0).alias("confidence"),
    )
    return aggregates.quantities(rows).select("designation", "nominal", "horizontal_m", "vertical_m", "total_m", "n_pipes", "state")


@query(f"WITH {PIPES} SELECT coalesce(CASE WHEN nominal % 5 = 0 THEN NULL ELSE designation END, '(unresolved)') AS designation, CAST(sum(coalesce(horizontal + vertical, 0)) AS BIGINT) AS total, count(*) AS n FROM pipes GROUP BY 1")
def totals_by_designation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pipes(spark, sf_dir).select(F.when(F.col("nominal") % 5 != 0, F.col("designation")).alias("designation"), (F.col("horizontal") + F.col("vertical")).alias("total_m"))
    return aggregates.totals(rows).select("designation", F.col("total").cast("long").alias("total"), "n")


@query(f"WITH {PIPES} SELECT nominal, CASE max(CASE state WHEN 'CONFIRMED' THEN 1 WHEN 'HIGH_CONFIDENCE' THEN 2 ELSE 3 END) WHEN 1 THEN 'CONFIRMED' WHEN 2 THEN 'HIGH_CONFIDENCE' ELSE 'AMBIGUOUS' END AS state FROM pipes GROUP BY nominal")
def worst_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipes(spark, sf_dir).groupBy("nominal").agg(states.worst(F.col("state")).alias("state"))


@query("SELECT l_suppkey, CASE WHEN count(v) = count(*) THEN CAST(sum(v) AS BIGINT) END AS strict, CAST(sum(v) AS BIGINT) AS loose FROM (SELECT l_suppkey, CASE WHEN l_quantity < 50 THEN CAST(l_quantity AS BIGINT) END AS v FROM lineitem) GROUP BY l_suppkey")
def null_propagating_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.when(F.col("l_quantity") < 50, F.col("l_quantity").cast("long")).alias("v"))
    return rows.groupBy("l_suppkey").agg(states.strict_sum(F.col("v")).alias("strict"), F.sum("v").alias("loose"))


@query(f"""WITH {STROKES}, m AS (SELECT layer, list_sort(list(len)) AS l FROM strokes GROUP BY layer)
  SELECT s.layer, count(*) AS n, any_value(m.l[len(m.l) // 2 + 1]) AS median_extent, round(avg(CASE WHEN ay = by_ THEN 1 ELSE 0 END), 6) AS closed, round(avg(CASE WHEN s.len >= 80 THEN 1 ELSE 0 END), 6) AS long, round(max(s.len) / 300.0, 6) AS span
  FROM strokes s JOIN m ON m.layer = s.layer GROUP BY s.layer""")
def layer_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = strokes(spark, sf_dir).select("layer", F.col("len").alias("extent"), (F.col("ay") == F.col("by")).alias("closed"), F.lit(False).alias("filled"), F.lit(False).alias("text"), F.lit(False).alias("dashed"), F.lit(None).cast("string").alias("dash"))
    out = aggregates.layer_signatures(s, 10.0, 300.0, [])
    return out.select("layer", "n", F.col("median_extent").cast("long").alias("median_extent"), F.round("closed", 6).alias("closed"), F.round("long", 6).alias("long"), F.round("span", 6).alias("span"))


@query(f"WITH {STROKES}, c AS (SELECT layer, count(*) AS hits FROM strokes WHERE len >= 60 GROUP BY layer) SELECT layer, hits, round(hits / sum(hits) OVER (), 6) AS share FROM c QUALIFY hits >= 3 AND hits / sum(hits) OVER () >= 0.05")
def attested_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.attested(strokes(spark, sf_dir).where("len >= 60"), "layer").select("layer", "hits", F.round("share", 6).alias("share"))


@query(f"WITH {STROKES}, m AS (SELECT pen, list_sort(list(len)) AS l FROM strokes GROUP BY pen) SELECT pen, l[len(l) // 2 + 1] AS median FROM m")
def upper_median_pen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strokes(spark, sf_dir).groupBy("pen").agg(islands.upper_median("len").cast("long").alias("median"))


@query("SELECT l_suppkey, bin AS cap_height FROM (SELECT l_suppkey, bin, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, bin) AS place FROM (SELECT l_suppkey, floor(l_quantity / 0.25 + 0.5) * 0.25 AS bin FROM lineitem WHERE l_quantity >= 1.2) GROUP BY l_suppkey, bin) WHERE place = 1")
def cap_height_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.cap_height(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity")


LINES = """lines AS (SELECT id, layer, ax, ay, ax + 30 AS bx, ay AS by_, pen AS style, len AS width, custkey FROM strokes)"""


def centrelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strokes as candidates of one length, so that some lie on each other."""
    s = strokes(spark, sf_dir)
    return s.select("layer", "ax", "ay", (F.col("ax") + 30).alias("bx"), F.col("ay").alias("by"), F.col("id").alias("candidate_id"), F.col("pen").alias("style"), F.col("len").alias("width"), F.array("custkey").alias("sources"))


@query(f"""WITH {STROKES}, {LINES} SELECT layer, ax, ay, style, width, min(id) AS id, array_to_string(list_sort(list_distinct(list(custkey))), ',') AS sources, count(*) AS instances FROM lines GROUP BY layer, ax, ay, style, width""")
def exact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = collapse_exact(centrelines(spark, sf_dir), ["layer"])
    return out.select("layer", "ax", "ay", "style", "width", F.col("candidate_id").alias("id"), F.array_join(F.col("all_sources").cast("array<string>"), ",").alias("sources"), "instances")


@query(f"""WITH {STROKES}, {LINES}, named AS (SELECT *, CASE style WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END AS kind FROM lines)
  SELECT layer, ax, ay, arg_min(id, (kind, width, id)) AS id, min(width) AS least_width, max(width) AS most_width, count(*) AS instances FROM named GROUP BY layer, ax, ay""")
def concentric_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    style = F.when(F.col("style") == "1-URGENT", "double_line").when(F.col("style") == "2-HIGH", "dashed_line").otherwise("single_line")
    out = collapse_concentric(centrelines(spark, sf_dir).withColumns({"style": style, "width": F.col("width").cast("double")}), ["layer"])
    return out.select("layer", "ax", "ay", F.col("candidate_id").alias("id"), F.col("least_width").cast("long").alias("least_width"), F.col("most_width").cast("long").alias("most_width"), "instances")


@query("""SELECT event_id, 'ev:' || substr(sha1(user_id || '|' || event_type), 1, 12) || ':' || (row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1) AS id FROM events""")
def occurrence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("place", canon.occurrence("user_id", "event_type", order=["event_id"]))
    return e.select("event_id", canon.occurrence_id("ev", F.concat_ws("|", "user_id", "event_type"), F.col("place")).alias("id"))


EDGES = """edges AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent, 'in_region' AS relation FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'in_nation' FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'ordered_by' FROM orders)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage of orders, customers, nations and regions."""
    t = lambda n: table(spark, sf_dir, n)
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    a = t("nation").select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent"), F.lit("in_region").alias("relation"))
    b = t("customer").select(name("c", "c_custkey").alias("child"), name("n", "c_nationkey").alias("parent"), F.lit("in_nation").alias("relation"))
    c = t("orders").select(name("o", "o_orderkey").alias("child"), name("c", "o_custkey").alias("parent"), F.lit("ordered_by").alias("relation"))
    return a.unionByName(b).unionByName(c)


@query(f"WITH RECURSIVE {EDGES}, up(start, id, parent, relation, depth) AS (SELECT child, child, parent, relation, 1 FROM edges WHERE child LIKE 'o%' UNION ALL SELECT u.start, e.child, e.parent, e.relation, u.depth + 1 FROM up u JOIN edges e ON e.child = u.parent WHERE u.depth < 6) SELECT start, id, parent, relation, depth FROM up")
def why_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step back from each order, to depth 6."""
    e = edges(spark, sf_dir)
    return graph.ancestors(e.where("child like 'o%'").select(F.col("child").alias("id")), e)


@query(f"WITH RECURSIVE {EDGES}, up(start, parent) AS (SELECT child, parent FROM edges WHERE child LIKE 'o%' UNION SELECT u.start, e.parent FROM up u JOIN edges e ON e.child = u.parent) SELECT start, count(*) AS ancestors FROM up GROUP BY start")
def lineage_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    found = graph.ancestors(e.where("child like 'o%'").select(F.col("child").alias("id")), e)
    return found.select("start", "parent").distinct().groupBy("start").agg(F.count(F.lit(1)).alias("ancestors"))


@query(f"WITH RECURSIVE {EDGES}, bfs(node, label, depth) AS (SELECT 'r' || r_regionkey, r_name, 0 FROM region UNION ALL SELECT e.child, b.label, b.depth + 1 FROM bfs b JOIN edges e ON e.parent = b.node) SELECT node, label, depth FROM bfs")
def bfs_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region names spread over the lineage; each node takes the nearest label."""
    seeds = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.col("r_name").alias("label"))
    out = graph.propagate(seeds, edges(spark, sf_dir).select(F.col("child").alias("u"), F.col("parent").alias("v")))
    return out.select("node", F.get("labels", F.lit(0)).alias("label"), "depth")


@query("""WITH got AS (SELECT lang AS designation, n_chars // 1000 AS size, count(*) AS n FROM documents GROUP BY 1, 2), want AS (SELECT lang AS designation, n_chars // 1000 AS size, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 AND n_chars >= 500 GROUP BY 1, 2)
  SELECT coalesce(g.designation, w.designation) AS designation, coalesce(g.size, w.size) AS size, CASE WHEN w.n IS NULL THEN 'FP' WHEN g.n IS NULL THEN 'FN' ELSE 'TP' END AS outcome, g.n - w.n AS difference, abs(g.n - w.n) <= greatest(0.05, 0.01 * abs(w.n)) AS "right"
  FROM got g FULL JOIN want w ON g.designation = w.designation AND g.size = w.size""")
def truth_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full outer comparison of two sets of quantities made of documents."""
    return compared(spark, sf_dir).select("designation", F.col("size").cast("long").alias("size"), "outcome", F.col("total_m_difference").alias("difference"), F.col("total_m_right").alias("right"))


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkgrid.operators.evaluate import compare

    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("designation"), F.expr("n_chars div 1000").alias("diameter"), "doc_id", "n_chars")
    count = lambda df: df.groupBy("designation", "diameter").agg(F.count(F.lit(1)).alias("total_m")).withColumns({"horizontal_m": F.col("total_m"), "vertical_m": F.col("total_m")})
    return compare(count(docs), count(docs.where("doc_id % 3 <> 0 and n_chars >= 500")))


@query("""SELECT doc_id, abs(n_chars - 1000 * (1 + quality)) <= greatest(0.05, 0.01 * abs(1000 * (1 + quality))) AS "right" FROM labels JOIN documents USING (doc_id)""")
def length_within_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkgrid.operators.evaluate import within

    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return both.select("doc_id", within(F.col("n_chars"), 1000 * (1 + F.col("quality"))).alias("right"))


@query("""WITH got AS (SELECT lang AS designation, n_chars // 1000 AS size, count(*) AS n FROM documents GROUP BY 1, 2), want AS (SELECT lang AS designation, n_chars // 1000 AS size, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 AND n_chars >= 500 GROUP BY 1, 2),
  o AS (SELECT w.n IS NOT NULL AND g.n IS NOT NULL AS tp, w.n IS NULL AS fp, g.n IS NULL AS fn, abs(g.n - w.n) <= greatest(0.05, 0.01 * abs(w.n)) AS good FROM got g FULL JOIN want w ON g.designation = w.designation AND g.size = w.size),
  s AS (SELECT count(*) FILTER (tp) AS tp, count(*) FILTER (fp) AS fp, count(*) FILTER (fn) AS fn, round(avg(CAST(good AS INTEGER)), 6) AS accuracy FROM o)
  SELECT tp, fp, fn, accuracy, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall FROM s""")
def truth_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and accuracy of the comparison of truth_compare."""
    from inkgrid.operators.evaluate import summary

    out = summary(compared(spark, sf_dir))
    return out.select("tp", "fp", "fn", F.round("total_m_accuracy", 6).alias("accuracy"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


SIGNATURES = """sig AS (SELECT a.vec_id AS u, b.vec_id AS v, a.label FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
  WHERE list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: abs(CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)))) <= {most})"""


@query(f"WITH {SIGNATURES.format(most=7.5)} SELECT u, v, label FROM sig")
def signature_l1_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of one block at most 7.5 apart in L1."""
    return like_signatures(table(spark, sf_dir, "embeddings"), ["label"], 7.5, "embedding", "vec_id").select("u", "v", "label")


@query(f"""WITH RECURSIVE {SIGNATURES.format(most=5.5)}, both_ways AS (SELECT u, v FROM sig UNION ALL SELECT v, u FROM sig), reach(n, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.n, b.v FROM reach r JOIN both_ways b ON r.m = b.u)
  SELECT n AS id, min(m) AS "cluster" FROM reach GROUP BY n""")
def shape_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of one block connected by distances of at most 5.5."""
    e = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("signature"))
    return strokes_of.shape_clusters(e, ["label"], 5.5).select("id", "cluster")


@query("""SELECT 'orders_without_customer' AS "check", count(*) AS offenders, count(*) = 0 AS passed FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
  UNION ALL SELECT 'repeated_order', count(*), count(*) = 0 FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'repeated_line', count(*), count(*) = 0 FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)""")
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, li = (table(spark, sf_dir, n) for n in ("orders", "customer", "lineitem"))
    return aggregates.gates({
        "orders_without_customer": o.join(c, o.o_custkey == c.c_custkey, "left_anti"),
        "repeated_order": o.groupBy("o_orderkey").count().where("count > 1"),
        "repeated_line": li.groupBy("l_orderkey", "l_linenumber").count().where("count > 1"),
    })


@query("""WITH runs AS (SELECT o_orderkey AS run, o_custkey AS pipe, CAST(coalesce(sum(l_quantity), 0) AS DOUBLE) AS length FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
  twice AS (SELECT count(*) AS n FROM (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)), again AS (SELECT count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey * 10 + l_linenumber HAVING count(*) > 1)), bare AS (SELECT count(*) AS n FROM runs WHERE run IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'))
  SELECT 'duplicate_centrelines' AS "check", n AS offenders, n = 0 AS passed FROM twice UNION ALL SELECT 'run_in_two_pipes', 0, true UNION ALL SELECT 'uncovered_runs', n, n = 0 FROM bare
  UNION ALL SELECT 'edge_in_two_runs', n, n = 0 FROM again UNION ALL SELECT 'length_difference', CAST(d > 0.01 AS BIGINT), d <= 0.01 FROM (SELECT abs(sum(length) - sum(length) FILTER (run NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'))) AS d FROM runs)""")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of orders as runs, lines as their edges and customers as pipes that leave out unfinished orders."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    edges = li.groupBy(F.col("l_orderkey").alias("run")).agg(F.collect_list(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edges"), F.sum("l_quantity").cast("double").alias("length"))
    runs = o.select(F.col("o_orderkey").alias("run"), "o_custkey", "o_orderstatus").join(edges, "run", "left").withColumn("length", F.coalesce("length", F.lit(0.0)))
    made = runs.where("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("pipe")).agg(F.collect_list("run").alias("runs"), F.sum("length").alias("length_pt"))
    candidates = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("candidate_id"), F.col("l_partkey").alias("line"))
    return aggregates.reconcile(candidates, runs, made)


@query("""SELECT user_id AS job, max_by(state, event_id) AS state, count(*) FILTER (state = 'failed') AS failures, count(*) AS n_events FROM (
  SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS state FROM events) GROUP BY user_id""")
def job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each job and how often it failed, from the events as a job log."""
    from inkgrid.streaming.jobs import states_of

    return states_of(table(spark, sf_dir, "events"))
