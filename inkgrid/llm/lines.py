"""Line dedup with a log-template tree.

A line with a word goes to a leaf of a tree of fixed depth: its number of tokens, then its DEPTH leading tokens (all,
if it has fewer), where a token with a digit counts as variable. Within a leaf, a token is constant at its position when
it stands there in MIN_DOCS lines or more (repeats included) and has no digit; other tokens are variable. The pattern
of constants and variables is the line's template. A template that is constant in at least MIN_CONSTANT of its
positions and occurs in MIN_DOCS documents or more is boilerplate: its lines are dropped everywhere but at their
first occurrence (the smallest doc_id, then line number), so no content leaves the corpus altogether.

Leaves, tokens, lines and templates are known by 64-bit hashes (lines and templates within their leaf), rows by 128 bits, and all
are counted by aggregations with partial sums; no task gathers a leaf. Null texts stay null, lines without words stay as they are, a text that loses all its lines
becomes empty, and repeated rows share their decisions. A null doc_id ranks first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.llm.bitmap import bitmap, hit
from inkgrid.llm.text import let, row_key, words
from inkgrid.session import materialise

DEPTH, MIN_DOCS, MIN_CONSTANT = 3, 3, 0.5


def _variable(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit("<*>")).otherwise(token)


def _leaf(tokens: Column) -> Column:
    path = [_variable(F.get(tokens, F.lit(i))) for i in range(DEPTH)]
    return F.when(F.size(tokens) > 0, F.xxhash64(F.size(tokens), *path))


def boilerplate(docs: DataFrame, text: str = "text") -> DataFrame:
    """key (row_key) and dropped (the sorted numbers of the lines to drop) of the texts that lose any."""
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    leaves = F.array_compact(F.array_distinct(F.transform(split, lambda line: let(words(line), _leaf))))
    shared = docs.select(F.explode(leaves).alias("leaf")).groupBy("leaf").count().where(F.col("count") >= MIN_DOCS).select("leaf")
    shared = materialise(shared, "line-leaves")

    def parsed(line: Column, i: Column) -> Column:
        return let(words(line), lambda t: F.struct(_leaf(t).alias("leaf"), i.alias("line_no"), t.alias("words")))

    rows = docs.select(row_key(text=text).alias("key"), "doc_id", F.explode(F.transform(split, parsed)).alias("x"))
    rows = rows.where(F.col("x.leaf").isNotNull() & hit(bitmap(shared, "leaf"), F.col("x.leaf")))
    tokens = F.transform("x.words", lambda x: F.when(x.rlike("[0-9]"), F.lit(0).cast("long")).otherwise(F.xxhash64(x).bitwiseOR(F.lit(1).cast("long"))))
    found = rows.select("key", "doc_id", "x.leaf", "x.line_no", tokens.alias("tokens")).withColumn("line", F.xxhash64("tokens"))
    found = materialise(found.join(shared, "leaf", "left_semi"), "line-candidates")

    once = found.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("n"), F.first("tokens").alias("tokens"))
    each = materialise(once.select("leaf", "line", "n", F.posexplode("tokens").alias("at", "token")), "line-tokens")
    usual = each.where("token <> 0").groupBy("leaf", "at", "token").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_DOCS).select("leaf", "at", "token", F.lit(True).alias("usual"))
    judged = each.join(usual, ["leaf", "at", "token"], "left")
    constant = F.coalesce("usual", F.lit(False))
    pattern = F.bit_xor(F.xxhash64("at", F.when(constant, F.col("token")).otherwise(F.lit(0)), constant))
    firm = judged.groupBy("leaf", "line").agg(pattern.alias("template"), (F.count_if(constant) >= MIN_CONSTANT * F.count(F.lit(1))).alias("firm"))
    # written first, so that the join reads two plain shuffles, of which adaptive execution can split those of common lines
    templates = materialise(firm.where("firm").select("leaf", "line", "template"), "line-patterns")
    placed = materialise(found.select("key", "doc_id", "line_no", "leaf", "line").join(templates, ["leaf", "line"]).drop("line"), "line-templates")

    by_doc = placed.groupBy("leaf", "template", "key").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    recurring = by_doc.groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first")).where(F.col("n") >= MIN_DOCS)
    drop = placed.join(materialise(recurring.drop("n"), "line-recurring"), ["leaf", "template"]).where(~F.struct("doc_id", "line_no").eqNullSafe(F.col("first")))
    return drop.groupBy("key").agg(F.array_sort(F.collect_set("line_no")).alias("dropped"))


def drop_boilerplate(docs: DataFrame, text: str = "text", dropped: str | None = None) -> DataFrame:
    """docs with the boilerplate lines taken out of text; dropped names a column for their numbers, if wanted."""
    key, gone = "__inkgrid_key", "__inkgrid_dropped"
    docs = docs.drop(dropped) if dropped else docs
    lost = boilerplate(docs, text).withColumnsRenamed({"key": key, "dropped": gone})
    both = docs.withColumn(key, row_key(text=text)).join(lost, key, "left")
    lines = F.split(F.col(text), "\n")
    left = let(lines, lambda s: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(s) - 1), F.col(gone)), lambda i: F.get(s, i)), "\n"))
    cleaned = F.when(F.col(gone).isNull(), F.col(text)).otherwise(left)
    extra = [F.coalesce(F.col(gone), F.expr("cast(array() as array<int>)")).alias(dropped)] if dropped else []
    return both.select(*(cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns), *extra)
