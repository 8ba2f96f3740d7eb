"""Quality rules with risk-controlled thresholds.

Four integer features are measured on every document. For each stratum (language) and feature, a grid of cutoffs is
tested on labelled documents: a cutoff is admissible when an exact binomial test shows, at level DELTA divided by the
number of all tests, that it rejects less than ALPHA / (number of features) of the good documents. The admissible
cutoff that best separates bad from good is used; where none is admissible, the feature rejects nothing. By the union
bound every stratum's false rejection rate is below ALPHA, jointly with probability 1 - DELTA.

Everything runs as DataFrame expressions. Null texts are empty, null languages are the stratum "", documents without
label take no part in the tests, repeated labels of one document count once with their lowest quality, and with no
labels only the base rule rejects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.llm.bitmap import bitmap, hit
from inkgrid.llm.text import let, words
from inkgrid.session import materialise

ALPHA, DELTA = 0.05, 0.05
#: What rejecting a share of the good documents costs, against the same share of the bad.
COST = 10
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A character of a word, and the symbols.
WORD, SYMBOLS = "[^\\x20\\x09-\\x0D]", "[#*$%&|<>]"
#: Cutoffs by feature; a document is rejected when its feature reaches the cutoff.
GRID = {
    "symbol_permille": [2, 5, 10, 20, 30, 50, 75, 100, 150, 200, 300],
    "dup_line_permille": [50, 100, 150, 200, 250, 300, 400, 500, 600, 700, 800],
    "repeat_word_permille": [50, 100, 150, 200, 250, 300, 350, 400, 450, 475, 500],
    "mean_word_centichars": [600, 650, 700, 750, 800, 900, 1000, 1200, 1500, 2000, 3000],
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(w: Column) -> Column:
    """Words of w in 3-word windows that occur twice or more.

    A window's hash (its low 33 bits) and position make one long, so that a sort of longs brings candidates together;
    the candidates' words are then compared, so that the count is exact.
    """
    position = F.lit(2147483647).cast("long")

    def packed(a: Column, i: Column) -> Column:
        return F.shiftleft(F.xxhash64(a, F.get(w, i + 1), F.get(w, i + 2)), 31).bitwiseOR(i.cast("long"))

    def candidates(s: Column) -> Column:
        key = lambda x: F.shiftright(x, 31)
        near = lambda x, k: F.coalesce(key(x) == key(F.get(s, k - 1)), F.lit(False)) | F.coalesce(key(x) == key(F.get(s, k + 1)), F.lit(False))
        return F.transform(F.filter(s, near), lambda x: x.bitwiseAND(position).cast("int"))

    def exact(s: Column) -> Column:
        same = lambda x, k: F.coalesce((x.a == F.get(s, k).a) & (x.b == F.get(s, k).b) & (x.c == F.get(s, k).c), F.lit(False))
        return F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x.p)

    def covered(s: Column) -> Column:
        step = lambda x, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - x, F.lit(3)))
        return F.aggregate(F.transform(s, step), F.lit(0).cast("long"), lambda total, x: total + x)

    windows = F.slice(F.transform(w, packed), 1, F.greatest(F.size(w) - 2, F.lit(0)))
    at = let(F.sort_array(windows), candidates)
    rows = F.transform(at, lambda p: F.struct(F.get(w, p).alias("a"), F.get(w, p + 1).alias("b"), F.get(w, p + 2).alias("c"), p.alias("p")))
    return let(F.sort_array(let(F.sort_array(rows), exact)), covered)


def metrics(text: Column) -> Column:
    """A struct of the BASE counts and the GRID features of a text; all counts of a null or wordless text are 0."""
    text = F.coalesce(text, F.lit(""))

    def measured(x: Column) -> Column:
        filled = F.size(x.lines)
        dup = filled - F.size(F.array_distinct(x.lines))
        n = F.size(x.w)
        per = lambda scale, a, b: F.floor(scale * a / F.greatest(b, F.lit(1))).cast("long")
        chars = F.char_length(F.array_join(x.w, ""))
        counts = F.struct(n.cast("long").alias("n"), chars.cast("long").alias("c"), x.s.cast("long").alias("s"), dup.cast("long").alias("d"), _repeat_words(x.w).alias("r"), filled.alias("f"))
        return let(
            counts,
            lambda k: F.struct(
                k.n.alias("n_words"), k.c.alias("word_chars"), k.s.alias("n_symbols"), k.d.alias("n_dup_lines"), k.r.alias("n_repeat_words"),
                per(1000, k.s, k.c).alias("symbol_permille"), per(1000, k.d, k.f).alias("dup_line_permille"),
                per(1000, k.r, k.n).alias("repeat_word_permille"), per(100, k.c, k.n).alias("mean_word_centichars"),
            ),
        )

    parts = F.struct(
        words(text).alias("w"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)).alias("lines"),
        # most texts have no symbol, and need no second look
        F.when(text.rlike(SYMBOLS), F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, ""))).otherwise(0).alias("s"),
    )
    return let(parts, measured)


def base_failed(m: Column) -> Column:
    return (m.n_words < MIN_WORDS) | (100 * m.n_repeat_words > MAX_REPEAT_PERCENT * m.n_words)


def _tail(k: Column, n: Column, rate: float) -> Column:
    """P(Binomial(n, rate) <= k), summed in logarithms from the term of 0 up."""
    odds = F.log(F.lit(rate / (1 - rate)))
    start = F.struct((n * F.log(F.lit(1 - rate))).alias("term"), (n * F.log(F.lit(1 - rate))).alias("total"))

    def step(acc: Column, j: Column) -> Column:
        term = acc.term + F.log((n - j + 1) / j) + odds
        return let(term, lambda t: F.struct(t.alias("term"), (F.greatest(acc.total, t) + F.log1p(F.exp(-F.abs(acc.total - t)))).alias("total")))

    upto = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.expr("cast(array() as array<bigint>)"))
    return F.exp(F.aggregate(upto, start, step, lambda acc: acc.total))


def fit_cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """measured: doc_id, stratum, m (a metrics struct). labels: doc_id, quality. Gives stratum, feature, cutoff.

    Tests run on the labelled documents that pass the base rule. Counts are aggregated by grid cell before any window,
    so that no task holds more than strata x features x grid rows.
    """
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    cell = lambda name: F.size(F.filter(F.array(*map(F.lit, GRID[name])), lambda c: F.col(f"m.{name}") >= c))
    held = measured.where(~base_failed(F.col("m"))).join(good, "doc_id")
    cells = held.select("stratum", "good", F.explode(F.array(*(F.struct(F.lit(name).alias("feature"), cell(name).alias("cell")) for name in GRID))).alias("x"))
    counts = cells.groupBy("stratum", "x.feature", "x.cell").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    whole = Window.partitionBy("stratum", "feature")
    above = whole.orderBy(F.desc("cell"))
    tests = F.size(F.collect_set("stratum").over(Window.partitionBy(F.lit(0)))) * sum(map(len, GRID.values()))
    # a row for every grid cell, so that sparse cells are tested too
    grid = counts.select("stratum", "feature").distinct().withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(max(map(len, GRID.values()))))))
    summed = grid.join(counts, ["stratum", "feature", "cell"], "left").na.fill(0, ["g", "b"]).select(
        "stratum", "feature", "cell", F.sum("g").over(whole).alias("n_good"), F.sum("b").over(whole).alias("n_bad"),
        F.sum("g").over(above).alias("k_good"), F.sum("b").over(above).alias("k_bad"), tests.alias("tests"),
    )
    rate = alpha / len(GRID)
    gain = F.col("k_bad") / F.greatest("n_bad", F.lit(1)) - COST * F.col("k_good") / F.greatest("n_good", F.lit(1))
    valid = summed.where("cell > 0 and k_bad > 0").where(F.col("k_good") < F.col("n_good") * rate)
    valid = valid.where(_tail(F.col("k_good"), F.col("n_good"), rate) <= delta / F.col("tests")).withColumn("gain", F.round(gain, 9)).where("gain > 0")
    best = valid.groupBy("stratum", "feature").agg(F.max_by("cell", F.struct("gain", "cell")).alias("cell"))
    cutoffs = F.create_map(*(x for name, cuts in GRID.items() for x in (F.lit(name), F.array(*map(F.lit, cuts)))))
    return best.select("stratum", "feature", F.get(F.element_at(cutoffs, F.col("feature")), F.col("cell") - 1).alias("cutoff"))


def verdict(df: DataFrame, cutoffs: DataFrame, stratum: Column, m: Column) -> Column:
    """True for a document that passes the base rule and stays below every cutoff of its stratum.

    The cutoffs (at most one for a stratum and feature) reach the rows as one scalar subquery, without a shuffle.
    """
    table = cutoffs.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "feature", "stratum"), "cutoff")))).scalar()
    reached = [F.coalesce(m[name] >= F.try_element_at(table, F.concat_ws("|", F.lit(name), stratum)), F.lit(False)) for name in GRID]
    failed = base_failed(m)
    for r in reached:
        failed = failed | r
    return ~failed


def measure(docs: DataFrame, text: str = "text", stratum: str = "lang") -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), metrics(F.col(text)).alias("m"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, the BASE counts, base_failed, kept."""
    measured = materialise(measure(docs), "quality-metrics")
    cutoffs = materialise(fit_cutoffs(measured, labels), "quality-cutoffs")
    m = F.col("m")
    return measured.select("doc_id", *(m[c].alias(c) for c in BASE), base_failed(m).alias("base_failed"), verdict(measured, cutoffs, F.col("stratum"), m).alias("kept"))


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that quality() keeps, with docs' own columns.

    Cutoffs are fitted on what may be labelled documents by a bitmap of their ids (the join in fit_cutoffs decides), so that
    other texts are measured once, and none is shuffled.
    """
    h, ids = "__inkgrid_h", F.xxhash64(F.col("doc_id").cast("long"))
    marked = labels.where("doc_id is not null and quality is not null").select(ids.alias(h))
    held = docs.where(hit(bitmap(marked, h), ids))
    cutoffs = materialise(fit_cutoffs(materialise(measure(held), "quality-metrics"), labels), "quality-cutoffs")
    m, s = "__inkgrid_m", F.coalesce(F.col("lang").cast("string"), F.lit(""))
    # a generator, since a filter would otherwise take the place of the projection and measure each text again for every feature
    seen = docs.select("*", F.explode(F.array(metrics(F.col("text")))).alias(m))
    return seen.where(verdict(seen, cutoffs, s, F.col(m))).select(*(f"`{c}`" for c in docs.columns))
