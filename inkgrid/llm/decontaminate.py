"""Benchmark decontamination by spaced seeds.

Texts become lower-case words, cut at white space and punctuation. At every position of benchmark items and documents, each mask
picks some of the following words and ignores the others; equal hashes of the picked words are seed hits, so that a hit
survives substitutions at ignored positions. Hits of a document and an item at the same offset are one alignment. An
alignment is an overlap when some window of WINDOW words of the item (the whole item, if shorter) has at least SHARE of
its words equal to the document's words there; words of the window outside the document count as unequal. Insertions or
deletions start another alignment.

No such window is missed: whichever of its words are substituted, one of the masks for items of that length hits it (tests
go through all substitutions). MASKS do so for items of 13 words or more, SHORT_MASKS with them for 5 to 12; of shorter
items all words must be equal, and these are one mask. Masks that no item needs are left out.

Documents reach the join as single hashes that passed a fixed-size bitmap of the benchmark's hashes, so the shuffle
holds hits, not the corpus; the join and the comparison of words then decide, with one row for each document and item.
Only DataFrame expressions are used.

Null texts have no words, items without words match nothing. Repeated items and documents count once each by id and
text; rows without doc_id are matched like others, with a null doc_id. Documents are dropped for overlaps of
LEAST_WINDOW words or more: shorter items are found, but they are phrases that clean texts hold too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.llm.bitmap import bitmap, hit
from inkgrid.llm.text import let, row_key
from inkgrid.session import materialise

#: Word positions that each mask looks at: for all items that it fits, and for items of fewer than LONG words.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 4, 6))
SHORT_MASKS, LONG = ((0, 1, 2, 3), (0, 2, 3, 4), (0, 1, 3, 4), (0, 1, 2, 4)), 13
SPAN = 1 + max(map(max, MASKS))
WINDOW, SHARE, LEAST_WINDOW = 20, 0.8, 5
#: Fixed value: what separates words, white space and punctuation.
CUT = "[\\x20\\x09-\\x0D.,;:!?\"'()\\[\\]{}]+"


def tokens(text: Column) -> Column:
    """The words of a text in lower case, cut at white space and punctuation."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), CUT), "")


def seed_masks() -> list[tuple[tuple[int, ...], int, int]]:
    """Every mask with the least and most words of the items that it is for."""
    whole = [(tuple(range(n)), n, n) for n in range(1, 5)]
    return [*((m, m[-1] + 1, 10**9) for m in MASKS), *((m, 5, LONG - 1) for m in SHORT_MASKS), *whole]


def _windows(t: Column) -> Column:
    """For every position of a token array, a struct of the tokens (hashed) that the masks may look at; null past the end."""
    return let(F.transform(t, lambda w: F.xxhash64(w)), lambda h: F.arrays_zip(*(F.slice(h, p + 1, F.greatest(F.size(h) - p, F.lit(0))).alias(f"t{p}") for p in range(SPAN))))


def _seeds(df: DataFrame, key: str, t: Column, masks: list[int], size: Column | None = None) -> DataFrame:
    """key, at and one column for every mask: its seed at this position, null where the mask doesn't fit or isn't for texts of this size."""
    at = df.select(key, *([size.alias("size")] if size is not None else []), F.posexplode(_windows(t)).alias("at", "x"))

    def seed(k: int) -> Column:
        mask, low, high = seed_masks()[k]
        there = F.col(f"x.t{mask[-1]}").isNotNull()
        return F.when(there & F.col("size").between(low, high) if size is not None else there, F.xxhash64(F.lit(k), *(F.col(f"x.t{p}") for p in mask)))

    return at.select(key, "at", *(seed(k).alias(f"seed{k}") for k in masks))


def _long(seeds: DataFrame, key: str, masks: list[int]) -> DataFrame:
    """key, at, seed: a row for each seed."""
    return seeds.select(key, "at", F.explode(F.array(*(f"seed{k}" for k in masks))).alias("seed")).where("seed is not null")


def _best(item: Column, doc: Column, offsets: Column) -> Column:
    """The most words of a window of the item that equal the document's at one of the offsets."""
    width = F.least(F.size(item), F.lit(WINDOW))
    total = lambda equal, i: F.aggregate(F.slice(equal, i + 1, width), F.lit(0), lambda acc, x: acc + x)
    most = lambda equal: F.array_max(F.transform(F.sequence(F.lit(0), F.size(item) - width), lambda i: total(equal, i)))
    at = lambda o: let(F.transform(item, lambda w, i: F.coalesce((w == F.get(doc, i + o)).cast("int"), F.lit(0))), most)
    return F.array_max(F.transform(offsets, at))


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, key (row_key), item_id, matched (words equal in the best window) and window (its length)."""
    items = benchmark.select("item_id", "text").distinct().select("item_id", row_key("item_id", "text").alias("item"), tokens(F.col("text")).alias("words"))
    items = materialise(items.where(F.size("words") > 0), "benchmark-words")
    sizes = {r[0] for r in items.select(F.least(F.size("words"), F.lit(LONG))).distinct().collect()}  # at most LONG values
    masks = [k for k, (_, low, high) in enumerate(seed_masks()) if any(low <= n <= high for n in sizes)] or [0]
    seeds = materialise(_long(_seeds(items, "item", F.col("words"), masks, F.size("words")), "item", masks).withColumnRenamed("at", "item_at"), "benchmark-seeds")
    bits = bitmap(seeds, "seed")
    found = _seeds(docs.select(row_key("doc_id", text).alias("key"), F.col(text).alias("text")), "key", tokens(F.col("text")), masks)
    some = F.lit(False)
    for k in masks:
        some = some | hit(bits, F.col(f"seed{k}"))
    hits = _long(found.where(some), "key", masks).where(hit(bits, F.col("seed"))).join(seeds, "seed")
    # no more offsets than words of the document and the item together
    lines = materialise(hits.groupBy("key", "item").agg(F.collect_set(F.col("at") - F.col("item_at")).alias("offsets")), "benchmark-alignments")
    texts = docs.select("doc_id", row_key("doc_id", text).alias("key"), F.col(text).alias("text")).join(lines.select("key").distinct(), "key", "left_semi").distinct()
    aligned = lines.join(texts.select("key", "doc_id", tokens(F.col("text")).alias("doc_words")), "key").join(items, "item")
    width = F.least(F.size("words"), F.lit(WINDOW))
    # an array of one, so that the filter doesn't compute it again
    scored = aligned.select("key", "doc_id", "item_id", F.explode(F.array(_best(F.col("words"), F.col("doc_words"), F.col("offsets")))).alias("matched"), width.alias("window"))
    return scored.where(F.col("matched") >= F.ceil(F.col("window") * SHARE)).groupBy("key", "doc_id", "item_id", "window").agg(F.max("matched").alias("matched"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that overlap no benchmark item in LEAST_WINDOW words or more."""
    key = "__inkgrid_key"
    leaked = materialise(overlaps(docs, benchmark, text).where(F.col("window") >= LEAST_WINDOW).select(F.col("key").alias(key)).distinct(), "benchmark-leaks")
    return docs.withColumn(key, row_key("doc_id", text)).join(leaked, key, "left_anti").select(*(f"`{c}`" for c in docs.columns))
