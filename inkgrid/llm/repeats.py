"""Substring dedup by hashing units of lines.

A unit is a sentence within a line (lines alone would miss passages set into the middle of a line). Units are
normalised (lower case, white space between words), and their 128-bit digests are grouped over all documents. The
earliest ranked occurrence is kept, every other one is a repeat; the rank is doc_id (null last), then a hash of the
text (for rows of one doc_id or of none), then the place in the text. Units of fewer than MIN_UNIT words are neither
repeats nor breaks. A maximal run of repeats in a row becomes a span to remove when its repeats have MIN_RUN words or
more; starts and ends are code points of the original text.

Digests are counted with partial sums; repeats are found by an equi-join that adaptive execution can split at common
digests. Null and empty texts have no units. Rows that share doc_id and text are one document, so that repeated rows
get the same spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.llm.bitmap import bitmap, hit
from inkgrid.llm.text import row_key
from inkgrid.session import map_arrow, materialise

#: Words of the least unit, and of the least run: half a passage of 50 words, whose ends may lie inside sentences of their own.
MIN_UNIT, MIN_RUN = 4, 25
UNIT = re.compile(r"[^\n.!?]+")
LAST = 2**63 - 1
NAMES = ("key", "rank", "at", "start", "end", "words", "d1", "d2", "again")
SCHEMA = "key struct<a: bigint, b: bigint>, rank long, at int, start long, end long, words int, d1 long, d2 long, again boolean"


def units(text: str | None) -> Iterator[tuple[int, int, int, bytes]]:
    """start, end, number of words and digest of every unit that can be a repeat."""
    for m in UNIT.finditer(text or ""):
        words = m[0].lower().split()
        if len(words) >= MIN_UNIT:
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            yield start, m.start() + len(m[0].rstrip()), len(words), xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "replace"))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for row, text in enumerate(batch.column("text").to_pylist()):
            seen: set[bytes] = set()
            for at, (start, end, words, digest) in enumerate(units(text)):
                rows.append((row, at, start, end, words, digest, digest in seen))
                seen.add(digest)
            if len(rows) >= 50_000:
                yield _batch(batch, rows)
                rows = []
        if rows:
            yield _batch(batch, rows)


def _batch(source: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    row, at, start, end, words, digest, again = zip(*rows, strict=True)
    d = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
    own = [source.column(c).take(pa.array(row, pa.int32())) for c in ("key", "rank")]
    return pa.RecordBatch.from_arrays([*own, pa.array(at, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(words, pa.int32()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(again)], list(NAMES))


def runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """key (row_key), doc_id, start, end, n_units, n_words, keepers and kept_doc_ids of every span to remove.

    keepers has every document that keeps units of the span (first, null for one without doc_id) and how many words it keeps,
    kept_doc_ids those that keep MIN_RUN / 2 words or more, or else the one that keeps most.
    """
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    every = materialise(map_arrow(docs.select(row_key(text=text).alias("key"), rank.alias("rank"), F.col(text).alias("text")), _units, SCHEMA), "repeat-units")
    counts = every.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    common = materialise(counts.where("n > 1").select("d1", "d2", "first"), "repeat-digests")
    likely = every.where(hit(bitmap(common, "d1"), F.col("d1"))).join(common, ["d1", "d2"])
    # several texts may share the first rank
    tied = likely.where("rank = first").groupBy("d1", "d2").agg(F.min("key.a").alias("first_key"), F.max("key.a").alias("last_key"))
    tied = materialise(tied.where("first_key <> last_key").drop("last_key"), "repeat-ties")
    later = F.col("again") | (F.col("rank") > F.col("first")) | F.coalesce(F.col("key.a") > F.col("first_key"), F.lit(False))
    repeats = likely.join(tied, ["d1", "d2"], "left").where(later).groupBy("key", "rank", "at", "start", "end", "words").agg(F.min("first").alias("first"))
    order = Window.partitionBy("key").orderBy("at")
    found = repeats.withColumn("run", F.col("at") - F.row_number().over(order))
    # a keeper at a time, then a run
    parts = found.groupBy("key", "rank", "run", "first").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_units"), F.sum("words").alias("n_words"))
    keepers = F.array_sort(F.collect_list(F.struct((-F.col("n_words")).alias("less"), "first")))
    spans = parts.groupBy("key", "rank", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_units").alias("n_units"), F.sum("n_words").alias("n_words"), keepers.alias("keepers"))
    number = lambda c: F.when(c < LAST, c)
    kept = F.array_sort(F.transform(F.filter("keepers", lambda k, i: (i == 0) | (-k.less >= MIN_RUN / 2)), lambda k: number(k["first"])))
    every_keeper = F.transform("keepers", lambda k: F.struct(number(k["first"]).alias("doc_id"), (-k.less).alias("n_words")))
    return spans.where(F.col("n_words") >= MIN_RUN).select("key", number(F.col("rank")).alias("doc_id"), "start", "end", "n_units", "n_words", every_keeper.alias("keepers"), kept.alias("kept_doc_ids"))


def drop_repeats(docs: DataFrame, text: str = "text", removed: str | None = None) -> DataFrame:
    """docs with the spans cut out of text; removed names a column for them (start, end), if wanted."""
    key, gone = "__inkgrid_key", "__inkgrid_spans"
    docs = docs.drop(removed) if removed else docs
    spans = runs(docs, text).groupBy(F.col("key").alias(key)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(gone))
    both = docs.withColumn(key, row_key(text=text)).join(spans, key, "left")
    t = F.col(text)
    # what stands between the end of one span and the start of the next
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(gone, lambda s: s.end))
    starts = F.concat(F.transform(gone, lambda s: s.start), F.array(F.char_length(t).cast("long")))
    left = F.array_join(F.zip_with(ends, starts, lambda a, b: F.substring(t, (a + 1).cast("int"), (b - a).cast("int"))), "")
    extra = [F.coalesce(F.col(gone), F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")).alias(removed)] if removed else []
    return both.select(*(F.coalesce(left, t).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns), *extra)
