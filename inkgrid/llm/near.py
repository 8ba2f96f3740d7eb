"""Near-duplicate documents by SimHash fingerprints and exact Jaccard similarity of their word shingles.

Two texts are near copies when their sets of SHINGLE words in a row (lower case, white space between words) have a
Jaccard similarity of 4/5 or more. SimHash fingerprints of the shingles (repeats included) meet first, at the anchors of
the covering code of `simhash`; the sets of those that are linked are verified. Near copies are often further apart than
its bits, and what fingerprints have not connected is found exactly. No pair is missed: with every set in one fixed order of shingles (rarer ones
first, by counts in BUCKETS), two near copies share a shingle among the first n - ceil(4/5 n) + 1 of each. Equal sets
are one node. Of the sets that share such a shingle, all are compared with that of the least hash first, those not yet connected
by that with that of the largest; after that only sets not connected yet meet in pairs, and of those only pairs that sizes and
places in the order still allow, so that a large family of near copies is not compared pair by pair. Every link is verified on the whole sets.

Null and wordless texts have the empty set and are copies of each other; a shorter text is one shingle of all its words.
Shingles are known by 48 bits of a hash, which are what is kept and shuffled of a text (a pair's sets share a hash by chance in
2 of 10**10 pairs), sets by 64. A null doc_id ranks last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.llm import simhash
from inkgrid.llm.bitmap import bitmap, hit
from inkgrid.llm.text import row_key
from inkgrid.operators.graph import components
from inkgrid.session import map_arrow, materialise

SHINGLE, SEED = 5, 42
BUCKETS, CHUNK, BYTES, PARTS = 16, 1 << 12, 6, 256
#: Links (16 bytes each) up to which one task finds their components; more go through rounds of joins.
FEW = 1 << 20


def hashed(text: str | None) -> np.ndarray:
    """The 64-bit hashes of a text's shingles, in order."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE, len(tokens))
    digest = xxhash.xxh64_intdigest
    spans = zip(begins[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, len(tokens) - k + 1)


def kept_bytes(hashes: np.ndarray) -> np.ndarray:
    """The sorted distinct hashes, of BYTES bytes each."""
    return np.unique(hashes >> np.uint64(64 - 8 * BYTES))


def packed(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // BYTES, 8), np.uint8)
    wide[:, :BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, BYTES)
    return wide.view("<u8").ravel()


def sketch(hashes: np.ndarray) -> bytes:
    """How many of a set's hashes fall in each of PARTS parts, up to 255."""
    return np.minimum(np.bincount((hashes % np.uint64(PARTS)).astype(np.int64), minlength=PARTS), 255).astype(np.uint8).tobytes()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            some = batch.slice(at, 1024)
            found, fps = [], []
            for t in some.column("text").to_pylist():
                h = hashed(t)
                fps.append(simhash.of_hashes(h[i : i + simhash.CHUNK] for i in range(0, len(h), simhash.CHUNK)))
                found.append(kept_bytes(h))
            raw = [packed(h) for h in found]
            ids = np.array([xxhash.xxh3_64_intdigest(r) for r in raw], np.uint64).view(np.int64)
            columns = [some.column("doc_id"), some.column("rk"), pa.array(ids), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array([len(h) for h in found], pa.int64()), pa.array([sketch(h) for h in found], pa.binary()), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "rk", "id", "fp", "n", "sketch", "hashes"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << BUCKETS, np.int64)
    for batch in batches:
        for raw in batch.column("hashes").to_pylist():
            np.add.at(counts, unpacked(raw) >> np.uint64(8 * BYTES - BUCKETS), 1)
    filled = np.flatnonzero(counts)
    for at in range(0, len(filled), CHUNK):
        some = filled[at : at + CHUNK]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])


def _prefixes(counts: np.ndarray):
    """Rows id, n, at, h: the first shingles of each set in the common order, and their places; once a task for copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids, sizes, places, found = [], [], [], []
            for i, raw in zip(batch.column("id").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
                if i in seen:
                    continue
                seen.add(i)
                h = unpacked(raw)
                if len(h):
                    some = h[np.argsort(counts[h >> np.uint64(8 * BYTES - BUCKETS)], kind="stable")][: len(h) - -(-4 * len(h) // 5) + 1]
                    ids.append(np.full(len(some), i))
                    sizes.append(np.full(len(some), len(h)))
                    places.append(np.arange(len(some)))
                    found.append(some)
            if ids:
                columns = [np.concatenate(c) for c in (ids, sizes, places, found)]
                columns[3] = columns[3].view(np.int64)
                whole = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "n", "at", "h"])
                for at in range(0, whole.num_rows, 1 << 16):
                    yield whole.slice(at, 1 << 16)

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v: sets of one shingle and different roots that may be near copies; rows come sorted by h and n."""

    def meet(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        i, n, at, root = np.concatenate(rows, axis=1)
        us, vs, held = [], [], 0
        last = np.searchsorted(n, 5 * n // 4, side="right")
        for k in range(len(i)):
            m = slice(k + 1, last[k])
            fits = (root[m] != root[k]) & (9 * np.minimum(n[k] - at[k], n[m] - at[m]) >= 4 * (n[k] + n[m]))
            other = i[m][fits]
            us.append(np.minimum(other, i[k]))
            vs.append(np.maximum(other, i[k]))
            held += len(other)
            if held and (held >= 1 << 16 or k == len(i) - 1):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])
                us, vs, held = [], [], 0

    now, rows = None, []
    for batch in batches:
        h = batch.column("h").to_numpy()
        table = np.stack([batch.column(c).to_numpy() for c in ("id", "n", "at", "root")])
        cuts = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), len(h)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if rows and h[a] != now:
                yield from meet(rows)
                rows = []
            now = h[a]
            rows.append(table[:, a:b])
    if rows:
        yield from meet(rows)


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches (x, y) and sizes (n, m) allow enough common hashes: no more than the lesser count of each part, unless both are at their most."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int64) for c in ("x", "y"))
        n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
        least = np.minimum(x, y)
        right = (9 * least.sum(axis=1) >= 4 * (n + m)) | (least == 255).any(axis=1)
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(right, pa.bool_()))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        right = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            a, b = unpacked(x), unpacked(y)
            right.append(9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b)))
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(right, pa.bool_()))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs u, v of sets that are near copies: sketches first, then whole sets of what they leave."""
    pairs = materialise(pairs.distinct(), "near-pairs")
    of = lambda some, c, **columns: sets.where(hit(bitmap(some, c), F.col("id"))).dropDuplicates(["id"]).select(F.col("id").alias(c), *(F.col(k).alias(v) for k, v in columns.items()))
    sketched = pairs.join(of(pairs, "u", sketch="x", n="n"), "u").join(of(pairs, "v", sketch="y", n="m"), "v")
    left = materialise(map_arrow(sketched.select("u", "v", "x", "y", "n", "m"), _possible, "u long, v long"), "near-possible")
    both = left.join(of(left, "u", hashes="x"), "u").join(of(left, "v", hashes="y"), "v").select("u", "v", "x", "y")
    return materialise(map_arrow(both, _verify, "u long, v long"), "near-links")


def by_fingerprints(sets: DataFrame) -> DataFrame:
    """The pairs u, v of near copies that SimHash finds: a set for each fingerprint, with those of linked fingerprints and with the others of its own."""
    heads = materialise(sets.groupBy("fp").agg(F.min("id").alias("id")), "near-fingerprints")
    head = lambda c, to: heads.select(F.col("fp").alias(c), F.col("id").alias(to))
    linked = simhash.links(heads.select("fp")).join(head("u", "a"), "u").join(head("v", "b"), "v").where("a <> b")
    alike = sets.select("fp", F.col("id").alias("b")).distinct().join(head("fp", "a"), "fp").where("a <> b")
    return verified(linked.select("a", "b").union(alike.select("a", "b")).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")), sets)


def _new(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose sets the links found don't connect."""
    roots = components(found, FEW)
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"of_{c}"))
    both = pairs.join(root("u"), "u", "left").join(root("v"), "v", "left")
    return both.where(~F.col("of_u").eqNullSafe(F.col("of_v")) | F.col("of_u").isNull()).select("u", "v")


def links(sets: DataFrame) -> DataFrame:
    """sets: id, fp, n, sketch and hashes, the same set maybe in many rows. Gives u, v: edges whose components are those of all pairs of near copies."""
    counted = map_arrow(sets.select("hashes"), _count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << BUCKETS, np.int64)
    counts[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    firsts = materialise(map_arrow(sets, _prefixes(counts), "id long, n long, at long, h long"), "near-prefixes")
    shared = firsts.groupBy("h").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most")
    met = materialise(firsts.join(shared, "h"), "near-places")
    found = by_fingerprints(sets)
    found = found.union(verified(_new(_to(met.withColumn("root", F.col("id")), "least").distinct(), found), sets))
    left = _apart(met, found)
    found = found.union(verified(_to(left, "most"), sets))
    left = _apart(left.drop("root"), found).select("h", "id", "n", "at", "root")
    rest = map_arrow(left.repartition("h").sortWithinPartitions("h", "n"), _pairs, "u long, v long")
    return found.union(verified(rest, sets))


def _to(rows: DataFrame, c: str) -> DataFrame:
    """Pairs of each set with set c of its shingle, where they aren't connected yet and may be near copies."""
    hub = rows.where(F.col("id") == F.col(c)).dropDuplicates(["h"]).select("h", F.col("n").alias("m"), F.col("at").alias("mat"), F.col("root").alias("hub"))
    fits = 9 * F.least(F.col("n") - F.col("at"), F.col("m") - F.col("mat")) >= 4 * (F.col("n") + F.col("m"))
    return rows.join(hub, "h").where((F.col("root") != F.col("hub")) & fits).select(F.least("id", c).alias("u"), F.greatest("id", c).alias("v"))


def _apart(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of those shingles whose sets aren't all connected by the links found, with the roots."""
    roots = components(found, FEW).withColumnRenamed("node", "id")
    rooted = materialise(rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "near-roots")
    mixed = materialise(rooted.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("h"), "near-mixed")
    return rooted.join(mixed, "h", "left_semi")


def drop_near_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of docs for each component of near copies: that with the smallest doc_id; of rows with one doc_id and text, one."""
    key = "__inkgrid_rk"
    rows = map_arrow(docs.select(F.col("doc_id").cast("long"), row_key(text=text).alias("rk"), F.col(text).alias("text")), _sets, "doc_id long, rk struct<a: bigint, b: bigint>, id long, fp long, n long, sketch binary, hashes binary")
    rows = materialise(rows, "near-sets")
    rank = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "rk")
    roots = components(links(rows.select("id", "fp", "n", "sketch", "hashes")), FEW).withColumnRenamed("node", "id")
    grouped = rows.groupBy("id").agg(F.min(rank).alias("first")).join(roots, "id", "left")
    kept = grouped.groupBy(F.coalesce("root", "id")).agg(F.min("first").alias("first")).select(F.col("first.rk.a").alias("a"), F.col("first.rk.b").alias("b"))
    return keep_rows(docs, rows.select("rk.a", "rk.b"), kept, text)


def keep_rows(docs: DataFrame, rows: DataFrame, kept: DataFrame, text: str) -> DataFrame:
    """One row of docs for each key (a, b: its row_key) in kept. rows: the keys of all rows of docs.

    Rows whose keys occur once and are kept pass where they are; only those that a bitmap of the other keys hits are shuffled.
    """
    counts = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    doubtful = materialise(counts.join(kept.distinct().withColumn("kept", F.lit(True)), ["a", "b"], "left").where("n > 1 or kept is null").select("a", "b", F.coalesce("kept", F.lit(False)).alias("kept")), "doubtful-rows")
    a, b, good = "__inkgrid_a", "__inkgrid_b", "__inkgrid_kept"
    keyed = docs.withColumns({a: row_key(text=text).a, b: row_key(text=text).b})
    seen = hit(bitmap(doubtful, "a"), F.col(a))
    named = doubtful.withColumnsRenamed({"a": a, "b": b, "kept": good})
    judged = keyed.where(seen).join(named, [a, b], "left")
    # a false hit of the bitmap is in no doubt; a key that is kept though it repeats is kept once
    clear = judged.where(F.col(good).isNull())
    once = judged.where(good).dropDuplicates([a, b])
    out = keyed.where(~seen).unionByName(clear.drop(good)).unionByName(once.drop(good))
    return out.select(*(f"`{c}`" for c in docs.columns))
