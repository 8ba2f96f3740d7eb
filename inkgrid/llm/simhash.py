"""Near-duplicate documents by SimHash and anchor points of a covering code.

The anchors are the words of a product of repetition codes: the 64 bits are cut into m blocks, and an anchor is
constant in each block. A fingerprint's home is the nearest anchor (the majority of each block), at most the covering
radius away. Fingerprints that differ in THRESHOLD bits at most meet at one of their homes when each one visits every
anchor within radius plus threshold; of those, only anchors that can be the home of a fingerprint within THRESHOLD bits
matter, and of a pair's two homes the larger is enough, so a fingerprint visits just these. m follows the number of
distinct fingerprints, so that an anchor's homes stay few as data grow; anchors with many homes all the same (large
families of near copies) are split over tasks by home. At an anchor, homes are held and visitors stream by; what is
emitted is a forest of the links found in a task, never all pairs.

Null and wordless texts have the fingerprint zero and are linked like any other. Copies meet as one fingerprint. The
component of documents without any doc_id has a null component_id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.llm.text import row_key
from inkgrid.operators.graph import components
from inkgrid.session import map_arrow, materialise

SHINGLE, SEED, THRESHOLD = 4, 42, 4
#: Homes of an anchor wanted on average, homes at which an anchor is split, and how many anchors may be split at most.
HOMES, SPLIT, SPLITS = 512, 4096, 65536
CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 without words."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE, len(tokens))
    spans = list(zip(begins[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True))
    digest = xxhash.xxh64_intdigest
    return of_hashes(np.array([digest(line[a:b], SEED) for a, b in spans[at : at + CHUNK]], "<u8") for at in range(0, len(spans), CHUNK))


def of_hashes(parts: Iterable[np.ndarray]) -> int:
    """The 64-bit SimHash of shingles' hashes, given in parts; 0 without any."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        counts += np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rk"), pa.array(found)], ["doc_id", "rk", "fp"])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, rk (a hash of doc_id and text that tells rows apart) and fp of every row."""
    rows = docs.select(F.col("doc_id").cast("long"), row_key(text=text).alias("rk"), F.col(text).alias("text"))
    return map_arrow(rows, _fingerprints, "doc_id long, rk struct<a: bigint, b: bigint>, fp long")


def blocks(m: int) -> list[int]:
    """The lengths of m blocks of 64 bits, as even as can be."""
    return [64 // m + (i < 64 % m) for i in range(m)]


def _homes(fps: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint's home, and the bits to change in each block for another majority there."""
    home, cost, shift = np.zeros(len(fps), np.int64), np.empty((len(fps), m), np.int8), 0
    for i, length in enumerate(blocks(m)):
        weight = np.bitwise_count((fps >> np.uint64(shift)) & np.uint64(2**length - 1)).astype(np.int8)
        major = weight > length // 2
        home |= major.astype(np.int64) << i
        cost[:, i] = np.where(major, weight - length // 2, length // 2 + 1 - weight)
        shift += length
    return home, cost


def _visits(fps: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Homes; then, for every visit, the fingerprint's position and the anchor (its own home, or a larger one)."""
    home, cost = _homes(fps, m)
    who, where = [np.arange(len(fps))], [home]
    for size in range(1, THRESHOLD + 1):
        for some in combinations(range(m), size):
            near = np.flatnonzero(cost[:, some].sum(axis=1, dtype=np.int16) <= THRESHOLD)
            anchor = home[near] ^ sum(1 << i for i in some)
            larger = anchor > home[near]
            who.append(near[larger])
            where.append(anchor[larger])
    return home, np.concatenate(who), np.concatenate(where)


def _deal(m: int, split: dict[int, int]):
    """Rows (anchor, part, visitor, fps): the fingerprints at home at an anchor, then those that visit it."""

    def blobs(anchor: np.ndarray, fps: np.ndarray, visitor: bool) -> Iterator[tuple]:
        order = np.argsort(anchor, kind="stable")
        anchor, fps = anchor[order], fps[order]
        cuts = np.flatnonzero(np.diff(anchor)) + 1
        for a, some in zip(anchor[np.concatenate(([0], cuts))].tolist(), np.split(fps, cuts), strict=True):
            parts = split.get(a, 1)
            for part in range(parts):
                mine = some if visitor or parts == 1 else some[some % np.uint64(parts) == part]
                if len(mine):
                    yield a, part, visitor, mine.tobytes()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                fps = batch.column("fp").slice(at, CHUNK).to_numpy().view(np.uint64)
                home, who, where = _visits(fps, m)
                rows = [*blobs(home, fps, False), *blobs(where, fps[who], True)]
                for i in range(0, len(rows), 2048):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 2048], strict=True), (pa.int64(), pa.int32(), pa.bool_(), pa.binary()), strict=True)], ["anchor", "part", "visitor", "fps"])

    return deal


class Forest:
    """A union-find that keeps the edges which joined two trees."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def join(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.edges.append((a, b))


def _meet(homes: np.ndarray, group: np.ndarray, visitors: np.ndarray, forest: Forest) -> np.ndarray:
    """Links visitors to homes; group, the homes' group numbers, is returned with the groups that a visitor joins made one."""
    step = max(1, (1 << 21) // len(homes))
    for at in range(0, len(visitors), step):
        some = visitors[at : at + step]
        near = np.bitwise_count(some[:, None] ^ homes[None, :]) <= THRESHOLD
        linked = np.flatnonzero(near.any(axis=1))
        if not len(linked):
            continue
        some, near = some[linked], near[linked]
        first = near.argmax(axis=1)
        for a, b in zip(some.tolist(), homes[first].tolist(), strict=True):
            if a != b:
                forest.join(a, b)
        near = near[near.sum(axis=1) > 1]
        while len(near):
            low = np.where(near, group, len(homes)).min(axis=1)
            high = np.where(near, group, -1).max(axis=1)
            open_ = low != high
            if not open_.any():
                break
            near = near[open_]
            for a, b in np.unique(np.stack([low[open_], high[open_]]), axis=1).T.tolist():
                forest.join(int(homes[a]), int(homes[b]))
                x, y = group[a], group[b]
                group[group == max(x, y)] = min(x, y)
    return group


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares each anchor's visitors with its homes; rows come sorted by anchor and part, homes first."""
    forest, at, held, homes, group = Forest(), None, [], None, None
    for batch in batches:
        for anchor, part, visitor, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            fps = np.frombuffer(raw, np.uint64)
            if (anchor, part) != at:
                at, held, homes = (anchor, part), [], None
            if not visitor:
                held.append(fps)
            elif held:
                if homes is None:
                    homes = np.unique(np.concatenate(held))
                    group = np.arange(len(homes))
                group = _meet(homes, group, fps, forest)
    if forest.edges:
        edges = np.array(forest.edges, np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["u", "v"])


def links(distinct: DataFrame) -> DataFrame:
    """distinct: fp, each once. Gives u, v: edges whose components are those of all links within THRESHOLD bits."""
    n = distinct.count()
    m = min(21, max(6, round(np.log2(max(n, 1) / HOMES))))
    most = max(SPLIT, n // SPLITS)  # so that at most SPLITS anchors can have as many homes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, each = np.unique(_homes(batch.column("fp").to_numpy().view(np.uint64), m)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(each)], ["anchor", "n"])

    large = map_arrow(distinct, count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > most).collect()
    dealt = map_arrow(distinct, _deal(m, {r.anchor: -(-r.n // most) for r in large}), "anchor long, part int, visitor boolean, fps binary")
    return map_arrow(dealt.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "visitor"), _links, "u long, v long")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, rk, fp, component_id (the smallest doc_id reachable) and keeper (the rk of the document to keep) per row."""
    fps = materialise(fingerprints(docs, text), "simhash")
    rank = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "rk")
    distinct = materialise(fps.groupBy("fp").agg(F.min(rank).alias("first")), "simhash-distinct")
    roots = components(links(distinct.select("fp"))).withColumnsRenamed({"node": "fp"})
    grouped = distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("first"))
    answer = grouped.drop("first").join(least, "root").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.rk").alias("keeper"))
    return fps.join(answer, "fp").select("doc_id", "rk", "fp", "component_id", "keeper")


def drop_near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of docs for each component: that with the smallest doc_id; of rows with one doc_id and text, one."""
    key = "__inkgrid_rk"
    kept = near_duplicates(docs, text).where("rk = keeper").select(F.col("keeper").alias(key)).distinct()
    out = docs.withColumn(key, row_key(text=text)).join(kept, key, "left_semi")
    return out.dropDuplicates([key]).select(*(f"`{c}`" for c in docs.columns))
