"""Toxicity from the nearest labelled examples by exact TF-IDF cosine, frequent words densely and the others by postings.

The classifier is fitted on a bounded sample of labelled rows: at most EXAMPLES of at most LONGEST bytes, half of them of
each class, chosen by a hash of doc_id; classes are weighted by how many labelled rows they stand for. A text's vector
has every one of its words, those of no example too: (1 + ln tf) * idf * gain, at length one. gain is the word's
information gain on the label among the examples, smoothed and never 0. The NEIGHBOURS nearest examples vote with
1 / (EPSILON + 1 - cosine). Votes become probabilities by isotonic regression on the examples' own votes, each without
itself. Neighbours, not only the score, are returned.

Every text is compared with all examples. Blocks of texts meet the examples in the DENSE terms of the most examples by one
product in single precision; the other terms' postings are added in double. Weights are not negative, so the error of a
cosine is relative and bounded, and only examples whose estimate lies within that bound of the last neighbour's can be
neighbours: these get cosines summed in double, each by itself, so that neighbours are exact and don't depend on what else
is in the block. Ties go to the earlier example.

Null and empty texts have no neighbours; their score is the share of toxic rows among such examples. Texts without any
word of an example score the share of toxic rows. Without labelled rows of both classes the score is the smoothed share
of toxic rows. Labels of one doc_id count once, as toxic if any is, and so do repeated rows with its text (the longest of
several texts); labels without doc_id, value or document take no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from inkgrid.llm.text import fold
from inkgrid.session import map_arrow, materialise

EXAMPLES, LONGEST, NEIGHBOURS, BLOCK, DENSE = 4_000, 1 << 15, 15, 64, 512
#: What the gain of a word is at least, and the distance added to that of a neighbour.
LEAST, EPSILON = 1e-6, 0.05
#: How many texts a task remembers, how many spellings of known words, and how many characters of texts are read together.
CACHE, TOKENS, TOGETHER, EVIDENCE = 20_000, 1 << 18, 1 << 21, 3
WORD = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of letters of a text in lower case, as hashes, and how often each occurs."""
    found = Counter(WORD.findall((text or "").lower()))
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(w) for w in found), np.uint64, len(found))
    return h, np.fromiter(found.values(), np.int64, len(found))


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of some spans, one span after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


def gains(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """The information gain on the class of words found in a of n_a and b of n_b examples, smoothed by half an example each way."""
    total, gain = n_a + n_b + 2, np.full(len(a), LEAST)
    share = (a + b + 1) / total
    for held, n in ((a, n_a), (b, n_b)):
        of_class = (n + 1) / total
        with_, without = (held + 0.5) / total, (n - held + 0.5) / total
        gain += with_ * np.log(with_ / (share * of_class)) + without * np.log(without / ((1 - share) * of_class))
    return np.maximum(gain, LEAST)


class Index:
    """Vectors of examples: the DENSE terms of the most examples as a matrix, the others as postings by term."""

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, n_terms: int) -> None:
        self.n = n
        frequent = np.argsort(-np.bincount(term, minlength=n_terms), kind="stable")[:DENSE]
        self.column = np.full(n_terms, -1, np.int32)
        self.column[frequent] = np.arange(len(frequent))
        column = self.column[term]
        self.exact = np.zeros((n, len(frequent)))
        self.exact[example[column >= 0], column[column >= 0]] = weight[column >= 0]
        self.dense = np.ascontiguousarray(self.exact.T, np.float32)
        # a sum of that many rounded products of rounded factors is off by a share of (terms + 2) * 2**-24 at most; this is over
        # twice that, for the estimate and for the last neighbour's, and twice over
        self.slack = (len(frequent) + 8) * 2.0**-22
        order = np.lexsort((example, term))
        order = order[column[order] < 0]
        self.example, self.weight = example[order].astype(np.int32), weight[order]
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, but: int = -1) -> list[tuple[float, int]]:
        """The k examples of largest cosine over 0 (cosine, example), without example but."""
        return self.nearest_all([(term, weight)], k, [but])[0]

    def nearest_all(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, but: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """nearest for each of several vectors, BLOCK of them at once."""
        out = []
        for i in range(0, len(vectors), BLOCK):
            some = vectors[i : i + BLOCK]
            columns = [self.column[term] for term, _ in some]
            rows = np.zeros((len(some), len(self.dense)))
            for row, column, (_, weight) in zip(rows, columns, some, strict=True):
                row[column[column >= 0]] = weight[column >= 0]
            near = rows.astype(np.float32) @ self.dense
            for j, (term, weight) in enumerate(some):
                rare = columns[j] < 0
                out.append(self._among(near[j], rows[j], term[rare], weight[rare], k, but[i + j] if but else -1))
        return out

    def _among(self, near: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, but: int) -> list[tuple[float, int]]:
        """The nearest, by estimates of the dense terms' part, these terms' weights, and the other terms and theirs."""
        starts = self.start[term]
        sizes = self.start[term + 1] - starts
        at = spans(starts, sizes)
        rest = np.bincount(self.example[at], np.repeat(weight, sizes) * self.weight[at], self.n)
        near = near + rest
        if but >= 0:
            near[but] = 0
        least = np.partition(near, -k)[-k] if k < self.n else 0.0
        some = np.flatnonzero((near >= least * (1 - self.slack) - 2e-12) & (near > 0))
        # row by row, as a matrix product would let a sum depend on its place among others
        cosine = np.round((self.exact[some] * row).sum(1) + rest[some], 12)
        best = np.lexsort((some, -cosine))[:k]
        return [(c, e) for c, e in zip(cosine[best].tolist(), some[best].tolist(), strict=True) if c > 0]


class Model:
    """examples: doc_id, toxic, hashes and counts of each. weights: how many labelled rows an example of each class stands for."""

    def __init__(self, examples: list[tuple[int, bool, np.ndarray, np.ndarray]], weights: dict[bool, float]) -> None:
        self.ids, self.toxic = [e[0] for e in examples], np.array([e[1] for e in examples], bool)
        self.weight = np.where(self.toxic, weights.get(True, 0.0), weights.get(False, 0.0))
        none = np.zeros(0, np.uint64)
        sizes = np.array([len(e[2]) for e in examples], np.int64)
        example = np.repeat(np.arange(len(examples)), sizes)
        self.vocabulary, term = np.unique(np.concatenate([none, *(e[2] for e in examples)]), return_inverse=True)
        n, v = len(examples), len(self.vocabulary)
        a, b = np.bincount(term[self.toxic[example]], minlength=v), np.bincount(term[~self.toxic[example]], minlength=v)
        n_a = int(self.toxic.sum())
        idf = lambda df: 1 + np.log((1 + n) / (1 + df))
        self.idf = idf(a + b) * gains(a, b, n_a, n - n_a)
        self.unseen = float(idf(0) * gains(np.zeros(1), np.zeros(1), n_a, n - n_a)[0])
        raw = (1 + np.log(np.concatenate([none.astype(np.int64), *(e[3] for e in examples)]))) * self.idf[term]
        length = np.sqrt(np.bincount(example, raw * raw, max(n, 1)))
        self.index = Index(example, term, raw / length[example] if len(raw) else raw, n, v)
        total = {c: self.weight[self.toxic == c].sum() for c in (True, False)}
        self.base = float((total[True] + 1) / (total[True] + total[False] + 2))
        empty = {c: self.weight[(self.toxic == c) & (sizes == 0)].sum() for c in (True, False)}
        self.unknown = float((empty[True] + self.base) / (empty[True] + empty[False] + 1))
        self.sure = n_a > 0 and n_a < n
        self.knots = self.values = np.zeros(0)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The terms of hashes, -1 for those not in the vocabulary."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def vector(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms of the vocabulary, and their weights in the vector of all words."""
        at = self.find(hashes)
        return self.unit(at[at >= 0], counts[at >= 0], counts[at < 0])

    def unit(self, term: np.ndarray, counts: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms in order, and their weights in the vector of them and of other words, by how often each occurs."""
        order = np.argsort(term)
        term, w = term[order], (1 + np.log(counts[order])) * self.idf[term[order]]
        unseen = (1 + np.log(np.sort(others))) * self.unseen
        return term, w / np.sqrt((w * w).sum() + (unseen * unseen).sum()) if len(w) else w

    def read(self, texts: list[str | None], known: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """vector(*terms(t)) of each text, None for one without words. known: the terms of spellings met before, which grows."""
        # cut at white space first, so that each spelling of the texts ("word," too) is looked into once
        pieces = pc.utf8_split_whitespace(pa.array([(t or "").lower() for t in texts], pa.large_string()))
        lengths, spelled = pc.list_value_length(pieces).to_numpy(), pieces.flatten().dictionary_encode()
        del pieces
        spellings = spelled.dictionary.to_numpy(zero_copy_only=False).tolist()
        m = len(spellings)
        # spellings are counted before they become words, and in place: a text may be long
        every = np.repeat(np.arange(len(texts)) * m, lengths)
        every += spelled.indices.to_numpy()
        every.sort()
        first = np.flatnonzero(np.diff(every, prepend=-1))
        text, codes = np.divmod(every[first], max(m, 1))
        times = np.diff(first, append=len(every))
        term, begins, sizes = np.fromiter(map(known.get, spellings, repeat(-1)), np.int64, m), np.arange(m), np.ones(m, np.int64)
        words: dict[str, int] = {}
        inside: list[int] = []  # the words of spellings not known, one spelling after the other
        alone = {}
        for j in np.flatnonzero(term < 0).tolist():
            some = [words.setdefault(w, len(words)) for w in WORD.findall(spellings[j])]
            begins[j], sizes[j] = m + len(inside), len(some)
            inside += some
            if len(some) == 1:
                alone[spellings[j]] = some[0]
        digest = xxhash.xxh3_64_intdigest
        found = self.find(np.fromiter((digest(w) for w in words), np.uint64, len(words))).tolist()
        new = {s: found[w] for s, w in alone.items() if found[w] >= 0}
        if len(known) + len(new) > TOKENS:
            known.clear()
        known.update(new)
        n = len(self.vocabulary)
        of = np.array([i if i >= 0 else n + w for w, i in enumerate(found)], np.int64)
        term = np.append(term, of[np.array(inside, np.int64)])
        begins, sizes = begins[codes], sizes[codes]
        every = np.repeat(text, sizes) * (n + len(words)) + term[spans(begins, sizes)]
        order = np.argsort(every)
        first = np.flatnonzero(np.diff(every[order], prepend=-1))
        counts = np.add.reduceat(np.repeat(times, sizes)[order], first) if len(first) else first
        text, term = np.divmod(every[order[first]], max(n + len(words), 1))
        ends = np.searchsorted(text, np.arange(len(texts) + 1))
        seen = ends[:-1] + np.bincount(text[term < n], minlength=len(texts))
        return [self.unit(term[a:b], counts[a:b], counts[b:c]) if a < c else None for a, b, c in zip(ends[:-1], seen, ends[1:], strict=True)]

    def vote(self, near: list[tuple[float, int]]) -> float:
        if not near:
            return self.base
        some = np.array([i for _, i in near])
        w = self.weight[some] / (EPSILON + 1 - np.minimum(1, np.array([c for c, _ in near])))
        return float((w * self.toxic[some]).sum() / w.sum())

    def own_votes(self, some: list[int], found: list[tuple[np.ndarray, np.ndarray]]) -> list[float]:
        """The votes on some examples by their hashes and counts, each without itself."""
        return [self.vote(near) for near in self.index.nearest_all([self.vector(*f) for f in found], NEIGHBOURS, some)]

    def calibrate(self, votes: np.ndarray, some: np.ndarray) -> None:
        """votes: those on examples some, each without itself."""
        self.knots, self.values = isotonic(votes, self.toxic[some].astype(float), self.weight[some])

    def scores(self, texts: list[str | None], known: dict[str, int]) -> list[tuple[float, list[tuple[float, int]]]]:
        """The probability that each text is toxic, and its neighbours (cosine, example). known as of read."""
        vectors = self.read(texts, known)
        if not self.sure:
            return [(self.unknown if v is None else self.base, []) for v in vectors]
        near = iter(self.index.nearest_all([v for v in vectors if v is not None], NEIGHBOURS))
        return [(self.unknown, []) if v is None else self.of(next(near)) for v in vectors]

    def of(self, near: list[tuple[float, int]]) -> tuple[float, list[tuple[float, int]]]:
        if not near or not len(self.knots):
            return self.base, near
        return float(np.interp(self.vote(near), self.knots, self.values)), near


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled neighbours: the increasing step function nearest to y, as knots and values; each pool is smoothed by one vote for 0.5."""
    pools: list[list[float]] = []
    for i in np.argsort(x, kind="stable").tolist():
        pools.append([x[i], x[i], w[i] * y[i], w[i]])
        while len(pools) > 1 and (pools[-2][1] == pools[-1][0] or pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]):
            _, last, s, n = pools.pop()
            pools[-1] = [pools[-1][0], last, pools[-1][2] + s, pools[-1][3] + n]
    value = [(s + 0.5) / (n + 1) for _, _, s, n in pools]
    for i in range(1, len(value)):
        value[i] = max(value[i], value[i - 1])
    return np.array([e for p in pools for e in p[:2]]), np.repeat(value, 2)


def parts(texts: dict[bytes, str | None]) -> Iterator[list[bytes]]:
    """The keys of texts, in parts of at most TOGETHER characters where a text is not longer itself."""
    some, size = [], 0
    for k, t in texts.items():
        if some and size + len(t or "") > TOGETHER:
            yield some
            some, size = [], 0
        some.append(k)
        size += len(t or "")
    if some:
        yield some


EXAMPLE = "doc_id long, toxic boolean, hashes binary, counts binary"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [terms(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *(pa.array([f[i].tobytes() for f in found], pa.binary()) for i in (0, 1))], ["doc_id", "toxic", "hashes", "counts"])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model:
    """The model of the labelled rows whose fold of five is not 0."""
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id"), 5) != 0))
    known = materialise(known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).alias("toxic")), "toxic-labels")
    size = F.octet_length(F.coalesce(F.col(text), F.lit("")))
    fits = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size")).join(known, "doc_id").where(F.col("size") <= LONGEST).select("doc_id", "toxic").distinct(), "toxic-known")
    mixed = lambda toxic: fits.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES // 2)
    sample = materialise(mixed(True).union(mixed(False)), "toxic-sample")  # at most EXAMPLES narrow rows, so it may be broadcast
    # one text for each doc_id, so that the sample's bound holds: the longest, and of those the one with the least hash
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), size.alias("size"), F.xxhash64(F.col(text)).alias("hash")).where(F.col("size") <= LONGEST).join(F.broadcast(sample), "doc_id")
    chosen = chosen.groupBy("doc_id", "toxic").agg(F.max_by("text", F.struct("size", "hash")).alias("text"))
    rows = materialise(map_arrow(chosen, _count, EXAMPLE), "toxic-examples")
    stands = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = rows.orderBy("doc_id").toArrow()
    examples = [(d, t, np.frombuffer(h, np.uint64), np.frombuffer(c, np.int64)) for d, t, h, c in zip(*(held.column(c).to_pylist() for c in ("doc_id", "toxic", "hashes", "counts")), strict=True)]
    sizes = Counter(e[1] for e in examples)
    model = Model(examples, {c: stands.get(c, 0) / sizes[c] for c in sizes})
    if model.sure:
        sent = spark.sparkContext.broadcast(model)

        def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = sent.value
            at = {d: i for i, d in enumerate(m.ids)}
            for batch in batches:
                found = [(at[d], (np.frombuffer(h, np.uint64), np.frombuffer(c, np.int64))) for d, h, c in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "hashes", "counts")), strict=True) if len(h)]
                some = [i for i, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(m.own_votes(some, [f for _, f in found]), pa.float64())], ["i", "vote"])

        # at most EXAMPLES rows are sorted here: an orderBy would take all votes twice, once to find its ranges
        own = map_arrow(rows.repartition(spark.sparkContext.defaultParallelism), votes, "i long, vote double").toArrow().sort_by("i")
        model.calibrate(own.column("vote").to_numpy(), own.column("i").to_numpy())
    return model


def score(docs: DataFrame, labels: DataFrame, text: str = "text", score: str = "score", evidence: str = "evidence") -> DataFrame:
    """docs with a toxicity score and the nearest EVIDENCE examples: doc_id, cosine and whether they are toxic.

    Columns of docs that have these names already are replaced.
    """
    docs = docs.drop(score, evidence)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text))
    held = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = model.value, {}
        seen: dict[bytes, tuple[float, list[dict]]] = {}
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            keys = [xxhash.xxh3_128_digest((t or "").encode("utf-8", "replace")) for t in texts]
            new = {k: t for k, t in zip(keys, texts, strict=True) if k not in seen}
            if len(seen) + len(new) > CACHE:
                seen.clear()
                new = dict(zip(keys, texts, strict=True))
            for some in parts(new):
                for k, (p, near) in zip(some, m.scores([new[k] for k in some], known), strict=True):
                    seen[k] = p, [{"doc_id": m.ids[e], "cosine": c, "toxic": bool(m.toxic[e])} for c, e in near[:EVIDENCE]]
            found = [seen[k] for k in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s for s, _ in found], pa.float64()), pa.array([w for _, w in found], held)], [*batch.schema.names, score, evidence])

    element = StructType([StructField("doc_id", LongType()), StructField("cosine", DoubleType()), StructField("toxic", BooleanType())])
    return map_arrow(docs, run, StructType([*docs.schema.fields, StructField(score, DoubleType()), StructField(evidence, ArrayType(element))]))
