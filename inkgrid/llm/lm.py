"""Language-model scoring with a log-frequency Bloom filter.

Training documents are those whose fold of five is not 1. Their tokens (words in lower case, then one end a document)
and pairs of adjacent tokens are counted exactly: tasks add up what they read, and one aggregation by cell of the hash
space, whose cells follow the bytes of text, adds up the rest. Each cell then writes its part of the filter: a count of
level q (levels grow by about BASE) enters the filter as the entries 1 to q, so that a count is read by probing level
after level until one is absent. A cell's part has BITS_EACH bits for each of its entries, whatever their number, so the
filter grows with the corpus, its false positives don't, and nothing is left out at any size.

A filter of at most BROADCAST bytes goes to every worker whole, which probes it as it reads texts. A larger one stays in
its cells: of each group of texts the distinct tokens and pairs, which come sorted and so by ranges of cells (PART of them),
are sent to the ranges as packed hashes and probed there, and a byte for each, its level, comes back in the same order.
Both ways read the same levels, and so give the same scores.

Scores: p(w | h) = (c(h w) + MU * p(w)) / (c(h) + MU) and p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), all c read from the
filter, a pair's never above its tokens'; h of the first word is the end of a text. The base score uses exact counts: those of
at most TOP of the most frequent tokens are broadcast (16 bytes each), the others' are joined.

Null texts are empty: one token, the end. With no training documents all counts are 0. Rows are told apart by their
place in a task's output, so repeated rows and null ids are scored each on its own.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrid.llm.text import fold
from inkgrid.session import map_arrow, materialise

BASE, PROBES, MU = 1.5, 4, 10.0
#: Bits for each entry of the filter, bytes of text to a cell, and the largest filter (with 16 bytes a cell) that is broadcast.
BITS_EACH, CELL_BYTES, BROADCAST = 10, 1 << 18, 128 << 20
TOP = 1 << 20
#: Cells that are probed together where the filter isn't broadcast; a power of two.
PART = 64
#: Bytes of text that are scored together, tokens whose counts a task adds up before it deals them out, and rows of a batch.
GROUP, DEAL, ROWS = 1 << 19, 1 << 20, 1 << 15
U = np.uint64
R = 0x9E3779B97F4A7C15 | 5
END = U(0x2545F4914F6CDD1D)
TABLE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
WHITE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(29))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(32))


class Powers:
    """R**i and R**-i modulo 2**64, as far as they were needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up))
            for name, r in (("up", R), ("down", pow(R, -1, 2**64))):
                steps = np.full(size, r, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up[:n], cls.down[:n]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash and the start of every word of a lower-case text; a polynomial over its bytes, mixed."""
    found, starts, at = [], [], 0
    while at < len(raw):
        cut = min(at + GROUP, len(raw))
        while cut < len(raw) and not WHITE[raw[cut]]:
            cut += 1
        piece = np.frombuffer(raw, np.uint8, cut - at, at)
        white = np.concatenate(([True], WHITE[piece], [True]))
        edge = np.flatnonzero(white[1:] != white[:-1])
        start, end = edge[::2], edge[1::2]
        up, down = Powers.to(len(piece))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(TABLE[piece] * up)))
        found.append(mix((sums[end] - sums[start]) * down[np.minimum(start, len(piece) - 1)] + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93)) if len(start) else np.zeros(0, np.uint64))
        starts.append(start + at)
        at = cut
    return (np.concatenate(found), np.concatenate(starts)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def groups(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Groups of texts: the first one's position, their tokens (each text's end too) and where each text's tokens begin, with the total last."""
    at = 0
    while at < len(texts):
        parts, size, i = [], 0, at
        while i < len(texts) and size < GROUP:
            parts.append((texts[i].as_py() or "").encode("utf-8", "replace").lower())
            size += len(parts[-1]) + 1
            i += 1
        words, starts = word_hashes(b" ".join(parts))
        offsets = np.cumsum([0] + [len(p) + 1 for p in parts])
        before = np.searchsorted(starts, offsets)
        doc = np.repeat(np.arange(len(parts)), np.diff(before))
        tokens = np.full(len(words) + len(parts), END)
        tokens[np.arange(len(words)) + doc] = words
        yield at, tokens, before + np.arange(len(parts) + 1)
        at = i


def pairs(tokens: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The hash of every token with the one before it; before the first stands an end."""
    before = np.concatenate(([END], tokens[:-1]))
    before[begins[:-1]] = END
    return mix(before * U(0x9FB21C651E98DF25) ^ tokens)


def levels() -> np.ndarray:
    """The least count of every level."""
    out = [1]
    while out[-1] < 2**60:
        out.append(max(out[-1] + 1, int(np.ceil(BASE * out[-1]))))
    return np.array(out, np.int64)


LEVELS = levels()
#: The count that a level stands for: the mean of its counts; 0 for none.
READ = np.concatenate(([0.0], (LEVELS[:-1] + LEVELS[1:] - 1) / 2))


def level(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, counts, side="right")


def places(h: np.ndarray, q: np.ndarray | int, bits: np.ndarray | int) -> list[np.ndarray]:
    """The bits, within a cell of so many bits, of the entries (h, q)."""
    g = mix(h + np.asarray(q).astype(np.uint64) * U(0x9E3779B97F4A7C15))
    low, high = g & U(0xFFFFFFFF), (g >> U(32)) | U(1)
    size = np.asarray(bits).astype(np.uint64)
    return [((low + U(i) * high) % size).astype(np.int64) for i in range(PROBES)]


def write_cell(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """A cell's part of the filter, of whole words of 64 bits."""
    reached = level(counts)
    bits = 64 * max(1, -(-BITS_EACH * int(reached.sum()) // 64))
    filled = np.zeros(bits, bool)
    for j in range(1, int(reached.max(initial=0)) + 1):
        for p in places(hashes[reached >= j], j, bits):
            filled[p] = True
    return np.packbits(filled, bitorder="little").tobytes()


class Filter:
    """Cells of the filter, as workers probe them: bits has the parts one after the other, starts where each begins (bytes), with the total last; first of cells, if not all."""

    def __init__(self, bits: bytes | np.ndarray, starts: np.ndarray, first: int = 0, cells: int = 0) -> None:
        self.bytes, self.starts = bits if isinstance(bits, np.ndarray) else np.frombuffer(bits, np.uint8), starts
        self.first, self.cells = first, cells or len(starts) - 1

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The levels that the filter holds for hashes, by repeated membership probes; 0 for a hash of a cell without entries."""
        cell = cell_of(h, self.cells) - self.first
        base, bits = self.starts[cell], 8 * (self.starts[cell + 1] - self.starts[cell])
        reached = np.zeros(len(h), np.int8)
        open_ = np.flatnonzero(bits > 0)
        q = 1
        while len(open_) and q < len(READ):
            there = np.ones(len(open_), bool)
            for p in places(h[open_], q, bits[open_]):
                there &= (self.bytes[base[open_] + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1 == 1
            open_ = open_[there]
            reached[open_] = q
            q += 1
        return reached


def cell_of(h: np.ndarray, cells: int) -> np.ndarray:
    return (h >> U(64 - (cells.bit_length() - 1))).astype(np.int64) if cells > 1 else np.zeros(len(h), np.int64)


def cell_column(cells: int) -> Column:
    """cell_of for a column h of signed longs."""
    return F.shiftrightunsigned("h", 64 - (cells.bit_length() - 1)).cast("long") if cells > 1 else F.lit(0).cast("long")


def batches_of(columns: list[np.ndarray], types: tuple, names: list[str]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + ROWS], t) for c, t in zip(columns, types, strict=True)], names)


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows pair, h, n: how often each token (pair is false) and each pair of tokens occurs in some of the texts."""

    def flush(seen: tuple[list, list]) -> Iterator[pa.RecordBatch]:
        for pair in (False, True):
            h, n = np.unique(np.concatenate(seen[pair]), return_counts=True)
            seen[pair].clear()
            yield from batches_of([np.full(len(h), pair), h.view(np.int64), n], (pa.bool_(), pa.int64(), pa.int64()), ["pair", "h", "n"])

    seen, size = ([], []), 0
    for batch in batches:
        for _, tokens, begins in groups(batch.column("text")):
            seen[0].append(tokens)
            seen[1].append(pairs(tokens, begins))
            size += len(tokens)
            if size >= DEAL:
                yield from flush(seen)
                size = 0
    if size:
        yield from flush(seen)


CELLS = "cell long, filter binary, h long, n long"


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell: a row (cell, filter) for each cell, and a row (cell, h, n) for every token."""
    types, names = (pa.int64(), pa.binary(), pa.int64(), pa.int64()), ["cell", "filter", "h", "n"]

    def done(cell: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, h, n = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("pair", "h", "n"))
        filled = write_cell(h.view(np.uint64), n)
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((cell, filled, None, None), types, strict=True)], names)
        h, n = h[~pair], n[~pair]
        for i in range(0, len(h), ROWS):
            m = len(h[i : i + ROWS])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, cell)), pa.nulls(m, pa.binary()), pa.array(h[i : i + ROWS]), pa.array(n[i : i + ROWS])], names)

    for cell, held in by_key(batches, "cell"):
        yield from done(cell, held)


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Each value of a column by which the rows are sorted, with its rows as slices of batches."""
    at, held = None, []
    for batch in batches:
        values = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and values[a] != at:
                yield at, held
                held = []
            at = int(values[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield at, held


MARK = b"inkgrid language model, whole\n::"


class Model:
    """What workers score with: the most frequent tokens with their counts, totals, and the filter where it is broadcast."""

    def __init__(self, filter_: Filter | None, top: np.ndarray, counts: np.ndarray, n: int, v: int) -> None:
        order = np.argsort(top)
        self._set(filter_, top[order], counts[order], n, v)

    def _set(self, filter_: Filter | None, top: np.ndarray, counts: np.ndarray, n: int, v: int) -> None:
        self.filter, self.n, self.v, self.top, self.counts = filter_, n, v, top, counts
        self.mass = n + 0.5 * (v + 1)

    def packed(self) -> bytes:
        """The model as bytes: MARK, five sizes, the tokens, their counts, where the filter's cells begin, and the filter."""
        starts, bits = (self.filter.starts, self.filter.bytes) if self.filter is not None else (np.zeros(0, np.int64), np.zeros(0, np.uint8))
        sizes = np.array([self.n, self.v, len(self.top), len(starts), len(bits)], "<i8")
        return b"".join([MARK, *(x.tobytes() for x in (sizes, self.top.astype("<u8"), self.counts.astype("<i8"), starts.astype("<i8"), bits))])

    @classmethod
    def unpacked(cls, raw: bytes | mmap.mmap, at: int = 0) -> Model:
        """The model whose MARK stands at a place; its filter is a view, the others are copies, which are aligned."""
        at += len(MARK)
        n, v, tokens, starts, bits = np.frombuffer(raw, "<i8", 5, at).tolist()
        at, parts = at + 40, []
        for kind, size in (("<u8", tokens), ("<i8", tokens), ("<i8", starts), ("u1", bits)):
            part = np.frombuffer(raw, kind, size, at) if size else np.zeros(0, kind)
            parts.append(part if kind == "u1" else part.copy())
            at += part.nbytes
        model = cls.__new__(cls)
        model._set(Filter(parts[3], parts[2]) if starts else None, parts[0], parts[1], n, v)
        return model

    @classmethod
    def of(cls, broadcast) -> Model:
        """The model of a broadcast of its bytes, mapped from the broadcast's local file where there is one, so that an executor's workers share the pages."""
        try:
            with open(broadcast._path, "rb") as f:
                mapped = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
            at = mapped.find(MARK, 0, 256)
        except (AttributeError, TypeError, OSError, ValueError):
            at = -1
        return cls.unpacked(mapped, at) if at >= 0 else cls.unpacked(broadcast.value)

    def exact(self, h: np.ndarray) -> np.ndarray:
        """Counts of the most frequent tokens; -1 for others."""
        if not len(self.top):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.top, h), len(self.top) - 1)
        return np.where(self.top[at] == h, self.counts[at], -1)

    def score(self, begins: np.ndarray, token_levels: np.ndarray, pair_levels: np.ndarray) -> np.ndarray:
        """The log10 probability of each text, from the levels of its tokens and of its pairs."""
        c = READ[token_levels]
        context = np.concatenate((c[:1], c[:-1]))
        context[begins[:-1]] = c[begins[1:] - 1]  # the end's count
        c2 = np.minimum(np.minimum(READ[pair_levels], context), c)
        return np.add.reduceat(np.log10((c2 + MU * (c + 0.5) / self.mass) / (context + MU)), begins[:-1])


def fit(docs: DataFrame, text: str = "text") -> tuple[Model, DataFrame, DataFrame, int]:
    """The model of the training documents, the table of exact counts (h, n) of tokens, that of the filter (cell, filter), and the number of cells."""
    train = docs.where(fold(F.col("doc_id"), 5) != 1).select(F.col(text).alias("text"))
    size = docs.select(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    cells = 1 << max(4, int(np.ceil(np.log2(max(1, size / CELL_BYTES)))))
    dealt = map_arrow(train, _deal, "pair boolean, h long, n long").withColumn("cell", cell_column(cells)).repartition("cell")
    counted = dealt.groupBy("cell", "pair", "h").agg(F.sum("n").alias("n")).sortWithinPartitions("cell")  # within the same partitions
    table = materialise(map_arrow(counted, _write, CELLS), "lm-counts")
    counts, filter_ = table.where("h is not null").select("h", "n"), table.where("filter is not null").select("cell", "filter")

    # the least size of counts of which there are no more than TOP
    bucket = F.floor(4 * F.log2("n")).cast("int")
    sizes = sorted(counts.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).collect(), reverse=True)
    n, v = sum(r.n for r in sizes), sum(r.v for r in sizes)
    least, held = 0, 0
    for r in sizes:
        held += r.v
        if held > TOP:
            least = r.bucket + 1
            break
    top = counts.where(bucket >= least).toArrow()
    room = filter_.agg(F.sum(F.octet_length("filter").cast("long"))).first()[0] or 0
    whole = None
    if room + 16 * cells <= BROADCAST:
        starts, parts = np.zeros(cells + 1, np.int64), bytearray(room)
        for r in filter_.select("cell", F.octet_length("filter").alias("size")).toArrow().to_pylist():
            starts[r["cell"] + 1] = r["size"]
        starts = np.cumsum(starts)
        for r in filter_.toLocalIterator():
            parts[starts[r.cell] : starts[r.cell + 1]] = r.filter
        whole = Filter(bytes(parts), starts)
    return Model(whole, top["h"].to_numpy().view(np.uint64), top["n"].to_numpy(), n, v), counts, filter_, cells


#: Rows of what is read from texts: of a text (kind 0), of a rarer token in a text (1), of what a group of texts asks of a range of cells (2), of a group (3).
NAMES = ["kind", "row", "doc_id", "n_tokens", "n_known", "base", "score", "pair", "h", "times", "part", "packed", "begins"]
SCHEMA = "kind byte, row long, doc_id long, n_tokens long, n_known long, base double, score double, pair boolean, h long, times int, part long, packed binary, begins binary"
TYPES = (pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())


def _rows(kind: int, m: int, **columns) -> Iterator[pa.RecordBatch]:
    """Batches of m rows of a kind; columns that aren't given are null."""
    for i in range(0, m, ROWS):
        k = min(ROWS, m - i)
        every = {"kind": np.full(k, kind, np.int8)} | {c: v[i : i + k] for c, v in columns.items()}
        yield pa.RecordBatch.from_arrays([pa.array(every[c], t) if c in every else pa.nulls(k, t) for c, t in zip(NAMES, TYPES, strict=True)], NAMES)


def parts_of(cells: int) -> int:
    return max(1, cells // PART)


def _read(broadcast, parts: int):
    """A row for each text, with what the most frequent tokens give to its base score, and the other tokens of each text.

    With a filter at hand, the rows have the score too; without, all that is to be probed and the groups' tokens follow, these as
    the distinct ones and each one's place among them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.of(broadcast)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column("doc_id")
            for at, tokens, begins in groups(batch.column("text")):
                texts = len(begins) - 1
                own = number + np.arange(texts)
                number += texts
                unique, where = np.unique(tokens, return_inverse=True)
                exact = m.exact(unique)
                known = exact >= 0
                base = np.where(known, np.log10((np.maximum(exact, 0) + 0.5) / m.mass), 0.0)
                both, at_pair = np.unique(pairs(tokens, begins), return_inverse=True)
                total = lambda x: np.add.reduceat(x, begins[:-1])
                columns = {"row": own, "doc_id": ids.slice(at, texts), "n_tokens": np.diff(begins), "n_known": total((known & (exact > 0))[where].astype(np.int64)), "base": total(base[where])}
                if m.filter is not None:
                    columns["score"] = m.score(begins, m.filter.levels(unique)[where], m.filter.levels(both)[at_pair])
                yield from _rows(0, texts, **columns)
                rest = np.flatnonzero(~known[where])
                if len(rest):
                    text_of = np.searchsorted(begins, rest, side="right") - 1
                    some, times = np.unique(np.stack([text_of, where[rest]]), axis=1, return_counts=True)
                    yield from _rows(1, len(times), row=own[some[0]], h=unique[some[1]].view(np.int64), times=times.astype(np.int32))
                if m.filter is None:
                    for pair, h in ((False, unique), (True, both)):
                        part = cell_of(h, parts)
                        cuts = np.flatnonzero(np.diff(part)) + 1
                        some = [x.tobytes() for x in np.split(h, cuts)]
                        yield from _rows(2, len(some), row=np.full(len(some), own[0]), pair=np.full(len(some), pair), part=part[np.concatenate(([0], cuts))], packed=some)
                    yield from _rows(3, 1, row=own[:1], packed=[unique.tobytes() + where.astype("<u4").tobytes()], begins=[np.append(len(unique), begins).astype(np.int64).tobytes()])

    return run


def _probe(cells: int, parts: int):
    """Rows come sorted by part and kind, its cells of the filter first; gives row, pair, part and the levels of the hashes packed in each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = cells // parts
        at, held, filter_ = None, {}, None
        for part, some in by_key(batches, "part"):
            if part != at:
                at, held, filter_ = part, {}, None
            for batch in some:
                own = batch.filter(pc.is_valid(batch.column("cell")))
                held |= dict(zip(own.column("cell").to_pylist(), own.column("packed").to_pylist(), strict=True))
                asked = batch.filter(pc.is_null(batch.column("cell")))
                if not asked.num_rows:
                    continue
                if filter_ is None:
                    filled = [held.get(part * each + i, b"") for i in range(each)]
                    filter_ = Filter(b"".join(filled), np.cumsum([0, *map(len, filled)]), part * each, cells)
                found = [filter_.levels(np.frombuffer(raw, np.uint64)).astype(np.uint8).tobytes() for raw in asked.column("packed").to_pylist()]
                yield pa.RecordBatch.from_arrays([asked.column("row"), asked.column("pair"), asked.column("part"), pa.array(found, pa.binary())], ["row", "pair", "part", "packed"])

    return run


def _finish(broadcast):
    """Rows come sorted by group, kind, pair and part, the group's tokens first, then the levels found; gives row and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.of(broadcast)
        for first, some in by_key(batches, "row"):
            begins = np.frombuffer(some[0].column("begins")[0].as_py(), np.int64)
            n, begins, raw = int(begins[0]), begins[1:], some[0].column("packed")[0].as_py()
            unique, where = np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, "<u4", offset=8 * n)
            found = pa.Table.from_batches(some).slice(1)
            levels = np.frombuffer(b"".join(found.column("packed").to_pylist()), np.uint8)
            at = np.unique(pairs(unique[where], begins), return_inverse=True)[1]
            score = m.score(begins, levels[:n][where], levels[n:][at])
            yield pa.RecordBatch.from_arrays([pa.array(first + np.arange(len(score))), pa.array(score)], ["row", "score"])

    return run


def _far(rows: DataFrame, filter_: DataFrame, cells: int, broadcast) -> DataFrame:
    """row and score of every text, with the filter probed in its cells."""
    none = lambda kind, *names: {c: F.lit(None).cast(kind) for c in names}
    there = filter_.select("cell", F.col("filter").alias("packed")).withColumns({"kind": F.lit(0), "part": F.floor(F.col("cell") / (cells // parts_of(cells))), "row": F.lit(None).cast("long"), "pair": F.lit(None).cast("boolean")})
    asked = rows.where("kind = 2").select("row", "pair", "part", "packed").withColumns({"kind": F.lit(1)} | none("long", "cell"))
    levels = map_arrow(there.unionByName(asked).repartition("part").sortWithinPartitions("part", "kind"), _probe(cells, parts_of(cells)), "row long, pair boolean, part long, packed binary")
    streams = rows.where("kind = 3").select("row", "packed", "begins").withColumns({"kind": F.lit(0)} | none("boolean", "pair") | none("long", "part"))
    both = streams.unionByName(levels.withColumns({"kind": F.lit(1)} | none("binary", "begins")))
    return map_arrow(both.repartition("row").sortWithinPartitions("row", "kind", "pair", "part"), _finish(broadcast), "row long, score double")


def score(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    model, counts, filter_, cells = fit(docs, text)
    broadcast = docs.sparkSession.sparkContext.broadcast(model.packed())
    read = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")), _read(broadcast, parts_of(cells)), SCHEMA)
    rows = materialise(read, "lm-scores")
    known = F.coalesce("n", F.lit(0))
    more = rows.where("kind = 1").select("row", "h", "times").join(counts, "h", "left")
    sums = more.groupBy("row").agg(F.sum(F.when(known > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.log10((known + 0.5) / F.lit(model.mass))).alias("more_base"))
    out = rows.where("kind = 0").select("row", "doc_id", "n_tokens", "n_known", "base", "score").join(sums, "row", "left")
    if model.filter is None:
        out = out.drop("score").join(_far(rows, filter_, cells, broadcast), "row")
    return out.select(
        "doc_id", (fold(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score",
    )
