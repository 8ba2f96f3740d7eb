"""Byte-pair encoding and decoding by speculation and verification.

A text is split at special tokens, normalised, lower-cased and cut into pieces as the vocabulary file says. For a piece
not seen lately, greedy longest match proposes tokens; a vectorised check of all adjacent pairs tests whether any merge
of lower rank would have crossed a boundary between two proposed tokens. Where none would, the proposal is what exact
merging gives; only the other pieces are merged exactly. Null texts count as empty and give no ids.

The vocabulary file is read on the driver and sent to the workers once (its size does not depend on the data).
A task keeps the pieces it saw last, in two generations of CACHE pieces at most, and forgets them when it ends, since
workers outlive their tasks and would hold them beside the stages that follow.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from inkgrid.session import map_arrow

CACHE = 400_000
#: Characters of text that are encoded together; a longer text is a group of its own.
GROUP = 1_000_000
#: Symbols up to which merging scans all pairs instead of keeping a heap.
SHORT = 40
#: Pieces longer than this are not kept in the cache.
LONG = 64
NEVER = np.int64(2**40)
#: Fixed value: the white space of the vocabulary's regular expression.
WHITE = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Vocabulary:
    """The tables of a byte-level BPE vocabulary with word ends, as its JSON file states them."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model = spec["model"]
        if model["type"] != "BPE" or spec["decoder"] or spec["post_processor"] or any(model[k] for k in ("unk_token", "dropout", "continuing_subword_prefix", "ignore_merges")):
            raise ValueError("only byte-level BPE with word ends and without decoder is read")
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = added
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.tokens = [""] * (1 + max([*self.ids.values(), *added.values()]))
        for token, i in [*self.ids.items(), *added.items()]:
            self.tokens[i] = token
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.piece = regex.compile(pattern.replace("[^\\s", f"[^{WHITE}").replace("\\s", f"[{WHITE}]"))
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        n = len(self.tokens)
        self.left, self.right, self.rank = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        keys = np.empty(len(merges), np.int64)
        for r, (a, b) in enumerate(merges):
            t = self.ids[a + b]
            self.left[t], self.right[t], self.rank[t] = self.ids[a], self.ids[b], r
            keys[r] = self.ids[a] << 32 | self.ids[b]
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.ranks = {(int(k >> 32), int(k & 0xFFFFFFFF)): r for r, k in enumerate(keys)}
        self.made = {(self.ids[a], self.ids[b]): self.ids[a + b] for a, b in merges}
        self.chars = byte_characters()
        self.proposable = self._reachable()
        self.longest = max(map(len, self.proposable), default=1)
        self.reach: dict[str, int] = {}  # the longest token by its first two characters
        for token in self.proposable:
            if len(token) > 1:
                self.reach[token[:2]] = max(self.reach.get(token[:2], 0), len(token))
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.merged = 0

    def forget(self) -> None:
        """Drops the pieces seen."""
        self.new, self.old = {}, {}

    def _reachable(self) -> dict[str, int]:
        """The tokens that merging makes of their own characters, so that a proposal may use them."""
        made = np.flatnonzero(self.rank >= 0)
        if (self.rank[self.left[made]] > self.rank[made]).any() or (self.rank[self.right[made]] > self.rank[made]).any():
            return {}  # ranks that don't grow from part to whole: exact merging does all
        ok = np.ones(len(self.tokens), bool)
        ok[made] = self.stable(self.left[made], self.right[made], whole=True)
        for t in made[np.argsort(self.rank[made])].tolist():
            ok[t] &= ok[self.left[t]] and ok[self.right[t]]
        return {token: i for token, i in self.ids.items() if ok[i]}

    def _pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(x), NEVER)
        key = x << 32 | y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NEVER)

    def stable(self, a: np.ndarray, b: np.ndarray, whole: bool = False) -> np.ndarray:
        """Whether no merge crosses the boundary of each pair of tokens; with whole, but for the pair's own merge.

        Going back in time, the later made of the two tokens at the boundary is undone, and a merge of the two
        counts when its rank comes before that at which either one was taken into a larger token.
        """
        x, y = a.astype(np.int64), b.astype(np.int64)
        until_x, until_y = np.full(len(x), NEVER), np.full(len(x), NEVER)
        good, open_ = np.ones(len(x), bool), np.arange(len(x))
        first = whole
        while len(open_):
            rank = self._pair_rank(x, y)
            if not first:
                cross = (rank < NEVER) & (rank < until_x) & (rank <= until_y)
                good[open_[cross]] = False
            else:
                cross = np.zeros(len(x), bool)
            first = False
            rx, ry = self.rank[x], self.rank[y]
            undo_x = rx > ry
            going = ~cross & ((rx >= 0) | (ry >= 0))
            until_x, until_y = np.where(undo_x, rx, until_x), np.where(undo_x, until_y, ry)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
            open_, x, y, until_x, until_y = open_[going], x[going], y[going], until_x[going], until_y[going]
        return good

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest match, or None where it comes to an end that is no token."""
        out, i, n, known, reach, suffix = [], 0, len(word), self.proposable, self.reach, self.suffix
        inner = n - (suffix != "")
        while i < n:
            if n - i <= self.longest and (t := known.get(word[i:] + suffix)) is not None:
                out.append(t)
                return out
            for j in range(min(inner, i + reach.get(word[i : i + 2], 1)), i, -1):
                if (t := known.get(word[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
            else:
                return None
        return out

    def merge(self, word: str) -> list[int]:
        """Exact merging: the pair of lowest rank first, of equal ranks the leftmost."""
        self.merged += 1
        ids = [self.ids[c] for c in word[:-1]] + [self.ids[word[-1] + self.suffix]]
        if len(ids) <= SHORT:
            return self._merge_short(ids)
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := self.ranks.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[a, b], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (r := self.ranks.get((ids[p], ids[q]))) is not None:
                    heapq.heappush(heap, (r, p, ids[p], ids[q]))
        return [t for t in ids if t >= 0]

    def _merge_short(self, ids: list[int]) -> list[int]:
        """The same for a few symbols: the least rank by a scan."""
        rank, made, never = self.ranks.get, self.made, len(self.ranks)
        ranks = [rank(pair, never) for pair in pairwise(ids)]
        while ranks and (least := min(ranks)) < never:
            i = ranks.index(least)
            ids[i : i + 2] = [made[ids[i], ids[i + 1]]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), never)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), never)
        return ids

    def resolve(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, packed."""
        words = ["".join(map(self.chars.__getitem__, p.encode("utf-8", "replace"))) for p in pieces]
        found = [self.propose(w) for w in words]
        sizes = [len(f) if f else 0 for f in found]
        flat = np.array([t for f in found if f for t in f], np.int64)
        ends = np.cumsum(sizes)
        bad = np.zeros(len(flat) + 1, np.int64)
        if len(flat) > 1:
            # pairs across two words are tested too, and don't count
            pairs, where = np.unique(flat[:-1] << 32 | flat[1:], return_inverse=True)
            bad[1:-1] = np.cumsum(~self.stable(pairs >> 32, pairs & 0xFFFFFFFF)[where])
            bad[-1] = bad[-2]
        begins = ends - sizes
        failing = bad[np.maximum(ends - 1, 0)] - bad[begins]
        return [np.array(self.merge(w) if f is None or x else f, "<u4").tobytes() for w, f, x in zip(words, found, failing.tolist(), strict=True)]

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text; special tokens stand as they are, before a NUL."""
        if self.special is None:
            return self._plain(text)
        parts = self.special.split(text)
        if len(parts) == 1:
            return self._plain(text)
        return [p for k, part in enumerate(parts) for p in ([f"{part}\0"] if k % 2 else self._plain(part))]

    def _plain(self, text: str) -> list[str]:
        # single characters are put in lower case, a final sigma too
        return self.piece.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, packed as little-endian unsigned 32-bit integers."""
        cut = [self.pieces(t or "") for t in texts]
        known: dict[str, bytes] = {}
        new, old = self.new, self.old
        missing = []
        for p in set().union(*cut):
            if (ids := new.get(p)) is None:
                if (ids := old.get(p)) is None:
                    if p[-1] == "\0" and p[:-1] in self.specials:
                        known[p] = np.array([self.specials[p[:-1]]], "<u4").tobytes()
                    else:
                        missing.append(p)
                    continue
                new[p] = ids
            known[p] = ids
        for at in range(0, len(missing), 50_000):
            some = missing[at : at + 50_000]
            for p, ids in zip(some, self.resolve(some), strict=True):
                known[p] = ids
                if len(p) <= LONG:
                    new[p] = ids
        if len(new) > CACHE:
            self.new, self.old = {}, new
        return [b"".join([known[p] for p in pieces]) for pieces in cut]

    def decode(self, packed: list[bytes]) -> list[str]:
        """The tokens of each row of ids, special ones too, with spaces between them."""
        tokens = self.tokens
        return [" ".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()]) for ids in packed]


_LOADED: dict[int, Vocabulary] = {}


def _vocabulary(spec: str) -> Vocabulary:
    key = hash(spec)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(spec)
    return _LOADED[key]


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= GROUP:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with a binary column ids (packed token ids) and, if named, the text that those ids decode to.

    Columns of docs that have these names already are replaced.
    """
    docs = docs.drop(ids, *([decoded] if decoded else []))
    spec = docs.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(spec.value)
        try:
            for batch in batches:
                at = batch.schema.get_field_index(text)
                texts = batch.column(at).to_pylist()
                for a, b in _groups(texts):
                    packed = vocabulary.encode(texts[a:b])
                    extra = [pa.array(packed, pa.binary())] + ([pa.array(vocabulary.decode(packed), pa.string())] if decoded else [])
                    yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *extra], [*batch.schema.names, ids, *([decoded] if decoded else [])])
        finally:
            vocabulary.forget()

    from pyspark.sql.types import BinaryType, StringType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField(ids, BinaryType())] + ([StructField(decoded, StringType())] if decoded else []))
    return map_arrow(docs, run, schema)
