import mmap
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from inkgrid.llm import lm

SF = "/root/testdata/sf0.001"


def plain(text):
    text = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), None]


def held_out(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 == 1


def brute(rows):
    counts = Counter(t for d, x in rows if not held_out(d) for t in plain(x))
    n, v = sum(counts.values()), len(counts)
    return [(d, held_out(d), len(t := plain(x)), sum(counts[w] > 0 for w in t), n, sum(log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for d, x in rows]


def same(out, rows):
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out), key=order)
    want = sorted(brute(rows), key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-10)


@pytest.mark.parametrize("top", [1 << 20, 20])
def test_base_scores(spark, monkeypatch, top):
    monkeypatch.setattr(lm, "TOP", top)
    monkeypatch.setattr(lm, "CELL_BYTES", 20_000)
    monkeypatch.setattr(lm, "GROUP", 30_000)
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = [(1000, None), (1001, ""), (None, " \t\n"), (5, "a b"), (5, "a b"), (1002, "É Ü x " * 30_000)]
    df = df.union(spark.createDataFrame(more, df.schema)).repartition(5)
    same(lm.score(df).collect(), [tuple(r) for r in df.collect()])


def test_word_hashes_are_those_of_words():
    rng = random.Random(1)
    text = "".join(rng.choice("abé \n\t") for _ in range(200_000)).encode()
    hashes, starts = lm.word_hashes(text)
    words = text.split()
    assert len(words) == len(hashes) and len(set(words)) == len(set(hashes.tolist())) == len(set(zip(words, hashes.tolist())))
    assert all(text[s : s + len(w)] == w for s, w in zip(starts.tolist(), words))


def test_filter_reads_levels():
    rng = np.random.default_rng(2)
    h = np.unique(rng.integers(0, 2**63, 20_000, dtype=np.uint64))
    counts = rng.geometric(0.2, len(h)) ** 2
    bits = lm.write_cell(h, counts)
    assert len(bits) * 8 <= lm.BITS_EACH * lm.level(counts).sum() + 64
    one = lm.Filter(bits, np.array([0, len(bits)]))
    read, want = one.levels(h), lm.level(counts)
    assert (read >= want).all() and (read > want).mean() < 0.05
    assert (one.levels(lm.mix(h + np.uint64(1))) > 0).mean() < 0.05
    halves = [h[h >> np.uint64(63) == i] for i in (0, 1)]
    parts = [lm.write_cell(x, counts[np.isin(h, x)]) for x in halves]
    two = lm.Filter(b"".join(parts), np.cumsum([0, *map(len, parts)]))
    assert (two.levels(h) >= want).all()


def exact_model(rows):
    """The score of each text from exact counts, each read as its level: what the filter would give without false positives."""
    ones, twos = Counter(), Counter()
    for d, x in rows:
        if not held_out(d):
            t = plain(x)
            ones.update(t)
            twos.update(zip([None, *t[:-1]], t, strict=True))
    n, v = sum(ones.values()), len(ones)
    read = lambda c: float(lm.READ[lm.level(np.array([c]))[0]])

    def of(x):
        total = 0.0
        t = plain(x)
        for a, b in zip([None, *t[:-1]], t, strict=True):
            c, context = read(ones[b]), read(ones[a])
            p = (c + 0.5) / (n + 0.5 * (v + 1))
            total += log10((min(read(twos[a, b]), context, c) + lm.MU * p) / (context + lm.MU))
        return total

    return {d: of(x) for d, x in rows}


@pytest.mark.parametrize("far", [False, True])
def test_scores_are_those_of_exact_counts(spark, monkeypatch, far):
    """Whole scores against exact counts; read a little high by false positives only. Both ways of probing."""
    if far:
        monkeypatch.setattr(lm, "BROADCAST", 0)
    monkeypatch.setattr(lm, "CELL_BYTES", 20_000)
    monkeypatch.setattr(lm, "GROUP", 30_000)
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    df = df.union(spark.createDataFrame([(10**6, None), (10**6 + 1, "a b " * 9000)], df.schema))
    want = exact_model([tuple(r) for r in df.collect()])
    got = {r.doc_id: r for r in lm.score(df.repartition(3)).collect()}
    assert got.keys() == want.keys()
    off = [(got[d].score - want[d]) / got[d].n_tokens for d in want]
    assert abs(np.mean(off)) < 0.02 and max(map(abs, off)) < 0.2


def test_both_ways_of_probing_agree(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    near = {r.doc_id: r for r in lm.score(df).collect()}
    monkeypatch.setattr(lm, "BROADCAST", 0)
    monkeypatch.setattr(lm, "TOP", 50)
    far = {r.doc_id: r for r in lm.score(df).collect()}
    assert near.keys() == far.keys()
    assert all(abs(near[d].score - far[d].score) < 1e-9 and abs(near[d].base_score - far[d].base_score) < 1e-9 and near[d].n_known == far[d].n_known for d in near)


def test_held_out_likelihood_beats_shuffled_words(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [r for r in lm.score(df).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    train = [(i, "the cat sat on the mat and the dog lay on the rug") for i in range(0, 400)]
    test = [(10_000 + i, t) for i in range(20) for t in ("the cat sat on the rug", "rug cat the on sat the")]
    scores = {}
    for r in lm.score(spark.createDataFrame(train + test, "doc_id long, text string")).collect():
        if r.doc_id >= 10_000 and r.held_out:
            scores.setdefault(r.doc_id, []).append(r.score)
    assert scores and all(max(s) - min(s) > 1 for s in scores.values())


def test_empty_table_and_clashes(spark):
    df = spark.createDataFrame([], "doc_id long, text string, row int, cell int")
    assert lm.score(df).count() == 0
    one = spark.createDataFrame([(1, "x", 2, 3)], df.schema)
    assert lm.score(one).first().n_tokens == 2


def test_model_is_mapped_from_the_broadcast(spark):
    """Workers hold no copy of the model: they map the broadcast's file. Without such a file its bytes are read."""
    bits, top, counts = lm.write_cell(np.arange(50, dtype=np.uint64), np.arange(1, 51)), np.array([9, 3, 7], np.uint64), np.array([4, 5, 6])
    model = lm.Model(lm.Filter(bits, np.array([0, len(bits)])), top, counts, 15, 3)
    filler = np.zeros(1 << 20, np.uint64)
    large = lm.Model(lm.Filter(bits, np.array([0, len(bits)])), np.arange(1 << 17, dtype=np.uint64), filler[: 1 << 17].astype(np.int64), 15, 3)

    def seen(m):
        return m.top.tolist()[:3], m.counts.tolist()[:3], m.filter.levels(np.arange(60, dtype=np.uint64)).tolist(), m.n, m.v, m.mass

    for m in (model, large):
        b = spark.sparkContext.broadcast(m.packed())
        assert seen(lm.Model.of(b)) == seen(m) and isinstance(memoryview(lm.Model.of(b).filter.bytes.base).obj, mmap.mmap)

        class Held:
            value = b.value

        assert seen(lm.Model.of(Held)) == seen(m)
    assert lm.Model.of(spark.sparkContext.broadcast(lm.Model(None, top, counts, 1, 2).packed())).filter is None


def test_probes_go_to_ranges_of_cells_packed(spark, monkeypatch):
    """A row for each group of texts and range of cells, not for each token and pair; scores equal those of the broadcast filter."""
    rows = [(i, " ".join(f"w{(i * j * j) % 97}" for j in range(60)) if i % 7 else None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = {r.doc_id: (r.n_tokens, round(r.base_score, 6), round(r.score, 9)) for r in lm.score(docs).collect()}
    kept, write = {}, lm.materialise
    monkeypatch.setattr(lm, "BROADCAST", 0)
    monkeypatch.setattr(lm, "PART", 4)
    monkeypatch.setattr(lm, "materialise", lambda df, name: kept.setdefault(name, write(df, name)))
    assert {r.doc_id: (r.n_tokens, round(r.base_score, 6), round(r.score, 9)) for r in lm.score(docs).collect()} == want
    asked, groups = (kept["lm-scores"].where(f"kind = {k}").count() for k in (2, 3))
    assert groups <= asked <= groups * 2 * 4 and kept["lm-scores"].where("kind = 2").select("part").distinct().count() == 4
