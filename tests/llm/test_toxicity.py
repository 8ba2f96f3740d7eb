import random
import re
import zlib
from collections import Counter
from math import log, sqrt

import numpy as np

from inkgrid.llm import queries
from inkgrid.llm import toxicity as T

SF = "/root/testdata/sf0.1"


def plain_vectors(examples, texts):
    """Vectors of examples (text, toxic) and of texts as dictionaries by word, straight from the definition."""
    count = lambda t: Counter(re.findall(r"[^\W\d_]+", (t or "").lower()))
    counts = [count(t) for t, _ in examples]
    n, n_a = len(examples), sum(x for _, x in examples)
    holders = lambda w, toxic: sum(w in c for c, (_, x) in zip(counts, examples, strict=True) if x == toxic)
    weight = {}

    def of(w):
        if w not in weight:
            held = {True: holders(w, True), False: holders(w, False)}
            total, gain = n + 2, T.LEAST
            share = (held[True] + held[False] + 1) / total
            for toxic, size in ((True, n_a), (False, n - n_a)):
                for k, p in ((held[toxic] + 0.5, share), (size - held[toxic] + 0.5, 1 - share)):
                    gain += k / total * log(k / total / (p * (size + 1) / total))
            weight[w] = (1 + log((1 + n) / (1 + held[True] + held[False]))) * max(gain, T.LEAST)
        return weight[w]

    def vector(c):
        v = {w: (1 + log(k)) * of(w) for w, k in c.items()}
        length = sqrt(sum(x * x for x in v.values()))
        return {w: x / length for w, x in v.items()}

    return [vector(c) for c in counts], [vector(count(t)) for t in texts]


def dot(q, v):
    return sum(x * v[w] for w, x in q.items() if w in v)


def as_example(i, text, toxic):
    return i, toxic, *T.terms(text)


def test_nearest_equals_all_cosines(monkeypatch):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "uvwxyz"]
    monkeypatch.setattr(T, "BLOCK", 16)
    for n in (1, 5, 700):
        examples = [(" ".join(rng.choices(words, k=rng.randint(0, 9))), rng.random() < 0.3) for _ in range(n)]
        texts = [" ".join(rng.choices([*words, "unseen"], k=rng.randint(1, 7))) for _ in range(100)]
        model = T.Model([as_example(i, *e) for i, e in enumerate(examples)], {True: 1.0, False: 2.0})
        held, queries_ = plain_vectors(examples, texts)
        for text, q in zip(texts, queries_, strict=True):
            every = sorted(((round(dot(q, v), 12), i) for i, v in enumerate(held)), key=lambda x: (-x[0], x[1]))
            want = [x for x in every if x[0] > 0][: T.NEIGHBOURS]
            got = model.index.nearest(*model.vector(*T.terms(text)), T.NEIGHBOURS)
            assert np.allclose([c for c, _ in got], [c for c, _ in want], atol=1e-11)
            assert [i for _, i in got] == [i for _, i in want] or np.allclose([c for c, _ in every[: T.NEIGHBOURS + 1]][-2:], got[-1][0], atol=1e-11) or len({round(c, 10) for c, _ in got}) < len(got)


def test_frequent_words_cost_no_postings(monkeypatch):
    """What a search walks through: postings of words that many examples have are nearly all of them, and none need a walk."""
    rng, walked = random.Random(5), []
    usual, rare = [f"{a}{b}" for a in "abcdefghij" for b in "uvwxyz"], [f"{a}{b}{c}" for a in "klmno" for b in "uvwxyz" for c in "pqrst"]
    examples = [" ".join(rng.choices(usual, k=60) + rng.choices(rare, k=2)) for _ in range(400)]
    monkeypatch.setattr(T, "spans", lambda starts, sizes, plain=T.spans: walked.append(int(sizes.sum())) or plain(starts, sizes))
    monkeypatch.setattr(T, "DENSE", 60, raising=False)
    model = T.Model([as_example(i, t, i % 3 == 0) for i, t in enumerate(examples)], {True: 1.0, False: 1.0})
    texts = [" ".join(rng.choices(usual, k=60) + rng.choices(rare, k=2)) for _ in range(50)]
    holders = Counter(w for t in examples for w in set(t.split()))
    every = sum(holders[w] for t in texts for w in set(t.split()))
    for t in texts:
        model.index.nearest(*model.vector(*T.terms(t)), T.NEIGHBOURS)
    assert sum(walked) <= every / 20


def test_nearest_is_the_same_in_any_company(monkeypatch):
    """Neighbours, with cosines to the last bit, by blocks of any size, by more or fewer dense terms, and with equal examples."""
    rng = random.Random(6)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "uvwxyz"]
    some = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(150)]
    examples = [(t, i % 3 == 0) for i, t in enumerate(some * 3)]
    texts = some[:40] + [" ".join(rng.choices([*words, "unseen"], k=rng.randint(1, 30))) for _ in range(90)] + ["unseen"]
    held, queries_ = plain_vectors(examples, texts)
    for dense in (0, 1, 10, 512):
        monkeypatch.setattr(T, "DENSE", dense)
        model = T.Model([as_example(i, *e) for i, e in enumerate(examples)], {True: 1.0, False: 2.0})
        vectors, got = [model.vector(*T.terms(t)) for t in texts], {}
        for block in (1, 7, 64):
            monkeypatch.setattr(T, "BLOCK", block)
            got[block] = model.index.nearest_all(vectors, T.NEIGHBOURS)
        assert got[1] == got[7] == got[64] == model.index.nearest_all(vectors[::-1], T.NEIGHBOURS)[::-1]
        for q, near in zip(queries_, got[1], strict=True):
            want = sorted(((round(dot(q, v), 9), i) for i, v in enumerate(held)), key=lambda x: (-x[0], x[1]))
            assert [(round(c, 9), i) for c, i in near] == [x for x in want if x[0] > 0][: T.NEIGHBOURS]
        but = model.index.nearest_all(vectors[:40], T.NEIGHBOURS, list(range(40)))
        assert all(i not in [e for _, e in near] and i + 150 in [e for _, e in near] for i, near in enumerate(but))


def test_read_equals_vector_of_terms(monkeypatch):
    """Texts read together have the vectors of their terms, with spellings known before, forgotten or neither."""
    odd = ["Stra\u00dfe, STRASSE! \u0130stanbul \u039f\u0394\u039f\u03a3 x\u00a0y\u2003z\u200bq", "don't e-mail_me 12ab34 x\u00b2 \u00bd\u2167 \u0663a", "a,b;c a, ,b c", "", None, " \t\n", "123 456 --", "\u6587\u5b57 abc\u6587", "new " * 500 + "words", "e\u0301 \U0001d49cx \U0001f600"]
    examples = [as_example(i, t, i % 2 == 0) for i, t in enumerate([*odd, "some words here", "words, here"])]
    for fitted in (examples, []):
        model = T.Model(fitted, {True: 1.0, False: 1.0})
        texts = [*odd, "others, others words: here", "Some WORDS here.", *odd[::-1]]
        want = [model.vector(*T.terms(t)) if len(T.terms(t)[0]) else None for t in texts]
        for most in (0, 3, 1 << 18):
            monkeypatch.setattr(T, "TOKENS", most)
            known = {}
            for got in (model.read(texts, known), [v for t in texts for v in model.read([t], known)], model.read(texts, known)):
                for g, w in zip(got, want, strict=True):
                    assert (g is None) == (w is None)
                    assert g is None or (g[0].tolist() == w[0].tolist() and g[1].tolist() == w[1].tolist())
                assert len(known) <= max(most, len(texts) * 20)
    assert model.read([], {}) == []


def test_parts_hold_every_text(monkeypatch):
    monkeypatch.setattr(T, "TOGETHER", 10)
    texts = dict(enumerate(["x" * 4, "x" * 6, None, "x", "x" * 30, "x" * 30, "x", ""]))
    assert list(T.parts(texts)) == [[0, 1, 2], [3], [4], [5], [6, 7]]
    assert list(T.parts({})) == []


def test_whole_query_equals_brute_force(spark):
    """Scores and evidence of the whole query on a fixture, from all cosines of all words."""
    rng = random.Random(9)
    usual, bad = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)], ["vile", "rotten", "nasty"]
    rows = []
    for i in range(260):
        words = rng.choices(usual, k=rng.randint(5, 40))
        toxic = rng.random() < 0.3
        if toxic and rng.random() < 0.9:
            words += rng.choices(bad, k=2)
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows] + [(1000, None), (1001, "zzz"), (1002, "vile " * 9000)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, x) for d, _, x in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in T.score(docs, labels).collect()}
    train = [(d, t, x) for d, t, x in rows if zlib.crc32(str(d).encode()) % 5]
    texts = {d: t for d, t, _ in rows} | {1002: "vile " * 9000}
    held, vectors = plain_vectors([(t, bool(x)) for _, t, x in train], texts.values())
    toxic = [bool(x) for _, _, x in train]

    def vote(q, but=None):
        near = sorted(((round(dot(q, v), 12), i) for i, v in enumerate(held) if i != but), key=lambda x: (-x[0], x[1]))
        near = [x for x in near if x[0] > 0][: T.NEIGHBOURS]
        w = [1 / (T.EPSILON + 1 - min(1, c)) for c, _ in near]
        base = (sum(toxic) + 1) / (len(toxic) + 2)
        return (sum(a for a, (_, i) in zip(w, near, strict=True) if toxic[i]) / sum(w) if near else base), near

    own = [vote(v, i)[0] for i, v in enumerate(held)]
    knots, values = T.isotonic(np.array(own), np.array(toxic, float), np.ones(len(own)))
    for d, q in zip(texts, vectors, strict=True):
        v, near = vote(q)
        assert abs(got[d].score - np.interp(v, knots, values)) < 1e-6, d
        assert np.allclose([e.cosine for e in got[d].evidence], [c for c, _ in near[: T.EVIDENCE]], atol=1e-9)
    assert got[1000].evidence == [] and got[1001].evidence == [] and 0 < got[1000].score < 1
    assert sum(bool(r.evidence) for r in got.values()) >= len(rows)


def test_isotonic_is_increasing_and_pools():
    x, y = np.array([0.1, 0.2, 0.2, 0.3, 0.9]), np.array([0, 1, 0, 0, 1.0])
    knots, values = T.isotonic(x, y, np.ones(5))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all() and values[0] < 0.5 < values[-1]


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in queries.op4_toxicity(spark, SF).collect()}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert len(rows) == 10_000 and len(labels) > 500 and all(0 <= r.score <= 1 for r in rows.values())
    caught = [rows[r.doc_id].predicted for r in labels if r.toxic]
    clean = [rows[r.doc_id].predicted for r in labels if not r.toxic]
    assert sum(caught) >= 0.85 * len(caught) and sum(clean) <= 0.02 * len(clean)
    assert all(r.evidence for r in rows.values() if r.predicted)
    assert sum(bool(r.evidence) for r in rows.values()) >= 0.99 * len(rows)  # nearly every document has neighbours


def test_repeated_and_long_rows(spark, monkeypatch):
    """Rows that repeat a labelled doc_id count as one example, texts over LONGEST are scored but are none."""
    rows = [(i, f"own{chr(97 + i)} words here " + ("vile thing" if i % 2 else "kind thing")) for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(21)], "doc_id long, toxic int")
    long_ = "kind words " * 100_000
    docs = spark.createDataFrame(rows + rows[:5] + [(3, "vile")] * 50 + [(20, long_)], "doc_id long, text string")
    model = T.fit(docs, labels)
    assert len(model.ids) == len(set(model.ids)) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(20))
    out = T.score(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out) and [r for r in out if r.doc_id == 20][0].evidence


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "x", 1), (2, "", 0)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(1, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    assert [0 <= r.score <= 1 for r in T.score(docs, labels).collect()] == [True] * 4
    assert T.score(docs.limit(0), labels.limit(0)).count() == 0
