import random

import numpy as np

from inkgrid.llm import simhash as S

SF = "/root/testdata/sf0.001"


def brute(fps):
    """Component numbers of a list of fingerprints, by comparing all pairs."""
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= S.THRESHOLD and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return group


def plain(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    k = min(4, len(words))
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if words else []
    hashes = [S.xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(900, None), (901, ""), (902, " \n"), (903, "two words"), (None, "no id at all here"), (7, None), (900, None)], docs.schema))
    rows = S.near_duplicates(docs).collect()
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    assert len(rows) == docs.count()
    fps = {d: plain(t) for d, t in texts if d is not None and d != 7}
    assert all(r.fp % 2**64 == fps[r.doc_id] for r in rows if r.doc_id in fps)
    some = [(r.doc_id, r.fp % 2**64, r.component_id) for r in rows]
    group = brute([f for _, f, _ in some])
    least = {g: min((d for (d, _, _), h in zip(some, group) if h == g and d is not None), default=None) for g in set(group)}
    assert all(c == least[g] for (_, _, c), g in zip(some, group))
    kept = S.drop_near_duplicates(docs).collect()
    assert len(kept) == len(set(group))


def test_families_of_near_fingerprints(spark, monkeypatch):
    rng = random.Random(1)
    fps = [rng.getrandbits(64) for _ in range(300)]
    for _ in range(400):  # chains and dense families
        f = rng.choice(fps[:5] + fps[-50:])
        for b in rng.sample(range(64), rng.randint(0, 6)):
            f ^= 1 << b
        fps.append(f)
    fps = sorted(set(fps))
    want = brute(fps)
    for m, split in ((6, 4096), (6, 3), (13, 50)):
        monkeypatch.setattr(S, "SPLIT", split)
        monkeypatch.setattr(S, "HOMES", max(1e-9, len(fps) / 2**m))
        df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
        forest = S.Forest()
        for u, v in S.links(df).collect():
            assert ((u ^ v) % 2**64).bit_count() <= 64
            forest.join(u % 2**64, v % 2**64)
        got = [forest.find(f) for f in fps]
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, fp int, rk int, root int")
    assert S.near_duplicates(df).count() == 0
    assert S.drop_near_duplicates(df).columns == df.columns
