import random

import corpus_pipeline as P
from inkgrid.llm import near as N

SF = "/root/testdata/sf0.01"


def sets(rows):
    out = {}
    for d, t in rows:
        w = (t or "").lower().split()
        k = min(5, len(w))
        out[d] = {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    return out


def brute(rows):
    """The least doc_id of each component of texts with a Jaccard similarity of 0.8 or more, from all pairs."""
    found = sets(rows)
    root = {d: d for d in found}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(found)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = found[a], found[b]
            if 5 * len(x & y) >= 4 * len(x | y) and (x or not y):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return {top(d) for d in ids}


def test_stage_keeps_one_of_each_group(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    # fingerprints of near copies are often over 4 bits apart: these differ by a word in sixty, and chains of them
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    for i in range(12):
        other = list(words)
        other[rng.randrange(60)] = f"x{i}"
        rows.append((10**6 + i, " ".join(other)))
        words = other if i % 3 == 2 else words
    rows += [(2 * 10**6, None), (2 * 10**6 + 1, " \n"), (2 * 10**6 + 2, "Two words"), (2 * 10**6 + 3, "two  WORDS")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in P.near_dedup(spark, docs, SF).collect()]
    assert len(kept) == len(set(kept)) and set(kept) == brute(rows)
    assert sum(10**6 <= d < 2 * 10**6 for d in kept) < 12


def test_pairs_left_after_the_stars(spark):
    """Groups of one shingle whose least and largest sets are linked to none of the others."""
    rows, at = [], 0
    for g in range(6):
        base = [f"b{g}x{i}" for i in range(40)]
        for j in range(5):
            for copy in range(2):
                own = [f"o{g}y{j}z{i}" for i in range(30 + 10 * j)]
                rows.append((at, " ".join(base[:8] + own + ([f"e{copy}"] if copy else []))))
                at += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in N.drop_near_copies(docs).collect()}
    assert kept == brute(rows) and len(kept) == 30


def test_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, id int, rk int, root int, h int")
    assert N.drop_near_copies(df).columns == df.columns and N.drop_near_copies(df).count() == 0


def test_fingerprints_link_first(spark, monkeypatch):
    """The stage goes through SimHash's covering: its links are near copies, and those of equal or close fingerprints are among them."""
    rng = random.Random(5)
    rows = []
    for g in range(20):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        rows += [(10 * g, " ".join(words)), (10 * g + 1, " ".join(words[:-1])), (10 * g + 2, " ".join(words)), (10 * g + 3, " ".join(w[::-1] for w in words))]
    rows += [(900, None), (901, "")]
    seen = []
    inner = N.by_fingerprints
    monkeypatch.setattr(N, "by_fingerprints", lambda sets: seen.append((sets, inner(sets))) or seen[-1][1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in P.near_dedup(spark, docs, SF).collect()}
    assert kept == brute(rows)
    sets_, found = seen[0]
    of = {r.id: (r.fp % 2**64, N.unpacked(r.hashes)) for r in sets_.collect()}
    links = {tuple(sorted((r.u, r.v))) for r in found.collect()}
    near = {(u, v) for u in of for v in of if u < v and (of[u][0] ^ of[v][0]).bit_count() <= N.simhash.THRESHOLD}
    right = {(u, v) for u, v in near if 9 * len(set(of[u][1]) & set(of[v][1])) >= 4 * (len(of[u][1]) + len(of[v][1]))}
    assert links == right and len(links) >= 10


def test_few_links_take_no_rounds(spark, monkeypatch):
    """Links up to FEW load the driver with no rounds of joins; more still do, with the same rows."""
    from inkgrid.operators import graph

    rng = random.Random(9)
    rows = []
    for g in range(8):
        words = [f"w{rng.randrange(10**6)}" for _ in range(90)]
        rows += [(10 * g, " ".join(words)), (10 * g + 1, " ".join(["x", *words[1:]])), (10 * g + 2, " ".join(words)), (10 * g + 3, " ".join([*words[:45], "y", *words[46:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rounds = []
    inner = graph._large
    monkeypatch.setattr(graph, "_large", lambda edges: rounds.append(1) or inner(edges))
    kept = {r.doc_id for r in N.drop_near_copies(docs).collect()}
    assert kept == brute(rows) == {10 * g for g in range(8)} and not rounds
    monkeypatch.setattr(N, "FEW", 3)
    assert {r.doc_id for r in N.drop_near_copies(docs).collect()} == kept and rounds
