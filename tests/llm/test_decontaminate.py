import random
from itertools import combinations
from math import ceil

from inkgrid.llm import decontaminate as D

SF = "/root/testdata/sf0.001"


def words(text):
    text = (text or "").lower()
    for s in " \t\n\x0b\x0c\r.,;:!?\"'()[]{}":
        text = text.replace(s, " ")
    return [w for w in text.split(" ") if w]


def brute(docs, items):
    """{(doc_id, item_id): most equal words of a window}, over all offsets."""
    out = {}
    for doc, a in docs:
        a = words(a)
        where = {}
        for i, w in enumerate(a):
            where.setdefault(w, []).append(i)
        for item, b in items:
            b = words(b)
            width = min(len(b), D.WINDOW)
            for o in {i - j for j, w in enumerate(b) for i in where.get(w, ())}:
                same = [0 <= i + o < len(a) and w == a[i + o] for i, w in enumerate(b)]
                best = max(sum(same[i : i + width]) for i in range(len(b) - width + 1))
                if best >= D.SHARE * width:
                    out[doc, item] = max(best, out.get((doc, item), 0))
    return out


def test_masks_hit_whatever_is_substituted():
    """Every way to substitute as many words as the share allows leaves a mask untouched, for windows of any length."""
    for n in range(1, D.WINDOW + 1):
        masks = [m for m, low, high in D.seed_masks() if low <= n <= high]
        for gone in combinations(range(n), n - ceil(D.SHARE * n)):
            assert any(not {i + p for p in m} & set(gone) for m in masks for i in range(n - m[-1])), (n, gone)


def check(spark, docs, items):
    got = D.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id): r.matched for r in got} == want and len(got) == len(want)
    return want


def test_documents_with_planted_edits(spark):
    rng = random.Random(2)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][:12]
    for n in range(12):
        w = items[n][1].split()
        for i in rng.sample(range(len(w)), n * len(w) // 40):
            w[i] = "zzz"
        docs[n] = (docs[n][0], docs[n][1][:300] + "\n" + " ".join(w).upper() + "!\n" + docs[n][1][300:])
    found = check(spark, docs[:60], items)
    assert all((docs[n][0], items[n][0]) in found for n in range(8))


def test_edges(spark):
    text = "one two three four five six seven eight nine ten"
    docs = [(1, text), (2, None), (3, ""), (4, "five six seven"), (None, "x " + text), (5, text + " " + text), (6, "one two three four five x seven eight nine ten " * 500)]
    items = [(1, text), (2, "five six seven"), (3, None), (4, "six seven eight nine ten"), (None, "one two three x five six seven y nine ten")]
    found = check(spark, docs, items)
    assert (6, 1) in found and (1, None) in found and (4, 2) in found and (1, 2) in found


def test_recall_of_items_of_all_lengths(spark):
    """Items of 1 to 40 words with random substitutions, against all offsets."""
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(n, " ".join(rng.choices(vocabulary, k=n))) for n in [*range(1, 31), 40, 40]]
    docs = []
    for d in range(90):
        item = items[d % len(items)][1].split()
        for i in rng.sample(range(len(item)), len(item) - ceil(0.8 * len(item)) + (d % 5 == 0)):
            item[i] = f"x{rng.randint(0, 9)}"
        docs.append((d, " ".join([*rng.choices(vocabulary, k=20), *item, *rng.choices(vocabulary, k=20)])))
    assert len(check(spark, docs, items)) > 90
    kept = {r.doc_id for r in D.drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items[:4], "item_id long, text string")).collect()}
    assert kept == set(range(90))  # items under LEAST_WINDOW words drop nothing


def test_repetitive_texts(spark):
    """One row for a document and an item, however many alignments they have."""
    docs = [(1, "go on " * 3000), (2, "on " * 200 + "stop")]
    items = [(1, "go on " * 60), (2, "on " * 30)]
    check(spark, docs, items)


def test_repeats_clashes_and_empty(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text, 0), (1, text, 0), (2, "clean", 1), (None, None, 2)], "doc_id long, text string, item int")
    items = spark.createDataFrame([(1, text, 0), (1, text, 0)], "item_id long, text string, words int")
    assert len(D.overlaps(docs, items).collect()) == 1
    kept = D.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.item for r in kept.collect()) == [1, 2]
    assert D.drop_contaminated(docs, items.limit(0)).count() == 4 and D.overlaps(docs.limit(0), items).count() == 0
