from inkgrid.llm import repeats as R

SF = "/root/testdata/sf0.01"


def brute(rows):
    """Sorted (doc_id, start, end, words, kept doc_ids), from dictionaries."""
    first, out = {}, set()
    rank = lambda d: (d is None, d or 0)
    for doc, text in sorted(set(rows), key=lambda r: (rank(r[0]), r[1] or "")):
        for *_, digest in R.units(text):
            first.setdefault(digest, doc)
    for doc, text in set(rows):
        run, seen = [], set()
        for u in [*R.units(text), None]:
            if u and (u[3] in seen or rank(doc) > rank(first[u[3]])):
                run.append((u, first[u[3]]))
            else:
                if sum(x[0][2] for x in run) >= R.MIN_RUN:
                    words = {k: sum(x[0][2] for x in run if x[1] == k) for _, k in run}
                    most = min(words, key=lambda k: (-words[k], rank(k)))
                    kept = tuple(sorted((k for k in words if k == most or words[k] >= R.MIN_RUN / 2), key=rank))
                    out.add((doc, run[0][0][0], run[-1][0][1], sum(x[0][2] for x in run), kept))
                run = []
            if u:
                seen.add(u[3])
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.start, r.end, r.n_words, tuple(r.kept_doc_ids)) for r in R.runs(df).collect()), key=str)
    assert got == brute(rows)
    return df, got


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    df, got = check(spark, rows)
    assert len(got) > 20
    texts = dict(rows)
    for r in R.drop_repeats(df, removed="gone").collect():
        text, at, left = texts[r.doc_id], 0, ""
        for s in r.gone:
            left, at = left + text[at : s.start], s.end
        assert r.text == left + text[at:]


def test_edges(spark):
    passage = " ".join(f"Word{i} éa b{i} c d{i}." for i in range(12))
    rows = [(5, f"own text\nsome words then {passage} and more"), (3, passage.upper().replace(" ", "  ")), (None, passage), (8, None), (9, ""), (10, passage + "\n" + passage), (10, passage + "\n" + passage), (11, "Es. It is. No."), (12, passage * 500)]
    _, got = check(spark, rows)
    assert {g[0] for g in got} == {5, None, 10, 12} and all(g[4] == (3,) for g in got)


def test_ties_keep_exactly_one(spark):
    """Of texts with one doc_id, or with none, that share a passage, one keeps it; every keeper of a span is listed with its words."""
    passage = " ".join(f"word{i} a b{i} c d{i}." for i in range(12))
    for doc in (None, 4):
        rows = [(doc, f"first own words {passage}"), (doc, f"second own words {passage}"), (doc, passage), (doc, passage)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        left = [r.text for r in R.drop_repeats(df).collect()]
        kept = {t for t in left if "word5 a b5" in t}
        assert len(kept) == 1 and sum("word5 a b5" in t for t in left) == (2 if passage in kept else 1)
    parts = [" ".join(f"p{k}word{i} a b{i} c d{i}." for i in range(3 if k else 8)) for k in range(4)]
    rows = [(k, p) for k, p in enumerate(parts)] + [(9, " ".join(parts))]
    (span,) = R.runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(k.doc_id, k.n_words) for k in span.keepers} == {(0, 40), (1, 15), (2, 15), (3, 15)} and span.doc_id == 9


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, key int, first int, start int")
    assert R.drop_repeats(df).columns == df.columns and R.runs(df).count() == 0 and R.drop_repeats(df).count() == 0
