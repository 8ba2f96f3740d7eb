import duckdb
import pytest

from inkgrid.llm import oracles, quality, queries


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    result = con.execute(oracles.SQL[name])
    names = [d[0] for d in result.description]
    want = sorted(map(str, result.fetchall()))
    assert sorted(df.columns) == sorted(names)
    assert sorted(str(tuple(r[c] for c in names)) for r in df.collect()) == want and want


def test_cutoffs_equal_sql_where_there_are_some(spark, monkeypatch):
    """With looser risk, small tables have admissible cutoffs too."""
    monkeypatch.setattr(quality, "ALPHA", 0.5)
    monkeypatch.setattr(quality, "DELTA", 0.9)
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = quality.measure(docs)
    fitted = quality.fit_cutoffs(m, labels, quality.ALPHA, quality.DELTA)
    assert fitted.count() > 0
    kept = m.select("doc_id", quality.verdict(m, fitted, m.stratum, m.m).alias("kept")).where("kept").count()
    want = con.execute(f"SELECT count(*) FILTER (kept), count(*) FILTER (NOT kept AND NOT base_failed) FROM ({oracles._quality()})").fetchone()
    assert kept == want[0] and want[1] > 0


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, None, 0), (None, "", "en", 1), (2, "a b c " * 40, "en", 2), (2, "a b c " * 40, "en", 2), (3, " ".join(f"word{i}" for i in range(60)), "en", 3)], "doc_id long, text string, lang string, m int")
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 1), (3, 0), (9, 1)], "doc_id long, quality int")
    out = sorted((r.doc_id or 0, r.n_words, r.n_repeat_words, r.kept) for r in quality.quality(docs, labels).collect())
    assert out == [(0, 0, 0, False), (1, 0, 0, False), (2, 120, 120, False), (2, 120, 120, False), (3, 60, 0, True)]
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns and [r.m for r in kept.collect()] == [3]
    assert quality.quality(docs.limit(0), labels).count() == 0 and quality.keep_quality(docs, labels.limit(0)).count() == 1


def test_quality_of_long_texts(spark):
    """Counts of very long texts, against plain ones."""
    import random
    import re
    from collections import Counter

    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(60_000)), "same words again " * 40_000, "\n".join(f"line {i % 900} #$ of many" for i in range(20_000)), "x" * 1_000_000]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for r in quality.quality(docs, labels).collect():
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", texts[r.doc_id]) if w]
        windows = Counter(zip(words, words[1:], words[2:]))
        again = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
        lines = [x for x in texts[r.doc_id].split("\n") if x.strip()]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(texts[r.doc_id].count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again))


def test_cutoffs_follow_labelled_documents_only(spark):
    """The pipeline's quality stage keeps what quality() keeps, though it measures labelled documents alone for the cutoffs."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    want = {r.doc_id for r in quality.quality(docs, labels).where("kept").collect()}
    assert {r.doc_id for r in quality.keep_quality(docs, labels).collect()} == want
