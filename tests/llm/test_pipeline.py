import duckdb
import tokenizers

import corpus_pipeline as P
from inkgrid.llm import bpe, decontaminate, lines, oracles, quality, simhash
from inkgrid.session import materialise

SF = "/root/testdata/sf0.01"


def plain_near(rows):
    """The least doc_id of each component of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    found, holders = {}, {}
    for d, r in rows.items():
        w = "".join(c.lower() if c.isascii() else c for c in r.text or "").split()
        found[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
        for s in found[d]:
            holders.setdefault(s, []).append(d)
    group = {d: d for d in rows}

    def top(d):
        while group[d] != d:
            d = group[d]
        return d

    for d in sorted(rows):
        shared = {e for s in found[d] for e in holders[s]} if found[d] else {e for e in rows if not found[e]}
        for e in shared:
            if 5 * len(found[d] & found[e]) >= 4 * len(found[d] | found[e]) and top(d) != top(e):
                a, b = sorted((top(d), top(e)))
                group[b] = a
    return {top(d) for d in rows}


def test_stages_equal_plain_versions(spark):
    """Each stage, on what the one before it kept, against SQL or a plain version."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    tokenizer = tokenizers.Tokenizer.from_file(str(P.VOCABULARY))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    for name, stage in P.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        con = duckdb.connect()
        for t in ("labels", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        frame = docs.toPandas()
        con.register("documents", frame)
        docs = materialise(stage(spark, docs, SF), f"test-{name}")
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(after)
        if name != "bpe":
            assert docs.columns == columns and all(r == before[d] for d, r in after.items() if name != "line_dedup")
        if name == "quality_rules":
            assert set(after) == {d for d, kept in con.execute(f"SELECT doc_id, kept FROM ({oracles.SQL['op9_quality_rules']})").fetchall() if kept}
        elif name == "line_dedup":
            want = dict(con.execute(f"SELECT doc_id, text_sha256 FROM ({oracles.SQL['op8_line_dedup']})").fetchall())
            import hashlib

            assert {d: hashlib.sha256(r.text.encode()).hexdigest() for d, r in after.items()} == want and all(r.n_chars == len(r.text) for r in after.values())
        elif name == "near_dedup":
            assert set(after) == plain_near(before)
        elif name == "decontamination":
            leaked = {d for (d,) in con.execute(f"SELECT DISTINCT doc_id FROM ({oracles.SQL['op1_decontamination']})").fetchall()}
            assert set(after) == set(before) - leaked and leaked
        else:
            want = tokenizer.encode_batch_fast([r.text or "" for r in after.values()], add_special_tokens=False)
            for r, w in zip(after.values(), want, strict=True):
                ids = list(memoryview(bytes(r.ids)).cast("I"))
                assert ids == w.ids and r.n_tokens == len(ids) and r.decoded == tokenizer.decode(ids, skip_special_tokens=False)


def test_edges(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and clashing columns go through every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, m int, rk int"
    long_ = " ".join(f"w{i} x{7 * i}" for i in range(200_000))
    rows = [(1, None, None, None, None, None, None, None), (None, "text " * 60, "en", "s", 5, "k", 1, 1), (2, "", "en", "s", 0, "k", 1, 1), (3, long_, "en", "s", len(long_), "k", 1, 1), (3, long_, "en", "s", len(long_), "k", 1, 1), (4, " ".join(f"a{i}b" for i in range(80)), None, "s", 1, None, 2, 2)]
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None), (1, "short")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for df in (docs, docs.limit(0)):
        for _, stage in P.STAGES:
            out = stage(spark, df, str(tmp_path))
            assert set(df.columns) <= set(out.columns)
            out.count()
    kept = P.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept) == [3, 4] and {len(r.ids) > 0 for r in kept} == {True}


def test_modules_say_how_they_treat_nulls():
    assert all("ull" in m.__doc__ for m in (bpe, decontaminate, lines, quality, simhash))
