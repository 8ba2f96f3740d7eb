import duckdb
from pyspark.sql import functions as F

from inkgrid.operators.islands import words
from inkgrid.plans import catalogue


def test_word_gaps_of_lines_with_mostly_spaces(spark, tmp_path):
    """Lines of which half the gaps or more are spaces, rows that share a doc_id, null ids and texts."""
    rows = [(1, "De |\nA | Is.\nÉ ê."), (2, "This" + " a" * 40), (3, "x"), (3, "y  z\n\n   \n a"), (None, "b c"), (None, "d e"), (4, None), (5, ""), (6, "𝄞 ab 𝄞 c\td")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = catalogue.QUERIES["word_gaps"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.ORACLES['word_gaps']})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str) and len(want) == 10


def test_words_without_known_spacing_go_by_the_median(spark):
    line = [(0, 0, 9, "a"), (0, 12, 20, "b"), (0, 23, 30, "c"), (0, 42, 50, None), (1, 0, 9, "a"), (1, 20, 29, "b")]
    df = spark.createDataFrame(line, "line int, start int, end int, char string").withColumn("height", F.lit(10))
    assert {r.line: r.text for r in words(df, ["line"], "height").collect()} == {0: "abc �", 1: "ab"}


def test_word_gaps_shuffles_nothing(spark, tmp_path, capsys):
    """A line's characters stay in its row, so that disk does not grow with them."""
    spark.createDataFrame([(1, "a b\nc  d")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalogue.QUERIES["word_gaps"](spark, str(tmp_path))
    df.explain()
    assert "Exchange" not in capsys.readouterr().out
    assert sorted((r.line, r.text) for r in df.collect()) == [(0, "a b"), (1, "c d")]
