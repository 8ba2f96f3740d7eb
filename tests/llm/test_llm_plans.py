"""Plans of the native operators, and names of columns that clash with what operators add or use."""

import pytest

import corpus_pipeline as P
from inkgrid.llm import bpe, decontaminate, lines, lm, quality, queries, repeats, secrets, simhash, toxicity

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op1_decontamination", "op8_line_dedup", "op9_quality_rules"])
def test_native_plans_have_no_python(spark, name, monkeypatch):
    from inkgrid import session

    seen = []
    for module in (decontaminate, lines, quality):
        monkeypatch.setattr(module, "materialise", lambda df, n: seen.append(plan(df)) or session.materialise(df, n))
    seen.append(plan(queries.queries()[name](spark, SF)))
    for text in seen:
        assert "Python" not in text and "MapInArrow" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_clashing_columns(spark):
    """Columns named like an operator's own: those it adds replace them, others pass through."""
    names = "ids decoded n_tokens base spans links score evidence dropped removed key rk fp leaf seed at first words m row cell stratum item n".split()
    docs = spark.createDataFrame([(i, f"some words of text number {i} " * 30, "en", *range(len(names))) for i in range(3)], "doc_id long, text string, lang string, " + ", ".join(f"{n} int" for n in names))
    labels = spark.createDataFrame([(1, 1, 0, 5)], "doc_id long, quality int, toxic int, good int")
    items = spark.createDataFrame([(1, "other words entirely here and more", 4)], "item_id long, text string, item int")
    kept = lambda df: {r.doc_id: r.leaf for r in df.collect()}
    every = {i: names.index("leaf") for i in range(3)}
    assert kept(bpe.encode(docs, P.VOCABULARY, decoded="decoded")) == every
    assert kept(secrets.scan(docs)) == every and kept(toxicity.score(docs, labels)) == every
    assert kept(lines.drop_boilerplate(docs, dropped="dropped")) == every and kept(repeats.drop_repeats(docs, removed="removed")) == every
    assert kept(decontaminate.drop_contaminated(docs, items)) == every
    assert set(kept(simhash.drop_near_duplicates(docs))) <= set(every) and set(kept(quality.keep_quality(docs, labels))) <= set(every)
    assert lm.score(docs).count() == 3 and quality.quality(docs, labels).count() == 3
    for _, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert len(set(out.columns)) == len(out.columns) and out.count() <= 3
