import re
from collections import Counter, defaultdict

from inkgrid.llm import lines as L

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute(rows):
    """{row index: dropped line numbers}, by dictionaries."""
    leaf_docs, occ = defaultdict(set), []
    for k, (doc, text) in enumerate(rows):
        for n, line in enumerate((text or "").split("\n")):
            t = [x for x in SPACE.split(line) if x]
            if t:
                t = ["" if re.search("[0-9]", x) else x for x in t]
                leaf = (len(t), *t[: L.DEPTH])
                leaf_docs[leaf].add(k)
                occ.append((k, doc, n, leaf, tuple(t)))
    occ = [o for o in occ if len(leaf_docs[o[3]]) >= L.MIN_DOCS]
    usual = Counter((o[3], i, x) for o in occ for i, x in enumerate(o[4]) if x)
    docs_of, first, placed = defaultdict(set), {}, []
    for k, doc, n, leaf, t in occ:
        firm = tuple(x if x and usual[leaf, i, x] >= L.MIN_DOCS else None for i, x in enumerate(t))
        if sum(x is not None for x in firm) >= L.MIN_CONSTANT * len(t):
            key = (doc, rows[k][1])
            docs_of[leaf, firm].add(key)
            at = (doc is not None, doc or 0, n)
            first[leaf, firm] = min(first.get((leaf, firm), at), at)
            placed.append((k, at, (leaf, firm)))
    out = defaultdict(set)
    for k, at, template in placed:
        if len(docs_of[template]) >= L.MIN_DOCS and at != first[template]:
            out[k].add(at[2])
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "", r.lost) for r in L.drop_boilerplate(df, dropped="lost").collect())
    gone = brute(rows)
    want = []
    for k, (doc, text) in enumerate(rows):
        left = "\n".join(x for i, x in enumerate((text or "").split("\n")) if i not in gone[k])
        want.append((doc if doc is not None else -1, left, sorted(gone[k])))
    assert got == sorted(want)
    return sum(map(len, gone.values()))


def test_real_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert check(spark, rows) > 10


def test_templates_and_edges(spark):
    log = [f"Served {n} requests for user u{n} in total" for n in range(5)]
    rows = [(i, f"own words of text {chr(97 + i)} here\n{line}") for i, line in enumerate(log)]
    rows += [(None, log[0]), (7, None), (8, ""), (9, "a b c"), (9, "a b c"), (3, log[3] * 2000)]
    assert check(spark, rows) == 9


def test_short_lines(spark):
    """Lines of one to three words are templates too: exact ones and those with a number, not a number alone."""
    rows = [(i, f"own words of text {chr(97 + i)}\nAll rights reserved.\nPage {i}\n{i}\nMenu\n\nonly {chr(97 + i)} here") for i in range(6)]
    assert check(spark, rows) == 20  # the first line of each, the rights, the page and the menu


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, leaf int, key string, line_no int")
    out = L.drop_boilerplate(df)
    assert out.columns == df.columns and out.count() == 0
