import gzip
import hashlib

from pyspark.errors import PythonException

from inkgrid.llm import queries, warc

SF = "/root/testdata/sf0.001"


def expected(rows):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each row."""
    groups = {}
    for page, html in rows:
        groups.setdefault(html or "", []).append(page)
    out = []
    for page, html in rows:
        raw = (html or "").encode()
        last = max((p for p in groups[html or ""] if p is not None), default=None)
        revisit = len(raw) >= warc.REVISIT and len(groups[html or ""]) > 1 and last is not None and page != last
        out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    big, odd = "é" * 600, "<p>\r\n\r\nWARC/1.1\r\n" + "\x1f\x8b\x08" * 400
    rows = [(1, big), (5, big), (3, big), (None, big), (8, "a"), (9, "a"), (10, None), (11, ""), (12, odd), (13, odd), (14, odd[:-1]), (5, big), (-4, "x" * 5_000_000), (None, "n" * 1000), (None, "n" * 1000)]
    df = spark.createDataFrame([(p, "http://e.x/ü \n" if p else None, h, 0) for p, h in rows], "page_id long, url string, html string, digest int")
    got = sorted((tuple(r) for r in warc.round_trip(df, f"file://{tmp_path}/w").collect()), key=str)
    assert got == expected(rows)
    assert warc.round_trip(df.limit(0), f"{tmp_path}/none").count() == 0


def test_ranges_and_pushdown(spark, tmp_path, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    path = f"{tmp_path}/w"
    warc.write(pages.union(pages.withColumn("page_id", pages.page_id + 1000)).coalesce(2), path)
    every = warc.read(spark, path).collect()
    assert len(every) == 100
    for size in (100, 5000, 10**9):
        assert warc.read(spark, path, range=str(size)).count() == 100
    revisits = warc.read(spark, path, payload="false").where("record_type = 'revisit' and length(record_id) > 0")
    some = revisits.collect()
    assert 0 < len(some) <= 50 and all(r.record_type == "revisit" and r.payload is None for r in some)
    reader = warc.WarcReader({"path": path, "payload": "false"})
    rest = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("file",), "x")]))
    assert len(rest) == 1
    inflated = []
    monkeypatch.setattr(warc.Source, "read", lambda self, n: inflated.append(n))
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(got) == len(some) and not inflated
    files = list(tmp_path.joinpath("w").glob("*.warc.gz"))
    assert sum(gzip.open(f).read().count(b"WARC/1.1\r\nWARC-Type") for f in files) == 100


def test_foreign_members_and_plain_files(spark, tmp_path):
    records = [warc.record(i, "http://e.x", b"p" * i, "00" * 20, None, "1970-01-01T00:00:00Z") for i in range(50)]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    rows = warc.read(spark, str(tmp_path), range="700").collect()
    assert sorted(len(r.payload) for r in rows) == sorted([*range(50)] * 2)
    assert len(warc.read(spark, f"{tmp_path}/b.warc.gz", payload="false", range="900").where("record_type = 'response'").collect()) == 50


def records(n, size=40):
    return [warc.record(i, "http://e.x", b"p" * (size + i), "00" * 20, None, "1970-01-01T00:00:00Z") for i in range(n)]


def test_members_of_many_records(spark, tmp_path):
    some = records(5)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(some)) + gzip.compress(b"".join(some[:2])) + warc.member(b"".join(some)))
    for payload in ("true", "false"):
        rows = warc.read(spark, str(tmp_path), payload=payload).collect()
        assert len(rows) == 12 and all(r.record_type == "response" for r in rows)
    assert sorted(len(r.payload) for r in warc.read(spark, str(tmp_path), range="64").collect()) == sorted([*range(40, 45)] * 2 + [40, 41])


def test_damaged_files(spark, tmp_path):
    """Damage becomes a row with x-error, and what follows it is read."""
    some = records(6)
    bad = some[2].replace(b"Content-Length: ", b"Content-Length: x")
    endless = b"WARC/1.1\r\n" + b"A: b\r\n" * 10
    (tmp_path / "a.warc").write_bytes(some[0] + bad + some[1] + b"junk\n" + some[3])
    (tmp_path / "b.warc").write_bytes(some[0] + some[1][:-30])
    (tmp_path / "c.warc").write_bytes(endless)
    members = [gzip.compress(r) for r in some]
    (tmp_path / "d.warc.gz").write_bytes(members[0] + gzip.compress(bad) + members[1] + members[2][:-40])
    own = [warc.member(r) for r in some]
    torn = bytearray(own[1])
    torn[60:90] = b"\0" * 30
    (tmp_path / "e.warc.gz").write_bytes(own[0] + bytes(torn) + own[2] + own[3][:-20])
    (tmp_path / "f.warc").write_bytes(b"")
    want = {"a.warc": ([40, 41, 43], 2), "b.warc": ([40], 1), "c.warc": ([], 1), "d.warc.gz": ([40, 41], 2), "e.warc.gz": ([40, 42], 2)}
    for name, (sizes, errors) in want.items():
        rows = warc.read(spark, f"{tmp_path}/{name}").collect()
        assert sorted(len(r.payload) for r in rows if r.record_type) == sizes, name
        assert sum("x-error" in r.headers for r in rows) == errors == sum(r.record_type is None for r in rows), name
        assert len(warc.read(spark, f"{tmp_path}/{name}").where("record_type = 'response'").collect()) == len(sizes), name
        assert len(warc.read(spark, f"{tmp_path}/{name}", payload="false").where("record_type = 'response'").collect()) >= len(sizes), name
        try:
            warc.read(spark, f"{tmp_path}/{name}", mode="FAILFAST").collect()
            raise AssertionError(name)
        except PythonException:
            pass


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()]
    assert sorted((tuple(r) for r in queries.op7_warc(spark, SF).collect()), key=str) == expected(rows)
