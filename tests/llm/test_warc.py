import hashlib
import random

from pyspark.sql import functions as F

from quirefold.llm import warc


def brute(rows):
    largest = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= warc.REVISIT:
            largest[html] = max(page, largest.get(html, page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        to = largest.get(html) if len(data) >= warc.REVISIT else None
        again = to is not None and to != page
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


def pages():
    draw = random.Random(2)
    bodies = ["é" * 600, "x" * 999, "y" * 1000, "WARC/1.1\r\n\r\n" * 100, "\r\n\r\n", "z\n" * 4000]
    rows = [(i, f"http://h{draw.randrange(5)}.example.org/{draw.randrange(9)}?q#f", draw.choice(bodies)) for i in range(300)]
    return [*rows, (None, "x\r\ny", "y" * 1000), (1000, None, None), (1001, "", ""), (1001, "", ""), (None, None, "alone" * 300), (None, None, "alone" * 300)]


def test_round_trip(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(5)
    warc.write_archives(df, str(tmp_path / "a"))
    index = warc.merged_index(warc.read_archives(spark, str(tmp_path / "a"))).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index), key=str) == brute(rows)
    order = [(r.url_key, r.captured, -(1 << 63) if r.page_id is None else r.page_id) for r in sorted(index, key=lambda r: (r.part, r.seq))]
    assert order == sorted(order)
    assert len({r.run for r in index}) > 1


def test_files_by_bytes_and_ranges_by_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CLASSES", ((999, 50), (1200, 3), (None, 1)))
    monkeypatch.setattr(warc, "RANGE_ROWS", 10)
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "a"))
    sizes = [len(list(warc.parse(p.read_bytes()))) for p in (tmp_path / "a").glob("part-*")]
    largest = [max((len(r["payload"]) for r in warc.parse(p.read_bytes())), default=0) for p in (tmp_path / "a").glob("part-*")]
    assert all(n <= (50 if m <= 999 else 3 if m <= 1200 else 1) for n, m in zip(sizes, largest))
    index = warc.merged_index(warc.read_archives(spark, str(tmp_path / "a"))).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index), key=str) == brute(rows)
    assert len({r.part for r in index}) > 20
    order = [(r.url_key, r.captured, -(1 << 63) if r.page_id is None else r.page_id) for r in sorted(index, key=lambda r: (r.part, r.seq))]
    assert order == sorted(order)


def test_empty(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "a"))
    assert warc.merged_index(warc.read_archives(spark, str(tmp_path / "a"))).count() == 0


def test_loser_tree():
    draw = random.Random(1)
    for n in range(9):
        runs = [sorted((draw.randrange(20), i) for _ in range(draw.randrange(6))) for i in range(n)]
        assert [k for k, _ in warc.LoserTree([iter([(x, 0) for x in r]) for r in runs])] == sorted(x for r in runs for x in r)


def test_url_key(spark):
    df = spark.createDataFrame([("https://www.a.B.org:80/x?y#z",), ("http://h",), ("odd",), (None,)], "url string")
    assert [r[0] for r in df.select(warc.url_key(F.col("url"))).collect()] == ["org,b,a)/x?y", "h)", "odd", ""]
