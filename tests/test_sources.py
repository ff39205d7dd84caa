import pytest
from pyspark.errors import IllegalArgumentException
from pyspark.sql import functions as F

from quirefold.functions import html, strings
from quirefold.operators import assemble, catalog, diff, illustrations, toc
from quirefold.plans.books import books
from quirefold.sources import rules, settings, store
from quirefold.sources.shared import spread
from quirefold.streaming.snapshots import follow


def test_settings():
    s = settings.load("\ufeff[global]\n; note\nenable_ruby = false\nto_page_break_threshold=4\ndate_format=%Y\nother=1\n", "a\tb\nc\t\n;x\ty\nbad\n")
    assert (s.enable_ruby, s.to_page_break_threshold, s.date_format) == (False, 4, "%Y")
    assert s.replace_pattern == [("a", "b")]
    assert settings.parse_replacements("c\t\n", keep_deletions=True) == [("c", "")]
    assert settings.parse_ini(settings.format_ini(s))["enable_ruby"] is False
    kv = settings.KeyValues()
    kv.set("a", 1, "global")
    kv.set("a", 2)
    assert kv.get("a") == 2
    kv.delete("a")
    assert (kv.get("a"), kv.get("b", 3)) == (1, 3)


def test_rules(tmp_path):
    site = rules.builtin()[0]
    assert site.resolve("toc_url", {"ncode": "n1a"}) == "https://ncode.syosetu.com/n1a/"
    assert site.resolve("toc_url", {"ncode": ""}) == "https://ncode.syosetu.com//"
    assert site.resolve("toc_url") == "https://ncode.syosetu.com/\\\\k<ncode>/"
    assert site.resolve("novel_type_string")["短編"] == 2
    assert site.pattern("subtitles").groups == {"chapter": 1, "href": 2, "index": 3, "subtitle": 4, "subdate": 5, "subupdate": 6}
    (tmp_path / "b.json").write_text('{"name": "b"}')
    (tmp_path / "a.json").write_text('{"name": "a"}')
    (tmp_path / "c.json").write_text("[1]")
    assert [s.raw("name") for s in rules.load(str(tmp_path))] == ["a", "b"]


def test_match_takes_the_first_pattern(spark):
    df = spark.createDataFrame([("a1",), ("b2",), ("c",)], "t string")
    patterns = [rules.Rule(r"a(?<x_1>\d)(?<y>z)?"), rules.Rule("(bad"), rules.Rule(r"[ab](?<x_1>\d)")]
    assert [tuple(r.m) for r in df.select(rules.match(F.col("t"), patterns).alias("m")).collect()] == [("1", ""), ("2", ""), (None, None)]


def test_catalog(spark):
    rows = [(1, "魔法の書", "田中", "u1", "2025-01-01 00:00:00"), (2, "Magic", "山田", "u2", None), (3, "剣", "田中 太郎", "u3", "2025-01-03 00:00:00")]
    works = spark.createDataFrame(rows, "id long, title string, author string, toc_url string, last_update string")
    assert [r.id for r in catalog.listing(works, "last_update; drop").collect()] == [3, 1, 2]
    assert [r.id for r in catalog.search(works, "田中").collect()] == [3, 1]
    assert [r.id for r in catalog.search(works, "mAGIC").collect()] == [2]
    assert [r.id for r in catalog.search(works, "' OR 1=1 --").collect()] == []
    assert catalog.get(works, 4).count() == 0
    with pytest.raises(IllegalArgumentException):
        catalog.insert(works, works.limit(1))
    more = catalog.insert(works, works.limit(1).withColumn("toc_url", F.lit("u9")))
    assert {r.id for r in more.collect()} == {1, 2, 3, 4}
    stored = spark.createDataFrame([(1, 1, "a,b", "2025-01-01T10:00:00"), (2, 0, "", None)], "id long, is_end int, tags string, last_update string")
    for c in catalog.WORKS.fieldNames():
        if c not in stored.columns:
            stored = stored.withColumn(c, F.lit(0) if c == "use_subdirectory" else F.lit(None).cast("string"))
    decoded = catalog.decode(stored)
    assert [r.tags for r in decoded.orderBy("id").collect()] == [["a", "b"], []]
    assert [r.last_update for r in catalog.encode(decoded).orderBy("id").collect()] == ["2025-01-01T10:00:00", None]


def test_diff(spark):
    schema = "work_id long, index string, ordinal long, subtitle string, chapter string, subdate string, subupdate string"
    old = spark.createDataFrame([(1, "1", 0, "x", "", "1", ""), (1, "1", 1, "a", "", "2", ""), (1, "2", 2, "b", "", "2", "3"), (1, "4", 3, "gone", "", "1", "")], schema)
    new = spark.createDataFrame([(1, "1", 0, "a", "", "2", ""), (1, "2", 1, "b", "", "2", "4"), (1, "3", 2, "c", None, "1", None)], schema)
    assert sorted((r["index"], r.reason) for r in diff.snapshot_diff(new, old, old_rows=4).collect()) == [("2", "date"), ("3", "new")]
    assert diff.snapshot_diff(new, new).count() == 0
    assert diff.snapshot_diff(new, old, force=True).count() == 3


def test_follow(spark, tmp_path):
    schema = "work_id long, index string, ordinal long, subtitle string, chapter string, subdate string, subupdate string"
    path = {k: str(tmp_path / k) for k in ("in", "state", "changes", "check")}
    for title in ("a", "b"):
        df = spark.createDataFrame([(1, "1", 0, title, "", "2", ""), (1, "2", 1, "same", "", "2", "")], schema)
        df.coalesce(1).write.mode("append").parquet(path["in"])
        stream = spark.readStream.schema(df.schema).parquet(path["in"])
        follow(stream, df.schema, path["state"], path["changes"], path["check"]).awaitTermination()
    got = spark.read.parquet(path["changes"]).collect()
    assert sorted((r.batch, r["index"], r.reason) for r in got) == [(0, "1", "new"), (0, "2", "new"), (1, "1", "title")]


def test_sections(spark, tmp_path):
    lines = ['{"work_id":1,"index":"10","subtitle":"ten","element":{"body":"b"},"download_time":"1"}', '{"work_id":1,"index":"9","subtitle":"old","element":{"body":"b"},"download_time":"1"}', '{"work_id":1,"index":"9","subtitle":"nine","element":{"body":"b"},"download_time":"2"}', "not json", '{"work_id":1,"index":"x"}']
    (tmp_path / "s.json").write_text("\n".join(lines))
    got = store.in_order(store.read_sections(spark, str(tmp_path / "s.json"))).orderBy("ordinal").collect()
    assert [(r.ordinal, r.subtitle) for r in got] == [(1, "nine"), (2, "ten")]
    assert store.read_or_empty(spark, str(tmp_path / "none"), store.SECTIONS).count() == 0
    paths = spark.createDataFrame([("a/../b",), ("../a",), ("a/../../b",), ("/a",), ("C:\\a",), ("..a/b",)], "p string")
    assert [r[0] for r in paths.select(store.inside(F.col("p"))).collect()] == [True, False, False, False, False, True]


def test_html_edges(spark):
    base = F.lit("http://h/a/b?c#d")
    srcs = ["x", "../x", "./x", "/x", "//g/x", "?y", "#z", "", "http://q/", "../../../x", "e/../x"]
    df = spark.createDataFrame([(s,) for s in srcs], "s string")
    want = ["http://h/a/x", "http://h/x", "http://h/a/x", "http://h/x", "http://g/x", "http://h/a/b?y", "http://h/a/b?c#z", "http://h/a/b?c#d", "http://q/", "http://h/x", "http://h/a/x"]
    assert [r[0] for r in df.select(html.resolve(F.col("s"), base)).collect()] == want
    text = spark.createDataFrame([("&amp;lt; &amp;quot; <a\nb>\r",)], "t string")
    assert text.select(strings.pretreat(F.col("t")), html.drop_tags(F.col("t"))).first()[:] == ("< &quot; <a\nb>", "&amp;lt; &amp;quot; <a\nb>\r")
    assert text.select(strings.code_illustrations(F.lit("a <i12|34>\nb"), "http://{0}.x/{1}/")).first()[0] == "a［＃挿絵（http://34.x/i12/）入る］b"


def test_books(spark):
    import io
    import zipfile

    works = spark.createDataFrame([(1, "題 & 名", "著者", "", "id", "now"), (2, "空", "誰", "site", "id2", "now")], "work_id long, title string, author string, sitename string, book_id string, modified string")
    element = F.struct(F.lit("前").alias("introduction"), F.lit("一\n二").alias("body"), F.lit("").alias("postscript"), F.lit("text").alias("data_type"))
    sections = spark.createDataFrame([(1, "2", "二話", ""), (1, "1", "一話", "第一章")], "work_id long, index string, subtitle string, chapter string").withColumn("element", element)
    made = {r.work_id: zipfile.ZipFile(io.BytesIO(bytes(r.archive))) for r in books(works, sections, css="p{}").collect()}
    names = made[1].namelist()
    assert names[0] == "mimetype" and made[1].getinfo("mimetype").compress_type == zipfile.ZIP_STORED
    assert "OEBPS/Text/section_0001.xhtml" in names and "OEBPS/Text/section_0002.xhtml" in names
    page = made[1].read("OEBPS/Text/section_0001.xhtml").decode()
    assert "<h2>一話</h2>" in page and '<div class="preface">\n<p>　前</p>\n</div>\n<p>　一</p>\n<p>　二</p>' in page
    toc = made[1].read("OEBPS/toc.xhtml").decode()
    assert toc.index("<span>第一章</span>") < toc.index("一話") < toc.index("二話")
    assert "題 &amp; 名" in made[1].read("OEBPS/content.opf").decode()
    assert 'href="Text/titlepage.xhtml">空' in made[2].read("OEBPS/toc.xhtml").decode()
    images = spark.createDataFrame([(1, 1, "a.png", None), (1, 2, "a.png", bytearray(b"x")), (1, 3, "a.png", bytearray(b"y"))], "work_id long, idx long, filename string, data binary")
    assert [(r.idx, bytes(r.data)) for r in assemble.first_images(images).collect()] == [(2, b"x")]


def test_multi_match(spark):
    site = rules.SiteRules({"top": "x", "a": [r"(bad", r"(?<p>q)", r"(?<p>\d)(?<q>z)?"], "b": r"(?<q>[x-z])\\k<top>", "c": "none"})
    df = spark.createDataFrame([("1zyx",), ("5",), ("zx",), ("",), (None,)], "t string")
    got = [tuple(r.m) for r in df.select(rules.multi_match(F.col("t"), site, ["a", "missing", "b", "c"]).alias("m")).collect()]
    assert got == [("1", "y"), ("5", ""), (None, "z"), (None, None), (None, None)]


def test_stored_contents_and_raw_pages(spark, tmp_path):
    path, raw = str(tmp_path / "toc"), str(tmp_path / "raw")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "work_id long, title string")
    store.write_contents(first, path)
    store.write_contents(spark.createDataFrame([(2, "c"), (3, "d")], first.schema), path)
    assert sorted(map(tuple, store.read_contents(spark, path, first.schema).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    pages = spark.createDataFrame([(1, "1", "始め", "<p>"), (1, "2", None, None)], "work_id long, index string, file_subtitle string, html string")
    store.write_raw(pages, raw)
    assert {r.path for r in store.read_raw(spark, raw).collect()} == {"raw/1 始め.html", "raw/2 .html"}
    with pytest.raises(Exception, match="leaves its folder"):
        store.write_raw(pages.withColumn("index", F.lit("../../x")), raw)


def test_linked_illustrations(spark):
    note = "［＃挿絵（{}）入る］".format
    rows = [(1, note("http://a") + "x" + note("http://b") + note("c.png")), (1, note("http://b")), (2, None), (None, note("http://a")), (3, ""), (4, "p<i1|2>\nq<i3|4>")]
    texts = spark.createDataFrame(rows, "id long, text string")
    images = spark.createDataFrame([("http://a", "a2.png"), ("http://a", "a1.png"), ("http://b", None), ("http://2.x/i1/", "i1.jpg")], "url string, filename string")
    got = [r.text for r in illustrations.link(texts, images, "id", "text", "http://{0}.x/{1}/").orderBy(F.col("id").asc_nulls_first(), F.length("text").desc()).collect()]
    assert got == ["", note("a1.png") + "x" + note("c.png"), "", None, "", "p" + note("i1.jpg") + "q"]
    assert illustrations.link(texts.limit(0), images, "id", "text").count() == 0


def test_contents_without_information(spark):
    site = rules.builtin()[0]
    info = "title string, writer string, story string, end boolean, novel_type int, general_firstup timestamp_ntz, novelupdated_at timestamp_ntz, general_lastup timestamp_ntz"
    works = spark.createDataFrame([(1, "u", ("", "w", "", False, 1, None, None, None)), (2, "u", None), (3, "u", ("t", "w", "s", True, 1, None, None, None))], f"work_id long, toc_url string, info struct<{info.replace(' string', ':string').replace(' boolean', ':boolean').replace(' int', ':int').replace(' timestamp', ':timestamp')}>")
    pages = spark.createDataFrame([(1, 1, "<h1>page &amp; title</h1>")], "work_id long, page_no int, html string")
    assert [r.work_id for r in toc.tables_of_contents(works, pages, site).collect()] == [3]
    titled = rules.SiteRules({**site.values, "title": "<h1>(?<title>.+?)</h1>", "story": "<h2>(?<story>.+?)</h2>"})
    got = {r.work_id: r for r in toc.tables_of_contents(works, pages, titled).collect()}
    assert set(got) == {1, 3} and (got[1].title, got[1].author, got[1].story, got[1].subtitles) == ("page & title", "", "", [])
    assert (got[3].title, got[3].end, got[3].subtitles) == ("t", True, [])


def test_spread(spark):
    small = spark.range(100).coalesce(1)
    assert spread(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(100).repartition(50)
    assert spread(wide) is wide


def test_stored_images(spark):
    from quirefold.operators import illustrations

    names = ["https://h/a/b.c.jpg?x=/y.z", "https://h/a/", "https://h/.hidden", "b.", "x", "", None, "a/b.png#c/d.e"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(names)], "i int, url string")
    assert [r[0] for r in df.select("i", illustrations.basename(F.col("url")).alias("n")).orderBy("i").select("n").collect()] == ["b.c", "a", ".hidden", "b.", "x", "", None, "b"]
    files = spark.createDataFrame([(1, "b.c.webp"), (1, "b.c.png"), (1, "b.c.svg"), (2, "x.gif"), (1, "plain")], "work_id int, filename string")
    wanted = df.withColumn("work_id", F.lit(1))
    assert {r.i: r.filename for r in illustrations.stored_images(wanted, files).collect()} == {0: "b.c.png"} | dict.fromkeys(range(1, 8))
