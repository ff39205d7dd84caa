import io
import zipfile

from pyspark.sql import functions as F

from quirefold.operators import assemble, diff, outcomes
from quirefold.plans.books import books, books_or_errors

ELEMENT = "struct<introduction:string,body:string,postscript:string,data_type:string>"
WORKS = "work_id long, title string, author string, sitename string, book_id string, modified string"
SECTIONS = f"work_id long, index string, subtitle string, chapter string, element {ELEMENT}"


def test_nulls_make_whole_packages(spark):
    works = spark.createDataFrame([(1, None, None, None, None, None), (2, "題", "著", "例", "b", "2024")], WORKS)
    sections = spark.createDataFrame([(1, "1", None, None, (None, None, None, None)), (1, "2", "T", None, None), (2, "1", "T", "章", ("", "本文", "", "text"))], SECTIONS)
    made = {r.work_id: zipfile.ZipFile(io.BytesIO(bytes(r.archive))) for r in books(works, sections).collect()}
    assert set(made) == {1, 2} and all(z.testzip() is None for z in made.values())
    assert "OEBPS/Text/section_0001.xhtml" in made[1].namelist() and "OEBPS/Text/section_0002.xhtml" not in made[1].namelist()
    assert "urn:uuid:1<" in made[1].read("OEBPS/content.opf").decode() and assemble.UNDATED in made[1].read("OEBPS/content.opf").decode()


def test_bad_works_and_good_ones(spark):
    works = spark.createDataFrame([(i, f"W{i}", "", "", "b", "m") for i in range(6)], WORKS)
    text = ("", "本文［＃挿絵（a.png）入る］", "", "text")
    rows = [(i, "1", "T", "", ("", "［＃挿絵（a.png）入る］", "", "text")) for i in range(6)] + [(1, "one", "T", "", text), (4, None, "T", "", text)]
    images = spark.createDataFrame([(2, "../a.png", b"x"), (3, "a/b.png", b"x"), (0, "a.png", b"1"), (5, "a.png", None), (4, "..", b"x")], "work_id long, filename string, data binary")
    made = {r.work_id: r for r in books_or_errors(works, spark.createDataFrame(rows, SECTIONS), images=images).collect()}
    assert {w: r.error for w, r in made.items()} == {0: None, 1: "an index that isn't a number: one", 2: "leaves its folder: ../a.png", 3: "leaves its folder: a/b.png", 4: "an index that isn't a number: null", 5: None}
    assert "OEBPS/Images/a.png" in zipfile.ZipFile(io.BytesIO(bytes(made[0].archive))).namelist()
    assert all((r.archive is None) == (r.error is not None) for r in made.values())
    report = outcomes.report(works, works.where("work_id > 2"), [spark.createDataFrame(list({(w, r.error) for w, r in made.items()}), "work_id long, error string")])
    assert {r.work_id: r.status for r in report.collect()} == {0: "none", 1: "failed", 2: "failed", 3: "failed", 4: "failed", 5: "ok"}
    assert tuple(outcomes.counters(report).first()) == (6, 2, 4, 1)
    assert tuple(outcomes.counters(outcomes.report(works.limit(0), works, [])).first()) == (0, 0, 0, 0)


def test_files_that_make_no_archive(spark):
    files = spark.createDataFrame([(1, "mimetype", b"m"), (1, "a", b"1"), (2, "a", b"1"), (2, "a", b"2"), (3, "b", None), (None, "a", b"1"), (4, None, b"1")], "work_id long, path string, content binary")
    got = {r.work_id: r for r in assemble.archives_or_errors(files).collect()}
    assert set(got) == {1, 2, 3} and got[1].error is None and zipfile.ZipFile(io.BytesIO(bytes(got[1].archive))).namelist() == ["mimetype", "a"]
    assert got[2].error == "ValueError: two files of one name: a" and got[3].error == "ValueError: a file without content: b"
    assert [r.work_id for r in assemble.archives(files).collect()] == [1]


def test_first_error_stays(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, None, 3)], "work_id long, t string, n int")
    once = outcomes.checked(df, [(F.col("t") != "b", "no b"), (F.col("t").isNotNull(), F.concat(F.lit("null at "), F.col("n").cast("string")))])
    assert [r.error for r in once.orderBy("n").collect()] == [None, "no b", "no b"]
    twice = outcomes.checked(once, [(F.col("n") < 3, "large"), (F.lit(False), F.lit(None).cast("string"))])
    assert [r.error for r in twice.orderBy("n").collect()] == ["unknown", "no b", "no b"]
    assert sorted(tuple(r) for r in outcomes.errors_by_work(twice, order="n").collect()) == [(1, "unknown", 2), (2, "no b", 1)]


def test_status_of_failed_works(spark):
    judged = spark.createDataFrame([(1, "new"), (1, None), (2, None), (3, "new")], "work_id long, reason string")
    known = spark.createDataFrame([(1,), (2,), (3,)], "work_id long")
    failed = spark.createDataFrame([(3, "b"), (3, "a"), (9, "gone"), (2, None)], "work_id long, error string")
    got = {r.work_id: (r.episodes, r.changed, r.is_new, r.new_arrivals, r.status, r.error) for r in diff.run_status(judged, known, failed=failed).collect()}
    assert got == {1: (2, 1, False, True, "ok", None), 2: (1, 0, False, False, "none", None), 3: (1, 1, False, False, "failed", "a"), 9: (0, 0, True, False, "failed", "gone")}
