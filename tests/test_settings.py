from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quirefold.functions import markup, normalize
from quirefold.plans.normalize import normalize as normalize_all
from quirefold.plans.normalize import normalize_by_work
from quirefold.queries import SPANS
from quirefold.sources import settings

FILES = {
    1: ("enable_convert_num_to_kanji=false\nenable_ruby=off\nkanji_num_with_units_lower_digit_zero=x", "(\\w+)ing\\b\t<\\1>\na\t\\1\n;no\trule\nempty\t"),
    2: ("enable_transform_date=true\ndate_format=%y-%-m'%d\nenable_convert_page_break=true\nto_page_break_threshold=4\nenable_illust=0\nenable_erase_postscript=true", None),
    3: ("﻿[x]\nenable_auto_indent=false\nenable_alphabet_force_zenkaku=true\nenable_erase_introduction=1\nto_page_break_threshold=-3\nenable_convert_page_break=true", "[x\ty\n^(?P<all_of>.)\t\\g<all_of>\\g<all_of>"),
    4: ("enable_convert_horizontal_ellipsis=false\nkanji_num_with_units_lower_digit_zero=5\nenable_half_indent_bracket=false\nenable_dakuten_font=false", ""),
    5: (None, None),
}
TEXTS = ["", None, SPANS, "übing [x\n\n\n\n\n\n次 ４０００００年 2024／2／3 ・・・・", "Hello world 第12章"]


@pytest.mark.parametrize("kind", ["body", "introduction", "postscript", "chapter"])
def test_by_work_as_single_runs(spark, kind):
    files = spark.createDataFrame([(k, *v) for k, v in FILES.items()], "work_id long, ini string, replacements string")
    rows = [(w, i, t) for w in (*FILES, 6, None) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "work_id long, i int, text string").withColumn("enable_ruby", F.lit("mine"))
    done = normalize_by_work(df, settings.by_work(files), kind=kind)
    assert done.columns == [*df.columns, "normalized"]
    got = {(r.work_id, r.i): r.normalized for r in done.collect()}
    assert len(got) == len(rows)
    for work in (*FILES, 6):
        own = settings.load(*(x or "" for x in FILES.get(work, ("", ""))))
        if work == 1:
            own = replace(own, enable_ruby=True, kanji_num_with_units_lower_digit_zero=3)  # "off" is a text, which counts as true
        want = normalize_all(spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string"), kind=kind, settings=own).collect()
        assert {r.i: r.normalized for r in want} == {i: got[work, i] for i in range(len(TEXTS))}
    assert all(got[None, i] == got[6, i] for i in range(len(TEXTS)))
    assert normalize_by_work(df.limit(0), settings.by_work(files.limit(0))).count() == 0


def test_files_of_works(spark, tmp_path):
    for name, ini, rules in (("n1", "enable_ruby=false", "a\tb"), ("n2", None, "c\td"), ("n3", "enable_illust=false", None)):
        (tmp_path / name).mkdir()
        if ini:
            (tmp_path / name / "setting.ini").write_text(ini, encoding="utf-8-sig")
        if rules:
            (tmp_path / name / "replace.txt").write_text(rules, encoding="utf-8-sig")
        (tmp_path / name / "other.txt").write_text("x")
    found = {r.work: r for r in settings.by_work(settings.read_by_work(spark, str(tmp_path)), "work").collect()}
    assert set(found) == {"n1", "n2", "n3"}
    assert found["n1"].enable_ruby is False and found["n1"].enable_illust is None and [tuple(r) for r in found["n1"].rules] == [("a", "b")]
    assert found["n3"].enable_illust is False and found["n3"].rules == [] and len(found["n2"].rules) == 1


def test_characters_of_fixed_sets(spark):
    df = spark.createDataFrame([("한글《x》 漢字《かんじ》", "何！[a] 何！］ 何?[b")], "a string, b string")
    got = df.select(markup.xhtml(F.col("a")), normalize.space_after_marks(F.col("b"))).first()
    assert got[0] == "<p>한글《x》 <ruby>漢字<rt>かんじ</rt></ruby></p>"
    assert got[1] == "何！　[a] 何！］ 何?　[b"


@pytest.mark.parametrize("broadcast", [10_000, 0])
def test_one_works_texts_are_spread(spark, broadcast, monkeypatch):
    """All texts of a work went to one task, unless Spark happened to broadcast the settings."""
    from quirefold.plans import normalize as plan

    monkeypatch.setattr(plan, "BROADCAST", broadcast, raising=False)
    files = spark.createDataFrame([(1, FILES[1][0], None)], "work_id long, ini string, replacements string")
    df = spark.range(400).select(F.lit(1).cast("long").alias("work_id"), F.concat(F.lit("あ"), F.col("id").cast("string")).alias("text")).repartition(4)
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        done = normalize_by_work(df, settings.by_work(files))
        rows = done.select("*", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert done.columns == ["work_id", "text", "normalized"] and len(rows) == 400 and len({r.task for r in rows}) > 1
    assert {r.text: r.normalized for r in rows}["あ12"] == "　あ［＃縦中横］12［＃縦中横終わり］"
