"""Stages and the whole chain on literals whose results were derived by hand."""

import pytest
from pyspark.sql import functions as F

from quirefold.functions import normalize as n
from quirefold.plans.normalize import normalize
from quirefold.sources.settings import Settings

STAGES = [
    (n.full_kana, "ｶﾞｷﾞﾊﾟｳﾞ", "ガギパヴ"),
    (n.full_kana, "カ゛ハ゜か゛—", "ガパか゛―"),
    (n.join_in_brackets, "「一\n　二\n\t三」\n「四」", "「一二三」\n「四」"),
    (n.join_in_brackets, "「外「中\n身」外\n」", "「外「中身」外」"),
    (n.join_in_brackets, "『一\n二』「三\n", "『一二』「三\n"),
    (n.join_lines, "と、\n　続く", "と、続く"),
    (n.join_lines, "と、\n　「開く", "と、\n　「開く"),
    (n.drop_comments, "a\n==========\nx\n==========\nb", "a\n\nb"),
    (n.site_tags, "<B>太</B>\n-----\n----", "［＃ゴシック体］太［＃ゴシック体終わり］\n［＃区切り線］\n----"),
    (n.roman_numerals, "II IV X 第II章 viii", "Ⅱ Ⅳ X 第II章 ⅷ"),
    (n.wide_latin, "aZ1", "ａＺ1"),
    (n.wide_symbols, "'x' 《z》 a-b\\", "〝x〟 ≪z≫ a－b￥"),
    (n.wide_symbols, "\"y\" 'x", "〝y〟 ‘x"),
    (n.wide_symbols, "'x' \"y\"", "〝x〟 〟y”"),
    (n.decimal_points, "3.14 1.2.3 a.b", "3・14 1・2.3 a.b"),
    (n.wide_numbers, "1 12 123 ２", "１ ［＃縦中横］12［＃縦中横終わり］ １２３ ２"),
    (n.digits_by_letters, "Ａ一二 三㎏ 四", "Ａ１２ ３㎏ 四"),
    (lambda t: n.kanji_units(t, 3), "一〇〇〇 一〇〇〇〇 一〇〇〇〇〇 一〇〇〇五 一〇〇〇〇五 〇〇〇 一〇〇", "一〇〇〇 一万 十万 一万五 十万五 〇〇〇 一〇〇"),
    (lambda t: n.kanji_units(t, 3), "二〇〇〇〇〇〇〇〇 一" + "〇" * 20, "二億 一" + "〇" * 20),
    (n.space_after_marks, "本当！?嘘 「え！」 はい！ え？\n終！", "本当！?　嘘 「え！」 はい！　え？　\n終！"),
    (n.ellipses, "・・・ ・・・・ ・・ 。。。．．．──", "… …… ・・ ……――"),
    (lambda t: n.ellipses(t, False), "・・・。。。", "・・・…"),
    (n.fractions, "三／四", "四分の三"),
    (n.dates, "2024／２／３ 2024／13／1 ２０２４／１／１", "2024年02月03日 2024／13／1 ２０２４／１／１"),
    (n.mark_font, "か゛ア゛漢゛", "［＃濁点］か［＃濁点終わり］［＃濁点］ア［＃濁点終わり］漢゛"),
    (n.readings, "その漢字≪かんじ≫ 東京（とうきょう） 漢｜≪x≫ か（き）", "その※［＃縦線］漢字《かんじ》 ※［＃縦線］東京《とうきょう》 ※［＃縦線］漢《x》 か（き）"),  # behind a （ the kept reading gets （）, which the next pass reads
    (n.readings, "漢｜≪x≫ か（き）", "漢≪x≫ か（き）"),
    (n.indent, "あ\n\n「い\n――う", "　あ\n　\n「い\n　――う"),
    (n.half_indent, "　「あ\nい「", "［＃二分アキ］「あ\nい「"),
    (n.pack_blank_lines, "a\n\n\n\n\nb\n\n\nc", "a\n\n\nb\n\n\nc"),
    (lambda t: n.page_breaks(t, 3), "a\n\n\n\nb\n\nc", "a\n［＃改ページ］\nb\n\nc"),
    (lambda t: n.user_rules(t, [(r"(a)(b)", r"\2$\1"), ("[x", "y")]), "ab [x", "b$a y"),
]


@pytest.mark.parametrize("number", range(len(STAGES)))
def test_stage(spark, number):
    stage, text, want = STAGES[number]
    assert spark.createDataFrame([(text,)], "t string").select(stage(F.col("t"))).first()[0] == want


WHOLE = [
    ("今日は100人と12人。", {}, "　今日は100人と一二人。"),
    ("https://x.example/a?b=1 へ", {}, "https://x.example/a?b=1 へ"),
    ("［＃挿絵（a 1.png）入る］", {}, "［＃挿絵（a 1.png）入る］"),
    ("［＃挿絵（a.png）入る］", {"enable_illust": False}, ""),
    ("ABC", {}, "　ＡＢＣ"),
    ("Hello world", {}, "Hello world"),
    ("Hello world", {"enable_alphabet_force_zenkaku": True}, "　Ｈｅｌｌｏ ｗｏｒｌｄ"),
    ("－１－", {}, "　　　［＃ゴシック体］－１－［＃ゴシック体終わり］"),
    ("三百人", {}, "　三百人"),
    ("2024", {"enable_convert_num_to_kanji": False}, "　２０２４"),
    ("", {}, ""),
    (None, {}, ""),
]


@pytest.mark.parametrize("number", range(len(WHOLE)))
def test_whole(spark, number):
    text, changed, want = WHOLE[number]
    df = spark.createDataFrame([(text,)], "text string")
    got = normalize(df, settings=Settings(**changed)).first().normalized
    assert got == want


def test_kinds(spark):
    df = spark.createDataFrame([("3話 A-1",)], "text string")
    assert normalize(df, kind="subtitle").first().normalized == "３話 A－１"
    assert normalize(df, kind="story").first().normalized == "３話 A-１"
    assert normalize(df, kind="introduction", settings=Settings(enable_erase_introduction=True)).first().normalized == ""
    assert normalize(df.withColumn("normalized", F.lit(1)), kind="postscript").first().normalized.startswith("［＃ここから後書き］\n")


def test_readings_in_their_line(spark):
    import re

    def plain(text):
        def ruby(m):
            whole, base, read = m[0], m[1], m[2]
            if base.endswith("｜"):
                return base[:-1] + (f"（{read}）" if "（" in whole else f"≪{read}≫")
            own = re.search("[一-龠Ａ-Ｚａ-ｚA-Za-z]+$", base)
            return f"{base[: own.start()]}{own[0]}《{read}》" if own else whole

        for span in ("(.+?)≪([^≪]+?)≫", "(.+?)（([ぁ-んァ-ヶーゝゞ・Ａ-Ｚａ-ｚA-Za-z 　]{1,20})）"):
            text = re.sub(span, ruby, text)
        return re.sub("[｜]", "※［＃縦線］", text)

    import random

    draw = random.Random(8)
    texts = ["".join(draw.choice("山川a ｜≪≫（）≪≫（）かカ\nー。") for _ in range(draw.randrange(0, 30))) for _ in range(2000)] + ["山（x） 川｜≪かわ≫", "あ" * 5000 + "≪", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.x for r in df.select("i", n.readings(F.col("t")).alias("x")).orderBy("i").collect()]
    assert [(t, g) for t, g in zip(texts, got, strict=True) if g != (None if t is None else plain(t))] == []


def _seconds(spark, text, change):
    import time

    df = spark.createDataFrame([(text,)], "t string")
    df.select(F.length(change(F.lit("a")))).collect()
    began = time.perf_counter()
    got = df.select(change(F.col("t"))).first()[0]
    return got, time.perf_counter() - began


def test_wrap_is_one_pass(spark):
    """Pieces were cut out by walking from the text's start to each of them: over a minute here."""
    from quirefold.functions import strings

    text = "あ𠮷\nb" * 150_000
    got, took = _seconds(spark, text, lambda t: F.array_join(strings.wrap(t, 7), "|"))
    assert got == "|".join(text[i : i + 7] for i in range(0, len(text), 7)) and took < 20
    df = spark.createDataFrame([("",), (None,), ("abc",), ("abcd",)], "t string")
    assert [r[0] for r in df.select(strings.wrap(F.col("t"), 3)).collect()] == [[], [], ["abc"], ["abc", "d"]]


def _named(column, name):
    """How often the plan of a column computes from the column `name`."""
    from pyspark.sql import SparkSession

    df = SparkSession.getActiveSession().createDataFrame([("x",)], f"{name} string").select(column)
    return df._jdf.queryExecution().optimizedPlan().toString().count(f"{name}#") - 1


def test_stages_search_a_text_few_times(spark):
    """What a stage makes of a text was computed anew wherever a later part of the stage named it: 13 and more times."""
    for stage in (n.readings, n.digits_by_letters, n.join_in_brackets, n.full_kana, n.roman_numerals):
        assert _named(stage(F.col("sought")), "sought") <= 5
    text = "．・" * 40_000  # a run without a letter behind it was searched from each of its characters
    got, took = _seconds(spark, "・" * 80_000 + "Ａ一" + text, n.digits_by_letters)
    assert got == "・" * 80_000 + "Ａ１" + text and took < 5


def test_roman_numerals_as_word_by_word(spark):
    import random
    import re

    draw = random.Random(4)
    texts = ["".join(draw.choice("IVXivx  -_章5Ⅱ") for _ in range(draw.randrange(30))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.x for r in df.select("i", n.roman_numerals(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [re.sub(r"\w+", lambda m: n.ROMAN.get(m[0], m[0]), t) for t in texts]


def test_classes_within_bounds(spark):
    """Characters are compared with bounds before they are compared with a class; both must agree on all characters."""
    import re

    chars = "".join(chr(c) for c in range(0x20, 0x10000) if not 0xD800 <= c < 0xE000)
    for bounded, plain in ((n.KANJI_RUN, n.KANJI_NUMBER), (n.KANJI_DIGIT, f"[{n.KANJI_DIGITS}]")):
        got = spark.createDataFrame([(chars,)], "t string").select(F.regexp_extract_all("t", F.lit(bounded), F.lit(0))).first()[0]
        assert "&&" in bounded and got == re.findall(plain, chars)


def test_long_line_of_open_brackets(spark):
    text = "山" + "≪" * 30_000 + "\n谷≪たに≫"
    got, took = _seconds(spark, text, n.readings)
    assert got == "山" + "≪" * 30_000 + "\n※［＃縦線］谷《たに》" and took < 20
