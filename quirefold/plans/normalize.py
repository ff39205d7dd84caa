"""The stages of normalisation in order, by the kind of a text. Stages that settings turn off never enter the plan; settings by
work are columns, and a stage is computed for the rows whose work has it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import normalize as n
from quirefold.functions.tokens import clean, hide, restore, stash
from quirefold.sources.settings import NAMES, Settings
from quirefold.sources.shared import cut

KINDS = ("body", "textfile", "introduction", "postscript", "subtitle", "chapter", "story")
#: What is restored at the end, in order.
RESTORED = ("ＵＲＬ", "挿絵", "英文", "半角数字", "章見出し")
#: Up to so many works' settings are broadcast; of more, each row is there once for every part of its work's texts.
BROADCAST, PARTS = 10_000, 16


class _Steps:
    """A frame whose column _text is changed step by step; hidden spans are columns of their own, so that no step is
    computed twice."""

    def __init__(self, df: DataFrame):
        self.df, self.hidden = df, {}

    def then(self, f, *args) -> None:
        self.df = self.df.withColumn("_text", f(F.col("_text"), *args))

    def when(self, flag: bool | Column, f, *args) -> None:
        """A step that a setting, or a column of it, turns on."""
        if isinstance(flag, Column):
            self.then(lambda t: F.when(flag, f(t, *args)).otherwise(t))
        elif flag:
            self.then(f, *args)

    def hide(self, kind: str, pattern: str, shown=None, flag: bool | Column = True) -> None:
        if not isinstance(flag, Column) and not flag:
            return
        name = f"_hidden{len(self.hidden)}"
        spans = stash(F.col("_text"), pattern)
        if isinstance(flag, Column):
            spans = F.when(flag, spans).otherwise(F.array().cast("array<string>"))
        self.df = self.df.withColumn(name, F.transform(spans, shown) if shown else spans)
        self.df = self.df.withColumn("_text", F.when(F.size(name) > 0, hide(F.col("_text"), pattern, kind)).otherwise(F.col("_text")))
        self.hidden[kind] = name

    def restore(self, kind: str) -> None:
        if name := self.hidden.pop(kind, None):
            text = F.when(F.size(name) > 0, restore(F.col("_text"), kind, F.col(name))).otherwise(F.col("_text"))
            self.df = self.df.withColumn("_text", text).drop(name)


def _not(flag: bool | Column) -> bool | Column:
    return ~flag if isinstance(flag, Column) else not flag


def _numbers(steps: _Steps, kanji: bool | Column) -> None:
    steps.then(n.decimal_points)
    steps.when(_not(kanji), n.wide_numbers)
    steps.hide("漢数字", n.KANJI_RUN, flag=kanji)
    steps.hide("半角数字", n.NUMBER, flag=kanji)
    steps.when(kanji, n.kanji_digits)


def _body(steps: _Steps, s: Settings) -> None:
    steps.then(n.full_kana)
    steps.when(s.enable_auto_join_in_brackets, n.join_in_brackets)
    steps.when(s.enable_auto_join_line, n.join_lines)
    steps.then(n.drop_comments)
    steps.hide("挿絵", n.ILLUSTRATION, flag=s.enable_illust)
    steps.when(_not(s.enable_illust), lambda t: F.regexp_replace(t, n.ILLUSTRATION, ""))
    steps.hide("ＵＲＬ", n.URL)
    steps.then(n.site_tags)
    steps.then(n.roman_numerals)
    steps.hide("英文", n.SENTENCE, flag=_not(s.enable_alphabet_force_zenkaku))
    steps.then(n.wide_latin)
    steps.then(n.wide_symbols)
    steps.hide("章見出し", n.HEADING, n.heading)
    _numbers(steps, s.enable_convert_num_to_kanji)
    steps.then(n.digits_by_letters)
    steps.when(s.enable_kanji_num_with_units, n.kanji_units, s.kanji_num_with_units_lower_digit_zero)
    steps.restore("漢数字")
    steps.then(n.space_after_marks)
    steps.then(n.ellipses, s.enable_convert_horizontal_ellipsis)
    steps.when(s.enable_transform_fraction, n.fractions)
    steps.when(s.enable_transform_date, n.dates, s.date_format)
    steps.when(s.enable_dakuten_font, n.mark_font)
    steps.when(s.enable_ruby, n.readings)
    steps.when(s.enable_auto_indent, n.indent)
    steps.when(s.enable_half_indent_bracket, n.half_indent)
    steps.when(s.enable_pack_blank_line, n.pack_blank_lines)
    steps.when(s.enable_convert_page_break, n.page_breaks, s.to_page_break_threshold)


def normalize(df: DataFrame, text_col: str = "text", kind: str = "body", settings: Settings | None = None, out_col: str = "normalized") -> DataFrame:
    """df with out_col: text_col (null: empty) normalised as a text of its kind. Characters that tokens are made of go."""
    s = settings or Settings()
    erased = s.enable_erase_introduction if kind == "introduction" else s.enable_erase_postscript if kind == "postscript" else False
    if not isinstance(erased, Column) and erased:
        return df.withColumn(out_col, F.lit(""))
    steps = _Steps(df.withColumn("_text", clean(F.coalesce(F.col(text_col), F.lit("")))))
    if isinstance(erased, Column):  # nothing is done for texts that go
        steps.when(erased, lambda t: F.lit(""))
    if isinstance(s.replace_pattern, Column) or s.replace_pattern:
        steps.then(n.user_rules, s.replace_pattern)
    if kind in ("subtitle", "chapter", "story"):
        steps.then(n.full_kana)
        _numbers(steps, kanji=False)
        if kind != "story":
            steps.then(n.wide_symbols)
    else:
        _body(steps, s)
    if kind in ("introduction", "postscript"):
        name = {"introduction": "前書き", "postscript": "後書き"}[kind]
        steps.then(lambda t: F.concat(F.lit(f"［＃ここから{name}］\n"), t, F.lit(f"\n［＃ここで{name}終わり］")))
    for hidden in RESTORED:
        steps.restore(hidden)
    if isinstance(erased, Column):
        steps.when(erased, lambda t: F.lit(""))
    return steps.df.withColumnRenamed("_text", out_col) if out_col not in df.columns else steps.df.withColumn(out_col, F.col("_text")).drop("_text")


def normalize_by_work(df: DataFrame, settings: DataFrame, work_col: str = "work_id", text_col: str = "text", kind: str = "body", out_col: str = "normalized") -> DataFrame:
    """As normalize(), each text by the settings of its work: a row of `settings` as sources.settings.by_work makes them. A work
    without a row, and a value that is null, has the defaults. One plan serves all works, whatever their settings: flags are
    columns and rules an array that is folded over the text. A work has one row of settings at most.

    Texts are never gathered by their work, so few works, or one with most of the texts, are spread like any others."""
    renamed = settings.select(F.col(work_col).alias("_work"), *[F.col(c).alias(f"_s_{c}") for c in (*NAMES, "java_date_format", "rules")])
    rows = _with_settings(df, cut(renamed), work_col, text_col).sortWithinPartitions("_work")  # so that a work's rules are compiled once a task
    plain = Settings()
    columns = {c: F.coalesce(f"_s_{c}", F.lit(getattr(plain, c))) for c in NAMES}
    columns["date_format"] = F.coalesce("_s_java_date_format", F.lit(n.java_date_form(plain.date_format)))
    rules = F.coalesce("_s_rules", F.array().cast(settings.schema["rules"].dataType))
    own = {f"_s_{c}": x for c, x in columns.items()}
    rows = rows.withColumns(own | {"_s_rules": rules})
    found = normalize(rows, text_col, kind, replace(plain, **{c: F.col(f"_s_{c}") for c in NAMES}, replace_pattern=F.col("_s_rules")), out_col)
    return found.drop("_work", "_part", "_text_part", "_s_java_date_format", "_s_rules", *own)


def _with_settings(df: DataFrame, renamed: DataFrame, work_col: str, text_col: str) -> DataFrame:
    if renamed.count() <= BROADCAST:
        return df.join(F.broadcast(renamed), F.col(work_col) == F.col("_work"), "left")
    parts = renamed.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = df.withColumn("_text_part", F.pmod(F.xxhash64(text_col), F.lit(PARTS)).cast("int"))
    return dealt.join(parts, (F.col(work_col) == F.col("_work")) & (F.col("_text_part") == F.col("_part")), "left")
