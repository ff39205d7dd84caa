"""The stages of text normalisation for vertical typesetting: a function of a column each.

Stages that protect spans (notes of illustrations, URLs, sentences in Latin letters, headings, numbers) hide them behind
tokens; plans.normalize carries what was hidden and restores it at the end.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.functions.patterns import java_rule
from quirefold.functions.strings import lookup, replace_all
from quirefold.functions.tokens import once, rewrite

# Fixed values ------------------------------------------------------------------------------------------------------
DIGITS, WIDE_DIGITS, KANJI_DIGITS = "0123456789", "０１２３４５６７８９", "〇一二三四五六七八九"
PLACES, UNITS = ("", "十", "百", "千"), ("", "万", "億", "兆", "京")
UNIT_SIGNS = "％㎜㎝㎞㎎㎏㏄㎡㎥"
HALF_KANA = "ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝﾞﾟ"
FULL_KANA = "ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン゛゜"
#: Kana that take a mark, and what they become with it.
VOICED_FROM, VOICED_TO = "カキクケコサシスセソタチツテトハヒフヘホウ", "ガギグゲゴザジズゼゾダヂヅデドバビブベボヴ"
HALF_VOICED_FROM, HALF_VOICED_TO = "ハヒフヘホ", "パピプペポ"
SYMBOLS_FROM = "-=+/*'\"\\%$#&!?<>＜＞()|‐,._;:[]"
SYMBOLS_TO = "－＝＋／＊‘”￥％＄＃＆！？〈〉〈〉（）｜－，．＿；：［］"
ROMAN = dict(zip("II III IV VI VII VIII IX ii iii iv vi vii viii ix".split(), "ⅡⅢⅣⅥⅦⅧⅨⅱⅲⅳⅵⅶⅷⅸ"))
#: What no space is put before after ! and ?.
CLOSING = r"」］\]』】〉》〕＞>≫)）\"'〟　☆★♪［―"
RUBY_BASE = "一-龠Ａ-Ｚａ-ｚA-Za-z"
READING = "ぁ-んァ-ヶーゝゞ・Ａ-Ｚａ-ｚA-Za-z 　"
ILLUSTRATION = "(?d)［＃挿絵（.+?）入る］"
#: Word characters of URLs and sentences: letters and numbers of any script.
WORD = r"\p{L}\p{N}_"
URL = rf"https?://[{WORD}/:%#$&?()~.=+\-]+"
NUMBER = r"\p{Nd}[\p{Nd},]+\p{Nd}"
KANJI_NUMBER = f"[{KANJI_DIGITS}十百千万億兆京]+"
SENTENCE_LENGTH = 8
LINE_TO_JOIN = "([^、])、\n　([^「『(（【<＜〈《≪…‥―])"
COMMENT = "(?msd)^={10,}\n.*?\n={10,}$"
BOLD = "(?iud)<b>(.+?)</b>"
SEPARATOR = "(?md)^-{5,}$"
DASH_LINE = "(?md)^[ 　\t]*(――)"
LINE_TO_INDENT = r"(?md)^([^　 \t「『(（【〈《≪〝―…‥※［＃])"
BRACKET_LINE = "(?md)^[ 　\t]*([〔「『(（【〈《≪〝])"
MARKED_KANA = ("ぁ-ん", "ァ-ン")
DAY = r"20\p{Nd}{2}／\p{Nd}{1,2}／\p{Nd}{1,2}"
# -------------------------------------------------------------------------------------------------------------------


def within(bounds: str, chars: str) -> str:
    """A class of characters that all lie within bounds. The bounds settle most characters of a text, where a plain class would
    compare them with each of its own."""
    return f"[{bounds}&&[{chars}]]"


#: KANJI_DIGITS and KANJI_NUMBER, as columns look for them.
KANJI_DIGIT = within("〇一-四", KANJI_DIGITS)
KANJI_RUN = within("〇一-四百", KANJI_DIGITS + "十百千万億兆京") + "+"
_SENTENCE = WORD + r".,!?'\" &:;\-"
#: Runs that hold a space, or have SENTENCE_LENGTH characters with a lower-case one among them.
SENTENCE = rf"(?<![{_SENTENCE}])(?:(?=[{_SENTENCE}]* )|(?=[{_SENTENCE}]{{{SENTENCE_LENGTH}}})(?=[{_SENTENCE}]*(?U:\p{{Lower}})))[{_SENTENCE}]++"
_TOP, _BOTTOM, _NUM = r"[－―<＜〈\-]", r"[－―>＞〉\-]", f"[0-9０-９{KANJI_DIGITS}]{{1,3}}"
HEADING = rf"(?md)^[ 　\t]*(?:{_TOP}+{_NUM}{_BOTTOM}*|{_TOP}*{_NUM}{_BOTTOM}+)$"


def user_rules(text: Column, rules: list[tuple[str, str]] | Column) -> Column:
    """Replacement rules in order; a rule that isn't one is taken literally (see patterns). A column holds an array of structs
    (pattern, replacement) that patterns.java_rule has made."""
    if isinstance(rules, Column):
        return F.aggregate(rules, text, lambda done, rule: F.regexp_replace(done, rule.pattern, rule.replacement))
    for pattern, replacement in rules:
        text = F.regexp_replace(text, *map(F.lit, java_rule(pattern, replacement)))
    return text


def full_kana(text: Column) -> Column:
    """Stage 1: half-width kana full-width, marks joined to their kana, em dashes made bars."""
    marked = {k + "゛": v for k, v in zip(VOICED_FROM, VOICED_TO)} | {k + "゜": v for k, v in zip(HALF_VOICED_FROM, HALF_VOICED_TO)}
    pairs = f"[ウ-ホ](?:(?<=[{VOICED_FROM}])゛|(?<=[{HALF_VOICED_FROM}])゜)"
    return once(F.translate(text, HALF_KANA + "—", FULL_KANA + "―"), lambda t: rewrite(t, pairs, lambda hit: lookup(hit, marked)))


def join_in_brackets(text: Column) -> Column:
    """Stage 2: lines inside 「」, then 『』, with at most one level inside, become one."""

    def joined(t: Column, o: str, c: str) -> Column:
        inner = f"[^{o}{c}]*+"
        return rewrite(t, f"{o}{inner}(?:{o}{inner}{c}{inner})*+{c}", lambda hit: F.regexp_replace(hit, "\n[　 \t]*", ""))

    return once(joined(text, "「", "」"), lambda t: joined(t, "『", "』"))


def join_lines(text: Column) -> Column:
    """Stage 3: a line that ends in 、 is joined with the next, indented one unless that opens a bracket."""
    return F.regexp_replace(text, LINE_TO_JOIN, "$1、$2")


def drop_comments(text: Column) -> Column:
    """Stage 4: blocks between lines of ten or more = go."""
    return F.regexp_replace(text, COMMENT, "")


def site_tags(text: Column) -> Column:
    """Stage 7: bold tags and separator lines become notes."""
    bold = F.regexp_replace(text, BOLD, "［＃ゴシック体］$1［＃ゴシック体終わり］")
    return F.regexp_replace(bold, SEPARATOR, "［＃区切り線］")


def roman_numerals(text: Column) -> Column:
    """Stage 8: II to IX, but for V, as single characters where they stand alone. All in one pass, which looks closer only at
    letters that begin one."""
    first = "".join(sorted({letters[0] for letters in ROMAN}))
    alone = rf"(?=[{first}])(?<![{WORD}])(?:{'|'.join(ROMAN)})(?![{WORD}])"
    return rewrite(text, alone, lambda hit: lookup(hit, ROMAN))


def wide_latin(text: Column) -> Column:
    """Stage 9, but for the sentences that it protects."""
    upper = "".join(map(chr, range(65, 91)))
    letters = upper + upper.lower()
    return F.translate(text, letters, "".join(chr(ord(c) + 0xFEE0) for c in letters))


def wide_symbols(text: Column) -> Column:
    """Stage 9b: quotes in pairs become 〝〟, symbols full-width, 《》 other brackets."""
    quoted = F.regexp_replace(text, "'([^'\"\n]+)'", "〝$1〟")
    quoted = F.regexp_replace(quoted, '["〝〟]([^"\n]+)["〝〟]', "〝$1〟")
    return F.translate(quoted, SYMBOLS_FROM + "《》", SYMBOLS_TO + "≪≫")


def heading(hit: Column) -> Column:
    """Stage 10: a heading line as it is restored."""
    return F.concat(F.lit("　　　［＃ゴシック体］"), F.regexp_replace(hit, "^[ 　\t]+", ""), F.lit("［＃ゴシック体終わり］"))


def decimal_points(text: Column) -> Column:
    """Stage 11: points between digits become ・."""
    digit = rf"[\p{{Nd}}{KANJI_DIGIT}]"
    return F.regexp_replace(text, f"({digit}+?)[.．]({digit}+?)", "$1・$2")


def kanji_digits(text: Column) -> Column:
    """Stage 11b, but for the numbers that it protects."""
    return F.translate(text, DIGITS + WIDE_DIGITS, KANJI_DIGITS * 2)


def wide_numbers(text: Column) -> Column:
    """Stage 11c: numbers of two digits upright in one cell, others full-width."""

    def change(number: Column) -> Column:
        upright = F.concat(F.lit("［＃縦中横］"), number, F.lit("［＃縦中横終わり］"))
        return F.when(F.length(number) == 2, upright).otherwise(F.translate(number, DIGITS, WIDE_DIGITS))

    return rewrite(text, r"\p{Nd}+", change)


def digits_by_letters(text: Column) -> Column:
    """Stage 12: kanji digits next to full-width letters or unit signs become full-width digits."""
    run = within("〇・～一-四", f"{KANJI_DIGITS}・～")
    wide = lambda hit: F.translate(hit, KANJI_DIGITS, WIDE_DIGITS)
    before = f"(?<!{run}){run}++[Ａ-Ｚａ-ｚ{UNIT_SIGNS}]"
    return once(rewrite(text, f"[Ａ-Ｚａ-ｚ]{run}+", wide), lambda t: rewrite(t, before, wide))


def kanji_units(text: Column, least_zeros: int | Column) -> Column:
    """Stage 13: numbers with so many 〇 or more get 万, 億, 兆, 京; the lowest four digits stay positional. Numbers of
    more than twenty digits stay as they are."""
    kanji = lambda d: F.translate(d, DIGITS, KANJI_DIGITS)

    def shown(padded: Column) -> Column:
        groups = []
        for unit in range(4, 0, -1):
            four = F.substring(padded, 17 - 4 * unit, 4)
            places = []
            for place in range(3, -1, -1):
                d = F.substring(four, 4 - place, 1)
                name = kanji(d) if place == 0 else F.when(d == "1", "").otherwise(kanji(d))
                places.append(F.when(d == "0", "").otherwise(F.concat(name, F.lit(PLACES[place]))))
            groups.append(F.when(four == "0000", "").otherwise(F.concat(*places, F.lit(UNITS[unit]))))
        return F.concat(*groups, kanji(F.regexp_replace(F.substring(padded, 17, 4), "^0+", "")))

    def change(run: Column) -> Column:
        number = F.regexp_replace(F.translate(run, KANJI_DIGITS, DIGITS), "^0+", "")
        zeros = F.length(run) - F.length(F.replace(run, F.lit("〇"), F.lit("")))
        return F.when((zeros < least_zeros) | (number == "") | (F.length(number) > 20), run).otherwise(once(F.lpad(number, 20, "0"), shown))

    return rewrite(text, f"{KANJI_DIGIT}+", change)


def space_after_marks(text: Column) -> Column:
    """Stage 15: U+3000 after runs of ! and ? unless they end the text or something closes."""
    spaced = F.regexp_replace(text, f"([!?！？]+)(?=[^!?！？ {CLOSING}])", "$1　")
    return F.regexp_replace(spaced, "([!?！？]+) ", "$1　")


def ellipses(text: Column, middle_dots: bool | Column = True) -> Column:
    """Stage 16: three or more ・ become … for each three begun; 。。。, ．．． and ── too."""
    if isinstance(middle_dots, Column) or middle_dots:
        dots = F.regexp_replace(text, "・{3}", "\ue030")
        dots = F.replace(F.regexp_replace(dots, "\ue030・{1,2}", "\ue030\ue030"), F.lit("\ue030"), F.lit("…"))
        text = F.when(middle_dots, dots).otherwise(text) if isinstance(middle_dots, Column) else dots
    return replace_all(text, (("。。。", "…"), ("．．．", "…"), ("──", "――")))


def fractions(text: Column) -> Column:
    """Stage 17: a／b as bのa."""
    digit = f"[{KANJI_DIGITS}０-９]"
    return F.regexp_replace(text, f"({digit}+)／({digit}+)", "$2分の$1")


def java_date_form(form: str) -> str:
    """A strftime form as Java's."""
    names = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%-m": "M", "%d": "dd", "%-d": "d", "%j": "DDD", "%H": "HH", "%M": "mm", "%S": "ss", "%%": "'%'"}
    parts = re.split(r"(%-?.)", form)
    return "".join(names.get(p, "") if i % 2 else ("'" + p.replace("'", "''") + "'" if p else "") for i, p in enumerate(parts))


def dates(text: Column, form: str | Column = "%Y年%m月%d日") -> Column:
    """Stage 17: 20yy／m／d in a strftime form (a column holds Java's); days that don't exist stay."""
    java = form if isinstance(form, Column) else F.lit(java_date_form(form))

    def change(hit: Column) -> Column:
        plain = F.translate(hit, WIDE_DIGITS + "／", DIGITS + "/")
        day = F.try_to_timestamp(plain, F.lit("yyyy/M/d")).cast("timestamp_ntz")
        return F.coalesce(F.call_function("date_format", day, java), hit)

    return rewrite(text, DAY, change)


def mark_font(text: Column) -> Column:
    """Stage 19: kana with a mark that has no character of its own."""
    for kana in MARKED_KANA:
        text = F.regexp_replace(text, f"([{kana}])゛", "［＃濁点］$1［＃濁点終わり］")
    return text


def readings(text: Column) -> Column:
    """Stage 20: base≪reading≫ and base（kana） become ruby; ｜ before the bracket keeps it from that. Bars become notes.

    A line is read from left to right, in spans of what lies before a reading (at least one character) and the reading. A
    kept ≪reading≫ has （） afterwards if its span has a （, so what stands before it on the line, but not before the last reading,
    counts. Spans only start behind another one or a line end, so a line without readings is read once.
    """
    bar = "\ue029"

    def ruby(t: Column, opened: str, reading: str, closed: str) -> Column:
        span = rf"(?md)(?:^|\G)(.[^{opened}\n]*+.*?){opened}({reading}){closed}"

        def change(hit: Column) -> Column:
            base, read = F.regexp_extract(hit, span, 1), F.regexp_extract(hit, span, 2)
            kept = F.when(hit.contains("（"), F.concat(F.lit("（"), read, F.lit("）"))).otherwise(F.concat(F.lit("≪"), read, F.lit("≫")))
            last = rf"(?<![{RUBY_BASE}])([{RUBY_BASE}]++)\z"
            marked = F.concat(F.regexp_replace(base, last, f"{bar}$1"), F.lit("《"), read, F.lit("》"))
            return F.when(base.endswith("｜"), F.concat(F.substring(base, F.lit(1), F.length(base) - 1), kept)).when(base.rlike(last), marked).otherwise(hit)

        return rewrite(t, span, change, t.contains(opened))

    t = once(ruby(text, "≪", "[^≪]+?", "≫"), lambda t: ruby(t, "（", f"[{READING}]{{1,20}}", "）"))
    return F.regexp_replace(t, f"[{bar}｜]", "※［＃縦線］")


def indent(text: Column) -> Column:
    """Stage 21: lines get U+3000 in front unless they start with a blank, a bracket, a dash or a note; empty ones, too."""
    dashes = F.regexp_replace(text, DASH_LINE, "　$1")
    return F.regexp_replace(dashes, LINE_TO_INDENT, "　$1")


def half_indent(text: Column) -> Column:
    """Stage 22: lines that open a bracket get the note of half a cell instead of blanks."""
    return F.regexp_replace(text, BRACKET_LINE, "［＃二分アキ］$1")


def pack_blank_lines(text: Column) -> Column:
    """Stage 23: at most two empty lines together."""
    return F.regexp_replace(text, "\n{4,}", "\n\n\n")


def page_breaks(text: Column, threshold: int | Column = 10) -> Column:
    """Stage 24: so many line ends together become the note of a new page. A threshold below 0 fits nowhere."""
    if isinstance(threshold, Column):
        least = F.greatest(threshold, F.lit(0)).cast("string")
        return F.when(threshold < 0, text).otherwise(F.regexp_replace(text, F.concat(F.lit("\n{"), least, F.lit(",}")), F.lit("\n［＃改ページ］\n")))
    return text if threshold < 0 else F.regexp_replace(text, f"\n{{{threshold},}}", "\n［＃改ページ］\n")
