"""Annotated text to XHTML, line by line inside a row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.functions.strings import html_escape, strip

# Fixed values ------------------------------------------------------------------------------------------------------
#: Lines that open and close blocks.
BLOCKS = {
    "［＃ここから前書き］": '<div class="preface">',
    "［＃ここで前書き終わり］": "</div>",
    "［＃ここから後書き］": '<div class="postscript">',
    "［＃ここで後書き終わり］": "</div>",
}
PAGE_BREAK, SEPARATOR, HALF = "［＃改ページ］", "［＃区切り線］", "［＃二分アキ］"
#: Paired notes and their elements.
SPANS = (("ゴシック体", "<b>", "</b>"), ("縦中横", '<span class="tcy">', "</span>"), ("濁点", '<span class="dakuten">', "</span>"))
SESAME = ('<em class="sesame">', "</em>")
KANJI = r"\u4E00-\u9FFF\u3400-\u4DBF\uF900-\uFAFF\u4EDD\u3005\u3006\u3007\u30F6"
PICTURE = r"(?U)^[\s　]*［＃挿絵（(.+?)）入る］\s*$"
# -------------------------------------------------------------------------------------------------------------------


def lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)


def inline(text: Column) -> Column:
    """Notes of a line as elements, everything else escaped; notes without a rule are kept hidden."""
    mark = 0xE020
    elements: list[tuple[str, str]] = []
    for name, opened, closed in SPANS:
        a, b = chr(mark), chr(mark + 1)
        text = F.regexp_replace(text, f"(?d)［＃{name}］(.+?)［＃{name}終わり］", f"{a}$1{b}")
        elements += [(a, opened), (b, closed)]
        mark += 2
    a, b = chr(mark), chr(mark + 1)
    text = F.when(text.contains("に傍点］"), F.regexp_replace(F.regexp_replace(text, r"(?d)(.+?)［＃「\1」に傍点］", f"{a}$1{b}"), "(?d)［＃「(.+?)」に傍点］", f"{a}$1{b}")).otherwise(text)
    elements += [(a, SESAME[0]), (b, SESAME[1])]
    bar = chr(mark + 2)
    text = html_escape(F.replace(text, F.lit("※［＃縦線］"), F.lit(bar)))
    for c, element in [*elements, (bar, "｜")]:
        text = F.replace(text, F.lit(c), F.lit(element))
    text = F.regexp_replace(text, "(?d)｜(.+?)《(.+?)》", "<ruby>$1<rt>$2</rt></ruby>")
    text = F.regexp_replace(text, f"(?d)([{KANJI}]+)《(.+?)》", "<ruby>$1<rt>$2</rt></ruby>")
    return F.regexp_replace(text, "(?d)［＃(.+?)］", '<span class="note" hidden="">[$1]</span>')


def line(text: Column) -> Column:
    """One line as XHTML, by the first rule that fits; a page break with text gives two lines."""
    bare = strip(text)
    src = F.regexp_extract(text, PICTURE, 1)
    paragraph = lambda t, kind="": F.concat(F.lit(f"<p{kind}>"), inline(t), F.lit("</p>"))
    out = F.when(bare.isin(*BLOCKS), F.element_at(F.create_map(*[F.lit(x) for kv in BLOCKS.items() for x in kv]), bare))
    picture = F.concat(F.lit('<div class="illustration"><img src="'), F.when(src.startswith("http"), "").otherwise("../Images/"), html_escape(src), F.lit('" alt="挿絵"/></div>'))
    rest = F.replace(text, F.lit(PAGE_BREAK), F.lit(""))
    out = out.when(src != "", picture)
    out = out.when(text.contains(PAGE_BREAK), F.concat(F.when(strip(rest) == "", "").otherwise(F.concat(paragraph(rest), F.lit("\n"))), F.lit('<hr class="pagebreak"/>')))
    out = out.when(bare == SEPARATOR, F.lit('<hr class="separator"/>')).when(bare == "", F.lit("<p><br/></p>"))
    half = F.regexp_extract(text, f"(?d)^{HALF}(.+)", 1)
    return out.when(half != "", paragraph(half, ' class="hang-indent"')).otherwise(paragraph(text))


def xhtml(text: Column) -> Column:
    return F.array_join(F.transform(lines(text), line), "\n")


def pictures(text: Column) -> Column:
    """Files that illustration lines name, in order; URLs aren't files."""
    found = F.transform(lines(text), lambda t: F.when(F.trim(t).isin(*BLOCKS), "").otherwise(F.regexp_extract(t, PICTURE, 1)))
    return F.transform(F.filter(found, lambda s: (s != "") & ~s.startswith("http")), lambda s: F.struct(s.alias("filename"), F.lit("挿絵").alias("alt"), F.lit(0).alias("width"), F.lit(0).alias("height")))
