"""Escapes, names, notes and other small string functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ------------------------------------------------------------------------------------------------------
#: Characters of file names, what they become, and those that go.
FILENAME_FROM, FILENAME_TO, FILENAME_GONE = '/:*?"<>|.\\', "／：＊？”〈〉｜．￥", "\t\n\0"
#: Entities in the order in which they are replaced; `&amp;` comes second, so `&amp;lt;` ends as `<`.
ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "(c)"), ("&#39;", "'"))
#: Entities of extracted bodies, in order.
BODY_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&nbsp;", " "))
XML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))
HTML = (*XML[:4], ("'", "&#x27;"))
#: Media types by extension, and extensions by media type.
MEDIA_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp"}
EXTENSIONS = {"image/jpeg": "jpg", "image/png": "png", "image/gif": "gif", "image/bmp": "bmp", "image/webp": "webp"}
ILLUSTRATION = "［＃挿絵（(.+?)）入る］"
# -------------------------------------------------------------------------------------------------------------------


def replace_all(text: Column, pairs) -> Column:
    """Literal replacements, one after another."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The value of a small table; null if the key isn't in it."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def safe_filename(name: Column) -> Column:
    return F.translate(name, FILENAME_FROM + FILENAME_GONE, FILENAME_TO)


def restore_entities(text: Column) -> Column:
    return replace_all(text, ENTITIES)


def pretreat(source: Column) -> Column:
    """Page sources before any extraction: entities restored, carriage returns gone."""
    return F.replace(restore_entities(source), F.lit("\r"), F.lit(""))


def ampersands(text: Column) -> Column:
    """Bare ampersands as entities."""
    return F.regexp_replace(text, r"(?i)&(?!amp;)", "&amp;")


def xml_escape(text: Column) -> Column:
    return replace_all(text, XML)


def html_escape(text: Column) -> Column:
    return replace_all(text, HTML)


def wrap(text: Column, width: int) -> Column:
    """Pieces of `width` characters; none of an empty text. One pass: to cut each piece out of the text by its number would walk
    to it from the text's start."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}"), F.lit(0)), F.array().cast("array<string>"))


def cover_start(lines: Column) -> Column:
    """Where a cover's title of so many lines starts."""
    return F.greatest(F.lit(200), 400 - lines * 50)


def media_type(filename: Column) -> Column:
    return F.coalesce(lookup(F.lower(F.substring_index(filename, ".", -1)), MEDIA_TYPES), F.lit("image/png"))


def extension(mime: Column) -> Column:
    """Of an image's media type, parameters aside; null if it is none."""
    return lookup(F.lower(F.trim(F.substring_index(mime, ";", 1))), EXTENSIONS)


def split_illustrations(text: Column) -> Column:
    """A struct of the text without illustration notes and the notes."""
    notes = F.regexp_extract_all(text, F.lit(ILLUSTRATION), F.lit(0))
    return F.struct(F.regexp_replace(text, ILLUSTRATION, "").alias("text"), notes.alias("notes"))


def code_illustrations(text: Column, template: str) -> Column:
    """`<iN|M>` tags, with blanks before and a line end after them, as notes of the template's URL: {0} is M, {1} iN."""
    url = template.replace("$", r"\$").replace("{0}", "$2").replace("{1}", "$1")
    return F.regexp_replace(text, r"[ 　\t]*<(i[0-9]+)\|([0-9]+)>\n?", f"［＃挿絵（{url}）入る］")


def fold_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def like(text: Column, query: str) -> Column:
    """LIKE '%query%' that folds A-Z only; % and _ in the query are wildcards and nothing escapes them."""
    folded = query.translate({c: c + 32 for c in range(65, 91)}).replace("\x1b", "")
    return F.like(fold_ascii(text), F.lit(f"%{folded}%"), F.lit("\x1b"))


def parse_date(text: Column, fix: bool = False) -> Column:
    """A naive time of `2024/1/31`, with hours and minutes, or with seconds; else null.

    Dates in 年月日 end in a slash after the mapping and so don't parse; fix drops that slash.
    """
    plain = F.regexp_replace(text, "(?d)[（(].+?[）)]", "")
    plain = F.trim(F.translate(plain, "年月日時分秒", "///:::"))
    if fix:
        plain = F.regexp_replace(F.regexp_replace(plain, r"[/:]+\s*$", ""), r"/\s+|/(?=\d+:)", " ")
    parts = (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}$", r"^\d{4}/\d{1,2}/\d{1,2}$")
    formats = ("yyyy/M/d H:m:s", "yyyy/M/d H:m", "yyyy/M/d")
    found = [F.when(plain.rlike(p), F.try_to_timestamp(plain, F.lit(f)).cast("timestamp_ntz")) for p, f in zip(parts, formats)]
    return F.coalesce(*found)
