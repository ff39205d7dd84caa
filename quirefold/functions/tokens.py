"""Rewriting and stashing the matches of a pattern.

A stash needs no numbers: all matches are extracted, each becomes the same token, and to restore them the text is split
at the token and joined again with the matches in between, in order. That holds as long as no step in between drops,
doubles or reorders tokens. Characters that tokens are made of are taken out of a text first (clean).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Private-use characters that tokens and markers may hold.
RESERVED = "\ue010-\ue030"
KEY = "\ue010"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once for a row, however often use names it and behind whatever condition. Spark
    would compute an expression anew wherever it is named."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def clean(text: Column) -> Column:
    return F.regexp_replace(text, f"[{RESERVED}]", "")


def interleave(parts: Column, hits: Column) -> Column:
    """parts[0] hits[0] parts[1] hits[1] ...; a hit that is missing is empty."""
    return F.array_join(F.zip_with(parts, hits, lambda p, h: F.concat(F.coalesce(p, F.lit("")), F.coalesce(h, F.lit("")))), "")


def rewrite(text: Column, pattern: str, change: Callable[[Column], Column], found: Column | None = None) -> Column:
    """Each match of the pattern, which has no empty match, replaced by change(match). `found` can be false only for texts without
    a match: a cheaper test than a search for the pattern."""
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), change)
    return F.when(text.rlike(pattern) if found is None else found, interleave(F.split(text, pattern, -1), hits)).otherwise(text)


def token(kind: str) -> str:
    return f"［＃{kind}＝{KEY}］"


def stash(text: Column, pattern: str) -> Column:
    """The matches."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def hide(text: Column, pattern: str, kind: str) -> Column:
    return F.regexp_replace(text, pattern, token(kind))


def restore(text: Column, kind: str, stashed: Column) -> Column:
    return interleave(F.split(text, f"［＃{kind}＝{KEY}］", -1), stashed)
