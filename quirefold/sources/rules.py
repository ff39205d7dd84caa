"""Extraction rules of sites: named patterns that refer to each other, resolved on the driver; columns do the matching."""

from __future__ import annotations

import re
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.functions.patterns import java_pattern

REFERENCE = re.compile(r"\\\\k<(\w+)>")
#: A name's mark: what stands in a pattern until the column of its values does.
MARK = "(?:\ue000{}\ue001)"
MARKED = re.compile(r"\\x\{e000\}(\d+)\\x\{e001\}")

# The rules of two sites, alike but for what _SITES says -------------------------------------------------
_EPISODE = (
    r'(?:<div class="p-eplist__chapter-title">(?<chapter>.+?)</div>\s*)?<div class="p-eplist__sublist">\s*'
    r'<a href="(?<href>/[^"]+?/(?<index>\d+?)/)" class="p-eplist__subtitle">\s*(?<subtitle>.+?)\s*</a>\s*'
    r'<div class="p-eplist__update">\s*(?<subdate>[0-9/: ]+?)(?:\s*<span title="(?<subupdate>.+?) 改稿">（<u>改</u>）</span>)?\s*</div>\s*</div>'
)
_COMMON = {
    "scheme": "https",
    "top_url": r"\\k<scheme>://\\k<domain>",
    "url": r"https?://\\k<domain>/(?<ncode>n\d+[a-zA-Z]+)",
    "encoding": "UTF-8",
    "append_title_to_folder_name": True,
    "title_strip_pattern": None,
    "toc_url": r"\\k<top_url>/\\k<ncode>/",
    "subtitles": _EPISODE,
    "toc_next_url": r'<a href="(?<toc_next_url>/\\k<ncode>/\?p=\d+)" class="c-pager__item c-pager__item--next">',
    "text_by_class": True,
    "novel_info_url": r"\\k<top_url>/novelview/infotop/ncode/\\k<ncode>/",
    "t": r'<h1 class="p-infotop-title">\s*<a href=".+?">(?<title>.+?)</a>\s*</h1>',
    "nt": r'<td class="p-infotop-data__value">(?<novel_type>連載中|完結済|短編)</td>',
    "novel_type_string": {"連載中": 1, "完結済": 3, "短編": 2},
    "ga": r"全(?<general_all_no>\d+)部",
    "s": r'<dt class="p-infotop-data__title">あらすじ</dt>\s*<dd class="p-infotop-data__value">(?<story>.+?)</dd>',
    "gf": r'<dt class="p-infotop-data__title">掲載日</dt>\s*<dd class="p-infotop-data__value">(?<general_firstup>.+?)</dd>',
    "nu": r'<dt class="p-infotop-data__title">最終掲載日</dt>\s*<dd class="p-infotop-data__value">(?<novelupdated_at>.+?)</dd>',
    "gl": r'<dt class="p-infotop-data__title">最終掲載日</dt>\s*<dd class="p-infotop-data__value">(?<general_lastup>.+?)</dd>',
    "w": r'<dt class="p-infotop-data__title">作者名</dt>\s*<dd class="p-infotop-data__value">(?:<a href=".+?">)?(?<writer>.+?)(?:</a>)?\s*</dd>',
}
_SITES = (
    {"name": "小説家になろう", "domain": "ncode.syosetu.com", "confirm_over18": False, "api_url": "https://api.syosetu.com/novelapi/api/"},
    {"name": "ノクターン・ムーンライト", "domain": "novel18.syosetu.com", "confirm_over18": True, "cookie": "over18=yes", "api_url": "https://api.syosetu.com/novel18api/api/"},
)
# -----------------------------------------------------------------------------------------------------------------------


class SiteRules:
    """Values of a site. Known values (what columns matched, or options) come before those of the rules."""

    def __init__(self, values: dict[str, Any]):
        self.values = dict(values)

    def raw(self, name: str) -> Any:
        return self.values.get(name)

    def resolve(self, name: str, known: dict[str, str] | None = None) -> Any:
        """The value with its references replaced; unknown ones stay, and so do those that lead back to themselves. An empty
        known value stands for the value asked for no more than a missing one, but in a reference it counts."""
        return self._value(name, known or {}, ())

    def _value(self, name: str, known: dict[str, str], above: tuple[str, ...]) -> Any:
        value = known.get(name) or self.values.get(name)
        if not isinstance(value, str):
            return value

        def put(m: re.Match) -> str:
            if m[1] in above or m[1] == name:
                return m[0]
            inner = known[m[1]] if known.get(m[1]) == "" else self._value(m[1], known, (*above, name))
            return m[0] if inner is None or isinstance(inner, (dict, list)) else str(inner)

        return REFERENCE.sub(put, value)

    def pattern(self, name: str, known: dict[str, str | Column] | None = None) -> Rule:
        """A rule as a pattern whose dot matches line ends. Known values that are columns stand for themselves in it, row by
        row, letter by letter; where one is null, the rule's own value of that name counts, and without one nothing matches."""
        return Rule.of(self, self.values.get(name), known)

    def text(self, name: str, known: dict[str, Column]) -> Column:
        """The value as a column: references to known columns take their values row by row."""
        marked = {k: f"\ue000{k}\ue001" for k in known}
        value = self.resolve(name, marked) or ""
        parts = re.split("\ue000(\\w+)\ue001", value)
        return F.concat(*[known[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


class Rule(str):
    """A pattern for columns, in Java's syntax with the meaning that rules have (see functions.patterns; groups may be named as
    (?<name>...) too), and the numbers of its named groups. A rule that isn't a pattern isn't valid, and matches nothing."""

    groups: dict[str, int]
    valid: bool
    values: list[Column]

    def __new__(cls, pattern: str, values: list[Column] | None = None) -> Rule:
        python = re.sub(r"\(\?<([^!=])", r"(?P<\1", pattern)
        try:
            java, number = java_pattern(python)
            groups, valid = {n: number[i] for n, i in re.compile(python).groupindex.items()}, True
        except (re.error, OverflowError, RecursionError):
            java, groups, valid = "(?!)", {}, False
        rule = super().__new__(cls, java)
        rule.groups, rule.valid, rule.values = groups, valid, values or []
        return rule

    @classmethod
    def of(cls, site: SiteRules, value: str | None, known: dict[str, str | Column] | None = None) -> Rule:
        """A rule's text with its references replaced; those to columns become marks first."""
        columns = {k: v for k, v in (known or {}).items() if isinstance(v, Column)}
        plain = {k: v for k, v in (known or {}).items() if k not in columns}
        marks = {k: MARK.format(i) for i, k in enumerate(columns)}
        resolved = SiteRules({**site.values, "": value}).resolve("", plain | marks) or ""
        own = [site.resolve(k, plain) for k in columns]
        return cls("(?s)" + resolved, [F.coalesce(c, F.lit(v)) if isinstance(v, str) else c for c, v in zip(columns.values(), own, strict=True)])

    def column(self) -> Column:
        """The pattern of each row; null where a value that it needs is null."""
        parts = MARKED.split(self)
        return F.concat(*[quoted(self.values[int(p)]) if i % 2 else F.lit(p) for i, p in enumerate(parts)]) if len(parts) > 1 else F.lit(str(self))

    def found(self, text: Column) -> Column:
        """Whether a text has it."""
        return F.coalesce(F.call_function("regexp", text, self.column()), F.lit(False) & text.isNotNull())

    def group(self, text: Column, name: str) -> Column:
        """What a named group took of a text: '' if it took no part, or the text doesn't have the rule."""
        return F.call_function("regexp_extract", text, self.column(), F.lit(self.groups[name]))

    def all(self, text: Column, name: str) -> Column:
        """What a named group took, of all matches."""
        return F.regexp_extract_all(text, self.column(), F.lit(self.groups[name]))


def quoted(text: Column) -> Column:
    """A pattern that matches the text itself."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def match(text: Column, patterns: list[Rule]) -> Column:
    """A struct of all named groups: those of the first pattern that the text has, '' for a group that took no part, null
    where no pattern matches."""
    valid = [p for p in patterns if p.valid]
    names = dict.fromkeys(n for p in valid for n in p.groups)
    out = []
    for name in names:
        value = F.lit(None).cast("string")
        for p in reversed(valid):
            value = F.when(p.found(text), p.group(text, name) if name in p.groups else F.lit("")).otherwise(value)
        out.append(value.alias(name))
    return F.struct(*out)


def multi_match(text: Column, site: SiteRules, keys: list[str], known: dict[str, str | Column] | None = None) -> Column:
    """A struct of the named groups of several rules, each a pattern or a list of patterns: of every rule its first pattern
    that the text has; a later rule's groups replace those of the same name. Null where no rule with the group matched.

    A later rule can refer to groups of earlier ones: what a row's text gave stands for itself in that row's pattern.
    """
    found: dict[str, Column] = {}
    for key in keys:
        value = site.raw(key)
        rules = [Rule.of(site, v, (known or {}) | found) for v in (value if isinstance(value, list) else [value]) if isinstance(v, str)]
        names = dict.fromkeys(n for r in rules if r.valid for n in r.groups)
        if names:
            groups = match(text, rules)
            found |= {n: F.coalesce(groups[n], found[n]) if n in found else groups[n] for n in names}
    return F.struct(*[c.alias(n) for n, c in found.items()]) if found else F.lit(None).cast("struct<>")


def builtin() -> list[SiteRules]:
    return [SiteRules(_COMMON | site) for site in _SITES]


def load(folder: str | None = None) -> list[SiteRules]:
    """Rules of all .json and, where PyYAML is installed, .yaml files of a folder by file name; files that don't hold a
    map are left out. Without a folder those of the two known sites."""
    if folder is None:
        return builtin()
    readers = {".json": __import__("json").loads}
    try:
        import yaml

        readers[".yaml"] = yaml.safe_load
    except ImportError:
        pass
    files = sorted(p for p in Path(folder).iterdir() if p.suffix in readers)
    found = [readers[p.suffix](p.read_text(encoding="utf-8")) for p in files]
    return [SiteRules(x) for x in found if isinstance(x, dict)]


def chain(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """CASE WHEN: the first case that holds."""
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), otherwise)
