"""Settings of text normalisation, and the small files they come in: for one run on the driver, or by work as a table."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.functions.normalize import java_date_form
from quirefold.functions.patterns import java_rule
from quirefold.sources import yaml_text


@dataclass
class Settings:
    enable_convert_num_to_kanji: bool = True
    enable_kanji_num_with_units: bool = True
    kanji_num_with_units_lower_digit_zero: int = 3
    enable_alphabet_force_zenkaku: bool = False
    enable_half_indent_bracket: bool = True
    enable_auto_indent: bool = True
    enable_auto_join_in_brackets: bool = True
    enable_inspect_invalid_openclose_brackets: bool = False
    enable_auto_join_line: bool = True
    enable_enchant_midashi: bool = True
    enable_author_comments: bool = True
    enable_erase_introduction: bool = False
    enable_erase_postscript: bool = False
    enable_ruby: bool = True
    enable_illust: bool = True
    enable_transform_fraction: bool = False
    enable_transform_date: bool = False
    date_format: str = "%Y年%m月%d日"
    enable_convert_horizontal_ellipsis: bool = True
    enable_convert_page_break: bool = False
    to_page_break_threshold: int = 10
    enable_dakuten_font: bool = True
    enable_display_end_of_book: bool = True
    enable_add_date_to_title: bool = False
    title_date_format: str = "(%-m/%-d)"
    title_date_align: str = "right"
    enable_ruby_youon_to_big: bool = False
    enable_pack_blank_line: bool = True
    #: (pattern, replacement) in order; a replacement refers to groups as \1.
    replace_pattern: list[tuple[str, str]] = field(default_factory=list)


NAMES = [f.name for f in fields(Settings) if f.name != "replace_pattern"]


def parse_ini(text: str) -> dict[str, Any]:
    """name=value lines: true and false, whole numbers, else strings; sections and `;` lines are skipped."""
    found: dict[str, Any] = {}
    for line in text.lstrip("\ufeff").splitlines():
        line = line.strip()
        if not line or line[0] in ";[" or "=" not in line:
            continue
        name, _, value = (x.strip() for x in line.partition("="))
        low = value.lower()
        found[name] = low == "true" if low in ("true", "false") else int(value) if re.fullmatch(r"[+-]?\d+", value) else value
    return found


def format_ini(settings: Settings) -> str:
    shown = ((n, getattr(settings, n)) for n in NAMES)
    return "\ufeff" + "".join(f"{n}={str(v).lower() if isinstance(v, bool) else v}\n" for n, v in shown)


def parse_replacements(text: str, keep_deletions: bool = False) -> list[tuple[str, str]]:
    """pattern TAB replacement lines. Ends of lines are trimmed first, so rules with an empty replacement are lost
    unless keep_deletions."""
    found = []
    for line in text.lstrip("\ufeff").splitlines():
        line = line.rstrip("\r\n") if keep_deletions else line.rstrip()
        if not line or line.startswith(";") or "\t" not in line:
            continue
        pattern, _, replacement = line.partition("\t")
        found.append((pattern, replacement))
    return found


def load(ini: str = "", replacements: str = "", keep_deletions: bool = False) -> Settings:
    """Defaults, overlaid by what the INI text names, and the replacement rules."""
    known = {n: v for n, v in parse_ini(ini).items() if n in NAMES}
    return Settings(**known, replace_pattern=parse_replacements(replacements, keep_deletions))


_TYPES = {bool: T.BooleanType(), int: T.IntegerType(), str: T.StringType()}
RULES = T.ArrayType(T.StructType([T.StructField("pattern", T.StringType()), T.StructField("replacement", T.StringType())]))


def _typed(value: Any, default: Any) -> Any:
    """A value as its setting has it: truth of anything for flags; a text where a number should be is none."""
    if isinstance(default, bool):
        return bool(value)
    if isinstance(default, int):
        return None if isinstance(value, str) or abs(value) >= 2**31 else int(value)
    return str(value)


def by_work(files: DataFrame, work_col: str = "work_id", keep_deletions: bool = False) -> DataFrame:
    """A row of settings for each row of files: a work's key, ini and replacements, the texts of its two files (null: no file).

    Columns are the names of Settings, java_date_format, and rules, ready to be folded over a text. What an INI text doesn't
    name is null and means the default. Rows aren't gathered: each work's small files are read where they lie.
    """
    plain = Settings()
    kinds = {n: _TYPES[type(getattr(plain, n))] for n in NAMES}
    schema = T.StructType([files.schema[work_col], *(T.StructField(n, k) for n, k in kinds.items()), T.StructField("java_date_format", T.StringType()), T.StructField("rules", RULES)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for work, ini, replacements in zip(frame[work_col], frame["ini"], frame["replacements"], strict=True):
                found = parse_ini(ini or "")
                values = [_typed(found[n], getattr(plain, n)) if n in found else None for n in NAMES]
                form = found.get("date_format")
                rules = [java_rule(*r) for r in parse_replacements(replacements or "", keep_deletions)]
                rows.append([work, *values, None if form is None else java_date_form(str(form)), rules])
            made = pd.DataFrame(rows, columns=schema.names)
            yield made.astype({n: "boolean" if isinstance(k, T.BooleanType) else "Int32" for n, k in kinds.items() if not isinstance(k, T.StringType)})

    return files.select(work_col, F.col("ini").cast("string").alias("ini"), F.col("replacements").cast("string").alias("replacements")).mapInPandas(run, schema)


def read_by_work(spark: SparkSession, folder: str) -> DataFrame:
    """(work, ini, replacements) of the folders below a folder, work being the folder's name: setting.ini and replace.txt, as far
    as they are there. Both are read by Spark, so any store that it reads will do."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "{setting.ini,replace.txt}").option("recursiveFileLookup", "true").load(folder)
    parts = F.split("path", "/")
    named = files.select(F.element_at(parts, -2).alias("work"), F.element_at(parts, -1).alias("name"), F.decode("content", "UTF-8").alias("text"))
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("text")))
    return named.groupBy("work").agg(of("setting.ini").alias("ini"), of("replace.txt").alias("replacements"))


class KeyValues:
    """A small store of named values in scopes; `local` values hide `global` ones. A scope is kept as one YAML file, a folder
    for each scope being given; without folders everything is in memory alone."""

    def __init__(self, scopes: dict[str, dict[str, Any]] | None = None, name: str = "settings", folders: dict[str, str | Path] | None = None):
        self.name, self.folders = name, {k: Path(v) for k, v in (folders or {}).items()}
        self.scopes = scopes or {k: {} for k in (self.folders or ("local", "global"))}
        for scope in self.folders:
            self.scopes[scope] = self._read(scope) | self.scopes.get(scope, {})

    def _path(self, scope: str) -> Path:
        return self.folders[scope] / f"{self.name}.yaml"

    def _read(self, scope: str) -> dict[str, Any]:
        """What a scope's file holds; no file, or one that isn't a map, holds nothing."""
        try:
            found = yaml_text.load(self._path(scope).read_text(encoding="utf-8"))
        except (OSError, ValueError):
            found = None
        return found if isinstance(found, dict) else {}

    def get(self, name: str, default: Any = None) -> Any:
        return next((s[name] for s in self.scopes.values() if name in s), default)

    def set(self, name: str, value: Any, scope: str = "local") -> None:
        self.scopes[scope][name] = value

    def delete(self, name: str, scope: str = "local") -> None:
        self.scopes[scope].pop(name, None)

    def save(self) -> None:
        """Writes each scope beside its file and puts it in the file's place, so a run that dies leaves the old one whole."""
        for scope in self.folders:
            path = self._path(scope)
            path.parent.mkdir(parents=True, exist_ok=True)
            fresh = path.with_suffix(".yaml.new")
            fresh.write_text(yaml_text.dump(self.scopes[scope]), encoding="utf-8")
            fresh.replace(path)
