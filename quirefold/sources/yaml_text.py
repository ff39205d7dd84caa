"""YAML texts as JSON texts, a column at a time, so that Spark's from_json reads them by a schema.

What is read: block and flow maps and sequences, plain and quoted scalars over several lines, literal and folded blocks,
comments; plain scalars as version 1.1 has them (null, yes and no, whole numbers in their bases, numbers). Dates stay texts.
Anchors, tags and complex keys are not read: such a text, like every other that can't be read, gives null.
"""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPECIAL = {**dict.fromkeys(("~", "null", "Null", "NULL", ""), None), **{f(w): w in ("yes", "true", "on") for w in ("yes", "no", "true", "false", "on", "off") for f in (str, str.title, str.upper)}}
_INT = re.compile(r"[-+]?(?:0b[01_]+|0x[0-9a-fA-F_]+|0[0-7_]*|[1-9][0-9_]*(?::[0-5]?[0-9])*)")
_FLOAT = re.compile(r"[-+]?[0-9][0-9_]*\.[0-9_]*(?:[eE][-+][0-9]+)?|\.[0-9][0-9_]*(?:[eE][-+][0-9]+)?")
_ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "\t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}
_DOUBLE = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S)
_SINGLE = re.compile(r"'((?:[^']|'')*)'", re.S)
_IN_DOUBLE = re.compile(r"\\(\n[ \t]*|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)|[ \t]*\n((?:[ \t]*\n)*)[ \t]*", re.S)
_BREAKS = re.compile(r"[ \t]*\n((?:[ \t]*\n)*)[ \t]*")
_KEY = re.compile(r"""("(?:[^"\\\n]|\\.)*"|'(?:[^'\n]|'')*'|[^\s#&*!|>'"%@`{}\[\],?:-][^\n]*?|[?:-][^\s][^\n]*?)[ ]*:(?=[ \n]|$)""")
_BLOCK = re.compile(r"([|>])([-+]?)([1-9]?)([-+]?)[ ]*(?:#[^\n]*)?$")
_FLOW_PLAIN = re.compile(r"[^ \t\n,\[\]{}#&*!|>'\"%@`](?:[^,\[\]{}:#]|:(?![ \t\n,\[\]{}]|\Z)|(?<![ \t\n])#)*")
_GAP = re.compile(r"(?:[ \t\n]|(?<=[ \t\n])#[^\n]*)*")


def plain(text: str) -> Any:
    """What a plain scalar stands for."""
    if text in _SPECIAL:
        return _SPECIAL[text]
    if _INT.fullmatch(text):
        sign, digits = (-1 if text[0] == "-" else 1), text.lstrip("+-").replace("_", "")
        if ":" in digits:
            value = 0
            for part in digits.split(":"):
                value = value * 60 + int(part)
            return sign * value
        base = 2 if digits[:2] == "0b" else 16 if digits[:2] == "0x" else 8 if digits[0] == "0" else 10
        return sign * int(digits, base)
    if _FLOAT.fullmatch(text):
        return float(text.replace("_", ""))
    return text


def _breaks(m: re.Match) -> str:
    return "\n" * m[1].count("\n") or " "


def _in_double(m: re.Match) -> str:
    if m[1] is None:
        return "\n" * m[2].count("\n") or " "
    if m[1][0] == "\n":
        return ""
    if m[1][0] in "xuU" and len(m[1]) > 1:
        return chr(int(m[1][1:], 16))
    return _ESCAPES[m[1]]


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self, why: str):
        raise ValueError(f"{why} at {self.text.count(chr(10), 0, self.at) + 1}")

    def line(self) -> str:
        end = self.text.find("\n", self.at)
        return self.text[self.at : end if end >= 0 else len(self.text)]

    def next(self) -> int:
        """Moves to the next line that has something; its indent, -1 at the end."""
        while self.at < len(self.text):
            line = self.line()
            bare = line.lstrip(" ")
            if bare[:1] == "\t" and bare.strip(" \t"):
                self.fail("a tab as indent")
            if bare.strip(" \t") and bare[0] != "#":
                return len(line) - len(bare)
            self.at += len(line) + 1
        return -1

    def block(self, least: int) -> Any:
        """The node that starts at the current line, if its indent is `least` or more."""
        indent = self.next()
        if indent < least:
            return None
        start = self.at + indent
        if re.match(r"-(?=[ \n]|$)", self.text[start : start + 2]):
            return self.sequence(indent)
        if self.text[start] in "\"'" or not _KEY.match(self.line(), indent):
            m = (_DOUBLE if self.text[start] == '"' else _SINGLE).match(self.text, start) if self.text[start] in "\"'" else None
            if not (m and re.match(r"[ ]*:(?=[ \n]|$)", self.text[m.end() : m.end() + 80])):
                self.at = start
                return self.value(indent - 1)
        return self.mapping(indent)

    def sequence(self, indent: int) -> list:
        out = []
        while self.next() == indent and re.match(r"-(?=[ \n]|$)", self.text[self.at + indent : self.at + indent + 2]):
            place = self.at + indent
            if re.fullmatch(r"[ ]*(#.*)?", self.line()[indent + 1 :]):
                self.at += len(self.line()) + 1
                out.append(self.block(indent + 1))
            else:
                self.text = self.text[:place] + " " + self.text[place + 1 :]
                out.append(self.block(indent + 1))
        return out

    def mapping(self, indent: int) -> dict:
        out = {}
        while (found := self.next()) >= indent:
            if found > indent:
                self.fail("an indent that fits nothing")
            m = _KEY.match(self.line(), indent)
            if not m:
                if re.match(r"-(?=[ \n]|$)", self.text[self.at + indent : self.at + indent + 2]):
                    break
                self.fail("no key")
            key = self.scalar_of(m[1])
            self.at += m.end()
            rest = self.line()
            if re.fullmatch(r"[ ]*(?:#.*)?", rest):
                self.at += len(rest) + 1
                deeper = self.next()
                if deeper == indent and re.match(r"-(?=[ \n]|$)", self.text[self.at + indent : self.at + indent + 2]):
                    out[key] = self.sequence(indent)
                else:
                    out[key] = self.block(indent + 1) if deeper > indent else None
            else:
                self.at += len(rest) - len(rest.lstrip(" "))
                out[key] = self.value(indent)
        return out

    def scalar_of(self, text: str) -> str:
        value = _IN_DOUBLE.sub(_in_double, text[1:-1]) if text[0] == '"' else text[1:-1].replace("''", "'") if text[0] == "'" else plain(text)
        return value if isinstance(value, str) else json.dumps(value)

    def value(self, indent: int) -> Any:
        """A scalar or a flow collection from here on; lines that go on are deeper than indent."""
        c = self.text[self.at]
        if c in "|>":
            return self.literal(indent)
        if c in "&*!%@`" or re.match(r"[-?](?=[ \n]|$)", self.line()):
            self.fail(f"{c} isn't read")
        if c in "\"'{[":
            value, end = self.flow(self.at)
            self.at = end
            rest = self.line()
            if not re.fullmatch(r"[ ]*(?:[ ]#.*)?", rest):
                self.fail("something behind a value")
            self.at += len(rest) + 1
            return value
        parts, blank = [], 0
        while True:
            line = self.line()
            shown = re.split(r"(?:^|[ \t])#", line, maxsplit=1)[0].strip(" \t")
            if parts and re.search(r":(?:[ ]|$)", shown) or not parts and re.search(r":(?:[ ]|$)", shown):
                self.fail("a key inside a value")
            parts += ["\n" * blank if blank else " " if parts else "", shown]
            self.at += len(line) + 1
            blank = 0
            ended = shown != line.strip(" \t")  # a comment ends it
            while self.at < len(self.text) and not self.line().strip(" \t"):
                blank += 1
                self.at += len(self.line()) + 1
            if ended or self.at >= len(self.text) or self.next() <= indent:
                return plain("".join(parts))

    def literal(self, indent: int) -> str:
        line = self.line()
        m = _BLOCK.match(line)
        if not m:
            self.fail("a block's head")
        self.at += len(line) + 1
        rows, keep, own = [], m[2] or m[4], indent + int(m[3]) if m[3] else 0
        own = max(own, 1) if m[3] and indent < 0 else own
        while self.at < len(self.text):
            line = self.line()
            lead = len(line) - len(line.lstrip(" "))
            if line.strip(" ") and lead <= indent:
                break
            if line.strip(" ") and not own:
                own = lead
            if line.strip(" ") and lead < own:
                self.fail("an indent inside a block")
            rows.append(line[own:] if own else "")
            self.at += len(line) + 1
        tail = 0
        while rows and not rows[-1]:
            rows.pop()
            tail += 1
        if m[1] == "|":
            text = "\n".join(rows)
        else:
            text = "".join(rows[:1])
            for before, row in zip(rows, rows[1:]):
                deep = row[:1] in (" ", "\t") or before[:1] in (" ", "\t")
                text += "\n" + row if deep or not row else ("" if not before else " ") + row
        return text + ("" if keep == "-" or not rows and keep != "+" else "\n" * (1 + tail if keep == "+" and rows else tail if keep == "+" else 1))

    def gap(self, p: int) -> int:
        return _GAP.match(self.text, p).end()

    def flow(self, p: int) -> tuple[Any, int]:
        if p >= len(self.text):
            self.fail("no end")
        c = self.text[p]
        if c in "\"'":
            m = (_DOUBLE if c == '"' else _SINGLE).match(self.text, p)
            if not m:
                self.fail("an open quote")
            return (_IN_DOUBLE.sub(_in_double, m[1]) if c == '"' else _BREAKS.sub(_breaks, m[1]).replace("''", "'")), m.end()
        if c not in "{[":
            m = _FLOW_PLAIN.match(self.text, p)
            if not m:
                self.fail("no value")
            return plain(_BREAKS.sub(_breaks, m[0].strip(" \t\n"))), m.end()
        out: Any = {} if c == "{" else []
        close, p = "}" if c == "{" else "]", self.gap(p + 1)
        while self.text[p : p + 1] != close:
            value, p = self.flow(p)
            p = self.gap(p)
            if self.text[p : p + 1] == ":":
                key = value if isinstance(value, str) else json.dumps(value)
                p = self.gap(p + 1)
                value, p = (None, p) if self.text[p : p + 1] in (",", close) else self.flow(p)
                p = self.gap(p)
                value = {key: value}
            elif c == "{":
                value = {value if isinstance(value, str) else json.dumps(value): None}
            out.update(value) if c == "{" else out.append(value)
            if self.text[p : p + 1] == ",":
                p = self.gap(p + 1)
            elif self.text[p : p + 1] != close:
                self.fail("an open collection")
        return out, p + 1


def load(text: str) -> Any:
    """The first document of a text. Raises ValueError for what isn't read."""
    text = re.sub(r"\r\n?", "\n", text.removeprefix("\ufeff"))
    text = re.sub(r"\A(?:(?:[ ]*|%[^\n]*|#[^\n]*)\n)*---(?:[ ]*(?=\n|\Z)|[ ])", "", text)
    text = re.split(r"^(?:---|\.\.\.)(?=[ \n]|\Z)", text, maxsplit=1, flags=re.M)[0]
    reader = _Reader(text)
    value = reader.block(0)
    if reader.next() >= 0:
        reader.fail("something behind the document")
    return value


def dump(values: dict[str, Any]) -> str:
    """A map in block form, a line for each name; what is inside is in flow form."""
    return "".join(f"{json.dumps(str(k), ensure_ascii=False)}: {json.dumps(v, ensure_ascii=False)}\n" for k, v in values.items()) or "{}\n"


@F.pandas_udf(T.StringType())
def _as_json(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(load(text), ensure_ascii=False, allow_nan=False)
        except (ValueError, KeyError, RecursionError):
            return None

    return texts.map(one)


def to_json(text: Column) -> Column:
    """YAML texts as JSON texts; null for what can't be read."""
    return _as_json(text)


def quoted(text: Column) -> Column:
    """A double-quoted scalar; null as null."""
    json_text = F.to_json(F.array(text))
    return F.when(text.isNull(), "null").otherwise(F.regexp_replace(json_text, r"\A\[|\]\z", ""))


def block_map(values: dict[str, Column | dict[str, Column]], indent: str = "") -> Column:
    """A block map of named texts, a line each; maps inside are deeper."""
    lines = []
    for name, value in values.items():
        lines.append(F.concat(F.lit(f"{indent}{name}:\n"), block_map(value, indent + "  ")) if isinstance(value, dict) else F.concat(F.lit(f"{indent}{name}: "), quoted(value)))
    return F.array_join(F.array(*lines), "\n")
