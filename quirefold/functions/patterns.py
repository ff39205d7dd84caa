r"""Patterns and replacements in Python's syntax as Java's, which Spark's functions take.

A pattern is parsed by the standard library and written anew from its parts, with the meaning that Python gives them:
\w, \d, \s and \b are those of Unicode (of ASCII under the flag a), `.` stops at \n alone, ^ and $ know \n alone ($ also
matches before a last \n), \Z is the very end, (?P=name) and (?(1)yes|no) work, and comments and blanks of the flag x are gone.
Groups are numbered; names are resolved here. A rule that Python doesn't take (a pattern that isn't one, a replacement that
refers to a group that isn't there) stands for itself, letter by letter.

Known differences: letters that one side's Unicode version doesn't know yet, and a repeated group whose last round is empty.
"""

from __future__ import annotations

import re
import warnings
from re import _constants as c
from re import _parser as parser  # the standard library's own parser; it has no public name

_WORD, _DIGIT = r"\p{L}\p{N}_", r"\p{Nd}"
_SPACE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Members of a class by category: for Unicode, for ASCII. A category that negates another has it here, too.
_CATEGORIES = {
    c.CATEGORY_WORD: (_WORD, "A-Za-z0-9_"),
    c.CATEGORY_DIGIT: (_DIGIT, "0-9"),
    c.CATEGORY_SPACE: (_SPACE, r"\t-\r\x20"),
}
_NEGATED = {c.CATEGORY_NOT_WORD: c.CATEGORY_WORD, c.CATEGORY_NOT_DIGIT: c.CATEGORY_DIGIT, c.CATEGORY_NOT_SPACE: c.CATEGORY_SPACE}
_ANY = r"(?s:.)"
_MOST = 2**31 - 1


def literal(text: str) -> str:
    """A pattern that matches the text itself."""
    return "".join(x if x.isascii() and x.isalnum() else f"\\x{{{ord(x):x}}}" for x in text)


def literal_replacement(text: str) -> str:
    return re.sub(r"[\\$]", r"\\\g<0>", text)


class _Writer:
    """Writes the parts of one pattern. Groups that conditions ask for get an empty group of their own behind them, as Java
    can refer back to a group but not ask whether it took part."""

    def __init__(self, asked: set[int], flags: int):
        self.asked, self.groups, self.number, self.marks = asked, 0, {}, {}
        self.folds = flags & re.IGNORECASE  # for the whole pattern

    def all(self, parts, flags: int) -> str:
        return "".join(self.one(op, arg, flags) for op, arg in parts)

    def one(self, op, arg, flags: int) -> str:
        if op is c.LITERAL:
            return self.folded(literal(chr(arg)), flags)
        if op is c.NOT_LITERAL:
            return f"(?!{self.folded(literal(chr(arg)), flags)}){_ANY}"
        if op is c.ANY:
            return _ANY if flags & re.DOTALL else r"[^\n]"
        if op is c.IN:
            return self.members(arg, flags)
        if op is c.BRANCH:
            return "(?:" + "|".join(self.all(x, flags) for x in arg[1]) + ")"
        if op is c.SUBPATTERN:
            number, added, removed, inner = arg
            flags = (flags | added) & ~removed
            if added & re.ASCII:
                flags &= ~re.UNICODE
            return f"(?:{self.all(inner, flags)})" if number is None else self.group(number, inner, flags)
        if op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
            low, high, inner = arg
            if low > _MOST:
                return "(?!)"
            bounds = f"{{{low},{'' if high is c.MAXREPEAT or high > _MOST else high}}}"
            written = self.all(inner, flags)
            single = len(inner) == 1 and (inner[0][0] is c.LITERAL or written[0] == "[" and "|" not in written)
            return (written if single and written[:2] != "(?" else f"(?:{written})") + bounds + {c.MAX_REPEAT: "", c.MIN_REPEAT: "?", c.POSSESSIVE_REPEAT: "+"}[op]
        if op is c.ATOMIC_GROUP:
            return f"(?>{self.all(arg, flags)})"
        if op in (c.ASSERT, c.ASSERT_NOT):
            back, inner = arg
            return f"(?{'<' if back < 0 else ''}{'=' if op is c.ASSERT else '!'}{self.all(inner, flags)})"
        if op is c.GROUPREF:
            return self.folded(f"\\{self.number[arg]}(?:)", flags)
        if op is c.GROUPREF_EXISTS:
            number, yes, no = arg
            mark = f"\\{self.marks[number]}(?:)" if number in self.marks else "(?!)"
            return f"(?:{mark}{self.all(yes, flags)}|(?!{mark}){self.all(no or [], flags)})"
        if op is c.AT:
            return self.at(arg, flags)
        if op is c.FAILURE:
            return "(?!)"
        raise re.error(f"no form for {op}")

    def group(self, number: int, inner, flags: int) -> str:
        self.groups += 1
        self.number[number] = self.groups
        body = self.all(inner, flags)
        if number not in self.asked:
            return f"({body})"
        self.groups += 1
        self.marks[number] = self.groups
        return f"({body})()"

    def folded(self, pattern: str, flags: int) -> str:
        if bool(flags & re.IGNORECASE) == bool(self.folds):
            return pattern
        return f"(?{'-iu' if self.folds else 'iu' if flags & re.UNICODE else 'i'}:{pattern})"

    def members(self, items, flags: int) -> str:
        plain, others, negated = "", [], False
        for op, arg in items:
            if op is c.NEGATE:
                negated = True
            elif op is c.LITERAL:
                plain += literal(chr(arg))
            elif op is c.RANGE:
                plain += f"{literal(chr(arg[0]))}-{literal(chr(arg[1]))}"
            else:
                no = arg in _NEGATED
                others.append(self.folded(f"[{'^' * no}{self.category(_NEGATED[arg] if no else arg, flags)}]", flags & ~re.IGNORECASE))
        if negated and not others:
            return self.folded(f"[^{plain}]", flags)
        either = [*([self.folded(f"[{plain}]", flags)] if plain else []), *others]
        return f"(?:(?!{'|'.join(either)}){_ANY})" if negated else either[0] if len(either) == 1 else f"(?:{'|'.join(either)})"

    def category(self, name, flags: int) -> str:
        return _CATEGORIES[name][0 if flags & re.UNICODE else 1]

    def at(self, where, flags: int) -> str:
        word = f"[{self.category(c.CATEGORY_WORD, flags)}]"
        if where is c.AT_BEGINNING:
            return r"(?<![^\n])" if flags & re.MULTILINE else r"\A"
        if where is c.AT_END:
            return r"(?![^\n])" if flags & re.MULTILINE else r"(?=\n?\z)"
        if where is c.AT_BOUNDARY:
            return f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
        if where is c.AT_NON_BOUNDARY:
            empty = "" if re.search(r"\B", "") else r"(?!\A\z)"  # Python's versions differ in an empty text
            return f"(?:{empty}(?:(?<={word})(?={word})|(?<!{word})(?!{word})))"
        return {c.AT_BEGINNING_STRING: r"\A", c.AT_END_STRING: r"\z"}[where]


def _asked(parts) -> set[int]:
    """The groups that conditions ask for."""
    found: set[int] = set()
    for op, arg in parts:
        if op is c.GROUPREF_EXISTS:
            found.add(arg[0])
        todo = [arg]
        while todo:
            x = todo.pop()
            if isinstance(x, parser.SubPattern):
                found |= _asked(x)
            elif isinstance(x, (tuple, list)):
                todo += x
    return found


def java_pattern(pattern: str) -> tuple[str, dict[int, int]]:
    """Java's form of a pattern, and the number there of each group. Raises re.error if Python doesn't take it."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        re.compile(pattern)
        parsed = parser.parse(pattern)
    flags = parsed.state.flags
    writer = _Writer(_asked(parsed), flags)
    written = writer.all(parsed, flags)
    if not parsed.getwidth()[0]:
        written = rf"(?![\x{{DC00}}-\x{{DFFF}}])(?:{written})"  # an empty match is never inside a character beyond 16 bits
    return ("" if not writer.folds else "(?iu)" if flags & re.UNICODE else "(?i)") + written, writer.number


def java_rule(pattern: str, replacement: str) -> tuple[str, str]:
    """Java's pattern and replacement for a rule; of a rule that Python doesn't take, those that match it literally."""
    try:
        java, number = java_pattern(pattern)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            template = parser.parse_template(replacement, re.compile(pattern)) if "\\" in replacement else [replacement]
    except (re.error, IndexError, OverflowError, RecursionError):
        return literal(pattern), literal_replacement(replacement)
    out = ""
    for part in template:
        if isinstance(part, int):
            out += f"${number[part]}" if part else "$0"
        elif part:
            text = literal_replacement(part)
            out += "\\" + text if text[0].isdigit() and out and out[-1].isdigit() else text
    return java, out
