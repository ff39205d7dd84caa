import random
import re

import pytest
from pyspark.sql import functions as F

from quirefold.functions import normalize, patterns

TEXTS = [
    "", "übing singing Straße_9 ２３ x", "a\nb\n", "a\r\nb\x85c\u2028d", "abcabc AbC äÄ ſs K", "aa bb cc\n", "foo123 bar\t45\u00a0٤٥ 六 ²", "x" * 50, "「漢字」 かな カナ ！？[a]", "日本😀語 😀😀",
    "a.b*c+d?e(f)[g]{h}|i^j$k\\l", "2024-01-31, 1999-12-01", "\n\nfirst\nsecond\n", "aXbXc", "<b>bold</b><i>it</i>", "a$1 \\1 $", "__init__ and _x", "İi ıI", "   lead", "tail   ", "ab" * 20,
]
RULES = [
    (r"(\w+)ing\b", r"<\1>"), (r"\bs", "S"), (r"\d+", "#"), (r"\D+", "-"), (r"\s+", " "), (r"\S+", "w"), (r"\W", "."), (r"\B", "|"), (r"\b", "|"), (".", "x"), ("(?s).", "x"), ("(?s).+", "x"), ("^", ">"), ("(?m)^", ">"),
    ("$", "<"), ("(?m)$", "<"), (r"\Z", "<"), (r"\A", ">"), (r"a\Z", "!"), (r"b$", "!"), (r"(?m)b$", "!"), (r"(?P<a_b>[a-z])(?P=a_b)", r"\g<a_b>2"), (r"(?P<first>\w)(\w)", r"\2\g<first>"), (r"(a)(b)?", r"[\1\2]"), (r"(a)|(b)", r"\1-\2"),
    (r"(<)?b(?(1)>|o)", "T"), (r"(?P<q>\()?f(?(q)\))", "F"), (r"(?i)abc", "n"), (r"(?i)[ä-ü]", "n"), (r"(?i)(a)\1", "n"), (r"(?i)s", "z"), (r"(?i:B)c", "n"), (r"(?i)a(?-i:B)c", "n"), (r"(?a)\w+", "w"), (r"(?a:\w)+é?", "w"), (r"(?x) a  b # twice" + "\n c", "n"),
    (r"[^\W\d_]+", "L"), (r"[^\s\d]", "q"), (r"[\w.]+", "k"), (r"[\D5]", "k"), (r"[]a]", "k"), (r"[^]a]", "k"), (r"[a\-z&&b]", "k"), (r"[a-c[]", "k"), (r"x*", "-"), (r"x{2,3}?", "y"), (r"x{3}", "y"), (r"x++", "y"), (r"(?>ab)+", "y"), (r"(?<=a)b", "y"), (r"(?<!a)b", "y"),
    (r"a(?=b)", "y"), (r"a(?!b)", "y"), (r"(\d{4})-(\d\d)-(\d\d)", r"\3.\2.\1"), ("😀", "e"), ("[😀語]", "e"), (r"(?:ab){2}", "c"), (r"\$1", "money"), ("a", "$1"), ("a", r"\\1"), ("a", r"\n"), ("(a)", r"\g<1>0"), ("(a)", r"\g<0>\g<0>"), ("(.)", r"\1\1"), (r"\.", r"\t"),
    # what isn't a rule is literal
    ("[a]{h}|i^j$k\\", "x"), ("(f)[g", "x"), ("*c", "x"), ("a", r"\1"), ("a", r"\q"), ("b", r"\g<nope>"), ("a(?P<1>x)", "y"), ("a)", r"\1"), (r"(?P=no)", "x"), ("x(?i)", "y"), (r"(?<=a*)b", "x"),
]


def wanted(pattern, replacement, text):
    try:
        return re.sub(pattern, replacement, text)
    except (re.error, IndexError):
        return text.replace(pattern, replacement)


def compare(spark, rules):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    java = [patterns.java_rule(*r) for r in rules]
    rows = df.select("i", F.array(*[F.regexp_replace("t", p, r) for p, r in java]).alias("out")).collect()
    return [(rule, TEXTS[r.i], got, want) for r in rows for rule, got in zip(rules, r.out, strict=True) if got != (want := wanted(*rule, TEXTS[r.i]))]


@pytest.mark.filterwarnings("ignore")
def test_as_pythons_patterns(spark):
    assert not compare(spark, RULES)


@pytest.mark.filterwarnings("ignore")
def test_random_patterns(spark):
    draw = random.Random(11)
    atoms = ["a", "b", "ß", "X", r"\w", r"\W", r"\d", r"\s", r"\S", ".", "[a-c]", "[^a\\s]", "[\\W_x]", "(a|b)", "(?:ab|c)", "(?P<n%d>[a-z])", "(x)?", r"\b", "^", "$", "(?i:A)", "(?=b)", "(?<!a)", "\n", "😀", "é", "2"]
    rules = []
    while len(rules) < 150:
        parts = [a % i if "%d" in (a := draw.choice(atoms)) else a for i in range(draw.randrange(1, 5))]
        pattern = draw.choice(["", "", "(?i)", "(?m)", "(?s)", "(?a)"]) + "".join(x + (draw.choice(["", "", "", "*", "+", "?", "+?", "{1,2}"]) if x not in ("^", "$", r"\b") and not x.startswith(("(?=", "(?<")) else "") for x in parts)
        rules.append((pattern, draw.choice(["-", r"<\g<0>>", r"\1", "$", r"\g<1>1"])))
    assert not compare(spark, rules)


def test_rules_in_order(spark):
    df = spark.createDataFrame([("singing the song",)], "t string")
    rules = [(r"(\w+)ing\b", r"<\1>"), ("[broken", "x"), ("the", "$"), (r"\$ s", r"\1")]
    assert df.select(normalize.user_rules(F.col("t"), rules)).first()[0] == "<sing> $ song"
