import random
from urllib.parse import urljoin

from pyspark.sql import functions as F

from quirefold.functions import html

PAIRS = [
    ("http://h/a/b/c/d/e", "../../../../../x"), ("http://h/a/b/c/d/e/f/g", "../../../../../x"), ("http://h/a", "../x?y=/a/../b"), ("http://h/a/b?q=/../c", "x"), ("http://h/a/b", "./.././../x/./y/.."), ("http://h", "x"), ("http://h?q", "x"),
    ("http://h/a/b;p?q#f", ""), ("http://h/a/b;p?q#f", "#g"), ("http://h/a/b;p?q#f", "?r"), ("http://h/a/b;p?q", ";x"), ("http://h/a/b", "..;x"), ("http://h/a//b//c", "d//e"), ("http://h/a/b", "//other/../x"), ("http://h/a/b", "HTTP://H2/./x"), ("http://h/a/b", "http:x"),
    ("https://h/a/b", "http://k/x"), ("http://h/a/b", "mailto:x@y"), ("http://h/a/b", "data:image/png;base64,AA=="), ("http://h/a/b", "/"), ("http://h/a/b", "/../.."), ("http://h/a/b", "x?"), ("http://h/a/b", " x\t\ny"), ("", "x"), ("http://h/日本/語", "../画像 1.png#é"), ("http://h/a/b", "."), ("http://h/a/b/", ".."),
]


def test_as_the_standard_library(spark):
    draw = random.Random(6)
    segments = ["a", "b", "..", ".", "", "c.d", "..x", "x;p", "é", "a b", "%20"]
    path = lambda n: "/".join(draw.choice(segments) for _ in range(draw.randrange(0, n)))
    tail = lambda: draw.choice(["", "", "?q=/../a", "?x=1&y=..", "#f/../g", "?a#b", ";r"])
    pairs = PAIRS + [(draw.choice(["http://h", "https://h:8080", "http://u@h"]) + "/" + path(7) + tail(), draw.choice(["", "", "", "/", "//k/", "http://k/", "https:"]) + path(9) + tail()) for _ in range(1500)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, base string, src string")
    got = [r.u for r in df.select("i", html.resolve(F.col("src"), F.col("base")).alias("u")).orderBy("i").collect()]
    assert [(p, g, w) for p, g in zip(pairs, got, strict=True) if g != (w := urljoin(*p))] == []
