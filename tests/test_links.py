import random

from pyspark.sql import functions as F

from quirefold.operators import toc
from quirefold.sources import rules

SITE = rules.builtin()[0]
HOST = "https://ncode.syosetu.com"


def page(code, number, link, entries=1):
    shown = "".join(f'<div class="p-eplist__sublist">\n<a href="/{code}/{number}{k}/" class="p-eplist__subtitle">\nT{number}.{k}\n</a>\n<div class="p-eplist__update">\n2024/01/02 10:00\n</div>\n</div>' for k in range(entries))
    return (f"{HOST}/{code}/" + (f"?p={number}" if number > 1 else ""), shown + (f'<a href="{link}" class="c-pager__item c-pager__item--next">' if link else ""))


def chains(spark, pages, starts, monkeypatch):
    """The numbers of the pages of each work, and how many frames were written."""
    cuts = []
    monkeypatch.setattr(toc, "cut", lambda df: (cuts.append(1), df.checkpoint())[1])
    works = spark.createDataFrame([(i, u) for i, u in enumerate(starts)], "work_id long, toc_url string").withColumn("title", F.lit("x"))
    df = spark.createDataFrame(pages, "url string, html string").withColumns({"page_no": F.lit(7), "work_id": F.lit(1)}).repartition(3)
    found = toc.linked_pages(works, df, SITE).collect()
    return {i: [r.url.rpartition("=")[2] if "=" in r.url else "1" for r in sorted(found, key=lambda r: r.page_no) if r.work_id == i] for i in range(len(starts))}, len(cuts)


def test_long_chain_in_few_rounds(spark, monkeypatch):
    pages = [page("n1a", k, f"/n1a/?p={k + 1}" if k < 1000 else "") for k in range(1, 1001)]
    random.Random(1).shuffle(pages)
    found, cuts = chains(spark, pages, [f"{HOST}/n1a/"], monkeypatch)
    assert found[0] == [str(k) for k in range(1, 1001)] and cuts <= 3 + 2 * 11


def test_ends_of_chains(spark, monkeypatch):
    pages = [page("n2a", k, f"/n2a/?p={k % 3 + 1}") for k in (1, 2, 3)]  # back to an address that isn't the first one's
    pages += [page("n3a", 1, "/n3a/?p=2", 0), page("n3a", 2, "/n3a/?p=3"), page("n3a", 3, "/n3a/?p=5")]  # a first page without entries; a page that isn't there
    pages += [page("n4a", 1, "/n4a/?p=2"), page("n4a", 2, "/n4a/?p=3", 0), page("n4a", 3, "")]  # a later page without entries
    pages += [page("n5a", 1, "/n2a/?p=2"), page("n6a", 1, "/n6a/?p=2"), page("n6a", 2, "/n6a/?p=3"), page("n6a", 3, "/n6a/?p=2")]  # another code; a cycle
    pages += [(None, "x"), (f"{HOST}/n7a/", None), page("n6a", 2, "/n6a/?p=3"), ("https://elsewhere/", '<a href="/n1a/?p=2" class="c-pager__item c-pager__item--next">')]
    starts = [f"{HOST}/n{k}a/" for k in range(2, 9)] + ["https://elsewhere/", None]
    found, _ = chains(spark, pages, starts, monkeypatch)
    assert list(found.values()) == [["1", "2", "3"], ["1", "2", "3"], ["1"], ["1"], ["1", "2", "3"], ["1"], [], ["1"], []]
    works = spark.createDataFrame([(1, starts[1])], "work_id long, toc_url string")
    df = spark.createDataFrame(pages, "url string, html string")
    assert [r.subtitle for r in toc.linked_contents(works, df, SITE).orderBy("ordinal").collect()] == ["T2.0", "T3.0"]
    assert toc.linked_contents(works.limit(0), df, SITE).count() == 0 and toc.linked_contents(works, df.limit(0), SITE).count() == 0


def test_groups_in_later_patterns(spark):
    site = rules.SiteRules({"a": r"<(?<name>.+?)>", "b": [r"(?<x>\\k<nobody>)", r"\\k<name>=(?<value>\w+)"], "name": "own", "c": r"(?<broken>"})
    rows = [("<k.y>kxy=1 k.y=2",), ("<a\\E+b>a\\E+b=é",), ("own=5",), ("<k>nothing",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(rules.multi_match(F.col("t"), site, ["a", "c", "b"]).alias("f")).collect()
    assert [(r.f.name, r.f.value) for r in got] == [("k.y", "2"), ("a\\E+b", "é"), (None, "5"), ("k", None), (None, None)]
    known = site.pattern("c")
    assert not known.valid and df.where(known.found(F.col("t"))).count() == 0
    by_column = rules.SiteRules({"p": r"\\k<w>!(?<r>.)"}).pattern("p", {"w": F.col("w")})
    both = spark.createDataFrame([("a.!x", "a."), ("ab!x", "a."), ("a!x", None)], "t string, w string")
    assert [r[0] for r in both.select(F.when(by_column.found(F.col("t")), by_column.group(F.col("t"), "r"))).collect()] == ["x", None, None]
