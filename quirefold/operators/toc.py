"""Targets, tables of contents, metadata and episode texts out of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.html import annotated, body_text
from quirefold.functions.strings import parse_date, pretreat, safe_filename, strip
from quirefold.sources.rules import SiteRules, chain, match, multi_match
from quirefold.sources.shared import cut

# Fixed values ------------------------------------------------------------------------------------------------------
#: Classes of the parts of an episode's page.
PREFACE = r'(?s)<div class="js-novel-text p-novel__text p-novel__text--preface">(.*?)</div>'
BODY = r'(?s)<div class="js-novel-text p-novel__text">\s*(.*?)\s*</div>'
AFTERWORD = r'(?s)<div class="js-novel-text p-novel__text p-novel__text--afterword">(.*?)</div>'
CODE = r"^n\p{Nd}+[a-z]+$"
UNKNOWN = "不明"
# -------------------------------------------------------------------------------------------------------------------


def resolve_targets(targets: DataFrame, works: DataFrame, sites: list[SiteRules], column: str = "target", default_site: str | None = None) -> DataFrame:
    """targets with site, code and toc_url: a URL is of the first site whose pattern it matches, a code of the default
    site, a number is a work whose URL is resolved so; else null."""
    default_site = default_site or sites[0].raw("name")
    plain = F.lower(strip(F.col(column)))
    number = F.when(strip(F.col(column)).rlike(r"^[+-]?\d+$"), strip(F.col(column)).try_cast("long"))
    known = works.select(F.col("id").alias("_id"), F.lower("toc_url").alias("_url"))
    rows = targets.withColumn("_number", number).join(known, F.col("_number") == F.col("_id"), "left")
    url = F.when(plain.startswith("http"), plain).otherwise(F.col("_url"))
    patterns = [(s, s.pattern("url")) for s in sites]
    by_url = [(url.rlike(p), F.lit(s.raw("name"))) for s, p in patterns]
    is_code = plain.rlike(CODE)
    site = chain([(is_code, F.lit(default_site)), *by_url], F.lit(None).cast("string"))
    code = chain([(is_code, plain), *[(url.rlike(p), F.lower(F.regexp_extract(url, p, p.groups["ncode"]))) for _, p in patterns]], F.lit(None).cast("string"))
    rows = rows.withColumns({"site": site, "code": code}).drop("_number", "_id", "_url")
    tocs = [(F.col("site") == s.raw("name"), s.text("toc_url", {"ncode": F.col("code")})) for s in sites]
    return rows.withColumn("toc_url", chain(tocs, F.lit(None).cast("string")))


def entries(source: Column, site: SiteRules) -> Column:
    """The episodes of a page of contents in order; groups that take no part are ''."""
    pattern = site.pattern("subtitles")
    each = lambda name: F.regexp_extract_all(source, F.lit(pattern), F.lit(pattern.groups[name]))
    zipped = F.arrays_zip(*[each(n).alias(n) for n in ("index", "href", "chapter", "subtitle", "subdate", "subupdate")])

    def entry(z: Column) -> Column:
        title = strip(F.translate(z.subtitle, "\t\n", ""))
        return F.struct(
            z.index.alias("index"),
            z.href.alias("href"),
            z.chapter.alias("chapter"),
            title.alias("subtitle"),
            safe_filename(title).alias("file_subtitle"),
            strip(z.subdate).alias("subdate"),
            strip(z.subupdate).alias("subupdate"),
        )

    return F.transform(zipped, entry)


def contents(pages: DataFrame, site: SiteRules, work_col: str = "work_id", page_col: str = "page_no", html_col: str = "html") -> DataFrame:
    """One row an episode: the entries of a work's pages of contents, one page after another, up to the first page that
    has none or has no link to a next one; ordinal is their order. Pages are in order here; linked_pages puts them in order."""
    source = pretreat(F.col(html_col))
    following = site.pattern("toc_next_url", {"ncode": r"[^/]+"})
    found = pages.select(work_col, page_col, entries(source, site).alias("entries"), source.rlike(following).alias("more"))
    before = Window.partitionBy(work_col).orderBy(page_col).rowsBetween(Window.unboundedPreceding, -1)
    cont = F.coalesce(F.bool_and(F.col("more") & (F.size("entries") > 0)).over(before), F.lit(True))
    return _listed(found.withColumn("go", cont).where("go"), work_col, page_col)


def _listed(found: DataFrame, work_col: str, page_col: str) -> DataFrame:
    """Entries of pages, numbered through a work."""
    before = Window.partitionBy(work_col).orderBy(page_col).rowsBetween(Window.unboundedPreceding, -1)
    kept = found.withColumn("first", F.coalesce(F.sum(F.size("entries")).over(before), F.lit(0)))
    rows = kept.select(work_col, "first", F.posexplode("entries").alias("at", "e"))
    return rows.select(work_col, (F.col("first") + F.col("at")).alias("ordinal"), "e.*")


def linked_pages(works: DataFrame, pages: DataFrame, site: SiteRules) -> DataFrame:
    """(work_id, page_no, url, entries) of all pages of contents of works (work_id, toc_url), following the link of each page.

    pages has url and html, in no order, of any number of works: a page is found by its own address (of pages that repeat
    one, the first by html). A link counts if it has the code that its own page's address has. The first page of a work is
    that of its toc_url; a chain ends at a page without a link, before one that isn't there or (but for the first) has no
    entries, and where it comes back to a page that it had.

    Pointers are doubled: after k rounds each page knows the page 2 ** k links on, and each work its first 2 ** k pages, so
    a chain of n pages takes about log2(n) joins, whatever the number of works.
    """
    source = pretreat(F.col("html"))
    address = site.pattern("url")
    code = F.when(address.found(F.col("url")), address.group(F.col("url"), "ncode"))
    link = site.pattern("toc_next_url", {"ncode": F.col("_code")})
    coded = pages.where("url is not null").groupBy("url").agg(F.min("html").alias("html")).withColumn("_code", code)
    following = F.when(link.found(source), F.concat(F.lit(site.resolve("top_url")), link.group(source, "toc_next_url")))
    read = cut(coded.select("url", entries(source, site).alias("entries"), following.alias("next")))
    known = read.where(F.size("entries") > 0).select(F.col("url").alias("next"))
    jump = cut(read.where("next is not null").select("url", "next").join(known, "next", "left_semi"))
    chain = cut(works.where("toc_url is not null").select("work_id", F.col("toc_url").alias("url"), F.lit(0).alias("page_no")).join(read.select("url"), "url", "left_semi").distinct())
    n, step = chain.count(), 1
    while n:
        further = chain.join(jump, "url").select("work_id", F.col("next").alias("url"), (F.col("page_no") + step).alias("page_no"))
        grown = cut(chain.unionByName(further).groupBy("work_id", "url").agg(F.min("page_no").alias("page_no")))
        chain, before, n = grown, n, grown.count()
        if n == before:
            break
        jump = cut(jump.join(jump.select(F.col("url").alias("next"), F.col("next").alias("_to")), "next").select("url", F.col("_to").alias("next")))
        step *= 2
    return chain.join(read.select("url", "entries"), "url").select("work_id", "page_no", "url", "entries")


def linked_contents(works: DataFrame, pages: DataFrame, site: SiteRules) -> DataFrame:
    """What contents() gives, of pages that are found by their links (see linked_pages)."""
    return _listed(linked_pages(works, pages, site), "work_id", "page_no")


def short_story_entry(title: Column, first_up: Column, updated: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.array(
        F.struct(F.lit("1").alias("index"), F.lit("/1/").alias("href"), F.lit("").alias("chapter"), title.alias("subtitle"), safe_filename(title).alias("file_subtitle"), text(first_up).alias("subdate"), text(updated).alias("subupdate"))
    )


def episode_url(href: Column, top_url: Column, toc_url: Column) -> Column:
    return F.when(href.startswith("/"), F.concat(top_url, href)).otherwise(F.concat(toc_url, href))


def info(source: Column, site: SiteRules, fix_dates: bool = False) -> Column:
    """Title, kind, end, story, writer and dates of an information page."""
    source = pretreat(source)
    part = lambda key, name: F.coalesce(match(source, [site.pattern(key)])[name], F.lit(""))
    kinds = site.raw("novel_type_string") or {}
    kind = part("nt", "novel_type")
    status = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), kind), F.lit(1)) if kinds else F.lit(1)
    parts = F.coalesce(part("ga", "general_all_no").try_cast("long"), F.lit(0))
    story = part("s", "story")
    return F.struct(
        part("t", "title").alias("title"),
        part("w", "writer").alias("writer"),
        (status == 3).alias("end"),
        F.when((status == 2) & (parts <= 1), 2).otherwise(1).alias("novel_type"),
        F.when(story == "", "").otherwise(annotated(story)).alias("story"),
        *[parse_date(part(k, name), fix_dates).alias(name) for k, name in (("gf", "general_firstup"), ("nu", "novelupdated_at"), ("gl", "general_lastup"))],
    )


def api_info(reply: Column) -> Column:
    """A reply of a metadata service, as JSON: two maps, the first with allcount 1; else null. The kind is what `noveltype` says,
    1 if it says nothing; end 0 means complete. A reply as YAML goes through sources.yaml_text.to_json first."""
    kind = "array<struct<allcount:string,title:string,writer:string,story:string,noveltype:string,end:string,general_all_no:string,general_firstup:string,general_lastup:string,novelupdated_at:string>>"
    rows = F.from_json(reply, kind)
    item = F.get(rows, 1)
    fine = (F.size(rows) >= 2) & (F.get(rows, 0).allcount == "1") & item.isNotNull()
    same = [item[n].alias(n) for n in ("general_firstup", "general_lastup", "novelupdated_at")]
    return F.when(fine, F.struct(item.title.alias("title"), F.coalesce(item.writer, F.lit("")).alias("writer"), item.story.alias("story"), F.coalesce(item.noveltype.try_cast("int"), F.lit(1)).alias("novel_type"), (item.end == "0").alias("end"), item.general_all_no.try_cast("int").alias("general_all_no"), *same))


def metadata(toc: DataFrame) -> DataFrame:
    """A work's row out of its table of contents (title, author, sitename, novel_type, subtitles)."""
    name = lambda c: F.when(F.coalesce(c, F.lit("")) == "", UNKNOWN).otherwise(F.col(c)).alias(c)
    return toc.select("toc_url", name("title"), name("author"), F.coalesce("sitename", F.lit("")).alias("sitename"), F.coalesce("novel_type", F.lit(1)).alias("novel_type"), F.size("subtitles").alias("general_all_no"))


def page_info(source: Column, site: SiteRules) -> Column:
    """What info() gives, out of a page of contents: title, author and story where the site has rules for them; else null."""
    rules = [k for k in ("title", "author", "story") if site.raw(k)]
    if "title" not in rules:
        return F.lit(None).cast("struct<title:string,writer:string,story:string,end:boolean,novel_type:int>")
    found = multi_match(pretreat(source), site, rules)
    part = lambda name: F.coalesce(found[name], F.lit("")) if name in rules else F.lit("")
    story = part("story")
    made = F.struct(part("title").alias("title"), part("author").alias("writer"), F.when(story == "", "").otherwise(annotated(story)).alias("story"), F.lit(False).alias("end"), F.lit(1).alias("novel_type"))
    return F.when(found["title"].isNotNull(), made)


def tables_of_contents(works: DataFrame, pages: DataFrame, site: SiteRules) -> DataFrame:
    """A row for each work: title, author, toc_url, story, end, novel_type and subtitles, an array of entries in order.

    works has work_id, toc_url and info (as info() gives it, or null where there was no information page); pages has
    work_id, page_no and html. Without information or its title the first page of contents is asked for them; works that
    have no title there either are left out. Short stories get their single entry, the others those of their pages.
    """
    first = pages.groupBy("work_id").agg(F.min_by("html", "page_no").alias("_page"))
    listed = contents(pages, site).groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "index", "href", "chapter", "subtitle", "file_subtitle", "subdate", "subupdate"))).alias("_rows"))
    known = F.coalesce(F.col("info.title"), F.lit("")) != ""
    names = ("title", "writer", "story", "end", "novel_type")
    same = [F.col(f"info.{n}").alias(n) for n in names]
    dates = F.struct(F.col("info.general_firstup").alias("first"), F.coalesce("info.novelupdated_at", "info.general_lastup").alias("last"))
    rows = works.join(first, "work_id", "left").join(listed, "work_id", "left")
    rows = rows.withColumns({"_info": F.when(known, F.struct(*same)).otherwise(page_info(F.col("_page"), site)), "_dates": F.when(known, dates)}).where("_info is not null")
    entry = short_story_entry(F.col("_info.title"), F.col("_dates.first"), F.col("_dates.last"))
    many = F.transform(F.coalesce("_rows", F.array()), lambda r: F.struct(*[r[n].alias(n) for n in ("index", "href", "chapter", "subtitle", "file_subtitle", "subdate", "subupdate")]))
    listing = F.when(F.coalesce("_info.novel_type", F.lit(1)) == 1, many).otherwise(entry).alias("subtitles")
    return rows.select("work_id", "_info.title", F.col("_info.writer").alias("author"), "toc_url", "_info.story", "_info.end", "_info.novel_type", listing)


def element(source: Column, site: SiteRules) -> Column:
    """Introduction, body and postscript of an episode's page."""
    if site.raw("text_by_class"):
        part = lambda p: body_text(F.regexp_extract(source, p, 1))
        return F.struct(part(PREFACE).alias("introduction"), part(BODY).alias("body"), part(AFTERWORD).alias("postscript"), F.lit("text").alias("data_type"))
    each = lambda p: F.coalesce(match(source, [site.pattern(f"{p}_pattern")])[p], F.lit("")) if site.raw(f"{p}_pattern") else F.lit("")
    return F.struct(*[each(p).alias(p) for p in ("introduction", "body", "postscript")], F.lit("html").alias("data_type"))
