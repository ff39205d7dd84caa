"""One query an operator over the tables of a folder, and SQL that gives the same rows in DuckDB.

The tables hold no Japanese text, so stages of normalisation see each document with SAMPLE behind it, which has what
they look for.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.functions import html, markup, normalize, strings
from quirefold.functions.tokens import hide, restore, stash
from quirefold.operators import assemble, catalog, diff, illustrations, outcomes, toc
from quirefold.plans.books import books, books_or_errors
from quirefold.plans.normalize import normalize as normalize_all
from quirefold.plans.normalize import normalize_by_work
from quirefold.sources import rules, settings, store, yaml_text
from quirefold.sources.shared import cut, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: What stages do to a text t, in SQL.
STAGE: dict[str, str] = {}

SAMPLE = (
    "\nｶﾞｷﾞ ﾊﾟか゛カ゛ウ゛—\n「一行目\n　二行目『中\n 身』」と、\n　続く、\n　「開く\n==========\n消える\n==========\nII章 第II章 vii IX\n"
    "<b>太い</b>\n------\n'quote' \"double\" 《山》 a,b;c\n－１－\n3.14と２．５ 12人 100人 5 1,000\nＡ一二 三㎏ 一〇〇〇〇年 二〇〇〇〇〇〇〇五\n"
    "本当！?嘘！」ええ? はい！\n・・・・。。。．．．──\n３／４ ２０２４／２／３０ 2024／1／31\n漢字≪かんじ≫ 東京（とうきょう） ｜≪そのまま≫\n――影\n『題』\n〔注\n\n\n\n\n\n終\n\n\n\n\n\n\n\n\n\n\n完"
)
ANNOTATED = (
    "\n［＃ここから前書き］\nA & B < C\n［＃ここで前書き終わり］\n　［＃挿絵（a.png）入る］\n［＃挿絵（http://x/y.jpg）入る］\n前［＃改ページ］\n［＃改ページ］\n［＃区切り線］\n　\n"
    "［＃二分アキ］「会話」\n［＃ゴシック体］太［＃ゴシック体終わり］［＃縦中横］12［＃縦中横終わり］［＃濁点］か［＃濁点終わり］［＃「点」に傍点］※［＃縦線］\n｜東京《とうきょう》と漢字《かんじ》 'q' \"d\"［＃太字］"
)


#: SAMPLE and what stages hide: URLs, notes of illustrations, sentences, headings.
SPANS = SAMPLE + "\n見よhttps://example.com/A?b=c~d よ［＃挿絵（a.png）入る］［＃挿絵（http://x/y.jpg）入る］ほ\n「Hello world」 abcDEFGH ABCDEFGH ab\n　―第―\n　－２章\n＜３＞\n四―\n"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_pairs(expr: str, pairs) -> str:
    for a, b in pairs:
        expr = f"replace({expr}, {lit(a)}, {lit(b)})"
    return expr


def sql_sub(expr: str, *pairs) -> str:
    """Patterns and replacements (groups as \\1), one after another."""
    for pattern, new in pairs:
        expr = f"regexp_replace({expr}, {lit(pattern)}, {lit(new)}, 'g')"
    return expr


def sql_rewrite(expr: str, pattern: str, change: str) -> str:
    """Matches x[2] as `change` says."""
    p = lit(pattern)
    return (
        f"array_to_string(list_transform(list_zip(string_split_regex({expr}, {p}), regexp_extract_all({expr}, {p})), "
        f"lambda x: coalesce(x[1], '') || coalesce({change}, '')), '')"
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def add_stage(name: str, change, sql: str | None, sample: str = SAMPLE) -> None:
    """A query of a column function over documents with a sample behind them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
        return docs.select("doc_id", F.concat("text", F.lit(sample)).alias("t")).select("doc_id", change(F.col("t")).alias("out"))

    QUERIES[name] = run
    if sql:
        STAGE[name] = sql
        SQL[name] = f"select doc_id, {sql} as out from (select doc_id, text || {lit(sample)} as t from documents)"


# -- pages ----------------------------------------------------------------------------------------------------------

_BODY_SQL = "regexp_replace(" + sql_pairs(
    sql_sub("html", (r"<br\s*/?>", "\n"), (r"(?s)<p[^>]*>(.*?)</p>", "\\1\n"), (r"<[^>]+>", "")), strings.BODY_ENTITIES
) + ", '\\n{3,}', chr(10) || chr(10), 'g')"
_STRIP = r"^\s+|\s+$"


@query(f"select page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as title, {sql_sub(_BODY_SQL, (_STRIP, ''))} as body from pages")
def page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), html.body_text(F.col("html")).alias("body"))


@query("select page_id, length(title) as title_chars, length(body) as body_chars, len(regexp_extract_all(body, '[^ \\n\\t\\r\\f\\x0B]+')) as words from (" + SQL["page_text"] + ")")
def page_counts(spark, sf_dir):
    rows = page_text(spark, sf_dir)
    words = F.regexp_extract_all("body", F.lit(r"[^ \n\t\r\f\x0B]+"), F.lit(0))
    return rows.select("page_id", F.length("title").cast("long").alias("title_chars"), F.length("body").cast("long").alias("body_chars"), F.size(words).cast("long").alias("words"))


@query(f"select page_id, {sql_sub(sql_pairs(sql_sub('html', (r'[' + chr(13) + chr(10) + ']+', ''), ('(?i)<br' + chr(92) + 's*/?>', chr(10))), [('《', '≪'), ('》', '≫')]), ('(?i)<b>', '［＃太字］'), ('(?i)</b>', '［＃太字終わり］'), ('(?-s)<.+?>', ''))} as note_text from pages")
def page_annotated(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.annotated(F.col("html")).alias("note_text"))


@query(f"select page_id, {sql_pairs('html', [*strings.ENTITIES, (chr(13), '')])} as source from pages")
def entity_restore(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", strings.pretreat(F.col("html")).alias("source"))


_LINK = r'<a href="([^"]*)">([^<]*)</a>'


@query(
    f"""with f as (select page_id, unnest(list_zip(range(1000000)[:len(a)], a, b)) as z from (
      select page_id, regexp_extract_all(html, {lit(_LINK)}, 1) as a, regexp_extract_all(html, {lit(_LINK)}, 2) as b from pages))
    select page_id, z[1]::int as ordinal, z[2] as href, z[3] as title from f"""
)
def page_links(spark, sf_dir):
    each = lambda n: F.regexp_extract_all("html", F.lit(_LINK), F.lit(n))
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.arrays_zip(each(1).alias("href"), each(2).alias("title"))).alias("ordinal", "z"))
    return rows.select("page_id", "ordinal", F.col("z.href").alias("href"), F.col("z.title").alias("title"))


_TOP = "https?://[^/?#]+"


@query(
    f"""select page_id, href, case when starts_with(href, '/') then top || href else url || href end as target from (
      select page_id, url, regexp_extract(url, '{_TOP}') as top, unnest(regexp_extract_all(html, {lit(_LINK)}, 1)) as href from pages)"""
)
def href_to_url(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", _TOP, 0).alias("top"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("href"))
    return rows.select("page_id", "href", toc.episode_url(F.col("href"), F.col("top"), F.col("url")).alias("target"))


_SITE = rules.SiteRules({"name": "example", "domain": r"(?:[a-z]+\.)*example\.(?:com|org|net)", "top_url": "https://example.com", "url": r"https?://\\k<domain>/(?<ncode>[a-z]{2}/\d+)", "toc_url": r"\\k<top_url>/\\k<ncode>/"})


@query(
    r"""with p as (select page_id, lower(trim(url)) as u from pages), m as (
      select page_id, regexp_matches(u, 'https?://(?:[a-z]+\.)*example\.(?:com|org|net)/[a-z]{2}/\d+') as hit,
             regexp_extract(u, 'https?://(?:[a-z]+\.)*example\.(?:com|org|net)/([a-z]{2}/\d+)', 1) as c from p)
    select page_id, case when hit then 'example' end as site, case when hit then c end as code,
           case when hit then 'https://example.com/' || c || '/' end as toc_url from m"""
)
def site_resolve(spark, sf_dir):
    targets = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("target"))
    works = spark.createDataFrame([], "id long, toc_url string")
    return toc.resolve_targets(targets, works, [_SITE], default_site="none").select("page_id", "site", "code", "toc_url")


@query(
    """with c as (select c_custkey, c_custkey % 5 as k from customer), r as (
      select c_custkey, case when k in (0, 1) then '小説家になろう' when k = 4 or k = 3 and c_custkey in (select s_suppkey from supplier) then 'ノクターン・ムーンライト' end as site,
             case k when 0 then 'n' || c_custkey || 'ab' when 1 then 'n' || c_custkey || 'aa' when 3 then 'n' || c_custkey || 'z' when 4 then 'n' || c_custkey || 'b' end as code from c)
    select c_custkey, site, case when site is not null then code end as code,
      case site when '小説家になろう' then 'https://ncode.syosetu.com/' || code || '/' when 'ノクターン・ムーンライト' then 'https://novel18.syosetu.com/' || code || '/' end as toc_url from r"""
)
def target_resolution(spark, sf_dir):
    """Customers as targets: URLs of two sites and of none, codes, and numbers of works, which suppliers are."""
    key = F.col("c_custkey").cast("string")
    forms = [F.concat(F.lit(" https://ncode.syosetu.com/N"), key, F.lit("AB/5/ ")), F.concat(F.lit("N"), key, F.lit("aa")), F.concat(F.lit("https://elsewhere.example/n"), key, F.lit("a")), key, F.concat(F.lit("https://novel18.syosetu.com/n"), key, F.lit("b"))]
    target = rules.chain([(F.col("c_custkey") % 5 == i, form) for i, form in enumerate(forms)], F.lit(None).cast("string"))
    works = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("https://novel18.syosetu.com/N"), F.col("s_suppkey").cast("string"), F.lit("Z/")).alias("toc_url"))
    return toc.resolve_targets(table(spark, sf_dir, "customer").select("c_custkey", target.alias("target")), works, rules.builtin()).drop("target")


_ENTRY_SQL = """
with t as (select conv_id as work_id, turn, (turn + 1)::varchar as index, rtrim('T' || regexp_replace(text[1:12], '[^A-Za-z]', ' ', 'g')) as title from conversations),
entry as (select work_id, turn as ordinal, index, '/n1a/' || index || '/' as href, case when turn % 4 = 0 then '章' || index else '' end as chapter,
  title || ': 話' as subtitle, title || '： 話' as file_subtitle, '2024/01/02 10:00' as subdate, case when turn % 3 = 0 then '2024/02/01 09:00' else '' end as subupdate from t)
"""


def _contents_pages(spark, sf_dir):
    """Conversations as pages of contents, two turns a page; each but the last links to the next one."""
    number = (F.col("turn") + 1).cast("string")
    title = F.rtrim(F.concat(F.lit("T"), F.regexp_replace(F.substring("text", 1, 12), "[^A-Za-z]", " ")))
    chapter = F.when(F.col("turn") % 4 == 0, F.concat(F.lit('<div class="p-eplist__chapter-title">章'), number, F.lit("</div>\n"))).otherwise("")
    changed = F.when(F.col("turn") % 3 == 0, '<span title="2024/02/01 09:00 改稿">（<u>改</u>）</span>').otherwise("")
    episode = F.concat(chapter, F.lit('<div class="p-eplist__sublist">\n<a href="/n1a/'), number, F.lit('/" class="p-eplist__subtitle">\n'), title, F.lit(':\t 話\t </a>\n<div class="p-eplist__update">\n2024/01/02 10:00\n'), changed, F.lit("</div>\n</div>\n"))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("work_id"), F.col("turn"), F.floor(F.col("turn") / 2).alias("page_no"), episode.alias("e"))
    pages = turns.groupBy("work_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "e"))), lambda x: x.e), "").alias("e"))
    last = turns.groupBy("work_id").agg(F.max("page_no").alias("last"))
    link = F.when(F.col("page_no") < F.col("last"), '<a href="/n1a/?p=2" class="c-pager__item c-pager__item--next">').otherwise("")
    return pages.join(last, "work_id").select("work_id", "page_no", F.concat("e", link).alias("html"))


@query(_ENTRY_SQL + "select * from entry")
def contents_pages(spark, sf_dir):
    """Entries of pages of contents, one page after another."""
    return toc.contents(_contents_pages(spark, sf_dir), rules.builtin()[0]).withColumn("ordinal", F.col("ordinal").cast("int"))


_ADDRESS = "https://ncode.syosetu.com/n"


@query(
    _ENTRY_SQL.replace("with ", "with pages as (select conv_id, max(turn) // 2 as last from conversations group by 1), ", 1)
    + "select entry.* from entry where not (work_id % 5 = 0 and ordinal >= 4)"
)
def linked_contents(spark, sf_dir):
    """Pages without numbers, found by the links between them: of every fifth work the third page is missing, of every
    seventh the last page links back to the second; other last pages link to another work."""
    pages = _contents_pages(spark, sf_dir)
    last = pages.groupBy("work_id").agg(F.max("page_no").alias("last"))
    own = F.concat(F.lit("/n"), F.col("work_id").cast("string"), F.lit("a/"))
    page = lambda k: F.concat(F.lit("?p="), k.cast("string"))
    to = F.when(F.col("page_no") < F.col("last"), F.concat(own, page(F.col("page_no") + 2))).when((F.col("work_id") % 7 == 0) & (F.col("last") > 0), F.concat(own, page(F.lit(2)))).otherwise(F.concat(F.lit("/n"), (F.col("work_id") + 1).cast("string"), F.lit("a/?p=2")))
    link = F.concat(F.lit('<a href="'), to, F.lit('" class="c-pager__item c-pager__item--next">'))
    url = F.concat(F.lit("https://ncode.syosetu.com"), own, F.when(F.col("page_no") > 0, page(F.col("page_no") + 1)).otherwise(""))
    linked = pages.join(last, "work_id").where("not (work_id % 5 = 0 and page_no = 2)").select(url.alias("url"), F.concat(F.regexp_replace("html", "<a [^>]*c-pager[^>]*>", ""), link).alias("html"))
    works = last.select("work_id", F.concat(F.lit("https://ncode.syosetu.com"), own).alias("toc_url"))
    return toc.linked_contents(works, linked, rules.builtin()[0]).withColumn("ordinal", F.col("ordinal").cast("int"))


@query(
    r"""select conv_id, turn, role as speaker, regexp_extract(body, '(?s)' || role || ': *([a-z]+)', 1) as said,
      coalesce(nullif(regexp_extract(body, 'turn\[' || turn || '\]=(\w+)', 1), ''), 'none') as mark
    from (select conv_id, turn, role, 'by ' || role || ' in turn[' || turn || ']; x: no ' || role || ': ' || lower(text) || ' turn[' || (turn // 2 * 3) || ']=m' || turn as body from conversations)"""
)
def patterns_by_row(spark, sf_dir):
    """Rules that refer to what earlier rules found in the same text: a speaker's name, and a place with brackets in it."""
    site = rules.SiteRules({"who": r"by (?<speaker>\w+) in (?<place>turn\[\d+\])", "said": r"\\k<speaker>: *(?<said>[a-z]+)", "mark": [r"\\k<nothing>(?<mark>x)", r"\\k<place>=(?<mark>\w+)"]})
    number = F.col("turn").cast("string")
    text = F.concat(F.lit("by "), "role", F.lit(" in turn["), number, F.lit("]; x: no "), "role", F.lit(": "), F.lower("text"), F.lit(" turn["), (F.floor(F.col("turn") / 2) * 3).cast("string"), F.lit("]=m"), number)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", rules.multi_match(text, site, ["who", "said", "mark"]).alias("f"))
    return rows.select("conv_id", "turn", "f.speaker", F.coalesce("f.said", F.lit("")).alias("said"), F.coalesce("f.mark", F.lit("none")).alias("mark"))


@query(
    _ENTRY_SQL
    + """select work_id, case work_id % 4 when 0 then '題' when 1 then '短' else 'T' end as title, case when work_id % 4 < 2 then '著者' else '' end as author,
      case when work_id % 4 = 1 then 1 else count(*) end as subtitles, case when work_id % 4 = 1 then '短|None|None' else string_agg(subtitle || '|' || subdate || '|' || subupdate, ',' order by ordinal) end as shown
    from entry where work_id % 4 <> 3 group by work_id"""
)
def tables_of_contents(spark, sf_dir):
    """Works with an information page (series or short), works whose page of contents has the title, and works without one."""
    kind = F.col("work_id") % 4
    site = rules.SiteRules({**rules.builtin()[0].values, "title": ["<h1>(?<title>.+?)</h1>", "<h9>(?<title>.+?)</h9>"]})
    pages = _contents_pages(spark, sf_dir).withColumn("html", F.when(kind == 2, F.concat(F.lit("<h9>T</h9>"), F.col("html"))).otherwise(F.col("html")))
    empty = F.lit(None).cast("timestamp_ntz")
    info = F.struct(F.when(kind == 0, "題").otherwise("短").alias("title"), F.lit("著者").alias("writer"), F.lit("").alias("story"), F.lit(False).alias("end"), F.when(kind == 1, 2).otherwise(1).alias("novel_type"), empty.alias("general_firstup"), empty.alias("novelupdated_at"), empty.alias("general_lastup"))
    works = pages.select("work_id").distinct().select("work_id", F.lit("https://example.com/").alias("toc_url"), F.when(kind < 2, info).alias("info"))
    rows = toc.tables_of_contents(works, pages, site)
    shown = F.array_join(F.transform("subtitles", lambda x: F.concat_ws("|", x.subtitle, x.subdate, x.subupdate)), ",")
    return rows.select("work_id", "title", "author", F.size("subtitles").cast("long").alias("subtitles"), shown.alias("shown"))


@query(
    """select conv_id as work_id, case when conv_id % 3 = 0 then '不明' else 'w' || conv_id end as title, '不明' as author, '' as sitename,
      case when conv_id % 2 = 0 then 2 else 1 end as novel_type, count(*) as general_all_no, 100 * sum((turn % 2)::int)::int // count(*)::int as percent from conversations group by 1"""
)
def work_metadata(spark, sf_dir):
    """Rows of works out of tables of contents, with the percentage of odd turns as progress."""
    t = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("work_id")).agg(F.collect_list("turn").alias("subtitles"), F.sum(F.col("turn") % 2).alias("odd"))
    title = F.when(F.col("work_id") % 3 != 0, F.concat(F.lit("w"), F.col("work_id").cast("string")))
    t = t.select(F.col("work_id").cast("string").alias("toc_url"), title.alias("title"), F.lit("").alias("author"), F.lit(None).cast("string").alias("sitename"), F.when(F.col("work_id") % 2 == 0, 2).alias("novel_type"), "subtitles", "odd")
    share = t.select("toc_url", diff.progress(F.col("odd"), F.size("subtitles")).alias("percent"))
    rows = toc.metadata(t).join(share, "toc_url")
    return rows.select(F.col("toc_url").cast("long").alias("work_id"), "title", "author", "sitename", "novel_type", F.col("general_all_no").cast("long").alias("general_all_no"), "percent")


_INFO_PAGE = (
    '<h1 class="p-infotop-title">\n<a href="/x">題 &amp; {name}</a></h1><td class="p-infotop-data__value">{kind}</td> 全{parts}部<dt class="p-infotop-data__title">あらすじ</dt>\n'
    '<dd class="p-infotop-data__value">{story}<br>二</dd><dt class="p-infotop-data__title">作者名</dt><dd class="p-infotop-data__value"><a href="/u">著者</a></dd>'
    '<dt class="p-infotop-data__title">掲載日</dt><dd class="p-infotop-data__value">2024/01/02 03:04</dd><dt class="p-infotop-data__title">最終掲載日</dt><dd class="p-infotop-data__value">2024年01月02日 03時04分</dd>'
)


@query(
    """select c_custkey, case when k < 3 then '題 & ' || c_name else '' end as title, case when k < 3 then '著者' else '' end as writer, k = 0 as ended,
      case when k = 1 and c_custkey % 3 < 2 then 2 else 1 end as novel_type, case when k < 3 then c_mktsegment || chr(10) || '二' else '' end as story,
      case when k < 3 then timestamp '2024-01-02 03:04:00' end as first_up, null::timestamp as last_up from (select *, c_custkey % 4 as k from customer)"""
)
def info_pages(spark, sf_dir):
    """Information pages of complete works, short stories (which have at most one part), unfinished ones, and other pages."""
    k = F.col("c_custkey") % 4
    html_of = F.lit(_INFO_PAGE)
    values = {"kind": F.when(k == 0, "完結済").when(k == 1, "短編").otherwise("連載中"), "parts": (F.col("c_custkey") % 3).cast("string"), "name": F.col("c_name"), "story": F.col("c_mktsegment")}
    for name, value in values.items():
        html_of = F.replace(html_of, F.lit("{" + name + "}"), value)
    rows = table(spark, sf_dir, "customer").select("c_custkey", toc.info(F.when(k < 3, html_of).otherwise("nothing"), rules.builtin()[0]).alias("i"))
    return rows.select("c_custkey", "i.title", "i.writer", F.col("i.end").alias("ended"), "i.novel_type", "i.story", F.col("i.general_firstup").alias("first_up"), F.col("i.general_lastup").alias("last_up"))


@query("select o_orderkey, case when k < 2 then o_orderpriority end as title, case when k < 2 then k = 0 end as ended, case when k < 2 then o_custkey::int end as parts from (select *, o_orderkey % 5 as k from orders)")
def api_replies(spark, sf_dir):
    """Replies about orders: complete, unfinished, not JSON, too short, or with another count."""
    k = F.col("o_orderkey") % 5
    item = F.to_json(F.struct(F.col("o_orderpriority").alias("title"), k.alias("end"), F.col("o_custkey").alias("general_all_no")))
    reply = F.concat(F.lit('[{"allcount":'), F.when(k == 4, "0").otherwise("1"), F.lit("}"), F.when(k == 3, "").otherwise(F.concat(F.lit(","), item)), F.lit("]"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", toc.api_info(F.when(k == 2, "<html>").otherwise(reply)).alias("i"))
    return rows.select("o_orderkey", "i.title", F.col("i.end").alias("ended"), F.col("i.general_all_no").alias("parts"))


@query("select o_orderkey, case when k < 2 then '題: ' || o_clerk end as title, case when k < 2 then o_comment_ || chr(10) || '  deeper' || chr(10) || chr(10) || '# end' || chr(10) end as story, case when k < 2 then k = 0 end as ended, case when k < 2 then case when k = 0 then 2 else 1 end end as novel_type from (select *, o_orderkey % 5 as k, o_orderpriority as o_clerk, o_orderstatus || ': x' as o_comment_ from orders)")
def yaml_replies(spark, sf_dir):
    """The same in YAML, with quotes, a literal block and comments: complete, unfinished, broken, no sequence, another count."""
    k = F.col("o_orderkey") % 5
    head = F.concat(F.lit("---\n-\n  allcount: "), F.when(k == 4, "0").otherwise("1"), F.lit("  # of all\n-\n  title: "))
    title = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("'題: "), "o_orderpriority", F.lit("'"))).otherwise(F.concat(F.lit('"\\u984c: '), "o_orderpriority", F.lit('"')))
    story = F.concat(F.lit("\n  story: |\n    "), "o_orderstatus", F.lit(": x\n      deeper\n\n    # end\n  end: "), k.cast("string"))
    reply = F.concat(head, title, story, F.when(k == 0, "\n  noveltype: 2\n").otherwise("\n"), F.when(k == 2, "  'open\n").otherwise(""))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k == 3, "<html><body>none</body></html>").otherwise(reply).alias("reply"))
    found = rows.select("o_orderkey", toc.api_info(yaml_text.to_json(F.col("reply"))).alias("i"))
    return found.select("o_orderkey", "i.title", "i.story", F.col("i.end").alias("ended"), "i.novel_type")


@query("select conv_id as work_id, (turn + 1)::varchar as index, text[1:12] as subtitle, case when turn % 7 = 3 then null else text || chr(10) || role end as body, role as data_type from conversations")
def yaml_sections(spark, sf_dir):
    """Sections as YAML maps, read again."""
    s = table(spark, sf_dir, "conversations")
    body = F.when(F.col("turn") % 7 != 3, F.concat("text", F.lit("\n"), "role"))
    empty = F.lit(None).cast("string")
    sections = s.select(F.col("conv_id").alias("work_id"), (F.col("turn") + 1).cast("string").alias("index"), *[empty.alias(c) for c in ("href", "chapter", "file_subtitle", "subdate", "subupdate", "download_time")], F.substring("text", 1, 12).alias("subtitle"), F.struct(empty.alias("introduction"), body.alias("body"), empty.alias("postscript"), F.col("role").alias("data_type")).alias("element"))
    again = sections.select(F.from_json(yaml_text.to_json(store.section_yaml(sections)), store.SECTIONS).alias("s")).select("s.*")
    return again.select("work_id", "index", "subtitle", "element.body", "element.data_type")


@query(
    """select conv_id, turn, '前 & ' || chr(10) || role as introduction, '｜漢字《かんじ》' || chr(10) || rtrim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) as body,
      case when turn % 2 = 0 then role else '' end as postscript, 'text' as data_type from conversations"""
)
def episode_elements(spark, sf_dir):
    """Turns as pages of episodes, every second one with an afterword."""
    div = '<div class="js-novel-text p-novel__text{0}">'
    words = F.regexp_replace("text", "[^A-Za-z]+", " ")
    after = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(div.replace("{0}", " p-novel__text--afterword")), F.col("role"), F.lit("</div>"))).otherwise("")
    page = F.concat(F.lit(div.replace("{0}", " p-novel__text--preface") + "<p>前 &amp; </p>"), F.col("role"), F.lit("</div>" + div.replace("{0}", "") + "\n<p><ruby>漢字<rt>かんじ</rt></ruby></p><i>"), words, F.lit("</i> </div>"), after)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", toc.element(page, rules.builtin()[0]).alias("e")).select("conv_id", "turn", "e.*")


@query(
    f"""select page_id, case page_id % 5 when 0 then '一' || chr(10) || '｜漢字《かんじ》＊' when 1 then '［＃太字］' || page_id || '［＃太字終わり］［＃斜体］i［＃斜体終わり］［＃取消線］s［＃取消線終わり］≪x≫'
      when 2 then '［＃挿絵（' || regexp_extract(url, '^https?://[^?#]*/') || 'c.png）入る］' when 3 then '［＃挿絵（' || regexp_extract(url, '^{_TOP}') || '/d.png）入る］' else 'plain' end as note_text from pages"""
)
def annotated_fragments(spark, sf_dir):
    """Fragments under the addresses of pages: ruby, styles, images by relative and by absolute path, marks without a base."""
    k = F.col("page_id") % 5
    fragment = F.when(k == 0, "一\r\n<BR /><ruby><u>漢</u>字<rp>(</rp><rt>かんじ</rt><rp>)</rp></ruby>＊").when(k == 1, F.concat(F.lit("<b>"), F.col("page_id").cast("string"), F.lit("</b><I>i</I><s>s</s>《x》")))
    fragment = fragment.when(k == 2, '<img alt="" src="c.png" width="1">').when(k == 3, '<img alt="" src="/d.png">').otherwise("<ruby><u>plain</u></ruby>")
    return table(spark, sf_dir, "pages").select("page_id", html.annotated(fragment, F.col("url")).alias("note_text"))


@query(
    """select o_orderkey, case o_orderkey % 5 when 0 then d + interval 10 hour + interval 20 minute + interval 30 second
      when 1 then d + interval 10 hour + interval 20 minute when 2 then d end as parsed
    from (select o_orderkey, date_trunc('day', o_orderdate)::timestamp as d from orders)"""
)
def date_parse(spark, sf_dir):
    """Order dates in the forms that pages show; two of these aren't dates."""
    k, day = F.col("o_orderkey") % 5, lambda form: F.date_format("o_orderdate", form)
    text = F.when(k == 0, F.concat(day("yyyy/M/d"), F.lit(" 10:20:30"))).when(k == 1, F.concat(day("yyyy/MM/dd"), F.lit(" 10:20（改）"))).when(k == 2, F.concat(F.lit(" "), day("yyyy/M/d"), F.lit(" ")))
    text = text.when(k == 3, day("yyyy年M月d日")).otherwise(F.concat(day("yyyy"), F.lit("/2/30")))
    return table(spark, sf_dir, "orders").select("o_orderkey", strings.parse_date(text).alias("parsed"))


# -- catalogue --------------------------------------------------------------------------------------------------------


@query("select doc_id, source from documents where translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '%ing_the%' or source like '%c1%'")
def catalog_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("shelf", F.when(F.col("source").contains("c1"), "sing them"))
    return catalog.search(docs, "InG_the", ("text", "shelf")).select("doc_id", "source")


@query("select row_number() over (order by o_orderdate desc nulls last, o_orderkey) as place, o_orderkey, o_orderdate from orders order by o_orderdate desc nulls last, o_orderkey limit 100")
def catalog_list(spark, sf_dir):
    """The newest hundred by a whitelisted column; the place is that in the listing."""
    top = catalog.listing(table(spark, sf_dir, "orders").orderBy("o_orderkey"), "o_orderdate", ("o_orderdate", "o_totalprice"))
    top = top.orderBy(F.col("o_orderdate").desc_nulls_last(), "o_orderkey").limit(100)
    by = Window.orderBy(F.col("o_orderdate").desc_nulls_last(), "o_orderkey")  # a hundred rows
    return top.select(F.row_number().over(by).cast("long").alias("place"), "o_orderkey", "o_orderdate")


@query("select row_number() over (order by o_orderdate desc nulls last, o_orderkey) as place, o_orderkey, o_orderdate from orders")
def catalog_list_all(spark, sf_dir):
    """The whole listing that catalog_list has the first hundred of."""
    works = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return catalog.placed(works, [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").asc()])


@query("select row_number() over (order by lower(p_name), p_partkey) as place, p_partkey, p_name from part")
def catalog_list_folded(spark, sf_dir):
    """The whole listing by name, upper and lower case being the same."""
    works = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("shown"), "p_name")
    return catalog.placed(works, [catalog.folded(works, "shown"), F.col("p_partkey").asc()]).select("place", "p_partkey", "p_name")


@query("select c_custkey, c_name, c_acctbal from customer where c_custkey = 7")
def catalog_get(spark, sf_dir):
    return catalog.get(table(spark, sf_dir, "customer"), 7, "c_custkey").select("c_custkey", "c_name", "c_acctbal")


@query("select c_custkey, c_name from customer where c_nationkey % 3 <> 0")
def catalog_delete(spark, sf_dir):
    works = table(spark, sf_dir, "customer")
    return catalog.delete(works, works.where("c_nationkey % 3 = 0"), "c_custkey").select("c_custkey", "c_name")


@query("select c_custkey, case when c_custkey % 5 = 0 then c_acctbal + 1 else c_acctbal end as c_acctbal from customer")
def catalog_update(spark, sf_dir):
    works = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    changed = works.where("c_custkey % 5 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    stray = changed.withColumn("c_custkey", -F.col("c_custkey") - 1)
    return catalog.update(works, changed.unionByName(stray), "c_custkey")


@query(
    """select c_custkey, case when c_custkey % 5 = 0 then 'new' else c_mktsegment end as c_mktsegment from customer
    union all select -c_custkey - 1, 'new' from customer where c_custkey % 5 = 0"""
)
def catalog_upsert(spark, sf_dir):
    works = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    changed = works.where("c_custkey % 5 = 0").withColumn("c_mktsegment", F.lit("new"))
    return catalog.upsert(works, changed.unionByName(changed.withColumn("c_custkey", -F.col("c_custkey") - 1)), "c_custkey")


@query(
    """select s_suppkey, s_name from supplier union all
    select (select max(s_suppkey) from supplier) + row_number() over (order by n_name), n_name from nation"""
)
def catalog_insert(spark, sf_dir):
    works = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    new = table(spark, sf_dir, "nation").select(F.lit(None).cast("long").alias("s_suppkey"), F.col("n_name").alias("s_name"))
    return catalog.insert(works, new, "s_suppkey", "s_name")


@query("select o_orderkey, count(*) as lines from lineitem join orders on l_orderkey = o_orderkey where o_custkey % 4 <> 0 group by 1")
def cascade_delete(spark, sf_dir):
    """Orders of some customers go, and their lines with them; lines left of each order."""
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    gone = orders.where("o_custkey % 4 = 0")
    kept, rest = catalog.delete_cascade(orders, lines, gone, "o_orderkey", "l_orderkey")
    return kept.select("o_orderkey").join(rest.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines")), "o_orderkey")


@query("select p_partkey, array_to_string(string_split(p_type, ' '), ',') as stored, len(string_split(p_type, ' '))::int as tags, false as empty_is_one from part")
def tags_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("stored", catalog.encode_tags(F.split("p_type", " ")))
    return rows.select("p_partkey", "stored", F.size(catalog.decode_tags(F.col("stored"))).alias("tags"), (F.size(catalog.decode_tags(F.lit(""))) > 0).alias("empty_is_one"))


@query("select o_orderkey, case when o_orderstatus = 'F' then '完結' else '連載中' end as status, case when o_orderstatus = 'F' then '#428bca' else '#5cb85c' end as colour from orders")
def display_status(spark, sf_dir):
    works = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("").alias("title"), F.lit("").alias("author"), F.lit("").alias("sitename"), F.lit(0).alias("general_all_no"), (F.col("o_orderstatus") == "F").alias("is_end"), F.lit(None).cast("timestamp_ntz").alias("last_update"))
    return catalog.display(works).select(F.col("id").alias("o_orderkey"), "status", "colour")


@query(
    """with t as (select n_regionkey, list(n_name order by n_nationkey) as names from nation group by 1)
    select n_regionkey, array_to_string(list_transform(names[:3], lambda x: '  - ' || x), chr(10)) ||
      case when len(names) > 3 then chr(10) || '  ... 他' || (len(names) - 3) || '件' else '' end as preview from t"""
)
def titles_preview(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    return rows.select("n_regionkey", catalog.preview(F.transform("r", lambda x: x.n_name), 3).alias("preview"))


# -- snapshots --------------------------------------------------------------------------------------------------------

_SNAPSHOTS_SQL = """
with snap as (select o_custkey as work_id, o_orderkey as k, o_orderkey::varchar as index, o_orderpriority as subtitle, o_orderstatus as chapter,
       strftime(o_orderdate, '%Y-%m-%d') as subdate from orders),
old as (select work_id, index, case when k % 7 = 0 then 'was ' || subtitle else subtitle end as subtitle,
       case when k % 5 = 0 then 'X' else chapter end as chapter,
       case when k % 3 = 0 then '1990-01-01' else subdate end as subdate from snap where k % 11 <> 0 and work_id % 13 <> 0),
judged as (select n.work_id, n.index, case when o.index is null then 'new' when n.subtitle <> o.subtitle then 'title'
       when n.chapter <> o.chapter then 'chapter' when n.subdate > o.subdate then 'date' end as reason
       from snap n left join old o on n.work_id = o.work_id and n.index = o.index)
"""


def _snapshots(spark, sf_dir):
    k = F.col("o_orderkey")
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("work_id"), k.cast("string").alias("index"), k.alias("ordinal"), F.col("o_orderpriority").alias("subtitle"), F.col("o_orderstatus").alias("chapter"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("subdate"), F.lit("").alias("subupdate"))
    n = F.col("ordinal")
    old = new.where((n % 11 != 0) & (F.col("work_id") % 13 != 0)).withColumns(
        {
            "subtitle": F.when(n % 7 == 0, F.concat(F.lit("was "), F.col("subtitle"))).otherwise(F.col("subtitle")),
            "chapter": F.when(n % 5 == 0, "X").otherwise(F.col("chapter")),
            "subdate": F.when(n % 3 == 0, "1990-01-01").otherwise(F.col("subdate")),
        }
    )
    return new, old


@query(_SNAPSHOTS_SQL + "select work_id, index, reason from judged where reason is not null")
def snapshot_diff(spark, sf_dir):
    return diff.snapshot_diff(*_snapshots(spark, sf_dir)).select("work_id", "index", "reason")


@query(
    _SNAPSHOTS_SQL
    + """select work_id, count(*) as episodes, count(reason) as changed, work_id not in (select work_id from old) as is_new,
      work_id not in (select work_id from old) or count(reason) > 0 as new_arrivals,
      case when work_id not in (select work_id from old) or count(reason) > 0 then 'ok' else 'none' end as status from judged group by work_id"""
)
def run_status(spark, sf_dir):
    new, old = _snapshots(spark, sf_dir)
    return diff.run_status(diff.snapshot_diff(new, old, changed_only=False), old)


@query(_SNAPSHOTS_SQL + "select count(*) as works, sum(n)::bigint as episodes, sum((n > 20)::int)::bigint as long_works from (select work_id, count(*) as n from snap group by 1)")
def work_counts(spark, sf_dir):
    each = _snapshots(spark, sf_dir)[0].groupBy("work_id").agg(F.count("*").alias("n"))
    return each.agg(F.count("*").alias("works"), F.sum("n").alias("episodes"), F.sum((F.col("n") > 20).cast("long")).alias("long_works"))


# -- sections and packages ----------------------------------------------------------------------------------------------


def _sections(spark, sf_dir):
    """Conversations as works: turns are sections, a system turn or the first of four names a chapter."""
    t = table(spark, sf_dir, "conversations")
    chapter = F.when(F.col("role") == "system", "序 & 章").when(F.col("turn") % 4 == 1, F.concat(F.lit("第"), F.col("turn").cast("string"), F.lit("章"))).otherwise("")
    return t.select(F.col("conv_id").alias("work_id"), (F.col("turn") + 1).alias("idx"), F.substring("text", 1, 12).alias("title"), chapter.alias("chapter"), F.col("text").alias("body"), "role")


_SECTIONS_SQL = """
with sec as (select conv_id as work_id, turn + 1 as idx, text[1:12] as title, role, text as body,
  case when role = 'system' then '序 & 章' when turn % 4 = 1 then '第' || turn || '章' else '' end as chapter from conversations),
filled as (select *, last_value(nullif(chapter, '') ignore nulls) over (partition by work_id order by idx rows between unbounded preceding and current row) as in_chapter from sec),
lined as (select *, coalesce(in_chapter <> lag(in_chapter) over w or (in_chapter is not null and lag(in_chapter) over w is null), false) as starts,
  lag(in_chapter) over w is not null as was_in, 'section_' || lpad(idx::varchar, 4, '0') as name, row_number() over w as place from filled window w as (partition by work_id order by idx))
"""
_ESCAPED = sql_pairs("title", strings.XML)


@query(_SECTIONS_SQL + "select work_id, idx, in_chapter, starts from lined")
def chapter_fill(spark, sf_dir):
    return assemble.chapters(_sections(spark, sf_dir)).select("work_id", "idx", "in_chapter", "starts")


@query(
    """select conv_id, concat_ws(chr(10), nullif(string_agg(text, chr(10) order by turn) filter (where role = 'system'), ''),
      nullif(string_agg(text, chr(10) order by turn) filter (where role = 'user'), ''), nullif(string_agg(text, chr(10) order by turn) filter (where role = 'assistant'), '')) as text
    from conversations group by 1"""
)
def section_assembly(spark, sf_dir):
    said = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(said.alias("t"))
    part = lambda role: F.array_join(F.transform(F.filter("t", lambda x: x.role == role), lambda x: x.text), "\n")
    return rows.select("conv_id", assemble.joined_element(part("system"), part("user"), part("assistant")).alias("text"))


@query(
    _SECTIONS_SQL
    + f"""select work_id, string_agg(case when starts and was_in then '      </ol>' || chr(10) || '      </li>' || chr(10) else '' end ||
      case when starts then '      <li><span>' || {sql_pairs("in_chapter", strings.XML)} || '</span>' || chr(10) || '      <ol>' || chr(10) else '' end ||
      case when in_chapter is not null then '        ' else '      ' end || '<li><a href="Text/' || name || '.xhtml">' || {_ESCAPED} || '</a></li>' || chr(10), '' order by idx)
      || case when last(in_chapter order by idx) is not null then '      </ol>' || chr(10) || '      </li>' || chr(10) else '' end as toc,
      string_agg('    <navPoint id="navPoint-' || place || '" playOrder="' || place || '">' || chr(10) || '      <navLabel><text>' || {_ESCAPED} ||
        '</text></navLabel>' || chr(10) || '      <content src="Text/' || name || '.xhtml"/>' || chr(10) || '    </navPoint>' || chr(10), '' order by idx) as points,
      string_agg(chr(10) || '    <itemref idref="' || name || '"/>', '' order by idx) as refs from lined group by 1"""
)
def toc_build(spark, sf_dir):
    return assemble.outlines(_sections(spark, sf_dir)).select("work_id", "toc", "points", "refs")


@query(
    _SECTIONS_SQL
    + "select work_id, 'OEBPS/Text/' || name || '.xhtml' as path, "
    + lit(assemble.SECTION).replace("{title}", f"' || {_ESCAPED} || '").replace("{body}", "' || body || '")
    + " as content from lined"
)
def section_pages(spark, sf_dir):
    return assemble.section_pages(_sections(spark, sf_dir))


@query(
    _SECTIONS_SQL
    + f"""select work_id, 'OEBPS/toc.ncx' as path, {lit(assemble.NCX).replace("{title}", "作品 ' || work_id || '").replace("{book_id}", "' || work_id || '").replace("{points}", "' || points || '")} as content from (
      select work_id, string_agg('    <navPoint id="navPoint-' || place || '" playOrder="' || place || '">' || chr(10) || '      <navLabel><text>' || {_ESCAPED} ||
        '</text></navLabel>' || chr(10) || '      <content src="Text/' || name || '.xhtml"/>' || chr(10) || '    </navPoint>' || chr(10), '' order by idx) as points from lined group by 1)"""
)
def package_ncx(spark, sf_dir):
    return _package(spark, sf_dir).where("path = 'OEBPS/toc.ncx'")


def _works(sections):
    name = F.concat(F.lit("作品 "), F.col("work_id").cast("string"))
    return sections.select("work_id").distinct().select("work_id", name.alias("title"), F.lit("著者").alias("author"), F.lit("例").alias("sitename"), F.col("work_id").cast("string").alias("book_id"), F.lit("2024-01-01T00:00:00Z").alias("modified"))


def _package(spark, sf_dir):
    sections = _sections(spark, sf_dir)
    return assemble.package_files(_works(sections), sections)


def sql_fill(template: str, **values: str) -> str:
    """The template with its {names} replaced by SQL expressions."""
    out = lit(template)
    for name, value in values.items():
        out = out.replace("{" + name + "}", f"' || {value} || '")
    return out


_ITEMS = sql_sub("refs", ('<itemref idref="([^"]+)"/>', '<item id="\\1" href="Text/\\1.xhtml" media-type="application/xhtml+xml"/>'))
_FILES = {
    "mimetype": lit(assemble.MIMETYPE),
    "META-INF/container.xml": lit(assemble.CONTAINER),
    "OEBPS/content.opf": sql_fill(assemble.OPF, book_id="work_id", title="title", author="'著者'", modified="'2024-01-01T00:00:00Z'", items=_ITEMS, refs="refs"),
    "OEBPS/toc.xhtml": sql_fill(assemble.CONTENTS, items="toc"),
    "OEBPS/toc.ncx": sql_fill(assemble.NCX, book_id="work_id", title="title", points="points"),
    "OEBPS/Text/cover.xhtml": sql_fill(assemble.COVER, title="title", author="'著者'", start="'350'", lines="'      <tspan x=\"300\" dy=\"0\">' || title || '</tspan>' || chr(10)"),
    "OEBPS/Text/titlepage.xhtml": sql_fill(assemble.TITLE_PAGE, title="title", author="'著者'", source="chr(10) || '  <p class=\"source\">例</p>'"),
}


@query(f"with o as (select *, '作品 ' || work_id as title from ({SQL['toc_build']})) " + " union all ".join(f"select work_id, {lit(p)} as path, {c} as content from o" for p, c in _FILES.items()))
def package_files(spark, sf_dir):
    return _package(spark, sf_dir)


@query("select conv_id, turn, 'raw/' || turn || ' ' || role || '.html' as path, turn % 3 <> 0 as fine from conversations")
def raw_paths(spark, sf_dir):
    path = store.raw_name(F.col("turn").cast("string"), F.col("role"))
    tried = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("a/../../"), path)).otherwise(path)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", path.alias("path"), store.inside(tried).alias("fine"))


@query(
    """select o_orderkey, case k when 1 then 'image/jpeg' else 'image/png' end as media_type, case k when 0 then 'png' when 1 then 'jpg' end as extension
    from (select o_orderkey, o_orderkey % 3 as k from orders)"""
)
def media_types(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    name = F.concat(F.col("o_orderkey").cast("string"), F.when(k == 0, ".PNG").when(k == 1, ".x.jpg").otherwise(""))
    mime = F.when(k == 0, "image/png; q=1").when(k == 1, "image/jpeg").otherwise("text/html")
    return table(spark, sf_dir, "orders").select("o_orderkey", strings.media_type(name).alias("media_type"), strings.extension(mime).alias("extension"))


# -- scalar functions -----------------------------------------------------------------------------------------------------

add_stage("xml_escape", strings.xml_escape, sql_pairs("t", strings.XML))
add_stage("html_escape", strings.html_escape, sql_pairs("t", strings.HTML))
add_stage("safe_filename", strings.safe_filename, f"translate(t, {lit(strings.FILENAME_FROM)} || chr(9) || chr(10), {lit(strings.FILENAME_TO)})")
add_stage("wrap_text", lambda t: F.array_join(strings.wrap(t, 10), "|"), "array_to_string(list_transform(range(0, ((length(t) + 9) // 10)::bigint), lambda i: t[i * 10 + 1 : i * 10 + 10]), '|')")
add_stage("illustration_notes", lambda t: F.concat_ws("|", strings.split_illustrations(t).text, strings.split_illustrations(t).notes), f"array_to_string(list_prepend({sql_sub('t', ('(?-s)［＃挿絵（.+?）入る］', ''))}, regexp_extract_all(t, '(?-s)［＃挿絵（.+?）入る］')), '|')", ANNOTATED)

# -- stages ---------------------------------------------------------------------------------------------------------------

n = normalize
_MARKED = [(k + "゛", v) for k, v in zip(n.VOICED_FROM, n.VOICED_TO)] + [(k + "゜", v) for k, v in zip(n.HALF_VOICED_FROM, n.HALF_VOICED_TO)] + [("—", "―")]
_K, _W, _D = n.KANJI_DIGITS, n.WIDE_DIGITS, n.DIGITS
_LATIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_WIDE_LATIN = "".join(chr(ord(c) + 0xFEE0) for c in _LATIN)
add_stage("stage_kana", n.full_kana, sql_pairs(f"translate(t, {lit(n.HALF_KANA)}, {lit(n.FULL_KANA)})", _MARKED))
_UNBROKEN = sql_sub("x[2]", ("\n[　 \t]*", ""))
_JOIN = sql_rewrite("t", "「[^「」]*(?:「[^「」]*」[^「」]*)*」", _UNBROKEN)
add_stage("stage_join_brackets", n.join_in_brackets, f"(select {sql_rewrite('j', '『[^『』]*(?:『[^『』]*』[^『』]*)*』', _UNBROKEN)} from (select {_JOIN} as j))")
add_stage("stage_join_lines", n.join_lines, sql_sub("t", (r"([^、])、\n　([^「『(（【<＜〈《≪…‥―])", r"\1、\2")))
add_stage("stage_comments", n.drop_comments, sql_sub("t", (r"(?ms)^={10,}\n.*?\n={10,}$", "")))
add_stage("stage_site_tags", n.site_tags, sql_sub("t", ("(?i-s)<b>(.+?)</b>", r"［＃ゴシック体］\1［＃ゴシック体終わり］"), ("(?m)^-{5,}$", "［＃区切り線］")))
_ROMAN = "case x[2] " + " ".join(f"when {lit(a)} then {lit(b)}" for a, b in n.ROMAN.items()) + " else x[2] end"
add_stage("stage_roman", n.roman_numerals, sql_rewrite("t", rf"[{n.WORD}]+", _ROMAN))
add_stage("stage_latin", n.wide_latin, f"translate(t, {lit(_LATIN)}, {lit(_WIDE_LATIN)})")
_QUOTED = sql_sub("t", (r"'([^'\"\n]+)'", r"〝\1〟"), ("[\"〝〟]([^\"\\n]+)[\"〝〟]", r"〝\1〟"))
add_stage("stage_symbols", n.wide_symbols, f"translate({_QUOTED}, {lit(n.SYMBOLS_FROM + '《》')}, {lit(n.SYMBOLS_TO + '≪≫')})")
add_stage("stage_decimal", n.decimal_points, sql_sub("t", (rf"([\p{{Nd}}{_K}]+?)[.．]([\p{{Nd}}{_K}]+?)", r"\1・\2")))
add_stage("stage_kanji_digits", n.kanji_digits, f"translate(t, {lit(_D + _W)}, {lit(_K + _K)})")
add_stage("stage_wide_numbers", n.wide_numbers, sql_rewrite("t", r"\p{Nd}+", f"case when length(x[2]) = 2 then '［＃縦中横］' || x[2] || '［＃縦中横終わり］' else translate(x[2], {lit(_D)}, {lit(_W)}) end"))
_LETTERED = sql_rewrite("t", f"[Ａ-Ｚａ-ｚ][{_K}・～]+", f"translate(x[2], {lit(_K)}, {lit(_W)})")
add_stage("stage_reconvert", n.digits_by_letters, f"(select {sql_rewrite('j', f'[{_K}・～]+[Ａ-Ｚａ-ｚ{n.UNIT_SIGNS}]', f'translate(x[2], {lit(_K)}, {lit(_W)})')} from (select {_LETTERED} as j))")


def _units_sql() -> str:
    number = f"ltrim(translate(x[2], {lit(_K)}, '{_D}'), '0')"
    padded = f"lpad({number}, 20, '0')"
    groups = []
    for unit in range(4, 0, -1):
        at = 17 - 4 * unit
        shown = []
        for place in range(3, -1, -1):
            d = f"{padded}[{at + 3 - place}]"
            one = f"'{n.PLACES[place]}'" if place else "'一'"
            shown.append(f"case {d} when '0' then '' when '1' then {one} else translate({d}, '{_D}', '{_K}') || '{n.PLACES[place]}' end")
        groups.append(f"case when {padded}[{at}:{at + 3}] = '0000' then '' else {' || '.join(shown)} || '{n.UNITS[unit]}' end")
    low = f"translate(ltrim({padded}[17:20], '0'), '{_D}', '{_K}')"
    few = f"length(x[2]) - length(replace(x[2], '〇', '')) < 3 or {number} = '' or length({number}) > 20"
    return sql_rewrite("t", f"[{_K}]+", f"case when {few} then x[2] else {' || '.join(groups)} || {low} end")


add_stage("stage_kanji_units", lambda t: n.kanji_units(t, 3), _units_sql())
add_stage("stage_mark_space", n.space_after_marks, sql_sub("t", (r"([!?！？]+)([^!?！？ 」］\]』】〉》〕＞>≫)）\"'〟　☆★♪［―])", r"\1　\2"), ("([!?！？]+) ", r"\1　")))
add_stage("stage_ellipses", n.ellipses, sql_pairs(sql_rewrite("t", "・{3,}", "repeat('…', ((length(x[2]) + 2) // 3)::bigint)"), [("。。。", "…"), ("．．．", "…"), ("──", "――")]))
add_stage("stage_fractions", n.fractions, sql_sub("t", (f"([{_K}０-９]+)／([{_K}０-９]+)", r"\2分の\1")))
_PLAIN_DAY = f"translate(x[2], {lit(_W + '／')}, '{_D}/')"
add_stage("stage_dates", n.dates, sql_rewrite("t", r"20\p{Nd}{2}／\p{Nd}{1,2}／\p{Nd}{1,2}", f"coalesce(strftime(try_strptime({_PLAIN_DAY}, '%Y/%m/%d'), '%Y年%m月%d日'), x[2])"))
add_stage("stage_mark_font", n.mark_font, sql_sub("t", ("([ぁ-ん])゛", r"［＃濁点］\1［＃濁点終わり］"), ("([ァ-ン])゛", r"［＃濁点］\1［＃濁点終わり］")))
_BAR = chr(0xE029)


def _ruby_sql(expr: str, opened: str, reading: str, closed: str) -> str:
    span, chars = f"(?-s)(.+?){opened}({reading}){closed}", "一-龠Ａ-Ｚａ-ｚA-Za-z"
    base, read = (f"regexp_extract(x[2], {lit(span)}, {i})" for i in (1, 2))
    kept = f"{base}[:-2] || case when contains(x[2], '（') then '（' || {read} || '）' else '≪' || {read} || '≫' end"
    return sql_rewrite(expr, span, f"case when ends_with({base}, '｜') then {kept} when regexp_matches({base}, '[{chars}]$') then regexp_replace({base}, '([{chars}]+)$', '{_BAR}\\1') || '《' || {read} || '》' else x[2] end")


_READ_SQL = f"(select {_ruby_sql('j', '（', '[ぁ-んァ-ヶーゝゞ・Ａ-Ｚａ-ｚA-Za-z 　]{1,20}', '）')} from (select {_ruby_sql('t', '≪', '[^≪]+?', '≫')} as j))"
#: Readings behind others, with and without bars, several a line, and brackets that are none.
_READINGS = "\n山（x） 川｜≪かわ≫ 谷≪たに≫｜≪まま≫ 森（もり）林≪はやし≫（x）｜≪y z≫\n｜≪a≫（b）≪≪c≫\n≪d≫e≪f\ng≫ 空（そら≪h≫\n海｜（うみ）湖｜≪みずうみ≫（い）｜（ろ）\n(x）（） 石（いしいしいしいしいしいしいしいしいしいしいし）"
add_stage("stage_readings", n.readings, sql_sub(_READ_SQL, (f"[{_BAR}｜]", "※［＃縦線］")), SAMPLE + _READINGS)
add_stage("stage_indent", n.indent, sql_sub("t", ("(?m)^[ 　\\t]*(――)", r"　\1"), ("(?m)^([^　 \\t「『(（【〈《≪〝―…‥※［＃])", r"　\1")))
add_stage("stage_half_indent", n.half_indent, sql_sub("t", ("(?m)^[ 　\\t]*([〔「『(（【〈《≪〝])", r"［＃二分アキ］\1")))
add_stage("stage_pack_blank", n.pack_blank_lines, sql_sub("t", ("\\n{4,}", "\n\n\n")))
add_stage("stage_page_break", n.page_breaks, sql_sub("t", ("\\n{10,}", "\n［＃改ページ］\n")))
_RULES = [(r"(\w+)ing\b", r"<\1>"), ("[broken", "x"), (r"(?P<t>th)(?P<r_2>e)(?!\w)", r"\g<r_2>$\g<t>"), ("(?i)ÉE", r"\1"), (r"\d{2,}", r"#\g<0>"), ("é+$", "E")]
#: The same, word by word; what names a group that isn't there stays literal, and the last rule sees the sample's end alone.
_ING = sql_rewrite("t", r"[\p{L}\p{N}_]+", "case when ends_with(x[2], 'ing') and length(x[2]) > 3 then '<' || x[2][:-4] || '>' else x[2] end")
_THE = sql_rewrite("j", r"[\p{L}\p{N}_]+", "case when ends_with(x[2], 'the') then x[2][:-4] || 'e$th' else x[2] end")
_RULES_SQL = sql_sub(sql_pairs(f"(select {_THE} from (select replace({_ING}, '[broken', 'x') as j))", [("(?i)ÉE", r"\1")]), (r"\p{Nd}{2,}", r"#\0"), ("é+$", "E"))
add_stage("user_rules", lambda t: n.user_rules(t, _RULES), _RULES_SQL, "\nübing singing the théé [broken ４２ 7 (?i)ÉE ing aing\nééé")


def _kept(pattern: str, kind: str, change, shown=None):
    """change, while the matches of the pattern are hidden."""
    return lambda t: restore(change(hide(t, pattern, kind)), kind, F.transform(stash(t, pattern), shown) if shown else stash(t, pattern))


def sql_kept(pattern: str, change: str) -> str:
    """What lies between the matches, x[1], as `change` says."""
    return f"array_to_string(list_transform(list_zip(string_split_regex(t, {lit(pattern)}), regexp_extract_all(t, {lit(pattern)})), lambda x: coalesce({change}, '') || coalesce(x[2], '')), '')"


_NOTE, _WIDE = "(?-s)［＃挿絵（.+?）入る］", f"translate(x[1], {lit(_LATIN)}, {lit(_WIDE_LATIN)})"
_RUN = rf"[{n.WORD}.,!?'\" &:;\-]+"
_SENTENCE = f"contains(x[2], ' ') or length(x[2]) >= {n.SENTENCE_LENGTH} and regexp_matches(x[2], '\\p{{Ll}}')"
_HEADING_SQL = n.HEADING.replace("(?md)^[ 　\\t]*(?:", "(?m)^[ 　\\t]*((?:").removesuffix("$") + ")$"
add_stage("stage_illustrations", _kept(n.ILLUSTRATION, "挿絵", n.wide_latin), sql_kept(_NOTE, _WIDE), SPANS)
add_stage("stage_urls", _kept(n.URL, "ＵＲＬ", n.wide_latin), sql_kept(n.URL, _WIDE), SPANS)
add_stage("stage_sentences", _kept(n.SENTENCE, "英文", n.wide_latin), sql_rewrite("t", _RUN, f"case when {_SENTENCE} then x[2] else translate(x[2], {lit(_LATIN)}, {lit(_WIDE_LATIN)}) end"), SPANS)
add_stage("stage_headings", _kept(n.HEADING, "章見出し", lambda t: t, n.heading), sql_sub("t", (_HEADING_SQL, r"　　　［＃ゴシック体］\1［＃ゴシック体終わり］")), SPANS)
add_stage("ampersands", strings.ampersands, sql_pairs(sql_sub("t", ("(?i)&amp;", chr(0xE100)), ("&", "&amp;")), [(chr(0xE100), "&amp;")]), ANNOTATED + " &AMP; &lt; &amp;amp;".lower())
_stash_roundtrip = _kept(n.KANJI_RUN, "漢数字", lambda t: t)


add_stage("stash_roundtrip", _stash_roundtrip, "t")


def _inline_sql(e: str) -> str:
    for name, a, b in markup.SPANS:
        k = chr(0xE100 + len(name)) + name
        e = sql_sub(e, (f"(?-s)［＃{name}］(.+?)［＃{name}終わり］", f"{k}1\\1{k}2"))
    e = sql_sub(e, ("(?-s)［＃「(.+?)」に傍点］", f"{chr(0xE101)}S1\\1{chr(0xE101)}S2"))
    e = sql_pairs(sql_pairs(e, [("※［＃縦線］", chr(0xE102))]), strings.HTML)
    for name, a, b in markup.SPANS:
        k = chr(0xE100 + len(name)) + name
        e = sql_pairs(e, [(f"{k}1", a), (f"{k}2", b)])
    e = sql_pairs(e, [(f"{chr(0xE101)}S1", markup.SESAME[0]), (f"{chr(0xE101)}S2", markup.SESAME[1]), (chr(0xE102), "｜")])
    ruby = r"<ruby>\1<rt>\2</rt></ruby>"
    return sql_sub(e, ("(?-s)｜(.+?)《(.+?)》", ruby), (r"(?-s)([\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{4EDD}\x{3005}\x{3006}\x{3007}\x{30F6}]+)《(.+?)》", ruby), ("(?-s)［＃(.+?)］", '<span class="note" hidden="">[\\1]</span>'))


def _line_sql() -> str:
    bare = r"regexp_replace(l, '^[\s　]+|[\s　]+$', '', 'g')"
    src = r"regexp_extract(l, '^[\s　]*［＃挿絵（(.+?)）入る］\s*$', 1)"
    rest = f"replace(l, {lit(markup.PAGE_BREAK)}, '')"
    cases = [(f"{bare} = {lit(k)}", lit(v)) for k, v in markup.BLOCKS.items()]
    cases += [
        (f"{src} <> ''", f"""'<div class="illustration"><img src="' || case when starts_with({src}, 'http') then '' else '../Images/' end || {sql_pairs(src, strings.HTML)} || '" alt="挿絵"/></div>'"""),
        (f"contains(l, {lit(markup.PAGE_BREAK)})", f"""case when regexp_replace({rest}, '[\\s　]+', '', 'g') = '' then '' else '<p>' || {_inline_sql(rest)} || '</p>' || chr(10) end || '<hr class="pagebreak"/>'"""),
        (f"{bare} = {lit(markup.SEPARATOR)}", """'<hr class="separator"/>'"""),
        (f"{bare} = ''", "'<p><br/></p>'"),
        (f"starts_with(l, {lit(markup.HALF)}) and length(l) > {len(markup.HALF)}", f"""'<p class="hang-indent">' || {_inline_sql(f"l[{len(markup.HALF) + 1}:]")} || '</p>'"""),
    ]
    return "case " + " ".join(f"when {a} then {b}" for a, b in cases) + f" else '<p>' || {_inline_sql('l')} || '</p>' end"


add_stage("line_parse", markup.xhtml, f"array_to_string(list_transform(string_split(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda l: {_line_sql()}), chr(10))", ANNOTATED)
add_stage("line_pictures", lambda t: F.array_join(F.transform(markup.pictures(t), lambda p: p.filename), ","), "'a.png'", ANNOTATED)


#: Settings of works by the rest of their number by 4, as the files of a work hold them; the last has no files.
_FILES_BY_WORK = [
    ("enable_convert_num_to_kanji=false\nenable_auto_indent=false\nenable_transform_fraction=true\nenable_illust=false\nenable_erase_introduction=true", "; rules\n(\\w+)ing\\b\t<\\1>\n[broken\tx\n"),
    ("[global]\nenable_alphabet_force_zenkaku=TRUE\nenable_ruby=0\nenable_transform_date=true\nenable_convert_page_break=true\nenable_pack_blank_line=false", r"\d{2,}" + "\t" + r"#\g<0>" + "\n"),
    ("enable_half_indent_bracket=false\nenable_kanji_num_with_units=false\nenable_auto_join_line=false\nenable_auto_join_in_brackets=false\nenable_convert_horizontal_ellipsis=false\nenable_dakuten_font=false\nunknown=1", None),
]
_SETTINGS = [settings.load(*(x or "" for x in f)) for f in _FILES_BY_WORK] + [settings.Settings()]
_RULES_BY_WORK = [f"replace({_ING}, '[broken', 'x')", sql_sub("t", (r"\p{Nd}{2,}", r"#\0")), "t", "t"]
_FEW_ELLIPSES = sql_pairs("t", [("。。。", "…"), ("．．．", "…"), ("──", "――")])


def _chain_sql(s=_SETTINGS[-1], rules: str = "t", where: str = "true", source: str = f"select doc_id, text || {lit(SPANS)} as t from documents", shown: str = "doc_id, t as normalized") -> str:
    """The stages of a body in order, with what they hide in columns of its own; a step each. source has the texts as t."""
    steps = [f"select * from ({source}) where {where}", f"select * replace ({rules} as t) from s0"]
    then = lambda *names: steps.extend(f"select * replace ({STAGE.get(x, x)} as t) from s{{at}}" for x in names)
    token = lambda kind: lit(f"［＃{kind}＝\ue010］")

    def hide_in(kind: str, pattern: str, where: str = "true", shown: str = "h") -> None:
        steps.append(f"select *, list_transform(list_filter(regexp_extract_all(t, {lit(pattern)}), lambda h: {where.replace('x[2]', 'h')}), lambda h: {shown}) as {kind} from s{{at}}")
        steps.append(f"select * replace ({sql_rewrite('t', pattern, f'case when {where} then {token(kind)} else x[2] end')} as t) from s{{at}}")

    def put_back(kind: str) -> None:
        steps.append(f"select * replace (array_to_string(list_transform(list_zip(string_split(t, {token(kind)}), {kind}), lambda x: coalesce(x[1], '') || coalesce(x[2], '')), '') as t) from s{{at}}")

    some = lambda *named: then(*(x for on, x in named if on))
    then("stage_kana")
    some((s.enable_auto_join_in_brackets, "stage_join_brackets"), (s.enable_auto_join_line, "stage_join_lines"))
    then("stage_comments")
    hidden = ["ＵＲＬ"]
    if s.enable_illust:
        hide_in("挿絵", _NOTE)
        hidden.append("挿絵")
    else:
        then(sql_sub("t", (_NOTE, "")))
    hide_in("ＵＲＬ", n.URL)
    then("stage_site_tags", "stage_roman")
    if not s.enable_alphabet_force_zenkaku:
        hide_in("英文", _RUN, _SENTENCE)
        hidden.append("英文")
    then("stage_latin", "stage_symbols")
    hide_in("章見出し", _HEADING_SQL, shown="'　　　［＃ゴシック体］' || ltrim(h, ' 　' || chr(9)) || '［＃ゴシック体終わり］'")
    then("stage_decimal")
    if s.enable_convert_num_to_kanji:
        hide_in("漢数字", n.KANJI_NUMBER)
        hide_in("半角数字", n.NUMBER)
        hidden.append("半角数字")
        then("stage_kanji_digits")
    else:
        then("stage_wide_numbers")
    then("stage_reconvert")
    some((s.enable_kanji_num_with_units, "stage_kanji_units"))
    if s.enable_convert_num_to_kanji:
        put_back("漢数字")
    then("stage_mark_space", "stage_ellipses" if s.enable_convert_horizontal_ellipsis else _FEW_ELLIPSES)
    some(
        (s.enable_transform_fraction, "stage_fractions"), (s.enable_transform_date, "stage_dates"), (s.enable_dakuten_font, "stage_mark_font"), (s.enable_ruby, "stage_readings"), (s.enable_auto_indent, "stage_indent"),
        (s.enable_half_indent_bracket, "stage_half_indent"), (s.enable_pack_blank_line, "stage_pack_blank"), (s.enable_convert_page_break, "stage_page_break"),
    )
    for kind in (*hidden, "章見出し"):
        put_back(kind)
    made = ", ".join(f"s{i} as ({x.replace('{at}', str(i - 1))})" for i, x in enumerate(steps))
    return f"with {made} select {shown} from s{len(steps) - 1}"


@query(_chain_sql())
def full_pipeline(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.concat("text", F.lit(SPANS)).alias("text"))
    return normalize_all(docs).select("doc_id", "normalized")


@query(" union all ".join(f"select * from ({_chain_sql(s, r, f'doc_id % 4 = {i}')})" for i, (s, r) in enumerate(zip(_SETTINGS, _RULES_BY_WORK, strict=True))))
def settings_by_work(spark, sf_dir):
    """Documents of four works, three of which have settings and rules of their own, normalised in one plan."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.concat("text", F.lit(SPANS)).alias("text"), (F.col("doc_id") % 4).alias("work_id"))
    texts = F.array(*[F.struct(F.lit(a).cast("string").alias("ini"), F.lit(b).cast("string").alias("replacements")) for a, b in _FILES_BY_WORK])
    files = docs.select("work_id").distinct().select("work_id", F.get(texts, F.col("work_id").cast("int")).alias("f")).where("f is not null").select("work_id", "f.*")
    return normalize_by_work(docs, settings.by_work(files)).select("doc_id", "normalized")


#: Sections as they are stored: system turns are introductions.
_LINES_SQL = f"array_to_string(list_transform(string_split(t, chr(10)), lambda l: {_line_sql()}), chr(10))"
_STORED_SQL = "select conv_id as work_id, turn + 1 as idx, coalesce(text[1:12], '') as title, role, text as t from conversations"
_NORMALIZED_SQL = _chain_sql(source=_STORED_SQL, shown="work_id, idx, title, case when role = 'system' then '［＃ここから前書き］' || chr(10) || t || chr(10) || '［＃ここで前書き終わり］' else t end as t")
_PAGES_SQL = (
    "select work_id, 'OEBPS/Text/section_' || lpad(idx::varchar, 4, '0') || '.xhtml' as path, "
    + lit(assemble.SECTION).replace("{title}", f"' || {_ESCAPED} || '").replace("{body}", f"' || {_LINES_SQL} || '")
    + f" as content from ({_NORMALIZED_SQL})"
)
_ALL_FILES_SQL = f"select * from ({SQL['package_files']}) union all select * from ({_PAGES_SQL}) union all select distinct conv_id, 'OEBPS/Styles/style.css', {lit(assemble.STYLE)} from conversations"


def _entries(frames):
    """Names of the entries of each archive, in order, whether all can be read, and a hash of names and contents."""
    for frame in frames:
        found = [zipfile.ZipFile(io.BytesIO(a)) for a in frame.pop("archive")]
        hashes = [sha256("".join(f"{x}\n{z.read(x).decode()}\n" for x in z.namelist()).encode()).hexdigest() for z in found]
        yield frame.assign(names=["|".join(z.namelist()) for z in found], sound=[z.testzip() is None for z in found], content_sha256=hashes)


def _stored(sections):
    intro = F.col("role") == "system"
    element = F.struct(F.when(intro, F.col("body")).otherwise("").alias("introduction"), F.when(~intro, F.col("body")).otherwise("").alias("body"), F.lit("").alias("postscript"), F.lit("text").alias("data_type"))
    return sections.select("work_id", F.col("idx").cast("string").alias("index"), F.col("title").alias("subtitle"), "chapter", element.alias("element"))


_ARCHIVES_SQL = f"""select work_id, string_agg(path, '|' order by path <> 'mimetype', path) as names, true as sound,
    sha256(string_agg(path || chr(10) || content || chr(10), '' order by path <> 'mimetype', path)) as content_sha256 from ({_ALL_FILES_SQL}) group by 1"""


@query(_ARCHIVES_SQL)
def archives(spark, sf_dir):
    """A package of each conversation, from stored sections: normalised, parsed, assembled, zipped; its entries, read back."""
    s = _sections(spark, sf_dir)
    return books(_works(s), _stored(s)).mapInPandas(_entries, "work_id long, names string, sound boolean, content_sha256 string")


@query(
    f"""select conv_id as work_id, case when conv_id % 5 = 0 or conv_id % 7 = 0 then 'failed' when conv_id % 3 = 0 then 'none' else 'ok' end as status,
      case when conv_id % 5 = 0 then 'an index that isn''t a number: ' || case when conv_id % 10 = 0 then 'x' else 'null' end when conv_id % 7 = 0 then 'leaves its folder: ../x.png' end as error,
      case when conv_id % 5 <> 0 and conv_id % 7 <> 0 then content_sha256 end as content_sha256
    from (select distinct conv_id from conversations) join ({_ARCHIVES_SQL}) on conv_id = work_id"""
)
def failing_works(spark, sf_dir):
    """Packages where some works have a section of no number or an image of a forbidden name: they fail, with a message, and
    all other archives are whole. Works without changes have status none."""
    s = _sections(spark, sf_dir)
    five = F.col("work_id") % 5 == 0
    odd = _stored(s.where("idx = 1")).where(five).withColumn("index", F.when(F.col("work_id") % 10 == 0, "x"))
    images = s.select("work_id").distinct().select("work_id", F.when(F.col("work_id") % 7 == 0, "../x.png").otherwise("unused.png").alias("filename"), F.lit(b"x").alias("data"))
    works = _works(s)
    made = cut(books_or_errors(works, _stored(s).unionByName(odd), images=images))
    kept = made.where("error is null").drop("error").mapInPandas(_entries, "work_id long, names string, sound boolean, content_sha256 string")
    told = outcomes.report(works, works.where("work_id % 3 <> 0"), [made.select("work_id", "error")])
    return told.join(kept.select("work_id", "content_sha256"), "work_id", "left")


@query(f"select count(*) as works, (count(*) - count(error))::bigint as success, count(error)::bigint as errors, count(*) filter (where status = 'ok')::bigint as changed from ({SQL['failing_works']})")
def run_counters(spark, sf_dir):
    """The counts of the run above."""
    return outcomes.counters(failing_works(spark, sf_dir))


_IMAGES_SQL = "case when doc_id % 3 = 0 then '［＃挿絵（' || doc_id || '.png）入る］' else '' end"


@query(f"select doc_id, replace(text, '［', '') || 'a' || {_IMAGES_SQL} || '［＃挿絵（b.png）入る］' || {_IMAGES_SQL} as linked from documents")
def illustrations_linked(spark, sf_dir):
    """Documents with notes of an image that a third of them have stored, of a stored file, and of an image that isn't there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    url = F.concat(F.lit("https://x.example/"), F.col("doc_id").cast("string"))
    note = F.concat(F.lit("［＃挿絵（"), url, F.lit("）入る］"))
    texts = docs.select("doc_id", F.concat(F.replace("text", F.lit("［"), F.lit("")), F.lit("a"), note, F.lit("［＃挿絵（b.png）入る］［＃挿絵（http://none/）入る］"), note).alias("linked"))
    images = docs.where("doc_id % 3 = 0").select(url.alias("url"), F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("filename"))
    return illustrations.link(texts, images, "doc_id", "linked")


@query(
    """select o_orderkey, case o_orderkey % 4 when 0 then 'i.' || o_orderkey || '.jpg' when 1 then 'i.' || o_orderkey || '.webp' when 2 then 'named.png' end as filename from orders"""
)
def images_stored(spark, sf_dir):
    """Which stored file an image's URL stands for: of several extensions the first, one that isn't an image's never, a given
    name before the URL's own, none where none is stored."""
    k = F.col("o_orderkey") % 4
    name = F.concat(F.lit("i."), F.col("o_orderkey").cast("string"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    wanted = orders.select("o_orderkey", F.concat(F.lit("https://x.example/a.b/"), name, F.lit(".PNG?v=1.2/3#f")).alias("url"), F.when(k == 2, "named").alias("basename"))
    kinds = F.when(k == 0, F.array(*map(F.lit, ("webp", "txt", "png", "jpg")))).when(k == 1, F.array(*map(F.lit, ("webp", "svg")))).otherwise(F.array(*map(F.lit, ("svg", "JPG"))))
    files = orders.select("o_orderkey", F.explode(F.transform(kinds, lambda e: F.concat(name, F.lit("."), e))).alias("filename"))
    named = orders.where(k == 2).select("o_orderkey", F.lit("named.png").alias("filename"))
    return illustrations.stored_images(wanted, files.unionByName(named), ("o_orderkey",)).select("o_orderkey", "filename")


_CHAPTER_SQL = f"'第［＃縦中横］12［＃縦中横終わり］章（' || case when length(c) = 2 then '［＃縦中横］' || c || '［＃縦中横終わり］' else translate(c, '{_D}', '{_W}') end || '）'"


@query(
    f"""select doc_id, '［＃ここから前書き］' || chr(10) || normalized || chr(10) || '［＃ここで前書き終わり］' as introduction, {_CHAPTER_SQL} as chapter_name
    from ({_chain_sql(source="select doc_id, text as t from documents")}) join (select doc_id, length(text)::varchar as c from documents) using (doc_id)"""
)
def text_kinds(spark, sf_dir):
    """Kinds of texts: whole texts as introductions between markers, a chapter's name."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    docs = docs.select("doc_id", F.col("text").alias("i"), F.concat(F.lit("第12章("), F.length("text").cast("string"), F.lit(")")).alias("c"))
    done = normalize_all(normalize_all(docs, "i", "introduction", out_col="introduction"), "c", "chapter", out_col="chapter_name")
    return done.select("doc_id", "introduction", "chapter_name")
