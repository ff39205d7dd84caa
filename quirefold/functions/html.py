"""Page markup to text, in regular expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.functions.strings import BODY_ENTITIES, replace_all, strip
from quirefold.functions.tokens import rewrite

#: Schemes of URLs that others can be relative to.
RELATIVE = ("", "http", "https", "ftp", "file", "sftp", "ws", "wss")
#: Tags and the notes that stand for them.
NOTES = (("b", "太字"), ("i", "斜体"), ("s", "取消線"))


def drop_tags(text: Column) -> Column:
    """Tags go, but for those that a line end splits."""
    return F.regexp_replace(text, "(?d)<.+?>", "")


def breaks(text: Column) -> Column:
    """Line ends go; <br> makes them."""
    return F.regexp_replace(F.regexp_replace(text, r"[\r\n]+", ""), r"(?iu)<br\s*/?>", "\n")


def ruby(text: Column) -> Column:
    """Ruby as ｜base《reading》; brackets of that kind in the text are made others first."""
    plain = F.translate(text, "《》", "≪≫")
    pair = r"(?iud)<ruby>((?:(?!<rt>|<rp>|</ruby>).)*)(?:(?!<rt>|</ruby>).)*<rt>((?:(?!<rt>|<rp>|</ruby>).)*).*?</ruby>"
    done = F.regexp_replace(plain, pair, "｜$1《$2》")
    return F.regexp_replace(done, r"(?iud)<ruby>((?:(?!</ruby>).)+?)</ruby>", "$1")


def style_notes(text: Column) -> Column:
    for tag, note in NOTES:
        text = F.regexp_replace(F.regexp_replace(text, f"(?i)<{tag}>", f"［＃{note}］"), f"(?i)</{tag}>", f"［＃{note}終わり］")
    return text


def _parts(url: Column) -> dict[str, Column]:
    """Scheme, host (null where a URL has none), path, parameters of its last segment, query and fragment."""
    plain = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), "[\t\r\n]", "")
    part = lambda n: F.regexp_extract(plain, r"(?s)\A(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z", n)
    path = part(4)
    kept = F.regexp_extract(path, r"(?s)\A((?:.*/)?[^/;]*)", 1)
    return {"scheme": F.lower(part(1)), "host": F.when(part(2) != "", part(3)), "path": kept, "params": F.substring(path, F.length(kept) + 2, F.length(path)), "query": part(5), "fragment": part(6)}


def _joined(p: dict[str, Column]) -> Column:
    ahead = lambda sign, c: F.when(c == "", "").otherwise(F.concat(F.lit(sign), c))
    slash = F.when(p["host"].isNotNull() & (p["path"] != "") & ~p["path"].startswith("/"), "/").otherwise("")
    scheme = F.when(p["scheme"] == "", "").otherwise(F.concat(p["scheme"], F.lit(":")))
    host = F.when(F.coalesce(p["host"], F.lit("")) == "", "").otherwise(F.concat(F.lit("//"), p["host"]))
    return F.concat(scheme, host, slash, p["path"], ahead(";", p["params"]), ahead("?", p["query"]), ahead("#", p["fragment"]))


def resolve(src: Column, base: Column) -> Column:
    """A reference as an absolute URL, as the standard library joins them: segments of both paths go through a stack, from
    which .. takes the last one, however many there are; queries and fragments are never touched."""
    s, b = _parts(src), _parts(base)
    scheme = F.when(s["scheme"] == "", b["scheme"]).otherwise(s["scheme"])
    folder = F.split(b["path"], "/", -1)
    folder = F.when(F.element_at(folder, -1) == "", folder).otherwise(F.slice(folder, 1, F.size(folder) - 1))
    own = F.split(s["path"], "/", -1)
    all_ = F.when(s["path"].startswith("/"), own).otherwise(F.concat(folder, own))
    # empty segments inside a joined path go, those of a path of its own stay
    middle = F.when(s["path"].startswith("/"), own).otherwise(F.filter(all_, lambda x, i: (x != "") | (i == 0) | (i == F.size(all_) - 1)))

    def step(stack: Column, x: Column) -> Column:
        return F.when(x == "..", F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).when(x == ".", stack).otherwise(F.concat(stack, F.array(x)))

    walked = F.aggregate(middle, F.array().cast("array<string>"), step)
    walked = F.when(F.element_at(all_, -1).isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    path = F.array_join(walked, "/")
    here = (s["path"] == "") & (s["params"] == "")
    joined = _joined({"scheme": scheme, "host": b["host"], "path": F.when(path == "", "/").otherwise(path), "params": s["params"], "query": s["query"], "fragment": s["fragment"]})
    same = _joined({"scheme": scheme, "host": b["host"], "path": b["path"], "params": b["params"], "query": F.when(s["query"] == "", b["query"]).otherwise(s["query"]), "fragment": s["fragment"]})
    whole = _joined(s | {"scheme": scheme})
    elsewhere = (scheme != b["scheme"]) | ~scheme.isin(*RELATIVE)
    found = F.when(elsewhere, src).when(F.coalesce(s["host"], F.lit("")) != "", whole).when(here, same).otherwise(joined)
    return F.when(base == "", src).when(src == "", base).otherwise(found)


def images(text: Column, base: Column | None = None) -> Column:
    """<img> as illustration notes, sources resolved against base if it is given."""
    pattern = r'(?iud)<img.+?src="(.+?)".*?>'
    if base is None:
        return F.regexp_replace(text, pattern, "［＃挿絵（$1）入る］")
    return rewrite(text, pattern, lambda tag: F.concat(F.lit("［＃挿絵（"), resolve(F.regexp_extract(tag, pattern, 1), base), F.lit("）入る］")))


def annotated(text: Column, base: Column | None = None) -> Column:
    """Markup as annotated text."""
    return drop_tags(images(style_notes(ruby(breaks(text))), base))


def body_text(text: Column) -> Column:
    """Markup of an episode's part as text: line ends of <br> and <p>, ruby as ｜base《reading》, nothing else."""
    t = F.regexp_replace(text, r"<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"(?s)<p[^>]*>(.*?)</p>", "$1\n")
    t = F.regexp_replace(t, r"<ruby>[^<]*<rb>([^<]*)</rb><rp>[^<]*</rp><rt>([^<]*)</rt><rp>[^<]*</rp></ruby>", "｜$1《$2》")
    t = F.regexp_replace(t, r"<ruby>([^<]*)<rt>([^<]*)</rt></ruby>", "｜$1《$2》")
    t = replace_all(F.regexp_replace(t, r"<[^>]+>", ""), BODY_ENTITIES)
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))
