"""Illustration notes of texts, joined with the images that are stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.strings import EXTENSIONS, ILLUSTRATION, code_illustrations
from quirefold.functions.tokens import rewrite


def basename(url: Column) -> Column:
    """The name that an image of this URL is stored under: the last segment of its path without its last extension."""
    path = F.regexp_replace(F.regexp_replace(url, r"(?s)[?#].*", ""), "/+$", "")
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return F.when(name.rlike(r"(?s)^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)


def stored_images(wanted: DataFrame, files: DataFrame, keys: tuple[str, ...] = ("work_id",)) -> DataFrame:
    """wanted (keys, url, and basename where it is given) with the filename that is stored for each, null where none is: of the
    files (keys, filename) of that name the first in the order of EXTENSIONS, whatever other extensions there are."""
    name = F.coalesce("basename", basename(F.col("url"))) if "basename" in wanted.columns else basename(F.col("url"))
    places = F.create_map(*[x for i, e in enumerate(EXTENSIONS.values()) for x in (F.lit(e), F.lit(i))])
    split = files.select(*keys, F.regexp_extract("filename", r"(?s)^(.*)\.([^.]*)$", 1).alias("_name"), F.element_at(places, F.regexp_extract("filename", r"\.([^.]*)$", 1)).alias("_place"), "filename")
    first = split.where("_place is not null").groupBy(*keys, "_name").agg(F.min_by("filename", "_place").alias("_stored"))
    rows = wanted.drop("filename").withColumn("_name", name).join(first, [*keys, "_name"], "left")
    return rows.withColumnRenamed("_stored", "filename").drop("_name")


def link(texts: DataFrame, images: DataFrame, id_col: str, text_col: str, code_template: str | None = None) -> DataFrame:
    """texts with the URLs of illustration notes replaced by the names under which images (url, filename) are stored; notes
    whose image isn't stored are removed, notes that hold no URL stay. With a template, coded tags become URLs first.

    URLs are looked up by a join on (url), a row each, and come back as a map for each id; texts don't travel with them.
    Rows that share an id share its map. Null texts stay null.
    """
    text = F.col(text_col) if code_template is None else code_illustrations(F.col(text_col), code_template)
    rows = texts.withColumn(text_col, text)
    urls = rows.select(id_col, F.explode(F.array_distinct(F.regexp_extract_all(text_col, F.lit(ILLUSTRATION), F.lit(1)))).alias("url"))
    stored = images.where("filename is not null").groupBy("url").agg(F.min("filename").alias("filename"))
    found = urls.where("url rlike '^https?://'").distinct().join(stored, "url")
    names = found.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("url", "filename"))).alias("_stored"))

    def change(note):
        url = F.regexp_extract(note, ILLUSTRATION, 1)
        name = F.coalesce(F.element_at("_stored", url), F.lit(""))
        kept = F.when(name == "", "").otherwise(F.concat(F.lit("［＃挿絵（"), name, F.lit("）入る］")))
        return F.when(url.rlike("^https?://"), kept).otherwise(note)

    out = rows.join(names, id_col, "left").withColumn(text_col, rewrite(F.col(text_col), ILLUSTRATION, change))
    return out.select(texts.columns)
