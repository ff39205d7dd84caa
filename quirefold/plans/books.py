"""From stored sections to packages: normalise, parse, assemble."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions.html import annotated
from quirefold.functions.markup import pictures, xhtml
from quirefold.operators import assemble, outcomes
from quirefold.plans.normalize import normalize
from quirefold.sources.settings import Settings
from quirefold.sources.shared import cut
from quirefold.sources.store import in_order, inside


def bodies(sections: DataFrame, settings: Settings | None = None) -> DataFrame:
    """sections (work_id, index, subtitle, chapter, element) as (work_id, idx, title, chapter, body, images). A section
    without subtitle is titled by its place."""
    rows = in_order(sections).select("work_id", F.col("ordinal").alias("idx"), F.coalesce("subtitle", F.concat(F.lit("第"), F.col("ordinal").cast("string"), F.lit("話"))).alias("title"), "chapter", "element.*")
    for kind in ("introduction", "body", "postscript"):
        markup = F.when(F.col("data_type") == "html", annotated(F.col(kind))).otherwise(F.col(kind))
        rows = normalize(rows.withColumn(kind, F.coalesce(markup, F.lit(""))), kind, kind, settings, out_col="_done")
        rows = rows.withColumn(kind, F.when(F.col(kind) == "", "").otherwise(F.col("_done"))).drop("_done")
    text = assemble.joined_element(F.col("introduction"), F.col("body"), F.col("postscript"))
    rows = rows.withColumn("text", text)
    return rows.select("work_id", "idx", "title", "chapter", xhtml(F.col("text")).alias("body"), pictures(F.col("text")).alias("images"))


def books_or_errors(works: DataFrame, sections: DataFrame, settings: Settings | None = None, css: str = assemble.STYLE, images: DataFrame | None = None) -> DataFrame:
    """(work_id, archive, error): a package of each work, its style sheet included, or why there is none.

    A work fails if a section's index isn't a number, if an image's name leads out of its folder, or if its archive can't be
    made; the others don't notice. Sections without an element (files that can't be read) are left out, nulls in titles and
    texts are empty. images: (work_id, filename, data); of those, what the sections name goes into the package and its
    manifest, each name once, in order of the first section that has it.
    """
    fine = F.col("index").try_cast("long").isNotNull()
    judged = outcomes.checked(sections.where("element is not null"), [(fine, F.concat(F.lit("an index that isn't a number: "), F.coalesce("index", F.lit("null"))))])
    failed = [outcomes.errors_by_work(judged)]
    if images is not None:
        named = outcomes.checked(images.where("data is not null"), [(inside(F.concat(F.lit("Images/"), "filename")) & ~F.col("filename").contains("/"), F.concat(F.lit("leaves its folder: "), F.coalesce("filename", F.lit("null"))))])
        failed.append(outcomes.errors_by_work(named))
    bad = reduce(DataFrame.unionByName, failed).groupBy("work_id").agg(F.min("error").alias("error"))
    works, sections = (df.join(bad, "work_id", "left_anti") for df in (works, judged.drop("error")))
    parts = bodies(sections, settings)
    shown = None
    if images is not None:
        parts = cut(parts)  # read twice, and normalising is what costs
        named = parts.select("work_id", "idx", F.posexplode("images").alias("at", "i")).select("work_id", F.struct("idx", "at").alias("place"), F.col("i.filename").alias("filename"))
        named = named.groupBy("work_id", "filename").agg(F.min("place").alias("place"))
        held = images.where("data is not null").groupBy("work_id", "filename").agg(F.min("data").alias("data"))
        shown = named.join(held, ["work_id", "filename"]).select("work_id", F.col("place").alias("idx"), "filename", "data")
    files = assemble.package_files(works, parts, shown).unionByName(assemble.section_pages(parts))
    styles = works.select("work_id", F.lit("OEBPS/Styles/style.css").alias("path"), F.lit(css).alias("content"))
    files = files.unionByName(styles).withColumn("content", F.col("content").cast("binary"))
    if shown is not None:
        files = files.unionByName(shown.select("work_id", F.concat(F.lit("OEBPS/Images/"), F.col("filename")).alias("path"), F.col("data").cast("binary").alias("content")))
    return assemble.archives_or_errors(files).unionByName(bad.select("work_id", F.lit(None).cast("binary").alias("archive"), "error"))


def books(works: DataFrame, sections: DataFrame, settings: Settings | None = None, css: str = assemble.STYLE, images: DataFrame | None = None) -> DataFrame:
    """(work_id, archive) of the works whose packages can be made; see books_or_errors."""
    return books_or_errors(works, sections, settings, css, images).where("error is null").drop("error")
