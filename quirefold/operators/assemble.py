"""Sections in order to a package: chapters, tables of contents, pages, archive bytes.

Inputs: works (work_id, title, author, sitename, book_id, modified), sections (work_id, idx, title, chapter, body). All
of a work's files but its sections are of the size of its table of contents; each section is a row of its own until an
archive is made, and an archive is one work's bytes.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.functions.strings import cover_start, media_type, wrap, xml_escape

# The documents of a package, {names} being filled in ---------------------------------------------------
HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n'
PAGE = HEAD + '<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="ja">\n<head>\n  <title>{title}</title>\n  <link rel="stylesheet" type="text/css" href="../Styles/style.css"/>\n</head>\n'
SECTION = PAGE + "<body>\n<h2>{title}</h2>\n{body}\n</body>\n</html>"
TITLE_PAGE = PAGE + '<body class="titlepage">\n  <h1>{title}</h1>\n  <p class="author">{author}</p>{source}\n</body>\n</html>'
COVER = PAGE + (
    '<body class="coverpage">\n  <svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 600 800" preserveAspectRatio="xMidYMid meet">\n'
    '    <rect width="600" height="800" fill="#f5f0e8"/>\n'
    '    <rect x="30" y="30" width="540" height="740" fill="none" stroke="#8b7355" stroke-width="2"/>\n'
    '    <rect x="35" y="35" width="530" height="730" fill="none" stroke="#8b7355" stroke-width="0.5"/>\n'
    '    <text text-anchor="middle" font-family="serif" font-size="42" fill="#333" y="{start}">\n{lines}    </text>\n'
    '    <line x1="200" y1="550" x2="400" y2="550" stroke="#8b7355" stroke-width="1"/>\n'
    '    <text text-anchor="middle" font-family="serif" font-size="24" fill="#555" x="300" y="600">\n      {author}\n    </text>\n'
    "  </svg>\n</body>\n</html>"
)
CONTENTS = HEAD + (
    '<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" xml:lang="ja">\n<head>\n  <title>目次</title>\n</head>\n'
    '<body>\n  <nav epub:type="toc">\n    <h1>目次</h1>\n    <ol>\n{items}    </ol>\n  </nav>\n</body>\n</html>'
)
NCX = HEAD + (
    '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1">\n  <head>\n    <meta name="dtb:uid" content="urn:uuid:{book_id}"/>\n    <meta name="dtb:depth" content="1"/>\n'
    '    <meta name="dtb:totalPageCount" content="0"/>\n    <meta name="dtb:maxPageNumber" content="0"/>\n  </head>\n  <docTitle><text>{title}</text></docTitle>\n  <navMap>\n{points}  </navMap>\n</ncx>'
)
OPF = HEAD + (
    '<package xmlns="http://www.idpf.org/2007/opf" version="3.0"\n         unique-identifier="BookId" xml:lang="ja">\n  <metadata xmlns:dc="http://purl.org/dc/elements/1.1/">\n'
    '    <dc:identifier id="BookId">urn:uuid:{book_id}</dc:identifier>\n    <dc:title>{title}</dc:title>\n    <dc:language>ja</dc:language>\n    <dc:creator>{author}</dc:creator>\n'
    '    <meta property="dcterms:modified">{modified}</meta>\n  </metadata>\n  <manifest>\n'
    '    <item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>\n'
    '    <item id="nav" href="toc.xhtml" media-type="application/xhtml+xml" properties="nav"/>\n'
    '    <item id="css" href="Styles/style.css" media-type="text/css"/>\n'
    '    <item id="cover" href="Text/cover.xhtml" media-type="application/xhtml+xml" properties="svg"/>\n'
    '    <item id="titlepage" href="Text/titlepage.xhtml" media-type="application/xhtml+xml"/>{items}\n  </manifest>\n'
    '  <spine toc="ncx" page-progression-direction="rtl">\n    <itemref idref="cover"/>\n    <itemref idref="titlepage"/>{refs}\n  </spine>\n</package>'
)
CONTAINER = HEAD + (
    '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0">\n  <rootfiles>\n'
    '    <rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/>\n  </rootfiles>\n</container>'
)
MIMETYPE = "application/epub+zip"
#: When a work was changed that has no date.
UNDATED = "1970-01-01T00:00:00Z"
# -----------------------------------------------------------------------------------------------------------------------


#: A style sheet of our own for the classes that pages and parsed lines use.
STYLE = (
    '@charset "UTF-8";\nhtml { writing-mode: vertical-rl; -epub-writing-mode: vertical-rl; }\nbody { margin: 1em; line-height: 1.8; }\n'
    "p { margin: 0; }\nh2 { margin: 0 2em 0 1em; font-size: 1.2em; }\n.tcy { text-combine-upright: all; -epub-text-combine: horizontal; }\n"
    ".sesame { text-emphasis-style: sesame; -epub-text-emphasis-style: sesame; font-style: normal; }\n.hang-indent { text-indent: -0.5em; padding-top: 0.5em; }\n"
    ".preface, .postscript { font-size: 0.9em; margin: 0 2em; }\n.pagebreak { visibility: hidden; break-after: page; }\n"
    ".illustration img { max-width: 100%; max-height: 100%; }\n.titlepage h1 { font-size: 1.6em; }\n.coverpage { margin: 0; }\n"
)


def fill(template: str, **values: Column) -> Column:
    """The template with its {names} replaced by columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def joined_element(introduction: Column, body: Column, postscript: Column) -> Column:
    """The parts that aren't empty, by line."""
    return F.concat_ws("\n", *[F.nullif(c, F.lit("")) for c in (introduction, body, postscript)])


def numbered(sections: DataFrame, work: str = "work_id", order: str = "ordinal") -> DataFrame:
    return sections.withColumn("idx", F.row_number().over(Window.partitionBy(work).orderBy(order)))


def filename(idx: Column) -> Column:
    return F.concat(F.lit("section_"), F.when(idx < 10_000, F.lpad(idx.cast("string"), 4, "0")).otherwise(idx.cast("string")), F.lit(".xhtml"))


def chapters(sections: DataFrame, work: str = "work_id", order: str = "idx") -> DataFrame:
    """sections with in_chapter, the last chapter named so far (null before the first), and starts, whether it is
    another one than that of the section before."""
    by = Window.partitionBy(work).orderBy(order)
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = sections.withColumn("in_chapter", F.last(F.nullif("chapter", F.lit("")), ignorenulls=True).over(so_far))
    return filled.withColumn("starts", F.col("in_chapter").isNotNull() & ~F.col("in_chapter").eqNullSafe(F.lag("in_chapter").over(by)))


def section_pages(sections: DataFrame) -> DataFrame:
    """(work_id, path, content) of each section."""
    page = fill(SECTION, title=xml_escape(F.coalesce("title", F.lit(""))), body=F.coalesce("body", F.lit("")))
    return sections.select("work_id", F.concat(F.lit("OEBPS/Text/"), filename(F.col("idx"))).alias("path"), page.alias("content"))


def _toc_line() -> Column:
    """What a section adds to the table of contents: the end of a chapter, the start of the next one, its own link."""
    close = F.when(F.col("starts") & F.col("was_in"), "      </ol>\n      </li>\n").otherwise("")
    start = F.when(F.col("starts"), F.concat(F.lit("      <li><span>"), xml_escape(F.col("in_chapter")), F.lit("</span>\n      <ol>\n"))).otherwise("")
    indent = F.when(F.col("in_chapter").isNotNull(), "        ").otherwise("      ")
    return F.concat(close, start, indent, F.lit('<li><a href="Text/'), filename(F.col("idx")), F.lit('">'), xml_escape(F.coalesce("title", F.lit(""))), F.lit("</a></li>\n"))


def outlines(sections: DataFrame) -> DataFrame:
    """(work_id, toc, points, items, refs): the parts of a work's package documents that list its sections, in order."""
    by = Window.partitionBy("work_id").orderBy("idx")
    lines = chapters(sections).withColumn("was_in", F.lag("in_chapter").over(by).isNotNull())
    order = F.row_number().over(by).cast("string")
    point = F.concat(F.lit('    <navPoint id="navPoint-'), order, F.lit('" playOrder="'), order, F.lit('">\n      <navLabel><text>'), xml_escape(F.coalesce("title", F.lit(""))), F.lit('</text></navLabel>\n      <content src="Text/'), filename(F.col("idx")), F.lit('"/>\n    </navPoint>\n'))
    name = F.regexp_replace(filename(F.col("idx")), r"\.xhtml$", "")
    item = F.concat(F.lit('\n    <item id="'), name, F.lit('" href="Text/'), name, F.lit('.xhtml" media-type="application/xhtml+xml"/>'))
    ref = F.concat(F.lit('\n    <itemref idref="'), name, F.lit('"/>'))
    held = lines.select("work_id", "idx", F.col("in_chapter").isNotNull().alias("inside"), _toc_line().alias("toc"), point.alias("points"), item.alias("items"), ref.alias("refs"))
    rows = held.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("idx", "inside", "toc", "points", "items", "refs"))).alias("rows"))
    text = lambda c: F.array_join(F.transform("rows", lambda r: r[c]), "").alias(c)
    end = F.when(F.element_at("rows", -1).inside, "      </ol>\n      </li>\n").otherwise("")
    return rows.select("work_id", F.concat(text("toc"), end).alias("toc"), text("points"), text("items"), text("refs"))


def package_files(works: DataFrame, sections: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(work_id, path, content) of a work's documents but for its sections. images: (work_id, idx, filename)."""
    shown = works.join(outlines(sections), "work_id", "left")
    if images is not None:
        kinds = F.concat(F.lit('" href="Images/'), xml_escape(F.col("filename")), F.lit('" media-type="'), media_type(F.col("filename")), F.lit('"/>'))
        of = images.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("idx", kinds.alias("rest")))).alias("pics"))
        shown = shown.join(of, "work_id", "left")
        pics = F.array_join(F.transform(F.coalesce("pics", F.array().cast(of.schema["pics"].dataType)), lambda p, i: F.concat(F.lit('\n    <item id="img'), i.cast("string"), p.rest)), "")
    else:
        pics = F.lit("")
    title, author = xml_escape(F.coalesce("title", F.lit(""))), xml_escape(F.coalesce("author", F.lit("")))
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    book_id, modified = F.coalesce("book_id", F.col("work_id").cast("string")), F.coalesce("modified", F.lit(UNDATED))
    source = F.when(part("sitename") == "", "").otherwise(F.concat(F.lit('\n  <p class="source">'), xml_escape(part("sitename")), F.lit("</p>")))
    lines = wrap(F.coalesce("title", F.lit("")), 10)
    spans = F.transform(lines, lambda t, i: F.concat(F.lit('      <tspan x="300" dy="'), F.when(i == 0, "0").otherwise("60"), F.lit('">'), xml_escape(t), F.lit("</tspan>\n")))
    empty = F.concat(F.lit('      <li><a href="Text/titlepage.xhtml">'), title, F.lit("</a></li>\n"))
    files = {
        "mimetype": F.lit(MIMETYPE),
        "META-INF/container.xml": F.lit(CONTAINER),
        "OEBPS/content.opf": fill(OPF, book_id=book_id, title=title, author=author, modified=modified, items=F.concat(part("items"), pics), refs=part("refs")),
        "OEBPS/toc.xhtml": fill(CONTENTS, items=F.when(part("toc") == "", empty).otherwise(part("toc"))),
        "OEBPS/toc.ncx": fill(NCX, book_id=book_id, title=title, points=part("points")),
        "OEBPS/Text/cover.xhtml": fill(COVER, title=title, author=author, start=cover_start(F.size(lines)).cast("string"), lines=F.array_join(spans, "")),
        "OEBPS/Text/titlepage.xhtml": fill(TITLE_PAGE, title=title, author=author, source=source),
    }
    rows = F.array(*[F.struct(F.lit(p).alias("path"), c.alias("content")) for p, c in files.items()])
    return shown.select("work_id", F.inline(rows))


def first_images(images: DataFrame) -> DataFrame:
    """(work_id, idx, filename, data): of each file name of a work the first one that has data, in order of idx."""
    return images.where("data is not null").groupBy("work_id", "filename").agg(F.min_by(F.struct("idx", "data"), "idx").alias("f")).select("work_id", "f.idx", "filename", "f.data")


def _archive(files: list[tuple[str, bytes | None]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        before = None
        for path, content in sorted(files, key=lambda f: (f[0] != "mimetype", f[0])):
            if path == before:
                raise ValueError(f"two files of one name: {path}")
            if content is None:
                raise ValueError(f"a file without content: {path}")
            entry = zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0))
            entry.compress_type = zipfile.ZIP_STORED if path == "mimetype" else zipfile.ZIP_DEFLATED
            z.writestr(entry, content)
            before = path
    return out.getvalue()


def _works(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Works whose rows follow one another, across batches; a file's bytes are copied when its work comes."""
    work, files = None, []
    for batch in batches:
        for i, w in enumerate(batch.column(0).to_pylist()):
            if files and w != work:
                yield work, files
                files = []
            work = w
            files.append((batch.column(1)[i].as_py(), batch.column(2)[i].as_py()))
    if files:
        yield work, files


def archives_or_errors(files: DataFrame) -> DataFrame:
    """(work_id, archive, error): the files (path, content as binary) of each work as one archive, the media type first and
    stored, the others by path; or what kept it from being made. A task builds one work at a time, from batches of rows that
    Spark sizes."""
    kind = files.schema["work_id"]
    schema = T.StructType([kind, T.StructField("archive", T.BinaryType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for work, own in _works(batches):
            archive = error = None
            try:
                archive = _archive(own)
            except Exception as e:  # whatever one work's files do, the others go on
                error = f"{type(e).__name__}: {e}"
            yield pa.RecordBatch.from_arrays([pa.array([work]), pa.array([archive], pa.binary()), pa.array([error], pa.string())], names=schema.names)

    rows = files.select("work_id", "path", F.col("content").cast("binary").alias("content")).where("work_id is not null and path is not null")
    # by a hash of the key: a repartition by the key itself is dropped where the rows come from joins by it, and these joins
    # may be planned anew while the query runs
    return rows.repartition(F.xxhash64("work_id")).sortWithinPartitions("work_id", "path").mapInArrow(run, schema)


def archives(files: DataFrame) -> DataFrame:
    """(work_id, archive) of the works whose archives can be made."""
    return archives_or_errors(files).where("error is null").drop("error")
