"""Where works, tables of contents, sections and raw pages are kept between runs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.operators import outcomes
from quirefold.sources import yaml_text
from quirefold.sources.versions import Versions

SECTIONS = T.StructType(
    [T.StructField("work_id", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("index", "href", "chapter", "subtitle", "file_subtitle", "subdate", "subupdate")]
    + [
        T.StructField("element", T.StructType([T.StructField(c, T.StringType()) for c in ("introduction", "body", "postscript", "data_type")])),
        T.StructField("download_time", T.StringType()),
    ]
)
CORRUPT = "_corrupt_record"
#: What stands between the documents of a YAML file.
BETWEEN = "\n---\n"


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table, or an empty one where there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_yaml(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The maps of all .yaml files (and of write_sections' own) below a folder by a schema, with work (the folder above the file's own), file and warning:
    null, or why all other columns are null. A file holds one map, or several with lines of --- between them.

    Files are listed, read and split by Spark, so any store that it reads will do; the driver reads none. A file without a
    character gives no row.
    """
    options = {"lineSep": BETWEEN, "recursiveFileLookup": "true", "pathGlobFilter": "{*.yaml,part-*}"}
    rows = spark.read.options(**options).text(path).select(F.regexp_replace("value", r"\A\x{feff}?---\r?\n", "").alias("text"), F.col("_metadata.file_path").alias("file"))
    rows = rows.withColumn("json", yaml_text.to_json(F.col("text")))
    warning = F.when(F.col("json").isNull(), "can't be read").when(~F.col("json").startswith("{"), "isn't a map")
    folder = F.url_decode(F.replace(F.element_at(F.split("file", "/"), -3), F.lit("+"), F.lit("%2B")))
    parsed = F.from_json(F.when(warning.isNull(), F.col("json")), schema)
    return rows.select(folder.alias("work"), "file", warning.alias("warning"), parsed.alias("s")).select("work", "file", "warning", "s.*")


def read_sections(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """Sections as JSON lines, YAML files or Parquet. Lines and files that aren't sections are left out (read_yaml tells which
    files); of rows that repeat a work's index the last download counts, so a renamed episode replaces its old file. A YAML
    section without work_id is of the work that its folder is named after, if that is a number."""
    if form == "json":
        schema = T.StructType([*SECTIONS.fields, T.StructField(CORRUPT, T.StringType())])
        rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
        rows = rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    elif form == "yaml":
        rows = read_yaml(spark, path, SECTIONS).where("warning is null").withColumn("work_id", F.coalesce("work_id", F.col("work").try_cast("long"))).select(SECTIONS.names)
    else:
        rows = spark.read.schema(SECTIONS).parquet(path)
    last = rows.where(F.col("index").isNotNull()).groupBy("work_id", "index").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("work_id", "index")]), F.coalesce("download_time", F.lit(""))).alias("r"))
    return last.select("work_id", "index", "r.*").select(SECTIONS.names)


def in_order(sections: DataFrame) -> DataFrame:
    """sections with ordinal, by the number that the index is; those without a number are left out."""
    number = F.col("index").try_cast("long")
    by = Window.partitionBy("work_id").orderBy(number)
    return sections.where(number.isNotNull()).withColumn("ordinal", F.row_number().over(by))


def write_sections(sections: DataFrame, path: str, mode: str = "append", form: str = "json") -> None:
    """Sections as JSON lines, or as YAML files of up to 1,000 maps each."""
    if form == "json":
        sections.select(SECTIONS.names).write.mode(mode).json(path)
    else:
        rows = sections.select(section_yaml(sections).alias("value"))
        rows.write.mode(mode).options(lineSep=BETWEEN, maxRecordsPerFile="1000").text(path)


def section_yaml(sections: DataFrame) -> Column:
    """A section as a YAML map, a line for each name."""
    parts = [f.name for f in SECTIONS["element"].dataType.fields]
    texts = {n: F.col(n) for n in SECTIONS.names if n not in ("work_id", "element")}
    element = {n: F.col(f"element.{n}") for n in parts}
    return F.concat(F.lit("work_id: "), F.coalesce(F.col("work_id").cast("string"), F.lit("null")), F.lit("\n"), yaml_text.block_map(texts | {"element": element}))


def write_contents(tables: DataFrame, path: str) -> None:
    """Tables of contents; those of works that are in `tables` replace what was stored, the others stay. Only the buckets of
    these works are read and written, and readers see the old tables until all of it is there (see sources.versions)."""
    Versions(tables.sparkSession, path, tables.schema).upsert(tables)


def read_contents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return Versions(spark, path, schema).read()


RAW = T.StructType([T.StructField("work_id", T.LongType()), T.StructField("path", T.StringType()), T.StructField("html", T.StringType())])


def raw_pages(pages: DataFrame) -> DataFrame:
    """Raw pages (work_id, index, file_subtitle, html) under their names, with `error` for those whose name would leave its
    folder: work_id, path, html, error."""
    name = raw_name(F.col("index"), F.coalesce("file_subtitle", F.lit("")))
    rows = pages.select(F.col("work_id").cast("long").alias("work_id"), name.alias("path"), "html")
    return outcomes.checked(rows, [(inside(F.col("path")), F.concat(F.lit("leaves its folder: "), F.coalesce("path", F.lit("null"))))])


def write_raw(pages: DataFrame, path: str) -> None:
    """Raw pages as rows of work_id, path and html: many small pages a file, all of a call or none. Names that would leave their
    folder are an error; to go on without them, write where raw_pages has none."""
    rows = raw_pages(pages)
    checked = F.when(F.col("error").isNull(), F.col("path")).otherwise(F.raise_error(F.col("error")))
    Versions(pages.sparkSession, path, RAW).append(rows.select("work_id", checked.alias("path"), "html"))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return Versions(spark, path, RAW).read()


def raw_name(index: Column, subtitle: Column) -> Column:
    return F.concat(F.lit("raw/"), index, F.lit(" "), subtitle, F.lit(".html"))


def inside(path: Column) -> Column:
    """Whether a relative path stays in its folder: not absolute, and never more `..` than names before."""
    parts = F.filter(F.split(path, r"[/\\]"), lambda p: ~p.isin("", "."))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda a, p: F.struct((a.at + F.when(p == "..", -1).otherwise(1)).alias("at"), F.least(a.low, a.at + F.when(p == "..", -1).otherwise(1)).alias("low")))
    return ~path.rlike(r"^[/\\]|^[A-Za-z]:") & (depth.low >= 0)
