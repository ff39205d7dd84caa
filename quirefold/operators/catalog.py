"""The catalogue of works: list, search, get, insert, update, upsert, delete. Each takes and gives a DataFrame."""

from __future__ import annotations

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.sources.shared import cut
from quirefold.functions.strings import like

#: Fixed value: columns that a listing can be sorted by; anything else means the first.
SORTABLE = ("last_update", "title", "author", "id", "new_arrivals_date")

WORKS = T.StructType(
    [T.StructField("id", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("title", "author", "toc_url", "sitename")]
    + [T.StructField("novel_type", T.IntegerType()), T.StructField("is_end", T.BooleanType())]
    + [T.StructField(c, T.TimestampNTZType()) for c in ("last_update", "new_arrivals_date")]
    + [T.StructField("general_all_no", T.IntegerType()), T.StructField("use_subdirectory", T.BooleanType()), T.StructField("tags", T.ArrayType(T.StringType()))]
    + [T.StructField(c, T.StringType()) for c in ("file_title", "story", "archive_path")]
)


def decode_tags(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, ",", -1))


def encode_tags(tags: Column) -> Column:
    """A tag with a comma comes back as two."""
    return F.array_join(tags, ",")


def decode(rows: DataFrame) -> DataFrame:
    """Rows as stored (flags 0 or 1, times and tags as text) in the schema of WORKS."""
    how = {"is_end": F.col("is_end") == 1, "use_subdirectory": F.col("use_subdirectory") == 1, "tags": decode_tags(F.col("tags"))}
    return rows.select(*[how.get(f.name, F.col(f.name).try_cast(f.dataType)).alias(f.name) for f in WORKS])


def encode(works: DataFrame) -> DataFrame:
    stamp = lambda c: F.replace(F.col(c).cast("string"), F.lit(" "), F.lit("T"))
    how = {c: F.col(c).cast("int") for c in ("is_end", "use_subdirectory")} | {c: stamp(c) for c in ("last_update", "new_arrivals_date")} | {"tags": encode_tags(F.col("tags"))}
    return works.select(*[how.get(f.name, F.col(f.name)).alias(f.name) for f in WORKS])


def folded(works: DataFrame, column: str) -> Column:
    """What a column is sorted by where upper and lower case are the same."""
    return F.lower(column) if works.schema[column].dataType.simpleString() == "string" else F.col(column)


def listing(works: DataFrame, sort_by: str = SORTABLE[0], sortable: tuple[str, ...] = SORTABLE) -> DataFrame:
    """Newest (largest) first, nulls last."""
    return works.orderBy(F.col(sort_by if sort_by in sortable else sortable[0]).desc_nulls_last())


def placed(works: DataFrame, by: list[Column], name: str = "place") -> DataFrame:
    """All works and their places, from 1, in the order of `by`, which should leave no ties.

    Places are numbered inside ranges of the order, and the counts of the ranges before are added. Ranges are drawn from
    samples, so they are written once, to the shared folder, for both.
    """
    ranged = cut(works.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    numbered = ranged.withColumn("_inside", inside).join(F.broadcast(counts.select("_range", before.alias("_before"))), "_range")
    return numbered.withColumn(name, F.col("_before") + F.col("_inside")).select(name, *works.columns)


def search(works: DataFrame, query: str, columns: tuple[str, ...] = ("title", "author")) -> DataFrame:
    """Works that have the query in one of the columns; A-Z match a-z, % and _ are wildcards."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(like(F.col(c), query), F.lit(False))
    return works.where(found).orderBy(F.col("last_update").desc_nulls_last()) if "last_update" in works.columns else works.where(found)


def get(works: DataFrame, key, column: str = "id") -> DataFrame:
    """One row or none."""
    return works.where(F.col(column) == F.lit(key)).limit(1)


def insert(works: DataFrame, new: DataFrame, key: str = "id", unique: str = "toc_url") -> DataFrame:
    """works and new, the latter with ids after the largest. Rows whose unique column is taken are an error.

    Ids are numbered in order of `unique`, range by range.
    """
    taken = new.join(works.select(unique), unique, "left_semi").limit(1)
    repeated = new.groupBy(unique).count().where("count > 1")
    if taken.count() or repeated.limit(1).count():
        raise IllegalArgumentException(f"{unique} is not unique")
    last = works.agg(F.coalesce(F.max(key), F.lit(0)).cast("long").alias("_last"))
    numbered = placed(new.drop(key), [F.col(unique).asc()], "_n").crossJoin(F.broadcast(last))  # one row
    return works.unionByName(numbered.withColumn(key, F.col("_last") + F.col("_n")).drop("_last", "_n").select(works.columns))


def update(works: DataFrame, changed: DataFrame, key: str = "id") -> DataFrame:
    """Rows of changed instead of those of the same key; keys that works lacks change nothing."""
    known = changed.join(works.select(key), key, "left_semi").select(works.columns)
    return works.join(changed.select(key), key, "left_anti").select(works.columns).unionByName(known)


def upsert(works: DataFrame, changed: DataFrame, key: str = "id") -> DataFrame:
    """Rows of changed, and those of works of other keys: one shuffle of each by the key."""
    return works.join(changed.select(key), key, "left_anti").select(works.columns).unionByName(changed.select(works.columns))


def delete(works: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return works.join(keys.select(key), key, "left_anti").select(works.columns)


def delete_cascade(works: DataFrame, sections: DataFrame, keys: DataFrame, key: str = "id", foreign: str = "work_id") -> tuple[DataFrame, DataFrame]:
    """Works and their sections without those of the keys."""
    return delete(works, keys, key), sections.join(keys.select(F.col(key).alias(foreign)), foreign, "left_anti").select(sections.columns)


def display(works: DataFrame) -> DataFrame:
    """The columns of a list view, and the colour of the status."""
    status = F.when(F.coalesce("is_end", F.lit(False)), "完結").otherwise("連載中")
    colour = F.when(F.coalesce("is_end", F.lit(False)), "#428bca").otherwise("#5cb85c")
    shown = F.coalesce("general_all_no", F.lit(0)).alias("episodes")
    return works.select("id", "title", "author", F.coalesce("sitename", F.lit("")).alias("sitename"), shown, status.alias("status"), colour.alias("colour"))


def preview(titles: Column, shown: int = 5) -> Column:
    """The first titles by line, and how many more there are."""
    head = F.array_join(F.transform(F.slice(titles, 1, shown), lambda t: F.concat(F.lit("  - "), t)), "\n")
    more = F.size(titles) - shown
    return F.when(more > 0, F.concat(head, F.lit("\n  ... 他"), more.cast("string"), F.lit("件"))).otherwise(head)
