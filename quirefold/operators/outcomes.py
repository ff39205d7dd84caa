"""What became of each work: a value or an error, and the counts of a run.

A step that can fail for one work gives rows with `error` (null: it went well), so the others go on. Errors are data: they are
joined, counted and stored like everything else, and a run ends with one row for each work.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OK, NONE, FAILED = "ok", "none", "failed"


def checked(df: DataFrame, checks: list[tuple[Column, str | Column]]) -> DataFrame:
    """df with `error`: the message of the first condition that doesn't hold, a null one included. What is in error already
    stays so, with its first message."""
    found = [F.when(F.coalesce(fine, F.lit(False)), F.lit(None)).otherwise(F.lit(m) if isinstance(m, str) else F.coalesce(m, F.lit("unknown"))) for fine, m in checks]
    before = [F.col("error")] if "error" in df.columns else []
    return df.withColumn("error", F.coalesce(*before, *found, F.lit(None).cast("string")))


def errors_by_work(rows: DataFrame, key: str = "work_id", order: str | None = None) -> DataFrame:
    """(key, error, n_errors) of the works that have rows in error: the first message, by `order` or else by itself."""
    bad = rows.where("error is not null")
    first = F.min(F.struct(F.col(order) if order else F.lit(0), "error"))["error"]
    return bad.groupBy(key).agg(first.alias("error"), F.count("*").alias("n_errors"))


def report(works: DataFrame, changed: DataFrame, failed: list[DataFrame], key: str = "work_id") -> DataFrame:
    """A row for each work: key, status (failed, else ok for works of `changed`, else none), error. failed: frames of key and
    error, in the order of their steps; of a work that fails twice the first step's error counts, of one step the smallest."""
    at = [f.select(key, F.lit(i).alias("step"), "error") for i, f in enumerate(failed)]
    rows = works.select(key).distinct().join(changed.select(key).distinct().withColumn("_changed", F.lit(True)), key, "left")
    if at:
        first = reduce(DataFrame.unionByName, at).where("error is not null").groupBy(key).agg(F.min(F.struct("step", "error"))["error"].alias("error"))
        rows = rows.join(first, key, "left")
    else:
        rows = rows.withColumn("error", F.lit(None).cast("string"))
    status = F.when(F.col("error").isNotNull(), FAILED).when(F.col("_changed"), OK).otherwise(NONE)
    return rows.select(key, status.alias("status"), "error")


def counters(reported: DataFrame) -> DataFrame:
    """One row: works, success (those that didn't fail), errors, changed."""
    of = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    failed = F.col("status") == FAILED
    return reported.agg(F.count("*").alias("works"), of(~failed).alias("success"), of(failed).alias("errors"), of(F.col("status") == OK).alias("changed"))
