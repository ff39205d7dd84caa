"""Which episodes of a new snapshot are new or changed against an old one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.operators import outcomes

#: Rows of the old snapshot that are broadcast at most; beyond, both are shuffled by the keys.
BROADCAST = 100_000


def dated(row: str) -> Column:
    """subupdate, or subdate where that is empty."""
    return F.coalesce(F.nullif(F.col(f"{row}.subupdate"), F.lit("")), F.col(f"{row}.subdate"), F.lit(""))


def snapshot_diff(new: DataFrame, old: DataFrame, keys: tuple[str, ...] = ("work_id", "index"), ordinal: str = "ordinal", force: bool = False, changed_only: bool = True, old_rows: int | None = None) -> DataFrame:
    """Rows of new with a reason: new, title, chapter or date (the later one as text), the first that holds; null for
    rows that are the same, which are left out unless changed_only is off. Rows that only old has are ignored; of rows
    that repeat a key in old the last one counts. force: all rows are new.

    old_rows: how many rows old has, if known; up to BROADCAST of them are broadcast.
    """
    if force:
        return new.withColumn("reason", F.lit("new"))
    held = ("subtitle", "chapter", "subdate", "subupdate")
    last = old.groupBy(*keys).agg(F.max_by(F.struct(*held), F.col(ordinal)).alias("was"))
    last = last.select(*keys, F.lit(True).alias("known"), "was.*")
    if old_rows is not None and old_rows <= BROADCAST:
        last = F.broadcast(last)
    n, o = new.alias("n"), last.alias("o")
    on = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    other = lambda c: ~F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    reason = F.when(F.col("o.known").isNull(), "new").when(other("subtitle"), "title").when(other("chapter"), "chapter").when(dated("n") > dated("o"), "date")
    out = n.join(o, on, "left").select("n.*", reason.alias("reason"))
    return out.where("reason is not null") if changed_only else out


def run_status(judged: DataFrame, known: DataFrame, key: str = "work_id", failed: DataFrame | None = None) -> DataFrame:
    """A row for each work of judged (snapshot_diff of all rows): episodes, changed, is_new, new_arrivals, status. Works of
    `failed` (key, error) are there too, with status failed, nothing new, and their error in a column of its own."""
    sums = judged.groupBy(key).agg(F.count("*").alias("episodes"), F.count("reason").alias("changed"))
    old = known.select(key).distinct().withColumn("_known", F.lit(True))
    rows = sums
    if failed is not None:
        first = failed.where("error is not null").groupBy(key).agg(F.min("error").alias("error"))
        rows = sums.join(first, key, "full").withColumns({"episodes": F.coalesce("episodes", F.lit(0)), "changed": F.coalesce("changed", F.lit(0))})
    rows = rows.join(old, key, "left").withColumn("is_new", F.col("_known").isNull()).drop("_known")
    arrived = F.col("is_new") | (F.col("changed") > 0)
    if failed is not None:
        arrived = arrived & F.col("error").isNull()
    status = F.when(arrived, outcomes.OK).otherwise(outcomes.NONE)
    if failed is not None:
        status = F.when(F.col("error").isNotNull(), outcomes.FAILED).otherwise(status)
    rows = rows.withColumns({"new_arrivals": arrived, "status": status})
    return rows if failed is None else rows.select(*[c for c in rows.columns if c != "error"], "error")


def progress(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(done * 100 / total)).otherwise(0).cast("int")
