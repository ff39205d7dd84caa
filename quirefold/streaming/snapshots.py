"""An extension: snapshots of tables of contents as a stream, each batch compared with what is kept and put in its place."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quirefold.operators.diff import snapshot_diff
from quirefold.sources.versions import BUCKETS, Versions

KEYS = ["work_id", "index"]


def follow(stream: DataFrame, schema: T.StructType, state: str, changes: str, checkpoint: str, n_buckets: int = BUCKETS) -> StreamingQuery:
    """Runs through what is there. state: the kept snapshot, in buckets of works with versions; changes: rows with a reason, a
    folder for each batch.

    A batch reads and writes the buckets of its own works only, so its cost follows them and not all that is kept. The state
    notes which batch it has: one that is run again after that changes nothing, one that died before is done anew and
    writes the same. Versions before the last two go.
    """
    writer = md5(checkpoint.encode()).hexdigest()

    def step(batch: DataFrame, number: int) -> None:
        kept = Versions(batch.sparkSession, state, schema, n_buckets=n_buckets)
        if kept.done(writer, number):
            return
        rows = batch.dropDuplicates(KEYS).select(schema.names).persist()
        old = kept.read(buckets=kept.touched(rows))
        snapshot_diff(rows, old).write.mode("overwrite").parquet(f"{changes}/batch={number}")
        kept.upsert(rows, KEYS, writer, number)
        kept.vacuum()
        rows.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_snapshot(spark, state: str, schema: T.StructType) -> DataFrame:
    """What follow() keeps, after its last whole batch."""
    return Versions(spark, state, schema).read()
