"""What the operators of this subpackage share: appending columns over Arrow, and cutting lineage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quirefold.sources.shared import cut, shared_dir  # noqa: F401, for the operators


#: Rows that are worked on at once.
SLICE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def append_by_arrow(
    df: DataFrame,
    fields: list[T.StructField],
    build: Callable[[], Callable[[list[pa.Array]], list[pa.Array]]],
    inputs: list[str],
    keep: list[str] | None = None,
    rows: int = SLICE,
) -> DataFrame:
    """df's columns `keep` (all, if None) and `fields`, computed from the columns `inputs` in Arrow, so many rows
    at once.

    build() runs once a task and returns the function of a batch. A kept column that has the name of a new one is
    replaced, as withColumn does.
    """
    new = {f.name for f in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])
    target = to_arrow_schema(schema, prefers_large_types=False)
    fed = [*keep, *(c for c in inputs if c not in keep)]
    at = [fed.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = build()
        for batch in (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows)):
            made = compute([batch.column(i) for i in at])
            columns = [*batch.columns[: len(keep)], *made]
            yield pa.RecordBatch.from_arrays(
                [c if c.type == t.type else c.cast(t.type) for c, t in zip(columns, target, strict=True)], schema=target
            )
        pa.default_memory_pool().release_unused()  # Spark keeps the worker for the stages to come

    return df.select(*[df[f"`{c}`"] for c in fed]).mapInArrow(run, schema)
