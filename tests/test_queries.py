import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from compare import differences

from quirefold import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_as_sql(spark, name):
    assert not differences(spark, queries.QUERIES[name], queries.SQL[name], DATA)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_driver_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 50
    assert set(queries.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_places_over_all_ranges(spark):
    from pyspark.sql import functions as F

    from quirefold.operators import catalog

    rows = [(i, None if i % 7 == 0 else i * 37 % 50) for i in range(1000)]
    works = spark.createDataFrame(rows, "id long, size int").repartition(5)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    kept = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        got = catalog.placed(works, [F.col("size").desc_nulls_last(), F.col("id").asc()]).collect()
    finally:
        spark.conf.set(name, kept)
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert sorted((r.place, r.id, r.size) for r in got) == [(k, *r) for k, r in enumerate(want, 1)]
    assert catalog.placed(works.limit(0), [F.col("id").asc()]).count() == 0
