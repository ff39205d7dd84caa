"""Connected components of links: union-find inside partitions, then alternating stars between them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import cut


def spanning(pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, smallest node of its group) for each node that isn't the smallest itself."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = parent[min(a, b)] = min(a, b)
    return [(x, find(x)) for x in list(parent) if find(x) != x]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition become a spanning forest; kept small by doing so again and again."""
    held: list[tuple[int, int]] = []
    for batch in batches:
        held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        if len(held) > 500_000:
            held = spanning(held)
    held = spanning(held)
    yield pa.record_batch({"u": pa.array([x for x, _ in held], pa.int64()), "v": pa.array([x for _, x in held], pa.int64())})


def components(links: DataFrame, name: str = "component") -> DataFrame:
    """(id, name) of all nodes of links (two long columns): the smallest node that links reach.

    Nodes without links are not in the result; links with a null are none.
    """
    a, b = links.columns
    forest = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").mapInArrow(_local, "u long, v long")
    edges = cut(forest.distinct())  # from a node to a smaller one
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen:
            break
        seen = mark
        # A node gives its larger neighbours its smallest one, if it has a smaller one. The lists of smallest ones are
        # written before they are joined: neighbours of a hub are rows of one key then, which Spark can split.
        up = cut(edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m")))
        large = cut(edges.join(up, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct())
        # each node gives itself and its smaller neighbours the smallest of these
        down = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct())
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias(name)).unionByName(roots.select("id", F.col("id").alias(name)))
