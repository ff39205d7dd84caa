"""Sharding by vector bin packing: bytes, tokens and rows of the shards are balanced jointly.

Rows of equal texts are a group. Groups are placed from the largest to the smallest, each where the dot product of its
sizes and the residual capacity is highest, among the shards that it overfills least. A group stays in one shard unless
it would overfill all of them by more than SPARE of a shard; only then is it split, into pieces of about 1 / CUTS of a
shard by the hash of the row's id.

Groups of more than 1 / PIECES of a shard are few whatever the input (at most 3 * shards * PIECES) and are placed first,
on the driver. The others are dealt to packers by hash; each packer has a share of what is left of every shard as its
capacity. As packers fill their own shares evenly, shards are even. Slots are counted by shard and deal, a hash of the row
of which there are as many as the rows ask for, and moved up by what is held before: no task numbers a whole shard.

Sizes: UTF-8 bytes of the text (null: none) plus one, runs of other than white space, and one a row. Null texts are equal
to empty ones, very long ones a group of one. Rows without id and rows that repeat one are rows like others; those of a
split group that have the same id stay together. Equal rows are told apart by nothing, so their slots are in any order.
An empty table gives an empty result. Columns of the table other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import cut

PIECES, CUTS, SPARE = 256, 32, 0.002
#: Groups that a packer gets on average, and rows of a deal.
GROUPS = 8192
MEASURES = ("size", "tokens", "n")


def place(sizes: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The shard of each item. sizes: a row of measures each; room: capacities, a row of measures a shard."""
    unit = np.maximum(room.sum(axis=0), 1e-9) / len(room)
    parts, left = sizes / unit, room / unit
    out = np.zeros(len(parts), np.int32)
    for i in np.argsort(-parts.max(axis=1), kind="stable"):
        over = np.maximum(0, parts[i] - left).max(axis=1)
        best = np.where(over <= over.min() + 1e-12, left @ parts[i], -np.inf).argmax()
        left[best] -= parts[i]
        out[i] = best
    return out


def too_large(sizes: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Which items have to be split, so that no shard gets more than SPARE beyond its room; pieces fill what is left."""
    unit = np.maximum(room.sum(axis=0), 1e-9) / len(room)
    parts, left = sizes / unit, room / unit
    out = np.zeros(len(parts), bool)
    for i in np.argsort(-parts.max(axis=1), kind="stable"):
        over = np.maximum(0, parts[i] - left).max(axis=1)
        if over.min() > SPARE:
            out[i] = True
        else:
            left[np.where(over <= over.min() + 1e-12, left @ parts[i], -np.inf).argmax()] -= parts[i]
    return out


def _packer(room: np.ndarray):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("digest", "ascending"), ("piece", "ascending")])
        sizes = np.column_stack([group.column(m).to_numpy().astype(float) for m in MEASURES])
        return group.select(["digest", "piece"]).append_column("shard", pa.array(place(sizes, room / room.sum(axis=0) * sizes.sum(axis=0)), pa.int32()))

    return run


def shard(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of df: id_col, size, text_crc32, shard, slot."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    tokens = F.greatest(F.size(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")), F.lit(1))
    rows = df.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        tokens.cast("long").alias("tokens"),
        F.xxhash64(text, F.lit(1)).alias("digest0"),
        F.xxhash64(F.reverse(text), F.octet_length(text)).alias("digest1"),
    ).withColumn("digest", F.concat_ws(":", F.hex("digest0"), F.hex("digest1")))
    rows = cut(rows.drop("digest0", "digest1"))
    groups = rows.groupBy("digest").agg(*(F.sum(F.lit(1) if m == "n" else F.col(m)).alias(m) for m in MEASURES))
    about = groups.agg(F.count("*").alias("groups"), *(F.sum(m).alias(m) for m in MEASURES)).first()
    if not about.groups:
        return rows.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    share = F.greatest(*(F.col(m) * (shards / about[m]) for m in MEASURES))  # of a shard
    many = groups.where(share > 1 / PIECES).withColumn("share", share).orderBy("digest").collect()  # 3 * shards * PIECES at most
    room = np.tile([about[m] / shards for m in MEASURES], (shards, 1))
    sizes = np.array([[float(r[m]) for m in MEASURES] for r in many]).reshape(len(many), len(MEASURES))
    cuts = [(r.digest, int(np.ceil(r.share * CUTS))) for r, large in zip(many, too_large(sizes, room), strict=True) if large]
    split = spark.createDataFrame(cuts, "digest string, pieces int")
    piece = F.coalesce(F.pmod(F.xxhash64("id", F.lit(7)), F.col("pieces")), F.lit(0)).cast("int")
    rows = rows.join(F.broadcast(split), "digest", "left").withColumn("piece", piece).drop("pieces")
    items = cut(rows.groupBy("digest", "piece").agg(*(F.sum(F.lit(1) if m == "n" else F.col(m)).alias(m) for m in MEASURES)))
    large = items.where(share > 1 / PIECES).orderBy("digest", "piece").collect()
    sizes = np.array([[float(r[m]) for m in MEASURES] for r in large]).reshape(len(large), len(MEASURES))
    first = place(sizes, room.copy())
    for i, s in enumerate(first):
        room[s] -= sizes[i]
    room = np.maximum(room, 1e-9 * room.max() + 1e-9)
    packers = max(1, round(about.groups / GROUPS))
    dealt = items.where(share <= 1 / PIECES).withColumn("packer", F.pmod(F.xxhash64("digest", "piece"), F.lit(packers)).cast("int"))
    placed = dealt.groupBy("packer").applyInArrow(_packer(room), "digest string, piece int, shard int")
    set_ = spark.createDataFrame([(r.digest, r.piece, int(s)) for r, s in zip(large, first, strict=True)], "digest string, piece int, shard int")
    placed = placed.unionByName(set_)
    done = cut(rows.join(placed, ["digest", "piece"]).withColumn("deal", F.pmod(F.xxhash64("id", "digest"), F.lit(max(1, round(about.n / GROUPS)))).cast("int")).select("id", "size", "text_crc32", "digest", "shard", "deal"))
    counts = done.groupBy("shard", "deal").agg(F.count("*").alias("held"))
    before = Window.partitionBy("shard").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select("shard", "deal", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "deal").orderBy("id", "digest")
    out = done.withColumn("place", F.row_number().over(within)).join(start, ["shard", "deal"])
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("start") + F.col("place") - 1).cast("long").alias("slot"))
