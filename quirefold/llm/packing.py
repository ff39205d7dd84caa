"""Best-fit packing of documents into sequences of `capacity` tokens, under conflicts.

A document takes its words (runs of other than white space) and one end token. Longer ones are cut into pieces of
`capacity`; nothing is dropped. No two pieces of one source, of one cluster of duplicates or of one document share a bin:
bins carry bitmaps of the sources and clusters in them. Bins are ordered by what is left of them; the search for a piece
starts at the first bin that it fits into and goes on to the next larger ones until a compatible one is found, so that
this is the tightest; if there is none, a bin is opened. Larger pieces come first.

Pieces are dealt by the hash of all their columns, so a hot source or cluster is spread evenly, to as many blocks as
their number asks for (BLOCK each, on average); a task packs one block at a time. The pieces of bins that are left less
than FULL are packed once more, together with those of other blocks. Bins and their numbers follow from the rows alone,
whatever the partitions.

Rows without source or cluster conflict with none by it; null and empty texts take one token, very long ones many
pieces. Rows that repeat an id are documents each; equal ones have equal clusters and stay apart. An empty table gives no
pieces. Columns of the table other than id, text and source are not read, whatever their names.

A cluster is one of equal texts, or, with near_clusters, what links between texts that are alike reach.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.llm import minhash
from quirefold.llm.common import append_by_arrow, cut

CAPACITY = 2048
BLOCK = 4096
FULL = 0.95
COLUMNS = ["id", "piece", "first_token", "n_tokens", "source", "cluster"]


def pack(pieces: list[tuple[int, str | None, int | None]], capacity: int) -> list[tuple[int, int]]:
    """(bin, first token in it) of each piece; pieces: tokens, source, cluster."""
    source_bit: dict = {None: 0}
    cluster_bit: dict = {None: 0}
    bins: list[tuple[int, int]] = []  # (what is left, number)
    sources: list[int] = []
    clusters: list[int] = []
    out = [(0, 0)] * len(pieces)
    for i in sorted(range(len(pieces)), key=lambda i: -pieces[i][0]):
        n, source, cluster = pieces[i]
        s = source_bit.setdefault(source, 1 << len(source_bit))
        c = cluster_bit.setdefault(cluster, 1 << len(cluster_bit))
        for at in range(bisect_left(bins, (n, -1)), len(bins)):
            left, b = bins[at]
            if not sources[b] & s and not clusters[b] & c:
                del bins[at]
                break
        else:
            left, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= s
        clusters[b] |= c
        out[i] = (b, capacity - left)
        if left > n:
            insort(bins, (left - n, b))
    return out


def _packer(capacity: int, turn: int):
    def run(block: pa.Table) -> pa.Table:
        """One block: its pieces with bins of their own; `fill` is what a bin holds in all."""
        block = block.sort_by([(c, "ascending") for c in ["deal", *COLUMNS]])
        placed = pack(list(zip(*(block.column(c).to_pylist() for c in ("n_tokens", "source", "cluster")), strict=True)), capacity)
        bins, offsets = (np.array(x, np.int64) for x in zip(*placed, strict=True))
        fill = np.bincount(bins, block.column("n_tokens").to_numpy()).astype(np.int32)
        first = (turn << 62) + (block.column("block")[0].as_py() << 24)
        block = block.select([*COLUMNS, "deal"]).append_column("bin_id", pa.array(first + bins, pa.int64()))
        return block.append_column("bin_offset", pa.array(offsets, pa.int32())).append_column("fill", pa.array(fill[bins], pa.int32()))

    return run


def in_bins(pieces: DataFrame, capacity: int, turn: int) -> DataFrame:
    """pieces (with `deal`) with bin_id, bin_offset and fill, packed in blocks that their number and hashes give."""
    blocks = max(1, round(pieces.count() / BLOCK))
    dealt = pieces.withColumn("block", F.pmod("deal", F.lit(blocks)).cast("long"))
    schema = "id long, piece int, first_token int, n_tokens int, source string, cluster long, deal long, bin_id long, bin_offset int, fill int"
    return cut(dealt.groupBy("block").applyInArrow(_packer(capacity, turn), schema))


def word_counts(texts: pa.Array) -> np.ndarray:
    """Runs of other than ASCII white space in each text; none in null."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[0] == offsets[-1]:
        return np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    begins = offsets - offsets[0]
    word = ~minhash.SPACES[data]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    at = begins[:-1][begins[:-1] < len(data)]
    starts[at] = word[at]
    before = np.concatenate([[0], np.cumsum(starts)])
    return before[begins[1:]] - before[begins[:-1]]


def text_cluster(text: Column) -> Column:
    """A cluster number of equal texts."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_clusters(df: DataFrame, text_col: str = "text", similarity: int = minhash.SIMILARITY) -> DataFrame:
    """(cluster, near): the smallest text_cluster among the near copies of a text, for texts where it is not their own.

    Texts stand for themselves here, so rows without id, or of an id that other rows have, are judged as all others.
    """
    texts = df.select(text_cluster(F.col(text_col)).alias("id"), F.col(text_col).alias("text"))
    found = minhash.near_duplicates(texts, "id", "text", similarity).where("component_id <> id")
    return cut(found.select(F.col("id").alias("cluster"), F.col("component_id").alias("near")).distinct())


def best_fit(df: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: Column | None = None, near: DataFrame | None = None) -> DataFrame:
    """One row a piece: id_col, piece, first_token, n_tokens, source, cluster, bin_id, bin_offset.

    near: near_clusters(df), for clusters of near copies and not of equal texts only.
    """
    cluster = text_cluster(F.col(text_col)) if cluster is None else cluster
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), cluster.cast("long").alias("cluster"), F.col(text_col).cast("string").alias("text"))
    rows = append_by_arrow(rows, [T.StructField("tokens", T.LongType())], lambda: lambda c: [pa.array(word_counts(c[0]) + 1)], ["text"], keep=["id", "source", "cluster"])
    if near is not None:
        near = F.broadcast(near) if near.count() <= minhash.BROADCAST else near
        rows = rows.join(near, "cluster", "left").withColumn("cluster", F.coalesce("near", "cluster")).drop("near")
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / capacity).cast("int"))))
    first = (F.col("piece") * capacity).cast("int")
    pieces = pieces.select("id", "piece", first.alias("first_token"), F.least(F.col("tokens") - first, F.lit(capacity)).cast("int").alias("n_tokens"), "source", "cluster")
    pieces = cut(pieces.withColumn("deal", F.xxhash64("id", "piece", "n_tokens", "source", "cluster")))
    packed = in_bins(pieces, capacity, 0)
    loose = F.col("fill") < FULL * capacity
    again = in_bins(packed.where(loose).select(*COLUMNS, F.xxhash64("deal").alias("deal")), capacity, 1)
    done = packed.where(~loose).unionByName(again)
    return done.select(*COLUMNS, "bin_id", "bin_offset").withColumnRenamed("id", id_col)
