"""Ranked lexical search over a bit-sliced impact index.

The weight that a term has in a document (its impact) is a whole number, so the impacts of a term in a block of documents
are slices: bitmap i holds bit i of every document's impact. The slices of an item's terms are added by bitwise carry
arithmetic, for all documents of the block at once, and the k highest sums are found by descending from the most
significant slice, without sorting. Ties at the last place go to smaller ids, as the documents of a block lie in their order.

- `count_terms`: terms and lengths of all documents (one pass over the texts, in Arrow batches, no shuffle);
- `build`: blocks of at most BLOCK documents, one row each, made where the documents lie;
- `top_k`: every item against every block, then the best of all blocks of an item.

Items are dealt to parts of about PAIRS (item, term) pairs, a bound on what is sent to the executors at once; each part has
its own pass, so any number of items works. Memory of a task: one block, and the longest text.

Nulls, ties, repeats: null and empty texts have no terms, nor do they count among the documents; a null id is last among
equal scores; rows that repeat an id are documents of their own; rows of one item_id are one item with all their terms, and
null is an item_id like others. Empty tables give no rows. Other columns of the tables are never read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import SLICE, cut

BLOCK = 8192
PAIRS = 200_000

#: Bytes of UTF-8: A-Z are lower-cased, what isn't a letter, a digit or beyond ASCII becomes a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

COUNTED = "doc_id long, n long, terms array<int>, tfs array<long>"
BLOCKS = "ids array<long>, terms array<int>, starts array<int>, words binary, n_slices int, slices binary"
CODEC = "zstd"


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order, with repeats."""
    return text.translate(_FOLD).split() if text else []


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term) of all items, each pair once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(i, t) for i, x in zip(*(c.to_pylist() for c in batch.columns), strict=True) for t in set(terms_of(x))]
            yield pa.record_batch({"item_id": pa.array([i for i, _ in pairs], pa.int64()), "term": pa.array([t for _, t in pairs], pa.binary())})

    found = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("binary").alias("text"))
    return found.mapInArrow(run, "item_id long, term binary").distinct()


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs) of every document: all its terms counted in n, those of the vocabulary by number in terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            n, terms, tfs = [], [], []
            for text in batch.column(1):
                found = terms_of(text.as_py())
                n.append(len(found))
                counts = Counter(map(number, found))
                counts.pop(None, None)
                terms.append(list(counts))
                tfs.append(list(counts.values()))
            yield pa.record_batch({"doc_id": batch.column(0), "n": pa.array(n, pa.int64()), "terms": pa.array(terms, pa.list_(pa.int32())), "tfs": pa.array(tfs, pa.list_(pa.int64()))})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, COUNTED)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _block(table: pa.Table, weights: np.ndarray, n_docs: int, n_terms: int) -> pa.RecordBatch:
    """One row: the slices of all terms in these documents. Columns of the slices are 64-bit words of the bitmaps that aren't
    zero; `words` tells which."""
    ids, n, terms, tfs = (table.column(i).combine_chunks() for i in range(4))
    order = np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    doc = np.repeat(np.arange(len(order)), terms.value_lengths().to_numpy())
    term, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
    m = 50 + (50 * n.to_numpy() * n_docs) // n_terms
    impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
    at = place[doc]
    by = np.lexsort((at, term))
    term, at, impact = term[by], at[by], impact[by].astype(np.uint64)
    word = at >> 6
    first = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(word) != 0)])
    bit = np.uint64(1) << (at & 63).astype(np.uint64)
    n_slices = max(1, int(impact.max()).bit_length())
    slices = np.empty((n_slices, len(first)), np.uint64)
    for i in range(n_slices):
        slices[i] = np.bitwise_or.reduceat(np.where((impact >> np.uint64(i)) & np.uint64(1), bit, np.uint64(0)), first)
    own = np.flatnonzero(np.r_[True, np.diff(term[first]) != 0])
    row = [
        [ids.take(pa.array(order)).to_pylist()],
        [term[first][own]],
        [own],
        [word[first].astype(np.uint32).tobytes()],
        [n_slices],
        [pa.Codec(CODEC).compress(slices.tobytes(), asbytes=True)],
    ]
    types = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.int32(), pa.binary()]
    names = ["ids", "terms", "starts", "words", "n_slices", "slices"]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], names=names)


def build(counted: DataFrame, weights: list[int], n_docs: int, n_terms: int) -> DataFrame:
    """The index (BLOCKS) of count_terms' rows. weights: of each term of the vocabulary, by number; n_docs: documents that
    have terms; n_terms: all their terms."""
    by_term = np.asarray(weights, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                part, batch = batch.slice(0, BLOCK - rows), batch.slice(BLOCK - rows)
                held.append(part)
                rows += part.num_rows
                if rows == BLOCK:
                    yield _block(pa.Table.from_batches(held), by_term, n_docs, n_terms)
                    held, rows = [], 0
        if held:
            yield _block(pa.Table.from_batches(held), by_term, n_docs, n_terms)

    return counted.where("size(terms) > 0").mapInArrow(run, BLOCKS)


def slices_of(words: np.ndarray, part: np.ndarray, n_words: int) -> list[int]:
    """The slices of a term, least significant first, each a whole number whose bits are documents."""
    wide = np.zeros((len(part), n_words), "<u8")
    wide[:, words] = part
    return [int.from_bytes(x.tobytes(), "little") for x in wide]


def add(total: list[int], part: list[int]) -> None:
    """Add part to total, for all documents at once: bit by bit, with the carries of all of them in one bitmap."""
    carry = 0
    for i, b in enumerate(part):
        if i == len(total):
            total.append(0)
        a = total[i]
        odd = a ^ b
        total[i], carry = odd ^ carry, a & b | odd & carry
    i = len(part)
    while carry:
        if i == len(total):
            total.append(0)
        total[i], carry = total[i] ^ carry, total[i] & carry
        i += 1


def places(bits: int, most: int) -> Iterator[int]:
    """The lowest bits that are set, so many at most."""
    while bits and most:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low
        most -= 1


def best(total: list[int], k: int) -> list[tuple[int, int]]:
    """(place, sum) of the k highest sums above 0, in no order; of equal ones at the end, the lowest places."""
    sure, tied = 0, reduce(int.__or__, total, 0)
    for s in reversed(total):
        more = sure | tied & s
        n = more.bit_count()
        if n > k:
            tied &= s
        else:
            sure, tied = more, tied & ~s
    found = [*places(sure, k), *places(tied, k - sure.bit_count())]
    return [(p, sum((s >> p & 1) << i for i, s in enumerate(total))) for p in found]


def top_k(blocks: DataFrame, items: list[tuple[int | None, list[int]]], k: int) -> DataFrame:
    """(item_id, doc_id, score) of the k best documents of every block for every item (its id, numbers of its terms)."""
    shared = blocks.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            ids, terms, starts, words, n_slices, slices = (c[0].as_py() for c in row.columns)
            words = np.frombuffer(words, np.uint32)
            slices = np.frombuffer(pa.Codec(CODEC).decompress(slices, decompressed_size=8 * n_slices * len(words), asbytes=True), np.uint64).reshape(n_slices, -1)
            ends, n_words = [*starts[1:], len(words)], -(-len(ids) // 64)
            held = {t: slices_of(words[a:b], slices[:, a:b], n_words) for t, a, b in zip(terms, starts, ends, strict=True)}
            out: list[tuple[int | None, int | None, int]] = []
            for item, numbers in shared.value:
                total: list[int] = []
                for t in numbers:
                    if t in held:
                        add(total, held[t])
                out += [(item, ids[p], score) for p, score in best(total, k)]
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.record_batch({c: pa.array(x, pa.int64()) for c, x in zip(("item_id", "doc_id", "score"), columns, strict=True)})

    return blocks.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the k documents of the highest scores above 0, all if there are fewer."""
    pairs = cut(item_terms(items))
    parts = -(-pairs.count() // PAIRS)
    found = None
    for part in range(parts):
        own = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).groupBy("item_id").agg(F.collect_list("term").alias("terms"))
        asked = [(r.item_id, [bytes(t) for t in r.terms]) for r in own.collect()]  # about PAIRS terms
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in asked for t in terms}))}
        counted = cut(count_terms(docs, vocabulary))
        n_docs, n_terms = counted.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = dict(counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # of the vocabulary
        weights = [weight(n_docs, df.get(i, 0)) for i in range(len(vocabulary))]
        numbered = [(item, [vocabulary[t] for t in terms]) for item, terms in asked]
        ranked = top_k(build(counted, weights, n_docs, n_terms), numbered, k)
        found = ranked if found is None else found.unionByName(ranked)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
