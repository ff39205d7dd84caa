"""Exact top-k search by inner product in paged M-trees, best first.

Vectors are turned into whole numbers (floor of SCALE times each component). A component sqrt(M - |x|^2) is added to
each, M being the largest squared length of all: the nearest vectors of a query (with 0 there) are then those of the
highest inner product. Distinct vectors are dealt to regions by their nearest root routing vector (at most ROOTS of them,
those of the smallest hashes), and a region to blocks of about BLOCK_ROWS by hash. Each block is bulk-loaded into an
M-tree whose pages hold routing vectors with covering radii and distances to the parent's routing vector.

A query first searches one block of its nearest region. The k-th score found there is its bound elsewhere: it is sent to
the blocks of those regions only that the bound and their radii can't rule out. A block is searched by all its queries
together: in each round every query opens its best pages, those of the least possible distance, twice as many as in the
round before. The triangle inequality with stored distances rules pages and vectors out before distances to them are
computed; what is left of a page is one matrix product for all queries that open it. The search ends when no page can
beat a k-th score. Rounding is allowed for in all bounds, and scores are whole numbers, so ties are exact.

Equal vectors are one entry that keeps its k + 1 smallest ids: no query can return more of them. The same holds for
queries: one search serves all queries of a vector, with one result more than asked for, from which each drops itself.
Ids that have several vectors search by themselves and leave out their own rows.

Edge cases: vectors that are null or hold a null or non-finite component (also after scaling) take no part; empty ones
do, and shorter ones count as filled with zeros. Scores beyond the range of a long are given and ranked as the nearest
long. Rows that repeat an id count as one vector each; a query leaves out all rows of its id and ranks what all its
vectors find together. Rows without id take no part. An empty table gives an empty result. Columns of the table other
than id and vector are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import cut

SCALE = 64
BLOCK_ROWS, QUERY_ROWS, ROOTS = 16_384, 8192, 256
PAGE, FAN = 128, 16
#: Products below this are exact in doubles.
EXACT = float(1 << 52)
#: Of the square of the lengths: what rounding can add to squared distances and to products beyond EXACT, with room.
ROUNDING = 1e-11
LONG = (1 << 63) - 1
#: Hits that a block's search holds before all but the best are dropped.
HELD = 2_000_000
#: Numbers of queries that go to regions in one batch.
SENT = 2_000_000


class Page:
    """A page of the tree. Leaves hold rows of vectors, others numbers of pages; both with distances to the page's routing
    vector (leaves in their order)."""

    __slots__ = ("children", "distances", "radii", "radius", "route", "routes", "rows")


def lifted(whole: np.ndarray, largest: float) -> np.ndarray:
    lengths = np.einsum("ij,ij->i", whole, whole)
    return np.column_stack([whole, np.sqrt(np.maximum(0.0, largest - lengths))])


def between(points: np.ndarray, others: np.ndarray, largest: float) -> np.ndarray:
    """Distances of lifted vectors, all of which have the length sqrt(largest)."""
    return np.sqrt(np.maximum(0.0, 2 * (largest - points @ others.T)))


def bulk_load(points: np.ndarray, largest: float) -> list[Page]:
    """The pages of a tree over lifted vectors, the root first; routing vectors are vectors of the block."""
    draw = np.random.default_rng(1)
    pages: list[Page] = []

    def load(rows: np.ndarray, route: int) -> int:
        page, number = Page(), len(pages)
        pages.append(page)
        away = between(points[rows], points[route : route + 1], largest)[:, 0]
        page.route, page.radius, page.rows, page.children = route, float(away.max()), None, None
        parts = []
        if len(rows) > PAGE and page.radius > 0:
            picks = draw.choice(rows, min(FAN, max(2, len(rows) // PAGE)), replace=False)
            near = between(points[rows], points[picks], largest).argmin(axis=1)
            parts = [(p, rows[near == i]) for i, p in enumerate(picks) if (near == i).any()]
        if len(parts) < 2:
            order = np.argsort(away, kind="stable")
            page.rows, page.distances = rows[order], away[order]
            return number
        page.children = np.array([load(part, p) for p, part in parts])
        page.routes = np.array([p for p, _ in parts])
        page.radii = np.array([pages[c].radius for c in page.children])
        page.distances = between(points[page.routes], points[route : route + 1], largest)[:, 0]
        return number

    load(np.arange(len(points)), 0)
    return pages


class Hits:
    """The best of what queries find: (query, row, score), ties to the row of the smaller first id."""

    def __init__(self, k: int, first: np.ndarray):
        self.k, self.first, self.parts, self.n = k, first, [], 0

    def add(self, queries: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
        self.parts.append((queries, rows, scores))
        self.n += len(rows)
        if self.n > HELD:
            kept = self.best()
            self.parts, self.n = [kept], min(len(kept[0]), HELD // 2)

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return (np.zeros(0, np.int64),) * 3
        queries, rows, scores = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((self.first[rows], ~scores, queries))  # ~x falls as x grows, without leaving the range
        queries, rows, scores = queries[order], rows[order], scores[order]
        starts = np.flatnonzero(np.concatenate([[True], queries[1:] != queries[:-1]]))
        place = np.arange(len(queries)) - np.repeat(starts, np.diff(np.append(starts, len(queries))))
        return tuple(x[place < self.k] for x in (queries, rows, scores))


def search(whole: np.ndarray, first: np.ndarray, queries: np.ndarray, bound: np.ndarray, k: int, largest: float, unit: float = 1.0, sole=None, own=None) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]:
    """Queries, rows and scores of each query's k best rows that reach its bound, and how many products were computed.

    whole, queries: components divided by unit; largest: of whole's squared lengths, or more. Rows whose `sole` is a
    query's `own` (both None for none) aren't results of it.
    """
    pages = bulk_load(lifted(whole, largest), largest)
    lengths = np.sqrt(np.einsum("ij,ij->i", whole, whole))
    norms = np.einsum("ij,ij->i", queries, queries)
    reach = np.sqrt(norms)
    slack = 4 * np.sqrt(ROUNDING * (norms + largest))
    n, computed = len(queries), 0
    top = np.full((n, k), -np.inf)
    kth = bound / unit / unit
    least, away = np.full((2, n, len(pages)), np.inf)
    end = float(LONG) / unit / unit

    def products(qs: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
        """Inner products and the error that they can have."""
        nonlocal computed
        computed += len(qs) * len(rows)
        sizes = np.outer(reach[qs], lengths[rows])
        error = 0.0 if unit == 1 and (not sizes.size or sizes.max() < EXACT) else np.where((sizes < EXACT) & (unit == 1), 0.0, ROUNDING * sizes)
        return queries[qs] @ whole[rows].T, error

    def distances(qs: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, norms[qs, None] + largest - 2 * products(qs, rows)[0]))

    def limits(qs: np.ndarray) -> np.ndarray:
        """Distances up to which rows can still reach the k-th score."""
        return np.sqrt(np.maximum(0.0, norms[qs] + largest - 2 * kth[qs])) + slack[qs]

    def exact(q: int, row: int) -> int:
        score = sum(int(a) * int(b) for a, b in zip(queries[q] * unit, whole[row] * unit, strict=True))
        return max(-LONG - 1, min(LONG, score))

    def open_inner(page: Page, qs: np.ndarray, d: np.ndarray) -> None:
        limit = limits(qs)[:, None]
        fit = np.abs(page.distances - d[:, None]) - page.radii <= limit
        some = np.flatnonzero(fit.any(axis=0))
        to = distances(qs, page.routes[some])
        low = np.maximum(0.0, to - page.radii[some])
        numbers = page.children[some]
        least[np.ix_(qs, numbers)] = np.where(fit[:, some] & (low <= limit), low, np.inf)
        away[np.ix_(qs, numbers)] = to

    def open_leaf(page: Page, qs: np.ndarray, d: np.ndarray) -> None:
        limit = limits(qs)
        lo = np.searchsorted(page.distances, (d - limit).min(), "left")
        hi = np.searchsorted(page.distances, (d + limit).max(), "right")
        rows = page.rows[lo:hi]
        if not len(rows):
            return
        scores, error = products(qs, rows)
        low, high = np.clip(scores - error, -end, end), np.clip(scores + error, -end, end)
        if own is not None:
            hidden = (own[qs, None] == sole[rows]) & (own[qs, None] != None)  # noqa: E711, of all elements
            low, high = np.where(hidden, -np.inf, low), np.where(hidden, -np.inf, high)
        fit = (high >= kth[qs, None]) & (high > -np.inf)
        a, b = np.nonzero(fit)
        if not len(a):
            return
        if np.isscalar(error):
            found = scores[a, b].astype(np.int64)
        else:
            found = np.array([exact(q, r) for q, r in zip(qs[a], rows[b])], np.int64)
        hits.add(qs[a], rows[b], found)
        changed = np.flatnonzero(fit.any(axis=1))
        better = np.concatenate([top[qs[changed]], np.where(fit[changed], low[changed], -np.inf)], axis=1)
        top[qs[changed]] = np.partition(better, better.shape[1] - k, axis=1)[:, -k:]
        kth[qs[changed]] = np.maximum(kth[qs[changed]], top[qs[changed]].min(axis=1))

    hits = Hits(k, first)
    every = np.arange(n)
    away[:, 0] = distances(every, np.array([pages[0].route]))[:, 0]
    least[:, 0] = np.maximum(0.0, away[:, 0] - pages[0].radius)
    width = 1
    while True:
        least[least > limits(every)[:, None]] = np.inf
        if not np.isfinite(least).any():
            return hits.best(), computed
        width = min(width, len(pages))
        chosen = np.argpartition(least, width - 1, axis=1)[:, :width]
        asked, numbers = np.repeat(every, width), chosen.ravel()
        real = np.isfinite(least[asked, numbers])
        asked, numbers = asked[real], numbers[real]
        order = np.lexsort((asked, least[asked, numbers], numbers))
        asked, numbers = asked[order], numbers[order]
        for part in np.split(np.arange(len(asked)), np.flatnonzero(np.diff(numbers)) + 1):
            number, qs = numbers[part[0]], np.sort(asked[part])
            qs = qs[least[qs, number] <= limits(qs)]
            least[asked[part], number] = np.inf
            if len(qs):
                (open_leaf if pages[number].children is None else open_inner)(pages[number], qs, away[qs, number])
        width *= 2


def whole_numbers(vector: Column) -> Column:
    """floor(SCALE * x) of each component as a double; null if the vector takes no part."""
    scaled = F.transform(vector, lambda x: x.cast("double") * SCALE)
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x))
    fine = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)), whole)


def matrix(column: pa.ChunkedArray | pa.Array, width: int, unit: float) -> np.ndarray:
    """Lists as rows, short ones filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    out, sizes = np.zeros((len(column), width)), np.diff(offsets)
    at = np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0], sizes)
    out[np.repeat(np.arange(len(column)), sizes), at] = values[offsets[0] : offsets[-1]] / unit
    return out


class Space:
    """What all tasks know: dimensions, the largest squared length, the root's routing vectors and their radii."""

    def __init__(self, width: int, largest: float, unit: float, roots: np.ndarray):
        self.width, self.largest, self.unit, self.roots = width, largest, unit, roots
        self.radii, self.empty = np.zeros(len(roots)), np.zeros(len(roots), bool)

    def distances(self, vectors: np.ndarray, stored: bool) -> np.ndarray:
        """To the root's routing vectors: of stored vectors, or of queries."""
        if stored:
            return between(lifted(vectors, self.largest), lifted(self.roots, self.largest), self.largest)
        norms = np.einsum("ij,ij->i", vectors, vectors)
        return np.sqrt(np.maximum(0.0, norms[:, None] + self.largest - 2 * vectors @ self.roots.T))

    def assign(self, stored: bool):
        """Batches with `region` and `away`, the nearest routing vector and the distance to it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                to = self.distances(matrix(batch.column("vector"), self.width, self.unit), stored)
                to[:, self.empty] = np.inf
                near = to.argmin(axis=1) if len(to) else np.zeros(0, np.int64)
                made = [pa.array(near, pa.int32()), pa.array(to[np.arange(len(to)), near], pa.float64())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "region", "away"])

        return run

    def reachable(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for each region that its bound can't rule out; batches of about SENT numbers, as each has the vectors."""
        n = max(1, SENT // max(1, self.width * len(self.roots)))
        for batch in (b.slice(i, n) for b in batches for i in range(0, b.num_rows, n)):
            vectors = matrix(batch.column("vector"), self.width, self.unit)
            bound = batch.column("bound").to_numpy(zero_copy_only=False).astype(float)
            bound = np.where(np.isnan(bound), -np.inf, lower(bound) / self.unit / self.unit)
            norms = np.einsum("ij,ij->i", vectors, vectors)
            limit = np.sqrt(np.maximum(0.0, norms + self.largest - 2 * bound)) + 4 * np.sqrt(ROUNDING * (norms + self.largest))
            asked, regions = np.nonzero(self.distances(vectors, False) - self.radii <= limit[:, None])
            out = batch.drop_columns(["region"]).take(pa.array(asked))
            yield out.append_column("region", pa.array(regions, pa.int32()))


def lower(scores: np.ndarray) -> np.ndarray:
    """Doubles that are no larger than the whole numbers they stand for."""
    return np.where(np.abs(scores) < EXACT, scores, scores - np.abs(scores) * 1e-15)


def _searcher(space: Space, k: int):
    def run(group: pa.Table) -> pa.Table:
        """One block of vectors and queries of it: (unit, id, score) of the k best entries of each query."""
        asked = group.column("asked").to_numpy()
        stored, queries = group.filter(pa.array(~asked)), group.filter(pa.array(asked))
        out = {"unit": [], "id": [], "score": []}
        if len(stored) and len(queries):
            ids = stored.column("ids").to_pylist()
            first, sole = np.array([x[0] for x in ids]), np.array([x[0] if len(x) == 1 else None for x in ids], object)
            bound = queries.column("bound").to_numpy().astype(float)
            bound = np.where(np.isnan(bound), -np.inf, lower(bound))
            own = queries.column("own").to_pylist()
            alone = {} if own.count(None) == len(own) else dict(sole=sole, own=np.array(own, object))
            whole, at = (matrix(t.column("vector"), space.width, space.unit) for t in (stored, queries))
            (qs, rows, scores), _ = search(whole, first, at, bound, k, space.largest, space.unit, **alone)
            units = queries.column("unit").to_pylist()
            for q, r, s in zip(qs.tolist(), rows.tolist(), scores.tolist()):
                for i in ids[r]:
                    if i != own[q]:
                        out["unit"].append(units[q])
                        out["id"].append(i)
                        out["score"].append(s)
        return pa.table({"unit": pa.array(out["unit"], pa.string()), "id": pa.array(out["id"], pa.int64()), "score": pa.array(out["score"], pa.int64())})

    return run


def top_k(df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each row of df where `queries` holds: its k best other rows, ties to smaller ids."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), whole_numbers(F.col(vector_col)).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asked"))
    rows = rows.where("id is not null and vector is not null").withColumn("key", F.sha2(F.array_join(F.col("vector").cast("array<string>"), ",").cast("binary"), 256))
    # of equal vectors the k + 1 smallest ids; Spark limits the groups before it shuffles them
    order = Window.partitionBy("key").orderBy("id")
    distinct = rows.select("key", "vector", "id").distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    entries = cut(distinct.groupBy("key").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_list("id")).alias("ids")))
    asks = rows.where("asked").select("key", "vector", F.col("id").alias("query_id")).distinct()
    several = asks.groupBy("query_id").agg(F.count("*").alias("n")).where("n > 1")
    asks = asks.join(several, "query_id", "left").withColumn("own", F.when(F.col("n").isNotNull(), F.col("query_id")))
    asks = cut(asks.select("query_id", "own", "vector", F.concat_ws(":", "key", F.col("own").cast("string")).alias("unit")))
    posed = asks.groupBy("unit").agg(F.first("own").alias("own"), F.first("vector").alias("vector"))

    size = F.aggregate("vector", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    about = entries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"), F.max(size).alias("size")).first()
    unit = 2.0**520 if (about.size or 0) >= 2.0**400 else 1.0
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x / unit) * (x / unit))
    largest = (entries.agg(F.max(length).alias("x")).first().x or 0.0) * (1 + 1e-9)
    n_roots = max(1, min(ROOTS, -(-about.n // BLOCK_ROWS)))
    roots = entries.orderBy(F.xxhash64("key"), "key").limit(n_roots).select("vector").toArrow()
    space = Space(about.width or 0, largest, unit, matrix(roots.column("vector"), about.width or 0, unit))
    if not about.n:
        return asks.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)

    stored = cut(entries.mapInArrow(space.assign(True), "key string, vector array<double>, ids array<long>, region int, away double"))
    subs, blocks_before = [0] * len(space.roots), [0] * len(space.roots)
    for r in stored.groupBy("region").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect():  # ROOTS rows at most
        subs[r.region] = -(-r.n // BLOCK_ROWS)
        space.radii[r.region] = r.radius
    space.empty[:] = [n == 0 for n in subs]
    for i in range(1, len(subs)):
        blocks_before[i] = blocks_before[i - 1] + subs[i - 1]
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("region"))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    spread = lambda key, n: F.pmod(F.xxhash64(key), F.greatest(n, F.lit(1))).cast("int")
    sides = ["block", "part", "asked", "unit", "vector", "ids", "own", "bound"]
    block = F.col("sub") + of(blocks_before)
    fixed = {"asked": F.lit(False), "unit": F.lit(None).cast("string"), "own": F.lit(None).cast("long"), "bound": F.lit(None).cast("long")}
    stored = stored.withColumn("sub", spread("key", of(subs))).withColumn("block", block).withColumns(fixed)
    posing = {"asked": F.lit(True), "ids": F.lit(None).cast("array<bigint>")}

    def searched(asking: DataFrame, parts: list[int]) -> DataFrame:
        there = stored.where(of(parts) > 0).withColumn("part", each(of(parts)))
        grid = there.select(sides).unionByName(asking.withColumns(posing).select(sides)).groupBy("block", "part")
        return cut(grid.applyInArrow(_searcher(space, k + 1), "unit string, id long, score long"))

    # a query's nearest region first
    at_home = posed.mapInArrow(space.assign(False), "unit string, own long, vector array<double>, region int, away double").drop("away")
    at_home = cut(at_home.withColumn("sub", spread("unit", of(subs))).withColumn("block", block))

    def parts_of(asking: DataFrame) -> list[int]:
        parts = [0] * len(subs)
        for r in asking.groupBy("region").count().collect():
            parts[r.region] = -(-r["count"] // QUERY_ROWS)
        return parts

    parts = parts_of(at_home)
    hits = searched(at_home.withColumns({"part": spread(F.concat("unit", F.lit("/")), of(parts)), "bound": F.lit(None).cast("long")}), parts)
    if sum(subs) > 1:
        full = Window.partitionBy("unit").orderBy(F.desc("score"), "id")
        known = hits.withColumn("rank", F.row_number().over(full)).where(F.col("rank") == k + 1).select("unit", F.col("score").alias("bound"))
        bounded = at_home.select("unit", "own", "vector", "region", F.col("block").alias("home")).join(known, "unit", "left")
        asking = bounded.mapInArrow(space.reachable, "unit string, own long, vector array<double>, home int, bound long, region int")
        asking = cut(asking.where(of(subs) > 0))
        parts = parts_of(asking)
        asking = asking.withColumn("part", spread(F.concat("unit", F.lit("/")), of(parts))).withColumn("sub", each(of(subs))).withColumn("block", block)
        hits = hits.unionByName(searched(asking.where("block <> home"), parts))
    best = Window.partitionBy("unit").orderBy(F.desc("score"), "id")
    named = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1).select("unit", "id", "score")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    paired = asks.select("query_id", "unit").join(named, "unit").where(F.col("id") != F.col("query_id"))
    # rows of an id that more than one vector of the query finds count by each, as rows of the table do
    paired = paired.withColumn("rank", F.row_number().over(own))
    return paired.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
