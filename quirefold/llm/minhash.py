"""Near-duplicate documents by SuperMinHash signatures, banding, verification on whole shingle sets and union-find.

A document's set: the distinct runs of SHINGLE words of its text, A-Z lower-cased, words being runs of characters other
than ASCII space; with fewer words, the whole sequence as one. Without words (null, empty, blank text) the set is empty
and linked with nothing. Documents whose sets are alike by `similarity` per cent or more are linked; a component is what links
reach, and its smallest id stays. Rows that repeat an id are judged each by its own text; rows without id have no
component and are not kept.

SuperMinHash: an element draws a random rank for each level and visits the slots of the signature in an order of its
own; slot values of level j are all below those of level j + 1, so a document ends at the level at which all its slots
are full. Here all elements of a batch take a level together.

Rows and bands give a pair of just that likeness at most MISS as its chance to share no bucket. Texts of equal sets form a
class that its smallest id stands for. Each class is compared with the smallest one of most of its buckets (rows linear
in the classes). In buckets whose classes are apart after that, all are compared, BLOCK by BLOCK inside tasks: their
slots tell which can be alike and whether an earlier bucket has them, too, and only those send their texts. No link
is lost but by chances of MISS, and no rows of pairs are made.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.llm.common import append_by_arrow, cut
from quirefold.llm.components import components

SHINGLE = 5
SIMILARITY = 80  # per cent
MISS = 3e-7
#: Elements that take a level together.
BATCH = 50_000
#: Levels in which slots are traced back, and bytes of texts whose words are hashed at once.
TRACED, BYTES = 8, 1_000_000
#: Ids that are broadcast at most; beyond, Spark joins as it sees fit.
BROADCAST = 1_000_000
#: Documents that are signed together, and rows of buckets and texts that a task gets together.
SIGNED, ROWS, TEXTS = 512, 8192, 512
#: Shingles of the texts that a task gets together: rows count, and so does their length.
SHINGLES = 2_000_000
#: Classes of a block where all are compared, and of a chunk that is compared with a center.
BLOCK = 256
U = np.uint64
ODD = U(0x9E3779B97F4A7C15)
BASE = 0x5851F42D4C957F2D
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Bytes as numbers that aren't 0, A-Z as a-z.
LETTERS = np.arange(1, 257, dtype=U)
LETTERS[65:91] += U(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose results look random."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class _Powers:
    """Powers of BASE and of its inverse modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            inverse = pow(BASE, -1, 1 << 64)
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, U), np.full(n, b, U)])) for b in (BASE, inverse))
        return self.up, self.down


def word_hashes(data: np.ndarray, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    """One 64-bit hash of each word of UTF-8 bytes, and where the words start."""
    space = SPACES[data]
    edges = np.flatnonzero(np.concatenate([[True], space]) != np.concatenate([space, [True]]))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, U), starts
    up, down = powers.to(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(LETTERS[data] * up[: len(data)], out=sums[1:])
    words = (sums[ends] - sums[starts]) * down[starts]
    return mix(words + (ends - starts).astype(U) * ODD), starts


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash of each run of so many words."""
    runs = np.zeros(max(0, len(words) - width + 1), U)
    for k in range(width):
        runs = mix(runs * ODD + words[k : k + len(runs)])
    return runs + U(width)


def distinct(runs: np.ndarray) -> np.ndarray:
    runs = np.sort(runs)
    return runs[np.concatenate([[True], runs[1:] != runs[:-1]])] if len(runs) else runs


def shingle_sets(texts: list[bytes], powers: _Powers) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text. Words and runs of all texts are hashed at once."""
    words, starts = word_hashes(np.frombuffer(b" ".join(texts), np.uint8), powers)
    ends = np.cumsum([len(t) + 1 for t in texts])
    last = np.searchsorted(starts, ends).tolist()
    runs = shingles(words, SHINGLE)
    found, first = [], 0
    for end in last:
        n = end - first
        found.append(distinct(runs[first : end - SHINGLE + 1] if n >= SHINGLE else shingles(words[first:end], n) if n else words[:0]))
        first = end
    return found


def shingle_set(text: str | None, powers: _Powers) -> np.ndarray:
    return shingle_sets([(text or "").encode()], powers)[0]


def super_minhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """Signatures, one row a set: the level above, a 48-bit rank below. Sets must not be empty.

    In the first levels the slot that an element visits is traced back through the swaps of its levels before; the few elements
    that go on have their order of the slots written out.
    """
    sizes = np.array([len(s) for s in sets])
    items = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    best = np.full(len(sets) * slots, ~U(0))
    swaps: list[np.ndarray] = []  # of each level, the place that it was exchanged with
    order = None  # of the slots, for each element
    for level in range(slots):
        drawn = mix(items + U((2 * level + 1) * int(ODD) % 2**64))
        at = level + ((mix(drawn ^ ODD) >> U(32)) * U(slots - level) >> U(32)).astype(np.int64)
        if order is None:
            slot = at
            for i in range(level - 1, -1, -1):
                slot = np.where(slot == swaps[i], i, slot)
            swaps.append(at)
        else:
            every = np.arange(len(items))
            slot = order[every, at].astype(np.int64)
            order[every, at] = order[every, level]
        np.minimum.at(best, owner * slots + slot, (drawn >> U(16)) | (U(level) << U(48)))
        full = (best.reshape(-1, slots) != ~U(0)).all(axis=1)
        if full.all():
            break
        left = ~full[owner]
        if not left.all():
            items, owner, swaps = items[left], owner[left], [x[left] for x in swaps]
            order = order if order is None else order[left]
        if level == TRACED - 1:
            order = np.broadcast_to(np.arange(slots, dtype=np.uint16), (len(items), slots)).copy()
            every = np.arange(len(items))
            for i, x in enumerate(swaps):
                order[every, x], order[every, i] = order[every, i], order[every, x]
            swaps = []
    return best.reshape(-1, slots)


def banding(similarity: int) -> tuple[int, int]:
    """Bands, and rows of each."""
    rows = 6 if similarity >= 85 else 5
    return math.ceil(math.log(MISS) / math.log(1 - (similarity / 100) ** rows)), rows


def short_slots(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The low 16 bits of each slot, the rows of a band side by side: enough to meet by, and to estimate likeness from."""
    return np.ascontiguousarray(signatures.reshape(-1, rows, bands).transpose(0, 2, 1).reshape(len(signatures), -1).astype("<u2"))


def band_keys(sig, band, similarity: int):
    """The bucket of a class in a band, in Spark: equal for equal slots."""
    wide = 2 * banding(similarity)[1]
    return F.xxhash64(band, F.substring(sig, band * wide + 1, F.lit(wide)))


def features(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """id, hash, n_shingles, two halves of a digest of the set (null if it is empty), and short_slots of the
    signature; docs: id, hash, text."""
    bands_, rows_ = banding(similarity)

    def build():
        powers = _Powers()

        def signed(sets: list[np.ndarray]) -> list[bytes]:
            return [row.tobytes() for row in short_slots(super_minhash(sets, bands_ * rows_), bands_, rows_)]

        def sets_of(texts: pa.Array) -> Iterator[np.ndarray]:
            held, n = [], 0
            for x in texts.cast(pa.binary()):
                held.append(x.as_py() or b"")
                n += len(held[-1])
                if n >= BYTES:
                    yield from shingle_sets(held, powers)
                    held, n = [], 0
            if held:
                yield from shingle_sets(held, powers)

        def compute(columns: list[pa.Array]) -> list[pa.Array]:
            sizes, halves, sigs = [], [[], []], []
            pending: list[np.ndarray] = []
            held = 0
            for s in sets_of(columns[0]):
                sizes.append(len(s))
                for salt, half in enumerate(halves):
                    half.append(int(np.bitwise_xor.reduce(mix(s * ODD + U(salt))).view(np.int64)) if len(s) else None)
                if len(s):
                    if held + len(s) > BATCH and pending:
                        sigs += signed(pending)
                        pending, held = [], 0
                    pending.append(s)
                    held += len(s)
            if pending:
                sigs += signed(pending)
            left = iter(sigs)
            held_by = [next(left) if n else None for n in sizes]
            return [pa.array(sizes, pa.int64()), *(pa.array(h, pa.int64()) for h in halves), pa.array(held_by, pa.binary())]

        return compute

    fields = [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("digest0", T.LongType()),
        T.StructField("digest1", T.LongType()),
        T.StructField("sig", T.BinaryType()),
    ]
    return append_by_arrow(docs, fields, build, ["text"], keep=["id", "hash"], rows=SIGNED)


def alike(shared, a, b, similarity: int):
    """Whether sets of sizes a and b that share so many items are alike enough, in whole numbers."""
    return 100 * shared >= similarity * (a + b - shared)


def threshold(similarity: int) -> float:
    """The share of equal slots of two signatures that alike sets stay below by less than a chance of MISS.

    Slots are equal where those of whole signatures are, or by a small chance; six standard deviations are allowed for."""
    bands, rows = banding(similarity)
    s = similarity / 100
    return s - 6 * math.sqrt(s * (1 - s) / (bands * rows))


class _Group:
    """Classes that meet in one bucket, of one block or of two, and what is known of them without their sets."""

    def __init__(self, group: pa.Table, similarity: int):
        self.similarity, self.shape = similarity, banding(similarity)
        self.ids, self.part = (group.column(c).to_numpy() for c in ("id", "part"))
        self.sizes, self.component = group.column("n").to_numpy(), group.column("component").to_numpy().copy()
        self.band = group.column("band")[0].as_py()
        sig = b"".join(group.column("sig").to_pylist())
        self.sig = np.frombuffer(sig, "<u2").reshape(len(self.ids), -1)
        self.two = self.part.min() != self.part.max()

    def partners(self, i: int) -> np.ndarray:
        """Classes that can be alike to class i, are in another component and meet it in no band before this one."""
        low, high = np.minimum(self.sizes, self.sizes[i]), np.maximum(self.sizes, self.sizes[i])
        fit = (100 * low >= self.similarity * high) & (self.component != self.component[i])
        fit &= (self.part != self.part[i]) if self.two else (np.arange(len(self.ids)) > i)
        found = np.flatnonzero(fit)
        same = self.sig[found] == self.sig[i]
        first = same.reshape(len(found), *self.shape).all(axis=2).argmax(axis=1) == self.band
        return found[first & (same.mean(axis=1) >= threshold(self.similarity))]

    def asking(self) -> np.ndarray:
        return np.flatnonzero(self.part == self.part.min())


def _promising(group: pa.Table, similarity: int) -> pa.Table:
    """The classes of a bucket that have a partner, by signatures."""
    g = _Group(group, similarity)
    wanted = np.zeros(len(g.ids), bool)
    for i in g.asking():
        found = g.partners(i)
        wanted[found] = True
        wanted[i] |= len(found) > 0
    return group.filter(pa.array(wanted))


def _compare(group: pa.Table, similarity: int) -> pa.Table:
    """Links between partners of one bucket, by their whole sets; enough of them for all components."""
    g, powers = _Group(group, similarity), _Powers()
    sets = [shingle_set(x.as_py(), powers) for x in group.column("text")]
    links: list[tuple[int, int]] = []
    for i in g.asking():
        for j in g.partners(i):
            if g.component[i] != g.component[j] and alike(len(np.intersect1d(sets[i], sets[j], True)), len(sets[i]), len(sets[j]), similarity):
                links.append((int(g.ids[i]), int(g.ids[j])))
                g.component[g.component == g.component[j]] = g.component[i]
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})


def _to_center(group: pa.Table, similarity: int) -> pa.Table:
    """Links of classes to their center, whose row is the one that isn't a member."""
    powers = _Powers()
    sets = [shingle_set(x.as_py(), powers) for x in group.column("text")]
    member, ids = group.column("member").to_pylist(), group.column("id").to_numpy()
    center = member.index(False)
    shared = [len(np.intersect1d(sets[center], s, True)) for s in sets]
    linked = [int(ids[i]) for i, s in enumerate(sets) if member[i] and alike(shared[i], len(s), len(sets[center]), similarity)]
    return pa.table({"a": pa.array([int(ids[center])] * len(linked), pa.int64()), "b": pa.array(linked, pa.int64())})


def bundled(df: DataFrame, keys: list[str], rows: int, of: int, f: Callable[[pa.Table], pa.Table], schema, shingles: int = 0) -> DataFrame:
    """f of each group of df by `keys` (numbers). Groups go to tasks in bundles of about `of` of all the `rows`, or SHINGLES of all
    the `shingles` of their texts if that is less: most are of a few rows, and a call of Python for each would cost more
    than its work."""
    bundles = max(1, -(-rows // of), -(-shingles // SHINGLES))

    def run(bundle: pa.Table) -> pa.Table:
        bundle = bundle.drop_columns("bundle").sort_by([(k, "ascending") for k in keys]).combine_chunks()
        columns = [bundle.column(k).to_numpy() for k in keys]
        new = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        starts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(bundle)]])
        made = pa.concat_tables([f(bundle.slice(a, b - a)) for a, b in zip(starts, starts[1:])])
        pa.default_memory_pool().release_unused()
        return made

    return df.withColumn("bundle", F.pmod(F.xxhash64(*keys), F.lit(bundles))).groupBy("bundle").applyInArrow(run, schema)


def _parts(rows, shingles):
    """Parts that a group is cut into: of BLOCK rows and of SHINGLES shingles at most, on average."""
    return F.ceil(F.greatest(rows / BLOCK, shingles / SHINGLES)).cast("int")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, hash, text), once each, of the wanted ids and hashes of texts."""
    few = wanted.count() <= BROADCAST
    found = docs.join(F.broadcast(wanted) if few else wanted, ["id", "hash"], "left_semi")
    return found.groupBy("id", "hash").agg(F.first("text").alias("text"))


def linked(docs: DataFrame, made: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """(id, component) of all ids that have links; docs: id, hash, text; made: features(docs), cut.

    First each class is compared with the class that is the smallest one of most of its buckets. Then, in buckets whose
    classes are still apart, all of them are compared: by their signatures, and by their sets where these allow a link.
    """
    fit = lambda a, b: 100 * F.least(a, b) >= similarity * F.greatest(a, b)
    classes = made.where("n_shingles > 0 and id is not null").groupBy("digest0", "digest1")
    classes = classes.agg(F.min(F.struct("id", "hash")).alias("first"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = cut(classes.select("first.*", "n", "sig"))
    every = F.explode(F.sequence(F.lit(0), F.lit(banding(similarity)[0] - 1)))
    keyed = classes.withColumn("band", every).select("id", "hash", "n", "band", band_keys(F.col("sig"), F.col("band"), similarity).alias("key"))
    centers = keyed.groupBy("key").agg(F.min(F.struct("id", "hash", "n")).alias("center"), F.max(F.struct("id", "hash")).alias("last"))
    shared = cut(keyed.join(centers.where(F.struct("center.id", "center.hash") != F.col("last")).drop("last"), "key"))

    met = shared.where((F.col("id") > F.col("center.id")) & fit(F.col("n"), F.col("center.n")))
    most = met.groupBy("id", "hash", F.col("center.id").alias("a"), F.col("center.hash").alias("a_hash")).agg(F.count("*").alias("buckets"), F.first("n").alias("n"))
    most = most.groupBy("id", "hash").agg(F.max(F.struct("buckets", "a", "a_hash", "n")).alias("m"))
    pairs = cut(most.select("id", "hash", "m.a", "m.a_hash", "m.n"))
    n_pairs, n_shingles = pairs.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    chunks = cut(pairs.groupBy("a", "a_hash").agg(_parts(F.count("*"), F.sum("n")).alias("chunks")))
    texts = _texts(docs, pairs.select("id", "hash").unionByName(pairs.select(F.col("a").alias("id"), F.col("a_hash").alias("hash"))).distinct())
    dealt = pairs.join(chunks, ["a", "a_hash"]).withColumn("chunk", F.pmod(F.xxhash64("id", "hash"), F.col("chunks")).cast("int"))
    members = texts.join(dealt, ["id", "hash"]).select("a", "a_hash", "chunk", "id", "text", F.lit(True).alias("member"))
    held = chunks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(F.col("a").alias("id"), F.col("a_hash").alias("hash"), "chunk")
    middle = texts.join(held, ["id", "hash"]).select(F.col("id").alias("a"), F.col("hash").alias("a_hash"), "chunk", "id", "text", F.lit(False).alias("member"))
    to_center = lambda group: _to_center(group, similarity)
    links = cut(bundled(members.unionByName(middle), ["a", "a_hash", "chunk"], 2 * n_pairs, TEXTS, to_center, "a long, b long", 2 * n_shingles))
    known = components(links)

    state = shared.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    tried = pairs.withColumn("tried", F.struct("a", "a_hash")).select("id", "hash", "tried")
    state = state.join(tried, ["id", "hash"], "left").withColumn("new", (F.col("id") > F.col("center.id")) & ~F.coalesce(F.col("tried") == F.struct("center.id", "center.hash"), F.lit(False)))
    state = cut(state.select("key", "band", "id", "hash", "n", "component", "new"))
    apart = state.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("of"), F.sum("n").alias("all"), F.max("new").alias("new"))
    # where a bucket has two classes, they have been compared unless their sizes keep them apart
    blocks = _parts(F.col("of"), F.col("all")).alias("blocks")
    apart = cut(apart.where("low < high and (of > 2 or new)").select("key", "of", blocks))
    rows = apart.agg(F.sum(F.col("of") * F.col("blocks"))).first()[0] or 0
    rest = state.join(apart.drop("of"), "key").withColumn("part", F.pmod(F.xxhash64("id", "hash"), F.col("blocks")).cast("int"))
    rest = rest.join(classes.select("id", "hash", "sig"), ["id", "hash"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = ["key", "low", "high"]
    rest = rest.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "band", "part", "id", "hash", "n", "component", "sig")
    open_ = cut(bundled(rest, group, rows, ROWS, lambda g: _promising(g, similarity), rest.schema))
    n_open, n_shingles = open_.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_open:
        return known
    texts = _texts(docs, open_.select("id", "hash").distinct())
    # cut, so that no task feeds two Python workers at once: Spark keeps workers, and what they hold, for later stages
    more = cut(bundled(texts.join(open_, ["id", "hash"]), group, n_open, TEXTS, lambda g: _compare(g, similarity), "a long, b long", n_shingles))
    return components(links.unionByName(more))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """One row for each of df: id_col, n_shingles, component_id, kept."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("hash"), F.col(text_col).alias("text"))
    made = cut(features(docs, similarity))
    named = linked(docs, made, similarity).withColumnRenamed("component", "component_id")
    classes = made.where("n_shingles > 0").groupBy("digest0", "digest1").agg(F.min("id").alias("id"))
    classes = classes.join(named, "id", "left").select("digest0", "digest1", F.coalesce("component_id", "id").alias("component_id"))
    out = made.select("id", "n_shingles", "digest0", "digest1").join(classes, ["digest0", "digest1"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
