import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quirefold.llm import sharding


def test_laws(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUPS", 500)
    draw = random.Random(4)
    texts = ["word " * int(draw.paretovariate(1.1) * 10 % 3000) + f"é{i}" for i in range(4000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5000 + i, texts[i % 40]) for i in range(400)] + [(6000 + i, "hot text " * 30) for i in range(2500)]
    rows += [(9000, None), (9001, ""), (9001, ""), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x")).repartition(6)
    got = sharding.shard(df).collect()
    assert sorted(str((r.doc_id, r["size"], r.text_crc32)) for r in got) == sorted(str((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for i, t in rows)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    assert len(sizes) == 8 and max(sizes.values()) < 1.02 * min(sizes.values()), sizes
    text_of, homes = dict(rows), defaultdict(set)
    for r in got:
        homes[text_of[r.doc_id] or ""].add(r.shard)
    hot = "hot text " * 30
    assert len(homes.pop(hot)) == 8
    assert {len(where) for where in homes.values()} == {1}


def test_empty(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    (row,) = sharding.shard(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    assert (row["size"], row.slot) == (1, 0)


def test_groups_that_fit_stay_whole(spark):
    """Of up to nine tenths of a shard, while one of two shards is split."""
    rows = [(i, f"g{i % 3}xx " * 500) for i in range(300)] + [(1000 + i, f"hf{i % 2}x " * 500) for i in range(120)]
    rows += [(2000 + i, "allx " * 500) for i in range(700)] + [(5000 + i, f"{i:04d} " * (450 + i % 100)) for i in range(500)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text_of, homes, sizes = dict(rows), defaultdict(set), Counter()
    for r in got:
        homes[text_of[r.doc_id][:4]].add(r.shard)
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) < 1.03 * min(sizes.values()), sizes
    share = sum(sizes.values()) / 8
    for name in ("g0xx", "g1xx", "g2xx", "hf0x", "hf1x"):
        size = sum(len(t) + 1 for _, t in rows if t[:4] == name)
        assert len(homes[name]) == 1 and size < share, name
    assert len(homes["allx"]) > 1


def naive_place(sizes, room):
    """The largest first, by plain loops."""
    unit = [max(sum(r[m] for r in room), 1e-9) / len(room) for m in range(3)]
    left = [[r[m] / unit[m] for m in range(3)] for r in room]
    parts = [[s[m] / unit[m] for m in range(3)] for s in sizes]
    out = [0] * len(parts)
    for i in sorted(range(len(parts)), key=lambda i: -max(parts[i])):
        over = [max(0, *(p - x for p, x in zip(parts[i], shard))) for shard in left]
        fit = [j for j in range(len(left)) if over[j] <= min(over) + 1e-12]
        best = max(fit, key=lambda j: (sum(p * x for p, x in zip(parts[i], left[j])), -j))
        left[best] = [x - p for x, p in zip(left[best], parts[i])]
        out[i] = best
    return out


def test_place_as_naive():
    draw = np.random.default_rng(2)
    for _ in range(20):
        sizes = draw.integers(1, 64, (draw.integers(1, 80), 3)).astype(float)
        room = np.tile(sizes.sum(axis=0) / 8, (8, 1))
        assert sharding.place(sizes, room).tolist() == naive_place(sizes.tolist(), room.tolist())


def test_few_texts_with_many_rows(spark):
    """Slots are counted in more than one deal though there are two groups."""
    rows = [(i % 2000 if i % 3 else None, "a b c" if i % 5 else "d e") for i in range(30_000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == len(rows)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
