import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from quirefold.llm import packing, queries


def naive(pieces, capacity):
    """Best fit with plain lists and sets."""
    bins, out = [], [None] * len(pieces)
    for i in sorted(range(len(pieces)), key=lambda i: -pieces[i][0]):
        n, source, cluster = pieces[i]
        fit = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= n and not (source is not None and source in b["s"]) and not (cluster is not None and cluster in b["c"])]
        if fit:
            k = min(fit)[1]
        else:
            k = len(bins)
            bins.append({"left": capacity, "s": set(), "c": set()})
        out[i] = (k, capacity - bins[k]["left"])
        bins[k]["left"] -= n
        bins[k]["s"].add(source)
        bins[k]["c"].add(cluster)
    return out


def test_as_naive_best_fit():
    draw = random.Random(1)
    for _ in range(60):
        pieces = [(draw.randrange(1, 101), draw.choice([None, "a", "a", "a", "b", "c", "d"]), draw.choice([None, *range(30)])) for _ in range(draw.randrange(120))]
        assert packing.pack(pieces, 100) == naive(pieces, 100)


def test_whole_and_without_conflicts(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 64)
    draw = random.Random(2)
    rows = [(i, "w " * draw.randrange(0, 300), draw.choice(["hot", "hot", "x", "y", "z", None])) for i in range(400)]
    rows += [(500, None, "x"), (501, "", None), (None, "no id", "x"), (502, "same text", "x"), (502, "same text", "x"), (503, "w\n\tw " * 3000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"cluster": F.lit("?"), "piece": F.lit("?")})
    got = packing.best_fit(df, 100).collect()
    tokens, want = defaultdict(int), defaultdict(int)
    for r in got:
        tokens[r.doc_id] += r.n_tokens
    for i, text, _ in rows:
        want[i] += len((text or "").split()) + 1
    assert tokens == want
    bins = defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
    for held in bins.values():
        held.sort(key=lambda r: r.bin_offset)
        at = 0
        for r in held:
            assert r.bin_offset == at
            at += r.n_tokens
        assert at <= 100
        sources = [r.source for r in held if r.source]
        assert len(sources) == len(set(sources)) and len(held) == len({r.cluster for r in held})
    assert packing.best_fit(df.limit(0)).count() == 0


def test_near_copies_stay_apart(spark, tmp_path):
    """Of different sources, and with ids that are null or repeated."""
    draw = random.Random(3)
    rows, group = [], {}
    for g in range(12):
        words = [f"w{draw.randrange(10**6)}" for _ in range(60)]
        for k in range(4):
            text = " ".join(words[:-1] + [f"end{k}"]) if k < 3 else " ".join(words).upper() + "  "
            group[len(rows)] = g
            rows.append((None if k == 1 else g if k == 2 else len(rows) + 100, text, f"s{len(rows)}"))
    rows += [(3, "", "blank"), (901, None, "none"), (902, "alone", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op9_best_fit_packing(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.source, r.n_tokens) for r in got) == sorted((str(i), s, len((t or "").split()) + 1) for i, t, s in rows)
    cluster, seen = defaultdict(set), set()
    for r in got:
        if r.source[1:].isdigit():
            g = group[int(r.source[1:])]
            cluster[g].add(r.cluster)
            assert (r.bin_id, g) not in seen
            seen.add((r.bin_id, g))
    assert all(len(c) == 1 for c in cluster.values()) and len(set().union(*cluster.values())) == 12
    assert len({r.bin_id for r in got}) < len(got)


def test_word_counts():
    texts = [None, "", " ", "a", " a", "a ", "ä\u3000b c", "x\x0by\x0cz", "one two\n\tthree  ", "", "end"]
    want = [len(re.findall(r"[^ \t-\r]+", t or "")) for t in texts]
    for array in (pa.array(texts), pa.array([None, "skipped words", *texts])[2:], pa.array(texts, pa.large_string())):
        assert packing.word_counts(array).tolist() == want
    assert packing.word_counts(pa.array([], pa.string())).tolist() == []


@pytest.mark.parametrize("hot", [0.1, 0.4])
def test_same_bins_for_any_partitions(spark, monkeypatch, hot):
    """And they are filled nearly as well as any packing could fill them."""
    monkeypatch.setattr(packing, "BLOCK", 256)
    draw = random.Random(7)
    rows = [(i, f"t{i} " * draw.randrange(1, 120), "hot" if draw.random() < hot else f"s{draw.randrange(60)}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = []
    for partitions in (1, 7, 23):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        found.append({tuple(r) for r in packing.best_fit(df.repartition(partitions), 256).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found[0] == found[1] == found[2] and len(found[0]) == 2000
    least = max(sum(r[3] for r in found[0]) / 256, max(Counter(r[4] for r in found[0]).values()))
    assert least >= 0.95 * len({r[6] for r in found[0]})
