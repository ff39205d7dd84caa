import random
import re

import pytest

from quirefold.llm import minhash
from quirefold.llm.components import components


def brute(rows, similarity):
    sets = []
    for key, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lower)
        k = min(5, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    group = {}
    for i, (key, _) in enumerate(rows):
        group.setdefault(find(i), []).append(key)
    return {key: (len(sets[i]), min(group[find(i)]), min(group[find(i)]) == key) for i, (key, _) in enumerate(rows)}


@pytest.mark.parametrize("similarity", [80, 85])
def test_against_brute_force(spark, similarity):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows, key = [], 0
    for _ in range(12):
        base = [draw.choice(words) for _ in range(draw.randrange(60, 300))]
        for _ in range(18):
            text = list(base)
            for _ in range(draw.randrange(0, 6)):
                text[draw.randrange(len(text))] = draw.choice(words).upper()
            rows.append((key := key + draw.randrange(1, 4), " ".join(text)))
        rows.append((key := key + 1, "\t".join(base) + "\n"))
    rows += [(key + 1, None), (key + 2, ""), (key + 3, " \n"), (key + 4, "one two"), (key + 5, "ONE  two"), (key + 6, "one two "), (key + 7, "x" * 100_000)]
    draw.shuffle(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), similarity=similarity).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows, similarity)


def test_edges(spark):
    rows = [(None, "a b c d e f", "s"), (5, "a b c d e f", "t"), (5, "a b c d e f", "t"), (7, "a b c d e f", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(map(tuple, minhash.near_duplicates(df).collect()), key=str)
    assert got == [(5, 2, 5, True), (5, 2, 5, True), (7, 2, 5, False), (None, 2, None, False)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [40])
def test_components_of_paths_and_stars(spark, n):
    links = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, n)] + [(1010, 2000)]
    random.Random(1).shuffle(links)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert {got[i] for i in range(n + 1)} == {0}
    assert {c for i, c in got.items() if i >= 1000} == {1000}
