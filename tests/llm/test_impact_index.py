import math
import random
import re
from collections import Counter, defaultdict

from quirefold.llm import impact_index as ix


def brute(docs, items, k):
    terms = lambda t: [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    said = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(x) for _, x in said), sum(len(x) for _, x in said)
    df = Counter(t for _, x in said for t in set(x))
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, x in said:
            tf = Counter(x)
            if x:
                m = 50 + 50 * len(x) * n_docs // n_terms
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in wanted if tf[t])
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(x for x in scored if x[0] < 0)[:k], 1)]
    return sorted(out, key=str)


def test_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ix, "PAIRS", 60)
    draw = random.Random(3)
    words = ["the", "The", "ÉTÉ", "été", "x-ray", "a1", "東京", *(f"w{i}" for i in range(80))]
    text = lambda n: " ".join(draw.choice(words[: draw.choice([5, 87])]) for _ in range(n))
    docs = [(i, text(draw.randrange(0, 60))) for i in range(300)]
    docs += [(None, "the w1"), (None, "the w1"), (7, "the w1 w2"), (900, None), (901, ""), (902, "... --"), (903, "w3 " * 50_000), *((1000 + i, "copy of w5 the") for i in range(80))]
    items = [(i, text(12)) for i in range(20)] + [(3, "w5 copy copy"), (50, None), (51, "nothing known"), (None, "the w1"), (52, "w5 w5 the THE")]
    draw.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "2 as terms", "'x' as rank").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'y' as term", "0 as score")
    got = ix.search(frame, asked, k=20)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items, 20)
    assert ix.search(frame, asked.limit(0)).count() == 0 and ix.search(frame.limit(0), asked).count() == 0


def test_blocks_and_slices(spark, monkeypatch):
    monkeypatch.setattr(ix, "BLOCK", 70)
    docs = [(i, f"a b{i % 3} c{i}") for i in range(500)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    items = [(1, "a b1"), (2, "c77 b2")]
    got = ix.search(frame, spark.createDataFrame(items, "item_id long, text string"), k=100)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items, 100)
    draw, total = random.Random(1), []
    want = [0] * 100
    for _ in range(9):
        part = [draw.randrange(1 << 12) * draw.randrange(2) for _ in range(100)]
        want = [a + b for a, b in zip(want, part)]
        ix.add(total, [sum((x >> i & 1) << p for p, x in enumerate(part)) for i in range(12)])
    assert sorted(ix.best(total, 13)) == sorted(sorted(((p, x) for p, x in enumerate(want) if x), key=lambda y: (-y[1], y[0]))[:13])
    assert ix.best([], 5) == [] and ix.best([0, 0], 5) == []
