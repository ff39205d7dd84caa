import random
import zlib
from hashlib import sha256

import numpy as np

from quirefold.llm import queries, runs


def brute(w):
    found = {}
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - p:
            j = i
            while j < len(w) - p and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def texts(seed, n):
    draw = random.Random(seed)
    for _ in range(n):
        w = [draw.choice("abcdefgh"[: draw.choice([1, 2, 3, 8])]) for _ in range(draw.randrange(0, 70))]
        if draw.random() < 0.5 and len(w) > 8:
            p, s = draw.randrange(1, len(w) // 4 + 1), draw.randrange(0, len(w) // 2)
            for i in range(s + p, draw.randrange(s + p, len(w) + 1)):
                w[i] = w[i - p]
        yield w


def found(batch):
    return [[tuple(map(int, x)) for x in r] for r in runs.find_runs([[x.encode() for x in w] for w in batch])]


def test_as_brute_force(monkeypatch):
    batch = [*texts(1, 400), ["a"] * 500, [], ["a"] * 5, ["a"] * 6, list("abcabcabcabc"), list("abcabcabcab")]
    want = [brute(w) for w in batch]
    assert found(batch) == want and sum(map(len, want)) > 100
    monkeypatch.setattr(runs, "PAIRS", 7)
    assert found(batch) == want
    monkeypatch.setattr(runs, "PRIME", 101)  # collisions everywhere
    monkeypatch.setattr(runs, "BASES", tuple(range(2, 99)))
    assert found(batch[:60]) == want[:60]


def test_alternating_words_of_thue_and_morse():
    assert found([["ab"[i.bit_count() & 1] for i in range(1 << 13)]]) == [[]]


def test_frames(spark):
    rows = [(1, None), (2, ""), (3, " \n\x0b\x0c\r\t"), (4, "x " * 30_000), (None, "a b\na b\ta b a b"), (None, "a b\na b\ta b a b"), (5, "a\x85a a　a"), (6, "é  " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'mine' as collapsed", "3 as start")
    got = runs.periodic_runs(df).collect()
    assert runs.periodic_runs(df).columns == ["doc_id", "text", "start", "runs", "collapsed"]
    by = {(r.doc_id, r.text): ([tuple(x) for x in r.runs], r.collapsed) for r in got}
    assert len(got) == len(rows) and by[4, "x " * 30_000] == ([(0, 30_000, 1)], "x") and by[None, "a b\na b\ta b a b"] == ([(0, 8, 2)], "a b")
    assert by[1, None] == by[2, ""] == by[3, " \n\x0b\x0c\r\t"] == ([], "") and by[5, "a\x85a a　a"] == ([], "a\x85a a　a") and by[6, "é  " * 9][0] == [(0, 9, 1)]
    assert runs.periodic_runs(df.limit(0)).count() == 0


def test_planted_runs(spark):
    rows = [(i, f"a{i} b c d e f g h {i % 3} j k l m n o p q r s t" * (i % 4)) for i in range(200)] + [(None, "x y")]
    got = {r.doc_id: r.text for r in queries.with_planted_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    changed = 0
    for i, text in rows:
        w, h = text.split(), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w, changed = [w[j] if j < a else w[a + (j - a) % p] for j in range(len(w))], changed + 1
        assert got[i].split() == w
    assert changed > 5


def test_collapse():
    w = [b"x", *[b"a", b"b"] * 4, b"y"]
    rows = runs.find_runs([w])[0]
    assert runs.collapse(w, rows) == [b"x", b"a", b"b", b"y"] and runs.collapse(w, np.empty((0, 3), np.int64)) == w
    assert sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
