import hashlib
import random
import re

from pyspark.sql import functions as F

from quirefold.llm import spotsigs


def spots(text):
    """The set of (anchor, two content words), or the whole text's words where there is none."""
    words = re.sub(r"[^\w]|_", " ", (text or "").lower()).split()
    anchors = set(spotsigs.ANCHORS)
    found = set()
    for i, w in enumerate(words):
        if w in anchors:
            chain = [x for x in words[i + 1 :] if x not in anchors][: spotsigs.CHAIN]
            if len(chain) == spotsigs.CHAIN:
                found.add((w, *chain))
    return found or ({" ".join(words)} if words else set())


def jaccard(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b) if a and b else 0.0


def texts(n, seed=1):
    draw = random.Random(seed)
    words = ["the", "a", "of", "is", "der", "la", *(f"w{i}é" for i in range(60))]
    return [" ".join(draw.choice(words) for _ in range(draw.randrange(0, 80))) for _ in range(n)]


def test_likeness_and_edits(spark):
    rows = [(3 * i, t) for i, t in enumerate(texts(150))]
    rows += [(1, None), (2, ""), (4, "the the"), (5, "Only, content: words!"), (7, "THE cat; sat on a mat"), (8, "the cat sat on a mat"), (None, "the first of all texts"), (10_000, "x" * 50_000), (9, rows[3][1]), (9, rows[3][1])]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"sigs": F.lit(1), "part": F.lit(1), "key": F.lit(1)})
    made = spotsigs.with_next(df, "doc_id", "text").withColumn("edited", spotsigs.edited(F.col("text"), F.col("next_text")))
    made = spotsigs.with_signatures(made, F.col("edited"), "edited_sigs")
    got = made.select("doc_id", "text", "edited", spotsigs.fingerprint(F.col("sigs")).alias("f"), F.size("sigs").alias("n"), spotsigs.likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), spotsigs.likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next")).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for i, (key, text) in enumerate(order):
        text, other = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edit = text[: len(text) - half] + other[:half]
        want.append((key, text, edit, len(spots(text)), round(jaccard(spots(text), spots(edit)), 9), round(jaccard(spots(text), spots(other)), 9)))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.text, r.edited, r.n, round(r.near_edited, 9), round(r.near_next, 9))) for r in got)
    assert len({r.f for r in got}) == len({frozenset(map(str, spots(r.text))) for r in got})
    assert spotsigs.with_next(df.limit(0), "doc_id", "text").count() == 0


def test_near_duplicates(spark):
    draw = random.Random(4)
    rows, key = [], 0
    for base in texts(20, 3):
        for _ in range(5):
            words = base.split()
            for _ in range(draw.randrange(3)):
                if words:
                    words[draw.randrange(len(words))] = f"w{draw.randrange(60)}é"
            rows.append(((key := key + 1), " ".join(words)))
    rows += [(key + 1, None), (key + 2, ""), (None, "the w1é w2é")]
    members, pairs = spotsigs.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = {k: spots(t) for k, t in rows if k is not None}
    cls = {r.doc_id: r.class_id for r in members.collect()}
    assert len(cls) == len(rows)
    for k, s in sets.items():
        assert cls[k] == (min(j for j, t in sets.items() if t == s) if s else None)
    heads = sorted({c for c in cls.values() if c is not None})
    want = {(a, b) for a in heads for b in heads if a < b and jaccard(sets[a], sets[b]) >= 0.8}
    assert {(r.a, r.b) for r in pairs.collect()} == want and want


def test_query_hashes_whole_texts(spark):
    from quirefold.llm.queries import op4_spotsigs

    rows = op4_spotsigs(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    for i, r in enumerate(rows):
        half = len(docs[i]) // 2
        edit = docs[i][: len(docs[i]) - half] + docs[(i + 1) % len(docs)][:half]
        assert (r.n_chars, r.edited_sha256) == (len(docs[i]), hashlib.sha256(edit.encode()).hexdigest())
