import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quirefold.llm import langid, toxicity

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["schr", "eng", "ü", "orf"], "cc": ["eau", "ois", "té", "que"]}


def invented(n, seed=1):
    draw = random.Random(seed)
    word = lambda lang: "".join(draw.choice(SYLLABLES[lang]) for _ in range(draw.randrange(1, 4)))
    return [(i, " ".join(word(lang) for _ in range(draw.randrange(3, 40))), lang) for i in range(n) for lang in [draw.choice(sorted(SYLLABLES))]]


def test_languages_held_out(spark):
    rows = invented(600)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("?"))
    model = langid.fit(df, train=F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    held = [r for r in rows if r[0] % 5 == 0]
    assert sum(got[i].lang_pred == lang for i, _, lang in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edges(spark):
    df = spark.createDataFrame(invented(60), "doc_id long, text string, lang string")
    edges = spark.createDataFrame([(1, None, "aa"), (2, "", None), (3, "12 ... \n", "bb"), (4, "kalomi " * 30_000, None), (None, "eauois", None), (None, "eauois", None)], "doc_id long, text string, lang string")
    got = langid.predict(edges, langid.fit(df.unionByName(edges)), keep=["doc_id"]).collect()
    assert sorted((str(r.doc_id), r.lang_pred) for r in got) == [("1", "und"), ("2", "und"), ("3", "und"), ("4", "aa"), ("None", "cc"), ("None", "cc")]
    none = langid.fit(edges.limit(0))
    assert {(r.lang_pred, r.score) for r in langid.predict(edges, none).collect()} == {("und", 0.0)}
    assert langid.predict(edges.limit(0), none).count() == 0


def test_known_words_come_first(spark):
    df = spark.createDataFrame([(1, "lala lala lolo", "aa"), (2, "lulu lala", "bb")], "doc_id long, text string, lang string")
    model = langid.fit(df)
    lala = model.of_words(["lala"])[0]
    assert lala[0] > lala[1] and np.array_equal(lala, model.logs[0][model.tables[0]["lala"]])
    unseen = model.of_words(["lol"])[0]  # its longest known run is ^lol
    assert np.array_equal(unseen, model.logs[4][model.tables[4]["^lol"]])


def toxic_rows(n, seed=1):
    draw = random.Random(seed)
    rows = []
    for i, text, _ in invented(n, seed):
        bad = draw.random() < 0.15
        words = text.split()
        for _ in range(draw.randrange(1, 4) if bad else 0):
            words.insert(draw.randrange(len(words) + 1), draw.choice(["Vileword", "scumbag", "rotter"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_held_out(spark):
    rows = toxic_rows(1500)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows if i % 2], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, train=F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [r for r in rows if r[0] % 3 == 1]
    right = [(got[i] >= 0.7) == bool(t) for i, _, t in held]
    assert sum(right) >= 0.97 * len(held)
    assert all(got[i] < 0.7 for i, _, t in rows if not t)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a " * 90_000), (None, "x"), (3, "again")], "doc_id long, text string").withColumn("score", F.lit("?"))
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0), (None, 1)], "doc_id long, toxic int")
    for model in (toxicity.fit(docs, labels), toxicity.fit(docs.limit(0), labels.limit(0)), toxicity.fit(docs.limit(0), labels)):
        scores = [r.score for r in toxicity.score(docs, model).collect()]
        assert len(scores) == 5 and all(0 <= s <= 1 for s in scores)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_rare_features_count_over_all_partitions(spark):
    """Words of three toxic texts each, mostly in different partitions of the sample."""
    draw = random.Random(3)
    bad = ["qworx", "zjupf", "xvimp", "wqyzt", "jhexk", "vfowq"]
    texts = [[] for _ in range(8)]
    for w in bad:
        for i in draw.sample(range(8), 3):
            texts[i].append(w)
    rows = [(i, " ".join([*t, f"lala{i}"])) for i, t in enumerate(texts)] + [(i, f"lolo tutu{i % 7}") for i in range(8, 3000)]
    labels = [(i, int(i < 8)) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {(f"^{w}$", 1) for w in bad} <= set(model.names)


def test_counts_in_parts_are_the_same(spark, monkeypatch):
    rows = toxic_rows(300)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    whole = toxicity.fit(docs, labels)
    seen = toxicity.Counter({("a", 1, True): 1, ("b", 1, False): 2, ("c", 2, True): 1})
    monkeypatch.setattr(toxicity, "COUNTS", 2)
    parts = [r for b in toxicity.counted(seen) for r in b.to_pylist()]
    assert {(r["name"], r["level"], r["positive"]): r["n"] for r in parts} == seen
    monkeypatch.setattr(toxicity, "COUNTED", 50)
    assert toxicity.fit(docs, labels).names == whole.names


def test_risk_stays_non_negative():
    draw = np.random.default_rng(1)
    positive = np.arange(400) < 100
    rows = [[0] if (p or draw.random() < 0.2) else [1] for p in positive]
    w, b = toxicity.nn_pu(rows, positive, 2, 0.2)
    assert toxicity.sigmoid(w[0] + b) > 0.7 > 0.3 > toxicity.sigmoid(w[1] + b)


def test_counts_as_brute_force(spark):
    """Features and their counts over several tasks, ids repeated thousands of times counting once."""
    rows = toxic_rows(200, seed=5)
    docs = spark.createDataFrame([r[:2] for r in rows] + [rows[7][:2]] * 3000, "doc_id long, text string").repartition(9)
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    bad = [text for _, text, t in rows if t]
    prior = len(bad) / len(rows)
    prior += (prior * (1 - prior) / len(rows)) ** 0.5
    assert abs(model.prior - prior) < 1e-12
    counts = [Counter(), Counter()]
    for which, texts in enumerate((bad, [text for _, text, _ in rows])):
        for text in texts:
            words = set(text.lower().split())
            runs = Counter(x for w in words for x in {f"^{w}$"} | {f"^{w}$"[i : i + n] for n in (3, 4, 5) for i in range(len(w) + 3 - n)})
            counts[which].update((x, level) for x, n in runs.items() for level in (1, 2, 4) if n >= level)
    want = {}
    for x, n in counts[0].items():
        p, u = n / len(bad), counts[1][x] / len(rows)
        usual = (counts[1][x] + 1) / (len(rows) + 2)
        evidence = len(bad) * (p * np.log(p / usual) + ((1 - p) * np.log((1 - p) / (1 - usual)) if p < 1 else 0))
        if p > u * max(1.2, toxicity.RATIO / prior) and evidence > toxicity.EVIDENCE:
            want[x] = p * np.log((p + 0.002) / (u + 0.002))
    assert model.names == sorted(want, key=lambda x: (-want[x], x)) and len(want) > 3


def test_gradient_of_the_risk():
    """One step of the training against differences of the risk, in both of its branches."""
    draw = np.random.default_rng(3)
    positive = np.arange(60) < 20
    rows = [sorted({*draw.integers(1, 5, 3).tolist()} | ({0} if p else set())) for p in positive]
    x = np.array([[float(i in r) for i in range(5)] + [1.0] for r in rows])

    def parts(w, prior):
        g = x @ w
        plus, minus = np.logaddexp(0, -g), np.logaddexp(0, g)
        return prior * plus[positive].mean(), minus[~positive].mean() - prior * minus[positive].mean()

    for prior, w in ((0.2, np.array([0.0, 0.3, -0.2, 0.1, 0.0, -1.4])), (0.9, np.array([5.0, 0, 0, 0, 0, -1]))):
        rest = parts(w, prior)[1]
        risk = (lambda v: sum(parts(v, prior))) if rest >= 0 else (lambda v: -parts(v, prior)[1])  # noqa: B023
        step = 1e-5 * np.eye(6)
        want = np.array([(risk(w + d) - risk(w - d)) / 2e-5 for d in step])
        assert np.allclose(toxicity.slopes(x @ w, positive, prior) @ x, want, atol=1e-6)
    assert rest < 0


def test_language_as_brute_force(spark):
    """Scores of texts by plain counting: words, then the longest known runs."""
    rows = invented(90, seed=4)
    df = spark.createDataFrame(rows + [rows[0]] * 2000, "doc_id long, text string, lang string").repartition(7)
    model = langid.fit(df)
    langs = sorted(SYLLABLES)
    assert model.languages == langs
    seen = [{lang: Counter() for lang in langs} for _ in range(6)]
    for _, text, lang in rows:
        for w in text.split():
            seen[0][lang][w] += 1
            for n in range(1, 6):
                marked = f"^{w}$" if n > 1 else w
                seen[n][lang].update(marked[i : i + n] for i in range(len(marked) - n + 1))

    def log(n, run):
        known = set().union(*seen[n].values())
        return [np.log((seen[n][lang][run] + 0.5) / (sum(seen[n][lang].values()) + 0.5 * (len(known) + 1))) for lang in langs]

    def of_word(w):
        if any(w in seen[0][lang] for lang in langs):
            return log(0, w)
        for n in range(5, 0, -1):
            marked = f"^{w}$" if n > 1 else w
            found = [log(n, r) for r in (marked[i : i + n] for i in range(len(marked) - n + 1)) if any(r in seen[n][lang] for lang in langs)]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(3)

    texts = [t for _, t, _ in invented(40, seed=9)] + ["kaschreau " * 3 + "zzz", "x" * 300 + " lo", "9 lo"]
    got = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        words = [w for w in texts[r.doc_id].split() if not w.isdigit()]
        total = np.mean([of_word(w) for w in words], axis=0) * min(len(words), langid.EVIDENCE)
        assert r.lang_pred == langs[int(total.argmax())]
        assert abs(r.score - 1 / np.exp(total - total.max()).sum()) < 1e-9
