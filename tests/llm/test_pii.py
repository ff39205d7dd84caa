import random
import re
from collections import defaultdict
from hashlib import sha256
from math import log2

from quirefold.llm import pii, queries

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def good(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if good(kind, m[0]))


def test_patterns():
    draw = random.Random(5)
    parts = ["a@b.c", "x.y_z@", "@", "mail8.example.com", "4111 1111-1111 1111", "4041894974608795", "0", "12", ".", "..", "-", " ", "+1 (386) 555-3733", "+49", "1.2.3.4", "256.1.1.1", "001.002.003.0004", "é", "_", "١", "%", "(", ")"]
    for _ in range(20_000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(0, 14)))
        assert pii.base_spans(text) == plain(text), text
    for text in ("9" * 300_000, "a" * 300_000 + "@", "@a" * 100_000, "1." * 100_000, "+1" * 100_000, "a.b-" * 50_000):
        pii.base_spans(text)  # in time that follows the length


def test_disclosing_terms(spark):
    draw = random.Random(2)
    filler = lambda n: " ".join(f"{draw.choice('bcdfghklmn')}o{draw.choice('bcdfghklmn')}a{draw.choice('bcd')}" for _ in range(n))
    rows = [(i, f"{filler(40)} contact Maribel of maria.b@mail.example.com {filler(40)}") for i in range(8)]
    rows += [(20 + i, f"{filler(30)} contact Someone {filler(20)} marigold {filler(20)} marinade {filler(9)}") for i in range(60)]
    rows += [(100 + i, "one text that is copied, Copycat at 10.20.30.40 in all of it") for i in range(30)]
    rows += [(200, None), (201, ""), (None, f"{filler(300)} maribel {filler(10)} Maribel@"), (None, "x" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as spans", "2 as entity", "3 as n").repartition(3)
    terms = {r.term: r.general for r in pii.disclosing_terms(df).collect()}
    # the same by plain counts
    seen, beside, of, n_words, words = defaultdict(set), defaultdict(int), defaultdict(int), 0, defaultdict(int)
    for _, text in rows:
        text = text or ""
        spans = pii.base_spans(text)
        rest = pii.masked(text, spans)
        assert len(rest) == len(text)
        own = [x.lower() for x in re.findall(r"\w{3,}", rest)]
        n_words += len(own)
        for w in own:
            for f in pii.forms(w):
                words[f] += 1
        for s, k, e in spans:
            key, near = (k, text[s:e]), pii.around(rest, s, e)
            of[key] += 1
            for f in {f for t in near for f in pii.forms(t)}:
                beside[key, f] += 1
            for t in near:
                seen[key, t].add(tuple(near))

    def discloses(key, f):
        return log2(n_words * beside[key, f] / (of[key] * words[f])) >= pii.DISCLOSURE * log2(n_words / of[key])

    want = {}
    for (key, t), contexts in seen.items():
        if len(contexts) >= pii.SUPPORT and discloses(key, t):
            want[t] = next((f for f in pii.forms(t)[1:] if not discloses(key, f)), None)
    assert terms == want and set(terms) == {"maribel"} and terms["maribel"] == "mari*"
    found = pii.redact(pii.detect(df))
    assert {"spans", "entity", "n", "sanitised"} <= set(found.columns)
    got = {r.doc_id: r for r in found.collect()}
    assert "contact mari* of <email> " in got[0].sanitised and "Copycat at <ip> in" in got[100].sanitised and got[20].sanitised == rows[8][1]
    assert [x.kind for x in got[0].spans] == ["term", "email"] and got[200].sanitised == got[201].sanitised == "" and not got[200].spans
    assert pii.detect(df.limit(0)).count() == 0 and pii.disclosing_terms(df.where("doc_id >= 200")) is None


def test_around():
    text = "alpha beta gamma@x.yz delta epsilon"
    (start, _, end), = pii.base_spans(text)
    assert pii.around(pii.masked(text, [(start, 0, end)]), start, end) == ["alpha", "beta", "delta", "epsilon"]
    long = "x" * 500 + " near 1.2.3.4 near " + "y" * 500
    (start, _, end), = pii.base_spans(long)
    assert pii.around(pii.masked(long, [(start, 1, end)]), start, end) == ["near"]


def test_query(spark):
    data = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in queries.op12_disclosed_terms(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for doc_id, text in docs:
        r, spans = rows[doc_id], plain(text or "")
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert r.base_sha256 == sha256(said.encode()).hexdigest()
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("term")) == said
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows.values()) > 5
