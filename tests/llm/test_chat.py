import random

from pyspark.sql import functions as F

from quirefold.llm import chat


def brute(rows):
    """{(conv, speaker): (whole text, text of the assistant's spans)}, for turns without ties."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0))
        names = [(r[2] or "unknown").replace("<|", "< |") for r in turns]
        for own in set(names) - {"system"}:
            text, spans = "", ""
            for name, r in zip(names, turns):
                body = (r[3] or "").replace("<|", "< |") + "<|end|>\n"
                text += ("<|assistant|>" if name == own else "<|system|>" if name == "system" else f"<|user:{name}|>") + "\n" + body
                spans += body if name == own else ""
            out[conv, own] = (text, spans)
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (str(r.conv_id), r.speaker, r.part)):
        text, spans = out.get((r.conv_id, r.speaker), ("", ""))
        assert r.char_offset == len(text)
        out[r.conv_id, r.speaker] = (text + r.text, spans + "".join(r.text[m.start : m.end] for m in r.masks))
    return out


def test_against_brute_force(spark):
    draw = random.Random(1)
    rows = [(c, t, draw.choice(["ann", "bob", "cy", "system", None]), draw.choice(["é" * 9, "", None, "<|assistant|>", "x" * 5000])) for c in range(30) for t in range(draw.randrange(1, 9))]
    rows += [(99, t, draw.choice(["ann", "bob"]), f"t{t}") for t in range(1000)] + [(None, 0, "ann", "no id"), (100, None, "zed", "last"), (100, 3, "ann", "first"), (101, 0, "system", "alone")]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"speaker": F.lit("?"), "part": F.lit("?")})
    want = brute(rows)
    assert collected(chat.perspectives(df)) == want
    assert chat.perspectives(df.limit(0)).count() == 0


def test_ties_are_cut(spark, monkeypatch):
    monkeypatch.setattr(chat, "LARGE", 100)
    rows = [(1, 5, "ann", f"n{i}") for i in range(900)] + [(1, 6, "bob", "again")] * 450 + [(1, None, "bob", f"z{i}") for i in range(300)] + [(1, 1, "ann", "first")]
    got = chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for who in ("ann", "bob"):
        parts = sorted((r for r in got if r.speaker == who), key=lambda r: r.part)
        assert [p.part for p in parts] == list(range(len(parts))) and max(p.n_turns for p in parts) <= 250
        text = "".join(p.text for p in parts)
        bodies = [b.partition("|>\n")[2] for b in text.split("<|end|>\n")[:-1]]
        assert sorted(bodies) == sorted(r[3] for r in rows)
        assert bodies[0] == "first" and bodies[901:1351] == ["again"] * 450
    assert sum(m.end - m.start for r in got if r.speaker == "bob" for m in r.masks) == sum(len(r[3]) + 8 for r in rows if r[2] == "bob")
