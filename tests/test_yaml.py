import random

import pytest
from pyspark.sql import functions as F

from quirefold.operators import toc
from quirefold.sources import store, yaml_text
from quirefold.sources.settings import KeyValues

TEXTS = [
    ("- {allcount: 1}\n- {title: '題', noveltype: 2, end: 0}\n", [{"allcount": 1}, {"title": "題", "noveltype": 2, "end": 0}]),
    ("a:\n  b: 'x\n\n    y z'\n  c: \"q \\\n    r\\n\\u3042\"\nd: |\n  l1\n   l2\n\n  l3\ne: plain\n  more\n\n  last # c\n", {"a": {"b": "x\ny z", "c": "q r\nあ"}, "d": "l1\n l2\n\nl3\n", "e": "plain more\nlast"}),
    ("g:\n- 1\n-\n- k: v\n  w: [a, b: c]\nh: yes\ni: 0x1F\nj: 10:30\nk: 1_000.5\nl: 017\nm: ~\n", {"g": [1, None, {"k": "v", "w": ["a", {"b": "c"}]}], "h": True, "i": 31, "j": 630, "k": 1000.5, "l": 15, "m": None}),
    ("a: |+\n  x\n\n\nb: |2\n   y\nc: >-\n  q\n\n   deep\n  r\n", {"a": "x\n\n\n", "b": " y\n", "c": "q\n\n deep\nr"}),
    ("﻿%YAML 1.1\n# c\n---\r\nt: 2024-01-02 10:00\r\nu: http://x/y#z\r\n...\nrest", {"t": "2024-01-02 10:00", "u": "http://x/y#z"}),
    ("", None), ("　", "　"), ("'it''s'", "it's"), ("{}", {}), ("[[], {a: }]", [[], {"a": None}]),
]
BROKEN = ["a: b: c", "a: [1", "a: 'x", "a: b\n c: d", "- a\nb: 1", "a: &x 1", "a: !!str 1", "? a\n: b", "a: - b", "\ta: 1", "a:\n  b: 1\n c: 2", "'x' y"]


def test_documents():
    assert [yaml_text.load(t) for t, _ in TEXTS] == [v for _, v in TEXTS]
    for text in BROKEN:
        with pytest.raises(ValueError):
            yaml_text.load(text)
    assert yaml_text.load(yaml_text.dump({"a b": [1, None, {"x": "é\n"}], "yes": True})) == {"a b": [1, None, {"x": "é\n"}], "yes": True}


def test_as_another_reader():
    yaml = pytest.importorskip("yaml")
    draw = random.Random(4)
    parts = ["a", "b", " ", "\n", ": ", "#", "'", '"', "\\", "「", "　", "é", "- ", "\t", "-", "0", "1:2", "yes", "😀", "{", "]", ",", "|", "\x07", "  ", "x" * 30 + " "]
    text = lambda: "".join(draw.choice(parts) for _ in range(draw.randrange(0, 25)))
    for i in range(500):
        value = {"index": str(i), "element": {"body": text() + text(), "data_type": draw.choice(["text", None, 1, True, 2.5])}, "t x": [text(), {"q": text(), "r": [text()]}, [], {}]}
        shown = yaml.dump(value, allow_unicode=draw.random() < 0.8, default_flow_style=draw.choice([False, None, True]), width=draw.choice([80, 20]))
        assert yaml_text.load(shown) == yaml.safe_load(shown), shown


def test_columns_and_replies(spark):
    rows = [t for t, _ in TEXTS] + BROKEN + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = [r.j for r in df.select("i", yaml_text.to_json(F.col("t")).alias("j")).orderBy("i").collect()]
    assert [j is None for j in got] == [False] * len(TEXTS) + [True] * (len(BROKEN) + 1)
    replies = ["<html><body>Service Unavailable</body></html>", "[{allcount: 0}]", "[1, 2]", "- {allcount: 0}\n- {}\n", "- {allcount: 1}\n- {title: 'T', writer: 'A', noveltype: 2, end: 0}\n", "- {allcount: 1}\n- {end: 1}\n", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(replies)], "i int, t string")
    got = [r.x for r in df.select("i", toc.api_info(yaml_text.to_json(F.col("t"))).alias("x")).orderBy("i").collect()]
    assert got[:4] == [None] * 4 and got[6] is None
    assert (got[4].title, got[4].writer, got[4].novel_type, got[4].end) == ("T", "A", 2, True) and (got[5].writer, got[5].novel_type, got[5].end) == ("", 1, False)


def test_files(spark, tmp_path):
    folder = tmp_path / "works" / "12" / "本文"
    folder.mkdir(parents=True)
    (folder / "1 a.yaml").write_text("index: '1'\nsubtitle: 題\nelement:\n  body: \"x\\n\n    y\"\n  data_type: text\ndownload_time: a\n", encoding="utf-8")
    (folder / "2 b.yaml").write_text("index: '2'\nelement: {body: 'two'}\n---\nindex: '1'\nsubtitle: newer\ndownload_time: b\n", encoding="utf-8")
    (folder / "3 c.yaml").write_text("a: [1", encoding="utf-8")
    (folder / "4 d.yaml").write_text("- 1\n", encoding="utf-8")
    (folder / "5 e.txt").write_text("index: 9", encoding="utf-8")
    rows = store.read_yaml(spark, str(tmp_path / "works"), store.SECTIONS).collect()
    assert sorted((r.file[-6:], r.warning) for r in rows) == [("a.yaml", None), ("b.yaml", None), ("b.yaml", None), ("c.yaml", "can't be read"), ("d.yaml", "isn't a map")]
    assert {r.work for r in rows} == {"12"}
    got = {r['index']: r for r in store.read_sections(spark, str(tmp_path / "works"), "yaml").collect()}
    assert set(got) == {"1", "2"} and got["1"].subtitle == "newer" and got["2"].element.body == "two" and got["2"].work_id == 12
    texts = ["", None, "a\n---\nb", "---\n", "q\"'\\ \t\u2028\x85 　: - #", "\n\n x \n", "[x]", "😀"]
    made = spark.createDataFrame([(i, str(i), None, "", t, t, None, "d", (t, t, None, "text"), "now") for i, t in enumerate(texts)], store.SECTIONS)
    store.write_sections(made, str(tmp_path / "out"), form="yaml")
    again = store.read_sections(spark, str(tmp_path / "out"), "yaml")
    assert sorted(map(str, again.collect())) == sorted(map(str, made.collect()))


def test_key_values(tmp_path):
    folders = {"local": tmp_path / "a", "global": tmp_path / "b"}
    kept = KeyValues(folders=folders)
    kept.set("x", [1, "é"])
    kept.set("y", None)
    kept.set("x", "hidden", "global")
    kept.set("z", 2.5, "global")
    kept.save()
    again = KeyValues(folders=folders)
    assert again.get("x") == [1, "é"] and again.get("y", 3) is None and again.get("z") == 2.5 and again.get("none", 4) == 4
    again.delete("x")
    again.save()
    assert KeyValues(folders=folders).get("x") == "hidden"
    (tmp_path / "a" / "settings.yaml").write_text("- no map")
    assert KeyValues(folders=folders).scopes["local"] == {}
    memory = KeyValues()
    memory.set("a", 1)
    memory.save()
    assert memory.get("a") == 1
