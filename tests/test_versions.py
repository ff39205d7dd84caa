import pytest
from pyspark.sql import functions as F

from quirefold.sources.versions import Conflict, Versions
from quirefold.streaming.snapshots import follow, kept_snapshot

SCHEMA = "work_id long, index string, ordinal long, subtitle string, chapter string, subdate string, subupdate string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def table(spark, tmp_path, n=8):
    schema = spark.createDataFrame([], "work_id long, t string").schema
    return Versions(spark, str(tmp_path / "t"), schema, n_buckets=n), lambda *r: spark.createDataFrame(r, schema)


def test_only_touched_buckets_are_written(spark, tmp_path):
    store, of = table(spark, tmp_path)
    assert rows(store.read()) == [] and store.upsert(of(*[(i, "a") for i in range(100)], (None, "n"))) == 1
    before = store.version()
    assert store.upsert(of((3, "b"), (3, "c"))) == 2
    after = store.version()
    assert [b for b in after.buckets if after.buckets[b] != before.buckets[b]] == [str(store.touched(of((3, "")))[0])]
    assert rows(store.read()) == rows(of(*[(i, "a") for i in range(100) if i != 3], (3, "b"), (3, "c"), (None, "n")))
    assert rows(store.read(1)) == rows(of(*[(i, "a") for i in range(100)], (None, "n")))
    store.upsert(of((None, "m")))
    assert rows(store.read().where("work_id is null")) == [(None, "m")]
    store.upsert(of((3, "c"), (3, "d")), on=["work_id", "t"])
    assert rows(store.read().where("work_id = 3")) == [(3, "b"), (3, "c"), (3, "d")]
    assert store.upsert(of()) == 5 and store.read().count() == 103


def test_a_write_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    store, of = table(spark, tmp_path)
    store.upsert(of((1, "a"), (2, "a")))
    with monkeypatch.context() as m:
        m.setattr(Versions, "_publish", lambda self, v: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            store.upsert(of((1, "b")))
    with pytest.raises(Exception, match="bad row"):
        store.append(of((1, "x")).withColumn("t", F.raise_error(F.lit("bad row"))))
    assert rows(store.read()) == [(1, "a"), (2, "a")] and len(store._names("data")) >= 2
    assert store.upsert(of((1, "c"))) == 2 and rows(store.read()) == [(1, "c"), (2, "a")]
    gone = store.vacuum()
    assert gone and rows(store.read()) == [(1, "c"), (2, "a")] and rows(store.read(1)) == [(1, "a"), (2, "a")]


def test_two_writers(spark, tmp_path, monkeypatch):
    store, of = table(spark, tmp_path)
    store.append(of((1, "a")))
    late = store.version()
    store.append(of((1, "b")))
    with monkeypatch.context() as m:
        m.setattr(store, "version", lambda number=None: late)
        with pytest.raises(Conflict):
            store.append(of((1, "c")))
    assert rows(store.read()) == [(1, "a"), (1, "b")]


def test_numbered_commits_appends_and_compaction(spark, tmp_path):
    store, of = table(spark, tmp_path, 2)
    for k in range(9):
        store.append(of((k, "x")), "w", k)
        store.append(of((k, "again")), "w", k)
    assert rows(store.read()) == [(k, "x") for k in range(9)] and store.done("w", 8) and not store.done("w", 9) and not store.done("v", 0)
    numbers = store.numbers()
    assert store.compact(3) > numbers[-1] and max(len(x) for x in store.version().buckets.values()) < 3
    assert rows(store.read()) == [(k, "x") for k in range(9)]
    store.vacuum(1)
    assert len(store.numbers()) == 1 and len(store._names("data")) <= 2 and rows(store.read()) == [(k, "x") for k in range(9)]
    with pytest.raises(ValueError):
        Versions(spark, "x", spark.createDataFrame([], "work_id long, Bucket int").schema)


def test_batches_follow_their_works(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    path = {k: str(tmp_path / k) for k in ("in", "state", "changes", "check")}

    def batch(*data):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path["in"])
        follow(spark.readStream.schema(schema).parquet(path["in"]), schema, path["state"], path["changes"], path["check"], n_buckets=16).awaitTermination()

    row = lambda w, i, title: (w, str(i), i, title, "", "1", "")
    batch(*[row(w, i, "a") for w in range(40) for i in range(3)])
    state = Versions(spark, path["state"], schema)
    before = state.version()
    batch(row(7, 1, "b"), row(7, 1, "b"), row(7, 5, "new"))
    after = state.version()
    assert sum(after.buckets[b] != before.buckets.get(b) for b in after.buckets) == 1
    batch(row(7, 1, "c"))
    assert len(state.numbers()) == 2  # older versions have gone
    assert {(r["index"], r.subtitle) for r in kept_snapshot(spark, path["state"], schema).where("work_id = 7").collect()} == {("0", "a"), ("1", "c"), ("2", "a"), ("5", "new")}
    assert kept_snapshot(spark, path["state"], schema).count() == 121
    got = spark.read.parquet(path["changes"]).where("batch > 0").collect()
    assert sorted((r.batch, r["index"], r.reason) for r in got) == [(1, "1", "title"), (1, "5", "new"), (2, "1", "title")]
    # the last batch once more, as after a crash behind the state's commit: nothing changes
    import shutil

    shutil.rmtree(f"{path['check']}/commits")
    number = state.version().number
    follow(spark.readStream.schema(schema).parquet(path["in"]), schema, path["state"], path["changes"], path["check"], n_buckets=16).awaitTermination()
    assert state.version().number == number
