import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[1]))
from compare import differences

import corpus_pipeline
from quirefold.llm import minhash, queries

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_follow_one_another(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, DATA)
        assert kept.columns == names
        ids, before = Counter(r.doc_id for r in kept.select("doc_id").collect()), Counter(r.doc_id for r in docs.select("doc_id").collect())
        assert ids <= before
        if name == "near_duplicates":
            assert set(ids) == {r.doc_id for r in minhash.near_duplicates(docs).where("kept").collect()}
        docs = spark.createDataFrame(kept.collect(), kept.schema)
    packed = corpus_pipeline.run(spark, DATA)
    assert {r.doc_id for r in packed.collect()} == set(ids)


def test_edges_of_stages(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "the same text of seven words here", "en", "s", 1), (3, "the same text of seven words here", "en", "s", 1), (4, "the same text of seven words here", "en", None, 1), (None, "no id at all", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates_stage(spark, df, DATA).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "3", "None"]
    assert corpus_pipeline.toxicity_stage(spark, df, DATA).count() == 6
    assert {r.doc_id for r in corpus_pipeline.language_stage(spark, df, DATA).collect()} == {3, 4, None}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), DATA).count() == 0


def test_queries_with_sql(spark):
    for name, sql in queries.SQL.items():
        assert not differences(spark, queries.QUERIES[name], sql, DATA)
