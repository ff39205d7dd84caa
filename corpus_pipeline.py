"""The stages that turn documents into packed training sequences.

Each stage works on all documents that the one before kept. Its decisions take effect, and all but the last return the
columns of documents:

- toxicity: documents that score TOXIC or more go;
- language: documents without any letter, or of no language that is likelier than all others together, go;
- near_duplicates: of each group of documents that are alike by 0.8 or more in their five-word shingles, the one of the
  smallest id stays; documents without id stay, and of rows that repeat an id one stays if the id does;
- packing: documents become pieces in bins of packing.CAPACITY tokens.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import langid, minhash, packing, toxicity
from quirefold.llm.common import cut, shared_dir, table
from quirefold.llm.queries import TOXIC, crc_mod

LIKELY = 0.5


def unused(name: str, df: DataFrame) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def columns(df: DataFrame) -> list[str]:
    return [f"`{c}`" for c in df.columns]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts score like texts without features, so they stay; copies of a row score alike."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), train=crc_mod(3) != 1)
    score = unused("toxicity", docs)
    return toxicity.score(docs, model, score_col=score).where(F.col(score) < TOXIC).select(columns(docs))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What it is to remove is text that no model of languages can use: digits, marks and codes without letters (null
    and empty texts too), and mixtures in which no language outweighs the others. Clean tables lose nothing."""
    model = langid.fit(docs, train=crc_mod(5) != 0)
    lang, likely = unused("lang", docs), unused("likely", docs)
    found = langid.predict(docs, model, lang_col=lang, score_col=likely)
    return found.where((F.col(lang) != langid.UNDETERMINED) & (F.col(likely) > LIKELY)).select(columns(docs))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts are linked with nothing and stay."""
    judged = cut(minhash.near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")))

    def ids(which: str) -> DataFrame:
        found = judged.where(which).select("doc_id")
        return F.broadcast(found) if found.count() <= minhash.BROADCAST else found

    kept = docs.join(ids("not kept"), "doc_id", "left_anti").select(columns(docs))
    repeated = ids("kept and n > 1")
    once = kept.join(repeated, "doc_id", "left_anti").select(columns(docs))
    return once.unionByName(kept.join(repeated, "doc_id", "left_semi").select(columns(docs)).dropDuplicates(["doc_id"]))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts are pieces of one token."""
    return packing.best_fit(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicates_stage),
    ("packing", packing_stage),
]

#: Trained models and hashed buckets: no SQL gives run()'s rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES, one after another; what a stage returns is written to the shared folder for the next one."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
