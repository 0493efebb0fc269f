"""A corpus in five stages: each takes what its predecessor kept, written as Parquet and read again.

toxicity drops documents that the classifier chain rejects; near_duplicates keeps one document of
each component; secrets replaces secrets in texts by a mark; mixing repeats or drops documents so
that sources come near their target weights; tokens encodes every remaining row and keeps its ids.
All but the last return the columns of documents.

Cases: null and empty texts are kept, have no tokens, and are near duplicates of nothing; rows that
repeat an id are judged together by near_duplicates, which keeps or drops all of them; empty tables
stay empty; columns are found by place, so others whose names differ in case only do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm import minhash, mixing, pieces, secrets, toxicity
from spectraloom.llm.common import Tables, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.kept(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = minhash.cluster(docs).where(~F.col("kept")).select("doc_id").distinct()
    dropped = Tables(spark, "pipeline").save(out, "dropped")
    few = dropped.count() <= minhash.BROADCAST_IDS
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("doc_id", F.col(f"c{names.index('doc_id')}"))
    return plain.join(F.broadcast(dropped) if few else dropped, "doc_id", "left_anti").select(*(f"c{i}" for i in range(len(names)))).toDF(*names)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and source of every row; texts can be had again by decoding."""
    return pieces.tokens(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash", minhash_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", tokens_stage),
]

#: SQL cannot express the classifier, the guess costs and the encoding; tests/llm has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, docs, before = Tables(spark, "corpus"), table(spark, sf_dir, "documents"), ()
    for name, stage in STAGES:
        docs = store.save(stage(spark, docs, sf_dir), name)
        store.drop(*before)
        before = (name,)
    return docs
