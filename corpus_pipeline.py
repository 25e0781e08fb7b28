"""The corpus pipeline: from raw documents to a sharded training mix.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns the
columns of documents; the last one adds the shard and the slot. Between stages rows are Parquet
in the shared folder, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dutyframe.llm import decontamination, minhash, mixing, sharding, toxicity
from dutyframe.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on the labelled ones, calls toxic go.

    Each row is judged by its text alone: repeated rows go or stay together, a null or empty text stays.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_ordinary(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingle similarity, the one with the smallest doc_id stays.

    Of rows that repeat this doc_id in one group, one stays: the first by text hash.
    """
    found = minhash.near_duplicates(docs, width=5)
    return minhash.keep_one(docs, found)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    Each row is judged by its text alone: repeated rows go or stay together, a null or empty text stays, as do rows with a null doc_id unless they hold one.
    """
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out, taken once, or repeated, as the sources' target weights ask.

    A null source is one of its own; a text without words adds none and is left out; repeated rows are drawn one by one.
    """
    return mixing.take(docs)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard of 16 and its slot there. A null doc_id is hashed as the empty text; repeated rows get a slot each."""
    return sharding.shard_table(docs, carry=tuple(c for c in docs.columns if c != "doc_id"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", into_shards),
]

#: Trained classifiers, sketches and seeded draws have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
