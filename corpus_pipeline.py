"""From raw documents to token ids: five stages, each on all that the one before has kept.

A stage is (name, function of (spark, docs, sf_dir)). Its result is written as
Parquet and read again as the ``docs`` of the next stage; all but the last
return the columns of ``documents``. Nulls, empty and very long texts, repeated
rows, empty tables and further columns are handled as the operators' modules
say: a null text is an empty one, and an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, exact_dedup, near_dedup, quality, sentencepiece_fst
from tidemark.llm.common import documents, drop_scratch_since, last_scratch, scratch_mark, written
from tidemark.llm.labels import labels_of


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject (score of 0.3 or more)."""
    return quality.keep_good(docs, quality.learn(docs, labels_of(spark, sf_dir)))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of every text, white space aside."""
    return exact_dedup.keep_first(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of 0.8 or more."""
    return near_dedup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of the benchmark; documents that are mostly benchmark go."""
    return decontaminate.remove_passages(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding the ids gives the text back."""
    found, ids, decoded = sentencepiece_fst.encode_column(docs.select("doc_id", "text"))
    same = F.coalesce(F.col("text"), F.lit("")) == F.col(decoded)
    return found.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.col(ids).alias("ids"), same.alias("round_trip"))


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_documents),
    ("near dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("sentencepiece", token_ids),
]

#: Trained scores and the model file have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; of the scratch tables only the last stage's input is left when it returns."""
    docs = documents(spark, sf_dir)
    *inner, (_, last) = STAGES
    mark = scratch_mark()
    for name, stage in inner:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        drop_scratch_since(spark, mark, last_scratch())
    return last(spark, docs, sf_dir)
