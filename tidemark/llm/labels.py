"""Bounded samples of labelled texts, and the columns that scorers add."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freeing, fresh, held_out, written


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, per_label: int) -> DataFrame:
    """(doc_id, y, text): about ``per_label`` whole texts of each label outside the held-out fold, chosen by the hash of the id; written.

    The share to take is computed from the counts of the labels, so the rows are
    bounded at every size. An id with both labels has none; of an id with
    several texts the one with the smallest hash is taken.
    """
    y = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y")).filter("y in (0, 1) and _id is not null")
    y = y.filter(~held_out(F.col("_id"))).groupBy("_id").agg(F.min("y").alias("y"), F.max("y").alias("_other")).filter("y = _other")
    counts = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col("y") == value, min(1.0, per_label / n)).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit(label), F.col("_id")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    y = y.filter(draw < share).select("_id", "y")
    # The drawn ids are as bounded as the sample, so they are sent to the documents, whose texts stay where they are.
    rows = docs.select(F.col("doc_id").alias("_id"), "text").filter("text is not null and text <> ''").join(F.broadcast(y), "_id")
    one = rows.groupBy("_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    return written(one.select(F.col("_id").alias("doc_id"), "y", "text"), "labelled")


def learnt_share(labels: DataFrame, label: str) -> float | None:
    """Share of label 1 among all rows labelled 0 or 1 outside the held-out fold."""
    rows = labels.filter(~held_out(F.col("doc_id"))).filter(F.col(label).cast("int").isin(0, 1))
    return rows.agg(F.avg(F.col(label).cast("double")).alias("p")).first()["p"]


def add_column(docs: DataFrame, name: str, kind: T.DataType, model, of: Callable, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a column of ``of(model, texts)`` per batch of whole texts, and the column's name; ``model`` is broadcast."""
    name, at = fresh(docs, name), docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, kind)])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, of(sent.value, batch.column(at).cast(pa.string()))], names=[f.name for f in schema.fields])
        finally:  # a worker keeps the model for later tasks, but not what it made of it
            release = getattr(sent.value, "release", None)
            if release is not None:
                release()

    return docs.mapInArrow(freeing(scan), schema), name
