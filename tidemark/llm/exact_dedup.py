"""Exact dedup in DataFrame operations: local winners, salted digest groups, global winners.

Every combining stage groups by the digest *and* the whole normalised text, so
two different texts never meet in a group even if their digests are equal.

Defined cases: a null text counts as empty; a null ``doc_id`` is never smaller
than another and keeps its group only if the group has no other id; rows that
repeat an id and a text are one document for ``group_exact`` (all carry the
same decision) and one row for ``keep_first``; an empty table gives an empty
result; other columns, whatever their names, are untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, written

SPACE = r"[\x20\x09-\x0D]+"
#: Salts of a digest in the second stage. A group sends one row per input split to its salts, whatever its size.
SALTS = 32


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def winners(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(_digest, _text, keep_id, group_size) per different text.

    The salt is the input split. The partial aggregate in front of the first
    exchange is the local dedup: a text leaves a split once, however often it
    occurs there. The salts of a text are combined by the second aggregate.
    """
    rows = docs.select(
        F.col("doc_id").alias("_id"), normalised(F.col("text")).alias("_text"),
        F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("_salt"),
    ).withColumn("_digest", digest(F.col("_text")))
    salted = rows.groupBy("_digest", "_salt", "_text").agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    return salted.groupBy("_digest", "_text").agg(F.min("_id").alias("keep_id"), F.sum("_n").alias("group_size"))


def groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> tuple[DataFrame, DataFrame | None]:
    """Digests of one text: (_digest, keep_id, group_size); and the texts that share a digest with another, or None.

    The combining stages have compared whole texts, so a digest with a single
    row stands for one text and a join with it needs no text any more.
    """
    texts = winners(docs, digest)
    slim = written(
        texts.groupBy("_digest").agg(
            F.count(F.lit(1)).alias("_texts"), F.min("keep_id").alias("keep_id"), F.min("group_size").alias("group_size")
        ), "exact-groups",
    )
    clash = slim.filter("_texts > 1").select("_digest")
    alone = slim.filter("_texts = 1").drop("_texts")
    return alone, (None if clash.isEmpty() else written(texts.join(clash, "_digest", "left_semi"), "exact-clashes"))


def _joined(left: DataFrame, alone: DataFrame, clash: DataFrame | None, text: str, *and_on: tuple[str, str]) -> DataFrame:
    """``left`` (with _digest) beside its group. Both sides are exchanged for this join alone, so a hot group can be split."""
    def on(right: DataFrame):
        cond = left["_digest"] == right["_digest"]
        for mine, other in and_on:
            cond = cond & (left[mine] == right[other])
        return cond

    found = [*left.columns]
    out = left.join(alone, on(alone)).select(*(left[c] for c in found), alone["keep_id"], alone["group_size"])
    if clash is not None:
        more = left.join(clash, on(clash) & (normalised(left[text]) == clash["_text"]))
        out = out.unionByName(more.select(*(left[c] for c in found), clash["keep_id"], clash["group_size"]))
    return out


def group_exact(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (columns doc_id and text)."""
    rows = docs.select("doc_id", "text")
    alone, clash = groups(rows, digest)
    left = rows.withColumn("_digest", digest(normalised(F.col("text"))))
    plain = digest is sha256
    if plain and clash is None:
        left = left.drop("text")
    out = _joined(left, alone, clash, "text")
    name = F.lower(F.hex("_digest")) if plain else F.sha2(normalised(F.col("text")), 256)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), name.alias("text_sha256"))


def keep_first(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The row with the smallest id of every text, with all columns of ``docs``.

    Rows meet their group by digest and id, so a group sends one row to the join.
    """
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    left = docs.select(*(docs[c].alias(n) for c, n in names.items()))
    text, key = names["text"], names["doc_id"]
    alone, clash = groups(docs.select("doc_id", "text"), digest)
    left = left.withColumn("_digest", digest(normalised(F.col(text))))
    out = _joined(left, alone, clash, text, (key, "keep_id")).dropDuplicates(["_digest", key] + ([text] if clash is not None else []))
    nameless = alone.filter("keep_id is null")
    more = clash.filter("keep_id is null") if clash is not None else None
    if not nameless.isEmpty() or (more is not None and not more.isEmpty()):
        rest = _joined(left.filter(F.col(key).isNull()), nameless, more, text)
        out = out.unionByName(rest.dropDuplicates(["_digest"] + ([text] if clash is not None else [])))
    return out.select(*(F.col(n).alias(c) for c, n in names.items()))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_exact(documents(spark, sf_dir))


SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
