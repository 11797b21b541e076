import hashlib
import re
from collections import defaultdict

import pytest
from cases import empty_docs, odd_docs, random_texts, table
from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import group_exact, keep_first, sha256


def one_byte(text):
    """A digest that many texts share."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 1))


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
    out = []
    for i, t in rows:
        norm = re.sub("[\x20\x09-\x0d]+", " ", t or "")
        ids = [x for x in groups[norm] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("digest", [sha256, one_byte])
def test_groups_equal_brute_force(spark, digest):
    docs = table(spark, random_texts(300, words=4, vocabulary=3))
    rows = [tuple(r) for r in docs.collect()]
    assert sorted(repr(tuple(r)) for r in group_exact(docs, digest).collect()) == expected(rows)
    kept = keep_first(docs, digest)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({int(e.split(",")[1]) for e in expected(rows)})


@pytest.mark.parametrize("digest", [sha256, one_byte])
def test_odd_rows(spark, digest):
    docs = odd_docs(spark, clashes=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(repr(tuple(r)) for r in group_exact(docs, digest).collect()) == expected(rows)
    kept = keep_first(docs, digest)
    assert kept.columns == docs.columns
    # 2 repeats 1, 9 is one space, 3, 4 and the nameless null row are empty; the nameless text has no other id.
    assert sorted(kept.select("doc_id").toPandas().doc_id.dropna()) == [1, 3, 5, 6, 7, 8, 9]
    assert kept.filter("doc_id is null").count() == 1


def test_empty(spark):
    assert group_exact(empty_docs(spark)).count() == 0
    assert keep_first(empty_docs(spark)).count() == 0


def test_plan_is_native_and_the_hot_group_is_combined_before_the_exchange(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("text"))
    out = group_exact(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert out.filter("group_size > 1").agg(F.max("group_size")).first()[0] == 13_333
