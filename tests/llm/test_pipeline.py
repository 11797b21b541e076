import hashlib
import re

import corpus_pipeline
import pytest
from cases import empty_docs, odd_docs
from test_decontaminate import expected as leaks
from test_near_dedup import expected as near

from tidemark.llm import quality
from tidemark.llm.common import documents, written
from tidemark.llm.labels import labels_of
from tidemark.llm.sentencepiece_fst import SentencePiece

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage."""
    docs = documents(spark, SF)
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "test-pipeline")
        out.append(docs.collect())
    return out


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_quality_stage(spark, stages):
    model = quality.learn(documents(spark, SF), labels_of(spark, SF))
    assert ids(stages[1]) == [r.doc_id for r in sorted(stages[0]) if model.score(r.text) >= 0.3]


def test_exact_stage(stages):
    first = {}
    for r in sorted(stages[1]):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r.text), r.doc_id)
    assert ids(stages[2]) == sorted(first.values())


def test_near_stage(stages):
    rows = stages[2]
    want = near([r.doc_id for r in rows], [r.text for r in rows], 5, 80, 100)
    assert ids(stages[3]) == sorted(int(w.split(",")[2].strip(" )")) for w in set(want) if eval(w)[0] == eval(w)[2])


def test_benchmark_stage(spark, stages):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = leaks([(r.doc_id, r.text) for r in stages[3]], items, 10)
    kept = {r.doc_id: r.text for r in stages[4]}
    before = {r.doc_id: r.text for r in stages[3]}
    assert sorted(kept) == sorted(d for d, (n, hit, _) in want.items() if len(hit) <= n * 0.5)
    for d, text in kept.items():
        assert (text == before[d]) == (not want[d][1])
    assert not any(hit for _, hit, _ in leaks(kept.items(), items, 10).values())


def test_token_stage(stages):
    coder = SentencePiece()
    assert ids(stages[5]) == ids(stages[4]) and all(r.round_trip for r in stages[5])
    text = {r.doc_id: r.text for r in stages[4]}
    for r in stages[5][:20]:
        assert r.ids == coder.encode(text[r.doc_id]) and r.n_tokens == len(r.ids)


def test_run_is_the_stages_in_a_row(spark, stages):
    digest = lambda rows: hashlib.sha256(repr(sorted((r.doc_id, r.n_tokens) for r in rows)).encode()).hexdigest()
    assert digest(corpus_pipeline.run(spark, SF).collect()) == digest(stages[5])


@pytest.mark.parametrize("rows", ["odd", "empty"])
def test_odd_tables_pass_every_stage(spark, rows):
    docs = odd_docs(spark) if rows == "odd" else empty_docs(spark)
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, SF), "test-pipeline")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
    assert rows == "odd" or docs.count() == 0
