import hashlib
import random
import re

import pytest
from cases import empty_docs, odd_docs, table
from pyspark.sql import functions as F

from tidemark.llm import decontaminate
from tidemark.llm.decontaminate import match, remove_passages, without_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, items, window):
    windows = {}
    for i, t in items:
        w = words(t)
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + k]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    hit.update(range(a, a + k))
                    found |= windows[tuple(w[a : a + k])]
        out[d] = (len(w), sorted(hit), sorted(found - {None}))
    return out


def some(seed, n_docs=60, n_items=12):
    r = random.Random(seed)
    pick = lambda n: " ".join(r.choice("abcDE") + r.choice(["", "", ",", "1"]) for _ in range(n))
    return [(i, pick(r.randrange(0, 40))) for i in range(n_docs)], [(f"i{k}", pick(r.choice([0, 1, 2, 5, 6, 9, 15]))) for k in range(n_items)]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("chunk", [200_000, 20])
def test_hits_equal_brute_force(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(decontaminate, "CHUNK_WORDS", chunk)
    docs, items = some(seed)
    items = [x for x in items if len(words(x[1])) != 1] if seed % 2 else items
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    out, count, hit, item = match(left, spark.createDataFrame(items, "item_id string, text string"), window=6)
    assert {r.doc_id: (r[count], r[hit], r[item]) for r in out.collect()} == expected(docs, items, 6)


def test_odd_rows_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "Beta gamma, DELTA epsilon zeta eta theta iota kappa alpha"), (2, None), (None, "alpha"), (3, "日本語"), (3, "")], "item_id long, text string")
    docs = odd_docs(spark, clashes=True)
    out, count, hit, item = match(docs, items)
    assert (count, hit, item) == ("_n_words", "_hit_words", "_item_ids")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = expected(rows, [(str(r.item_id) if r.item_id is not None else None, r.text) for r in items.collect()], 10)
    for r in out.collect():
        if r.doc_id is not None:
            assert (r[count], r[hit], r[item]) == want[r.doc_id]
    assert match(docs, items.limit(0))[0].filter(F.size("_hit_words") > 0).count() == 0
    assert match(empty_docs(spark), items)[0].count() == 0


def test_passages_are_cut_and_clean_texts_stay_as_they_are(spark):
    item = " ".join(f"q{i}" for i in range(12))
    clean = "Not a leak:  two  spaces,\nand a line."
    leak = f"Before it, {' '.join(item.split()[:11]).upper()}. After it and " + "more words " * 20
    docs = spark.createDataFrame([(1, clean, 0), (2, leak, 0), (3, item, 0), (4, None, 0)], "doc_id long, text string, n_words int")
    out = {r.doc_id: r for r in remove_passages(docs, spark.createDataFrame([("x", item)], "item_id string, text string")).collect()}
    assert set(out) == {1, 2, 4} and out[1].text == clean and out[4].text is None and out[1].n_words == 0
    assert out[2].text == "Before it, . After it and " + "more words " * 20
    assert without_words("a b c d", [0, 1, 3]) == " c "


def test_a_large_benchmark_has_a_bounded_plan(spark, monkeypatch):
    """Thirty chunks: the plan holds one pass, the result is that of brute force."""
    monkeypatch.setattr(decontaminate, "CHUNK_WORDS", 20)
    docs, items = some(11, n_docs=40, n_items=160)
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    assert len(list(decontaminate._chunks(benchmark))) >= 30
    out, count, hit, item = match(left, benchmark, window=6)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert {r.doc_id: (r[count], r[hit], r[item]) for r in out.collect()} == expected(docs, items, 6)


def test_query_digest():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
