import re

import numpy as np
import pyarrow as pa
import pytest
from cases import ROWS, empty_docs, odd_docs, random_texts, table
from pyspark.sql import functions as F

from tidemark.llm import near_dedup
from tidemark.llm.components import connected, local_components
from tidemark.llm.near_dedup import keep_one, linked_groups, near_groups, prefix_links, shingle_sets


def sets(texts, k):
    out = []
    for t in texts:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def expected(ids, texts, k, num, den):
    s = sets(texts, k)
    root = list(range(len(s)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            if s[a] and s[b] and den * len(s[a] & s[b]) >= num * len(s[a] | s[b]):
                root[find(a)] = find(b)
    groups = {}
    for i in range(len(s)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for i in range(len(s)):
        known = [ids[j] for j in groups[find(i)] if ids[j] is not None]
        out.append((ids[i], len(s[i]), min(known) if known else None))
    return sorted(map(repr, out))


def found(df):
    return sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("block", [2000, 7])
def test_components_equal_brute_force(spark, seed, block):
    """With blocks of seven classes the units are split, tied by hubs and finished tile by tile."""
    texts = random_texts(220, words=60, vocabulary=300, seed=seed) + ["", "one", "one two"]
    out = near_groups(table(spark, texts), words=3, num=70, den=100, block_classes=block)
    assert found(out) == expected(range(len(texts)), texts, 3, 70, 100)


def test_one_large_group(spark):
    base = [f"w{i}" for i in range(120)]
    rng = np.random.default_rng(1)
    texts = []
    for _ in range(300):
        t = list(base)
        for p in rng.integers(0, 120, rng.integers(0, 9)):
            t[p] = f"z{rng.integers(1 << 30)}"
        texts.append(" ".join(t))
    out = near_groups(table(spark, texts), words=3, num=85, den=100, block_classes=40)
    assert found(out) == expected(range(len(texts)), texts, 3, 85, 100)


def test_odd_rows(spark):
    docs = odd_docs(spark, clashes=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = expected([i for i, _ in rows], [t for _, t in rows], 5, 80, 100)
    assert found(near_groups(docs)) == want
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.toPandas().doc_id.dropna()) == [1, 3, 4, 5, 6, 7, 9]
    assert kept.filter("doc_id is null").count() == 2  # a text of its own, and one without words
    assert near_groups(empty_docs(spark)).count() == 0 and keep_one(empty_docs(spark)).count() == 0


def test_search_from_set_to_set(spark):
    texts = random_texts(150, words=40, vocabulary=30, seed=9)
    label = linked_groups(*shingle_sets(pa.array(texts), 3), 60, 100)
    want = expected(range(150), texts, 3, 60, 100)
    assert sorted(repr((i, len(s), int(g))) for i, (g, s) in enumerate(zip(label, sets(texts, 3)))) == want


def test_depth_follows_the_region(monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION", 2)
    keys = np.array([[0, 1, 1, 1, 1, 1], [0, 1, 1, 1, 1, 2], [0, 1, 1, 1, 2, 2], [0, 2, 2, 9, 9, 9], [0, 2, 2, 8, 9, 9], [1, 2, 2, 8, 9, 9]])
    assert prefix_links(keys, 2, 4).tolist() == [True, False, False, True, False]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1100)] + [(2000, 2001), (2001, 2000), (3000, 3000)]
    out = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(61)) and all(out[i] == 1000 for i in range(1000, 1100)) and out[2001] == 2000
    a, b = local_components(np.array([5, 3, 9]), np.array([3, 1, 9]))
    assert dict(zip(a.tolist(), b.tolist())) == {3: 1, 5: 1}


@pytest.mark.parametrize("threshold", [0.85, 0.80])
def test_recall_at_the_threshold_of_both_depths(threshold):
    """Pairs whose signatures agree as often as pairs at the threshold share a prefix in some order, in sparse and in dense regions."""
    rng, pairs = np.random.default_rng(5), 20_000
    agree = rng.random((pairs, near_dedup.SIGNATURE)) < threshold
    least, most = near_dedup.depths(threshold)
    for depth, orders in ((least, near_dedup._POSITIONS[: near_dedup.ORDERS]), (most, near_dedup._POSITIONS)):
        met = np.zeros(pairs, bool)
        for positions in orders:
            met |= agree[:, positions[:depth]].all(1)
        assert (~met).sum() <= 3, depth


def test_further_orders_are_cut_deep():
    keys = np.array([[near_dedup.ORDERS, 1, 1, 1, 1], [near_dedup.ORDERS, 1, 1, 1, 2], [near_dedup.ORDERS, 1, 1, 1, 2]])
    assert prefix_links(keys, 2, 4).tolist() == [False, True]
