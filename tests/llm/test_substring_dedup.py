import hashlib

import numpy as np
import pytest
from cases import LONG, empty_docs, odd_docs, random_texts, table

from tidemark.llm import substring_dedup
from tidemark.llm.substring_dedup import WINDOW, remove_repeats, rolling, sliding_min


def brute_force(texts: dict, window: int = WINDOW) -> dict:
    """Id -> (words, removed, sha256 of the kept words)."""
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    seen: dict[tuple, int] = {}
    for w in words.values():
        for a in range(len(w) - window + 1):
            seen[tuple(w[a : a + window])] = seen.get(tuple(w[a : a + window]), 0) + 1
    out = {}
    for i, w in words.items():
        gone = {p for a in range(len(w) - window + 1) if seen[tuple(w[a : a + window])] > 1 for p in range(a, a + window)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def found(df):
    return {r.doc_id: (r._n_words, r._n_removed, hashlib.sha256(r._kept.encode()).hexdigest()) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("common", [2, 10**9])
def test_removed_words_equal_brute_force(spark, monkeypatch, seed, common):
    """With a low limit almost every inner hash counts as common; the result must not change."""
    real = substring_dedup.common_hashes
    monkeypatch.setattr(substring_dedup, "common_hashes", lambda rows, w, g: real(rows, w, g, share=common / 1e9 if common == 2 else 1.0))
    texts = random_texts(120, words=60, vocabulary=5, seed=seed)
    assert found(remove_repeats(table(spark, texts), window=9, gram=3)) == brute_force(dict(enumerate(texts)), 9)


def test_repeats_inside_one_text(spark):
    text = " ".join(f"x{i}" for i in range(40))
    texts = [f"{text} middle {text}", "y " * 50, text.replace("x39", "z")]
    assert found(remove_repeats(table(spark, texts))) == brute_force(dict(enumerate(texts)))


def test_odd_rows(spark):
    docs = odd_docs(spark, clashes=True)
    out = remove_repeats(docs)
    rows = out.collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    n = len(LONG.split())
    assert (by[7]._n_words, by[7]._n_removed, by[7]._kept) == (n, n, "")
    assert (by[8]._n_removed, by[8]._kept) == (n, "tail")
    assert (by[3]._n_words, by[3]._kept, by[1]._n_removed) == (0, "", 0)
    assert remove_repeats(empty_docs(spark)).count() == 0


def test_rolling_hashes_name_their_words():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    words[30:40] = words[5:15]
    whole = rolling(words, (10,))[0]
    assert whole[30] == whole[5] and len(np.unique(whole)) == len(whole) - 1
    assert sliding_min(whole, 7).tolist() == [whole[i : i + 7].min() for i in range(len(whole) - 6)]
