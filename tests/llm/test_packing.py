import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import ROWS, empty_docs, odd_docs, random_texts, table
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing as pk

TEXTS = random_texts(60) + [
    "A's don't 'S x!'s ..'s it's!'re a<|endoftext|>b  two   three    four \n five\n six\n  seven \t eight  ", " lead", "  lead", "\n\n x", "end \n",
    "日本語テスト 한국어 😀 😀 ñÑ É!É 9.9.9 a_b 12ab34 x y 　z a  b", "mark \x1f mark", "", " ", "   ", "we'll (don't) \"quote\" 'tis a'b' ' s 's", "́ ́a á",
    "tab\there \r\n crlf", "x  y  z", "ǅ ǅa Ⅷ Ⅷ9 ²", "a b c , . , d1 2e",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def encoder():
    return pk.ByteEncoder()


def test_ids_are_those_of_the_library(library, encoder):
    for text in [*TEXTS, "a" * 5000, "<|endoftext|>", "x<|endoftext|><|endoftext|> y <|ENDOFTEXT|>", "\x00\ufffd\U0010ffff"]:
        assert encoder(text).tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert encoder(None).tolist() == []


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=" \n\t\r\x0b\x1c\x85\u3000\u2003\u200b'sa1, é!x\u0301Ⅷ日", max_size=14))
def test_any_white_space(library, encoder, text):
    assert encoder(text).tolist() == library.encode(text, add_special_tokens=False).ids


def spread(sizes, window, m):
    sums = np.bincount(window, sizes, minlength=m)
    return sums.max() - sums.min()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=8), st.integers(1, 3))
def test_differencing_is_a_partition_and_near_the_best(sizes, m):
    found = pk.differencing(sizes, m)
    assert len(found) == len(sizes) and found.min() >= 0 and found.max() < m
    best = min(max(np.bincount(w, sizes, minlength=m)) for w in itertools.product(range(m), repeat=len(sizes)))
    assert max(np.bincount(found, sizes, minlength=m)) <= 4 / 3 * best + 1e-9


def test_differencing_equals_the_known_example():
    # 8, 7, 6, 5, 4 in two parts: differences 1, 1, 4 -> 0, 4 -> ... the method ends with 2, greedy dealing with 4
    assert spread([8, 7, 6, 5, 4], pk.differencing([8, 7, 6, 5, 4], 2), 2) == 2
    assert spread([4, 5, 6, 7, 8, 9], pk.differencing([4, 5, 6, 7, 8, 9], 3), 3) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 99), min_size=1, max_size=60))
def test_deal_keeps_every_id_and_the_capacity(sizes):
    pieces, window = pk.deal(sizes, 100)
    assert np.bincount(window, [p[2] for p in pieces]).max() <= 100
    for i, size in enumerate(sizes):
        own = sorted(p[1:] for p in pieces if p[0] == i)
        assert [a for a, _ in own] == list(itertools.accumulate([0] + [n for _, n in own[:-1]])) and sum(n for _, n in own) == size


def test_deal_leaves_little_room():
    rng = np.random.default_rng(1)
    for sizes in (rng.integers(1, 2048, 1500), np.full(1000, 1100), np.full(999, 1025), rng.integers(1000, 2048, 600), np.full(700, 2047)):
        pieces, window = pk.deal(sizes.tolist())
        n = np.bincount(window, [p[2] for p in pieces])
        assert len(n) <= np.ceil(sizes.sum() / 2048) * 1.02 + 1, (sizes[:3], len(n))


def checked(library, rows, texts):
    """Pieces make up every document, sequences have no gaps; the share of padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        ids = np.array(library.encode(texts[doc] or "", add_special_tokens=False).ids + [1], "<u4")
        own.sort(key=lambda r: r.start)
        assert own[0].start == 0 and all(a.start + a.length == b.start for a, b in zip(own, own[1:])) and own[-1].start + own[-1].length == len(ids)
        assert all(r.doc_tokens == len(ids) and r.length > 0 and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    spare = 0
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        n = sum(r.length for r in own)
        assert own[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(own, own[1:])) and n <= 2048
        spare += pk.padded(n, 2048) - n
    return spare / sum(r.length for r in rows)


def test_query_on_whole_documents(spark, library, tmp_path):
    texts = random_texts(900, words=900, vocabulary=3000, seed=5) + [" ".join(f"w{i}" for i in range(9000))] + TEXTS
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    found = pk.op12_packing(spark, str(tmp_path))
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert checked(library, found.collect(), dict(enumerate(texts))) < 0.02


def test_sequences_hold_padded_ids(spark, library):
    rows = pk.sequences(pk.tokenised(table(spark, TEXTS)), pad_id=7, group=20).collect()
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == pk.padded(r.n_tokens, 2048) and (ids[r.n_tokens :] == 7).all()
        for p in r.pieces:
            own = library.encode(TEXTS[p.doc_id], add_special_tokens=False).ids + [1]
            assert ids[p.offset : p.offset + p.length].tolist() == own[p.start : p.start + p.length]
    assert len({r.sequence_id >> 20 for r in rows}) >= 4


def test_odd_rows(spark, library, tmp_path):
    rows = pk.digests(pk.sequences(pk.tokenised(odd_docs(spark, clashes=True)))).collect()
    want = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in ROWS)
    assert sum(r.length for r in rows) == want
    alone = [r for r in ROWS if r[0] is not None and r[0] != 1]
    checked(library, pk.digests(pk.sequences(pk.tokenised(spark.createDataFrame(alone, odd_docs(spark).schema)))).collect(), {r[0]: r[1] for r in alone})
    assert pk.sequences(pk.tokenised(empty_docs(spark))).count() == 0
