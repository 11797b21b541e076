import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from cases import ROWS, empty_docs, odd_docs, random_texts, table
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm.common import scratch
from tidemark.llm.token_files import TOKENIZER, EliasFano, Encoder, Segment, read_token_files, segment_bytes, write_token_files


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**12) | st.integers(0, 50), max_size=300))
def test_elias_fano_gives_back_every_value(values):
    values = sorted(values)
    raw = EliasFano.of(np.array(values, np.int64)).to_bytes()
    found = EliasFano.from_bytes(raw)
    assert found.values().tolist() == values
    assert [found.select(i) for i in range(len(values))] == values


def test_elias_fano_is_near_its_bound():
    n, top = 100_000, 50_000_000
    values = np.sort(np.random.default_rng(0).integers(0, top, n))
    bits = 8 * len(EliasFano.of(values).to_bytes()) / n
    assert bits < 2 + np.log2(top / n) + 1 + 32 / 64


TEXTS = random_texts(40) + [
    "A's don't 'S x!'s ..'s it's!'re a<|endoftext|>b <|ENDOFTEXT|> |>", "é É İ İ ﬁ ½ ²③ a b 　 ﻿ x",
    "日本語テスト 한국어 😀😀 ñÑ É!É 9.9.9 a_b", "ΑΣ ΣΑΣ. ǅ", "", " \n", "é .́", "<|startoftext|>",
]


def test_pieces_give_the_ids_of_whole_texts(library):
    ids, ends = Encoder()(pa.array(TEXTS + [None], pa.string()))
    for i, text in enumerate(TEXTS):
        assert ids[ends[i] : ends[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids
    tiny = Encoder(cache=5)
    for text in TEXTS:
        assert tiny(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_segment_has_random_access():
    ids = [np.array(x, "<u2") for x in ([5, 6, 2], [2], [7, 2], [65535] * 9)]
    segment = Segment(io.BytesIO(b"".join(segment_bytes([None, -3, -3, 10**12], ids, 2))))
    assert segment.doc_ids() == [None, -3, -3, 10**12]
    assert [segment.ids(i).tolist() for i in range(4)] == [x.tolist() for x in ids]
    assert [x.tolist() for x in segment.all_ids()] == [x.tolist() for x in ids]


@pytest.mark.parametrize("segment_ids", [50, 1 << 20])
def test_files_hold_the_corpus_in_order(spark, library, segment_ids):
    folder = scratch(spark, "test-files")
    manifest = write_token_files(table(spark, TEXTS), folder, segment_ids=segment_ids)
    rows = sorted(tuple(r) for r in read_token_files(manifest, folder, with_ids=True).collect())
    at = 0
    for i, text in enumerate(TEXTS):
        want = library.encode(text, add_special_tokens=False).ids + [2]
        assert rows[i] == (i, at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()), want)
        at += len(want)
    assert (manifest.count() > 5) == (segment_ids == 50)


def test_odd_rows(spark, library):
    folder = scratch(spark, "test-files")
    rows = read_token_files(write_token_files(odd_docs(spark, clashes=True), folder), folder).collect()
    want = sorted(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in ROWS)
    assert sorted(r.n_tokens for r in rows) == want
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows][:3] == [None, None, 1] and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    folder = scratch(spark, "test-files")
    assert read_token_files(write_token_files(empty_docs(spark), folder), folder).count() == 0
