import itertools
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from cases import ROWS, empty_docs, odd_docs, random_texts, table

from tidemark.llm.sentencepiece_fst import MODEL, UNKNOWN_PENALTY, Model, SentencePiece, encode_column, id_digests


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def ours():
    return SentencePiece()


def strings(n=3000):
    r = random.Random(3)
    letters = list("aabtheinor.,'!▁  \n\tÉé́日本😀 ſ<s>0xA1")
    return ["".join(r.choice(letters) for _ in range(r.randrange(0, 40))) for _ in range(n)] + ["", " ", "  ", "a  b", " a", "a ", " " * 99 + "x", "<s>a</s><0x0A>"]


def test_ids_and_text_equal_the_library(library, ours):
    texts = strings() + random_texts(50)
    ids, ends = ours.encode_batch(pa.array(texts, pa.string()))
    back = ours.decode_batch(ids, ends)
    for i, text in enumerate(texts):
        want = library.encode(text)
        assert ids[ends[i] : ends[i + 1]].tolist() == want
        assert back[i] == library.decode(want)
    assert [ours.encode(t) for t in texts[:300]] == [library.encode(t) for t in texts[:300]]


def test_every_neighbour_rule_agrees_with_merging_by_definition(ours):
    for text in strings(300):
        text = ours.normalise(text)
        assert ours.pieces.bpe_path(text) == ours.pieces.merged(text)


def message(field, value):
    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return number(field << 3) + number(value)
    if isinstance(value, float):
        return number(field << 3 | 5) + struct.pack("<f", value)
    return number(field << 3 | 2) + number(len(value)) + value


def test_unigram_path_is_the_least_of_all_paths(tmp_path):
    pieces = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("▁a", -1.5, 1), ("a", -2.5, 1), ("b", -2.0, 1), ("ab", -3.0, 1), ("ba", -3.7, 1), ("bab", -5.0, 1)]
    raw = b"".join(message(1, message(1, p.encode()) + message(2, s) + message(3, k)) for p, s, k in pieces)
    raw += message(2, message(3, 1)) + message(3, message(4, 0))
    path = tmp_path / "unigram.model"
    path.write_bytes(raw)
    ours = SentencePiece(str(path))
    score = {p: s for p, s, k in pieces if k == 1}
    worst = min(score.values()) - UNKNOWN_PENALTY
    for text in map("".join, itertools.product("abc", repeat=5)):
        marked = "▁" + text
        costs = []
        for cuts in itertools.product([0, 1], repeat=len(marked) - 1):
            parts, last = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(marked[last:i])
                    last = i
            parts.append(marked[last:])
            if all(p in score or len(p) == 1 for p in parts):
                costs.append(sum(-score.get(p, worst) for p in parts))
        assert np.isclose(sum(-score.get(p, worst) for p in ours.pieces.unigram_path(marked)), min(costs))


def test_a_normalisation_table_is_refused():
    with pytest.raises(ValueError):
        Model(message(3, message(2, b"table")))


def test_rows_in_spark(spark, library):
    out = id_digests(odd_docs(spark, clashes=True)).collect()
    assert len(out) == len(ROWS) and all(r.round_trip for r in out)
    assert sorted(r.n_tokens for r in out) == sorted(len(library.encode(t or "")) for _, t, *_ in ROWS)
    found, ids, decoded = encode_column(odd_docs(spark, clashes=True))
    assert (ids, decoded) == ("_ids", "decoded")
    assert {(r.doc_id, tuple(r[ids])) for r in found.collect()} == {(i, tuple(library.encode(t or ""))) for i, t, *_ in ROWS}
    assert id_digests(empty_docs(spark)).count() == 0


def test_small_cache_gives_the_same(spark, monkeypatch, library):
    from tidemark.llm import sentencepiece_fst

    monkeypatch.setattr(sentencepiece_fst, "CACHE_CHUNKS", 3)
    coder = SentencePiece()
    for text in random_texts(20):
        ids, _ = coder.encode_batch(pa.array([text]))
        assert ids.tolist() == library.encode(text)
