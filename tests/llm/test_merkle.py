import hashlib
import zlib

import numpy as np
import pytest
from cases import ROWS, empty_docs, odd_docs

from tidemark.llm import merkle as mk

NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, lower=False):
    doc_id, text, lang, source, n_chars = row
    if lower and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return H(field(v) for v in (doc_id, source, lang, n_chars, text))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def plain(rows):
    """The whole tree in memory, and every proof folded by hashing all children again."""
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = mine, levels([leaf(r) for r in mine])
    top = levels([trees[v][1][-1][0] for v in langs])
    out = []
    for at, lang in enumerate(langs):
        mine, tree = trees[lang]
        for i, row in enumerate(mine):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            now, proof = leaf(row, tampered), []
            for ls, j in ((tree, i), (top, at)):
                for level in ls[:-1]:
                    run = level[j // 8 * 8 : j // 8 * 8 + 8]
                    proof += run[: j % 8] + run[j % 8 + 1 :]
                    now = H(run[: j % 8] + [now] + run[j % 8 + 1 :])
                    j //= 8
            root = top[-1][0]
            out.append((row[0], leaf(row), tree[-1][0], root, H(proof), now, now == root))
    return sorted(map(repr, out))


def found(df):
    assert df.columns == NAMES
    return sorted(repr(tuple(r)) for r in df.collect())


def many(n, langs=3):
    return [(i * 7 % 1000, f"Text {i} ABC" if i % 4 else "small only", f"l{i % langs}" if i % 11 else None, "s", i) for i in range(n)]


def test_compressions_equal_the_library():
    rng = np.random.default_rng(3)
    for n in (1, 7, 8, 9, 65, 200):
        nodes = rng.integers(0, 256, (n, 32)).astype(np.uint8)
        level = mk.Level(nodes)
        hexes = [x.tobytes().hex() for x in nodes]
        for p in range(len(level.parents)):
            assert level.parents[p].tobytes().hex() == H(hexes[8 * p : 8 * p + 8])
        new = rng.integers(0, 256, (n, 32)).astype(np.uint8)
        for i, folded in enumerate(level.fold(np.arange(n), new)):
            run = hexes[i // 8 * 8 : i // 8 * 8 + 8]
            run[i % 8] = new[i].tobytes().hex()
            assert folded.tobytes().hex() == H(run)


def test_kept_states_resume_without_left_siblings():
    nodes = np.random.default_rng(4).integers(0, 256, (13, 32)).astype(np.uint8)
    level = mk.Level(nodes)
    for i in range(13):
        before, after = level.siblings(i)
        step = {"state": level.states[i // 8, i % 8].astype("<u4").tobytes(), "before": b"\0" * len(before), "after": after}
        assert mk.resume(step, nodes[[i]])[0].tobytes() == level.parents[i // 8].tobytes()


@pytest.mark.parametrize("height", [1, 2, mk.LEVELS])
def test_proofs_equal_brute_force(spark, height):
    rows = many(300) + ROWS
    docs = spark.createDataFrame(rows, odd_docs(spark).schema).repartition(5)
    assert found(mk.verify(mk.leaves(docs), height)) == plain(rows)


def test_odd_rows_as_a_query(spark, tmp_path):
    odd_docs(spark, clashes=True).write.parquet(f"{tmp_path}/documents.parquet")
    assert found(mk.op13_merkle_manifest(spark, str(tmp_path))) == plain(ROWS)


@pytest.mark.parametrize("rows", [many(1), many(9, langs=1)[1:], [(i, "x", f"l{i}", None, None) for i in range(20)], [(5, "Same", "en", "s", 1)] * 10])
def test_lone_leaves_and_many_parts(spark, rows):
    docs = spark.createDataFrame(rows, odd_docs(spark).schema)
    assert found(mk.verify(mk.leaves(docs), 1)) == plain(rows)


def test_empty_table(spark):
    assert mk.verify(mk.leaves(empty_docs(spark))).count() == 0
