import re
from itertools import permutations

import pytest
from cases import CLASHES, ROWS, empty_docs, odd_docs

from tidemark.llm import filter_audit as fa

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"
LONG_GOOD = " ".join(f"n{i}" for i in range(220))
MORE = [
    (20, LONG_GOOD, "en", "s", 1), (21, LONG_GOOD, "fr", "s", 1), (19, LONG_GOOD, "en", "s", 1), (22, LONG_GOOD + " $", "", "s", 1),
    (23, "word " * 300, "en", "s", 1), (24, " ".join("ABCDEF%d" % i for i in range(300)), None, "s", 1), (20, LONG_GOOD, "de", "s", 1),
    (None, LONG_GOOD, "en", "s", 1),
]
MARKS = [(20, 1, 0), (20, 0, 1), (21, None, 1), (23, 1, None), (1, 1, 1), (None, 1, 1), (22, 5, -1), (24, 1, 0), (999, 1, 1)]


def plain(rows, marks):
    """All 120 orders, one document after the other."""
    docs = []
    for doc_id, text, lang, *_ in rows:
        t = text or ""
        words = SPLIT.findall(t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": doc_id is not None and any(o is not None and o < doc_id and (u or "") == t for o, u, *_ in rows),
        }
        mine = [m for m in marks if doc_id is not None and m[0] == doc_id]
        docs.append((lang or "", {f for f in fails if fails[f]}, any(m[1] == 1 for m in mine), any(m[2] == 1 for m in mine)))
    out = []
    for part in {d[0] for d in docs}:
        own, steps, total = [d for d in docs if d[0] == part], [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left, gone = own, []
            for i, f in enumerate(order):
                hit = [d for d in left if f in d[1]]
                late = [d for d in gone if f in d[1]]
                left = [d for d in left if f not in d[1]]
                gone = gone + hit
                total[f] += len(hit)
                alone = sum(d[1] == {f} for d in own)
                steps.append((f, ("".join(order), i + 1, len(left), len(hit), len(late), alone, sum(d[2] for d in hit), sum(d[3] for d in hit))))
        out += [(part, *s, total[f]) for f, s in steps]
    return sorted(out)


@pytest.mark.parametrize("hot", [1, 1024])
def test_all_orders_equal_brute_force(spark, tmp_path, hot, monkeypatch):
    monkeypatch.setattr(fa, "HOT", hot)
    rows = ROWS + MORE
    spark.createDataFrame(rows, odd_docs(spark).schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(MARKS, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    found = fa.op11_filter_audit(spark, str(tmp_path))
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in found.collect()) == plain(rows, MARKS)


def test_clashing_columns_and_empty_tables(spark):
    marks = spark.createDataFrame(MARKS, LABELS)
    found = fa.audit(*fa.text_relations(odd_docs(spark, clashes=True), marks))
    assert sorted(tuple(r) for r in found.collect()) == plain(ROWS, MARKS) and "part" in CLASHES
    assert fa.audit(*fa.text_relations(empty_docs(spark), marks)).count() == 0


def test_relations_of_two_filters(spark):
    ids = spark.createDataFrame([(i, "", i == 3, False) for i in range(5)], "rid long, part string, good boolean, toxic boolean")
    fails = {"X": spark.createDataFrame([(1,), (3,)], "rid long"), "Y": spark.createDataFrame([(3,), (4,)], "rid long")}
    rows = {(r.filter_order, r.step): tuple(r)[3:] for r in fa.audit(ids, fails).collect()}
    assert rows == {("XY", 1): (3, 2, 0, 1, 1, 0, 3), ("XY", 2): (2, 1, 1, 1, 0, 0, 3), ("YX", 1): (3, 2, 0, 1, 1, 0, 3), ("YX", 2): (2, 1, 1, 1, 0, 0, 3)}
    with pytest.raises(ValueError):
        fa.audit(ids, {})
