import random
import time

import pytest
from cases import empty_docs, odd_docs

from tidemark.llm.license_scan import TEMPLATES, Scanner, scan_licenses


def texts():
    filler = "Anblewh sttible athawh thonre was is anly hend and oftionnten.\n"
    out = {name: filler * 3 + text + "\n" + filler * 3 for name, text in TEMPLATES.items()}
    out["none"] = filler * 9
    out["talk"] = "The driver's licence was revoked.\nCopyright is a wide field, and a license is often asked for."
    out["wrapped"] = filler + "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including"
    out["changed"] = "This work is licensed under the GNU General Public License, version 9."
    out["other"] = "Licensed under the Apricot Licence, Edition 5.0."
    out["two"] = "Released under the MIT License.\n" + filler + "All rights reserved."
    out["inline"] = "word " * 300 + "Licensed under CC BY-NC 4.0. " + "word " * 300
    return out


def test_every_template_is_found_and_nothing_else():
    scan = Scanner()
    found = {name: scan.scan(text)[1] for name, text in texts().items()}
    for name in TEMPLATES:
        assert found[name] == [name.split("/")[0]], name
    assert found["none"] == found["talk"] == found["other"] == []
    assert found["wrapped"] == ["mit"] and found["two"] == ["all-rights-reserved", "mit"] and found["inline"] == ["cc-by-nc-4.0"]


def test_differences_count_words():
    scan = Scanner()
    text = TEMPLATES["gpl-3.0"]
    assert scan.differences("gpl-3.0", text) == 0
    assert scan.differences("gpl-3.0", text.replace("version 3", "version 9")) == 1
    assert scan.differences("gpl-3.0", text.replace("the GNU", "the old GNU")) == 1
    assert scan.differences("gpl-3.0", "nothing alike") == len(scan.words["gpl-3.0"])
    block = "released under the mit license"
    assert max(scan.words, key=lambda n: scan.saving(n, block)) == "mit"


def test_odd_rows(spark):
    docs = odd_docs(spark, clashes=True).withColumnRenamed("n_chars", "licenses")
    out, blocks, licenses, differences = scan_licenses(docs)
    rows = out.collect()
    assert licenses == "_licenses" and len(rows) == docs.count() and all(r[licenses] == [] and r[differences] == -1 for r in rows)
    assert scan_licenses(empty_docs(spark))[0].count() == 0
    given = texts()
    df = spark.createDataFrame(list(given.items()), "doc_id string, text string")
    scan = Scanner()
    assert {r.doc_id: (r.n_blocks, r.licenses, r.n_differences) for r in scan_licenses(df)[0].collect()} == {k: scan.scan(t) for k, t in given.items()}


def test_usual_wordings_are_found():
    """Paraphrases within the allowance, other usual wordings, and licenses beside the most common ones."""
    scan = Scanner()
    given = {
        "It is licensed under the MIT License": "mit", "Distributed under the terms of the MIT license.": "mit",
        "Apache License 2.0": "apache-2.0", "Available under the Apache Software License, version 2.0": "apache-2.0",
        "CC-BY-NC 4.0 license": "cc-by-nc-4.0", "Creative Commons Attribution-ShareAlike 4.0 International": "cc-by-sa-4.0",
        "SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3.0", "Released under the GPLv3.": "gpl-3.0",
        "This file is under the GNU Lesser General Public License, version 2.1": "lgpl-2.1", "Licensed under AGPL v3": "agpl-3.0",
        "available under the Eclipse Public License v2.0": "epl-2.0", "published under the Unlicense": "unlicense",
        "Use is governed by the Mozilla Public License, v. 2.0.": "mpl-2.0", "The 3-clause BSD License applies": "bsd",
    }
    assert {t: scan.scan(f"Some words before. {t}\nand some after it")[1] for t in given} == {t: [n] for t, n in given.items()}


def test_other_names_and_versions_are_not_confirmed():
    scan = Scanner()
    header = TEMPLATES["gpl-3.0/header"]
    assert scan.scan(header.replace("version 3", "version 2"))[1] == ["gpl-2.0"]
    assert scan.scan(header.replace("GNU General", "GNU Lesser General"))[1] == ["lgpl-3.0"]
    misses = [
        "This work is licensed under the GNU General Public License, version 9.", "Licensed under the Apache License, Version 1.1.",
        "Licensed under CC BY-NC 3.0.", "Released under the NIT License.", "Released under the MIT Museum rules, no license.",
        "Subject to the terms of the Mozilla Public License, v. 1.1.", "Some rights reserved.", "Apache License 2.0.1",
    ]
    assert {m: scan.scan(m)[1] for m in misses} == {m: [] for m in misses}


def test_two_licenses_in_one_line():
    text = "Released under the MIT License. All rights reserved. " + "word " * 300 + "Licensed under CC BY-NC 4.0."
    assert Scanner().scan(text)[1] == ["all-rights-reserved", "cc-by-nc-4.0", "mit"]


def wrapped(words, at, mark):
    return f"Some words of the file.\n{mark}" + " ".join(words[:at]) + f"\n{mark}" + " ".join(words[at:]) + "\nfollowing text"


def test_notices_wrapped_at_any_word():
    scan = Scanner()
    for name, text in TEMPLATES.items():
        words = text.split(" ")
        for at in sorted({1, len(words) // 2, len(words) - 1}):
            for mark in ("", " * "):
                assert scan.scan(wrapped(words, at, mark))[1] == [name.split("/")[0]], (name, at, mark)


def test_wrapped_notices_reach_the_scan(spark):
    given = ["/* All rights\n * reserved. */", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0."]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    out, blocks, licenses, differences = scan_licenses(df)
    assert [(r[blocks], r[licenses], r[differences]) for r in out.orderBy("doc_id").collect()] == [(1, ["all-rights-reserved"], 0), (1, ["mpl-2.0"], 0)]


def plain_distance(want, have):
    """Fewest words to change, add or take out, by the whole table."""
    d = [[i + j if not i * j else 0 for j in range(len(have) + 1)] for i in range(len(want) + 1)]
    for i in range(1, len(want) + 1):
        for j in range(1, len(have) + 1):
            d[i][j] = min(d[i - 1][j - 1] + (want[i - 1] != have[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    return d[-1][-1]


@pytest.mark.parametrize("seed", range(6))
def test_alignment_is_the_closest_of_all_parts(seed):
    r = random.Random(seed)
    scan = Scanner({"t": " ".join(r.choice("abcd") for _ in range(r.randrange(2, 7)))})
    for _ in range(30):
        have = [r.choice("abcde") for _ in range(r.randrange(1, 10))]
        at = r.randrange(len(have))
        cost, first, last = scan.aligned("t", have, at)
        parts = {(i, j): plain_distance(scan.words["t"], have[i:j]) for i in range(at + 1) for j in range(at + 1, len(have) + 1)}
        assert cost == min(parts.values()) == parts[first, last]


def test_savings_decide_what_is_found(monkeypatch):
    """Without the bytes that templates save nothing is a candidate; another order of savings gives other winners."""
    given = {n: t for n, t in texts().items() if n in TEMPLATES}
    right = {n: Scanner().scan(t) for n, t in given.items()}
    plain = Scanner.saving
    monkeypatch.setattr(Scanner, "saving", lambda self, name, block: (0, 0.0))
    assert all(Scanner().scan(t)[1] == [] for t in given.values())
    monkeypatch.setattr(Scanner, "saving", lambda self, name, block: (1000 - plain(self, name, block)[0], plain(self, name, block)[1]))
    turned = {n: Scanner().scan(t) for n, t in given.items()}
    assert sum(turned[n] != right[n] for n in right) > 3


def test_another_dictionary_changes_the_ranking():
    words = "this file is licensed under the mit license and may be used".split()
    ours, at = Scanner(), words.index("license")
    other = Scanner(TEMPLATES | {"mit": "Nothing that occurs here, no license.", "house/rules": "This file is licensed under the MIT License and may be used"})
    assert "mit" in ours.candidates(words, at) and "mit" not in other.candidates(words, at) and other.candidates(words, at)[0] == "house/rules"
    assert ours.scan(" ".join(words))[1] == ["mit"] and other.scan(" ".join(words))[1] == ["house"]


def test_long_texts_full_of_cues_end(spark):
    text = " ".join(f"license{i} is a word about copyright number {i % 7}" for i in range(800)) + " Released under the MIT License."
    start = time.time()
    blocks, names, _ = Scanner().scan(text)
    assert names == ["mit"] and blocks == 2 * 800 + 1 and time.time() - start < 20
