"""License scans by conditional compression.

Words around cues (licence, copyright, redistribute ...) are candidate blocks:
for every template the run of as many words as it has that puts the text's cue
where the template has its own. Wordings may be wrapped over lines, with comment
marks before each, as only words count. A block is compressed alone and with the
template as zstandard raw dictionary. Templates that spare at least ``SPARED``
of what they themselves take are candidates, and the bytes that they save rank
them. The first of that order is taken which the wording confirms: the run of
words around the cue with the fewest words to change, add or take out differs in
few words and holds the license's identifying words (name and version).

Blocks have a bounded number of words and those that occur again are looked up,
so the work grows with the cues of a text.

Defined cases: null and empty texts have no blocks; several blocks with the same
license name it once; equal savings go to the longer template, then to the name
that sorts first; rows that repeat an id are scanned each by itself; further
columns pass through whatever their names.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, fresh, small_batches

_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_SPDX = (
    "AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0",
    "CC-BY-ND-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
_CC = {"": "", "-nc": "-NonCommercial", "-nc-nd": "-NonCommercial-NoDerivatives", "-nc-sa": "-NonCommercial-ShareAlike", "-nd": "-NoDerivatives", "-sa": "-ShareAlike"}
#: Notices of common licenses, by SPDX-like name. Wordings of one license share the name before the slash.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "agpl-3.0/header": _GNU.format("Affero General Public License", "3"),
    "agpl-3.0/name": "GNU AGPL v3 license",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0/header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "apache-2.0/name": "Apache License 2.0",
    "bsd/redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd/name": "Released under the BSD License.",
    "bsd/clause-2": "2-Clause BSD License",
    "bsd/clause-3": "3-Clause BSD License",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "cc0-1.0": "This work is released under the Creative Commons CC0 1.0 Universal Public Domain Dedication.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "epl-2.0/name": "Eclipse Public License, version 2.0",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-2.0/header": _GNU.format("General Public License", "2"),
    "gpl-2.0/name": "GNU GPL v2 license",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0/header": _GNU.format("General Public License", "3"),
    "gpl-3.0/name": "GNU GPL v3 license",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc/name": "Released under the ISC License.",
    "lgpl-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-2.1/header": _GNU.format("Lesser General Public License", "2.1"),
    "lgpl-2.1/name": "GNU LGPL v2.1 license",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "lgpl-3.0/header": _GNU.format("Lesser General Public License", "3"),
    "lgpl-3.0/name": "GNU LGPL v3 license",
    "mit": "Released under the MIT License.",
    "mit/permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2.0/name": "Mozilla Public License 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "unlicense/name": "Released under the Unlicense.",
    "zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "zlib/name": "Released under the zlib License.",
}
for _short, _version in (("AGPL", "3"), ("GPL", "2"), ("GPL", "3"), ("LGPL", "2.1"), ("LGPL", "3")):
    _name = f"{_short.lower()}-{_version if '.' in _version else _version + '.0'}"
    TEMPLATES[f"{_name}/short"] = f"Released under the {_short}v{_version}."
    TEMPLATES[f"{_name}/spaced"] = f"Licensed under {_short} v{_version}."
for _short, _long in _CC.items():
    TEMPLATES[f"cc-by{_short}-4.0"] = f"Licensed under CC BY{_short.upper()} 4.0."
    TEMPLATES[f"cc-by{_short}-4.0/name"] = f"CC-BY{_short.upper()} 4.0 license"
    TEMPLATES[f"cc-by{_short}-4.0/title"] = f"Creative Commons Attribution{_long} 4.0 International"
    TEMPLATES[f"cc-by{_short}-4.0/deed"] = f"This work is licensed under a Creative Commons Attribution{_long} 4.0 International License."
for _name in _SPDX:
    TEMPLATES[("bsd" if _name.startswith("BSD") else _name.lower()) + f"/spdx-{_name}"] = f"SPDX-License-Identifier: {_name}"


def _gnu(short: str, full: str, version: str) -> str:
    middle = r"(?:as published by the free software foundation )?(?:either )?(?:version |v )?v?"
    return rf"(?<![\w-]){short}[ -]?(?:version |v )?v?{version}(?:\.0)?(?:-only|-or-later)?(?![\w.-])|{full}general public licen[cs]e {middle}{version}(?:\.0)?(?![\w.-])"


_PLAIN = r"(?<!affero )(?<!lesser )(?<!library )"
_NAMED = r"(?<![\w-]){0} (?:software )?licen[cs]e\b|identifier {0}(?![\w.-])"
#: Words that a part must hold, as an expression over its words in small letters with single spaces.
IDENTITY = {
    "all-rights-reserved": r"\ball rights reserved\b",
    "agpl-3.0": _gnu("agpl", "affero ", "3"),
    "apache-2.0": r"\bapache(?: software)? licen[cs]e (?:version |v )?v?2(?:\.0)?(?![\w.-])|\bapache[ -]2(?:\.0)?(?![\w.-])",
    "bsd": r"(?<![\w-])bsd(?:-style)?(?:[ -][0-4][ -]clause)? licen[cs]e\b|\bbsd-[0-4]-clause\b|\bredistribution and use in source and binary forms\b",
    "bsl-1.0": r"\bboost software licen[cs]e (?:version |v )?v?1\.0(?![\w.-])|\bbsl-1\.0(?![\w.-])",
    "cc0-1.0": r"\bcc0(?:[ -](?:version |v )?1\.0)?(?![\w.-])",
    "epl-2.0": r"\beclipse public licen[cs]e (?:version |v )?v?2(?:\.0)?(?![\w.-])|\bepl[ -]?v?2\.0(?![\w.-])",
    "gpl-2.0": _gnu("gpl", _PLAIN, "2"),
    "gpl-3.0": _gnu("gpl", _PLAIN, "3"),
    "isc": _NAMED.format("isc") + r"|\bpermission to use copy modify and(?: or)? distribute this software for any purpose with or without fee\b",
    "lgpl-2.1": _gnu("lgpl", "lesser ", r"2\.1"),
    "lgpl-3.0": _gnu("lgpl", "lesser ", "3"),
    "mit": _NAMED.format("mit") + r"|\bto any person obtaining a copy of this software\b",
    "mpl-2.0": r"\bmozilla public licen[cs]e (?:version |v )?v?2(?:\.0)?(?![\w.-])|\bmpl[ -]?v?2\.0(?![\w.-])",
    "unlicense": r"(?<![\w-])unlicense\b|\bunencumbered software released into the public domain\b",
    "zlib": _NAMED.format("zlib") + r"|\bgranted to anyone to use this software for any purpose\b",
}
for _short, _long in _CC.items():
    _by, _deed = _short.replace("-", "[ -]"), _long.lower().replace("-", "[ -]").replace("noncommercial", "non-?commercial")
    IDENTITY[f"cc-by{_short}-4.0"] = rf"\bcc[ -]by{_by}[ -](?:version |v )?4\.0(?![\w.-])|\bcreative commons attribution{_deed} 4\.0(?![\w.-])"
CUES = r"licen[cs]|rights\W+reserved|permission\W+(to|is)|redistribut|copyright|public\W+domain|\b[al]?gpl|\bcc[ -]?(by|0)|creative\W+commons"
#: Words of a template that may differ: this share of them, or this many if that is more.
MOST_DIFFERENT, ALWAYS_DIFFERENT = 0.1, 2
LEVEL = 9
#: Share of its own compressed bytes that a candidate saves a block, and blocks of templates that a worker remembers.
SPARED, KEPT_BLOCKS = 0.15, 200_000

_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def cue_words(text: str) -> tuple[list[str], list[int]]:
    """The words of a text, and which of them a cue begins in."""
    cues = [m.start() for m in re.finditer(CUES, text, re.I)]
    if not cues:
        return [], []
    spans = [m.span() for m in _WORD.finditer(text)]
    return [text[a:b].lower() for a, b in spans], sorted({max(0, bisect.bisect_right(spans, (c, len(text))) - 1) for c in cues} if spans else ())


class Scanner:
    """Templates with their words; picklable, compressors are made where they are used."""

    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.templates = sorted(templates.items(), key=lambda x: (-len(words_of(x[1])), x[0]))
        self.words = {name: words_of(text) for name, text in self.templates}
        self.cues = {name: cue_words(" ".join(w))[1] or [0] for name, w in self.words.items()}
        self._ready, self._known = None, {}

    def __getstate__(self):
        return self.__dict__ | {"_ready": None, "_known": {}}

    def _compressors(self):
        """A compressor without dictionary, and for every template the one with it and the bytes that the template itself takes."""
        if self._ready is None:
            plain = dict(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            alone, given = zstandard.ZstdCompressor(**plain), {}
            for name, _ in self.templates:
                raw = " ".join(self.words[name]).encode()
                content = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                content.precompute_compress(level=LEVEL)
                given[name] = zstandard.ZstdCompressor(dict_data=content, **plain), max(1, len(alone.compress(raw)) - len(alone.compress(b"")))
            self._ready = alone, given
        return self._ready

    def saving(self, name: str, block: str) -> tuple[int, float]:
        """Compressed bytes of the block that a template saves, as a share of what the template itself takes too."""
        if (name, block) not in self._known:
            if len(self._known) >= KEPT_BLOCKS:
                self._known.clear()
            alone, given = self._compressors()
            raw, (compressor, own) = block.encode(), given[name]
            saved = len(alone.compress(raw)) - len(compressor.compress(raw))
            self._known[name, block] = saved, saved / own
        return self._known[name, block]

    def candidates(self, words: list[str], at: int) -> list[str]:
        """Templates that spare a block around the cue word ``at`` enough, those that save the most bytes first."""
        ranked = []
        for order, (name, _) in enumerate(self.templates):
            need, best = len(self.words[name]), (0, 0.0)
            for cue in self.cues[name]:
                best = max(best, self.saving(name, " ".join(words[max(0, at - cue) : max(0, at - cue) + need])))
            if best[0] > 0 and best[1] >= SPARED:
                ranked.append((-best[0], order, name))
        return [name for _, _, name in sorted(ranked)]

    def aligned(self, name: str, have: list[str], at: int | None = None) -> tuple[int, int, int]:
        """(words to change, add or take out, first, last + 1) of the part of ``have`` closest to the template; it holds word ``at``."""
        want = self.words[name]
        last = len(have) if at is None else at  # a part begins there at the latest
        cost, start = [max(0, j - last) for j in range(len(have) + 1)], [min(j, last) for j in range(len(have) + 1)]
        for i, w in enumerate(want, 1):
            above, begun = cost, start
            cost, start = [i], [0]
            for j, h in enumerate(have, 1):
                c, b = min((above[j - 1] + (h != w), begun[j - 1]), (above[j] + 1, begun[j]), (cost[j - 1] + 1, start[j - 1]))
                cost.append(c)
                start.append(b)
        # of equally close parts the longest, so that no name or version is left out
        ends = [
            (c, b - j, j) for j, (c, b) in enumerate(zip(cost, start))
            if (at is None or j > at) and (j == 0 or c <= cost[j - 1] or j - 1 == at)  # no words added behind the last one
        ]
        c, size, j = min(ends, default=(len(want), 0, 0))
        return c, j + size, j

    def differences(self, name: str, block: str) -> int:
        """Words to change, add or take out between the template and the part of the block closest to it."""
        return self.aligned(name, words_of(block))[0]

    def confirmed(self, name: str, words: list[str], at: int) -> int | None:
        """Differences of the part around the cue word ``at``, if they are few and the part identifies the license."""
        need = len(self.words[name])
        low, allowed = max(0, at - need - ALWAYS_DIFFERENT), max(ALWAYS_DIFFERENT, MOST_DIFFERENT * need)
        near = words[low : at + need + ALWAYS_DIFFERENT]
        if (Counter(self.words[name]) - Counter(near)).total() > allowed:
            return None
        found = self.aligned(name, near, at - low)
        part = " ".join(words[low + found[1] : low + found[2]])
        return found[0] if found[0] <= allowed and self.marks(name).search(part) else None

    def winner(self, words: list[str], at: int) -> tuple[str, int] | None:
        """(license, differences) of the best ranked candidate that the wording around ``at`` confirms."""
        for name in self.candidates(words, at):
            found = self.confirmed(name, words, at)
            if found is not None:
                return name.split("/")[0], found
        return None

    def marks(self, name: str) -> re.Pattern:
        """What identifies a template's license; templates of other licenses identify themselves by all of their words."""
        license = name.split("/")[0]
        return re.compile(IDENTITY.get(license) or rf"\b{re.escape(' '.join(self.words[name]))}\b")

    def scan(self, text: str) -> tuple[int, list[str], int]:
        """Cues with candidate blocks, licenses, and the fewest differences over confirmed blocks (-1 without any)."""
        words, places = cue_words(text)
        found = [w for at in places if (w := self.winner(words, at)) is not None]
        return len(places), sorted({name for name, _ in found}), min((d for _, d in found), default=-1)


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, text: str = "text") -> tuple[DataFrame, str, str, str]:
    """``docs`` with number of candidate blocks, license names and fewest differences; and the names of these columns."""
    small_batches(docs.sparkSession)
    names = [fresh(docs, c) for c in ("n_blocks", "licenses", "n_differences")]
    kinds = [T.LongType(), T.ArrayType(T.StringType()), T.LongType()]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds))])
    at, sent = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(Scanner(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(at).cast(pa.string()), "")
            cue = np.asarray(pc.match_substring_regex(texts, CUES, ignore_case=True)).astype(bool)
            rows = [sent.value.scan(texts[i].as_py()) if c else (0, [], -1) for i, c in enumerate(cue.tolist())]
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.list_(pa.string()), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema), *names


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, blocks, licenses, differences = scan_licenses(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id", F.col(blocks).alias("n_blocks"), F.size(licenses).cast("long").alias("n_licenses"),
        F.array_join(licenses, ",").alias("licenses"), F.col(differences).alias("n_differences"),
    )
