"""Benchmark decontamination with a generalised suffix automaton of the test items.

Both sides are normalised alike: A-Z become lower case, words are runs of
digits, letters a-z and bytes above 0x7F. The automaton holds every substring
of every item. A document's words stream through it; after each word the state
is the longest suffix that occurs in some item, and its length is tracked.
A suffix of ``window`` words or more is a leaked passage; an item shorter than
a window counts when it occurs whole.

Items are taken in chunks of about ``CHUNK_WORDS`` words, an item never being
split; the automaton of a chunk is sent to the tasks and the documents pass it
without a shuffle. A plan holds ``AUTOMATA`` of them at most; a larger benchmark
takes several passes, and what one has found is written before the next.

Defined cases: null texts have no words; items without words never match; an
item without an id makes hits and cuts, but is not among the items found;
repeated items and repeated rows are kept apart by their rows; an empty benchmark leaves all documents clean; further
columns of ``docs`` pass through unchanged whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import doc_of, documents, drop_scratch, freeing, fresh, last_scratch, small_batches, space_words, translate, written

WINDOW = 10
#: Words of the items in one automaton; bounds what is collected and broadcast at once.
CHUNK_WORDS = 200_000
#: Automata in one pass and one plan; with more the documents found so far are written in between.
AUTOMATA = 4
#: Share of hit words above which a document is dropped instead of cut.
MAX_COVERAGE = 0.5

#: Byte to byte: A-Z to a-z, bytes that belong to no word to a space.
FOLD = np.array(
    [b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8
)


class Automaton:
    """Generalised suffix automaton over word numbers."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        for _, words in items:
            self._add([self.words.setdefault(w, len(self.words)) for w in words])
        self.items: list[set[str]] = [set() for _ in self.len]
        for item, words in items:
            prefix = 0
            for w in words:
                prefix = state = self.next[prefix][self.words[w]]
                while state > 0 and item not in self.items[state]:
                    self.items[state].add(item)
                    state = self.link[state]
        self.short: dict[int, list[tuple[int, str]]] = {}
        for item, words in items:
            if 0 < len(words) < window:
                self.short.setdefault(self._at([self.words[w] for w in words]), []).append((len(words), item))
        #: States from which an occurring short item can be reached by suffix links.
        self.near_short = [False] * len(self.len)
        for state in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            self.near_short[state] = state in self.short or self.near_short[self.link[state]]
        #: No run of known words shorter than this can hold a window.
        self.least = min([window if len(w) >= window else len(w) for _, w in items], default=window)

    def _at(self, numbers: list[int]) -> int:
        state = 0
        for c in numbers:
            state = self.next[state][c]
        return state

    def _state(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.len.append(length)
        self.link.append(link)
        self.next.append(arcs)
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of ``q`` for the shorter strings that reach it from ``p``."""
        copy = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _add(self, numbers: list[int]) -> None:
        last = 0
        for c in numbers:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.len[q] == self.len[last] + 1 else self._split(last, c, q)
            else:
                new, p = self._state(self.len[last] + 1, 0, {}), last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][c]
                    self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
                last = new

    def stream(self, numbers: list[int]) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, words, items) of each window that ends at some word; -1 is a word of no item."""
        state = length = 0
        for at, c in enumerate(numbers):
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if c not in self.next[state]:
                length = 0
                continue
            state, length = self.next[state][c], length + 1
            if length >= self.window:
                s = state
                while self.len[self.link[s]] >= self.window:
                    s = self.link[s]
                yield at - self.window + 1, self.window, self.items[s]
            s = state
            while self.near_short[s]:
                for words, item in self.short.get(s, ()):
                    if words <= length:
                        yield at - words + 1, words, {item}
                s = self.link[s]


def known_runs(numbers: np.ndarray, ends: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(text, first word, end) of the runs of at least ``least`` known words inside one text."""
    known = numbers >= 0
    if not known.any():
        return []
    doc = doc_of(ends)
    cut = np.flatnonzero(np.diff(known.astype(np.int8)) | np.diff(doc)) + 1
    first, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(known)]])
    long = known[first] & (end - first >= least)
    return list(zip(doc[first[long]].tolist(), first[long].tolist(), end[long].tolist()))


def find_hits(texts: pa.Array, automaton: Automaton) -> tuple[np.ndarray, list[list[int]], list[list[str]]]:
    """Per text: number of words, hit word positions, ids of items with occurring windows."""
    words, codes, ends = space_words(translate(texts, FOLD))
    n, lookup = len(texts), automaton.words
    hits: list[set[int]] = [set() for _ in range(n)]
    items: list[set[str]] = [set() for _ in range(n)]
    if len(codes):
        table = np.fromiter((lookup.get(w, -1) for w in words.cast(pa.binary()).to_pylist()), np.int64, len(words))
        numbers = table[codes]
        for doc, first, end in known_runs(numbers, ends, automaton.least):
            for at, size, found in automaton.stream(numbers[first:end].tolist()):
                start = first - ends[doc] + at
                hits[doc].update(range(start, start + size))
                items[doc] |= found
    return np.diff(ends), [sorted(map(int, h)) for h in hits], [sorted(i - {None}) for i in items]


def _chunks(benchmark: DataFrame) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items with their words, in groups of a bounded number of words; one group is on the driver at a time."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).filter("t is not null")
    letters = rows.agg(F.sum(F.octet_length("t")).alias("b")).first()["b"] or 0
    parts = max(1, -(-letters // (2 * CHUNK_WORDS)))
    for part in range(parts):
        found = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part).toArrow() if parts > 1 else rows.toArrow()
        texts = found["t"].combine_chunks().cast(pa.string())
        words, codes, ends = space_words(translate(texts, FOLD)) if len(texts) else (pa.array([], pa.string()), np.zeros(0, np.int64), [0])
        words = words.cast(pa.binary()).to_pylist()
        items = [(i, [words[c] for c in codes[a:b]]) for i, a, b in zip(found["i"].to_pylist(), ends[:-1], ends[1:]) if b > a]
        if items:
            yield items


def match(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> tuple[DataFrame, str, str, str]:
    """``docs`` with word count, hit word positions and item ids; and the names of these three columns."""
    spark = docs.sparkSession
    small_batches(spark)
    count, hit, item = (fresh(docs, c) for c in ("n_words", "hit_words", "item_ids"))
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(count, T.LongType()), T.StructField(hit, T.ArrayType(T.LongType())), T.StructField(item, T.ArrayType(T.StringType()))])
    out, ready, more, before = docs, [], False, None
    for items in _chunks(benchmark) if benchmark is not None else ():
        if len(ready) == AUTOMATA:
            # what these automata found is written, so a plan never holds more of them, whatever the benchmark's size
            out = written(_through(out, ready, at, schema, more), "decontaminate")
            for sent in ready:
                sent.destroy()
            if before:
                drop_scratch(spark, before)
            before, ready, more = last_scratch(), [], True
        ready.append(spark.sparkContext.broadcast(Automaton(items, window)))
    if ready or not more:
        out = _through(out, ready or [spark.sparkContext.broadcast(Automaton([], window))], at, schema, more)
    return out, count, hit, item


def _through(docs: DataFrame, automata: list, at: int, schema: T.StructType, more: bool) -> DataFrame:
    """One pass of the documents through a few automata, without a shuffle; ``more``: ``docs`` has what others found."""
    width = len(schema.fields)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            hits = [set(h) for h in columns[width - 2].to_pylist()] if more else None
            items = [set(i) for i in columns[width - 1].to_pylist()] if more else None
            for automaton in automata:
                n, own, found = find_hits(columns[at].cast(pa.string()), automaton.value)
                hits = [a | set(b) for a, b in zip(hits, own)] if hits is not None else [set(h) for h in own]
                items = [a | set(b) for a, b in zip(items, found)] if items is not None else [set(i) for i in found]
            made = [pa.array(n, pa.int64()), pa.array(list(map(sorted, hits)), pa.list_(pa.int64())), pa.array(list(map(sorted, items)), pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*columns[: width - 3], *made], names=[f.name for f in schema.fields])

    return docs.mapInArrow(freeing(scan), schema)


def remove_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """``docs`` without leaked passages: hit words are cut from the text, and a document goes
    whole when more than ``max_coverage`` of its words are hit. A clean text stays byte for byte.
    Columns and rows are otherwise those of ``docs``."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    text = names[docs.columns.index("text")]
    found, count, hit, _ = match(plain, benchmark, window, text)
    found = found.filter(F.size(hit) <= F.col(count) * F.lit(max_coverage))
    at, schema = found.columns.index(text), found.select(*names).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[: len(names)]
            dirty = np.asarray(pc.greater(pc.list_value_length(batch.columns[-1]), 0))
            if dirty.any():
                texts = columns[at].to_pylist()
                for i in np.flatnonzero(dirty):
                    texts[i] = without_words(texts[i], batch.columns[-1][int(i)].as_py())
                columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = found.select(*names, hit).mapInArrow(cut, schema)
    return out.toDF(*docs.columns)


def without_words(text: str, hit: list[int]) -> str:
    """``text`` without the bytes from the first to the last word of each run of hit words."""
    raw = np.frombuffer(text.encode(), np.uint8)
    inside = np.concatenate([[False], FOLD[raw] != 32, [False]])
    edge = np.diff(inside.astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep, h = np.ones(len(raw), bool), np.asarray(hit)
    for run in np.split(h, np.flatnonzero(np.diff(h) > 1) + 1):
        keep[starts[run[0]] : ends[run[-1]]] = False
    return raw[keep].tobytes().decode()


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    found, count, hit, item = match(documents(spark, sf_dir).select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id", F.col(count).alias("n_words"), F.size(hit).cast("long").alias("n_hit"), F.size(item).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(item), ","), 256).alias("items_sha256"), (F.size(hit) > 0).alias("contaminated"),
    )


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT item_id, least(len(w), {WINDOW}) AS k, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
grams AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
found AS (SELECT r, i, grams.k, item_id FROM grams JOIN (SELECT DISTINCT item_id, k, g FROM win) win ON grams.k = win.k AND grams.g = win.g),
n_hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM found) GROUP BY r),
its AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS s FROM found GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(n_hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (r) LEFT JOIN its USING (r)
"""
