"""Substring dedup: every window of 35 words that occurs twice is removed.

A window's hash is a Rabin-Karp polynomial over word hashes, taken for all
windows at once from prefix sums modulo 2^64. A window travels to the task of
the smallest 8-word hash inside it (equal windows hold the same one), so
neighbouring windows share a row and equal windows meet. In front of the
exchange a batch settles what repeats inside it and sends one representative.
8-word hashes that are common in a sample come last in that order: they would
gather the surroundings of a frequent passage in one task. The sample decides
nothing but the balance.

Two windows count as equal when the 64-bit hash of the 8 words and 48 bits of
the window's hash agree. Repeated windows merge into maximal intervals.

Defined cases: null and empty texts have no words and lose none; texts shorter
than a window lose none; rows that repeat an id or a text count as different
places, so their windows are repeated; an empty table gives an empty result;
further columns pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_of, documents, fresh, hash_words, mix, small_batches, space_words

WINDOW = 35
#: Words of the inner hash that chooses the task of a window.
GRAM = 8
#: Documents in the sample that finds common inner hashes; share of its documents that makes one common.
SAMPLE, COMMON = 20_000, 1 / 500
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PENALTY = np.uint64(1 << 63)

PARTS = "part long, doc_id long, text_hash long, start int, blob binary, size int"
SPANS = "doc_id long, text_hash long, start int, size int"


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def rolling(words: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Rabin-Karp hashes of all runs of ``size`` words, for each size; at the last places of runs that would not fit: left out."""
    n = len(words)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(_BASE, n), dtype=np.uint64)])
    back = powers(_INVERSE, n + 1)
    return [mix((sums[k:] - sums[: n + 1 - k]) * back[: n + 1 - k]) for k in sizes]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def batch_windows(words: np.ndarray, ends: np.ndarray, window: int, gram: int, common: np.ndarray):
    """For the windows inside single texts: place of the first word, window hash, inner hash that chooses the task."""
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    whole, inner = rolling(words, (window, gram))
    if len(common):
        at = np.minimum(np.searchsorted(common, inner), len(common) - 1)
        inner = np.where(common[at] == inner, inner | _PENALTY, inner >> np.uint64(1))
    else:
        inner = inner >> np.uint64(1)
    key = sliding_min(inner, window - gram + 1)
    last = np.repeat(ends[1:], np.diff(ends))[: len(whole)]
    place = np.flatnonzero(np.arange(len(whole)) + window <= last)
    return place, whole[place], key[place]


def runs(cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and sizes of the runs that begin where ``cut`` is set."""
    first = np.flatnonzero(cut)
    return first, np.diff(np.append(first, len(cut)))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    distinct, codes, ends = space_words(texts)
    return (mix(hash_words(distinct))[codes] if len(codes) else np.zeros(0, np.uint64)), ends


def _pack(hashes: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """48 bits of each hash, as one binary value per run."""
    data = np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
    offsets = np.concatenate([[0], np.cumsum(sizes * 6)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def _unpack(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter((len(b) // 6 for b in (blobs.to_pylist())), np.int64, len(blobs))
    raw = np.frombuffer(b"".join(blobs.to_pylist()), np.uint8).reshape(-1, 6)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :6] = raw
    return full.reshape(-1).view("<u8").astype(np.uint64), sizes


def _rows(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=names)


def _deal(window: int, gram: int, common):
    """Map side: windows of a batch, what repeats inside it settled, one representative of each sent on."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "doc_id", "text_hash", "start", "blob", "size"]
        for batch in batches:
            words, ends = word_hashes(batch.column(2).cast(pa.string()))
            place, whole, key = batch_windows(words, ends, window, gram, common.value)
            if not len(place):
                continue
            doc = doc_of(ends)[place]
            start = place - ends[doc]
            ids, text = batch.column(0), batch.column(1)

            _, first, back, count = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
            twice = count[back] > 1
            send = ~twice
            send[first] = True

            def joined(pick, *same):
                """Runs of picked neighbours in one text that agree in ``same``."""
                at = np.flatnonzero(pick)
                cut = np.ones(len(at), bool)
                cut[1:] = (np.diff(at) != 1) | (np.diff(doc[at]) != 0)
                for s in same:
                    cut[1:] |= s[at][1:] != s[at][:-1]
                begin, size = runs(cut)
                return at, at[begin], size

            at, begin, size = joined(send, key)
            rows = pa.array(doc[begin])
            yield _rows(names, pa.array(key[begin].view(np.int64)), ids.take(rows), text.take(rows), pa.array(start[begin].astype(np.int32)), _pack(whole[at], size), pa.nulls(len(begin), pa.int32()))
            if twice.any():
                _, begin, size = joined(twice)
                rows = pa.array(doc[begin])
                yield _rows(names, pa.array(mix(whole[begin]).view(np.int64)), ids.take(rows), text.take(rows), pa.array(start[begin].astype(np.int32)), pa.nulls(len(begin), pa.binary()), pa.array(size.astype(np.int32)))

    return deal


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side, rows sorted by part: windows that two places share, as runs of first words."""
    names = ["doc_id", "text_hash", "start", "size"]
    rest = None
    for batch in _whole_parts(batches):
        settled = batch.filter(pa.array(np.asarray(batch.column(4).is_valid()) == 0))
        if settled.num_rows:
            yield _rows(names, *(settled.column(i) for i in (1, 2, 3, 5)))
        batch = batch.filter(batch.column(4).is_valid())
        if not batch.num_rows:
            continue
        hashes, sizes = _unpack(batch.column(4))
        part = np.asarray(batch.column(0))
        rank = np.cumsum(np.concatenate([[0], part[1:] != part[:-1]])).astype(np.uint64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        both = np.empty(len(hashes), [("rank", np.uint64), ("hash", np.uint64)])
        both["rank"], both["hash"] = rank[row], hashes
        order = np.lexsort((hashes, rank[row]))
        same = both[order][1:] == both[order][:-1]
        twice = np.zeros(len(hashes), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = np.flatnonzero(twice)
        if not len(at):
            continue
        cut = np.ones(len(at), bool)
        cut[1:] = (np.diff(at) != 1) | (np.diff(row[at]) != 0)
        begin, size = runs(cut)
        begin = at[begin]
        first = np.concatenate([[0], np.cumsum(sizes)])[row[begin]]
        rows = pa.array(row[begin])
        start = np.asarray(batch.column(3))[row[begin]] + (begin - first)
        yield _rows(names, batch.column(1).take(rows), batch.column(2).take(rows), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)))


def _whole_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut so that no part is in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        part = np.asarray(batch.column(0))
        if held and part[0] != held[-1].column(0)[-1].as_py():
            yield pa.concat_batches(held)
            held = []
        last = int(np.searchsorted(part, part[-1], side="left"))
        if last:
            held.append(batch.slice(0, last))
            yield pa.concat_batches(held)
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.concat_batches(held)


def common_hashes(rows: DataFrame, window: int, gram: int, sample: int = SAMPLE, share: float = COMMON) -> np.ndarray:
    """Inner hashes that many documents of a sample have; at most (inner hashes per document) / ``share`` of them."""
    total = rows.count()
    part = rows.sample(min(1.0, sample / max(total, 1)), seed=7) if total > sample else rows

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ends = word_hashes(batch.column(2).cast(pa.string()))
            if len(words) >= gram:
                inner = rolling(words, (gram,))[0]
                doc = doc_of(ends)[: len(inner)]
                pick = sliding_pick(inner, window - gram + 1)
                got = np.unique(np.stack([doc[pick].astype(np.uint64), inner[pick]], 1), axis=0)[:, 1]
                found, count = np.unique(got, return_counts=True)
                yield _rows(["hash", "n"], pa.array(found.view(np.int64)), pa.array(count))

    least = max(8, int(min(total, sample) * share))
    found = part.mapInArrow(keys, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return np.sort(np.asarray(found.select("hash").toArrow().column(0).combine_chunks()).astype(np.int64).view(np.uint64))


def sliding_pick(inner: np.ndarray, width: int) -> np.ndarray:
    """Places whose value is the smallest of some ``width`` neighbours."""
    pick = np.zeros(len(inner), bool)
    if len(inner) >= width:
        low = sliding_min(inner, width)
        pick[: len(low)] |= low == inner[: len(low)]
        pick[width - 1 :] |= low == inner[width - 1 :]
        for shift in range(1, width - 1):
            pick[shift : shift + len(low)] |= low == inner[shift : shift + len(low)]
    return pick


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_hash, start, size): runs of first words of repeated windows; ``text_hash`` is xxhash64 of the text."""
    spark = docs.sparkSession
    small_batches(spark)
    gram = min(gram, window)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").alias("text")).filter("text is not null")
    common = spark.sparkContext.broadcast(common_hashes(rows, window, gram))
    dealt = rows.mapInArrow(_deal(window, gram, common), PARTS)
    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(_settle, SPANS)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with three more columns, by default _n_words, _n_removed and _kept: the words no
    repeated window covers, joined by one space."""
    spans = repeated_spans(docs, window, gram).select(
        F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.struct("start", "size").alias("_s")
    ).groupBy("_d", "_h").agg(F.collect_set("_s").alias("_spans"))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at, key = docs.columns.index("text"), names[docs.columns.index("doc_id")]
    left = docs.toDF(*names)
    left = left.withColumn("_hash", F.xxhash64(names[at]))
    joined = left.join(spans, (left["_hash"] == spans["_h"]) & left[key].cast("long").eqNullSafe(spans["_d"]), "left").drop("_d", "_h", "_hash")
    width = len(names)
    made = {fresh(docs, "_n_words"): F.lit(0).cast("long"), fresh(docs, "_n_removed"): F.lit(0).cast("long"), fresh(docs, "_kept"): F.lit("")}
    schema = docs.withColumns(made).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(width).to_pylist()):
                words = (text or "").encode().split()
                left = np.ones(len(words) + 1, np.int32)
                if spans:
                    left[:] = 0
                    np.add.at(left, [s["start"] for s in spans], 1)
                    np.add.at(left, [s["start"] + s["size"] + window - 1 for s in spans], -1)
                    left = np.cumsum(left) == 0
                    words = [w for w, k in zip(words, left[:-1].tolist()) if k]
                n.append(len(left) - 1)
                gone.append(len(left) - 1 - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=[f.name for f in schema.fields])

    return joined.mapInArrow(cut, schema)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2("_kept", 256).alias("kept_sha256"))


SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(w[i:i + {WINDOW} - 1], ' ')) AS g FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM d WHERE len(w) >= {WINDOW})),
twice AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS p FROM win JOIN twice USING (g)),
word AS (SELECT r, p, w[p] AS x FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS s FROM word ANTI JOIN gone USING (r, p) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
"""
