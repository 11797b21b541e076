"""Token ids in binary files with Elias-Fano document boundaries.

A segment file holds the ids of consecutive documents, in ascending doc_id
order, as one array of the narrowest width the vocabulary allows. The document
boundaries and the document ids are Elias-Fano sequences: the low bits of every
value packed side by side, the high bits in unary, and the place of every 64th
one as 32-bit numbers, from which ``select`` finds an offset by reading a few
bytes. No table of 64-bit offsets exists.

    bytes 0-7    magic            8-15  documents      16-23  ids
    24-27  bytes of an id         28-31  documents without a doc_id (they come first)
    32-39  smallest doc_id        40-55  bytes of the two sequences
    then: boundaries (documents + 1 values), doc_ids less the smallest, the ids

Documents are range-partitioned by doc_id and sorted; a task writes its
segments to shared storage under a temporary name and renames them, so a task
that is run again replaces its own files. A segment is closed at
``SEGMENT_IDS`` ids, which bounds the memory of writers.

Texts are encoded by the tokenizers library piece by piece: its normaliser drops
white space and its pattern never joins an ASCII letter or digit with ASCII
punctuation (but for the apostrophe), so pieces between such places are encoded
alone, each distinct piece once, and kept in a bounded cache. Texts that spell a
special token are encoded whole.

Defined cases: null texts are empty and have the end id alone; rows without
doc_id come first, rows that repeat one follow each other in the order of their
texts; a text that is longer than a segment has one of its own; an empty table
writes no segment; further columns are not stored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, scratch, small_batches, space_words, written

END_ID = 2
SEGMENT_IDS = 32 << 20
#: Distinct pieces a Python worker keeps encoded; the cache starts anew when it is full.
CACHE_PIECES = 700_000
MAGIC = b"TOKSEG01"
SAMPLE = 64
MANIFEST = "segment string, part int, number int, n_docs long, n_ids long"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# --- Elias-Fano -----------------------------------------------------------------------------


class EliasFano:
    """A sequence of non-decreasing whole numbers from 0 on."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        cells = ((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8)
        ones = (values >> bits) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, bits, np.packbits(cells.reshape(-1), bitorder="little"), np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high)], "<u4").tobytes()
        return head + self.samples.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, bits, lows, highs = np.frombuffer(raw, "<u4", 4).tolist()
        at = 16 + 4 * -(-n // SAMPLE)
        return cls(n, bits, np.frombuffer(raw, np.uint8, lows, at), np.frombuffer(raw, np.uint8, highs, at + lows), np.frombuffer(raw, "<u4", -(-n // SAMPLE), 16))

    def _low(self, i: int) -> int:
        first, last = i * self.low_bits, (i + 1) * self.low_bits
        window = int.from_bytes(self.low[first >> 3 : (last + 7) >> 3].tobytes(), "little")
        return (window >> (first & 7)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Value number ``i``: its one is searched from the nearest sampled one on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        at = place >> 3
        byte = int(self.high[at]) >> (place & 7) << (place & 7)
        while (ones := byte.bit_count()) <= left:
            left -= ones
            at += 1
            byte = int(self.high[at])
        for _ in range(left):
            byte &= byte - 1
        return (8 * at + (byte & -byte).bit_length() - 1 - i) << self.low_bits | self._low(i)

    def values(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        cells = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
        low = cells.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return (ones - np.arange(self.n)) << self.low_bits | low


# --- segment files --------------------------------------------------------------------------


def segment_bytes(doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> Iterator[bytes]:
    """The parts of a segment file; ``doc_ids`` ascend, nulls first."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    bounds = EliasFano.of(np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])).to_bytes()
    docs = EliasFano.of(known - least).to_bytes()
    yield MAGIC + np.array([len(ids), sum(map(len, ids))], "<u8").tobytes() + np.array([width, len(doc_ids) - len(known)], "<u4").tobytes()
    yield np.array([least], "<i8").tobytes() + np.array([len(bounds), len(docs)], "<u8").tobytes() + bounds + docs
    for x in ids:
        yield x.astype(f"<u{width}").tobytes()


class Segment:
    """Random access to a segment file that is open for reading and seeking."""

    def __init__(self, file):
        self.file = file
        head = file.read(56)
        if head[:8] != MAGIC:
            raise ValueError("not a token segment")
        self.n_docs, self.n_ids = np.frombuffer(head, "<u8", 2, 8).tolist()
        self.width, self.nameless = np.frombuffer(head, "<u4", 2, 24).tolist()
        self.least = int(np.frombuffer(head, "<i8", 1, 32)[0])
        bounds, docs = np.frombuffer(head, "<u8", 2, 40).tolist()
        self.bounds, self.docs = EliasFano.from_bytes(file.read(bounds)), EliasFano.from_bytes(file.read(docs))
        self.at = 56 + bounds + docs

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nameless + (self.docs.values() + self.least).tolist()

    def _read(self, first: int, last: int) -> np.ndarray:
        self.file.seek(self.at + first * self.width)
        return np.frombuffer(self.file.read((last - first) * self.width), f"<u{self.width}").astype("<u4")

    def ids(self, i: int) -> np.ndarray:
        """Ids of document number ``i`` of the file, found by two selects."""
        return self._read(self.bounds.select(i), self.bounds.select(i + 1))

    def all_ids(self) -> Iterator[np.ndarray]:
        """Ids of document after document, read in large pieces."""
        bounds = self.bounds.values().tolist()
        first = 0
        while first < self.n_docs:
            last = first + 1
            while last < self.n_docs and bounds[last + 1] - bounds[first] <= 1 << 20:
                last += 1
            piece = self._read(bounds[first], bounds[last])
            for a, b in zip(bounds[first:last], bounds[first + 1 : last + 1]):
                yield piece[a - bounds[first] : b - bounds[first]]
            first = last


# --- encoding -------------------------------------------------------------------------------

_PUNCT = r"[!-&(-/:-@\[-`{-~]"


def ragged_take(values: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of the runs ``at``, and its offsets."""
    size = (offsets[1:] - offsets[:-1])[at]
    out = np.concatenate([[0], np.cumsum(size)])
    return values[np.repeat(offsets[:-1][at] - out[:-1], size) + np.arange(out[-1])], out


class Encoder:
    def __init__(self, path: str = TOKENIZER, cache: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), cache
        with open(path) as f:
            self.specials = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.values, self.ends, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0

    def _remember(self, pieces: list[str]) -> None:
        """Encode new pieces, many in one call with a special token between them."""
        mark, number = next(iter(self.specials.items()))
        sep = f" {mark} "
        groups = [pieces[i : i + 500] for i in range(0, len(pieces), 500)]
        found = self.tokenizer.encode_batch_fast([sep.join(g) for g in groups], add_special_tokens=False)
        for group, encoding in zip(groups, found):
            ids = np.array(encoding.ids, np.uint32)
            marks = np.flatnonzero(ids == number)
            size = np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1
            ids = ids[ids != number]
            n = len(self.known)
            while self.used + len(ids) > len(self.values):
                self.values = np.concatenate([self.values, np.zeros_like(self.values)])
            while n + len(group) + 1 > len(self.ends):
                self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            self.values[self.used : self.used + len(ids)] = ids
            self.ends[n + 1 : n + 1 + len(group)] = self.used + np.cumsum(size)
            self.used += len(ids)
            self.known.update(zip(group, range(n, n + len(group))))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the offsets of the texts in them."""
        texts = pc.fill_null(texts, "")
        whole = np.zeros(len(texts), bool)
        for mark in self.specials:
            whole |= np.asarray(pc.match_substring(texts, mark)).astype(bool)
        plain = pc.if_else(pa.array(whole), "", texts) if whole.any() else texts
        chunks, codes, ends = space_words(plain)
        pieces = pc.replace_substring_regex(chunks, f"([A-Za-z0-9])({_PUNCT})", r"\1 \2")
        pieces = pc.replace_substring_regex(pieces, f"({_PUNCT})([A-Za-z0-9])", r"\1 \2")
        distinct, piece, of_chunk = space_words(pc.ascii_lower(pieces))
        if len(self.known) + len(distinct) > self.cache:
            self._forget()
        names = distinct.to_pylist()
        new = [p for p in names if p not in self.known]
        if new:
            self._remember(new)
        at = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        ids, offsets = ragged_take(self.values, self.ends, at[piece])
        ids, offsets = ragged_take(ids, offsets[of_chunk], codes)
        offsets = offsets[ends]
        if not whole.any():
            return ids, offsets
        parts = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        for i in np.flatnonzero(whole):
            parts[i] = np.array(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


@lru_cache(maxsize=2)
def worker_encoder(path: str) -> Encoder:
    return Encoder(path)


# --- Spark ----------------------------------------------------------------------------------


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Write the segments of ``docs`` (doc_id, text) to ``folder``; their manifest (segment, n_docs, n_ids, first_id)."""
    spark = docs.sparkSession
    small_batches(spark)
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = worker_encoder(tokenizer), TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        names, held, size, number = [], [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"segment-{task.partitionId():06d}-{number:04d}.bin"
            new = f"{root}/.{name}.{task.taskAttemptId()}"
            with store.open_output_stream(new) as out:
                for part in segment_bytes(names, held, encode.width):
                    out.write(part)
            store.move(new, f"{root}/{name}")
            row = [name], [task.partitionId()], [number], [len(held)], [size]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["segment", "part", "number", "n_docs", "n_ids"])

        for batch in batches:
            ids, offsets = encode(batch.column(1).cast(pa.string()))
            ids = ids.astype(f"<u{encode.width}")
            for doc, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                if held and size + b - a + 1 > segment_ids:
                    yield close()
                    names, held, size, number = [], [], 0, number + 1
                names.append(doc)
                held.append(np.append(ids[a:b], ids.dtype.type(end_id)))
                size += b - a + 1
        if held:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    manifest = written(ordered.mapInArrow(write, MANIFEST), "token-manifest")
    before = F.sum("n_ids").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("first_id", F.coalesce(before, F.lit(0)).cast("long"))


def read_token_files(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids, if asked) per document, read from the segments."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{root}/{name}") as file:
                    segment = Segment(file)
                    docs, start, rows = segment.doc_ids(), first, []
                    for doc, ids in zip(docs, segment.all_ids()):
                        rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes())) + ((ids.astype(np.int32),) if with_ids else ()))
                        start += len(ids)
                        if len(rows) == 2000:
                            yield pack(rows)
                            rows = []
                    if rows:
                        yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return manifest.select("segment", "first_id").repartition(F.col("segment")).mapInArrow(read, schema)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-files")
    return read_token_files(write_token_files(documents(spark, sf_dir), folder), folder)
