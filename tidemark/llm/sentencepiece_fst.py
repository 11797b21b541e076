"""SentencePiece encoding and decoding as a shortest path through weighted transducers.

Three transducers are compiled from a model file:

* the normaliser: a dummy prefix, spaces to the space mark, runs of spaces kept
  or squeezed, as the model says;
* the pieces: a trie whose paths read characters and emit a piece at its end;
* byte fallback: a character that no piece covers emits its UTF-8 bytes.

Composed with an input they give a lattice of positions and pieces, and the
result is the shortest path in the tropical semiring (weights add along a path,
the least total wins). In a unigram model an arc weighs the negative score of
its piece. In a BPE model a further acceptor over neighbouring pieces is
composed in: an arc weighs 0 if merging the two pieces' characters by the
model's priorities gives back these two pieces, and infinity if not. A sequence
of pieces is what BPE makes of a text exactly if all its neighbours are so, and
every prefix of a text has one such sequence, so one state per position is
enough in both kinds of model.

No piece holds a space mark behind another character (checked when a model is
compiled for chunked use), so a text falls into independent chunks at such
places; distinct chunks are encoded once and kept in a bounded cache.

Defined cases: null and empty texts have no ids and decode to the empty text;
ids outside the model raise; byte sequences that are not UTF-8 decode to
U+FFFD; a model with a normalisation table of its own is refused; rows that
repeat an id are encoded each by itself; further columns pass whatever their
names.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, freeing, fresh, small_batches
from .token_files import ragged_take

MODEL = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
#: Score of an unknown character below the lowest piece, in unigram models.
UNKNOWN_PENALTY = 10.0
#: Distinct chunks, and pairs of neighbouring pieces, that a worker keeps; each starts anew when it is full.
CACHE_CHUNKS, CACHE_PAIRS = 400_000, 1_000_000


# --- model file -----------------------------------------------------------------------------


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            size = number() if size is None else size
            yield key >> 3, raw[at : at + size]
            at += size


class Model:
    """What the file says: pieces, scores, kinds, the kind of model and the flags of its normaliser."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.kind, self.byte_fallback = UNIGRAM, False
        self.dummy_prefix, self.squeeze, self.escape = True, True, True
        for field, value in fields(raw):
            if field == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(fields(value))
                self.kind, self.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
            elif field == 3:
                normaliser = dict(fields(value))
                if normaliser.get(2):
                    raise ValueError("models with a normalisation table are not supported")
                self.dummy_prefix, self.squeeze, self.escape = (bool(normaliser.get(k, 1)) for k in (3, 4, 5))


# --- transducers ----------------------------------------------------------------------------


class Normaliser:
    """Input text to the text that pieces are matched against."""

    def __init__(self, model: Model):
        self.prefix = MARK if model.escape else " "
        self.model = model

    def __call__(self, text: str) -> str:
        m = self.model
        if m.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        text = " " + text if m.dummy_prefix else text
        return text.replace(" ", MARK) if m.escape else text

    def back(self, text: str) -> str:
        if self.model.escape:
            text = text.replace(MARK, " ")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


class Pieces:
    """The trie of pieces with byte fallback, and the weights of arcs."""

    def __init__(self, model: Model):
        self.model = model
        self.id = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k in (NORMAL, USER)}
        self.score = {p: model.scores[i] for p, i in self.id.items()}
        self.unknown = model.kinds.index(UNKNOWN) if UNKNOWN in model.kinds else 0
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == BYTE}
        self.trie: dict = {}
        for piece in self.id:
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = piece
        self.worst = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: merge the neighbours that form the best piece, leftmost first."""
        symbols, score = list(text), self.score
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def neighbours(self, left: str) -> dict[str, bool]:
        if self.n_pairs > CACHE_PAIRS:
            self.pairs, self.n_pairs = {}, 0
        return self.pairs.setdefault(left, {})

    def may_follow(self, left: str, piece: str, known: dict[str, bool]) -> bool:
        """Weight 0 (true) or infinity of ``piece`` behind ``left``; "" is the start."""
        self.n_pairs += 1
        known[piece] = found = self.merged(left + piece) == ([left, piece] if left else [piece])
        return found

    def emit(self, path: list[str]) -> list[int]:
        out: list[int] = []
        for piece in path:
            found = self.id.get(piece)
            if found is not None:
                out.append(found)
            elif self.model.byte_fallback and self.byte:
                out.extend(self.byte[b] for b in piece.encode())
            elif not (out and out[-1] == self.unknown):
                out.append(self.unknown)
        return out

    def bpe_path(self, text: str) -> list[str]:
        """The path of weight 0 through the lattice of ``text``; ``last`` holds the one live state of each position."""
        n = len(text)
        last: list[str | None] = [None] * (n + 1)
        last[0] = ""
        trie = self.trie
        for i in range(n):
            left = last[i]
            known = self.neighbours(left)
            node, j = trie, i
            while j < n:
                node = node.get(text[j])
                j += 1
                if node is None:
                    if j > i + 1:
                        break
                    piece, node = text[i], {}
                else:
                    piece = node.get("")
                    if piece is None:
                        if j > i + 1:
                            continue
                        piece = text[i]
                if last[j] is None:
                    ok = known.get(piece)
                    if ok or (ok is None and self.may_follow(left, piece, known)):
                        last[j] = piece
        path, at = [], n
        while at:
            path.append(last[at])
            at -= len(last[at])
        return path[::-1]

    def unigram_path(self, text: str) -> list[str]:
        """The path of least total weight, weights being negative scores."""
        n = len(text)
        best, last = [0.0] + [np.inf] * n, [""] * (n + 1)
        for i in range(n):
            node, j, single = self.trie, i, False
            while j < n and (node := node.get(text[j])) is not None:
                j += 1
                piece = node.get("")
                if piece is not None:
                    single |= j == i + 1
                    if best[i] - self.score[piece] < best[j]:
                        best[j], last[j] = best[i] - self.score[piece], piece
            if not single and best[i] - self.worst < best[i + 1]:
                best[i + 1], last[i + 1] = best[i] - self.worst, text[i]
        path, at = [], n
        while at:
            path.append(last[at])
            at -= len(last[at])
        return path[::-1]


class SentencePiece:
    """Encoder and decoder of one model."""

    def __init__(self, path: str = MODEL):
        with open(path, "rb") as f:
            self.model = Model(f.read())
        self.normalise, self.pieces = Normaliser(self.model), Pieces(self.model)
        self.path = self.pieces.bpe_path if self.model.kind == BPE else self.pieces.unigram_path
        self.chunked = self.model.escape and not self.model.squeeze and self.model.dummy_prefix and not any(MARK in p.lstrip(MARK) for p in self.pieces.id)
        surface = {CONTROL: b"", UNKNOWN: " ⁇ ".encode()}
        self.surface = pa.array(
            [bytes([int(p[3:5], 16)]) if k == BYTE else surface.get(k, p.replace(MARK, " ").encode()) for p, k in zip(self.model.pieces, self.model.kinds)],
            pa.binary(),
        )
        self.forget()

    def encode(self, text: str | None) -> list[int]:
        """Ids of one text: normalise, compose, shortest path."""
        return self.pieces.emit(self.path(self.normalise(text or "")))

    def decode(self, ids: list[int]) -> str:
        return self.decode_batch(np.array(ids, np.int64), np.array([0, len(ids)]))[0]

    def forget(self) -> None:
        """Empty the cache of chunks; a task does so at its end."""
        self.known: dict[str, int] = {}
        self.values, self.ends, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0

    def _numbers(self, chunks: list[str]) -> np.ndarray:
        """Places of chunks in the cache; new ones are encoded."""
        known, out = self.known, np.empty(len(chunks), np.int64)
        for k, chunk in enumerate(chunks):
            at = known.get(chunk)
            if at is None:
                ids = self.pieces.emit(self.path(chunk))
                at = known[chunk] = len(known)
                while self.used + len(ids) > len(self.values):
                    self.values = np.concatenate([self.values, np.zeros_like(self.values)])
                if at + 2 > len(self.ends):
                    self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
                self.values[self.used : self.used + len(ids)] = ids
                self.used += len(ids)
                self.ends[at + 1] = self.used
            out[k] = at
        return out

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the offsets of the texts in them; chunk by chunk where the model allows."""
        texts = pc.fill_null(texts, "")
        odd = np.ones(len(texts), bool)
        if self.chunked and len(texts):
            odd = np.asarray(pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.match_substring(texts, MARK), pc.starts_with(texts, " ")))).astype(bool)
        blank = np.asarray(pc.equal(texts, "")).astype(bool)
        plain = texts.filter(pa.array(~odd & ~blank))
        lists = pc.split_pattern(plain, " ")
        words = lists.flatten().dictionary_encode()
        if len(self.known) + len(words.dictionary) > CACHE_CHUNKS:
            self.forget()
        at = self._numbers([MARK + w for w in words.dictionary.to_pylist()])
        ids, offsets = ragged_take(self.values, self.ends, at[np.asarray(words.indices).astype(np.int64)] if len(words) else at)
        ends = np.asarray(lists.offsets).astype(np.int64)
        offsets = offsets[ends - ends[0]] if len(ends) else np.zeros(1, np.int64)
        size = np.zeros(len(texts), np.int64)
        size[~odd & ~blank] = np.diff(offsets)
        if not (odd & ~blank).any():
            return ids, np.concatenate([[0], np.cumsum(size)])
        parts = np.split(ids, np.concatenate([[0], np.cumsum(size)])[1:-1])
        for i in np.flatnonzero(odd & ~blank):
            text = texts[int(i)].as_py()
            if self.chunked:
                at = self._numbers(re.findall(f"{MARK}+[^{MARK}]*", self.normalise(text)))
                parts[i] = ragged_take(self.values, self.ends, at)[0]
            else:
                parts[i] = np.array(self.encode(text), np.int32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of ids: the surfaces of the pieces side by side, without the dummy prefix."""
        found = self.surface.take(pa.array(ids))
        size = np.asarray(pc.binary_length(found)).astype(np.int64)
        raw = b"".join([found.buffers()[2].to_pybytes()]) if len(found) and found.buffers()[2] is not None else b""
        at = np.concatenate([[0], np.cumsum(size)])[offsets].tolist()
        lead = self.model.dummy_prefix
        return [raw[a + (lead and raw[a : a + 1] == b" ") if b > a else a : b].decode(errors="replace") for a, b in zip(at[:-1], at[1:])]


@lru_cache(maxsize=2)
def worker_model(path: str) -> SentencePiece:
    return SentencePiece(path)


# --- Spark ----------------------------------------------------------------------------------


def encode_column(docs: DataFrame, model: str = MODEL, text: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` with the ids of every whole text and the text decoded from them; and the names of the two columns."""
    small_batches(docs.sparkSession)
    ids, decoded = fresh(docs, "ids"), fresh(docs, "decoded")
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_model(model)
        for batch in batches:
            found, offsets = coder.encode_batch(batch.column(at).cast(pa.string()))
            back = pa.array(coder.decode_batch(found, offsets), pa.string())
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, back], names=[f.name for f in schema.fields])
        coder.forget()

    return docs.mapInArrow(freeing(run), schema), ids, decoded


def id_digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of little-endian 32-bit ids), decoded_sha256, round_trip per row of (doc_id, text)."""
    small_batches(docs.sparkSession)
    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)] + [T.StructField(n, t) for n, t in (("n_tokens", T.LongType()), ("ids_crc32", T.LongType()), ("text", T.StringType()), ("decoded", T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_model(model)
        for batch in batches:
            texts = batch.column(1).cast(pa.string())
            found, offsets = coder.encode_batch(texts)
            raw = found.astype("<u4")
            crc = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            back = pa.array(coder.decode_batch(found, offsets), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(crc, pa.int64()), texts, back], names=kind.names)
        coder.forget()

    found = docs.select("doc_id", "text").mapInArrow(freeing(run), kind)
    same = F.coalesce(F.col("text"), F.lit("")) == F.col("decoded")
    return found.select("doc_id", "n_tokens", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("round_trip"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_digests(documents(spark, sf_dir))
