"""Packing of documents into sequences of fixed length by multiway differencing.

Every document becomes ids and an end id. Pieces of the full window length are
sequences already; what is left over of each document goes to a group of about
``GROUP`` remainders. In a group, Karmarkar-Karp differencing deals the pieces
to windows: a partial partition holds one sum per window, the two with the
largest imbalance are merged with the large sums of one on the small sums of
the other, until one partition is left. Its windows are near equal; if one
exceeds the capacity, the group is dealt anew to one window more.

Pieces of all sizes are what differencing needs for equal windows, so one
remainder in ``HALVED`` is cut into halves, quarters and so on. If a group needs
more than one window in a hundred beyond its tokens' own number, twice as many
remainders are halved, at last all of them.

Ids are written once with the number that chooses their group; groups have a
bounded number of rows, whatever the documents are, and the only exchange is
that of the remainders. Texts are never exchanged.

Defined cases: a null text is empty and has the end id alone; rows without a
doc_id or with the same one are documents of their own, told apart in the
result by their sequence alone; a text of any length is cut into as many
sequences as it needs; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, freeing, mix, small_batches, written

WINDOW = 2048
END_ID = 1
#: Remainders of documents in a group.
GROUP = 1000
#: Groups that a task reads, one after the other, about 3 MB each.
GROUPS = 16
#: A writer holds a row group in memory; ids do not repeat as whole values, so a dictionary of them is of no use.
SMALL_BLOCKS = {"parquet.block.size": str(16 << 20), "parquet.enable.dictionary": "false"}
#: One remainder in so many is cut into halves; a piece has at least SMALLEST ids then.
HALVED, SMALLEST = 4, 4
#: Ranks of the vocabulary of byte_bpe_50k.json, and its special token.
TOKENIZER, SPECIAL = public_tokenizers.path("byte_bpe_50k.tiktoken"), "<|endoftext|>"


class ByteEncoder:
    """Ids of a byte-level vocabulary, as the ``tokenizers`` library gives them.

    The vocabulary is read as ranks, from which another library gives the same
    ids in a quarter of the time (the tests compare the two). The special
    token's own string in a text is that token in both.
    """

    def __init__(self, path: str = TOKENIZER, special: str = SPECIAL):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coding = tiktoken.Encoding("byte pairs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={special: len(ranks)})

    def __call__(self, text: str | None) -> np.ndarray:
        return self.coding.encode_to_numpy(text or "", allowed_special="all")


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


# --- differencing -----------------------------------------------------------------------------


def differencing(sizes: list[int], m: int) -> np.ndarray:
    """Window 0 .. m-1 of every piece: near-equal sums by Karmarkar-Karp multiway differencing."""
    heap, joined, top = [], [], len(sizes)
    for i, size in enumerate(sizes):
        sums, bags = np.zeros(m, np.int64), np.zeros(m, np.int64)
        sums[0], bags[0] = size, i + 1
        heap.append((-int(size), i, sums, bags))
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        (_, _, a, x), (_, _, b, y) = heapq.heappop(heap), heapq.heappop(heap)
        sums, y = a + b[::-1], y[::-1]  # the sums of a partial partition descend; imbalances meet the other way round
        both = np.flatnonzero((x > 0) & (y > 0))
        bags = np.where(x > 0, x, y)
        bags[both] = top + 1 + np.arange(len(both))
        joined.append((top + 1, x[both], y[both]))
        top += len(both)
        down = np.argsort(-sums, kind="stable")
        sums, bags = sums[down], bags[down]
        sums = sums - sums[-1]
        heapq.heappush(heap, (-int(sums[0]), order, sums, bags))
        order += 1
    window = np.full(top + 1, -1)
    if heap:
        bags = heap[0][3]
        window[bags[bags > 0]] = np.flatnonzero(bags)
    for first, x, y in reversed(joined):
        window[x] = window[y] = window[first : first + len(x)]
    return window[1 : len(sizes) + 1]


def halves(size: int, smallest: int = SMALLEST) -> list[int]:
    """Lengths that a remainder is cut into: a half, a quarter and so on."""
    out = []
    while size > 0:
        out.append(min(size, max(smallest, -(-size // 2))))
        size -= out[-1]
    return out


def deal(sizes: list[int], window: int = WINDOW) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """Pieces (remainder, start in it, length) and their windows; no window has more than ``window`` ids."""
    ideal, every = -(-sum(sizes) // window), HALVED
    while True:
        pieces = []
        for i, size in enumerate(sizes):
            at = 0
            for length in halves(size) if i % every == 0 else [size]:
                pieces.append((i, at, length))
                at += length
        lengths, m = np.array([p[2] for p in pieces], np.int64), max(1, ideal)
        while every == 1 or m <= ideal + max(1, ideal // 100):
            found = differencing(lengths, m)
            if np.bincount(found, lengths, minlength=m).max() <= window:
                return pieces, found
            m += 1
        every //= 2


# --- Spark ------------------------------------------------------------------------------------

_PIECES = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("offset", pa.int64())]))
SEQUENCES = (
    "sequence_id long, n_tokens long, ids binary, "
    "pieces array<struct<doc_id:long,start:long,length:long,doc_tokens:long,offset:long>>"
)


def tokenised(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """(draw, doc_id, start, length, doc_tokens, ids): the full windows and the remainder of every document; written.

    ``ids`` are unsigned 32-bit little-endian numbers; ``draw`` chooses the group of a remainder.
    """
    names = ["draw", "doc_id", "start", "length", "doc_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, count = worker_encoder(tokenizer), TaskContext.get().partitionId() << 40

        def out(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal count
            draws = mix(np.arange(count, count + len(rows), dtype=np.uint64)) >> np.uint64(1)
            count += len(rows)
            return pa.RecordBatch.from_arrays([pa.array(draws.astype(np.int64)), *(pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.binary()]))], names=names)

        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.append(encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                for at in range(0, len(own), window):
                    piece = own[at : at + window]
                    rows.append((doc, at, len(piece), len(own), piece.tobytes()))
                    held += len(piece)
                if held > 1 << 18:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)

    schema = "draw long, doc_id long, start long, length long, doc_tokens long, ids binary"
    small_batches(docs.sparkSession)
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(freeing(run), schema), "packing-ids", **SMALL_BLOCKS)


def padded(n: int, window: int) -> int:
    """Length that a sequence of ``n`` ids is padded to: powers of two stay as they are."""
    return n if n & (n - 1) == 0 else window


def _grouped(window: int, pad_id: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("draw").combine_chunks()
        group = table["group"][0].as_py()
        rows = {c: table[c].to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "ids")}
        pieces, found = deal(rows["length"], window)
        ids, parts, n = {}, {}, {}
        for (i, at, length), w in zip(pieces, found.tolist()):
            own = {"doc_id": rows["doc_id"][i], "start": rows["start"][i] + at, "length": length, "doc_tokens": rows["doc_tokens"][i], "offset": n.get(w, 0)}
            parts.setdefault(w, []).append(own)
            ids.setdefault(w, []).append(rows["ids"][i][4 * at : 4 * (at + length)])
            n[w] = n.get(w, 0) + length
        fill = np.uint32(pad_id).astype("<u4").tobytes()
        return pa.Table.from_arrays(
            [
                pa.array([group << 20 | w for w in n]), pa.array(list(n.values()), pa.int64()),
                pa.array([b"".join(ids[w]) + fill * (padded(n[w], window) - n[w]) for w in n], pa.binary()), pa.array([parts[w] for w in n], _PIECES),
            ],
            names=["sequence_id", "n_tokens", "ids", "pieces"],
        )

    return run


def sequences(rows: DataFrame, window: int = WINDOW, pad_id: int = 0, group: int = GROUP) -> DataFrame:
    """(sequence_id, n_tokens, ids, pieces): the ids of every sequence, padded, and whose they are.

    ``rows`` are those of ``tokenised``. A sequence is padded to ``window`` ids
    unless it has a power of two of them.
    """
    rest, full = rows.filter(F.col("length") < window), rows.filter(F.col("length") == window)
    n = max(1, -(-rest.count() // group))
    # a task reads GROUPS groups, however many there are
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // GROUPS))
    dealt = rest.withColumn("group", F.col("draw") % n).repartition(parts, "group").groupBy("group").applyInArrow(_grouped(window, pad_id), SEQUENCES)
    own = F.struct("doc_id", "start", "length", "doc_tokens", F.lit(0).cast("long").alias("offset"))
    alone = full.select(
        F.monotonically_increasing_id().bitwiseOR(F.lit(1 << 62)).alias("sequence_id"), F.col("length").alias("n_tokens"), "ids", F.array(own).alias("pieces")
    )
    return dealt.unionByName(alone)


def digests(packed: DataFrame) -> DataFrame:
    """One row per piece of the sequences, with the check sum of its ids there."""
    p = packed.select("sequence_id", "ids", F.explode("pieces").alias("p")).select("sequence_id", "ids", "p.*")
    own = F.substring(F.col("ids"), (4 * F.col("offset") + 1).cast("int"), (4 * F.col("length")).cast("int"))
    return p.select("doc_id", "start", "length", F.crc32(own).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(sequences(tokenised(documents(spark, sf_dir))))
