"""Quality by compression: which of two zstandard dictionaries shortens a text more.

One dictionary is built from good labelled texts, one from bad ones: pieces from
all places of the texts of one half of the sample, without those that the other
label's dictionary shortens much, as they tell nothing. A text is cut into
blocks of ``BLOCK`` bytes, each block is compressed with both, and the
normalised difference of the summed sizes, (bad - good) / (bad + good), is the
measure. A logistic curve over it and the compression ratio, fitted on the other
half of the sample, turns it into a score between 0 and 1. The ratio is there
for texts that repeat themselves, which any dictionary shortens alike; the
length of a text is no input.

The labelled texts learnt from are a bounded sample by the hash of the id: at
most about ``SAMPLE`` per label, each of them whole. Pieces and sizes are made
in Spark; the driver gets pieces of ``DRAWN`` dictionaries and a row of sizes per
text. Scoring reads every whole text.

Defined cases: null and empty texts score the share of label 1 among the
labelled rows, as all texts do if a label has under four texts (0.5 without
labels); an id with both labels is not learnt from; rows that repeat an id are
scored each by itself; further columns pass through whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, held_out, small_batches, written
from .labels import add_column, labelled_rows, labels_of, learnt_share

#: Labelled texts of each label that are learnt from.
SAMPLE = 1500
DICTIONARY_BYTES, BLOCK, LEVEL = 512 << 10, 8192, 9
#: Characters of a piece, drawn pieces in dictionaries, and the saving by the other label's dictionary that drops a piece.
PIECE, DRAWN, SHARED = 256, 2, 0.25
THRESHOLD = 0.3


class Measure:
    """Two dictionaries; picklable, compressors are made where they are used."""

    def __init__(self, good: bytes, bad: bytes):
        self.raw, self._ready = (good, bad), None

    def __getstate__(self):
        return {"raw": self.raw, "_ready": None}

    def _compressors(self):
        if self._ready is None:
            found = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in self.raw]
            for d in found:
                d.precompute_compress(level=LEVEL)
            self._ready = [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False) for d in found]
        return self._ready

    def release(self) -> None:
        """Give back the tables of the compressors, some 50 MB; they are made anew when they are needed."""
        self._ready = None

    def sizes(self, raw: bytes) -> tuple[int, int]:
        """Compressed bytes with the good and with the bad dictionary, over all blocks."""
        good, bad = self._compressors()
        blocks = [raw[at : at + BLOCK] for at in range(0, len(raw), BLOCK)]
        return sum(len(good.compress(b)) for b in blocks), sum(len(bad.compress(b)) for b in blocks)

    def __call__(self, text: str) -> list[int]:
        """Compressed sizes with both dictionaries and the bytes of a whole text."""
        raw = text.encode()
        return [*self.sizes(raw), len(raw)]


def inputs(sizes: np.ndarray) -> np.ndarray:
    """Inputs of the curve from rows of (good, bad, bytes): the normalised difference, and how far the text compresses at all."""
    good, bad, size = np.asarray(sizes, float).T
    diff, ratio = (bad - good) / (bad + good), np.log(good / size)
    return np.stack([np.ones(len(diff)), diff, ratio, ratio * ratio, diff * ratio, diff * diff], 1)


def dictionaries(good: list[bytes], bad: list[bytes]) -> tuple[bytes, bytes]:
    """Raw dictionary contents of drawn pieces; one that the other label's dictionary shortens by SHARED or more is left out."""
    first = [b"".join(p)[:DICTIONARY_BYTES] for p in (good, bad)]
    alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    out = []
    for pieces, other in ((good, first[1]), (bad, first[0])):
        against = Measure(other, b"")._compressors()[0]
        own = [p for p in pieces if len(against.compress(p)) > (1 - SHARED) * len(alone.compress(p))]
        out.append(b"".join(own or pieces)[:DICTIONARY_BYTES])
    return out[0], out[1]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 100) -> np.ndarray:
    """Weights of a logistic curve by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


class Classifier:
    def __init__(self, measure: Measure | None, weights: np.ndarray | None, prior: float):
        self.measure, self.weights, self.prior = measure, weights, prior

    def release(self) -> None:
        if self.measure is not None:
            self.measure.release()

    def score(self, text: str | None) -> float:
        if not text or self.measure is None:
            return self.prior
        return float(1 / (1 + np.exp(-np.clip(inputs([self.measure(text)])[0] @ self.weights, -30, 30))))


def drawn_pieces(rows: DataFrame) -> dict[int, list[bytes]]:
    """Different pieces from all places of the texts by label, DRAWN dictionaries of them at most (in expectation)."""
    places = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE).cast("int"))
    cut = F.explode(F.transform(places, lambda i: F.substring(F.col("text"), i * PIECE + 1, F.lit(PIECE))))
    pieces = written(rows.select("y", cut.alias("piece")).distinct(), "quality-pieces")
    totals = {r["y"]: r["n"] for r in pieces.groupBy("y").agg(F.sum(F.octet_length("piece")).alias("n")).collect()}
    share = F.lit(1.0)
    for y, n in totals.items():
        share = F.when(F.col("y") == y, min(1.0, DRAWN * DICTIONARY_BYTES / max(n, 1))).otherwise(share)
    order = F.xxhash64("piece")
    found = pieces.filter(F.pmod(order, F.lit(1 << 20)) / F.lit(float(1 << 20)) < share).select("y", "piece", F.xxhash64("piece", F.lit(1)).alias("o")).toArrow().to_pandas()
    return {y: [p.encode() for p in found[found.y == y].sort_values(["o", "piece"]).piece] for y in (0, 1)}


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Classifier:
    """Dictionaries from one half of the sample, the curve from the other half.

    The curve is moved from the sample's share of label 1 to that of all
    labelled rows.
    """
    small_batches(docs.sparkSession)
    prior = learnt_share(labels, label)
    prior = 0.5 if prior is None else prior
    rows = labelled_rows(docs, labels, label, SAMPLE).withColumn("_half", F.pmod(F.xxhash64(F.lit("half"), F.col("doc_id")), F.lit(2)))
    counts = {(r["y"], r["_half"]): r["n"] for r in rows.groupBy("y", "_half").agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(counts.get((y, h), 0) for y in (0, 1) for h in (0, 1)) < 2:
        return Classifier(None, None, prior)
    pieces = drawn_pieces(rows.filter("_half = 0"))
    measure = Measure(*dictionaries(pieces[1], pieces[0]))
    sizes, name = add_column(rows.filter("_half = 1").select("doc_id", "y", "text"), "sizes", T.ArrayType(T.LongType()), measure, _sizes)
    found = sizes.select("doc_id", "y", name).toArrow().sort_by("doc_id").to_pandas()
    y = found.y.to_numpy(float)
    weights = logistic(inputs(np.stack(found[name].to_numpy())), y)
    weights[0] += np.log(prior / (1 - prior)) - np.log(y.mean() / (1 - y.mean()))
    return Classifier(measure, weights, prior)


def _sizes(measure: Measure, texts: pa.Array) -> pa.Array:
    return pa.array([measure(t) for t in texts.to_pylist()], pa.list_(pa.int64()))


def _scores(classifier: Classifier, texts: pa.Array) -> pa.Array:
    return pa.array([classifier.score(t) for t in texts.to_pylist()], pa.float64())


def scored(docs: DataFrame, classifier: Classifier, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a score column, and its name."""
    return add_column(docs, "score", T.DoubleType(), classifier, _scores, text)


def keep_good(docs: DataFrame, classifier: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that score ``threshold`` or more."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    found, score = scored(docs.toDF(*names), classifier, names[docs.columns.index("text")])
    return found.filter(F.col(score) >= threshold).drop(score).toDF(*docs.columns)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found, score = scored(docs, learn(docs, labels_of(spark, sf_dir)))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(score).alias("score"),
        (F.col(score) >= THRESHOLD).cast("int").alias("predicted"),
    )
