"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters, digits and bytes above 0x7F, A-Z lowered. A text's
features are the distinct hashes of its words, of pairs of neighbours and of
pairs one word apart. FTRL-proximal takes the sampled documents one by one;
every coordinate has its own learning rate, and the L1 term keeps weights at
exactly zero until their evidence is strong, so that the model is a short sorted
list of hashes and weights, at most one per feature bucket, which is broadcast.

The labelled texts learnt from are a bounded sample by the hash of the id: at
most about ``SAMPLE`` per label, each of them whole; Spark hashes their features
and sends those. Scoring reads every whole text.

Defined cases: null and empty texts have no features and score by the offset
alone; without labels of both kinds the score is the share of label 1 (0.5
without any); an id with both labels is not learnt from; rows that repeat an id
are scored each by itself; further columns
pass through whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import doc_of, documents, hash_words, held_out, mix, small_batches, space_words, translate
from .decontaminate import FOLD
from .labels import add_column, labelled_rows, labels_of, learnt_share

#: Labelled texts of each label that are learnt from.
SAMPLE = 4000
BITS, EPOCHS = 20, 8
#: Learning rate, its offset, L1 and L2 of FTRL-proximal.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 10.0, 0.0
THRESHOLD = 0.5


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word, pair of neighbours and pair one word apart; not yet distinct."""
    distinct, codes, ends = space_words(translate(texts, FOLD))
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words, doc = hash_words(distinct)[codes], doc_of(ends)
    found = [(doc, mix(words))]
    for step, salt in ((1, 3), (2, 7)):
        pair = doc[step:] == doc[:-step] if len(doc) > step else np.zeros(0, bool)
        found.append((doc[:-step][pair], mix(mix(words[:-step][pair] * np.uint64(salt)) + words[step:][pair])))
    return np.concatenate([d for d, _ in found]), np.concatenate([h >> np.uint64(64 - BITS) for _, h in found]).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal; coordinate 2**BITS is the offset, without L1."""

    def __init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 1 << BITS, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, y: float) -> None:
        at = np.append(at.astype(np.int64), 1 << BITS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
        grown = np.sqrt(self.n[at] + g * g)
        self.z[at] += g - (grown - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += g * g


class Model:
    """Sparse weights: sorted buckets, their weights, the offset."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, offset: float):
        self.buckets, self.weights, self.offset = buckets, weights, offset

    def scores(self, texts: pa.Array) -> np.ndarray:
        total = np.full(len(texts), self.offset)
        doc, bucket = features(texts)
        if len(self.buckets) and len(doc):
            at = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
            hit = self.buckets[at] == bucket
            seen = np.unique(doc[hit] * len(self.buckets) + at[hit])
            np.add.at(total, seen // len(self.buckets), self.weights[seen % len(self.buckets)])
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(held: list[np.ndarray], y: np.ndarray, prior: float | None, epochs: int = EPOCHS) -> Model:
    """``held``: distinct buckets of every text, ``y``: its label. ``prior``: share of label 1 among all labelled rows; the offset is moved from the sample's share to it."""
    prior = 0.5 if prior is None else prior
    none = np.zeros(0, np.int64)
    share = float(y.mean()) if len(y) else 0.5
    if not 0 < share < 1:
        return Model(none, np.zeros(0), float(np.log((prior + 1e-9) / (1 - prior + 1e-9))))
    model, order = Ftrl(), np.random.default_rng(5)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            model.learn(held[i], y[i])
    every = np.arange((1 << BITS) + 1)
    w = model.weights(every)
    kept = np.flatnonzero(w[:-1])
    return Model(kept, w[kept], float(w[-1] + np.log(prior / (1 - prior)) - np.log(share / (1 - share))))


def _buckets(_, texts: pa.Array) -> pa.Array:
    """Distinct buckets of every whole text."""
    doc, bucket = features(texts)
    own = np.unique(doc << BITS | bucket)
    ends = np.searchsorted(own >> BITS, np.arange(len(texts) + 1))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((own & ((1 << BITS) - 1)).astype(np.int32)))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    small_batches(docs.sparkSession)
    found, name = add_column(labelled_rows(docs, labels, label, SAMPLE), "buckets", T.ArrayType(T.IntegerType()), None, _buckets)
    sample = found.select("doc_id", "y", name).toArrow().sort_by("doc_id")
    return fit([b.values.to_numpy() for b in sample[name]], sample["y"].to_numpy().astype(float), learnt_share(labels, label))


def scored(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a score column, and its name."""
    return add_column(docs, "score", T.DoubleType(), model, lambda m, texts: pa.array(m.scores(texts), pa.float64()), text)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found, score = scored(docs, learn(docs, labels_of(spark, sf_dir)))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(score).alias("score"),
        (F.col(score) >= THRESHOLD).cast("int").alias("predicted"),
    )
