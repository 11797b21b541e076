"""Language ID: a bidirectional gated recurrent network over bytes, trained here with numpy.

A text's bytes (A-Z lowered) are cut into segments of ``SEGMENT``. Two GRU
layers read a segment forwards and backwards; from both states every position
gets a probability for each language, and a document's probabilities are the
mean over all its positions. Training is backpropagation through time with Adam
on a bounded sample: at most about ``SAMPLE`` texts per language (fewer if there
are many languages), chosen by the hash of the id, ``SAMPLE_CHARS`` characters
of each. Prediction reads every byte of every text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
without any labelled text all documents are ``und``; with one language all
texts with letters have it; ties go to the language that sorts first; rows that
repeat an id are predicted each by itself; further columns pass through
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, fresh, held_out, mix, small_batches, written

SEGMENT, HIDDEN = 64, 8
#: Whole texts of a language that are learnt from, texts in all, and segments of a language that are drawn from them.
SAMPLE, SAMPLE_ALL, SAMPLE_SEGMENTS = 400, 20_000, 16_384
#: Languages that are learnt: those with the most texts.
MOST_LANGUAGES = 500
STEPS, BATCH, RATE = 400, 256, 0.01
#: Segments that the network reads side by side; bounds its memory.
WIDTH = 4096

LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class Gru:
    """One direction. ``x``: (256, 3H) input rows, ``u``: (H, 3H), ``b``: bias of the candidate's recurrent part."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.x = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.u = (rng.normal(0, 1, (hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.b = np.zeros(hidden, np.float32)

    def forward(self, text: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (T, S, H) for bytes (T, S); what backpropagation needs, if asked."""
        steps, width = text.shape
        h_size = len(self.b)
        h = np.zeros((width, h_size), np.float32)
        states, kept = np.empty((steps, width, h_size), np.float32), []
        for t in range(steps):
            a = self.x[text[t]]
            g = h @ self.u
            gate = a[:, : 2 * h_size] + g[:, : 2 * h_size]
            gate *= 0.5
            np.tanh(gate, out=gate)
            gate += 1.0
            gate *= 0.5
            r, z = gate[:, :h_size], gate[:, h_size:]
            inner = g[:, 2 * h_size :] + self.b
            n = np.tanh(a[:, 2 * h_size :] + r * inner)
            new = n + z * (h - n)
            if keep:
                kept.append((h, r, z, n, inner))
            h = states[t] = new
        return states, kept

    def backward(self, text: np.ndarray, kept: list, grad: np.ndarray) -> list[np.ndarray]:
        """Gradients of x, u and b from those of all states."""
        steps, width, h_size = grad.shape
        dx = np.empty((steps, width, 3 * h_size), np.float32)
        du, db = np.zeros_like(self.u), np.zeros_like(self.b)
        dh = np.zeros((width, h_size), np.float32)
        for t in range(steps - 1, -1, -1):
            h, r, z, n, inner = kept[t]
            dh = dh + grad[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * inner * r * (1 - r)
            dx[t] = np.concatenate([dr, dz, dn], 1)
            dg = np.concatenate([dr, dz, dn * r], 1)
            du += h.T @ dg
            db += (dn * r).sum(0)
            dh = dh * z + dg @ self.u.T
        order = np.argsort(text.reshape(-1), kind="stable")
        bytes_, starts = np.unique(text.reshape(-1)[order], return_index=True)
        gx = np.zeros_like(self.x)
        gx[bytes_] = np.add.reduceat(dx.reshape(-1, 3 * h_size)[order], starts, axis=0)
        return [gx, du, db]


class Network:
    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.languages, self.ahead, self.back = languages, Gru(rng, hidden), Gru(rng, hidden)
        self.out = rng.normal(0, 0.3, (2 * hidden, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.ahead.x, self.ahead.u, self.ahead.b, self.back.x, self.back.u, self.back.b, self.out, self.bias]

    def positions(self, text: np.ndarray) -> np.ndarray:
        """Probabilities (T, S, languages) of every position of bytes (T, S)."""
        ahead, _ = self.ahead.forward(text)
        back, _ = self.back.forward(text[::-1])
        h = len(self.ahead.b)
        return softmax(ahead @ self.out[:h] + back[::-1] @ self.out[h:] + self.bias)

    def gradients(self, text: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over all positions that hold text, and its gradients."""
        ahead, kept_a = self.ahead.forward(text, True)
        back, kept_b = self.back.forward(text[::-1], True)
        both = np.concatenate([ahead, back[::-1]], 2)
        p = softmax(both @ self.out + self.bias)
        used = (text > 0).astype(np.float32) / max(1, int((text > 0).sum()))
        s = np.arange(text.shape[1])
        loss = float(-(np.log(p[:, s, label] + 1e-9) * used).sum())
        p[:, s, label] -= 1
        d = p * used[:, :, None]
        g_out = np.tensordot(both, d, ((0, 1), (0, 1)))
        g_both = d @ self.out.T
        h = len(self.ahead.b)
        left = self.ahead.backward(text, kept_a, g_both[:, :, :h])
        right = self.back.backward(text[::-1], kept_b, g_both[::-1, :, h:])
        return loss, [*left, *right, g_out, d.sum((0, 1))]

    def train(self, segments: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = 4) -> None:
        """Adam over balanced draws of segments (S, SEGMENT)."""
        rng = np.random.default_rng(seed)
        groups = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        weights = self.weights()
        m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        for step in range(1, steps + 1):
            k = rng.integers(0, len(groups), BATCH)
            pick = np.array([groups[g][rng.integers(len(groups[g]))] for g in k])
            _, grads = self.gradients(segments[pick].T, labels[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            rate = RATE * (1 - step / (steps + 1)) ** 0.5
            for w, g, a, b in zip(weights, grads, m, v):
                g = g / max(1.0, norm)
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def segments_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(segments, SEGMENT) bytes, the last one of a text filled with zeros, and the text of each."""
    raw = [LOWER[np.frombuffer(t.encode(), np.uint8)] for t in texts]
    count = np.array([-(-len(r) // SEGMENT) for r in raw], np.int64)
    out = np.zeros(int(count.sum()) * SEGMENT, np.uint8)
    at = 0
    for r, n in zip(raw, count.tolist()):
        out[at : at + len(r)] = r
        at += n * SEGMENT
    return out.reshape(-1, SEGMENT), np.repeat(np.arange(len(texts)), count)


def pooled(network: Network, texts: list[str]) -> np.ndarray:
    """Mean probabilities (texts, languages) over all positions of each text."""
    segments, owner = segments_of(texts)
    total = np.zeros((len(texts), len(network.languages)))
    for at in range(0, len(segments), WIDTH):
        part = segments[at : at + WIDTH].T
        p = network.positions(part) * (part > 0)[:, :, None]
        np.add.at(total, owner[at : at + WIDTH], p.sum(0, dtype=np.float64))
    return total / np.maximum(total.sum(1, keepdims=True), 1e-12)


def position_labels(network: Network, text: str) -> list[str]:
    """The likeliest language at every byte of a text."""
    segments, _ = segments_of([text])
    best = network.positions(segments.T).argmax(-1).T.reshape(-1)[: len(text.encode())]
    return [network.languages[k] for k in best]


def labelled_segments(docs: DataFrame, per_language: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, segments (S, SEGMENT) and the language of each, from whole labelled texts outside the held-out fold.

    Rows are drawn by the hash of the id, segments from all places of their texts
    by a hash of id and place, so that what reaches the driver is bounded.
    """
    rows = docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"))).filter("lang is not null and text is not null and text <> ''")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    counts = {r["lang"]: r["n"] for r in counts}
    if not counts:
        return [], np.zeros((0, SEGMENT), np.uint8), np.zeros(0, np.int64)
    wanted = min(per_language, max(8, SAMPLE_ALL // len(counts)))
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, wanted / n))))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = written(rows.filter(draw < share[F.col("lang")]), "language-texts")
    size = {r["lang"]: r["n"] for r in picked.groupBy("lang").agg(F.sum(F.ceil(F.octet_length("text") / SEGMENT)).alias("n")).collect()}
    languages = sorted(size)
    keep = {lang: min(1.0, SAMPLE_SEGMENTS / n) for lang, n in size.items()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                segments, _ = segments_of([text])
                place = mix(np.arange(len(segments), dtype=np.uint64) + np.full(1, doc & (1 << 62) - 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                at = np.flatnonzero((place >> np.uint64(11)) / float(1 << 53) < keep[lang])
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(at), pa.int64()), pa.array(at), pa.array([lang] * len(at), pa.string()), pa.array([segments[i].tobytes() for i in at], pa.binary())], names=["doc_id", "at", "lang", "segment"])

    found = picked.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").mapInArrow(cut, "doc_id long, at long, lang string, segment binary")
    found = found.toArrow().to_pandas().sort_values(["lang", "doc_id", "at", "segment"])
    segments = np.frombuffer(b"".join(found.segment), np.uint8).reshape(-1, SEGMENT)
    return languages, segments, found.lang.map({lang: k for k, lang in enumerate(languages)}).to_numpy(np.int64)


def learn(docs: DataFrame, steps: int = STEPS) -> Network | None:
    """Network from the labelled part of ``docs`` (doc_id, text, lang); None without any label."""
    small_batches(docs.sparkSession)
    languages, segments, codes = labelled_segments(docs)
    languages = [languages[k] for k in np.unique(codes)]
    if not languages:
        return None
    network = Network(languages)
    if len(languages) > 1:
        network.train(segments, np.unique(codes, return_inverse=True)[1].reshape(-1), steps)
    return network


def identify(docs: DataFrame, network: Network | None, text: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` with language and score of every whole text, and the names of these columns."""
    lang, score, letters = fresh(docs, "lang_pred"), fresh(docs, "score"), fresh(docs, "has_letter")
    if network is None:
        return docs.withColumns({lang: F.lit("und"), score: F.lit(0.0)}), lang, score
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            use = np.flatnonzero(np.asarray(batch.column(batch.num_columns - 1)).astype(bool))
            langs, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            if len(use):
                p = pooled(sent.value, batch.column(at).take(pa.array(use)).to_pylist())
                for i, k in zip(use.tolist(), p.argmax(1).tolist()):
                    langs[i] = sent.value.languages[k]
                scores[use] = p.max(1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(np.clip(scores, 0, 1))], names=[f.name for f in schema.fields])

    marked = docs.withColumn(letters, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    return marked.mapInArrow(run, schema), lang, score


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    network = learn(docs.select("doc_id", "text", "lang"))
    found, lang, score = identify(docs.select("doc_id", "text"), network)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(lang).alias("lang_pred"), F.col(score).alias("score"))
