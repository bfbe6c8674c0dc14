"""Quality rules: fixed base rules, then a hashed n-gram logistic regression with calibrated probabilities.

Method. Words, pairs of words and runs of three to five characters are hashed to a fixed number of buckets; a text's features
are the buckets' shares. Weights are fitted on labelled texts, and a second fit on texts kept apart (Platt's two
parameters) turns scores into probabilities. Executors score Arrow batches; verdicts follow from fixed thresholds.

Bound. The model is fitted on at most `sample` labelled rows, chosen by a hash of doc_id: features of those reach the
driver, never a count that grows with the corpus. Scores, counts and thresholds cover every row and whole texts.

Defined results: a null or empty text has no words and fails the base rules; without labels of both kinds the model
gives every text the share of good labels (1 if there is none); equal labels of a doc_id count once;
input columns named as those that apply() adds are replaced.
"""

from __future__ import annotations

import dataclasses
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textstats
from .common import first_by_hash, with_text_columns

#: Buckets of words and of runs of characters; powers of two.
BUCKETS = 4096
#: Labelled rows that a fit takes at most, and the probability below which a text is rejected.
SAMPLE, KEEP_FROM = 3000, 0.4
#: Base rules: fewer words, or a larger percentage of words in repeated windows, fail.
MIN_WORDS, MAX_REPEAT = 20, 30
#: Odd multipliers that spread runs of 3, 4 and 5 characters.
SPREAD = {3: 0x9E3779B97F4A7C15, 4: 0xC2B2AE3D27D4EB4F, 5: 0x165667B19E3779F9}


class Hashes(dict):
    """Hash of a word, kept while a task runs, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = zlib.crc32(word)
        return h


def word_buckets(words: list[bytes], hashes: Hashes) -> np.ndarray:
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B1) + h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.concatenate([h * np.uint64(0x9E3779B97F4A7C15), pairs]) >> np.uint64(52)


def run_buckets(text: str) -> np.ndarray:
    """Buckets of the runs of code points of the lengths in SPREAD."""
    c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    out, run = [], c
    for n in (2, 3, 4, 5):
        if len(run) < 2:
            break
        run = run[:-1] * np.uint64(0x100000001B3) + c[n - 1 :]
        if n in SPREAD:
            out.append((run * np.uint64(SPREAD[n])) >> np.uint64(52))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


@dataclasses.dataclass
class Model:
    weights: np.ndarray  # of word buckets, then of buckets of runs
    bias: float
    slope: float
    offset: float

    def probability(self, texts: list[str | None], hashes: Hashes) -> np.ndarray:
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            words, runs = word_buckets((t or "").encode("utf-8").split(), hashes), run_buckets(t or "")
            z = self.bias
            z += float(self.weights[:BUCKETS][words].mean()) if len(words) else 0.0
            z += float(self.weights[BUCKETS:][runs].mean()) if len(runs) else 0.0
            out[i] = z
        return 1 / (1 + np.exp(-np.clip(self.slope * out + self.offset, -30, 30)))


def features(text: str | None, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur, and their shares among the words' and among the runs' buckets."""
    words, runs = word_buckets((text or "").encode("utf-8").split(), hashes), run_buckets(text or "")
    dense = np.concatenate([np.bincount(x.astype(np.int64), minlength=BUCKETS) / max(len(x), 1) for x in (words, runs)])
    at = np.flatnonzero(dense)
    return at.astype(np.int32), dense[at].astype(np.float32)


def labelled(documents: DataFrame, labels: DataFrame, sample: int, label: str = "quality") -> DataFrame:
    """(doc_id, text, label) of at most sample rows; which, a hash of doc_id says.

    Of documents with one doc_id the smallest text counts, so that repeated rows cannot widen the sample.
    """
    few = first_by_hash(labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label")), "doc_id", sample)
    named = F.broadcast(few.select("doc_id").distinct())
    texts = documents.select("doc_id", "text").join(named, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    return texts.join(F.broadcast(few), "doc_id")


def logistic(x: np.ndarray, y: np.ndarray, ridge: np.ndarray, steps: int = 300, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam steps on the mean logistic loss with ridge/2 * w**2."""
    w, b = np.zeros(x.shape[1], np.float32), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g, gb = x.T @ (p - y).astype(np.float32) / len(y) + ridge * w, float((p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = rate / (1 + 3 * t / steps)
        w = w - step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= 0.1 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w.astype(np.float64), b


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> Model:
    """A model of label 1; every fifth of the sampled rows serves the calibration alone."""

    def make():
        hashes = Hashes()

        def work(texts: list) -> dict:
            got = [features(t, hashes) for t in texts]
            return {"at": [a.tobytes() for a, _ in got], "share": [s.tobytes() for _, s in got]}

        return work

    fields = [T.StructField("at", T.BinaryType()), T.StructField("share", T.BinaryType())]
    rows = with_text_columns(labelled(documents, labels, sample, label), fields, make, keep=["doc_id", "label"]).collect()
    rows.sort(key=lambda r: (r.doc_id, r.label))
    y = np.array([r.label for r in rows], dtype=np.float64)
    if len(set(y)) < 2:
        share = float(y.mean()) if len(y) else 1.0
        return Model(np.zeros(2 * BUCKETS), 0.0, 0.0, 30.0 * (2 * share - 1))
    x = np.zeros((len(rows), 2 * BUCKETS), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["share"], np.float32)
    apart = np.array([zlib.crc32(str(r.doc_id).encode()) % 5 == 1 for r in rows])
    if len(set(y[~apart])) < 2 or len(set(y[apart])) < 2:
        apart = np.zeros(len(rows), bool)
    w, b = logistic(x[~apart], y[~apart], np.float32(1e-5))
    held = apart if apart.any() else ~apart
    z = x[held] @ w + b
    spread = max(float(z.std()), 1e-6)
    slope, offset = logistic((z / spread).reshape(-1, 1).astype(np.float32), y[held], np.float32(1e-2), steps=400, rate=0.1)
    return Model(w, b, float(slope[0]) / spread, offset)


def apply(documents: DataFrame, model: Model, keep_from: float = KEEP_FROM, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT, column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """documents (their columns keep) with the base counts, base_failed, probability and kept."""

    def make():
        hashes = Hashes()

        def work(texts: list) -> dict:
            out = textstats.base(texts)
            failed = (out["n_words"] < min_words) | (100 * out["n_repeat_words"] > max_repeat * out["n_words"])
            p = model.probability(texts, hashes)
            return out | {"base_failed": failed, "probability": p, "kept": ~failed & (p >= keep_from)}

        return work

    counts = [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    fields = [*counts, T.StructField("base_failed", T.BooleanType()), T.StructField("probability", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return with_text_columns(documents, fields, make, column, keep)
