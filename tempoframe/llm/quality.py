"""Document quality by Bradley-Terry ranking.

Features of the whole text are compared in preference pairs: one document marked good, one marked poor. Weights come
from the logistic loss on the differences of their features, so that a document's score is its strength in the
Bradley-Terry sense. The threshold is the score quantile that leaves the share of poor documents below it; score is
the logistic function of the distance to it.

The fit uses at most ``SAMPLE_ROWS`` labelled rows and ``PAIRS`` pairs of them; every document is scored.

Defined cases: null text is the empty text (all shares zero); without labels of both kinds all scores are 0.5, which
predicts 1; several labels of a document count as their largest; a null ``doc_id`` is never held out and never learnt
from; repeated rows are scored each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempoframe.llm.labelled import Logistic, bounded_sample, held_out, one_label, with_labels
from tempoframe.llm.shared import bounded_batches, staged, text_or_empty

FOLDS, FOLD = 3, 1
SAMPLE_ROWS, PAIRS = 20_000, 200_000


def byte_groups() -> np.ndarray:
    """Group of each UTF-8 byte: letters, digits, spaces and some kinds of marks."""
    out = np.full(256, 7, np.int64)
    for group, members in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:?'\"-()", bytes(range(128, 256)))):
        out[list(members)] = group
    out[list(b"|/\\_=<>{}[]~^`")] = 8
    return out


GROUPS = byte_groups()


def features(text: str) -> list[float]:
    """Shares and means, so that they do not grow with the length; the lengths themselves as logarithms."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(len(data), 1)
    by_byte = np.bincount(data, minlength=256) if len(data) else np.zeros(256, np.int64)
    share = np.bincount(GROUPS, weights=by_byte, minlength=9) / n
    p = by_byte[by_byte > 0] / n
    words, lines = text.split(), [x for x in text.split("\n") if x]
    w, k = max(len(words), 1), max(len(lines), 1)
    same = sum(map(eq, words, words[1:])) / w
    counts = Counter(words)
    windows = [len(set(words[i : i + 64])) / len(words[i : i + 64]) for i in range(0, len(words), 64)]
    upper, alpha = sum(map(str.isupper, words)) / w, sum(map(str.isalpha, words)) / w
    marks = share[5] + share[7] + share[8]
    shares = [*share, same, upper, alpha, max(counts.values(), default=0) / w, len(set(lines)) / k, float(np.mean(windows)) if windows else 0.0, min(windows, default=0.0)]
    return [*shares, float(-(p * np.log(p)).sum()), sum(map(len, words)) / w / 10, *(float(np.log(x + 0.01)) for x in (share[1], marks, share[7], share[8], same, upper)), float(np.log(n)), float(np.log(w)), float(np.log(k))]


def preference_pairs(label: np.ndarray, most: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of good and of poor rows, paired at random; each row is in a pair."""
    rng = np.random.default_rng(seed)
    good, poor = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(poor):
        return good[:0], poor[:0]
    n = max(most, len(label))
    return tuple(rng.permutation(np.resize(rng.permutation(x), n)) for x in (good, poor))


class Ranking:
    """Bradley-Terry strengths that are linear in the features, and the threshold by quantile."""

    def __init__(self, x: np.ndarray, label: np.ndarray, pairs: int = PAIRS):
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        good, poor = preference_pairs(label, pairs)
        self.weights, self.threshold = np.zeros(x.shape[1]), 0.0
        if len(good):
            z = (x - self.mean) / self.scale
            # Each pair once in either direction, so that the loss is that of a fit without intercept.
            d = z[good] - z[poor]
            d[1::2] *= -1
            won = np.ones(len(d))
            won[1::2] = 0
            fit = Logistic(d, won, ridge=1e-3, intercept=False)
            self.weights = fit.weights[:-1] / fit.scale
            s = np.sort(self.strength(x))
            k = int(np.count_nonzero(label == 0))
            self.threshold = float((s[max(k - 1, 0)] + s[min(k, len(s) - 1)]) / 2)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.threshold, -40, 40)))


def quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, pairs: int = PAIRS, column: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted. Rows whose crc32(doc_id as text) mod 3 is 1 are held out."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    learnt = staged(bounded_sample(one_label(labels, column).filter(~held_out(FOLDS, FOLD)), sample_rows))
    width = len(features(""))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([features(t.as_py()) for t in b.column(0)], pa.list_(pa.float64()))], ["label", "x"])

    rows = with_labels(texts, learnt).select("text", "label").mapInArrow(measured, "label int, x array<double>").collect()  # sample_rows documents
    rows.sort(key=lambda r: (r["label"], r["x"]))
    ranking = Ranking(np.array([r["x"] for r in rows], float).reshape(len(rows), width), np.array([r["label"] for r in rows], int), pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = ranking.score(np.array([features(t.as_py()) for t in b.column(2)], float).reshape(b.num_rows, width))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array(score >= 0.5).cast(pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return texts.select("doc_id", held_out(FOLDS, FOLD).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
