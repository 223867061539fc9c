"""Rows that labels mark, and the small logistic fits on bounded samples of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A label table of no more rows than this (two longs each) is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 1_000_000


def held_out(folds: int, fold: int) -> Column:
    """crc32 of doc_id as text modulo ``folds`` is ``fold``; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def one_label(labels: DataFrame, name: str) -> DataFrame:
    """doc_id, label (0 or 1): the largest of a document's labels; rows without id or label are left out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).cast("int").alias("label"))
    return rows.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("label") > 0, 1).otherwise(0)).alias("label"))


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Inner join on doc_id; labels are broadcast only after counting them."""
    few = labels.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(labels) if few else labels, "doc_id")


def bounded_sample(labels: DataFrame, most: int) -> DataFrame:
    """At most so many labelled rows, by the order of a hash of doc_id."""
    return labels.orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(most)


class Logistic:
    """L2-regularised logistic regression by Newton steps on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50, intercept: bool = True, start: float = 0.0):
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        if not intercept:
            self.mean = np.zeros(x.shape[1])
        z = np.c_[(x - self.mean) / self.scale, np.full(len(x), float(intercept))]
        self.weights = np.zeros(z.shape[1])
        self.weights[-1] = start
        if len(x) == 0 or (intercept and y.min() == y.max()):  # nothing to tell apart: the smoothed share of the label
            if len(x):
                self.weights[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
            return
        penalty = ridge * len(x) * np.eye(z.shape[1])
        penalty[-1, -1] = 0 if intercept else 1

        def loss(weights: np.ndarray) -> float:
            margin = z @ weights
            return float((np.logaddexp(0, margin) - y * margin).sum() + weights @ penalty @ weights / 2)

        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -40, 40)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(z.shape[1]), z.T @ (p - y) + penalty @ self.weights)
            share = 1.0  # a whole step may lead away from the least loss where the classes lie far apart
            while share > 1e-4 and loss(self.weights - share * step) > loss(self.weights):
                share /= 2
            self.weights = self.weights - share * step
            if np.abs(share * step).max() < 1e-8:
                break

    def margin(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))
