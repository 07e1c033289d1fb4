"""Many logistic models over the same rows, fitted together: every pass over the data gives the gradients of all of them.

A sweep over C, penalties and class weights, or one model per class of a multilabel problem, asks for many fits on one view. The rows
are packed into matrix blocks once and cached. In each step the points that all unfinished fits want to look at go out together as one
matrix, tasks return summed losses and gradients, and the driver holds one small quasi-Newton state per fit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20
#: Partial sums one driver step adds up; more are added up by tasks first.
MOST_PARTIALS = 64


@dataclass(frozen=True)
class Linear:
    """Settings of one fit; ``target`` is the target column it learns."""

    C: float = 1.0
    l1_ratio: float = 0.0
    balanced: bool = False
    max_iter: int = 100
    tol: float = 1e-4
    intercept: bool = True
    target: int = 0


@dataclass
class LinearModel:
    """Weights by class (one row for two classes) on the features as they are, and the number of steps the fit took."""

    weights: np.ndarray
    bias: np.ndarray
    steps: int = 0

    @property
    def coefficientMatrix(self) -> DenseMatrix:
        return DenseMatrix(*self.weights.shape, self.weights.ravel(order="F"))

    @property
    def coefficients(self) -> DenseVector:
        return DenseVector(self.weights[0])

    @property
    def intercept(self) -> float:
        return float(self.bias[0])


def shares(models: Sequence[LinearModel], vec: Column) -> Column:
    """Class probabilities of each model, as an array of arrays, for all models in one pass over the vectors."""
    weights = [(m.weights.T.copy(), m.bias.copy()) for m in models]

    @F.pandas_udf("array<array<double>>")
    def score(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        x = np.stack(vectors.to_numpy()).astype(np.float64)
        out = [_probabilities(x @ w + b) for w, b in weights]
        return pd.Series([[p[i] for p in out] for i in range(len(x))])

    return score(vec)


def _probabilities(z: np.ndarray) -> np.ndarray:
    if z.shape[-1] == 1:
        p = 0.5 * (1.0 + np.tanh(0.5 * z))
        return np.concatenate([1.0 - p, p], axis=-1)
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def pack(rows: DataFrame) -> DataFrame:
    """``rows`` (vec: array<double>, target: array<int>) as (n, width, targets, x, y): matrix blocks of bounded size."""
    def each(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vec"), np.float64)
            y = _matrix(batch.column("target"), np.int32)
            step = max(1, BLOCK_BYTES // max(8, 8 * x.shape[1]))
            for i in range(0, len(x), step):
                a, b = x[i:i + step], y[i:i + step]
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(a)], pa.int32()), "width": pa.array([x.shape[1]], pa.int32()),
                                                  "targets": pa.array([y.shape[1]], pa.int32()), "x": [a.tobytes()], "y": [b.tobytes()]})

    return rows.mapInArrow(each, "n int, width int, targets int, x binary, y binary")


def _matrix(column: pa.Array, kind) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if column.null_count or len(flat) % len(column) or (column.value_lengths().to_numpy(zero_copy_only=False) != len(flat) // len(column)).any():
        raise ValueError("vectors and targets must be there and of one length")
    return np.asarray(flat, dtype=kind).reshape(len(column), -1)


def _blocks(batch: pa.RecordBatch):
    for r in batch.to_pylist():
        yield np.frombuffer(r["x"]).reshape(r["n"], r["width"]), np.frombuffer(r["y"], np.int32).reshape(r["n"], r["targets"])


def _summed(blocks: DataFrame, part, parts: int) -> np.ndarray:
    """The sum over all blocks of the vectors that ``part(x, y)`` gives."""
    def rows(total):
        if total is not None:
            yield pa.RecordBatch.from_pydict({"body": [total.astype(np.float64).tobytes()]})

    def each(batches):
        total = None
        for batch in batches:
            for x, y in _blocks(batch):
                made = part(x, y)
                total = made if total is None else total + made
        yield from rows(total)

    def add(batches):
        total = None
        for batch in batches:
            for body in batch.column("body").to_pylist():
                total = np.frombuffer(body) if total is None else total + np.frombuffer(body)
        yield from rows(total)

    partial = blocks.mapInArrow(each, "body binary")
    if parts > MOST_PARTIALS:
        partial = partial.repartition(max(1, int(parts ** 0.5))).mapInArrow(add, "body binary")
    return sum(np.frombuffer(r["body"]) for r in partial.collect())


@dataclass
class _State:
    """One fit's quasi-Newton state, in coordinates scaled by the features' deviations; L1 parts follow the orthant rule."""

    task: Linear
    l1: np.ndarray
    l2: np.ndarray
    scale: np.ndarray
    x: np.ndarray
    tries: np.ndarray | None = None
    f: float = np.inf
    g: np.ndarray | None = None
    length: float = 1.0
    steps: int = 0
    done: bool = False
    past: list = field(default_factory=list)

    def penalized(self, point: np.ndarray, loss: float, gradient: np.ndarray) -> tuple[float, np.ndarray]:
        return loss + float((0.5 * self.l2 * point * point + self.l1 * np.abs(point)).sum()), gradient + self.l2 * point

    def pseudo(self) -> np.ndarray:
        up, down = self.g + self.l1, self.g - self.l1
        at_zero = np.where(down > 0, down, np.where(up < 0, up, 0.0))
        return np.where(self.x > 0, up, np.where(self.x < 0, down, at_zero))

    def direction(self) -> np.ndarray:
        slope = self.pseudo()
        q, kept = slope.copy(), []
        for s, y in reversed(self.past):
            a = (s * q).sum() / (s * y).sum()
            q -= a * y
            kept.append(a)
        if self.past:
            s, y = self.past[-1]
            q *= (s * y).sum() / (y * y).sum()
        for (s, y), a in zip(self.past, reversed(kept)):
            q += s * (a - (y * q).sum() / (s * y).sum())
        return np.where((self.l1 == 0) | (q * slope > 0), -q, 0.0)

    def aim(self) -> None:
        """The next point to look at, along the direction at the present length."""
        step = self.x + self.length * self.way
        side = np.where(self.x != 0, np.sign(self.x), -np.sign(self.slope))
        self.tries = np.where((self.l1 > 0) & (np.sign(step) != side), 0.0, step)

    def start(self) -> None:
        self.slope = self.pseudo()
        if np.abs(self.slope * self.scale).max(initial=0.0) <= self.task.tol or self.steps >= self.task.max_iter:
            self.done = True
            return
        self.way = self.direction()
        self.length = 1.0 if self.past else min(1.0, 1.0 / max(1e-12, float(np.abs(self.slope).sum())))
        self.aim()

    def take(self, loss: float, gradient: np.ndarray) -> None:
        """Loss and gradient at the point last looked at: move there if it is low enough, else come closer."""
        f, g = self.penalized(self.tries, loss, gradient)
        if self.g is not None and not f <= self.f + 1e-4 * float((self.slope * (self.tries - self.x)).sum()):
            self.length *= 0.5 if np.isfinite(f) else 0.1
            if self.length < 1e-6:  # no lower point along it: once more from the plain gradient, then this is as low as sums of doubles get
                self.done = not self.past
                self.past = []
                if not self.done:
                    self.start()
                return
            self.aim()
            return
        if self.g is not None:
            s, y = self.tries - self.x, g - self.g
            if (s * y).sum() > 1e-12 * (y * y).sum() > 0:
                self.past = [*self.past[-9:], (s, y)]
            self.steps += 1
        flat = self.f - f <= 1e-13 * max(1.0, abs(f))
        self.x, self.f, self.g = self.tries, f, g
        if flat:
            self.done = True
        else:
            self.start()


def fit_linear(rows: DataFrame, tasks: Sequence[Linear], n_classes: int = 2) -> list[LinearModel]:
    """One model per task over ``rows`` (vec, target: array<int> of class indices, one entry per target column).

    Minimizes the mean weighted log loss plus ``1 / (C n)`` times the penalty (half the squares, or with ``l1_ratio`` that share of
    absolute values) on the features as they are, intercepts free; until no component of the gradient exceeds ``tol`` or after ``max_iter`` steps.
    Balanced weights are n / (classes * count). Vectors must be there and of one length.
    """
    blocks = pack(rows.select(F.col("vec").cast("array<double>").alias("vec"), F.col("target").cast("array<int>").alias("target")))
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fit(blocks, list(tasks), n_classes)
    finally:
        blocks.unpersist()


def _fit(blocks: DataFrame, tasks: list[Linear], n_classes: int) -> list[LinearModel]:
    shape = blocks.select("width", "targets", F.spark_partition_id().alias("p")).agg(
        F.max("width").alias("d"), F.min("width").alias("least"), F.max("targets").alias("t"), F.count_distinct("p").alias("p")).first()
    if shape["d"] is None:
        raise ValueError("no rows to fit")
    if shape["least"] != shape["d"]:
        raise ValueError("vectors must be of one length")
    d, targets, parts = shape["d"], shape["t"], shape["p"]

    def facts(x, y):
        counts = [(y == k).sum(axis=0) for k in range(n_classes)]
        return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0), *counts]).astype(np.float64)

    sums = _summed(blocks, facts, parts)
    n, mean = sums[0], sums[1:1 + d] / sums[0]
    deviation = np.sqrt(np.maximum(sums[1 + d:1 + 2 * d] / n - mean * mean, 0.0))
    scale = np.where(deviation > 1e-12, deviation, 1.0)
    counts = sums[1 + 2 * d:].reshape(n_classes, targets)
    rows = 1 if n_classes == 2 else n_classes
    present = (counts > 0).sum(axis=0)
    weights = np.ones((len(tasks), n_classes))
    for i, t in enumerate(tasks):
        if t.balanced:
            weights[i] = n / (present[t.target] * np.maximum(counts[:, t.target], 1.0))
    total = np.array([(weights[i] * counts[:, t.target]).sum() for i, t in enumerate(tasks)])
    states = []
    for t in tasks:
        penalty = np.zeros((rows, d + 1))
        penalty[:, :d] = 1.0 / (t.C * n)
        unit = np.append(scale, 1.0)
        states.append(_State(t, penalty * t.l1_ratio / unit, penalty * (1 - t.l1_ratio) / unit ** 2, np.tile(unit, (rows, 1)), np.zeros((rows, d + 1))))
        states[-1].tries = states[-1].x
    while active := [i for i, s in enumerate(states) if not s.done]:
        points = np.stack([states[i].tries for i in active])
        free = np.array([tasks[i].intercept for i in active])
        picked, given = [tasks[i].target for i in active], weights[active]

        def part(x, y, points=points, picked=picked, given=given):
            k = len(points)
            z = (x / scale) @ points[:, :, :d].reshape(k * rows, d).T + points[:, :, d].reshape(-1)
            z = z.reshape(len(x), k, rows)
            truth = y[:, picked]
            w = given[np.arange(k), truth]
            if rows == 1:
                sign = np.where(truth == 1, 1.0, -1.0)
                margin = sign * z[:, :, 0]
                loss = np.logaddexp(0.0, -margin) * w
                error = (-sign * w * 0.5 * (1.0 - np.tanh(0.5 * margin)))[:, :, None]
            else:
                p = _probabilities(z)
                hit = np.arange(rows) == truth[:, :, None]
                top = z.max(axis=-1)
                loss = (np.log(np.exp(z - top[:, :, None]).sum(axis=-1)) + top - np.take_along_axis(z, truth[:, :, None], 2)[:, :, 0]) * w
                error = (p - hit) * w[:, :, None]
            gradient = np.empty((k, rows, d + 1))
            gradient[:, :, :d] = (error.reshape(len(x), -1).T @ (x / scale)).reshape(k, rows, d)
            gradient[:, :, d] = error.sum(axis=0)
            return np.concatenate([loss.sum(axis=0), gradient.ravel()])

        made = _summed(blocks, part, parts)
        gradients = made[len(active):].reshape(points.shape)
        gradients[~free, :, d] = 0.0
        for at, i in enumerate(active):
            states[i].take(made[at] / total[i], gradients[at] / total[i])
    return [LinearModel(s.x[:, :d] / scale, s.x[:, d].copy(), s.steps) for s in states]
