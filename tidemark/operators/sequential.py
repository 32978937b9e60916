"""Logistic regression in stages: a second fit may be held near the first one.

Rows never leave their tasks. Each pass sums loss and gradient (or the Hessian) over row blocks inside
the tasks, adds the partial sums by a grouped aggregation, and brings one number for each weight (or
pair of weights) to the driver, which moves the weight vector: by Newton steps up to `DENSE` weights,
as these take few passes, by L-BFGS beyond."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Weights up to which a pass also sums the Hessian.
DENSE = 128


@dataclass(frozen=True)
class Anchor:
    """A quadratic penalty (w - theta)' precision (w - theta) / 2; the intercept stands last."""

    theta: np.ndarray
    precision: np.ndarray


def l2_sp(theta: np.ndarray, strength: float) -> Anchor:
    """Pulls back to the weights of the first stage, all alike."""
    return Anchor(theta, strength * np.eye(len(theta)))


def laplace(theta: np.ndarray, curvature: np.ndarray, strength: float, diagonal: bool = False) -> Anchor:
    """Pulls back as far as the first stage was sure of a weight (its Hessian, or that's diagonal)."""
    return Anchor(theta, strength * (np.diag(np.diag(curvature)) if diagonal else curvature))


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """rows with `weight`, which gives both classes one total and all rows their number."""
    total = rows.agg(F.count("*").alias("__n"), F.sum(label).alias("__pos"))
    w = F.col("__n") / (2.0 * F.greatest(F.when(F.col(label) == 1, F.col("__pos")).otherwise(F.col("__n") - F.col("__pos")), F.lit(1)))
    return rows.crossJoin(F.broadcast(total)).withColumn("weight", w).drop("__n", "__pos")


def with_replay(rows: DataFrame, earlier: DataFrame, share: float) -> DataFrame:
    """Rows of the second stage with those of the first one, whose weights are `share` of their own."""
    return rows.unionByName(earlier.withColumn("weight", F.col("weight") * share))


def _blocks(rows: DataFrame, x: str, label: str, weight: str | Column) -> DataFrame:
    w = F.col(weight) if isinstance(weight, str) else weight
    return rows.where(F.col(label).isNotNull()).select(F.col(x).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"), w.cast("double").alias("w"))


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
    return np.hstack([x, np.ones((len(y), 1))]), y, w


def _sums(blocks: DataFrame, of) -> dict[int, float]:
    """Position -> sum over all rows of what `of` gives for a block (a flat array)."""

    def partial(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(*_read(batch))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "v"])

    return {r.at: r.v for r in blocks.mapInArrow(partial, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()}


def _p(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit(rows: DataFrame, x: str, label: str, weight: str | Column = "weight", l2: float = 1.0, anchor: Anchor | None = None, start: np.ndarray | None = None, steps: int = 200, tolerance: float = 1e-7, dense: int = DENSE) -> np.ndarray:
    """Weights, the intercept last, that minimise the weighted logistic loss of rows (x, an array of
    doubles of one length; label 0 or 1; nulls left out), l2 / 2 of the squares of all weights but the
    intercept, and the anchor. start carries on from earlier weights. rows are kept in Spark's store
    while this runs; a lost part is computed again. Raises ValueError without rows."""
    blocks = _blocks(rows, x, label, weight).persist()
    try:
        first = blocks.first()
        if first is None:
            raise ValueError("no labelled rows")
        dim = len(first.x) + 1
        free = np.append(np.full(dim - 1, l2), 0.0)

        curved = dim <= dense
        fixed = np.diag(free) + (anchor.precision if anchor is not None else 0)

        def at(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray | None]:
            def of(xa, y, w):
                z = xa @ theta
                p = _p(z)
                first = np.append((w * (p - y)) @ xa, (w * (np.logaddexp(0, z) - y * z)).sum())
                return np.append(first, ((xa * (w * p * (1 - p))[:, None]).T @ xa).reshape(-1)) if curved else first

            s = _sums(blocks, of)
            value = s[dim] + 0.5 * (free * theta) @ theta
            grad = np.array([s[i] for i in range(dim)]) + free * theta
            second = np.array([s[dim + 1 + i] for i in range(dim * dim)]).reshape(dim, dim) + fixed if curved else None
            if anchor is not None:
                pulled = anchor.precision @ (theta - anchor.theta)
                value, grad = value + 0.5 * (theta - anchor.theta) @ pulled, grad + pulled
            return float(value), grad, second

        return _minimise(at, np.zeros(dim) if start is None else np.asarray(start, float), steps, tolerance)
    finally:
        blocks.unpersist()


def _minimise(at, theta: np.ndarray, steps: int, tolerance: float, memory: int = 20) -> np.ndarray:
    """The least point of at(theta), which gives value, gradient and, if it has one, the Hessian.
    Steps are halved until the value falls enough."""
    value, grad, second = at(theta)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(grad).max() < tolerance * max(1.0, abs(value)):
            break
        d = _recent(grad, past) if second is None else -np.linalg.lstsq(second, grad, rcond=None)[0]
        t = 1.0
        while (new := at(theta + t * d))[0] > value + 1e-4 * t * (grad @ d) and t > 1e-10:
            t /= 2
        if t <= 1e-10:
            break
        s, y = t * d, new[1] - grad
        if s @ y > 1e-12 * (y @ y):
            past = [*past, (s, y)][-memory:]
        theta, (value, grad, second) = theta + s, new
    return theta


def _recent(grad: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A descent direction by what the last steps say of the curvature."""
    d, kept = -grad, []
    for s, y in reversed(past):
        kept.append((s @ d) / (s @ y))
        d = d - kept[-1] * y
    d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(grad).max()))
    for (s, y), a in zip(past, reversed(kept), strict=True):
        d = d + (a - (y @ d) / (s @ y)) * s
    return d


def hessian(rows: DataFrame, x: str, label: str, theta: np.ndarray, weight: str | Column = "weight", l2: float = 1.0) -> np.ndarray:
    """The curvature of the loss with its L2 part at theta (Fisher's information of the model)."""
    dim = len(theta)

    def of(xa, y, w):
        p = _p(xa @ theta)
        return ((xa * (w * p * (1 - p))[:, None]).T @ xa).reshape(-1)

    s = _sums(_blocks(rows, x, label, weight), of)
    return np.array([s.get(i, 0.0) for i in range(dim * dim)]).reshape(dim, dim) + np.diag(np.append(np.full(dim - 1, l2), 0.0))


def logit(x: Column | str, theta: np.ndarray) -> Column:
    """The model's logit of an array of features, as an expression."""
    c = F.col(x) if isinstance(x, str) else x
    parts = F.zip_with(c.cast("array<double>"), F.array(*[F.lit(float(t)) for t in theta[:-1]]), lambda a, b: a * b)
    return F.aggregate(parts, F.lit(float(theta[-1])), lambda s, v: s + v)
