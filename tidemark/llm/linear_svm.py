"""A linear support vector machine for bounded training samples: squared hinge loss, L2 penalty,
fitted by Newton steps whose systems are solved with conjugate gradients."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 25, inner: int = 30, balanced: bool = True) -> np.ndarray:
    """Weights, the bias last, for x (rows, features) and y in {-1, 1}. balanced: each class
    weighs the same in total. x is never copied; only vectors are made."""
    y = y.astype(np.float32)
    cost = np.full(len(y), c, np.float32)
    if balanced:
        for s in (-1, 1):
            cost[y == s] *= len(y) / (2 * max(1, (y == s).sum()))

    def times(v: np.ndarray) -> np.ndarray:
        return x @ v[:-1] + v[-1]

    def back(r: np.ndarray) -> np.ndarray:
        return np.append(r @ x, r.sum()).astype(np.float32)

    def loss(v: np.ndarray) -> float:
        m = np.maximum(0, 1 - y * times(v))
        return float(v @ v / 2 + (cost * m * m).sum())

    w = np.zeros(x.shape[1] + 1, np.float32)
    now = loss(w)
    for _ in range(steps):
        m = np.maximum(0, 1 - y * times(w))
        on = cost * (m > 0)
        r = 2 * back(on * y * m) - w
        d, p, rr = np.zeros_like(w), r.copy(), float(r @ r)
        if rr < 1e-6:
            break
        stop = rr * 1e-4
        for _ in range(inner):
            hp = p + 2 * back(on * times(p))
            a = rr / float(p @ hp)
            d += a * p
            r = r - a * hp
            new = float(r @ r)
            if new < stop:
                break
            p = r + (new / rr) * p
            rr = new
        t = 1.0
        while t > 1e-4 and (then := loss(w + t * d)) > now:
            t /= 2
        if t <= 1e-4:
            break
        w = w + np.float32(t) * d
        if now - then < 1e-5 * max(1.0, now):
            break
        now = then
    return w


def margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))


def platt(margins: np.ndarray, positive: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """a, b of the logistic curve sigmoid(a * margin + b) fitted to 0/1 labels with smoothed
    targets."""
    n1, n0 = positive.sum(), (~positive).sum()
    t = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z = np.column_stack([margins, np.ones_like(margins)]).astype(np.float64)
    v = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = sigmoid(z @ v)
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, z.T @ (p - t))
        v = v - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return float(v[0]), float(v[1])
