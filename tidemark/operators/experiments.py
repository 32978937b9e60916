"""Training experiments: many small fits side by side.

Each configuration is a row; a task fits one configuration on a bounded sample of rows, so experiments
run beside each other and the driver fits nothing. The sample is chosen by a hash of the key, and
smaller shares are parts of larger ones."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of the hash that chooses, holds out and flips.
BUCKETS = 1_000_000


@dataclass(frozen=True)
class Setup:
    """One configuration: train on `share` of the rows that aren't held out (of groups other than
    `without`, if given), with labels turned over for `flip` of them, with the features `drop` at 0 (or
    only `only`), and L2 strength `l2`. Rows of `without` are then the ones it is tested on."""

    name: str
    share: float = 1.0
    flip: float = 0.0
    drop: tuple[int, ...] = ()
    only: tuple[int, ...] = ()
    without: str | None = None
    l2: float = 1.0
    seed: int = 0


def learning_curve(shares: Sequence[float] = (0.25, 0.5, 0.75, 1.0), seeds: int = 3) -> list[Setup]:
    return [Setup(f"share {s:g}, seed {k}", share=s, seed=k) for s in shares for k in range(seeds)]


def ablations(groups: dict[str, Sequence[int]]) -> list[Setup]:
    """All features, then all but each group."""
    return [Setup("full"), *[Setup(f"without {g}", drop=tuple(c)) for g, c in groups.items()]]


def label_noise(rates: Sequence[float] = (0.1,), seeds: int = 3) -> list[Setup]:
    return [Setup(f"flip {r:g}, seed {k}", flip=r, seed=k) for r in rates for k in range(seeds)]


def leave_one_out(groups: Sequence[str]) -> list[Setup]:
    return [Setup(f"without {g}", without=g) for g in groups]


def _coin(key: np.ndarray, seed: int, what: int) -> np.ndarray:
    """A number in [0, 1) for each key, independent of which other rows are there."""
    x = key.astype(np.uint64) + np.uint64((seed * 1_000_003 + what * 7_919) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def fit(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 50) -> np.ndarray:
    """Weights, the intercept last, of a class-balanced logistic regression by Newton steps."""
    xa = np.hstack([x, np.ones((len(x), 1))])
    w = np.where(y == 1, len(y) / (2 * max(1, int(y.sum()))), len(y) / (2 * max(1, int((1 - y).sum()))))
    free = np.append(np.full(x.shape[1], l2), 1e-9)
    t = np.zeros(xa.shape[1])
    for _ in range(steps):
        p = 0.5 * (1 + np.tanh(0.5 * (xa @ t)))
        d = np.linalg.solve((xa * (w * p * (1 - p))[:, None]).T @ xa + np.diag(free), xa.T @ (w * (p - y)) + free * t)
        t = t - d
        if np.abs(d).max() < 1e-10:
            break
    return t


def average_precision(y: np.ndarray, score: np.ndarray) -> float | None:
    """Area under precision and recall, equal scores together; None without a row of label 1."""
    if not y.sum():
        return None
    order = np.argsort(-score, kind="stable")
    last = np.append(np.flatnonzero(np.diff(score[order])), len(y) - 1)
    hits = np.cumsum(y[order])[last]
    return float((np.diff(np.append(0, hits)) * hits / (last + 1)).sum() / y.sum())


def roc_auc(y: np.ndarray, score: np.ndarray) -> float | None:
    """The chance that a row of label 1 scores higher, ties half; None for one class."""
    pos, neg = int(y.sum()), int(len(y) - y.sum())
    if not pos or not neg:
        return None
    rank = pd.Series(score).rank().to_numpy()
    return float((rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * neg))


def run(rows: DataFrame, key: str, x: str, label: str, group: str, setups: Sequence[Setup], sample: int = 20_000, held: float = 0.3) -> DataFrame:
    """name, trained, tested, pr_auc, roc_auc of each setup over rows (x an array of doubles; label 0 or
    1; null labels left out).

    At most about `sample` rows are used, those of the smallest hashes of their key, and each setup is
    tested on the same `held` share of them. Every draw is a hash of the key, so reruns agree, a
    smaller share is a part of a larger one, and no draw depends on the other rows. Features are
    standardised by the training rows."""
    spark = rows.sparkSession
    coin = F.pmod(F.xxhash64(F.lit(11), F.col(key).cast("string")), F.lit(BUCKETS))
    known = rows.where(F.col(label).isNotNull()).select(F.xxhash64(F.lit(5), F.col(key).cast("string")).alias("h"), F.col(x).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y"), F.col(group).cast("string").alias("g"), coin.alias("coin"))
    n = known.agg(F.count("*").alias("n"))
    bounded = known.crossJoin(F.broadcast(n)).where(F.col("coin") < F.ceil(F.lit(sample) / F.col("n") * BUCKETS)).drop("coin", "n")
    table = spark.createDataFrame([(i, s.name) for i, s in enumerate(setups)], "setup int, name string").repartition(max(1, len(setups)), "setup")
    by_number = {i: asdict(s) for i, s in enumerate(setups)}

    def train(p: pd.DataFrame) -> pd.DataFrame:
        s = by_number[int(p["setup"].iloc[0])]
        h = p["h"].to_numpy().view(np.uint64)
        order = np.argsort(h, kind="stable")
        p, h = p.iloc[order], h[order]
        data, y = np.array(p["x"].tolist(), np.float64), p["y"].to_numpy()
        test = (p["g"] == s["without"]).to_numpy() if s["without"] is not None else _coin(h, 0, 1) < held
        used = ~test & (_coin(h, s["seed"], 2) < s["share"])
        target = np.where(_coin(h, s["seed"], 3) < s["flip"], 1 - y, y)
        cols = [i for i in range(data.shape[1]) if i not in s["drop"] and (not s["only"] or i in s["only"])]
        result = {"name": s["name"], "trained": int(used.sum()), "tested": int(test.sum()), "pr_auc": None, "roc_auc": None}
        if used.any() and test.any():
            mean, scale = data[used].mean(axis=0), data[used].std(axis=0)
            z = ((data - mean) / np.where(scale > 0, scale, 1))[:, cols]
            score = np.round(np.hstack([z, np.ones((len(z), 1))]) @ fit(z[used], target[used], s["l2"]), 9)[test]
            result |= {"pr_auc": average_precision(y[test], score), "roc_auc": roc_auc(y[test], score)}
        return pd.DataFrame([result])

    each = table.select("setup").crossJoin(bounded)
    return each.groupBy("setup").applyInPandas(train, "name string, trained long, tested long, pr_auc double, roc_auc double")
