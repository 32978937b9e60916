"""Embedding whitening with MLlib's distributed singular value decomposition.

Entries become whole numbers x = floor(64 * c) + 1000000, so that means and deviations are exact.
The fit list holds each distinct vector once: n vectors with sums S. MLlib's computeSVD takes the rows
x - S / n, centred before anything is multiplied; its right singular vectors are the components, and
a singular value s becomes the eigenvalue s^2 / n. The total variance comes from the exact deviations
n * x - S, not from the decomposition, which gives only the first components.

Scale: the fit list is found by one shuffle of distinct vectors, written to the shared folder and
read by each pass. The driver holds sums, components and matrices of dimension by dimension numbers
at most, never rows. Every row is projected inside its task; rows that repeat a vector stay apart."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, OFFSET = 64, 1_000_000
#: Components at most; those whose standard deviation is below LEAST times the first have none.
COMPONENTS, LEAST = 16, 1e-6
#: Largest magnitude of 64 * c, so that floor() is exact as a double and x fits a long.
LARGEST = float(1 << 52)


def whole(embedding: Column | str) -> Column:
    """Entries as array of longs; null where the vector is null, empty, or holds a null, a
    non-finite entry."""
    c = F.col(embedding) if isinstance(embedding, str) else embedding
    good = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scaled = F.transform(c, lambda v: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), v.cast("double") * SCALE))) + OFFSET)
    return F.when(good & (F.size(c) > 0), scaled)


@dataclass
class Whitening:
    """n and exact sums of the fit list, components [dimension, k] with their eigenvalues, trace of
    the covariance, and the largest entry of the whitened covariance minus the identity."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float

    def onto(self) -> np.ndarray:
        """What x - S / n is multiplied by."""
        return self.components / np.sqrt(self.eigenvalues)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The exact sum over dimensions of (n * x - S)^2 of every row of x (longs)."""
    if not len(x):
        return []
    kind = np.int64 if _fits(x, n, sums) else object
    d = x.astype(kind) * n - np.array(sums, kind)
    return [int(v) for v in (d * d).sum(axis=1)]


def _fits(x: np.ndarray, n: int, sums: list[int]) -> bool:
    """True if squares of n * x - S add up to a long."""
    low, high = x.min(axis=0).tolist(), x.max(axis=0).tolist()
    return sum(max(abs(n * a - s), abs(n * b - s)) ** 2 for a, b, s in zip(low, high, sums, strict=True)) < 1 << 63 and n * max(map(abs, (*low, *high))) < 1 << 63


def described(x: Column, n: int, sums: list[int], onto: np.ndarray | None) -> Column:
    """deviation (decimal(38,0), exact) and, where there are components, w: x - S / n on each of them."""
    mean = np.array([s / n for s in sums])
    width = 0 if onto is None else onto.shape[1]

    @F.arrow_udf("struct<deviation:decimal(38,0),w:array<double>>")
    def describe(column: pa.Array) -> pa.Array:
        rows = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(sums))
        exact = pa.array([Decimal(v) for v in deviations(rows, n, sums)], pa.decimal128(38, 0))
        out = (rows - mean) @ onto if width else np.zeros((len(rows), 0))
        ends = pa.array(np.arange(len(rows) + 1) * width, pa.int32())
        return pa.StructArray.from_arrays([exact, pa.ListArray.from_arrays(ends, pa.array(out.reshape(-1)))], names=["deviation", "w"])

    return describe(x)


def _matrix(rows: DataFrame, values: Column) -> RowMatrix:
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(values).alias("row")), "row"))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of rows (x, array of longs); None if there are none or
    all are equal. Raises ValueError if they differ in length."""
    distinct = written(rows.select("x").where("x IS NOT NULL").distinct(), "whitening-fit")
    n, least, dimension = distinct.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if not n:
        return None
    if least != dimension:
        raise ValueError(f"vectors of {least} to {dimension} entries")
    sums = list(distinct.agg(*[F.sum(F.get("x", F.lit(i))) for i in range(dimension)]).first())
    total = distinct.agg(F.sum(described(F.col("x"), n, sums, None)["deviation"])).first()[0]
    if not total:
        return None
    mean = F.array(*[F.lit(s / n) for s in sums])
    # all components are asked for, as MLlib then decomposes exactly and doesn't iterate to a tolerance
    svd = _matrix(distinct, F.zip_with("x", mean, lambda v, m: v.cast("double") - m)).computeSVD(dimension, False, LEAST)
    values = (np.array(svd.s.toArray()) ** 2 / n)[:components]
    model = Whitening(n, sums, svd.V.toArray()[:, : len(values)], values, float(total) / n**3, 0.0)
    white = written(distinct.select(described(F.col("x"), n, sums, model.onto())["w"].alias("w")), "whitening-check")
    means = white.agg(*[F.avg(F.get("w", F.lit(i))) for i in range(len(values))]).first()
    centred = F.zip_with("w", F.array(*[F.lit(m) for m in means]), lambda v, m: v - m)
    covariance = _matrix(white, centred).computeGramianMatrix().toArray() / n
    model.identity_error = float(np.abs(covariance - np.eye(len(values))).max())
    return model


def whiten(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for every row of
    table (vec_id, embedding) and each component, fitted on the distinct vectors.

    Rows whose vector is null, empty, or holds a null or non-finite entry have no result. Entries
    beyond 2^46 in magnitude count as that. Rows that repeat repeat here and count once in the fit;
    equal eigenvalues come in MLlib's order. A deviation beyond a long is an error. An empty table, or one of equal vectors only, has no
    component and gives an empty result, and a component without variance is left out. Vectors of
    unequal length are a ValueError. A null vec_id stays null; other columns are not read."""
    rows = table.select("vec_id", whole("embedding").alias("x")).where("x IS NOT NULL")
    model = fit(rows, components)
    if model is None:
        kind = rows.schema["vec_id"].dataType.simpleString()
        return table.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    out = rows.select("vec_id", described(F.col("x"), model.n, model.sums, model.onto()).alias("d"))
    out = out.select("vec_id", F.col("d.deviation").cast("long").alias("deviation"), F.posexplode("d.w").alias("at", "whitened"))
    explained = F.element_at(F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues]), F.col("at") + 1)
    return out.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
