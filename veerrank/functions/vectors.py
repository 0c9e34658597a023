"""Vector arithmetic as Columns, in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _doubles(a: Column | str) -> Column:
    return F.transform(F.col(a) if isinstance(a, str) else a, lambda x: x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column | str, eps: float = 1e-12) -> Column:
    return F.transform(_doubles(a), lambda x: x / F.greatest(l2(a), F.lit(eps)))


def cosine(a: Column | str, b: Column | str, eps: float = 1e-8) -> Column:
    return dot(a, b) / F.greatest(l2(a) * l2(b), F.lit(eps))


def project(rows: list[list[float]] | np.ndarray):
    """Matrix times vector, normalised: a linear projection of a query's negative side, as an Arrow function of a vector column.

    The matrix is broadcast once (its size is that of the vectors' dimension squared, whatever the data); null vectors stay null, zero ones zero."""
    weight = SparkSession.active().sparkContext.broadcast(np.asarray(rows, np.float64))

    @F.pandas_udf("array<double>")
    def apply(vectors: pd.Series) -> pd.Series:
        there = vectors.notna().to_numpy()
        out = pd.Series([None] * len(vectors), dtype=object)
        if there.any():
            z = np.stack(vectors[there].to_numpy()).astype(np.float64) @ weight.value.T
            out[there] = pd.Series(list(z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)), index=out.index[there])
        return out

    return apply


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def softplus(x: Column, beta: float = 1.0) -> Column:
    """ln(1 + exp(beta x)) / beta in the form that does not overflow."""
    return relu(x) + F.log1p(F.exp(-F.abs(beta * x))) / beta


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
