"""Vector scores over array columns, in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if either is all zero, null if a value is null, an error if their lengths differ."""
    norm = F.sqrt(_dot(a, a) * _dot(b, b))
    value = F.when(norm == 0, F.lit(0.0)).otherwise(_dot(a, b) / norm)
    return F.when(F.size(a) == F.size(b), value).when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("vectors of different lengths")).cast("double"))


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays; null and length rules as for the cosine."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    value = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))
    return F.when(F.size(a) == F.size(b), value).when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("vectors of different lengths")).cast("double"))


def cosine_to_distance(score: Column) -> Column:
    return F.lit(1.0) - score


def distance_to_score(distance: Column) -> Column:
    """Score of an L2 distance: 1 for equal vectors, towards 0 with growing distance."""
    return F.lit(1.0) / (F.lit(1.0) + distance)


def usable(vector: Column) -> Column:
    """Non-null, not empty, all values present and finite."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))


def from_bytes(blob: Column) -> Column:
    """Little-endian float32 bytes as array<float>; null unless the length is a multiple of 4."""
    @F.pandas_udf("array<float>")
    def decode(values: pd.Series) -> pd.Series:
        return values.map(lambda b: np.frombuffer(b, "<f4").tolist() if b is not None and len(b) % 4 == 0 else None)

    return decode(blob)


def to_bytes(vector: Column) -> Column:
    @F.pandas_udf("binary")
    def encode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: np.asarray(v, "<f4").tobytes() if v is not None else None)

    return encode(vector)
