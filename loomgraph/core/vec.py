"""Expressions over ARRAY<DOUBLE> features.

Where the width is known the helpers unroll into scalar expressions, which stay inside
whole-stage code generation and aggregate map-side; otherwise higher-order functions.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parts(c: Column | str, dim: int) -> list[Column]:
    c = as_col(c)
    return [c[k] for k in range(dim)]


def pack(cols: Sequence[Column]) -> Column:
    return F.array(*[c.cast("double") for c in cols])


def add_all(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return add_all([x * y for x, y in zip(a, b)])


def norm2(a: Sequence[Column]) -> Column:
    return F.sqrt(add_all([x * x for x in a]))


def cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def angle(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """atan2(|a x b|, a . b)"""
    return F.atan2(norm2(cross(a, b)), dot(a, b))


def linear(x: Sequence[Column], weight: Sequence[Sequence[float]],
           bias: Sequence[float] | None = None) -> list[Column]:
    """x @ weight + bias with ``weight`` given as rows by input channel."""
    out = []
    for c in range(len(weight[0])):
        v = add_all([x[r] * F.lit(float(weight[r][c])) for r in range(len(weight))])
        out.append(v + F.lit(float(bias[c])) if bias is not None else v)
    return out


def reduce_vec(agg: Callable[[Column], Column], c: Column | str, dim: int) -> Column:
    return F.array(*[agg(p) for p in parts(c, dim)])


def width(df: DataFrame, c: str) -> int:
    """Feature width, read from one row."""
    row = df.select(F.size(c)).first()
    return 0 if row is None else int(row[0])


def array_dot(a: Column, b: Column) -> Column:
    """Dot product of arrays of unknown width."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def relu(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def leaky(c: Column, slope: float) -> Column:
    return F.when(c > 0, c).otherwise(c * slope)


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def softplus(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0)) + F.log1p(F.exp(-F.abs(c)))


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b, or ``empty`` where b is 0 or missing."""
    return F.coalesce(F.when(b != 0, a / b), F.lit(float(empty)))
