"""Scalar basis and activation functions as column expressions."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..core import vec


def swish(x: Column) -> Column:
    return x * vec.sigmoid(x)


def shifted_softplus(x: Column) -> Column:
    return vec.softplus(x) - math.log(2.0)


def time_encoding(t: Column, w: Sequence[float], b: Sequence[float]) -> list[Column]:
    """cos(w t + b)"""
    return [F.cos(t * float(a) + float(c)) for a, c in zip(w, b)]


def gaussian_smearing(d: Column, start: float, stop: float, num: int) -> list[Column]:
    """Radial basis at ``num`` even centres, width one spacing."""
    gap = (stop - start) / (num - 1)
    return [F.exp(-0.5 / gap ** 2 * (d - (start + k * gap)) * (d - (start + k * gap))) for k in range(num)]


def envelope(x: Column, exponent: int) -> Column:
    """Smooth polynomial cutoff on (0, 1]."""
    p = exponent + 1
    a, b, c = -(p + 1) * (p + 2) / 2, p * (p + 2.0), -p * (p + 1) / 2
    return 1 / x + a * F.pow(x, p - 1) + b * F.pow(x, p) + c * F.pow(x, p + 1)


def bessel_basis(d: Column, num: int, cutoff: float, exponent: int) -> list[Column]:
    """envelope(d/c) sin(n pi d/c), n = 1..num"""
    u = d / cutoff
    return [envelope(u, exponent) * F.sin(n * math.pi * u) for n in range(1, num + 1)]


def _bessel(n: int, x: float) -> float:
    """Spherical Bessel function by upward recurrence (n small, x not near 0)."""
    a, b = math.sin(x) / x, math.sin(x) / x ** 2 - math.cos(x) / x
    if n == 0:
        return a
    for k in range(1, n):
        a, b = b, (2 * k + 1) / x * b - a
    return b


def bessel_roots(orders: int, count: int) -> list[list[float]]:
    """First zeros of each order, bracketed by the previous order's and bisected."""
    zeros = [[math.pi * k for k in range(1, count + orders + 1)]]
    for n in range(1, orders):
        row = []
        for lo, hi in zip(zeros[-1], zeros[-1][1:]):
            for _ in range(80):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if _bessel(n, lo) * _bessel(n, mid) > 0 else (lo, mid)
            row.append((lo + hi) / 2)
        zeros.append(row)
    return [row[:count] for row in zeros]


def _bessel_col(n: int, x: Column) -> Column:
    a, b = F.sin(x) / x, F.sin(x) / (x * x) - F.cos(x) / x
    if n == 0:
        return a
    for k in range(1, n):
        a, b = b, (2 * k + 1) / x * b - a
    return b


def _legendre(n: int, z: Column) -> Column:
    a, b = F.lit(1.0), z
    if n == 0:
        return a
    for k in range(1, n):
        a, b = b, ((2 * k + 1) * z * b - k * a) / (k + 1)
    return b


def spherical_basis(u: Column, angle: Column, orders: int, radial: int, exponent: int) -> list[Column]:
    """envelope(u) * normalised j_l(z_ln u) * Y_l0(angle), l-major."""
    env, out = envelope(u, exponent), []
    for l, row in enumerate(bessel_roots(orders, radial)):
        y = math.sqrt((2 * l + 1) / (4 * math.pi)) * _legendre(l, F.cos(angle))
        for z in row:
            scale = 1 / math.sqrt(0.5 * _bessel(l + 1, z) ** 2)
            out.append(env * scale * _bessel_col(l, u * z) * y)
    return out
