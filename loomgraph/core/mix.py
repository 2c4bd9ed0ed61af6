"""Portable pseudo-random numbers from keys.

A value depends only on its keys and seed, so a lost task or a second read of the plan
draws the same numbers again (``rand()`` does not promise that after a re-partition),
and plain SQL can recompute them.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mersenne prime 2^31-1 and two published multipliers for it.
PRIME = 2147483647
MULTIPLIERS = (48271, 69621)


def mix(*keys: Column | str, seed: int = 0) -> Column:
    """Integer in [0, PRIME) from integer keys."""
    h = F.lit(seed + 7).cast("bigint")
    for key in keys:
        c = F.col(key) if isinstance(key, str) else key
        h = F.pmod((h + F.pmod(c.cast("bigint"), F.lit(PRIME))) * MULTIPLIERS[0] + 11, F.lit(PRIME))
        h = F.pmod(F.pmod(h * h, F.lit(PRIME)) + h * MULTIPLIERS[1], F.lit(PRIME))
    return h


def unit(*keys: Column | str, seed: int = 0) -> Column:
    """Float in (0, 1)."""
    return (mix(*keys, seed=seed) + 1).cast("double") / F.lit(float(PRIME + 1))


def mix_sql(*keys: str, seed: int = 0) -> str:
    h = str(seed + 7)
    for key in keys:
        h = f"((({h}) + (({key}) % {PRIME})) * {MULTIPLIERS[0]} + 11) % {PRIME}"
        h = (f"(list_transform([({h})::BIGINT], lambda h: "
             f"((h * h) % {PRIME} + h * {MULTIPLIERS[1]}) % {PRIME}))[1]")
    return f"({h})"


def unit_sql(*keys: str, seed: int = 0) -> str:
    return f"(({mix_sql(*keys, seed=seed)} + 1)::DOUBLE / {float(PRIME + 1)})"
