"""Uniform numbers that depend on their place only: the same for any partitioning, retry and engine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

P = 2147483647
_SITE, _YEAR, _KEY, _PURPOSE, _MULTIPLIER, _STEP = 73856093, 19349663, 83492791, 2654435, 48271, 11
MORTALITY, LIGHT, ESTABLISHMENT = 1, 2, 3


def uniform_sql(seed: int, site: str, year: str, key: str, purpose: int) -> str:
    """The number as SQL text; ``site`` below 10**10, all BIGINT."""
    h = f"(({seed} + CAST({site} AS BIGINT) * {_SITE} + CAST({year} AS BIGINT) * {_YEAR} + CAST({key} AS BIGINT) * {_KEY} + {purpose * _PURPOSE}) % {P})"
    for _ in range(3):
        h = f"(({h} * {h} + {_MULTIPLIER} * {h} + {_STEP}) % {P})"
    return f"({h} / CAST({P} AS DOUBLE))"


def uniform(seed: int, site: str | Column, year: Column | int, key: str | Column, purpose: int) -> Column:
    col = lambda c: (F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)).cast("long")
    h = F.pmod(F.lit(seed).cast("long") + col(site) * _SITE + col(year) * _YEAR + col(key) * _KEY + F.lit(purpose * _PURPOSE), F.lit(P))
    for _ in range(3):  # eight copies of the first line, which codegen computes once
        h = F.pmod(h * h + h * _MULTIPLIER + _STEP, F.lit(P))
    return h / F.lit(float(P))


def uniform_np(seed: int, site: np.ndarray, year: int, key: np.ndarray, purpose: int) -> np.ndarray:
    h = (seed + site.astype(np.int64) * _SITE + year * _YEAR + key.astype(np.int64) * _KEY + purpose * _PURPOSE) % P
    for _ in range(3):
        h = (h * h + _MULTIPLIER * h + _STEP) % P
    return h / float(P)
