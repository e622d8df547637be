"""Smoothed and binned age distributions in long form.

A distribution is a set of rows (keys, age, mass). Smoothing scatters every age over the kernel, reflecting at
the edges (1 and the largest age), which equals a symmetric filter because the kernel is symmetric. Binning
and cumulating follow as a partial aggregation and a window over at most a few bins per key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kernel(half: int = 3, variance: float = 1.0) -> list[float]:
    """Weights at -half .. half; the distance is divided by the variance itself, as the model's numbers rest on it."""
    w = [math.exp(-0.5 * (k / variance) ** 2) for k in range(-half, half + 1)]
    total = sum(w)
    return [x / total for x in w]


@dataclass(frozen=True)
class AgeBins:
    """Upper edges of the bins; an age equal to an edge belongs to the next bin. An open last bin takes the rest."""

    edges: tuple[int, ...] = (5, 10, 20, 40, 60, 80)
    last_open: bool = True

    def __post_init__(self) -> None:
        if len(self.edges) < (1 if self.last_open else 2) or list(self.edges) != sorted(set(self.edges)):
            raise ValueError("bins need ascending edges: one at least, two if the last bin is closed")

    @property
    def count(self) -> int:
        return len(self.edges) + self.last_open

    @property
    def widths(self) -> list[int]:
        """Widths of all bins but the last."""
        all_widths = [b - a for a, b in zip((0, *self.edges[:-1]), self.edges, strict=True)]
        return all_widths if self.last_open else all_widths[:-1]

    def of(self, age: Column) -> Column:
        """1-based bin of an age; null beyond a closed last bin."""
        b = F.lit(1)
        for e in self.edges:
            b = b + (age >= e).cast("int")
        return b if self.last_open else F.when(b <= self.count, b)


@dataclass(frozen=True)
class LossParams:
    bins: AgeBins = field(default_factory=AgeBins)
    half: int = 1
    variance: float = 1.0
    lam: float = 1e-2
    eps: float = 1e-7


def histogram(df: DataFrame, keys: Sequence[str], age: str = "age_calc", mass: str = "agb_sum") -> DataFrame:
    """(keys, age, mass) summed per age."""
    return df.groupBy(*keys, F.col(age).alias("age")).agg(F.sum(mass).alias("mass"))


def smooth(hist: DataFrame, keys: Sequence[str], weights: Sequence[float], top: Column | int | None) -> DataFrame:
    """Scatter every age over the kernel. ``top`` is the largest age; None: nothing reflects there."""
    h = len(weights) // 2
    spread = F.explode(F.array(*(F.struct(F.lit(k - h).alias("k"), F.lit(w).alias("w")) for k, w in enumerate(weights))))
    at = F.col("age") + F.col("e.k")
    at = F.when(at < 1, 1 - at).otherwise(at)
    if top is not None:
        limit = F.lit(top) if isinstance(top, int) else top
        at = F.when(at > limit, 2 * limit + 1 - at).otherwise(at)
    return hist.withColumn("e", spread).groupBy(*keys, at.alias("age")).agg(F.sum(F.col("mass") * F.col("e.w")).alias("mass"))


def binned(dist: DataFrame, keys: Sequence[str], bins: AgeBins) -> DataFrame:
    """(keys, bin, mass) of the occupied bins."""
    return dist.groupBy(*keys, bins.of(F.col("age")).alias("bin")).agg(F.sum("mass").alias("mass")).filter("bin is not null")


def cdf_rows(bin_mass: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, bin, cdf) over the occupied bins; 0 where a distribution has no mass."""
    w = Window.partitionBy(*keys)
    cum = F.sum("mass").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("mass").over(w)
    return bin_mass.select(*keys, "bin", F.when(total > 0, cum / total).otherwise(F.lit(0.0)).alias("cdf"))


def cdf_array(df: DataFrame, keys: Sequence[str], params: LossParams, top: Column | int | None, age: str = "age_calc", mass: str = "agb_sum", more: Sequence[Column] = ()) -> DataFrame:
    """(keys, mass, cdf, occupied): total mass, the dense distribution over all bins as an array, and which bins any age
    reaches; ``more`` are further aggregates.

    Smoothing and binning are linear, so every row adds its share to one column per bin: a single partial
    aggregation replaces the chain of scatter, group and window.
    """
    h, weights = params.half, kernel(params.half, params.variance)
    a = F.col(age)
    parts = []
    for k, w in enumerate(weights):
        at = a + (k - h)
        at = F.when(at < 1, 1 - at).otherwise(at)
        if top is not None:
            limit = F.lit(top) if isinstance(top, int) else top
            at = F.when(at > limit, 2 * limit + 1 - at).otherwise(at)
        parts.append((params.bins.of(at), w))
    sums = [F.sum(F.col(mass) * sum((F.when(b == i, F.lit(w)).otherwise(0.0) for b, w in parts), F.lit(0.0))).alias(f"_b{i}") for i in range(1, params.bins.count + 1)]
    reached = [F.max(reduce(lambda x, y: x | y, [F.coalesce(b == i, F.lit(False)) for b, _ in parts])).alias(f"_o{i}") for i in range(1, params.bins.count + 1)]
    g = df.groupBy(*keys).agg(F.sum(mass).alias("mass"), *sums, *reached, *more)
    others = g.columns[len(keys) + 1 + 2 * params.bins.count :]
    total = sum((F.col(f"_b{i}") for i in range(1, params.bins.count + 1)), F.lit(0.0))
    cum, so_far = [], F.lit(0.0)
    for i in range(1, params.bins.count + 1):
        so_far = so_far + F.col(f"_b{i}")
        cum.append(F.when(total > 0, so_far / total).otherwise(F.lit(0.0)))
    return g.select(*keys, "mass", F.array(*cum).alias("cdf"), F.array(*(f"_o{i}" for i in range(1, params.bins.count + 1))).alias("occupied"), *others)


def occupied_rows(dense: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, bin, cdf) of the occupied bins of ``cdf_array``."""
    cells = F.arrays_zip("cdf", "occupied")
    return dense.select(*keys, F.posexplode(cells).alias("_at", "_c")).filter("_c.occupied").select(*keys, (F.col("_at") + 1).alias("bin"), F.col("_c.cdf").alias("cdf"))


def w1(p: str, q: str, bins: AgeBins) -> Column:
    """Wasserstein-1 distance of two dense distributions: widths times absolute differences, without the last bin."""
    out = F.lit(0.0)
    for i, width in enumerate(bins.widths):
        out = out + F.lit(float(width)) * F.abs(F.get(F.col(p), F.lit(i)) - F.get(F.col(q), F.lit(i)))
    return out


def bins_loss(p: str, q: str, params: LossParams) -> Column:
    """Distance of two distributions either of which may be missing or empty.

    W1 counts only if both have mass; if either has, the difference of the logarithms of their totals is added.
    """
    last = F.lit(params.bins.count - 1)
    a, b = (F.coalesce(F.get(F.col(c), last), F.lit(0.0)) for c in (p, q))
    a, b = (F.when(x > params.eps, x).otherwise(0.0) for x in (a, b))
    both, either = (a > params.eps) & (b > params.eps), (a > params.eps) | (b > params.eps)
    tag = params.lam * F.abs(F.log10(a + params.eps) - F.log10(b + params.eps))
    return F.when(both, w1(p, q, params.bins)).otherwise(0.0) + F.when(either, tag).otherwise(0.0)


def reference_distributions(splots: DataFrame, params: LossParams, top: int) -> DataFrame:
    """(plot_id, eco, sim_year, species_symbol_map, measdate, agb, cdf) of every measured species.

    If two measurements of a plot fall into the same year, the later one holds.
    """
    keys = ["plot_id", "eco", "measdate", "sim_year", "species_symbol_map"]
    per = cdf_array(splots, keys, params, top)
    return per.groupBy("plot_id", "eco", "sim_year", "species_symbol_map").agg(
        F.max("measdate").alias("measdate"), F.max_by("mass", "measdate").alias("agb"), F.max_by("cdf", "measdate").alias("cdf")
    )
