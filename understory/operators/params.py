"""Model parameters: relational tables, priors and mutation."""

from __future__ import annotations

import copy
import json
from bisect import bisect_right
from dataclasses import asdict, dataclass, field
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from understory.schemas import ECO_PARAMS, ECO_SPECIES_PARAMS
from understory.session import bounded_rows

# Chance of sufficient light by shade class 0 to 5 (rows) and shade tolerance 1 to 5 (columns).
LIGHT = (
    (1.0, 1.0, 1.0, 1.0, 1.0),
    (0.5, 1.0, 1.0, 1.0, 1.0),
    (0.25, 0.5, 1.0, 1.0, 1.0),
    (0.0, 0.25, 0.5, 1.0, 1.0),
    (0.0, 0.0, 0.25, 0.5, 1.0),
    (0.0, 0.0, 0.0, 0.25, 0.5),
)
#: Parameter sets are small: species lists times ecoregion lists.
MAX_PAIRS = 200_000


@dataclass(frozen=True)
class Prior:
    """A parameter: its kind of distribution, bounds and what it varies with."""

    name: str
    low: float
    high: float
    mean: float | None = None
    sd: float | None = None
    whole: bool = False
    by_species: bool = False
    by_eco: bool = False

    def draw(self, rng: np.random.Generator, size: int | None = None):
        u = rng.random(size)
        if self.whole:
            x = np.floor(self.low + u * (self.high - self.low + 1))
        elif self.mean is None:
            x = self.low + u * (self.high - self.low)
        else:
            n = NormalDist(self.mean, self.sd)
            a, b = n.cdf(self.low), n.cdf(self.high)
            x = np.vectorize(lambda p: n.inv_cdf(min(max(p, 1e-12), 1 - 1e-12)))(a + u * (b - a))
            x = np.clip(x, self.low, self.high)
        return float(x) if size is None else x


# The priors of the calibrated parameters.
PRIORS = (
    Prior("spinup_mortality", 0.0, 0.20),
    Prior("s", 0.01, 1.0, 0.5, 1.0, by_species=True),
    Prior("d", 5, 25, 15, 10, by_species=True),
    Prior("longevity", 100, 300, 200, 100, by_species=True),
    Prior("shade_tol", 1, 5, whole=True, by_species=True),
    Prior("maturity", 3, 40, whole=True, by_species=True),
    Prior("prob_mort", 0.0, 1.0, by_species=True, by_eco=True),
    Prior("prob_estab", 0.0, 1.0, by_species=True, by_eco=True),
    Prior("anpp_max", 2400, 2500, 2500, 100, by_species=True, by_eco=True),
    Prior("b_max", 2400, 2500, 2500, 100, by_species=True, by_eco=True),
    Prior("first_min_rel", 0.0, 0.5, by_eco=True),
)
BASE_WEIGHT, MIN_REL_STEP = 15, 0.1


@dataclass
class Params:
    """One parameter set: values by species, by ecoregion and by their listed pairs."""

    species: list[str]
    ecos: list[str]
    pairs: list[tuple[int, int]]  # (eco, species) places, sorted
    values: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def draw(cls, eco_species: DataFrame, seed: int) -> Params:
        """Draw from the priors for the distinct (eco, species) of a table."""
        rows = bounded_rows(eco_species.select("eco", "species").distinct(), MAX_PAIRS, "the parameter table")
        ecos, species = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
        e, s = {x: i for i, x in enumerate(ecos)}, {x: i for i, x in enumerate(species)}
        p = cls(species, ecos, sorted((e[r[0]], s[r[1]]) for r in rows))
        rng = np.random.default_rng(seed)
        p.values = {q.name: np.asarray(q.draw(rng, p.size(q))) for q in PRIORS}
        p.values["spinup_mortality"] = np.array([0.15])
        return p

    def size(self, q: Prior) -> int:
        return len(self.pairs) if q.by_species and q.by_eco else len(self.species) if q.by_species else len(self.ecos) if q.by_eco else 1

    def mutate(self, rng: np.random.Generator) -> Params:
        """A copy with one element of one parameter drawn anew; parameters with more elements are chosen more often.

        The weights are those of the parameters themselves (no shift by one), and every parameter can be chosen.
        """
        weights = np.cumsum([BASE_WEIGHT + self.size(q) for q in PRIORS])
        q = PRIORS[bisect_right(weights / weights[-1], rng.random())]
        new = Params(self.species, self.ecos, self.pairs, dict(self.values))
        if q.by_species and q.by_eco:  # first the ecoregion, then one of its species
            eco = int(rng.integers(len(self.ecos)))
            own = [i for i, (e, _) in enumerate(self.pairs) if e == eco]
            at = own[int(rng.integers(len(own)))]
        else:
            at = int(rng.integers(self.size(q)))
        changed = copy.copy(self.values[q.name])
        changed[at] = q.draw(rng)
        new.values[q.name] = changed
        return new

    def rows(self) -> list[dict]:
        """Per (eco, species) the values of both, in the order of the columns of ``eco_params``."""
        v, out, local, most = self.values, [], {}, {}
        for i, (e, _) in enumerate(self.pairs):
            most[e] = max(most.get(e, 0.0), float(v["b_max"][i]))
        for i, (e, s) in enumerate(self.pairs):
            local[e] = local.get(e, 0) + 1
            row = {"eco": self.ecos[e], "species": self.species[s], "local_id": local[e]}
            row |= {n: float(v[n][s]) for n in ("d", "s")} | {n: int(v[n][s]) for n in ("longevity", "shade_tol", "maturity")}
            row |= {n: float(v[n][i]) for n in ("b_max", "anpp_max", "prob_mort", "prob_estab")}
            row |= {f"r{k + 1}": float(v["first_min_rel"][e]) + MIN_REL_STEP * k for k in range(5)} | {"b_max_eco": most[e]}
            out.append(row)
        return out

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """The parameters as relational tables: per (eco, species) and per eco."""
        rows = self.rows()
        shade = {r["eco"]: tuple(r[n] for n in ECO_PARAMS.names) for r in rows}
        return spark.createDataFrame([tuple(r[n] for n in ECO_SPECIES_PARAMS.names) for r in rows], ECO_SPECIES_PARAMS), spark.createDataFrame(list(shade.values()), ECO_PARAMS)

    def to_dict(self) -> dict:
        return asdict(self) | {"values": {k: x.tolist() for k, x in self.values.items()}}

    @classmethod
    def of_dict(cls, d: dict) -> Params:
        return cls(d["species"], d["ecos"], [tuple(p) for p in d["pairs"]], {k: np.array(x) for k, x in d["values"].items()})

    def to_json(self) -> str:
        return json.dumps(self.to_dict())

    @classmethod
    def from_json(cls, text: str) -> Params:
        return cls.of_dict(json.loads(text))


def eco_params(eco_species: DataFrame, eco_shade: DataFrame) -> DataFrame:
    """One row per (eco, species) with all that a site needs, the largest b_max of the ecoregion included."""
    most = eco_species.groupBy("eco").agg(F.max("b_max").alias("b_max_eco"))
    return eco_species.join(eco_shade.drop("b_max_eco"), "eco").join(most, "eco")


def eco_bmax(eco_species: DataFrame) -> DataFrame:
    return eco_species.groupBy("eco").agg(F.max("b_max").alias("b_max_eco"))
