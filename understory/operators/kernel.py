"""The succession kernel over many sites at once: flat cohort arrays, sums per site by bincount.

No year barrier and no shuffle: a batch of sites runs through all its years inside one task. Results depend
on (seed, site, year, cohort) only, never on the batch a site is in.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from understory.functions.rng import ESTABLISHMENT, LIGHT, MORTALITY, uniform_np
from understory.operators.params import LIGHT as LIGHT_TABLE
from understory.operators.succession import ACTIVE_AGE, FIRST, HALF, NEW_KEY, SENESCENT, SPREAD, Semantics

_LIGHT = np.array(LIGHT_TABLE)


def added_key(year: int, local: np.ndarray) -> np.ndarray:
    """Keys of the cohorts that reproduction adds in a year."""
    if not -FIRST <= year < FIRST:
        raise ValueError(f"year {year} has no key")
    return NEW_KEY + (year + FIRST) * SPREAD + local


@dataclass
class Table:
    """Parameters per (eco, species) row and per eco, as arrays; ``row`` finds the row of a pair.

    ``spinup_mortality`` is that of a parameter set; None: that of the semantics.
    """

    eco: list[str]
    species: list[str]
    local: np.ndarray
    values: dict[str, np.ndarray]
    row: dict[tuple[str, str], int]
    spinup_mortality: float | None = None

    @classmethod
    def of(cls, rows: list[dict]) -> Table:
        rows = sorted(rows, key=lambda r: (r["eco"], r["species"]))
        names = ("d", "s", "longevity", "shade_tol", "maturity", "b_max", "anpp_max", "prob_mort", "prob_estab", "b_max_eco", "r1", "r2", "r3", "r4", "r5")
        values = {n: np.array([r[n] for r in rows], float) for n in names}
        if any(not 0 < r["local_id"] < HALF for r in rows):
            raise ValueError(f"local ids of an ecoregion must lie between 1 and {HALF - 1}")
        return cls([r["eco"] for r in rows], [r["species"] for r in rows], np.array([r["local_id"] for r in rows], np.int64), values, {(r["eco"], r["species"]): i for i, r in enumerate(rows)})


class Sites:
    """A batch of sites. ``site`` is the place of a cohort's site in ``ids``; ``p`` its parameter row."""

    def __init__(self, ids: np.ndarray, table: Table, site: np.ndarray, p: np.ndarray, age: np.ndarray, bio: np.ndarray, key: np.ndarray, seed: int, sem: Semantics) -> None:
        self.ids, self.table, self.seed, self.sem = ids, table, seed, sem
        self.site, self.p, self.age, self.bio, self.key = site, p, age.astype(np.int64), bio.astype(float), key.astype(np.int64)
        if len(self.key) and self.key.max() >= NEW_KEY:
            raise ValueError("initial cohorts are numbered beyond the keys of added ones")
        self.prev = np.zeros(len(ids))
        self.b = np.zeros(len(ids))
        self.agnpp = np.zeros(len(ids))
        self.shade = np.ones(len(ids), np.int64)
        self.old = np.zeros(len(ids), np.int64)

    def _sum(self, x: np.ndarray, site: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.site if site is None else site, weights=x, minlength=len(self.ids)).astype(float)

    def add(self, site: np.ndarray, p: np.ndarray, age: np.ndarray, bio: np.ndarray, key: np.ndarray) -> None:
        self.site, self.p, self.age = np.concatenate([self.site, site]), np.concatenate([self.p, p]), np.concatenate([self.age, age])
        self.bio, self.key = np.concatenate([self.bio, bio]), np.concatenate([self.key, key])

    def new_biomass(self, anpp: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        factor = np.exp(-1.6 * b / most)
        return np.maximum(2.0, anpp * (np.maximum(1.0, factor) if self.sem.new_biomass_at_least_anpp else factor))

    def step(self, year: int) -> None:
        """Succession, then reproduction."""
        v = {k: x[self.p] for k, x in self.table.values.items()}
        sem, site, bio = self.sem, self.site, self.bio
        spin = sem.spinup_mortality if self.table.spinup_mortality is None else self.table.spinup_mortality
        age = self.age + 1
        comp = np.maximum(bio**0.95, 1.0)
        b_all, c_all = self._sum(bio)[site], self._sum(comp)[site]
        f = np.exp(v["d"] * (age / v["longevity"] - 1)) + (spin if year <= 0 else 0.0)
        u = uniform_np(self.seed, self.ids[site], year, self.key, MORTALITY)
        m_age = np.where((age < v["longevity"]) & (u > v["prob_mort"]) & (f < 1), bio * f, bio)
        b_pot = np.maximum(v["b_max"] * sem.capacity_reduction - b_all - (bio if sem.own_biomass_counts_twice else 0.0), 1.0)
        if sem.capacity_reduction >= 1:
            b_pot = np.maximum(b_pot, self.prev[site])
        b_ap = bio / b_pot
        x = b_ap ** v["s"]
        keep = 1 - sem.growth_reduction if sem.growth_reduction > 0 else 1.0
        most = v["anpp_max"] * comp / c_all
        growth = np.minimum(x * np.exp(1 - x), 1.0) * most * keep
        m = np.where(most <= 1, most * 2 * b_ap / (1 + b_ap), most)
        anpp = np.maximum(growth - m_age, 1.0)
        m_bio = np.maximum(np.minimum(m, bio) * keep - m_age, 0.0)
        m_bio = np.maximum(m_bio, anpp) if sem.growth_mortality_at_least_growth else np.minimum(m_bio, anpp)
        m_tot = m_age + m_bio
        new = bio + anpp - m_tot
        lives = new > SENESCENT
        mature = age >= v["maturity"]
        live = np.bincount(site[lives], minlength=len(self.ids))
        b_act = self._sum(np.where(lives & (age > ACTIVE_AGE), new, 0.0))
        eco_most = np.full(len(self.ids), 1.0)
        eco_most[site] = v["b_max_eco"]
        share = np.minimum(b_act, eco_most - self.prev) / eco_most
        shade = np.zeros(len(self.ids), np.int64)
        for k in range(1, 6):
            limit = np.full(len(self.ids), np.inf)
            limit[site] = v[f"r{k}"]
            shade += share > limit
        had = np.bincount(site, minlength=len(self.ids)) > 0
        self.shade = np.where(had, shade, self.shade)
        self.agnpp = self._sum(growth)
        self.b = self._sum(np.where(lives, new, 0.0))
        self.prev = np.where(had, self._sum(m_tot), self.prev)
        self.old = live
        seeds_site, seeds_p = site[mature], self.p[mature]
        self.site, self.p, self.age, self.bio, self.key = site[lives], self.p[lives], age[lives], new[lives], self.key[lives]
        self._reproduce(year, seeds_site, seeds_p, live)

    def _reproduce(self, year: int, site: np.ndarray, p: np.ndarray, live: np.ndarray) -> None:
        pairs = np.unique(np.stack([site, p], 1)[live[site] > 0], axis=0) if len(site) else np.empty((0, 2), np.int64)
        site, p = pairs[:, 0], pairs[:, 1]
        v, local = self.table.values, self.table.local[p]
        light = uniform_np(self.seed, self.ids[site], year, local, LIGHT) <= _LIGHT[self.shade[site], v["shade_tol"][p].astype(int) - 1]
        settles = uniform_np(self.seed, self.ids[site], year, local, ESTABLISHMENT) <= v["prob_estab"][p]
        at = np.flatnonzero(light & settles)
        site, p, local = site[at], p[at], local[at]
        if not len(at):
            return
        if self.sem.new_biomass_at_least_anpp:
            bio = self.new_biomass(v["anpp_max"][p], self.b[site], v["b_max_eco"][p])
            self.b += self._sum(bio, site)
        else:  # species by species: each finds the site with those before it
            bio = np.empty(len(at))
            nth = np.arange(len(at)) - np.searchsorted(site, site)
            for k in range(int(nth.max()) + 1):
                i = np.flatnonzero(nth == k)
                bio[i] = self.new_biomass(v["anpp_max"][p[i]], self.b[site[i]], v["b_max_eco"][p[i]])
                self.b += self._sum(bio[i], site[i])
        self.add(site, p, np.ones(len(at), np.int64), bio, added_key(year, local))

    def spin_up(self, site: np.ndarray, p: np.ndarray, year_deficit: np.ndarray, first: int, last: int) -> None:
        """Bring sites from the earliest establishment to year -1.

        Cohorts that were established in year d are of age 1 in year d + 1; ``first`` and ``last`` are the
        earliest and latest such years of all sites. A species that just got a young cohort gets no second one.
        """
        order = np.argsort(year_deficit, kind="stable")
        site, p, due = site[order], p[order], year_deficit[order] + 1
        for t in range(first, last + 1):
            i = np.flatnonzero(due == t)
            if len(i):
                s, q = site[i], p[i]
                _, keep = np.unique(np.stack([s, q], 1), axis=0, return_index=True)
                s, q = s[np.sort(keep)], q[np.sort(keep)]
                base = int(added_key(t - 1, np.int64(0)))
                young = (self.key >= base) & (self.key < base + HALF)  # those of last year's reproduction
                n = len(self.table.species)
                fresh = ~np.isin(s * n + q, self.site[young] * n + self.p[young])
                s, q = s[fresh], q[fresh]
                bio = self.new_biomass(self.table.values["b_max"][q], self.b[s], self.table.values["b_max_eco"][q])
                self.add(s, q, np.ones(len(s), np.int64), bio, added_key(t, HALF + self.table.local[q]))
            if t < last:
                self.step(t)
