"""Site trajectories: every site is an independent task unit, and its years run inside the task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from understory.functions.agecdf import LossParams, kernel
from understory.operators.kernel import Sites, Table
from understory.operators.params import MAX_PAIRS
from understory.operators.succession import Semantics
from understory.session import bounded_rows

#: Cohorts of a site at most: a site is simulated in one piece.
MAX_SITE = 500_000
OUT = "candidate int, year int, mapcode long, eco string, species string, seq long, age int, biomass double"


def parameter_table(params: DataFrame) -> Table:
    """The joined parameter rows on the driver: bounded by the reference lists, checked."""
    return Table.of([r.asDict() for r in bounded_rows(params, MAX_PAIRS, "the parameter table")])


def sites_of(cohorts: DataFrame, site: str, eco: str, species: str, age: str, sem: Semantics = Semantics(), bio: str = "bio") -> DataFrame:
    """(site, eco, seq, species, age, bio): initial cohorts numbered within their site in an explicit order."""
    w = Window.partitionBy(site).orderBy(age, species, bio)
    return cohorts.select(
        F.col(site).cast("long").alias("site"), F.col(eco).alias("eco"), F.row_number().over(w).cast("long").alias("seq"), F.col(species).alias("species"),
        (F.lit(1) if sem.seed_at_age_one else F.col(age)).cast("int").alias("age"), F.col(bio).cast("double").alias("bio"),
    )


def gathered(cohorts: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """One row per site with its cohorts as an array. A site holds at most one cohort per measured species and age;
    one of more than MAX_SITE cohorts is an error."""
    cells = F.struct("seq", "species", "age", "bio", *extra)
    sites = cohorts.groupBy("site", "eco").agg(F.sort_array(F.collect_list(cells)).alias("cohorts"))
    fits = F.when(F.size("cohorts") <= MAX_SITE, F.col("cohorts")).otherwise(F.raise_error(F.lit(f"a site holds more than {MAX_SITE} cohorts")).cast(sites.schema["cohorts"].dataType))
    return sites.withColumn("cohorts", fits)


def _places(x: pa.Array) -> tuple[np.ndarray, list]:
    """The values of a column as places in the list of its distinct values."""
    d = x.dictionary_encode(null_encoding="encode")
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def _rows(table: Table, eco: pa.Array, site: np.ndarray, species: pa.Array) -> np.ndarray:
    """The parameter row of every cohort, -1 without one; names are looked up once per distinct pair."""
    e, ecos = _places(eco)
    s, names = _places(species)
    pair, at = np.unique(e[site] * len(names) + s, return_inverse=True)
    rows = [table.row.get((ecos[k // len(names)], names[k % len(names)]), -1) for k in pair.tolist()]
    return np.array(rows, np.int64)[at] if len(pair) else np.empty(0, np.int64)


def _batch(s: Sites, candidate: int, year: int, at: np.ndarray | None = None) -> pa.RecordBatch:
    """The cohorts of all sites, or of those marked in ``at``."""
    eco, species = np.array(s.table.eco, object), np.array(s.table.species, object)
    order = np.lexsort((s.key, s.site))
    if at is not None:
        order = order[at[s.site[order]]]
    p = s.p[order]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(p), candidate, np.int32)), pa.array(np.full(len(p), year, np.int32)), pa.array(s.ids[s.site[order]]), pa.array(eco[p], pa.string()), pa.array(species[p], pa.string()), pa.array(s.key[order]), pa.array(s.age[order].astype(np.int32)), pa.array(s.bio[order])],
        ["candidate", "year", "mapcode", "eco", "species", "seq", "age", "biomass"],
    )


def with_years(sites: DataFrame, compared: DataFrame) -> DataFrame:
    """``gathered`` sites with the array of their years in ``compared`` (site, year); a site without any is dropped."""
    return sites.join(compared.groupBy("site").agg(F.sort_array(F.collect_set("year")).alias("years")), "site")


def with_truth(sites: DataFrame, reference: DataFrame) -> DataFrame:
    """``with_years`` of the measured years of ``reference`` (site, year, species, agb, cdf), which is kept beside them."""
    per = reference.groupBy("site").agg(F.sort_array(F.collect_set("year")).alias("years"), F.collect_list(F.struct("year", "species", "agb", "cdf")).alias("truth"))
    return sites.join(per, "site")


def _due(b: pa.RecordBatch) -> dict[int, np.ndarray]:
    """Which sites of a batch each year is wanted of."""
    lists = b.column("years")
    site, year = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
    due = {int(y): np.zeros(b.num_rows, bool) for y in np.unique(year)}
    for y, at in due.items():
        at[site[year == y]] = True
    return due


def _trajectories(b: pa.RecordBatch, tables: Sequence[Table], years: Sequence[int], seed: int, sem: Semantics, wanted: set[int], own: bool, spin: tuple[int, int] | None = None) -> Iterator[tuple[int, int, Sites, np.ndarray | None]]:
    """(candidate, year, the sites after that year, which of them are wanted) for a batch of gathered sites."""
    ids, lists = b.column("site").to_numpy(), b.column("cohorts")
    cell = lists.flatten()
    site = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
    age, bio, seq = (cell.field(n).to_numpy() for n in ("age", "bio", "seq"))
    due = {y: at for y, at in _due(b).items() if y in wanted} if own else dict.fromkeys(wanted)
    for c, table in enumerate(tables):
        p = _rows(table, b.column("eco"), site, cell.field("species"))
        ok = p >= 0
        if spin:
            s = Sites(ids, table, *(np.empty(0, np.int64),) * 3, np.empty(0), np.empty(0, np.int64), seed, sem)
            s.spin_up(site[ok], p[ok], cell.field("year_deficit").to_numpy()[ok], *spin)
            yield c, -1, s, None
        else:
            s = Sites(ids, table, site[ok], p[ok], age[ok], bio[ok], seq[ok], seed, sem)
        for y in years:
            if own and y > max(due, default=-1):
                break
            s.step(y)
            if y in due:
                yield c, y, s, due[y]


def run(sites: DataFrame, tables: Sequence[Table], years: Sequence[int], seed: int, sem: Semantics = Semantics(), keep: Sequence[int] | None = None, spin: tuple[int, int] | None = None) -> DataFrame:
    """Simulate ``gathered`` sites through ``years``, once per parameter table (candidate).

    Rows of every year, or of those in ``keep``, are sent on year by year. Cohorts without parameters are
    dropped. Sites ``with_years`` send their own years only, and a batch ends with the last of them; the states
    of those years are the same. With ``spin`` = (first, last) the array holds spin-up cohorts with ``year_deficit`` instead of
    initial ones, and the state at the end of the spin-up comes out as year -1.
    """
    wanted = set(years if keep is None else keep)
    own = "years" in sites.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                for c, y, s, at in _trajectories(b, tables, years, seed, sem, wanted, own, spin):
                    yield _batch(s, c, y, at)

    return sites.select("site", "eco", "cohorts", *["years"] * own).mapInArrow(work, OUT)


# ---------------------------------------------------------------- scoring where the sites are

def distributions(s: Sites, at: np.ndarray | None, params: LossParams, sem: Semantics) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(site, parameter row, agb, cdf) of every species of the marked sites: ``loss.simulated_distributions`` as arrays."""
    order = np.lexsort((s.key, s.age, s.p, s.site))
    order = order if at is None else order[at[s.site[order]]]
    site, p, age, bio = s.site[order], s.p[order], s.age[order], s.bio[order]
    if not len(order):
        return site, p, bio, np.empty((0, params.bins.count))
    new = np.append(True, (site[1:] != site[:-1]) | (p[1:] != p[:-1]))
    first = np.flatnonzero(new)
    agb = np.add.reduceat(bio, first)
    fresh = new.copy()
    fresh[1:] |= age[1:] != age[:-1]
    begins = np.flatnonzero(fresh)
    mass = bio[np.append(begins[1:], len(bio)) - 1] if sem.last_cohort_of_an_age_wins else np.add.reduceat(bio, begins)
    of, ages, k = (np.cumsum(new) - 1)[begins], age[begins], params.bins.count
    hist = np.zeros(len(first) * k)
    for j, w in enumerate(kernel(params.half, params.variance)):
        a = ages + (j - params.half)
        bin_ = np.searchsorted(params.bins.edges, np.where(a < 1, 1 - a, a), side="right")
        ok = bin_ < k
        hist += np.bincount(of[ok] * k + bin_[ok], weights=mass[ok] * w, minlength=len(hist))
    hist = hist.reshape(-1, k)
    total = hist.sum(1, keepdims=True)
    return site[first], p[first], agb, np.where(total > 0, np.cumsum(hist, 1) / np.where(total > 0, total, 1.0), 0.0)


class _Truth:
    """The measured distributions of a batch of sites, sorted by (year, site, species)."""

    def __init__(self, b: pa.RecordBatch, tables: Sequence[Table], bins: int) -> None:
        lists = b.column("truth")
        cell = lists.flatten()
        code, names = _places(cell.field("species"))
        known = {x: i for i, x in enumerate(names)}
        self.codes = [np.array([known.setdefault(x, len(known)) for x in t.species], np.int64) for t in tables]
        self.names, self.n = np.array(list(known), object), len(known)
        site = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
        year = cell.field("year").to_numpy()
        order = np.lexsort((code, site, year))
        self.year, self.key = year[order], (site * self.n + code)[order]
        self.agb = cell.field("agb").to_numpy()[order]
        self.cdf = cell.field("cdf").flatten().to_numpy().reshape(-1, bins)[order]

    def compare(self, c: int, y: int, s: Sites, at: np.ndarray, params: LossParams, sem: Semantics) -> tuple[np.ndarray, ...]:
        """(site and species, w_loss, agb_loss, signed) of a year: the arithmetic of ``loss.species_loss``."""
        site, p, sim, cdf = distributions(s, at, params, sem)
        lo, hi = np.searchsorted(self.year, [y, y + 1])
        key, ref = self.key[lo:hi], self.agb[lo:hi]
        own = site * self.n + self.codes[c][p]
        order = np.argsort(own, kind="stable")
        own, sim, cdf = own[order], sim[order], cdf[order]
        place = np.searchsorted(key, own)
        met = (key[np.minimum(place, len(key) - 1)] == own) if len(key) else np.zeros(len(own), bool)
        partner = np.minimum(place, max(len(key) - 1, 0))
        lone = np.ones(len(key), bool)
        lone[place[met]] = False
        log = lambda x: np.log10(x + params.eps)
        measured = np.where(met, ref[partner], 0.0) if len(key) else np.zeros(len(own))
        far = np.abs(cdf - self.cdf[lo:hi][partner])[:, : len(params.bins.widths)] @ np.array(params.bins.widths, float) if len(key) else np.zeros(len(own))
        w = np.where(met, (1 + far) * (log(sim) - log(measured)) ** 2, log(sim) ** 2)
        return (
            np.concatenate([own, key[lone]]), np.concatenate([w, params.lam * np.abs(log(ref[lone]))]),
            np.concatenate([np.abs(sim - measured), ref[lone]]), np.concatenate([sim - measured, -ref[lone]]),
        )


def losses(sites: DataFrame, tables: Sequence[Table], years: Sequence[int], params: LossParams, seed: int, sem: Semantics = Semantics(), by_species: bool = False) -> DataFrame:
    """Simulate sites ``with_truth`` and score them where they are, in one pass: only losses leave the task.

    (candidate, site, year, w_loss, agb_loss, site_agb_loss) of every measured year of every site, or per species
    (candidate, site, year, species, w_loss, agb_loss, signed); the values of ``loss.site_loss`` and ``loss.species_loss``.
    """
    wanted = set(years)
    last = "species string, w_loss double, agb_loss double, signed double" if by_species else "w_loss double, agb_loss double, site_agb_loss double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            truth = _Truth(b, tables, params.bins.count)
            for c, y, s, at in _trajectories(b, tables, years, seed, sem, wanted, True):
                key, *values = truth.compare(c, y, s, at, params, sem)
                where = key // truth.n
                if by_species:
                    out = [pa.array(truth.names[key % truth.n], pa.string()), *map(pa.array, values)]
                else:
                    where = np.flatnonzero(at)
                    w, agb, signed = (np.bincount(key // truth.n, weights=x, minlength=b.num_rows)[where].astype(float) for x in values)
                    out = [pa.array(w), pa.array(agb), pa.array(np.abs(signed))]
                head = [pa.array(np.full(len(where), c, np.int32)), pa.array(s.ids[where]), pa.array(np.full(len(where), y, np.int32))]
                yield pa.RecordBatch.from_arrays([*head, *out], [x.split()[0] for x in schema.split(", ")])

    schema = f"candidate int, site long, year int, {last}"
    return sites.select("site", "eco", "cohorts", "years", "truth").mapInArrow(work, schema)
