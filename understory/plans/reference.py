"""Queries over the model's own operators, each beside the SQL that must give the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from understory.functions import agecdf as A
from understory.operators import cohorts as C
from understory.operators import crosswalk as X
from understory.operators import loss as L
from understory.operators import sinks, succession
from understory.operators.landscape import Landscape
from understory.operators.params import Params, eco_bmax, eco_params
from understory.operators.search import Schedule, calibrate, score_candidates
from understory.operators.simulate import gathered, losses, parameter_table, run, with_years
from understory.plans import fixture as fx
from understory.plans.fixture import PLOT, SEED, World, sql, step_ctes
from understory.plans.rounding import rounded, rounded_sql
from understory.schemas import PLOT_KEY
from understory.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
LOSS = A.LossParams()
MEASURED_AGES = succession.Semantics(seed_at_age_one=False)
KEYS = ["plot_id", "eco", "measdate", "sim_year", "species_symbol_map"]
KEY_SQL = ", ".join(KEYS)


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = rounded_sql(oracle)
        return f

    return add


# ---------------------------------------------------------------- scans, filters, projections

@query("SELECT eco, count(*) AS n, sum(tree_count) AS trees FROM data_eco_cohorts WHERE subp_has_dstrb = 'f' GROUP BY eco")
def scan_filter_undisturbed(spark, d):
    return C.undisturbed(table(spark, d, "data_eco_cohorts")).groupBy("eco").agg(F.count("*").alias("n"), F.sum("tree_count").alias("trees"))


@query("SELECT cohort_id, eco, plt_cn FROM data_eco_cohorts WHERE eco IN ('9.3.5.83a', '12.5.6.89a') AND subp_has_dstrb = 'f'")
def eco_inlist_filter(spark, d):
    return C.undisturbed(C.in_ecos(table(spark, d, "data_eco_cohorts"), ["9.3.5.83a", "12.5.6.89a"])).select("cohort_id", "eco", "plt_cn")


@query(sql("SELECT cohort_id, measdate, eco, species_symbol_map, age_calc, agb FROM coh", ["coh"]))
def valid_cohorts(spark, d):
    return fx.coh(spark, d).select("cohort_id", "measdate", "eco", "species_symbol_map", "age_calc", "agb")


@query("SELECT DISTINCT species_symbol_map FROM data_eco_cohorts")
def distinct_species(spark, d):
    return table(spark, d, "data_eco_cohorts").select("species_symbol_map").distinct()


@query("SELECT eco || '_' || coalesce(sftwd_hrdwd, '') AS catch_all, count(*) AS n FROM (SELECT coalesce(eco, '') AS eco, sftwd_hrdwd FROM data_eco_cohorts) t GROUP BY 1")
def catch_all_symbols(spark, d):
    symbol = F.concat(F.coalesce("eco", F.lit("")), F.lit("_"), F.coalesce("sftwd_hrdwd", F.lit("")))
    return table(spark, d, "data_eco_cohorts").groupBy(symbol.alias("catch_all")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- sums, first measurements, years

@query(sql("SELECT * REPLACE (round(agb_sum, 8) AS agb_sum) FROM sums", ["sums"]))
def plots_group_sum(spark, d):
    return rounded(C.group_sum(fx.coh(spark, d)), "agb_sum", digits=8)


_STARTS = sql(f"SELECT DISTINCT {PLOT}, plt_cn, measdate, start_measdate FROM coh JOIN starts USING ({PLOT})", ["coh", "starts"])


@query(_STARTS)
def start_measdate_window(spark, d):
    return C.with_start(fx.coh(spark, d)).select(*PLOT_KEY, "plt_cn", "measdate", "start_measdate").distinct()


@query(_STARTS)
def start_measdate_join(spark, d):
    return C.with_start_joined(fx.coh(spark, d)).select(*PLOT_KEY, "plt_cn", "measdate", "start_measdate").distinct()


_YEARS = f"{PLOT}, measdate, species_symbol_map, age_calc"


@query(sql(f"SELECT {_YEARS}, sim_year FROM splots", ["splots"]))
def sim_year(spark, d):
    return fx.splots(spark, d).select(*PLOT_KEY, "measdate", "species_symbol_map", "age_calc", "sim_year")


@query(sql(f"SELECT {_YEARS}, year_deficit FROM splots", ["splots"]))
def year_deficit(spark, d):
    return fx.splots(spark, d).select(*PLOT_KEY, "measdate", "species_symbol_map", "age_calc", "year_deficit")


@query(sql("SELECT plot_id, eco, species_symbol_map, year_deficit FROM splots WHERE year_deficit < -1", ["splots"]))
def spinup_cohorts(spark, d):
    return C.spinup_cohorts(fx.splots(spark, d)).select("plot_id", "eco", "species_symbol_map", "year_deficit")


@query(sql("SELECT plot_id, eco, species_symbol_map, age_calc, round(agb_sum, 8) AS agb_sum FROM splots WHERE sim_year = 0", ["splots"]))
def initial_cohorts(spark, d):
    return rounded(C.initial_cohorts(fx.splots(spark, d)).select("plot_id", "eco", "species_symbol_map", "age_calc", "agb_sum"), "agb_sum", digits=8)


# ---------------------------------------------------------------- ids and lists

@query(sql(f"SELECT DISTINCT {PLOT}, eco, plot_id FROM splots", ["splots"]))
def plot_ids(spark, d):
    return C.dense_ids(fx.coh(spark, d), [*PLOT_KEY, "eco"], "plot_id")


@query(sql("SELECT DISTINCT eco, eco_id FROM splots", ["splots"]))
def eco_ids(spark, d):
    return C.list_ids(fx.coh(spark, d), "eco", "eco_id")


@query(sql("SELECT DISTINCT species_symbol_map, species_id FROM splots", ["splots"]))
def species_ids(spark, d):
    return C.list_ids(fx.coh(spark, d), "species_symbol_map", "species_id")


@query(sql("SELECT DISTINCT eco, species_symbol_map, eco_species_id FROM splots", ["splots"]))
def eco_species_ids(spark, d):
    return C.eco_species_ids(fx.coh(spark, d))


@query(sql("SELECT eco, string_agg(DISTINCT species_symbol_map, ',' ORDER BY species_symbol_map) AS species_list FROM coh GROUP BY eco", ["coh"]))
def eco_species_list(spark, d):
    return C.eco_species_list(fx.coh(spark, d)).withColumn("species_list", F.concat_ws(",", "species_list"))


@query(sql(f"SELECT {PLOT}, eco, string_agg(sim_year, ',' ORDER BY sim_year) AS sim_years FROM (SELECT DISTINCT {PLOT}, eco, sim_year FROM splots) GROUP BY {PLOT}, eco", ["splots"]))
def site_sim_years(spark, d):
    years = F.concat_ws(",", F.transform("sim_years", lambda y: y.cast("string")))
    return C.site_sim_years(C.with_start(fx.coh(spark, d)).withColumn("sim_year", C.sim_year())).withColumn("sim_years", years)


@query(sql("SELECT * REPLACE (round(agb_sum, 8) AS agb_sum) FROM splots", ["splots"]))
def splots(spark, d):
    return rounded(fx.splots(spark, d), "agb_sum", digits=8)


@query(sql("SELECT max(age_calc) AS max_age, max(plot_id) AS n_plots, max(species_id) AS n_species, max(eco_id) AS n_ecos, min(sim_year) AS first_year, max(sim_year) AS last_year FROM splots", ["splots"]))
def table_extents(spark, d):
    return fx.splots(spark, d).agg(
        F.max("age_calc").alias("max_age"), F.max("plot_id").alias("n_plots"), F.max("species_id").alias("n_species"), F.max("eco_id").alias("n_ecos"),
        F.min("sim_year").alias("first_year"), F.max("sim_year").alias("last_year"),
    )


# ---------------------------------------------------------------- age distributions

_W = A.kernel(LOSS.half, LOSS.variance)
_EDGES = LOSS.bins.edges


def _cdf_ctes(name: str, source: str, keys: str, age: str, mass: str, top: str | None) -> dict[str, str]:
    """Long-form oracle of a distribution: <name>s smoothed, <name>b binned over all bins, <name>c cumulated."""
    kernel = ", ".join(f"({k - LOSS.half}, {w!r})" for k, w in enumerate(_W))
    upper = f"WHEN {age} + k > {top} THEN 2 * {top} + 1 - ({age} + k)" if top else ""
    bins = " + ".join(f"CAST(age >= {e} AS INT)" for e in _EDGES)
    k = len(_EDGES) + 1
    return {
        f"{name}s": f"SELECT {keys}, CASE WHEN {age} + k < 1 THEN 1 - ({age} + k) {upper} ELSE {age} + k END AS age, sum({mass} * w) AS mass FROM {source}, (VALUES {kernel}) kernel(k, w) GROUP BY ALL",
        f"{name}b": f"SELECT {keys}, 1 + {bins} AS bin, sum(mass) AS mass FROM {name}s GROUP BY ALL",
        f"{name}k": f"SELECT * FROM (SELECT {keys}, sum(mass) AS total FROM {name}b GROUP BY ALL) t, (SELECT unnest(range(1, {k + 1})) AS bin) b",
        f"{name}c": f"""SELECT {keys}, bin, CASE WHEN total > 0 THEN sum(coalesce(mass, 0)) OVER (PARTITION BY {keys} ORDER BY bin) / total ELSE 0 END AS cdf
  FROM {name}k LEFT JOIN {name}b USING ({keys}, bin)""",
    }


@query(sql(f"SELECT {KEY_SQL}, age_calc AS age, round(sum(agb_sum), 8) AS mass FROM splots WHERE agb_sum IS NOT NULL GROUP BY ALL", ["splots"]))
def age_hist(spark, d):
    return rounded(A.histogram(C.with_biomass(fx.splots(spark, d)), KEYS), "mass", digits=8)


def _smoothed(spark, d) -> DataFrame:
    world = World(spark, d)
    return A.smooth(A.histogram(C.with_biomass(world.splots), KEYS), KEYS, _W, world.top())


_REF = {"m": "SELECT s.*, n FROM splots s, top WHERE agb_sum IS NOT NULL"} | _cdf_ctes("r", "m", KEY_SQL, "age_calc", "agb_sum", "n")


@query(sql(f"SELECT {KEY_SQL}, age, round(mass, 8) AS mass FROM rs", ["splots", "top"], _REF))
def smooth_ages(spark, d):
    return rounded(_smoothed(spark, d), "mass", digits=8)


@query(sql(f"SELECT {KEY_SQL}, bin, round(mass, 8) AS mass FROM rb", ["splots", "top"], _REF))
def bin_ages(spark, d):
    dist = _smoothed(spark, d)
    return rounded(A.binned(dist, KEYS, LOSS.bins), "mass", digits=8)


@query(sql(f"SELECT {KEY_SQL}, bin, round(cdf, 6) AS cdf FROM rc SEMI JOIN rb USING ({KEY_SQL}, bin)", ["splots", "top"], _REF))
def age_cdf(spark, d):
    """Undisturbed or not: the distribution of every measured species over its occupied bins."""
    world = World(spark, d)
    return rounded(A.occupied_rows(A.cdf_array(C.with_biomass(world.splots), KEYS, LOSS, world.top()), KEYS), "cdf")


_CDF_COLS = ", ".join(f"round(max(CASE WHEN bin = {i + 1} THEN cdf END), 6) AS c{i + 1}" for i in range(LOSS.bins.count))
_SPDF = _REF | {
    "mass": f"SELECT {KEY_SQL}, sum(agb_sum) AS agb FROM m GROUP BY ALL",
    "last": "SELECT plot_id, eco, sim_year, species_symbol_map, max(measdate) AS measdate FROM mass GROUP BY ALL",
    "ref": f"SELECT {KEY_SQL}, bin, cdf, agb FROM rc JOIN mass USING ({KEY_SQL}) SEMI JOIN last USING (plot_id, eco, sim_year, species_symbol_map, measdate)",
}


def _spdf(world: World) -> DataFrame:
    return A.reference_distributions(C.with_biomass(world.splots), LOSS, world.top())


def _wide(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.select(*(c for c in df.columns if c != column), *(F.round(F.get(column, F.lit(i)), 6).alias(f"{prefix}{i + 1}") for i in range(LOSS.bins.count)))


@query(sql(f"SELECT {KEY_SQL}, round(any_value(agb), 8) AS agb, {_CDF_COLS} FROM ref GROUP BY {KEY_SQL}", ["splots", "top"], _SPDF))
def spdf(spark, d):
    return rounded(_wide(_spdf(World(spark, d)), "cdf", "c"), "agb", digits=8)


_WIDTHS = "CASE bin " + " ".join(f"WHEN {i + 1} THEN {w}" for i, w in enumerate(LOSS.bins.widths)) + " ELSE 0 END"
_PLOT_SPECIES = "plot_id, eco, species_symbol_map"
_NEXT = _SPDF | {
    "seen": f"SELECT {_PLOT_SPECIES}, sim_year, lead(sim_year) OVER (PARTITION BY {_PLOT_SPECIES} ORDER BY sim_year) AS next_year FROM (SELECT DISTINCT {_PLOT_SPECIES}, sim_year FROM ref)",
    "steps": f"SELECT s.*, r.bin, r.cdf FROM seen s JOIN ref r USING ({_PLOT_SPECIES}, sim_year) WHERE next_year IS NOT NULL",
}


@query(sql(f"SELECT {_PLOT_SPECIES}, p.sim_year, p.next_year, round(sum({_WIDTHS.replace('CASE bin', 'CASE p.bin')} * abs(p.cdf - q.cdf)), 6) AS w1 FROM steps p JOIN ref q USING ({_PLOT_SPECIES}, bin) WHERE q.sim_year = p.next_year GROUP BY ALL", ["splots", "top"], _NEXT))
def w1_loss(spark, d):
    """Distance between every measurement of a species of a plot and the next one of the same species there."""
    own = Window.partitionBy("plot_id", "eco", "species_symbol_map").orderBy("sim_year")
    f = _spdf(World(spark, d)).withColumn("next_year", F.lead("sim_year").over(own)).withColumn("q", F.lead("cdf").over(own)).filter("next_year is not null")
    return rounded(f.select("plot_id", "eco", "species_symbol_map", "sim_year", "next_year", A.w1("cdf", "q", LOSS.bins).alias("w1")), "w1")


_E, _LAM = LOSS.eps, LOSS.lam
_EACH = _SPDF | {
    "years": "SELECT *, lead(sim_year) OVER (PARTITION BY plot_id, eco ORDER BY sim_year) AS next_year FROM (SELECT DISTINCT plot_id, eco, sim_year FROM ref)",
    "p": "SELECT plot_id, eco, sim_year, next_year, species_symbol_map, bin, cdf FROM ref JOIN years USING (plot_id, eco, sim_year) WHERE next_year IS NOT NULL",
    "q": "SELECT r.plot_id, r.eco, y.sim_year, next_year, species_symbol_map, bin, cdf FROM ref r JOIN years y ON r.plot_id = y.plot_id AND r.eco = y.eco AND r.sim_year = y.next_year",
    "pq": f"SELECT plot_id, eco, sim_year, next_year, species_symbol_map, sum({_WIDTHS} * abs(p.cdf - q.cdf)) AS w, coalesce(max(CASE WHEN bin = {LOSS.bins.count} THEN p.cdf END), 0) AS a, coalesce(max(CASE WHEN bin = {LOSS.bins.count} THEN q.cdf END), 0) AS b FROM p FULL JOIN q USING (plot_id, eco, sim_year, next_year, species_symbol_map, bin) GROUP BY ALL",
}


@query(sql(f"""SELECT plot_id, eco, sim_year, next_year, species_symbol_map, round(CASE WHEN a > {_E} AND b > {_E} THEN w ELSE 0 END + CASE WHEN a > {_E} OR b > {_E} THEN {_LAM} * abs(log10(CASE WHEN a > {_E} THEN a ELSE 0 END + {_E}) - log10(CASE WHEN b > {_E} THEN b ELSE 0 END + {_E})) ELSE 0 END, 6) AS loss
FROM pq""", ["splots", "top"], _EACH))
def w1_loss_nullable(spark, d):
    """Distance between every measurement of a plot and the next one; species may be missing on either side."""
    world = World(spark, d)
    own = Window.partitionBy("plot_id", "eco").orderBy("sim_year")
    years = C.with_biomass(world.splots).select("plot_id", "eco", "sim_year").distinct().select("*", F.lag("sim_year").over(own).alias("last_year"), F.lead("sim_year").over(own).alias("next_year"))
    # a measurement is the earlier side of one pair and the later side of another
    side = lambda a, b, p, q: F.struct(F.col(a).alias("sim_year"), F.col(b).alias("next_year"), p.alias("p"), q.alias("q"))
    none = F.lit(None).cast("array<double>")
    sides = F.explode(F.array(side("sim_year", "next_year", F.col("cdf"), none), side("last_year", "sim_year", none, F.col("cdf")))).alias("x")
    x = _spdf(world).join(years, ["plot_id", "eco", "sim_year"]).select("plot_id", "eco", "species_symbol_map", sides).select("plot_id", "eco", "species_symbol_map", "x.*")
    keys = ["plot_id", "eco", "sim_year", "next_year", "species_symbol_map"]
    pairs = x.dropna(subset=["sim_year", "next_year"]).groupBy(*keys).agg(F.max("p").alias("p"), F.max("q").alias("q"))
    return rounded(pairs.select(*keys, A.bins_loss("p", "q", LOSS).alias("loss")), "loss")


# ---------------------------------------------------------------- pixels and crosswalk

def _lists(spark, d) -> tuple:
    return tuple(table(spark, d, x) for x in ("eco_ecocode_map", "data_species_eco_map", "data_all_species"))


def _crosswalk(spark, d) -> X.Crosswalk:
    return X.Crosswalk(fx.pixels(spark, d), fx.coh(spark, d), *_lists(spark, d))


def _effective(spark, d) -> DataFrame:
    return X.effective_splots(_crosswalk(spark, d).final())


@query(sql("SELECT * FROM pairs", ["pairs"]))
def pixel_pair_counts(spark, d):
    return X.pixel_pairs(fx.pixels(spark, d))


_FULL_COLS = "raster_ecocode, raster_eco, cohort_id, plt_cn, eco, species_symbol_map, borrowed, effective_eco, effective_ecocode, effective_species"


@query(sql(f"SELECT {_FULL_COLS} FROM full_table", ["full_table"]))
def crosswalk_full(spark, d):
    return _crosswalk(spark, d).full().select(*_FULL_COLS.split(", "))


@query(sql("SELECT * FROM totals", ["totals"]))
def crosswalk_group_totals(spark, d):
    return X.group_totals(_crosswalk(spark, d).resolved)


@query(sql("SELECT * FROM dom", ["dom"]))
def crosswalk_dominant(spark, d):
    return X.dominant(X.group_totals(_crosswalk(spark, d).resolved))


@query(sql(f"SELECT {_FULL_COLS} FROM resolved", ["resolved"]))
def crosswalk_final(spark, d):
    return _crosswalk(spark, d).final().select(*_FULL_COLS.split(", "))


_EFF = {
    "es": f"""SELECT e.*, min(measdate) OVER (PARTITION BY {PLOT}) AS start_measdate, plot_id, eco_id, effective_eco_id, species_id FROM eff e
  JOIN (SELECT *, row_number() OVER (ORDER BY {PLOT}, raster_ecocode) AS plot_id FROM (SELECT DISTINCT {PLOT}, raster_ecocode FROM eff)) USING ({PLOT}, raster_ecocode)
  JOIN (SELECT raster_eco, row_number() OVER (ORDER BY raster_eco) AS eco_id FROM (SELECT DISTINCT raster_eco FROM eff)) USING (raster_eco)
  JOIN (SELECT effective_eco, row_number() OVER (ORDER BY effective_eco) AS effective_eco_id FROM (SELECT DISTINCT effective_eco FROM eff)) USING (effective_eco)
  JOIN (SELECT effective_species, row_number() OVER (ORDER BY effective_species) AS species_id FROM (SELECT DISTINCT effective_species FROM eff)) USING (effective_species)""",
    "missed": "SELECT px.* FROM px ANTI JOIN eff ON px.plt_cn = eff.plt_cn AND px.ecocode = eff.raster_ecocode",
}


@query(sql("SELECT * REPLACE (round(agb_sum, 8) AS agb_sum) FROM es", ["eff"], _EFF))
def splots_effective(spark, d):
    return rounded(_effective(spark, d), "agb_sum", digits=8)


@query(sql("SELECT px.mapcode, px.plt_cn, px.ecocode, effective_eco, effective_species, age_calc, round(agb_sum, 8) AS agb_sum FROM px LEFT JOIN eff ON px.plt_cn = eff.plt_cn AND px.ecocode = eff.raster_ecocode", ["px", "eff"]))
def pixel_cohorts(spark, d):
    return rounded(X.pixel_cohorts(fx.pixels(spark, d), _effective(spark, d)), "agb_sum", digits=8)


@query(sql("SELECT * FROM missed", ["px", "eff"], _EFF))
def pixel_miss_rows(spark, d):
    return X.missed_pixels(fx.pixels(spark, d), _effective(spark, d)).select("mapcode", "plt_cn", "ecocode")


@query(sql("SELECT round(100.0 * (SELECT count(*) FROM missed) / (SELECT count(*) FROM px), 6) AS miss_rate", ["px", "eff"], _EFF))
def pixel_miss_rate(spark, d):
    return rounded(X.miss_rate(fx.pixels(spark, d), _effective(spark, d)), "miss_rate")


@query(sql("""SELECT eco, effective_eco, species, param_local_id, CAST(row_number() OVER (PARTITION BY eco ORDER BY effective_eco, species) AS INT) AS local_id
FROM (SELECT DISTINCT raster_eco AS eco, e.effective_eco, effective_species AS species, p.local_id AS param_local_id FROM eff e JOIN eco_species p ON e.effective_eco = p.eco AND e.effective_species = p.species) t""", ["eff", "eco_species"]))
def param_remap(spark, d):
    mapped = X.remap_params(_effective(spark, d), fx.eco_species(spark, d))
    return X.require_complete(mapped, ["eco", "effective_eco", "species", "param_local_id"])


# ---------------------------------------------------------------- parameters, one year, loss

@query(sql("SELECT eco, max(b_max) AS b_max_eco FROM eco_species GROUP BY eco", ["eco_species"]))
def eco_bmax_query(spark, d):
    return eco_bmax(fx.eco_species(spark, d))


@query(sql("SELECT * REPLACE (round(r1, 6) AS r1, round(r2, 6) AS r2, round(r3, 6) AS r3, round(r4, 6) AS r4, round(r5, 6) AS r5) FROM pe", ["pe"]))
def eco_params_query(spark, d):
    return rounded(eco_params(fx.eco_species(spark, d), fx.eco_shade(spark, d)), "r1", "r2", "r3", "r4", "r5")


@query(sql("SELECT site, species, round(greatest(2, anpp_max * greatest(1, exp(-1.6 * b / b_max_eco))), 6) AS bio FROM (SELECT *, sum(bio) OVER (PARTITION BY site) AS b FROM c0 JOIN pe USING (eco, species)) t", ["c0", "pe"]))
def initial_biomass(spark, d):
    world = World(spark, d)
    x = world.sites().join(world.params(), ["eco", "species"]).withColumn("b", F.sum("bio").over(Window.partitionBy("site")))
    return rounded(x.select("site", "species", succession.initial_biomass(F.col("anpp_max"), F.col("b"), F.col("b_max_eco")).alias("bio")), "bio")


_ONE = ["c0", "pe"]


def _steps(spark, d, sem: succession.Semantics = succession.Semantics()) -> DataFrame:
    world = World(spark, d)
    return succession.stepped(world.sites(sem), world.params(), 0, SEED, sem)


@query(sql("SELECT site, eco, seq, species, new_age AS age, round(new_bio, 4) AS bio FROM st0 WHERE new_bio > 1e-8", _ONE, step_ctes(0)))
def succession_step(spark, d):
    return rounded(succession.survivors(_steps(spark, d)), "bio", digits=4)


@query(sql("SELECT site, eco, round(b, 4) AS b, round(agnpp, 4) AS agnpp, round(m_tot, 4) AS m_tot, live, shade_class FROM tot0", _ONE, step_ctes(0)))
def site_shade(spark, d):
    return rounded(succession.site_totals(_steps(spark, d)), "b", "agnpp", "m_tot", digits=4)


@query(sql("SELECT site, eco, seq, species, age, round(bio, 4) AS bio FROM new0", _ONE, fx.MEASURED | step_ctes(0)))
def reproduction_step(spark, d):
    """Seedlings of sites that start with their measured ages."""
    steps = _steps(spark, d, MEASURED_AGES)
    return rounded(succession.seedlings(steps, succession.site_totals(steps), 0, SEED), "bio", digits=4)


GROWING = succession.Semantics(seed_at_age_one=False, growth_reduction=0.0)


@query(sql("SELECT site, eco, seq, species, new_age AS age, round(new_bio, 4) AS bio, round(growth, 4) AS growth, round(m_tot, 4) AS m_tot FROM st0 WHERE new_bio > 1e-8", _ONE, fx.MEASURED | step_ctes(0, True)))
def growing_step(spark, d):
    """A year with growth, from measured ages."""
    alive = _steps(spark, d, GROWING).filter("lives")
    return rounded(alive.select("site", "eco", "seq", "species", "age", F.col("new_bio").alias("bio"), "growth", "m_tot"), "bio", "growth", "m_tot", digits=4)


@query(sql("SELECT site, eco, round(b, 4) AS b, round(agnpp, 4) AS agnpp, round(m_tot, 4) AS m_tot, live, shade_class FROM tot0", _ONE, fx.MEASURED | step_ctes(0, True)))
def growing_shade(spark, d):
    """Site totals and shade after a year with growth, from measured ages."""
    return rounded(succession.site_totals(_steps(spark, d, GROWING)), "b", "agnpp", "m_tot", digits=4)


_THREE = reduce(dict.__or__, (step_ctes(y) for y in range(3)))


_THREE_YEARS = "SELECT " + " UNION ALL SELECT ".join(f"{y} AS year, site AS mapcode, eco, species, seq, CAST(age AS INT) AS age, round(bio, 4) AS biomass FROM c{y + 1}" for y in range(3))


@query(sql(_THREE_YEARS, _ONE, _THREE))
def simulate_3y(spark, d):
    return rounded(_simulated(spark, d, range(3)), "biomass", digits=4)


def _simulated(spark, d, years, keep=None, sem=succession.Semantics()) -> DataFrame:
    world = World(spark, d)
    return run(gathered(world.sites(sem)), [parameter_table(world.params())], years, SEED, sem, keep).drop("candidate")


@query(sql(_THREE_YEARS, _ONE, fx.MEASURED | _THREE))
def simulate_3y_measured(spark, d):
    """Three years from measured ages: mature species reproduce, old cohorts die."""
    return rounded(_simulated(spark, d, range(3), sem=MEASURED_AGES), "biomass", digits=4)


@query(sql(_THREE_YEARS, _ONE, fx.MEASURED | reduce(dict.__or__, (step_ctes(y, True) for y in range(3)))))
def simulate_3y_growing(spark, d):
    """Three years with growth, from measured ages, in the kernel."""
    return rounded(_simulated(spark, d, range(3), sem=GROWING), "biomass", digits=4)


@query(sql("SELECT " + " UNION ALL SELECT ".join(f"{y} AS year, site AS mapcode, eco, species, seq, CAST(age AS INT) AS age, round(bio, 4) AS biomass FROM c{y + 1}" for y in range(30)), _ONE, reduce(dict.__or__, (step_ctes(y) for y in range(30)))))
def simulate_30y(spark, d):
    return rounded(_simulated(spark, d, range(30)), "biomass", digits=4)


@query(sql("SELECT year, mapcode, round(sum(bio), 4) AS agb FROM (SELECT " + " UNION ALL SELECT ".join(f"{y} AS year, site AS mapcode, bio FROM c{y + 1}" for y in range(3)) + ") t GROUP BY ALL", _ONE, _THREE))
def raster_agb_by_year(spark, d):
    return rounded(sinks.raster_agb(_simulated(spark, d, range(3))), "agb", digits=4)


@query("SELECT year, mapcode, round(sum(biomass), 4) AS agb FROM output_communities WHERE mapcode IS NOT NULL AND year IS NOT NULL GROUP BY year, mapcode")
def communities_agb(spark, d):
    records = table(spark, d, "output_communities").filter("mapcode is not null and year is not null")
    return rounded(sinks.raster_agb(records), "agb", digits=4)


@query(sql("SELECT mapcode, CASE WHEN EXISTS (SELECT 1 FROM eff WHERE eff.plt_cn = px.plt_cn AND eff.raster_ecocode = px.ecocode) THEN mapcode ELSE 0 END AS value FROM px", ["px", "eff"]))
def raster_mapcodes(spark, d):
    px = fx.pixels(spark, d)
    return sinks.raster_mapcodes(px, X.pixel_cohorts(px, _effective(spark, d)).filter("effective_species is not null"))


#: A landscape: its parameters by pixel ecoregion and species, its sites by pixel.
_LAND = {
    "pe": """SELECT m.eco, m.species, m.local_id, p.* EXCLUDE (eco, species, local_id), shade.* EXCLUDE (eco), max(b_max) OVER (PARTITION BY m.eco) AS b_max_eco
  FROM (SELECT *, row_number() OVER (PARTITION BY eco ORDER BY effective_eco, species) AS local_id FROM (SELECT DISTINCT raster_eco AS eco, effective_eco, effective_species AS species FROM eff
    WHERE agb_sum IS NOT NULL AND (effective_eco, effective_species) IN (SELECT (eco, species) FROM eco_species))) m
  JOIN eco_species p ON p.eco = m.effective_eco AND p.species = m.species JOIN eco_shade shade ON shade.eco = m.eco""",
    "c0": """SELECT mapcode AS site, raster_eco AS eco, row_number() OVER (PARTITION BY mapcode ORDER BY age_calc, effective_species, agb_sum) AS seq, effective_species AS species, 1 AS age,
    agb_sum AS bio, CAST(0 AS DOUBLE) AS prev_mortality FROM px JOIN eff ON px.plt_cn = eff.plt_cn AND px.ecocode = eff.raster_ecocode WHERE agb_sum IS NOT NULL""",
} | reduce(dict.__or__, (step_ctes(y) for y in range(1, 4)))
_LAND["c1"] = _LAND["c0"]
_LAND = {k: _LAND[k] for k in ("pe", "c0", "c1", *(x for x in _LAND if x not in ("pe", "c0", "c1")))}
_LAND_ROWS = "SELECT " + " UNION ALL SELECT ".join(f"{y} AS year, site AS mapcode, eco, species, seq, CAST(age AS INT) AS age, round(bio, 4) AS biomass FROM c{y + 1}" for y in range(1, 4))


@query(sql(_LAND_ROWS, ["px", "eff", "eco_species", "eco_shade"], _LAND))
def landscape_3y(spark, d):
    """Pixels with the communities of their measurements, simulated for three years."""
    land = Landscape(fx.pixels(spark, d), fx.coh(spark, d), _lists(spark, d))
    return rounded(land.simulate(fx.eco_species(spark, d), fx.eco_shade(spark, d), range(1, 4), SEED), "biomass", digits=4)


def _ref(world: World) -> DataFrame:
    return _spdf(world).select(F.col("plot_id").alias("site"), F.col("sim_year").alias("year"), F.col("species_symbol_map").alias("species"), "agb", "cdf")


#: Years that the unrolled SQL simulates: past the last measured year of the tables it is run on (the queries ask the data).
UNROLLED = 30
_ALL = reduce(dict.__or__, (step_ctes(y) for y in range(UNROLLED)))
_SITE_YEAR = "site, year, species"
_LOSS_SQL = _ALL | _SPDF | {
    "refc": "SELECT plot_id AS site, sim_year AS year, species_symbol_map AS species, agb, bin, cdf FROM ref",
    "compared": "SELECT DISTINCT site, year FROM refc",
    "sim": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT {y} AS year, site, species, age, seq, bio FROM c{y + 1}" for y in range(UNROLLED)) + ") SEMI JOIN compared USING (site, year)",
    "per": f"SELECT {_SITE_YEAR}, age, arg_max(bio, seq) AS mass FROM sim GROUP BY ALL",
    "sim_agb": f"SELECT {_SITE_YEAR}, sum(bio) AS agb FROM sim GROUP BY ALL",
} | _cdf_ctes("s", "per", _SITE_YEAR, "age", "mass", None) | {
    "simc": f"SELECT {_SITE_YEAR}, a.agb, bin, cdf FROM sc JOIN sim_agb a USING ({_SITE_YEAR})",
    "two_sides": f"SELECT {_SITE_YEAR}, any_value(s.agb) AS sim, any_value(r.agb) AS ref, sum({_WIDTHS} * abs(s.cdf - r.cdf)) AS w1 FROM simc s FULL JOIN refc r USING ({_SITE_YEAR}, bin) GROUP BY {_SITE_YEAR}",
    "sl": f"""SELECT {_SITE_YEAR}, CASE WHEN ref IS NULL THEN pow(log10(sim + {_E}), 2) WHEN sim IS NULL THEN {_LAM} * abs(log10(ref + {_E})) ELSE (1 + w1) * pow(log10(sim + {_E}) - log10(ref + {_E}), 2) END AS w_loss,
    CASE WHEN sim IS NULL THEN ref WHEN ref IS NULL THEN sim ELSE abs(sim - ref) END AS agb_loss, coalesce(sim, 0) - coalesce(ref, 0) AS signed FROM two_sides""",
    "site_l": "SELECT site, year, sum(w_loss) AS w_loss, sum(agb_loss) AS agb_loss, abs(sum(signed)) AS site_agb_loss FROM sl GROUP BY site, year",
}


def _losses(spark, d, by_species: bool = False) -> DataFrame:
    world = World(spark, d)
    return losses(world.measured_sites(_ref(world)), [parameter_table(world.params())], world.years(), LOSS, SEED, by_species=by_species).drop("candidate")


@query(sql("SELECT site, year, species, round(w_loss, 4) AS w_loss, round(agb_loss, 4) AS agb_loss FROM sl", [*_ONE, "top"], _LOSS_SQL))
def species_loss(spark, d):
    """The loss of every species in every measured year of its site."""
    return rounded(_losses(spark, d, True).select("site", "year", "species", "w_loss", "agb_loss"), "w_loss", "agb_loss", digits=4)


@query(sql("SELECT site, year, round(w_loss, 4) AS w_loss, round(agb_loss, 4) AS agb_loss, round(site_agb_loss, 4) AS site_agb_loss FROM site_l", [*_ONE, "top"], _LOSS_SQL))
def site_loss(spark, d):
    """The loss of every site in each of its measured years."""
    return rounded(_losses(spark, d), "w_loss", "agb_loss", "site_agb_loss", digits=4)


@query(sql("SELECT round((sum(w_loss) + sum(agb_loss) + sum(site_agb_loss)) / count(*), 4) AS loss, count(*) AS num_sites FROM site_l", [*_ONE, "top"], _LOSS_SQL))
def run_loss(spark, d):
    """The mean loss over all measured site-years."""
    return rounded(L.run_loss(_losses(spark, d).withColumn("candidate", F.lit(0))).drop("candidate"), "loss", digits=4)


@query(sql("SELECT site, year, species, round(w_loss, 4) AS w_loss, round(agb_loss, 4) AS agb_loss FROM sl", [*_ONE, "top"], _LOSS_SQL))
def species_loss_joined(spark, d):
    """The same from stored records by joins: simulated cohorts of the measured years against the measured distributions."""
    world = World(spark, d)
    sites = with_years(gathered(world.sites()), _ref(world).select("site", "year"))
    sim = run(sites, [parameter_table(world.params())], world.years(), SEED).withColumnRenamed("mapcode", "site")
    out = L.species_loss(L.simulated_distributions(sim, LOSS), _ref(world).withColumn("candidate", F.lit(0)), LOSS)
    return rounded(out.select("site", "year", "species", "w_loss", "agb_loss"), "w_loss", "agb_loss", digits=4)


@query()
def spinup_state(spark, d):
    """Sites brought from their earliest establishment to year -1."""
    world = World(spark, d)
    s = C.spinup_cohorts(world.splots).select(
        F.col("plot_id").alias("site"), "eco", F.col("age_calc").cast("long").alias("seq"), F.col("species_symbol_map").alias("species"), F.lit(1).alias("age"), F.lit(0.0).alias("bio"), "year_deficit",
    )
    ends = s.agg(F.min("year_deficit"), F.max("year_deficit")).first()
    if ends[0] is None:
        return spark.createDataFrame([], "year int, mapcode long, eco string, species string, seq long, age int, biomass double")
    return rounded(run(gathered(s, ["year_deficit"]), [parameter_table(world.params())], [], SEED, spin=(ends[0] + 1, ends[1] + 1)).drop("candidate"), "biomass", digits=4)


@query()
def mutate_batch_loss(spark, d):
    """The losses of a parameter set and of four mutations of it, scored in one job on all sites and measured years."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    world = World(spark, d)
    first = Params.draw(world.eco_species(), SEED)
    batch = [first, *(first.mutate(rng) for _ in range(4))]
    return rounded(score_candidates(batch, world.measured_sites(_ref(world)), world.years(), LOSS, SEED), "loss", digits=4)


@query()
def sa_trace(spark, d):
    """Three batches of annealing against all measured years: trial, loss, acceptance, temperature."""
    world = World(spark, d)
    first = Params.draw(world.eco_species(), SEED)
    _, _, trace = calibrate(first, gathered(world.sites()), _ref(world), world.years(), LOSS, Schedule(max_iter=6, initial_t=1e3), batch=2, seed=SEED)
    return spark.createDataFrame([tuple(t.values()) for t in trace], "trial int, loss double, accepted boolean, t double, current double, best double")
