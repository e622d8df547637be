"""One year of biomass succession as column expressions: the readable, oracle-checked form of the kernel.

Cohort rows: (site, eco, seq, species, age, bio, prev_mortality). Sites never read each other, so everything
is a window or a group over the site. Quirks that define the model's numbers are kept by default, each with a
flag in ``Semantics``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from understory.functions.rng import ESTABLISHMENT, LIGHT, MORTALITY, uniform
from understory.operators.params import LIGHT as LIGHT_TABLE


@dataclass(frozen=True)
class Semantics:
    seed_at_age_one: bool = True  # measured ages are discarded when sites are seeded
    growth_reduction: float = 1.0  # applied as 1 - growth_reduction
    capacity_reduction: float = 1.0
    growth_mortality_at_least_growth: bool = True  # a cohort never gains biomass
    own_biomass_counts_twice: bool = True  # in the room that is left
    new_biomass_at_least_anpp: bool = True  # a factor below 1 is raised to 1
    last_cohort_of_an_age_wins: bool = True  # in simulated histograms
    spinup_mortality: float = 0.15  # added in years up to 0


SENESCENT, ACTIVE_AGE = 1e-8, 5
#: Keys of cohorts that are added later: NEW_KEY + (year + FIRST) * SPREAD + local id of the species, above all initial
#: ones; those of the spin-up lie HALF above those of reproduction. The kernel checks that all parts fit.
NEW_KEY, FIRST, SPREAD, HALF = 1_000_000_000, 5_000, 200_000, 100_000


def stepped(cohorts: DataFrame, params: DataFrame, year: Column | int, seed: int, sem: Semantics = Semantics()) -> DataFrame:
    """Every cohort one year on: new age and biomass, mortality, growth and whether it lives. ``params``: small, joined by name."""
    site = Window.partitionBy("site")
    y = year if isinstance(year, Column) else F.lit(year)
    x = cohorts.join(params, ["eco", "species"]).withColumn("age", F.col("age") + 1)
    x = x.withColumn("comp", F.greatest(F.pow("bio", F.lit(0.95)), F.lit(1.0)))
    x = x.withColumn("b_all", F.sum("bio").over(site)).withColumn("c_all", F.sum("comp").over(site))
    f = F.exp(F.col("d") * (F.col("age") / F.col("longevity") - 1)) + F.when(y <= 0, sem.spinup_mortality).otherwise(0.0)
    u = uniform(seed, "site", y, "seq", MORTALITY)
    x = x.withColumn("f", f).withColumn("m_age", F.when((F.col("age") < F.col("longevity")) & (u > F.col("prob_mort")) & (F.col("f") < 1), F.col("bio") * F.col("f")).otherwise(F.col("bio")))
    room = F.col("b_max") * sem.capacity_reduction - F.col("b_all") - (F.col("bio") if sem.own_biomass_counts_twice else 0.0)
    x = x.withColumn("b_pot", F.greatest(room, F.lit(1.0)))
    if sem.capacity_reduction >= 1:
        x = x.withColumn("b_pot", F.greatest("b_pot", "prev_mortality"))
    x = x.withColumn("b_ap", F.col("bio") / F.col("b_pot")).withColumn("x", F.pow("b_ap", F.col("s")))
    keep = 1 - sem.growth_reduction if sem.growth_reduction > 0 else 1.0
    x = x.withColumn("anpp_most", F.col("anpp_max") * F.col("comp") / F.col("c_all"))
    x = x.withColumn("growth", F.least(F.col("x") * F.exp(1 - F.col("x")), F.lit(1.0)) * F.col("anpp_most") * keep)
    m = F.when(F.col("anpp_most") <= 1, F.col("anpp_most") * 2 * F.col("b_ap") / (1 + F.col("b_ap"))).otherwise(F.col("anpp_most"))
    x = x.withColumn("anpp", F.greatest(F.col("growth") - F.col("m_age"), F.lit(1.0)))
    x = x.withColumn("m_bio", F.greatest(F.least(m, F.col("bio")) * keep - F.col("m_age"), F.lit(0.0)))
    x = x.withColumn("m_bio", F.greatest("m_bio", "anpp") if sem.growth_mortality_at_least_growth else F.least("m_bio", "anpp"))
    x = x.withColumn("m_tot", F.col("m_age") + F.col("m_bio")).withColumn("new_bio", F.col("bio") + F.col("anpp") - F.col("m_tot"))
    return x.withColumn("lives", F.col("new_bio") > SENESCENT).withColumn("mature", F.col("age") >= F.col("maturity"))


def survivors(steps: DataFrame) -> DataFrame:
    return steps.filter("lives").select("site", "eco", "seq", "species", "age", F.col("new_bio").alias("bio"))


def site_totals(steps: DataFrame) -> DataFrame:
    """(site, eco, b, agnpp, m_tot, live, shade_class) after the year."""
    alive = F.col("lives")
    g = steps.groupBy("site", "eco").agg(
        F.sum(F.when(alive, F.col("new_bio")).otherwise(0.0)).alias("b"), F.sum("growth").alias("agnpp"), F.sum("m_tot").alias("m_tot"), F.sum(alive.cast("int")).alias("live"),
        F.sum(F.when(alive & (F.col("age") > ACTIVE_AGE), F.col("new_bio")).otherwise(0.0)).alias("b_act"),
        F.first("prev_mortality").alias("prev"), F.first("b_max_eco").alias("b_max_eco"), *(F.first(f"r{k}").alias(f"r{k}") for k in range(1, 6)),
    )
    share = F.least("b_act", F.col("b_max_eco") - F.col("prev")) / F.col("b_max_eco")
    shade = sum(((share > F.col(f"r{k}")).cast("int") for k in range(2, 6)), (share > F.col("r1")).cast("int"))
    return g.select("site", "eco", "b", "agnpp", "m_tot", "live", shade.alias("shade_class"))


def initial_biomass(anpp: Column, site_b: Column, b_max_eco: Column, sem: Semantics = Semantics()) -> Column:
    """Biomass of a new cohort: what it could produce on the site, 2 at least."""
    factor = F.exp(-1.6 * site_b / b_max_eco)
    return F.greatest(F.lit(2.0), anpp * (F.greatest(F.lit(1.0), factor) if sem.new_biomass_at_least_anpp else factor))


def sufficient_light(shade_class: Column, shade_tol: Column) -> Column:
    table = F.array(*(F.lit(p) for row in LIGHT_TABLE for p in row))
    return F.get(table, shade_class * 5 + shade_tol - 1)


def seedlings(steps: DataFrame, totals: DataFrame, year: Column | int, seed: int, sem: Semantics = Semantics()) -> DataFrame:
    """New cohorts of the species that were mature this year, on sites where anything lives.

    New biomass doesn't depend on the order of species as long as its factor is raised to 1.
    """
    y = year if isinstance(year, Column) else F.lit(year)
    mature = steps.filter("mature").select("site", "eco", "species", "local_id", "shade_tol", "prob_estab", "anpp_max", "b_max_eco").distinct()
    x = mature.join(totals.filter("live > 0").select("site", "b", "shade_class"), "site")
    light = uniform(seed, "site", y, "local_id", LIGHT) <= sufficient_light(F.col("shade_class"), F.col("shade_tol"))
    settles = uniform(seed, "site", y, "local_id", ESTABLISHMENT) <= F.col("prob_estab")
    seq = F.lit(NEW_KEY).cast("long") + (y.cast("long") + FIRST) * SPREAD + F.col("local_id")
    return x.filter(light & settles).select("site", "eco", seq.alias("seq"), "species", F.lit(1).alias("age"), initial_biomass(F.col("anpp_max"), F.col("b"), F.col("b_max_eco"), sem).alias("bio"))


def one_year(cohorts: DataFrame, params: DataFrame, year: int, seed: int, sem: Semantics = Semantics()) -> DataFrame:
    """The cohorts after succession and reproduction, with the site's mortality for the next year."""
    steps = stepped(cohorts, params, year, seed, sem)
    totals = site_totals(steps)
    both = survivors(steps).unionByName(seedlings(steps, totals, year, seed, sem))
    return both.join(totals.select("site", F.col("m_tot").alias("prev_mortality")), "site")
