"""Scoring simulated against measured species-age distributions.

Everything is keyed by (candidate, site, year, species): one full outer join decides whether a species is on
both sides, only simulated or only measured, and plain sums add up species, sites and years.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from understory.functions.agecdf import LossParams, cdf_array, w1
from understory.operators.succession import Semantics

KEYS = ["candidate", "site", "year"]


def simulated_distributions(cohorts: DataFrame, params: LossParams, sem: Semantics = Semantics()) -> DataFrame:
    """(candidate, site, year, species, agb, cdf) of simulated cohorts (KEYS, species, seq, age, biomass), read once.

    Of cohorts of one age the last in the order of ``seq`` fills the histogram; the total counts all.
    """
    mass = F.max_by("biomass", "seq") if sem.last_cohort_of_an_age_wins else F.sum("biomass")
    per_age = cohorts.groupBy(*KEYS, "species", "age").agg(mass.alias("mass"), F.sum("biomass").alias("whole"))
    return cdf_array(per_age, [*KEYS, "species"], params, None, age="age", mass="mass", more=[F.sum("whole").alias("agb")]).select(*KEYS, "species", "agb", "cdf")


def species_loss(sim: DataFrame, ref: DataFrame, params: LossParams) -> DataFrame:
    """(KEYS, species, w_loss, agb_loss, signed) for every species on either side of a compared site and year.

    ``ref``: (KEYS, species, agb, cdf). Only sites and years with a measurement are compared.
    """
    e, lam = params.eps, params.lam
    compared = ref.select(*KEYS).distinct()
    s = sim.join(compared, KEYS, "left_semi").select(*KEYS, "species", F.col("agb").alias("sim"), F.col("cdf").alias("p"))
    r = ref.select(*KEYS, "species", F.col("agb").alias("ref"), F.col("cdf").alias("q"))
    x = s.join(r, [*KEYS, "species"], "full_outer")
    both, only_sim = F.col("sim").isNotNull() & F.col("ref").isNotNull(), F.col("ref").isNull()
    log = lambda c: F.log10(F.col(c) + e)
    w = F.when(both, (1 + w1("p", "q", params.bins)) * F.pow(log("sim") - log("ref"), F.lit(2.0))).when(only_sim, F.pow(log("sim"), F.lit(2.0))).otherwise(lam * F.abs(log("ref")))
    agb = F.when(both, F.abs(F.col("sim") - F.col("ref"))).otherwise(F.coalesce("sim", "ref"))
    return x.select(*KEYS, "species", w.alias("w_loss"), agb.alias("agb_loss"), (F.coalesce("sim", F.lit(0.0)) - F.coalesce("ref", F.lit(0.0))).alias("signed"))


def site_loss(species: DataFrame) -> DataFrame:
    return species.groupBy(*KEYS).agg(F.sum("w_loss").alias("w_loss"), F.sum("agb_loss").alias("agb_loss"), F.abs(F.sum("signed")).alias("site_agb_loss"))


def run_loss(sites: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """(candidate, loss, num_sites): the mean over compared sites and years."""
    total = alpha * F.sum("w_loss") + beta * F.sum("agb_loss") + F.sum("site_agb_loss")
    return sites.groupBy("candidate").agg((total / F.count("*")).alias("loss"), F.count("*").alias("num_sites"))
