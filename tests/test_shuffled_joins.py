"""Queries over many plots: beyond the counted limit plots and measurements are shuffled, whatever Spark takes the size of their files for."""

import pytest

import __spark_entry__ as entry
from understory import session as S
from understory.operators import cohorts as C
from understory.operators import crosswalk as X

NAMES = [
    "splots",
    "age_cdf",
    "spdf",
    "bin_ages",
    "growing_shade",
    "initial_biomass",
    "param_remap",
    "pixel_miss_rate",
    "w1_loss_nullable",
    "initial_cohorts",
    "succession_step",
    "growing_step",
    "spinup_cohorts",
    "age_hist",
    "raster_mapcodes",
    "pixel_cohorts",
    "pixel_miss_rows",
    "raster_agb_by_year",
    "run_loss",
    "simulate_3y_growing",
    "site_loss",
    "species_loss",
    "mutate_batch_loss",
    "simulate_30y",
]


@pytest.mark.parametrize("name", NAMES)
def test_plots_are_not_broadcast(spark, data, monkeypatch, name):
    plans = []

    def lookup(*args, **more):
        joined = S.lookup(*args, **more, limit=0)
        plans.append(joined._jdf.queryExecution().executedPlan().toString())
        return joined

    for module in (C, X):
        monkeypatch.setattr(module, "lookup", lookup)
    entry.queries()[name](spark, data)
    assert plans and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)
