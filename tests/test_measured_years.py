"""Scores count every measured year, and the losses of the task are those of the joins."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_model import small_world

from understory.functions import agecdf as A
from understory.operators import loss as L
from understory.operators import search as S
from understory.operators.params import Params
from understory.operators.simulate import gathered, losses, parameter_table, run, with_truth, with_years
from understory.operators.succession import Semantics
from understory.plans import fixture as fx
from understory.plans import reference as R


def world(spark, seed=2, n=9):
    """Sites, a reference of some of their years with unknown, missing and empty species, and parameter rows."""
    rows, sites = small_world(seed, n)
    df = spark.createDataFrame([(s, "e", k, f"s{p}", a, b) for s, cs in sites.items() for p, a, b, k in cs], "site long, eco string, seq long, species string, age int, bio double")
    rng = np.random.default_rng(seed)
    ref = []
    for s in list(sites)[:-1]:
        for y in sorted(set(rng.integers(0, 7, 3).tolist())):
            for name in ("s0", "s2", "unknown")[: int(rng.integers(1, 4))]:
                cdf = np.cumsum(rng.random(7))
                ref.append((s, y, name, float(rng.uniform(0, 900)), (cdf / cdf[-1] if rng.random() < 0.8 else cdf * 0).tolist()))
    return rows, df, spark.createDataFrame(ref, "site long, year int, species string, agb double, cdf array<double>")


@pytest.mark.parametrize("sem", [Semantics(), Semantics(last_cohort_of_an_age_wins=False, growth_reduction=0.0)])
def test_losses_of_the_task_are_those_of_the_joins(spark, sem):
    rows, df, ref = world(spark)
    tables = [parameter_table(spark.createDataFrame([r | {"d": d} for r in rows])) for d in (7.0, 21.0)]
    p, years = A.LossParams(), range(7)
    sim = run(with_years(gathered(df), ref), tables, years, 5, sem).withColumnRenamed("mapcode", "site")
    both = ref.withColumn("candidate", F.explode(F.array(F.lit(0), F.lit(1))))
    want = L.species_loss(L.simulated_distributions(sim, p, sem), both, p)
    sites = with_truth(gathered(df), ref).repartition(3)
    key = lambda d, k: {tuple(r[:k]): r[k:] for r in d.collect()}
    for got, expected, k in ((losses(sites, tables, years, p, 5, sem, True), want, 4), (losses(sites, tables, years, p, 5, sem), L.site_loss(want), 3)):
        a, b = key(got, k), key(expected, k)
        assert a.keys() == b.keys() and len(a) > 20 and all(np.allclose(a[x], b[x], rtol=1e-9) for x in a)


@pytest.fixture(scope="module")
def site_years(duck):
    con = duck.cursor()
    con.sql("set timezone='UTC'")
    return con.sql(fx.sql("select count(*) from (select distinct plot_id, sim_year from splots where agb_sum is not null)", ["splots"])).fetchall()[0][0]


def test_batch_scores_every_site_year(spark, data, site_years):
    got = R.mutate_batch_loss(spark, data).collect()
    assert sorted(r.candidate for r in got) == [0, 1, 2, 3, 4] and {r.num_sites for r in got} == {site_years}


def test_trace_is_of_losses_over_every_measured_year(spark, data):
    """The trials mutate parameters like the batch, so the first has the loss of a single candidate over all years."""
    w = R.World(spark, data)
    first = Params.draw(w.eco_species(), R.SEED).mutate(np.random.default_rng(R.SEED))
    want = R.score_candidates([first], w.measured_sites(R._ref(w)), w.years(), R.LOSS, R.SEED).first()
    trace = R.sa_trace(spark, data).collect()
    assert [r.trial for r in trace] == [1, 2, 3, 4, 5, 6] and math.isclose(trace[0].loss, want.loss, rel_tol=1e-9)


def alike(a, b):
    """Equal traces, but for the order in which losses are added."""
    return len(a) == len(b) and all(x[k] == y[k] or math.isclose(x[k], y[k], rel_tol=1e-9) for x, y in zip(a, b, strict=True) for k in x)


def test_calibration_goes_on_as_if_it_had_never_stopped(spark, tmp_path):
    rows, df, ref = world(spark)
    first = Params.draw(spark.createDataFrame([(r["eco"], r["species"]) for r in rows], "eco string, species string"), 1)
    args = (first, gathered(df), ref, range(7), A.LossParams())
    whole = S.calibrate(*args, S.Schedule(max_iter=6, initial_t=10.0), batch=2, seed=5)
    one = S.calibrate(*args, S.Schedule(max_iter=4, initial_t=10.0), batch=2, seed=5, output=str(tmp_path))
    two = S.calibrate(*args, S.Schedule(max_iter=6, initial_t=10.0), batch=2, seed=5, output=str(tmp_path))
    assert alike(one[2] + two[2], whole[2]) and math.isclose(two[1].best, whole[1].best) and two[0].to_json() == whole[0].to_json()
    assert (tmp_path / "best_params.json").read_text() == two[0].to_json()


def test_an_interrupted_search_is_saved(spark, tmp_path, monkeypatch):
    rows, df, ref = world(spark)
    first = Params.draw(spark.createDataFrame([(r["eco"], r["species"]) for r in rows], "eco string, species string"), 1)
    args = (first, gathered(df), ref, range(7), A.LossParams(), S.Schedule(max_iter=6, initial_t=10.0))
    whole = S.calibrate(*args, batch=2, seed=5)
    real, calls = S.score_candidates, []

    def stop(*a):
        calls.append(1)
        if len(calls) == 3:
            raise KeyboardInterrupt
        return real(*a)

    monkeypatch.setattr(S, "score_candidates", stop)
    with pytest.raises(KeyboardInterrupt):
        S.calibrate(*args, batch=2, seed=5, output=str(tmp_path))
    monkeypatch.setattr(S, "score_candidates", real)
    assert alike(S.calibrate(*args, batch=2, seed=5, output=str(tmp_path))[2], whole[2][4:])
