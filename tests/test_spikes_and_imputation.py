import math

import numpy as np
import pandas as pd
import pytest
from helpers import cohort, cohorts, with_clashes

from understory.operators import impute, spikes


def plain_flags(df: pd.DataFrame) -> set:
    """The definitions, crew by crew, in plain pandas. df: cohort_id, crew, age_calc, agb (NaN: no reading)."""
    out = set()
    for f, (lo, hi) in spikes.BOUNDS.items():
        x = df[["cohort_id", "crew", f, f"{f}?"]][df[f"{f}?"]].sort_values(["crew", "cohort_id"])
        for _, g in x.groupby("crew"):
            v = g[f].to_numpy(float)
            ok = (v >= lo) & (v <= hi)
            logs = np.round(np.log2(v[ok & (v > 0)]) * 256)
            if len(logs):
                mid = np.median(logs)
                dev = max(1.4826 * np.median(np.abs(logs - mid)), 1.0)
            run = np.cumsum(np.r_[True, v[1:] != v[:-1]])
            size = np.bincount(run)[run]
            for i, (c, a, s) in enumerate(zip(g.cohort_id, v, size, strict=True)):
                far = ok[i] and (a == 0 or abs(math.log2(a) * 256 - mid) > 5 * dev)
                if not ok[i] or far or s >= 6:
                    out.add((c, f))
    return out


def chain_rows(seed, n=900, crews=5, hot=0.5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        crew = 0 if rng.random() < hot else int(rng.integers(1, crews))
        age, agb = int(np.exp(rng.normal(3.5, 0.3))), float(np.exp(rng.normal(1.5, 0.4)).round(3))
        u = rng.random()
        if u < 0.02:
            age, agb = 0 if u < 0.01 else -17, -3.0
        elif u < 0.04:
            age, agb = age * 30, agb * 500
        elif u < 0.05:
            agb = math.nan if u < 0.045 else math.inf
        elif u < 0.06:
            age, agb = None, None
        rows.append([i, crew, age, agb])
    for start in (40, 300, 500):  # stuck runs of crew 0, one across many cohorts of others
        k = 0
        for r in rows[start:]:
            if r[1] == 0 and k < 6 + start // 100:
                r[2], r[3], k = 77, 4.25, k + 1
    return rows


@pytest.mark.parametrize(("partitions", "chunk", "sources"), [(1, spikes.CHUNK, 100), (7, 50, 100), (40, spikes.CHUNK, 100), (5, 37, 1)])
def test_flags_match_the_definitions(spark, partitions, chunk, sources):
    """The probabilities alone decide; beyond ``sources`` crews the other join is taken."""
    rows = chain_rows(3)
    df = cohorts(spark, [cohort(i, crew_id=c, age_calc=a, agb=b) for i, c, a, b in rows] + [cohort(i, crew_id=c, age_calc=a, agb=b) for i, c, a, b in rows[:50]])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = spikes.flag_readings(with_clashes(df), chunk, sources).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    absent = {0}  # recurs across crews; -17 is no code
    flat = pd.DataFrame([(i, c, a if a is not None else math.nan, a is not None and a not in absent, b if b is not None else math.nan, b is not None) for i, c, a, b in rows], columns=["cohort_id", "crew", "age_calc", "age_calc?", "agb", "agb?"])
    assert {(r.cohort_id, r.field) for r in got} == plain_flags(flat)
    assert len(got) == len({(r.cohort_id, r.field) for r in got}) and min(r.probability for r in got) > spikes.FLAGGED


def test_forward_backward_is_the_sequential_one():
    rng = np.random.default_rng(1)
    e, seg = rng.random((400, 4)) + 1e-3, np.repeat([0, 1, 2], [150, 1, 249])
    same, entry = rng.random(400) < 0.4, np.repeat([0.01, 0.2, 0.05], [150, 1, 249])
    alpha, beta = rng.random(4), rng.random(4)
    got = spikes.Chain(e, same, entry, seg).posterior(alpha, beta)

    def steps(repeats, odds):
        t = spikes.BASE * (1 if repeats else 1 - odds)
        if repeats:
            t[spikes.STUCK] = 0
        t[:, spikes.STUCK] = 0 if repeats else odds
        t[spikes.STUCK, spikes.STUCK] = 1 if repeats else odds
        return t

    for s in range(3):
        at = np.flatnonzero(seg == s)
        a, fwd = alpha if s == 0 else spikes._stationary(), []
        for i in at:
            a = (a @ steps(same[i], entry[i])) * e[i]
            a = a / a.sum()
            fwd.append(a)
        b, back = beta if s == 2 else np.ones(4), []
        for i in at[::-1]:
            back.append(b)
            b = steps(same[i], entry[i]) @ (e[i] * b)
            b = b / b.sum()
        p = np.array(fwd) * np.array(back[::-1])
        assert np.allclose(got[at], p / p.sum(1, keepdims=True))


@pytest.mark.parametrize("rate", [0.0, 0.01, 0.2, 0.9])
@pytest.mark.parametrize("length", [4, 5, 6, 7, 300])
def test_six_is_the_shortest_stuck_run(rate, length):
    """Whatever the crew's rate of repetition, and also beside a spike, an impossible reading and another run."""
    x = np.r_[20.0, 1e6, np.full(length, 33.0), np.full(5, 34.0), -1.0, np.full(length, 30.0), 21.0]
    same = np.append(False, x[1:] == x[:-1])
    rates = np.full(len(x), rate)
    e = spikes.emissions("age_calc", x, np.full(len(x), 5.0), np.full(len(x), 0.3), rates, same)
    off = 1 - spikes.Chain(e, same, spikes.entry_odds(rates), np.zeros(len(x), int)).posterior(None, None)[:, 0]
    want = np.isin(x, (1e6, -1.0)) | (np.isin(x, (33.0, 30.0)) & (length >= 6))
    assert ((off > spikes.FLAGGED) == want).all()


def test_flags_edge_cases(spark):
    assert spikes.flag_readings(cohorts(spark, [])).count() == 0
    rows = [cohort(i, crew_id=None, age_calc=20 + i % 5, agb=1.0 + i % 3) for i in range(20)] + [cohort(None, agb=-1.0), cohort(30, crew_id=None, agb=0.0, age_calc=None), cohort(31, crew_id=None, agb=None, age_calc=1501)]
    got = {(r.cohort_id, r.crew_id, r.field, r.kind) for r in spikes.flag_readings(cohorts(spark, rows)).collect()}
    assert got == {(30, None, "agb", "spike"), (31, None, "age_calc", "out_of_range")}


def tables(spark, data):
    return [spark.read.parquet(f"{data}/{x}.parquet") for x in ("eco_ecocode_map", "data_all_species", "data_species_eco_map")]


def test_fill_marks_and_keeps(spark, data):
    raw = spark.read.parquet(f"{data}/data_eco_cohorts.parquet")
    filled = impute.fill(with_clashes(raw), *tables(spark, data)).toPandas().set_index("cohort_id")
    once = raw.dropDuplicates(["cohort_id"]).toPandas().set_index("cohort_id")
    assert set(filled.index) == set(once.index) and filled.index.is_unique
    ecos = {r.eco for r in tables(spark, data)[0].collect()}
    species = {r.species_symbol_map for r in tables(spark, data)[1].collect()}
    for f in ("age_calc", "eco", "species_symbol_map"):
        same = ~filled[f"{f}_absent"]
        assert (filled.loc[same, f] == once.loc[filled.index[same], f]).all()
        assert (filled[f"{f}_filled"] == filled[f"{f}_absent"]).all() and filled[f].notna().all()
    assert filled.loc[filled.eco_filled, "eco"].isin(ecos).all() and filled.loc[filled.species_symbol_map_filled, "species_symbol_map"].isin(species).all()
    assert filled.loc[filled.age_calc_filled, "age_calc"].between(1, 1500).all()


def test_held_out_accuracy(spark):
    """Hidden values come back: eco from the plot, species from the map, ages from crew and visit."""
    from pyspark.sql import functions as F

    data = "/root/testdata/sf0.01"
    raw = spark.read.parquet(f"{data}/data_eco_cohorts.parquet")
    hide = lambda k: F.abs(F.hash("cohort_id", F.lit(k))) % 25 == 0
    hidden = raw.select(*(F.when(~hide(i), F.col(c)).alias(c) if (i := {"age_calc": 1, "eco": 2, "species_symbol_map": 3}.get(c)) else F.col(c) for c in raw.columns))
    filled = impute.fill(hidden, *tables(spark, data))
    listed = [r.eco for r in tables(spark, data)[0].collect()]
    x = raw.dropDuplicates(["cohort_id"]).select("cohort_id", F.col("age_calc").alias("a"), F.col("eco").alias("e"), F.col("species_symbol_map").alias("s"), hide(1).alias("h1"), hide(2).alias("h2"), hide(3).alias("h3")).join(filled, "cohort_id").toPandas()
    eco = x[x.h2 & x.e.isin(listed)]
    assert (eco.e == eco.eco).mean() > 0.97
    known = x[x.h3 & x.s.isin({r.species_symbol_map for r in tables(spark, data)[1].collect()})]
    assert (known.s == known.species_symbol_map).mean() > 0.95
    age = x[x.h1 & x.a.between(1, 500)]
    error = np.abs(np.log(age.a) - np.log(age.age_calc)).mean()
    assert error < 0.75 * np.abs(np.log(age.a) - np.log(age.a.median())).mean()


def test_fill_edge_cases(spark, data):
    assert impute.fill(cohorts(spark, []), *tables(spark, data)).count() == 0
    rows = [cohort(1, eco=None, age_calc=None, species_symbol_map=None, species_symbol=None, sftwd_hrdwd=None, agb=None, tree_count=None, crew_id=None, plot=None, plt_cn=None), cohort(None), cohort(2, eco="zz", species_symbol_map="_H", age_calc=4000, agb=math.inf)]
    got = {r.cohort_id: r for r in impute.fill(cohorts(spark, rows), *tables(spark, data)).collect()}
    assert set(got) == {1, 2} and got[1].eco_filled and got[1].eco and 1 <= got[1].age_calc <= 1500
    assert (got[2].eco, got[2].species_symbol_map, got[2].age_calc, got[2].eco_absent) == ("zz", "_H", 4000, False)
    nothing = [t.filter("false") for t in tables(spark, data)]
    r = impute.fill(cohorts(spark, rows[:1]), *nothing).first()
    assert r.eco is None and r.eco_absent and not r.eco_filled
    assert {tuple(x) for x in impute.absent_fields(impute.fill(cohorts(spark, rows), *tables(spark, data))).collect()} == {(1, "age_calc"), (1, "eco"), (1, "species_symbol_map")}
