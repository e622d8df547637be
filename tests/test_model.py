"""Golden cases, a scalar restatement of the kernel, and properties of the model's parts."""

import datetime
import math
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from understory.functions import agecdf as A
from understory.functions.rng import ESTABLISHMENT, LIGHT, MORTALITY, P, uniform, uniform_np
from understory.operators import cohorts as C
from understory.operators import loss as L
from understory.operators import search as S
from understory.operators.kernel import Sites, Table, added_key
from understory.operators.params import LIGHT as LIGHT_TABLE
from understory.operators.params import PRIORS, Params, eco_params
from understory.operators.simulate import gathered, parameter_table, run
from understory.operators.succession import HALF, Semantics, one_year, site_totals, stepped, survivors

BINS = A.AgeBins()


def test_kernel_weights():
    assert np.allclose(A.kernel(1), [0.274068619, 0.451862762, 0.274068619])
    assert np.allclose(A.kernel(3)[:4], [0.00443305, 0.05400558, 0.24203623, 0.39905028])


def test_bins():
    assert BINS.widths == [5, 5, 10, 20, 20, 20] and BINS.count == 7
    assert A.AgeBins((5, 10), False).widths == [5] and A.AgeBins((5, 10), False).count == 2
    with pytest.raises(ValueError):
        A.AgeBins((5,), False)
    with pytest.raises(ValueError):
        A.AgeBins((5, 5))


def test_bin_edges(spark):
    ages = spark.range(1, 101).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("age"), F.lit(1.0).alias("mass"))
    got = {r.bin: r.mass for r in A.binned(ages, ["k"], BINS).collect()}
    assert np.cumsum([got[b] for b in range(1, 8)]).tolist() == [4, 9, 19, 39, 59, 79, 100]
    closed = {r.bin: r.mass for r in A.binned(ages, ["k"], A.AgeBins(BINS.edges, False)).collect()}
    assert sum(closed.values()) == 79


def dense_cdf(hist, n, half, bins=BINS):
    x = np.zeros(n)
    for a, m in hist.items():
        x[a - 1] += m
    w = A.kernel(half)
    s = np.convolve(np.pad(x, half, mode="symmetric"), w, mode="valid")
    at = np.array([1 + sum(a >= e for e in bins.edges) for a in range(1, n + 1)])
    b = np.bincount(at, weights=s, minlength=bins.count + 1)[1:]
    c = np.cumsum(b)
    return c / c[-1] if c[-1] > 0 else c


GOLD_A, GOLD_B = {1: 10.0, 5: 20.0, 80: 5.0}, {4: 12.0, 40: 8.0}


def test_golden_distributions(spark):
    rows = [("A", a, m) for a, m in GOLD_A.items()] + [("B", a, m) for a, m in GOLD_B.items()] + [("Z", 3, 0.0)]
    df = spark.createDataFrame(rows, "k string, age_calc int, agb_sum double")
    p = A.LossParams()
    got = {r.k: r for r in A.cdf_array(df, ["k"], p, 100).collect()}
    a, b = [0.44232492, 0.85714286, 0.85714286, 0.85714286, 0.85714286, 0.89629552, 1], [0.43555883, 0.6, 0.6, 0.70962745, 1, 1, 1]
    assert np.allclose(got["A"].cdf, a) and np.allclose(got["B"].cdf, b) and got["Z"].cdf == [0.0] * 7
    assert np.allclose(dense_cdf(GOLD_A, 100, 1), a)
    pair = spark.createDataFrame([(got["A"].cdf, got["B"].cdf, None, got["Z"].cdf)], "p array<double>, q array<double>, m array<double>, z array<double>")
    r = pair.select(A.w1("p", "q", BINS).alias("w"), A.bins_loss("p", "p", p).alias("same"), A.bins_loss("p", "m", p).alias("one"), A.bins_loss("m", "z", p).alias("none")).first()
    assert math.isclose(r.w, 11.772514047551, rel_tol=1e-9) and r.same == 0 and r.none == 0
    assert math.isclose(r.one, 0.01 * abs(math.log10(1 + 1e-7) - math.log10(1e-7)), rel_tol=1e-9)


@pytest.mark.parametrize("half", [1, 3])
def test_scatter_is_the_symmetric_filter(spark, half):
    rng = np.random.default_rng(half)
    hist = {int(a): float(m) for a, m in zip(rng.choice(np.arange(1, 61), 25, False), rng.random(25), strict=True)}
    df = spark.createDataFrame([(1, a, m) for a, m in hist.items()], "k int, age_calc int, agb_sum double")
    h = A.smooth(A.histogram(df, ["k"]), ["k"], A.kernel(half), 60)
    long = {r.bin: r.cdf for r in A.cdf_rows(A.binned(h, ["k"], BINS), ["k"]).collect()}
    want = dense_cdf(hist, 60, half)
    assert all(math.isclose(long[b], want[b - 1], abs_tol=1e-12) for b in long)
    assert math.isclose(h.agg(F.sum("mass")).first()[0], sum(hist.values()), rel_tol=1e-12)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.floats(0.001, 100), min_size=1, max_size=20), st.integers(1, 3))
def test_distributions_are_monotone(hist, half):
    c = dense_cdf(hist, 100, half)
    assert (np.diff(c) >= -1e-12).all() and math.isclose(c[-1], 1.0)


def test_golden_losses(spark):
    rows = [("A", a, m) for a, m in GOLD_A.items()] + [("B", a, m) for a, m in GOLD_B.items()]
    cdf = {r.k: r.cdf for r in A.cdf_array(spark.createDataFrame(rows, "k string, age_calc int, agb_sum double"), ["k"], A.LossParams(), 100).collect()}
    schema = "candidate int, site long, year int, species string, agb double, cdf array<double>"
    sim = spark.createDataFrame([(0, 1, 0, "both", 20.0, cdf["B"]), (0, 1, 0, "sim", 20.0, cdf["B"]), (0, 2, 0, "sim", 1.0, cdf["B"])], schema)
    ref = spark.createDataFrame([(0, 1, 0, "both", 35.0, cdf["A"]), (0, 1, 0, "ref", 35.0, cdf["A"])], schema)
    out = L.species_loss(sim, ref, A.LossParams())
    got = {r.species: (r.w_loss, r.agb_loss) for r in out.collect()}
    want = {"both": (0.754440379714, 15.0), "sim": (1.692679055268, 20.0), "ref": (0.015440680456, 35.0)}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    r = L.run_loss(L.site_loss(out)).first()
    assert r.num_sites == 1 and math.isclose(r.loss, sum(w + a for w, a in want.values()) + abs(20 - 35 + 20 - 35))


def test_dates(spark):
    D = datetime.date
    df = spark.createDataFrame([(D(2005, 7, 2), D(2000, 1, 1), 1), (D(2020, 2, 29), D(2020, 2, 29), 1)], "measdate date, start_measdate date, age_calc int")
    got = [tuple(r) for r in df.select(C.sim_year(), C.year_deficit()).collect()]
    assert got == [(6, 5), (0, -1)]


def test_uniform_numbers_agree(spark):
    df = spark.range(1000).withColumn("k", F.col("id") * 7 + 1)
    got = np.array([r[0] for r in df.select(uniform(42, "id", F.lit(-3), "k", MORTALITY)).collect()])
    ids = np.arange(1000)
    assert np.allclose(got, uniform_np(42, ids, -3, ids * 7 + 1, MORTALITY), atol=1e-12) or np.abs(got - uniform_np(42, ids, -3, ids * 7 + 1, MORTALITY)).max() < 2 / P
    assert abs(uniform_np(1, np.arange(100_000), 5, np.ones(100_000, int), LIGHT).mean() - 0.5) < 0.01


# ---------------------------------------------------------------- one golden year

def golden_table(longevity=100):
    return dict(eco="e", species="s", local_id=1, d=10.0, s=0.5, longevity=longevity, shade_tol=1, maturity=3, b_max=2500.0, anpp_max=2400.0, prob_mort=0.1, prob_estab=0.0, b_max_eco=2500.0, r1=0.1, r2=0.2, r3=0.3, r4=0.4, r5=0.5)


def golden_sites(year, sem, mort):
    row = golden_table() | {"prob_mort": mort}
    t = Table.of([row])
    s = Sites(np.array([1]), t, np.zeros(3, int), np.zeros(3, int), np.array([9, 49, 99]), np.array([400.0, 600.0, 50.0]), np.array([1, 2, 3]), 1, sem)
    s.step(year)
    return s


@pytest.mark.parametrize(
    ("year", "gr", "bio", "agnpp", "m_tot"),
    [(1, 1.0, (399.950636, 595.957232), 0, 57.092132), (0, 1.0, (339.950636, 505.957232), 0, 207.092132), (1, 0.0, (399.950636, 595.957232), 2220.080642, 2220.080642)],
)
def test_golden_step(spark, year, gr, bio, agnpp, m_tot):
    sem = Semantics(growth_reduction=gr)
    s = golden_sites(year, sem, -1.0)  # no random death
    assert np.allclose(s.bio, bio) and s.age.tolist() == [10, 50] and math.isclose(s.b[0], sum(bio), rel_tol=1e-6)
    assert math.isclose(s.agnpp[0], agnpp, rel_tol=1e-6, abs_tol=1e-9) and math.isclose(s.prev[0], m_tot, rel_tol=1e-6) and s.shade[0] == 3
    cohorts = spark.createDataFrame([(1, "e", 1, "s", 9, 400.0, 0.0), (1, "e", 2, "s", 49, 600.0, 0.0), (1, "e", 3, "s", 99, 50.0, 0.0)], "site long, eco string, seq long, species string, age int, bio double, prev_mortality double")
    steps = stepped(cohorts, spark.createDataFrame([golden_table() | {"prob_mort": -1.0}]), year, 1, sem)
    assert np.allclose(sorted(r.bio for r in survivors(steps).collect()), sorted(bio))
    t = site_totals(steps).first()
    assert math.isclose(t.agnpp, agnpp, rel_tol=1e-6, abs_tol=1e-9) and math.isclose(t.m_tot, m_tot, rel_tol=1e-6) and t.shade_class == 3


# ---------------------------------------------------------------- the kernel against a plain loop

def plain_year(site, live, prev, year, table, seed, sem):
    """One site, one cohort at a time: the cohorts [p, age, bio, key] and the mortality after a year."""
    v = table.values
    u = lambda key, what: float(uniform_np(seed, np.array([site]), year, np.array([key]), what)[0])
    mature = set()
    total, comps = sum(c[2] for c in live), [max(c[2] ** 0.95, 1.0) for c in live]
    left, m_sum, act = [], 0.0, 0.0
    for c, comp in zip(live, comps, strict=True):
        p, age, bio, key = c[0], c[1] + 1, c[2], c[3]
        g = {k: x[p] for k, x in v.items()}
        if age >= g["maturity"]:
            mature.add(p)
        m_age = bio
        if age < g["longevity"] and u(key, MORTALITY) > g["prob_mort"]:
            f = math.exp(g["d"] * (age / g["longevity"] - 1)) + (sem.spinup_mortality if year <= 0 else 0)
            m_age = bio * f if f < 1 else bio
        pot = max(g["b_max"] - total - bio, 1.0)
        pot = max(pot, prev)
        ap = bio / pot
        most = g["anpp_max"] * comp / sum(comps)
        keep = 1 - sem.growth_reduction
        growth = min(ap ** g["s"] * math.exp(1 - ap ** g["s"]), 1.0) * most * keep
        m = most * 2 * ap / (1 + ap) if most <= 1 else most
        anpp = max(growth - m_age, 1.0)
        m_bio = max(max(min(m, bio) * keep - m_age, 0.0), anpp)
        m_sum += m_age + m_bio
        new = bio + anpp - m_age - m_bio
        assert new <= bio - m_age + 1e-9  # a cohort never gains biomass
        if new > 1e-8:
            left.append([p, age, new, key])
            act += new if age > 5 else 0
    had, live, b = bool(live), left, sum(c[2] for c in left)
    if had:
        p0 = next(iter(mature), left[0][0] if left else 0)
        most = v["b_max_eco"][p0]
        share = min(act, most - prev) / most
        shade = sum(share > v[f"r{k}"][p0] for k in range(1, 6))
        prev = m_sum
    if live:
        for p in sorted(mature):
            local = table.local[p]
            if u(local, LIGHT) <= LIGHT_TABLE[shade][int(v["shade_tol"][p]) - 1] and u(local, ESTABLISHMENT) <= v["prob_estab"][p]:
                bio = max(2.0, v["anpp_max"][p] * max(1.0, math.exp(-1.6 * b / v["b_max_eco"][p])))
                b += bio
                live.append([p, 1, bio, int(added_key(year, local))])
    return live, prev


def plain_years(ids, cohorts, table, years, seed, sem):
    """cohorts: {site: [(p, age, bio, key)]}."""
    out = {}
    for site in ids:
        live, prev = [list(c) for c in cohorts[site]], 0.0
        for year in years:
            live, prev = plain_year(site, live, prev, year, table, seed, sem)
            out[site, year] = sorted((c[0], c[1], round(c[2], 6), c[3]) for c in live)
    return out


def plain_spin_up(site, established, first, last, table, seed, sem):
    """established: [(p, year_deficit)] of one site; its cohorts in year -1."""
    live, prev = [], 0.0
    for t in range(first, last + 1):
        young = {c[0] for c in live if c[1] == 1 and int(added_key(t - 1, 0)) < c[3] < int(added_key(t - 1, HALF))}
        for p in sorted({p for p, d in established if d + 1 == t} - young):
            live.append([p, 1, max(2.0, table.values["b_max"][p]), int(added_key(t, HALF + table.local[p]))])
        if t < last:
            live, prev = plain_year(site, live, prev, t, table, seed, sem)
    return sorted((c[0], c[1], round(c[2], 6), c[3]) for c in live)


def small_world(seed, n=12):
    rng = np.random.default_rng(seed)
    rows = [golden_table(int(rng.integers(60, 200))) | dict(eco="e", species=f"s{i}", local_id=i + 1, d=float(rng.uniform(5, 25)), s=float(rng.uniform(0.1, 1)), shade_tol=int(rng.integers(1, 6)), maturity=int(rng.integers(2, 30)), b_max=float(rng.uniform(2400, 2500)), anpp_max=float(rng.uniform(2400, 2500)), prob_mort=float(rng.uniform(0, 0.2)), prob_estab=float(rng.uniform(0.2, 1))) for i in range(4)]
    sites = {i + 1: [(int(rng.integers(4)), int(rng.integers(1, 60)), float(rng.uniform(0.5, 600)), k + 1) for k in range(int(rng.integers(1, 6)))] for i in range(n)}
    return rows, sites


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([0.0, 1.0]))
def test_kernel_matches_plain_loop(seed, gr):
    rows, sites = small_world(seed)
    t, sem, ids = Table.of(rows), Semantics(growth_reduction=gr), np.array(sorted(sites))
    flat = [(i, *c) for i, s in enumerate(ids) for c in sites[s]]
    a = [np.array([f[k] for f in flat]) for k in range(5)]
    s = Sites(ids, t, a[0], a[1], a[2], a[3], a[4], 7, sem)
    want = plain_years(ids, sites, t, range(-2, 6), 7, sem)
    for y in range(-2, 6):
        s.step(y)
        assert np.isclose(s.b, np.bincount(s.site, weights=s.bio, minlength=len(ids)), atol=1e-6).all() and ((s.shade >= 0) & (s.shade <= 5)).all()
        for i, site in enumerate(ids):
            m = s.site == i
            got = sorted(zip(s.p[m].tolist(), s.age[m].tolist(), np.round(s.bio[m], 6).tolist(), s.key[m].tolist(), strict=True))
            assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want[site, y]]
            assert np.allclose([g[2] for g in got], [w[2] for w in want[site, y]], atol=2e-6)


def test_simulation_ignores_partitioning_and_agrees_with_columns(spark):
    rows, sites = small_world(5, 30)
    cells = [(s, "e", k, f"s{p}", a, b, 0.0) for s, cs in sites.items() for p, a, b, k in cs]
    df = spark.createDataFrame(cells, "site long, eco string, seq long, species string, age int, bio double, prev_mortality double")
    table = parameter_table(spark.createDataFrame(rows))
    key = lambda d: sorted((r.year, r.mapcode, r.species, r.seq, r.age, round(r.biomass, 6)) for r in d.collect())
    one = key(run(gathered(df).coalesce(1), [table], range(4), 3))
    assert one == key(run(gathered(df).repartition(7), [table], range(4), 3)) and len(one) > 50
    state = df
    for y in range(2):
        state = one_year(state, spark.createDataFrame(rows), y, 3)
    cols = sorted((1, r.site, r.species, r.seq, r.age, r.bio) for r in state.collect())
    same = sorted(r for r in one if r[0] == 1)
    assert [c[:5] for c in cols] == [r[:5] for r in same] and np.allclose([c[5] for c in cols], [r[5] for r in same], atol=1e-5)


def test_spin_up(spark):
    t = Table.of([golden_table() | dict(prob_mort=-1.0, prob_estab=0.0), golden_table() | dict(species="t", local_id=2, prob_mort=-1.0, prob_estab=0.0)])
    s = Sites(np.array([1, 2]), t, *(np.empty(0, int),) * 3, np.empty(0), np.empty(0, int), 1, Semantics())
    s.spin_up(np.array([0, 0, 0, 1]), np.array([0, 0, 1, 1]), np.array([-4, -4, -2, -3]), -3, -1)
    got = sorted(zip(s.site.tolist(), s.p.tolist(), s.age.tolist(), strict=True))
    assert got == [(0, 0, 3), (0, 1, 1), (1, 1, 2)]  # one of two equal cohorts, none stepped after the last


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([0.0, 1.0]))
def test_spin_up_matches_plain_loop(seed, gr):
    rows, _ = small_world(seed)
    rng, t, sem = np.random.default_rng(seed), Table.of(rows), Semantics(growth_reduction=gr)
    ids = np.arange(1, 8)
    site, p, deficit = rng.integers(0, len(ids), 30), rng.integers(0, 4, 30), rng.integers(-45, -1, 30)
    first, last = int(deficit.min()) + 1, -1
    s = Sites(ids, t, *(np.empty(0, int),) * 3, np.empty(0), np.empty(0, int), 7, sem)
    s.spin_up(site, p, deficit, first, last)
    for i, k in enumerate(ids):
        m = s.site == i
        got = sorted(zip(s.p[m].tolist(), s.age[m].tolist(), np.round(s.bio[m], 6).tolist(), s.key[m].tolist(), strict=True))
        want = plain_spin_up(int(k), [(int(a), int(d)) for x, a, d in zip(site, p, deficit, strict=True) if x == i], first, last, t, 7, sem)
        assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=2e-6)


# ---------------------------------------------------------------- search

def test_first_candidate_is_accepted_and_average_reset():
    sch = S.Schedule(initial_t=10.0)
    s, taken, record = S.offer(sch.starts(), 5.0, 0.5, sch)
    assert taken and record and s.best == 5.0 and math.isinf(s.diff_avg)
    s, taken, record = S.offer(replace(s, i=2), 6.0, 0.999, sch)
    assert not taken and not record and s.diff_avg == 1.0 and math.isclose(s.prob_avg, math.exp(-0.1))
    s, *_ = S.offer(replace(s, i=3), 5.0, 0.999, sch)
    assert math.isclose(s.diff_avg, 0.9) and math.isclose(s.prob_avg, 0.9 * math.exp(-0.1) + 0.1)


def test_reheat_and_stop():
    sch = S.Schedule(initial_t=100.0, reheat_after=3, max_iter=50, alpha=0.5, min_t=1.0)
    s = S.State(t=1.0, current=0.0, best=0.0)
    for i in range(1, 4):
        assert s.t == 1.0
        s, *_ = S.offer(replace(s, i=i), 1e6, 0.5, sch)
    assert s.t == 100.0 and s.cold == 0
    n, over = -1, False
    while not over:
        s, over = S.cool(s, sch)
        n += 1
    assert n == 6 and s.t < 1.0
    assert S.accepts("TA", 0.5, 1.0, 0.99) and not S.accepts("TA", 1.5, 1.0, 0.0)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 1000), st.integers(1, 7))
def test_best_never_rises(seed, batch):
    rng, seen = np.random.default_rng(seed), []
    sch = S.Schedule(max_iter=60, initial_t=1.0)
    at = S.search(S.Progress(sch.starts(), 0.0, 0.0, np.random.default_rng(seed)), lambda x, n: [x + rng.normal() for _ in range(n)], lambda xs: [(x - 3) ** 2 for x in xs], sch, batch, lambda s, fx, ok: seen.append(s.best))
    assert seen == sorted(seen, reverse=True) and len(seen) == 60 and at.state.i == 61 and math.isclose((at.best - 3) ** 2, at.state.best)


def test_priors_and_mutation(spark):
    pairs = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y")], "eco string, species string")
    p = Params.draw(pairs, 3)
    for q in PRIORS:
        x = p.values[q.name]
        assert len(x) == p.size(q) and ((x >= q.low) & (x <= q.high)).all() and (not q.whole or (x == np.floor(x)).all())
    rng, names = np.random.default_rng(1), set()
    for _ in range(400):
        m = p.mutate(rng)
        changed = [(n, int((m.values[n] != p.values[n]).sum())) for n in p.values if not np.array_equal(m.values[n], p.values[n])]
        assert len(changed) <= 1 and all(k == 1 for _, k in changed)
        names |= {n for n, _ in changed}
    assert names == {q.name for q in PRIORS}  # every parameter can be drawn, the last one too
    assert Params.from_json(p.to_json()).values["d"].tolist() == p.values["d"].tolist()
    t = eco_params(*p.tables(spark)).collect()
    assert len(t) == 3 and all(r.b_max_eco == max(x.b_max for x in t if x.eco == r.eco) and r.r1 < r.r5 for r in t)


def test_keys_of_added_cohorts_fit():
    """Thousands of species in an ecoregion keep keys apart; what doesn't fit is an error."""
    assert int(added_key(5, np.int64(99_999))) < int(added_key(5, np.int64(100_001))) < int(added_key(6, np.int64(1)))
    with pytest.raises(ValueError):
        added_key(5_000, np.int64(1))
    with pytest.raises(ValueError):
        Table.of([golden_table() | {"local_id": 100_000}])


def test_a_site_is_bounded(spark, monkeypatch):
    from understory.operators import simulate

    df = spark.createDataFrame([(1, "e", k, "s", 1, 1.0) for k in range(4)], "site long, eco string, seq long, species string, age int, bio double")
    assert simulate.gathered(df).count() == 1
    monkeypatch.setattr(simulate, "MAX_SITE", 3)
    with pytest.raises(Exception, match="more than 3 cohorts"):
        simulate.gathered(df).collect()
