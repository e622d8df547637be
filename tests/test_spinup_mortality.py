"""The calibrated spin-up mortality reaches the score of its candidate."""

from dataclasses import replace

import numpy as np
from test_model import golden_table, small_world

from understory.functions import agecdf as A
from understory.operators import search as S
from understory.operators.kernel import Sites, Table
from understory.operators.params import Params
from understory.operators.simulate import gathered, with_truth
from understory.operators.succession import Semantics


def stepped(table, sem, year):
    s = Sites(np.array([1]), table, np.zeros(2, int), np.zeros(2, int), np.array([9, 49]), np.array([400.0, 600.0]), np.array([1, 2]), 1, sem)
    s.step(year)
    return s.bio.tolist()


def test_the_table_rules_up_to_year_0():
    t = Table.of([golden_table() | {"prob_mort": -1.0}])
    own, default = replace(t, spinup_mortality=0.02), Semantics()
    assert stepped(own, default, 0) == stepped(t, Semantics(spinup_mortality=0.02), 0) != stepped(t, default, 0)
    assert stepped(replace(t, spinup_mortality=0.0), default, 0) == stepped(t, default, 1)
    assert stepped(own, default, 1) == stepped(t, default, 1)


def test_candidates_that_differ_in_it_alone_differ_in_loss(spark):
    rows, sites = small_world(2, 6)
    pairs = spark.createDataFrame([(r["eco"], r["species"]) for r in rows], "eco string, species string")
    df = spark.createDataFrame([(s, "e", k, f"s{p}", a, b) for s, cs in sites.items() for p, a, b, k in cs], "site long, eco string, seq long, species string, age int, bio double")
    ref = spark.createDataFrame([(s, 0, "s0", 50.0, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 1.0]) for s in sites], "site long, year int, species string, agb double, cdf array<double>")
    p = Params.draw(pairs, 1)
    batch = [p, *(Params(p.species, p.ecos, p.pairs, p.values | {"spinup_mortality": np.array([x])}) for x in (0.02, 0.15))]
    score = lambda candidates, sem=Semantics(): {r.candidate: round(r.loss, 6) for r in S.score_candidates(candidates, with_truth(gathered(df), ref), [0], A.LossParams(), 5, sem).collect()}
    got = score(batch)
    assert got[0] == got[2] != got[1]
    assert got == score(batch, Semantics(spinup_mortality=0.3))  # the candidates' own value is what counts
