"""Simulated annealing as a driver-side state machine, and calibration in batches of candidates.

A batch draws its candidates from the current parameters and scores them in one Spark job; they are then
offered to the state machine one after the other. Batches of one give the sequential search; larger ones
change which proposals are seen, not the rules.
"""

from __future__ import annotations

import json
import logging
import math
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame

from understory.functions.agecdf import LossParams
from understory.operators import loss as L
from understory.operators.kernel import Table
from understory.operators.params import Params
from understory.operators.simulate import losses, with_truth
from understory.operators.succession import Semantics
from understory.session import load_text, save_text

log = logging.getLogger("understory")


@dataclass(frozen=True)
class Schedule:
    max_iter: int = 1000
    initial_t: float = 1e4
    min_t: float = 0.01
    alpha: float = 0.9992
    rule: str = "SA"  # or TA, threshold accepting
    average: float = 0.9
    reheat_below: float = 0.01
    reheat_after: int = 100

    def starts(self) -> State:
        return State(t=self.initial_t)


@dataclass(frozen=True)
class State:
    """Temperature, losses and running averages before trial ``i``."""

    t: float
    i: int = 1
    current: float = math.inf
    best: float = math.inf
    current_at: int = 0
    best_at: int = 0
    diff_avg: float = 0.0
    prob_avg: float = 0.0
    cold: int = 0


@dataclass
class Progress:
    """Where a search stands: its state, the candidates of the current and best loss, and its random numbers."""

    state: State
    current: object
    best: object
    draws: np.random.Generator = field(default_factory=np.random.default_rng)


def chance(diff: float, t: float) -> float:
    """How likely annealing is to take a step that changes the loss by ``diff``."""
    return 1.0 if diff <= 0 else math.exp(-diff / t)


def averaged(s: State, diff: float, keep: float) -> State:
    """The running averages with one more step; an average that is infinite, or of no step yet, starts with it."""
    p = chance(diff, s.t)
    if s.i == 1 or math.isinf(s.diff_avg):
        return replace(s, diff_avg=diff, prob_avg=p)
    blend = lambda old, new: keep * old + (1 - keep) * new
    return replace(s, diff_avg=blend(s.diff_avg, diff), prob_avg=blend(s.prob_avg, p))


def reheated(s: State, schedule: Schedule) -> State:
    """Back to the initial temperature when hardly anything was accepted for many trials in a row."""
    cold = s.cold + 1 if s.prob_avg < schedule.reheat_below else 0
    return replace(s, cold=0, t=schedule.initial_t) if cold >= schedule.reheat_after else replace(s, cold=cold)


def accepts(rule: str, diff: float, t: float, u: float) -> bool:
    """Improvements are always taken; beyond them threshold accepting looks at the size, annealing at a chance."""
    return diff < 0 or (diff < t if rule == "TA" else chance(diff, t) > u)


def offer(s: State, fx: float, u: float, schedule: Schedule) -> tuple[State, bool, bool]:
    """The state after comparing a candidate's loss with the current one, whether it was accepted, whether it is the best."""
    diff = fx - s.current
    s = reheated(averaged(s, diff, schedule.average), schedule)
    taken = accepts(schedule.rule, diff, s.t, u)
    record = taken and fx < s.best
    if taken:
        s = replace(s, current=fx, current_at=s.i)
    return (replace(s, best=fx, best_at=s.i) if record else s), taken, record


def cool(s: State, schedule: Schedule) -> tuple[State, bool]:
    """The next trial at a lower temperature, and whether the search is over."""
    t = s.t * schedule.alpha
    return replace(s, t=t, i=s.i + 1), t < schedule.min_t or s.i >= schedule.max_iter


def search(at: Progress, neighbours: Callable[[object, int], Sequence], score: Callable[[Sequence], Sequence[float]], schedule: Schedule, batch: int = 1, after: Callable[[State, float, bool], None] | None = None, between: Callable[[Progress], None] | None = None) -> Progress:
    """The annealing loop over any candidates, from where ``at`` stands. ``after`` sees every trial, ``between`` the
    progress after every batch, which is a place to resume from."""
    over = at.state.i > schedule.max_iter or at.state.t < schedule.min_t
    while not over:
        proposals = list(neighbours(at.current, min(batch, schedule.max_iter - at.state.i + 1)))
        for x, fx in zip(proposals, score(proposals), strict=True):
            s, taken, record = offer(at.state, float(fx), float(at.draws.random()), schedule)
            at.current, at.best = x if taken else at.current, x if record else at.best
            if after:
                after(s, float(fx), taken)
            at.state, over = cool(s, schedule)
            if over:
                break
        if between:
            between(at)
    return at


def table_of(p: Params) -> Table:
    """A candidate as a kernel table, made on the driver without a job."""
    return replace(Table.of(p.rows()), spinup_mortality=float(p.values["spinup_mortality"][0]))


def score_candidates(candidates: Sequence[Params], sites: DataFrame, years: Sequence[int], params: LossParams, seed: int, sem: Semantics = Semantics()) -> DataFrame:
    """(candidate, loss, num_sites) of a batch over sites ``with_truth``, in one job that moves only sums."""
    return L.run_loss(losses(sites, [table_of(c) for c in candidates], years, params, seed, sem))


def calibrate(first: Params, sites: DataFrame, reference: DataFrame, years: Sequence[int], params: LossParams = LossParams(), schedule: Schedule = Schedule(initial_t=1e3), batch: int = 8, seed: int = 1337, output: str | None = None, every: int = 10, sem: Semantics = Semantics()) -> tuple[Params, State, list[dict]]:
    """Anneal over parameter sets; ``sites`` are gathered, ``reference`` is (site, year, species, agb, cdf).

    Writes best_params.json and search.json to ``output``, a folder of any file system, after at least every ``every``
    trials and at the end, interrupted or not. If they are there, the search goes on as if it had never stopped: with
    its current candidate, its temperature and its random numbers.
    """
    spark = sites.sparkSession
    rng = np.random.default_rng(seed)
    at = Progress(schedule.starts(), first, first, np.random.default_rng(seed + 1))
    saved = load_text(spark, f"{output}/search.json") if output else None
    if saved:
        d = json.loads(saved)
        at.state, at.current, at.best = State(**d["state"]), Params.of_dict(d["current"]), Params.of_dict(d["best"])
        rng.bit_generator.state, at.draws.bit_generator.state = d["proposals"], d["draws"]
    joined = with_truth(sites, reference).persist()  # read by every batch
    trace: list[dict] = []
    last_saved, proposals = at.state.i, rng.bit_generator.state  # the latter before a batch that may be interrupted

    def save(p: Progress) -> None:
        nonlocal last_saved
        if output:
            save_text(spark, f"{output}/best_params.json", p.best.to_json())
            whole = {"state": asdict(p.state), "current": p.current.to_dict(), "best": p.best.to_dict(), "proposals": proposals, "draws": p.draws.bit_generator.state}
            save_text(spark, f"{output}/search.json", json.dumps(whole))
        last_saved = p.state.i

    def between(p: Progress) -> None:
        nonlocal proposals
        proposals = rng.bit_generator.state
        log.info("trial %d of %d: current %.6g, best %.6g, temperature %.4g", p.state.i - 1, schedule.max_iter, p.state.current, p.state.best, p.state.t)
        if p.state.i - last_saved >= every:
            save(p)

    def score(batch_of: Sequence[Params]) -> list[float]:
        # losses count to 12 digits: beyond them they depend on the order in which tasks are added up, and equal ones would differ
        rows = {r["candidate"]: float(f"{r['loss']:.11e}") for r in score_candidates(batch_of, joined, years, params, seed, sem).collect()}
        return [rows.get(c, math.inf) for c in range(len(batch_of))]

    def after(s: State, fx: float, accepted: bool) -> None:
        trace.append({"trial": s.i, "loss": fx, "accepted": accepted, "t": s.t, "current": s.current, "best": s.best})

    try:
        search(at, lambda p, n: [p.mutate(rng) for _ in range(n)], score, schedule, batch, after, between)
    finally:
        save(at)
        joined.unpersist()
    return at.best, at.state, trace
