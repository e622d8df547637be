"""Implausible readings per source: a hidden Markov model with hard bounds.

Every source (crew) is a chain of readings in the order of its records. The hidden states are normal, spike,
stuck and out of range; a reading is flagged if its forward-backward probability of being normal is below one
half, and its kind is the likeliest other state. All that the states emit comes from the source itself:

* normal: log2(reading) lies around the typical reading (median) of the crew with its usual deviation
  (1.4826 x the median absolute deviation), both over its possible readings and to 1/256 octave. The
  distribution ends at five deviations: what lies beyond isn't normal by definition;
* spike: spread widely beyond five deviations;
* stuck: a value like a normal one that is repeated for certain. Normal readings repeat their forerunner at the
  crew's own rate r, the chance that two of its readings fall together. A crew gets stuck only where its value
  changes, with odds of r ** 4.5, and gets free only where it changes again: so the odds of a run of n equal
  readings are r ** (5.5 - n), and six is the shortest run that is rather stuck than normal, whatever the crew;
* out of range: hard bounds, age below 1 or above 1,500, agb below zero or not finite.

The chain of a source may span any number of partitions. A partition is worked on in chunks of CHUNK rows, blocks of
readings side by side; between chunks only a last value and a 4 x 4 transfer matrix travel, at most four small rows
per chunk and field, which the driver links.

Null readings and absent ages are passed over. A null crew is a source of its own, rows without cohort_id
have no place in the order and are left out, repeated cohorts count once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from understory.operators.absent import is_absent, recurring_codes
from understory.session import cut, width

FIELDS = ("age_calc", "agb")
#: Possible readings, both bounds included.
BOUNDS = {"age_calc": (1.0, 1500.0), "agb": (0.0, float(np.finfo(float).max))}
OCTAVE = 256
#: Where a normal reading ends, the shortest run that counts as stuck, and the probability that flags.
DEVIATIONS, RUN, FLAGGED = 5.0, 6, 0.5
BLOCK = 64
#: Rows of a partition that are in memory at once.
CHUNK = 1 << 20
#: A table of this many sources is broadcast (56 bytes each); more sources are joined by shuffle, salted.
BROADCAST_SOURCES, SALTS = 200_000, 16
NO_SOURCE = -(2**63)
STATES = ("normal", "spike", "stuck", "out_of_range")
STUCK = STATES.index("stuck")
#: From state to state where the value changes, apart from getting stuck, which depends on the crew.
BASE = np.array([[0.985, 0.010, 0.0, 0.005], [0.90, 0.085, 0.0, 0.015], [0.985, 0.010, 0.0, 0.005], [0.90, 0.03, 0.0, 0.07]])
#: Bounds of a crew's rate of repetition, and what a state that can't emit a reading emits.
RATES, NEVER = (1e-3, 0.5), 1e-20
SCHEMA = "cohort_id long, crew_id long, field string, reading double, kind string, probability double"
EDGES = pa.schema([("pid", pa.int32()), ("chunk", pa.int32()), ("field", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("seen", pa.bool_()), ("tail", pa.float64())])
TRANSFERS = pa.schema([("pid", pa.int32()), ("chunk", pa.int32()), ("field", pa.string()), ("m", pa.list_(pa.float64())), ("w", pa.list_(pa.float64()))])


def _stationary() -> np.ndarray:
    p = np.ones(4) / 4
    for _ in range(500):
        p = p @ BASE
    return p


def entry_odds(rate: np.ndarray) -> np.ndarray:
    """The probability of getting stuck where the value changes."""
    odds = np.clip(rate, *RATES) ** (RUN - 1.5)
    return odds / (1 + odds)


def ordered_readings(cohorts: DataFrame) -> DataFrame:
    """(crew, cohort_id, age_calc, agb) once per cohort, range-partitioned and sorted by (crew, cohort_id)."""
    codes = recurring_codes(cohorts, {"age_calc": "age"})["age_calc"]
    rows = cohorts.filter("cohort_id is not null").select(
        F.coalesce(F.col("crew_id").cast("long"), F.lit(NO_SOURCE)).alias("crew"), F.col("cohort_id").cast("long").alias("cohort_id"),
        F.when(~is_absent("age_calc", codes), F.col("age_calc")).cast("double").alias("age_calc"), F.col("agb").cast("double").alias("agb"),
    )
    once = rows.repartitionByRange(width(rows), "crew", "cohort_id").dropDuplicates(["crew", "cohort_id"])
    return cut(once.sortWithinPartitions("crew", "cohort_id"))


def normal_ranges(readings: DataFrame) -> DataFrame:
    """(crew, <field>_mid, <field>_dev, <field>_rate), the first two in octaves, from mergeable histograms of log2(reading)."""
    parts = [F.struct(F.lit(f).alias("field"), F.col(f).alias("x")) for f in FIELDS]
    possible = " or ".join(f"(field = '{f}' and x > 0 and x >= {lo!r} and x <= {hi!r})" for f, (lo, hi) in BOUNDS.items())
    hist = (
        readings.select("crew", F.explode(F.array(*parts)).alias("e")).select("crew", "e.*").filter(possible)
        .withColumn("bin", F.round(F.log2("x") * OCTAVE).cast("int"))
        .groupBy("crew", "field", "bin").agg(F.count("*").alias("n"))
    )

    def median_of(df: DataFrame, at: str, name: str) -> DataFrame:
        whole = Window.partitionBy("crew", "field")
        cum = F.sum("n").over(whole.orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        x = df.withColumn("_c", cum).withColumn("_n", F.sum("n").over(whole))
        low = F.min(F.when(F.col("_c") >= F.floor((F.col("_n") + 1) / 2), F.col(at))).over(whole)
        high = F.min(F.when(F.col("_c") >= F.floor(F.col("_n") / 2) + 1, F.col(at))).over(whole)
        return x.withColumn(name, (low + high) / 2).drop("_c", "_n")

    mid = median_of(hist, "bin", "mid").withColumn("off", F.abs(F.col("bin") - F.col("mid")))
    share = F.col("n").cast("double")
    both = median_of(mid, "off", "mad").groupBy("crew", "field").agg(F.first("mid").alias("mid"), F.first("mad").alias("mad"), (F.sum(share * share) / F.sum(share) / F.sum(share)).alias("rate"))
    dev = F.greatest(F.col("mad") * 1.4826, F.lit(1.0))
    of = {"mid": F.col("mid") / OCTAVE, "dev": dev / OCTAVE, "rate": F.col("rate")}
    return both.groupBy("crew").agg(*(F.max(F.when(F.col("field") == f, x)).alias(f"{f}_{k}") for f in FIELDS for k, x in of.items()))


def emissions(field: str, x: np.ndarray, mid: np.ndarray, dev: np.ndarray, rate: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Likelihood of every reading in every state."""
    lo, hi = BOUNDS[field]
    impossible = ~((x >= lo) & (x <= hi))
    with np.errstate(all="ignore"):
        z = np.abs(np.log2(np.where(impossible, 1.0, x)) - mid) / dev
    z = np.minimum(np.where(np.isnan(z) | impossible, 0.0, z), 1e3)
    far = z > DEVIATIONS
    e = np.full((len(x), 4), NEVER)
    e[:, 0] = np.where(far, NEVER, 0.3989 * np.exp(-0.5 * np.minimum(z, DEVIATIONS) ** 2))
    e[:, 1] = np.where(far, 1 / (10 * np.pi * (1 + (z / 10) ** 2)), NEVER)
    e[:, STUCK] = e[:, 0]
    e[impossible] = (NEVER, NEVER, NEVER, 1.0)
    again = np.where(same, np.clip(rate, *RATES), 1.0)
    e[:, [0, 1, 3]] *= again[:, None]
    return e


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(v.sum(-1, keepdims=True), 1e-300)


def ahead(a: np.ndarray, same: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """State weights one step on: where the value is the same, stuck stays stuck and nothing gets stuck."""
    free = a.copy()
    free[..., STUCK] = np.where(same, 0.0, a[..., STUCK])
    out = (free @ BASE) * np.where(same, 1.0, 1 - entry)[..., None]
    out[..., STUCK] = np.where(same, a[..., STUCK], entry * a.sum(-1))
    return out


def behind(y: np.ndarray, same: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """The same step backwards, for the likelihood of what follows."""
    out = y @ BASE.T
    out = np.where(same[..., None], out, (1 - entry)[..., None] * out + (entry * y[..., STUCK])[..., None])
    out[..., STUCK] = np.where(same, y[..., STUCK], out[..., STUCK])
    return out


class Chain:
    """The readings of one field in blocks of BLOCK, none of which spans two crews."""

    def __init__(self, e: np.ndarray, same: np.ndarray, entry: np.ndarray, seg: np.ndarray) -> None:
        first = np.flatnonzero(np.diff(seg, prepend=-1))
        sizes = np.diff(np.append(first, len(seg)))
        per = -(-sizes // BLOCK)
        self.of = np.repeat(np.arange(len(first)), per)
        nth = np.arange(len(self.of)) - np.repeat(np.cumsum(per) - per, per)
        at = first[self.of] + nth * BLOCK
        self.n = np.minimum(BLOCK, first[self.of] + sizes[self.of] - at)
        ix = np.minimum(at[:, None] + np.arange(BLOCK)[None, :], len(e) - 1)
        self.e, self.same, self.entry, self.nth = e[ix], same[ix], entry[at], nth

    def transfers(self) -> np.ndarray:
        """The product of the steps of every block, scaled to a largest entry of 1."""
        p = np.broadcast_to(np.eye(4), (len(self.n), 4, 4)).copy()
        for t in range(int(self.n.max(initial=0))):
            q = ahead(p, self.same[:, t, None], self.entry[:, None]) * self.e[:, t, None, :]
            q /= np.maximum(q.max((1, 2), keepdims=True), 1e-300)
            p = np.where((t < self.n)[:, None, None], q, p)
        return p

    def posterior(self, alpha: np.ndarray | None, beta: np.ndarray | None) -> np.ndarray:
        """Probabilities of the states of every reading; alpha enters the first crew, beta the last."""
        p, nb = self.transfers(), len(self.n)
        a_in, b_in = np.tile(_stationary(), (nb, 1)), np.ones((nb, 4))
        if alpha is not None:
            a_in[0] = alpha
        if beta is not None:
            b_in[-1] = beta
        order = np.argsort(self.nth, kind="stable")
        most = int(self.nth.max())
        cuts = np.searchsorted(self.nth[order], np.arange(most + 2))
        for k in range(1, most + 1):
            i = order[cuts[k] : cuts[k + 1]]
            a_in[i] = _unit((a_in[i - 1][:, None, :] @ p[i - 1])[:, 0])
        for k in range(most, 0, -1):
            i = order[cuts[k] : cuts[k + 1]]
            b_in[i - 1] = _unit((p[i] @ b_in[i][:, :, None])[:, :, 0])
        fwd, longest = np.empty((nb, BLOCK, 4)), int(self.n.max())
        a = a_in
        for t in range(longest):
            a = np.where((t < self.n)[:, None], _unit(ahead(a, self.same[:, t], self.entry) * self.e[:, t]), a)
            fwd[:, t] = a
        out = np.empty((nb, BLOCK, 4))
        b = b_in
        for t in range(longest - 1, -1, -1):
            out[:, t] = fwd[:, t] * b
            b = np.where((t < self.n)[:, None], _unit(behind(self.e[:, t] * b, self.same[:, t], self.entry)), b)
        return _unit(out[np.arange(BLOCK)[None, :] < self.n[:, None]])


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """A partition in chunks of ``rows`` rows, numbered: columns as arrays, null readings masked."""
    held: list[pa.RecordBatch] = []
    no = size = 0

    def arrays(t: pa.Table) -> dict[str, np.ndarray]:
        cols: dict[str, np.ndarray] = {}
        for name in t.column_names:
            c = t[name]
            if name in FIELDS:
                cols[f"{name}?"] = c.is_valid().to_numpy()
            cols[name] = (c.fill_null(0) if c.null_count and name in FIELDS else c).to_numpy()
        return cols

    for b in batches:
        while b.num_rows:
            part = b.slice(0, rows - size)
            held.append(part)
            size += part.num_rows
            b = b.slice(part.num_rows)
            if size == rows:
                yield no, arrays(pa.Table.from_batches(held))
                held, size, no = [], 0, no + 1
    if size:
        yield no, arrays(pa.Table.from_batches(held))


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean", pa.float64(): "double"}
    return ", ".join(f"{f.name} {names.get(f.type, 'array<double>')}" for f in schema)


def edges_of(cols: dict[str, np.ndarray], place: dict) -> Iterator[dict]:
    """Per field: the first and last crew of a chunk and the last reading of the last crew, if it has one here."""
    crew = cols["crew"]
    for f in FIELDS:
        x = cols[f][(crew == crew[-1]) & cols[f"{f}?"]]
        yield place | {"field": f, "first": int(crew[0]), "last": int(crew[-1]), "seen": bool(len(x)), "tail": float(x[-1]) if len(x) else None}


def _in_order(rows: list[dict], f: str) -> list[dict]:
    return sorted((r for r in rows if r["field"] == f), key=lambda r: (r["pid"], r["chunk"]))


def link_edges(rows: list[dict]) -> dict[tuple[int, int, str], float]:
    """Per (partition, chunk, field): the last reading of its first crew before it."""
    out: dict[tuple[int, int, str], float] = {}
    for f in FIELDS:
        crew, value = None, None
        for r in _in_order(rows, f):
            if crew == r["first"] and value is not None:
                out[r["pid"], r["chunk"], f] = value
            if r["seen"]:
                value = r["tail"]
            elif crew != r["last"]:
                value = None
            crew = r["last"]
    return out


def link_transfers(rows: list[dict], edges: list[dict]) -> dict[tuple[int, int, str], tuple]:
    """Per (partition, chunk, field): the forward vector that enters its first crew, the backward vector that enters its last."""
    steps = {(r["pid"], r["chunk"], r["field"]): (np.array(r["m"]).reshape(4, 4), np.array(r["w"]).reshape(4, 4)) for r in rows}
    into: dict = {}
    from_behind: dict = {}
    for f in FIELDS:
        chain = _in_order(edges, f)
        for forward, out in ((True, into), (False, from_behind)):
            crew, v = None, None
            for r in chain if forward else chain[::-1]:
                near, far = (r["first"], r["last"]) if forward else (r["last"], r["first"])
                key = (r["pid"], r["chunk"], f)
                v = v if crew == near else None
                out[key] = v
                m = steps[key][1 if forward else 0]  # of the crew at the far end
                fresh = _stationary() if forward else np.ones(4)
                v = v if near == far and v is not None else fresh
                crew, v = far, _unit(v @ m if forward else m @ v)
    return {k: (into[k], from_behind[k]) for k in into}


def prepare(cols: dict[str, np.ndarray], f: str, before: float | None) -> dict[str, np.ndarray]:
    """Readings, repetitions and emissions of one field of a chunk. ``before``: the reading before of its first crew."""
    at = np.flatnonzero(cols[f"{f}?"])
    x, crew = cols[f][at], cols["crew"][at]
    same = np.zeros(len(x), bool)
    same[1:] = (crew[1:] == crew[:-1]) & (x[1:] == x[:-1])
    if len(x) and before is not None and crew[0] == cols["crew"][0]:
        same[0] = x[0] == before
    rate = np.nan_to_num(cols[f"{f}_rate"][at].astype(float), nan=RATES[0])
    e = emissions(f, x, cols[f"{f}_mid"][at].astype(float), np.maximum(cols[f"{f}_dev"][at].astype(float), 1e-9), rate, same)
    return {"at": at, "x": x, "crew": crew, "same": same, "entry": entry_odds(rate), "e": e}


def transfers_of(cols: dict[str, np.ndarray], place: dict, links: dict) -> Iterator[dict]:
    """Per field: the transfer matrices of the readings of the first crew of a chunk and of those of the last."""
    own = np.flatnonzero((cols["crew"] == cols["crew"][0]) | (cols["crew"] == cols["crew"][-1]))
    edge = {k: v[own] for k, v in cols.items()}
    for f in FIELDS:
        r = prepare(edge, f, links.get((place["pid"], place["chunk"], f)))
        ends = []
        for crew in (edge["crew"][0], edge["crew"][-1]):
            mine, m = np.flatnonzero(r["crew"] == crew), np.eye(4)
            if len(mine):
                for p in Chain(r["e"][mine], r["same"][mine], r["entry"][mine], np.zeros(len(mine), int)).transfers():
                    m = m @ p
                    m /= max(m.max(), 1e-300)
            ends.append(m.ravel().tolist())
        yield place | {"field": f, "m": ends[0], "w": ends[1]}


def flags_of(cols: dict[str, np.ndarray], place: dict, links: dict, vectors: dict) -> Iterator[pa.Table]:
    for f in FIELDS:
        key = (place["pid"], place["chunk"], f)
        r = prepare(cols, f, links.get(key))
        if not len(r["x"]):
            continue
        alpha, beta = vectors.get(key, (None, None))
        alpha = alpha if r["crew"][0] == cols["crew"][0] else None
        beta = beta if r["crew"][-1] == cols["crew"][-1] else None
        seg = np.cumsum(np.append(True, r["crew"][1:] != r["crew"][:-1])) - 1
        states = Chain(r["e"], r["same"], r["entry"], seg).posterior(alpha, beta)
        off = 1 - states[:, 0]
        hit = np.flatnonzero(off > FLAGGED)
        kind = states[hit, 1:].argmax(1) + 1
        rows = r["at"][hit]
        yield pa.table({
            "cohort_id": cols["cohort_id"][rows], "crew_id": pa.array(r["crew"][hit], mask=r["crew"][hit] == NO_SOURCE),
            "field": pa.array([f] * len(hit), pa.string()), "reading": r["x"][hit],
            "kind": pa.array([STATES[k] for k in kind], pa.string()), "probability": off[hit],
        })


def _per_chunk(readings: DataFrame, rows: int, of: Callable[[dict, dict], Iterator[dict]], schema: pa.Schema) -> list[dict]:
    """The small rows that ``of`` makes of every chunk, on the driver: two per chunk of ``rows`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        for no, cols in _chunks(batches, rows):
            yield pa.RecordBatch.from_pylist(list(of(cols, {"pid": pid, "chunk": no})), schema)

    return [r.asDict() for r in readings.mapInArrow(run, _ddl(schema)).collect()]


def flag_readings(cohorts: DataFrame, chunk: int = CHUNK, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """(cohort_id, crew_id, field, reading, kind, probability) of the flagged readings, each once."""
    readings = ordered_readings(cohorts)
    ranges = cut(normal_ranges(readings))
    if ranges.count() <= broadcast_sources:
        known = readings.join(F.broadcast(ranges), "crew", "left")
    else:  # a source that holds a third of all rows meets SALTS tasks
        salted = ranges.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        joined = readings.withColumn("_salt", F.pmod("cohort_id", F.lit(SALTS)).cast("int")).join(salted, ["crew", "_salt"], "left").drop("_salt")
        known = cut(joined.repartitionByRange(readings.rdd.getNumPartitions(), "crew", "cohort_id").sortWithinPartitions("crew", "cohort_id"))
    edges = _per_chunk(known.select("crew", "cohort_id", *FIELDS), chunk, edges_of, EDGES)
    links = link_edges(edges)
    vectors = link_transfers(_per_chunk(known, chunk, lambda cols, place: transfers_of(cols, place, links), TRANSFERS), edges)

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        for no, cols in _chunks(batches, chunk):
            for t in flags_of(cols, {"pid": pid, "chunk": no}, links, vectors):
                yield from t.combine_chunks().to_batches()

    return known.mapInArrow(flag, SCHEMA)
