"""Filling missing values from similar records by low-rank alternating least squares.

Every cohort is a row of mixed encoded cells: one block of indicator cells per categorical field (scaled by
1/sqrt(share), centred) and one standardised cell per numeric field. Cells of the record's plot (its known
eco and mean log age), visit and crew (mean log age) stand beside its own. A record's factor is the ridge solution
over its observed cells, the cell factors are the ridge solution over all records (with the uncertainty of their factors, so
that a factor only one cell speaks for isn't trusted); the two alternate. The
factors of the cells are a small matrix (cells x rank); all sums over records are aggregated in Spark.

A missing entry is decoded to the valid value with the highest predicted share. What is valid follows from the records
of the same plot and from the lists: a plot has one eco, so where its other records name one, that is the valid eco, else
every listed one; the species list maps an eco and symbol to the valid values of species_symbol_map, or to the eco's
values for unmapped wood, or else all values of the eco are valid; for age a whole number from 1 to 1,500. Observed
entries are never changed, malformed or unlisted ones included.

Defined cases: repeated cohorts count once; rows without cohort_id have no key and are left out; an empty
table gives an empty result; with no listed values at all a text field stays null and is marked unfilled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from understory.operators.absent import is_absent, recurring_codes
from understory.session import bounded_rows, cut_table

RANK, ROUNDS, SEED = 8, 5, 7
#: Ridge of the record factors: the noise variance of a cell, beside a prior variance of 1 of a factor.
RIDGE = 1.0
#: The fields that are filled.
FILLED = ("age_calc", "eco", "species_symbol_map")
PLOT = ("statecd", "unitcd", "countycd", "plot")
#: Categorical blocks and numeric cells of a record; plot_* are those of its plot.
BLOCKS = ("eco", "species", "symbol", "wood", "plot_eco")
NUMBERS = ("age", "agb", "trees", "plot_age", "visit_age", "crew_age")
#: Weight of a numeric cell beside the blocks, whose cells are many.
NUMBER_WEIGHT = 2.0
MAX_LIST = 5_000
#: Vectors of partial sums that meet in one task or on the driver.
FAN = 64
MIN_SHARE = 1e-4
#: Bits of a code, the stand-in for a null number, and steps of a log agb while records are shuffled.
BITS, NONE, LOG_STEPS = 15, -(1 << 31), 10_000
OUT = (
    "cohort_id long, age_calc int, eco string, species_symbol_map string, age_calc_filled boolean, eco_filled boolean, "
    "species_symbol_map_filled boolean, age_calc_absent boolean, eco_absent boolean, species_symbol_map_absent boolean"
)


class Lists:
    """The reference lists in encoded form. Place len(list) of a block stands for every unlisted value."""

    def __init__(self, ecos: DataFrame, species: DataFrame, species_eco: DataFrame) -> None:
        self.eco = sorted({r[0] for r in bounded_rows(ecos.select("eco").filter("eco is not null").distinct(), MAX_LIST, "the eco list")})
        self.species = sorted({r[0] for r in bounded_rows(species.select("species_symbol_map").filter("species_symbol_map is not null").distinct(), MAX_LIST, "the species list")})
        pairs = bounded_rows(species_eco.select("eco", "species_symbol", "species_symbol_map").na.drop().distinct(), 20 * MAX_LIST, "the species map")
        self.symbol = sorted({r[1] for r in pairs})
        self.wood = ["H", "S"]
        if max(map(len, (self.eco, self.species, self.symbol))) > (1 << BITS) - 3:
            raise ValueError("a reference list is too long for its code")
        e, s, y = ({v: i for i, v in enumerate(x)} for x in (self.eco, self.species, self.symbol))
        self.of_pair: dict[tuple[int, int], list[int]] = {}
        self.of_eco = np.zeros((len(self.eco) + 1, len(self.species)), bool)
        for eco, symbol, mapped in pairs:
            if eco in e and mapped in s:
                self.of_pair.setdefault((e[eco], y[symbol]), []).append(s[mapped])
                self.of_eco[e[eco], s[mapped]] = True
        self.other = np.full((len(self.eco) + 1, 2), -1)  # the eco's species for unmapped hardwood and softwood
        for i, eco in enumerate(self.eco):
            for k, w in enumerate(self.wood):
                self.other[i, k] = s.get(f"{eco}_{w}", -1)
                if self.other[i, k] >= 0:
                    self.of_eco[i, self.other[i, k]] = True
        self.of_eco[-1] = True
        self.of_eco[~self.of_eco.any(1)] = True

    def sizes(self) -> list[int]:
        n = {"eco": self.eco, "species": self.species, "symbol": self.symbol, "wood": self.wood, "plot_eco": self.eco}
        return [len(n[b]) + 1 for b in BLOCKS]


def _dictionary(spark, values: list[str], key: str, code: str) -> DataFrame:
    """A list (at most MAX_LIST values, checked) as a table of codes."""
    return F.broadcast(spark.createDataFrame(list(enumerate(values)), f"{code} int, {key} string"))


def _key(*columns: str):
    """A hash that tells nulls of different columns apart."""
    return F.xxhash64(*(x for c in columns for x in (F.coalesce(c, F.lit(0)), F.col(c).isNull())))


def encode(cohorts: DataFrame, lists: Lists) -> DataFrame:
    """The records as codes and floats, once per cohort, with the cells of their plot, visit and crew.

    Everything is encoded before the first shuffle. Statistics of plots, visits and crews are summed where
    the rows are read (repeated deliveries count as often as they came) and joined to each other while they
    are small; the records meet them in one join on the visit. Written once, in packed columnar blocks, and
    read by every round.
    """
    codes = recurring_codes(cohorts, {"age_calc": "age", "eco": "text", "species_symbol_map": "text"})
    spark = cohorts.sparkSession
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in PLOT])
    base = cohorts.select(
        F.col("cohort_id").cast("long").alias("cohort_id"), F.when(whole | F.col("plt_cn").isNotNull(), _key("plt_cn", *PLOT, "crew_id")).alias("visit"),
        F.when(whole, _key(*PLOT)).alias("place"), "crew_id",
        *(F.when(~is_absent(f, codes[f]), F.col(f)).alias(f) for f in ("age_calc", "eco", "species_symbol_map")),
        "species_symbol", F.upper(F.substring("sftwd_hrdwd", 1, 1)).alias("w"),
        "agb", "tree_count",
    ).withColumn("age", F.when(F.col("age_calc").between(1, 1500), F.log("age_calc")).cast("float"))
    mean = [F.sum("age").alias("s"), F.count("age").alias("k")]
    visits = base.groupBy("visit", "place", "crew_id").agg(*mean)  # a record without plot and plt_cn has no visit, one without a whole plot key no plot
    again = [F.sum("s").alias("s"), F.sum("k").alias("k")]
    of_crew = visits.filter("crew_id is not null").groupBy("crew_id").agg(*again).select("crew_id", (F.col("s") / F.col("k")).alias("crew_age"))
    of_place = visits.filter("place is not null").groupBy("place").agg(*again).select("place", (F.col("s") / F.col("k")).alias("plot_age"))
    in_eco = base.filter("eco is not null and place is not null").groupBy("place", "eco").agg(F.count("*").alias("n")).groupBy("place").agg(F.max(F.struct("n", "eco"))["eco"].alias("plot_of"))
    in_eco = in_eco.join(_dictionary(spark, lists.eco, "plot_of", "plot_eco"), "plot_of", "left").select("place", F.coalesce("plot_eco", F.lit(len(lists.eco))).alias("plot_eco"))
    known = (
        visits.filter("visit is not null").join(of_place, "place", "left").join(in_eco, "place", "left").join(of_crew, "crew_id", "left")
        .groupBy("visit").agg(F.max("plot_eco").alias("plot_eco"), F.avg("plot_age").alias("plot_age"), F.avg("crew_age").alias("crew_age"), (F.sum("s") / F.sum("k")).alias("visit_age"))
    )
    coded = base.filter("cohort_id is not null")
    for key, code, values in (("eco", "eco_at", lists.eco), ("species_symbol_map", "species_at", lists.species), ("species_symbol", "symbol_at", lists.symbol)):
        coded = coded.join(_dictionary(spark, values, key, code), key, "left")

    def code(key: str, at: str, size: int):
        """0 for null, then the place in the list, then one for every unlisted value."""
        return F.when(F.col(key).isNull(), 0).otherwise(F.coalesce(at, F.lit(size)) + 1).cast("long")

    wood = F.when(F.col("w").isNull(), 0).when(F.col("w") == "H", 1).when(F.col("w") == "S", 2).otherwise(3).cast("long")
    blocks = [code("eco", "eco_at", len(lists.eco)), code("species_symbol_map", "species_at", len(lists.species)), code("species_symbol", "symbol_at", len(lists.symbol)), wood]
    # two numbers hold all cells while the rows travel: four codes of BITS bits; age and log agb in 32 bits each
    log_agb = F.when((F.col("agb") > 0) & (F.col("agb") < float("inf")), F.round(F.log("agb") * LOG_STEPS))
    rows = coded.select(
        "cohort_id", F.coalesce("visit", F.xxhash64("cohort_id")).alias("visit"),  # records without a visit don't meet in one task
        sum(F.shiftleft(c, BITS * i) for i, c in enumerate(blocks)).alias("codes"),
        (F.shiftleft(F.coalesce("age_calc", F.lit(NONE)).cast("long"), 32) + (F.coalesce(log_agb, F.lit(NONE)).cast("long") - NONE)).alias("numbers"),
        F.col("tree_count").cast("int").alias("tree_count"),
        F.when(F.col("eco_at").isNull(), F.col("eco")).alias("raw_eco"), F.when(F.col("species_at").isNull(), F.col("species_symbol_map")).alias("raw_species"),
    ).dropDuplicates(["cohort_id"])

    def unpacked(i: int):
        return (F.shiftright("codes", BITS * i).bitwiseAND(F.lit((1 << BITS) - 1)) - 1).cast("short")

    age = F.shiftright("numbers", 32).cast("int")
    agb = F.col("numbers").bitwiseAND(F.lit((1 << 32) - 1)) + NONE
    out = rows.join(known, "visit", "left").select(
        "cohort_id", F.when(age != NONE, age).alias("age_calc"), "raw_eco", "raw_species", *(unpacked(i).alias(x) for i, x in enumerate(BLOCKS[:4])),
        F.coalesce("plot_eco", F.lit(-1)).cast("short").alias("plot_eco"),
        F.when(age.between(1, 1500), F.log(age)).cast("float").alias("age"), F.when(agb != NONE, agb / LOG_STEPS).cast("float").alias("agb"),
        F.when(F.col("tree_count") > 0, F.log("tree_count")).cast("float").alias("trees"),
        *(F.col(x).cast("float").alias(x) for x in NUMBERS[3:]),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(b)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block"])

    return cut_table(out.mapInArrow(pack, "block binary"))


class Model:
    """Cell factors V (cells x rank) with the shares and scales that centre the cells."""

    def __init__(self, sizes: list[int], share: list[np.ndarray], mean: np.ndarray, std: np.ndarray) -> None:
        self.sizes, self.share, self.mean, self.std = sizes, share, mean, std
        self.offset = np.concatenate([[0], np.cumsum(sizes)])
        self.cells = int(self.offset[-1]) + len(NUMBERS)
        self.v = np.random.default_rng(SEED).normal(0, 0.1, (self.cells, RANK))

    def factors(self, codes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ridge solution of every record, its pattern of seen cells, and the uncertainty of each pattern.

        codes: n x blocks, -1 if unseen; numbers: n x numeric cells, standardised, NaN if unseen.
        """
        rhs = np.zeros((len(codes), RANK))
        seen = np.concatenate([codes >= 0, ~np.isnan(numbers)], 1)
        grams = []
        for g in range(len(BLOCKS)):
            v = self.v[self.offset[g] : self.offset[g + 1]]
            root = np.sqrt(self.share[g])
            table = np.vstack([v / root[:, None] - root @ v, np.zeros(RANK)])  # the last row serves code -1
            rhs += table[codes[:, g]]
            grams.append(v.T @ v)
        for j in range(len(NUMBERS)):
            v = self.v[self.offset[-1] + j]
            rhs += np.nan_to_num(numbers[:, j])[:, None] * v
            grams.append(np.outer(v, v))
        kinds, at = np.unique(seen @ (1 << np.arange(seen.shape[1])), return_inverse=True)
        u, spread = np.empty_like(rhs), np.empty((len(kinds), RANK, RANK))
        for k, p in enumerate(kinds):
            inverse = np.linalg.inv(sum((grams[j] for j in range(len(grams)) if p >> j & 1), np.eye(RANK) * RIDGE))
            u[at == k] = rhs[at == k] @ inverse
            spread[k] = RIDGE * inverse
        return u, at, spread

    def sums(self, codes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """What the cell factors need from these records: flat, additive."""
        u, at, spread = self.factors(codes, numbers)
        parts = []

        def gram(i: np.ndarray) -> np.ndarray:
            return (u[i].T @ u[i] + np.tensordot(np.bincount(at[i], minlength=len(spread)), spread, 1)).ravel()

        for g in range(len(BLOCKS)):
            i = codes[:, g] >= 0
            s = np.zeros((self.sizes[g], RANK))
            for r in range(RANK):
                s[:, r] = np.bincount(codes[i, g], weights=u[i, r], minlength=self.sizes[g])
            parts += [s.ravel(), gram(i)]
        for j in range(len(NUMBERS)):
            i = ~np.isnan(numbers[:, j])
            parts += [numbers[i, j] @ u[i], gram(i)]
        return np.concatenate(parts)

    def update(self, flat: np.ndarray) -> None:
        at = 0

        def take(k: int) -> np.ndarray:
            nonlocal at
            at += k
            return flat[at - k : at]

        for g, size in enumerate(self.sizes):
            s, gram = take(size * RANK).reshape(size, RANK), take(RANK * RANK).reshape(RANK, RANK)
            root = np.sqrt(self.share[g])
            rhs = s / root[:, None] - root[:, None] * s.sum(0)
            self.v[self.offset[g] : self.offset[g + 1]] = rhs @ np.linalg.inv(gram + np.eye(RANK) * RIDGE)
        for j in range(len(NUMBERS)):
            rhs, gram = take(RANK), take(RANK * RANK).reshape(RANK, RANK)
            self.v[self.offset[-1] + j] = rhs @ np.linalg.inv(gram + np.eye(RANK) * RIDGE)

    def block_scores(self, u: np.ndarray, g: int) -> np.ndarray:
        """Predicted shares of the values of a block."""
        v = self.v[self.offset[g] : self.offset[g + 1]]
        return self.share[g] + np.sqrt(self.share[g]) * (u @ v.T)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The records of packed rows: a row holds a whole columnar batch, so that a round costs the engine a few rows."""
    for b in batches:
        for x in b.column(0):
            yield pa.ipc.open_stream(x.as_buffer()).read_all().combine_chunks()


def _arrays(t: pa.Table, model: Model | None) -> tuple[np.ndarray, np.ndarray]:
    codes = np.stack([t[b].to_numpy() for b in BLOCKS], 1).astype(np.int64)
    numbers = np.stack([t[x].to_numpy() for x in NUMBERS], 1).astype(float)
    return codes, NUMBER_WEIGHT * (numbers - model.mean) / model.std if model else numbers


def _summed(coded: DataFrame, of) -> np.ndarray:
    """The sum over all records of a flat vector: one vector per partition, added up in a tree of FAN branches."""

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(map(of, _blocks(batches)))

    def node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(np.frombuffer(x.as_buffer()) for b in batches for x in b.column(1))

    def packed(vectors: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in vectors:
            total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["j", "x"])

    parts, n = coded.mapInArrow(leaf, "j int, x binary"), coded._jdf.queryExecution().toRdd().getNumPartitions()
    while n > FAN:
        n = -(-n // FAN)
        parts = parts.select(F.floor(F.col("j") / FAN).cast("int").alias("j"), "x").repartition(n, "j").mapInArrow(node, "j int, x binary")
    return sum((np.frombuffer(bytes(r["x"])) for r in parts.collect()), start=np.zeros(1))


def fit(coded: DataFrame, lists: Lists, rank_rounds: int = ROUNDS) -> Model | None:
    sizes = lists.sizes()

    def moments(t: pa.Table) -> np.ndarray:
        codes, numbers = _arrays(t, None)
        counts = [np.bincount(codes[codes[:, g] >= 0, g], minlength=k).astype(float) for g, k in enumerate(sizes)]
        ok = ~np.isnan(numbers)
        z = np.where(ok, numbers, 0)
        return np.concatenate([*counts, ok.sum(0), z.sum(0), (z * z).sum(0), [len(codes)]])

    m = _summed(coded, moments)
    if len(m) <= 1 or m[-1] == 0:
        return None
    at = np.concatenate([[0], np.cumsum(sizes)])
    share = [np.maximum((c := m[at[g] : at[g + 1]]) / max(c.sum(), 1), MIN_SHARE) for g in range(len(sizes))]
    k, s, ss = m[at[-1] : -1].reshape(3, len(NUMBERS))
    mean = s / np.maximum(k, 1)
    std = np.sqrt(np.maximum(ss / np.maximum(k, 1) - mean**2, 1e-6))
    model = Model(sizes, share, mean, std)
    for _ in range(rank_rounds):
        model.update(_summed(coded, lambda t, now=model: now.sums(*_arrays(t, now))))
    return model


def permitted_species(lists: Lists, eco: np.ndarray, symbol: np.ndarray, wood: np.ndarray) -> np.ndarray:
    """Which species a record may have (records x species): what the map gives its eco and symbol, else the eco's species
    for unmapped hardwood or softwood, else any of the eco's. ``eco``: its place, that after the last for an unlisted one."""
    kinds, at = np.unique(np.stack([eco, symbol, wood]), axis=1, return_inverse=True)
    valid = lists.of_eco[kinds[0]].copy()
    for k, (e, s, w) in enumerate(kinds.T.tolist()):
        rest = int(lists.other[e, w]) if 0 <= w < 2 else -1
        mapped = lists.of_pair.get((e, s)) or ([rest] if s >= 0 and rest >= 0 else None)
        if mapped:
            valid[k] = False
            valid[k, mapped] = True
    return valid[at.ravel()]


def decode(t: pa.Table, model: Model, lists: Lists, validity: bool = True) -> pa.Table:
    """Fill the missing entries of a batch of encoded records. Without ``validity`` any listed eco, and any species of the
    eco, may be chosen: that measures the factors alone."""
    codes, numbers = _arrays(t, model)
    eco, species, age = codes[:, 0].copy(), codes[:, 1].copy(), t["age_calc"].combine_chunks()
    no_eco, no_species, no_age = eco < 0, species < 0, np.asarray(age.is_null())
    ages = pc.fill_null(age, 0).to_numpy().copy()
    need = np.flatnonzero(no_eco | no_species | no_age)
    u = model.factors(codes[need], numbers[need])[0] if len(need) else np.empty((0, RANK))
    i = np.flatnonzero(no_eco[need])
    if len(i) and lists.eco:
        best = model.block_scores(u[i], 0)[:, :-1].argmax(1)
        plot = codes[need[i], 4]
        eco[need[i]] = np.where(validity & (plot >= 0) & (plot < len(lists.eco)), plot, best)
    i = np.flatnonzero(no_species[need])
    if len(i) and lists.species:
        rows = need[i]
        score = model.block_scores(u[i], 1)[:, :-1]
        where = np.where((eco[rows] >= 0) & (eco[rows] < len(lists.eco)), eco[rows], len(lists.eco))
        valid = permitted_species(lists, where, codes[rows, 2], codes[rows, 3]) if validity else lists.of_eco[where]
        species[rows] = np.where(valid, score, -np.inf).argmax(1)
    i = np.flatnonzero(no_age[need])
    if len(i):
        v = model.v[model.offset[-1]]
        log_age = model.mean[0] + model.std[0] / NUMBER_WEIGHT * (u[i] @ v)
        ages[need[i]] = np.clip(np.rint(np.exp(np.clip(log_age, 0, 8))), 1, 1500)

    def text(code: np.ndarray, values: list[str], raw: str) -> pa.Array:
        known = pa.array([*values, None, None], pa.string()).take(pa.array(np.where(code < 0, len(values) + 1, code)))
        return pc.coalesce(known, t[raw].combine_chunks())

    out = {"cohort_id": t["cohort_id"], "age_calc": pa.array(ages, pa.int32()), "eco": text(eco, lists.eco, "raw_eco"), "species_symbol_map": text(species, lists.species, "raw_species")}
    out |= {"age_calc_filled": pa.array(no_age), "eco_filled": pa.array(no_eco & (eco >= 0)), "species_symbol_map_filled": pa.array(no_species & (species >= 0))}
    return pa.table(out | {"age_calc_absent": pa.array(no_age), "eco_absent": pa.array(no_eco), "species_symbol_map_absent": pa.array(no_species)})


def fill(cohorts: DataFrame, ecos: DataFrame, species: DataFrame, species_eco: DataFrame) -> DataFrame:
    """One row per cohort: the three fields filled, with a mark on every filled and every absent value."""
    lists = Lists(ecos, species, species_eco)
    coded = encode(cohorts, lists)
    model = fit(coded, lists)
    if model is None:
        return cohorts.sparkSession.createDataFrame([], OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches):
            yield from decode(t, model, lists).combine_chunks().to_batches()

    return coded.mapInArrow(run, OUT)


def absent_fields(filled: DataFrame) -> DataFrame:
    """(cohort_id, field) of every value that was absent."""
    marks = [F.when(F.col(f"{f}_absent"), F.lit(f)) for f in ("age_calc", "eco", "species_symbol_map")]
    return filled.select("cohort_id", F.explode(F.array_compact(F.array(*marks))).alias("field"))
