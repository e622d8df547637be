"""Per-entity feature table: mergeable sparse vectors, expanded into columns at the end.

The state of an entity is a sparse vector over encoded event types; a cell holds a count, a total and the
latest day. Cells merge by sum, sum and max, so states of single days or partitions combine in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from understory.functions.dates import parse_day
from understory.operators.absent import is_absent, recurring_codes
from understory.session import bounded_rows

#: Event types come from a reference list; a longer list is an error, as every type becomes three columns.
MAX_TYPES = 2_000
#: Entities expanded at once.
SLICE = 1_024


def finite(c: str) -> Column:
    return F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf"))), F.col(c))


def cohort_events(cohorts: DataFrame) -> DataFrame:
    """(entity, kind, total, day): each cohort once, however often it was delivered.

    A null plt_cn is an entity of its own. An absent species is the kind null. A null or non-finite agb
    adds nothing to totals; an unusable measdate adds no latest day.
    """
    codes = recurring_codes(cohorts, {"species_symbol_map": "text"})["species_symbol_map"]
    rows = cohorts.select(
        "cohort_id", F.col("plt_cn").alias("entity"),
        F.when(~is_absent("species_symbol_map", codes), F.col("species_symbol_map")).alias("kind"),
        finite("agb").alias("total"), parse_day("measdate").alias("day"),
    )
    known = rows.filter("cohort_id is not null").dropDuplicates(["cohort_id"])
    return known.unionByName(rows.filter("cohort_id is null")).drop("cohort_id")


def type_index(spark, species: DataFrame) -> list[str]:
    """The event types in their order of encoding: the sorted distinct symbols of the reference list."""
    names = species.select("species_symbol_map").filter("species_symbol_map is not null").distinct()
    return sorted(r[0] for r in bounded_rows(names, MAX_TYPES, "the list of event types"))


def encode(events: DataFrame, types: list[str]) -> DataFrame:
    """``kind`` becomes ``type_ix``, its place in ``types``; -1 for a kind that isn't listed (and null)."""
    codes = events.sparkSession.createDataFrame(list(enumerate(types)), "type_ix int, kind string")
    # at most MAX_TYPES rows
    return events.join(F.broadcast(codes), "kind", "left").withColumn("type_ix", F.coalesce("type_ix", F.lit(-1)))


def merge_cells(cells: DataFrame) -> DataFrame:
    """Combine cells of any states: (entity, type_ix, kind, n, total, latest)."""
    return cells.groupBy("entity", "type_ix", "kind").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("latest").alias("latest"))


def cells(events: DataFrame, types: list[str]) -> DataFrame:
    """The sparse vectors in coordinate form. Listed types drop their name; others keep it under type_ix -1."""
    coded = encode(events, types).withColumn("kind", F.when(F.col("type_ix") < 0, F.col("kind")))
    return merge_cells(coded.select("entity", "type_ix", "kind", F.lit(1).cast("long").alias("n"), "total", F.col("day").alias("latest")))


def _dense(types: list[str]):
    """Scatter the cells of entities, which come one after the other, into one column per type and measure."""
    names = [f"{m}_{t.replace('.', '_')}" for t in types for m in ("n", "total", "days")]
    T = len(types)

    def rows(t: pa.Table, begin: np.ndarray) -> pa.RecordBatch:
        """The rows of the entities that begin at ``begin``; cells of one entity and type merge by sum, sum and min of days."""
        m = len(begin)
        row = np.repeat(np.arange(m), np.diff(np.append(begin, t.num_rows)))
        ix, n, total = (t[c].to_numpy() for c in ("type_ix", "n", "total"))
        days = t["days"].combine_chunks()
        known, days = np.asarray(days.is_valid()), days.fill_null(0).to_numpy()
        listed = ix >= 0
        at = ix[listed].astype(np.int64) * m + row[listed]
        count = np.bincount(at, n[listed], T * m).astype(np.int32).reshape(T, m)
        amount = np.bincount(at, total[listed], T * m).astype(float).reshape(T, m)
        least = np.full(T * m, np.iinfo(np.int32).max, np.int32)
        np.minimum.at(least, at[known[listed]], days[listed][known[listed]])
        least = least.reshape(T, m)
        unseen = least == np.iinfo(np.int32).max
        other: list[dict] = [{} for _ in range(m)]
        for i in np.flatnonzero(~listed).tolist():
            k, had = t["kind"][i].as_py(), other[row[i]]
            c, a, d = had.get(k, (0, 0.0, None))
            d = d if not known[i] else int(days[i]) if d is None else min(d, int(days[i]))
            had[k] = (c + int(n[i]), a + float(total[i]), d)
        lists = [[{"kind": k, "n": v[0], "total": v[1], "days": v[2]} for k, v in sorted(o.items(), key=lambda x: (x[0] is not None, x[0] or ""))] for o in other]
        cols = [c for i in range(T) for c in (pa.array(count[i]), pa.array(amount[i]), pa.array(least[i], mask=unseen[i]))]
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("n", pa.int32()), ("total", pa.float64()), ("days", pa.int32())]))
        return pa.RecordBatch.from_arrays([t["entity"].combine_chunks().take(pa.array(begin)), *cols, pa.array(lists, kinds)], ["plt_cn", *names, "other"])

    def begins(t: pa.Table) -> np.ndarray:
        e = t["entity"].combine_chunks()
        x, gone = e.fill_null(0).to_numpy(), np.asarray(e.is_null())
        return np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (gone[1:] != gone[:-1])))

    def slices(t: pa.Table, begin: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.append(begin[1:], t.num_rows)
        for k in range(0, len(begin), SLICE):
            lo, hi = begin[k], ends[min(k + SLICE, len(begin)) - 1]
            yield rows(t.slice(lo, hi - lo), begin[k : k + SLICE] - lo)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            begin = begins(t)
            yield from slices(t.slice(0, begin[-1]), begin[:-1])  # the last entity may go on in the next batch
            held = t.slice(begin[-1])
        if held is not None:
            yield from slices(held, np.array([0]))

    schema = ", ".join(["plt_cn long", *(f"`{x}` {'double' if x[0] == 't' else 'int'}" for x in names), "other array<struct<kind:string,n:int,total:double,days:int>>"])
    return run, schema


def expand(parts: DataFrame, types: list[str], as_of) -> DataFrame:
    """One row per entity: n_<type>, total_<type>, days_<type> for every listed type, and ``other``.

    ``other`` holds the cells of kinds that aren't listed, so that no row is lost. Counts and totals of a
    type the entity never had are 0, its days are null. ``parts`` may hold several cells of an entity and kind.
    """
    days = F.datediff(F.lit(as_of).cast("date"), "latest").alias("days")
    cells = parts.select(F.col("entity").cast("long").alias("entity"), "type_ix", "kind", "n", F.coalesce("total", F.lit(0.0)).alias("total"), days)
    return cells.repartition("entity").sortWithinPartitions("entity").mapInArrow(*_dense(types))


#: Parts of an entity that are reduced apart from each other, so that no task meets a large one whole.
PARTS = 16


def cohort_parts(cohorts: DataFrame, types: list[str]) -> DataFrame:
    """Cells of parts of the entities, to be merged: the rows move once.

    Kinds are encoded where rows are read. Rows meet by entity and part of their cohort_id: there repeated deliveries
    (same cohort_id of the same entity) drop out and every part is reduced to its cells; cells then meet by entity.
    """
    codes = recurring_codes(cohorts, {"species_symbol_map": "text"})["species_symbol_map"]
    rows = cohorts.select(
        "cohort_id", F.col("plt_cn").alias("entity"), F.when(~is_absent("species_symbol_map", codes), F.col("species_symbol_map")).alias("kind"),
        finite("agb").alias("total"), parse_day("measdate").alias("day"),
        F.when(F.col("cohort_id").isNull(), F.monotonically_increasing_id()).alias("_lone"),  # rows without an id are rows of their own
    )
    part = F.pmod(F.xxhash64("cohort_id", "_lone"), F.lit(PARTS)).cast("int")
    coded = encode(rows, types).select("entity", part.alias("_part"), "cohort_id", "_lone", "type_ix", F.when(F.col("type_ix") < 0, F.col("kind")).alias("kind"), "total", "day")
    # a repeated delivery has the values of the first; if it hasn't, the largest count. No buffer holds text, so this hashes instead of sorting
    once = coded.repartition("entity", "_part").groupBy("entity", "_part", "cohort_id", "_lone", "kind").agg(*(F.max(c).alias(c) for c in ("type_ix", "total", "day")))
    parts = once.groupBy("entity", "_part", "type_ix", "kind").agg(F.count("*").alias("n"), F.sum("total").alias("total"), F.max("day").alias("latest"))
    return parts.drop("_part")


def cohort_cells(cohorts: DataFrame, types: list[str]) -> DataFrame:
    """``cells`` of ``cohort_events``, with rows that move once and cells that move once."""
    return merge_cells(cohort_parts(cohorts, types))


def newest_day(cohorts: DataFrame):
    """The day up to which recency counts: that of the newest delivery (null for an empty table)."""
    return cohorts.agg(F.max(F.col("loaded_at").cast("date"))).first()[0]


def feature_table(cohorts: DataFrame, species: DataFrame) -> DataFrame:
    types = type_index(cohorts.sparkSession, species)
    return expand(cohort_parts(cohorts, types), types, newest_day(cohorts))


def feature_cells(cohorts: DataFrame, species: DataFrame) -> DataFrame:
    """The same vectors in coordinate form: (plt_cn, species_symbol_map, n, total, days)."""
    types = type_index(cohorts.sparkSession, species)
    names = cohorts.sparkSession.createDataFrame(list(enumerate(types)), "type_ix int, listed string")
    day = F.lit(newest_day(cohorts)).cast("date")
    return (
        cohort_cells(cohorts, types).join(F.broadcast(names), "type_ix", "left")
        .select(F.col("entity").alias("plt_cn"), F.coalesce("listed", "kind").alias("species_symbol_map"), "n",
                F.coalesce("total", F.lit(0.0)).alias("total"), F.datediff(day, "latest").alias("days"))
    )
