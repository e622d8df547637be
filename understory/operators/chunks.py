"""Per-key results without skew: exact offset chunking.

Rows are counted per (input partition, key); a prefix sum over the partitions gives every partition the
offset of its first row of a key; rows are numbered exactly where they are read, without moving them; equal-sized
chunks of a key are reduced to boundary states, also where they are read, and only these states travel: they are
merged per key in their order. No task ever holds more than a batch of rows of a key, however large the key is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from understory.operators.absent import is_absent, recurring_codes
from understory.session import cut, width

CHUNK_ROWS = 65_536
#: Offsets, one row per (partition, key), are broadcast up to this number of rows; more are joined by shuffle.
BROADCAST_OFFSETS = 500_000


def in_order(rows: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """``rows`` range-partitioned and sorted by ``order``, in the checkpoint folder."""
    return cut(rows.repartitionByRange(partitions or width(rows), *order).sortWithinPartitions(*order))


def _codes(b: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Numbers that tell the values of some columns of a batch apart, null being a value."""
    code = np.zeros(b.num_rows, np.int64)
    for name in names:
        one = b.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        code = np.unique(code * (int(one.max(initial=0)) + 1) + one, return_inverse=True)[1].astype(np.int64)
    return code


def number_locally(rows: DataFrame, keys: list[str], follow: str | None = None) -> DataFrame:
    """``rows`` with ``_pid``, the partition, ``_no``, the 0-based number within (partition, key), and ``_turn``:
    whether ``follow`` differs from the row of the key before (null for the first of a partition)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        seen: dict[tuple, tuple[int, object]] = {}  # rows so far and the last value, per key
        for b in batches:
            if not b.num_rows:
                continue
            code = _codes(b, keys)
            order = np.argsort(code, kind="stable")
            kinds, first, size = np.unique(code[order], return_index=True, return_counts=True)
            names = list(zip(*(b.column(k).take(pa.array(order[first])).to_pylist() for k in keys), strict=True))
            before = [seen.get(k, (0, None)) for k in names]
            no, turn, fresh = np.empty(b.num_rows, np.int64), np.zeros(b.num_rows, bool), np.zeros(b.num_rows, bool)
            no[order] = np.repeat(np.array([n for n, _ in before]) - first, size) + np.arange(b.num_rows)
            values: list = [None] * len(kinds)
            if follow:
                x = _codes(b, [follow])[order]
                turn[order[1:]] = x[1:] != x[:-1]
                heads, values = (b.column(follow).take(pa.array(order[i])).to_pylist() for i in (first, first + size - 1))
                turn[order[first]] = [h != v for h, (_, v) in zip(heads, before, strict=True)]
                fresh[order[first]] = [n == 0 for n, _ in before]
            seen.update(zip(names, zip((n + int(k) for (n, _), k in zip(before, size, strict=True)), values, strict=True), strict=True))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, pid, np.int32)), pa.array(no), pa.array(turn, mask=fresh)], [*b.schema.names, "_pid", "_no", "_turn"])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "_pid int, _no long, _turn boolean"])
    return rows.mapInArrow(run, schema)


def with_numbers(rows: DataFrame, keys: list[str], follow: str | None = None) -> DataFrame:
    """``number_locally`` with ``key_no``, the 0-based number of the row within its key."""
    counts = rows.groupBy(F.spark_partition_id().alias("_p"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.count("*").alias("_n"))
    names = [f"_k{i}" for i in range(len(keys))]
    before = Window.partitionBy(*names).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(counts.select(*names, "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    if offsets.count() <= BROADCAST_OFFSETS:
        offsets = F.broadcast(offsets)
    same: Column = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)], F.col("_pid") == F.col("_p"))
    return number_locally(rows, keys, follow).join(offsets, same, "inner").withColumn("key_no", F.col("_off") + F.col("_no")).drop("_off", "_p", *names)


def number_rows(rows: DataFrame, keys: list[str], order: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """``rows`` with ``key_no``: the 0-based number of the row within its key.

    Without ``order`` the numbering follows the input partitions, so ``rows`` must be a plain scan (with
    projections, filters or explodes) or a checkpoint, whose partitions are the same each time they are
    read. With ``order`` the rows are range-partitioned by these columns first and written to the
    checkpoint folder. Null keys form a key of their own. An empty table gives an empty result.
    """
    return with_numbers(in_order(rows, order, partitions) if order else rows, keys).drop("_pid", "_no", "_turn")


def chunk_states(rows: DataFrame, keys: list[str], value: str, follow: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per (key, chunk, partition): counts, totals and the boundary state of that piece of a chunk.

    ``turns`` counts rows whose ``follow`` differs from that of the row before in the same piece.
    """
    good = F.when(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.col(value))
    x = with_numbers(rows, keys, follow).select(
        *keys, "_pid", "key_no", follow, F.floor(F.col("key_no") / F.lit(chunk_rows)).alias("chunk"), good.alias("_x"),
        (F.coalesce("_turn", F.lit(False)) & (F.col("key_no") % chunk_rows != 0)).cast("long").alias("_turn"),
    )
    return x.groupBy(*keys, "chunk", "_pid").agg(
        F.count("*").alias("n"), F.count("_x").alias("n_values"), F.sum("_x").alias("total"),
        F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.sum("_turn").alias("turns"),
        F.min(F.struct("key_no", follow)).alias("head"), F.max(F.struct("key_no", follow)).alias("tail"),
    )


def merge_states(states: DataFrame, keys: list[str], follow: str) -> DataFrame:
    """Merge the pieces of a key in order; a turn across a boundary counts as one inside a piece."""
    w = Window.partitionBy(*keys).orderBy("chunk", "_pid")
    joined = states.withColumn("_before", F.lag("tail").over(w)).withColumn(
        "_cross", (F.col("_before").isNotNull() & ~F.col(f"_before.{follow}").eqNullSafe(F.col(f"head.{follow}"))).cast("long")
    )
    return joined.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"), F.sum("n_values").alias("n_values"), F.sum("total").alias("total"),
        F.min("lo").alias("lowest"), F.max("hi").alias("highest"), (F.sum("turns") + F.sum("_cross")).alias("turns"),
        F.countDistinct("chunk").alias("chunks"),
    )


def keyed_rows(cohorts: DataFrame, fields: tuple[str, ...] = ("eco", "species_symbol_map"), keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per (cohort row, field) with a key; null and absent values are no keys."""
    codes = recurring_codes(cohorts, {f: "text" for f in fields})
    pairs = [F.struct(F.lit(f).alias("field"), F.when(~is_absent(f, codes[f]), F.col(f)).alias("key_value")) for f in fields]
    return (
        cohorts.select(*keep, F.explode(F.array(*pairs)).alias("_e"))
        .select(*keep, "_e.field", "_e.key_value")
        .filter("key_value is not null")
    )


def per_key_results(cohorts: DataFrame, order: list[str] | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(field, key_value, n_rows, n_values, total, lowest, highest, turns, chunks) over all cohort rows.

    Repeated rows count as often as they were delivered. Readings that are null or not finite are no
    values. ``turns``: how often the crew changes from one row of the key to the next.
    """
    keys = ["field", "key_value"]
    if order:  # the rows are sorted once, not once for each of their keys
        cohorts = in_order(cohorts.select(*dict.fromkeys(["eco", "species_symbol_map", "agb", "crew_id", *order])), order)
    rows = keyed_rows(cohorts, keep=("agb", "crew_id"))
    return merge_states(chunk_states(rows, keys, "agb", "crew_id", chunk_rows), keys, "crew_id")


def heavy_keys(cohorts: DataFrame, share: float = 0.05, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(field, key_value) of the values that hold at least ``share`` of all rows, from their merged states."""
    total = cohorts.count()
    return per_key_results(cohorts, None, chunk_rows).filter(F.col("n_rows") >= F.lit(share * total)).select("field", "key_value")
