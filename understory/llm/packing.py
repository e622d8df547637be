"""Filling containers of permitted capacities with items of varying length: variable-capacity best-fit.

Sizes are whole numbers up to the largest capacity, so the best-fit decreasing plan is made from the counts
per size (at most ``capacity`` numbers, whatever the corpus): groups of equal bins take equal items at once.
For a new bin the capacity of least cost per packed token is opened; in the end every bin is downsized to the
smallest permitted capacity that holds its contents. The items are then numbered exactly within their size
and looked up in the plan; no task and no driver ever sees a list of items.

An item larger than the largest capacity is split into full pieces and a rest; no other item is split. An
item without tokens needs no space: it comes out with bin_id null. Repeated rows are items of their own.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from understory.operators.chunks import number_rows
from understory.session import cut_table

CAPACITIES = (2048,)
OUT = "doc_id long, piece int, piece_start long, n_tokens int, bin_id long, bin_offset int, bin_capacity int"


@dataclass
class Plan:
    """Runs of items: of size ``size``, numbered from ``first``, ``per_bin`` to a bin, from bin ``bin`` at ``offset``."""

    size: np.ndarray
    first: np.ndarray
    bin: np.ndarray
    per_bin: np.ndarray
    offset: np.ndarray
    starts: np.ndarray  # first bin of every group of equal bins
    capacity: np.ndarray  # final capacity of the group
    bins: int

    def place(self, size: np.ndarray, no: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """bin, offset in it and its capacity for items given by size and number within the size."""
        key = self.size.astype(np.int64) << 44 | self.first
        at = np.searchsorted(key, size.astype(np.int64) << 44 | no, side="right") - 1
        k = no - self.first[at]
        b = self.bin[at] + k // self.per_bin[at]
        return b, self.offset[at] + k % self.per_bin[at] * size, self.capacity[np.searchsorted(self.starts, b, side="right") - 1]


def make_plan(counts: dict[int, int], capacities: Sequence[int] = CAPACITIES, cost=lambda c: c) -> Plan:
    """Best-fit decreasing over counts per size; ``cost`` gives the cost of a bin of a capacity."""
    caps = sorted(set(capacities))
    runs: list[tuple[int, int, int, int, int]] = []
    room: list[int] = []  # the rooms that open groups have, ascending
    groups: dict[int, list[tuple[int, int, int]]] = {}  # room -> (first bin, bins, capacity opened)
    bins = 0
    done: list[tuple[int, int, int]] = []  # (first bin, bins, contents)

    def put(first: int, n: int, left: int, cap: int) -> None:
        if left == 0:
            done.append((first, n, cap))
            return
        if left not in groups:
            groups[left] = []
            insort(room, left)
        groups[left].append((first, n, cap))

    for s in sorted((s for s, c in counts.items() if c and s > 0), reverse=True):
        c, no = counts[s], 0
        while c:
            i = bisect_left(room, s)
            if i < len(room):
                left = room[i]
                first, n, cap = groups[left].pop()
                if not groups[left]:
                    del groups[left]
                    room.pop(i)
            else:
                cap = min((x for x in caps if x >= s), key=lambda x: (cost(x) / (x // s * s), -x))
                left, first, n = cap, bins, -(-c // (cap // s))
                bins += n
            per = left // s
            full = min(n, c // per)
            if full:
                runs.append((s, no, first, per, cap - left))
                put(first, full, left - per * s, cap)
                c, no = c - full * per, no + full * per
            if full < n:
                some = c  # fewer than fill one bin, or none
                if some and some < per:
                    runs.append((s, no, first + full, some, cap - left))
                    put(first + full, 1, left - some * s, cap)
                    c, no, full = 0, no + some, full + 1
                if full < n:
                    put(first + full, n - full, left, cap)
    for left, gs in groups.items():
        done += [(first, n, cap - left) for first, n, cap in gs]
    done.sort()
    fit = np.array([caps[bisect_left(caps, used)] for _, _, used in done], np.int64)
    r = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return Plan(r[:, 0], r[:, 1], r[:, 2], r[:, 3], r[:, 4], np.array([d[0] for d in done], np.int64), fit, bins)


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, piece_start, size): items larger than ``capacity`` become full pieces and a rest."""
    last = F.greatest(F.ceil(F.col("n_tokens") / F.lit(capacity)).cast("int") - 1, F.lit(0))
    cut = sizes.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    return cut.select("doc_id", "piece", start.alias("piece_start"), F.least(F.col("n_tokens") - start, F.lit(capacity)).cast("int").alias("size"))


def pack(sizes: DataFrame, capacities: Sequence[int] = CAPACITIES) -> DataFrame:
    """One row per piece of every item of ``sizes`` (doc_id, n_tokens) with its container."""
    rows = cut_table(pieces(sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")), max(capacities)))
    counts = {r["size"]: r["n"] for r in rows.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most capacity + 1 rows
    numbered = number_rows(rows, ["size"], order=["doc_id", "piece"])  # the same plan for any partitioning
    plan = make_plan(counts, capacities)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            size, no = b.column("size").to_numpy(), b.column("key_no").to_numpy()
            real = size > 0
            at = np.flatnonzero(real)
            bin_, off, cap = (np.zeros(len(size), np.int64) for _ in range(3))
            if len(at):
                bin_[at], off[at], cap[at] = plan.place(size[at], no[at])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("piece"), b.column("piece_start"), b.column("size"), pa.array(bin_, mask=~real), pa.array(off.astype(np.int32), mask=~real), pa.array(cap.astype(np.int32), mask=~real)],
                ["doc_id", "piece", "piece_start", "n_tokens", "bin_id", "bin_offset", "bin_capacity"],
            )

    return numbered.select("doc_id", "piece", "piece_start", "size", "key_no").mapInArrow(run, OUT)


def checked(packed: DataFrame) -> DataFrame:
    """(items, overfull, overlapping, split_small): one row of counts over ``pack``; all but the first are 0 where it is right."""
    real = packed.filter("bin_id is not null")
    bins = real.groupBy("bin_id").agg(F.sum("n_tokens").alias("used"), F.max("bin_capacity").alias("capacity"), F.max(F.col("bin_offset") + F.col("n_tokens")).alias("reach"), F.countDistinct("bin_offset").alias("places"), F.count("*").alias("n"))
    bad = bins.agg(F.count(F.when(F.col("used") > F.col("capacity"), 1)).alias("overfull"), F.count(F.when((F.col("reach") != F.col("used")) | (F.col("places") != F.col("n")), 1)).alias("overlapping"))
    whole = packed.agg(F.count(F.when(F.col("piece") == 0, 1)).alias("items"), F.count(F.when((F.col("piece") == 1) & (F.col("piece_start") != F.lit(max(CAPACITIES))), 1)).alias("split_small"))
    return whole.crossJoin(bad)  # one row each
