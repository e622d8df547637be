"""Percentiles with bounded rank error from mergeable rank-interval summaries.

A summary of n values is a sorted list of tuples (value, lo, hi): the rank of the value is at least lo and at
most hi. If hi of a tuple minus lo of the tuple before it is never above 2e, every rank has a tuple within e.
Partitions are summarised first, then summaries are merged per (key, salt) and per key; merging adds up the
absolute errors, compressing spends a stated share of the permitted one, and the error that a summary has
come to is measured from its tuples and kept with it. Everything is deterministic and vectorised over groups.

Null and non-finite values are left out; null keys form groups of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Permitted rank error as a share of n: half is spent on the first summaries, a quarter on either merge. Stored days spend
#: DAYS of it, so that combining them, which merges twice more, stays within it.
EPS = 0.005
DAYS = 2 / 3
SALTS = 64
#: Rows that are summarised together, and tuples that are merged together: a task holds no more at once, but for the
#: summaries of one key.
BUILD_ROWS, MERGE_TUPLES = 1 << 20, 1 << 21
POINTS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
STATE = "n long, rank_error double, v array<double>, lo array<long>, hi array<long>"


def _kept(code: np.ndarray, n: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Tuples to keep: the first and last of a group and the last in every stretch of ``width`` ranks."""
    stretch = (at / np.maximum(width, 1)).astype(np.int64)
    last = np.ones(len(code), bool)
    last[:-1] = (code[1:] != code[:-1]) | (stretch[1:] != stretch[:-1])
    first = np.ones(len(code), bool)
    first[1:] = code[1:] != code[:-1]
    return last | first


def _errors(code: np.ndarray, lo: np.ndarray, hi: np.ndarray, groups: int) -> np.ndarray:
    """Half the widest gap between neighbouring tuples of every group: the most ranks a query may be off."""
    out = np.zeros(groups, np.int64)
    inner = np.flatnonzero(code[1:] == code[:-1])
    np.maximum.at(out, code[inner], (hi[inner + 1] - lo[inner]) // 2)
    np.maximum.at(out, code, (hi - lo) // 2)
    return out.astype(float)


def summarise(code: np.ndarray, x: np.ndarray, groups: int, eps: float) -> tuple[np.ndarray, ...]:
    """Exact ranks of the values of every group, thinned to steps of 2 x eps x n ranks: (code, v, lo, hi, n)."""
    order = np.lexsort((x, code))
    code, x = code[order], x[order]
    n = np.bincount(code, minlength=groups)
    rank = np.arange(len(x)) - (np.cumsum(n) - n)[code] + 1
    step = np.floor(2 * eps * n).astype(np.int64)
    keep = _kept(code, n, rank, step[code])
    return code[keep], x[keep], rank[keep], rank[keep], n


def merge(code: np.ndarray, summary: np.ndarray, v: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: np.ndarray, groups: int, eps: float) -> tuple[np.ndarray, ...]:
    """Merge the summaries of every group and thin the result by eps x n ranks.

    ``summary`` numbers the summaries (ascending, tuples in order), ``size`` is the n of each summary. Passing
    a tuple raises the lower rank of all that follows by its own step, and the upper rank by the step to the
    tuple after it; two running sums give the rank intervals in the merged order.
    """
    m = len(v)
    first = np.ones(m, bool)
    first[1:] = summary[1:] != summary[:-1]
    last = np.append(first[1:], True) if m else first
    up = lo.astype(np.int64).copy()
    up[1:][~first[1:]] -= lo[:-1][~first[1:]]
    after = np.empty(m, np.int64)
    after[:-1] = hi[1:]
    over = np.where(last, size[summary] + 1, after if m else hi) - hi
    order = np.lexsort((np.arange(m), v, code))
    c = code[order]
    begin = np.ones(m, bool)
    begin[1:] = c[1:] != c[:-1]
    base = np.flatnonzero(begin)
    of = np.cumsum(begin) - 1
    s = np.cumsum(up[order])
    new_lo = s - (s[base] - up[order][base])[of]
    start = np.zeros(groups, np.int64)
    np.add.at(start, code[first], hi[first] - 1)
    t = np.cumsum(over[order])
    new_hi = t - over[order] - (t[base] - over[order][base])[of] + start[c] + 1
    n = np.zeros(groups, np.int64)
    np.add.at(n, code[first], size[summary[first]])
    keep = _kept(c, n, (new_lo + new_hi) / 2.0, np.floor(eps * n).astype(np.int64)[c])
    return c[keep], v[order][keep], new_lo[keep], new_hi[keep], n


def _state(code: np.ndarray, v: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: np.ndarray, groups: int) -> dict[str, pa.Array]:
    at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(code, minlength=groups))]).astype(np.int32))
    lists = {k: pa.ListArray.from_arrays(at, pa.array(x)) for k, x in (("v", v), ("lo", lo), ("hi", hi))}
    return {"n": pa.array(n.astype(np.int64)), "rank_error": pa.array(_errors(code, lo, hi, groups))} | lists


def _groups(t: pa.Table, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Group number of every row, a row of every group, and the number of groups."""
    code = t.select(keys).to_pandas().groupby(list(keys), dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(t.num_rows, int)
    _, sample = np.unique(code, return_index=True)
    return code, sample, len(sample)


def build(rows: DataFrame, keys: Sequence[str], fields: Sequence[str], eps: float = EPS) -> DataFrame:
    """Summaries per input partition: (keys, field, salt, state)."""
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "field string, salt int", STATE])

    def whole(t: pa.Table, salt: int) -> Iterator[pa.RecordBatch]:
        code, sample, groups = _groups(t, keys)
        for f in fields:
            x = t[f].to_numpy().astype(float)
            ok = np.isfinite(x)
            c, v, lo, hi, n = summarise(code[ok], x[ok], groups, eps / 2)
            out = {k: t[k].combine_chunks().take(pa.array(sample)) for k in keys}
            out |= {"field": pa.array([f] * groups, pa.string()), "salt": pa.array(np.full(groups, salt, np.int32))} | _state(c, v, lo, hi, n, groups)
            yield from pa.table(out).filter(pa.array(n > 0)).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % SALTS
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= BUILD_ROWS:
                yield from whole(pa.Table.from_batches(held), salt)
                held = []
        if held:
            yield from whole(pa.Table.from_batches(held), salt)

    return rows.select(*keys, *(F.col(f).cast("double").alias(f) for f in fields)).mapInArrow(run, schema)


def _merge_level(summaries: DataFrame, keys: Sequence[str], eps: float) -> DataFrame:
    """One summary per value of ``keys``; the summaries of a key meet in one task, key after key."""
    schema = ", ".join([*(f"`{k}` {kind}" for k, kind in summaries.select(*keys).dtypes), STATE])

    def merged(t: pa.Table) -> Iterator[pa.RecordBatch]:
        code, sample, groups = _groups(t, keys)
        lists = {k: t[k].combine_chunks() for k in ("v", "lo", "hi")}
        per = lists["v"].value_lengths().to_numpy()
        summary = np.repeat(np.arange(t.num_rows), per)
        flat = {k: x.flatten().to_numpy() for k, x in lists.items()}
        c, v, lo, hi, n = merge(code[summary], summary, flat["v"], flat["lo"], flat["hi"], t["n"].to_numpy(), groups, eps)
        out = {k: t[k].combine_chunks().take(pa.array(sample)) for k in keys} | _state(c, v, lo, hi, n, groups)
        yield from pa.table(out).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        tuples = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            tuples += len(b.column("v").flatten())
            if tuples >= MERGE_TUPLES:  # all keys but the last are complete
                t = pa.Table.from_batches(held).combine_chunks()
                code = _groups(t, keys)[0]
                done = int(np.flatnonzero(code == code[-1])[0])
                if done:
                    yield from merged(t.slice(0, done).combine_chunks())
                held = t.slice(done).combine_chunks().to_batches()
                tuples = sum(len(x.column("v").flatten()) for x in held)
        if held:
            yield from merged(pa.Table.from_batches(held).combine_chunks())

    return summaries.select(*keys, "n", "rank_error", "v", "lo", "hi").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def merge_summaries(summaries: DataFrame, keys: Sequence[str], eps: float = EPS) -> DataFrame:
    """Merge hierarchically: first per (key, salt), then per key."""
    return _merge_level(_merge_level(summaries, [*keys, "salt"], eps / 4), keys, eps / 4)


def percentiles(summaries: DataFrame, keys: Sequence[str], points: Sequence[float] = POINTS) -> DataFrame:
    """(keys, n, rank_error, p01, p05, ...): rank_error is the largest possible, as a share of n."""
    names = [f"p{round(100 * p):02d}" for p in points]
    schema = ", ".join([*(f"`{k}` {kind}" for k, kind in summaries.select(*keys).dtypes), "n long, rank_error double", *(f"{x} double" for x in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            lists = {k: t[k].combine_chunks() for k in ("v", "lo", "hi")}
            flat = {k: x.flatten().to_numpy() for k, x in lists.items()}
            per, n = lists["v"].value_lengths().to_numpy(), t["n"].to_numpy()
            first = np.cumsum(per) - per
            of = np.repeat(np.arange(len(per)), per)
            mid = (flat["lo"] + flat["hi"]) / 2.0
            scale = 2.0 * (n.max() + 1)
            key = of * scale + mid
            out = {k: t[k] for k in keys} | {"n": t["n"], "rank_error": pa.array(t["rank_error"].to_numpy() / n)}
            for p, name in zip(points, names, strict=True):
                r = np.maximum(np.ceil(p * n - 1e-9), 1)
                right = np.clip(np.searchsorted(key, np.arange(len(per)) * scale + r), first, first + per - 1)
                left = np.maximum(right - 1, first)
                off = [np.maximum(r - flat["lo"][i], flat["hi"][i] - r) for i in (left, right)]
                out[name] = pa.array(flat["v"][np.where(off[0] <= off[1], left, right)])
            yield from pa.table(out).combine_chunks().to_batches()

    return summaries.mapInArrow(run, schema)


def community_rows(communities: DataFrame) -> DataFrame:
    """Each record once; rows without record_id have no key to compare and all count."""
    rows = communities.select("record_id", F.col("written_at").cast("date").alias("day"), "species_symbol", "ecocode", "biomass", "age")
    return rows.filter("record_id is not null").dropDuplicates(["record_id"]).unionByName(rows.filter("record_id is null")).drop("record_id")


KEYS, FIELDS = ("species_symbol", "ecocode"), ("biomass", "age")


def day_summaries(communities: DataFrame, eps: float = EPS) -> DataFrame:
    """(day, species_symbol, ecocode, field, state): the stored form of single days, with DAYS of the permitted error."""
    keys = ["day", *KEYS]
    return merge_summaries(build(community_rows(communities), keys, FIELDS, DAYS * eps), [*keys, "field"], DAYS * eps)


def combine_days(days: DataFrame, eps: float = EPS) -> DataFrame:
    """Summaries over any set of stored days. The two merges spend the rest: DAYS + 2 (1 - DAYS) x 2 / 4 = 1 of ``eps``."""
    salted = days.withColumn("salt", F.pmod(F.datediff("day", F.lit("1970-01-01").cast("date")), F.lit(SALTS)).cast("int"))
    return merge_summaries(salted.withColumn("salt", F.coalesce("salt", F.lit(0))), [*KEYS, "field"], 2 * (1 - DAYS) * eps)


def community_percentiles(communities: DataFrame, eps: float = EPS) -> DataFrame:
    """(species_symbol, ecocode, field, n, rank_error, percentiles) over all days."""
    keys = [*KEYS, "field"]
    return percentiles(merge_summaries(build(community_rows(communities), KEYS, FIELDS, eps), keys, eps), keys)


def checked(communities: DataFrame, eps: float = EPS) -> DataFrame:
    """(species_symbol, ecocode, field, n, within): whether every percentile is within the stated error of its exact rank."""
    names = [f"p{round(100 * p):02d}" for p in POINTS]
    found = community_percentiles(communities, eps)
    values = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in FIELDS))).alias("e")
    rows = community_rows(communities).select(*KEYS, values).select(*KEYS, "e.field", "e.x").filter("x is not null and not isnan(x) and abs(x) < double('infinity')")
    same = (F.col("a.species_symbol").eqNullSafe(F.col("b.species_symbol"))) & (F.col("a.ecocode").eqNullSafe(F.col("b.ecocode"))) & (F.col("a.field") == F.col("b.field"))
    met = rows.alias("a").join(found.alias("b"), same).select("b.*", F.col("a.x").alias("x"))
    counts = [F.sum((F.col("x") < F.col(c)).cast("long")).alias(f"{c}_below") for c in names] + [F.sum((F.col("x") <= F.col(c)).cast("long")).alias(f"{c}_upto") for c in names]
    per = met.groupBy(*KEYS, "field", "n", "rank_error").agg(F.count("*").alias("rows"), *counts)
    off = [F.greatest(F.greatest(F.ceil(F.lit(p) * F.col("n") - 1e-9), F.lit(1)) - F.col(f"{c}_upto"), F.col(f"{c}_below") + 1 - F.greatest(F.ceil(F.lit(p) * F.col("n") - 1e-9), F.lit(1)), F.lit(0)) for p, c in zip(POINTS, names, strict=True)]
    within = (F.greatest(*off) <= F.greatest(F.col("rank_error") * F.col("n"), F.lit(0.0))) & (F.col("rank_error") <= eps) & (F.col("rows") == F.col("n"))
    return per.select(*KEYS, "field", "n", within.alias("within"))
