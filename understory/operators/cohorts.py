"""From delivered cohort rows to the normalised measurement table (splots).

Plots are named by four columns. Surrogate ids are dense and 1-based; they are numbered on the distinct keys,
so that no window ever spans the whole fact table on a single task for more than the keys themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from understory.functions.dates import parse_day
from understory.operators.absent import is_absent, recurring_codes
from understory.schemas import COHORTS, PLOT_KEY
from understory.session import cut, cut_table, if_small, lookup

#: Possible ages, both included.
AGES = (1, 1500)
MEASUREMENT = ["plt_cn", *PLOT_KEY, "eco", "measdate", "species_symbol_map", "age_calc"]


def in_ecos(df: DataFrame, ecos: Sequence[str], column: str = "eco") -> DataFrame:
    """Rows of the listed ecoregions; an empty list keeps all."""
    return df.filter(F.col(column).isin(*ecos)) if ecos else df


def undisturbed(df: DataFrame) -> DataFrame:
    """Rows of plots without disturbance; an unknown state is dropped."""
    return df.filter(F.col("subp_has_dstrb") == "f")


def valid_cohorts(cohorts: DataFrame, ecos: DataFrame, species: DataFrame) -> DataFrame:
    """Cohorts fit for the model, once each: whole plot key, readable day, listed eco and species, possible age.

    Ages that stand for "not recorded" are none. An impossible or missing agb becomes null and is skipped by sums;
    its cohort still counts. Improbable readings stay: flagging them is another operator's task.
    """
    codes = recurring_codes(cohorts, {"age_calc": "age"})["age_calc"]
    possible = F.when((F.col("agb") >= 0) & (F.col("agb") < float("inf")), F.col("agb"))
    rows = (
        cohorts.select(*(c for c in COHORTS.names if c != "loaded_at")).withColumn("measdate", parse_day("measdate"))
        .filter(F.col("measdate").isNotNull() & F.col("age_calc").between(*AGES) & ~is_absent("age_calc", codes)).dropna(subset=["plt_cn", *PLOT_KEY])
        .withColumn("agb", possible).distinct()
    )
    # both lists are reference tables of a fixed, small size; without a hint the optimiser broadcasts them
    return rows.join(ecos.select("eco"), "eco", "left_semi").join(species.select("species_symbol_map"), "species_symbol_map", "left_semi")


def with_biomass(df: DataFrame, agb: str = "agb_sum") -> DataFrame:
    """Measurements that have a biomass at all."""
    return df.filter(F.col(agb).isNotNull())


def group_sum(df: DataFrame, keys: Sequence[str] = tuple(MEASUREMENT)) -> DataFrame:
    """Number of cohorts and summed agb per key; null keys form groups, null agb is skipped."""
    return df.groupBy(*keys).agg(F.count("*").alias("count"), F.sum("agb").alias("agb_sum"))


def with_start(df: DataFrame) -> DataFrame:
    """First measurement day of every plot, as a window: no self-join."""
    return df.withColumn("start_measdate", F.min("measdate").over(Window.partitionBy(*PLOT_KEY)))


def with_start_joined(df: DataFrame) -> DataFrame:
    """The same by partial aggregation and a join back, for plots that hold very many rows."""
    return df.join(df.groupBy(*PLOT_KEY).agg(F.min("measdate").alias("start_measdate")), PLOT_KEY)


def sim_year(day: str = "measdate", start: str = "start_measdate") -> Column:
    """Simulated year of a measurement: whole years since the first, rounded."""
    return F.rint(F.datediff(day, start) / 365.25).cast("int")


def year_deficit() -> Column:
    """Year in which a cohort was established relative to the first measurement; negative: before it."""
    born = F.add_months(F.col("measdate"), -12 * F.col("age_calc"))
    return F.rint(F.datediff(born, "start_measdate") / 365.25).cast("int")


def spinup_cohorts(df: DataFrame) -> DataFrame:
    return df.filter("year_deficit < -1")


def initial_cohorts(df: DataFrame) -> DataFrame:
    return df.filter("sim_year = 0")


def dense_ids(df: DataFrame, keys: Sequence[str], name: str, unique: bool = False) -> DataFrame:
    """(keys, name): 1-based ids in the order of the keys; a table of ``unique`` keys keeps its other columns.

    Distinct keys are range-partitioned, numbered within the partitions and shifted by the number of keys
    before: numbering needs no single-task window over the keys.
    """
    distinct = df if unique else df.select(*keys).distinct()
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()  # the partition, and the place within it in the low 33 bits
    parts = cut(distinct.repartitionByRange(n, *keys).sortWithinPartitions(*keys)).select("*", F.shiftright(at, 33).alias("_pid"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_no"))
    counts = parts.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = counts.select("_pid", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    # one row per partition is all that is broadcast
    return parts.join(F.broadcast(before), "_pid").select(*distinct.columns, (F.col("_off") + F.col("_no") + 1).cast("long").alias(name))


def numbered_plots(sums: DataFrame, keys: Sequence[str], name: str = "plot_id") -> DataFrame:
    """(keys, start_measdate, name), written: every plot with its id and first measurement day, found on the plots alone."""
    plots = dense_ids(sums.groupBy(*keys).agg(F.min("measdate").alias("_first")), keys, name, unique=True)
    return cut_table(plots.withColumn("start_measdate", F.min("_first").over(Window.partitionBy(*PLOT_KEY))).drop("_first"))


def list_ids(df: DataFrame, column: str, name: str) -> DataFrame:
    """Ids of a short dictionary (species, ecoregions) in sorted order."""
    distinct = df.select(column).distinct()
    return distinct.withColumn(name, F.row_number().over(Window.orderBy(column)).cast("long"))


def eco_species_ids(df: DataFrame, eco: str = "eco", species: str = "species_symbol_map") -> DataFrame:
    """(eco, species, eco_species_id): 1-based place of a species in the sorted list of its ecoregion."""
    pairs = df.select(eco, species).distinct()
    return pairs.withColumn("eco_species_id", F.row_number().over(Window.partitionBy(eco).orderBy(species)).cast("long"))


def eco_species_list(df: DataFrame, eco: str = "eco", species: str = "species_symbol_map") -> DataFrame:
    """The sorted species list of every ecoregion as an array."""
    return df.groupBy(eco).agg(F.sort_array(F.collect_set(species)).alias("species_list"))


def site_sim_years(df: DataFrame) -> DataFrame:
    """The years in which a plot was measured, sorted."""
    return df.groupBy(*PLOT_KEY, "eco").agg(F.sort_array(F.collect_set("sim_year")).alias("sim_years"))


def splots(cohorts: DataFrame) -> DataFrame:
    """The normalised measurements: sums per measurement, species and age with their ids and years.

    The sums are written once; all dictionaries are read from them, not from the delivered rows.
    """
    sums = cut_table(group_sum(cohorts))
    pairs = sums.select("eco", "species_symbol_map").distinct()
    # three ids per (ecoregion, species): at most the product of two reference lists
    named = cut_table(eco_species_ids(pairs).join(list_ids(pairs, "eco", "eco_id"), "eco").join(list_ids(pairs, "species_symbol_map", "species_id"), "species_symbol_map"))
    placed = lookup(sums, numbered_plots(sums, [*PLOT_KEY, "eco"]), [*PLOT_KEY, "eco"], "age_calc")
    years = placed.withColumn("sim_year", sim_year()).withColumn("year_deficit", year_deficit())
    return years.join(if_small(named), ["eco", "species_symbol_map"]).select(
        *MEASUREMENT, "count", "agb_sum", "start_measdate", "sim_year", "year_deficit", "plot_id", "eco_id", "species_id", "eco_species_id"
    )


#: The order in which measurements are listed.
LISTED = ["measdate", *PLOT_KEY, "age_calc", "species_symbol_map"]


def in_listed_order(df: DataFrame, keys: Sequence[str] = tuple(LISTED)) -> DataFrame:
    """Rows in the total order of measurements, for output; nothing inside relies on it."""
    return df.orderBy(*(k for k in keys if k in df.columns))


def dates_as_text(df: DataFrame, columns: Sequence[str] = ("measdate", "start_measdate")) -> DataFrame:
    """Dates written as yyyy-MM-dd text, as text-only stores need them."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in columns if c in df.columns})


def extents(splots: DataFrame) -> DataFrame:
    """One row: (n_plots, n_species, n_ecos, max_age, first_year, last_year)."""
    return splots.agg(
        F.max("plot_id").alias("n_plots"), F.max("species_id").alias("n_species"), F.max("eco_id").alias("n_ecos"),
        F.max("age_calc").alias("max_age"), F.min("sim_year").alias("first_year"), F.max("sim_year").alias("last_year"),
    )


def sample_sites(sites: DataFrame, share: float, seed: int, key: str = "site") -> DataFrame:
    """A share of the sites without replacement, exact to one site: those with the lowest hashes of their key.

    The same sites come out for any partitioning. It is a feature of its own; no other operator samples.
    """
    hashed = sites.withColumn("_h", F.xxhash64(F.lit(seed), key))
    n = round(share * sites.count())
    return hashed.orderBy("_h", key).limit(n).drop("_h")
