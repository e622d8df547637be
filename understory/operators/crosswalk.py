"""Pixels, plots and ecoregions: which species, of which ecoregion, a pixel's cohorts stand for.

A pixel carries the measurement (plt_cn) that resembles it best and the ecoregion it lies in. The species of
the measurement's cohorts are resolved in the pixel's ecoregion: by the species map, else by the catch-all of
that ecoregion for soft- or hardwood, else they are borrowed from the ecoregion of the measurement itself.
Where one species of a pixel ecoregion comes from several, the one with most trees stands for all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from understory.operators.cohorts import list_ids, numbered_plots
from understory.schemas import PLOT_KEY
from understory.session import cut_table, if_small, lookup

#: What the resolution of a cohort depends on.
KIND = ["eco", "species_symbol", "species_symbol_map", "sftwd_hrdwd"]


def pixel_pairs(pixels: DataFrame) -> DataFrame:
    """(plt_cn, ecocode, count) over the pixels that have a measurement."""
    return pixels.filter("plt_cn is not null").groupBy("plt_cn", "ecocode").agg(F.count("*").alias("count"))


def kinds(pairs: DataFrame, cohorts: DataFrame) -> DataFrame:
    """(raster_ecocode, KIND, trees): what is to be resolved, reduced before and after the one join."""
    narrow = cohorts.groupBy("plt_cn", *KIND).agg(F.sum("tree_count").alias("trees"))
    met = pairs.select("plt_cn", F.col("ecocode").alias("raster_ecocode")).join(narrow, "plt_cn")
    return met.groupBy("raster_ecocode", *KIND).agg(F.sum("trees").alias("trees"))


def resolve_kinds(found: DataFrame, ecos: DataFrame, species_eco: DataFrame, species: DataFrame) -> DataFrame:
    """Per kind, and per row of the species map that names it: own and effective ecoregion and species, and whether it is borrowed."""
    target = ecos.select(F.col("ecocode").alias("raster_ecocode"), F.col("eco").alias("raster_eco"))
    own = ecos.select("eco", F.col("ecocode").alias("own_ecocode"))
    mapped = species_eco.select(F.col("eco").alias("raster_eco"), "species_symbol", F.col("species_symbol_map").alias("mapped"))
    rest = species.select(F.col("species_symbol_map").alias("catch_all")).distinct()
    catch_all = F.concat(F.coalesce("raster_eco", F.lit("")), F.lit("_"), F.coalesce("sftwd_hrdwd", F.lit("")))
    joined = (
        found.join(target, "raster_ecocode").join(own, "eco")
        .join(mapped, ["raster_eco", "species_symbol"], "left").join(rest, catch_all == F.col("catch_all"), "left")
    )
    meant = F.coalesce("mapped", "catch_all")
    return joined.select(
        "raster_ecocode", "raster_eco", *KIND, "trees", meant.isNull().alias("borrowed"),
        F.when(meant.isNull(), F.col("eco")).otherwise(F.col("raster_eco")).alias("effective_eco"),
        F.when(meant.isNull(), F.col("own_ecocode")).otherwise(F.col("raster_ecocode")).alias("effective_ecocode"),
        F.coalesce(meant, "species_symbol_map").alias("effective_species"),
    )


def group_totals(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("raster_ecocode", "effective_species", "effective_eco", "effective_ecocode").agg(F.sum("trees").alias("group_count"))


def dominant(totals: DataFrame) -> DataFrame:
    """The source with most trees per (pixel ecoregion, species); ties go to the first ecoregion by name."""
    w = Window.partitionBy("raster_ecocode", "effective_species").orderBy(F.desc_nulls_last("group_count"), "effective_eco", "effective_ecocode")
    return totals.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", "group_count")


def by_dominant(resolved: DataFrame) -> DataFrame:
    """Resolved kinds with the effective ecoregion of the dominant source of their species."""
    return resolved.drop("effective_eco", "effective_ecocode").join(dominant(group_totals(resolved)), ["raster_ecocode", "effective_species"])


def attach(pairs: DataFrame, cohorts: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row per (pixel pair, cohort, mapping): the cohort with what its kind stands for there."""
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KIND], F.col("ecocode") == F.col("raster_ecocode"))
    known = resolved.select("raster_ecocode", "raster_eco", "borrowed", "effective_eco", "effective_ecocode", "effective_species", *(F.col(k).alias(f"_{k}") for k in KIND))
    return pairs.select("plt_cn", "ecocode").join(cohorts, "plt_cn").join(known, same).drop("ecocode", *(f"_{k}" for k in KIND))


class Crosswalk:
    """The crosswalk of a set of pixels: which kinds there are is found, resolved and written once, cohorts are attached last."""

    def __init__(self, pixels: DataFrame, cohorts: DataFrame, ecos: DataFrame, species_eco: DataFrame, species: DataFrame) -> None:
        self.pairs = if_small(cut_table(pixel_pairs(pixels)))
        self.cohorts = cut_table(cohorts)
        self.resolved = cut_table(resolve_kinds(kinds(self.pairs, self.cohorts), ecos, species_eco, species))

    def full(self) -> DataFrame:
        return attach(self.pairs, self.cohorts, if_small(self.resolved))

    def final(self) -> DataFrame:
        """Every row of ``full`` with the effective ecoregion of the dominant source of its species."""
        return attach(self.pairs, self.cohorts, if_small(cut_table(by_dominant(self.resolved))))


def effective_splots(resolved: DataFrame) -> DataFrame:
    """Normalised measurements per pixel ecoregion with effective ids."""
    keys = ["plt_cn", *PLOT_KEY, "raster_ecocode", "raster_eco", "effective_eco", "effective_ecocode", "effective_species", "measdate", "age_calc"]
    sums = cut_table(resolved.groupBy(*keys).agg(F.count("*").alias("count"), F.sum("agb").alias("agb_sum")))
    placed = lookup(sums, numbered_plots(sums, [*PLOT_KEY, "raster_ecocode"]), [*PLOT_KEY, "raster_ecocode"], "age_calc")
    for column, name in (("raster_eco", "eco_id"), ("effective_eco", "effective_eco_id"), ("effective_species", "species_id")):
        placed = placed.join(if_small(cut_table(list_ids(sums, column, name))), column)
    return placed


def pixel_cohorts(pixels: DataFrame, splots: DataFrame) -> DataFrame:
    """Every pixel with the cohorts of its measurement in its ecoregion; pixels without any keep one row of nulls."""
    c = splots.select("plt_cn", F.col("raster_ecocode").alias("ecocode"), "effective_eco", "effective_species", "age_calc", "agb_sum")
    return pixels.join(c, ["plt_cn", "ecocode"], "left")


def missed_pixels(pixels: DataFrame, splots: DataFrame) -> DataFrame:
    return pixels.join(splots.select("plt_cn", F.col("raster_ecocode").alias("ecocode")), ["plt_cn", "ecocode"], "left_anti")


def miss_rate(pixels: DataFrame, splots: DataFrame) -> DataFrame:
    """Share of the pixels without cohorts, in percent."""
    have = splots.select("plt_cn", F.col("raster_ecocode").alias("ecocode"), F.lit(1).alias("hit")).distinct()
    return pixels.join(have, ["plt_cn", "ecocode"], "left").agg((F.avg(F.col("hit").isNull().cast("int")) * 100).alias("miss_rate"))


def landscape_params(splots: DataFrame, eco_species: DataFrame) -> DataFrame:
    """The parameters of a landscape, keyed by pixel ecoregion and species: those of the effective ecoregion, numbered anew."""
    mapped = require_complete(remap_params(splots, eco_species), ["eco", "effective_eco", "species", "param_local_id"])
    values = eco_species.withColumnRenamed("eco", "effective_eco").drop("local_id")
    return mapped.join(values, ["effective_eco", "species"]).drop("effective_eco", "param_local_id")


def remap_params(splots: DataFrame, eco_species: DataFrame) -> DataFrame:
    """Local species of every pixel ecoregion with the parameters they borrow, by names instead of positions.

    (eco, effective_eco, species, param_local_id, local_id): ``local_id`` numbers the species of a pixel ecoregion.
    """
    used = splots.select(F.col("raster_eco").alias("eco"), "effective_eco", F.col("effective_species").alias("species")).distinct()
    params = eco_species.select(F.col("eco").alias("effective_eco"), "species", F.col("local_id").alias("param_local_id"))
    w = Window.partitionBy("eco").orderBy("effective_eco", "species")
    return used.join(params, ["effective_eco", "species"]).withColumn("local_id", F.row_number().over(w))


def require_complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fail while running if any of the columns holds a null."""
    for c in columns:
        df = df.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is null")).cast(df.schema[c].dataType)))
    return df

