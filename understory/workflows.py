"""Whole runs, from tables or files to saved results: preparing measurements, calibrating, simulating a landscape.

Every step is one of the operators; these functions only wire them and write what they return. The command line
(``python -m understory``) calls them.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from understory.functions import agecdf as A
from understory.operators import cohorts as C
from understory.operators import sinks
from understory.operators.landscape import Landscape
from understory.operators.params import Params
from understory.operators.search import Schedule, State, calibrate
from understory.operators.simulate import gathered, sites_of
from understory.operators.succession import Semantics
from understory.session import cut_table, load_text
from understory.sources import raster, sqlite, tables

log = logging.getLogger("understory")


@contextmanager
def step(what: str) -> Iterator[None]:
    """Say what is being done and how long it took."""
    began = time.perf_counter()
    log.info("%s", what)
    yield
    log.info("%s: %.1f s", what, time.perf_counter() - began)


def read_deliveries(spark: SparkSession, path: str, name: str | None = None, ecos: Sequence[str] = (), only_undisturbed: bool = False) -> DataFrame:
    """Delivered cohorts from SQLite (with the name of a table), CSV or Parquet; both filters reach the scan where it can filter."""
    if name:
        df = sqlite.read_sqlite(spark, path, name)
    elif path.endswith(".csv"):
        df = tables.read_csv(spark, path)
    else:
        df = spark.read.parquet(path)
    df = C.in_ecos(df, ecos)
    return C.undisturbed(df) if only_undisturbed else df


def prepare(deliveries: DataFrame, ecos: DataFrame, species: DataFrame, output: str) -> dict:
    """Delivered cohorts to the table of measurements, dates as text and in the listed order, with its extents as JSON."""
    spark = deliveries.sparkSession
    with step("measurements"):
        splots = cut_table(C.splots(C.valid_cohorts(deliveries, ecos, species)))
        sinks.write_table(C.dates_as_text(C.in_listed_order(splots)), f"{output}/splots")
    found = C.extents(splots).first().asDict()
    sinks.save_json(spark, found, f"{output}/extents.json")
    return found


def parametrize(deliveries: DataFrame, ecos: DataFrame, species: DataFrame, output: str, losses: A.LossParams = A.LossParams(), schedule: Schedule = Schedule(max_iter=30_000, initial_t=1e3), batch: int = 8, seed: int = 1337, sem: Semantics = Semantics(), share: float = 1.0) -> tuple[Params, State]:
    """Calibrate parameters against the measurements of delivered cohorts; an interrupted run goes on where it stopped.

    All sites count unless a ``share`` below 1 asks for a sample of them. Writes best_params.json, search.json and the
    trials as a table to ``output``.
    """
    spark = deliveries.sparkSession
    with step("measurements"):
        splots = cut_table(C.with_biomass(C.splots(C.valid_cohorts(deliveries, ecos, species))))
    ends = splots.agg(F.max("age_calc"), F.min("sim_year"), F.max("sim_year")).first()
    if ends[0] is None:
        raise ValueError("no usable measurements")
    if ends[1] != 0:
        raise ValueError("every plot must have a measurement in year 0")
    with step("reference distributions"):
        measured = A.reference_distributions(splots, losses, ends[0])
        reference = cut_table(measured.select(F.col("plot_id").alias("site"), F.col("sim_year").alias("year"), F.col("species_symbol_map").alias("species"), "agb", "cdf"))
    sites = gathered(sites_of(C.initial_cohorts(splots), "plot_id", "eco", "species_symbol_map", "age_calc", sem, bio="agb_sum"))
    if share < 1:
        sites = C.sample_sites(sites, share, seed)
    first = Params.draw(splots.select("eco", F.col("species_symbol_map").alias("species")), seed)
    with step("trials"):
        best, state, trace = calibrate(first, sites, reference, range(ends[2] + 1), losses, schedule, batch, seed, output, sem=sem)
    if trace:
        rows = spark.createDataFrame([tuple(t.values()) for t in trace], "trial int, loss double, accepted boolean, t double, current double, best double")
        rows.coalesce(1).write.mode("append").parquet(f"{output}/trials")
    return best, state


def load_params(spark: SparkSession, path: str) -> Params:
    text = load_text(spark, path)
    if text is None:
        raise ValueError(f"{path} doesn't exist")
    return Params.from_json(text)


def simulate_landscape(plot_raster: str, eco_raster: str, attributes: DataFrame, cohorts: DataFrame, lists: tuple[DataFrame, DataFrame, DataFrame], params: Params, output: str, horizon: int = 50, seed: int = 1337, plot_column: str = "PLT_CN", sem: Semantics = Semantics()) -> dict:
    """Two rasters to yearly records, the raster of simulated pixels and one raster of biomass per year.

    ``lists``: the tables of ecoregions, of mapped species and of all species; ``cohorts`` are delivered rows.
    """
    spark = cohorts.sparkSession
    plots, ecos = raster.read_meta(plot_raster), raster.read_meta(eco_raster)
    if (plots.width, plots.height) != (ecos.width, ecos.height):
        raise ValueError("the rasters differ in size")
    with step("pixels and communities"):
        pixels = raster.with_ecocodes(raster.plot_pixels(raster.read_pixels(spark, plot_raster), attributes, plot_column), raster.read_pixels(spark, eco_raster, False))
        pixels = cut_table(pixels.filter("plt_cn is not null and ecocode is not null"))
        land = Landscape(pixels, C.valid_cohorts(cohorts, lists[0], lists[2]), lists)
        sites = cut_table(land.sites(sem))
    raster.write_pixels(sinks.raster_mapcodes(pixels, sites.select(F.col("site").alias("mapcode"))), f"{output}/output_communities.tif", plots, "int32", 0, "value")
    with step("simulation"):
        sinks.write_records(land.simulate(*params.tables(spark), range(1, horizon + 1), seed, sem, sites), f"{output}/records")
    counts = pixels.agg(F.count("*").alias("pixels")).first()["pixels"], sites.count()
    with step("rasters of biomass"):
        files = raster_years(spark, f"{output}/records", plot_raster, output)
    found = {"pixels": counts[0], "sites": counts[1], "missed_percent": 100 * (1 - counts[1] / counts[0]) if counts[0] else None, "rasters": files, "semantics": asdict(sem)}
    sinks.save_json(spark, found, f"{output}/run.json")
    return found


def raster_years(spark: SparkSession, records: str, like: str, output: str) -> list[str]:
    """agb_<year>.tif of every year of stored records."""
    return raster.write_yearly(sinks.raster_agb(tables.read_records(spark, records)), output, raster.read_meta(like))
