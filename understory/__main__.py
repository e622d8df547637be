"""Command line: python -m understory prepare | calibrate | landscape | rasters; -h names the options of each."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from understory import workflows as W
from understory.functions.agecdf import AgeBins, LossParams
from understory.operators.search import Schedule
from understory.session import drop_intermediates
from understory.sources import raster


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="understory", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        c.add_argument("--output", required=True)
        return c

    def lists(c: argparse.ArgumentParser) -> None:
        c.add_argument("--cohorts", required=True, help="delivered cohorts: Parquet, .csv, or a SQLite file with --table")
        c.add_argument("--table")
        c.add_argument("--ecos", required=True, help="Parquet of the ecoregions")
        c.add_argument("--species", required=True, help="Parquet of all species")
        c.add_argument("--eco", action="append", default=[], help="only this ecoregion; may be repeated")
        c.add_argument("--undisturbed", action="store_true")
        c.add_argument("--seed", type=int, default=1337)

    lists(command("prepare", "write the table of measurements"))
    c = command("calibrate", "anneal over parameters")
    lists(c)
    c.add_argument("--trials", type=int, default=30_000)
    c.add_argument("--batch", type=int, default=8)
    c.add_argument("--edges", type=int, nargs="+", default=[5, 10, 20, 40, 60, 80], help="upper edges of the age bins")
    c.add_argument("--share", type=float, default=1.0, help="share of the sites to score")
    c = command("landscape", "simulate the pixels of two rasters")
    lists(c)
    c.add_argument("--species-map", required=True, help="Parquet of the species map")
    c.add_argument("--plot-raster", required=True)
    c.add_argument("--eco-raster", required=True)
    c.add_argument("--attributes", help="attribute table of the plot raster: Parquet, .dbf or .aux.xml; by default the one beside it")
    c.add_argument("--plot-column", default="PLT_CN")
    c.add_argument("--params", required=True, help="best_params.json of a calibration")
    c.add_argument("--horizon", type=int, default=50)
    c = command("rasters", "one raster of biomass per year of stored records")
    c.add_argument("--records", required=True)
    c.add_argument("--like", required=True, help="raster whose geometry is taken over")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> object:
    a = _parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    own = spark is None
    spark = spark or SparkSession.builder.appName(f"understory {a.command}").getOrCreate()
    try:
        if a.command == "rasters":
            return W.raster_years(spark, a.records, a.like, a.output)
        rows = W.read_deliveries(spark, a.cohorts, a.table, a.eco, a.undisturbed)
        ecos, species = spark.read.parquet(a.ecos), spark.read.parquet(a.species)
        if a.command == "prepare":
            return W.prepare(rows, ecos, species, a.output)
        if a.command == "calibrate":
            return W.parametrize(rows, ecos, species, a.output, LossParams(AgeBins(tuple(a.edges))), Schedule(max_iter=a.trials, initial_t=1e3), a.batch, a.seed, share=a.share)
        table = spark.read.parquet(a.attributes) if a.attributes and not a.attributes.endswith((".dbf", ".xml")) else raster.read_attributes(spark, a.plot_raster, a.attributes)
        return W.simulate_landscape(a.plot_raster, a.eco_raster, table, rows, (ecos, spark.read.parquet(a.species_map), species), W.load_params(spark, a.params), a.output, a.horizon, a.seed, a.plot_column)
    finally:
        if own:
            drop_intermediates(spark)
            spark.stop()


if __name__ == "__main__":
    main()
