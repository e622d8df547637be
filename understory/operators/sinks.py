"""Sinks: yearly site records, tables, JSON and rasters."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from understory.session import save_text

NODATA = -9999.0


def write_records(records: DataFrame, path: str, max_rows: int = 5_000_000) -> None:
    """Yearly records as Parquet by year. Rebalancing splits large years and joins small ones by their true sizes, so
    files stay few and no year is bound to a number of writers."""
    records.hint("rebalance", "year").write.mode("overwrite").option("maxRecordsPerFile", max_rows).partitionBy("year").parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append_communities(records: DataFrame, ecos: DataFrame, path: str) -> None:
    """Live cohorts as (year, mapcode, ecocode, species_symbol, age, biomass) rows."""
    ids = ecos.select("eco", "ecocode")
    records.join(ids, "eco").select("year", "mapcode", "ecocode", F.col("species").alias("species_symbol"), "age", "biomass").write.mode("append").parquet(path)


def save_json(spark: SparkSession, obj, path: str) -> None:
    """A small object as JSON, in any file system Spark knows."""
    save_text(spark, path, json.dumps(obj, indent=1))


def raster_agb(records: DataFrame) -> DataFrame:
    """(year, mapcode, agb): summed biomass of every pixel and year."""
    return records.groupBy("year", "mapcode").agg(F.sum("biomass").alias("agb"))


def raster_mapcodes(pixels: DataFrame, sites: DataFrame) -> DataFrame:
    """(mapcode, value): the own code of a simulated pixel, 0 of any other."""
    done = sites.select("mapcode", F.col("mapcode").alias("value")).distinct()
    return pixels.select("mapcode").join(done, "mapcode", "left").select("mapcode", F.coalesce("value", F.lit(0)).alias("value"))
