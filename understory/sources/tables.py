"""Readers of delivered tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from understory.operators.cohorts import in_ecos, undisturbed
from understory.schemas import COHORTS


def read_csv(spark: SparkSession, path: str, schema: StructType = COHORTS, line_breaks: bool = False) -> DataFrame:
    """A CSV with header under a fixed schema; malformed values become null.

    Files are split among tasks. With ``line_breaks`` quoted fields may hold line breaks, and a file is one task.
    """
    return spark.read.schema(schema).option("header", True).option("multiLine", line_breaks).option("escape", '"').csv(path)


def read_cohorts(spark: SparkSession, path: str, ecos: Sequence[str] = (), only_undisturbed: bool = False) -> DataFrame:
    """A cohort table (Parquet) with both optional filters, which reach the scan."""
    df = in_ecos(spark.read.parquet(path), ecos)
    return undisturbed(df) if only_undisturbed else df


def read_records(spark: SparkSession, path: str, columns: Sequence[str] = ("year", "mapcode", "biomass")) -> DataFrame:
    """Yearly site records written by year; only the named columns are read."""
    return spark.read.parquet(path).select(*columns)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Records in files named year_<y>_chunk_<c>.parquet; ``file_year`` is the year of the name.

    A chunk may hold several years: use the column ``year`` where there is one.
    """
    files = spark.read.option("pathGlobFilter", "year_*_chunk_*.parquet").parquet(path)
    return files.withColumn("file_year", F.regexp_extract(F.input_file_name(), r"year_(\d+)_chunk_", 1).cast("int"))


def enumerate_list(spark: SparkSession, values: Sequence[str], name: str, id_name: str = "id") -> DataFrame:
    """A literal list as a table with 1-based ids."""
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], f"{id_name} int, {name} string").select(name, id_name)


def explode_lists(df: DataFrame, column: str, name: str, id_name: str) -> DataFrame:
    """A ragged list column as rows with 1-based places."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(column).alias("_p", name)).withColumn(id_name, F.col("_p") + 1).drop("_p")


def register(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)
