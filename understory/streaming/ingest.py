"""Deliveries as a stream: raw lines are parsed on arrival and per-entity cells are kept up to date.

Both are plain Structured Streaming plans. Cells merge by sum, sum and max, so the stored state of earlier
batches and the cells of a new one combine like the states of any two partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from understory.functions.dates import parse_day
from understory.operators import absent, features, lines

_FIELD = {"species_symbol_map": "text"}


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def parsed_lines(deliveries: DataFrame) -> DataFrame:
    """Typed rows and rejected lines of a stream of raw lines, as they come."""
    return lines.parse(deliveries)


def counts_by_window(cohorts: DataFrame, width: str = "30 days", late: str = "90 days") -> DataFrame:
    """Cohorts and biomass per ecoregion and window of delivery; rows later than ``late`` are dropped."""
    at = F.col("loaded_at").cast("timestamp")
    return (
        cohorts.withColumn("at", at).withWatermark("at", late).groupBy(F.window("at", width), "eco")
        .agg(F.count("*").alias("n"), F.sum(features.finite("agb")).alias("agb"))
        .select(F.col("window.start").alias("from"), "eco", "n", "agb")
    )


def keep_cells(cohorts: DataFrame, types: list[str], state: str, checkpoint: str) -> StreamingQuery:
    """Merge every batch into the cells stored under ``state``/<version>; a failed batch is done again in full.

    Every batch writes a version of its own, so that it never overwrites what it reads, and a batch that is run
    twice starts from the version before it. Beside the cells stand, by version as well, the cohort_ids that came
    first with it (``ids``; a cohort counts once, however often it is delivered) and the tally of "not recorded"
    spellings so far (``codes``). Stored cells keep every spelling, since which of them recur changes with the
    rows; read them by ``kept_cells``.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        tally = absent.tally(batch, _FIELD)
        if number:
            tally = tally.unionByName(spark.read.parquet(f"{state}/codes/{number - 1}"))
        merged = tally.groupBy("field", "code").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        merged.coalesce(1).write.mode("overwrite").parquet(f"{state}/codes/{number}")
        known = batch.filter("cohort_id is not null").dropDuplicates(["cohort_id"])
        if number:
            known = known.join(spark.read.parquet(*(f"{state}/ids/{k}" for k in range(number))), "cohort_id", "left_anti").select(*batch.columns)
        known.select("cohort_id").write.mode("overwrite").parquet(f"{state}/ids/{number}")
        once = known.unionByName(batch.filter("cohort_id is null"))
        new = features.cells(
            once.select(F.col("plt_cn").alias("entity"), F.col("species_symbol_map").alias("kind"), features.finite("agb").alias("total"), parse_day("measdate").alias("day")), types
        )
        both = new.unionByName(spark.read.parquet(f"{state}/{number - 1}")) if number else new
        features.merge_cells(both).write.mode("overwrite").parquet(f"{state}/{number}")
        batch.unpersist()

    return cohorts.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_cells(spark: SparkSession, types: list[str], state: str, number: int) -> DataFrame:
    """The cells after batch ``number``: those of ``features.cohort_events`` over all rows up to it."""
    codes = absent.codes_of(spark.read.parquet(f"{state}/codes/{number}").collect(), _FIELD)["species_symbol_map"]
    listed = [i for i, t in enumerate(types) if t.strip(absent.WHITE).lower() in ("", *codes)]
    missing = F.col("type_ix").isin(listed) | ((F.col("type_ix") < 0) & absent.is_absent("kind", codes))
    cells = spark.read.parquet(f"{state}/{number}").withColumn("missing", missing)
    return features.merge_cells(cells.select("entity", F.when(F.col("missing"), -1).otherwise(F.col("type_ix")).alias("type_ix"), F.when(~F.col("missing"), F.col("kind")).alias("kind"), "n", "total", "latest"))
