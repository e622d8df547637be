"""Session helpers: table loading, shared checkpoint folder, bounded collects."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; a folder of this machine only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor reaches")
        named = tempfile.mkdtemp(prefix="understory-")
    sc.setCheckpointDir(named)
    atexit.register(_at_exit, spark)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder: fixed partitions and rows, safe against lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_table(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a columnar table in the same folder: cheaper to read many times, in no fixed order."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new folder name beside the intermediate tables."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/understory-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _hadoop(spark, path)
    return fs.exists(at)


def save_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text in any file system Spark knows; the old one stays until the new one is whole."""
    (new, fs), (at, _) = _hadoop(spark, f"{path}.new"), _hadoop(spark, path)
    out = fs.create(new, True)
    out.write(text.encode())
    out.close()
    fs.delete(at, False)
    fs.rename(new, at)


def load_text(spark: SparkSession, path: str) -> str | None:
    """The text saved at a path, if there is one."""
    found = [p for p in (path, f"{path}.new") if exists(spark, p)]
    return spark.read.text(found[0], wholetext=True).first()[0] if found else None


def drop_intermediates(spark: SparkSession) -> None:
    """Remove what ``cut`` and ``cut_table`` wrote in this application. Call it when no result is read any more;
    it is done at the end of the Python process as well."""
    folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        return
    path, fs = _hadoop(spark, folder)
    if fs.exists(path):
        for entry in fs.listStatus(path):
            fs.delete(entry.getPath(), True)


def _at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have been stopped before
        drop_intermediates(spark)


#: Spark's size of a relation it knows nothing of is larger than this.
UNKNOWN = 1 << 60


def _bytes(plan) -> int:
    return int(str(plan.stats().sizeInBytes()))


def width(df: DataFrame, part_bytes: int = 128 << 20) -> int:
    """How many partitions a range partitioning of ``df`` should have: one per core and shuffle partition, more if the
    size asks for it. Estimates behind joins and explodes are wild, so they count up to 8 times the size of what is read;
    rows from a plain RDD have no known size."""
    spark = df.sparkSession
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    read = sum(_bytes(leaves.apply(i)) for i in range(leaves.size()))
    return least if read >= UNKNOWN else max(least, -(-min(_bytes(plan), 8 * read) // part_bytes))


#: Rows up to which a materialised side of a join is broadcast; beyond, both are shuffled. That is stated by a hint: Spark
#: knows only the compressed size of the files, a twentieth of the rows or less, and would broadcast by it.
BROADCAST_ROWS = 500_000


def if_small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """A materialised table, marked for broadcast if it is counted to be small, else for a shuffle."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if limit is None else limit) else df.hint("merge")


def lookup(left: DataFrame, right: DataFrame, keys: list[str], spread: str, how: str = "inner", limit: int | None = None, salts: int = 16) -> DataFrame:
    """Join rows to a materialised table by ``keys``. It is broadcast if it is counted to be small; else both sides are
    shuffled by the keys and a salt of ``spread``, a column of ``left``, so that a key of very many rows meets many tasks."""
    if right.count() <= (BROADCAST_ROWS if limit is None else limit):
        return left.join(F.broadcast(right), keys, how)
    salted = right.withColumn("_salt", F.explode(F.array(*map(F.lit, range(salts))))).hint("merge")
    return left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(salted, [*keys, "_salt"], how).drop("_salt")


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table whose size must be bounded; more than ``limit`` rows is an error, never a cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows")
    return rows
