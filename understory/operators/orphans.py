"""References to records that do not exist, from signed change deltas.

Every list entry is a +1 of existence on the day it is listed and a -1 on the day it is delisted; every
referring row is a +1 of reference on its day. Per key the deltas are summed in day order: a (key, day)
with positive references and zero existence is an orphan.

``KeptCounts`` maintains the two counts under a folder: a delivery of rows or a change of a list, late ones
included, adds its signed deltas, and only the buckets of the keys it touches are summed again.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from understory.operators.absent import is_absent, recurring_codes
from understory.session import cut_table, exists, load_text, lookup, save_text

#: Rows without a day are judged against the list as it stands last.
NO_DAY = "9999-12-31"
#: Which table and field refers to which list.
USES = (
    ("data_eco_cohorts", "species_symbol_map", "species"),
    ("output_communities", "species_symbol", "species"),
    ("output_communities", "ecocode", "ecocode"),
)


def existence_deltas(listing: DataFrame, key: str, ref_table: str) -> DataFrame:
    """(list_name, ref, day, exists). Entries without listed_on, or delisted before they are listed, never exist."""
    ok = listing.filter(F.col(key).isNotNull() & F.col("listed_on").isNotNull() & (F.col("delisted_on").isNull() | (F.col("delisted_on") > F.col("listed_on"))))
    both = F.array(
        F.struct(F.col("listed_on").cast("date").alias("day"), F.lit(1).alias("exists")),
        F.struct(F.col("delisted_on").cast("date").alias("day"), F.lit(-1).alias("exists")),
    )
    return ok.select(F.lit(ref_table).alias("list_name"), F.col(key).cast("string").alias("ref"), F.explode(both).alias("d")).select(
        "list_name", "ref", "d.day", "d.exists"
    ).filter("day is not null")


def references(rows: DataFrame, table_name: str, row_id: str, at: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """(table_name, field, list_name, row_id, ref, day): one row per reference; ``fields`` maps a field to (column, list)."""
    parts = [
        F.struct(F.lit(f).alias("field"), F.lit(to).alias("list_name"), F.col(c).cast("string").alias("ref"))
        for f, (c, to) in fields.items()
    ]
    return rows.select(
        F.lit(table_name).alias("table_name"), F.col(row_id).alias("row_id"),
        F.coalesce(F.col(at).cast("date"), F.lit(NO_DAY).cast("date")).alias("day"), F.explode(F.array(*parts)).alias("e"),
    ).select("table_name", "e.field", "e.list_name", "row_id", "e.ref", "day").filter("ref is not null")


def deltas(refs: DataFrame, existence: DataFrame) -> DataFrame:
    """(table_name, field, ref, day, n_refs, exists): the signed deltas per (key, day), of references and of existence.

    References are summed per (key, day) before the shuffle, so a key that holds a third of all rows is no
    more than one row per day and partition.
    """
    counted = refs.groupBy("table_name", "field", "ref", "day").agg(F.count("*").alias("n_refs"))
    used_by = F.explode(F.array(*(F.struct(F.lit(t).alias("table_name"), F.lit(f).alias("field"), F.lit(to).alias("to")) for t, f, to in USES)))
    listed = existence.withColumn("u", used_by).filter("list_name = u.to").groupBy("u.table_name", "u.field", "ref", "day").agg(F.sum("exists").alias("exists"))
    none = F.lit(0).cast("long")
    return counted.select("table_name", "field", "ref", "day", "n_refs", none.alias("exists")).unionByName(listed.select("table_name", "field", "ref", "day", none.alias("n_refs"), F.col("exists").cast("long").alias("exists")))


def orphans_among(signed: DataFrame) -> DataFrame:
    """(table_name, field, ref, day, n_refs) of the keys that are referred to on a day on which they don't exist."""
    per_day = signed.groupBy("table_name", "field", "ref", "day").agg(F.sum("n_refs").alias("n_refs"), F.sum("exists").alias("exists"))
    w = Window.partitionBy("table_name", "field", "ref").orderBy("day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return per_day.withColumn("existing", F.sum("exists").over(w)).filter("n_refs > 0 and existing <= 0").select("table_name", "field", "ref", "day", "n_refs")


def orphan_days(refs: DataFrame, existence: DataFrame) -> DataFrame:
    return orphans_among(deltas(refs, existence))


class KeptCounts:
    """The signed counts of all deliveries so far, in buckets of keys, with the orphans of every bucket.

    ``apply`` adds the deltas of one delivery: rows (n_refs), list entries and delistings (exists), retracted
    rows with negative counts. It rewrites the buckets of the keys in the delivery and no other. Every delivery
    writes files of its own and moves the pointer ``current`` last, so that one that fails can be done again.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64) -> None:
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def _current(self) -> dict:
        """The version of every bucket that was ever written."""
        text = load_text(self.spark, f"{self.folder}/current")
        return json.loads(text) if text else {"version": 0, "of": {}, "buckets": self.buckets}

    def _read(self, name: str, at: dict[str, int]) -> DataFrame | None:
        paths = [f"{self.folder}/{name}/version={v}/bucket={b}" for b, v in at.items()]
        paths = [p for p in paths if exists(self.spark, p)]
        return self.spark.read.parquet(*paths) if paths else None

    def apply(self, signed: DataFrame) -> None:
        state = self._current()
        bucket = F.pmod(F.xxhash64("table_name", "field", "ref"), F.lit(state["buckets"])).cast("int")
        new = cut_table(signed.groupBy("table_name", "field", "ref", "day").agg(F.sum("n_refs").alias("n_refs"), F.sum("exists").alias("exists")).withColumn("bucket", bucket))
        touched = sorted(r[0] for r in new.select("bucket").distinct().collect())  # one row per bucket at most
        if not touched:
            return
        old = self._read("counts", {b: v for b, v in state["of"].items() if int(b) in touched})
        both = new.drop("bucket") if old is None else new.drop("bucket").unionByName(old)
        summed = both.groupBy("table_name", "field", "ref", "day").agg(F.sum("n_refs").alias("n_refs"), F.sum("exists").alias("exists"))
        version = state["version"] + 1

        def write(df: DataFrame, name: str) -> None:
            df.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{name}/version={version}")

        write(summed, "counts")
        now = {str(b): version for b in touched}
        write(orphans_among(self._read("counts", now)), "orphans")
        save_text(self.spark, f"{self.folder}/current", json.dumps({"version": version, "of": state["of"] | now, "buckets": state["buckets"]}))

    def orphan_days(self) -> DataFrame:
        """What ``orphan_days`` of all deliveries together would give."""
        found = self._read("orphans", self._current()["of"])
        return self.spark.createDataFrame([], "table_name string, field string, ref string, day date, n_refs long") if found is None else found


def all_references(cohorts: DataFrame, communities: DataFrame) -> DataFrame:
    """The references of both tables. An absent species_symbol_map is none; every other value that isn't null is one."""
    codes = recurring_codes(cohorts, {"species_symbol_map": "text"})["species_symbol_map"]
    named = cohorts.filter(~is_absent("species_symbol_map", codes))
    return references(named, "data_eco_cohorts", "cohort_id", "loaded_at", {"species_symbol_map": ("species_symbol_map", "species")}).unionByName(
        references(communities, "output_communities", "record_id", "written_at", {"species_symbol": ("species_symbol", "species"), "ecocode": ("ecocode", "ecocode")})
    )


def all_existence(species: DataFrame, ecos: DataFrame) -> DataFrame:
    return existence_deltas(species, "species_symbol_map", "species").unionByName(existence_deltas(ecos, "ecocode", "ecocode"))


#: Orphan keys by day are broadcast up to this number of rows; more are joined by shuffle.
BROADCAST_DAYS = 500_000


def orphan_rows(refs: DataFrame, existence: DataFrame) -> DataFrame:
    """(table_name, field, row_id), distinct: the records with a row whose reference is an orphan.

    Where the orphan (key, day) pairs are few, the references are looked up where they are read and only orphans
    move. Beyond, both sides are shuffled by (key, day) and a salt, so that a key of very many rows meets many tasks.
    """
    keys = ["table_name", "field", "ref", "day"]
    days = cut_table(orphan_days(refs, existence).select(*keys))
    hit = lookup(refs, days, keys, "row_id", "left_semi", BROADCAST_DAYS)
    return hit.select("table_name", "field", "row_id").distinct()


def orphan_report(refs: DataFrame, existence: DataFrame) -> DataFrame:
    return report(orphan_days(refs, existence))


def report(days: DataFrame) -> DataFrame:
    """Per table, field and month: rows with an orphan reference and the distinct keys they refer to."""
    by_key = days.withColumn("period", F.date_format("day", "yyyy-MM")).groupBy("table_name", "field", "period", "ref").agg(F.sum("n_refs").alias("n"))
    return by_key.groupBy("table_name", "field", "period").agg(F.count("*").alias("orphan_keys"), F.sum("n").alias("orphan_rows"))
