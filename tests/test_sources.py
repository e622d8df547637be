import datetime
import sqlite3

import numpy as np
import pytest
from helpers import cohort, cohorts

from understory import session
from understory.operators import sinks
from understory.sources import raster, sqlite, tables
from understory.streaming import ingest


def test_csv(spark, tmp_path):
    df = cohorts(spark, [cohort(1, eco='a "b",\nc'), cohort(2, agb=None)])
    df.write.option("header", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert sorted(tables.read_csv(spark, str(tmp_path / "c"), line_breaks=True).collect()) == sorted(df.collect())
    plain = cohorts(spark, [cohort(i) for i in range(2000)])
    plain.coalesce(1).write.option("header", True).csv(str(tmp_path / "p"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        back = tables.read_csv(spark, str(tmp_path / "p"))
        assert back.count() == 2000 and back.rdd.getNumPartitions() > 2  # one file, many tasks
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_filters_reach_the_scan(spark, data):
    df = tables.read_cohorts(spark, f"{data}/data_eco_cohorts.parquet", ["9.3.5.83a"], True).select("eco", "agb")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(subp_has_dstrb,f)" in plan and "9.3.5.83a" in plan.split("PushedFilters")[1] and "tree_count" not in plan


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "c.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (eco TEXT, agb REAL, n INTEGER)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [("a", 1.5, 1), ("b", None, 2), ("c", 2.5, 3), (None, 0.0, 4)] * 25)
    df = sqlite.read_sqlite(spark, path, "t")
    assert df.count() == 100 and [f.dataType.simpleString() for f in df.schema] == ["string", "double", "bigint"]
    assert df.filter(df.eco.isin("a", "b") & (df.n >= 2)).count() == 25
    df.filter("eco = 'c'").coalesce(2).write.format("sqlite").option("path", path).option("table", "out").mode("overwrite").save()
    with sqlite3.connect(path) as db:
        assert db.execute("SELECT count(*), min(eco), sum(agb) FROM out").fetchone() == (25, "c", 62.5)


@pytest.mark.parametrize("kind", ["float32", "int16", "int32", "uint8"])
def test_raster_round_trip(spark, tmp_path, kind):
    data = np.arange(35).reshape(5, 7).astype(kind)
    data[2, 3] = 99
    path = str(tmp_path / "a.tif")
    like = raster.Meta(7, 5, kind, tags={33550: (12, (30.0, 30.0, 0.0)), 33922: (12, (0.0, 0.0, 0.0, 500.0, 900.0, 0.0))})
    raster.write_tiff(path, data, like, 99)
    meta = raster.read_meta(path)
    assert (meta.width, meta.height, meta.nodata, meta.tags) == (7, 5, 99.0, like.tags)
    px = {r.mapcode: r.value for r in raster.read_pixels(spark, path).collect()}
    assert len(px) == 34 and px == {c * 5 + r + 1: float(data[r, c]) for r in range(5) for c in range(7) if data[r, c] != 99}
    assert raster.read_pixels(spark, path, False).count() == 35
    out = str(tmp_path / "b.tif")
    raster.write_pixels(raster.read_pixels(spark, path), out, meta, nodata=-1.0)
    assert {r.mapcode: r.value for r in raster.read_pixels(spark, out).collect()} == px and raster.read_meta(out).tags == like.tags


def test_plot_raster(spark, tmp_path):
    path, eco = str(tmp_path / "p.tif"), str(tmp_path / "e.tif")
    raster.write_tiff(path, np.array([[1, 2], [3, 0]], "int32"), nodata=0)
    raster.write_tiff(eco, np.array([[7, 7], [8, 8]], "int16"))
    rat = spark.createDataFrame([(1, 101), (2, 102)], "Value int, PLT_CN long")
    got = raster.with_ecocodes(raster.plot_pixels(raster.read_pixels(spark, path), rat), raster.read_pixels(spark, eco, False))
    assert {tuple(r) for r in got.select("mapcode", "plt_cn", "ecocode").collect()} == {(1, 101, 7), (3, 102, 7), (2, None, 8)}


def test_records_and_yearly_rasters(spark, tmp_path):
    rec = spark.createDataFrame([(y, m, "e", "s", 3, float(m)) for y in (0, 1) for m in (1, 2, 2, 4)], "year int, mapcode long, eco string, species string, age int, biomass double")
    sinks.write_records(rec, str(tmp_path / "r"))
    back = tables.read_records(spark, str(tmp_path / "r"))
    assert back.columns == ["year", "mapcode", "biomass"] and back.count() == 8
    agb = sinks.raster_agb(back)
    assert {tuple(r) for r in agb.filter("year = 1").collect()} == {(1, 1, 1.0), (1, 2, 4.0), (1, 4, 4.0)}
    files = sorted(raster.write_yearly(agb, str(tmp_path), raster.Meta(2, 2, "float32")))
    assert len(files) == 2 and {r.mapcode: r.value for r in raster.read_pixels(spark, files[0]).collect()} == {1: 1.0, 2: 4.0, 4: 4.0}
    codes = sinks.raster_mapcodes(spark.range(1, 5).withColumnRenamed("id", "mapcode"), back)
    assert {tuple(r) for r in codes.collect()} == {(1, 1), (2, 2), (3, 0), (4, 4)}
    ecos = spark.createDataFrame([("e", 9)], "eco string, ecocode long")
    sinks.append_communities(rec, ecos, str(tmp_path / "c"))
    sinks.append_communities(rec, ecos, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).columns == ["year", "mapcode", "ecocode", "species_symbol", "age", "biomass"]
    assert spark.read.parquet(str(tmp_path / "c")).count() == 16


def test_chunk_files(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"year": pa.array([3, 4], pa.uint32()), "biomass": pa.array([1.0, 2.0], pa.float32())}), tmp_path / "year_4_chunk_1.parquet")
    pq.write_table(pa.table({"year": pa.array([9], pa.uint32()), "biomass": pa.array([1.0], pa.float32())}), tmp_path / "other.parquet")
    assert {tuple(r) for r in tables.read_chunks(spark, str(tmp_path)).select("year", "file_year").collect()} == {(3, 4), (4, 4)}


def test_literal_tables(spark, tmp_path):
    assert [tuple(r) for r in tables.enumerate_list(spark, ["b", "a"], "eco").collect()] == [("b", 1), ("a", 2)]
    ragged = spark.createDataFrame([(1, ["x", "y"]), (2, ["z"])], "eco int, species array<string>")
    assert sorted(map(tuple, tables.explode_lists(ragged, "species", "name", "local").collect())) == [(1, "x", 1), (1, "y", 2), (2, "z", 1)]
    tables.register(ragged, "ragged_lists")
    assert spark.sql("select count(*) from ragged_lists").first()[0] == 2
    sinks.save_json(spark, {"a": 1}, str(tmp_path / "deep" / "x.json"))
    sinks.save_json(spark, {"a": 2}, str(tmp_path / "deep" / "x.json"))
    assert session.load_text(spark, str(tmp_path / "deep" / "x.json")) == '{\n "a": 2\n}' and session.load_text(spark, str(tmp_path / "none")) is None


def test_streams(spark, tmp_path):
    rows = cohorts(spark, [cohort(i, loaded_at=datetime.datetime(2010, 1, 1 + i)) for i in range(20)])
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    src = ingest.read_stream(spark, str(tmp_path / "in"), rows.schema, 2)
    q = ingest.keep_cells(src, ["AAAA"], str(tmp_path / "state"), str(tmp_path / "cp"))
    q.awaitTermination()
    last = max(int(p.name) for p in (tmp_path / "state").iterdir() if p.name.isdigit())
    assert last == 1 and spark.read.parquet(str(tmp_path / "state" / str(last))).agg({"n": "sum"}).first()[0] == 20
    counts = ingest.counts_by_window(ingest.read_stream(spark, str(tmp_path / "in"), rows.schema)).writeStream.outputMode("complete").format("memory").queryName("counts_w").trigger(availableNow=True).start()
    counts.awaitTermination()
    assert spark.sql("select sum(n) from counts_w").first()[0] == 20
    lines = spark.createDataFrame([(1, "f", 1, None, "a,b"), (2, "f", 2, None, '"')], "line_id long, file_name string, line_no int, received_at timestamp_ntz, line string")
    lines.write.parquet(str(tmp_path / "lines"))
    parsed = ingest.parsed_lines(ingest.read_stream(spark, str(tmp_path / "lines"), lines.schema)).writeStream.format("memory").queryName("parsed_w").trigger(availableNow=True).start()
    parsed.awaitTermination()
    assert {tuple(r) for r in spark.sql("select line_id, reason from parsed_w").collect()} == {(1, "column_count"), (2, "quoting")}
