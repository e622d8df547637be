"""Whole runs from files to files, by the command line."""

import json
import sqlite3

import numpy as np
import pytest
from test_rasters import build, dbf

from understory import workflows as W
from understory.__main__ import main
from understory.operators import cohorts as C
from understory.plans import fixture as fx
from understory.sources import raster, sqlite


@pytest.fixture(scope="module")
def common(data):
    return ["--cohorts", f"{data}/data_eco_cohorts.parquet", "--ecos", f"{data}/eco_ecocode_map.parquet", "--species", f"{data}/data_all_species.parquet"]


def test_prepare(spark, data, tmp_path, common):
    found = main(["prepare", *common, "--output", str(tmp_path)], spark)
    out = spark.read.parquet(str(tmp_path / "splots"))
    want = fx.splots(spark, data)
    assert found == json.loads((tmp_path / "extents.json").read_text()) and found["first_year"] == 0
    assert out.count() == want.count() and dict(out.dtypes)["measdate"] == "string" and out.agg({"plot_id": "max"}).first()[0] == found["n_plots"]
    rows = [tuple(r) for r in C.in_listed_order(want).select(*C.LISTED).collect()]
    assert rows == sorted(rows)


def test_deliveries_from_sqlite_and_csv(spark, data, tmp_path):
    raw = spark.read.parquet(f"{data}/data_eco_cohorts.parquet")
    sqlite.write_sqlite(raw.select("cohort_id", "eco", "agb", "subp_has_dstrb"), str(tmp_path / "c.db"), "cohorts", batch=100)
    with sqlite3.connect(tmp_path / "c.db") as db:
        n, total = db.execute("select count(*), sum(agb) from cohorts where eco = '9.3.5.83a' and subp_has_dstrb = 'f'").fetchone()
    got = W.read_deliveries(spark, str(tmp_path / "c.db"), "cohorts", ["9.3.5.83a"], True)
    assert got.count() == n > 0 and np.isclose(got.agg({"agb": "sum"}).first()[0], total)
    assert sqlite.read_sqlite(spark, str(tmp_path / "c.db"), "cohorts", columns=["agb", "eco"]).columns == ["agb", "eco"]
    raw.limit(50).coalesce(1).write.option("header", True).option("escape", '"').csv(str(tmp_path / "c.csv"))
    assert W.read_deliveries(spark, str(tmp_path / "c.csv")).count() == 50


def test_calibrate_then_simulate_a_landscape(spark, data, tmp_path, common):
    out = str(tmp_path / "fit")
    best, state = main(["calibrate", *common, "--output", out, "--trials", "2", "--batch", "2"], spark)
    assert state.i == 3 and W.load_params(spark, f"{out}/best_params.json").to_dict() == best.to_dict() and spark.read.parquet(f"{out}/trials").count() == 2
    px = [r for r in fx.pixels(spark, data).orderBy("mapcode").limit(29).collect()]
    grid, ecos = np.zeros((5, 6), "int32"), np.zeros((5, 6), "int64")
    for i, r in enumerate(px):
        grid[i % 5, i // 5], ecos[i % 5, i // 5] = i + 1, r.ecocode
    plots = build(tmp_path / "plots.tif", grid, compression=8, nodata=0)
    dbf(tmp_path / "plots.tif.vat.dbf", [("Value", "N", 9, 0), ("PLT_CN", "N", 15, 0)], [(i + 1, r.plt_cn) for i, r in enumerate(px)])
    eco = build(tmp_path / "eco.tif", ecos.astype("int32"))
    found = main(["landscape", *common, "--species-map", f"{data}/data_species_eco_map.parquet", "--plot-raster", plots, "--eco-raster", eco, "--params", f"{out}/best_params.json", "--horizon", "2", "--output", str(tmp_path / "land")], spark)
    assert found["pixels"] == 29 and 0 < found["sites"] <= 29 and len(found["rasters"]) == 2
    records = spark.read.parquet(str(tmp_path / "land" / "records"))
    sums = {r[0]: r[1] for r in records.filter("year = 2").groupBy("mapcode").sum("biomass").collect()}
    back = {r.mapcode: r.value for r in raster.read_pixels(spark, found["rasters"][1]).collect()}
    assert back.keys() == sums.keys() and all(np.isclose(back[k], sums[k], rtol=1e-5) for k in sums)
    codes = {r.mapcode for r in raster.read_pixels(spark, str(tmp_path / "land" / "output_communities.tif")).collect()}
    assert set(sums) <= codes and len(codes) == found["sites"]
    again = main(["rasters", "--records", str(tmp_path / "land" / "records"), "--like", plots, "--output", str(tmp_path / "again")], spark)
    assert len(again) == 2


def test_samples_of_sites(spark):
    sites = spark.range(1000).withColumnRenamed("id", "site")
    got = {r.site for r in C.sample_sites(sites, 0.33, 7).collect()}
    assert len(got) == 330 and got == {r.site for r in C.sample_sites(sites.repartition(9), 0.33, 7).collect()} != {r.site for r in C.sample_sites(sites, 0.33, 8).collect()}
