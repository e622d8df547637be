"""A landscape from end to end: pixels, their communities, their years, records and rasters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from understory.operators import cohorts as C
from understory.operators.crosswalk import Crosswalk, effective_splots, landscape_params
from understory.operators.params import eco_params
from understory.operators.simulate import gathered, parameter_table, run, sites_of
from understory.operators.succession import Semantics
from understory.session import cut_table


class Landscape:
    """Pixels (mapcode, plt_cn, ecocode) with the communities of the measurements they carry.

    ``lists``: the tables of ecoregions, of mapped species and of all species. The crosswalk is resolved once;
    everything else is derived from its written result.
    """

    def __init__(self, pixels: DataFrame, cohorts: DataFrame, lists: tuple[DataFrame, DataFrame, DataFrame]) -> None:
        self.pixels, self.ecos = pixels, lists[0]
        self.splots = cut_table(C.with_biomass(effective_splots(Crosswalk(pixels, cohorts, *lists).final())))

    def params(self, eco_species: DataFrame, eco_shade: DataFrame) -> DataFrame:
        return eco_params(landscape_params(self.splots, eco_species), eco_shade)

    def sites(self, sem: Semantics = Semantics()) -> DataFrame:
        """A site per pixel that has a community. Communities are gathered per (measurement, ecoregion), of which there are
        far fewer than pixels, and pixels are dealt out evenly afterwards, however many share one community."""
        of_pair = self.splots.select(F.xxhash64("plt_cn", "raster_ecocode").alias("pair"), "plt_cn", "raster_ecocode", F.col("raster_eco").alias("eco"), "effective_species", "age_calc", "agb_sum")
        community = gathered(sites_of(of_pair, "pair", "eco", "effective_species", "age_calc", sem, bio="agb_sum"))
        named = of_pair.select("pair", "plt_cn", F.col("raster_ecocode").alias("ecocode")).distinct().join(community, F.col("pair") == F.col("site")).drop("site", "pair")
        return self.pixels.join(named, ["plt_cn", "ecocode"]).select(F.col("mapcode").cast("long").alias("site"), "eco", "cohorts").repartition("site")

    def simulate(self, eco_species: DataFrame, eco_shade: DataFrame, years: Sequence[int], seed: int, sem: Semantics = Semantics(), sites: DataFrame | None = None) -> DataFrame:
        """Records (year, mapcode, eco, species, seq, age, biomass) of every live cohort of every pixel and year."""
        return run(self.sites(sem) if sites is None else sites, [parameter_table(self.params(eco_species, eco_shade))], years, seed, sem).drop("candidate")
