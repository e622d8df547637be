"""Explicit schemas of the tables; nothing is inferred from files."""

from pyspark.sql.types import DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType


def _of(**fields) -> StructType:
    return StructType([StructField(k, v()) for k, v in fields.items()])


COHORTS = _of(
    cohort_id=LongType, plt_cn=LongType, statecd=IntegerType, unitcd=IntegerType, countycd=IntegerType, plot=IntegerType, eco=StringType,
    measdate=StringType, species_symbol=StringType, species_symbol_map=StringType, sftwd_hrdwd=StringType, age_calc=IntegerType, agb=DoubleType,
    tree_count=IntegerType, subp_has_dstrb=StringType, crew_id=IntegerType, loaded_at=TimestampNTZType,
)
ECO_CODES = _of(eco=StringType, ecocode=LongType, listed_on=DateType, delisted_on=DateType)
SPECIES = _of(species_symbol_map=StringType, listed_on=DateType, delisted_on=DateType)
SPECIES_ECO = _of(eco=StringType, species_symbol=StringType, species_symbol_map=StringType)
#: One live cohort of a site in a simulated year.
SITE_RECORD = _of(year=IntegerType, mapcode=LongType, eco=StringType, species=StringType, age=IntegerType, biomass=DoubleType)
#: Parameters of a species in an ecoregion.
ECO_SPECIES_PARAMS = _of(
    eco=StringType, species=StringType, local_id=IntegerType, d=DoubleType, s=DoubleType, longevity=IntegerType, shade_tol=IntegerType, maturity=IntegerType,
    b_max=DoubleType, anpp_max=DoubleType, prob_mort=DoubleType, prob_estab=DoubleType,
)
#: Parameters of an ecoregion: its largest b_max and the shares of it that the shade classes 1 to 5 exceed.
ECO_PARAMS = _of(eco=StringType, b_max_eco=DoubleType, r1=DoubleType, r2=DoubleType, r3=DoubleType, r4=DoubleType, r5=DoubleType)
PLOT_KEY = ["statecd", "unitcd", "countycd", "plot"]
