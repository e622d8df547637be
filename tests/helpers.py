import datetime
import math

COHORT = (
    "cohort_id long, plt_cn long, statecd int, unitcd int, countycd int, plot int, eco string, measdate string, species_symbol string, species_symbol_map string, "
    "sftwd_hrdwd string, age_calc int, agb double, tree_count int, subp_has_dstrb string, crew_id int, loaded_at timestamp_ntz"
)
#: Columns that carry names the operators use inside.
CLASHING = ("n", "field", "key_value", "chunk", "key_no", "_pid", "_at", "visit", "total", "kind", "entity", "crew", "reason", "row_id", "ref", "day", "salt", "size", "pos", "core", "type_ix", "line_no")


def cohort(i, **k):
    at = i or 0
    base = dict(cohort_id=i, plt_cn=100 + at // 4, statecd=1, unitcd=1, countycd=1, plot=at // 8, eco="e1", measdate="2010-05-01", species_symbol="AAAA", species_symbol_map="AAAA", sftwd_hrdwd="H", age_calc=30, agb=5.0, tree_count=2, subp_has_dstrb="f", crew_id=at % 3, loaded_at=datetime.datetime(2010, 6, 1))
    return tuple((base | k).values())


def cohorts(spark, rows):
    return spark.createDataFrame(rows, COHORT)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit("x").alias(c) for c in CLASHING if c not in df.columns))


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    if isinstance(v, int | float) or type(v).__name__ == "Decimal":
        return repr(float(v))
    return str(v)


def as_rows(columns, data):
    ix = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(norm(r[i]) for i in ix) for r in data), key=str)
