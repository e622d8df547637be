"""Queries over the data-quality operators of the core: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from understory.operators import chunks, features, impute, lines, orphans, spikes
from understory.plans.rounding import significant, significant_sql
from understory.session import scratch, table


def p1_features(spark, d):
    return features.feature_table(table(spark, d, "data_eco_cohorts"), table(spark, d, "data_all_species"))


def p1_cells(spark, d):
    cells = features.feature_cells(table(spark, d, "data_eco_cohorts"), table(spark, d, "data_all_species"))
    return cells.withColumn("total", significant("total"))


def p2_found(spark, d):
    return chunks.heavy_keys(table(spark, d, "data_eco_cohorts"))


def p2_results(spark, d):
    r = chunks.per_key_results(table(spark, d, "data_eco_cohorts"), order=["loaded_at", "cohort_id"])
    return r.withColumn("total", significant("total")).drop("chunks")


def _filled(spark, d):
    return impute.fill(*(table(spark, d, t) for t in ("data_eco_cohorts", "eco_ecocode_map", "data_all_species", "data_species_eco_map")))


def p3_found(spark, d):
    return impute.absent_fields(_filled(spark, d))


def p3_filled(spark, d):
    return _filled(spark, d)


def p3_checks(spark, d):
    """Per field: cohorts, absent and filled values, observed values that came out unchanged, and filled values that are listed or possible."""
    filled = _filled(spark, d)
    once = table(spark, d, "data_eco_cohorts").select("cohort_id", *(F.col(f).alias(f"was_{f}") for f in impute.FILLED)).dropDuplicates(["cohort_id"])
    ecos, species = table(spark, d, "eco_ecocode_map"), table(spark, d, "data_all_species")
    x = filled.join(once, "cohort_id")
    x = x.join(ecos.select(F.col("eco"), F.lit(True).alias("ok_eco")), "eco", "left").join(species.select("species_symbol_map", F.lit(True).alias("ok_species_symbol_map")).distinct(), "species_symbol_map", "left")
    x = x.withColumn("ok_age_calc", F.col("age_calc").between(1, 1500))
    per = [F.struct(F.lit(f).alias("field"), F.col(f"{f}_absent").alias("gone"), F.col(f"{f}_filled").alias("filled"), F.col(f).eqNullSafe(F.col(f"was_{f}")).alias("same"), F.coalesce(f"ok_{f}", F.lit(False)).alias("ok")) for f in impute.FILLED]
    e = x.select(F.explode(F.array(*per)).alias("e")).select("e.*")
    n = lambda c: F.count(F.when(c, 1))
    return e.groupBy("field").agg(F.count("*").alias("cohorts"), n(F.col("gone")).alias("absent"), n(F.col("filled")).alias("filled"), n(~F.col("gone") & F.col("same")).alias("kept"), n(F.col("filled") & F.col("ok")).alias("valid"))


def p4_found(spark, d):
    return spikes.flag_readings(table(spark, d, "data_eco_cohorts")).select("cohort_id", "field")


def p4_flags(spark, d):
    return spikes.flag_readings(table(spark, d, "data_eco_cohorts"))


def p4_kinds(spark, d):
    """What the model takes every flagged reading for."""
    return spikes.flag_readings(table(spark, d, "data_eco_cohorts")).select("cohort_id", "crew_id", "field", "reading", "kind")


def p6_found(spark, d):
    return lines.rejected(table(spark, d, "cohort_lines"))


def p6_loaded(spark, d):
    return lines.loaded(table(spark, d, "cohort_lines"))


def _orphans(spark, d):
    refs = orphans.all_references(table(spark, d, "data_eco_cohorts"), table(spark, d, "output_communities"))
    return refs, orphans.all_existence(table(spark, d, "data_all_species"), table(spark, d, "eco_ecocode_map"))


def p7_found(spark, d):
    return orphans.orphan_rows(*_orphans(spark, d))


def p7_report(spark, d):
    return orphans.orphan_report(*_orphans(spark, d))


def p7_kept(spark, d):
    """The report from kept counts: the lists and the rows of the first half of all days, then the later rows, then the
    first half's delistings, which arrive last."""
    refs, existence = _orphans(spark, d)
    days = refs.filter(F.col("day") < F.lit(orphans.NO_DAY).cast("date")).agg(F.min("day"), F.max("day")).first()
    mid = days[0] + (days[1] - days[0]) / 2 if days[0] else None
    early = F.coalesce(F.col("day") < F.lit(mid).cast("date"), F.lit(False))
    kept = orphans.KeptCounts(spark, scratch(spark))
    kept.apply(orphans.deltas(refs.filter(early), existence.filter("exists > 0")))
    kept.apply(orphans.deltas(refs.filter(~early), existence.filter((F.col("exists") < 0) & ~early)))
    kept.apply(orphans.deltas(refs.limit(0), existence.filter((F.col("exists") < 0) & early)))
    return orphans.report(kept.orphan_days())


QUERIES = {f.__name__: f for f in (p1_features, p1_cells, p2_found, p2_results, p3_found, p3_filled, p3_checks, p4_found, p4_flags, p4_kinds, p6_found, p6_loaded, p7_found, p7_report, p7_kept)}

# ---------------------------------------------------------------- the same in SQL, over whole tables

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
# what "not recorded" can look like, stated apart from the operators
_TEXT = "'na', 'n/a', 'nan', 'none', 'null', 'unknown', 'unkn', 'unk', 'missing', 'not recorded', '?', '-', '.', '0', '0.0.0.0', '999', '-999', '9999', '-9999'"
_AGE = "'0', '-1', '-9', '-99', '-999', '999', '9999', '-9999'"


def _norm(c: str) -> str:
    return f"lower(trim(CAST({c} AS VARCHAR), {_WHITE}))"


def _codes(field: str, listed: str) -> str:
    return f"""SELECT {_norm(field)} AS code FROM data_eco_cohorts WHERE {_norm(field)} IN ({listed}) GROUP BY 1
  HAVING min(crew_id) < max(crew_id) AND count(*) >= 0.0002 * (SELECT count(*) FROM data_eco_cohorts)"""


def _absent(field: str) -> str:
    return f"({field} IS NULL OR {_norm(field)} = '' OR {_norm(field)} IN (SELECT code FROM codes_{field}))"


_CODES = ",\n".join(f"codes_{f} AS ({_codes(f, x)})" for f, x in (("species_symbol_map", _TEXT), ("eco", _TEXT), ("age_calc", _AGE)))
_DAY = r"""CASE WHEN regexp_full_match(trim(measdate), '(\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{8})([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?')
  THEN CAST(try_strptime(substr(regexp_replace(substr(trim(measdate), 1, 10), '[-/]', '', 'g'), 1, 8), '%Y%m%d') AS DATE) END"""
_FINITE = "CASE WHEN NOT isnan(agb) AND abs(agb) < CAST('infinity' AS DOUBLE) THEN agb END"
_KEYED = f"""keyed AS (SELECT 'eco' AS field, eco AS key_value, agb, crew_id, loaded_at, cohort_id FROM data_eco_cohorts WHERE NOT {_absent("eco")}
  UNION ALL SELECT 'species_symbol_map', species_symbol_map, agb, crew_id, loaded_at, cohort_id FROM data_eco_cohorts WHERE NOT {_absent("species_symbol_map")})"""
_ONCE = "SELECT DISTINCT cohort_id, crew_id, plt_cn, eco, species_symbol_map, measdate, age_calc, agb FROM data_eco_cohorts"


def _flags(field: str, reading: str, possible: str) -> str:
    """Flags of one field: impossible, far from the crew's median on a log scale, or in a run of equal readings."""
    f = field
    return f"""r_{f} AS (SELECT cohort_id, crew_id, x, {possible} AS ok, round(log2(CASE WHEN {possible} AND x > 0 THEN x END) * 256) AS bin FROM ({reading}) t),
m_{f} AS (SELECT *, quantile_cont(bin, 0.5) OVER (PARTITION BY crew_id) AS mid FROM r_{f}),
d_{f} AS (SELECT *, quantile_cont(abs(bin - mid), 0.5) OVER (PARTITION BY crew_id) AS mad FROM m_{f}),
n_{f} AS (SELECT *, CASE WHEN x IS NOT DISTINCT FROM lag(x) OVER (PARTITION BY crew_id ORDER BY cohort_id) THEN 0 ELSE 1 END AS fresh FROM d_{f}),
g_{f} AS (SELECT *, sum(fresh) OVER (PARTITION BY crew_id ORDER BY cohort_id) AS run FROM n_{f}),
l_{f} AS (SELECT *, count(*) OVER (PARTITION BY crew_id, run) AS length FROM g_{f}),
f_{f} AS (SELECT cohort_id, CAST(crew_id AS BIGINT) AS crew_id, '{f}' AS field, x AS reading, CASE WHEN NOT ok THEN 'out_of_range'
    WHEN x = 0 OR abs(log2(CASE WHEN ok AND x > 0 THEN x END) - mid / 256) > 5 * greatest(1.4826 * mad, 1) / 256 THEN 'spike' WHEN length >= 6 THEN 'stuck' END AS kind FROM l_{f})"""


_ODD = f"""WITH {_CODES}, once AS ({_ONCE}),
{_flags("age_calc", f"SELECT cohort_id, crew_id, CAST(age_calc AS DOUBLE) AS x FROM once WHERE NOT {_absent('age_calc')}", "(x >= 1 AND x <= 1500)")},
{_flags("agb", "SELECT cohort_id, crew_id, agb AS x FROM once WHERE agb IS NOT NULL", "(x >= 0 AND x < CAST('infinity' AS DOUBLE) AND NOT isnan(x))")},
odd AS (SELECT * FROM f_age_calc WHERE kind IS NOT NULL UNION ALL SELECT * FROM f_agb WHERE kind IS NOT NULL)"""

_F = r"""(?:[^",]*|"(?:[^"]|"")*")"""
_LINE = rf"^({_F}),{_F},{_F},{_F},{_F},{_F},({_F}),{_F},{_F},{_F},{_F},({_F}),{_F},{_F},{_F}$"


_WHOLE_LINE = ",".join([f"({_F})"] * len(lines.FIELDS))
_TYPED = {"plt_cn": "CAST(plt_cn AS BIGINT) AS plt_cn", "measdate": "CAST(measdate AS DATE) AS measdate", "agb": "CASE WHEN agb <> '' THEN CAST(agb AS DOUBLE) END AS agb"}


def _field(i: int) -> str:
    v = f"regexp_extract(line, '{_LINE}', {i})"
    return f"CASE WHEN {v} LIKE '\"%' THEN replace(substr({v}, 2, length({v}) - 2), '\"\"', '\"') ELSE {v} END"


_ORPHANS = f"""refs AS (SELECT 'data_eco_cohorts' AS table_name, 'species_symbol_map' AS field, cohort_id AS row_id, species_symbol_map AS ref, CAST(loaded_at AS DATE) AS day FROM data_eco_cohorts WHERE NOT {_absent("species_symbol_map")}
  UNION ALL SELECT 'output_communities', 'species_symbol', record_id, species_symbol, CAST(written_at AS DATE) FROM output_communities WHERE species_symbol IS NOT NULL
  UNION ALL SELECT 'output_communities', 'ecocode', record_id, CAST(ecocode AS VARCHAR), CAST(written_at AS DATE) FROM output_communities WHERE ecocode IS NOT NULL),
listed AS (SELECT 's' AS list, species_symbol_map AS ref, listed_on, delisted_on FROM data_all_species UNION ALL SELECT 'e', CAST(ecocode AS VARCHAR), listed_on, delisted_on FROM eco_ecocode_map),
orphans AS (SELECT * FROM refs r WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE l.ref = r.ref AND l.list = CASE WHEN r.field = 'ecocode' THEN 'e' ELSE 's' END
  AND l.listed_on <= coalesce(r.day, DATE '9999-12-31') AND (l.delisted_on IS NULL OR coalesce(r.day, DATE '9999-12-31') < l.delisted_on)))"""

_REPORT = f"WITH {_CODES}, {_ORPHANS} SELECT table_name, field, strftime(coalesce(day, DATE '9999-12-31'), '%Y-%m') AS period, count(DISTINCT ref) AS orphan_keys, count(*) AS orphan_rows FROM orphans GROUP BY ALL"

ORACLES = {
    "p1_cells": f"""WITH {_CODES}, once AS ({_ONCE}), e AS (SELECT plt_cn, CASE WHEN NOT {_absent("species_symbol_map")} THEN species_symbol_map END AS species_symbol_map, {_FINITE} AS t, {_DAY} AS day FROM once)
SELECT plt_cn, species_symbol_map, count(*) AS n, {significant_sql('coalesce(sum(t), 0)')} AS total, date_diff('day', max(day), (SELECT max(CAST(loaded_at AS DATE)) FROM data_eco_cohorts)) AS days FROM e GROUP BY ALL""",
    "p2_found": f"WITH {_CODES}, {_KEYED} SELECT field, key_value FROM keyed GROUP BY ALL HAVING count(*) >= 0.05 * (SELECT count(*) FROM data_eco_cohorts)",
    "p2_results": f"""WITH {_CODES}, {_KEYED}, o AS (SELECT *, {_FINITE} AS x, lag(crew_id) OVER w AS before, row_number() OVER w AS no FROM keyed WINDOW w AS (PARTITION BY field, key_value ORDER BY loaded_at, cohort_id))
SELECT field, key_value, count(*) AS n_rows, count(x) AS n_values, {significant_sql('sum(x)')} AS total, min(x) AS lowest, max(x) AS highest, count(*) FILTER (no > 1 AND before IS DISTINCT FROM crew_id) AS turns FROM o GROUP BY ALL""",
    "p3_found": f"WITH {_CODES} " + " UNION ALL ".join(f"SELECT DISTINCT cohort_id, '{f}' AS field FROM data_eco_cohorts WHERE {_absent(f)}" for f in ("age_calc", "eco", "species_symbol_map")),
    "p3_checks": f"WITH {_CODES}, once AS (SELECT cohort_id, " + ", ".join(f"any_value({_absent(f)}) AS gone_{f}" for f in impute.FILLED) + " FROM data_eco_cohorts WHERE cohort_id IS NOT NULL GROUP BY cohort_id) "
    + " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS cohorts, count(*) FILTER (gone_{f}) AS absent, count(*) FILTER (gone_{f}) AS filled, count(*) FILTER (NOT gone_{f}) AS kept, count(*) FILTER (gone_{f}) AS valid FROM once" for f in impute.FILLED),
    "p4_found": f"{_ODD} SELECT cohort_id, field FROM odd",
    "p4_kinds": f"{_ODD} SELECT * FROM odd",
    "p6_found": rf"""WITH a AS (SELECT line_id, line, regexp_replace(line, '"(?:[^"]|"")*"', 'q', 'g') AS bare FROM cohort_lines),
b AS (SELECT *, CASE WHEN line IS NULL THEN 'column_count' WHEN NOT regexp_full_match(line, '{_F}(?:,{_F})*') THEN 'quoting' WHEN length(bare) - length(replace(bare, ',', '')) <> 14 THEN 'column_count' END AS reason FROM a),
c AS (SELECT *, {_field(1)} AS k, {_field(2)} AS m, {_field(3)} AS g FROM b)
SELECT DISTINCT line_id, coalesce(reason, 'invalid_value') AS reason FROM c WHERE reason IS NOT NULL OR NOT regexp_full_match(k, '[0-9]{{1,15}}')
  OR NOT regexp_full_match(m, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') OR try_strptime(m, '%Y-%m-%d') IS NULL OR NOT (g = '' OR (regexp_full_match(g, '([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') AND coalesce(TRY_CAST(g AS DOUBLE) < CAST('infinity' AS DOUBLE), false)))""",
    "p6_loaded": rf"""WITH s AS (SELECT line_id, regexp_extract(line, '^{_WHOLE_LINE}$', [{", ".join(f"'{f}'" for f in lines.FIELDS)}]) AS v FROM cohort_lines WHERE regexp_full_match(line, '{_WHOLE_LINE}')),
u AS (SELECT line_id, {", ".join(f"CASE WHEN v.{f} LIKE '" + chr(34) + f"%' THEN replace(substr(v.{f}, 2, length(v.{f}) - 2), repeat(chr(34), 2), chr(34)) ELSE v.{f} END AS {f}" for f in lines.FIELDS)} FROM s)
SELECT line_id, {", ".join(f"CASE WHEN regexp_full_match({f}, '[+-]?[0-9]{{1,10}}') THEN TRY_CAST({f} AS INT) END AS {f}" if f in lines.WHOLE else _TYPED.get(f, f) for f in lines.FIELDS)} FROM u
WHERE regexp_full_match(plt_cn, '[0-9]{{1,15}}') AND regexp_full_match(measdate, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_strptime(measdate, '%Y-%m-%d') IS NOT NULL
  AND (agb = '' OR (regexp_full_match(agb, '([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') AND coalesce(TRY_CAST(agb AS DOUBLE) < CAST('infinity' AS DOUBLE), false)))""",
    "p7_found": f"WITH {_CODES}, {_ORPHANS} SELECT DISTINCT table_name, field, row_id FROM orphans",
    "p7_report": _REPORT,
    "p7_kept": _REPORT,
}
