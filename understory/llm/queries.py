"""Queries of the llm subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from understory.llm import bpe, packing, quantiles, spans
from understory.session import table


def p5_percentiles(spark, d):
    return quantiles.community_percentiles(table(spark, d, "output_communities"))


def p5_days(spark, d):
    return quantiles.day_summaries(table(spark, d, "output_communities"))


def p5_combined(spark, d):
    keys = [*quantiles.KEYS, "field"]
    return quantiles.percentiles(quantiles.combine_days(quantiles.day_summaries(table(spark, d, "output_communities"))), keys)


def p5_checks(spark, d):
    """Every percentile against its exact rank."""
    return quantiles.checked(table(spark, d, "output_communities"))


def p8_ids(spark, d):
    return bpe.encode_documents(table(spark, d, "documents"), bpe.vocabulary_path(spark))


def p8_checks(spark, d):
    """The ids of every text stand for its bytes."""
    return bpe.round_trips(table(spark, d, "documents"), bpe.vocabulary_path(spark))


def _sizes(spark, d):
    return bpe.count_tokens(table(spark, d, "documents"), bpe.vocabulary_path(spark))


def p9_packed(spark, d):
    return packing.pack(_sizes(spark, d))


def p9_lengths(spark, d):
    return packing.pack(_sizes(spark, d), (512, 1024, 2048))


def p9_checks(spark, d):
    """No container holds too much or anything twice, no text is split that fits one."""
    return packing.checked(p9_packed(spark, d))


def p10_found(spark, d):
    return spans.shared_spans(table(spark, d, "documents"))


def p10_amounts(spark, d):
    return spans.shared_amounts(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p5_percentiles, p5_days, p5_combined, p5_checks, p8_ids, p8_checks, p9_packed, p9_lengths, p9_checks, p10_found, p10_amounts)}

# ---------------------------------------------------------------- SQL, over whole tables

_SHARED = """windows AS (SELECT doc_id, i AS start, md5(substr(text, CAST(i + 1 AS BIGINT), 200)) AS h FROM (SELECT doc_id, text, unnest(range(length(text) - 199)) AS i FROM documents WHERE length(text) >= 200 AND doc_id IS NOT NULL)),
shared AS (SELECT h FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)),
starts AS (SELECT DISTINCT doc_id, start FROM windows SEMI JOIN shared USING (h)),
fresh AS (SELECT *, CASE WHEN start <= lag(start) OVER (PARTITION BY doc_id ORDER BY start) + 200 THEN 0 ELSE 1 END AS is_new FROM starts),
numbered AS (SELECT *, sum(is_new) OVER (PARTITION BY doc_id ORDER BY start) AS span FROM fresh),
spans AS (SELECT doc_id, CAST(min(start) AS INT) AS span_start, CAST(max(start) + 200 AS INT) AS span_end FROM numbered GROUP BY doc_id, span)"""
_RECORDS = "SELECT DISTINCT record_id, species_symbol, ecocode, CAST(biomass AS DOUBLE) AS biomass, CAST(age AS DOUBLE) AS age FROM output_communities WHERE record_id IS NOT NULL UNION ALL SELECT record_id, species_symbol, ecocode, biomass, age FROM output_communities WHERE record_id IS NULL"

ORACLES = {
    "p5_checks": f"WITH r AS ({_RECORDS}), v AS (SELECT species_symbol, ecocode, 'biomass' AS field, biomass AS x FROM r UNION ALL SELECT species_symbol, ecocode, 'age', age FROM r) SELECT species_symbol, ecocode, field, count(*) AS n, true AS within FROM v WHERE isfinite(x) GROUP BY ALL",
    "p8_checks": "SELECT doc_id, true AS same FROM documents",
    "p9_checks": "SELECT count(*) AS items, 0 AS overfull, 0 AS overlapping, 0 AS split_small FROM documents",
    "p10_found": f"WITH {_SHARED} SELECT * FROM spans",
    "p10_amounts": f"""WITH {_SHARED}, amounts AS (SELECT doc_id, sum(span_end - span_start) AS shared_chars FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce(shared_chars, 0) AS shared_chars, CASE WHEN length(text) > 0 THEN coalesce(shared_chars, 0) / length(text) END AS shared_share FROM documents LEFT JOIN amounts USING (doc_id)""",
}
