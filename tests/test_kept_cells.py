"""Streamed cells are those of the whole table: cohorts once, "not recorded" codes as one absent kind."""

from helpers import cohort, cohorts

from understory.operators import features
from understory.streaming import ingest


def test_streamed_cells_are_the_cells_of_all_rows(spark, tmp_path):
    kinds = ["AAAA", "BBBB", "N/A", " ", None, "odd"]
    first = [cohort(i, species_symbol_map=kinds[i % 6], crew_id=1) for i in range(12)]  # one crew: the code isn't known yet
    later = [cohort(i, species_symbol_map=kinds[i % 6], crew_id=2) for i in range(8, 30)] + [cohort(25, species_symbol_map="BBBB", crew_id=2), cohort(None), cohort(None)]
    later = [first[r[0]] if r[0] is not None and 8 <= r[0] < 12 else r for r in later]  # delivered again with the same values
    types = ["AAAA", "BBBB"]
    for k, rows in enumerate((first, later)):
        cohorts(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = ingest.read_stream(spark, str(tmp_path / "in"), cohorts(spark, rows).schema, files_per_batch=1)
        ingest.keep_cells(src, types, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
        key = lambda d: sorted(map(repr, (tuple(r[c] for c in ("entity", "type_ix", "kind", "n", "total", "latest")) for r in d.collect())))
        whole = features.cells(features.cohort_events(spark.read.parquet(str(tmp_path / "in"))), types)
        kept = ingest.kept_cells(spark, types, str(tmp_path / "state"), k)
        assert key(kept) == key(whole)
        assert (kept.filter("kind = 'N/A'").count() > 0) == (k == 0)  # a code once a second crew uses it
    assert kept.agg({"n": "sum"}).first()[0] == 32
