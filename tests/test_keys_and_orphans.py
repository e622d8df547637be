import datetime

from helpers import cohort, cohorts, with_clashes

from understory.operators import chunks, orphans
from understory.operators.absent import recurring_codes


def test_numbering_is_exact_and_dense(spark, monkeypatch):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 7)) as k", "id", "5000 - id as o").repartition(5)
    rows = chunks.cut(rows)
    for order, limit in ((None, chunks.BROADCAST_OFFSETS), (["o"], chunks.BROADCAST_OFFSETS), (None, 0)):
        monkeypatch.setattr(chunks, "BROADCAST_OFFSETS", limit)
        got = chunks.number_rows(rows, ["k"], order).toPandas()
        for _, g in got.groupby("k"):
            assert sorted(g.key_no) == list(range(len(g)))
            if order:
                assert g.sort_values("o").key_no.is_monotonic_increasing


def test_null_keys_are_a_key(spark):
    rows = chunks.cut(spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, id int"))
    got = {(r.k, r.key_no) for r in chunks.number_rows(rows, ["k"]).collect()}
    assert got == {(None, 0), (None, 1), ("a", 0)}


def test_turns_across_chunks(spark):
    rows = [cohort(i, crew_id=i // 3, agb=float(i), loaded_at=datetime.datetime(2010, 1, 1) + datetime.timedelta(hours=i)) for i in range(40)]
    small = chunks.per_key_results(cohorts(spark, rows), ["loaded_at", "cohort_id"], chunk_rows=4).filter("field = 'eco'").first()
    assert (small.n_rows, small.turns, small.total, small.lowest, small.highest, small.chunks) == (40, 13, 780.0, 0.0, 39.0, 10)


def test_turns_across_partitions(spark):
    """Without an order the rows follow each other partition by partition."""
    rows = [cohort(i, crew_id=None if i // 3 == 2 else i // 3, agb=float(i)) for i in range(40)]
    kept = chunks.cut(cohorts(spark, rows).repartitionByRange(7, "cohort_id").sortWithinPartitions("cohort_id"))
    for size in (3, 4, 1000):
        r = chunks.per_key_results(kept, chunk_rows=size).filter("field = 'eco'").first()
        assert (r.n_rows, r.turns, r.chunks) == (40, 13, -(-40 // size))


def test_heavy_keys(spark):
    rows = [cohort(i, eco="e1" if i < 95 else f"r{i}", species_symbol_map=None if i % 2 else "") for i in range(100)]
    got = {tuple(r) for r in chunks.heavy_keys(with_clashes(cohorts(spark, rows))).collect()}
    assert got == {("eco", "e1")}
    # repeated rows count, null and blank values are no keys, ties at the threshold count
    assert {tuple(r) for r in chunks.heavy_keys(cohorts(spark, rows[:95] + rows[95:96] * 5)).collect()} == {("eco", "e1"), ("eco", "r95")}


def test_empty_table(spark):
    assert chunks.heavy_keys(cohorts(spark, [])).count() == 0


def test_codes_recur_across_crews(spark):
    rows = [cohort(i, eco="unknown", age_calc=-1) for i in range(4)] + [cohort(9, eco="n/a", age_calc=999, crew_id=1)]
    assert recurring_codes(cohorts(spark, rows), {"eco": "text", "age_calc": "age"}) == {"eco": ["unknown"], "age_calc": ["-1"]}


DAY = datetime.date


def lists(spark):
    species = spark.createDataFrame([("AAAA", DAY(2000, 1, 1), None), ("BBBB", DAY(2000, 1, 1), DAY(2010, 6, 1)), ("CCCC", DAY(2012, 1, 1), None), ("DDDD", None, None)], "species_symbol_map string, listed_on date, delisted_on date")
    ecos = spark.createDataFrame([("e1", 7, DAY(2000, 1, 1), None)], "eco string, ecocode long, listed_on date, delisted_on date")
    return orphans.all_existence(species, ecos)


def communities(spark, rows):
    return spark.createDataFrame(rows, "record_id long, year int, mapcode long, ecocode long, species_symbol string, age int, biomass double, written_at timestamp_ntz")


def test_orphans(spark):
    names = {1: "AAAA", 2: "BBBB", 3: "CCCC", 4: "DDDD", 5: "aaaa", 6: None, 7: "AAAA "}
    rows = [cohort(i, species_symbol_map=s) for i, s in names.items()] + [cohort(2, species_symbol_map="BBBB", loaded_at=datetime.datetime(2009, 1, 1)), cohort(8, species_symbol_map="ZZZZ", loaded_at=None)]
    com = communities(spark, [(1, 0, 1, 7, "AAAA", 1, 1.0, datetime.datetime(2020, 1, 1)), (2, 0, 1, 8, None, 1, 1.0, datetime.datetime(2020, 1, 1)), (2, 0, 1, 8, None, 1, 1.0, datetime.datetime(2020, 1, 1))])
    refs = orphans.all_references(with_clashes(cohorts(spark, rows)), with_clashes(com))
    got = {tuple(r) for r in orphans.orphan_rows(refs, lists(spark)).collect()}
    assert got == {("data_eco_cohorts", "species_symbol_map", i) for i in (2, 3, 4, 5, 7, 8)} | {("output_communities", "ecocode", 2)}
    report = {(r.table_name, r.period): (r.orphan_keys, r.orphan_rows) for r in orphans.orphan_report(refs, lists(spark)).collect()}
    assert report[("data_eco_cohorts", "2010-06")] == (5, 5)  # BBBB is delisted on that very day
    assert report[("output_communities", "2020-01")] == (1, 2) and report[("data_eco_cohorts", "9999-12")] == (1, 1)


def test_orphans_of_empty_tables(spark):
    refs = orphans.all_references(cohorts(spark, []), communities(spark, []))
    assert orphans.orphan_rows(refs, lists(spark)).count() == 0


def test_either_join_finds_the_same_rows(spark, monkeypatch):
    rows = [cohort(i, species_symbol_map=["AAAA", "BBBB", "ZZZZ"][i % 3]) for i in range(30)]
    refs = orphans.all_references(cohorts(spark, rows), communities(spark, []))
    one = {tuple(r) for r in orphans.orphan_rows(refs, lists(spark)).collect()}
    monkeypatch.setattr(orphans, "BROADCAST_DAYS", 0)
    assert one == {tuple(r) for r in orphans.orphan_rows(refs, lists(spark)).collect()} and len(one) == 20


def test_kept_counts_equal_the_whole(spark, tmp_path):
    """Deliveries in any order, late list entries and retracted rows give what a full run gives."""
    rows = [cohort(i, species_symbol_map=["AAAA", "BBBB", "CCCC", "ZZZZ", None][i % 5], loaded_at=datetime.datetime(2008 + i % 6, 1 + i % 12, 3)) for i in range(60)]
    refs = orphans.all_references(cohorts(spark, rows), communities(spark, [(1, 0, 1, 8, None, 1, 1.0, None)]))
    existence = lists(spark)
    kept = orphans.KeptCounts(spark, str(tmp_path / "kept"))
    assert kept.orphan_days().count() == 0
    kept.apply(orphans.deltas(refs.filter("row_id % 2 = 1"), existence.filter("ref = 'CCCC'")))
    kept.apply(orphans.deltas(refs.filter("row_id % 2 = 0"), existence.limit(0)))
    before = {p.name for p in (tmp_path / "kept" / "counts" / "version=2").iterdir() if p.name.startswith("bucket")}
    kept.apply(orphans.deltas(refs.limit(0), existence.filter("ref != 'CCCC'")))  # the lists come last
    touched = {p.name for p in (tmp_path / "kept" / "counts" / "version=3").iterdir() if p.name.startswith("bucket")}
    key = lambda df: sorted(map(tuple, df.select("table_name", "field", "ref", "day", "n_refs").collect()))
    assert key(kept.orphan_days()) == key(orphans.orphan_days(refs, existence)) != []
    assert touched and not before <= touched  # buckets without a delta stay as they are
    gone = refs.filter("ref = 'ZZZZ'")
    kept.apply(orphans.deltas(gone, existence.limit(0)).selectExpr("table_name", "field", "ref", "day", "-n_refs as n_refs", "exists"))
    assert key(kept.orphan_days()) == key(orphans.orphan_days(refs.filter("ref != 'ZZZZ'"), existence))


def test_many_orphan_days_are_not_broadcast(spark, monkeypatch):
    refs = orphans.references(communities(spark, [(i, 0, 1, 7, f"S{i}", 5, 1.0, datetime.datetime(2020, 1, 1)) for i in range(50)]), "output_communities", "record_id", "written_at", {"species_symbol": ("species_symbol", "species")})
    monkeypatch.setattr(orphans, "BROADCAST_DAYS", 10)
    found = orphans.orphan_rows(refs, lists(spark))
    assert len(found.collect()) == 50
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
