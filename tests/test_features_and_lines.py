import datetime
import math

import pyarrow as pa
from helpers import cohort, cohorts, with_clashes
from hypothesis import given, settings
from hypothesis import strategies as st

from understory.operators import features, lines

SPECIES = [("AAAA", None, None), ("B.B", None, None), ("CCCC", None, None)]


def species(spark):
    return spark.createDataFrame(SPECIES, "species_symbol_map string, listed_on date, delisted_on date")


def test_feature_table(spark):
    rows = [
        cohort(1, plt_cn=5), cohort(1, plt_cn=5), cohort(2, plt_cn=5, agb=2.5, measdate="2010/05/11"), cohort(3, plt_cn=5, species_symbol_map="B.B", measdate="0000-00-00"),
        cohort(4, plt_cn=5, species_symbol_map="odd", agb=None), cohort(5, plt_cn=None, agb=math.nan, measdate="20100502"), cohort(6, plt_cn=6, species_symbol_map=None, agb=math.inf),
    ]
    got = {r.plt_cn: r for r in features.feature_table(with_clashes(cohorts(spark, rows)), species(spark)).collect()}
    assert set(got) == {5, 6, None}
    r = got[5]
    assert (r.n_AAAA, r.total_AAAA, r.days_AAAA) == (2, 7.5, 21)
    assert (r.n_B_B, r.total_B_B, r.days_B_B) == (1, 5.0, None) and (r.n_CCCC, r.total_CCCC, r.days_CCCC) == (0, 0.0, None)
    assert [tuple(x) for x in r.other] == [("odd", 1, 0.0, 31)]
    assert (got[None].n_AAAA, got[None].total_AAAA, got[None].days_AAAA) == (1, 0.0, 30)
    assert [tuple(x)[:3] for x in got[6].other] == [(None, 1, 0.0)]


def test_feature_table_of_nothing(spark):
    assert features.feature_table(cohorts(spark, []), species(spark)).count() == 0


def test_cells_merge_like_the_whole(spark):
    rows = [cohort(i, plt_cn=i % 3, agb=float(i), measdate=f"2010-05-{1 + i % 28:02d}") for i in range(60)]
    types = ["AAAA"]
    whole = features.cells(features.cohort_events(cohorts(spark, rows)), types)
    parts = [features.cells(features.cohort_events(cohorts(spark, rows[i::2])), types) for i in range(2)]
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(features.merge_cells(parts[0].unionByName(parts[1]))) == key(whole)
    names = ["entity", "type_ix", "kind", "n", "total", "latest"]
    again = cohorts(spark, rows + rows[:20] + [cohort(None), cohort(None)])
    assert key(features.cohort_cells(again, types).select(names)) == key(features.cells(features.cohort_events(again), types).select(names))


GOOD = '400000000001,1,1,1,1,e1,2010-05-01,AAAA,AAAA,H,30,5.5,2,f,"a, ""b"""'


def verdict(line):
    return lines.diagnose(line)[0]


def test_reasons():
    swap = lambda i, v: ",".join(v if k == i else x for k, x in enumerate(["400000000001", "1", "1", "1", "1", "e1", "2010-05-01", "A", "A", "H", "30", "5.5", "2", "f", ""]))
    assert verdict(GOOD) is None and verdict(swap(14, '"two\nlines"')) is None and verdict(swap(5, '""')) is None
    for bad in (swap(14, 'say "x"'), swap(5, '"e1'), swap(5, '"e1"x'), swap(5, ' "e1"'), '"', swap(14, '"a \\" b"')):
        assert verdict(bad) == "quoting"
    for bad in ("", None, "a;b", swap(0, "1") + ",", "total 7", '"' + GOOD.replace('"', '""') + '"'):
        assert verdict(bad) == "column_count"
    for i, v in ((0, ""), (0, "1" * 16), (0, " 1"), (0, "+1"), (0, "١"), (6, "2010-02-30"), (6, "2010-5-1"), (6, "0000-01-01"), (6, "2010-05-01 "), (11, "-1"), (11, "+1"), (11, "nan"), (11, "inf"), (11, "1e999"), (11, "1,5"), (11, "1e"), (11, " 1"), (11, "0x1")):
        if "," not in v:
            assert verdict(swap(i, v)) == "invalid_value", v
    for v in ("", "5", "5.", ".5", "1e3", "1.5E-03", '"2.5"', "0"):
        assert verdict(swap(11, v)) is None, v


def test_blocks_agree_with_the_strict_parser(spark, data):
    t = spark.read.parquet(f"{data}/cohort_lines.parquet")
    strict = {r.line_id: lines.diagnose(r.line) for r in t.collect()}
    got = {r.line_id: r for r in lines.parse(with_clashes(t)).collect()}
    assert {i: r.reason for i, r in got.items()} == {i: d[0] for i, d in strict.items()}
    for i, (reason, values) in strict.items():
        if reason is None:
            assert {f: got[i][f] for f in lines.FIELDS} == values


def test_lines_of_nothing_and_repeats(spark):
    schema = "line_id long, file_name string, line_no int, received_at timestamp_ntz, line string"
    empty = spark.createDataFrame([], schema)
    assert lines.rejected(empty).count() == 0 and lines.loaded(empty).count() == 0
    rows = spark.createDataFrame([(1, "f", 1, None, GOOD), (1, "f", 1, None, GOOD), (2, "f", 2, None, "x" * 200_000), (2, "f", 2, None, "x" * 200_000), (3, None, None, None, None)], schema)
    assert sorted(map(tuple, lines.rejected(rows).collect())) == [(2, "column_count"), (3, "column_count")]
    assert lines.loaded(rows).count() == 2 and lines.loaded(rows).first().measdate == datetime.date(2010, 5, 1)


PIECES = st.lists(st.sampled_from(['"', ",", "a", "1", "\n", "\r", '""', ",,", "400000000001,1,1,1,1,e1,2010-05-01,A,A,H,30,5.5,2,f,", GOOD]), max_size=24)


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECES.map("".join), min_size=1, max_size=40))
def test_any_block_agrees_with_the_strict_parser(block):
    tables = list(lines.parse_lines(pa.array(range(len(block)), pa.int64()), pa.array(block, pa.string())))
    got = {i: (r, k) for t in tables for i, r, k in zip(t["line_id"].to_pylist(), t["reason"].to_pylist(), t["agb"].to_pylist(), strict=True)}
    assert got == {i: ((d := lines.diagnose(x))[0], d[1].get("agb")) for i, x in enumerate(block)}
