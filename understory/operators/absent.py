"""Which values of a field stand for "not recorded".

A value is absent if it is null, blank, or a spelling of "not recorded" that recurs as such: it is used
by at least two crews and by at least ``MIN_SHARE`` of all rows. Malformed or unlisted symbols and single
wrong readings are not absent. Which spellings can be one is a parameter: words, and codes of zeros only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from understory.session import bounded_rows

#: Spellings that can stand for "not recorded" in a text field, lower case, without outer white space.
TEXT_CODES = (
    "na", "n/a", "n.a.", "n.a", "nan", "nil", "none", "null", "unknown", "unkn", "unk", "undefined", "undef",
    "missing", "not recorded", "notrecorded", "not available", "no data", "nodata", "blank", "empty", "tbd",
    "?", "??", "???", "-", "--", "---", ".", "..", "...", "_", "*", "#n/a", "x", "xx", "xxx", "xxxx",
    "-1", "-9", "-99", "-999", "-9999", "999", "9999", "99999",
)
#: Zeros in at most six groups, as codes are written that have no other digit.
ZEROS = r"^0{1,4}([./_-]0{1,4}){0,5}$"
#: Readings of an age that can stand for "not recorded".
AGE_CODES = (0, -1, -9, -99, -999, -9999, 999, 9999, 99999)
MIN_SHARE, MAX_SPELLINGS = 2e-4, 50_000
WHITE = " \t\r\n\x0b\x0c "


def _norm(c: Column) -> Column:
    return F.lower(F.btrim(c.cast("string"), F.lit(WHITE)))


def _spelling(field: str, words: tuple) -> Column:
    x = _norm(F.col(field))
    return F.when(x.isin(*map(str, words)) | x.rlike(ZEROS), x)


def tally(df: DataFrame, fields: dict[str, str], source: str = "crew_id", words: dict[str, tuple] | None = None) -> DataFrame:
    """(field, code, n, lo, hi): rows and lowest and highest source per spelling; merges by sum, min and max."""
    of = {"text": TEXT_CODES, "age": AGE_CODES} | (words or {})
    as_array = [F.struct(F.lit(f).alias("field"), _spelling(f, of[kind]).alias("code")) for f, kind in fields.items()]
    return (
        df.select(F.col(source).alias("_src"), F.explode(F.array(*as_array)).alias("e"))
        .groupBy("e.field", "e.code")
        .agg(F.count("*").alias("n"), F.min("_src").alias("lo"), F.max("_src").alias("hi"))
    )


def codes_of(seen: list, fields: dict[str, str]) -> dict[str, list]:
    """The codes in use by the rows of a tally."""
    total = {f: sum(r["n"] for r in seen if r["field"] == f) for f in fields}
    found: dict[str, list] = {f: [] for f in fields}
    for r in seen:
        if r["code"] is not None and r["lo"] is not None and r["lo"] != r["hi"] and r["n"] >= MIN_SHARE * total[r["field"]]:
            found[r["field"]].append(r["code"])
    return {f: sorted(v) for f, v in found.items()}


def recurring_codes(df: DataFrame, fields: dict[str, str], source: str = "crew_id", words: dict[str, tuple] | None = None) -> dict[str, list]:
    """The codes in use per field. ``fields`` maps a column to ``text`` or ``age``; ``words`` replaces the spellings of either.

    One scan, partial aggregation, and no more result rows than there are spellings.
    """
    return codes_of(bounded_rows(tally(df, fields, source, words), MAX_SPELLINGS, "the list of spellings"), fields)


def is_absent(column: str | Column, codes: list) -> Column:
    """True for null, blank and the given codes; never null."""
    c = F.col(column) if isinstance(column, str) else column
    return c.isNull() | _norm(c).isin("", *codes)
