"""Results that two engines add up in different orders, rounded to what doesn't depend on it; in both languages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Readings have few decimals, so exact sums often end in the digit 5 where they are rounded; the order in which doubles
#: are added would then decide. Halves are lifted by far more than that error.
LIFT = 1.00000000003
#: Numbers from here on keep nine significant digits instead of a number of decimals.
LARGE = 100_000


def significant(column: str):
    """Nine significant digits, halves up."""
    return F.format_string("%.8e", F.col(column) * LIFT).try_cast("double")


def significant_sql(text: str) -> str:
    return f"CAST(printf('%.8e', CAST({text} AS DOUBLE) * {LIFT}) AS DOUBLE)"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.when(F.abs(F.col(c)) >= LARGE, significant(c)).otherwise(F.round(c, digits)))
    return df


def rounded_sql(text: str) -> str:
    """SQL in which every ``round(x, digits)`` does what ``rounded`` does."""
    out, at = "", 0
    for m in re.finditer(r"\bround\(", text):
        if m.start() < at:
            continue
        depth, comma, end = 1, 0, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            comma = end if depth == 1 and text[end] == "," else comma
            end += 1
        x, digits = text[m.end() : comma], text[comma + 1 : end - 1]
        out += text[at : m.start()] + f"CASE WHEN abs({x}) >= {LARGE} THEN {significant_sql(x)} ELSE round({x}, {digits}) END"
        at = end
    return out + text[at:]
