"""Dates that are delivered in more than one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPELLINGS = r"^(\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{8})([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"


def parse_day(c: Column | str) -> Column:
    """yyyy-mm-dd, yyyy/mm/dd or yyyymmdd, with or without a time of day; null for anything else.

    The pieces are cast to a date, which costs far less than a date pattern.
    """
    col = F.btrim(F.col(c) if isinstance(c, str) else c)
    split = F.substring(col, 5, 1).isin("-", "/")
    day = F.concat(F.substring(col, 1, 4), F.lit("-"), F.when(split, F.substring(col, 6, 2)).otherwise(F.substring(col, 5, 2)), F.lit("-"), F.when(split, F.substring(col, 9, 2)).otherwise(F.substring(col, 7, 2)))
    return F.when(col.rlike(SPELLINGS), day.try_cast("date"))
