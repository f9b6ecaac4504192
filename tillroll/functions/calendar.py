"""Calendar keys and tolerant parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_half(ts: Column) -> Column:
    """``2024-H1`` for January to June, ``2024-H2`` for the rest."""
    return F.concat(F.year(ts).cast("string"), F.lit("-H"), F.when(F.month(ts) <= 6, "1").otherwise("2"))


def year_month(ts: Column) -> Column:
    """``2024-03``."""
    return F.concat(F.year(ts).cast("string"), F.lit("-"), F.lpad(F.month(ts).cast("string"), 2, "0"))


def month_start(ts: Column) -> Column:
    """The first instant of the month, without a time zone."""
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def parse_year_half(text: Column, strict: bool = False) -> Column:
    """struct(year, half) of a text like ``2024-H2``; else null, or an error if ``strict``."""
    fits = text.rlike("^[0-9]{1,4}-H[12]$")
    value = F.struct(F.split_part(text, F.lit("-"), F.lit(1)).cast("int").alias("year"), F.right(text, F.lit(1)).cast("int").alias("half"))
    return _checked(fits, value, text, "half-year", strict)


def parse_year_month(text: Column, strict: bool = False) -> Column:
    """struct(year, month) of a text like ``2024-11``; else null, or an error if ``strict``."""
    fits = text.rlike("^[0-9]{1,4}-(0?[1-9]|1[0-2])$")
    value = F.struct(F.split_part(text, F.lit("-"), F.lit(1)).cast("int").alias("year"), F.split_part(text, F.lit("-"), F.lit(2)).cast("int").alias("month"))
    return _checked(fits, value, text, "month", strict)


def _checked(fits: Column, value: Column, text: Column, what: str, strict: bool) -> Column:
    out = F.when(fits, value)
    if strict:
        out = F.when(text.isNull(), F.lit(None)).when(fits, value).otherwise(F.raise_error(F.concat(F.lit(f"not a {what}: "), text)))
    return out


#: A day, or a day and a time, with parts of a second and an offset if need be.
_ISO = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:[.][0-9]{1,9})?)?)?)(?:Z|[+-][0-9]{2}:?[0-9]{2})?$"


def parse_ts(text: Column) -> Column:
    """A timestamp without zone from ISO text (``T`` or a space before the time); null if it is none.

    A day alone is its first instant; of an offset nothing is kept but the clock
    time before it; parts of a second below a millionth are cut.
    """
    clock = F.regexp_extract(F.trim(text), _ISO, 1)
    return F.when(clock != "", clock).try_cast("timestamp_ntz")
