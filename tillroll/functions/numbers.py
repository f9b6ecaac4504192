"""Numbers: tolerant parsing and the report's rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_whole(value: Column) -> Column:
    """A whole number from a double column or text (``12``, ``12.0``; ``12.7`` is cut to 12); else null.

    A direct cast to bigint would reject ``12.0``.
    """
    return value.try_cast("double").try_cast("bigint")


def parse_decimal_comma(text: Column) -> Column:
    """A double from text with a decimal comma or point; null if it is none."""
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def parse_flag(text: Column) -> Column:
    """True for ``true`` in any case, null for null, false for all else."""
    return F.lower(text) == "true"


def exact(amount: Column) -> Column:
    """Millionths as decimals, so that a sum doesn't depend on the order of its rows.

    What is not finite, or 10^22 and more, counts as null, which sums leave out.
    """
    return amount.try_cast("decimal(28,6)")


def cents(amount: Column) -> Column:
    """A decimal of two places; null where ``exact`` is."""
    return F.round(exact(amount), 2).try_cast("decimal(24,2)")


def custom_round(x: Column) -> Column:
    """Two decimals; but where the third decimal of ``x`` (to four) is 5, that value less 0.001."""
    text = F.format_string("%.4f", x)
    third = F.substring(F.substring_index(text, ".", -1), 3, 1)
    return F.when(third == "5", text.cast("double") - F.lit(0.001)).otherwise(F.round(x, 2))
