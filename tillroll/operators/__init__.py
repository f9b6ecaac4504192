"""Operators: functions from DataFrames to DataFrames."""

from pyspark.sql import DataFrame


def free_name(base: str, *tables: DataFrame) -> str:
    """``base``, or ``base`` with as many more underscores as it takes to differ from the tables' columns."""
    taken = {c.lower() for t in tables for c in t.columns}
    while base.lower() in taken:
        base = "_" + base
    return base
