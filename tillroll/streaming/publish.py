"""Results that appear whole or not at all.

Each version of a result is a folder of its own, ``published_version=<number>``.  It counts
once a marker file is in it, which is written last; readers take the newest version
with a marker.  So a run that fails while it writes leaves the version before it
readable, a repeated run with the same number writes its folder anew, and one that
had finished already does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import exists, names, read_text, remove, write_text

MARKER, FOLDER, BASE = "_COMPLETE", "published_version", "base"
#: So many versions that build on each other are merged into a base.
COMPACT = 8


def folder_of(target: str, version: int) -> str:
    return f"{target}/{FOLDER}={version}"


def is_complete(spark: SparkSession, target: str, version: int) -> bool:
    return exists(spark, f"{folder_of(target, version)}/{MARKER}")


def complete_versions(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the versions that have been published, ascending."""
    found = [int(n.split("=")[1]) for n in names(spark, target) if n.startswith(f"{FOLDER}=")]
    return sorted(v for v in found if is_complete(spark, target, v))


def complete(spark: SparkSession, target: str, version: int, note: str = "") -> None:
    """From now on the version counts; ``note`` is kept in its marker."""
    write_text(spark, f"{folder_of(target, version)}/{MARKER}", note)


def note_of(spark: SparkSession, target: str, version: int) -> str:
    return read_text(spark, f"{folder_of(target, version)}/{MARKER}")


def live_versions(spark: SparkSession, target: str) -> list[int]:
    """The last version noted as ``base``, which holds all before it, and those after it; all where there is none."""
    versions = complete_versions(spark, target)
    bases = [v for v in versions if note_of(spark, target, v) == BASE]
    return [v for v in versions if not bases or v >= bases[-1]]


def read_versions(spark: SparkSession, target: str, versions: list[int]) -> DataFrame:
    """The rows of several versions together; each may have partition folders inside."""
    return spark.read.option("basePath", target).parquet(*(folder_of(target, v) for v in versions)).drop(FOLDER)


def publish(df: DataFrame, target: str, version: int, keep: int = 2) -> None:
    """Make ``df`` the result; of earlier versions ``keep - 1`` stay for readers that have begun."""
    spark = df.sparkSession
    if is_complete(spark, target, version):
        return
    df.write.mode("overwrite").parquet(folder_of(target, version))
    complete(spark, target, version)
    for old in complete_versions(spark, target)[:-keep]:
        remove(spark, folder_of(target, old))


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The newest result that was published."""
    versions = complete_versions(spark, target)
    if not versions:
        raise FileNotFoundError(f"nothing has been published in {target}")
    return spark.read.parquet(folder_of(target, versions[-1]))
