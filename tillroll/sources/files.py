"""Readers and writers: CSV folders, Parquet tables, result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import parse_ts
from ..functions.numbers import parse_flag, parse_whole
from .schemas import NEEDED, TABLES, text_schema

_TYPED = {
    "str": lambda c: c,
    "whole": parse_whole,
    "real": lambda c: c.try_cast("double"),
    "flag": parse_flag,
    "day": lambda c: c.try_cast("date"),
    "time": parse_ts,
}


def _pattern(table: str) -> str:
    """A glob for files with the table's name in any case."""
    letters = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in table)
    return f"*{letters}*"


def typed(text: DataFrame, table: str, *others: str) -> DataFrame:
    """The table's columns with their types, and ``others`` as they are; what doesn't parse is null."""
    return text.select(*(_TYPED[kind](F.col(name)).alias(name) for name, kind in TABLES[table]), *others)


def table_of_file(name: Column) -> Column:
    """The rule of :func:`schemas.table_of` as a column: of the tables that a file's name holds, the one with the longest name."""
    out = F.lit(None).cast("string")
    for table in sorted(TABLES, key=lambda t: (len(t), t)):
        out = F.when(F.contains(F.lower(name), F.lit(table)), table).otherwise(out)
    return out


def _lines(reader, folder: str, table: str, corrupt: str | None = None) -> DataFrame:
    """The table's lines as text columns.  By position, whatever the header says; no quoting; an empty field is null."""
    schema = text_schema(table)
    if corrupt:
        schema = schema.add(corrupt, "string")
        reader = reader.option("columnNameOfCorruptRecord", corrupt).option("columnPruning", "false")
    options = {"header": "true", "enforceSchema": "true", "quote": "", "recursiveFileLookup": "true", "pathGlobFilter": _pattern(table), "mode": "PERMISSIVE", "nullValue": ""}
    # The pattern lets files through whose names hold another table's as well; their names decide, before they are read.
    return reader.schema(schema).options(**options).csv(folder).where(table_of_file(F.col("_metadata.file_name")) == table)


def read_csv_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """All files below ``folder`` whose name tells the table."""
    return typed(_lines(spark.read, folder, table), table)


def stream_csv_table(spark: SparkSession, folder: str, table: str, files: int | None = None, archive: str | None = None) -> DataFrame:
    """The same as a stream: at most ``files`` files in a batch; what has been read is moved to ``archive``."""
    reader = spark.readStream
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return typed(_lines(reader, folder, table), table)


def position() -> Column:
    """Where a row of a scan stands: folder, file, split, place in the split.

    Compares as the files' order does (folders by name, files by name, lines as
    they follow), also where files are split; to be used directly on a scan.
    """
    folder = F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/", 1)
    return F.struct(folder.alias("folder"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))


def read_csv_positions(spark: SparkSession, folder: str, table: str, name: str = "position") -> DataFrame:
    """:func:`read_csv_table` with :func:`position`, by which the last of several entries can be told."""
    lines = _lines(spark.read, folder, table)
    return typed(lines.withColumn(name, position()), table, name)


def with_line_numbers(rows: DataFrame, name: str = "position") -> DataFrame:
    """``rows`` with ``line`` long, from 1: the place in the file.

    Rows are numbered inside their split, which one task has read before, and the
    lines of a file's earlier splits are added: one short row for each split.
    """
    split = [F.col(f"{name}.{f}").alias(f"_{f}") for f in ("folder", "file", "split")]
    keys = ["_folder", "_file", "_split"]
    sizes = rows.select(*split).groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.partitionBy("_folder", "_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*keys, F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(f"{name}.row"))
    numbered = rows.select("*", *split).withColumn("_inside", inside).join(offsets, keys)
    return numbered.select(*rows.columns, (F.col("_before") + F.col("_inside")).alias("line"))


def split_csv_table(spark: SparkSession, folder: str, table: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose lines are sound, and the others: file, line (as it stands there), reasons (array of text).

    A line is sound if it has a field for each column and every field that isn't
    empty parses.  Every line is in one of the two; an empty line is none.  Each of
    the two is a scan of its own when it is computed.
    """
    lines = _lines(spark.read, folder, table, "_line")
    fields = [F.coalesce(F.col(name), F.lit("")) for name, _ in TABLES[table]]
    # Without quoting, a line with the right number of fields is these fields joined.
    whole = F.coalesce(F.col("_line"), F.concat_ws(",", *fields))
    count = F.size(F.split(whole, ",", -1))
    broken = [F.when(F.col(name).isNotNull() & _TYPED[kind](F.col(name)).isNull(), f"{name} is no {kind}") for name, kind in TABLES[table]]
    amiss = [F.when(count < len(fields), "too few fields"), F.when(count > len(fields), "too many fields"), *broken]
    told = lines.select("*", F.col("_metadata.file_name").alias("_file"), whole.alias("_whole"), F.filter(F.array(*amiss), lambda x: x.isNotNull()).alias("_reasons"))
    rejects = told.where(F.size("_reasons") > 0).select(F.col("_file").alias("file"), F.col("_whole").alias("line"), F.col("_reasons").alias("reasons"))
    return typed(told.where(F.size("_reasons") == 0), table), rejects


def observed_csv_table(spark: SparkSession, folder: str, table: str) -> tuple[DataFrame, Observation]:
    """:func:`read_csv_table`, and what it will have read once something has consumed it whole:
    rows, bytes (of the lines, with their ends) and files, from the running scan."""
    seen = Observation(f"scan of {table}")
    lines = _lines(spark.read, folder, table)
    length = sum((F.coalesce(F.octet_length(name), F.lit(0)) + 1 for name, _ in TABLES[table][1:]), F.coalesce(F.octet_length(TABLES[table][0][0]), F.lit(0)) + 1)
    # A file's first line is the first row of its first split.
    path = F.col("_metadata.file_path")
    told = lines.select("*", length.alias("_bytes"), path.alias("_path"))
    watched = told.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("_bytes"), F.lit(0)).alias("bytes"), F.collect_set("_path").alias("files"))
    return typed(watched, table), seen


def project(df: DataFrame, table: str) -> DataFrame:
    """Only the columns that the queries need; the scan then reads no others."""
    return df.select(*NEEDED[table])


def read_parquet_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan_stats(df: DataFrame) -> DataFrame:
    """file, rows, bytes: what a scan has read of each file."""
    return df.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count(F.lit(1)).alias("rows"))


def csv_stats(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return scan_stats(_lines(spark.read, folder, table))


def write_result_csv(df: DataFrame, path: str, order_by: list[str] | None = None) -> None:
    """One CSV file with a header; for results of reporting size.

    Larger ones are better written as they are: ``df.write.csv(path)``.
    """
    out = df.orderBy(*order_by) if order_by else df
    out.coalesce(1).write.mode("overwrite").options(header="true", quote="", emptyValue="").csv(path)
