"""Reading given tables and writing generated ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import types as T

FORMATS = ("parquet", "orc", "csv", "json")
# Keeps nulls apart from empty text, and blanks at either end of a text.
CSV = {"header": True, "nullValue": "\\N", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_table(
    spark: SparkSession,
    folder: str,
    name: str,
    fmt: str = "parquet",
    schema: T.StructType | None = None,
    line_breaks: bool = True,
) -> DataFrame:
    """One table from ``folder``.

    CSV and JSON carry no types, so those need ``schema``; it is never inferred from data.
    CSV files are split among tasks only with ``line_breaks=False``, which is right as long
    as no text holds a line break; ``write`` keeps files small for the other case.
    """
    if fmt in ("csv", "json") and schema is None:
        raise ValueError(f"reading {fmt} needs a schema")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.options(**CSV, multiLine=line_breaks)
    return reader.load(f"{folder.rstrip('/')}/{name}")


def given(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given Parquet tables, ``<folder>/<name>.parquet``."""
    return read_table(spark, folder, f"{name}.parquet")


def write(
    tables: Mapping[str, DataFrame],
    path: str,
    fmt: str = "parquet",
    by: Mapping[str, Sequence[str]] | None = None,
    mode: str = "errorifexists",
    rows_per_file: int = 2_000_000,
    watch: Mapping[str, tuple[Observation, Sequence[Column]]] | None = None,
) -> dict[str, str]:
    """Writes each table to its own folder, partitioned by the columns ``by`` names for it.

    Partitioned tables are rebalanced first: adaptive execution gathers a partition value's
    rows into few files and splits a value that holds too many over several tasks. ``watch`` names
    aggregates to take of a table's rows as they are written; they belong to the tasks that write,
    so a task or shuffle that runs again counts once. Returns the folder of each table.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}, known: {', '.join(FORMATS)}")
    folders = {}
    for name, df in tables.items():
        columns = list((by or {}).get(name, ()))
        if columns:
            df = df.hint("rebalance", *columns)
        if name in (watch or {}):
            observation, aggregates = watch[name]
            df = df.observe(observation, *aggregates)
        writer = df.write.format(fmt).mode(mode).option("maxRecordsPerFile", rows_per_file)
        if fmt == "csv":
            writer = writer.options(**CSV)
        if columns:
            writer = writer.partitionBy(*columns)
        folders[name] = f"{path.rstrip('/')}/{name}"
        writer.save(folders[name])
    return folders
