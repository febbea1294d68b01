"""What the operators share: given tables, working tables, rows kept whole, the words of a text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import work_dir

SPACES = r"\x20\x09-\x0D"  # the characters between words: the blank, and tab to carriage return


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def settled(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: made once, and no lineage
    left that a lost executor would have to repeat."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def text_of(df: DataFrame, text: str) -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(df[text], F.lit(""))


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that added columns cannot clash with their names."""
    return F.struct(*[df[f"`{name.replace('`', '``')}`"].alias(name) for name in df.columns])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{SPACES}]+"))
