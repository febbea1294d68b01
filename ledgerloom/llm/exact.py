"""Exact dedup: a 128-bit content hash groups, the bytes inside a group decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import settled, text_of, whole_row

KEEP = {"smallest": F.min, "largest": F.max}


def _keyed(df: DataFrame, id: str, text: str, *more: Column) -> DataFrame:
    return df.select(df[id].alias("doc_id"), text_of(df, text).alias("text"), *more).withColumns(
        {"hash": F.unhex(F.md5("text")), "sha": F.unhex(F.sha2("text", 256))}
    )


def text_groups(df: DataFrame, id: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per different text: (hash, sha, keep_id, group_size).

    Rows are grouped by MD5 *and* the text itself, so equality is that of the bytes; a group is
    summed in each task before anything is shuffled, which leaves one row per task and text of
    even the largest group of copies. Two texts with one MD5 stay two groups, told apart by
    their SHA-256; should that be equal as well, the job fails and merges nothing.
    """
    chosen = KEEP[keep]
    by_bytes = (
        _keyed(df, id, text)
        .groupBy("hash", "sha", "text")
        .agg(chosen("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    )
    clash = F.raise_error(F.lit("two texts share their MD5 and their SHA-256"))
    return (
        by_bytes.groupBy("hash", "sha")
        .agg(chosen("keep_id").alias("keep_id"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
        .select("hash", "sha", "keep_id", F.when(F.col("texts") > 1, clash).otherwise(F.col("n")).alias("group_size"))
    )


def exact_dedup(df: DataFrame, id: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """Every row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` is "smallest" or "largest": the id that stays in a group of equal texts. A null text
    counts as empty. A row without id stays only where its whole group has none. Repeated rows
    count each; rows that repeat the id that stays are all marked (``survivors`` returns one).
    The empty table gives no rows; other columns of ``df`` play no part.
    """
    rows = _keyed(df, id, text).drop("text").alias("r")
    groups = settled(text_groups(df, id, text, keep), "groups").alias("g")  # so that AQE can split a hot group's rows
    return rows.join(groups, (F.col("r.hash") == F.col("g.hash")) & (F.col("r.sha") == F.col("g.sha"))).select(
        "r.doc_id",
        "g.keep_id",
        "g.group_size",
        F.col("r.doc_id").eqNullSafe(F.col("g.keep_id")).alias("kept"),
        F.lower(F.hex("r.sha")).alias("text_sha256"),
    )


def survivors(df: DataFrame, id: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``df``, with all their columns, that stay: one for each different text."""
    rows = _keyed(df, id, text, whole_row(df).alias("row")).drop("text").alias("r")
    groups = text_groups(df, id, text, keep).alias("g")
    same = (
        (F.col("r.hash") == F.col("g.hash"))
        & (F.col("r.sha") == F.col("g.sha"))
        & F.col("r.doc_id").eqNullSafe(F.col("g.keep_id"))
    )
    copies = Window.partitionBy("hash", "sha", "doc_id").orderBy(F.xxhash64("row"))
    stay = rows.join(groups, same, "left_semi").withColumn("copy", F.row_number().over(copies))
    return stay.filter("copy = 1").select("row.*")
