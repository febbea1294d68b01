"""Dated rows swept by time: where a key's ranges overlap or leave gaps, and the ranges that they cover together."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.spread import LIMITS, Limits, ordered_scan

OPEN = dt.date(9999, 12, 31)  # stands for the end of a range that is still open


def _swept(
    hist: DataFrame, on: Sequence[str], valid_from: str, valid_to: str, row_key: Sequence[str], limits: Limits
) -> DataFrame:
    """Ranges that hold a day, with ``_end`` and ``_reached``: the latest end of the key's ranges that begin before."""
    ends = hist.withColumn("_end", F.coalesce(F.col(valid_to).cast("date"), F.lit(OPEN)))
    sound = ends.filter(F.col(valid_from) < F.col("_end"))
    return ordered_scan(sound, on, [valid_from, "_end", *row_key], {"_reached": "_end"}, "max_before", limits)


def validity_faults(
    hist: DataFrame, on: Sequence[str], valid_from: str, valid_to: str, row_key: Sequence[str], limits: Limits = LIMITS
) -> DataFrame:
    """Rows that begin before all earlier ranges of their key have ended, or later than that, and rows that hold no day.

    Adds ``fault`` (``overlap``, ``gap`` or ``empty``) and ``days``: how many days of the row lie in
    earlier ranges (null if that never ends), or how many lie between. Ends are exclusive; a null end is open, and a row
    without a beginning is ``empty``. Rows that follow each other without either are left out.
    One scan in the order of time, whatever the number of ranges that overlap: no row meets another.
    """
    begin = F.col(valid_from).cast("date")
    swept = _swept(hist, on, valid_from, valid_to, row_key, limits)
    fault = F.when(F.col("_reached") > begin, "overlap").when(F.col("_reached") < begin, "gap")
    both = F.nullif(F.least("_reached", "_end"), F.lit(OPEN))
    shared = F.datediff(both, begin)
    days = F.when(fault == "overlap", shared).otherwise(F.datediff(begin, "_reached"))
    found = swept.withColumns({"fault": fault, "days": days}).filter("fault IS NOT NULL")
    none = hist.filter(~F.coalesce(begin < F.coalesce(F.col(valid_to).cast("date"), F.lit(OPEN)), F.lit(False)))
    none = none.withColumns({"fault": F.lit("empty"), "days": F.lit(0)})
    return found.select(*hist.columns, "fault", "days").unionByName(none.select(*hist.columns, "fault", "days"))


def covered(
    hist: DataFrame, on: Sequence[str], valid_from: str, valid_to: str, row_key: Sequence[str], limits: Limits = LIMITS
) -> DataFrame:
    """(on..., valid_from, valid_to, rows): the ranges that a key's rows cover, overlapping and touching ones as one.

    An end is null if a row's is. The sweep marks where a range begins that none before reaches; a
    running count of the marks numbers the ranges, and a grouping sums them up before it shuffles.
    """
    swept = _swept(hist, on, valid_from, valid_to, row_key, limits)
    begins: Column = F.col("_reached").isNull() | (F.col("_reached") < F.col(valid_from))
    order = [valid_from, "_end", *row_key]
    numbered = ordered_scan(swept.withColumn("_new", begins.cast("bigint")), on, order, {"_range": "_new"}, "sum", limits)
    ranges = numbered.groupBy(*on, "_range").agg(
        F.min(valid_from).alias(valid_from), F.max("_end").alias("_end"), F.count(F.lit(1)).alias("rows")
    )
    return ranges.select(*on, valid_from, F.nullif(F.col("_end"), F.lit(OPEN)).alias(valid_to), "rows")
