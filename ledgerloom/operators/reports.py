"""Accounting reports over journals, invoices and payments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.draws import ColumnLike, as_col


def trial_balance(journal: DataFrame, levels: Sequence[str], amount: str = "amount") -> DataFrame:
    """Debit, credit and balance per combination of ``levels``, with subtotals.

    ``depth`` counts the levels a row is split by; 0 is the grand total. Subtotals have null
    in the levels they add over.
    """
    value = F.col(amount)
    zero = F.lit(0).cast(journal.schema[amount].dataType)
    finest = journal.groupBy(*levels).agg(
        F.sum(F.when(value > 0, value).otherwise(zero)).alias("debit"),
        F.sum(F.when(value < 0, -value).otherwise(zero)).alias("credit"),
    )
    # subtotals multiply rows by the levels, so they are made of sums, not of journal lines
    debit, credit = F.sum("debit"), F.sum("credit")
    grouped = finest.rollup(*levels).agg(
        debit.alias("debit"), credit.alias("credit"), (debit - credit).alias("balance"), F.grouping_id().alias("_folded")
    )
    depth = F.lit(len(levels)) - F.bit_count("_folded")
    return grouped.select(*levels, depth.cast("int").alias("depth"), "debit", "credit", "balance")


# Upper ends of the usual ageing buckets, in days overdue.
AGES = (0, 30, 60, 90)


def age_names(ends: Sequence[int] = AGES) -> list[str]:
    inner = [f"d{low + 1}_{high}" for low, high in zip(ends, ends[1:])]
    return ["not_due", *inner, f"over_{ends[-1]}"]


def ageing(
    invoices: DataFrame,
    payments: DataFrame,
    as_of: Column,
    by: Sequence[str],
    invoice_key: str = "invoice_id",
    amount: ColumnLike = "amount",
    paid: ColumnLike = "amount",
    due: str = "due_date",
    ends: Sequence[int] = AGES,
) -> DataFrame:
    """Open amounts per ``by`` group in buckets of days overdue, one column per bucket.

    Payments are summed per invoice before the join. The bucket columns are conditional
    sums: what a pivot would make, in one aggregate with known columns.
    """
    settled = payments.groupBy(invoice_key).agg(F.sum(as_col(paid)).alias("_paid"))
    met = invoices.select(invoice_key, *by, due, as_col(amount).alias("_owed")).join(settled, invoice_key, "left")
    left = F.col("_owed") - F.coalesce("_paid", F.lit(0))
    late = F.datediff(as_of, F.col(due))
    open_items = met.select(*by, left.alias("_open"), late.alias("_late")).filter(F.col("_open") != 0)
    lows = [None, *ends]
    highs = [*ends, None]
    sums = []
    for name, low, high in zip(age_names(ends), lows, highs):
        inside = F.lit(True)
        if low is not None:
            inside = inside & (F.col("_late") > low)
        if high is not None:
            inside = inside & (F.col("_late") <= high)
        sums.append(F.coalesce(F.sum(F.when(inside, F.col("_open"))), F.lit(0)).alias(name))
    return open_items.groupBy(*by).agg(*sums, F.sum("_open").alias("open"))
