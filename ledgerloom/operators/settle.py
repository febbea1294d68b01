"""Payments set against invoices, oldest first, and stock that is ordered again before it runs out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.draws import ColumnLike, as_col
from ledgerloom.operators.spread import LIMITS, Limits, ordered_scan

INVOICE, PAYMENT = 0, 1


def settle(
    invoices: DataFrame,
    payments: DataFrame,
    by: Sequence[str],
    invoice_key: str = "invoice_id",
    due: str = "due_date",
    payment_key: str = "payment_id",
    paid_on: str = "pay_date",
    amount: str = "amount",
    limits: Limits = LIMITS,
) -> DataFrame:
    """(by..., invoice_key, payment_key, amount): what each payment pays of each invoice, oldest first.

    A customer's invoices, in the order of ``due`` and key, fill a line from 0 to their sum, and
    so do the payments in the order of ``paid_on`` and key. Where two ranges overlap, the one pays the other.
    The beginnings of both sides' ranges are put on one line and the latest of each side is carried on:
    rows grow with invoices plus payments, never with their product, and a customer with many rows is
    scanned in pieces. Invoices that nothing pays come with a null payment, payments left over with a
    null invoice, so that the amounts of an invoice, and of a payment, add up to its own. Amounts that are null, zero
    or negative take no part. Keys have to be unique within a customer.
    """
    by = list(by)

    def side(df: DataFrame, number: int, key: str, when: str) -> DataFrame:
        return df.filter(F.col(amount) > 0).select(
            *by, F.lit(number).alias("_side"), F.col(when).alias(f"_when{number}"),
            F.col(key).alias(f"_key{number}"), F.col(amount).alias("_amount"),
        )

    both = side(invoices, INVOICE, invoice_key, due).unionByName(
        side(payments, PAYMENT, payment_key, paid_on), allowMissingColumns=True
    )
    order = [f"{name}{number}" for number in (INVOICE, PAYMENT) for name in ("_when", "_key")]
    placed = ordered_scan(both, [*by, "_side"], order, {"_end": "_amount"}, "sum", limits)
    money = placed.schema["_end"].dataType
    begins = placed.withColumn("_at", (F.col("_end") - F.col("_amount")).cast(money)).drop("_amount", "_when0", "_when1")

    # each side closes where its sum ends, at 0 if it has no rows; nothing is told of a customer before both are known
    def closing(number: int) -> Column:
        total = F.sum(F.when(F.col("_side") == number, F.col("_amount")))
        at = F.coalesce(total.cast(money), F.lit(0).cast(money))
        return F.struct(F.lit(number).alias("_side"), at.alias("_at"))

    closed = both.groupBy(*by).agg(F.array(closing(INVOICE), closing(PAYMENT)).alias("_ends"))
    line = begins.unionByName(closed.select(*by, F.inline("_ends")), allowMissingColumns=True)

    def latest(number: int) -> Column:
        return F.when(F.col("_side") == number, F.struct("_end", F.col(f"_key{number}").alias("key")))

    carried = ordered_scan(
        line, by, ["_at", "_side"], {"_invoice": latest(INVOICE), "_payment": latest(PAYMENT)}, "last", limits
    )
    upto = F.least(F.col("_invoice")["_end"], F.col("_payment")["_end"])
    met = carried.filter("_invoice IS NOT NULL AND _payment IS NOT NULL").select(
        *by,
        F.col("_invoice")["key"].alias(invoice_key),
        F.col("_payment")["key"].alias(payment_key),
        (upto - F.col("_at")).cast(money).alias(amount),
    )
    return met.filter(F.col(amount) > 0)


def reordered(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    qty: ColumnLike,
    floor: int = 0,
    lot: int = 1,
    limits: Limits = LIMITS,
) -> DataFrame:
    """Adds ``ordered``, what is bought at a movement so that stock never falls below ``floor``, and ``balance`` after it.

    The least number of whole lots is bought that lifts the balance to the floor. What has been
    bought up to a row is the running maximum of what its plain running sum lacks, in lots: steps that lift a balance to a
    floor compose to one such step, so the scan needs no row-by-row state and
    heavy keys are scanned in pieces. A null quantity moves nothing.
    """
    if lot < 1:
        raise ValueError("a lot holds 1 at least")
    moved = F.coalesce(as_col(qty).cast("bigint"), F.lit(0).cast("bigint"))
    plain = ordered_scan(df, by, order, {"_sum": moved}, "sum", limits)
    lacks = F.lit(floor).cast("bigint") - F.col("_sum")
    lots = F.when(lacks > 0, F.expr(f"({floor} - _sum + {lot - 1}) div {lot}")).otherwise(F.lit(0).cast("bigint"))
    seen = ordered_scan(plain.withColumn("_lots", lots), by, order, {"_before": "_lots"}, "max_before", limits)
    before = F.coalesce("_before", F.lit(0).cast("bigint"))
    bought = F.greatest(before, F.col("_lots"))
    size = F.lit(lot).cast("bigint")
    return seen.select(
        *df.columns, ((bought - before) * size).alias("ordered"), (F.col("_sum") + bought * size).alias("balance")
    )
