"""Weighted choice from very many values by an alias table: one equi-join on a slot and one compare."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.spread import LIMITS, Limits, dense_number, lookup_join, ordered_scan


def alias_table(choices: DataFrame, value: str, weight: str, limits: Limits = LIMITS) -> DataFrame:
    """Walker's table as rows (slot, value, own, alias, full) for whole-number weights.

    There is a slot for each of the n values with a positive weight, numbered from 0 in the order of
    values. A slot is ``full`` (the sum of all weights) wide; its own value has ``own`` of it and
    ``alias`` the rest. Over all slots each value has exactly n times its weight.

    Nothing is paired one after the other. What values below the mean lack is laid on one line, what
    those above have to spare on another; where a lack begins tells which value fills it, and
    where a value's spare ends tells what it lacks itself, which the next one fills. So two running
    sums and one scan of both lines make the table, in pieces where it is large.
    """
    known = choices.filter((F.col(weight) > 0) & F.col(value).isNotNull()).select(
        F.col(value).alias("value"), F.col(weight).cast("bigint").alias("weight")
    )
    n, full = known.agg(F.count(F.lit(1)), F.sum("weight")).head()
    if not n:
        raise ValueError(f"no {value} has a positive {weight}")
    if n * full >= 2**63:
        raise ValueError("values times the sum of weights must stay below 2^63")
    numbered = dense_number(known, [], ["value"], "_number", limits, rows=n)
    over = (F.col("weight") * F.lit(n) - F.lit(full)).alias("over")
    slots = numbered.select("value", (F.col("_number") - 1).alias("slot"), over)
    lacking = ordered_scan(slots.filter("over < 0"), [], ["value"], {"upto": -F.col("over")}, "sum", limits)
    lacking = lacking.select("value", "slot", "over", (F.col("upto") + F.col("over")).alias("at"), F.lit(0).alias("spare"))
    spare = ordered_scan(slots.filter("over > 0"), [], ["value"], {"at": F.col("over")}, "sum", limits)
    spare = ordered_scan(spare, [], ["value"], {"after": F.col("value")}, "next", limits)
    line = lacking.unionByName(spare.withColumn("spare", F.lit(1)), allowMissingColumns=True).withColumn("back", -F.col("at"))
    seen = {
        "filler": F.when(F.col("spare") == 1, F.col("value")),  # the next value whose spare ends beyond here
        "begun": F.when(F.col("spare") == 0, F.col("at")),  # where the next lack begins
    }
    met = ordered_scan(line, [], ["back", "spare"], seen, "last", limits, rows=n)
    lack_total = slots.agg(F.coalesce(F.sum(F.when(F.col("over") < 0, -F.col("over"))), F.lit(0))).scalar()
    short = F.coalesce("begun", lack_total) - F.col("at")  # what a value gave beyond its spare
    paired = met.select(
        "slot",
        "value",
        (F.lit(full) + F.when(F.col("spare") == 1, -short).otherwise(F.col("over"))).alias("own"),
        F.when(F.col("spare") == 1, F.col("after")).otherwise(F.col("filler")).alias("alias"),
    )
    even = slots.filter("over = 0").select("slot", "value", F.lit(full).cast("bigint").alias("own"), F.lit(None).cast(known.schema["value"].dataType).alias("alias"))
    table = paired.unionByName(even).withColumn("full", F.lit(full).cast("bigint"))
    return table.withColumn("alias", F.when(F.col("own") < F.col("full"), F.col("alias")))


def alias_choice(
    df: DataFrame, table: DataFrame, u: Column, v: Column, row_key: Sequence[str], out: str, limits: Limits = LIMITS
) -> DataFrame:
    """Draws a value for each row: ``u`` takes a slot, ``v`` a place in it. No search: the rows join their slots.

    Slots are taken evenly, so the join has no heavy key, however uneven the weights are. Rows
    with a null draw get null.
    """
    n = table.count()
    slot = F.least(F.floor(u * F.lit(float(n))), F.lit(n - 1)).cast("bigint")
    joined = lookup_join(df.withColumns({"slot": slot, "_place": v}), table, ["slot"], "left", row_key, limits, n)
    own = F.floor(F.col("_place") * F.col("full")) < F.col("own")
    return joined.withColumn(out, F.when(own, F.col("value")).otherwise(F.col("alias"))).select(*df.columns, out)
