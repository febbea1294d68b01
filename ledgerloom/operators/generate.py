"""Operators that make tables: keys, lines, documents, balances, prices and planted defects."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.draws import ColumnLike, as_col, draw
from ledgerloom.functions.values import fk
from ledgerloom.operators.spread import LIMITS, Limits, asof, dense_number, in_tasks, lookup_join, ordered_scan

__all__ = [
    "Defects", "Step", "asof", "balance", "defects", "document_flow", "fanout", "fk_sparse", "follow",
    "price_history", "rollup_total", "running", "spine", "valid_to",
]

ROWS_PER_PART = 4_000_000


def spine(spark: SparkSession, n: int, start: int = 1, parts: int | None = None, name: str = "id") -> DataFrame:
    """``n`` gap-free BIGINT keys from ``start``, made in place by every task."""
    if parts is None:
        parts = max(1, min(n, max(spark.sparkContext.defaultParallelism, math.ceil(n / ROWS_PER_PART))))
    return spark.range(start, start + n, 1, parts).withColumnRenamed("id", name)


def fk_sparse(
    df: DataFrame,
    parent: DataFrame,
    key: str,
    u: Column,
    out: str,
    skew: float = 1.0,
    row_key: Sequence[str] | None = None,
    limits: Limits = LIMITS,
) -> DataFrame:
    """Adds a foreign key into a parent whose keys have gaps.

    The parent's keys are numbered 1..n in key order, the draw picks a number, and an
    equi-join turns it into the key. The number's join may be skewed, so it is salted. A row
    without a draw gets no key; a parent without keys is refused.
    """
    keys = parent.filter(F.col(key).isNotNull()).select(F.col(key).alias(out)).distinct()
    n = keys.count()
    if not n:
        raise ValueError(f"the parent has no {key} to draw from")
    indexed = dense_number(keys, [], [out], "_index", limits, rows=n)
    placed = df.withColumn("_index", fk(u, n, skew))
    return lookup_join(placed, indexed, ["_index"], "left", row_key, limits, n).drop("_index")


def fanout(df: DataFrame, n: ColumnLike, out: str = "line_no", block: int | None = None) -> DataFrame:
    """Each header becomes ``n`` lines numbered from 1; headers with ``n`` < 1 have none.

    One explode, no shuffle. If a single header may own more lines than a task should make,
    set ``block``: headers are first cut into blocks of lines, those are spread over the
    cluster, and each block explodes by itself.
    """
    count = as_col(n).cast("bigint")
    if block is None:
        return df.filter(count >= 1).withColumn(out, F.explode(F.sequence(F.lit(1), count.cast("int"))))
    first = F.sequence(F.lit(1).cast("bigint"), count, F.lit(block).cast("bigint"))
    blocks = df.filter(count >= 1).withColumn("_first", F.explode(first)).withColumn("_count", count)
    # round-robin; Spark sorts before it, so a repeated task deals the rows out the same way
    spread = blocks.repartition(blocks.sparkSession.sparkContext.defaultParallelism * 3)
    last = F.least(F.col("_first") + F.lit(block - 1), F.col("_count"))
    lines = spread.withColumn(out, F.explode(F.sequence("_first", last)))
    return lines.withColumn(out, F.col(out).cast("int")).drop("_first", "_count")


def rollup_total(header: DataFrame, lines: DataFrame, key: str, amount: ColumnLike, out: str = "total") -> DataFrame:
    """Adds each header's total of its lines, 0 where it has none.

    Lines are summed before they are shuffled, so a header with very many lines costs one
    row per task.
    """
    totals = lines.groupBy(key).agg(F.sum(as_col(amount)).alias("_total"))
    joined = header.join(totals, key, "left")
    return joined.withColumn(out, F.coalesce("_total", F.lit(0).cast(totals.schema["_total"].dataType))).drop("_total")


@dataclass(frozen=True)
class Step:
    """One step of a document flow: kept at ``rate``, dated ``low``..``high`` days after the last."""

    name: str
    rate: float
    lag_days: tuple[int, int]


def follow(df: DataFrame, step: Step, after: ColumnLike, kept: Column, lag: Column) -> DataFrame:
    """Adds ``<step>_date``: null where the step (or the one before) does not happen.

    ``kept`` and ``lag`` are draws. A null ``after`` date stays null, so a chain of calls
    never has a later document without the earlier one. No shuffle and no join.
    """
    low, high = step.lag_days
    days = F.lit(low) + F.floor(lag * F.lit(float(high - low + 1))).cast("int")
    return df.withColumn(
        f"{step.name}_date", F.when(kept < F.lit(step.rate), F.date_add(as_col(after), days))
    )


def document_flow(
    df: DataFrame, start: ColumnLike, steps: Sequence[Step], seed: int, table: str, *keys: ColumnLike
) -> DataFrame:
    """Order -> shipment -> invoice -> payment (or any other chain) as one date per step."""
    after: ColumnLike = start
    for step in steps:
        kept = draw(seed, table, f"{step.name}_kept", *keys)
        lag = draw(seed, table, f"{step.name}_lag", *keys)
        df = follow(df, step, after, kept, lag)
        after = f"{step.name}_date"
    return df


def balance(
    lines: DataFrame, doc: str, amount: str, contra: Mapping[str, ColumnLike], line: str = "line_no"
) -> DataFrame:
    """Adds one line per document that brings its sum to zero.

    ``contra`` gives the new line's other columns, as columns over (doc, line, amount); the
    rest are null. The sums are combined before the shuffle. Line numbers go on after the
    document's last.
    """
    closing = lines.groupBy(doc).agg(
        (-F.sum(amount)).cast(lines.schema[amount].dataType).alias(amount),
        (F.max(line) + F.lit(1)).cast(lines.schema[line].dataType).alias(line),
    )
    closing = closing.select("*", *[as_col(value).alias(name) for name, value in contra.items()])
    return lines.unionByName(closing, allowMissingColumns=True)


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    amount: ColumnLike,
    out: str = "balance",
    limits: Limits = LIMITS,
) -> DataFrame:
    """Stock or account balance after each movement; heavy accounts are scanned in pieces."""
    return ordered_scan(df, by, order, {out: as_col(amount)}, "sum", limits)


def price_history(
    items: DataFrame,
    key: str,
    seed: int,
    base: ColumnLike,
    start: ColumnLike,
    versions: int,
    days: int,
    limits: Limits = LIMITS,
) -> DataFrame:
    """Dated prices in cents: ``versions`` per item, one every ``days`` days, valid_to exclusive.

    The last version stays open (valid_to null). Prices move within 20 % of ``base``. Items are counted
    and, if their versions are too many for one task, dealt out before they are multiplied.
    """
    items = in_tasks(items, items.columns, items.count() * versions, limits)
    number = F.col("version")
    factor = F.lit(0.8) + F.lit(0.4) * draw(seed, "price", "factor", key, number)
    opened = F.date_add(as_col(start), (number - F.lit(1)) * F.lit(days))
    closed = F.when(number < F.lit(versions), F.date_add(as_col(start), number * F.lit(days)))
    return fanout(items, F.lit(versions), "version").select(
        key,
        "version",
        opened.alias("valid_from"),
        closed.alias("valid_to"),
        F.floor(as_col(base) * factor).alias("price"),
    )


def valid_to(
    hist: DataFrame, on: Sequence[str], valid_from: str, out: str = "valid_to", limits: Limits = LIMITS
) -> DataFrame:
    """Closes each dated row where the next one of its key begins; the last stays open."""
    return ordered_scan(hist, on, [valid_from], {out: valid_from}, "next", limits)


@dataclass(frozen=True)
class Defects:
    """Rates of planted errors: column -> rate, except ``duplicates``, a rate for whole rows."""

    nulls: Mapping[str, float] = field(default_factory=dict)
    broken_keys: Mapping[str, float] = field(default_factory=dict)
    outliers: Mapping[str, float] = field(default_factory=dict)
    duplicates: float = 0.0


BROKEN_KEY_OFFSET = 1_000_000_000_000
OUTLIER_FACTOR = 1000


def defects(df: DataFrame, spec: Defects, seed: int, table: str, *keys: ColumnLike) -> DataFrame:
    """Plants seeded nulls, broken foreign keys, outliers and repeated rows.

    A column gets at most one kind of defect per row, in the order broken key, outlier,
    null. The ``truth`` column lists what was done, e.g. ``null:amount,duplicate``; it is
    empty for untouched rows. One narrow pass: repeats come from an explode, not a union.
    """

    def hit(kind: str, name: str, rate: float) -> Column:
        return draw(seed, table, f"{kind}:{name}", *keys) < F.lit(rate)

    changed: dict[str, Column] = {}
    notes: list[Column] = []
    touched = {**spec.broken_keys, **spec.outliers, **spec.nulls}
    for name in [c for c in df.columns if c in touched]:
        kind_of = F.lit(None).cast("string")
        value = F.col(name)
        plans = (
            ("null", spec.nulls, F.lit(None).cast(df.schema[name].dataType)),
            ("outlier", spec.outliers, value * F.lit(OUTLIER_FACTOR)),
            ("broken_key", spec.broken_keys, value + F.lit(BROKEN_KEY_OFFSET)),
        )
        for kind, rates, made in plans:
            if name in rates:
                chosen = hit(kind, name, rates[name])
                value = F.when(chosen, made.cast(df.schema[name].dataType)).otherwise(value)
                kind_of = F.when(chosen, F.lit(f"{kind}:{name}")).otherwise(kind_of)
        changed[name] = value
        notes.append(kind_of)

    copies = F.array(F.lit(0))
    if spec.duplicates:
        copies = F.when(hit("duplicate", "", spec.duplicates), F.array(F.lit(0), F.lit(1))).otherwise(copies)
    marked = df.select(
        *[changed.get(c, F.col(c)).alias(c) for c in df.columns],
        F.concat_ws(",", *notes).alias("_notes") if notes else F.lit("").alias("_notes"),
        F.explode(copies).alias("_copy"),
    )
    repeat = F.when(F.col("_copy") == 1, F.lit("duplicate"))
    noted = F.when(F.col("_notes") != "", F.col("_notes"))
    return marked.withColumn("truth", F.concat_ws(",", noted, repeat)).drop("_notes", "_copy")
