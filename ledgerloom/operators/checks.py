"""Checks on finished tables, and distances between a table and the one it imitates.

Rows are counted per value before they are shuffled, so a key that repeats very often
travels as one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.draws import ColumnLike, as_col
from ledgerloom.operators.ranks import ks_distance
from ledgerloom.operators.spread import LIMITS, Limits, lookup_join


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that appear more than once, with their number of rows ``n``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def fk_ok(child: DataFrame, parent: DataFrame, on: str, parent_key: str | None = None) -> DataFrame:
    """Foreign keys with no parent, with their number of child rows ``n``; null keys pass.

    Child keys are counted first and only then matched.
    """
    keys = child.filter(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("n"))
    return keys.join(parent.select(F.col(parent_key or on).alias(on)), on, "left_anti")


def orphans(
    child: DataFrame,
    parent: DataFrame,
    on: str,
    parent_key: str | None = None,
    row_key: Sequence[str] | None = None,
    limits: Limits = LIMITS,
) -> DataFrame:
    """The child rows themselves whose foreign key has no parent."""
    broken = fk_ok(child, parent, on, parent_key).select(on)
    return lookup_join(child, broken, [on], "left_semi", row_key, limits)


@dataclass(frozen=True)
class Rule:
    """A named condition that is true for a row that breaks the rule."""

    name: str
    broken: Column


def not_null(col: str) -> Rule:
    return Rule(f"{col} is not null", F.col(col).isNull())


def in_range(col: str, low, high) -> Rule:
    return Rule(f"{col} in [{low}, {high}]", ~F.col(col).between(low, high))


def one_of(col: str, *values) -> Rule:
    return Rule(f"{col} in ({', '.join(map(str, values))})", ~F.col(col).isin(*values))


def domain(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule, violations) for any number of rules over one table, in one scan."""
    counted = df.agg(*[F.count_if(rule.broken).alias(f"r{i}") for i, rule in enumerate(rules)])
    pairs = [F.struct(F.lit(r.name).alias("rule"), F.col(f"r{i}").alias("violations")) for i, r in enumerate(rules)]
    return counted.select(F.inline(F.array(*pairs)))


def balanced(df: DataFrame, doc: str, amount: ColumnLike) -> DataFrame:
    """Documents whose lines do not add up to zero, with the ``difference``."""
    return df.groupBy(doc).agg(F.sum(as_col(amount)).alias("difference")).filter(F.col("difference") != 0)


def header_matches(
    header: DataFrame, lines: DataFrame, key: str, total: ColumnLike, amount: ColumnLike
) -> DataFrame:
    """Keys whose header ``total`` differs from the sum of lines (also one without the other)."""
    sides = header.select(key, as_col(total).alias("_side")).unionByName(
        lines.select(key, (-as_col(amount)).alias("_side"))
    )
    return sides.groupBy(key).agg(F.sum("_side").alias("difference")).filter(F.col("difference") != 0)


def dates_ok(df: DataFrame, before: ColumnLike, after: ColumnLike) -> DataFrame:
    """Rows whose ``after`` date lies before their ``before`` date."""
    return df.filter(as_col(after) < as_col(before))


def dates_ok_between(
    child: DataFrame,
    parent: DataFrame,
    on: Sequence[str],
    before: str,
    after: str,
    row_key: Sequence[str] | None = None,
    limits: Limits = LIMITS,
) -> DataFrame:
    """Child rows dated (``after``) before their parent's ``before``, with the parent's date."""
    dated = lookup_join(child, parent.select(*on, before), on, "inner", row_key, limits)
    return dates_ok(dated, before, after)


@dataclass(frozen=True)
class Side:
    """A table's part in the rules of a key: its key columns, and measures as name -> (kind, column).

    Kinds are ``sum``, ``min`` and ``max``. The rows of a key are always counted.
    """

    table: str
    df: DataFrame
    key: Sequence[str]
    measures: Mapping[str, tuple[str, ColumnLike]] = field(default_factory=dict)


@dataclass(frozen=True)
class KeyRule:
    """A named rule of a table: ``violations`` is a number per key, over ``rows_of`` and ``measure`` columns."""

    name: str
    table: str
    violations: Column


def rows_of(table: str) -> Column:
    """Rows that a side has of the key."""
    return F.coalesce(F.col(f"{table}.rows"), F.lit(0))


def measure(table: str, name: str) -> Column:
    """A side's measure over its rows of the key; null where it has none."""
    return F.col(f"{table}.{name}")


def unique_key(table: str, name: str) -> KeyRule:
    """Keys that appear more than once."""
    return KeyRule(name, table, (rows_of(table) > 1).cast("bigint"))


def known_key(child: str, parent: str, name: str) -> KeyRule:
    """Child rows whose key the parent does not have; null keys pass."""
    return KeyRule(name, child, F.when(F.col("has_key") & (rows_of(parent) == 0), rows_of(child)).otherwise(F.lit(0)))


def same_sum(header: str, total: str, lines: str, amount: str, name: str) -> KeyRule:
    """Keys whose header total differs from the sum of lines (also one without the other)."""
    sides = [F.coalesce(measure(header, total), F.lit(0)), F.coalesce(measure(lines, amount), F.lit(0))]
    return KeyRule(name, header, (sides[0] != sides[1]).cast("bigint"))


def zero_sum(table: str, amount: str, name: str) -> KeyRule:
    """Keys whose rows do not add up to zero."""
    return KeyRule(name, table, (F.coalesce(measure(table, amount), F.lit(0)) != 0).cast("bigint"))


def not_before(child: str, after: str, parent: str, before: str, name: str) -> KeyRule:
    """Keys whose earliest child date (a ``min``) lies before the parent's latest (a ``max``)."""
    early = F.col("has_key") & (measure(child, after) < measure(parent, before))
    return KeyRule(name, child, F.coalesce(early.cast("bigint"), F.lit(0)))


_KINDS = {"sum": F.sum, "min": F.min, "max": F.max}


def key_rules(sides: Sequence[Side], rules: Sequence[KeyRule]) -> DataFrame:
    """(rule, table_name, violations) for any number of rules about one key, in one grouping.

    Each table is read once and gives narrow rows of key and measures; all are counted and
    summed per key in their tasks, meet in one shuffle, and each rule looks at a key's sums alone.
    A key that repeats very often travels as one row per task.
    """
    width = len(sides[0].key)
    narrow, sums = [], []
    for side in sides:
        if len(side.key) != width:
            raise ValueError("all sides need as many key columns")
        own = {"rows": ("sum", F.lit(1).cast("bigint")), **side.measures}
        names = [f"{side.table}|{i}" for i in range(len(own))]
        keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(side.key)]
        narrow.append(side.df.select(*keys, *[as_col(value).alias(n) for n, (_, value) in zip(names, own.values())]))
        sums += [_KINDS[kind](n).alias(n) for n, (kind, _) in zip(names, own.values())]
    keys = [f"_k{i}" for i in range(width)]
    parts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), narrow).groupBy(*keys).agg(*sums)
    shaped = parts.select(
        reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]).alias("has_key"),
        *[
            F.struct(*[F.col(f"{side.table}|{i}").alias(name) for i, name in enumerate(["rows", *side.measures])]).alias(side.table)
            for side in sides
        ],
    )
    counted = shaped.agg(*[F.coalesce(F.sum(rule.violations), F.lit(0)).cast("bigint").alias(f"r{i}") for i, rule in enumerate(rules)])
    rows = [
        F.struct(F.lit(r.name).alias("rule"), F.lit(r.table).alias("table_name"), F.col(f"r{i}").alias("violations"))
        for i, r in enumerate(rules)
    ]
    return counted.select(F.inline(F.array(*rows)))


def ks(a: DataFrame, b: DataFrame, col: str, limits: Limits = LIMITS) -> DataFrame:
    """Exact Kolmogorov-Smirnov distance of one numeric column: (n_a, n_b, ks); nulls are left out."""
    value = F.col(col).cast("double") + F.lit(0.0)
    left = a.select(value.alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    right = b.select(value.alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    return ks_distance(left.unionByName(right).filter(F.col("v").isNotNull()), limits)


def tvd(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Total variation distance and chi-square of one category: (tvd, chi_square, categories).

    Chi-square tests ``a``'s counts against the shares of ``b``, over the values ``b`` has.
    """
    sides = a.select(F.col(col).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        b.select(F.col(col).alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    met = sides.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    rows_a, rows_b = (side.agg(F.count(F.lit(1)).cast("double")).scalar() for side in (a, b))
    share_a, share_b = F.col("a") / rows_a, F.col("b") / rows_b
    expected = share_b * rows_a
    off = F.when(F.col("b") > 0, (F.col("a") - expected) * (F.col("a") - expected) / expected)
    return met.agg(
        (F.sum(F.abs(share_a - share_b)) / 2).alias("tvd"),
        F.sum(off).alias("chi_square"),
        F.count(F.lit(1)).alias("categories"),
    )


def correlations(df: DataFrame, cols: Sequence[str], out: str = "r") -> DataFrame:
    """(x, y, r) for every pair of columns, from one aggregate over one scan."""
    pairs = [(x, y) for i, x in enumerate(cols) for y in cols[i + 1 :]]
    wide = df.agg(*[F.corr(x, y).alias(f"r{i}") for i, (x, y) in enumerate(pairs)])
    rows = [
        F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"r{i}").alias(out))
        for i, (x, y) in enumerate(pairs)
    ]
    return wide.select(F.inline(F.array(*rows)))


def corr_gap(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Each pair's correlation in both tables and the difference: (x, y, r_a, r_b, gap)."""
    met = correlations(a, cols, "r_a").join(F.broadcast(correlations(b, cols, "r_b")), ["x", "y"])
    return met.withColumn("gap", F.col("r_a") - F.col("r_b"))


def copies(gen: DataFrame, seed: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Value combinations of ``gen`` that also occur in ``seed``, with ``gen``'s rows ``n``.

    Both sides are counted per combination in one grouping; nulls match nulls.
    """
    sides = gen.select(*cols, F.lit(1).alias("n"), F.lit(0).alias("_real")).unionByName(
        seed.select(*cols, F.lit(0).alias("n"), F.lit(1).alias("_real"))
    )
    met = sides.groupBy(*cols).agg(F.sum("n").alias("n"), F.max("_real").alias("_real"))
    return met.filter("n > 0 AND _real = 1").drop("_real")
