"""Operators that measure a seed table and draw values that look like it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.draws import as_col
from ledgerloom.operators import ranks
from ledgerloom.operators.ranks import quantiles
from ledgerloom.operators.spread import (
    LIMITS,
    Limits,
    asof,
    dense_number,
    lookup_join,
    ordered_scan,
    spread_small,
)

QUARTILES = (0.25, 0.5, 0.75)


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(c, num, big, txt) rows of the non-null values: column position and one of the three filled.

    Doubles cannot tell large whole numbers apart, so BIGINTs and dates travel as ``big``
    and whatever is neither as text.
    """
    entries = []
    for i, name in enumerate(cols):
        kind, value = df.schema[name].dataType, F.col(name)
        num, big, txt = (F.lit(None).cast(t) for t in ("double", "bigint", "string"))
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            num = value.cast("double") + F.lit(0.0)  # -0.0 and 0.0 are one value
        elif isinstance(kind, T.IntegralType):
            big = value.cast("bigint")
        elif isinstance(kind, T.DateType):
            big = F.unix_date(value).cast("bigint")
        else:
            txt = value.cast("string")
        entries.append(F.struct(F.lit(i).alias("c"), num.alias("num"), big.alias("big"), txt.alias("txt")))
    flat = df.select(F.inline(F.array(*entries)))
    return flat.filter(F.col("num").isNotNull() | F.col("big").isNotNull() | F.col("txt").isNotNull())


def _stats(df: DataFrame, cols: Sequence[str], picked: Sequence[int], numeric: bool, exact: bool) -> DataFrame:
    """One row per picked column, from one scan of those columns."""
    none_num, none_txt = F.lit(None).cast("double"), F.lit(None).cast("string")
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i in picked:
        value = F.col(cols[i])
        as_num = value.cast("double")
        rough = F.percentile_approx(as_num, F.array(*[F.lit(q) for q in QUARTILES]), F.lit(10_000))
        estimates = [
            F.approx_count_distinct(value).alias("distinct"),
            (rough if numeric else F.lit(None).cast("array<double>")).alias("q"),
        ]
        aggregates.append(
            F.struct(
                F.lit(i).alias("c"),
                F.lit(cols[i]).alias("column"),
                F.count_if(value.isNull()).alias("nulls"),
                (F.min(as_num) + F.lit(0.0) if numeric else none_num).alias("min_num"),
                (F.max(as_num) + F.lit(0.0) if numeric else none_num).alias("max_num"),
                (none_txt if numeric else F.min(value).cast("string")).alias("min_txt"),
                (none_txt if numeric else F.max(value).cast("string")).alias("max_txt"),
                (F.avg(as_num) if numeric else none_num).alias("mean"),
                (F.stddev_samp(as_num) if numeric else none_num).alias("sd"),
                *([] if exact else estimates),
            ).alias(f"_s{i}")
        )
    return df.agg(*aggregates).select("rows", F.inline(F.array(*[f"_s{i}" for i in picked])))


def profile(
    df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True, limits: Limits = LIMITS
) -> DataFrame:
    """One row per column: rows, nulls, distinct, min, max, mean, sd and quartiles.

    Numbers fill the ``_num`` bounds, the moments and the quartiles, other types the
    ``_txt`` bounds. Numbers and the rest are scanned apart, since text buffers would keep
    the numbers out of hash aggregation; no column is read twice for it. The exact form then
    counts every distinct value; with ``exact=False`` distinct and quartiles are estimates
    from the same scans.
    """
    cols = list(cols or df.columns)
    numeric = [i for i, name in enumerate(cols) if _is_number(df.schema[name].dataType)]
    others = [i for i in range(len(cols)) if i not in numeric]
    scans = [_stats(df, cols, picked, picked is numeric, exact) for picked in (numeric, others) if picked]
    stats = reduce(DataFrame.unionByName, scans)
    shown = ["column", "rows", "nulls", "distinct", "min_num", "max_num", "min_txt", "max_txt", "mean", "sd"]
    names = [f"q{int(p * 100)}" for p in QUARTILES]
    if not exact:
        return stats.select(*shown, *[F.get("q", i).alias(n) for i, n in enumerate(names)])

    measured = stats.collect()  # one row per column of the schema
    fixed = df.sparkSession.createDataFrame(measured, stats.schema)
    values = _long(spread_small(df.select(*cols), measured[0]["rows"], limits), cols)
    distinct = values.distinct().groupBy("c").agg(F.count(F.lit(1)).alias("distinct"))
    known = {row["c"]: ranks.Extent(row["rows"] - row["nulls"], row["min_num"], row["max_num"]) for row in measured}
    long = ranks.quantiles(df, [cols[i] for i in numeric], QUARTILES, limits, [known[i] for i in numeric])
    wide = long.groupBy("column").agg(
        *[F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(n) for p, n in zip(QUARTILES, names)]
    )
    # both have one row per column of the schema
    joined = fixed.join(F.broadcast(distinct), "c", "left").join(F.broadcast(wide), "column", "left")
    return joined.withColumn("distinct", F.coalesce("distinct", F.lit(0).cast("bigint"))).select(*shown, *names)


def freq(df: DataFrame, *cols: str) -> DataFrame:
    """Share of each value (or combination of values): (cols..., n, share)."""
    counts = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("share", F.col("n") / total)


def resample(
    df: DataFrame,
    seed_df: DataFrame,
    by: Sequence[str],
    cols: Sequence[str],
    order: Sequence[str],
    u: Column,
    row_key: Sequence[str] | None = None,
    limits: Limits = LIMITS,
) -> DataFrame:
    """Gives each row the ``cols`` of one seed row of its own ``by`` group.

    Several ``cols`` come from the same seed row, which keeps how they depend on each other.
    Seed rows are numbered per group along ``order``. Rows whose group has no seed row get
    nulls.
    """
    by = list(by)
    rows = seed_df.count()
    sizes = seed_df.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    numbered = dense_number(seed_df, by, order, "_index", limits).select(*by, "_index", *cols)
    sized = lookup_join(df, sizes, by, "left", row_key, limits)
    indexed = sized.withColumn("_index", F.lit(1).cast("bigint") + F.floor(u * F.col("_size"))).drop("_size")
    return lookup_join(indexed, numbered, [*by, "_index"], "left", row_key, limits, rows).drop("_index")


def quantile_grid(df: DataFrame, col: str, steps: int = 100, limits: Limits = LIMITS) -> list[float]:
    """``steps + 1`` exact quantiles of a column, from its minimum to its maximum."""
    probs = [i / steps for i in range(steps + 1)]
    grid = [r["quantile"] for r in quantiles(df, [col], probs, limits).sort("p").collect()]
    if not grid:
        raise ValueError(f"{col} has no values to take quantiles of")
    return grid


def from_quantiles(u: Column, grid: Sequence[float]) -> Column:
    """Smooth number whose distribution follows the quantile grid; no join."""
    last = len(grid) - 1
    points = F.array(*[F.lit(float(g)) for g in grid])
    place = u * F.lit(float(last))
    at = F.least(F.floor(place).cast("int"), F.lit(last - 1))
    low, high = F.get(points, at), F.get(points, at + F.lit(1))
    return low + (high - low) * (place - at)


def choice_from(
    df: DataFrame,
    choices: DataFrame,
    given: Sequence[str],
    value: str,
    weight: str,
    u: Column,
    row_key: Sequence[str],
    out: str | None = None,
    limits: Limits = LIMITS,
) -> DataFrame:
    """Draws ``value`` by whole-number ``weight`` from the choices of the row's ``given`` columns.

    Weights are added up per group in value order; the draw times the group's total falls
    into one value's part, which ``asof`` finds. Groups with no choice get null.
    """
    given, out = list(given), out or value
    choices = choices.filter(F.col(weight) > 0)
    upto = ordered_scan(choices, given, [value], {"_upto": F.col(weight).cast("bigint")}, "sum", limits)
    begin = (F.col("_upto") - F.col(weight)).cast("bigint")
    starts = upto.select(*given, begin.alias("_from"), F.col(value).alias(out))
    total = F.sum(weight).cast("bigint").alias("_size")
    if given:
        sized = lookup_join(df, choices.groupBy(*given).agg(total), given, "left", row_key, limits)
    else:
        sized = df.withColumn("_size", F.lit(choices.agg(total).head()[0]))
    placed = sized.withColumn("_pick", F.floor(u * F.col("_size")).cast("bigint")).drop("_size")
    return asof(placed, starts, given, "_pick", "_from", [out], row_key, limits).drop("_pick")


def cond_choice(
    df: DataFrame,
    seed_df: DataFrame,
    given: Sequence[str],
    col: str,
    u: Column,
    row_key: Sequence[str],
    out: str | None = None,
    limits: Limits = LIMITS,
) -> DataFrame:
    """A category of ``col`` given other categories, by the seed table's own frequencies."""
    counts = seed_df.filter(as_col(col).isNotNull()).groupBy(*given, col).agg(F.count(F.lit(1)).alias("_n"))
    return choice_from(df, counts, given, col, "_n", u, row_key, out, limits)
