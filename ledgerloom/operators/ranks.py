"""Exact ranks of numeric columns without sorting them.

Values are put into bins that keep their order, and counted per bin: a sum per task and a
few thousand numbers to the driver. The counts tell which bins hold what is asked for, and
only the values of those bins are shuffled and sorted. Bins are shaped by a sample,
which decides how even they are, not what comes out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.values import last_at_most
from ledgerloom.operators.spread import LIMITS, Limits, ordered_scan

BINS = 4096  # at most, of one column
ENTRIES = 65_536  # about how many bin counts may come to the driver
SAMPLE = 100_000  # rows looked at to shape the bins


@dataclass(frozen=True)
class Bins:
    """Order-keeping bins: even around the middle of the values, wider with the distance from it."""

    middle: float
    spread: float
    low: float
    per_unit: float
    count: int

    def of(self, value: Column) -> Column:
        """The bin's number; a little arithmetic in generated code, rising with the value."""
        away = (value - F.lit(self.middle)) / F.lit(self.spread)
        bent = F.signum(away) * F.log1p(F.abs(away))
        step = F.floor((bent - F.lit(self.low)) * F.lit(self.per_unit))
        inside = F.least(F.greatest(step, F.lit(0)), F.lit(self.count - 1))
        return F.when(F.isnan(value), F.lit(self.count - 1)).otherwise(inside).cast("int")


@dataclass(frozen=True)
class Extent:
    """How many values a column has and between which bounds."""

    size: int
    low: float | None
    high: float | None


def extents(df: DataFrame, values: Sequence[Column]) -> list[Extent]:
    parts = [F.struct(F.count(v), F.min(v), F.max(v)).alias(f"e{i}") for i, v in enumerate(values)]
    return [Extent(*found) for found in df.agg(*parts).head()]


def bins_for(df: DataFrame, values: Sequence[Column], found: Sequence[Extent]) -> list[Bins]:
    """Bins for each column, shaped by the quartiles of a sample; they hold every value all the same.

    The sample is a scan of its own: estimates within the scan for the extents would keep it
    out of generated code.
    """
    most = max(extent.size for extent in found)
    looked_at = df.sample(fraction=min(1.0, SAMPLE / max(most, 1)), seed=7)
    probs = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    shapes = looked_at.agg(*[F.percentile_approx(v, probs, F.lit(1000)).alias(f"q{i}") for i, v in enumerate(values)])
    return [_bins(extent, shape, len(found)) for extent, shape in zip(found, shapes.head())]


def _bins(extent: Extent, quartiles: Sequence[float] | None, columns: int) -> Bins:
    low, high = extent.low, extent.high
    count = max(64, min(BINS, ENTRIES // columns))
    if not extent.size or not math.isfinite(high - low) or low == high:
        return Bins(0.0, 1.0, 0.0, 0.0, 1)
    first, middle, third = quartiles or (low, (low + high) / 2, high)
    spread = (third - first) / 2 or (high - low) / count

    def bent(value: float) -> float:
        away = (value - middle) / spread
        return math.copysign(math.log1p(abs(away)), away)

    return Bins(middle, spread, bent(low), count / (bent(high) - bent(low)), count)


def _neighbours(size: int, p: float) -> tuple[int, int, float]:
    """The two ranks around quantile ``p`` of ``size`` values, and the way between them."""
    rank = (size - 1) * p
    low = math.floor(rank)
    return low, min(low + 1, size - 1), rank - low


def quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    limits: Limits = LIMITS,
    found: Sequence[Extent] | None = None,
) -> DataFrame:
    """Exact quantiles of numeric columns as (column, p, quantile), interpolated between ranks.

    ``found`` may hold the columns' extents where they are known already.
    """
    spark = df.sparkSession
    numbers = [F.col(name).cast("double") + F.lit(0.0) for name in cols]  # -0.0 and 0.0 are one value
    found = found or extents(df, numbers)
    kept = [i for i in range(len(cols)) if found[i].size]
    sizes = {i: found[i].size for i in kept}
    targets = [(i, cols[i], float(p), *_neighbours(sizes[i], p)) for i in kept for p in probs]
    schema = "c int, column string, p double, low bigint, high bigint, part double"
    if not targets:
        return spark.createDataFrame([], "column string, p double, quantile double")
    wanted = {i: sorted({rank for c, _, _, low, high, _ in targets if c == i for rank in (low, high)}) for i in kept}

    whole = sum(sizes.values()) <= limits.heavy_rows
    bins = [None] * len(cols) if whole else bins_for(df, numbers, found)
    entries = []
    for i in kept:
        place = F.lit(0) if whole else bins[i].of(numbers[i])
        entries.append(F.struct(F.lit(i).alias("c"), place.alias("bin"), numbers[i].alias("v")))
    values = df.select(F.inline(F.array(*entries))).filter(F.col("v").isNotNull())
    if whole:
        parts = [(i, 0, 0, wanted[i]) for i in kept]
        rows = sum(sizes.values())
    else:
        counts = values.groupBy("c", "bin").agg(F.count(F.lit(1)).alias("n")).sort("c", "bin").collect()
        parts, rows = [], 0
        for i in kept:
            own = [(r["bin"], r["n"]) for r in counts if r["c"] == i]
            befores = accumulate((n for _, n in own), initial=0)
            for (number, n), before in zip(own, befores):
                inside = [rank for rank in wanted[i] if before <= rank < before + n]
                if inside:
                    parts.append((i, number, before, inside))
                    rows += n
    starts = spark.createDataFrame(parts, "c int, bin int, before bigint, ranks array<bigint>")
    at_value = values.join(F.broadcast(starts.select("c", "bin")), ["c", "bin"])
    at_value = at_value.groupBy("c", "bin", "v").agg(F.count(F.lit(1)).alias("n"))
    ranked = ordered_scan(at_value, ["c", "bin"], ["v"], {"_upto": "n"}, "sum", limits, rows=rows)
    ranked = ranked.join(F.broadcast(starts), ["c", "bin"])
    upto = F.col("before") + F.col("_upto")
    longest = max(len(ranks) for *_, ranks in parts)
    first = last_at_most(F.col("ranks"), upto - F.col("n") - 1, longest)
    past = last_at_most(F.col("ranks"), upto - 1, longest)
    hits = ranked.withColumns({"first": first, "past": past}).filter("past > first")
    # at most two ranks per wanted quantile are left from here on
    got = hits.select(
        "c", "v", F.explode(F.slice("ranks", F.col("first") + 1, F.col("past") - F.col("first"))).alias("rank")
    )
    asked = spark.createDataFrame(targets, schema)
    low = got.select("c", F.col("rank").alias("low"), F.col("v").alias("below"))
    high = got.select("c", F.col("rank").alias("high"), F.col("v").alias("above"))
    met = F.broadcast(asked).join(low, ["c", "low"]).join(F.broadcast(high), ["c", "high"])
    value = F.col("below") + (F.col("above") - F.col("below")) * F.col("part")
    return met.select("column", "p", value.alias("quantile"))


def ks_distance(both: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Largest distance of two distribution functions, from rows (v, a, b) with a + b = 1.

    Within a bin the functions cannot part further than the bin's counts allow, so only
    bins that could beat the largest distance at a bin's end are looked into.
    """
    spark = both.sparkSession
    value = F.col("v")
    bounds = F.struct(F.count(value), F.min(value), F.max(value)).alias("extent")
    found = both.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), bounds).head()
    n_a, n_b = found["a"] or 0, found["b"] or 0
    if not n_a or not n_b:
        return spark.createDataFrame([(n_a, n_b, None)], "n_a bigint, n_b bigint, ks double")
    best, rows = 0.0, n_a + n_b
    if rows <= limits.heavy_rows:
        zero = F.lit(0).cast("bigint")
        opened = both.select("*", F.lit(0).alias("bin"), zero.alias("before_a"), zero.alias("before_b"))
    else:
        (bins,) = bins_for(both, [value], [Extent(*found["extent"])])
        binned = both.withColumn("bin", bins.of(value))
        sums = binned.groupBy("bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).sort("bin").collect()
        ends, a, b = [], 0, 0
        for row in sums:
            highest = (a + row["a"]) / n_a - b / n_b
            lowest = a / n_a - (b + row["b"]) / n_b
            ends.append((row["bin"], a, b, max(abs(highest), abs(lowest)), row["a"] + row["b"]))
            a, b = a + row["a"], b + row["b"]
            best = max(best, abs(a / n_a - b / n_b))
        open_bins = [end for end in ends if end[3] > best]
        rows = sum(end[4] for end in open_bins)
        starts = spark.createDataFrame([end[:3] for end in open_bins], "bin int, before_a bigint, before_b bigint")
        opened = binned.join(F.broadcast(starts), "bin")
    at_value = opened.groupBy("bin", "before_a", "before_b", "v")
    counts = at_value.agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    seen = ordered_scan(counts, ["bin"], ["v"], {"upto_a": "a", "upto_b": "b"}, "sum", limits, rows=rows)
    share_a = (F.col("before_a") + F.col("upto_a")) / F.lit(float(n_a))
    share_b = (F.col("before_b") + F.col("upto_b")) / F.lit(float(n_b))
    gap = F.greatest(F.max(F.abs(share_a - share_b)), F.lit(best))
    return seen.agg(F.lit(n_a).cast("bigint").alias("n_a"), F.lit(n_b).cast("bigint").alias("n_b"), gap.alias("ks"))
