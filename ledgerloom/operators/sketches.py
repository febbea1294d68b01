"""Profiles from stored sketches: made once per part of a table, merged for any parts without reading rows again."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.imitate import QUARTILES


@dataclass(frozen=True)
class Accuracy:
    """Sizes of the sketches, which alone decide their errors, whatever the number of rows or merges."""

    log_registers: int = 16  # of a distinct count: 2 to this power
    items: int = 800  # kept by a quantile sketch at its lowest level

    @property
    def distinct_error(self) -> float:
        """Share by which a distinct count may be off: six standard errors of merged sketches.

        At three, one count in some 370 lies beyond, so a profile of a few columns and parts misses now and then.
        """
        return 6 * 1.04 / 2 ** (self.log_registers / 2)

    @property
    def rank_error(self) -> float:
        """Share of all rows by which a quantile's rank may be off: twice the published 99 % bound."""
        return 2 * 2.296 / self.items**0.9723


ACCURACY = Accuracy()


def sketch(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), accuracy: Accuracy = ACCURACY) -> DataFrame:
    """One row per part (the values of ``by``) and column, from one scan: what a profile needs, mergeable.

    Columns: ``by``, column, rows, nulls, min_num, max_num, min_txt, max_txt, mean, m2 (sum of squared
    distances from the mean), hll (distinct values) and kll (quantiles of numbers). Values travel as
    sketches of fixed size, one per task and part; rows are not shuffled.
    """
    none = {kind: F.lit(None).cast(kind) for kind in ("double", "string", "binary")}
    structs = []
    for i, name in enumerate(cols):
        value, kind = F.col(name), df.schema[name].dataType
        number = isinstance(kind, T.NumericType)
        as_num = value.cast("double") + F.lit(0.0)  # -0.0 and 0.0 are one value
        hashed = F.when(value.isNotNull(), F.xxhash64(as_num if isinstance(kind, (T.DoubleType, T.FloatType)) else value))
        parts = {
            "column": F.lit(name),
            "rows": F.count(F.lit(1)),
            "nulls": F.count_if(value.isNull()),
            "min_num": F.min(as_num) if number else none["double"],
            "max_num": F.max(as_num) if number else none["double"],
            "min_txt": none["string"] if number else F.min(value).cast("string"),
            "max_txt": none["string"] if number else F.max(value).cast("string"),
            "mean": F.avg(as_num) if number else none["double"],
            "m2": F.var_pop(as_num) * F.count(value) if number else none["double"],
            "hll": F.hll_sketch_agg(hashed, accuracy.log_registers),
            "kll": F.kll_sketch_agg_double(as_num, accuracy.items) if number else none["binary"],
        }
        structs.append(F.struct(*[made.alias(to) for to, made in parts.items()]).alias(f"_s{i}"))
    grouped = df.groupBy(*by).agg(*structs) if by else df.agg(*structs)
    return grouped.select(*by, F.inline(F.array(*[f"_s{i}" for i in range(len(cols))])))


def merged_profile(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The profile of all rows behind some sketches, as of ``imitate.profile``, per ``by`` and column.

    rows, nulls, bounds, mean and sd are exact; distinct and the quartiles are estimates within the
    errors of the Accuracy that the sketches were made with. Only sketches are read and shuffled.
    """
    keys = [*by, "column"]
    n = (F.col("rows") - F.col("nulls")).cast("double")
    whole = sketches.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"),
        *[F.min(c).alias(c) for c in ("min_num", "min_txt")], *[F.max(c).alias(c) for c in ("max_num", "max_txt")],
        (F.sum(n * F.col("mean")) / F.nullif(F.sum(F.when(F.col("mean").isNotNull(), n)), F.lit(0.0))).alias("mean"),
        F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("distinct"),
        F.kll_merge_agg_double("kll").alias("kll"),
    )
    means = whole.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("mean").alias("_mean"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    away = F.col("mean") - F.col("_mean")
    spread = sketches.join(means, same).groupBy(*keys).agg(F.sum(F.col("m2") + n * away * away).alias("m2"))
    spread = spread.select(*[F.col(k).alias(f"_{k}") for k in keys], "m2")
    counted = F.col("rows") - F.col("nulls")
    known = F.col("mean").isNotNull()
    quartile = {f"q{int(p * 100)}": F.when(known, F.kll_sketch_get_quantile_double("kll", F.lit(p))) for p in QUARTILES}
    return whole.join(spread, same).select(
        *keys, "rows", "nulls", "distinct", "min_num", "max_num", "min_txt", "max_txt", "mean",
        F.when(counted > 1, F.sqrt(F.col("m2") / (counted - 1))).alias("sd"),
        *[value.alias(name) for name, value in quartile.items()],
    )


def store(sketches: DataFrame, path: str, by: Sequence[str]) -> None:
    """Adds sketches of new parts to those in a folder; parts that are there already are replaced."""
    writer = sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*by).parquet(path)
