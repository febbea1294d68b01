"""Joins and ordered scans that stay balanced when one key holds much of the data.

Every size taken here is measured: a side is broadcast only after it was counted, and a
group is split only after its rows were counted. What comes back to the driver is bounded:
at most ``1 / heavy_share`` heavy keys and ``max_chunks`` cut points.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.draws import as_col
from ledgerloom.functions.values import last_at_most


@dataclass(frozen=True)
class Limits:
    """Sizes at which an operator changes its way of working (never its result)."""

    broadcast_rows: int = 200_000  # largest counted side to broadcast
    broadcast_bytes: int = 64 * 2**20  # the same for its text, measured where it has any
    array_rows: int = 4_096  # most history rows of one key to search as an array
    heavy_rows: int = 2_000_000  # groups up to this size go to one task
    task_rows: int = 1_000_000  # rows of many groups dealt to one task
    heavy_share: float = 1e-4  # larger groups are heavy from this share of all rows
    max_chunks: int = 4096  # most pieces the heavy groups are cut into
    max_salts: int = 1024  # most pieces one heavy join key is cut into
    sample_per_chunk: int = 20  # rows looked at per cut point


LIMITS = Limits()


def heavy_keys(
    df: DataFrame, keys: Sequence[str], limits: Limits = LIMITS, rows: int | None = None
) -> tuple[list[Row], int]:
    """Key values too large for one task, as rows of (keys..., _rows), and the total row count.

    A heavy key holds at least ``heavy_share`` of the rows, so there are at most
    ``1 / heavy_share`` of them. Small tables are answered by the count alone.
    """
    total = df.count() if rows is None else rows
    if total <= limits.heavy_rows:
        return [], total
    least = max(limits.heavy_rows, math.ceil(total * limits.heavy_share))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.filter(F.col("_rows") > least).collect(), total


def _heavy_table(df: DataFrame, keys: Sequence[str], heavy: list[Row], extra: str, size) -> DataFrame:
    """The heavy keys as a table of (_k0, _k1, ..., extra), where extra = size(rows)."""
    fields = ", ".join(f"_k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    rows = [(*[r[k] for k in keys], size(r["_rows"])) for r in heavy]
    return df.sparkSession.createDataFrame(rows, f"{fields}, {extra} int")


def _mark(df: DataFrame, keys: Sequence[str], table: DataFrame) -> DataFrame:
    on = [df[k].eqNullSafe(table[f"_k{i}"]) for i, k in enumerate(keys)]
    marked = df.join(F.broadcast(table), on, "left")
    return marked.drop(*[f"_k{i}" for i in range(len(keys))])


HOWS = ("inner", "left", "left_semi", "left_anti")


def _check_how(how: str) -> None:
    if how not in HOWS:
        raise ValueError(f"how must be one of {', '.join(HOWS)}, not {how!r}")


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    row_key: Sequence[str] | None = None,
    limits: Limits = LIMITS,
) -> DataFrame:
    """Equi-join that cuts ``big``'s heavy keys into salted pieces.

    Only the matching rows of ``small`` are repeated, once per piece. ``row_key`` names the
    columns that tell ``big``'s rows apart (all of them by default). The salt comes from a
    hash of those, not from ``rand``, so a task that runs twice sends rows the same way.
    ``how`` must keep no unmatched row of ``small``, which would come out once per piece.
    """
    _check_how(how)
    on = list(on)
    heavy, _ = heavy_keys(big, on, limits)
    if not heavy:
        return big.join(small, on, how)
    pieces = _heavy_table(
        big, on, heavy, "_salts", lambda n: min(limits.max_salts, max(2, math.ceil(n / limits.heavy_rows)))
    )
    salt = F.pmod(F.xxhash64(*[as_col(c) for c in (row_key or big.columns)]), F.coalesce("_salts", F.lit(1)))
    left = _mark(big, on, pieces).withColumn("_salt", salt.cast("int")).drop("_salts")
    right = (
        _mark(small, on, pieces)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - F.lit(1))))
        .drop("_salts")
    )
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def fits_broadcast(df: DataFrame, rows: int, limits: Limits = LIMITS) -> bool:
    """Whether a counted table may be broadcast; columns of open width are measured."""
    if rows > limits.broadcast_rows:
        return False
    fixed = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)
    open_ended = [f.name for f in df.schema.fields if not isinstance(f.dataType, fixed)]
    if not open_ended:
        return True
    text = F.to_json(F.struct(*open_ended))
    return (df.agg(F.sum(F.octet_length(text))).head()[0] or 0) <= limits.broadcast_bytes


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    row_key: Sequence[str] | None = None,
    limits: Limits = LIMITS,
    rows: int | None = None,
) -> DataFrame:
    """Broadcasts ``small`` if its ``rows`` (counted here if not known) allow it, else salts the join.

    ``how`` is one of HOWS, whatever the size.
    """
    _check_how(how)
    if fits_broadcast(small, small.count() if rows is None else rows, limits):
        return big.join(F.broadcast(small), list(on), how)
    return salted_join(big, small, on, how, row_key, limits)


def sample_share(total: int, limits: Limits = LIMITS) -> float:
    """Share of ``total`` rows that is enough to place the cut points."""
    return min(1.0, _parts(total, limits) * limits.sample_per_chunk / max(total, 1))


def _parts(total: int, limits: Limits) -> int:
    return min(limits.max_chunks, max(2, math.ceil(total / limits.heavy_rows)))


def cut_points(
    df: DataFrame, cols: Sequence[str], total: int, limits: Limits = LIMITS, sampled: bool = False
) -> list[Row]:
    """Sorted values of ``cols`` that cut ``total`` rows into ranges of about ``heavy_rows``.

    A sample (of ``df``, or ``df`` itself if it is ``sampled``) decides where to cut and
    nothing else: whatever the cuts, every row falls between two of them and is kept.
    """
    parts, share = _parts(total, limits), sample_share(total, limits)
    seen = df.select(*cols)
    if not sampled and share < 1.0:
        seen = seen.sample(fraction=share, seed=7)
    ordered = seen.sort(*cols).collect()
    picked = [ordered[i * len(ordered) // parts] for i in range(1, parts)] if ordered else []
    return list(dict.fromkeys(picked))


def spread_small(df: DataFrame, rows: int, limits: Limits = LIMITS) -> DataFrame:
    """Deals a counted, small table out to all cores; it often lies in a single file.

    Tables past ``heavy_rows`` have enough files and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if rows <= limits.heavy_rows else df


def in_tasks(df: DataFrame, keys: Sequence[str], rows: int, limits: Limits = LIMITS) -> DataFrame:
    """Deals a counted table out by ``keys``, ``task_rows`` or less to a task on average.

    Left to itself, the number of tasks follows from a setting and from compressed bytes, and
    what a task holds grows with the table. Tables that one task holds are left as they are.
    """
    if rows <= limits.task_rows or not keys:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, math.ceil(rows / limits.task_rows)), *keys)


def with_chunk(df: DataFrame, cols: Sequence[str], cuts: Sequence[Row]) -> DataFrame:
    """Adds ``_chunk``: how many cut points are at or below the row's ``cols``, read left to right."""
    # one value for the whole query: the cut points as a sorted array
    points = df.sparkSession.createDataFrame(list(cuts), df.select(*cols).schema)
    bounds = points.agg(F.sort_array(F.collect_list(F.struct(*cols)))).scalar()
    found = last_at_most(F.col("_bounds"), F.struct(*cols), len(cuts))
    return df.withColumn("_bounds", bounds).withColumn("_chunk", found).drop("_bounds")


# How a scan works inside a piece, what a piece passes on, and how both are put together.
_FOLDS = {
    "sum": (
        lambda v, w, _: F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        lambda v, _: F.sum(v),
        lambda t, w: F.sum(t).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        lambda here, other: F.coalesce(here + other, here, other),
    ),
    "last": (
        lambda v, w, _: F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        lambda v, order: F.max_by(v, F.when(v.isNotNull(), order)),
        lambda t, w: F.last(t, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        lambda here, other: F.coalesce(here, other),
    ),
    "max_before": (
        lambda v, w, _: F.max(v).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        lambda v, _: F.max(v),
        lambda t, w: F.max(t).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        lambda here, other: F.greatest(here, other),
    ),
    "next": (
        lambda v, w, _: F.lead(v).over(w),
        lambda v, order: F.min_by(v, order),
        lambda t, w: F.lead(t).over(w),
        lambda here, other: F.coalesce(here, other),
    ),
}


def ordered_scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    outs: Mapping[str, Column | str],
    kind: str = "sum",
    limits: Limits = LIMITS,
    cuts: Sequence[Row] | None = None,
    light: DataFrame | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Adds running values over ``by`` groups in ascending ``order``.

    ``outs`` maps new columns to what runs through them. Kinds: ``sum`` up to and with the
    row, ``last`` non-null value up to and with the row, ``max_before`` the row, ``next`` row's value.
    ``order`` has to be unique within a group for the result to be fixed.

    Groups that fit a task use one window. Heavy groups (``by=[]`` is one group) are cut
    into ranges of the order columns: a window within each range, one total per range, a
    window over the totals, and a join of the two. ``cuts`` skips the detection and cuts
    every group at the given points. ``light`` may name a cheaper frame with the same rows
    that has at least ``by``, ``order`` and what runs; counts and totals are then taken of it.
    ``rows`` is the number of rows or more, where it is known. Tasks take as many rows each, however many there are.
    """
    by, order = list(by), list(order)
    inside, combine_totals, before, together = _FOLDS[kind]
    outs = {name: as_col(value) for name, value in outs.items()}
    sort_key = F.struct(*order)
    light = df if light is None else light
    marks: DataFrame | None = None  # the heavy groups, if only some are
    heavy: list[Row] = []
    if cuts is None and by:
        heavy, rows = heavy_keys(light, by, limits, rows)
        if heavy:
            marks = _heavy_table(light, by, heavy, "_heavy", lambda n: 1)
            held = sum(r["_rows"] for r in heavy)
            cuts = cut_points(_mark(light, by, marks).filter("_heavy = 1"), [*by, *order], held, limits)
    elif cuts is None:
        rows = light.count() if rows is None else rows
        cuts = cut_points(light, order, rows, limits) if rows > limits.heavy_rows else None

    if not cuts:
        window = Window.partitionBy(*by).orderBy(*order)
        return in_tasks(df, by, rows or 0, limits).select("*", *[inside(v, window, sort_key).alias(n) for n, v in outs.items()])

    def cut(frame: DataFrame, heavy_only: bool) -> DataFrame:
        if marks is None:
            return with_chunk(frame, [*by, *order], cuts)
        marked = _mark(frame, by, marks)
        if heavy_only:
            return with_chunk(marked.filter("_heavy = 1"), [*by, *order], cuts)
        chunked = with_chunk(marked, [*by, *order], cuts)
        return chunked.withColumn("_chunk", F.when(F.col("_heavy") == 1, F.col("_chunk")).otherwise(-1)).drop("_heavy")

    pieces = in_tasks(cut(df, heavy_only=False), [*by, "_chunk"], rows or 0, limits)
    totals = cut(light, heavy_only=True).groupBy(*by, "_chunk").agg(
        *[combine_totals(v, sort_key).alias(f"_t_{n}") for n, v in outs.items()]
    )
    along = Window.partitionBy(*by).orderBy("_chunk")
    carried = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)],
        F.col("_chunk").alias("_c"),
        *[before(F.col(f"_t_{n}"), along).alias(f"_t_{n}") for n in outs],
    )
    # Every cut starts one more piece at most, so groups + cuts bounds the totals.
    groups = len(heavy) if by else 1
    if groups and groups + len(cuts) <= limits.broadcast_rows:
        carried = F.broadcast(carried)
    window = Window.partitionBy(*by, "_chunk").orderBy(*order)
    local = pieces.select("*", *[inside(v, window, sort_key).alias(f"_l_{n}") for n, v in outs.items()])
    on = [local[k].eqNullSafe(carried[f"_k{i}"]) for i, k in enumerate(by)]
    joined = local.join(carried, [*on, local["_chunk"] == carried["_c"]], "left")
    return joined.select(*df.columns, *[together(F.col(f"_l_{n}"), F.col(f"_t_{n}")).alias(n) for n in outs])


def dense_number(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    out: str,
    limits: Limits = LIMITS,
    light: DataFrame | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Gap-free numbers 1, 2, 3, ... within each group, such as legal invoice numbers per year."""
    return ordered_scan(df, by, order, {out: F.lit(1).cast("bigint")}, "sum", limits, light=light, rows=rows)


def asof(
    df: DataFrame,
    hist: DataFrame,
    on: Sequence[str],
    ts: str,
    valid_from: str,
    values: Sequence[str],
    row_key: Sequence[str],
    limits: Limits = LIMITS,
) -> DataFrame:
    """Adds to each row the ``values`` of its key's latest history row with valid_from <= ts.

    A counted, small history is sent out as one sorted array per key and searched in place:
    no shuffle of ``df``. Otherwise both sides are put in one time line per key and the last
    history row is carried on, so the work grows with rows plus versions, never with their
    product; keys that hold many rows are scanned in pieces. ``row_key`` tells the rows of
    ``df`` apart; of history rows at one time the
    greatest values count. Rows before the first
    version, and rows whose key or time is null, get nulls.
    """
    on = list(on)
    at_type = df.schema[ts].dataType
    hist = hist.filter(F.col(valid_from).isNotNull()).select(
        *on, F.col(valid_from).cast(at_type).alias("_from"), F.struct(*values).alias("_found")
    )
    rows, most = hist.count(), None
    small = fits_broadcast(hist, rows, limits)
    # of equal times the greatest values; a large history is dealt out first, as one small file may hold or make it
    hist = in_tasks(hist, [*on, "_from"], rows, limits).groupBy(*on, "_from").agg(F.max("_found").alias("_found"))
    if small:
        most = hist.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).head()[0] or 0
    if small and most <= limits.array_rows:
        parts = F.sort_array(F.collect_list(F.struct("_from", "_found"))).alias("_parts")
        # two plain arrays: a field of an array of structs would be copied out at every step
        begins, founds = F.col("_parts._from").alias("_begins"), F.col("_parts._found").alias("_founds")
        if on:
            joined = df.join(F.broadcast(hist.groupBy(*on).agg(parts).select(*on, begins, founds)), on, "left")
        else:
            listed = hist.agg(parts)
            joined = df.withColumns(
                {"_begins": listed.select(begins).scalar(), "_founds": listed.select(founds).scalar()}
            )
        found = F.get("_founds", last_at_most(F.col("_begins"), F.col(ts), max(most, 1)) - F.lit(1))
        return joined.withColumn("_last", found).select(*df.columns, *[F.col("_last")[v].alias(v) for v in values])

    keys = [f"_r{i}" for i in range(len(row_key))]
    ordering = {ts: "_at", **dict(zip(row_key, keys))}  # columns that travel under the names they sort by
    carried = [c for c in df.columns if c not in (*on, *ordering)]
    facts = df.select(
        *on,
        F.lit(1).alias("_side"),
        *[F.col(c).alias(name) for c, name in ((ts, "_at"), *zip(row_key, keys))],
        F.struct(*carried).alias("_rest") if carried else F.lit(None).alias("_rest"),
    )
    dated = hist.withColumn("_side", F.lit(0)).withColumnRenamed("_from", "_at")
    line = facts.unionByName(dated, allowMissingColumns=True)
    # history rows of one time are counted apart, so that the history is not made and grouped again for a number
    seen = ordered_scan(
        line, on, ["_at", "_side", *keys], {"_last": "_found"}, "last", limits, rows=df.count() + rows
    )
    known = F.lit(True)
    for k in [*on, "_at"]:
        known = known & F.col(k).isNotNull()

    def back(name: str) -> Column:
        if name in on:
            return F.col(name)
        return F.col(ordering[name]) if name in ordering else F.col("_rest")[name]

    return seen.filter(F.col("_side") == 1).select(
        *[back(c).alias(c) for c in df.columns], *[F.when(known, F.col("_last")[v]).alias(v) for v in values]
    )
