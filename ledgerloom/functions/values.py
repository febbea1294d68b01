"""Values made from draws: numbers, categories, dates, codes and foreign keys.

Everything here is a plain column expression, so it adds no shuffle and stays in the JVM.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable, Sequence
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.draws import ColumnLike, as_col

CASE_LIMIT = 16


def _normal(mean: float = 0.0, sd: float = 1.0) -> Callable[..., Column]:
    # Box-Muller needs two independent draws; 1-u keeps the logarithm away from zero.
    def make(u: Column, v: Column) -> Column:
        radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u))
        return F.lit(mean) + F.lit(sd) * radius * F.cos(F.lit(2.0 * math.pi) * v)

    return make


def _lognormal(mean: float = 0.0, sd: float = 1.0) -> Callable[..., Column]:
    return lambda u, v: F.exp(_normal(mean, sd)(u, v))


DISTRIBUTIONS: dict[str, Callable[..., Callable[..., Column]]] = {
    "uniform": lambda low, high: lambda u: F.lit(float(low)) + u * F.lit(float(high) - float(low)),
    "exponential": lambda rate: lambda u: -F.log(F.lit(1.0) - u) / F.lit(float(rate)),
    "power_law": lambda least, alpha: lambda u: F.lit(float(least))
    * F.pow(F.lit(1.0) - u, F.lit(-1.0 / (alpha - 1.0))),
    "normal": _normal,
    "lognormal": _lognormal,
}


def dist(name: str, *params: float) -> Callable[..., Column]:
    """``dist('normal', 10, 2)(u, v)``: normal and lognormal take two draws, the others one."""
    return DISTRIBUTIONS[name](*params)


def whole(u: Column, low: int, high: int) -> Column:
    """Integer from ``low`` to ``high``, both included."""
    return F.lit(low).cast("bigint") + F.floor(u * F.lit(float(high - low + 1)))


def cumulative(weights: Sequence[float]) -> list[float]:
    """Upper bounds of each weight's share; the last is exactly 1."""
    total = float(sum(weights))
    return [*(part / total for part in list(accumulate(weights))[:-1]), 1.0]


def last_at_most(bounds: Column, value: Column, size: int) -> Column:
    """How many of the sorted array's leading entries are <= ``value`` (binary search)."""
    steps = F.array(*[F.lit(2**p) for p in reversed(range(max(size, 1).bit_length()))])

    def search(key: Column) -> Column:
        return F.aggregate(
            steps,
            F.lit(0),
            lambda at, step: F.when(F.get(bounds, at + step - F.lit(1)) <= key, at + step).otherwise(at),
        )

    # inside a lambda the key is worked out once, not at every step
    return F.get(F.transform(F.array(value), search), 0)


def choice(u: Column, values: Sequence, weights: Sequence[float] | None = None) -> Column:
    """Categorical value by weight.

    Short lists become a CASE, longer ones a binary search in an array literal. Lists that
    live in a table belong in ``operators.imitate.choice_from``.
    """
    bounds = cumulative(weights or [1.0] * len(values))
    if len(values) != len(bounds):
        raise ValueError("choice needs one weight per value")
    if len(values) == 1:
        return F.lit(values[0])
    if len(values) <= CASE_LIMIT:
        case = F.when(u < F.lit(bounds[0]), F.lit(values[0]))
        for value, bound in zip(values[1:-1], bounds[1:-1]):
            case = case.when(u < F.lit(bound), F.lit(value))
        return case.otherwise(F.lit(values[-1]))
    uppers = F.array(*[F.lit(b) for b in bounds[:-1]])
    return F.get(F.array(*[F.lit(v) for v in values]), last_at_most(uppers, u, len(bounds) - 1))


def weekday_slots(start: dt.date, end: dt.date) -> tuple[dt.date, int, int]:
    """(Monday on or before start, weekdays between it and start, weekdays in the period)."""
    skipped = min(start.weekday(), 5)
    monday = start - dt.timedelta(days=start.weekday())
    span = (end - monday).days + 1
    count = span // 7 * 5 + min(span % 7, 5) - skipped
    return monday, skipped, count


def date_draw(u: Column, start: dt.date, end: dt.date, weekdays: bool = False) -> Column:
    """Date from ``start`` to ``end``, both included; Monday to Friday only if ``weekdays``."""
    if not weekdays:
        days = (end - start).days + 1
        return F.date_add(F.lit(start), F.floor(u * F.lit(float(days))).cast("int"))
    monday, skipped, count = weekday_slots(start, end)
    if count < 1:
        raise ValueError("the period holds no weekday")
    slot = (F.floor(u * F.lit(float(count))) + F.lit(skipped)).cast("int")
    return F.date_add(F.lit(monday), F.floor(slot / F.lit(5)).cast("int") * 7 + slot % F.lit(5))


def code(prefix: str, *cols: ColumnLike, width: int = 6) -> Column:
    """Document number such as ``INV-2001-000042``; the last column is zero-padded.

    Numbers longer than ``width`` keep all their digits, so codes stay unique.
    """
    *parts, last = [as_col(c).cast("string") for c in cols]
    padded = F.lpad(last, F.greatest(F.lit(width), F.length(last)), F.lit("0"))
    return F.concat_ws("-", F.lit(prefix), *parts, padded)


def fk(u: Column, n_parent: int, skew: float = 1.0, start: int = 1) -> Column:
    """Key of a dense parent, ``start`` to ``start + n_parent - 1``; ``skew`` > 1 favours low keys.

    Needs no join. The upper clamp covers powers that round up to 1. An empty parent is refused.
    """
    if n_parent < 1:
        raise ValueError("the parent has no keys to draw from")
    spread = u if skew == 1.0 else F.pow(u, F.lit(float(skew)))
    index = F.floor(spread * F.lit(float(n_parent)))
    return F.lit(start).cast("bigint") + F.least(index, F.lit(n_parent - 1).cast("bigint"))


def cents(amount: ColumnLike) -> Column:
    """Money held as a number of units, in whole BIGINT cents."""
    return F.round(as_col(amount) * F.lit(100)).cast("bigint")


def money(in_cents: ColumnLike) -> Column:
    """Whole cents as DECIMAL(18,2)."""
    return (as_col(in_cents).cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,2)")
