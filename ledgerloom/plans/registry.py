"""What the registered queries share: the seed, the register, and result columns both engines spell alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.draws import ColumnLike, as_col

SEED = 20240229

Query = Callable[[SparkSession, str], DataFrame]


class Register:
    """Queries and, where it can be said in SQL, the statement that gives the same rows."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(run: Query) -> Query:
            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return run

        return keep


def day(value: ColumnLike) -> Column:
    """A date as ISO text."""
    return as_col(value).cast("date").cast("string")


def rounded(value: ColumnLike, places: int = 6) -> Column:
    """Engines differ in a double's last digit, and in how they show a negative zero."""
    return F.round(as_col(value), places) + F.lit(0.0)
