"""Seeded draws: numbers in [0, 1) fixed by (seed, table, column, key).

A draw depends on the row's key and nothing else, never on its partition or position, so a
re-run task makes the same rows, and a child table can recompute a parent's values from the
foreign key instead of joining back to it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def stream_id(seed: int, table: str, col: str) -> int:
    """64-bit number naming one column's stream of draws."""
    digest = hashlib.md5(f"{seed}|{table}|{col}".encode()).digest()
    return int.from_bytes(digest[:8], "big", signed=True)


def text_key(*cols: ColumnLike) -> Column:
    """Turns text (or mixed) columns into a BIGINT that ``draw`` accepts as a key."""
    return F.xxhash64(*[as_col(c) for c in cols])


def draw(seed: int, table: str, col: str, *keys: ColumnLike, method: str = "xxhash64") -> Column:
    """Uniform double in [0, 1).

    ``xxhash64`` has 53 bits and stays inside generated code. ``md5`` has 52 bits, costs
    over ten times more, and is for exchange with systems that offer no other hash.
    """
    whole = [as_col(k).cast("bigint") for k in keys]
    if method == "xxhash64":
        mixed = F.xxhash64(F.lit(stream_id(seed, table, col)).cast("bigint"), *whole)
        return F.shiftrightunsigned(mixed, 11) * F.lit(2.0**-53)
    if method == "md5":
        key = F.concat_ws(":", *[k.cast("string") for k in whole])
        digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(table), F.lit(col), key))
        return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") * F.lit(2.0**-52)
    raise ValueError(f"unknown draw method {method!r}")
