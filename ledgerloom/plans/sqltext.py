"""SQL text of the draws and values, for checking this package against another engine.

The 64-bit hash is the published XXH64 of 8-byte values; the engine checked against has no
such function, so it is spelled out in 128-bit arithmetic. A running hash is the seed of the
next key's hash, beginning with 42 and the stream number.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Mapping, Sequence

from ledgerloom.functions.draws import stream_id
from ledgerloom.functions.values import cumulative, weekday_slots

MASK = 2**64 - 1
# fixed values: the five primes of XXH64
PRIMES = (
    0x9E3779B185EBCA87,
    0xC2B2AE3D27D4EB4F,
    0x165667B19E3779F9,
    0x85EBCA77C2B2AE63,
    0x27D4EB2F165667C5,
)


def _times(a: str, b: int) -> str:
    return f"((({a})::UHUGEINT * {b}::UHUGEINT) & {MASK}::UHUGEINT)::UBIGINT"


def _plus(a: str, b: int) -> str:
    return f"((({a})::UHUGEINT + {b}::UHUGEINT) & {MASK}::UHUGEINT)::UBIGINT"


def _named(value: str, use: str) -> str:
    return f"list_transform([{value}], lambda h: {use})[1]"


def _rotated_times(value: str, bits: int, factor: int) -> str:
    rotated = f"(((h & {2 ** (64 - bits) - 1}::UBIGINT) << {bits}) | (h >> {64 - bits}))"
    return _named(value, _times(rotated, factor))


def _fold(value: str, bits: int) -> str:
    return _named(value, f"xor(h, h >> {bits})")


def hash_step(key: str, seed: str) -> str:
    """Hash of one non-negative key, going on from ``seed`` (an unsigned 64-bit expression)."""
    p1, p2, p3, p4, p5 = PRIMES
    mixed = f"xor({_plus(seed, (p5 + 8) & MASK)}, {_rotated_times(_times(key, p2), 31, p1)})"
    mixed = _plus(_rotated_times(mixed, 27, p1), p4)
    mixed = _times(_fold(mixed, 33), p2)
    mixed = _times(_fold(mixed, 29), p3)
    return _fold(mixed, 32)


def _hash_known(value: int, seed: int) -> int:
    """The same hash of a known number."""
    p1, p2, p3, p4, p5 = PRIMES

    def rotate(x: int, bits: int) -> int:
        return (x << bits | x >> (64 - bits)) & MASK

    h = (seed + p5 + 8) & MASK
    h ^= rotate((value & MASK) * p2 & MASK, 31) * p1 & MASK
    h = (rotate(h, 27) * p1 + p4) & MASK
    h = (h ^ h >> 33) * p2 & MASK
    h = (h ^ h >> 29) * p3 & MASK
    return h ^ h >> 32


def num(value: float) -> str:
    """A DOUBLE literal; without an exponent it would be read as DECIMAL."""
    text = repr(float(value))
    return text if "e" in text else f"{text}e0"


def draw(seed: int, table: str, col: str, *keys: str) -> str:
    mixed = f"{_hash_known(stream_id(seed, table, col), 42)}::UBIGINT"
    for key in keys:
        mixed = hash_step(key, mixed)
    return f"(({mixed} >> 11)::DOUBLE * {num(2.0**-53)})"


def draw_md5(seed: int, table: str, col: str, *keys: str) -> str:
    key = "concat_ws(':', " + ", ".join(keys) + ")"
    digest = f"md5(concat_ws('|', '{seed}', '{table}', '{col}', {key}))"
    return f"(('0x' || substr({digest}, 1, 13))::BIGINT * {num(2.0**-52)})"


def whole(u: str, low: int, high: int) -> str:
    return f"({low} + floor({u} * {num(high - low + 1)})::BIGINT)"


def fk(u: str, n: str | int, skew: float = 1.0, start: int = 1) -> str:
    spread = u if skew == 1.0 else f"pow({u}, {num(skew)})"
    return f"({start} + least(floor({spread} * ({n})::DOUBLE)::BIGINT, ({n}) - 1))"


def text(value) -> str:
    return f"'{value}'" if isinstance(value, str) else str(value)


def choice(u: str, values: Sequence, weights: Sequence[float] | None = None) -> str:
    bounds = cumulative(weights or [1.0] * len(values))
    cases = " ".join(f"WHEN {u} < {num(b)} THEN {text(v)}" for v, b in zip(values[:-1], bounds[:-1]))
    return f"(CASE {cases} ELSE {text(values[-1])} END)"


def pick(u: str, weights: Mapping) -> str:
    return choice(u, list(weights), list(weights.values()))


def normal(u: str, v: str, mean: float, sd: float) -> str:
    return f"({num(mean)} + {num(sd)} * sqrt(-2e0 * ln(1e0 - {u})) * cos({num(2 * math.pi)} * {v}))"


def date_draw(u: str, start: dt.date, end: dt.date, weekdays: bool = False) -> str:
    if not weekdays:
        return f"(DATE '{start}' + floor({u} * {num((end - start).days + 1)})::INTEGER)"
    monday, skipped, count = weekday_slots(start, end)
    slot = f"(floor({u} * {num(count)})::INTEGER + {skipped})"
    return f"(DATE '{monday}' + (7 * ({slot} // 5) + {slot} % 5)::INTEGER)"


def code(prefix: str, *cols: str, width: int = 6) -> str:
    *parts, last = [f"({c})::VARCHAR" for c in cols]
    padded = f"lpad({last}, greatest({width}, length({last}))::INTEGER, '0')"
    return f"concat_ws('-', {', '.join([text(prefix), *parts, padded])})"


def day(expr: str) -> str:
    return f"({expr})::DATE::VARCHAR"


def cents(expr: str) -> str:
    return f"round(({expr}) * 100)::BIGINT"
