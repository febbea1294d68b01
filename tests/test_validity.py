"""Sweeps over dated rows against brute force by day, in one window and in pieces."""

import datetime as dt
import random
from collections import Counter

import pytest

from ledgerloom.operators.spread import Limits
from ledgerloom.operators.validity import covered, validity_faults

DAY = dt.date(2024, 1, 1)
SCHEMA = "id long, k string, since date, until date"


def day(n):
    return None if n is None else DAY + dt.timedelta(days=n)


def made(seed, n=120):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        begin = r.choice([None] + list(range(60)) * 3)
        rows.append((i, r.choice(["hot", "hot", "hot", "a", None]), begin, None if r.random() < 0.02 else (begin or 0) + r.choice([-1, 0, 1, 1, 2, 3])))
    return rows


def brute(rows):
    faults, ranges = [], []
    for key in {k for _, k, *_ in rows}:
        own = sorted(((b, 10**6 if e is None else e, i) for i, k, b, e in rows if k == key and b is not None and b < (10**6 if e is None else e)))
        faults += [(i, "empty", 0) for i, k, b, e in rows if k == key and (b is None or (e is not None and b >= e))]
        reached, current = None, None
        for b, e, i in own:
            if reached is not None and reached > b:
                faults.append((i, "overlap", None if min(reached, e) == 10**6 else min(reached, e) - b))
            elif reached is not None and reached < b:
                faults.append((i, "gap", b - reached))
            if reached is None or reached < b:
                current = [key, b, e, 0]
                ranges.append(current)
            current[2], current[3] = max(current[2], e), current[3] + 1
            reached = e if reached is None else max(reached, e)
    return Counter(faults), Counter((k, day(b), None if e == 10**6 else day(e), n) for k, b, e, n in ranges)


@pytest.mark.parametrize("limits", [Limits(), Limits(heavy_rows=9, broadcast_rows=3)])
def test_sweeps_against_brute_force(spark, limits):
    for seed in range(3):
        rows = made(seed)
        df = spark.createDataFrame([(i, k, day(b), day(e)) for i, k, b, e in rows], SCHEMA).repartition(4)
        faults, ranges = brute(rows)
        got = validity_faults(df, ["k"], "since", "until", ["id"], limits).collect()
        assert Counter((r["id"], r["fault"], r["days"]) for r in got) == faults
        assert Counter(tuple(r) for r in covered(df, ["k"], "since", "until", ["id"], limits).collect()) == ranges
    empty = df.filter("false")
    assert validity_faults(empty, ["k"], "since", "until", ["id"], limits).count() == covered(empty, ["k"], "since", "until", ["id"], limits).count() == 0
