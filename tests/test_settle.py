"""Settlement oldest first and reordered stock, against step-by-step versions, in one window and in pieces."""

import datetime as dt
import random
from collections import Counter

import pytest

from ledgerloom.operators.settle import reordered, settle
from ledgerloom.operators.spread import Limits
from ledgerloom.plans import company as co
from ledgerloom.plans import trading
from ledgerloom.plans.registry import SEED
from tests.conftest import plan, rows

DAY = dt.date(2024, 1, 1)
BOTH = [Limits(), Limits(heavy_rows=9, broadcast_rows=3)]


def day(n):
    return None if n is None else DAY + dt.timedelta(days=n)


def made(seed, n, first):
    r = random.Random(seed)
    amounts = [None, 0, -5, 7, 7, 10, 10, 25, 100]
    return [(first + i, r.choice(["hot", "hot", "hot", "a", "b", None]), r.choice([None, *range(30)]), r.choice(amounts)) for i in range(n)]


def by_hand(invoices, payments):
    def dated(row):
        return (row[2] is not None, row[2] or 0, row[0])

    out = Counter()
    for key in {k for _, k, *_ in invoices + payments}:
        owed = [[i, a] for i, k, _, a in sorted(invoices, key=dated) if k == key and (a or 0) > 0]
        paid = [[i, a] for i, k, _, a in sorted(payments, key=dated) if k == key and (a or 0) > 0]
        while owed and paid:
            step = min(owed[0][1], paid[0][1])
            out[(key, owed[0][0], paid[0][0], step)] += 1
            for queue in (owed, paid):
                queue[0][1] -= step
                if not queue[0][1]:
                    queue.pop(0)
        out.update((key, i, None, a) for i, a in owed)
        out.update((key, None, i, a) for i, a in paid)
    return out


def frames(spark, invoices, payments):
    return (
        spark.createDataFrame([(i, k, day(d), a) for i, k, d, a in invoices], "invoice_id long, who string, due_date date, amount long"),
        spark.createDataFrame([(i, k, day(d), a) for i, k, d, a in payments], "payment_id long, who string, pay_date date, amount long"),
    )


@pytest.mark.parametrize("limits", BOTH)
def test_settle_against_queues(spark, limits):
    for seed, (n, m) in enumerate([(80, 80), (90, 20), (15, 90), (0, 12), (12, 0)]):
        invoices, payments = made(seed, n, 0), made(seed + 50, m, 1000)
        a, b = frames(spark, invoices, payments)
        got = settle(a.repartition(3), b.repartition(4), ["who"], limits=limits).collect()
        assert Counter(tuple(r) for r in got) == by_hand(invoices, payments)


def test_amounts_agree_with_both_sides(spark):
    """One customer with two thirds of all rows, cut into pieces; decimals."""
    invoices, payments = made(7, 400, 0), made(8, 300, 1000)
    a, b = (df.withColumn("amount", df["amount"].cast("decimal(12,2)")) for df in frames(spark, invoices, payments))
    got = settle(a, b, ["who"], limits=Limits(heavy_rows=50))
    for df, key in ((a, "invoice_id"), (b, "payment_id")):
        want = {r[0]: r[1] for r in df.filter("amount > 0").select(key, "amount").collect()}
        assert {r[0]: r[1] for r in got.filter(f"{key} IS NOT NULL").groupBy(key).sum("amount").collect()} == want
    pieces = got.count()
    assert pieces <= 400 + 300 + 2 * 4


def test_no_join_of_invoices_and_payments(spark, capsys):
    a, b = frames(spark, made(1, 50, 0), made(2, 50, 1000))
    settle(a, b, ["who"]).explain()
    assert "Join" not in capsys.readouterr().out


@pytest.mark.parametrize("limits", BOTH)
@pytest.mark.parametrize("floor,lot", [(0, 1), (5, 12), (-3, 7)])
def test_reordered_step_by_step(spark, limits, floor, lot):
    r = random.Random(floor * 100 + lot)
    rows = [(i, r.choice(["hot", "hot", "a", None]), r.choice([None, -9, -4, -1, 0, 3, 20])) for i in range(150)]
    want, level = [], {}
    for i, k, q in rows:
        x = level.get(k, 0) + (q or 0)
        bought = -(-(floor - x) // lot) * lot if x < floor else 0
        level[k] = x + bought
        want.append((i, k, q, bought, level[k]))
    df = spark.createDataFrame(rows, "id long, item string, qty int").repartition(4)
    got = reordered(df, ["item"], ["id"], "qty", floor, lot, limits).collect()
    assert sorted(map(tuple, got), key=lambda t: t[0]) == want
    assert all(t[4] >= floor for t in want)
    assert reordered(df.filter("false"), ["item"], ["id"], "qty", floor, lot, limits).count() == 0


def test_lot_of_nothing(spark):
    with pytest.raises(ValueError, match="lot"):
        reordered(spark.range(1), [], ["id"], "id", lot=0)


def test_settlement_reads_orders_that_were_made_once(spark, folder, tmp_path, capsys):
    spec = co.sized_like(spark, folder)
    kept = co.keep_orders(spark, spec, SEED, f"{tmp_path}/orders")
    made, again = co.build(spark, spec, SEED, kept), co.build(spark, spec, SEED)
    for name in co.OF_ORDERS:
        assert made[name].dtypes == again[name].dtypes and rows(made[name]) == rows(again[name]), name
    for side in trading._accounts(spark, folder):
        text = plan(side, capsys)
        assert "FileScan" in text and "Range (" not in text
