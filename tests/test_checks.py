"""Checks against facts known of the given tables, and distances against their definitions."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import checks as c
from ledgerloom.operators import reports as r
from ledgerloom.operators.spread import Limits
from ledgerloom.sources.tables import given
from tests.conftest import rows


def test_known_facts_of_the_given_tables(spark, folder):
    lines, orders = given(spark, folder, "lineitem"), given(spark, folder, "orders")
    surplus = c.unique(lines, "l_orderkey", "l_linenumber").agg(F.sum(F.col("n") - 1)).head()[0]
    assert surplus == 1401
    assert c.unique(orders, "o_orderkey").count() == 0
    assert c.fk_ok(lines, orders, "l_orderkey", "o_orderkey").count() == 0
    assert c.fk_ok(orders, lines, "o_orderkey", "l_orderkey").count() == 27
    parents = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    assert c.dates_ok_between(lines, parents, ["l_orderkey"], "o_orderdate", "l_shipdate").count() == 2815


def test_orphan_rows(spark):
    child = spark.createDataFrame([(1, 1), (2, 9), (3, 9), (4, None)], "id int, k int")
    parent = spark.createDataFrame([(1,), (None,)], "k int")
    assert rows(c.fk_ok(child, parent, "k")) == [(9, 2)]
    assert rows(c.orphans(child, parent, "k").select("id")) == [(2,), (3,)]
    split = c.orphans(child, parent, "k", row_key=["id"], limits=Limits(broadcast_rows=0, heavy_rows=1))
    assert rows(split.select("id")) == [(2,), (3,)]


def test_nulls_break_only_their_own_rule(spark):
    df = spark.createDataFrame([(None, "a"), (5, "z"), (50, None)], "n int, s string")
    got = {x.rule: x.violations for x in c.domain(df, [c.not_null("n"), c.in_range("n", 0, 9), c.one_of("s", "a")]).collect()}
    assert got == {"n is not null": 1, "n in [0, 9]": 1, "s in (a)": 1}


def test_headers_and_lines_missing_on_either_side(spark):
    header = spark.createDataFrame([(1, 10), (2, 5), (3, 7)], "k int, total int")
    lines = spark.createDataFrame([(1, 4), (1, 6), (2, 4), (4, 2)], "k int, amount int")
    assert rows(c.header_matches(header, lines, "k", "total", "amount")) == [(2, 1), (3, 7), (4, -2)]


@pytest.mark.parametrize("limits", [Limits(), Limits(heavy_rows=30)])
def test_ks_of_known_samples(spark, limits):
    a = spark.range(100).select(F.col("id").cast("double").alias("x"))
    b = spark.range(50, 150).select(F.col("id").cast("double").alias("x"))
    assert tuple(c.ks(a, b, "x", limits).head()) == (100, 100, pytest.approx(0.5))
    assert c.ks(a, a, "x", limits).head().ks == 0
    with_nulls = a.unionByName(spark.createDataFrame([(None,)] * 40, "x double"))
    assert tuple(c.ks(with_nulls, b, "x", limits).head()) == (100, 100, pytest.approx(0.5))


def test_tvd_of_known_shares(spark):
    a = spark.createDataFrame([("x",)] * 6 + [("y",)] * 4, "v string")
    b = spark.createDataFrame([("x",)] * 5 + [("z",)] * 3 + [(None,)] * 2, "v string")
    got = c.tvd(a, b, "v").head()
    assert got.tvd == pytest.approx(0.5) and got.categories == 4
    assert got.chi_square == pytest.approx((6 - 5) ** 2 / 5 + 3 + 2)


def test_correlation_gap(spark):
    a = spark.range(50).select(F.col("id").alias("x"), (F.col("id") * 2).alias("y"))
    b = spark.range(50).select(F.col("id").alias("x"), (-F.col("id")).alias("y"))
    got = c.corr_gap(a, b, ["x", "y"]).head()
    assert (got.r_a, got.r_b, got.gap) == (pytest.approx(1), pytest.approx(-1), pytest.approx(2))


def test_copies_match_nulls(spark):
    made = spark.createDataFrame([(1, None), (1, None), (2, "b"), (3, "c")], "a int, b string")
    real = spark.createDataFrame([(1, None), (3, "c"), (3, "c"), (4, "d")], "a int, b string")
    assert rows(c.copies(made, real, ["a", "b"])) == [(1, None, 2), (3, "c", 1)]


def test_trial_balance(spark):
    journal = spark.createDataFrame([("a", 1, 10), ("a", 1, -4), ("a", 2, 1), ("b", 1, -7)], "acc string, m int, amount int")
    got = {(x.acc, x.m, x.depth): (x.debit, x.credit, x.balance) for x in r.trial_balance(journal, ["acc", "m"]).collect()}
    assert got[(None, None, 0)] == (11, 11, 0) and got[("a", None, 1)] == (11, 4, 7)
    assert got[("a", 1, 2)] == (10, 4, 6) and got[("b", 1, 2)] == (0, 7, -7) and len(got) == 6


def test_ageing(spark):
    owed = spark.createDataFrame(
        [(1, "c", "2024-01-31", 100), (2, "c", "2024-01-01", 50), (3, "c", "2023-12-01", 70), (4, "d", "2023-01-01", 9)],
        "invoice_id int, cust string, due string, amount int",
    ).withColumn("due_date", F.to_date("due"))
    paid = spark.createDataFrame([(2, 20), (2, 5), (3, 70)], "invoice_id int, amount int")
    got = {x.cust: x.asDict() for x in r.ageing(owed, paid, F.to_date(F.lit("2024-01-31")), ["cust"]).collect()}
    assert (got["c"]["not_due"], got["c"]["d1_30"], got["c"]["d31_60"], got["c"]["open"]) == (100, 25, 0, 125)
    assert got["d"]["over_90"] == 9
