"""Generation operators: dense keys, exact totals, ordered documents, planted defects."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.draws import draw
from ledgerloom.operators import checks as c
from ledgerloom.operators import generate as g
from ledgerloom.operators.imitate import cond_choice, freq, from_quantiles, quantile_grid
from ledgerloom.sources.tables import given
from tests.conftest import plan, rows


@pytest.mark.parametrize("n, parts", [(0, None), (1, None), (1000, 1), (1000, 13)])
def test_spine_is_dense(spark, n, parts):
    assert [r.id for r in g.spine(spark, n, 5, parts).sort("id").collect()] == list(range(5, 5 + n))


def test_big_spines_get_more_parts(spark):
    assert g.spine(spark, 1_000_000_000).rdd.getNumPartitions() == 250


@pytest.mark.parametrize("block", [None, 1, 4, 100])
def test_fanout(spark, block):
    headers = spark.createDataFrame([(1, 3), (2, 0), (3, 9), (4, None), (5, -2)], "k int, n int")
    got = g.fanout(headers, "n", block=block).select("k", "line_no")
    assert rows(got) == sorted([(1, i) for i in range(1, 4)] + [(3, i) for i in range(1, 10)], key=repr)


def test_one_giant_header_is_spread(spark):
    giant = g.fanout(spark.createDataFrame([(1, 100_000)], "k int, n int"), "n", block=1000)
    sizes = giant.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 4 and max(r["count"] for r in sizes) < 50_000


def test_rollup_total_keeps_empty_headers(spark, folder):
    orders = given(spark, folder, "orders").select("o_orderkey")
    lines = given(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    got = g.rollup_total(orders, lines, "o_orderkey", F.col("l_quantity").cast("bigint"))
    assert got.count() == 1500 and got.filter("total = 0").count() == 27
    total = lines.agg(F.sum("l_quantity")).head()[0]
    assert got.agg(F.sum("total")).head()[0] == total


def test_documents_follow_each_other(spark):
    steps = (g.Step("ship", 0.8, (1, 5)), g.Step("bill", 0.5, (0, 0)))
    orders = g.spine(spark, 20_000).withColumn("d", F.lit(dt.date(2020, 1, 1)))
    got = g.document_flow(orders, "d", steps, 3, "t", "id")
    assert got.filter("ship_date IS NULL AND bill_date IS NOT NULL").count() == 0
    assert c.dates_ok(got, F.date_add("d", 1), "ship_date").count() == 0
    assert got.filter("bill_date <> ship_date OR ship_date > date_add(d, 5)").count() == 0
    kept = got.agg(F.count("ship_date"), F.count("bill_date")).head()
    assert kept[0] / 20_000 == pytest.approx(0.8, abs=0.02) and kept[1] / kept[0] == pytest.approx(0.5, abs=0.02)


def test_double_entry_balances(spark):
    lines = spark.createDataFrame([(1, 1, "a", 10), (1, 2, "b", -3), (2, 1, "a", 5)], "doc int, line_no int, acc string, amt int")
    got = g.balance(lines, "doc", "amt", {"acc": F.lit("contra")})
    assert c.balanced(got, "doc", "amt").count() == 0 and c.balanced(lines, "doc", "amt").count() == 2
    assert rows(got.filter("acc = 'contra'")) == [(1, 3, "contra", -7), (2, 2, "contra", -5)]


def test_price_versions_cover_time_without_gap(spark):
    items = spark.createDataFrame([(1, 1000), (2, 500)], "item int, cost int")
    hist = g.price_history(items, "item", 1, "cost", F.lit(dt.date(2020, 1, 1)), 5, 30)
    assert hist.count() == 10 and hist.filter("valid_to IS NULL").count() == 2
    next_row = g.valid_to(hist.drop("valid_to"), ["item"], "valid_from")
    assert rows(next_row.select("item", "valid_from", "valid_to")) == rows(hist.select("item", "valid_from", "valid_to"))
    base = hist.join(items, "item")
    assert base.filter("price < 0.8 * cost - 1 OR price > 1.2 * cost").count() == 0


def test_checks_find_every_planted_defect(spark):
    table = g.spine(spark, 5000).select("id", (F.col("id") % 50).alias("fk"), F.col("id").alias("amount"), F.lit("x").alias("t"))
    spec = g.Defects(nulls={"t": 0.03}, broken_keys={"fk": 0.02}, outliers={"amount": 0.01}, duplicates=0.04)
    got = g.defects(table, spec, 5, "t", "id").cache()
    truth = {k: got.filter(F.col("truth").contains(k)).count() for k in ("null:t", "broken_key:fk", "outlier", "duplicate")}
    assert all(n > 0 for n in truth.values())
    assert c.unique(got, "id").count() == truth["duplicate"]
    parents = spark.range(50).withColumnRenamed("id", "fk")
    assert c.fk_ok(got, parents, "fk").agg(F.sum("n")).head()[0] == truth["broken_key:fk"]
    found = {r.rule: r.violations for r in c.domain(got, [c.not_null("t"), c.in_range("amount", 1, 5000)]).collect()}
    assert found["t is not null"] == truth["null:t"]
    assert found["amount in [1, 5000]"] == got.filter("truth LIKE '%outlier%' AND amount > 5000").count()
    assert rows(got.filter("truth = ''").drop("truth")) == rows(table.join(got.filter("truth = ''").select("id"), "id"))


def test_no_defects_change_nothing(spark):
    table = g.spine(spark, 100)
    got = g.defects(table, g.Defects(), 1, "t", "id")
    assert rows(got.drop("truth")) == rows(table) and got.filter("truth <> ''").count() == 0


def test_sparse_keys_exist_and_null_parents_are_ignored(spark):
    parents = spark.createDataFrame([(k * 7,) for k in range(1, 40)] + [(None,)], "p int")
    children = g.spine(spark, 2000)
    got = g.fk_sparse(children, parents, "p", draw(1, "c", "p", "id"), "p", row_key=["id"])
    assert got.count() == 2000 and c.fk_ok(got, parents, "p").count() == 0
    assert got.select("p").distinct().count() == 39 and got.filter("p IS NULL").count() == 0


def test_smooth_draws_follow_the_grid(spark, folder):
    orders = given(spark, folder, "orders")
    grid = quantile_grid(orders, "o_totalprice", 20)
    made = g.spine(spark, 20_000).select(from_quantiles(draw(1, "q", "q", "id"), grid).alias("o_totalprice"))
    assert c.ks(made, orders, "o_totalprice").head().ks < 0.03


def test_conditional_shares_follow_the_seed(spark, folder):
    orders = given(spark, folder, "orders")
    made = g.spine(spark, 15_000).withColumn("o_orderstatus", F.lit("F"))
    got = cond_choice(made, orders, ["o_orderstatus"], "o_orderpriority", draw(1, "c", "c", "id"), ["id"])
    far = c.tvd(got, orders.filter("o_orderstatus = 'F'"), "o_orderpriority").head()
    assert far.tvd < 0.02 and far.categories == 5


def test_frequencies_add_up(spark, folder):
    shares = freq(given(spark, folder, "orders"), "o_orderstatus")
    assert shares.agg(F.sum("share"), F.sum("n")).head()[:] == (pytest.approx(1.0), 1500)


def test_filters_and_columns_reach_the_scan(spark, folder, capsys):
    parents = given(spark, folder, "customer").filter("c_acctbal > 0")
    text = plan(g.fk_sparse(g.spine(spark, 10), parents, "c_custkey", draw(1, "a", "b", "id"), "c"), capsys)
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThan(c_acctbal,0.0)" in text
    assert "c_name" not in text
