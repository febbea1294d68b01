"""Behaviour off the test layout: folder tables, restarts, empty parents, ties, kinds of joins."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.values import fk
from ledgerloom.operators.generate import fk_sparse
from ledgerloom.operators.imitate import quantile_grid
from ledgerloom.operators.spread import Limits, asof, lookup_join, salted_join
from ledgerloom.plans.catalog import REGISTERS
from ledgerloom.streaming import feeds
from tests.conftest import rows

STREAMS = ("stream_generate", "stream_window_counts", "stream_dedup")
QUERIES = {name: run for register in REGISTERS for name, run in register.queries.items()}


@pytest.fixture(scope="module")
def foldered(spark, folder, tmp_path_factory):
    target = str(tmp_path_factory.mktemp("tables"))
    for name in ("customer", "orders", "lineitem", "part", "supplier", "events", "nation", "region"):
        spark.read.parquet(f"{folder}/{name}.parquet").repartition(4).write.parquet(f"{target}/{name}.parquet")
    return target


@pytest.mark.parametrize("name", STREAMS)
def test_streams_read_both_layouts(spark, folder, foldered, name):
    assert rows(QUERIES[name](spark, foldered)) == rows(QUERIES[name](spark, folder))


def test_a_stream_goes_on_in_its_folder(spark, foldered, tmp_path):
    feed = feeds.replay(spark, foldered, "orders", files_per_batch=1)
    n = spark.read.parquet(f"{foldered}/orders.parquet").count()
    for _ in range(2):
        assert feeds.run_append(feed, "again", folder=str(tmp_path)).count() == n


def test_no_input_gives_no_rows(spark, tmp_path):
    spark.createDataFrame([], "id long, ts timestamp").write.parquet(str(tmp_path / "t.parquet"))
    feed = feeds.windowed(feeds.replay(spark, str(tmp_path), "t"), "ts", "1 hour", "1 hour", [])
    assert feeds.run_latest(feed, "none", ["window"]).count() == 0


@pytest.mark.parametrize("join", [lookup_join, salted_join])
@pytest.mark.parametrize("how", ["right", "full", "cross"])
def test_kinds_of_joins_that_would_repeat_rows_are_refused(spark, join, how):
    with pytest.raises(ValueError):
        join(spark.range(3), spark.range(3), ["id"], how)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_joins_agree_whatever_the_limits(spark, how):
    big = spark.range(300).select(F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("k"), "id")
    small = spark.createDataFrame([(None, "n"), (1, "a"), (1, "b"), (4, "c"), (99, "d")], "k long, v string")
    low = Limits(broadcast_rows=0, heavy_rows=20, heavy_share=0.01)
    assert rows(lookup_join(big, small, ["k"], how, limits=low)) == rows(lookup_join(big, small, ["k"], how))


def test_ties_in_history_do_not_depend_on_its_size(spark):
    df = spark.createDataFrame([(1, 5, 0), (1, 0, 1)], "k long, ts long, id long")
    hist = spark.createDataFrame([(1, 3, "b"), (1, 3, "c"), (1, 3, "a")], "k long, at long, v string")
    for limits in (Limits(), Limits(broadcast_rows=0), Limits(array_rows=0)):
        got = asof(df, hist, on=["k"], ts="ts", valid_from="at", values=["v"], row_key=["id"], limits=limits)
        assert sorted((r["id"], r["v"]) for r in got.collect()) == [(0, "c"), (1, None)]


def test_empty_parents_and_columns_are_refused(spark):
    empty = spark.createDataFrame([], "k long, v double")
    with pytest.raises(ValueError):
        fk(F.lit(0.5), 0)
    with pytest.raises(ValueError):
        fk_sparse(spark.range(5), empty, "k", F.lit(0.5), "k")
    with pytest.raises(ValueError):
        quantile_grid(empty, "v")
