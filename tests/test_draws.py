"""Draws and values: fixed by the key alone, and of the right shape."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import values as v
from ledgerloom.functions.draws import draw, text_key
from ledgerloom.operators.generate import spine
from tests.conftest import rows

N = 40_000


@pytest.fixture(scope="module")
def drawn(spark):
    keys = spine(spark, N, parts=4)
    return keys.select("id", draw(1, "t", "u", "id").alias("u"), draw(1, "t", "v", "id").alias("v")).cache()


@pytest.mark.parametrize("method", ["xxhash64", "md5"])
def test_partitions_do_not_matter(spark, method):
    made = [
        rows(spine(spark, 500, parts=p).repartition(p).select("id", draw(3, "t", "c", "id", method=method)))
        for p in (2, 7)
    ]
    assert made[0] == made[1]


def test_streams_differ_by_seed_table_column_and_key(spark):
    one = spark.range(1).select(F.lit(5).alias("k"))
    variants = [draw(1, "a", "b", "k"), draw(2, "a", "b", "k"), draw(1, "c", "b", "k"), draw(1, "a", "d", "k")]
    variants += [draw(1, "a", "b", "k", "k"), draw(1, "a", "b", text_key("k"))]
    assert len(set(one.select(*variants).head())) == len(variants)


def test_key_width_does_not_matter(spark):
    both = spark.range(1).select(draw(1, "a", "b", F.lit(7).cast("int")), draw(1, "a", "b", F.lit(7).cast("bigint")))
    first, second = both.head()
    assert first == second


def test_draws_are_uniform_and_independent(drawn):
    got = drawn.agg(F.avg("u"), F.stddev("u"), F.min("u"), F.max("u"), F.corr("u", "v")).head()
    assert got[0] == pytest.approx(0.5, abs=0.01) and got[1] == pytest.approx(1 / math.sqrt(12), abs=0.01)
    assert 0 <= got[2] and got[3] < 1 and abs(got[4]) < 0.02
    following = drawn.select("id", "u").withColumn("id", F.col("id") + 1).withColumnRenamed("u", "w")
    assert abs(drawn.join(following, "id").agg(F.corr("u", "w")).head()[0]) < 0.02


@pytest.mark.parametrize(
    "name, params, mean, sd",
    [
        ("uniform", (10, 30), 20, 20 / math.sqrt(12)),
        ("exponential", (0.5,), 2, 2),
        ("power_law", (3, 4.5), 3 * 3.5 / 2.5, None),
        ("normal", (100, 15), 100, 15),
        ("lognormal", (1, 0.5), math.exp(1.125), math.exp(1.125) * math.sqrt(math.exp(0.25) - 1)),
    ],
)
def test_distributions(drawn, name, params, mean, sd):
    made = v.dist(name, *params)
    value = made(F.col("u"), F.col("v")) if name in ("normal", "lognormal") else made(F.col("u"))
    got = drawn.agg(F.avg(value), F.stddev(value)).head()
    assert got[0] == pytest.approx(mean, rel=0.02)
    if sd:
        assert got[1] == pytest.approx(sd, rel=0.05)


@pytest.mark.parametrize("size", [1, 2, 16, 17, 60])
def test_choice_follows_weights(drawn, size):
    weights = [float(1 + i % 5) for i in range(size)]
    made = v.choice(F.col("u"), list(range(size)), weights).alias("c")
    got = {r[0]: r[1] for r in drawn.select(made).groupBy("c").count().collect()}
    for i, weight in enumerate(weights):
        share = weight / sum(weights)
        assert got[i] / N == pytest.approx(share, abs=4 * math.sqrt(share / N) + 1e-9)


def test_choice_wants_one_weight_per_value(spark):
    with pytest.raises(ValueError):
        v.choice(F.lit(0.5), ["a", "b"], [1.0])


@pytest.mark.parametrize("first", [dt.date(2001, 3, 5) + dt.timedelta(days=i) for i in range(7)])
@pytest.mark.parametrize("length", [6, 9, 13])
def test_weekdays_cover_exactly_the_weekdays(drawn, first, length):
    last = first + dt.timedelta(days=length)
    days = [first + dt.timedelta(days=i) for i in range(length + 1)]
    got = drawn.select(v.date_draw(F.col("u"), first, last, weekdays=True).alias("d")).distinct().collect()
    assert sorted(r.d for r in got) == [d for d in days if d.weekday() < 5]


def test_weekdays_need_one(spark):
    with pytest.raises(ValueError):
        v.date_draw(F.lit(0.1), dt.date(2001, 3, 10), dt.date(2001, 3, 11), weekdays=True)


def test_dates_include_both_ends(drawn):
    first, last = dt.date(2001, 1, 1), dt.date(2001, 1, 4)
    got = drawn.select(v.date_draw(F.col("u"), first, last).alias("d")).agg(F.min("d"), F.max("d")).head()
    assert tuple(got) == (first, last)


def test_codes_keep_long_numbers_apart(spark):
    got = spark.createDataFrame([(7, 12), (7, 1234567)], "a int, b int").select(v.code("X", "a", "b", width=4))
    assert [r[0] for r in got.collect()] == ["X-7-0012", "X-7-1234567"]


@pytest.mark.parametrize("skew", [1.0, 0.5, 3.0])
def test_foreign_keys_stay_inside(spark, skew):
    edge = spark.createDataFrame([(0.0,), (1 - 2.0**-53,)], "u double")
    got = [r[0] for r in edge.select(v.fk(F.col("u"), 10, skew, start=5)).collect()]
    assert got == [5, 14]


def test_skewed_keys_favour_the_first(drawn):
    got = drawn.groupBy(v.fk(F.col("u"), 100, 2.0).alias("k")).count().collect()
    count = {r.k: r["count"] for r in got}
    assert count[1] / N == pytest.approx(0.1, abs=0.01) and set(count) == set(range(1, 101))


def test_money(spark):
    got = spark.createDataFrame([(12345,), (-5,)], "c bigint").select(v.money("c").cast("string")).collect()
    assert [r[0] for r in got] == ["123.45", "-0.05"]
