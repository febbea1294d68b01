"""The forms for heavy keys give what the plain forms give."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions.draws import draw
from ledgerloom.operators import spread as s
from ledgerloom.operators.generate import asof, price_history, spine, valid_to
from ledgerloom.operators.imitate import choice_from, profile, quantiles, resample
from tests.conftest import plan, rows

EARLY = s.Limits(broadcast_rows=3, heavy_rows=40)


@pytest.fixture(scope="module")
def hot(spark):
    """900 rows: one key has half of them, one tenth has no key, the rest are spread out."""
    u = draw(9, "hot", "k", "id")
    key = F.when(u < 0.5, 1).when(u > 0.9, None).otherwise((u * 100).cast("int"))
    date = F.date_add(F.lit(dt.date(2020, 1, 1)), (draw(9, "hot", "d", "id") * 20).cast("int"))
    return spine(spark, 900).select("id", key.alias("k"), date.alias("d"), (F.col("id") % 11 - 5).alias("v")).cache()


def test_heavy_keys_are_found(hot):
    heavy, total = s.heavy_keys(hot, ["k"], EARLY)
    assert total == 900 and {r.k for r in heavy} == {1, None}
    assert s.heavy_keys(hot, ["k"])[0] == []


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(spark, hot, how, capsys):
    small = spark.createDataFrame([(k, f"n{k}") for k in range(1, 70)], "k int, name string")
    split = s.salted_join(hot, small, ["k"], how, ["id"], EARLY)
    assert rows(split.select(*hot.columns)) == rows(hot.join(small, ["k"], how).select(*hot.columns))
    assert "_salt" in plan(split, capsys)


def test_long_text_is_not_broadcast(spark, hot, capsys):
    small = spark.createDataFrame([(k, "n" * 100) for k in range(1, 70)], "k int, name string")
    tight = s.Limits(broadcast_bytes=5_000)
    assert s.fits_broadcast(small, 69) and not s.fits_broadcast(small, 69, tight)
    assert s.fits_broadcast(small.select("k"), 69, tight) and not s.fits_broadcast(small, 200_001)
    assert rows(s.lookup_join(hot, small, ["k"], limits=tight)) == rows(hot.join(small, "k"))


@pytest.mark.parametrize("by", [[], ["k"]])
def test_running_sum(hot, by, capsys):
    split = s.ordered_scan(hot, by, ["d", "id"], {"b": "v"}, limits=EARLY)
    window = Window.partitionBy(*by).orderBy("d", "id").rowsBetween(Window.unboundedPreceding, 0)
    assert rows(split) == rows(hot.withColumn("b", F.sum("v").over(window)))
    assert "_chunk" in plan(split, capsys)
    if by:
        assert "SinglePartition" not in plan(split.select("id", "b"), capsys).split("Subquery")[0]


def test_running_sum_with_a_light_frame(hot):
    light = hot.select("k", "d", "id")
    split = s.dense_number(hot, ["k"], ["d", "id"], "n", EARLY, light)
    assert rows(split) == rows(s.dense_number(hot, ["k"], ["d", "id"], "n"))


def test_dense_numbers_have_no_gap(hot):
    split = s.dense_number(hot, ["k"], ["d", "id"], "n", EARLY)
    got = split.groupBy("k").agg(F.min("n"), F.max("n"), F.count("*"), F.count_distinct("n")).collect()
    assert all(low == 1 and high == size == distinct for _, low, high, size, distinct in got)


def test_ties_within_one_date_are_split_too(spark):
    same = spine(spark, 500).select("id", F.lit(1).alias("k"), F.lit(dt.date(2020, 1, 1)).alias("d"))
    cuts = s.cut_points(same, ["k", "d", "id"], 500, EARLY)
    pieces = s.with_chunk(same, ["k", "d", "id"], cuts).groupBy("_chunk").count().collect()
    assert len(pieces) == len(cuts) + 1 and max(r["count"] for r in pieces) < 250


def test_next(hot):
    dated = hot.select("k", "d").distinct()
    split = valid_to(dated, ["k"], "d", limits=s.Limits(heavy_rows=10))
    assert rows(split) == rows(valid_to(dated, ["k"], "d"))
    assert split.filter("valid_to <= d").count() == 0


@pytest.fixture(scope="module")
def history(spark):
    start = dt.date(2020, 1, 3)
    versions = [(k, start + dt.timedelta(days=3 * i), k * 100 + i) for k in range(0, 80) for i in range(5)]
    return spark.createDataFrame(versions, "k int, since date, price int")


def brute_asof(hot, history):
    known = {}
    for k, since, price in history.collect():
        known.setdefault(k, []).append((since, price))

    def price(k, d):
        return max(((s_, p) for s_, p in known.get(k, []) if s_ <= d), default=(None, None))[1]

    return sorted(((r.id, price(r.k, r.d)) for r in hot.collect()), key=repr)


@pytest.mark.parametrize("limits", [s.LIMITS, EARLY, s.Limits(broadcast_rows=3)])
def test_asof(hot, history, limits):
    got = asof(hot, history, ["k"], "d", "since", ["price"], ["id"], limits)
    assert got.columns == [*hot.columns, "price"]
    assert rows(got.select("id", "price")) == brute_asof(hot, history)


@pytest.mark.parametrize("limits", [s.LIMITS, EARLY])
def test_choice_from_a_table(spark, limits):
    facts = spine(spark, 3000).withColumn("g", (F.col("id") % 3).cast("int"))
    options = [(g, f"v{g}{i}", i) for g in range(2) for i in range(6)]
    table = spark.createDataFrame(options, "g int, v string, w int")
    got = choice_from(facts, table, ["g"], "v", "w", draw(1, "c", "c", "id"), ["id"], limits=limits)
    counts = {(r.g, r.v): r["count"] for r in got.groupBy("g", "v").count().collect()}
    assert counts[(2, None)] == 1000 and (0, "v00") not in counts
    for (g, value), n in counts.items():
        if g < 2:
            assert n / 1000 == pytest.approx(int(value[-1]) / 15, abs=0.05)


def test_resample_takes_rows_of_the_own_group(hot):
    seeds = hot.select("k", F.col("id").alias("from_id"), F.col("v").alias("from_v"))
    got = resample(
        hot.select("id", "k"), seeds, ["k"], ["from_id", "from_v"], ["from_id"], draw(1, "r", "r", "id"), ["id"], EARLY
    )
    plain = resample(
        hot.select("id", "k"), seeds, ["k"], ["from_id", "from_v"], ["from_id"], draw(1, "r", "r", "id"), ["id"]
    )
    assert rows(got.select(*sorted(got.columns))) == rows(plain.select(*sorted(plain.columns)))
    back = hot.select(F.col("id").alias("from_id"), F.col("k").alias("k2"), F.col("v").alias("v2"))
    wrong = got.join(back, "from_id").filter("k <> k2 or from_v <> v2")
    assert got.count() == 900 and wrong.count() == 0


@pytest.mark.parametrize("limits", [s.LIMITS, EARLY])
def test_quantiles_are_exact(spark, hot, limits):
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = {(r["column"], r.p): r.quantile for r in quantiles(hot, ["id", "v", "k"], probs, limits).collect()}
    for name in ("id", "v", "k"):
        want = hot.agg(F.percentile(name, F.array(*[F.lit(p) for p in probs]))).head()[0]
        assert [got[(name, p)] for p in probs] == pytest.approx(want)


@pytest.mark.parametrize("limits", [s.LIMITS, EARLY])
def test_profile(spark, limits):
    big = 2**60
    data = [(big, 1.5, "a", dt.date(2020, 1, 1), None), (big + 1, -0.0, "b", None, None), (big + 1, 0.0, None, None, None)]
    df = spark.createDataFrame(data * 30, "b bigint, f double, s string, d date, e int")
    got = {r["column"]: r for r in profile(df, limits=limits).collect()}
    assert [got[c].distinct for c in "bfsde"] == [2, 2, 2, 1, 0]
    assert [got[c].nulls for c in "bfsde"] == [0, 0, 30, 60, 90]
    assert (got["s"].min_txt, got["s"].max_txt, got["d"].min_txt) == ("a", "b", "2020-01-01")
    assert got["f"].q50 == 0.0 and got["f"].max_num == 1.5 and got["d"].q50 is None and got["e"].q50 is None


def test_estimates_are_near(spark, folder):
    from ledgerloom.sources.tables import given

    orders = given(spark, folder, "orders")
    exact = {r["column"]: r for r in profile(orders).collect()}
    near = {r["column"]: r for r in profile(orders, exact=False).collect()}
    for name, row in exact.items():
        assert near[name].distinct == pytest.approx(row.distinct, rel=0.15)
        assert (near[name].rows, near[name].min_num, near[name].mean) == (row.rows, row.min_num, row.mean)


def test_large_histories_and_scans_are_dealt_out_by_their_rows(spark, capsys):
    # one task holds and multiplies the whole history
    history = spark.range(0, 2_000, 1, 1).select(
        F.col("id").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("since"), (F.col("id") * 3).alias("price")
    )
    facts = spark.range(6_000).select("id", (F.col("id") % 2_100).alias("k"), (F.col("id") % 7).cast("int").alias("d"))
    limits = s.Limits(broadcast_rows=100, task_rows=1_000)
    got = asof(facts, history, ["k"], "d", "since", ["price"], ["id"], limits)
    assert got.rdd.getNumPartitions() == 26
    text = plan(got, capsys)
    # what few tasks make is not grouped before it is dealt out
    dealt = text.split("REPARTITION_BY_NUM")
    assert len(dealt) > 2 and all("HashAggregate" not in below.split("\n+- == Initial")[0] for below in dealt[-1:])
    want = facts.selectExpr("id", "CASE WHEN k < 2000 THEN k * 3 END AS price")
    assert rows(got.select("id", "price")) == rows(want)
    scanned = s.ordered_scan(facts, ["k"], ["id"], {"n": F.lit(1)}, limits=limits)
    assert scanned.rdd.getNumPartitions() == 8  # as many as there are cores, more only if rows need them
    assert rows(scanned) == rows(s.ordered_scan(facts, ["k"], ["id"], {"n": F.lit(1)}))


def test_a_history_is_dealt_out_before_it_is_multiplied_and_not_made_again_to_be_counted(spark, capsys, monkeypatch):
    # one task reads all items
    items = spark.range(0, 500, 1, 1).select(F.col("id").alias("k"), (F.col("id") * 100).alias("cost"))
    start, limits = F.lit(dt.date(2020, 1, 1)), s.Limits(broadcast_rows=100, heavy_rows=3_000, task_rows=700)
    prices = price_history(items, "k", 1, "cost", start, 14, 30, limits)
    made = prices.groupBy(F.spark_partition_id()).count().collect()
    assert len(made) == 10 and max(r["count"] for r in made) < 1_400
    assert rows(prices) == rows(price_history(items, "k", 1, "cost", start, 14, 30))
    assert "REPARTITION" not in plan(price_history(items, "k", 1, "cost", start, 14, 30), capsys)

    told, scan = [], s.ordered_scan
    monkeypatch.setattr(s, "ordered_scan", lambda *args, **named: told.append(named["rows"]) or scan(*args, **named))
    twice = prices.unionByName(prices)  # more history rows than times
    facts = spark.range(3_000).select("id", (F.col("id") % 600).alias("k"), F.expr("date '2020-01-15' + cast(id % 500 as int)").alias("d"))
    got = asof(facts, twice, ["k"], "d", "valid_from", ["price"], ["id"], limits)
    assert told == [3_000 + 14_000]
    assert rows(got) == rows(asof(facts, prices, ["k"], "d", "valid_from", ["price"], ["id"]))
