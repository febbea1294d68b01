"""Registered queries that measure the given tables and draw values that look like them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.draws import draw
from ledgerloom.functions.values import fk
from ledgerloom.operators import checks as c
from ledgerloom.operators import imitate as im
from ledgerloom.operators import sketches as sk
from ledgerloom.operators.alias import alias_choice, alias_table
from ledgerloom.operators.spread import Limits
from ledgerloom.plans import sqltext as q
from ledgerloom.plans.registry import SEED, Register, rounded
from ledgerloom.session import work_dir
from ledgerloom.sources.tables import given

register = Register()


def _u(col: str, *keys: str):
    return draw(SEED, "imitate", col, *keys)


def _s(col: str, *keys: str) -> str:
    return q.draw(SEED, "imitate", col, *keys)


# column -> True if it is a number
PROFILED = {
    "l_orderkey": True,
    "l_partkey": True,
    "l_linenumber": True,
    "l_quantity": True,
    "l_extendedprice": True,
    "l_discount": True,
    "l_returnflag": False,
    "l_shipdate": False,
}


def _profile_sql(table: str, cols: dict[str, bool]) -> str:
    parts = []
    for name, number in cols.items():
        if number:
            own = f"""min({name})::DOUBLE + 0e0 AS min_num, max({name})::DOUBLE + 0e0 AS max_num,
                   NULL::VARCHAR AS min_txt, NULL::VARCHAR AS max_txt,
                   round(avg({name}), 7) AS mean, round(stddev_samp({name}), 6) AS sd,
                   round(quantile_cont({name}::DOUBLE, 0.25), 6) + 0e0 AS q25,
                   round(quantile_cont({name}::DOUBLE, 0.5), 6) + 0e0 AS q50,
                   round(quantile_cont({name}::DOUBLE, 0.75), 6) + 0e0 AS q75"""
        else:
            own = f"""NULL::DOUBLE, NULL::DOUBLE, min({name})::VARCHAR, max({name})::VARCHAR,
                   NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE"""
        parts.append(
            f"""SELECT '{name}' AS "column", count(*) AS rows, count(*) - count({name}) AS nulls,
                   count(DISTINCT {name}) AS "distinct", {own} FROM {table}"""
        )
    return " UNION ALL ".join(parts)


def _shown(profiled: DataFrame) -> DataFrame:
    # means of cents end in exact halves of the sixth place, so those show a seventh
    places = {"mean": 7, "sd": 6, "q25": 6, "q50": 6, "q75": 6}
    return profiled.select(*[rounded(n, places[n]).alias(n) if n in places else F.col(n) for n in profiled.columns])


@register.add("table_profile", _profile_sql("lineitem", PROFILED))
def table_profile(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(im.profile(given(spark, folder, "lineitem"), list(PROFILED)))


@register.add("table_profile_split", _profile_sql("lineitem", PROFILED))
def table_profile_split(spark: SparkSession, folder: str) -> DataFrame:
    """The same with ranks taken in pieces."""
    return _shown(im.profile(given(spark, folder, "lineitem"), list(PROFILED), limits=Limits(heavy_rows=10_000)))


SPLIT_YEAR = 1995  # shipped in this year or before: one of the two sets of parts


def _estimated_sql() -> str:
    parts = []
    for name, number in PROFILED.items():
        num = f"min({name})::DOUBLE + 0e0, max({name})::DOUBLE + 0e0, NULL::VARCHAR, NULL::VARCHAR"
        txt = f"NULL::DOUBLE, NULL::DOUBLE, min({name})::VARCHAR, max({name})::VARCHAR"
        shown = f"round(avg({name}), 5), round(stddev_samp({name}), 5), true" if number else "NULL::DOUBLE, NULL::DOUBLE, NULL::BOOLEAN"
        parts.append(f"""SELECT years, '{name}', count(*), count(*) - count({name}), {num if number else txt}, {shown}, true
                         FROM l GROUP BY 1""")
    names = ["years", '"column"', "rows", "nulls", "min_num", "max_num", "min_txt", "max_txt", "mean", "sd", "ranks_within", "distinct_within"]
    return f"""
    WITH l AS (
        SELECT *, 'all' AS years FROM lineitem
        UNION ALL SELECT *, 'first' FROM lineitem WHERE year(l_shipdate) <= {SPLIT_YEAR}),
    p({', '.join(names)}) AS ({' UNION ALL '.join(parts)})
    SELECT * FROM p
    """


@register.add("table_profile_approx", _estimated_sql())
def table_profile_approx(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles of all years and of the first ones from sketches stored per year: exact columns, and
    whether distinct counts and quartiles lie within the error that the sketches state.

    What they are held against is counted from the rows; the profile itself reads no row twice.
    """
    lines = given(spark, folder, "lineitem").select(*PROFILED).withColumn("year", F.year("l_shipdate"))
    path = work_dir(spark, "sketches")
    for late in (F.col("year") > SPLIT_YEAR, F.col("year") <= SPLIT_YEAR):  # the parts may come in any order
        sk.store(sk.sketch(lines.filter(late), list(PROFILED), ["year"]), path, ["year"])
    stored = spark.read.parquet(path)
    sets = F.when(F.col("year") <= SPLIT_YEAR, F.array(F.lit("all"), F.lit("first"))).otherwise(F.array(F.lit("all")))
    profile = _made(sk.merged_profile(stored.withColumn("years", F.explode(sets)), ["years"]))
    return profile.join(_within(lines.withColumn("sets", sets), profile), ["years", "column"]).select(
        "years", "column", "rows", "nulls", "min_num", "max_num", "min_txt", "max_txt",
        rounded("mean", 5).alias("mean"), rounded("sd", 5).alias("sd"), "ranks_within", "distinct_within",
    )


def _made(profile: DataFrame) -> DataFrame:
    """The estimates, once made: a row per column and set of parts."""
    rows = profile.collect()
    return profile.sparkSession.createDataFrame(rows, profile.schema)


def _within(rows: DataFrame, profile: DataFrame) -> DataFrame:
    """(years, column, ranks_within, distinct_within): the estimates against counts of the rows, from two scans."""
    found = profile.collect()
    tests, error = [], F.lit(sk.ACCURACY.rank_error)
    for r in found:
        own, value = F.array_contains("sets", r["years"]), F.col(r["column"])
        quartiles = [(p, r[f"q{int(p * 100)}"]) for p in im.QUARTILES]
        total = F.count(F.when(own, value))
        near = [
            (F.count_if(own & (value < q)) / total <= p + error) & (F.count_if(own & (value <= q)) / total >= p - error)
            for p, q in quartiles
            if q is not None
        ]
        tests.append(reduce(lambda a, b: a & b, near) if near else F.lit(None).cast("boolean"))
    wide = rows.agg(*[t.alias(f"t{i}") for i, t in enumerate(tests)])
    names = [F.struct(F.lit(r["years"]).alias("years"), F.lit(r["column"]).alias("column"), F.col(f"t{i}").alias("ranks_within")) for i, r in enumerate(found)]
    ranks = wide.select(F.inline(F.array(*names)))
    hashed = [F.struct(F.lit(n).alias("column"), F.when(F.col(n).isNotNull(), F.xxhash64(n)).alias("h")) for n in PROFILED]
    values = rows.select("sets", F.inline(F.array(*hashed))).filter("h IS NOT NULL").select("column", "h", F.explode("sets").alias("years"))
    exact = values.distinct().groupBy("years", "column").agg(F.count(F.lit(1)).alias("exact"))
    off = F.abs(F.col("exact") - F.col("distinct")) <= F.lit(sk.ACCURACY.distinct_error) * F.col("exact") + 0.5
    counted = profile.select("years", "column", "distinct").join(exact, ["years", "column"], "left")
    return ranks.join(counted.select("years", "column", off.alias("distinct_within")), ["years", "column"])


@register.add(
    "category_freq",
    """
    SELECT o_orderstatus, o_orderpriority, count(*) AS n,
           round(count(*)::DOUBLE / (SELECT count(*) FROM orders), 9) AS share
    FROM orders GROUP BY 1, 2
    """,
)
def category_freq(spark: SparkSession, folder: str) -> DataFrame:
    shares = im.freq(given(spark, folder, "orders"), "o_orderstatus", "o_orderpriority")
    return shares.withColumn("share", rounded("share", 9))


_RESAMPLE_SQL = f"""
    WITH s AS (
        SELECT o_orderpriority, o_custkey, o_totalprice,
               row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS pos,
               count(*) OVER (PARTITION BY o_orderpriority) AS size
        FROM orders),
    d AS (
        SELECT o_orderkey, o_orderpriority,
               1 + floor({_s('resample', 'o_orderkey')} * count(*) OVER (PARTITION BY o_orderpriority))::BIGINT AS pick
        FROM orders)
    SELECT o_orderkey, d.o_orderpriority, s.o_custkey, s.o_totalprice
    FROM d JOIN s ON d.o_orderpriority = s.o_orderpriority AND pick = pos
    """


def _resampled(spark: SparkSession, folder: str, **options) -> DataFrame:
    orders = given(spark, folder, "orders")
    seeds = orders.select("o_orderkey", "o_orderpriority", "o_custkey", "o_totalprice")
    return im.resample(
        orders.select("o_orderkey", "o_orderpriority"),
        seeds,
        ["o_orderpriority"],
        ["o_custkey", "o_totalprice"],
        ["o_orderkey"],
        _u("resample", "o_orderkey"),
        ["o_orderkey"],
        **options,
    )


@register.add("resample_grouped", _RESAMPLE_SQL)
def resample_grouped(spark: SparkSession, folder: str) -> DataFrame:
    return _resampled(spark, folder)


@register.add("resample_grouped_split", _RESAMPLE_SQL)
def resample_grouped_split(spark: SparkSession, folder: str) -> DataFrame:
    """Five groups of a fifth of all rows each, numbered in pieces and joined with salt."""
    return _resampled(spark, folder, limits=Limits(broadcast_rows=4, heavy_rows=1_000))


STEPS = 50


@register.add(
    "resample_quantile",
    f"""
    WITH g AS (SELECT quantile_cont(o_totalprice, [{', '.join(str(i / STEPS) for i in range(STEPS + 1))}]) AS q
               FROM orders),
    d AS (SELECT o_orderkey, {_s('quantile', 'o_orderkey')} * {q.num(STEPS)} AS place FROM orders),
    e AS (SELECT o_orderkey, place, least(floor(place)::BIGINT, {STEPS - 1}) AS pos FROM d)
    SELECT o_orderkey, round(q[pos + 1] + (q[pos + 2] - q[pos + 1]) * (place - pos), 4) AS price FROM e, g
    """,
)
def resample_quantile(spark: SparkSession, folder: str) -> DataFrame:
    orders = given(spark, folder, "orders")
    grid = im.quantile_grid(orders, "o_totalprice", STEPS)
    price = im.from_quantiles(_u("quantile", "o_orderkey"), grid)
    return orders.select("o_orderkey", rounded(price, 4).alias("price"))


_COND_SQL = f"""
    WITH f AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2),
    b AS (SELECT o_orderstatus, o_orderpriority, n,
                 sum(n) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS upto,
                 sum(n) OVER (PARTITION BY o_orderstatus) AS size FROM f),
    d AS (SELECT o_orderkey, o_orderstatus, {_s('cond', 'o_orderkey')} AS u FROM orders)
    SELECT o_orderkey, d.o_orderstatus, b.o_orderpriority AS priority
    FROM d JOIN b ON d.o_orderstatus = b.o_orderstatus
      AND floor(u * size)::BIGINT >= upto - n AND floor(u * size)::BIGINT < upto
    """


def _chosen(spark: SparkSession, folder: str, **options) -> DataFrame:
    orders = given(spark, folder, "orders")
    return im.cond_choice(
        orders.select("o_orderkey", "o_orderstatus"),
        orders,
        ["o_orderstatus"],
        "o_orderpriority",
        _u("cond", "o_orderkey"),
        ["o_orderkey"],
        "priority",
        **options,
    )


@register.add("conditional_choice", _COND_SQL)
def conditional_choice(spark: SparkSession, folder: str) -> DataFrame:
    return _chosen(spark, folder)


@register.add("conditional_choice_split", _COND_SQL)
def conditional_choice_split(spark: SparkSession, folder: str) -> DataFrame:
    """Three given values of a third of all rows each, on the path for tables too large to send out."""
    return _chosen(spark, folder, limits=Limits(broadcast_rows=2, heavy_rows=1_500))


_ALIAS_SQL = f"""
    WITH c AS (SELECT o_custkey AS v, count(*) * count(*) AS w FROM orders GROUP BY 1),
    t AS (SELECT count(*) AS n, sum(w)::BIGINT AS whole FROM c),
    s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS slot, (w * n - whole)::BIGINT AS over, whole, n FROM c, t),
    l AS (SELECT v, slot, over, whole, (sum(-over) OVER (ORDER BY v) + over)::BIGINT AS pos FROM s WHERE over < 0),
    h AS (SELECT v, slot, whole, (sum(over) OVER (ORDER BY v))::BIGINT AS pos, lead(v) OVER (ORDER BY v) AS after
          FROM s WHERE over > 0),
    a AS (
        SELECT l.slot, l.v, l.whole + l.over AS own, h.v AS alias FROM l ASOF JOIN h ON l.pos < h.pos
        UNION ALL
        SELECT h.slot, h.v, h.whole - (coalesce(l.pos, (SELECT sum(-over) FROM l)) - h.pos), h.after
        FROM h ASOF LEFT JOIN l ON h.pos <= l.pos
        UNION ALL SELECT slot, v, whole, NULL FROM s WHERE over = 0),
    d AS (SELECT o_orderkey, floor({_s('alias_slot', 'o_orderkey')} * n::DOUBLE)::BIGINT AS slot,
                 floor({_s('alias_place', 'o_orderkey')} * whole::DOUBLE)::BIGINT AS place FROM orders, t)
    SELECT o_orderkey, CASE WHEN place < own THEN v ELSE alias END AS customer FROM d JOIN a USING (slot)
    """


def _by_alias(spark: SparkSession, folder: str, **options) -> DataFrame:
    orders = given(spark, folder, "orders").select("o_orderkey", "o_custkey")
    counts = orders.groupBy("o_custkey").agg((F.count(F.lit(1)) * F.count(F.lit(1))).alias("weight"))
    slots = alias_table(counts, "o_custkey", "weight", **options)
    draws = _u("alias_slot", "o_orderkey"), _u("alias_place", "o_orderkey")
    return alias_choice(orders.select("o_orderkey"), slots, *draws, ["o_orderkey"], "customer", **options)


@register.add("weighted_choice_alias", _ALIAS_SQL)
def weighted_choice_alias(spark: SparkSession, folder: str) -> DataFrame:
    """A customer for each order, by the square of how many orders customers have, from a slot and a compare."""
    return _by_alias(spark, folder)


@register.add("weighted_choice_alias_split", _ALIAS_SQL)
def weighted_choice_alias_split(spark: SparkSession, folder: str) -> DataFrame:
    """The same for a table of values too large to send out, made in pieces."""
    return _by_alias(spark, folder, limits=Limits(broadcast_rows=10, heavy_rows=40))


_KS_SQL = """
    WITH v AS (
        SELECT l_extendedprice AS v, count(*) FILTER (l_returnflag = 'A') AS a,
               count(*) FILTER (l_returnflag = 'R') AS b
        FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1),
    t AS (SELECT sum(a) AS na, sum(b) AS nb FROM v),
    c AS (SELECT sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb FROM v)
    SELECT max(na)::BIGINT AS n_a, max(nb)::BIGINT AS n_b,
           round(max(abs(ca::DOUBLE / na::DOUBLE - cb::DOUBLE / nb::DOUBLE)), 9) AS ks
    FROM c, t
    """


def _distance(spark: SparkSession, folder: str, **options) -> DataFrame:
    lines = given(spark, folder, "lineitem").select("l_returnflag", "l_extendedprice")
    a, b = lines.filter("l_returnflag = 'A'"), lines.filter("l_returnflag = 'R'")
    return c.ks(a, b, "l_extendedprice", **options).withColumn("ks", rounded("ks", 9))


@register.add("compare_numeric", _KS_SQL)
def compare_numeric(spark: SparkSession, folder: str) -> DataFrame:
    return _distance(spark, folder)


@register.add("compare_numeric_split", _KS_SQL)
def compare_numeric_split(spark: SparkSession, folder: str) -> DataFrame:
    return _distance(spark, folder, limits=Limits(heavy_rows=2_000))


@register.add(
    "compare_numeric_resampled",
    f"""
    WITH r AS ({_RESAMPLE_SQL}),
    u AS (SELECT o_totalprice AS v, 1 AS a, 0 AS b FROM r UNION ALL SELECT o_totalprice, 0, 1 FROM orders),
    v AS (SELECT v, sum(a) AS a, sum(b) AS b FROM u GROUP BY 1),
    t AS (SELECT sum(a) AS na, sum(b) AS nb FROM v),
    c AS (SELECT sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb FROM v)
    SELECT max(na)::BIGINT AS n_a, max(nb)::BIGINT AS n_b,
           round(max(abs(ca::DOUBLE / na::DOUBLE - cb::DOUBLE / nb::DOUBLE)), 9) AS ks
    FROM c, t
    """,
)
def compare_numeric_resampled(spark: SparkSession, folder: str) -> DataFrame:
    """How far the resampled prices are from the ones they imitate."""
    real = given(spark, folder, "orders").select("o_totalprice")
    made = _resampled(spark, folder).select("o_totalprice")
    return c.ks(made, real, "o_totalprice").withColumn("ks", rounded("ks", 9))


@register.add(
    "compare_category",
    f"""
    WITH made AS ({_COND_SQL}),
    a AS (SELECT priority AS v, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM made) AS share
          FROM made GROUP BY 1),
    b AS (SELECT o_orderpriority AS v, count(*)::DOUBLE / (SELECT count(*) FROM orders) AS share
          FROM orders GROUP BY 1),
    m AS (SELECT coalesce(a.n, 0) AS n, coalesce(a.share, 0) AS sa, coalesce(b.share, 0) AS sb,
                 coalesce(b.share, 0) * (SELECT count(*) FROM made) AS expected
          FROM a FULL JOIN b ON a.v IS NOT DISTINCT FROM b.v)
    SELECT round(sum(abs(sa - sb)) / 2, 9) AS tvd,
           round(sum(CASE WHEN sb > 0 THEN (n - expected) * (n - expected) / expected END), 6) AS chi_square,
           count(*) AS categories
    FROM m
    """,
)
def compare_category(spark: SparkSession, folder: str) -> DataFrame:
    made = _chosen(spark, folder).select(F.col("priority").alias("o_orderpriority"))
    far = c.tvd(made, given(spark, folder, "orders"), "o_orderpriority")
    return far.select(
        rounded("tvd", 9).alias("tvd"), rounded("chi_square").alias("chi_square"), "categories"
    )


CORRELATED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _corr_sql() -> str:
    pairs = [(x, y) for i, x in enumerate(CORRELATED) for y in CORRELATED[i + 1 :]]
    rows = [
        f"""SELECT '{x}' AS x, '{y}' AS y,
            corr({x}, {y}) FILTER (l_returnflag = 'A') AS a, corr({x}, {y}) FILTER (l_returnflag = 'R') AS b
            FROM lineitem"""
        for x, y in pairs
    ]
    return f"""WITH p AS ({' UNION ALL '.join(rows)})
    SELECT x, y, round(a, 6) + 0e0 AS r_a, round(b, 6) + 0e0 AS r_b, round(a - b, 6) + 0e0 AS gap FROM p"""


@register.add("compare_correlation", _corr_sql())
def compare_correlation(spark: SparkSession, folder: str) -> DataFrame:
    lines = given(spark, folder, "lineitem")
    gaps = c.corr_gap(lines.filter("l_returnflag = 'A'"), lines.filter("l_returnflag = 'R'"), CORRELATED)
    return gaps.select("x", "y", *[rounded(n).alias(n) for n in ("r_a", "r_b", "gap")])


@register.add(
    "exact_copy_check",
    f"""
    WITH u AS (SELECT o_orderkey, {_s('copy', 'o_orderkey')} AS u FROM orders),
    made AS (SELECT {q.fk('u', '(SELECT count(*) FROM customer)', start=0)} AS o_custkey, o_orderstatus, o_orderpriority
             FROM orders JOIN u USING (o_orderkey))
    SELECT o_custkey, o_orderstatus, o_orderpriority, count(*) AS n
    FROM made
    WHERE (o_custkey, o_orderstatus, o_orderpriority) IN
          (SELECT (o_custkey, o_orderstatus, o_orderpriority) FROM orders)
    GROUP BY 1, 2, 3
    """,
)
def exact_copy_check(spark: SparkSession, folder: str) -> DataFrame:
    orders = given(spark, folder, "orders")
    customers = given(spark, folder, "customer").count()
    made = orders.withColumn("o_custkey", fk(_u("copy", "o_orderkey"), customers, start=0))
    return c.copies(made, orders, ["o_custkey", "o_orderstatus", "o_orderpriority"])
