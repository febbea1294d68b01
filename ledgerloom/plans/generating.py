"""Registered queries of the generation operators, keyed by and sized like the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.draws import draw
from ledgerloom.functions.values import cents, choice, code, date_draw, dist, fk, whole
from ledgerloom.operators import generate as g
from ledgerloom.operators.imitate import choice_from
from ledgerloom.operators import validity as vd
from ledgerloom.operators.spread import Limits, dense_number
from ledgerloom.plans import sqltext as q
from ledgerloom.plans.registry import SEED, Register, day, rounded
from ledgerloom.sources.tables import given

register = Register()
# Makes the splitting of heavy groups happen on test-size tables.
SPLIT_EARLY = Limits(broadcast_rows=100, heavy_rows=2_000)


def _u(col: str, *keys: str):
    return draw(SEED, "q", col, *keys)


def _s(col: str, *keys: str) -> str:
    return q.draw(SEED, "q", col, *keys)


@register.add("key_spine", "SELECT unnest(range(1, (SELECT count(*) FROM orders) + 1))::BIGINT AS id")
def key_spine(spark: SparkSession, folder: str) -> DataFrame:
    return g.spine(spark, given(spark, folder, "orders").count())


@register.add(
    "seeded_draw",
    f"SELECT l_orderkey, l_linenumber, {_s('line', 'l_orderkey', 'l_linenumber')} AS u FROM lineitem",
)
def seeded_draw(spark: SparkSession, folder: str) -> DataFrame:
    lines = given(spark, folder, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", _u("line", "l_orderkey", "l_linenumber").alias("u"))


@register.add(
    "seeded_draw_md5",
    f"SELECT l_orderkey, l_linenumber, {q.draw_md5(SEED, 'q', 'line', 'l_orderkey', 'l_linenumber')} AS u FROM lineitem",
)
def seeded_draw_md5(spark: SparkSession, folder: str) -> DataFrame:
    lines = given(spark, folder, "lineitem")
    u = draw(SEED, "q", "line", "l_orderkey", "l_linenumber", method="md5")
    return lines.select("l_orderkey", "l_linenumber", u.alias("u"))


@register.add(
    "numeric_dist",
    f"""
    WITH d AS (SELECT o_orderkey, {_s('a', 'o_orderkey')} AS u, {_s('b', 'o_orderkey')} AS v FROM orders)
    SELECT o_orderkey,
           round(10e0 + u * 20e0, 6) AS uniform,
           round(-ln(1e0 - u) / 5e-1, 6) AS exponential,
           round(3e0 * pow(1e0 - u, {q.num(-1 / 1.5)}), 4) AS power_law,
           round({q.normal('u', 'v', 100.0, 15.0)}, 6) + 0e0 AS normal,
           round(exp({q.normal('u', 'v', 4.0, 0.5)}), 6) AS lognormal
    FROM d
    """,
)
def numeric_dist(spark: SparkSession, folder: str) -> DataFrame:
    u, v = _u("a", "o_orderkey"), _u("b", "o_orderkey")
    return given(spark, folder, "orders").select(
        "o_orderkey",
        rounded(dist("uniform", 10, 30)(u)).alias("uniform"),
        rounded(dist("exponential", 0.5)(u)).alias("exponential"),
        rounded(dist("power_law", 3, 2.5)(u), 4).alias("power_law"),
        rounded(dist("normal", 100.0, 15.0)(u, v)).alias("normal"),
        rounded(dist("lognormal", 4.0, 0.5)(u, v)).alias("lognormal"),
    )


METHODS = {"transfer": 6.0, "card": 3.0, "cheque": 0.5, "cash": 0.5}
BRANCHES = {f"branch {i:02d}": float(1 + i % 7) for i in range(60)}


@register.add(
    "weighted_choice",
    f"""
    WITH d AS (SELECT o_orderkey, {_s('method', 'o_orderkey')} AS u, {_s('branch', 'o_orderkey')} AS v FROM orders)
    SELECT o_orderkey, {q.pick('u', METHODS)} AS method, {q.pick('v', BRANCHES)} AS branch FROM d
    """,
)
def weighted_choice(spark: SparkSession, folder: str) -> DataFrame:
    return given(spark, folder, "orders").select(
        "o_orderkey",
        choice(_u("method", "o_orderkey"), list(METHODS), list(METHODS.values())).alias("method"),
        choice(_u("branch", "o_orderkey"), list(BRANCHES), list(BRANCHES.values())).alias("branch"),
    )


@register.add(
    "weighted_choice_table",
    f"""
    WITH parts AS (
        SELECT p_partkey, sum(p_size) OVER (ORDER BY p_partkey) - p_size AS low,
               sum(p_size) OVER (ORDER BY p_partkey) AS high
        FROM part),
    d AS (SELECT o_orderkey, floor({_s('part', 'o_orderkey')} * (SELECT sum(p_size) FROM part))::BIGINT AS pick
          FROM orders)
    SELECT o_orderkey, p_partkey FROM d ASOF JOIN parts ON d.pick >= parts.low
    """,
)
def weighted_choice_table(spark: SparkSession, folder: str) -> DataFrame:
    orders = given(spark, folder, "orders").select("o_orderkey")
    parts = given(spark, folder, "part").select("p_partkey", "p_size")
    return choice_from(orders, parts, [], "p_partkey", "p_size", _u("part", "o_orderkey"), ["o_orderkey"])


PERIOD = (dt.date(2001, 3, 7), dt.date(2003, 11, 29))


@register.add(
    "date_draw",
    f"""
    WITH d AS (SELECT o_orderkey, {_s('date', 'o_orderkey')} AS u FROM orders)
    SELECT o_orderkey, {q.day(q.date_draw('u', *PERIOD))} AS any_day,
           {q.day(q.date_draw('u', *PERIOD, weekdays=True))} AS work_day
    FROM d
    """,
)
def date_draws(spark: SparkSession, folder: str) -> DataFrame:
    u = _u("date", "o_orderkey")
    return given(spark, folder, "orders").select(
        "o_orderkey",
        day(date_draw(u, *PERIOD)).alias("any_day"),
        day(date_draw(u, *PERIOD, weekdays=True)).alias("work_day"),
    )


@register.add(
    "code_format",
    f"""
    SELECT o_orderkey, {q.code('ORD', 'year(o_orderdate)', 'o_orderkey')} AS code,
           {q.code('C', 'o_custkey', width=3)} AS short_code
    FROM orders
    """,
)
def code_format(spark: SparkSession, folder: str) -> DataFrame:
    return given(spark, folder, "orders").select(
        "o_orderkey",
        code("ORD", F.year("o_orderdate"), "o_orderkey").alias("code"),
        code("C", "o_custkey", width=3).alias("short_code"),
    )


@register.add(
    "gapless_number",
    f"""
    SELECT o_orderkey, year(o_orderdate)::BIGINT AS year, number,
           {q.code('RE', 'o_orderstatus', 'year(o_orderdate)', 'number')} AS code
    FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, year(o_orderdate)
                                       ORDER BY o_orderdate, o_orderkey) AS number FROM orders)
    """,
)
def gapless_number(spark: SparkSession, folder: str) -> DataFrame:
    orders = given(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("year"), "o_orderdate"
    )
    numbered = dense_number(orders, ["o_orderstatus", "year"], ["o_orderdate", "o_orderkey"], "number")
    return numbered.select(
        "o_orderkey",
        F.col("year").cast("bigint").alias("year"),
        "number",
        code("RE", "o_orderstatus", "year", "number").alias("code"),
    )


@register.add(
    "fk_draw",
    f"""
    WITH d AS (SELECT l_orderkey, l_linenumber, {_s('fk', 'l_orderkey', 'l_linenumber')} AS u FROM lineitem)
    SELECT l_orderkey, l_linenumber, {q.fk('u', '(SELECT count(*) FROM customer)', start=0)} AS flat,
           {q.fk('u', '(SELECT count(*) FROM part)', skew=3.0, start=0)} AS skewed
    FROM d
    """,
)
def fk_draw(spark: SparkSession, folder: str) -> DataFrame:
    u = _u("fk", "l_orderkey", "l_linenumber")
    customers, parts = (given(spark, folder, name).count() for name in ("customer", "part"))
    return given(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        fk(u, customers, start=0).alias("flat"),
        fk(u, parts, skew=3.0, start=0).alias("skewed"),
    )


_SPARSE_SQL = f"""
    WITH parents AS (
        SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS pos FROM customer WHERE c_acctbal > 0),
    d AS (SELECT o_orderkey, {_s('sparse', 'o_orderkey')} AS u FROM orders)
    SELECT o_orderkey, c_custkey
    FROM d JOIN parents ON pos = {q.fk('u', '(SELECT count(*) FROM parents)', skew=2.0)}
    """


def _sparse(spark: SparkSession, folder: str, **options) -> DataFrame:
    orders = given(spark, folder, "orders").select("o_orderkey")
    parents = given(spark, folder, "customer").filter("c_acctbal > 0")
    return g.fk_sparse(
        orders, parents, "c_custkey", _u("sparse", "o_orderkey"), "c_custkey", 2.0, ["o_orderkey"], **options
    )


@register.add("fk_draw_sparse", _SPARSE_SQL)
def fk_draw_sparse(spark: SparkSession, folder: str) -> DataFrame:
    return _sparse(spark, folder)


@register.add("fk_draw_sparse_split", _SPARSE_SQL)
def fk_draw_sparse_split(spark: SparkSession, folder: str) -> DataFrame:
    return _sparse(spark, folder, limits=Limits(broadcast_rows=100, heavy_rows=200))


_FANOUT_SQL = f"""
    WITH d AS (SELECT o_orderkey, {q.whole(_s('lines', 'o_orderkey'), 0, 7)} AS n FROM orders)
    SELECT o_orderkey, unnest(range(1, n + 1))::BIGINT AS line_no FROM d
    """


def _fanned(spark: SparkSession, folder: str, block: int | None) -> DataFrame:
    orders = given(spark, folder, "orders").select("o_orderkey")
    lines = g.fanout(orders, whole(_u("lines", "o_orderkey"), 0, 7), block=block)
    return lines.select("o_orderkey", F.col("line_no").cast("bigint").alias("line_no"))


@register.add("header_to_lines", _FANOUT_SQL)
def header_to_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _fanned(spark, folder, None)


@register.add("header_to_lines_split", _FANOUT_SQL)
def header_to_lines_split(spark: SparkSession, folder: str) -> DataFrame:
    return _fanned(spark, folder, 3)


@register.add(
    "lines_to_header_total",
    f"""
    SELECT o_orderkey, coalesce(sum({q.cents('l_extendedprice')}), 0)::BIGINT AS total
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey
    """,
)
def lines_to_header_total(spark: SparkSession, folder: str) -> DataFrame:
    lines = given(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    orders = given(spark, folder, "orders").select("o_orderkey")
    return g.rollup_total(orders, lines, "o_orderkey", cents("l_extendedprice"))


FLOW = (g.Step("ship", 0.9, (1, 10)), g.Step("invoice", 0.95, (0, 3)), g.Step("pay", 0.8, (5, 60)))


def flow_sql(table: str, key: str, start: str, steps=FLOW, seed: int = SEED) -> tuple[str, str]:
    """(draw columns, date columns) of a document flow; each date refers to the one before."""
    draws, dates, after = [], [], start
    for step in steps:
        low, high = step.lag_days
        draws.append(f"{q.draw(seed, table, f'{step.name}_kept', key)} AS {step.name}_kept")
        draws.append(f"{q.draw(seed, table, f'{step.name}_lag', key)} AS {step.name}_lag")
        lag = f"{low} + floor({step.name}_lag * {q.num(high - low + 1)})::INTEGER"
        dates.append(f"CASE WHEN {step.name}_kept < {q.num(step.rate)} THEN {after} + ({lag}) END AS {step.name}_date")
        after = f"{step.name}_date"
    return ", ".join(draws), ", ".join(dates)


_FLOW_DRAWS, _FLOW_DATES = flow_sql("flow", "o_orderkey", "order_date")


@register.add(
    "document_flow",
    f"""
    WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS order_date, {_FLOW_DRAWS} FROM orders),
    f AS (SELECT o_orderkey, {_FLOW_DATES} FROM d)
    SELECT o_orderkey, {q.day('ship_date')} AS ship_date, {q.day('invoice_date')} AS invoice_date,
           {q.day('pay_date')} AS pay_date
    FROM f
    """,
)
def document_flow(spark: SparkSession, folder: str) -> DataFrame:
    orders = given(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("order_date"))
    flowed = g.document_flow(orders, "order_date", FLOW, SEED, "flow", "o_orderkey")
    return flowed.select("o_orderkey", *[day(f"{s.name}_date").alias(f"{s.name}_date") for s in FLOW])


@register.add(
    "double_entry",
    f"""
    WITH j AS (SELECT l_orderkey AS doc, l_linenumber::BIGINT AS line_no, 'revenue' AS account,
                      -{q.cents('l_extendedprice')} AS amount FROM lineitem)
    SELECT * FROM j
    UNION ALL
    SELECT doc, max(line_no) + 1, 'receivable', (-sum(amount))::BIGINT FROM j GROUP BY doc
    """,
)
def double_entry(spark: SparkSession, folder: str) -> DataFrame:
    lines = given(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("doc"),
        F.col("l_linenumber").cast("bigint").alias("line_no"),
        F.lit("revenue").alias("account"),
        (-cents("l_extendedprice")).alias("amount"),
    )
    return g.balance(lines, "doc", "amount", {"account": F.lit("receivable")})


def _running_sql(by: str) -> str:
    return f"""
    SELECT {by}, l_orderkey, l_linenumber,
           (sum(l_quantity::BIGINT) OVER (PARTITION BY {by} ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey,
                l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING))::BIGINT AS balance
    FROM lineitem
    """


def _running(spark: SparkSession, folder: str, by: str, **options) -> DataFrame:
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    moves = given(spark, folder, "lineitem").select(*dict.fromkeys([by, *order]))
    balances = g.running(moves, [by], order, F.col("l_quantity").cast("bigint"), **options)
    return balances.select(by, "l_orderkey", "l_linenumber", "balance")


@register.add("running_balance", _running_sql("l_partkey"))
def running_balance(spark: SparkSession, folder: str) -> DataFrame:
    return _running(spark, folder, "l_partkey")


@register.add("running_balance_split", _running_sql("l_returnflag"))
def running_balance_split(spark: SparkSession, folder: str) -> DataFrame:
    """Three accounts with a third of all movements each, scanned in pieces."""
    return _running(spark, folder, "l_returnflag", limits=SPLIT_EARLY)


PRICES = {"versions": 14, "days": 180}
_PRICE_SQL = f"""
    h AS (
        SELECT p_partkey, version,
               DATE '1995-01-01' + ((version - 1) * {PRICES['days']})::INTEGER AS valid_from,
               CASE WHEN version < {PRICES['versions']}
                    THEN DATE '1995-01-01' + (version * {PRICES['days']})::INTEGER END AS valid_to,
               floor({q.cents('p_retailprice')}
                     * (8e-1 + 4e-1 * {q.draw(SEED, 'price', 'factor', 'p_partkey', 'version')}))::BIGINT AS price
        FROM part, range(1, {PRICES['versions'] + 1}) AS r(version))
    """


def _prices(spark: SparkSession, folder: str) -> DataFrame:
    parts = given(spark, folder, "part").select("p_partkey", "p_retailprice")
    start = F.lit(dt.date(1995, 1, 1))
    return g.price_history(parts, "p_partkey", SEED, cents("p_retailprice"), start, **PRICES)


@register.add(
    "price_history",
    f"""WITH {_PRICE_SQL} SELECT p_partkey, version, {q.day('valid_from')} AS valid_from,
        {q.day('valid_to')} AS valid_to, price FROM h""",
)
def price_history(spark: SparkSession, folder: str) -> DataFrame:
    return _prices(spark, folder).select(
        "p_partkey",
        F.col("version").cast("bigint").alias("version"),
        day("valid_from").alias("valid_from"),
        day("valid_to").alias("valid_to"),
        "price",
    )


_ASOF_SQL = f"""
    WITH {_PRICE_SQL}
    SELECT l_orderkey, l_linenumber, l_partkey, {q.day('l_shipdate')} AS ship_date, price
    FROM lineitem LEFT JOIN h
      ON l_partkey = p_partkey AND l_shipdate >= valid_from AND (valid_to IS NULL OR l_shipdate < valid_to)
    """


def _priced(spark: SparkSession, folder: str, **options) -> DataFrame:
    lines = given(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    prices = _prices(spark, folder).withColumnRenamed("p_partkey", "l_partkey")
    met = g.asof(
        lines, prices, ["l_partkey"], "l_shipdate", "valid_from", ["price"], ["l_orderkey", "l_linenumber"], **options
    )
    return met.select("l_orderkey", "l_linenumber", "l_partkey", day("l_shipdate").alias("ship_date"), "price")


@register.add("price_asof", _ASOF_SQL)
def price_asof(spark: SparkSession, folder: str) -> DataFrame:
    return _priced(spark, folder)


@register.add("price_asof_split", _ASOF_SQL)
def price_asof_split(spark: SparkSession, folder: str) -> DataFrame:
    return _priced(spark, folder, limits=Limits(broadcast_rows=100, heavy_rows=60))


_VALIDITY_SQL = f"""
    WITH d AS (SELECT DISTINCT o_orderpriority, o_orderdate FROM orders)
    SELECT o_orderpriority, {q.day('o_orderdate')} AS valid_from,
           {q.day('lead(o_orderdate) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate)')} AS valid_to
    FROM d
    """


@register.add("price_validity", _VALIDITY_SQL)
def price_validity(spark: SparkSession, folder: str) -> DataFrame:
    dated = given(spark, folder, "orders").select("o_orderpriority", "o_orderdate").distinct()
    closed = g.valid_to(dated, ["o_orderpriority"], "o_orderdate", limits=SPLIT_EARLY)
    return closed.select("o_orderpriority", day("o_orderdate").alias("valid_from"), day("valid_to").alias("valid_to"))


PLANTED = g.Defects(
    nulls={"o_orderpriority": 0.02, "total": 0.01},
    broken_keys={"o_custkey": 0.01},
    outliers={"total": 0.01},
    duplicates=0.015,
)


def planted_sql() -> str:
    """CTE ``p`` with the planted orders and their truth column."""

    def u(kind: str, col: str) -> str:
        return q.draw(SEED, "defects", f"{kind}:{col}", "o_orderkey")

    return f"""
    d AS (
        SELECT o_orderkey, o_custkey, o_orderpriority, {q.cents('o_totalprice')} AS total,
               {u('null', 'o_orderpriority')} < 2e-2 AS n_priority, {u('null', 'total')} < 1e-2 AS n_total,
               {u('broken_key', 'o_custkey')} < 1e-2 AS b_cust, {u('outlier', 'total')} < 1e-2 AS o_total,
               {u('duplicate', '')} < 1.5e-2 AS dup
        FROM orders),
    p AS (
        SELECT o_orderkey, CASE WHEN b_cust THEN o_custkey + {g.BROKEN_KEY_OFFSET} ELSE o_custkey END AS o_custkey,
               CASE WHEN n_priority THEN NULL ELSE o_orderpriority END AS o_orderpriority,
               CASE WHEN o_total THEN total * {g.OUTLIER_FACTOR} WHEN n_total THEN NULL ELSE total END AS total,
               concat_ws(',', CASE WHEN b_cust THEN 'broken_key:o_custkey' END,
                         CASE WHEN n_priority THEN 'null:o_orderpriority' END,
                         CASE WHEN o_total THEN 'outlier:total' WHEN n_total THEN 'null:total' END,
                         CASE WHEN copy = 1 THEN 'duplicate' END) AS truth
        FROM d, range(0, 2) AS r(copy) WHERE copy = 0 OR dup)
    """


def planted(spark: SparkSession, folder: str) -> DataFrame:
    orders = given(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", cents("o_totalprice").alias("total")
    )
    return g.defects(orders, PLANTED, SEED, "defects", "o_orderkey")


@register.add("inject_defects", f"WITH {planted_sql()} SELECT * FROM p")
def inject_defects(spark: SparkSession, folder: str) -> DataFrame:
    return planted(spark, folder)


_RANGES_SQL = f"""
    r AS (
        SELECT o_orderkey, o_custkey, o_orderdate::DATE AS valid_from,
               CASE WHEN {_s('open', 'o_orderkey')} < 0.01 THEN NULL
                    ELSE (o_orderdate::DATE + floor({_s('valid', 'o_orderkey')} * 120e0)::INTEGER)::DATE END AS valid_to
        FROM orders),
    e AS (SELECT *, coalesce(valid_to, DATE '{vd.OPEN}') AS fin FROM r),
    w AS (
        SELECT *, max(fin) OVER (PARTITION BY o_custkey ORDER BY valid_from, fin, o_orderkey
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached
        FROM e WHERE valid_from < fin)"""
_FAULTS_SQL = f"""
    WITH {_RANGES_SQL}
    SELECT o_orderkey, o_custkey, CASE WHEN reached > valid_from THEN 'overlap' ELSE 'gap' END AS fault,
           CASE WHEN reached > valid_from THEN nullif(least(reached, fin), DATE '{vd.OPEN}') - valid_from ELSE valid_from - reached END::BIGINT AS days
    FROM w WHERE reached <> valid_from
    UNION ALL SELECT o_orderkey, o_custkey, 'empty', 0 FROM e WHERE valid_from >= fin
    """
_COVERED_SQL = f"""
    WITH {_RANGES_SQL},
    n AS (
        SELECT *, sum(CASE WHEN reached IS NULL OR reached < valid_from THEN 1 ELSE 0 END)
                  OVER (PARTITION BY o_custkey ORDER BY valid_from, fin, o_orderkey ROWS UNBOUNDED PRECEDING) AS part
        FROM w)
    SELECT o_custkey, {q.day('min(valid_from)')} AS valid_from,
           {q.day(f"nullif(max(fin), DATE '{vd.OPEN}')")} AS valid_to, count(*) AS rows
    FROM n GROUP BY o_custkey, part
    """


def _ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Each order's date as the beginning of a range of up to 119 days, a hundredth of them open, many overlapping."""
    orders = given(spark, folder, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("valid_from"))
    length = F.floor(_u("valid", "o_orderkey") * 120.0).cast("int")
    end = F.when(_u("open", "o_orderkey") >= 0.01, F.date_add("valid_from", length))
    return orders.withColumn("valid_to", end)


def _faults(spark: SparkSession, folder: str, **options) -> DataFrame:
    found = vd.validity_faults(_ranges(spark, folder), ["o_custkey"], "valid_from", "valid_to", ["o_orderkey"], **options)
    return found.select("o_orderkey", "o_custkey", "fault", F.col("days").cast("bigint").alias("days"))


def _covered(spark: SparkSession, folder: str, **options) -> DataFrame:
    found = vd.covered(_ranges(spark, folder), ["o_custkey"], "valid_from", "valid_to", ["o_orderkey"], **options)
    return found.select("o_custkey", day("valid_from").alias("valid_from"), day("valid_to").alias("valid_to"), "rows")


@register.add("validity_faults", _FAULTS_SQL)
def validity_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Where the ranges of a customer overlap, leave a gap, or hold no day."""
    return _faults(spark, folder)


@register.add("validity_faults_split", _FAULTS_SQL)
def validity_faults_split(spark: SparkSession, folder: str) -> DataFrame:
    """The same with customers of many orders swept in pieces."""
    return _faults(spark, folder, limits=Limits(broadcast_rows=100, heavy_rows=8))


@register.add("validity_covered", _COVERED_SQL)
def validity_covered(spark: SparkSession, folder: str) -> DataFrame:
    """The ranges that a customer's orders cover together."""
    return _covered(spark, folder)


@register.add("validity_covered_split", _COVERED_SQL)
def validity_covered_split(spark: SparkSession, folder: str) -> DataFrame:
    return _covered(spark, folder, limits=Limits(broadcast_rows=100, heavy_rows=8))
