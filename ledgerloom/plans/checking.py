"""Registered queries of the checks, on the given tables and on planted defects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.values import cents
from ledgerloom.operators import checks as c
from ledgerloom.operators.spread import Limits
from ledgerloom.plans import sqltext as q
from ledgerloom.plans.generating import planted, planted_sql
from ledgerloom.plans.registry import Register, day
from ledgerloom.plans.validate import Finding, findings
from ledgerloom.sources.tables import given

register = Register()


@register.add(
    "check_unique",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def check_unique(spark: SparkSession, folder: str) -> DataFrame:
    return c.unique(given(spark, folder, "lineitem"), "l_orderkey", "l_linenumber")


# (child, foreign key, parent, key); the last two have violations, being no foreign keys
LINKS = (
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("orders", "o_orderkey", "lineitem", "l_orderkey"),
    ("lineitem", "l_partkey", "customer", "c_custkey"),
)


@register.add(
    "check_fk",
    " UNION ALL ".join(
        f"""SELECT '{child}.{key} -> {parent}' AS rule, count(DISTINCT {key}) AS keys, count(*) AS violations
        FROM {child} WHERE NOT EXISTS (SELECT 1 FROM {parent} WHERE {parent_key} = {key})"""
        for child, key, parent, parent_key in LINKS
    ),
)
def check_fk(spark: SparkSession, folder: str) -> DataFrame:
    results = [
        c.fk_ok(given(spark, folder, child), given(spark, folder, parent), key, parent_key).agg(
            F.lit(f"{child}.{key} -> {parent}").alias("rule"),
            F.count(F.lit(1)).alias("keys"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("violations"),
        )
        for child, key, parent, parent_key in LINKS
    ]
    return reduce(DataFrame.unionByName, results)


_ORPHANS_SQL = """
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    WHERE l_partkey NOT IN (SELECT c_custkey FROM customer)
    """


@register.add("check_fk_rows", _ORPHANS_SQL)
def check_fk_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows behind a broken key: here line parts looked up among customers."""
    lines = given(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return c.orphans(lines, given(spark, folder, "customer"), "l_partkey", "c_custkey")


# fixed values: each rule's name and the condition that breaks it
BREAKS = {
    "l_shipdate is not null": "l_shipdate IS NULL",
    "l_discount in [0.0, 0.05]": "NOT l_discount BETWEEN 0.0 AND 0.05",
    "l_quantity in [1, 40]": "NOT l_quantity BETWEEN 1 AND 40",
    "l_returnflag in (A, N)": "l_returnflag NOT IN ('A', 'N')",
    "price is quantity times 900 or more": "l_extendedprice < l_quantity * 900",
}


@register.add(
    "check_domain",
    " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, count(*) AS violations FROM lineitem WHERE {broken}"
        for rule, broken in BREAKS.items()
    ),
)
def check_domain(spark: SparkSession, folder: str) -> DataFrame:
    rules = [
        c.not_null("l_shipdate"),
        c.in_range("l_discount", 0.0, 0.05),
        c.in_range("l_quantity", 1, 40),
        c.one_of("l_returnflag", "A", "N"),
        c.Rule("price is quantity times 900 or more", F.col("l_extendedprice") < F.col("l_quantity") * 900),
    ]
    return c.domain(given(spark, folder, "lineitem"), rules)


@register.add(
    "check_balance",
    f"""
    WITH s AS (
        SELECT o_orderkey, {q.cents('o_totalprice')} AS side FROM orders
        UNION ALL SELECT l_orderkey, -{q.cents('l_extendedprice')} FROM lineitem)
    SELECT o_orderkey, sum(side)::BIGINT AS difference FROM s GROUP BY 1 HAVING sum(side) <> 0
    """,
)
def check_balance(spark: SparkSession, folder: str) -> DataFrame:
    orders = given(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    lines = given(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    return c.header_matches(orders, lines, "o_orderkey", cents("o_totalprice"), cents("l_extendedprice"))


@register.add(
    "check_balance_documents",
    f"""
    SELECT user_id, sum(CASE WHEN event_type = 'purchase' THEN -{q.cents('value')} ELSE {q.cents('value')} END)::BIGINT
           AS difference
    FROM events GROUP BY 1
    HAVING sum(CASE WHEN event_type = 'purchase' THEN -{q.cents('value')} ELSE {q.cents('value')} END) <> 0
    """,
)
def check_balance_documents(spark: SparkSession, folder: str) -> DataFrame:
    amount = cents("value")
    signed = F.when(F.col("event_type") == "purchase", -amount).otherwise(amount)
    return c.balanced(given(spark, folder, "events"), "user_id", signed)


_DATES_SQL = f"""
    SELECT l_orderkey, l_linenumber, {q.day('o_orderdate')} AS ordered, {q.day('l_shipdate')} AS shipped
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate
    """


def _misdated(spark: SparkSession, folder: str, **options) -> DataFrame:
    lines = given(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    orders = given(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    wrong = c.dates_ok_between(lines, orders, ["l_orderkey"], "o_orderdate", "l_shipdate", **options)
    return wrong.select(
        "l_orderkey", "l_linenumber", day("o_orderdate").alias("ordered"), day("l_shipdate").alias("shipped")
    )


@register.add("check_order_of_dates", _DATES_SQL)
def check_order_of_dates(spark: SparkSession, folder: str) -> DataFrame:
    return _misdated(spark, folder)


@register.add("check_order_of_dates_split", _DATES_SQL)
def check_order_of_dates_split(spark: SparkSession, folder: str) -> DataFrame:
    return _misdated(spark, folder, limits=Limits(broadcast_rows=100, heavy_rows=9))


@register.add(
    "check_defects",
    f"""
    WITH {planted_sql()}
    SELECT 'order_id is unique' AS rule, 'orders' AS table_name, count(*) AS violations
    FROM (SELECT o_orderkey FROM p GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'customer exists', 'orders', count(*) FROM p
    WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
    UNION ALL SELECT 'priority is given', 'orders', count(*) FROM p WHERE o_orderpriority IS NULL
    UNION ALL SELECT 'total is given', 'orders', count(*) FROM p WHERE total IS NULL
    UNION ALL SELECT 'total is below 100 million', 'orders', count(*) FROM p WHERE total >= 100000000
    """,
)
def check_defects(spark: SparkSession, folder: str) -> DataFrame:
    """What the checks find in orders with planted defects."""
    orders = planted(spark, folder)
    customers = given(spark, folder, "customer")
    found = {
        Finding("order_id is unique", "orders"): c.unique(orders, "o_orderkey"),
        Finding("customer exists", "orders", "n"): c.fk_ok(orders, customers, "o_custkey", "c_custkey"),
        Finding("orders", "orders", "domain"): c.domain(
            orders,
            [
                c.Rule("priority is given", F.col("o_orderpriority").isNull()),
                c.Rule("total is given", F.col("total").isNull()),
                c.Rule("total is below 100 million", F.col("total") >= 100_000_000),
            ],
        ),
    }
    return findings(found)
