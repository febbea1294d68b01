"""The whole set of business tables, consistent by construction.

Each table is a column expression over a key range. Children recompute what they need of a
parent from the foreign key, so building the set needs no join; only invoice numbers, which
must be gap-free per company and year, and the checks need a shuffle. Money is BIGINT cents
here and DECIMAL(18,2) in ``published`` tables.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.draws import ColumnLike, as_col, draw
from ledgerloom.functions.values import choice, code, date_draw, dist, fk, money, whole
from ledgerloom.operators.generate import Step, document_flow, fanout, spine
from ledgerloom.operators.spread import LIMITS, Limits, dense_number
from ledgerloom.sources.tables import given

CURRENCIES = {"EUR": 5.0, "USD": 4.0, "GBP": 2.0, "JPY": 1.0}
COUNTRIES = {"DE": 6.0, "FR": 4.0, "US": 8.0, "GB": 3.0, "JP": 2.0, "BR": 1.0}
SEGMENTS = {"retail": 5.0, "wholesale": 3.0, "public": 1.0, "online": 6.0}
CATEGORIES = {"raw material": 4.0, "component": 5.0, "finished good": 3.0, "service part": 2.0}
TERMS_DAYS = {14: 2.0, 30: 5.0, 60: 3.0}
ACCOUNT_KINDS = ("cash", "receivable", "inventory", "payable", "revenue", "cost of sales")
CASH, RECEIVABLE, REVENUE = 1, 2, 5  # positions in ACCOUNT_KINDS, from 1
ACCOUNTS_PER_COMPANY = 100  # account_id = company_id * 100 + position
SUPPLIERS_PER_COMPANY = 10
DUE_DAYS = 30
MARKUP = 1.4
STEPS = (Step("ship", 0.9, (1, 10)), Step("invoice", 0.95, (0, 3)), Step("pay", 0.8, (5, 60)))


@dataclass(frozen=True)
class Spec:
    """How many of each, and when."""

    companies: int
    customers: int
    vendors: int
    items: int
    orders: int
    start: dt.date = dt.date(2023, 1, 2)
    end: dt.date = dt.date(2024, 12, 31)
    max_lines: int = 7
    customer_skew: float = 2.0
    item_skew: float = 1.5
    steps: tuple[Step, ...] = STEPS


def sized_like(spark: SparkSession, folder: str) -> Spec:
    """A spec with as many rows as the given tables have, and a company for every ten suppliers."""

    names = ("customer", "supplier", "part", "orders")
    counts = [
        given(spark, folder, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name in names
    ]
    rows = {row["name"]: row["n"] for row in reduce(DataFrame.unionByName, counts).collect()}
    companies = max(1, rows["supplier"] // SUPPLIERS_PER_COMPANY)
    return Spec(companies, *[rows[name] for name in names])


def _pick(u: Column, weights: Mapping) -> Column:
    return choice(u, list(weights), list(weights.values()))


def company(spark: SparkSession, spec: Spec, seed: int) -> DataFrame:
    return spine(spark, spec.companies, name="company_id").select(
        "company_id",
        code("CO", "company_id", width=3).alias("name"),
        _pick(draw(seed, "company", "currency", "company_id"), CURRENCIES).alias("currency"),
    )


def account(spark: SparkSession, spec: Spec, seed: int) -> DataFrame:
    rows = fanout(spine(spark, spec.companies, name="company_id"), F.lit(len(ACCOUNT_KINDS)), "position")
    return rows.select(
        account_id("company_id", F.col("position")).alias("account_id"),
        "company_id",
        F.get(F.array(*[F.lit(k) for k in ACCOUNT_KINDS]), F.col("position") - 1).alias("kind"),
    )


def account_id(company: ColumnLike, position: Column | int) -> Column:
    place = F.lit(position) if isinstance(position, int) else position
    return as_col(company) * F.lit(ACCOUNTS_PER_COMPANY) + place


def customer(spark: SparkSession, spec: Spec, seed: int) -> DataFrame:
    key = "customer_id"
    spread = dist("lognormal", 8.0, 1.0)(draw(seed, "customer", "limit_a", key), draw(seed, "customer", "limit_b", key))
    return spine(spark, spec.customers, name=key).select(
        key,
        _pick(draw(seed, "customer", "segment", key), SEGMENTS).alias("segment"),
        _pick(draw(seed, "customer", "country", key), COUNTRIES).alias("country"),
        (F.floor(spread / F.lit(100.0)) * F.lit(10_000)).alias("credit_limit"),
    )


def vendor(spark: SparkSession, spec: Spec, seed: int) -> DataFrame:
    return spine(spark, spec.vendors, name="vendor_id").select(
        "vendor_id",
        _pick(draw(seed, "vendor", "country", "vendor_id"), COUNTRIES).alias("country"),
        _pick(draw(seed, "vendor", "terms", "vendor_id"), TERMS_DAYS).alias("terms_days"),
    )


def unit_cost(seed: int, item: ColumnLike) -> Column:
    """An item's cost in cents, from its key alone."""
    spread = dist("lognormal", 7.0, 0.8)(draw(seed, "item", "cost_a", item), draw(seed, "item", "cost_b", item))
    return F.lit(50).cast("bigint") + F.floor(spread)


def item(spark: SparkSession, spec: Spec, seed: int) -> DataFrame:
    return spine(spark, spec.items, name="item_id").select(
        "item_id",
        code("IT", "item_id", width=7).alias("code"),
        _pick(draw(seed, "item", "category", "item_id"), CATEGORIES).alias("category"),
        unit_cost(seed, "item_id").alias("unit_cost"),
    )


def line_item(spec: Spec, seed: int, order: ColumnLike, line: ColumnLike) -> Column:
    return fk(draw(seed, "order_line", "item", order, line), spec.items, spec.item_skew)


def line_qty(seed: int, order: ColumnLike, line: ColumnLike) -> Column:
    return whole(draw(seed, "order_line", "qty", order, line), 1, 10)


def line_amount(spec: Spec, seed: int, order: ColumnLike, line: ColumnLike) -> Column:
    price = F.floor(unit_cost(seed, line_item(spec, seed, order, line)) * F.lit(MARKUP))
    return line_qty(seed, order, line) * price


def with_facts(keyed: DataFrame, spec: Spec, seed: int) -> DataFrame:
    """Adds to an ``order_id`` column all its key decides: parties, number of lines, step dates."""
    key = "order_id"
    parties = keyed.select(
        "*",
        fk(draw(seed, "order", "company", key), spec.companies).alias("company_id"),
        fk(draw(seed, "order", "customer", key), spec.customers, spec.customer_skew).alias("customer_id"),
        date_draw(draw(seed, "order", "date", key), spec.start, spec.end, weekdays=True).alias("order_date"),
        whole(draw(seed, "order", "lines", key), 1, spec.max_lines).cast("int").alias("n_lines"),
    )
    return document_flow(parties, "order_date", spec.steps, seed, "order", key)


def order_facts(spark: SparkSession, spec: Spec, seed: int) -> DataFrame:
    return with_facts(spine(spark, spec.orders, name="order_id"), spec, seed)


def with_totals(orders: DataFrame, spec: Spec, seed: int) -> DataFrame:
    """Order facts plus the ``total`` of the order's lines.

    The lines of one order are made in one task and the key range is already partitioned by
    order, so this sum needs no shuffle. Facts are drawn again from the key afterwards.
    """
    lines = fanout(orders.select("order_id", "n_lines"), "n_lines")
    amount = line_amount(spec, seed, "order_id", "line_no")
    return with_facts(lines.groupBy("order_id").agg(F.sum(amount).alias("total")), spec, seed)


def keep_orders(spark: SparkSession, spec: Spec, seed: int, path: str) -> DataFrame:
    """Facts and totals of all orders, made once and read from ``path``, for plans that need them many times."""
    with_totals(order_facts(spark, spec, seed), spec, seed).write.parquet(path)
    return spark.read.parquet(path)


def _reached(spark: SparkSession, spec: Spec, seed: int, step: str, kept: DataFrame | None) -> DataFrame:
    """Facts of the orders that reached a step."""
    facts = order_facts(spark, spec, seed) if kept is None else kept.drop("total")
    return facts.filter(F.col(step).isNotNull())


def _summed(spark: SparkSession, spec: Spec, seed: int, step: str, kept: DataFrame | None) -> DataFrame:
    """The same with their totals."""
    if kept is not None:
        return kept.filter(F.col(step).isNotNull())
    return with_totals(_reached(spark, spec, seed, step, None), spec, seed)


def order_header(spark: SparkSession, spec: Spec, seed: int, kept: DataFrame | None = None) -> DataFrame:
    status = (
        F.when(F.col("pay_date").isNotNull(), "paid")
        .when(F.col("invoice_date").isNotNull(), "invoiced")
        .when(F.col("ship_date").isNotNull(), "shipped")
        .otherwise("open")
    )
    return _summed(spark, spec, seed, "order_id", kept).select(
        "order_id", "company_id", "customer_id", "order_date", status.alias("status"), "total"
    )


def order_line(spark: SparkSession, spec: Spec, seed: int, kept: DataFrame | None = None) -> DataFrame:
    lines = fanout(_reached(spark, spec, seed, "order_id", kept).select("order_id", "n_lines"), "n_lines")
    return lines.select(
        "order_id",
        "line_no",
        line_item(spec, seed, "order_id", "line_no").alias("item_id"),
        line_qty(seed, "order_id", "line_no").cast("int").alias("qty"),
        line_amount(spec, seed, "order_id", "line_no").alias("amount"),
    )


def shipment(spark: SparkSession, spec: Spec, seed: int, kept: DataFrame | None = None) -> DataFrame:
    shipped = _reached(spark, spec, seed, "ship_date", kept)
    return shipped.select(F.col("order_id").alias("shipment_id"), "order_id", "ship_date")


def invoice(
    spark: SparkSession, spec: Spec, seed: int, limits: Limits = LIMITS, kept: DataFrame | None = None
) -> DataFrame:
    billed = _reached(spark, spec, seed, "invoice_date", kept)
    rows = _summed(spark, spec, seed, "invoice_date", kept).select(
        F.col("order_id").alias("invoice_id"),
        "order_id",
        "company_id",
        F.year("invoice_date").alias("year"),
        "invoice_date",
        F.date_add("invoice_date", DUE_DAYS).alias("due_date"),
        F.col("total").alias("amount"),
    )
    order = ["invoice_date", "invoice_id"]
    light = billed.select(F.col("order_id").alias("invoice_id"), "company_id", F.year("invoice_date").alias("year"), "invoice_date")
    numbered = dense_number(rows, ["company_id", "year"], order, "running", limits, light)
    number = code("INV", "company_id", "year", "running")
    return numbered.select("invoice_id", "order_id", number.alias("number"), "invoice_date", "due_date", "amount")


def paid_amount(seed: int, order: ColumnLike, total: Column) -> Column:
    """Most payments are in full, the rest settle half (rounded down)."""
    full = draw(seed, "payment", "full", order) < F.lit(0.85)
    return F.when(full, total).otherwise(F.floor(total / F.lit(2)))


def payment(spark: SparkSession, spec: Spec, seed: int, kept: DataFrame | None = None) -> DataFrame:
    return _summed(spark, spec, seed, "pay_date", kept).select(
        F.col("order_id").alias("payment_id"),
        F.col("order_id").alias("invoice_id"),
        "pay_date",
        paid_amount(seed, "order_id", F.col("total")).alias("amount"),
    )


def journal_line(spark: SparkSession, spec: Spec, seed: int, kept: DataFrame | None = None) -> DataFrame:
    """Two lines per invoice (receivable, revenue) and two per payment (cash, receivable).

    Document numbers are twice the order's key, plus one for its payment. Debits are
    positive and every document's lines add up to zero.
    """
    facts = _summed(spark, spec, seed, "invoice_date", kept)
    facts = facts.withColumn("paid", paid_amount(seed, "order_id", F.col("total")))

    def entry(odd: int, line: int, account: int, posted: str, amount: Column) -> Column:
        return F.struct(
            (F.col("order_id") * 2 + F.lit(odd)).alias("doc_id"),
            F.lit(line).alias("line_no"),
            account_id("company_id", account).alias("account_id"),
            F.col(posted).alias("posted"),
            amount.alias("amount"),
        )

    billed = [
        entry(0, 1, RECEIVABLE, "invoice_date", F.col("total")),
        entry(0, 2, REVENUE, "invoice_date", -F.col("total")),
    ]
    settled = [
        entry(1, 1, CASH, "pay_date", F.col("paid")),
        entry(1, 2, RECEIVABLE, "pay_date", -F.col("paid")),
    ]
    entries = F.when(F.col("pay_date").isNotNull(), F.array(*billed, *settled)).otherwise(F.array(*billed))
    return facts.select(F.inline(entries))


def stock_move(spark: SparkSession, spec: Spec, seed: int, kept: DataFrame | None = None) -> DataFrame:
    """An opening receipt per item and an issue per shipped line; issues are negative.

    Receipts have even move numbers and issues odd ones.
    """
    receipts = spine(spark, spec.items, name="item_id").select(
        (F.col("item_id") * 2).alias("move_id"),
        "item_id",
        F.lit(spec.start).alias("move_date"),
        whole(draw(seed, "stock", "opening", "item_id"), 100, 1000).cast("int").alias("qty"),
    )
    shipped = _reached(spark, spec, seed, "ship_date", kept)
    lines = fanout(shipped.select("order_id", "ship_date", "n_lines"), "n_lines")
    number = F.col("order_id") * F.lit(spec.max_lines) + F.col("line_no")
    issues = lines.select(
        (number * 2 + 1).alias("move_id"),
        line_item(spec, seed, "order_id", "line_no").alias("item_id"),
        F.col("ship_date").alias("move_date"),
        (-line_qty(seed, "order_id", "line_no")).cast("int").alias("qty"),
    )
    return receipts.unionByName(issues)


TABLES = {
    "company": company,
    "account": account,
    "customer": customer,
    "vendor": vendor,
    "item": item,
    "order_header": order_header,
    "order_line": order_line,
    "shipment": shipment,
    "invoice": invoice,
    "payment": payment,
    "journal_line": journal_line,
    "stock_move": stock_move,
}

OF_ORDERS = ("order_header", "order_line", "shipment", "invoice", "payment", "journal_line", "stock_move")

MONEY = {
    "customer": ("credit_limit",),
    "item": ("unit_cost",),
    "order_header": ("total",),
    "order_line": ("amount",),
    "invoice": ("amount",),
    "payment": ("amount",),
    "journal_line": ("amount",),
}


def build(spark: SparkSession, spec: Spec, seed: int, kept: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables, lazily: nothing but the invoice numbering looks at data before an action.

    ``kept`` are the orders of ``keep_orders``; without them each table makes its own again.
    """
    known = {name: {"kept": kept} for name in OF_ORDERS if kept is not None}
    return {name: make(spark, spec, seed, **known.get(name, {})) for name, make in TABLES.items()}


def published(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The same tables with money as DECIMAL(18,2)."""
    return {
        name: df.withColumns({c: money(c) for c in MONEY.get(name, ())}) if MONEY.get(name) else df
        for name, df in tables.items()
    }
