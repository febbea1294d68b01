"""Registered queries of the whole business: generated tables, reports, sinks and feeds."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import reports as r
from ledgerloom.operators.generate import running
from ledgerloom.operators.settle import reordered, settle
from ledgerloom.operators.spread import LIMITS, Limits
from ledgerloom.plans import company as co
from ledgerloom.plans import sqltext as q
from ledgerloom.plans.generating import flow_sql
from ledgerloom.plans.registry import SEED, Register, day
from ledgerloom.plans.validate import DATES, KEYS, LINKS, validate, write_validated
from ledgerloom.session import work_dir
from ledgerloom.sources.sets import publish, read_set
from ledgerloom.sources.tables import FORMATS, given, read_table, write
from ledgerloom.streaming import feeds

register = Register()
AS_OF = dt.date(2024, 10, 31)


def _tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return co.build(spark, co.sized_like(spark, folder), SEED)


def _s(table: str, col: str, *keys: str) -> str:
    return q.draw(SEED, table, col, *keys)


_COMPANIES = f"(SELECT greatest(1, count(*) // {co.SUPPLIERS_PER_COMPANY})::BIGINT FROM supplier)"


def _keys(name: str, table: str) -> str:
    size = _COMPANIES if name == "company_id" else f"(SELECT count(*) FROM {table})"
    return f"(SELECT unnest(range(1, {size} + 1)) AS {name})"


_SPEC = co.Spec(0, 0, 0, 0, 0)  # for its dates, skews and steps; the sizes come from the tables
_DRAWS, _DATES = flow_sql("order", "order_id", "order_date", _SPEC.steps)
_COST = f"""(50 + floor(exp({q.normal('ca', 'cb', 7.0, 0.8)}))::BIGINT)"""

# Orders with their facts, lines with their amounts, and orders with totals, as CTEs.
_FACTS = f"""
    k AS {_keys('order_id', 'orders')},
    o1 AS (
        SELECT order_id, {q.fk(_s('order', 'company', 'order_id'), _COMPANIES)} AS company_id,
               {q.fk(_s('order', 'customer', 'order_id'), '(SELECT count(*) FROM customer)', _SPEC.customer_skew)}
               AS customer_id,
               {q.date_draw(_s('order', 'date', 'order_id'), _SPEC.start, _SPEC.end, True)} AS order_date,
               {q.whole(_s('order', 'lines', 'order_id'), 1, _SPEC.max_lines)} AS n_lines, {_DRAWS}
        FROM k),
    f AS (SELECT order_id, company_id, customer_id, order_date, n_lines, {_DATES} FROM o1)
    """
_LINES = f"""{_FACTS},
    l1 AS (SELECT order_id, unnest(range(1, n_lines + 1)) AS line_no FROM f),
    l2 AS (
        SELECT *, {q.fk(_s('order_line', 'item', 'order_id', 'line_no'), '(SELECT count(*) FROM part)',
                        _SPEC.item_skew)} AS item_id,
               {q.whole(_s('order_line', 'qty', 'order_id', 'line_no'), 1, 10)} AS qty
        FROM l1),
    l3 AS (SELECT *, {_s('item', 'cost_a', 'item_id')} AS ca, {_s('item', 'cost_b', 'item_id')} AS cb FROM l2),
    lines AS (
        SELECT order_id, line_no, item_id, qty,
               qty * floor({_COST}::DOUBLE * {q.num(co.MARKUP)})::BIGINT AS amount FROM l3)
    """
_TOTALS = f"""{_LINES},
    t AS (SELECT f.*, total FROM f JOIN (SELECT order_id, sum(amount)::BIGINT AS total FROM lines GROUP BY 1) USING (order_id))
    """
_PAID = f"""{_TOTALS},
    p AS (
        SELECT *, CASE WHEN {_s('payment', 'full', 'order_id')} < 8.5e-1 THEN total
                       ELSE floor(total::DOUBLE / 2)::BIGINT END AS paid FROM t)
    """


def _journal_sql() -> str:
    entries = (
        (0, 1, co.RECEIVABLE, "invoice_date", "total"),
        (0, 2, co.REVENUE, "invoice_date", "-total"),
        (1, 1, co.CASH, "pay_date", "paid"),
        (1, 2, co.RECEIVABLE, "pay_date", "-paid"),
    )
    return " UNION ALL ".join(
        f"""SELECT order_id * 2 + {odd} AS doc_id, {line}::BIGINT AS line_no,
            company_id * {co.ACCOUNTS_PER_COMPANY} + {account} AS account_id, {date} AS posted, {amount} AS amount
            FROM p WHERE invoice_date IS NOT NULL AND {date} IS NOT NULL"""
        for odd, line, account, date, amount in entries
    )


_MOVES_SQL = f"""
    WITH {_FACTS},
    l1 AS (SELECT order_id, ship_date, unnest(range(1, n_lines + 1)) AS line_no FROM f WHERE ship_date IS NOT NULL)
    SELECT item_id * 2 AS move_id, item_id, {q.day(f"DATE '{_SPEC.start}'")} AS move_date,
           {q.whole(_s('stock', 'opening', 'item_id'), 100, 1000)} AS qty
    FROM {_keys('item_id', 'part')}
    UNION ALL
    SELECT (order_id * {_SPEC.max_lines} + line_no) * 2 + 1,
           {q.fk(_s('order_line', 'item', 'order_id', 'line_no'), '(SELECT count(*) FROM part)', _SPEC.item_skew)},
           {q.day('ship_date')}, -{q.whole(_s('order_line', 'qty', 'order_id', 'line_no'), 1, 10)}
    FROM l1
    """

_INVOICE_SQL = f"""
    WITH {_TOTALS},
    n AS (SELECT *, row_number() OVER (PARTITION BY company_id, year(invoice_date)
                                       ORDER BY invoice_date, order_id) AS running
          FROM t WHERE invoice_date IS NOT NULL)
    SELECT order_id AS invoice_id, order_id, {q.code('INV', 'company_id', 'year(invoice_date)', 'running')} AS number,
           {q.day('invoice_date')} AS invoice_date, {q.day(f'invoice_date + {co.DUE_DAYS}')} AS due_date,
           total AS amount
    FROM n
    """

_TABLE_SQL = {
    "company": f"""
        SELECT company_id, {q.code('CO', 'company_id', width=3)} AS name,
               {q.pick(_s('company', 'currency', 'company_id'), co.CURRENCIES)} AS currency
        FROM {_keys('company_id', 'supplier')}""",
    "account": f"""
        SELECT company_id * {co.ACCOUNTS_PER_COMPANY} + pos AS account_id, company_id,
               {list(co.ACCOUNT_KINDS)}[pos] AS kind
        FROM {_keys('company_id', 'supplier')}, range(1, {len(co.ACCOUNT_KINDS) + 1}) AS r(pos)""",
    "customer": f"""
        SELECT customer_id, {q.pick(_s('customer', 'segment', 'customer_id'), co.SEGMENTS)} AS segment,
               {q.pick(_s('customer', 'country', 'customer_id'), co.COUNTRIES)} AS country,
               floor(exp({q.normal(_s('customer', 'limit_a', 'customer_id'), _s('customer', 'limit_b', 'customer_id'),
                                   8.0, 1.0)}) / 1e2)::BIGINT * 10000 AS credit_limit
        FROM {_keys('customer_id', 'customer')}""",
    "vendor": f"""
        SELECT vendor_id, {q.pick(_s('vendor', 'country', 'vendor_id'), co.COUNTRIES)} AS country,
               {q.pick(_s('vendor', 'terms', 'vendor_id'), co.TERMS_DAYS)}::BIGINT AS terms_days
        FROM {_keys('vendor_id', 'supplier')}""",
    "item": f"""
        WITH i AS (SELECT item_id, {_s('item', 'cost_a', 'item_id')} AS ca, {_s('item', 'cost_b', 'item_id')} AS cb
                   FROM {_keys('item_id', 'part')})
        SELECT item_id, {q.code('IT', 'item_id', width=7)} AS code,
               {q.pick(_s('item', 'category', 'item_id'), co.CATEGORIES)} AS category, {_COST} AS unit_cost FROM i""",
    "order_header": f"""
        WITH {_TOTALS}
        SELECT order_id, company_id, customer_id, {q.day('order_date')} AS order_date,
               CASE WHEN pay_date IS NOT NULL THEN 'paid' WHEN invoice_date IS NOT NULL THEN 'invoiced'
                    WHEN ship_date IS NOT NULL THEN 'shipped' ELSE 'open' END AS status, total
        FROM t""",
    "order_line": f"WITH {_LINES} SELECT * FROM lines",
    "shipment": f"""
        WITH {_FACTS} SELECT order_id AS shipment_id, order_id, {q.day('ship_date')} AS ship_date
        FROM f WHERE ship_date IS NOT NULL""",
    "invoice": _INVOICE_SQL,
    "payment": f"""
        WITH {_PAID} SELECT order_id AS payment_id, order_id AS invoice_id, {q.day('pay_date')} AS pay_date,
                            paid AS amount FROM p WHERE pay_date IS NOT NULL""",
    "journal_line": f"""
        WITH {_PAID}, j AS ({_journal_sql()})
        SELECT doc_id, line_no, account_id, {q.day('posted')} AS posted, amount FROM j""",
    "stock_move": _MOVES_SQL,
}


def _plain(df: DataFrame) -> DataFrame:
    """Dates as text and integers as BIGINT, which both engines hand over alike."""
    kinds = {"date": day, "int": lambda n: F.col(n).cast("bigint")}
    return df.select(*[kinds.get(t, F.col)(n).alias(n) for n, t in df.dtypes])


def _add_table(name: str) -> None:
    @register.add(f"table_of_{name}", _TABLE_SQL[name])
    def table(spark: SparkSession, folder: str) -> DataFrame:
        return _plain(co.TABLES[name](spark, co.sized_like(spark, folder), SEED))


for _name in co.TABLES:
    _add_table(_name)


@register.add(
    "order_slice",
    f"""WITH {_LINES}
    SELECT customer_id, count(DISTINCT order_id) AS orders, count(*) AS lines, sum(qty)::BIGINT AS qty,
           sum(amount)::BIGINT AS amount
    FROM f JOIN lines USING (order_id) GROUP BY 1""",
)
def order_slice(spark: SparkSession, folder: str) -> DataFrame:
    """Headers with a skewed customer, fanned out to lines, added up per customer.

    Lines are added up per order first: there the order's range partitioning saves a shuffle,
    and one row per order goes on to the customers.
    """
    spec = co.sized_like(spark, folder)
    per_order = co.order_line(spark, spec, SEED).groupBy("order_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("qty").alias("qty"), F.sum("amount").alias("amount")
    )
    totals = co.with_facts(per_order, spec, SEED)
    return totals.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("orders"),
        *[F.sum(name).cast("bigint").alias(name) for name in ("lines", "qty", "amount")],
    )


@register.add(
    "stock_balance",
    f"""
    WITH m AS ({_MOVES_SQL})
    SELECT move_id, item_id,
           (sum(qty) OVER (PARTITION BY item_id ORDER BY move_date, move_id ROWS UNBOUNDED PRECEDING))::BIGINT AS balance
    FROM m
    """,
)
def stock_balance(spark: SparkSession, folder: str) -> DataFrame:
    moves = co.stock_move(spark, co.sized_like(spark, folder), SEED)
    return running(moves, ["item_id"], ["move_date", "move_id"], "qty").select("move_id", "item_id", "balance")


SPLIT_ITEMS = Limits(broadcast_rows=100, heavy_rows=50)
REORDER = {"floor": 0, "lot": 50}
_REORDER_SQL = f"""
    WITH RECURSIVE m AS ({_MOVES_SQL}),
    n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY move_date, move_id) AS k FROM m),
    s AS (
        SELECT item_id, 0::BIGINT AS k, 0::BIGINT AS move_id, 0::BIGINT AS ordered, 0::BIGINT AS balance
        FROM (SELECT DISTINCT item_id FROM n)
        UNION ALL
        SELECT item_id, k, move_id, (bought * {REORDER['lot']})::BIGINT, (plain + bought * {REORDER['lot']})::BIGINT
        FROM (SELECT n.item_id, n.k, n.move_id, s.balance + n.qty AS plain,
                     greatest(0, ceil(({REORDER['floor']} - s.balance - n.qty)::DOUBLE / {REORDER['lot']}))::BIGINT AS bought
              FROM s JOIN n ON n.item_id = s.item_id AND n.k = s.k + 1))
    SELECT move_id, item_id, ordered, balance FROM s WHERE k > 0
    """


def _reordered(spark: SparkSession, folder: str, limits: Limits) -> DataFrame:
    moves = co.stock_move(spark, co.sized_like(spark, folder), SEED)
    kept = reordered(moves, ["item_id"], ["move_date", "move_id"], "qty", **REORDER, limits=limits)
    return kept.select("move_id", "item_id", "ordered", "balance")


@register.add("stock_reordered", _REORDER_SQL)
def stock_reordered(spark: SparkSession, folder: str) -> DataFrame:
    """Stock that is bought in lots before it falls below zero; the SQL goes movement by movement."""
    return _reordered(spark, folder, LIMITS)


@register.add("stock_reordered_split", _REORDER_SQL)
def stock_reordered_split(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the busiest items scanned in pieces."""
    return _reordered(spark, folder, SPLIT_ITEMS)



@register.add(
    "check_generated",
    f"""
    WITH {_PAID}, j AS ({_journal_sql()}),
    d AS (SELECT doc_id FROM j GROUP BY 1 HAVING sum(amount) <> 0),
    i AS ({_INVOICE_SQL})
    SELECT 'documents add up to zero' AS rule, 'journal_line' AS table_name, count(*) AS violations FROM d
    UNION ALL
    SELECT 'number is unique', 'invoice', count(*) FROM (SELECT number FROM i GROUP BY 1 HAVING count(*) > 1)
    UNION ALL
    SELECT 'customer_id exists in customer', 'order_header', count(*) FROM f
    WHERE customer_id NOT BETWEEN 1 AND (SELECT count(*) FROM customer)
    UNION ALL
    SELECT 'item_id exists in item', 'order_line', count(*) FROM lines
    WHERE item_id NOT BETWEEN 1 AND (SELECT count(*) FROM part)
    UNION ALL
    SELECT 'ship_date is not before order_date', 'shipment', count(*) FROM f WHERE ship_date < order_date
    UNION ALL
    SELECT 'pay_date is not before invoice_date', 'payment', count(*) FROM f WHERE pay_date < invoice_date
    """,
)
def check_generated(spark: SparkSession, folder: str) -> DataFrame:
    """The checks the SQL restates; ``validate`` runs some thirty, see the tests."""
    stated = (
        ("journal_line", "documents add up to zero"),
        ("invoice", "number is unique"),
        ("order_header", "customer_id exists in customer"),
        ("order_line", "item_id exists in item"),
        ("shipment", "ship_date is not before order_date"),
        ("payment", "pay_date is not before invoice_date"),
    )
    return validate(_tables(spark, folder), only=stated)


# fixed values: what is damaged in the generated tables before they are written and checked
DAMAGE = {
    "customer": "customer_id % 10 <> 3",
    "order_line": "NOT (order_id % 40 = 7 AND line_no = 1)",
    "journal_line": "NOT (doc_id % 60 = 8 AND line_no = 2)",
    "shipment": "order_id % 70 <> 5",
}
EARLIER_DAYS, EARLIER = 40, "order_id % 30 = 11"  # invoices dated so many days back
TWICE = "payment_id % 50 = 9"  # payments that are there twice
TOO_MANY, MANY = "order_id % 100 = 1", 11  # lines with a quantity out of range


def damaged(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The generated tables with broken references, sums, dates, keys and ranges."""
    made = {name: df.filter(DAMAGE[name]) if name in DAMAGE else df for name, df in tables.items()}
    lines, invoices, payments = made["order_line"], made["invoice"], made["payment"]
    qty = F.when(F.expr(TOO_MANY), F.lit(MANY)).otherwise(F.col("qty")).cast(lines.schema["qty"].dataType)
    dated = F.when(F.expr(EARLIER), F.date_sub("invoice_date", EARLIER_DAYS)).otherwise(F.col("invoice_date"))
    copies = F.when(F.expr(TWICE), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return made | {
        "order_line": lines.withColumn("qty", qty),
        "invoice": invoices.withColumn("invoice_date", dated),
        "payment": payments.withColumn("copy", F.explode(copies)).drop("copy"),
    }


def _damaged_sql() -> str:
    changes = {
        "order_line": f"SELECT * REPLACE (CASE WHEN {TOO_MANY} THEN {MANY} ELSE qty END AS qty) FROM",
        "invoice": f"""SELECT * REPLACE (CASE WHEN {EARLIER} THEN (invoice_date::DATE - {EARLIER_DAYS})::DATE::VARCHAR
                       ELSE invoice_date END AS invoice_date) FROM""",
        "payment": f"SELECT * EXCLUDE (copy) FROM (SELECT *, unnest(CASE WHEN {TWICE} THEN [0, 1] ELSE [0] END) AS copy FROM",
    }
    parts = []
    for name in co.TABLES:
        filtered = f"(SELECT * FROM ({_TABLE_SQL[name]}) WHERE {DAMAGE.get(name, 'true')})"
        changed = f"{changes.get(name, 'SELECT * FROM')} {filtered}{')' if name == 'payment' else ''}"
        parts.append(f"t_{name} AS MATERIALIZED ({changed})")
    rows = []

    def rule(name: str, table: str, count: str) -> None:
        rows.append(f"SELECT '{name}' AS rule, '{table}' AS table_name, ({count})::BIGINT AS violations")

    unique = [*((name, key) for name, key in KEYS.items()), ("order_line", "order_id, line_no"), ("invoice", "number")]
    for name, key in unique:
        rule(f"{key} is unique", name, f"SELECT count(*) FROM (SELECT {key} FROM t_{name} GROUP BY {key} HAVING count(*) > 1)")
    for child, key, parent in LINKS:
        rule(f"{key} exists in {parent}", child, f"SELECT count(*) FROM t_{child} WHERE {key} NOT IN (SELECT {key} FROM t_{parent})")
    rule("total is the sum of lines", "order_header", """
        SELECT count(*) FROM (SELECT order_id, sum(a) FROM (SELECT order_id, total AS a FROM t_order_header
                              UNION ALL SELECT order_id, -amount FROM t_order_line) GROUP BY 1 HAVING sum(a) <> 0)""")
    rule("documents add up to zero", "journal_line",
         "SELECT count(*) FROM (SELECT doc_id FROM t_journal_line GROUP BY 1 HAVING sum(amount) <> 0)")
    for child, on, parent, before, after in DATES:
        rule(f"{after} is not before {before}", child,
             f"SELECT count(DISTINCT c.{on}) FROM t_{child} c JOIN t_{parent} p ON c.{on} = p.{on} WHERE c.{after} < p.{before}")
    rule("qty in [1, 10]", "order_line", "SELECT count(*) FROM t_order_line WHERE qty NOT BETWEEN 1 AND 10")
    rule("amount is positive", "order_line", "SELECT count(*) FROM t_order_line WHERE amount <= 0")
    rule("status in (open, shipped, invoiced, paid)", "order_header",
         "SELECT count(*) FROM t_order_header WHERE status NOT IN ('open', 'shipped', 'invoiced', 'paid')")
    rule("order_date is not null", "order_header", "SELECT count(*) FROM t_order_header WHERE order_date IS NULL")
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(rows)}"


@register.add("check_written", _damaged_sql())
def check_written(spark: SparkSession, folder: str) -> DataFrame:
    """All twelve tables, some damaged, written and checked on the way: all rules and what breaks them."""
    _, found = write_validated(damaged(_tables(spark, folder)), work_dir(spark, "checked"), {"journal_line": ["line_no"]})
    return found


@register.add(
    "trial_balance",
    f"""
    WITH {_PAID}, j AS ({_journal_sql()}),
    m AS (SELECT account_id, strftime(posted, '%Y-%m') AS period, amount FROM j)
    SELECT account_id, period,
           (2 - bit_count(grouping_id(account_id, period)::INTEGER))::BIGINT AS depth,
           sum(CASE WHEN amount > 0 THEN amount ELSE 0 END)::BIGINT AS debit,
           sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END)::BIGINT AS credit, sum(amount)::BIGINT AS balance
    FROM m GROUP BY ROLLUP (account_id, period)
    """,
)
def trial_balance(spark: SparkSession, folder: str) -> DataFrame:
    journal = co.journal_line(spark, co.sized_like(spark, folder), SEED)
    by_month = journal.select("account_id", F.date_format("posted", "yyyy-MM").alias("period"), "amount")
    return _plain(r.trial_balance(by_month, ["account_id", "period"]))


def _late(due: str) -> str:
    return f"date_diff('day', {due}, DATE '{AS_OF}')"


def _ageing_sql(open_items: str) -> str:
    """``open_items`` ends in the table ``a`` of (customer_id, late, owed)."""
    conditions = [f"late <= {r.AGES[0]}"]
    conditions += [f"late > {low} AND late <= {high}" for low, high in zip(r.AGES, r.AGES[1:])]
    conditions += [f"late > {r.AGES[-1]}"]
    sums = ", ".join(
        f"coalesce(sum(owed) FILTER ({condition}), 0)::BIGINT AS {name}"
        for name, condition in zip(r.age_names(), conditions)
    )
    return f"""
    WITH {open_items}
    SELECT customer_id, {sums}, sum(owed)::BIGINT AS open FROM a WHERE owed <> 0 GROUP BY 1
    """


_OWN_SQL = f"""{_PAID},
    a AS (SELECT customer_id, {_late(f'invoice_date + {co.DUE_DAYS}')} AS late,
                 total - CASE WHEN pay_date <= DATE '{AS_OF}' THEN paid ELSE 0 END AS owed
          FROM p WHERE invoice_date <= DATE '{AS_OF}')
    """


@register.add("receivables_ageing", _ageing_sql(_OWN_SQL))
def receivables_ageing(spark: SparkSession, folder: str) -> DataFrame:
    spec = co.sized_like(spark, folder)
    billed = co.with_totals(co.order_facts(spark, spec, SEED).filter(F.col("invoice_date") <= AS_OF), spec, SEED)
    invoices = billed.select(
        F.col("order_id").alias("invoice_id"),
        "customer_id",
        F.date_add("invoice_date", co.DUE_DAYS).alias("due_date"),
        F.col("total").alias("amount"),
    )
    payments = co.payment(spark, spec, SEED).filter(F.col("pay_date") <= AS_OF)
    return r.ageing(invoices, payments, F.lit(AS_OF), ["customer_id"])


# Invoices and payments of a customer as ranges of one line, and where they overlap.
_MET = f"""{_PAID},
    i AS (SELECT customer_id, order_id AS invoice_id, invoice_date + {co.DUE_DAYS} AS due_date, total AS amount,
                 sum(total) OVER (PARTITION BY customer_id ORDER BY invoice_date, order_id) AS upto
          FROM p WHERE invoice_date <= DATE '{AS_OF}'),
    y AS (SELECT customer_id, order_id AS payment_id, paid AS amount,
                 sum(paid) OVER (PARTITION BY customer_id ORDER BY pay_date, order_id) AS upto
          FROM p WHERE pay_date <= DATE '{AS_OF}'),
    met AS (SELECT customer_id, invoice_id, payment_id,
                   least(i.upto, y.upto) - greatest(i.upto - i.amount, y.upto - y.amount) AS amount
            FROM i JOIN y USING (customer_id) WHERE i.upto - i.amount < y.upto AND y.upto - y.amount < i.upto),
    owing AS (SELECT customer_id, invoice_id, due_date, amount - coalesce(paid, 0) AS amount
              FROM i LEFT JOIN (SELECT invoice_id, sum(amount) AS paid FROM met GROUP BY 1) USING (invoice_id)
              WHERE amount > coalesce(paid, 0)),
    spare AS (SELECT customer_id, payment_id, amount - coalesce(used, 0) AS amount
              FROM y LEFT JOIN (SELECT payment_id, sum(amount) AS used FROM met GROUP BY 1) USING (payment_id)
              WHERE amount > coalesce(used, 0))
    """
_SETTLED_SQL = f"""
    WITH {_MET}
    SELECT customer_id, invoice_id, payment_id, amount::BIGINT AS amount FROM met
    UNION ALL SELECT customer_id, invoice_id, NULL, amount::BIGINT FROM owing
    UNION ALL SELECT customer_id, NULL, payment_id, amount::BIGINT FROM spare
    """


def _accounts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Invoices and payments up to AS_OF, each with its customer, which follows from the order's key."""
    spec = co.sized_like(spark, folder)
    # read some eighteen times by a scan in pieces, so made once
    orders = co.keep_orders(spark, spec, SEED, work_dir(spark, "orders"))
    billed = orders.filter(F.col("invoice_date") <= AS_OF)
    due = F.date_add("invoice_date", co.DUE_DAYS).alias("due_date")
    invoices = billed.select("customer_id", F.col("order_id").alias("invoice_id"), due, F.col("total").alias("amount"))
    paid = billed.filter(F.col("pay_date") <= AS_OF).select(
        "customer_id",
        F.col("order_id").alias("payment_id"),
        "pay_date",
        co.paid_amount(SEED, "order_id", F.col("total")).alias("amount"),
    )
    return invoices, paid


@register.add("payments_settled", _SETTLED_SQL)
def payments_settled(spark: SparkSession, folder: str) -> DataFrame:
    """What each payment pays of which invoice when a customer's oldest debts are paid first."""
    return settle(*_accounts(spark, folder), ["customer_id"])


@register.add("payments_settled_split", _SETTLED_SQL)
def payments_settled_split(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the busiest customers scanned in pieces."""
    return settle(*_accounts(spark, folder), ["customer_id"], limits=SPLIT_ITEMS)


@register.add(
    "receivables_ageing_settled",
    _ageing_sql(f"{_MET}, a AS (SELECT customer_id, {_late('due_date')} AS late, amount AS owed FROM owing)"),
)
def receivables_ageing_settled(spark: SparkSession, folder: str) -> DataFrame:
    """Ageing of what stays open when the oldest debts are paid first, not each payment's own invoice."""
    invoices, paid = _accounts(spark, folder)
    met = settle(invoices, paid, ["customer_id"]).filter("invoice_id IS NOT NULL AND payment_id IS NOT NULL")
    return r.ageing(invoices, met, F.lit(AS_OF), ["customer_id"])


@register.add(
    "write_tables",
    f"""
    WITH {_PAID}, i AS ({_INVOICE_SQL})
    SELECT format, year(invoice_date::DATE)::BIGINT AS year, count(*) AS invoices, sum(amount)::BIGINT AS amount,
           min(number) AS first_number, max(due_date) AS last_due
    FROM i, (SELECT unnest({list(FORMATS)}) AS format) GROUP BY 1, 2
    """,
)
def write_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Invoices written in every format, partitioned by year, and read back with their schema."""
    spec = co.sized_like(spark, folder)
    invoices = co.published({"invoice": co.invoice(spark, spec, SEED)})["invoice"]
    dated = invoices.withColumn("year", F.year("invoice_date"))
    base = work_dir(spark, "tables")
    back = None
    for fmt in FORMATS:
        write({"invoice": dated}, f"{base}/{fmt}", fmt, {"invoice": ["year"]})
        schema = dated.schema if fmt in ("csv", "json") else None
        read = read_table(spark, f"{base}/{fmt}", "invoice", fmt, schema)
        summed = read.groupBy(F.lit(fmt).alias("format"), F.col("year").cast("bigint").alias("year")).agg(
            F.count(F.lit(1)).alias("invoices"),
            (F.sum("amount") * 100).cast("bigint").alias("amount"),
            F.min("number").alias("first_number"),
            day(F.max("due_date")).alias("last_due"),
        )
        back = summed if back is None else back.unionByName(summed)
    return back


PARTED = {"order_header": ["company_id"], "journal_line": ["line_no"], "customer": ["country", "segment"]}
_EDITED = {
    "order_header": "company_id <> 1 OR status = 'open'",
    "vendor": "terms_days >= 30",
}


def _published_sql() -> str:
    """Rows and a sum of row hashes of every table, as it was made and as it was edited."""
    rows = []
    for name, sql in _TABLE_SQL.items():
        for version in (1, 2):
            kept = _EDITED.get(name, "true") if version == 2 else "true"
            rows.append(f"""
                SELECT {version}::BIGINT AS version, '{name}' AS name, count(*) AS n,
                       coalesce(sum(('0x' || substr(md5(concat_ws('|', *COLUMNS(*))), 1, 8))::BIGINT), 0)::BIGINT AS hashes
                FROM ({sql}) WHERE {kept}""")
    return " UNION ALL ".join(rows)


@register.add("set_published", _published_sql())
def set_published(spark: SparkSession, folder: str) -> DataFrame:
    """All twelve tables published as one set, two of them edited, and both versions read again, every row hashed."""
    path = work_dir(spark, "published")
    spec = co.sized_like(spark, folder)
    kept = co.keep_orders(spark, spec, SEED, work_dir(spark, "orders"))  # seven of the tables are made of it
    tables = {name: _plain(df) for name, df in co.build(spark, spec, SEED, kept).items()}
    known: dict[str, DataFrame] = {}  # listed once: folders of orders grow in number with the companies
    publish(tables, path, PARTED, known=known)
    first = read_set(spark, path, 1, known)
    publish(
        {
            "order_header": first["order_header"].filter("company_id = 1 AND status = 'open'"),
            "vendor": first["vendor"].filter(_EDITED["vendor"]),
        },
        path,
        PARTED,
        edit=True,
        known=known,
    )
    found = None
    for version in (1, 2):
        for name, df in read_set(spark, path, version, known).items():
            row = F.conv(F.substr(F.md5(F.concat_ws("|", *df.columns).cast("binary")), F.lit(1), F.lit(8)), 16, 10)
            summed = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row.cast("bigint")), F.lit(0)).alias("hashes"))
            summed = summed.select(F.lit(version).cast("bigint").alias("version"), F.lit(name).alias("name"), "n", "hashes")
            found = summed if found is None else found.unionByName(summed)
    return found


@register.add(
    "stream_generate",
    f"""
    SELECT o_orderkey AS event_id,
           {q.pick(_s('event', 'kind', 'o_orderkey'), feeds.EVENT_KINDS)} AS kind,
           {q.fk(_s('event', 'customer', 'o_orderkey'), '(SELECT count(*) FROM customer)', 2.0)} AS customer_id,
           {q.whole(_s('event', 'amount', 'o_orderkey'), 100, 99_999)} AS amount_cents
    FROM orders
    """,
)
def stream_generate(spark: SparkSession, folder: str) -> DataFrame:
    """The generator on a stream of order keys; ``feeds.stream`` puts it on an endless one."""
    orders = feeds.replay(spark, folder, "orders")
    customers = given(spark, folder, "customer").count()
    made = feeds.business_events(orders, "o_orderkey", SEED, customers, F.col("o_orderdate").cast("timestamp"))
    return feeds.run_append(made, "generated").drop("ts")


def _feed(spark: SparkSession, folder: str) -> DataFrame:
    return feeds.replay(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@register.add(
    "stream_window_counts",
    f"""
    SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n,
           sum({q.cents('value')})::BIGINT AS value_cents
    FROM events GROUP BY 1, 2
    """,
)
def stream_window_counts(spark: SparkSession, folder: str) -> DataFrame:
    amount = F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("value_cents")
    counted = feeds.windowed(
        _feed(spark, folder), "ts", "1 hour", "10 minutes", ["event_type"], F.count(F.lit(1)).alias("n"), amount
    )
    latest = feeds.run_latest(counted, "windows", ["window", "event_type"])
    hour = F.date_format(F.col("window.start"), "yyyy-MM-dd HH:mm")
    return latest.select(hour.alias("hour"), "event_type", "n", "value_cents")


@register.add(
    "stream_dedup",
    f"SELECT DISTINCT event_id, user_id, event_type, {q.cents('value')} AS value_cents FROM events",
)
def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """A feed that delivers everything twice, freed of its repeats."""
    twice = _feed(spark, folder).unionByName(_feed(spark, folder))
    once = feeds.dedup(twice, "event_id", "ts", "1 hour")
    amount = F.round(F.col("value") * 100).cast("bigint").alias("value_cents")
    return feeds.run_append(once.select("event_id", "user_id", "event_type", amount), "deduplicated")
