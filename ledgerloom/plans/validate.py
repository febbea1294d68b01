"""Runs the checks over a whole set of business tables."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ledgerloom.operators import checks as c
from ledgerloom.sources.tables import write


@dataclass(frozen=True)
class Finding:
    """Names a check's result. ``count`` says what adds up to the violations: its ``rows``, a
    column of counts, or ``domain`` for a result that already has one row per rule."""

    rule: str
    table: str
    count: str = "rows"


def findings(results: Mapping[Finding, DataFrame]) -> DataFrame:
    """(rule, table_name, violations) from check results; one row per rule."""
    parts = []
    for finding, df in results.items():
        table = F.lit(finding.table).alias("table_name")
        if finding.count == "domain":
            parts.append(df.select("rule", table, "violations"))
            continue
        amount = F.count(F.lit(1)) if finding.count == "rows" else F.coalesce(F.sum(finding.count), F.lit(0))
        parts.append(df.agg(F.lit(finding.rule).alias("rule"), table, amount.cast("bigint").alias("violations")))
    return reduce(DataFrame.unionByName, parts)


KEYS = {
    "company": "company_id",
    "account": "account_id",
    "customer": "customer_id",
    "vendor": "vendor_id",
    "item": "item_id",
    "order_header": "order_id",
    "shipment": "shipment_id",
    "invoice": "invoice_id",
    "payment": "payment_id",
    "stock_move": "move_id",
}

LINKS = (
    ("account", "company_id", "company"),
    ("order_header", "company_id", "company"),
    ("order_header", "customer_id", "customer"),
    ("order_line", "order_id", "order_header"),
    ("order_line", "item_id", "item"),
    ("shipment", "order_id", "order_header"),
    ("invoice", "order_id", "order_header"),
    ("payment", "invoice_id", "invoice"),
    ("journal_line", "account_id", "account"),
    ("stock_move", "item_id", "item"),
)


DATES = (
    ("shipment", "order_id", "order_header", "order_date", "ship_date"),
    ("invoice", "order_id", "shipment", "ship_date", "invoice_date"),
    ("payment", "invoice_id", "invoice", "invoice_date", "pay_date"),
)


ROW_RULES: Mapping[str, Callable[[], list[c.Rule]]] = {
    "order_line": lambda: [c.in_range("qty", 1, 10), c.Rule("amount is positive", F.col("amount") <= 0)],
    "order_header": lambda: [c.one_of("status", "open", "shipped", "invoiced", "paid"), c.not_null("order_date")],
}
# table -> (column -> (kind, measure)) that rules about a key look at
MEASURES = {
    ("order_id", "order_header"): {"total": ("sum", "total"), "order_date": ("max", "order_date")},
    ("order_id", "order_line"): {"amount": ("sum", "amount")},
    ("order_id", "shipment"): {"first_date": ("min", "ship_date"), "ship_date": ("max", "ship_date")},
    ("order_id", "invoice"): {"first_date": ("min", "invoice_date")},
    ("invoice_id", "invoice"): {"invoice_date": ("max", "invoice_date")},
    ("invoice_id", "payment"): {"first_date": ("min", "pay_date")},
    ("doc_id", "journal_line"): {"amount": ("sum", "amount")},
}


def key_checks() -> dict[tuple[str, ...], list[tuple[c.KeyRule, tuple[str, ...]]]]:
    """All rules about keys, by key columns, each with the tables it needs."""
    found: dict[tuple[str, ...], list[tuple[c.KeyRule, tuple[str, ...]]]] = {}

    def add(key: Collection[str], rule: c.KeyRule, *needed: str) -> None:
        found.setdefault(tuple(key), []).append((rule, needed))

    for name, key in KEYS.items():
        add([key], c.unique_key(name, f"{key} is unique"), name)
    add(["order_id", "line_no"], c.unique_key("order_line", "order_id, line_no is unique"), "order_line")
    add(["number"], c.unique_key("invoice", "number is unique"), "invoice")
    for child, key, parent in LINKS:
        add([key], c.known_key(child, parent, f"{key} exists in {parent}"), child, parent)
    total = c.same_sum("order_header", "total", "order_line", "amount", "total is the sum of lines")
    add(["order_id"], total, "order_header", "order_line")
    add(["doc_id"], c.zero_sum("journal_line", "amount", "documents add up to zero"), "journal_line")
    for child, on, parent, before, after in DATES:
        rule = c.not_before(child, "first_date", parent, before, f"{after} is not before {before}")
        add([on], rule, child, parent)
    return found


def check_keys(tables: Mapping[str, DataFrame], only: Collection[tuple[str, str]] | None = None) -> list[DataFrame]:
    """The rules about keys, one grouping for each key with all its rules, each table read once in it."""
    results = []
    for key, rules in key_checks().items():
        rules = [(rule, needed) for rule, needed in rules if only is None or (rule.table, rule.name) in only]
        names = dict.fromkeys(name for _, needed in rules for name in needed)
        sides = [c.Side(name, tables[name], key, MEASURES.get((key[0], name), {}) if len(key) == 1 else {}) for name in names]
        if rules:
            results.append(c.key_rules(sides, [rule for rule, _ in rules]))
    return results


def validate(tables: Mapping[str, DataFrame], only: Collection[tuple[str, str]] | None = None) -> DataFrame:
    """Keys, references, document sums, date order and value ranges of generated tables.

    (rule, table_name, violations), one row per rule. All rules about one key share one grouping, and
    all rules about rows of a table one scan. ``only`` names the (table, rule) pairs to check,
    all of them by default; the ranges of a table are one rule named ``values``.
    """
    ranges = {
        Finding("values", name, "domain"): c.domain(tables[name], rules())
        for name, rules in ROW_RULES.items()
        if only is None or (name, "values") in only
    }
    results = check_keys(tables, only) + ([findings(ranges)] if ranges else [])
    return reduce(DataFrame.unionByName, results)


def write_validated(
    tables: Mapping[str, DataFrame], path: str, by: Mapping[str, Sequence[str]] | None = None
) -> tuple[dict[str, str], DataFrame]:
    """Writes a set of tables as Parquet and checks it on the way: (folders, findings as of ``validate``).

    Rules about rows are counted by the tasks that write them. Rules about keys read the few
    columns they need of what was written, once for each key, so no table is made a second time.
    """
    watch, rules = {}, {}
    for name, made in ROW_RULES.items():
        rules[name] = made()
        counts = [F.count_if(rule.broken).alias(f"r{i}") for i, rule in enumerate(rules[name])]
        watch[name] = (Observation(f"values of {name}"), counts)
    folders = write(tables, path, by=by, watch=watch)
    seen = [
        (rule.name, name, watch[name][0].get[f"r{i}"]) for name, own in rules.items() for i, rule in enumerate(own)
    ]
    spark = next(iter(tables.values())).sparkSession
    ranges = spark.createDataFrame(seen, "rule string, table_name string, violations bigint")
    written = {name: spark.read.schema(df.schema).parquet(folders[name]) for name, df in tables.items()}
    return folders, reduce(DataFrame.unionByName, [*check_keys(written), ranges])
