"""All rules about a key in one grouping, and rules about rows counted by the tasks that write them."""

import datetime as dt
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from ledgerloom.operators import checks as c
from ledgerloom.plans import company as co
from ledgerloom.plans.trading import damaged
from ledgerloom.plans.validate import check_keys, key_checks, validate, write_validated
from tests.conftest import plan, rows

SPEC = co.Spec(companies=2, customers=60, vendors=10, items=40, orders=400)
DAY = dt.date(2024, 1, 1)


def day(n):
    return None if n is None else DAY + dt.timedelta(days=n)


def made(seed):
    r = random.Random(seed)
    heads = [(r.choice([*range(30), None]), r.choice([0, 5, 9, None]), day(r.choice([0, 3, 8, None]))) for _ in range(25)]
    lines = [(r.choice([*range(25, 40), 3, 3, 3, None]), r.choice([1, 4, 5, None]), day(r.choice([2, 5, None]))) for _ in range(60)]
    return heads, lines


def brute(heads, lines):
    known = {k for k, *_ in heads if k is not None}
    got = {"unique": sum(n > 1 for n in Counter(k for k, *_ in heads).values())}
    got["known"] = sum(k is not None and k not in known for k, *_ in lines)
    keys = {k for k, *_ in heads + lines}
    total = {k: sum(v or 0 for i, v, _ in heads if i == k) - sum(v or 0 for i, v, _ in lines if i == k) for k in keys}
    got["same"] = sum(v != 0 for v in total.values())
    got["zero"] = sum(sum(v or 0 for i, v, _ in lines if i == k) != 0 for k in {k for k, *_ in lines})
    late = {k: max((d for i, _, d in heads if i == k and d), default=None) for k in known}
    early = {k: min((d for i, _, d in lines if i == k and d), default=None) for k in known}
    got["dated"] = sum(late[k] is not None and early[k] is not None and early[k] < late[k] for k in known)
    return got


def test_rules_of_a_key_against_brute_force(spark):
    for seed in range(4):
        heads, lines = made(seed)
        head = spark.createDataFrame(heads, "id long, total long, day date").repartition(3)
        line = spark.createDataFrame(lines, "ref long, amount long, day date")
        sides = [
            c.Side("head", head, ["id"], {"total": ("sum", "total"), "last": ("max", "day")}),
            c.Side("line", line, ["ref"], {"amount": ("sum", F.col("amount") * 1), "first": ("min", "day")}),
        ]
        rules = [
            c.unique_key("head", "unique"), c.known_key("line", "head", "known"), c.zero_sum("line", "amount", "zero"),
            c.same_sum("head", "total", "line", "amount", "same"), c.not_before("line", "first", "head", "last", "dated"),
        ]
        found = c.key_rules(sides, rules)
        assert {r["rule"]: r["violations"] for r in found.collect()} == brute(heads, lines)
    empty = [c.Side(s.table, s.df.filter("false"), s.key, s.measures) for s in sides]
    assert {r["violations"] for r in c.key_rules(empty, rules).collect()} == {0}


def test_each_key_takes_one_shuffle_of_sums(spark, tmp_path, capsys):
    folders, _ = write_validated(co.build(spark, SPEC, 4), str(tmp_path / "set"))
    tables = {name: spark.read.parquet(path) for name, path in folders.items()}
    for found, (key, own) in zip(check_keys(tables), key_checks().items(), strict=True):
        text = plan(found, capsys)
        names = {name for _, needed in own for name in needed}
        assert len(re.findall(r"Exchange hashpartitioning", text)) == 1 and "Join" not in text
        assert len(re.findall(r"FileScan parquet", text)) == len(names)
        assert text.rindex("partial_sum") > text.index("Exchange hashpartitioning")  # below it: before the shuffle


def test_checked_while_written_as_when_checked_afterwards(spark, tmp_path):
    tables = damaged(co.build(spark, SPEC, 4))
    folders, found = write_validated(tables, str(tmp_path / "set"), {"order_line": ["line_no"]})
    again = validate({name: spark.read.schema(tables[name].schema).parquet(path) for name, path in folders.items()})
    assert rows(found) == rows(again) and found.filter("violations > 0").count() == 6
    assert spark.read.parquet(folders["order_line"]).count() == tables["order_line"].count()
