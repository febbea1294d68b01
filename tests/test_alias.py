"""The alias table gives every value exactly its weight, whatever the weights and the way the table is made."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.draws import draw
from ledgerloom.operators.alias import alias_choice, alias_table
from ledgerloom.operators.spread import Limits
from tests.conftest import plan


def parts(rows):
    held = Counter()
    for r in rows:
        assert 0 <= r["own"] <= r["full"] and (r["alias"] is not None) == (r["own"] < r["full"])
        held[r["value"]] += r["own"]
        if r["alias"] is not None:
            held[r["alias"]] += r["full"] - r["own"]
    return held


@pytest.mark.parametrize("limits", [Limits(), Limits(heavy_rows=5)])
def test_every_value_has_its_weight(spark, limits):
    r = random.Random(3)
    weights = [[1], [5, 5, 5], [1, 9], [9, 1], [1] * 30 + [1000], [1000] + [1] * 30, [r.randint(1, 9) for _ in range(40)],
               [r.randint(0, 3) ** 6 for _ in range(60)] + [7], [2, 2, 2, 6, 3, 3]]
    for own in weights:
        rows = [(f"v{i:03}", w) for i, w in enumerate(own)] + [(None, 4), ("none", None), ("zero", 0)]
        table = alias_table(spark.createDataFrame(rows, "name string, w int"), "name", "w", limits).collect()
        n = sum(w > 0 for w in own)
        assert sorted(r["slot"] for r in table) == list(range(n)) and {r["full"] for r in table} == {sum(own)}
        assert parts(table) == {f"v{i:03}": n * w for i, w in enumerate(own) if w}


def test_draws_follow_the_weights(spark):
    choices = spark.range(1, 201).select(F.col("id").alias("v"), (F.col("id") * F.col("id")).alias("w"))
    rows = spark.range(200_000)
    picked = alias_choice(rows, alias_table(choices, "v", "w"), draw(1, "t", "slot", "id"), draw(1, "t", "place", "id"), ["id"], "v")
    share = {r["v"]: r["count"] / 200_000 for r in picked.groupBy("v").count().collect()}
    total = sum(i * i for i in range(1, 201))
    assert max(abs(share.get(i, 0) - i * i / total) for i in range(1, 201)) < 0.0015


def test_no_search_in_the_plan(spark, capsys):
    choices = spark.range(1, 5000).select(F.col("id").alias("v"), (F.col("id") % 7 + 1).alias("w"))
    table = alias_table(choices, "v", "w")
    few = Limits(broadcast_rows=10)
    text = plan(alias_choice(spark.range(1000), table, draw(1, "t", "a", "id"), draw(1, "t", "b", "id"), ["id"], "v", few), capsys)
    assert "NestedLoop" not in text and "Cartesian" not in text and "Join" in text


def test_nothing_to_choose_is_refused(spark):
    with pytest.raises(ValueError, match="no v has"):
        alias_table(spark.createDataFrame([(1, 0)], "v long, w long"), "v", "w")
    with pytest.raises(ValueError, match="below"):
        alias_table(spark.createDataFrame([(1, 2**62), (2, 2**61)], "v long, w long"), "v", "w")
