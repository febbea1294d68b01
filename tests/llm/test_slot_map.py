"""The stored slot map: used again, edited, grown and shrunk; versions and slots are there once."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import shards


def places(df):
    return {r["doc_id"]: (r["virtual_slot"], r["shard"]) for r in df.collect()}


def sound(df, rows, count):
    got = df.toPandas()
    assert len(got) == rows and sorted(got.shard.unique()) == list(range(count))
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))


def test_calls_with_one_path_edit_the_map(spark, folder, tmp_path):
    path, docs = str(tmp_path / "map"), spark.read.parquet(f"{folder}/documents.parquet")
    n = docs.count()
    made = []
    for count in (24, 24, 25, 23):
        made.append(shards.shard(docs, count, path=path))
        sound(made[-1], n, count)
    stored = spark.read.parquet(path)
    versions = stored.groupBy("version").agg(F.count("*"), F.countDistinct("slot"), F.max("shards")).sort("version").collect()
    assert [tuple(v) for v in versions] == [(v, shards.SLOTS, shards.SLOTS, c) for v, c in enumerate((24, 24, 24, 25, 23))]
    first, again, more, fewer = map(places, made)
    assert first == again  # what is in balance stays
    assert {s for _, s in more.values()} - {s for _, s in again.values()} == {24}
    assert all(more[i] == again[i] or more[i][1] == 24 for i in again)
    assert all(fewer[i] == more[i] or more[i][1] >= 23 for i in more)


def test_a_growing_table_moves_little(spark, folder, tmp_path):
    path, docs = str(tmp_path / "map"), spark.read.parquet(f"{folder}/documents.parquet").filter("length(text) < 2000")
    before = places(shards.shard(docs.filter("doc_id % 10 <> 0"), 6, path=path))
    after = places(shards.shard(docs, 6, path=path))
    moved = sum(after[i] != before[i] for i in before)
    assert 0 < len(before) and moved <= 0.3 * len(before)


def test_versions_are_stored_once(spark, tmp_path):
    path = str(tmp_path / "map")
    with pytest.raises(ValueError, match="cannot follow"):
        shards.save_map(spark, path, 1, [0, 1], 2)
    shards.save_map(spark, path, 0, [0, 1], 2)
    with pytest.raises(ValueError, match="cannot follow"):
        shards.save_map(spark, path, 0, [0, 1], 2)
    spark.createDataFrame([(0, 2, 1, 0)], "version int, shards int, slot int, shard int").write.mode("append").parquet(path)
    with pytest.raises(Exception, match="slot twice"):
        shards.load_map(spark, path).collect()
    with pytest.raises(ValueError, match="each of 2 slots once"):
        shards.next_map(spark, path, {}, 2, 2)


def test_shrinking_moves_only_the_slots_left_out():
    load = {slot: 1 + slot % 5 for slot in range(300)}
    old = shards.first_map(6, 300)
    new = shards.shrunk(old, load, 4)
    assert set(new) == set(range(4)) and all(b == a for a, b in zip(old, new) if a < 4)
    total = [sum(load[s] for s in range(300) if new[s] == k) for k in range(4)]
    assert max(total) - min(total) <= 5
