"""Sets of tables: versions, replaced partitions, killed writes, pruning by a joined key."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import sets
from ledgerloom.sources.sets import last_version, manifest, publish, read_set
from tests.conftest import plan, rows


@pytest.fixture
def facts(spark):
    return spark.range(60).select(
        "id", (F.col("id") % 6).cast("int").alias("year"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("a b/"), F.col("id") % 4)).alias("kind")
    )


@pytest.fixture
def names(spark):
    return spark.range(6).select(F.col("id").cast("int").alias("year"), F.concat(F.lit("y"), "id").alias("label"))


def test_versions_and_replaced_partitions(spark, tmp_path, facts, names):
    path = f"{tmp_path}/set/"
    by = {"facts": ["year", "kind"]}
    assert last_version(spark, path) == 0
    assert publish({"facts": facts, "names": names}, path, by) == 1
    fresh = facts.filter("year IN (1, 2)").withColumn("id", F.col("id") + 1000)
    assert publish({"facts": fresh}, path, by, edit=True) == 2
    again = facts.filter("year = 2").withColumn("id", F.col("id") + 2000)
    assert publish({"facts": again, "names": names.limit(2)}, path, by, edit=True) == 3
    kept = facts.filter("year NOT IN (1, 2)")
    assert rows(read_set(spark, path, 1)["facts"]) == rows(facts)
    assert rows(read_set(spark, path, 2)["facts"]) == rows(kept.unionAll(fresh))
    now = read_set(spark, path)
    assert rows(now["facts"]) == rows(kept.unionAll(fresh.filter("year = 1")).unionAll(again))
    assert now["facts"].schema.names == facts.schema.names and now["facts"].dtypes == facts.dtypes
    assert now["names"].count() == 2 and read_set(spark, path, 2)["names"].count() == 6
    assert publish({"names": names}, path) == 4
    assert set(read_set(spark, path)) == {"names"}
    live = manifest(spark, path).filter("version = 3").groupBy("name").agg(F.sum("rows")).collect()
    assert dict(map(tuple, live)) == {"facts": 60, "names": 2}


def test_killed_write_leaves_the_old_set(spark, tmp_path, facts, names, monkeypatch):
    path = f"{tmp_path}/set"
    publish({"facts": facts, "names": names}, path, {"facts": ["year"]})
    broken = names.withColumn("label", F.when(F.col("year") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("label")))
    with pytest.raises(Exception, match="lost"):
        publish({"facts": facts.limit(3), "names": broken}, path, {"facts": ["year"]})
    assert last_version(spark, path) == 1
    assert rows(read_set(spark, path)["facts"]) == rows(facts)
    # all data written, killed before the manifest
    monkeypatch.setattr(sets, "ENTRY", "nothing")
    monkeypatch.setattr(sets, "last_version", lambda *_: 1)
    with pytest.raises(Exception):
        publish({"facts": facts.limit(3)}, path, {"facts": ["year"]})
    monkeypatch.undo()
    assert last_version(spark, path) == 1 and rows(read_set(spark, path)["names"]) == rows(names)


def test_two_writers_of_a_version_are_told(spark, tmp_path, names):
    path = f"{tmp_path}/set"
    publish({"names": names}, path)
    other = manifest(spark, path).withColumn("writer", F.lit("other"))
    other.write.mode("append").partitionBy("version").parquet(f"{path}/sets")
    with pytest.raises(ValueError, match="twice"):
        read_set(spark, path)


def test_a_joined_key_prunes_partitions(spark, tmp_path, facts, names, capsys):
    path = f"{tmp_path}/set"
    publish({"facts": facts, "names": names}, path, {"facts": ["year"]})
    tables = read_set(spark, path)
    wanted = tables["names"].filter("label = 'y3'")
    joined = tables["facts"].join(wanted, "year")
    assert "dynamicpruning" in plan(joined, capsys)
    assert joined.count() == 10
    assert "PartitionFilters: [isnotnull(year" in plan(tables["facts"].filter("year = 3"), capsys)


def test_empty_tables_and_wrong_edits(spark, tmp_path, facts, names):
    path = f"{tmp_path}/set"
    with pytest.raises(ValueError, match="no version"):
        read_set(spark, path)
    with pytest.raises(ValueError, match="one table"):
        publish({}, path)
    publish({"facts": facts.filter("false"), "names": names.filter("false")}, path, {"facts": ["year"]})
    assert {n: t.count() for n, t in read_set(spark, path).items()} == {"facts": 0, "names": 0}
    publish({"facts": facts}, path, {"facts": ["year"]}, edit=True)
    assert {n: t.count() for n, t in read_set(spark, path).items()} == {"facts": 60, "names": 0}
    with pytest.raises(ValueError, match="other columns"):
        publish({"facts": facts.drop("kind")}, path, {"facts": ["year"]}, edit=True)


def test_folders_are_listed_once_for_all_versions(spark, tmp_path, facts, names, monkeypatch):
    from pyspark.sql.readwriter import DataFrameReader

    path, by, known, listed = f"{tmp_path}/set", {"facts": ["year", "kind"]}, {}, []
    read = DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, p, **o: (listed.append(p), read(self, p, **o))[1])
    publish({"facts": facts, "names": names}, path, by, known=known)
    publish({"facts": facts.filter("year = 2").limit(1)}, path, by, edit=True, known=known)
    sets_read = [read_set(spark, path, v, known) for v in (1, 2, 1, None)]
    data = [p for p in listed if "/data/" in p]
    assert len(data) == len(set(data)) == 3
    for v, tables in zip((1, 2, 1, None), sets_read):
        assert {n: rows(t) for n, t in tables.items()} == {n: rows(t) for n, t in read_set(spark, path, v).items()}
