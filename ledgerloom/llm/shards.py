"""Sharding over fixed virtual slots: records hash to slots, an edited and versioned map sends slots to shards."""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import settled, text_of
from ledgerloom.session import work_dir

SLOTS = 4096
OVERHEAD = 8  # bytes that a record takes besides its text


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 0: the shard of each slot, before anything is known of the data."""
    return [slot % shards for slot in range(slots)]


def rebalance(where: Sequence[int], load: Mapping[int, int], shards: int, moves: int = 10_000) -> list[int]:
    """The next version of a map: slots moved or swapped between the fullest and the emptiest
    shard until no such edit brings the two closer. ``load`` has the bytes of each slot; only
    slots and shards are looped over, never records. ``moves`` bounds the edits, each of which
    shrinks the difference; what is left of it is then simply larger.
    """
    where = list(where)
    inside: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(where):
        inside[shard].append((load.get(slot, 0), slot))
    for own in inside:
        own.sort()
    total = [sum(size for size, _ in own) for own in inside]
    for _ in range(moves):
        order = sorted(range(shards), key=lambda s: (total[s], s))
        low, high = order[0], order[-1]
        gap = total[high] - total[low]
        best: tuple[int, tuple[int, int], tuple[int, int] | None] | None = None
        for give in inside[high]:
            for take in [None, *_near(inside[low], give[0] - gap / 2)]:
                shift = give[0] - (take[0] if take else 0)
                left = abs(gap - 2 * shift)
                if left < gap and (best is None or left < best[0]):
                    best = left, give, take
        if best is None:
            break
        _, give, take = best
        for entry, source, target in ((give, high, low), (take, low, high)):
            if entry:
                inside[source].remove(entry)
                inside[target].insert(bisect_left(inside[target], entry), entry)
                total[source] -= entry[0]
                total[target] += entry[0]
                where[entry[1]] = target
    return where


def _near(entries: list[tuple[int, int]], size: float) -> list[tuple[int, int]]:
    at = bisect_left(entries, (size, -1))
    return entries[max(0, at - 1) : at + 1]


def grown(where: Sequence[int], load: Mapping[int, int], shards: int) -> list[int]:
    """The map for one shard more: the new shard takes slots from the fullest shards, none moves elsewhere."""
    where = list(where)
    share = sum(load.values()) / (shards + 1)
    total = [0] * shards
    inside: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(where):
        total[shard] += load.get(slot, 0)
        inside[shard].append((load.get(slot, 0), slot))
    for own in inside:
        own.sort(reverse=True)
    got = 0
    while got < share:
        fullest = max(range(shards), key=lambda s: (total[s] if inside[s] else -1, -s))
        if not inside[fullest] or total[fullest] <= share:
            break
        size, slot = inside[fullest].pop()
        total[fullest] -= size
        got += size
        where[slot] = shards
    return where


def shrunk(where: Sequence[int], load: Mapping[int, int], shards: int) -> list[int]:
    """The map for fewer shards: the slots of those beyond go to the emptiest ones, none moves elsewhere."""
    where = list(where)
    total = [0] * shards
    for slot, shard in enumerate(where):
        if shard < shards:
            total[shard] += load.get(slot, 0)
    for size, slot in sorted(((load.get(s, 0), s) for s, shard in enumerate(where) if shard >= shards), reverse=True):
        where[slot] = min(range(shards), key=lambda s: (total[s], s))
        total[where[slot]] += size
    return where


def last_version(spark: SparkSession, path: str) -> int | None:
    """The number of the last stored version, None where no map is stored yet."""
    try:
        return spark.read.parquet(path).agg(F.max("version")).head()[0]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def save_map(spark: SparkSession, path: str, version: int, where: Sequence[int], shards: int) -> None:
    """Appends a version (version, shards, slot, shard) to the stored map; only the next one is taken."""
    last = last_version(spark, path)
    if version != (0 if last is None else last + 1):
        raise ValueError(f"version {version} cannot follow version {last} of {path}")
    listed = F.from_json(F.lit(json.dumps(list(where))), "array<int>")
    rows = spark.range(1).select(F.lit(version).alias("version"), F.lit(shards).alias("shards"), F.posexplode(listed).alias("slot", "shard"))
    rows.coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(slot, shard) of a version, or of the last one. A slot that a version names twice is an error."""
    wanted = last_version(spark, path) if version is None else version
    own = spark.read.parquet(path).filter(F.col("version") == wanted).groupBy("slot")
    twice = F.raise_error(F.lit(f"version {wanted} of {path} has a slot twice"))
    return own.agg(F.min("shard").alias("shard"), F.count(F.lit(1)).alias("n")).select(
        "slot", F.when(F.col("n") > 1, twice.cast("int")).otherwise(F.col("shard")).alias("shard")
    )


def next_map(spark: SparkSession, path: str, load: Mapping[int, int], shards: int, slots: int) -> list[int]:
    """Edits the stored map, or the first one, for the bytes that slots hold now, and stores the result.

    With as many shards as before slots are moved until the shards are near equal. With more, new ones
    take slots and no other moves; with fewer, the slots of those left out go to the emptiest.
    """
    version = last_version(spark, path)
    if version is None:
        version, before, where = 0, shards, first_map(shards, slots)
        save_map(spark, path, version, where, shards)
    else:
        rows = spark.read.parquet(path).filter(F.col("version") == version).select("slot", "shard", "shards").collect()  # slots rows
        if sorted(r["slot"] for r in rows) != list(range(slots)):
            raise ValueError(f"version {version} of {path} does not have each of {slots} slots once")
        before, where = rows[0]["shards"], [r["shard"] for r in sorted(rows, key=lambda r: r["slot"])]
    if shards == before:
        where = rebalance(where, load, shards)
    for count in range(before, shards):
        where = grown(where, load, count)
    if shards < before:
        where = shrunk(where, load, shards)
    save_map(spark, path, version + 1, where, shards)
    return where


def records(df: DataFrame, id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and the virtual slot of each row.

    The slot is a hash of id and checksum: rows without id spread by their texts.
    """
    sized = df.select(
        df[id].alias("doc_id"),
        (F.octet_length(text_of(df, text)) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(F.encode(text_of(df, text), "UTF-8")).alias("text_crc32"),
    )
    return sized.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def shard(
    df: DataFrame, shards: int, id: str = "doc_id", text: str = "text", slots: int = SLOTS, path: str | None = None
) -> DataFrame:
    """Every row's shard under the law ``bytes``, with its place in the shard (0, 1, ...).

    Rows are hashed to ``slots`` virtual slots, the bytes of each slot are summed, and the map stored
    in ``path`` (a fresh folder if None) gets one version more, an edit of its last: as many shards as
    before are rebalanced, a new shard only takes slots. A slot stays where it is unless it is
    moved, so calls over a growing table move little. Only (slot, bytes, rows) reaches the driver:
    ``slots`` rows, whatever the input. Places are numbered within a slot, behind the rows of the
    shard's lower slots, so no task holds a whole shard. The groups that may be large are those of
    equal texts: their rows have different ids, and so spread over all slots.

    A null text has no bytes but the overhead. Repeated rows each get a place; their order among
    each other is open. An empty table gives no rows, and the map of version 0 stays. Extra
    columns are ignored.
    """
    spark = df.sparkSession
    path = path or work_dir(spark, "slot-map")
    sized = settled(records(df, id, text, slots), "records")
    loads = settled(sized.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "loads")
    load = {r["virtual_slot"]: r["bytes"] for r in loads.collect()}
    next_map(spark, path, load, shards, slots)
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    places = loads.join(load_map(spark, path).withColumnRenamed("slot", "virtual_slot"), "virtual_slot").select(
        "virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first")
    )
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32")
    return (
        sized.withColumn("place", F.row_number().over(inside) - 1)
        .join(F.broadcast(places), "virtual_slot")  # one row per slot
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("first") + F.col("place")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
        )
    )
