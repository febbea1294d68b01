"""Filter interaction audit: what each filter removes in every order, kept up to date by a stream with retractions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import permutations
from math import ceil

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.llm.common import SPACES, table, text_of, words_of
from ledgerloom.session import work_dir
from ledgerloom.streaming.feeds import replay

FILTERS = "ABCDE"  # filter i fails with bit 2**i of a mask
COPY = 16  # the bit of E, the only filter that looks at other rows
MIN_WORDS = 200
MIN_DISTINCT = 50  # percent of words
MAX_CAPITALS = 2  # percent of code points
SYMBOLS = r"[#$%&*|]"
BATCHES = 8  # micro-batches that the files of a table are dealt out to
SLOT_ROWS = 2_000  # texts whose states lie together
CHUNK_ROWS = 50_000  # rows that a task sums before it sends them on
LAST_ID = 2**63 - 1  # rows without id come after all others
SIGN = ["part", "mask", "good", "toxic"]
CELLS = "part string, mask int, good int, toxic int, n long"
HELD = pa.schema([("key", pa.binary()), ("id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()),
                  ("good", pa.int32()), ("toxic", pa.int32()), ("n", pa.int64())])


def own_mask(text: Column) -> Column:
    """The filters A to D that a text fails, as bits; each hangs on the text alone."""
    words = words_of(text)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [
        F.size(words) < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * F.size(words),
        100 * capitals > MAX_CAPITALS * F.length(text),
        text.rlike(SYMBOLS),
    ]
    bits = [F.when(fail, F.lit(2**i)).otherwise(F.lit(0)) for i, fail in enumerate(fails)]
    return (bits[0] + bits[1] + bits[2] + bits[3]).cast("int")


def marked(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows (key, id, part, mask, good, toxic), without texts: the key is the text's SHA-256.

    ``docs`` may be a stream. Of several labels of one id a 1 counts.
    """
    value = text_of(docs, text)
    rows = docs.select(
        F.unhex(F.sha2(value, 256)).alias("key"),
        F.coalesce(docs[id].cast("long"), F.lit(LAST_ID)).alias("id"),
        F.coalesce(docs[source].cast("string"), F.lit("")).alias("part"),
        own_mask(value).alias("mask"),
    )
    known = labels.filter(labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].cast("long").alias("id"))
    known = known.agg(*[F.max(F.coalesce((labels[n] == 1).cast("int"), F.lit(0))).alias(to) for n, to in (("quality", "good"), ("toxic", "toxic"))])
    none = F.lit(0)
    return rows.join(known, "id", "left").select("key", "id", "part", "mask", F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"))


def summed(rows: DataFrame) -> DataFrame:
    """Per task: rows with a key name the smallest id of a text in the task and how many rows have
    it; rows without a key count all documents. So however many copies a text has, a task
    sends on one row of it for each chunk, and per part."""

    def total(chunk: pa.Table) -> Iterator[pa.RecordBatch]:
        each = chunk.group_by(SIGN).aggregate([("id", "count")]).rename_columns([*SIGN, "n"])
        none = {"key": pa.nulls(len(each), pa.binary()), "id": pa.repeat(0, len(each))}  # a null would turn ids into doubles
        yield from pa.Table.from_pydict(none | {c: each[c] for c in [*SIGN, "n"]}).cast(HELD).to_batches()
        least = chunk.group_by("key").aggregate([("id", "min")]).rename_columns(["key", "id"])
        first = chunk.join(least, ["key", "id"], join_type="inner").group_by(["key", "id", *SIGN]).aggregate([([], "count_all")])
        yield from first.rename_columns(["key", "id", *SIGN, "n"]).select(HELD.names).cast(HELD).to_batches()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= CHUNK_ROWS:
                yield from total(pa.Table.from_batches(waiting))
                waiting = []
        if sum(b.num_rows for b in waiting):
            yield from total(pa.Table.from_batches(waiting))

    return rows.mapInArrow(sums, f"key binary, id long, {CELLS}")


def _step(rows: pd.DataFrame, held: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """New rows of a slot against the smallest ids held there: (changes of the counters, what is held then).

    Every row is first counted as a copy; the rows with the smallest id of their text take that
    back. Where a smaller id arrives, the rows that held the text become copies again.
    """
    counted = rows[rows["key"].isna()]
    both = pd.concat([held, rows[rows["key"].notna()]], ignore_index=True).astype({"id": "int64"})
    least = both.groupby("key", sort=False)["id"].transform("min") if len(both) else both["id"]
    kept = both[both["id"] == least].groupby(["key", "id", *SIGN], sort=False, as_index=False)["n"].sum()
    change = pd.concat([kept, held.assign(n=-held["n"])]).groupby(SIGN, sort=False, as_index=False)["n"].sum()
    change = change[change["n"] != 0]
    copies = change.assign(mask=change["mask"] | COPY, n=-change["n"])
    parts = [counted.assign(mask=counted["mask"] | COPY), change, copies]
    return pd.concat([p[[*SIGN, "n"]] for p in parts if len(p)] or [change[[*SIGN, "n"]]]), kept


def _packed(held: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    data = pa.Table.from_pandas(held[HELD.names], schema=HELD, preserve_index=False)
    with pa.ipc.new_stream(sink, HELD) as writer:
        writer.write_table(data)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes | None) -> pd.DataFrame:
    if data is None:
        return HELD.empty_table().to_pandas()
    return pa.ipc.open_stream(data).read_all().to_pandas()


def follow(slot: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One slot of texts in one micro-batch; the state has the smallest id of each of its texts."""
    held = _unpacked(state.get[0] if state.exists else None)
    change, held = _step(pd.concat(list(frames), ignore_index=True), held)
    state.update((_packed(held),))
    yield change.astype({"mask": "int32", "good": "int32", "toxic": "int32", "n": "int64"})


def counters(
    feed: DataFrame, labels: DataFrame, slots: int, folder: str | None = None,
    id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a part fail exactly the filters of a mask.

    Runs ``feed``, a stream of documents, over all files there are, in micro-batches. Each batch
    adds to the counters what it changes; a text's smallest id so far is keyed state, and
    when a smaller one arrives the mask of the earlier one is taken back and counted
    anew as that of a copy. States lie in ``slots`` groups by the text's hash, some
    SLOT_ROWS texts each, and copies of a text are summed before they are sent there, so
    no group grows with the copies of one text. A batch that is repeated after a fault overwrites
    its own changes. With ``folder`` a later call goes on where the last one ended, over new files
    alone; ``slots`` has to stay the same then.
    """
    spark = feed.sparkSession
    folder = folder or work_dir(spark, "audit")
    spark.createDataFrame([], CELLS).write.mode("ignore").parquet(f"{folder}/changes/batch=-1")
    rows = summed(marked(feed, labels, id, text, source))
    placed = rows.withColumn("slot", F.pmod(F.xxhash64(F.coalesce("key", F.encode("part", "UTF-8"))), F.lit(slots)).cast("int"))
    changes = placed.groupBy("slot").applyInPandasWithState(follow, CELLS, "held binary", "update", GroupStateTimeout.NoTimeout)

    def store(batch: DataFrame, number: int) -> None:
        added = batch.groupBy(*SIGN).agg(F.sum("n").alias("n")).filter("n <> 0")
        added.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    running = changes.writeStream.foreachBatch(store).outputMode("update").trigger(availableNow=True)
    running.option("checkpointLocation", f"{folder}/checkpoint").start().awaitTermination()
    stored = spark.read.schema(f"{CELLS}, batch int").option("basePath", f"{folder}/changes").parquet(f"{folder}/changes")
    return stored.groupBy(*SIGN).agg(F.sum("n").alias("n")).filter("n <> 0")


def orders() -> list[dict]:
    """All steps of all orders of the filters, with the bits of the step's filter and of those before it."""
    found = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, i in enumerate(order, 1):
            name = "".join(FILTERS[j] for j in order)
            found.append({"filter_order": name, "step": step, "own": 2**i, "before": before})
            before |= 2**i
    return found


def report(cells: DataFrame) -> DataFrame:
    """One row per part, filter order and step from the counters of :func:`counters`.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley. A document that fails f filters is removed by each of them in
    120 / f of the 120 orders. At most 32 sums a part go into its 600 rows.
    """
    n = F.col("n")
    each = cells.groupBy("part", "mask").agg(
        F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic")
    )
    parts = each.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    steps = F.from_json(F.lit(json.dumps(orders())), "array<struct<filter_order string, step int, own int, before int>>")
    rows = parts.select("part", "cells", F.explode(steps).alias("o")).select("part", "cells", "o.*")
    own, before = F.col("own"), F.col("before")

    def total(value: Callable[[Column], Column], when: Callable[[Column], Column]) -> Column:
        picked = lambda s, c: s + F.when(when(c["mask"]), value(c)).otherwise(F.lit(0)).cast("long")
        return F.aggregate("cells", F.lit(0).cast("long"), picked)

    def removed(mask: Column) -> Column:
        return (mask.bitwiseAND(own) != 0) & (mask.bitwiseAND(before) == 0)

    orderings = len(orders()) // len(FILTERS)
    return rows.select(
        "part",
        "filter_order",
        "step",
        total(lambda c: c["n"], lambda m: m.bitwiseAND(own + before) == 0).alias("kept"),
        total(lambda c: c["n"], removed).alias("removed"),
        total(lambda c: c["n"], lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total(lambda c: c["n"], lambda m: m == own).alias("unique_fails"),
        total(lambda c: c["good"], removed).alias("good_lost"),
        total(lambda c: c["toxic"], removed).alias("toxic_lost"),
        total(
            lambda c: c["n"] * (F.lit(orderings) / F.bit_count(c["mask"])).cast("long"), lambda m: m.bitwiseAND(own) != 0
        ).alias("shapley"),
    )


def audit(spark: SparkSession, folder: str, documents: str = "documents", labels: str = "labels", state: str | None = None) -> DataFrame:
    """The audit of the filters A to E over a table of documents, read as a stream of its files.

    A: fewer than 200 words; B: fewer than half of the words distinct; C: more than 2 % of the code
    points in A-Z; D: one of ``#$%&*|``; E: the same text at a smaller id anywhere in the table,
    removed or not. The files come in BATCHES micro-batches or, if there are fewer files, in as many
    as there are. Texts are equal if their SHA-256 is.

    A null text is empty, which fails A alone (and E). A row without id is a copy of any row with
    one, and not of others without; equal rows with one id are no copies of each other. A null
    source is the part ``''``, as is an empty one. An empty table has no parts and gives no rows;
    other columns play no part. Texts of any length are looked at whole, within their row.
    """
    docs = table(spark, folder, documents)
    files = max(1, ceil(len(docs.inputFiles()) / BATCHES))
    slots = max(1, ceil(docs.count() / SLOT_ROWS))
    return report(counters(replay(spark, folder, documents, files), table(spark, folder, labels), slots, state))


SQL = rf"""
    WITH d AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
               regexp_extract_all(coalesce(text, ''), '[^{SPACES}]+') AS w
        FROM documents),
    m AS (
        SELECT doc_id, part,
               (len(w) < {MIN_WORDS})::INTEGER + 2 * (100 * len(list_distinct(w)) < {MIN_DISTINCT} * len(w))::INTEGER
               + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MAX_CAPITALS} * length(t))::INTEGER
               + 8 * regexp_matches(t, '{SYMBOLS}')::INTEGER
               + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INTEGER AS mask
        FROM d),
    l AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY 1),
    c AS (
        SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
        FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
    f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
    p AS (
        SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
        FROM f a JOIN f b ON b.f <> a.f JOIN f c ON c.f NOT IN (a.f, b.f) JOIN f d ON d.f NOT IN (a.f, b.f, c.f)
        JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
    s AS (
        SELECT filter_order, step, bits[step] AS own, list_sum(bits[1:step])::INTEGER - bits[step] AS before
        FROM p, (SELECT unnest(range(1, 6)) AS step))
    SELECT part, filter_order, step::INTEGER AS step,
           coalesce(sum(n) FILTER (mask & (own + before) = 0), 0)::BIGINT AS kept,
           coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
           coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
           coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
           coalesce(sum(good) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
           coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
           coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & own <> 0), 0)::BIGINT AS shapley
    FROM c, s GROUP BY 1, 2, 3
    """
