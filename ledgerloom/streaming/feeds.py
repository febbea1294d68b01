"""Event feeds with Structured Streaming: made, counted in windows, freed of repeats, stored.

Streams need TIMESTAMP event times; a ``timestamp_ntz`` column has to be cast first.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.draws import ColumnLike, draw
from ledgerloom.functions.values import choice, fk, whole
from ledgerloom.session import work_dir

EVENT_KINDS = {"order": 5.0, "shipment": 3.0, "invoice": 3.0, "payment": 2.0, "return": 0.5}


def business_events(keyed: DataFrame, key: str, seed: int, customers: int, ts: Column) -> DataFrame:
    """Turns any keyed frame, stream or batch, into synthetic events; the key decides the rest."""
    return keyed.select(
        F.col(key).alias("event_id"),
        ts.alias("ts"),
        choice(draw(seed, "event", "kind", key), list(EVENT_KINDS), list(EVENT_KINDS.values())).alias("kind"),
        fk(draw(seed, "event", "customer", key), customers, skew=2.0).alias("customer_id"),
        whole(draw(seed, "event", "amount", key), 100, 99_999).alias("amount_cents"),
    )


def stream(spark: SparkSession, seed: int, rps: int, customers: int, parts: int | None = None) -> DataFrame:
    """An endless stream of synthetic events, ``rps`` a second, numbered without gaps."""
    source = spark.readStream.format("rate").option("rowsPerSecond", rps)
    if parts:
        source = source.option("numPartitions", parts)
    return business_events(source.load(), "value", seed, customers, F.col("timestamp"))


@dataclass(frozen=True)
class Delays:
    """How long events take to arrive: a ``share`` of them up to ``late``, the others up to ``usual``."""

    share: float
    usual: dt.timedelta
    late: dt.timedelta

    def micros(self, seed: int, table: str, *keys: ColumnLike) -> Column:
        """Microseconds, fixed by the row's key."""
        most = F.when(draw(seed, table, "is_late", *keys) < self.share, _micros(self.late)).otherwise(_micros(self.usual))
        return F.floor(draw(seed, table, "delay", *keys) * most.cast("double")).cast("bigint")


def _micros(span: dt.timedelta) -> int:
    return span // dt.timedelta(microseconds=1)


def endless(
    spark: SparkSession, seed: int, customers: int, per_batch: int, start: dt.datetime, per_second: int,
    delays: Delays | None = None, parts: int | None = None,
) -> DataFrame:
    """An endless stream of synthetic events whose rows follow from their offset alone.

    Event ``k`` arrives ``k / per_second`` seconds after ``start`` (UTC), having happened as much earlier as
    its delay says; a micro-batch brings ``per_batch`` of them. Nothing hangs on the clock or on
    where the batches are cut: a restarted stream, or one with other batches, makes the same rows.
    """
    source = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", per_batch)
    source = source.option("startTimestamp", 0).option("advanceMillisPerBatch", 1)  # its own times are not used
    if parts:
        source = source.option("numPartitions", parts)
    first = _micros(start.replace(tzinfo=dt.timezone.utc) - dt.datetime.fromtimestamp(0, dt.timezone.utc))
    arrived = F.lit(first) + F.floor(F.col("value") * F.lit(1_000_000 / per_second)).cast("bigint")
    happened = arrived - delays.micros(seed, "event", "value") if delays else arrived
    return business_events(source.load(), "value", seed, customers, F.timestamp_micros(happened))


def advance(
    feed: Callable[[], DataFrame], label: str, batches: int, folder: str | None = None, seen: list[Batch] | None = None
) -> DataFrame:
    """Lets an endless stream go on by so many micro-batches, each as a run of its own, and returns all that was written.

    ``feed`` makes the stream anew for each run, as a restarted driver would. With ``folder`` a later
    call goes on behind the last batch.
    """
    made = feed()
    folder = folder or work_dir(made.sparkSession, label)
    written = run_append(made, label, folder=folder, seen=seen)
    for _ in range(batches - 1):
        written = run_append(feed(), label, folder=folder, seen=seen)
    return written


def land(df: DataFrame, arrived: Column, slices: int, label: str, files: int = 1) -> tuple[str, int]:
    """Writes rows as files in the order of their arrival: (folder, files to read as one batch).

    The time from the first arrival to the last, in whole units of ``arrived``, is cut into ``slices``
    of equal length; each becomes ``files`` files, written after those before it. Rows are dealt
    to slices in one pass; then each slice is copied by itself, so that its files are younger.
    """
    spark = df.sparkSession
    name = "_arrived"
    bounds = df.agg(F.min(arrived).alias("first"), F.max(arrived).alias("last")).head()
    first, last = bounds["first"] or 0, bounds["last"] or 0
    width = (last - first) // slices + 1
    since = arrived - F.lit(first)
    dealt = df.withColumn(name, ((since - F.pmod(since, F.lit(width))) / F.lit(width)).cast("int"))
    staged = work_dir(spark, f"{label}-staged")
    dealt.write.partitionBy(name).parquet(staged)
    landed = work_dir(spark, label)
    back = spark.read.schema(dealt.schema).parquet(staged)
    for number in range(slices):
        own = back.filter(F.col(name) == number).drop(name)
        own.repartition(files).write.mode("append").parquet(f"{landed}/rows.parquet")
    return landed, files


def replay(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A given Parquet table, one file or a folder of files, as a stream of its files."""
    path = f"{folder}/{name}.parquet"
    table = spark.read.parquet(path)
    files = table.inputFiles()
    if not files:
        raise ValueError(f"{path} holds no files")
    source = spark.readStream.schema(table.schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    if any(file.rstrip("/").rpartition("/")[2] != f"{name}.parquet" for file in files):
        return source.parquet(path)
    return source.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def windowed(feed: DataFrame, ts: str, size: str, delay: str, by: Sequence[str], *aggregates: Column) -> DataFrame:
    """Aggregates per tumbling window and ``by``; rows later than ``delay`` may be dropped."""
    return (
        feed.withWatermark(ts, delay)
        .groupBy(F.window(ts, size).alias("window"), *by)
        .agg(*(aggregates or (F.count(F.lit(1)).alias("n"),)))
    )


def dedup(feed: DataFrame, ids: ColumnLike | Sequence[str], ts: str, delay: str) -> DataFrame:
    """Drops repeats of an event id that come within ``delay`` of the first; state is bounded."""
    keys = [ids] if isinstance(ids, str) else list(ids)
    return feed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


@dataclass(frozen=True)
class Batch:
    """What a micro-batch of a stream with one keyed operator did."""

    number: int
    rows: int  # read
    late: int  # left out by the watermark
    state_rows: int  # held when it ended


def run_append(
    feed: DataFrame, label: str, fmt: str = "parquet", folder: str | None = None, seen: list[Batch] | None = None
) -> DataFrame:
    """Runs a stream over all input there is, into files, and returns what was written.

    Files and checkpoint lie in ``folder``; a run with the same folder goes on where one before
    it ended. Without it a fresh folder is taken, and nothing can go on. ``seen`` takes the run's
    batches, the last hundred of them.
    """
    folder = folder or work_dir(feed.sparkSession, label)
    query = (
        feed.writeStream.format(fmt)
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if seen is not None:
        for done in query.recentProgress:
            held = done.stateOperators
            late, rows = (sum(getattr(s, name) for s in held) for name in ("numRowsDroppedByWatermark", "numRowsTotal"))
            seen.append(Batch(done.batchId, done.numInputRows, late, rows))
    return feed.sparkSession.read.schema(feed.schema).format(fmt).load(f"{folder}/rows")


def run_latest(
    feed: DataFrame, label: str, keys: Sequence[Column | str], folder: str | None = None
) -> DataFrame:
    """Runs an aggregate over all input there is and returns every group's latest state.

    Append mode would hold back windows the watermark has not passed. Update mode writes
    them all; each batch has its own folder, which a repeated batch overwrites, and the
    newest row per group counts. ``folder`` is as in ``run_append``; no input gives no rows.
    """
    spark = feed.sparkSession
    folder = folder or work_dir(spark, label)
    columns = feed.columns
    spark.createDataFrame([], feed.schema).write.mode("ignore").parquet(f"{folder}/rows/batch=-1")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = (
        feed.writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = T.StructType([*feed.schema.fields, T.StructField("batch", T.IntegerType())])
    stored = spark.read.schema(schema).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
    latest = stored.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.col("batch")).alias("_row"))
    return latest.select("_row.*")
