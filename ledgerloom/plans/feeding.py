"""Registered queries of feeds in many micro-batches: the endless source, and events that arrive late."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.values import cents
from ledgerloom.plans import sqltext as q
from ledgerloom.plans.registry import SEED, Register
from ledgerloom.sources.tables import given
from ledgerloom.streaming import feeds

register = Register()

BATCHES = 8
START = dt.datetime(2024, 3, 1)
PER_SECOND = 40
DELAY = "1 hour"
DELAY_MICROS = 3_600_000_000
WINDOW_MICROS = 3_600_000_000
FEED = feeds.Delays(share=0.1, usual=dt.timedelta(seconds=30), late=dt.timedelta(hours=2))
EVENTS = feeds.Delays(share=0.2, usual=dt.timedelta(minutes=10), late=dt.timedelta(days=10))
AGAIN = feeds.Delays(share=0.3, usual=dt.timedelta(0), late=dt.timedelta(days=5))


def _delay_sql(delays: feeds.Delays, table: str, key: str) -> str:
    late, usual = (span // dt.timedelta(microseconds=1) for span in (delays.late, delays.usual))
    most = f"CASE WHEN {q.draw(SEED, table, 'is_late', key)} < {delays.share} THEN {late}::DOUBLE ELSE {usual}::DOUBLE END"
    return f"floor({q.draw(SEED, table, 'delay', key)} * ({most}))::BIGINT"


@register.add(
    "stream_endless",
    f"""
    WITH k AS (SELECT unnest(range({BATCHES} * ((count(*) + {BATCHES} - 1) // {BATCHES}))) AS k FROM orders)
    SELECT k AS event_id,
           epoch_us(TIMESTAMP '{START}') + floor(k * {q.num(1_000_000 / PER_SECOND)})::BIGINT
           - {_delay_sql(FEED, 'event', 'k')} AS ts_micros,
           {q.pick(q.draw(SEED, 'event', 'kind', 'k'), feeds.EVENT_KINDS)} AS kind,
           {q.fk(q.draw(SEED, 'event', 'customer', 'k'), '(SELECT count(*) FROM customer)', 2.0)} AS customer_id,
           {q.whole(q.draw(SEED, 'event', 'amount', 'k'), 100, 99_999)} AS amount_cents
    FROM k
    """,
)
def stream_endless(spark: SparkSession, folder: str) -> DataFrame:
    """The first batches of the endless source, restarted before each; as many events as there are orders, or a few more."""
    per_batch = max(1, -(-given(spark, folder, "orders").count() // BATCHES))
    customers = given(spark, folder, "customer").count()
    made = feeds.advance(lambda: feeds.endless(spark, SEED, customers, per_batch, START, PER_SECOND, FEED), "endless", BATCHES)
    return made.select("event_id", F.unix_micros("ts").alias("ts_micros"), "kind", "customer_id", "amount_cents")


# Which row arrives in which batch, and the latest time below which the batch leaves rows out: what the
# batches before the last one had seen, less the delay, in whole milliseconds.
_ARRIVED = f"""
    e AS (
        SELECT event_id, user_id, event_type, {q.cents('value')} AS value_cents, epoch_us(ts) AS us,
               epoch_us(ts) + {_delay_sql(EVENTS, 'arrival', 'event_id')} AS arrived
        FROM events)"""
_LATE = f"""
    t AS (SELECT min(arrived) AS first, (max(arrived) - min(arrived)) // {BATCHES} + 1 AS width FROM a),
    p AS (SELECT a.*, (arrived - first) // width AS batch FROM a, t),
    s AS (SELECT batch, max(us) AS latest FROM p GROUP BY 1),
    n AS (SELECT unnest(range({BATCHES})) AS batch),
    w AS (
        SELECT batch, max(latest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 1000 * 1000
                      - {DELAY_MICROS} AS mark
        FROM n LEFT JOIN s USING (batch)),
    l AS (SELECT batch, mark, coalesce(lag(mark) OVER (ORDER BY batch), 0) AS bound FROM w)"""


def _landed(spark: SparkSession, folder: str, again: bool) -> DataFrame:
    """The given events as a stream in the order of arrival, a slice of time in each micro-batch."""
    events = given(spark, folder, "events").select("event_id", "user_id", "event_type", cents("value").alias("value_cents"), F.col("ts").cast("timestamp").alias("ts"))
    arrived = F.unix_micros("ts") + EVENTS.micros(SEED, "arrival", "event_id")
    once = events.withColumn("arrived", arrived)
    if again:
        later = F.col("arrived") + AGAIN.micros(SEED, "again", "event_id")
        once = once.withColumn("arrived", F.explode(F.array(F.col("arrived"), later)))
    path, files = feeds.land(once, F.col("arrived"), BATCHES, "arrivals")
    return feeds.replay(spark, path, "rows", files).drop("arrived")


@register.add(
    "stream_late_windows",
    f"""
    WITH {_ARRIVED}, a AS (SELECT * FROM e), {_LATE}
    SELECT us // {WINDOW_MICROS} AS hour, event_type, count(*) AS n, sum(value_cents)::BIGINT AS value_cents
    FROM p JOIN l USING (batch) WHERE us // {WINDOW_MICROS} * {WINDOW_MICROS} + {WINDOW_MICROS} > bound GROUP BY 1, 2
    """,
)
def stream_late_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per hour of events that arrive late: those whose window was given up are left out."""
    counted = feeds.windowed(
        _landed(spark, folder, False), "ts", "1 hour", DELAY, ["event_type"],
        F.count(F.lit(1)).alias("n"), F.sum("value_cents").alias("value_cents"),
    )
    latest = feeds.run_latest(counted, "late-windows", ["window", "event_type"])
    hour = F.floor(F.unix_micros("window.start") / F.lit(WINDOW_MICROS))
    return latest.select(hour.alias("hour"), "event_type", "n", "value_cents")


_TWICE = f"""
    a AS (
        SELECT * FROM e
        UNION ALL SELECT * REPLACE (arrived + {_delay_sql(AGAIN, 'again', 'event_id')} AS arrived) FROM e)"""


@register.add(
    "stream_late_dedup",
    f"""
    WITH {_ARRIVED}, {_TWICE}, {_LATE}
    SELECT event_id, any_value(user_id) AS user_id, any_value(event_type) AS event_type, any_value(value_cents) AS value_cents
    FROM p JOIN l USING (batch) WHERE us > bound GROUP BY 1
    """,
)
def stream_late_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Events delivered twice and late: each once, but for those that came after their time both times."""
    once = feeds.dedup(_landed(spark, folder, True), "event_id", "ts", DELAY)
    return feeds.run_append(once.select("event_id", "user_id", "event_type", "value_cents"), "late-dedup")


@register.add(
    "stream_late_batches",
    f"""
    WITH {_ARRIVED}, {_TWICE}, {_LATE},
    f AS (SELECT event_id, us, min(batch) AS batch FROM p JOIN l USING (batch) WHERE us > bound GROUP BY 1, 2)
    SELECT batch, (SELECT count(*) FROM p WHERE p.batch = l.batch) AS rows,
           (SELECT count(*) FROM p WHERE p.batch = l.batch AND us <= bound) AS late,
           (SELECT count(*) FROM f WHERE f.batch <= l.batch AND us + {DELAY_MICROS} > coalesce(mark, 0)) AS state_rows
    FROM l
    """,
)
def stream_late_batches(spark: SparkSession, folder: str) -> DataFrame:
    """What each micro-batch read, left out as late, and still held: state does not grow with the feed."""
    seen: list[feeds.Batch] = []
    once = feeds.dedup(_landed(spark, folder, True), "event_id", "ts", DELAY)
    feeds.run_append(once.select("event_id"), "late-batches", seen=seen)
    rows = [(b.number, b.rows, b.late, b.state_rows) for b in seen if b.number < BATCHES]
    return spark.createDataFrame(rows, "batch bigint, rows bigint, late bigint, state_rows bigint")
