"""The endless source, whose rows hang on nothing but their offset, and streams of many batches with late rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import feeding
from ledgerloom.streaming import feeds
from tests.conftest import rows

START = dt.datetime(2024, 5, 1)
DELAYS = feeds.Delays(0.25, dt.timedelta(seconds=5), dt.timedelta(hours=3))


def made(spark, per_batch, parts=None):
    return lambda: feeds.endless(spark, 3, 20, per_batch, START, 50, DELAYS, parts)


def test_rows_follow_from_the_offset_however_it_is_cut(spark, tmp_path):
    few = rows(feeds.advance(made(spark, 300), "few", 2))
    many = rows(feeds.advance(made(spark, 100, parts=3), "many", 6))
    assert few == many and [r[0] for r in sorted(few)] == list(range(600))
    folder = str(tmp_path / "feed")
    feeds.advance(made(spark, 150), "restarted", 1, folder)
    feeds.advance(made(spark, 50), "restarted", 3, folder)  # a later session may take other batches
    assert rows(feeds.advance(made(spark, 300), "restarted", 1, folder)) == few


def test_event_times_lie_before_arrival(spark):
    got = feeds.advance(made(spark, 400), "times", 1).withColumn("due", F.lit(START) + F.make_dt_interval(secs=F.col("event_id") / 50))
    behind = F.unix_micros("due") - F.unix_micros("ts")
    late, least, most = got.agg(F.avg((behind > 5_000_000).cast("int")), F.min(behind), F.max(behind)).head()
    assert 0.15 < late < 0.35 and least >= 0 and most <= 3 * 3600 * 1_000_000


def test_batches_tell_what_was_read(spark):
    seen = []
    feeds.advance(made(spark, 70), "seen", 3, seen=seen)
    assert [(b.rows, b.late, b.state_rows) for b in seen] == [(70, 0, 0)] * 3


def test_state_stays_bounded_and_late_rows_are_left_out(spark, folder):
    report = {r["batch"]: r for r in feeding.stream_late_batches(spark, folder).collect()}
    total = sum(r["rows"] for r in report.values())
    assert sorted(report) == list(range(feeding.BATCHES)) and sum(r["late"] for r in report.values()) > 0.02 * total
    later = [report[b]["state_rows"] for b in range(2, feeding.BATCHES)]
    assert max(later) <= max(r["rows"] for r in report.values())  # some batches' worth, not the feed's
    assert later[-1] <= total / 4


def test_slices_hold_what_arrives_in_their_time(spark):
    df = spark.createDataFrame([(i, (i * 37) % 100) for i in range(100)] + [(100, 0), (101, 99)], "id long, at long")
    path, files = feeds.land(df, F.col("at"), 5, "landing", files=2)
    feed = feeds.replay(spark, path, "rows", files)
    seen = []
    back = feeds.run_append(feed.withColumn("again", F.col("at")), "landed", seen=seen)
    assert rows(back.select("id", "at")) == rows(df) and [b.rows for b in seen if b.rows] == [21, 20, 20, 20, 21]


@pytest.mark.parametrize("n", [0, 1])
def test_small_feeds_land(spark, n):
    df = spark.createDataFrame([(7, 5)][:n], "id long, at long")
    path, files = feeds.land(df, F.col("at"), 3, "small")
    assert feeds.run_append(feeds.replay(spark, path, "rows", files), "small-out").count() == n
