"""The whole set of tables: consistent, repeatable, written in every format, replayed as streams."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.spread import Limits
from ledgerloom.plans import company as co
from ledgerloom.plans.validate import validate
from ledgerloom.session import work_dir
from ledgerloom.sources.tables import FORMATS, given, read_table, write
from ledgerloom.streaming import feeds
from tests.conftest import plan, rows

SPEC = co.Spec(companies=3, customers=200, vendors=20, items=150, orders=1000)


@pytest.fixture(scope="module")
def tables(spark):
    return {name: df.cache() for name, df in co.build(spark, SPEC, 4).items()}


def test_all_checks_pass(tables):
    found = validate(tables).collect()
    assert len(found) == 31 and {r.violations for r in found} == {0}


def test_checks_notice_damage(tables):
    damaged = dict(tables)
    damaged["order_line"] = tables["order_line"].filter("order_id <> 17 OR line_no <> 1")
    damaged["journal_line"] = tables["journal_line"].filter("doc_id <> 34 OR line_no <> 1")
    damaged["customer"] = tables["customer"].filter("customer_id > 1")
    bad = {(r.table_name, r.rule): r.violations for r in validate(damaged).collect() if r.violations}
    assert bad[("order_header", "total is the sum of lines")] == 1
    orphaned = tables["order_header"].filter("customer_id = 1").count()
    assert bad[("order_header", "customer_id exists in customer")] == orphaned > 0
    invoiced = tables["invoice"].filter("invoice_id = 17").count()
    assert bad.get(("journal_line", "documents add up to zero"), 0) == invoiced


def test_same_seed_same_rows_in_any_partitioning(spark, tables):
    for name in ("order_header", "invoice", "journal_line"):
        again = co.TABLES[name](spark, SPEC, 4).repartition(7)
        assert rows(again) == rows(tables[name])
    other = co.TABLES["order_header"](spark, SPEC, 5)
    assert rows(other) != rows(tables["order_header"])


def test_more_orders_keep_the_earlier_ones(spark, tables):
    longer = co.order_header(spark, replace(SPEC, orders=1500), 4).filter("order_id <= 1000")
    assert rows(longer) == rows(tables["order_header"])


def test_invoice_numbers_have_no_gap(spark, tables):
    split = co.invoice(spark, SPEC, 4, Limits(heavy_rows=50))
    assert rows(split) == rows(tables["invoice"])
    part = F.split("number", "-")
    runs = tables["invoice"].groupBy(part[1], part[2]).agg(F.max(part[3].cast("int")), F.count(F.lit(1))).collect()
    assert len(runs) >= 6 and all(last == n for *_, last, n in runs)


@pytest.mark.parametrize("name", ["order_header", "order_line", "payment", "journal_line", "stock_move"])
def test_tables_are_made_without_a_shuffle(spark, name, capsys):
    assert "Exchange" not in plan(co.TABLES[name](spark, SPEC, 4), capsys)


def test_published_money_is_decimal(tables):
    shown = co.published(tables)
    assert dict(shown["invoice"].dtypes)["amount"] == "decimal(18,2)"
    cents = tables["invoice"].agg(F.sum("amount")).head()[0]
    assert shown["invoice"].agg(F.sum("amount")).head()[0] * 100 == cents


@pytest.mark.parametrize("fmt", FORMATS)
def test_written_tables_read_back_the_same(spark, tables, tmp_path, fmt):
    made = co.published(tables)["invoice"].withColumn("year", F.year("invoice_date"))
    made = made.withColumn("note", F.when(F.col("invoice_id") % 3 == 0, F.lit("")).when(F.col("invoice_id") % 3 == 1, "a,\"b\"\n"))
    where = write({"invoice": made}, str(tmp_path), fmt, {"invoice": ["year"]})
    assert any(p.name.startswith("year=") for p in (tmp_path / "invoice").iterdir())
    back = read_table(spark, str(tmp_path), "invoice", fmt, made.schema)
    assert where == {"invoice": f"{tmp_path}/invoice"}
    options = made.columns
    assert rows(back.select(*options)) == rows(made)


def test_reading_text_needs_a_schema(spark):
    with pytest.raises(ValueError):
        read_table(spark, "/nowhere", "x", "csv")
    with pytest.raises(ValueError):
        write({}, "/nowhere", "xml")


def test_work_dir_follows_the_session(spark):
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    one, two = work_dir(spark, "a"), work_dir(spark, "a")
    assert one != two and one.startswith(f"{base}/a-")


def test_endless_stream(spark):
    feed = feeds.stream(spark, 1, 200, 50, parts=2)
    assert feed.isStreaming
    query = feed.writeStream.format("memory").queryName("endless").start()
    try:
        for _ in range(60):
            query.processAllAvailable()
            if spark.table("endless").count() > 100:
                break
    finally:
        query.stop()
    got = spark.table("endless")
    ids = [r.event_id for r in got.select("event_id").collect()]
    assert len(ids) == len(set(ids)) > 100
    assert got.filter("customer_id NOT BETWEEN 1 AND 50 OR amount_cents NOT BETWEEN 100 AND 99999").count() == 0
    batch = feeds.business_events(spark.range(max(ids) + 1).withColumnRenamed("id", "value"), "value", 1, 50, F.lit(None))
    kinds = {(r.event_id, r.kind, r.amount_cents) for r in batch.collect()}
    assert {(r.event_id, r.kind, r.amount_cents) for r in got.collect()} <= kinds


def test_late_events_are_dropped_and_open_windows_kept(spark, folder, tmp_path):
    """Lateness is judged by the watermark of the batch before the last, hence three files."""
    events = given(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    late = events.filter(F.col("event_id") == 10).withColumn("event_id", F.lit(-1).cast("bigint"))
    parts = [events.filter("event_id < 400"), events.filter("event_id BETWEEN 400 AND 699")]
    for part in (*parts, events.filter("event_id >= 700").unionByName(late)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counted = feeds.windowed(feed, "ts", "1 hour", "10 minutes", ["event_type"])
    latest = feeds.run_latest(counted, "late", ["window", "event_type"])
    assert latest.agg(F.sum("n")).head()[0] == 1000
    assert latest.count() == latest.select("window", "event_type").distinct().count()


def test_repeats_across_batches_are_dropped(spark, folder, tmp_path):
    events = given(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for _ in range(2):
        events.filter("event_id < 30").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    once = feeds.run_append(feeds.dedup(feed, "event_id", "ts", "30 days"), "once")
    assert sorted(r.event_id for r in once.collect()) == list(range(30))
