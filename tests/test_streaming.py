"""Stream jobs over the sf0.001 fixtures, fed file by file, equal the batch jobs."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tavolo.catalog import SINCE, shop
from tavolo.operators import calls, orders, sales
from tavolo.streaming import jobs
from tavolo.streaming.store import EpochStore


def _split_to_files(df, key, path, parts=3):
    """Write ``df`` as ``parts`` files in key order (one micro-batch each)."""
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    step = (hi - lo) // parts + 1
    for i in range(parts):
        chunk = df.where((F.col(key) >= lo + i * step) & (F.col(key) < lo + (i + 1) * step))
        chunk.coalesce(1).write.mode("overwrite").parquet(os.path.join(path, f"part{i}"))
    return [os.path.join(path, f"part{i}") for i in range(parts)]


def _stream_of(spark, df, key, tmp):
    src = os.path.join(tmp, "src")
    os.makedirs(src)
    for i, p in enumerate(_split_to_files(df, key, os.path.join(tmp, "stage"))):
        f = [x for x in os.listdir(p) if x.endswith(".parquet")][0]
        os.rename(os.path.join(p, f), os.path.join(src, f"{i:03d}.parquet"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)


def _rows(df, order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="tavolo-stream-")


def test_stream_order_state_equals_batch(spark, small_dir, tmp):
    s = shop(spark, small_dir)
    store = EpochStore(spark, os.path.join(tmp, "store"))
    q = jobs.stream_order_state(_stream_of(spark, s.order_events, "order_id", tmp), store,
                                os.path.join(tmp, "ckpt"))
    q.awaitTermination()
    got = jobs.current_order_state(store).select(*orders.order_state(s.order_events).columns)
    assert _rows(got, ["order_id"]) == _rows(orders.order_state(s.order_events), ["order_id"])


def test_stream_order_state_out_of_order_events(spark, small_dir, tmp):
    """Events of one order spread over batches in reverse seq order still fold exactly."""
    s = shop(spark, small_dir)
    ev = s.order_events.where(F.col("order_id") < 30)
    store = EpochStore(spark, os.path.join(tmp, "store"))
    src = _stream_of(spark, ev.withColumn("k", -F.col("seq")), "k", tmp).drop("k")
    jobs.stream_order_state(src, store, os.path.join(tmp, "ckpt")).awaitTermination()
    got = jobs.current_order_state(store).select(*orders.order_state(ev).columns)
    assert _rows(got, ["order_id"]) == _rows(orders.order_state(ev), ["order_id"])


def test_sales_batch_takes_the_newest_version(spark, small_dir, tmp):
    s = shop(spark, small_dir)
    row = s.orders.where("status = 'closed'").select(
        "order_id", "restaurant_id", "status", "total", "created_at", "source").limit(1)
    closed = row.withColumn("version", F.lit(2).cast("long"))
    opened = row.withColumns({"status": F.lit("open"), "version": F.lit(1).cast("long")})
    sold = []
    for i, batch in enumerate((opened.unionByName(closed), closed.unionByName(opened))):
        store = EpochStore(spark, os.path.join(tmp, f"versions{i}"))
        jobs.sales_batch(store, batch, 0, s.restaurants, SINCE)
        jobs.sales_batch(store, opened, 1, s.restaurants, SINCE)  # an old version that comes late
        want = sales.sales_summary(row, s.restaurants.join(row, "restaurant_id", "left_semi"), SINCE)
        sold.append(_rows(jobs.current_sales(store).select(*want.columns), ["restaurant_id"]))
    assert sold[0] == sold[1] == _rows(want, ["restaurant_id"])


def test_stream_sales_equals_batch(spark, small_dir, tmp):
    s = shop(spark, small_dir)
    store = EpochStore(spark, os.path.join(tmp, "store"))
    o = s.orders.select("order_id", "restaurant_id", "status", "total", "created_at", "source",
                        F.lit(2).cast("long").alias("version"))
    jobs.stream_sales(_stream_of(spark, o, "order_id", tmp), store, s.restaurants, SINCE,
                      os.path.join(tmp, "ckpt")).awaitTermination()
    want = sales.sales_summary(s.orders, s.restaurants, SINCE).join(
        s.orders.select("restaurant_id").distinct(), "restaurant_id", "left_semi")
    got = jobs.current_sales(store).select(*want.columns)
    assert _rows(got, ["restaurant_id"]) == _rows(want, ["restaurant_id"])


def test_stream_debounce_equals_batch(spark, small_dir, tmp):
    s = shop(spark, small_dir)
    store = EpochStore(spark, os.path.join(tmp, "store"))
    jobs.stream_ring_debounce(_stream_of(spark, s.ring_log, "seq", tmp), store,
                              os.path.join(tmp, "ckpt1")).awaitTermination()
    got = store.read("debounce").select("seq", "table_id", "ts", "accepted")
    assert _rows(got, ["seq"]) == _rows(calls.ring_debounce(s.ring_log), ["seq"])
    assert jobs.late_events(store, "debounce").count() == 0


def test_stream_call_alerts_equal_the_batch_grid(spark, small_dir, tmp):
    """Every poll that the watermark has passed alerts as in the batch operator."""
    s = shop(spark, small_dir)
    store = EpochStore(spark, os.path.join(tmp, "store"))
    jobs.stream_calls(_stream_of(spark, s.ring_log, "seq", tmp), store, os.path.join(tmp, "ckpt2")).awaitTermination()
    alerts = store.read("alerts").drop("epoch")
    mark = s.ring_log.agg(F.max("ts")).first()[0]
    want = (calls.newly_ringing(s.ring_log).where(F.col("poll_at") <= F.lit(mark))
            .withColumn("urgent", F.col("call_count") > 5).select(*alerts.columns))
    assert want.count() > 100
    assert _rows(alerts, ["table_id", "poll_at"]) == _rows(want, ["table_id", "poll_at"])


def test_stream_availability_prunes_carts(spark, small_dir, tmp):
    from tavolo.operators import carts
    s = shop(spark, small_dir)
    store = EpochStore(spark, os.path.join(tmp, "store"))
    lines = carts.cart_fold(s.cart_events, s.menu_items)
    jobs.stream_availability(_stream_of(spark, s.avail_events, "seq", tmp), store, s.menu_items, lines,
                             os.path.join(tmp, "ckpt")).awaitTermination()
    snap = store.latest("availability", ["menu_item_id"], order="seq").select("menu_item_id", "is_available")
    want = orders.availability_state(s.menu_items, s.avail_events).where("toggled").select(
        "menu_item_id", "is_available")
    assert _rows(snap, ["menu_item_id"]) == _rows(want, ["menu_item_id"])
    assert store.read("cart_prune").count() > 0
