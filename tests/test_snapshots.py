"""Keyed snapshots and the stream jobs' state: retries, compaction, late events, retractions, bounded reads."""

import datetime as dt
import os
import random
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tavolo.operators import calls, carts, orders, sales
from tavolo.streaming import jobs
from tavolo.streaming.store import EpochStore, KeyedSnapshot

T0 = dt.datetime(2024, 1, 1)
ROWS = "k long, v long, gone boolean"


@pytest.fixture()
def store(spark):
    return EpochStore(spark, os.path.join(tempfile.mkdtemp(prefix="tavolo-snap-"), "store"))


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_snapshot_holds_the_newest_row_of_each_key(spark, store):
    snap = KeyedSnapshot(store, "t", ROWS, ["k"], buckets=4, compact_every=3)
    rnd, want = random.Random(1), {}
    for epoch in range(10):
        batch = {rnd.randrange(30): rnd.randrange(100) for _ in range(8)}
        gone = {k for k in batch if rnd.random() < 0.2}
        df = spark.createDataFrame([(k, v, k in gone) for k, v in batch.items()], ROWS)
        before = dict(want)
        want.update(batch)
        want = {k: v for k, v in want.items() if k not in gone}
        snap.merge(df, epoch)
        assert {r.k: r.v for r in snap.rows().collect()} == want
        if epoch % 4 == 1:      # a retry starts from the state before the epoch, whatever its first attempt left
            assert {r.k: r.v for r in snap.rows(epoch).collect()} == before
            snap.merge(df, epoch)
            assert {r.k: r.v for r in snap.rows().collect()} == want
        assert all(len(e) < 3 for e in snap.before().buckets.values())
    some = snap.buckets_of(spark.createDataFrame([(3, 0, False)], ROWS))
    assert len(some) == 1 and snap.bytes(None, some) < snap.bytes()


def order_events(spark, first, n, seq0=0, kinds=("create", "status")):
    out = []
    for o in range(first, first + n):
        for i, kind in enumerate(kinds):
            out.append((o, seq0 + i, kind, 1 if kind == "create" else None, "closed" if kind == "status" else None, None,
                        [(1, "a", Decimal("2.0000"), 1)], T0 + dt.timedelta(minutes=seq0 + i)))
    return spark.createDataFrame(out, "order_id long, seq int, kind string, restaurant_id int, status_arg string, "
                                      f"payment string, items array<{orders.LINE}>, ts timestamp_ntz")


def test_order_state_reads_the_orders_in_work_and_not_the_log(spark, store):
    opts = {"ttl_epochs": 2, "buckets": 2, "compact_every": 2}
    log, _ = jobs.order_snapshots(store, 2, 2)
    sizes = []
    for epoch in range(9):
        jobs.order_state_batch(store, order_events(spark, epoch * 20, 20), epoch, **opts)
        sizes.append(log.bytes())
    assert max(sizes[5:]) < 1.6 * sizes[4]          # flat, while the log grows by as much each batch
    got = jobs.current_order_state(store, 2, 2)
    want = orders.order_state(order_events(spark, 0, 180))
    assert rows(got.select(*want.columns), "order_id") == rows(want, "order_id")
    # an event after its order was archived, and one that never had a create, end in the late table
    late = order_events(spark, 3, 1, 7, ("add",)).unionByName(order_events(spark, 9_999, 1, 1, ("add",)))
    jobs.order_state_batch(store, late, 9, **opts)
    for epoch in range(10, 14):
        jobs.order_state_batch(store, order_events(spark, epoch * 20, 20), epoch, **opts)
    orphans = store.read("order_events_archive").select("order_id", "seq").distinct()
    assert rows(orphans, "order_id") == [(3, 7), (9_999, 1)]


def test_an_order_in_work_keeps_its_events_beside_pending_ones(spark, store):
    """Buckets that pending events touch more often than orders do lose no event of an active order."""
    opts = {"ttl_epochs": 2, "buckets": 1, "compact_every": 2}
    jobs.order_state_batch(store, order_events(spark, 0, 3, 0, ("create",)), 0, **opts)
    for epoch in range(1, 6):
        jobs.order_state_batch(store, order_events(spark, 500 + epoch, 1, 1, ("add",)), epoch, **opts)
    jobs.order_state_batch(store, order_events(spark, 0, 3, 5, ("add",)), 6, **opts)
    want = orders.order_state(order_events(spark, 0, 3, 0, ("create",)).unionByName(order_events(spark, 0, 3, 5, ("add",))))
    got = jobs.current_order_state(store, 1, 2)
    assert rows(got.select(*want.columns), "order_id") == rows(want, "order_id")


def test_order_state_of_a_retried_and_a_repeated_batch(spark, store):
    a, b = order_events(spark, 0, 5), order_events(spark, 0, 5, 2, ("status", "add"))
    for epoch, batch in ((0, a), (1, b), (1, b), (2, a)):       # epoch 1 twice; batch a delivered again as epoch 2
        jobs.order_state_batch(store, batch, epoch)
    want = orders.order_state(a.unionByName(b))
    assert rows(jobs.current_order_state(store).select(*want.columns), "order_id") == rows(want, "order_id")


def test_sales_follow_updates_across_and_within_batches(spark, store):
    rnd = random.Random(3)
    tenants = spark.createDataFrame([(i, "n") for i in range(4)], "restaurant_id int, name string")
    schema = jobs.ORDER_ROWS + ", source string"
    newest = {}
    for epoch in range(6):
        batch = []
        for _ in range(25):
            o = rnd.randrange(40)
            batch.append((o, o % 5, rnd.choice(["open", "closed", "closed", "void"]),
                          rnd.choice([None, Decimal(rnd.randrange(10_000)) / 100]),
                          T0 + dt.timedelta(days=rnd.randrange(-3, 3)), rnd.randrange(60), "pos"))
        # one row a version; ties of a version are not defined by the job
        batch = list({(r[0], r[5]): r for r in batch if not (r[0] in newest and newest[r[0]][5] == r[5])}.values())
        df = spark.createDataFrame(batch, schema)
        for attempt in range(1 + (epoch % 3 == 0)):
            jobs.sales_batch(store, df, epoch, tenants, "2024-01-01", buckets=4)
        for r in batch:
            if r[0] not in newest or r[5] > newest[r[0]][5]:
                newest[r[0]] = r
    want = sales.sales_summary(spark.createDataFrame(list(newest.values()), schema), tenants, "2024-01-01")
    assert rows(jobs.current_sales(store, 4).select(*want.columns), "restaurant_id") == rows(want, "restaurant_id")


def ring_log(spark, events):
    return spark.createDataFrame([(s, t, k, T0 + dt.timedelta(seconds=u)) for s, t, k, u in events],
                                 "seq long, table_id long, kind string, ts timestamp_ntz")


def random_rings(seed, n=400):
    rnd, t, out = random.Random(seed), 0, []
    for s in range(n):
        t += rnd.choice([0, 1, 4, 9, 200])
        out.append((s, rnd.randrange(4), rnd.choice(["ring"] * 4 + ["ack"]), t))
    return out


@pytest.mark.parametrize("delay", [0, 300])
def test_alerts_and_debounce_equal_batch_and_late_events_go_aside(spark, store, delay):
    """Batches of events shuffled within the allowed delay; with no delay, what came too late is set aside."""
    events = random_rings(5)
    rnd = random.Random(6)
    shuffled = sorted(events, key=lambda e: e[3] + rnd.randrange(1 + 280 * (delay > 0)))
    late = [] if delay else [(10_000, 1, "ring", events[50][3]), (10_001, 9, "ring", 1)]
    end = [(20_000, 7, "ack", events[-1][3] + 10_000)]      # moves the watermark past every poll
    batches = [shuffled[:150], shuffled[150:300], shuffled[300:] + late, end]
    for epoch, b in enumerate(batches):
        for attempt in range(1 + (epoch == 1)):
            jobs.calls_batch(store, ring_log(spark, b), epoch, poll_seconds=60, delay_seconds=delay, buckets=3)
            rings = [e if e[2] == "ring" else (e[0], e[1], "ack", e[3]) for e in b]
            rings += [(30_000, 7, "ring", events[-1][3] + 10_000)] if epoch == 3 else []
            jobs.debounce_batch(store, ring_log(spark, rings), epoch, delay_seconds=delay, buckets=3)
    log = ring_log(spark, events + end)
    alerts = store.read("alerts").drop("epoch")
    want = (calls.newly_ringing(log, 60).withColumn("urgent", F.col("call_count") > 5)
            .where(F.col("poll_at") <= F.lit(T0 + dt.timedelta(seconds=events[-1][3] + 10_000 - delay))))
    assert rows(alerts, "table_id", "poll_at") == rows(want.select(*alerts.columns), "table_id", "poll_at")
    assert want.where("urgent").count() > 0
    got = store.read("debounce").where("seq < 30000").select("seq", "table_id", "ts", "accepted")
    assert rows(got, "seq") == rows(calls.ring_debounce(log), "seq")
    for name in ("rings", "debounce"):
        assert sorted(r.seq for r in jobs.late_events(store, name).collect()) == sorted(e[0] for e in late)


def test_idle_state_times_out(spark, store):
    """Tables without open rings and old locks leave the state; what comes later is as with them."""
    for epoch in range(11):
        t = 100_000 * epoch
        b = [(10 * epoch, epoch, "ring", t), (10 * epoch + 1, epoch, "ack", t + 1)]
        jobs.calls_batch(store, ring_log(spark, b), epoch, buckets=1)
        jobs.debounce_batch(store, ring_log(spark, b), epoch, buckets=1)
    assert jobs.calls_snapshot(store, 1).rows().count() < 7
    assert jobs.debounce_snapshot(store, 1).rows().count() < 7
    assert store.read("debounce").where("accepted").count() == 11


def test_carts_follow_clicks_and_a_toggle_reads_the_carts_that_hold_it(spark, store):
    rnd = random.Random(8)
    menu = spark.createDataFrame([(i, f"item {i}", Decimal(i + 1), True) for i in range(12)],
                                 "menu_item_id long, name string, price decimal(18,4), is_available boolean")
    clicks = [(rnd.randrange(20), rnd.randrange(11), s, rnd.choice([1, 1, 1, -1, -1, 0])) for s in range(600)]
    clicks += [(99, 11, 600, 1), (99, 3, 601, 1)]           # the only cart with item 11
    schema = "cart_id long, item_id long, seq long, delta int"
    for epoch in range(5):
        part = clicks[epoch * 130:(epoch + 1) * 130]
        for attempt in range(1 + (epoch == 2)):
            jobs.cart_batch(store, spark.createDataFrame(part, schema), epoch, menu, buckets=4)
    jobs.cart_batch(store, spark.createDataFrame([(99, 11, 600, 1), (99, 11, 5, 1)], schema), 5, menu, buckets=4)
    assert store.read("late_cart_events").count() == 2
    want = carts.cart_fold(spark.createDataFrame(clicks, schema), menu)
    got = jobs.current_carts(store, 4)
    assert rows(got.select(*want.columns), "cart_id", "item_id") == rows(want, "cart_id", "item_id")
    held = jobs.carts_holding(store, spark.createDataFrame([(11,)], "item_id long"), 4)
    assert {r.cart_id for r in held.collect()} == {99}
    files = {f.split("/bucket=")[1].split("/")[0] for f in jobs.cart_snapshots(store, 4)[0].rows(
        None, jobs.cart_snapshots(store, 4)[0].buckets_of(held)).inputFiles()}
    assert len(files) == 1                                   # one cart, one bucket
    toggles = "menu_item_id long, seq long, is_available boolean"
    jobs.availability_batch(store, spark.createDataFrame([(11, 5, False), (11, 4, True), (777, 9, False)], toggles), 0,
                            menu, buckets=4)
    assert rows(store.read("cart_prune").drop("epoch"), "cart_id") == [(99, 1, 1, "item 11")]
    # an older toggle changes nothing and reads no cart
    jobs.availability_batch(store, spark.createDataFrame([(11, 2, True)], toggles), 1, menu, buckets=4)
    assert store.read("cart_prune").where("epoch = 1").count() == 0
