"""Batch operators = a plain replay of the reference rules on random logs."""

import datetime as dt
from decimal import Decimal

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from contextlib import contextmanager

from simulate import replay_cart, replay_debounce, replay_orders, replay_rings
from tavolo.operators import calls, carts, orders
from tavolo.plans.scan import CONF_HOT_KEY_ROWS

# hot-key thresholds: every key chunked, a mix of chunked and plain keys, none chunked
HOT = st.sampled_from([0, 2, None])


@contextmanager
def hot_key_rows(spark, n):
    """Run with the session's hot-key threshold set to ``n`` (None: the default)."""
    if n is not None:
        spark.conf.set(CONF_HOT_KEY_ROWS, str(n))
    try:
        yield
    finally:
        spark.conf.unset(CONF_HOT_KEY_ROWS)

EV_SCHEMA = ("order_id bigint, seq int, kind string, status_arg string, payment string, "
             "qty int, price decimal(18,4), ts timestamp_ntz")
T0 = dt.datetime(2024, 1, 1)

kinds = st.sampled_from(["status", "status", "add", "replace", "void"])
status_args = st.sampled_from(["open", "preparing", "ready", "closed", "void"])
payments = st.sampled_from([None, None, "cash", "card"])


@st.composite
def order_logs(draw):
    rows = []
    for oid in range(draw(st.integers(1, 6))):
        n = draw(st.integers(1, 9))
        for seq in range(n):
            kind = "create" if seq == 0 else draw(kinds)
            arg = draw(status_args) if kind == "status" else None
            pay = draw(payments) if kind == "status" else None
            price = Decimal(draw(st.integers(0, 5000))) / 100
            rows.append((oid, seq, kind, arg, pay, draw(st.integers(1, 5)), price,
                         T0 + dt.timedelta(minutes=oid * 100 + seq)))
    return rows


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(order_logs(), st.sampled_from([1, 2, 3, 1 << 16]), HOT)
def test_order_fold_equals_replay(spark, rows, chunk, hot):
    df = spark.createDataFrame(rows, EV_SCHEMA)
    with hot_key_rows(spark, hot):
        got = {r.order_id: (r.status, r.payment_method, r.closed_at, float(r.subtotal), float(r.tax),
                            float(r.total), r.n_lines)
               for r in orders.order_state(df, chunk_size=chunk).collect()}
        rej = sorted((r.order_id, r.seq, r.kind) for r in orders.rejected_order_events(df, chunk).collect())
    keys = ["order_id", "seq", "kind", "status_arg", "payment", "qty", "price", "ts"]
    want, rejected = replay_orders([dict(zip(keys, r)) for r in rows])
    assert got == want
    assert rej == rejected


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2), st.sampled_from([1, 1, -1, -1, 0])),
                min_size=1, max_size=40), st.sampled_from([1, 3, 7, 1 << 16]), HOT)
def test_cart_fold_equals_replay(spark, evs, chunk, hot):
    rows = [(c, i, seq, d) for seq, (c, i, d) in enumerate(evs)]
    df = spark.createDataFrame(rows, "cart_id bigint, item_id bigint, seq bigint, delta int")
    menu = spark.createDataFrame([(i, f"item{i}", Decimal("1.5")) for i in range(3)],
                                 "menu_item_id bigint, name string, price decimal(18,4)")
    with hot_key_rows(spark, hot):
        got = {(r.cart_id, r.item_id): (r.qty, r.line_since) for r in carts.cart_fold(df, menu, chunk).collect()}
    want = {}
    for key in {(c, i) for c, i, _, _ in rows}:
        q, since = replay_cart([(s, d) for c, i, s, d in rows if (c, i) == key])
        if q > 0:
            want[key] = (q, since)
    assert got == want


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40), st.sampled_from(["ring", "ring", "ack"])),
                min_size=1, max_size=40), st.sampled_from([1, 3, 1 << 16]), HOT)
def test_rings_equal_replay(spark, evs, chunk, hot):
    t = T0
    rows = []
    for seq, (table, gap, kind) in enumerate(evs):
        t = t + dt.timedelta(seconds=gap)
        rows.append((seq, table, kind, 1, t))
    df = spark.createDataFrame(rows, "seq bigint, table_id bigint, kind string, staff_id bigint, ts timestamp_ntz")
    with hot_key_rows(spark, hot):
        _check_rings(spark, df, rows, chunk)


def _check_rings(spark, df, rows, chunk):
    got_counts = {r.seq: r.open_count for r in calls.ring_counts(df, chunk).collect()}
    want_counts = {}
    for table in {r[1] for r in rows}:
        want_counts.update(replay_rings([(s, k) for s, tb, k, _, _ in rows if tb == table]))
    assert got_counts == want_counts
    got_acc = {r.seq: r.accepted for r in calls.ring_debounce(df, 15, chunk).collect()}
    # the walk crosses many chunks
    got_hot = {r.seq: r.accepted for r in calls.ring_debounce(df, 15, 2).collect()}
    assert got_hot == got_acc
    got_ack = {r.seq: r.ack_seq for r in calls.acknowledge_fold(df, chunk).collect()}
    want_ack = {s: next((s2 for s2, tb2, k2, _, _ in rows if tb2 == tb and k2 == "ack" and s2 > s), None)
                for s, tb, k, _, _ in rows if k == "ring"}
    assert got_ack == want_ack
    want_acc = {}
    for table in {r[1] for r in rows}:
        rings = [(s, ts) for s, tb, k, _, ts in rows if tb == table and k == "ring"]
        us = [int((ts - T0).total_seconds() * 1_000_000) for _, ts in rings]
        want_acc.update(dict(zip([s for s, _ in rings], replay_debounce(us, 15_000_000))))
    assert got_acc == want_acc


def test_no_python_in_fold_plans(spark):
    rows = [(0, 0, "create", None, None, 1, Decimal("1"), T0)]
    df = spark.createDataFrame(rows, EV_SCHEMA)
    for plan_df in (orders.order_state(df), orders.rejected_order_events(df)):
        text = plan_df._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in text and "PythonUDF" not in text
    assert F is not None


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.one_of(st.none(), st.integers(-5, 5))), min_size=1, max_size=30),
       st.sampled_from([1, 2, 5]), st.sampled_from([0, 2, 100]))
def test_chunked_scan_equals_plain_window(spark, vals, chunk, hot):
    from pyspark.sql import Window
    from tavolo.plans.scan import Prefix, prefix_by_key
    rows = [(k, i, v) for i, (k, v) in enumerate(vals)]
    df = spark.createDataFrame(rows, "k bigint, o bigint, v int")
    specs = [Prefix("s", "sum", F.col("v")), Prefix("mx", "max", F.col("v"), inclusive=False),
             Prefix("mn", "min", F.col("v")), Prefix("l", "last", F.col("v"), inclusive=False),
             Prefix("rs", "sum", F.col("v"), reverse=True), Prefix("rl", "last", F.col("v"), reverse=True)]
    got = {r.o: (r.s, r.mx, r.mn, r.l, r.rs, r.rl) for r in prefix_by_key(df, ["k"], "o", specs, chunk,
                                                                                    hot_rows=hot).collect()}
    fw = Window.partitionBy("k").orderBy("o")
    bw = Window.partitionBy("k").orderBy(F.col("o").desc())
    upto, before = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)
    plain = df.select("o", F.sum("v").over(fw.rowsBetween(*upto)).alias("s"),
                      F.max("v").over(fw.rowsBetween(*before)).alias("mx"),
                      F.min("v").over(fw.rowsBetween(*upto)).alias("mn"),
                      F.last("v", ignorenulls=True).over(fw.rowsBetween(*before)).alias("l"),
                      F.sum("v").over(bw.rowsBetween(*upto)).alias("rs"),
                      F.last("v", ignorenulls=True).over(bw.rowsBetween(*upto)).alias("rl"))
    want = {r.o: (r.s, r.mx, r.mn, r.l, r.rs, r.rl) for r in plain.collect()}
    assert got == want
