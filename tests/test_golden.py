"""Hand-made cases for each trap named in the survey."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from simulate import replay_debounce

from tavolo.functions.text import encode_uri_component
from tavolo.operators import calls, feedback, ingest, orders, reads, receipts, sales

T0 = dt.datetime(2024, 1, 1, 12)


def _restaurants(spark):
    return spark.createDataFrame(
        [(1, "Cafe", "cafe", "PKR", Decimal("0.05"), "+92 300-1234567")],
        "restaurant_id int, name string, slug string, currency string, tax_rate decimal(9,6), whatsapp_number string")


def _menu(spark):
    return spark.createDataFrame([(10, 1, "Tea", Decimal("50")), (11, 1, "Cake", Decimal("25"))],
                                 "menu_item_id bigint, restaurant_id int, name string, price decimal(18,4)")


def _requests(spark, rows):
    return spark.createDataFrame(
        rows, "order_id bigint, restaurant_id int, phone string, opt_in boolean, created_at timestamp_ntz, items string")


def test_request_quarantine_and_null_totals(spark):
    rows = [
        (1, 1, "555", True, T0, '[{"menu_item_id": "10", "name": "Tea", "price": "50", "qty": 2}]'),
        (2, 1, "555", False, T0, "[]"),                                                  # empty: valid, NULL totals
        (3, 1, " ", True, T0, "not json"),                                               # malformed
        (4, 1, None, True, T0, '[{"menu_item_id": "10", "name": "Tea", "price": "50", "qty": "2.0"}]'),
        (5, 1, None, True, T0, '[{"menu_item_id": "10", "price": "50", "qty": 1}]'),    # missing name
        (6, 9, None, True, T0, '[{"menu_item_id": "10", "name": "Tea", "price": "50", "qty": 1}]'),
        (7, 1, None, True, T0, '[{"menu_item_id": "99", "name": "X", "price": "5", "qty": 1},'
                               ' {"menu_item_id": "10", "name": "Tea", "price": "50", "qty": 1}]'),
        (8, 1, None, True, T0, '[{"menu_item_id": null, "name": "Custom", "price": "10", "qty": 3}]'),
    ]
    req, rest, menu = _requests(spark, rows), _restaurants(spark), _menu(spark)
    rej = {r.order_id: r.reason for r in ingest.rejected_requests(req, rest, menu).collect()}
    assert rej == {3: "items is not a JSON array", 4: "bad qty", 5: "missing name",
                   6: "unknown restaurant", 7: "unknown menu item"}
    lines = ingest.parse_request_lines(req, rest, menu)
    tot = {r.order_id: (r.subtotal, r.tax, r.total) for r in ingest.order_totals(lines, rest).collect()}
    assert tot[1] == (Decimal("100.0000"), Decimal("5.0000"), Decimal("105.0000"))
    assert tot[2] == (None, None, None)
    assert tot[8] == (Decimal("30.0000"), Decimal("2.0000"), Decimal("32.0000"))   # 1.5 rounds half up
    assert set(tot) == {1, 2, 8}


def test_tax_rounds_half_away_from_zero(spark):
    req = _requests(spark, [(1, 1, None, True, T0, '[{"menu_item_id": "10", "name": "Tea", "price": "50", "qty": 1}]'),
                            (2, 1, None, True, T0, '[{"menu_item_id": "10", "name": "Tea", "price": "70", "qty": 1}]')])
    lines = ingest.parse_request_lines(req, _restaurants(spark), _menu(spark))
    tax = {r.order_id: r.tax for r in ingest.order_totals(lines, _restaurants(spark)).collect()}
    assert tax == {1: Decimal("3.0000"), 2: Decimal("4.0000")}   # 2.5 -> 3, 3.5 -> 4


def test_customer_upsert_latest_opt_in_and_blank_phone(spark):
    heads = spark.createDataFrame(
        [(1, 1, "555", True, T0), (2, 1, "555", False, T0 + dt.timedelta(hours=1)), (3, 1, "  ", True, T0)],
        "order_id bigint, restaurant_id int, phone string, opt_in boolean, created_at timestamp_ntz")
    cust = ingest.customer_upsert(heads).collect()
    assert len(cust) == 1 and cust[0].marketing_opt_in is False and cust[0].created_at == T0
    link = {r.order_id: r.customer_id for r in
            ingest.order_customer_link(heads, ingest.customer_upsert(heads)).collect()}
    assert link[3] is None and link[1] == link[2] == cust[0].customer_id


def _events(spark, rows):
    return spark.createDataFrame(
        rows, "order_id bigint, seq int, kind string, status_arg string, payment string, qty int, "
              "price decimal(18,4), ts timestamp_ntz")


def test_void_then_reopen_keeps_closed_at(spark):
    ev = _events(spark, [
        (1, 0, "create", None, None, 1, Decimal("10"), T0),
        (1, 1, "void", None, None, 1, Decimal("0"), T0 + dt.timedelta(minutes=1)),
        (1, 2, "status", "open", None, 1, Decimal("0"), T0 + dt.timedelta(minutes=2)),
        (1, 3, "add", None, None, 2, Decimal("5"), T0 + dt.timedelta(minutes=3)),
    ])
    r = orders.order_state(ev).collect()[0]
    assert r.status == "open" and r.closed_at == T0 + dt.timedelta(minutes=1)
    assert r.subtotal == Decimal("20.0000") and r.n_lines == 2


def test_add_after_close_is_rejected(spark):
    ev = _events(spark, [
        (1, 0, "create", None, None, 1, Decimal("10"), T0),
        (1, 1, "status", "closed", "cash", 1, Decimal("0"), T0),
        (1, 2, "add", None, None, 1, Decimal("5"), T0),
        (1, 3, "replace", None, None, 1, Decimal("5"), T0),
    ])
    rej = orders.rejected_order_events(ev).collect()
    assert [(r.seq, r.reason) for r in sorted(rej, key=lambda r: r.seq)] == [
        (2, orders.ADD_REJECTED), (3, orders.EDIT_REJECTED)]
    st = orders.order_state(ev).collect()[0]
    assert st.status == "closed" and st.payment_method == "cash" and st.subtotal == Decimal("10.0000")


def test_add_moves_ready_back_to_open_but_replace_does_not(spark):
    ev = _events(spark, [
        (1, 0, "create", None, None, 1, Decimal("10"), T0),
        (1, 1, "status", "ready", None, 1, Decimal("0"), T0),
        (1, 2, "replace", None, None, 3, Decimal("2"), T0),
        (2, 0, "create", None, None, 1, Decimal("10"), T0),
        (2, 1, "status", "ready", None, 1, Decimal("0"), T0),
        (2, 2, "add", None, None, 3, Decimal("2"), T0),
    ])
    st = {r.order_id: (r.status, r.subtotal) for r in orders.order_state(ev).collect()}
    assert st == {1: ("ready", Decimal("6.0000")), 2: ("open", Decimal("16.0000"))}


def _orders(spark, rows):
    return spark.createDataFrame(
        rows, "order_id bigint, restaurant_id int, table_id bigint, source string, status string, "
              "total decimal(18,4), customer_id bigint, created_at timestamp_ntz")


def test_sales_since_is_inclusive_and_null_totals(spark):
    o = _orders(spark, [
        (1, 1, None, "pos", "closed", Decimal("10"), None, dt.datetime(2000, 1, 1)),
        (2, 1, None, "qr", "closed", None, None, dt.datetime(2000, 6, 1)),
        (3, 1, None, "qr", "void", Decimal("99"), None, dt.datetime(2000, 6, 1)),
        (4, 1, None, "pos", "closed", Decimal("30"), None, dt.datetime(1999, 12, 31, 23, 59)),
    ])
    r = sales.sales_summary(o, _restaurants(spark), "2000-01-01").collect()[0]
    assert (r.total_sales, r.order_count, r.avg_order) == (Decimal("10.0000"), 2, 10.0)
    empty = sales.sales_summary(o, _restaurants(spark), "2030-01-01").collect()[0]
    assert (empty.total_sales, empty.order_count, empty.avg_order) == (Decimal("0.0000"), 0, 0.0)


def test_top_items_group_by_name(spark):
    o = _orders(spark, [(1, 1, None, "pos", "closed", Decimal("1"), None, dt.datetime(2001, 1, 1))])
    items = spark.createDataFrame(
        [(1, 1, 10, "Latte", Decimal("1"), 2), (1, 2, 11, "Latte", Decimal("1"), 2), (1, 3, 12, "Tea", Decimal("1"), 3)],
        "order_id bigint, line_no int, menu_item_id bigint, name_snapshot string, price_snapshot decimal(18,4), qty int")
    top = [(r.name, r.qty, r.rank) for r in sales.top_items(o, items, "2000-01-01").orderBy("rank").collect()]
    assert top == [("Latte", 4, 1), ("Tea", 3, 2)]


def test_urgent_needs_more_than_five(spark):
    rows = [(i, 1, t, T0, False, None) for t, n in ((1, 5), (2, 6)) for i in range(t * 10, t * 10 + n)]
    c = spark.createDataFrame(rows, "call_id bigint, restaurant_id int, table_id bigint, created_at timestamp_ntz, "
                                    "acknowledged boolean, acknowledged_by bigint")
    tables = spark.createDataFrame([(1, 1, "Table 1", "t1"), (2, 1, "Table 2", "t2")],
                                   "table_id bigint, restaurant_id int, label string, qr_token string")
    got = {r.table_id: (r.call_count, r.urgent) for r in calls.active_calls(c, tables).collect()}
    assert got == {1: (5, False), 2: (6, True)}


def test_ack_then_fewer_rings_raises_no_alert(spark):
    h = dt.timedelta(hours=1)
    log = spark.createDataFrame([
        (1, 7, "ring", 0, T0), (2, 7, "ring", 0, T0), (3, 7, "ring", 0, T0),          # poll 1: 3
        (4, 7, "ack", 1, T0 + h), (5, 7, "ring", 0, T0 + h),                         # poll 2: 1 (no alert)
        (6, 7, "ring", 0, T0 + 2 * h), (7, 7, "ring", 0, T0 + 2 * h),               # poll 3: 3 (alert)
    ], "seq bigint, table_id bigint, kind string, staff_id bigint, ts timestamp_ntz")
    got = [(r.call_count, r.prev_count) for r in calls.newly_ringing(log).orderBy("poll_at").collect()]
    assert got == [(3, 0), (3, 1)]


def test_debounce_compares_with_last_accepted_ring(spark):
    s = dt.timedelta(seconds=1)
    log = spark.createDataFrame([(i, 1, "ring", 0, T0 + k * s) for i, k in enumerate([0, 10, 16, 20, 31, 45])],
                                "seq bigint, table_id bigint, kind string, staff_id bigint, ts timestamp_ntz")
    got = [r.accepted for r in calls.ring_debounce(log).orderBy("seq").collect()]
    # 10 is within 15 s of 0; 16 is accepted (16 s after 0) though only 6 s after 10
    assert got == [True, False, True, False, True, False]
    # the walk crosses chunks of any size
    for rings in (1, 2, 4):
        assert [r.accepted for r in calls.ring_debounce(log, chunk_rings=rings).orderBy("seq").collect()] == got


def test_feedback_order_check_comes_first(spark):
    o = _orders(spark, [(1, 1, None, "pos", "closed", Decimal("1"), None, T0)])
    ev = spark.createDataFrame([(1, 1, 4, "ok"), (1, 2, 5, None), (1, 3, 0, "bad"), (2, 1, 9, "x"), (1, 4, None, "n")],
                               "order_id bigint, seq bigint, rating int, comment string")
    up = feedback.feedback_upsert(ev, o).collect()[0]
    assert (up.rating, up.comment, up.first_seq, up.n_submissions) == (5, None, 1, 2)
    rej = {(r.order_id, r.seq): r.reason for r in feedback.rejected_feedback(ev, o).collect()}
    assert rej == {(1, 3): feedback.BAD_RATING, (2, 1): feedback.ORDER_NOT_FOUND, (1, 4): feedback.NULL_RATING}


def test_receipt_text_and_link(spark):
    o = _orders(spark, [(1, 1, None, "pos", "closed", Decimal("104.5"), None, T0)])
    items = spark.createDataFrame(
        [(1, 1, 10, "Chai (large)", Decimal("49.75"), 2)],
        "order_id bigint, line_no int, menu_item_id bigint, name_snapshot string, price_snapshot decimal(18,4), qty int")
    text = receipts.receipt_text(o, items, _restaurants(spark)).collect()[0].receipt
    assert text == "Order receipt - Cafe\n\n2x Chai (large) - PKR 100\n\nTotal: PKR 105"
    link = receipts.receipt_link_restaurant(o, items, _restaurants(spark)).collect()[0].link
    assert link.startswith("https://wa.me/923001234567?text=Order%20receipt%20-%20Cafe%0A%0A2x%20Chai%20(large)")


def test_encode_uri_component(spark):
    df = spark.createDataFrame([("a b!'()*~-_.:/?&=+%é",)], "s string")
    got = df.select(encode_uri_component(F.col("s")).alias("e")).collect()[0].e
    assert got == "a%20b!'()*~-_.%3A%2F%3F%26%3D%2B%25%C3%A9"


def test_menu_tree_keeps_empty_category_and_drops_orphans(spark):
    cats = spark.createDataFrame([(1, "c1", "Hot", 1), (1, "c2", "Cold", 2), (1, "c3", "Hot", 3), (2, "c4", "Hot", 1)],
                                 "restaurant_id int, category_id string, name string, sort_order int")
    items = spark.createDataFrame(
        [(10, 1, "c1", "Tea", Decimal("1"), True, 2), (11, 1, "c1", "Coffee", Decimal("1"), True, 1),
         (12, 1, None, "Orphan", Decimal("1"), True, 1), (13, 1, "c2", "Ice", Decimal("1"), False, 1),
         (14, 1, "c3", "Soup", Decimal("1"), True, 1), (15, 1, "c4", "Foreign", Decimal("1"), True, 1)],
        "menu_item_id bigint, restaurant_id int, category_id string, name string, price decimal(18,4), "
        "is_available boolean, sort_order int")
    tree = {(r.restaurant_id, r.category_id, r.category): [x.name for x in r["items"]]
            for r in reads.menu_tree(cats, items).collect()}
    # two categories of one name stay apart, another tenant's category takes no item
    assert tree == {(1, "c1", "Hot"): ["Coffee", "Tea"], (1, "c2", "Cold"): [], (1, "c3", "Hot"): ["Soup"],
                    (2, "c4", "Hot"): []}


def test_event_time_rules_ignore_the_session_zone(spark):
    """Debounce gaps, poll grids and positions are in UTC whatever the session zone."""
    rows = [(0, 1, "ring", 1, dt.datetime(2024, 3, 10, 1, 59, 50)),   # New York skips 02:00-03:00
            (1, 1, "ring", 1, dt.datetime(2024, 3, 10, 2, 0, 1)),
            (2, 1, "ring", 1, dt.datetime(2024, 3, 10, 2, 59, 59)),
            (3, 1, "ring", 1, dt.datetime(2024, 3, 10, 3, 0, 5)),
            (4, 1, "ring", 1, dt.datetime(2024, 11, 3, 1, 30, 0))]
    log = spark.createDataFrame(rows, "seq bigint, table_id bigint, kind string, staff_id bigint, ts timestamp_ntz")
    orders = spark.createDataFrame([(i, 1, r[4]) for i, r in enumerate(rows)],
                                   "order_id bigint, restaurant_id bigint, created_at timestamp_ntz")

    def run():
        return (sorted(tuple(r) for r in calls.ring_debounce(log).select("seq", "accepted").collect()),
                sorted(tuple(r) for r in calls.newly_ringing(log).collect()),
                sorted(tuple(r) for r in reads.with_position(orders, "restaurant_id", "created_at", "order_id")
                       .select("order_id", "position").collect()))

    utc = run()
    # 02:00:01 is 11 s after 01:59:50 and 03:00:05 is 6 s after 02:59:59 on the
    # wall clock: both dropped under any zone
    assert [a for _, a in utc[0]] == [True, False, True, False, True]
    for zone in ("America/New_York", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert run() == utc
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_request_must_be_an_array_and_prices_must_fit(spark):
    from tavolo.operators import ingest
    reqs = spark.createDataFrame(
        [(1, 7, '{"menu_item_id":"10","name":"a","price":"1","qty":"1"}'),
         (2, 7, '[{"menu_item_id":"10","name":"a","price":"50.12345","qty":"1"}]'),
         (3, 7, '[{"menu_item_id":"10","name":"a","price":"50.1234","qty":"1"}]')],
        "order_id long, restaurant_id long, items string")
    tenants = spark.createDataFrame([(7,)], "restaurant_id long")
    items = spark.createDataFrame([(10,)], "menu_item_id long")
    got = {r.order_id: r.reason for r in ingest.rejected_requests(reqs, tenants, items).collect()}
    assert got == {1: "items is not a JSON array", 2: "price does not fit"}


def test_receipt_counts_a_null_qty_as_zero(spark):
    from tavolo.operators.receipts import _receipt
    rows = spark.createDataFrame([([("Tea", 5.0, None), ("Cake", 3.0, 2)],)],
                                 "items array<struct<name_snapshot:string,price_snapshot:double,qty:int>>")
    text = rows.select(_receipt(F.col("items"), F.lit("Shop"), F.lit("PKR"), F.lit(6.0), True, True)).first()[0]
    assert "0x Tea - PKR 0" in text and "2x Cake - PKR 6" in text


def test_debounce_of_a_long_burst_is_one_pass(spark):
    log = spark.range(50_000).selectExpr("id as seq", "1L as table_id", "'ring' as kind",
                                         "cast(timestamp_seconds(id) as timestamp_ntz) as ts")
    got = calls.ring_debounce(log, 15).where("accepted")
    assert got.count() == -(-50_000 // 15)


def test_debounce_of_a_dense_and_endless_burst(spark):
    """200,000 rings of one table, 1 s apart and then 500 within each second: one path, chunks of bounded rows."""
    log = spark.range(200_000).selectExpr(
        "id as seq", "1L as table_id", "'ring' as kind",
        "cast(timestamp_millis(if(id < 100000, id * 1000, 100000000 + (id - 100000) * 2)) as timestamp_ntz) as ts")
    got = calls.ring_debounce(log, 15).where("accepted").agg(F.count("seq").alias("n"), F.max("seq").alias("last")).first()
    ms = [i * 1000 if i < 100_000 else 100_000_000 + (i - 100_000) * 2 for i in range(200_000)]
    want = [i for i, ok in enumerate(replay_debounce(ms, 15_000)) if ok]
    assert (got.n, got["last"]) == (len(want), want[-1])
