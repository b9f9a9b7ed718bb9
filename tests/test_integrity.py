"""Foreign-key deletes, constraint rules, request checks, panels and the distributed rank against plain Python."""

import datetime as dt
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tavolo.catalog import AS_OF, DELETES, ROW_KEYS, TABLES, shop
from tavolo.operators import ingest, integrity, reads, sales
from tavolo.operators.integrity import CASCADE, SET_NULL, Reference, Rule
from tavolo.plans.scan import range_counts


def test_deletes_spread_along_a_graph(spark):
    """root -> mid (cascade) -> leaf (cascade); leaf.tag -> tag (set null); NULL and unknown references stay."""
    refs = (Reference("mid", "root_id", "root", "root_id", CASCADE), Reference("leaf", "mid_id", "mid", "mid_id", CASCADE),
            Reference("leaf", "tag", "tag", "tag", SET_NULL))
    t = {"leaf": spark.createDataFrame([(1, 10, 5), (2, 11, 5), (3, 12, 6), (4, None, 6), (5, 99, 7), (6, 12, None)],
                                       "leaf_id int, mid_id int, tag int"),
         "root": spark.createDataFrame([(1,), (2,)], "root_id int"),
         "tag": spark.createDataFrame([(5,), (6,)], "tag int"),
         "mid": spark.createDataFrame([(10, 1), (11, 2), (12, None)], "mid_id int, root_id int")}
    assert integrity.parents_first(t, refs).index("mid") > integrity.parents_first(t, refs).index("root")
    d = {"root": spark.createDataFrame([(1,), (1,)], "root_id int"), "tag": spark.createDataFrame([(6,)], "tag int")}
    after = integrity.cascade_delete(t, d, refs)
    assert sorted(tuple(r) for r in after["mid"].collect()) == [(11, 2), (12, None)]
    assert sorted(map(tuple, after["leaf"].collect()), key=str) == sorted(
        [(2, 11, 5), (3, 12, None), (4, None, None), (5, 99, 7), (6, 12, None)], key=str)
    assert after["leaf"].columns == ["leaf_id", "mid_id", "tag"]
    with pytest.raises(ValueError):
        integrity.parents_first(["a", "b"], (Reference("a", "x", "b", "x", CASCADE), Reference("b", "y", "a", "y", CASCADE)))


def test_each_fact_is_scanned_once(spark, small_dir):
    s = shop(spark, small_dir)
    frames = {t: getattr(s, t) for t in TABLES}
    dels = {t: frames[t].where(F.expr(c)).select(ROW_KEYS[t][0]) for t, c in DELETES.items()}
    after = integrity.cascade_delete(frames, dels)
    for name, file in (("order_items", "lineitem.parquet"), ("calls", "events.parquet"), ("feedback", "labels.parquet")):
        plan = after[name]._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation") >= 1 and plan.count("l_orderkey#") < 40
        assert after[name]._jdf.queryExecution().executedPlan().toString().count(file) == 1
    # parents were read once into the checkpoint: no order file in what is left to run
    assert "orders.parquet" not in after["order_items"]._jdf.queryExecution().executedPlan().toString()


def test_rules_count_rows_in_one_pass_a_table(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, None, 9), (None, "a", 0), (None, "a", None), (2, "b", 3),
                                (1, "a", 4)], "t int, p string, n int")
    rules = (Rule("x", "unique", ("t", "p")), Rule("x", "unique", ("p",)), Rule("x", "not null", ("p",)),
             Rule("x", "not null", ("t",)), Rule("x", "check", check="n between 1 and 5"), Rule("y", "unique", ("p",)))
    got = {r.rule: r.violations for r in integrity.constraint_audit({"x": df, "y": df.where("false")}, rules).collect()}
    # NULL keys repeat nothing, a NULL check holds
    assert got == {"x (t, p) unique": 3, "x.p unique": 5, "x.p not null": 1, "x.t not null": 2,
                   "x check n between 1 and 5": 2, "y.p unique": 0}


def test_planted_violations_are_found(spark, small_dir):
    from tavolo.catalog import QUERIES
    got = {r.rule: r.violations for r in QUERIES["constraint_audit"](spark, small_dir).collect()}
    assert len(got) == len(integrity.RULES) and all(v > 0 for v in got.values()), got


def test_every_reject_reason_occurs_and_headers_are_the_rest(spark, small_dir):
    s = shop(spark, small_dir)
    args = (s.requests, s.restaurants, s.menu_items, s.tables, s.staff)
    reasons = Counter(r.reason for r in ingest.rejected_requests(*args).collect())
    assert set(reasons) == {"items is not a JSON array", "bad qty", "bad price", "price does not fit", "missing name",
                            "missing price", "missing qty", "bad menu_item_id", "unknown menu item",
                            "unknown restaurant", "unknown table", "unknown staff"}
    heads = ingest.order_headers(ingest.parse_request_lines(*args), s.restaurants)
    assert heads.count() + sum(reasons.values()) == s.requests.count()
    # a null table or staff id is no fault
    assert heads.where("table_id is null").count() > 0 and heads.where("staff_id is null").count() > 0


def test_a_stored_customer_is_no_request(spark):
    t0 = dt.datetime(2024, 1, 1)
    req = spark.createDataFrame([(5, 1, "123", True, t0), (6, 1, "123", False, t0 + dt.timedelta(days=1))],
                                "order_id long, restaurant_id int, phone string, opt_in boolean, created_at timestamp_ntz")
    first = ingest.customer_upsert(req.where("order_id = 5"))
    again = ingest.customer_upsert(req.where("order_id = 6"), existing=first).first()
    whole = ingest.customer_upsert(req).first()
    assert (again.n_requests, again.marketing_opt_in, again.created_at) == (2, False, t0)
    assert (whole.n_requests, whole.marketing_opt_in, whole.created_at) == (2, False, t0)
    bare = ingest.customer_upsert(req.where("order_id = 6"), existing=first.drop("n_requests")).first()
    assert bare.n_requests == 1


def test_panels_come_from_one_slice(spark, small_dir):
    s = shop(spark, small_dir)
    p = sales.period_panels(s.orders, s.order_items, s.restaurants, AS_OF, s.tables, s.feedback)
    for df in (p.summary, p.source_split, p.top_items, p.recent_orders):
        assert "orders.parquet" not in df._jdf.queryExecution().executedPlan().toString()
    for days in (1, 7, 30):
        since = dt.date.fromisoformat(AS_OF) - dt.timedelta(days=days)
        want = sales.recent_orders(s.orders, s.tables, s.order_items, s.feedback, since)
        got = p.recent_orders.where(F.col("days") == days)
        assert sorted((r.restaurant_id, r.rank, r.order_id, r.table_label, str(r["items"]), r.stars) for r in got.collect()) \
            == sorted((r.restaurant_id, r.rank, r.order_id, r.table_label, str(r["items"]), r.stars) for r in want.collect())
        top = sales.top_items(s.orders, s.order_items, since)
        assert sorted(map(tuple, p.top_items.where(F.col("days") == days).select(*top.columns).collect())) \
            == sorted(map(tuple, top.collect()))


def test_a_hot_tenant_day_is_ranked_by_many_tasks(spark):
    """All orders of one tenant within one second: ranges split them, ties go by id, NULL tenants are one key."""
    n = 40_000
    df = spark.range(n).selectExpr("id as order_id", "if(id % 100 = 0, null, 7) as restaurant_id",
                                   "timestamp_ntz'2024-01-01 10:00:00' as created_at")
    ranked = reads.with_position(df, "restaurant_id", "created_at", "order_id", partitions=8)
    got = {r.order_id: r.position for r in ranked.collect()}
    assert len(got) == n
    hot = sorted(o for o in got if o % 100)
    assert [got[o] for o in hot] == list(range(1, len(hot) + 1))
    assert [got[o] for o in range(0, n, 100)] == list(range(1, n // 100 + 1))
    parts = df.repartitionByRange(8, "restaurant_id", "created_at", "order_id").groupBy(F.spark_partition_id()).count()
    sizes = [r["count"] for r in parts.collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * n / 8


def test_range_counts_sum_weights(spark):
    rows = [(k, i % 5, i, (i * 7) % 3) for k in ("a", "b", None) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, o int, t int, w long")
    got = {(r.k, r.t): r.s for r in range_counts(df, "k", ["o", "t"], "s", weight=F.col("w"), partitions=5).collect()}
    for key in ("a", "b", None):
        total = 0
        for _, o, t, w in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            total += w
            assert got[key, t] == total


def test_order_header_amounts(spark):
    t0 = dt.datetime(2024, 1, 1)
    req = spark.createDataFrame(
        [(1, 1, 3, "qr", None, " ", True, t0, '[{"name": "a", "price": "2.5", "qty": "3"}]'),
         (2, 1, None, "pos", 4, "12", True, t0, "[]"), (3, 1, 8, "qr", None, "12", True, t0, "[]"),
         (4, 1, 3, "qr", 9, "12", True, t0, "[]")],
        "order_id long, restaurant_id int, table_id long, source string, staff_id long, phone string, opt_in boolean, "
        "created_at timestamp_ntz, items string")
    rest = spark.createDataFrame([(1, Decimal("0.1"))], "restaurant_id int, tax_rate decimal(9,6)")
    menu = spark.createDataFrame([], "menu_item_id long")
    lines = ingest.parse_request_lines(req, rest, menu, spark.createDataFrame([(3,)], "table_id long"),
                                       spark.createDataFrame([(4,)], "staff_id long"))
    got = {r.order_id: (r.table_id, r.status, r.subtotal, r.tax, r.total, r.n_lines, r.customer_id is None)
           for r in ingest.order_headers(lines, rest).collect()}
    assert got == {1: (3, "open", Decimal("7.5"), 1, Decimal("8.5"), 1, True), 2: (None, "open", None, None, None, 0, False)}
    rejected = {r.order_id: r.reason for r in lines.where("reason is not null").collect()}
    assert rejected == {3: "unknown table", 4: "unknown staff"}
