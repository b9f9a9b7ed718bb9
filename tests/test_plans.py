"""Plan checks: pushdown, top-k before the shuffle, no Python in batch plans,
and the all-tenant = single-tenant metamorphic property."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tavolo.catalog import QUERIES, SINCE, shop
from tavolo.operators import reads, sales


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_udf_in_batch_plans(spark, small_dir, name):
    text = _plan(entry.queries()[name](spark, small_dir))
    assert "EvalPython" not in text and "PythonUDF" not in text and "MapInPandas" not in text


def test_tenant_filter_reaches_the_scan(spark, small_dir):
    s = shop(spark, small_dir)
    df = sales.top_items(s.orders, s.order_items, SINCE).where(F.col("restaurant_id") == 7)
    scan = [ln for ln in _plan(df).splitlines() if "customer.parquet" in ln][0]
    assert "EqualTo(c_nationkey,7)" in scan.split("PushedFilters")[1]


def test_status_and_since_filters_pushed(spark, small_dir):
    s = shop(spark, small_dir)
    text = _plan(sales.source_split(s.orders, SINCE))
    assert "PushedFilters" in text and "o_orderdate" in text.split("PushedFilters")[1][:400]


def test_top_k_is_limited_before_the_shuffle(spark, small_dir):
    s = shop(spark, small_dir)
    df = sales.recent_orders(s.orders, s.tables, s.order_items, s.feedback, SINCE)
    df.write.format("noop").mode("overwrite").save()
    assert "WindowGroupLimit" in df._jdf.queryExecution().optimizedPlan().toString() or \
        "WindowGroupLimit" in _plan(df)


def test_scan_reads_only_needed_columns(spark, small_dir):
    s = shop(spark, small_dir)
    text = _plan(sales.source_split(s.orders, SINCE))
    scan = [ln for ln in text.splitlines() if "orders.parquet" in ln][0]
    assert "o_totalprice" not in scan


def test_role_map_is_the_only_hinted_broadcast(spark, small_dir):
    s = shop(spark, small_dir)
    text = reads.role_queue(spark, s.orders)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in text.lower()


def test_all_tenants_filtered_equals_one_tenant_input(spark, small_dir):
    s = shop(spark, small_dir)
    t = 7
    all_t = sales.sales_summary(s.orders, s.restaurants, SINCE).where(F.col("restaurant_id") == t)
    one = sales.sales_summary(s.orders.where(F.col("restaurant_id") == t),
                              s.restaurants.where(F.col("restaurant_id") == t), SINCE)
    assert [tuple(r) for r in all_t.collect()] == [tuple(r) for r in one.collect()]
    top_all = sales.top_items(s.orders, s.order_items, SINCE).where(F.col("restaurant_id") == t)
    top_one = sales.top_items(s.orders.where(F.col("restaurant_id") == t), s.order_items, SINCE)
    assert sorted(map(tuple, top_all.collect())) == sorted(map(tuple, top_one.collect()))


def _shuffles(df):
    df.write.format("noop").mode("overwrite").save()
    return _plan(df).count("Exchange hashpartitioning")


def test_fold_without_hot_keys_is_one_shuffle(spark, small_dir):
    from tavolo.operators import orders
    s = shop(spark, small_dir)
    # the per-order window and the final aggregate share the order partitioning
    assert _shuffles(orders.order_state(s.order_events)) == 1


def test_hot_keys_take_the_chunked_path(spark, small_dir):
    from tavolo.operators import orders
    from tavolo.plans.scan import CONF_HOT_KEY_ROWS
    s = shop(spark, small_dir)
    plain = orders.order_state(s.order_events)
    spark.conf.set(CONF_HOT_KEY_ROWS, "2")  # orders with 3+ events are hot
    try:
        mixed = orders.order_state(s.order_events)
        assert _shuffles(mixed) > 1  # chunk summaries and carry-ins
        assert sorted(mixed.collect()) == sorted(plain.collect())
    finally:
        spark.conf.unset(CONF_HOT_KEY_ROWS)


def test_broadcast_only_below_the_counted_limit(spark):
    from tavolo.plans.joins import checked_broadcast
    ids = spark.range(3).withColumnRenamed("id", "order_id")
    hinted = checked_broadcast(ids, max_rows=3)._jdf.queryExecution().analyzed().toString().lower()
    plain = checked_broadcast(ids, max_rows=2)._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" in hinted and "broadcast" not in plain
