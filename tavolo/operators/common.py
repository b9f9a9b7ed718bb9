"""Small shared pieces: parameters, nested item lists, literal tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed values of the reference (page defaults and thresholds).
TOP_ITEMS_LIMIT = 5
RECENT_ORDERS_LIMIT = 8
URGENT_ABOVE = 5                 # more than 5 open rings is urgent
RING_COOLDOWN_SECONDS = 15       # call-waiter button lock
REPORT_PERIOD_DAYS = (1, 7, 30)  # dashboard period buttons
TRACKER_STEPS = ("open", "preparing", "ready", "closed")
EMPTY_MARK = "—"            # "—" shown when there is no best seller


def ts_lit(value) -> Column:
    """A timestamp parameter as a foldable literal (pushes into scans)."""
    if isinstance(value, (dt.datetime, dt.date)):
        value = value.isoformat(sep=" ") if isinstance(value, dt.datetime) else value.isoformat()
    return F.lit(str(value)).cast("timestamp_ntz")


def order_lines(order_items: DataFrame, *fields: str) -> DataFrame:
    """order_id -> items: array of line structs sorted by line.

    Partial aggregation is not possible for collect_list, but the group
    is one order's lines, bounded by that order's payload.
    """
    cols = [F.col(f) for f in ("line_no",) + fields]
    return (order_items.groupBy("order_id")
            .agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("items")))


def attach_lines(orders: DataFrame, order_items: DataFrame, *fields: str) -> DataFrame:
    """``orders`` plus ``items`` (line structs sorted by line; NULL without lines).

    For a large share of the orders (all active ones, say): join first and
    aggregate once, so the order side is shuffled once by order_id (a
    semi-join, aggregate and join back shuffles it twice), and the
    collect_list runs as a sort aggregate over the join's sorted output.
    The header columns are functions of order_id and ride along as first().
    """
    cols = ("line_no",) + fields
    heads = [c for c in orders.columns if c != "order_id"]
    li = order_items.select("order_id", *cols, F.lit(True).alias("__hit"))
    line = F.when(F.col("__hit"), F.struct(*[F.col(c) for c in cols]))
    g = (orders.join(li, "order_id", "left").groupBy("order_id")
         .agg(*[F.first(c).alias(c) for c in heads],
              F.sort_array(F.collect_list(line)).alias("items")))
    return g.withColumn("items", F.when(F.size("items") > 0, F.col("items")))


def items_text(items: Column, with_price: bool = False) -> Column:
    """"2x A, 1x B" (optionally "2x A @ 12.5000") from a line array."""
    def one(x):
        base = F.concat(x["qty"].cast("string"), F.lit("x "), x["name_snapshot"])
        if with_price:
            base = F.concat(base, F.lit(" @ "), x["price_snapshot"].cast("string"))
        return base
    return F.array_join(F.transform(items, one), ", ")


def literal_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A fixed, tiny table (role maps, period lists): always broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))
