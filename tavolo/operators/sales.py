"""Sales analytics over closed orders, all tenants in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from tavolo.functions.money import MONEY
from tavolo.operators.common import (EMPTY_MARK, RECENT_ORDERS_LIMIT, REPORT_PERIOD_DAYS,
                                     TOP_ITEMS_LIMIT, items_text, order_lines, ts_lit)
from tavolo.plans import cut_lineage
from tavolo.plans.joins import checked_broadcast


def closed_since(orders: DataFrame, since) -> DataFrame:
    """status = 'closed' and created_at >= since (inclusive); both push into the scan."""
    return orders.where((F.col("status") == "closed") & (F.col("created_at") >= ts_lit(since)))


def _avg(sum_col, n_col):
    return F.when(n_col > 0, sum_col.cast("double") / n_col)


def sales_summary(orders: DataFrame, restaurants: DataFrame, since) -> DataFrame:
    """Per tenant: total sales, order count, average order; zeros when none.

    count(*) counts orders with a NULL total, avg ignores them.
    """
    agg = (closed_since(orders, since).groupBy("restaurant_id")
           .agg(F.sum("total").cast(MONEY).alias("s"), F.count(F.lit(1)).alias("n"),
                F.count("total").alias("n_total")))
    return (restaurants.select("restaurant_id").join(agg, "restaurant_id", "left")
            .select("restaurant_id",
                    F.coalesce(F.col("s"), F.lit(0).cast(MONEY)).alias("total_sales"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("int").alias("order_count"),
                    F.coalesce(_avg(F.col("s"), F.col("n_total")), F.lit(0.0)).alias("avg_order")))


def item_sales(orders: DataFrame, order_items: DataFrame, since) -> DataFrame:
    """(restaurant_id, name) -> qty sold over closed orders; grouped by name."""
    o = closed_since(orders, since).select("order_id", "restaurant_id")
    li = order_items.select("order_id", "name_snapshot", "qty")
    return (li.join(o, "order_id")
            .groupBy("restaurant_id", F.col("name_snapshot").alias("name"))
            .agg(F.sum("qty").cast("bigint").alias("qty")))


def top_items(orders: DataFrame, order_items: DataFrame, since, k: int = TOP_ITEMS_LIMIT) -> DataFrame:
    """Top k item names by quantity per tenant; ties broken by name."""
    w = Window.partitionBy("restaurant_id").orderBy(F.col("qty").desc(), F.col("name"))
    return (item_sales(orders, order_items, since)
            .withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))


def best_seller(orders, order_items, restaurants, since) -> DataFrame:
    top = top_items(orders, order_items, since, 1).select("restaurant_id", "name")
    return (restaurants.select("restaurant_id").join(top, "restaurant_id", "left")
            .select("restaurant_id", F.coalesce("name", F.lit(EMPTY_MARK)).alias("best_seller")))


def source_split(orders: DataFrame, since) -> DataFrame:
    return (closed_since(orders, since).groupBy("restaurant_id", "source")
            .agg(F.count(F.lit(1)).alias("order_count")))


def source_split_filled(orders: DataFrame, restaurants: DataFrame, since) -> DataFrame:
    """pos and qr counts per tenant, zero-filled; other sources not shown."""
    piv = (closed_since(orders, since).groupBy("restaurant_id")
           .pivot("source", ["pos", "qr"]).agg(F.count(F.lit(1))))
    return (restaurants.select("restaurant_id").join(piv, "restaurant_id", "left")
            .select("restaurant_id",
                    F.coalesce("pos", F.lit(0)).cast("bigint").alias("pos_orders"),
                    F.coalesce("qr", F.lit(0)).cast("bigint").alias("qr_orders")))


def recent_orders(orders, tables, order_items, feedback, since,
                  k: int = RECENT_ORDERS_LIMIT) -> DataFrame:
    """Newest k closed orders per tenant with label, items and feedback.

    Rank first (WindowGroupLimit keeps k rows per tenant before the
    shuffle), then join the small ranked set to labels, lines and feedback.
    The ranked ids are checkpointed once for both scans; they (k per tenant) are counted and broadcast into the line
    and feedback scans, so those are filtered where they are read instead
    of shuffled whole.
    """
    w = Window.partitionBy("restaurant_id").orderBy(F.col("created_at").desc(), F.col("order_id").desc())
    ranked = (closed_since(orders, since)
              .select("order_id", "restaurant_id", "table_id", "source", "total", "created_at")
              .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
    return _with_details(ranked, cut_lineage(ranked.select("order_id")), tables, order_items, feedback).select(
        "restaurant_id", "rank", "order_id", "source", "total", "created_at", "table_label", "items", "rating",
        "comment", "stars")


def _with_details(ranked: DataFrame, ids: DataFrame, tables, order_items, feedback) -> DataFrame:
    """Label, lines and feedback of ranked orders; ``ids`` are theirs, computed already."""
    ids = checked_broadcast(ids)
    lines = order_lines(order_items.join(ids, "order_id", "left_semi").select(
        "order_id", *[c for c in ("line_no", "menu_item_id", "name_snapshot", "price_snapshot", "qty")
                      if c in order_items.columns]),
        *[c for c in ("menu_item_id", "name_snapshot", "price_snapshot", "qty") if c in order_items.columns])
    out = ranked.join(lines, "order_id", "left")
    if tables is not None:
        out = out.join(tables.select("table_id", F.col("label").alias("table_label")), "table_id", "left")
    if feedback is not None:
        fb = feedback.join(ids, "order_id", "left_semi").select("order_id", "rating", "comment")
        stars = F.when(F.col("rating") > 0,
                       F.concat(F.repeat(F.lit("★"), F.col("rating")),
                                F.repeat(F.lit("☆"), F.greatest(F.lit(5) - F.col("rating"), F.lit(0)))))
        out = out.join(fb, "order_id", "left").withColumn("stars", stars)
    return out


@dataclass
class PeriodPanels:
    """The dashboard's panels for nested rolling periods, all from one closed slice."""
    summary: DataFrame          # restaurant_id, days, total_sales, order_count, avg_order
    source_split: DataFrame     # restaurant_id, days, pos_orders, qr_orders
    top_items: DataFrame        # restaurant_id, days, rank, name, qty
    recent_orders: DataFrame    # restaurant_id, days, rank, order_id, source, total, created_at, table_label, items, ...


def period_panels(orders, order_items, restaurants, as_of, tables=None, feedback=None, days=REPORT_PERIOD_DAYS,
                  k_items: int = TOP_ITEMS_LIMIT, k_orders: int = RECENT_ORDERS_LIMIT) -> PeriodPanels:
    """Summary, source split, top items and recent orders for each rolling period.

    Periods nest (1 day within 7 within 30), so each closed order is tagged
    with the smallest period that holds it; the tagged slice is
    checkpointed, and every panel reads it instead of the orders.  A
    tenant's figures are aggregated per tag and only the *aggregated* rows
    are expanded into the periods that contain their tag (at most
    ``len(days)`` copies of a small table).  A tenant's newest k orders of
    a short period are the first of its newest k of the longest one, so
    they are ranked once.  Lines are joined to the slice once.
    """
    days = sorted(days)
    asof = ts_lit(as_of)
    tag = None  # built from the widest period inward, so the smallest match wins
    for d in reversed(days):
        cond = F.col("created_at") >= asof - F.expr(f"INTERVAL {int(d)} DAYS")
        tag = F.when(cond, F.lit(d)) if tag is None else F.when(cond, F.lit(d)).otherwise(tag)
    oldest = asof - F.expr(f"INTERVAL {int(days[-1])} DAYS")
    wanted = [c for c in ("order_id", "restaurant_id", "table_id", "source", "total", "created_at") if c in orders.columns]
    closed = cut_lineage(orders.where((F.col("status") == "closed") & (F.col("created_at") >= oldest))
                         .select(*wanted, tag.alias("tag")))
    periods = F.array(*[F.lit(d) for d in days])

    def spread(df):  # a row tagged t counts in every period d >= t
        return df.withColumn("days", F.explode(F.filter(periods, lambda d: d >= F.col("tag"))))

    per_tag = (closed.groupBy("restaurant_id", "tag")
               .agg(F.sum("total").alias("s"), F.count(F.lit(1)).alias("n"),
                    F.count("total").alias("n_total"),
                    F.count(F.when(F.col("source") == "pos", 1)).alias("pos"),
                    F.count(F.when(F.col("source") == "qr", 1)).alias("qr")))
    summ = (spread(per_tag).groupBy("restaurant_id", "days")
            .agg(F.sum("s").cast(MONEY).alias("s"), F.sum("n").alias("n"), F.sum("n_total").alias("n_total"),
                 F.sum("pos").alias("pos"), F.sum("qr").alias("qr")))
    # every (tenant, period) row exists even when the period is empty
    zero = F.lit(0)
    grid = (restaurants.select("restaurant_id", F.explode(periods).alias("days"))
            .join(summ, ["restaurant_id", "days"], "left"))
    summary = grid.select("restaurant_id", "days", F.coalesce("s", zero.cast(MONEY)).alias("total_sales"),
                          F.coalesce("n", zero).cast("int").alias("order_count"),
                          F.coalesce(_avg(F.col("s"), F.col("n_total")), F.lit(0.0)).alias("avg_order"))
    split = grid.select("restaurant_id", "days", F.coalesce("pos", zero).cast("bigint").alias("pos_orders"),
                        F.coalesce("qr", zero).cast("bigint").alias("qr_orders"))

    li = order_items.select("order_id", "name_snapshot", "qty")
    items = (li.join(closed.select("order_id", "restaurant_id", "tag"), "order_id")
             .groupBy("restaurant_id", F.col("name_snapshot").alias("name"), "tag").agg(F.sum("qty").alias("q")))
    per_name = spread(items).groupBy("restaurant_id", "days", "name").agg(F.sum("q").cast("bigint").alias("qty"))
    best_w = Window.partitionBy("restaurant_id", "days").orderBy(F.col("qty").desc(), F.col("name"))
    top = per_name.withColumn("rank", F.row_number().over(best_w)).where(F.col("rank") <= k_items)

    newest = Window.partitionBy("restaurant_id").orderBy(F.col("created_at").desc(), F.col("order_id").desc())
    ranked = closed.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= k_orders)
    ranked = cut_lineage(ranked)
    recent = _with_details(ranked, ranked.select("order_id"), tables, order_items, feedback)
    return PeriodPanels(summary, split, top, spread(recent).drop("tag", "table_id"))


def sales_by_period(orders, order_items, restaurants, as_of, days=REPORT_PERIOD_DAYS) -> DataFrame:
    """One row per (tenant, period): summary, source split and best seller."""
    p = period_panels(orders, order_items, restaurants, as_of, days=days)
    best = p.top_items.where("rank = 1").select("restaurant_id", "days", F.col("name").alias("best_seller"))
    key = ["restaurant_id", "days"]
    return (p.summary.join(p.source_split, key).join(best, key, "left")
            .withColumn("best_seller", F.coalesce("best_seller", F.lit(EMPTY_MARK))))


__all__ = ["sales_summary", "item_sales", "top_items", "best_seller", "source_split",
           "source_split_filled", "recent_orders", "period_panels", "sales_by_period", "closed_since", "items_text"]
