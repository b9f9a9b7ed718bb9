"""Operational reads: open orders, queues, tracker, menus, tables, staff.

Every read serves all tenants at once; a single-tenant call is the
same frame with a ``restaurant_id`` filter, which Catalyst pushes into
the scan.  All joins are left equi-joins so no order is lost when its
table or customer is gone.  Item lists are aggregated per order first
and joined after (group-then-join), which keeps NULL (no lines) apart
from an empty list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tavolo.functions.money import js_round
from tavolo.functions.text import ACTIVE_STATUSES, is_active, strip_one_trailing_slash
from tavolo.operators.common import TRACKER_STEPS, attach_lines, items_text, literal_table, order_lines
from tavolo.plans import cut_lineage
from tavolo.plans.joins import checked_broadcast
from tavolo.plans.scan import range_counts

# Which active statuses each role's queue shows.
ROLE_QUEUES = {
    "kitchen": ("open", "preparing"),
    "cashier": ("ready",),
    "headwaiter": ACTIVE_STATUSES,
    "manager": ACTIVE_STATUSES,
    "owner": ACTIVE_STATUSES,
}


def tenant_scan(restaurants: DataFrame, slug: str) -> DataFrame:
    """The tenant row(s) for a slug -- a filter pushed into the scan.

    Exactly one row is expected; duplicates are reported by
    ``constraint_audit`` ("restaurants.slug unique").
    """
    return restaurants.where(F.col("slug") == F.lit(slug))


def _labels(tables: DataFrame) -> DataFrame:
    return tables.select("table_id", F.col("label").alias("table_label"))


def open_orders(orders, tables, order_items, customers) -> DataFrame:
    """Active orders, oldest first per tenant, with amounts, label, lines and phone.

    The position is computed on the narrow order rows first, then lines,
    labels and phones join.
    """
    act = orders.where(is_active(F.col("status"))).select(
        "order_id", "restaurant_id", "table_id", "customer_id", "source", "status", "subtotal", "tax", "total",
        "created_at")
    act = attach_lines(with_position(act, "restaurant_id", "created_at", "order_id"),
                       order_items, "menu_item_id", "name_snapshot", "price_snapshot", "qty")
    phones = customers.select("customer_id", F.col("phone").alias("customer_phone"))
    return (act.join(_labels(tables), "table_id", "left")
            .join(phones, "customer_id", "left")
            .select("restaurant_id", "order_id", "table_label", "source", "status", "subtotal", "tax", "total",
                    "created_at", "items", "customer_phone", "position"))


def with_position(df: DataFrame, key: str, ts: str, tiebreak: str, partitions: int | None = None) -> DataFrame:
    """1-based position within ``key`` by (ts, tiebreak): a distributed rank.

    A tenant's orders, those of one day or one second included, spread
    over range partitions (``tavolo.plans.scan.range_counts``).
    """
    d = range_counts(df, key, [ts, tiebreak], "position", partitions=partitions)
    return d.withColumn("position", F.col("position").cast("int"))


def live_orders_digest(orders, tables, order_items, restaurants) -> DataFrame:
    """The live panel text: "Table 3 · QR order · open", "2x A, 1x B", "PKR 1,234"."""
    act = attach_lines(orders.where(is_active(F.col("status")))
                       .select("order_id", "restaurant_id", "table_id", "source", "status", "total", "created_at"),
                       order_items, "menu_item_id", "name_snapshot", "price_snapshot", "qty")
    cur = restaurants.select("restaurant_id", "currency")
    src = F.when(F.col("source") == "qr", F.lit("QR order")).otherwise(F.lit("POS"))
    head = F.concat_ws(" · ", F.coalesce("table_label", F.lit("Takeaway")), src, F.col("status"))
    amount = F.concat(F.col("currency"), F.lit(" "),
                      F.format_number(js_round(F.coalesce(F.col("total").cast("double"), F.lit(0.0))), 0))
    return (act.join(_labels(tables), "table_id", "left")
            .join(cur, "restaurant_id", "left")
            .select("restaurant_id", "order_id", "created_at", head.alias("heading"),
                    F.coalesce(items_text(F.col("items")), F.lit("")).alias("items_text"),
                    amount.alias("amount_text")))


def role_queue(spark: SparkSession, orders: DataFrame) -> DataFrame:
    """Which active orders each role sees (a 12-row literal map, broadcast)."""
    rows = [(r, s) for r, sts in ROLE_QUEUES.items() for s in sts]
    m = literal_table(spark, rows, "role string, status string")
    return (orders.where(is_active(F.col("status"))).join(m, "status")
            .select("role", "restaurant_id", "order_id", "status", "created_at"))


def order_tracker(orders, tables) -> DataFrame:
    """Status, table label and tracker step (open 0 … closed 3, others 0)."""
    steps = F.array(*[F.lit(s) for s in TRACKER_STEPS])
    step = F.greatest(F.lit(0), F.array_position(steps, F.col("status")).cast("int") - 1)
    return (orders.join(_labels(tables), "table_id", "left")
            .select("order_id", "status", "table_label", step.alias("step")))


def newest_active(orders) -> DataFrame:
    """Newest active order per table (any source); table-less orders excluded."""
    w = Window.partitionBy("table_id").orderBy(F.col("created_at").desc(), F.col("order_id").desc())
    return (orders.where(is_active(F.col("status")) & F.col("table_id").isNotNull())
            .select("table_id", "order_id", "status", "subtotal", "tax", "total", "created_at")
            .withColumn("rn", F.row_number().over(w)).where(F.col("rn") == 1).drop("rn"))


def active_order_per_table(orders, order_items) -> DataFrame:
    """Newest active order per table with its lines.

    One order per table: the ranking is checkpointed, so ids, lines and
    output read it once computed; the ids are counted and broadcast into
    the line scan (a shuffle join above the limit).
    """
    act = cut_lineage(newest_active(orders))
    ids = checked_broadcast(act.select("order_id"))
    lines = order_lines(order_items.join(ids, "order_id", "left_semi"),
                        "menu_item_id", "name_snapshot", "price_snapshot", "qty")
    return act.join(lines, "order_id", "left")


def table_by_token(scans, tables) -> DataFrame:
    """Scanned token -> table of that tenant, or none (a takeaway order)."""
    t = tables.select("restaurant_id", "qr_token", "table_id", "label")
    return (scans.join(t, ["restaurant_id", "qr_token"], "left")
            .select("scan_id", "restaurant_id", "qr_token", "table_id", "label",
                    F.when(F.col("table_id").isNull(), F.lit("takeaway")).otherwise(F.lit("dine-in"))
                    .alias("order_type")))


def rescan_route(scans, tables, orders) -> DataFrame:
    """Per scan: 'resume' when the table has an active order, else 'menu'."""
    hit = table_by_token(scans, tables)
    act = newest_active(orders).select(
        "table_id", F.col("order_id").alias("active_order_id"))
    return (hit.join(act, "table_id", "left")
            .select("scan_id", "restaurant_id", "table_id", "order_type", "active_order_id",
                    F.when(F.col("active_order_id").isNotNull(), F.lit("resume"))
                    .otherwise(F.lit("menu")).alias("route")))


def menu_tree(categories, menu_items, available_only: bool = True) -> DataFrame:
    """Categories by sort_order, each with its items by sort_order.

    Items belong to a category by its id, within the tenant (two categories
    of one name stay apart).  They are grouped per (tenant, category)
    first, then joined to the categories, so an empty category keeps [] and
    an item whose category is NULL, unknown or another tenant's drops out.
    """
    mi = menu_items.where(F.col("is_available")) if available_only else menu_items
    mi = mi.where(F.col("category_id").isNotNull())
    per_cat = (mi.groupBy("restaurant_id", "category_id")
               .agg(F.sort_array(F.collect_list(F.struct("sort_order", "name", "menu_item_id", "price")))
                    .alias("items")))
    pos = Window.partitionBy("restaurant_id").orderBy("sort_order", "category", "category_id")
    c = categories.select("restaurant_id", "category_id", F.col("name").alias("category"), "sort_order")
    return (c.join(per_cat, ["restaurant_id", "category_id"], "left")
            .select("restaurant_id", "category_id", "category", "sort_order",
                    F.coalesce("items", F.array().cast(per_cat.schema["items"].dataType)).alias("items"))
            .withColumn("position", F.row_number().over(pos)))


def menu_text(items) -> F.Column:
    return F.array_join(F.transform(items, lambda x: x["name"]), ", ")


def table_list(tables) -> DataFrame:
    """Tables by label (text order: "Table 10" before "Table 2")."""
    w = Window.partitionBy("restaurant_id").orderBy("label", "table_id")
    return tables.select("restaurant_id", "table_id", "label", "qr_token").withColumn(
        "position", F.row_number().over(w))


def table_links(tables, base_url: str) -> DataFrame:
    base = strip_one_trailing_slash(F.lit(base_url))
    return tables.select("restaurant_id", "table_id",
                         F.concat(base, F.lit("/menu.html?t="), F.col("qr_token")).alias("url"))


def mint_table_tokens(tables, salt: str) -> DataFrame:
    """20-char token: tenant id up to its first '-', '-', then hex.

    The hex comes from a salted sha2 of the table key, not uuid(), so a
    recomputed stage gives the same token.  The salt is a secret of the
    caller: whoever knows it can compute every token.
    """
    prefix = F.lower(F.regexp_replace(F.col("restaurant_id").cast("string"), "-.*", ""))
    hexpart = F.substring(F.sha2(F.concat_ws("|", F.lit(salt), F.col("restaurant_id").cast("string"),
                                             F.col("table_id").cast("string")), 256), 1, 32)
    token = F.substring(F.concat(prefix, F.lit("-"), hexpart), 1, 20)
    return tables.select("restaurant_id", "table_id", "label", token.alias("qr_token"))


def staff_directory(staff) -> DataFrame:
    """id, name, role, created_at, oldest first -- never a password hash column."""
    w = Window.partitionBy("restaurant_id").orderBy("created_at", "staff_id")
    return staff.select("restaurant_id", "staff_id", "name", "role", "created_at").withColumn(
        "position", F.row_number().over(w))


def order_feedback(feedback) -> DataFrame:
    """Feedback rows by order; they carry the order's id, so orders are not read."""
    return feedback.select("order_id", "rating", "comment")
