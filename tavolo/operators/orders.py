"""Order-state folds: an append-only order event log -> current orders.

Log schema: order_id, seq, kind (create|status|add|replace|void),
restaurant_id (on create), status_arg, payment, ts and ``items``, the
list of lines ``{menu_item_id, name, price, qty}`` (any number, none
included) that a create / add / replace event carries.  A log with one
``price, qty`` an event instead of ``items`` is read as lists of one line.

No sequential state is needed.  Whether an order is active changes only
through create / status / void events (a valid add maps an active order
to 'open', which is active again).  So one ordered window per order
gives, for every event, the status the order had just before it, and
everything else is an aggregate:

1. ``prior`` = last non-null effect of {create->open, status->arg,
   void->void} over the earlier events of the order, null before its
   first valid create;
2. an event whose list has a line without name, price or qty changes
   nothing (the whole command fails on the not-null columns); an add /
   replace is valid iff ``prior`` is active as well;
3. ``base`` = last valid create or replace; the current lines are the
   concatenated lists of the valid create / replace / add events from
   ``base`` on;
4. status = last of {create->open, status->arg, void->void, valid add->open};
5. closed_at = time of the last void or 'closed' event, payment = the
   last non-null payment;
6. subtotal = sum over the current lines; without lines it is 0 after a
   replace and NULL after a create or add.  Tax uses the rate of the
   order's tenant.

A list is summed inside its event row, so lines are never exploded for
the totals, and the order-level aggregate combines map-side.  The log is
shuffled once (by order and chunk of seq) for the running scans.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from tavolo.functions.money import DEFAULT_TAX_RATE, MONEY, RATE, tax_on
from tavolo.functions.text import ACTIVE_STATUSES
from tavolo.plans.scan import DEFAULT_CHUNK, Prefix, prefix_by_key

ADD_REJECTED = "This order is no longer open for additions"
EDIT_REJECTED = "This order is no longer open for editing"
LINE = "struct<menu_item_id:bigint,name:string,price:decimal(18,4),qty:int>"
LISTED = ("create", "add", "replace")        # kinds of events that carry a list
SUM = "decimal(38,4)"


def item_events(events: DataFrame) -> DataFrame:
    """The log with typed ``items`` (never NULL) and ``restaurant_id``."""
    cols = events.columns
    if "items" not in cols:
        line = F.struct(F.lit(None).cast("bigint").alias("menu_item_id"), F.lit("").alias("name"),
                        F.col("price"), F.col("qty"))
        events = events.withColumn("items", F.array(line)).drop("price", "qty")
    if "restaurant_id" not in cols:
        events = events.withColumn("restaurant_id", F.lit(None).cast("int"))
    empty = F.array().cast(f"array<{LINE}>")
    items = F.when(F.col("kind").isin(*LISTED), F.col("items").cast(f"array<{LINE}>"))
    return events.withColumn("items", F.coalesce(items, empty))


def list_fault(items) -> Column:
    """The first not-null column that a line of the list misses, or NULL."""
    column = (lambda x: F.when(x["name"].isNull(), F.lit("name_snapshot"))
              .when(x["price"].isNull(), F.lit("price_snapshot")).when(x["qty"].isNull(), F.lit("qty")))
    return F.get(F.filter(F.transform(items, column), lambda c: c.isNotNull()), F.lit(0))


def list_total(items) -> Column:
    """Sum of price * qty over a list, NULL for an empty one."""
    total = F.aggregate(items, F.lit(0).cast(SUM), lambda acc, x: (acc + x["price"] * x["qty"]).cast(SUM))
    return F.when(F.size(items) > 0, total)


def annotate_events(events: DataFrame, chunk_size: int = DEFAULT_CHUNK) -> DataFrame:
    """Per event: the order's status before it, and whether it is valid.

    Both scans are chunked running aggregates (``tavolo.plans.scan``): the
    log is shuffled once by (order, chunk of seq), so even an order with a
    huge log is spread over tasks.
    """
    kind = F.col("kind")
    sound = F.col("fault").isNull()
    created = (kind == "create") & sound
    effect = (F.when(created, F.lit("open"))
              .when(kind == "status", F.col("status_arg"))
              .when(kind == "void", F.lit("void")))
    edit = kind.isin("add", "replace")
    # an order that was created has an effect since then, so the last one is never older than its create
    prior = F.when(F.col("exists_before").isNotNull(), F.col("last_effect"))
    # create always applies; add / replace need an active order; status
    # and void need an existing one (else a silent no-op).
    valid = (F.when(kind == "create", sound)
             .when(edit, sound & F.coalesce(prior.isin(*ACTIVE_STATUSES), F.lit(False)))
             .otherwise(prior.isNotNull()))
    base_candidate = F.when(kind.isin("create", "replace") & valid, F.col("seq"))
    e = item_events(events).withColumn("fault", list_fault(F.col("items")))
    e = prefix_by_key(e, ["order_id"], "seq", [
        [Prefix("last_effect", "last", effect, inclusive=False),
         Prefix("exists_before", "max", F.when(created, F.lit(1)), inclusive=False)],
        # the whole-order max = max(running max, running max from the end)
        [Prefix("base_fwd", "max", base_candidate), Prefix("base_rev", "max", base_candidate, reverse=True)],
    ], chunk_size)
    e = (e.withColumns({"prior": prior, "effect": effect, "valid": valid,
                        "base_seq": F.greatest("base_fwd", "base_rev")})
         .drop("base_fwd", "base_rev", "last_effect", "exists_before"))
    e = e.withColumn("status_after", F.when((kind == "add") & F.col("valid"), F.lit("open"))
                     .when(edit, F.lit(None).cast("string"))
                     .when(F.col("valid"), F.col("effect")))
    return e.withColumn("is_line", kind.isin(*LISTED) & F.col("valid") & (F.col("seq") >= F.col("base_seq")))


def fold_orders(events: DataFrame, tax_rate=None, chunk_size: int = DEFAULT_CHUNK,
                restaurants: DataFrame | None = None) -> DataFrame:
    """One row per order: tenant, status, payment, closed_at, lines and totals.

    The tax rate is that of the order's tenant in ``restaurants`` (an
    unknown tenant has none, so tax and total are NULL), else ``tax_rate``.
    The aggregate combines map-side (partial max_by / sum / count), so a
    hot order is pre-aggregated per chunk before the final shuffle.
    """
    e = annotate_events(events, chunk_size)
    kind = F.col("kind")
    closing = F.col("valid") & ((kind == "void") | ((kind == "status") & (F.col("status_arg") == "closed")))
    paid = F.col("valid") & F.col("payment").isNotNull()
    created = (kind == "create") & F.col("valid")
    agg = e.groupBy("order_id").agg(
        F.max_by("status_after", F.when(F.col("status_after").isNotNull(), F.col("seq"))).alias("status"),
        F.max_by("payment", F.when(paid, F.col("seq"))).alias("payment_method"),
        F.max_by("ts", F.when(closing, F.col("seq"))).alias("closed_at"),
        F.min(F.when(created, F.col("ts"))).alias("created_at"),
        F.max_by("restaurant_id", F.when(created, F.col("seq"))).alias("restaurant_id"),
        F.sum(F.when(F.col("is_line"), list_total(F.col("items")))).cast(MONEY).alias("subtotal"),
        F.coalesce(F.sum(F.when(F.col("is_line"), F.size("items").cast("long"))), F.lit(0)).alias("n_lines"),
        F.max_by("kind", F.when(F.col("is_line"), F.col("seq"))).alias("last_edit"),
        F.max("base_seq").alias("base_seq"),
        F.count(F.when((kind == "add") & F.col("valid"), 1)).alias("n_adds"),
        F.count(F.when((kind == "replace") & F.col("valid"), 1)).alias("n_replaces"),
        F.count(F.when(kind.isin("add", "replace") & ~F.col("valid"), 1)).alias("n_rejected"),
        F.max("seq").alias("last_seq"),
    )
    # only the edit coalesces the sum of no lines to 0
    agg = agg.withColumn("subtotal", F.when(F.col("last_edit") == "replace",
                                            F.coalesce("subtotal", F.lit(0).cast(MONEY))).otherwise(F.col("subtotal")))
    if restaurants is None:
        rate = F.lit(Decimal(DEFAULT_TAX_RATE if tax_rate is None else tax_rate)).cast(RATE)
    else:
        agg = agg.join(restaurants.select("restaurant_id", F.col("tax_rate").cast(RATE).alias("__rate")),
                       "restaurant_id", "left")
        rate = F.col("__rate")
    agg = agg.withColumn("tax", tax_on(F.col("subtotal"), rate))
    agg = agg.withColumn("total", (F.col("subtotal") + F.col("tax")).cast(MONEY))
    # an order without a valid create event does not exist
    return agg.where(F.col("created_at").isNotNull()).drop("last_edit", "__rate")


def order_state(events: DataFrame, tax_rate=None, chunk_size: int = DEFAULT_CHUNK,
                restaurants: DataFrame | None = None) -> DataFrame:
    return fold_orders(events, tax_rate, chunk_size, restaurants).select(
        "order_id", "status", "payment_method", "created_at", "closed_at", "subtotal", "tax", "total",
        "n_lines", "last_seq")


def order_status_fold(events: DataFrame) -> DataFrame:
    return fold_orders(events).select("order_id", "status", "payment_method", "closed_at")


def void_fold(events: DataFrame, tax_rate=None, restaurants: DataFrame | None = None) -> DataFrame:
    """Voided orders keep their row and totals; closed_at is the void time."""
    return (fold_orders(events, tax_rate, restaurants=restaurants).where(F.col("status") == "void")
            .select("order_id", "closed_at", "subtotal", "total", "n_lines"))


def addon_fold(events: DataFrame, tax_rate=None, restaurants: DataFrame | None = None) -> DataFrame:
    return (fold_orders(events, tax_rate, restaurants=restaurants).where(F.col("n_adds") > 0)
            .select("order_id", "n_adds", "status", "n_lines", "subtotal", "tax", "total"))


def replace_items_fold(events: DataFrame, tax_rate=None, restaurants: DataFrame | None = None) -> DataFrame:
    return (fold_orders(events, tax_rate, restaurants=restaurants).where(F.col("n_replaces") > 0)
            .select("order_id", "n_replaces", "base_seq", "n_lines", "subtotal", "tax", "total"))


def rejected_order_events(events: DataFrame, chunk_size: int = DEFAULT_CHUNK) -> DataFrame:
    """Create / add / replace events that changed nothing, with the reason.

    The order's status is tested first (an inactive or missing order), then
    the lines' not-null columns.
    """
    e = annotate_events(events, chunk_size)
    kind = F.col("kind")
    closed = kind.isin("add", "replace") & ~F.coalesce(F.col("prior").isin(*ACTIVE_STATUSES), F.lit(False))
    null_column = F.concat(F.lit('null value in column "'), F.col("fault"),
                           F.lit('" violates not-null constraint'))
    return (e.where(kind.isin(*LISTED) & ~F.col("valid"))
            .select("order_id", "seq", "kind", F.col("prior").alias("status_before"),
                    F.when(closed & (kind == "add"), F.lit(ADD_REJECTED))
                    .when(closed, F.lit(EDIT_REJECTED)).otherwise(null_column).alias("reason")))


def current_lines(events: DataFrame, chunk_size: int = DEFAULT_CHUNK) -> DataFrame:
    """The order_items rows an event log leads to (one per current line).

    ``line_seq`` is the event that brought the line, ``line_idx`` its place
    in that event's list.  The valid list events are kept by the same scan
    as the fold and exploded in place, without another shuffle.
    """
    e = annotate_events(events, chunk_size).where(F.col("is_line"))
    return (e.select("order_id", F.col("seq").alias("line_seq"), F.posexplode("items").alias("line_idx", "l"))
            .select("order_id", "line_seq", "line_idx", F.col("l.menu_item_id").alias("menu_item_id"),
                    F.col("l.name").alias("name"), F.col("l.price").alias("price"), F.col("l.qty").alias("qty")))


def current_items(events: DataFrame, chunk_size: int = DEFAULT_CHUNK) -> DataFrame:
    """order_id -> the current lines as one list, in the order they were ordered."""
    e = annotate_events(events, chunk_size).where(F.col("is_line"))
    lists = e.groupBy("order_id").agg(F.sort_array(F.collect_list(F.struct("seq", "items"))).alias("lists"))
    return lists.select("order_id", F.flatten(F.transform("lists", lambda x: x["items"])).alias("items"))


def availability_state(menu_items: DataFrame, avail_events: DataFrame) -> DataFrame:
    """Current is_available per menu item: the latest toggle, else the menu's flag."""
    latest = (avail_events.groupBy("menu_item_id")
              .agg(F.max_by("is_available", "seq").alias("toggled"),
                   F.max("seq").alias("toggle_seq")))
    return (menu_items.join(latest, "menu_item_id", "left")
            .select("menu_item_id", "restaurant_id", "name",
                    F.coalesce("toggled", "is_available").alias("is_available"),
                    F.col("toggled").isNotNull().alias("toggled")))


def settings_state(restaurants: DataFrame, setting_events: DataFrame) -> DataFrame:
    """Latest WhatsApp number per tenant; blank becomes NULL (and NULL is a value)."""
    from tavolo.functions.text import blank_to_null
    latest = (setting_events
              .withColumn("v", F.struct(blank_to_null(F.col("whatsapp_number")).alias("n")))
              .groupBy("restaurant_id").agg(F.max_by("v", "seq").alias("v")))
    return (restaurants.join(latest, "restaurant_id", "left")
            .select("restaurant_id",
                    F.when(F.col("v").isNotNull(), F.col("v.n")).otherwise(F.col("whatsapp_number"))
                    .alias("whatsapp_number")))
