"""Order request ingest: JSON payload -> typed lines, totals, customers.

A request row is ``order_id, restaurant_id, table_id, source, staff_id,
phone, opt_in, created_at, items`` where ``items`` is the JSON text ``[{menu_item_id, name, price,
qty}]``.  Fields are read as text and cast with ``try_cast`` (like
``->>`` then ``::type``); a failed cast rejects the *whole request* into
a quarantine output instead of failing the job.

Totals are array aggregates on the request row itself, so they need no
shuffle; only the foreign-key checks join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tavolo.functions.money import MONEY, tax_on
from tavolo.functions.text import is_blank

RAW_ITEM = StructType([StructField(n, StringType()) for n in ("menu_item_id", "name", "price", "qty")])
RAW_ITEMS = ArrayType(RAW_ITEM)
WIDE = "decimal(38,18)"   # what a price is read as before it must fit the money type


def _typed(x):
    return F.struct(
        x["menu_item_id"].try_cast("bigint").alias("menu_item_id"),
        x["name"].alias("name"),
        x["price"].try_cast(WIDE).cast(MONEY).alias("price"),
        x["qty"].try_cast("int").alias("qty"),
        x.alias("raw"),
    )


def _line_error(x):
    """Reason a typed line is unusable, or NULL."""
    raw = x["raw"]
    return (F.when(raw["menu_item_id"].isNotNull() & x["menu_item_id"].isNull(), F.lit("bad menu_item_id"))
            .when(raw["price"].isNotNull() & x["price"].isNull(), F.lit("bad price"))
            # the column keeps four decimals; a finer price is not rounded without a word
            .when(raw["price"].try_cast(WIDE) != x["price"], F.lit("price does not fit"))
            .when(raw["qty"].isNotNull() & x["qty"].isNull(), F.lit("bad qty"))
            .when(x["name"].isNull(), F.lit("missing name"))
            .when(x["price"].isNull(), F.lit("missing price"))
            .when(x["qty"].isNull(), F.lit("missing qty")))


def parse_request_lines(requests: DataFrame, restaurants: DataFrame, menu_items: DataFrame,
                        tables: DataFrame | None = None, staff: DataFrame | None = None) -> DataFrame:
    """One row per (request, item) with the request's verdict.

    Columns: the request header, ``line_idx`` / typed item fields (NULL
    for a request with an empty list, which is kept as one row), and
    ``reason`` -- NULL when the whole request is accepted.

    Row-local checks (JSON shape, casts, not-null fields) are array
    expressions on the request row; the tenant, table, staff and menu-item
    checks are left joins against the dimensions (a null table or staff id
    is allowed; without ``tables`` or ``staff`` that key is not checked).  The per-request verdict is a
    window over ``order_id``: when the input is already partitioned by
    order (as a log keyed by order is) this adds a sort but no shuffle,
    and the request subtree is evaluated once.
    """
    parsed = requests.withColumn("raw_items", F.from_json(F.col("items"), RAW_ITEMS))
    parsed = parsed.withColumn("typed", F.transform("raw_items", lambda x: _typed(x)))
    errs = F.filter(F.transform("typed", _line_error), lambda e: e.isNotNull())
    reason = (F.when(F.col("raw_items").isNull() | F.json_array_length("items").isNull(),
                     F.lit("items is not a JSON array"))
              .when(F.size(errs) > 0, F.element_at(errs, 1)))
    for parent, key, what in ((restaurants, "restaurant_id", "restaurant"), (tables, "table_id", "table"),
                              (staff, "staff_id", "staff")):
        if parent is None:
            continue
        parsed = parsed.join(parent.select(key, F.lit(True).alias(f"{what}_ok")), key, "left")
        # every order has a tenant; the other two may be absent
        given = F.lit(True) if what == "restaurant" else F.col(key).isNotNull()
        reason = reason.when(given & F.col(f"{what}_ok").isNull(), F.lit(f"unknown {what}"))
    parsed = parsed.withColumn("row_reason", reason)
    heads = [c for c in requests.columns if c != "items"]
    lines = parsed.select(*heads, "row_reason",
                          F.posexplode_outer(F.coalesce("typed", F.array().cast(parsed.schema["typed"].dataType)))
                          .alias("line_idx", "l"))
    lines = lines.select(*heads, "row_reason", "line_idx",
                         F.col("l.menu_item_id").alias("menu_item_id"), F.col("l.name").alias("name"),
                         F.col("l.price").alias("price"), F.col("l.qty").alias("qty"))
    known_item = menu_items.select("menu_item_id", F.lit(True).alias("item_ok"))
    lines = lines.join(known_item, "menu_item_id", "left")
    unknown = F.max((F.col("menu_item_id").isNotNull() & F.col("item_ok").isNull()).cast("int")) \
        .over(Window.partitionBy("order_id"))
    reason = F.coalesce(F.col("row_reason"), F.when(unknown == 1, F.lit("unknown menu item")))
    return lines.withColumn("reason", reason).drop("row_reason", "item_ok")


def parse_order_requests(requests, restaurants, menu_items, tables=None, staff=None) -> DataFrame:
    """Typed lines of the accepted requests (one row per item)."""
    lines = parse_request_lines(requests, restaurants, menu_items, tables, staff)
    return (lines.where(F.col("reason").isNull() & F.col("line_idx").isNotNull())
            .select("order_id", "restaurant_id", "line_idx", "menu_item_id", "name", "price", "qty"))


def rejected_requests(requests, restaurants, menu_items, tables=None, staff=None) -> DataFrame:
    """Quarantine: one row per rejected request with the first reason found."""
    lines = parse_request_lines(requests, restaurants, menu_items, tables, staff)
    return (lines.where(F.col("reason").isNotNull())
            .groupBy("order_id", "restaurant_id").agg(F.min("reason").alias("reason")))


def order_items_snapshot(lines: DataFrame) -> DataFrame:
    """order_items rows: name and price frozen as sent with the order."""
    return lines.select("order_id", "line_idx", "menu_item_id",
                        F.col("name").alias("name_snapshot"), F.col("price").alias("price_snapshot"),
                        "qty", (F.col("price") * F.col("qty")).cast(MONEY).alias("line_total"))


def order_totals(request_lines: DataFrame, restaurants: DataFrame) -> DataFrame:
    """subtotal = sum(price * qty) of an accepted request (NULL for an empty list),
    tax = round(subtotal * rate) in whole units, total = subtotal + tax.

    Grouping by order reuses the order partitioning of the parsed lines.
    """
    ok = request_lines.where(F.col("reason").isNull())
    sub = (ok.groupBy("order_id", "restaurant_id")
           .agg(F.sum(F.col("price") * F.col("qty")).cast(MONEY).alias("subtotal")))
    rates = restaurants.select("restaurant_id", "tax_rate")
    return (sub.join(rates, "restaurant_id", "left")
            .withColumn("tax", tax_on(F.col("subtotal"), F.col("tax_rate")))
            .withColumn("total", (F.col("subtotal") + F.col("tax")).cast(MONEY))
            .select("order_id", "restaurant_id", "subtotal", "tax", "total"))


def order_headers(request_lines: DataFrame, restaurants: DataFrame) -> DataFrame:
    """The orders row that each accepted request inserts.

    Status is 'open' and the type its column default; the customer is the
    one minted for (tenant, phone), NULL for a blank phone.  Header and
    totals come from the parsed lines alone: the group by order reuses
    their partitioning, and the customer id needs no join.
    """
    heads = ("restaurant_id", "table_id", "source", "staff_id", "phone", "created_at")
    ok = request_lines.where(F.col("reason").isNull())
    one = ok.groupBy("order_id").agg(*[F.first(c).alias(c) for c in heads],
                                     F.sum(F.col("price") * F.col("qty")).cast(MONEY).alias("subtotal"),
                                     F.count("line_idx").alias("n_lines"))
    customer = F.when(~is_blank(F.col("phone")), customer_key(F.col("restaurant_id"), F.col("phone")))
    return (one.join(restaurants.select("restaurant_id", "tax_rate"), "restaurant_id", "left")
            .withColumn("tax", tax_on(F.col("subtotal"), F.col("tax_rate")))
            .select("order_id", "restaurant_id", "table_id", F.lit("dine-in").alias("order_type"), "source",
                    F.lit("open").alias("status"), customer.alias("customer_id"), "subtotal", "tax",
                    (F.col("subtotal") + F.col("tax")).cast(MONEY).alias("total"), "staff_id", "created_at", "n_lines"))


def customer_key(restaurant_id, phone):
    """Deterministic customer id from the natural key (stable on recompute)."""
    return F.sha2(F.concat_ws("|", restaurant_id.cast("string"), phone), 256)


def customer_upsert(requests: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One customer per (tenant, phone): first id / created_at, latest opt-in.

    Requests apply in (created_at, order_id) order.  A stored snapshot is
    merged by union + re-aggregation (its rows count as the earliest).
    Partial aggregation runs map-side, so a hot phone never gathers in
    one place.
    """
    req = (requests.where(~is_blank(F.col("phone")))
           .select("restaurant_id", "phone", F.col("opt_in").alias("marketing_opt_in"),
                   "created_at", F.lit(None).cast("string").alias("customer_id"), F.lit(1).cast("long").alias("n"),
                   F.struct(F.lit(1).alias("src"), F.col("created_at"), F.col("order_id")).alias("ord")))
    if existing is not None:
        # a stored row stands for the requests it has counted so far, and is none itself
        counted = F.col("n_requests") if "n_requests" in existing.columns else F.lit(0)
        old = existing.select("restaurant_id", "phone", "marketing_opt_in", "created_at", "customer_id",
                              counted.cast("long").alias("n"),
                              F.struct(F.lit(0).alias("src"), F.col("created_at"),
                                       F.lit(None).cast("bigint").alias("order_id")).alias("ord"))
        req = old.unionByName(req)
    g = req.groupBy("restaurant_id", "phone").agg(
        F.min_by("customer_id", "ord").alias("kept_id"),
        F.min("created_at").alias("created_at"),
        F.max_by("marketing_opt_in", "ord").alias("marketing_opt_in"),
        F.sum("n").alias("n_requests"))
    return g.select(F.coalesce("kept_id", customer_key(F.col("restaurant_id"), F.col("phone")))
                    .alias("customer_id"),
                    "restaurant_id", "phone", "created_at", "marketing_opt_in", "n_requests")


def order_customer_link(requests: DataFrame, customers: DataFrame | None = None) -> DataFrame:
    """order -> customer id; NULL when the phone is blank.

    Ids minted here are the key hash, so without a stored snapshot of
    externally assigned ids no join is needed; with one, a left join on
    (tenant, phone) picks the stored id.
    """
    r = requests.select("order_id", "restaurant_id", "phone")
    blank = is_blank(F.col("phone"))
    if customers is None:
        return r.select("order_id", F.when(~blank, customer_key(F.col("restaurant_id"), F.col("phone")))
                        .alias("customer_id"))
    c = customers.select("restaurant_id", "phone", "customer_id")
    return (r.join(c, ["restaurant_id", "phone"], "left")
            .select("order_id", F.when(~blank, F.col("customer_id")).alias("customer_id")))


def customer_phones(requests: DataFrame) -> DataFrame:
    """customer_id -> phone for the ids minted by ``customer_key``."""
    return (requests.where(~is_blank(F.col("phone")))
            .select(customer_key(F.col("restaurant_id"), F.col("phone")).alias("customer_id"), "phone")
            .distinct())


def derive_order_type(orders: DataFrame) -> DataFrame:
    ot = F.coalesce(F.col("given_order_type"),
                    F.when(F.col("table_id").isNull(), F.lit("takeaway")).otherwise(F.lit("dine-in")))
    return orders.select("order_id", "table_id", ot.alias("order_type"))


def backfill_order_type(orders: DataFrame) -> DataFrame:
    """Stored type defaults to 'dine-in'; table-less dine-in becomes takeaway."""
    stored = F.coalesce(F.col("given_order_type"), F.lit("dine-in"))
    fixed = F.when(F.col("table_id").isNull() & (stored == "dine-in"), F.lit("takeaway")).otherwise(stored)
    return orders.select("order_id", "table_id", stored.alias("order_type_before"), fixed.alias("order_type"))


