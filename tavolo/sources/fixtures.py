"""The shop data model derived from the driver tables.

Each ``s_*`` frame re-expresses one fixture view (see FIXTURES.md) with
the DataFrame API.  They are plain projections / joins / filters of the
driver tables, so every operator built on them scales with the input.
"""

from __future__ import annotations

from decimal import Decimal
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from tavolo.functions.money import MONEY, RATE


# Planted violations for the constraint audit: column -> expression, the same text in Spark and in the oracle.
DIRTY = {
    "restaurants": {"slug": "case when restaurant_id % 6 = 1 then 'dup' when restaurant_id % 6 = 2 then null else slug end",
                    "name": "case when restaurant_id % 11 = 3 then null else name end"},
    "tables": {"qr_token": "case when table_id % 13 = 1 then 'dup' when table_id % 13 = 2 then null else qr_token end",
               "label": "case when table_id % 17 = 3 then null else label end"},
    "categories": {"name": "case when restaurant_id % 9 = 4 then null else name end"},
    "menu_items": {"name": "case when menu_item_id % 19 = 5 then null else name end",
                   "price": "case when menu_item_id % 23 = 6 then null else price end"},
    "staff": {"name": "case when staff_id % 4 = 1 then null else name end"},
    "customers": {"phone": "case when customer_id % 7 = 1 then '5550' when customer_id % 7 = 2 then null else phone end"},
    "order_items": {"name_snapshot": "case when order_id % 29 = 1 then null else name_snapshot end",
                    "price_snapshot": "case when order_id % 31 = 2 then null else price_snapshot end",
                    "qty": "case when order_id % 37 = 3 then null else qty end"},
    "feedback": {"order_id": "case when order_id % 8 = 1 then null when order_id % 8 = 2 then 2 else order_id end",
                 "rating": "case when order_id % 5 = 1 then 0 when order_id % 5 = 2 then null when order_id % 5 = 3 then 6 else rating end"},
}


def _mod(c: str, n: int):
    return F.col(c) % F.lit(n)


class Shop:
    def __init__(self, tables):
        self.t = tables

    # ---- dimensions -------------------------------------------------
    @cached_property
    def restaurants(self) -> DataFrame:
        n = self.t.nation
        return n.select(
            F.col("n_nationkey").alias("restaurant_id"),
            F.col("n_name").alias("name"),
            F.lower("n_name").alias("slug"),
            F.lit("PKR").alias("currency"),
            F.when(_mod("n_nationkey", 4) == 1, F.lit(Decimal("0.16")).cast(RATE))
             .when(_mod("n_nationkey", 4) == 2, F.lit(Decimal("0")).cast(RATE))
             .when(_mod("n_nationkey", 4) == 3, F.lit(Decimal("0.0825")).cast(RATE))
             .otherwise(F.lit(Decimal("0.05")).cast(RATE)).alias("tax_rate"),
            F.when(_mod("n_nationkey", 3) == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("+92 300-"),
                                 (F.lit(1000000) + F.col("n_nationkey")).cast("string")))
             .alias("whatsapp_number"),
        )

    @cached_property
    def tables(self) -> DataFrame:
        # 8 tables per tenant: a generator per row, not a cross join.
        n = self.t.nation.select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
        return n.select(
            (F.col("n_nationkey") * 8 + F.col("k")).alias("table_id"),
            F.col("n_nationkey").alias("restaurant_id"),
            F.concat(F.lit("Table "), (F.col("k") + 1).cast("string")).alias("label"),
            F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit("-t"),
                     (F.col("k") + 1).cast("string")).alias("qr_token"),
        )

    @staticmethod
    def _category_id(tenant):
        # half of the names stand for two categories of one tenant
        twin = F.when(F.length("p_type") % 2 == 0, _mod("p_size", 2)).otherwise(F.lit(0))
        return F.concat(tenant.cast("string"), F.lit("-"), F.col("p_type"), F.lit("-"), twin.cast("string"))

    @cached_property
    def categories(self) -> DataFrame:
        return self.t.part.select(
            self._category_id(_mod("p_partkey", 25)).alias("category_id"),
            _mod("p_partkey", 25).alias("restaurant_id"),
            F.col("p_type").alias("name"),
            F.length("p_type").alias("sort_order"),
        ).distinct()

    @cached_property
    def menu_items(self) -> DataFrame:
        return self.t.part.select(
            F.col("p_partkey").alias("menu_item_id"),
            _mod("p_partkey", 25).alias("restaurant_id"),
            # some items have no category, some another tenant's
            F.when(F.col("p_size") == 50, F.lit(None).cast("string"))
             .when(F.col("p_size") == 49, self._category_id((F.col("p_partkey") + 1) % 25))
             .otherwise(self._category_id(_mod("p_partkey", 25))).alias("category_id"),
            F.col("p_name").alias("name"),
            F.col("p_retailprice").cast(MONEY).alias("price"),
            (_mod("p_size", 5) != 0).alias("is_available"),
            F.col("p_size").alias("sort_order"),
        )

    @cached_property
    def staff(self) -> DataFrame:
        roles = F.when(_mod("s_suppkey", 7) == 0, "owner").when(_mod("s_suppkey", 7) == 1, "manager") \
            .when(_mod("s_suppkey", 7) == 2, "cashier").when(_mod("s_suppkey", 7) == 3, "waiter") \
            .when(_mod("s_suppkey", 7) == 4, "headwaiter").when(_mod("s_suppkey", 7) == 5, "kitchen") \
            .otherwise("chef")
        return self.t.supplier.select(
            F.col("s_suppkey").alias("staff_id"),
            F.col("s_nationkey").alias("restaurant_id"),
            F.col("s_name").alias("name"),
            roles.alias("role"),
            (F.lit("2020-01-01").cast("timestamp_ntz")
             + F.make_dt_interval((F.col("s_suppkey") * 7919 % 37).cast("int"))).alias("created_at"),
        )

    @cached_property
    def customers(self) -> DataFrame:
        c = self.t.customer
        return c.select(F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("restaurant_id"),
                        (F.lit(5550000) + F.col("c_custkey")).cast("string").alias("phone"))

    # ---- facts --------------------------------------------------------
    @cached_property
    def orders(self) -> DataFrame:
        o = self.t.orders
        c = self.t.customer.select("c_custkey", "c_nationkey")
        j = o.join(c, o.o_custkey == c.c_custkey)
        k = F.col("o_orderkey")
        tax = F.floor(F.col("o_totalprice") / 20).cast(MONEY)
        return j.select(
            k.alias("order_id"),
            F.col("c_nationkey").alias("restaurant_id"),
            F.when(k % 9 == 0, F.lit(None).cast("bigint"))
             .otherwise(F.col("c_nationkey") * 8 + k % 8).alias("table_id"),
            F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "qr")
             .when(F.col("o_orderpriority") == "3-MEDIUM", "whatsapp").otherwise("pos").alias("source"),
            F.when(k % 50 == 0, "void").when(F.col("o_orderstatus") == "F", "closed")
             .when(F.col("o_orderstatus") == "O", "open").when(k % 2 == 0, "ready")
             .otherwise("preparing").alias("status"),
            F.when(k % 101 == 0, F.lit(None).cast(MONEY))
             .otherwise(F.col("o_totalprice").cast(MONEY)).alias("total"),
            F.when(k % 101 != 0, F.col("o_totalprice").cast(MONEY) - tax).cast(MONEY).alias("subtotal"),
            F.when(k % 101 != 0, tax).alias("tax"),
            F.col("o_custkey").alias("customer_id"),
            (k % 10).alias("staff_id"),
            F.when(k % 13 == 0, "delivery").alias("given_order_type"),
            F.col("o_orderdate").alias("created_at"),
        )

    @cached_property
    def order_items(self) -> DataFrame:
        li = self.t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
        p = self.t.part.select("p_partkey", "p_name", "p_retailprice")
        j = li.join(p, li.l_partkey == p.p_partkey)
        return j.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line_no"),
            F.col("l_partkey").alias("menu_item_id"),
            F.col("p_name").alias("name_snapshot"),
            F.col("p_retailprice").cast(MONEY).alias("price_snapshot"),
            F.col("l_quantity").cast("int").alias("qty"),
        )

    @cached_property
    def order_events(self) -> DataFrame:
        e = self.t.events
        eid, et = F.col("event_id"), F.col("event_type")
        first = eid % 10 == 0
        kind = (F.when(first, "create").when(et.isin("signup", "purchase"), "status")
                .when(et == "view", "add").when(et == "click", "replace").otherwise("void"))
        # 0 to 3 lines an event; a few lines miss their name or price
        n = F.when(kind.isin("create", "add", "replace"),
                   ((eid * 7 + F.floor(eid / 10)) % 4).cast("int")).otherwise(F.lit(0))

        def line(k):
            dish = (eid * 3 + k * 11) % 400
            return F.struct(
                dish.cast("bigint").alias("menu_item_id"),
                F.when(~((eid % 67 == 7) & (k == 1)), F.concat(F.lit("Dish "), (dish % 64).cast("string"))).alias("name"),
                F.when(~((eid % 61 == 5) & (k == 0)), (F.col("value").cast(MONEY) + k).cast(MONEY)).alias("price"),
                (F.lit(1) + (eid + k) % 5).cast("int").alias("qty"))
        lines = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), line)
        return e.select(
            F.floor(eid / 10).cast("bigint").alias("order_id"),
            (eid % 10).cast("int").alias("seq"),
            kind.alias("kind"),
            F.when(first, (F.floor(eid / 10) % 25).cast("int")).alias("restaurant_id"),
            F.when(first, F.lit(None).cast("string")).when(et == "signup", "preparing")
             .when(et == "purchase", "closed").alias("status_arg"),
            F.when(~first & (et == "purchase") & (eid % 3 != 0),
                   F.when(eid % 3 == 1, "cash").otherwise("card")).alias("payment"),
            F.slice(lines, F.lit(1), n).alias("items"),
            F.col("ts"),
        )

    @cached_property
    def calls(self) -> DataFrame:
        e = self.t.events.where(F.col("event_type").isin("view", "click", "error"))
        ack = F.col("event_id") % 8 != 0
        return e.select(
            F.col("event_id").alias("call_id"),
            (F.col("user_id") % 25).cast("int").alias("restaurant_id"),
            ((F.col("user_id") % 25) * 8 + F.col("user_id") % 8).alias("table_id"),
            F.col("ts").alias("created_at"),
            ack.alias("acknowledged"),
            F.when(ack, F.col("user_id") % 10).alias("acknowledged_by"),
        )

    @cached_property
    def ring_log(self) -> DataFrame:
        e = self.t.events.where(F.col("event_type").isin("view", "click", "purchase"))
        return e.select(
            F.col("event_id").alias("seq"),
            ((F.col("user_id") % 25) * 8 + F.col("user_id") % 8).alias("table_id"),
            F.when(F.col("event_type") == "purchase", "ack").otherwise("ring").alias("kind"),
            (F.col("user_id") % 10).alias("staff_id"),
            F.col("ts"),
        )

    @cached_property
    def feedback(self) -> DataFrame:
        lab = self.t.labels
        doc = self.t.documents.select("doc_id", "source")
        j = lab.join(doc, "doc_id")
        return j.select(
            F.col("doc_id").alias("order_id"),
            (F.lit(1) + F.lit(3) * F.col("quality") + (F.lit(1) - F.col("toxic"))).cast("int").alias("rating"),
            F.col("source").alias("comment"),
        )

    @cached_property
    def feedback_events(self) -> DataFrame:
        c = self.t.conversations.where(F.col("role") == "user")
        return c.select(
            (F.col("conv_id") * 200).alias("order_id"),
            F.col("turn").alias("seq"),
            (F.length("text") % 7).cast("int").alias("rating"),
            F.col("text").alias("comment"),
        )

    @cached_property
    def cart_events(self) -> DataFrame:
        e = self.t.events
        return e.select(
            F.col("user_id").alias("cart_id"),
            (F.col("event_id") % 20).alias("item_id"),
            F.col("event_id").alias("seq"),
            F.when(F.col("event_type") == "error", -1).when(F.col("event_type") == "purchase", 0)
             .otherwise(1).alias("delta"),
        )

    @cached_property
    def avail_events(self) -> DataFrame:
        return self.t.events.select(
            (F.col("event_id") % 400).alias("menu_item_id"),
            F.col("event_id").alias("seq"),
            (F.col("event_type") != "error").alias("is_available"),
        )

    @cached_property
    def setting_events(self) -> DataFrame:
        e = self.t.events.where(F.col("event_type") == "signup")
        return e.select(
            (F.col("user_id") % 25).cast("int").alias("restaurant_id"),
            F.col("event_id").alias("seq"),
            F.when(F.col("event_id") % 4 == 0, "  ")
             .otherwise(F.concat(F.lit(" 92"), F.col("event_id").cast("string"))).alias("whatsapp_number"),
        )

    @cached_property
    def scans(self) -> DataFrame:
        e = self.t.events.where(F.col("event_type") == "view")
        return e.select(
            F.col("event_id").alias("scan_id"),
            F.when(F.col("event_id") % 11 == 0, "nope")
             .otherwise(F.concat(F.lit("n"), (F.col("user_id") % 25).cast("string"), F.lit("-t"),
                                 (F.lit(1) + F.col("user_id") % 8).cast("string"))).alias("qr_token"),
            (F.col("user_id") % 25).cast("int").alias("restaurant_id"),
            F.col("ts"),
        )

    @cached_property
    def orders_with_phone(self) -> DataFrame:
        """Orders plus the phone / opt-in their create_order call carried."""
        return self.orders.withColumns({
            "phone": F.when(F.col("customer_id") % 10 == 0, "  ")
                      .otherwise((F.lit(5550000) + F.col("customer_id")).cast("string")),
            "opt_in": F.col("order_id") % 2 == 0,
        })

    @cached_property
    def request_headers(self) -> DataFrame:
        """One create_order call per order, without its items."""
        return self.orders_with_phone.select("order_id", "restaurant_id", "phone", "opt_in", "created_at")

    @cached_property
    def requests_flat(self) -> DataFrame:
        o = self.orders
        i = self.order_items
        j = o.join(i, "order_id", "left")
        return j.select(
            "order_id", "restaurant_id",
            F.when(F.col("customer_id") % 10 == 0, "  ")
             .otherwise((F.lit(5550000) + F.col("customer_id")).cast("string")).alias("phone"),
            (F.col("order_id") % 2 == 0).alias("opt_in"),
            "created_at", "line_no", "menu_item_id", "name_snapshot", "price_snapshot", "qty",
        )

    @cached_property
    def requests(self) -> DataFrame:
        """One JSON order request per order (the create_order payload).

        Grouped by order_id alone: the header columns depend on it, so
        ``first`` picks the one value and the hash key stays a long.  Some
        requests carry a fault: ``order_id % 211`` is its number.
        """
        fault = F.col("order_id") % 211
        head = ("restaurant_id", "table_id", "source", "phone", "opt_in", "created_at")
        flat = self.orders_with_phone.select("order_id", *head).join(self.order_items, "order_id", "left")
        line = F.struct("line_no", "menu_item_id", "name_snapshot", "price_snapshot", "qty")
        lists = flat.groupBy("order_id").agg(
            *[F.first(c).alias(c) for c in head],
            F.sort_array(F.collect_list(F.when(F.col("menu_item_id").isNotNull(), line))).alias("lines"))

        def one(x, i):
            here = i == 0       # a line fault goes into the first line of the request
            return F.struct(
                F.when(here & (fault == 9), F.lit("x")).when(here & (fault == 10), F.lit("999999999"))
                 .otherwise(x["menu_item_id"].cast("string")).alias("menu_item_id"),
                F.when(~(here & (fault == 6)), x["name_snapshot"]).alias("name"),
                F.when(here & (fault == 4), F.lit("abc")).when(here & (fault == 5), F.lit("1.00001"))
                 .when(~(here & (fault == 7)), x["price_snapshot"].cast("string")).alias("price"),
                F.when(here & (fault == 3), F.lit("2.0"))
                 .when(~(here & (fault == 8)), x["qty"].cast("string")).alias("qty"))

        items = F.when(fault == 1, F.lit('{"menu_item_id": 1}')).when(fault == 2, F.lit('[{"menu_item_id":')) \
            .otherwise(F.to_json(F.transform("lines", one)))
        return lists.select(
            "order_id",
            F.when(fault == 11, F.lit(99)).otherwise(F.col("restaurant_id")).alias("restaurant_id"),
            F.when(fault == 12, F.lit(100_000).cast("long")).otherwise(F.col("table_id")).alias("table_id"),
            "source",
            F.when(fault == 13, F.lit(1_000_000).cast("long"))
             .when(F.col("order_id") % 3 != 0, F.col("order_id") % 10).alias("staff_id"),
            "phone", "opt_in", "created_at", items.alias("items"))

    def dirty(self, name: str) -> DataFrame:
        """A table with planted violations (see ``DIRTY``)."""
        df = getattr(self, name)
        return df.withColumns({c: F.expr(e) for c, e in DIRTY[name].items()})
