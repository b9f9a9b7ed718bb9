"""Receipt text and WhatsApp links, built with JVM string functions.

Amounts follow the page: ``Math.round`` (half toward +infinity) and a
plain integer, no grouping.  The link text is ``encodeURIComponent``
encoded (see ``tavolo.functions.text.encode_uri_component``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tavolo.functions.money import js_round
from tavolo.functions.text import digits_only, encode_uri_component
from tavolo.operators.common import order_lines

THANK_YOU = "Thank you for dining with us!"
WA_BASE = "https://wa.me/"


def _amount(c):
    return js_round(c).cast("bigint").cast("string")


def _receipt(lines, name, currency, total, thank_you: bool, null_as_zero: bool):
    def line(x):
        price, qty = x["price_snapshot"], x["qty"]
        if null_as_zero:
            price, qty = F.coalesce(price, F.lit(0)), F.coalesce(qty, F.lit(0))
        return F.concat(qty.cast("string"), F.lit("x "), x["name_snapshot"], F.lit(" - "),
                        currency, F.lit(" "), _amount(price * qty))
    parts = [F.concat(F.lit("Order receipt - "), name), F.lit("")]
    # NULL (skipped by concat_ws) when there are no lines, as an empty JS spread
    body = F.when(F.size(F.coalesce(lines, F.array())) > 0, F.array_join(F.transform(lines, line), "\n"))
    tail = [F.lit(""), F.concat(F.lit("Total: "), currency, F.lit(" "), _amount(F.coalesce(total, F.lit(0))))]
    if thank_you:
        tail += [F.lit(""), F.lit(THANK_YOU)]
    return F.concat_ws("\n", *parts, body, *tail)


def _orders_with_lines(orders, order_items, restaurants):
    lines = order_lines(order_items, "menu_item_id", "name_snapshot", "price_snapshot", "qty")
    r = restaurants.select("restaurant_id", F.col("name").alias("r_name"), "currency", "whatsapp_number")
    return orders.join(r, "restaurant_id", "left").join(lines, "order_id", "left")


def receipt_text(orders, order_items, restaurants) -> DataFrame:
    j = _orders_with_lines(orders, order_items, restaurants)
    return j.select("order_id", _receipt(F.col("items"), F.col("r_name"), F.col("currency"),
                                         F.col("total"), False, False).alias("receipt"))


def receipt_link_restaurant(orders, order_items, restaurants) -> DataFrame:
    """wa.me link to the tenant's number, NULL when the tenant has none."""
    j = _orders_with_lines(orders, order_items, restaurants)
    text = _receipt(F.col("items"), F.col("r_name"), F.col("currency"), F.col("total"), False, False)
    link = F.when(F.col("whatsapp_number").isNotNull() & (F.col("whatsapp_number") != ""),
                  F.concat(F.lit(WA_BASE), digits_only(F.col("whatsapp_number")), F.lit("?text="),
                           encode_uri_component(text)))
    return j.select("order_id", link.alias("link"))


def receipt_link_customer(orders, order_items, restaurants, customers) -> DataFrame:
    """Link to the customer's phone with a thank-you line; missing price/qty count as 0."""
    j = _orders_with_lines(orders, order_items, restaurants)
    c = customers.select("customer_id", F.col("phone").alias("customer_phone"))
    j = j.join(c, "customer_id", "left")
    text = _receipt(F.col("items"), F.col("r_name"), F.col("currency"), F.col("total"), True, True)
    link = F.when(F.col("customer_phone").isNotNull() & (F.col("customer_phone") != ""),
                  F.concat(F.lit(WA_BASE), digits_only(F.col("customer_phone")), F.lit("?text="),
                           encode_uri_component(text)))
    return j.select("order_id", link.alias("link"))
