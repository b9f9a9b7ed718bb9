"""Carts: a click log folded into cart lines.

Events: cart_id, item_id, seq, delta (+1 add, -1 decrement, 0 remove).
The page keeps ``qty = max(0, qty + delta)`` (a decrement on an absent
line is ignored, a line at 0 disappears) and a remove clears the line.
That floored walk has a closed form: over the events after the last
remove, with S the running sum of deltas (S0 = 0),
``qty = S - min(0, min S)`` -- so running aggregates replace a sequential
fold and no per-cart list is ever gathered.  The running aggregates are
chunked (``tavolo.plans.scan``), so a hot cart line is split over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tavolo.functions.money import MONEY
from tavolo.plans.scan import DEFAULT_CHUNK, Prefix, prefix_by_key


def cart_line_states(cart_events: DataFrame, chunk_size: int = DEFAULT_CHUNK) -> DataFrame:
    """Per event: the line's quantity right after it (for the events after the
    line's last remove; earlier events get 0 -- they no longer matter).

    With S the running sum of all deltas (a remove adds 0), the quantity
    after a live event is ``S - min(S over the rows from the last remove
    on)``, or ``S - min(0, min S)`` when the line was never removed.  Two
    chunked stages, one shuffle: (S, removes before, removes after), then
    the running minimum.
    """
    rem = (F.col("delta") == 0).cast("long")
    tail = (F.col("removes_after") == 0) | ((F.col("delta") == 0) & (F.col("removes_after") == 1))
    e = prefix_by_key(cart_events, ["cart_id", "item_id"], "seq", [
        [Prefix("s", "sum", F.col("delta").cast("long")),
         Prefix("removes_before", "sum", rem),
         Prefix("removes_after", "sum", rem, reverse=True)],
        [Prefix("m", "min", F.when(tail, F.col("s")))],
    ], chunk_size)
    live = F.col("removes_after") == 0
    floor = F.least(F.col("m"), F.when(F.col("removes_before") == 0, F.lit(0)))
    return e.withColumn("live", live).withColumn(
        "q", F.when(live, F.col("s") - floor).otherwise(F.lit(0)))


def cart_fold(cart_events: DataFrame, menu_items: DataFrame, chunk_size: int = DEFAULT_CHUNK) -> DataFrame:
    """Current cart lines (qty > 0) with the item's name and price.

    ``line_since`` is the event that (re)created the line, which is the
    line's position in the cart.
    """
    st = cart_line_states(cart_events, chunk_size)
    g = st.groupBy("cart_id", "item_id").agg(
        F.max_by("q", "seq").alias("qty"),
        F.max(F.when((F.col("q") == 1) & (F.col("delta") == 1), F.col("seq"))).alias("line_since"))
    m = menu_items.select(F.col("menu_item_id").alias("item_id"), "name", "price")
    return (g.where(F.col("qty") > 0).join(m, "item_id", "left")
            .select("cart_id", "item_id", F.col("qty").cast("bigint").alias("qty"), "line_since", "name", "price"))


def cart_summary(cart_lines: DataFrame) -> DataFrame:
    """Item count and value per non-empty cart."""
    return cart_lines.groupBy("cart_id").agg(
        F.sum("qty").cast("bigint").alias("item_count"),
        F.sum(F.col("price") * F.col("qty")).cast(MONEY).alias("cart_value"))


def cart_availability_prune(cart_lines: DataFrame, availability: DataFrame) -> DataFrame:
    """Per cart: lines kept, and the names of sold-out lines removed (cart order)."""
    av = availability.select(F.col("menu_item_id").alias("item_id"), "is_available")
    j = cart_lines.join(av, "item_id", "left")
    gone = F.coalesce(~F.col("is_available"), F.lit(True))
    return j.groupBy("cart_id").agg(
        F.count(F.when(~gone, 1)).alias("kept_lines"),
        F.count(F.when(gone, 1)).alias("removed_lines"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(gone, F.struct("line_since", "name")))),
                                 lambda x: x["name"]), ", ").alias("removed_names"))
