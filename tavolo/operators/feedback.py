"""Feedback submissions: upsert per order and the rejected submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

ORDER_NOT_FOUND = "Order not found"
BAD_RATING = "Rating must be between 1 and 5"
NULL_RATING = 'null value in column "rating" violates not-null constraint'


def _checked(feedback_events: DataFrame, orders: DataFrame) -> DataFrame:
    o = orders.select("order_id", "restaurant_id")
    r = F.col("rating")
    reason = (F.when(F.col("restaurant_id").isNull(), F.lit(ORDER_NOT_FOUND))
              .when((r < 1) | (r > 5), F.lit(BAD_RATING))
              .when(r.isNull(), F.lit(NULL_RATING)))
    return feedback_events.join(o, "order_id", "left").withColumn("reason", reason)


def feedback_upsert(feedback_events: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per order: first submission kept as id, latest rating and comment.

    A NULL comment in the latest submission overwrites the earlier one,
    hence max_by over a struct.
    """
    ok = _checked(feedback_events, orders).where(F.col("reason").isNull())
    g = ok.groupBy("order_id", "restaurant_id").agg(
        F.max_by(F.struct("rating", "comment"), "seq").alias("last"),
        F.min("seq").alias("first_seq"),
        F.count(F.lit(1)).alias("n_submissions"))
    return g.select("order_id", "restaurant_id", F.col("last.rating").alias("rating"),
                    F.col("last.comment").alias("comment"), "first_seq", "n_submissions")


def rejected_feedback(feedback_events: DataFrame, orders: DataFrame) -> DataFrame:
    """Unknown order first, then the rating rule (NULL fails the column rule)."""
    return (_checked(feedback_events, orders).where(F.col("reason").isNotNull())
            .select("order_id", "seq", "rating", "reason"))
