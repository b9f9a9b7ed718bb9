"""Size-checked broadcasts.

A side is broadcast only after its rows are counted: below the limit it
is hinted, above it the join stays a shuffle join.  The count is one job
when the plan is built; it is meant for key lists whose size has a bound
that does not grow with the facts (top-k per tenant, one row per table, a
hot-key list), where it saves shuffling the big side of the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 1_000_000  # rows of a key list that may be broadcast


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, n: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint when it has at most ``max_rows`` rows.

    ``n`` is a row count already known (so it is not counted twice).
    """
    n = df.count() if n is None else n
    return F.broadcast(df) if n <= max_rows else df
