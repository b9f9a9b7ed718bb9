"""Money and rounding expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MONEY = "decimal(18,4)"   # amounts
RATE = "decimal(9,6)"     # tax rates
DEFAULT_TAX_RATE = "0.05"  # column default of restaurants.tax_rate


def money(c) -> Column:
    return F.col(c).cast(MONEY) if isinstance(c, str) else c.cast(MONEY)


def tax_on(subtotal: Column, rate: Column) -> Column:
    """round(subtotal * rate) to whole units, half away from zero.

    The subtotal is cast back to (18,4) first: a (38,4) sum times a (9,6)
    rate would lose digits, (18,4) x (9,6) stays exact.
    """
    return F.round(subtotal.cast(MONEY) * rate, 0).cast(MONEY)


def line_amount(price: Column, qty: Column) -> Column:
    return price.cast(MONEY) * qty


def sum_money(c: Column) -> Column:
    return F.sum(c).cast(MONEY)


def js_round(c: Column) -> Column:
    """Browser ``Math.round``: half toward +infinity."""
    return F.floor(c + F.lit(0.5))


def as_report(c: Column) -> Column:
    """Money handed to reports / comparisons as double."""
    return c.cast("double")
