"""String helpers mirroring the page-side formatting rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ACTIVE_STATUSES = ("open", "preparing", "ready")


def blank_to_null(c: Column) -> Column:
    """nullif(trim(x), '') -- trims spaces only, like the database."""
    return F.nullif(F.trim(c), F.lit(""))


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.length(F.trim(c)) == 0)


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def encode_uri_component(c: Column) -> Column:
    """JavaScript ``encodeURIComponent`` from Spark's form encoder.

    ``url_encode`` is form encoding: space becomes '+', and it escapes
    ! ' ( ) ~ which encodeURIComponent leaves alone.
    """
    e = F.url_encode(c)
    e = F.replace(e, F.lit("+"), F.lit("%20"))
    for enc, raw in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        e = F.replace(e, F.lit(enc), F.lit(raw))
    return e


def strip_one_trailing_slash(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "/$", "")


def is_active(status: Column) -> Column:
    return status.isin(*ACTIVE_STATUSES)
