"""Event-time arithmetic on wall-clock (TIMESTAMP_NTZ) columns.

``unix_micros(cast(ts as timestamp))`` reads a wall-clock value in the
session time zone, so gaps and grids would move across a DST change on a
cluster whose session zone is not UTC.  These build the micros from the
value's own fields and back, so every event-time rule is in UTC whatever
the session zone (JVM-side expressions, codegen friendly).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

DAY_US = 86_400_000_000
EPOCH = dt.date(1970, 1, 1)


def ntz_micros(c: Column) -> Column:
    """Microseconds since 1970-01-01 00:00 of a wall-clock timestamp."""
    secs = F.date_part(F.lit("SECOND"), c)  # seconds with their fraction
    return (F.unix_date(c.cast("date")).cast("long") * DAY_US
            + (F.hour(c) * 3600 + F.minute(c) * 60).cast("long") * 1_000_000
            + (secs * 1_000_000).cast("long"))


def ntz_from_micros(us: Column) -> Column:
    """The wall-clock timestamp ``us`` microseconds after 1970-01-01 00:00."""
    day = F.floor(us / F.lit(DAY_US))
    rest = us - day * DAY_US
    midnight = F.date_add(F.lit(EPOCH), day.cast("int")).cast("timestamp_ntz")
    return midnight + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                         (rest / F.lit(1_000_000)).cast("decimal(18,6)"))
