"""Running (prefix) aggregates per key that split hot keys.

``Window.partitionBy(key).orderBy(o)`` sends every row of a key to one
task, so a key holding a third of the data runs on one core.  A prefix
sum / max / min / last-non-null is associative, so it splits:

1. cut each key's rows into chunks of the ordering value
   (``floor(o / chunk_size)``) and run the window per (key, chunk);
2. aggregate one row per (key, chunk) -- the chunk's total, a partial
   aggregate that combines map-side -- and run a small window over the
   chunks of each key for the carry-in;
3. combine the local result with the carry-in (a join on
   (key, chunk) that keeps the big side's partitioning).

The big side is shuffled once, exactly as with a plain window; the chunk
summaries are small for a hot key (its ordering range / chunk_size).  A
later stage whose input depends on an earlier stage re-derives that stage
for its totals over the pruned columns only.  Keys must not be NULL.

Chunks are cut on the ordering value, so a small key whose few rows are
far apart (an order's events over a day of a global sequence) would get
one chunk per row, and its summary would be as long as its rows.  Hence
only *hot* keys are chunked: a first pass counts rows per key (a partial
aggregate), keys above ``hotKeyRows`` form the hot list, whose length is
counted before it is broadcast (a shuffle join beyond the limit); the
other keys take a plain window, where a task holds at most ``hotKeyRows``
rows of one key.  Without hot keys the scan is one plain window, i.e.
one shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tavolo.plans.joins import checked_broadcast

DEFAULT_CHUNK = 1 << 16
HOT_KEY_ROWS = 1 << 20          # rows of one key above which its scan is chunked
CONF_HOT_KEY_ROWS = "tavolo.scan.hotKeyRows"


def hot_key_rows(spark) -> int:
    """The session's hot-key threshold (``tavolo.scan.hotKeyRows``)."""
    return int(spark.conf.get(CONF_HOT_KEY_ROWS, str(HOT_KEY_ROWS)))


def split_hot_keys(df: DataFrame, keys: list[str], threshold: int):
    """``(hot rows or None, other rows)``: a key is hot above ``threshold`` rows.

    The count per key combines map-side.  The hot list holds at most
    rows / threshold keys; its length is counted before a broadcast, and a
    longer list is joined by a shuffle instead.
    """
    hot = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
           .where(F.col("__n") > F.lit(threshold)).select(*keys))
    n = hot.count()
    if n == 0:
        return None, df
    flag = checked_broadcast(hot, n=n)
    return df.join(flag, keys, "left_semi"), df.join(flag, keys, "left_anti")


@dataclass
class Prefix:
    """One running aggregate: ``name = kind(expr)`` over the rows before / up to each row."""
    name: str
    kind: str            # "sum" | "max" | "min" | "last"  (last = last non-null)
    expr: Column
    inclusive: bool = True
    reverse: bool = False  # scan from the end (a suffix aggregate)


def _local(kind, x, w):
    if kind == "sum":
        return F.sum(x).over(w)
    if kind == "max":
        return F.max(x).over(w)
    if kind == "min":
        return F.min(x).over(w)
    if kind == "last":
        return F.last(x, ignorenulls=True).over(w)
    raise ValueError(kind)


def _chunk_total(kind, x, pos, descending):
    """The chunk's total as a plain aggregate of the input (combines map-side)."""
    if kind == "sum":
        return F.sum(x)
    if kind == "max":
        return F.max(x)
    if kind == "min":
        return F.min(x)
    key = F.when(x.isNotNull(), pos)
    return F.min_by(x, key) if descending else F.max_by(x, key)


def _carry(kind, x, w):
    if kind == "sum":
        return F.sum(x).over(w)
    if kind == "max":
        return F.max(x).over(w)
    if kind == "min":
        return F.min(x).over(w)
    return F.last(x, ignorenulls=True).over(w)


def _combine(kind, local, carry):
    if kind == "sum":
        return F.when(local.isNull() & carry.isNull(), F.lit(None)).otherwise(
            F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0)))
    if kind == "max":
        return F.greatest(local, carry)
    if kind == "min":
        return F.least(local, carry)
    return F.coalesce(local, carry)


def _stages(specs):
    return specs if specs and isinstance(specs[0], (list, tuple)) else [specs]


def _sort(order: str, tiebreak: str | None, rev: bool):
    o = F.col(order)
    sort = [o.desc() if rev else o.asc()]
    if tiebreak:
        sort.append(F.col(tiebreak).desc() if rev else F.col(tiebreak).asc())
    return sort


def plain_prefix(df: DataFrame, keys: list[str], order: str, specs, descending: bool = False,
                 tiebreak: str | None = None) -> DataFrame:
    """The same columns as ``prefix_by_key`` with one window per key (no split)."""
    for stage in _stages(specs):
        cols = {}
        for sp in stage:
            w = (Window.partitionBy(*keys).orderBy(*_sort(order, tiebreak, descending != sp.reverse))
                 .rowsBetween(Window.unboundedPreceding, 0 if sp.inclusive else -1))
            cols[sp.name] = _local(sp.kind, sp.expr, w)
        df = df.withColumns(cols)
    return df


def prefix_by_key(df: DataFrame, keys: list[str], order: str, specs,
                  chunk_size: int = DEFAULT_CHUNK, descending: bool = False,
                  tiebreak: str | None = None, hot_rows: int | None = None) -> DataFrame:
    """Add one column per spec: the running aggregate within ``keys`` by ``order``.

    ``specs`` is a list of ``Prefix`` or a list of such lists (stages); a
    later stage may use the columns of an earlier one.  Keys with more than
    ``hot_rows`` rows (default: the session's ``tavolo.scan.hotKeyRows``)
    are chunked; all stages share one chunk column, so their rows are
    shuffled once by (keys, chunk) and later windows only re-sort.  The
    other keys take ``plain_prefix``.  ``descending`` flips the scan
    direction of every spec, ``Prefix.reverse`` that of one spec.

    ``order`` must be numeric; ``tiebreak`` orders rows with equal
    ``order`` (ties never cross chunks, which are cut on ``order``).
    Finding the hot keys runs one counting job when the frame is built.
    """
    threshold = hot_key_rows(df.sparkSession) if hot_rows is None else hot_rows
    hot, other = split_hot_keys(df, keys, threshold)
    plain = plain_prefix(other, keys, order, specs, descending, tiebreak)
    if hot is None:
        return plain
    return plain.unionByName(chunked_prefix(hot, keys, order, specs, chunk_size, descending, tiebreak))


def chunked_prefix(df: DataFrame, keys: list[str], order: str, specs,
                   chunk_size: int = DEFAULT_CHUNK, descending: bool = False,
                   tiebreak: str | None = None) -> DataFrame:
    """The two-level scan of the module docstring, for every key of ``df``."""
    stages = _stages(specs)
    o = F.col(order)
    ck = "__chunk"
    df = df.withColumn(ck, F.floor(o / F.lit(chunk_size)).cast("long"))
    pos = o if tiebreak is None else F.struct(o, F.col(tiebreak))

    def windows(rev: bool):
        w1 = Window.partitionBy(*keys, ck).orderBy(*_sort(order, tiebreak, rev))
        w2 = Window.partitionBy(*keys).orderBy(F.col(ck).desc() if rev else F.col(ck).asc()) \
            .rowsBetween(Window.unboundedPreceding, -1)
        return w1, w2

    for stage in stages:
        for sp in stage:
            df = df.withColumn(f"__x_{sp.name}", sp.expr)
        # chunk totals straight from the input: a map-side partial aggregate
        # over the pruned columns, so only one row per (key, chunk) is shuffled
        summary = df.groupBy(*keys, ck).agg(*[
            _chunk_total(sp.kind, F.col(f"__x_{sp.name}"), pos, descending != sp.reverse)
            .alias(f"__t_{sp.name}") for sp in stage])
        carry_cols = []
        for sp in stage:
            w1, w2 = windows(descending != sp.reverse)
            frame = w1.rowsBetween(Window.unboundedPreceding, 0 if sp.inclusive else -1)
            df = df.withColumn(f"__l_{sp.name}", _local(sp.kind, F.col(f"__x_{sp.name}"), frame))
            carry_cols.append(_carry(sp.kind, F.col(f"__t_{sp.name}"), w2).alias(f"__c_{sp.name}"))
        carries = summary.select(*keys, ck, *carry_cols)
        df = df.join(carries, [*keys, ck], "left")
        for sp in stage:
            df = df.withColumn(sp.name, _combine(sp.kind, F.col(f"__l_{sp.name}"), F.col(f"__c_{sp.name}")))
        df = df.drop(*[f"__{p}_{sp.name}" for sp in stage for p in ("x", "l", "c")])
    return df.drop(ck)


def range_counts(df: DataFrame, key: str, order: list[str], name: str, weight: Column | None = None,
                 partitions: int | None = None) -> DataFrame:
    """Add ``name``: the running sum of ``weight`` (default 1 a row) within ``key`` by ``order``, this row included.

    A distributed rank: rows are range-partitioned by (key, order) on
    sampled bounds, so a key of any size, and rows that tie on its first
    order columns, spread over tasks by the later ones.  The ranges of a
    key follow one another, so a row's sum is its sum inside its range
    plus the totals of the key's ranges before it: one small row a key and
    range.  The ranges are checkpointed, because a recomputed sample could
    move their bounds between the two uses.  Keys may be NULL (one key).
    """
    from tavolo.plans.session import cut_lineage
    part, local, before = "__range", "__local", "__before"
    one = F.lit(1).cast("long") if weight is None else weight
    cols = [F.col(key), *[F.col(c) for c in order]]
    d = df.withColumn("__w", one)
    d = d.repartitionByRange(partitions, *cols) if partitions else d.repartitionByRange(*cols)
    d = cut_lineage(d.withColumn(part, F.spark_partition_id()))
    rows = Window.partitionBy(part, key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranges = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (d.groupBy(F.col(key).alias("__key"), F.col(part).alias("__part")).agg(F.sum("__w").alias("__n"))
              .withColumn(before, F.coalesce(F.sum("__n").over(ranges), F.lit(0))).drop("__n"))
    d = d.withColumn(local, F.sum("__w").over(rows))
    j = d.join(totals, (F.col(part) == F.col("__part")) & F.col(key).eqNullSafe(F.col("__key")))
    return j.withColumn(name, F.col(local) + F.col(before)).drop(part, local, before, "__key", "__part", "__w")
