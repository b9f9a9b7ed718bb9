"""Call-waiter analytics over the ring / ack log and the calls table.

Ring log: seq, table_id, kind (ring|ack), staff_id, ts.  An ack marks
every earlier open ring of its table, so the rings between two acks form
an *episode*; all per-ring figures are running aggregates inside one
window per table (one shuffle, one sort).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tavolo.functions.clock import ntz_from_micros, ntz_micros
from tavolo.operators.common import RING_COOLDOWN_SECONDS, URGENT_ABOVE
from tavolo.operators.reads import with_position
from tavolo.plans import cut_lineage
from tavolo.plans.scan import DEFAULT_CHUNK, Prefix, prefix_by_key, range_counts


def with_open_counts(ring_log: DataFrame, chunk_size: int = DEFAULT_CHUNK,
                     carried: DataFrame | None = None) -> DataFrame:
    """Per event: unacknowledged rings of the table right after it.

    open = R - R_at_last_ack, with R the running count of rings: a prefix
    sum and a prefix last-non-null, both split into chunks of seq so a
    busy table is spread over tasks.  ``carried (table_id, open_count)``
    are rings left open by earlier events; they count until the first ack.
    """
    ring = (F.col("kind") == "ring").cast("long")
    e = prefix_by_key(ring_log, ["table_id"], "seq",
                      [[Prefix("r", "sum", ring)],
                       [Prefix("r_ack", "last", F.when(F.col("kind") == "ack", F.col("r")))]], chunk_size)
    if carried is None:
        return e.withColumn("open_count", F.col("r") - F.coalesce("r_ack", F.lit(0))).drop("r", "r_ack")
    before = carried.select("table_id", F.col("open_count").alias("carried"))
    return (e.join(before, "table_id", "left")
            .withColumn("open_count", F.coalesce(F.col("r") - F.col("r_ack"),
                                                 F.col("r") + F.coalesce("carried", F.lit(0))))
            .drop("r", "r_ack", "carried"))


def ring_counts(ring_log: DataFrame, chunk_size: int = DEFAULT_CHUNK) -> DataFrame:
    """What ring_bell returns: the table's open rings after each ring."""
    return (with_open_counts(ring_log, chunk_size).where(F.col("kind") == "ring")
            .select("seq", "table_id", "ts", "open_count"))


def acknowledge_fold(ring_log: DataFrame, chunk_size: int = DEFAULT_CHUNK) -> DataFrame:
    """Each ring with the first later ack of its table (who, when), if any.

    "Nearest later ack" is a last-non-null scan in descending seq order,
    chunked like every other running aggregate here.
    """
    ack = F.when(F.col("kind") == "ack", F.struct(F.col("seq").alias("ack_seq"),
                                                   F.col("staff_id").alias("by"),
                                                   F.col("ts").alias("at")))
    e = prefix_by_key(ring_log, ["table_id"], "seq", [Prefix("nxt", "last", ack, inclusive=False)],
                      chunk_size, descending=True)
    return (e.where(F.col("kind") == "ring")
            .select("seq", "table_id", F.col("nxt").isNotNull().alias("acknowledged"),
                    F.col("nxt.by").alias("acknowledged_by"), F.col("nxt.ack_seq").alias("ack_seq"),
                    F.col("nxt.at").alias("acknowledged_at")))


def _open_calls(calls: DataFrame, tables: DataFrame, urgent_above: int) -> DataFrame:
    """Tables with open calls: label, count, first call, urgent."""
    agg = (calls.where(~F.col("acknowledged"))
           .groupBy("restaurant_id", "table_id")
           .agg(F.count(F.lit(1)).alias("call_count"), F.min("created_at").alias("first_called_at")))
    labels = tables.select("table_id", F.col("label").alias("table_label"))
    return agg.join(labels, "table_id", "left").select(
        "restaurant_id", "table_id", "table_label", "call_count", "first_called_at",
        (F.col("call_count") > urgent_above).alias("urgent"))


def active_calls(calls: DataFrame, tables: DataFrame, urgent_above: int = URGENT_ABOVE) -> DataFrame:
    """Tables with open calls, oldest first per tenant; urgent above 5.

    The position is a distributed rank (``with_position``), so a tenant
    with a huge share of the tables is split like any hot key.
    """
    return with_position(_open_calls(calls, tables, urgent_above), "restaurant_id", "first_called_at", "table_id")


def urgent_escalations(calls: DataFrame, tables: DataFrame, urgent_above: int = URGENT_ABOVE) -> DataFrame:
    """The urgent ones of the open calls (no position is computed)."""
    return _open_calls(calls, tables, urgent_above).where(F.col("urgent"))


def newly_ringing(ring_log: DataFrame, poll_seconds: int = 3600, chunk_size: int = DEFAULT_CHUNK) -> DataFrame:
    """Alerts a poller on a fixed grid would raise.

    A poll at instant P sees the events before P.  A table alerts when its
    open count is above what the previous poll saw (0 if it was not
    listed).  Counts change only at events, so only polls right after a
    table's events can alert: take each table's count at the end of each
    poll interval that has events, and compare with the previous such
    interval (``lag``).  No table x poll grid is materialised.
    """
    step = poll_seconds * 1_000_000
    us = ntz_micros(F.col("ts"))
    ev = with_open_counts(ring_log, chunk_size).withColumn(
        "poll_at", ntz_from_micros((F.floor(us / step) + 1) * step))
    # one row a table and poll, computed once for the hot-key count and the scan below
    per_poll = cut_lineage(ev.groupBy("table_id", "poll_at")
                           .agg(F.max_by("open_count", F.struct("ts", "seq")).alias("call_count"))
                           .withColumn("__poll_us", ntz_micros(F.col("poll_at"))))
    # the previous poll's count (never NULL) = the last count before this poll
    prev = prefix_by_key(per_poll, ["table_id"], "__poll_us",
                         [Prefix("prev_count", "last", F.col("call_count"), inclusive=False)],
                         chunk_size * step)
    return (prev.withColumn("prev_count", F.coalesce("prev_count", F.lit(0)))
            .where(F.col("call_count") > F.col("prev_count"))
            .select("table_id", "poll_at", "call_count", "prev_count",
                    (F.col("prev_count") == 0).alias("is_new")))


CHUNK_RINGS = 256     # rings of a chunk (results do not depend on it)


def _next_rings(rings: DataFrame, gap: int) -> DataFrame:
    """Per ring: its position in the table's order (from 0) and that of the first ring ``gap`` or more later.

    Both are counts of rings in one merged order of rings and probes (a
    probe stands ``gap`` after its ring, before rings of that instant), so
    one distributed running count gives them (``range_counts``).
    """
    marks = rings.select("table_id", "us", F.lit(1).alias("is_ring"), "seq", "ts")
    probes = rings.select("table_id", (F.col("us") + gap).alias("us"), F.lit(0).alias("is_ring"), "seq", "ts")
    n = range_counts(marks.unionByName(probes), "table_id", ["us", "is_ring", "seq"], "n",
                     weight=F.col("is_ring").cast("long"))
    ring = F.col("is_ring") == 1
    return n.groupBy("table_id", "seq").agg(F.max(F.when(ring, F.col("n") - 1)).alias("pos"),
                                            F.max(F.when(~ring, F.col("n"))).alias("nxt"), F.first("ts").alias("ts"))


def _chunks(walk: DataFrame, chunk_rings: int) -> DataFrame:
    """Chunks of at most ``chunk_rings`` consecutive rings with their map.

    ``rs`` are the chunk's rings; ``exits`` says for every ring of it: if
    this one is accepted, which ring is the first accepted one after the
    chunk.  It is built from the chunk's end: a ring whose next one lies
    outside exits there, any other exits where its next one does.
    ``start`` is the last ring that is accepted whatever came before (the
    table's first ring, or one that the ring before it does not lock).
    """
    rs = F.sort_array(F.collect_list(F.struct("pos", "nxt", "seq", "ts")))
    c = walk.groupBy("table_id", F.floor(F.col("pos") / F.lit(chunk_rings)).alias("chunk")).agg(rs.alias("rs"))
    exits = F.aggregate(
        F.reverse("rs"), F.array().cast("array<bigint>"),
        lambda acc, x: F.array_prepend(acc, F.coalesce(F.get(acc, (x["nxt"] - x["pos"] - 1).cast("int")), x["nxt"])))
    free = F.transform("rs", lambda x, i: (x["pos"] == 0) | (F.get(F.col("rs"), i - 1)["nxt"] <= x["pos"]))
    c = c.withColumns({"exits": exits, "free": F.transform(free, lambda f: F.coalesce(f, F.lit(False)))})
    return c.withColumn("start", F.array_max(F.filter(F.transform(
        "free", lambda f, i: F.when(f, i)), lambda i: i.isNotNull())))


def _entries(chunks: DataFrame) -> DataFrame:
    """(table_id, pos): the first accepted ring of every chunk that the walk enters from another.

    The walk over chunks starts from every chunk with a ring that is
    accepted anyway, at once, and composes the chunk maps: round k adds
    what 2^k maps lead to from everything found, and squares the maps.  It
    ends when a round finds nothing new, which is the first one where
    locks seldom cross a chunk, and log2(chunks in a row) rounds in one
    endless burst.  Only rings that some map exits to are looked up.
    """
    jumps = chunks.select("table_id", F.explode(F.arrays_zip(F.transform("rs", lambda x: x["pos"]).alias("pos"),
                                                             F.col("exits").alias("to"))).alias("j"))
    jumps = jumps.select("table_id", F.col("j.pos").alias("pos"), F.col("j.to").alias("to"))
    targets = jumps.select("table_id", F.col("to").alias("pos")).distinct()
    jumps = cut_lineage(jumps.join(targets, ["table_id", "pos"], "left_semi"))
    found = cut_lineage(chunks.where("start is not null").select(
        "table_id", F.get(F.col("exits"), F.col("start")).alias("pos")).distinct())
    n = found.count()
    while True:
        step = found.join(jumps, ["table_id", "pos"]).select("table_id", F.col("to").alias("pos"))
        grown = cut_lineage(found.unionByName(step).distinct())
        m = grown.count()
        if m == n:
            return grown
        found, n = grown, m
        then = jumps.select("table_id", F.col("pos").alias("to"), F.col("to").alias("far"))
        jumps = cut_lineage(jumps.join(then, ["table_id", "to"]).select("table_id", "pos", F.col("far").alias("to")))


def ring_debounce(ring_log: DataFrame, cooldown_s: int = RING_COOLDOWN_SECONDS,
                  chunk_rings: int = CHUNK_RINGS) -> DataFrame:
    """Drop rings within ``cooldown_s`` of the last *accepted* ring of the table.

    The rule is sequential along a table's rings, but a stretch of rings is
    a map: from the ring at which the walk enters it to the ring at which
    it goes on.  Rings are numbered by a distributed rank and cut into
    chunks of bounded rows; each chunk computes its map, the maps are
    composed over the chunks (``_entries``), and each chunk replays its own
    rings from where the walk enters it.  A chunk is the only thing that is
    gathered, so a table with any share of the rings, at any density, is
    spread over tasks, and the work is linear in the rings.

    Chunks and maps are checkpointed (they are read by each round); this
    runs jobs when the frame is built.
    """
    gap = cooldown_s * 1_000_000
    rings = (ring_log.where(F.col("kind") == "ring")
             .select("seq", "table_id", "ts", ntz_micros(F.col("ts")).alias("us")))
    chunks = cut_lineage(_chunks(_next_rings(rings, gap), chunk_rings))
    entry = _entries(chunks).groupBy("table_id", F.floor(F.col("pos") / F.lit(chunk_rings)).alias("chunk")).agg(
        F.min("pos").alias("entry"))
    verdicts = "array<boolean>"

    def step(acc, x):
        i = x["pos"] - F.get(F.col("rs"), F.lit(0))["pos"]
        ok = (x["pos"] == acc["at"]) | F.get(F.col("free"), i.cast("int"))
        return F.struct(F.when(ok, x["nxt"]).otherwise(acc["at"]).alias("at"), F.array_append(acc["ok"], ok).alias("ok"))

    init = F.struct(F.coalesce("entry", F.lit(-1)).cast("long").alias("at"), F.array().cast(verdicts).alias("ok"))
    walked = chunks.join(entry, ["table_id", "chunk"], "left").select(
        "table_id", F.explode(F.arrays_zip(F.col("rs").alias("r"), F.aggregate("rs", init, step)["ok"].alias("ok"))).alias("x"))
    return walked.select(F.col("x.r.seq").alias("seq"), "table_id", F.col("x.r.ts").alias("ts"),
                         F.col("x.ok").alias("accepted"))
