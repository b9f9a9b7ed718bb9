"""Structured Streaming jobs replacing the reference's polling loops.

Each job is a ``foreachBatch`` that runs the batch operators on what a
micro-batch touches, together with the state those keys left behind, so a
stream gives what the batch job gives on the same data.  State lives in
keyed snapshots (``tavolo.streaming.store``): hash buckets of current
rows, of which a batch reads and rewrites those it touches.  No job reads
its log again, and none holds a key's rows in Python.

Event time: the call and debounce jobs keep a watermark, the greatest
event time seen less an allowed delay.  Events wait until the watermark
reaches them, are processed in order, and an event that comes after that
goes to a late table with the rows it would have been.  State that the
watermark has made irrelevant times out at compaction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tavolo.functions.clock import ntz_from_micros, ntz_micros
from tavolo.functions.money import MONEY
from tavolo.functions.text import ACTIVE_STATUSES
from tavolo.operators import calls as call_ops
from tavolo.operators import carts as cart_ops
from tavolo.operators import orders as fold_ops
from tavolo.operators.common import RING_COOLDOWN_SECONDS, URGENT_ABOVE, ts_lit
from tavolo.plans import cut_lineage
from tavolo.streaming.store import EpochStore, KeyedSnapshot

BUCKETS = 64                # default; a snapshot keeps the number it was made with
COMPACT_EVERY = 8           # files of a bucket before they are rewritten as one
ORDER_TTL_EPOCHS = 100_800  # a week of six-second batches: closed orders leave the working set


def _run(stream: DataFrame, batch, checkpoint: str, trigger: dict | None):
    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


# ------------------------------------------------------------ order state
EVENT_ROWS = ("order_id long, seq int, kind string, restaurant_id int, status_arg string, payment string, "
              f"items array<{fold_ops.LINE}>, ts timestamp_ntz, touched long")
STATE_ROWS = ("order_id long, status string, payment_method string, created_at timestamp_ntz, closed_at timestamp_ntz, "
              "subtotal decimal(18,4), tax decimal(18,4), total decimal(18,4), n_lines long, last_seq int, touched long")


def order_snapshots(store: EpochStore, buckets: int = BUCKETS, compact_every: int = COMPACT_EVERY):
    """(events of the orders in the working set, their current state)."""
    return (KeyedSnapshot(store, "order_events", EVENT_ROWS, ["order_id", "seq"], ["order_id"], buckets, compact_every),
            KeyedSnapshot(store, "order_state", STATE_ROWS, ["order_id"], None, buckets, compact_every))


def order_state_batch(store: EpochStore, batch: DataFrame, epoch: int, tax_rate=None,
                      restaurants: DataFrame | None = None, ttl_epochs: int = ORDER_TTL_EPOCHS,
                      buckets: int = BUCKETS, compact_every: int = COMPACT_EVERY) -> None:
    """Re-fold the touched orders from their own events, in the touched buckets.

    The events of an order stay in the working set while it is active and
    for ``ttl_epochs`` batches after its last event (a reopen is legal);
    then its state moves to the archive and its events go.  An event
    delivered twice is one row (key order_id, seq).  Events that never got
    their create, or that come after their order was archived, wait as
    long and then go to ``order_events_archive``, the late side output.
    What a batch reads so follows the orders in work, not the log.
    """
    log, state = order_snapshots(store, buckets, compact_every)
    new = fold_ops.item_events(batch).withColumn("touched", F.lit(int(epoch)).cast("long")).select(*log.columns)
    new = cut_lineage(new.dropDuplicates(["order_id", "seq"]))
    touched = log.buckets_of(new)
    if not touched:
        return
    orders = new.select("order_id").distinct()
    known = log.rows(epoch, touched).join(orders, "order_id", "left_semi")
    events = known.join(new.select("order_id", "seq"), ["order_id", "seq"], "left_anti").unionByName(new)
    folded = fold_ops.order_state(events.drop("touched"), tax_rate, restaurants=restaurants)
    now = cut_lineage(folded.withColumn("touched", F.lit(int(epoch)).cast("long")))
    old = F.col("touched") <= int(epoch) - ttl_epochs

    def done(rows: DataFrame) -> DataFrame:
        return rows.withColumn("expired", ~F.col("status").isin(*ACTIVE_STATUSES) & old)

    # both are compacted together, so an order's events and its state leave in the same batch
    due = sorted({*log.due(epoch), *state.due(epoch)})
    before = state.rows(epoch, due).join(now.select("order_id"), "order_id", "left_anti").unionByName(
        now.where(state.bucket().isin(due or [-1])))
    verdict = done(before).select("order_id", F.col("expired").alias("__archived"))

    def without_order(rows: DataFrame) -> DataFrame:
        """Events of archived orders, and events that waited too long for a create."""
        flagged = rows.join(verdict, "order_id", "left")
        return flagged.withColumn("expired", F.coalesce("__archived", old)).withColumn(
            "orphan", F.col("__archived").isNull())

    log.merge(new, epoch, expire=without_order, archive="orphan", due=due)
    state.merge(now, epoch, expire=done, archive="expired", due=due)


def current_order_state(store: EpochStore, buckets: int = BUCKETS, compact_every: int = COMPACT_EVERY) -> DataFrame:
    """State of every order: the working set and the archive."""
    _, state = order_snapshots(store, buckets, compact_every)
    return state.rows_with_archive()


def stream_order_state(events: DataFrame, store: EpochStore, checkpoint: str, trigger: dict | None = None,
                       restaurants: DataFrame | None = None, **options):
    return _run(events, lambda df, epoch: order_state_batch(store, df, epoch, restaurants=restaurants, **options),
                checkpoint, trigger)


# ------------------------------------------------------------ sales panels
ORDER_ROWS = ("order_id long, restaurant_id int, status string, total decimal(18,4), created_at timestamp_ntz, "
              "version long")
SALES_ROWS = "restaurant_id int, s decimal(38,4), n long, n_total long"


def sales_snapshots(store: EpochStore, buckets: int = BUCKETS):
    return (KeyedSnapshot(store, "orders", ORDER_ROWS, ["order_id"], buckets=buckets),
            KeyedSnapshot(store, "sales_summary", SALES_ROWS, ["restaurant_id"], buckets=min(buckets, 8)))


def _contribution(df: DataFrame, since, sign: int) -> DataFrame:
    """What each order row adds to its tenant's figures (or, with sign -1, takes back)."""
    counts = (F.col("status") == "closed") & (F.col("created_at") >= ts_lit(since))
    one = F.when(counts, F.lit(sign)).otherwise(F.lit(0))
    return df.select("restaurant_id",
                     F.when(counts, F.col("total") * sign).cast("decimal(38,4)").alias("s"),
                     one.cast("long").alias("n"),
                     F.when(F.col("total").isNotNull(), one).otherwise(F.lit(0)).cast("long").alias("n_total"))


def sales_batch(store: EpochStore, batch: DataFrame, epoch: int, restaurants: DataFrame, since,
                buckets: int = BUCKETS) -> None:
    """Sales as a retracting aggregate: the old version of each changed order out, the new one in.

    ``batch`` holds whole order rows with ``version``, a sequence that grows
    with each change of the order.  The newest version in the batch counts
    if it is newer than the stored one; tenant figures then change by the
    difference of both rows, so neither the orders of a tenant nor earlier
    epochs are read: only the touched buckets of the order snapshot and of
    the tenants' figures.
    """
    orders, sales = sales_snapshots(store, buckets)
    cols = [c for c in orders.columns if c != "order_id"]
    newest = (batch.groupBy("order_id").agg(F.max_by(F.struct(*cols), "version").alias("v"))
              .select("order_id", *[F.col("v")[c].alias(c) for c in cols])
              .select(*[F.col(f.name).cast(f.dataType) for f in
                        store.spark.createDataFrame([], ORDER_ROWS).schema]))
    stored = orders.rows(epoch, orders.buckets_of(newest)).select("order_id", F.struct(*cols).alias("old"))
    changed = cut_lineage(newest.join(stored, "order_id", "left")
                          .where(F.col("old").isNull() | (F.col("version") > F.col("old.version"))))
    taken = changed.where("old is not null").select("order_id", *[F.col("old")[c].alias(c) for c in cols])
    # a tenant whose orders came without a change still has a row
    touched = batch.select(F.col("restaurant_id").cast("int").alias("restaurant_id")).distinct()
    zero = touched.select("restaurant_id", F.lit(0).cast("decimal(38,4)").alias("s"), F.lit(0).cast("long").alias("n"),
                          F.lit(0).cast("long").alias("n_total"))
    delta = (_contribution(changed, since, 1).unionByName(_contribution(taken, since, -1)).unionByName(zero)
             .join(restaurants.select("restaurant_id"), "restaurant_id", "left_semi")
             .groupBy("restaurant_id").agg(*[F.sum(c).alias(c) for c in ("s", "n", "n_total")]))
    delta = cut_lineage(delta)
    was = sales.rows(epoch, sales.buckets_of(delta)).select(
        "restaurant_id", *[F.col(c).alias(f"was_{c}") for c in ("s", "n", "n_total")])
    now = delta.join(was, "restaurant_id", "left").select(
        "restaurant_id", (F.coalesce("s", F.lit(0)) + F.coalesce("was_s", F.lit(0))).cast("decimal(38,4)").alias("s"),
        *[(F.col(c) + F.coalesce(f"was_{c}", F.lit(0))).alias(c) for c in ("n", "n_total")])
    sales.merge(now, epoch)
    orders.merge(changed, epoch)


def current_sales(store: EpochStore, buckets: int = BUCKETS) -> DataFrame:
    """The sales panel of every tenant with orders so far."""
    _, sales = sales_snapshots(store, buckets)
    return sales.rows().select(
        "restaurant_id", F.col("s").cast(MONEY).alias("total_sales"), F.col("n").cast("int").alias("order_count"),
        F.coalesce(F.when(F.col("n_total") > 0, F.col("s").cast(MONEY).cast("double") / F.col("n_total")),
                   F.lit(0.0)).alias("avg_order"))


def stream_sales(orders: DataFrame, store: EpochStore, restaurants: DataFrame, since, checkpoint: str,
                 trigger: dict | None = None):
    return _run(orders, lambda df, epoch: sales_batch(store, df, epoch, restaurants, since), checkpoint, trigger)


# ------------------------------------------------------------ availability + carts
AVAILABILITY_ROWS = "menu_item_id long, is_available boolean, seq long"
CART_ROWS = ("cart_id long, item_id long, qty long, line_since long, name string, price decimal(18,4), "
             "last_seq long, touched long")
HOLDER_ROWS = "item_id long, cart_id long, gone boolean"
CART_TTL_EPOCHS = 40_320    # a week of batches every 15 s: a removed line's row


def cart_snapshots(store: EpochStore, buckets: int = BUCKETS):
    """(cart lines by cart, the inverted index item -> carts that hold it)."""
    return (KeyedSnapshot(store, "cart_lines", CART_ROWS, ["cart_id", "item_id"], ["cart_id"], buckets),
            KeyedSnapshot(store, "item_carts", HOLDER_ROWS, ["item_id", "cart_id"], ["item_id"], buckets))


def availability_snapshot(store: EpochStore, buckets: int = BUCKETS) -> KeyedSnapshot:
    return KeyedSnapshot(store, "availability", AVAILABILITY_ROWS, ["menu_item_id"], buckets=buckets)


def _put_lines(store: EpochStore, lines: DataFrame, epoch: int, buckets: int) -> None:
    """Changed cart lines (qty 0: no longer in the cart) into both cart snapshots."""
    carts, holders = cart_snapshots(store, buckets)
    stale = (F.col("qty") == 0) & (F.col("touched") <= int(epoch) - CART_TTL_EPOCHS)
    carts.merge(lines, epoch, expire=lambda rows: rows.withColumn("expired", stale))
    holders.merge(lines.select("item_id", "cart_id", (F.col("qty") == 0).alias("gone")), epoch)


def load_carts(store: EpochStore, cart_lines: DataFrame, buckets: int = BUCKETS) -> None:
    """Start the cart snapshots from folded lines (once; epoch -1)."""
    carts, _ = cart_snapshots(store, buckets)
    if carts.before().buckets:
        return
    lines = cart_lines.withColumns({"last_seq": F.col("line_since").cast("long"), "touched": F.lit(-1).cast("long")})
    _put_lines(store, cut_lineage(lines.select(*carts.columns)), -1, buckets)


def cart_batch(store: EpochStore, batch: DataFrame, epoch: int, menu_items: DataFrame, buckets: int = BUCKETS) -> None:
    """Click events (cart_id, item_id, seq, delta) into the cart lines and the index.

    A line's quantity so far is the first step of its walk (the floored walk
    starts from any quantity), so the batch operator folds the new events
    alone.  Events at or before the line's last one are late.
    """
    carts, _ = cart_snapshots(store, buckets)
    keys = ["cart_id", "item_id"]
    events = cut_lineage(batch.select(*[F.col(c).cast("long") for c in ("cart_id", "item_id", "seq", "delta")])
                         .dropDuplicates([*keys, "seq"]))
    stored = carts.rows(epoch, carts.buckets_of(events)).select(
        *keys, F.col("qty").alias("was_qty"), F.col("line_since").alias("was_since"), "last_seq")
    flagged = events.join(stored, keys, "left").withColumn("late", F.coalesce(F.col("seq") <= F.col("last_seq"),
                                                                              F.lit(False)))
    flagged = cut_lineage(flagged)
    store.write(flagged.where("late").select(*keys, "seq", "delta"), "late_cart_events", epoch)
    fresh = flagged.where("not late")
    start = (fresh.where("was_qty > 0").groupBy(*keys).agg(F.first("last_seq").alias("seq"),
                                                         F.first("was_qty").alias("delta"))
             .withColumn("start", F.lit(True)))
    walk = fresh.select(*keys, "seq", "delta", F.lit(False).alias("start")).unionByName(start)
    now = cart_ops.cart_line_states(walk).groupBy(*keys).agg(
        F.max_by("q", "seq").cast("long").alias("qty"), F.max("seq").alias("last_seq"),
        F.max(F.when((F.col("q") == 1) & (F.col("delta") == 1) & ~F.col("start"), F.col("seq"))).alias("since"))
    names = menu_items.select(F.col("menu_item_id").alias("item_id"), "name", "price")
    lines = (now.join(stored.drop("last_seq"), keys, "left").join(names, "item_id", "left")
             .withColumn("line_since", F.when(F.col("qty") > 0, F.coalesce("since", "was_since")))
             .withColumn("touched", F.lit(int(epoch)).cast("long")).select(*carts.columns))
    _put_lines(store, cut_lineage(lines), epoch, buckets)


def current_carts(store: EpochStore, buckets: int = BUCKETS) -> DataFrame:
    return cart_snapshots(store, buckets)[0].rows().where("qty > 0").select(
        "cart_id", "item_id", "qty", "line_since", "name", "price")


def carts_holding(store: EpochStore, items: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """All lines of the carts that hold one of ``items (item_id)``.

    The index buckets of the items give the carts, and the cart buckets of
    those carts give the lines; nothing else is read.
    """
    carts, holders = cart_snapshots(store, buckets)
    held = holders.rows(None, holders.buckets_of(items)).join(items, "item_id", "left_semi")
    ids = cut_lineage(held.select("cart_id").distinct())
    return (carts.rows(None, carts.buckets_of(ids)).where("qty > 0").join(ids, "cart_id", "left_semi")
            .select("cart_id", "item_id", "qty", "line_since", "name", "price"))


def availability_batch(store: EpochStore, batch: DataFrame, epoch: int, menu_items: DataFrame,
                       cart_lines: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Newest toggle per item into the snapshot, then prune the carts that hold a toggled item."""
    if cart_lines is not None:
        load_carts(store, cart_lines, buckets)
    snap = availability_snapshot(store, buckets)
    # a toggle of an unknown item updates nothing
    known = batch.join(menu_items.select("menu_item_id"), "menu_item_id", "left_semi")
    latest = known.groupBy("menu_item_id").agg(F.max_by("is_available", "seq").alias("is_available"),
                                               F.max("seq").cast("long").alias("seq"))
    latest = cut_lineage(latest.select(F.col("menu_item_id").cast("long").alias("menu_item_id"), "is_available", "seq"))
    stored = snap.rows(epoch, snap.buckets_of(latest)).select("menu_item_id", F.col("seq").alias("was"))
    newer = latest.join(stored, "menu_item_id", "left").where("was is null or seq > was").drop("was")
    newer = cut_lineage(newer)
    snap.merge(newer, epoch)
    carts = cut_lineage(carts_holding(store, newer.select(F.col("menu_item_id").alias("item_id")), buckets))
    on_sale = carts.select(F.col("item_id").alias("menu_item_id")).distinct()
    now = snap.rows(None, snap.buckets_of(on_sale)).select("menu_item_id", F.col("is_available").alias("toggled"))
    avail = (menu_items.join(on_sale, "menu_item_id", "left_semi").select("menu_item_id", "is_available")
             .join(now, "menu_item_id", "left")
             .select("menu_item_id", F.coalesce("toggled", "is_available").alias("is_available")))
    store.write(cart_ops.cart_availability_prune(carts, avail), "cart_prune", epoch)


def stream_availability(toggles: DataFrame, store: EpochStore, menu_items: DataFrame, cart_lines: DataFrame | None,
                        checkpoint: str, trigger: dict | None = None):
    if cart_lines is not None:
        load_carts(store, cart_lines)
    return _run(toggles, lambda df, epoch: availability_batch(store, df, epoch, menu_items), checkpoint, trigger)


def stream_carts(clicks: DataFrame, store: EpochStore, menu_items: DataFrame, checkpoint: str,
                 trigger: dict | None = None):
    return _run(clicks, lambda df, epoch: cart_batch(store, df, epoch, menu_items), checkpoint, trigger)


# ------------------------------------------------------------ event time of the ring log
RING_ROWS = "seq long, table_id long, kind string, ts timestamp_ntz, us long"


def late_events(store: EpochStore, name: str) -> DataFrame:
    """The late events of ``rings`` (call alerts) or ``debounce``."""
    return store.read(f"late_{name}", RING_ROWS)


def _ripe(store: EpochStore, name: str, batch: DataFrame, epoch: int, meta: dict, base_epoch: int,
          seen: DataFrame, delay_us: int) -> tuple[DataFrame, int | None]:
    """The events that the watermark has reached, and the new watermark.

    ``seen`` holds each table's greatest processed (us, seq).  An event is
    late if the watermark or its table has passed it; it goes to
    ``late_<name>``.  Events the watermark has not reached wait in
    ``waiting_<name>``, which is rewritten each epoch and holds ``delay_us``
    of event time.
    """
    passed = meta.get("watermark_us")
    events = batch.select("seq", F.col("table_id").cast("long").alias("table_id"), "kind", "ts",
                          ntz_micros(F.col("ts")).alias("us")).join(seen, "table_id", "left")
    late = F.coalesce(F.struct("us", "seq") <= F.struct("seen_us", "seen_seq"), F.lit(False)) & F.col("seen_us").isNotNull()
    if passed is not None:
        late = late | (F.col("us") < F.lit(passed))
    events = cut_lineage(events.withColumn("late", late).drop("seen_us", "seen_seq"))
    store.write(events.where("late").drop("late"), f"late_{name}", epoch)
    waiting = store.read_epoch(f"waiting_{name}", base_epoch, RING_ROWS)
    all_ = waiting.unionByName(events.where("not late").drop("late")).dropDuplicates(["table_id", "seq"])
    greatest = events.agg(F.max("us")).first()[0]
    if greatest is None and passed is None:
        return all_, None
    mark = max(x for x in (passed, None if greatest is None else greatest - delay_us) if x is not None)
    all_ = cut_lineage(all_)
    store.write(all_.where(F.col("us") > mark), f"waiting_{name}", epoch)
    return all_.where(F.col("us") <= mark), mark


# ------------------------------------------------------------ call alerts
TABLE_ROWS = ("table_id long, seen_us long, seen_seq long, open_count long, listed long, "
              "poll_us long, poll_last struct<us: long, seq: long, n: long>")


def calls_snapshot(store: EpochStore, buckets: int = BUCKETS) -> KeyedSnapshot:
    return KeyedSnapshot(store, "ring_tables", TABLE_ROWS, ["table_id"], buckets=buckets)


def calls_batch(store: EpochStore, batch: DataFrame, epoch: int, poll_seconds: int = 3600,
                urgent_above: int = URGENT_ABOVE, delay_seconds: int = 0, buckets: int = BUCKETS) -> None:
    """Newly-ringing alerts on a grid of polls, as the batch operator gives them.

    A table's state is its open rings, the count that its last closed poll
    saw, and its poll in progress.  A poll closes when the watermark passes
    its instant, and alerts if the table's count rose since the last one.
    A table without open rings and without a poll in progress times out:
    a new row for it starts from the same values.
    """
    snap = calls_snapshot(store, buckets)
    base = snap.before(epoch)
    state = snap.rows(epoch)
    step = poll_seconds * 1_000_000
    ripe, mark = _ripe(store, "rings", batch, epoch, base.meta, base.epoch,
                       state.select("table_id", "seen_us", "seen_seq"), delay_seconds * 1_000_000)
    if mark is None:
        return
    counted = call_ops.with_open_counts(ripe, carried=state.select("table_id", "open_count"))
    counted = cut_lineage(counted.withColumn("poll_us", (F.floor(F.col("us") / step) + 1) * step))
    last = F.struct("us", "seq", F.col("open_count").alias("n"))
    polls = (counted.select("table_id", "poll_us", last.alias("poll_last"))
             .unionByName(state.where("poll_us is not null").select("table_id", "poll_us", "poll_last"))
             .groupBy("table_id", "poll_us").agg(F.max("poll_last").alias("poll_last")))
    closed = cut_lineage(polls.where(F.col("poll_us") <= mark))
    w = Window.partitionBy("table_id").orderBy("poll_us")
    alerts = (closed.join(state.select("table_id", "listed"), "table_id", "left")
              .withColumn("call_count", F.col("poll_last.n"))
              .withColumn("prev_count", F.coalesce(F.lag("call_count").over(w), "listed", F.lit(0)))
              .where("call_count > prev_count")
              .select("table_id", ntz_from_micros(F.col("poll_us")).alias("poll_at"), "call_count", "prev_count",
                      (F.col("prev_count") == 0).alias("is_new"), (F.col("call_count") > urgent_above).alias("urgent")))
    store.write(alerts, "alerts", epoch)
    at_end = counted.groupBy("table_id").agg(F.max(F.struct("seq", "open_count")).alias("e"),
                                             F.max(F.struct("us", "seq")).alias("s"))
    listed = closed.groupBy("table_id").agg(F.max_by(F.col("poll_last.n"), "poll_us").alias("now_listed"))
    running = polls.where(F.col("poll_us") > mark).select("table_id", F.col("poll_us").alias("now_poll"),
                                                          F.col("poll_last").alias("now_last"))
    changed = at_end.select("table_id").unionByName(listed.select("table_id")).distinct()
    now = (changed.join(state, "table_id", "left").join(at_end, "table_id", "left").join(listed, "table_id", "left")
           .join(running, "table_id", "left")
           .select("table_id", F.coalesce("s.us", "seen_us").alias("seen_us"), F.coalesce("s.seq", "seen_seq").alias("seen_seq"),
                   F.coalesce("e.open_count", "open_count").alias("open_count"),
                   F.coalesce("now_listed", "listed", F.lit(0)).cast("long").alias("listed"),
                   F.col("now_poll").alias("poll_us"), F.col("now_last").alias("poll_last")))
    idle = (F.col("open_count") == 0) & (F.col("listed") == 0) & F.col("poll_us").isNull()
    snap.merge(cut_lineage(now), epoch, {"watermark_us": mark}, lambda rows: rows.withColumn("expired", idle))


def stream_calls(ring_log: DataFrame, store: EpochStore, checkpoint: str, trigger: dict | None = None, **options):
    """Alerts into ``alerts``, late events into ``late_rings``."""
    return _run(ring_log, lambda df, epoch: calls_batch(store, df, epoch, **options), checkpoint, trigger)


# ------------------------------------------------------------ ring debounce
LOCK_ROWS = "table_id long, seen_us long, seen_seq long, last_us long"


def debounce_snapshot(store: EpochStore, buckets: int = BUCKETS) -> KeyedSnapshot:
    return KeyedSnapshot(store, "ring_locks", LOCK_ROWS, ["table_id"], buckets=buckets)


def debounce_batch(store: EpochStore, batch: DataFrame, epoch: int, cooldown_s: int = RING_COOLDOWN_SECONDS,
                   delay_seconds: int = 0, buckets: int = BUCKETS) -> None:
    """Accepted and dropped rings, as the batch operator gives them.

    A table's state is its last accepted ring, which goes before the new
    rings of the batch operator.  A lock that the watermark has left
    behind by the cooldown times out: the next ring is accepted anyway.
    """
    snap = debounce_snapshot(store, buckets)
    base = snap.before(epoch)
    gap = cooldown_s * 1_000_000
    rings = batch.where(F.col("kind") == "ring")
    ids = [b for b in base.buckets] if not base.buckets else snap.buckets_of(
        rings.select(F.col("table_id").cast("long").alias("table_id")))
    state = snap.rows(epoch, None if delay_seconds else ids)
    ripe, mark = _ripe(store, "debounce", rings, epoch, base.meta, base.epoch,
                       state.select("table_id", "seen_us", "seen_seq"), delay_seconds * 1_000_000)
    if mark is None:
        return
    ripe = cut_lineage(ripe)
    locks = state.join(ripe.select("table_id").distinct(), "table_id", "left_semi").select(
        F.lit(-1).cast("long").alias("seq"), "table_id", F.lit("ring").alias("kind"),
        ntz_from_micros(F.col("last_us")).alias("ts"))
    walked = call_ops.ring_debounce(ripe.drop("us").unionByName(locks), cooldown_s)
    walked = cut_lineage(walked.withColumn("us", ntz_micros(F.col("ts"))))
    store.write(walked.where("seq >= 0").select("seq", "table_id", "ts", "accepted"), "debounce", epoch)
    now = walked.groupBy("table_id").agg(
        F.max(F.struct("us", "seq")).alias("s"), F.max(F.when(F.col("accepted"), F.col("us"))).alias("last_us"))
    now = now.select("table_id", F.col("s.us").alias("seen_us"), F.col("s.seq").alias("seen_seq"), "last_us")
    over = F.col("seen_us") + gap <= F.lit(mark)
    snap.merge(cut_lineage(now), epoch, {"watermark_us": mark}, lambda rows: rows.withColumn("expired", over))


def stream_ring_debounce(ring_log: DataFrame, store: EpochStore, checkpoint: str, trigger: dict | None = None,
                         **options):
    """Verdicts into ``debounce``, late rings into ``late_debounce``."""
    return _run(ring_log, lambda df, epoch: debounce_batch(store, df, epoch, **options), checkpoint, trigger)
