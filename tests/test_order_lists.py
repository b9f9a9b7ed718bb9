"""Order folds over item lists and tenant rates against a step-by-step replay."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from simulate import replay_order_lists

from tavolo.operators import orders
from tavolo.plans.scan import CONF_HOT_KEY_ROWS

T0 = dt.datetime(2024, 1, 1)
RATES = {1: Decimal("0.05"), 2: Decimal("0"), 3: Decimal("0.0825"), 4: Decimal("0.5")}
LOG = ("order_id long, seq int, kind string, restaurant_id int, status_arg string, payment string, "
       "items array<struct<menu_item_id: long, name: string, price: decimal(18,4), qty: int>>, ts timestamp_ntz")


def line(rnd):
    return (rnd.choice([None, 1, 2]), rnd.choice(["a", "b", "a", "c"] * 4 + [None]),
            rnd.choice([Decimal("2.5"), Decimal("10"), Decimal("0.3333")] * 6 + [None]), rnd.choice([1, 2, 3] * 9 + [None]))


def log(seed, n_orders=60):
    rnd = random.Random(seed)
    rows = []
    for o in range(n_orders):
        for seq in range(rnd.randrange(1, 9)):
            first = seq == 0 and rnd.random() < 0.9
            kind = "create" if first else rnd.choice(["add", "replace", "status", "void", "add", "replace", "status",
                                                      "create" if rnd.random() < 0.1 else "add"])
            rows.append({"order_id": o, "seq": seq, "kind": kind,
                         "restaurant_id": rnd.choice([1, 2, 3, 4, 9]) if kind == "create" else None,
                         "status_arg": rnd.choice(["preparing", "ready", "closed", "open"]) if kind == "status" else None,
                         "payment": rnd.choice([None, "cash", "card"]) if kind == "status" else None,
                         "items": rnd.choice([None, []]) if rnd.random() < 0.25 else
                         [line(rnd) for _ in range(rnd.randrange(4))],
                         "ts": T0 + dt.timedelta(minutes=seq + 10 * o)})
    return rows


@pytest.mark.parametrize("hot", [None, "0"])
@pytest.mark.parametrize("seed", [1, 2])
def test_folds_of_lists_equal_a_replay(spark, seed, hot):
    rows = log(seed)
    names = [c.split()[0] for c in LOG.replace("array<struct<menu_item_id: long, name: string, price: decimal(18,4), qty: int>>",
                                               "x").split(", ")]
    ev = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], LOG)
    tenants = spark.createDataFrame(list(RATES.items()), "restaurant_id int, tax_rate decimal(9,6)")
    state, lines, rejected = replay_order_lists(rows, RATES)
    if hot is not None:
        spark.conf.set(CONF_HOT_KEY_ROWS, hot)
    try:
        got = {r.order_id: (r.status, r.payment_method, r.closed_at, r.subtotal, r.tax, r.total, r.n_lines)
               for r in orders.order_state(ev, restaurants=tenants, chunk_size=2).collect()}
        assert got == state
        now = {}
        for r in sorted(orders.current_lines(ev, 2).collect(), key=lambda r: (r.line_seq, r.line_idx)):
            now.setdefault(r.order_id, []).append((r.line_seq, r.line_idx, r.menu_item_id, r.name, r.price, r.qty))
        assert now == {o: x for o, x in lines.items() if x}
        nested = {r.order_id: [tuple(x) for x in r["items"]] for r in orders.current_items(ev, 2).collect()}
        assert nested == {o: [y[2:] for y in x] for o, x in lines.items()}
        rej = sorted((r.order_id, r.seq, "null" if r.reason.startswith("null value") else "closed")
                     for r in orders.rejected_order_events(ev, 2).collect())
        assert rej == rejected
    finally:
        spark.conf.unset(CONF_HOT_KEY_ROWS)


def test_empty_lists_and_sums(spark):
    """An empty create or add leaves no sum (NULL), an empty replace leaves 0."""
    def ev(order, seq, kind, items):
        return (order, seq, kind, 1 if kind == "create" else None, None, None, items, T0)
    one = [(1, "a", Decimal("2.0"), 2)]
    rows = [ev(1, 0, "create", []), ev(2, 0, "create", one), ev(2, 1, "replace", []), ev(3, 0, "create", one),
            ev(3, 1, "replace", None), ev(3, 2, "add", []), ev(4, 0, "create", []), ev(4, 1, "add", one + one)]
    tenants = spark.createDataFrame([(1, Decimal("0.05"))], "restaurant_id int, tax_rate decimal(9,6)")
    got = {r.order_id: (r.subtotal, r.tax, r.total, r.n_lines)
           for r in orders.order_state(spark.createDataFrame(rows, LOG), restaurants=tenants).collect()}
    assert got == {1: (None, None, None, 0), 2: (0, 0, 0, 0), 3: (None, None, None, 0), 4: (8, 0, 8, 2)}


def test_an_order_has_the_rate_of_its_tenant(spark):
    rows = [(o, 0, "create", t, None, None, [(1, "a", Decimal("100"), 1)], T0) for o, t in ((1, 1), (2, 2), (3, 3), (4, 9))]
    tenants = spark.createDataFrame(list(RATES.items()), "restaurant_id int, tax_rate decimal(9,6)")
    df = spark.createDataFrame(rows, LOG)
    got = {r.order_id: r.tax for r in orders.order_state(df, restaurants=tenants).collect()}
    assert got == {1: 5, 2: 0, 3: 8, 4: None}
    assert {r.tax for r in orders.order_state(df, tax_rate="0.1").select(F.col("tax")).collect()} == {10}
