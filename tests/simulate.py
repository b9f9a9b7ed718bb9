"""Plain-Python step-by-step simulations of the reference rules.

Used only by the property tests: the Spark operators must give what a
row-at-a-time replay of the same commands gives.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

ACTIVE = {"open", "preparing", "ready"}
RATE = Decimal("0.05")


def _tax(sub):
    if sub is None:
        return None
    return (sub * RATE).quantize(Decimal("1"), rounding=ROUND_HALF_UP)


def replay_orders(events):
    """events: dicts with order_id, seq, kind, status_arg, payment, price, qty, ts."""
    orders, rejected = {}, []
    for e in sorted(events, key=lambda e: (e["order_id"], e["seq"])):
        oid, kind = e["order_id"], e["kind"]
        o = orders.get(oid)
        line = (Decimal(e["price"]), e["qty"])
        if kind == "create":
            orders[oid] = o = {"status": "open", "payment": None, "closed_at": None, "created_at": e["ts"],
                               "lines": [line], "sub": line[0] * line[1], "from_replace": False}
        elif kind == "status":
            if o is None:
                continue
            o["status"] = e["status_arg"]
            o["payment"] = e["payment"] if e["payment"] is not None else o["payment"]
            if e["status_arg"] == "closed":
                o["closed_at"] = e["ts"]
        elif kind == "void":
            if o is None:
                continue
            o["status"], o["closed_at"] = "void", e["ts"]
        elif kind in ("add", "replace"):
            if o is None or o["status"] not in ACTIVE:
                rejected.append((oid, e["seq"], kind))
                continue
            if kind == "add":
                o["lines"].append(line)
                if o["status"] in ("preparing", "ready"):
                    o["status"] = "open"
            else:
                o["lines"] = [line]
            o["sub"] = sum((p * q for p, q in o["lines"]), Decimal(0))
    out = {}
    for oid, o in orders.items():
        sub = o["sub"]
        tax = _tax(sub)
        out[oid] = (o["status"], o["payment"], o["closed_at"], float(sub), float(tax), float(sub + tax),
                    len(o["lines"]))
    return out, sorted(rejected)


def replay_cart(events):
    """events: (seq, delta) of one (cart, item); returns (qty, line_since)."""
    qty, since = 0, None
    for seq, d in sorted(events):
        if d == 0:
            qty, since = 0, None
        elif d > 0:
            if qty == 0:
                since = seq
            qty += 1
        else:
            if qty == 0:
                continue
            qty -= 1
            if qty == 0:
                since = None
    return qty, since


def replay_debounce(times_us, gap_us):
    """Greedy: accept a ring when gap_us has passed since the last accepted one."""
    last, out = None, []
    for t in times_us:
        ok = last is None or t - last >= gap_us
        if ok:
            last = t
        out.append(ok)
    return out


def replay_rings(events):
    """events: (seq, kind) of one table; returns {ring seq: open count after it}."""
    open_rings, out = 0, {}
    for seq, kind in sorted(events):
        if kind == "ack":
            open_rings = 0
        else:
            open_rings += 1
            out[seq] = open_rings
    return out


def replay_order_lists(events, rates):
    """Orders from events with item lists: dicts with order_id, seq, kind, restaurant_id, status_arg, payment, items, ts.

    Items are (menu_item_id, name, price, qty); ``rates`` maps tenants to
    tax rates.  Returns ({order: figures}, {order: current lines}, rejected events).
    """
    orders, rejected = {}, []
    for e in sorted(events, key=lambda e: (e["order_id"], e["seq"])):
        oid, kind, o = e["order_id"], e["kind"], orders.get(e["order_id"])
        lines = [(e["seq"], i, *x) for i, x in enumerate(e["items"] or [])] if kind in ("create", "add", "replace") else []
        faulty = any(x[3] is None or x[4] is None or x[5] is None for x in lines)
        if kind in ("add", "replace") and (o is None or o["status"] not in ACTIVE):
            rejected.append((oid, e["seq"], "closed"))
            continue
        if faulty:
            rejected.append((oid, e["seq"], "null"))
            continue
        if kind == "create":
            first = o["created_at"] if o else e["ts"]
            orders[oid] = o = {"status": "open", "payment": o and o["payment"], "closed_at": o and o["closed_at"],
                               "created_at": min(first, e["ts"]), "lines": lines, "zero": False,
                               "tenant": e["restaurant_id"]}
        elif o is None:
            continue
        elif kind == "status":
            o["status"] = e["status_arg"]
            o["payment"] = e["payment"] if e["payment"] is not None else o["payment"]
            o["closed_at"] = e["ts"] if e["status_arg"] == "closed" else o["closed_at"]
        elif kind == "void":
            o["status"], o["closed_at"] = "void", e["ts"]
        elif kind == "add":
            o["lines"], o["status"], o["zero"] = o["lines"] + lines, "open", False
        else:
            o["lines"], o["zero"] = lines, True
    out = {}
    for oid, o in orders.items():
        sub = sum((x[4] * x[5] for x in o["lines"]), Decimal(0)) if o["lines"] or o["zero"] else None
        rate = rates.get(o["tenant"])
        tax = None if sub is None or rate is None else (sub * rate).quantize(Decimal("1"), rounding=ROUND_HALF_UP)
        out[oid] = (o["status"], o["payment"], o["closed_at"], sub, tax, None if tax is None else sub + tax,
                    len(o["lines"]))
    return out, {oid: o["lines"] for oid, o in orders.items()}, sorted(rejected)
