"""DuckDB oracle texts for the correctness gate.

Each query is plain SQL over the driver's tables.  The fixture views
below are fixed texts (they define the shop model on top of the driver
tables) and are put in front of a query as CTEs.
"""

from __future__ import annotations

import re

from tavolo.sources.fixtures import DIRTY

# The fixture view definitions, in creation order.
FIXTURE_SQL = {
    "s_restaurants": "select n_nationkey as restaurant_id, n_name as name, lower(n_name) as slug, 'PKR' as currency, cast(case n_nationkey % 4 when 1 then 0.16 when 2 then 0 when 3 then 0.0825 else 0.05 end as decimal(9,6)) as tax_rate, case when n_nationkey % 3 = 0 then null else concat('+92 300-', cast(1000000 + n_nationkey as string)) end as whatsapp_number from nation",
    "s_tables": "select n_nationkey * 8 + k as table_id, n_nationkey as restaurant_id, concat('Table ', cast(k + 1 as string)) as label, concat('n', cast(n_nationkey as string), '-t', cast(k + 1 as string)) as qr_token from nation cross join (values (0),(1),(2),(3),(4),(5),(6),(7)) v(k)",
    "s_categories": "select distinct concat(cast(p_partkey % 25 as string), '-', p_type, '-', cast(case when length(p_type) % 2 = 0 then p_size % 2 else 0 end as string)) as category_id, p_partkey % 25 as restaurant_id, p_type as name, length(p_type) as sort_order from part",
    "s_menu_items": "select p_partkey as menu_item_id, p_partkey % 25 as restaurant_id, case when p_size = 50 then null when p_size = 49 then concat(cast((p_partkey + 1) % 25 as string), '-', p_type, '-', cast(case when length(p_type) % 2 = 0 then p_size % 2 else 0 end as string)) else concat(cast(p_partkey % 25 as string), '-', p_type, '-', cast(case when length(p_type) % 2 = 0 then p_size % 2 else 0 end as string)) end as category_id, p_name as name, cast(p_retailprice as decimal(18,4)) as price, p_size % 5 <> 0 as is_available, p_size as sort_order from part",
    "s_customers": "select c_custkey as customer_id, c_nationkey as restaurant_id, cast(5550000 + c_custkey as string) as phone from customer",
    "s_orders": "select o_orderkey as order_id, c_nationkey as restaurant_id, case when o_orderkey % 9 = 0 then null else c_nationkey * 8 + o_orderkey % 8 end as table_id, case when o_orderpriority in ('1-URGENT','2-HIGH') then 'qr' when o_orderpriority = '3-MEDIUM' then 'whatsapp' else 'pos' end as source, case when o_orderkey % 50 = 0 then 'void' when o_orderstatus = 'F' then 'closed' when o_orderstatus = 'O' then 'open' when o_orderkey % 2 = 0 then 'ready' else 'preparing' end as status, case when o_orderkey % 101 = 0 then null else cast(o_totalprice as decimal(18,4)) end as total, case when o_orderkey % 101 <> 0 then cast(cast(o_totalprice as decimal(18,4)) - cast(floor(o_totalprice / 20) as decimal(18,4)) as decimal(18,4)) end as subtotal, case when o_orderkey % 101 <> 0 then cast(floor(o_totalprice / 20) as decimal(18,4)) end as tax, o_custkey as customer_id, o_orderkey % 10 as staff_id, case when o_orderkey % 13 = 0 then 'delivery' end as given_order_type, o_orderdate as created_at from orders join customer on c_custkey = o_custkey",
    "s_order_items": "select l_orderkey as order_id, l_linenumber as line_no, l_partkey as menu_item_id, p_name as name_snapshot, cast(p_retailprice as decimal(18,4)) as price_snapshot, cast(l_quantity as int) as qty from lineitem join part on p_partkey = l_partkey",
    "s_order_events": "select cast(floor(event_id / 10) as bigint) as order_id, cast(event_id % 10 as int) as seq, case when event_id % 10 = 0 then 'create' when event_type in ('signup','purchase') then 'status' when event_type = 'view' then 'add' when event_type = 'click' then 'replace' else 'void' end as kind, case when event_id % 10 = 0 then cast(floor(event_id / 10) % 25 as int) end as restaurant_id, case when event_id % 10 = 0 then null when event_type = 'signup' then 'preparing' when event_type = 'purchase' then 'closed' end as status_arg, case when event_id % 10 <> 0 and event_type = 'purchase' and event_id % 3 <> 0 then case when event_id % 3 = 1 then 'cash' else 'card' end end as payment, event_id, value, ts from events",
    "s_event_lines": "select order_id, seq, cast(k as int) as idx, (event_id * 3 + k * 11) % 400 as menu_item_id, case when not (event_id % 67 = 7 and k = 1) then concat('Dish ', cast((event_id * 3 + k * 11) % 400 % 64 as string)) end as name, case when not (event_id % 61 = 5 and k = 0) then cast(cast(value as decimal(18,4)) + k as decimal(18,4)) end as price, cast(1 + (event_id + k) % 5 as int) as qty from s_order_events, range(0, 3) r(k) where kind in ('create', 'add', 'replace') and k < (event_id * 7 + cast(floor(event_id / 10) as bigint)) % 4",
    "s_calls": "select event_id as call_id, cast(user_id % 25 as int) as restaurant_id, (user_id % 25) * 8 + user_id % 8 as table_id, ts as created_at, event_id % 8 <> 0 as acknowledged, case when event_id % 8 <> 0 then user_id % 10 end as acknowledged_by from events where event_type in ('view','click','error')",
    "s_ring_log": "select event_id as seq, (user_id % 25) * 8 + user_id % 8 as table_id, case when event_type = 'purchase' then 'ack' else 'ring' end as kind, user_id % 10 as staff_id, ts from events where event_type in ('view','click','purchase')",
    "s_feedback": "select l.doc_id as order_id, cast(1 + 3 * l.quality + (1 - l.toxic) as int) as rating, d.source as comment from labels l join documents d on d.doc_id = l.doc_id",
    "s_feedback_events": "select conv_id * 200 as order_id, turn as seq, cast(length(text) % 7 as int) as rating, text as comment from conversations where role = 'user'",
    "s_cart_events": "select user_id as cart_id, event_id % 20 as item_id, event_id as seq, case when event_type = 'error' then -1 when event_type = 'purchase' then 0 else 1 end as delta from events",
    "s_avail_events": "select event_id % 400 as menu_item_id, event_id as seq, event_type <> 'error' as is_available from events",
    "s_setting_events": "select cast(user_id % 25 as int) as restaurant_id, event_id as seq, case when event_id % 4 = 0 then '  ' else concat(' 92', cast(event_id as string)) end as whatsapp_number from events where event_type = 'signup'",
    "s_staff": "select s_suppkey as staff_id, s_nationkey as restaurant_id, s_name as name, case cast(s_suppkey % 7 as int) when 0 then 'owner' when 1 then 'manager' when 2 then 'cashier' when 3 then 'waiter' when 4 then 'headwaiter' when 5 then 'kitchen' else 'chef' end as role, timestamp '2020-01-01' + to_days(cast(s_suppkey * 7919 % 37 as int)) as created_at from supplier",
    "s_scans": "select event_id as scan_id, case when event_id % 11 = 0 then 'nope' else concat('n', cast(user_id % 25 as string), '-t', cast(1 + user_id % 8 as string)) end as qr_token, cast(user_id % 25 as int) as restaurant_id, ts from events where event_type = 'view'",
    "s_requests_flat": "select o.order_id, o.restaurant_id, case when o.customer_id % 10 = 0 then '  ' else cast(5550000 + o.customer_id as string) end as phone, o.order_id % 2 = 0 as opt_in, o.created_at, i.line_no, i.menu_item_id, i.name_snapshot, i.price_snapshot, i.qty from s_orders o left join s_order_items i on i.order_id = o.order_id",
}

_REJECT = """case order_id % 211 when 1 then 'items is not a JSON array' when 2 then 'items is not a JSON array'
  when 11 then 'unknown restaurant' when 12 then 'unknown table' when 13 then 'unknown staff'
  else case when n_lines > 0 then case order_id % 211 when 3 then 'bad qty' when 4 then 'bad price'
    when 5 then 'price does not fit' when 6 then 'missing name' when 7 then 'missing price' when 8 then 'missing qty'
    when 9 then 'bad menu_item_id' when 10 then 'unknown menu item' end end end"""
FIXTURE_SQL["s_request_headers"] = f"""select r.order_id, case when r.order_id % 211 = 11 then 99 else r.restaurant_id end as restaurant_id,
  case when r.order_id % 211 = 12 then 100000 else o.table_id end as table_id, o.source,
  case when r.order_id % 211 = 13 then 1000000 when r.order_id % 3 <> 0 then r.order_id % 10 end as staff_id,
  r.phone, r.opt_in, r.created_at, r.reason
from (select *, {_REJECT} as reason from (
  select order_id, restaurant_id, phone, opt_in, created_at, count(menu_item_id) as n_lines from s_requests_flat group by all) g) r
join s_orders o on o.order_id = r.order_id"""
# the same tables with planted violations
for _name, _columns in DIRTY.items():
    FIXTURE_SQL[f"dirty_{_name}"] = f"select * replace ({', '.join(f'{e} as {c}' for c, e in _columns.items())}) from s_{_name}"

_ORDER = list(FIXTURE_SQL)


def with_fixtures(sql: str) -> str:
    """Prefix ``sql`` with the fixture CTEs it (transitively) uses."""
    need: set[str] = set()

    def visit(text: str):
        for name in _ORDER:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                visit(FIXTURE_SQL[name])

    visit(sql)
    if not need:
        return sql
    ctes = ",\n".join(f"{n} as ({FIXTURE_SQL[n]})" for n in _ORDER if n in need)
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
