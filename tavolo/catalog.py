"""Registered queries: name -> (spark, sf_dir) -> DataFrame, plus oracle SQL.

Every query reads the driver tables of ``sf_dir`` (through the shop
model in ``tavolo.sources.fixtures``) and runs over whole tables.
Money leaves as double and nested item lists as text so that the
DuckDB oracle can compare like with like.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tavolo.operators import sales
from tavolo.operators.common import items_text
from tavolo.sources.tables import Tables

# Parameters of the fixture set.
SINCE = "2000-01-01"
SINCE_LATE = "2001-07-25"
AS_OF = "2001-08-02"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def shop(spark: SparkSession, sf_dir: str):
    return Tables(spark, sf_dir).shop


def dbl(*names):
    return [F.col(n).cast("double").alias(n) for n in names]


# ---------------------------------------------------------------- sales
@query("top_items", """
select restaurant_id, name, qty, rank from (
  select restaurant_id, name, qty, cast(row_number() over (partition by restaurant_id order by qty desc, name) as int) as rank
  from (select o.restaurant_id, i.name_snapshot as name, cast(sum(i.qty) as bigint) as qty
        from s_order_items i join s_orders o on o.order_id = i.order_id
        where o.status = 'closed' and o.created_at >= timestamp '2000-01-01'
        group by o.restaurant_id, i.name_snapshot) g) r
where rank <= 5""")
def q_top_items(spark, sf_dir):
    s = shop(spark, sf_dir)
    return sales.top_items(s.orders, s.order_items, SINCE)


_SUMMARY_SQL = """
select r.restaurant_id, cast(coalesce(a.s, 0) as double) as total_sales,
       cast(coalesce(a.n, 0) as int) as order_count,
       coalesce(case when a.n_total > 0 then cast(a.s as double) / a.n_total end, 0.0) as avg_order
from s_restaurants r left join (
  select restaurant_id, cast(sum(total) as decimal(18,4)) as s, count(*) as n, count(total) as n_total
  from s_orders where status = 'closed' and created_at >= timestamp '{since}' group by restaurant_id) a
on a.restaurant_id = r.restaurant_id"""


@query("sales_summary", _SUMMARY_SQL.format(since=SINCE))
def q_sales_summary(spark, sf_dir):
    s = shop(spark, sf_dir)
    return sales.sales_summary(s.orders, s.restaurants, SINCE).withColumn(
        "total_sales", F.col("total_sales").cast("double"))


@query("sales_summary_late", _SUMMARY_SQL.format(since=SINCE_LATE))
def q_sales_summary_late(spark, sf_dir):
    s = shop(spark, sf_dir)
    return sales.sales_summary(s.orders, s.restaurants, SINCE_LATE).withColumn(
        "total_sales", F.col("total_sales").cast("double"))


@query("best_seller", """
select r.restaurant_id, coalesce(t.name, '—') as best_seller
from s_restaurants r left join (
  select restaurant_id, name from (
    select restaurant_id, name, row_number() over (partition by restaurant_id order by qty desc, name) as rk
    from (select o.restaurant_id, i.name_snapshot as name, sum(i.qty) as qty
          from s_order_items i join s_orders o on o.order_id = i.order_id
          where o.status = 'closed' and o.created_at >= timestamp '2000-01-01'
          group by o.restaurant_id, i.name_snapshot) g) x where rk = 1) t
on t.restaurant_id = r.restaurant_id""")
def q_best_seller(spark, sf_dir):
    s = shop(spark, sf_dir)
    return sales.best_seller(s.orders, s.order_items, s.restaurants, SINCE)


@query("source_split", """
select restaurant_id, source, count(*) as order_count from s_orders
where status = 'closed' and created_at >= timestamp '2000-01-01' group by restaurant_id, source""")
def q_source_split(spark, sf_dir):
    s = shop(spark, sf_dir)
    return sales.source_split(s.orders, SINCE)


@query("source_split_filled", """
select r.restaurant_id, coalesce(a.pos, 0) as pos_orders, coalesce(a.qr, 0) as qr_orders
from s_restaurants r left join (
  select restaurant_id, count(*) filter (where source = 'pos') as pos, count(*) filter (where source = 'qr') as qr
  from s_orders where status = 'closed' and created_at >= timestamp '2000-01-01' group by restaurant_id) a
on a.restaurant_id = r.restaurant_id""")
def q_source_split_filled(spark, sf_dir):
    s = shop(spark, sf_dir)
    return sales.source_split_filled(s.orders, s.restaurants, SINCE)


@query("recent_orders", """
with ranked as (
  select * from (
    select order_id, restaurant_id, table_id, source, total, created_at,
           cast(row_number() over (partition by restaurant_id order by created_at desc, order_id desc) as int) as rank
    from s_orders where status = 'closed' and created_at >= timestamp '2000-01-01') x where rank <= 8),
lines as (
  select i.order_id, string_agg(cast(i.qty as varchar) || 'x ' || i.name_snapshot, ', '
           order by i.line_no, i.menu_item_id, i.name_snapshot, i.price_snapshot, i.qty) as items
  from s_order_items i join ranked r on r.order_id = i.order_id group by i.order_id)
select r.restaurant_id, r.rank, r.order_id, r.source, cast(r.total as double) as total, r.created_at,
       t.label as table_label, l.items, f.rating, f.comment,
       case when f.rating > 0 then repeat('★', f.rating) || repeat('☆', greatest(5 - f.rating, 0)) end as stars
from ranked r left join s_tables t on t.table_id = r.table_id
left join lines l on l.order_id = r.order_id left join s_feedback f on f.order_id = r.order_id""")
def q_recent_orders(spark, sf_dir):
    s = shop(spark, sf_dir)
    df = sales.recent_orders(s.orders, s.tables, s.order_items, s.feedback, SINCE)
    return df.withColumn("total", F.col("total").cast("double")).withColumn("items", items_text(F.col("items")))


@query("sales_by_period", """
with p(days) as (values (1), (7), (30)),
o as (select * from s_orders where status = 'closed'),
summ as (
  select r.restaurant_id, p.days, cast(sum(o.total) as decimal(18,4)) as s, count(o.order_id) as n,
         count(o.total) as n_total, count(o.order_id) filter (where o.source = 'pos') as pos,
         count(o.order_id) filter (where o.source = 'qr') as qr
  from s_restaurants r cross join p
  left join o on o.restaurant_id = r.restaurant_id and o.created_at >= timestamp '2001-08-02' - p.days * interval 1 day
  group by r.restaurant_id, p.days),
itm as (
  select o.restaurant_id, p.days, i.name_snapshot, sum(i.qty) as q
  from o join s_order_items i on i.order_id = o.order_id cross join p
  where o.created_at >= timestamp '2001-08-02' - p.days * interval 1 day
  group by o.restaurant_id, p.days, i.name_snapshot),
best as (
  select restaurant_id, days, name_snapshot from (
    select *, row_number() over (partition by restaurant_id, days order by q desc, name_snapshot) as rk from itm) x
  where rk = 1)
select s.restaurant_id, s.days, cast(coalesce(s.s, 0) as double) as total_sales, cast(s.n as int) as order_count,
       coalesce(case when s.n_total > 0 then cast(s.s as double) / s.n_total end, 0.0) as avg_order,
       s.pos as pos_orders, s.qr as qr_orders, coalesce(b.name_snapshot, '—') as best_seller
from summ s left join best b on b.restaurant_id = s.restaurant_id and b.days = s.days""")
def q_sales_by_period(spark, sf_dir):
    s = shop(spark, sf_dir)
    return sales.sales_by_period(s.orders, s.order_items, s.restaurants, AS_OF).withColumn(
        "total_sales", F.col("total_sales").cast("double"))


@query("period_top_items", """
with p(days) as (values (1), (7), (30))
select restaurant_id, days, rank, name, qty from (
  select *, cast(row_number() over (partition by restaurant_id, days order by qty desc, name) as int) as rank from (
    select o.restaurant_id, p.days, i.name_snapshot as name, cast(sum(i.qty) as bigint) as qty
    from s_orders o join s_order_items i on i.order_id = o.order_id cross join p
    where o.status = 'closed' and o.created_at >= timestamp '2001-08-02' - p.days * interval 1 day
    group by o.restaurant_id, p.days, i.name_snapshot) g) r where rank <= 5""")
def q_period_top_items(spark, sf_dir):
    s = shop(spark, sf_dir)
    return sales.period_panels(s.orders, s.order_items, s.restaurants, AS_OF).top_items


@query("period_recent_orders", """
with p(days) as (values (1), (7), (30)),
ranked as (
  select * from (
    select o.*, p.days, cast(row_number() over (partition by restaurant_id, days order by created_at desc, order_id desc) as int) as rank
    from s_orders o cross join p
    where status = 'closed' and created_at >= timestamp '2001-08-02' - p.days * interval 1 day) x where rank <= 8),
lines as (
  select order_id, string_agg(cast(qty as varchar) || 'x ' || name_snapshot, ', '
           order by line_no, menu_item_id, name_snapshot, price_snapshot, qty) as items
  from s_order_items group by order_id)
select r.restaurant_id, r.days, r.rank, r.order_id, r.source, cast(r.total as double) as total, r.created_at,
       t.label as table_label, l.items, f.rating, f.comment,
       case when f.rating > 0 then repeat('★', f.rating) || repeat('☆', greatest(5 - f.rating, 0)) end as stars
from ranked r left join s_tables t on t.table_id = r.table_id
left join lines l on l.order_id = r.order_id left join s_feedback f on f.order_id = r.order_id""")
def q_period_recent_orders(spark, sf_dir):
    s = shop(spark, sf_dir)
    df = sales.period_panels(s.orders, s.order_items, s.restaurants, AS_OF, s.tables, s.feedback).recent_orders
    return df.withColumn("total", F.col("total").cast("double")).withColumn("items", items_text(F.col("items"))).select(
        "restaurant_id", "days", "rank", "order_id", "source", "total", "created_at", "table_label", "items", "rating",
        "comment", "stars")


# ---------------------------------------------------------------- ingest
from tavolo.operators import ingest  # noqa: E402


_ACCEPTED_LINES = """(select f.* from s_requests_flat f join s_request_headers h on h.order_id = f.order_id
  where h.reason is null)"""


def _request_args(s):
    return s.requests, s.restaurants, s.menu_items, s.tables, s.staff


@query("parse_order_requests", f"""
select order_id, restaurant_id, menu_item_id, name_snapshot as name, cast(price_snapshot as double) as price, qty
from {_ACCEPTED_LINES} f where menu_item_id is not null""")
def q_parse_order_requests(spark, sf_dir):
    df = ingest.parse_order_requests(*_request_args(shop(spark, sf_dir)))
    return df.select("order_id", "restaurant_id", "menu_item_id", "name",
                     F.col("price").cast("double").alias("price"), "qty")


@query("rejected_requests", "select order_id, restaurant_id, reason from s_request_headers where reason is not null")
def q_rejected_requests(spark, sf_dir):
    return ingest.rejected_requests(*_request_args(shop(spark, sf_dir)))


@query("order_items_snapshot", f"""
select order_id, menu_item_id, name_snapshot, cast(price_snapshot as double) as price_snapshot, qty,
       cast(cast(price_snapshot * qty as decimal(18,4)) as double) as line_total
from {_ACCEPTED_LINES} f where menu_item_id is not null""")
def q_order_items_snapshot(spark, sf_dir):
    lines = ingest.parse_order_requests(*_request_args(shop(spark, sf_dir)))
    return ingest.order_items_snapshot(lines).select(
        "order_id", "menu_item_id", "name_snapshot", *dbl("price_snapshot"), "qty", *dbl("line_total"))


_TOTALS_SQL = f"""
t as (
  select order_id, restaurant_id, cast(sum(price_snapshot * qty) as decimal(18,4)) as subtotal,
         count(menu_item_id) as n_lines
  from {_ACCEPTED_LINES} f group by order_id, restaurant_id),
x as (select t.*, cast(round(t.subtotal * r.tax_rate, 0) as decimal(18,4)) as tax
      from t left join s_restaurants r on r.restaurant_id = t.restaurant_id)"""


@query("order_totals", f"""
with {_TOTALS_SQL}
select order_id, restaurant_id, cast(subtotal as double) as subtotal, cast(tax as double) as tax,
       cast(cast(subtotal + tax as decimal(18,4)) as double) as total from x""")
def q_order_totals(spark, sf_dir):
    s = shop(spark, sf_dir)
    lines = ingest.parse_request_lines(*_request_args(s))
    return ingest.order_totals(lines, s.restaurants).select(
        "order_id", "restaurant_id", *dbl("subtotal", "tax", "total"))


@query("order_headers", f"""
with {_TOTALS_SQL}
select h.order_id, h.restaurant_id, h.table_id, 'dine-in' as order_type, h.source, 'open' as status,
       case when length(trim(h.phone)) > 0 then sha256(concat_ws('|', cast(h.restaurant_id as varchar), h.phone)) end as customer_id,
       cast(x.subtotal as double) as subtotal, cast(x.tax as double) as tax,
       cast(cast(x.subtotal + x.tax as decimal(18,4)) as double) as total, h.staff_id, h.created_at, x.n_lines
from s_request_headers h join x on x.order_id = h.order_id where h.reason is null""")
def q_order_headers(spark, sf_dir):
    s = shop(spark, sf_dir)
    return _money_out(ingest.order_headers(ingest.parse_request_lines(*_request_args(s)), s.restaurants),
                      "subtotal", "tax", "total")


_REQ_HEADERS = """(select distinct order_id, restaurant_id, phone, opt_in, created_at from s_requests_flat)"""

_CUSTOMERS_SQL = f"""
select sha256(concat_ws('|', cast(restaurant_id as varchar), phone)) as customer_id, restaurant_id, phone,
       min(created_at) as created_at,
       arg_max(opt_in, created_at::varchar || lpad(cast(order_id as varchar), 20, '0')) as marketing_opt_in,
       count(*) as n_requests
from {_REQ_HEADERS} h where length(trim(phone)) > 0 group by restaurant_id, phone"""


@query("customer_upsert", _CUSTOMERS_SQL)
def q_customer_upsert(spark, sf_dir):
    s = shop(spark, sf_dir)
    return ingest.customer_upsert(s.request_headers)


@query("order_customer_link", f"""
select order_id, case when length(trim(phone)) > 0
  then sha256(concat_ws('|', cast(restaurant_id as varchar), phone)) end as customer_id
from {_REQ_HEADERS} h""")
def q_order_customer_link(spark, sf_dir):
    s = shop(spark, sf_dir)
    return ingest.order_customer_link(s.request_headers)


@query("derive_order_type", """
select order_id, table_id, coalesce(given_order_type, case when table_id is null then 'takeaway' else 'dine-in' end) as order_type
from s_orders""")
def q_derive_order_type(spark, sf_dir):
    return ingest.derive_order_type(shop(spark, sf_dir).orders)


@query("backfill_order_type", """
select order_id, table_id, coalesce(given_order_type, 'dine-in') as order_type_before,
  case when table_id is null and coalesce(given_order_type, 'dine-in') = 'dine-in' then 'takeaway'
       else coalesce(given_order_type, 'dine-in') end as order_type
from s_orders""")
def q_backfill_order_type(spark, sf_dir):
    return ingest.backfill_order_type(shop(spark, sf_dir).orders)


# ---------------------------------------------------------------- order folds
from tavolo.operators import orders as folds  # noqa: E402

_EVENTS = """
with lists as (
  select order_id, seq, count(*) as n, sum(price * qty) as total,
         bool_or(name is null or price is null or qty is null) as faulty,
         min(case when name is null then 'name_snapshot' when price is null then 'price_snapshot'
                  when qty is null then 'qty' end) filter (where idx = bad_idx) as fault
  from (select *, min(case when name is null or price is null or qty is null then idx end)
                  over (partition by order_id, seq) as bad_idx from s_event_lines) x
  group by order_id, seq),
e as (
  select v.*, coalesce(l.n, 0) as n, l.total, coalesce(l.faulty, false) as faulty, l.fault,
         kind = 'create' and not coalesce(l.faulty, false) as created,
         case when kind = 'create' and not coalesce(l.faulty, false) then 'open' when kind = 'status' then status_arg
              when kind = 'void' then 'void' end as effect
  from s_order_events v left join lists l on l.order_id = v.order_id and l.seq = v.seq),
a as (
  select *, case when bool_or(created) over w then last_value(effect ignore nulls) over w end as prior
  from e window w as (partition by order_id order by seq rows between unbounded preceding and 1 preceding)),
b as (
  select *, case when kind = 'create' then not faulty
                 when kind in ('add', 'replace') then not faulty and coalesce(prior in ('open', 'preparing', 'ready'), false)
                 else prior is not null end as valid from a)"""

_FOLD = _EVENTS + """,
c as (
  select *, case when kind = 'add' and valid then 'open' when kind in ('add', 'replace') then null
                 when valid then effect end as status_after,
         max(case when kind in ('create', 'replace') and valid then seq end) over (partition by order_id) as base_seq
  from b),
d as (select *, kind in ('create', 'replace', 'add') and valid and seq >= base_seq as is_line from c),
f as (
  select order_id,
    arg_max(status_after, seq) filter (where status_after is not null) as status,
    arg_max(payment, seq) filter (where valid and payment is not null) as payment_method,
    arg_max(ts, seq) filter (where valid and (kind = 'void' or (kind = 'status' and status_arg = 'closed'))) as closed_at,
    min(ts) filter (where kind = 'create' and valid) as created_at,
    max(restaurant_id) filter (where kind = 'create' and valid) as restaurant_id,
    cast(sum(total) filter (where is_line) as decimal(18,4)) as sub0,
    cast(coalesce(sum(n) filter (where is_line), 0) as bigint) as n_lines,
    arg_max(kind, seq) filter (where is_line) as last_edit,
    max(base_seq) as base_seq,
    count(*) filter (where kind = 'add' and valid) as n_adds,
    count(*) filter (where kind = 'replace' and valid) as n_replaces,
    max(seq) as last_seq
  from d group by order_id),
g as (select f.*, r.tax_rate, case when last_edit = 'replace' then coalesce(sub0, 0) else sub0 end as subtotal
      from f left join s_restaurants r on r.restaurant_id = f.restaurant_id where created_at is not null),
fold as (
  select *, cast(round(cast(subtotal as decimal(18,4)) * tax_rate, 0) as decimal(18,4)) as tax
  from g)
"""


def _fold_sql(select: str) -> str:
    return _FOLD + select


def _money_out(df, *names):
    return df.select(*[F.col(c).cast("double").alias(c) if c in names else F.col(c) for c in df.columns])


def _fold(operator, spark, sf_dir):
    s = shop(spark, sf_dir)
    return operator(s.order_events, restaurants=s.restaurants)


@query("order_state", _fold_sql("""
select order_id, status, payment_method, created_at, closed_at, cast(subtotal as double) as subtotal,
       cast(tax as double) as tax, cast(cast(subtotal + tax as decimal(18,4)) as double) as total, n_lines, last_seq
from fold"""))
def q_order_state(spark, sf_dir):
    return _money_out(_fold(folds.order_state, spark, sf_dir), "subtotal", "tax", "total")


@query("order_status_fold", _fold_sql("select order_id, status, payment_method, closed_at from fold"))
def q_order_status_fold(spark, sf_dir):
    return folds.order_status_fold(shop(spark, sf_dir).order_events)


@query("void_fold", _fold_sql("""
select order_id, closed_at, cast(subtotal as double) as subtotal,
       cast(cast(subtotal + tax as decimal(18,4)) as double) as total, n_lines
from fold where status = 'void'"""))
def q_void_fold(spark, sf_dir):
    return _money_out(_fold(folds.void_fold, spark, sf_dir), "subtotal", "total")


@query("addon_fold", _fold_sql("""
select order_id, n_adds, status, n_lines, cast(subtotal as double) as subtotal, cast(tax as double) as tax,
       cast(cast(subtotal + tax as decimal(18,4)) as double) as total
from fold where n_adds > 0"""))
def q_addon_fold(spark, sf_dir):
    return _money_out(_fold(folds.addon_fold, spark, sf_dir), "subtotal", "tax", "total")


@query("replace_items_fold", _fold_sql("""
select order_id, n_replaces, base_seq, n_lines, cast(subtotal as double) as subtotal, cast(tax as double) as tax,
       cast(cast(subtotal + tax as decimal(18,4)) as double) as total
from fold where n_replaces > 0"""))
def q_replace_items_fold(spark, sf_dir):
    return _money_out(_fold(folds.replace_items_fold, spark, sf_dir), "subtotal", "tax", "total")


@query("current_order_lines", _fold_sql("""
select d.order_id, d.seq as line_seq, l.idx as line_idx, l.menu_item_id, l.name, cast(l.price as double) as price, l.qty
from d join s_event_lines l on l.order_id = d.order_id and l.seq = d.seq where d.is_line"""))
def q_current_order_lines(spark, sf_dir):
    return _money_out(folds.current_lines(shop(spark, sf_dir).order_events), "price")


@query("current_order_items", _fold_sql("""
select d.order_id, cast(count(*) as int) as n_items,
       string_agg(cast(l.qty as varchar) || 'x ' || l.name, ', ' order by d.seq, l.idx) as items
from d join s_event_lines l on l.order_id = d.order_id and l.seq = d.seq where d.is_line group by d.order_id"""))
def q_current_order_items(spark, sf_dir):
    df = folds.current_items(shop(spark, sf_dir).order_events).where(F.size("items") > 0)
    text = F.array_join(F.transform("items", lambda x: F.concat(x["qty"].cast("string"), F.lit("x "), x["name"])), ", ")
    return df.select("order_id", F.size("items").alias("n_items"), text.alias("items"))


@query("rejected_order_events", _EVENTS + """
select order_id, seq, kind, prior as status_before,
  case when kind <> 'create' and not coalesce(prior in ('open', 'preparing', 'ready'), false)
       then case when kind = 'add' then 'This order is no longer open for additions'
                 else 'This order is no longer open for editing' end
       else 'null value in column "' || fault || '" violates not-null constraint' end as reason
from b where kind in ('create', 'add', 'replace') and not valid""")
def q_rejected_order_events(spark, sf_dir):
    return folds.rejected_order_events(shop(spark, sf_dir).order_events)


@query("availability_state", """
with l as (select menu_item_id, arg_max(is_available, seq) as toggled from s_avail_events group by menu_item_id)
select m.menu_item_id, m.restaurant_id, m.name, coalesce(l.toggled, m.is_available) as is_available,
       l.toggled is not null as toggled
from s_menu_items m left join l on l.menu_item_id = m.menu_item_id""")
def q_availability_state(spark, sf_dir):
    s = shop(spark, sf_dir)
    return folds.availability_state(s.menu_items, s.avail_events)


@query("settings_state", """
with l as (
  select restaurant_id, nullif(trim(whatsapp_number), '') as n,
         row_number() over (partition by restaurant_id order by seq desc) as rk
  from s_setting_events)
select r.restaurant_id, case when exists (select 1 from l where l.restaurant_id = r.restaurant_id)
         then (select n from l where l.restaurant_id = r.restaurant_id and rk = 1) else r.whatsapp_number end as whatsapp_number
from s_restaurants r""")
def q_settings_state(spark, sf_dir):
    s = shop(spark, sf_dir)
    return folds.settings_state(s.restaurants, s.setting_events)


# ---------------------------------------------------------------- operational reads
from tavolo.operators import reads  # noqa: E402

BASE_URL = "https://menu.example.org/"

_LINES_SQL = """
select order_id, string_agg(cast(qty as varchar) || 'x ' || name_snapshot || ' @ ' || cast(price_snapshot as varchar), ', '
         order by line_no, menu_item_id, name_snapshot, price_snapshot, qty) as items
from s_order_items group by order_id"""


def _customers(s):
    """Orders carrying the minted customer id, and the id -> phone dimension."""
    o = s.orders_with_phone
    minted = F.when(F.length(F.trim("phone")) > 0, ingest.customer_key(F.col("restaurant_id"), F.col("phone")))
    return o.withColumn("customer_id", minted).drop("phone", "opt_in"), ingest.customer_phones(o)


TENANT_SLUG = "nation_7"


@query("tenant_scan", f"""
select restaurant_id, name, slug, currency, cast(tax_rate as double) as tax_rate, whatsapp_number
from s_restaurants where slug = '{TENANT_SLUG}'""")
def q_tenant_scan(spark, sf_dir):
    return _money_out(reads.tenant_scan(shop(spark, sf_dir).restaurants, TENANT_SLUG), "tax_rate")


@query("open_orders", f"""
with lines as ({_LINES_SQL}),
ph as (select distinct order_id, case when length(trim(phone)) > 0 then phone end as customer_phone from s_requests_flat)
select o.restaurant_id, o.order_id, t.label as table_label, o.source, o.status, cast(o.total as double) as total,
       cast(o.subtotal as double) as subtotal, cast(o.tax as double) as tax, o.created_at, l.items, ph.customer_phone,
       cast(row_number() over (partition by o.restaurant_id order by o.created_at, o.order_id) as int) as position
from s_orders o left join s_tables t on t.table_id = o.table_id left join lines l on l.order_id = o.order_id
left join ph on ph.order_id = o.order_id
where o.status in ('open', 'preparing', 'ready')""")
def q_open_orders(spark, sf_dir):
    s = shop(spark, sf_dir)
    orders, cust = _customers(s)
    df = reads.open_orders(orders, s.tables, s.order_items, cust)
    return _money_out(df, "subtotal", "tax", "total").withColumn("items", items_text(F.col("items"), with_price=True))


@query("live_orders_digest", """
with lines as (
  select order_id, string_agg(cast(qty as varchar) || 'x ' || name_snapshot, ', '
           order by line_no, menu_item_id, name_snapshot, price_snapshot, qty) as items
  from s_order_items group by order_id)
select o.restaurant_id, o.order_id, o.created_at,
       concat_ws(' · ', coalesce(t.label, 'Takeaway'), case when o.source = 'qr' then 'QR order' else 'POS' end, o.status) as heading,
       coalesce(l.items, '') as items_text,
       r.currency || ' ' || format('{:,}', cast(floor(coalesce(cast(o.total as double), 0.0) + 0.5) as bigint)) as amount_text
from s_orders o left join s_tables t on t.table_id = o.table_id left join lines l on l.order_id = o.order_id
left join s_restaurants r on r.restaurant_id = o.restaurant_id
where o.status in ('open', 'preparing', 'ready')""")
def q_live_orders_digest(spark, sf_dir):
    s = shop(spark, sf_dir)
    return reads.live_orders_digest(s.orders, s.tables, s.order_items, s.restaurants)


@query("role_queue", """
with m(role, status) as (values ('kitchen', 'open'), ('kitchen', 'preparing'), ('cashier', 'ready'),
  ('headwaiter', 'open'), ('headwaiter', 'preparing'), ('headwaiter', 'ready'),
  ('manager', 'open'), ('manager', 'preparing'), ('manager', 'ready'),
  ('owner', 'open'), ('owner', 'preparing'), ('owner', 'ready'))
select m.role, o.restaurant_id, o.order_id, o.status, o.created_at from s_orders o join m on m.status = o.status""")
def q_role_queue(spark, sf_dir):
    return reads.role_queue(spark, shop(spark, sf_dir).orders)


@query("order_tracker", """
select o.order_id, o.status, t.label as table_label,
       case o.status when 'preparing' then 1 when 'ready' then 2 when 'closed' then 3 else 0 end as step
from s_orders o left join s_tables t on t.table_id = o.table_id""")
def q_order_tracker(spark, sf_dir):
    s = shop(spark, sf_dir)
    return reads.order_tracker(s.orders, s.tables)


_ACTIVE_PER_TABLE = """
select table_id, order_id, status, subtotal, tax, total, created_at from (
  select table_id, order_id, status, subtotal, tax, total, created_at,
         row_number() over (partition by table_id order by created_at desc, order_id desc) as rn
  from s_orders where status in ('open', 'preparing', 'ready') and table_id is not null) x where rn = 1"""


@query("active_order_per_table", f"""
with a as ({_ACTIVE_PER_TABLE}), lines as ({_LINES_SQL})
select a.table_id, a.order_id, a.status, cast(a.subtotal as double) as subtotal, cast(a.tax as double) as tax,
       cast(a.total as double) as total, a.created_at, l.items
from a left join lines l on l.order_id = a.order_id""")
def q_active_order_per_table(spark, sf_dir):
    s = shop(spark, sf_dir)
    df = reads.active_order_per_table(s.orders, s.order_items)
    return df.select("table_id", "order_id", "status", *dbl("subtotal", "tax", "total"),
                     "created_at", items_text(F.col("items"), with_price=True).alias("items"))


@query("table_by_token", """
select s.scan_id, s.restaurant_id, s.qr_token, t.table_id, t.label,
       case when t.table_id is null then 'takeaway' else 'dine-in' end as order_type
from s_scans s left join s_tables t on t.restaurant_id = s.restaurant_id and t.qr_token = s.qr_token""")
def q_table_by_token(spark, sf_dir):
    s = shop(spark, sf_dir)
    return reads.table_by_token(s.scans, s.tables)


@query("rescan_route", f"""
with a as ({_ACTIVE_PER_TABLE})
select s.scan_id, s.restaurant_id, t.table_id,
       case when t.table_id is null then 'takeaway' else 'dine-in' end as order_type,
       a.order_id as active_order_id, case when a.order_id is not null then 'resume' else 'menu' end as route
from s_scans s left join s_tables t on t.restaurant_id = s.restaurant_id and t.qr_token = s.qr_token
left join a on a.table_id = t.table_id""")
def q_rescan_route(spark, sf_dir):
    s = shop(spark, sf_dir)
    return reads.rescan_route(s.scans, s.tables, s.orders)


_MENU_SQL = """
with mi as (select * from s_menu_items where category_id is not null {filt}),
per as (
  select restaurant_id, category_id, count(*) as n_items,
         string_agg(name, ', ' order by sort_order, name, menu_item_id, price) as items_text
  from mi group by restaurant_id, category_id)
select c.restaurant_id, c.category_id, c.name as category, cast(c.sort_order as int) as sort_order,
       cast(row_number() over (partition by c.restaurant_id order by c.sort_order, c.name, c.category_id) as int) as position,
       coalesce(p.n_items, 0) as n_items, coalesce(p.items_text, '') as items_text
from s_categories c left join per p on p.restaurant_id = c.restaurant_id and p.category_id = c.category_id"""


def _menu_out(df):
    return df.select("restaurant_id", "category_id", "category", "sort_order", "position",
                     F.size("items").cast("bigint").alias("n_items"),
                     reads.menu_text(F.col("items")).alias("items_text"))


@query("menu_tree", _MENU_SQL.format(filt="and is_available"))
def q_menu_tree(spark, sf_dir):
    s = shop(spark, sf_dir)
    return _menu_out(reads.menu_tree(s.categories, s.menu_items, available_only=True))


@query("full_menu_tree", _MENU_SQL.format(filt=""))
def q_full_menu_tree(spark, sf_dir):
    s = shop(spark, sf_dir)
    return _menu_out(reads.menu_tree(s.categories, s.menu_items, available_only=False))


@query("table_list", """
select restaurant_id, table_id, label, qr_token,
       cast(row_number() over (partition by restaurant_id order by label, table_id) as int) as position
from s_tables""")
def q_table_list(spark, sf_dir):
    return reads.table_list(shop(spark, sf_dir).tables)


@query("table_links", f"""
select restaurant_id, table_id, regexp_replace(trim('{BASE_URL}'), '/$', '') || '/menu.html?t=' || qr_token as url
from s_tables""")
def q_table_links(spark, sf_dir):
    return reads.table_links(shop(spark, sf_dir).tables, BASE_URL)


@query("mint_table_tokens", """
select restaurant_id, table_id, label,
       substr(lower(regexp_replace(cast(restaurant_id as varchar), '-.*', '')) || '-' ||
              substr(sha256(concat_ws('|', 'table-token', cast(restaurant_id as varchar), cast(table_id as varchar))), 1, 32), 1, 20) as qr_token
from s_tables""")
def q_mint_table_tokens(spark, sf_dir):
    return reads.mint_table_tokens(shop(spark, sf_dir).tables, "table-token")


@query("staff_directory", """
select restaurant_id, staff_id, name, role, created_at,
       cast(row_number() over (partition by restaurant_id order by created_at, staff_id) as int) as position
from s_staff""")
def q_staff_directory(spark, sf_dir):
    return reads.staff_directory(shop(spark, sf_dir).staff)


@query("order_feedback", """
select order_id, rating, comment from s_feedback""")
def q_order_feedback(spark, sf_dir):
    s = shop(spark, sf_dir)
    return reads.order_feedback(s.feedback)


# ---------------------------------------------------------------- calls
from tavolo.operators import calls as calls_ops  # noqa: E402

_OPEN_COUNTS = """
e0 as (select *, sum(case when kind = 'ring' then 1 else 0 end) over (partition by table_id order by seq
          rows between unbounded preceding and current row) as r from s_ring_log),
e1 as (select *, last_value(case when kind = 'ack' then r end ignore nulls) over (partition by table_id order by seq
          rows between unbounded preceding and current row) as ra from e0),
ev as (select seq, table_id, kind, staff_id, ts, cast(r - coalesce(ra, 0) as bigint) as open_count from e1)"""


@query("ring_counts", f"with {_OPEN_COUNTS} select seq, table_id, ts, open_count from ev where kind = 'ring'")
def q_ring_counts(spark, sf_dir):
    return calls_ops.ring_counts(shop(spark, sf_dir).ring_log)


@query("acknowledge_fold", """
with n as (
  select *, first_value(case when kind = 'ack' then seq end ignore nulls) over (partition by table_id order by seq
           rows between 1 following and unbounded following) as ack_seq from s_ring_log)
select n.seq, n.table_id, n.ack_seq is not null as acknowledged, a.staff_id as acknowledged_by, n.ack_seq,
       a.ts as acknowledged_at
from n left join s_ring_log a on a.seq = n.ack_seq where n.kind = 'ring'""")
def q_acknowledge_fold(spark, sf_dir):
    return calls_ops.acknowledge_fold(shop(spark, sf_dir).ring_log)


_ACTIVE_CALLS = """
select c.restaurant_id, c.table_id, t.label as table_label, count(*) as call_count, min(c.created_at) as first_called_at,
       count(*) > 5 as urgent{pos}
from s_calls c left join s_tables t on t.table_id = c.table_id
where not c.acknowledged group by c.restaurant_id, c.table_id, t.label"""


@query("active_calls", _ACTIVE_CALLS.format(
    pos=", cast(row_number() over (partition by c.restaurant_id order by min(c.created_at), c.table_id) as int) as position"))
def q_active_calls(spark, sf_dir):
    s = shop(spark, sf_dir)
    return calls_ops.active_calls(s.calls, s.tables)


@query("urgent_escalations", _ACTIVE_CALLS.format(pos="") + " having count(*) > 5")
def q_urgent_escalations(spark, sf_dir):
    s = shop(spark, sf_dir)
    return calls_ops.urgent_escalations(s.calls, s.tables)


@query("newly_ringing", f"""
with {_OPEN_COUNTS},
p as (select *, make_timestamp(cast((floor(epoch_us(ts) / 3600000000) + 1) * 3600000000 as bigint)) as poll_at from ev),
q as (select table_id, poll_at, open_count as call_count from (
        select *, row_number() over (partition by table_id, poll_at order by ts desc, seq desc) as rk from p) x
      where rk = 1),
l as (select *, lag(call_count, 1, 0) over (partition by table_id order by poll_at) as prev_count from q)
select table_id, poll_at, call_count, prev_count, prev_count = 0 as is_new from l where call_count > prev_count""")
def q_newly_ringing(spark, sf_dir):
    return calls_ops.newly_ringing(shop(spark, sf_dir).ring_log)


@query("ring_debounce", """
with recursive r as (
  select seq, table_id, ts, epoch_us(ts) as us, row_number() over (partition by table_id order by ts, seq) as rn
  from s_ring_log where kind = 'ring'),
walk(table_id, rn, seq, ts, last_us, accepted) as (
  select table_id, rn, seq, ts, us, true from r where rn = 1
  union all
  select r.table_id, r.rn, r.seq, r.ts,
         case when r.us - w.last_us >= 15000000 then r.us else w.last_us end, r.us - w.last_us >= 15000000
  from walk w join r on r.table_id = w.table_id and r.rn = w.rn + 1)
select seq, table_id, ts, accepted from walk""")
def q_ring_debounce(spark, sf_dir):
    return calls_ops.ring_debounce(shop(spark, sf_dir).ring_log)


# ---------------------------------------------------------------- feedback
from tavolo.operators import feedback as fb_ops  # noqa: E402


@query("feedback_upsert", """
with ok as (select f.*, o.restaurant_id from s_feedback_events f join s_orders o on o.order_id = f.order_id
            where f.rating between 1 and 5),
x as (select ok.*, row_number() over (partition by order_id order by seq desc) as rk,
             min(seq) over (partition by order_id) as first_seq, count(*) over (partition by order_id) as n_submissions
      from ok)
select order_id, restaurant_id, rating, comment, first_seq, n_submissions from x where rk = 1""")
def q_feedback_upsert(spark, sf_dir):
    s = shop(spark, sf_dir)
    return fb_ops.feedback_upsert(s.feedback_events, s.orders)


@query("rejected_feedback", """
select * from (
  select f.order_id, f.seq, f.rating,
         case when o.order_id is null then 'Order not found'
              when f.rating < 1 or f.rating > 5 then 'Rating must be between 1 and 5'
              when f.rating is null then 'null value in column "rating" violates not-null constraint' end as reason
  from s_feedback_events f left join s_orders o on o.order_id = f.order_id) x
where reason is not null""")
def q_rejected_feedback(spark, sf_dir):
    s = shop(spark, sf_dir)
    return fb_ops.rejected_feedback(s.feedback_events, s.orders)


# ---------------------------------------------------------------- carts
from tavolo.operators import carts as cart_ops  # noqa: E402

_CART_LINES = """
c0 as (select *, max(case when delta = 0 then seq end) over (partition by cart_id, item_id) as reset from s_cart_events),
c1 as (select *, reset is null or seq > reset as live from c0),
c2 as (select *, sum(case when live then delta else 0 end) over (partition by cart_id, item_id order by seq
          rows between unbounded preceding and current row) as s from c1),
c3 as (select *, min(case when live then s end) over (partition by cart_id, item_id order by seq
          rows between unbounded preceding and current row) as m from c2),
c4 as (select *, case when live then s - least(0, m) else 0 end as q from c3),
c5 as (select cart_id, item_id, cast(arg_max(q, seq) as bigint) as qty,
              max(case when q = 1 and delta = 1 then seq end) as line_since from c4 group by cart_id, item_id),
cart as (select c5.cart_id, c5.item_id, c5.qty, c5.line_since, m.name, m.price
         from c5 left join s_menu_items m on m.menu_item_id = c5.item_id where c5.qty > 0)"""


def _cart_lines(s):
    return cart_ops.cart_fold(s.cart_events, s.menu_items)


@query("cart_fold", f"with {_CART_LINES} select cart_id, item_id, qty, line_since, name, cast(price as double) as price from cart")
def q_cart_fold(spark, sf_dir):
    return _money_out(_cart_lines(shop(spark, sf_dir)), "price")


@query("cart_summary", f"""
with {_CART_LINES}
select cart_id, cast(sum(qty) as bigint) as item_count, cast(cast(sum(price * qty) as decimal(18,4)) as double) as cart_value
from cart group by cart_id""")
def q_cart_summary(spark, sf_dir):
    return _money_out(cart_ops.cart_summary(_cart_lines(shop(spark, sf_dir))), "cart_value")


@query("cart_availability_prune", f"""
with {_CART_LINES},
j as (select c.*, coalesce(not m.is_available, true) as gone from cart c
      left join s_menu_items m on m.menu_item_id = c.item_id)
select cart_id, count(*) filter (where not gone) as kept_lines, count(*) filter (where gone) as removed_lines,
       coalesce(string_agg(name, ', ' order by line_since, name) filter (where gone), '') as removed_names
from j group by cart_id""")
def q_cart_availability_prune(spark, sf_dir):
    s = shop(spark, sf_dir)
    return cart_ops.cart_availability_prune(_cart_lines(s), s.menu_items)


# ---------------------------------------------------------------- receipts
from tavolo.operators import receipts as rc_ops  # noqa: E402

_RECEIPT = """
j as (select o.order_id, o.total, r.name as r_name, r.currency, r.whatsapp_number
      from s_orders o left join s_restaurants r on r.restaurant_id = o.restaurant_id),
li as (select i.order_id,
         string_agg(cast(i.qty as varchar) || 'x ' || i.name_snapshot || ' - ' || j.currency || ' ' ||
                    cast(cast(floor(coalesce(i.price_snapshot, 0) * coalesce(i.qty, 0) + 0.5) as bigint) as varchar), chr(10)
                    order by i.line_no, i.menu_item_id, i.name_snapshot, i.price_snapshot, i.qty) as body
       from s_order_items i join j on j.order_id = i.order_id group by i.order_id),
t as (select j.order_id, j.whatsapp_number,
        concat_ws(chr(10), 'Order receipt - ' || j.r_name, '', li.body, '',
                  'Total: ' || j.currency || ' ' || cast(cast(floor(coalesce(j.total, 0) + 0.5) as bigint) as varchar)) as receipt
      from j left join li on li.order_id = j.order_id)"""

_ENCODE = ("replace(replace(replace(replace(replace(url_encode({x}), '%21', '!'), '%27', ''''), "
           "'%28', '('), '%29', ')'), '%2A', '*')")


@query("receipt_text", f"with {_RECEIPT} select order_id, receipt from t")
def q_receipt_text(spark, sf_dir):
    s = shop(spark, sf_dir)
    return rc_ops.receipt_text(s.orders, s.order_items, s.restaurants)


@query("receipt_link_restaurant", f"""
with {_RECEIPT}
select order_id, case when whatsapp_number is not null and whatsapp_number <> ''
  then 'https://wa.me/' || regexp_replace(whatsapp_number, '[^0-9]', '', 'g') || '?text=' || {_ENCODE.format(x='receipt')}
  end as link from t""")
def q_receipt_link_restaurant(spark, sf_dir):
    s = shop(spark, sf_dir)
    return rc_ops.receipt_link_restaurant(s.orders, s.order_items, s.restaurants)


@query("receipt_link_customer", f"""
with {_RECEIPT},
ph as (select distinct order_id, case when length(trim(phone)) > 0 then phone end as phone from s_requests_flat),
u as (select t.order_id, ph.phone, t.receipt || chr(10) || chr(10) || 'Thank you for dining with us!' as txt
      from t left join ph on ph.order_id = t.order_id)
select order_id, case when phone is not null and phone <> ''
  then 'https://wa.me/' || regexp_replace(phone, '[^0-9]', '', 'g') || '?text=' || {_ENCODE.format(x='txt')}
  end as link from u""")
def q_receipt_link_customer(spark, sf_dir):
    s = shop(spark, sf_dir)
    orders, cust = _customers(s)
    return rc_ops.receipt_link_customer(orders, s.order_items, s.restaurants, cust)


# ---------------------------------------------------------------- integrity
from tavolo.operators import integrity as ig  # noqa: E402


TABLES = ("restaurants", "tables", "categories", "menu_items", "staff", "customers", "orders", "order_items", "calls",
          "feedback")
ROW_KEYS = {"restaurants": ["restaurant_id"], "tables": ["table_id"], "categories": ["category_id"],
            "menu_items": ["menu_item_id"], "staff": ["staff_id"], "customers": ["customer_id"], "orders": ["order_id"],
            "order_items": ["order_id", "line_no"], "calls": ["call_id"], "feedback": ["order_id"]}
# What the integrity queries delete, as conditions on the tables' keys.
DELETES = {"restaurants": "restaurant_id % 10 = 0", "tables": "table_id % 7 = 0", "staff": "staff_id = 3",
           "categories": "category_id like '%-PROMO-%'", "menu_items": "menu_item_id % 9 = 2",
           "customers": "customer_id % 8 = 5"}


def _frames(s):
    return {t: getattr(s, t) for t in TABLES}


def _deletes(s, *only):
    return {t: getattr(s, t).where(F.expr(c)).select(ROW_KEYS[t][0]) for t, c in DELETES.items()
            if not only or t in only}


_GONE = f"""
gr as (select restaurant_id from s_restaurants where {DELETES['restaurants']}),
gt as (select table_id from s_tables where {DELETES['tables']} or restaurant_id in (select restaurant_id from gr)),
gc as (select category_id from s_categories where {DELETES['categories']} or restaurant_id in (select restaurant_id from gr)),
gm as (select menu_item_id from s_menu_items where {DELETES['menu_items']} or restaurant_id in (select restaurant_id from gr)),
gs as (select staff_id from s_staff where {DELETES['staff']} or restaurant_id in (select restaurant_id from gr)),
gu as (select customer_id from s_customers where {DELETES['customers']} or restaurant_id in (select restaurant_id from gr)),
gor as (select order_id from s_orders where restaurant_id in (select restaurant_id from gr)),
kr as (select * from s_restaurants where restaurant_id not in (select restaurant_id from gr)),
kt as (select * from s_tables where table_id not in (select table_id from gt)),
kc as (select * from s_categories where category_id not in (select category_id from gc)),
km as (select * from s_menu_items where menu_item_id not in (select menu_item_id from gm)),
ks as (select * from s_staff where staff_id not in (select staff_id from gs)),
ku as (select * from s_customers where customer_id not in (select customer_id from gu)),
ko as (select * from s_orders where order_id not in (select order_id from gor)),
ki as (select * from s_order_items where order_id not in (select order_id from gor)),
ka as (select * from s_calls where restaurant_id not in (select restaurant_id from gr) and table_id not in (select table_id from gt)),
kf as (select * from s_feedback where order_id not in (select order_id from gor))"""

_KEPT_TABLES = (("restaurants", "kr"), ("tables", "kt"), ("categories", "kc"), ("menu_items", "km"), ("staff", "ks"),
                ("customers", "ku"), ("orders", "ko"), ("order_items", "ki"), ("calls", "ka"), ("feedback", "kf"))


@query("cascade_delete", f"with {_GONE}\n" + " union all ".join(
    f"select '{t}' as table_name, (select count(*) from s_{t}) as rows_before, (select count(*) from {k}) as rows_after"
    for t, k in _KEPT_TABLES))
def q_cascade_delete(spark, sf_dir):
    s = shop(spark, sf_dir)
    return ig.row_counts(_frames(s), _deletes(s))


def _key_sql(table: str) -> str:
    return f"concat_ws('/', {', '.join(f'cast({c} as varchar)' for c in ROW_KEYS[table])})"


@query("cascade_delete_rows", f"with {_GONE}\n" + " union all ".join(
    f"select '{t}' as table_name, {_key_sql(t)} as row_key from {k}" for t, k in _KEPT_TABLES))
def q_cascade_delete_rows(spark, sf_dir):
    s = shop(spark, sf_dir)
    return ig.surviving_rows(_frames(s), _deletes(s), ROW_KEYS)


_NULLED = (("menu_items", "km", "category_id", "gc", "category_id"), ("orders", "ko", "table_id", "gt", "table_id"),
           ("orders", "ko", "customer_id", "gu", "customer_id"), ("orders", "ko", "staff_id", "gs", "staff_id"),
           ("order_items", "ki", "menu_item_id", "gm", "menu_item_id"),
           ("calls", "ka", "acknowledged_by", "gs", "staff_id"))


def _refs_sql(edges) -> str:
    return " union all ".join(
        f"select '{t}.{c}' as edge, {_key_sql(t)} as row_key, "
        f"cast(case when {c} not in (select {key} from {gone}) then {c} end as varchar) as ref from {kept}"
        for t, kept, c, gone, key in edges)


@query("null_dangling_refs", f"with {_GONE}\n{_refs_sql(_NULLED)}")
def q_null_dangling_refs(spark, sf_dir):
    s = shop(spark, sf_dir)
    return ig.kept_references(_frames(s), _deletes(s), ROW_KEYS)


def _rows(df, table, ref=None):
    r = F.col(ref).cast("string") if ref else F.lit(None).cast("string")
    return df.select(F.lit(table).alias("table_name"), ig.row_key(df, ROW_KEYS[table]).alias("row_key"), r.alias("ref"))


@query("remove_staff", f"""
select 'orders' as table_name, {_key_sql('orders')} as row_key, cast(case when staff_id <> 3 then staff_id end as varchar) as ref from s_orders
union all select 'calls', {_key_sql('calls')}, cast(case when acknowledged_by <> 3 then acknowledged_by end as varchar) from s_calls
union all select 'staff', {_key_sql('staff')}, null from s_staff where staff_id <> 3""")
def q_remove_staff(spark, sf_dir):
    s = shop(spark, sf_dir)
    o, c, st = ig.remove_staff(s.orders, s.calls, s.staff, _deletes(s, "staff")["staff"])
    return _rows(o, "orders", "staff_id").unionByName(_rows(c, "calls", "acknowledged_by")).unionByName(
        _rows(st, "staff"))


@query("remove_table", f"""
select 'orders' as table_name, {_key_sql('orders')} as row_key, cast(case when table_id % 7 <> 0 then table_id end as varchar) as ref from s_orders
union all select 'calls', {_key_sql('calls')}, cast(table_id as varchar) from s_calls where table_id % 7 <> 0
union all select 'tables', {_key_sql('tables')}, null from s_tables where table_id % 7 <> 0""")
def q_remove_table(spark, sf_dir):
    s = shop(spark, sf_dir)
    o, c, t = ig.remove_table(s.orders, s.calls, s.tables, _deletes(s, "tables")["tables"])
    return _rows(o, "orders", "table_id").unionByName(_rows(c, "calls", "table_id")).unionByName(_rows(t, "tables"))


def _rule_sql(r) -> str:
    table = f"dirty_{r.table}"
    nulls = " or ".join(f"{c} is null" for c in r.columns)
    if r.kind == "unique":
        keys = ", ".join(r.columns)
        count = (f"cast(coalesce((select sum(n) from (select count(*) as n from {table} where not ({nulls}) "
                 f"group by {keys} having count(*) > 1)), 0) as bigint)")
    else:
        count = f"(select count(*) from {table} where {nulls if r.kind == 'not null' else f'not ({r.check})'})"
    return f"select '{r.name}' as rule, {count} as violations"


@query("constraint_audit", " union all ".join(_rule_sql(r) for r in ig.RULES))
def q_constraint_audit(spark, sf_dir):
    s = shop(spark, sf_dir)
    return ig.constraint_audit({t: s.dirty(t) for t in {r.table for r in ig.RULES}})


@query("staff_role_audit", """
select staff_id, restaurant_id, role as role_before, case when role = 'waiter' then 'headwaiter' else role end as role,
       (case when role = 'waiter' then 'headwaiter' else role end) in ('owner', 'manager', 'cashier', 'headwaiter', 'kitchen') as role_valid
from s_staff""")
def q_staff_role_audit(spark, sf_dir):
    return ig.staff_role_audit(shop(spark, sf_dir).staff)
