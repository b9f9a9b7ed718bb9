"""Referential-integrity and constraint jobs.

Deletes spread along a declared foreign-key graph as *deleted keys*: a
table's deleted rows are those that were named and those whose cascading
reference points at a deleted key.  Tables are taken parents first; each
is read once, joined with the (small) sets of its parents' deleted keys,
and only a table that is a parent itself is checkpointed, so that its
keys and its rows come from one pass.  A reference that points at a
deleted key of a "set null" edge becomes NULL; a NULL reference, or one to
a row that was never there, stays.

Constraints are declared as rules and compiled to one pass per table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tavolo.plans import cut_lineage

# The final role list.
ALLOWED_ROLES = ("owner", "manager", "cashier", "headwaiter", "kitchen")

CASCADE, SET_NULL = "cascade", "set null"


@dataclass(frozen=True)
class Reference:
    """``child.column`` references ``parent.key``."""
    child: str
    column: str
    parent: str
    key: str
    action: str

    @property
    def name(self) -> str:
        return f"{self.child}.{self.column}"


# The model's foreign keys, for the tables that have fixtures.
REFERENCES = (
    Reference("categories", "restaurant_id", "restaurants", "restaurant_id", CASCADE),
    Reference("menu_items", "restaurant_id", "restaurants", "restaurant_id", CASCADE),
    Reference("menu_items", "category_id", "categories", "category_id", SET_NULL),
    Reference("tables", "restaurant_id", "restaurants", "restaurant_id", CASCADE),
    Reference("staff", "restaurant_id", "restaurants", "restaurant_id", CASCADE),
    Reference("customers", "restaurant_id", "restaurants", "restaurant_id", CASCADE),
    Reference("orders", "restaurant_id", "restaurants", "restaurant_id", CASCADE),
    Reference("orders", "table_id", "tables", "table_id", SET_NULL),
    Reference("orders", "customer_id", "customers", "customer_id", SET_NULL),
    Reference("orders", "staff_id", "staff", "staff_id", SET_NULL),
    Reference("order_items", "order_id", "orders", "order_id", CASCADE),
    Reference("order_items", "menu_item_id", "menu_items", "menu_item_id", SET_NULL),
    Reference("calls", "restaurant_id", "restaurants", "restaurant_id", CASCADE),
    Reference("calls", "table_id", "tables", "table_id", CASCADE),
    Reference("calls", "acknowledged_by", "staff", "staff_id", SET_NULL),
    Reference("feedback", "order_id", "orders", "order_id", CASCADE),
)


def parents_first(tables, references=REFERENCES) -> list[str]:
    """The tables in an order that puts parents before their children."""
    left, out = list(tables), []
    while left:
        ready = [t for t in left if not any(r.child == t and r.parent in left and r.parent != t for r in references)]
        if not ready:
            raise ValueError(f"references form a cycle among {left}")
        out += ready
        left = [t for t in left if t not in ready]
    return out


def flag_deletes(tables: dict[str, DataFrame], deletes: dict[str, DataFrame],
                 references=REFERENCES) -> dict[str, DataFrame]:
    """Every table with ``__gone`` and its dangling "set null" references nulled.

    ``deletes`` maps a table to the keys to remove (one column, named as the
    table's key).  References to tables that are not given are skipped.
    """
    refs = [r for r in references if r.child in tables and r.parent in tables]
    gone_keys = {t: {k.columns[0]: k.distinct()} for t, k in deletes.items()}
    out = {}
    for name in parents_first(tables, refs):
        df = tables[name].withColumn("__gone", F.lit(False))
        for i, (column, keys) in enumerate(gone_keys.get(name, {}).items()):
            df = _flag(df, column, keys, F.col("__gone") | F.col("__hit"), "__gone")
        for r in (r for r in refs if r.child == name):
            keys = gone_keys.get(r.parent, {}).get(r.key)
            if keys is None:
                continue
            if r.action == CASCADE:
                df = _flag(df, r.column, keys, F.col("__gone") | F.col("__hit"), "__gone")
            else:
                df = _flag(df, r.column, keys, F.when(~F.col("__hit"), F.col(r.column)), r.column)
        children = {r.key for r in refs if r.parent == name}
        if children and (name in deletes or any(r.child == name and r.action == CASCADE
                                                and gone_keys.get(r.parent) for r in refs)):
            df = cut_lineage(df)
            gone_keys[name] = {k: df.where("__gone").select(k).distinct() for k in children}
        out[name] = df
    return out


def _flag(df: DataFrame, column: str, keys: DataFrame, value, target: str) -> DataFrame:
    """``target`` set to ``value``, in which ``__hit`` says that ``column`` is one of ``keys``."""
    k = keys.select(F.col(keys.columns[0]).alias("__k"), F.lit(True).alias("__found"))
    j = df.join(k, df[column] == k["__k"], "left").withColumn("__hit", F.col("__found").isNotNull())
    return j.withColumn(target, value).drop("__k", "__found", "__hit")


def cascade_delete(tables: dict[str, DataFrame], deletes: dict[str, DataFrame],
                   references=REFERENCES) -> dict[str, DataFrame]:
    """The tables after the deletes, with all cascades and nulled references."""
    return {n: df.where("not __gone").drop("__gone") for n, df in flag_deletes(tables, deletes, references).items()}


def row_counts(tables: dict[str, DataFrame], deletes: dict[str, DataFrame], references=REFERENCES) -> DataFrame:
    """table_name, rows_before, rows_after: one partial aggregate over a union of the flagged tables."""
    flagged = flag_deletes(tables, deletes, references)
    out = None
    for name, df in flagged.items():
        part = df.select(F.lit(name).alias("table_name"), "__gone")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("table_name").agg(F.count(F.lit(1)).alias("rows_before"),
                                         F.count(F.when(~F.col("__gone"), 1)).alias("rows_after"))


def row_key(df: DataFrame, columns) -> F.Column:
    return F.concat_ws("/", *[F.col(c).cast("string") for c in columns])


def kept_references(tables: dict[str, DataFrame], deletes: dict[str, DataFrame], row_keys: dict[str, list[str]],
                    references=REFERENCES, only: list[str] | None = None) -> DataFrame:
    """(edge, row_key, ref): every surviving row's reference along the "set null" edges, after the deletes."""
    after = cascade_delete(tables, deletes, references)
    out = None
    for r in references:
        if r.action != SET_NULL or r.child not in tables or r.parent not in tables or (only and r.name not in only):
            continue
        df = after[r.child]
        part = df.select(F.lit(r.name).alias("edge"), row_key(df, row_keys[r.child]).alias("row_key"),
                         F.col(r.column).cast("string").alias("ref"))
        out = part if out is None else out.unionByName(part)
    return out


def surviving_rows(tables: dict[str, DataFrame], deletes: dict[str, DataFrame], row_keys: dict[str, list[str]],
                   references=REFERENCES) -> DataFrame:
    """(table_name, row_key) of every row that the deletes leave."""
    out = None
    for name, df in cascade_delete(tables, deletes, references).items():
        part = df.select(F.lit(name).alias("table_name"), row_key(df, row_keys[name]).alias("row_key"))
        out = part if out is None else out.unionByName(part)
    return out


def remove_staff(orders: DataFrame, calls: DataFrame, staff: DataFrame, staff_ids: DataFrame):
    """Null orders.staff_id and calls.acknowledged_by of removed staff; drop them."""
    after = cascade_delete({"staff": staff, "orders": orders, "calls": calls}, {"staff": staff_ids.select("staff_id")})
    return after["orders"], after["calls"], after["staff"]


def remove_table(orders: DataFrame, calls: DataFrame, tables: DataFrame, table_ids: DataFrame):
    """Null orders.table_id, drop the tables and (cascade) their calls."""
    after = cascade_delete({"tables": tables, "orders": orders, "calls": calls},
                           {"tables": table_ids.select("table_id")})
    return after["orders"], after["calls"], after["tables"]


@dataclass(frozen=True)
class Rule:
    """A constraint of one table: ``not null`` and ``unique`` over columns, or a ``check`` expression."""
    table: str
    kind: str
    columns: tuple[str, ...] = ()
    check: str = ""

    @property
    def name(self) -> str:
        what = ", ".join(self.columns)
        if self.kind == "check":
            return f"{self.table} check {self.check}"
        return f"{self.table}.{what} {self.kind}" if len(self.columns) == 1 else f"{self.table} ({what}) {self.kind}"


# The model's unique, not-null and check rules.
RULES = (
    Rule("restaurants", "not null", ("name",)), Rule("restaurants", "not null", ("slug",)),
    Rule("restaurants", "unique", ("slug",)),
    Rule("categories", "not null", ("name",)),
    Rule("menu_items", "not null", ("name",)), Rule("menu_items", "not null", ("price",)),
    Rule("tables", "not null", ("label",)), Rule("tables", "not null", ("qr_token",)),
    Rule("tables", "unique", ("qr_token",)),
    Rule("staff", "not null", ("name",)),
    Rule("customers", "not null", ("phone",)), Rule("customers", "unique", ("restaurant_id", "phone")),
    Rule("order_items", "not null", ("name_snapshot",)), Rule("order_items", "not null", ("price_snapshot",)),
    Rule("order_items", "not null", ("qty",)),
    Rule("feedback", "unique", ("order_id",)), Rule("feedback", "not null", ("rating",)),
    Rule("feedback", "check", check="rating between 1 and 5"),
)


def constraint_audit(tables: dict[str, DataFrame], rules=RULES) -> DataFrame:
    """One row per rule: rule name and number of violating rows.

    Each table is read once: a row emits a mark for every not-null or check
    rule it breaks and its key for every unique rule.  Marks and keys are
    counted per (rule, key) by one aggregate over all tables (which
    combines map-side, so a hot key is one row a task), and a key's count
    is a violation if it exceeds one.  A key with a NULL part repeats
    nothing, and a check that is NULL holds, as in SQL.
    """
    marks = None
    numbered = list(enumerate(rules))
    for name, df in tables.items():
        own = [(i, r) for i, r in numbered if r.table == name]
        if not own:
            continue
        emit = []
        for i, r in own:
            if r.kind == "unique":
                whole = F.when(~_any_null(r.columns), F.to_json(F.struct(*[F.col(c).cast("string") for c in r.columns])))
                emit.append(F.struct(F.lit(i).alias("rule"), whole.alias("key")))
            else:
                broken = _any_null(r.columns) if r.kind == "not null" else ~F.expr(r.check)
                emit.append(F.struct(F.lit(i).alias("rule"), F.when(broken, F.lit("")).alias("key")))
        part = df.select(F.explode(F.array(*emit)).alias("m")).where("m.key is not null").select("m.rule", "m.key")
        marks = part if marks is None else marks.unionByName(part)
    per_key = marks.groupBy("rule", "key").agg(F.count(F.lit(1)).alias("n"))
    unique = [i for i, r in numbered if r.kind == "unique"]
    counts = (per_key.where(~F.col("rule").isin(unique) | (F.col("n") > 1)).groupBy("rule")
              .agg(F.sum("n").alias("violations")))
    spark = marks.sparkSession
    names = F.broadcast(spark.createDataFrame([(i, r.name) for i, r in numbered if r.table in tables],
                                              "rule int, name string"))
    return (names.join(counts, "rule", "left")
            .select(F.col("name").alias("rule"), F.coalesce("violations", F.lit(0)).cast("bigint").alias("violations")))


def _any_null(columns):
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


def staff_role_audit(staff: DataFrame) -> DataFrame:
    """Rename legacy 'waiter' to 'headwaiter', then flag roles outside the final set."""
    role = F.when(F.col("role") == "waiter", F.lit("headwaiter")).otherwise(F.col("role"))
    return staff.select("staff_id", "restaurant_id", F.col("role").alias("role_before"), role.alias("role"),
                        role.isin(*ALLOWED_ROLES).alias("role_valid"))
