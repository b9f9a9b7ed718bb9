"""Filter interaction audit: five text filters in all 120 orders, by a Gray-code subset walk.

Which documents survive a set of filters does not depend on their order,
so 32 states hold everything.  A document fails a set of filters, its
mask; documents of one part (language) and one mask are one cell with
three counts (all, good, toxic).  The walk visits the 32 subsets in Gray
order, so that a step toggles one filter: each cell that fails it moves
its counter of active failures by one, and a cell whose counter leaves or
reaches zero leaves or joins the running survivors.  What a filter
removes after others is the difference of two stored states.

Spark does what grows with the input: one pass over the texts gives narrow
rows (mask of the text's own filters, SHA-256 of the text), which are
counted per distinct text, part and label before they meet on the text.
A text that a third of all rows share is so combined before it is
shuffled, and a part ends as 32 cells at most, whatever its size.

Filters: A under 100 words, B under 80 % distinct words, C over 10 %
``[A-Z]``, D one of ``#$%&*|``, E identical to the text of a smaller id.

Defined cases: null text is the empty text, null part the empty string,
which both meet their equals; a null id is neither smaller nor larger
than another, so it fails E never and makes no other row fail it;
repeated rows count each, and rows of one id do not fail E by one
another; a document with several label rows has the label that any of
them gives; label rows of unknown documents are ignored; an empty table
gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

FILTERS = "ABCDE"
# The contract's limits.
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITAL_PERCENT = 10
SIGNS = r"[#$%&*|]"
BLANKS = r"[\x20\x09-\x0D]+"
SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, "
          "unique_fails long, good_lost long, toxic_lost long, shapley long")


def _own_mask(text):
    """Bits of the filters that a text fails by itself (A to D)."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [F.size(words) < MIN_WORDS,
             F.size(F.array_distinct(words)) * 100 < F.size(words) * MIN_DISTINCT_PERCENT,
             capitals.cast("long") * 100 > F.length(text).cast("long") * MAX_CAPITAL_PERCENT,
             text.rlike(SIGNS)]
    return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0))


def failure_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  part_col: str = "lang") -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents by part and failed filters (bit 0 is A)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                       F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
                       text.alias("text"))
    rows = rows.select("id", "part", _own_mask(F.col("text")).alias("own"), F.sha2("text", 256).alias("h"))
    marks = (labels.where("doc_id is not null")
             .groupBy(F.col("doc_id").cast("long").alias("id"))
             .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                  F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")))
    rows = rows.join(marks, "id", "left").withColumns({
        "good": F.coalesce("good", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))})
    # rows of one id first (the join has dealt them by id already), then of one text, part and label
    same_id = rows.groupBy("h", "part", "own", "good", "toxic", "id").agg(F.count(F.lit(1)).alias("n"))
    same_text = same_id.groupBy("h", "part", "own", "good", "toxic").agg(
        F.min("id").alias("least"), F.sum("n").alias("n"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(F.lit(0))).alias("n_null"),
        F.min_by("n", "id").alias("n_least"))
    # a text now has one row for each part and pair of labels
    first = F.min("least").over(Window.partitionBy("h"))
    spared = F.col("n_null") + F.when(F.col("least") == first, F.col("n_least")).otherwise(F.lit(0))
    split = same_text.withColumn("spared", spared).select(
        "part", "good", "toxic", F.explode(F.array(
            F.struct(F.col("own").alias("mask"), F.col("spared").alias("n")),
            F.struct((F.col("own") + F.lit(1 << 4)).alias("mask"), (F.col("n") - F.col("spared")).alias("n"))))
        .alias("c")).select("part", "good", "toxic", "c.mask", "c.n")
    return split.where("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(F.lit(0))).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(F.lit(0))).alias("toxic"))


def subset_states(masks: np.ndarray, counts: np.ndarray, n_filters: int = len(FILTERS)) -> np.ndarray:
    """Survivors of every subset of filters: row S holds what no filter of S removes.

    ``masks`` are the cells' failed filters, ``counts`` their figures (a row a cell).
    """
    states = np.zeros((1 << n_filters, counts.shape[1]), dtype=np.int64)
    failing = [np.flatnonzero(masks >> f & 1) for f in range(n_filters)]
    active = np.zeros(len(masks), dtype=np.int64)   # active filters that a cell fails
    alive = counts.sum(axis=0)
    states[0] = alive
    subset = 0
    for i in range(1, 1 << n_filters):
        f = (i & -i).bit_length() - 1               # the bit that Gray codes toggle at step i
        subset ^= 1 << f
        cells = failing[f]
        if subset >> f & 1:
            alive = alive - counts[cells[active[cells] == 0]].sum(axis=0)
            active[cells] += 1
        else:
            active[cells] -= 1
            alive = alive + counts[cells[active[cells] == 0]].sum(axis=0)
        states[subset] = alive
    return states


def shapley_sums(states: np.ndarray, n_filters: int = len(FILTERS)) -> list[int]:
    """What each filter removes, summed over all orders: each difference as often as orders reach it."""
    out = []
    for f in range(n_filters):
        total = 0
        for s in range(1 << n_filters):
            if not s >> f & 1:
                before = s.bit_count()
                total += (factorial(before) * factorial(n_filters - 1 - before)
                          * int(states[s, 0] - states[s | 1 << f, 0]))
        out.append(total)
    return out


def order_rows(part: str, cells: pd.DataFrame) -> pd.DataFrame:
    """The 600 rows of a part: every order of the filters, step by step."""
    states = subset_states(cells["mask"].to_numpy(np.int64), cells[["n", "good", "toxic"]].to_numpy(np.int64))
    full = len(states) - 1
    shapley = shapley_sums(states)
    fails = [int(states[0, 0] - states[1 << f, 0]) for f in range(len(FILTERS))]
    unique = [int(states[full ^ 1 << f, 0] - states[full, 0]) for f in range(len(FILTERS))]
    rows = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[f] for f in order), 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            n, good, toxic = (int(x) for x in states[before] - states[after])
            rows.append((part, name, step, int(states[after, 0]), n, fails[f] - n, unique[f], good, toxic,
                         shapley[f]))
            before = after
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  part_col: str = "lang") -> DataFrame:
    """Per part, order and step what the step's filter does there (see the module's text)."""
    cells = failure_cells(docs, labels, id_col, text_col, part_col)
    # a group has 32 rows at most
    return cells.groupBy("part").applyInPandas(lambda key, c: order_rows(key[0], c), SCHEMA)


def oracle() -> str:
    """DuckDB SQL of the same rows, by replaying every order on every document."""
    return r"""
with d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
         list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '') as w from documents),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good,
             max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by 1),
m as (
  select d.part, coalesce(l.good, 0) as good, coalesce(l.toxic, 0) as toxic,
    case when len(w) < 100 then 1 else 0 end as fa,
    case when 100 * len(list_distinct(w)) < 80 * len(w) then 1 else 0 end as fb,
    case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) then 1 else 0 end as fc,
    case when regexp_matches(t, '[#$%&*|]') then 1 else 0 end as fd,
    case when d.doc_id > min(d.doc_id) over (partition by t) then 1 else 0 end as fe
  from d left join l on l.doc_id = d.doc_id),
letters as (select * from (values ('A'), ('B'), ('C'), ('D'), ('E')) v(x)),
orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
  where a.x not in (b.x, c.x, d.x, e.x) and b.x not in (c.x, d.x, e.x) and c.x not in (d.x, e.x) and d.x <> e.x),
cells as (
  select part, fa, fb, fc, fd, fe, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by all),
fails as (
  select filter_order, s.step, c.*, substr(filter_order, s.step, 1) as f,
    list_contains(list_transform(range(1, s.step), lambda i: (case substr(filter_order, i, 1)
      when 'A' then fa when 'B' then fb when 'C' then fc when 'D' then fd else fe end)::int), 1) as gone,
    (case substr(filter_order, s.step, 1)
      when 'A' then fa when 'B' then fb when 'C' then fc when 'D' then fd else fe end) as hit
  from orders, (select unnest(range(1, 6)) as step) s, cells c),
rows_ as (
  select part, filter_order, step, f,
    coalesce(sum(n) filter (not gone and hit = 0), 0)::bigint as kept,
    coalesce(sum(n) filter (not gone and hit = 1), 0)::bigint as removed,
    coalesce(sum(n) filter (gone and hit = 1), 0)::bigint as redundant,
    coalesce(sum(n) filter (hit = 1 and fa + fb + fc + fd + fe = 1), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (not gone and hit = 1), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (not gone and hit = 1), 0)::bigint as toxic_lost
  from fails group by all)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, f))::bigint as shapley
from rows_"""
