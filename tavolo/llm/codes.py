"""Vector code compression: product codes with codebooks fitted by dual-tree Lloyd rounds.

A vector is floored to integers and cut into 16 parts; each part position
has a codebook of 64 entries.  A Lloyd round assigns every part to its
nearest entry and moves the entries to their parts' means.

``DualTree`` does the assignment of a block of vectors.  The parts of a
position lie in a balanced tree (median splits of the widest side), the
entries in another; nodes carry their bounding box, and part nodes the
sum of their parts.  Both trees are descended together, one level of node
pairs at a time: a pair goes when its least distance exceeds the part
node's least upper bound.  A part node that has one entry left is
assigned whole and adds its cached sum; what is still uncertain in the
leaves is settled by integer distances, ties to the lower index.  The
boxes hold integers, so the bounds are exact as well.

Spark deals the vectors; a task keeps one block at a time and returns one
row of sums for each part position and entry, which are added by a
partial aggregate.  The driver holds the codebooks alone (64 vectors).

Defined cases: a row whose vector is null or holds a null or non-finite
component is dropped; the vectors' length is the longest one's, brought up
to a multiple of 16 (16 at least), and shorter vectors count as ended by
zeros; with under 64 kept rows a codebook has as many entries; rows of one
id count each (the smallest ids take ties in the order of their vectors),
null ids come last; null labels are one label; components of any size are
exact (Python integers from 2^26 up), and an error beyond a long is null,
as is its label's sum; an empty table gives no rows; other columns are
ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tavolo.llm.common import kept

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LEAF = 16                   # parts of a leaf
BLOCK_VALUES = 1 << 20      # components of a block of vectors (results do not depend on it)
PAIR_VALUES = 1 << 21       # components compared at once in the leaves
EXACT = 1 << 26             # floored components below it keep squared distances inside 64 bits


class Tree:
    """Balanced boxes over points; ``levels`` hold (start, end, low, high, sum, first child, children)."""

    def __init__(self, points: np.ndarray, leaf: int):
        n = len(points)
        self.order = np.arange(n)
        start, end = np.array([0]), np.array([n])
        self.levels = []
        while True:
            own = points[self.order]
            low, high = np.minimum.reduceat(own, start), np.maximum.reduceat(own, start)
            split = end - start > leaf
            children = np.where(split, 2, 1)
            first = np.cumsum(children) - children
            self.levels.append((start, end, low, high, np.add.reduceat(own, start), first, children))
            if not split.any():
                self.points = own
                return
            # by the widest side inside each node, then cut at the middle
            node = np.repeat(np.arange(len(start)), end - start)
            side = np.argmax(high - low, axis=1)
            rank = np.argsort(own[np.arange(n), side[node]], kind="stable")
            self.order = self.order[rank[np.argsort(node[rank], kind="stable")]]
            middle = (start + end) // 2
            cuts = np.unique(np.concatenate([start, middle[split]]))
            start, end = cuts, np.append(cuts[1:], n)


class DualTree:
    """Assigns the parts of one position to the entries of its codebook."""

    def __init__(self, points: np.ndarray, entries: np.ndarray):
        self.parts, self.book = Tree(points, LEAF), Tree(entries, 1)
        self.sums = np.zeros_like(entries)
        self.counts = np.zeros(len(entries), dtype=np.int64)
        sorted_codes = np.empty(len(points), dtype=np.int64)
        self._descend(sorted_codes)
        self.codes = np.empty_like(sorted_codes)
        self.codes[self.parts.order] = sorted_codes

    def _descend(self, codes: np.ndarray) -> None:
        up, down = self.parts.levels, self.book.levels
        i = j = 0
        a, b = np.array([0]), np.array([0])
        while True:
            start, end, a_low, a_high, a_sum, a_first, a_children = up[i]
            b_start, _, b_low, b_high, _, b_first, b_children = down[j]
            gap = np.maximum(np.maximum(a_low[a] - b_high[b], b_low[b] - a_high[a]), 0)
            far = np.maximum(a_high[a] - b_low[b], b_high[b] - a_low[a])
            head = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            most = np.minimum.reduceat((far * far).sum(axis=1), head)
            near = (gap * gap).sum(axis=1) <= np.repeat(most, np.diff(np.r_[head, len(a)]))
            a, b = a[near], b[near]
            if j == len(down) - 1:
                head = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
                runs = np.diff(np.r_[head, len(a)])
                sure = head[runs == 1]
                entry = self.book.order[b_start[b[sure]]]
                np.add.at(self.sums, entry, a_sum[a[sure]])
                size = end[a[sure]] - start[a[sure]]
                np.add.at(self.counts, entry, size)
                codes[spread(start[a[sure]], size)] = np.repeat(entry, size)
                left = np.repeat(runs > 1, runs)
                a, b = a[left], b[left]
                if not len(a):
                    return
                if i == len(up) - 1:
                    return self._leaves(start, end, a, self.book.order[b_start[b]], codes)
            if i < len(up) - 1:
                a, b = _children(a_first, a_children, a, b)
                i += 1
            if j < len(down) - 1:
                b, a = _children(b_first, b_children, b, a)
                j += 1
            at = np.argsort(a, kind="stable")
            a, b = a[at], b[at]

    def _leaves(self, start, end, a, entry, codes) -> None:
        """Exact distances of the parts of uncertain leaves to the entries left for them."""
        points, entries = self.parts.points, self.book.points[np.argsort(self.book.order)]
        far = (1 << 62) if points.dtype != object else (1 << 4096)
        best = np.full(len(points), far, dtype=points.dtype)
        size = end[a] - start[a]
        step = max(1, PAIR_VALUES // (LEAF * max(1, points.shape[1])))
        for s in range(0, len(a), step):
            at = spread(start[a[s:s + step]], size[s:s + step])
            e = np.repeat(entry[s:s + step], size[s:s + step])
            d = points[at] - entries[e]
            np.minimum.at(best, at, (d * d).sum(axis=1) * ENTRIES + e)
        at = np.flatnonzero(best != far)
        code = (best[at] % ENTRIES).astype(np.int64)
        codes[at] = code
        np.add.at(self.sums, code, points[at])
        np.add.at(self.counts, code, 1)


def _children(first, children, x, other):
    """Every child of the nodes ``x``, with what the parent was paired with."""
    n = children[x]
    return spread(first[x], n), np.repeat(other, n)


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every range, one after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def to_integers(values: np.ndarray, exact: bool) -> np.ndarray:
    """floor(256 * x) of doubles: 64-bit, or Python integers where they may not fit."""
    if not exact:
        return np.floor(values.astype(np.float64) * SCALE).astype(np.int64)
    flat = [int(x) * SCALE if abs(x) >= 2**53 else math.floor(float(x) * SCALE) for x in values.ravel().tolist()]
    return np.array(flat, dtype=object).reshape(values.shape)


def _matrix(column: pa.Array, dim: int, exact: bool) -> np.ndarray:
    """A list column as integer rows of ``dim`` components, short ones ended by zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    size = np.diff(column.offsets.to_numpy())
    if (size == dim).all():
        return to_integers(values.reshape(len(size), dim), exact)
    out = np.zeros((len(size), dim))
    out[np.repeat(np.arange(len(size)), size), spread(np.zeros(len(size), dtype=np.int64), size)] = values
    return to_integers(out, exact)


def _blocks(batches, dim: int, exact: bool):
    """(rows, integer parts by position) of bounded blocks."""
    rows = max(1, BLOCK_VALUES // dim)
    for batch in batches:
        for s in range(0, batch.num_rows, rows):
            b = batch.slice(s, rows)
            m = _matrix(b.column("v"), dim, exact)
            yield b, m.reshape(len(m), PARTS, dim // PARTS).swapaxes(0, 1)


def assign(points: np.ndarray, books: np.ndarray) -> list[DualTree]:
    """One ``DualTree`` a part position (``points`` and ``books``: position, row, component)."""
    return [DualTree(p, e) for p, e in zip(points, books)]


def _round(vectors: DataFrame, books: np.ndarray, dim: int, exact: bool) -> np.ndarray:
    """The codebooks after one Lloyd round."""
    width = dim // PARTS

    def sums(batches):
        total = np.zeros_like(books)
        counts = np.zeros(books.shape[:2], dtype=np.int64)
        for _, points in _blocks(batches, dim, exact):
            for p, t in enumerate(assign(points, books)):
                total[p] += t.sums
                counts[p] += t.counts
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(p.astype(np.int32)), "entry": pa.array(e.astype(np.int32)),
            "n": pa.array(counts[p, e]),
            "s": pa.array([[str(x) for x in row] for row in total[p, e].tolist()], pa.list_(pa.string()))})

    # wide sums: exact over any number of rows (Python integers beyond 38 digits)
    out = vectors.select("v").mapInArrow(sums, "part int, entry int, n long, s array<string>")
    if exact:
        rows = [(r.part, r.entry, r.n, [int(x) for x in r.s]) for r in _merged_text(out).collect()]
    else:
        rows = [(r[0], r[1], r[2], [int(x) for x in r[3:]]) for r in out.groupBy("part", "entry").agg(
            F.sum("n").alias("n"), *(F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}")
                                     for i in range(width))).collect()]
    books = books.copy()
    for p, e, n, s in rows:
        books[p, e] = [x // n for x in s]
    return books


def _merged_text(out: DataFrame) -> DataFrame:
    """Sums of Python integers, added pair by pair inside Spark's groups (one row a task, position and entry)."""
    def add(batches):
        total: dict = {}
        for b in batches:
            for r in b.to_pylist():
                n, s = total.get((r["part"], r["entry"]), (0, None))
                own = [int(x) for x in r["s"]]
                total[r["part"], r["entry"]] = (n + r["n"], own if s is None else [x + y for x, y in zip(s, own)])
        yield pa.RecordBatch.from_pylist(
            [{"part": p, "entry": e, "n": n, "s": [str(x) for x in s]} for (p, e), (n, s) in total.items()],
            schema=pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()),
                              ("s", pa.list_(pa.string()))]))
    schema = "part int, entry int, n long, s array<string>"
    return out.repartition(PARTS * ENTRIES, "part", "entry").mapInArrow(add, schema)


def _finite(v):
    """Neither null nor holding a null or non-finite component (NaN is above infinity)."""
    return v.isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))


def fit_codebooks(vectors: DataFrame) -> tuple[np.ndarray, int, bool] | None:
    """``(codebooks, dimension, exact)`` of finite ``vectors (id, v)``; None without rows."""
    size = vectors.agg(F.max(F.size("v")).alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("top"),
                       F.count(F.lit(1)).alias("rows")).first()
    if not size.rows:
        return None
    dim = PARTS * max(1, -(-size.n // PARTS))
    exact = (size.top or 0.0) * SCALE >= EXACT
    first = [r.v for r in vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()]
    start = _matrix(pa.array(first, pa.list_(pa.float64())), dim, exact)
    books = start.reshape(len(first), PARTS, dim // PARTS).swapaxes(0, 1).copy()
    for _ in range(ROUNDS):
        books = _round(vectors, books, dim, exact)
    return books, dim, exact


def encode(vectors: DataFrame, books: np.ndarray, dim: int, exact: bool) -> DataFrame:
    """``(id, code, error, label)`` of ``vectors (id, v, label)``."""
    def code(batches):
        for b, points in _blocks(batches, dim, exact):
            trees = assign(points, books)
            codes = np.stack([t.codes for t in trees], axis=1).astype(np.uint8)
            error = 0
            for p, t in enumerate(trees):
                d = points[p] - books[p][t.codes]
                error = error + (d * d).sum(axis=1)
            error = [x if x < 2**63 else None for x in error.tolist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([c.tobytes().hex() for c in codes], pa.string()),
                 pa.array(error, pa.int64()), b.column("label")], names=["id", "code", "error", "label"])

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.mapInArrow(code, f"id long, code string, error long, label {label}")


def compress(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
             label_col: str = "label") -> DataFrame:
    """Code and error of every kept vector, its label's error and the digest of the codebooks."""
    vectors = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                                F.col(f"`{vector_col}`").cast("array<double>").alias("v"),
                                F.col(f"`{label_col}`").alias("label")).where(_finite(F.col("v")))
    fitted = fit_codebooks(vectors)
    out = "id as vec_id", "code", "error", "label_error", "codebooks_sha256"
    if fitted is None:
        return vectors.where("false").selectExpr(
            "id as vec_id", "'' as code", "0L as error", "0L as label_error", "'' as codebooks_sha256")
    books, dim, exact = fitted
    digest = hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()
    codes = kept(encode(vectors, books, dim, exact))
    of_label = codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"),
                                          F.count(F.when(F.col("error").isNull(), 1)).alias("beyond"))
    of_label = of_label.select(F.col("label").alias("l"),
                               F.when(F.col("beyond") == 0, F.col("s").try_cast("long")).alias("label_error"))
    return (codes.join(of_label, F.col("label").eqNullSafe(F.col("l")), "left")
            .withColumn("codebooks_sha256", F.lit(digest)).selectExpr(*out))


def oracle() -> str:
    """DuckDB SQL of the same rows by comparing every part with every entry."""
    def assigned(book: str) -> str:
        return f"""
  select w.rn, w.p, min(list_sum(list_transform(list_zip(w.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))
                        * 64 + c.e) as best
  from parts w join {book} c on c.p = w.p group by w.rn, w.p"""

    def moved(book: str, assigned_: str) -> str:
        return f"""
  select c.p, c.e, coalesce(n.q, c.q) as q from {book} c left join (
    select p, e, list(x order by i) as q from (
      select w.p, a.best % 64 as e, i, floor(sum(w.q[i])::double / count(*))::bigint as x
      from {assigned_} a join parts w on w.rn = a.rn and w.p = a.p, range(1, {{width}} + 1) r(i)
      group by all) group by p, e) n on n.p = c.p and n.e = c.e"""

    text = f"""
with kept as materialized (
  select vec_id, label, row_number() over (order by vec_id) - 1 as rn,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (
  select rn, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] as q from kept, range(0, 16) r(p)),
book0 as materialized (select p, rn as e, q from parts where rn < 64),
near0 as materialized ({assigned('book0')}),
book1 as materialized ({moved('book0', 'near0')}),
near1 as materialized ({assigned('book1')}),
book2 as materialized ({moved('book1', 'near1')}),
near2 as materialized ({assigned('book2')}),
digest as (
  select sha256(string_agg(x, ',' order by p, e, i)) as codebooks_sha256 from (
    select p, e, unnest(q)::varchar as x, generate_subscripts(q, 1) as i from book2)),
coded as (
  select rn, string_agg(format('{{:02x}}', best % 64), '' order by p) as code, sum(best // 64)::bigint as error
  from near2 group by rn)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from coded join kept using (rn), digest"""
    return text.replace("{width}", "(select max(len(q)) from parts)")
