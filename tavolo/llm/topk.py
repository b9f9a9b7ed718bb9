"""Exact top-k inner products over norm-sorted blocks.

Vectors are dealt by descending length into blocks of bounded rows, so a
block's rows are all at most as long as those of the blocks before it in
its task.  All are rotated onto the eigenvectors of the corpus' second
moments (the right singular vectors), so the leading coordinates hold
most of a product; by Cauchy-Schwarz the rest is at most the product of
the residual lengths.

Queries are taken in chunks of bounded bytes.  A chunk is scored against
the block of longest rows first, which gives every query a floor for its
k-th score.  Then the chunk goes to all tasks, and each passes through its
blocks in order of length, so blocks are read where they lie and nothing
but the chunk moves.  A pair of query block and candidate block goes
unread when the product of their greatest lengths is below the least
floor; inside a pair, partial sums plus residual bounds drop the
candidates that no query can want, and the others are scored by one
product of integer matrices.  Each query keeps its k best so far, whose
last raises its floor for the blocks to come.

Scores: components are floor(scale * x); the score is the integer inner
product, vectors of different lengths being filled up with zeros; ties go
to the smaller id.  Products are taken in floating point where every sum
stays below 2^52 and so is exact, else in Python integers.  Defined cases:
vectors that are null or hold a null or non-finite component take no part,
nor do rows of a null id; the empty vector scores 0 with all; equal
vectors are ranked by id; a repeated id is several rows, each a candidate
of the others and, where it is a query, a list of its own; a score beyond
a long is ranked by its value and null in the result; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tavolo.llm.common import kept

SCALE = 256
TOP = 5
QUERY_EVERY = 50
QUERY_ROWS = 1024              # rows of a query block
BLOCK_ROWS = 4096              # rows of a candidate block
BLOCK_VALUES = 1 << 20         # components of a candidate block, at most (one row at least)
TASK_BLOCKS = 16               # candidate blocks of a task
CHUNK_VALUES = 1 << 22         # components of the queries that go to all tasks at once
LEADING = 0.25                 # share of the rotated coordinates in the partial sum
FLOAT_SAFE = 2.0 ** 52         # products below this are exact in floating point
SLACK = 1e-9                   # of the lengths' product: rounding of rotated sums

BLOCK = "rows array<long>, ids array<long>, dim int, data binary, top double"
HITS = "query_row long, query_id long, row long, vec_id long, score long, place string"


def _values(column: pa.Array) -> tuple[np.ndarray, int]:
    """A list column as rows of doubles, short ones filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(column.offsets.to_numpy())
    dim = int(size.max(initial=0))
    if (size == dim).all():
        return flat.reshape(len(size), dim), dim
    out = np.zeros((len(size), dim))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out, dim


def floored(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): doubles below 2^52, else Python integers."""
    if values.size == 0 or np.abs(values).max() < FLOAT_SAFE / scale:
        return np.floor(values * scale)
    flat = [int(x) * scale if abs(x) >= FLOAT_SAFE else math.floor(x * scale) for x in values.ravel().tolist()]
    return np.array(flat, dtype=object).reshape(values.shape)


def _padded(a: np.ndarray, dim: int) -> np.ndarray:
    if a.shape[1] == dim:
        return a
    out = np.zeros((len(a), dim), dtype=a.dtype)
    out[:, :a.shape[1]] = a
    return out


class Block:
    """Rows with their integers and, where those are doubles, their rotated leading part and residual lengths."""

    def __init__(self, rows, ids, values: np.ndarray, scale: int, rotation: np.ndarray):
        self.rows, self.ids = np.asarray(rows, dtype=np.int64), np.asarray(ids, dtype=np.int64)
        self.m = floored(values, scale)
        self.exact = self.m.dtype == object
        if self.exact:
            return
        self.greatest = float(np.abs(self.m).max(initial=0))
        d = len(rotation)
        m = _padded(self.m, d) if self.m.shape[1] < d else self.m
        self.lead = max(1, math.ceil(LEADING * d)) if d else 0
        turned = m[:, :d] @ rotation
        self.front = turned[:, :self.lead]
        # what lies outside the rotated dimensions belongs to the residual
        rest = (turned[:, self.lead:] ** 2).sum(axis=1) + (m[:, d:] ** 2).sum(axis=1)
        self.rest = np.sqrt(rest)
        self.norm = np.sqrt((self.m ** 2).sum(axis=1))


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer products of all rows: int64 where they fit, else Python integers."""
    dim = max(q.shape[1], c.shape[1])
    q, c = _padded(q, dim), _padded(c, dim)
    if q.dtype != object and c.dtype != object:
        bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * dim
        if bound < FLOAT_SAFE:
            return (q @ c.T).astype(np.int64)
        if bound < 2.0 ** 62:
            return q.astype(np.int64) @ c.astype(np.int64).T
    whole = [a if a.dtype == object else np.array([int(x) for x in a.ravel().tolist()], dtype=object).reshape(a.shape)
             for a in (q, c)]
    return whole[0] @ whole[1].T if dim else np.zeros((len(q), len(c)), dtype=object)


class Best:
    """The k best candidates of each query so far: score, id, row (unused places: no row, -1)."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k = k
        self.score = np.zeros((n, k), dtype=object)
        self.id = np.zeros((n, k), dtype=np.int64)
        self.row = np.full((n, k), -1, dtype=np.int64)
        self.floor = floor.copy()       # no score below it can be among the k best

    def add(self, at: np.ndarray, cols: np.ndarray, score: np.ndarray, ids, rows) -> None:
        """New entries: query numbers (sorted), their candidates and scores."""
        for q in np.unique(at):
            own = np.flatnonzero(at == q) if len(at) < 64 else np.arange(*np.searchsorted(at, (q, q + 1)))
            old = np.flatnonzero(self.row[q] >= 0)
            s = [*self.score[q][old], *score[own].tolist()]
            i = [*self.id[q][old].tolist(), *ids[cols[own]].tolist()]
            r = [*self.row[q][old].tolist(), *rows[cols[own]].tolist()]
            order = sorted(range(len(s)), key=lambda x: (-s[x], i[x], r[x]))[:self.k]
            for place, x in enumerate(order):
                self.score[q, place], self.id[q, place], self.row[q, place] = s[x], i[x], r[x]
            if len(order) == self.k:
                self.floor[q] = max(self.floor[q], _below(s[order[-1]]))


def _below(score: int) -> float:
    """A double not above the integer."""
    try:
        f = float(score)
    except OverflowError:
        return sys.float_info.max if score > 0 else -math.inf
    return f if f <= score else math.nextafter(f, -math.inf)


def meet(q: Block, c: Block, best: Best) -> None:
    """Scores the candidates of ``c`` that some query of ``q`` can want, and keeps the k best.

    Columns are in order of id, so the first of equal scores are those to keep.
    """
    cols = np.arange(len(c.ids))
    if not (q.exact or c.exact):
        high = q.front @ c.front.T
        high += np.outer(q.rest, c.rest)
        high += SLACK * np.outer(q.norm, c.norm) + 1e-6
        cols = np.flatnonzero((high >= best.floor[:, None]).any(axis=0))
        if not len(cols):
            return
    score = products(q.m, c.m[cols])
    own = np.isin(c.rows[cols], q.rows)
    blocked = q.rows[:, None] == c.rows[cols][None, own]
    k = best.k
    if score.dtype == object:
        for i in range(len(score)):
            floor = float(best.floor[i])        # a Python number: compared exactly with integers of any size
            ok = [j for j in range(len(cols)) if c.rows[cols[j]] != q.rows[i] and score[i, j] >= floor]
            if ok:
                best.add(np.full(len(ok), i), cols[ok], score[i][ok], c.ids, c.rows)
        return
    lowest = np.iinfo(np.int64).min
    part = score[:, own]
    part[blocked] = lowest
    score[:, own] = part
    # the k-th best here is a floor too: above it fewer than k, at it the first ones
    floor = np.ceil(np.maximum(best.floor, -2.0 ** 62)).astype(np.int64)
    if score.shape[1] > k:
        kth = np.maximum(np.partition(score, -k, axis=1)[:, -k], floor)
        above = score > kth[:, None]
        level = (score == kth[:, None]) & (kth > lowest)[:, None]
        want = above | level & (np.cumsum(level, axis=1) <= (k - above.sum(axis=1))[:, None])
    else:
        want = (score >= floor[:, None]) & (score > lowest)
    at, j = np.nonzero(want)
    if len(at):
        best.add(at, cols[j], score[at, j], c.ids, c.rows)


def place(score: int) -> str:
    """A text that sorts as the integer does."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):06d}{digits}"
    return f"0{999_999 - len(digits):06d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def _entries(q: Block, best: Best):
    """The kept entries as a batch, without those that the floor has passed."""
    out = []
    for i in range(len(q.rows)):
        for p in range(best.k):
            if best.row[i, p] >= 0 and best.score[i, p] >= float(best.floor[i]):
                s = int(best.score[i, p])
                out.append((int(q.rows[i]), int(q.ids[i]), int(best.row[i, p]), int(best.id[i, p]),
                            s if -2**63 <= s < 2**63 else None, place(s)))
    kinds = [pa.int64()] * 5 + [pa.string()]
    cols = list(zip(*out)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                      names=[c.split()[0] for c in HITS.split(", ")])


def _read(batch, scale, rotation):
    """(greatest length, block) of each row of a batch of blocks."""
    for r in batch.to_pylist():
        values = np.frombuffer(r["data"], dtype="<f8").reshape(len(r["ids"]), r["dim"])
        yield r["top"], (lambda r=r, v=values: Block(r["rows"], r["ids"], v, scale, rotation))


def _scan(blocks: DataFrame, chunk, scale: int, k: int) -> DataFrame:
    """Every block of each task against the chunk of query blocks ``(queries, floors)``."""
    def run(batches):
        rotation, queries = chunk.value
        queries = [(top, Block(rows, ids, v, scale, rotation), floor) for top, rows, ids, v, floor in queries]
        state = [Best(len(q.rows), k, floor) for _, q, floor in queries]
        for b in batches:
            for top, block in _read(b, scale, rotation):
                c = None
                for (q_top, q, _), best in zip(queries, state):
                    if top * q_top * (1 + SLACK) + 1e-6 < best.floor.min(initial=math.inf):
                        continue
                    c = c or block()
                    meet(q, c, best)
        for (_, q, _), best in zip(queries, state):
            yield _entries(q, best)
    return blocks.mapInArrow(run, HITS)


def _seeded(queries: DataFrame, longest, scale: int, k: int) -> DataFrame:
    """Query blocks with each query's k-th score in the block of longest rows."""
    def run(batches):
        rotation, (rows, ids, values) = longest.value
        first = Block(rows, ids, values, scale, rotation)
        for b in batches:
            floors = []
            for _, block in _read(b, scale, rotation):
                q = block()
                best = Best(len(q.rows), k, np.full(len(q.rows), -np.inf))
                meet(q, first, best)
                floors.append(best.floor.tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(floors, pa.list_(pa.float64()))],
                                             names=[*b.schema.names, "floors"])
    return queries.mapInArrow(run, f"{BLOCK}, n long, floors array<double>")


def _tasks(spark, n_rows: int, size: int, dim: int) -> int:
    """Tasks for blocks of ``size`` rows: every core has one, and none has more than a few blocks."""
    blocks = math.ceil(n_rows / max(1, min(size, BLOCK_VALUES // max(1, dim))))
    return max(1, min(blocks, spark.sparkContext.defaultParallelism), math.ceil(blocks / TASK_BLOCKS))


def _blocks(rows: DataFrame, size: int, tasks: int) -> DataFrame:
    """Rows ``(row, id, v, norm)`` as blocks, in order of length within each of the range partitions."""
    def pack(batches):
        # no batch is held longer than the block it ends
        held, n, dim = [], 0, 0

        def block():
            t = pa.Table.from_batches(held).sort_by([("id", "ascending"), ("row", "ascending")]).combine_chunks()
            v = t.column("v").combine_chunks() if t.num_rows else None
            values, d = _values(v.chunk(0) if isinstance(v, pa.ChunkedArray) else v)
            return pa.RecordBatch.from_arrays(
                [pa.array([t.column("row").to_pylist()], pa.list_(pa.int64())),
                 pa.array([t.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([d], pa.int32()),
                 pa.array([values.astype("<f8").tobytes()], pa.binary()),
                 pa.array([max(t.column("norm").to_pylist())], pa.float64())],
                names=["rows", "ids", "dim", "data", "top"])
        for b in batches:
            at = 0
            while at < b.num_rows:
                dim = max(dim, len(b.column("v")[at]))
                room = max(1, min(size, BLOCK_VALUES // max(1, dim))) - n
                if room <= 0:
                    yield block()
                    held, n, dim = [], 0, 0
                    continue
                part = b.slice(at, room)
                held.append(part)
                n += part.num_rows
                at += part.num_rows
        if n:
            yield block()
    order = [F.col("norm").desc(), F.col("id"), F.col("row")]
    # the id and row split a length that many rows share
    return rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(pack, BLOCK)


def _rotation(rows: DataFrame, scale: int, safe: bool) -> np.ndarray:
    """Eigenvectors of the sum of outer products, greatest first (none where integers may not be doubles).

    d * d numbers a task, added by Spark; the driver holds d * d.
    """
    def run(batches):
        total = np.zeros((0, 0))
        for b in batches:
            m, d = _values(b.column("v"))
            if d > len(total):
                big = np.zeros((d, d))
                big[:len(total), :len(total)] = total
                total = big
            m = np.floor(m * scale)
            total[:d, :d] += m.T @ m
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "x"])
    if not safe:
        return np.zeros((0, 0))
    found = rows.select("v").mapInArrow(run, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    dim = int(max(found["i"].max(), found["j"].max())) + 1 if len(found) else 0
    out = np.zeros((dim, dim))
    out[found["i"], found["j"]] = found["x"]
    return np.linalg.eigh(out)[1][:, ::-1].copy() if dim else out


def top_inner_products(vectors: DataFrame, k: int = TOP, query_every: int = QUERY_EVERY, scale: int = SCALE,
                       id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best rows of every query row."""
    spark = vectors.sparkSession
    v = F.col(f"`{vec_col}`").cast("array<double>")
    rows = (vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"))
            .where(F.col("id").isNotNull() & F.col("v").isNotNull()
                   & F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * scale).cast("double"), F.lit(2.0))))
    # a row number that stays: ids may repeat
    rows = kept(rows.select(F.monotonically_increasing_id().alias("row"), "id", "v").withColumn(
        "norm", F.when(F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0)) * scale < FLOAT_SAFE, norm)
        .otherwise(F.lit(float("inf")))))
    facts = rows.agg(F.max("norm").alias("top"), F.max(F.size("v")).alias("dim"), F.count(F.lit(1)).alias("n")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not facts.n:
        return empty
    rotation = _rotation(rows, scale, facts.top < float("inf"))
    cands = kept(_blocks(rows, BLOCK_ROWS, _tasks(spark, facts.n, BLOCK_ROWS, facts.dim)))
    c = cands.orderBy(F.col("top").desc()).limit(1).collect()[0]
    longest = spark.sparkContext.broadcast((rotation, (c.rows, c.ids, np.frombuffer(c.data, "<f8").reshape(len(c.ids), c.dim))))
    asked = rows.where(F.col("id") % query_every == 0)
    queries = kept(_blocks(asked, QUERY_ROWS, _tasks(spark, asked.count(), QUERY_ROWS, facts.dim))
                   .withColumn("n", F.monotonically_increasing_id()))
    queries = kept(_seeded(queries, longest, scale, k))
    found = None
    for chunk in _chunks(queries, max(1, CHUNK_VALUES // (max(1, facts.dim) * QUERY_ROWS))):
        told = [(r.top, r.rows, r.ids, np.frombuffer(r.data, "<f8").reshape(len(r.ids), r.dim), np.array(r.floors))
                for r in chunk]
        part = kept(_scan(cands, spark.sparkContext.broadcast((rotation, told)), scale, k))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return empty
    w = Window.partitionBy("query_row").orderBy(F.col("place").desc(), "vec_id", "row")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _chunks(queries: DataFrame, blocks: int):
    """Query blocks on the driver, a bounded number at a time."""
    last = -1
    while True:
        chunk = queries.where(F.col("n") > last).orderBy("n").limit(blocks).collect()
        if not chunk:
            return
        yield chunk
        last = chunk[-1].n
        if len(chunk) < blocks:
            return


def oracle() -> str:
    """DuckDB SQL of the same rows by scoring all pairs."""
    return f"""
with kept as materialized (
  select vec_id, row_number() over () as n, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v
  from embeddings where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.n, q.vec_id as query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v),
           lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0)::bigint as score
  from kept q join kept c on c.n <> q.n where q.vec_id % {QUERY_EVERY} = 0)
select query_id, rank, vec_id, score from (
  select *, (row_number() over (partition by n order by score desc, vec_id))::int as rank from scored) r
where rank <= {TOP}"""
