"""Best-fit packing of documents into token sequences by hierarchical residuals.

Every partition packs its own pieces best-fit, longest first.  Bins that
are nearly full are final; each underfull bin goes on as one item to the
next round, where fewer partitions pack such items again, and so on up
the tree.  Only (bin, load) pairs climb, so the last rounds are small;
when a round's bins would be too many for one task the tree keeps as many
partitions as they need and ends when merging stops helping.

Defined cases: null text is the empty text, which is the one end token;
equal rows are packed each on its own; a piece of full length is a
sequence of its own; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import gc
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tavolo.llm.bpe import Encoder, load_tables
from tavolo.llm.common import broadcast_once, kept, text_of

SEQUENCE_TOKENS = 2048
END_ID = 0
NEARLY_FULL = 0.995        # a bin this full is final
FAN_IN = 8                 # partitions merged into one in a round
TASK_ITEMS = 400_000       # underfull bins one task may take

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", bin long, offset long, load long"
CLIMBED = "bin long, load long, parent long, shift long, parent_load long"


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item (taken in the given order), and the bins' loads.

    An item goes to the fullest bin that still takes it.  Bins are kept by
    the room left; a bit mask of rooms finds the least that suffices.
    """
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    bins, offsets, loads = [], [], []
    for s in sizes:
        fit = rooms >> s
        if fit:
            room = s + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(loads), capacity
            loads.append(0)
        bins.append(b)
        offsets.append(loads[b])
        loads[b] += s
        left = room - s
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, loads


def token_pieces(docs: DataFrame, path: str, length: int = SEQUENCE_TOKENS, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``length`` ids of every document's ids and the end id."""
    tables = broadcast_once(docs, load_tables, path)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        gc.disable()  # see bpe: many live objects, no cycles
        enc = Encoder(tables.value)
        for b in batches:
            for first, ids, offsets in enc.groups(b.column("text")):
                docs_of = b.column("doc_id").slice(first, len(offsets) - 1).to_pylist()
                raw, out = memoryview(ids.tobytes()), []
                for d, lo, hi in zip(docs_of, offsets[:-1].tolist(), offsets[1:].tolist()):
                    n = hi - lo + 1
                    for i, at in enumerate(range(0, n, length)):
                        size = min(length, n - at)
                        crc = zlib.crc32(raw[4 * (lo + at):4 * min(lo + at + size, hi)])
                        out.append((d, i, at, size, zlib.crc32(end, crc) if at + size == n else crc))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(zip(*out))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return text_of(docs, id_col, text_col).mapInArrow(run, PIECES)


def _numbered(level: int, bins) -> np.ndarray:
    """Bin ids that differ between rounds and tasks, and are the same when a task is run again."""
    return (level << 58) + (TaskContext.get().partitionId() << 34) + np.asarray(bins, dtype=np.int64)


def _pack(frames: Iterator[pd.DataFrame], level: int, size: str, order: list[str], capacity: int):
    """Pack one task's items; adds bin, offset and load."""
    parts = list(frames)  # a task's items: metadata of a bounded number of rows
    if not parts:
        return
    x = pd.concat(parts, ignore_index=True)
    x = x.sort_values([size, *order], ascending=[False] + [True] * len(order), kind="stable", ignore_index=True)
    bins, offsets, loads = best_fit(x[size].tolist(), capacity)
    x["to"] = _numbered(level, bins)
    x["at"] = np.asarray(offsets, dtype=np.int64)
    x["total"] = np.asarray(loads, dtype=np.int64)[np.asarray(bins, dtype=np.int64)]
    yield x


def pack(pieces: DataFrame, length: int = SEQUENCE_TOKENS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces``."""
    full = math.ceil(NEARLY_FULL * length)

    def first(frames):
        for x in _pack(frames, 0, "length", ["doc_id", "piece"], length):
            yield x.rename(columns={"to": "bin", "at": "offset", "total": "load"})

    # a task packs at most TASK_ITEMS pieces; round robin keeps the split even
    n = pieces.count()
    spread = pieces.repartition(max(1, math.ceil(n / TASK_ITEMS)))
    placed = kept(spread.mapInPandas(first, PLACED))
    bins = kept(placed.where(F.col("load") < full).select("bin", "load").distinct())
    moves = []
    tasks, count, level = None, bins.count(), 0
    tasks = max(1, math.ceil(n / TASK_ITEMS))
    while count > 1:
        level += 1
        fewer = max(math.ceil(tasks / FAN_IN), math.ceil(count / TASK_ITEMS))

        def climb(frames, level=level):
            for x in _pack(frames, level, "load", ["bin"], length):
                yield x.rename(columns={"to": "parent", "at": "shift", "total": "parent_load"})

        step = kept(bins.repartition(fewer).mapInPandas(climb, CLIMBED))
        moves.append(step)
        bins = kept(step.where(F.col("parent_load") < full)
                    .select(F.col("parent").alias("bin"), F.col("parent_load").alias("load")).distinct())
        before, count = count, bins.count()
        if fewer == 1 or (fewer >= tasks and count >= 0.99 * before):
            break
        tasks = fewer
    where = None  # bin of round 0 -> final bin and its offset there
    for step in moves:
        s = step.select(F.col("bin").alias("b"), "parent", "shift")
        if where is None:
            where = s.select(F.col("b").alias("bin"), F.col("parent").alias("last"), F.col("shift").alias("by"))
        else:
            where = where.join(s, F.col("last") == F.col("b"), "left").select(
                "bin", F.coalesce("parent", "last").alias("last"),
                (F.col("by") + F.coalesce("shift", F.lit(0))).alias("by"))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if where is None:
        return placed.select(*cols, F.col("bin").alias("sequence_id"), "offset")
    return placed.join(where, "bin", "left").select(
        *cols, F.coalesce("last", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"))


def pack_documents(docs: DataFrame, path: str, length: int = SEQUENCE_TOKENS, end_id: int = END_ID,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    return pack(kept(token_pieces(docs, path, length, end_id, id_col, text_col)), length)
