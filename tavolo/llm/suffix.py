"""Removal of long byte strings that occur more than once, by suffix arrays.

A byte goes when a string of ``length`` bytes that covers it also starts
anywhere else.  Steps:

1. *Anchors.*  Every window of ``length`` bytes is filed under the least
   32-byte gram hash in it, so equal windows share the anchor at the same
   place in them.  Neighbouring windows under one anchor form a segment
   (a text has about one per 185 bytes).  Segments of equal content are
   counted by an aggregate; all windows of a content seen twice repeat.
2. *Slices.*  What is left are the different contents under one anchor, one
   copy of each.  An anchor with up to ``SLICE_CONTENTS`` of them is a
   slice.  A larger one (a passage that very many texts share) is split by
   a further key that equal windows share as well: a segment is cut at a
   grid fixed to the anchor, and a piece is filed under the bytes that all
   its windows cover.  Pieces are counted again by content and by key, and
   those of still larger keys are cut on a finer grid, down to single
   windows.  So every slice is complete, none is large, and the rows of a
   split are in proportion to the bytes that are split.
3. *Index family.*  A task passes through its slices in order, batch by
   batch.  A batch gets its suffix array (the starts of its windows in the
   order of key, first bytes and fingerprint, in which equal strings are
   neighbours), is merge-scanned against the levels held so far, and
   becomes a level itself; levels of like size merge, so their sizes grow
   geometrically.  Matches are compared byte by byte.  Levels keep the
   slice that the next batch may go on with, and nothing else.
4. *Removal.*  The matched windows of a document are united and cut out.

Contents and pieces are told apart by 64-bit fingerprints (polynomials
over random byte codes) under a 64-bit key.

Defined cases: null is the empty text; texts shorter than ``length`` stay
whole; equal texts remove each other's windows, every copy included; a
row is known by a digest of its id and text, so null ids take part like
any other, rows that share an id are judged each by its own text, and
equal rows are answered alike; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tavolo.llm.common import kept, text_of
from tavolo.llm.words import BYTE_CODE, _power_tables, batches_of, mix

MATCH_BYTES = 400
GRAM_BYTES = 32
SLICE_CONTENTS = 128       # different contents under one key that go to one slice
GRIDS = (50, 10, 1)        # steps of the grids that larger keys are split on, all dividing the length

ANCHORS = "row binary, first int, windows int, offset int, anchor long, content long, own long"
# a segment or piece: its windows start at ``first`` of the text and ``place`` from the anchor
PIECES = ("key long, content long, own long, row binary, first int, windows int, place int, alone boolean, "
          "data binary")
SPANS = "row binary, first int, stop int"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
PACKED = "row binary, doc_id long, packed binary"


class Prints:
    """Fingerprints of any substring of a buffer."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        up, self.down = _power_tables(n + 1)
        self.total = np.empty(n + 1, dtype=np.uint64)
        self.total[0] = 0
        np.cumsum(BYTE_CODE[raw] * up[:n], out=self.total[1:])

    def of(self, start, end) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start])


def window_anchors(gram: np.ndarray, width: int) -> np.ndarray:
    """For each start, the position of the least of ``width`` gram hashes from it (the first, if equal)."""
    bits = np.uint64(max(1, len(gram).bit_length()))
    key = ((gram >> bits) << bits) | np.arange(len(gram), dtype=np.uint64)
    k = 1
    while 2 * k <= width:
        key = np.minimum(key[:-k], key[k:])
        k *= 2
    if k < width:
        key = np.minimum(key[:len(key) - (width - k)], key[width - k:])
    return (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def segments(texts: list[bytes], length: int = MATCH_BYTES):
    """Segments of a batch of texts: (text, first start, windows, anchor offset, anchor, content)."""
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.cumsum(sizes) - sizes
    gram_bytes = min(GRAM_BYTES, length)
    counts = np.maximum(sizes - length + 1, 0)
    n = int(counts.sum())
    if not n:
        return tuple(np.empty(0, np.int64) for _ in range(4)) + tuple(np.empty(0, np.uint64) for _ in range(2))
    prints = Prints(raw)
    at = np.arange(len(raw) - gram_bytes + 1)
    gram = prints.of(at, at + gram_bytes)
    anchor = window_anchors(gram, length - gram_bytes + 1)
    text = np.repeat(np.arange(len(texts)), counts)
    start = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(base, counts)
    place = anchor[start]
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[new[1:], n] - 1
    first, place, windows, text = start[new], place[new], last - new + 1, text[new]
    offset = place - first
    shape = (offset.astype(np.uint64) << np.uint64(32)) + windows.astype(np.uint64)
    content = mix(prints.of(first, start[last] + length) + mix(shape))
    return text, first - base[text], windows, offset, gram[place], content


def _texts(batch) -> list[bytes]:
    return [(t or "").encode() for t in batch.column("text").to_pylist()]


def _row_numbers(rows: pa.Array) -> np.ndarray:
    """64 bits of each row's digest."""
    return np.frombuffer(b"".join(r[:8] for r in rows.to_pylist()), dtype="<u8")


def _anchors(length):
    def run(batches):
        for b in batches:
            rows = b.column("row")
            texts = _texts(b)
            numbers = _row_numbers(rows)
            for i, j in batches_of(texts):
                t, first, windows, offset, anchor, content = segments(texts[i:j], length)
                own = mix(mix(numbers[i:j][t]) + first.astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [rows.slice(i, j - i).take(pa.array(t)),
                     *(pa.array(x.astype(np.int32)) for x in (first, windows, offset)),
                     *(pa.array(x.view(np.int64)) for x in (anchor, content, own))],
                    names=[c.split()[0] for c in ANCHORS.split(", ")])
    return run


def _batch(columns: dict, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    names = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[t]) for n, t in names], names=[n for n, _ in names])


def _cut_segments(batches):
    """Rows and their wanted segments -> segments with their bytes."""
    for b in batches:
        unpack = zstandard.ZstdDecompressor().decompress
        out = {c.split()[0]: [] for c in PIECES.split(", ")}
        kinds = []
        for row, packed, wanted in zip(*(b.column(c).to_pylist() for c in ("row", "packed", "wanted"))):
            raw = unpack(packed)
            for w in wanted:
                for c in ("content", "own", "first", "windows", "place", "alone"):
                    out[c].append(w[c])
                out["key"].append(w["anchor"])
                out["row"].append(row)
                out["data"].append(raw[w["first"]:w["first"] + w["stop"]])
                kinds.append(w["kinds"])
        rows = _batch(out, PIECES)
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(kinds, pa.int64())], names=[*rows.schema.names, "kinds"])


def split_pieces(data: list[bytes], key, windows, place, length: int, step: int):
    """Segments cut on a grid: (segment, first window, windows, key, content) of every piece.

    Windows whose place from the anchor lies in one cell of the grid are a
    piece.  All of them cover the same bytes from the cell's end on, which
    with the cell's number and the old key are the new key; equal windows
    lie in one cell and cover equal bytes.
    """
    raw = np.frombuffer(b"".join(data), dtype=np.uint8)
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    base = np.cumsum(sizes) - sizes
    low, high = place // step, (place + windows - 1) // step
    n = high - low + 1
    seg = np.repeat(np.arange(len(data)), n)
    cell = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[seg]
    begin = np.maximum(cell * step, place[seg]) - place[seg]
    end = np.minimum(cell * step + step, place[seg] + windows[seg]) - place[seg]
    prints = Prints(raw)
    at = base[seg] + begin
    content = mix(prints.of(at, base[seg] + end - 1 + length) + mix((end - begin).astype(np.uint64)))
    # from the last place of the cell to the end of the window at its first place
    core = base[seg] + (cell + 1) * step - 1 - place[seg]
    covered = prints.of(core, core + length - step + 1)
    new_key = mix(mix(covered + mix(cell.astype(np.uint64))) + key.astype(np.int64).view(np.uint64)[seg])
    return seg, begin, end - begin, new_key.view(np.int64), mix(content + new_key).view(np.int64)


def _split(length, step):
    """Pieces of the rows of large keys, on the next grid."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            data, rows = b.column("data").to_pylist(), b.column("row")
            first, windows, place = (b.column(c).to_numpy().astype(np.int64) for c in ("first", "windows", "place"))
            for i in range(0, len(data), 4096):
                at = slice(i, i + 4096)
                seg, begin, n, key, content = split_pieces(data[at], b.column("key").to_numpy()[at], windows[at], place[at],
                                                           length, step)
                whole = seg + i
                own = mix(mix(_row_numbers(rows)[whole]) + (first[whole] + begin).astype(np.uint64))
                yield _batch({
                    "key": key, "content": content, "own": own.view(np.int64), "row": rows.take(pa.array(whole)),
                    "first": (first[whole] + begin).astype(np.int32), "windows": n.astype(np.int32),
                    "place": (place[whole] + begin).astype(np.int32),
                    "alone": b.column("alone").take(pa.array(whole)),
                    "data": [data[s][f:f + k - 1 + length] for s, f, k in zip(whole.tolist(), begin.tolist(), n.tolist())]},
                    PIECES)
    return run


class IndexFamily:
    """Suffix arrays of batches, in levels whose sizes grow geometrically.

    A level holds the different windows of its batches in suffix order:
    (key, first bytes, fingerprint) of each, and the window's number.
    ``matched`` tells, by number, which windows occur more than once.
    """

    def __init__(self, length: int):
        self.length = length
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.raw = np.zeros(0, dtype=np.uint8)
        self.start = np.zeros(0, dtype=np.int64)       # window number -> place in raw
        self.matched = np.zeros(0, dtype=bool)

    ORDER = np.dtype([("key", "<i8"), ("head", ">u8"), ("print", "<u8")])

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether windows are equal, byte by byte (pairs of window numbers)."""
        out = np.ones(len(a), dtype=bool)
        span = np.arange(self.length)
        for i in range(0, len(a), 4096):
            x, y = self.start[a[i:i + 4096], None] + span, self.start[b[i:i + 4096], None] + span
            out[i:i + 4096] = (self.raw[x] == self.raw[y]).all(axis=1)
        return out

    def _sorted(self, order: np.ndarray, numbers: np.ndarray):
        """Sort; mark windows equal to their neighbour; keep one of each."""
        by = np.lexsort((order["print"], order["head"], order["key"]))
        order, numbers = order[by], numbers[by]
        near = np.flatnonzero(order[1:] == order[:-1])
        near = near[self._equal(numbers[near], numbers[near + 1])]
        self.matched[numbers[near]] = self.matched[numbers[near + 1]] = True
        first = np.ones(len(numbers), dtype=bool)
        first[near + 1] = False
        return order[first], numbers[first]

    def add(self, raw: np.ndarray, start: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Index a batch's windows (a key each); returns their numbers."""
        numbers = np.arange(len(self.start), len(self.start) + len(start))
        order = np.empty(len(start), dtype=self.ORDER)
        order["key"] = key
        head = np.zeros((len(start), 8), dtype=np.uint8)
        for i in range(min(8, self.length)):
            head[:, i] = raw[start + i]
        order["head"] = head.view(">u8")[:, 0]
        order["print"] = Prints(raw).of(start, start + self.length)
        self.start = np.concatenate([self.start, start + len(self.raw)])
        self.raw = np.concatenate([self.raw, raw])
        self.matched = np.concatenate([self.matched, np.zeros(len(start), dtype=bool)])
        new = self._sorted(order, numbers)
        for level in self.levels:
            self._scan(level, new)
        while self.levels and len(self.levels[-1][0]) <= 2 * len(new[0]):
            old = self.levels.pop()
            new = self._sorted(np.concatenate([old[0], new[0]]), np.concatenate([old[1], new[1]]))
        self.levels.append(new)
        return numbers

    def _scan(self, level, new) -> None:
        """Merge-scan: equal neighbours of two suffix arrays, level and batch."""
        order, numbers = np.concatenate([level[0], new[0]]), np.concatenate([level[1], new[1]])
        by = np.lexsort((order["print"], order["head"], order["key"]))
        order, numbers = order[by], numbers[by]
        near = np.flatnonzero(order[1:] == order[:-1])
        near = near[self._equal(numbers[near], numbers[near + 1])]
        self.matched[numbers[near]] = self.matched[numbers[near + 1]] = True

    def forget(self, before: int) -> None:
        """Drop the windows numbered below ``before``; the others count from 0 again."""
        if before >= len(self.start):
            self.__init__(self.length)
            return
        place = self.start[before]
        self.raw, self.start, self.matched = self.raw[place:], self.start[before:] - place, self.matched[before:]
        self.levels = [(o[n >= before], n[n >= before] - before) for o, n in self.levels]
        self.levels = [level for level in self.levels if len(level[0])]


class Slices:
    """A task's slices in order of key: pending rows of the open slice, and what the family says of the closed ones."""

    def __init__(self, length: int):
        self.length, self.family, self.rows = length, IndexFamily(length), []
        self.key = None

    def batch(self, key, data, row, first, windows, alone):
        """Add rows sorted by key; yields the spans of the slices that are over."""
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        base = np.cumsum(sizes) - sizes
        total = windows.sum()
        inner = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows)
        numbers = self.family.add(np.frombuffer(b"".join(data), dtype=np.uint8), np.repeat(base, windows) + inner,
                                  np.repeat(key, windows))
        at = numbers[0] + np.cumsum(windows) - windows
        self.rows += [x for x in zip(at.tolist(), windows.tolist(), row, first.tolist(), alone.tolist(), key.tolist())]
        self.key = key[-1]

    def close(self, last_key=None):
        """Spans of all slices but ``last_key``'s, which alone is held from then on."""
        spans, held = [], []
        for r in self.rows:
            if last_key is not None and r[5] == last_key:
                held.append(r)
                continue
            at, n, row, first, alone, _ = r
            if not alone:
                continue
            hit = np.flatnonzero(np.diff(np.concatenate([[0], self.family.matched[at:at + n], [0]]).astype(np.int8)))
            spans += [(row, first + int(a), first + int(z) - 1 + self.length) for a, z in zip(hit[::2], hit[1::2])]
        before = held[0][0] if held else len(self.family.start)
        self.family.forget(before)
        self.rows = [(r[0] - before, *r[1:]) for r in held]
        return spans


def _matches(length):
    """Rows of a task's slices, sorted by key -> matched runs of windows."""
    def run(batches):
        slices = Slices(length)
        for b in batches:
            data = b.column("data").to_pylist()
            if not data:
                continue
            key, windows, first = (b.column(c).to_numpy().astype(np.int64) for c in ("key", "windows", "first"))
            row, alone = b.column("row").to_pylist(), b.column("alone").to_numpy(zero_copy_only=False).astype(bool)
            spans = []
            for i, j in batches_of(data):
                # the slice that was open goes on, or is over
                if slices.rows and slices.key != key[i]:
                    spans += slices.close()
                slices.batch(key[i:j], data[i:j], row[i:j], first[i:j], windows[i:j], alone[i:j])
                spans += slices.close(key[j - 1])
            yield _spans(spans)
        yield _spans(slices.close())
    return run


def _spans(spans) -> pa.RecordBatch:
    return _batch(dict(zip(("row", "first", "stop"), zip(*spans))) if spans else {"row": [], "first": [], "stop": []}, SPANS)


def _pack(batches):
    for b in batches:
        pack = zstandard.ZstdCompressor(level=3).compress
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"),
                                          pa.array([pack(t) for t in _texts(b)], pa.binary())],
                                         names=["row", "doc_id", "packed"])


def remaining(raw: bytes, firsts, stops) -> tuple[bytes, int, int]:
    """What is left without the united spans, the bytes removed and the number of maximal runs."""
    out, at, removed, runs, end = [], 0, 0, 0, -1
    for a, z in sorted(zip(firsts, stops)):
        if a > end:
            if end >= 0:
                removed += end - at
            out.append(raw[max(end, 0):a])
            at, end = a, z
            runs += 1
        elif z > end:
            end = z
    if runs:
        removed += end - at
        out.append(raw[end:])
        return b"".join(out), removed, runs
    return raw, 0, 0


def _remove(batches):
    for b in batches:
        unpack = zstandard.ZstdDecompressor().decompress
        rows = []
        for packed, spans in zip(b.column("packed").to_pylist(), b.column("spans").to_pylist()):
            raw = unpack(packed)
            left, removed, runs = remaining(raw, *zip(*((s["first"], s["stop"]) for s in spans))) if spans else (raw, 0, 0)
            rows.append((len(raw), removed, runs, hashlib.sha256(left).hexdigest(), left.decode(errors="replace")))
        cols = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])],
            names=[c.split()[0] for c in RESULT.split(", ")])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(row, doc_id, text)``: a row is known by a digest of its id and text."""
    whole = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(" "), F.coalesce("text", F.lit("")))
    return text_of(docs, id_col, text_col).select(F.unhex(F.md5(whole)).alias("row"), "doc_id", "text")


def _counted(rows: DataFrame) -> DataFrame:
    """``rows (key, content, own, ...)`` with ``copies`` of their content and, for one copy of each, its key's ``kinds``."""
    contents = kept(rows.groupBy("content").agg(F.count(F.lit(1)).alias("copies"), F.min("own").alias("one"),
                                                F.min("key").alias("key")))
    kinds = contents.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    wanted = kept(contents.join(kinds, "key", "left").where("copies > 1 or kinds > 1")
                  .select("content", "copies", "one", F.coalesce("kinds", F.lit(1)).alias("kinds")))
    return rows.join(wanted, "content").where((F.col("copies") > 1) | (F.col("own") == F.col("one"))).withColumn(
        "kinds", F.when(F.col("own") == F.col("one"), F.col("kinds")).otherwise(F.lit(1))).drop("one")


def _in_slices(rows: DataFrame, length: int) -> DataFrame:
    """Spans of the slices: rows of a key lie in one task, in order."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.select(*[c.split()[0] for c in PIECES.split(", ")]).repartition(n, "key").sortWithinPartitions("key")
            .mapInArrow(_matches(length), SPANS))


def repeated_spans(docs: DataFrame, length: int = MATCH_BYTES,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, first, stop``: byte spans made of windows that also start elsewhere (they may overlap)."""
    texts = _keyed(docs, id_col, text_col)
    found = texts.mapInArrow(_anchors(length), ANCHORS).withColumnRenamed("anchor", "key")
    stop = F.col("windows") + (length - 1)
    seen = kept(_counted(found).select("row", "first", stop.alias("stop"), "windows", F.col("key").alias("anchor"),
                                       (-F.col("offset")).alias("place"), "content", "own", "kinds",
                                       (F.col("copies") == 1).alias("alone")))
    lists = (seen.where("kinds > 1").groupBy("row").agg(F.collect_list(F.struct(
        "anchor", "content", "own", "kinds", "first", "stop", "windows", "place", "alone")).alias("wanted")))
    cut = (texts.mapInArrow(_pack, PACKED).join(lists, "row").select("row", "packed", "wanted")
           .mapInArrow(_cut_segments, f"{PIECES}, kinds long"))
    large = F.col("kinds") > SLICE_CONTENTS
    steps = [g for g in GRIDS if length % g == 0 and g < length]
    # the rows of large keys pass through the slices' shuffle by their own number, and are split behind it
    spread = F.when(large, F.col("own")).otherwise(F.col("key"))
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = cut.withColumn("deal", spread).repartition(n, "deal").sortWithinPartitions("deal", "key")
    first = kept(both.mapInArrow(_first_level(length, steps[0], SLICE_CONTENTS), f"{PIECES}, stop int"))
    spans = [seen.where(~F.col("alone")).select("row", "first", (F.col("first") + F.col("stop")).alias("stop")),
             first.where("stop is not null").select("row", "first", "stop")]
    pieces = first.where("stop is null").drop("stop")
    for level in range(len(steps)):
        if pieces.isEmpty():
            break
        counted = kept(_counted(pieces))
        ends = (F.col("first") + F.col("windows") + (length - 1)).alias("stop")
        spans.append(counted.where("copies > 1 and alone").select("row", "first", ends))
        # a copy that is removed already still matches others
        one = counted.withColumn("alone", F.col("alone") & (F.col("copies") == 1))
        if level + 1 == len(steps):
            break
        spans.append(kept(_in_slices(one.where((F.col("kinds") > 1) & ~large), length)))
        pieces = kept(one.where(large).select(*[c.split()[0] for c in PIECES.split(", ")])
                      .mapInArrow(_split(length, steps[level + 1]), PIECES))
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    return out


def _first_level(length, step, limit):
    """Spans of the anchors' slices, and the pieces of the segments of anchors over the limit."""
    matches, split = _matches(length), _split(length, step)

    def run(batches):
        def small():
            for b in batches:
                hot = b.column("kinds").to_numpy() > limit
                if hot.any():
                    for p in split([b.filter(pa.array(hot))]):
                        out.append(pa.RecordBatch.from_arrays([*p.columns, pa.nulls(p.num_rows, pa.int32())],
                                                              names=[*p.schema.names, "stop"]))
                yield b.filter(pa.array(~hot))
        out: list = []
        for s in matches(small()):
            n = s.num_rows
            blank = {c.split()[0]: [None] * n for c in PIECES.split(", ")} | {
                "row": s.column("row"), "first": s.column("first")}
            whole = _batch(blank, PIECES)
            yield pa.RecordBatch.from_arrays([*whole.columns, s.column("stop")], names=[*whole.schema.names, "stop"])
            while out:
                yield out.pop()
        while out:
            yield out.pop()
    return run


def remove_repeats(docs: DataFrame, length: int = MATCH_BYTES,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and the remaining ``text`` of every document.

    Bytes that removal leaves without the rest of their character show as
    U+FFFD in ``text``; the digest is of the bytes.
    """
    spans = (repeated_spans(docs, length, id_col, text_col).groupBy("row")
             .agg(F.collect_list(F.struct("first", "stop")).alias("spans")))
    return (_keyed(docs, id_col, text_col).mapInArrow(_pack, PACKED).join(spans, "row", "left")
            .select("doc_id", "packed", "spans").mapInArrow(_remove, RESULT))
