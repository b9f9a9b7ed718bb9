"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

A document's set is its distinct 5-word shingles (A-Z lower-cased; fewer
words: the whole sequence as one).  Every shingle draws a random
permutation of the registers, one position per level, so its ranks are
correlated; a register holds the least (level, fraction).  Registers
filled at a level cannot change at later ones, so a document stops once
all are filled.

Equal sets are one class, so copies cost one row.  Classes meet in bands
of registers.  In each bucket the smallest class is compared with all
others, on full sets; components follow; a bucket whose members are
still in different components goes on with ever more hubs a round, over
the pairs not yet compared, until every pair in it is either
compared or connected.  No bucket is capped, and none is expanded into
all its pairs while a component already explains them.

Defined cases: null or blank text has an empty set, no link and is kept;
a null id takes no part; equal texts share a component; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tavolo.llm.common import components, kept, text_of
from tavolo.llm.words import mix, shingle_sets

SHINGLE_WORDS = 5
SIMILARITY = 75           # percent
BANDS, ROWS = 32, 4       # a pair at the threshold misses every band once in 200,000
EMPTY = np.uint64(2**64 - 1)
HUB_GROWTH = 64           # more hubs in each next round of a bucket still apart
GROUP_ELEMENTS = 1 << 16  # shingles signed together

# A sketch holds 4 bits of every register; pairs whose agreement lies this many standard
# deviations below that of a pair at the threshold are not compared in full.
SKETCH_DEVIATIONS = 6
SKETCH = [f"s{i}" for i in range(BANDS * ROWS // 16)]
# Parity bits: every shingle flips one.  Two sets differ in at least as many shingles as
# their parity bits differ, so a pair over the allowed difference is surely no link.
PARITY_BITS = 2048

FEATURES = ("doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, "
            + ", ".join(f"{c} long" for c in SKETCH) + ", parity array<long>")
SETS = "doc_id long, shingles array<long>"


def signatures(sets: list[np.ndarray], registers: int) -> np.ndarray:
    """SuperMinHash of each set: one row of 64-bit register values (all ``EMPTY`` for an empty set)."""
    sig = np.full((len(sets), registers), EMPTY, dtype=np.uint64)
    flat = sig.reshape(-1)
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    if not sizes.sum():
        return sig
    h = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), sizes)
    swaps: list[np.ndarray] = []
    for level in range(registers):
        seed = np.uint64((2 * level + 1) * 0x9E3779B97F4A7C15 % 2**64)
        draw = mix(h + seed)
        slot = (level + (((draw >> np.uint64(40)) * np.uint64(registers - level)) >> np.uint64(24)).astype(np.int64))
        # where the slot's content stood before the earlier swaps of this element
        place = slot.copy()
        for i in range(level - 1, -1, -1):
            np.copyto(place, i, where=swaps[i] == place)
        at = doc * registers + place
        value = (mix(draw ^ h) >> np.uint64(8)) | np.uint64(level << 56)
        if level:
            open_ = flat[at] >= np.uint64(level << 56)
            np.minimum.at(flat, at[open_], value[open_])
        else:
            np.minimum.at(flat, at, value)
        more = (sig == EMPTY).any(axis=1)[doc]
        if not more.any():
            break
        swaps.append(slot)
        if not more.all():
            h, doc = h[more], doc[more]
            swaps = [s[more] for s in swaps]
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band of registers."""
    parts = sig.reshape(len(sig), bands, rows)
    keys = np.repeat((np.arange(bands, dtype=np.uint64) + np.uint64(1))[None, :], len(sig), axis=0)
    for r in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return keys


def sketch_words(sig: np.ndarray) -> np.ndarray:
    """The low 4 bits of every register, 16 registers a 64-bit word."""
    low = (mix(sig) & np.uint64(15)).reshape(len(sig), -1, 16)
    return (low << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64)


def sketch_least(percent: int) -> int:
    """Least agreement of two sketches that lets a pair pass."""
    n = BANDS * ROWS
    p = percent / 100 + (1 - percent / 100) / 16
    return int(n * p - SKETCH_DEVIATIONS * (n * p * (1 - p)) ** 0.5)


def parity_words(sets: list[np.ndarray]) -> np.ndarray:
    """The parity bits of each set, 64 a word."""
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    out = np.zeros((len(sets), PARITY_BITS), dtype=np.uint8)
    if sizes.sum():
        bit = (mix(np.concatenate(sets) + np.uint64(4242)) % np.uint64(PARITY_BITS)).astype(np.int64)
        at = np.repeat(np.arange(len(sets)), sizes) * PARITY_BITS + bit
        out = (np.bincount(at, minlength=out.size) & 1).astype(np.uint8).reshape(out.shape)
    return np.packbits(out, axis=1).view(np.uint64)


def _differing(a: str, b: str):
    """Parity bits in which two sets differ: at most the size of their symmetric difference."""
    one = F.zip_with(f"{a}.parity", f"{b}.parity", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(one, F.lit(0), lambda s, n: s + n)


def _agreeing(a: str, b: str):
    """Registers on which two sketches agree."""
    total = None
    for c in SKETCH:
        x = F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        n = F.lit(16) - F.bit_count(x)
        total = n if total is None else total + n
    return total


def _texts(batch) -> list[bytes]:
    return [(t or "").encode() for t in batch.column("text").to_pylist()]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.uint64).view(np.int64)))


def _features(batches):
    for b in batches:
        sets = shingle_sets(_texts(b), SHINGLE_WORDS)
        keys = np.empty((len(sets), BANDS), dtype=np.uint64)
        sketch = np.empty((len(sets), len(SKETCH)), dtype=np.uint64)
        parity = np.empty((len(sets), PARITY_BITS // 64), dtype=np.uint64)
        at = 0
        while at < len(sets):
            n, end = 0, at
            while end < len(sets) and (end == at or n + len(sets[end]) <= GROUP_ELEMENTS):
                n += len(sets[end])
                end += 1
            sig = signatures(sets[at:end], BANDS * ROWS)
            keys[at:end], sketch[at:end] = band_keys(sig, BANDS, ROWS), sketch_words(sig)
            for i in range(at, end, 1000):
                parity[i:min(i + 1000, end)] = parity_words(sets[i:min(i + 1000, end)])
            at = end
        a = np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
        c = np.array([mix(s + np.uint64(77)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(a.view(np.int64)),
             pa.array(c.view(np.int64)), _lists(list(keys)),
             *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in sketch.T), _lists(list(parity))],
            names=["doc_id", "n_shingles", "set_a", "set_b", "bands", *SKETCH, "parity"])


def _sets(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists(shingle_sets(_texts(b), SHINGLE_WORDS))],
                                         names=["doc_id", "shingles"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(left, "a").join(right, "b")
            .select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), both.alias("both"))
            .where(F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("both")))
            .select("a", "b"))


def _near(pairs: DataFrame, percent: int) -> DataFrame:
    """Of the joined rows ``x`` and ``y``, those whose sizes, parities and sketches allow the similarity.

    At a similarity of p percent, sets of n and m differ in at most (n + m) (100 - p) / (100 + p) shingles.
    """
    return pairs.where((F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent)
                       & (_agreeing("x", "y") >= sketch_least(percent))
                       & (_differing("x", "y") * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent)))


def near_duplicates(docs: DataFrame, percent: int = SIMILARITY,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document."""
    texts = text_of(docs, id_col, text_col)
    feats = kept(texts.mapInArrow(_features, FEATURES))
    classes = kept(feats.where("doc_id is not null and n_shingles > 0")
                   .groupBy("set_a", "set_b", F.col("n_shingles").alias("n"))
                   .agg(F.min(F.struct("doc_id", "bands", "parity", *SKETCH)).alias("r"))
                   .select("set_a", "set_b", "n", F.col("r.doc_id").alias("rep"), "r.bands", "r.parity", *[f"r.{c}" for c in SKETCH]))
    buckets = classes.select("rep", F.explode("bands").alias("key"))
    shared = (buckets.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("top"))
              .where("hub < top").select("key", "hub"))
    members = kept(buckets.join(shared, "key").select("key", "hub", "rep"))
    sets = kept(texts.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
                .mapInArrow(_sets, SETS))
    sketches = classes.select("rep", "n", "parity", *SKETCH)
    pairs = _near(members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
                  .join(sketches.alias("x"), F.col("a") == F.col("x.rep")).join(sketches.alias("y"), F.col("b") == F.col("y.rep")), percent)
    links = kept(_verified(pairs.select("a", "b"), sets, percent))
    parts = kept(components(links))
    # Ranks 0 .. done - 1 of each bucket have been compared with all its members.
    w = Window.partitionBy("key").orderBy("rep")
    open_ = kept(_apart(members.drop("hub"), parts).withColumn("rank", F.row_number().over(w) - 1))
    done = 1
    while not (rest := open_.where(F.col("rank") > done)).isEmpty():
        last = done * HUB_GROWTH
        hubs = open_.where(F.col("rank").between(done, last)).join(sketches, "rep")
        pairs = _near(hubs.alias("x").join(rest.join(sketches, "rep").alias("y"), F.expr("x.key = y.key and x.rank < y.rank and x.part <> y.part")), percent)
        found = kept(_verified(pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct(), sets, percent))
        if not found.isEmpty():
            links = kept(links.unionByName(found))
            parts = kept(components(links))
        done = last + 1
        open_ = kept(_apart(open_.drop("part"), parts))
    whole = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_a", "set_b", "n", F.coalesce("component", "rep").alias("part"))
    f = feats.select("doc_id", "n_shingles", "set_a", "set_b")
    return (f.join(whole, (f.set_a == whole.set_a) & (f.set_b == whole.set_b) & (f.n_shingles == whole.n), "left")
            .select("doc_id", "n_shingles", F.coalesce("part", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def _apart(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Members, with their components, of the buckets that lie in more than one component."""
    m = (members.join(parts.withColumnRenamed("node", "rep"), "rep", "left")
         .withColumn("part", F.coalesce("component", "rep")).drop("component"))
    keys = m.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
    return m.join(keys, "key", "left_semi")


def oracle() -> str:
    """DuckDB SQL of the same rows by counting the shingles that pairs share."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
with recursive w as materialized (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[ \\t-\\r]+'),
                             lambda x: x <> '') as w from documents),
s as materialized (
  select doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end) as sh from w),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as shared from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
l as materialized (
  select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * shared >= 75 * (a.n + b.n - shared)),
e as materialized (select x, y from l union all select y, x from l),
r(node, root) as (select doc_id, doc_id from documents union select r.node, e.y from r join e on e.x = r.root),
c as (select node, min(root) as component_id from r group by node)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, c.component_id = d.doc_id as kept
from documents d left join n on n.doc_id = d.doc_id join c on c.node = d.doc_id"""
