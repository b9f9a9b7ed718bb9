"""Tables that micro-batches write: append-only epochs, and keyed snapshots.

``EpochStore`` tables hold each micro-batch's rows under
``<root>/<name>/epoch=<id>`` with dynamic partition overwrite, so a
retried batch replaces exactly its own output (idempotent).  ``root``
must be a shared folder on a cluster (the same kind of place as
``spark.checkpoint.dir``).

``KeyedSnapshot`` holds the current row of every key without reading its
history: see its docstring.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F


class EpochStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, epoch: int, partition_by: tuple[str, ...] = ()) -> None:
        (df.withColumn("epoch", F.lit(int(epoch)))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*partition_by, "epoch").parquet(self.path(name)))

    def exists(self, name: str) -> bool:
        return Files(self.spark).exists(self.path(name))

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """A whole table; with its ``schema`` (without the epoch) also one that has no rows yet."""
        if schema is None:
            return self.spark.read.parquet(self.path(name))
        full = f"{schema}, epoch long"
        if not self.exists(name):
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(self.path(name))

    def read_epoch(self, name: str, epoch: int, schema: str) -> DataFrame:
        """One micro-batch's rows alone (empty if it wrote none)."""
        path = f"{self.path(name)}/epoch={int(epoch)}"
        if not Files(self.spark).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def latest(self, name: str, keys: list[str], order: str = "epoch",
               only: DataFrame | None = None) -> DataFrame:
        """Latest row per key (the current snapshot of a keyed table).

        ``order`` may name a per-key sequence in the rows; it goes before
        the epoch, so several versions of a key in one batch have one winner.
        ``only`` keeps rows that match its columns (which a key never changes).
        """
        df = self.read(name)
        if only is not None:
            df = df.join(only, only.columns, "left_semi")
        rank = F.struct(order, "epoch") if order != "epoch" else F.col("epoch")
        cols = [c for c in df.columns if c not in keys]
        g = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), rank).alias("v"))
        return g.select(*keys, *[F.col("v")[c].alias(c) for c in cols])


class Files:
    """The few file operations a manifest needs, on whatever file system holds the path."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength()

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Whole or not at all: written beside its place, then renamed."""
        fs, p = self._at(path)
        _, part = self._at(path + ".part")
        stream = fs.create(part, True)
        stream.write(text.encode())
        stream.close()
        fs.delete(p, False)
        fs.rename(part, p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


@dataclass
class Manifest:
    """Which epochs' files make up each bucket after a micro-batch, and small values kept with them."""
    epoch: int
    buckets: dict[int, list[int]] = field(default_factory=dict)
    meta: dict = field(default_factory=dict)

    def files(self) -> set[tuple[int, int]]:
        return {(b, e) for b, epochs in self.buckets.items() for e in epochs}


class KeyedSnapshot:
    """The current row of every key, in hash buckets, as base files with deltas.

    A micro-batch appends the new rows of the keys it changes under
    ``bucket=<b>/epoch=<e>`` and commits a manifest that names, for each
    bucket, the epochs to read (the newest row of a key wins).  A reader
    names the buckets it needs, so a batch reads the buckets it touches.
    A bucket with ``compact_every`` files is rewritten as one in the same
    write; rows that ``expire`` marks go then (to ``<name>_archive`` where
    asked), so a bucket's size follows the live keys and not the log.

    A retried epoch starts from the manifest before it and overwrites its
    own files, so it ends in the same state.  Files are deleted one
    committed epoch after they were last named, so that manifest stays
    readable.  Driver-side data is one entry a bucket and file: bounded by
    ``buckets * compact_every``.
    """

    def __init__(self, store: EpochStore, name: str, schema: str, keys: list[str], bucket_by: list[str] | None = None,
                 buckets: int = 64, compact_every: int = 8):
        self.store, self.name, self.schema, self.keys = store, name, schema, keys
        self.bucket_by = bucket_by or keys
        self.n, self.compact_every = buckets, compact_every
        self.columns = store.spark.createDataFrame([], schema).columns
        self.files = Files(store.spark)
        self.manifests = f"{store.root}/_manifests/{name}"

    def bucket(self, *cols) -> F.Column:
        """The bucket of the given bucket columns (default: the snapshot's own)."""
        return F.pmod(F.xxhash64(*[F.col(c) for c in cols or self.bucket_by]), F.lit(self.n)).cast("int")

    def buckets_of(self, rows: DataFrame, *cols) -> list[int]:
        """The buckets that ``rows`` touch (at most ``buckets`` small numbers)."""
        return sorted(r[0] for r in rows.select(self.bucket(*cols)).distinct().collect())

    def _epochs(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(self.manifests) if n.endswith(".json"))

    def before(self, epoch: int | None = None) -> Manifest:
        """The newest manifest older than ``epoch`` (None: the newest of all)."""
        older = [e for e in self._epochs() if epoch is None or e < epoch]
        if not older:
            return Manifest(-(1 << 62))
        m = json.loads(self.files.read(f"{self.manifests}/{older[-1]}.json"))
        return Manifest(older[-1], {int(b): e for b, e in m["buckets"].items()}, m["meta"])

    def _paths(self, m: Manifest, buckets: list[int] | None) -> list[str]:
        wanted = m.buckets if buckets is None else [b for b in buckets if b in m.buckets]
        return [f"{self.store.path(self.name)}/bucket={b}/epoch={e}" for b in wanted for e in m.buckets[b]]

    def bytes(self, epoch: int | None = None, buckets: list[int] | None = None) -> int:
        """What reading the buckets costs."""
        return sum(self.files.size(p) for p in self._paths(self.before(epoch), buckets))

    def rows(self, epoch: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Current rows as of before ``epoch`` (None: now), of some buckets or all."""
        return self._rows(self.before(epoch), buckets).drop("epoch")

    def _rows(self, m: Manifest, buckets: list[int] | None) -> DataFrame:
        spark, paths = self.store.spark, self._paths(m, buckets)
        if not paths:
            return spark.createDataFrame([], f"{self.schema}, epoch long")
        df = (spark.read.schema(f"{self.schema}, bucket int, epoch long")
              .option("basePath", self.store.path(self.name)).parquet(*paths).drop("bucket"))
        return self._newest(df)

    def _newest(self, df: DataFrame) -> DataFrame:
        cols = [c for c in df.columns if c not in self.keys]
        g = df.groupBy(*self.keys).agg(F.max_by(F.struct(*cols), "epoch").alias("v"))
        g = g.select(*self.keys, *[F.col("v")[c].alias(c) for c in cols])
        return g.where("not coalesce(gone, false)") if "gone" in cols else g

    def due(self, epoch: int) -> list[int]:
        """The buckets that the micro-batch ``epoch`` compacts."""
        return [b for b, epochs in self.before(epoch).buckets.items() if len(epochs) + 1 >= self.compact_every]

    def rows_with_archive(self) -> DataFrame:
        """Current rows and archived ones (a key that came back is current)."""
        rows = self.rows()
        old = self._newest(self.store.read(f"{self.name}_archive", self.schema)).select(*self.columns)
        return rows.unionByName(old.join(rows.select(*self.keys), self.keys, "left_anti"))

    def merge(self, rows: DataFrame, epoch: int, meta: dict | None = None,
              expire: Callable[[DataFrame], DataFrame] | None = None, archive: str | None = None,
              due: list[int] | None = None) -> None:
        """Commit the micro-batch ``epoch``: ``rows`` are the new rows of the keys it changes.

        A row with a true ``gone`` column deletes its key.  ``expire`` adds a
        boolean ``expired`` to the rows of buckets that are compacted, and
        ``archive`` names the flag of those that go to the archive table.
        ``due`` are the buckets to compact (default: those with enough files);
        snapshots whose rows expire together are compacted together.
        """
        base = self.before(epoch)
        due = self.due(epoch) if due is None else due
        new = rows.select(*self.columns).withColumn("epoch", F.lit(int(epoch)).cast("long"))
        if due:
            old = self._rows(base, due).select(*new.columns)
            in_due = self.bucket().isin(due)
            whole = self._newest(old.unionByName(new.where(in_due)))
            if expire is not None:
                whole = expire(whole)
                if archive:
                    moved = whole.where(F.col("expired") & F.col(archive)).select(*self.columns)
                    self.store.write(moved, f"{self.name}_archive", epoch)
                whole = whole.where("not coalesce(expired, false)")
            new = new.where(~in_due).unionByName(whole.select(*new.columns))
        self._write(new, epoch)
        written = {b for b in range(self.n)
                   if self.files.exists(f"{self.store.path(self.name)}/bucket={b}/epoch={int(epoch)}")}
        buckets = {b: list(e) for b, e in base.buckets.items()}
        for b in due:
            buckets.pop(b, None)
        for b in written:
            buckets.setdefault(b, []).append(int(epoch))
        self._commit(Manifest(int(epoch), buckets, base.meta | (meta or {})), base)

    def _write(self, rows: DataFrame, epoch: int) -> None:
        # what a failed attempt of this epoch left in buckets that the retry does not write must go
        for b in range(self.n):
            self.files.delete(f"{self.store.path(self.name)}/bucket={b}/epoch={int(epoch)}")
        # a file a bucket; a bucket that one key fills is split
        (rows.withColumns({"bucket": self.bucket(), "epoch": F.lit(int(epoch))}).hint("rebalance", F.col("bucket"))
         .write.mode("append").partitionBy("bucket", "epoch").parquet(self.store.path(self.name)))

    def _commit(self, new: Manifest, base: Manifest) -> None:
        self.files.write(f"{self.manifests}/{new.epoch}.json",
                         json.dumps({"buckets": new.buckets, "meta": new.meta}))
        older = self.before(base.epoch) if base.buckets or base.meta else None
        if older is None or older.epoch < -(1 << 61):
            return
        # only the two newest manifests can be read again
        for b, e in older.files() - base.files() - new.files():
            self.files.delete(f"{self.store.path(self.name)}/bucket={b}/epoch={e}")
        self.files.delete(f"{self.manifests}/{older.epoch}.json")
