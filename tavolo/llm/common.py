"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tavolo.plans import cut_lineage

_BROADCAST: dict = {}


def text_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` alone: other columns, whatever their names, go."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))


def broadcast_once(df: DataFrame, make, *args):
    """Broadcast ``make(*args)`` once per application (for tables of fixed size, like a vocabulary)."""
    sc = df.sparkSession.sparkContext
    key = (sc.applicationId, make.__name__, args)
    if key not in _BROADCAST:
        _BROADCAST[key] = sc.broadcast(make(*args))
    return _BROADCAST[key]


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder (survives lost executors)."""
    return cut_lineage(df)


def components(edges: DataFrame) -> DataFrame:
    """Connected components: ``(node, component)`` for every node of ``edges (a, b)``.

    The component is its smallest node.  Each round hangs the neighbours of
    a node on its smallest neighbour, first the larger ones, then the
    smaller ones; a path of n nodes needs about log n rounds, and a star
    needs one.  A node's minimum is a partial aggregate, so a hub of any
    degree is split over tasks.  Edges with a null end are ignored.
    """
    e = kept(edges.where("a is not null and b is not null and a <> b")
             .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = kept(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))


def _stars(e: DataFrame) -> bool:
    """Whether every node hangs on one smallest node, which hangs on none."""
    several = e.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return several.isEmpty() and e.select(F.col("v").alias("u")).join(e.select("u"), "u", "left_semi").isEmpty()
