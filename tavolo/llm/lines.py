"""Boilerplate lines by their spread over sites.

A line is what stands between newlines, compared without blanks at its
ends.  Lines of at least ``MIN_CHARS`` characters get a HyperLogLog sketch
of their sites (the document's source); sketches are partial aggregates
and merge by aggregation, so a line that stands in a third of all documents
costs one row a task.  A line whose estimate lies near the threshold gets
an exact distinct count.  Lines on ``MIN_SITES`` sites or more are
boilerplate: only the first copy stays (smallest document id, then line
number), all others are cut out.

Only DataFrame operations.  Defined cases: null text stays null and has no
lines; the empty text has one blank line, which is never boilerplate; a
null site is no site; documents of a null id keep all lines (they count
towards the spread); equal rows are cut alike, and when the first copy's
id occurs twice, both keep it; an empty table gives an empty result;
other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tavolo.llm.common import kept

MIN_SITES = 10
MIN_CHARS = 8
SKETCH_LOG_SIZE = 10
NEAR = 0.25            # estimates within this share of the threshold are counted exactly


def _lines(docs: DataFrame) -> DataFrame:
    """``doc_id, site, pos, line`` hash of every line long enough."""
    one = docs.select("doc_id", "site", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    return (one.withColumn("raw", F.trim("raw", F.lit(" \t\r")))
            .where(F.length("raw") >= MIN_CHARS)
            .select("doc_id", "site", "pos", F.xxhash64("raw").alias("line")))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``line, first``: boilerplate line hashes and where the copy that stays is; docs ``(doc_id, site, text)``."""
    lines = _lines(docs)
    low, high = min_sites * (1 - NEAR), min_sites * (1 + NEAR)
    spread = kept(lines.groupBy("line")
                  .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_LOG_SIZE))).alias("sites"),
                       F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "pos"))).alias("first"))
                  .where(F.col("sites") >= low))
    near = spread.where(F.col("sites") <= high).select("line")
    exact = (lines.join(near, "line", "left_semi").select("line", "site").distinct()
             .groupBy("line").agg(F.count("site").alias("n")).where(F.col("n") >= min_sites).select("line"))
    return kept(spread.where(F.col("sites") > high).unionByName(
        spread.where(F.col("sites") <= high).join(exact, "line", "left_semi")).select("line", "first"))


def cut_lines(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", site_col: str = "source",
              text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with the text's boilerplate lines removed, and two columns more:
    ``__n_lines`` and ``__n_cut`` (with further underscores before them if ``docs`` has such columns)."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{site_col}`").cast("string").alias("site"),
                         F.col(f"`{text_col}`").cast("string").alias("text"))
    found = boilerplate(narrow, min_sites)
    hits = (_lines(narrow).drop("site").join(found, "line")
            .where(F.col("doc_id").isNotNull() & (F.struct("doc_id", "pos") != F.col("first")))
            .groupBy("doc_id").agg(F.collect_set("pos").alias("cut")))
    # the columns of docs travel in one struct, so no name of theirs meets one used here
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        F.col(f"`{id_col}`").alias("doc_id"), F.split(F.col(f"`{text_col}`").cast("string"), "\n").alias("all"))
    joined = whole.join(hits, "doc_id", "left")
    places = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("cut"))
    left = F.concat_ws("\n", F.transform(places, lambda i: F.get("all", i)))
    text = F.when(F.col("cut").isNull(), F.col("row").getField(text_col)).otherwise(left)
    counts = {"__n_lines": F.when(F.col("all").isNull(), 0).otherwise(F.size("all")).cast("long"),
              "__n_cut": F.coalesce(F.size(F.coalesce("cut", F.array().cast("array<int>"))), F.lit(0)).cast("long")}
    taken = {c.lower() for c in docs.columns}
    out = [(text if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns]
    for name, value in counts.items():
        while name in taken:
            name = "_" + name
        out.append(value.alias(name))
    return joined.select(*out)


ORACLE = f"""
with l as (select doc_id, source site, unnest(range(len(string_split(text, chr(10))))) pos,
    unnest(string_split(text, chr(10))) raw from documents where text is not null),
t as (select doc_id, site, pos, trim(raw, chr(32) || chr(9) || chr(13)) line from l),
f as (select * from t where length(line) >= {MIN_CHARS}),
b as (select line from f group by line having count(distinct site) >= {MIN_SITES}),
first as (select line, min(struct_pack(d := doc_id, p := pos)) place from f join b using (line) where doc_id is not null group by line),
gone as (select doc_id, pos from f join first using (line) where struct_pack(d := doc_id, p := pos) <> place),
kept as (select l.doc_id, count(*) n, string_agg(raw, chr(10) order by l.pos) text from l
    anti join gone on l.doc_id = gone.doc_id and l.pos = gone.pos group by l.doc_id),
a as (select doc_id, count(*) n_lines from l group by doc_id)
select d.doc_id, coalesce(a.n_lines, 0) n_lines, coalesce(a.n_lines, 0) - coalesce(kept.n, 0) n_removed,
    sha256(case when d.text is null then null else coalesce(kept.text, '') end) text_sha256
from documents d left join a using (doc_id) left join kept using (doc_id)"""
