"""Url verdicts: host and path rules, then trust and distrust over the host graph.

A page that a rule fits takes the verdict of the longest one.  For all
others the host decides.  Hosts are linked by absolute links in the pages
(page host -> linked host) and by each host's parent domain, both ways.
Trust is a personalised PageRank that starts from hosts with allowed
pages and follows links; distrust starts from hosts with blocked pages
and goes against the links (who points at a blocked host is distrusted).
Start weights are the hosts' counts of allowed, or blocked, pages, so both
ranks are on one scale and a host that no link connects changes nothing.
Rounds go on until no host's rank moves by more than ``TOLERANCE`` of
itself between two checkpoints (and no new host was reached).  A host is
blocked when distrust holds more than ``MAX_DISTRUST`` of the sum of both,
by more than the tolerance; a host that neither reaches is allowed.

Only DataFrame operations: hosts and links are aggregated first, so a
page-rich host is one row, and both ranks go through one join and one sum
an iteration.

Defined cases: a null url, or one without ``://``, has an empty host and
path and is judged by the host graph like any other (the empty host has
no links and is allowed); null html has no links; repeated rows are judged alike
and count as often as they occur; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tavolo.llm.common import kept

# (verdict, host, path prefix)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
DAMPING = 0.85
TOLERANCE = 1e-3
CUT_EVERY = 4           # rounds between checkpoints
TASK_LINKS = 200_000    # links of a task
SQL_ROUNDS = 60         # rounds of the SQL, enough for the tolerance at this damping
MAX_DISTRUST = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\bhref\s{0,8}=\s{0,8}["']?(?:[a-z][a-z0-9+.-]{0,20}:)?//([^/?#"'\s<>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The lower-cased host and the path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return (F.coalesce(F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.lit("")),
            F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit("")))


def fits(host: Column, path: Column, rule) -> Column:
    """Whether a rule's host is the host or a parent of it and its path a prefix."""
    _, h, p = rule
    return ((host == h) | host.endswith("." + h)) & path.startswith(p)


def first_rule(rules, value, host: Column, path: Column) -> Column:
    """``value(rule)`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        out = F.when(fits(host, path, r), F.lit(value(r))).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: links between different hosts of pages ``(host, html)``."""
    linked = pages.where("host <> ''").select(
        F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    linked = linked.withColumn("dst", F.translate("dst", UPPER, LOWER))
    out = linked.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("n"))
    hosts = pages.where("host <> ''").select("host").distinct()
    parent = F.regexp_replace("host", r"^[^.]*\.", "")
    # a top-level name is no parent: it would join everything
    up = hosts.select(F.col("host").alias("src"), parent.alias("dst")).where("dst <> src and instr(dst, '.') > 0")
    both = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return (out.unionByName(both.withColumn("n", F.lit(1.0)))
            .groupBy("src", "dst").agg(F.sum("n").alias("n")))


def spread(links: DataFrame, seeds: DataFrame, damping: float, tolerance: float = TOLERANCE) -> DataFrame:
    """``kind, host, score``: personalised PageRank of each kind of seed, to the tolerance.

    ``links (of, src, dst, share)``: what part of src's score goes to dst;
    ``seeds (kind, host, weight)``.  A round's ranks only grow, by at most
    the damping of the last growth, so a small growth bounds what is left.
    """
    # tasks by the size of the graph: one that fits in a task makes its rounds there, without a shuffle
    tasks = max(1, math.ceil(links.count() / TASK_LINKS))
    links = kept(links.coalesce(tasks))
    base = kept(seeds.select("kind", "host", (F.col("weight") * (1 - damping)).alias("score")).coalesce(tasks))
    # starting from the base alone, every round adds the walks that are one link longer
    rank = last = base
    while True:
        for _ in range(CUT_EVERY):
            moved = rank.join(links, (rank.kind == links.of) & (rank.host == links.src)).select(
                "kind", F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
            rank = moved.unionByName(base).coalesce(tasks).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        rank = kept(rank.coalesce(tasks))
        before = last.select("kind", "host", F.col("score").alias("was"))
        if rank.join(before, ["kind", "host"], "left").where(
                F.col("was").isNull() | (F.col("score") > F.col("was") * (1 + tolerance))).isEmpty():
            return rank
        last = rank


def judge_urls(pages: DataFrame, rules=RULES, damping: float = DAMPING, tolerance: float = TOLERANCE,
               max_distrust: float = MAX_DISTRUST, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page."""
    host, path = host_and_path(F.col(f"`{url_col}`").cast("string"))
    p = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"),
                     F.col(f"`{html_col}`").cast("string").alias("html"))
    p = p.withColumns({"rule": first_rule(rules, lambda r: r[1] + r[2], F.col("host"), F.col("path")),
                       "ruled": first_rule(rules, lambda r: r[0], F.col("host"), F.col("path"))})
    counts = kept(p.where("host <> ''").groupBy("host").agg(
        F.count_if(F.col("ruled") == "allow").alias("allow"), F.count_if(F.col("ruled") == "block").alias("block")))
    seeds = reduce(DataFrame.unionByName, [
        counts.where(F.col(k) > 0).select(F.lit(k).alias("kind"), "host", F.col(k).cast("double").alias("weight"))
        for k in ("allow", "block")])
    links = kept(host_links(p))
    turned = links.select(F.lit("allow").alias("of"), "src", "dst", "n").unionByName(
        links.select(F.lit("block").alias("of"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    sums = turned.groupBy("of", "src").agg(F.sum("n").alias("all"))
    shares = turned.join(sums, ["of", "src"]).select("of", "src", "dst", (F.col("n") / F.col("all")).alias("share"))
    page = p.select("page_id", "host", "path", "rule", "ruled")
    scores = spread(shares, seeds, damping, tolerance)
    bad = (scores.groupBy("host").agg(F.sum(F.when(F.col("kind") == "allow", F.col("score")).otherwise(0.0)).alias("trust"),
                                      F.sum(F.when(F.col("kind") == "block", F.col("score")).otherwise(0.0)).alias("distrust"))
           .where(F.col("distrust") > max_distrust * (1 + tolerance) * (F.col("trust") + F.col("distrust")))
           .select(F.col("host").alias("bad_host")))
    return page.join(kept(bad), F.col("host") == F.col("bad_host"), "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow")).alias("verdict"))


def oracle(rules=RULES, rounds: int = SQL_ROUNDS, damping: float = DAMPING, tolerance: float = TOLERANCE,
           max_distrust: float = MAX_DISTRUST) -> str:
    """The same as DuckDB SQL."""
    def case(value):
        out = " ".join(
            f"when (host = '{r[1]}' or ends_with(host, '.{r[1]}')) and starts_with(path, '{r[2]}') then '{value(r)}'"
            for r in sorted(rules, key=lambda r: (len(r[1] + r[2]), r), reverse=True))
        return f"case {out} end"
    # in DuckDB's RE2 \\b and the bounds mean the same here
    link = LINK.replace("'", "''")
    parts = [f"""
u as (select page_id, html, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
h as (select page_id, html, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') path from u),
p as (select *, {case(lambda r: r[1] + r[2])} "rule", {case(lambda r: r[0])} ruled from h),
hosts as (select distinct host from p where host <> ''),
a as (select host src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') dst from p where host <> ''),
up as (select host src, regexp_replace(host, '^[^.]*\\.', '') dst from hosts),
up2 as (select * from up where dst <> src and strpos(dst, '.') > 0),
l as (select src, dst, sum(n) n from (select src, dst, 1.0::double n from a where src <> dst union all select src, dst, 1.0 from up2
  union all select dst, src, 1.0 from up2) group by all),
t as (select 'allow' kind, src, dst, n from l union all select 'block', dst, src, n from l),
s as materialized (select kind, src, dst, n / sum(n) over (partition by kind, src) share from t),
w as materialized (select ruled kind, host, count(*)::double weight from p
  where host <> '' and ruled is not null group by ruled, host),
r0 as (select kind, host, weight * {1 - damping} score from w)"""]
    for i in range(rounds):
        parts.append(f"""r{i + 1} as materialized (select kind, host, sum(score) score from (
  select r.kind, s.dst host, r.score * s.share * {damping} score from r{i} r join s on s.kind = r.kind and s.src = r.host
  union all select kind, host, weight * {1 - damping} from w) group by kind, host)""")
    parts.append(f"""b as (select host from (select host, sum(case when kind = 'allow' then score else 0 end) trust,
  sum(case when kind = 'block' then score else 0 end) distrust from r{rounds} group by host)
  where distrust > {max_distrust * (1 + tolerance)} * (trust + distrust))""")
    return "with " + ",\n".join(parts) + """
select page_id, p.host, path, "rule", coalesce(ruled, case when b.host is not null then 'block' else 'allow' end) verdict
from p left join b on p.host = b.host"""
