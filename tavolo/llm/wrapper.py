"""Main text of web pages by wrapper induction over the pages of a host.

Pages are read as folded trees (``markup``).  The distinct trees of a host
are aligned by simple tree matching, the largest match that keeps order
among siblings and joins equal labels only, into one wrapper: matched
nodes are one slot, others are added beside their neighbours.  Trees merge
in rounds of bounded groups (by hash, ``FAN`` a group on average), so a
host of any size is spread over tasks, and equal trees were one row before.

Every slot then has the texts of all pages of the host that hold it, as
partial aggregates: least and greatest hash, characters, characters in
links, and a sketch of how many different pages they are from.  A slot
whose text never varies over ``MIN_PAGES`` different pages is template.
Slots that vary, or that too few pages show, are content if no element
around them is chrome by the HTML standard or by its name (navigation,
footer, form, advert, comments ...).  If a page marks its main text
(``article``, ``main``), the content slots there are taken; else those of
the densest part of the wrapper, found by following the child that holds
most of the unlinked text.  A second pass writes the text of each page's
content slots, whole and in page order.

Defined cases: null html is the empty page, its text is empty; pages
without a host (null url, no ``://``) are the pages of one nameless host;
null ids and repeated rows are extracted row by row (equal pages count as
one page of evidence); broken markup is read as the HTML standard reads
it, as far as text is concerned; a page of any length or depth is read
whole; an empty table gives no rows; other columns are ignored whatever
their names.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tavolo.llm.common import kept
from tavolo.llm.markup import chrome_nodes, hash64, main_nodes, parse_skeleton, read_page
from tavolo.llm.urls import host_and_path

FAN = 32            # trees a group merges on average
MIN_PAGES = 4       # different pages that must show one text before it is template
DOMINANT = 0.5      # share of unlinked text that a child must exceed to be followed
MAX_LINKED = 0.5    # share of linked text above which an unmarked slot is no content
SKETCH = 8          # log2 of the registers of a page sketch (exact for the few pages that matter)
# Verdicts that may be broadcast to the pages; more are joined by a shuffle.
BROADCAST_TREES = 20_000
BROADCAST_NODES = 1_000_000


class Tree:
    """A wrapper: labelled nodes with ordered children."""
    __slots__ = ("label", "kids")

    def __init__(self, label: str):
        self.label, self.kids = label, []


def tree_of(nodes: list[tuple[int, str]]) -> tuple[Tree, list[Tree]]:
    """The tree of a skeleton and its nodes by number."""
    made = [Tree(label) for _, label in nodes]
    for (parent, _), t in zip(nodes, made):
        if parent >= 0:
            made[parent].kids.append(t)
    return made[0], made


def skeleton_of(root: Tree) -> tuple[str, list[Tree]]:
    """A tree's text form, parents first, and its nodes by number."""
    order, lines, at = [root], [f"-1 {root.label}"], 0
    while at < len(order):
        for k in order[at].kids:
            order.append(k)
            lines.append(f"{at} {k.label}")
        at += 1
    return "\n".join(lines), order


def _best_run(pairs: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The heaviest pairs ``(i, j, weight)`` that rise in both i and j."""
    pairs = sorted(pairs, key=lambda p: (p[0], -p[1]))
    rank = {j: r for r, j in enumerate(sorted({p[1] for p in pairs}), 1)}
    tree = [(0, -1)] * (len(rank) + 1)          # running maxima by j (Fenwick)
    back, best = [], (0, -1)
    for n, (_, j, weight) in enumerate(pairs):
        r, most = rank[j] - 1, (0, -1)
        while r:
            most = max(most, tree[r])
            r -= r & -r
        back.append(most[1])
        own = (most[0] + weight, n)
        best = max(best, own)
        r = rank[j]
        while r <= len(rank):
            tree[r] = max(tree[r], own)
            r += r & -r
    out, n = [], best[1]
    while n >= 0:
        out.append(pairs[n][:2])
        n = back[n]
    return out[::-1]


def match(a: Tree, b: Tree) -> dict[Tree, Tree]:
    """Simple tree matching: nodes of ``a`` to nodes of ``b`` (roots match)."""
    # pairs of equal labels whose parents are such a pair, parents first
    pairs, at, inner = [(a, b)], 0, []
    while at < len(pairs):
        x, y = pairs[at]
        by_label = defaultdict(list)
        for j, k in enumerate(y.kids):
            by_label[k.label].append((j, k))
        own = []
        for i, k in enumerate(x.kids):
            for j, other in by_label.get(k.label, ()):
                own.append((i, j, len(pairs)))
                pairs.append((k, other))
        inner.append(own)
        at += 1
    weight, run = [1] * len(pairs), [()] * len(pairs)
    for n in range(len(pairs) - 1, -1, -1):
        if inner[n]:
            where = {(i, j): p for i, j, p in inner[n]}
            chosen = _best_run([(i, j, weight[p]) for i, j, p in inner[n]])
            run[n] = [where[c] for c in chosen]
            weight[n] += sum(weight[p] for p in run[n])
    out, todo = {}, [0]
    while todo:
        n = todo.pop()
        out[pairs[n][0]] = pairs[n][1]
        todo.extend(run[n])
    return out


def merge(wrapper: Tree, other: Tree) -> None:
    """Adds to ``wrapper`` the nodes of ``other`` that it has no match for, each after its left neighbour."""
    found = match(other, wrapper)
    todo = [other]
    while todo:
        x = todo.pop()
        own = found[x]
        place = {id(k): i for i, k in enumerate(own.kids)}
        added = defaultdict(list)               # position in the wrapper -> new nodes after it
        last = -1
        for k in x.kids:
            if k in found:
                last = place[id(found[k])]
                todo.append(k)
            else:
                added[last].append(k)
        if added:
            own.kids = added[-1] + [n for i, k in enumerate(own.kids) for n in (k, *added[i])]


def merge_all(skeletons: list[str]) -> str:
    """One wrapper of many trees, the same for any order of them."""
    skeletons = sorted(set(skeletons), key=lambda s: (-len(s), s))
    root = tree_of(parse_skeleton(skeletons[0]))[0]
    for s in skeletons[1:]:
        merge(root, tree_of(parse_skeleton(s))[0])
    return skeleton_of(root)[0]


@lru_cache(maxsize=16)
def _whole(wrapper: str) -> tuple[Tree, dict[int, int]]:
    """A wrapper's tree and its nodes' numbers (kept for the next trees of the host)."""
    root, made = tree_of(parse_skeleton(wrapper))
    return root, {id(t): i for i, t in enumerate(made)}


def slots(skeleton: str, wrapper: str) -> list[int]:
    """The wrapper's node of every node of a tree; a node whose place was taken in another order has
    a slot of its own, below zero."""
    root, made = tree_of(parse_skeleton(skeleton))
    whole, number = _whole(wrapper)
    found = match(root, whole)
    return [number[id(found[t])] if t in found else -1 - i for i, t in enumerate(made)]


def _shapes(batches):
    """Per page and text-bearing node: hash and sizes of its texts; and the tree once a batch."""
    schema = pa.schema([("host", pa.string()), ("tree", pa.string()), ("skeleton", pa.string()), ("node", pa.int32()),
                        ("h", pa.int64()), ("chars", pa.int64()), ("linked", pa.int64()), ("page", pa.int64())])
    for b in batches:
        rows, told = [], set()
        for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
            page = read_page(html or "")
            skeleton = page.skeleton()
            tree = tree_key(skeleton)
            if (host, tree) not in told:
                told.add((host, tree))
                rows.append((host, tree, skeleton, None, None, None, None, None))
            chrome = chrome_nodes(page.nodes)
            linked: dict[int, int] = defaultdict(int)
            for node, text, link in page.pieces:
                if link:
                    linked[node] += len(text)
            texts = page.texts()
            own = hash64("\0".join(t for n, t in texts.items() if not chrome[n]))
            rows.extend((host, tree, None, n, hash64(t), len(t), linked[n], own)
                        for n, t in texts.items() if not chrome[n])
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else
            [pa.array([], f.type) for f in schema], schema=schema)


def tree_key(skeleton: str) -> str:
    return f"{hash64(skeleton) & (2**64 - 1):016x}{hash64(skeleton[::-1]) & (2**64 - 1):016x}"


def induce(trees: DataFrame) -> DataFrame:
    """``(host, wrapper)`` of the distinct ``trees (host, skeleton)``, merged in rounds of bounded groups."""
    now = trees.select("host", F.col("skeleton").alias("wrapper"))

    def join(key, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "wrapper": [merge_all(group["wrapper"].tolist())]})

    while True:
        size = now.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        if (size.agg(F.max("n")).first()[0] or 0) <= 1:
            return now
        bucket = F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / F.lit(FAN)).cast("long"))
        now = kept(now.join(size, "host").groupBy("host", bucket.alias("bucket"))
                   .applyInPandas(join, "host string, wrapper string").distinct())


def _aligned(batches):
    for b in batches:
        out = [slots(s, w) for s, w in zip(b.column("skeleton").to_pylist(), b.column("wrapper").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("host"), b.column("tree"), b.column("skeleton"),
                                          pa.array(out, pa.list_(pa.int32()))],
                                         names=["host", "tree", "skeleton", "slots"])


def content_slots(wrapper: str, figures: list[dict]) -> tuple[list[int], list[int]]:
    """(slots whose text is no template, those of them in the wrapper's densest part).

    The second leaves out slots of mostly linked text; marked main text does not weigh.
    """
    nodes = parse_skeleton(wrapper)
    marked = main_nodes(nodes)
    good = [f for f in figures if f["varies"]]
    plain = [f for f in good if f["linked"] <= MAX_LINKED * f["chars"]]
    mass = [0] * len(nodes)
    for f in plain:
        if not marked[f["slot"]]:
            mass[f["slot"]] += f["chars"] - f["linked"]
    kids = defaultdict(list)
    for i in range(len(nodes) - 1, 0, -1):
        mass[nodes[i][0]] += mass[i]
        kids[nodes[i][0]].append(i)
    top = 0
    while True:
        # a child that only holds text itself is one of the parts, not all of them
        best = max((k for k in kids[top] if kids[k]), key=lambda k: (mass[k], -k), default=None)
        if best is None or mass[best] <= DOMINANT * mass[top]:
            break
        top = best
    inside = [False] * len(nodes)
    for i, (parent, _) in enumerate(nodes):
        inside[i] = i == top or parent >= 0 and inside[parent]
    return [f["slot"] for f in good], [f["slot"] for f in plain if inside[f["slot"]]]


def _host_slots(batches):
    for b in batches:
        both = [content_slots(w, f or []) for w, f in zip(b.column("wrapper").to_pylist(),
                                                          b.column("figures").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [b.column("host"), *(pa.array([x[k] for x in both], pa.list_(pa.int32())) for k in (0, 1))],
            names=["host", "good", "dense"])


def content_nodes(skeleton: str, at: list[int], good: set[int], dense: set[int], own: set[int]) -> list[int]:
    """A tree's nodes of main text: the marked ones if any, else those in the densest part."""
    nodes = parse_skeleton(skeleton)
    marked, chrome = main_nodes(nodes), chrome_nodes(nodes)
    text = [i for i in range(len(nodes)) if not chrome[i] and (at[i] in good or at[i] in own)]
    return [i for i in text if marked[i]] or [i for i in text if at[i] in dense or at[i] in own]


def _verdicts(batches):
    for b in batches:
        rows = b.to_pylist()
        out = [content_nodes(r["skeleton"], r["slots"], set(r["good"]), set(r["dense"]), set(r["own"] or ()))
               for r in rows]
        yield pa.RecordBatch.from_arrays([b.column("host"), b.column("tree"), pa.array(out, pa.list_(pa.int32()))],
                                         names=["host", "tree", "content"])


def induce_content(pages: DataFrame) -> DataFrame:
    """``(host, tree, content)``: the nodes of main text of every tree of ``pages (host, html)``."""
    shapes = pages.select("host", "html").mapInArrow(
        _shapes, "host string, tree string, skeleton string, node int, h long, chars long, linked long, page long")
    # one row for each host, tree and node, whatever the number of pages
    nodes = kept(shapes.groupBy("host", "tree", "node").agg(
        F.max("skeleton").alias("skeleton"), F.min("h").alias("low"), F.max("h").alias("high"),
        F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
        F.hll_sketch_agg("page", F.lit(SKETCH)).alias("pages")))
    trees = nodes.where("skeleton is not null").select("host", "tree", "skeleton")
    wrappers = induce(trees)
    aligned = kept(trees.join(wrappers, "host").mapInArrow(
        _aligned, "host string, tree string, skeleton string, slots array<int>"))
    slot = F.col("slots")[F.col("node")]
    figures = (nodes.where("node is not null").drop("skeleton")
               .join(aligned.select("host", "tree", "slots"), ["host", "tree"])
               .groupBy("host", slot.alias("slot"), F.when(slot < 0, F.col("tree")).alias("own"))
               .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("chars").alias("chars"),
                    F.sum("linked").alias("linked"), F.hll_union_agg("pages").alias("pages"))
               .withColumn("varies", (F.col("low") != F.col("high"))
                           | (F.hll_sketch_estimate("pages") < MIN_PAGES)))
    # arrays as long as a wrapper, or a tree, which a task holds anyway
    shared = (figures.where("own is null").groupBy("host")
              .agg(F.collect_list(F.struct("slot", "chars", "linked", "varies")).alias("figures")))
    single = (figures.where("own is not null and varies").groupBy("host", F.col("own").alias("tree"))
              .agg(F.collect_list("slot").alias("own")))
    of_host = wrappers.join(shared, "host", "left").mapInArrow(
        _host_slots, "host string, good array<int>, dense array<int>")
    return (aligned.join(of_host, "host").join(single, ["host", "tree"], "left")
            .mapInArrow(_verdicts, "host string, tree string, content array<int>"))


def _pieces(batches):
    for b in batches:
        trees, pieces = [], []
        for html in b.column("html").to_pylist():
            page = read_page(html or "")
            trees.append(tree_key(page.skeleton()))
            pieces.append([{"node": n, "text": t} for n, t, _ in page.pieces])
        yield pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("url"), b.column("host"), pa.array(trees, pa.string()),
             pa.array(pieces, pa.list_(pa.struct([("node", pa.int32()), ("text", pa.string())])))],
            names=["page_id", "url", "host", "tree", "pieces"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``: the main text of every page (see the module's text)."""
    url = F.col(f"`{url_col}`").cast("string")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("url"),
                        host_and_path(url)[0].alias("host"), F.col(f"`{html_col}`").cast("string").alias("html"))
    content = kept(induce_content(rows))
    size = content.agg(F.count(F.lit(1)).alias("trees"), F.sum(F.size("content")).alias("nodes")).first()
    read = rows.mapInArrow(_pieces, "page_id long, url string, host string, tree string, "
                                    "pieces array<struct<node: int, text: string>>")
    # a tree's verdict goes to its pages: broadcast within a size, else by a shuffle of the pages' text
    small = size.trees <= BROADCAST_TREES and (size.nodes or 0) <= BROADCAST_NODES
    out = read.join(F.broadcast(content) if small else content, ["host", "tree"], "left")
    taken = F.filter("pieces", lambda p: F.array_contains("content", p["node"]))
    whole = F.array_join(F.transform(taken, lambda p: p["text"]), "")
    text = F.coalesce(F.trim(F.regexp_replace(whole, " +", " ")), F.lit(""))
    return out.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def oracle() -> str:
    """DuckDB SQL for pages whose main text is one ``article`` of headings, paragraphs and breaks."""
    refs = [("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("nbsp", "\u00a0"), ("amp", "&")]
    text = """regexp_replace(regexp_replace(coalesce(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), ''),
      '</?(h1|p|br)>', ' ', 'g'), '<[^>]*>', '', 'g')"""
    for name, sign in refs:
        # these references also stand without their semicolon (a cut-off title); the ampersand's own goes last
        text = f"regexp_replace({text}, '&{name};?', '{sign}', 'g')"
    return f"""
select page_id, url, text, length(text)::bigint as n_chars from (
  select page_id, url, trim(regexp_replace({text}, '[\\s\u00a0\u0085]+', ' ', 'g')) as text from pages)"""
