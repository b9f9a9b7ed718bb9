"""The filter interaction audit against a replay of every order on every document."""

import random
import re
from itertools import permutations

import numpy as np

from tavolo.llm import audit
from tavolo.sources import Tables

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def replay(docs, labels):
    """``{(part, order, step): figures}`` by applying the orders document by document."""
    good, toxic = ({i for i, q, t in labels if i is not None and (q if k == 0 else t) == 1} for k in (0, 1))
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": i is not None and least[t] < i}
        rows.append((lang or "", fails, i in good, i in toxic))
    out, total = {}, {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(r[1][f] for r in own) - len(gone),
                    sum(r[1][f] and sum(r[1].values()) == 1 for r in own), sum(r[2] for r in gone),
                    sum(r[3] for r in gone)]
                total[part, f] = total.get((part, f), 0) + len(gone)
    return {k: [*v, total[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def found(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost,
                                              r.toxic_lost, r.shapley] for r in rows}
    assert len(out) == len(rows)
    return out


def test_audit_equals_a_replay_of_the_orders(spark, small_dir):
    t = Tables(spark, small_dir)
    docs = [tuple(r) for r in t.documents.select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in t.labels.select("doc_id", "quality", "toxic").collect()]
    assert found(audit.audit_filters(t.documents, t.labels)) == replay(docs, labels)


def test_audit_of_odd_rows(spark):
    rnd = random.Random(7)
    texts = [None, "", " \t\n", "A B C", "x " * 150, "Ab$", " ".join(f"w{i}" for i in range(120)),
             " ".join(f"W{i}X" for i in range(120)), "y " * 300_000, "日本 é & z", "\x1c\x85 " * 101]
    docs = [(rnd.choice([None, *range(30)]), rnd.choice(texts), rnd.choice([None, "", "en", "de"]))
            for _ in range(200)]
    docs += docs[:20]                                               # repeated rows
    labels = [(rnd.choice([None, *range(40)]), rnd.choice([None, 0, 1]), rnd.choice([None, 0, 1])) for _ in range(60)]
    frame = spark.createDataFrame([(*d, 1, "h", 2) for d in docs],
                                  "doc_id long, text string, lang string, n int, part string, mask int")
    marks = spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int, n int")
    assert found(audit.audit_filters(frame, marks)) == replay(docs, labels)
    assert audit.audit_filters(frame.where("false"), marks).collect() == []
    no_labels = found(audit.audit_filters(frame, marks.where("false")))
    assert all(v[4] == v[5] == 0 for v in no_labels.values())


def test_walk_equals_subset_sums():
    rnd = np.random.default_rng(3)
    for _ in range(20):
        masks = rnd.permutation(32)[:rnd.integers(0, 33)]
        counts = rnd.integers(0, 50, (len(masks), 3))
        states = audit.subset_states(masks, counts)
        for s in range(32):
            assert (states[s] == counts[masks & s == 0].sum(axis=0)).all()


def test_a_shared_text_is_combined_before_it_is_shuffled(spark):
    """A third of all rows with one text: its rows reach the window as one row a part and label pair."""
    n = 30_000
    docs = spark.range(n).selectExpr("id as doc_id", "if(id % 3 = 0, 'same', cast(id as string)) as text",
                                     "'en' as lang")
    labels = spark.range(10).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    r = {(x.filter_order, x.step): x for x in audit.audit_filters(docs, labels).collect()}
    assert r["EABCD", 1].removed == n // 3 - 1 and r["EABCD", 1].good_lost == 3
    assert r["ABCDE", 1].removed == n and r["ABCDE", 5].redundant == n // 3 - 1
