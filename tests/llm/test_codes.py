"""Vector codes against a plain Lloyd in Python integers."""

import hashlib
import math
import random

import numpy as np

from tavolo.llm import codes
from tavolo.sources import Tables


def plain(rows):
    """{(id, vector): (code, error)} and the digest, by comparing every part with every entry."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = 16 * max(1, -(-max((len(v) for _, v, _ in kept), default=0) // 16))
    width = dim // 16
    ints = [[int(x) * 256 if abs(x) >= 2**53 else math.floor(x * 256) for x in v] + [0] * (dim - len(v))
            for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:64]
    books = [[ints[k][p * width:(p + 1) * width] for k in order] for p in range(16)]

    def near(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(2):
        for p in range(16):
            parts = [v[p * width:(p + 1) * width] for v in ints]
            where = [near(x, books[p])[1] for x in parts]
            for e in range(len(books[p])):
                own = [x for x, w in zip(parts, where) if w == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    out, by_label = [], {}
    for (i, _, lab), v in zip(kept, ints):
        hits = [near(v[p * width:(p + 1) * width], books[p]) for p in range(16)]
        error = sum(h[0] for h in hits)
        out.append((i, "".join(f"{h[1]:02x}" for h in hits), error, lab))
        by_label[lab] = by_label.get(lab, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()

    def long(x):
        return x if x < 2**63 else None

    return sorted(((i, c, long(e), long(by_label[lab]) if all(
        long(o[2]) is not None for o in out if o[3] == lab) else None, digest) for i, c, e, lab in out), key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 5, "x") for r in rows],
                                 "vec_id long, embedding array<double>, label int, id int, v string")


def found(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()),
                  key=str)


def test_codes_equal_a_plain_lloyd(spark, small_dir):
    t = Tables(spark, small_dir).embeddings
    rows = [tuple(r) for r in t.select("vec_id", "embedding", "label").collect()]
    assert found(codes.compress(t)) == plain(rows)


def test_odd_vectors(spark):
    rnd = random.Random(5)
    def vector(n):
        return [rnd.choice([-1.5, -0.001, 0.0, 0.25, 3.0]) for _ in range(n)]
    rows = [(rnd.choice([None, *range(90)]), vector(20), rnd.choice([None, 1, 2])) for _ in range(150)]
    rows += rows[:10] + [(1, None, 1), (2, [], 2), (3, [float("nan")] * 20, 1), (4, [float("inf")] * 20, 1),
                         (5, [None] * 20, 1), (6, [0.5] * 3, None), (7, [-0.0] * 20, 2)]
    same = [(200 + i, [0.5] * 20, 7) for i in range(200)]           # one vector for many ids
    assert found(codes.compress(table(spark, rows + same))) == plain(rows + same)
    assert codes.compress(table(spark, rows).where("false")).collect() == []
    assert codes.compress(table(spark, [(1, None, 1), (2, [float("nan")], 1)])).collect() == []
    few = [(i, vector(16), i) for i in range(3)]
    assert found(codes.compress(table(spark, few))) == plain(few)


def test_components_of_any_size(spark):
    rnd = random.Random(9)
    rows = [(i, [rnd.choice([1e300, -1e30, 1.7e308, 2.0**40, 1.5]) for _ in range(16)], i % 3) for i in range(80)]
    rows += [(100 + i, [2.0**20 + i, -3.25] * 8, 9) for i in range(40)]
    assert found(codes.compress(table(spark, rows))) == plain(rows)


def test_dual_tree_equals_all_pairs():
    rnd = np.random.default_rng(1)
    for n, k, d, scale in [(1, 1, 4, 5), (5, 3, 1, 3), (900, 64, 4, 60), (3000, 64, 4, 3), (700, 7, 9, 100), (300, 64, 4, 0)]:
        points = np.floor(rnd.normal(size=(n, d)) * scale).astype(np.int64)
        book = points[rnd.integers(0, n, k)]
        best = ((((points[:, None, :] - book[None]) ** 2).sum(2) * 64) + np.arange(k)).min(1) % 64
        t = codes.DualTree(points, book)
        assert (t.codes == best).all()
        for e in range(k):
            assert (t.sums[e] == points[best == e].sum(0)).all() and t.counts[e] == (best == e).sum()
